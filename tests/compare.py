"""Side-by-side comparison of a Spark query and its SQL twin."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return "\0"
    if isinstance(v, float):
        return "\0" if math.isnan(v) else repr(round(v, 6))
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def differ(df, con, sql: str) -> str | None:
    """None when equal, else what differs first."""
    cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if cols != want_cols:
        return f"columns {cols} != {want_cols}"
    if got == want:
        return None
    a, b = set(got) - set(want), set(want) - set(got)
    clip = lambda rows: [tuple(c[:80] for c in r) for r in sorted(rows)[:2]]
    return f"rows {len(got)} != {len(want)}; only spark {len(a)} {clip(a)}; only sql {len(b)} {clip(b)}"
