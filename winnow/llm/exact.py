"""Exact dedup by content sort."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import arrow_map, byte_texts, narrow, written

SPACE = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
# Characters of the normalised text that range splitters look at; the driver holds samples of them.
SPLITTER_CHARS = 64


def normalise(text):
    out = F.coalesce(text, F.lit(""))
    for c in SPACE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _local(batches):
    """Rows sorted by text: one row per document with the number of its run, one more per run
    with the text and its count."""
    part = TaskContext.get().partitionId() << 33
    run, head = -1, None
    for b in batches:
        out = []
        for doc, chars, norm in zip(b.column("doc_id").to_pylist(), b.column("chars").to_pylist(),
                                    b.column("norm").cast(pa.binary()).to_pylist()):
            first = head is None or norm != head[3]
            if first:
                if head is not None:
                    out.append(tuple(head))
                run += 1
                head = [part + run, doc, chars, norm, 0, True]
            head[4] += 1
            out.append((part + run, doc, chars, None, None, first))
        yield _rows(out)
    if head is not None:
        yield _rows([tuple(head)])


LOCAL = "run long, doc_id long, chars long, norm binary, n long, first boolean"


def _rows(rows):
    columns = list(zip(*rows)) if rows else [[]] * 6
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.bool_()]
    names = [c.split()[0] for c in LOCAL.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _neighbours(batches):
    """Runs sorted by text: equal neighbours form a group, the first stays. A group has at most
    one run of each part of the input."""
    runs, norm, keep, size = [], None, None, 0

    def group():
        sha = hashlib.sha256(norm).hexdigest()
        n = len(runs)
        return pa.RecordBatch.from_pydict({
            "run": pa.array(runs, pa.int64()), "keep_id": pa.array([keep] * n, pa.int64()), "group_size": pa.array([size] * n, pa.int64()),
            "wins": [i == 0 for i in range(n)], "text_sha256": [sha] * n})

    held = []
    for b in batches:
        for run, doc, text, n in zip(b.column("run").to_pylist(), b.column("doc_id").to_pylist(), b.column("norm").to_pylist(), b.column("n").to_pylist()):
            if norm is None or text != norm:
                if norm is not None:
                    held.append(group())
                runs, norm, keep, size = [], text, doc, 0
            runs.append(run)
            size += n
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if norm is not None:
        yield group()


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without the characters 20 and 09 to 0D. Every part of the
    input is sorted by that text and its equal neighbours become one run, so that a group
    of any size reaches the next step as one row per part. The runs are range-partitioned by
    sampled splitters over the first characters and a hash, sorted by the whole text, and
    neighbours compared in full. Of a group, the row with the most code points stays, then the
    smallest doc_id; a null id is larger than any. Null texts are empty texts; all empty texts
    are one group. Of rows equal in id and text exactly one is kept. No rows give no rows."""
    rows = narrow(docs, doc_id=id_col, text=text_col).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"),
        normalise(F.col("text")).alias("norm"))
    order = ["norm", F.col("chars").desc(), F.col("doc_id").asc_nulls_last()]
    local = written(arrow_map(rows.sortWithinPartitions(*order), _local, LOCAL), "runs")
    heads = local.where(F.col("norm").isNotNull()).select(
        "run", "doc_id", "chars", "norm", "n",
        F.substring("norm", 1, SPLITTER_CHARS).alias("lead"), F.xxhash64("norm").alias("hash"))
    split = ["lead", "hash"]
    groups = arrow_map(heads.repartitionByRange(*split).sortWithinPartitions(*split, *order).select("run", "doc_id", "norm", "n"),
                       _neighbours, "run long, keep_id long, group_size long, wins boolean, text_sha256 string")
    return local.where(F.col("norm").isNull()).select("run", "doc_id", "first").join(groups, "run").select(
        "doc_id", "keep_id", "group_size", (F.col("first") & F.col("wins")).alias("kept"), "text_sha256")


def _leaders(text_col):
    white = "".join(SPACE).encode()

    def run(batches):
        """Of rows sorted by normalised text, the first of each run of equal ones."""
        last = None
        for b in batches:
            first = []
            for text in byte_texts(b.column(text_col)):
                norm = text.translate(None, white)
                first.append(norm != last)
                last = norm
            yield b.filter(pa.array(first, pa.bool_()))

    return run


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that `dedup` keeps, all their columns: one of each group of equal texts.

    The same two sorts, but whole rows take part, so that they meet no list of decisions afterwards: they are shuffled once and
    neither joined nor gathered in groups. Sorts go by the first characters and the digest of the normalised text, neighbours are
    compared in full. Of rows equal in code points and id the one with the largest hash of its text stays."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    text, norm = F.coalesce(F.col(text_col), F.lit("")), normalise(F.col(text_col))
    # columns of their own, as a sort takes an expression anew in every comparison; their names are longer than any in `docs`
    lead, sha, chars, doc, text_hash = ["_" * max(map(len, docs.columns)) + c for c in ("lead", "sha", "chars", "doc", "text")]
    keyed = docs.withColumns({
        lead: F.substring(norm, 1, SPLITTER_CHARS), sha: F.sha2(norm, 256), chars: F.length(text),
        doc: F.col(id_col).cast("long"), text_hash: F.xxhash64(text)})
    order = [lead, sha, F.col(chars).desc(), F.col(doc).asc_nulls_last(), F.col(text_hash).desc()]
    local = written(keyed.sortWithinPartitions(*order).mapInArrow(_leaders(text_col), keyed.schema), "runs")
    placed = local.repartitionByRange(lead, sha).sortWithinPartitions(*order)
    return placed.select(*columns).mapInArrow(_leaders(text_col), docs.schema)
