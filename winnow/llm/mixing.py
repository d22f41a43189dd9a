"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import narrow, null_safe, running, written

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Sources by code point, null last, take `weights` in turn and share `share` of all sizes; a
    target stops at `most` times its source's size and the excess goes to the others by weight
    until none is above. The level at which that ends is found in one pass over the sources in
    the order in which they fill up. One row per source: a small table, in one task."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.select("source", "source_size", w.alias("w"), F.row_number().over(by_name).alias("r"))
    ranked = ranked.withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("fills", F.col("cap") / F.col("w"))
    order = Window.orderBy("fills", "r")
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    ranked = ranked.withColumn("level", left / F.sum("w").over(onward))
    open_level = F.min(F.when(F.col("fills") > F.col("level"), F.struct("fills", "r", "level"))).over(everything)["level"]
    ranked = ranked.withColumn("open_level", open_level)
    return ranked.select("source", "source_size", F.when(
        F.col("open_level").isNull() | (F.col("fills") <= F.col("open_level")), F.col("cap")
    ).otherwise(F.col("open_level") * F.col("w")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: str = "mix",
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Words the mix takes of every document, as weighted fair queueing would serve them.

    Each source's documents are shuffled by a seeded hash of their id and queued `most` times
    over. A copy's virtual finish time is its source's cumulative words over the source's target.
    All copies are range-sorted by finish time and cut at the total budget; copies that finish
    at the same time stay or go together.

    Returns doc_id, size, source_size, target, taken, copies (taken over size) and text_hash
    (xxhash64 of the text, null as empty). Null text has size 0; a document without
    words takes nothing. Null source is a source of its own, last in order. Null ids share one
    hash and repeated rows stand side by side; both count as rows. An empty table gives no rows."""
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":" + seed)))
    rows = written(narrow(docs, doc_id=id_col, text=text_col, source=source_col).select(
        "doc_id", "source", key.alias("key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sizes")
    wanted = written(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, float(most)), "targets")
    goal = wanted.withColumnRenamed("source", "_source")
    queued = running(rows, ["key", "doc_id", "size", "text_hash"], F.col("size"), ["source"], "cum")
    queued = written(
        queued.join(goal, null_safe(queued, goal, {"source": "_source"}))
        .select("doc_id", "text_hash", "size", "source_size", "target", F.when(F.col("size") > 0, F.transform(
            F.sequence(F.lit(0), F.lit(most - 1)),
            lambda e: (e * F.col("source_size") + F.col("cum") + F.col("size")) / F.col("target"))).alias("finish")),
        "queued")
    served = queued.select(F.explode("finish").alias("finish"), "size").groupBy("finish").agg(F.sum("size").alias("size"))
    # two numbers come back to the driver
    budget = wanted.agg(F.sum("target")).first()[0]
    line = running(served, ["finish"], F.col("size"), out="cum")
    cut = line.where(F.col("cum") + F.col("size") <= F.lit(budget)).agg(F.max("finish")).first()[0]
    copies = F.size(F.filter("finish", lambda f: f <= F.lit(cut).cast("double")))
    copies = F.when(F.col("finish").isNull(), 0).otherwise(copies)
    return queued.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"),
                         copies.alias("copies"), "text_hash")
