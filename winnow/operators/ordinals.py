"""Dense row numbers over tables of any size, without a one-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import broadcast_if_small, freeze


def dense_ordinal(df: DataFrame, order: list[str], out: str = "ordinal", group: list[str] | None = None,
                  key: list[str] | None = None) -> DataFrame:
    """Add `out` = 0, 1, 2, ... in `order`, restarting per `group`.

    Only the key, group and order columns are range-sorted and checkpointed, with a
    per-partition counter; each partition then gets its offset from one row per partition.
    With `group`, the first number of each group is subtracted, so a group holding most of
    the rows is still spread over many tasks. The wide rows get their number by one join
    on `key`, which must be unique (the order columns by default)."""
    group, key = group or [], key or order
    names = list(dict.fromkeys([*group, *order, *key]))
    numbered = freeze(
        df.select(*names).orderBy(*group, *order).withColumn("_mid", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_mid", 33))
    # one row per sorted partition: bounded by the partition count
    sizes = numbered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    row_in_part = F.col("_mid") - F.shiftleft(F.col("_part"), 33)
    placed = numbered.join(F.broadcast(starts), "_part").withColumn("_pos", F.col("_start") + row_in_part)
    if group:
        keys = [f"_g{i}" for i in range(len(group))]
        first = placed.groupBy(*[F.col(g).alias(k) for g, k in zip(group, keys)]).agg(F.min("_pos").alias("_first"))
        same = [F.col(g).eqNullSafe(F.col(k)) for g, k in zip(group, keys)]
        placed = placed.join(broadcast_if_small(first), same).withColumn("_pos", F.col("_pos") - F.col("_first"))
    if set(names) == set(df.columns):
        return placed.select(*df.columns, F.col("_pos").alias(out))
    return df.join(placed.select(*key, F.col("_pos").alias(out)), key)
