"""Three-way merge of a base table, its edited copy and the keys last deployed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def three_way_merge(base: DataFrame, override: DataFrame, stamp: DataFrame | None, key: str,
                    mode: str = "rows") -> tuple[DataFrame, DataFrame]:
    """(merged, changes).

    rows: an override row beats the base row of its key; a key only in the override is
    added, unless the stamp holds it, which means the base deleted it since.
    values: columns (key, value); an override value still equal to the stamp was never
    edited, so the base decides, deletion included."""
    cols = [c for c in base.columns if c != key]
    old = base.select(key, F.struct(*cols).alias("old"))
    new = override.where(F.col(key).isNotNull()).select(key, F.struct(*cols).alias("new"))
    both = old.join(new, key, "full")
    has_old, has_new = F.col("old").isNotNull(), F.col("new").isNotNull()
    differ = ~F.col("old").eqNullSafe(F.col("new"))

    if mode == "rows":
        if stamp is None:
            stamp = override.select(key).limit(0)
        both = both.join(stamp.select(key, F.lit(True).alias("stamped")).distinct(), key, "left")
        action = (
            F.when(has_old & has_new & differ, "updated")
            .when(~has_old & F.col("stamped"), "removed")
            .when(~has_old, "added")
            .otherwise("same")
        )
        value = F.coalesce("new", "old")
    else:
        if stamp is None:
            stamp = override.limit(0)
        both = both.join(stamp.select(key, F.struct(*cols).alias("was")), key, "left")
        untouched = F.col("was").isNotNull() & F.col("was").eqNullSafe(F.col("new"))
        # a null value equals a missing one here
        differ_value = ~F.col("old.value").eqNullSafe(F.col("new.value"))
        action = (
            F.when(~has_new, "same")
            .when(untouched & ~has_old, "removed")
            .when(untouched & differ_value, "kept")
            .when(untouched, "same")
            .when(differ_value, "set")
            .when(~has_old, "absent")
            .otherwise("same")
        )
        value = F.when(F.col("action") == "set", F.col("new")).otherwise(F.coalesce("old", "new"))

    resolved = both.withColumn("action", action).withColumn("_value", value)
    merged = resolved.where(~F.col("action").isin("removed", "absent")).select(key, "_value.*").select(base.columns)
    changes = resolved.where(~F.col("action").isin("same", "absent")).select(key, "action")
    return merged, changes
