"""Helpers the corpus operators share: narrow inputs, written tables, running totals, words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import written  # noqa: F401

# Rows per Arrow batch: documents run from a few bytes to megabytes.
BATCH_ROWS = 1000
# Distinct words a task remembers the hash of before it starts anew.
WORD_CACHE = 300_000
GRAM_BASE = 0x9E3779B97F4A7C15


def batch_rows(spark: SparkSession) -> None:
    """Batches of the corpus operators are bounded in rows and not, as `tune` leaves them, in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    batch_rows(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under the operator's own names, so extra columns of any name do no harm."""
    return df.select(*[df[c].alias(name) for name, c in columns.items()])


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def null_safe(left: DataFrame, right: DataFrame, keys: dict[str, str]):
    """Join condition left.key <=> right.key for every pair of names."""
    out = F.lit(True)
    for a, b in keys.items():
        out = out & left[a].eqNullSafe(right[b])
    return out


def _add_before(batches):
    total = 0
    for b in batches:
        values = b.column("_value").to_numpy(zero_copy_only=False).astype(np.int64)
        upto = np.cumsum(values) + total
        if len(upto):
            before, total = upto - values, int(upto[-1])
        else:
            before = upto
        keep = [i for i, n in enumerate(b.schema.names) if n != "_value"]
        yield pa.RecordBatch.from_arrays([b.column(i) for i in keep] + [pa.array(before), pa.array(upto)],
                                         names=[b.schema.names[i] for i in keep] + ["_before", "_upto"])


def running(df: DataFrame, order: list, value, group: list[str] | None = None, out: str = "before") -> DataFrame:
    """Add `out`: the sum of `value` (non-negative long) over all rows earlier in `order`, per `group`.

    Rows are range-sorted over many tasks, each task adds up its own part, and the parts get
    their start from one row per part. A group's start is the least total among its rows, so a
    group holding most of the rows is spread like any other data. Rows equal in all of `order`
    stand in any order."""
    group = group or []
    keys = [*[F.col(g).asc_nulls_last() for g in group], *[F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in order]]
    columns = df.columns
    placed = (
        df.withColumn("_value", value.cast("long")).repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id())
    )
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema if f.name != "_value")
    placed = written(arrow_map(placed, _add_before, kinds + ", _before long, _upto long"), "running")
    # one row per part: bounded by the number of partitions
    parts = placed.groupBy("_part").agg(F.max("_upto").alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    total = placed.join(F.broadcast(starts), "_part").withColumn(out, F.col("_before") + F.col("_start")).drop("_before", "_upto", "_start", "_part")
    if not group:
        return total.select(*columns, out)
    first = total.groupBy(*[F.col(g).alias(f"_g_{g}") for g in group]).agg(F.min(out).alias("_first"))
    joined = total.join(first, null_safe(total, first, {g: f"_g_{g}" for g in group}))
    return joined.select(*columns, (F.col(out) - F.col("_first")).cast("long").alias(out))


class WordHashes(dict):
    """64-bit hash of each word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of every k consecutive words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = words[:n].copy()
    for j in range(1, k):
        h *= np.uint64(GRAM_BASE)
        h += words[j:n + j]
    return mix64(h)


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, null as empty. bytes.split() without arguments cuts exactly at
    the white space the operators mean, 20 and 09 to 0D, and nothing else."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]
