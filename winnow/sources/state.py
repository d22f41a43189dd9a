"""Tables kept between runs.

Every table is a folder of batches. A batch writes only its own folder and overwrites it
when it is replayed, so a run repeated after a failure leaves no row twice."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from ..operators.history import keep_latest
from ..operators.seen import seen_cutoff
from ..operators.usage import expire_usage, usage_cutoff


def write_batch(rows: DataFrame, path: str, batch_id, partition: str | None = None) -> None:
    writer = rows.write.mode("overwrite")
    if partition:
        writer = writer.partitionBy(partition)
    writer.parquet(f"{path}/batch_id={batch_id}")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, or no rows while nothing was written."""
    return _read(spark, path, schema + ", batch_id string")


# The day of a call is the folder it lies in.
USAGE_ROWS = schemas.USAGE.replace("day date, ", "")
MANIFEST = "version bigint, gen bigint, live boolean, watermark timestamp"
# Folder of the rows that a new generation took over.
FOLDED = "folded"


class LogTable:
    """Rows appended by batch and day, rewritten by generation.

    A generation is a folder. Which one is read stands in the manifest with the highest version, a single small file that
    appears whole or not at all. A number is claimed in a manifest before anything is written under it, so a rewrite
    that died leaves a folder that nobody reads and nobody uses again. Rewritten rows keep the batch that wrote
    them; once that batch is delivered again, its new rows stand for the folded ones. One writer at a time."""

    def __init__(self, path: str, schema: str, partition: str):
        self.path, self.partition = path, partition
        self.schema = f"{schema}, {partition} date, written_by string"

    def _manifests(self, spark: SparkSession) -> tuple[int, int, int]:
        """Generation to read, highest number claimed, highest version."""
        notes = _read(spark, f"{self.path}.generations", MANIFEST)
        row = notes.agg(F.max_by(F.when(F.col("live"), F.col("gen")), F.when(F.col("live"), F.col("version"))), F.max("gen"), F.max("version")).first()
        return row[0] or 0, row[1] or 0, row[2] or 0

    def _note(self, spark: SparkSession, gen: int, live: bool, watermark=None) -> None:
        version = self._manifests(spark)[2] + 1
        row = spark.range(1, numPartitions=1).select(
            F.lit(version).cast("bigint").alias("version"), F.lit(gen).cast("bigint").alias("gen"), F.lit(live).alias("live"),
            F.lit(watermark).cast("timestamp").alias("watermark"))
        row.write.mode("append").parquet(f"{self.path}.generations")

    def _folder(self, gen: int) -> str:
        return f"{self.path}/gen={gen}"

    def rows(self, spark: SparkSession) -> DataFrame:
        """The table's rows, with the batch that wrote each as written_by."""
        gen = self._manifests(spark)[0]
        rows = read_table(spark, self._folder(gen), self.schema)
        if not gen:
            return rows.drop("batch_id")
        own = rows.where(F.col("batch_id") != FOLDED)
        again = own.select(F.col("batch_id").alias("written_by")).distinct()
        return own.unionByName(rows.where(F.col("batch_id") == FOLDED).join(again, "written_by", "left_anti")).drop("batch_id")

    def add(self, rows: DataFrame, batch_id) -> None:
        folder = self._folder(self._manifests(rows.sparkSession)[0])
        write_batch(rows.withColumn("written_by", F.lit(str(batch_id))), folder, batch_id, self.partition)

    def rewrite(self, spark: SparkSession, kept: DataFrame | None, watermark=None) -> None:
        """Go on with `kept`, rows of this table, or with none."""
        gen = self._manifests(spark)[1] + 1
        self._note(spark, gen, False)
        if kept is not None:
            write_batch(kept, self._folder(gen), FOLDED, self.partition)
        self._note(spark, gen, True, watermark)


class SeenStore(LogTable):
    """Delivered links as a log of marks, by day.

    Marking appends; nothing rewrites the table. A link marked twice has two rows, which
    an anti join does not mind. Expired days are skipped by partition pruning and dropped
    for good by `compact`."""

    def __init__(self, path: str):
        super().__init__(path, schemas.SEEN, "seen_date")

    def _live(self, spark: SparkSession, as_of, retention_days: int) -> DataFrame:
        cutoff = seen_cutoff(as_of, retention_days)
        return self.rows(spark).where((F.col("seen_date") >= F.to_date(cutoff)) & (F.col("seen_at") > cutoff))

    def read(self, spark: SparkSession, as_of, retention_days: int = 14, except_batch=None) -> DataFrame:
        """Unexpired marks; without those of `except_batch`, so that a batch delivered again is
        not judged by its own marks, compacted or not."""
        live = self._live(spark, as_of, retention_days)
        if except_batch is not None:
            live = live.where(F.col("written_by") != str(except_batch))
        return live.select("link", "seen_at")

    def mark(self, items: DataFrame, as_of, batch_id) -> None:
        """Record the items' links; call it after delivery, never before."""
        at = F.lit(as_of).cast("timestamp")
        links = items.where(F.coalesce("link", F.lit("")) != "").select("link").distinct()
        self.add(links.select("link", at.alias("seen_at"), F.to_date(at).alias("seen_date")), batch_id)

    def compact(self, spark: SparkSession, as_of, retention_days: int = 14) -> None:
        """Rewrite the live marks, one per link and batch, as the next generation."""
        live = self._live(spark, as_of, retention_days).groupBy("link", "written_by").agg(F.max("seen_at").alias("seen_at"))
        self.rewrite(spark, live.withColumn("seen_date", F.to_date("seen_at")), as_of)

    def expire(self, spark: SparkSession, as_of, retention_days: int = 14) -> bool:
        """Compact if a whole day of marks has expired."""
        cutoff = F.to_date(seen_cutoff(as_of, retention_days))
        if self.rows(spark).where(F.col("seen_date") < cutoff).isEmpty():
            return False
        self.compact(spark, as_of, retention_days)
        return True

    def clear(self, spark: SparkSession) -> None:
        """Forget everything: the next generation starts empty."""
        self.rewrite(spark, None)


class HistoryStore(LogTable):
    """Delivered items, by day, and the highest id that each batch claimed."""

    def __init__(self, path: str):
        super().__init__(path, schemas.HISTORY, "sent_date")

    def read(self, spark: SparkSession) -> DataFrame:
        return self.rows(spark).withColumnRenamed("written_by", "batch_id")

    def last_id(self, spark: SparkSession, batch_id) -> int:
        """Highest id of any other batch, from one row a batch."""
        claims = read_table(spark, f"{self.path}.ids", "last_id bigint").where(F.col("batch_id") != str(batch_id))
        return claims.agg(F.max("last_id")).first()[0] or 0

    def claim(self, spark: SparkSession, batch_id, n: int) -> int:
        """Reserve n ids for the batch, before its rows are written; returns the id before the first."""
        last = self.last_id(spark, batch_id)
        write_batch(spark.range(1, numPartitions=1).select(F.lit(last + n).cast("bigint").alias("last_id")), f"{self.path}.ids", batch_id)
        return last

    def append(self, rows: DataFrame, batch_id) -> None:
        self.add(rows.withColumn("sent_date", F.to_date("sent_at")), batch_id)

    def expire(self, spark: SparkSession, max_entries: int = 10_000) -> bool:
        """Keep the newest rows by id, if there are more."""
        if self.rows(spark).count() <= max_entries:
            return False
        self.rewrite(spark, keep_latest(self.rows(spark), max_entries))
        return True


class UsageStore(LogTable):
    """Calls of the model, by day."""

    def __init__(self, path: str):
        super().__init__(path, USAGE_ROWS, "day")

    def read(self, spark: SparkSession) -> DataFrame:
        return self.rows(spark).drop("written_by")

    def expire(self, spark: SparkSession, as_of, retention_days: int = 400) -> bool:
        """Drop days past the retention, if there are any."""
        rows = self.rows(spark)
        kept = expire_usage(rows, as_of, retention_days)
        if rows.where(~(F.col("day") >= usage_cutoff(as_of, retention_days))).isEmpty():
            return False
        self.rewrite(spark, kept, as_of)
        return True


def run_row(spark: SparkSession, status: str, items: int, as_of, previous_delivered: bool = False,
            error: str | None = None) -> DataFrame:
    return spark.range(1).select(
        F.lit(as_of).cast("timestamp").alias("at"), F.lit(status).alias("status"),
        F.lit(items).cast("bigint").alias("items_processed"), F.lit(previous_delivered).alias("previous_delivered"),
        F.lit(error).cast("string").alias("error"),
    )


def log_run(spark: SparkSession, path: str, batch_id, status: str, items: int = 0, as_of=None,
            previous_delivered: bool = False, error: str | None = None) -> None:
    """The batch's status; `running` is replaced by the outcome."""
    write_batch(run_row(spark, status, items, as_of, previous_delivered, error), path, batch_id)


def latest_run(log: DataFrame, by: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """The newest row, or an idle one while there is none; with `by`, the newest row of each log."""
    fields = ["status", "items_processed", "previous_delivered", "error"]
    newest = log.groupBy(*by or []).agg(F.max_by(F.struct("at", *fields, *order or []), F.struct("at", *order or [])).alias("r"))
    return newest.select(
        *by or [], *[F.col(f"r.{c}").alias(c) for c in order or []],
        F.coalesce("r.status", F.lit("idle")).alias("status"), F.col("r.at").alias("last_run"),
        F.coalesce("r.items_processed", F.lit(0)).cast("bigint").alias("items_processed"),
        F.coalesce("r.previous_delivered", F.lit(False)).alias("previous_delivered"), F.col("r.error").alias("error"),
    )
