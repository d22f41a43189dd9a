"""Daily usage over a stream of calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def daily_usage_stream(calls: DataFrame) -> DataFrame:
    """Per-day totals that equal the batch ones, however late a call comes; state holds one row
    per day and needs no watermark."""
    return (
        calls.groupBy(F.to_date("at").alias("day"))
        .agg(
            F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
            F.count("*").alias("calls"), F.sum(F.coalesce("cost_usd", F.lit(0.0))).alias("_cost"),
            F.bool_or(F.col("cost_usd").isNull()).alias("cost_is_partial"),
            F.sort_array(F.collect_set(F.concat_ws("/", "provider", "model"))).alias("models"),
        )
        .select(
            "day", "input_tokens", "output_tokens",
            (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"), "calls",
            F.round("_cost", 4).alias("cost_usd"), "cost_is_partial", "models",
        )
    )


def keep_days(daily: DataFrame, path: str, checkpoint: str):
    """Write each batch's changed days; a day's newest batch holds its totals."""

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch_no={batch_id}")

    return (
        daily.writeStream.outputMode("update").foreachBatch(step)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def read_days(spark, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    fields = [c for c in rows.columns if c not in ("batch", "batch_no")]
    return rows.groupBy(F.col("day").alias("_d")).agg(F.max_by(F.struct(*fields), F.col("batch")).alias("r")).select("r.*")
