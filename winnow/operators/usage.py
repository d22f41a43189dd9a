"""Token usage: what each call cost, and what each day cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import broadcast_if_small


def extract_usage(responses: DataFrame, column: str = "usage_json") -> DataFrame:
    """input_tokens and output_tokens from either naming; calls without any are left out."""
    def field(name):
        return F.get_json_object(column, "$." + name).try_cast("bigint")

    native = F.struct(field("input_tokens").alias("i"), field("output_tokens").alias("o"))
    compat = F.struct(field("prompt_tokens").alias("i"), field("completion_tokens").alias("o"))
    has_native = field("input_tokens").isNotNull() | field("output_tokens").isNotNull()
    picked = responses.withColumn("_u", F.when(has_native, native).otherwise(compat))
    return (
        picked.where(F.col("_u.i").isNotNull() | F.col("_u.o").isNotNull())
        .withColumn("input_tokens", F.coalesce("_u.i", F.lit(0)).cast("bigint"))
        .withColumn("output_tokens", F.coalesce("_u.o", F.lit(0)).cast("bigint"))
        .drop("_u", column)
    )


def price_models(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Price per distinct (provider, model): the exact id, else the longest listed id the
    model is a dated release of."""
    models = usage.select("provider", "model").distinct()
    listed = prices.select("provider", "id", "input_usd_per_mtok", "output_usd_per_mtok")
    suffix = F.expr("substr(model, length(id) + 1)")
    applies = F.col("model").startswith(F.col("id")) & ((suffix == "") | suffix.rlike("^-[0-9]"))
    return (
        models.join(broadcast_if_small(listed), "provider")
        .where(applies)
        .groupBy("provider", "model")
        .agg(F.max_by(F.struct("input_usd_per_mtok", "output_usd_per_mtok"), F.length("id")).alias("_p"))
        .select("provider", "model", F.col("_p.input_usd_per_mtok").alias("_in"), F.col("_p.output_usd_per_mtok").alias("_out"))
    )


def estimate_cost(usage: DataFrame, prices: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """cost_usd per call, NULL for a model without a listed price.

    A stream of calls names its models in `models`, since it cannot list them itself."""
    priced = price_models(usage if models is None else models, prices)
    cost = F.round(F.col("input_tokens") / 1_000_000 * F.col("_in") + F.col("output_tokens") / 1_000_000 * F.col("_out"), 6)
    kept = [c for c in usage.columns if c != "cost_usd"]
    return usage.join(broadcast_if_small(priced), ["provider", "model"], "left").select(*kept, cost.alias("cost_usd"))


def usage_rows(responses: DataFrame, prices: DataFrame, as_of) -> DataFrame:
    """Usage table rows for a run's calls: (provider, model, kind, usage_json) in."""
    at = F.lit(as_of).cast("timestamp")
    counted = extract_usage(responses).withColumn("at", at).withColumn("day", F.to_date(at))
    return estimate_cost(counted, prices).select(
        "at", "day", "provider", "model", "kind", "input_tokens", "output_tokens", "cost_usd"
    )


def _totals():
    return [
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"),
        F.count("*").alias("calls"),
        F.round(F.sum(F.coalesce("cost_usd", F.lit(0.0))), 4).alias("cost_usd"),
        F.bool_or(F.col("cost_usd").isNull()).alias("cost_is_partial"),
        F.sort_array(F.collect_set(F.concat_ws("/", "provider", "model"))).alias("models"),
    ]


def daily_usage(usage: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Per-day totals of the last `days` days, newest first."""
    since = F.date_sub(F.to_date(F.lit(as_of).cast("timestamp")), days - 1)
    return usage.where(F.col("day") >= since).groupBy("day").agg(*_totals()).orderBy(F.desc("day"))


def usage_totals(daily: DataFrame) -> DataFrame:
    """The daily rows plus one total row, whose day is NULL."""
    return (
        daily.rollup("day")
        .agg(
            F.sum("calls").alias("calls"),
            F.sum("input_tokens").alias("input_tokens"),
            F.sum("output_tokens").alias("output_tokens"),
            F.sum("total_tokens").alias("total_tokens"),
            F.round(F.sum("cost_usd"), 4).alias("cost_usd"),
            F.bool_or("cost_is_partial").alias("cost_is_partial"),
            F.count("*").alias("n_days"),
        )
    )


def usage_cutoff(as_of, retention_days: int) -> Column:
    """The oldest day kept."""
    return F.date_sub(F.to_date(F.lit(as_of).cast("timestamp")), retention_days)


def expire_usage(usage: DataFrame, as_of, retention_days: int = 400) -> DataFrame:
    return usage.where(F.col("day") >= usage_cutoff(as_of, retention_days))
