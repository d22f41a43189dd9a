"""Age filter, per-feed cap and the two ways of trimming a run to a total."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

# Above this the optimizer no longer prunes ranks before the shuffle by itself.
_GROUP_LIMIT_ROWS = 1000
_SALTS = 64


def drop_stale(items: DataFrame, as_of, max_age_days: int | None) -> DataFrame:
    """Keep items at most max_age_days old; undated ones stay."""
    if not max_age_days:
        return items
    cutoff = F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(max_age_days))
    return items.where(F.col("published").isNull() | (F.col("published") >= cutoff))


def with_link(items: DataFrame) -> DataFrame:
    return items.where(F.coalesce("link", F.lit("")) != "")


def first_per_feed(items: DataFrame, order: list, n: int, rank: str = "_rank") -> DataFrame:
    """First n rows of each feed in `order`, ranked from 1.

    A feed's rows are cut to n inside each map task before they meet: up to 1000 the
    optimizer does that from the rank filter, above it a salted first stage does."""
    if n > _GROUP_LIMIT_ROWS:
        salt = F.pmod(F.xxhash64("item_id"), F.lit(_SALTS))
        by_salt = Window.partitionBy("feed_id", "_salt").orderBy(*order)
        items = (
            items.withColumn("_salt", salt)
            .withColumn(rank, F.row_number().over(by_salt))
            .where(F.col(rank) <= n)
            .drop("_salt", rank)
        )
    by_feed = Window.partitionBy("feed_id").orderBy(*order)
    return items.withColumn(rank, F.row_number().over(by_feed)).where(F.col(rank) <= n)


def cap_per_feed(items: DataFrame, n: int = 20) -> DataFrame:
    """First n entries of each feed in document order."""
    return first_per_feed(items, [F.col("entry_ord")], n).drop("_rank")


def _recency(as_of):
    # an undated item counts as just fetched
    return F.coalesce("published", F.lit(as_of).cast("timestamp"))


def fair_trim(items: DataFrame, max_total: int, as_of) -> DataFrame:
    """Round-robin over feeds, newest first in each, until max_total rows.

    No feed can place more than max_total rows, so its rank filter bounds the shuffle."""
    order = [_recency(as_of).desc(), F.col("entry_ord")]
    ranked = first_per_feed(items, order, max_total)
    return ranked.orderBy("_rank", "feed_ord").limit(max_total).drop("_rank")


def newest(items: DataFrame, max_total: int, as_of) -> DataFrame:
    """The max_total newest items over all feeds."""
    return items.orderBy(_recency(as_of).desc(), "feed_ord", "entry_ord").limit(max_total)
