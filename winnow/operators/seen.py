"""What was delivered before, and what this run settles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .trim import with_link


def seen_cutoff(as_of, retention_days: int):
    return F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(retention_days))


def filter_new(items: DataFrame, seen: DataFrame, as_of, retention_days: int = 14) -> DataFrame:
    """Items whose link has no unexpired seen row. Repeats inside the batch all pass.

    The expiry test reaches the seen scan; several rows per link on that side are fine
    for an anti join, so the seen log needs no grouping first."""
    live = seen.where(F.col("seen_at") > seen_cutoff(as_of, retention_days)).select("link")
    return with_link(items).join(live, "link", "left_anti").select(items.columns)


def upsert_seen(seen: DataFrame, items: DataFrame, as_of, retention_days: int = 14) -> DataFrame:
    """Seen table after marking the items: expired rows gone, latest time per link."""
    live = seen.where(F.col("seen_at") > seen_cutoff(as_of, retention_days)).select("link", "seen_at")
    marked = with_link(items).select("link", F.lit(as_of).cast("timestamp").alias("seen_at"))
    return live.unionByName(marked).groupBy("link").agg(F.max("seen_at").alias("seen_at"))


def item_links(rows: DataFrame) -> DataFrame:
    """Every link a scored row stands for: its own and each merged member's."""
    own = F.array("link")
    links = F.array_union(own, F.col("links.link")) if "links" in rows.columns else own
    return (
        rows.select(F.explode(F.coalesce(links, own)).alias("link"))
        .where(F.coalesce("link", F.lit("")) != "")
    )


def settled(fetched: DataFrame, scored: DataFrame, routed: DataFrame, exclude: str = "exclude") -> DataFrame:
    """Fetched items that were delivered or deliberately excluded."""
    delivered = item_links(routed)
    excluded = item_links(scored.where(F.col("category") == exclude))
    return fetched.join(delivered.unionByName(excluded), "link", "left_semi").select(fetched.columns)
