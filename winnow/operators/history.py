"""What was sent, when, in which digest."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .ordinals import dense_ordinal


def history_rows(routed: DataFrame, as_of, last_id: int = 0) -> DataFrame:
    """One row per delivered item and digest, numbered on from last_id."""
    rows = routed.select(
        "digest_ord", "item_ord", "digest_title", "digest_slug", "title", "link", "source", "summary", "category"
    )
    numbered = dense_ordinal(rows, ["digest_ord", "item_ord"], "id")
    return numbered.select(
        (F.col("id") + 1 + last_id).alias("id"),
        F.lit(as_of).cast("timestamp").alias("sent_at"),
        "digest_title", "digest_slug",
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("title", "link", "source", "summary", "category")],
    )


def keep_latest(history: DataFrame, max_entries: int = 10_000) -> DataFrame:
    """The max_entries newest rows by id."""
    return history.orderBy(F.desc("id")).limit(max_entries)


def _of_digest(history: DataFrame, digest_slug: str | None) -> DataFrame:
    return history.where(F.col("digest_slug") == digest_slug) if digest_slug else history


def history_count(history: DataFrame, digest_slug: str | None = None) -> DataFrame:
    return _of_digest(history, digest_slug).agg(F.count("*").alias("total"))


def history_page(history: DataFrame, limit: int = 200, offset: int = 0,
                 digest_slug: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(newest-first page, one-row total)."""
    rows = _of_digest(history, digest_slug)
    return rows.orderBy(F.desc("id")).offset(offset).limit(limit), history_count(history, digest_slug)


def history_before(history: DataFrame, before_id: int, limit: int = 200, digest_slug: str | None = None) -> DataFrame:
    """The page below a known id: deep pages without sorting what lies above."""
    return _of_digest(history, digest_slug).where(F.col("id") < before_id).orderBy(F.desc("id")).limit(limit)


def digest_list(history: DataFrame) -> DataFrame:
    """Digests seen so far, title and slug."""
    return history.select(F.col("digest_title").alias("title"), F.col("digest_slug").alias("slug")).distinct()
