"""Where digests go."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .state import write_batch


def write_digests(rendered: DataFrame, path: str) -> None:
    """Markdown text under digest_slug=<slug>/, pages in file order.

    Ranges of (digest, page) make the tasks, so one very long digest spans several files
    and short ones share a task without sharing a file."""
    (
        rendered.repartitionByRange("digest_slug", "page")
        .sortWithinPartitions("digest_slug", "page")
        .select("digest_slug", F.col("markdown").alias("value"))
        .write.mode("overwrite").partitionBy("digest_slug").text(path)
    )


def write_block_files(blocks: DataFrame, path: str) -> None:
    """The ordered blocks of documents (digest_slug, rank, n, text) as text files under digest_slug=<slug>/, to be read in the order of
    their names. Ranges of (digest, rank, n) make the tasks, so a digest with most of the blocks spans many files."""
    order = ["digest_slug", "rank", "n"]
    blocks.repartitionByRange(*order).sortWithinPartitions(*order).select("digest_slug", F.col("text").alias("value")).write.mode(
        "overwrite").partitionBy("digest_slug").text(path)


def write_outbox(outbox: DataFrame, path: str, batch_id) -> None:
    """Messages for an outside sender, by batch."""
    write_batch(outbox, path, batch_id)


def show_digests(rendered: DataFrame) -> None:
    """Every page or block, in order."""
    pages = rendered.orderBy("digest_ord", "rank", "n").select("text") if "text" in rendered.columns else rendered.orderBy("digest_ord", "page").select("markdown")
    pages.show(rendered.count(), truncate=False)


def deliver(rendered: DataFrame, output: str, path: str | None = None) -> None:
    """Write files, or show on the console, which also stands in for an unknown output."""
    if output == "file":
        (write_block_files if "text" in rendered.columns else write_digests)(rendered, path)
    else:
        show_digests(rendered)
