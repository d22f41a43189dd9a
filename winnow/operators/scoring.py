"""Prompts out, model calls, results back onto their items."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.responses import field, is_object, unwrap_list
from ..functions.text import DELIMITERS, blank_to_null, fill_template, strip_delimiters
from ..functions.vocab import coerce
from .ordinals import dense_ordinal

NO_DESCRIPTION = "(no description)"
SUMMARY_CHARS = 300


def number_batches(items: DataFrame, batch_size: int = 8) -> DataFrame:
    """batch_id and pos: consecutive groups of batch_size in item order."""
    return (
        dense_ordinal(items, ["item_ord"], "_n", key=["item_id"])
        .withColumn("batch_id", F.floor(F.col("_n") / batch_size))
        .withColumn("pos", (F.col("_n") % batch_size).cast("int"))
        .drop("_n")
    )


def number_topics(items: DataFrame, max_items: int = 2000) -> DataFrame:
    """topic_idx: 0-based position inside each source, in item order; chunk and item_idx: the
    prompt that shows the item and its position there.

    max_items is the size of one prompt only. A larger topic becomes several calls, and
    `clusters.merge_calls` finds the stories that a cut has separated."""
    return (
        dense_ordinal(items, ["item_ord"], "topic_idx", ["source"], key=["item_id"])
        .withColumn("chunk", F.floor(F.col("topic_idx") / max_items))
        .withColumn("item_idx", (F.col("topic_idx") % max_items).cast("int"))
    )


def topic_lines() -> Column:
    """TOPIC lines of an item found by a topic search; '' for any other."""
    context = F.coalesce("topic_context", F.lit(""))
    topic = strip_delimiters(F.col("source"))
    told = strip_delimiters(context)
    lines = F.concat(
        F.lit("TOPIC: "), topic, F.lit("\n"),
        F.when(told != "", F.concat(F.lit("TOPIC CONTEXT: "), told, F.lit("\n"))).otherwise(""),
    )
    return F.when((context != "") & (topic != ""), lines).otherwise("")


def _credited() -> Column:
    return strip_delimiters(F.coalesce(blank_to_null(F.col("publisher")), F.col("source")))


def _described() -> Column:
    return F.coalesce(blank_to_null(strip_delimiters(F.col("description"))), F.lit(NO_DESCRIPTION))


def item_text(first_line: Column) -> Column:
    """An item as it stands in a prompt."""
    return F.concat(first_line, F.lit("\n"), item_body())


def item_body() -> Column:
    """An item below its first line; untrusted text between the two markers."""
    return F.concat(
        topic_lines(),
        F.lit("TITLE: "), strip_delimiters(F.col("title")), F.lit("\n"),
        F.lit("SOURCE: "), _credited(), F.lit("\n"),
        F.lit("DESCRIPTION:\n" + DELIMITERS[0] + "\n"), _described(), F.lit("\n" + DELIMITERS[1] + "\n"),
    )


def _joined(order: str) -> Column:
    rows = F.sort_array(F.collect_list(F.struct(order, "_text")))
    return F.array_join(F.transform(rows, lambda r: r["_text"]), "\n")


def batch_prompts(batched: DataFrame, template: str = "{items}") -> DataFrame:
    """One prompt per batch of numbered items."""
    label = F.concat(F.lit("Item "), (F.col("pos") + 1).cast("string"), F.lit(":"))
    return (
        batched.select("batch_id", "pos", item_text(label).alias("_text"))
        .groupBy("batch_id")
        .agg(_joined("pos").alias("_items"), F.count("*").alias("n_items"))
        .select("batch_id", "n_items", fill_template(template, items=F.col("_items")).alias("prompt"))
    )


def topic_prompts(numbered: DataFrame, template: str = "{items}") -> DataFrame:
    """One prompt per topic; its labels are the indexes the model answers with."""
    label = F.concat(F.lit("INDEX: "), F.col("item_idx").cast("string"))
    return (
        numbered.select("source", "chunk", "item_idx", item_text(label).alias("_text"))
        .groupBy("source", "chunk")
        .agg(_joined("item_idx").alias("_items"), F.count("*").alias("n_items"))
        .select("source", "chunk", "n_items", fill_template(template, items=F.col("_items")).alias("prompt"))
    )


# Blocks of one side that meet in one task: a task makes at most the square of it in prompts.
_TILE = 8


def paired_prompts(paired: DataFrame, bodies: DataFrame, template: str = "{items}") -> DataFrame:
    """`topic_prompts` of the rows of `clusters.paired_calls`, from (item_id, body).

    Texts are gathered once by block, and the blocks of two parts meet in tiles where their prompts are made. So a text
    is shuffled as often as its part has tiles across, which is mostly once, and not for every prompt that shows it."""
    block, fixed = ["source", "part", "block"], ["across", "half", "most"]
    texts = (
        paired.where("other = 0").select(*block, *fixed, "place", "item_id").join(bodies, "item_id")
        .groupBy(*block, *fixed).agg(F.sort_array(F.collect_list(F.struct("place", "body"))).alias("_texts"))
    )
    # blocks of the other part, from narrow rows
    others = paired.groupBy(*block).agg(F.max("other").alias("_last"))
    tiles = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("_last") / _TILE)))
    dealt = texts.join(others, block).withColumn("_tile", tiles)
    own, pair = F.floor(F.col("block") / _TILE), F.floor(F.col("part") / 2)
    left = dealt.where("part % 2 = 0").select("source", pair.alias("_pair"), own.alias("_l"), F.col("_tile").alias("_r"), "most", "half", F.col("block").alias("_left"), "_texts")
    right = dealt.where("part % 2 = 1").select(
        "source", pair.alias("_pair"), F.col("_tile").alias("_l"), own.alias("_r"), "across", F.col("block").alias("_right"), F.col("_texts").alias("_more"))
    before = F.least(F.col("half"), F.col("across") - F.col("_left") * F.col("half"))

    def shown(rows: str, start: Column) -> Column:
        return F.transform(rows, lambda r: F.concat(F.lit("INDEX: "), (start + r["place"]).cast("string"), F.lit("\n"), r["body"]))

    items = F.array_join(F.concat(shown("_texts", F.lit(0)), shown("_more", before)), "\n")
    return left.join(right, ["source", "_pair", "_l", "_r"]).select(
        "source", ((F.col("_pair") * F.col("most") + F.col("_left")) * F.col("most") + F.col("_right")).alias("chunk"),
        fill_template(template, items=items).alias("prompt"))


def item_prompts(items: DataFrame, template: str) -> DataFrame:
    """One prompt per item, for batches whose call failed."""
    return items.select("item_id", fill_template(
        template, title=strip_delimiters(F.col("title")), source=_credited(),
        description=_described(), topic=topic_lines(),
    ).alias("prompt"))


def score(prompts: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
          schema: str, calls_at_once: int | None = None) -> DataFrame:
    """Run the model function over the prompts, partition by partition."""
    spread = prompts.repartition(calls_at_once) if calls_at_once else prompts
    return spread.mapInPandas(fn, schema)


def caller(make_client: Callable[[], Callable[[str], tuple[str, str | None]]]):
    """A function for `score`: one client per task, one call per prompt.

    The client returns (response, usage JSON). A call that raises leaves both NULL, which
    the joins below turn into fallbacks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()

        def call(prompt):
            try:
                return client(prompt)
            except Exception:  # noqa: BLE001 - any provider failure means no response
                return None, None

        for frame in frames:
            answers = [call(p) for p in frame["prompt"]]
            yield frame.drop(columns=["prompt"]).assign(
                response=pd.Series([a[0] for a in answers], dtype="object", index=frame.index),
                usage_json=pd.Series([a[1] for a in answers], dtype="object", index=frame.index),
            )

    return run


def _labelled(items: DataFrame, found: Column, vocab, fallback, domains, fallback_domain) -> DataFrame:
    """summary, category and domain from the element `found`, or the fallbacks."""
    summary = blank_to_null(field(found, "summary"))
    return (
        items.withColumn("_found", found)
        .withColumn("summary", summary)
        .withColumn("category", F.when(F.col("summary").isNotNull(), coerce(field(F.col("_found"), "category"), vocab, fallback)).otherwise(fallback))
        .withColumn("domain", coerce(F.when(F.col("summary").isNotNull(), field(F.col("_found"), "domain")), domains or [], fallback_domain))
        .withColumn("summary", F.coalesce("summary", F.substring(F.coalesce("description", F.lit("")), 1, SUMMARY_CHARS)))
        .drop("_found")
    )


def attach_results(batched: DataFrame, responses: DataFrame, vocab: list[str], fallback: str,
                   domains: list[str] | None = None, fallback_domain: str | None = None) -> DataFrame:
    """Result i of a batch goes to item i; anything missing or malformed falls back."""
    lists = responses.select("batch_id", unwrap_list(F.col("response"), "items").alias("_results"))
    joined = batched.join(lists, "batch_id", "left")
    return _labelled(joined, F.get("_results", F.col("pos")), vocab, fallback, domains, fallback_domain).drop("_results")


def attach_single(items: DataFrame, responses: DataFrame, vocab: list[str], fallback: str,
                  domains: list[str] | None = None, fallback_domain: str | None = None) -> DataFrame:
    """One response object per item_id."""
    docs = responses.select("item_id", F.try_parse_json("response").alias("_doc"))
    return _labelled(items.join(docs, "item_id", "left"), F.col("_doc"), vocab, fallback, domains, fallback_domain).drop("_doc")


def response_audit(batched: DataFrame, responses: DataFrame, vocab: list[str]) -> DataFrame:
    """Per batch: what the fallbacks had to repair."""
    sizes = batched.groupBy("batch_id").agg(F.count("*").alias("n_items"))
    results = F.col("_results")
    usable = F.filter(results, lambda e: is_object(e) & (F.coalesce(field(e, "summary"), F.lit("")) != ""))
    unknown = F.filter(usable, lambda e: ~F.coalesce(field(e, "category").isin(vocab), F.lit(False)))
    return (
        sizes.join(responses.select("batch_id", unwrap_list(F.col("response"), "items").alias("_results")), "batch_id", "left")
        .withColumn("_results", F.slice(results, F.lit(1), F.col("n_items").cast("int")))
        .select(
            "batch_id", "n_items",
            results.isNull().alias("unparseable"),
            (F.col("n_items") - F.coalesce(F.size(usable), F.lit(0))).alias("n_missing"),
            F.coalesce(F.size(unknown), F.lit(0)).cast("bigint").alias("n_unknown_category"),
        )
    )
