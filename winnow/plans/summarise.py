"""From new items to labelled ones, through a model."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import vocab as V
from ..operators import clusters, scoring
from ..operators.ordinals import dense_ordinal
from ..session import freeze

SETTINGS = "categories array<string>, domains array<string>, fallback_category string, fallback_domain string"


@dataclass
class Labels:
    """Vocabulary, prompts and call sizes of one instance."""

    categories: list[str] | None = None
    domains: list[str] | None = None
    fallback_category: str | None = None
    fallback_domain: str | None = None
    batch_size: int = 8
    cluster: bool = False
    topic_items: int = 2000
    calls_at_once: int | None = None
    batch_template: str = "{items}"
    cluster_template: str = "{items}"
    item_template: str = "{topic}TITLE: {title}\nSOURCE: {source}\nDESCRIPTION:\n{description}"
    provider: str = "none"
    model: str = "none"
    calls: list[DataFrame] = field(default_factory=list)

    def vocabulary(self, spark: SparkSession):
        """(categories, fallback, domains, fallback) of this instance: one row of settings."""
        rows = [(self.categories, self.domains, self.fallback_category, self.fallback_domain)]
        row = V.with_vocabulary(spark.createDataFrame(rows, SETTINGS)).first()
        return row["categories"], row["fallback_category"], row["domains"], row["fallback_domain"]


def _ask(prompts: DataFrame, keys: str, labels: Labels, fn, kind: str) -> DataFrame:
    """Responses, written down once: a second call could answer differently."""
    made = freeze(scoring.score(
        prompts.select(*[k.split()[0] for k in keys.split(", ")], "prompt"), fn,
        f"{keys}, response string, usage_json string", labels.calls_at_once))
    labels.calls.append(made.select(
        F.lit(labels.provider).alias("provider"), F.lit(labels.model).alias("model"), F.lit(kind).alias("kind"), "usage_json"))
    return made


def by_batch(items: DataFrame, labels: Labels, fn) -> DataFrame:
    """Batches of items; items of a batch whose call failed are asked one by one."""
    batched = scoring.number_batches(items, labels.batch_size)
    answers = _ask(scoring.batch_prompts(batched, labels.batch_template), "batch_id bigint", labels, fn, "batch")
    spec = labels.vocabulary(items.sparkSession)
    failed = answers.where(F.col("response").isNull()).select("batch_id")
    done = scoring.attach_results(batched, answers, *spec)
    if not failed.isEmpty():
        again = batched.join(failed, "batch_id", "left_semi")
        single = _ask(scoring.item_prompts(again, labels.item_template), "item_id bigint", labels, fn, "item")
        done = done.join(failed, "batch_id", "left_anti").unionByName(scoring.attach_single(again, single, *spec))
    return done.drop("batch_id", "pos").withColumn("links", F.lit(None).cast("array<struct<publisher:string,link:string>>"))


def _asker(items: DataFrame, stories: DataFrame, keys: str, labels: Labels, fn):
    """Calls of the second merge. Only the texts of stories still apart go on: they are cut whenever half of them have joined
    others, so all rounds together read little more than the first."""
    bodies = freeze(items.select("item_id", scoring.item_body().alias("body")).join(stories.select("item_id"), "item_id", "left_semi"))
    size = bodies.count()

    def ask(paired: DataFrame, apart: DataFrame) -> DataFrame:
        nonlocal bodies, size
        n = apart.count()
        if 2 * n <= size:
            bodies, size = freeze(bodies.join(apart.select("item_id"), "item_id", "left_semi")), n
        return _ask(scoring.paired_prompts(paired, bodies, labels.cluster_template), keys, labels, fn, "cluster")

    return ask


def by_topic(items: DataFrame, labels: Labels, fn) -> DataFrame:
    """Calls over each topic, its items merged into stories; what no usable answer told of goes
    through batches. Topics never mix: the topic is what digests route on.

    topic_items bounds a prompt and nothing else: the stories of a topic that took several calls
    are compared across them."""
    if labels.topic_items < 2:
        raise ValueError("topic_items below 2 compares nothing")
    numbered = scoring.number_topics(items, labels.topic_items)
    keys = "source string, chunk bigint"
    answers = _ask(scoring.topic_prompts(numbered, labels.cluster_template), keys, labels, fn, "cluster")
    from ..functions.responses import unwrap_list

    # ids and places alone until stories are whole
    placed = freeze(clusters.place_items(numbered.select("item_id", "source", "chunk", "item_idx", "topic_idx"), answers))
    texts = items.drop("source")
    stories = clusters.in_several_calls(placed, answers)
    if not stories.isEmpty():
        placed = freeze(clusters.merge_calls(placed, stories, _asker(items, stories, keys, labels, fn), labels.topic_items))
    usable = unwrap_list(F.col("response"), "clusters").isNotNull()
    lost = answers.where(~F.coalesce(usable, F.lit(False))).select("source", "chunk", F.lit(True).alias("_lost"))
    marked = placed.join(lost, ["source", "chunk"], "left").join(texts, "item_id")
    alone = F.col("_lost").isNotNull() & F.col("cluster_ord").isNull()
    merged = clusters.merge_stories(marked.where(~alone).drop("_lost"), *labels.vocabulary(items.sparkSession))
    if not lost.isEmpty():
        rest = marked.where(alone).select(*items.columns, "story_ord")
        merged = merged.unionByName(by_batch(rest, labels, fn), allowMissingColumns=True)
    # stories follow their topic's first item, clusters first
    first = items.groupBy("source").agg(F.min("item_ord").alias("_topic"))
    ordered = merged.join(first, "source")
    return dense_ordinal(
        freeze(ordered.withColumnRenamed("item_ord", "_old")), ["_topic", "story_ord", "_old"], "item_ord", key=["item_id"]).drop(
        "_old", "_topic", "story_ord", "n_members")


def summarise_all(items: DataFrame, labels: Labels, fn) -> DataFrame:
    """items with summary, category, domain and links; labels.calls keeps every call."""
    labels.calls.clear()
    return freeze(by_topic(items, labels, fn) if labels.cluster else by_batch(items, labels, fn))
