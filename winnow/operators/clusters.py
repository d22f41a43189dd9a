"""Merging the items a model reported as one story."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.responses import field, integers, is_object, unwrap_list
from ..functions.text import blank_to_null
from ..functions.vocab import coerce
from ..session import freeze
from .ordinals import dense_ordinal
from .scoring import SUMMARY_CHARS

KEYS = ["source", "chunk"]
LABELS = ["cluster_ord", "c_title", "c_summary", "c_category", "c_domain"]
# story_ord of a story no cluster named: after every cluster
_LATE = 1 << 40


def claims(responses: DataFrame) -> DataFrame:
    """(source, chunk, item_idx) -> the first cluster that claimed it, with its labels."""
    clusters = responses.select(
        *KEYS, F.posexplode(unwrap_list(F.col("response"), "clusters")).alias("cluster_ord", "_c")
    ).where(is_object(F.col("_c")))
    members = clusters.select(
        *KEYS, "cluster_ord",
        field(F.col("_c"), "title").alias("c_title"),
        field(F.col("_c"), "summary").alias("c_summary"),
        field(F.col("_c"), "category").alias("c_category"),
        field(F.col("_c"), "domain").alias("c_domain"),
        F.posexplode(integers(F.col("_c"), "members")).alias("pos", "item_idx"),
    )
    # earliest (cluster, position) per item: a partial aggregate, so an index claimed by
    # very many clusters shrinks before the shuffle
    first = F.min_by(F.struct("cluster_ord", "pos", "c_title", "c_summary", "c_category", "c_domain"),
                     F.struct("cluster_ord", "pos"))
    return members.groupBy(*KEYS, "item_idx").agg(first.alias("_claim")).select(*KEYS, "item_idx", "_claim.*")


def place_items(numbered: DataFrame, responses: DataFrame) -> DataFrame:
    """Every item with its story's number inside the source and the labels it was claimed with.

    Clusters count through the answers of a topic, unclaimed items through its items, so
    neither number depends on where the topic was cut into calls."""
    sizes = responses.select(*KEYS, F.coalesce(F.size(unwrap_list(F.col("response"), "clusters")), F.lit(0)).alias("_n"))
    # one narrow row per call
    earlier = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*KEYS, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    rows = numbered.join(claims(responses).join(starts, KEYS), [*KEYS, "item_idx"], "left")
    story = F.coalesce(F.col("_start") + F.col("cluster_ord"), F.lit(_LATE) + F.col("topic_idx"))
    place = F.struct("chunk", F.coalesce("pos", F.lit(0)).alias("pos"), "item_idx")
    return rows.withColumn("story_ord", story.cast("bigint")).withColumn("_place", place).drop("_start")


def in_several_calls(placed: DataFrame, responses: DataFrame) -> DataFrame:
    """The earliest item of each story and its call, for topics that took several calls, one of them usable."""
    usable = responses.where(unwrap_list(F.col("response"), "clusters").isNotNull())
    cut = placed.groupBy("source").agg(F.max("chunk").alias("_last")).where("_last > 0").select("source")
    asked = cut.join(usable.select("source").distinct(), "source", "left_semi")
    return freeze(placed.join(asked, "source", "left_semi").groupBy("source", "story_ord").agg(
        F.min_by("item_id", "_place").alias("item_id"), F.min("topic_idx").alias("topic_idx"), F.min("chunk").alias("part")))


def paired_calls(heads: DataFrame, max_items: int) -> DataFrame:
    """(source, chunk, item_idx, item_id): prompts of at most max_items that show every story of an
    even part beside every one of the odd part after it, and for `scoring.paired_prompts` the part, its block, the
    other one's, the place in the block, the size of the other part, that of a block, and the most blocks of any part. heads: (source, topic_idx, item_id, part), the item that tells a story.

    Half a prompt is a block; a blocks on one side and b on the other take a * b calls. Stories of
    one part met before and are not compared again."""
    half = max_items // 2
    if half < 1:
        raise ValueError("a prompt of fewer than two items cannot compare any")
    numbered = dense_ordinal(heads, ["topic_idx"], "n", ["source", "part"], key=["item_id"])
    sizes = freeze(numbered.groupBy("source", "part").agg(F.count("*").alias("_across")))
    most = F.lit((sizes.agg(F.max("_across")).first()[0] - 1) // half + 1)
    across = sizes.withColumn("part", F.col("part").bitwiseXOR(F.lit(1).cast("bigint")))
    odd, own, other = F.col("part") % 2 == 1, F.floor(F.col("n") / half), F.col("_other")
    # the left block of a prompt comes first, and the last one of a part may be short
    before = F.when(odd, F.least(F.lit(half), F.col("_across") - other * half)).otherwise(0)
    left, right = F.when(odd, other).otherwise(own), F.when(odd, own).otherwise(other)
    return (
        numbered.join(across, ["source", "part"])
        .withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_across") - 1) / half))))
        .withColumn("chunk", (F.floor(F.col("part") / 2) * most + left) * most + right)
        .withColumn("item_idx", (before + F.col("n") % half).cast("int"))
        .select(*KEYS, "item_idx", "item_id", "part", own.alias("block"), other.alias("other"), (F.col("n") % half).alias("place"),
                F.col("_across").alias("across"), F.lit(half).alias("half"), most.cast("bigint").alias("most"))
    )


def _connected(links: DataFrame) -> DataFrame:
    """(u, v) to (node, label): the smallest node that links lead to. Each round joins every
    node to its smallest neighbour's smallest neighbour and goes on with what is still linked."""
    links = freeze(links.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    labels = None
    while not links.isEmpty():
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = freeze(both.groupBy("u").agg(F.least("u", F.min("v")).alias("p")))
        far = near.select(F.col("u").alias("p"), F.col("p").alias("_p"))
        parent = freeze(near.join(far, "p").select("u", F.col("_p").alias("p")))
        if labels is None:
            labels = parent.select(F.col("u").alias("node"), F.col("p").alias("label"))
        else:
            labels = freeze(labels.join(parent.select(F.col("u").alias("label"), "p"), "label", "left").select(
                "node", F.coalesce("p", "label").alias("label")))
        a, b = (parent.select(F.col("u").alias(k), F.col("p").alias(f"_{k}")) for k in ("u", "v"))
        links = freeze(links.join(a, "u").join(b, "v").where("_u != _v").select(
            F.least("_u", "_v").alias("u"), F.greatest("_u", "_v").alias("v")).distinct())
    return links.select(F.col("u").alias("node"), F.col("v").alias("label")) if labels is None else labels


def _told_together(heads: DataFrame, paired: DataFrame, responses: DataFrame) -> DataFrame | None:
    """(node, head, _told) of the stories that the answers put together: the earliest one of each
    group and the labels of its first cluster. None where the answers join nothing."""
    told = paired.withColumnRenamed("item_id", "node").join(claims(responses), [*KEYS, "item_idx"])
    groups = [*KEYS, "cluster_ord"]
    joined = freeze(told.join(told.groupBy(*groups).agg(F.min("node").alias("v"), F.count("*").alias("_k")).where("_k > 1"), groups))
    if joined.isEmpty():
        return None
    labels = _connected(joined.select(F.col("node").alias("u"), "v"))
    called = joined.join(labels, "node").groupBy("label").agg(
        F.min_by(F.struct(*LABELS), F.struct("chunk", "cluster_ord", "pos")).alias("_told"))
    first = heads.withColumnRenamed("item_id", "node").join(labels, "node").groupBy("label").agg(F.min_by("node", "topic_idx").alias("head"))
    return freeze(labels.join(first, "label").join(called, "label").select("node", "head", "_told"))


def merge_calls(placed: DataFrame, stories: DataFrame, ask, max_items: int) -> DataFrame:
    """The second merge: stories that were told in different calls of a topic become one where the
    model puts them together. `ask` turns the rows of `paired_calls` into responses, given the stories still
    apart; texts are its business.

    Parts of a topic, at first its calls, are compared two by two and then go on as one part with
    their joined stories shown once, so a round has half the parts and only stories still apart.
    A topic of s stories in c calls of m items takes about c * (s / m) squared calls, and all pairs of
    blocks only where nothing joins. A joined story has the labels of its first cluster in the last
    round that joined it. In the topics of `stories`, clusters are ordered by their first item, as one
    call over the whole would show them; a call without a usable answer joins nothing."""
    heads = stories.drop("story_ord")
    told_type = f"struct<{', '.join(f'{c}: {placed.schema[c].dataType.simpleString()}' for c in LABELS)}>"
    found = stories.select("source", "story_ord", "topic_idx", F.col("item_id").alias("head"), F.lit(None).cast(told_type).alias("_told"))
    while heads.agg(F.max("part")).first()[0]:
        paired = freeze(paired_calls(heads, max_items))
        moved = None if paired.isEmpty() else _told_together(heads, paired.select(*KEYS, "item_idx", "item_id"), ask(paired, heads))
        if moved is not None:
            new = moved.select(F.col("node").alias("head"), F.col("head").alias("_head"), F.col("_told").alias("_new"))
            found = freeze(found.join(new, "head", "left").select(
                "source", "story_ord", "topic_idx", F.coalesce("_head", "head").alias("head"), F.coalesce("_new", "_told").alias("_told")))
            heads = heads.join(moved.where("node != head").select(F.col("node").alias("item_id")), "item_id", "left_anti")
        heads = freeze(heads.withColumn("part", F.floor(F.col("part") / 2)))
    starts = found.groupBy("head").agg(F.min("topic_idx").alias("_start"))
    new = found.join(starts, "head").select("source", "story_ord", "_start", "_told")
    rows = placed.join(new, ["source", "story_ord"], "left")
    joined_up = F.col("_told").isNotNull()
    for c in LABELS:
        rows = rows.withColumn(c, F.when(joined_up, F.col(f"_told.{c}")).otherwise(F.col(c)))
    order = F.when(F.col("_start").isNotNull() & F.col("cluster_ord").isNotNull(), F.col("_start")).otherwise(F.col("story_ord"))
    return rows.withColumn("story_ord", order).drop("_start", "_told")


def assign_clusters(numbered: DataFrame, responses: DataFrame, vocab: list[str], fallback: str,
                    domains: list[str] | None = None, fallback_domain: str | None = None) -> DataFrame:
    """One row per story: claimed items merged, every unclaimed item a story of its own."""
    return merge_stories(place_items(numbered, responses), vocab, fallback, domains, fallback_domain)


def merge_stories(placed: DataFrame, vocab: list[str], fallback: str,
                  domains: list[str] | None = None, fallback_domain: str | None = None) -> DataFrame:
    """One row per (source, story_ord) of placed items."""
    item_cols = [c for c in placed.columns if c not in (*KEYS, "item_idx", "topic_idx", "story_ord", "_place", "pos", *LABELS)]
    # a link counts once per story, at its first place; the first row of all is the primary. Texts join its id
    by_link = placed.groupBy("source", "story_ord", F.coalesce("link", F.lit("")).alias("_link")).agg(
        F.min("_place").alias("_place"),
        F.min_by(F.struct("item_id", "publisher"), F.col("_place")).alias("_row"),
        F.max("published").alias("_published"),
        F.count("*").alias("_n"),
    )
    credited = F.coalesce(blank_to_null(F.col("_row.publisher")), F.col("source"))
    entry = F.struct("_place", credited.alias("publisher"), F.col("_link").alias("link"))
    merged = by_link.groupBy("source", "story_ord").agg(
        F.min_by("_row.item_id", F.col("_place")).alias("item_id"),
        F.max("_published").alias("_published"),
        F.sum("_n").alias("n_members"),
        F.sort_array(F.collect_list(F.when(F.col("_link") != "", entry))).alias("_links"),
    ).join(placed.select(*item_cols, *LABELS), "item_id")

    claimed = F.col("cluster_ord").isNotNull()
    links = F.transform("_links", lambda e: F.struct(e["publisher"].alias("publisher"), e["link"].alias("link")))
    kept = [c for c in item_cols if c not in ("title", "link", "published")]
    return merged.select(
        "source", *kept, "story_ord", "n_members",
        F.coalesce(blank_to_null(F.col("c_title")), F.col("title")).alias("title"),
        F.coalesce(F.get("_links", F.lit(0))["link"], F.col("link")).alias("link"),
        F.col("_published").alias("published"),
        F.coalesce(blank_to_null(F.col("c_summary")),
                   F.substring(F.coalesce("description", F.lit("")), 1, SUMMARY_CHARS)).alias("summary"),
        F.when(claimed, coerce(F.col("c_category"), vocab, fallback)).otherwise(fallback).alias("category"),
        coerce(F.col("c_domain"), domains or [], fallback_domain).alias("domain"),
        links.alias("links"),
    )
