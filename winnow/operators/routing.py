"""Which item reaches which digest, and what reaches none.

A digest accepts an item on three tests: its sections hold the category, its sources hold
the feed (or it takes any feed), its domain equals the item's (or it has none). Instead of
a theta join, each digest is spelled out as equi-join keys and each item asks for the four
combinations of {this feed, any feed} x {this domain, any domain}; a pair of item and
digest meets under exactly one of them, so no pair repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import blank_to_null, fold, slug, strip
from ..session import broadcast_if_small
from .readers import normalise_users

ANY = "any"
EMPTY = "cast(array() as array<string>)"


def _is(c: Column) -> Column:
    return F.concat(F.lit("is:"), c)


def _either(c: Column) -> Column:
    """Explode to the key naming this value and the key of 'any value'."""
    return F.explode(F.array(_is(c), F.lit(ANY)))


def _feed_keys() -> Column:
    sources = F.coalesce("sources", F.expr(EMPTY))
    return (
        F.when(F.size(sources) > 0, F.transform(F.array_distinct(F.transform(sources, strip)), _is))
        .when(F.coalesce("sources_derived", F.lit(False)), F.expr(EMPTY))
        .otherwise(F.array(F.lit(ANY)))
    )


def digest_keys(digests: DataFrame) -> DataFrame:
    """One row per digest, section and accepted feed."""
    return (
        digests.select(
            "digest_ord",
            F.col("title").alias("digest_title"),
            F.explode(F.array_distinct("sections")).alias("_section"),
            _feed_keys().alias("_feeds"),
            F.coalesce(_is(blank_to_null(F.col("domain"))), F.lit(ANY)).alias("_domain_key"),
        )
        .withColumn("_feed_key", F.explode("_feeds"))
        .drop("_feeds")
    )


def route(scored: DataFrame, digests: DataFrame) -> DataFrame:
    """Item x accepting digest, many to many."""
    keys = broadcast_if_small(
        digest_keys(digests).withColumn("digest_slug", slug(F.col("digest_title")))
    )
    asked = scored.withColumn("_feed_key", _either(F.col("source"))).withColumn("_domain_key", _either(F.col("domain")))
    return (
        asked.join(keys.withColumnRenamed("_section", "category"), ["category", "_feed_key", "_domain_key"])
        .select(*scored.columns, "digest_ord", "digest_title", "digest_slug")
    )


def only_digests(digests: DataFrame, slugs: list[str] | None) -> DataFrame:
    """Restrict a run to the digests with these slugs."""
    return digests.where(slug(F.col("title")).isin(slugs)) if slugs else digests


def unrouted(scored: DataFrame, routed: DataFrame, exclude: str = "exclude") -> DataFrame:
    """Scored items no digest took, counted by what would have routed them."""
    return (
        scored.where(F.col("category") != exclude)
        .join(routed.select("item_id"), "item_id", "left_anti")
        .groupBy("source", F.coalesce(blank_to_null(F.col("domain")), F.lit("-")).alias("domain"), "category")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "source", "domain", "category")
    )


def run_counts(scored: DataFrame, routed: DataFrame, exclude: str = "exclude") -> DataFrame:
    """Excluded items and delivered item-digest pairs."""
    return (
        scored.select((F.col("category") == exclude).cast("long").alias("x"), F.lit(0).cast("long").alias("d"))
        .unionAll(routed.select(F.lit(0).cast("long"), F.lit(1).cast("long")))
        .agg(F.sum("x").alias("excluded"), F.sum("d").alias("delivered"))
    )


def _named(feeds: DataFrame) -> DataFrame:
    return feeds.where(F.coalesce("name", F.lit("")) != "")


def uses_feed_routing(feeds: DataFrame) -> bool:
    """True once any feed says where it goes, even when it says nowhere."""
    return not _named(feeds).where(F.col("digests").isNotNull()).isEmpty()


def _declared(feeds: DataFrame) -> DataFrame:
    return _named(feeds).select(
        strip(F.col("name")).alias("feed"), F.explode("digests").alias("t")
    ).select("feed", strip(F.col("t")).alias("declared_title")).distinct()


def apply_feed_routing(digests: DataFrame, feeds: DataFrame) -> DataFrame:
    """Fill each digest's sources from the feeds that name it; explicit ones win."""
    if not uses_feed_routing(feeds):
        return digests
    named = _declared(feeds).groupBy("declared_title").agg(F.sort_array(F.collect_set("feed")).alias("_declared"))
    explicit = F.size(F.coalesce("sources", F.expr(EMPTY))) > 0
    return (
        digests.withColumn("_explicit", explicit)
        .join(named, strip(F.col("title")) == F.col("declared_title"), "left")
        .withColumn("sources", F.when(F.col("_explicit"), F.col("sources")).otherwise(F.coalesce("_declared", F.expr(EMPTY))))
        .withColumn("sources_derived", F.coalesce("sources_derived", F.lit(False)) | ~F.col("_explicit"))
        .select(digests.columns)
    )


def routing_grid(feeds: DataFrame, digests: DataFrame, categories: list[str],
                 domains: list[str] | None = None, exclude: str = "exclude") -> DataFrame:
    """(feed, col, digests): who takes each feed per column.

    The columns are the domains where there are any, otherwise the categories."""
    columns = sorted(set(domains)) if domains else [c for c in sorted(set(categories)) if c != exclude]
    keys = digest_keys(digests)
    if domains:
        keys = keys.drop("_section").distinct()
        on = ["_feed_key", "_domain_key"]
    else:
        # without domains an item has none, so a digest that wants one takes nothing
        keys = keys.where(F.col("_domain_key") == ANY).withColumnRenamed("_section", "col").drop("_domain_key")
        on = ["_feed_key", "col"]
    cells = _named(feeds).select(
        "feed_id", F.col("name").alias("feed"), F.explode(F.array(*[F.lit(c) for c in columns])).alias("col")
    )
    asked = cells.withColumn("_feed_key", _either(F.col("feed")))
    if domains:
        asked = asked.withColumn("_domain_key", _either(F.col("col")))
    hits = asked.join(broadcast_if_small(keys), on, "left")
    titles = F.sort_array(F.collect_set("digest_title")) if domains else F.transform(
        F.sort_array(F.collect_list(F.when(F.col("digest_ord").isNotNull(), F.struct("digest_ord", "digest_title")))),
        lambda s: s["digest_title"],
    )
    return hits.groupBy("feed_id", "feed", "col").agg(titles.alias("digests"))


def routing_matrix(feeds, digests, categories, domains=None, exclude="exclude"):
    """The grid, its cells that reach no digest, and the feeds that reach none at all."""
    grid = routing_grid(feeds, digests, categories, domains, exclude)
    unroutable = grid.where(F.size("digests") == 0).select("feed", "col")
    orphans = grid.groupBy("feed_id", "feed").agg(F.max(F.size("digests")).alias("n")).where("n = 0").select("feed")
    return grid.orderBy(F.lower("feed"), "col"), unroutable, orphans


def _reached(named: DataFrame, digests: DataFrame, *about: str) -> DataFrame:
    """Digests that accept the `name` of each row, in their order."""
    keys = digests.select(
        "digest_ord", F.col("title").alias("digest_title"), F.explode(_feed_keys()).alias("_feed_key")
    )
    hit = F.when(F.col("digest_ord").isNotNull(), F.struct("digest_ord", "digest_title"))
    return (
        named.withColumn("_feed_key", _either(F.col("name")))
        .join(broadcast_if_small(keys), "_feed_key", "left")
        .groupBy(*about, "name")
        .agg(F.transform(F.sort_array(F.collect_list(hit)), lambda s: s["digest_title"]).alias("digests"))
    )


def reach(feeds: DataFrame, digests: DataFrame) -> DataFrame:
    """Digests that accept each feed by name, whatever the category."""
    return _reached(_named(feeds).select("feed_id", "name"), digests, "feed_id").withColumnRenamed("name", "feed")


def topic_reach(topics: DataFrame, digests: DataFrame) -> DataFrame:
    """Digests that accept the items of each topic by its name; an empty list shows a name that reaches nobody. Topics
    without a name are left out."""
    named = topics.select("topic_ord", strip(F.col("name")).alias("name")).where("name <> ''")
    return _reached(named, digests, "topic_ord").withColumnRenamed("name", "topic")


def lints(feeds: DataFrame, topics: DataFrame, users: DataFrame, digests: DataFrame) -> DataFrame:
    """Wiring faults as rows of (rule, subject, object)."""

    def rows(df: DataFrame, rule: str, subject, obj) -> DataFrame:
        return df.select(F.lit(rule).alias("rule"), F.expr(subject).alias("subject"), F.expr(obj).alias("object"))

    known = _named(feeds).select(strip(F.col("name")).alias("feed")).distinct()
    effective = apply_feed_routing(digests, feeds)
    listed = effective.select("title", F.explode("sources").alias("s")).select("title", strip(F.col("s")).alias("feed"))
    found = rows(listed.join(known, "feed", "left_anti"), "unknown_source", "title", "feed")

    restricted = F.size(F.coalesce("sources", F.expr(EMPTY))) > 0
    if not digests.isEmpty() and effective.where(~restricted).isEmpty():
        loose = known.join(listed, "feed", "left_anti")
        found = found.unionAll(rows(loose, "unrouted_source", "feed", "cast(null as string)"))

    to = strip(F.coalesce(blank_to_null(F.col("recipient")), F.lit("all")))
    addressed = topics.select("name", to.alias("recipient"), fold(to).alias("k")).where(~F.col("k").isin("all", ""))
    emails = normalise_users(users).select(fold(F.col("email")).alias("k"))
    found = found.unionAll(rows(addressed.join(emails, "k", "left_anti"), "unknown_recipient", "name", "recipient"))

    if not digests.isEmpty() and uses_feed_routing(feeds):
        declared = _declared(feeds)
        titles = digests.select(strip(F.col("title")).alias("declared_title"), restricted.alias("explicit"))
        found = (
            found
            .unionAll(rows(declared.join(titles, "declared_title", "left_anti"), "unknown_digest", "feed", "declared_title"))
            .unionAll(rows(titles.where("explicit").join(declared, "declared_title", "left_semi"),
                           "double_wired", "declared_title", "cast(null as string)"))
            .unionAll(rows(_named(feeds).where(F.col("digests").isNull()), "silent_feed", "trim(name)", "cast(null as string)"))
        )
    return found


def orphan_topics(topics: DataFrame, users: DataFrame) -> DataFrame:
    """Topics addressed to nobody on the user list."""
    to = fold(strip(F.coalesce(blank_to_null(F.col("recipient")), F.lit("all"))))
    emails = users.select(fold(strip(F.col("email"))).alias("_to"))
    return topics.withColumn("_to", to).where(F.col("_to") != "all").join(emails, "_to", "left_anti").select(topics.columns)
