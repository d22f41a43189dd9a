"""Topics as search feeds: the crawl list an outside fetcher works off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import blank_to_null, strip
from ..operators.ordinals import dense_ordinal
from ..session import freeze

# The two search endpoints and the defaults of a topic.
GOOGLE_SEARCH = "https://news.google.com/rss/search"
BING_SEARCH = "https://www.bing.com/news/search"
DEFAULT_LANG = "en"
DEFAULT_COUNTRY = "US"
DEFAULT_WINDOW = "when:2d"
ENGINES = ("google", "bing")


def form_encode(c: Column) -> Column:
    """Query-string encoding with + for a space; ~ stays, * is encoded."""
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def search_feeds(topics: DataFrame, engines: tuple[str, ...] = ENGINES) -> DataFrame:
    """One feed per topic, query and engine, in that order, carrying the topic's context."""
    lang = F.coalesce(blank_to_null(strip(F.col("lang"))), F.lit(DEFAULT_LANG))
    country = F.coalesce(blank_to_null(strip(F.col("country"))), F.lit(DEFAULT_COUNTRY))
    window = F.coalesce(strip(F.col("window")), F.lit(DEFAULT_WINDOW))
    wanted = F.when(F.size(F.coalesce("engines", F.expr("cast(array() as array<string>)"))) > 0, F.col("engines")).otherwise(
        F.array(*[F.lit(e) for e in engines]))
    # only a missing list asks for the name itself; blank entries just go
    asked = F.when(F.size(F.coalesce("queries", F.expr("cast(array() as array<string>)"))) > 0, F.col("queries")).otherwise(F.array("name"))
    rows = (
        topics.withColumn("name", strip(F.col("name")))
        .where(F.coalesce("name", F.lit("")) != "")
        .withColumn("queries", F.filter(F.transform(asked, strip), lambda q: q != ""))
        .select(
            "topic_ord", "name", strip(F.coalesce("context", F.lit(""))).alias("topic_context"),
            lang.alias("lang"), country.alias("country"), window.alias("window"), wanted.alias("engines"),
            F.posexplode("queries").alias("query_ord", "query"),
        )
        .withColumn("engine", F.explode(F.filter(F.array(*[F.lit(e) for e in ENGINES]), lambda e: F.array_contains("engines", e))))
    )
    query = F.trim(F.concat_ws(" ", "query", "window"))
    google = F.concat(F.lit(GOOGLE_SEARCH + "?q="), form_encode(query), F.lit("&hl="), "lang", F.lit("&gl="), "country",
                      F.lit("&ceid="), "country", F.lit(":"), "lang")
    bing = F.concat(F.lit(BING_SEARCH + "?q="), form_encode(F.col("query")), F.lit("&format=RSS&setmkt="), "lang", F.lit("-"),
                    "country", F.lit("&sortbydate=1"))
    return rows.select(
        "topic_ord", "query_ord", "engine", "name",
        F.when(F.col("engine") == "google", google).otherwise(bing).alias("url"),
        "topic_context", F.lit(True).alias("is_search"),
    )


def union_feeds(written: DataFrame, generated: DataFrame) -> DataFrame:
    """Hand-written feeds, then generated ones; rows without an address go, a nameless
    feed is called by its address, and any address a topic generates is a search feed."""
    both = written.withColumn("_g", F.lit(0)).unionByName(generated.withColumn("_g", F.lit(1)), allowMissingColumns=True)
    rows = both.where(F.coalesce("url", F.lit("")) != "").withColumn("name", F.coalesce("name", "url"))
    urls = generated.select("url").distinct().withColumn("_s", F.lit(True))
    return rows.drop("is_search").join(urls, "url", "left").withColumn(
        "is_search", F.coalesce("_s", F.lit(False))).drop("_s", "_g")


def crawl_list(written: DataFrame, topics: DataFrame, engines: tuple[str, ...] = ENGINES) -> DataFrame:
    """All feeds of an instance: `written` and those its topics generate.

    A generated feed is named by topic, query and engine in its feed_id, which is also the stem
    of its landed files, and its feed_ord goes on after the written ones in that order."""
    place = F.array_position(F.array(*[F.lit(e) for e in ENGINES]), F.col("engine")).alias("engine_ord")
    generated = freeze(search_feeds(topics, engines).select("*", place))
    order = ["topic_ord", "query_ord", "engine_ord"]
    last = written.agg(F.max("feed_ord")).first()[0]  # one number
    searched = dense_ordinal(generated, order, "_place").select(
        F.concat_ws("-", F.lit("search"), "topic_ord", "query_ord", "engine").alias("feed_id"),
        (F.lit(-1 if last is None else last) + 1 + F.col("_place")).cast("int").alias("feed_ord"),
        "name", "url", "topic_context", "is_search")
    return union_feeds(written, searched)
