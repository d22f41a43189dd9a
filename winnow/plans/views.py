"""The item model derived from the driver's tables, always over whole tables.

`AS_OF` stands for the moment of the run; nothing here reads the clock."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import slug

AS_OF = "2024-01-31 00:00:00"

# label pairs (quality, toxic) -> category
VOCAB = ["exclude", "key", "mention", "notable"]
FALLBACK = "mention"
DOMAINS = ["de", "en", "es", "fr"]
FALLBACK_DOMAIN = "de"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def items(spark, sf) -> DataFrame:
    """documents as items: the first sentence is the title, (source, lang) the feed."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("item_id"),
        F.concat_ws("/", "source", "lang").alias("feed_id"),
        (F.regexp_extract("source", "([0-9]+)", 1).cast("int") * 1000 + F.ascii(F.substring("lang", 2, 1))).alias("feed_ord"),
        F.col("doc_id").alias("entry_ord"),
        F.col("doc_id").alias("item_ord"),
        "source",
        F.col("source").alias("publisher"),
        F.trim(F.regexp_extract("text", r"^[^.\n|]*", 0)).alias("title"),
        F.concat(F.lit("https://www."), "source", F.lit(".example.com/a/"), F.substring(F.md5("text"), 1, 12)).alias("link"),
        F.col("text").alias("description"),
        F.when(F.col("doc_id") % 11 != 0,
               F.expr("timestamp'2024-01-30 00:00:00' - make_dt_interval(0, cast(doc_id * 37 % 720 as int))")).alias("published"),
        F.when(F.col("lang") == "en", F.concat(F.lit("About "), "source")).alias("topic_context"),
        F.col("lang").alias("lang"),
    )


def story_items(spark, sf) -> DataFrame:
    """items plus one reworded copy of each, an hour older: other first words, same rest."""
    base = items(spark, sf).select("item_id", "item_ord", "source", "title", "published")
    reworded = F.concat(
        F.lit("zeta"), F.col("item_id").cast("string"), F.lit(" omega"), F.col("item_id").cast("string"), F.lit(" "),
        F.regexp_replace("title", r"^([^ ]* ){0,3}", ""),
    )
    copy = base.select(
        (F.col("item_id") + 1_000_000_000).alias("item_id"), (F.col("item_ord") + 1_000_000_000).alias("item_ord"),
        "source", reworded.alias("title"), F.expr("published - make_dt_interval(0, 1)").alias("published"),
    )
    return base.unionAll(copy)


def web_items(spark, sf) -> DataFrame:
    """pages as items; every third address sits inside a click redirect."""
    wrapped = F.concat(F.lit("http://www.bing.com/news/apiclick.aspx?ref=x&url="), F.url_encode("url"), F.lit("&c=1"))
    return table(spark, sf, "pages").select(
        "page_id", F.when(F.col("page_id") % 3 == 0, wrapped).otherwise(F.col("url")).alias("link"), "html",
        F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"),
    )


def seen(spark, sf) -> DataFrame:
    """The links of labelled documents, delivered up to 30 days ago."""
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("item_id"))
    return (
        items(spark, sf).join(labels, "item_id", "left_semi")
        .groupBy("link")
        .agg(F.expr(f"max(timestamp'{AS_OF}' - make_dt_interval(cast(item_id % 30 as int)))").alias("seen_at"))
    )


def category(quality, toxic):
    return (
        F.when(quality.isNull(), "mention").when(toxic == 1, "exclude")
        .when(quality == 1, "key").otherwise("notable")
    )


def summarised(spark, sf) -> DataFrame:
    """items with their description as summary."""
    return items(spark, sf).withColumn("summary", F.col("description"))


def scored(spark, sf, given: DataFrame | None = None) -> DataFrame:
    """items (or those given) with the category of their label, their language as domain."""
    labels = table(spark, sf, "labels").withColumnRenamed("doc_id", "item_id")
    return (
        (summarised(spark, sf) if given is None else given).join(labels, "item_id", "left")
        .withColumn("category", category(F.col("quality"), F.col("toxic")))
        .withColumn("domain", F.col("lang"))
        .drop("quality", "toxic", "lang")
    )


# digest_ord, title, sections, sources, sources_derived, domain, to, labels
DIGEST_ROWS = [
    (0, "English Desk", ["key", "notable"], [], False, "en", ["en@example.com"], {"key": "Key Stories"}),
    (1, "French Desk", ["key", "notable"], [], False, "fr", ["fr@example.com, fr2@example.com"], None),
    (2, "German Desk", ["key", "notable"], [], False, "de", [], None),
    (3, "Everything / All", ["mention", "key"], [], False, None, ["all@example.com"], {"mention": "Also [new]"}),
    (4, "Derived Nothing", ["key", "mention"], [], True, None, ["none@example.com"], None),
    (5, "Three Sources", ["notable", "thought_leadership"], ["src1", "src2", "src3"], False, None, [], None),
]


def digests(spark, sf=None) -> DataFrame:
    return spark.createDataFrame(
        DIGEST_ROWS,
        "digest_ord int, title string, sections array<string>, sources array<string>, "
        "sources_derived boolean, domain string, to array<string>, labels map<string,string>",
    )


def plain_digests(spark, sf=None) -> DataFrame:
    """The same digests before any sources were derived."""
    return digests(spark).withColumn("sources_derived", F.lit(False))


def feeds(spark, sf) -> DataFrame:
    """One feed per (source, lang); where it goes follows from its number."""
    number = F.col("feed_ord")
    return (
        items(spark, sf).select("feed_id", "feed_ord", F.col("source").alias("name")).distinct()
        .withColumn("url", F.concat(F.lit("https://"), "name", F.lit(".example.com/rss")))
        .withColumn("is_search", F.lit(False))
        .withColumn("topic_context", F.lit(None).cast("string"))
        .withColumn("digests", F.when(number % 4 == 0, F.array(F.lit("English Desk"), F.lit("Ghost Desk")))
                    .when(number % 4 == 1, F.array(F.lit("French Desk"), F.lit("Three Sources")))
                    .when(number % 4 == 2, F.expr("cast(array() as array<string>)")))
    )


def users(spark, sf) -> DataFrame:
    """customer as readers: one nation's addresses broken, one segment listed twice."""
    key = F.col("c_custkey")
    local = F.lower(F.replace("c_name", F.lit("#"), F.lit(".")))
    email = F.concat(local, F.lit("@example.com"))
    base = table(spark, sf, "customer").select(
        key.cast("int").alias("user_ord"), F.concat(F.lit(" "), "c_name").alias("name"),
        F.when(F.col("c_nationkey") == 7, F.concat(local, F.lit(" at example"))).otherwise(email).alias("email"), "c_mktsegment",
    )
    again = base.where("c_mktsegment = 'MACHINERY'").select(
        (F.col("user_ord") + 100_000_000).alias("user_ord"), "name", F.upper("email").alias("email"), "c_mktsegment")
    return base.unionAll(again).drop("c_mktsegment")


def topics(spark, sf) -> DataFrame:
    """part as topics: most to one reader, some to all, some to an unknown address."""
    key = F.col("p_partkey")
    to = F.concat(F.lit("Customer."), F.lpad((key % 1500).cast("string"), 9, "0"), F.lit("@example.com"))
    return table(spark, sf, "part").select(
        key.cast("int").alias("topic_ord"),
        F.concat("p_name", F.lit(" "), key.cast("string")).alias("name"),
        F.array("p_name", F.concat("p_brand", F.lit(" & "), "p_type")).alias("queries"),
        F.concat(F.lit("About "), "p_type").alias("context"),
        F.when(key % 3 == 0, "sv").alias("lang"), F.when(key % 3 == 0, "SE").alias("country"),
        F.lit(None).cast("string").alias("window"),
        F.when(key % 7 == 0, F.array(F.lit("bing"))).alias("engines"),
        F.when(key % 50 == 0, "ALL").when(key % 97 == 0, "nobody@example.com").when(key % 41 == 0, "").otherwise(to).alias("recipient"),
    )


PRICE_ROWS = [
    ("alpha", "m-1", 1.0, 5.0), ("alpha", "m-1-4", 3.0, 15.0), ("beta", "n-small", 0.15, 0.6),
    ("beta", "n-small-latest", 0.5, 1.5), ("gamma", "q-9", 0.03, 0.13),
]


def prices(spark, sf=None) -> DataFrame:
    return spark.createDataFrame(PRICE_ROWS, "provider string, id string, input_usd_per_mtok double, output_usd_per_mtok double")


CALL_MODELS = [
    ("alpha", "m-1"), ("alpha", "m-1-20240101"), ("alpha", "m-1-4-20240202"), ("beta", "n-small-beta"), ("delta", "z-1"),
]


def call_models(spark) -> DataFrame:
    return spark.createDataFrame(CALL_MODELS, "provider string, model string")


def usage_calls(spark, sf) -> DataFrame:
    return calls_of(table(spark, sf, "events"))


def calls_of(events: DataFrame) -> DataFrame:
    """events as model calls: exact id, dated release, longest prefix, near miss, unlisted."""
    kind = F.element_at(F.array(F.lit("batch"), F.lit("cluster"), F.lit("item")), (F.col("event_id") % 3 + 1).cast("int"))
    by_type = lambda *v: (
        F.when(F.col("event_type") == "view", v[0]).when(F.col("event_type") == "purchase", v[1])
        .when(F.col("event_type") == "signup", v[2]).when(F.col("event_type") == "click", v[3]).otherwise(v[4]))
    return events.select(
        "event_id", F.col("ts").cast("timestamp").alias("at"), F.to_date("ts").alias("day"),
        by_type("alpha", "alpha", "alpha", "beta", "delta").alias("provider"),
        by_type("m-1", "m-1-20240101", "m-1-4-20240202", "n-small-beta", "z-1").alias("model"),
        kind.alias("kind"),
        F.floor(F.col("value") * 100).cast("bigint").alias("input_tokens"),
        F.floor(F.col("value") * 10).cast("bigint").alias("output_tokens"),
    )


def history(spark, sf) -> DataFrame:
    """orders as delivery history."""
    title = F.concat(F.lit("Digest "), "o_orderpriority")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("sent_at"),
        title.alias("digest_title"), slug(title).alias("digest_slug"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"),
        F.col("o_orderstatus").alias("source"),
    )


def run_log(spark, sf) -> DataFrame:
    """orders as runs, one log per customer."""
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("instance"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("run_id"),
        F.when(F.col("o_orderstatus") == "F", "failure").otherwise("success").alias("status"),
        F.floor("o_totalprice").cast("bigint").alias("items_processed"),
        (F.col("o_orderstatus") == "P").alias("previous_delivered"),
        F.when(F.col("o_orderstatus") == "F", "boom").alias("error"),
    )


# nations the base table lost, and those whose rows were edited or last deployed
_LOST = "s_nationkey in (3, 8, 13, 18, 23)"
_EDITED = "s_nationkey between 5 and 14"
_DEPLOYED = "s_nationkey <= 12"
_KNOWN_TO_COPY = "s_acctbal >= 500"


def merge_tables(spark, sf):
    """supplier as the base table, an edited copy and the keys last deployed."""
    s = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), "s_nationkey", "s_acctbal")
    base = s.where(f"not ({_LOST})")
    edited = s.where(_KNOWN_TO_COPY).withColumn(
        "s_acctbal", F.when(F.expr(_EDITED), F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal")))
    return base, edited, s.where(_DEPLOYED).select("name")


def setting_tables(spark, sf):
    """supplier as key/value settings: base, override and what was deployed."""
    s = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), "s_nationkey", "s_acctbal", F.floor("s_acctbal").cast("bigint").alias("v"))
    changed = lambda cond, by: F.when(F.expr(cond), F.col("v") + by).otherwise(F.col("v")).alias("value")
    base = s.where(f"not ({_LOST})").select("name", changed("s_nationkey between 10 and 20", 7))
    override = s.where(_KNOWN_TO_COPY).select("name", changed(_EDITED, 1))
    return base, override, s.where(_DEPLOYED).select("name", F.col("v").alias("value"))


def batch_of(rows: DataFrame, size: int = 8) -> DataFrame:
    """Batch and place of an item whose ids are already 0, 1, 2, ..."""
    return rows.withColumn("batch_id", F.floor(F.col("item_ord") / size)).withColumn("pos", (F.col("item_ord") % size).cast("int"))


def responses(spark, sf) -> DataFrame:
    """Recorded answers per batch with seeded defects: wrapped, bare array, one scalar
    element, last element missing and one unknown category; every 13th no JSON at all."""
    rows = batch_of(scored(spark, sf)).select("batch_id", "pos", "item_id", "title", "category", "domain")
    label = F.when((F.col("batch_id") % 4 == 3) & (F.col("pos") == 0), "gossip").otherwise(F.col("category"))
    element = F.when((F.col("batch_id") % 4 == 2) & (F.col("pos") == 1), F.lit("7")).otherwise(F.to_json(F.struct(
        F.concat(F.lit("S"), F.col("item_id").cast("string")).alias("summary"),
        label.alias("category"), F.col("domain").alias("domain"))))
    per_batch = rows.groupBy("batch_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.when(~((F.col("batch_id") % 4 == 3) & (F.col("pos") == 7)),
                                           F.struct("pos", element.alias("e"))))),
        lambda r: r["e"]), ",").alias("body"))
    return per_batch.select(
        "batch_id",
        F.when(F.col("batch_id") % 13 == 12, F.lit("sorry, no")).when(F.col("batch_id") % 4 == 1, F.concat(F.lit("["), "body", F.lit("]")))
        .otherwise(F.concat(F.lit('{"items":['), "body", F.lit("]}"))).alias("response"),
    )


def cluster_responses(spark, sf) -> DataFrame:
    """One answer per source: a pair, a single, a repeat claim, an index out of range."""
    body = ('{"clusters":[{"title":"Pair","summary":"both","category":"key","domain":"en","members":[0,2]},'
            '{"title":"","summary":"one","category":"odd","domain":"xx","members":[1]},'
            '{"title":"Late","summary":"","category":"notable","domain":"fr","members":[2,5,5]},'
            '{"title":"Out","summary":"x","category":"key","domain":"en","members":[1099511627776]},"junk"]}')
    return table(spark, sf, "documents").select("source").distinct().select(
        "source", F.lit(0).cast("bigint").alias("chunk"), F.lit(body).alias("response"))


# documents per landed feed document
DOC_SPAN = 500


def feed_documents(spark, sf) -> DataFrame:
    """documents as landed feed documents (feed_id, doc_ord, body): French ones Atom, the
    others RSS, Spanish ones as a news search would serve them."""
    def xml(c):
        for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            c = F.replace(c, F.lit(raw), F.lit(safe))
        return c

    def tag(name, c):
        return F.coalesce(F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>")), F.lit(""))

    rows = items(spark, sf).withColumn("doc_ord", F.floor(F.col("item_id") / DOC_SPAN).cast("int"))
    searched = F.col("lang") == "es"
    title = F.when(searched, F.concat("title", F.lit(" - "), F.upper("source"), F.lit(".example.com"))).otherwise(F.col("title"))
    text = F.when(searched, F.concat(F.lit("<p>"), "description", F.lit("</p>&nbsp;"))).otherwise(F.col("description"))
    outlet = F.when(F.col("item_id") % 10 == 0, F.lit("The Outlet"))
    rss = F.concat(
        F.lit("<item>"), tag("title", xml(title)), tag("link", xml(F.col("link"))), tag("description", xml(text)),
        tag("pubDate", F.concat(F.date_format("published", "EEE, d MMM yyyy HH:mm:ss"), F.lit(" GMT"))),
        tag("source", outlet), F.lit("</item>"))
    atom = F.concat(
        F.lit('<entry><link rel="self" href="https://self.example.com"/><link href="'), xml(F.col("link")), F.lit('"/>'),
        tag("title", xml(title)), tag("summary", xml(text)),
        tag("updated", F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss'Z'")), F.lit("</entry>"))
    entry = F.when(F.col("lang") == "fr", atom).otherwise(rss)
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("item_id", entry.alias("e")))), lambda r: r["e"]), "\n")
    docs = rows.groupBy("feed_id", "doc_ord", "lang").agg(body.alias("b"))
    return docs.select("feed_id", "doc_ord", F.when(
        F.col("lang") == "fr", F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), "b", F.lit("</feed>"))
    ).otherwise(F.concat(F.lit("<rss><channel>"), "b", F.lit("</channel></rss>"))).alias("body"))


def search_marked_feeds(spark, sf) -> DataFrame:
    return feeds(spark, sf).withColumn("is_search", F.col("feed_id").endswith("/es"))
