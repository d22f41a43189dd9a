"""Landed feed documents (RSS, RDF, Atom) as items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..session import broadcast_if_small

# Largest document read, longest description kept.
MAX_BYTES = 5 * 1024 * 1024
MAX_DESCRIPTION = 1000

_ENTRY = (
    "title:string,link:string,description:string,`content:encoded`:string,pubDate:string,`dc:date`:string,"
    "guid:struct<_VALUE:string,_isPermaLink:string>,source:struct<_VALUE:string,_url:string>"
)
_TEXT = "struct<_VALUE:string,_type:string>"
# the whole document, so that an entry keeps its place
DOCUMENT = (
    f"channel struct<item:array<struct<{_ENTRY}>>>, item array<struct<{_ENTRY}>>, "
    f"entry array<struct<title:{_TEXT},link:array<struct<_href:string,_rel:string>>,summary:{_TEXT},content:{_TEXT},"
    "published:string,updated:string,source:struct<title:string>>>, _corrupt string"
)


def parse_date(c: Column) -> Column:
    """Mail-style dates with a zone name or an offset, or ISO dates; else NULL."""
    plain = F.trim(F.regexp_replace(c, r"^\s*[A-Za-z]{3,9},\s*", ""))
    formats = ["d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm z", "d MMM yyyy HH:mm Z"]
    return F.coalesce(*[F.try_to_timestamp(plain, F.lit(f)) for f in formats], plain.try_cast("timestamp"))


def _place(path: Column) -> list[Column]:
    """feed_id and doc_ord of a landed file named `<feed_id>.xml` or `<feed_id>~<n>.xml`."""
    stem = F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
    number = F.coalesce(F.regexp_extract(stem, "~([0-9]+)$", 1).try_cast("int"), F.lit(0))
    return [F.substring_index(stem, "~", 1).alias("feed_id"), number.alias("doc_ord")]


# Documents of one container are read in groups of about so many bytes as they are stored, and of so many documents: one that is
# megabytes of blanks is stored in a few bytes, and a reader holds a whole group.
_GROUP_BYTES, _GROUP_DOCUMENTS = 8 << 20, 16


def _files(spark: SparkSession, path: str) -> DataFrame:
    """Landed documents with feed_id, doc_ord, length and content: packed in containers, as land_documents writes them, or
    files with a document each, placed by their folders or their names."""
    if not spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path").isEmpty():
        return spark.read.schema("feed_id string, doc_ord int, length bigint, content binary").parquet(path)
    files = spark.read.format("binaryFile").load(path)
    if {"feed_id", "doc_ord"} <= set(files.columns):
        return files.withColumns({"feed_id": F.col("feed_id").cast("string"), "doc_ord": F.col("doc_ord").cast("int")})
    return files.select("*", *_place(F.col("path")))


def land_documents(docs: DataFrame, path: str) -> None:
    """Write (feed_id, doc_ord, body) where read_documents finds them, many documents a file: a file or folder for each
    would cost more than what is in it. Bodies end with a line end."""
    content = F.concat(F.coalesce("body", F.lit("")), F.lit("\n")).cast("binary")
    packed = docs.select(T.blank_to_null(F.col("feed_id")).alias("feed_id"), F.col("doc_ord").cast("int").alias("doc_ord"), content.alias("content"))
    packed.select("feed_id", "doc_ord", F.length("content").cast("bigint").alias("length"), "content").write.options(**{
        "compression": "zstd", "parquet.block.size": str(_GROUP_BYTES), "parquet.block.row.count.limit": str(_GROUP_DOCUMENTS),
        "parquet.page.size.row.check.min": "1", "parquet.page.size.check.estimate": "false",
        "parquet.enable.dictionary#content": "false"}).parquet(path)


def read_documents(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(feed_id, doc_ord, body) of landed documents.

    Oversized ones are left out by the scan itself; `skipped_documents` names them."""
    latin = F.lower(F.substring(F.col("content").cast("string"), 1, 100)).rlike("encoding=.iso-8859-1")
    body = F.when(latin, F.decode("content", "ISO-8859-1")).otherwise(F.make_valid_utf8(F.col("content").cast("string")))
    files = _files(spark, path).where(F.col("length") <= max_bytes)
    return files.select("feed_id", "doc_ord", body.alias("body"))


def skipped_documents(spark: SparkSession, path: str, feeds: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(feed_id, doc_ord, reason) of landed documents that give no items: oversized, of no known
    feed, or malformed. Only the last reads contents."""
    files = _files(spark, path).select("feed_id", "doc_ord", "length")
    known = feeds.where(F.coalesce("url", F.lit("")) != "").select("feed_id").distinct()
    large = F.col("length") > max_bytes
    stray = files.where(~large).join(known, "feed_id", "left_anti")
    broken = bad_documents(read_documents(spark, path, max_bytes)).join(known, "feed_id", "left_semi")
    return (
        files.where(large).select("feed_id", "doc_ord", F.lit("oversized").alias("reason"))
        .unionAll(stray.select("feed_id", "doc_ord", F.lit("unknown_feed")))
        .unionAll(broken.select("feed_id", "doc_ord", F.lit("malformed")))
    )


def _rss(entries: Column) -> Column:
    def entry(e):
        permalink = F.when(F.coalesce(e["guid"]["_isPermaLink"], F.lit("true")) != "false", e["guid"]["_VALUE"])
        return F.struct(
            e["title"].alias("title"),
            F.coalesce(T.blank_to_null(e["link"]), permalink).alias("link"),
            F.coalesce(e["description"], e["content:encoded"]).alias("description"),
            F.coalesce(T.blank_to_null(e["pubDate"]), e["dc:date"]).alias("date"),
            e["source"]["_VALUE"].alias("outlet"),
        )
    return F.transform(entries, entry)


def _atom(entries: Column) -> Column:
    def entry(e):
        links = F.filter(e["link"], lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
        return F.struct(
            e["title"]["_VALUE"].alias("title"),
            F.get(links, F.lit(0))["_href"].alias("link"),
            F.coalesce(e["summary"]["_VALUE"], e["content"]["_VALUE"]).alias("description"),
            F.coalesce(T.blank_to_null(e["published"]), e["updated"]).alias("date"),
            e["source"]["title"].alias("outlet"),
        )
    return F.transform(entries, entry)


def parse_documents(docs: DataFrame) -> DataFrame:
    """docs with `entries` (NULL or empty when there are none) and `broken`."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = docs.withColumn("_x", F.from_xml("body", DOCUMENT, options))
    entries = F.coalesce(_rss(F.col("_x.channel.item")), _rss(F.col("_x.item")), _atom(F.col("_x.entry")))
    return parsed.select(*[c for c in docs.columns if c != "body"], entries.alias("entries"),
                         F.col("_x._corrupt").isNotNull().alias("broken"))


def bad_documents(docs: DataFrame) -> DataFrame:
    """Documents with a parse error and no entries; the run goes on without them."""
    return parse_documents(docs).where(F.col("broken") & (F.coalesce(F.size("entries"), F.lit(0)) <= 0)).select("feed_id", "doc_ord")


def feed_items(docs: DataFrame, feeds: DataFrame, max_description_chars: int = MAX_DESCRIPTION) -> DataFrame:
    """Items of the documents, cleaned the way their kind of feed needs.

    item_ord packs feed (21 bits), document (22) and entry (20, more than a document of the size
    limit can hold), so it needs no numbering pass; what doesn't fit fails the run."""
    spec = feeds.select(
        "feed_id", "feed_ord", F.coalesce("name", "url").alias("source"), "topic_context",
        F.coalesce("is_search", F.lit(False)).alias("is_search"))
    raw = (
        parse_documents(docs)
        .select("feed_id", "doc_ord", F.posexplode("entries").alias("place", "e"))
        .join(broadcast_if_small(spec), "feed_id")
    )
    searched = F.col("is_search")
    text = F.coalesce("e.description", F.lit(""))
    rows = (
        raw.withColumn("link", T.clean_link(F.coalesce("e.link", F.lit(""))))
        .withColumn("publisher", T.resolve_publisher(F.col("e.outlet"), searched, F.col("link"), F.col("source")))
        .withColumn("_title", T.strip(F.coalesce("e.title", F.lit(""))))
        # only search feeds carry markup to flatten; others skip the Python decoder
        .withColumn("_plain", T.strip_html(F.when(searched, text)))
    )
    entry = F.shiftleft(F.col("doc_ord").cast("bigint"), 20) + F.col("place").cast("bigint")
    fits = (F.col("feed_ord") < 1 << 21) & (F.col("doc_ord") < 1 << 22) & (F.col("place") < 1 << 20)
    ordinal = F.when(fits, F.shiftleft(F.col("feed_ord").cast("bigint"), 42) + entry).otherwise(
        F.raise_error(F.lit("feed, document or entry number too large for item_ord")).cast("bigint"))
    return rows.select(
        ordinal.alias("item_id"), "feed_id", "feed_ord",
        entry.alias("entry_ord"),
        ordinal.alias("item_ord"), "source", "publisher",
        F.when(searched, T.strip_title_suffix(F.col("_title"), F.col("publisher"))).otherwise(F.col("_title")).alias("title"),
        "link",
        F.substring(F.when(searched, F.col("_plain")).otherwise(text), 1, max_description_chars).alias("description"),
        parse_date(F.col("e.date")).alias("published"),
        "topic_context",
    )


def read_feeds(spark: SparkSession, path: str, feeds: DataFrame, max_bytes: int = MAX_BYTES,
               max_description_chars: int = MAX_DESCRIPTION) -> tuple[DataFrame, DataFrame]:
    """(items, bad documents) of a folder of landed documents."""
    docs = read_documents(spark, path, max_bytes)
    known = feeds.where(F.coalesce("url", F.lit("")) != "")
    return feed_items(docs, known, max_description_chars), bad_documents(docs)
