"""A whole run: from landed documents to delivered digests and the state they leave."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import history, readers, render, routing, scoring, seen, similar, trim, usage
from ..sources import feeds as landed, search, sinks, state
from ..session import freeze, tune
from .meter import Meter
from .summarise import Labels, summarise_all

DIGEST_ARCHIVE = "digest_ord int, digest_title string, digest_slug string, n_blocks bigint, body_chars bigint, rendered_at timestamp"
DIGEST_BLOCKS = "digest_ord int, digest_title string, digest_slug string, rank int, n bigint, text string"


@dataclass
class Settings:
    """Configuration tables and limits of one instance.

    Topics add search feeds. Without declared digests (None) every user gets one, of the topics
    addressed to them or to everyone; declared digests leave the users out."""

    feeds: DataFrame
    digests: DataFrame | None
    state_path: str
    topics: DataFrame | None = None
    users: DataFrame | None = None
    digest_title: str = "{name}'s Digest"
    digest_sections: tuple[str, ...] = ("key", "notable", "mention")
    prices: DataFrame | None = None
    labels: Labels = field(default_factory=Labels)
    per_feed: int | None = 20  # no limit if None
    max_total: int | None = 50
    fair: bool = False
    max_age_days: int | None = None
    max_description_chars: int = landed.MAX_DESCRIPTION
    max_document_bytes: int = landed.MAX_BYTES
    content_dedupe: bool = False
    similarity: float = 0.85
    story_dedupe: bool = False
    story_containment: float = 0.6
    retention_days: int = 14
    history_entries: int = 10_000
    usage_days: int = 400
    digest_slugs: list[str] | None = None
    default_to: str | None = None
    template: str = render.HEADER
    meter: Meter = field(default_factory=Meter)


def trim_run(items: DataFrame, cfg: Settings, as_of) -> DataFrame:
    """Per-feed cap, age, total: in this order, each limit changes what the next sees."""
    given = cfg.meter.on("trim", "in", items)
    capped = given if cfg.per_feed is None else trim.cap_per_feed(given, cfg.per_feed)
    young = trim.drop_stale(capped, as_of, cfg.max_age_days)
    if cfg.max_total is not None:
        young = trim.fair_trim(young, cfg.max_total, as_of) if cfg.fair else trim.newest(young, cfg.max_total, as_of)
    cfg.meter.trimmed = young
    return young


def all_feeds(cfg: Settings) -> DataFrame:
    """Written feeds and those of the topics."""
    return cfg.feeds if cfg.topics is None else search.crawl_list(cfg.feeds, readers.clean_topics(cfg.topics))


def all_digests(cfg: Settings) -> DataFrame:
    """Declared digests, or one per reader."""
    if cfg.digests is not None:
        return cfg.digests
    if cfg.users is None or cfg.topics is None:
        raise ValueError("declare digests, or give users and topics to derive them from")
    return readers.derive_digests(cfg.users, readers.clean_topics(cfg.topics), cfg.digest_title, cfg.digest_sections)


def fetch_all(spark: SparkSession, path: str, cfg: Settings, as_of, batch_id="0") -> DataFrame:
    """Items of this run from a folder of landed feed documents. Documents that give none are
    written to the `skipped` table with their reason."""
    feeds = freeze(all_feeds(cfg))
    items, _ = landed.read_feeds(spark, path, feeds, cfg.max_document_bytes, cfg.max_description_chars)
    state.write_batch(landed.skipped_documents(spark, path, feeds, cfg.max_document_bytes), f"{cfg.state_path}/skipped", batch_id)
    return trim_run(items, cfg, as_of)


def warnings(cfg: Settings) -> list[str]:
    """Settings that work against each other."""
    found = []
    if cfg.story_dedupe and cfg.labels.cluster:
        found.append("story_dedupe drops retold stories before clustering can keep their links")
    if cfg.digests is not None and cfg.users is not None:
        found.append("users are ignored: digests are declared")
    return found


def run(spark: SparkSession, cfg: Settings, items: DataFrame, as_of, fn, batch_id="0") -> dict:
    """One run over trimmed items. State is written last, so a failure leaves it untouched
    and a replay of the batch delivers the same rows again instead of twice."""
    tune(spark)
    log = f"{cfg.state_path}/runs"
    state.log_run(spark, log, batch_id, "running", as_of=as_of)
    try:
        result = _run(spark, cfg, items, as_of, fn, batch_id)
    except Exception as e:
        state.log_run(spark, log, batch_id, "failure", as_of=as_of, error=str(e))
        return {"success": False, "error": str(e)}
    state.log_run(spark, log, batch_id, "success", result["items"], as_of, bool(result.get("previous_delivered")))
    found = warnings(cfg)
    return {"success": True, **result} | ({"warnings": found} if found else {})


def _run(spark, cfg: Settings, items, as_of, fn, batch_id) -> dict:
    path, store = cfg.state_path, state.SeenStore(f"{cfg.state_path}/seen")
    meter = cfg.meter
    if items is not meter.trimmed:
        meter.forget("trim", "in")
    fetched = freeze(meter.on("trim", "out", items))
    if fetched.isEmpty():
        return {"items": 0}
    if cfg.content_dedupe:
        fetched = similar.dedupe_content(fetched, cfg.similarity, cfg.story_dedupe, cfg.story_containment)
    fetched = meter.on("dedup", "out", fetched)
    new = freeze(meter.on("seen", "out", seen.filter_new(fetched, store.read(spark, as_of, cfg.retention_days, batch_id), as_of, cfg.retention_days)))
    digests = freeze(routing.only_digests(routing.apply_feed_routing(all_digests(cfg), cfg.feeds), cfg.digest_slugs))

    if new.isEmpty():
        return {"items": 0, "previous_delivered": deliver_previous(spark, cfg, digests, as_of, batch_id)}
    scored = summarise_all(new, cfg.labels, fn)
    if digests.isEmpty():
        return {"items": 0, "message": "No matching digests"}

    scored = freeze(meter.on("summarise", "out", scored))
    routed = freeze(meter.on("route", "out", routing.route(scored, digests)))
    n_routed = meter.rows("route", "out")
    state.write_batch(render.in_order(render.document(routed, digests, as_of, cfg.template)), f"{path}/blocks", batch_id)
    blocks = state.read_table(spark, f"{path}/blocks", DIGEST_BLOCKS).where(F.col("batch_id") == str(batch_id))
    rendered = freeze(render.sizes(blocks))
    own = rendered.withColumn("document_batch", F.lit(str(batch_id)))
    sinks.write_outbox(render.outbox(own, digests, cfg.default_to, as_of), f"{path}/outbox", batch_id)
    state.write_batch(rendered.withColumn("rendered_at", F.lit(as_of).cast("timestamp")), f"{path}/digests", batch_id)
    sent = state.HistoryStore(f"{path}/history")
    sent.append(history.history_rows(routed, as_of, sent.claim(spark, batch_id, n_routed)), batch_id)
    dropped = meter.on("unrouted", "out", routing.unrouted(scored, routed))
    state.write_batch(dropped, f"{path}/unrouted", batch_id)
    used = state.UsageStore(f"{path}/usage")
    if cfg.prices is not None and cfg.labels.calls:
        calls = cfg.labels.calls[0]
        for more in cfg.labels.calls[1:]:
            calls = calls.unionByName(more)
        used.add(usage.usage_rows(calls, cfg.prices, as_of), batch_id)
    state.write_batch(meter.stages(spark), f"{path}/stages", batch_id)
    state.write_batch(meter.table(spark), f"{path}/metrics", batch_id)
    # last: what was delivered or deliberately excluded
    store.mark(seen.settled(new, scored, routed), as_of, batch_id)
    store.expire(spark, as_of, cfg.retention_days)
    sent.expire(spark, cfg.history_entries)
    used.expire(spark, as_of, cfg.usage_days)
    return {"items": n_routed}


def deliver_previous(spark, cfg: Settings, digests: DataFrame, as_of, batch_id) -> int:
    """Nothing new: the last rendering of each digest goes out again, marked as such; the messages
    refer to the blocks of the batch that wrote them."""
    archive = state.read_table(spark, f"{cfg.state_path}/digests", DIGEST_ARCHIVE).withColumnsRenamed(
        {"digest_ord": "document_ord", "batch_id": "document_batch"})
    wanted = digests.select("digest_ord", F.col("title").alias("digest_title"))
    latest = freeze(render.latest_digests(archive).join(wanted, "digest_title"))
    box = render.outbox(latest, digests, cfg.default_to, as_of, no_new_updates=True)
    sinks.write_outbox(box, f"{cfg.state_path}/outbox", batch_id)
    return latest.select("digest_slug").distinct().count()


def run_stream(spark: SparkSession, cfg: Settings, path: str, schema: str, as_of, fn, checkpoint: str,
               files_per_batch: int = 1000):
    """The same run for every batch of newly landed item files, until none are left.

    `as_of` is a function of the batch id. Duplicates are judged against the seen store
    inside each batch, and the store is marked after delivery."""

    def step(batch: DataFrame, batch_id: int) -> None:
        at = as_of(batch_id)
        result = run(batch.sparkSession, cfg, trim_run(batch, cfg, at), at, fn, f"stream-{batch_id}")
        if not result["success"]:
            raise RuntimeError(result["error"])

    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
        .writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def health(feeds: DataFrame, topics: DataFrame, users: DataFrame, digests: DataFrame, categories: list[str],
           domains: list[str] | None = None, audit: DataFrame | None = None) -> DataFrame:
    """Everything wrong with the wiring as (rule, subject, object, n)."""
    effective = routing.apply_feed_routing(digests, feeds)
    _, unroutable, orphans = routing.routing_matrix(feeds, effective, categories, domains)
    none = F.lit(None).cast("string")
    found = (
        routing.lints(feeds, topics, users, digests)
        .unionAll(unroutable.select(F.lit("unroutable"), "feed", "col"))
        .unionAll(orphans.select(F.lit("orphan_feed"), "feed", none))
        .unionAll(routing.orphan_topics(topics, readers_of(users)).select(F.lit("orphan_topic"), "name", "recipient"))
        .withColumn("n", F.lit(1).cast("bigint"))
    )
    if audit is not None:
        repaired = audit.agg(
            F.sum(F.col("unparseable").cast("bigint")).alias("unparseable"), F.sum("n_missing").alias("missing"),
            F.sum("n_unknown_category").alias("unknown_category"))
        rows = repaired.select(F.explode(F.create_map(
            F.lit("unparseable"), "unparseable", F.lit("missing"), "missing", F.lit("unknown_category"), "unknown_category",
        )).alias("subject", "n"))
        found = found.unionAll(rows.where("n > 0").select(F.lit("response"), "subject", none, "n"))
    return found


def readers_of(users: DataFrame) -> DataFrame:
    from ..operators.readers import normalise_users

    return normalise_users(users)
