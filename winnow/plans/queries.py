"""Registered queries: each operator over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import schemas
from ..functions import text as T, vocab
from ..operators import clusters, history, merge, readers, render, routing, scoring, seen, similar, story, trim, usage
from ..session import freeze, scratch_path, tune
from ..sources import feeds, search, sinks, state
from ..streaming import seen as seen_stream, usage as usage_stream
from . import run as whole, summarise, views as V

AS_OF = V.AS_OF
CAP = 150


def _stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def _join(c: str, sep: str = ","):
    return F.array_join(c, sep).alias(c)


# --- trimming -----------------------------------------------------------------------

def fair_trim(spark, sf):
    return trim.fair_trim(V.items(spark, sf), CAP, AS_OF).select("item_id", "feed_id", _stamp("published"))


def feed_cap(spark, sf):
    return trim.cap_per_feed(V.items(spark, sf), 20).select("item_id", "feed_id", "title")


def newest_topk(spark, sf):
    return trim.newest(V.items(spark, sf), CAP, AS_OF).select("item_id", "feed_id", _stamp("published"))


def stale_filter(spark, sf):
    return trim.drop_stale(V.items(spark, sf), AS_OF, 14).select("item_id", _stamp("published"))


# --- dedup and seen state -------------------------------------------------------------

def seen_new(spark, sf):
    return seen.filter_new(V.items(spark, sf), V.seen(spark, sf), AS_OF).select("item_id", "link")


def seen_upsert(spark, sf):
    return seen.upsert_seen(V.seen(spark, sf), _settled(spark, sf), AS_OF).select("link", _stamp("seen_at"))


def _routed(spark, sf):
    return routing.route(V.scored(spark, sf), V.digests(spark))


def _settled(spark, sf):
    scored = V.scored(spark, sf)
    return seen.settled(V.items(spark, sf), scored, routing.route(scored, V.digests(spark)))


def settled(spark, sf):
    return _settled(spark, sf).select("item_id", "link")


def title_dedup(spark, sf):
    return similar.dedupe_content(V.items(spark, sf), 0.85).select("item_id", "title")


def title_dedup_exact(spark, sf):
    return similar.dedupe_content(V.story_items(spark, sf), 1.0, story_dedupe=True).select("item_id", "title")


def story_dedup(spark, sf):
    return story.drop_retold(V.story_items(spark, sf)).select("item_id", "source", "title")


# --- routing ----------------------------------------------------------------------------

def route(spark, sf):
    return _routed(spark, sf).select("item_id", "digest_title", "digest_slug", "category")


def unrouted(spark, sf):
    scored = V.scored(spark, sf)
    return routing.unrouted(scored, routing.route(scored, V.digests(spark)))


def run_counts(spark, sf):
    scored = V.scored(spark, sf)
    return routing.run_counts(scored, routing.route(scored, V.digests(spark)))


def route_grid(spark, sf):
    grid = routing.routing_grid(V.feeds(spark, sf), V.digests(spark), V.VOCAB)
    return grid.select("feed_id", "feed", "col", _join("digests", "|"))


def route_grid_domains(spark, sf):
    grid = routing.routing_grid(V.feeds(spark, sf), V.digests(spark), V.VOCAB, V.DOMAINS)
    return grid.select("feed_id", "feed", "col", _join("digests", "|"))


def _sourced_digests(spark):
    return V.digests(spark).where(F.size("sources") > 0)


def route_gaps(spark, sf):
    _, unroutable, orphans = routing.routing_matrix(V.feeds(spark, sf), _sourced_digests(spark), V.VOCAB)
    return unroutable.groupBy("feed", "col").agg(F.count("*").alias("n")).join(
        orphans.distinct().withColumn("orphan", F.lit(True)), "feed", "left").select(
        "feed", "col", "n", F.coalesce("orphan", F.lit(False)).alias("orphan"))


def feed_digests(spark, sf):
    return routing.apply_feed_routing(V.plain_digests(spark), V.feeds(spark, sf)).select(
        "digest_ord", "title", _join("sources"), "sources_derived")


def feed_reach(spark, sf):
    return routing.reach(V.feeds(spark, sf), V.digests(spark)).select("feed_id", "feed", _join("digests", "|"))


def topic_reach(spark, sf):
    """Topics against the declared digests and one digest for each brand, which lists its topics."""
    topics = V.topics(spark, sf)
    brand = F.element_at("queries", 2)
    branded = topics.withColumn("brand", F.regexp_extract(brand, "^(Brand#([0-9]+))", 1)).where(F.col("context").contains("M")).groupBy("brand").agg(
        F.collect_list("name").alias("sources")).select(
        (F.regexp_extract("brand", "([0-9]+)", 1).cast("int") + 100).alias("digest_ord"), F.col("brand").alias("title"), F.array(F.lit("key")).alias("sections"),
        "sources", F.lit(False).alias("sources_derived"), F.lit(None).cast("string").alias("domain"), F.array().cast("array<string>").alias("to"),
        F.lit(None).cast("map<string,string>").alias("labels"))
    return routing.topic_reach(topics, V.digests(spark).unionByName(branded)).select("topic_ord", "topic", _join("digests", "|"))


def reader_users(spark, sf):
    return readers.normalise_users(V.users(spark, sf))


def reader_digests(spark, sf):
    return readers.derive_digests(V.users(spark, sf), V.topics(spark, sf)).select(
        "digest_ord", "title", _join("sections"), _join("sources", "|"), _join("to"))


def wiring_lints(spark, sf):
    return routing.lints(V.feeds(spark, sf), V.topics(spark, sf), V.users(spark, sf), V.plain_digests(spark)).select(
        "rule", "subject", F.coalesce("object", F.lit("")).alias("object"))


def orphan_topics(spark, sf):
    return routing.orphan_topics(V.topics(spark, sf), V.users(spark, sf)).select("topic_ord", "name", "recipient")


def topic_clean(spark, sf):
    return readers.clean_topics(V.topics(spark, sf).withColumn("name", F.regexp_replace("name", " [0-9]+$", ""))).select(
        "topic_ord", "name", _join("queries", "|"))


def search_feeds(spark, sf):
    return search.search_feeds(V.topics(spark, sf)).select("topic_ord", "query_ord", "engine", "name", "url", "topic_context")


def available_digests(spark, sf):
    return history.digest_list(V.history(spark, sf))


# --- scalars ------------------------------------------------------------------------------

def clean_links(spark, sf):
    return V.web_items(spark, sf).select("page_id", T.clean_link(F.col("link")).alias("link"))


def publishers(spark, sf):
    link = T.clean_link(F.col("link"))
    named = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("  "), F.regexp_extract("title", "^[^ ]*", 0)))
    return V.web_items(spark, sf).select(
        "page_id", T.publisher_from_link(link).alias("host"), T.publisher_from_link(F.col("link")).alias("raw_host"),
        T.resolve_publisher(named, F.col("page_id") % 2 == 0, link, F.lit("The Feed")).alias("publisher"))


def title_suffixes(spark, sf):
    rows = V.items(spark, sf)
    title = F.when(F.col("item_id") % 3 == 0, F.concat("title", F.lit(" – "), F.upper("source"))).otherwise(
        F.concat("title", F.lit(" - and why it matters")))
    return rows.select("item_id", T.strip_title_suffix(title, F.col("source")).alias("title"))


def strip_html(spark, sf):
    return V.web_items(spark, sf).select("page_id", T.strip_html(F.col("html")).alias("plain"))


def truncate_text(spark, sf):
    return V.items(spark, sf).select("item_id", F.substring("description", 1, 1000).alias("description"))


def slugs(spark, sf):
    return V.items(spark, sf).select("item_id", T.slug(F.col("description")).alias("slug"))


def norm_titles(spark, sf):
    return V.items(spark, sf).select("item_id", T.normalize_title(F.col("description")).alias("norm"))


def title_tokens(spark, sf):
    words = T.significant_tokens(F.col("description"), F.col("source"))
    return V.items(spark, sf).select("item_id", F.array_join(F.sort_array(words), " ").alias("tokens"))


def safe_text(spark, sf):
    return V.web_items(spark, sf).select(
        "page_id", T.safe_text(F.col("html")).alias("safe"),
        T.safe_link(F.concat(F.lit("  "), F.when(F.col("page_id") % 4 == 0, F.replace("link", F.lit("http"), F.lit("javascript")))
                             .otherwise(F.col("link")))).alias("href"))


def delimiters(spark, sf):
    forged = F.concat("title", F.lit("<item_description>"), "description", F.lit("</item_description>"))
    return V.items(spark, sf).select("item_id", T.strip_delimiters(forged).alias("text"))


def email_check(spark, sf):
    return V.users(spark, sf).select("user_ord", "email", T.valid_email(F.col("email")).alias("ok"))


# --- model answers ----------------------------------------------------------------------

def _batched(spark, sf):
    return scoring.number_batches(V.items(spark, sf))


def prompts(spark, sf):
    return scoring.batch_prompts(_batched(spark, sf), "Sum up {items} as {\"items\": []}").select("batch_id", "n_items", "prompt")


def topic_prompts(spark, sf):
    numbered = scoring.number_topics(V.items(spark, sf), max_items=50)
    return scoring.topic_prompts(numbered).select("source", "chunk", "n_items", "prompt")


def batch_join(spark, sf):
    return scoring.attach_results(
        _batched(spark, sf), V.responses(spark, sf), V.VOCAB, V.FALLBACK, V.DOMAINS, V.FALLBACK_DOMAIN,
    ).select("item_id", "batch_id", "pos", "summary", "category", "domain")


def response_audit(spark, sf):
    return scoring.response_audit(_batched(spark, sf), V.responses(spark, sf), V.VOCAB)


def single_join(spark, sf):
    answers = V.scored(spark, sf).select("item_id", F.when(F.col("item_id") % 9 == 0, "no JSON").when(
        F.col("item_id") % 9 == 1, '["x"]').otherwise(F.to_json(F.struct(
            F.concat(F.lit("S"), F.col("item_id").cast("string")).alias("summary"), "category"))).alias("response"))
    return scoring.attach_single(V.items(spark, sf), answers, V.VOCAB[:3], V.FALLBACK).select("item_id", "summary", "category")


def cluster_stories(spark, sf):
    numbered = scoring.number_topics(V.items(spark, sf), max_items=100_000)
    return clusters.assign_clusters(
        numbered, V.cluster_responses(spark, sf), V.VOCAB, V.FALLBACK, V.DOMAINS, V.FALLBACK_DOMAIN,
    ).select("item_id", "source", "story_ord", "n_members", "title", "link", _stamp("published"), "summary",
             "category", "domain", F.array_join(F.transform("links", lambda x: F.concat(x["publisher"], F.lit("="), x["link"])), " ").alias("links"))


def _echo(prompt: str):
    """Stand-in for a model: answers each item of the prompt by its place."""
    import json

    count = prompt.count("\nTITLE: ")
    usage_json = json.dumps({"prompt_tokens": len(prompt), "completion_tokens": count})
    return json.dumps({"items": [{"summary": f"place {i}", "category": "key", "domain": "en"} for i in range(count)]}), usage_json


def model_calls(spark, sf):
    batched = _batched(spark, sf)
    made = scoring.score(scoring.batch_prompts(batched), scoring.caller(lambda: _echo),
                         "batch_id bigint, n_items bigint, response string, usage_json string")
    return usage.extract_usage(made).select("batch_id", "n_items", "input_tokens", "output_tokens")


# --- usage ----------------------------------------------------------------------------------

def _usage(spark, sf):
    return usage.estimate_cost(V.usage_calls(spark, sf), V.prices(spark))


def usage_extract(spark, sf):
    shape = F.col("event_id") % 4
    calls = V.usage_calls(spark, sf).withColumn("usage_json", F.when(shape == 0, F.to_json(F.struct("input_tokens", "output_tokens")))
        .when(shape == 1, F.to_json(F.struct(F.col("input_tokens").alias("prompt_tokens"), F.col("output_tokens").alias("completion_tokens"))))
        .when(shape == 2, F.to_json(F.struct("input_tokens"))).otherwise("{}")).drop("input_tokens", "output_tokens")
    return usage.extract_usage(calls).select("event_id", "input_tokens", "output_tokens")


def usage_cost(spark, sf):
    return _usage(spark, sf).select("event_id", "provider", "model", "cost_usd")


def _daily_text(df):
    return df.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "input_tokens", "output_tokens", "total_tokens",
                     "calls", "cost_usd", "cost_is_partial", _join("models"))


def usage_daily(spark, sf):
    return _daily_text(usage.daily_usage(_usage(spark, sf), AS_OF, 30))


def usage_rollup(spark, sf):
    totals = usage.usage_totals(usage.daily_usage(_usage(spark, sf), AS_OF, 30))
    return totals.select(F.coalesce(F.date_format("day", "yyyy-MM-dd"), F.lit("total")).alias("day"), "calls", "input_tokens",
                         "output_tokens", "total_tokens", "cost_usd", "cost_is_partial", "n_days")


# --- history and runs -------------------------------------------------------------------------

def history_page(spark, sf):
    page, _ = history.history_page(V.history(spark, sf), limit=200, offset=400, digest_slug="digest-1-urgent")
    return page.select("id", _stamp("sent_at"), "digest_title", "title")


def history_deep(spark, sf):
    return history.history_before(V.history(spark, sf), 7000, 200).select("id", "digest_slug", "title")


def history_trim(spark, sf):
    return history.keep_latest(V.history(spark, sf), 10_000).select("id", "digest_slug")


def history_counts(spark, sf):
    h = V.history(spark, sf)
    return history.history_count(h).withColumn("digest_slug", F.lit("")).unionByName(
        h.groupBy("digest_slug").agg(F.count("*").alias("total"))).select("digest_slug", "total")


def history_append(spark, sf):
    return history.history_rows(_routed(spark, sf), AS_OF, last_id=1000).select(
        "id", "digest_slug", "title", "link", "source", "summary", "category")


def run_latest(spark, sf):
    return state.latest_run(V.run_log(spark, sf), ["instance"], ["run_id"]).select(
        "instance", "run_id", "status", "items_processed", "previous_delivered", "error")


def state_retention(spark, sf):
    """Marks of three batches, 20, 10 and 0 days old: the oldest expire, the second is delivered again after that and judged without its own
    marks. History is cut to 1000 rows, usage to 14 days; a table forgotten after a rewrite that died stays empty."""
    path = scratch_path(spark, "retention")
    items, out = freeze(V.items(spark, sf).select("item_id", "link")), []
    store = state.SeenStore(f"{path}/seen")
    for batch, at in enumerate(("2024-01-11 00:00:00", "2024-01-21 00:00:00", AS_OF)):
        store.mark(items.where(F.col("item_id") % 3 == batch), at, batch)
    store.expire(spark, AS_OF)
    store.mark(items.where("item_id % 3 = 1"), "2024-01-21 00:00:00", 1)
    for name, other in (("live", None), ("without_1", 1)):
        out.append(store.read(spark, AS_OF, except_batch=other).select(F.lit(name).alias("kept"), "link").distinct())
    out.append(store.rows(spark).groupBy("written_by").agg(F.count_distinct("link").alias("n")).select(
        F.lit("marks").alias("kept"), F.concat_ws("=", "written_by", F.col("n").cast("string")).alias("link")))
    sent = state.HistoryStore(f"{path}/history")
    for batch in range(2):
        rows = V.history(spark, sf).where(F.col("id") % 2 == batch).withColumns(
            {c: F.lit("") for c in ("link", "summary", "category")} | {"sent_at": F.date_trunc("year", "sent_at")})
        sent.append(rows, batch)
    sent.expire(spark, 1000)
    out.append(sent.read(spark).select(F.lit("history"), F.col("id").cast("string")))
    used = state.UsageStore(f"{path}/usage")
    used.add(_usage(spark, sf).select("at", "day", "provider", "model", "kind", "input_tokens", "output_tokens", "cost_usd"), "0")
    used.expire(spark, AS_OF, 14)
    out.append(used.read(spark).groupBy("day").count().select(F.lit("usage"), F.concat_ws("=", F.date_format("day", "yyyy-MM-dd"), F.col("count").cast("string"))))
    gone = state.SeenStore(f"{path}/gone")
    gone.mark(items, AS_OF, 0)
    gone.compact(spark, AS_OF)
    gone.clear(spark)
    out.append(gone.rows(spark).select(F.lit("forgotten"), "link"))
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionAll(more)
    return rows


# --- merge ---------------------------------------------------------------------------------------

def merge_rows(spark, sf):
    merged, _ = merge.three_way_merge(*V.merge_tables(spark, sf), "name")
    return merged


def merge_changes(spark, sf):
    _, changes = merge.three_way_merge(*V.merge_tables(spark, sf), "name")
    return changes


def merge_values(spark, sf):
    merged, changes = merge.three_way_merge(*V.setting_tables(spark, sf), "name", mode="values")
    return merged.join(changes, "name", "full").select("name", "value", F.coalesce("action", F.lit("same")).alias("action"))


# --- documents --------------------------------------------------------------------------------------

def _document(spark, sf):
    return render.document(_routed(spark, sf), V.digests(spark), AS_OF)


def digest_blocks(spark, sf):
    """Every digest as a run writes it."""
    return render.in_order(_document(spark, sf)).select("digest_slug", "rank", "n", "text")


def render_digests(spark, sf):
    """Each digest as one string."""
    return render.render(_routed(spark, sf), V.digests(spark), AS_OF).select("digest_slug", "page", "markdown")


def outbox(spark, sf):
    digests = V.digests(spark)
    routed = routing.route(V.scored(spark, sf, render.measured(V.summarised(spark, sf))), digests)
    return render.outbox(render.document_sizes(routed, digests, AS_OF), digests, None, AS_OF).select(
        "digest_slug", F.coalesce("recipient", F.lit("")).alias("recipient"), "subject", "body_chars", F.coalesce("error", F.lit("")).alias("error"))


def digest_files(spark, sf):
    """Lines of the files that the digests were written to."""
    path = scratch_path(spark, "files")
    sinks.write_block_files(render.in_order(_document(spark, sf)), path)
    return spark.read.schema("value string, digest_slug string").text(path).groupBy("digest_slug", F.col("value").alias("line")).agg(F.count("*").alias("n"))


def previous_digests(spark, sf):
    archive = V.history(spark, sf).select("digest_slug", "digest_title", F.col("sent_at").alias("rendered_at"), "id")
    return render.latest_digests(archive).select("digest_slug", "id", _stamp("rendered_at"))


# --- the whole run -----------------------------------------------------------------------------------

def digest_run(spark, sf):
    """Items of the last 30 days, trimmed fairly, new ones only, labelled, routed, counted."""
    fresh = trim.fair_trim(trim.drop_stale(V.items(spark, sf), AS_OF, 30), CAP, AS_OF)
    new = seen.filter_new(fresh, V.seen(spark, sf), AS_OF)
    labels = V.scored(spark, sf).select("item_id", "category", "domain", "summary")
    routed = routing.route(new.join(labels, "item_id"), V.digests(spark))
    return routed.groupBy("digest_title", "category").agg(F.count("*").alias("n"))


def feed_scan(spark, sf):
    items = feeds.feed_items(V.feed_documents(spark, sf), V.search_marked_feeds(spark, sf))
    return items.select("item_id", "feed_id", "source", "publisher", "title", "link", "description", _stamp("published"))


def landed_trim(spark, sf):
    items = feeds.feed_items(V.feed_documents(spark, sf), V.search_marked_feeds(spark, sf))
    cfg = whole.Settings(None, None, "", per_feed=20, max_total=CAP, fair=True, max_age_days=21)
    return whole.trim_run(items, cfg, AS_OF).select("item_id", "feed_id", _stamp("published"))


def _labelling(prompt: str):
    """Stand-in for a model: labels each item of a batch by its place."""
    import json

    count = prompt.count("\nTITLE: ")
    found = [{"summary": f"place {i}", "category": V.VOCAB[i % 4], "domain": V.DOMAINS[i // 2 % 4]} for i in range(count)]
    return json.dumps({"items": found}), json.dumps({"input_tokens": len(prompt), "output_tokens": count})


def _settings(spark, sf, path: str, **more) -> whole.Settings:
    labels = _labels(provider="alpha", model="m-1")
    return whole.Settings(
        V.search_marked_feeds(spark, sf), V.digests(spark), path, prices=V.prices(spark), labels=labels, max_age_days=21,
        **{"per_feed": None, "max_total": None} | more)


def _whole_run(spark, sf, docs: DataFrame, **more) -> tuple[str, dict]:
    path = scratch_path(spark, "run")
    feeds.land_documents(docs, f"{path}/landed")
    cfg = _settings(spark, sf, f"{path}/state", **more)
    result = whole.run(spark, cfg, whole.fetch_all(spark, f"{path}/landed", cfg, AS_OF), AS_OF, scoring.caller(lambda: _labelling))
    if not result["success"]:
        raise RuntimeError(result["error"])
    return cfg.state_path, result


def full_run(spark, sf):
    """Landed documents through a whole run; what it leaves in history, outbox, unrouted, usage and the seen store."""
    path, _ = _whole_run(spark, sf, V.feed_documents(spark, sf))
    read = lambda name, schema: state.read_table(spark, f"{path}/{name}", schema)
    row = lambda kind, name, number, text: [F.lit(kind).alias("kind"), name.alias("name"), number.cast("bigint").alias("number"), text.alias("text")]
    none, zero = F.lit(""), F.lit(0)
    sent = state.HistoryStore(f"{path}/history").read(spark)
    box = read("outbox", "digest_slug string, recipient string, subject string, body_chars bigint, error string")
    dropped = read("unrouted", "source string, domain string, category string, n bigint")
    used = state.UsageStore(f"{path}/usage").read(spark)
    tables = [
        sent.select(*row("history", F.col("digest_slug"), F.col("id"), F.concat_ws(" ", "title", "link", "summary", "category"))),
        box.select(*row("outbox", F.col("digest_slug"), zero, F.concat_ws(" ", F.coalesce("recipient", F.lit("-")), "subject"))),
        dropped.select(*row("unrouted", F.col("source"), F.col("n"), F.concat_ws(" ", "domain", "category"))),
        used.groupBy("provider", "model").agg(F.sum("output_tokens").alias("n")).select(*row("usage", F.col("provider"), F.col("n"), F.col("model"))),
        state.SeenStore(f"{path}/seen").read(spark, AS_OF).select(*row("seen", F.col("link"), zero, none)),
        state.latest_run(read("runs", schemas.RUN_LOG)).select(*row("run", F.col("status"), F.col("items_processed"), none)),
    ]
    rows = tables[0]
    for more in tables[1:]:
        rows = rows.unionAll(more)
    return rows


def run_metrics(spark, sf):
    """Rows in and out of the stages of a run that trims fairly, as its own jobs observed them."""
    path, _ = _whole_run(spark, sf, V.feed_documents(spark, sf), per_feed=20, max_total=CAP, fair=True)
    return state.read_table(spark, f"{path}/metrics", "stage string, rows_in bigint, rows_out bigint").drop("batch_id")


def bad_feeds(spark, sf):
    """Documents of every fifth feed broken off, of others too large or under an unknown feed: what is skipped, and the items of the rest."""
    docs = V.feed_documents(spark, sf).join(V.feeds(spark, sf).select("feed_id", "feed_ord"), "feed_id")
    kind = F.col("feed_ord") % 5
    limit = 1_000_000
    docs = docs.select(
        F.when(kind == 2, F.concat(F.lit("stray-"), "feed_id")).otherwise(F.col("feed_id")).alias("feed_id"), "doc_ord",
        F.when(kind == 0, F.substring("body", 1, 10)).when(kind == 1, F.rpad("body", limit + 1, " ")).otherwise(F.col("body")).alias("body"))
    path = scratch_path(spark, "bad")
    feeds.land_documents(docs, f"{path}/landed")
    cfg = _settings(spark, sf, f"{path}/state", max_document_bytes=limit)
    items = whole.fetch_all(spark, f"{path}/landed", cfg, AS_OF)
    skipped = state.read_table(spark, f"{path}/state/skipped", "feed_id string, doc_ord int, reason string").drop("batch_id")
    return items.groupBy("feed_id").agg(F.count("*").alias("n")).select(
        "feed_id", F.lit(-1).alias("doc_ord"), F.concat(F.lit("items "), F.col("n").cast("string")).alias("reason")).unionByName(skipped)


def _labels(**more):
    return summarise.Labels(categories=V.VOCAB, domains=V.DOMAINS, fallback_category=V.FALLBACK, **more)


def summarise_batches(spark, sf):
    """Every item labelled through the stand-in model."""
    done = summarise.summarise_all(V.items(spark, sf), _labels(), scoring.caller(lambda: _echo))
    return done.select("item_id", "summary", "category", "domain")


def vocabularies(spark, sf):
    """Labels of twenty instances: their parts' brands, domains from the types, some choices their own."""
    part, key = V.table(spark, sf, "part"), F.col("p_partkey")
    settings = part.groupBy((key % 20).alias("instance")).agg(
        F.collect_list(F.when(key % 20 != 0, F.when(key % 7 == 0, F.lit(" ")).when((key % 20 < 4) & (key % 11 == 0), F.lit("other")).otherwise(
            F.concat(F.lit(" "), "p_brand")))).alias("categories"),
        F.collect_list(F.when(key % 20 < 15, F.element_at(F.split("p_type", " "), 1))).alias("domains"),
    ).withColumns({
        "fallback_category": F.when(F.col("instance") % 5 == 0, F.lit("chosen")),
        "fallback_domain": F.when(F.col("instance") % 3 == 0, F.lit("PROMO")).when(F.col("instance") % 3 == 1, F.lit("nowhere")),
    })
    return vocab.with_vocabulary(settings).select("instance", _join("categories"), "fallback_category", _join("domains"), "fallback_domain")


def summarise_topics(spark, sf):
    """Topics of a stand-in model that answers with no clusters: batches take over."""
    few = _labels(cluster=True, topic_items=200)
    done = summarise.summarise_all(V.items(spark, sf), few, scoring.caller(lambda: _echo))
    return done.groupBy("source", "category", "summary").agg(F.count("*").alias("n"))


def _by_letter(prompt: str):
    """Stand-in for a model that tells stories: titles of one first letter, where it sees several."""
    import json
    import re

    groups: dict[str, list[int]] = {}
    for index, letter in re.findall(r"^INDEX: (\d+)\n(?:TOPIC: .*\n(?:TOPIC CONTEXT: .*\n)?)?TITLE: (.?)", prompt, re.M):
        groups.setdefault(letter, []).append(int(index))
    told = [{"title": f"All of {c}", "summary": f"about {c}", "category": "key", "domain": "en", "members": at} for c, at in groups.items() if len(at) > 1]
    return json.dumps({"clusters": told}), None


def topic_stories(spark, sf):
    """Stories of topics that take many calls, merged across them."""
    small = _labels(cluster=True, topic_items=20)
    done = summarise.summarise_all(V.items(spark, sf), small, scoring.caller(lambda: _by_letter))
    return done.select("item_ord", "item_id", "source", "title", "summary", "category", _stamp("published"), F.size("links").alias("n_links"))


def stream_daily(spark, sf):
    """Daily usage from a stream over events."""
    schema = V.table(spark, sf, "events").schema
    live = spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet")
    calls = usage.estimate_cost(V.calls_of(live), V.prices(spark), models=V.call_models(spark))
    out = scratch_path(spark, "daily")
    usage_stream.keep_days(usage_stream.daily_usage_stream(calls), f"{out}/days", f"{out}/progress").awaitTermination()
    return _daily_text(usage_stream.read_days(spark, f"{out}/days"))


def stream_seen(spark, sf):
    """documents arriving in four drops; a link delivered in one is not new in the next."""
    out = scratch_path(spark, "arrivals")
    rows = V.items(spark, sf).select("item_id", "link", "published")
    schema = rows.schema
    arrived = freeze(rows.withColumn("drop_no", F.col("item_id") % 4))
    store = state.SeenStore(f"{out}/seen")
    for drop_no in range(4):
        arrived.where(F.col("drop_no") == drop_no).drop("drop_no").write.parquet(f"{out}/landed/drop={drop_no}")
        live = spark.readStream.schema(schema).parquet(f"{out}/landed/drop=*")
        seen_stream.new_items_stream(live, store, f"{out}/new", AS_OF, f"{out}/progress").awaitTermination()
    return state.read_table(spark, f"{out}/new", "item_id bigint, link string, published timestamp").select("item_id", "link")


def stream_keyed(spark, sf):
    """documents arriving in four drops out of the order of their times, judged by state of their links."""
    out = scratch_path(spark, "keyed")
    rows = V.items(spark, sf).select("item_id", "link", F.coalesce("published", F.lit(AS_OF).cast("timestamp")).alias("published"))
    arrived = freeze(rows.withColumn("drop_no", F.col("item_id") % 4))
    for drop_no in (2, 0, 3, 1):
        arrived.where(F.col("drop_no") == drop_no).drop("drop_no").write.parquet(f"{out}/landed/drop={drop_no}")
        live = spark.readStream.schema(rows.schema).parquet(f"{out}/landed/drop=*")
        seen_stream.run_available(seen_stream.keyed_arrivals(live, "published", "5 days"), f"{out}/new", f"{out}/progress")
    return spark.read.schema(rows.schema).parquet(f"{out}/new").select("item_id", "link")


def health(spark, sf):
    audit = scoring.response_audit(_batched(spark, sf), V.responses(spark, sf), V.VOCAB)
    found = whole.health(V.feeds(spark, sf), V.topics(spark, sf), V.users(spark, sf), V.plain_digests(spark), V.VOCAB, audit=audit)
    return found.groupBy("rule").agg(F.sum("n").alias("n"))


NAMES = [
    digest_run, fair_trim, feed_cap, newest_topk, stale_filter, seen_new, seen_upsert, settled, title_dedup,
    title_dedup_exact, story_dedup, route, unrouted, run_counts, route_grid, route_grid_domains, route_gaps,
    feed_digests, feed_reach, reader_users, reader_digests, wiring_lints, orphan_topics, topic_clean, search_feeds,
    available_digests, clean_links, publishers, title_suffixes, strip_html, truncate_text, slugs, norm_titles,
    title_tokens, safe_text, delimiters, email_check, prompts, topic_prompts, batch_join, response_audit, single_join,
    cluster_stories, model_calls, usage_extract, usage_cost, usage_daily, usage_rollup, history_page, history_deep,
    history_trim, history_counts, history_append, run_latest, merge_rows, merge_changes, merge_values, digest_blocks, render_digests,
    outbox, previous_digests, feed_scan, landed_trim, summarise_batches, summarise_topics, topic_stories, stream_daily, stream_seen, health,
    vocabularies, state_retention, full_run, run_metrics, bad_feeds, digest_files, stream_keyed, topic_reach,
]


def _tuned(fn):
    def run(spark, sf) -> DataFrame:
        return fn(tune(spark), sf)

    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


QUERIES = {fn.__name__: _tuned(fn) for fn in NAMES}
