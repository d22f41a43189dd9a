"""Landed documents, state between runs, whole runs and streams."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from winnow import schemas
from winnow.operators import scoring
from winnow.plans import run as whole
from winnow.plans.summarise import Labels, summarise_all
from winnow.sources import feeds as landed, search, sinks, state
from winnow.streaming import seen as seen_stream

AS_OF = "2024-01-31 00:00:00"

RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>C</title>
<item><title> One &amp; two </title><link>https://a.example/1</link><description><![CDATA[<p>Hi &amp; <b>x</b></p>]]></description>
<pubDate>Mon, 29 Jan 2024 10:00:00 GMT</pubDate><source url="https://s">The Outlet</source></item>
<item><title>Two - b.example</title><link>https://www.bing.com/news/apiclick.aspx?url=https%3a%2f%2fwww.b.example%2f2</link><pubDate>29 Jan 2024 12:00:00 +0200</pubDate></item>
<item><title>Three</title><guid>https://a.example/3</guid><dc:date>2024-01-01</dc:date></item>
<item><title>Four</title><guid isPermaLink="false">x</guid><pubDate>some day</pubDate></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title><entry><title type="html">A1</title><link rel="self" href="https://x/self"/>
<link rel="alternate" href="https://x/1"/><updated>2024-01-02T03:04:05Z</updated><summary>S</summary></entry></feed>"""
RDF = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><channel><title>c</title></channel><item><title>R1</title><link>https://r/1</link></item></rdf:RDF>"""


@pytest.fixture
def folder(tmp_path):
    for name, text in {"1": RSS, "2": ATOM, "3": "<rss><channel><item>", "4": RDF, "5": "<rss><channel></channel></rss>"}.items():
        (tmp_path / f"{name}.xml").write_text(text, encoding="utf-8")
    (tmp_path / "6.xml").write_text("<rss><channel><item><title>" + "x" * 5000 + "</title></item></channel></rss>")
    (tmp_path / "7.xml").write_bytes('<?xml version="1.0" encoding="ISO-8859-1"?><rss><channel><item><title>Zürich</title></item></channel></rss>'.encode("latin-1"))
    return str(tmp_path)


def feed_table(spark, search_ids=()):
    return spark.createDataFrame([(str(i), i, f"Feed {i}", f"https://f{i}", str(i) in search_ids, "ctx" if i == 2 else None, None) for i in range(1, 8)], schemas.FEEDS)


def test_read_feeds(spark, folder):
    items, bad = landed.read_feeds(spark, folder, feed_table(spark), max_bytes=4000)
    got = {r["item_ord"] & 0xFFFFFF | r["feed_ord"] << 24: r for r in items.collect()}
    at = lambda feed, place: got[feed << 24 | place]
    assert len(got) == 7 and [r["feed_id"] for r in bad.collect()] == ["3"]
    assert (at(1, 0)["title"], at(1, 0)["publisher"], at(1, 0)["published"]) == ("One & two", "The Outlet", dt.datetime(2024, 1, 29, 10))
    assert at(1, 0)["description"] == "<p>Hi &amp; <b>x</b></p>"
    assert (at(1, 1)["link"], at(1, 1)["publisher"], at(1, 1)["title"]) == ("https://www.b.example/2", "Feed 1", "Two - b.example")
    assert at(1, 1)["published"] == dt.datetime(2024, 1, 29, 10)
    assert (at(1, 2)["link"], at(1, 2)["published"]) == ("https://a.example/3", dt.datetime(2024, 1, 1))
    assert (at(1, 3)["link"], at(1, 3)["published"]) == ("", None)
    assert (at(2, 0)["link"], at(2, 0)["description"], at(2, 0)["topic_context"]) == ("https://x/1", "S", "ctx")
    assert at(4, 0)["title"] == "R1" and at(7, 0)["title"] == "Zürich"


def test_search_feeds_are_cleaned_further(spark, folder):
    items, _ = landed.read_feeds(spark, folder, feed_table(spark, ("1",)), max_description_chars=4)
    rows = {r["title"]: r for r in items.where("feed_id = '1'").collect()}
    assert rows["Two"]["publisher"] == "b.example" and rows["One & two"]["description"] == "Hi &"


def test_size_limit_reaches_the_scan(spark, folder):
    plan = landed.read_documents(spark, folder, 4000)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,4000)" in plan


def test_search_feed_addresses(spark):
    topics = spark.createDataFrame([
        (1, " Acme ", ["a~b*c d", " "], "ctx", "sv", "SE", None, None, None), (2, "Beta", None, None, "", None, "", ["bing", "other"], None),
        (3, " ", ["q"], None, None, None, None, None, None), (4, "Gone", [" "], None, None, None, None, None, None)], schemas.TOPICS)
    got = search.search_feeds(topics).orderBy("topic_ord", "query_ord", F.desc("engine")).collect()
    assert [(r["name"], r["url"], r["topic_context"]) for r in got] == [
        ("Acme", "https://news.google.com/rss/search?q=a~b%2Ac+d+when%3A2d&hl=sv&gl=SE&ceid=SE:sv", "ctx"),
        ("Acme", "https://www.bing.com/news/search?q=a~b%2Ac+d&format=RSS&setmkt=sv-SE&sortbydate=1", "ctx"),
        ("Beta", "https://www.bing.com/news/search?q=Beta&format=RSS&setmkt=en-US&sortbydate=1", "")]
    written = spark.createDataFrame([("W", "https://w"), (None, "https://n"), ("no address", None)], "name string, url string")
    both = search.union_feeds(written, search.search_feeds(topics).select("name", "url", "topic_context", "is_search"))
    assert {(r["name"], r["is_search"]) for r in both.collect()} == {("W", False), ("https://n", False), ("Acme", True), ("Beta", True)}


def test_seen_store(spark, tmp_path):
    store = state.SeenStore(str(tmp_path / "seen"))
    links = lambda *names: spark.createDataFrame([(n,) for n in names], "link string")
    live = lambda at, days=14: sorted(r["link"] for r in store.read(spark, at, days).collect())
    assert live(AS_OF) == []
    store.mark(links("a", "b", "b", ""), "2024-01-10 00:00:00", "r1")
    store.mark(links("c"), "2024-01-30 00:00:00", "r2")
    store.mark(links("c"), "2024-01-30 00:00:00", "r2")
    assert live("2024-01-20 00:00:00") == ["a", "b", "c"] and live(AS_OF) == ["c"]
    store.compact(spark, AS_OF)
    assert live("2024-01-11 00:00:00") == ["c"]
    store.clear(spark)
    assert live(AS_OF) == []


def test_expired_days_are_pruned(spark, tmp_path):
    store = state.SeenStore(str(tmp_path / "seen"))
    store.mark(spark.createDataFrame([("a",)], "link string"), "2024-01-10 00:00:00", "r1")
    plan = store.read(spark, AS_OF)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "seen_date" in plan.split("PartitionFilters")[1][:200]


def test_run_log(spark, tmp_path):
    path = str(tmp_path / "runs")
    latest = lambda: state.latest_run(state.read_table(spark, path, schemas.RUN_LOG)).first()
    assert latest()["status"] == "idle"
    state.log_run(spark, path, "1", "running", as_of="2024-01-01 00:00:00")
    state.log_run(spark, path, "1", "success", 5, "2024-01-01 00:00:00")
    state.log_run(spark, path, "2", "failure", 0, "2024-01-02 00:00:00", error="boom")
    assert (latest()["status"], latest()["error"]) == ("failure", "boom")
    assert state.read_table(spark, path, schemas.RUN_LOG).count() == 2


def answering(category):
    def make():
        def call(prompt):
            if "FAIL" in prompt and prompt.startswith("Item"):
                raise RuntimeError("down")
            n = prompt.count("TITLE: ")
            one = {"summary": "sum", "category": category}
            return json.dumps({"items": [one] * n} if prompt.startswith("Item") else one), '{"input_tokens": 10, "output_tokens": 1}'
        return call
    return scoring.caller(make)


def run_items(spark, titles, source="a", start=0):
    rows = [(start + i, "1", 1, i, start + i, source, "P", t, f"https://x/{start + i}", "text", dt.datetime(2024, 1, 30), None) for i, t in enumerate(titles)]
    return spark.createDataFrame(rows, schemas.ITEM)


def settings(spark, tmp_path, **more):
    feeds = spark.createDataFrame([("1", 1, "a", "u", False, None, None)], schemas.FEEDS)
    digests = spark.createDataFrame([(0, "Daily", ["news"], [], False, None, ["r@x.io"], None)], schemas.DIGESTS)
    prices = spark.createDataFrame([("p", "m", 1.0, 1.0)], schemas.PRICES)
    labels = Labels(batch_size=2, provider="p", model="m")
    return whole.Settings(feeds, digests, str(tmp_path / "state"), prices=prices, labels=labels, **more)


def test_failed_batches_are_asked_item_by_item(spark):
    labels = Labels(batch_size=2)
    rows = summarise_all(run_items(spark, ["A", "FAIL", "C"]), labels, answering("news")).orderBy("item_ord").collect()
    assert [(r["summary"], r["category"]) for r in rows] == [("sum", "news")] * 3 and len(labels.calls) == 2


def test_a_run_and_the_next_one(spark, tmp_path):
    cfg = settings(spark, tmp_path, content_dedupe=True)
    items = run_items(spark, ["A first headline", "A first headline", "Something else entirely"])
    first = whole.run(spark, cfg, items, AS_OF, answering("news"), "r1")
    assert first == {"success": True, "items": 2}
    path = cfg.state_path
    history = state.HistoryStore(f"{path}/history").read(spark).orderBy("id").collect()
    assert [(r["id"], r["title"], r["digest_slug"]) for r in history] == [(1, "A first headline", "daily"), (2, "Something else entirely", "daily")]
    box = state.read_table(spark, f"{path}/outbox", "digest_slug string, page bigint, recipient string, subject string, body string, no_new_updates boolean, error string")
    assert [(r["recipient"], r["no_new_updates"]) for r in box.collect()] == [("r@x.io", False)]
    used = state.read_table(spark, f"{path}/usage", schemas.USAGE).collect()
    assert [(r["input_tokens"], r["cost_usd"]) for r in used] == [(10, 0.000011)]
    stages = {r["stage"]: r["rows"] for r in spark.read.parquet(f"{path}/stages").collect()}
    assert stages == {"fetched": 2, "new": 2, "scored": 2, "routed": 2, "unrouted": 0}
    # the next run finds nothing new and sends the old digest again
    seen_before = state.SeenStore(f"{path}/seen").read(spark, AS_OF).count()
    again = whole.run(spark, cfg, items, "2024-01-31 06:00:00", answering("news"), "r2")
    assert again == {"success": True, "items": 0, "previous_delivered": 1} and seen_before == 2
    assert sorted(r["no_new_updates"] for r in box.sparkSession.read.parquet(f"{path}/outbox").collect()) == [False, True]
    runs = state.latest_run(state.read_table(spark, f"{path}/runs", schemas.RUN_LOG)).first()
    assert runs["status"] == "success" and runs["previous_delivered"]


def test_topics_and_readers_from_landed_files_to_the_outbox(spark, tmp_path):
    """Topics become feeds, each reader's digest follows from the topics, skipped files are reported."""
    written = spark.createDataFrame([("w", 0, "W", "https://w", False, None, None)], schemas.FEEDS)
    topics = spark.createDataFrame(
        [(0, "Bridges", ["bridge"], "", None, None, None, ["google"], "all"),
         (1, "Ports", ["port", "harbour"], "", None, None, None, ["bing", "google"], "Ann@x.io")], schemas.TOPICS)
    users = spark.createDataFrame([(0, "Ann", "ann@x.io"), (1, "Bob", "bob@x.io"), (2, "None", "nowhere")], schemas.USERS)
    cfg = whole.Settings(written, None, str(tmp_path / "state"), topics, users, digest_sections=("news",),
                         labels=Labels(categories=["news", "exclude"]))
    feeds = [tuple(r) for r in whole.all_feeds(cfg).orderBy("feed_ord").select("feed_id", "feed_ord", "name", "is_search").collect()]
    assert feeds == [("w", 0, "W", False), ("search-0-0-google", 1, "Bridges", True)] + [
        (f"search-1-{q}-{e}", 2 + 2 * q + n, "Ports", True) for q in (0, 1) for n, e in enumerate(("google", "bing"))]
    land = tmp_path / "landed"
    land.mkdir()

    def body(title):
        return f"<rss><channel><item><title>{title}</title><link>https://x/{title}</link><pubDate>2024-01-30</pubDate></item></channel></rss>"

    for stem, text in {"w": body("own"), "search-0-0-google": body("span"), "search-1-1-bing~1": body("quay"),
                       "stranger": body("stray"), "search-1-0-google": "<rss><chan"}.items():
        (land / f"{stem}.xml").write_text(text)
    (land / "w~2.xml").write_bytes(b" " * (landed.MAX_BYTES + 1))
    items = whole.fetch_all(spark, str(land), cfg, AS_OF, "r1")
    result = whole.run(spark, cfg, items, AS_OF, answering("news"), "r1")
    assert result == {"success": True, "items": 3}
    routed = state.HistoryStore(f"{cfg.state_path}/history").read(spark)
    assert sorted((r["digest_title"], r["title"]) for r in routed.collect()) == [
        ("Ann's Digest", "quay"), ("Ann's Digest", "span"), ("Bob's Digest", "span")]
    box = spark.read.parquet(f"{cfg.state_path}/outbox")
    assert sorted(r["recipient"] for r in box.collect()) == ["ann@x.io", "bob@x.io"]
    skipped = spark.read.parquet(f"{cfg.state_path}/skipped").select("feed_id", "doc_ord", "reason")
    assert sorted(tuple(r) for r in skipped.collect()) == [
        ("search-1-0-google", 0, "malformed"), ("stranger", 0, "unknown_feed"), ("w", 2, "oversized")]


def test_settings_that_work_against_each_other(spark, tmp_path):
    cfg = settings(spark, tmp_path, story_dedupe=True)
    assert whole.warnings(cfg) == []
    cfg.labels.cluster = True
    assert len(whole.warnings(cfg)) == 1


def test_unrouted_items_come_back_and_excluded_ones_do_not(spark, tmp_path):
    cfg = settings(spark, tmp_path)
    items = run_items(spark, ["A", "B"])
    assert whole.run(spark, cfg, items, AS_OF, answering("ai"), "r1")["items"] == 0
    assert state.SeenStore(f"{cfg.state_path}/seen").read(spark, AS_OF).count() == 0
    assert [tuple(r)[:4] for r in spark.read.parquet(f"{cfg.state_path}/unrouted/batch_id=r1").collect()] == [("a", "-", "ai", 2)]
    whole.run(spark, cfg, items, AS_OF, answering("exclude"), "r2")
    assert state.SeenStore(f"{cfg.state_path}/seen").read(spark, AS_OF).count() == 2


def test_a_failed_run_leaves_the_state_alone(spark, tmp_path):
    cfg = settings(spark, tmp_path)

    def broken(frames):
        raise RuntimeError("no model")
        yield

    result = whole.run(spark, cfg, run_items(spark, ["A"]), AS_OF, broken, "r1")
    assert not result["success"]
    assert state.SeenStore(f"{cfg.state_path}/seen").read(spark, AS_OF).count() == 0
    assert state.latest_run(state.read_table(spark, f"{cfg.state_path}/runs", schemas.RUN_LOG)).first()["status"] == "failure"


def test_topics_are_merged_and_ordered(spark):
    def make():
        def call(prompt):
            if "TITLE: b" in prompt:
                return "nothing", None
            return json.dumps({"clusters": [{"title": "M", "summary": "s", "category": "news", "members": [2, 0]}]}), None
        return call

    items = run_items(spark, ["a0", "a1", "a2"], "a").unionAll(run_items(spark, ["b0"], "b", 10))
    rows = summarise_all(items, Labels(cluster=True), scoring.caller(make)).orderBy("item_ord").collect()
    assert [(r["source"], r["title"], r["category"], len(r["links"] or [])) for r in rows] == [
        ("a", "M", "news", 2), ("a", "a1", "other", 1), ("b", "b0", "other", 0)]


def test_stream_runs_equal_batches(spark, tmp_path):
    cfg = settings(spark, tmp_path, max_total=100)
    land = str(tmp_path / "landed")
    for n, titles in enumerate([["A", "B"], ["A", "C"]]):
        run_items(spark, titles).withColumn("link", F.concat(F.lit("https://x/"), "title")).coalesce(1).write.parquet(f"{land}/{n}")
        whole.run_stream(spark, cfg, f"{land}/*", schemas.ITEM, lambda batch: AS_OF, answering("news"), str(tmp_path / "progress")).awaitTermination()
    sent = state.HistoryStore(f"{cfg.state_path}/history").read(spark)
    assert sorted((r["id"], r["title"]) for r in sent.collect()) == [(1, "A"), (2, "B"), (3, "C")]


def test_keyed_arrivals(spark, tmp_path):
    """Late rows are judged, a link comes back after the retention, a batch that comes again gives the same rows."""
    day = lambda d: dt.datetime(2024, 1, d)
    drops = [[("a", day(10)), ("a", day(10)), ("b", day(10)), ("", day(1)), (None, day(1)), ("c", None)],
             [("a", day(2)), ("c", day(1)), ("b", day(12))], [("a", day(24)), ("b", day(23)), ("c", day(3))], [("a", day(30))]]
    new = []
    for n, rows in enumerate(drops):
        spark.createDataFrame(rows, "link string, time timestamp").coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
        live = spark.readStream.schema("link string, time timestamp").parquet(str(tmp_path / "in/*"))
        seen_stream.run_available(seen_stream.keyed_arrivals(live, "time"), str(tmp_path / "out"), str(tmp_path / "cp"))
        rows = sorted((r["link"], r["time"].day) for r in spark.read.parquet(str(tmp_path / "out")).collect())
        new.append(rows)
    assert new[0] == [("a", 10), ("a", 10), ("b", 10)]
    assert new[1] == sorted(new[0] + [("c", 1)])
    assert new[3] == new[2] == sorted(new[1] + [("a", 24)])


def test_a_batch_that_comes_again_after_compacting(spark, tmp_path):
    store = state.SeenStore(str(tmp_path / "seen"))
    links = lambda *names: spark.createDataFrame([(n,) for n in names], "link string")
    live = lambda **k: sorted(r["link"] for r in store.read(spark, AS_OF, **k).collect())
    store.mark(links("a", "b"), AS_OF, "1")
    store.mark(links("b", "c"), AS_OF, "2")
    store.compact(spark, AS_OF)
    assert live() == ["a", "b", "b", "c"] and live(except_batch="1") == ["b", "c"]
    store.mark(links("a"), AS_OF, "1")  # its rows stand for the folded ones
    assert live() == ["a", "b", "c"]
    store.compact(spark, AS_OF)
    assert live() == ["a", "b", "c"] and live(except_batch=2) == ["a"]


def test_clear_after_a_rewrite_that_died(spark, tmp_path, monkeypatch):
    store = state.SeenStore(str(tmp_path / "seen"))
    store.mark(spark.createDataFrame([("a",)], "link string"), AS_OF, "1")
    note = store._note

    def dies(spark, gen, live, watermark=None):
        if live:
            raise RuntimeError("lost")
        note(spark, gen, live, watermark)

    monkeypatch.setattr(store, "_note", dies)
    with pytest.raises(RuntimeError):
        store.compact(spark, AS_OF)
    assert store.read(spark, AS_OF).count() == 1  # the old generation still counts
    monkeypatch.undo()
    store.clear(spark)
    assert store.read(spark, AS_OF).count() == 0
    store.mark(spark.createDataFrame([("b",)], "link string"), AS_OF, "2")
    assert [r["link"] for r in store.read(spark, AS_OF).collect()] == ["b"]


def test_two_renderings_of_one_time(spark):
    from winnow.operators import render

    rows = [("a", "A", dt.datetime(2024, 1, 1), "r1"), ("a", "A", dt.datetime(2024, 1, 1), "r2"), ("b", "B", dt.datetime(2024, 1, 1), "r1")]
    archive = spark.createDataFrame(rows, "digest_slug string, digest_title string, rendered_at timestamp, document_batch string")
    assert sorted((r["digest_slug"], r["document_batch"]) for r in render.latest_digests(archive).collect()) == [("a", "r2"), ("b", "r1")]


def test_a_run_expires_what_it_keeps(spark, tmp_path):
    cfg = settings(spark, tmp_path, history_entries=3, usage_days=30)
    for n, at in enumerate(("2023-11-01 00:00:00", "2024-01-30 00:00:00", AS_OF)):
        titles = [f"batch {n} item {i}" for i in range(2)]
        items = run_items(spark, titles, start=10 * n)
        assert whole.run(spark, cfg, items, at, answering("news"), f"r{n}")["items"] == 2
    path = cfg.state_path
    sent = state.HistoryStore(f"{path}/history")
    assert sorted(r["id"] for r in sent.read(spark).collect()) == [4, 5, 6] and sent.last_id(spark, "next") == 6
    assert [r["day"].year for r in state.UsageStore(f"{path}/usage").read(spark).collect()] == [2024, 2024]
    seen = state.SeenStore(f"{path}/seen").rows(spark)
    assert sorted(r["link"][-2:] for r in seen.collect()) == ["10", "11", "20", "21"]
    # the last batch comes again: same rows, no ids used twice
    assert whole.run(spark, cfg, run_items(spark, ["batch 2 item 0", "batch 2 item 1"], start=20), AS_OF, answering("news"), "r2")["items"] == 2
    assert sorted(r["id"] for r in sent.read(spark).collect()) == [4, 5, 6]


def test_metrics_of_a_run(spark, tmp_path):
    cfg = settings(spark, tmp_path, content_dedupe=True, per_feed=4, max_total=None)
    items = run_items(spark, ["A first headline", "A first headline", "Something else entirely", "third", "cut off"])
    # an unused trim must not be waited for
    whole.trim_run(items, cfg, AS_OF)
    whole.run(spark, cfg, whole.trim_run(items, cfg, AS_OF), AS_OF, answering("news"), "r1")
    rows = [tuple(r)[:3] for r in spark.read.parquet(f"{cfg.state_path}/metrics").collect()]
    assert sorted(rows) == sorted([("trim", 5, 4), ("dedup", 4, 3), ("seen", 3, 3), ("summarise", 3, 3), ("route", 3, 3)])
    whole.trim_run(items, cfg, AS_OF)
    whole.run(spark, cfg, run_items(spark, ["other"], start=50), AS_OF, answering("news"), "r2")
    rows = [tuple(r)[:3] for r in spark.read.parquet(f"{cfg.state_path}/metrics/batch_id=r2").collect()]
    assert ("trim", None, 1) in rows


def test_landed_folders(spark, tmp_path):
    path = str(tmp_path / "landed")
    docs = spark.createDataFrame([("a/b c", 0, RSS), ("a/b c", 1, "<rss><chan"), ("x", 0, ATOM)], "feed_id string, doc_ord int, body string")
    landed.land_documents(docs, path)
    got = landed.read_documents(spark, path).collect()
    assert sorted((r["feed_id"], r["doc_ord"]) for r in got) == [("a/b c", 0), ("a/b c", 1), ("x", 0)]
    plan = landed.read_documents(spark, path, 4000)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,4000)" in plan


def test_landed_groups_are_bounded(spark, tmp_path):
    """Documents of blanks are stored in few bytes; a reader holds a group of them whole."""
    import pyarrow.parquet as pq

    body = F.when(F.col("id") % 4 == 0, F.repeat(F.lit(" "), 200_000)).otherwise(F.concat(F.lit("<rss>"), "id"))
    docs = spark.range(150).coalesce(1).select(F.col("id").cast("string").alias("feed_id"), F.lit(0).alias("doc_ord"), body.alias("body"))
    landed.land_documents(docs, path := str(tmp_path / "landed"))
    stored = pq.ParquetFile(next((tmp_path / "landed").rglob("*.parquet"))).metadata
    assert max(stored.row_group(i).num_rows for i in range(stored.num_row_groups)) == 16
    want = sorted((r["feed_id"], r["body"] + "\n") for r in docs.collect())
    assert sorted((r["feed_id"], r["body"]) for r in landed.read_documents(spark, path).collect()) == want


def test_landed_documents_share_files(spark, tmp_path):
    """Files follow the tasks and not the documents; every document is read back, whatever its id, length or body."""
    path = str(tmp_path / "landed")
    body = F.when(F.col("id") == 7, F.lit(None)).when(F.col("id") == 8, F.repeat(F.lit("é"), 3000)).otherwise(F.concat(F.lit("<rss>"), "id"))
    docs = spark.range(300).coalesce(2).select(
        F.when(F.col("id") == 9, F.lit("")).otherwise(F.concat(F.lit("00"), F.col("id") % 90)).alias("feed_id"), F.floor(F.col("id") / 90).cast("int").alias("doc_ord"),
        body.cast("string").alias("body"))
    landed.land_documents(docs, path)
    assert len(list((tmp_path / "landed").rglob("*.parquet"))) == 2
    want = sorted((r["feed_id"] or "", r["doc_ord"], (r["body"] or "") + "\n") for r in docs.collect())
    assert sorted((r["feed_id"] or "", r["doc_ord"], r["body"]) for r in landed.read_documents(spark, path).collect()) == want
    known = docs.where("feed_id <> ''").select("feed_id", F.lit("u").alias("url"))
    reasons = {(r["feed_id"], r["doc_ord"]): r["reason"] for r in landed.skipped_documents(spark, path, known, 6000).collect()}
    assert reasons[("008", 0)] == "oversized" and reasons[(None, 0)] == "unknown_feed"
    assert landed.read_documents(spark, path, 6001).count() == 300


def test_block_files_in_order(spark, tmp_path):
    rows = [("a", i // 50, i % 50, f"line {i}") for i in range(200)] + [("b", 0, 0, "two\nlines")]
    spark_rows = spark.createDataFrame(rows, "digest_slug string, rank int, n long, text string").repartition(7)
    sinks.deliver(spark_rows, "file", str(tmp_path / "out"))
    for slug, want in (("a", [f"line {i}" for i in range(200)]), ("b", ["two", "lines"])):
        files = sorted((tmp_path / "out" / f"digest_slug={slug}").glob("part-*"))
        assert "".join(f.read_text() for f in files).splitlines() == want


def test_digest_files(spark, tmp_path):
    rows = spark.createDataFrame([(0, "A", "a", 1, "tail"), (0, "A", "a", 0, "head\nline"), (1, "B", "b", 0, "b")],
                                 "digest_ord int, digest_title string, digest_slug string, page long, markdown string")
    sinks.deliver(rows, "file", str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out" / "digest_slug=a").glob("part-*")))
    assert text == "head\nline\ntail\n"


def test_checkpoint_folder_of_the_cluster_is_used(spark):
    from winnow.session import ensure_checkpoint_dir, freeze

    ensure_checkpoint_dir(spark)
    assert freeze(spark.range(3)).count() == 3 and spark.sparkContext.getCheckpointDir()


def test_a_batch_delivered_again_keeps_its_rows(spark, tmp_path):
    store, out = state.SeenStore(str(tmp_path / "seen")), str(tmp_path / "out")
    items = run_items(spark, ["A", "B"]).withColumn("link", F.concat(F.lit("https://x/"), "title")).coalesce(1)
    items.write.parquet(str(tmp_path / "in"))
    for again in range(2):  # a new progress folder delivers batch 0 once more
        live = spark.readStream.schema(items.schema).parquet(str(tmp_path / "in"))
        seen_stream.new_items_stream(live, store, out, AS_OF, str(tmp_path / f"cp{again}")).awaitTermination()
        assert sorted(r["title"] for r in spark.read.parquet(out).collect()) == ["A", "B"]
    assert store.read(spark, AS_OF).count() == 2 and store.read(spark, AS_OF, except_batch="s0").count() == 0


def test_late_days_are_counted(spark, tmp_path):
    from winnow.streaming import usage as usage_stream

    kinds = "at timestamp, provider string, model string, input_tokens long, output_tokens long, cost_usd double"
    for n, day in enumerate([20, 5, 6]):
        spark.createDataFrame([(dt.datetime(2024, 1, day, 3), "p", "m", 10, 1, 0.5)], kinds).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
        calls = spark.readStream.schema(kinds).parquet(str(tmp_path / "in/*"))
        usage_stream.keep_days(usage_stream.daily_usage_stream(calls), str(tmp_path / "days"), str(tmp_path / "cp")).awaitTermination()
    rows = usage_stream.read_days(spark, str(tmp_path / "days")).collect()
    assert sorted((r["day"].day, r["calls"], r["total_tokens"]) for r in rows) == [(5, 1, 11), (6, 1, 11), (20, 1, 11)]


def test_documents_beyond_16_bits_keep_their_own_ids(spark):
    body = "<rss><channel><item><title>t</title><link>https://x/1</link></item></channel></rss>"
    docs = spark.createDataFrame([("a", 65536, body), ("b", 0, body)], "feed_id string, doc_ord int, body string")
    feeds_ = spark.createDataFrame([("a", 0, "A", "ua", False, None), ("b", 1, "B", "ub", False, None)],
                                   "feed_id string, feed_ord int, name string, url string, is_search boolean, topic_context string")
    assert landed.feed_items(docs, feeds_).select("item_id").distinct().count() == 2


@pytest.mark.parametrize("reported", [1, 2])
@pytest.mark.parametrize("cap", [3, 7])
def test_a_low_and_a_high_cap_give_equal_stories(spark, cap, reported):
    """Stories are the titles' letters; the stand-in reports those it sees at least `reported` times."""
    def make():
        def call(prompt):
            groups = {}
            for i, line in enumerate(x for x in prompt.split("\n") if x.startswith("TITLE: ")):
                groups.setdefault(line[7], []).append(i)
            told = [{"title": f"{c} all", "summary": f"about {c}", "category": "news", "members": at} for c, at in groups.items() if len(at) >= reported]
            return json.dumps({"clusters": told}), None
        return call

    items = run_items(spark, ["a1", "b1", "c1", "d1", "b2", "a2", "e1", "f1", "a3", "f2", "e2", "g1"], "a").unionAll(run_items(spark, ["a9", "a8"], "b", 20))

    def told(size):
        rows = summarise_all(items, Labels(cluster=True, topic_items=size), scoring.caller(make)).orderBy("item_ord").collect()
        return [(r["item_ord"], r["item_id"], r["source"], r["title"], r["summary"], r["category"], r["link"], [x["link"] for x in r["links"]]) for r in rows]

    high = told(100)
    assert len(high) == 8 and told(cap) == high


def test_a_lost_call_of_a_topic_is_made_good(spark):
    """Items of a call without an answer join stories of the others; the rest goes through batches."""
    def make():
        def call(prompt):
            if prompt.startswith("Item"):
                return json.dumps({"items": [{"summary": "batch", "category": "news"}] * prompt.count("TITLE: ")}), None
            titles = [x[7:] for x in prompt.split("\n") if x.startswith("TITLE: ")]
            if titles == ["a2", "b1"]:
                return None, None
            at = [i for i, t in enumerate(titles) if t[0] == "a"]
            return json.dumps({"clusters": [{"title": "A", "summary": "s", "category": "news", "members": at}]}), None
        return call

    rows = summarise_all(run_items(spark, ["a1", "c1", "a2", "b1"]), Labels(cluster=True, topic_items=2), scoring.caller(make)).orderBy("item_ord").collect()
    assert [(r["title"], r["summary"]) for r in rows] == [("A", "s"), ("c1", "text"), ("b1", "batch")]


def test_messages_refer_to_the_blocks_of_their_batch(spark, tmp_path):
    from winnow.operators import render

    cfg = settings(spark, tmp_path)
    items = run_items(spark, ["A", "B"])
    for batch, at in (("r1", AS_OF), ("r2", "2024-01-31 06:00:00")):
        assert whole.run(spark, cfg, items, at, answering("news"), batch)["success"]
    box = spark.read.parquet(f"{cfg.state_path}/outbox")
    blocks = state.read_table(spark, f"{cfg.state_path}/blocks", whole.DIGEST_BLOCKS)
    told = render.message_blocks(box, blocks).orderBy("n").collect()
    texts = {again: "\n".join(r["text"] for r in told if r["no_new_updates"] == again) for again in (False, True)}
    assert texts[False] == texts[True] and texts[False].count("### [") == 2
    assert [r["body_chars"] for r in box.collect()] == [len(texts[True])] * 2


@pytest.mark.parametrize("buckets", [1, 3])
def test_keyed_arrivals_share_state(spark, tmp_path, buckets):
    """Links in one bucket keep their own marks, and each drop makes no more calls than there are buckets."""
    day = lambda d: dt.datetime(2024, 1, d)
    drops = [[(f"l{i}", day(1 + i % 3)) for i in range(50)], [(f"l{i}", day(4 + i % 14)) for i in range(60)], [("l0", day(9)), ("l1", day(30))]]
    marks, want = {}, []
    for n, rows in enumerate(drops):
        new = [(k, t) for k, t in rows if k not in marks or t >= marks[k] + dt.timedelta(days=14)]
        for k, t in new:
            marks[k] = max(t, marks.get(k, t))
        want += new
        spark.createDataFrame(rows, "link string, time timestamp").write.parquet(str(tmp_path / f"in/{n}"))
        live = spark.readStream.schema("link string, time timestamp").parquet(str(tmp_path / "in/*"))
        judged = seen_stream.keyed_arrivals(live, "time", buckets=buckets)
        assert "_bucket" in judged._jdf.queryExecution().analyzed().toString()
        seen_stream.run_available(judged, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["link"], r["time"]) for r in got) == sorted(want)


def test_marks_of_a_bucket_go_one_by_one():
    """A mark that is due goes unless its link has rows, which are still judged by it; the rest stays with its own time."""
    import pandas as pd

    class State:
        hasTimedOut, exists, get, gone = False, True, (["a", "b", "c"], [100, 100, 100], [5, 5, 50]), False
        getCurrentProcessingTimeMs = staticmethod(lambda: 10)  # noqa: N815

        def update(self, value):
            self.get = value

        def remove(self):
            self.gone = True

        def setTimeoutDuration(self, ms):  # noqa: N802
            self.wait = ms

    state_, frame = State(), pd.DataFrame({"link": ["a", "d"], "_micros": [105, 7]})
    assert [f["link"].tolist() for f in seen_stream._judge(20, 30)(None, iter([frame]), state_)] == [["d"]]
    assert state_.get == (["c", "a", "d"], [100, 100, 7], [50, 40, 40]) and state_.wait == 30
    state_.hasTimedOut, State.getCurrentProcessingTimeMs = True, staticmethod(lambda: 45)
    assert list(seen_stream._judge(20, 30)(None, iter([]), state_)) == [] and state_.get[0] == ["c"] and state_.wait == 5
    State.getCurrentProcessingTimeMs = staticmethod(lambda: 50)
    assert list(seen_stream._judge(20, 30)(None, iter([]), state_)) == [] and state_.gone
