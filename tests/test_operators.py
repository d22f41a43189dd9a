"""Small golden cases of the relational operators."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from winnow.functions import vocab
from winnow.operators import clusters, history, merge, readers, render, routing, scoring, seen, trim, usage
from winnow.operators.ordinals import dense_ordinal
from winnow import schemas

AS_OF = "2024-01-31 00:00:00"
D = dt.datetime


def test_ordinals_are_dense_within_groups(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("g"))
    got = {(r["g"], r["id"]): r["n"] for r in dense_ordinal(df.repartition(7), ["id"], "n", ["g"]).collect()}
    hot = sorted(i for g, i in got if g == "hot")
    assert [got["hot", i] for i in hot] == list(range(len(hot)))
    assert {n for (g, _), n in got.items() if g != "hot"} == {0}
    everything = dense_ordinal(df.repartition(7), ["id"], "n").collect()
    assert {r["n"]: r["id"] for r in everything} == {i: i for i in range(1000)}


@pytest.fixture
def loud_quiet(spark):
    rows = [(i, "loud", 0, i, D(2024, 1, 20, i)) for i in range(10)] + [(10 + i, "quiet", 1, i, D(2024, 1, 10 - i)) for i in range(2)]
    return spark.createDataFrame(rows, "item_id long, feed_id string, feed_ord int, entry_ord long, published timestamp")


@pytest.mark.parametrize("cap,quiet", [(2, 1), (3, 1), (4, 2), (50, 2)])
def test_fair_trim_serves_the_quiet_feed(loud_quiet, cap, quiet):
    got = [r["feed_id"] for r in trim.fair_trim(loud_quiet, cap, AS_OF).collect()]
    assert got.count("quiet") == quiet and len(got) == min(cap, 12)
    assert {r["feed_id"] for r in trim.newest(loud_quiet, 10, AS_OF).collect()} == {"loud"}


def test_fair_trim_above_the_group_limit(loud_quiet):
    assert trim.fair_trim(loud_quiet, 5000, AS_OF).count() == 12


def test_undated_items_count_as_fresh(spark):
    df = spark.createDataFrame([(1, "f", 0, 0, D(2020, 1, 1)), (2, "f", 0, 1, None), (3, "f", 0, 2, D(2024, 1, 30))],
                               "item_id long, feed_id string, feed_ord int, entry_ord long, published timestamp")
    assert [r["item_id"] for r in trim.newest(df, 2, AS_OF).collect()] == [2, 3]
    assert {r["item_id"] for r in trim.drop_stale(df, AS_OF, 5).collect()} == {2, 3}
    assert trim.drop_stale(df, AS_OF, None).count() == 3


def test_seen_expires_and_empty_links_never_pass(spark):
    items = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, ""), (5, None), (6, "c")], "item_id long, link string")
    store = spark.createDataFrame([("a", D(2024, 1, 30)), ("b", D(2024, 1, 17))], schemas.SEEN)
    assert {r["item_id"] for r in seen.filter_new(items, store, AS_OF, 14).collect()} == {2, 3, 6}
    after = {r["link"]: r["seen_at"] for r in seen.upsert_seen(store, items, AS_OF, 14).collect()}
    assert after == {link: D(2024, 1, 31) for link in "abc"}


SCORED = "item_id long, source string, category string, domain string, link string, links array<struct<publisher:string,link:string>>"
DIGEST = "digest_ord int, title string, sections array<string>, sources array<string>, sources_derived boolean, domain string"


def test_routing_rules(spark):
    scored = spark.createDataFrame([
        (1, "f1", "news", "en", "l1", None), (2, "f2", "news", None, "l2", None), (3, "f1", "exclude", "en", "l3", None), (4, "f3", "ai", "en", "l4", None),
    ], SCORED)
    digests = spark.createDataFrame([
        (0, "All", ["news"], [], False, None), (1, "None", ["news", "ai"], [], True, None), (2, "F1", ["news"], [" f1 "], False, None),
        (3, "En", ["news"], None, None, "en"),
    ], DIGEST)
    routed = routing.route(scored, digests)
    assert sorted((r["item_id"], r["digest_title"]) for r in routed.collect()) == [(1, "All"), (1, "En"), (1, "F1"), (2, "All")]
    assert [tuple(r) for r in routing.unrouted(scored, routed).collect()] == [("f3", "en", "ai", 1)]
    assert tuple(routing.run_counts(scored, routed).first()) == (1, 4)
    assert {r["item_id"] for r in seen.settled(scored, scored, routed).collect()} == {1, 2, 3}


def test_members_of_a_delivered_story_are_settled(spark):
    fetched = spark.createDataFrame([(1, "l1"), (2, "l2"), (3, "l3")], "item_id long, link string")
    story = spark.createDataFrame([(1, "f", "news", None, "l1", [("p", "l1"), ("q", "l2")])], SCORED)
    assert {r["item_id"] for r in seen.settled(fetched, story, story).collect()} == {1, 2}


def test_feed_routing_and_lints(spark):
    feeds = spark.createDataFrame([("1", 1, "a", "u", False, None, ["X", "Ghost"]), ("2", 2, "b", "u", False, None, []), ("3", 3, "c", "u", False, None, None)], schemas.FEEDS)
    digests = spark.createDataFrame([(0, "X", ["news"], [], False, None, [], None), (1, "Y", ["news"], ["a", "zz"], False, None, [], None)], schemas.DIGESTS)
    applied = {r["title"]: (r["sources"], r["sources_derived"]) for r in routing.apply_feed_routing(digests, feeds).collect()}
    assert applied == {"X": (["a"], True), "Y": (["a", "zz"], False)}
    topics = spark.createDataFrame([(1, "t", None, None, None, None, None, None, "gone@x.io"), (2, "s", None, None, None, None, None, None, None)], schemas.TOPICS)
    users = spark.createDataFrame([(1, "U", "u@x.io")], schemas.USERS)
    found = {tuple(r) for r in routing.lints(feeds, topics, users, digests).collect()}
    assert found == {("unknown_source", "Y", "zz"), ("unrouted_source", "b", None), ("unrouted_source", "c", None),
                     ("unknown_recipient", "t", "gone@x.io"), ("unknown_digest", "a", "Ghost"), ("silent_feed", "c", None)}
    none = feeds.withColumn("digests", F.lit(None).cast("array<string>"))
    assert routing.apply_feed_routing(digests, none).first()["sources_derived"] is False


def test_readers(spark):
    users = spark.createDataFrame([(1, " Ann ", " ann@x.io "), (2, "", "BOB@x.io"), (3, "dup", "ANN@X.IO"), (4, "bad", "nope")], schemas.USERS)
    clean = [(r["user_ord"], r["name"], r["email"]) for r in readers.normalise_users(users).orderBy("user_ord").collect()]
    assert clean == [(1, "Ann", "ann@x.io"), (2, "BOB@x.io", "BOB@x.io")]
    pad = (None,) * 6
    topics = spark.createDataFrame([(1, "T1", *pad, "Ann@x.io"), (2, "T2", *pad, "carl@x.io"), (3, "T3", *pad, "ann@x.io")], schemas.TOPICS)
    got = readers.derive_digests(users, topics, labels={"key": "Top"}).collect()
    assert [(r["title"], r["sources"], r["to"], r["labels"]) for r in got] == [("Ann's Digest", ["T1", "T3"], ["ann@x.io"], {"key": "Top"})]


def test_merge_rows_and_values(spark):
    t = lambda rows: spark.createDataFrame(rows, "name string, url string")
    base, edited = t([("kept", "1"), ("same", "2"), ("upd", "3")]), t([("same", "2"), ("upd", "9"), ("gone", "4"), ("new", "5")])
    stamp = spark.createDataFrame([("gone",), ("upd",)], "name string")
    merged, changes = merge.three_way_merge(base, edited, stamp, "name")
    assert {tuple(r) for r in merged.collect()} == {("kept", "1"), ("same", "2"), ("upd", "9"), ("new", "5")}
    assert {tuple(r) for r in changes.collect()} == {("upd", "updated"), ("gone", "removed"), ("new", "added")}
    _, without = merge.three_way_merge(base, edited, None, "name")
    assert ("gone", "added") in {tuple(r) for r in without.collect()}
    kv = lambda rows: spark.createDataFrame(rows, "name string, value string")
    merged, changes = merge.three_way_merge(
        kv([("a", "1"), ("b", "2"), ("only", "x")]), kv([("a", "0"), ("b", "3"), ("c", "4"), ("d", "5")]), kv([("a", "0"), ("c", "4")]), "name", mode="values")
    assert {tuple(r) for r in merged.collect()} == {("a", "1"), ("b", "3"), ("only", "x"), ("d", "5")}
    assert {tuple(r) for r in changes.collect()} == {("a", "kept"), ("b", "set"), ("c", "removed"), ("d", "set")}


def test_prices(spark):
    prices = spark.createDataFrame([("p", "m-1", 1.0, 2.0), ("p", "m-1-4", 10.0, 20.0), ("p", "s", 5.0, 5.0)], schemas.PRICES)
    calls = spark.createDataFrame([(i, "p" if m != "other" else "q", m if m != "other" else "m-1", 1_000_000, 1_000_000) for i, m in enumerate(
        ["m-1", "m-1-20240101", "m-1-4-20240101", "s-latest", "s-", "other"])], "id int, provider string, model string, input_tokens long, output_tokens long")
    got = {r["id"]: r["cost_usd"] for r in usage.estimate_cost(calls, prices).collect()}
    assert got == {0: 3.0, 1: 3.0, 2: 30.0, 3: None, 4: None, 5: None}


def test_usage_fields(spark):
    rows = [('{"input_tokens":1,"output_tokens":2}',), ('{"prompt_tokens":3}',), ("{}",), (None,), ('{"output_tokens":7,"prompt_tokens":9}',)]
    got = usage.extract_usage(spark.createDataFrame(rows, "usage_json string")).collect()
    assert sorted((r["input_tokens"], r["output_tokens"]) for r in got) == [(0, 7), (1, 2), (3, 0)]


def test_daily_usage_is_partial_and_windowed(spark):
    rows = [(D(2024, 1, 31), dt.date(2024, 1, 31), "p", "m", "batch", 1, 2, 0.5), (D(2024, 1, 31), dt.date(2024, 1, 31), "p", "x", "batch", 1, 2, None),
            (D(2024, 1, 30), dt.date(2024, 1, 30), "p", "m", "batch", 5, 5, 0.25), (D(2023, 1, 1), dt.date(2023, 1, 1), "p", "m", "batch", 9, 9, 9.0)]
    calls = spark.createDataFrame(rows, schemas.USAGE)
    daily = usage.daily_usage(calls, AS_OF, 2).collect()
    assert [(str(r["day"]), r["calls"], r["total_tokens"], r["cost_usd"], r["cost_is_partial"], r["models"]) for r in daily] == [
        ("2024-01-31", 2, 6, 0.5, True, ["p/m", "p/x"]), ("2024-01-30", 1, 10, 0.25, False, ["p/m"])]
    total = [r for r in usage.usage_totals(usage.daily_usage(calls, AS_OF, 2)).collect() if r["day"] is None][0]
    assert (total["calls"], total["cost_usd"], total["cost_is_partial"], total["n_days"]) == (3, 0.75, True, 2)
    assert usage.expire_usage(calls, AS_OF, 390).count() == 3


VOCAB = ["exclude", "key", "mention"]


def batch(spark, n=3):
    rows = [(i, i, 0, i, f"T{i}", "desc" * 100) for i in range(n)]
    return spark.createDataFrame(rows, "item_id long, item_ord long, batch_id long, pos int, title string, description string")


@pytest.mark.parametrize("response,want", [
    ('{"items":[{"summary":"a","category":"key"},{"summary":"b","category":"odd"}]}', ["a/key", "b/mention", "-/mention"]),
    ('[{"summary":"a","category":"key"},"x",{"category":"key"},{"summary":"late"}]', ["a/key", "-/mention", "-/mention"]),
    ('"just text"', ["-/mention"] * 3), ("{broken", ["-/mention"] * 3), (None, ["-/mention"] * 3),
    ('{"items":[{"summary":"","category":"key"},null,{"summary":"c","category":"exclude"}]}', ["-/mention", "-/mention", "c/exclude"]),
])
def test_batch_results(spark, response, want):
    answers = spark.createDataFrame([(0, response)], "batch_id long, response string")
    got = scoring.attach_results(batch(spark), answers, VOCAB, "mention").orderBy("pos").collect()
    assert [("-" if r["summary"] == ("desc" * 100)[:300] else r["summary"]) + "/" + r["category"] for r in got] == want
    assert {r["domain"] for r in got} == {None}


def test_vocabulary(spark):
    rows = [  # settings, then the labels expected
        ((None, None, None, None), (sorted(vocab.DEFAULT_CATEGORIES), [], "other", None)),
        ((["b", " a ", "exclude"], [" b", "", "a"], None, None), (["a", "b", "exclude"], ["a", "b"], "b", "a")),
        ((["exclude"], ["y", "x"], None, "q"), (["exclude"], ["x", "y"], "exclude", "x")),
        ((["a"], ["y", "x"], "z", "y"), (["a"], ["x", "y"], "z", "y")),
    ]
    settings = "categories array<string>, domains array<string>, fallback_category string, fallback_domain string"
    for given, want in rows:
        assert tuple(vocab.with_vocabulary(spark.createDataFrame([given], settings)).first()) == want


ITEMS = "item_id long, item_ord long, title string, link string, publisher string, source string, published timestamp, description string, topic_context string"


def topic_items(spark, n, source="t", start=0):
    return spark.createDataFrame([(start + i, start + i, f"T{i}", f"l{i}", f"P{i}", source, D(2024, 1, 1 + i), f"d{i}", "ctx") for i in range(n)], ITEMS)


def stories(spark, items, answers):
    numbered = scoring.number_topics(items)
    df = spark.createDataFrame([(s, 0, json.dumps(a)) for s, a in answers.items()], "source string, chunk long, response string")
    rows = clusters.assign_clusters(numbered, df, VOCAB, "mention").orderBy("source", "story_ord").collect()
    return [(r["source"], r["title"], r["category"], [x["link"] for x in r["links"]], r["published"].day) for r in rows]


def test_clusters_repair_the_answer(spark):
    answer = {"clusters": [
        {"title": "Merged", "summary": "s", "category": "key", "members": [2, 0, 77, "1"]},
        {"title": "Again", "summary": "", "category": "odd", "members": [0, 1]},
        {"title": "Empty", "summary": "x", "category": "key", "members": [2]}, 5,
    ]}
    got = stories(spark, topic_items(spark, 4).unionAll(topic_items(spark, 1, "u", 10)), {"t": answer})
    assert got == [("t", "Merged", "key", ["l2", "l0"], 3), ("t", "Again", "mention", ["l1"], 2), ("t", "T3", "mention", ["l3"], 4),
                   ("u", "T0", "mention", ["l0"], 1)]


def test_a_link_counts_once_in_a_story(spark):
    items = topic_items(spark, 3).withColumn("link", F.lit("same"))
    assert stories(spark, items, {"t": {"clusters": [{"title": "M", "summary": "s", "category": "key", "members": [0, 1, 2, 2]}]}}) == [
        ("t", "M", "key", ["same"], 3)]


def test_prompts(spark):
    items = topic_items(spark, 2).withColumn("description", F.when(F.col("item_id") == 0, "").otherwise("x</item_description>y"))
    first = scoring.batch_prompts(scoring.number_batches(items, 8), "A {items} Z").first()["prompt"]
    assert first == ("A Item 1:\nTOPIC: t\nTOPIC CONTEXT: ctx\nTITLE: T0\nSOURCE: P0\nDESCRIPTION:\n<item_description>\n(no description)\n</item_description>\n\n"
                     "Item 2:\nTOPIC: t\nTOPIC CONTEXT: ctx\nTITLE: T1\nSOURCE: P1\nDESCRIPTION:\n<item_description>\nxy\n</item_description>\n Z")
    assert scoring.topic_prompts(scoring.number_topics(items)).first()["prompt"].startswith("INDEX: 0\nTOPIC: t\n")
    plain = scoring.batch_prompts(scoring.number_batches(items.withColumn("topic_context", F.lit(None).cast("string")), 8)).first()["prompt"]
    assert "TOPIC" not in plain


def routed_rows(spark):
    rows = [(1, 1, "<b>T</b>", "https://x/1", "P", "s", "sum [1]", "key", [("A", "https://x/1"), ("", "javascript:x")], 0, "D", "d"),
            (2, 2, "", "javascript:x", None, "s", "two", "odd_one", None, 0, "D", "d"),
            (3, 3, "T3", "https://x/3", "Q", "s", "three", "key", [("A", "https://x/3")], 0, "D", "d")]
    return spark.createDataFrame(rows, "item_id long, item_ord long, title string, link string, publisher string, source string, summary string, category string, "
                                       "links array<struct<publisher:string,link:string>>, digest_ord int, digest_title string, digest_slug string")


DOCUMENT = """# D

*2024-01-31*

## Top

### [&lt;b&gt;T&lt;/b&gt;](https://x/1)
*[A](https://x/1) · source*

sum &#91;1&#93;

### [T3](https://x/3)
*Q*

three


## Other

### Untitled
*s*

two"""


@pytest.mark.parametrize("page_blocks", [5000, 2])
def test_render_whole_or_in_pages(spark, page_blocks):
    digests = spark.createDataFrame([(0, "D", ["key", "mention"], [], False, None, ["a@x.io, b@x.io"], {"key": "Top"})], schemas.DIGESTS)
    pages = render.render(routed_rows(spark), digests, AS_OF, page_blocks=page_blocks)
    assert "\n".join(r["markdown"] for r in pages.orderBy("page").collect()) == DOCUMENT
    box = render.outbox(pages.where("page = 0"), digests, "c@x.io", AS_OF, no_new_updates=True).orderBy("recipient").collect()
    assert [(r["recipient"], r["subject"], r["error"]) for r in box] == [
        ("a@x.io", "D — 2024-01-31 (no new updates)", None), ("b@x.io", "D — 2024-01-31 (no new updates)", None)]
    bare = digests.withColumn("to", F.lit(None).cast("array<string>"))
    assert [r["recipient"] for r in render.outbox(pages.where("page = 0"), bare, "c@x.io", AS_OF, env_to="e@x.io, f@x.io").collect()] == ["e@x.io", "f@x.io"]
    assert render.outbox(pages.where("page = 0"), bare, None, AS_OF).first()["error"] is not None


def test_history(spark):
    rows = spark.createDataFrame([(i, D(2024, 1, 1), "T", "a" if i % 2 else "b", str(i), "l", "s", "x", "c") for i in range(1, 11)], schemas.HISTORY)
    page, total = history.history_page(rows, limit=2, offset=1, digest_slug="a")
    assert [r["id"] for r in page.collect()] == [7, 5] and total.first()["total"] == 5
    assert [r["id"] for r in history.keep_latest(rows, 3).collect()] == [10, 9, 8]
    assert [r["id"] for r in history.history_before(rows, 4, 2).collect()] == [3, 2]


def test_topics_for_everyone_by_list_and_by_join(spark, sf):
    from winnow.plans import views

    users, topics = readers.normalise_users(views.users(spark, sf)), views.topics(spark, sf)
    rows = lambda limit: {r["user_ord"]: r["topics"] for r in readers.topics_by_user(users, topics, limit).collect()}
    assert rows(50_000) == rows(0)


def test_a_long_list_for_everyone_is_in_no_shuffle(spark):
    """More names than a dimension may have rows: still one list, joined after the readers met their own topics."""
    users = spark.createDataFrame([(1, "A", "a@x.io"), (2, "B", "b@x.io")], "user_ord int, name string, email string")
    topics = spark.range(60_001).select(
        F.col("id").cast("int").alias("topic_ord"), F.concat(F.lit("t"), "id").alias("name"), F.when(F.col("id") == 30_000, "A@x.io").alias("recipient"))
    rows = readers.topics_by_user(users, topics)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" not in plan and plan.index("_common") < plan.index("Join LeftOuter")
    got = {r["user_ord"]: r["topics"] for r in rows.collect()}
    assert got[1] == [f"t{i}" for i in range(60_001)] and got[2] == [t for t in got[1] if t != "t30000"]
    none = readers.topics_by_user(users, topics.where("recipient IS NOT NULL")).collect()
    assert [(r["user_ord"], r["topics"]) for r in none] == [(1, ["t30000"])]


def test_stories_of_a_source_count_on_across_calls(spark):
    """Unclaimed items are numbered over the source, clusters through its answers."""
    numbered = scoring.number_topics(topic_items(spark, 6), max_items=3)
    answers = [("t", k, json.dumps({"clusters": [{"title": f"C{k}", "members": [0, 2]}]})) for k in (0, 1)]
    rows = clusters.assign_clusters(numbered, spark.createDataFrame(answers, "source string, chunk long, response string"), VOCAB, "mention")
    late = 1 << 40
    assert sorted((r["story_ord"], r["title"]) for r in rows.collect()) == [(0, "C0"), (1, "C1"), (late + 1, "T1"), (late + 4, "T4")]


def test_a_digest_as_blocks_and_one_message(spark):
    """However a digest is cut, each recipient gets one message, and its blocks are the document."""
    digests = spark.createDataFrame([(0, "D", ["key", "mention"], [], False, None, ["a@x.io, b@x.io"], {"key": "Top"})], schemas.DIGESTS)
    blocks = render.document(routed_rows(spark), digests, AS_OF).orderBy("n").collect()
    assert [r["n"] for r in blocks] == list(range(7)) and "\n".join(r["text"] for r in blocks) == DOCUMENT
    pages = render.render(routed_rows(spark), digests, AS_OF, page_blocks=2)
    for rendered in (pages, render.document(routed_rows(spark), digests, AS_OF)):
        box = render.outbox(rendered, digests, None, AS_OF).orderBy("recipient").collect()
        assert [(r["recipient"], r["body_chars"]) for r in box] == [("a@x.io", len(DOCUMENT)), ("b@x.io", len(DOCUMENT))]


@pytest.mark.parametrize("template", [render.HEADER, "", " \t", "\n\n {title} \n"])
def test_sizes_without_blocks(spark, template):
    """Lengths alone give what the blocks give: blank and padded headers, summaries that end in white space or are null."""
    digests = spark.createDataFrame([
        (0, "D", ["key", "mention"], [], False, None, ["a@x.io"], {"key": "Top"}), (1, " E ", ["mention"], [], False, None, [], None),
        (2, "Nothing", ["gone"], [], False, None, [], None)], schemas.DIGESTS)
    base = routed_rows(spark)
    tailed = base.withColumn("summary", F.when(F.col("item_ord") % 2 == 0, F.concat("summary", F.lit(" \n "))))
    other = tailed.withColumns({"digest_ord": F.lit(1), "digest_title": F.lit(" E "), "digest_slug": F.lit("e")})
    for routed in (base, tailed, tailed.unionByName(other), base.limit(0)):
        told = [sorted(map(tuple, f.collect())) for f in (
            render.document_sizes(routed, digests, AS_OF, template), render.sizes(render.document(routed, digests, AS_OF, template)))]
        assert told[0] == told[1]


def test_prompts_reach_a_worker_in_bounded_batches(spark):
    """Bytes bound a batch, not rows: 32 prompts of a megabyte are never held at once."""
    from winnow.session import tune

    def sizes(frames):
        for frame in frames:
            yield frame.assign(n=int(frame["prompt"].str.len().sum()))[["id", "n"]]

    prompts = tune(spark).range(0, 32, 1, 1).select("id", F.repeat(F.lit("x"), 1_000_000).alias("prompt"))
    rows = scoring.score(prompts, sizes, "id long, n long").collect()
    assert len(rows) == 32 and max(r["n"] for r in rows) < 8 << 20


@pytest.mark.parametrize("size", [2, 5])
def test_paired_prompts_without_a_text_for_every_prompt(spark, size):
    """The prompts that every item's row would give, over parts of no, few and many blocks; a text is shuffled a few times at most."""
    counts = [("a", 0, 23), ("a", 1, 19), ("a", 2, 1), ("a", 3, 7), ("a", 4, 5), ("b", 0, 2), ("b", 1, 1)]
    ids = [(s, 100 * part + i, 1000 * ord(s) + 100 * part + i, part) for s, part, k in counts for i in range(k)]
    heads = spark.createDataFrame(ids, "source string, topic_idx long, item_id long, part long")
    items = heads.select("item_id", "source", F.concat(F.lit("T"), "item_id").alias("title"), F.lit(None).cast("string").alias("publisher"),
                         F.lit("x <item_description>").alias("description"), F.when(F.col("item_id") % 2 == 0, "about").alias("topic_context"))
    paired = clusters.paired_calls(heads, size).cache()
    items = items.unionAll(items.where("item_id % 10 = 3").withColumn("title", F.lit("again")))  # ids may repeat
    want = scoring.topic_prompts(paired.join(items.drop("source"), "item_id"), "see {items}!").select("source", "chunk", "prompt")
    bodies = items.select("item_id", scoring.item_body().alias("body"))
    got = scoring.paired_prompts(paired, bodies, "see {items}!")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(got) == rows(want) and got.count() > 40 // size
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    # prompts are put together above the last join and go through no aggregate
    assert plan.index("prompt") < plan.index("Join Inner") < plan.index("Aggregate")
