"""Distributed dedup against what defines its result."""

import datetime as dt
import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from winnow.functions.text import normalize_title
from winnow.operators import similar, story
from winnow.operators.similar import Profiles, dedupe_content, earliest_close, gram_bound

SCHEMA = "item_id long, item_ord long, title string, published timestamp, source string"


def close(later, earlier, threshold):
    return SequenceMatcher(None, later, earlier).ratio() >= threshold


def in_order(df):
    """(item_id, normalised title), newest first."""
    rows = df.select("item_id", normalize_title(F.col("title")).alias("t"), story.newest_first(F.col("published"), F.col("item_ord")).alias("o"))
    return [(r["item_id"], r["t"]) for r in rows.orderBy("o").collect()]


def check_cover(rows, kept, threshold):
    """What defines the result: kept titles are apart, and each one dropped is close to a newer kept one."""
    place = {i: n for n, (i, _) in enumerate(rows)}
    standing = [(place[i], t) for i, t in rows if i in kept and t]
    for i, t in rows:
        covers = [n for n, k in standing if n < place[i] and t and close(t, k, threshold)]
        assert (i in kept) == (not covers), (i, t, covers)


def headlines(seed, n, sources=("s1", "s1", "s2", "")):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdeimnorst") for _ in range(rnd.randint(3, 8))) for _ in range(40)]
    titles, rows = [], []
    for i in range(n):
        if titles and rnd.random() < 0.6:
            w = rnd.choice(titles).split()
            for _ in range(rnd.randint(0, 3)):
                kind = rnd.random()
                if kind < 0.4 and w:
                    w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
                elif kind < 0.6:
                    w.insert(rnd.randrange(len(w) + 1), rnd.choice(vocabulary))
                elif w:
                    j = rnd.randrange(len(w))
                    w[j] = w[j][:-1] + rnd.choice("xyz")
            title = " ".join(w)
        else:
            title = " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([0, 1, 1, 2, 5, 6, 8, 10, 12, 40])))
        titles.append(title)
        when = None if rnd.random() < 0.1 else dt.datetime(2024, 1, 1) + dt.timedelta(hours=rnd.randint(0, 60))
        rows.append((i, i, title, when, rnd.choice(sources)))
    return rows


def ids(df):
    return {r["item_id"] for r in df.select("item_id").collect()}


@pytest.mark.parametrize("seed,threshold,stories,options", [
    (1, 0.85, False, {}),
    (2, 0.85, True, {}),
    (3, 0.85, False, dict(cell=25)),
    (4, 0.7, False, dict(cell=40)),
    (5, 0.5, True, dict(cell=100)),
    (6, 1.0, True, {}),
])
def test_kept_titles_are_apart_and_cover_the_rest(spark, seed, threshold, stories, options):
    df = spark.createDataFrame(headlines(seed, 300), SCHEMA)
    left = story.drop_retold(df) if stories else df
    check_cover(in_order(left), ids(dedupe_content(df, threshold, stories, **options)), threshold)


RETOLD = [
    # item, title, source: newest first; all of one source retell the first but where said
    (1, "harbour bridge closed after storm damage inspection", "s1"),
    (2, "storm damage keeps harbour bridge traffic waiting", "s1"),
    (3, "storm damage keeps harbour bridge traffic waiting", "s2"),  # another source
    (4, "museum opens wing while harbour bridge rests quietly", "s1"),  # two words shared
    (5, "harbour bridge closed after storm", "s1"),  # fewer than two words of its own
    (6, "storm damage keeps harbour bridge traffic waiting", ""),  # no source
]


def test_story_rule_by_example(spark):
    rows = [(i, i, title, dt.datetime(2024, 1, 10 - i), source) for i, title, source in RETOLD]
    assert ids(story.drop_retold(spark.createDataFrame(rows, SCHEMA), 0.5)) == {1, 3, 4, 5, 6}


@pytest.mark.parametrize("hot_word,hot_key", [(3, 2000), (3, 4), (1, 2)])
def test_story_rule_with_every_kind_of_key(spark, hot_word, hot_key):
    """Which keys lead to a pair changes nothing; the SQL twin checks the rule itself over whole tables."""
    df = spark.createDataFrame(headlines(11, 300), SCHEMA)
    want = ids(story.drop_retold(df, 0.6))
    assert 0 < len(want) < 300 and ids(story.drop_retold(df, 0.6, hot_word, hot_key)) == want


def test_a_third_of_all_rows_under_one_template(spark):
    """One hot source, one template: two own words each, so all but the newest go."""
    rows = [(i, i, f"alpha bravo charlie delta echo foxtrot left{i} right{i}", dt.datetime(2024, 1, 1), "hot") for i in range(300)]
    rows += [(1000 + i, 1000 + i, f"only{i} here{i} once{i}", None, f"s{i}") for i in range(600)]
    kept = ids(story.drop_retold(spark.createDataFrame(rows, SCHEMA), 0.6, hot_word=20, hot_key=50))
    assert kept == {0} | {1000 + i for i in range(600)}


def test_copies_and_untitled(spark):
    rows = [(i, i, "Same headline for all", dt.datetime(2024, 1, 1), "a") for i in range(50)]
    rows += [(100 + i, 100 + i, "...", None, "a") for i in range(3)]
    assert ids(dedupe_content(spark.createDataFrame(rows, SCHEMA), 0.85)) == {0, 100, 101, 102}


def test_one_swapped_name_is_close_in_letters_but_not_a_retelling(spark):
    rows = [(1, 1, "Regulator opens a Lisbon supervision office", dt.datetime(2024, 1, 2), "x"),
            (2, 2, "Regulator opens a Prague supervision office", dt.datetime(2024, 1, 1), "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert ids(dedupe_content(df, 0.8)) == {1}
    assert ids(dedupe_content(df, 1.0, story_dedupe=True)) == {1, 2}
    assert ids(dedupe_content(df, 1.0)) == {1, 2}


def test_whole_table_at_the_smallest_size(spark, sf):
    from winnow.plans import views

    items = views.items(spark, sf).select("item_id", "item_ord", "title", "published", "source")
    check_cover(in_order(items), ids(dedupe_content(items, 0.85)), 0.85)


def test_a_crowd_of_look_alikes_and_a_chain(spark):
    """A third of all titles close to each other, and titles each close to its neighbours alone, so that every second goes."""
    rows = [(i, i, f"one long template of a headline that only its number tells apart {i:03}", None, "a") for i in range(300)]
    word = "abcdefghijklmnopqrstuvwxyz"
    rows += [(2000 + i, 2000 + i, word[:26 - i] + "0123456789ABCDEF"[:i], None, "a") for i in range(12)]
    rows += [(3000 + i, 3000 + i, f"{i * 7919 % 1000003:x} " * 4, None, "b") for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    for cell in (None, 100):
        check_cover(in_order(df), ids(dedupe_content(df, 0.85, cell=cell)), 0.85)


def test_bounds_never_hide_a_pair():
    titles = sorted({" ".join(r[2].lower().split()) for seed in range(4) for r in headlines(seed, 150)} - {""})
    random.Random(3).shuffle(titles)
    titles.insert(7, "e" * 400 + " long titles go past the counted levels" + "e" * 300)
    titles.append("e" * 390 + " long titles go past the counted levels" + "e" * 300)
    ranks = np.arange(len(titles)) * 3
    for t in (0.85, 0.6):
        want = [next((j for j in range(i) if SequenceMatcher(None, titles[i], titles[j]).ratio() >= t), -1) for i in range(len(titles))]
        assert earliest_close(Profiles(titles), ranks, Profiles(titles), ranks, t).tolist() == want


def test_gram_bound_is_reached():
    assert round(gram_bound(120, 0.85, 2), 6) == 32.0 and round(gram_bound(120, 0.85, 3), 6) == 13.0


def test_order_key_sorts_undated_last(spark):
    df = spark.createDataFrame([(1, None), (2, dt.datetime(2024, 1, 1)), (3, dt.datetime(2024, 1, 2))], "item_ord long, published timestamp")
    got = df.orderBy(story.newest_first(F.col("published"), F.col("item_ord"))).collect()
    assert [r["item_ord"] for r in got] == [3, 2, 1]


def test_common_subsequence():
    rnd = random.Random(5)
    for _ in range(200):
        a, b = ("".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 12))) for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert similar.common_subsequence(similar._positions(a), len(a), b) == best[-1][-1]


def test_common_subsequences_of_many_pairs():
    rnd = random.Random(6)
    titles = ["".join(rnd.choice("abcdé") for _ in range(rnd.choice([1, 5, 63, 64, 65, 130, 200, 260]))) for _ in range(60)]
    titles += [t[:k] + t[k + 3:] for t in titles for k in (2, 40)]
    titles = [t for t in titles if t]
    profiles, every = Profiles(titles), np.arange(len(titles))
    places, texts = profiles.places(every), profiles.texts(every)
    i, j = (x.reshape(-1) for x in np.meshgrid(every, every))
    size, other = profiles.sizes[i], profiles.sizes[j]
    most = np.array([similar.common_subsequence(similar._positions(titles[a]), len(titles[a]), titles[b]) for a, b in zip(i.tolist(), j.tolist())])
    for t in (0.5, 0.85, 0.95):
        least = t * (size + other) / 2
        assert (similar.common_subsequences_reach(places, i, texts, j, size, other, least) == (most >= least)).all()


def test_pairs_of_usual_titles_are_not_compared_one_by_one(monkeypatch):
    rnd = random.Random(7)
    titles = [" ".join(rnd.choice(["the", "ing", "and", "tion", "re", "ed"]) for _ in range(40)) for _ in range(300)]
    titles += [t[:-2] for t in titles[::50]]
    ranks, aligned = np.arange(len(titles)), []
    want = [next((j for j in range(i) if close(titles[i], titles[j], 0.9)), -1) for i in range(300, len(titles))]
    monkeypatch.setattr(similar, "common_subsequence", None)
    monkeypatch.setattr(similar, "SequenceMatcher", lambda *a: aligned.append(a) or SequenceMatcher(*a))
    got = earliest_close(Profiles(titles), ranks, Profiles(titles), ranks, 0.9).tolist()
    assert got[300:] == want and -1 not in want and len(aligned) < 300


def test_crowded_keys_are_copied_as_often_as_their_size_asks_for(spark):
    """Every row of one side meets every row of the other once, whatever the size; a key just above the bound is not copied 32 times."""
    sizes = {1: 5, 2: 11, 3: 40}
    rows = spark.createDataFrame([(a, -1, 100 * a + i) for a, n in sizes.items() for i in range(n)], "a long, b long, sid long")
    crowd = spark.createDataFrame([(a, -1, n) for a, n in sizes.items() if n > 10], "a long, b long, size long")
    copied = story._salted(rows, crowd, 10, True)
    assert {r["a"]: r["count"] for r in copied.groupBy("a").count().collect()} == {1: 5, 2: 22, 3: 160}
    spread = story._salted(rows, crowd, 10, False).withColumnRenamed("sid", "other")
    met = spread.join(copied, ["a", "b", "salt"])
    assert met.count() == met.distinct().count() == sum(n * n for n in sizes.values())


def test_words_of_one_set_alone_are_not_sent(spark):
    """Rows sent for each key hold numbers, and only of words that another set of the source has."""
    sets = [(i, "s", [f"alone{i}", f"only{i}", "common", "shared", "word"], 5, (i, i)) for i in range(4)] + [(9, "t", ["common", "shared", "u", "v", "w"], 5, (9, 9))]
    df = spark.createDataFrame(sets, "_no long, source string, words array<string>, n int, first struct<age:long,item_ord:long>").withColumn("sid", F.col("_no"))
    found = story._ordered_by_rarity(df).collect()
    assert sorted((r["sid"], r["own"], [x["c"] for x in r["ranked"]], len(set(r["words"]))) for r in found) == [(i, 2, [4, 4, 4], 3) for i in range(4)]
    assert len({tuple(r["words"]) for r in found}) == 1
