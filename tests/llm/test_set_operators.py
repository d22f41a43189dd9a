"""Jaccard join, substring dedup, mixing, sharding, components and the pipeline."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpus_rows import CLASHING, DOCS
from winnow.llm import exact, jaccard, mixing, sharding, substring
from winnow.llm.common import running, written
from winnow.llm.components import components

WORD = r"[^\x20\x09-\x0D]+"


def words_of(text):
    return re.findall(WORD, text or "")


# --- running totals ---------------------------------------------------------------------

def test_running_totals(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.randrange(5)) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, g string, v long").repartition(7)
    got = {r["i"]: (r["all"], r["own"]) for r in running(running(df, ["i"], F.col("v"), out="all"), ["i"], F.col("v"), ["g"], "own").collect()}
    total, own = 0, Counter()
    for i, g, v in rows:
        assert got[i] == (total, own[g])
        total += v
        own[g] += v


# --- components ---------------------------------------------------------------------------

def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(200)] + [(rng.randrange(300, 500), rng.randrange(300, 500)) for _ in range(120)] + [(900, 900)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in links:
        parent[root(u)] = root(v)
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    nodes = {x for u, v in links if u != v for x in (u, v)}
    assert set(got) == nodes
    by_label, by_root = defaultdict(set), defaultdict(set)
    for x in nodes:
        by_label[got[x]].add(x)
        by_root[root(x)].add(x)
    assert sorted(map(sorted, by_label.values())) == sorted(map(sorted, by_root.values()))
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- Jaccard join ---------------------------------------------------------------------------

def plain_near_copies(rows, size=5, threshold=75):
    sets = []
    for _, text in rows:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words_of(text)]
        sets.append({tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def by_text(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def families(seed, n=140):
    """Texts around a few originals, more and less changed, many at the border of a link."""
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    originals = [[rng.choice(vocabulary) for _ in range(rng.choice([6, 30, 60]))] for _ in range(5)]
    passage = [f"p{i}" for i in range(25)]
    out = []
    for i in range(n):
        w = list(rng.choice(originals))
        for _ in range(rng.choice([0, 1, 1, 2, 3, 12])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            w = w[:10] + passage + w[10:]
        if rng.random() < 0.2:
            w = [x.upper() for x in w]
        out.append((i * 7 % 1000, " ".join(w)))
    return out


def near(df, **k):
    return by_text((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_copies(df, **k).collect())


def test_jaccard_odd_rows(docs):
    assert near(docs) == by_text(plain_near_copies([(d, t) for d, t, _ in DOCS]))
    assert jaccard.near_copies(docs.limit(0)).count() == 0


@pytest.mark.parametrize("leaf,screen,pivots,depth", [(jaccard.LEAF_SHINGLES, 8192, 32, 4), (150, 4, 3, 3), (150, 8192, 2, 0)])
def test_jaccard_any_region_size(frame, leaf, screen, pivots, depth):
    rows = families(5)
    df = frame([(d, t, "s") for d, t in rows], 4)
    assert near(df, leaf_shingles=leaf, screen_docs=screen, n_pivots=pivots, depth=depth) == by_text(plain_near_copies(rows))


def test_jaccard_screens_regions_of_any_size(spark):
    """A region larger than one task may compare goes in blocks; before, it passed whole."""
    sets = [np.sort(jaccard.mix64(np.arange(40 * i, 40 * i + 40, dtype=np.uint64))) for i in range(40)]
    for i in (7, 31):
        sets[i] = sets[3].copy()
    marks = spark.createDataFrame([(i, len(x), bytearray(jaccard.signature(x))) for i, x in enumerate(sets)], "uid long, n int, signature binary")
    members = spark.createDataFrame([("a", i, i, 7) for i in range(40)], "region string, uid long, label long, pivot long")
    for screen in (8192, 10, 4):
        found = jaccard._screen(members, marks, 75, screen).collect()
        assert sorted((r["region"], r["uid"], r["label"], r["n"], r["with_pivot"]) for r in found) == [("a", i, i, len(sets[i]), True) for i in (3, 7, 31)]


def test_jaccard_regions_that_pivots_do_not_cut(frame, monkeypatch):
    """All documents are as far from each other: every cell is the region again, so it isn't cut a second time."""
    shared, calls = " ".join(f"p{i}" for i in range(64)), []
    rows = [(i, shared + "".join(f" own{i}x{k}" for k in range(11))) for i in range(40)]
    compare = jaccard._compare
    monkeypatch.setattr(jaccard, "_compare", lambda *a: calls.append(a) or compare(*a))
    assert near(frame([(d, t, "s") for d, t in rows], 4), leaf_shingles=500, n_pivots=4, depth=3) == by_text(plain_near_copies(rows))
    assert len(calls) == 2


def test_signatures_never_miss_a_link():
    rng = random.Random(12)
    sets, texts = [], [t for _, t in families(12, 60)]
    known = jaccard.WordHashes()
    sets = [jaccard.shingles(t.encode(), known) for t in texts]
    sizes = np.array([len(s) for s in sets])
    labels = np.array([rng.randrange(40) for _ in sets])
    any_, with_first = jaccard.may_link([jaccard.signature(s) for s in sets], sizes, labels, 75, 3)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if labels[i] != labels[j] and jaccard.linked(len(np.intersect1d(a, b)), len(a), len(b), 75):
                assert any_[i] and any_[j] and (i != 3 or with_first[j])
    assert not any_.all()


def test_jaccard_frequent_shingles(frame, monkeypatch):
    monkeypatch.setattr(jaccard, "COUNT_LEAST", 2)
    monkeypatch.setattr(jaccard, "COUNT_CHUNK", 300)
    rows = families(8)
    assert near(frame([(d, t, "s") for d, t in rows], 1)) == by_text(plain_near_copies(rows))


# --- substring dedup --------------------------------------------------------------------------

def plain_substrings(rows, window):
    first = {}
    for d, t in rows:
        w = words_of(t)
        for i in range(len(w) - window + 1):
            k = tuple(w[i:i + window])
            first[k] = min(first.get(k, float("inf")), float("inf") if d is None else d)
    out = []
    for d, t in rows:
        w = words_of(t)
        gone = {p for i in range(len(w) - window + 1) if first[tuple(w[i:i + window])] < (float("inf") if d is None else d) for p in range(i, i + window)}
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


def cut(df, **k):
    return by_text(tuple(r) for r in substring.dedup(df, **k).drop("kept_text").collect())


def test_substring_odd_rows(docs):
    assert cut(docs) == by_text(plain_substrings([(d, t) for d, t, _ in DOCS], 50))
    assert substring.dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("window,gram,shard", [(12, 5, 512), (12, 5, 1), (8, 8, 2), (6, 1, 3)])
def test_substring_any_shard_size(frame, window, gram, shard):
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(30)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.choice([10, 20, 40]))] for _ in range(4)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(rng.randrange(4)):
            w += rng.choice([rng.choice(passages), [rng.choice(vocabulary) for _ in range(8)], ["be"] * 20, rng.choice(passages)[3:]])
        rows.append((rng.randrange(50), " ".join(w)))
    df = frame([(d, t, "s") for d, t in rows], 4)
    assert cut(df, window=window, gram=gram, shard_segments=shard) == by_text(plain_substrings(rows, window))


def test_substring_pieces(frame, monkeypatch):
    monkeypatch.setattr(substring, "PIECE", 17)
    w = [f"v{i % 70}" for i in range(200)]
    rows = [(1, " ".join(w)), (2, " ".join(["x", *w[30:150], "y"])), (3, " ".join(w[:49]))]
    assert list(substring.segments(substring.WordHashes().of([x.encode() for x in w]), 50, 11))
    assert cut(frame([(d, t, "s") for d, t in rows], 1)) == by_text(plain_substrings(rows, 50))


def test_automaton_matching_statistics():
    rng = random.Random(9)
    for _ in range(40):
        texts = sorted((rng.randrange(6), [rng.choice("ab") for _ in range(rng.randrange(1, 25))]) for _ in range(5))
        a = substring.Automaton()
        for d, t in texts:
            a.add(t, d)
        for query in [t for _, t in texts] + [[rng.choice("abc") for _ in range(30)]]:
            for k in (1, 3, 5):
                want = [min((d for d, t in texts if any(t[j:j + k] == query[i:i + k] for j in range(len(t) - k + 1))), default=substring.NO_ID)
                        for i in range(len(query) - k + 1)]
                assert a.firsts(query, k) == want


# --- mixing -------------------------------------------------------------------------------------

def test_mixing_odd_rows(docs):
    got = mixing.mix(docs).collect()
    assert len(got) == len(DOCS) and mixing.mix(docs.limit(0)).count() == 0
    sizes = sorted(len(words_of(t)) for _, t, _ in DOCS)
    assert sorted(r["size"] for r in got) == sizes
    for r in got:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    assert sum(r["taken"] for r in got) <= 1.5 * sum(sizes)


def plain_targets(sizes, weights, share, most):
    """Sources that would be above their cap stop there; the rest is shared again."""
    w = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    left, open_, out = Fraction(share) * sum(sizes.values()), set(sizes), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        above = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not above:
            out.update({s: level * w[s] for s in open_})
            break
        for s in above:
            out[s] = Fraction(most * sizes[s])
            left -= out[s]
        open_ -= above
    return out


def test_mixing_targets(spark):
    rng = random.Random(6)
    for _ in range(4):
        sizes = {s: rng.choice([0, 3, 50, 400, 10_000]) for s in [*"abcdefg", "ä", "\U0001f600", "￿", None][:rng.randrange(1, 12)]}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.targets(df, (3, 1, 2), 1.5, 2.0).collect()}
        assert got.keys() == sizes.keys()
        for s, t in plain_targets(sizes, (3, 1, 2), 1.5, 2).items():
            assert got[s] == pytest.approx(float(t))


def test_mix_is_near_its_targets(frame):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randrange(1, 40), rng.choice(["a"] * 6 + ["b", "b", "c", None])) for i in range(900)]
    df = mixing.mix(frame(rows)).drop("text_hash")
    got = df.collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(frame(rows, 5)).drop("text_hash").collect()))
    by_source = defaultdict(lambda: [0, 0.0])
    for r in got:
        by_source[r["source_size"]][0] += r["taken"]
        by_source[r["source_size"]][1] = r["target"]
    assert all(abs(taken - target) <= 80 for taken, target in by_source.values())


# --- sharding -------------------------------------------------------------------------------------

def test_sharding_odd_rows(docs):
    got = sharding.shard(docs, 4).collect()
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _ in DOCS)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    where = defaultdict(set)
    for r in got:
        where[r["text_crc32"]].add(r["shard"])
    assert all(len(s) == 1 for s in where.values())
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    assert sharding.shard(docs.limit(0)).count() == 0


@pytest.mark.parametrize("chunk", [7, 20_000])
def test_sharding_is_balanced_at_any_chunk(frame, chunk):
    rng = random.Random(8)
    rows = [(i, f"{i} " + "y" * int(rng.paretovariate(1.3) * 30), "s") for i in range(600)]
    got = sharding.shard(frame(rows, 5), 16, chunk=chunk).collect()
    sums = Counter()
    for r in got:
        sums[r["shard"]] += r["size"]
    assert len(got) == 600 and set(sums) == set(range(16))
    largest = max(r["size"] for r in got)
    assert max(sums.values()) - min(sums.values()) <= max(largest, 0.02 * max(sums.values()))


def test_difference_is_karmarkar_karp():
    rng = random.Random(5)
    for _ in range(30):
        sizes = [rng.randrange(1, 1000) for _ in range(rng.randrange(1, 40))]
        sums, held = sharding.difference([[s] for s in sizes], 2)
        heap = [-s for s in sizes]  # for two bins: the two largest are replaced by their difference
        heapq.heapify(heap)
        while len(heap) > 1:
            heapq.heappush(heap, heapq.heappop(heap) - heapq.heappop(heap))
        assert sums[0] - sums[1] == -heap[0]
        assert sorted(i for m in held for i, _ in m) == list(range(len(sizes)))
        assert [sum(sizes[i] for i, _ in m) for m in held] == sums


# --- pipeline ---------------------------------------------------------------------------------------

def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "1 AS uid", "'y' AS `__x`", "2 AS text_sha256")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(written(stage(spark, kept[-1], sf), "stage"))
        assert kept[-1].columns == docs.columns
    rows = {n: [(r["doc_id"], r["text"]) for r in df.collect()] for n, df in zip(["documents", *names], kept)}
    # classifier: clean documents stay, most of the others go
    gone = {d for d, _ in rows["documents"]} - {d for d, _ in rows["quality_classifier"]}
    assert sum(labels.get(d) == 1 for d in gone) <= 0.02 * sum(labels.values())
    assert sum(labels.get(d) == 0 for d in gone) >= 0.8 * sum(v == 0 for v in labels.values())
    # exact dedup: one of each text, the longest
    groups = defaultdict(list)
    for d, t in rows["quality_classifier"]:
        groups["".join(t.split())].append((-len(t), d, t))
    assert sorted(rows["exact_dedup"]) == sorted((d, t) for _, d, t in map(min, groups.values()))
    # near copies: the smallest of each component
    assert sorted(d for d, _ in rows["jaccard_join"]) == sorted(d for d, _, c in plain_near_copies(rows["exact_dedup"]) if c == d)
    # the mix: copies of what came in
    copies = Counter(rows["mixing_sources"])
    assert set(copies) <= set(rows["jaccard_join"]) and max(copies.values()) <= 2
    total = lambda r: sum(len(words_of(t)) for _, t in r)
    assert 1.3 * total(rows["jaccard_join"]) <= total(rows["mixing_sources"]) <= 1.5 * total(rows["jaccard_join"])
    last = corpus_pipeline.STAGES[-1][1](spark, kept[-1], sf).collect()
    assert Counter(r["doc_id"] for r in last) == Counter(d for d, _ in rows["mixing_sources"])
    text = dict(rows["documents"])
    assert all(r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest() for r in last)
    whole = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, last))


def test_stages_odd_rows(spark, docs, sf):
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[1:]:
            out = stage(spark, rows, sf)
            if name != "bpe_encoding":
                assert out.columns == docs.columns
            assert out.count() >= (rows.count() > 0)
    kept = [r["text"] for r in corpus_pipeline.STAGES[1][1](spark, docs, sf).collect()]
    assert len(kept) == len({"".join(re.split(r"[\x20\x09-\x0D]", t or "")) for _, t, _ in DOCS})
    assert set(CLASHING) <= set(docs.columns) and exact.dedup(docs).columns[0] == "doc_id"


def test_stages_keep_one_row_of_null_and_repeated_ids(spark, frame):
    """One of each group of near copies, and of equal texts the longest, whatever the ids are."""
    from winnow.llm import stages

    words = [f"w{i}" for i in range(60)]
    near_ = [" ".join(words), " ".join(words + ["x"]), " ".join(words + ["y"])]
    other = [" ".join(f"o{i}" for i in range(40)) + end for end in ("", " a", " b")]
    kept = stages.jaccard_join(spark, frame([(None, t, "s") for t in near_] + [(7, t, "s") for t in other]), "").collect()
    assert sorted((r["doc_id"] is None, r["text"][0]) for r in kept) == [(False, "o"), (True, "w")]
    variants = ["a b c", "a  b  c", "abc", "a b  c"]
    rows = [(None, t, "s") for t in variants] + [(3, t.upper(), "s") for t in variants]
    for parts in (1, 3):
        kept = stages.exact_dedup(spark, frame(rows, parts), "").collect()
        assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == [(0, "a  b  c"), (3, "A  B  C")]


def test_exact_dedup_keeps_the_rows_of_dedup_without_joining_texts(spark, frame):
    """The rows that exact.dedup keeps; whole texts meet no decisions in a join and are gathered in no aggregate."""
    from winnow.llm import stages

    lead = "z" * 200  # beyond the characters that splitters look at
    rows = [(k, lead + str(k % 7) + " " * (k % 3), "s") for k in range(40)] + [(None, None, "s"), (None, "", "t"), (50, " \n", "s"), (51, None, "s")]
    rows += [(52, "\u00e9 \u00a0x", "s"), (52, "\u00e9\u00a0x", "s"), (53, "\u00e9x", "s"), (None, "\u00e9x ", "s")]
    for parts in (1, 4):
        table = frame(rows, parts)
        out = stages.exact_dedup(spark, table, "")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan
        digest = F.sha2(exact.normalise(F.col("text")), 256).alias("text_sha256")
        got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text_sha256"]) for r in out.select("doc_id", digest).collect())
        kept = exact.dedup(table).where("kept").collect()
        assert got == sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text_sha256"]) for r in kept)
    assert stages.exact_dedup(spark, frame(rows[:0]), "").count() == 0


@pytest.mark.parametrize("threshold", [20, 40, 50, 75])
def test_signatures_of_any_width_that_may_link_are_compared(threshold):
    sets = [np.sort(jaccard.mix64(np.arange(n, dtype=np.uint64))) for n in (30, 33, 60, 66, 75, 130, 150, 160)]
    sizes, labels = np.array([len(x) for x in sets]), np.arange(len(sets))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if jaccard.linked(len(b), len(a), len(b), threshold):
                assert jaccard.may_link([jaccard.signature(b), jaccard.signature(a)], sizes[[j, i]], labels[[j, i]], threshold, 0)[0].all()


@pytest.mark.parametrize("threshold", [25, 45])
def test_low_thresholds_lose_no_link(frame, threshold):
    rng = random.Random(threshold)
    rows = []
    for k in range(6):
        words = [f"k{k}w{i}" for i in range(200)]
        rows += [(100 * k + n, " ".join(words[:n])) for n in (rng.randrange(18, 24), rng.randrange(40, 50), rng.randrange(70, 90))]
    got = near(frame([(d, t, "s") for d, t in rows]), threshold=threshold, screen_docs=8192)
    assert got == by_text(plain_near_copies(rows, threshold=threshold))
