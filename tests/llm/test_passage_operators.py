"""Tokenizer alignment, the conversation trie and decontamination on odd rows and against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from corpus_rows import CLASHING, DOCS
from winnow.llm import align, decontaminate, trie
from winnow.llm.queries import QUERIES, tokenizer_path

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def clashing(df):
    return df.selectExpr("*", *[f"'{c}' AS `{c}`" for c in CLASHING if c not in df.columns])


# --- alignment --------------------------------------------------------------------------

@pytest.fixture(scope="module")
def own():
    return align.encoders(tokenizer_path(A), tokenizer_path(B))


def plain_alignment(own, text):
    """Whole text, token by token: (n_a, n_b, groups, links)."""
    if not text:
        return 0, 0, [], Counter()
    raw = (" " + text).encode()
    ids_a = own.a.encode(" " + text, add_special_tokens=False).ids
    ids_b = own.b.encode(text)
    if b"".join(own.bytes_a[i] for i in ids_a) != raw or b"".join(own.bytes_b[i] for i in ids_b) != raw:
        return 0, 0, [], Counter()

    def owners(ids, size):
        return [k for k, i in enumerate(ids) for _ in range(size[i])]

    over_a, over_b = owners(ids_a, own.size_a), owners(ids_b, own.size_b)
    links = Counter((ids_a[x], ids_b[y]) for x, y in dict.fromkeys(zip(over_a, over_b)))
    groups, last = [], (0, 0)
    for k in range(1, len(raw) + 1):
        if k == len(raw) or over_a[k] != over_a[k - 1] and over_b[k] != over_b[k - 1]:
            x, y = over_a[k - 1] + 1, over_b[k - 1] + 1
            groups.append(",".join(map(str, ids_a[last[0]:x])) + "|" + ",".join(map(str, ids_b[last[1]:y])))
            last = x, y
    return len(ids_a), len(ids_b), groups, links


def wanted_alignment(own, rows):
    each = [(d, plain_alignment(own, t)) for d, t in rows]
    total = sum((links for _, (*_, links) in each), Counter())
    most = defaultdict(int)
    for (_, b), n in total.items():
        most[b] = max(most[b], n)
    out = []
    for d, (n_a, n_b, groups, links) in each:
        out.append((d, n_a, n_b, len(groups), sum(links.values()), sum(n for p, n in links.items() if total[p] == most[p[1]]),
                    sum(n * total[p] for p, n in links.items()), sha(";".join(groups)) if groups else ""))
    return out


def aligned(df):
    got = align.align(df, tokenizer_path(A), tokenizer_path(B)).fillna(-1, "doc_id")
    return sorted(tuple(r) for r in got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


ODD = [(30, "tab\t then  two\n\n lines \n"), (31, "low line ▁ here"), (32, "</s> <s> <unk> <|endoftext|>"), (33, "\x00 and \x1c x\x1fy　z \x85 "),
       (34, "a b c\xa0d"), (35, " leading and trailing "), (36, "\n"), (37, "é ﬁ ﷽"), (38, "no break " * 40), (39, "　　x"), (40, "-\t-\t -")]


def test_align_odd_rows(frame, own):
    rows = [(d, t) for d, t, _ in DOCS] + ODD
    df = frame([(d, t, "s") for d, t in rows])
    assert aligned(df) == sorted(wanted_alignment(own, [(-1 if d is None else d, t) for d, t in rows]))
    assert align.align(df.limit(0), tokenizer_path(A), tokenizer_path(B)).count() == 0


def test_align_whole_table(spark, sf, texts, own):
    got = sorted(tuple(r) for r in QUERIES["op11_align"](spark, sf).collect())
    assert got == sorted(wanted_alignment(own, texts))


def test_align_small_containers_and_cache(spark, texts, own, monkeypatch):
    # bitmaps of few documents, closed often; the functions run in this process
    monkeypatch.setattr(align, "CACHE", 200)
    known = align.Segments(own)
    for _, text in texts[:20]:
        numbers = known.numbers(own.segments(text))
        known.learn()
        n_a, n_b, groups, links = plain_alignment(own, text)
        assert known.counts[numbers].sum(axis=0).tolist() == [n_a, n_b, len(groups), sum(links.values())]
        assert ";".join(known.groups[n] for n in numbers) == ";".join(groups)
        if known.full():
            known.restart()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, align.CONTAINER_DOCS - 1), st.integers(1, 9)), max_size=60), st.booleans())
def test_planes_keep_every_link(rows, crowded):
    if crowded:
        rows = rows + [(7, d, 1 + d % 5) for d in range(0, align.CONTAINER_DOCS, 3)]
    pair, doc, times = (np.array([r[i] for r in rows], np.int64) for i in range(3))
    back = Counter()
    for plane, pairs, n, bitmaps in align.planes(pair, doc, times):
        for p, count, bitmap in zip(pairs.tolist(), n.tolist(), bitmaps.to_pylist()):
            at = align.places(bitmap).tolist()
            assert len(at) == count
            for d in at:
                back[p, d] += 1 << max(plane, 0)
    want = Counter()
    for p, d, n in rows:
        want[p, d] += n
    assert back == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab  \n\n\t\r'<s>é漢\x1c\x85 　.▁1\U0001f600"), max_size=40))
def test_segments_are_encoded_as_in_the_whole(own, text):
    n_a, n_b, groups, links = plain_alignment(own, text)
    segments = own.segments(text)
    assert "".join(segments) == " " + text
    found = align.Aligned(own, segments)
    if found.ok.all() and text:
        assert (found.n_a.sum(), found.n_b.sum(), ";".join(found.groups)) == (n_a, n_b, ";".join(groups))
        assert Counter((p >> align.B_BITS, p & (1 << align.B_BITS) - 1) for p in found.links.tolist()) == links


# --- trie -------------------------------------------------------------------------------

def plain_trie(rows, rebuild=True):
    """rows (conv, turn, role, text) to the nodes' tuples."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            turns[conv].append(((turn is not None, turn or 0), digest, role, text))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + v[h:] if rebuild else v
    members, ends = defaultdict(list), defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
        ends[tuple(v)].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * words
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p],
                   sha(",".join(map(str, sorted(ends[p]))))) for p, m in members.items())


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def nodes(spark, rows, rebuild=True):
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3))
    turns = trie.numbered(df)
    got = trie.trie(trie.rebuilt(turns) if rebuild else trie.ended(turns)).select(*NODE).fillna(-1, "parent_conv_id")
    return sorted(tuple(r) for r in got.collect())


def test_trie_odd_rows(spark):
    rows = [
        (0, 0, "user", "hello there"), (0, 1, "assistant", "hi you"), (0, None, None, "first of all"), (0, 2, "user", None),
        (3, 0, "user", "hello there"), (3, 0, "user", "hello there"), (3, 1, "user", ""), (4, 5, "", "x y z"), (7, 1, None, None),
        (25, 0, "user", "no family"), (45, 0, "user", "a b"), (46, 0, "user", "a b"), (46, 1, "a", "b"), (46, 1, "a", "c"),
        (None, 0, "user", "nobody's"), (12, 0, "u", "w " * 5000), (13, 0, "u", "w " * 5000),
    ] + [(60 + c, t, "u", f"turn {t}" if t < 9 else f"turn {t} {c % 2}") for c in range(3) for t in range(11)]
    assert nodes(spark, rows) == plain_trie(rows)
    assert nodes(spark, rows, rebuild=False) == plain_trie(rows, rebuild=False)
    assert nodes(spark, rows[:0] or [(None, 1, "a", "b")]) == []


def test_trie_long_and_crowded(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [(c, t, "u", rnd.choice("ab")) for c in range(150) for t in range(rnd.randint(1, 13))]
    rows += [(1000 + c, t, "u", f"same {t}") for c in range(300) for t in range(5)]  # copies
    rows += [(20_000 + c, t, "u", f"long {t}") for c in range(2) for t in range(120)]  # two long ones
    assert nodes(spark, rows) == plain_trie(rows)


@pytest.mark.parametrize("chunk", [1, 7, 1 << 16])
def test_end_digests(spark, monkeypatch, chunk):
    monkeypatch.setattr(trie, "CHUNK", chunk)
    rows = [(bytes([e]), c) for e in range(5) for c in range(1 if e < 2 else 400)]
    random.Random(1).shuffle(rows)
    want = {bytes([e]): sha(",".join(map(str, range(1 if e < 2 else 400)))) for e in range(5)}
    # as tasks would: three parts of the sorted rows
    import pyarrow as pa

    kind = pa.schema([("end", pa.binary()), ("conv", pa.int64()), ("_part", pa.int64())])
    rows.sort()
    out = []
    for part in range(3):
        own = rows[part * 401:(part + 1) * 401]
        batches = [pa.RecordBatch.from_pylist([{"end": e, "conv": c, "_part": part} for e, c in own[k:k + 90]], kind) for k in range(0, len(own), 90)]
        out += [r for b in trie._end_digests(batches) for r in b.to_pylist()]
    got = {r["end"]: r["sha"] for r in out if r["sha"]}
    pieces = sorted((r for r in out if r["ids"] is not None), key=lambda r: (r["end"], r["part"], r["place"]))
    joined = pa.RecordBatch.from_pylist([{"end": r["end"], "ids": r["ids"]} for r in pieces], pa.schema([("end", pa.binary()), ("ids", pa.string())]))
    got |= {r["end"]: r["sha"] for b in trie._joined_digests([joined]) for r in b.to_pylist()}
    assert got == want
    df = spark.createDataFrame([(bytearray(e), c) for e, c in rows], "end binary, conv long")
    assert {bytes(r["end"]): r["sha"] for r in trie.end_digests(df).collect()} == want


# --- decontamination --------------------------------------------------------------------

def plain_words(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_hits(docs, items, window=10):
    windows = defaultdict(set)
    for item, text in items:
        words = plain_words(text)
        k = min(window, len(words))
        for i in range(len(words) - k + 1 if k else 0):
            windows[tuple(words[i:i + k])].add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        words, hit, found = plain_words(text), set(), set()
        for k in sizes:
            for i in range(len(words) - k + 1):
                own = windows.get(tuple(words[i:i + k]))
                if own:
                    hit |= set(range(i, i + k))
                    found |= {str(x) for x in own if x is not None}
        out.append((-1 if doc is None else doc, len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return sorted(out)


ITEMS = [
    (1, "W1000 w1001, w1002 w1003 w1004 w1005 w1006 w1007 w1008 w1009 w1010 w1011"), (2, "quick BROWN fox"), (3, ""), (4, None), (5, "é ü"),
    (None, "lazy dog"), (7, "same line"), (7, "another"), (8, "be " * 12), (9, "?!"), (10, "w5 " * 3 + "w6"), (11, "don"), (12, "漢字"), (13, "x" * 5000),
    (14, " ".join(f"w{i}" for i in range(1490, 1510))), (15, "a" * 300 + " " + "b" * 40),
]


def found(spark, docs, items, **settings):
    items = clashing(spark.createDataFrame(items, "item_id long, text string"))
    rows = decontaminate.report(decontaminate.find(docs, items, **settings)).fillna(-1, "doc_id").collect()
    return sorted(tuple(r) for r in rows)


@pytest.mark.parametrize("shard_bytes", [decontaminate.SHARD_BYTES, 700])
def test_decontaminate_odd_rows(spark, frame, shard_bytes):
    docs = DOCS + [(50, "A" * 300 + "-" + "b" * 40 + "\x00" + "be,be.be;be:be be be be be be be be", "s"), (51, "lazy\ndog same line  lazy dog", "s")]
    assert found(spark, frame(docs), ITEMS, shard_bytes=shard_bytes) == plain_hits([(d, t) for d, t, _ in docs], ITEMS)


def test_decontaminate_nothing(spark, frame):
    assert found(spark, frame(DOCS), ITEMS[2:4]) == plain_hits([(d, t) for d, t, _ in DOCS], [])
    assert found(spark, frame(DOCS).limit(0), ITEMS) == []


def test_decontaminate_long_items_in_parts(spark, frame, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(decontaminate, "PART_BYTES", 60)
    words = [f"v{i}" for i in range(100)]
    batch = pa.RecordBatch.from_pydict({"item": ["1"], "text": [" ".join(words)]})
    parts = [p.split() for b in decontaminate._parts(10)([batch]) for p in b.column("part").to_pylist()]
    assert len(parts) > 5
    windows = {tuple(p[i:i + 10]) for p in parts for i in range(len(p) - 9)}
    assert windows == {tuple(w.encode() for w in words[i:i + 10]) for i in range(91)}


def test_decontaminate_spans_and_clean(spark, frame):
    docs = frame([(1, "zero one two three", "s"), (2, "nothing", "s"), (None, "one two", "s")])
    items = spark.createDataFrame([(1, "one two"), (2, "two three")], "item_id long, text string")
    hits = decontaminate.find(docs, items)
    got = {r["doc_id"]: ([tuple(s) for s in r["spans"]], sorted(r["items"])) for r in hits.collect()}
    assert got == {1: ([(1, 4)], ["1", "2"]), 2: ([], []), None: ([(0, 2)], ["1"])}
    assert [r["doc_id"] for r in decontaminate.clean(docs, hits).collect()] == [2]


def test_very_long_texts(spark, frame, own):
    text = "word " * 1_900_000 + " ".join(f"w{i}" for i in range(100_000))  # 10 MB
    docs = frame([(1, text, "s"), (2, "w7 w8", "s")])
    got = {r[0]: r[1:4] for r in found(spark, docs, [(1, "w7 w8 w9"), (2, "w7 w8")])}
    assert got == {1: (2_000_000, 3, 2), 2: (2, 2, 1)}
    rows = {r[0]: r for r in aligned(docs)}
    assert rows[1][1:3] == (len(own.a.encode(" " + text, add_special_tokens=False).ids), len(own.b.encode(text)))
