"""BPE, token id files, WARC, exact dedup, rules and quality on odd rows and against plain versions."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from corpus_rows import DOCS
from winnow.llm import bpe, exact, quality, rangecoder, rules, tokenids, warc
from winnow.llm.queries import QUERIES, tokenizer_path
from winnow.session import scratch_path

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_file(tokenizer_path(n)) for n in (BYTE, WORD)}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# --- BPE --------------------------------------------------------------------------------

def wanted_bpe(library, text):
    ids = library[BYTE].encode(text, add_special_tokens=False).ids
    return len(ids), sha(",".join(map(str, ids))), sha(library[BYTE].decode(ids, skip_special_tokens=False))


def test_bpe_odd_rows(docs, library):
    path = tokenizer_path(BYTE)
    got = sorted(tuple(r) for r in bpe.decode(bpe.encode(docs, path), path).fillna(-1, "doc_id").collect())
    assert got == sorted((-1 if d is None else d, *wanted_bpe(library, t or "")) for d, t, _ in DOCS)
    assert bpe.decode(bpe.encode(docs.limit(0), path), path).count() == 0


def test_bpe_whole_table(spark, sf, texts, library):
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op1_bpe"](spark, sf).collect()}
    assert got == {d: wanted_bpe(library, t) for d, t in texts}


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abe tht  '\n\t<|>sé漢1 \U0001f600"), max_size=60))
def test_bpe_text(library, text):
    own = bpe.tokenizer(tokenizer_path(BYTE))
    cache = bpe.PieceCache(own)
    numbers = cache.numbers(bpe.cut(own, text))
    cache.learn()
    ids = cache.spell(numbers).tolist()
    assert ids == library[BYTE].encode(text, add_special_tokens=False).ids
    assert own.decode(ids) == text


def test_bpe_pieces_together_and_a_lower_rank_that_arises():
    own = object.__new__(bpe.ByteBPE)
    own.byte_id = list(range(256))
    a, b, c = b"abc"
    # (b, c) -> 300 comes after (a, 300) in rank: applying (b, c) makes a pair that must go first
    own.ranks = {(b, c): (5, 300), (a, 300): (1, 301), (301, b): (2, 302)}
    pieces, wanted = ["abcbc", "bc", "", "abc"], [[302, c], [300], [], [301]]
    ids, counts = own.encode_pieces(pieces)
    assert [own_ids.tolist() for own_ids in np.split(ids, np.cumsum(counts)[:-1])] == wanted == own.encode_stepwise(pieces)
    # a chain of merges makes (300, b) for a moment, which has to go before the second (b, b)
    own = object.__new__(bpe.ByteBPE)
    own.byte_id = list(range(256))
    own.ranks = {(b, b): (5, 300), (300, b): (1, 301)}
    assert own.encode_pieces(["bbbb", "cbb"])[0].tolist() == [301, b, c, 300] == sum(own.encode_stepwise(["bbbb", "cbb"]), [])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab", max_size=12), max_size=8), st.randoms())
def test_bpe_together_as_stepwise(pieces, rnd):
    """Any order of ranks, also where a token is made by several pairs."""
    own = object.__new__(bpe.ByteBPE)
    own.byte_id = list(range(256))
    tokens = {"a": 97, "b": 98, **{t: 300 + n for n, t in enumerate(["aa", "ab", "ba", "aab", "aba", "abab", "baab"])}}
    pairs = [(x, y) for x in tokens for y in tokens if x + y in tokens]
    rnd.shuffle(pairs)
    own.ranks = {(tokens[x], tokens[y]): (n, tokens[x + y]) for n, (x, y) in enumerate(pairs)}
    ids, counts = own.encode_pieces(pieces)
    assert ids.tolist() == sum(own.encode_stepwise(pieces), []) and counts.tolist() == list(map(len, own.encode_stepwise(pieces)))


# --- token id files -----------------------------------------------------------------------

def wanted_ids(library, rows):
    start, out = 0, []
    for d, t in rows:
        ids = library[WORD].encode(t or "", add_special_tokens=False).ids + [2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_ids_odd_rows(spark, frame, library):
    rows = [r for r in DOCS if r[0] is not None] + [(None, "last", None)]
    path = scratch_path(spark, "ids")
    tokenids.write(frame(rows), path, tokenizer_path(WORD), file_ids=500)
    got = sorted((tuple(r) for r in tokenids.read(spark, path).collect()), key=lambda r: r[1])
    order = sorted((r for r in rows), key=lambda r: (r[0] is None, r[0] or 0))
    assert got == wanted_ids(library, [(d, t) for d, t, _ in order])


def test_token_ids_whole_table(spark, sf, texts, library):
    got = sorted((tuple(r) for r in QUERIES["op7_token_ids"](spark, sf).collect()), key=lambda r: r[1])
    assert got == wanted_ids(library, sorted(texts))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(["'S", "'re", "<|endoftext|>", "<|EndOfText|>", "İ", "ſ", "ẞ", "e\u0301", "\u0301", "\xa0", "\x85", "\x1f", "\xad", " ", "\n", "é", "²", "漢"]),
                          st.text(st.characters(max_codepoint=0x17F), max_size=6)), max_size=20))
def test_token_ids_of_a_text(library, parts):
    """Plain texts are cut here, words of other characters or special tokens by the library."""
    text = "".join(parts).encode("utf-8", "ignore").decode()
    ids = np.frombuffer(tokenids.piece_ids(tokenizer_path(WORD)).ids(text.encode()), "<u2").tolist()
    assert ids == library[WORD].encode(text, add_special_tokens=False).ids


def test_token_ids_memory_starts_anew(library, texts, monkeypatch):
    monkeypatch.setattr(tokenids, "CACHE", 50)
    pieces = tokenids.PieceIds(tokenizer_path(WORD))
    for _, text in list(texts)[:40]:
        text = text or ""
        assert np.frombuffer(pieces.ids(text.encode()), "<u2").tolist() == library[WORD].encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.one_of(
    st.sampled_from(["'s", "'S", "'re", "'ll", "'l", "''m", "'v", "'ve", "d'", "x'd'y", "12", "²½", "ª", "É", " ", "\t\n", "<|EndOfText|>", "e\u0301", "漢", "\x1f", "\xa0", "!?"]),
    st.text(st.characters(max_codepoint=0xFF), max_size=5)), max_size=8), max_size=6))
def test_token_ids_of_many_texts(library, texts):
    """Plain texts are cut and looked up together, with the ids of each alone."""
    texts = ["".join(t).encode("utf-8", "ignore").decode() for t in texts]
    got = tokenids.piece_ids(tokenizer_path(WORD)).of([t.encode() for t in texts])
    assert [ids.tolist() for ids in got] == [library[WORD].encode(t, add_special_tokens=False).ids for t in texts]


def test_token_ids_many_texts_see_a_piece_once(library, texts, monkeypatch):
    """What the library is given for the pieces of many texts, also with a memory that starts anew."""
    texts = [t or "" for _, t in texts][:60]
    wanted = [library[WORD].encode(t, add_special_tokens=False).ids for t in texts]
    given = []
    real = tokenids.PieceIds._encode
    monkeypatch.setattr(tokenids.PieceIds, "_encode", lambda self, pieces: given.extend(pieces.to_pylist()) or real(self, pieces))
    for cache in (tokenids.CACHE, 50):
        monkeypatch.setattr(tokenids, "CACHE", cache)
        pieces, got = tokenids.PieceIds(tokenizer_path(WORD)), []
        for k in range(0, len(texts), 7):
            got += pieces.of([t.encode() for t in texts[k:k + 7]])
        assert [ids.tolist() for ids in got] == wanted
        assert len(given) == len(set(given)) or cache == 50


def test_token_ids_empty_table(spark, docs):
    path = scratch_path(spark, "ids")
    tokenids.write(docs.limit(0), path, tokenizer_path(WORD))
    assert tokenids.read(spark, path).count() == 0


def test_damaged_file():
    content = bytearray(tokenids.pack(0, 0, [1, None], [3, 2], np.array([5, 6, 2, 7, 2])))
    assert tokenids.unpack(bytes(content))[0] == [1, None]
    assert tokenids.unpack(tokenids.pack(0, 0, [4], [0], np.array([], np.uint16)))[0] == [4]
    content[-1] ^= 1
    content[-3] ^= 255
    with pytest.raises(ValueError):
        tokenids.unpack(bytes(content))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 300), st.integers(1, 1 << 16), st.integers(0, 1 << 30))
def test_range_coder_round_trip(lanes, length, top, seed):
    rows = np.random.default_rng(seed).integers(0, top, (lanes, length))
    assert (rangecoder.decode(rangecoder.encode(rows), length) == rows).all()


def test_range_coder_blocks_are_independent_and_learn():
    rows = np.tile(np.random.default_rng(1).integers(0, 50_000, 40), (3, 40))
    coded = rangecoder.encode(rows)
    assert coded[0] == rangecoder.encode(rows[:1])[0] and len(coded[0]) < rows.shape[1] // 2
    assert (rangecoder.decode(coded[1:2], rows.shape[1]) == rows[1]).all()


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 3000), st.integers(1, 1 << 16), st.floats(1, 8), st.integers(0, 1 << 30))
def test_start_round_trip(size, top, skew, seed):
    ids = (top * np.random.default_rng(seed).random(size) ** skew).astype(np.uint16)
    start, ranks = rangecoder.Start.of(ids)
    assert (start.ids[ranks] == ids).all()
    again, at = rangecoder.Start.unpack(b"xy" + start.pack() + b"z", 2)
    assert at == len(start.pack()) + 2
    for field in ("ids", "cls", "freq", "begin", "rank", "counts", "after"):
        assert (getattr(start, field) == getattr(again, field)).all()
    docs, counts, back = tokenids.unpack(tokenids.pack(1, 2, [7], [size], ids, block=100))
    assert (docs, counts.tolist()) == ([7], [size]) and (back == ids).all()


@pytest.mark.parametrize("skew", [1, 3, 9])
def test_coder_takes_the_files_shares(skew):
    """Shares of the file come from its header, and those of a block are taken anew on the way."""
    ids = (5000 * np.random.default_rng(skew).random(3 * 700) ** skew).astype(np.uint16)
    ids[700:] = ids[np.arange(1400) % 90]
    start, ranks = rangecoder.Start.of(ids)
    before = start.chances.copy()
    coded = rangecoder.encode(ranks.reshape(3, 700), start)
    again, _ = rangecoder.Start.unpack(start.pack(), 0)
    assert (again.chances == start.chances).all() and (start.chances != before).any() and 700 > 2 * rangecoder.REFRESH
    assert (rangecoder.decode(coded, 700, again) == ranks.reshape(3, 700)).all()
    assert (rangecoder.decode(coded[2:], 700, again) == ranks[1400:]).all()


def test_start_keeps_the_most_frequent_successor():
    start, _ = rangecoder.Start.of(np.array([8, 9] * 5 + [8, 7] * 9 + [3], np.uint16))
    rank = {int(i): r for r, i in enumerate(start.ids)}
    assert start.after[rank[8]] == rank[7] and start.after[rank[7]] == rank[8] and start.after[rank[3]] == rangecoder.NONE


def test_file_is_smaller_than_zlib(texts):
    """Header, index of documents and blocks of a file against its ids alone under zlib."""
    pieces = tokenids.piece_ids(tokenizer_path(WORD))
    docs = [np.frombuffer(pieces.ids((t or "").encode()), "<u2") for _, t in texts]
    ids = np.concatenate(docs)
    content = tokenids.pack(0, 0, [d for d, _ in texts], [len(d) for d in docs], ids)
    assert len(content) < len(zlib.compress(ids.tobytes(), 6))


def test_damaged_start():
    content = bytearray(tokenids.pack(0, 0, [1], [3], np.array([5, 6, 2])))
    content[tokenids.HEAD_BYTES + 13 + 12] ^= 255
    with pytest.raises(ValueError):
        tokenids.unpack(bytes(content))


# --- WARC -----------------------------------------------------------------------------------

def test_warc(spark):
    rows = [(4, "http://x/é y", "<p>same</p>"), (2, None, "<p>same</p>"), (2, None, "<p>same</p>"), (9, "", "<p>same</p>"), (None, "u", "<p>same</p>"),
            (None, "u", "<p>same</p>"), (None, "u", "of no page"), (None, "u", "of no page"), (5, "u", None), (6, "u", ""), (7, "u", "<p>" + "long é " * 30000), (8, "u", "PK*M\x18\x00\x00\x00\x00\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS refers_to", "'x' AS digest", "0 AS archive")
    for min_bytes in (0, 1):
        path = scratch_path(spark, "warc")
        warc.write(pages, path, min_bytes=min_bytes, archive_bytes=100)
        got = sorted((tuple(r) for r in warc.read(spark, path).collect()), key=str)
        want = []
        for page, _, html in rows:
            raw = (html or "").encode()
            first = min((p for p, _, h in rows if p is not None and (h or "") == (html or "")), default=None)
            again = first is not None and len(raw) >= min_bytes and first != page
            want.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first if again else None))
        assert got == sorted(want, key=str)
    path = scratch_path(spark, "warc")
    warc.write(pages.limit(0), path)
    assert warc.read(spark, path).count() == 0


def test_warc_whole_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    first = {}
    for r in sorted(rows, key=lambda r: r["page_id"]):
        first.setdefault(r["html"] or "", r["page_id"])
    want = {r["page_id"]: (len((r["html"] or "").encode()), first[r["html"] or ""]) for r in rows}
    got = QUERIES["op3_warc"](spark, sf).collect()
    assert {r["page_id"]: (r["payload_bytes"], r["page_id"] if r["refers_to"] is None else r["refers_to"]) for r in got} == want and len(got) == len(rows)


def test_warc_archive_is_plain_zstandard():
    import zstandard

    records = [warc.record(i, "http://x", b"<p>%d</p>" % i * 50, None) for i in range(300)]
    content = warc.archive(records)
    assert content[:4] == bytes.fromhex("5d2a4d18") and list(warc.records_of(content + warc.PADDING.encode())) == records
    size = int.from_bytes(content[4:8], "little")
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content[8:8 + size])).stream_reader(content[8 + size:], read_across_frames=True)
    assert reader.read() == b"".join(records)
    damaged = warc.record(1, None, b"payload", None).replace(b"payload", b"paYload")
    with pytest.raises(ValueError):
        warc.parse(damaged)


# --- exact dedup ------------------------------------------------------------------------------

def test_exact_dedup_odd_rows(docs):
    got = exact.dedup(docs).collect()
    assert len(got) == len(DOCS)
    groups = {}
    for d, t, _ in DOCS:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), d is None, d or 0, d))
    by_sha = {sha(k): (min(v)[3], len(v)) for k, v in groups.items()}
    for r in got:
        assert (r["keep_id"], r["group_size"]) == by_sha[r["text_sha256"]]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert sum(r["kept"] for r in got) == len(groups)
    assert exact.dedup(docs.limit(0)).count() == 0


# --- rules --------------------------------------------------------------------------------------

def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    inside = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_rules_odd_rows(docs):
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    led = rules.ledger(docs).fillna(-1, "doc_id")
    got = sorted((r["doc_id"], *[r[c] for c in columns]) for r in led.collect())
    assert got == sorted((-1 if d is None else d, *plain_measures(t or "")) for d, t, _ in DOCS if True)
    kept = {r["doc_id"] for r in led.where(rules.passes("v2")).collect()}
    assert {5, 3, 9, 17, 18, 2} <= kept and not kept & {7, 8, 11, 12, 15, 16}
    assert rules.ledger(docs.limit(0)).count() == 0


def test_ablation_counts(docs):
    led = rules.ledger(docs)
    for version in rules.POLICIES:
        masks = [r["failures"] & rules.policy_mask(version) for r in led.collect()]
        for r in rules.ablation(led, version).collect():
            bit = 1 << list(rules.RULES).index(r["rule"])
            assert (r["n_failed"], r["n_only"], r["n_kept_without"]) == (
                sum(m & bit > 0 for m in masks), sum(m == bit for m in masks), sum(m & ~bit == 0 for m in masks))


# --- quality ------------------------------------------------------------------------------------

def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op6_quality"](spark, sf)
    rows = got.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert got.count() == 10_000 and len(rows) > 500
    good = [r["score"] for r in rows if r["quality"] == 1]
    bad = [r["score"] for r in rows if r["quality"] == 0]
    pairs = [(g > b) + 0.5 * (g == b) for g in random.Random(1).choices(good, k=2000) for b in bad[:100]]
    assert sum(pairs) / len(pairs) > 0.97
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.95
    assert sum(s >= 0.3 for s in good) / len(good) > 0.98


def test_quality_odd_rows(spark, docs):
    labels = spark.createDataFrame([(5, 1, 0), (5, 1, 0), (3, 0, 0), (3, 1, 0), (None, 1, 0), (15, 0, 0), (16, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(DOCS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert [r["held_out"] for r in got] == [r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in got]
    assert {r["score"] for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_discriminant_is_the_log_density_difference():
    rng = np.random.default_rng(3)
    a, b = rng.normal(0, 1, (500, 2)), rng.normal(3, 2, (500, 2))
    covs = [np.cov(x.T, bias=True) for x in (a, b)]
    factors = [np.linalg.cholesky(c) for c in covs]
    model = quality.Discriminant([a.mean(0), b.mean(0)], [np.linalg.inv(f) for f in factors], [2 * np.log(np.diag(f)).sum() for f in factors])
    x = rng.normal(1, 2, (50, 2))

    def density(x, mean, cov):
        d = x - mean
        return -0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.log(np.linalg.det(cov))

    assert np.allclose(model.difference(x), density(x, b.mean(0), covs[1]) - density(x, a.mean(0), covs[0]))
