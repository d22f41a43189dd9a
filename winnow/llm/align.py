"""Alignment of two tokenizers over a corpus, by inverted bitmaps of linked id pairs."""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .bpe import byte_letters
from .common import arrow_map, narrow, written

# Documents, and characters, after which a container of bitmaps is closed.
CONTAINER_DOCS, CONTAINER_CHARS = 4096, 6_000_000
# Distinct segments, and their characters, that a worker remembers before it starts anew.
CACHE, CACHE_CHARS = 400_000, 8_000_000
# Bits of the second id in the number of a pair.
B_BITS = 20
# Bytes of a bitmap; a list of 16-bit places is kept where it is shorter.
BITMAP = CONTAINER_DOCS // 8
PRESENCE = -1

# A segment ends where something other than white space stands before a space or a line end. Neither tokenizer has
# a token across that place: the first cuts there, the second has no piece with a space after another character or with
# a line end (looked up when its vocabulary is loaded).
SEGMENTS = re.compile(r"\s*\S+(?:[^\S \n]\s*\S*)*|\s+")


class Encoders:
    """Both tokenizers and the bytes of their ids."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in enumerate(byte_letters())}
        vocab = spec["model"]["vocab"]
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            if all(c in back for c in token):
                self.bytes_a[i] = bytes(back[c] for c in token)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if len(pieces) > 1 << B_BITS:
            raise ValueError("ids of the second tokenizer must be below 2 ** 20")
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a = np.fromiter(map(len, self.bytes_a), np.int64, len(self.bytes_a))
        self.size_b = np.fromiter(map(len, self.bytes_b), np.int64, len(self.bytes_b))
        # a byte-level cut in the standard way, and no piece across the place where segments end
        cut = spec.get("pre_tokenizer") or {}
        self.cuts = (
            cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not spec.get("normalizer")
            and not any("\n" in p or "▁" in p.lstrip("▁") for p in pieces))
        self.lead = self.b.piece_to_id("▁")

    def segments(self, text: str) -> list[str]:
        """Of a space and the text."""
        return SEGMENTS.findall(" " + text) if self.cuts else [" " + text]

    def encode(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        # the second tokenizer puts the space before a text itself; before a line end it is one piece of its own
        b = self.b.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)
        return a, [ids if s[0] == " " else ids[1:] if ids[:1] == [self.lead] else [] for s, ids in zip(segments, b)]


@lru_cache(maxsize=1)
def encoders(path_a: str, path_b: str) -> Encoders:
    return Encoders(path_a, path_b)


def _spread(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, .. n[0] numbers, then those of begin[1], .."""
    upto = np.cumsum(n)
    return np.repeat(begin - upto + n, n) + np.arange(upto[-1] if len(upto) else 0)


class Aligned:
    """Segments one after the other: counts, groups as text, and links as numbers of pairs."""

    def __init__(self, own: Encoders, segments: list[str]):
        ids_a, ids_b = own.encode(segments)
        raw = [s.encode() for s in segments]
        self.ok = np.fromiter((
            b"".join(map(own.bytes_a.__getitem__, a)) == r == b"".join(map(own.bytes_b.__getitem__, b)) for a, b, r in zip(ids_a, ids_b, raw)), bool, len(raw))
        good = self.ok.tolist()
        ids_a, ids_b = ([ids if ok else [] for ids, ok in zip(x, good)] for x in (ids_a, ids_b))
        self.n_a = np.fromiter(map(len, ids_a), np.int64, len(raw))
        self.n_b = np.fromiter(map(len, ids_b), np.int64, len(raw))
        flat_a = np.array([i for ids in ids_a for i in ids], np.int64)
        flat_b = np.array([i for ids in ids_b for i in ids], np.int64)
        end_a, end_b = np.cumsum(own.size_a[flat_a]), np.cumsum(own.size_b[flat_b])
        # between two neighbouring ends, of whichever tokenizer, exactly one token of each lies over the bytes: a link
        ends = np.union1d(end_a, end_b)
        self.links = flat_a[np.searchsorted(end_a, ends)] << B_BITS | flat_b[np.searchsorted(end_b, ends)]
        segment_ends = np.cumsum([len(r) if ok else 0 for r, ok in zip(raw, good)])
        self.n_links = np.diff(np.searchsorted(ends, segment_ends, "right"), prepend=0)
        groups = np.intersect1d(end_a, end_b)
        to_a = np.searchsorted(end_a, groups, "right").tolist()
        to_b = np.searchsorted(end_b, groups, "right").tolist()
        text_a, text_b = list(map(str, flat_a.tolist())), list(map(str, flat_b.tolist()))
        spelled, i, k = [], 0, 0
        for j, m in zip(to_a, to_b):
            spelled.append((text_a[i] if j - i == 1 else ",".join(text_a[i:j])) + "|" + (text_b[k] if m - k == 1 else ",".join(text_b[k:m])))
            i, k = j, m
        upto = np.searchsorted(groups, segment_ends, "right")
        self.n_groups = np.diff(upto, prepend=0)
        upto = upto.tolist()
        self.groups = [";".join(spelled[s:e]) for s, e in zip([0, *upto], upto)]


class Segments(dict):
    """segment -> its number; what Aligned tells of all numbered ones stands in arrays."""

    COUNTS = ("n_a", "n_b", "n_groups", "n_links")

    def __init__(self, own: Encoders):
        self.own = own
        self.restart()

    def __missing__(self, segment: str) -> int:
        n = self[segment] = len(self)
        self.new.append(segment)
        return n

    def restart(self) -> None:
        self.clear()
        self.chars = 0
        self.new: list[str] = []
        self.groups: list[str] = []
        self.ok = np.empty(0, bool)
        self.links = np.empty(0, np.int64)
        self.counts = np.empty((0, len(self.COUNTS)), np.int64)
        self.links_from = np.empty(0, np.int64)

    def numbers(self, segments: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, segments), np.int64, len(segments))

    def learn(self) -> None:
        for k in range(0, len(self.new), 50_000):
            self._add(Aligned(self.own, self.new[k:k + 50_000]))
        self.chars += sum(map(len, self.new))
        self.new = []

    def _add(self, found: Aligned) -> None:
        begin = len(self.links) + np.cumsum(found.n_links) - found.n_links
        self.groups += found.groups
        self.ok = np.concatenate([self.ok, found.ok])
        self.links = np.concatenate([self.links, found.links])
        self.links_from = np.concatenate([self.links_from, begin])
        self.counts = np.concatenate([self.counts, np.stack([getattr(found, c) for c in self.COUNTS], axis=1)])

    def full(self) -> bool:
        return len(self) > CACHE or self.chars > CACHE_CHARS


@lru_cache(maxsize=1)
def known_segments(path_a: str, path_b: str) -> Segments:
    """Kept by a worker from task to task."""
    return Segments(encoders(path_a, path_b))


def _bitmaps(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Pairs, the number of documents of each, and these as a list of places or a bitmap, from ascending keys."""
    pair, doc = key // CONTAINER_DOCS, (key % CONTAINER_DOCS).astype("<u2")
    first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    n = np.diff([*first.tolist(), len(pair)])
    listed = 2 * n < BITMAP
    sizes = np.where(listed, 2 * n, BITMAP)
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]), np.uint8)
    out[_spread((ends - sizes)[listed], sizes[listed])] = doc[np.repeat(listed, n)].view(np.uint8)
    for i in np.flatnonzero(~listed).tolist():
        bits = np.zeros(CONTAINER_DOCS, np.uint8)
        bits[doc[first[i]:first[i] + n[i]]] = 1
        out[ends[i] - BITMAP:ends[i]] = np.packbits(bits)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pair[first], n, pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())])


def places(bitmap: bytes) -> np.ndarray:
    if len(bitmap) == BITMAP:
        return np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8)))
    return np.frombuffer(bitmap, "<u2").astype(np.int64)


def planes(pair: np.ndarray, doc: np.ndarray, times: np.ndarray):
    """Inverts the links of a container: per pair a bitmap of the documents that have it, and a plane for each binary digit of
    times - 1. Yields the plane, and pairs, numbers of documents and compressed bitmaps."""
    if not len(pair):
        return
    key = pair * CONTAINER_DOCS + doc
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    key, more = key[begins], np.add.reduceat(times, begins) - 1
    yield PRESENCE, *_bitmaps(key)
    plane = 0
    while len(key):
        digit = (more >> plane & 1).astype(bool)
        if digit.any():
            yield plane, *_bitmaps(key[digit])
        plane += 1
        on = more >> plane > 0
        key, more = key[on], more[on]


DOCUMENT = "container long, place long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
POSTING = "pair long, plane int, n long, docs binary"


def _invert(path_a: str, path_b: str, kinds: pa.Schema):
    def run(batches):
        known = known_segments(path_a, path_b)
        if known.new:  # left by a task that failed
            known.restart()
        begin, number = TaskContext.get().partitionId() << 32, 0
        held, chars = [], 0  # documents of the container: id, numbers of its segments or None, text

        def batch(columns: dict) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in kinds], schema=kinds)

        def closed():
            known.learn()
            container = begin + number
            rows: dict[str, list] = {f: [] for f in ("container", "place", "doc_id", *Segments.COUNTS, "groups_sha256")}
            pairs, docs, times = [], [], []
            for place, (doc, numbers, text) in enumerate(held):
                counts, sha = [0] * len(Segments.COUNTS), ""
                if len(numbers) and known.ok[numbers].all():
                    counts = known.counts[numbers].sum(axis=0).tolist()
                    sha = hashlib.sha256(";".join(map(known.groups.__getitem__, numbers.tolist())).encode()).hexdigest()
                    own, n = np.unique(numbers, return_counts=True)
                    links = known.counts[own, 3]
                    pairs.append(known.links[_spread(known.links_from[own], links)])
                    times.append(np.repeat(n, links))
                elif len(numbers):
                    whole = Aligned(known.own, [" " + text])  # bytes may differ in parts and yet agree over all
                    if whole.ok[0]:
                        counts = [int(getattr(whole, c)[0]) for c in Segments.COUNTS]
                        sha = hashlib.sha256(whole.groups[0].encode()).hexdigest()
                        own, n = np.unique(whole.links, return_counts=True)
                        pairs.append(own)
                        times.append(n)
                if counts[0]:
                    docs.append(np.full(len(pairs[-1]), place))
                for f, v in zip(rows, (container, place, doc, *counts, sha)):
                    rows[f].append(v)
            yield batch({"kind": [0] * len(held)} | rows)
            if pairs:
                for plane, pair, n, bitmaps in planes(np.concatenate(pairs), np.concatenate(docs), np.concatenate(times)):
                    size = len(pair)
                    yield batch({"kind": np.ones(size, np.int32), "container": np.full(size, container), "pair": pair, "plane": np.full(size, plane, np.int32), "n": n, "docs": bitmaps})
            if known.full():
                known.restart()

        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                held.append((doc, known.numbers(known.own.segments(text) if text else []), text))
                chars += len(text or "")
                if len(held) >= CONTAINER_DOCS or chars >= CONTAINER_CHARS:
                    yield from closed()
                    held, chars, number = [], 0, number + 1
        if held:
            yield from closed()

    return run


SCORE = pa.schema([(c, pa.int64()) for c in ("container", "place", "n_best", "count_sum")])


def _scores(postings: pa.Table, counts: pa.Table) -> pa.Table:
    """What the bitmaps of a container return to its documents: how many links the pairs that they have are counted with."""
    known = counts.column("linked").to_numpy()
    order = np.argsort(known)
    own = order[np.searchsorted(known, postings.column("pair").to_numpy(), sorter=order)]
    weight = np.left_shift(1, np.maximum(postings.column("plane").to_numpy().astype(np.int64), 0))
    best = counts.column("best").to_numpy()[own] * weight
    links = counts.column("links").to_numpy()[own] * weight
    listed = [places(x) for x in postings.column("docs").to_pylist()]
    at, n = np.concatenate(listed), list(map(len, listed))
    sums = np.zeros((2, CONTAINER_DOCS), np.int64)
    np.add.at(sums[0], at, np.repeat(best, n))
    np.add.at(sums[1], at, np.repeat(links, n))
    place = np.flatnonzero(sums[1])
    container = np.full(len(place), postings.column("container")[0].as_py())
    return pa.table([container, place, *sums[:, place]], schema=SCORE)


def invert(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents (container, place, doc_id, counts, groups_sha256) and postings (container, pair, plane, n, docs): the compressed
    bitmap of the documents of a container that have the pair of ids (plane -1), and planes of the binary digits of how
    often they have it, less one. Both are written once, as a container's places must not change."""
    rows = narrow(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"kind int, doc_id {kind}, {DOCUMENT}, {POSTING}"
    as_arrow = pa.schema([
        *[pa.field(n, t) for n, t in (("kind", pa.int32()), ("doc_id", _arrow_type(rows)), ("container", pa.int64()), ("place", pa.int64()))],
        *[pa.field(c, pa.int64()) for c in Segments.COUNTS], pa.field("groups_sha256", pa.string()),
        pa.field("pair", pa.int64()), pa.field("plane", pa.int32()), pa.field("n", pa.int64()), pa.field("docs", pa.binary())])
    table = written(arrow_map(rows, _invert(path_a, path_b, as_arrow), schema), "inverted", ["kind"])
    return (table.where("kind = 0").select("container", "place", "doc_id", *Segments.COUNTS, "groups_sha256"),
            table.where("kind = 1").select("container", "pair", "plane", "n", "docs"))


def _arrow_type(rows: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema["doc_id"].dataType)


def pair_counts(postings: DataFrame) -> DataFrame:
    """a, b, n_docs, links of every linked pair of ids, and best: 1 if no other pair of its second id has more links. Popcounts of the
    bitmaps are added up; those of one pair cover different documents. Reads no bitmap."""
    weight = F.when(F.col("plane") < 0, 1).otherwise(F.expr("shiftleft(1L, plane)"))
    counts = postings.groupBy("pair").agg(
        F.sum(F.when(F.col("plane") < 0, F.col("n")).otherwise(0)).alias("n_docs"), F.sum(F.col("n") * weight).alias("links"))
    counts = written(counts.select("pair", F.shiftright("pair", B_BITS).alias("a"), F.col("pair").bitwiseAND((1 << B_BITS) - 1).alias("b"), "n_docs", "links"), "pairs")
    most = counts.groupBy("b").agg(F.max("links").alias("most"))
    return counts.join(most, "b").select("pair", "a", "b", "n_docs", "links", (F.col("links") == F.col("most")).cast("long").alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of `docs`.

    A space and the text are encoded by the byte-level tokenizer at `path_a` and, the text alone, by the piece tokenizer at
    `path_b`, which adds the space; special tokens in a text are plain text. Tokens whose bytes overlap are linked, places
    where tokens of both end cut them into groups. count_sum adds up, over the links of a document, how many links of the corpus
    have the same ids, n_best counts the links than which no other pair of their second id has more, ties included.

    Null and empty texts, and texts that the tokens of one side do not spell byte for byte, have no tokens: zeros and ''.
    Null and repeated doc_ids are rows like any other; every row counts. No rows give no rows. Long texts are whole."""
    documents, postings = invert(docs, path_a, path_b, id_col, text_col)
    counts = pair_counts(postings).select("pair", "links", "best")
    # only numbers meet by pair; the bitmaps move once, to the counts of their own container, which is of bounded size
    pairs = postings.where(F.col("plane") == PRESENCE).select(F.col("container").alias("home"), F.col("pair").alias("linked"))
    counted = pairs.join(counts.hint("merge"), pairs["linked"] == counts["pair"]).select("home", "linked", "links", "best")
    scores = postings.select("container", "pair", "plane", "docs").groupBy("container").cogroup(counted.groupBy("home")).applyInArrow(
        _scores, "container long, place long, n_best long, count_sum long")
    return documents.join(scores, ["container", "place"], "left").select(
        "doc_id", *Segments.COUNTS, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")], "groups_sha256")
