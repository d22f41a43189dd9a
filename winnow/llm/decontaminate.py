"""Benchmark passages in documents: Wu-Manber search for many strings at once."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import arrow_map, byte_texts, narrow, null_safe, running, written

# Consecutive words of an item that make a window.
WINDOW = 10
# Bytes of items whose windows are searched for, and broadcast, together.
SHARD_BYTES = 4_000_000
# Bytes after which a long item is cut; the parts share window - 1 words.
PART_BYTES = 250_000
# Longest block, in bytes, that the shift tables look at, and the size of these tables.
BLOCK, TABLE_BITS = 16, 20
# Positions of a text that one lane walks through; all lanes of a batch jump together.
LANE = 2048
# Candidates compared at once.
PAIRS = 500_000

# Everything but 0-9, A-Z, a-z and what stands above ASCII ends a word; A-Z become a-z.
_LETTERS = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_PAD = b" " * BLOCK


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_LETTERS).split()


def padded(words: list[bytes]) -> bytes:
    """Words with a space before, between and after them: a window's string stands in it exactly where its words do."""
    return b" " + b" ".join(words) + b" " if words else b""


class Buffer:
    """Bytes that can be read eight at a time from any place."""

    def __init__(self, raw: bytes):
        self.raw = np.frombuffer(_PAD + raw + _PAD, np.uint8)
        self.begin, self.end = len(_PAD), len(_PAD) + len(raw)
        self.eight = np.ndarray((len(self.raw) - 7,), "<u8", self.raw, strides=(1,))


class Tables:
    """Shift table and buckets for strings of similar length.

    A window as long as the shortest string slides over the text. Its last block tells how far it may move without
    passing the start of a string; where it may not, the block's bucket has the strings to compare."""

    def __init__(self, strings: list[bytes], numbers: np.ndarray):
        sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        self.least = int(sizes.min())
        self.block = min(BLOCK, max(2, self.least // 2))
        self.text = Buffer(b"".join(strings))
        begins = np.cumsum(sizes) - sizes + self.text.begin
        self.shift = np.full(1 << TABLE_BITS, self.least - self.block + 1, np.int64)
        for end in range(self.block, self.least + 1):
            np.minimum.at(self.shift, self.slot(self.hashes(self.text, begins + end)), self.least - end)
        keys = self.hashes(self.text, begins + self.least)
        order = np.argsort(keys, kind="stable")
        self.keys, self.sizes, self.begins, self.numbers = keys[order], sizes[order], begins[order], numbers[order]

    def hashes(self, text: Buffer, ends: np.ndarray) -> np.ndarray:
        """Of the blocks that end before each place."""
        h = text.eight[ends - 8] >> np.uint64(8 * max(0, 8 - self.block))
        h = h * np.uint64(0x9E3779B97F4A7C15)
        if self.block > 8:
            h ^= (text.eight[ends - 16] >> np.uint64(8 * (16 - self.block))) * np.uint64(0xC2B2AE3D27D4EB4F)
        return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)

    @staticmethod
    def slot(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def search(self, text: Buffer) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of every occurrence."""
        at = np.arange(text.begin + self.least, text.end + 1, LANE)
        stop = np.minimum(at + LANE, text.end + 1)
        places, numbers = [], []
        while len(at):
            hashes = self.hashes(text, at)
            jump = self.shift[self.slot(hashes)]
            here = np.flatnonzero(jump == 0)
            if len(here):
                self._compare(text, at[here] - self.least, hashes[here], places, numbers)
            at = at + np.maximum(jump, 1)
            alive = at < stop
            if not alive.all():
                at, stop = at[alive], stop[alive]
        none = np.empty(0, np.int64)
        return np.concatenate([none, *places]), np.concatenate([none, *numbers])

    def _compare(self, text: Buffer, begins: np.ndarray, hashes: np.ndarray, places: list, numbers: list) -> None:
        """Every candidate with every string of its bucket, byte for byte."""
        first = np.searchsorted(self.keys, hashes)
        n = np.searchsorted(self.keys, hashes, "right") - first
        upto = np.cumsum(n)
        for k in range(0, int(upto[-1]), PAIRS):
            pair = np.arange(k, min(k + PAIRS, int(upto[-1])))
            i = np.searchsorted(upto, pair, "right")
            at, own = begins[i], first[i] + pair - (upto[i] - n[i])
            done = 0
            while len(at):
                left = self.sizes[own] - done
                room = at + done + 8 <= len(text.raw)  # a longer string than the rest of the text
                at, own, left = at[room], own[room], left[room]
                differ = (text.eight[at + done] ^ self.text.eight[self.begins[own] + done]) & _MASKS[np.minimum(left, 8)]
                same = differ == 0
                ended = same & (left <= 8)
                places.append(at[ended])
                numbers.append(self.numbers[own[ended]])
                on = same & (left > 8)
                at, own, done = at[on], own[on], done + 8


class Windows:
    """The distinct windows of some items, and the search for them."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        numbers: dict[bytes, int] = {}
        holders: list[tuple[int, int]] = []
        self.ids: list[str] = []
        known: dict[str, int] = {}
        for item, raw in items:
            words = raw.split()
            if not words:
                continue
            k = min(window, len(words))
            ends = np.cumsum([1, *(len(w) + 1 for w in words)]).tolist()
            own = {numbers.setdefault(raw[ends[i] - 1:ends[i + k]], len(numbers)) for i in range(len(words) - k + 1)}
            if item is not None:
                if item not in known:
                    known[item] = len(known)
                    self.ids.append(item)
                holders += [(n, known[item]) for n in own]
        strings = list(numbers)
        self.words = np.fromiter((s.count(b" ") - 1 for s in strings), np.int64, len(strings))
        pairs = np.array(sorted(set(holders)), np.int64).reshape(-1, 2)
        self.items = pairs[:, 1]
        self.items_from = np.searchsorted(pairs[:, 0], np.arange(len(strings) + 1))
        # one set of tables per length class, so that a short string does not shorten the jumps for the rest
        sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        classes = np.minimum(np.log2(np.maximum(sizes, 1)).astype(np.int64), 5)
        self.tables = [Tables([strings[i] for i in own.tolist()], own) for c in range(6) if len(own := np.flatnonzero(classes == c))]

    def find(self, texts: list[bytes]):
        """Per text: begins and ends of runs of hit words, and the items; as flat arrays with the text of each."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        text = Buffer(b"".join(texts))
        found = [t.search(text) for t in self.tables]
        none = np.empty(0, np.int64)
        at = np.concatenate([none, *(f[0] for f in found)])
        number = np.concatenate([none, *(f[1] for f in found)])
        if not len(at):
            return (none,) * 5
        begins = np.cumsum(sizes) - sizes + text.begin
        spaces = np.flatnonzero(text.raw[:text.end] == 0x20)
        first = np.searchsorted(spaces, begins)  # the space before each text's first word
        word = np.searchsorted(spaces, at)
        doc = np.searchsorted(begins, at, "right") - 1
        # covered words: one more where a window begins, one less where it ends
        edges = np.zeros(len(spaces) + 1, np.int64)
        np.add.at(edges, word, 1)
        np.add.at(edges, word + self.words[number], -1)
        hit = np.concatenate([[False], np.cumsum(edges) > 0, [False]])
        run_from = np.flatnonzero(~hit[:-1] & hit[1:])
        run_to = np.flatnonzero(hit[:-1] & ~hit[1:])
        owner = np.searchsorted(first, run_from, "right") - 1
        pairs = np.unique(doc * len(self.words) + number)
        doc, number = pairs // len(self.words), pairs % len(self.words)
        n = self.items_from[number + 1] - self.items_from[number]
        upto = np.cumsum(n)
        item = self.items[np.repeat(self.items_from[number] - upto + n, n) + np.arange(upto[-1])]
        held = np.unique(np.repeat(doc, n) * max(1, len(self.ids)) + item)
        return owner, run_from - first[owner], run_to - first[owner], held // max(1, len(self.ids)), held % max(1, len(self.ids))


_BUILT: dict[str, Windows] = {}


def _windows(token: str, items, window: int) -> Windows:
    """Kept by a worker from task to task, one shard at a time."""
    if token not in _BUILT:
        _BUILT.clear()
        _BUILT[token] = Windows(items.value, window)
    return _BUILT[token]


SPANS = "array<struct<begin:long,end:long>>"
_SPAN_LIST = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def _lists(owner: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), values)


def _search(token: str, items, window: int):
    def run(batches):
        windows = _windows(token, items, window)
        ids = np.array([*windows.ids, ""], object)
        for b in batches:
            texts, counts = [], []
            for raw in byte_texts(b.column("text")):
                words = words_of(raw)
                texts.append(padded(words))
                counts.append(len(words))
            owner, begins, ends, holder, held = windows.find(texts)
            n = len(texts)
            spans = pa.StructArray.from_arrays([pa.array(begins), pa.array(ends)], ["begin", "end"])
            keep = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in keep], pa.array(counts, pa.int64()), _lists(owner, n, spans).cast(_SPAN_LIST),
                 _lists(holder, n, pa.array(ids[held].tolist(), pa.string()))],
                names=[*keep, "n_words", "spans", "items"])

    return run


def _parts(window: int):
    def run(batches):
        for b in batches:
            items, parts = [], []
            for item, raw in zip(b.column("item").to_pylist(), byte_texts(b.column("text"))):
                words, first, size = words_of(raw), 0, 0
                for i, w in enumerate(words):
                    size += len(w) + 1
                    if size >= PART_BYTES and i + 1 < len(words) and i + 1 - first >= window:
                        items.append(item)
                        parts.append(padded(words[first:i + 1]))
                        first = i + 2 - window
                        size = sum(map(len, words[first:i + 1])) + window
                if words:
                    items.append(item)
                    parts.append(padded(words[first:]))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(parts, pa.binary())], names=["item", "part"])

    return run


def _joined_spans(batches):
    """Runs that meet or overlap become one, repeated items one."""
    for b in batches:
        out, items = [], []
        for spans, own in zip(b.column("spans").to_pylist(), b.column("items").to_pylist()):
            runs: list[dict] = []
            for s in sorted((x["begin"], x["end"]) for x in spans):
                if runs and s[0] <= runs[-1]["end"]:
                    runs[-1]["end"] = max(runs[-1]["end"], s[1])
                else:
                    runs.append({"begin": s[0], "end": s[1]})
            out.append(runs)
            items.append(sorted(set(own)))
        yield pa.RecordBatch.from_arrays(
            [b.column("k1"), b.column("k2"), pa.array(out, _SPAN_LIST), pa.array(items, pa.list_(pa.string()))], names=["k1", "k2", "spans", "items"])


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES,
         id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, spans, items for every row of `docs`.

    spans are the runs [begin, end) of words covered by a window of an item, items the distinct ids, as strings, of the
    items with such a window. A window is `window` consecutive words of an item, or a whole shorter item with at least
    one word. Null texts have no words. An item's rows under one id count together; windows of a row without id hit words,
    but name no item. Null and repeated doc_ids are rows like any other. Without items nothing is hit.

    Items are searched for in shards of at most `shard_bytes` (and one part of an item); only one shard at a time is
    on the driver and broadcast. One shard, the usual case, takes one pass over the documents without a shuffle. With more, the hits of each pass
    are kept by a hash of the text and joined back."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = narrow(docs, doc_id=id_col, text=text_col)
    items = narrow(benchmark, item=item_col, text=item_text_col).withColumn("item", F.col("item").cast("string"))
    parts = written(arrow_map(items, _parts(window), "item string, part binary"), "items")
    size = parts.agg(F.coalesce(F.sum(F.octet_length("part")), F.lit(0))).first()[0]

    def searched(shard: DataFrame, over: DataFrame, keys: str) -> DataFrame:
        held = spark.sparkContext.broadcast([(r["item"], bytes(r["part"])) for r in shard.collect()])
        return arrow_map(over, _search(uuid.uuid4().hex, held, window), f"{keys}, n_words long, spans {SPANS}, items array<string>")

    if size <= shard_bytes:
        return searched(parts.select("item", "part"), rows, f"doc_id {kind}")
    order = [F.col("item").asc_nulls_last(), F.xxhash64("part").asc()]
    shards = written(running(parts, order, F.octet_length("part")).withColumn("shard", F.expr(f"before div {shard_bytes}")).drop("before"), "shards")
    keyed = rows.withColumns({"k1": F.xxhash64(F.coalesce("text", F.lit(""))), "k2": F.xxhash64(F.lit(1), F.coalesce("text", F.lit("")))})
    hits, counts = None, None
    for number in range(shards.agg(F.max("shard")).first()[0] + 1):
        found = searched(shards.where(F.col("shard") == number).select("item", "part"), keyed, f"doc_id {kind}, k1 long, k2 long")
        if counts is None:
            found = counts = written(found, "hits")
        part = written(found.where("size(spans) > 0").groupBy("k1", "k2").agg(F.first("spans").alias("spans"), F.first("items").alias("items")), "hits")
        hits = part if hits is None else hits.unionByName(part)
    # a text has at most one row for each shard
    hits = hits.groupBy("k1", "k2").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    hits = arrow_map(hits, _joined_spans, f"k1 long, k2 long, spans {SPANS}, items array<string>")
    return counts.select("doc_id", "n_words", "k1", "k2").join(hits, ["k1", "k2"], "left").select(
        "doc_id", "n_words", F.coalesce("spans", F.expr(f"cast(array() as {SPANS})")).alias("spans"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated from the rows of find()."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of `docs` whose id no row of find() shows as hit; ids are taken as a document's name here."""
    hit = found.where("size(spans) > 0").select(F.col("doc_id").alias("_hit")).distinct()
    return docs.join(hit, null_safe(docs, hit, {id_col: "_hit"}), "left_anti")
