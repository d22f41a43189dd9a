"""Token id files: documents' ids in coded, checksummed blocks."""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import rangecoder
from .common import arrow_map, byte_texts, narrow

# Ids after which a file is closed.
FILE_IDS = 8_000_000
END_ID = 2
# Distinct pieces, and their characters, that a worker remembers before it starts anew.
CACHE, CACHE_CHARS = 400_000, 8_000_000
# Bytes of texts that are cut at once.
GROUP_BYTES = 8_000_000
MAGIC = b"WIDS0003"
# magic, part, number in the part, documents, ids, blocks, ids per block, checksum of the index
HEAD = "<8sIIIQIII"
HEAD_BYTES = struct.calcsize(HEAD)
# ids, bytes, crc32 of the ids as little-endian 32 bit, crc32 of the bytes
BLOCK_HEAD = "<IIII"
BLOCK_HEAD_BYTES = struct.calcsize(BLOCK_HEAD)
# What the text sink puts after a file; readers go by the lengths.
LINE_END = "\n"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    if tokenizer.get_vocab_size() > 1 << 16:
        raise ValueError("the file format holds ids below 65536")
    return tokenizer


# Characters of texts that are cut here, Latin-1 without other white space and controls.
# Normal form C leaves them as they are, lower case is a matter of single characters, and each is one byte of Latin-1.
PLAIN = "".join(map(chr, [*range(0x09, 0x0E), *range(0x20, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]))
# The cut that arrays can do, and the classes of plain characters that it knows.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WHITE, LETTER, NUMBER, OTHER = range(4)
KIND = np.array([WHITE if chr(b).isspace() else {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(b))[0], OTHER) for b in range(256)], np.uint8)
# The characters that a byte-level vocabulary writes bytes of UTF-8 with; spaces stay between pieces.
SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_LEVEL = {b: chr(b) for b in [0x20, *SHOWN]} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in SHOWN) if b != 0x20}
# Of plain texts in Latin-1: their characters, and lower case.
PLAIN_BYTES, LOWER = PLAIN.encode("latin-1"), bytes(ord(c) if len(c := chr(b).lower()) == 1 and ord(c) < 256 else b for b in range(256))


def _pieces(data: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Pieces by SPLIT of plain lower-case texts in Latin-1, with white space between texts; where each starts."""
    kind = KIND[data]
    starts = kind == NUMBER
    starts[:1] = True
    starts[1:] |= kind[1:] != kind[:-1]
    # an apostrophe that starts a piece takes some letters along, and what follows them is a new one
    quotes = np.flatnonzero((data == ord("'")) & starts)
    padded = np.append(data, np.full(3, ord(" "), np.uint8))
    after, last = padded[quotes + 1], padded[quotes + 2]
    two = ((after == ord("r")) | (after == ord("v"))) & (last == ord("e")) | (after == ord("l")) & (last == ord("l"))
    one = np.isin(after, np.frombuffer(b"stmd", np.uint8))
    starts[quotes[one | two] + 1] = False
    for ends in (quotes[one] + 2, quotes[two] + 3):
        starts[ends[ends < len(starts)]] = True
    dark = kind != WHITE
    starts &= dark
    values = data[dark]
    offsets = np.append(np.flatnonzero(starts[dark]), len(values)).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])
    return pieces, np.flatnonzero(starts)


@lru_cache(maxsize=2)
def _cut(path: str):
    """The tokenizer's own cut of a plain text in lower case, its special tokens, which ids end
    a piece, and whether the cut is SPLIT. None for a tokenizer that normalises or cuts in any other way."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    normal = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
    cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    if normal != ["NFC", "Replace", "Lowercase"] or [c["type"] for c in cuts] != ["Split", "ByteLevel"]:
        return None
    white = spec["normalizer"]["normalizers"][1]
    split, level = cuts
    if white["pattern"] != {"Regex": r"\s+"} or white["content"] != " " or (split["behavior"], split["invert"]) != ("Removed", True):
        return None
    suffix = spec["model"].get("end_of_word_suffix")
    if level["use_regex"] or level["add_prefix_space"] or not suffix:
        return None
    # classes of plain characters spelled out, which the standard patterns can do
    pattern = split["pattern"].get("Regex", r"\p")
    for kind in "LN":
        pattern = pattern.replace(rf"\p{{{kind}}}", re.escape("".join(c for c in PLAIN if unicodedata.category(c)[0] == kind)))
    if r"\p" in pattern or r"\P" in pattern:
        return None
    last = np.zeros(1 << 16, bool)
    last[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True
    return re.compile(pattern).findall, [t["content"].lower() for t in spec["added_tokens"]], last, split["pattern"].get("Regex") == SPLIT


class PieceIds(dict):
    """piece -> its ids as little-endian 16 bit, so that the tokenizer sees a piece once. A word with
    other than plain characters or a special token is one piece. Exact for tokenizers that cut at
    white space and drop it: no piece and no normalisation reaches across."""

    strange = staticmethod(re.compile("[^" + re.escape(PLAIN) + "]").search)

    def __init__(self, path: str):
        self.tokenizer, self.size = _tokenizer(path), 0
        self.findall, self.special, self.last, self.arrays = _cut(path) or (None, [], None, False)
        self.known, self.first, self.length, self.flat = pa.array([], pa.binary()), *(np.zeros(0, t) for t in (np.int64, np.int64, "<u2"))
        self.marks = [t.encode("latin-1") for t in self.special if max(t) < "\u0100"]
        if self.arrays:
            # for pieces alone: nothing to normalise, and no other cut than at spaces
            from tokenizers import Tokenizer, pre_tokenizers

            self.bare = Tokenizer(self.tokenizer.model)
            self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()

    def _plain(self, text: str, low: str) -> bool:
        return self.findall is not None and not self.strange(text) and not any(t in low for t in self.special)

    def ids(self, raw: bytes) -> bytes:
        """Of a whole text."""
        text = raw.decode()
        low = text.lower()
        whole: set[str] = set()
        if self._plain(text, low):
            pieces = self.findall(low)
        else:
            pieces = []
            for word in map(bytes.decode, raw.split()):
                low = word.lower()
                if self._plain(word, low):
                    pieces += self.findall(low)
                else:
                    pieces.append(word)
                    whole.add(word)
        try:
            return b"".join(map(self.__getitem__, pieces))
        except KeyError:
            self._learn(set(pieces), whole)
            return b"".join(map(self.__getitem__, pieces))

    def _low(self, raw: bytes) -> bytes | None:
        """A plain text in lower case, in Latin-1; None for any other."""
        try:
            text = raw.decode().encode("latin-1")
        except UnicodeEncodeError:
            return None
        low = text.translate(LOWER)
        return None if text.translate(None, PLAIN_BYTES) or any(t in low for t in self.marks) else low

    def of(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each of many texts; plain ones are cut, and their pieces looked up, together."""
        out: list[np.ndarray] = [np.zeros(0, "<u2")] * len(texts)
        plain, cut = [], []
        for k, raw in enumerate(texts):
            low = self._low(raw) if self.arrays else None
            if low is None:
                out[k] = np.frombuffer(self.ids(raw), "<u2")
            else:
                plain.append(k)
                cut.append(low)
        if plain:
            pieces, starts = _pieces(np.frombuffer(b" ".join(cut), np.uint8))
            ids, before = self._spell(pieces)
            # the ids of a text go from its first piece to the next text's
            begins = np.cumsum([0, *(len(c) + 1 for c in cut)])
            ends = before[np.searchsorted(starts, begins)]
            for k, a, b in zip(plain, ends[:-1].tolist(), ends[1:].tolist()):
                out[k] = ids[a:b]
        return out

    def _spell(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces, and how many stand before each piece and at the end."""
        coded = pieces.dictionary_encode()
        own = coded.dictionary
        place = pc.index_in(own, value_set=self.known)
        if place.null_count:
            new, missing = own.filter(place.is_null()), place.is_null().to_numpy(zero_copy_only=False)
            places = place.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            if len(self.known) + len(new) > CACHE or self.known.nbytes + new.nbytes > CACHE_CHARS + 4 * CACHE:
                # anew, with what these texts have
                old = places[~missing]
                self.known = self.known.take(pa.array(old))
                self.flat, upto = self._gather(old)
                self.first, self.length = upto[:-1], np.diff(upto)
                places[~missing] = np.arange(len(old))
            places[missing] = len(self.known) + np.arange(len(new))
            ids, ends = self._encode(new)
            length = np.diff(ends, prepend=0)
            self.known = pa.concat_arrays([self.known, new])
            self.first = np.concatenate([self.first, len(self.flat) + ends - length])
            self.length = np.concatenate([self.length, length])
            self.flat = np.concatenate([self.flat, ids])
        else:
            places = place.to_numpy(zero_copy_only=False)
        return self._gather(places[coded.indices.to_numpy()])

    def _gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.length[places]
        upto = np.concatenate([[0], np.cumsum(size)])
        return self.flat[np.repeat(self.first[places] - upto[:-1], size) + np.arange(upto[-1])], upto

    def _encode(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces in Latin-1, and where those of each end."""
        text = b" ".join(pieces.to_pylist()).decode("latin-1").encode().decode("latin-1").translate(BYTE_LEVEL)
        # one text of all of them: the last id of a piece, and no other, has the suffix
        ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u2")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(pieces):
            raise ValueError("the tokenizer's ids do not show where pieces end")
        return ids, ends

    def _learn(self, wanted: set[str], whole: set[str]) -> None:
        new = [p for p in wanted if p not in self]
        self.size += sum(map(len, new))
        if len(self) + len(new) > CACHE or self.size > CACHE_CHARS:
            self.clear()
            new = list(wanted)
            self.size = sum(map(len, new))
        cut = [p for p in new if p not in whole]
        if cut:
            # one text of all of them: the last id of a piece, and no other, has the suffix
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(cut)], add_special_tokens=False)[0].ids, "<u2")
            ends = (2 * np.flatnonzero(self.last[ids]) + 2).tolist()
            if len(ends) != len(cut):
                raise ValueError("the tokenizer's ids do not show where pieces end")
            self.update(zip(cut, map(ids.tobytes().__getitem__, map(slice, [0, *ends], ends))))
        words = [p for p in new if p in whole]
        for w, e in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False)):
            self[w] = np.array(e.ids, "<u2").tobytes()


@lru_cache(maxsize=1)
def piece_ids(path: str) -> PieceIds:
    """Kept by a worker from task to task."""
    return PieceIds(path)


def pack(part: int, number: int, docs: list[int | None], counts: list[int], ids: np.ndarray, block: int = rangecoder.BLOCK) -> bytes:
    """One file: header, index of documents, the blocks' common start, blocks."""
    block = max(1, min(block, len(ids)))
    n = -(-len(ids) // block)
    start, ranks = rangecoder.Start.of(ids)
    lanes = np.zeros(n * block, np.uint16)
    lanes[:len(ids)] = ranks
    lanes = lanes.reshape(n, block)
    index = b"".join([
        np.array([d is None for d in docs], np.uint8).tobytes(),
        np.array([d or 0 for d in docs], "<i8").tobytes(), np.array(counts, "<u4").tobytes()])
    out = [struct.pack(HEAD, MAGIC, part, number, len(docs), len(ids), n, block, zlib.crc32(index)), index]
    payloads = rangecoder.encode(lanes, start)
    out.append(start.pack())
    for i, payload in enumerate(payloads):
        own = ids[i * block:(i + 1) * block]
        out += [struct.pack(BLOCK_HEAD, len(own), len(payload), zlib.crc32(own.astype("<u4").tobytes()), zlib.crc32(payload)), payload]
    return b"".join(out)


def unpack(content: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Documents, their counts and all ids of a file; a wrong checksum raises."""
    magic, _, _, n_docs, n_ids, n, block, index_crc = struct.unpack_from(HEAD, content)
    if magic != MAGIC:
        raise ValueError("not a token id file")
    at = HEAD_BYTES + 13 * n_docs
    index = content[HEAD_BYTES:at]
    if zlib.crc32(index) != index_crc:
        raise ValueError("index of a token id file is damaged")
    missing = np.frombuffer(index, np.uint8, n_docs)
    docs = [None if m else d for m, d in zip(missing.tolist(), np.frombuffer(index, "<i8", n_docs, n_docs).tolist())]
    counts = np.frombuffer(index, "<u4", n_docs, 9 * n_docs)
    start, at = rangecoder.Start.unpack(content, at)
    payloads, sums = [], []
    for _ in range(n):
        size, length, crc, raw_crc = struct.unpack_from(BLOCK_HEAD, content, at)
        at += BLOCK_HEAD_BYTES
        payloads.append(content[at:at + length])
        if zlib.crc32(payloads[-1]) != raw_crc:
            raise ValueError("block of a token id file is damaged")
        sums.append((size, crc))
        at += length
    lanes = start.ids.astype(np.uint16)[rangecoder.decode(payloads, block, start)]
    for own, (size, crc) in zip(lanes, sums):
        if zlib.crc32(own[:size].astype("<u4").tobytes()) != crc:
            raise ValueError("block of a token id file is damaged")
    return docs, counts, lanes.reshape(-1)[:n_ids]


def _groups(batches):
    """Ids and texts of documents, some GROUP_BYTES at a time."""
    docs, texts, size = [], [], 0
    for b in batches:
        for doc, text in zip(b.column("doc_id").to_pylist(), byte_texts(b.column("text"))):
            docs.append(doc)
            texts.append(text)
            size += len(text)
            if size >= GROUP_BYTES:
                yield docs, texts
                docs, texts, size = [], [], 0
    if docs:
        yield docs, texts


def _files(path, end_id, file_ids):
    def run(batches):
        pieces = piece_ids(path)
        part, number = TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u2")
        docs, counts, held, size = [], [], [], 0

        def close():
            return pa.RecordBatch.from_pydict({"file": [pack(part, number, docs, counts, np.concatenate(held))]})

        for group, texts in _groups(batches):
            for doc, own in zip(group, pieces.of(texts)):
                docs.append(doc)
                counts.append(len(own) + 1)
                held += [own, end]
                size += len(own) + 1
                if size >= file_ids:
                    yield close()
                    docs, counts, held, size, number = [], [], [], 0, number + 1
        if docs:
            yield close()

    return run


def write(docs: DataFrame, out: str, tokenizer_path: str, end_id: int = END_ID, file_ids: int = FILE_IDS,
          id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of every whole text, each followed by `end_id`, in ascending doc_id order.

    Documents are range-sorted by id, and every task writes files of bounded size through Spark's
    text sink, so that only whole files of finished tasks appear. Equal ids stand in the order
    of their texts' hashes. Null ids stand last. A null text is empty and has the end id alone.
    An empty table leaves a folder without files. Words split only at the white space 20 and 09 to 0D; the
    tokenizer must drop white space, and have ids below 65536."""
    order = [F.col("doc_id").asc_nulls_last(), F.col("hash")]
    rows = narrow(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("hash", F.xxhash64("text"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    packed = arrow_map(rows, _files(tokenizer_path, end_id, file_ids), "file binary")
    packed.select(F.col("file").cast("string").alias("value")).write.option("lineSep", LINE_END).option("maxRecordsPerFile", 1).text(out)


def _heads(batches):
    for b in batches:
        heads = [struct.unpack(HEAD, h) for h in b.column("head").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in heads], pa.int64()) for i in (1, 2, 4)], names=["part", "number", "n"])


def _documents(batches):
    for b in batches:
        for content in b.column("content").to_pylist():
            head = struct.unpack_from(HEAD, content)
            docs, counts, ids = unpack(content)
            ends = np.cumsum(counts, dtype=np.int64)
            raw = ids.astype("<u4")
            n = len(docs)
            crc = [zlib.crc32(raw[e - c:e].tobytes()) for e, c in zip(ends.tolist(), counts.tolist())]
            yield pa.RecordBatch.from_arrays([
                pa.array([head[1]] * n, pa.int64()), pa.array([head[2]] * n, pa.int64()), pa.array(docs, pa.int64()), pa.array(ends - counts),
                pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64())], names=["part", "number", "doc_id", "offset", "n_tokens", "ids_crc32"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files. The files' starts come
    from one header each; a damaged file fails the read."""
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    heads = arrow_map(files.select(F.substring("content", 1, HEAD_BYTES).alias("head")), _heads, "part long, number long, n long")
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    starts = heads.select("part", "number", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    documents = arrow_map(files.select("content"), _documents, "part long, number long, doc_id long, offset long, n_tokens long, ids_crc32 long")
    return documents.join(starts, ["part", "number"]).select("doc_id", (F.col("begin") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
