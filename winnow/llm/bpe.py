"""Byte-level BPE over a pair occurrence index."""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import arrow_map, narrow

# Distinct pieces, and their characters, that a worker remembers before it starts anew.
CACHE, CACHE_CHARS = 400_000, 8_000_000

# Bits of an id in the number that stands for a pair.
PAIR_BITS = 20

# Fixed value: the cut of byte-level BPE into pieces.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where
    it is printable Latin-1, else the next unused one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b if b in plain else next(other)) for b in range(256)]


class ByteBPE:
    """Vocabulary, ranks and special tokens of a byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        self.byte_id = [vocab[c] for c in letters]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.bytes_of = {i: bytes(back[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.cut = regex.compile(PIECES)
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    @cached_property
    def by_number(self) -> tuple[dict[int, int], dict[int, tuple[int, int, int]]]:
        """pair, as one number -> rank; rank -> (left, right, made)"""
        return ({a << PAIR_BITS | b: rank for (a, b), (rank, _) in self.ranks.items()},
                {rank: (a, b, made) for (a, b), (rank, made) in self.ranks.items()})

    @cached_property
    def by_pair(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs as sorted numbers, their ranks, and the ranks of pairs of single bytes; -1: none."""
        numbers = self.by_number[0]
        keys = np.array(sorted(numbers), np.int64)
        of_bytes = [[numbers.get(a << PAIR_BITS | b, -1) for b in self.byte_id] for a in self.byte_id]
        return keys, np.array([numbers[k] for k in keys.tolist()], np.int64), np.array(of_bytes, np.int64)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys, ranks, _ = self.by_pair
        numbers = left << PAIR_BITS | right
        at = np.searchsorted(keys, numbers)
        at[at == len(keys)] = 0
        return np.where(keys[at] == numbers, ranks[at], -1) if len(keys) else np.full(len(numbers), -1)

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pieces at once, all in one array, and the number of ids of each piece.

        The symbols of all pieces stand in one row of cells linked to their neighbours; every
        adjacent pair is indexed with all its cells. The lowest active rank is applied to all its cells
        together, and the pairs that it makes enter the index. Pieces where a merge makes a pair
        of lower rank, which has to go before the rest, are encoded step by step."""
        raw = [p.encode() for p in pieces]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(sizes)
        cells = np.frombuffer(b"".join(raw), np.uint8)
        if not len(cells):
            return np.empty(0, np.int32), sizes
        ids = np.array(self.byte_id, np.int64)[cells]
        after = np.arange(1, len(ids) + 1)
        before = np.arange(-1, len(ids) - 1)
        after[ends[sizes > 0] - 1] = -1
        before[(ends - sizes)[sizes > 0]] = -1

        where: dict[int, list[np.ndarray]] = {}  # rank of a pair -> its cells
        active: list[int] = []

        def enter(at: np.ndarray, ranks: np.ndarray) -> None:
            known = np.flatnonzero(ranks >= 0)
            if not len(known):
                return
            at, ranks = at[known], ranks[known]
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
            for rank, s, e in zip(ranks[cuts[:-1]].tolist(), cuts, cuts[1:]):
                own = where.get(rank)
                if own is None:
                    where[rank] = [at[s:e]]
                    heapq.heappush(active, rank)
                else:
                    own.append(at[s:e])

        first = np.flatnonzero(after >= 0)
        enter(first, self.by_pair[2][cells[first], cells[first + 1]])
        merges = self.by_number[1]
        rank_of = self.by_number[0].get
        odd = []  # cells of pieces that go step by step
        while active:
            now = heapq.heappop(active)
            a, b, made = merges[now]
            at = where.pop(now)
            i = at[0] if len(at) == 1 else np.concatenate(at)
            if len(i) > 1:
                i = np.unique(i)
            i = i[(ids[i] == a) & (after[i] >= 0)]
            i = i[ids[after[i]] == b]
            if a == b and len(i) > 1:
                # of overlapping pairs every second one, from the left of each run
                places = np.arange(len(i))
                begins = np.concatenate([[True], after[i[:-1]] != i[1:]])
                i = i[(places - np.maximum.accumulate(np.where(begins, places, 0))) % 2 == 0]
            if not len(i):
                continue
            j = after[i]
            k = after[j]
            ids[i], ids[j] = made, -1
            after[i] = k
            followed = np.flatnonzero(k >= 0)
            before[k[followed]] = i[followed]
            chained = k[:-1] == i[1:]  # two merged cells side by side
            h = before[i]
            led = h >= 0
            led[1:] &= ~chained
            changed = np.concatenate([i[followed], h[led]])
            ranks = self.ranks_of(ids[changed], ids[after[changed]])
            odd.append(changed[(ranks >= 0) & (ranks < now)])
            between = rank_of(made << PAIR_BITS | a)  # stands for a moment in a chain
            if between is not None and between < now:
                odd.append(i[1:][chained])
            enter(changed, ranks)
        alive = ids >= 0
        upto = np.concatenate([[0], np.cumsum(alive)])
        counts = upto[ends] - upto[ends - sizes]
        flat = ids[alive].astype(np.int32)
        stepwise = np.unique(np.searchsorted(ends, np.concatenate(odd), side="right")).tolist() if odd else []
        if stepwise:
            parts = np.split(flat, np.cumsum(counts)[:-1])
            for n, own in zip(stepwise, self.encode_stepwise([pieces[n] for n in stepwise])):
                parts[n] = np.array(own, np.int32)
                counts[n] = len(own)
            flat = np.concatenate(parts)
        return flat, counts

    def encode_stepwise(self, pieces: list[str]) -> list[list[int]]:
        """As encode_pieces, one cell at a time, which may stop inside a rank for a lower one."""
        ids: list[int] = []
        after: list[int] = []
        before: list[int] = []
        starts: list[int] = []
        byte_id = self.byte_id
        for piece in pieces:
            s = len(ids)
            starts.append(s)
            ids += [byte_id[byte] for byte in piece.encode()]
            e = len(ids)
            if e > s:
                after += range(s + 1, e)
                after.append(-1)
                before.append(-1)
                before += range(s, e - 1)
        numbers, merges = self.by_number
        rank_of = numbers.get
        where: dict[int, list[int]] = {}  # rank of a pair -> its cells
        cells_of = where.get
        for i, j in enumerate(after):
            if j >= 0:
                rank = rank_of(ids[i] << PAIR_BITS | ids[j])
                if rank is not None:
                    cells = cells_of(rank)
                    if cells is None:
                        where[rank] = [i]
                    else:
                        cells.append(i)
        active = list(where)
        heapq.heapify(active)
        push = heapq.heappush
        while active:
            now = heapq.heappop(active)
            cells = where.pop(now, None)
            if cells is None:
                continue
            cells.sort()
            a, b, made = merges[now]
            for n, i in enumerate(cells):
                j = after[i]
                if ids[i] != a or j < 0 or ids[j] != b:
                    continue  # an earlier merge took one of the two
                ids[i], ids[j] = made, -1
                k = after[i] = after[j]
                h = before[i]
                lower = False
                if k >= 0:
                    before[k] = i
                    rank = rank_of(made << PAIR_BITS | ids[k])
                    if rank is not None:
                        lower = rank < now
                        own = cells_of(rank)
                        if own is None:
                            where[rank] = [i]
                            push(active, rank)
                        else:
                            own.append(i)
                if h >= 0:
                    rank = rank_of(ids[h] << PAIR_BITS | made)
                    if rank is not None:
                        lower |= rank < now
                        own = cells_of(rank)
                        if own is None:
                            where[rank] = [h]
                            push(active, rank)
                        else:
                            own.append(h)
                if lower and n + 1 < len(cells):
                    where.setdefault(now, []).extend(cells[n + 1:])
                    push(active, now)
                    break
        return [[i for i in ids[s:e] if i >= 0] for s, e in zip(starts, [*starts[1:], len(ids)])]

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteBPE:
    return ByteBPE(path)


class PieceCache(dict):
    """piece -> its number; the ids of all numbered pieces stand in one array. Special tokens are
    always among them. A piece asked for the first time gets a number, and its ids by learn()."""

    def __init__(self, bpe: ByteBPE):
        self.bpe = bpe
        self.restart()

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        self.new.append(piece)
        self.new_chars += len(piece)
        return n

    def restart(self) -> None:
        self.clear()
        self.chars = 0
        self.new: list[str] = []
        self.new_chars = 0
        self.update({t: n for n, t in enumerate(self.bpe.special)})
        self.ids = np.array(list(self.bpe.special.values()), np.int32)
        self.ends = np.arange(len(self) + 1)

    def numbers(self, pieces: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, pieces), np.int32, len(pieces))

    def learn(self) -> None:
        self.chars += self.new_chars
        ids, counts = self.bpe.encode_pieces(self.new)
        self.ids = np.concatenate([self.ids, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts)])
        self.new, self.new_chars = [], 0

    def full(self) -> bool:
        return len(self) > CACHE or self.chars > CACHE_CHARS

    def spell(self, numbers: np.ndarray) -> np.ndarray:
        """Ids of a row of numbered pieces."""
        begin = self.ends[numbers]
        sizes = self.ends[numbers + 1] - begin
        upto = np.cumsum(sizes)
        return self.ids[np.repeat(begin - upto + sizes, sizes) + np.arange(upto[-1] if len(upto) else 0)]


@lru_cache(maxsize=1)
def piece_cache(path: str) -> PieceCache:
    """Kept by a worker from task to task."""
    return PieceCache(tokenizer(path))


def cut(bpe: ByteBPE, text: str) -> list[str]:
    """Pieces of a text; special tokens are pieces of their own."""
    if bpe.cut_special is None or not any(s in text for s in bpe.special):
        return bpe.cut.findall(text)
    out = []
    for part in bpe.cut_special.split(text):
        if part in bpe.special:
            out.append(part)
        elif part:
            out.extend(bpe.cut.findall(part))
    return out


# Pieces are indexed together until a group has so many characters of text, or of new pieces.
GROUP_CHARS, GROUP_NEW = 8_000_000, 1_000_000


def _encode(path: str, decoded: bool = False):
    """With `decoded`, digests of what the ids spell instead of the ids."""

    def run(batches):
        bpe = tokenizer(path)
        cache = piece_cache(path)
        if cache.new:  # left by a task that failed
            cache.restart()
        decimal = list(map(str, range(max(bpe.bytes_of, default=-1) + 1)))
        held, chars = [], 0

        def spelled():
            cache.learn()
            for doc_ids, rows in held:
                n, ids_sha, ids_all = [], [], []
                for row in rows:
                    ids = cache.spell(row)
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids.tolist())).encode()).hexdigest())
                    ids_all.append(hashlib.sha256(bpe.decode(ids.tolist()).encode()).hexdigest() if decoded else ids.tobytes())
                last = pa.array(ids_all, pa.string() if decoded else pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [doc_ids, pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), last],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256" if decoded else "ids"])
            if cache.full():
                cache.restart()

        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            held.append((b.column("doc_id"), [cache.numbers(cut(bpe, t)) for t in texts]))
            chars += sum(map(len, texts))
            if chars >= GROUP_CHARS or cache.new_chars >= GROUP_NEW:
                yield from spelled()
                held, chars = [], 0
        if held:
            yield from spelled()

    return run


def _decode(path: str):
    def run(batches):
        bpe = tokenizer(path)
        for b in batches:
            sha = [hashlib.sha256(bpe.decode(np.frombuffer(ids, np.int32).tolist()).encode()).hexdigest() for ids in b.column("ids").to_pylist()]
            keep = [n for n in b.schema.names if n != "ids"]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in keep], pa.array(sha, pa.string())], names=[*keep, "decoded_sha256"])

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, ids (little-endian 32-bit) of every whole text.

    A null text is an empty one and has no ids. Special tokens standing in a text become their
    id. Null and repeated doc_ids are rows like any other. No rows give no rows."""
    rows = narrow(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return arrow_map(rows, _encode(path), f"doc_id {kind}, n_tokens long, ids_sha256 string, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Replace `ids` by decoded_sha256, the digest of the text that the ids spell."""
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return arrow_map(encoded.select("doc_id", "n_tokens", "ids_sha256", F.coalesce("ids", F.lit(b"")).alias("ids")), _decode(path),
                     f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """decode(encode(docs)) in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256. The ids stay in the task."""
    rows = narrow(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return arrow_map(rows, _encode(path, True), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
