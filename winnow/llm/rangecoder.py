"""Adaptive context-mixing range coder over token ids, many blocks side by side.

Every block starts from the same reset state, which the file's header holds: the frequencies of
its ids, what mostly follows each, and how often the orders were right. So all blocks of a file advance
together: one step codes the next id of every block, each block being one lane of the arrays.
What the orders say depends on the ids alone, so a coder traces it first and turns it into shares many
steps at a time; its last loop only narrows spans. Inside the coder an id is its rank, the place
among the file's ids by falling frequency."""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np

# Ids per block, and entries of the order-1 and order-2 tables of a block.
BLOCK = 4096
TABLE_BITS = 11
# Steps after which a block's shares are taken anew, what one id adds to them, and how many ids the
# file's classes, and the file's events of one context, count for.
REFRESH, GAIN, PRIOR, EVENT_PRIOR = 256, 24, 256, 32
# Steps whose shares a coder works out at once.
AHEAD = 8
# Bits of the three parts of a frequency: which prediction holds, the class of ranks, the rank in it.
WHICH, CLASS, WITHIN = 9, 11, 11
FULL, SLOTS = 1 << WHICH, 1 << WITHIN
CLASSES = 64
TOTAL = np.uint64(WHICH + CLASS + WITHIN)
LITERAL = CLASS + WITHIN
# A span is at least BOTTOM before a step, so one word of 32 bits makes up for any step.
BOTTOM = np.uint64(1 << 32)
S32 = np.uint64(32)
NONE = 1 << 16  # no rank
# For gathers whose places are right anyway; the default's way of checking them takes as long as the gather.
IN = "clip"
# An entry of a table is a rank and, in its lowest bits, a confidence.
SURE_BITS = 3
MOST_SURE = (1 << SURE_BITS) - 1
EMPTY = NONE << SURE_BITS
# Contexts of the mix: both confidences and whether the orders differ; in which of them order 2 or
# order 1 can be right where the ones before are not.
SEEN = 1 << (2 * SURE_BITS + 1)
SURE2, SURE1, DIFFER = np.arange(SEEN) >> (SURE_BITS + 1), (np.arange(SEEN) >> 1) & MOST_SURE, np.arange(SEEN) & 1
TWO, ONE = (SURE2 > 0).astype(np.int32), DIFFER.astype(np.int32)
# Counts are kept as levels, four to a doubling.
LEVELS = np.array([(16, 19, 23, 27)[k & 3] << (k >> 2) for k in range(128)], np.int64)
# Pairs of ids seen less often in a file are no successors.
SUCCESSOR_COUNT = 4
START_HEAD = "<III"


def _levels(count: np.ndarray) -> np.ndarray:
    return np.maximum(np.searchsorted(LEVELS, count * 16, "right") - 1, 0).astype(np.uint8)


class Start:
    """The reset state of every block of a file: distinct `ids`, their count `levels`,
    `after`, the rank that mostly follows each rank (NONE where none does), and the count levels of the
    `events` of each context (order 2 right, order 1 right, neither) and of the `literals` of each class.

    Ranks fall into classes of contiguous ranks, halfway between equal frequency and equal number:
    frequent ids stand alone, and no class has more ranks than slots."""

    def __init__(self, ids: np.ndarray, levels: np.ndarray, after: np.ndarray | None = None,
                 events: np.ndarray | None = None, literals: np.ndarray | None = None):
        order = np.lexsort((ids, -levels.astype(np.int64)))
        self.ids, self.levels = ids[order], levels[order]
        n = len(ids)
        weight = LEVELS[self.levels]
        total = max(1, int(weight.sum()))
        self.cls = CLASSES * ((np.cumsum(weight) - weight) * n + np.arange(n) * total) // max(1, 2 * n * total)
        share = np.bincount(self.cls, weight, CLASSES).astype(np.int64)
        size = np.bincount(self.cls, minlength=CLASSES)
        self.freq = 1 + weight * (SLOTS - size[self.cls]) // np.maximum(1, share[self.cls])
        first = np.flatnonzero(np.diff(self.cls, prepend=-1))
        used = np.bincount(self.cls, self.freq, CLASSES).astype(np.int64)
        self.freq[first] += SLOTS - used[self.cls[first]]
        before = np.cumsum(self.freq) - self.freq
        # of a rank: its first slot; of a slot in a class: its rank
        self.begin = before & (SLOTS - 1)
        self.rank = np.zeros(CLASSES << WITHIN, np.int32)
        self.rank[np.repeat((self.cls << WITHIN) + self.begin - before, self.freq) + np.arange(int(self.freq.sum()))] = np.repeat(np.arange(n), self.freq)
        self.after = np.full(n, NONE, np.int32) if after is None else after
        if events is None:
            events = _levels(np.concatenate([4 * SURE2 ** 2, 1 + 2 * SURE1, np.full(SEEN, 8)]))
        self.share(events, _levels(share // 16) if literals is None else literals)

    def share(self, events: np.ndarray, literals: np.ndarray) -> None:
        self.events, self.literals = events, literals
        can = np.stack([TWO, ONE, np.ones(SEEN, np.int32)])
        weight = LEVELS[events].reshape(3, 1, SEEN) * can[:, None]
        self.chances = (can[:, None] + GAIN * EVENT_PRIOR * weight // weight.sum(axis=0)).astype(np.int32)
        weight = LEVELS[literals]
        self.counts = (1 + GAIN * PRIOR * weight // weight.sum()).astype(np.int32)

    @classmethod
    def of(cls, ids: np.ndarray) -> tuple[Start, np.ndarray]:
        """The state for these ids below 65536, and their ranks."""
        count = np.bincount(ids, minlength=1 << 16)
        own = np.flatnonzero(count)
        start = cls(own, _levels(count[own]))
        place = np.zeros(1 << 16, np.uint16)
        place[start.ids] = np.arange(len(own))
        ranks = place[ids]
        pairs = np.sort((ranks[:-1].astype(np.uint32) << np.uint32(16)) | ranks[1:])
        ends = np.flatnonzero(np.append(pairs[1:] != pairs[:-1], len(pairs) > 0))
        often = np.diff(ends, prepend=-1)
        pair, often = pairs[ends][often >= SUCCESSOR_COUNT], often[often >= SUCCESSOR_COUNT]
        rising = np.argsort(often, kind="stable")
        start.after[pair[rising] >> 16] = pair[rising] & 0xFFFF  # the most frequent is written last
        return start, ranks

    def pack(self) -> bytes:
        marks = np.zeros(1 << 16, np.uint8)
        marks[self.ids] = 1
        by_id = np.argsort(self.ids)
        body = [np.packbits(marks).tobytes(), self.events.tobytes(), self.literals.tobytes(), self.levels[by_id].astype(np.uint8).tobytes(),
                (self.after < NONE).astype(np.uint8).tobytes(), self.after[self.after < NONE].astype("<u2").tobytes()]
        raw = zlib.compress(b"".join(body), 9)
        return struct.pack(START_HEAD, len(raw), len(self.ids), zlib.crc32(raw)) + raw

    @classmethod
    def unpack(cls, content: bytes, at: int) -> tuple[Start, int]:
        """The state packed at `at`, and where it ends; a wrong checksum raises."""
        size, n, crc = struct.unpack_from(START_HEAD, content, at)
        at += struct.calcsize(START_HEAD)
        raw = content[at:at + size]
        if zlib.crc32(raw) != crc:
            raise ValueError("start of a token id file is damaged")
        body = zlib.decompress(raw)
        at_events, at_literals = 1 << 13, (1 << 13) + 3 * SEEN
        at_levels = at_literals + CLASSES
        ids = np.flatnonzero(np.unpackbits(np.frombuffer(body, np.uint8, at_events)))
        after = np.full(n, NONE, np.int32)
        after[np.frombuffer(body, np.uint8, n, at_levels + n) > 0] = np.frombuffer(body, "<u2", offset=at_levels + 2 * n)
        return cls(ids, np.frombuffer(body, np.uint8, n, at_levels), after, np.frombuffer(body, np.uint8, 3 * SEEN, at_events),
                   np.frombuffer(body, np.uint8, CLASSES, at_literals)), at + size


@lru_cache(maxsize=1)
def _even() -> Start:
    """Of ids that nothing is known about: each is its own rank."""
    return Start(np.arange(1 << 16), np.zeros(1 << 16, np.int64))


@lru_cache(maxsize=1)
def _hashes() -> tuple[np.ndarray, np.ndarray]:
    """Of each rank: its place in an order-1 table, and what the rank before it turns into a place of order 2."""
    ranks = np.arange(1 << 16, dtype=np.int64)
    return tuple(((ranks * k) & 0xFFFFFFFF) >> (32 - TABLE_BITS) for k in (0x9E3779B1, 0x85EBCA6B))


class Orders:
    """Predictions of order 2 and 1 for every lane, learned as ranks pass by.

    The entry of an order-2 or order-1 context is its last rank and a confidence, 1 to 7; an
    empty order-1 entry stands for the file's successor with confidence 0."""

    def __init__(self, lanes: int, start: Start):
        self.follow = start.after << SURE_BITS
        self.of1, self.of2 = _hashes()
        # apart by no power of two, so that equal contexts of all lanes don't meet in one set of a cache
        apart = (1 << TABLE_BITS) + 16
        self.table = np.full(2 * lanes * apart, EMPTY, np.int32)
        self.row = np.arange(2 * lanes, dtype=np.int64).reshape(2, lanes) * apart
        self.hash = np.zeros((2, lanes), np.int64)  # of order 2 and of order 1, as all that follows
        self.after = np.full(lanes, EMPTY, np.int32)

    def predict(self) -> None:
        """The `ranks` of order 2 and order 1; `seen`: both confidences and whether the ranks differ."""
        self.at = self.row + self.hash
        self.entry = self.table.take(self.at, mode=IN)
        np.putmask(self.entry[1], self.entry[1] == EMPTY, self.after)
        self.ranks, self.sure = self.entry >> SURE_BITS, self.entry & MOST_SURE
        self.seen = (self.sure[0] << SURE_BITS + 1) | (self.sure[1] << 1) | (self.ranks[0] != self.ranks[1])

    def learn(self, ranks: np.ndarray) -> np.ndarray:
        """Takes the ranks that came; returns which order had them."""
        hits = self.ranks == ranks
        missed = np.where(self.sure > 1, self.entry - (self.sure >> 1), (ranks << SURE_BITS) | 1)
        self.table[self.at] = np.where(hits, self.entry + (self.sure < MOST_SURE), missed)
        place = ranks.astype(np.int64)
        np.bitwise_xor(self.of2.take(place, mode=IN), self.hash[1], out=self.hash[0])
        self.hash[1] = self.of1.take(place, mode=IN)
        self.after = self.follow.take(place, mode=IN)
        return hits


class Shares:
    """What every lane gives to the order-2 rank, the order-1 rank and each class of all others:
    the file's shares mixed with what the block has shown, taken anew after REFRESH steps."""

    def __init__(self, lanes: int, start: Start):
        self.lanes = np.arange(lanes, dtype=np.int64)
        self.events = np.repeat(start.chances, lanes, axis=1).reshape(3, -1)
        self.two, self.one = np.tile(TWO, lanes), np.tile(ONE, lanes)
        self.classes = np.tile(start.counts, lanes)
        self.refresh()

    def refresh(self) -> None:
        two, one, none = self.events.astype(np.float32)
        part = np.float32(FULL - 3) / (two + one + none)
        upto2 = (two * part).astype(np.int32) + self.two
        upto1 = (one * part).astype(np.int32) + upto2 + self.one
        # both ends of a context in one number
        self.ends = (upto1 << WHICH) | upto2
        total = np.cumsum(self.classes.reshape(-1, CLASSES), axis=1, dtype=np.int64)
        cum = np.zeros((len(total), CLASSES + 1), np.int32)
        cum[:, 1:] = total * ((1 << CLASS) - CLASSES) // total[:, -1:] + np.arange(1, CLASSES + 1)
        self.cum = cum.reshape(-1)

    def by_slot(self) -> np.ndarray:
        """The class of each slot of each lane."""
        own = np.diff(self.cum.reshape(-1, CLASSES + 1), axis=1).reshape(-1)
        return np.repeat(np.tile(np.arange(CLASSES, dtype=np.uint8), len(self.lanes)), own)

    def learn(self, seen: np.ndarray, event: np.ndarray, classes: np.ndarray) -> None:
        """Rows of steps: contexts, which of the three came, and the class of the rank."""
        np.add.at(self.events.reshape(-1), (event * np.int64(self.events.shape[1]) + self.lanes * SEEN + seen).reshape(-1), np.int32(GAIN))
        literal = event == 2
        np.add.at(self.classes, (self.lanes * CLASSES + classes)[literal], np.int32(GAIN))
        self.refresh()


def _events(hits: np.ndarray) -> np.ndarray:
    """Whether order 2 (0), order 1 (1) or neither (2) had the rank; hits by step, order and lane."""
    return np.where(hits[:, 0], np.uint8(0), np.uint8(2) - hits[:, 1].view(np.uint8))


def _trace(rows: np.ndarray, start: Start) -> tuple[np.ndarray, np.ndarray]:
    """Contexts and events of every step and lane."""
    length, lanes = rows.shape
    seen, hits = np.empty((length, lanes), np.uint8), np.empty((length, 2, lanes), bool)
    orders = Orders(lanes, start)
    for step, ranks in enumerate(rows):
        orders.predict()
        seen[step] = orders.seen
        hits[step] = orders.learn(ranks.astype(np.int32))
    return seen, _events(hits)


def encode(blocks: np.ndarray, start: Start | None = None) -> list[bytes]:
    """Code rows of ranks, a row per block; returns the bytes of each. Without a start ranks are ids.
    A start takes the shares of these rows and is packed afterwards."""
    rows = np.ascontiguousarray(blocks.T)
    length, lanes = rows.shape
    seen, event = _trace(rows, start or _even())
    if start:
        literals = start.cls.take(rows[event == 2], mode=IN)
        start.share(_levels(np.bincount(event.reshape(-1) * np.int32(SEEN) + seen.reshape(-1), minlength=3 * SEEN)),
                    _levels(np.bincount(literals, minlength=CLASSES)))
    start = start or _even()
    shares = Shares(lanes, start)
    low = np.zeros(lanes, np.uint64)
    span = np.full(lanes, (1 << 64) - 1, np.uint64)
    # of every step and lane: the upper half of low, whether it goes out, whether the words before are one more
    words = np.empty((length + 2, lanes), np.uint32)
    out = np.ones((length + 2, lanes), bool)
    carry = np.zeros((length + 2, lanes), bool)
    row_seen, row_class = shares.lanes * SEEN, shares.lanes * (CLASSES + 1)
    for first in range(0, length, REFRESH):
        part = slice(first, min(first + REFRESH, length))
        classes = start.cls.take(rows[part], mode=IN)
        for a in range(part.start, part.stop, AHEAD):
            some = slice(a, min(a + AHEAD, part.stop))
            ranks, came = rows[some], event[some]
            ends = shares.ends.take(row_seen + seen[some], mode=IN)
            upto2, upto1 = (ends & (FULL - 1)).astype(np.int64), (ends >> WHICH).astype(np.int64)
            at_class = row_class + classes[some.start - first:some.stop - first]
            begin = shares.cum.take(at_class, mode=IN).astype(np.int64)
            own = shares.cum.take(at_class + 1, mode=IN) - begin
            left = FULL - upto1
            place = (upto1 << LITERAL) + left * ((begin << WITHIN) + start.begin.take(ranks, mode=IN) * own)
            freq = own * left * start.freq.take(ranks, mode=IN)
            for k, lo, hi in ((0, 0, upto2), (1, upto2, upto1)):
                known = came == k
                np.copyto(place, lo << LITERAL, where=known)
                np.copyto(freq, (hi - lo) << LITERAL, where=known)
            for step, p, f in zip(range(some.start, some.stop), place.view(np.uint64), freq.view(np.uint64)):
                r = span >> TOTAL
                new = low + r * p
                np.less(new, low, out=carry[step])
                np.multiply(r, f, out=span)
                np.less(span, BOTTOM, out=out[step])
                np.right_shift(new, S32, out=words[step], casting="unsafe")
                shift = out[step].astype(np.uint64) << np.uint64(5)
                low = new << shift
                span <<= shift
        shares.learn(seen[part], event[part], classes)
    words[length], words[length + 1] = low >> S32, low & np.uint64((1 << 32) - 1)
    sizes = out.sum(axis=0)
    # lane by lane: the words that go out, then the carries into the last word before each
    sent = np.flatnonzero(out.T)
    stream = np.ascontiguousarray(words.T).reshape(-1)[sent]
    back = np.searchsorted(sent, np.flatnonzero(carry.T)) - 1
    while len(back):
        full = stream[back] == 0xFFFFFFFF
        stream[back] += np.uint32(1)  # wraps to 0 where full
        back = back[full] - 1
    ends = np.cumsum(sizes)
    return [stream[e - n:e].astype("<u4").tobytes() for e, n in zip(ends.tolist(), sizes.tolist())]


def decode(payloads: list[bytes], length: int, start: Start | None = None) -> np.ndarray:
    """The ranks of blocks of `length` ranks, a row per block."""
    start = start or _even()
    lanes = len(payloads)
    orders, shares = Orders(lanes, start), Shares(lanes, start)
    sizes = np.array([len(p) // 4 for p in payloads], np.int64)
    words = np.concatenate([*(np.frombuffer(p, "<u4") for p in payloads), np.zeros(4, "<u4")]).astype(np.uint64)
    at = np.cumsum(sizes) - sizes
    code = (words[at] << S32) | words[at + 1]
    at += 2
    span = np.full(lanes, (1 << 64) - 1, np.uint64)
    rows = np.empty((length, lanes), np.uint16)
    seen, hits = np.empty((REFRESH, lanes), np.uint8), np.empty((REFRESH, 2, lanes), bool)
    row_seen, row_class, row_slot = shares.lanes * SEEN, shares.lanes * (CLASSES + 1), shares.lanes << CLASS
    by_slot = shares.by_slot()
    for step in range(length):
        orders.predict()
        ends = shares.ends.take(row_seen + orders.seen, mode=IN)
        upto2, upto1 = (ends & (FULL - 1)).astype(np.int64), (ends >> WHICH).astype(np.int64)
        r = span >> TOTAL
        value = (code // r).view(np.int64)
        which = value >> LITERAL
        # as if no order had the rank, else without meaning; exact: all numbers are below 2 to the 53
        left, base = FULL - upto1, upto1 << LITERAL
        inner = ((value - base) / left).astype(np.int64)
        classes = by_slot.take(row_slot + (inner >> WITHIN), mode=IN).astype(np.int64)
        at_class = row_class + classes
        begin = shares.cum.take(at_class, mode=IN).astype(np.int64)
        own = shares.cum.take(at_class + 1, mode=IN) - begin
        slot = ((inner - (begin << WITHIN)) / own).astype(np.int64)
        ranks = start.rank.take((classes << WITHIN) + slot, mode=IN)
        at_rank = ranks.astype(np.int64)
        place = base + left * ((begin << WITHIN) + start.begin.take(at_rank, mode=IN) * own)
        freq = own * left * start.freq.take(at_rank, mode=IN)
        # where an order had it
        base2 = upto2 << LITERAL
        for has, rank, lo, share in ((which < upto1, orders.ranks[1], base2, base - base2), (which < upto2, orders.ranks[0], 0, base2)):
            np.putmask(ranks, has, rank)
            np.putmask(place, has, lo)
            np.putmask(freq, has, share)
        rows[step] = ranks
        k = step % REFRESH
        seen[k] = orders.seen
        hits[k] = orders.learn(ranks)
        if k == REFRESH - 1:
            shares.learn(seen, _events(hits), start.cls.take(rows[step - k:step + 1], mode=IN))
            by_slot = shares.by_slot()
        code -= r * place.view(np.uint64)
        np.multiply(r, freq.view(np.uint64), out=span)
        low = (span < BOTTOM).astype(np.uint64)
        shift = low << np.uint64(5)
        code <<= shift
        span <<= shift
        code |= words.take(at, mode=IN) * low
        at += low.view(np.int64)
    return np.ascontiguousarray(np.minimum(rows, max(0, len(start.ids) - 1)).T)
