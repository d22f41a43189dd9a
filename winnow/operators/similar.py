"""Near-identical titles: an item goes when its title is too close to one already kept.

Newest first, each title is compared with the kept ones only. A title without any close earlier title is
kept; one whose earliest close title is kept goes; one whose earliest close title went looks for the
next among the titles that still stand. So a title needs one number, the rank of its earliest close
title, and never a list of pairs: a crowd of look-alikes points at its first member and is gone at once.

No key that close titles must share is selective at the usual threshold (of two titles of 60 characters up to 18 characters may
be unmatched, anywhere). Titles meet by length instead: a title of one length bucket has all its close ones in
that bucket and its neighbours. Buckets are cut by rank into cells of bounded size, and two cells meet in one
task, whichever bucket holds most titles. There, lengths, bit vectors of bigram counts, character and bigram counts and
the longest common subsequence, found for many pairs side by side, bound the ratio from above; an alignment decides what
passes all of them."""

from __future__ import annotations

import math
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.text import normalize_title
from ..session import broadcast_if_small, written
from .ordinals import dense_ordinal
from .story import drop_retold, newest_first

# Titles of a cell in all length buckets, at most, and fewest of them: smaller cells so that a small table still uses every core. A title is
# copied, and its counts are taken, once for each cell that its own meets.
CELL, LEAST_CELL = 24576, 512
# Titles compared at once, later by earlier ones.
ROWS, COLUMNS = 256, 512
# Counting buckets for single characters and bigrams.
_BUCKETS = (64, 256)
# How often a bigram may occur before the bit vectors stop counting it.
_LEVELS = 2
# Pairs whose common subsequences are found at once, words of 64 places that the later title may have there, and buckets its
# characters fall into. Longer titles go one by one.
PAIRS, WORDS, _CHARS = 4096, 8, 128
# Steps after which pairs that cannot reach their length any more go.
STEPS = 16


def gram_bound(total_length, threshold: float, q: int):
    """Fewest q-grams two titles of this summed length share at the threshold.

    m matched characters lie in at most (unmatched + 1) runs, and a run of r characters
    holds r - q + 1 grams."""
    return total_length * ((2 * q - 1) * threshold / 2 - (q - 1)) - (q - 1)


def _counts(lengths: np.ndarray, codes: np.ndarray, q: int) -> np.ndarray:
    """q-gram counts up to 255 in hashed buckets. Merging or capping them can only bring titles nearer."""
    size = _BUCKETS[q - 1]
    row = np.repeat(np.arange(len(lengths)), lengths)
    n = max(len(codes) - q + 1, 0)
    grams = codes[:n].copy()
    for i in range(1, q):
        grams = grams * 31 + codes[i:n + i]
    inside = row[:n] == row[q - 1:]  # a gram of one title
    return np.bincount((row[:n] * size + grams % size)[inside], minlength=len(lengths) * size).reshape(-1, size)


_EVEN, _SUM = np.uint64(0x00FF00FF00FF00FF), np.uint64(0x0001000100010001)


def _apart(counts: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Summed differences of rows of counts in bytes, eight at a time."""
    words = (np.maximum(counts, other) - np.minimum(counts, other)).view(np.uint64)
    halves = ((words & _EVEN) + ((words >> np.uint64(8)) & _EVEN)).sum(axis=1, dtype=np.uint64)
    return ((halves * _SUM) >> np.uint64(48)).astype(np.int64)


def _positions(title: str) -> dict[str, int]:
    """Bit set of the places of each character."""
    bits: dict[str, int] = {}
    for i, ch in enumerate(title):
        bits[ch] = bits.get(ch, 0) | 1 << i
    return bits


def common_subsequence(positions: dict[str, int], n: int, other: str) -> int:
    """Length of the longest common subsequence, all places of one title at a time.

    A clear bit of `open_` marks a place where the best length grows by one."""
    full = open_ = (1 << n) - 1
    for ch in other:
        hit = open_ & positions.get(ch, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & full
    return n - open_.bit_count()


def common_subsequences_reach(places: np.ndarray, row: np.ndarray, texts: np.ndarray, column: np.ndarray,
                              sizes: np.ndarray, others: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which pairs, of a row of `places` and a column of `texts` with these sizes, have a common subsequence of the `least`
    length: `common_subsequence` for many pairs side by side. Never too few, and too many only where different characters
    of a pair share a bucket.

    Places that match are no further apart than characters of a title may stay unmatched, so a word of places takes part
    in some steps only; and a pair goes as soon as the rest of the text cannot make up for what it lacks."""
    reached = np.zeros(len(row), bool)
    if not len(row):
        return reached
    ahead, behind = (max(0, math.ceil((n - least).max())) for n in (sizes, others))
    pairs, base = np.arange(len(row)), row * (_CHARS + 1)
    open_ = np.full((len(places), len(row)), np.iinfo(np.uint64).max)

    def matched():
        return 64 * len(places) - np.bitwise_count(open_).sum(axis=0, dtype=np.int64)

    for step, codes in enumerate(texts):
        if step % STEPS == 0 and step:
            can = matched() + np.maximum(others - step, 0) >= least
            if not can.all():
                pairs, base, column, others, least, open_ = pairs[can], base[can], column[can], others[can], least[can], open_[:, can]
                if not len(pairs):
                    return reached
        at = base + codes.take(column)
        over = None
        for w in range(max(0, (step - behind) // 64), min(len(places), (step + ahead) // 64 + 1)):
            own = open_[w]
            hit = places[w].take(at)
            hit &= own
            grown = own + hit
            carry, over = over, grown < hit
            if carry is not None:
                grown += carry
                over |= grown < carry
            own ^= hit
            own |= grown
    reached[pairs] = matched() >= least
    return reached


class Profiles:
    """Counts of titles, one bit per bigram bucket and level that the count reaches, and the buckets of their characters."""

    def __init__(self, titles: list[str]):
        self.titles = titles
        self.sizes = np.fromiter(map(len, titles), np.int64, len(titles))
        codes = np.frombuffer("".join(titles).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        one, two = (_counts(self.sizes, codes, q) for q in (1, 2))
        self.counts = [np.minimum(c, 255).astype(np.uint8) for c in (one, two)]
        bits = np.concatenate([np.packbits(two >= k, axis=1).view(np.uint64) for k in range(1, _LEVELS + 1)], axis=1)
        self.levels = [np.ascontiguousarray(word) for word in bits.T]
        self.over = np.maximum(two - _LEVELS, 0).sum(axis=1).astype(np.int32)
        self.codes, self.begin = (codes % _CHARS).astype(np.uint8), np.cumsum(self.sizes) - self.sizes

    def texts(self, of: np.ndarray) -> np.ndarray:
        """Character buckets of these titles, a column each; below its end a column is in no bucket."""
        place = np.arange(self.sizes[of].max())[:, None]
        inside = place < self.sizes[of]
        return np.where(inside, self.codes.take(self.begin[of] + place, mode="clip"), np.uint8(_CHARS))

    def places(self, of: np.ndarray) -> np.ndarray:
        """Bit sets of the places of each character bucket in these titles, by word of 64 places."""
        texts = self.texts(of)
        out = np.zeros((-(-len(texts) // 64), len(of) * (_CHARS + 1)), np.uint64)
        at = np.arange(len(of)) * (_CHARS + 1) + texts
        for i, bucket in enumerate(at):
            out[i // 64, bucket] |= np.uint64(1 << i % 64)  # a title once in each
        out[:, _CHARS::_CHARS + 1] = 0
        return out


def close(title: str, other: str, threshold: float) -> bool:
    return SequenceMatcher(None, title, other).ratio() >= threshold


def widest(threshold: float) -> float:
    """How many times as long as the other the longer of two close titles can be."""
    return (2 - threshold) / threshold * (1 + 1e-9) if threshold > 0 else math.inf


def _subsequences_reach(later: Profiles, i: np.ndarray, places: np.ndarray | None, row: np.ndarray, earlier: Profiles, j: np.ndarray,
                        texts: np.ndarray, column: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs have a common subsequence as long as the runs of a close pair, which form one: much cheaper than to align them."""
    least = (threshold * (later.sizes[i] + earlier.sizes[j]) - 1e-6) / 2
    if places is not None:
        parts = [slice(p, p + PAIRS) for p in range(0, len(i), PAIRS)]
        return np.concatenate([np.zeros(0, bool), *(common_subsequences_reach(
            places, row[p], texts, column[p], later.sizes[i[p]], earlier.sizes[j[p]], least[p]) for p in parts)])
    most = np.empty(len(i), np.int64)
    now, positions = -1, {}
    for n, (a, b) in enumerate(zip(i.tolist(), j.tolist())):
        if a != now:
            now, positions = a, _positions(later.titles[a])
        most[n] = common_subsequence(positions, len(later.titles[a]), earlier.titles[b])
    return most >= least


def earliest_close(later: Profiles, later_ranks: np.ndarray, earlier: Profiles, earlier_ranks: np.ndarray, threshold: float) -> np.ndarray:
    """For every later title the place of the first of the earlier titles, which ascend by rank, that precedes it and is
    close to it; -1 if there is none. A shade of slack keeps rounding from hiding a pair.

    Titles of like length go together, so that those too short or too long for all of them are left out at once."""
    found = np.full(len(later.titles), -1)
    by_length = np.argsort(later.sizes, kind="stable")
    # the bound is linear: either title's part of it
    parts = [(gram_bound(2 * p.sizes, threshold, 2) / 2).astype(np.float32) for p in (later, earlier)]
    for r in range(0, len(found), ROWS):
        rows = block = by_length[r:r + ROWS]
        spot = np.zeros(len(found), np.int64)
        spot[block] = np.arange(len(block))
        places = later.places(block) if later.sizes[block[-1]] <= 64 * WORDS else None
        shortest, longest = later.sizes[block[0]], later.sizes[block[-1]]
        fits = np.flatnonzero((earlier.sizes * widest(threshold) >= shortest) & (earlier.sizes <= longest * widest(threshold)))
        for c in range(0, len(fits), COLUMNS):
            columns = fits[c:c + COLUMNS]
            rows = rows[(found[rows] < 0) & (later_ranks[rows] > earlier_ranks[columns[0]])]
            if not len(rows):
                break
            shared = np.minimum(later.over[rows][:, None], earlier.over[columns][None])
            for own, other in zip(later.levels, earlier.levels):
                shared += np.bitwise_count(own[rows][:, None] & other[columns][None])
            near = shared - parts[1][columns] >= parts[0][rows][:, None] - np.float32(0.05)
            near &= later_ranks[rows][:, None] > earlier_ranks[columns]
            i, column = np.nonzero(near)
            i, j = rows[i], columns[column]
            for q in (1, 2):
                # what two titles share of q-grams must reach the bound
                total = later.sizes[i] + earlier.sizes[j]
                apart = _apart(later.counts[q - 1][i], earlier.counts[q - 1][j])
                near = total - 2 * (q - 1) - apart >= 2 * gram_bound(total, threshold, q) - 1e-6
                i, j, column = i[near], j[near], column[near]
            if not len(i):
                continue
            texts = earlier.texts(columns) if places is not None else None
            # the first of each title alone, then the others of those it does not settle
            first = np.diff(i, prepend=-1) != 0
            for wave in (first, ~first):
                wave &= found[i] < 0
                a, b, at = i[wave], j[wave], column[wave]
                near = _subsequences_reach(later, a, places, spot[a], earlier, b, texts, at, threshold)
                for x, y in zip(a[near].tolist(), b[near].tolist()):
                    if found[x] < 0 and close(later.titles[x], earlier.titles[y], threshold):
                        found[x] = y
    return found


def _meet(threshold: float):
    """Two cells of titles in one task."""

    def run(earlier: pa.Table, later: pa.Table) -> pa.Table:
        ranks = [earlier.column("rank").to_numpy(), later.column("_rank").to_numpy()]
        titles = [earlier.column("norm").to_pylist(), later.column("_norm").to_pylist()]
        order = np.argsort(ranks[0])
        first = ranks[0][order]
        at = earliest_close(Profiles(titles[1]), ranks[1], Profiles([titles[0][i] for i in order.tolist()]), first, threshold) \
            if len(first) else np.full(len(titles[1]), -1)
        hit = at >= 0
        return pa.table([pa.array(ranks[1][hit]), pa.array(first[at[hit]] if len(first) else ranks[1][hit])], names=["rank", "found"])

    return run


def _nearest(earlier: DataFrame, later: DataFrame, threshold: float) -> DataFrame:
    """(rank, found): the rank of the earliest close title for each of `later` that has one among `earlier`."""
    # a pair of cells is met only if some later title needs it
    cells = later.select(
        "rank", "norm", F.col("block").alias("own"), F.explode(F.sequence(F.col("bucket") - 1, F.col("bucket") + 1)).alias("bucket")
    ).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), "own")))
    wanted = later.select(F.col("block").alias("own"), F.explode(F.sequence(F.col("bucket") - 1, F.col("bucket") + 1)).alias("bucket")).distinct()
    index = earlier.join(broadcast_if_small(wanted), "bucket").where("block <= own").select("rank", "norm", "bucket", "block", "own")
    keys = ["bucket", "block", "own"]
    return index.groupBy(*keys).cogroup(cells.select(*[F.col(k).alias(f"_{k}") for k in (*keys, "rank", "norm")]).groupBy(*[f"_{k}" for k in keys])).applyInArrow(
        _meet(threshold), "rank long, found long").groupBy("rank").agg(F.min("found").alias("found"))


def similar_titles(titles: DataFrame, threshold: float, cell: int | None = None) -> DataFrame:
    """tids to keep, from distinct non-empty (tid, norm, len, ord)."""
    ranked = dense_ordinal(titles, ["ord"], "rank")
    if cell is None:
        cores = titles.sparkSession.sparkContext.defaultParallelism
        cell = min(CELL, max(LEAST_CELL, math.isqrt(titles.count() ** 2 // (cores * 4))))
    bucket = F.floor(F.log(F.col("len")) / F.lit(math.log(widest(threshold)))) if threshold > 0 else F.lit(0)
    titles = written(ranked.select("tid", "norm", "rank", bucket.cast("long").alias("bucket"), F.expr(f"rank div {cell}").alias("block")), "titles")
    nodes = written(titles.select("rank").join(_nearest(titles, titles, threshold), "rank", "left").withColumn("state", F.lit("open")), "nodes")
    while True:
        of = nodes.select(F.col("rank").alias("found"), F.col("state").alias("of"))
        nodes = written(nodes.join(of, "found", "left").select("rank", "found", F.when(F.col("state") != "open", F.col("state"))
                       .when(F.col("found").isNull(), "kept").when(F.col("of") == "kept", "dropped")
                       .when(F.col("of") == "dropped", "search").otherwise("open").alias("state")), "nodes")
        states = {r["state"] for r in nodes.select("state").distinct().collect()}  # four at most
        if not states & {"open", "search"}:
            return titles.join(nodes.where("state = 'kept'"), "rank").select("tid")
        if "search" in states:
            later = titles.join(nodes.where("state = 'search'").select("rank"), "rank")
            earlier = titles.join(nodes.where("state = 'dropped'").select("rank"), "rank", "left_anti")
            again = _nearest(earlier, later, threshold).select("rank", F.col("found").alias("again"))
            search = F.col("state") == "search"
            nodes = written(nodes.join(again, "rank", "left").select(
                "rank", F.when(search, F.col("again")).otherwise(F.col("found")).alias("found"), F.when(search, "open").otherwise(F.col("state")).alias("state")), "nodes")


def dedupe_content(items: DataFrame, similarity_threshold: float = 0.85, story_dedupe: bool = False,
                   story_containment_threshold: float = 0.6, cell: int | None = None) -> DataFrame:
    """Drop items whose title nearly equals a kept newer one's, and with story_dedupe
    items retelling an earlier one of their source.

    Copies of a title collapse to the newest before any comparison; an item without a
    usable title resembles nothing. Order of the result: newest first, undated last."""
    if similarity_threshold >= 1.0 and not story_dedupe:
        return items
    left = drop_retold(items, story_containment_threshold) if story_dedupe else items
    placed = left.withColumn("_ord", newest_first(F.col("published"), F.col("item_ord"))).withColumn(
        "_norm", normalize_title(F.col("title")))
    titles = (
        placed.where(F.col("_norm") != "").groupBy(F.col("_norm").alias("norm"))
        .agg(F.min("_ord").alias("ord"), F.min_by("item_id", "_ord").alias("tid"))
        .select("tid", "norm", F.length("norm").alias("len"), "ord")
    )
    if similarity_threshold > 1.0:
        result = left
    else:
        kept = titles.select("tid") if similarity_threshold == 1.0 else similar_titles(
            titles, similarity_threshold, cell)
        untitled = placed.where(F.col("_norm") == "").select(F.col("item_id").alias("tid"))
        result = left.join(kept.unionAll(untitled), left["item_id"] == F.col("tid"), "left_semi")
    return result.select(items.columns)
