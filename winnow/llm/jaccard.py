"""N-gram Jaccard join in the metric space of shingle sets: pivots, regions, windows."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import WordHashes, arrow_map, byte_texts, gram_hashes, mix64, narrow, written
from .components import components

SHINGLE = 5
THRESHOLD = 75  # per cent
# Shingles counted together; of one count, those seen this often are reported.
COUNT_CHUNK, COUNT_LEAST = 2_000_000, 8
# Most frequent shingles that are ordered by count; it is an order only, any list is right.
FREQUENT = 200_000
# Shingles, over all its documents, of a region that one task joins.
LEAF_SHINGLES = 3_000_000
# Documents whose signatures one task compares; a larger region goes in blocks of half as many, every two of them together.
SCREEN_DOCS = 8192
# Pivots a larger region is cut by, and documents compared with pivots in one run of rows.
PIVOTS, RUN_ROWS = 32, 4096
# Stands for a null id: not smaller than any.
NO_ID = (1 << 63) - 1
# Times a region may be cut before its rest is joined in blocks.
DEPTH = 4


def shingles(text: bytes, known: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; with fewer words, of the whole sequence."""
    words = text.lower().split()  # on bytes: A-Z only, and no other white space than 20 and 09 to 0D
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(known.of(words), min(size, len(words))))


def signature(own: np.ndarray) -> bytes:
    """Parity of the shingles in each of 2n or more buckets, a power of two. The bits in which two
    signatures differ are at most the shingles in which the sets differ; a longer one folds onto a
    shorter by exclusive or."""
    bits = min(1 << 17, max(64, 1 << int(2 * len(own) - 1).bit_length())) if len(own) else 64
    parity = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8)).tobytes()


def may_link(signatures: list[bytes], sizes: np.ndarray, labels: np.ndarray, threshold: int, first: int | None = None):
    """Which documents may link with one of another label, and which with document `first`, as far
    as sizes and signatures tell. Never misses a link."""
    n = len(sizes)
    any_, with_first = np.zeros(n, bool), np.zeros(n, bool)
    width = np.array([len(x) for x in signatures])
    for w in np.unique(width).tolist():
        # linked sizes differ by 100 / threshold times at most, and a width by less than two times from its size's share
        at = np.flatnonzero((width >= w) & (width * threshold < 200 * w))
        own = width[at] == w
        folded = np.empty((len(at), w // 8), np.uint64)
        for row, i in enumerate(at.tolist()):
            raw = np.frombuffer(signatures[i], np.uint64)
            folded[row] = raw if own[row] else np.bitwise_xor.reduce(raw.reshape(-1, w // 8), axis=0)
        both = sizes[at].astype(np.int64)
        for row in np.flatnonzero(own).tolist():
            total = both + both[row]
            near = (100 + threshold) * (total - np.bitwise_count(folded ^ folded[row]).sum(1, dtype=np.int64)) >= 2 * threshold * total
            near &= labels[at] != labels[at[row]]
            near[row] = False
            if near.any():
                any_[at[near]] = any_[at[row]] = True
                if at[row] == first:
                    with_first[at[near]] = True
                elif first is not None and near[at == first].any():
                    with_first[at[row]] = True
    return any_, with_first


def linked(inter, a, b, threshold: int):
    return 100 * inter >= threshold * (a + b - inter)


def _frequent(size):
    def run(batches):
        known, held, count = WordHashes(), [], 0

        def close():
            s, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= COUNT_LEAST
            return pa.RecordBatch.from_arrays([pa.array(s[often].view(np.int64)), pa.array(n[often].astype(np.int64))], names=["s", "n"])

        for b in batches:
            for text in byte_texts(b.column("text")):
                own = shingles(text, known, size)
                held.append(own)
                count += len(own)
                if count >= COUNT_CHUNK:
                    yield close()
                    held, count = [], 0
        if held:
            yield close()

    return run


def _prefixes(size, threshold, hot, hot_n):
    """Per document its set's size and, for the first of equal sets in a task, prefix and signature."""

    def run(batches):
        known, seen, made = WordHashes(), {}, 0
        part = TaskContext.get().partitionId() << 33
        for b in batches:
            rep, sizes, cold, crowded, marks = [], [], [], [], []
            for text in byte_texts(b.column("text")):
                own = shingles(text, known, size)
                n = len(own)
                digest = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                if n and digest in seen:
                    rep.append(seen[digest])
                    sizes.append(n)
                    cold.append(None)
                    crowded.append(None)
                    marks.append(None)
                    continue
                uid = part + made
                made += 1
                if len(seen) >= 500_000:
                    seen.clear()
                seen[digest] = uid
                take = n - -(-threshold * n // 100) + 1 if n else 0
                often = np.zeros(n, np.int64)
                if len(hot) and n:
                    at = np.minimum(np.searchsorted(hot, own), len(hot) - 1)
                    often = np.where(hot[at] == own, hot_n[at], 0)
                mixed = mix64(own)
                order = np.lexsort((mixed, often))[:take]
                first, many = own[order].view(np.int64), often[order] > 0
                rep.append(uid)
                sizes.append(n)
                cold.append(first[~many])
                crowded.append(first[many])
                marks.append(signature(own))
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), b.column("hash"), pa.array(rep, pa.int64()), pa.array(sizes, pa.int32()),
                pa.array(cold, pa.list_(pa.int64())), pa.array(crowded, pa.list_(pa.int64())), pa.array(marks, pa.binary())],
                names=["doc_id", "hash", "uid", "n", "cold", "crowded", "signature"])

    return run


def _stars(threshold):
    """Rows (s, uid, n) sorted by s, uid -> (pivot, uid): the first of each cell is its pivot.
    A cell of two whose sizes rule a link out is left out: it holds no other pair."""

    def run(batches):
        rest = None  # the last cell so far, which may go on
        for b in batches:
            s, uid, n = (b.column(k).to_numpy().astype(np.int64) for k in ("s", "uid", "n"))
            if rest is not None:
                s, uid, n = (np.concatenate(x) for x in zip(rest, (s, uid, n)))
            if not len(s):
                continue
            start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            # a cell that goes on keeps its pivot and one more row, which is enough to go by
            done = start[-1]
            yield from cells(s[:done], uid[:done], n[:done], start[:-1])
            tail = slice(done, None)
            if len(s) - done > 3:
                yield from cells(s[tail], uid[tail], n[tail], np.array([0]))
                tail = [done, done + 1, done + 2]
            rest = s[tail], uid[tail], n[tail]
        if rest is not None:
            yield from cells(*rest, np.array([0]))

    def cells(s, uid, n, start):
        if not len(s):
            return
        size = np.diff(np.concatenate([start, [len(s)]]))
        pivot, pivot_n = np.repeat(uid[start], size), np.repeat(n[start], size)
        fits = 100 * np.minimum(n, pivot_n) >= threshold * np.maximum(n, pivot_n)
        take = (uid != pivot) & (fits | (np.repeat(size, size) > 2))
        if take.any():
            pairs = np.unique(np.stack([pivot[take], uid[take]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["pivot", "uid"])

    return run


def _screened(threshold):
    """Rows sorted by region and part -> those that may link with another label in their part of the region."""

    def survivors(rows):
        pivot = next((i for i, r in enumerate(rows) if r[0] == r[4]), None)
        any_, with_pivot = may_link([r[3] for r in rows], np.array([r[2] for r in rows]), np.array([r[1] for r in rows]), threshold, pivot)
        return [(rows[i][0], rows[i][1], rows[i][2], bool(with_pivot[i]) or i == pivot) for i in np.flatnonzero(any_).tolist()]

    def run(batches):
        key, rows = None, []
        for b in batches:
            out = []
            for region, part, *row in zip(*[b.column(k).to_pylist() for k in ("region", "part", "uid", "label", "n", "signature", "pivot")]):
                if (region, part) != key:
                    out += [(key[0], *r) for r in survivors(rows)] if rows else []
                    key, rows = (region, part), []
                rows.append(row)
            if out:
                yield found(out)
        if rows and (out := [(key[0], *r) for r in survivors(rows)]):
            yield found(out)

    def found(out):
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=["region", "uid", "label", "n", "with_pivot"])

    return run


def _screen(members: DataFrame, marks: DataFrame, threshold: int, screen_docs: int) -> DataFrame:
    """(region, uid, label, pivot) to (region, uid, label, n, with_pivot): members that may link, by size
    and signature, with a member of another label; `with_pivot`: also with the pivot. A region too
    large for one task is dealt in blocks, and a task gets two of them, so that every two members meet in some task."""
    sizes = members.groupBy("region").agg(F.count("*").alias("size")).select(
        "region", F.when(F.col("size") > screen_docs, F.ceil(2 * F.col("size") / screen_docs)).otherwise(1).cast("int").alias("blocks"))
    block, blocks = F.pmod(F.xxhash64("uid", F.lit("screen")), F.col("blocks")).cast("int"), F.col("blocks")
    others = F.filter(F.sequence(F.lit(0), blocks - 1), lambda x: (x != F.col("block")) | (blocks == 1))
    rows = members.join(sizes, "region").join(marks, "uid").withColumn("block", block).withColumn("other", F.explode(others)).select(
        "region", (F.least("block", "other").cast("long") * blocks + F.greatest("block", "other")).alias("part"), "uid", "label", "n", "signature", "pivot")
    told = arrow_map(rows.repartition("region", "part").sortWithinPartitions("region", "part"), _screened(threshold),
                     "region string, uid long, label long, n int, with_pivot boolean")
    return told.groupBy("region", "uid").agg(F.first("label").alias("label"), F.first("n").alias("n"), F.max("with_pivot").alias("with_pivot"))


def _distances(size, threshold, window):
    """Rows sorted by (region, run, pivots first) -> the region's documents against its pivots.

    One row per document and pivot whose region it belongs to: the nearest, and by the triangle
    inequality every other one that is no more than two windows farther."""

    def run(batches):
        known, key, pivots = WordHashes(), None, []
        for b in batches:
            out = ([], [], [], [], [], [])
            for region, run_no, uid, is_pivot, text in zip(
                    *[b.column(k).to_pylist() for k in ("region", "run", "uid", "is_pivot")], byte_texts(b.column("text"))):
                if (region, run_no) != key:
                    key, pivots = (region, run_no), []
                own = shingles(text, known, size)
                if is_pivot:
                    pivots.append((uid, own))
                    continue
                each = []
                for pivot, other in pivots:
                    inter = len(own) if pivot == uid else len(np.intersect1d(own, other, assume_unique=True))
                    each.append((1 - inter / max(1, len(own) + len(other) - inter), pivot, bool(linked(inter, len(own), len(other), threshold))))
                nearest = min(each)[0]
                for d, pivot, link in each:
                    if d <= nearest + 2 * window + 1e-9 or link:
                        for column, v in zip(out, (region, pivot, uid, d, link, len(own))):
                            column.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.float64()),
                                                  pa.array(out[4], pa.bool_()), pa.array(out[5], pa.int32())], names=["region", "pivot", "uid", "d", "link", "n"])

    return run


def join_region(uids: list[int], labels: list[int], sets: list[np.ndarray], threshold: int, left: int | None = None) -> list[tuple[int, int]]:
    """Links that make the documents' components whole, where equal labels already are.

    A document is compared with all later ones through the shingles they share, unless
    none of them has another label. With `left`, only pairs of one of the first `left` documents."""
    n = len(sets)
    if n < 2:
        return []
    lengths = np.array([len(s) for s in sets])
    label = np.unique(np.array(labels), return_inverse=True)[1]
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), lengths)
    _, group, count = np.unique(flat, return_inverse=True, return_counts=True)
    common = count[group] > 1
    group, owner = group[common], owner[common]
    order = np.argsort(group, kind="stable")
    posting = owner[order]
    begin = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=len(count)))])
    own_start = np.searchsorted(owner, np.arange(n + 1))
    out = []
    for x in range(n - 1 if left is None else min(left, n - 1)):
        open_ = label[x + 1:] != label[x]
        if not open_.any():
            if (label == label[0]).all():
                break
            continue
        mine = group[own_start[x]:own_start[x + 1]]
        if not len(mine):
            continue
        size = begin[mine + 1] - begin[mine]
        at = np.repeat(begin[mine] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        inter = np.bincount(posting[at], minlength=n)[x + 1:]
        hits = np.flatnonzero(open_ & linked(inter, lengths[x], lengths[x + 1:], threshold)) + x + 1
        for y in hits.tolist():
            if label[y] != label[x]:
                out.append((uids[x], uids[y]))
                label[label == label[y]] = label[x]
    return out


def _leaves(size, threshold):
    """Rows sorted by (region, side) -> links; a region with sides joins side 0 with both."""

    def links(known, rows):
        rows.sort(key=lambda r: r[0])
        left = sum(1 for r in rows if r[0] == 0) if rows[-1][0] else None
        return join_region([r[1] for r in rows], [r[2] for r in rows], [shingles(r[3], known, size) for r in rows], threshold, left)

    def run(batches):
        known, key, rows = WordHashes(), None, []
        for b in batches:
            out = []
            for region, side, uid, label, text in zip(*[b.column(k).to_pylist() for k in ("region", "side", "uid", "label")], byte_texts(b.column("text"))):
                if region != key:
                    out += links(known, rows) if rows else []
                    key, rows = region, []
                rows.append((side, uid, label, text))
            if out:
                yield pairs(out)
        if rows and (out := links(known, rows)):
            yield pairs(out)

    def pairs(out):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["u", "v"])

    return run


def _compare(members: DataFrame, pivots: DataFrame, texts: DataFrame, size: int, threshold: int) -> DataFrame:
    """Distances of every region's documents, pivots included, to its pivots. A region goes in runs of
    bounded length, each with the pivots in front, so one that holds a third of all rows is spread."""
    runs = members.groupBy("region").agg(F.ceil(F.count("*") / RUN_ROWS).cast("int").alias("runs"))
    own = members.join(runs, "region").select(
        "region", F.pmod(F.xxhash64("uid"), F.col("runs")).cast("int").alias("run"), "uid", F.lit(False).alias("is_pivot"))
    front = pivots.join(runs, "region").select(
        "region", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run"), "uid", F.lit(True).alias("is_pivot"))
    rows = own.unionByName(front).join(texts.select("uid", "text"), "uid")
    dealt = rows.repartition("region", "run").sortWithinPartitions("region", "run", F.col("is_pivot").desc(), "uid")
    return arrow_map(dealt.select("region", "run", "uid", "is_pivot", "text"), _distances(size, threshold, 1 - threshold / 100),
                     "region string, pivot long, uid long, d double, link boolean, n int")


def _halved(near: DataFrame, sized: DataFrame) -> DataFrame:
    """Regions that their pivots' cells, which overlap, cut to half the pairs at least. Where nearly all distances are alike every
    document belongs to every cell, and cells of cells would hold the region many times over."""
    cells = near.groupBy("region", "pivot").agg(F.sum("n").cast("double").alias("cell_n"))
    pairs = cells.groupBy("region").agg(F.sum(F.col("cell_n") * F.col("cell_n")).alias("pairs"))
    return pairs.join(sized, "region").where(2 * F.col("pairs") <= F.col("all_n").cast("double") * F.col("all_n")).select("region")


def _open(members: DataFrame, labels: DataFrame, window: float) -> DataFrame:
    """Members (region, uid, d or null) of regions that may still hold a link between components.

    A link joins documents of two labels whose distances to the pivot differ by a window at most.
    In each region the label nearest to the pivot is settled among itself; documents nearer to the pivot
    than the nearest of another label less the window can have no link that matters. A distance that was
    not taken is more than a window."""
    named = members.join(labels.withColumnRenamed("node", "uid"), "uid", "left").withColumn("label", F.coalesce("label", "uid"))
    about = named.groupBy("region").agg(F.count("*").alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi"),
                                       F.coalesce(F.min_by("label", "d"), F.min("label")).alias("main"))
    named = named.join(about.where("size > 1 and lo != hi").select("region", "main"), "region")
    near = named.where("label != main").groupBy("region").agg(F.min(F.coalesce("d", F.lit(window))).alias("fringe"))
    return named.join(near, "region").where(F.col("d").isNull() | (F.col("d") >= F.col("fringe") - window - 1e-9)).select(
        "region", "uid", "label", F.lit(None).cast("long").alias("pivot"))


def near_copies(docs: DataFrame, threshold: int = THRESHOLD, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text",
                leaf_shingles: int = LEAF_SHINGLES, screen_docs: int = SCREEN_DOCS, n_pivots: int = PIVOTS, depth: int = DEPTH) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included), text_hash
    (xxhash64 of the text, null as empty), kept: the one (doc_id, text_hash) of each component that is
    smallest, null ids last; rows equal in both are alike.

    Two documents link when their sets of `size`-word shingles, lower-cased in A-Z, overlap in at least
    `threshold` per cent of their union: when their Jaccard distance, a metric, is within the window.

    1. Nearly all documents are at distance 1 from each other, where pivots tell nothing. So the
       space is first cut into cells: ordered by frequency, linked sets share one of their first
       n - ceil(t n) + 1 shingles. Each cell's first document is its pivot; all cells of a pivot form its region.
    2. Sizes and parity signatures, whose difference is never more than the sets' own, rule out most
       pairs of a region. Exact distances to the pivot link documents within the window; linked ones are
       a component.
    3. Regions in which two components could still link, by the triangle inequality, are joined
       exactly in one task if small. Larger ones get pivots of their own, every document goes to
       the nearest one's Voronoi region and, within two windows, to the neighbouring ones, and these go
       the same way. Where the regions do not halve the pairs, the larger one is joined in blocks, exactly too.

    Texts without words, null or empty, have no shingles and link with nothing. Null ids are
    never the smallest; a component of null ids only has a null component_id. Repeated rows link with each
    other. No rows give no rows."""
    window = 1 - threshold / 100
    rows = narrow(docs, doc_id=id_col, text=text_col).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumns(
        {"hash": F.xxhash64("text"), "doc": F.coalesce("doc_id", F.lit(NO_ID))})
    often = arrow_map(rows.select("text"), _frequent(size), "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))
    listed = often.orderBy(F.col("n").desc(), "s").limit(FREQUENT).toArrow()  # bounded
    hot, hot_n = listed.column("s").to_numpy().view(np.uint64), listed.column("n").to_numpy()
    order = np.argsort(hot)
    table = written(arrow_map(rows, _prefixes(size, threshold, hot[order], hot_n[order]),
                              "doc_id long, hash long, uid long, n int, cold array<long>, crowded array<long>, signature binary"), "prefixes")

    cold = table.where("size(cold) > 0").select(F.explode("cold").alias("s"), "uid", "n").repartition("s").sortWithinPartitions("s", "uid")
    pairs = arrow_map(cold, _stars(threshold), "pivot long, uid long")
    crowd = table.where("size(crowded) > 0").select(F.explode("crowded").alias("s"), "uid")
    heads = crowd.groupBy("s").agg(F.min("uid").alias("pivot"))
    pairs = written(pairs.unionByName(crowd.join(heads, "s").where("uid != pivot").select("pivot", "uid")).distinct(), "stars")
    pivots = pairs.select("pivot").distinct().select(F.col("pivot").cast("string").alias("region"), F.col("pivot").alias("uid"), "pivot")
    members = pairs.select(F.col("pivot").cast("string").alias("region"), "uid", "pivot").unionByName(pivots)
    marks = table.where("signature is not null").select("uid", "n", "signature")
    members = written(_screen(members.withColumn("label", F.col("uid")), marks, threshold, screen_docs), "members")

    # the first of equal sets in each task stands for them
    uids = table.where("cold is not null").select("uid", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "hash").join(
        members.select("uid").distinct(), "uid")
    texts = written(rows.select("doc", "hash", "text").join(uids, ["doc", "hash"]).dropDuplicates(["doc", "hash", "uid"]).select("uid", "text"), "texts")

    star = members.where("with_pivot").select("region", "uid")
    centres = star.where("region = cast(uid as string)")
    near = written(_compare(star, centres, texts, size, threshold), "near")
    links = near.where("link").select(F.col("pivot").alias("u"), F.col("uid").alias("v"))
    labels = components(links)
    measured = members.select("region", "uid").join(near.select("region", "uid", "d").dropDuplicates(["region", "uid"]), ["region", "uid"], "left")
    regions = written(_screen(_open(measured, labels, window), marks, threshold, screen_docs).drop("with_pivot"), "regions")
    for level in range(depth + 1):
        sized = regions.groupBy("region").agg(F.sum("n").alias("all_n"), F.count("*").alias("count"))
        regions = regions.join(sized, "region")
        small = regions.where(F.col("all_n") <= leaf_shingles).select("region", F.lit(0).alias("side"), "uid", "label")
        found = [_join_leaves(small, texts, size, threshold)]
        large = written(regions.where(F.col("all_n") > leaf_shingles), "large")
        more = not large.isEmpty()
        if more and level == depth:
            found.append(_join_leaves(_blocks(large, leaf_shingles), texts, size, threshold))
        elif more:
            chance = F.abs(F.xxhash64("uid", F.lit(level)) / F.lit(float(1 << 63)))
            drawn = large.withColumn("chance", chance)
            least = drawn.groupBy("region").agg(F.min("chance").alias("least"))
            centres = drawn.join(least, "region").where((F.col("chance") * F.col("count") < n_pivots) | (F.col("chance") == F.col("least"))).select("region", "uid")
            near = written(_compare(large.select("region", "uid"), centres, texts, size, threshold), "near")
            found.append(near.where("link").select(F.col("pivot").alias("u"), F.col("uid").alias("v")))
            halved = written(_halved(near, sized), "halved")
            found.append(_join_leaves(_blocks(large.join(halved, "region", "left_anti"), leaf_shingles), texts, size, threshold))
            near = near.join(halved, "region", "left_semi")
        for more_links in found:
            links = links.unionByName(more_links)
        links = written(links, "links")
        labels = components(links)
        if not more or level == depth or halved.isEmpty():
            break
        cells = near.select(F.concat_ws("/", "region", "pivot").alias("region"), "uid", "d")
        regions = written(_screen(_open(cells, labels, window), marks, threshold, screen_docs).drop("with_pivot"), "regions")

    rows = table.select("doc_id", "hash", F.col("n").alias("n_shingles"), "uid")
    joined = rows.join(labels, rows["uid"] == labels["node"], "left").select("doc_id", "hash", "n_shingles", F.coalesce("label", "uid").alias("label"))
    least = joined.where("n_shingles > 0").groupBy("label").agg(
        F.min("doc_id").alias("least"), F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "hash")).alias("first")).withColumnRenamed("label", "_label")
    return joined.join(least, (joined["label"] == least["_label"]) & (joined["n_shingles"] > 0), "left").select(
        "doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"),
        F.col("hash").alias("text_hash"),
        ((F.col("n_shingles") == 0) | (F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "hash") == F.col("first"))).alias("kept"))


def _join_leaves(rows: DataFrame, texts: DataFrame, size: int, threshold: int) -> DataFrame:
    dealt = rows.join(texts, "uid").repartition("region").sortWithinPartitions("region", "side")
    return arrow_map(dealt.select("region", "side", "uid", "label", "text"), _leaves(size, threshold), "u long, v long")


def _blocks(large: DataFrame, leaf_shingles: int) -> DataFrame:
    """A region as blocks of bounded size, and a leaf for every two of them."""
    blocked = large.withColumn("blocks", F.ceil(2 * F.col("all_n") / leaf_shingles).cast("int")).withColumn(
        "block", F.pmod(F.xxhash64("uid", F.lit("block")), F.col("blocks")).cast("int"))
    return blocked.select("region", "uid", "label", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        F.concat_ws("/", "region", F.least("block", "other"), F.greatest("block", "other")).alias("region"),
        F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"), "uid", "label")
