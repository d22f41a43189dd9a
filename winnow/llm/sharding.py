"""Shards of near equal bytes by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq
import math

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import arrow_map, narrow, running, written

# Items one differencing pass holds at a time.
CHUNK = 20_000


def difference(items: list[list[int]], bins: int) -> tuple[list[int], list[list[tuple[int, int]]]]:
    """Combine partial partitions until one is left; returns its sums and, per bin, the
    (item, item's own bin) it holds.

    An item is a list of sums, one per bin; a plain size is a list of one. The two partial
    partitions with the largest spread are joined, the fullest bin of one with the emptiest
    of the other."""
    heap = []
    for i, sums in enumerate(items):
        own = sorted(((s, [(i, j)]) for j, s in enumerate(sums)), key=lambda b: -b[0])
        own += [(0, []) for _ in range(bins - len(own))]
        own.sort(key=lambda b: -b[0])
        heap.append((own[-1][0] - own[0][0], i, own))
    heapq.heapify(heap)
    order = len(items)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        joined = []
        for (x, p), (y, q) in zip(a, reversed(b)):
            if len(p) < len(q):
                p, q = q, p
            p.extend(q)
            joined.append((x + y, p))
        joined.sort(key=lambda t: -t[0])
        heapq.heappush(heap, (joined[-1][0] - joined[0][0], order, joined))
        order += 1
    last = heap[0][2]
    return [s for s, _ in last], [m for _, m in last]


def _pass(bins: int, chunk: int):
    def run(batches):
        part, number = TaskContext.get().partitionId(), 0

        def flush(names, items):
            parent = f"{part}-{number}"
            sums, held = difference(items, bins)
            own: dict[int, list[int]] = {i: [0] * len(s) for i, s in enumerate(items)}
            for b, members in enumerate(held):
                for i, j in members:
                    own[i][j] = b
            return pa.RecordBatch.from_pydict({
                "parent": [parent] * (len(names) + 1), "item": [*names, None],
                "bins": pa.array([*[own[i] for i in range(len(names))], None], pa.list_(pa.int32())),
                "sums": pa.array([*[None] * len(names), sums], pa.list_(pa.int64())),
            })

        names, items = [], []
        for b in batches:
            for name, sums in zip(b.column("item").to_pylist(), b.column("sums").to_pylist()):
                names.append(name)
                items.append(sums)
                if len(items) == chunk:
                    yield flush(names, items)
                    names, items, number = [], [], number + 1
        if items:
            yield flush(names, items)

    return run


def assign(groups: DataFrame, bins: int, chunk: int = CHUNK) -> DataFrame:
    """(item, size) to (item, shard). Each task differences its own groups; the partial
    partitions that come out are items of the next level, until one is left."""
    level = groups.select("item", F.array(F.col("size").cast("long")).alias("sums"))
    placed = None
    while True:
        out = written(arrow_map(level, _pass(bins, chunk), "parent string, item string, bins array<int>, sums array<long>"), "shards")
        held = out.where(F.col("sums").isNull()).select("parent", "item", "bins")
        if placed is None:
            placed = held.select("item", "parent", F.col("bins")[0].alias("bin"))
        else:
            up = held.select(F.col("item").alias("_child"), F.col("parent").alias("_next"), F.col("bins").alias("_bins"))
            placed = placed.join(up, placed["parent"] == up["_child"]).select(
                "item", F.col("_next").alias("parent"), F.expr("_bins[bin]").alias("bin"))
        partials = out.where(F.col("sums").isNotNull()).select(F.col("parent").alias("item"), "sums")
        n = partials.count()
        if n <= 1:
            return placed.select("item", F.col("bin").alias("shard"))
        level = partials.repartition(math.ceil(n / chunk))


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Place every row in one of `shards` shards of near equal bytes; equal texts share a shard.

    Returns doc_id, size (UTF-8 bytes plus 1), text_crc32, law ('bytes'), shard, slot (0, 1, ...
    within the shard by doc_id), grown_shard (null under this law). A null text is an empty
    one and goes with the empty texts. Null and repeated ids are rows like any other, each with
    its own slot; null ids stand last. An empty table gives no rows. A group of equal texts
    larger than a fair share fills its shard alone. Other columns of the input are not read."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = written(narrow(docs, doc_id=id_col, text=text_col).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"),
        F.md5(text).alias("item")), "rows")
    groups = rows.groupBy("item").agg(F.sum("size").alias("size"))
    placed = assign(groups, shards, chunk).withColumnRenamed("item", "_item")
    rows = rows.join(placed, rows["item"] == placed["_item"]).select("doc_id", "size", "text_crc32", "shard")
    rows = running(rows, ["doc_id", "size", "text_crc32"], F.lit(1), ["shard"], "slot")
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))
