"""Prefix trie of conversations, by digests of blocks of turns."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import arrow_map, narrow, written

# Turns of a block.
BLOCK = 4
# Prefix digests are four sums of digest * base ** block modulo a prime below 2 ** 31.
PRIME = 2147483647
BASES = (1103515245, 1597334677, 1812433253, 1664525)
# Conversations under one id of a family, and the turns at most that are taken over from the first of it.
FAMILY, SHARED = 20, 4
# Characters of ids digested at once.
CHUNK = 1 << 16

WORD = r"[^\x20\x09-\x0D]+"


def _binary16(digest: Column) -> Column:
    return F.substring(F.unhex(digest), 1, 16)


def _scan(extra: Callable[[pa.RecordBatch], np.ndarray], n: int, drop: tuple[str, ...] = ()):
    """Adds to rows sorted by conv: own values v0.., sums b0.. over the conversation's earlier rows of this part, the
    row's place in the part, and whether its conversation is the part's first."""

    def run(batches):
        first = last = None
        carry, place = np.zeros(n, np.int64), 0
        for b in batches:
            if not b.num_rows:
                continue
            conv = b.column("conv").to_numpy()
            own = extra(b)
            upto = np.cumsum(own, axis=0)
            begins = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
            base = (upto - own)[begins]
            if last is not None and conv[0] == last:
                base[0] -= carry
            size = np.diff([*begins.tolist(), len(conv)])
            before = upto - own - np.repeat(base, size, axis=0)
            first = conv[0] if first is None else first
            last, carry = conv[-1], (before + own)[-1]
            keep = [c for c in b.schema.names if c not in drop]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in keep], *[pa.array(own[:, i]) for i in range(n)], *[pa.array(before[:, i]) for i in range(n)],
                 pa.array(np.arange(place, place + len(conv))), pa.array(conv == first)],
                names=[*keep, *[f"v{i}" for i in range(n)], *[f"b{i}" for i in range(n)], "_place", "_head"])
            place += len(conv)

    return run


def along(df: DataFrame, order: list[Column], extra, n: int, name: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """Running sums within each conversation: adds v0.. (the row's values) and b0.. (their sums over earlier rows).

    Rows are range-sorted by (conv, order), so a conversation with most of the rows lies in many tasks; each adds up its own
    part, and what earlier parts hold of a part's first conversation is added from one row per part."""
    keys = [F.col("conv").asc(), *order]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id())
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema if f.name not in drop]
    sums = [f"{c}{i} long" for c in "vb" for i in range(n)]
    placed = written(arrow_map(placed, _scan(extra, n, drop), ", ".join([*kinds, *sums, "_place long", "_head boolean"])), name)
    tails = placed.groupBy("_part").agg(
        F.min("conv").alias("_first"), F.max("conv").alias("_last"),
        *[F.max_by(F.col(f"v{i}") + F.col(f"b{i}"), "_place").alias(f"t{i}") for i in range(n)])
    # one row per part: bounded by the number of partitions
    so_far = Window.partitionBy("_last").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    line = Window.orderBy("_part")
    carried = tails.withColumns({f"t{i}": F.sum(f"t{i}").over(so_far) for i in range(n)})
    carried = carried.select("_part", *[
        F.when(F.lag("_last").over(line) == F.col("_first"), F.lag(f"t{i}").over(line)).otherwise(0).alias(f"c{i}") for i in range(n)])
    total = placed.join(F.broadcast(carried), "_part")
    return total.withColumns({f"b{i}": F.col(f"b{i}") + F.when(F.col("_head"), F.col(f"c{i}")).otherwise(0) for i in range(n)}).drop(
        "_part", "_place", "_head", *[f"c{i}" for i in range(n)])


def numbered(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, pos (from 0), digest of role and text, words of the text, for every turn.

    Turns stand in the order of `turn`, null first, and of their digests where it is equal. Null roles and texts are
    empty. Rows without a conversation id belong to none and are left out."""
    rows = narrow(conversations, conv=conv_col, turn=turn_col, role=role_col, text=text_col).where("conv IS NOT NULL")
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    rows = rows.select(
        F.col("conv").cast("long").alias("conv"), "turn",
        _binary16(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long").alias("words"))
    placed = along(rows, [F.col("turn").asc_nulls_first(), F.col("digest").asc()], lambda b: np.ones((b.num_rows, 1), np.int64), 1, "turns", ("turn",))
    return placed.select("conv", F.col("b0").alias("pos"), "digest", "words")


def rebuilt(turns: DataFrame) -> DataFrame:
    """Turns of the conversations rebuilt: conversation c starts with the first h turns of the first conversation of its
    family, c - c % 20 (all if it has fewer, none if there is none), and goes on with its own after its first h, where h is
    crc32(c) % 4. Every conversation also has a row without digest after its last turn, so those without turns stay."""
    convs = turns.groupBy("conv").agg(F.count("*").alias("n")).withColumns({
        "h": (F.crc32(F.col("conv").cast("string").cast("binary")) % SHARED).cast("int"), "base": F.col("conv") - F.col("conv") % FAMILY})
    heads = turns.where(f"conv % {FAMILY} = 0 AND pos < {SHARED - 1}").groupBy(F.col("conv").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "digest", "words"))).alias("heads"))
    convs = convs.join(heads, "base", "left").withColumn("heads", F.expr("slice(heads, 1, h)"))
    convs = written(convs.withColumn("k", F.coalesce(F.when(F.col("heads").isNotNull(), F.size("heads")), F.lit(0))), "convs")
    shared = convs.select("conv", F.explode("heads").alias("t")).select("conv", "t.*")
    own = turns.join(convs.select("conv", "h", "k"), "conv").where("pos >= h").select("conv", F.expr("pos - h + k").alias("pos"), "digest", "words")
    ends = convs.select("conv", F.expr("k + greatest(n - h, 0)").alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("words"))
    return shared.unionByName(own).unionByName(ends)


def ended(turns: DataFrame) -> DataFrame:
    """Turns as they are, with the row after the last one that trie() wants."""
    ends = turns.groupBy("conv").agg(F.count("*").alias("pos")).select(
        "conv", "pos", F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("words"))
    return turns.unionByName(ends)


def _block_values(batch: pa.RecordBatch) -> np.ndarray:
    """Four digests of a block, each times its base to the power of the block's number, and its words."""
    raw = np.frombuffer(b"".join(batch.column("own").to_pylist()), "<u4").reshape(-1, 4).astype(np.int64) % PRIME
    power = batch.column("blk").to_numpy().copy()
    factor, square = np.ones((len(power), 4), np.int64), np.array(BASES, np.int64)
    while power.any():
        factor = np.where((power & 1).astype(bool)[:, None], factor * square % PRIME, factor)
        square, power = square * square % PRIME, power >> 1
    return np.concatenate([raw * factor % PRIME, batch.column("words").to_numpy()[:, None]], axis=1)


def _joined(digests: Column, n: Column) -> Column:
    return F.aggregate(F.slice(digests, 1, n), F.lit(b""), lambda a, d: F.concat(a, d))


def _spelled(edges: DataFrame, values: list[str]) -> DataFrame:
    """A row for each turn of each block, as a node: id, parent, depth, digest, words, words before it, and `values`."""
    j = F.col("j")
    node = {
        "id": F.when((j == BLOCK) & F.col("full"), F.col("end")).otherwise(F.unhex(F.md5(F.concat("start", _joined(F.col("digests"), j))))),
        "parent": F.when(j == 1, F.col("start")).otherwise(F.unhex(F.md5(F.concat("start", _joined(F.col("digests"), j - 1))))),
        "depth": F.col("blk") * BLOCK + j,
        "digest": F.element_at("digests", j),
        "words": F.element_at("sizes", j),
        "before": F.col("before") + F.aggregate(F.slice("sizes", 1, j - 1), F.lit(0).cast("long"), lambda a, w: a + w),
    }
    rows = edges.where("size(digests) > 0").withColumn("j", F.explode(F.sequence(F.lit(1), F.size("digests"))))
    return rows.select(*[c.alias(name) for name, c in node.items()], "forked", *values)


def _by_node(edges: DataFrame, same: list[str], sums: dict[str, Column]) -> DataFrame:
    """Sums over the blocks that share a node. Only where blocks with the same past differ do their turns have to be grouped; a
    block without siblings is its nodes' only one."""
    rows = _spelled(edges, list(sums))
    straight = rows.where("NOT forked").select("id", *same, *sums)
    forked = rows.where("forked").groupBy("id").agg(*[F.first(c).alias(c) for c in same], *[c.alias(name) for name, c in sums.items()])
    return straight.unionByName(forked)


_IDS = pa.schema([("end", pa.binary()), ("sha", pa.string()), ("part", pa.int64()), ("place", pa.int64()), ("ids", pa.string())])


def _end_digests(batches):
    """Digest of the ids at each end that lies in this part alone; the ids at the part's first and last end, which others may
    share, and of long lists as pieces of text."""
    now, held, size, place, whole = None, [], 0, 0, False

    def row(digest: bool) -> list[dict]:
        text = ",".join(held)
        if digest:
            return [{"end": now, "sha": hashlib.sha256(text.encode()).hexdigest(), "part": part, "place": place, "ids": None}]
        return [{"end": now, "sha": None, "part": part, "place": place, "ids": text}] if held else []

    for b in batches:
        rows: list[dict] = []
        for end, conv, part in zip(b.column("end").to_pylist(), b.column("conv").to_pylist(), b.column("_part").to_pylist()):
            if end != now:
                rows += row(whole) if now is not None else []
                now, held, size, whole = end, [], 0, now is not None
                place += 1
            held.append(str(conv))
            size += len(held[-1]) + 1
            if size >= CHUNK:
                rows += row(False)
                held, size, whole = [], 0, False
                place += 1
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _IDS)
    if now is not None:
        yield pa.RecordBatch.from_pylist(row(False), _IDS)


def _joined_digests(batches):
    """One digest over the pieces of each end, in their order."""
    now, state = None, None
    kind = pa.schema([("end", pa.binary()), ("sha", pa.string())])
    for b in batches:
        rows = []
        for end, ids in zip(b.column("end").to_pylist(), b.column("ids").to_pylist()):
            if end != now:
                if now is not None:
                    rows.append({"end": now, "sha": state.hexdigest()})
                now, state = end, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kind)
    if now is not None:
        yield pa.RecordBatch.from_pylist([{"end": now, "sha": state.hexdigest()}], kind)


def end_digests(ends: DataFrame) -> DataFrame:
    """(end, conv) to (end, sha): digest of the ascending ids at each end. Rows are range-sorted by both, so an end with most of
    the conversations lies in many tasks; these hand on their part as text of CHUNK characters, digested one after the other."""
    placed = ends.repartitionByRange("end", "conv").sortWithinPartitions("end", "conv").withColumn("_part", F.spark_partition_id())
    placed = written(arrow_map(placed, _end_digests, "end binary, sha string, part long, place long, ids string"), "ends")
    pieces = placed.where("ids IS NOT NULL").repartition("end").sortWithinPartitions("end", "part", "place").select("end", "ids")
    return placed.where("ids IS NULL").select("end", "sha").unionByName(arrow_map(pieces, _joined_digests, "end binary, sha string"))


def trie(turns: DataFrame) -> DataFrame:
    """Nodes of the prefix trie of conversations, from rows conv, pos, digest, words and a row without digest after each last turn.

    id, parent_id, conv_id (the smallest conversation that starts with the node), depth, digest (of its last turn; none at
    the root), parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. No conversations give no rows.

    Turns are packed into blocks of BLOCK. Digests of the blocks so far, running along each conversation, tell which
    conversations share their past; equal blocks with the same past are counted as one. Turns are looked at only where such
    blocks differ. Sums over a subtree come from its members: the smallest member owns a node, a conversation owns the
    last nodes of its path, so each conversation brings the words and the leaf of the nodes it owns."""
    t = F.col("turns")
    packed = turns.groupBy("conv", F.expr(f"pos div {BLOCK}").alias("blk")).agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "words"))).alias("turns"))
    packed = packed.withColumn("kept", F.filter(t, lambda x: x["digest"].isNotNull())).select(
        "conv", "blk", F.transform("kept", lambda x: x["digest"]).alias("digests"), F.transform("kept", lambda x: x["words"]).alias("sizes"),
        (F.size("kept") == F.size(t)).alias("full"))
    packed = packed.withColumns({
        "own": _binary16(F.sha2(_joined(F.col("digests"), F.size("digests")), 256)),
        "words": F.aggregate("sizes", F.lit(0).cast("long"), lambda a, w: a + w)})
    summed = along(packed, [F.col("blk").asc()], _block_values, 5, "summed")

    def past(blk: Column, *sums: Column) -> Column:
        return F.unhex(F.md5(F.concat_ws(":", blk.cast("string"), *[(s % PRIME).cast("string") for s in sums]).cast("binary")))

    blocks = written(summed.select(
        "conv", "blk", "digests", "sizes", "full", "own", "words", F.col("b4").alias("before"),
        past(F.col("blk"), *[F.col(f"b{i}") for i in range(4)]).alias("start"),
        past(F.col("blk") + 1, *[F.col(f"b{i}") + F.col(f"v{i}") for i in range(4)]).alias("end")), "blocks")
    same = ["blk", "digests", "sizes", "full", "before", "end"]
    edges = blocks.groupBy("start", "own").agg(F.count("*").alias("n"), F.min("conv").alias("least"), *[F.first(c).alias(c) for c in same])
    edges = written(edges, "edges")
    siblings = edges.groupBy("start").agg((F.count("*") > 1).alias("forked"))
    edges = written(edges.join(siblings, "start"), "edges")

    about = ["parent", "depth", "digest", "words", "before"]
    nodes = _by_node(edges, about, {"n": F.sum("n"), "least": F.min("least")})
    root = blocks.where("blk = 0").agg(F.first("start").alias("id"), F.count("*").alias("n"), F.min("conv").alias("least")).where("n > 0").selectExpr(
        "id", "cast(null AS binary) AS parent", "0L AS depth", "cast(null AS binary) AS digest", "0L AS words", "0L AS before", "n", "least")
    nodes = written(nodes.unionByName(root), "nodes")
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    nodes = written(nodes.join(children, "id", "left").fillna(0, "n_children"), "nodes")

    owners = nodes.groupBy(F.col("least").alias("conv")).agg(F.sum("words").alias("owned"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    last = blocks.where("NOT full").select(
        "conv", (F.col("before") + F.col("words")).alias("total"),
        F.when(F.size("digests") == 0, F.col("start")).otherwise(
            F.unhex(F.md5(F.concat("start", _joined(F.col("digests"), F.size("digests")))))).alias("end"))
    members = written(last.join(owners, "conv", "left").fillna(0, ["owned", "leaf"]), "members")

    brought = {c: F.sum(c) for c in ("total", "owned", "leaf")}
    sums = blocks.select("conv", "start", "own").join(members.drop("end"), "conv").groupBy("start", "own").agg(*[c.alias(n) for n, c in brought.items()])
    sums = _by_node(edges.join(sums, ["start", "own"]), [], brought)
    of_root = members.agg(*[c.alias(n) for n, c in brought.items()])
    sums = sums.unionByName(root.select("id").join(F.broadcast(of_root)))  # one row each

    parents = nodes.select(F.col("id").alias("parent"), F.col("least").alias("parent_conv_id"))
    owner = members.select(F.col("conv").alias("least"), F.col("total").alias("own_total"), F.col("owned").alias("own_owned"))
    ends = end_digests(members.select("end", "conv")).withColumnRenamed("end", "id")
    out = nodes.join(sums, "id").join(ends, "id", "left").join(owner, "least").join(parents, "parent", "left")
    saved = (F.col("total") - F.col("n") * F.col("before")) - (F.col("owned") - F.col("own_owned") + F.col("own_total") - F.col("before"))
    return out.select(
        "id", F.col("parent").alias("parent_id"), F.col("least").alias("conv_id"), "depth", "digest", "parent_conv_id",
        F.col("n").alias("n_convs"), "n_children", F.col("leaf").alias("n_leaves"), saved.alias("saved_tokens"),
        F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
