"""Substring dedup: matching statistics against suffix automata of reference shards."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import WordHashes, arrow_map, byte_texts, gram_hashes, mix64, narrow, written

WINDOW = 50
# Words of an anchor: every window holds WINDOW - GRAM + 1 candidates and picks one by its content.
GRAM = 11
# Distinct segments of one anchor that one automaton takes; more go by window.
SHARD_SEGMENTS = 512
# Crowded anchors that are broadcast, 8 bytes each; more are joined by shuffle.
BROADCAST_ANCHORS = 100_000
# Words of a document looked at in one piece; pieces overlap so that each window is in one.
PIECE = 4_000_000
# Stands for a null id: not smaller than any.
NO_ID = (1 << 63) - 1


def choose(words: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window start, the hash and the position of the window's anchor: the gram of
    least hash, the first of equal ones. Depends on the window's words only."""
    hashes = gram_hashes(words, gram)
    width = window - gram + 1
    n = len(hashes) - width + 1
    position = np.arange(len(hashes), dtype=np.uint64)
    key = (hashes & ~np.uint64((1 << 23) - 1)) | position
    span = 1
    while span * 2 <= width:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < width:
        key = np.minimum(key[:n], key[width - span:width - span + n])
    at = (key & np.uint64((1 << 23) - 1)).astype(np.int64)
    return hashes[at], at


def segments(words: np.ndarray, window: int, gram: int):
    """(anchor hash, first window start, last window start) of every run of windows that picked
    the same gram; each window is in exactly one."""
    n = len(words) - window + 1
    for start in range(0, max(n, 0), PIECE):
        part = words[start:start + PIECE + window - 1]
        hashes, at = choose(part, window, gram)
        edge = np.flatnonzero(np.diff(at)) + 1
        first = np.concatenate([[0], edge])
        last = np.concatenate([edge, [len(at)]]) - 1
        yield hashes[first].astype(np.int64), first + start, last + start


def _anchors(window, gram):
    def run(batches):
        known = WordHashes()
        for b in batches:
            ids, keys, anchors = [], [], []
            for doc, key, text in zip(b.column("doc").to_pylist(), b.column("key").to_pylist(), byte_texts(b.column("text"))):
                words = text.split()
                if len(words) < window:
                    continue
                own = np.unique(np.concatenate([a for a, _, _ in segments(known.of(words), window, gram)]))
                ids.append(np.full(len(own), doc))
                keys.append(np.full(len(own), key))
                anchors.append(own)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (anchors, ids, keys)], names=["anchor", "doc", "key"])

    return run


def _segments(window, gram):
    """Rows with the document's shared anchors -> its distinct segments and where they start."""

    def run(batches):
        known = WordHashes()
        for b in batches:
            for i, (doc, key, shared, text) in enumerate(zip(b.column("doc").to_pylist(), b.column("key").to_pylist(), b.column("anchors").to_pylist(), byte_texts(b.column("text")))):
                words = text.split()
                wanted = np.array(shared, np.int64)
                found: dict[tuple[int, bytes], list[int]] = {}
                for anchors, first, last in segments(known.of(words), window, gram):
                    at = np.flatnonzero(np.isin(anchors, wanted))
                    for a, f, t in zip(anchors[at].tolist(), first[at].tolist(), last[at].tolist()):
                        found.setdefault((a, b" ".join(words[f:t + window])), []).append(f)
                if found:
                    n = len(found)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([a for a, _ in found], pa.int64()), pa.array([c for _, c in found], pa.binary()),
                        pa.array([hashlib.md5(c).digest() for _, c in found], pa.binary()),
                        pa.array(np.full(n, doc), pa.int64()), pa.array(np.full(n, key), pa.int64()),
                        pa.array(list(found.values()), pa.list_(pa.int32())),
                        pa.array([c.count(b" ") + 2 - window for _, c in found], pa.int32())],
                        names=["anchor", "content", "digest", "doc", "key", "starts", "windows"])

    return run


class Automaton:
    """Suffix automaton of word sequences added by ascending document; `first` of a state is
    the smallest document in which its words occur."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [NO_ID]

    def add(self, words: list, doc: int) -> None:
        nxt, link, length, first = self.next, self.link, self.length, self.first
        last = 0
        for c in words:
            q = nxt[last].get(c)
            if q is not None:  # another sequence went this way
                last = q if length[q] == length[last] + 1 else self._clone(last, c, q)
                continue
            new = len(nxt)
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            first.append(doc)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
            last = new

    def _clone(self, p: int, c, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        self.first.append(self.first[q])
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def firsts(self, words: list, window: int) -> list[int]:
        """For every window of `words`: the smallest document that holds it, NO_ID for none."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        state, matched, out = 0, 0, []
        for i, c in enumerate(words):
            while state and c not in nxt[state]:
                state = link[state]
                matched = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                matched += 1
            while matched > window and length[link[state]] >= window:
                state = link[state]
                matched = length[state]
            if i + 1 >= window:
                out.append(first[state] if matched >= window else NO_ID)
        return out


def _resolve(window):
    """Distinct segments sorted by anchor and document: one automaton per anchor."""

    def settle(group):
        if len(group) == 1:
            return
        docs, contents, digests = zip(*group)
        words = [c.split() for c in contents]
        automaton = Automaton()
        for doc, own in zip(docs, words):
            automaton.add(own, doc)
        for doc, own, digest in zip(docs, words, digests):
            earlier = [k for k, first in enumerate(automaton.firsts(own, window)) if first < doc]
            if earlier:
                yield digest, earlier

    def run(batches):
        anchor, group = None, []
        for b in batches:
            out = []
            for a, d, c, g in zip(*[b.column(n).to_pylist() for n in ("anchor", "doc", "content", "digest")]):
                if a != anchor:
                    out += [(anchor, *r) for r in settle(group)] if group else []
                    anchor, group = a, []
                group.append((d, c, g))
            if out:
                yield rows(out)
        if group and (out := [(anchor, *r) for r in settle(group)]):
            yield rows(out)

    def rows(out):
        kinds = (pa.int64(), pa.binary(), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=["anchor", "digest", "earlier"])

    return run


def _windows(window):
    """Segments of crowded anchors -> a row per window, by two hashes of its words."""

    def run(batches):
        known = WordHashes()
        for b in batches:
            for a, d, c, g in zip(*[b.column(n).to_pylist() for n in ("anchor", "doc", "content", "digest")]):
                words = known.of(c.split())
                one, two = gram_hashes(words, window), gram_hashes(mix64(words), window)
                n = len(one)
                yield pa.RecordBatch.from_arrays([
                    pa.array([a] * n, pa.int64()), pa.array([g] * n, pa.binary()), pa.array(range(n), pa.int32()), pa.array([d] * n, pa.int64()),
                    pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], names=["anchor", "digest", "at", "doc", "one", "two"])

    return run


def crowded_anchors(segments_: DataFrame, shard_segments: int) -> DataFrame:
    return written(segments_.select("anchor", "digest").distinct().groupBy("anchor").agg(F.count("*").alias("n")).where(
        F.col("n") > shard_segments).select("anchor"), "crowded")


def earlier_windows(segments_: DataFrame, window: int, shard_segments: int) -> DataFrame:
    """(anchor, digest, content, doc) to (anchor, digest, earlier): of the smallest document with a
    segment, the windows that a still smaller document holds; segments without any are left out.

    Each anchor's segments are a shard of the reference; its automaton is built where its
    segments meet. An anchor with more than `shard_segments` distinct segments goes by window:
    equal windows are aggregated by hash, which splits over all tasks."""
    distinct = segments_.groupBy("anchor", "digest").agg(F.first("content").alias("content"), F.min("doc").alias("doc"))
    crowded = crowded_anchors(segments_, shard_segments)
    n = crowded.count()
    hint = F.broadcast if n <= BROADCAST_ANCHORS else lambda df: df
    shards = distinct.join(hint(crowded), "anchor", "left_anti") if n else distinct
    shards = shards.select("anchor", "doc", "content", "digest").repartition("anchor").sortWithinPartitions("anchor", "doc")
    by_automaton = arrow_map(shards, _resolve(window), "anchor long, digest binary, earlier array<int>")
    if not n:
        return by_automaton
    crowd = distinct.join(hint(crowded), "anchor").select("anchor", "doc", "content", "digest")
    each = arrow_map(crowd, _windows(window), "anchor long, digest binary, at int, doc long, one long, two long")
    least = each.groupBy("one", "two").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").drop("last")
    by_window = each.join(least, ["one", "two"]).where("first < doc").groupBy("anchor", "digest").agg(F.collect_list("at").alias("earlier"))
    return by_automaton.unionByName(by_window)


def _keep(window):
    def run(batches):
        for b in batches:
            rows = []
            for text, gone in zip(byte_texts(b.column("text")), b.column("gone").to_pylist()):
                words = text.split()
                n = len(words)
                if gone:
                    edges = np.zeros(n + 1, np.int64)
                    at = np.unique(np.array(gone, np.int64))
                    edges[at] += 1
                    edges[at + window] -= 1
                    stays = np.cumsum(edges[:n]) == 0
                    words = [w for w, s in zip(words, stays.tolist()) if s]
                kept = b" ".join(words)
                rows.append((n, n - len(words), kept.decode("utf-8", "replace"), hashlib.sha256(kept).hexdigest()))
            n, removed, kept, sha = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(sha, pa.string())],
                                             names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])

    return run


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_segments: int = SHARD_SEGMENTS,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_text, kept_sha256 of every document after removing each
    word covered by a `window`-word window that also starts in a document with a smaller id.

    Every window picks one anchor gram by its own words, so equal windows pick equal anchors.
    Windows of one anchor form a segment; only segments whose anchor stands in two documents can
    repeat. Their distinct texts, with the smallest document of each, are the reference shards;
    matching statistics of every segment against its shard's suffix automaton give the smallest
    document of each window. Words are compared as text, in crowded shards by 128 bits of hash.

    Null and empty texts and texts under `window` words lose nothing. A null id is larger than
    any id and never makes another document lose words. Rows with equal ids do not make each
    other lose words. Repeated rows give repeated results. No rows give no rows."""
    rows = narrow(docs, doc_id=id_col, text=text_col).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"doc": F.coalesce("doc_id", F.lit(NO_ID)), "key": F.xxhash64("doc_id", "text")})
    anchors = written(arrow_map(rows.select("doc", "key", "text"), _anchors(window, gram), "anchor long, doc long, key long"), "anchors")
    shared = anchors.groupBy("anchor").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("anchor")
    per_doc = anchors.join(shared, "anchor").groupBy("doc", "key").agg(F.collect_set("anchor").alias("anchors"))
    found = written(arrow_map(rows.join(per_doc, ["doc", "key"]).dropDuplicates(["doc", "key"]).select("doc", "key", "anchors", "text"), _segments(window, gram),
                              "anchor long, content binary, digest binary, doc long, key long, starts array<int>, windows int"), "segments")
    earlier = written(earlier_windows(found, window, shard_segments), "earlier")
    least = found.groupBy("anchor", "digest").agg(F.min("doc").alias("least"))
    places = found.select("anchor", "digest", "doc", "key", "starts", "windows").join(least, ["anchor", "digest"]).join(earlier, ["anchor", "digest"], "left")
    # a larger document loses all of a segment, the smallest what a still smaller one holds
    at = F.when(F.col("doc") > F.col("least"), F.sequence(F.lit(0), F.col("windows") - 1)).otherwise(F.col("earlier"))
    gone = places.withColumn("at", at).where("size(at) > 0")
    gone = gone.select("doc", "key", F.flatten(F.transform("starts", lambda s: F.transform("at", lambda k: s + k))).alias("at"))
    gone = written(gone.groupBy("doc", "key").agg(F.flatten(F.collect_list("at")).alias("gone")), "gone")
    back = rows.join(gone, ["doc", "key"], "left").select("doc_id", "text", "gone")
    return arrow_map(back, _keep(window), "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")
