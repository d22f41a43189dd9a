"""Quality rules: every rule once, failures as bits, policies and ablations over the bits."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import WordHashes, arrow_map, byte_texts, gram_hashes, narrow

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

# Rule name to failing condition over the measurements; a rule's place is its bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "n_symbols > n_words",
    "duplicate_lines": "100 * n_dup_lines > 30 * n_lines",
    "long_words": "word_chars > 25 * n_words",
    "short_words": "word_chars < 2 * n_words",
}
# Policy version to the rules it applies.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "duplicate_lines"),
    "v2": ("few_words", "repeated_words", "symbols", "duplicate_lines", "long_words", "short_words"),
}


def _measure(batches):
    hashes = WordHashes()
    for b in batches:
        rows = []
        for text in byte_texts(b.column("text")):
            words = text.split()
            n = len(words)
            letters = sum(map(len, words))
            # code points: all bytes but the continuation bytes
            if not text.isascii():
                raw = np.frombuffer(text, np.uint8)
                letters -= int(np.count_nonzero((raw & 0xC0) == 0x80))
            lines = Counter(line for line in text.split(b"\n") if line and not line.isspace())
            repeated = 0
            if n > WINDOW:
                grams = gram_hashes(hashes.of(words), WINDOW)
                order = np.argsort(grams, kind="stable")
                same = grams[order][1:] == grams[order][:-1]
                if same.any():
                    twice = np.zeros(len(grams) + 1, bool)
                    twice[order[1:][same]] = True
                    twice[order[:-1][same]] = True
                    edges = np.zeros(n + 1, np.int64)
                    at = np.flatnonzero(twice)
                    edges[at] += 1
                    edges[at + WINDOW] -= 1
                    repeated = int(np.count_nonzero(np.cumsum(edges) > 0))
            rows.append((n, letters, sum(text.count(SYMBOLS[i:i + 1]) for i in range(len(SYMBOLS))),
                         sum(lines.values()) - len(lines), repeated, sum(lines.values())))
        columns = list(zip(*rows)) if rows else [[]] * len(MEASURES)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns]], names=["doc_id", *MEASURES])


def policy_mask(version: str) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in POLICIES[version])


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, the measurements, and `failures`, a bit per failed rule.

    Words are runs of characters outside 20 and 09 to 0D, over the whole text. word_chars:
    code points in words; n_symbols: characters of #*$%&|<>; n_lines: \\n-split lines with a word;
    n_dup_lines: those equal to an earlier line; n_repeat_words: words inside 5-word windows that
    stand in the text twice or more. Null texts are empty: all zero. Null and repeated ids
    are rows like any other. No rows give no rows."""
    rows = narrow(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    measured = arrow_map(rows, _measure, f"doc_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = sum((F.when(F.expr(rule), F.lit(1 << i)).otherwise(0) for i, rule in enumerate(RULES.values())), F.lit(0))
    return measured.withColumn("failures", bits.cast("long"))


def passes(version: str, failures: str = "failures") -> Column:
    """Whether a ledger row passes a policy; no rule is evaluated again."""
    return F.col(failures).bitwiseAND(F.lit(policy_mask(version))) == 0


def ablation(rows: DataFrame, version: str) -> DataFrame:
    """Per rule of a policy: rule, n_failed, n_only (documents that nothing else in the policy
    rejects), n_kept_without (kept if the rule were dropped). Counted over distinct masks, of
    which there are at most two to the number of rules."""
    mask = policy_mask(version)
    names = list(RULES)
    counts = rows.groupBy(F.col("failures").bitwiseAND(F.lit(mask)).alias("m")).agg(F.count("*").alias("n"))
    bits = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit")) for r in POLICIES[version]])).alias("b")
    each = counts.select("m", "n", bits).select("m", "n", "b.rule", "b.bit")
    hit = F.col("m").bitwiseAND(F.col("bit")) != 0
    rest = F.col("m").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0
    return each.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(hit & rest, F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(rest, F.col("n")).otherwise(0)).alias("n_kept_without"))
