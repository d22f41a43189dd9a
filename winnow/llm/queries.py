"""Registered queries of the corpus operators: each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import scratch_path, tune
from . import align, bpe, decontaminate, exact, jaccard, mixing, quality, rules, sharding, substring, tokenids, trie, warc
from .common import read_table, written

POLICY = "v2"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _documents(spark, sf) -> DataFrame:
    return read_table(tune(spark), sf, "documents")


def op1_bpe(spark, sf):
    return bpe.round_trip(_documents(spark, sf), tokenizer_path("byte_bpe_50k.json"))


def op2_exact_dedup(spark, sf):
    return exact.dedup(_documents(spark, sf))


def op3_warc(spark, sf):
    path = scratch_path(spark, "warc")
    warc.write(read_table(tune(spark), sf, "pages"), path)
    return warc.read(spark, path)


def op4_jaccard_join(spark, sf):
    return jaccard.near_copies(_documents(spark, sf)).select("doc_id", "n_shingles", "component_id")


def op5_mixing(spark, sf):
    return mixing.mix(_documents(spark, sf)).select("doc_id", "size", "source_size", "target", "taken")


def op6_quality(spark, sf):
    return quality.classify(_documents(spark, sf), read_table(spark, sf, "labels"))


def op7_token_ids(spark, sf):
    path = scratch_path(spark, "ids")
    tokenids.write(_documents(spark, sf), path, tokenizer_path("word_bpe_49k.json"))
    return tokenids.read(spark, path)


def op8_quality_rules(spark, sf):
    rows = rules.ledger(_documents(spark, sf))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       (~rules.passes("base")).alias("base_failed"), rules.passes(POLICY).alias("kept"))


def rule_ablation(spark, sf):
    return rules.ablation(written(rules.ledger(_documents(spark, sf)).select("failures"), "ledger"), POLICY)


def op9_substring_dedup(spark, sf):
    return substring.dedup(_documents(spark, sf)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_sharding(spark, sf):
    return sharding.shard(_documents(spark, sf))


def op11_align(spark, sf):
    return align.align(_documents(spark, sf), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_trie(spark, sf):
    turns = trie.numbered(read_table(tune(spark), sf, "conversations"))
    return trie.trie(trie.rebuilt(turns)).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op13_decontaminate(spark, sf):
    return decontaminate.report(decontaminate.find(_documents(spark, sf), read_table(spark, sf, "benchmark")))


QUERIES = {f.__name__: f for f in (
    op1_bpe, op2_exact_dedup, op3_warc, op4_jaccard_join, op5_mixing, op6_quality, op7_token_ids, op8_quality_rules, rule_ablation,
    op9_substring_dedup, op10_sharding, op11_align, op12_trie, op13_decontaminate)}
