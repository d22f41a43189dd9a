"""Stages of the corpus pipeline: documents in, documents out, whatever their other columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import tune
from . import bpe, exact, jaccard, mixing, quality
from .common import batch_rows, read_table, written
from .jaccard import NO_ID
from .queries import tokenizer_path

REJECT_BELOW = 0.3


def _ready(spark: SparkSession) -> None:
    batch_rows(tune(spark))


def _joined(docs: DataFrame, decisions: DataFrame, digest) -> DataFrame:
    """Rows of `docs` with the decision for their (doc_id, digest), one row for each such pair."""
    keyed = docs.withColumns({"__doc": F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)), "__digest": digest})
    wanted = decisions.withColumn("__doc", F.coalesce("doc_id", F.lit(NO_ID))).drop("doc_id")
    return keyed.join(wanted, ["__doc", "__digest"]).dropDuplicates(["__doc", "__digest"])


def _text_hash(docs: DataFrame):
    return F.xxhash64(F.coalesce(docs["text"], F.lit("")))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject, every row on its own, whatever its id; a null text is empty. Without labels of
    both classes all stay."""
    _ready(spark)
    marks = quality.marks(read_table(spark, sf_dir, "labels"))
    table = written(quality.features(docs), "features")
    model = quality.fit(table.join(marks, "doc_id").where(~quality.held_out()))
    return quality.keep(docs, model, REJECT_BELOW)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the row that exact.dedup keeps. Of rows with its id and
    its normalised text that is the one with the most code points."""
    _ready(spark)
    return exact.survivors(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest id, then the smallest hash of the text; a null id
    is larger than any."""
    _ready(spark)
    kept = jaccard.near_copies(docs).where("kept").select("doc_id", F.col("text_hash").alias("__digest")).distinct()
    return _joined(docs, kept, _text_hash(docs)).select(*[F.col(f"`{c}`") for c in docs.columns])


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: every document as often as it is taken. Rows with one id (null ids are one) and one text count as one row that is
    taken as often as all of them; documents without words are not taken."""
    _ready(spark)
    taken = mixing.mix(docs).groupBy("doc_id", F.col("text_hash").alias("__digest")).agg(F.sum("copies").cast("int").alias("__copies")).where("__copies > 0")
    return _joined(docs, taken, _text_hash(docs)).withColumn("__copy", F.explode(F.sequence(F.lit(1), "__copies"))).select(
        *[F.col(f"`{c}`") for c in docs.columns])


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text of every row, rows with null or repeated ids too; a
    null text is empty."""
    _ready(spark)
    return bpe.round_trip(docs, tokenizer_path("byte_bpe_50k.json"))
