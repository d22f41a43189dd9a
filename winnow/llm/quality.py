"""Quality classifier: regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import WordHashes, arrow_map, byte_texts, gram_hashes, narrow, written

# Labelled rows per class the score is calibrated on; the covariances use all labelled rows.
CALIBRATION_ROWS = 20_000
SHRINKAGE = 0.1
FEATURES = (
    "log_words", "word_length", "distinct_words", "top_word", "repeated_grams", "upper", "symbols", "exclaims", "digits",
    "non_ascii", "punctuation", "entropy", "line_words", "duplicate_lines", "capitalised", "long_words",
)
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
PUNCTUATION = np.frombuffer(b".,;:'\"()-", np.uint8)


def _logit(share: float) -> float:
    share = min(max(share, 0.0), 1.0)
    return float(np.log((share + 0.01) / (1.01 - share)))


def statistics(text: bytes, hashes: WordHashes) -> list[float]:
    """Transformed statistics of one text: shares as logits, counts as logarithms."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    letters = sum(map(len, words))
    bag = Counter(words)
    grams = gram_hashes(hashes.of(words), 3)
    lines = Counter(line for line in text.split(b"\n") if line and not line.isspace())
    n_lines = sum(lines.values())
    p = counts[counts > 0] / len(text)
    return [
        float(np.log1p(n)),
        float(np.log(letters / n)),
        float(np.log((len(bag) + 1) / (n ** 0.8 + 1))),
        _logit(max(bag.values()) / (n + 5)),
        _logit(1 - len(np.unique(grams)) / len(grams)) if len(grams) else _logit(0),
        _logit(counts[65:91].sum() / letters),
        _logit(counts[SYMBOLS].sum() / letters),
        _logit(counts[33] / letters),
        _logit(counts[48:58].sum() / letters),
        _logit(counts[128:].sum() / letters),
        _logit(counts[PUNCTUATION].sum() / letters),
        float(-(p * np.log(p)).sum()),
        float(np.log(n / n_lines)),
        _logit(1 - len(lines) / n_lines),
        _logit(sum(w[:1].isupper() for w in words) / n),
        _logit(sum(len(w) > 15 for w in words) / n),
    ]


def _features(batches):
    hashes = WordHashes()
    for b in batches:
        rows = [statistics(t, hashes) for t in byte_texts(b.column("text"))]
        flat = pa.array(np.asarray(rows, np.float64).reshape(-1), pa.float64())
        x = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(FEATURES)), pa.int32()), flat)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), x], names=["doc_id", "x"])


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and x, the statistics of the whole text; null and empty texts and texts without a
    word have zeros."""
    rows = narrow(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return arrow_map(rows, _features, f"doc_id {kind}, x array<double>")


def _moments(batches):
    sums: dict[int, list] = {}
    d = len(FEATURES)
    for b in batches:
        x = np.asarray(b.column("x").flatten(), float).reshape(-1, d)
        y = np.asarray(b.column("label"))
        for label in (0, 1):
            own = x[y == label]
            n, s, ss = sums.get(label, (0, np.zeros(d), np.zeros((d, d))))
            sums[label] = n + len(own), s + own.sum(0), ss + own.T @ own
    for label, (n, s, ss) in sums.items():
        yield pa.RecordBatch.from_pydict({"label": pa.array([label], pa.int32()), "n": [n], "s": [s.tolist()], "ss": [ss.reshape(-1).tolist()]})


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log determinants of both classes, and the
    calibration of their log-density difference."""

    means: list
    inverse: list
    logdet: list
    slope: float = 1.0
    offset: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """log density under class 1 less that under class 0"""
        out = []
        for mean, inverse, logdet in zip(self.means, self.inverse, self.logdet):
            z = (x - mean) @ inverse.T
            out.append(-0.5 * (z * z).sum(1) - 0.5 * logdet)
        return out[1] - out[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.signal(x) + self.offset, -40, 40)))

    def signal(self, x: np.ndarray) -> np.ndarray:
        d = self.difference(x)
        return np.sign(d) * np.log1p(np.abs(d))


def _calibrate(signal: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic fit of the label on the signal, slope not negative."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * signal + b, -40, 40)))
        w = p * (1 - p) + 1e-6
        g = np.array([(signal * (p - y)).sum() + 0.01 * a, (p - y).sum() + 0.01 * b])
        h = np.array([[(w * signal * signal).sum() + 0.01, (w * signal).sum()], [(w * signal).sum(), w.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(float(a), 0.0), float(b)


def fit(labelled: DataFrame, shrinkage: float = SHRINKAGE, calibration_rows: int = CALIBRATION_ROWS) -> Discriminant | None:
    """Fit on rows (x, label 0 or 1). Counts, sums and products of all rows are added up per
    task; the driver gets d*d numbers per class and task. A class covariance is shrunk towards
    the pooled one, and that towards its diagonal. None where a class has under two rows."""
    d = len(FEATURES)
    total = {0: [0, np.zeros(d), np.zeros((d, d))], 1: [0, np.zeros(d), np.zeros((d, d))]}
    parts = arrow_map(labelled.select("x", "label"), _moments, "label int, n long, s array<double>, ss array<double>")
    summed = parts.groupBy("label").agg(F.sum("n").alias("n"), *[
        F.array(*[F.sum(F.col(c)[i]) for i in range(k)]).alias(c) for c, k in (("s", d), ("ss", d * d))])
    for row in summed.collect():  # two rows
        total[row["label"]] = [row["n"], np.array(row["s"]), np.array(row["ss"]).reshape(d, d)]
    if min(total[0][0], total[1][0]) < 2:
        return None
    means, covs = [], []
    for label in (0, 1):
        n, s, ss = total[label]
        means.append(s / n)
        covs.append(ss / n - np.outer(s / n, s / n))
    counts = [total[0][0], total[1][0]]
    pooled = (covs[0] * counts[0] + covs[1] * counts[1]) / sum(counts)
    target = (1 - shrinkage) * pooled + shrinkage * np.diag(np.diag(pooled)) + 1e-4 * np.eye(d)
    inverse, logdet = [], []
    for cov in covs:
        factor = np.linalg.cholesky((1 - shrinkage) * cov + shrinkage * target)
        inverse.append(np.linalg.inv(factor))
        logdet.append(2 * float(np.log(np.diag(factor)).sum()))
    model = Discriminant(means, inverse, logdet)
    rows = []
    for label in (0, 1):  # a bounded sample, the same on every run
        # ids hashed below the share that is needed, and a half more: only these are sorted, and reach the driver from any task
        below = min(1.0, 1.5 * calibration_rows / total[label][0]) * (1 << 32)
        own = labelled.where((F.col("label") == label) & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < F.lit(int(below))))
        rows += own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(calibration_rows).select("x", "label").collect()
    x, y = np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows], float)
    model.slope, model.offset = _calibrate(model.signal(x), y)
    return model


def score(rows: DataFrame, model: Discriminant | None) -> DataFrame:
    """Add `score` from 0 to 1 to rows with x; 0.5 for all without a model."""
    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "x"]

    def run(batches):
        for b in batches:
            x = np.asarray(b.column("x").flatten(), float).reshape(-1, len(FEATURES))
            s = model.score(x) if model else np.full(len(x), 0.5)
            keep = [n for n in b.schema.names if n != "x"]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in keep], pa.array(s)], names=[*keep, "score"])

    return arrow_map(rows, run, ", ".join([*names, "score double"]))


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def marks(labels: DataFrame, label_col: str = "quality") -> DataFrame:
    """(doc_id, label) of documents with one label, 0 or 1; a contradicted one is left out."""
    return narrow(labels, doc_id="doc_id", label=label_col).where(F.col("label").isin(0, 1)).groupBy("doc_id").agg(
        F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").select("doc_id", F.col("label").cast("int").alias("label"))


def keep(docs: DataFrame, model: Discriminant | None, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose text scores at least `threshold`; all without a model."""
    if model is None:
        return docs

    def run(batches):
        hashes = WordHashes()
        for b in batches:
            x = np.asarray([statistics(t, hashes) for t in byte_texts(b.column(text_col))], float).reshape(-1, len(FEATURES))
            yield b.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Learns from labelled documents with crc32(doc_id as text) mod 5 not 0. A document with
    several equal labels counts once, with contradicting or null labels not at all. Null ids
    match no label. Repeated rows are scored each. Without labels of both classes every score is
    0.5. No documents give no rows."""
    table = written(features(docs, id_col, text_col), "features")
    model = fit(table.join(marks(labels, label_col), "doc_id").where(~held_out()))
    scored = score(table, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
