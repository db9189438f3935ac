"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

One pass turns every text into a short vector.  Counts, sums and products of
the labelled rows give each class a mean and a covariance, which is shrunk
towards the pooled one and its diagonal.  A score is the sigmoid of the
difference of the classes' log densities (Mahalanobis terms from Cholesky
factors that the driver computes once) and log priors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, utf8_bytes, written

#: Weights of the pooled covariance and of its diagonal in a class's covariance.
POOLED, DIAGONAL = 0.2, 0.05
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
#: A share is taken as if this many bytes or words of the usual kind (the third number) had been seen besides,
#: so that a very short text is judged by what stands out in it and not by chance.
BYTES, WORDS = 150, 25
FEATURES = (
    "word_length", "symbols", "digits", "upper", "stops", "shouts", "beyond_ascii", "distinct_words", "commonest_word", "short_words", "repeated_lines", "entropy", "spaces", "stutter",
)


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of one text; shares are square roots, which steadies their variance."""
    words = text.split()
    n, w = len(text), len(words)
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    tally: dict[bytes, int] = {}
    for x in words:
        tally[x] = tally.get(x, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    share = seen / max(1, n)
    some = share[share > 0]
    trust = n / (n + BYTES)

    def of_bytes(count: float, usual: float) -> float:
        return math.sqrt((count + BYTES * usual) / (n + BYTES))

    def of_words(count: float, usual: float) -> float:
        return math.sqrt((count + WORDS * usual) / (w + WORDS))

    return [
        math.log((n - seen[9:14].sum() - seen[32] + WORDS * 5) / (w + WORDS)),
        of_bytes(seen[SYMBOLS].sum(), 0.0),
        of_bytes(seen[48:58].sum(), 0.0),
        of_bytes(seen[65:91].sum(), 0.02),
        of_words(seen[46], 0.1),
        of_bytes(seen[33] + seen[63], 0.0),
        of_bytes(seen[128:].sum(), 0.02),
        math.log((len(tally) + WORDS) / (w + WORDS)),
        of_words(max(tally.values(), default=0), 0.05),
        of_words(sum(c for x, c in tally.items() if len(x) <= 3), 0.4),
        math.sqrt((len(lines) - len(set(lines))) / (len(lines) + 5)),
        trust * float(-(some * np.log2(some)).sum()) + (1 - trust) * 4.2,
        of_bytes(seen[32], 0.15),
        of_words(sum(map(eq, words, words[1:])), 0.0),
    ]


def feature_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key and its `x`, an array of len(FEATURES) doubles (null like empty)."""
    bounded_batches(docs.sparkSession)
    source = docs.select(docs[key], docs[text].cast("string"))
    kind = source.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t) for t in utf8_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=[key, "x"])

    return source.mapInArrow(run, f"`{key}` {kind}, x array<double>")


class Discriminant:
    """The fitted model: per class a mean, the inverse Cholesky factor and a constant."""

    def __init__(self, moments: dict[int, tuple[int, np.ndarray, np.ndarray]], dim: int):
        n = {k: moments[k][0] if k in moments else 0 for k in (0, 1)}
        self.prior = math.log((n[1] + 1) / (n[0] + 1))
        self.parts = None
        if min(n.values()) < 2:
            return
        mean = {k: moments[k][1] / n[k] for k in n}
        own = {k: moments[k][2] / n[k] - np.outer(mean[k], mean[k]) for k in n}
        pooled = (n[0] * own[0] + n[1] * own[1]) / (n[0] + n[1])
        spread = np.diag(np.maximum(np.diag(pooled), 1e-6))
        self.parts = {}
        for k in n:
            covariance = (1 - POOLED - DIAGONAL) * own[k] + POOLED * pooled + DIAGONAL * spread + 1e-6 * np.eye(dim)
            factor = np.linalg.cholesky(covariance)
            self.parts[k] = (mean[k], np.linalg.inv(factor).T, -np.log(np.diag(factor)).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        """The share of label 1 that the model expects; the prior alone if a class was not seen."""
        odds = np.full(len(x), self.prior)
        if self.parts:
            for k, sign in ((1, 1.0), (0, -1.0)):
                mean, whiten, constant = self.parts[k]
                odds += sign * (constant - 0.5 * (((x - mean) @ whiten) ** 2).sum(axis=1))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def held_out(key: str = "doc_id"):
    """Rows that no model may learn from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(features: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> Discriminant:
    """From all labelled rows that are not held out; sums are taken on the cluster, two rows come back."""
    d = len(FEATURES)
    known = labels.where(~held_out(key)).select(key, F.col(label).cast("int").alias("label")).where("label in (0, 1)")
    joined = features.join(known, key)
    x = [F.col("x")[i] for i in range(d)]
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(x)] + [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)]
    moments = {}
    for row in joined.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *sums).collect():
        products = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                products[i, j] = products[j, i] = row[f"p{i}_{j}"]
        moments[row.label] = (row.n, np.array([row[f"s{i}"] for i in range(d)]), products)
    return Discriminant(moments, d)


def quality_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """Per row: key, held_out, score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= 0.5).

    Null and empty texts are scored as a text of no bytes.  Labels that are
    null or neither 0 nor 1 are not used; with fewer than two rows of a class
    all scores are the smoothed share of label 1.  Repeated rows each give a
    row; other columns are ignored; an empty table gives no row.
    """
    features = written(feature_table(docs, key, text), "features")
    model = fit(features, labels, key, label)
    kind = features.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            score = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[key, "score", "predicted"])

    scored = features.select(key, "x").mapInArrow(run, f"`{key}` {kind}, score double, predicted int")
    return scored.select(key, held_out(key).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents predicted to be good; rows with a null doc_id can't be matched to a verdict and stay."""
    rejected = quality_scores(docs, labels).where("predicted = 0").select("doc_id").distinct()
    return docs.join(rejected, "doc_id", "left_anti").select(docs.columns)
