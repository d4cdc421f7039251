"""A quality classifier: regularised quadratic discriminant over transformed document statistics.

Each text gives a dozen pairs (count, out of), such as upper-case letters out of bytes. A pair becomes the log odds of
its rate, drawn towards the rate of the training texts by a number of pseudo-counts, so that short texts, whose rates
say little, lie near the middle. Each class has a Gaussian over these values, whose covariance is shrunk towards that
of both classes and towards a multiple of the identity. Scores come from the difference of the two log densities, taken
from Mahalanobis distances by the Cholesky factors that the model keeps.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import sliced

#: Pseudo-counts of each pair: of bytes, of words, of lines.
PSEUDO = {
    "upper": 100, "digit": 100, "high": 100, "stop": 100, "symbol": 100, "space": 100, "distinct_words": 20,
    "doubled_words": 20, "distinct_pairs": 20, "repeated_lines": 4, "distinct_length": 100, "words": 100, "odd_ends": 20,
}


def text_statistics(text: str | None) -> list[float]:
    """(count, out of) of each name in PSEUDO, one after another, over the whole text; zeros if there is none."""
    raw = (text or "").encode()
    n = len(raw)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digit = int(seen[65:91].sum()), int(seen[97:123].sum()), int(seen[48:58].sum())
    high, space, stop = int(seen[128:].sum()), int(seen[32] + seen[9:14].sum()), int(seen[44] + seen[46])
    words = raw.split()
    w, kinds, lines = len(words), Counter(words), raw.split(b"\n")
    pairs = list(pairwise(words))
    odd = sum(1 for x in words if x[-1] < 128 and not x[-1:].isalpha())
    found = (
        (upper, n), (digit, n), (high, n), (stop, n), (n - upper - lower - digit - high - space - stop, n), (space, n),
        (len(kinds), w), (sum(a == b for a, b in pairs), w), (len(set(pairs)), w),
        (len(lines) - len(set(lines)), len(lines) if n else 0), (sum(map(len, kinds)), sum(map(len, words))), (w, n), (odd, w),
    )
    return [float(x) for pair in found for x in pair]


@dataclass
class Discriminant:
    """Two Gaussians with cached Cholesky factors, over standardised log odds."""

    rates: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray

    @staticmethod
    def odds(stats: np.ndarray, rates: np.ndarray) -> np.ndarray:
        x, n, m = stats[:, 0::2], stats[:, 1::2], np.array([*PSEUDO.values()], float)
        return np.log((x + m * rates) / (np.maximum(n - x, 0) + m * (1 - rates)))

    @classmethod
    def fit(cls, stats: np.ndarray, labels: np.ndarray, to_pooled: float, to_identity: float) -> Discriminant:
        rates = (stats[:, 0::2].sum(0) + 1) / (stats[:, 1::2].sum(0) + 2)
        x = cls.odds(stats, rates)
        centre, spread = x.mean(0), x.std(0) + 1e-6
        z = (x - centre) / spread
        pooled, eye = np.cov(z.T, bias=True), np.eye(z.shape[1])
        means, factors, constants = [], [], []
        for k in (0, 1):
            own = z[labels == k]
            cov = (1 - to_pooled) * np.cov(own.T, bias=True) + to_pooled * pooled
            cov = (1 - to_identity) * cov + to_identity * np.trace(cov) / len(cov) * eye + 1e-9 * eye
            factor = np.linalg.cholesky(cov)
            means.append(own.mean(0))
            factors.append(np.linalg.inv(factor))
            constants.append(math.log(len(own) / len(z)) - np.log(np.diag(factor)).sum())
        return cls(rates, centre, spread, np.array(means), np.array(factors), np.array(constants))

    def score(self, stats: np.ndarray) -> np.ndarray:
        z = (self.odds(stats, self.rates) - self.centre) / self.spread
        density = [c - 0.5 * (((z - m) @ f.T) ** 2).sum(1) for m, f, c in zip(self.means, self.factors, self.constants, strict=True)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def held_out(id_col: str | Column) -> Column:
    """Rows whose crc32(id as text) mod 5 is 0; a null id counts as the empty text."""
    at = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(at.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit_quality(docs: DataFrame, labels: DataFrame, max_train_rows: int = 20_000, to_pooled: float = 0.2, to_identity: float = 0.05):
    """The model, learned from at most max_train_rows labelled rows outside the held-out fold (the first by a hash of
    their ids, whose statistics alone go to the driver), or None if these don't hold both classes, twice at least. An id
    that has several documents or labels gives a row for each pair; of all these, too, max_train_rows are taken."""
    train = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
        .select(F.col("doc_id").alias("label_id"), F.col("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("label_id", "quality"), "label_id")
        .limit(max_train_rows)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(train), F.col("doc_id") == F.col("label_id")).select("label_id", "quality", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            stats = pa.array([text_statistics(x.as_py()) for x in b.column(2)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), stats], names=["label_id", "quality", "stats"])

    seen = rows.mapInArrow(run, "label_id long, quality int, stats array<double>")
    found = seen.orderBy(F.xxhash64("label_id", "quality"), "label_id", "quality", "stats").limit(max_train_rows).toPandas()
    y = found["quality"].to_numpy()
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return None
    order = np.lexsort([*np.stack(found["stats"].to_numpy()).T, y])  # the same sums whatever order rows come in
    return Discriminant.fit(np.stack(found["stats"].to_numpy())[order], y[order], to_pooled, to_identity)


def score_quality(docs: DataFrame, model: Discriminant | None, threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted (1 if score >= threshold) of every row.

    Only the text is an input. Null and empty texts have no counts and get the score of average rates. Without a model
    (too few labels) every score is 1. Each row is scored by itself, so repeated ids are scored each; an empty table
    gives no rows.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            score = _scores(model, b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=schema.names)

    return rows.mapInArrow(run, schema)


def keep_quality(docs: DataFrame, model: Discriminant | None, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, that score at least threshold."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            yield b.filter(pa.array(_scores(model, b.column(at)) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def _scores(model: Discriminant | None, texts: pa.Array) -> np.ndarray:
    if not model or not len(texts):
        return np.ones(len(texts))
    return model.score(np.array([text_statistics(x.as_py()) for x in texts]))
