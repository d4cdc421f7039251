"""Approximate nearest neighbours by a hash-prefix forest.

Every vector gets one long bit string per tree; a bit says on which side of a random hyperplane, through the median of
a sample, it lies. Rows are indexed in segments of bounded size; a segment keeps each tree as a sorted array of its
strings, is built once, and answers all queries, which come to it a batch at a time. A query descends to the longest prefixes that any tree matches, then ascends in all trees at once, a bit at a
time, until the ranges of that prefix length hold enough entries. All candidates are ranked by exact distance, and the
results of all segments are merged. How many entries are enough is measured: the least for which a bounded sample
reaches the wanted recall against brute force.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixframe.session import stored

BITS = 32
#: So many vectors get their strings at a time.
ROWS = 1024


@dataclass
class Planes:
    """The hyperplanes of all trees, and how many entries a segment must give for each of its rows."""

    normals: np.ndarray
    cuts: np.ndarray
    trees: int
    enough: float = 1.0

    @classmethod
    def draw(cls, sample: np.ndarray, trees: int, seed: int) -> Planes:
        normals = np.random.default_rng(seed).standard_normal((sample.shape[1], trees * BITS))
        return cls(normals, np.median(sample @ normals, axis=0), trees)

    def strings(self, vectors: np.ndarray) -> np.ndarray:
        """One unsigned number of BITS bits for each tree (rows) and vector (columns)."""
        found = np.zeros((self.trees, len(vectors)), np.int64)
        for at in range(0, len(vectors), ROWS):
            some = vectors[at : at + ROWS]
            bits = (some @ self.normals > self.cuts).reshape(len(some), self.trees, BITS)
            found[:, at : at + ROWS] = (bits @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))).T
        return found


class Segment:
    """Sorted arrays of strings over some rows."""

    def __init__(self, planes: Planes, ids: np.ndarray, vectors: np.ndarray):
        self.planes, self.ids, self.vectors = planes, ids, vectors
        strings = planes.strings(vectors)
        self.order = np.argsort(strings, axis=1, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, 1)

    def ranges(self, strings: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last place, in each tree, of the strings that share `depth` bits with each query."""
        low = strings >> (BITS - depth) << (BITS - depth)
        high = low + (1 << (BITS - depth))
        first = np.stack([np.searchsorted(a, x) for a, x in zip(self.sorted, low, strict=True)])
        last = np.stack([np.searchsorted(a, x) for a, x in zip(self.sorted, high, strict=True)])
        return first, last

    def search(self, ids: np.ndarray, vectors: np.ndarray, k: int, enough: float | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the ids and distances of its nearest candidates, nearest first, ties to smaller ids."""
        need = max(4 * k, (self.planes.enough if enough is None else enough) * len(self.ids))
        strings = self.planes.strings(vectors)
        found: list[tuple[np.ndarray, np.ndarray]] = [None] * len(ids)  # type: ignore[list-item]
        open_ = np.arange(len(ids))
        for depth in range(BITS, -1, -1):  # all trees ascend together
            first, last = self.ranges(strings[:, open_], depth)
            full = (last - first).sum(0) >= need
            if depth == 0:
                full[:] = True
            for at in np.flatnonzero(full):
                q = open_[at]
                seen = np.zeros(len(self.ids), bool)
                for order, a, b in zip(self.order, first[:, at], last[:, at], strict=True):
                    seen[order[a:b]] = True
                rows = np.flatnonzero(seen & (self.ids != ids[q]))
                distance = np.sqrt(((self.vectors[rows] - vectors[q]) ** 2).sum(1))
                if len(rows) > k:
                    limit = np.partition(distance, k - 1)[k - 1]
                    rows, distance = rows[distance <= limit], distance[distance <= limit]
                best = np.lexsort((self.ids[rows], distance))[:k]
                found[q] = (self.ids[rows][best], distance[best])
            open_ = open_[~full]
            if not len(open_):
                break
        return found


def brute_force(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[np.ndarray]:
    out = []
    for i, q in zip(query_ids, queries, strict=True):
        rows = np.flatnonzero(ids != i)
        distance = np.sqrt(((vectors[rows] - q) ** 2).sum(1))
        out.append(ids[rows][np.lexsort((ids[rows], distance))[:k]])
    return out


def recall(found: list[np.ndarray], truth: list[np.ndarray]) -> float:
    return sum(len(np.intersect1d(a, b)) for a, b in zip(found, truth, strict=True)) / max(1, sum(map(len, truth)))


def merged(found: list[list[tuple[np.ndarray, np.ndarray]]], k: int) -> list[np.ndarray]:
    """The ids of the k nearest of each query, of what several segments have found."""
    out = []
    for own in zip(*found, strict=True):
        ids, distance = (np.concatenate([x[i] for x in own]) for i in (0, 1))
        out.append(ids[np.lexsort((ids, distance))[:k]])
    return out


def fit_planes(sample_ids: np.ndarray, sample: np.ndarray, k: int, trees: int, seed: int, wanted: float, segment_rows: int, queries: int = 100) -> Planes:
    """Hyperplanes, and the least `enough` that gives the sample's own first queries the wanted recall, in segments of
    the size that all rows are dealt to."""
    planes = Planes.draw(sample, trees, seed)
    parts = -(-len(sample) // segment_rows)
    segments = [Segment(planes, sample_ids[i::parts], sample[i::parts]) for i in range(parts)]
    ids, own = sample_ids[:queries], sample[:queries]
    truth = brute_force(sample_ids, sample, ids, own, k)
    for enough in (*(2.0 ** (e / 2) for e in range(-14, 11)), float(trees)):
        planes.enough = enough
        if recall(merged([s.search(ids, own, k) for s in segments], k), truth) >= wanted:
            break
    return planes


def nearest(
    rows: DataFrame,
    k: int = 10,
    every: int = 100,
    trees: int = 64,
    seed: int = 7,
    wanted_recall: float = 0.95,
    sample_rows: int = 8192,
    segment_rows: int = 32_768,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found (Euclidean) of each row whose vec_id `every` divides.

    rows has vec_id and embedding. Every valid row is indexed and is a candidate for all queries but its own id. Rows
    with a null id, and vectors that are null, zero, of another than the commonest dimension or hold a null or a
    non-finite component, take no part. Of rows with one id the least vector counts; they meet before any is indexed.
    Hyperplanes and the number of
    candidates are fitted on sample_rows rows at most. A query with fewer candidates than k gets all of them; an empty
    table gives no rows.
    """
    spark = rows.sparkSession
    whole = F.transform("embedding", lambda x: x.cast("double"))
    fine = rows.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v")).where(
        F.col("vec_id").isNotNull()
        & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists("v", lambda x: x != 0)
    )
    counts = (F.count("*").alias("n"), F.count_distinct("vec_id").alias("ids"))
    sizes = fine.groupBy(F.size("v").alias("d")).agg(*counts).orderBy(F.desc("n"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    d, n, ids = sizes[0]
    fine = fine.where(F.size("v") == d)
    if ids < n:
        fine = stored(fine.groupBy("vec_id").agg(F.min("v").alias("v")), "neighbour-rows")
    first = fine.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toPandas()
    planes = fit_planes(first["vec_id"].to_numpy(), np.stack(first["v"].to_numpy()), k, trees, seed, wanted_recall, segment_rows)
    segments = -(-ids // segment_rows)
    own = F.pmod(F.xxhash64("vec_id"), F.lit(segments)).cast("int")
    index = fine.select(own.alias("segment"), F.lit(0).alias("asks"), "vec_id", "v")
    asked = fine.where(F.col("vec_id") % every == 0).select(F.explode(F.sequence(F.lit(0), F.lit(segments - 1))).alias("segment"), F.lit(1).alias("asks"), "vec_id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, segment = None, [], None
        for b in batches:
            numbers, asks, vec = (b.column(c).to_numpy() for c in ("segment", "asks", "vec_id"))
            vectors = b.column("v").flatten().to_numpy().reshape(-1, d)
            cuts = np.flatnonzero(np.diff(numbers * 2 + asks, prepend=-1)).tolist()
            for low, high in zip(cuts, [*cuts[1:], len(vec)], strict=True):
                if numbers[low] != now:
                    now, held, segment = numbers[low], [], None
                if not asks[low]:
                    held.append((vec[low:high], vectors[low:high]))
                    continue
                if held and segment is None:  # all its rows are here: they come first
                    rows = [np.concatenate([h[i] for h in held]) for i in (0, 1)]
                    by = np.argsort(rows[0])
                    segment = Segment(planes, rows[0][by], rows[1][by])
                if segment is not None:
                    found = segment.search(vec[low:high], vectors[low:high], k)
                    sizes = [len(a) for a, _ in found]
                    columns = [np.repeat(vec[low:high], sizes), np.concatenate([a for a, _ in found]), np.concatenate([x for _, x in found])]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

    dealt = index.unionByName(asked).repartition("segment").sortWithinPartitions("segment", "asks")
    parts = dealt.mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
