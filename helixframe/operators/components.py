"""Connected components by alternating large-star and small-star passes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.session import SMALL, discard, stored


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _replace(new: DataFrame, *old: DataFrame) -> DataFrame:
    """Write new, then delete the tables it was made from."""
    kept = stored(new, "components")
    for df in old:
        for path in {p.rpartition("/")[0] for p in df.inputFiles()}:
            discard(df.sparkSession, path)
    return kept


def _in_one_task(edges: DataFrame) -> DataFrame:
    """u and v, the least node reachable, of few edges (u, v) at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = [b for b in batches if b.num_rows]
        if not some:
            return
        table = pa.Table.from_batches(some)
        kind = table.schema.field("u").type
        both = pa.concat_arrays([c for name in ("u", "v") for c in table.column(name).chunks])
        coded = both.dictionary_encode()
        names = coded.dictionary.take(pa.compute.sort_indices(coded.dictionary))
        rank = np.empty(len(names), np.int64)
        rank[pa.compute.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(names))
        u, v = np.split(rank[coded.indices.to_numpy()], 2)
        least = np.arange(len(names))
        while True:  # each node takes the least number around it, and then that one's own, until nothing changes
            before = least.copy()
            low = np.minimum(least[u], least[v])
            np.minimum.at(least, least[u], low)
            np.minimum.at(least, least[v], low)
            least = least[least]
            if (least == before).all():
                break
        other = np.flatnonzero(least != np.arange(len(names)))
        yield pa.RecordBatch.from_arrays([names.take(pa.array(x)).cast(kind) for x in (other, least[other])], names=["u", "v"])

    return edges.coalesce(1).mapInArrow(run, edges.schema)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, at_once: int = 0) -> DataFrame:
    """node and component (the smallest node reachable) of every node that an edge to another node touches.

    Each pass links every node's neighbours to the least of them, the larger ones first, then the smaller ones; all
    edges point at their component's least node in the end. Passes grow with the logarithm of the longest path. Every
    pass is written to the shared folder; of many edges the minima are too: as tables they let a join split a hot node. Edges
    with a null end and loops link nothing. Up to at_once edges are taken by one task instead, which gives the same.
    Raises if max_rounds passes don't settle it.
    """
    a, b = F.col(src), F.col(dst)
    now = stored(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "components")
    mark = _fingerprint(now)
    small = 0 < mark[0] <= at_once
    if small:
        now = _replace(_in_one_task(now), now)
    for _ in range(max_rounds):
        if not mark[0] or small:
            break
        hot = mark[0] > SMALL  # else no node has more rows than a task can take
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        least = stored(least, "components") if hot else least
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = _replace(large, least) if hot else large
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        lower = stored(lower, "components") if hot else lower
        joined = large.join(lower, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = joined.unionByName(lower.select("u", F.col("m").alias("v"))).distinct()
        now = _replace(new, now, large, lower) if hot else _replace(new, now)
        before, mark = mark, _fingerprint(now)
        if before == mark:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} passes")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
