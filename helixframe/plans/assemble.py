"""Whole runs: reads to contigs, in one graph or partition by partition, and their reports."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions import kmer as K
from helixframe.operators.clip import clip
from helixframe.operators.compact import compact, unitigs
from helixframe.operators.finish import finish, min_contig_length
from helixframe.operators.kmers import Graph, de_bruijn, kmer_counts
from helixframe.operators.partition import Partitioner, coloured_arcs, components, resolved, targets
from helixframe.operators.report import contig_stats, coverage_histogram, weighted_median_coverage
from helixframe.session import stored
from helixframe.sources.reads import split_unknown


@dataclass(frozen=True)
class Options:
    """What a run can be told: k; whether other characters than bases cut a read or count as A; whether tips are clipped,
    bubbles popped, isolated cycles kept; the least and the most coverage (0: any); and the cap on an arc's weight."""

    k: int
    unknown: str = "A"
    clip: bool = True
    bubbles: bool = False
    keep_cycles: bool = False
    cov_cutoff: float = 0.0
    max_coverage: float = 0.0
    max_weight: int = K.MAX_WEIGHT


def prepared(reads: DataFrame, options: Options) -> DataFrame:
    if options.unknown == "split":
        return split_unknown(reads).drop("stretch")
    return reads.withColumn("seq", K.normalise(F.col("seq")))


def assemble(reads: DataFrame, options: Options) -> Graph:
    """Reads to clipped chains."""
    graph = de_bruijn(prepared(reads, options), options.k, options.max_weight)
    return clip(graph, options.keep_cycles) if options.clip else compact(graph, options.keep_cycles)


def assemble_in_parts(reads: DataFrame, options: Options, m: int, partitioner: Partitioner, parts: int, rounds: int = 2) -> Graph:
    """The same chains, partition by partition.

    K-mers and arcs have the colour of their mini-k-mer, and arcs to another colour are borders. In each round the next
    partitions are loaded: borders between loaded ones become inner arcs, and the components that have no border left are
    final. These leave, are clipped and compacted by themselves; the others wait for the partitions of later rounds. In
    the end all finished components are one graph."""
    reads = prepared(reads, options)
    none = "cast(array() as array<int>) as weights", "cast(array() as array<boolean>) as marks_f", "cast(array() as array<boolean>) as marks_b"
    color = partitioner(K.mini_kmer(F.col("kmer"), options.k, m))
    waiting = stored(kmer_counts(reads, options.k).withColumn("color", color), "waiting-nodes")
    arcs = stored(coloured_arcs(reads, options.k, m, partitioner, options.max_weight), "waiting-arcs")
    done: list[Graph] = []
    for i in range(1, rounds + 1):
        upto = parts * i // rounds
        loaded, near = waiting.where(F.col("color") <= upto), resolved(arcs, upto)
        found = targets(components(loaded.withColumnRenamed("kmer", "id"), near, parts), parts, upto)
        final = stored(found.where("target = 'final'").select("id"), "final")
        nodes = waiting.join(final, F.col("kmer") == F.col("id"), "left_semi").selectExpr("kmer as id", "kmer as seq", "array(occ) as occs", *none)
        own = arcs.join(final, F.col("src") == F.col("id"), "left_semi").select("src", "side", "base", "weight", F.lit(False).alias("mark"), "dst", "dst_side")
        graph = Graph(options.k, nodes, own)
        done.append(clip(graph, options.keep_cycles) if options.clip else compact(graph, options.keep_cycles))
        if i < rounds:
            waiting = stored(waiting.join(final, F.col("kmer") == F.col("id"), "left_anti"), "waiting-nodes")
            arcs = stored(arcs.join(final, F.col("src") == F.col("id"), "left_anti"), "waiting-arcs")
    union = lambda name: reduce(DataFrame.unionByName, [getattr(g, name) for g in done])
    return Graph(options.k, union("nodes"), union("arcs"))


def contigs(reads: DataFrame, options: Options, least_kmers: int = 0) -> DataFrame:
    """Unitigs after the whole fixed sequence of finishing steps."""
    graph = finish(assemble(reads, options), options.cov_cutoff, options.max_coverage, options.bubbles)
    return min_contig_length(unitigs(graph), options.k, least_kmers)


def reports(found: DataFrame) -> dict[str, DataFrame]:
    return {"stats": contig_stats(found), "histogram": coverage_histogram(found), "median": weighted_median_coverage(found)}
