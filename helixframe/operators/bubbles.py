"""Popping of bubbles: of short parallel chains between two nodes the weaker ones go."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixframe.functions import kmer as K
from helixframe.functions.similarity import MAX_BUBBLE_LENGTH, sequences_similar
from helixframe.operators.compact import compact
from helixframe.operators.kmers import Graph
from helixframe.session import stored


def _coverage(nodes: DataFrame) -> DataFrame:
    total = F.aggregate("occs", F.lit(0).cast("long"), lambda a, x: a + x)
    return nodes.select("id", "seq", total.alias("total"), (total / F.size("occs")).alias("coverage"))


def bubbles(graph: Graph) -> DataFrame:
    """pop, trunk, total: chains that are to go, the chain that stays instead, and the occurrences it gains.

    At each side with several arcs the trunk is the neighbour of the highest coverage, of equal ones that of the least
    base. Another neighbour pops if it has at most 200 bases and one arc at each end, if it leads to the same side of the
    same node as the trunk, and if its sequence is like the trunk's on either strand. Each chain pops once, and none that
    is a trunk elsewhere in the pass.
    """
    nodes, arcs = stored(_coverage(graph.nodes), "coverage"), graph.arcs.where("src != dst")
    sides = graph.arcs.groupBy("src", "side").agg(F.count("*").alias("n"))
    forks = arcs.join(sides.where("n > 1").select("src", "side"), ["src", "side"]).select(
        F.col("src").alias("root"), F.col("side").alias("root_side"), "base", F.col("dst").alias("id"), F.col("dst_side").alias("entry")
    )
    ranked = forks.join(nodes, "id").withColumn(
        "rank", F.row_number().over(Window.partitionBy("root", "root_side").orderBy(F.desc("coverage"), "base"))
    )
    ranked = stored(ranked, "forks")
    onward = arcs.select(F.col("src").alias("id"), F.when(F.col("side") == "L", "R").otherwise("L").alias("entry"), F.col("dst").alias("join"), F.col("dst_side").alias("join_side"))
    single = sides.where("n = 1").groupBy("src").agg(F.count("*").alias("ends")).where("ends = 2").select(F.col("src").alias("id"))
    # both ends have one arc: the one from the root and the one to the join
    pops = (
        ranked.where((F.col("rank") > 1) & (F.length("seq") <= MAX_BUBBLE_LENGTH))
        .join(single, "id", "left_semi")
        .join(onward, ["id", "entry"])
        .select("root", "root_side", F.col("id").alias("pop"), F.col("entry").alias("pop_entry"), F.col("seq").alias("pop_seq"), "total", "join", "join_side")
    )
    trunks = ranked.where("rank = 1").join(onward, ["id", "entry"]).select("root", "root_side", F.col("id").alias("trunk"), F.col("seq").alias("trunk_seq"), "join", "join_side")
    pairs = pops.join(trunks, ["root", "root_side", "join", "join_side"]).where("pop != trunk and length(trunk_seq) <= 200")
    alike = sequences_similar(F.col("pop_seq"), F.col("trunk_seq")) | sequences_similar(K.reverse_complement(F.col("pop_seq")), F.col("trunk_seq"))
    found = stored(pairs.where(alike).groupBy("pop").agg(F.min_by(F.struct("trunk", "total"), F.struct("root", "root_side")).alias("x")).select("pop", "x.*"), "bubbles")
    return found.join(found.select(F.col("trunk").alias("pop")), "pop", "left_anti")


def pop_bubbles(graph: Graph, max_passes: int = 100) -> Graph:
    """Passes of popping, with chains compacted after each, until none is left. The trunk gains the occurrences of what
    it replaces, but no k-mers, so its coverage grows."""
    for _ in range(max_passes):
        gone = stored(bubbles(graph), "popped")
        if not gone.limit(1).count():
            return graph
        ids = gone.select("pop")
        gains = gone.groupBy(F.col("trunk").alias("id")).agg(F.sum("total").alias("gain"))
        first = F.concat(F.array(F.get("occs", F.lit(0)) + F.coalesce("gain", F.lit(0))), F.slice("occs", F.lit(2), F.size("occs")))
        nodes = graph.nodes.join(ids.withColumnRenamed("pop", "id"), "id", "left_anti").join(gains, "id", "left").withColumn("occs", first).drop("gain")
        arcs = graph.arcs.join(ids.withColumnRenamed("pop", "src"), "src", "left_anti").join(ids.withColumnRenamed("pop", "dst"), "dst", "left_anti")
        graph = compact(replace(graph, nodes=nodes, arcs=arcs, tables=False))
    raise RuntimeError(f"popping did not settle in {max_passes} passes")
