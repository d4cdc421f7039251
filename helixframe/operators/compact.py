"""Chains of nodes as single nodes.

A node is left at a side, along the only arc there, into a side that has no other arc: then both are one chain. The
states (node, side it is left at) form lists; pointer doubling finds the end of each and the distance to it, so a chain
of n nodes takes log n joins. A chain's orientation, position by position, follows from its two ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions import kmer as K
from helixframe.operators.kmers import Graph
from helixframe.session import stored


def port(node: str, side: str) -> Column:
    return F.concat(F.col(node), F.lit("|"), F.col(side))


def opposite(side: str) -> Column:
    return F.when(F.col(side) == "L", "R").otherwise("L")


def mergeable(arcs: DataFrame) -> DataFrame:
    """Half-arcs that are alone on their side at both ends, with their twin's mark; arcs of a node to itself are not."""
    alone = arcs.groupBy("src", "side").agg(F.count("*").alias("n"), F.first("mark").alias("own")).where("n = 1").select("src", "side", "own")
    there = alone.select(F.col("src").alias("dst"), F.col("side").alias("dst_side"), F.col("own").alias("twin_mark"))
    return arcs.where("src != dst").join(alone.drop("own"), ["src", "side"], "left_semi").join(there, ["dst", "dst_side"])


def _ends(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, bool]:
    """port, id, side, to (the port at which its list ends), dist, done, low; and whether some are in cycles."""
    nexts = links.select(port("src", "side").alias("port"), F.concat(F.col("dst"), F.lit("|"), opposite("dst_side")).alias("to"))
    ports = nodes.select("id", F.explode(F.array(F.lit("L"), F.lit("R"))).alias("side")).select("id", "side", port("id", "side").alias("port"))
    states = ports.join(nexts, "port", "left").select(
        "port", "id", "side", F.coalesce("to", "port").alias("to"), F.when(F.col("to").isNull(), 0).otherwise(1).cast("long").alias("dist"),
        F.col("to").isNull().alias("done"), F.least("port", F.coalesce("to", "port")).alias("low"),
    )
    # a list ends with a state that is its own end and counts no step

    def doubled(states: DataFrame) -> DataFrame:
        ahead = states.select(F.col("port").alias("to"), F.col("to").alias("far"), F.col("dist").alias("more"), F.col("done").alias("ended"), F.col("low").alias("lower"))
        moved = states.where(~F.col("done")).join(ahead, "to").select(
            "port", "id", "side", F.col("far").alias("to"), (F.col("dist") + F.col("more")).alias("dist"), F.col("ended").alias("done"), F.least("low", "lower").alias("low")
        )
        return states.where("done").unionByName(moved)

    states = stored(states, "chains")
    count, rounds = states.count(), 0
    todo = states.where(~F.col("done")).limit(1).count()
    while todo and 2**rounds <= 2 * count:
        states = stored(doubled(doubled(states)), "chains")
        todo, rounds = states.where(~F.col("done")).limit(1).count(), rounds + 2
    return states, bool(todo)


def compact(graph: Graph, keep_cycles: bool = False) -> Graph:
    """The graph with every chain as one node. A chain that closes to a cycle is dropped, or, with keep_cycles, cut at
    its least node. A node's id is the least of its chain's; its orientation does not depend on how rows are dealt."""
    nodes, all_arcs = (graph.nodes, graph.arcs) if graph.tables else (stored(graph.nodes, "nodes"), stored(graph.arcs, "arcs"))
    links = stored(mergeable(all_arcs), "links")
    states, cyclic = _ends(nodes, links)
    if cyclic and keep_cycles:
        cut = states.where(~F.col("done")).where(F.col("low") == F.col("port")).select("id").distinct()
        cut = stored(cut, "cuts")
        left = links.join(cut, F.col("src") == F.col("id"), "left_semi").where("side = 'L'")
        twins = left.select(F.col("dst").alias("src"), F.col("dst_side").alias("side"))
        gone = stored(left.select("src", "side").unionByName(twins).distinct(), "cuts")
        links = stored(links.join(gone, ["src", "side"], "left_anti"), "links")
        states, cyclic = _ends(nodes, links)
    states = states.where("done")
    right = states.where("side = 'R'").select("id", F.col("to").alias("to_r"), F.col("dist").alias("dist_r"))
    left = states.where("side = 'L'").select("id", F.col("to").alias("to_l"), F.col("dist").alias("dist_l"))
    placed = right.join(left, "id").select(
        "id",
        (F.col("to_r") < F.col("to_l")).alias("flip"),
        F.least("to_r", "to_l").alias("chain"),
        F.greatest("to_r", "to_l").alias("last"),
        F.when(F.col("to_r") < F.col("to_l"), F.col("dist_r")).otherwise(F.col("dist_l")).alias("pos"),
    )
    placed = stored(placed, "placed")
    step = links.select(F.col("src").alias("id"), "side", F.col("weight").alias("w"), F.col("mark").alias("mf"), F.col("twin_mark").alias("mb"))
    exit_side = F.when(F.col("flip"), "L").otherwise("R")
    members = nodes.join(placed, "id").withColumn("side", exit_side).join(step, ["id", "side"], "left")
    turned = lambda c: F.when(F.col("flip"), F.reverse(c)).otherwise(F.col(c))
    member = F.struct(
        "pos",
        "id",
        F.when(F.col("flip"), K.reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"),
        turned("occs").alias("occs"),
        turned("weights").alias("weights"),
        F.when(F.col("flip"), F.reverse("marks_b")).otherwise(F.col("marks_f")).alias("marks_f"),
        F.when(F.col("flip"), F.reverse("marks_f")).otherwise(F.col("marks_b")).alias("marks_b"),
        "w",
        "mf",
        "mb",
    )
    chains = members.groupBy("chain", "last").agg(F.sort_array(F.collect_list(member)).alias("m"), F.min("id").alias("new_id"))

    def flat(field: str, link: str) -> Column:
        return F.flatten(F.transform("m", lambda x: F.concat(x[field], F.filter(F.array(x[link]), lambda y: y.isNotNull()))))

    tail = F.array_join(F.transform(F.slice("m", 2, F.greatest(F.size("m") - 1, F.lit(0))), lambda x: F.substring(x["seq"], graph.k, F.lit(2**30))), "")
    built = stored(
        chains.select(
            "chain",
            "last",
            F.col("new_id").alias("id"),
            F.concat(F.get("m", F.lit(0))["seq"], tail).alias("seq"),
            F.flatten(F.transform("m", lambda x: x["occs"])).alias("occs"),
            flat("weights", "w").alias("weights"),
            flat("marks_f", "mf").alias("marks_f"),
            flat("marks_b", "mb").alias("marks_b"),
        ),
        "unitigs",
    )
    flips = placed.select("id", "flip")
    border = built.select(F.col("chain").alias("old"), F.col("id").alias("new"), F.lit("L").alias("new_side")).unionByName(
        built.select(F.col("last").alias("old"), F.col("id").alias("new"), F.lit("R").alias("new_side"))
    )
    outer = all_arcs.join(links.select("src", "side"), ["src", "side"], "left_anti")
    at_src = border.select(F.col("old").alias("p"), F.col("new").alias("n_src"), F.col("new_side").alias("n_side"))
    at_dst = border.select(F.col("old").alias("q"), F.col("new").alias("n_dst"), F.col("new_side").alias("n_dst_side"))
    arcs = (
        outer.withColumns({"p": port("src", "side"), "q": port("dst", "dst_side")})
        .join(at_src, "p")
        .join(at_dst, "q")
        .join(flips.withColumnRenamed("id", "src"), "src")
        .select(
            F.col("n_src").alias("src"),
            F.col("n_side").alias("side"),
            F.when(F.col("flip"), K.complement(F.col("base"))).otherwise(F.col("base")).alias("base"),
            "weight",
            "mark",
            F.col("n_dst").alias("dst"),
            F.col("n_dst_side").alias("dst_side"),
        )
    )
    return Graph(graph.k, built.drop("chain", "last"), stored(arcs, "unitig-arcs"), tables=True)


def unitigs(graph: Graph) -> DataFrame:
    """node_id, seq (the lesser of both strands), n_kmers, kmer_occurrences, coverage."""
    occurrences = F.aggregate("occs", F.lit(0).cast("long"), lambda a, x: a + x)
    n = F.size("occs")
    return graph.nodes.select(
        F.col("id").alias("node_id"),
        F.least("seq", K.reverse_complement(F.col("seq"))).alias("seq"),
        n.alias("n_kmers"),
        occurrences.alias("kmer_occurrences"),
        (occurrences / n).alias("coverage"),
    )
