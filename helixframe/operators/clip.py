"""Clipping of tips, on chains.

A tip is a chain with nothing at one end. Walking in from there, all of it goes if it leads nowhere, or if it meets a
junction by an arc that is not the junction's heaviest or has weight 1. It stays if it is long (2k k-mers and not all of
its arcs single), if it forks, or if its arc is the junction's heaviest; even then the k-mers nearest to the free end go,
as far as all arcs up to and including the next have weight 1, or up to an arc that an earlier junction has marked.
A junction whose heaviest arc on a side is single and belongs to a tip that goes marks all single arcs on that side, so
that equal tips go together. Decisions of a pass see the graph as it was before it; passes go on until none changes it.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions import kmer as K
from helixframe.operators.compact import compact
from helixframe.operators.kmers import Graph, degrees
from helixframe.session import stored


def _first(array: Column, wanted) -> Column:
    """The place (from 1) of the first element that is wanted, 0 if none is."""
    return F.coalesce(F.array_position(F.transform(array, wanted), F.lit(True)).cast("int"), F.lit(0))


def _tips(graph: Graph) -> DataFrame:
    """id, n, cut (k-mers that go from each end), whole, and of the junction that is left: dst, dst_side, marks."""
    k = graph.k
    degree = degrees(graph.arcs).withColumnRenamed("src", "id")
    nodes = graph.nodes.join(degree, "id", "left").fillna(0, ["lefts", "rights"]).withColumn("n", F.size("occs"))
    ends = nodes.where("lefts = 0 or rights = 0").select(
        "id",
        "n",
        F.inline(
            F.array(
                F.struct(F.lit("L").alias("end"), F.lit("R").alias("far"), F.col("lefts").alias("own"), F.col("rights").alias("out"), F.col("weights").alias("w"), F.col("marks_b").alias("back")),
                F.struct(F.lit("R").alias("end"), F.lit("L").alias("far"), F.col("rights").alias("own"), F.col("lefts").alias("out"), F.reverse("weights").alias("w"), F.reverse("marks_f").alias("back")),
            )
        ),
    )
    tips = ends.where("own = 0 and (n > 1 or out <= 1)")
    junctions = graph.arcs.groupBy("src", "side").agg(F.count("*").alias("arcs"), F.max("weight").alias("heaviest"))
    onward = graph.arcs.join(
        junctions.select(F.col("src").alias("dst"), F.col("side").alias("dst_side"), F.col("arcs").alias("meets"), "heaviest"), ["dst", "dst_side"]
    ).select(F.col("src").alias("id"), F.col("side").alias("far"), "weight", "dst", "dst_side", "meets", "heaviest")
    tips = tips.join(onward.withColumn("out", F.lit(1).cast("long")), ["id", "far", "out"], "left")
    not_single = _first(F.col("w"), lambda x: x > 1)
    single = F.when(not_single == 0, F.col("n") - 1).otherwise(not_single - 1)  # arcs of weight 1 from the free end on
    tips = tips.withColumn("single", single).withColumn("stop", F.greatest(F.lit(2 * k), F.col("single") + 2))
    inside = F.col("stop") <= F.col("n")
    walked = F.when(inside, F.col("stop") - 1).otherwise(F.col("n") - 1)
    back = F.slice("back", F.lit(1), walked)
    forced = F.when(F.array_contains(back, True), walked + 1 - _first(F.reverse(back), lambda x: x)).otherwise(0)
    dominant = (F.col("weight") >= 2) & (F.col("weight") == F.col("heaviest"))
    meets = F.coalesce(F.col("meets"), F.lit(0))
    whole = ~inside & ((F.col("out") == 0) | ((F.col("out") == 1) & (meets > 1) & ~dominant))
    return tips.select(
        "id", "n", "end", whole.alias("whole"), F.when(whole, F.col("n")).otherwise(F.greatest(F.col("single"), forced)).alias("cut"),
        F.when(whole & (F.col("out") == 1) & (F.col("weight") == 1) & (F.col("heaviest") == 1), F.col("dst")).alias("dst"), "dst_side",
    )


def clip_once(graph: Graph) -> tuple[Graph, int]:
    """One pass over a graph of chains, and how many chains it changed."""
    tips = stored(_tips(graph), "tips")
    cuts = tips.where("cut > 0").groupBy("id").agg(
        F.max("n").alias("n"),
        F.coalesce(F.max(F.when(F.col("end") == "L", F.col("cut"))), F.lit(0)).alias("l"),
        F.coalesce(F.max(F.when(F.col("end") == "R", F.col("cut"))), F.lit(0)).alias("r"),
    )
    cuts = stored(cuts, "cuts")
    changed = cuts.count()
    if not changed:
        return graph, 0
    gone = cuts.where("l + r >= n").select("id")
    rest = F.size("occs") - F.col("l") - F.col("r")
    kept = graph.nodes.join(gone, "id", "left_anti").join(cuts.drop("n"), "id", "left").fillna(0, ["l", "r"])
    inner = lambda c: F.slice(c, F.col("l") + 1, rest - 1).alias(c)
    nodes = kept.select(
        "id", F.substring("seq", F.col("l") + 1, rest + graph.k - 1).alias("seq"), F.slice("occs", F.col("l") + 1, rest).alias("occs"),
        inner("weights"), inner("marks_f"), inner("marks_b"),
    )
    marks = tips.where("dst is not null").select(F.col("dst").alias("src"), F.col("dst_side").alias("side"), F.lit(True).alias("now")).distinct()
    arcs = (
        graph.arcs.join(gone.withColumnRenamed("id", "src"), "src", "left_anti")
        .join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
        .join(marks, ["src", "side"], "left")
        .select("src", "side", "base", "weight", (F.col("mark") | (F.col("now").isNotNull() & (F.col("weight") == 1))).alias("mark"), "dst", "dst_side")
    )
    return replace(graph, nodes=stored(nodes, "clipped"), arcs=stored(arcs, "clipped-arcs"), tables=True), changed


def clip(graph: Graph, keep_cycles: bool = False, max_passes: int = 200) -> Graph:
    """The compacted graph without tips. Raises if passes do not come to an end."""
    graph = compact(graph, keep_cycles)
    for _ in range(max_passes):
        graph, changed = clip_once(graph)
        if not changed:
            return graph
        graph = compact(graph, keep_cycles)
    raise RuntimeError(f"clipping did not settle in {max_passes} passes")


def reverse_complements_equal(a: DataFrame, b: DataFrame, column: str = "seq") -> bool:
    """Whether two tables have the same sequences, each as often, whatever the strand."""
    x, y = (d.select(F.least(column, K.reverse_complement(F.col(column))).alias("seq")) for d in (a, b))
    return not x.exceptAll(y).limit(1).count() and not y.exceptAll(x).limit(1).count()
