"""Filters on chains, and the fixed order of steps that turns a clipped graph into contigs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from helixframe.operators.bubbles import pop_bubbles
from helixframe.operators.clip import clip
from helixframe.operators.compact import compact
from helixframe.operators.kmers import Graph
from helixframe.session import stored


def cut_coverage(graph: Graph, least: float = 0.0, most: float = 0.0) -> Graph:
    """Without nodes whose coverage is below least or above most (0: no limit), and without arcs to or from them."""
    if most and least >= most:
        raise ValueError("the least coverage must be below the most")
    if not least and not most:
        return graph
    coverage = F.aggregate("occs", F.lit(0).cast("long"), lambda a, x: a + x) / F.size("occs")
    gone = (coverage < least if least else F.lit(False)) | (coverage > most if most else F.lit(False))
    ids = stored(graph.nodes.where(gone).select("id"), "cut")
    arcs = graph.arcs.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return replace(graph, nodes=graph.nodes.where(~gone), arcs=arcs, tables=False)


def min_contig_length(unitigs, k: int, least: int):
    """Only contigs of at least least + k - 1 bases, that is of `least` k-mers."""
    return unitigs.where(F.length("seq") >= least + k - 1)


def finish(graph: Graph, least: float = 0.0, most: float = 0.0, bubbles: bool = False) -> Graph:
    """Clip, join chains, pop, cut by coverage, pop, clip, pop, clip, join; popping only if bubbles are asked for."""
    pop = pop_bubbles if bubbles else (lambda g: g)
    graph = pop(clip(graph))
    graph = compact(cut_coverage(graph, least, most))
    graph = clip(pop(graph))
    return clip(pop(graph))
