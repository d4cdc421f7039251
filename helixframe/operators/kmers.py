"""K-mers of reads, and the weighted, strand-aware de Bruijn graph they make.

The graph is two tables. Nodes are canonical k-mers. Arcs are kept as both of their halves: (src, side, base) is the
neighbour that follows when src is left at that side (L or R of its canonical form) towards that base, dst and dst_side
the node and the side of it that is reached.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions import kmer as K
from helixframe.sources.reads import long_enough

FRAGMENT = 100


def exploded(reads: DataFrame, width: int) -> DataFrame:
    """read_id, pos (from 0), word: all substrings of that width, and the reads' sample if they have one.

    Reads are cut first into fragments that overlap in width - 1 bases, so that no substring is looked up far from the
    beginning of a long string.
    """
    keys = ["read_id", *(["sample"] if "sample" in reads.columns else [])]
    starts = F.sequence(F.lit(0), F.length("seq") - width, F.lit(FRAGMENT))
    cut = reads.where(F.length("seq") >= width).select(*keys, "seq", F.explode(starts).alias("at"))
    pieces = cut.select(*keys, "at", F.substring("seq", F.col("at") + 1, F.lit(FRAGMENT + width - 1)).alias("piece"))
    return pieces.select(*keys, "at", F.posexplode(K.windows(F.col("piece"), width)).alias("i", "word")).select(
        *keys, (F.col("at") + F.col("i")).alias("pos"), "word"
    )


def kmers(reads: DataFrame, k: int) -> DataFrame:
    """read_id, pos, kmer, canon, sense_reversed of every k-mer of the reads that are longer than k."""
    K.check_k(k)
    words = exploded(long_enough(reads, k), k).withColumnRenamed("word", "kmer")
    return words.withColumns({"canon": K.canonical(F.col("kmer")), "sense_reversed": K.is_reversed(F.col("kmer"))})


def _words(reads: DataFrame, width: int) -> DataFrame:
    """word, twin (its reverse complement), comp and back (both read backwards: complement and reverse), and sample and n of
    the reads: all substrings of that width of the reads longer than k. Strands are turned once a fragment."""
    keys = [c for c in ("sample", "n") if c in reads.columns]
    starts = F.sequence(F.lit(0), F.length("seq") - width, F.lit(FRAGMENT))
    cut = reads.where(F.length("seq") >= width).select(*keys, "seq", F.explode(starts).alias("at"))
    pieces = cut.select(*keys, F.substring("seq", F.col("at") + 1, F.lit(FRAGMENT + width - 1)).alias("piece"))
    piece = F.col("piece")
    turned = F.struct(piece.alias("fore"), K.complement(piece).alias("comp"), F.reverse(piece).alias("back"), K.reverse_complement(piece).alias("twin"))
    strands = pieces.select(*keys, F.inline(F.array(turned)))
    i, last = F.col("i"), F.length("fore") - width + 1
    placed = strands.select(*keys, "fore", "comp", "back", "twin", F.explode(F.sequence(F.lit(1), last)).alias("i"))
    from_end = last - i + 1
    at = lambda c, i: F.substring(c, i, F.lit(width)).alias(c if c != "fore" else "word")
    return placed.select(*keys, at("fore", i), at("comp", i), at("back", from_end), at("twin", from_end))


def _times(reads: DataFrame) -> Column:
    return F.sum("n") if "n" in reads.columns else F.count("*")


def kmer_counts(reads: DataFrame, k: int) -> DataFrame:
    """kmer (canonical) and occ; and sample, if reads have it. A read with n counts n times."""
    K.check_k(k)
    words = _words(long_enough(reads, k), k)
    keys = ["sample"] if "sample" in reads.columns else []
    canon = F.when(F.col("comp") < F.col("back"), F.col("twin")).otherwise(F.col("word"))
    return words.groupBy(*keys, canon.alias("kmer")).agg(_times(reads).alias("occ"))


def half_arcs(reads: DataFrame, k: int, max_weight: int | None = K.MAX_WEIGHT) -> DataFrame:
    """src, side, base, weight, dst, dst_side, sense_changed of both halves of every arc; and sample, if reads have it.

    (k+1)-mers are counted, each with its reverse complement, a read with n n times. A half tells its (k+1)-mer, so each
    comes from one row; one that is its own reverse complement has both of its halves in one and counts twice. Weights
    end at max_weight, if there is one.
    """
    K.check_k(k)
    keys = ["sample"] if "sample" in reads.columns else []
    words = _words(long_enough(reads, k), k + 1)
    counted = words.groupBy(*keys, F.least("word", "twin").alias("word")).agg(_times(reads).alias("n"))
    word = F.col("word")
    turned = F.struct(K.complement(word).alias("comp"), F.reverse(word).alias("back"), K.reverse_complement(word).alias("twin"))
    part = lambda c, i, n: F.substring(c, i, n)
    strands = counted.select(*keys, "n", "word", F.inline(F.array(turned)))
    ends = strands.select(
        *keys, "n", "word", "comp", "twin", (part("comp", 1, k) < part("back", 2, k)).alias("ar"), (part("comp", 2, k) < part("back", 1, k)).alias("br")
    )
    ends = ends.select(
        *keys,
        "n",
        "ar",
        "br",
        (F.col("word") == F.col("twin")).alias("own_twin"),
        F.when(F.col("ar"), part("twin", 2, k)).otherwise(part("word", 1, k)).alias("a"),
        F.when(F.col("br"), part("twin", 1, k)).otherwise(part("word", 2, k)).alias("b"),
        F.when(F.col("ar"), part("comp", k + 1, 1)).otherwise(part("word", k + 1, 1)).alias("added"),
        F.when(F.col("br"), part("comp", 1, 1)).otherwise(part("word", 1, 1)).alias("dropped"),
    )
    out_side, in_side = F.when(F.col("ar"), "L").otherwise("R"), F.when(F.col("br"), "R").otherwise("L")
    sense = (F.col("ar") != F.col("br")).alias("sense_changed")
    half = lambda src, side, base, dst, dst_side: F.struct(
        F.col(src).alias("src"), side.alias("side"), F.col(base).alias("base"), F.col(dst).alias("dst"), dst_side.alias("dst_side"), sense
    )
    there, back = half("a", out_side, "added", "b", in_side), half("b", in_side, "dropped", "a", out_side)
    halves = ends.select(*keys, "n", "own_twin", F.inline(F.when(F.col("own_twin"), F.array(there)).otherwise(F.array(there, back))))
    weight = F.when(F.col("own_twin"), F.col("n") * 2).otherwise(F.col("n"))
    weight = weight if max_weight is None else F.least(weight, F.lit(max_weight))
    return halves.select(*keys, "src", "side", "base", "dst", "dst_side", "sense_changed", weight.cast("int").alias("weight"))


@dataclass
class Graph:
    """Nodes (id, seq, occs, weights, marks_f, marks_b) and half-arcs (src, side, base, weight, mark, dst, dst_side).

    A node is a chain of k-mers: occs has the occurrences of each, weights the weight of each arc between neighbours,
    marks_f and marks_b whether that arc is marked on the left or on the right one's side. All arrays follow seq.
    tables: both are stored already and cost nothing to read again.
    """

    k: int
    nodes: DataFrame
    arcs: DataFrame
    tables: bool = False


def de_bruijn(reads: DataFrame, k: int, max_weight: int | None = K.MAX_WEIGHT) -> Graph:
    """The graph of the reads' k-mers. Nodes of different samples are different nodes."""

    def named(c: str):
        return F.concat(F.col("sample").cast("string"), F.lit(":"), F.col(c)) if "sample" in reads.columns else F.col(c)

    none = "cast(array() as array<int>) as weights", "cast(array() as array<boolean>) as marks_f", "cast(array() as array<boolean>) as marks_b"
    counts = kmer_counts(reads, k).withColumn("id", named("kmer"))
    nodes = counts.selectExpr("id", "kmer as seq", "array(occ) as occs", *none)
    arcs = half_arcs(reads, k, max_weight)
    arcs = arcs.select(named("src").alias("src"), "side", "base", "weight", F.lit(False).alias("mark"), named("dst").alias("dst"), "dst_side")
    return Graph(k, nodes, arcs)


def degrees(arcs: DataFrame) -> DataFrame:
    """src, lefts, rights: arcs on both sides of every node that has any."""
    return arcs.groupBy("src").agg(F.count_if(F.col("side") == "L").alias("lefts"), F.count_if(F.col("side") == "R").alias("rights"))


def node_classes(nodes: DataFrame | None, arcs: DataFrame, node: str = "id") -> DataFrame:
    """id, lefts, rights, class: isolated, tip (one neighbour), linear (one on each side) or branching. Without nodes
    those that have arcs."""
    joined = degrees(arcs).withColumnRenamed("src", "id")
    if nodes is not None:
        joined = nodes.select(F.col(node).alias("id")).join(joined, "id", "left").fillna(0, ["lefts", "rights"])
    kind = (
        F.when((F.col("lefts") == 0) & (F.col("rights") == 0), "isolated")
        .when(F.col("lefts") + F.col("rights") == 1, "tip")
        .when((F.col("lefts") == 1) & (F.col("rights") == 1), "linear")
        .otherwise("branching")
    )
    return joined.withColumn("class", kind)


def broken_arcs(arcs: DataFrame) -> DataFrame:
    """Half-arcs without a twin of the same weight: none, if a graph is sound."""
    twins = arcs.select(F.col("src").alias("dst"), F.col("side").alias("dst_side"), F.col("dst").alias("src"), F.col("dst_side").alias("side"), "weight").distinct()
    return arcs.join(twins, ["src", "side", "dst", "dst_side", "weight"], "left_anti")
