"""Partitions of k-mers by colour, super-k-mers, and what lies across the borders of partitions.

A partitioner is a function from a Column of canonical mini-k-mers to a Column of colours, 1 to P.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import kmer as K
from helixframe.functions.similarity import run_distance
from helixframe.operators.components import connected_components
from helixframe.operators.kmers import half_arcs, kmers
from helixframe.session import SMALL, stored
from helixframe.sources.reads import long_enough

Partitioner = Callable[[Column], Column]


def by_range(m: int, parts: int) -> Partitioner:
    """Equal ranges of the mini-k-mers' codes."""
    if parts > 4**m:
        raise ValueError("there are fewer mini-k-mers than partitions")
    return lambda mini: (F.lit(1) + F.floor(K.encode(mini) / F.lit(4**m // parts))).cast("int")


def by_hash(parts: int) -> Partitioner:
    """A colour by a hash, the same in every run."""
    return lambda mini: (F.pmod(F.xxhash64(mini), F.lit(parts)) + 1).cast("int")


def colour_table(df: DataFrame, mini: str, colours: DataFrame) -> DataFrame:
    """df with the colour of its column `mini` from a table (mini, color); there are 4**m mini-k-mers at most."""
    return df.join(F.broadcast(colours.select(F.col("mini").alias(mini), "color")), mini)


def coloured(reads: DataFrame, k: int, m: int, partitioner: Partitioner) -> DataFrame:
    """read_id, pos, kmer, canon, sense_reversed and color of every k-mer."""
    return kmers(reads, k).withColumn("color", partitioner(K.mini_kmer(F.col("kmer"), k, m)))


def super_kmers(reads: DataFrame, k: int, m: int, partitioner: Partitioner) -> DataFrame:
    """read_id, run, color, n_kmers, seq, prefix_color, suffix_color: each read cut where the colour changes.

    seq has one more base for the k-mer before and after the run, where the read has one; their colours are given. A read
    is cut by itself, so nothing is shuffled.
    """
    K.check_k(k)
    colors = F.transform(K.all_windows(F.col("seq"), k), lambda w: partitioner(K.mini_kmer(w, k, m)))
    # an exploded array of one stands between, so that what stands below is not made again for each element of what follows
    rows = long_enough(reads, k).select("read_id", "seq", F.explode(F.array(colors)).alias("colors"))
    places = F.sequence(F.lit(0), F.size("colors") - 1)
    changes = F.filter(places, lambda i: (i == 0) | (F.get("colors", i) != F.get("colors", i - 1)))
    rows = rows.withColumn("starts", F.explode(F.array(changes)))
    runs = rows.select("read_id", "seq", "colors", "starts", F.posexplode("starts").alias("run", "start"))
    n = F.coalesce(F.get("starts", F.col("run") + 1), F.size("colors")) - F.col("start")
    runs = runs.withColumn("n_kmers", n)
    before, after = (F.col("start") > 0).cast("int"), (F.col("start") + F.col("n_kmers") < F.size("colors")).cast("int")
    return runs.select(
        "read_id", "run", F.get("colors", F.col("start")).alias("color"), "n_kmers",
        F.substring("seq", F.col("start") + 1 - before, F.col("n_kmers") + (k - 1) + before + after).alias("seq"),
        F.when(before == 1, F.get("colors", F.col("start") - 1)).alias("prefix_color"), F.get("colors", F.col("start") + F.col("n_kmers")).alias("suffix_color"),
    )


def piece_lengths(pieces: DataFrame, most: int = 20) -> DataFrame:
    """n (k-mers in a piece, at most `most`), pieces, kmers: how k-mers spread over pieces of each length."""
    return pieces.groupBy(F.least("n_kmers", F.lit(most)).alias("n")).agg(F.count("*").alias("pieces"), F.sum("n_kmers").alias("kmers"))


def mini_kmer_table(spark: SparkSession, m: int) -> DataFrame:
    """mini: all canonical mini-k-mers."""
    words = spark.range(4**m).select(K.decode(F.col("id"), m).alias("mini"))
    return words.where(~K.is_reversed(F.col("mini")))


def mini_kmer_borders(spark: SparkSession, m: int, partitioner: Partitioner) -> DataFrame:
    """color, minis, neighbours, foreign: mini-k-mers of each colour, their neighbours, and those of another colour."""
    own = mini_kmer_table(spark, m).withColumn("color", partitioner(F.col("mini")))
    bases = F.array(*[F.lit(b) for b in K.BASES])
    around = F.concat(
        F.transform(bases, lambda b: F.concat(F.substring("mini", 2, m - 1), b)), F.transform(bases, lambda b: F.concat(b, F.substring("mini", 1, m - 1)))
    )
    steps = own.select("mini", "color", F.explode(around).alias("to")).withColumn("other", partitioner(K.canonical(F.col("to"))))
    return steps.groupBy("color").agg(
        F.count_distinct("mini").alias("minis"), F.count("*").alias("neighbours"), F.count_if(F.col("other") != F.col("color")).alias("foreign")
    )


def coloured_arcs(reads: DataFrame, k: int, m: int, partitioner: Partitioner, max_weight: int | None = K.MAX_WEIGHT) -> DataFrame:
    """Half-arcs with color, of the side's own node, and far, the colour of the other node, 0 if it is the same."""

    def color(c: str) -> Column:
        return partitioner(K.mini_kmer(F.col(c), k, m))

    arcs = half_arcs(reads, k, max_weight).withColumns({"color": color("src"), "other": color("dst")})
    return arcs.withColumn("far", F.when(F.col("other") == F.col("color"), 0).otherwise(F.col("other"))).drop("other")


def resolved(arcs: DataFrame, upto: int) -> DataFrame:
    """Arcs as they are when the partitions 1 to upto have been loaded: those between two of them are no borders."""
    inside = (F.col("color") <= upto) & (F.col("far") <= upto)
    return arcs.where(F.col("color") <= upto).withColumn("far", F.when(inside, 0).otherwise(F.col("far")))


def components(nodes: DataFrame, arcs: DataFrame, parts: int) -> DataFrame:
    """id, component (the least id), min_frontier, borders: components over arcs that stay inside a partition, the least
    colour across their borders (parts + 1 without any), and how many border arcs they have."""
    found = connected_components(arcs.where("far = 0"), at_once=SMALL).withColumnRenamed("node", "id")
    labelled = nodes.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    border = arcs.where("far > 0").groupBy(F.col("src").alias("id")).agg(F.min("far").alias("far"), F.count("*").alias("n"))
    labelled = stored(labelled.join(border, "id", "left"), "members")
    of = labelled.groupBy(F.col("component").alias("of")).agg(F.coalesce(F.min("far"), F.lit(parts + 1)).alias("min_frontier"), F.coalesce(F.sum("n"), F.lit(0)).alias("borders"))
    of = stored(of, "member-borders")  # a table, so that the join can split a component with very many nodes
    return labelled.join(of, F.col("component") == F.col("of")).select("id", "component", "min_frontier", "borders")


def related(members: DataFrame, incoming: DataFrame) -> DataFrame:
    """Those of the members (id, component, ...) that lie in a component with a node that an incoming border arc (dst)
    touches: what a partition that is loaded next can change."""
    touched = members.join(incoming.select(F.col("dst").alias("id")).distinct(), "id", "left_semi").select("component").distinct()
    return members.join(stored(touched, "touched"), "component", "left_semi").select(*members.columns)


def targets(found: DataFrame, parts: int, current: int) -> DataFrame:
    """Where each component goes next: final, the inbox of a later partition, or it stays."""
    where = F.when(F.col("min_frontier") == parts + 1, "final").when(F.col("min_frontier") > current, F.concat(F.lit("inbox-"), F.col("min_frontier").cast("string"))).otherwise("resident")
    return found.withColumn("target", where)


def open_nodes(arcs: DataFrame) -> DataFrame:
    """id: nodes whose fate a border can still change.

    A walk enters a node where a border arc does. It goes on by the only arc of the other side, and, if the side it enters
    has other arcs and its own is weak there (of weight 1, or not the heaviest), by those too, but for border arcs. Walks
    by only arcs are lists, so pointer doubling follows them to their ends in log n joins.
    """
    side_arcs = arcs.groupBy("src", "side").agg(F.count("*").alias("n"), F.max("weight").alias("heaviest"))
    weak = (F.col("n") > 1) & ((F.col("weight") == 1) | (F.col("weight") < F.col("heaviest")))
    every = stored(arcs.join(side_arcs, ["src", "side"]).select("src", "side", "dst", "dst_side", "far", "n", weak.alias("weak")), "sides")
    twin = every.select(F.col("src").alias("dst"), F.col("side").alias("dst_side"), F.col("dst").alias("src"), F.col("dst_side").alias("side"), F.col("weak").alias("to_weak"))
    inner = stored(every.where("far = 0").join(twin, ["src", "side", "dst", "dst_side"]).distinct(), "steps")
    to = [F.col("dst").alias("to_id"), F.col("dst_side").alias("to_side"), "to_weak"]
    entered = F.when(F.col("side") == "L", "R").otherwise("L")
    jumps = [stored(inner.where("n = 1").select(F.col("src").alias("id"), entered.alias("side"), *to), "jumps")]
    count = jumps[0].count()
    while 2 ** len(jumps) <= 2 * count:
        ahead = jumps[-1].select(F.col("id").alias("to_id"), F.col("side").alias("to_side"), F.col("to_id").alias("far_id"), F.col("to_side").alias("far_side"), F.col("to_weak").alias("far_weak"))
        joined = jumps[-1].drop("to_weak").join(ahead, ["to_id", "to_side"])
        longer = stored(joined.select("id", "side", F.col("far_id").alias("to_id"), F.col("far_side").alias("to_side"), F.col("far_weak").alias("to_weak")), "jumps")
        if not longer.limit(1).count():
            break
        jumps.append(longer)
    aside = inner.where("n > 1").select(F.col("src").alias("id"), "side", *to)

    def moved(states: DataFrame, by: DataFrame) -> DataFrame:
        return states.join(by, ["id", "side"]).select(F.col("to_id").alias("id"), F.col("to_side").alias("side"), F.col("to_weak").alias("weak"))

    near = stored(every.where("far > 0").select(F.col("src").alias("id"), "side", "weak").distinct(), "open")
    found = None
    while near.limit(1).count():  # as many rounds as a walk turns aside
        for by in jumps:
            near = near.unionByName(moved(near.select("id", "side"), by)).distinct()
        near = stored(near, "open")
        found = near if found is None else stored(found.unionByName(near).distinct(), "open")
        near = stored(moved(near.where("weak").select("id", "side"), aside).distinct().join(found, ["id", "side", "weak"], "left_anti"), "open")
    return (near if found is None else found).select("id").distinct()


def scooped(m: int, parts: int, seed: int = 37) -> dict[str, int]:
    """A colour for every canonical mini-k-mer: far-apart seeds grow by turns over neighbours. 4**m is small."""
    comp = str.maketrans(K.BASES, K.COMPLEMENTS)

    def canonical(s: str) -> str:
        r = s.translate(comp)[::-1]
        return r if r[::-1] < s[::-1] else s

    def word(n: int) -> str:
        return "".join(K.BASES[n >> 2 * i & 3] for i in range(m))

    every = sorted({canonical(word(n)) for n in range(4**m)})
    rng = np.random.default_rng(seed)
    seeds = [every[int(rng.integers(len(every)))]]
    while len(seeds) < min(parts, len(every)):
        some = {every[int(i)] for i in rng.integers(len(every), size=64)} - set(seeds) or set(every) - set(seeds)
        seeds.append(max(sorted(some), key=lambda s: min(run_distance(s, t) for t in seeds)))
    colour = {s: i + 1 for i, s in enumerate(seeds)}
    edges = {i + 1: [s] for i, s in enumerate(seeds)}
    while any(edges.values()):
        for c in edges:
            grown = []
            for s in edges[c]:
                for b in K.BASES:
                    for t in (canonical(s[1:] + b), canonical(b + s[:-1])):
                        if t not in colour:
                            colour[t] = c
                            grown.append(t)
            edges[c] = grown
    return colour


def clustered(adjacent: DataFrame, counts: DataFrame, parts: int) -> dict[str, int]:
    """A colour for every mini-k-mer seen: clusters of the most adjacent ones merge greedily while they stay below an
    equal share, and are numbered by size. adjacent (a, b, n) and counts (mini, n) have 4**m rows at most."""
    size = {r["mini"]: r["n"] for r in counts.collect()}
    limit, parent = sum(size.values()) / parts * 1.1, {s: s for s in size}

    def root(s: str) -> str:
        while parent[s] != s:
            parent[s] = parent[parent[s]]
            s = parent[s]
        return s

    for r in sorted(adjacent.collect(), key=lambda r: (-r["n"], r["a"], r["b"])):
        a, b = root(r["a"]), root(r["b"])
        if a != b and size[a] + size[b] <= limit:
            a, b = min(a, b), max(a, b)
            parent[b], size[a] = a, size[a] + size[b]
    roots = sorted({root(s) for s in parent}, key=lambda s: (-size[s], s))
    load, of = [0] * parts, {}
    for i, s in enumerate(roots):
        at = i if i < parts else load.index(min(load))
        load[at] += size[s]
        of[s] = at + 1
    return {s: of[root(s)] for s in parent}
