import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixframe.functions import kmer as K
from helixframe.functions.similarity import common_subsequence, kmer_distance, run_distance, similar
from helixframe.operators.compact import compact, unitigs
from helixframe.operators.kmers import broken_arcs, de_bruijn, half_arcs, kmer_counts, kmers, node_classes
from helixframe.plans.assemble import Options, assemble, assemble_in_parts, contigs, prepared, reports
from helixframe.operators import distribute, partition
from helixframe.operators.clip import reverse_complements_equal
from helixframe.operators.components import connected_components
from helixframe.operators.finish import cut_coverage
from helixframe.operators.ranking import numbered
from helixframe.sources.reads import counted, lineitem_read_counts, lineitem_reads

COMP = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s.translate(COMP)[::-1]


def canon(s):
    return rc(s) if rc(s)[::-1] < s[::-1] else s


def code(s):
    return sum("ACGT".index(c) << 2 * i for i, c in enumerate(s))


def frame(spark, seqs):
    return spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string")


def sequences(n, least=1, most=60, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice("ACGT") for _ in range(rng.randint(least, most))) for _ in range(n)]


def test_scalar_functions(spark):
    words = sequences(40, 31, 31)
    rows = frame(spark, words).select(
        "seq", K.canonical(F.col("seq")).alias("canon"), K.encode(F.col("seq")).alias("code"), K.decode(K.encode(F.col("seq")), 31).alias("back"),
        K.mini_kmer(F.col("seq"), 31, 9).alias("mini"), K.append_base(K.encode(F.col("seq")), F.lit(2), 31).alias("appended"),
        K.prepend_base(K.encode(F.col("seq")), F.lit(3), 31).alias("prepended"), K.hashed(K.encode(F.col("seq"))).alias("hash"),
        K.with_base(K.encode(F.col("seq")), 4, F.lit(1)).alias("changed"),
    ).collect()
    for r in rows:
        s = r["seq"]
        c = code(s)
        assert r["canon"] == canon(s) == min(s, rc(s), key=code)
        assert (r["code"], r["back"], r["mini"]) == (c, s, canon(s[11:20]))
        assert (r["appended"], r["prepended"]) == (code(s[1:] + "G"), code("T" + s[:-1]))
        assert r["hash"] % 2**64 == (c ^ c >> 17 ^ c >> 37 ^ c << 11) % 2**64
        assert r["changed"] == code(s[:4] + "C" + s[5:])


def test_numbers():
    assert [K.round_up_power(n) for n in (1, 2, 4, 5, 200)] == [1, 4, 4, 16, 256]
    assert [K.parse_unsigned(x) for x in ("12", "0x1f", "017", "0")] == [12, 31, 15, 0]
    for bad in ("-1", "0x1ffffffffffffffff"):
        with pytest.raises(ValueError):
            K.parse_unsigned(bad)
    with pytest.raises(ValueError):
        K.check_k(8)


def test_normalise_and_split(spark):
    rows = frame(spark, ["acgtN.xACé\r\nT", "", "NN"]).select(K.normalise(F.col("seq")).alias("n"), K.known_stretches(F.col("seq")).alias("s")).collect()
    assert [r["n"] for r in rows] == ["ACGTAAAACAAAT", "", "AA"]
    assert [r["s"] for r in rows] == [["ACGT", "AC", "T"], [], []]


@pytest.mark.parametrize("k", [3, 9, 33])
def test_counts_and_arcs(spark, k):
    seqs = [*sequences(30, 1, 260, k), "A" * 50, "ACGT" * 20, "A" * k, None]
    words = Counter(canon(s[i : i + k]) for s in seqs if s and len(s) > k for i in range(len(s) - k + 1))
    reads = frame(spark, seqs)
    assert {r["kmer"]: r["occ"] for r in kmer_counts(reads, k).collect()} == words
    arcs = Counter()
    for s in seqs:
        if s and len(s) > k:
            for i in range(len(s) - k):
                a, b = s[i : i + k], s[i + 1 : i + k + 1]
                ar, br = canon(a) != a, canon(b) != b
                added, dropped = b[-1], a[0]
                arcs[canon(a), "L" if ar else "R", added.translate(COMP) if ar else added, canon(b), "R" if br else "L"] += 1
                arcs[canon(b), "R" if br else "L", dropped.translate(COMP) if br else dropped, canon(a), "L" if ar else "R"] += 1
    found = half_arcs(reads, k)
    assert {(r["src"], r["side"], r["base"], r["dst"], r["dst_side"]): r["weight"] for r in found.collect()} == {x: min(n, 125) for x, n in arcs.items()}
    assert broken_arcs(found).count() == 0
    assert kmers(reads, k).count() == sum(words.values())


def test_unitigs_hold_every_kmer_once(spark):
    seqs = sequences(25, 5, 120, 8)
    reads = frame(spark, seqs)
    k = 7
    graph = compact(de_bruijn(reads, k), keep_cycles=True)
    found = unitigs(graph).collect()
    inside = Counter(canon(r["seq"][i : i + k]) for r in found for i in range(r["n_kmers"]))
    want = {r["kmer"]: r["occ"] for r in kmer_counts(reads, k).collect()}
    assert inside == dict.fromkeys(want, 1)
    assert sum(r["kmer_occurrences"] for r in found) == sum(want.values())
    assert broken_arcs(graph.arcs).count() == 0
    degree = {r["id"]: (r["lefts"], r["rights"]) for r in node_classes(graph.nodes, graph.arcs).collect()}
    # no chain can be joined any further
    assert not [r for r in graph.arcs.where("src != dst").collect() if _one(graph, r, degree)]


def _one(graph, r, degree):
    own, other = degree[r["src"]], degree[r["dst"]]
    return own[r["side"] == "R"] == 1 and other[r["dst_side"] == "R"] == 1


def test_a_cycle_is_dropped_or_cut(spark):
    reads = frame(spark, ["ACGGTCATTG" * 3])
    dropped, kept = (compact(de_bruijn(reads, 5), keep_cycles=x).nodes for x in (False, True))
    assert dropped.count() == 0
    rows = kept.collect()
    assert len(rows) == 1 and len(rows[0]["occs"]) == 10


def test_partitioned_equals_direct(spark):
    rng = random.Random(4)
    genome = "".join(rng.choice("ACGT") for _ in range(300))
    seqs = [genome[i : i + 40] for i in (rng.randrange(260) for _ in range(150))]
    seqs += [s[:20] + "ACGT"["CGTA".index(s[20])] + s[21:] for s in seqs[:6]]
    reads, options = frame(spark, seqs), Options(k=15)
    whole = unitigs(assemble(reads, options))
    parts = unitigs(assemble_in_parts(reads, options, 7, partition.by_range(7, 16), 16, rounds=4))
    assert reverse_complements_equal(whole, parts) and whole.count() > 0
    found = contigs(reads, Options(k=15, bubbles=True, cov_cutoff=1.5))
    longest = max(found.collect(), key=lambda r: r["n_kmers"])
    assert longest["seq"] in (genome + rc(genome)) or rc(longest["seq"]) in genome or longest["seq"] in genome
    assert reports(found)["stats"].first()["longest"] == longest["n_kmers"]


def test_a_bubble_pops(spark):
    rng = random.Random(9)
    g = "".join(rng.choice("ACGT") for _ in range(140))
    other = g[:70] + "ACGT"["CGTA".index(g[70])] + g[71:]
    reads = frame(spark, [g] * 6 + [other] * 3)
    assert unitigs(assemble(reads, Options(k=15))).count() == 4
    popped = contigs(reads, Options(k=15, bubbles=True)).collect()
    assert [r["seq"] for r in popped] == [min(g, rc(g))]
    assert popped[0]["kmer_occurrences"] == 9 * 126


def test_coverage_limits(spark):
    reads = frame(spark, [*["ACCGTTAGCATTGCAC"] * 5, "GGTATCAACTGAGGTC"])
    graph = compact(de_bruijn(reads, 9))
    assert cut_coverage(graph, 2.0).nodes.count() == 1 and cut_coverage(graph, 0, 2.0).nodes.count() == 1 and cut_coverage(graph).nodes.count() == 2
    with pytest.raises(ValueError):
        cut_coverage(graph, 3.0, 2.0)


@settings(max_examples=60, deadline=None)
@given(st.text("ACGT", max_size=30), st.text("ACGT", max_size=30))
def test_common_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0] * (len(b) + 1)
        for j, y in enumerate(b):
            row[j + 1] = max(last[j] + (x == y), last[j + 1], row[j])
    assert common_subsequence(a, b) == row[-1]


def test_similarity(spark):
    a = "ACGTTGCA" * 10
    assert similar(a, a[:40] + "T" + a[41:]) and similar(a, a[:77]) and not similar(a, a[:76]) and not similar("A" * 201, "A" * 201) and not similar(None, a)
    assert run_distance("ACGTA", "ACGTA") == 0
    row = frame(spark, ["ACGTA"]).select(kmer_distance(F.col("seq"), F.lit("ACGTA")).alias("d")).first()
    assert row["d"] == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=30))
def test_components(spark, edges):
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    parent = {i: i for e in edges for i in e}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    assert found == {i: root(i) for a, b in edges if a != b for i in (a, b)}


def test_junctions_and_masks(spark):
    g = sequences(1, 200, 200, 3)[0]
    graph = compact(de_bruijn(frame(spark, [g, g[:100] + "A" * 20]), 11))
    found = distribute.junctions(graph.nodes, graph.arcs)
    assert found.count() == graph.nodes.count()
    edges = {(r["vid"], r["to"]) for r in distribute.junction_edges(found).collect()}
    assert edges and all((b, a) in edges for a, b in edges)
    parts = spark.createDataFrame([(v, v % 2) for v in {x for e in edges for x in e}], "vid long, part int")
    dealt = distribute.dealt_nodes(found, parts)
    assert {r["id"] for r in dealt.collect()} == {r["id"] for r in found.collect()}
    pairs = spark.createDataFrame([(1, 2)], "first long, second long")
    masks = spark.createDataFrame([(1, 3), (2, 1)], "read_id long, mask long")
    got = {(r["part"], r["read_id"], r["paired"]) for r in distribute.routed(masks, pairs, 2).collect()}
    assert got == {(0, 1, True), (0, 2, True), (1, 1, False)}


def test_partitioners(spark):
    colours = partition.scooped(3, 4)
    assert set(colours.values()) == {1, 2, 3, 4} and len(colours) == 32
    counts = spark.createDataFrame([("AAA", 5), ("AAC", 4), ("CAA", 3), ("ACC", 1)], "mini string, n long")
    near = spark.createDataFrame([("AAA", "AAC", 9), ("ACC", "CAA", 2)], "a string, b string, n long")
    got = partition.clustered(near, counts, 2)
    assert set(got) == {"AAA", "AAC", "CAA", "ACC"} and max(got.values()) <= 2
    reads = frame(spark, sequences(20, 30, 80, 6))
    pieces = partition.super_kmers(reads, 9, 5, partition.by_hash(8))
    assert pieces.agg(F.sum("n_kmers")).first()[0] == kmers(reads, 9).count()


def test_numbered(spark):
    rows = numbered(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")), "x").collect()
    assert all(r["x"] == r["number"] for r in rows) and len(rows) == 1000


def test_every_read_is_routed(spark):
    ids = [(0,), (1,), (2,), (10,), (20,), (21,), (22,), (23,)]
    pairs = distribute.neighbours(spark.createDataFrame(ids, "read_id long"), F.expr("read_id div 10"))
    assert {tuple(r) for r in pairs.collect()} == {(0, 1), (2, None), (10, None), (20, 21), (22, 23)}
    masks = spark.createDataFrame([(i, 3 if i == 1 else 1) for (i,) in ids], "read_id long, mask long")
    got = {(r["part"], r["read_id"], r["paired"]) for r in distribute.routed(masks, pairs, 2).collect()}
    assert got == {(0, i, i not in (2, 10)) for (i,) in ids} | {(1, 1, False)}


@pytest.mark.parametrize("sizes", [(5, 4), (60, 50), (400, 700)])
def test_components_at_once_equal_those_in_passes(spark, sizes):
    rng = random.Random(sum(sizes))
    edges = [(f"n{rng.randrange(sizes[0])}", f"n{rng.randrange(sizes[0])}") for _ in range(sizes[1])] + [(f"p{i:04}", f"p{i + 1:04}") for i in range(300)]
    df = spark.createDataFrame(edges, "src string, dst string").repartition(3)
    once, passes = ({tuple(r) for r in connected_components(df, at_once=n).collect()} for n in (10**6, 0))
    assert once == passes and len(once) > 300


def test_open_nodes_walk_as_they_are_told(spark):
    """A border at x1; x1 x2 x3 are a list; x3 meets the branch b by a weak arc, y by a single one, z by a heavy one."""
    half = lambda s, ss, d, ds, w, far=0: [(s, ss, "A", w, d, ds, far), (d, ds, "C", w, s, ss, far)]
    rows = half("x1", "R", "x2", "L", 2) + half("x2", "R", "x3", "L", 2) + half("x3", "R", "b", "L", 1) + half("y", "R", "b", "L", 1) + half("z", "R", "b", "L", 5)
    rows += half("b", "R", "c", "L", 4) + half("y0", "R", "y", "L", 3) + half("c", "R", "d", "L", 1) + half("c", "R", "e", "L", 4) + half("q", "R", "r", "L", 4)
    rows += [("x1", "L", "G", 3, "far", "R", 9)]
    arcs = spark.createDataFrame(rows, "src string, side string, base string, weight int, dst string, dst_side string, far int")
    assert {r["id"] for r in partition.open_nodes(arcs).collect()} == {"x1", "x2", "x3", "b", "c", "y", "z", "y0"}
    none = partition.open_nodes(arcs.where("far = 0"))
    assert none.count() == 0


def test_related_components_are_those_that_are_touched(spark):
    members = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c"), ("d", "d")], "id string, component string")
    coming = spark.createDataFrame([("x", "b"), ("y", "d"), ("y", "zz")], "src string, dst string")
    assert {r["id"] for r in partition.related(members, coming).collect()} == {"a", "b", "d"}


def test_functions_of_sql(spark):
    from helixframe.functions.registered import register

    register(spark)
    frame(spark, [*sequences(30, 1, 40), "ACGTT", "ACGT"]).createOrReplaceTempView("some_reads")
    rows = spark.sql("SELECT read_id, x.* FROM some_reads, LATERAL kmers(seq, 5) x")
    assert rows.exceptAll(kmers(spark.table("some_reads"), 5).select(rows.columns)).count() == 0 and rows.count() == kmers(spark.table("some_reads"), 5).count()
    back = spark.sql("SELECT seq, kmer_of_code(kmer_code(seq), length(seq)) AS back, reverse_complement(seq) AS twin, canonical_kmer(seq) AS canon, mini_kmer('ACGTTCA', 3) AS mini, sequence_of_contig('ACGT', 'CGTA', 4) AS joined, complement_of('AC') AS c, normalised('acN') AS n FROM some_reads WHERE length(seq) <= 31").collect()
    assert all((r["back"], r["twin"], r["canon"]) == (r["seq"], rc(r["seq"]), canon(r["seq"])) for r in back)
    assert (back[0]["mini"], back[0]["joined"], back[0]["c"], back[0]["n"]) == (canon("GTT"), "ACGTA", "TG", "ACA")


def test_super_kmers_of_long_reads(spark):
    g = sequences(1, 3000, 3000, 12)[0]
    reads = frame(spark, [g, g[:14], g[:15], g[:16]])
    pieces = partition.super_kmers(reads, 15, 7, partition.by_hash(8)).orderBy("read_id", "run").collect()
    whole = [p for p in pieces if p["read_id"] == 0]
    assert sum(p["n_kmers"] for p in whole) == 2986 and {p["read_id"] for p in pieces} == {0, 3}
    at = 0
    for i, p in enumerate(whole):
        before, after = i > 0, i < len(whole) - 1
        assert p["seq"] == g[at - before : at + p["n_kmers"] + 14 + after]
        assert p["prefix_color"] == (whole[i - 1]["color"] if before else None) and p["suffix_color"] == (whole[i + 1]["color"] if after else None)
        at += p["n_kmers"]


@pytest.mark.parametrize("k", [3, 9])
def test_reads_with_a_number_count_as_often(spark, k):
    seqs = [*sequences(20, 1, 150, k), "ACGT" * 20, "ACGT" * 20, "A" * 30] * 3
    reads = frame(spark, seqs)
    once = counted(reads)
    assert once.agg(F.count("*"), F.sum("n")).first()[:] == (len(set(seqs)), len(seqs))
    twice = counted(once.unionByName(once))
    assert {r["n"] for r in twice.collect()} == {2 * n for n in Counter(seqs).values()}
    for made in (lambda x: kmer_counts(x, k), lambda x: half_arcs(x, k), lambda x: half_arcs(x, k, None), lambda x: de_bruijn(x, k).nodes.select("id", "occs")):
        want, got = made(reads), made(once).select(made(reads).columns)
        assert want.exceptAll(got).count() == got.exceptAll(want).count() == 0
    split = prepared(once, Options(k=k, unknown="split"))
    assert kmer_counts(split, k).exceptAll(kmer_counts(reads, k)).count() == 0


def test_lineitem_reads_are_counted_before_they_are_made(spark, tmp_path):
    rows = [(i % 40, i % 7, i % 500, i % 41, 1.0) for i in range(3000)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    reads = {r["seq"]: r["n"] for r in counted(lineitem_reads(spark, str(tmp_path))).collect()}
    found = Counter()
    for r in lineitem_read_counts(spark, str(tmp_path)).collect():
        found[r["seq"]] += r["n"]
    assert found == reads and sum(reads.values()) == len({r[:4] for r in rows}) > len(reads)
    genome = "".join("ACGT"[x * x % (2**31 - 1) // 7 % 4] for x in ((1_103_515_245 * i + 12_345) % (2**31 - 1) for i in range(1036)))
    for order, line, part, supplier, _ in rows[:300]:
        at, wrong = (order * 7919 + part * 13) % (1000 - 36), part % 36 if supplier % 20 == 0 else -1
        assert "".join("ACGT"[("ACGT".index(b) + (i == wrong)) % 4] for i, b in enumerate(genome[at : at + 36])) in reads


def test_component_stats_make_arcs_once(spark, tmp_path, monkeypatch):
    from helixframe.plans import registry

    spark.createDataFrame([(i, i % 7, i % 5, i % 3, 1.0) for i in range(40)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    made, far = [], registry._far
    monkeypatch.setattr(registry, "_far", lambda *a: made.append(far(*a)) or made[-1])
    plan = registry.queries()["component_stats"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert len(made) == 1 and "lineitem" not in plan and "l_orderkey" not in plan
