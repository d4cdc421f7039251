import gzip
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from helixframe.operators.compact import compact, unitigs
from helixframe.operators.kmers import de_bruijn, half_arcs, kmer_counts
from helixframe.operators.partition import by_range, super_kmers
from helixframe.operators.report import contig_stats, counters, histogram, histogram_summary, log_numbers, weighted_median_coverage
from helixframe.sources import graphs
from helixframe.sources.graphs import read_components, read_parts, write_components
from helixframe.sources.reads import category, read_fasta, read_fastq, read_tabbed
from helixframe.streaming.spectrum import GrowingGraph, read_stream, spectrum_stream


def text(path):
    return "".join(p.read_text() for p in sorted(Path(path).glob("part-*")))


def test_fasta(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.fa").write_text(">one x\nACGT\nacg\n\n>\nTTT\r\n>empty\n>last\nGG>A")
    (d / "b.fa").write_text(">b\nCCC\n")
    rows = read_fasta(spark, str(d), 1).orderBy("seq").collect()
    assert {(r["header"], r["seq"], r["category"]) for r in rows} == {("b", "CCC", 1), ("last", "GG>A", 1), ("", "TTT", 1), ("one x", "ACGTacg", 1)}
    assert len({r["read_id"] for r in rows}) == 4


def test_other_reads(spark, tmp_path):
    (tmp_path / "t.txt").write_text("1\t2\t3\t4\tACGT\n1\t2\n")
    assert [r["seq"] for r in read_tabbed(spark, str(tmp_path / "t.txt")).collect()] == ["ACGT"]
    with gzip.open(tmp_path / "q.fastq.gz", "wt") as f:
        f.write("@a\nACG\n+\n@@I\n@b\nTT\n+\nII\n")
    assert sorted(r["seq"] for r in read_fastq(spark, str(tmp_path / "q.fastq.gz")).collect() if r["seq"])[-1] == "TT"


def test_categories():
    assert [category(c) for c in ("short", "shortPaired", "short2", "shortPaired2", "long", "longPaired")] == [0, 1, 2, 3, 4, 5]
    with pytest.raises(ValueError):
        category("wide")


@pytest.fixture(scope="module")
def graph(spark):
    reads = spark.createDataFrame([(0, "ACCGTTAGCATTGCACGGATC"), (1, "ACCGTTAGCATTGCACGGATC"), (2, "CCGTTAGCATAGCACG")], "read_id long, seq string")
    return compact(de_bruijn(reads, 9))


def test_pregraph_round_trip(spark, graph, tmp_path):
    found = unitigs(graph)
    for direct, first in ((True, f"0x{found.count():08x}\t3\t0\t9\t1"), (False, f"{found.count()}\t3\t9\t1")):
        path = str(tmp_path / f"pre{direct}")
        graphs.write_pregraph(found, path, 9, 3, direct)
        assert text(path).split("\n")[0] == first
        head, back = graphs.read_pregraph(spark, path)
        assert head["nodes"] == found.count() and head["k"] == 9
        assert {(r["seq"], r["n_kmers"]) for r in back.collect()} == {(r["seq"], r["n_kmers"]) for r in found.collect()}


def test_text_sinks(spark, graph, tmp_path):
    found = unitigs(graph)
    graphs.write_contigs(found, str(tmp_path / "fa"))
    lines = text(tmp_path / "fa").split()
    assert lines[0].startswith(">NOD_1_") and lines[0].split("_")[3] == "0" and len(lines) == 2 * found.count()
    assert {r["seq"] for r in read_fasta(spark, str(tmp_path / "fa")).collect()} == {r["seq"] for r in found.collect()}
    graphs.write_plain_pregraph(found, str(tmp_path / "plain"))
    assert all(len(x.split("\t")) == 3 for x in text(tmp_path / "plain").split("\n") if x.startswith("NODE"))
    graphs.write_coverage_database(found, str(tmp_path / "db"))
    assert len(text(tmp_path / "db").split("\n")) == found.count() + 1
    graphs.write_dot(graph.nodes, graph.arcs, str(tmp_path / "dot"))
    dot = text(tmp_path / "dot")
    assert dot.startswith("graph g {\n") and dot.endswith("}\n") and dot.count("shape=record") == graph.nodes.count()
    reads = spark.createDataFrame([(5, "A" * 130)], "read_id long, seq string")
    graphs.write_sequences(reads, str(tmp_path / "seq"))
    assert text(tmp_path / "seq").split("\n")[:4] == [">5\t1\t0", "A" * 60, "A" * 60, "A" * 10]
    edges = spark.createDataFrame([(0, 1), (1, 0), (1, 2), (2, 1)], "vid long, to long")
    graphs.write_metis(edges, str(tmp_path / "metis"))
    assert text(tmp_path / "metis") == "3 2\n2\n1 3\n2\n"
    (tmp_path / "parts").write_text("1\n0\n1\n")
    assert {(r["vid"], r["part"]) for r in graphs.read_parts(spark, str(tmp_path / "parts")).collect()} == {(0, 1), (1, 0), (2, 1)}


def test_tables(spark, graph, tmp_path):
    graphs.write_graph(graph.nodes, graph.arcs, str(tmp_path / "g"))
    back = graphs.read_graph(spark, str(tmp_path / "g"), 9)
    assert unitigs(back).exceptAll(unitigs(graph)).count() == 0
    reads = spark.createDataFrame([(0, "ACCGTTAGCATTGCACGGATC")], "read_id long, seq string")
    pieces = super_kmers(reads, 9, 5, by_range(5, 16))
    graphs.write_super_kmers(pieces, str(tmp_path / "s"))
    assert graphs.read_super_kmers(spark, str(tmp_path / "s")).count() == pieces.count()
    color = pieces.first()["color"]
    assert graphs.read_super_kmers(spark, str(tmp_path / "s"), color).count() == pieces.where(F.col("color") == color).count()


def test_scoop(graph):
    root = graph.arcs.first()["src"]
    rows = graphs.scoop(graph.arcs, root, 3).collect()
    assert len(rows) <= 3 and (root, 0) in [(r["id"], r["depth"]) for r in rows]


def test_number_format(spark):
    rows = spark.createDataFrame([(12.5,), (3.0,), (1 / 3,), (1e7,)], "c double").select(graphs.shortest(F.col("c")).alias("g")).collect()
    assert [r["g"] for r in rows] == ["12.5", "3", "0.333333", "1e+07"]


@pytest.mark.parametrize("lengths", [[5], [3, 9], [1, 2, 3, 4], [7, 7, 7, 1, 1, 20], list(range(1, 40))])
def test_contig_stats(spark, lengths):
    row = contig_stats(spark.createDataFrame([(n,) for n in lengths], "n_kmers int")).first()
    s, total = sorted(lengths), sum(lengths)
    half = len(s) // 2
    assert (row["contigs"], row["total"], row["shortest"], row["longest"], row["mean"]) == (len(s), total, s[0], s[-1], total // len(s))
    assert row["median"] == (s[half] if len(s) % 2 else (s[half] + s[half - 1]) // 2)
    for p in (50, 80):
        left, n, last = int(total * p / 100 + 0.5), 0, 0
        for x in reversed(s):
            if left <= 0:
                break
            left, n, last = left - x, n + 1, x
        assert (row[f"n{p}"], row[f"n{p}_count"], row[f"n{p}_percent"]) == (last, n, 100 * n // len(s))


def test_small_reports(spark):
    df = spark.createDataFrame([(-3,), (0,), (2,), (99,)], "v int")
    buckets = histogram(df, F.col("v"), 0, 10)
    assert {r["bucket"]: r["n"] for r in buckets.collect()} == {0: 2, 2: 1, 10: 1}
    assert histogram_summary(buckets, 11).first()["weighted"] is None
    u = spark.createDataFrame([(1.0, 10), (5.0, 30), (9.0, 5)], "coverage double, n_kmers int")
    assert weighted_median_coverage(u).first()["coverage"] == 5.0
    log = spark.createDataFrame([("12 nodes, 3 dumped",), ("x",)], "value string")
    assert log_numbers(log, r"(\d+) nodes, (\d+) dumped", "nodes", "dumped").collect()[0]["dumped"] == 3.0


def test_streams(spark, tmp_path):
    path = str(tmp_path / "reads")
    batches = [[(1, "ACCGTTAGCATTGC"), (2, "GGTTAACC")], [(3, "ACCGTTAGCATTGC" * 2)]]
    for rows in batches:
        spark.createDataFrame(rows, "read_id long, seq string").coalesce(1).write.mode("append").parquet(path)
    every = spark.read.parquet(path)
    graph = GrowingGraph(spark, 5, str(tmp_path / "g"))
    graph.start_available(read_stream(spark, path), str(tmp_path / "c1")).awaitTermination()
    assert graph.nodes().exceptAll(kmer_counts(every, 5)).count() == 0
    keys = ["src", "side", "base", "weight"]
    assert graph.arcs().select(keys).exceptAll(half_arcs(every, 5).select(keys)).count() == 0
    run = spectrum_stream(read_stream(spark, path), 5).writeStream.format("memory").queryName("counts").outputMode("complete")
    run.option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("counts").exceptAll(kmer_counts(every, 5)).count() == 0


def test_fastq_quality_may_begin_with_an_at_sign(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"r{i} x", "".join(rng.choice("ACGT") for _ in range(1 + i % 40))) for i in range(300)]
    quality = lambda i, n: ("@" * (i % 3) + "+" * (i % 2) + "I" * n)[:n] if i % 4 else "@" * n
    text = "".join(f"@{h}\n{s}\n+{h if i % 5 == 0 else ''}\n{quality(i, len(s))}\n" for i, (h, s) in enumerate(rows))
    (tmp_path / "a.fq").write_text(text)
    (tmp_path / "b.fq").write_text(text.replace("\n", "\r\n"))
    for name in ("a.fq", "b.fq"):
        found = read_fastq(spark, str(tmp_path / name)).collect()
        assert sorted((r["header"], r["seq"]) for r in found) == sorted(rows)
    (tmp_path / "c.fq").write_text("@a\n\n+\n\n@b\nACG\n+\n@@@\n@c\nT\n+\n@\n")
    assert sorted(r["seq"] for r in read_fastq(spark, str(tmp_path / "c.fq")).collect()) == ["ACG", "T"]


def test_a_stream_goes_on_where_it_ended(spark, tmp_path):
    path, seqs = str(tmp_path / "reads"), ["ACCGTTAGCATTGC", "GGTTAACCGT", "TTAGGCATCAAC", "ACCGTTAGCA"]
    write = lambda i: spark.createDataFrame([(i, seqs[i])], "read_id long, seq string").coalesce(1).write.mode("append").parquet(path)
    for i in range(4):
        write(i)
        graph = GrowingGraph(spark, 5, str(tmp_path / "g"), every=2)  # as after a restart
        graph.start_available(read_stream(spark, path), str(tmp_path / "c")).awaitTermination()
        assert graph.nodes().exceptAll(kmer_counts(spark.read.parquet(path), 5)).count() == 0
        assert graph.nodes().agg(F.sum("occ")).first()[0] == sum(len(s) - 4 for s in seqs[: i + 1])
    assert graph._complete()[0] == [1, 3] and 0 not in graph._complete()[1]


def test_a_batch_that_failed_is_added_once(spark, tmp_path):
    """A kill after the nodes are written, and one after the batch is written but before the stream knows."""
    reads = [spark.createDataFrame([(i, s)], "read_id long, seq string") for i, s in enumerate(["ACCGTTAGCATTGC", "GGTTAACCGT"])]
    graph = GrowingGraph(spark, 5, str(tmp_path / "g"))
    graph.add(reads[0], 0)
    kmer_counts(reads[1], 5).write.parquet(str(tmp_path / "g" / "batch-1" / "nodes"))
    again = GrowingGraph(spark, 5, str(tmp_path / "g"))
    assert again.nodes().exceptAll(kmer_counts(reads[0], 5)).count() == 0
    for _ in range(2):
        again.add(reads[1], 1)
        assert again.nodes().exceptAll(kmer_counts(reads[0].unionByName(reads[1]), 5)).count() == 0
        assert again.nodes().agg(F.sum("occ")).first()[0] == 10 + 6


def test_partition_answers_of_any_size(spark, tmp_path):
    rng = random.Random(3)
    parts = [rng.randrange(9) for _ in range(5000)]
    (tmp_path / "p").write_text("".join(f"{p}\n" for p in parts[:2500]) + "\n" + "".join(f" {p}\n" for p in parts[2500:]))
    found = {r["vid"]: r["part"] for r in read_parts(spark, str(tmp_path / "p")).collect()}
    assert found == {i + (i >= 2500): p for i, p in enumerate(parts)}


def test_components_of_a_bucket(spark, tmp_path):
    rows = spark.createDataFrame([("A", "A", "final"), ("C", "A", "final"), ("G", "G", "inbox-3")], "id string, component string, target string")
    write_components(rows, str(tmp_path / "c"))
    assert {tuple(r) for r in read_components(spark, str(tmp_path / "c")).select(rows.columns).collect()} == {tuple(r) for r in rows.collect()}
    assert [r["id"] for r in read_components(spark, str(tmp_path / "c"), "inbox-3").collect()] == ["G"]
    open_ids = spark.createDataFrame([("G",)], "id string")
    assert {tuple(r) for r in counters(rows, open_ids).collect()} == {("final", 1, 2, 2, 0), ("inbox-3", 1, 1, 1, 1)}


def test_a_shared_folder_is_needed_on_a_cluster(spark, monkeypatch):
    from helixframe import session

    class Context:
        master = "yarn"
        _jsc = spark.sparkContext._jsc
        getConf = spark.sparkContext.getConf

    class Session:
        conf, sparkContext = spark.conf, Context()

    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        with pytest.raises(ValueError):
            session.shared_dir(Session())


def test_scratch_tables_go_and_lasting_ones_stay(spark, tmp_path):
    from helixframe import session

    rows = spark.range(5)
    with session.scratch(spark):
        inner, lasting = session.stored(rows, "inner"), session.stored(rows, "lasting", lasting=True)
        with session.scratch(spark):
            innermost = session.stored(inner, "innermost")
            paths = [df.inputFiles()[0].removeprefix("file:").replace("///", "/") for df in (inner, lasting, innermost)]
            assert all(Path(p).exists() for p in paths)
        assert [Path(p).exists() for p in paths] == [True, True, False]
    assert [Path(p).exists() for p in paths] == [False, True, False]
    assert lasting.count() == 5 and not any(p.rpartition("/")[0] in str(session._LEFT) for p in paths)
