import random

import pytest

from helixframe.__main__ import main


@pytest.mark.parametrize("options", [[], ["--part", "5", "5", "--bubble-removal", "--cov-cutoff", "1.5", "--stat"]])
def test_command(spark, tmp_path, options):
    rng = random.Random(2)
    genome = "".join(rng.choice("ACGT") for _ in range(150))
    (tmp_path / "r.fa").write_text("".join(f">r{i}\n{genome[i % 100 : i % 100 + 50]}\n" for i in range(0, 400, 3)))
    out = tmp_path / "out"
    main([str(out), "15", str(tmp_path / "r.fa"), *options], spark)
    contigs = [x for p in (out / "contigs").glob("part-*") for x in p.read_text().split("\n") if x and x[0] != ">"]
    twin = genome.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    assert len(contigs) == 1 and (contigs[0] in genome or contigs[0] in twin) and len(contigs[0]) > 120
    assert spark.read.parquet(str(out / "stats")).first()["contigs"] == 1
    assert (out / "partitions").exists() == bool(options)


def test_distribution(spark, tmp_path):
    """The junctions of a graph go out, the partitioner's answer comes in, and reads follow their nodes."""
    rng = random.Random(5)
    genome = ["".join(rng.choice("ACGT") for _ in range(120)) for _ in range(3)]
    reads = [g[i : i + 40] for g in genome for i in range(0, 80, 2) for _ in range(2)]
    (tmp_path / "r.fa").write_text("".join(f">r{i}\n{s}\n" for i, s in enumerate(reads)))
    main([str(tmp_path / "a"), "15", str(tmp_path / "r.fa"), "--pgpart", "--part", "4", "5", "--flow", "2"], spark)
    lines = [x for p in sorted((tmp_path / "a" / "metis").glob("part-*")) for x in p.read_text().split("\n") if x]
    count = int(lines[0].split()[0])
    assert len(lines) == count + 1
    (tmp_path / "answer").write_text("".join(f"{i % 2}\n" for i in range(count)))
    main([str(tmp_path / "b"), "15", str(tmp_path / "r.fa"), "--pgdist", str(tmp_path / "answer"), "--pgfilter", "12", "--category", "shortPaired"], spark)
    assert spark.read.parquet(str(tmp_path / "b" / "distributed")).select("id").distinct().count() == 3
    masks = {r["read_id"]: r["mask"] for r in spark.read.parquet(str(tmp_path / "b" / "masks")).collect()}
    assert sorted(masks) == list(range(len(reads))) and all(m > 0 for m in masks.values())
    routed = spark.read.parquet(str(tmp_path / "b" / "routed"))
    assert routed.where("paired").count() > 0 and routed.select("read_id").distinct().count() == len(reads)


def test_usage_error(spark, tmp_path):
    with pytest.raises(SystemExit):
        main([str(tmp_path / "x"), "15", "f", "--cov-cutoff", "3", "--max-coverage", "2"], spark)
