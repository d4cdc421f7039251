"""Plans read only the columns they need, count before they shuffle, and stay out of Python."""

import pytest

from helixframe.plans import registry


#: The most shuffles of each; lineitem's distinct rows take one for each time that reads are made.
SHUFFLES = {"kmer_spectrum": 3, "kmer_top": 2, "arc_weights": 3, "node_degree_class": 5, "superkmers": 1, "boundary_arcs": 3, "read_partition_mask": 6}


@pytest.fixture
def sf_dir(spark, tmp_path):
    spark.createDataFrame([(1, "ACGTACGTACGTACGTACGTACGTACG", "en", "s", 27)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    rows = [(i, i % 7, i % 5, i % 3, 1.0) for i in range(40)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["kmer_spectrum", "kmer_top", "arc_weights", "node_degree_class", "superkmers", "boundary_arcs", "read_partition_mask"])
def test_plan(spark, sf_dir, name):
    plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "n_chars" not in plan and "l_quantity" not in plan and "lang" not in plan
    assert "partial_" in plan or name == "superkmers"
    assert plan.count("Exchange hashpartitioning") <= SHUFFLES[name]
