from graph_cases import CASES, sequences
from pyspark.sql import functions as F

from helixframe.operators.clip import clip
from helixframe.operators.kmers import de_bruijn


def rc(s):
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def test_all_small_cases_at_once(spark):
    reads = [(i, case, s) for case, (given, _) in CASES.items() for i, s in enumerate(sequences(given))]
    graph = clip(de_bruijn(spark.createDataFrame(reads, "read_id long, sample string, seq string"), 9))
    found = {}
    for r in graph.nodes.select(F.split("id", ":")[0].alias("sample"), "seq").collect():
        found.setdefault(r["sample"], []).append(min(r["seq"], rc(r["seq"])))
    wrong = {}
    for case, (_, expected) in CASES.items():
        want = sorted(min(s, rc(s)) for s in sequences(expected))
        if sorted(found.get(case, [])) != want:
            wrong[case] = (sorted(found.get(case, [])), want)
    assert not wrong
