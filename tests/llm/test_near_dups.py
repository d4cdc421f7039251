import random

import numpy as np
from pyspark.sql import functions as F

from helixframe.llm import near_dups
from helixframe.llm.near_dups import near_duplicates, without_near_duplicates
from helixframe.llm.shingles import shingle_set


def brute_force(corpus, percent):
    sets = {}
    for i, t in corpus:
        if i is not None:
            words = (t or "").encode().lower().split()
            sets[i] = {tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))} if words else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


def check(spark, docs, corpus, percent):
    want = brute_force(corpus, percent)
    rows = near_duplicates(docs, percent).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_equals_brute_force(spark, docs, corpus):
    check(spark, docs, corpus, 85)


def test_large_groups_in_small_blocks(spark, docs, corpus):
    want = brute_force(corpus, 80)
    rows = near_duplicates(docs.drop("n"), 80, most=8).where("doc_id is not null").collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == {i: c for i, (_, c) in want.items()}


def test_texts_are_shuffled_beyond_the_broadcast_bound(spark, docs, corpus, monkeypatch):
    monkeypatch.setattr("helixframe.llm.common.BROADCAST_IDS", 0)
    monkeypatch.setattr(near_dups.of_ids, "__defaults__", ("inner", 0))
    check(spark, docs, corpus, 85)


def test_stage_keeps_one_of_each_group(docs, corpus):
    found = without_near_duplicates(docs)
    assert found.columns == docs.columns
    ids = [r[0] for r in found.select("doc_id").collect()]
    want = {i for i, (_, c) in brute_force(corpus, 80).items() if i == c}
    assert sorted(i for i in ids if i is not None) == sorted(want)
    assert sum(i is None for i in ids) == 2


def test_empty_table(none):
    assert near_duplicates(none).count() == 0
    assert without_near_duplicates(none).count() == 0


def test_shingles():
    assert len(shingle_set(None)) == len(shingle_set(" \t\n")) == 0
    assert len(shingle_set("a b")) == 1
    assert np.array_equal(shingle_set("A b c d e f"), shingle_set("a  b\x0bc\td\ne f"))
    assert not np.array_equal(shingle_set("É b c d e"), shingle_set("é b c d e"))
    assert not np.array_equal(shingle_set("a b"), shingle_set("b a"))


def test_repeated_rows_stay_rows(docs):
    assert near_duplicates(docs.where("doc_id = 3")).agg(F.count("*")).first()[0] == 3


def family(n, planted):
    """(doc_id, text): n texts that share 0.75 to 0.80 of their shingles with each other, and copies of the first
    `planted` of them that share a little more than 0.80 with their own."""
    rng = random.Random(11)
    hub = [f"w{i}" for i in range(270)]

    def changed(words, count, mark):
        w = list(words)
        for at in rng.sample(range(0, 270, 5), count):
            w[at] = f"{mark}-{at}"
        return w

    texts = [changed(hub, 4, f"a{i}") for i in range(n)]
    texts += [changed(texts[i], 5, f"b{i}") for i in range(planted)]
    return [(i, " ".join(w)) for i, w in enumerate(texts)]


def test_regions_of_a_large_group_stay_whole(spark):
    corpus = family(600, 150)
    want = {i: c for i, (_, c) in brute_force(corpus, 80).items()}
    assert sum(i != c for i, c in want.items()) >= 150
    found = near_duplicates(spark.createDataFrame(corpus, "doc_id long, text string").repartition(4), 80)
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == want


def test_every_partner_of_another_label_is_met(spark, monkeypatch):
    """All pairs of two labels that reach the threshold are candidates, however many members share a shingle."""
    monkeypatch.setattr(near_dups, "SIDE", 16)
    text = dict(family(120, 20))
    sets = {i: shingle_set(t) for i, t in text.items()}
    rows = spark.createDataFrame([(i, i % 7, t) for i, t in text.items()], "doc_id long, label long, text string").repartition(3)
    rare = near_dups._rare_shingles(rows, near_dups._common_shingles(rows, 5), 5, 75)
    pairs = near_dups._rare_pairs(rare, 75)
    found = [(r["src"], r["dst"]) for r in pairs.collect()]
    assert len(found) == len(set(found)) and all(a % 7 != b % 7 for a, b in found)
    share = {(i, j): len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) for i in sets for j in sets if i < j and i % 7 != j % 7}
    want = {p for p, x in share.items() if x >= 0.75}
    assert len(want) > 100 and want <= set(found)
    linked = [(r["src"], r["dst"]) for r in near_dups._verified_pairs(rows, pairs, 5, 75).collect()]
    assert linked and set(linked) <= want


def test_blocks_of_large_groups_are_as_deep_as_it_takes(spark):
    rng = random.Random(4)
    signature = lambda x: bytearray(np.array(x, ">u4").tobytes())
    rows = [(i, 1, signature([i % 3, rng.randrange(50), rng.randrange(2**32), i])) for i in range(900)] + [(900 + i, 2, signature([7] * 4)) for i in range(100)]
    found = near_dups._adaptive_blocks(spark.createDataFrame(rows, "id long, component long, signature binary").coalesce(1), 30).collect()
    assert len({r["id"] for r in found}) == len(found) == len(rows)
    blocks = {}
    for r in found:
        blocks.setdefault(r["block"], []).append(r)
    assert all(len(b) <= 30 and len({r["component"] for r in b}) == 1 for b in blocks.values())


def test_rows_that_repeat_a_third_of_the_table(spark):
    texts = dict(family(150, 40))
    rows = list(texts.items()) + [(5, texts[5])] * 100
    want = {i: c for i, (_, c) in brute_force(list(texts.items()), 80).items()}
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 80).collect()
    assert len(found) == len(rows) and {r["doc_id"]: r["component_id"] for r in found} == want
