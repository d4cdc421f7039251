import os
import random

import corpus_pipeline
from helixframe.llm.quality import fit_quality, score_quality
from helixframe.session import shared_dir
from tests.llm.test_near_dups import brute_force as groups
from tests.llm.test_suffixes import brute_force as spans


def test_every_stage_equals_its_brute_force_on_what_it_gets(spark, corpus, words, tmp_path):
    rng = random.Random(21)
    item = [(i, ". ".join(" ".join(rng.choice(words) + "q" for _ in range(12)).capitalize() for _ in range(2)) + ".") for i in range(6)]
    rows = [(i, t) for i, t in {i: t for i, t in corpus if i is not None}.items()]
    leaks, toxic = {}, []
    for n in range(60):
        text = " ".join(rng.choice(words) for _ in range(80))
        if n % 10 == 3:
            leaks[1000 + n] = n % 6
            text = f"{text}\n{item[n % 6][1]}\n{text[::-1]}"
        if n % 3 == 1:
            toxic.append(1000 + n)
            text = " ".join(w + rng.choice(["###", "$$$"]) for w in text.split())
        rows.append((1000 + n, text))
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i not in toxic), 0) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(item, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    model, now = fit_quality(frame, spark.read.parquet(f"{tmp_path}/labels.parquet")), frame
    before, after = {}, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before[name] = texts(now)
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        after[name] = texts(now)
        assert now.columns == frame.columns and len(after[name]) == now.count()
    score = {r["doc_id"]: r["score"] for r in score_quality(frame, model).collect()}
    assert set(after["quality"]) == {i for i in score if score[i] >= 0.3}
    assert len(set(toxic) - set(after["quality"])) >= 0.9 * len(toxic) and len(set(dict(rows)) - set(toxic) - set(after["quality"])) <= 3
    assert set(after["near_dedup"]) == {i for i, (_, c) in groups(list(before["near_dedup"].items()), 80).items() if i == c}
    assert all(after[n].items() <= before[n].items() for n in ("quality", "near_dedup", "decontaminate"))
    cut = spans(list(before["suffix_dedup"].items()))
    for i, (n, removed, _, _) in cut.items():
        left = after["suffix_dedup"].get(i)
        if removed and removed == n:
            assert left is None
        elif not removed:
            assert left == before["suffix_dedup"][i]
        elif left is not None and left.isascii():
            assert n - removed == len(left)
    held = {i for i, x in leaks.items() if i in before["decontaminate"] and item[x][1] in before["decontaminate"][i]}
    assert held and set(before["decontaminate"]) - set(after["decontaminate"]) == held
    there = set(os.listdir(shared_dir(spark).removeprefix("file://")))
    result = corpus_pipeline.run(spark, str(tmp_path))
    packed = result.collect()
    left = set(os.listdir(shared_dir(spark).removeprefix("file://"))) - there
    assert {n.rpartition("-")[0] for n in left} == {"pipeline-packing"} and len(left) == 1
    size = {}
    for r in packed:
        size[r["doc_id"]] = size.get(r["doc_id"], 0) + r["length"]
    assert size == {i: len((t or "").encode()) for i, t in after["decontaminate"].items()}


def test_stages_keep_the_columns_of_documents(spark, docs, words, tmp_path):
    rows = [(i, i % 2, 0) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    item = [(1, " ".join(words[:40])), (2, None)]
    spark.createDataFrame(item, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now = docs
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.schema == docs.schema or now.columns == docs.columns
    assert corpus_pipeline.run(spark, str(tmp_path)).columns[:2] == ["doc_id", "piece"]


def test_no_documents(spark, none, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    none.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
