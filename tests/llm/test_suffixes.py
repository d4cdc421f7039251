import hashlib
import random

import numpy as np
import pytest

from helixframe.llm import suffixes
from helixframe.llm.suffixes import Repeats, remove_repeats, repeated_spans, without_repeats


def brute_force(corpus, length=50):
    docs = {i: (t or "").encode() for i, t in corpus if i is not None}
    seen, out = set(), {}
    for i in sorted(docs):
        b = docs[i]
        own = [b[j : j + length] for j in range(len(b) - length + 1)]
        cover = bytearray(len(b))
        for j, w in enumerate(own):
            if w in seen:
                cover[j : j + length] = b"\1" * length
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        runs = sum(1 for p in bytes(cover).split(b"\0") if p)
        out[i] = (len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest())
        seen.update(own)
    return out


def check(rows, corpus):
    want = brute_force(corpus)
    assert len(rows) == len(corpus)
    for r in rows:
        if r["doc_id"] is None:
            assert r["n_removed"] == r["n_spans"] == 0
        else:
            assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]]


def test_equals_brute_force(docs, corpus):
    check(remove_repeats(docs).collect(), corpus)


@pytest.mark.parametrize("direct", [4096, 1])
def test_small_runs_and_buckets(docs, corpus, monkeypatch, direct):
    """Many runs and buckets, in one step and in two; trees of two streams, so that there are several passes."""
    for name, value in {"RUN_BYTES": 3000, "MOST_BYTES": 20_000, "PIECE_BYTES": 300, "DIRECT_BUCKETS": direct, "MERGED_RUNS": 2, "BROADCAST_BYTES": 0}.items():
        monkeypatch.setattr(suffixes, name, value)
    x = suffixes.Exchange.of(sum(len((t or "").encode()) for _, t in corpus))
    assert x.buckets > 20 and (x.ranges > 3) == (direct == 1) and x.streams == 2
    check(remove_repeats(docs.coalesce(1)).collect(), corpus)


def test_units_grow_with_the_text_up_to_a_bound():
    sizes = [suffixes.Exchange.of(10**n) for n in range(6, 15)]
    assert [x.ranges > 0 for x in sizes] == [x.buckets > suffixes.DIRECT_BUCKETS for x in sizes]
    assert max(x.run_bytes for x in sizes) == suffixes.MOST_BYTES and sizes[0].buckets == 1
    h = np.sort(np.random.default_rng(1).integers(0, 2**suffixes.HASH_BITS, 10_000).astype(np.uint64))
    for x in sizes:
        own = x.bucket(h)
        assert (np.diff(own) >= 0).all() and own.min() >= 0 and own.max() < x.buckets
        assert (x.first(h) // x.per_range == own // x.per_range).all()


@pytest.mark.parametrize("direct", [4096, 1])
def test_hot_groups_leave_the_merge(docs, corpus, monkeypatch, direct):
    monkeypatch.setattr(suffixes.repeated_spans, "__defaults__", (50, 3))
    for name, value in {"RUN_BYTES": 2000, "MOST_BYTES": 2000, "DIRECT_BUCKETS": direct}.items():
        monkeypatch.setattr(suffixes, name, value)
    check(remove_repeats(docs).collect(), corpus)


def test_stage_cuts_texts(docs, corpus):
    found = without_repeats(docs)
    assert found.columns == docs.columns and found.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    want = brute_force(corpus)
    seen = {}
    for r in found.where("doc_id is not null").collect():
        seen[r["doc_id"]] = r
        n, removed, _, sha = want[r["doc_id"]]
        if not removed:
            assert hashlib.sha256((r["text"] or "").encode()).hexdigest() == sha
        elif all(ord(c) < 128 for c in r["text"]):
            assert len(r["text"].encode()) <= n - removed and r["n_chars"] == len(r["text"])
    assert {i for i, w in want.items() if not w[1]} <= set(seen)
    assert not {i for i, w in want.items() if w[0] == w[1] >= 50} & set(seen)


def test_same_id_with_different_texts(spark):
    rows = [(1, "x" * 60), (1, "y" * 70), (2, "x" * 60), (3, "y" * 70 + "z")]
    found = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == 4
    assert {r["doc_id"]: r["n_removed"] for r in found if r["doc_id"] > 1}[2] == 60


def test_empty_table(none):
    assert remove_repeats(none).count() == 0
    assert without_repeats(none).count() == 0


def test_short_strings_are_refused(docs):
    with pytest.raises(ValueError):
        repeated_spans(docs, 20)


def test_loser_tree_merges_in_order():
    rng = random.Random(1)
    runs = []
    for _ in range(9):
        own = sorted(int.from_bytes(bytes(rng.choice(b"ab") for _ in range(6)), "big") for _ in range(rng.randint(0, 40)))
        run, last = [], None
        for x in own:
            run.append((x, 0 if last is None else 6 - ((x ^ last).bit_length() + 7) // 8))
            last = x
        runs.append(run)
    for most in (256, 2, 3):
        merged_in_order(runs, list(suffixes.merged([iter(r) for r in runs], 6, most)))


def merged_in_order(runs, out):
    keys = [x[0] for x, _ in out]
    assert keys == sorted(x for r in runs for x, _ in r)
    for (a, b), (_, common) in zip(zip(keys, keys[1:], strict=False), out[1:], strict=True):
        assert common == 6 - ((a ^ b).bit_length() + 7) // 8


def test_group_rules_agree():
    rng = random.Random(2)
    r = Repeats(50)
    texts = [bytes(rng.choice(b"ab") for _ in range(60)) for _ in range(5)]
    group = []
    for d in range(15):
        t = bytearray(rng.choice(texts) + rng.choice(texts))
        t[rng.randrange(len(t))] = 65 + d
        right, left = rng.randint(20, 50), rng.randint(0, 30)
        key = bytes(t[40 : 40 + right]).ljust(50, b"\0") + bytes(t[40 - left : 40][::-1]).ljust(30, b"\0")
        group.append((int.from_bytes(key, "big"), 0, rng.randint(0, 6), right, left, 40, 0, 0))
    assert r._many(group) == [r._one(group, g) for g in group]
