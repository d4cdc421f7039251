"""MinHash near-duplicate groups by an LSH forest.

Every document gives its set of word shingles and a MinHash signature. Documents with one set are one class. A tree of
the forest orders all classes by the signature, beginning at another place in each tree; in such an order neighbours
whose longest common prefix has `depth` minima or more form a region, and the members of a region are candidates. The
orders are dealt out by range, on the whole key and the id, so a region may lie in several tasks.

Candidate groups, the connected regions of all trees, are mostly small: their members are compared on their full sets,
all that are not linked yet. A large group is ordered by its signatures; the regions of that order are as deep as it
takes for them to hold a bounded number of members, and each is compared with itself and with the member that is nearest
to the group's commonest minima. That joins nearly all there is to join. What the labels so far keep apart is then joined
exactly, whatever the size of the group: two sets that reach the threshold share one of their rarest shingles, so members
of different labels meet in the buckets of these alone, and only where their places in the order still allow a link are
they compared on their full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, product

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixframe.llm.common import gathered, of_ids, packed, small_batches, unpacked
from helixframe.llm.shingles import MinHash, shingle_set
from helixframe.operators.components import connected_components
from helixframe.session import stored, stored_if_large

WORD = 4  # bytes of a minimum
#: About so many members of a large group tell its commonest minima; which member leads a block does not change results
#: that are confirmed, only how many comparisons it takes.
SAMPLE = 512
#: About so many members of a shingle's bucket on either side are compared at a time.
SIDE = 256
#: How many values of a shingle's hash are counted apart, and in how many parts.
CELLS, SLICES = 2**20, 16


def shingled(docs: DataFrame, words: int, minima: int) -> DataFrame:
    """doc_id, n_shingles, print (of the set; null if empty) and signature of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHash(minima)
        for batch in batches:
            sizes, prints, signatures = [], [], []
            for value in batch.column(1):
                found = shingle_set(value.as_py(), words)
                sizes.append(len(found))
                prints.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                signatures.append(minhash(found).tobytes() if len(found) else None)
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(signatures, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "print", "signature"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, print binary, signature binary")


def _ordered(rows: DataFrame, trees: int, depth: int) -> DataFrame:
    """tree, key and id: every tree's order, by its first `depth` minima, dealt out by range."""
    width = depth * WORD
    keys = F.array(*[F.substring("signature", t * width + 1, width) for t in range(trees)])
    exploded = rows.select("id", F.posexplode(keys).alias("tree", "key"))
    return exploded.repartitionByRange("tree", "key", "id").sortWithinPartitions("tree", "key", "id")


def _neighbour_edges(rows: DataFrame, trees: int, depth: int) -> DataFrame:
    """src, dst: for every tree a chain of stars through all members of each region of that depth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, last, first = None, None, True
        borders: list[tuple] = []
        for b in gathered(batches):
            ids, tree = (b.column(c).to_numpy() for c in ("id", "tree"))
            key = np.stack([np.frombuffer(x, ">u4") for x in b.column("key").to_pylist()])
            common = (key[1:] == key[:-1]).all(1) & (tree[1:] == tree[:-1])  # the prefix of neighbours is `depth` long
            goes_on = np.concatenate([[last is not None and last == (tree[0], key[0].tobytes())], common])
            starts = np.where(goes_on, -1, np.arange(len(ids)))
            starts = np.maximum.accumulate(starts)
            heads = np.where(starts >= 0, ids[starts], head if head is not None else ids[0])
            if first:
                borders.append((int(tree[0]), key[0].tobytes(), int(heads[0])))
                first = False
            head, last = int(heads[-1]), (tree[-1], key[-1].tobytes())
            linked = heads != ids
            yield _edges(ids[linked], heads[linked])
        if last is not None:
            borders.append((int(last[0]), last[1], head))
            yield _edges([x[2] for x in borders], [x[2] for x in borders], [x[0] for x in borders], [x[1] for x in borders])

    def _edges(src, dst, tree=None, key=None):
        n = len(src)
        columns = [pa.array(src, pa.int64()), pa.array(dst, pa.int64())]
        columns += [pa.array(tree, pa.int32()) if tree else pa.nulls(n, pa.int32()), pa.array(key, pa.binary()) if key else pa.nulls(n, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["src", "dst", "tree", "key"])

    found = stored(_ordered(rows, trees, depth).mapInArrow(run, "src long, dst long, tree int, key binary"), "forest-edges")
    borders = found.where("key is not null")  # two rows a task; they join regions that lie in several
    joined = borders.withColumn("least", F.min("src").over(Window.partitionBy("tree", "key"))).where("src != least")
    return found.where("key is null").select("src", "dst").unionByName(joined.select("src", F.col("least").alias("dst"))).distinct()


def _verified(docs: DataFrame, members: DataFrame, count: int, words: int, percent: int) -> DataFrame:
    """src, dst: of the members of a block (doc_id, block) that sets of at least `percent` connect, each with the least."""

    def links(ids: list[int], texts: list[str]) -> Iterator[tuple[int, int]]:
        sets = [shingle_set(t, words) for t in texts]
        order = sorted(range(len(ids)), key=lambda i: len(sets[i]))
        parent = list(range(len(ids)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for at, j in enumerate(order):
            for i in reversed(order[:at]):  # from the nearest size down, until sets are too small to reach it
                a, b = len(sets[i]), len(sets[j])
                if 100 * a < percent * b:
                    break
                if root(i) != root(j):
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= percent * (a + b - both):
                        parent[root(j)] = root(i)
        least: dict[int, int] = {}
        for i, own in enumerate(ids):
            least[root(i)] = min(own, least.get(root(i), own))
        return ((least[root(i)], own) for i, own in enumerate(ids) if least[root(i)] != own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, texts, out = None, [], [], []
        for b in batches:
            for own, doc, text in zip(*(b.column(c).to_pylist() for c in ("block", "doc_id", "text")), strict=True):
                if own != block:
                    out += links(ids, texts)
                    block, ids, texts = own, [], []
                ids.append(doc)
                texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["src", "dst"])
            out = []
        out += links(ids, texts)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["src", "dst"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = of_ids(texts, members, count).select("block", "doc_id", "text").repartition("block").sortWithinPartitions("block")
    return dealt.mapInArrow(run, "src long, dst long")


def _adaptive_blocks(large: DataFrame, most: int) -> DataFrame:
    """id, component, block: the members (id, component, signature) of each large group in the order of their signatures,
    cut where neighbours have the shortest common prefix until `most` of them or fewer are left together."""

    def cut(shared: np.ndarray, low: int, high: int) -> Iterator[int]:
        """First places of the blocks of members low to high; shared[i] is the prefix of i with the one before."""
        todo = [(low, high)]
        while todo:
            a, b = todo.pop()
            if b - a <= most:
                yield a
                continue
            inner = shared[a + 1 : b]
            at = a + 1 + np.flatnonzero(inner == inner.min())
            if len(at) == len(inner):  # nothing tells them apart
                at = np.arange(a + most, b, most)
            todo += zip([a, *at.tolist()], [*at.tolist(), b], strict=True)

    def filled(firsts: list[int], high: int) -> Iterator[int]:
        """Of neighbouring blocks that fit together one."""
        start = firsts[0]
        for first, end in zip(firsts, [*firsts[1:], high], strict=True):
            if end - start > most:
                yield start
                start = first
        yield start

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches):
            ids, own = (b.column(c).to_numpy() for c in ("id", "component"))
            signature = np.frombuffer(b"".join(b.column("signature").to_pylist()), ">u4").reshape(len(ids), -1)
            differ = signature[1:] != signature[:-1]
            shared = np.where(differ.any(1), differ.argmax(1), signature.shape[1])
            shared = np.concatenate([[-1], np.where(own[1:] == own[:-1], shared, -1)])
            borders = [*np.flatnonzero(shared < 0).tolist(), len(ids)]
            firsts = np.array([f for low, high in zip(borders, borders[1:], strict=False) for f in filled(sorted(cut(shared, low, high)), high)])
            block = ids[firsts][np.searchsorted(firsts, np.arange(len(ids)), side="right") - 1]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, own, block)], names=["id", "component", "block"])

    rows = large.select("id", "component", "signature")
    dealt = rows.repartitionByRange("component", "signature", "id").sortWithinPartitions("component", "signature", "id")
    return dealt.mapInArrow(run, "id long, component long, block long")


def _blocks_of_large(large: DataFrame, minima: int, most: int) -> DataFrame:
    """doc_id, block: members (id, component, n, signature) of large groups in adaptive blocks of at most `most`, each with
    the member nearest to the group's commonest minima, as a bounded sample of the group has them."""
    sample = large.where(F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / SAMPLE)) == 0).select("component", "signature")

    def commonest(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        found = np.stack([np.frombuffer(x, ">u4") for x in frame["signature"]]).astype(np.uint32)
        common = []
        for column in found.T:
            values, counts = np.unique(column, return_counts=True)
            common.append(values[counts.argmax()])
        return pd.DataFrame({"of": [key[0]], "common": [np.array(common, ">u4").tobytes()]})

    modes = stored(sample.groupBy("component").applyInPandas(commonest, "of long, common binary"), "forest-modes")
    agree = sum(
        (F.substring("signature", WORD * i + 1, WORD) == F.substring("common", WORD * i + 1, WORD)).cast("int") for i in range(minima)
    )
    scored = large.join(modes, F.col("component") == F.col("of"), "left").select("id", "component", F.coalesce(agree, F.lit(0)).alias("agree"))
    centres = scored.groupBy("component").agg(F.max(F.struct("agree", (-F.col("id")).alias("id"))).alias("best"))
    centres = stored(centres.select(F.col("component").alias("of"), (-F.col("best.id")).alias("centre")), "forest-centres")
    dealt = stored(_adaptive_blocks(large, most), "forest-blocks")
    each = dealt.select("component", "block").distinct().join(centres, F.col("component") == F.col("of")).select(F.col("centre").alias("doc_id"), "block")
    return dealt.select(F.col("id").alias("doc_id"), "block").unionByName(each).distinct()


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """ids (doc_id and other columns) with the text of each row of docs that has the id."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return of_ids(texts, ids, ids.count())


def _common_shingles(rows: DataFrame, words: int) -> np.ndarray:
    """How often shingles occur in all texts of rows, as a power of two for each of CELLS values of their hash.

    Any order of shingles finds all pairs; this one, of a size that no table changes, puts rare ones first."""
    each = CELLS // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.uint32)
        for b in batches:
            for text in b.column(0).to_pylist():
                np.add.at(total, (shingle_set(text, words) % np.uint64(CELLS)).astype(np.int64), np.uint32(1))
        if total.any():
            parts = [packed(total[i * each : (i + 1) * each]) for i in range(SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], names=["slice", "counts"])

    def add(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(each, np.uint64)
        for frame in frames:
            for x in frame["counts"]:
                total += unpacked(x, "u4")
        yield pd.DataFrame({"slice": [key[0]], "power": [packed(np.log2(total + np.uint64(1)).astype(np.uint8))]})

    found = rows.select("text").mapInArrow(count, "slice int, counts binary").groupBy("slice").applyInPandas(add, "slice int, power binary").collect()
    powers = np.zeros(CELLS, np.uint8)
    for r in found:  # SLICES rows at most
        powers[r["slice"] * each : (r["slice"] + 1) * each] = unpacked(r["power"], "u1")
    return powers


def _rare_shingles(rows: DataFrame, powers: np.ndarray, words: int, percent: int) -> DataFrame:
    """shingle, at, id, label, size: of every text (doc_id, label) the first shingles, rarest first, of which a set that
    reaches `percent` with it must have one; `at` is the place in that order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, label, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "label", "text")), strict=True):
                own = shingle_set(text, words)
                if len(own):
                    order = np.lexsort((own, powers[(own % np.uint64(CELLS)).astype(np.int64)]))
                    first = own[order[: len(own) - -(-percent * len(own) // 100) + 1]]
                    n = len(first)
                    out.append((first.view(np.int64), np.arange(n), np.full(n, doc), np.full(n, label), np.full(n, len(own))))
            if out:
                columns = [pa.array(np.concatenate([x[i] for x in out]), pa.int64()) for i in range(5)]
                yield pa.RecordBatch.from_arrays(columns, names=["shingle", "at", "id", "label", "size"])

    return rows.select("doc_id", "label", "text").mapInArrow(run, "shingle long, at long, id long, label long, size long")


def _rare_pairs(rare: DataFrame, percent: int) -> DataFrame:
    """block, src, dst, a, b: once, every pair of members of other labels, a and b, that share a shingle of `rare` and whose
    sets can reach `percent` for all that sizes and places in the order tell.

    A shingle's members are dealt out wherever they lie: in parts of about SIDE, every part against every other and
    itself, except that the parts of the label with most members don't meet each other."""
    counts = rare.groupBy("shingle", "label").agg(F.count("*").alias("c"))
    buckets = counts.groupBy("shingle").agg(F.sum("c").alias("n"), F.max(F.struct("c", "label")).alias("most"), F.count("*").alias("labels")).where("labels > 1")
    parts = [F.col("most.label").alias("top"), F.ceil(F.col("most.c") / SIDE).alias("tops"), F.ceil((F.col("n") - F.col("most.c")) / SIDE).alias("others")]
    buckets = stored(buckets.select(F.col("shingle").alias("of"), *parts), "forest-buckets")
    of_top, hashed = F.col("label") == F.col("top"), F.xxhash64("id")
    last = F.col("tops") + F.col("others") - 1
    part = F.when(of_top, F.pmod(hashed, F.col("tops"))).otherwise(F.col("tops") + F.pmod(hashed, F.col("others")))
    against = F.explode(F.sequence(F.when(of_top, F.col("tops")).otherwise(F.lit(0).cast("long")), last))
    met = rare.join(buckets, F.col("shingle") == F.col("of")).withColumn("part", part).withColumn("against", against)
    block = F.xxhash64("shingle", F.least("part", "against"), F.greatest("part", "against")).alias("block")
    dealt = met.select(block, "part", (F.col("part") == F.col("against")).alias("within"), "id", "label", "size", "at")

    def pairs(block: int, part: np.ndarray, within: np.ndarray, ids: np.ndarray, labels: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        x = np.arange(len(ids)) if within[0] else np.flatnonzero(part == part[0])
        y = x if within[0] else np.flatnonzero(part != part[0])
        a, b = sizes[x][:, None], sizes[y][None, :]
        both = np.minimum(a - at[x][:, None], b - at[y][None, :])  # at most so many shingles are common, if this is the first
        fine = (labels[x][:, None] != labels[y][None, :]) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & ((100 + percent) * both >= percent * (a + b))
        i, j = np.nonzero(np.triu(fine) if within[0] else fine)
        i, j = x[i], y[j]
        turned = ids[i] > ids[j]
        i, j = np.where(turned, j, i), np.where(turned, i, j)
        columns = [np.full(len(i), block), ids[i], ids[j], labels[i], labels[j]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["block", "src", "dst", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.Table] = []
        for b in chain(gathered(batches), [None]):
            whole = pa.concat_tables(rest + ([b] if b is not None else [])) if rest or b is not None else None
            if whole is None:
                continue
            blocks = whole.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1), len(blocks)]
            rest = [] if b is None else [whole.slice(cuts[-2])]  # the last block may go on
            if b is not None:
                cuts.pop()
            columns = [whole.column(c).to_numpy() for c in ("part", "within", "id", "label", "size", "at")]
            for low, high in zip(cuts, cuts[1:], strict=False):
                yield pairs(blocks[low], *(c[low:high] for c in columns))

    found = dealt.repartition("block").sortWithinPartitions("block").mapInArrow(run, "block long, src long, dst long, a long, b long")
    return found.groupBy("src", "dst").agg(F.min("block").alias("block"), F.first("a").alias("a"), F.first("b").alias("b"))


def _verified_pairs(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """src, dst: the pairs (block, src, dst, a, b) that sets of at least `percent` link, but for those of labels that earlier
    pairs of the block link already."""
    ends = stored(pairs.select("block", F.explode(F.array("src", "dst")).alias("doc_id")).distinct(), "forest-ends")
    none = F.lit(None).cast("long")
    members = _texts_of(docs, ends).select("block", F.col("doc_id").alias("src"), *(none.alias(c) for c in ("dst", "a", "b")), "text")
    asked = pairs.select("block", "src", "dst", "a", "b", F.lit(None).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sets, parent = None, {}, {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for batch in batches:
            out = []
            for own, src, dst, a, b, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != block:
                    block, sets, parent = own, {}, {}
                if dst is None:  # members come first
                    sets.setdefault(src, []).append(shingle_set(text, words))  # rows may share an id
                elif root(a) != root(b):
                    for x, y in product(sets[src], sets[dst]):
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        if 100 * both >= percent * (len(x) + len(y) - both):
                            parent[root(b)] = root(a)
                            out.append((src, dst))
                            break
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["src", "dst"])

    dealt = members.unionByName(asked).repartition("block").sortWithinPartitions("block", F.col("dst").asc_nulls_first(), "src")
    return dealt.mapInArrow(run, "src long, dst long")


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = 5, trees: int = 16, depth: int = 4, most: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: groups of documents that sets of word shingles link.

    Two documents are linked if 100 * shared shingles >= percent * all shingles of both; candidates come from the
    forest and every link is confirmed on full sets. A pair exactly at 85 percent shares a region of one of 16 trees of
    depth 4 with a probability of 0.99999, one at 80 percent of 0.9998, besides other paths through its group.
    component_id is the smallest doc_id reachable, kept whether that is the own one. A text that is null, empty or
    white space has no shingles and is linked with nothing. Rows that share an id count as one document; a row without
    an id is linked with nothing, has a null component_id and is kept. Only doc_id and text are read; an empty table
    gives no rows.
    """
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs, percent, words, trees, depth, most)


def _near_duplicates(docs: DataFrame, percent: int, words: int, trees: int, depth: int, most: int) -> DataFrame:
    minima = trees * depth
    rows = stored(shingled(docs, words, minima), "forest-signatures")
    whole = rows.where("print is not null and doc_id is not null")
    n, ids = whole.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if n > ids:  # of rows with one id and text one is compared
        docs = docs.select("doc_id", "text").dropDuplicates(["doc_id", "text"])
    classes = stored(whole.groupBy("print").agg(F.min("doc_id").alias("id"), F.first("signature").alias("signature")), "forest-classes")
    groups = connected_components(_neighbour_edges(classes.select("id", "signature"), trees, depth))
    sizes = groups.groupBy("component").agg(F.count("*").alias("n")).withColumnRenamed("component", "of")
    sizes = stored_if_large(sizes, groups.count(), "forest-sizes")
    sized = stored(groups.join(sizes, F.col("component") == F.col("of")).select("node", "component", "n"), "forest-groups")
    small, n_large = sized.where(F.col("n") <= most), sized.where(F.col("n") > most).count()
    members = small.select(F.col("node").alias("doc_id"), F.col("component").alias("block"))
    signed = classes.select("id", "signature").dropDuplicates(["id"])
    if n_large:
        large = stored(sized.where(F.col("n") > most).join(signed, F.col("node") == F.col("id")).select("id", "component", "n", "signature"), "forest-large")
        members = stored(members.unionByName(_blocks_of_large(large, minima, most)), "forest-members")
    links = stored(_verified(docs, members, members.count(), words, percent), "forest-links")
    labels = connected_components(links)
    if n_large:
        labels_of = labels.select(F.col("node").alias("id"), F.col("component").alias("label"))
        labelled = stored(large.join(labels_of, "id", "left").select("id", "component", F.coalesce("label", "id").alias("label")), "forest-labels")
        apart = labelled.groupBy("component").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
        apart = stored(apart.select(F.col("component").alias("of")), "forest-apart")  # groups that are not one label yet
        members = stored(labelled.join(apart, F.col("component") == F.col("of")).select(F.col("id").alias("doc_id"), "label"), "forest-members")
        texts = stored(_texts_of(docs, members).select("doc_id", "label", "text"), "forest-texts")
        rare = stored(_rare_shingles(texts, _common_shingles(texts, words), words, percent), "forest-rare")
        pairs = stored(_rare_pairs(rare, percent), "forest-pairs")
        labels = connected_components(links.unionByName(stored(_verified_pairs(docs, pairs, words, percent), "forest-links")))
    joined = classes.select("print", "id").join(labels, F.col("id") == F.col("node"), "left")
    groups_of = stored(joined.select(F.col("print").alias("of"), F.coalesce("component", "id").alias("group")), "forest-result")
    component = F.coalesce("group", "doc_id")
    linked = F.col("print").isNotNull() & F.col("doc_id").isNotNull()
    alone = rows.where(~linked).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    found = rows.where(linked).join(groups_of, F.col("print") == F.col("of"), "left")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept")).unionByName(alone)


def without_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, that near_duplicates keeps. Of rows that share an id one stays."""
    found = stored(near_duplicates(docs, percent), "near-duplicates")
    if found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        docs = docs.where("doc_id is null").unionByName(docs.where("doc_id is not null").dropDuplicates(["doc_id"]))
    dropped = stored(found.where("not kept").select("doc_id").distinct(), "near-duplicates")
    return of_ids(docs, dropped, dropped.count(), "left_anti").select(*docs.columns)
