"""Benchmark decontamination: a BM25 inverted index of the test items, asked by every training passage.

Documents are read in overlapping passages; each is a query against the index. Block-max WAND finds all items whose
score reaches the threshold: impacts are kept with their maximum per term and per block of a term's postings. Terms whose
maxima together stay below the threshold can't make a passage reach it alone, so only the blocks of its other terms are
looked at first; the sums of the blocks' maxima rule out nearly all of these for a batch at once, and the postings of the rest
are walked with pivots. A found item is verified on the text around the passage: the word n-grams of its question and
those of its answer must both occur. Postings and maxima are sparse, so an index grows with its items' text alone.

The index holds test items, not documents. Items are dealt to indexes of bounded size; each is asked by all passages.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import sliced

WINDOW, STRIDE = 64, 32
#: An item of more words is as good as this many of them: the least that some passage holds of it.
COVERED = WINDOW - STRIDE // 2
NOT_WORD = re.compile(r"[\W_]+")
CACHE_ENTRIES, KNOWN_ITEMS = 300_000, 10_000
#: How much scores may differ by the order of their sums.
SLACK = 1e-6
#: Weak terms are those that reach less than this share of the threshold together; at most 1, which changes no result.
LIGHT = 0.4
#: About so many blocks of postings are looked at together.
EXPANDED = 500_000


def normalise(word: str) -> str:
    return NOT_WORD.sub("", word.lower())


def words_of(text: str) -> list[str]:
    return [w for w in map(normalise, text.split()) if w]


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The words before and in the last line, or else the last sentence; the answer is empty if there is only one."""
    lines = [x for x in text.splitlines() if words_of(x)]
    if len(lines) < 2:
        lines = [x for x in re.split(r"(?<=[.?!])\s+", text) if words_of(x)]
    return [w for x in lines[: max(1, len(lines) - 1)] for w in words_of(x)], words_of(lines[-1]) if len(lines) > 1 else []


def ngrams(words: list[str], n: int) -> set[tuple[str, ...]]:
    """Distinct n-grams; of fewer words, all as one."""
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def _ends(first: np.ndarray, n: int) -> np.ndarray:
    """Where slices of n values end that begin at first."""
    return np.append(first[1:], n) if len(first) else first


class Frequencies:
    """The number of items that have any word, of all their words, and of the items that have each word."""

    def __init__(self):
        self.items, self.words, self.having = 0, 0, Counter()

    def add(self, items: list[list[str]]) -> Frequencies:
        for ws in items:
            self.items += bool(ws)
            self.words += len(ws)
            self.having.update(set(ws))
        return self


class BlockMaxIndex:
    """Postings with impacts, each impact a share of the most that its item can score. Frequencies are the items' own,
    unless those of the whole benchmark are given."""

    def __init__(self, items: list[tuple[int, str]], block: int = 8, k1: float = 1.2, b: float = 0.75, n: int = 3, whole: Frequencies | None = None):
        self.items = [(i, text) for i, text in items if words_of(text)]
        self.block, self.n = block, n
        words = [words_of(t) for _, t in self.items]
        self.lengths = [len(w) for w in words]
        whole = whole or Frequencies().add(words)
        mean = max(1.0, whole.words / whole.items) if whole.items else 1.0
        self.ids: dict[str, int] = {}
        for w in (w for ws in words for w in ws):
            self.ids.setdefault(w, len(self.ids))
        self.terms = len(self.ids)
        at = np.repeat(np.arange(len(words)), self.lengths)
        term = np.fromiter((self.ids[w] for ws in words for w in ws), np.int64, len(at))
        key, c = np.unique(term * max(1, len(words)) + at, return_counts=True)
        term, self.at = np.divmod(key, max(1, len(words)))  # postings by term, then by item
        having = np.array([whole.having[w] for w in self.ids], np.int64)
        idf = np.log(1 + (whole.items - having + 0.5) / (having + 0.5))
        lengths = np.array(self.lengths, float)
        impact = idf[term] * c * (k1 + 1) / (c + k1 * (1 - b + b * lengths[self.at] / mean))
        total = np.bincount(self.at, impact, len(words)) * np.minimum(1, COVERED / np.maximum(1, lengths))
        impact = impact / total[self.at]
        strength = np.zeros(self.terms)
        np.maximum.at(strength, term, impact)
        weakest = np.argsort(strength, kind="stable")  # terms are numbered from the weakest up
        rank = np.argsort(weakest)
        self.ids = {w: int(i) for w, i in zip(self.ids, rank, strict=True)}
        by = np.lexsort((self.at, rank[term]))
        term, self.at, self.impact = rank[term][by], self.at[by], impact[by]
        self.term_max = np.append(strength[weakest], 0.0)
        self.first = np.searchsorted(term, np.arange(self.terms + 2))  # the last term is that of all other words
        self.blocks = max(1, -(-len(words) // block))
        self.block_key, begin = np.unique(term * self.blocks + self.at // block, return_index=True)
        self.block_max = np.maximum.reduceat(self.impact, begin) if len(begin) else np.zeros(0)
        self.block_first = np.searchsorted(self.block_key, np.arange(self.terms + 2) * self.blocks)
        self.known: dict[int, tuple[set, set]] = {}

    def halves(self, item: int) -> tuple[set, set]:
        """The n-grams of an item's question and of its answer."""
        if item not in self.known:
            if len(self.known) > KNOWN_ITEMS:
                self.known.clear()
            question, answer = question_and_answer(self.items[item][1])
            self.known[item] = ngrams(question, self.n), ngrams(answer, self.n)
        return self.known[item]

    def maxima(self, terms: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """The maximum of each term in each block, 0 where a block has no such term."""
        if not len(self.block_key):
            return np.zeros(len(terms))
        key = terms * self.blocks + blocks
        place = np.minimum(np.searchsorted(self.block_key, key), len(self.block_key) - 1)
        return np.where(self.block_key[place] == key, self.block_max[place], 0.0)

    def candidates(self, begin: np.ndarray, term: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(passage, block) that can reach the threshold; the terms of passage i begin at begin[i] and ascend."""
        n = _ends(begin, len(term)) - begin
        passage = np.repeat(np.arange(len(begin)), n)
        total = np.cumsum(self.term_max[term])
        total -= np.repeat(np.concatenate([[0], total])[begin], n)
        strong = total >= LIGHT * threshold - SLACK  # from the weakest term up
        weak = np.bincount(passage, np.where(strong, 0, self.term_max[term]), len(begin))
        light = np.bincount(passage[~strong], minlength=len(begin))
        chosen = np.flatnonzero(strong)
        first, count = self.block_first[term[chosen]], np.diff(self.block_first)[term[chosen]]
        start = np.flatnonzero(np.diff(passage[chosen], prepend=-1))
        looked = (np.cumsum(count) - count)[start] + np.arange(len(start)) * self.blocks
        low = start[np.flatnonzero(np.diff(looked // EXPANDED, prepend=-1))]
        found_p, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for low, high in zip(low, _ends(low, len(chosen)), strict=True):  # whole passages, about EXPANDED blocks at a time
            f, c, own = first[low:high], count[low:high], passage[chosen[low:high]]
            place = np.repeat(f - np.cumsum(c) + c, c) + np.arange(c.sum())
            key = np.repeat((own - own[0]) * self.blocks, c) + self.block_key[place] % self.blocks
            bounds = np.bincount(key, self.block_max[place], (own[-1] - own[0] + 1) * self.blocks).reshape(-1, self.blocks)
            p, b = np.nonzero(bounds >= (threshold - SLACK - weak[own[0] : own[-1] + 1])[:, None])
            bound, p = bounds[p, b], p + own[0]
            owner = np.repeat(np.arange(len(p)), light[p])  # a passage's weak terms come first
            place = np.repeat(begin[p] - np.cumsum(light[p]) + light[p], light[p]) + np.arange(light[p].sum())
            fine = bound + np.bincount(owner, self.maxima(term[place], b[owner]), len(p)) >= threshold - SLACK
            found_p.append(p[fine])
            found_b.append(b[fine])
        return np.concatenate(found_p), np.concatenate(found_b)

    def search(self, terms: np.ndarray, blocks: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """All items of these blocks that score at least threshold, by block-max WAND over the terms' postings."""
        found = []
        for block in blocks:
            low, high = int(block) * self.block, (int(block) + 1) * self.block
            bounds = self.maxima(terms, np.full(len(terms), block))
            cursors = []
            for t, bound in zip(terms[bounds > 0].tolist(), bounds[bounds > 0].tolist(), strict=True):
                a, b = self.first[t], self.first[t + 1]
                c, d = np.searchsorted(self.at[a:b], [low, high]) + a
                cursors.append([list(zip(self.at[c:d].tolist(), self.impact[c:d].tolist(), strict=True)), 0, bound])
            while cursors:
                cursors.sort(key=lambda c: c[0][c[1]][0])
                bound, pivot = 0.0, None
                for c in cursors:
                    bound += c[2]
                    if bound >= threshold - SLACK:
                        pivot = c[0][c[1]][0]
                        break
                if pivot is None:
                    break
                if cursors[0][0][cursors[0][1]][0] == pivot:
                    score = sum(c[0][c[1]][1] for c in cursors if c[0][c[1]][0] == pivot)
                    if score >= threshold - SLACK:
                        found.append((pivot, score))
                    for c in cursors:
                        c[1] += c[0][c[1]][0] == pivot
                else:
                    for c in cursors:
                        while c[1] < len(c[0]) and c[0][c[1]][0] < pivot:
                            c[1] += 1
                cursors = [c for c in cursors if c[1] < len(c[0])]
        return found


class Asker:
    """Asks an index with all passages of batches of documents."""

    def __init__(self, index: BlockMaxIndex, threshold: float, overlap: float):
        self.index, self.threshold, self.overlap = index, threshold, overlap
        self.cache: dict[str, int] = {}

    def _id(self, word: str) -> int:
        """The term, the number of terms if the index has none such, or -1 for what is no word."""
        w = normalise(word)
        n = self.index.ids.get(w, self.index.terms) if w else -1
        if len(word) <= 64:
            self.cache[word] = n
        return n

    def ask(self, texts: list[str]) -> list[list[tuple[int, float, float, float]]]:
        """For each text its verified (item id, score, question overlap, answer overlap), by item id."""
        out: list[list] = [[] for _ in texts]
        ids, owners, size = [], [], 0
        for d, text in enumerate(texts):
            if len(self.cache) > CACHE_ENTRIES:
                self.cache.clear()
            get, own = self.cache.get, []
            for w in text.split():
                n = get(w)
                own.append(self._id(w) if n is None else n)
            a = np.array(own, np.int64)
            a = a[a >= 0]
            if len(a):
                ids.append(a)
                owners.append(d)
                size += len(a)
            if size > 200_000 or d == len(texts) - 1 and ids:
                for at, found in self._passages(ids).items():
                    d0 = owners[at]
                    out[d0] = self._verified(words_of(texts[d0]), found)
                ids, owners, size = [], [], 0
        return out

    def _passages(self, docs: list[np.ndarray]) -> dict[int, list[tuple[int, int, float]]]:
        """For each document (place in docs) the (passage, item, score) that reach the threshold."""
        lengths = np.array([len(a) for a in docs])
        passages = np.maximum(1, -(-(lengths - WINDOW) // STRIDE) + 1)
        first = np.concatenate([[0], np.cumsum(passages)])
        flat = np.concatenate(docs)
        owner = np.repeat(np.arange(len(docs)), lengths)
        half = (np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)) // STRIDE
        known = flat < self.index.terms
        flat, owner, half = flat[known], owner[known], half[known]
        terms = self.index.terms + 1
        keys = []
        for shift in (0, 1):  # a word is in the passage that begins in its stride and in the one before
            p = half - shift
            fine = (p >= 0) & (p < passages[owner])
            keys.append((first[owner[fine]] + p[fine]) * terms + flat[fine])
        keys = np.unique(np.concatenate(keys))
        if not len(keys):
            return {}
        passage, term = keys // terms, keys % terms
        begin = np.flatnonzero(np.diff(passage, prepend=-1))
        found: dict[int, list[tuple[int, int, float]]] = {}
        ends = _ends(begin, len(term))
        at, block = self.index.candidates(begin, term, self.threshold)
        cuts = np.flatnonzero(np.diff(at, prepend=-1))
        for low, high in zip(cuts, _ends(cuts, len(at)), strict=True):
            own = slice(begin[at[low]], ends[at[low]])
            p = int(passage[begin[at[low]]])
            d = int(np.searchsorted(first, p, side="right")) - 1
            for item, score in self.index.search(term[own], block[low:high], self.threshold):
                found.setdefault(d, []).append((p - int(first[d]), item, score))
        return found

    def _verified(self, words: list[str], found: list[tuple[int, int, float]]) -> list[tuple[int, float, float, float]]:
        best: dict[int, tuple[float, float, float]] = {}
        for p, item, score in found:
            reach = self.index.lengths[item]
            around = ngrams(words[max(0, p * STRIDE - reach) : p * STRIDE + WINDOW + reach], self.index.n)
            question, answer = self.index.halves(item)
            n = self.index.n
            share = [
                1.0 if not part else sum(g in around or (len(g) < n and any(h[:len(g)] == g or h[-len(g):] == g for h in around)) for g in part) / len(part)
                for part in (question, answer)
            ]
            if min(share) >= self.overlap:
                best[item] = max(best.get(item, (0.0, 0.0, 0.0)), (score, *share))
        return sorted((self.index.items[i][0], *x) for i, x in best.items())


def _indexes(benchmark: DataFrame, max_index_bytes: int) -> Iterator[BlockMaxIndex]:
    """The items, dealt by a hash to indexes of about max_index_bytes of text; all score by the whole benchmark's frequencies."""
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-size // max_index_bytes))

    def items(chunk: int) -> list[tuple[int, str]]:
        return sorted((r["item_id"], r["text"]) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)) == chunk).collect())

    whole = None
    if chunks > 1:
        whole = Frequencies()
        for chunk in range(chunks):
            whole.add([words_of(text) for _, text in items(chunk)])
    for chunk in range(chunks):
        yield BlockMaxIndex(items(chunk), whole=whole)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.6, max_index_bytes: int = 8_000_000
) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: each test item that each document holds.

    docs has doc_id and text, benchmark item_id and text. score is the best passage's BM25 score as a share of the most
    that the item can reach in a passage; it must be at least `threshold`, and at least `overlap` of the item's question
    n-grams and of its answer n-grams must occur around that passage. Words are compared lower-cased, letters and
    digits only. Null and empty texts, of documents or items, match nothing; items without an id are left out; repeated
    items each match, repeated rows are each reported; without items or documents there are no rows. The size of the
    items' text is measured; what goes to the workers at a time is bounded by max_index_bytes.
    """
    parts = [_leaks(docs, index, threshold, overlap) for index in _indexes(benchmark, max_index_bytes)]
    return reduce(DataFrame.unionByName, parts)


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.6, max_index_bytes: int = 8_000_000
) -> DataFrame:
    """The rows of docs, with all their columns, for which find_leaks has no row. A null text stays."""
    at = docs.columns.index("text")
    for index in _indexes(benchmark, max_index_bytes):

        def run(batches: Iterator[pa.RecordBatch], index: BlockMaxIndex = index) -> Iterator[pa.RecordBatch]:
            asker = Asker(index, threshold, overlap)
            for b in sliced(batches, 2000):
                yield b.filter(pa.array([not a for a in asker.ask([x.as_py() or "" for x in b.column(at)])], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def _leaks(docs: DataFrame, index: BlockMaxIndex, threshold: float, overlap: float) -> DataFrame:
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = T.StructType(
        [rows.schema["doc_id"], T.StructField("item_id", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("score", "question_overlap", "answer_overlap"))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asker = Asker(index, threshold, overlap)
        for b in sliced(batches, 2000):
            answers = asker.ask([x.as_py() or "" for x in b.column(1)])
            at = [i for i, a in enumerate(answers) for _ in a]
            flat = [x for a in answers for x in a]
            columns = [pa.array([x[i] for x in flat], pa.int64() if not i else pa.float64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *columns], names=schema.names)

    return rows.mapInArrow(run, schema)
