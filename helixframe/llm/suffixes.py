"""Exact removal of repeated byte strings by a sparse suffix array that is merged across the cluster.

Of all suffixes only anchors are kept: those whose first GRAM bytes have the least hash of some window of `length`
bytes. Two equal strings of that length have the same anchors, so every repeated string holds an anchor that repeats.

1. Runs of documents send sorted hashes of their anchors; anchors that one document alone has go no further.
2. Each run sorts the suffixes at its remaining anchors, with the bytes before them behind, keeps of equal ones those of
   its smallest document, and sends them front-coded: a common prefix is a number.
3. A loser tree merges the runs. Heads carry their common prefix with the last suffix out; the longer one wins, and only
   where two are as long are bytes compared, those beyond. The stream's common prefixes delimit groups of one anchor;
   in a group each suffix finds the windows around it that a smaller document has.

Answers return to the run, and from there to each document as the spans to remove.

Runs and buckets grow with the square root of the text, up to a bound, so that pieces stay as large; beyond it pieces go
in two steps, by groups of runs and ranges of buckets: a loser tree merges what a group sends to a range, and answers
return the same way. More streams than a tree may have are merged in passes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import of_ids, packed, sliced, small_batches, unpacked
from helixframe.session import stored

GRAM = 20
HASH_BITS = 48
#: The least and the most text of a run or a bucket, and the text that a run should have in a bucket.
RUN_BYTES, MOST_BYTES, PIECE_BYTES = 8_000_000, 32_000_000, 32_000
#: Up to so many buckets pieces go there in one step.
DIRECT_BUCKETS = 4096
CHUNK_BYTES = 200_000
#: The most streams of a loser tree.
MERGED_RUNS = 256
SMALL_GROUP = 12
SENT = "bucket long, grp long, run long, kind int, a binary, b binary, c binary"
ANSWER = "run long, kind int, a binary, b binary, c binary"


@dataclass(frozen=True)
class Exchange:
    """How text is dealt to runs, suffixes to buckets, and whether they get there in one step or two."""

    run_bytes: int
    buckets: int
    ranges: int  # of buckets; 0 in one step
    streams: int

    @classmethod
    def of(cls, total: int) -> Exchange:
        size = max(RUN_BYTES, min(MOST_BYTES, isqrt(total * PIECE_BYTES)))
        buckets = max(1, -(-total // size))
        return cls(size, buckets, isqrt(buckets) if buckets > DIRECT_BUCKETS else 0, MERGED_RUNS)

    @property
    def per_range(self) -> int:
        return -(-self.buckets // max(1, self.ranges))

    def bucket(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(HASH_BITS - 32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)

    def first(self, hashes: np.ndarray) -> np.ndarray:
        """Where a run sends hashes: their bucket, or the first one of its range."""
        return self.bucket(hashes) // self.per_range * self.per_range if self.ranges else self.bucket(hashes)

    def group(self, run: int) -> int:
        """Of a run's group, as many as there are ranges; each run is one of its own in one step."""
        return ((run >> 32) * 0x9E3779B1 + (run & 0xFFFFFFFF)) % self.ranges if self.ranges else run

    def by_group(self, rows: DataFrame):
        return rows.groupBy(F.floor(F.col("bucket") / self.per_range).alias("range"), "grp")

class Anchors:
    """Places of anchors in texts, and the hashes of the grams there, for strings of `length` bytes."""

    def __init__(self, length: int):
        if length <= GRAM:
            raise ValueError(f"strings must be longer than {GRAM} bytes")
        self.length, self.window = length, length - GRAM + 1

    @staticmethod
    def _rolling(b: np.ndarray) -> np.ndarray:
        """A 32-bit hash of the GRAM bytes at each place, by doubling."""
        base, n = 0x9E3779B1, len(b) - GRAM + 1
        x = b.astype(np.uint32) + np.uint32(1)
        of = {1: x}
        for w in (1, 2, 4, 8):
            x = x[:-w] * np.uint32(pow(base, w, 2**32)) + x[w:]
            of[2 * w] = x
        x = of[16][:n] * np.uint32(pow(base, 4, 2**32)) + of[4][16 : 16 + n]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(12)
        x *= np.uint32(0x297A2D39)
        x ^= x >> np.uint32(15)
        return x

    def _slide(self, x: np.ndarray, of) -> np.ndarray:
        """min or max over each `window` neighbours."""
        w = 1
        while 2 * w <= self.window:
            x = of(x[:-w], x[w:])
            w *= 2
        return of(x[: len(x) - (self.window - w)], x[self.window - w :]) if w < self.window else x

    def places(self, b: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Anchors in texts that lie one after another in b, beginning at starts. All ties are anchors."""
        x = self._rolling(b)
        crossing = np.zeros(len(x), bool)
        for s in starts[1:]:
            crossing[max(0, s - GRAM + 1) : s] = True
        x[crossing] = 2**32 - 1
        least = self._slide(x, np.minimum)
        edge = np.zeros(self.window - 1, np.uint32)
        greatest = self._slide(np.concatenate([edge, least, edge]), np.maximum)
        return np.flatnonzero((x == greatest) & ~crossing)

    @staticmethod
    def hashes(b: np.ndarray, places: np.ndarray) -> np.ndarray:
        """HASH_BITS bits for the gram at each place."""
        gram = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(b, GRAM)[places])
        u, v = gram[:, :16].copy().view(np.uint64), gram[:, 16:].copy().view(np.uint32)[:, 0].astype(np.uint64)
        h = u[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ (u[:, 1] + np.uint64(0x7F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= v * np.uint64(0x165667B19E3779F9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        return h >> np.uint64(64 - HASH_BITS)

    def of_texts(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(bytes, starts, text, place in bytes, hash) of the anchors, for a chunk of the texts at a time; starts has
        an end too."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (size < CHUNK_BYTES or end == at):
                size += len(texts[end])
                end += 1
            b = np.frombuffer(b"".join(texts[at:end]), np.uint8)
            starts = np.concatenate([[0], np.cumsum([len(t) for t in texts[at:end]])])
            if len(b) >= self.length:
                places = self.places(b, starts[:-1])
                yield b, starts, at + np.searchsorted(starts, places, side="right") - 1, places, self.hashes(b, places), at
            at = end


def _runs(batches: Iterator[pa.RecordBatch], columns: int, run_bytes: int) -> Iterator[tuple[int, list[list]]]:
    """Rows of a task in runs of about run_bytes of text (the second column), each with a number of its own."""
    task, n, size, out = TaskContext.get().partitionId(), 0, 0, [[] for _ in range(columns)]
    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(columns)), strict=True):
            text = row[1].encode()
            for to, value in zip(out, (row[0], text, *row[2:]), strict=True):
                to.append(value)
            size += len(text)
            if size >= run_bytes:
                yield task << 32 | n, out
                n, size, out = n + 1, 0, [[] for _ in range(columns)]
    if out[0]:
        yield task << 32 | n, out


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=NAMES)


NAMES = ["bucket", "grp", "run", "kind", "a", "b", "c"]


def _ends(first: np.ndarray, n: int) -> np.ndarray:
    """Where slices of n values end that begin at first."""
    return np.append(first[1:], n) if len(first) else first


def _slices(own: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, first, last) of the stretches of equal values."""
    first = np.flatnonzero(np.diff(own, prepend=-1))
    for a, b in zip(first.tolist(), _ends(first, len(own)).tolist(), strict=True):
        yield int(own[a]), a, b


def _by_run(runs: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(run, its part of each column)."""
    order = np.argsort(runs, kind="stable")
    for run, a, b in _slices(runs[order]):
        yield run, *(c[order[a:b]] for c in columns)


TABLE, PART, HOT = 0, 1, 2


def _shared_anchors(docs: DataFrame, anchors: Anchors, x: Exchange) -> DataFrame:
    """doc_id, grams: the hashes of each document's anchors that another document has too."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, (ids, texts) in _runs(batches, 2, x.run_bytes):
            found = [(h, t) for _, _, t, _, h, _ in anchors.of_texts(texts)]
            h = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.uint64)
            t = np.concatenate([f[1] for f in found]).astype(np.uint32) if found else np.zeros(0, np.uint32)
            order = np.lexsort((t, h))
            h, t = h[order], t[order]
            fresh = np.ones(len(h), bool)
            fresh[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
            h, t = h[fresh], t[fresh]  # a document has each once
            first = np.flatnonzero(np.diff(h, prepend=h[:1] + np.uint64(1))) if len(h) else np.zeros(0, np.int64)
            many = np.diff(np.append(first, len(h))) > 1
            known = np.repeat(many, np.diff(np.append(first, len(h))))
            out = [(run % x.buckets, x.group(run), run, TABLE, packed(np.array(ids, np.int64)), packed(h[known]), packed(t[known]))]
            h, t = h[first], np.where(many, np.uint32(2**32 - 1), t[first])  # of several documents none needs an answer
            out += [(k, x.group(run), run, PART, _rising(h[a:b]), packed(t[a:b]), None) for k, a, b in _slices(x.first(h))]
            yield _rows(out)

    def parts(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, text and run of all that a frame has."""
        rows = list(frame[frame["kind"] == PART].itertuples())
        h = [np.cumsum(unpacked(r.a, "u8"), dtype=np.uint64) for r in rows]
        runs = [np.full(len(y), r.run) if r.c is None else unpacked(r.c, "i8") for r, y in zip(rows, h, strict=True)]
        none = [np.zeros(0, np.uint64)]
        return np.concatenate(h + none), np.concatenate([unpacked(r.b, "u4") for r in rows] + none).astype(np.uint32), np.concatenate(runs + none).astype(np.int64)

    def combine(frame: pd.DataFrame) -> pd.DataFrame:
        """What a group of runs sends to each bucket of a range."""
        out, grp = list(frame[frame["kind"] == TABLE][NAMES].itertuples(index=False, name=None)), int(frame["grp"].iloc[0])
        h, t, runs = parts(frame)
        order = np.argsort(h, kind="stable")
        h, t, runs = h[order], t[order], runs[order]
        out += [(k, grp, -1, PART, _rising(h[a:b]), packed(t[a:b]), packed(runs[a:b])) for k, a, b in _slices(x.bucket(h))]
        return pd.DataFrame(out, columns=NAMES)

    def match(frame: pd.DataFrame) -> pd.DataFrame:
        out, bucket = list(frame[frame["kind"] == TABLE][NAMES].itertuples(index=False, name=None)), int(frame["bucket"].iloc[0])
        h, t, runs = parts(frame)
        order = np.argsort(h, kind="stable")
        s, twice = h[order], np.zeros(len(h), bool)
        same = s[1:] == s[:-1]  # a run sends each hash once, so equal ones come from two
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        keep = twice & (t != 2**32 - 1)
        h, t, runs = h[keep], t[keep], runs[keep]
        if x.ranges:
            own = np.array([x.group(r) for r in runs.tolist()], np.int64)
            out += [(bucket, grp, -1, PART, packed(r), packed(a), packed(b)) for grp, r, a, b in _by_run(own, runs, h, t)]
        else:
            out += [(bucket, run, run, PART, None, packed(a), packed(b)) for run, a, b in _by_run(runs, h, t)]
        return pd.DataFrame(out, columns=NAMES)

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        ids = unpacked(frame["a"][frame["kind"] == TABLE].iloc[0], "i8")
        h = np.concatenate([unpacked(y, "u8") for y in frame["b"]])
        t = np.concatenate([unpacked(y, "u4") for y in frame["c"]])
        order = np.argsort(t, kind="stable")
        h, t = h[order], t[order]
        first = np.flatnonzero(np.diff(t.astype(np.int64), prepend=-1))
        last = _ends(first, len(t))
        return pd.DataFrame({"doc_id": ids[t[first]], "grams": [h[a:b].tobytes() for a, b in zip(first, last, strict=True)]})

    sent = docs.mapInArrow(send, SENT)
    if x.ranges:
        sent = x.by_group(sent).applyInPandas(combine, SENT)
    found = sent.groupBy("bucket").applyInPandas(match, SENT)
    if x.ranges:
        found = x.by_group(found).applyInPandas(_split("u8"), SENT)
    return found.groupBy("run").applyInPandas(gather, "doc_id long, grams binary")


def _rising(h: np.ndarray) -> bytes:
    return packed(np.diff(h, prepend=np.uint64(0)))


def _split(kind: str):
    """Answers to a group of runs as answers to each; b has one value of the kind or more for each run in a."""

    def split(frame: pd.DataFrame) -> pd.DataFrame:
        out, bucket, grp = list(frame[frame["kind"] != PART][NAMES].itertuples(index=False, name=None)), int(frame["bucket"].iloc[0]), int(frame["grp"].iloc[0])
        rows = list(frame[frame["kind"] == PART].itertuples())
        if rows:
            runs, c = np.concatenate([unpacked(r.a, "i8") for r in rows]), np.concatenate([unpacked(r.c, "u4") for r in rows])
            b = np.concatenate([unpacked(r.b, kind) for r in rows]).reshape(len(runs), -1)
            out += [(bucket, grp, run, PART, None, packed(y.reshape(-1)), packed(z)) for run, y, z in _by_run(runs, b, c)]
        return pd.DataFrame(out, columns=NAMES)

    return split


class LoserTree:
    """Merges sorted runs of (key, common prefix with the key before, ...) tuples.

    A head's prefix is the one with the last key out. The head with the longer prefix is the smaller; of equal prefixes
    the keys are compared, which begin to differ beyond it, and the loser remembers where.
    """

    def __init__(self, runs: list[Iterator[tuple]], width: int):
        self.runs, self.width = runs, width
        self.heads = [next(r, None) for r in runs]
        self.prefix = [0] * len(runs)
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        self.losers = [-1] * self.size
        self.winner = self._build(1)

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size if node - self.size < len(self.runs) else -1
        return self._play(node, self._build(2 * node), self._build(2 * node + 1))

    def _play(self, node: int, a: int, b: int) -> int:
        """The smaller of the heads of runs a and b; the other stays at the node."""
        if a < 0 or self.heads[a] is None:
            a, b = b, a
        elif b >= 0 and self.heads[b] is not None:
            pa_, pb = self.prefix[a], self.prefix[b]
            if pb > pa_:
                a, b = b, a
            elif pa_ == pb:
                x, y = self.heads[a][0], self.heads[b][0]
                common = self.width - ((x ^ y).bit_length() + 7) // 8
                if y < x:
                    a, b = b, a
                self.prefix[b] = common
        self.losers[node] = b
        return a

    def __iter__(self) -> Iterator[tuple[tuple, int]]:
        """(tuple, common prefix with the key before) in order."""
        heads, prefix, losers, width = self.heads, self.prefix, self.losers, self.width
        while self.winner >= 0 and heads[self.winner] is not None:
            w = self.winner
            yield heads[w], prefix[w]
            heads[w] = new = next(self.runs[w], None)
            if new is not None:
                prefix[w] = new[1]
            node = (w + self.size) // 2
            while node:  # the way up, as _play, without calls
                b = losers[node]
                if b >= 0 and heads[b] is not None:
                    if heads[w] is None or prefix[b] > prefix[w]:
                        losers[node], w = w, b
                    elif prefix[b] == prefix[w]:
                        x, y = heads[w][0], heads[b][0]
                        common = width - ((x ^ y).bit_length() + 7) // 8
                        if y < x:
                            losers[node], w = w, b
                            prefix[losers[node]] = common
                        else:
                            prefix[b] = common
                node //= 2
            self.winner = w


def merged(streams: list[Iterator[tuple]], width: int, most: int = MERGED_RUNS) -> LoserTree:
    """A loser tree over the streams, or over trees of at most `most` of them, in as many passes as it takes."""

    def again(tree: LoserTree) -> Iterator[tuple]:
        for item, common in tree:
            yield item[0], common, *item[2:]

    while len(streams) > most:
        streams = [again(LoserTree(streams[a : a + most], width)) for a in range(0, len(streams), most)]
    return LoserTree(streams, width)


class Repeats:
    """Finds, in groups of suffixes with one gram, the windows that a smaller document has."""

    def __init__(self, length: int):
        self.length, self.left = length, length - GRAM
        self.width = length + self.left

    def masks(self, group: list[tuple]) -> list[int]:
        """For each (key, _, doc, right, left, ...) a bit d for each window that begins d bytes before the anchor."""
        docs = [g[2] for g in group]
        low = min(docs)
        if low == max(docs):
            return [0] * len(group)
        return self._many(group) if len(group) > SMALL_GROUP else [self._one(group, g) if g[2] > low else 0 for g in group]

    def _one(self, group: list[tuple], own: tuple) -> int:
        key, _, doc, right, left = own[:5]
        mask, below = 0, 8 * self.left
        for other in group:
            if other[2] < doc:
                x = key ^ other[0]
                r = min(right, other[3], self.length - ((x >> below).bit_length() + 7) // 8)
                d = min(left, other[4], self.left - ((x & ((1 << below) - 1)).bit_length() + 7) // 8)
                a = max(0, self.length - r)
                if d >= a:
                    mask |= ((1 << (d - a + 1)) - 1) << a
        return mask

    def _many(self, group: list[tuple]) -> list[int]:
        raw = np.frombuffer(b"".join(g[0].to_bytes(self.width, "big") for g in group), np.uint8).reshape(-1, self.width)
        doc, right, left = (np.array([g[i] for g in group]) for i in (2, 3, 4))
        masks = np.zeros(len(group), np.int64)
        for d in range(self.left + 1):
            rows = np.flatnonzero((left >= d) & (right >= self.length - d))
            if len(rows) < 2:
                continue
            windows = np.concatenate([raw[rows, : self.length - d], raw[rows, self.length : self.length + d]], axis=1)
            _, of = np.unique(np.ascontiguousarray(windows).view(f"V{self.length}")[:, 0], return_inverse=True)
            least = np.full(of.max() + 1, 2**63 - 1)
            np.minimum.at(least, of, doc[rows])
            masks[rows[doc[rows] > least[of]]] |= 1 << d
        return masks.tolist()

    def spans(self, mask: int, place: int) -> Iterator[tuple[int, int]]:
        while mask:
            a = (mask & -mask).bit_length() - 1
            n = ((mask >> a) + 1 & -((mask >> a) + 1)).bit_length() - 1
            yield place - (a + n - 1), place - a + self.length
            mask &= ~(((1 << n) - 1) << a)


def _front_coded(keys: np.ndarray) -> tuple[bytes, bytes]:
    """Of sorted keys (rows of bytes): prefixes shared with the row before, and the bytes beyond them."""
    differ = keys[1:] != keys[:-1]
    common = np.concatenate([[0], np.where(differ.any(1), differ.argmax(1), keys.shape[1])]).astype(np.uint8)
    return packed(common), packed(keys[np.arange(keys.shape[1]) >= common[:, None]])


RECORD = np.dtype([("doc", "i8"), ("run", "i8"), ("place", "u4"), ("text", "u4"), ("right", "u1"), ("left", "u1")])


def _decoded(row, width: int) -> Iterator[tuple]:
    """(key, common, doc, right, left, place, text, run) of a piece, keys as numbers."""
    x, common, rest = unpacked_records(row.c), unpacked(row.a, "u1"), unpacked(row.b, "u1").tobytes()
    at, last, key = 0, b"", 0
    names = ("doc", "right", "left", "place", "text", "run")
    for c, *more in zip(common.tolist(), *(x[n].tolist() for n in names), strict=True):
        end = at + width - c
        if at < end:
            last = last[:c] + rest[at:end]
            key = int.from_bytes(last, "big")
            at = end
        yield key, c, *more


def _pieces(key: np.ndarray, record: np.ndarray, own: np.ndarray, grp: int, run: int) -> Iterator[tuple]:
    """Rows for each bucket in `own` of keys in order."""
    by = np.argsort(own, kind="stable")  # a bucket's keys stay in order
    for k, a, b in _slices(own[by]):
        yield k, grp, run, PART, *_front_coded(key[by[a:b]]), packed_records(record[by[a:b]])


def _repeated_spans(docs: DataFrame, anchors: Anchors, x: Exchange, most: int) -> DataFrame:
    """doc_id, spans: where documents (doc_id, text, grams) repeat a string of a smaller document."""
    repeats, length, before = Repeats(anchors.length), anchors.length, anchors.length - GRAM
    width = before + length

    def records(ids: np.ndarray, texts: list[bytes], grams: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """hash, key bytes and RECORD of all suffixes at shared anchors."""
        out = []
        for b, starts, t, p, h, at in anchors.of_texts(texts):
            keep = np.zeros(len(h), bool)
            cuts = np.searchsorted(t, np.arange(at, at + len(starts)))
            for k in range(len(starts) - 1):
                own = slice(cuts[k], cuts[k + 1])
                keep[own] = np.isin(h[own], np.frombuffer(grams[at + k], np.uint64))
            t, p, h = t[keep], p[keep], h[keep]
            padded = np.concatenate([np.zeros(before, np.uint8), b, np.zeros(length, np.uint8)])
            around = np.lib.stride_tricks.sliding_window_view(padded, before + length)[p]
            key = np.concatenate([around[:, before:], around[:, :before][:, ::-1]], axis=1)
            record = np.zeros(len(h), RECORD)
            record["doc"], record["text"], record["place"] = ids[t], t, p - starts[t - at]
            record["right"] = np.minimum(length, starts[t - at + 1] - p)
            record["left"] = np.minimum(before, p - starts[t - at])
            spread = np.arange(before + length)
            inside = np.where(spread < length, spread < record["right"][:, None], spread - length < record["left"][:, None])
            out.append((h, np.where(inside, key, 0).astype(np.uint8), record))
        if not out:
            return np.zeros(0, np.uint64), np.zeros((0, before + length), np.uint8), np.zeros(0, RECORD)
        return tuple(np.concatenate([y[i] for y in out]) for i in range(3))

    def in_order(key: np.ndarray) -> np.ndarray:
        return np.argsort(np.ascontiguousarray(key).view(f"S{key.shape[1]}")[:, 0], kind="stable")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, (ids, texts, grams) in _runs(batches, 3, x.run_bytes):
            ids = np.array(ids, np.int64)
            h, key, record = records(ids, texts, grams)
            by = np.argsort(record["doc"], kind="stable")
            by = by[in_order(key[by])]
            h, key, record = h[by], key[by], record[by]
            equal = np.zeros(len(h), bool)
            equal[1:] = (key[1:] == key[:-1]).all(1) & (record["right"][1:] == record["right"][:-1]) & (record["left"][1:] == record["left"][:-1])
            group = np.flatnonzero(~equal)
            smallest = np.repeat(record["doc"][group], np.diff(np.append(group, len(h))))
            later = record["doc"] > smallest  # the run itself has their whole surroundings in a smaller document
            r = record[later]
            r = r[r["right"].astype(int) + r["left"] >= length]
            spans = np.stack([r["place"].astype(np.int64) - r["left"], r["place"].astype(np.int64) + r["right"]], 1).astype(np.int32)
            out = [(run % x.buckets, x.group(run), run, TABLE, packed(ids), packed(spans.reshape(-1)), packed(r["text"].astype(np.uint32)))]
            h, key, record = h[~later], key[~later], record[~later]
            record["run"] = run
            yield _rows(out + list(_pieces(key, record, x.first(h), x.group(run), run)))

    def streams(frame: pd.DataFrame) -> LoserTree:
        return merged([_decoded(r, width) for r in frame[frame["kind"] == PART].itertuples()], width, x.streams)

    def as_arrays(items: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        key = np.frombuffer(b"".join(g[0].to_bytes(width, "big") for g in items), np.uint8).reshape(-1, width)
        return key, np.array([(g[2], g[7], g[5], g[6], g[3], g[4]) for g in items], RECORD)

    def combine(frame: pd.DataFrame) -> pd.DataFrame:
        """What a group of runs sends to each bucket of a range: their suffixes in one order."""
        out, grp = list(frame[frame["kind"] == TABLE][NAMES].itertuples(index=False, name=None)), int(frame["grp"].iloc[0])
        done, some = [], []
        for item, _ in streams(frame):
            some.append(item)
            if len(some) == 10_000:
                done.append(as_arrays(some))
                some = []
        done.append(as_arrays(some))
        key, record = (np.concatenate([d[i] for d in done]) for i in (0, 1))
        own = x.bucket(anchors.hashes(key.reshape(-1), np.arange(len(key)) * width)) if len(key) else np.zeros(0, np.int64)
        return pd.DataFrame(out + list(_pieces(key, record, own, grp, -1)), columns=NAMES)

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        out, bucket = list(frame[frame["kind"] == TABLE][NAMES].itertuples(index=False, name=None)), int(frame["bucket"].iloc[0])
        answers: dict[int, tuple[list, list, list]] = {}  # by run, or by group
        hot: list[tuple] = []

        def resolve(group: list[tuple]) -> None:
            for g, mask in zip(group, repeats.masks(group), strict=True):
                if mask:
                    spans, texts, runs = answers.setdefault(x.group(g[7]), ([], [], []))
                    for a, b in repeats.spans(mask, g[5]):
                        spans += (a, b)
                        texts.append(g[6])
                        runs.append(g[7])

        group, over = [], False
        for item, common in streams(frame):
            if common < GRAM:
                if over:
                    hot += group
                elif len(group) > 1:
                    resolve(group)
                group, over = [], False
            group.append(item)
            if len(group) > most:
                hot += group
                group, over = [], True
        if over:
            hot += group
        elif len(group) > 1:
            resolve(group)
        for grp, (spans, texts, runs) in answers.items():
            run, all_runs = (-1, packed(np.array(runs, np.int64))) if x.ranges else (runs[0], None)
            out.append((bucket, grp, run, PART, all_runs, packed(np.array(spans, np.int32)), packed(np.array(texts, np.uint32))))
        for at in range(0, len(hot), 10_000):
            key, record = as_arrays(hot[at : at + 10_000])
            out.append((bucket, 0, 0, HOT, key.tobytes(), None, packed_records(record)))
        return pd.DataFrame(out, columns=NAMES)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every window around the suffixes of groups of more than `most`, as a row."""
        for b in batches:
            for a, c in zip(*(b.column(i).to_pylist() for i in range(2)), strict=True):
                key, record = np.frombuffer(a, np.uint8).reshape(-1, width), unpacked_records(c)
                for d in range(before + 1):
                    rows = np.flatnonzero((record["left"] >= d) & (record["right"] >= length - d))
                    text = np.concatenate([key[rows, length : length + d][:, ::-1], key[rows, : length - d]], axis=1)
                    columns = [pa.array([x.tobytes() for x in text], pa.binary()), pa.array(record["doc"][rows]), pa.array(record["run"][rows])]
                    columns += [pa.array(record["text"][rows].astype(np.int64)), pa.array(record["place"][rows].astype(np.int32) - d)]
                    yield pa.RecordBatch.from_arrays(columns, names=["w", "doc", "run", "text", "start"])

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        ids = unpacked(frame["a"][frame["kind"] == TABLE].iloc[0], "i8")
        spans = np.concatenate([unpacked(x, "i4") for x in frame["b"]]).reshape(-1, 2)
        t = np.concatenate([unpacked(x, "u4") for x in frame["c"]]).astype(np.int64)
        order = np.lexsort((spans[:, 0], t))
        spans, t = spans[order].astype(np.int64), t[order]
        reach = 2**32  # texts one after another, so that spans of all can be joined at once
        begin, end = spans[:, 0] + t * reach, np.maximum.accumulate(spans[:, 1] + t * reach) if len(t) else spans[:, 1]
        first = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]])) if len(t) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(t)) - 1 if len(t) else first
        joined = np.stack([begin[first] - t[first] * reach, end[last] - t[first] * reach], 1).astype(np.int32) if len(t) else spans
        owner = t[first]
        cut = np.flatnonzero(np.diff(owner, prepend=-1))
        to = _ends(cut, len(owner))
        return pd.DataFrame({"doc_id": ids[owner[cut]], "spans": [joined[a:b].tobytes() for a, b in zip(cut, to, strict=True)]})

    sent = docs.mapInArrow(send, SENT)
    if x.ranges:
        sent = x.by_group(sent).applyInPandas(combine, SENT)
    found = stored(sent.groupBy("bucket").applyInPandas(merge, SENT), "suffix-answers")
    hot = found.where(F.col("kind") == HOT).select("a", "c")
    answers = found.where(F.col("kind") != HOT)
    if x.ranges:
        answers = x.by_group(answers).applyInPandas(_split("i4"), SENT)
    answers = answers.select("run", "kind", "a", "b", "c")
    if hot.limit(1).count():
        rows = stored(hot.mapInArrow(windows, "w binary, doc long, run long, text long, start int"), "suffix-windows")
        least = stored(rows.groupBy("w").agg(F.min("doc").alias("least")).withColumnRenamed("w", "of"), "suffix-least")
        more = rows.join(least, F.col("w") == F.col("of")).where("doc > least").select("run", "text", "start")

        def answer(frame: pd.DataFrame) -> pd.DataFrame:
            start = frame["start"].to_numpy(np.int32)
            spans = np.stack([start, start + np.int32(length)], 1).reshape(-1)
            return pd.DataFrame([(int(frame["run"].iloc[0]), PART, None, packed(spans), packed(frame["text"].to_numpy(np.uint32)))], columns=["run", "kind", "a", "b", "c"])

        answers = answers.unionByName(more.groupBy("run").applyInPandas(answer, ANSWER))
    return answers.groupBy("run").applyInPandas(gather, "doc_id long, spans binary")


def packed_records(records: np.ndarray) -> bytes:
    return packed(records.view(f"V{RECORD.itemsize}").view(np.uint8).reshape(-1, RECORD.itemsize).view(f"V{RECORD.itemsize}")[:, 0])


def unpacked_records(data: bytes) -> np.ndarray:
    return unpacked(data, f"V{RECORD.itemsize}").view(RECORD)


def repeated_spans(docs: DataFrame, length: int = 50, most: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """What to remove of every row of docs (doc_id, text).

    First doc_id, n_bytes, digest (SHA-256 of the whole text), copy (the whole text occurs in a smaller document) of
    every row; second doc_id and spans, for documents that are no copies: ascending, disjoint (start, end) pairs of
    32-bit numbers that cover every byte in a string of `length` bytes that also starts in a document with a smaller
    doc_id. Groups of more than `most` suffixes with one gram and different surroundings leave the merge; their windows
    are shuffled one by one. Null texts are empty; null ids take no part; of rows that share an id and differ in their
    text, the one with the least digest takes part.
    """
    with small_batches(docs.sparkSession):
        return _repeated(docs, length, most)


def _repeated(docs: DataFrame, length: int, most: int) -> tuple[DataFrame, DataFrame]:
    anchors = Anchors(length)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = stored(plain.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("digest")), "suffix-rows")
    firsts = stored(rows.groupBy("digest").agg(F.min("doc_id").alias("first")).withColumnRenamed("digest", "of"), "suffix-firsts")
    judged = stored(
        rows.join(firsts, F.col("digest") == F.col("of")).select("doc_id", "n_bytes", "digest", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("copy")),
        "suffix-judged",
    )
    own = judged.where("not copy and doc_id is not null")
    total, n, ids = own.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.count("*"), F.count_distinct("doc_id")).first()
    taken = plain.where((F.octet_length("text") >= length) & F.col("doc_id").isNotNull())
    if n == ids:
        copies = stored(judged.where("copy").select("doc_id").distinct().join(own.select("doc_id"), "doc_id", "left_anti"), "suffix-copies")
        taken = of_ids(taken, copies, copies.count(), "left_anti")
    else:  # ids with several texts: one of them takes part
        chosen = stored(own.groupBy("doc_id").agg(F.min("digest").alias("own")).withColumnRenamed("doc_id", "id"), "suffix-chosen")
        joined = taken.withColumn("digest", F.sha2("text", 256)).join(chosen, (F.col("doc_id") == F.col("id")) & (F.col("digest") == F.col("own")))
        taken = joined.dropDuplicates(["doc_id"]).select("doc_id", "text")
    x = Exchange.of(total)
    grams = stored(_shared_anchors(taken, anchors, x), "suffix-grams")
    merged = grams.groupBy("doc_id").agg(F.first("grams").alias("grams"))
    spans = _repeated_spans(taken.join(merged.hint("merge"), "doc_id").select("doc_id", "text", "grams"), anchors, x, most)
    return judged, stored(spans, "suffix-spans")


def kept_parts(text: bytes, spans: bytes | None) -> tuple[bytes, int, int]:
    """The bytes outside the spans, how many are inside, and the number of spans."""
    pairs = np.frombuffer(spans or b"", np.int32).reshape(-1, 2).tolist()
    at, out = 0, []
    for a, b in pairs:
        out.append(text[at:a])
        at = b
    out.append(text[at:])
    return b"".join(out), sum(b - a for a, b in pairs), len(pairs)


#: The most bytes of spans that are broadcast; beyond it texts are shuffled.
BROADCAST_BYTES = 32_000_000


def with_spans(docs: DataFrame, spans: DataFrame, how: str = "left") -> DataFrame:
    """docs joined to spans by doc_id."""
    n, size = spans.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("spans")), F.lit(0))).first()
    return of_ids(docs, spans, n * 32 + size, how, BROADCAST_BYTES)


def remove_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; see repeated_spans.

    A copy of a smaller document loses all bytes, if it has `length` of them. An empty table gives no rows.
    """
    judged, spans = repeated_spans(docs, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts = [t.encode() for t in b.column(1).to_pylist()]
            found = [kept_parts(t, s) for t, s in zip(texts, b.column(2).to_pylist(), strict=True)]
            shas = [hashlib.sha256(t).hexdigest() for t in texts]
            columns = [b.column(0), pa.array(shas), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([hashlib.sha256(x[0]).hexdigest() for x in found])], names=["id", "own", "removed", "runs", "sha"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    cut = with_spans(plain, spans, "inner").select("doc_id", "text", "spans").mapInArrow(run, "id long, own string, removed long, runs long, sha string")
    cut = cut.dropDuplicates(["id", "own"])
    whole = F.col("copy") & (F.col("n_bytes") >= length)
    empty = hashlib.sha256(b"").hexdigest()
    return judged.join(cut, (F.col("doc_id") == F.col("id")) & (F.col("digest") == F.col("own")) & ~F.col("copy"), "left").select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("runs", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(empty)).otherwise(F.coalesce("sha", "digest")).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """The rows of docs, with all their columns, less what remove_repeats removes from their texts.

    A character that loses a part of its bytes goes as a whole. A document that keeps no word, and had some, goes. A
    column n_chars gets the new length; a null text stays null.
    """
    judged, spans = repeated_spans(docs, length)
    empty = stored(judged.where(F.col("copy") & (F.col("n_bytes") >= length)).select("doc_id").distinct(), "suffix-empty")
    rows = of_ids(docs, empty, empty.count(), "left_anti").select(*docs.columns)
    joined = with_spans(rows.withColumnRenamed("spans", "__own"), spans)
    joined = joined.select(*("__own" if c == "spans" else c for c in docs.columns), F.col("spans").alias("__spans"))
    names = docs.columns
    at, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            *columns, cuts = b.columns
            texts, keep = [], []
            for text, spans in zip(columns[at].to_pylist(), cuts.to_pylist(), strict=True):
                if text is not None and spans:
                    rest = kept_parts(text.encode(), spans)[0].decode(errors="ignore")
                    keep.append(bool(rest.split()) or not text.split())
                    text = rest
                else:
                    keep.append(True)
                texts.append(text)
            if chars is not None:
                old = columns[chars]
                columns[chars] = pa.array([None if c is None else len(t) if s else c for c, t, s in zip(old.to_pylist(), texts, cuts.to_pylist(), strict=True)], old.type)
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, docs.schema)
