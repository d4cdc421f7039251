"""Best-fit packing of documents into sequences of several permitted lengths.

Pieces are dealt to groups at random, each group large enough that packing it alone wastes next to nothing. Within a
group pieces go, longest first, to the fullest open bin that takes them. Where none does, a bin is opened of that
permitted size which costs least per unit that the pieces still to come can fill it with: for each size the longest ones
that fit are put in on trial. A sequence of c units costs c, a fixed overhead, and c * c / `square` for what grows with
the square of its length, as attention does; so short sequences are cheaper, as long as they can be filled. When all
pieces are placed, each bin is cut down to the smallest permitted size that holds its contents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.session import stored


def cost_of(capacity: int, overhead: float, square: float) -> float:
    return capacity + overhead + capacity * capacity / square


class Waiting:
    """The lengths of the pieces still to come, longest first out."""

    def __init__(self, lengths: np.ndarray):
        values, counts = np.unique(lengths, return_counts=True)
        self.count = dict(zip(values.tolist(), counts.tolist(), strict=True))
        self.bits = sum(1 << n for n in self.count)  # a bit for each length there is

    def take(self, n: int) -> None:
        self.count[n] -= 1
        if not self.count[n]:
            self.bits ^= 1 << n

    def fill(self, space: int) -> int:
        """How many units of a space the longest pieces that fit, one after another, would take."""
        left, limit = space, space
        while left and (fitting := self.bits & ((1 << min(limit, left) + 1) - 1)):
            n = fitting.bit_length() - 1
            left -= n * min(self.count[n], left // n)
            limit = n - 1
        return space - left


def best_fit(lengths: np.ndarray, capacities: tuple[int, ...], overhead: float, square: float = float("inf")) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """bin, offset in the bin, and the bin's final capacity, of every length. Lengths must be 1 to max(capacities)."""
    sizes = sorted(capacities)
    cost = {c: cost_of(c, overhead, square) for c in sizes}
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: dict[int, list[int]] = {}  # bins by their free space; spaces has a bit for each key that has bins
    spaces, used, waiting = 0, [], Waiting(lengths)
    for i in order:
        n = int(lengths[i])
        waiting.take(n)
        fitting = spaces >> n
        if fitting:
            space = n + (fitting & -fitting).bit_length() - 1
            b = free[space].pop()
            if not free[space]:
                spaces ^= 1 << space
        else:
            space = min((c for c in sizes if c >= n), key=lambda c: (cost[c] / (n + waiting.fill(c - n)), c))
            b = len(used)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += n
        space -= n
        if space:
            free.setdefault(space, []).append(b)
            spaces |= 1 << space
    final = np.array(sizes)[np.searchsorted(sizes, used)] if used else np.zeros(0, np.int64)
    return bins, offsets, final[bins] if used else final


def pack(
    docs: DataFrame,
    length: Column | None = None,
    capacities: tuple[int, ...] = (2048, 4096, 8192, 16384),
    overhead: int = 16,
    square: float = 65_536,
    group_units: int = 16_000_000,
    group_rows: int = 100_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, piece, start, length, bin_id, bin_capacity, bin_offset: every unit of every document in one place.

    `length` gives a document's units, UTF-8 bytes of its text (the tokens of a byte-level vocabulary) unless another
    is passed, such as token counts. Documents longer than the largest capacity are cut into pieces of that size; start
    is where a piece begins in its document. A bin of c units costs c + overhead + c * c / square. Pieces are dealt by
    chance, equal rows too, to groups of about group_units units and group_rows pieces at most. A text that is null or
    empty has one piece of length 0 without a bin. Repeated rows are packed each; null ids are kept; an empty table gives
    no rows.
    """
    largest = max(capacities)
    units = F.coalesce(F.octet_length(text_col) if length is None else length, F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), units.alias("units"))
    pieces = stored(  # with a number for each row, so that a task that is run again deals its pieces out as before
        rows.withColumn("row", F.monotonically_increasing_id())
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("units") - 1) / largest)).cast("int"))))
        .withColumn("start", F.col("piece").cast("long") * largest)
        .withColumn("length", F.least(F.lit(largest).cast("long"), F.col("units") - F.col("start")))
        .drop("units"),
        "packing-pieces",
    )
    total, n = pieces.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count_if(F.col("length") > 0)).first()
    groups = max(1, -(-total // group_units), -(-n // group_rows))
    pieces = pieces.withColumn("grp", F.pmod(F.xxhash64("row", "piece"), F.lit(groups)))

    def run(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = pd.concat(frames, ignore_index=True).sort_values(["length", "doc_id", "row", "piece"], ascending=[False, True, True, True], ignore_index=True)
        bins, offsets, capacity = best_fit(frame["length"].to_numpy(), capacities, overhead, square)
        frame["bin_id"] = int(key[0]) * 2**32 + bins
        frame["bin_capacity"], frame["bin_offset"] = capacity, offsets
        yield frame.drop(columns=["grp", "row"])

    kind = pieces.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, bin_id long, bin_capacity int, bin_offset long"
    whole = pieces.where("length > 0").groupBy("grp").applyInPandas(run, schema)
    empty = pieces.where("length = 0").selectExpr("doc_id", "piece", "start", "length", "cast(null as long) as bin_id", "cast(null as int) as bin_capacity", "cast(null as long) as bin_offset")
    return whole.unionByName(empty)
