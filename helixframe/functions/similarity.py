"""Comparisons of short sequences that no built-in function expresses, in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_BUBBLE_LENGTH, MAX_BUBBLE_GAPS, MAX_BUBBLE_DIVERGENCE = 200, 3, 0.2


def common_subsequence(a: str, b: str) -> int:
    """The length of the longest common subsequence."""
    x, y = np.frombuffer(a.encode(), np.uint8), np.frombuffer(b.encode(), np.uint8)
    row = np.zeros(len(y) + 1, np.int32)
    for c in x:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (y == c)))
    return int(row[-1])


def similar(a: str | None, b: str | None) -> bool:
    """At most 200 bases each, and at most 3 and a fifth of the longer one outside the common subsequence."""
    if a is None or b is None or max(len(a), len(b)) > MAX_BUBBLE_LENGTH or not a or not b:
        return False
    longer, common = max(len(a), len(b)), common_subsequence(a, b)
    return common >= longer - MAX_BUBBLE_GAPS and 1 - common / longer <= MAX_BUBBLE_DIVERGENCE


def _all_similar(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similar(x, y) for x, y in zip(a, b, strict=True)])


def sequences_similar(a: Column, b: Column) -> Column:
    return F.pandas_udf(_all_similar, "boolean")(a, b)


def run_distance(a: str, b: str) -> int:
    """How far apart two k-mers are: the least cost over their common runs, k without one.

    A run of n bases that ends at i in a and at j in b costs the k - n bases outside it and two offsets: the one in a is
    i, or k - i - n if that is smaller and not negative; the one in b is j if the second was taken, else k - j - n.
    """
    k = best = len(a)
    run = [0] * (k + 1)
    for i in range(k):
        above, run = run, [0] * (k + 1)
        for j in range(k):
            if a[i] == b[j]:
                n = run[j + 1] = above[j] + 1
                rest = k - i - n
                own = min(i, rest) if rest >= 0 else i
                cost = own + k - n + (j if own < i else k - j - n)
                best = min(best, cost) if cost >= 0 else best
    return best


def _all_distances(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([run_distance(x, y) for x, y in zip(a, b, strict=True)])


def kmer_distance(a: Column, b: Column) -> Column:
    return F.pandas_udf(_all_distances, "int")(a, b)
