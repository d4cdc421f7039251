"""What several operators need: choosing documents by id, and compact arrays in binary columns."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The most ids that are broadcast to choose texts by; beyond it texts are shuffled.
BROADCAST_IDS = 200_000


def of_ids(docs: DataFrame, ids: DataFrame, count: int, how: str = "inner", most: int = BROADCAST_IDS) -> DataFrame:
    """docs joined by doc_id to ids, which has `count` rows."""
    return docs.join(F.broadcast(ids) if count <= most else ids.hint("merge"), "doc_id", how)


def packed(values: np.ndarray) -> bytes:
    """The array's bytes, first all first bytes, then all second bytes, and so on, compressed."""
    a = np.ascontiguousarray(values)
    return zstandard.compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes(), 1)


def unpacked(data: bytes, dtype: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype)[:, 0] if len(raw) else np.zeros(0, dtype)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """Until the end, Python workers get `rows` rows at a time at most: whole texts can be long. The session's own
    setting holds again afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches, some rows at a time, so that few texts are Python's at once; Spark bounds a batch by its bytes."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 10_000) -> Iterator[pa.Table]:
    """The batches, without empty ones, in tables of `rows` rows or more, but for the last."""
    some: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            some.append(b)
        if sum(x.num_rows for x in some) >= rows:
            yield pa.Table.from_batches(some).combine_chunks()
            some = []
    if some:
        yield pa.Table.from_batches(some).combine_chunks()
