"""Sharding by sampled splitters, with DataFrame functions only.

Records are ordered by (key, doc_id, row), the key being 60 bits of the text's MD5, so equal texts are neighbours, and
row a number of their own, so that no two are equal. A size-weighted sample of that order gives quantile boundaries; records are range-partitioned by them, and ranges that
turn out overfull are sampled again and subdivided. The exact sizes of all ranges, summed up in order, then place each
record by its offset in the whole order, so the shards do not depend on which keys were drawn.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixframe.session import stored

LAST = 2**63 - 1
FIRST = -(2**63)


def _uniform(*cols: str, salt: int) -> Column:
    """A repeatable number in [0, 1) for each row."""
    return F.shiftrightunsigned(F.xxhash64(*cols, F.lit(salt)), 11) / F.lit(float(2**53))


def _range_of(splitters: list[tuple[int, int, int]]) -> Column:
    """How many splitters are at or before (key, order_id, row): a binary search in three literal arrays."""
    depth = max(1, len(splitters).bit_length())
    padded = splitters + [(LAST, LAST, LAST)] * (2**depth - 1 - len(splitters))
    keys, ids, rows = (F.lit([p[i] for p in padded]) for i in range(3))
    steps = F.lit([2**i for i in reversed(range(depth))])

    def step(at: Column, by: Column) -> Column:
        k, d, r = (F.get(a, at + by - 1) for a in (keys, ids, rows))
        same = (k == F.col("key")) & ((d < F.col("order_id")) | ((d == F.col("order_id")) & (r <= F.col("row"))))
        return F.when((k < F.col("key")) | same, at + by).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def _quantiles(sample: list, ranges: int) -> list[tuple[int, int, int]]:
    """The boundaries of about equal weight in a sample of rows (key, order_id, row, weight)."""
    rows = sorted((r["key"], r["order_id"], r["row"], r["weight"]) for r in sample)
    target, found, done = sum(r[3] for r in rows) / max(1, ranges), [], 0
    for *at, w in rows:
        if done // target != (done + w) // target and done:
            found.append(tuple(at))
        done += w
    return sorted(set(found))


def shard_by_splitters(
    docs: DataFrame,
    shards: int = 40,
    id_col: str = "doc_id",
    text_col: str = "text",
    group_tolerance: float = 0.02,
    rows_per_range: int = 100_000,
    max_ranges: int = 16_384,
    sample_per_range: int = 32,
) -> DataFrame:
    """Put every row into one of `shards` shards of near equal bytes (law `bytes`).

    size is the text's UTF-8 bytes plus 16. A group of equal texts stays in one shard unless it holds more than
    group_tolerance of a shard's share; larger groups are subdivided by id. Sizes differ from the mean by that
    tolerance and one record at most. slot numbers a shard's rows from 0 without gaps, in the order of (key, id, row).

    Driver memory is bounded by about max_ranges * sample_per_range sampled keys at a time; the sample only draws
    boundaries, all rows are counted and placed. A null text counts as empty; a null id sorts first; repeated rows each get a slot of their
    own; an empty table gives no rows. Other columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text).cast("long") + 16).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long").alias("key"),
            F.coalesce(F.col(id_col).cast("long"), F.lit(FIRST)).alias("order_id"),
            F.monotonically_increasing_id().alias("row"),  # stays as it is, since it is stored
        ),
        "shard-base",
    )
    total, rows = base.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    if not rows:
        return base.select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"),
            F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    ranges = min(max_ranges, max(16 * shards, rows // rows_per_range))
    per_key = total / (ranges * sample_per_range)
    sample = (
        base.where(_uniform("row", "key", salt=1) * per_key < F.col("size"))
        .select("key", "order_id", "row", F.greatest(F.col("size").cast("double"), F.lit(per_key)).alias("weight"))
        .collect()
    )
    splitters = _quantiles(sample, ranges)
    for again in range(2, 5):  # subdivide overfull ranges by a denser sample of their own
        full = (
            base.withColumn("range", _range_of(splitters))
            .groupBy("range")
            .agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
            .where((F.col("bytes") > 2 * total / ranges) & (F.col("rows") > 1))
            .select("range", "bytes")
        )
        over = {r["range"]: r["bytes"] for r in full.collect()}
        if not over:
            break
        each = sum(over.values()) / (ranges * sample_per_range)  # as many sampled keys as at first, now of these ranges alone
        more = (
            base.withColumn("range", _range_of(splitters))
            .where(F.col("range").isin(*over))
            .where(_uniform("row", "key", salt=again) * each < F.col("size"))
            .select("range", "key", "order_id", "row", F.greatest(F.col("size").cast("double"), F.lit(each)).alias("weight"))
        )
        drawn: dict[int, list] = {}
        for r in more.collect():
            drawn.setdefault(r["range"], []).append(r)
        for k, b in over.items():
            splitters += _quantiles(drawn.get(k, []), int(2 * b * ranges / total))
        splitters = sorted(set(splitters))

    tolerance = group_tolerance * total / shards
    cut = spark.createDataFrame([(k,) for k in {k for k, *_ in splitters}], "key long")
    large = {
        r["key"]
        for r in base.join(F.broadcast(cut), "key", "left_semi")
        .groupBy("key")
        .agg(F.sum("size").alias("bytes"))
        .where(F.col("bytes") > tolerance)
        .collect()
    }
    splitters = sorted({p if p[0] in large else (p[0], FIRST, FIRST) for p in splitters})

    order = Window.partitionBy("range").orderBy("key", "order_id", "row")
    group = Window.partitionBy("range", "key")
    ranged = base.withColumn("range", _range_of(splitters))
    sums = {r["range"]: r["bytes"] for r in ranged.groupBy("range").agg(F.sum("size").alias("bytes")).collect()}
    starts = list(accumulate((sums.get(k, 0) for k in range(len(splitters))), initial=0))
    large_group = (F.sum("size").over(group) > tolerance) | F.array_contains(F.lit(sorted(large) or [FIRST]), F.col("key"))
    placed = (
        ranged.withColumn("before", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("at", F.when(large_group, F.col("before")).otherwise(F.min("before").over(group)))
        .withColumn("offset", F.get(F.lit(starts), F.col("range")) + F.col("at"))
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor(F.col("offset") * shards / F.lit(total))).cast("int"))
        .withColumn("nth", F.row_number().over(Window.partitionBy("range", "shard").orderBy("key", "order_id", "row")))
        .select("doc_id", "size", "text_crc32", "range", "shard", "nth")
    )
    placed = stored(placed, "shard-placed")
    counts = placed.groupBy("shard", "range").agg(F.count("*").alias("n")).collect()
    done: dict[int, int] = {}
    slots = []
    for r in sorted(counts, key=lambda r: (r["shard"], r["range"])):
        slots.append((r["shard"], r["range"], done.get(r["shard"], 0)))
        done[r["shard"]] = done.get(r["shard"], 0) + r["n"]
    offsets = spark.createDataFrame(slots, "shard int, range int, first long")  # one row a range, and one more a shard
    return placed.join(F.broadcast(offsets), ["shard", "range"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("first") + F.col("nth") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
