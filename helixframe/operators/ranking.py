"""Consecutive numbers in an order, without bringing all rows to one task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixframe.session import stored


def numbered(df: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """df with the place of each row, from 0, in that order: rows are dealt out by range and numbered in each task,
    after the counts of the tasks before it."""
    placed = df.repartitionByRange(*order).withColumn("__task", F.spark_partition_id())
    placed = stored(placed, "numbered")
    counts = {r["__task"]: r["n"] for r in placed.groupBy("__task").agg(F.count("*").alias("n")).collect()}
    tasks = sorted(counts)
    first = dict(zip(tasks, accumulate((counts[t] for t in tasks), initial=0), strict=False))
    starts = df.sparkSession.createDataFrame([(t, first[t]) for t in tasks], "__task int, __first long")
    own = F.row_number().over(Window.partitionBy("__task").orderBy(*order)) - 1
    return placed.withColumn("__own", own).join(F.broadcast(starts), "__task").withColumn(name, F.col("__first") + F.col("__own")).drop("__task", "__first", "__own")
