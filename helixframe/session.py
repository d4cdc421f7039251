"""Session helpers shared by all layers: tables, the shared folder, lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which every executor can reach.

    Only where a local session, as in tests, names none a temporary folder is set; on a cluster that is an error, since
    executors would not share it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="helixframe-")
    atexit.register(shutil.rmtree, own, True)
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


#: What scratch() is to delete, the innermost one last; and all that is left, to be deleted when the process ends.
_SCRATCH: list[list[str]] = []
_LEFT: dict[str, SparkSession] = {}


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, in the end, the tables that were stored within it, but for lasting ones."""
    paths: list[str] = []
    _SCRATCH.append(paths)
    try:
        yield
    finally:
        _SCRATCH.remove(paths)
        for path in paths:
            discard(spark, path)


def _discard_left() -> None:
    while _LEFT and SparkContext._active_spark_context is not None:
        path, spark = _LEFT.popitem()
        try:
            discard(spark, path)
        except (Py4JError, OSError):  # the JVM has ended before
            return


atexit.register(_discard_left)


def stored_path(spark: SparkSession, name: str, lasting: bool = False) -> str:
    """A new folder in the shared one. Unless it is lasting, it goes with the scratch() around it, or with the process."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not lasting:
        _LEFT[path] = spark
        if _SCRATCH:
            _SCRATCH[-1].append(path)
    return path


def stored(df: DataFrame, name: str, *partition_by: str, lasting: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = stored_path(spark, name, lasting)
    writer = df.write.partitionBy(*partition_by).option("compression", "zstd")
    writer.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)  # nobody else waits for it
    return spark.read.schema(df.schema).parquet(path)


#: Up to so many rows one task can take all rows of a key.
SMALL = 1_000_000


def stored_if_large(df: DataFrame, rows: int, name: str) -> DataFrame:
    """df, as a table if it is made from more than SMALL rows: a join with a table that is read can split a key with very
    many rows, one with an aggregate that stands in the same stage can't."""
    return stored(df, name) if rows > SMALL else df


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of stored() that nothing reads any more."""
    _LEFT.pop(path, None)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
