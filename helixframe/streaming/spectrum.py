"""Streams of reads: a running spectrum, and a graph that grows batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from helixframe.functions import kmer as K
from helixframe.operators.kmers import half_arcs, kmer_counts
from helixframe.session import discard, stored, stored_path
from helixframe.sources.reads import counted

READS = "read_id long, seq string"


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Parquet files of reads as they arrive in a folder."""
    return spark.readStream.schema(READS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def spectrum_stream(reads: DataFrame, k: int) -> DataFrame:
    """kmer, occ over all reads so far. Spark's state store keeps the counts."""
    return kmer_counts(reads, k)


class GrowingGraph:
    """Nodes and arcs as tables in a folder, to which each batch of reads is added.

    A batch writes what it adds as a table of its own; after every `every` batches all is summed up to a base. What there
    is is read from the folder each time, and a table counts once its arcs, which are written last, are complete. So a
    batch that is repeated after a failure is added once, and a new GrowingGraph on the same folder goes on where the last
    one ended. Tables that a base holds are deleted when the next base is complete. Sums are kept whole and capped when
    they are read, so the order of batches does not matter.
    """

    KEYS = {"nodes": ["kmer"], "arcs": ["src", "side", "base", "dst", "dst_side", "sense_changed"]}
    SUMS = {"nodes": "occ", "arcs": "weight"}

    def __init__(self, spark: SparkSession, k: int, path: str | None = None, every: int = 10):
        self.spark, self.k, self.every = spark, k, every
        self.path = path or stored_path(spark, "growing")

    def _complete(self) -> tuple[list[int], list[int]]:
        """The numbers of all bases and batches that are complete, ascending."""
        jvm = self.spark.sparkContext._jvm
        top = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found: dict[str, list[int]] = {"base": [], "batch": []}
        if fs.exists(top):
            for status in fs.listStatus(top):
                kind, _, number = status.getPath().getName().partition("-")
                if kind in found and fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "arcs/_SUCCESS")):
                    found[kind].append(int(number))
        return sorted(found["base"]), sorted(found["batch"])

    def _read(self, name: str) -> DataFrame | None:
        bases, batches = self._complete()
        last = bases[-1] if bases else -1
        paths = [f"{self.path}/base-{last}/{name}"] * bool(bases) + [f"{self.path}/batch-{b}/{name}" for b in batches if b > last]
        if not paths:
            return None
        total = F.sum(self.SUMS[name]).cast("long").alias(self.SUMS[name])
        return self.spark.read.parquet(*paths).groupBy(*self.KEYS[name]).agg(total)

    def _write(self, nodes: DataFrame, arcs: DataFrame, name: str) -> None:
        nodes.write.mode("overwrite").parquet(f"{self.path}/{name}/nodes")
        arcs.write.mode("overwrite").parquet(f"{self.path}/{name}/arcs")

    def add(self, reads: DataFrame, batch: int) -> None:
        bases, batches = self._complete()
        if batch in batches or (bases and batch <= bases[-1]):
            return
        reads = stored(counted(reads), "batch")  # nodes and arcs are both made from each different read once
        arcs = half_arcs(reads, self.k, max_weight=None)
        self._write(kmer_counts(reads, self.k), arcs.withColumn("weight", F.col("weight").cast("long")), f"batch-{batch}")
        for path in {p.rpartition("/")[0] for p in reads.inputFiles()}:
            discard(self.spark, path)
        if (batch + 1) % self.every == 0:
            self._write(self._read("nodes"), self._read("arcs"), f"base-{batch}")
            for name in [f"base-{n}" for n in bases[:-1]] + [f"batch-{n}" for n in batches if bases and n <= bases[-1]]:
                discard(self.spark, f"{self.path}/{name}")

    def start(self, reads: DataFrame, checkpoint: str) -> StreamingQuery:
        return reads.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).start()

    def start_available(self, reads: DataFrame, checkpoint: str) -> StreamingQuery:
        """As start, but it ends when the files that are there have been read."""
        return reads.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def nodes(self) -> DataFrame:
        return self._read("nodes")

    def arcs(self, max_weight: int = K.MAX_WEIGHT) -> DataFrame:
        return self._read("arcs").withColumn("weight", K.saturated(F.col("weight"), max_weight).cast("int"))
