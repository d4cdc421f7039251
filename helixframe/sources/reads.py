"""Reads: FASTA and other text files, and read sets derived from the driver's tables.

A read set has read_id and seq; sample, where present, keeps the graphs of several read sets in one table apart. Counts
and graphs need no read_id; n, where present, is how many reads a row stands for.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import kmer as K
from helixframe.session import table

CATEGORIES = ("short", "shortPaired", "long", "longPaired")


def category(name: str) -> int:
    """The number of a read category: short 0, shortPaired 1, then each further pair of libraries, long 4, longPaired 5."""
    m = re.fullmatch(r"(short|shortPaired|long|longPaired)(\d*)", name)
    if not m:
        raise ValueError(f"no such read category: {name}")
    kind, number = m[1], int(m[2] or 1)
    if kind in ("long", "longPaired"):
        return 4 + (kind == "longPaired")
    return 2 * (number - 1) + (kind == "shortPaired")


def read_fasta(spark: SparkSession, path: str, category_id: int = 0) -> DataFrame:
    """read_id, header, seq, category of each FASTA record of a file, or of the files in a folder.

    Headers may be empty, sequences may span lines, blank lines and carriage returns are dropped; records without a
    sequence are not returned. read_id is unique, not consecutive.
    """
    records = spark.read.option("lineSep", "\n>").text(path)
    record = F.regexp_replace(F.regexp_replace("value", "\r", ""), "^>", "")
    parts = records.select(record.alias("record"))
    return (
        parts.select(
            F.monotonically_increasing_id().alias("read_id"),
            F.regexp_extract("record", r"^([^\n]*)", 1).alias("header"),
            F.regexp_replace(F.regexp_replace("record", r"^[^\n]*", ""), r"\n", "").alias("seq"),
            F.lit(category_id).alias("category"),
        )
        .where(F.length("seq") > 0)
    )


def read_tabbed(spark: SparkSession, path: str, skip: int = 4, category_id: int = 0) -> DataFrame:
    """Reads of sequencer text files: the field after `skip` tab-separated fields of each line."""
    fields = spark.read.text(path).select(F.split(F.regexp_replace("value", "\r", ""), "\t").alias("f"))
    return fields.where(F.size("f") > skip).select(
        F.monotonically_increasing_id().alias("read_id"), F.get("f", F.lit(skip)).alias("seq"), F.lit(category_id).alias("category")
    )


def read_fastq(spark: SparkSession, path: str, category_id: int = 0) -> DataFrame:
    """Reads of FASTQ files with four lines a record, gzip files included; records without a sequence are not returned.

    A record is header, sequence and a line that begins with +. Where its quality begins with @, that line is cut off as
    a piece of its own, which has no such lines and is passed over.
    """
    records = spark.read.option("lineSep", "\n@").text(path)
    lines = F.split(F.regexp_replace(F.regexp_replace("value", "\r", ""), "^@", ""), "\n")
    whole = records.select(lines.alias("l")).where((F.size("l") >= 3) & F.get("l", F.lit(2)).startswith("+") & (F.get("l", F.lit(1)) != ""))
    return whole.select(
        F.monotonically_increasing_id().alias("read_id"), F.get("l", F.lit(0)).alias("header"), F.get("l", F.lit(1)).alias("seq"), F.lit(category_id).alias("category")
    )


def document_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's whole text as a read of normalised bases; texts are shuffled only where the table has fewer parts
    than there are cores."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("read_id"), K.normalise(F.col("text")).alias("seq"))
    return docs.repartition("read_id") if docs.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism else docs


#: The genome of the synthetic reads has a base for so many rows of lineitem, LEAST at least. Base i is x * x mod P // 7
#: mod 4, where x is A * i + C mod P. Reads look their bases up in blocks of BLOCK.
ROWS_PER_BASE, LEAST, WIDTH, P, A, C = 12, 1000, 36, 2**31 - 1, 1_103_515_245, 12_345
BLOCK = 64


def _blocks(spark: SparkSession, genome: int) -> DataFrame:
    """block, bases: the genome in blocks of BLOCK bases, each with the WIDTH bases that follow it."""

    def base(i):
        x = F.pmod(F.lit(A) * (F.col("block") * BLOCK + i) + C, F.lit(P))
        return F.substring(F.lit(K.BASES), (F.floor(F.pmod(x * x, F.lit(P)) / 7) % 4 + 1).cast("int"), F.lit(1))

    bases = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(BLOCK + WIDTH - 1)), base), "")
    return spark.range(genome // BLOCK + 1).select(F.col("id").alias("block")).select("block", bases.alias("bases"))


def _windows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """l_orderkey, l_linenumber, l_partkey, l_suppkey, start, wrong: where each read begins, and its substitution or -1;
    and the length of the genome."""
    lines = table(spark, sf_dir, "lineitem")
    genome = max(LEAST, lines.count() // ROWS_PER_BASE)
    rows = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    start = F.pmod(F.col("l_orderkey") * 7919 + F.col("l_partkey") * 13, F.lit(genome - WIDTH))
    wrong = F.when(F.col("l_suppkey") % 20 == 0, F.pmod(F.col("l_partkey"), F.lit(WIDTH))).otherwise(-1)
    return rows.withColumns({"start": start, "wrong": wrong}), genome


def _sequenced(rows: DataFrame, genome: int, column: Column, name: str) -> DataFrame:
    """The column by that name, and seq: the bases from start on, that at wrong (if it is one) replaced by the next of ACGT."""
    placed = rows.select(column.alias(name), "wrong", (F.col("start") % BLOCK).cast("int").alias("at"), F.expr(f"start div {BLOCK}").alias("block"))
    cut = placed.join(_blocks(rows.sparkSession, genome), "block", "left").withColumn("right", F.substring("bases", F.col("at") + 1, F.lit(WIDTH)))
    wrong, whole = F.col("wrong").cast("int"), F.lit(WIDTH)
    part = lambda i, n: F.substring("right", i, n)
    seq = F.when(wrong < 0, F.col("right")).otherwise(F.concat(part(F.lit(1), wrong), F.translate(part(wrong + 1, F.lit(1)), K.BASES, "CGTA"), part(wrong + 2, whole)))
    return cut.select(name, F.explode(F.array(seq)).alias("seq"))  # so that filters on seq don't make it again


def lineitem_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 36-base window of a synthetic genome, which grows with the table, for each different (order, line, part,
    supplier) of lineitem, every twentieth supplier's with a substitution."""
    number = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 2**32 + F.col("l_partkey") * 2**12 + F.col("l_suppkey")
    return _sequenced(*_windows(spark, sf_dir), number, "read_id")


def lineitem_read_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq and n, how many of lineitem_reads() have it (a sequence that stands at several places has several rows):
    counted by place before sequences are made."""
    rows, genome = _windows(spark, sf_dir)
    return _sequenced(rows.groupBy("start", "wrong").agg(F.count("*").alias("n")), genome, F.col("n"), "n")


def counted(reads: DataFrame) -> DataFrame:
    """seq and n: each different sequence once, with the number of reads that have it; and sample, if reads have it."""
    keys = ["sample"] if "sample" in reads.columns else []
    return reads.groupBy(*keys, "seq").agg((F.sum("n") if "n" in reads.columns else F.count("*")).alias("n"))


def split_unknown(reads: DataFrame) -> DataFrame:
    """One read for each stretch of known bases: what the reads have, stretch (from 0), seq."""
    return reads.select(*[c for c in reads.columns if c != "seq"], F.posexplode(K.known_stretches(F.col("seq"))).alias("stretch", "seq"))


def long_enough(reads: DataFrame, k: int) -> DataFrame:
    """Only reads of more than k bases have any k-mers to give."""
    return reads.where(F.length("seq") > k)
