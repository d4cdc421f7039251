"""Text formats of graphs and contigs, and tables of super-k-mers and components."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators.ranking import numbered


def _shortest(x: pd.Series) -> pd.Series:
    return x.map(lambda v: f"{v:g}", na_action="ignore")


def shortest(x: Column) -> Column:
    """Numbers with six significant digits and no trailing zeros, as C prints them by %g."""
    return F.pandas_udf(_shortest, "string")(x)


def contig_lines(unitigs: DataFrame) -> DataFrame:
    """number (from 1), node (the NODE line), seq of each unitig, in the order of its sequence."""
    rows = numbered(unitigs, "seq")
    node = F.concat_ws("\t", F.lit("NODE"), (F.col("number") + 1).cast("string"), F.col("n_kmers").cast("string"), F.lit("0"), shortest(F.col("coverage")))
    return rows.select((F.col("number") + 1).alias("number"), node.alias("node"), "seq")


def write_pregraph(unitigs: DataFrame, path: str, k: int, reads: int, direct: bool = True) -> None:
    """A header and two lines for each node, in one folder whose files follow one another in name order.

    direct: node count in hexadecimal, reads, 0, k and 1; else node count in decimal, reads, k and 1.
    """
    lines = contig_lines(unitigs)
    count = lines.count()
    head = f"0x{count:08x}\t{reads}\t0\t{k}\t1" if direct else f"{count}\t{reads}\t{k}\t1"
    body = lines.select("number", F.concat_ws("\n", "node", "seq").alias("value"))
    header = unitigs.sparkSession.createDataFrame([(0, head)], "number long, value string")
    header.unionByName(body).repartitionByRange("number").sortWithinPartitions("number").select("value").write.text(path)


def read_pregraph(spark: SparkSession, path: str) -> tuple[dict[str, int], DataFrame]:
    """The header's numbers, and node_id, n_kmers, coverage, seq of each node."""
    records = spark.read.option("lineSep", "NODE\t").text(path)
    head = [int(x, 0) for x in records.where(F.col("value").rlike(r"^\s*(0x)?[0-9a-fA-F]+\t")).where(~F.col("value").rlike("[ACGT]{2}")).first()["value"].split()]
    names = ("nodes", "reads", "category", "k", "strands") if len(head) == 5 else ("nodes", "reads", "k", "strands")[: len(head)]
    fields = F.split(F.split("value", "\n")[0], "\t")
    nodes = records.where(F.col("value").rlike("\n[ACGT]+")).where(F.size(fields) >= 4)
    return dict(zip(names, head, strict=False)), nodes.select(
        fields[0].cast("long").alias("node_id"), fields[1].cast("int").alias("n_kmers"), fields[3].cast("double").alias("coverage"), F.split("value", "\n")[1].alias("seq")
    )


def write_contigs(unitigs: DataFrame, path: str) -> None:
    """FASTA with headers >NOD_<number>_<k-mers>_0_<coverage>."""
    name = F.concat(F.lit(">NOD_"), F.regexp_replace(F.substring("node", 6, 2**30), "\t", "_"))
    contig_lines(unitigs).orderBy("number").select(F.concat_ws("\n", name, "seq").alias("value")).write.text(path)


def write_plain_pregraph(unitigs: DataFrame, path: str) -> None:
    """Nodes without the two coverage columns, for tools that expect number and length only."""
    node = F.array_join(F.slice(F.split("node", "\t"), 1, 3), "\t")
    contig_lines(unitigs).orderBy("number").select(F.concat_ws("\n", node, "seq").alias("value")).write.text(path)


def coverage_database(unitigs: DataFrame) -> DataFrame:
    return unitigs.select("n_kmers", "coverage")


def write_coverage_database(unitigs: DataFrame, path: str) -> None:
    coverage_database(unitigs).write.option("sep", "\t").csv(path)


def write_sequences(reads: DataFrame, path: str, width: int = 60) -> None:
    """Reads with header, number and category, `width` bases a line."""
    rows = numbered(reads, "read_id")
    header = F.coalesce("header", F.lit("")) if "header" in reads.columns else F.col("read_id").cast("string")
    kind = F.col("category").cast("string") if "category" in reads.columns else F.lit("0")
    head = F.concat_ws("\t", F.concat(F.lit(">"), header), (F.col("number") + 1).cast("string"), kind)
    body = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    rows.select(F.concat_ws("\n", head, body).alias("value")).write.text(path)


def dot_lines(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """value: a Graphviz record for each node, an edge with its weight for each arc."""
    node = nodes.select(F.concat(F.lit('  "'), F.col("id"), F.lit('" [shape=record, label="<L> | '), F.col("seq"), F.lit(' | <R>"];')).alias("value"))
    edge = arcs.where("src <= dst").select(F.format_string('  "%s":%s -- "%s":%s [label="%d"];', "src", "side", "dst", "dst_side", "weight").alias("value"))
    return node.unionByName(edge)


def write_dot(nodes: DataFrame, arcs: DataFrame, path: str) -> None:
    spark = nodes.sparkSession
    first, last = (spark.createDataFrame([(x,)], "value string") for x in ("graph g {", "}"))
    lines = first.withColumn("at", F.lit(0)).unionByName(dot_lines(nodes, arcs).withColumn("at", F.lit(1))).unionByName(last.withColumn("at", F.lit(2)))
    lines.repartitionByRange("at").sortWithinPartitions("at").select("value").write.text(path)


def scoop(arcs: DataFrame, root: str, most: int) -> DataFrame:
    """id, depth: the `most` nodes nearest to a root; of the same distance those of the least id."""
    spark = arcs.sparkSession
    found = {root: 0}
    edge, depth = [root], 0
    while edge and len(found) < most:  # `most` bounds what is held here
        depth += 1
        near = arcs.where(F.col("src").isin(edge)).select(F.col("dst").alias("id")).distinct().orderBy("id").limit(most + len(found)).collect()
        edge = [r["id"] for r in near if r["id"] not in found][: most - len(found)]
        found |= {i: depth for i in edge}
    return spark.createDataFrame(sorted(found.items()), "id string, depth int")


def metis_lines(edges: DataFrame) -> DataFrame:
    """number (the header is 0), value: vertices and edges, then the neighbours, from 1, of each vertex."""
    lists = edges.groupBy("vid").agg(F.array_join(F.transform(F.sort_array(F.collect_set("to")), lambda x: (x + 1).cast("string")), " ").alias("value"))
    head = edges.agg(F.count_distinct("vid").alias("v"), (F.count("*") / 2).cast("long").alias("e"))
    return head.select(F.lit(0).cast("long").alias("number"), F.concat_ws(" ", F.col("v").cast("string"), F.col("e").cast("string")).alias("value")).unionByName(
        lists.select((F.col("vid") + 1).alias("number"), "value")
    )


def write_metis(edges: DataFrame, path: str) -> None:
    metis_lines(edges).repartitionByRange("number").sortWithinPartitions("number").select("value").write.text(path)


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """vid, part: the partition on each line of one text file, in order; blank lines count but give no row."""
    lines = spark.read.text(path).select(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.trim("value").alias("line"))
    return numbered(lines, "block", "at").where("line != ''").select(F.col("number").alias("vid"), F.col("line").cast("int").alias("part"))


def write_super_kmers(pieces: DataFrame, path: str) -> None:
    """Super-k-mers as Parquet, a folder for each colour."""
    pieces.write.partitionBy("color").parquet(path)


def read_super_kmers(spark: SparkSession, path: str, color: int | None = None) -> DataFrame:
    found = spark.read.parquet(path)
    return found if color is None else found.where(F.col("color") == color)


def write_graph(nodes: DataFrame, arcs: DataFrame, path: str) -> None:
    nodes.write.parquet(f"{path}/nodes")
    arcs.write.parquet(f"{path}/arcs")


def read_graph(spark: SparkSession, path: str, k: int):
    from helixframe.operators.kmers import Graph

    return Graph(k, spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/arcs"))


def write_components(members: DataFrame, path: str) -> None:
    """Nodes with component and target as Parquet, a folder for each target."""
    members.write.partitionBy("target").parquet(path)


def read_components(spark: SparkSession, path: str, target: str | None = None) -> DataFrame:
    """The nodes that write_components wrote, of one target or of all."""
    found = spark.read.parquet(path)
    return found if target is None else found.where(F.col("target") == target)
