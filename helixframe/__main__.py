"""python -m helixframe OUT K [options] FILE...: reads to contigs, with the reports beside them.

Writes to the new folder OUT: pregraph (text), contigs (FASTA), coverage (k-mers and coverage of each node, tabbed),
stats, histogram and median (Parquet), sequences (the number of records), command, and with --part the super-k-mers of
each partition. Files of a folder are all read; FASTA unless --format says otherwise.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import kmer as K
from helixframe.operators import distribute, partition, report
from helixframe.operators.compact import compact, unitigs
from helixframe.operators.finish import finish, min_contig_length
from helixframe.operators.kmers import half_arcs, kmer_counts, node_classes
from helixframe.functions.kmer import round_up_power
from helixframe.operators.ranking import numbered
from helixframe.plans.assemble import Options, assemble, assemble_in_parts, prepared
from helixframe.session import stored
from helixframe.sources import graphs
from helixframe.sources.reads import category, read_fasta, read_fastq, read_tabbed

READERS = {"fasta": read_fasta, "fastq": read_fastq, "tabbed": lambda spark, path, category_id: read_tabbed(spark, path, category_id=category_id)}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="helixframe", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("out")
    p.add_argument("k", type=int)
    p.add_argument("files", nargs="+")
    p.add_argument("--format", choices=sorted(READERS), default="fasta")
    p.add_argument("--category", default="short", help="short, shortPaired, short2, ..., long or longPaired")
    p.add_argument("--unknown", choices=("A", "split"), default="A", help="what other characters than bases do to a read")
    p.add_argument("--part", type=int, nargs=2, metavar=("PARTS", "M"), help="count by partitions of mini-k-mers of M bases")
    p.add_argument("--noclip", action="store_true")
    p.add_argument("--keep-cycles", action="store_true")
    p.add_argument("--bubble-removal", action="store_true")
    p.add_argument("--cov-cutoff", type=float, default=0.0)
    p.add_argument("--max-coverage", type=float, default=0.0)
    p.add_argument("--min-contig", type=int, default=0, help="least k-mers of a contig")
    p.add_argument("--stat", action="store_true", help="write the classes of the k-mer graph's nodes")
    p.add_argument("--flow", type=int, default=1, metavar="ROUNDS", help="with --part: load the partitions in so many rounds")
    p.add_argument("--pgpart", action="store_true", help="write the graph's junctions for an outside partitioner (METIS)")
    p.add_argument("--pgdist", metavar="FILE", help="the partitioner's answer: deal the graph's nodes out by it")
    p.add_argument("--pgfilter", type=int, metavar="BITS", help="with --pgdist: write each read's partitions, by a sketch of 2**BITS buckets")
    return p


def load(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    kind = category(args.category)
    parts = [READERS[args.format](spark, path, kind).select("read_id", "seq", "category", F.lit(i).alias("file_index")) for i, path in enumerate(args.files)]
    reads = parts[0]
    for part in parts[1:]:
        reads = reads.unionByName(part)
    return numbered(reads.withColumnRenamed("read_id", "own_id"), "file_index", "own_id", name="read_id")


def distribution(spark: SparkSession, args: argparse.Namespace, graph, reads: DataFrame) -> None:
    """What --pgpart, --pgdist and --pgfilter write: metis, distributed (nodes by partition), masks and routed reads."""
    graph = graph if graph.tables else compact(graph)
    found = stored(distribute.junctions(graph.nodes, graph.arcs), "junctions")
    if args.pgpart:
        graphs.write_metis(distribute.junction_edges(found), f"{args.out}/metis")
    if args.pgdist:
        dealt = stored(distribute.dealt_nodes(found, graphs.read_parts(spark, args.pgdist)), "dealt")
        dealt.join(graph.nodes.select("id", "seq"), "id").write.partitionBy("part").parquet(f"{args.out}/distributed")
        if args.pgfilter:
            words = dealt.join(graph.nodes, "id").select("part", F.explode(K.all_windows(F.col("seq"), args.k)).alias("word"))
            owned = words.select(K.canonical(F.col("word")).alias("kmer"), "part")
            masks = stored(distribute.read_masks(reads, args.k, distribute.sketch(owned, args.pgfilter), args.pgfilter), "masks")
            masks.write.parquet(f"{args.out}/masks")
            group = F.floor(F.col("read_id") / 2) if "Paired" in args.category else F.col("read_id")
            pairs = distribute.neighbours(reads, group)
            distribute.routed(masks, pairs, 64).write.partitionBy("part").parquet(f"{args.out}/routed")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    if args.max_coverage and args.cov_cutoff >= args.max_coverage:
        sys.exit("--cov-cutoff must be below --max-coverage")
    spark = spark or SparkSession.builder.appName("helixframe").getOrCreate()
    options = Options(args.k, args.unknown, not args.noclip, args.bubble_removal, args.keep_cycles, args.cov_cutoff, args.max_coverage)
    reads = stored(load(spark, args), "reads")
    count = reads.count()
    texts = {"command": " ".join(argv if argv is not None else sys.argv[1:]), "sequences": str(count)}
    if args.part:
        parts, m = round_up_power(args.part[0]), args.part[1]
        colours = partition.by_range(m, parts)
        graphs.write_super_kmers(partition.super_kmers(prepared(reads, options), args.k, m, colours), f"{args.out}/partitions")
        graph = assemble_in_parts(reads, options, m, colours, parts, args.flow)
        texts["partitions"] = str(parts)
    else:
        graph = assemble(reads, options)
    if args.stat:
        clean = prepared(reads, options)
        classes = node_classes(kmer_counts(clean, args.k), half_arcs(clean, args.k), "kmer")
        classes.groupBy("class").count().write.parquet(f"{args.out}/classes")
    if options.clip:
        graph = finish(graph, args.cov_cutoff, args.max_coverage, args.bubble_removal)
    if args.pgpart or args.pgdist:
        distribution(spark, args, graph, prepared(reads, options))
    found = stored(min_contig_length(unitigs(graph), args.k, args.min_contig), "contigs")
    graphs.write_pregraph(found, f"{args.out}/pregraph", args.k, count, direct=not args.part)
    graphs.write_contigs(found, f"{args.out}/contigs")
    graphs.write_coverage_database(found, f"{args.out}/coverage")
    report.contig_stats(found).write.parquet(f"{args.out}/stats")
    report.coverage_histogram(found).write.parquet(f"{args.out}/histogram")
    report.weighted_median_coverage(found).write.parquet(f"{args.out}/median")
    for name, text in texts.items():
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{args.out}/{'run-' if name == 'partitions' else ''}{name}")


if __name__ == "__main__":
    main()
