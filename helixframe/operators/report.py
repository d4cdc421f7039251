"""Reports on graphs and contigs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def histogram(df: DataFrame, value: Column, low: int, high: int) -> DataFrame:
    """bucket, n: values of an integer column, those outside clamped to both ends."""
    return df.groupBy(F.least(F.greatest(value, F.lit(low)), F.lit(high)).alias("bucket")).agg(F.count("*").alias("n"))


def histogram_summary(buckets: DataFrame, slots: int) -> DataFrame:
    """used_percent, average, largest, weighted: the share of buckets in use, the mean bucket, the highest bucket in use
    and the mean weighted by the bucket, which is null if the last bucket holds a fifth or more."""
    total, last = F.sum("n"), F.sum(F.when(F.col("bucket") == slots - 1, F.col("n")).otherwise(0))
    first = F.sum(F.col("bucket") * F.col("n"))
    weighted = F.when(last < 0.2 * total, F.sum(F.col("bucket") * F.col("bucket") * F.col("n")) / F.nullif(first, F.lit(0)))
    return buckets.agg(
        (F.count_if(F.col("n") > 0) * 100.0 / slots).alias("used_percent"), (first / total).alias("average"),
        F.max("bucket").alias("largest"), weighted.alias("weighted"),
    )


def component_stats(members: DataFrame, classes: DataFrame, arcs: DataFrame) -> DataFrame:
    """component, nodes, isolated, tips, linear, branching, internal_arcs, border_arcs, border_nodes, single_copy,
    complete (no borders): one row for each component."""
    of = members.select("id", "component").join(classes.select("id", "class"), "id")
    inner = arcs.where("far = 0").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("ends"), F.max("weight").alias("heaviest"))
    outer = arcs.where("far > 0").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("border"))
    rows = of.join(inner, "id", "left").join(outer, "id", "left").fillna(0, ["ends", "border", "heaviest"])
    kinds = {n: F.count_if(F.col("class") == c).alias(n) for n, c in (("isolated", "isolated"), ("tips", "tip"), ("linear", "linear"), ("branching", "branching"))}
    return rows.groupBy("component").agg(
        F.count("*").alias("nodes"), *kinds.values(), (F.sum("ends") / 2).cast("long").alias("internal_arcs"), F.sum("border").alias("border_arcs"),
        F.count_if(F.col("border") > 0).alias("border_nodes"), (F.max("heaviest") <= 1).alias("single_copy"), (F.sum("border") == 0).alias("complete"),
    )


def contig_stats(lengths: DataFrame, column: str = "n_kmers") -> DataFrame:
    """contigs, total, shortest, longest, mean, median, and n50, n80 with the contigs that reach them and their percent.

    Fractions are cut to integers; the median of an even number is the mean of the middle two. Lengths are counted
    first, so the running sums go over distinct lengths. Without contigs there is no row.
    """
    counted = lengths.groupBy(F.col(column).cast("long").alias("len")).agg(F.count("*").alias("c"))
    begin, end = Window.unboundedPreceding, Window.unboundedFollowing
    down, up, all_ = Window.orderBy(F.desc("len")).rowsBetween(begin, 0), Window.orderBy("len").rowsBetween(begin, 0), Window.orderBy("len").rowsBetween(begin, end)
    size = F.col("len") * F.col("c")
    rows = counted.withColumns(
        {"bases": F.sum(size).over(down), "upto": F.sum("c").over(down), "below": F.sum("c").over(up), "contigs": F.sum("c").over(all_), "total": F.sum(size).over(all_)}
    )
    lower = F.min(F.when(F.col("below") * 2 >= F.col("contigs"), F.col("len")))
    upper = F.min(F.when(F.col("below") > F.floor(F.col("contigs") / 2), F.col("len")))
    found = [F.floor((lower + upper) / 2).alias("median")]
    for p in (50, 80):
        goal = F.floor(F.col("total") * p / 100 + 0.5)
        found += [
            F.max(F.when(F.col("bases") >= goal, F.col("len"))).alias(f"n{p}"),
            F.max(F.when(F.col("bases") < goal, F.col("upto")).otherwise(0)).alias(f"before{p}"),
            (F.max(goal) - F.max(F.when(F.col("bases") < goal, F.col("bases")).otherwise(0))).alias(f"rest{p}"),
        ]
    out = rows.groupBy("contigs", "total").agg(F.min("len").alias("shortest"), F.max("len").alias("longest"), *found)
    out = out.withColumn("mean", F.floor(F.col("total") / F.col("contigs")))
    for p in (50, 80):
        n = F.col(f"before{p}") + F.ceil(F.col(f"rest{p}") / F.col(f"n{p}"))
        out = out.withColumn(f"n{p}_count", n.cast("long")).withColumn(f"n{p}_percent", F.floor(F.lit(100) * n / F.col("contigs")).cast("long"))
    return out.select("contigs", "total", "shortest", "longest", "mean", "median", "n50", "n50_count", "n50_percent", "n80", "n80_count", "n80_percent")


def coverage_histogram(unitigs: DataFrame) -> DataFrame:
    """bucket (tenths of coverage), nodes, weighted: nodes in each, and ten times their k-mer occurrences."""
    tenths = F.floor(F.col("kmer_occurrences") * 10 / F.col("n_kmers")).cast("long")
    return unitigs.groupBy(tenths.alias("bucket")).agg(F.count("*").alias("nodes"), F.sum((F.col("kmer_occurrences") * 10).cast("long")).alias("weighted"))


def weighted_median_coverage(unitigs: DataFrame) -> DataFrame:
    """coverage: the least at which nodes of at most that coverage hold half of all k-mers.

    K-mers are counted by tenths of coverage first; only values within the tenth that holds the middle are put in order."""
    tenth = F.floor(F.col("coverage") * 10)
    counted = unitigs.groupBy(tenth.alias("tenth")).agg(F.sum("n_kmers").alias("n"))
    begin, end = Window.unboundedPreceding, Window.unboundedFollowing
    upto, total = F.sum("n").over(Window.orderBy("tenth").rowsBetween(begin, 0)), F.sum("n").over(Window.orderBy("tenth").rowsBetween(begin, end))
    middle = counted.withColumns({"upto": upto, "total": total}).where(F.col("upto") * 2 >= F.col("total")).orderBy("tenth").limit(1)
    middle = middle.select(F.col("tenth").alias("of"), (F.col("upto") - F.col("n")).alias("below"), "total")
    near = unitigs.join(F.broadcast(middle), tenth == F.col("of")).groupBy("of", "below", "total", "coverage").agg(F.sum("n_kmers").alias("n"))
    reached = F.col("below") + F.sum("n").over(Window.partitionBy("of").orderBy("coverage").rowsBetween(begin, 0))
    return near.withColumn("upto", reached).where(F.col("upto") * 2 >= F.col("total")).agg(F.min("coverage").alias("coverage"))


def counters(found: DataFrame, open_ids: DataFrame) -> DataFrame:
    """target, components, nodes, largest, open: what a partition's components (id, component, target) are and how many
    of their nodes a later partition can still change."""
    sizes = found.groupBy("target", "component").agg(F.count("*").alias("n"))
    still = found.join(open_ids, "id", "left_semi").groupBy("target").agg(F.count("*").alias("open"))
    rows = sizes.groupBy("target").agg(F.count("*").alias("components"), F.sum("n").alias("nodes"), F.max("n").alias("largest"))
    return rows.join(still, "target", "left").fillna(0, ["open"])


def component_classes(stats: DataFrame) -> DataFrame:
    """kind, n, components: of component_stats, how many components of each kind have n nodes. Kinds are complete single
    nodes, complete single-copy and other complete ones, and open ones by one, two or more border nodes."""
    kind = (
        F.when(F.col("complete") & (F.col("nodes") == 1), "single node")
        .when(F.col("complete") & F.col("single_copy"), "single copy")
        .when(F.col("complete"), "complete")
        .when(F.col("border_nodes") == 1, "one border node")
        .when(F.col("border_nodes") == 2, "two border nodes")
        .otherwise("more border nodes")
    )
    return stats.groupBy(kind.alias("kind"), F.col("nodes").alias("n")).agg(F.count("*").alias("components"))


def log_numbers(lines: DataFrame, pattern: str, *names: str) -> DataFrame:
    """The numbers that a pattern's groups find in the lines (value) of a log, as columns."""
    hit = lines.where(F.col("value").rlike(pattern))
    return hit.select(*[F.regexp_extract("value", pattern, i + 1).cast("double").alias(n) for i, n in enumerate(names)])
