"""All registered queries outside the llm subpackage, with the SQL that must give the same rows.

Counting queries read every document's text as bases; graph queries read synthetic reads made from lineitem. Each runs
over its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import kmer as K
from helixframe.operators import distribute, partition, report
from helixframe.operators.compact import compact, unitigs
from helixframe.operators.finish import cut_coverage, min_contig_length
from helixframe.operators.kmers import Graph, broken_arcs, de_bruijn, half_arcs, kmer_counts, kmers, node_classes
from helixframe.operators.ranking import numbered
from helixframe.plans import assemble as plans
from helixframe.plans import sql as S
from helixframe.session import stored, stored_path, table
from helixframe.sources import graphs
from helixframe.sources.reads import category, document_reads, lineitem_read_counts, lineitem_reads, read_fasta, read_fastq, read_tabbed, split_unknown
from helixframe.streaming.spectrum import GrowingGraph, read_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: The graph queries' k, mini-k-mer length and number of partitions.
KG, M, PARTS = 15, 7, 64


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


# Reads and scalar functions


@query(f"WITH {S.DOCUMENT_READS} SELECT read_id, length(seq) AS bases, md5(seq) AS digest FROM reads")
def read_normalise(spark, sf_dir):
    return document_reads(spark, sf_dir).select("read_id", F.length("seq").alias("bases"), F.md5(F.col("seq").cast("binary")).alias("digest"))


@query("""
SELECT doc_id AS read_id, len(s) AS stretches, list_sum(list_transform(s, lambda x: length(x)))::BIGINT AS bases, list_max(list_transform(s, lambda x: length(x))) AS longest
FROM (SELECT doc_id, regexp_extract_all(translate(text, 'acgt', 'ACGT'), '[ACGT]+') AS s FROM documents) WHERE len(s) > 0
""")
def read_split_unknown(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("read_id"), F.col("text").alias("seq"))
    n = F.length("seq")
    return split_unknown(docs).groupBy("read_id").agg(F.count("*").alias("stretches"), F.sum(n).alias("bases"), F.max(n).alias("longest"))


@query("SELECT least(length(text) // 100, 200) AS bucket, count(*) AS n FROM documents GROUP BY 1")
def read_length_hist(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return report.histogram(docs, F.floor(F.length("text") / 100), 0, 200)


@query(f"""
WITH {S.LINEITEM_READS}, {S.kmers(KG)}
SELECT read_id, count(*) AS n_kmers, count(*) FILTER (sense_reversed) AS n_reversed, min(canon) AS least, max(canon) AS greatest, max(pos) AS last_pos FROM kmers GROUP BY 1
""")
def kmer_explode(spark, sf_dir):
    rows = kmers(lineitem_reads(spark, sf_dir), KG)
    return rows.groupBy("read_id").agg(
        F.count("*").alias("n_kmers"), F.count_if("sense_reversed").alias("n_reversed"), F.min("canon").alias("least"), F.max("canon").alias("greatest"), F.max("pos").alias("last_pos")
    )


@query(f"""
WITH {S.LINEITEM_READS}, {S.counts(KG)}, coded AS (SELECT kmer, {S.code('kmer', KG)} AS code FROM counts)
SELECT kmer, code, {S.rc('kmer')} AS twin, {S.mini('kmer', KG, M)} AS mini, {S.hashed('code')} AS hash,
  code & 3 AS head_base, (code >> {2 * KG - 2}) & 3 AS tail_base, (code >> 2) | (2::BIGINT << {2 * KG - 2}) AS appended, ((code << 2) | 1) & {K.mask(KG)} AS prepended
FROM coded
""")
def kmer_codes(spark, sf_dir):
    rows = kmer_counts(lineitem_reads(spark, sf_dir), KG).withColumn("code", K.encode(F.col("kmer")))
    code = F.col("code")
    return rows.select(
        "kmer", "code", K.reverse_complement(F.col("kmer")).alias("twin"), K.mini_kmer(F.col("kmer"), KG, M).alias("mini"), K.hashed(code).alias("hash"),
        K.base_at(code, 0).alias("head_base"), K.base_at(code, KG - 1).alias("tail_base"),
        K.append_base(code, F.lit(2), KG).alias("appended"), K.prepend_base(code, F.lit(1), KG).alias("prepended"),
    )


@query(f"WITH {S.LINEITEM_READS}, {S.counts(KG)} SELECT {S.mini('kmer', KG, M)} AS mini, count(*) AS kmers, sum(occ)::BIGINT AS occ FROM counts GROUP BY 1")
def minikmer(spark, sf_dir):
    rows = kmer_counts(lineitem_reads(spark, sf_dir), KG)
    return rows.groupBy(K.mini_kmer(F.col("kmer"), KG, M).alias("mini")).agg(F.count("*").alias("kmers"), F.sum("occ").alias("occ"))


def _written(spark, lines: DataFrame, name: str) -> str:
    """The folder of text files with these lines (value)."""
    path = stored_path(spark, name)
    lines.select("value").write.text(path)
    return path


SCANNED = f"WITH {S.LINEITEM_READS} SELECT seq, count(*) AS n, {{0}} AS category FROM reads GROUP BY 1"


@query(SCANNED.format(1))
def fasta_scan(spark, sf_dir):
    """Reads as FASTA with lower and upper case headers, sequences over two lines, and back."""
    seq = F.col("seq")
    value = F.concat(F.lit(">read "), F.col("read_id").cast("string"), F.lit("\n"), F.substring(seq, 1, 20), F.lit("\r\n"), F.substring(seq, 21, 2**30))
    found = read_fasta(spark, _written(spark, lineitem_reads(spark, sf_dir).withColumn("value", value), "fasta"), category("shortPaired"))
    return found.groupBy("seq", "category").agg(F.count("*").alias("n"))


@query(SCANNED.format(4))
def fastq_scan(spark, sf_dir):
    """Reads as FASTQ, every third with a quality that begins with an at sign, and back."""
    quality = F.when(F.col("read_id") % 3 == 0, F.repeat(F.lit("@"), 36)).otherwise(F.repeat(F.lit("I"), 36))
    value = F.concat(F.lit("@"), F.col("read_id").cast("string"), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), quality)
    found = read_fastq(spark, _written(spark, lineitem_reads(spark, sf_dir).withColumn("value", value), "fastq"), category("long"))
    return found.groupBy("seq", "category").agg(F.count("*").alias("n"))


@query(SCANNED.format(2))
def tabbed_scan(spark, sf_dir):
    """Reads as the fifth field of tabbed lines, and back."""
    value = F.concat(F.lit("1\t2\t\tx\t"), F.col("seq"), F.lit("\tq"))
    found = read_tabbed(spark, _written(spark, lineitem_reads(spark, sf_dir).withColumn("value", value), "tabbed"), category_id=category("short2"))
    return found.groupBy("seq", "category").agg(F.count("*").alias("n"))


@query(f"""
WITH {S.LINEITEM_READS}, {S.counts(KG)}, coded AS (SELECT kmer, occ, {S.code('kmer', KG)} AS code FROM counts)
SELECT kmer, (code & ~(3::BIGINT << 8)) | (1::BIGINT << 8) AS changed, kmer || substr({S.rc('kmer')}, {KG}) AS joined, least(occ, 3)::BIGINT AS weight, ((code << 2) | 3) & {K.mask(KG)} AS shifted, (code >> 6) & 3 AS base
FROM coded
""")
def kmer_edits(spark, sf_dir):
    rows = kmer_counts(lineitem_reads(spark, sf_dir), KG).withColumn("code", K.encode(F.col("kmer")))
    code = F.col("code")
    return rows.select(
        "kmer", K.with_base(code, 4, F.lit(1)).alias("changed"), K.joined(F.col("kmer"), K.reverse_complement(F.col("kmer")), KG).alias("joined"),
        K.saturated(F.col("occ"), 3).cast("long").alias("weight"), K.prepend_base(code, F.lit(3), KG).alias("shifted"), K.base_at(code, 3).alias("base"),
    )


# Counting


@query(f"WITH {S.DOCUMENT_READS}, {S.counts(21)} SELECT occ, count(*) AS kmers FROM counts GROUP BY 1")
def kmer_spectrum(spark, sf_dir):
    return kmer_counts(document_reads(spark, sf_dir), 21).groupBy("occ").agg(F.count("*").alias("kmers"))


@query(f"WITH {S.DOCUMENT_READS}, {S.counts(21)} SELECT kmer, occ FROM counts ORDER BY occ DESC, kmer LIMIT 20")
def kmer_top(spark, sf_dir):
    return kmer_counts(document_reads(spark, sf_dir), 21).orderBy(F.desc("occ"), "kmer").limit(20)


@query(f"WITH {S.DOCUMENT_READS}, {S.counts(33)} SELECT substr(kmer, 1, 5) AS head, occ, count(*) AS kmers, min(kmer) AS least, max(kmer) AS greatest FROM counts GROUP BY 1, 2")
def kmer_counts_long(spark, sf_dir):
    counts = kmer_counts(document_reads(spark, sf_dir), 33)
    return counts.groupBy(F.substring("kmer", 1, 5).alias("head"), "occ").agg(F.count("*").alias("kmers"), F.min("kmer").alias("least"), F.max("kmer").alias("greatest"))


@query(f"""
WITH {S.LINEITEM_READS}, {S.counts(KG)}, coded AS (SELECT {S.code('kmer', KG)} AS code FROM counts),
depths AS (SELECT {S.hashed('code')} & 1023 AS bucket, count(*) AS depth FROM coded GROUP BY 1) SELECT depth, count(*) AS buckets FROM depths GROUP BY 1
""")
def hash_chain_hist(spark, sf_dir):
    rows = kmer_counts(lineitem_reads(spark, sf_dir), KG)
    bucket = K.hashed(K.encode(F.col("kmer"))).bitwiseAND(F.lit(1023))
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("depth")).groupBy("depth").agg(F.count("*").alias("buckets"))


@query(f"WITH {S.LINEITEM_READS}, {S.arcs(KG, None)} SELECT * FROM arcs")
def arc_weights(spark, sf_dir):
    return half_arcs(lineitem_reads(spark, sf_dir), KG, None)


@query(f"WITH {S.DOCUMENT_READS}, {S.arcs(9)} SELECT weight, count(*) AS halves, count(*) FILTER (src = dst) AS loops FROM arcs GROUP BY 1")
def arc_weights_saturated(spark, sf_dir):
    return half_arcs(document_reads(spark, sf_dir), 9).groupBy("weight").agg(F.count("*").alias("halves"), F.count_if(F.col("src") == F.col("dst")).alias("loops"))


@query(f"WITH {S.LINEITEM_READS}, {S.arcs(KG)} SELECT src, side, base, dst, weight FROM arcs WHERE sense_changed")
def sense_changed_arcs(spark, sf_dir):
    return half_arcs(lineitem_reads(spark, sf_dir), KG).where("sense_changed").select("src", "side", "base", "dst", "weight")


DEGREES = f"""{S.LINEITEM_READS}, {S.counts(KG)}, {S.arcs(KG)}, classes AS (
  SELECT kmer AS id, coalesce(lefts, 0) AS lefts, coalesce(rights, 0) AS rights,
    CASE WHEN coalesce(lefts + rights, 0) = 0 THEN 'isolated' WHEN lefts + rights = 1 THEN 'tip' WHEN lefts = 1 AND rights = 1 THEN 'linear' ELSE 'branching' END AS class
  FROM counts LEFT JOIN (SELECT src, count(*) FILTER (side = 'L') AS lefts, count(*) FILTER (side = 'R') AS rights FROM arcs GROUP BY src) d ON d.src = counts.kmer
)"""


def _classes(spark, sf_dir):
    """Every k-mer of a read that is longer than k is an end of some arc, so arcs tell all nodes."""
    return node_classes(None, half_arcs(lineitem_reads(spark, sf_dir), KG))


@query(f"WITH {DEGREES} SELECT class, lefts, rights, count(*) AS nodes FROM classes GROUP BY ALL")
def node_degree_class(spark, sf_dir):
    return _classes(spark, sf_dir).groupBy("class", "lefts", "rights").agg(F.count("*").alias("nodes"))


@query(f"WITH {DEGREES} SELECT id, lefts = 0 AS walks_right FROM classes WHERE lefts + rights = 1")
def tip_starts(spark, sf_dir):
    return _classes(spark, sf_dir).where("lefts + rights = 1").select("id", (F.col("lefts") == 0).alias("walks_right"))


@query(f"WITH {S.LINEITEM_READS}, {S.arcs(KG)} SELECT a.src, a.side, a.dst, b.dst AS next, b.weight FROM arcs a JOIN arcs b ON b.src = a.dst AND b.side <> a.dst_side")
def two_hops(spark, sf_dir):
    arcs = half_arcs(lineitem_reads(spark, sf_dir), KG)
    onward = arcs.select(F.col("src").alias("dst"), F.col("side").alias("exit"), F.col("dst").alias("next"), "weight")
    return arcs.drop("weight").join(onward, "dst").where("exit != dst_side").select("src", "side", "dst", "next", "weight")


# Partitions


def _colour_sql(x: str) -> str:
    return f"(1 + {S.code(S.mini(x, KG, M), M)} // {4**M // PARTS})::INT"


COLOURED = f"{S.LINEITEM_READS}, {S.kmers(KG)}, coloured AS (SELECT *, {_colour_sql('kmer')} AS color FROM kmers)"
RANGES = partition.by_range(M, PARTS)


@query(f"WITH {COLOURED} SELECT color, count(*) AS occ, count(DISTINCT canon) AS kmers FROM coloured GROUP BY 1")
def kmer_partition_range(spark, sf_dir):
    rows = partition.coloured(lineitem_reads(spark, sf_dir), KG, M, RANGES)
    return rows.groupBy("color").agg(F.count("*").alias("occ"), F.count_distinct("canon").alias("kmers"))


@query(f"""
WITH {COLOURED}, sizes AS (SELECT color, count(DISTINCT canon) AS kmers FROM coloured GROUP BY 1)
SELECT count(*) AS parts, min(kmers) AS least, max(kmers) AS most, round(avg(kmers), 6) AS mean, round(stddev_pop(kmers), 6) AS deviation FROM sizes
""")
def partition_balance(spark, sf_dir):
    n = F.col("kmers")
    return kmer_partition_range(spark, sf_dir).agg(
        F.count("*").alias("parts"), F.min(n).alias("least"), F.max(n).alias("most"), F.round(F.avg(n), 6).alias("mean"), F.round(F.stddev_pop(n), 6).alias("deviation")
    )


PIECES = f"""{COLOURED}, runs AS (
  SELECT *, sum(CASE WHEN before = color THEN 0 ELSE 1 END) OVER (PARTITION BY read_id ORDER BY pos) - 1 AS run FROM (
    SELECT *, lag(color) OVER w AS before, lead(color) OVER w AS after, lag(kmer) OVER w AS prior, lead(kmer) OVER w AS next FROM coloured WINDOW w AS (PARTITION BY read_id ORDER BY pos))
), pieces AS (
  SELECT read_id, run::INT AS run, color, count(*)::INT AS n_kmers,
    coalesce(substr(first(prior ORDER BY pos), 1, 1), '') || first(kmer ORDER BY pos) || coalesce(string_agg(CASE WHEN before = color THEN substr(kmer, {KG}, 1) END, '' ORDER BY pos), '') || coalesce(substr(last(next ORDER BY pos), {KG}, 1), '') AS seq,
    first(before ORDER BY pos) AS prefix_color, last(after ORDER BY pos) AS suffix_color
  FROM runs GROUP BY read_id, run, color
)"""


@query(f"WITH {PIECES} SELECT * FROM pieces")
def superkmers(spark, sf_dir):
    return partition.super_kmers(lineitem_reads(spark, sf_dir), KG, M, RANGES)


@query(f"WITH {PIECES} SELECT least(n_kmers, 20) AS n, count(*) AS pieces, sum(n_kmers)::BIGINT AS kmers FROM pieces GROUP BY 1")
def partition_stats(spark, sf_dir):
    return partition.piece_lengths(superkmers(spark, sf_dir))


@query(f"""
WITH all_minis AS (SELECT mini, {S.code('mini', M)} AS c FROM (SELECT list_aggregate(list_transform(range({M}), lambda i: substr('ACGT', (((n >> (2 * i)) & 3) + 1)::INT, 1)), 'string_agg', '') AS mini FROM range({4**M}) AS r(n)) WHERE NOT {S.reversed_('mini')}),
steps AS (SELECT mini, 1 + c // {4**M // PARTS} AS color, unnest(list_concat(list_transform(['A', 'C', 'G', 'T'], lambda b: substr(mini, 2) || b), list_transform(['A', 'C', 'G', 'T'], lambda b: b || substr(mini, 1, {M - 1})))) AS t FROM all_minis)
SELECT color::INT AS color, count(DISTINCT mini) AS minis, count(*) AS neighbours, count(*) FILTER (1 + {S.code(S.canon('t'), M)} // {4**M // PARTS} <> color) AS "foreign" FROM steps GROUP BY 1
""")
def minikmer_borders(spark, sf_dir):
    return partition.mini_kmer_borders(spark, M, RANGES)


FAR = f"""{S.LINEITEM_READS}, {S.arcs(KG)}, far_arcs AS (
  SELECT *, CASE WHEN color = other THEN 0 ELSE other END AS far FROM (SELECT *, {_colour_sql('src')} AS color, {_colour_sql('dst')} AS other FROM arcs)
)"""


def _far(spark, sf_dir):
    return partition.coloured_arcs(lineitem_read_counts(spark, sf_dir), KG, M, RANGES)


@query(f"WITH {FAR} SELECT src, side, base, weight, color, far FROM far_arcs WHERE far > 0")
def boundary_arcs(spark, sf_dir):
    return _far(spark, sf_dir).where("far > 0").select("src", "side", "base", "weight", "color", "far")


@query(f"""
WITH {FAR}, loaded AS (SELECT * FROM far_arcs WHERE color <= 32) SELECT a.src, a.side, a.base FROM loaded a
WHERE NOT EXISTS (SELECT 1 FROM loaded b WHERE b.src = a.dst AND b.side = a.dst_side AND b.dst = a.src AND b.dst_side = a.side AND b.weight = a.weight)
""")
def unpaired_arcs(spark, sf_dir):
    """Of the first 32 partitions alone: the halves whose other half is in a later one."""
    return broken_arcs(_far(spark, sf_dir).where("color <= 32")).select("src", "side", "base")


@query(f"""
WITH {FAR}, {S.counts(KG)} SELECT kmer AS id FROM counts WHERE NOT EXISTS (SELECT 1 FROM far_arcs WHERE far = 0 AND src = kmer)
""")
def isolated_nodes(spark, sf_dir):
    """Nodes without an arc inside their own partition."""
    nodes = kmer_counts(lineitem_reads(spark, sf_dir), KG)
    return node_classes(nodes, _far(spark, sf_dir).where("far = 0"), "kmer").where("class = 'isolated'").select("id")


@query(f"WITH {FAR} SELECT color, count(*) AS halves, count(*) FILTER (far > 0 AND far > 32) AS still_open FROM far_arcs WHERE color <= 32 GROUP BY 1")
def boundary_resolve(spark, sf_dir):
    left = partition.resolved(_far(spark, sf_dir), 32)
    return left.groupBy("color").agg(F.count("*").alias("halves"), F.count_if(F.col("far") > 0).alias("still_open"))


COMPONENTS = f"""RECURSIVE {FAR}, {S.counts(KG)}, links AS (SELECT DISTINCT src, dst FROM far_arcs WHERE far = 0), reach AS (
  SELECT kmer AS id, kmer AS r FROM counts UNION SELECT reach.id, links.dst FROM reach JOIN links ON links.src = reach.r
), labelled AS (SELECT id, min(r) AS component FROM reach GROUP BY id), found AS (
  SELECT id, component, min(f) OVER c AS min_frontier, sum(n) OVER c AS borders FROM (
    SELECT id, component, coalesce(f, {PARTS + 1}) AS f, coalesce(n, 0) AS n FROM labelled LEFT JOIN (SELECT src, min(far) AS f, count(*) AS n FROM far_arcs WHERE far > 0 GROUP BY src) b ON b.src = labelled.id)
  WINDOW c AS (PARTITION BY component)
)"""


def _components(arcs: DataFrame) -> DataFrame:
    """Of stored arcs, which tell all nodes."""
    return partition.components(arcs.select(F.col("src").alias("id")), arcs, PARTS)


@query(f"WITH {COMPONENTS} SELECT id, component, min_frontier::INT AS min_frontier, borders::BIGINT AS borders FROM found")
def component_labels(spark, sf_dir):
    return _components(stored(_far(spark, sf_dir), "far-arcs"))


@query(f"""
WITH {COMPONENTS} SELECT CASE WHEN min_frontier = {PARTS + 1} THEN 'final' WHEN min_frontier > 32 THEN 'inbox-' || min_frontier ELSE 'resident' END AS target,
  count(*) AS nodes, count(DISTINCT component) AS components FROM found GROUP BY 1
""")
def component_split(spark, sf_dir):
    found = partition.targets(component_labels(spark, sf_dir), PARTS, 32)
    return found.groupBy("target").agg(F.count("*").alias("nodes"), F.count_distinct("component").alias("components"))


@query(f"""
WITH {COMPONENTS}, degree AS (SELECT src, count(*) FILTER (side = 'L') AS lefts, count(*) FILTER (side = 'R') AS rights, count(*) FILTER (far = 0) AS ends,
  count(*) FILTER (far > 0) AS border, coalesce(max(weight) FILTER (far = 0), 0) AS heaviest FROM far_arcs GROUP BY src),
member AS (SELECT component, coalesce(lefts, 0) AS l, coalesce(rights, 0) AS r, coalesce(ends, 0) AS ends, coalesce(border, 0) AS border, coalesce(heaviest, 0) AS heaviest FROM found LEFT JOIN degree ON degree.src = found.id)
SELECT component, count(*) AS nodes, count(*) FILTER (l + r = 0) AS isolated, count(*) FILTER (l + r = 1) AS tips, count(*) FILTER (l = 1 AND r = 1) AS linear,
  count(*) FILTER (l + r > 1 AND NOT (l = 1 AND r = 1)) AS branching, (sum(ends) // 2)::BIGINT AS internal_arcs, sum(border)::BIGINT AS border_arcs,
  count(*) FILTER (border > 0) AS border_nodes, max(heaviest) <= 1 AS single_copy, sum(border) = 0 AS complete
FROM member GROUP BY 1
""")
def component_stats(spark, sf_dir):
    arcs = stored(_far(spark, sf_dir), "far-arcs")
    return report.component_stats(_components(arcs), node_classes(None, arcs), arcs)


@query(f"""
WITH {COMPONENTS}, degree AS (SELECT src, count(*) FILTER (far > 0) AS border, coalesce(max(weight) FILTER (far = 0), 0) AS heaviest FROM far_arcs GROUP BY src),
stats AS (SELECT component, count(*) AS n, sum(coalesce(border, 0)) AS borders, count(*) FILTER (coalesce(border, 0) > 0) AS nodes, max(coalesce(heaviest, 0)) <= 1 AS single FROM found LEFT JOIN degree ON degree.src = found.id GROUP BY 1)
SELECT CASE WHEN borders = 0 AND n = 1 THEN 'single node' WHEN borders = 0 AND single THEN 'single copy' WHEN borders = 0 THEN 'complete' WHEN nodes = 1 THEN 'one border node' WHEN nodes = 2 THEN 'two border nodes' ELSE 'more border nodes' END AS kind,
  n, count(*) AS components FROM stats GROUP BY ALL
""")
def component_class_hist(spark, sf_dir):
    return report.component_classes(component_stats(spark, sf_dir))


@query(f"""
WITH {COMPONENTS}, coming AS (SELECT DISTINCT dst FROM far_arcs WHERE color > 32 AND far BETWEEN 1 AND 32)
SELECT id, component FROM found WHERE component IN (SELECT component FROM found JOIN coming ON coming.dst = found.id)
""")
def related_components(spark, sf_dir):
    """Components that the arcs of the partitions above 32 touch in those up to 32."""
    arcs = stored(_far(spark, sf_dir), "far-arcs")
    return partition.related(_components(arcs), arcs.where("color > 32 and far between 1 and 32")).select("id", "component")


OPEN = f"""RECURSIVE {FAR}, loaded AS (SELECT src, side, weight, dst, dst_side, CASE WHEN far <= 60 THEN 0 ELSE far END AS far FROM far_arcs WHERE color <= 60),
sides AS (SELECT src, side, count(*) AS n, max(weight) AS heaviest FROM loaded GROUP BY 1, 2),
marked AS (SELECT a.src, a.side, a.dst, a.dst_side, a.far, n, n > 1 AND (weight = 1 OR weight < heaviest) AS weak FROM loaded a JOIN sides s ON s.src = a.src AND s.side = a.side),
steps AS (SELECT DISTINCT a.src, a.side, a.n, a.dst, a.dst_side, b.weak AS to_weak FROM marked a JOIN marked b ON b.src = a.dst AND b.side = a.dst_side AND b.dst = a.src AND b.dst_side = a.side WHERE a.far = 0),
walk AS (
  SELECT DISTINCT src AS id, side, weak FROM marked WHERE far > 0
  UNION SELECT s.dst, s.dst_side, s.to_weak FROM walk w JOIN steps s ON s.src = w.id AND ((s.side <> w.side AND s.n = 1) OR (s.side = w.side AND s.n > 1 AND w.weak))
), open AS (SELECT DISTINCT id FROM walk)"""


@query(f"WITH {OPEN} SELECT id FROM open")
def open_nodes(spark, sf_dir):
    """With the partitions up to 60 loaded."""
    return partition.open_nodes(partition.resolved(_far(spark, sf_dir), 60))


@query()
def scooped_partitions(spark, sf_dir):
    colours = spark.createDataFrame(sorted(partition.scooped(5, 16).items()), "mini string, color int")
    rows = kmer_counts(lineitem_reads(spark, sf_dir), KG).withColumn("mini", K.mini_kmer(F.col("kmer"), KG, 5))
    return partition.colour_table(rows, "mini", colours).groupBy("color").agg(F.count("*").alias("kmers"), F.sum("occ").alias("occ"))


@query()
def clustered_partitions(spark, sf_dir):
    rows = kmers(lineitem_reads(spark, sf_dir), KG).select("read_id", "pos", K.mini_kmer(F.col("kmer"), KG, 5).alias("mini"))
    counts = rows.groupBy("mini").agg(F.count("*").alias("n"))
    after = rows.select("read_id", (F.col("pos") - 1).alias("pos"), F.col("mini").alias("to"))
    near = rows.join(after, ["read_id", "pos"]).where("mini != to").groupBy(F.least("mini", "to").alias("a"), F.greatest("mini", "to").alias("b")).agg(F.count("*").alias("n"))
    colours = spark.createDataFrame(sorted(partition.clustered(near, counts, 16).items()), "mini string, color int")
    return partition.colour_table(counts, "mini", colours).groupBy("color").agg(F.count("*").alias("minis"), F.sum("n").alias("occ"))


@query()
def hashed_partitions(spark, sf_dir):
    rows = partition.coloured(lineitem_reads(spark, sf_dir), KG, M, partition.by_hash(PARTS))
    return rows.groupBy("color").agg(F.count("*").alias("occ"), F.count_distinct("canon").alias("kmers"))


# Assembly

GRAPH = plans.Options(k=21)


CHAINS = f"""RECURSIVE {S.LINEITEM_READS}, {S.counts(KG)}, {S.arcs(KG)}, alone AS (SELECT src, side FROM arcs GROUP BY 1, 2 HAVING count(*) = 1),
links AS (SELECT a.src, a.side, a.dst, CASE a.dst_side WHEN 'L' THEN 'R' ELSE 'L' END AS onward, CASE a.side WHEN 'R' THEN base ELSE {S.comp('base')} END AS added
  FROM arcs a JOIN alone x ON x.src = a.src AND x.side = a.side JOIN alone y ON y.src = a.dst AND y.side = a.dst_side WHERE a.src <> a.dst),
starts AS (SELECT kmer, occ, side FROM counts, (VALUES ('L'), ('R')) v(side) WHERE NOT EXISTS (SELECT 1 FROM links WHERE src = kmer AND links.side <> v.side)),
walk AS (
  SELECT kmer AS id, side, kmer AS node_id, CASE side WHEN 'R' THEN kmer ELSE {S.rc('kmer')} END AS seq, 1 AS n_kmers, occ::BIGINT AS kmer_occurrences FROM starts
  UNION ALL SELECT l.dst, l.onward, least(node_id, l.dst), seq || added, n_kmers + 1, kmer_occurrences + c.occ FROM walk w JOIN links l ON l.src = w.id AND l.side = w.side JOIN counts c ON c.kmer = l.dst
), chains AS (
  SELECT node_id, min(least(seq, {S.rc('seq')})) AS seq, max(n_kmers)::INT AS n_kmers, max(kmer_occurrences) AS kmer_occurrences, max(kmer_occurrences) / max(n_kmers) AS coverage
  FROM walk w WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.src = w.id AND l.side = w.side) GROUP BY node_id
)"""


@query(f"WITH {CHAINS} SELECT * FROM chains")
def chains(spark, sf_dir):
    return unitigs(compact(de_bruijn(lineitem_reads(spark, sf_dir), KG)))


@query(f"WITH {CHAINS} SELECT (kmer_occurrences * 10) // n_kmers AS bucket, count(*) AS nodes, sum(kmer_occurrences * 10)::BIGINT AS weighted FROM chains GROUP BY 1")
def chain_coverage_hist(spark, sf_dir):
    return report.coverage_histogram(chains(spark, sf_dir))


@query(f"""
WITH {CHAINS}, c AS (SELECT coverage, sum(n_kmers) AS n FROM chains GROUP BY 1),
r AS (SELECT coverage, sum(n) OVER (ORDER BY coverage) AS upto, sum(n) OVER () AS total FROM c) SELECT min(coverage) AS coverage FROM r WHERE upto * 2 >= total
""")
def chain_median(spark, sf_dir):
    return report.weighted_median_coverage(chains(spark, sf_dir))


@query(f"""
WITH {CHAINS} SELECT row_number() OVER (ORDER BY seq) AS number, 'NODE' || chr(9) || row_number() OVER (ORDER BY seq) || chr(9) || n_kmers || chr(9) || '0' || chr(9) || format('{{:g}}', coverage) AS node, seq FROM chains
""")
def chain_lines(spark, sf_dir):
    return graphs.contig_lines(chains(spark, sf_dir))


@query(f"WITH {CHAINS} SELECT n_kmers, format('{{:g}}', coverage)::DOUBLE AS coverage, seq FROM chains")
def pregraph_scan(spark, sf_dir):
    """Chains as a text graph, and back."""
    path = stored_path(spark, "pregraph")
    graphs.write_pregraph(chains(spark, sf_dir), path, KG, 1)
    return graphs.read_pregraph(spark, path)[1].select("n_kmers", "coverage", "seq")


@query(f"WITH {CHAINS} SELECT n_kmers, coverage FROM chains")
def coverage_scan(spark, sf_dir):
    """Chains as a tabbed coverage database, and back."""
    path = stored_path(spark, "coverage")
    graphs.write_coverage_database(chains(spark, sf_dir), path)
    return spark.read.option("sep", "\t").schema("n_kmers int, coverage double").csv(path)


@query(f"WITH {CHAINS} SELECT node_id, n_kmers FROM chains WHERE coverage >= 2 AND coverage <= 4")
def chain_cutoff(spark, sf_dir):
    graph = cut_coverage(compact(de_bruijn(lineitem_reads(spark, sf_dir), KG)), 2, 4)
    return unitigs(graph).select("node_id", "n_kmers")


@query()
def clipped_unitigs(spark, sf_dir):
    return unitigs(plans.assemble(lineitem_read_counts(spark, sf_dir), GRAPH))


@query()
def clipped_in_parts(spark, sf_dir):
    return unitigs(plans.assemble_in_parts(lineitem_read_counts(spark, sf_dir), GRAPH, M, RANGES, PARTS))


@query()
def popped_contigs(spark, sf_dir):
    return plans.contigs(lineitem_read_counts(spark, sf_dir), plans.Options(k=21, bubbles=True, cov_cutoff=2.0))


@query()
def contigs_over_100(spark, sf_dir):
    return plans.contigs(lineitem_read_counts(spark, sf_dir), GRAPH, 100)


@query()
def contig_report(spark, sf_dir):
    return report.contig_stats(unitigs(plans.assemble(lineitem_read_counts(spark, sf_dir), GRAPH)))


@query()
def unitig_coverage_hist(spark, sf_dir):
    return report.coverage_histogram(unitigs(plans.assemble(lineitem_read_counts(spark, sf_dir), GRAPH)))


@query()
def pregraph_lines(spark, sf_dir):
    return graphs.contig_lines(unitigs(plans.assemble(lineitem_read_counts(spark, sf_dir), GRAPH)))


LENGTHS = "lengths AS (SELECT length(text)::BIGINT AS len FROM documents WHERE length(text) > 0)"


def _n(p: int) -> str:
    goal = f"floor(total * {p} / 100 + 0.5)"
    return f"""(SELECT min(len) FROM (SELECT len, nth FROM ranked, totals WHERE so_far - len < {goal})) AS n{p},
  (SELECT max(nth) FROM ranked, totals WHERE so_far - len < {goal}) AS n{p}_count,
  (SELECT (100 * max(nth)) // max(contigs) FROM ranked, totals WHERE so_far - len < {goal}) AS n{p}_percent"""


@query(f"""
WITH {LENGTHS}, totals AS (SELECT count(*) AS contigs, sum(len)::BIGINT AS total FROM lengths),
ranked AS (SELECT len, sum(len) OVER (ORDER BY len DESC, i ROWS UNBOUNDED PRECEDING) AS so_far, row_number() OVER (ORDER BY len DESC, i) AS nth FROM (SELECT len, row_number() OVER () AS i FROM lengths))
SELECT contigs, total, (SELECT min(len) FROM lengths) AS shortest, (SELECT max(len) FROM lengths) AS longest, total // contigs AS mean,
  (SELECT floor(median(len))::BIGINT FROM lengths) AS median, {_n(50)}, {_n(80)} FROM totals
""")
def contig_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.length("text").alias("n_kmers")).where("n_kmers > 0")
    return report.contig_stats(docs)


LIKE_UNITIGS = "u AS (SELECT doc_id AS node_id, length(text) AS n_kmers, length(text) * (1 + doc_id % 37) + doc_id % 5 AS kmer_occurrences FROM documents WHERE length(text) > 0)"


def _like_unitigs(spark, sf_dir):
    """Documents as nodes, with lengths and made-up occurrences, so that reports can be compared with SQL."""
    n = F.length("text")
    docs = table(spark, sf_dir, "documents").where(n > 0)
    occ = n * (1 + F.col("doc_id") % 37) + F.col("doc_id") % 5
    return docs.select(F.col("doc_id").alias("node_id"), n.alias("n_kmers"), occ.alias("kmer_occurrences"), (occ / n).alias("coverage"))


@query(f"""
WITH {CHAINS}, lengths AS (SELECT n_kmers::BIGINT AS len FROM chains), totals AS (SELECT count(*) AS contigs, sum(len)::BIGINT AS total FROM lengths),
ranked AS (SELECT len, sum(len) OVER (ORDER BY len DESC, i ROWS UNBOUNDED PRECEDING) AS so_far, row_number() OVER (ORDER BY len DESC, i) AS nth FROM (SELECT len, row_number() OVER () AS i FROM lengths))
SELECT contigs, total, (SELECT min(len) FROM lengths) AS shortest, (SELECT max(len) FROM lengths) AS longest, total // contigs AS mean,
  (SELECT floor(median(len))::BIGINT FROM lengths) AS median, {_n(50)}, {_n(80)} FROM totals
""")
def chain_stats(spark, sf_dir):
    return report.contig_stats(chains(spark, sf_dir))


@query(f"WITH {LIKE_UNITIGS} SELECT (kmer_occurrences * 10) // n_kmers AS bucket, count(*) AS nodes, sum(kmer_occurrences * 10)::BIGINT AS weighted FROM u GROUP BY 1")
def coverage_hist(spark, sf_dir):
    return report.coverage_histogram(_like_unitigs(spark, sf_dir))


@query(f"""
WITH {LIKE_UNITIGS}, c AS (SELECT kmer_occurrences / n_kmers AS coverage, sum(n_kmers) AS n FROM u GROUP BY 1),
r AS (SELECT coverage, sum(n) OVER (ORDER BY coverage) AS upto, sum(n) OVER () AS total FROM c) SELECT min(coverage) AS coverage FROM r WHERE upto * 2 >= total
""")
def length_weighted_median(spark, sf_dir):
    return report.weighted_median_coverage(_like_unitigs(spark, sf_dir))


@query(f"""
WITH {LIKE_UNITIGS}, kept AS (SELECT node_id, n_kmers FROM u WHERE kmer_occurrences / n_kmers >= 5 AND kmer_occurrences / n_kmers <= 30)
SELECT node_id, n_kmers, (SELECT count(*) FROM kept b WHERE b.node_id IN (a.node_id - 1, a.node_id + 1)) AS arcs FROM kept a
""")
def cov_cutoff(spark, sf_dir):
    """Documents as nodes in a row, each with an arc to the next."""
    docs, n = _like_unitigs(spark, sf_dir), F.col("n_kmers")
    each, last = 1 + F.col("node_id") % 37, F.col("node_id") % 5
    occs = F.concat(F.array_repeat(each, n - 1), F.array(each + last))
    nodes = docs.select(F.col("node_id").alias("id"), F.lit("").alias("seq"), occs.alias("occs"))
    arc = lambda side, step: F.struct(F.lit(side).alias("side"), (F.col("node_id") + step).alias("dst"), F.lit("L" if side == "R" else "R").alias("dst_side"))
    arcs = docs.select(F.col("node_id").alias("src"), F.inline(F.array(arc("L", -1), arc("R", 1)))).join(docs.select(F.col("node_id").alias("dst")), "dst", "left_semi")
    left = cut_coverage(Graph(1, nodes, arcs), 5, 30)
    counted = left.arcs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("arcs"))
    return left.nodes.join(counted, "id", "left").fillna(0, ["arcs"]).select(F.col("id").alias("node_id"), F.size("occs").alias("n_kmers"), "arcs")


@query("SELECT doc_id AS node_id, length(text) AS n FROM documents WHERE length(text) >= 100 + 21 - 1")
def min_length(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), F.col("text").alias("seq"))
    return min_contig_length(docs, 21, 100).select("node_id", F.length("seq").alias("n"))


@query("SELECT doc_id, row_number() OVER (ORDER BY length(text) DESC, doc_id) - 1 AS number FROM documents")
def numbered_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", (-F.length("text")).alias("n"))
    return numbered(docs, "n", "doc_id").select("doc_id", "number")


# Distribution

SKETCH = f"""{COLOURED}, parts AS (SELECT DISTINCT canon AS kmer, (color - 1) AS part FROM coloured), coded AS (SELECT {S.code('kmer', KG)} AS code, part FROM parts),
sketch AS (SELECT {S.hashed('code')} & 65535 AS bucket, bit_or(1::BIGINT << (part % 60)) AS mask FROM coded GROUP BY 1),
own AS (SELECT read_id, {S.hashed('code')} & 65535 AS bucket FROM (SELECT read_id, {S.code('canon', KG)} AS code FROM kmers)),
masks AS (SELECT read_id, bit_or(mask) AS mask FROM own JOIN sketch USING (bucket) GROUP BY 1)"""


def _masks(spark, sf_dir):
    reads = lineitem_reads(spark, sf_dir)
    colour = RANGES(K.mini_kmer(F.col("kmer"), KG, M))  # of a k-mer, on either strand
    parts = kmer_counts(reads, KG).select("kmer", ((colour - 1) % 60).cast("int").alias("part"))
    return distribute.read_masks(reads, KG, distribute.sketch(parts, 16), 16)


@query(f"WITH {SKETCH} SELECT read_id, mask FROM masks")
def read_partition_mask(spark, sf_dir):
    return _masks(spark, sf_dir)


@query(f"""
WITH {SKETCH}, placed AS (SELECT read_id, read_id // {10 * 2**32} AS g, row_number() OVER (PARTITION BY read_id // {10 * 2**32} ORDER BY read_id) - 1 AS place FROM reads),
pairs AS (SELECT min(read_id) AS first, max(read_id) FILTER (place % 2 = 1) AS second FROM placed GROUP BY g, place // 2),
dealt AS (SELECT p.part, a.read_id AS r1, b.read_id AS r2, ((a.mask >> p.part) & 1) = 1 AS h1, coalesce(((b.mask >> p.part) & 1) = 1, false) AS h2
  FROM pairs JOIN masks a ON a.read_id = first LEFT JOIN masks b ON b.read_id = second, range(60) AS p(part)),
routed AS (SELECT part, r1 AS read_id, h1 AND h2 AS paired FROM dealt WHERE h1 UNION ALL SELECT part, r2, h1 AND h2 FROM dealt WHERE h2)
SELECT part::INT AS part, paired, count(*) AS reads, min(read_id) AS least FROM routed GROUP BY 1, 2
""")
def read_routing(spark, sf_dir):
    pairs = distribute.neighbours(lineitem_reads(spark, sf_dir), F.expr(f"read_id div {10 * 2**32}"))
    out = distribute.routed(_masks(spark, sf_dir), pairs, 60)
    return out.groupBy("part", "paired").agg(F.count("*").alias("reads"), F.min("read_id").alias("least"))


JUNCTIONS = f"""RECURSIVE {S.LINEITEM_READS}, {S.counts(KG)}, {S.arcs(KG)}, sides AS (SELECT kmer AS id, side, kmer || '|' || side AS name FROM counts, (VALUES ('L'), ('R')) v(side)),
met AS (SELECT src || '|' || side AS a, dst || '|' || dst_side AS b FROM arcs), bare AS (SELECT DISTINCT id FROM sides WHERE name NOT IN (SELECT a FROM met)),
links AS (SELECT a, b FROM met UNION SELECT id || '|L', id || '|R' FROM bare UNION SELECT id || '|R', id || '|L' FROM bare),
reach AS (SELECT name, name AS r FROM sides UNION SELECT reach.name, links.b FROM reach JOIN links ON links.a = reach.r),
placed AS (SELECT id, side, dense_rank() OVER (ORDER BY c) - 1 AS vid FROM (SELECT name, min(r) AS c FROM reach GROUP BY 1) JOIN sides USING (name)),
found AS (SELECT id, max(vid) FILTER (side = 'L') AS l, max(vid) FILTER (side = 'R') AS r FROM placed GROUP BY 1),
sure AS (SELECT l AS vid, r AS next FROM found WHERE l <> r UNION SELECT r, l FROM found WHERE l <> r),
every AS (SELECT count(DISTINCT vid) AS n FROM placed),
single AS (SELECT DISTINCT vid, (vid + 1) % n AS next FROM placed, every WHERE vid NOT IN (SELECT vid FROM sure)),
edges AS (SELECT vid, next FROM sure UNION SELECT vid, next FROM single UNION SELECT next, vid FROM single)"""


def _junctions(spark, sf_dir):
    arcs = stored(half_arcs(lineitem_read_counts(spark, sf_dir), KG).select("src", "side", "dst", "dst_side"), "junction-arcs")
    return stored(distribute.junctions(arcs.select(F.col("src").alias("id")).distinct(), arcs), "junctions")


@query(f"WITH {JUNCTIONS} SELECT id, l AS left_vid, r AS right_vid FROM found")
def kmer_junctions(spark, sf_dir):
    return _junctions(spark, sf_dir)


@query(f"WITH {JUNCTIONS} SELECT 0::BIGINT AS number, (SELECT count(DISTINCT vid) FROM edges) || ' ' || (SELECT count(*) // 2 FROM edges) AS value UNION ALL SELECT vid + 1, string_agg((next + 1)::VARCHAR, ' ' ORDER BY next) FROM edges GROUP BY vid")
def kmer_metis_lines(spark, sf_dir):
    return graphs.metis_lines(distribute.junction_edges(_junctions(spark, sf_dir)))


@query(f"WITH {JUNCTIONS} SELECT id, unnest(list_distinct([l % 5, r % 5]))::INT AS part, l % 5 <> r % 5 AS shared FROM found")
def node_distribution(spark, sf_dir):
    """Nodes dealt out to five partitions of junctions."""
    found = _junctions(spark, sf_dir)
    vids = found.select(F.explode(F.array("left_vid", "right_vid")).alias("vid")).distinct()
    return distribute.dealt_nodes(found, vids.withColumn("part", (F.col("vid") % 5).cast("int")))


@query()
def metis_edges(spark, sf_dir):
    graph = plans.assemble(lineitem_read_counts(spark, sf_dir), GRAPH)
    return distribute.junction_edges(distribute.junctions(graph.nodes, graph.arcs))


@query()
def metis_lines(spark, sf_dir):
    return graphs.metis_lines(metis_edges(spark, sf_dir))


# Streaming


@query(f"WITH {S.LINEITEM_READS}, {S.counts(KG)} SELECT kmer, occ FROM counts")
def growing_graph(spark, sf_dir):
    """K-mer counts of a stream that brings the reads in files."""
    path = stored_path(spark, "stream")
    lineitem_reads(spark, sf_dir).repartition(3, "read_id").write.parquet(path)
    graph = GrowingGraph(spark, KG)
    run = graph.start_available(read_stream(spark, path, 2), stored_path(spark, "stream-checkpoint"))
    run.awaitTermination()
    return graph.nodes()


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
