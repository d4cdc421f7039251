"""The k-mer functions by name in Spark SQL, as SQL functions that Catalyst puts into the plan: nothing runs in Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name: (parameters, what is returned, body)
FUNCTIONS = {
    "complement_of": ("seq STRING", "STRING", "translate(seq, 'ACGT', 'TGCA')"),
    "reverse_complement": ("seq STRING", "STRING", "reverse(translate(seq, 'ACGT', 'TGCA'))"),
    "normalised": ("seq STRING", "STRING", "regexp_replace(translate(seq, 'acgt', 'ACGT'), '(?s)[^ACGT]', 'A')"),
    "canonical_kmer": (
        "kmer STRING",
        "STRING",
        "CASE WHEN translate(kmer, 'ACGT', 'TGCA') < reverse(kmer) THEN reverse(translate(kmer, 'ACGT', 'TGCA')) ELSE kmer END",
    ),
    "mini_kmer": ("kmer STRING, m INT", "STRING", "canonical_kmer(substring(kmer, (length(kmer) - m) DIV 2 + 1, m))"),
    "kmer_code": ("kmer STRING", "BIGINT", "CAST(conv(reverse(translate(kmer, 'ACGT', '0123')), 4, 10) AS BIGINT)"),
    "kmer_of_code": ("code BIGINT, k INT", "STRING", "reverse(translate(lpad(conv(CAST(code AS STRING), 10, 4), k, '0'), '0123', 'ACGT'))"),
    "sequence_of_contig": ("a STRING, b STRING, k INT", "STRING", "concat(a, substring(b, k))"),
}
KMERS = """CREATE OR REPLACE TEMPORARY FUNCTION kmers(seq STRING, k INT) RETURNS TABLE (pos INT, kmer STRING, canon STRING, sense_reversed BOOLEAN)
RETURN SELECT pos, kmer, canonical_kmer(kmer), translate(kmer, 'ACGT', 'TGCA') < reverse(kmer)
FROM (SELECT posexplode(CASE WHEN length(kmers.seq) > kmers.k THEN transform(sequence(1, length(kmers.seq) - kmers.k + 1), i -> substring(kmers.seq, i, kmers.k)) END) AS (pos, kmer))"""


def register(spark: SparkSession) -> None:
    """Make the functions known to a session, and the table function kmers(seq, k): pos (from 0), kmer, canon and
    sense_reversed of every k-mer of a sequence that is longer than k."""
    for name, (parameters, returns, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")
    spark.sql(KMERS)
