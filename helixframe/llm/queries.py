"""The registered queries of this subpackage: thin wrappers that give each operator its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from helixframe.session import table


def op1_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.llm.near_dups import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op2_suffix_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.llm.suffixes import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), length=50)


def op3_quadratic_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.llm.quality import fit_quality, held_out, score_quality

    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = score_quality(docs, model, threshold=0.3)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op4_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.llm.sharding import shard_by_splitters

    return shard_by_splitters(table(spark, sf_dir, "documents"), shards=40)


def op5_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.llm.neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op6_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.llm.warc import round_trip

    read = round_trip(table(spark, sf_dir, "pages"), min_bytes=0)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), named AS (
  SELECT page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + (((('0x' || substr(h, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31))::BIGINT, 1)), 'string_agg', '') AS payload_digest
  FROM hashed
), firsts AS (SELECT payload_digest, min(page_id) AS first FROM named GROUP BY payload_digest)
SELECT page_id, payload_bytes, n.payload_digest AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM named n JOIN firsts f ON n.payload_digest = f.payload_digest
"""


def op7_whole_token_shortcut(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.llm.tokens import token_counts

    return token_counts(table(spark, sf_dir, "documents"), limit=512)


def op8_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.llm.decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_variable_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op10_markov_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.llm.urls import Rule, judge_urls

    rules = (
        Rule("net", "/", "block"),
        Rule("example.net", "/en/", "allow"),
        Rule("example.com", "/de/", "block"),
        Rule("org", "/fr/", "allow"),
    )
    return judge_urls(table(spark, sf_dir, "pages"), rules)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_minhash_forest,
        op2_suffix_merge,
        op3_quadratic_discriminant,
        op4_sampled_splitters,
        op5_hash_prefix_forest,
        op6_revisit_resolution,
        op7_whole_token_shortcut,
        op8_block_max_wand,
        op9_variable_capacity,
        op10_markov_ratio,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op6_revisit_resolution": OP6_SQL}
