"""Pieces of DuckDB SQL that the oracles of several queries share."""

from __future__ import annotations

from helixframe.operators.kmers import FRAGMENT
from helixframe.sources import reads as R

DOCUMENT_READS = "reads AS (SELECT doc_id AS read_id, regexp_replace(translate(text, 'acgt', 'ACGT'), '[^ACGT]', 'A', 'g') AS seq FROM documents)"

LINEITEM_READS = f"""genome AS (SELECT greatest({R.LEAST}, count(*) // {R.ROWS_PER_BASE}) AS bases FROM lineitem), windows AS (
  SELECT DISTINCT (l_orderkey * 10 + l_linenumber) * {2**32} + l_partkey * {2**12} + l_suppkey AS read_id,
    (l_orderkey * 7919 + l_partkey * 13) % (bases - {R.WIDTH}) AS start,
    CASE WHEN l_suppkey % 20 = 0 THEN l_partkey % {R.WIDTH} ELSE -1 END AS wrong FROM lineitem, genome
), reads AS (
  SELECT read_id, list_aggregate(list_transform(range({R.WIDTH}), lambda i: substr('ACGT', 1 + (
    ((((({R.A} * (start + i) + {R.C}) % {R.P}) * (({R.A} * (start + i) + {R.C}) % {R.P}) % {R.P}) // 7) % 4 + CASE WHEN i = wrong THEN 1 ELSE 0 END) % 4)::INT, 1)), 'string_agg', '') AS seq
  FROM windows
)"""


def comp(x: str) -> str:
    return f"translate({x}, 'ACGT', 'TGCA')"


def rc(x: str) -> str:
    return f"reverse({comp(x)})"


def reversed_(x: str) -> str:
    return f"({comp(x)} < reverse({x}))"


def canon(x: str) -> str:
    return f"(CASE WHEN {reversed_(x)} THEN {rc(x)} ELSE {x} END)"


def mini(x: str, k: int, m: int) -> str:
    return canon(f"substr({x}, {(k - m) // 2 + 1}, {m})")


def code(x: str, k: int) -> str:
    return f"list_sum(list_transform(range({k}), lambda i: (instr('ACGT', substr({x}, i + 1, 1)) - 1)::BIGINT << (2 * i)))::BIGINT"


def hashed(x: str) -> str:
    return f"xor(xor(xor({x}, {x} >> 17), {x} >> 37), {x} << 11)"


def words(k: int, width: int, name: str = "words") -> str:
    """CTEs that end with read_id, pos, word: all substrings of that width of reads longer than k."""
    return f"""{name}_cut AS (
  SELECT read_id, first_at, substr(seq, (first_at + 1)::INT, {FRAGMENT + width - 1}) AS piece
  FROM (SELECT read_id, seq, unnest(range(0, length(seq) - {width} + 1, {FRAGMENT})) AS first_at FROM reads WHERE length(seq) > {k})
), {name} AS (
  SELECT read_id, first_at + i AS pos, substr(piece, (i + 1)::INT, {width}) AS word
  FROM (SELECT *, unnest(range(0, length(piece) - {width} + 1)) AS i FROM {name}_cut)
)"""


def kmers(k: int) -> str:
    return f"{words(k, k)}, kmers AS (SELECT read_id, pos, word AS kmer, {canon('word')} AS canon, {reversed_('word')} AS sense_reversed FROM words)"


def counts(k: int) -> str:
    return f"{words(k, k)}, counts AS (SELECT {canon('word')} AS kmer, count(*) AS occ FROM words GROUP BY 1)"


def arcs(k: int, most: int | None = 125) -> str:
    """CTEs that end with arcs: src, side, base, weight, dst, dst_side, sense_changed."""
    weight = "sum(n)" if most is None else f"least(sum(n), {most})"
    return f"""{words(k, k + 1, 'longer')}, pairs AS (
  SELECT word, substr(word, 1, {k}) AS a, substr(word, 2, {k}) AS b, count(*) AS n FROM longer GROUP BY word
), oriented AS (
  SELECT n, {canon('a')} AS ca, {reversed_('a')} AS ar, {canon('b')} AS cb, {reversed_('b')} AS br, substr(word, 1, 1) AS dropped, substr(word, {k + 1}, 1) AS added
  FROM pairs
), halves AS (
  SELECT ca AS src, CASE WHEN ar THEN 'L' ELSE 'R' END AS side, CASE WHEN ar THEN {comp('added')} ELSE added END AS base,
    cb AS dst, CASE WHEN br THEN 'R' ELSE 'L' END AS dst_side, ar <> br AS sense_changed, n FROM oriented
  UNION ALL
  SELECT cb, CASE WHEN br THEN 'R' ELSE 'L' END, CASE WHEN br THEN {comp('dropped')} ELSE dropped END,
    ca, CASE WHEN ar THEN 'L' ELSE 'R' END, ar <> br, n FROM oriented
), arcs AS (
  SELECT src, side, base, dst, dst_side, sense_changed, ({weight})::INT AS weight FROM halves GROUP BY src, side, base, dst, dst_side, sense_changed
)"""
