"""K-mers as Column expressions, on strings and, for k up to 31, on 64-bit codes.

A code holds base i in bits 2i and 2i+1 (A 0, C 1, G 2, T 3), so the last base counts most and codes are in the order of
the reversed strings. That order decides which of a k-mer and its reverse complement is canonical.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES, COMPLEMENTS = "ACGT", "TGCA"
MAX_WEIGHT = 125


def normalise(text: Column) -> Column:
    """Upper-case ACGT; every other character becomes A."""
    return F.regexp_replace(F.translate(text, "acgt", BASES), "(?s)[^ACGT]", "A")


def known_stretches(text: Column) -> Column:
    """The stretches of known bases of a read, cut at everything else, as an array."""
    return F.filter(F.split(F.translate(text, "acgt", BASES), "[^ACGT]+"), lambda x: F.length(x) > 0)


def complement(seq: Column) -> Column:
    return F.translate(seq, BASES, COMPLEMENTS)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def is_reversed(kmer: Column) -> Column:
    """Whether the reverse complement is the canonical form."""
    return complement(kmer) < F.reverse(kmer)


def canonical(kmer: Column) -> Column:
    return F.when(is_reversed(kmer), reverse_complement(kmer)).otherwise(kmer)


def mini_kmer(kmer: Column, k: int, m: int) -> Column:
    """The canonical middle m bases; k - m must be even."""
    if m > k or (k - m) % 2 or not m % 2:
        raise ValueError("mini-k-mers must be odd, no longer than k and in the middle")
    return canonical(F.substring(kmer, (k - m) // 2 + 1, m))


def encode(kmer: Column) -> Column:
    """The code of a k-mer of up to 31 bases."""
    return F.conv(F.reverse(F.translate(kmer, BASES, "0123")), 4, 10).cast("long")


def decode(code: Column, k: int) -> Column:
    return F.reverse(F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", BASES))


def mask(k: int) -> int:
    return (1 << 2 * k) - 1


def mask_kmer(code: Column, k: int) -> Column:
    return code.bitwiseAND(F.lit(mask(k)))


def append_base(code: Column, base: Column, k: int) -> Column:
    return F.shiftright(code, 2).bitwiseOR(F.shiftleft(base.cast("long"), 2 * k - 2))


def prepend_base(code: Column, base: Column, k: int) -> Column:
    return mask_kmer(F.shiftleft(code, 2).bitwiseOR(base.cast("long")), k)


def base_at(code: Column, i: int) -> Column:
    return F.shiftright(code, 2 * i).bitwiseAND(F.lit(3))


def with_base(code: Column, i: int, base: Column) -> Column:
    return code.bitwiseAND(F.lit(~(3 << 2 * i))).bitwiseOR(F.shiftleft(base.cast("long"), 2 * i))


def hashed(code: Column) -> Column:
    """A cheap mix of a code's bits, for bucket numbers."""
    mixed = code.bitwiseXOR(F.shiftrightunsigned(code, 17)).bitwiseXOR(F.shiftrightunsigned(code, 37))
    return mixed.bitwiseXOR(F.shiftleft(code, 11))


def joined(left: Column, right: Column, k: int) -> Column:
    """Two sequences that overlap in k - 1 bases as one."""
    return F.concat(left, F.substring(right, k, 2**30))


def windows(seq: Column, width: int, first: Column | int = 1, count: Column | None = None) -> Column:
    """All substrings of that width that begin at `first` or later, as an array."""
    last = F.length(seq) - width + 1 if count is None else F.least(F.length(seq) - width + 1, first + count - 1)
    return F.transform(F.sequence(F.lit(first) if isinstance(first, int) else first, last), lambda i: F.substring(seq, i, F.lit(width)))


def all_windows(seq: Column, width: int) -> Column:
    """All substrings of that width, as an array; of stretches first, since a substring is looked for from the beginning."""
    starts = F.sequence(F.lit(1), F.length(seq) - width + 1, F.lit(500))
    return F.flatten(F.transform(F.transform(starts, lambda i: F.substring(seq, i, F.lit(500 + width - 1))), lambda x: windows(x, width)))


def saturated(weight: Column, most: int = MAX_WEIGHT) -> Column:
    return F.least(weight, F.lit(most))


def round_up_power(n: int, base: int = 4, most: int = 65534) -> int:
    """The least power of base that is n or more; partition counts are rounded so."""
    p = 1
    while p < n:
        p *= base
    if not 0 < p <= most:
        raise ValueError(f"{n} partitions are too few or too many")
    return p


def parse_unsigned(text: str, most: int = 2**64 - 1) -> int:
    """Decimal, 0x hexadecimal or 0 octal."""
    text = text.strip()
    n = int(text, 8) if len(text) > 1 and text[0] == "0" and text.isdigit() else int(text, 0)
    if not 0 <= n <= most:
        raise ValueError(f"{text} is out of range")
    return n


def check_k(k: int) -> int:
    """k must be odd, so that no k-mer is its own reverse complement."""
    if k < 1 or not k % 2:
        raise ValueError("k must be odd")
    return k
