"""Column helpers for DNA text: all built-in expressions, all inside codegen.

A k-mer is a string of letters A, C, G, T; its canonical form is the smaller of
the word and its reverse complement. For k <= 31 a k-mer packs into one BIGINT
(A=0, C=1, G=2, T=3, first letter most significant), whose numeric order equals
the lexicographic order of the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise(seq: Column) -> Column:
    """Upper-case acgt; any other character becomes N."""
    return F.regexp_replace(F.upper(seq), "[^ACGT]", "N")


def bases(seq: Column) -> Column:
    """Letters as the graph sees them: unknown bases count as A."""
    return F.regexp_replace(F.upper(seq), "[^ACGT]", "A")


def revcomp(seq: Column) -> Column:
    """Reverse complement; letters other than ACGT become A."""
    return F.translate(F.reverse(seq), "ACGTN", "TGCAA")


def canonical(word: Column) -> Column:
    return F.least(word, revcomp(word))


def is_kmer(word: Column, k: int) -> Column:
    """True for exactly k letters out of ACGT (null is no k-mer)."""
    return F.coalesce((F.length(word) == k) & (F.translate(word, "ACGT", "") == ""), F.lit(False))


def pack(word: Column) -> Column:
    """BIGINT code of an upper-case k-mer, k <= 31."""
    return F.conv(F.translate(word, "ACGT", "0123"), 4, 10).cast("bigint")


def unpack(code: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def canonical_code(text: Column, k: int = 31) -> Column:
    """Packed canonical form of a k-mer in any letter case, null for other text."""
    up = F.upper(text)
    return F.when(is_kmer(up, k), pack(F.least(up, F.translate(F.reverse(up), "ACGT", "TGCA"))))


#: Bases cut out at once: taking a substring walks the text from its start, so long texts are cut in two steps.
BLOCK = 2048


def kmer_positions(seq: Column, k: int) -> Column:
    """Array of structs (pos, word) of all k-mers of `seq`, 0-based; empty if shorter than k."""

    def words(text: Column, first: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.length(text) - k),
            lambda p: F.struct((first + p).alias("pos"), F.substring(text, p + 1, F.lit(k)).alias("word")),
        )

    blocks = F.transform(
        F.sequence(F.lit(0), F.length(seq) - k, F.lit(BLOCK)),
        lambda at: F.struct(at.alias("at"), F.substring(seq, at + 1, F.lit(BLOCK + k - 1)).alias("text")),
    )
    long_ = F.flatten(F.transform(blocks, lambda b: words(b["text"], b["at"])))
    empty = F.array().cast("array<struct<pos:int,word:string>>")
    return F.when(F.length(seq) < k, empty).when(F.length(seq) <= BLOCK, words(seq, F.lit(0))).otherwise(long_)


def kmer_length(seq: Column, k: int) -> Column:
    """Sequence length counted in k-mers; not positive for short reads."""
    return F.length(seq) - (k - 1)
