"""k-mers of sequences: policies that choose where seeds start, and successors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POLICIES = ("overlapping", "non_overlapping", "greedy_non_overlapping")


def offsets(length: Column, k: int, step: int = 1, policy: str = "overlapping") -> Column:
    """Where seeds start, for length >= k.

    overlapping: every step bases; non_overlapping: every k; greedy_non_overlapping: multiples of k below length - k, and
    then always the last k-mer.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy}")
    if policy == "greedy_non_overlapping":
        before = F.when(length > k, F.sequence(F.lit(0), F.greatest(length - k - 1, F.lit(0)), F.lit(k))).otherwise(F.array().cast("array<int>"))
        return F.concat(before, F.array(length - k))
    return F.sequence(F.lit(0), F.greatest(length - k, F.lit(0)), F.lit(k if policy == "non_overlapping" else step))


def kmers(df: DataFrame, k: int, step: int = 1, policy: str = "overlapping", key: tuple[str, ...] = ("read_id",), seq: str = "seq", at: str = "read_offset") -> DataFrame:
    """key columns, the start and the k-mer. Sequences shorter than k have none."""
    long = df.where(F.length(seq) >= k).select(*key, seq, F.explode(offsets(F.length(seq), k, step, policy)).alias(at))
    return long.select(*key, at, F.expr(f"substr({seq}, {at} + 1, {k})").alias("kmer"))


def distinct_kmers(df: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """The distinct k-mers and how often each occurs (a text index's enumeration)."""
    return kmers(df, k, key=(), seq=seq, at="at").groupBy("kmer").agg(F.count("*").alias("n"))


def next_kmer(kmer: Column) -> Column:
    """The lexicographic successor over ACGT; the last one wraps to the first."""
    n = F.length(kmer)
    kept = F.rtrim(kmer, F.lit("T"))
    m = F.length(kept)
    raised = F.concat(F.left(kept, m - 1), F.translate(F.right(kept, F.lit(1)), "ACG", "CGT"), F.repeat(F.lit("A"), n - m))
    return F.when(m == 0, F.repeat(F.lit("A"), n)).otherwise(raised)


def kmer_number(kmer: Column) -> Column:
    """The rank of a k-mer among all of its length (base 4)."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")
