"""Simulated reads. All choices are hashes of (seed, haplotype, read), so runs and engines agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.scalar import hashed_index, hashed_uniform, reverse_complement


def reads_per_haplotype(haplotypes: DataFrame, total: int, read_length: int) -> DataFrame:
    """hap_id, n_reads: in proportion to length, rounded down; the rest goes one by one to the first haplotypes by id.

    haplotypes: hap_id, length. Those shorter than a read get none.
    """
    long = haplotypes.where(F.col("length") >= read_length)
    bases = long.agg(F.sum("length").alias("all"))
    n = long.join(F.broadcast(bases)).select("hap_id", "length", F.floor(F.lit(total) * F.col("length") / F.col("all")).cast("long").alias("n"))
    given = n.agg(F.sum("n").alias("given"))
    order = F.row_number().over(W.orderBy("hap_id"))
    full = n.withColumn("i", order).join(F.broadcast(given)).select("hap_id", (F.col("n") + F.when(F.col("i") <= F.lit(total) - F.col("given"), 1).otherwise(0)).alias("n_reads"))
    return haplotypes.select("hap_id").join(full, "hap_id", "left").select("hap_id", F.coalesce("n_reads", F.lit(0)).cast("long").alias("n_reads"))


def single_end(texts: DataFrame, counts: DataFrame, length: int, error: float = 0.0, indel: float = 0.0, seed: int = 0, tries: int = 100) -> DataFrame:
    """hap_id, i, pos, strand, seq, qual: reads at hashed positions, strands in turn, none with an N (of up to `tries`
    draws). error: chance of a wrong base; indel: the share of errors that insert or delete instead.

    texts: hap_id, text; counts: hap_id, n_reads.
    """
    room = F.length("text") - length + 1
    r = texts.join(counts, "hap_id").where((F.col("n_reads") > 0) & (room > 0)).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_reads") - 1)))
    draws = F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), lambda t: hashed_index(room, "hap_id", "i", t, seed=seed)) if tries > 1 else F.array(hashed_index(room, "hap_id", "i", F.lit(0), seed=seed))
    clean = F.filter(draws, lambda p: ~F.substring("text", p + 1, F.lit(length)).contains("N"))
    r = r.withColumn("pos", F.get(clean, F.lit(0))).where("pos is not null")
    r = r.withColumn("strand", F.when(F.col("i") % 2 == 0, "F").otherwise("R")).withColumn("raw", F.substring("text", F.col("pos") + 1, F.lit(length)))
    r = r.withColumn("raw", F.when(F.col("strand") == "F", F.col("raw")).otherwise(reverse_complement("raw")))
    if error > 0:
        bases = F.transform(F.sequence(F.lit(1), F.lit(length)), lambda j: _erred(j, error, indel, seed))
        r = r.withColumn("raw", F.left(F.rpad(F.concat_ws("", bases), length, "A"), F.lit(length)))
    return r.select("hap_id", "i", "pos", "strand", F.col("raw").alias("seq"), F.repeat(F.lit("I"), F.length("raw")).alias("qual"))


def _erred(j, error: float, indel: float, seed: int):
    """The j-th base of raw, perhaps replaced, left out or doubled by another one."""
    base = F.substring("raw", j, F.lit(1))
    u = hashed_uniform("hap_id", "i", j, seed=seed + 1)
    turn = hashed_index(F.lit(3), "hap_id", "i", j, seed=seed + 2)
    other = F.when(turn == 0, F.translate(base, "ACGTN", "CGTAA")).when(turn == 1, F.translate(base, "ACGTN", "GTACC")).otherwise(F.translate(base, "ACGTN", "TACGG"))
    return F.when(u >= error, base).when(u >= error * indel, other).when(u >= error * indel / 2, F.lit("")).otherwise(F.concat(base, other))


def paired_end(texts: DataFrame, counts: DataFrame, length: int, distance: int, error: float = 0.0, seed: int = 0) -> DataFrame:
    """hap_id, i, pos, mate, seq, qual: two reads at the ends of fragments of `distance` bases, facing each other."""
    f = single_end(texts, counts, distance, 0.0, 0.0, seed).withColumn("fragment", F.when(F.col("strand") == "F", F.col("seq")).otherwise(reverse_complement("seq")))
    mates = F.array(
        F.struct(F.lit(1).alias("mate"), F.left("fragment", F.lit(length)).alias("seq")), F.struct(F.lit(2).alias("mate"), reverse_complement(F.right("fragment", F.lit(length))).alias("seq"))
    )
    return f.select("hap_id", "i", "pos", F.explode(mates).alias("m")).select("hap_id", "i", "pos", "m.mate", "m.seq", F.repeat(F.lit("I"), F.lit(length)).alias("qual"))
