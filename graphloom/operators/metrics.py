"""Metrics over tables of runs, and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def run_metrics(runs: DataFrame) -> DataFrame:
    """runs (run, k, read_length, n_reads, hits, off_hits, query_s, traverse_s, loci, index_bytes) with derived metrics."""
    r = F.col
    return runs.select(
        "run",
        (r("hits") / ((r("read_length") - r("k") + 1) * r("n_reads"))).alias("sensitivity"),
        (r("query_s") * 1e3 / (F.floor(r("read_length") / r("k")) * r("n_reads"))).alias("kmer_query_ms"),
        (r("query_s") * 1e6 / F.nullif("hits", F.lit(0))).alias("us_per_hit"),
        ((r("hits") - r("off_hits")) / F.nullif("hits", F.lit(0))).alias("on_path_share"),
        (r("traverse_s") / 3600).alias("traverse_h"),
        (r("traverse_s") / F.nullif("loci", F.lit(0))).alias("traverse_s_per_locus"),
        (r("index_bytes") / (1024.0 * 1024)).alias("index_mb"),
    )


def cumulative_shares(counts: DataFrame) -> DataFrame:
    """run, class, share, cumulative of counts (run, class, n), in order of class."""
    share = F.col("n") / F.sum("n").over(W.partitionBy("run"))
    c = F.sum("n").over(W.partitionBy("run").orderBy("class").rowsBetween(W.unboundedPreceding, 0)) / F.sum("n").over(W.partitionBy("run"))
    return counts.select("run", "class", share.alias("share"), c.alias("cumulative"))


def long_form(wide: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, name, value."""
    return wide.unpivot([key], columns, "name", "value")


def histogram(df: DataFrame, column: str, width: int = 1) -> DataFrame:
    """bin, n."""
    return df.groupBy((F.floor(F.col(column) / width) * width).cast("long").alias("bin")).agg(F.count("*").alias("n"))
