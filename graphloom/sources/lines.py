"""Text lines with their number in the file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str, keep: Column | None = None) -> DataFrame:
    """file, line (0-based among the file's kept lines), value.

    Spark packs the splits of several files into partitions by their size, so neither partitions nor row ids follow a
    file's order. Lines are numbered within each split, and splits by the byte where they begin: only one row a split is
    gathered, by file. A compressed file is one split.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    if keep is not None:
        raw = raw.where(keep)
    at = raw.withColumn("at", F.monotonically_increasing_id())
    splits = at.groupBy("file", "split").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("file", "split", (before - F.col("first")).alias("shift"))
    return at.join(splits, ["file", "split"]).select("file", (F.col("at") + F.col("shift")).alias("line"), "value")


def numbered_records(records: DataFrame, out: str, n: str = "n") -> DataFrame:
    """records (file, line, ...) with out: their number over all files, files in order of their names.

    n: how many records a file has; the totals, one row a file, are summed in a window.
    """
    totals = records.groupBy("file").agg(F.count("*").alias(n), F.min("line").alias("least"))
    before = F.coalesce(F.sum(n).over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return records.join(totals.select("file", (before - F.col("least")).alias("shift")), "file").withColumn(out, F.col("line") + F.col("shift")).drop("shift")
