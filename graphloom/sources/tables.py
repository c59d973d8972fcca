"""Indexes and results as Parquet tables, with a check that an index fits the query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VERSION = 1


class IndexMismatch(ValueError):
    """A saved index was made with other parameters."""


def save(df: DataFrame, path: str, kind: str, **parameters: int | str | bool) -> None:
    """df under path/data, and one row of kind and parameters under path/meta."""
    df.write.mode("overwrite").parquet(f"{path}/data")
    meta = ", ".join(f"{k}={parameters[k]}" for k in sorted(parameters))
    df.sparkSession.createDataFrame([(VERSION, kind, meta)], "version int, kind string, parameters string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load(spark: SparkSession, path: str, kind: str, **parameters: int | str | bool) -> DataFrame:
    """The saved table; IndexMismatch if it is of another kind or was made with other parameters."""
    got = spark.read.parquet(f"{path}/meta").first()
    want = ", ".join(f"{k}={parameters[k]}" for k in sorted(parameters))
    if (got["version"], got["kind"], got["parameters"]) != (VERSION, kind, want):
        raise IndexMismatch(f"{path} holds {got['kind']} ({got['parameters']}), not {kind} ({want})")
    return spark.read.parquet(f"{path}/data")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/meta/_SUCCESS")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def loci_name(prefix: str, k: int, step: int) -> str:
    return f"{prefix}_loci_k{k}_step{step}"


def distance_name(prefix: str, dmin: int, dmax: int) -> str:
    return f"{prefix}_distances_{dmin}_{dmax}"


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_loci(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """node_id, node_offset from Parquet or JSON."""
    return spark.read.schema("node_id long, node_offset int").format(form).load(path)
