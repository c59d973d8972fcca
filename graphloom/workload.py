"""A deterministic graph, paths and reads derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DNA = "translate(md5(concat('{0}', cast({1} as string))), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, rank, comp, len, seq: a node for each part, 50 in a component, with 1 to 8 bases."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    seq = F.expr(f"substr({DNA.format('n', 'p_partkey')}, 1, cast(1 + p_partkey % 8 as int))")
    return part.select(
        (F.col("p_partkey") + 1).alias("node_id"), (F.col("p_partkey") + 1).alias("rank"), F.floor(F.col("p_partkey") / 50).cast("long").alias("comp"), F.length(seq).alias("len"), seq.alias("seq")
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: a chain of bubbles; every node leads to the next two of its component."""
    n = nodes(spark, sf_dir).select("node_id", "comp")
    step = n.withColumn("dst", F.explode(F.array(F.col("node_id") + 1, F.col("node_id") + 2)))
    return step.join(n.select(F.col("node_id").alias("dst"), F.col("comp").alias("c")), "dst").where("comp = c").select(F.col("node_id").alias("src"), "dst")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id, name, seq: 32 bases for each customer."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select(F.col("c_custkey").alias("read_id"), F.concat(F.lit("r"), "c_custkey").alias("name"), F.expr(DNA.format("r", "c_custkey")).alias("seq"))


def path_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path_id, pos, node_id: for each component, every second node (2 comp) and every node (2 comp + 1)."""
    at = (F.col("node_id") - 1) % 50
    n = nodes(spark, sf_dir).select("comp", "node_id", at.alias("i"))
    every = n.select((F.col("comp") * 2 + 1).alias("path_id"), F.col("i").cast("int").alias("pos"), "node_id")
    second = n.where("i % 2 = 0").select((F.col("comp") * 2).alias("path_id"), (F.col("i") / 2).cast("int").alias("pos"), "node_id")
    return second.union(every)
