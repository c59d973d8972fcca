"""Seeds of arriving reads: a stateless stream-static join with the path index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.functions.kmers import kmers


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def seeds_stream(reads: DataFrame, path_kmers: DataFrame, k: int, step: int = 0, limit: int = 0) -> DataFrame:
    """Seeds on paths of a stream of reads (read_id, seq). path_kmers is static; its counts are taken once a batch."""
    n = path_kmers.groupBy("kmer").agg(F.count("*").alias("gocc"))
    n = n if limit == 0 else n.where(F.col("gocc") <= limit)
    index = path_kmers.join(n, "kmer").where("not contains(kmer, 'N')")
    hits = kmers(reads, k, step or k).join(index, "kmer")
    return hits.select("node_id", "node_offset", "read_id", "read_offset", F.lit(k).alias("match_len"), "gocc")


def start(seeds: DataFrame, out: str, checkpoint: str, callback: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Run over what has arrived; seeds go to Parquet, or each batch to a callback."""
    w = seeds.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return w.foreachBatch(callback).start() if callback else w.format("parquet").option("path", out).start()
