"""The distance index: pairs of loci with a walk between them of a length in [dmin, dmax].

A pair (v, o, u, p) says that some walk from offset o of node v to offset p of node u has that many bases. Pairs are kept
by character order of both ends: (row, col).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.operators.graph import char_order, loci, steps
from graphloom.staging import staged


def node_distances(nodes: DataFrame, edges: DataFrame, dmax: int) -> DataFrame:
    """src, dst, gap: the distinct distances (bases) from the end of src to the start of dst, up to dmax."""
    near = steps(nodes, edges)
    front = edges.select("src", "dst", F.lit(0).alias("gap")).distinct()
    parts = []
    while True:
        front = staged(front, "gaps")
        if front.isEmpty():
            break
        parts.append(front)
        on = near.select(F.col("src").alias("mid"), F.col("dst").alias("to"))
        size = nodes.select(F.col("node_id").alias("mid"), F.length("seq").alias("n"))
        grown = front.withColumnRenamed("dst", "mid").join(size, "mid").where(F.col("gap") + F.col("n") <= dmax).join(on, "mid")
        front = grown.select("src", F.col("to").alias("dst"), (F.col("gap") + F.col("n")).alias("gap")).distinct()
    return reduce(DataFrame.union, parts).distinct() if parts else front


def distance_pairs(nodes: DataFrame, edges: DataFrame, dmin: int, dmax: int, inner: bool = True) -> DataFrame:
    """v, o, u, p, distinct. inner: also pairs within one node."""
    if dmax == 0:
        dmax = dmin
    if dmax < dmin:
        raise ValueError("dmax must be 0 or at least dmin")
    size = nodes.select("node_id", F.length("seq").alias("n"))
    at = loci(nodes)
    gap = node_distances(nodes, edges, dmax)
    a = gap.join(size.select(F.col("node_id").alias("src"), F.col("n").alias("n1")), "src").join(size.select(F.col("node_id").alias("dst"), F.col("n").alias("n2")), "dst")
    a = a.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n1") - 1))).withColumn("d0", F.col("n1") - F.col("o") + F.col("gap"))
    a = a.where(F.col("d0") <= dmax).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("n2") - 1)))
    out = a.where((F.col("d0") + F.col("p")).between(dmin, dmax)).select(F.col("src").alias("v"), "o", F.col("dst").alias("u"), "p")
    if inner:
        own = at.join(size, "node_id").withColumn("p", F.explode(F.sequence(F.col("node_offset"), F.col("n") - 1)))
        out = out.union(own.where((F.col("p") - F.col("node_offset")).between(dmin, dmax)).select(F.col("node_id").alias("v"), F.col("node_offset").alias("o"), F.col("node_id").alias("u"), "p"))
    return out.distinct()


def as_cells(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """row, col: the pairs by character order."""
    first = char_order(nodes)
    p = pairs.join(first.select(F.col("node_id").alias("v"), F.col("first").alias("f1")), "v").join(first.select(F.col("node_id").alias("u"), F.col("first").alias("f2")), "u")
    return p.select((F.col("f1") + F.col("o")).alias("row"), (F.col("f2") + F.col("p")).alias("col"))


def ranges(cells: DataFrame) -> DataFrame:
    """row, col_lo, col_hi: runs of adjacent columns in a row."""
    c = cells.distinct().withColumn("g", F.col("col") - F.row_number().over(W.partitionBy("row").orderBy("col")))
    return c.groupBy("row", "g").agg(F.min("col").alias("col_lo"), F.max("col").alias("col_hi")).drop("g")


def expand_ranges(r: DataFrame) -> DataFrame:
    return r.select("row", F.explode(F.sequence("col_lo", "col_hi")).alias("col"))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b.select(*a.columns)).distinct()


def without_inner(pairs: DataFrame) -> DataFrame:
    """The pairs of different nodes; those within a node follow from their offsets."""
    return pairs.where("v <> u")


def verify(queries: DataFrame, pairs: DataFrame, dmin: int, dmax: int) -> DataFrame:
    """queries (v, o, u, p) with ok. Within a node only the offsets count."""
    known = pairs.where("v <> u").select("v", "o", "u", "p").distinct().withColumn("found", F.lit(True))
    own = (F.col("p") >= F.col("o")) & (F.col("p") - F.col("o")).between(dmin, dmax)
    return queries.join(known, ["v", "o", "u", "p"], "left").withColumn("ok", F.when(F.col("v") == F.col("u"), own).otherwise(F.coalesce("found", F.lit(False)))).drop("found")


def stats(cells: DataFrame, nodes: DataFrame) -> DataFrame:
    """n_rows, n_cols, n_cells, n_ranges, cells_per_range: the order of the matrix, its non-zero cells, the ranges that
    hold them, and how many cells a range holds (null without any)."""
    spark = cells.sparkSession
    n = nodes.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0)).cast("long")).first()[0]
    full, runs = cells.distinct().count(), ranges(cells).count()
    return spark.createDataFrame([(n, n, full, runs, full / runs if runs else None)], "n_rows long, n_cols long, n_cells long, n_ranges long, cells_per_range double")
