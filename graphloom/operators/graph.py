"""The sequence graph: character order, steps, breadth-first levels, components, induced graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.staging import staged


def prefix_sums(df: DataFrame, order: str, value: str, out: str, bucket: int = 65_536) -> DataFrame:
    """df with out: the sum of value over all rows of smaller order (an integer, distinct).

    Two levels: totals of order ranges are summed in a window over few rows, then each range has a window of its own,
    so no task sees the whole table.
    """
    b = df.withColumn("__b", F.floor(F.col(order) / bucket))
    totals = b.groupBy("__b").agg(F.sum(value).alias("__t"))
    before = totals.select("__b", F.coalesce(F.sum("__t").over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    within = F.coalesce(F.sum(value).over(W.partitionBy("__b").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return b.join(before, "__b").withColumn(out, (within + F.col("__before")).cast("long")).drop("__b", "__before")


def char_order(nodes: DataFrame) -> DataFrame:
    """node_id, first: the 0-based index of each node's first base over all nodes by rank."""
    return prefix_sums(nodes.select("node_id", "rank", "len"), "rank", "len", "first").select("node_id", "first")


def steps(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """src, dst, dst_seq, dst_len: edges with what they lead to."""
    return edges.select("src", "dst").join(nodes.select(F.col("node_id").alias("dst"), F.col("seq").alias("dst_seq"), F.length("seq").alias("dst_len")), "dst")


def loci(nodes: DataFrame) -> DataFrame:
    """node_id, node_offset of every base."""
    return nodes.where("length(seq) > 0").select("node_id", F.explode(F.sequence(F.lit(0), F.length("seq") - 1)).alias("node_offset"))


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, comp: the smallest node id connected with each node, by rounds of minima with pointer jumping."""
    both = staged(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src")).distinct(), "both-ways")
    label = staged(nodes.select("node_id", F.col("node_id").alias("comp")), "components")
    while True:
        near = both.join(label, both.b == label.node_id).groupBy(F.col("a").alias("node_id")).agg(F.min("comp").alias("m"))
        lower = label.join(near, "node_id", "left").select("node_id", F.col("comp").alias("old"), F.least("comp", F.coalesce("m", "comp")).alias("c"))
        far = label.select(F.col("node_id").alias("c"), F.col("comp").alias("f"))
        after = staged(lower.join(far, "c").select("node_id", "old", F.least("c", "f").alias("comp")), "components")
        done = after.where("old <> comp").limit(1).isEmpty()
        label = after.select("node_id", "comp")
        if done:
            return label


def bfs_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, level: breadth-first levels in every component, from its node of lowest rank; what is not reached from
    there starts again, at level 0, at the lowest rank left.

    One table is written for each level; what has been seen is the union of the levels, rewritten as one now and then.
    """
    near = edges.select("src", "dst")
    seen: list[DataFrame] = []
    while True:
        left = nodes.select("node_id", "rank", "comp")
        left = left.join(union(seen).select("node_id"), "node_id", "left_anti") if seen else left
        first = left.groupBy("comp").agg(F.min_by("node_id", "rank").alias("node_id"))
        front = staged(first.select("node_id", F.lit(0).alias("level")), "front")
        if front.isEmpty():
            return union(seen) if seen else front
        while True:
            seen.append(front)
            if len(seen) == 16:
                seen = [staged(union(seen), "seen")]
            after = front.join(near, front.node_id == near.src).select(F.col("dst").alias("node_id"), (F.col("level") + 1).alias("level")).distinct()
            front = staged(after.join(union(seen).select("node_id"), "node_id", "left_anti"), "front")
            if front.isEmpty():
                break


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


def topological_violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """n_edges, n_backward: edges, and those that do not lead to a higher rank."""
    r = nodes.select("node_id", "rank")
    e = edges.join(r.select(F.col("node_id").alias("src"), F.col("rank").alias("r1")), "src").join(r.select(F.col("node_id").alias("dst"), F.col("rank").alias("r2")), "dst")
    return e.agg(F.count("*").alias("n_edges"), F.count_if(F.col("r1") >= F.col("r2")).alias("n_backward"))


def component_ranks(path_steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """rank of the first node of every embedded path."""
    s = path_steps.join(nodes.select("node_id", "rank"), "node_id")
    return s.groupBy("path_id").agg(F.min_by("rank", "pos").alias("first_rank"))


def induced_nodes(path_steps: DataFrame) -> DataFrame:
    return path_steps.select("node_id").distinct()


def induced_edges(path_steps: DataFrame) -> DataFrame:
    """src, dst of consecutive steps, once each."""
    after = F.lead("node_id").over(W.partitionBy("path_id").orderBy("pos"))
    return path_steps.select(F.col("node_id").alias("src"), after.alias("dst")).where("dst is not null").distinct()


def chunk_of(order: Column, size: int) -> Column:
    """The chunk of at most size rows that a dense order falls in."""
    return F.floor(order / size)
