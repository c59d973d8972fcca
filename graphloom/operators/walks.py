"""Bounded walk expansion: the recursion under k-walks, seeds off paths, walk counts and distances.

A frontier of partial walks is joined with the graph's steps, level by level; a level adds at least one base, so there
are at most k. Finished walks leave the frontier. Every level is written to the shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.operators.graph import char_order, loci, steps
from graphloom.staging import staged


def kwalks(starts: DataFrame, nodes: DataFrame, edges: DataFrame, k: int, prefixes: DataFrame | None = None) -> DataFrame:
    """node_id, node_offset, kmer, walk (array of node ids): every walk of k bases from every start, as a bag.

    Walks that meet an N, or end before k bases, are none. prefixes: a column kmer; walks whose text starts none of these
    are dropped as they grow.
    """
    known = {}
    if prefixes is not None:
        distinct = staged(prefixes.select("kmer").distinct(), "prefixes")
        known = {n: distinct.select(F.left("kmer", F.lit(n)).alias("p")).distinct() for n in range(max(1, k // 4), k, max(1, k // 4))}
        known[k] = distinct.select(F.col("kmer").alias("p"))
    near = steps(nodes, edges)
    text = nodes.select("node_id", "seq")
    front = starts.select("node_id", "node_offset").join(text, "node_id").where(F.col("node_offset") < F.length("seq"))
    front = front.select("node_id", "node_offset", F.col("node_id").alias("cur"), F.expr(f"substr(seq, node_offset + 1, {k})").alias("text"), F.array("node_id").alias("walk"))
    finished = []
    for _ in range(k):
        front = front.where(~F.col("text").contains("N"))
        for n, p in known.items():
            front = _pruned(front, p, n)
        front = staged(front, "walks")
        finished.append(front.where(F.length("text") == k))
        open_walks = front.where(F.length("text") < k)
        if open_walks.isEmpty():
            break
        grown = open_walks.join(near, open_walks.cur == near.src)
        front = grown.select("node_id", "node_offset", F.col("dst").alias("cur"), F.concat("text", F.expr(f"left(dst_seq, {k} - length(text))")).alias("text"), F.concat("walk", F.array("dst")).alias("walk"))
    return reduce(DataFrame.union, finished).select("node_id", "node_offset", F.col("text").alias("kmer"), "walk")


def _pruned(front: DataFrame, prefixes: DataFrame, n: int) -> DataFrame:
    """The walks shorter than n, and the others whose first n bases are known."""
    short = front.where(F.length("text") < n)
    return short.union(front.where(F.length("text") >= n).join(prefixes, F.left("text", F.lit(n)) == F.col("p"), "left_semi"))


def count_kwalks(nodes: DataFrame, edges: DataFrame, k: int, forward: bool = True) -> int:
    """How many k-walks start anywhere, without making them: walks are counted by (node, bases missing)."""
    if not forward:
        raise ValueError("only forward walks can be counted")
    if k == 0:
        return 0
    near = steps(nodes, edges)
    front = loci(nodes).join(nodes.select("node_id", F.length("seq").alias("n")), "node_id")
    front = front.groupBy(F.col("node_id").alias("cur"), (F.lit(k) - F.col("n") + F.col("node_offset")).alias("need")).agg(F.count("*").alias("ways"))
    total = 0
    for _ in range(k + 1):
        front = staged(front, "walk-counts")
        total += front.where("need <= 0").agg(F.coalesce(F.sum("ways"), F.lit(0))).first()[0]
        front = front.where("need > 0")
        if front.isEmpty():
            break
        front = front.join(near, front.cur == near.src).groupBy(F.col("dst").alias("cur"), (F.col("need") - F.col("dst_len")).alias("need")).agg(F.sum("ways").alias("ways"))
    return int(total)


def all_loci(nodes: DataFrame, step: int = 1) -> DataFrame:
    """Starting loci with a given step; the step runs on from node to node by rank within a component."""
    if step == 1:
        return loci(nodes)
    at = loci(nodes).join(char_order(nodes), "node_id").join(nodes.select("node_id", "comp"), "node_id")
    first = at.groupBy("comp").agg(F.min("first").alias("zero"))
    return at.join(first, "comp").where((F.col("first") - F.col("zero") + F.col("node_offset")) % step == 0).select("node_id", "node_offset")


def uncovered_walks(walks: DataFrame, path_steps: DataFrame) -> DataFrame:
    """The walks that are no contiguous part of any path: an anti-join with the paths' node n-grams of the same lengths."""
    w = walks.withColumn("key", F.array_join(F.col("walk").cast("array<string>"), ","))
    lengths = [r[0] for r in w.select(F.size("walk").alias("m")).distinct().collect()]  # at most k
    grams = [path_grams(path_steps, m).select(F.array_join(F.col("gram").cast("array<string>"), ",").alias("key")) for m in lengths]
    if not grams:
        return walks
    return w.join(reduce(DataFrame.union, grams).distinct(), "key", "left_anti").drop("key")


def path_grams(path_steps: DataFrame, m: int) -> DataFrame:
    """path_id, pos, gram: every run of m nodes of every path."""
    w = W.partitionBy("path_id").orderBy("pos")
    ahead = [F.col("node_id"), *(F.lead("node_id", i).over(w) for i in range(1, m))]
    return path_steps.select("path_id", "pos", F.array(*ahead).alias("gram")).where(F.get("gram", F.lit(m - 1)).isNotNull())


def uncovered_loci(nodes: DataFrame, edges: DataFrame, path_steps: DataFrame, k: int, step: int = 1) -> DataFrame:
    """node_id, node_offset where a k-walk starts that no path covers."""
    walks = kwalks(all_loci(nodes, step), nodes, edges, k)
    return uncovered_walks(walks, path_steps).select("node_id", "node_offset").distinct()
