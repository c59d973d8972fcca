"""GFA 1 and 2 text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.operators.graph import weak_components


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """f (fields) of every line. Only .gfa files, also compressed ones, are taken."""
    if not any(x in path.lower() for x in (".gfa", "*")):
        raise ValueError(f"not a GFA path: {path}")
    return spark.read.text(path).select(F.split("value", "\t").alias("f")).where("size(f) > 1")


def _number(name: str) -> F.Column:
    return F.regexp_replace(F.expr(name), "[+-]$", "").cast("long")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, edges and path_steps. Ranks follow node ids; overlaps and orientations are kept and not followed."""
    lines = read_lines(spark, path)
    two = F.expr("try_cast(f[2] as int)").isNotNull() & (F.size("f") > 3)
    seg = lines.where("f[0] = 'S'").select(F.expr("cast(f[1] as long)").alias("node_id"), F.upper(F.when(two, F.expr("f[3]")).otherwise(F.expr("f[2]"))).alias("seq"))
    e2 = lines.where("f[0] = 'E'").select(_number("f[2]").alias("src"), _number("f[3]").alias("dst"), F.expr("f[2] like '%-'").alias("from_start"), F.expr("f[3] like '%-'").alias("to_end"), F.lit(0).alias("overlap"))
    e1 = lines.where("f[0] = 'L'").select(
        F.expr("cast(f[1] as long)").alias("src"), F.expr("cast(f[3] as long)").alias("dst"), F.expr("f[2] = '-'").alias("from_start"), F.expr("f[4] = '-'").alias("to_end"),
        F.coalesce(F.expr("try_cast(regexp_extract(f[5], '([0-9]+)M', 1) as int)"), F.lit(0)).alias("overlap"),
    )
    edges = e2.union(e1)
    p2 = lines.where("f[0] = 'O'").select(F.expr("f[1]").alias("path_name"), F.split(F.expr("f[2]"), " ").alias("s"))
    p1 = lines.where("f[0] = 'P'").select(F.expr("f[1]").alias("path_name"), F.split(F.expr("f[2]"), ",").alias("s"))
    named = p2.union(p1)
    # only the names are ranked in one task, not the paths themselves
    ranks = named.select("path_name").distinct().select("path_name", (F.row_number().over(W.orderBy("path_name")) - 1).cast("long").alias("path_id"))
    steps = named.join(ranks, "path_name").select("path_id", "path_name", F.posexplode("s").alias("pos", "x"))
    steps = steps.select("path_id", "path_name", "pos", _number("x").alias("node_id"), F.col("x").endswith("-").alias("is_reverse"))
    comp = weak_components(seg.select("node_id"), edges)
    nodes = seg.join(comp, "node_id").select("node_id", F.col("node_id").alias("rank"), "comp", F.length("seq").alias("len"), "seq")
    return nodes, edges, steps


def region_paths(lines: DataFrame, name: str = "^SN:Z:chr") -> DataFrame:
    """value: a P line for every S line that begins a region (tag SN:Z: of the name and SO:i:0)."""
    tag = F.filter("f", lambda x: x.rlike(name))
    first = lines.where("f[0] = 'S'").where((F.size(tag) > 0) & F.array_contains("f", "SO:i:0"))
    return first.select(F.concat_ws("\t", F.lit("P"), F.substr(F.get(tag, F.lit(0)), F.lit(6)), F.concat(F.expr("f[1]"), F.lit("+")), F.lit("*")).alias("value"))


def write_gfa(nodes: DataFrame, edges: DataFrame, path_steps: DataFrame, path: str) -> None:
    """GFA 1 text, sorted by line type within the files."""
    s = nodes.select(F.concat_ws("\t", F.lit("S"), "node_id", "seq").alias("value"))
    e = edges.select(F.concat_ws("\t", F.lit("L"), "src", F.lit("+"), "dst", F.lit("+"), F.lit("0M")).alias("value"))
    named = path_steps.groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct("pos", "node_id"))).alias("s"))
    p = named.select(F.concat_ws("\t", F.lit("P"), F.col("path_id").cast("string"), F.array_join(F.transform("s", lambda x: F.concat(x["node_id"].cast("string"), F.lit("+"))), ","), F.lit("*")).alias("value"))
    s.union(e).union(p).write.mode("overwrite").text(path)
