"""Paths: texts, positions, coverage, containment, k-mers and path algebra.

path_steps: path_id, pos (0-based), node_id. Ends, where given: path_id, head (used bases of the first node, its suffix)
and tail (used bases of the last node, its prefix); 0 or no row means the whole node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.kmers import kmers
from graphloom.operators.walks import path_grams


def pieces(path_steps: DataFrame, nodes: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """path_id, pos, node_id, skip (bases of the node before the path's text), piece."""
    s = path_steps.select("path_id", "pos", "node_id").join(nodes.select("node_id", "seq"), "node_id")
    if ends is None:
        return s.select("path_id", "pos", "node_id", F.lit(0).alias("skip"), F.col("seq").alias("piece"))
    last = path_steps.groupBy("path_id").agg(F.max("pos").alias("last"))
    s = s.join(last, "path_id").join(ends.select("path_id", "head", "tail"), "path_id", "left")
    n = F.length("seq")
    skip = F.when((F.col("pos") == 0) & (F.coalesce("head", F.lit(0)) > 0), n - F.col("head")).otherwise(0)
    stop = F.when((F.col("pos") == F.col("last")) & (F.coalesce("tail", F.lit(0)) > 0), F.col("tail")).otherwise(n)
    return s.withColumn("skip", skip).withColumn("stop", stop).select("path_id", "pos", "node_id", "skip", F.expr("substr(seq, skip + 1, greatest(stop - skip, 0))").alias("piece"))


def path_texts(path_steps: DataFrame, nodes: DataFrame, ends: DataFrame | None = None, reverse: bool = False) -> DataFrame:
    """path_id, text."""
    p = pieces(path_steps, nodes, ends).groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("s"))
    text = F.concat_ws("", F.transform("s", lambda x: x["piece"]))
    return p.select("path_id", (F.reverse(text) if reverse else text).alias("text"))


def step_starts(path_steps: DataFrame, nodes: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """path_id, pos, node_id, skip, start, size: where each step lies in the path's text (rank and select)."""
    p = pieces(path_steps, nodes, ends).withColumn("size", F.length("piece"))
    before = F.sum("size").over(W.partitionBy("path_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1))
    return p.select("path_id", "pos", "node_id", "skip", F.coalesce(before, F.lit(0)).cast("int").alias("start"), "size")


def position_map(path_steps: DataFrame, nodes: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """path_id, text_pos, node_id, node_offset of every base of every path's text."""
    s = step_starts(path_steps, nodes, ends).where("size > 0")
    s = s.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("size") - 1)))
    return s.select("path_id", (F.col("start") + F.col("i")).alias("text_pos"), "node_id", (F.col("skip") + F.col("i")).alias("node_offset"))


def reversed_position(pos: Column, length: Column) -> Column:
    """The forward position of a position in a reversed text."""
    return length - pos - 1


def locate(positions: DataFrame, starts: DataFrame) -> DataFrame:
    """positions (path_id, text_pos) with node_id and node_offset."""
    s = starts.select("path_id", "node_id", "skip", "start", "size")
    hit = positions.join(s, "path_id").where("text_pos >= start and text_pos < start + size")
    return hit.select(*positions.columns, "node_id", (F.col("text_pos") - F.col("start") + F.col("skip")).alias("node_offset"))


def path_kmers(path_steps: DataFrame, nodes: DataFrame, k: int, ends: DataFrame | None = None) -> DataFrame:
    """kmer, path_id, text_pos, node_id, node_offset of every k-mer without N on a path."""
    texts = path_texts(path_steps, nodes, ends)
    found = kmers(texts, k, key=("path_id",), seq="text", at="text_pos").where("not contains(kmer, 'N')")
    return found.join(position_map(path_steps, nodes, ends), ["path_id", "text_pos"]).select("kmer", "path_id", "text_pos", "node_id", "node_offset")


def edge_kmers(path_steps: DataFrame, nodes: DataFrame, k: int, last: bool = False) -> DataFrame:
    """The locus of each path's first (or last) k-mer."""
    found = path_kmers(path_steps, nodes, k)
    pick = F.max_by if last else F.min_by
    return found.groupBy("path_id").agg(pick("node_id", "text_pos").alias("node_id"), pick("node_offset", "text_pos").alias("node_offset"))


# --- coverage and containment ----------------------------------------------------------------------------------------


def node_coverage(path_steps: DataFrame) -> DataFrame:
    """node_id, n_paths: in how many paths each node is."""
    return path_steps.groupBy("node_id").agg(F.countDistinct("path_id").alias("n_paths"))


def occurrences(walks: DataFrame, path_steps: DataFrame) -> DataFrame:
    """walks (walk_id, walk) joined with every (path_id, pos) where the walk is a contiguous part."""
    lengths = [r[0] for r in walks.select(F.size("walk").alias("m")).distinct().collect()]
    parts = [walks.where(F.size("walk") == m).join(path_grams(path_steps, m), F.col("walk") == F.col("gram")).select("walk_id", "path_id", "pos") for m in lengths if m > 0]
    out = parts[0] if parts else walks.select("walk_id", F.lit(0).cast("long").alias("path_id"), F.lit(0).alias("pos")).limit(0)
    for p in parts[1:]:
        out = out.union(p)
    return out


def walk_coverage(walks: DataFrame, path_steps: DataFrame) -> DataFrame:
    """walk_id, n_paths."""
    n = occurrences(walks, path_steps).groupBy("walk_id").agg(F.countDistinct("path_id").alias("n"))
    return walks.select("walk_id").join(n, "walk_id", "left").select("walk_id", F.coalesce("n", F.lit(0)).alias("n_paths"))


def covered(walks: DataFrame, path_steps: DataFrame, want: bool = True) -> DataFrame:
    """The walks that some path holds (or that none does)."""
    return walks.join(occurrences(walks, path_steps).select("walk_id").distinct(), "walk_id", "left_semi" if want else "left_anti")


def _text(nodes: Column) -> Column:
    return F.concat(F.lit(","), F.array_join(nodes.cast("array<string>"), ","), F.lit(","))


def contains_run(path: Column, run: Column) -> Column:
    """Whether the nodes of run follow each other in path."""
    return (F.size(run) > 0) & F.contains(_text(path), _text(run))


def contains_reversed(path: Column, run: Column) -> Column:
    """The same for a run given last node first."""
    return contains_run(path, F.reverse(run))


def contains_all(path: Column, some: Column) -> Column:
    """Whether every node of some is in path, in any order."""
    return F.forall(some, lambda x: F.array_contains(path, x))


def contains_by_rank(path: Column, run: Column) -> Column:
    """For paths and runs as arrays of ranks: run ascends, and path has these and no other ranks between its ends."""
    between = F.filter(F.array_sort(path), lambda x: (x >= F.element_at(run, 1)) & (x <= F.element_at(run, -1)))
    return (F.size(run) > 0) & (between == run)


# --- path algebra on node arrays -------------------------------------------------------------------------------------


def appended(path: Column, more: Column) -> Column:
    return F.concat(path, more)


def trimmed_back(path: Column, node: Column, inclusive: bool = True) -> Column:
    """The path up to the last occurrence of node, without it if inclusive; unchanged if it is not there."""
    at = F.array_position(F.reverse(path), node)
    keep = F.size(path) - at + (0 if inclusive else 1)
    return F.when(at > 0, F.slice(path, F.lit(1), keep.cast("int"))).otherwise(path)


def trimmed_front(path: Column, node: Column, inclusive: bool = True) -> Column:
    """The path from the first occurrence of node on, without it if inclusive; unchanged if it is not there."""
    at = F.array_position(path, node)
    skip = at - (0 if inclusive else 1)
    return F.when(at > 0, F.slice(path, (skip + 1).cast("int"), F.greatest(F.size(path) - skip, F.lit(0)).cast("int"))).otherwise(path)


def trimmed_by_length(steps: DataFrame, bases: int, front: bool = False, hard: bool = True, keep_partial: bool = False) -> DataFrame:
    """step_starts rows without whole nodes at the back (or front) that lie within `bases` of that end.

    hard: a node that straddles the limit goes as well, unless keep_partial; soft trims never leave fewer than `bases`.
    """
    total = F.sum("size").over(W.partitionBy("path_id"))
    after = total - F.col("start") - F.col("size")
    outside = F.col("start") + F.col("size") if front else after + F.col("size")
    inside = F.col("start") if front else after
    drop = outside <= bases if keep_partial or not hard else inside < bases
    return steps.withColumn("__drop", drop).where("not __drop").drop("__drop")


def length(path: DataFrame) -> DataFrame:
    """path_id, n_bases, n_nodes of step_starts rows."""
    return path.groupBy("path_id").agg(F.sum("size").alias("n_bases"), F.count("*").alias("n_nodes"))


def mappings(path_steps: DataFrame, nodes: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """path_id, mapping: an array of (rank from 1, node_id, offset, one full-match edit) for each path."""
    p = pieces(path_steps, nodes, ends)
    edit = F.struct(F.length("piece").alias("from_length"), F.length("piece").alias("to_length"), F.lit("").alias("sequence"))
    m = F.struct((F.col("pos") + 1).alias("rank"), "node_id", F.col("skip").alias("offset"), F.array(edit).alias("edit"))
    return p.groupBy("path_id").agg(F.array_sort(F.collect_list(m)).alias("mapping"))


def marked_mappings(path_steps: DataFrame, nodes: DataFrame, loci: DataFrame) -> DataFrame:
    """path_id, pos, node_id, edits: each node's edits, with an S at every marked locus."""
    marks = loci.groupBy("node_id").agg(F.array_sort(F.collect_set("node_offset")).alias("at"))
    p = pieces(path_steps, nodes).join(marks, "node_id", "left").withColumn("n", F.length("piece"))
    points = F.array_distinct(F.array_sort(F.concat(F.array(F.lit(0), F.col("n")), F.coalesce("at", F.array().cast("array<int>")))))
    edit = F.transform(
        F.sequence(F.lit(1), F.size("points") - 1),
        lambda i: F.struct(
            (F.element_at("points", i + 1) - F.element_at("points", i)).alias("length"),
            F.when(F.array_contains(F.coalesce("at", F.array().cast("array<int>")), F.element_at("points", i)), "S").otherwise("").alias("sequence"),
        ),
    )
    return p.withColumn("points", points).where("n > 0").select("path_id", "pos", "node_id", edit.alias("edits"))
