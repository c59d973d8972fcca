"""The registered queries over the derived workload."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import workload
from graphloom.functions import kmers as km
from graphloom.functions import scalar
from graphloom.model import Params
from graphloom.operators import alignments, distance, graph, haplotypes, metrics, paths, seeds, simulate, walks
from graphloom.plans.finder import SeedFinder
from graphloom.shipping import ship
from graphloom.sources import gaf, gfa, logs, reads, tables
from graphloom.staging import shared_dir, staged
from graphloom.streaming import seeds as streaming

K = 8
DMIN, DMAX = 6, 10

#: Positions, which the queries give as 64-bit integers.
WIDE = ("node_offset", "read_offset", "text_pos", "o", "p")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    """Register a query; the package is sent to the workers before it runs."""

    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        out = f(spark, sf_dir)
        return out.select(*[F.col(c).cast("long").alias(c) if c in WIDE else F.col(c) for c in out.columns])

    QUERIES[f.__name__] = run
    return run


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return workload.nodes(spark, d), workload.edges(spark, d)


def _read_kmers(spark: SparkSession, d: str) -> DataFrame:
    return km.kmers(workload.reads(spark, d), K, policy="non_overlapping")


def _path_kmers(spark: SparkSession, d: str) -> DataFrame:
    return paths.path_kmers(workload.path_steps(spark, d), workload.nodes(spark, d), K)


# --- graph -----------------------------------------------------------------------------------------------------------


@query
def node_charorder(spark: SparkSession, d: str) -> DataFrame:
    return graph.char_order(workload.nodes(spark, d))


@query
def topo_check(spark: SparkSession, d: str) -> DataFrame:
    return graph.topological_violations(*_graph(spark, d))


@query
def weak_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.weak_components(*_graph(spark, d))


@query
def component_ranks(spark: SparkSession, d: str) -> DataFrame:
    return graph.component_ranks(workload.path_steps(spark, d), workload.nodes(spark, d))


@query
def bfs_levels(spark: SparkSession, d: str) -> DataFrame:
    return graph.bfs_levels(*_graph(spark, d))


@query
def induced_graph(spark: SparkSession, d: str) -> DataFrame:
    """The edges that the paths induce."""
    return graph.induced_edges(workload.path_steps(spark, d))


@query
def graph_kwalks(spark: SparkSession, d: str) -> DataFrame:
    n, e = _graph(spark, d)
    return walks.kwalks(graph.loci(n), n, e, K).groupBy("node_id", "node_offset", "kmer").agg(F.count("*").alias("n_walks"))


@query
def count_kmers(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(walks.count_kwalks(*_graph(spark, d), K),)], "n_walks long")


@query
def loci_stepped(spark: SparkSession, d: str) -> DataFrame:
    return walks.all_loci(workload.nodes(spark, d), 4)


@query
def loci_range(spark: SparkSession, d: str) -> DataFrame:
    """The first 20 loci from node 11 to node 40."""
    return graph.loci(workload.nodes(spark, d)).where("node_id between 11 and 40").orderBy("node_id", "node_offset").limit(20)


# --- sequences -------------------------------------------------------------------------------------------------------


@query
def read_kmers_overlap(spark: SparkSession, d: str) -> DataFrame:
    return km.kmers(workload.reads(spark, d), K)


@query
def read_kmers_nonoverlap(spark: SparkSession, d: str) -> DataFrame:
    return _read_kmers(spark, d)


@query
def read_kmers_greedy(spark: SparkSession, d: str) -> DataFrame:
    return km.kmers(workload.reads(spark, d), 7, policy="greedy_non_overlapping")


@query
def distinct_kmers(spark: SparkSession, d: str) -> DataFrame:
    return km.distinct_kmers(workload.reads(spark, d), 5)


@query
def next_kmers(spark: SparkSession, d: str) -> DataFrame:
    r = _read_kmers(spark, d).select("kmer").distinct()
    return r.select("kmer", km.next_kmer(F.col("kmer")).alias("successor"), km.kmer_number(F.col("kmer")).alias("number"))


@query
def revcomp_reads(spark: SparkSession, d: str) -> DataFrame:
    return workload.reads(spark, d).select("read_id", scalar.reverse_complement("seq").alias("revcomp"))


@query
def scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet")
    return p.select(
        "p_partkey", scalar.next_power_of_two("p_size").alias("power"), scalar.field("p_name", 0, " ").alias("first_word"), scalar.hashed_index(F.lit(10), "p_partkey").alias("draw"),
        scalar.trimmed(F.concat(F.lit(" \t"), "p_brand", F.lit(" "))).alias("brand"), scalar.starts_with("p_brand", "Brand#1").alias("is_one"),
        scalar.without_pair_suffix(F.concat(F.col("p_partkey").cast("string"), F.lit("/2"))).alias("name"),
    )


# --- paths -----------------------------------------------------------------------------------------------------------


@query
def path_text(spark: SparkSession, d: str) -> DataFrame:
    return paths.path_texts(workload.path_steps(spark, d), workload.nodes(spark, d))


@query
def path_text_reversed(spark: SparkSession, d: str) -> DataFrame:
    return paths.path_texts(workload.path_steps(spark, d), workload.nodes(spark, d), reverse=True)


@query
def path_text_trimmed(spark: SparkSession, d: str) -> DataFrame:
    """Paths of even components with one base of the first node and of the last."""
    s = workload.path_steps(spark, d)
    ends = s.select("path_id").distinct().select("path_id", F.lit(1).alias("head"), F.lit(1).alias("tail"))
    return paths.path_texts(s, workload.nodes(spark, d), ends)


@query
def path_position_map(spark: SparkSession, d: str) -> DataFrame:
    return paths.position_map(workload.path_steps(spark, d), workload.nodes(spark, d))


@query
def path_locate(spark: SparkSession, d: str) -> DataFrame:
    """What lies at every tenth position of every path."""
    starts = paths.step_starts(workload.path_steps(spark, d), workload.nodes(spark, d))
    n = starts.groupBy("path_id").agg(F.sum("size").cast("int").alias("n"))
    at = n.select("path_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(10))).alias("text_pos"))
    return paths.locate(at, starts)


@query
def path_kmers(spark: SparkSession, d: str) -> DataFrame:
    return _path_kmers(spark, d)


@query
def path_coverage(spark: SparkSession, d: str) -> DataFrame:
    return paths.node_coverage(workload.path_steps(spark, d))


def _edge_walks(spark: SparkSession, d: str) -> DataFrame:
    return workload.edges(spark, d).select((F.col("src") * 10 + F.col("dst") - F.col("src")).alias("walk_id"), F.array("src", "dst").alias("walk"))


@query
def path_occurrences(spark: SparkSession, d: str) -> DataFrame:
    return paths.occurrences(_edge_walks(spark, d), workload.path_steps(spark, d)).withColumn("pos", F.col("pos").cast("long"))


@query
def covered_walks(spark: SparkSession, d: str) -> DataFrame:
    """Edges that the paths hold."""
    return paths.covered(_edge_walks(spark, d), workload.path_steps(spark, d)).select("walk_id")


@query
def walk_coverage(spark: SparkSession, d: str) -> DataFrame:
    return paths.walk_coverage(_edge_walks(spark, d), workload.path_steps(spark, d))


@query
def path_contains(spark: SparkSession, d: str) -> DataFrame:
    """For each path, whether it holds three nodes in a row, in reverse, in any order, and by rank."""
    s = workload.path_steps(spark, d).groupBy("path_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node_id"))), lambda x: x["node_id"]).alias("p"))
    first = F.element_at("p", 1)
    run = F.array(first + 2, first + 4, first + 6)
    return s.select(
        "path_id", paths.contains_run(F.col("p"), run).alias("run"), paths.contains_run(F.col("p"), F.array(first, first + 1)).alias("gap"), paths.contains_reversed(F.col("p"), F.reverse(run)).alias("rev"),
        paths.contains_all(F.col("p"), F.array(first + 4, first)).alias("any_order"), paths.contains_by_rank(F.col("p"), run).alias("by_rank"),
    )


@query
def path_algebra(spark: SparkSession, d: str) -> DataFrame:
    """Nodes left of each path after trims by node at the back and front."""
    s = workload.path_steps(spark, d).groupBy("path_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node_id"))), lambda x: x["node_id"]).alias("p"))
    node = F.element_at("p", 1) + 9
    return s.select("path_id", F.size(paths.trimmed_back(F.col("p"), node)).alias("back"), F.size(paths.trimmed_front(F.col("p"), node)).alias("front"), F.size(paths.trimmed_back(F.col("p"), node, False)).alias("back_kept"))


@query
def path_trim_by_length(spark: SparkSession, d: str) -> DataFrame:
    """Steps left after a soft trim of 20 bases at the back."""
    starts = paths.step_starts(workload.path_steps(spark, d), workload.nodes(spark, d))
    return paths.trimmed_by_length(starts, 20, hard=False).groupBy("path_id").agg(F.count("*").alias("n_steps"))


@query
def edge_kmers(spark: SparkSession, d: str) -> DataFrame:
    """The locus of each path's first k-mer."""
    return paths.edge_kmers(workload.path_steps(spark, d), workload.nodes(spark, d), K)


@query
def path_mappings(spark: SparkSession, d: str) -> DataFrame:
    """The mappings of every path, one a row."""
    m = paths.mappings(workload.path_steps(spark, d), workload.nodes(spark, d)).select("path_id", F.explode("mapping").alias("m"))
    return m.select("path_id", F.col("m.rank").cast("long").alias("rank"), "m.node_id", F.col("m.edit")[0]["from_length"].cast("long").alias("n_bases"))


@query
def path_marked(spark: SparkSession, d: str) -> DataFrame:
    """How many edits begin at a marked locus, on each path; every node's second base is marked."""
    n = workload.nodes(spark, d)
    marks = graph.loci(n).where("node_offset = 1")
    e = paths.marked_mappings(workload.path_steps(spark, d), n, marks)
    return e.groupBy("path_id").agg(F.sum(F.size(F.filter("edits", lambda x: x["sequence"] == "S"))).alias("n_marked"))


@query
def induced_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.induced_nodes(workload.path_steps(spark, d))


# --- seeds -----------------------------------------------------------------------------------------------------------


@query
def seeds_on_paths(spark: SparkSession, d: str) -> DataFrame:
    return seeds.on_paths(_path_kmers(spark, d), _read_kmers(spark, d), K)


@query
def seeds_on_paths_limited(spark: SparkSession, d: str) -> DataFrame:
    return seeds.on_paths(_path_kmers(spark, d), _read_kmers(spark, d), K, limit=1)


@query
def seeds_all_loci(spark: SparkSession, d: str) -> DataFrame:
    n, e = _graph(spark, d)
    return seeds.off_paths(graph.loci(n), n, e, _read_kmers(spark, d), K)


@query
def seeds_all_loci_pruned(spark: SparkSession, d: str) -> DataFrame:
    n, e = _graph(spark, d)
    return seeds.off_paths(graph.loci(n), n, e, _read_kmers(spark, d), K, prune=True)


@query
def uncovered_loci(spark: SparkSession, d: str) -> DataFrame:
    n, e = _graph(spark, d)
    return walks.uncovered_loci(n, e, workload.path_steps(spark, d), K)


@query
def uncovered_kmers(spark: SparkSession, d: str) -> DataFrame:
    n, e = _graph(spark, d)
    w = walks.uncovered_walks(walks.kwalks(graph.loci(n), n, e, K), workload.path_steps(spark, d))
    return w.agg(F.count("*").alias("n_walks"), F.countDistinct("node_id").alias("n_nodes"))


def _off(spark: SparkSession, d: str) -> DataFrame:
    n, e = _graph(spark, d)
    starts = staged(walks.uncovered_loci(n, e, workload.path_steps(spark, d), K), "loci")
    return seeds.off_paths(starts, n, e, _read_kmers(spark, d), K)


@query
def seeds_off_paths(spark: SparkSession, d: str) -> DataFrame:
    return _off(spark, d)


@query
def seeds_all(spark: SparkSession, d: str) -> DataFrame:
    return seeds.all_seeds(seeds.on_paths(_path_kmers(spark, d), _read_kmers(spark, d), K), _off(spark, d))


@query
def seeds_distinct(spark: SparkSession, d: str) -> DataFrame:
    return seeds.all_seeds(seeds.on_paths(_path_kmers(spark, d), _read_kmers(spark, d), K), _off(spark, d), distinct=True)


@query
def hit_totals(spark: SparkSession, d: str) -> DataFrame:
    return seeds.totals(seeds.all_seeds(seeds.on_paths(_path_kmers(spark, d), _read_kmers(spark, d), K), _off(spark, d)))


@query
def finder_patched(spark: SparkSession, d: str) -> DataFrame:
    """The whole plan with picked, patched paths: equal to seeds_distinct as a set."""
    n, e = _graph(spark, d)
    finder = SeedFinder(staged(n, "nodes"), staged(e, "edges"), Params(K, paths=3, distinct=True))
    finder.build()
    return finder.seeds(workload.reads(spark, d))


@query
def read_matches_whole(spark: SparkSession, d: str) -> DataFrame:
    """Whole reads on paths: the reads, and one read of 32 bases from each path, with negative numbers."""
    texts = paths.path_texts(workload.path_steps(spark, d), workload.nodes(spark, d))
    own = texts.where(F.length("text") >= 35).select((-F.col("path_id") - 1).alias("read_id"), F.substr("text", F.lit(4), F.lit(32)).alias("seq"))
    return seeds.whole_reads(texts, _path_kmers(spark, d), workload.reads(spark, d).select("read_id", "seq").union(own), K)


@query
def greedy_matches(spark: SparkSession, d: str) -> DataFrame:
    n, s = workload.nodes(spark, d), workload.path_steps(spark, d)
    return seeds.greedy_matches(paths.path_texts(s, n), paths.path_kmers(s, n, 6), workload.reads(spark, d), 6, limit=2)


@query
def prefix_counts(spark: SparkSession, d: str) -> DataFrame:
    return seeds.prefix_table(paths.path_texts(workload.path_steps(spark, d), workload.nodes(spark, d)), 4)


@query
def linear_reference_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Reads against linear texts: every path as a graph of one node."""
    text = paths.path_texts(workload.path_steps(spark, d), workload.nodes(spark, d)).select(F.col("path_id").alias("node_id"), F.col("text").alias("seq"))
    index = km.kmers(text, K, key=("node_id",), at="node_offset")
    return seeds.on_paths(index, km.kmers(workload.reads(spark, d), K, policy="non_overlapping"), K)


def _word_runs(df: DataFrame, key: str, k: int = 6) -> DataFrame:
    """key, kmer: runs of k words."""
    w = df.select(key, F.split("text", " ").alias("w")).where(F.size("w") >= k)
    return w.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.array_join(F.slice("w", i, F.lit(k)), " "))).alias("kmer"))


@query
def doc_benchmark_kmers(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, item_id, n: distinct runs of six words shared by benchmark items and documents.

    The items' runs, far fewer, are joined first (by broadcast while Spark finds them small enough); only what is shared is
    made distinct.
    """
    docs, items = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    shared = _word_runs(docs, "doc_id").join(_word_runs(items, "item_id").distinct(), "kmer").distinct()
    return shared.groupBy("doc_id", "item_id").agg(F.count("*").alias("n"))


@query
def seeds_stream(spark: SparkSession, d: str) -> DataFrame:
    """The reads as a stream of files; the same rows as seeds_on_paths."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    workload.reads(spark, d).select("read_id", "seq").repartition(4).write.parquet(f"{base}/in")
    index = staged(_path_kmers(spark, d), "path-kmers")
    found = streaming.seeds_stream(streaming.read_stream(spark, f"{base}/in", "read_id long, seq string"), index, K)
    streaming.start(found, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{base}/out")


# --- distances -------------------------------------------------------------------------------------------------------


@query
def distance_pairs(spark: SparkSession, d: str) -> DataFrame:
    return distance.distance_pairs(*_graph(spark, d), DMIN, DMAX)


def _queries(spark: SparkSession, d: str) -> DataFrame:
    """Offset 0 of each node with offset 0 of the nodes up to 6 on, and within the node with its last base."""
    n = workload.nodes(spark, d).select("node_id", "len", "comp")
    far = n.select(F.col("node_id").alias("v"), F.lit(0).alias("o"), F.explode(F.sequence(F.col("node_id"), F.col("node_id") + 6)).alias("u"), "len")
    return far.select("v", "o", "u", F.when(F.col("u") == F.col("v"), F.col("len") - 1).otherwise(0).alias("p"))


@query
def verify_distance(spark: SparkSession, d: str) -> DataFrame:
    return distance.verify(_queries(spark, d), distance.distance_pairs(*_graph(spark, d), DMIN, DMAX), DMIN, DMAX)


@query
def dindex_ranges(spark: SparkSession, d: str) -> DataFrame:
    n, e = _graph(spark, d)
    return distance.ranges(distance.as_cells(distance.distance_pairs(n, e, DMIN, DMAX), n))


@query
def dindex_merge(spark: SparkSession, d: str) -> DataFrame:
    n, e = _graph(spark, d)
    return distance.merge(distance.distance_pairs(n, e, DMIN, 8), distance.distance_pairs(n, e, 8, DMAX))


@query
def dindex_compress(spark: SparkSession, d: str) -> DataFrame:
    return distance.without_inner(distance.distance_pairs(*_graph(spark, d), DMIN, DMAX))


@query
def dindex_stats(spark: SparkSession, d: str) -> DataFrame:
    n, e = _graph(spark, d)
    found = distance.stats(staged(distance.as_cells(distance.distance_pairs(n, e, DMIN, DMAX), n), "cells"), n)
    return found.withColumn("cells_per_range", F.round("cells_per_range", 6))


# --- haplotypes and simulation ---------------------------------------------------------------------------------------


@query
def haplotypes_random(spark: SparkSession, d: str) -> DataFrame:
    n, e = _graph(spark, d)
    first = n.groupBy("comp").agg(F.min("node_id").alias("node_id")).select(F.concat(F.lit("c"), "comp").alias("name"), "comp", "node_id")
    return haplotypes.random_haplotypes(first, e, 2).select("comp", "hap", "pos", "node_id")


@query
def haplotypes_diverse(spark: SparkSession, d: str) -> DataFrame:
    return haplotypes.pick_paths(*_graph(spark, d), 4)


@query
def haplotypes_patched(spark: SparkSession, d: str) -> DataFrame:
    return haplotypes.pick_paths(*_graph(spark, d), 4, "patched", 10)


@query
def haplotypes_local(spark: SparkSession, d: str) -> DataFrame:
    return haplotypes.pick_paths(*_graph(spark, d), 4, "local", 12)


def _hap_texts(spark: SparkSession, d: str) -> DataFrame:
    return paths.path_texts(workload.path_steps(spark, d), workload.nodes(spark, d)).withColumnRenamed("path_id", "hap_id")


@query
def reads_dist(spark: SparkSession, d: str) -> DataFrame:
    return simulate.reads_per_haplotype(_hap_texts(spark, d).select("hap_id", F.length("text").alias("length")), 1000, 40)


@query
def simulated_reads(spark: SparkSession, d: str) -> DataFrame:
    t = _hap_texts(spark, d)
    return simulate.single_end(t, t.select("hap_id", F.lit(5).cast("long").alias("n_reads")), 30, tries=1).select("hap_id", "i", "pos", "strand", "seq")


@query
def simulated_pairs(spark: SparkSession, d: str) -> DataFrame:
    t = _hap_texts(spark, d)
    return simulate.paired_end(t, t.select("hap_id", F.lit(3).cast("long").alias("n_reads")), 20, 50)


@query
def simulated_errors(spark: SparkSession, d: str) -> DataFrame:
    t = _hap_texts(spark, d)
    return simulate.single_end(t, t.select("hap_id", F.lit(5).cast("long").alias("n_reads")), 30, error=0.1, indel=0.2)


# --- sources and sinks -----------------------------------------------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/source-{uuid.uuid4().hex}"


@query
def source_gfa(spark: SparkSession, d: str) -> DataFrame:
    """kind, a, b, text: the segments, links and path steps of the graph, written as GFA and read again."""
    at = _folder(spark) + ".gfa"
    gfa.write_gfa(workload.nodes(spark, d), workload.edges(spark, d), workload.path_steps(spark, d), at)
    nodes, edges, walked = gfa.read_graph(spark, at)
    return (
        nodes.select(F.lit("S").alias("kind"), F.col("node_id").alias("a"), F.col("len").cast("long").alias("b"), F.col("seq").alias("text"))
        .union(edges.select(F.lit("L"), "src", "dst", F.lit(""))).union(walked.select(F.lit("P"), F.col("pos").cast("long"), "node_id", "path_name"))
    )


def _written(spark: SparkSession, d: str, kind: str) -> str:
    at = _folder(spark)
    reads.write_sequences(workload.reads(spark, d), at, kind)
    return at


@query
def source_fasta(spark: SparkSession, d: str) -> DataFrame:
    """The reads, written as FASTA and read again."""
    return reads.read_fasta(spark, _written(spark, d, "fasta")).select("name", "seq")


@query
def source_fastq(spark: SparkSession, d: str) -> DataFrame:
    """The reads, written as FASTQ and read again."""
    return reads.read_fastq(spark, _written(spark, d, "fastq")).select("name", "seq", "qual")


@query
def source_gaf(spark: SparkSession, d: str) -> DataFrame:
    """The alignment records' mandatory fields, written as GAF and read again."""
    at = _folder(spark)
    gaf.as_lines(_gaf(spark, d)).write.text(at)
    return gaf.read_gaf(spark, at).groupBy("q_name", "path", "p_start", "block").agg(F.count("*").alias("n"))


@query
def source_loci(spark: SparkSession, d: str) -> DataFrame:
    """All loci, written as JSON and read again."""
    at = _folder(spark)
    tables.write_json(graph.loci(workload.nodes(spark, d)), at)
    return tables.read_loci(spark, at, "json").select("node_id", F.col("node_offset").cast("long").alias("node_offset"))


@query
def source_index(spark: SparkSession, d: str) -> DataFrame:
    """Seeds by an index that was saved and loaded again; the same as seeds_on_paths and off them."""
    n, e = _graph(spark, d)
    n, e, at = staged(n, "nodes"), staged(e, "edges"), _folder(spark)
    built = SeedFinder(n, e, Params(K, paths=2, distinct=True))
    built.build(workload.path_steps(spark, d))
    built.save(at)
    loaded = SeedFinder(n, e, Params(K, paths=2, distinct=True))
    loaded.load(at)
    return loaded.seeds(workload.reads(spark, d))


# --- alignments ------------------------------------------------------------------------------------------------------


def gaf_lines(spark: SparkSession, d: str) -> DataFrame:
    """line, value: alignment records made from orders; two records for most reads."""
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("line"))
    line, read = F.col("line"), F.floor(F.col("line") / 2)
    base = F.concat(F.lit("q"), F.floor(read * 3 / 4).cast("string"))
    name = F.concat(base, F.when(line % 2 == 0, "/1").otherwise("/2"))
    node = F.col("line") % 150 + 1
    return o.select(
        "line",
        F.concat_ws(
            "\t", name, F.lit("32"), F.lit("0"), F.lit("32"), F.lit("+"), F.concat(F.when(F.col("line") % 7 == 0, "<").otherwise(">"), node.cast("string"), F.lit(">"), (node + 1).cast("string")),
            F.lit("60"), (F.col("line") % 3).cast("string"), F.lit("35"), F.lit("30"), F.when(F.col("line") % 11 == 0, "0").otherwise("32"), F.lit("60"),
            F.concat(F.lit("dv:f:0."), F.lpad((F.col("line") % 25).cast("string"), 2, "0")), F.lit("NM:i:2"), F.lit("xx:q:bad"),
            F.when((line % 2 == 0) & (line % 13 != 0), F.concat(F.lit("fn:Z:"), F.when(line % 26 == 2, "other").otherwise(F.concat(base, F.lit("/2"))))),
            F.when((line % 2 == 1) & (line % 10 != 9), F.concat(F.lit("fp:Z:"), F.when(line % 34 == 1, "other").otherwise(F.concat(base, F.lit("/1"))))),
            F.when(line % 10 == 9, F.concat(F.lit("fn:Z:"), base, F.lit("/1"))),
        ).alias("value"),
    )


def _gaf(spark: SparkSession, d: str) -> DataFrame:
    return gaf.parse(gaf_lines(spark, d))


@query
def gaf_parse(spark: SparkSession, d: str) -> DataFrame:
    g = _gaf(spark, d)
    first = F.get(alignments.oriented_path(F.col("path")), F.lit(0))
    return g.select("line", "q_name", "q_len", "q_fwd", "p_start", "block", first["node_id"].alias("first_node"), first["forward"].alias("first_forward"), F.col("tag_i")["NM"].alias("nm"), F.round(alignments.identity(F.col("tag_f")).cast("double"), 4).alias("identity"))


@query
def gaf_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = alignments.consecutive_pairs(_gaf(spark, d).select("line", "q_name", "q_len"))
    return p.select(F.col("one.line").alias("line1"), F.col("two.line").alias("line2"))


@query
def gaf_header(spark: SparkSession, d: str) -> DataFrame:
    return alignments.header_counts(_gaf(spark, d))


def _truth(spark: SparkSession, d: str) -> DataFrame:
    """Truth loci: those of the records themselves, but node 1 for odd reads and offset 0 for every third line."""
    odd = F.regexp_extract("q_name", "^q([0-9]+)", 1).cast("long") % 2 == 1
    g = _gaf(spark, d).withColumn("path", F.when(odd, ">1").otherwise(F.col("path"))).withColumn("p_start", F.when(F.col("line") % 3 == 2, 0).otherwise(F.col("p_start")))
    return alignments.truth_loci(g)


@query
def read_alignments(spark: SparkSession, d: str) -> DataFrame:
    """Every read's counts of pairs, singles and invalid records, and its truth flag."""
    return alignments.per_read_counts(_gaf(spark, d), _truth(spark, d))


@query
def read_classes(spark: SparkSession, d: str) -> DataFrame:
    return alignments.class_counts(alignments.per_read_counts(_gaf(spark, d)))


@query
def class_sample(spark: SparkSession, d: str) -> DataFrame:
    return alignments.class_sample(alignments.per_read_counts(_gaf(spark, d)), "NLUP", 0.5)


@query
def gaf_fragments(spark: SparkSession, d: str) -> DataFrame:
    return alignments.fragments(_truth(spark, d))


@query
def truth_classes(spark: SparkSession, d: str) -> DataFrame:
    return alignments.class_counts(alignments.per_read_counts(_gaf(spark, d), _truth(spark, d)), truth=True).where(F.col("class").isin(*alignments.TRUTH))


@query
def pair_distance_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether each pair's inner distance is one that the distance index has."""
    n, e = _graph(spark, d)
    pairs = alignments.consecutive_pairs(_gaf(spark, d).select("line", "q_name", "path", "p_len", "p_start", "p_end"))
    asked = alignments.end_coordinates(pairs, n).select(F.col("one.line").alias("line"), "v", "o", "u", "p")
    return distance.verify(asked, distance.distance_pairs(n, e, DMIN, DMAX), DMIN, DMAX).select("line", "v", "o", "u", "p", "ok")


@query
def pair_distance(spark: SparkSession, d: str) -> DataFrame:
    g = _gaf(spark, d)
    # reference paths may not share nodes: those that are the longest path of some node
    steps = workload.path_steps(spark, d)
    longest = steps.join(steps.groupBy("path_id").agg(F.count("*").alias("n")), "path_id").groupBy("node_id").agg(F.max_by("path_id", F.struct("n", "path_id")).alias("path_id"))
    steps = steps.join(longest.select("path_id").distinct(), "path_id", "left_semi")
    starts = paths.step_starts(steps, workload.nodes(spark, d)).select("path_id", "node_id", "start")
    pairs = alignments.consecutive_pairs(g.select("line", "q_name", "q_len"))
    return alignments.pair_distances(pairs, staged(alignments.reference_position(g, starts), "positions"))


# --- metrics ---------------------------------------------------------------------------------------------------------


@query
def run_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Runs made from suppliers."""
    s = spark.read.parquet(f"{d}/supplier.parquet")
    k = F.col("s_suppkey")
    runs = s.select(
        k.alias("run"), F.lit(30).alias("k"), F.lit(150).alias("read_length"), (k % 100 + 1).alias("n_reads"), (k % 1000).alias("hits"), (k % 10).alias("off_hits"), (k % 60 / 4.0).alias("query_s"),
        (k % 100 * 36.0).alias("traverse_s"), (k % 50).alias("loci"), (k * 1024).alias("index_bytes"),
    )
    m = metrics.run_metrics(runs)
    return m.select("run", *[F.round(c, 6).alias(c) for c in m.columns if c != "run"])


@query
def class_cumulative(spark: SparkSession, d: str) -> DataFrame:
    c = spark.read.parquet(f"{d}/customer.parquet").groupBy(F.col("c_nationkey").alias("run"), F.col("c_mktsegment").alias("class")).agg(F.count("*").alias("n"))
    m = metrics.cumulative_shares(c)
    return m.select("run", "class", F.round("share", 6).alias("share"), F.round("cumulative", 6).alias("cumulative"))


@query
def occurrence_histogram(spark: SparkSession, d: str) -> DataFrame:
    return metrics.histogram(km.distinct_kmers(workload.reads(spark, d), 6), "n", 2)


@query
def metrics_long(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.col("p_size").cast("long").alias("size"), F.length("p_name").cast("long").alias("name_length"))
    return metrics.long_form(p, "p_partkey", ["size", "name_length"])


@query
def log_extract(spark: SparkSession, d: str) -> DataFrame:
    """Log lines made from events; a run for each user."""
    e = spark.read.parquet(f"{d}/events.parquet").select(
        F.col("user_id").alias("run"), F.col("event_id").alias("line"), F.concat(F.lit("stage "), "event_type", F.lit(" took "), (F.col("event_id") % 97).cast("string"), F.lit(" us")).alias("value")
    )
    fields = {"first_stage": (r"stage (\w+) took", "first"), "total_us": (r"took (\d+) us", "sum"), "n_stages": (r"stage (\w+)", "count"), "max_us": (r"took (\d+) us", "max")}
    return logs.extract(e, fields)
