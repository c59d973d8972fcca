from __future__ import annotations

import random
from collections import Counter

import pytest
import tiny
from pyspark.sql import functions as F

from graphloom.functions import kmers as km
from graphloom.functions import scalar
from graphloom.model import Params
from graphloom.operators import distance, graph, haplotypes, paths, seeds, walks
from graphloom.plans.finder import SeedFinder
from graphloom.sources import tables


@pytest.mark.parametrize("k", [1, 3, 12])
def test_walks_equal_brute_force(spark, k):
    n, e = tiny.nodes(spark), tiny.edges(spark)
    got = Counter((r.node_id, r.node_offset, r.kmer, tuple(r.walk)) for r in walks.kwalks(graph.loci(n), n, e, k).collect())
    assert got == Counter((a, b, c, tuple(d)) for a, b, c, d in tiny.walks(k))
    assert walks.count_kwalks(n, e, k) == len(tiny.walks(k))


def test_no_walks_are_counted_for_k_0_and_backwards_is_refused(spark):
    assert walks.count_kwalks(tiny.nodes(spark), tiny.edges(spark), 0) == 0
    with pytest.raises(ValueError):
        walks.count_kwalks(tiny.nodes(spark), tiny.edges(spark), 3, forward=False)


def test_pruning_keeps_walks_of_known_kmers(spark):
    n, e = tiny.nodes(spark), tiny.edges(spark)
    want = {"AAATAAGG", "CTATTATA", "GGGGGGGG"}
    known = spark.createDataFrame([(x,) for x in want], "kmer string")
    got = Counter((r.node_id, r.node_offset, r.kmer) for r in walks.kwalks(graph.loci(n), n, e, 8, known).collect())
    assert got == Counter((a, b, c) for a, b, c, _ in tiny.walks(8) if c in want)


def test_walks_stop_at_n(spark):
    n = spark.createDataFrame([(1, 1, 1, 3, "ACN"), (2, 2, 1, 2, "GT")], "node_id long, rank long, comp long, len int, seq string")
    e = spark.createDataFrame([(1, 2)], "src long, dst long")
    assert {r.kmer for r in walks.kwalks(graph.loci(n), n, e, 2).collect()} == {"AC", "GT"}


def test_distances(spark):
    n, e = tiny.nodes(spark), tiny.edges(spark)
    pairs = distance.distance_pairs(n, e, 8, 12)
    q = spark.createDataFrame(tiny.NEAR + tiny.FAR, "v long, o int, u long, p int")
    ok = {(r.v, r.o, r.u, r.p): r.ok for r in distance.verify(q, pairs, 8, 12).collect()}
    assert all(ok[x] for x in tiny.NEAR) and not any(ok[x] for x in tiny.FAR)
    cells = distance.as_cells(pairs, n)
    assert distance.expand_ranges(distance.ranges(cells)).exceptAll(cells).isEmpty()
    assert cells.exceptAll(distance.expand_ranges(distance.ranges(cells))).isEmpty()
    with pytest.raises(ValueError):
        distance.distance_pairs(n, e, 5, 3)


def test_full_haplotypes(spark):
    n, e = tiny.nodes(spark), tiny.edges(spark)
    picked = haplotypes.pick_paths(n, e, 4)
    texts = {r.path_id: r.text for r in paths.path_texts(haplotypes.as_steps(picked), n).collect()}
    first, second = texts[1_000_000], texts[1_000_001]
    assert first == "CAAATAAGATTTGAAAATTTTCTGGAGTTCTATAATATACCAACTCTCTG"
    assert second == "CAAATAAGGCTTGGAAATTTTCTGGAGTTCTATTATATTCCAACTCTCTG"
    assert len(set(texts.values())) == 4
    assert picked.groupBy("path_no").count().select("count").distinct().collect()[0][0] == 10


@pytest.mark.parametrize(("k", "n_paths", "patched", "want"), [(12, 8, True, 0), (45, 32, False, 0)])
def test_enough_paths_leave_nothing_uncovered(spark, k, n_paths, patched, want):
    f = SeedFinder(tiny.nodes(spark), tiny.edges(spark), Params(k, paths=n_paths, patched=patched))
    assert f.build().loci.count() == want


def test_few_paths_leave_loci(spark):
    f = SeedFinder(tiny.nodes(spark), tiny.edges(spark), Params(12, paths=4))
    got = {(r.node_id, r.node_offset) for r in f.build().loci.collect()}
    assert got <= {(1, i) for i in range(2, 8)} | {(2, 0), (3, 0), (4, 0), (5, 0)} | {(9, i) for i in range(19)} | {(6, i) for i in range(3)} | {(n, 0) for n in range(7, 15)} | {(12, i) for i in range(4)}


@pytest.mark.parametrize("n_paths", [0, 1, 3])
def test_the_finder_is_complete(spark, n_paths, tmp_path):
    n, e = tiny.nodes(spark), tiny.edges(spark)
    reads = spark.createDataFrame([(i, t) for i, (_, _, t, _) in enumerate(tiny.walks(14)[::5])] + [(900, "NACGTTTTA"), (901, "AC")], "read_id long, seq string")
    p = Params(7, paths=n_paths, distinct=True, dmin=3, dmax=5)
    f = SeedFinder(n, e, p)
    f.build()
    got = {tuple(r) for r in f.seeds(reads).collect()}
    rk = km.kmers(reads, 7, 7).collect()
    want = {(a, b, r.read_id, r.read_offset) for a, b, t, _ in tiny.walks(7) for r in rk if r.kmer == t}
    assert got == want and got
    if n_paths:
        f.save(f"file://{tmp_path}/index")
        g = SeedFinder(n, e, p)
        g.load(f"file://{tmp_path}/index")
        assert {tuple(r) for r in g.seeds(reads).collect()} == want
        with pytest.raises(tables.IndexMismatch):
            tables.load(spark, f"file://{tmp_path}/index_paths", "paths", k=8, paths=n_paths, patched=True, context=8)


def test_parameters_are_checked():
    for bad in ({"k": 0}, {"k": 5, "context": 3}, {"k": 5, "dmin": 4, "dmax": 2}, {"k": 5, "paths": -1}):
        with pytest.raises(ValueError):
            Params(**bad)


def test_seeding_policies(spark):
    r = spark.createDataFrame([(0, "CAAATAAGAT"), (1, "ACGTA"), (2, "ACGT"), (3, "ACG")], "read_id long, seq string")
    got = {p: [x.kmer for x in km.kmers(r.where("read_id = 0"), 4, policy=p).orderBy("read_offset").collect()] for p in km.POLICIES}
    assert got["overlapping"] == ["CAAA", "AAAT", "AATA", "ATAA", "TAAG", "AAGA", "AGAT"]
    assert got["non_overlapping"] == ["CAAA", "TAAG"]
    assert got["greedy_non_overlapping"] == ["CAAA", "TAAG", "AGAT"]
    assert [x.kmer for x in km.kmers(r.where("read_id = 1"), 4, policy="greedy_non_overlapping").orderBy("read_offset").collect()] == ["ACGT", "CGTA"]
    assert km.kmers(r.where("read_id = 2"), 4, policy="greedy_non_overlapping").count() == 1
    assert km.kmers(r.where("read_id = 3"), 4).count() == 0
    with pytest.raises(ValueError):
        km.offsets(F.lit(9), 4, policy="other")


def test_next_kmer(spark):
    r = spark.createDataFrame([("AAA", "AAC"), ("ACT", "AGA"), ("ATT", "CAA"), ("TTT", "AAA")], "a string, b string")
    assert r.where(km.next_kmer(F.col("a")) != F.col("b")).isEmpty()


def test_kmer_join_counts(spark):
    def table(texts, k):
        return km.kmers(spark.createDataFrame(list(enumerate(texts)), "read_id long, seq string"), k)

    a, b = table(["GATAGACTAGCCA", "GGGCGTAGCCA"], 4), table(["GGGCGTAGCCA"], 4)
    assert seeds.kmer_matches(a.drop("read_id", "read_offset"), b).count() == 11
    assert seeds.kmer_matches(a.drop("read_id", "read_offset"), b, limit=1).count() == 5
    n = table(["ACGNACGT"], 4)
    assert seeds.kmer_matches(n.select("kmer"), n).count() == 1
    assert seeds.kmer_matches(n.select("kmer"), n, allow_n=True).count() == 5


def test_greedy_matches_equal_a_scan(spark):
    texts = ["ACGTACGTTACGGA", "TTACGTACCA"]
    reads = ["ACGTACCAGG", "GGACGTT", "TACGTACG", "NACGTA", "A", "CACGTTTACGTACCAT"]

    def scan(read, least, limit):
        out, start, n = [], 0, 0
        while start + n < len(read):
            hit = False
            if n >= least:
                occ = [(i, p) for i, t in enumerate(texts) for p in range(len(t) - n + 1) if t[p : p + n] == read[start : start + n]]
                if len(occ) <= (limit or 10**9):
                    hit = True
                    out += [(start, n, i, p) for i, p in occ]
            if hit or read[start + n] == "N" or not any(read[start : start + n + 1] in t for t in texts):
                start, n = start + n + 1, 0
            else:
                n += 1
        return out

    nodes = spark.createDataFrame([(i + 1, s) for i, s in enumerate(texts)], "node_id long, seq string")
    steps = spark.createDataFrame([(i, 0, i + 1) for i in range(len(texts))], "path_id long, pos int, node_id long")
    df = spark.createDataFrame(list(enumerate(reads)), "read_id long, seq string")
    for least, limit in ((3, 0), (3, 1), (4, 2)):
        got = sorted((r.read_id, r.read_offset, r.match_len, r.node_id - 1, r.node_offset) for r in seeds.greedy_matches(paths.path_texts(steps, nodes), paths.path_kmers(steps, nodes, least), df, least, limit).collect())
        assert got == sorted((i, *x) for i, r in enumerate(reads) for x in scan(r, least, limit))


def test_greedy_matches_of_any_length_and_with_n(spark):
    """Matches over 1000 bases, an N in a text and many copies of a text, held against a scan that extends base by base."""
    rng = random.Random(3)
    long = "".join(rng.choices("ACGT", k=1300))
    texts = [long, long[:1200] + "C" + long[:30], "ACGTNACGTTNNGA", *["GATTACA" * 3] * 40, "A" * 60]
    reads = [long[:1250], long[5:1195] + "GG" + long[300:340], "TACGTNACGTTC", "CGATTACAGATTACAGATTACATT", "A" * 30 + "NN" + "A" * 70, "N", "", "ACG", *("".join(rng.choices("ACGT", k=40)) for _ in range(20))]

    def scan(read, least, limit, most):
        out, start, n, hits = [], 0, 0, 0
        while start + n < len(read):
            occ = [(i, p) for i, t in enumerate(texts) for p in range(len(t) - n + 1) if t.startswith(read[start : start + n], p)] if n >= least else []
            hit = n >= least and len(occ) <= (limit or 10**9)
            if hit:
                out += [(start, n, len(occ), i, p) for i, p in occ]
                hits += len(occ)
                if most and hits >= most:
                    break
            if hit or read[start + n] == "N" or not any(read[start : start + n + 1] in t for t in texts):
                start, n = start + n + 1, 0
            else:
                n += 1
        return out

    nodes = spark.createDataFrame([(i + 1, s) for i, s in enumerate(texts)], "node_id long, seq string")
    steps = spark.createDataFrame([(i, 0, i + 1) for i in range(len(texts))], "path_id long, pos int, node_id long")
    df = spark.createDataFrame(list(enumerate(reads)), "read_id long, seq string")
    for least, limit, most in ((4, 1, 0), (4, 0, 3)):
        found = seeds.greedy_matches(paths.path_texts(steps, nodes), paths.path_kmers(steps, nodes, least), df, least, limit, most).collect()
        assert sorted((r.read_id, r.read_offset, r.match_len, r.gocc, r.node_id - 1, r.node_offset) for r in found) == sorted((i, *x) for i, r in enumerate(reads) for x in scan(r, least, limit, most))


def test_path_ends_and_positions(spark):
    n = tiny.nodes(spark)
    steps = spark.createDataFrame([(7, i, x) for i, x in enumerate((1, 3, 5, 6))], "path_id long, pos int, node_id long")
    ends = spark.createDataFrame([(7, 3, 2)], "path_id long, head int, tail int")
    assert paths.path_texts(steps, n, ends).first().text == "AAGGCTT"
    assert paths.path_texts(steps, n, ends, reverse=True).first().text == "TTCGGAA"
    at = [(r.node_id, r.node_offset) for r in paths.position_map(steps, n, ends).orderBy("text_pos").collect()]
    assert at == [(1, 5), (1, 6), (1, 7), (3, 0), (5, 0), (6, 0), (6, 1)]
    q = spark.createDataFrame([(7, 4)], "path_id long, text_pos int")
    assert paths.locate(q, paths.step_starts(steps, n, ends)).select("node_id", "node_offset").first() == (5, 0)


def test_graph_without_edges_and_empty_graph(spark):
    n = spark.createDataFrame([(1, 1, 1, 2, "AC"), (2, 2, 2, 0, "")], "node_id long, rank long, comp long, len int, seq string")
    e = spark.createDataFrame([], "src long, dst long")
    assert {(r.node_id, r.level) for r in graph.bfs_levels(n, e).collect()} == {(1, 0), (2, 0)}
    assert walks.kwalks(graph.loci(n), n, e, 2).count() == 1
    empty = n.limit(0)
    assert graph.bfs_levels(empty, e).count() == 0 and walks.kwalks(graph.loci(empty), empty, e, 2).count() == 0
    assert distance.distance_pairs(empty, e, 1, 3).count() == 0
    assert haplotypes.pick_paths(empty, e, 2).count() == 0


def test_breadth_first_restarts(spark):
    n = spark.createDataFrame([(i, i, 1, 1, "A") for i in range(1, 5)], "node_id long, rank long, comp long, len int, seq string")
    e = spark.createDataFrame([(1, 3), (2, 3), (2, 4)], "src long, dst long")
    assert {(r.node_id, r.level) for r in graph.bfs_levels(n, e).collect()} == {(1, 0), (3, 1), (2, 0), (4, 1)}


def test_scalars(spark):
    one = spark.range(1)
    powers = one.select(*[scalar.next_power_of_two(F.lit(x)).alias(f"c{x}") for x in (0, 1, 2, 3, 4, 5, 1023, 1024, 2**40 + 1)]).first()
    assert list(powers) == [1, 1, 2, 4, 4, 8, 1024, 1024, 2**41]
    r = one.select(
        scalar.reverse_complement(F.lit("ACGTN")).alias("a"), scalar.without_pair_suffix(F.lit("r_1/2")).alias("b"), scalar.last_position(F.array(F.lit(1), F.lit(2), F.lit(1)), F.lit(1)).alias("c"),
        scalar.trimmed(F.lit(" x "), "left").alias("d"), scalar.field(F.lit("a;b"), 5).alias("e"), scalar.without_last(F.lit("abc"), 2).alias("f"),
    ).first()
    assert tuple(r) == ("NACGT", "r_1", 2, "x ", None, "a")
