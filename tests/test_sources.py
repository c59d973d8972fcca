from __future__ import annotations

import random
import pytest
import tiny
from pyspark.sql import functions as F

from graphloom.model import Params
from graphloom.operators import alignments, metrics, paths, simulate
from graphloom.plans import queries
from graphloom.plans.finder import SeedFinder
from graphloom.sources import gaf, gfa, logs, reads, tables, vg
from graphloom.streaming import seeds as streaming


def test_gfa_both_versions(spark, tmp_path):
    two = "H\tVN:Z:2.0\nO\tx\t1+ 2+\nS\t1\t3\tACG\nS\t2\t1\tt\nE\t9\t1+\t2+\t3$\t3$\t0\t0\t0M\nS\t5\t1\tA\n"
    one = "H\tVN:Z:1.0\nS\t1\tACG\nS\t2\tt\nL\t1\t+\t2\t+\t0M\nP\tx\t1+,2+\t*\nS\t5\tA\n"
    for text, name in ((two, "two.gfa"), (one, "one.gfa")):
        (tmp_path / name).write_text(text)
        n, e, s = gfa.read_graph(spark, f"file://{tmp_path}/{name}")
        assert {(r.node_id, r.seq, r.comp) for r in n.collect()} == {(1, "ACG", 1), (2, "T", 1), (5, "A", 5)}
        assert [(r.src, r.dst) for r in e.collect()] == [(1, 2)]
        assert [(r.path_name, r.pos, r.node_id) for r in s.orderBy("pos").collect()] == [("x", 0, 1), ("x", 1, 2)]
    gfa.write_gfa(n, e, s, f"file://{tmp_path}/out.gfa")
    assert gfa.read_graph(spark, f"file://{tmp_path}/out.gfa")[0].count() == 3
    with pytest.raises(ValueError):
        gfa.read_lines(spark, "x.txt")


def test_region_paths(spark, tmp_path):
    (tmp_path / "r.gfa").write_text("S\t1\tA\tSN:Z:chr1\tSO:i:0\nS\t2\tA\tSN:Z:chr1\tSO:i:5\n")
    assert gfa.region_paths(gfa.read_lines(spark, f"file://{tmp_path}/r.gfa")).collect()[0].value == "P\tchr1\t1+\t*"


def test_fasta_and_fastq(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">s1 first\nACG\nta\n>s2\nGG\n")
    got = reads.read_fasta(spark, f"file://{tmp_path}/a.fa").orderBy("read_id").collect()
    assert [tuple(r) for r in got] == [(0, "s1", "ACGTA"), (1, "s2", "GG")]
    (tmp_path / "a.fastq").write_text("@r1 0;5;F\nACGT\n+\n@III\n@r2\nGGGG\n+\nIIII\n")
    got = reads.read_fastq(spark, f"file://{tmp_path}/a.fastq").orderBy("read_id").collect()
    assert [(r.read_id, r.name, r.comment, r.seq, r.qual) for r in got] == [(0, "r1", "0;5;F", "ACGT", "@III"), (1, "r2", "", "GGGG", "IIII")]
    df = spark.createDataFrame(got)
    assert reads.chunk(df, 1, 5).count() == 1 and reads.chunk(df, 0).count() == 2
    reads.write_sequences(df, f"file://{tmp_path}/b.fastq")
    assert reads.read_fastq(spark, f"file://{tmp_path}/b.fastq").count() == 2
    with pytest.raises(ValueError):
        reads.write_sequences(df, "x", "bam")


def test_gaf(spark):
    line = "q/1\t10\t0\t10\t+\t>1<2\t20\t3\t13\t9\t10\t60\tdv:f:0.25\tNM:i:x\tcg:Z:10M\tNM:i:3\tzz:i:nope"
    star = "*\t*\t*\t*\t*\t*\t*\t*\t*\t*\t*\t*"
    df = spark.createDataFrame([(0, line), (1, star)], "line long, value string")
    a, b = gaf.parse(df).orderBy("line").collect()
    assert (a.q_name, a.q_fwd, a.p_start, a.tag_f["dv"], a.tag_i, a.tag_az) == ("q/1", True, 3, 0.25, {"NM": 3}, {"cg": "10M"})
    assert (b.q_name, b.q_len, b.q_fwd, b.block) == ("", 0, None, 0)
    steps = gaf.parse(df).select(alignments.oriented_path(F.col("path")).alias("p"), alignments.identity(F.col("tag_f")).alias("i")).collect()
    assert [tuple(x) for x in steps[0].p] == [(True, 1), (False, 2)] and steps[0].i == 0.75 and steps[1].p == []
    with pytest.raises(Exception, match="fewer than 12"):
        gaf.parse(spark.createDataFrame([(0, "a\tb")], "line long, value string")).collect()


def test_pairs_are_greedy(spark):
    names = ["a/1", "a/2", "b/1", "c/1", "c/2", "c/1", "d/1"]
    df = spark.createDataFrame(list(enumerate(names)), "line long, q_name string")
    got = sorted((r.one.line, r.two.line) for r in alignments.consecutive_pairs(df).collect())
    assert got == [(0, 1), (3, 4)]


def test_vg_round_trip(spark, tmp_path):
    graph = {"node": [{"id": 1, "sequence": "acg"}, {"id": 2, "sequence": "T"}], "edge": [{"from": 1, "to": 2}], "path": [{"name": "x", "mapping": [{"position": {"node_id": 1}, "rank": 1}, {"position": {"node_id": 2}, "rank": 2}]}]}
    half = {"node": [{"id": 2, "sequence": "T"}, {"id": -3, "sequence": "G"}]}
    (tmp_path / "g.vg").write_bytes(vg.stream([vg.encode(graph, "Graph"), vg.encode(half, "Graph")], group=1))
    n, e, s = vg.read_graph(spark, f"file://{tmp_path}/g.vg")
    assert {tuple(r) for r in n.collect()} == {(1, "ACG"), (2, "T"), (-3, "G")}
    assert [(r.src, r.dst) for r in e.collect()] == [(1, 2)] and s.count() == 2
    steps = spark.createDataFrame([(4, 0, 1), (4, 1, 2)], "path_id long, pos int, node_id long")
    p = paths.path_texts(steps, n).join(paths.mappings(steps, n), "path_id")
    data = vg.path_alignments(p).collect()[0].content
    a = vg.decode(next(vg.messages(bytes(data))), "Alignment")
    assert a["sequence"] == "ACGT" and [m["position"]["node_id"] for m in a["path"]["mapping"]] == [1, 2]


def test_logs(spark):
    df = spark.createDataFrame([("r", 1, "took 5 us"), ("r", 2, "took 7 us"), ("r", 3, "done")], "run string, line int, value string")
    got = logs.extract(df, {"a": (r"took (\d+)", "first"), "b": (r"took (\d+)", "sum"), "c": (r"(done)", "count")}).first()
    assert (got.a, got.b, got.c) == ("5", 12.0, 1)
    with pytest.raises(ValueError):
        logs.extract(df, {"a": ("x", "median")})


def test_streamed_seeds_equal_batch(spark):
    a = {tuple(r) for r in queries.QUERIES["seeds_stream"](spark, "/root/testdata/sf0.001").collect()}
    b = {tuple(r) for r in queries.QUERIES["seeds_on_paths"](spark, "/root/testdata/sf0.001").collect()}
    assert a == b and callable(streaming.start)


def test_simulated_reads_come_from_their_texts(spark):
    t = spark.createDataFrame([(1, "ACGTNACGTACGGTTACGAT"), (2, "ACG")], "hap_id long, text string")
    n = simulate.reads_per_haplotype(t.select("hap_id", F.length("text").alias("length")), 11, 6)
    assert {(r.hap_id, r.n_reads) for r in n.collect()} == {(1, 11), (2, 0)}
    got = simulate.single_end(t, n, 6).collect()
    assert len(got) == 11
    back = str.maketrans("ACGT", "TGCA")
    for r in got:
        s = r.seq if r.strand == "F" else r.seq.translate(back)[::-1]
        assert "N" not in s and t.collect()[0].text[r.pos : r.pos + 6] == s
    wrong = simulate.single_end(t, n, 6, error=1.0).collect()
    assert all(len(r.seq) == 6 for r in wrong) and any(r.seq != x.seq for r, x in zip(wrong, got, strict=True))


def test_metrics(spark):
    h = {(r.bin, r.n) for r in metrics.histogram(spark.createDataFrame([(1,), (2,), (3,), (9,)], "x int"), "x", 2).collect()}
    assert h == {(0, 1), (2, 2), (8, 1)}
    assert tiny.TEXTS[0] == "CAAATAAG"


def test_records_of_many_splits_and_files(spark, tmp_path):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        for f, n in (("a", 150), ("b", 90)):
            (tmp_path / f"{f}.fastq").write_text("".join(f"@{f}{i}\n{'ACGT' * (i % 9 + 1)}\n+\n@{'I' * (4 * (i % 9 + 1) - 1)}\n" for i in range(n)) + "@broken\nAC\n" * (f == "a"))
            (tmp_path / f"{f}.fasta").write_text("".join(f">{f}{i}\nACGT\nAC\n" for i in range(n)))
            (tmp_path / f"{f}.gaf").write_text("#header\n" + "".join(f"{f}{i // 2}/{i % 2 + 1}\t4\t0\t4\t+\t>1\t4\t0\t4\t4\t4\t60\n" for i in range(2 * n)))
        want = [f"a{i}" for i in range(150)] + [f"b{i}" for i in range(90)]
        got = reads.read_fastq(spark, f"file://{tmp_path}/*.fastq").orderBy("read_id").collect()
        assert [r.name for r in got] == want and [r.read_id for r in got] == list(range(240)) and all(len(r.seq) == len(r.qual) for r in got)
        got = reads.read_fasta(spark, f"file://{tmp_path}/*.fasta").orderBy("read_id").collect()
        assert [r.name for r in got] == want and [r.read_id for r in got] == list(range(240)) and {r.seq for r in got} == {"ACGTAC"}
        records = gaf.read_gaf(spark, f"file://{tmp_path}/*.gaf")
        assert records.groupBy("file").agg(F.max("line").alias("m"), F.count("*").alias("n")).where("m <> n - 1").count() == 0
        pairs = alignments.consecutive_pairs(records.select("file", "line", "q_name"), "file").collect()
        assert sorted(r.one.q_name[:-2] for r in pairs) == sorted(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def plain_counts(rows):
    """The records one after the other: (name, fn, fp, valid, high)."""
    out, wait = {}, None
    for name, fn, fp, valid, high in rows:
        own = out.setdefault(name, [0] * 5)
        if wait and not (valid and name == wait[1] and fp == wait[0]):
            out[wait[0]][1] += 1
            out[wait[0]][4] += wait[2]
            wait, broke = None, True
        else:
            broke = False
        if not valid:
            own[2] += 1
        elif wait:
            own[0] += 1
            own[3] += high and wait[2]
            own[4] += high != wait[2]
            wait = None
        elif fn and not broke:
            wait = (name, fn, high)
        else:
            own[1] += 1
            own[4] += high
    return {k: tuple(v) for k, v in out.items()}


def _as_records(spark, rows):
    made = [(i, n, ">1", 0, 1 if valid else 0, {k: v for k, v in (("fn", fn), ("fp", fp)) if v}, {"id": 0.95 if high else 0.5}) for i, (n, fn, fp, valid, high) in enumerate(rows)]
    return spark.createDataFrame(made, "line long, q_name string, path string, p_start long, block long, tag_az map<string,string>, tag_f map<string,float>")


def test_records_that_wait_for_their_mates(spark):
    by_hand = [
        ("a", "b", "", True, True), ("b", "", "a", True, True),  # a pair, both high
        ("c", "d", "", True, True), ("d", "", "x", True, False),  # the second names another: both single
        ("e", "f", "", True, False), ("f", "", "e", False, False),  # the second is invalid
        ("g", "h", "", True, False), ("h", "i", "g", True, True),  # a pair, one high; the second's own fn does not count
        ("i", "j", "", True, True), ("k", "l", "", True, True), ("l", "", "k", True, True),  # the second cannot wait: all single
        ("m", "n", "", True, True),  # waits at the end: nothing
    ]
    want = {"a": (0,) * 5, "b": (1, 0, 0, 1, 0), "c": (0, 1, 0, 0, 1), "d": (0, 1, 0, 0, 0), "e": (0, 1, 0, 0, 0), "f": (0, 0, 1, 0, 0), "g": (0,) * 5, "h": (1, 0, 0, 0, 1)}
    want |= {"i": (0, 1, 0, 0, 1), "k": (0, 1, 0, 0, 1), "l": (0, 1, 0, 0, 1), "m": (0,) * 5}
    assert plain_counts(by_hand) == want
    got = alignments.per_read_counts(_as_records(spark, by_hand)).collect()
    assert {r.name: (r.paired, r.single, r.invalid, r.hi_paired, r.hi_single) for r in got} == want
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.choice(["", "a", "b", "b"]), rng.choice(["", "a", "b"]), rng.random() < 0.9, rng.random() < 0.5) for _ in range(300)]
    r = alignments.held_back(_as_records(spark, rows), bucket=16)
    assert r.count() == 300
    got = alignments.per_read_counts(_as_records(spark, rows)).collect()
    assert {r.name: (r.paired, r.single, r.invalid, r.hi_paired, r.hi_single) for r in got} == plain_counts(rows)


def test_truth_flags(spark):
    loci = F.expr("array(named_struct('forward', true, 'node_id', 1L, 'offset', 5L), named_struct('forward', false, 'node_id', 2L, 'offset', 7L))")
    flag = lambda path, start: spark.range(1).select(alignments.truth_flag(F.lit(path), F.lit(start), loci).alias("f")).first().f
    assert [flag(">1>9", 5), flag(">1", 6), flag("<2>1", 7), flag("<2", 0), flag(">2", 7), flag(">8", 5)] == [3, 2, 12, 8, 0, 0]


def test_containment_and_algebra(spark):
    p = F.array(*map(F.lit, (1, 3, 5, 3, 6)))
    r = spark.range(1).select(
        paths.contains_run(p, F.array(F.lit(5), F.lit(3))).alias("a"), paths.contains_run(p, F.array(F.lit(1), F.lit(5))).alias("b"), paths.contains_all(p, F.array(F.lit(6), F.lit(1))).alias("c"),
        paths.trimmed_back(p, F.lit(3)).alias("d"), paths.trimmed_back(p, F.lit(3), False).alias("e"), paths.trimmed_front(p, F.lit(3)).alias("f"), paths.trimmed_front(p, F.lit(9)).alias("g"),
        paths.contains_by_rank(F.array(F.lit(1), F.lit(2), F.lit(4)), F.array(F.lit(1), F.lit(4))).alias("h"),
    ).first()
    assert tuple(r) == (True, False, True, [1, 3, 5], [1, 3, 5, 3], [5, 3, 6], [1, 3, 5, 3, 6], False)


def test_graph_chunks_and_loci_files(spark, tmp_path):
    n, e = tiny.nodes(spark), tiny.edges(spark)
    rows = vg.graph_chunks(n, e, 4).collect()
    assert len(rows) == 4
    (tmp_path / "g.vg").write_bytes(b"".join(bytes(r.content) for r in rows))
    nodes, edges, _ = vg.read_graph(spark, f"file://{tmp_path}/g.vg")
    assert nodes.count() == 15 and edges.count() == 20
    loci = spark.createDataFrame([(1, 2)], "node_id long, node_offset int")
    tables.write_json(loci, f"file://{tmp_path}/loci.json")
    assert tables.read_loci(spark, f"file://{tmp_path}/loci.json", "json").collect() == loci.collect()


def test_index_stats(spark):
    f = SeedFinder(tiny.nodes(spark), tiny.edges(spark), Params(12, paths=1))
    f.build()
    s = f.stats().first()
    assert (s.n_paths, s.n_bases, s.context, s.n_loci) == (1, 50, 12, 55) and s.n_uncovered > 0
