"""Seeds: k-mer joins on paths, expansion off paths, whole-read matches and the greedy match scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.operators.walks import kwalks
from graphloom.staging import staged

#: Greedy matches: the characters held behind a position at first, the longest prefix of the first round, how many
#: lengths a round has while more than so many positions are open, and the characters of all prefixes of a round with
#: fewer. They set the speed only.
PREFIX, FIRST, WIDTHS, CHARS = 64, 9, ((1_000_000, 1), (100_000, 4)), 200_000_000
COLUMNS = ("node_id", "node_offset", "read_id", "read_offset", "match_len", "gocc")


def kmer_matches(index: DataFrame, reads: DataFrame, limit: int = 0, allow_n: bool = False) -> DataFrame:
    """Equi-join of two k-mer tables, with gocc: how often the k-mer occurs in index. k-mers over the limit are skipped.

    The count is pre-aggregated and only k-mers within the limit are joined, which also keeps repeats from skewing it.
    """
    n = index.groupBy("kmer").agg(F.count("*").alias("gocc"))
    n = n if limit == 0 else n.where(F.col("gocc") <= limit)
    hits = index.join(n, "kmer").join(reads, "kmer")
    return hits if allow_n else hits.where("not contains(kmer, 'N')")


def on_paths(path_kmers: DataFrame, read_kmers: DataFrame, k: int, limit: int = 0) -> DataFrame:
    """Seeds on indexed paths; gocc counts the k-mer on paths."""
    hits = kmer_matches(path_kmers.select("kmer", "node_id", "node_offset"), read_kmers, limit)
    return hits.select("node_id", "node_offset", "read_id", "read_offset", F.lit(k).alias("match_len"), "gocc")


def off_paths(starts: DataFrame, nodes: DataFrame, edges: DataFrame, read_kmers: DataFrame, k: int, prune: bool = False) -> DataFrame:
    """Seeds on walks from the starting loci; gocc counts the k-mer in the reads. prune: drop walks no read begins."""
    walks = kwalks(starts, nodes, edges, k, read_kmers if prune else None).select("node_id", "node_offset", "kmer")
    n = read_kmers.groupBy("kmer").agg(F.count("*").alias("gocc"))
    hits = walks.join(read_kmers, "kmer").join(n, "kmer")
    return hits.select("node_id", "node_offset", "read_id", "read_offset", F.lit(k).alias("match_len"), "gocc")


def all_seeds(on: DataFrame, off: DataFrame, distinct: bool = False) -> DataFrame:
    """Both, with their source, as a bag; or the distinct (locus, read position)s."""
    both = on.withColumn("source", F.lit("on")).unionByName(off.withColumn("source", F.lit("off")))
    return both.select("node_id", "node_offset", "read_id", "read_offset").distinct() if distinct else both


def totals(seeds: DataFrame) -> DataFrame:
    """n_hits, n_off_paths, n_reads."""
    return seeds.agg(F.count("*").alias("n_hits"), F.count_if(F.col("source") == "off").alias("n_off_paths"), F.countDistinct("read_id").alias("n_reads"))


def whole_reads(texts: DataFrame, path_kmers: DataFrame, reads: DataFrame, k: int) -> DataFrame:
    """node_id, node_offset, read_id, path_id, text_pos where a whole read lies on a path.

    The read's first k-mer finds candidates by an equi-join; the rest is compared in place. Reads shorter than k: none.
    """
    first = reads.where(F.length("seq") >= k).select("read_id", "seq", F.left("seq", F.lit(k)).alias("kmer"))
    near = path_kmers.join(first, "kmer").join(texts, "path_id")
    return near.where("substr(text, text_pos + 1, length(seq)) = seq").select("node_id", "node_offset", "read_id", "path_id", "text_pos")


def greedy_matches(texts: DataFrame, path_kmers: DataFrame, reads: DataFrame, min_length: int, limit: int = 0, max_hits: int = 0) -> DataFrame:
    """A greedy scan of each read: extend from a start until the match is at least min_length long and occurs at most
    `limit` times (0: any), report all its occurrences, and go on behind the character that ended it.

    A match that would reach the last character of the read is not reported, as the scan ends there. An N ends a match.
    After max_hits hits (0: no limit) a read's scan stops; the last match is reported whole. path_kmers must have
    k = min_length.

    Text positions and the reads' starts go down the texts' prefixes together, some lengths a round. Both leave at their
    first prefix that occurs at most `limit` times, so starts are joined with counts of prefixes and never with the
    positions that share a min_length-mer; the hits are one equi-join with the prefixes at which positions left. The
    scan itself folds a read's starts. A prefix shorter than min_length that occurs nowhere moves the start beyond the
    failing character.
    """
    most = limit or 2**31 - 1
    parts = int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a small table can make very many starts
    reads = reads.select("read_id", "seq").where(F.length("seq") > min_length)
    top = max(min_length, (reads.agg(F.max(F.length("seq"))).first()[0] or 0) - 1)  # the longest match that can be reported
    have = min(max(PREFIX, min_length), top)

    def spelled(rows: DataFrame, text: str, at: str) -> DataFrame:
        """s: the first characters behind each position, up to an N."""
        return rows.withColumn("s", F.substring_index(F.expr(f"substr({text}, {at} + 1, {have})"), "N", 1)).drop(text)

    starts = reads.repartition(parts, "read_id").withColumn("start", F.explode(F.sequence(F.lit(0), F.length("seq") - min_length - 1))).withColumn("room", F.length("seq") - F.col("start") - 1)
    starts = spelled(starts, "seq", "start")
    spots = staged(spelled(path_kmers.drop("kmer").join(texts, "path_id"), "text", "text_pos").repartition(parts, "path_id", "text_pos"), "spots")
    done, left, at, n_open = [], [], min_length - 1, spots.count()
    while True:
        width = next((w for n, w in WIDTHS if n_open > n), max(16, min(at, CHARS // (n_open * at + 1))))
        to = min(max(at + width, min(FIRST, min_length + 3)), top)
        if to > have:
            have = max(to, 4 * have)
            spots = staged(spelled(spots.drop("s").join(texts, "path_id"), "text", "text_pos"), "spots")
            starts = staged(spelled(starts.drop("s").join(reads, "read_id"), "seq", "start"), "starts")
        spots = spots.where(F.length("s") > at)
        prefixes = spots.select(F.explode(F.transform(F.sequence(F.lit(at + 1), F.least(F.lit(to), F.length("s"))), lambda m: F.left("s", m))).alias("prefix"))
        prefixes = staged(prefixes.groupBy("prefix").agg(F.count("*").alias("n")), "prefixes")
        spots = staged(_descend(spots, ["path_id", "text_pos"], F.length("s"), prefixes, at, to, most), "spots")
        starts = staged(_descend(starts.where(F.col("room") > at), ["read_id", "start"], F.col("room"), prefixes, at, to, most), "starts")
        left.append(spots.where("leaf is not null").select(F.expr("left(s, leaf.m)").alias("prefix"), "node_id", "node_offset", F.col("leaf.n").alias("gocc")))
        done.append(starts.where("leaf is not null").select("read_id", "start", F.lit(True).alias("hit"), F.col("leaf.m").alias("step")))
        ended = starts.where(F.col("leaf").isNull() & (F.col("depth") < F.least(F.lit(to), "room")))
        if at < min_length:  # how far a start without a whole min_length-mer gets
            done.append(_reach(ended.where(F.col("depth") < min_length), texts, min_length).select("read_id", "start", F.lit(False).alias("hit"), F.col("short").alias("step")))
        done.append(ended.where(F.col("depth") >= min_length).select("read_id", "start", F.lit(False).alias("hit"), F.col("depth").alias("step")))
        spots, starts = (x.where(F.col("leaf").isNull() & (F.col("depth") == to)).drop("leaf", "depth") for x in (spots, starts))
        at, more, n_open = to, starts.count(), spots.count()
        if at >= top or not more:
            break
        n_open = max(n_open, more)
    plan = reduce(DataFrame.union, done).groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct("start", "hit", "step"))).alias("s"))
    seen = F.aggregate(
        "s", F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<start:int,step:int>>").alias("taken")),
        lambda acc, x: F.when(
            x["start"] == acc["next"],
            F.struct(
                (x["start"] + x["step"] + 1).alias("next"),
                F.when(x["hit"], F.concat(acc["taken"], F.array(F.struct(x["start"].alias("start"), x["step"].alias("step"))))).otherwise(acc["taken"]).alias("taken"),
            ),
        ).otherwise(acc),
    )
    taken = plan.select("read_id", F.explode(seen["taken"]).alias("t")).join(reads, "read_id")
    taken = taken.select("read_id", F.col("t.start").alias("read_offset"), F.col("t.step").alias("match_len"), F.expr("substr(seq, t.start + 1, t.step)").alias("prefix"))
    hits = taken.join(reduce(DataFrame.union, left), "prefix")
    if max_hits:
        per = hits.groupBy("read_id", "read_offset").agg(F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(W.partitionBy("read_id").orderBy("read_offset").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        hits = hits.join(per.withColumn("before", before).where(F.col("before") < max_hits).select("read_id", "read_offset"), ["read_id", "read_offset"], "left_semi")
    return hits.select(*COLUMNS)


def _descend(rows: DataFrame, key: list[str], room: Column, prefixes: DataFrame, at: int, to: int, most: int) -> DataFrame:
    """rows (s, with prefixes up to room) with depth: the longest prefix of s met on the way from at to to, and leaf
    (m, n): the first one that occurs at most `most` times, where the row stops. A few lengths are a join each, which
    moves no row while the prefixes are few; many lengths are one join of all of a row's prefixes."""
    if to - at > 4:
        met = rows.select(*key, "s", F.explode(F.sequence(F.lit(at + 1), F.least(F.lit(to), room))).alias("m")).withColumn("prefix", F.expr("left(s, m)")).join(prefixes, "prefix")
        met = met.where(F.length("prefix") == F.col("m")).groupBy(*key).agg(F.max("m").alias("depth"), F.min(F.when(F.col("n") <= most, F.struct("m", "n"))).alias("leaf"))
        return rows.join(met, key, "left").withColumn("depth", F.coalesce("depth", F.lit(at)))
    out = rows.withColumn("depth", F.lit(at)).withColumn("leaf", F.lit(None).cast("struct<m:int,n:bigint>"))
    for m in range(at + 1, to + 1):
        live = F.col("leaf").isNull() & (F.col("depth") == m - 1) & (room >= m)
        met = prefixes.where(F.length("prefix") == m)
        out = out.withColumn("key", F.when(live, F.left("s", F.lit(m)))).join(met, F.col("key") == F.col("prefix"), "left")
        leaf = F.when(F.col("n") <= most, F.struct(F.lit(m).alias("m"), F.col("n").alias("n"))).otherwise(F.col("leaf"))
        out = out.withColumn("leaf", leaf).withColumn("depth", F.when(F.col("n").isNotNull(), m).otherwise(F.col("depth"))).drop("key", "prefix", "n")
    return out


def _reach(starts: DataFrame, texts: DataFrame, min_length: int) -> DataFrame:
    """read_id, start, short: the longest prefix of s below min_length that occurs on a path."""
    out = starts.select("read_id", "start", "s").withColumn("short", F.lit(0))
    spot = texts.where(F.length("text") > 0).select("text", F.explode(F.sequence(F.lit(1), F.length("text"))).alias("i"))
    tips = spot.select(F.substring_index(F.expr(f"substr(text, i, {min_length - 1})"), "N", 1).alias("tip")).distinct()
    for m in range(1, min_length):
        known = tips.where(F.length("tip") >= m).select(F.left("tip", F.lit(m)).alias("p")).distinct()
        key = F.when((F.col("short") == m - 1) & (F.length("s") >= m), F.left("s", F.lit(m)))
        out = out.withColumn("key", key).join(known, F.col("key") == F.col("p"), "left")
        out = out.withColumn("short", F.when(F.col("p").isNotNull(), m).otherwise(F.col("short"))).drop("key", "p")
    return out


def prefix_table(texts: DataFrame, depth: int) -> DataFrame:
    """prefix, n: every substring of up to depth characters and how often it occurs (a trie's nodes and counts)."""
    n = F.length("text")
    at = texts.select("text", F.explode(F.sequence(F.lit(1), n)).alias("i")).select(F.expr(f"substr(text, i, {depth})").alias("s"))
    prefix = at.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("s")), lambda m: F.left("s", m))).alias("prefix"))
    return prefix.groupBy("prefix").agg(F.count("*").alias("n"))
