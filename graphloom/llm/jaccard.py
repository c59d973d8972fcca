"""N-gram Jaccard join by grouped prefixes: components of documents whose word-shingle sets are similar.

A document's set holds the 64-bit hashes of its distinct k-word shingles. All documents order their shingles the same
way: by hash, with the shingles that a bounded sample shows to be common put last. Sets with Jaccard similarity of at
least s share a shingle in their prefixes of n - ceil(s n) + 1 shingles. The steps:

1. Documents with identical prefixes and size form a group, with identical sets a class within it. All later work is
   on groups and classes, so copies cost one row each.
2. Prefix shingles of one group only are dropped after a pre-aggregated count. The others form one list a group.
3. Rounds. Every shingle names one of its groups, in turn the likeliest centre of near copies and any one, and each group
   is compared with the few named groups of other components with which it shares most shingles: a number of pairs in proportion to the input. Pairs
   that share enough prefix shingles for a link are verified on whole texts, and components grow. In the first round
   the classes of a group are also compared with its first class. Rounds end when one finds few links for its pairs.
4. Completeness. Groups that hold several components between them and share a prefix shingle are paired. Each pair is
   made at the first shingle the two share only (not where one of the shingles before it is shared too), and only if
   the size and the places leave room for a link. Pairs that share enough prefix shingles (an upper bound of the
   overlap, so no link is lost) are expanded to their classes, which are verified if they are of different components.

The order, the sample and the rounds only steer cost: every link between components is found, whatever they are.

Defined cases. Null and blank texts have an empty set and are linked with nothing. Rows that share an id are one node,
with the links of all its texts. A null id is linked with nothing and its component is null. Texts of fewer than k words
have one shingle, their whole sequence. Very long texts are read in whole, one at a time. An empty table gives an empty
result. Only the id and the text are read, so other columns can have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.common import GRAM_A, GRAM_B, IdFilter, Words, as_long, blocks, components, finish_step, grams, mix, near_components, per_batch, staged

HOT = np.uint64(1 << 63)


@dataclass(frozen=True)
class Plan:
    """k words a shingle; similarity at least num/den; shingles in at least common of about sample documents go last.
    best: how many named groups a group is compared with in a round; worth: a round follows one that found a link in
    every so many pairs; before: how many shingles before a shared one are looked at in step 4."""

    k: int = 5
    num: int = 75
    den: int = 100
    sample: int = 20_000
    common: int = 3
    best: int = 3
    worth: int = 10
    before: int = 6

    def prefix(self, n: int) -> int:
        return n - (self.num * n + self.den - 1) // self.den + 1

    def beyond(self, n: str) -> str:
        """SQL: how many shingles of a set of size n lie behind its prefix."""
        return f"(ceil({self.num} * {n} / {self.den}) - 1)"

    def overlap_at_least(self, n: str, m: str) -> str:
        """SQL: the least overlap of linked sets of sizes n and m."""
        return f"ceil({self.num} * ({n} + {m}) / {self.num + self.den})"


def shingles(texts: pa.Array, plan: Plan, common: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle values) of every text; common: sorted values that get the high bit."""
    for lo, hi, buf, offs in blocks(texts):
        words = Words(buf, offs, lower=True)
        value = grams(words.hash, plan.k, GRAM_A) >> np.uint64(1)
        if common is not None and len(common) and len(value):
            at = np.minimum(np.searchsorted(common, value), len(common) - 1)
            value = np.where(common[at] == value, value | HOT, value)
        for d in range(hi - lo):
            a, b = int(words.first[d]), int(words.first[d + 1])
            if b - a >= plan.k:
                own = np.sort(value[a : b - plan.k + 1])
                new = np.ones(len(own), bool)
                new[1:] = own[1:] != own[:-1]
                yield lo + d, own[new]
            elif b > a:
                yield lo + d, grams(words.hash[a:b], b - a, GRAM_B) >> np.uint64(1)
            else:
                yield lo + d, value[:0]


def _sampled(batch: pa.RecordBatch, plan: Plan) -> Iterator[pa.RecordBatch]:
    parts = [v for _, v in shingles(batch.column(0), plan)]
    if parts:
        got, n = np.unique(np.concatenate(parts), return_counts=True)
        yield pa.RecordBatch.from_arrays([as_long(got), pa.array(n)], ["t", "n"])


def common_shingles(docs: DataFrame, text: str, key: str, plan: Plan) -> np.ndarray:
    """Shingles in at least plan.common documents of a sample of about plan.sample (by a hash of the key): at most
    sample * size / common values, whatever the number of documents."""
    n = docs.count()
    share = min(1.0, plan.sample / max(n, 1))
    rows = docs.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select(text)
    counts = rows.mapInArrow(per_batch(lambda b: _sampled(b, plan)), "t long, n long").groupBy("t").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") >= plan.common).select("t").toArrow()["t"].to_numpy()
    return np.sort(found.view(np.uint64))


def _signature(values: np.ndarray, salt: int) -> np.int64:
    return mix(mix(values ^ np.uint64(salt)).sum(dtype=np.uint64)[None] + np.uint64(len(values)))[0].view(np.int64)


def _profile(batch: pa.RecordBatch, plan: Plan, common: np.ndarray) -> Iterator[pa.RecordBatch]:
    n, group, sig = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
    for row, v in shingles(batch.column(1), plan, common):
        n[row] = len(v)
        if len(v):
            group[row], sig[row] = _signature(v[: plan.prefix(len(v))], 0x5EED) + len(v), _signature(v, 0xC1A55)
    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(group), pa.array(sig)], ["id", "n", "g", "sig"])


def _prefixes(batch: pa.RecordBatch, plan: Plan, common: np.ndarray) -> Iterator[pa.RecordBatch]:
    groups, parts, places, size = [], [], [], 0

    def flushed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([as_long(np.concatenate(parts)), pa.array(np.concatenate(groups)), pa.array(np.concatenate(places).astype(np.int32))], ["t", "g", "pos"])

    for _, v in shingles(batch.column(0), plan, common):
        if len(v):
            p = v[: plan.prefix(len(v))]
            parts.append(p)
            groups.append(np.full(len(p), _signature(p, 0x5EED) + len(v)))
            places.append(np.arange(len(p)))
            size += len(p)
        if size > 200_000:
            yield flushed()
            groups, parts, places, size = [], [], [], 0
    if parts:
        yield flushed()


# --- verification ----------------------------------------------------------------------------------------------------


def _verify(batch: pa.RecordBatch, plan: Plan) -> Iterator[pa.RecordBatch]:
    sets = [dict(shingles(batch.column(c), plan)) for c in (2, 3)]
    ok = np.zeros(batch.num_rows, bool)
    for i in range(batch.num_rows):
        a, b = sets[0][i], sets[1][i]
        both = len(np.intersect1d(a, b, assume_unique=True))
        ok[i] = both > 0 and plan.den * both >= plan.num * (len(a) + len(b) - both)
    keep = pa.array(ok)
    yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["x", "y"])


def verified(pairs: DataFrame, docs: DataFrame, plan: Plan) -> DataFrame:
    """The pairs (x, y) of ids whose whole texts are linked. Texts of other documents are dropped before the shuffle."""
    kind = pairs.schema["x"].dataType.simpleString()
    ids = pairs.select(F.col("x").alias("id")).union(pairs.select("y")).distinct()
    needed = docs.sparkSession.sparkContext.broadcast(IdFilter(ids, "id"))

    def passing(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield batch.filter(pa.array(needed.value.passing(batch.column(0), batch.column(1)))).select([2, 3])

    h, b = IdFilter.keys(F.col("id"))
    texts = docs.select(h.alias("h"), b.alias("b"), "id", "text").mapInArrow(per_batch(passing), f"id {kind}, text string")
    left = pairs.join(texts.select(F.col("id").alias("x"), F.col("text").alias("a")), "x")
    both = left.join(texts.select(F.col("id").alias("y"), F.col("text").alias("b")), "y").select("x", "y", "a", "b")
    return both.mapInArrow(per_batch(lambda b: _verify(b, plan)), f"x {kind}, y {kind}")


# --- the join --------------------------------------------------------------------------------------------------------


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plan: Plan = Plan()) -> DataFrame:
    """(id, n_shingles, component_id) for every row."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    usable = docs.where("id is not null and text is not null")
    common = spark.sparkContext.broadcast(common_shingles(usable, "text", "id", plan))
    profile = staged(docs.mapInArrow(per_batch(lambda b: _profile(b, plan, common.value)), f"id {kind}, n long, g long, sig long"), "profile")
    # classes of identical sets, x being the least id; a group is led by its least class
    classes = staged(profile.where("n > 0 and id is not null").groupBy("g", "n", "sig").agg(F.min("id").alias("x")), "classes")
    leaders = classes.groupBy("g").agg(F.min("x").alias("y"), F.first("n").alias("n"))

    rows = usable.select("text").mapInArrow(per_batch(lambda b: _prefixes(b, plan, common.value)), "t long, g long, pos int")
    # the count's key is changed, so that the join deals both sides anew and can split a frequent shingle
    shared = rows.groupBy("t").agg(F.min("g").alias("least"), F.max("g").alias("most")).where("least < most").select(F.col("t").bitwiseXOR(F.lit(1)).alias("u"))
    found = rows.join(shared, F.col("t").bitwiseXOR(F.lit(1)) == F.col("u"), "left_semi").groupBy("g", "t").agg(F.min("pos").alias("pos"))
    lists = found.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("l")).join(leaders.withColumnRenamed("g", "lg"), F.col("g") == F.col("lg"))
    lists = staged(lists.select("g", "n", "y", F.col("l.pos").alias("places"), F.col("l.t").alias("ts")), "prefix-lists")
    finish_step(spark)

    inner = classes.join(leaders.select("g", "y"), "g").where("x <> y").select("x", "y")
    links, label = inner.limit(0), None
    for turn in range(8):
        pairs = _named(lists, label, turn, plan)
        pairs = staged((pairs if turn else pairs.union(inner)).distinct(), "pairs")
        new = staged(verified(pairs, usable, plan), "links")
        n, tried = new.count(), pairs.count()
        links = staged(links.union(new), "links")
        label = near_components(links, "x", "y")
        finish_step(spark)
        if plan.worth * n <= tried:
            break

    survivors = staged(_survivors(lists, classes, label, plan), "near-pairs")
    more = staged(verified(survivors, usable, plan), "links")
    finish_step(spark)
    last = components(links.union(more), "x", "y")
    common.destroy()
    labelled = classes.join(last, classes.x == last.node, "left").select(
        F.col("g").alias("cg"), F.col("sig").alias("csig"), F.col("n").alias("cn"), F.coalesce("component", "x").alias("component")
    )
    # rows with one id and several texts take the least of their components
    by_row = profile.join(labelled, (profile.g == labelled.cg) & (profile.sig == labelled.csig) & (profile.n == labelled.cn) & profile.id.isNotNull(), "left")
    return by_row.select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def _named(lists: DataFrame, label: DataFrame | None, turn: int, plan: Plan) -> DataFrame:
    """x, y: the first classes of groups of different components, each group with the best few groups that its shingles name."""
    if label is None:
        led = lists.withColumn("k", F.col("y"))
    else:
        led = lists.join(label, F.col("y") == F.col("node"), "left").withColumn("k", F.coalesce("component", "y"))
    # in every other round the group with the largest share of shingles that others have too, a likely centre of its copies
    central = F.size("ts") / F.expr(f"n - {plan.beyond('n')}") if turn % 2 == 0 else F.lit(0.0)
    rows = led.select("g", "n", "k", F.struct(central.alias("a"), F.xxhash64("g", F.lit(turn)).alias("b")).alias("order"), F.explode("ts").alias("t"))
    name = rows.groupBy("t").agg(F.max_by(F.struct("g", "n", "k"), "order").alias("h"))
    name = name.select(F.col("t").bitwiseXOR(F.lit(1)).alias("u"), F.col("h.g").alias("g2"), F.col("h.n").alias("n2"), F.col("h.k").alias("k2"))
    met = rows.join(name, F.col("t").bitwiseXOR(F.lit(1)) == F.col("u")).where(f"k <> k2 and {_sizes(plan)}")
    best = met.groupBy("g", "g2").agg(F.count("*").alias("c"))
    best = best.withColumn("i", F.row_number().over(W.partitionBy("g").orderBy(F.desc("c"), "g2"))).where(F.col("i") <= plan.best)
    return _sharing(best.select("g", "g2"), lists, plan).select("x", "y")


def _sharing(pairs: DataFrame, lists: DataFrame, plan: Plan) -> DataFrame:
    """g, g2, x, y: those pairs of groups that share enough prefix shingles for a link; x and y are their first classes."""
    other = lists.select(F.col("g").alias("g2"), F.col("n").alias("n2"), F.col("y").alias("z"), F.col("ts").alias("ts2"))
    both = pairs.join(lists.select("g", "n", F.col("y").alias("x"), "ts"), "g").join(other, "g2")
    return both.withColumn("c", F.size(F.array_intersect("ts", "ts2"))).where(_enough(plan, "n", "n2")).select("g", "g2", "x", F.col("z").alias("y"))


def _survivors(lists: DataFrame, classes: DataFrame, label: DataFrame, plan: Plan) -> DataFrame:
    """x, y: classes of different components whose groups share enough prefix shingles for a link."""
    node = classes.join(label, classes.x == label.node, "left").select("g", "x", F.coalesce("component", "x").alias("k"))
    spans = node.groupBy("g").agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
    rows = lists.join(spans, "g").select("g", "n", "lo", "hi", "ts", F.posexplode(F.arrays_zip("places", "ts")).alias("i", "e"))
    before = F.slice("ts", F.greatest(F.lit(1), F.col("i") + 1 - plan.before), F.least(F.col("i"), F.lit(plan.before)))
    rows = rows.select("g", "n", "lo", "hi", F.col("e.ts").alias("t"), F.col("e.places").alias("pos"), before.alias("before"))
    mixed = rows.groupBy("t").agg(F.min("lo").alias("a"), F.max("hi").alias("b")).where("a < b").select(F.col("t").bitwiseXOR(F.lit(1)).alias("u"))
    rows = staged(rows.join(mixed, F.col("t").bitwiseXOR(F.lit(1)) == F.col("u"), "left_semi"), "open-shingles")
    other = rows.select(F.col("t").alias("s"), *(F.col(c).alias(f"{c}2") for c in ("g", "n", "lo", "hi", "pos", "before")))
    # Linked sets share at least `least` prefix shingles, so the first they share has as many places behind it in both.
    least, p, p2 = f"greatest(1, {plan.overlap_at_least('n', 'n2')} - greatest({plan.beyond('n')}, {plan.beyond('n2')}))", f"n - {plan.beyond('n')}", f"n2 - {plan.beyond('n2')}"
    room = f"g < g2 and least(lo, lo2) < greatest(hi, hi2) and {_sizes(plan)} and pos + {least} <= {p} and pos2 + {least} <= {p2} and not arrays_overlap(before, before2)"
    pairs = staged(rows.join(other, F.expr(f"t = s and {room}")).select("g", "g2").distinct(), "group-pairs")
    pairs = _sharing(pairs, lists, plan).select("g", "g2").union(spans.where("lo < hi").select("g", F.col("g").alias("g2")))
    one, two = (node.select(F.col("g").alias(g), F.col("x").alias(x), F.col("k").alias(k)) for g, x, k in (("g", "x", "k"), ("g2", "y", "k2")))
    return pairs.join(one, "g").join(two, "g2").where("k <> k2 and (g <> g2 or x < y)").select("x", "y").distinct()


def _sizes(plan: Plan) -> str:
    """Whether sets of sizes n and n2 can be linked."""
    return f"{plan.den} * n >= {plan.num} * n2 and {plan.den} * n2 >= {plan.num} * n"


def _enough(plan: Plan, n: str, m: str) -> F.Column:
    """Whether c shared prefix shingles leave room for a link of sets of sizes n and m."""
    return F.expr(f"c + greatest({plan.beyond(n)}, {plan.beyond(m)}) >= {plan.overlap_at_least(n, m)}")
