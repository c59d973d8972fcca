"""Analytics on alignment records (GAF)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.scalar import hashed_uniform, without_last, without_pair_suffix

# Names of the read classes (first that holds), of the further counts, and of the truth classes by flag.
CLASSES = (
    ("NHUP", "hi_paired = 1"), ("NHMP", "hi_paired > 1"), ("NLUP", "paired = 1"), ("NLMP", "paired > 1"), ("NHUS", "hi_single = 1"),
    ("NHDS", "hi_single = 2"), ("NHMS", "hi_single > 2"), ("NLUS", "single = 1"), ("NLDS", "single = 2"), ("NLMS", "single > 2"),
)
FURTHER = (("NRAL", "paired > 0 or single > 0"), ("NMUL", "paired + single > 1"), ("NWIN", "invalid > 0"))
TRUTH = {"NFFM": (0b1111,), "NPPM": (0b1010,), "NFPM": (0b1110, 0b1011), "NFNM": (0b1100, 0b0011), "NPNM": (0b1000, 0b0010), "NNNM": (0,)}


def is_valid(block: Column) -> Column:
    return block != 0


def identity(tag_f: Column) -> Column:
    """Tag id, else 1 - dv, else 0."""
    return F.coalesce(tag_f["id"], F.lit(1.0) - tag_f["dv"], F.lit(0.0))


def oriented_path(path: Column) -> Column:
    """Array of (forward, node_id). A path of stable names (without > or <) is an error."""
    parts = F.regexp_extract_all(path, F.lit("([><][^><]+)"), F.lit(1))
    nodes = F.transform(parts, lambda x: F.struct((F.left(x, F.lit(1)) == ">").alias("forward"), F.substr(x, F.lit(2)).cast("long").alias("node_id")))
    return F.when(path == "*", F.array().cast("array<struct<forward:boolean,node_id:bigint>>")).when(F.size(parts) > 0, nodes).otherwise(F.raise_error(F.lit("stable path names are not supported")))


def consecutive_pairs(records: DataFrame, block: str | None = None) -> DataFrame:
    """Records (line, q_name, ...) paired with the next one where the names agree but for the pair suffix.

    Pairing is greedy in file order: a record that ended a pair starts none. Among runs of equal names, that is the odd
    records of the run, so two windows suffice and the file is never gathered in one task. Runs are found by `line`, which
    must ascend by one within a file; block: a column with the file.
    """
    name = without_pair_suffix("q_name")
    key = [block] if block else []
    r = records.withColumn("__name", name)
    by_name = W.partitionBy(*key, "__name").orderBy("line")
    r = r.withColumn("__run", F.col("line") - F.row_number().over(by_name))
    in_run = W.partitionBy(*key, "__name", "__run").orderBy("line")
    r = r.withColumn("__i", F.row_number().over(in_run)).withColumn("__mate", F.lead(F.struct(*records.columns)).over(in_run))
    pairs = r.where((F.col("__i") % 2 == 1) & F.col("__mate").isNotNull())
    return pairs.select(F.struct(*records.columns).alias("one"), F.col("__mate").alias("two"))


def truth_loci(truth: DataFrame, trim: bool = False) -> DataFrame:
    """q_name, loci: the first oriented node and the offset of every valid truth record of a read, in file order. Reads with
    invalid records only have none. trim: names lose their last two characters."""
    first = F.get(oriented_path(F.col("path")), F.lit(0))
    locus = F.when(is_valid(F.col("block")), F.struct("line", first["forward"].alias("forward"), first["node_id"].alias("node_id"), F.col("p_start").alias("offset")))
    name = without_last("q_name", 2) if trim else F.col("q_name")
    got = truth.select(name.alias("q_name"), locus.alias("l")).groupBy("q_name").agg(F.array_sort(F.collect_list("l")).alias("l"))
    return got.select("q_name", F.transform("l", lambda x: F.struct(x["forward"].alias("forward"), x["node_id"].alias("node_id"), x["offset"].alias("offset"))).alias("loci"))


def fragments(loci: DataFrame) -> DataFrame:
    """n_fragments (3: three or more), n_reads of truth_loci rows."""
    return loci.groupBy(F.least(F.size("loci"), F.lit(3)).alias("n_fragments")).agg(F.count("*").alias("n_reads"))


def truth_flag(path: Column, p_start: Column, loci: Column) -> Column:
    """For the first truth locus on the record's first oriented node, two bits at twice its number: 2, and 1 more if the
    offsets agree; 0 if there is none. More than four loci are an error."""
    first = F.get(oriented_path(path), F.lit(0))
    at = F.array_position(F.transform(loci, lambda x: F.struct(x["forward"].alias("forward"), x["node_id"].alias("node_id"))), first) - 1
    same = F.get(loci, at.cast("int"))["offset"] == p_start
    flag = F.when(F.coalesce(at, F.lit(-1)) < 0, 0).otherwise((F.lit(2) + same.cast("int")) * F.pow(F.lit(4), at).cast("int"))
    return F.when(F.size(loci) > 4, F.raise_error(F.lit("too many ground truth fragments"))).otherwise(flag)


def held_back(records: DataFrame, block: str | None = None, bucket: int = 65_536) -> DataFrame:
    """records with mate (name, next, high of the record before, where that one waits for this one) and held (this one waits).

    A valid record that names its next fragment (tag fn) waits for the next record, unless the one before it waits already.
    So in a run of such records every other one waits, the first among them: it is enough to know how far back the last
    other record is, which is found by a window in each range of lines and one over the ranges. line must ascend by one
    within a file; block: a column with the file.
    """
    key = [block] if block else []
    r = records.withColumn("__next", F.coalesce(F.col("tag_az")["fn"], F.lit(""))).withColumn("__b", F.floor(F.col("line") / bucket))
    starts = is_valid(F.col("block")) & (F.col("__next") != "")
    r = r.withColumn("__stop", F.when(~starts, F.col("line")))
    ranges = r.groupBy(*key, "__b").agg(F.max("__stop").alias("__s"), F.min("line").alias("__l"))
    over = W.partitionBy(*key) if key else W.partitionBy(F.lit(0))
    ranges = ranges.select(*key, "__b", F.max("__s").over(over.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)).alias("__s"), (F.min("__l").over(over) - 1).alias("__l"))
    within = F.max("__stop").over(W.partitionBy(*key, "__b").orderBy("line").rowsBetween(W.unboundedPreceding, 0))
    r = r.withColumn("__w", within).join(ranges, [*key, "__b"])
    r = r.withColumn("held", starts & ((F.col("line") - F.coalesce("__w", "__s", "__l")) % 2 == 1)).drop("__stop", "__w", "__s", "__l", "__b")
    waits = r.where("held").select(*key, (F.col("line") + 1).alias("line"), F.struct(F.col("q_name").alias("name"), F.col("__next").alias("next"), identity(F.col("tag_f")).alias("identity")).alias("mate"))
    return r.drop("__next").join(waits, [*key, "line"], "left")


def per_read_counts(records: DataFrame, loci: DataFrame | None = None, min_identity: float = 0.9, block: str | None = None) -> DataFrame:
    """name, paired, single, invalid, hi_paired, hi_single, flag of every read name.

    A record that waits (see held_back) and the next one are a pair, counted for the second's name, if the second is valid,
    has the name awaited and names the first (tag fp): high if both are, else a single high one if either is. Otherwise the
    one that waited is a single, and so is the second if it is valid. What waits at the end of a file counts as nothing.
    flag: the truth flags of all valid records. Identities are rounded to six digits, since tags are single precision.
    """
    high = lambda x: F.coalesce(F.round(x.cast("double"), 6) >= min_identity, F.lit(False))
    r = held_back(records, block).withColumn("valid", is_valid(F.col("block"))).withColumn("high", high(identity(F.col("tag_f"))))
    r = r.withColumn("waited", F.col("mate").isNotNull()).withColumn("mate_high", high(F.col("mate.identity")))
    met = F.col("waited") & F.col("valid") & (F.col("q_name") == F.col("mate.next")) & (F.col("mate.name") == F.coalesce(F.col("tag_az")["fp"], F.lit("")))
    r = r.withColumn("met", F.coalesce(met, F.lit(False)))
    if loci is None:
        r = r.withColumn("flag", F.lit(0))
    else:
        r = r.join(loci.select(F.col("q_name").alias("__name"), "loci"), F.col("q_name") == F.col("__name"), "left")
        r = r.withColumn("flag", F.when(F.col("valid") & F.col("loci").isNotNull(), truth_flag(F.col("path"), F.col("p_start"), F.col("loci"))).otherwise(0))
    alone = F.col("valid") & ~F.col("met") & ~F.col("held")
    one = lambda c: c.cast("long")
    own = F.struct(
        F.col("q_name").alias("name"), one(F.col("met")).alias("paired"), one(alone).alias("single"), one(~F.col("valid")).alias("invalid"), one(F.col("met") & F.col("high") & F.col("mate_high")).alias("hi_paired"),
        (one(F.col("met") & (F.col("high") != F.col("mate_high"))) + one(alone & F.col("high"))).alias("hi_single"), F.col("flag").alias("flag"),
    )
    none = F.lit(0).cast("long")
    left = F.struct(F.col("mate.name").alias("name"), none.alias("paired"), F.lit(1).cast("long").alias("single"), none.alias("invalid"), none.alias("hi_paired"), one(F.col("mate_high")).alias("hi_single"), F.lit(0).alias("flag"))
    each = r.select(F.explode(F.when(F.col("waited") & ~F.col("met"), F.array(own, left)).otherwise(F.array(own))).alias("e")).select("e.*")
    sums = [F.sum(c).alias(c) for c in ("paired", "single", "invalid", "hi_paired", "hi_single")]
    return each.groupBy("name").agg(*sums, F.bit_or("flag").alias("flag"))


def read_classes(truth: bool = False) -> Column:
    """The classes of a per_read_counts row: at most one of CLASSES, then FURTHER, then one of TRUTH if there is a truth."""
    first = F.coalesce(*[F.when(F.expr(rule), name) for name, rule in CLASSES])
    more = [F.when(F.expr(rule), name) for name, rule in FURTHER]
    told = [F.when(F.col("flag").isin(*flags), name) for name, flags in TRUTH.items()] if truth else []
    return F.array_compact(F.array(first, *more, *told))


def class_counts(counts: DataFrame, truth: bool = False) -> DataFrame:
    """class, n of per_read_counts rows."""
    return counts.select(F.explode(read_classes(truth)).alias("class")).groupBy("class").agg(F.count("*").alias("n"))


def class_sample(counts: DataFrame, wanted: str, rate: float, seed: int = 0, truth: bool = False) -> DataFrame:
    """The counts of a class's reads, each kept with probability rate by a hash of its name."""
    return counts.where(F.array_contains(read_classes(truth), wanted)).where(hashed_uniform("name", seed=seed) < rate)


def header_counts(records: DataFrame) -> DataFrame:
    """n_records, n_valid, n_invalid."""
    v = is_valid(F.col("block"))
    return records.agg(F.count("*").alias("n_records"), F.count_if(v).alias("n_valid"), F.count_if(~v).alias("n_invalid"))


def end_coordinates(pairs: DataFrame, nodes: DataFrame, inner: bool = True) -> DataFrame:
    """pairs (one, two) with v, o, u, p: the loci between which a pair's distance is asked.

    The record whose path starts forward comes first. inner: from the last base of the first to that of the second (whose
    path is read from its end); else from the start of the first to the far end of the second.
    """
    size = nodes.select(F.col("node_id").alias("__id"), F.length("seq").alias("__n"))
    swap = ~F.get(oriented_path(F.col("one.path")), F.lit(0))["forward"]
    p = pairs.withColumn("__a", F.when(swap, F.col("two")).otherwise(F.col("one"))).withColumn("__c", F.when(swap, F.col("one")).otherwise(F.col("two")))
    node = lambda c, last: F.element_at(oriented_path(F.col(f"{c}.path")), -1 if last else 1)["node_id"]
    p = p.withColumn("v", node("__a", inner)).withColumn("u", node("__c", inner))
    asked = p.join(size, F.col("__id") == F.col("v" if inner else "u"), "left")
    if inner:
        o, q = F.col("__n") - (F.col("__a.p_len") - F.col("__a.p_end")) - 1, F.col("__c.p_len") - F.col("__c.p_end")
    else:
        o, q = F.col("__a.p_start"), F.col("__n") - F.col("__c.p_start") - 1
    return asked.select(*pairs.columns, "v", o.cast("int").alias("o"), "u", q.cast("int").alias("p"))


def reference_position(records: DataFrame, ref_starts: DataFrame) -> DataFrame:
    """line, path_id, ref_pos: where a record's first step on a reference path lies on it.

    ref_starts: path_id, node_id, start. Bases of earlier steps and the offset in the first node are taken off.
    """
    steps = records.select("line", "p_start", F.posexplode(oriented_path(F.col("path"))).alias("i", "s")).select("line", "p_start", "i", F.col("s.node_id").alias("node_id"))
    hit = steps.join(ref_starts, "node_id")
    first = hit.groupBy("line").agg(F.min_by(F.struct("path_id", "start", "i", "p_start"), F.struct("i", "path_id", "start")).alias("f"))
    return first.select("line", "f.path_id", (F.col("f.start") + F.when(F.col("f.i") == 0, F.col("f.p_start")).otherwise(0)).alias("ref_pos"))


def pair_distances(pairs: DataFrame, positions: DataFrame) -> DataFrame:
    """line, distance of paired records on the same reference path; a negative one is kept, and marked by its sign."""
    a, b = (positions.select(F.col("line").alias(f"l{i}"), F.col("path_id").alias(f"p{i}"), F.col("ref_pos").alias(f"r{i}")) for i in (1, 2))
    p = pairs.select(F.col("one.line").alias("l1"), F.col("two.line").alias("l2"), F.col("two.q_len").alias("n2"))
    return p.join(a, "l1").join(b, "l2").where("p1 = p2").select(F.col("l1").alias("line"), (F.col("r2") + F.col("n2") - F.col("r1")).alias("distance"))
