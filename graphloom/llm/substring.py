"""Removal of repeated passages: seed and extend on winnowed anchors.

A window is a run of `window` words. The hash of every run of ANCHOR words is a seed; of the seeds inside a window the
smallest is the window's anchor (winnowing), so equal windows always have equal anchors and about one word in five
starts an anchor. Anchors that occur in different texts are found by a pre-aggregated count; only at those places are
the seeds extended, to the left and right, to the whole windows that the anchor stands for. A window's owner is the
smallest id that holds it; windows found elsewhere cover the words to remove, and overlapping windows merge to maximal
repeats. Windows are keyed by 96 hash bits.

No pairs of documents are made: a group of m copies costs m rows. Whole copies of a text are set aside first.

Defined cases. Null text has no words. Texts shorter than a window lose nothing. Rows that share an id are one
document. A row with a null id keeps all its words and claims none. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import GRAM_A, GRAM_B, IdFilter, Words, as_long, blocks, finish_step, grams, inside, per_batch, staged

ANCHOR = 4


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each run of width values."""
    n, done = len(x) - width + 1, 1
    if n <= 0:
        return x[:0]
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[:n], x[width - done : width - done + n])


def _windows(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of each window and which windows lie in one text."""
    return sliding_min(grams(words.hash, ANCHOR, GRAM_A), window - ANCHOR + 1), inside(words.first, window)


def _anchors(batch: pa.RecordBatch, window: int) -> Iterator[pa.RecordBatch]:
    ids = batch.column(0).to_numpy()
    for lo, hi, buf, offs in blocks(batch.column(1)):
        words = Words(buf, offs)
        raw = buf.tobytes()
        text = np.array([int.from_bytes(hashlib.blake2b(raw[offs[d] : offs[d + 1]], digest_size=8).digest(), "little", signed=True) for d in range(hi - lo)], np.int64)
        anchor, ok = _windows(words, window)
        at = np.flatnonzero(ok)
        anchor, doc = anchor[at], words.doc()[at]
        new = np.ones(len(at), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
        yield pa.RecordBatch.from_arrays([as_long(anchor[new]), pa.array(text[doc[new]]), pa.array(ids[lo:hi][doc[new]])], ["a", "text", "id"])


def _extend(batch: pa.RecordBatch, window: int) -> Iterator[pa.RecordBatch]:
    ids, found = batch.column(0).to_numpy(), batch.column(2)
    for lo, hi, buf, offs in blocks(batch.column(1)):
        words = Words(buf, offs)
        anchor, ok = _windows(words, window)
        whole = grams(words.hash, window, GRAM_B)
        hit = np.zeros(len(ok), bool)
        for d in range(hi - lo):
            a, b = words.first[d], words.first[d + 1] - window + 1
            if b > a:
                hit[a:b] = np.isin(anchor[a:b].view(np.int64), found[lo + d].values.to_numpy())
        at = np.flatnonzero(hit & ok)
        yield pa.RecordBatch.from_arrays(
            [pa.array((anchor[at] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)), as_long(whole[at]), pa.array(ids[lo:hi][words.doc()[at]])],
            ["a", "w", "id"],
        )


def _finish(batch: pa.RecordBatch, window: int, n_keep: int, kept_text: bool) -> Iterator[pa.RecordBatch]:
    text, flags, copy = (batch.column(n_keep + i) for i in range(3))
    names = batch.schema.names[:n_keep]
    for lo, hi, buf, offs in blocks(text):
        words = Words(buf, offs)
        whole = grams(words.hash, window, GRAM_B).view(np.int64)
        cover = np.zeros(len(words.start) + 1, np.int64)
        for d in range(hi - lo):
            a, b = words.first[d], words.first[d + 1] - window + 1
            if b <= a:
                continue
            if copy[lo + d].as_py():
                hit = np.arange(a, b)
            elif flags[lo + d].is_valid:
                hit = a + np.flatnonzero(np.isin(whole[a:b], flags[lo + d].values.to_numpy()))
            else:
                continue
            np.add.at(cover, hit, 1)
            np.subtract.at(cover, hit + window, 1)
        keep = np.cumsum(cover)[:-1] <= 0
        out, at = words.joined(keep)
        shas = [hashlib.sha256(out[at[d] : at[d + 1]]).hexdigest() for d in range(hi - lo)]
        gone = np.concatenate([[0], np.cumsum(~keep)])[words.first]
        columns = [batch.column(i).slice(lo, hi - lo) for i in range(n_keep)]
        columns += [pa.array(words.counts.astype(np.int64)), pa.array(np.diff(gone).astype(np.int64)), pa.array(shas, pa.string())]
        if kept_text:
            columns.append(pa.Array.from_buffers(pa.string(), hi - lo, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(out)]))
        yield pa.RecordBatch.from_arrays(columns, [*names, "n_words", "n_removed", "kept_sha256", *["kept_text"] * kept_text])


def remove_repeats(docs: DataFrame, keep: list[str], window: int = 13, id_col: str = "doc_id", text_col: str = "text", kept_text: bool = False) -> DataFrame:
    """For each row: the columns in keep, n_words, n_removed, kept_sha256 and, if asked for, kept_text.

    Texts are shuffled only where they hold a shared anchor, and again where they lose words.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    owned = texts.where("id is not null")
    firsts = owned.select("id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")).groupBy("h").agg(F.min("id").alias("first_id")).select("first_id")
    firsts = staged(firsts.distinct(), "first-copies")

    # Seeds. Copies of a text share its hash, so they do not make an anchor shared. The key is changed after the count:
    # the join then deals both sides anew and can split a frequent anchor.
    anchored = owned.mapInArrow(per_batch(lambda b: _anchors(b, window)), f"a long, text long, id {kind}")
    shared = anchored.groupBy("a").agg(F.min("text").alias("least"), F.max("text").alias("most")).where("least < most")
    shared = shared.select(F.col("a").bitwiseXOR(F.lit(1)).alias("b"))
    places = anchored.select("a", "id").join(shared, F.col("a").bitwiseXOR(F.lit(1)) == F.col("b")).groupBy(F.col("id").alias("at_id")).agg(F.collect_set("a").alias("anchors"))
    places = staged(places.join(firsts, F.col("at_id") == F.col("first_id"), "left_semi"), "shared-anchors")
    finish_step(spark)

    # Extension.
    near = _passing(texts, ["id", "text"], IdFilter(places, "at_id")).join(places, F.col("id") == F.col("at_id")).select("id", "text", "anchors")
    extended = staged(near.mapInArrow(per_batch(lambda b: _extend(b, window)), f"a int, w long, id {kind}"), "windows")
    finish_step(spark)
    owner = extended.groupBy("a", "w").agg(F.min("id").alias("owner"), F.max("id").alias("most")).where("owner < most")
    owner = owner.select(F.col("w").bitwiseXOR(F.lit(1)).alias("v"), F.col("a").alias("c"), "owner")
    later = extended.join(owner, (F.col("w").bitwiseXOR(F.lit(1)) == F.col("v")) & (F.col("a") == F.col("c"))).where("id > owner")
    flags = later.groupBy("id").agg(F.collect_set("w").alias("flags")).select("id", "flags", F.lit(False).alias("copy"))
    copies = owned.select("id").join(firsts, F.col("id") == F.col("first_id"), "left_anti").distinct()
    marks = staged(flags.unionByName(copies.select("id", F.lit(None).cast("array<bigint>").alias("flags"), F.lit(True).alias("copy"))), "marks")
    finish_step(spark)

    # Removal.
    columns = [f"k{i}" for i in range(len(keep))]
    whole = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    out = [T.StructField(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(keep)]
    out += [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    out += [T.StructField("kept_text", T.StringType())] * kept_text
    touched = IdFilter(marks, "id")
    marks = marks.select(F.col("id").alias("mark_id"), "flags", "copy")
    some = _passing(whole, [*columns, "text", "id"], touched).join(marks, F.col("id") == F.col("mark_id"), "left")
    none = _passing(whole, [*columns, "text"], touched, want=False)
    rows = some.select(*columns, "text", "flags", F.coalesce("copy", F.lit(False)).alias("copy"))
    rest = none.withColumn("flags", F.lit(None).cast("array<bigint>")).withColumn("copy", F.lit(False))
    done = [x.mapInArrow(per_batch(lambda b: _finish(b, window, len(keep), kept_text)), T.StructType(out)) for x in (rows, rest)]
    taken = {"n_words", "n_removed", "kept_sha256", *["kept_text"] * kept_text}
    return done[0].union(done[1]).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep) if c not in taken], *[f.name for f in out[len(keep) :]])


def _passing(df: DataFrame, columns: list[str], which: IdFilter, want: bool = True) -> DataFrame:
    """Those rows (their id is in column id) that the filter lets pass, or those that it does not."""
    held = df.sparkSession.sparkContext.broadcast(which)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ok = held.value.passing(batch.column(0), batch.column(1)) == want
        yield batch.filter(pa.array(ok)).select(list(range(2, batch.num_columns)))

    h, b = IdFilter.keys(F.col("id"))
    return df.select(h.alias("__h"), b.alias("__b"), *columns).mapInArrow(per_batch(run), df.select(*columns).schema)
