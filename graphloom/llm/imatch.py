"""I-Match fingerprints with randomised lexicons.

The lexicon holds the terms whose document frequency lies between two shares of all documents (an inverse-document-
frequency band), counted over the whole corpus. Its size is bounded: a share d leaves at most (mean distinct terms of a
document) / d terms. SLOTS random subsets of it are fixed, each term being in a subset of rate q with chance q; the
rates halve from 1/4 to 1/2048. A slot is the hash of all of the document's distinct terms that lie in its subset, in
sorted order, as I-Match has it; a fingerprint is the number of the document's lexicon terms and its slots.

Likeness. Two documents whose terms differ in x places have equal slots at rate q with chance (1 - q) ** x. The x that
makes the slots seen most likely gives the likeness (a + b - x) / (a + b + x) of documents with a and b terms: an
estimate of the Jaccard similarity of their terms. Equal fingerprints have likeness 1.

Defined cases. Null text is empty. A text without lexicon terms uses all its terms, one without terms has an empty
fingerprint; two empty fingerprints have likeness 1, an empty and another 0. Documents follow each other by id, null
ids first, rows of one id by text; after the last comes the first. A single document follows itself. An empty table
gives an empty result. Very long texts are read in whole, one at a time. Ids are numbers; only the id and the text are
read, so other columns can have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import Words, as_long, blocks, mix, per_batch

SLOTS, RATES = 60, 10
_SEEDS = mix(np.arange(1, SLOTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_HALVINGS = np.arange(SLOTS) % RATES + 2
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def _terms(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, term) pairs of a block, by text and term."""
    doc, h = words.doc(), words.hash
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def _frequencies(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    parts = []
    for _, _, buf, offs in blocks(batch.column(0)):
        _, h = _terms(Words(buf, offs, lower=True))
        parts.append(h)
    if parts:
        got, n = np.unique(np.concatenate(parts), return_counts=True)
        yield pa.RecordBatch.from_arrays([as_long(got), pa.array(n)], ["h", "n"])


def lexicon(docs: DataFrame, text_col: str = "text", rarest: float = 0.0005, commonest: float = 0.15) -> np.ndarray:
    """Sorted term hashes within the band of document frequency."""
    n = docs.count()
    counts = docs.select(text_col).mapInArrow(per_batch(_frequencies), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    found = counts.where((F.col("n") >= max(2, rarest * n)) & (F.col("n") <= max(2, commonest * n))).select("h").toArrow()
    return np.sort(found["h"].to_numpy().view(np.uint64))


def fingerprints(texts: pa.Array, lex: np.ndarray) -> list[str]:
    """A hexadecimal fingerprint of each text, four digits a slot."""
    out: list[str] = []
    for lo, hi, buf, offs in blocks(texts):
        doc, h = _terms(Words(buf, offs, lower=True))
        if len(lex) and len(h):
            at = np.minimum(np.searchsorted(lex, h), len(lex) - 1)
            known = lex[at] == h
        else:
            known = np.zeros(len(h), bool)
        some = np.bincount(doc[known], minlength=hi - lo) > 0
        use = known | ~some[doc]
        doc, h = doc[use], h[use]
        full, first = np.unique(doc, return_index=True)
        size = np.diff(np.append(first, len(doc)))
        slots = np.zeros((hi - lo, SLOTS + 1), np.uint16)
        slots[full, 0] = np.minimum(size, 65535)
        base = mix(h)
        for k in range(SLOTS):
            v = base * _SEEDS[k]
            at = np.flatnonzero((v ^ v >> np.uint64(29)) >> np.uint64(64 - _HALVINGS[k]) == 0)
            if len(at):
                own, begin = np.unique(doc[at], return_index=True)
                place = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
                total = np.add.reduceat(mix(h[at] + (place.astype(np.uint64) + np.uint64(1)) * _SEEDS[0]), begin)
                slots[own, k + 1] = (mix(total) >> np.uint64(48)).astype(np.uint16) | np.uint16(1)
        digits = _HEX[(slots[:, :, None] >> np.array([12, 8, 4, 0], np.uint16)) & 15].reshape(hi - lo, -1)
        has = np.bincount(full, minlength=hi - lo) > 0
        out += [digits[d].tobytes().decode() if has[d] else "" for d in range(hi - lo)]
    return out


def likeness(a: str, b: str) -> float:
    """How alike the documents of two fingerprints are, from 0 to 1."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    m, n = int(a[:4], 16), int(b[:4], 16)
    equal = np.zeros(RATES)
    for k in range(SLOTS):
        equal[_HALVINGS[k] - 2] += a[4 * k + 4 : 4 * k + 8] == b[4 * k + 4 : 4 * k + 8]
    x = _GRID[_GRID <= m + n]
    best = (_SAME[: len(x)] @ equal + _OTHER[: len(x)] @ (SLOTS // RATES - equal)).argmax()
    return float((m + n - x[best]) / (m + n + x[best]))


_GRID = np.unique(np.geomspace(1, 131072, 400).astype(np.int64)).astype(np.float64)
_SAME = _GRID[:, None] * np.log1p(-(0.5 ** np.arange(2, RATES + 2)))[None]
_OTHER = np.log(-np.expm1(_SAME))


def ring(docs: DataFrame, id_col: str, text_col: str, parts: int) -> DataFrame:
    """id, text, p and extra: in each part p, in order of (extra, id, text), runs of documents that follow each other; the
    one row with extra = 1 repeats the first document after the part, for the part's last."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    cuts = rows.select(F.percentile_approx("id", [i / parts for i in range(1, parts)] or [0.5], 10 * parts).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts))
    part = F.when(F.col("id").isNull(), 0).otherwise(_below(cuts, F.col("id"))) if cuts else F.lit(0)
    rows = rows.withColumn("p", part)
    # the first document of every part, in the order of the rows, goes behind the part before it; only the numbers of the
    # parts that have rows come to the driver
    heads = rows.groupBy("p").agg(F.min(F.struct(F.col("id").isNotNull().alias("k"), "id", F.coalesce("text", F.lit("")).alias("text"))).alias("h"))
    used = sorted(r["p"] for r in rows.select("p").distinct().collect())
    if not used:
        return rows.withColumn("extra", F.lit(0))
    before = dict(zip(used, [used[-1], *used[:-1]], strict=True))
    to = F.create_map(*(F.lit(x) for pair in before.items() for x in pair))
    after = heads.select("h.id", "h.text", to[F.col("p")].alias("p"), F.lit(1).alias("extra"))
    return rows.withColumn("extra", F.lit(0)).unionByName(after)


def _below(cuts: list, value: F.Column) -> F.Column:
    """How many of the sorted cuts are at most value, by halving."""
    held = F.array(*map(F.lit, cuts))

    def halve(acc: F.Column, _: F.Column) -> F.Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        up, live = F.get(held, mid) <= value, acc["lo"] < acc["hi"]
        return F.struct(F.when(live & up, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(live & ~up, mid).otherwise(acc["hi"]).alias("hi"))

    turns = F.array(*map(F.lit, range(len(cuts).bit_length() + 1)))
    return F.aggregate(turns, F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi")), halve)["lo"]


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next, for every row."""
    spark = docs.sparkSession
    lex = spark.sparkContext.broadcast(lexicon(docs, text_col))
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))  # several a task, so that tasks even out
    dealt = ring(docs, id_col, text_col, parts).repartition("p").sortWithinPartitions("p", "extra", "id", F.coalesce("text", F.lit("")))
    fields = [
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_chars", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")),
        T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the document before, which waits for its next one

        def rows(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
            """Cut a batch so that about 2 MB of text is in hand at a time."""
            lo, size = 0, 0
            for i, n in enumerate(pc.binary_length(batch.column(1)).to_pylist()):
                size += n or 0
                if size > 2 << 20:
                    yield lo, i + 1
                    lo, size = i + 1, 0
            if lo < batch.num_rows:
                yield lo, batch.num_rows

        def pairs(new: list[tuple]) -> Iterator[tuple]:
            nonlocal held
            for row in new:
                if held and held[0][2] == row[2]:
                    yield held[0], row
                held = [row] if not row[3] else []

        for batch in batches:
            for lo, hi in rows(batch):
                cut = batch.slice(lo, hi - lo)
                new = [(i, t or "", p, e) for i, t, p, e in zip(*(c.to_pylist() for c in cut.columns), strict=True)]
                both = list(pairs(new))
                if not both:
                    continue
                own = [a[1] for a, _ in both]
                edited = []
                for a, b in both:
                    q = len(a[1]) // 4
                    edited.append(a[1][: len(a[1]) - q] + b[1][:q])
                # the next texts are the own ones one row on, but for the ends of runs
                chain = [j + 1 < len(both) and both[j + 1][0] is both[j][1] for j in range(len(both))]
                ends = [b[1] for (_, b), c in zip(both, chain, strict=True) if not c]
                prints = fingerprints(pa.array([*own, *edited, *ends], pa.large_string()), lex.value)
                mine, theirs, rest = prints[: len(both)], prints[len(both) : 2 * len(both)], iter(prints[2 * len(both) :])
                after = [mine[j + 1] if c else next(rest) for j, c in enumerate(chain)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([a[0] for a, _ in both], batch.schema.field(0).type), pa.array([len(t) for t in own], pa.int64()),
                        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]), pa.array(mine), pa.array(theirs),
                        pa.array(map(likeness, mine, theirs), pa.float64()), pa.array(map(likeness, mine, after), pa.float64()),
                    ],
                    [f.name for f in fields],
                )

    return dealt.select("id", "text", "p", "extra").mapInArrow(run, T.StructType(fields))
