"""Language identification by prediction by partial matching (PPM).

Every language has a variable-order context tree over byte classes (orders 0 to 3) with frozen counts. A byte's
probability in a context with T visits and q distinct successors is c/(T+q) if seen there, else the escape q/(T+q)
times its probability one order lower; order -1 is uniform. Since the counts are frozen the trees are compiled into
one table of code lengths, addressed by the longest context kept, and a text's exact code length under each language
is a sum over its bytes. The shortest code wins; ties go to the first language in alphabetical order.

Defined cases. Null and empty texts and texts without a letter are `und` with score 0; repeated rows are scored row by
row; an empty table gives an empty result, and training on none a model that knows no language. Very long texts are
read in whole. Columns in keep with the name of a result are replaced by it. The table has one row for each context
kept, of 158 code lengths a language: some tens of MB for a few languages, and its size follows the sample alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import blocks, per_batch

# Byte classes: start of text, 26 letters (case folded), white space and controls, digits, other ASCII, each high byte.
CLASSES = np.full(256, 29, np.int32)
CLASSES[:33] = 27
CLASSES[48:58] = 28
CLASSES[97:123] = np.arange(1, 27)
CLASSES[65:91] = np.arange(1, 27)
CLASSES[128:] = np.arange(30, 158)
SIZE = 158
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True


@dataclass
class Model:
    """langs; state: row of each 3-class context; bits: code lengths by (row, class, language)."""

    langs: list[str]
    state: np.ndarray
    bits: np.ndarray


def _classes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The contexts (as one number) and classes of all bytes; a text starts after three start symbols."""
    n = len(offs) - 1
    x = np.zeros(len(buf) + 3 * n, np.int32)
    at = np.arange(len(buf)) + 3 * np.repeat(np.arange(1, n + 1), np.diff(offs))
    x[at] = CLASSES[buf]
    context = (x[at - 3] * SIZE + x[at - 2]) * SIZE + x[at - 1]
    return context, x[at]


def _count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    langs = batch.column(1).to_pylist()
    for lo, hi, buf, offs in blocks(batch.column(0)):
        context, symbol = _classes(buf, offs)
        key = context.astype(np.int64) * SIZE + symbol
        names = sorted(set(langs[lo:hi]))
        which = np.repeat([names.index(x) for x in langs[lo:hi]], np.diff(offs))
        for k, name in enumerate(names):
            got, n = np.unique(key[which == k], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(got)), pa.array(got), pa.array(n)], ["lang", "gram", "n"])


def train(docs: DataFrame, usable: Column, max_rows_per_lang: int = 1500, min_visits: int = 4) -> Model:
    """Fit on a bounded sample of the usable labelled rows.

    About max_rows_per_lang whole texts of each language are taken by a hash of doc_id (all if there are fewer), which
    bounds the counts that reach the driver. Order-3 contexts visited fewer than min_visits times are left to order 2.
    Null texts and null languages teach nothing. Without any usable row the model knows no language.
    """
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang", "doc_id")
    found = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(max_rows_per_lang / n)) for k, n in found.items()], F.lit(0.0))
    picked = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    grams = picked.mapInArrow(per_batch(_count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return compile_trees(grams.toArrow(), min_visits)


def compile_trees(grams: pa.Table, min_visits: int) -> Model:
    """The frozen trees of (lang, gram, n), as a table."""
    name = np.array(grams["lang"].to_pylist(), object)
    gram, n = grams["gram"].to_numpy(), grams["n"].to_numpy().astype(np.float64)
    langs = sorted(set(name))
    contexts, visits = _sums(gram // SIZE, n)
    kept = contexts[visits >= min_visits]
    # rows: order 0, then every order-1 context, the order-2 contexts seen, the order-3 contexts kept
    twos = np.unique(kept % SIZE**2) if len(kept) else kept
    state = np.tile(np.arange(1, SIZE + 1, dtype=np.int32), SIZE**2)
    row_of_two = np.zeros(SIZE**2, np.int32)
    row_of_two[twos] = np.arange(len(twos)) + 1 + SIZE
    state = np.where((two := np.tile(row_of_two, SIZE)) > 0, two, state)
    state[kept] = np.arange(len(kept)) + 1 + SIZE + len(twos)
    bits = np.empty((1 + SIZE + len(twos) + len(kept), SIZE, len(langs)), np.float32)
    for k, lang in enumerate(langs):
        own, c = gram[name == lang], n[name == lang]
        p0 = _ppm(np.zeros(1, np.int64), own % SIZE, c, np.full((1, SIZE), 1 / SIZE))
        p1 = _ppm(np.arange(SIZE), own % SIZE**2, c, np.repeat(p0, SIZE, 0))
        p2 = _ppm(twos, own % SIZE**3, c, p1[twos % SIZE])
        p3 = _ppm(kept, own, c, p2[np.searchsorted(twos, kept % SIZE**2)] if len(kept) else p2[:0])
        bits[:, :, k] = -np.log2(np.concatenate([p0, p1, p2, p3]))
    return Model(langs, state, bits)


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    got, back = np.unique(keys, return_inverse=True)
    return got, np.bincount(back, n, len(got))


def _ppm(contexts: np.ndarray, grams: np.ndarray, n: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Probabilities by (context, symbol); contexts are sorted, lower is the distribution one order below."""
    count = np.zeros(lower.shape)
    if len(contexts):
        row = np.minimum(np.searchsorted(contexts, grams // SIZE), len(contexts) - 1)
        ok = contexts[row] == grams // SIZE
        np.add.at(count, (row[ok], (grams % SIZE)[ok]), n[ok])
    total, distinct = count.sum(1, keepdims=True), (count > 0).sum(1, keepdims=True)
    seen = count / np.maximum(total + distinct, 1)
    escape = np.where(total > 0, distinct / np.maximum(total + distinct, 1), 1.0)
    return np.where(count > 0, seen, escape * lower)


def code_lengths(model: Model, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Bits of every text under every language."""
    out = np.zeros((len(offs) - 1, len(model.langs)))
    full = np.flatnonzero(offs[:-1] < offs[1:])
    if len(full) and model.langs:
        context, symbol = _classes(buf, offs)
        cost = model.bits.reshape(-1, len(model.langs))[model.state[context] * SIZE + symbol]
        out[full] = np.add.reduceat(cost, offs[:-1][full], axis=0, dtype=np.float64)
    return out


def has_letter(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    total = np.concatenate([[0], np.cumsum(LETTER[buf])])
    found = total[offs[1:]] > total[offs[:-1]]
    high = np.concatenate([[0], np.cumsum(buf > 127)])
    for d in np.flatnonzero(~found & (high[offs[1:]] > high[offs[:-1]])):
        found[d] = any(map(str.isalpha, buf[offs[d] : offs[d + 1]].tobytes().decode("utf-8", "replace")))
    return found


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns in keep, lang_pred, score (the winner's posterior under equal priors; 0 for `und`) and bits_per_byte (its code).

    Null texts, texts without a letter, and all texts under a model without languages are `und`.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in keep if c not in ("lang_pred", "score", "bits_per_byte")]
    kept = [docs.schema[c] for c in keep]
    # a text that is kept is sent once
    at, extra = (keep.index("text"), []) if "text" in keep else (len(keep), [F.col("text").alias("__text")])
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        m = held.value
        texts = batch.column(at)
        for lo, hi, buf, offs in blocks(texts, 1 << 18):  # a byte takes some sixty in passing
            bits = code_lengths(m, buf, offs)
            ok = has_letter(buf, offs) & bool(m.langs)
            if m.langs:
                best = bits.argmin(1)
                score = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
                pred = [m.langs[b] if k else "und" for b, k in zip(best, ok, strict=True)]
            else:
                score, pred = np.zeros(hi - lo), ["und"] * (hi - lo)
            columns = [batch.column(i).slice(lo, hi - lo) for i in range(len(kept))]
            rate = (bits.min(1) if m.langs else np.zeros(hi - lo)) / np.maximum(np.diff(offs), 1)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(pred, pa.string()), pa.array(np.where(ok, score, 0.0)), pa.array(rate)], [*keep, "lang_pred", "score", "bits_per_byte"])

    return docs.select(*keep, *extra).mapInArrow(per_batch(run), schema)
