"""Packing token sequences by bin completion.

The plan needs only how many pieces have each length: at most `capacity` numbers, whatever the corpus. For the largest
length left, the undominated fillings of the rest of its sequence are enumerated (one, two or three further pieces that
leave no gap, larger ones first, then the best fit), the first is used as often as the counts allow, and the others
remain as branches. A branch is cut when the gaps so far exceed what a better plan than the incumbent may waste; the
first incumbent is the best-fit-decreasing plan. The search ends when the incumbent meets the lower bound (all tokens
over the capacity), or after a number of nodes that grows with the number of distinct lengths; what then remains open is
told: every row has the sequences used and the lower bound.

Pieces then find their places without meeting in one task: pieces of a length are numbered by partition and by order
within it, and the numbers select a run of the plan (pattern, slot), of which there are few.

Defined cases. Null text is one end token. Texts longer than the capacity are cut, however long; rows and ids may
repeat, each row is packed. An empty table gives an empty result. Only the id and the text are read, so other columns can
have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.bpe import BLOCK, Encoder, tokenizer_words
from graphloom.llm.common import blocks, release, staged

Pattern = tuple[tuple[int, ...], int]


# --- the plan --------------------------------------------------------------------------------------------------------


def _times(counts: np.ndarray, items: tuple[int, ...]) -> int:
    """How often the items can be taken together."""
    need: dict[int, int] = {}
    for x in items:
        need[x] = need.get(x, 0) + 1
    return min(int(counts[x]) // k for x, k in need.items())


def _best_fit(counts: np.ndarray, top: int, capacity: int) -> tuple[int, ...]:
    """The top length with, again and again, the largest piece that fits."""
    items, room, left = [top], capacity - top, counts.copy()
    left[top] -= 1
    while room:
        fit = np.flatnonzero(left[: room + 1])
        if not len(fit):
            break
        items.append(int(fit[-1]))
        left[fit[-1]] -= 1
        room -= int(fit[-1])
    return tuple(items)


def fillings(counts: np.ndarray, top: int, capacity: int, most: int = 8) -> list[tuple[int, ...]]:
    """Undominated ways to fill a sequence that holds the top length: fuller first, then larger pieces first."""
    room = capacity - top
    left = counts.copy()
    left[top] -= 1
    if not room:
        return [(top,)]
    found: list[tuple[int, ...]] = []
    if left[room]:
        return [(top, room)]  # dominates all others
    fit = np.flatnonzero(left[: room + 1])[::-1]

    def pairs(room: int, below: np.ndarray, n: int) -> list[tuple[int, int]]:
        a = below[(2 * below >= room) & (below < room)]
        a = a[left[room - a] > (2 * a == room)][:n]
        return [(int(x), room - int(x)) for x in a]

    found += [(top, *p) for p in pairs(room, fit, most)]
    if len(found) < most:
        for x in fit[:64]:
            left[x] -= 1
            found += [(top, int(x), *p) for p in pairs(room - int(x), fit[fit <= x], 2)]
            left[x] += 1
            if len(found) >= most:
                break
    found.append(_best_fit(counts, top, capacity))
    return list(dict.fromkeys(found))


def best_fit_plan(hist: np.ndarray, capacity: int) -> list[Pattern]:
    counts, plan = hist.copy(), []
    for top in range(capacity, 0, -1):
        while counts[top]:
            items = _best_fit(counts, top, capacity)
            m = _times(counts, items)
            np.subtract.at(counts, list(items), m)
            plan.append((items, m))
    return plan


def plan_bins(hist: np.ndarray, capacity: int, nodes_per_length: int = 1) -> list[Pattern]:
    """Patterns (lengths in a sequence) and how often each is used. hist[n]: how many pieces have length n.

    The search visits at most nodes_per_length nodes for each distinct length, and as many again for each of the
    first hundred lengths: enough to try every filling of each length, and whole searches of small cases."""
    total = int((hist * np.arange(capacity + 1)).sum())
    best = best_fit_plan(hist, capacity)
    size = sum(m for _, m in best)
    bound = least_sequences(hist, capacity)
    distinct = int(np.count_nonzero(hist))
    nodes = nodes_per_length * (distinct + 10 * min(distinct, 100)) + 1000
    # a node: the counts before its filling, which its siblings share, the filling, the waste, and the fillings before
    stack: list[tuple[np.ndarray, tuple[int, ...], int, int, tuple | None]] = [(hist, (), 0, 0, None)]
    while stack and size > bound and nodes:
        before, items, m, waste, done = stack.pop()
        nodes -= 1
        counts = before.copy()
        np.subtract.at(counts, list(items), m)
        left = np.flatnonzero(counts)
        if not len(left):
            plan = []
            while done:
                plan.append(done[0])
                done = done[1]
            if (n := sum(m for _, m in plan)) < size:
                best, size = plan, n
            continue
        for items in reversed(fillings(counts, int(left[-1]), capacity)):
            m = _times(counts, items)
            more = waste + m * (capacity - sum(items))
            if m and more <= (size - 1) * capacity - total or len(left) == 1:
                stack.append((counts, items, m, more, ((items, m), done)))
    return best


def least_sequences(hist: np.ndarray, capacity: int) -> int:
    """A lower bound: all tokens over the capacity, or the pieces longer than half of it."""
    total = int((hist * np.arange(len(hist))).sum())
    return max(-(-total // capacity), int(hist[capacity // 2 + 1 :].sum()))


def runs_of(plan: list[Pattern], capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (length << 40 | first number), with the first sequence and the offset of each run of pieces."""
    start = np.zeros(capacity + 1, np.int64)
    rows, base = [], 0
    for items, m in plan:
        at = 0
        for n in items:
            rows.append((n << 40 | int(start[n]), base, at))
            start[n] += m
            at += n
        base += m
    table = np.array(sorted(rows), np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 1], table[:, 2]


# --- the tables ------------------------------------------------------------------------------------------------------


def cut_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end: int = 1) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, part and nth (its number among the part's pieces of the length)."""
    fields = [T.StructField("id", docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "part", "nth"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pieces_too=False)
        part, met = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for lo, hi, buf, offs in blocks(batch.column(1), BLOCK):
                ids, bound, _, _ = encoder.encode(tokenizer_words(buf, offs))
                ids = np.insert(ids, bound[1:], np.uint32(end))
                bound = bound + np.arange(hi - lo + 1)
                n = np.diff(bound)
                per = -(-n // capacity)
                doc = np.repeat(np.arange(hi - lo), per)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
                start = piece * capacity
                length = np.minimum(capacity, n[doc] - start)
                raw = memoryview(ids.astype("<u4")).cast("B")
                at = (bound[doc] + start) * 4
                crc = [zlib.crc32(raw[a : a + 4 * k]) for a, k in zip(at.tolist(), length.tolist(), strict=True)]
                # the number of each piece among those of its length so far
                order = np.argsort(length, kind="stable")
                own = length[order]
                first = np.searchsorted(own, own)
                nth = np.empty(len(own), np.int64)
                nth[order] = np.arange(len(own)) - first + met[own]
                met += np.bincount(own, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).take(pa.array(doc)), pa.array(piece.astype(np.int32)), *(pa.array(np.asarray(x, np.int64)) for x in (start, length, crc, np.full(len(doc), part), nth))],
                    [f.name for f in fields],
                )
            release()

    return docs.select(id_col, text_col).mapInArrow(run, T.StructType(fields))


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end: int = 1) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset, n_sequences (used in all) and
    least_sequences (a lower bound of that)."""
    pieces = staged(cut_pieces(docs, path, id_col, text_col, capacity, end), "pieces")  # also fixes the numbering
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    counts = staged(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "piece-counts")
    hist = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        hist[r["length"]] = r["n"]
    plan = plan_bins(hist, capacity)
    used, least = sum(m for _, m in plan), least_sequences(hist, capacity)
    runs = docs.sparkSession.sparkContext.broadcast(runs_of(plan, capacity))
    release()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, base, at = runs.value
        for batch in batches:
            length, nth = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            run = np.searchsorted(key, length << 40 | nth, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(base[run] + nth - (key[run] & ((1 << 40) - 1))), pa.array(at[run])], [*batch.schema.names[:5], "sequence_id", "offset"])

    numbered = pieces.join(counts.select("part", "length", "before"), ["part", "length"])
    numbered = numbered.select("id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("before")).alias("nth"))
    schema = T.StructType([*numbered.schema.fields[:5], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return numbered.mapInArrow(place, schema).withColumns({"n_sequences": F.lit(used).cast("long"), "least_sequences": F.lit(least).cast("long")})
