"""What the operators share: staged tables, the byte-level word kernel and connected components.

The kernel works on the UTF-8 buffer of a whole Arrow column, so words are split and hashed by a handful of numpy
passes and no Python object is made per word.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.shipping import ship
from graphloom.staging import staged

_LIBC = ctypes.CDLL(None)


def prepare(spark: SparkSession) -> None:
    """Send the package to the workers, and let an Arrow batch hold few enough rows for long texts.

    What steps before this one have left in the driver and in the executors is given back first."""
    finish_step(spark)
    collect_executors(spark)
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo the modulus (null for a null id)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


# --- the word kernel -------------------------------------------------------------------------------------------------

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
GRAM_A, GRAM_B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
#: Words of more bytes are hashed one by one with BLAKE2.
LONG_WORD = 1024


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes: eight bytes at a time, a bijective mix after each.

    Different spans of one length up to eight bytes never clash; any others do with a chance of 2**-64 a pair, whatever
    their structure (a polynomial modulo 2**64 has no such bound: Thue-Morse words clash under every base).
    """
    size = end - start
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    eight = np.ndarray(len(buf) + 1, "<u8", padded, 0, (1,))
    h = mix(size.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + np.uint64(1))
    live, at = np.arange(len(start)), 0
    while len(live):
        left = np.minimum(size[live] - at, 8).astype(np.uint64)
        chunk = eight[start[live] + at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left))
        h[live] = mix(h[live] ^ chunk)
        at += 8
        live = live[(size[live] > at) & (size[live] <= LONG_WORD)]
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = int.from_bytes(hashlib.blake2b(buf[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def blocks(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of whole texts of about limit bytes: (first row, end row, bytes, offsets). Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, at, data = texts.buffers()
    offs = np.frombuffer(at, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


class Words:
    """The words of a block: byte spans start..end, first[d]..first[d+1] the words of text d, hash a 64-bit word hash."""

    __slots__ = ("buf", "offs", "white", "start", "end", "first", "hash")

    def __init__(self, buf: np.ndarray, offs: np.ndarray, lower: bool = False, hashed: bool = True, cut: np.ndarray | None = None) -> None:
        """cut: bytes at which a new word begins even without white space before."""
        self.buf, self.offs = LOWER[buf] if lower else buf, offs
        self.white = white = WHITE[buf]
        begins, ends = ~white, ~white
        begins[1:] &= white[:-1]
        ends[:-1] &= white[1:]
        full = offs[:-1] < offs[1:]
        heads, tails = offs[:-1][full], offs[1:][full] - 1
        begins[heads], ends[tails] = ~white[heads], ~white[tails]
        if cut is not None:
            begins |= cut
            ends[:-1] |= cut[1:] & ~white[:-1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offs)
        if hashed:
            self.hash = word_hashes(self.buf, self.start, self.end)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The text of each word, as its index in the block."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def joined(self, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of each text's kept words joined by one space."""
        if keep is None:
            keep = np.ones(len(self.start), bool)
        mask = np.zeros(len(self.buf), bool)
        mask[~self.white] = np.repeat(keep, self.end - self.start)
        kept = np.flatnonzero(keep)
        doc = np.searchsorted(self.first, kept, "right") - 1
        gap = self.end[kept[:-1][doc[:-1] == doc[1:]]] if len(kept) else kept
        out = self.buf.copy()
        out[gap], mask[gap] = 32, True
        size = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=size[1:])
        return out[mask], size[self.offs]


def grams(h: np.ndarray, k: int, factor: np.uint64) -> np.ndarray:
    """A hash of each run of k word hashes (also of those that cross from text to text: see inside)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = mix(h[:n] ^ factor)
    for j in range(1, k):
        total += h[j : j + n]
        total *= factor
        total ^= total >> np.uint64(32)
    return mix(total)


def inside(first: np.ndarray, k: int) -> np.ndarray:
    """Which runs of k words lie within one text."""
    ok = np.ones(max(0, int(first[-1]) - k + 1), bool)
    for j in range(1, k):
        at = first[1:] - j
        ok[at[(at >= 0) & (at < len(ok))]] = False
    return ok


def as_long(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def lists(flat: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat, kind))


def per_batch(fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]) -> Callable:
    """A mapInArrow function from one that treats a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from fn(batch)
            release()

    return run


def release() -> None:
    """Give freed memory back to the system: workers are reused, and an executor holds several."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(_LIBC, "malloc_trim", None):
        trim(0)


# --- fixed-size filters ----------------------------------------------------------------------------------------------

FILTER_BITS = 1 << 23


class IdFilter:
    """A Bloom filter of fixed size (1 MB) over ids: it keeps texts out of shuffles that will not need them.

    It lets every id of its set pass and, while the set has fewer than a million or so, few others; with more it lets
    more pass, which costs time and never rows.
    """

    def __init__(self, ids: DataFrame, column: str) -> None:
        h, bit = IdFilter.keys(F.col(column))
        bits = ids.select(F.shiftright(h, 6).alias("w"), F.expr("1L").alias("one"), bit.alias("b"))
        got = bits.groupBy("w").agg(F.bit_or(F.expr("shiftleft(one, cast(b as int))")).alias("bits")).toArrow()
        self.bits = np.zeros(FILTER_BITS // 64, np.int64)
        self.bits[got["w"].to_numpy()] = got["bits"].to_numpy()

    @staticmethod
    def keys(column: Column) -> tuple[Column, Column]:
        """The columns that passing() reads; null for a null id."""
        h = F.when(column.isNotNull(), F.pmod(F.xxhash64(column), F.lit(FILTER_BITS)))
        return h, F.when(column.isNotNull(), F.pmod(F.xxhash64(column, F.lit(1)), F.lit(64)))

    def passing(self, h: pa.Array, b: pa.Array) -> np.ndarray:
        known = h.is_valid().to_numpy(zero_copy_only=False)
        h, b = (x.fill_null(0).to_numpy() for x in (h, b))
        return known & ((self.bits[h >> 6] >> b) & 1 == 1)


def finish_step(spark: SparkSession) -> None:
    """Have the JVM collect its garbage, so that Spark deletes the shuffle files and broadcasts of steps whose results are
    written, and give the driver's freed memory back."""
    gc.collect()
    release()
    spark.sparkContext._jvm.System.gc()


def collect_executors(spark: SparkSession) -> None:
    """Have the executors' JVMs collect their garbage, which also shrinks their heaps: a step then starts with the memory
    that it would have if it ran alone. An executor that gets no task keeps what it holds, which costs memory only."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()


# --- connected components --------------------------------------------------------------------------------------------


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge.

    Rounds of neighbour minimum and pointer jumping, each written to the shared folder; the number of rounds grows
    with the logarithm of a component's diameter. Minima are pre-aggregated before they are shuffled, so a node with
    very many edges is not gathered in one task.
    """
    both = staged(
        edges.select(F.col(a).alias("s"), F.col(b).alias("t"))
        .union(edges.select(F.col(b).alias("s"), F.col(a).alias("t")))
        .where("s is not null and t is not null and s <> t")
        .distinct(),
        "edges",
    )
    label = staged(both.groupBy(F.col("s").alias("node")).agg(F.least("node", F.min("t")).alias("component")), "labels")
    while True:
        near = both.join(label, both.t == label.node).groupBy(F.col("s").alias("node")).agg(F.min("component").alias("m"))
        lower = label.join(near, "node", "left").select("node", F.col("component").alias("old"), F.least("component", "m").alias("c"))
        jump = label.select(F.col("node").alias("c"), F.col("component").alias("far"))
        after = staged(lower.join(jump, "c", "left").select("node", "old", F.least("c", "far").alias("component")), "labels")
        changed = not after.where("old <> component").limit(1).isEmpty()
        label = after.select("node", "component")
        if not changed:
            return label


def near_components(edges: DataFrame, a: str, b: str, rounds: int = 3) -> DataFrame:
    """(node, component) like components, but after a few rounds of neighbour minima only: nodes of one label are connected,
    nodes of one component need not have one label. Cheap, where knowing most connections is enough."""
    both = staged(
        edges.select(F.col(a).alias("s"), F.col(b).alias("t")).union(edges.select(F.col(b).alias("s"), F.col(a).alias("t"))).where("s <> t").distinct(), "edges"
    )
    label = staged(both.groupBy(F.col("s").alias("node")).agg(F.least("node", F.min("t")).alias("component")), "labels")
    for _ in range(rounds - 1):
        near = both.join(label, both.t == label.node).groupBy("s").agg(F.min("component").alias("m"))
        label = staged(label.join(near, F.col("node") == F.col("s")).select("node", F.least("component", "m").alias("component")), "labels")
    return label
