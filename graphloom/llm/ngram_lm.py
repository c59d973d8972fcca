"""Scoring with an n-gram model in an Elias-Fano trie.

Counting. Every 1-, 2- and 3-gram of the training texts counts, from one occurrence on: no n-gram is left out, whatever
the corpus. Texts are dealt into blocks of about BLOCK bytes. A block sends its distinct n-grams, as 62-bit hashes in
order with their counts in its training texts, to the tasks that own their ranges of hashes; those add up and answer the
whole corpus's count of every n-gram a block asked for, in the order it asked. The ranges are served in PASSES passes, each
over all texts, to bound the disk that is in use at once. Nothing is broadcast or sent to the driver that grows with the
corpus, and as blocks count before they send, a frequent n-gram is no large key. A clash of hashes is not looked for.

Model. Each order is smoothed with the one below: (n + m P) / (c + m), with n the n-gram's count, c its context's, P the
probability of the shorter n-gram and m = MASS * sqrt(c), about the number of different words after such a context; at
the end stands the add-one unigram (c + 1) / (N + V + 1), which covers every word, also unseen ones. An n-gram that was
not met has the back-off weight m / (c + m) of its context. So the probabilities of a context sum to 1 and need no
statistics but counts. Probabilities and back-off weights are rounded down to 16-bit logarithms.

Trie. A block is scored with the part of the model that holds its own n-grams, which gives it what the whole would. Every
level holds the words of its entries, packed in as few bits as the vocabulary needs, and quantised values. A context's
entries are adjacent; where they start is a monotone sequence in Elias-Fano form. A query decodes the two pointers of its
context and looks for the successor of its word between them. The levels are one memory-mapped file. The bigrams of a
block's texts are numbered as the trie is made, so only trigrams are looked for.

Defined cases. Null text is empty: one end token. A null id is neither trained on nor held out. Rows with equal ids are
scored row by row; rows that agree in text and all plain kept columns meet in one block. Without training tokens every
token has the add-one probability of an empty model, 1.
"""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import Words, blocks, finish_step, mix, per_batch, release, staged

END = np.uint64(0xE4D0F7E87)  # the hash that stands for the end token
START = np.uint64(0x57A27B0F3)  # that of the start of a text, only a context
GRAM = np.uint64(0xD6E8FEB86659FD93)
BLOCK = 4 << 20  # bytes of text scored together
RANGE = 8 << 20  # bytes of text for each range of hashes
PASSES = 2
MASS = 1.0
DISCOUNT = 0.75
STEP = 12 / 65535  # of the quantised logarithms, which reach down to -12


# --- bits ------------------------------------------------------------------------------------------------------------


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Values of width bits, one after the other, and 8 spare bytes."""
    out, at = [], np.arange(width, dtype=np.uint64)
    for lo in range(0, len(values), 1 << 13):
        bits = (values[lo : lo + (1 << 13), None].astype(np.uint64) >> at) & np.uint64(1)
        out.append(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"))
    return np.concatenate([*out, np.zeros(8, np.uint8)])


def unpack(packed: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    if width == 0:
        return np.zeros(len(at), np.int64)
    words = np.ndarray(len(packed) - 7, "<u8", packed, 0, (1,))
    bit = at * width
    return ((words[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.int64)


@dataclass
class EliasFano:
    """A monotone sequence: low bits packed; high parts as a bit string with a one at (high part + index) of each value."""

    width: int
    low: np.ndarray
    high: np.ndarray  # 64-bit words
    ones: np.ndarray  # ones before each word

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n, top = max(1, len(values)), int(values[-1]) if len(values) else 0
        width = max(0, (top // n).bit_length() - 1) if top > n else 0
        at = (values >> width) + np.arange(len(values))
        bits = np.zeros((int(at[-1]) // 64 + 1 if len(at) else 1) * 64, np.uint8)
        bits[at] = 1
        high = np.packbits(bits, bitorder="little").view("<u8")
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high))[:-1]]).astype(np.int64)
        return cls(width, pack(values & ((1 << width) - 1), width) if width else np.zeros(8, np.uint8), high, ones)

    def at(self, i: np.ndarray) -> np.ndarray:
        """Values by index: the select of the i-th one, by halving within its word."""
        w = np.searchsorted(self.ones, i, "right") - 1
        rest, word, place = i - self.ones[w], self.high[w], np.zeros(len(i), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count(word & np.uint64((1 << half) - 1)).astype(np.int64)
            up = rest >= low
            rest = np.where(up, rest - low, rest)
            place += half * up
            word = np.where(up, word >> np.uint64(half), word)
        return ((w * 64 + place - i) << self.width) | unpack(self.low, self.width, i)


@dataclass
class Level:
    """Entries by context: where they start, their packed words, quantised probabilities and back-off weights."""

    starts: EliasFano
    width: int
    words: np.ndarray
    prob: np.ndarray
    backoff: np.ndarray

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The entry of each word within its context, or -1."""
        if not len(context):
            return np.zeros(0, np.int64)
        top = int(context.max()) + 2
        if top <= len(context):
            starts = self.starts.at(np.arange(top))
            lo, end = starts[context], starts[context + 1]
        else:
            own, back = np.unique(context, return_inverse=True)
            lo, end = self.starts.at(own)[back], self.starts.at(own + 1)[back]
        hi = end.copy()
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less = unpack(self.words, self.width, mid) < word[live]
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
            live = live[lo[live] < hi[live]]
        ok = lo < end
        ok[ok] = unpack(self.words, self.width, lo[ok]) == word[ok]
        return np.where(ok, lo, -1)


def quantised(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.ceil(-log10 / STEP), 0, 65535).astype(np.uint16)


def value(q: np.ndarray) -> np.ndarray:
    return -STEP * q.astype(np.float64)


@dataclass
class Model:
    """hash: sorted hashes of the words with ids; log1: their unigram logarithms; two, three: the levels above."""

    hash: np.ndarray
    log1: np.ndarray
    backoff1: np.ndarray
    two: Level
    three: Level
    tokens: int
    distinct: int

    @property
    def start(self) -> int:
        """The id of the start of a text, only a context."""
        return len(self.hash)

    def arrays(self) -> list[np.ndarray]:
        return [self.hash, self.log1, self.backoff1, *(a for v in (self.two, self.three) for a in (v.starts.low, v.starts.high, v.starts.ones, v.words, v.prob, v.backoff))]

    def to_bytes(self) -> tuple[bytes, list, list]:
        """The levels as one blob, the arrays' places in it, and the numbers beside them."""
        blob, places = bytearray(), []
        for a in self.arrays():
            blob += bytes(-len(blob) % 8)
            places.append((len(blob), a.dtype.str, len(a)))
            blob += a.tobytes()
        return bytes(blob) + bytes(8), places, [self.tokens, self.distinct, self.two.starts.width, self.two.width, self.three.starts.width, self.three.width]

    @classmethod
    def mapped(cls, blob: bytes, places: list, numbers: list) -> Model:
        """The model over a memory map of the blob in a file without a name."""
        with tempfile.TemporaryFile() as f:
            f.write(blob)
            f.flush()
            held = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        a = [np.frombuffer(held, d, n, at) for at, d, n in places]
        levels = [Level(EliasFano(numbers[2 + 2 * i], *a[3 + 6 * i : 6 + 6 * i]), numbers[3 + 2 * i], *a[6 + 6 * i : 9 + 6 * i]) for i in (0, 1)]
        return cls(*a[:3], *levels, *numbers[:2])


# --- counting --------------------------------------------------------------------------------------------------------


def _stream(texts: pa.Array, limit: int = 1 << 62) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Token hashes with the end token after each text, and the texts' bounds, of runs of texts."""
    for _, _, buf, offs in blocks(texts, limit):
        words = Words(buf, offs, lower=True)
        yield np.insert(words.hash, words.first[1:], END), words.first + np.arange(len(words.first))


def _before(ids: np.ndarray, bound: np.ndarray, start: int) -> np.ndarray:
    """The id before each token: the start id at the first of a text."""
    out = np.empty_like(ids)
    out[1:] = ids[:-1]
    out[bound[:-1]] = start
    return out


def _counted(keys: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    if keys:
        got, n = np.unique(np.concatenate(keys), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(got.view(np.int64)), pa.array(n)], ["k", "n"])


def train(docs: DataFrame, usable: Column, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The training texts, and the table (k, n) of all their unigrams (hash and count). Longer n-grams are counted by
    score(), together with what asks for them."""
    texts = docs.where(usable).select(F.col(text_col).alias("text"))

    def unigrams(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield from _counted([h for h, _ in _stream(batch.column(0), 1 << 20)])

    table = staged(texts.mapInArrow(per_batch(unigrams), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")), "unigrams")
    finish_step(docs.sparkSession)
    return texts, table


def _keys1(h: np.ndarray) -> np.ndarray:
    return mix(h ^ GRAM)


def _keys2(key1: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Of bigrams: the key of the word before, and the word."""
    return mix(key1 ^ h)


def _keys3(key2: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Of trigrams: the key of the bigram before, and the word."""
    return mix(key2 + h)


def _marked(keys: np.ndarray, single: bool) -> np.ndarray:
    """Room for a flag in the last bit; the one before says whether it is a unigram."""
    return keys & ~np.uint64(3) | np.uint64(2 * single)


def _planes(keys: np.ndarray) -> bytes:
    """Numbers in order, all first bytes before all second ones: the high ones repeat and compress away."""
    return keys.astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplaned(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(">u8").ravel().astype(np.uint64)


def _short(n: np.ndarray) -> bytes:
    """Counts, a byte each; those from 255 on follow at the end."""
    return np.minimum(n, 255).astype(np.uint8).tobytes() + n[n >= 255].astype("<i8").tobytes()


def _long(raw: bytes, size: int) -> np.ndarray:
    n = np.frombuffer(raw, np.uint8, size).astype(np.int64)
    n[n == 255] = np.frombuffer(raw, "<i8", -1, size)
    return n


def _asked(table: pa.Table, ranges: int, lo: int, hi: int) -> pa.Table:
    """A block's distinct n-grams by range of hashes, from range lo to before hi, with their counts in its training texts."""
    least, most = np.uint64((lo << 64) // ranges), np.uint64(((hi << 64) // ranges) - 1)
    got = [np.zeros(0, np.uint64)]
    for h, bound in _stream(table["text"]):
        learn = np.repeat(table["learn"].to_numpy().astype(np.uint64), np.diff(bound))
        first = np.zeros(len(h), bool)
        first[bound[:-1]] = True
        key1 = _keys1(h)
        before = np.roll(key1, 1)
        before[first] = _keys1(np.array([START]))[0]
        key2 = _keys2(before, h)
        key3 = _keys3(np.roll(key2, 1), h)
        for keys, single, ok in ((key1, True, True), (key2, False, True), (key3, False, ~first)):
            ok = (keys >= least) & (keys <= most) & ok
            got.append(_marked(keys[ok], single) | learn[ok])
    keys = np.concatenate(got)
    keys.sort()
    own = keys >> np.uint64(1)
    new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])[: len(own)])
    n = np.add.reduceat((keys & np.uint64(1)).astype(np.int64), new) if len(new) else np.zeros(0, np.int64)
    own = own[new]
    edges = np.searchsorted(own, np.array([(j << 64) // ranges >> 1 for j in range(lo + 1, hi)], np.uint64))
    cut = list(zip([0, *edges], [*edges, len(own)], strict=True))
    return pa.table({
        "b": pa.array(np.full(hi - lo, table["b"][0].as_py())), "p": pa.array(np.arange(lo, hi)),
        "keys": pa.array([_planes(own[i:j]) for i, j in cut], pa.binary()), "counts": pa.array([_short(n[i:j]) for i, j in cut], pa.binary()),
    })


def _answered(table: pa.Table) -> pa.Table:
    """The sums of the counts in a range, for every n-gram of every block that is to be scored; and for block -1, as p and
    size, the training tokens and different words of the range."""
    asker = table["b"].to_numpy()
    keys = [_unplaned(x.as_py()) for x in table["keys"]]
    size = np.array([len(k) for k in keys])
    n = np.concatenate([_long(x.as_py(), m) for x, m in zip(table["counts"], size, strict=True)])
    keys = np.concatenate(keys)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]
    tokens = distinct = 0
    if len(keys):
        total = np.add.reduceat(n[order], np.flatnonzero(new))
        n[order] = total[np.cumsum(new) - 1]
        words = total[keys[new] & np.uint64(1) == 1]
        tokens, distinct = int(words.sum()), np.count_nonzero(words)
    at = np.concatenate([[0], np.cumsum(size)])
    ok = np.flatnonzero(asker >= 0)
    got = pa.array([b"", *(_short(n[at[i] : at[i + 1]]) for i in ok)], pa.binary())
    return pa.table({
        "b": pa.array(np.append(-1, asker[ok])), "p": pa.array(np.append(tokens, table["p"].to_numpy()[ok])), "size": pa.array(np.append(distinct, size[ok])), "counts": got,
    })


def build(known: np.ndarray, count: np.ndarray, k2: np.ndarray, n2: np.ndarray, k3: np.ndarray, n3: np.ndarray, tokens: int, distinct: int, texts: int) -> Model:
    """Smoothed probabilities and the levels. k2: context << 32 | word; k3: index in k2 << 32 | word; all sorted."""
    p1 = (count + 1) / (tokens + distinct + 1)
    mask = (1 << 32) - 1
    c1, w2 = k2 >> 32, k2 & mask
    total1 = np.append(count, max(texts, 1)).astype(np.float64)
    p2 = (n2 - DISCOUNT) / np.maximum(total1[c1], n2)
    left1 = 1 - np.bincount(c1, p2, len(total1))
    back1 = left1 / np.maximum(1 - np.bincount(c1, p1[w2], len(total1)), 1e-9)
    c2, w3 = k3 >> 32, k3 & mask
    p3 = (n3 - DISCOUNT) / n2[c2]
    # the bigram probability of every trigram's last two words; both its bigrams were kept
    lower = p2[np.searchsorted(k2, w2[c2] << 32 | w3)] if len(k3) else p3
    left2 = 1 - np.bincount(c2, p3, len(k2))
    back2 = left2 / np.maximum(1 - np.bincount(c2, lower, len(k2)), 1e-9)
    return _trie(known, p1, back1, k2, p2, back2, k3, p3, tokens, distinct)


def part(known: np.ndarray, count: np.ndarray, k2: np.ndarray, n2: np.ndarray, k3: np.ndarray, n3: np.ndarray, tokens: int, distinct: int, texts: int) -> Model:
    """Like build(), for some n-grams of a model that has them all: counts are the whole corpus's and nothing is pruned."""
    mask = (1 << 32) - 1
    p1 = (count + 1) / (tokens + distinct + 1)
    total1 = np.append(count, texts).astype(np.float64)
    c1, w2, c2, w3 = k2 >> 32, k2 & mask, k3 >> 32, k3 & mask
    mass1, mass2 = MASS * np.sqrt(np.maximum(total1, 1)), MASS * np.sqrt(n2)
    p2 = (n2 + mass1[c1] * p1[w2]) / (total1 + mass1)[c1]
    p3 = (n3 + mass2[c2] * p2[np.searchsorted(k2, w2[c2] << 32 | w3)]) / (n2 + mass2)[c2] if len(k3) else np.zeros(0)
    return _trie(known, p1, mass1 / (total1 + mass1), k2, p2, mass2 / (n2 + mass2), k3, p3, tokens, distinct)


def _trie(known: np.ndarray, p1: np.ndarray, back1: np.ndarray, k2: np.ndarray, p2: np.ndarray, back2: np.ndarray, k3: np.ndarray, p3: np.ndarray, tokens: int, distinct: int) -> Model:
    mask = (1 << 32) - 1
    width = max(1, len(known).bit_length())

    def level(contexts: np.ndarray, n: int, words: np.ndarray, p: np.ndarray, back: np.ndarray) -> Level:
        starts = np.concatenate([[0], np.cumsum(np.bincount(contexts, minlength=n))]).astype(np.int64)
        return Level(EliasFano.of(starts), width, pack(words, width), quantised(np.log10(p)), quantised(np.log10(np.clip(back, 1e-12, 1))))

    two = level(k2 >> 32, len(known) + 1, k2 & mask, p2, back2)
    three = level(k3 >> 32, len(k2), k3 & mask, p3, np.zeros(0))
    return Model(known, np.log10(p1), quantised(np.log10(np.clip(back1, 1e-12, 1))), two, three, tokens, distinct)


# --- scoring ---------------------------------------------------------------------------------------------------------


def log_probabilities(m: Model, ids: np.ndarray, bound: np.ndarray, two: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """log10 of each token's model probability, without the unigram term of words that have no id; and which have one.
    two: the entry of the bigram that ends at each token, or -1, where that is known."""
    known = ids >= 0
    before = _before(ids, bound, m.start)
    out = np.zeros(len(ids))
    ctx2 = np.full(len(ids), -1)
    if two is None:
        two, ok = np.full(len(ids), -1), known & (before >= 0)
        two[ok] = m.two.find(before[ok], ids[ok])
    ctx2[1:] = two[:-1]
    ctx2[bound[:-1]] = -1
    three = np.full(len(ids), -1)
    ok = known & (ctx2 >= 0)
    three[ok] = m.three.find(ctx2[ok], ids[ok])
    a = three >= 0
    out[a] = value(m.three.prob[three[a]])
    down = ~a & (ctx2 >= 0)
    out[down] += value(m.two.backoff[ctx2[down]])
    b = ~a & (two >= 0)
    out[b] += value(m.two.prob[two[b]])
    c = ~a & (two < 0)
    e = c & (before >= 0)
    out[e] += value(m.backoff1[before[e]])
    d = c & known
    out[d] += m.log1[ids[d]]
    return out, known


def _scored(table: pa.Table, answers: pa.Table, tokens: int, distinct: int) -> list[np.ndarray]:
    """n_tokens, n_known, base_score and score of a block's texts."""
    h, bound = next(_stream(table["text"]))
    vocabulary, ids = np.unique(h, return_inverse=True)
    size, mask = len(vocabulary), (1 << 32) - 1
    k2, in2 = np.unique(_before(ids, bound, size) << 32 | ids, return_inverse=True)
    inner = np.ones(len(h), bool)
    inner[bound[:-1]] = False
    k3 = np.unique((np.roll(in2, 1) << 32 | ids)[inner])
    key1 = _keys1(np.append(vocabulary, START))
    key2 = _keys2(key1[k2 >> 32], vocabulary[k2 & mask])
    key3 = _keys3(key2[k3 >> 32], vocabulary[k3 & mask])
    asked = np.concatenate([_marked(key1[:-1], True), _marked(key2, False), _marked(key3, False)])
    order = np.argsort(asked)
    asked = asked[order]
    place = np.cumsum(np.concatenate([[False], asked[1:] != asked[:-1]]))
    raw, sizes = answers["counts"].to_pylist(), answers["size"].to_numpy()
    told = np.concatenate([_long(raw[i], sizes[i]) for i in np.argsort(answers["p"].to_numpy())])
    if len(told) != place[-1] + 1:
        raise ValueError(f"{len(told)} counts for {place[-1] + 1} n-grams of a block")
    n = np.empty(len(asked), np.int64)
    n[order] = told[place]
    n1, n2, n3 = np.split(n, [size, size + len(k2)])

    # what the training texts hold, numbered anew in the same order
    has1, has2 = n1 > 0, n2 > 0
    new1, new2 = np.append(np.cumsum(has1) - 1, has1.sum()), np.cumsum(has2) - 1
    k3 = (new2[k3 >> 32] << 32 | new1[k3 & mask])[n3 > 0]
    k2 = (new1[k2 >> 32] << 32 | new1[k2 & mask])[has2]
    texts = int(n1[np.searchsorted(vocabulary, END)])
    m = part(vocabulary[has1], n1[has1], k2, n2[has2], k3, n3[n3 > 0], tokens, distinct, texts)
    m = Model.mapped(*m.to_bytes())
    logs, known = log_probabilities(m, np.where(has1, new1[:-1], -1)[ids], bound, np.where(has2, new2, -1)[in2])
    log1 = np.log10((n1 + 1) / (tokens + distinct + 1))[ids]
    logs[~known] += log1[~known]
    return [np.diff(bound), *(np.add.reduceat(x, bound[:-1]) for x in (known.astype(np.int64), log1, logs))]


def score(docs: DataFrame, texts: DataFrame | None, unigrams: DataFrame | None, keep: list[str], text_col: str = "text", learns: Column | None = None) -> DataFrame:
    """The columns in keep, n_tokens, n_known, train_tokens, base_score and score.

    texts and unigrams come from train(). Where the training texts are themselves rows of docs, learns can say which rows
    they are instead: each text is then read for both ends at once, and the words are counted with all other n-grams."""
    spark = docs.sparkSession
    flag = F.lit(False) if learns is None else F.coalesce(learns, F.lit(False))
    own = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("text"), flag.alias("learn"))
    room = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)
    total = sum(int(df.agg(room).first()[0] or 0) for df in ([own] if learns is not None else [own, texts]))
    n_blocks, ranges = -(-total // BLOCK) or 1, -(-total // RANGE) or 1
    # copies of a text are dealt by the other columns; whenever the blocks are made, they hold the same rows
    plain = [f.name for f in own.schema if f.name != "learn" and "<" not in f.dataType.simpleString() and f.dataType.typeName() != "variant"]
    own = own.withColumn("b", F.pmod(F.xxhash64(*plain), F.lit(n_blocks)))
    tasks = -(-n_blocks // 4)

    def counts(lo: int, hi: int) -> DataFrame:
        def asked(table: pa.Table) -> pa.Table:
            out = _asked(table, ranges, lo, hi)
            release()
            return out

        def answered(table: pa.Table) -> pa.Table:
            out = _answered(table)
            release()
            return out

        rows = own.select("b", "learn", "text")
        if learns is None:
            rows = rows.union(texts.select((-1 - F.pmod(F.monotonically_increasing_id(), F.lit(n_blocks))).alias("b"), F.lit(True), "text"))
        sent = rows.repartition(tasks, "b").groupBy("b").applyInArrow(asked, "b long, p long, keys binary, counts binary")
        told = sent.repartition(-(-(hi - lo) // 2), "p").groupBy("p").applyInArrow(answered, "b long, p long, size long, counts binary")
        return staged(told, "counts")

    told, tokens, distinct, passes = None, 0, 0, min(PASSES, ranges)
    for j in range(passes):
        more = counts(j * ranges // passes, (j + 1) * ranges // passes)
        told = told.union(more) if told is not None else more
        # a query after the pass: the scheduler still holds the last job, and its shuffles, when the garbage is collected
        n, words = more.where("b < 0").agg(F.sum("p"), F.sum("size")).first()
        tokens, distinct = tokens + int(n or 0), distinct + int(words or 0)
        finish_step(spark)
    if learns is None:
        tokens, distinct = map(int, unigrams.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first())

    def finished(table: pa.Table, answers: pa.Table) -> pa.Table:
        n_tokens, n_known, base, logs = _scored(table, answers, tokens, distinct)
        out = pa.table([*(table[f"k{i}"] for i in range(len(keep))), n_tokens, n_known, np.full(len(n_tokens), tokens), base, logs], names)
        release()
        return out

    names = [*(f"k{i}" for i in range(len(keep))), "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds = [*(docs.schema[c].dataType for c in keep), T.LongType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType()]
    schema = T.StructType([T.StructField(c, k) for c, k in zip(names, kinds, strict=True)])
    both = own.drop("learn").repartition(tasks, "b").groupBy("b").cogroup(told.where("b >= 0").repartition(tasks, "b").groupBy("b"))
    return both.applyInArrow(finished, schema).toDF(*keep, *names[len(keep) :])
