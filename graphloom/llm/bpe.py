"""Byte-pair encoding by a distinct-word table, and decoding through an id-to-piece table.

Every tokenizer rule of the vocabulary used here works inside a run of non-blank characters, so a text's ids are its
words' ids in order (words are split at ASCII white space; other white space stays inside and the tokenizer splits it).
The vocabulary ignores case and never joins an ASCII letter with punctuation other than an apostrophe, so words are
also lower-cased and cut there, which makes them fewer; texts near a special token's `<|` are left as they are.
The words are split and hashed on the Arrow buffer in Spark. One table holds the distinct words that make up more than
1/max_words of all repeated words, so it has at most max_words rows whatever the corpus: each is encoded once, its pieces come
from the id-to-piece table, and it is broadcast and joined back to the words by position. The rarer words, which meet
few others of their kind anywhere, enter the same kind of table once in each task.

Null text is empty and has no ids. Rows and ids repeat freely: each row is encoded on its own.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import LOWER, Words, as_long, blocks, per_batch, release, staged


_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[[i for i in range(33, 127) if not chr(i).isalnum() and chr(i) != "'"]] = True


def tokenizer_words(buf: np.ndarray, offs: np.ndarray) -> Words:
    """The words of a block as the table holds them."""
    if b"<|" in buf.tobytes():
        return Words(buf, offs)
    low = LOWER[buf]
    letter, mark = _LETTER[low], _MARK[low]
    cut = np.zeros(len(buf), bool)
    cut[1:] = (letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])
    return Words(low, offs, cut=cut)


#: Bytes of text encoded at a time: larger blocks merge fewer tables, smaller ones take less memory.
BLOCK = (2 << 20) - 8192


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def ids_of_words(words: list[str], path: str, at_a_time: int = 1000) -> list[list[int]]:
    """Each word's ids; few words at a time, since the library's results are large."""
    out: list[list[int]] = []
    for i in range(0, len(words), at_a_time):
        out += [e.ids for e in tokenizer(path).encode_batch_fast(words[i : i + at_a_time], add_special_tokens=False)]
    return out


@lru_cache(maxsize=4)
def pieces(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The id-to-piece table: UTF-8 bytes of every piece followed by a space, and their bounds by id."""
    tok = tokenizer(path)
    raw = [((tok.id_to_token(i) or "") + " ").encode() for i in range(tok.get_vocab_size(with_added_tokens=True))]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])


def gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + size], one after the other."""
    total = np.cumsum(size)
    if not len(total):
        return flat[:0]
    return flat[np.repeat(start - (total - size), size) + np.arange(total[-1])]


@dataclass
class Table:
    """Distinct words: sorted hashes; word i has ids[bound[i] : bound[i + 1]] and text[at[i] : at[i + 1]]."""

    hash: np.ndarray
    ids: np.ndarray
    bound: np.ndarray
    text: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray, encoded: list[list[int]], path: str, pieces_too: bool = True) -> Table:
        order = np.argsort(hashes)
        encoded = [encoded[i] for i in order]
        bound = np.concatenate([[0], np.cumsum([len(x) for x in encoded], dtype=np.int64)])
        ids = np.fromiter((i for x in encoded for i in x), np.uint32, int(bound[-1]))
        if not pieces_too:
            return cls(hashes[order], ids, bound, np.zeros(0, np.uint8), np.zeros(len(bound), np.int64))
        flat, edge = pieces(path)
        size = np.diff(edge)[ids]
        text = gathered(flat, edge[ids], size)
        return cls(hashes[order], ids, bound, text, np.concatenate([[0], np.cumsum(size)])[bound])

    def find(self, h: np.ndarray) -> np.ndarray:
        """Row of each hash, or -1."""
        if not len(self.hash):
            return np.full(len(h), -1)
        row = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where(self.hash[row] == h, row, -1)

    def and_(self, other: Table) -> Table:
        """Both tables; their words are distinct."""
        h = np.concatenate([self.hash, other.hash])
        order = np.argsort(h)
        size, chars = (np.concatenate([np.diff(a), np.diff(b)])[order] for a, b in ((self.bound, other.bound), (self.at, other.at)))
        ids = gathered(np.concatenate([self.ids, other.ids]), np.concatenate([self.bound[:-1], other.bound[:-1] + len(self.ids)])[order], size)
        text = gathered(np.concatenate([self.text, other.text]), np.concatenate([self.at[:-1], other.at[:-1] + len(self.text)])[order], chars)
        return Table(h[order], ids, np.concatenate([[0], np.cumsum(size)]), text, np.concatenate([[0], np.cumsum(chars)]))


def empty_table() -> Table:
    return Table(np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, np.uint8), np.zeros(1, np.int64))


class Encoder:
    """Encodes blocks of texts. It starts from a shared table and adds each rarer word once, up to most_rare of them.
    Without pieces_too it cannot give decoded text, and is smaller."""

    def __init__(self, path: str, shared: Table | None = None, most_rare: int = 1_000_000, pieces_too: bool = True) -> None:
        self.path, self.shared, self.most_rare, self.pieces_too = path, shared or empty_table(), most_rare, pieces_too
        self.rare = empty_table()

    def rows(self, words: Words) -> tuple[Table, np.ndarray]:
        """A table with all the block's words, and the row of each word."""
        distinct, first, back = np.unique(words.hash, return_index=True, return_inverse=True)
        missing = self.shared.find(distinct) < 0
        new = missing & (self.rare.find(distinct) < 0)
        if len(self.rare.hash) + int(new.sum()) > self.most_rare:  # bounded memory; what is dropped is encoded again
            self.rare, new = empty_table(), missing
        if new.any():
            raw = words.buf.tobytes()
            text = [raw[words.start[i] : words.end[i]].decode("utf-8", "replace") for i in first[new]]
            encoded = ids_of_words(text, self.path)
            self.rare = self.rare.and_(Table.of(distinct[new], encoded, self.path, self.pieces_too))
        return self._joined(distinct, back)

    def _joined(self, distinct: np.ndarray, back: np.ndarray) -> tuple[Table, np.ndarray]:
        own = distinct[self.shared.find(distinct) >= 0]
        s, r = self.shared.find(own), self.rare
        size, chars = np.diff(self.shared.bound)[s], np.diff(self.shared.at)[s]
        part = Table(own, gathered(self.shared.ids, self.shared.bound[s], size), np.concatenate([[0], np.cumsum(size)]), gathered(self.shared.text, self.shared.at[s], chars), np.concatenate([[0], np.cumsum(chars)]))
        table = part.and_(r) if len(own) else r
        return table, table.find(distinct)[back]

    def encode(self, words: Words, text: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]:
        """ids and their bounds by text; if asked for, the decoded bytes (a space after each piece) and their bounds."""
        table, row = self.rows(words)
        size = np.diff(table.bound)[row]
        ids = gathered(table.ids, table.bound[:-1][row], size)
        bound = np.concatenate([[0], np.cumsum(size)])[words.first]
        if not text:
            return ids, bound, None, None
        chars = np.diff(table.at)[row]
        return ids, bound, gathered(table.text, table.at[:-1][row], chars), np.concatenate([[0], np.cumsum(chars)])[words.first]


def _distinct(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for _, _, buf, offs in blocks(batch.column(0)):
        words = tokenizer_words(buf, offs)
        if len(words.hash):
            h, first, n = np.unique(words.hash, return_index=True, return_counts=True)
            raw = words.buf.tobytes()
            yield pa.RecordBatch.from_arrays([as_long(h), pa.array([raw[words.start[i] : words.end[i]].decode() for i in first]), pa.array(n)], ["h", "word", "n"])


def word_table(docs: DataFrame, path: str, text_col: str = "text", max_words: int = 500_000) -> Table:
    """The shared table: each distinct word with more than 1/max_words of all repeated words' occurrences, encoded once."""
    counts = docs.select(text_col).mapInArrow(per_batch(_distinct), "h long, word string, n long")
    words = counts.groupBy("h").agg(F.min("word").alias("word"), F.sum("n").alias("n"))
    words = staged(words.where("n > 1"), "words")  # a word met once gains nothing from a shared table
    total = words.agg(F.sum("n")).first()[0] or 0  # at most all occurrences
    shared = words.where(F.col("n") * max_words > total)

    def encode(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = ids_of_words(batch.column(1).to_pylist(), path)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["h", "ids"])

    got = shared.select("h", "word").mapInArrow(per_batch(encode), "h long, ids array<int>").toArrow()
    return Table.of(got["h"].to_numpy().view(np.uint64), got["ids"].to_pylist(), path)


def encode_digests(docs: DataFrame, path: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns in keep, n_tokens, ids_sha256 and decoded_sha256."""
    held = docs.sparkSession.sparkContext.broadcast(word_table(docs, path, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, held.value)
        for batch in batches:
            for lo, hi, buf, offs in blocks(batch.column(len(keep)), BLOCK):
                ids, bound, text, at = encoder.encode(tokenizer_words(buf, offs), text=True)
                a, b = ([hashlib.sha256(x[e[d] : max(e[d], e[d + 1] - cut)]).hexdigest() for d in range(hi - lo)] for x, e, cut in ((ids, bound, 0), (text, at, 1)))
                columns = [batch.column(i).slice(lo, hi - lo) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(bound)), pa.array(a, pa.string()), pa.array(b, pa.string())], [*keep, "n_tokens", "ids_sha256", "decoded_sha256"])
            release()

    fields = [*(docs.schema[c] for c in keep), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, T.StructType(fields))


def encode(docs: DataFrame, path: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns in keep and ids."""
    held = docs.sparkSession.sparkContext.broadcast(word_table(docs, path, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, held.value)
        for batch in batches:
            for lo, hi, buf, offs in blocks(batch.column(len(keep)), BLOCK):
                ids, bound, _, _ = encoder.encode(tokenizer_words(buf, offs))
                out = pa.ListArray.from_arrays(pa.array(bound.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(len(keep))), out], [*keep, "ids"])

    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, T.StructType([*(docs.schema[c] for c in keep), T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """encoded with a column decoded: every id joined with its piece, the pieces joined by spaces. Null ids give null."""
    flat, edge = pieces(path)
    spark = encoded.sparkSession
    table = spark.sparkContext.broadcast([bytes(flat[edge[i] : edge[i + 1] - 1]).decode() for i in range(len(edge) - 1)])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known = table.value
        out = [None if x is None else " ".join(known[i] for i in x) for x in batch.column(batch.schema.get_field_index(ids_col)).to_pylist()]
        names = [c for c in batch.schema.names if c != "decoded"]
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(out, pa.string())], [*names, "decoded"])

    return encoded.mapInArrow(per_batch(run), T.StructType([*(f for f in encoded.schema if f.name != "decoded"), T.StructField("decoded", T.StringType())]))
