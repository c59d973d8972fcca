"""Scalar functions on sequences, strings, numbers and arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def _c(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def complement(seq: ColumnLike) -> Column:
    return F.translate(_c(seq), "ACGTN", "TGCAN")


def reverse_complement(seq: ColumnLike) -> Column:
    return F.reverse(complement(seq))


def only_acgt(seq: ColumnLike) -> Column:
    return _c(seq).rlike("^[ACGT]+$")


def without_pair_suffix(name: ColumnLike) -> Column:
    """A read name without _1, /1, _2 or /2 at its end."""
    return F.regexp_replace(_c(name), "[_/][12]$", "")


def without_last(name: ColumnLike, n: int) -> Column:
    return F.when(F.length(_c(name)) > n, F.left(_c(name), F.length(_c(name)) - n)).otherwise("")


def next_power_of_two(x: ColumnLike) -> Column:
    """The least power of two not below x; 1 for x below 2. Exact, by bit length."""
    n = _c(x).cast("long")
    return F.when(n < 2, F.lit(1).cast("long")).otherwise(F.expr("1L") * F.pow(F.lit(2), F.length(F.bin(n - 1))).cast("long"))


def trimmed(s: ColumnLike, side: str = "both") -> Column:
    """Without white space at the left, right or both ends."""
    pattern = {"left": r"^\s+", "right": r"\s+$", "both": r"^\s+|\s+$"}[side]
    return F.regexp_replace(_c(s), pattern, "")


def starts_with(s: ColumnLike, prefix: str) -> Column:
    return _c(s).startswith(prefix)


def ends_with(s: ColumnLike, suffix: str) -> Column:
    return _c(s).endswith(suffix)


def last_position(array: ColumnLike, value: Column) -> Column:
    """0-based index of the last element equal to value, or -1."""
    a = _c(array)
    found = F.array_position(F.reverse(a), value)
    return F.when(found > 0, F.size(a) - found).otherwise(-1)


def equal_reversed(a: ColumnLike, b: ColumnLike) -> Column:
    return F.reverse(_c(a)) == F.reverse(_c(b))


def field(s: ColumnLike, i: int, delimiter: str = ";") -> Column:
    """The i-th (0-based) delimited field; null beyond the last."""
    return F.get(F.split(_c(s), f"[{delimiter}]"), F.lit(i))


def hashed_uniform(*key: ColumnLike, seed: int = 0) -> Column:
    """A reproducible number in [0, 1) from a key: the first 32 bits of an md5. The same in every engine that has md5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[_c(k).cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def hashed_index(n: Column, *key: ColumnLike, seed: int = 0) -> Column:
    """A reproducible index in [0, n)."""
    return F.floor(hashed_uniform(*key, seed=seed) * n).cast("int")
