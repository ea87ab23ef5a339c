"""Kernels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Words between single blanks: blanks in a row, and at the start, give empty words; one empty word at the end is
    dropped, so nothing comes of an empty line. Null gives null, and so no records."""
    t = F.split(text, " ", -1)
    return F.when(F.element_at(t, -1) == "", F.slice(t, 1, F.size(t) - 1)).otherwise(t)


def duplicated(value: Column) -> Column:
    return F.array(value, value)


def kv_text(key: Column, val: Column) -> Column:
    """<key, val>"""
    return F.concat(F.lit("<"), key.cast("string"), F.lit(", "), val.cast("string"), F.lit(">"))


def kv_key(text: Column) -> Column:
    """The key of <key, val>; of other text, null."""
    return F.nullif(F.regexp_extract(text, r"^<(.*), (.*)>$", 1), F.lit(""))


def kv_val(text: Column, kind: str = "long") -> Column:
    """The value of <key, val>; of other text, or where it is of another type, null."""
    return F.regexp_extract(text, r"^<(.*), (.*)>$", 2).try_cast(kind)


def repeated_if_even(s: Column) -> Column:
    """An even number as often as its last digit says."""
    return F.when(s % 2 == 0, F.array_repeat(s, F.abs(s % 10).cast("int"))).otherwise(F.array().cast("array<bigint>"))


def grown(v: Column) -> Column:
    """With m, v's last digit, unless that is 0: m + 1 times v + 1 and 0."""
    m = F.abs(v % 10)
    pairs = F.flatten(F.array_repeat(F.array(v + 1, F.lit(0).cast("bigint")), (m + 1).cast("int")))
    return F.when(m != 0, pairs).otherwise(F.array().cast("array<bigint>"))


def shares(rank: Column, targets: Column, dtype: str = "struct<key:bigint,val:double>") -> Column:
    """A rank in equal shares for each target."""
    return F.transform(targets, lambda t: F.struct(t.alias("key"), (rank / F.size(targets)).alias("val")))


def damped(rank: Column, n: int, damping: float = 0.85) -> Column:
    return rank * F.lit(damping) + F.lit((1 - damping) / n)


def variance(*prices: Column) -> Column:
    """Of the population."""
    mean = sum(prices[1:], prices[0]) / len(prices)
    squares = [(p - mean) * (p - mean) for p in prices]
    return sum(squares[1:], squares[0]) / len(prices)


def only_name(words: Column, names: list[str]) -> Column:
    """The one of `names` that occurs among the words; null if none or several do."""
    found = F.array_intersect(words, F.array(*map(F.lit, names)))
    return F.when(F.size(found) == 1, F.element_at(found, 1))


def length_with_blanks(words: Column) -> Column:
    """Characters of the words, each with the blank that follows it."""
    return F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + F.char_length(w) + 1)
