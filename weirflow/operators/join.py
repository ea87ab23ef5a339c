"""The join of two pipes by key."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.pipe import BAG, BinaryOperator
from .elements import FlatMap, PyFlatMap


@dataclass(frozen=True)
class JoinFlatMapByKey(BinaryOperator):
    """For each pair of records with equal keys, left and right, any number of records. The kernel maps (key, left value,
    right value) to an array, as FlatMap's does. Keys that one side lacks, and null keys, give nothing."""

    kernel: Callable[[Column, Column, Column], Column]
    structures = frozenset((BAG,))

    def combine(self, left: DataFrame, right: DataFrame) -> DataFrame:
        kernel = self.kernel
        return FlatMap(lambda r: kernel(r.key, r.l_val, r.r_val)).apply(joined(left, right))


@dataclass(frozen=True)
class PyJoinFlatMapByKey(BinaryOperator):
    """The same with a Python kernel from (key, left value, right value) to records of `schema`."""

    kernel: Callable[[object, object, object], Iterable[Mapping]]
    schema: str | T.StructType
    structures = frozenset((BAG,))

    def combine(self, left: DataFrame, right: DataFrame) -> DataFrame:
        kernel = self.kernel

        def each(r: dict) -> Iterator[Mapping]:
            yield from kernel(r["key"], r["l_val"], r["r_val"])

        return PyFlatMap(each, self.schema).apply(joined(left, right))


def joined(left: DataFrame, right: DataFrame) -> DataFrame:
    l = left.select("key", F.col("val").alias("l_val"))  # noqa: E741
    r = right.select(F.col("key").alias("r_key"), F.col("val").alias("r_val"))
    return l.join(r, F.col("key") == F.col("r_key")).drop("r_key")
