"""Element-wise operators. A kernel maps a Row of columns to columns, which the optimiser sees; Python is the fallback."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.pipe import Operator

Columns = Column | Sequence[Column] | Mapping[str, Column]


class Row:
    """The record that a kernel is given: row.name or row["name"] is a column."""

    def __getattr__(self, name: str) -> Column:
        return F.col(f"`{name}`")

    __getitem__ = __getattr__


def kv(key: Column, val: Column) -> list[Column]:
    """A key-value record."""
    return [key.alias("key"), val.alias("val")]


def pair(key: Column, val: Column) -> Column:
    """A key-value record as one value, as FlatMap's arrays hold."""
    return F.struct(*kv(key, val))


def listed(columns: Columns) -> list[Column]:
    if isinstance(columns, Column):
        return [columns.alias("value")]
    if isinstance(columns, Mapping):
        return [c.alias(k) for k, c in columns.items()]
    return list(columns)


@dataclass(frozen=True)
class Map(Operator):
    """One record for each. The kernel gives a column, which is named value, or several, in a list or by name."""

    kernel: Callable[[Row], Columns]

    def apply(self, df: DataFrame) -> DataFrame:
        return df.select(*listed(self.kernel(Row())))


@dataclass(frozen=True)
class FlatMap(Operator):
    """Any number of records for each: the kernel gives an array. Of structs, the fields become columns; of other values,
    the column is named value. `keep` names columns that go along, such as a stream's order or a Counted's number."""

    kernel: Callable[[Row], Column]
    keep: tuple[str, ...] = ()

    def apply(self, df: DataFrame) -> DataFrame:
        kept = [F.col(c) for c in self.keep]
        array = self.kernel(Row())
        kind = df.select(array.alias("a")).schema["a"].dataType
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            return df.select(*kept, F.inline(array))
        return df.select(*kept, F.explode(array).alias("value"))


@dataclass(frozen=True)
class Filter(Operator):
    """The records for which the kernel's column is true."""

    kernel: Callable[[Row], Column]

    def apply(self, df: DataFrame) -> DataFrame:
        return df.where(self.kernel(Row()))


@dataclass(frozen=True)
class PyFlatMap(Operator):
    """Python kernel: from a record, a dict, to any number of records of `schema`. Batches pass through Arrow."""

    kernel: Callable[[dict], Iterable[Mapping]]
    schema: str | T.StructType

    def apply(self, df: DataFrame) -> DataFrame:
        out = T._parse_datatype_string(self.schema) if isinstance(self.schema, str) else self.schema
        from pyspark.sql.pandas.types import to_arrow_schema

        kernel, arrow = self.kernel, to_arrow_schema(out)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_pylist([dict(y) for x in batch.to_pylist() for y in kernel(x)], schema=arrow)

        return df.mapInArrow(run, out)


def PyMap(kernel: Callable[[dict], Mapping], schema: str | T.StructType) -> PyFlatMap:  # noqa: N802
    """Python kernel: from a record to a record."""
    return PyFlatMap(lambda x: (kernel(x),), schema)
