"""Reductions: by key, by key over count windows, and of everything.

A kernel is the name of an aggregate, a function of two columns, or a function of two Python values. Kernels must be
associative and, but in windows, commutative; there is no identity, so nothing comes of nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.durable import cut
from ..plans.pipe import BAG, BOTH, Operator, PipeError, PipeTypeError

#: Of one value a record; they combine before the shuffle.
NAMED: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "max": F.max,
    "min": F.min,
    "count": F.count,
    "xor": F.bit_xor,
    "and": F.bit_and,
    "or": F.bit_or,
    # Of arrays: their values, of all rows, in one array.
    "concat": lambda v: F.flatten(F.collect_list(v)),
}
Kernel = str | Callable[[Column, Column], Column]

#: A key with more records in a bag has its count windows numbered in many tasks.
HOT_ROWS = 1_000_000
#: Bytes of records that a task gathers before column expressions fold each key's values of them.
FOLD_BYTES = 16 << 20


@dataclass(frozen=True)
class Python:
    """Marks a kernel as a function of two Python values."""

    function: Callable


def folded(values: Column, kernel: Callable[[Column, Column], Column]) -> Column:
    """The kernel from left to right over an array that isn't empty."""
    return F.reduce(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.element_at(values, 1), kernel)


def numbered(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """`df` with rn, each key's records numbered from 0 by `order`. Keys are dealt out by ranges of key and order, so that
    one key's records are many tasks'; the count of a range's records of a key tells where the next begins."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sort = [F.col(c) for c in (*keys, *order)]
    dealt = df.repartitionByRange(n, *sort).sortWithinPartitions(*sort).withColumn("rn_place", F.monotonically_increasing_id())
    dealt = cut(dealt, "numbered").withColumns({"rn_part": F.shiftright("rn_place", 33), "rn_row": F.col("rn_place").bitwiseAND(F.lit((1 << 33) - 1))})
    names = [f"rn_key_{k}" for k in range(len(keys))]
    counts = dealt.groupBy(*[F.col(k).alias(x) for k, x in zip(keys, names, strict=True)], F.col("rn_part").alias("rn_of")).agg(F.count("*").alias("n"), F.min("rn_row").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*names).orderBy("rn_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*names, "rn_of", (before - F.col("first")).alias("rn_from"))
    meets = F.col("rn_part") == F.col("rn_of")
    for k, x in zip(keys, names, strict=True):
        meets &= F.col(k).eqNullSafe(F.col(x))
    joined = dealt.join(starts, meets)
    return joined.withColumn("rn", F.col("rn_row") + F.col("rn_from")).drop("rn_place", "rn_part", "rn_row", "rn_of", "rn_from", *names)


def hot(df: DataFrame) -> bool:
    """Whether a key has more than HOT_ROWS records; they are counted before they are shuffled."""
    return not df.groupBy("key").count().where(F.col("count") > HOT_ROWS).isEmpty()


@dataclass(frozen=True)
class ReduceByKey(Operator):
    """Records (key, val) to one for each key."""

    kernel: Kernel | Python
    structures = frozenset((BAG,))
    gathers = True

    def window(self, size: int, order_by: str = "seq", split: bool | None = None) -> WindowByKey:
        """Over each `size` records of a key, in order of a column. What is left at the end is a window too. `split`: whether
        one key's records of a bag are numbered by many tasks; None: if a key has more than HOT_ROWS, which is counted first."""
        return WindowByKey(self.kernel, size, order_by, split)

    def apply(self, df: DataFrame) -> DataFrame:
        if isinstance(self.kernel, str):
            return df.groupBy("key").agg(NAMED[self.kernel](F.col("val")).alias("val"))
        if isinstance(self.kernel, Python):
            return python_by_key(df, self.kernel.function)
        # Each batch's values of a key are folded before the shuffle, so that a key has at most one value from each batch.
        parts = batched(df).select("key", folded(F.col("vals"), self.kernel).alias("val"))
        return parts.groupBy("key").agg(folded(F.collect_list("val"), self.kernel).alias("val"))


@dataclass(frozen=True)
class Counted(Operator):
    """Equal records, as grouping has them, to one with their number, in column n. `of` names a column that says how many
    records each stands for, and then holds the sum. A bag in this form takes a row for each different record, however
    often it occurs: a FlatMap that keeps the number, and a Counted of it, give as many as the bag's own records would."""

    of: str | None = None
    structures = frozenset((BAG,))
    gathers = True

    def apply(self, df: DataFrame) -> DataFrame:
        name = self.of or "n"
        if (self.of is not None) != (name in df.columns):
            raise PipeTypeError(f"Counted: column {name} is {'missing' if self.of else 'taken'}")
        number = F.sum(F.col(f"`{name}`")) if self.of else F.count(F.lit(1))
        return df.groupBy(*[F.col(f"`{c}`") for c in df.columns if c != name]).agg(number.alias(name))


def batched(df: DataFrame) -> DataFrame:
    """(key, vals): the values of each key in each FOLD_BYTES of a partition; nothing is shuffled."""
    from pyspark.sql.pandas.types import to_arrow_schema

    read = df.select("key", "val")
    kind = T.StructType([read.schema["key"], T.StructField("vals", T.ArrayType(read.schema["val"].dataType))])
    arrow = to_arrow_schema(kind)

    def grouped(batch: pa.RecordBatch) -> pa.RecordBatch:
        order, starts = by_equal(batch["key"])
        vals = pa.ListArray.from_arrays(pa.array([*starts, len(order)], pa.int32()), batch["val"].take(order))
        keys = batch["key"].take(order.take(pa.array(starts, pa.int64()))) if len(starts) else batch["key"].slice(0, 0)
        return pa.RecordBatch.from_arrays([keys, vals.cast(arrow.field("vals").type)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= FOLD_BYTES:
                yield from map(grouped, pa.Table.from_batches(held).combine_chunks().to_batches())
                held, size = [], 0
        if held:
            yield from map(grouped, pa.Table.from_batches(held).combine_chunks().to_batches())

    return read.mapInArrow(run, kind)


def by_equal(keys: pa.Array) -> tuple[pa.Array, list[int]]:
    """Row numbers with those of equal keys beside each other, and where each key's begin."""
    if pa.types.is_nested(keys.type):
        places: dict = {}
        for i, k in enumerate(keys.to_pylist()):
            places.setdefault(repr(k), []).append(i)
        starts, order = [], []
        for rows in places.values():
            starts.append(len(order))
            order += rows
        return pa.array(order, pa.int64()), starts
    codes = keys.dictionary_encode("encode").indices
    order = pc.sort_indices(codes)
    sorted_codes = codes.take(order).to_numpy(zero_copy_only=False)
    return order, np.flatnonzero(np.concatenate(([len(order) > 0], sorted_codes[1:] != sorted_codes[:-1]))).tolist()


def python_by_key(df: DataFrame, f: Callable) -> DataFrame:
    """Each partition's records are reduced before the shuffle, so a key has at most one value from each."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = df.select("key", "val").schema
    arrow = to_arrow_schema(schema)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for k, v in zip(batch["key"].to_pylist(), batch["val"].to_pylist(), strict=True):
                held[k] = f(held[k], v) if k in held else v
        yield pa.RecordBatch.from_pydict({"key": list(held), "val": list(held.values())}, schema=arrow)

    def final(table: pa.Table) -> pa.Table:
        first, *rest = table["val"].to_pylist()
        for v in rest:
            first = f(first, v)
        return pa.Table.from_pydict({"key": table["key"].to_pylist()[:1], "val": [first]}, schema=arrow)

    return df.select("key", "val").mapInArrow(partial, schema).groupBy("key").applyInArrow(final, schema)


@dataclass(frozen=True)
class WindowByKey(Operator):
    """Count windows by key. On bags columns do it; on streams a state for each key, see weirflow.streaming."""

    kernel: Kernel | Python
    size: int
    order_by: str = "seq"
    split: bool | None = None
    structures = BOTH
    gathers = True

    def __post_init__(self):
        if self.size < 1:
            raise PipeError("a window holds at least one record")

    def apply(self, df: DataFrame) -> DataFrame:
        if df.isStreaming:
            from ..streaming.count_windows import windows

            return windows(df, self)
        if self.split or self.split is None and hot(df):
            rows = numbered(df, ["key"], [self.order_by])
        else:
            rows = df.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy(self.order_by)) - 1)
        groups = rows.groupBy("key", F.floor(F.col("rn") / self.size).alias("w"))
        if isinstance(self.kernel, str):
            return groups.agg(NAMED[self.kernel](F.col("val")).alias("val")).select("key", "val")
        values = F.transform(F.array_sort(F.collect_list(F.struct("rn", "val"))), lambda x: x["val"])
        if isinstance(self.kernel, Python):
            f, kind = self.kernel.function, df.schema["val"].dataType

            def fold(v):
                first, *rest = v
                for x in rest:
                    first = f(first, x)
                return first

            # At most `size` values meet.
            return groups.agg(F.udf(fold, kind, useArrow=True)(values).alias("val")).select("key", "val")
        return groups.agg(folded(values, self.kernel).alias("val")).select("key", "val")


@dataclass(frozen=True)
class Reduce(Operator):
    """All records' value to one; of no records, none."""

    kernel: Kernel | Python
    column: str = "value"
    structures = frozenset((BAG,))

    def apply(self, df: DataFrame) -> DataFrame:
        keyed = df.select(F.lit(0).alias("key"), F.col(self.column).alias("val"))
        return ReduceByKey(self.kernel).apply(keyed).select(F.col("val").alias(self.column))


@dataclass(frozen=True)
class FoldReduce(Operator):
    """All records to one state. Declared: aggregates by name. Of no records the aggregates' own empty value comes."""

    aggregates: dict[str, Column]
    structures = frozenset((BAG,))

    def apply(self, df: DataFrame) -> DataFrame:
        return df.agg(*[c.alias(k) for k, c in self.aggregates.items()])


@dataclass(frozen=True)
class PyFoldReduce(Operator):
    """All records to one state, in Python: `fold(state, record)` in each partition from `zero()`, then `merge(a, b)` by
    twos, fours and so on of the partitions' states. States are dicts of `schema`."""

    zero: Callable[[], dict]
    fold: Callable[[dict, dict], dict]
    merge: Callable[[dict, dict], dict]
    schema: str
    fan_in: int = 16
    structures = frozenset((BAG,))

    def apply(self, df: DataFrame) -> DataFrame:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = T._parse_datatype_string(self.schema)
        arrow, zero, fold, merge = to_arrow_schema(out), self.zero, self.fold, self.merge

        def folded_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state = zero()
            for batch in batches:
                for x in batch.to_pylist():
                    state = fold(state, x)
            yield pa.RecordBatch.from_pylist([state], schema=arrow)

        def merged_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state = None
            for batch in batches:
                for x in batch.to_pylist():
                    state = x if state is None else merge(state, x)
            yield pa.RecordBatch.from_pylist([] if state is None else [state], schema=arrow)

        states, n = df.mapInArrow(folded_part, out), df.rdd.getNumPartitions()
        while n > self.fan_in:
            n = -(-n // self.fan_in)
            states = states.repartition(n).mapInArrow(merged_part, out)
        return states.coalesce(1).mapInArrow(merged_part, out)


