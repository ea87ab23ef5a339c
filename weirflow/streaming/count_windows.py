"""Count windows by key on streams: a state of each key holds its open window.

Kernels of two Python values, and the named ones that two values at a time can compute, keep a count and one value. For
column expressions and lists the state keeps the open window's values, of which there are fewer than the window's size
(or as many as its lists hold); full windows leave as arrays, and columns fold them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.live import Live, mark
from ..plans.pipe import PipeError

#: The named kernels that two values at a time can compute.
PAIRS: dict[str, Callable] = {
    "sum": lambda a, b: a + b,
    "max": lambda a, b: a if a >= b else b,
    "min": lambda a, b: a if a <= b else b,
    "xor": lambda a, b: a ^ b,
    "and": lambda a, b: a & b,
    "or": lambda a, b: a | b,
}


def pairwise(kernel: object) -> Callable | None:
    """The kernel as a function of two Python values; None if columns fold it."""
    from ..operators.reduce import Python

    if isinstance(kernel, Python):
        return kernel.function
    if isinstance(kernel, str):
        if kernel in PAIRS:
            return PAIRS[kernel]
        if kernel != "concat":
            raise PipeError("on a stream, a named kernel is one of " + ", ".join([*PAIRS, "concat"]))
    return None


def plain(x):
    return x.item() if isinstance(x, np.generic) else x


def in_order(parts: Iterable[pd.DataFrame]) -> Iterator:
    """A key's values of a micro-batch, in order; nulls as None."""
    rows = pd.concat(list(parts)).sort_values("at", kind="stable", na_position="first")
    for v, null in zip(rows["val"], rows["null"]):
        yield None if null else plain(v)


def windows(df: DataFrame, op) -> DataFrame:
    """Full windows, as (key, val). Records of a micro-batch are taken in order of op.order_by; those of an earlier one come
    first. Null values count like any other, as on bags; named kernels skip them, and Python functions are
    given None."""
    f, size, skips = pairwise(op.kernel), op.size, isinstance(op.kernel, str)
    key, val = df.schema["key"], df.schema["val"]

    def step(group: tuple, parts: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, value = state.get if state.exists else (0, None)
        out = []
        for v in in_order(parts):
            if not n or skips and value is None:
                value = v
            elif not (skips and v is None):
                value = f(value, v)
            n += 1
            if n == size:
                out.append(value)
                n, value = 0, None
        state.update((n, value))
        yield pd.DataFrame({"key": [plain(group[0])] * len(out), "val": pd.Series(out, dtype=object)})

    def gather(group: tuple, parts: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, values = state.get if state.exists else (0, [])
        held, out = list(values), []
        for v in in_order(parts):
            n += 1
            held += [v] if alone else [] if v is None else list(v)
            if n == size:
                out.append(held)
                n, held = 0, []
        state.update((n, held))
        yield pd.DataFrame({"key": [plain(group[0])] * len(out), "val": pd.Series(out, dtype=object)})

    # Lists are held as their values, one after another, and as text: pandas has no nulls in lists of numbers.
    alone, nested = op.kernel != "concat", T.ArrayType | T.MapType | T.StructType | T.BinaryType
    if not f and isinstance(val.dataType if alone else val.dataType.elementType, nested):
        raise PipeError("on a stream, a column expression reduces plain values, and concat lists of plain values")
    kind = val.dataType if f else T.ArrayType(val.dataType if alone else T.StringType())
    schema = T.StructType([T.StructField("key", key.dataType), T.StructField("val", kind)])
    kept = T.StructType([T.StructField("n", T.LongType()), T.StructField("val", kind)])
    # pandas turns integers beside a null into floats, so nulls are told by a column of their own.
    filled = F.coalesce("val", F.lit(0).cast(val.dataType)) if isinstance(val.dataType, T.NumericType) else F.col("val")
    if not alone:
        filled = F.col("val").cast(kind)
    rows = df.select("key", filled.alias("val"), F.col(op.order_by).alias("at"), F.col("val").isNull().alias("null"))
    states = rows.groupBy("key").applyInPandasWithState(step if f else gather, schema, kept, "append", "NoTimeout")
    made = F.col("val") if f else folded_values(op.kernel) if alone else F.col("val").cast(val.dataType)
    reduced = lambda x: x.select("key", made.alias("val"))
    return mark(reduced(states), Live(window=states, opened=opened, after=reduced, whole=True))


def folded_values(kernel: Callable[[Column, Column], Column]) -> Column:
    from ..operators.reduce import folded

    return folded(F.col("val"), kernel)


def opened(state: DataFrame) -> DataFrame:
    """(key, val) of the open windows, of the rows of a state store."""
    # The state is the group's: a struct with the declared fields, packed beside a timeout.
    value = state.schema["value"].dataType
    inner = "value.groupState" if "groupState" in value.names else "value"
    key = F.col("key").getField(state.schema["key"].dataType.names[0])
    return state.where(F.col(f"{inner}.n") > 0).select(key.alias("key"), F.col(f"{inner}.val").alias("val"))
