"""Operators and kernels against sequential models, and their edge cases."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from functools import reduce

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weirflow.functions.kernels import duplicated, grown, kv_key, kv_text, kv_val, repeated_if_even, tokens
from weirflow.operators import Counted, Filter, FlatMap, FoldReduce, Map, PyFlatMap, PyFoldReduce, PyMap, Python, Reduce, ReduceByKey, kv
from weirflow.operators.reduce import WindowByKey, batched, numbered
from weirflow.plans.pipe import PipeTypeError, same_type

RANDOM = random.Random(7)


def frame(spark, pairs, parts=3):
    return spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(pairs)], "key string, val long, seq long").repartition(parts)


def some(n=300, keys="abcdef"):
    return [(RANDOM.choice(keys), RANDOM.randint(-10, 10)) for _ in range(n)]


def got(df):
    return sorted((r.key, r.val) for r in df.collect())


def by_key(pairs):
    out = defaultdict(list)
    for k, v in pairs:
        out[k].append(v)
    return out


def split_one(line: str) -> list[str]:
    """Words between single blanks, but for one empty word at the end."""
    t = line.split(" ")
    return t[:-1] if t[-1] == "" else t


@pytest.mark.parametrize("line", ["", " ", "a", "a  b ", " x", "a  ", "a b", "  ", "é ü", "a\tb\nc"])
def test_tokens(spark, line):
    df = spark.createDataFrame([(line,)], "v string").select(tokens(F.col("v")).alias("t"))
    assert df.first().t == split_one(line)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=" ab", max_size=8), max_size=6))
def test_tokens_of_any_line(spark, lines):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, v string")
    assert {r.k: r.t for r in df.select("k", tokens(F.col("v")).alias("t")).collect()} == {k: split_one(x) for k, x in enumerate(lines)}


def test_null_gives_no_words(spark):
    df = spark.createDataFrame([(None,)], "v string")
    assert FlatMap(lambda r: tokens(r.v)).apply(df).count() == 0


@pytest.mark.parametrize("s,n", [(0, 0), (4, 4), (-4, 4), (3, 0), (18, 8), (20, 0)])
def test_repeated_if_even(spark, s, n):
    assert spark.range(1).select(repeated_if_even(F.lit(s).cast("bigint")).alias("a")).first().a == [s] * n


@pytest.mark.parametrize("v", [0, 1, -3, 10, 12])
def test_grown(spark, v):
    m = abs(v) % 10
    want = sorted([v + 1, 0] * (m + 1)) if m else []
    assert sorted(spark.range(1).select(grown(F.lit(v).cast("bigint")).alias("a")).first().a) == want


def test_text_of_key_values(spark):
    df = spark.createDataFrame([("a", 3), ("x, y", -1)], "key string, val long")
    text = df.select(kv_text(F.col("key"), F.col("val")).alias("t"))
    assert [r.t for r in text.collect()] == ["<a, 3>", "<x, y, -1>"]
    assert got(text.select(*kv(kv_key(F.col("t")), kv_val(F.col("t"))))) == [("a", 3), ("x, y", -1)]
    bad = spark.createDataFrame([("<a 3>",), ("",), ("<a, b>",)], "t string").select(kv_key(F.col("t")).alias("k"), kv_val(F.col("t")).alias("v"))
    assert [tuple(r) for r in bad.collect()] == [(None, None), (None, None), ("a", None)]


def test_element_wise(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n long, s string")
    assert [r.value for r in Map(lambda r: r.n * 2).apply(df).collect()] == [2, 4]
    assert Map(lambda r: {"x": r.n, "y": r.s}).apply(df).columns == ["x", "y"]
    assert Filter(lambda r: r.s == "a").apply(df).count() == 1  # null is not true
    assert [r.value for r in FlatMap(lambda r: duplicated(r.n)).apply(df).collect()] == [1, 1, 2, 2]
    assert FlatMap(lambda r: F.array(F.struct(r.n.alias("a"), r.s.alias("b")))).apply(df).columns == ["a", "b"]
    assert [r.y for r in PyMap(lambda x: {"y": (x["s"] or "-") * x["n"]}, "y string").apply(df).collect()] == ["a", "--"]
    assert PyFlatMap(lambda x: [{"y": x["n"]}] * x["n"], "y long").apply(df).count() == 3
    assert PyFlatMap(lambda x: [], "y long").apply(df).count() == 0


def test_a_name_with_odd_characters(spark):
    df = spark.createDataFrame([(1,)], ["a.b c"])
    assert Map(lambda r: r["a.b c"] + 1).apply(df).first().value == 2


NAMED = {"sum": sum, "max": max, "min": min, "count": len, "xor": lambda v: reduce(lambda a, b: a ^ b, v), "and": lambda v: reduce(lambda a, b: a & b, v), "or": lambda v: reduce(lambda a, b: a | b, v)}


@pytest.mark.parametrize("name", NAMED)
def test_reduce_by_key(spark, name):
    pairs = some()
    assert got(ReduceByKey(name).apply(frame(spark, pairs))) == sorted((k, NAMED[name](v)) for k, v in by_key(pairs).items())


def test_reduce_by_key_with_any_kernel(spark):
    pairs = some()
    want = sorted((k, sum(v)) for k, v in by_key(pairs).items())
    assert got(ReduceByKey(lambda a, b: a + b).apply(frame(spark, pairs))) == want
    assert got(ReduceByKey(Python(lambda a, b: a + b)).apply(frame(spark, pairs))) == want


@pytest.mark.parametrize("kernel", ["sum", lambda a, b: a + b, Python(lambda a, b: a + b)])
def test_reduce_of_nothing_is_nothing(spark, kernel):
    empty = frame(spark, [])
    assert got(ReduceByKey(kernel).apply(empty)) == []
    assert got(ReduceByKey(kernel).window(2).apply(empty)) == []
    assert Reduce(kernel, "val").apply(empty).where("val is not null").count() == 0


def test_concat(spark):
    df = spark.createDataFrame([("a", [1, 2]), ("a", [3]), ("b", [])], "key string, val array<long>")
    assert {r.key: sorted(r.val) for r in ReduceByKey("concat").apply(df).collect()} == {"a": [1, 2, 3], "b": []}


def windowed(pairs, size, f):
    return sorted((k, f(v[i : i + size])) for k, v in by_key(pairs).items() for i in range(0, len(v), size))


@pytest.mark.parametrize("size", [1, 2, 8, 1000])
@pytest.mark.parametrize("split", [False, True, None])
def test_count_windows(spark, size, split):
    pairs = some()
    assert got(ReduceByKey("sum").window(size, split=split).apply(frame(spark, pairs))) == windowed(pairs, size, sum)


def test_count_windows_keep_the_order(spark):
    pairs = some(120)
    for kernel in (lambda a, b: a * 3 + b, Python(lambda a, b: a * 3 + b)):
        assert got(ReduceByKey(kernel).window(4).apply(frame(spark, pairs))) == windowed(pairs, 4, lambda v: reduce(lambda a, b: a * 3 + b, v))


def test_windows_split_where_a_key_is_hot(spark, monkeypatch):
    import weirflow.operators.reduce as module

    pairs = [("hot", i) for i in range(200)] + some(50)
    monkeypatch.setattr(module, "HOT_ROWS", 100)
    df = frame(spark, pairs, 5)
    assert got(WindowByKey("max", 3).apply(df)) == windowed(pairs, 3, max)


def test_numbered_by_ranges(spark):
    pairs = [("hot", i) for i in range(300)] + [("b", 1), (None, 5), (None, 6)]
    out = numbered(frame(spark, pairs, 5), ["key"], ["seq"]).orderBy("seq").collect()
    want, seen = [], defaultdict(int)
    for k, _ in pairs:
        want.append(seen[k])
        seen[k] += 1
    assert [r.rn for r in out] == want


def test_global_reductions(spark):
    pairs = some()
    df = frame(spark, pairs)
    vals = [v for _, v in pairs]
    for kernel in ("max", lambda a, b: F.greatest(a, b), Python(max)):
        assert [r.val for r in Reduce(kernel, "val").apply(df).collect()] == [max(vals)]
    assert FoldReduce({"n": F.count("*"), "s": F.sum("val")}).apply(df).first().asDict() == {"n": len(vals), "s": sum(vals)}
    fold = PyFoldReduce(lambda: {"n": 0, "s": 0}, lambda s, x: {"n": s["n"] + 1, "s": s["s"] + x["val"]}, lambda a, b: {k: a[k] + b[k] for k in a}, "n long, s long", fan_in=2)
    assert [r.asDict() for r in fold.apply(df.repartition(9)).collect()] == [{"n": len(vals), "s": sum(vals)}]


def test_plan_reaches_the_scan(spark, sf):
    """Filters and columns get to the Parquet reader, and reductions combine before the shuffle."""
    from weirflow.plans.pipe import Pipe
    from weirflow.sources import ReadTable

    p = Pipe(ReadTable(f"{sf}/lineitem.parquet")).add(Filter(lambda r: r.l_returnflag == "R")).add(Map(lambda r: kv(r.l_suppkey, r.l_quantity))).add(ReduceByKey("sum"))
    plan = p.compile(spark)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_returnflag,R)" in plan
    assert plan.count("HashAggregate") == 2 and plan.count("Exchange") == 1
    assert "l_comment" not in plan and "l_tax" not in plan


def test_any_kernel_combines_before_the_only_shuffle(spark):
    out = ReduceByKey(lambda a, b: a + b).apply(frame(spark, some()))
    plan = out._jdf.queryExecution().executedPlan().toString()
    # The frame is dealt out by the test itself.
    assert plan.count("Exchange hashpartitioning") == 1
    below = plan[plan.index("Exchange hashpartitioning") :]
    assert "MapInArrow" in below and "reduce(" in below


@pytest.mark.parametrize("key", ["string", "double", "struct<x: int, y: string>", "array<int>", "date"])
def test_any_kernel_by_any_key(spark, key):
    df = spark.range(500).select(F.when(F.col("id") % 7 > 0, F.col("id") % 7).alias("n"), F.col("id").alias("val"))
    made = {
        "string": F.col("n").cast("string"), "double": F.col("n") / 2, "struct<x: int, y: string>": F.struct(F.col("n").cast("int").alias("x"), F.lit("q").alias("y")),
        "array<int>": F.array(F.col("n").cast("int")), "date": F.date_add(F.lit("2020-01-01").cast("date"), F.col("n").cast("int")),
    }[key]
    df = df.select(made.alias("key"), F.col("val"))
    want = sorted((repr(r.key), r.val) for r in df.groupBy("key").agg(F.sum("val").alias("val")).collect())
    assert sorted((repr(r.key), r.val) for r in ReduceByKey(lambda a, b: a + b).apply(df).collect()) == want


def test_a_key_has_few_values_to_shuffle(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "10")
    try:
        df = spark.range(0, 4000, 1, 4).select(F.when(F.col("id") % 2 == 0, "k").alias("key"), F.col("id").alias("val"))
        parts = batched(df)
        assert sorted((r.key or "", len(r.vals)) for r in parts.collect()) == [("", 500)] * 4 + [("k", 500)] * 4
        total = Reduce(lambda a, b: a + b, "val").apply(df).collect()
        assert [r.val for r in total] == [sum(range(4000))]
        assert batched(df.limit(0)).count() == 0
    finally:
        spark.conf.set(name, before)


def test_counted(spark):
    df = spark.createDataFrame([("a", 1.5), ("a", 1.5), (None, 1.5), (None, 1.5), ("a", None)], "`k.1` string, v double")
    once = Counted().apply(df)
    assert once.columns == ["k.1", "v", "n"]
    assert Counter(map(tuple, once.collect())) == Counter([("a", 1.5, 2), (None, 1.5, 2), ("a", None, 1)])
    again = Counted(of="n").apply(once.union(once))
    assert same_type(again.schema, once.schema)
    assert Counter(map(tuple, again.collect())) == Counter([("a", 1.5, 4), (None, 1.5, 4), ("a", None, 2)])
    assert Counted().apply(df.limit(0)).count() == 0
    for clash in (lambda: Counted().apply(once), lambda: Counted(of="n").apply(df)):
        with pytest.raises(PipeTypeError):
            clash()


def test_number_of_tasks(spark):
    df = frame(spark, some())
    many = Map(lambda r: kv(r.key, r.val)).par(5).apply(df)
    assert many.rdd.getNumPartitions() == 5 and many.count() == 300
    assert ReduceByKey("sum").par(2).apply(df).rdd.getNumPartitions() == 2
    with pytest.raises(ValueError):
        Map(lambda r: r.val).par(0)
