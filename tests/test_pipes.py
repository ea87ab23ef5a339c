"""Composition of pipes: degrees, structures and types, and what each combinator computes."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from weirflow.functions.kernels import grown
from weirflow.operators import Counted, FlatMap, JoinFlatMapByKey, Map, PyJoinFlatMapByKey, ReduceByKey, kv, pair
from weirflow.plans.graph import Graph, semantics, to_dotfile
from weirflow.plans.pipe import BAG, STREAM, FixedIterations, Frame, Pipe, PipeError, PipeTypeError, Until
from weirflow.sources import Collect, ReadFromFile, ReadFromSocket, WriteToDisk, WriteToFile, WriteToStdOut


def numbers(spark, n=5) -> Pipe:
    return Pipe(Frame(spark.range(n).select(F.col("id").alias("value"))))


def plus(k) -> Map:
    return Map(lambda r: r.value + k)


def values(df) -> list:
    return sorted(r.value for r in df.collect())


def records(spark, *pairs):
    return Pipe(Frame(spark.createDataFrame(list(pairs), "key string, val long")))


def summed() -> JoinFlatMapByKey:
    return JoinFlatMapByKey(lambda k, a, b: F.array(pair(k, a + b)))


# Composition


def test_empty_is_neutral_and_to_is_associative(spark):
    p = Pipe(plus(1))
    assert Pipe().to(p) == p == p.to(Pipe())
    a, b, c = (Pipe(plus(k)) for k in (1, 2, 3))
    assert len(a.to(b).to(c).children) == len(a.to(b.to(c)).children) == 3
    assert values(numbers(spark, 2).to(a).to(b.to(c)).compile(spark)) == [6, 7]


def test_composition_leaves_its_parts_as_they_are(spark):
    p = numbers(spark)
    before = p.kind, p.children, p.outputs
    p.to(Pipe(plus(1)), Pipe(plus(2)))
    assert (p.kind, p.children, p.outputs) == before


@pytest.mark.parametrize(
    "compose",
    [
        lambda p: Pipe(Collect()).to(Pipe(plus(1))),  # nothing comes out
        lambda p: Pipe(plus(1)).to(p),  # nothing goes in
        lambda p: p.to(),
        lambda p: p.to(Pipe(plus(1)), p),
        lambda p: Pipe(Collect()).to(Pipe(plus(1)), Pipe(plus(1))),
        lambda p: Pipe(plus(1)).merge(Pipe(plus(2))),  # two inputs
        lambda p: p.merge(p.add(Collect())),
        lambda p: Pipe(plus(1)).pair_with(Pipe(plus(2)), summed()),
        lambda p: p.pair_with(p, plus(1)),
        lambda p: p.pair_with(p.add(Collect()), summed()),
        lambda p: Pipe(summed()),
        lambda p: p.iterate(2),
        lambda p: Pipe(plus(1)).iterate(0),
        lambda p: ReduceByKey("sum").window(0),
    ],
)
def test_terms_that_cannot_be(spark, compose):
    with pytest.raises(PipeError):
        compose(numbers(spark))


def test_structures_meet(tmp_path):
    assert Pipe(ReadFromFile("x")).add(plus(1)).structures == {BAG}
    assert Pipe(ReadFromSocket("h", 1)).add(plus(1)).structures == {STREAM}
    with pytest.raises(PipeError):  # also behind an operator that takes both
        Pipe(ReadFromSocket("h", 1)).to(Pipe(plus(1)).add(ReduceByKey("sum")))
    with pytest.raises(PipeError):
        Pipe(ReadFromFile("x")).add(WriteToStdOut())
    with pytest.raises(PipeError):
        Pipe(ReadFromSocket("h", 1)).add(WriteToDisk("x"))
    assert Pipe(ReadFromSocket("h", 1)).add(ReduceByKey("sum").window(2)).structures == {STREAM}
    with pytest.raises(PipeError):
        Pipe(ReadFromSocket("h", 1)).merge(Pipe(ReadFromFile("x")))
    with pytest.raises(PipeError):
        Pipe(WriteToStdOut()).iterate(2)


def test_only_closed_pipes_run(spark):
    with pytest.raises(PipeError):
        numbers(spark).run(spark)
    with pytest.raises(PipeError):
        Pipe(plus(1)).add(Collect()).run(spark)
    with pytest.raises(PipeError):
        Pipe(plus(1)).compile(spark)
    done = numbers(spark).add(Collect()).run(spark)
    assert values(done.result) == [0, 1, 2, 3, 4] and done.milliseconds > 0


def test_a_pipe_runs_again(spark, tmp_path):
    p = numbers(spark).add(WriteToFile(str(tmp_path / "out")))
    p.run(spark)
    p.run(spark)
    assert sorted((tmp_path / "out").read_text().split()) == list("01234")


# Combinators


def test_merge_keeps_duplicates(spark):
    p = numbers(spark, 2)
    assert values(p.merge(p).merge(p.add(plus(1))).compile(spark)) == [0, 0, 1, 1, 1, 2]
    assert len(p.merge(p).merge(p).children) == 3


def test_merge_of_an_open_pipe(spark):
    p = Pipe(plus(10)).merge(numbers(spark, 2))
    assert p.inputs == 1
    assert values(numbers(spark, 1).to(p).compile(spark)) == [0, 1, 10]


def test_merge_of_other_types(spark):
    with pytest.raises(PipeTypeError):
        numbers(spark).merge(numbers(spark).add(Map(lambda r: r.value.cast("string")))).compile(spark)


def test_multi_to(spark, tmp_path):
    p = numbers(spark, 2)
    assert values(p.to(Pipe(plus(1)), Pipe(plus(10))).compile(spark)) == [1, 2, 10, 11]
    mixed = p.to(Pipe(plus(1)), Pipe(WriteToFile(str(tmp_path / "a"))))
    assert mixed.outputs == 1 and values(mixed.compile(spark)) == [1, 2]
    assert sorted((tmp_path / "a").read_text().split()) == ["0", "1"]
    sinks = p.to(Pipe(WriteToFile(str(tmp_path / "b"))), Pipe(WriteToFile(str(tmp_path / "c"))))
    assert sinks.outputs == 0
    sinks.run(spark)
    assert (tmp_path / "b").read_text().split() == (tmp_path / "c").read_text().split()


def test_pair_with(spark):
    left, right = records(spark, ("a", 1), ("a", 2), ("b", 3), (None, 4)), records(spark, ("a", 10), ("a", 20), ("c", 5), (None, 6))
    out = left.pair_with(right, summed()).compile(spark)
    assert sorted(map(tuple, out.collect())) == [("a", 11), ("a", 12), ("a", 21), ("a", 22)]


def test_pair_with_takes_left_and_right_as_they_stand(spark):
    minus = JoinFlatMapByKey(lambda k, a, b: F.array(pair(k, a - b)))
    p = records(spark, ("a", 1))
    q = records(spark, ("a", 10))
    assert p.to(Pipe().pair_with(q, minus)).compile(spark).first().val == -9
    assert p.to(q.pair_with(Pipe(), minus)).compile(spark).first().val == 9


def test_pair_with_python(spark):
    twice = PyJoinFlatMapByKey(lambda k, a, b: [{"key": k, "val": f"{a}/{b}"}] * 2 if a else [], "key string, val string")
    p = records(spark, ("a", 1), ("a", 0))
    assert [tuple(r) for r in p.pair_with(p, twice).compile(spark).collect()].count(("a", "1/0")) == 2


def test_join_that_reduces(spark):
    p = records(spark, ("a", 1), ("a", 2), ("b", 3))
    out = p.pair_with(p, summed()).add(ReduceByKey("sum")).compile(spark)
    assert sorted(map(tuple, out.collect())) == [("a", 12), ("b", 6)]


# Iteration


def test_iterate_counts_rounds(spark):
    for n in (1, 2, 6):
        assert values(numbers(spark, 2).to(Pipe(plus(1)).iterate(n)).compile(spark)) == [n, n + 1]
    assert values(numbers(spark, 1).to(Pipe(plus(1)).iterate(FixedIterations(3))).compile(spark)) == [3]
    assert Pipe().iterate(3).empty


def test_iterate_until(spark):
    small = lambda before, now: now.agg(F.max("value")).first()[0] >= 7
    assert values(numbers(spark, 1).to(Pipe(plus(1)).iterate(Until(small))).compile(spark)) == [7]
    assert values(numbers(spark, 1).to(Pipe(plus(1)).iterate(Until(lambda *_: False, most=4))).compile(spark)) == [4]


def test_iterate_must_keep_the_type(spark):
    with pytest.raises(PipeTypeError):
        numbers(spark).to(Pipe(Map(lambda r: r.value.cast("string"))).iterate(2)).compile(spark)


def test_iterate_cuts_its_lineage(spark):
    df = numbers(spark, 3).to(Pipe(FlatMap(lambda r: F.array(r.value, r.value + 1))).iterate(4, cut_every=2)).compile(spark)
    assert df.count() == 3 * 2**4
    # After the last cut no operator of an earlier round is left.
    assert "Generate" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_iterate_passes_numbers_of_equal_records_on(spark):
    twice = Pipe(FlatMap(lambda r: F.array(r.value, r.value), keep=("n",))).add(Counted(of="n"))
    out = numbers(spark, 2).add(Counted()).to(twice.iterate(40, cut_every=10)).compile(spark)
    assert sorted(map(tuple, out.collect())) == [(0, 2**40), (1, 2**40)]


def test_iterate_gives_each_record_as_often_counted_or_not(spark):
    rows = [(k, v) for k in ("a", "b", None) for v in (*range(-30, 31, 7), 3, 3, 10, None)]
    grow = lambda r: F.transform(grown(r.val), lambda v: pair(r.key, v))
    for n in (1, 2, 3):
        plain = records(spark, *rows).to(Pipe(FlatMap(grow)).iterate(n)).compile(spark)
        step = Pipe(FlatMap(grow, keep=("n",))).add(Counted(of="n"))
        counted = records(spark, *rows).add(Counted()).to(step.iterate(n)).compile(spark)
        assert counted.columns == ["key", "val", "n"]
        got = [tuple(r) for r in counted.collect()]
        assert {(k, v): c for k, v, c in got} == Counter(map(tuple, plain.collect())) and len(got) == len({x[:2] for x in got})


def test_iterate_computes_the_other_side_once(spark, tmp_path):
    from weirflow.plans.pipe import Source

    loads = []

    class Counted(Source):
        structures = frozenset((BAG,))

        def load(self, spark):
            loads.append(1)
            return spark.createDataFrame([("a", 1)], "key string, val long")

    body = Pipe().pair_with(Pipe(Counted()), summed())
    out = records(spark, ("a", 0)).to(body.iterate(4)).compile(spark)
    assert out.first().val == 4 and len(loads) == 1


# Graphs


def test_graph(tmp_path):
    p = Pipe(ReadFromFile("x")).add(plus(1)).to(Pipe(plus(1)).iterate(2), Pipe(WriteToDisk("y")))
    g = Graph(p)
    assert g.nodes == ["ReadFromFile", "Map", "Map", "WriteToDisk"]
    assert g.edges == [(0, 1, ""), (2, 2, "again"), (1, 2, ""), (1, 3, "")]
    assert "Map[1] -> Map[2], WriteToDisk[3]" in semantics(p)
    to_dotfile(p, tmp_path / "p.dot")
    assert (tmp_path / "p.dot").read_text().startswith("digraph")


def test_graph_of_a_pair_without_input():
    p = Pipe(ReadFromFile("x")).pair_with(Pipe(ReadFromFile("y")), summed())
    assert Graph(p).edges == [(0, 2, "left"), (1, 2, "right")]
    assert "Merge" in semantics(Pipe(ReadFromFile("x")).merge(Pipe(ReadFromFile("y"))))


def test_graph_query(spark, sf):
    import __spark_entry__ as e

    got = {tuple(r) for r in e.queries()["semantic_graph"](spark, sf).collect()}
    assert ("Merge", "JoinFlatMapByKey", "right") in got and ("JoinFlatMapByKey", "Empty", "again") in got


def test_kv_columns(spark):
    assert numbers(spark, 1).add(Map(lambda r: kv(r.value, r.value))).compile(spark).columns == ["key", "val"]


def test_a_run_tells_its_stages(spark, tmp_path):
    run = numbers(spark).add(WriteToDisk(str(tmp_path / "out"))).run(spark)
    assert run.stages and all(x.done == x.tasks and not x.failed for x in run.stages)
    assert run.statistics().count("\n") == len(run.stages) - 1


def test_sinks_leave_nothing_cached(spark, tmp_path):
    before = spark._jsc.getPersistentRDDs().size()
    numbers(spark).to(Pipe(WriteToDisk(str(tmp_path / "a"))), Pipe(plus(1)).add(WriteToDisk(str(tmp_path / "b")))).run(spark)
    assert spark._jsc.getPersistentRDDs().size() == before


def test_tables_lie_in_the_shared_folder(spark, tmp_path, monkeypatch):
    from weirflow.plans import durable

    monkeypatch.setattr(durable, "shared_folder", lambda _: f"file://{tmp_path}")
    df = durable.cut(spark.range(3), "three")
    assert df.cut_path.startswith(f"file://{tmp_path}/weirflow-") and df.count() == 3
    durable.discard(df, spark.range(1))
    assert not list(tmp_path.glob("*/three*"))


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from weirflow.plans import durable

    context = SimpleNamespace(master="spark://h:7077", getCheckpointDir=lambda: None)
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context)
    with pytest.raises(RuntimeError):
        durable.shared_folder(session)
    context.getCheckpointDir = lambda: "hdfs://h/checkpoints"
    assert durable.shared_folder(session) == "hdfs://h/checkpoints"
