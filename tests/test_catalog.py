"""Every registered query against DuckDB on the smallest tables; those without SQL run, and are tested elsewhere."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_module

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Of these the value is tested in tests/.
WITHOUT_SQL = {"stock_pricing_variance", "semantic_graph"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def own(names) -> list[str]:
    return [n for n in names if not n.startswith("op") and n != "pipeline"]


@pytest.mark.parametrize("name", own(entry_module.oracle_sql()))
def test_same_rows_as_sql(spark, duck, sf, rows, name):
    cursor = duck.execute(entry_module.oracle_sql()[name])
    columns = [x[0] for x in cursor.description]
    order = sorted(range(len(columns)), key=columns.__getitem__)
    want = Counter(tuple(f"{r[k]:.9g}" if isinstance(r[k], float) else repr(r[k]) for k in order) for r in cursor.fetchall())
    df = entry_module.queries()[name](spark, sf)
    assert sorted(df.columns) == sorted(columns)
    assert rows(df) == want


def exploded(df) -> int:
    """Rows that the arrays of a collected frame's plan became."""

    def below(plan) -> int:
        inner = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan.plan() if plan.nodeName().endswith("QueryStage") else None
        if inner is not None:
            return below(inner)
        own = plan.metrics().apply("numOutputRows").value() if plan.nodeName() == "Generate" else 0
        return own + sum(below(plan.children().apply(k)) for k in range(plan.children().size()))

    return below(df._jdf.queryExecution().executedPlan())


def test_iterate_flatmap_3_makes_few_rows_of_many_events(spark, duck, tmp_path):
    """The rounds' rows are bounded by the different records, however many events there are; odd events are the SQL's too."""
    odd = "SELECT CASE WHEN i % 11 = 0 THEN NULL ELSE i * 37 % 500 - CASE WHEN i % 13 = 0 THEN 40 ELSE 0 END END AS user_id, CASE WHEN i % 7 = 0 THEN NULL ELSE i * 1.5 - 400 END AS value, i AS event_id FROM range(600) r(i)"
    made = []
    for copies in (1, 10):
        (tmp_path / str(copies)).mkdir()
        path = f"{tmp_path}/{copies}/events.parquet"
        duck.execute(f"COPY (SELECT user_id, value, event_id + 600 * c AS event_id FROM ({odd}), range({copies}) s(c)) TO '{path}' (FORMAT parquet)")
        df = entry_module.queries()["iterate_flatmap_3"](spark, f"{tmp_path}/{copies}")
        got = Counter((r.key, r.val, r.n) for r in df.collect())
        made.append(exploded(df))
        con = duckdb.connect()
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}'")
        assert got == Counter(con.execute(entry_module.oracle_sql()["iterate_flatmap_3"]).fetchall())
    assert 0 < made[0] == made[1]


def test_each_query_has_sql_or_a_test_of_its_own():
    assert {n for n in own(entry_module.queries())} - set(entry_module.oracle_sql()) == WITHOUT_SQL


def test_entry(spark):
    assert entry_module.entry(spark).columns == ["key", "val"]
