"""Queries over the test tables, by name, and the SQL that gives the same rows."""

from __future__ import annotations

import contextlib
import io
import socket
import tempfile
import threading
from collections.abc import Callable
from math import comb

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .apps import links, page_rank, parsed_edges, parsed_options, stock_pricing, stock_pricing_windowed, stock_tweets, word_count
from .functions.kernels import duplicated, grown, kv_key, kv_text, kv_val, repeated_if_even, tokens
from .functions.pricing import binomial_call
from .operators import Counted, Filter, FlatMap, FoldReduce, JoinFlatMapByKey, Map, PyFlatMap, PyFoldReduce, PyJoinFlatMapByKey, PyMap, Python, Reduce, ReduceByKey, kv, pair
from .plans.durable import new_path
from .plans.graph import Graph
from .plans.pipe import BinaryOperator, Pipe, Until
from .sources import Drain, ReadFromFile, ReadFromHDFS, ReadFromSocket, ReadFromStdIn, ReadStream, ReadTable, WriteToDisk, WriteToFile, WriteToStdOut, spooled

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Names that the tweets query looks for.
STOCKS = ["by", "this", "from", "with", "pour", "avec", "mit", "nicht"]


def query(sql: str | None = None):
    """Register a function that returns a pipe, or rows, under its name."""

    def put(f):
        QUERIES[f.__name__] = lambda spark, d: out.compile(spark) if isinstance(out := f(spark, d), Pipe) else out
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(d: str, name: str, *columns: str) -> Pipe:
    return Pipe(ReadTable(f"{d}/{name}.parquet", columns))


def value_of(r):
    return F.floor(r.value).cast("bigint") % 21 - 10


def pairs(d: str) -> Pipe:
    """Events as records of 26 keys with small values, and their order."""
    return table(d, "events", "event_id", "user_id", "value").add(Map(lambda r: [*kv(F.chr((97 + r.user_id % 26).cast("int")), value_of(r)), r.event_id.alias("seq")]))


def users(d: str) -> Pipe:
    """Events as records (user, small value)."""
    return table(d, "events", "user_id", "value").add(Map(lambda r: kv(r.user_id, value_of(r))))


def nations(d: str) -> Pipe:
    return table(d, "nation", "n_regionkey", "n_nationkey").add(Map(lambda r: kv(r.n_regionkey.cast("bigint"), r.n_nationkey.cast("bigint"))))


def bare() -> Map:
    return Map(lambda r: kv(r.key, r.val))


_VAL = "cast(floor(value) AS BIGINT) % 21 - 10"
_PAIRS = f"(SELECT chr(cast(97 + user_id % 26 AS INTEGER)) AS key, {_VAL} AS val, event_id AS seq FROM events)"
_USERS = f"(SELECT user_id AS key, {_VAL} AS val FROM events)"
_NATIONS = "(SELECT cast(n_regionkey AS BIGINT) AS key, cast(n_nationkey AS BIGINT) AS val FROM nation)"
_TOKENS = "(CASE WHEN string_split(text, ' ')[-1] = '' THEN string_split(text, ' ')[1:-2] ELSE string_split(text, ' ') END)"


def _rbk(f: str) -> str:
    return f"SELECT key, cast({f} AS BIGINT) AS val FROM {_PAIRS} GROUP BY key"


def _window(f: str, size: int, rows: str = _PAIRS) -> str:
    return f"SELECT key, cast({f} AS BIGINT) AS val FROM (SELECT key, val, (row_number() OVER (PARTITION BY key ORDER BY seq) - 1) // {size} AS w FROM {rows}) GROUP BY key, w"


# Element-wise


@query("SELECT l_orderkey, l_linenumber, cast(cast(l_extendedprice AS DECIMAL(12, 2)) * (1 - cast(l_discount AS DECIMAL(4, 2))) AS DOUBLE) AS revenue FROM lineitem")
def map_revenue(spark, d):
    money = lambda r: r.l_extendedprice.cast("decimal(12,2)") * (1 - r.l_discount.cast("decimal(4,2)"))
    revenue = lambda r: [r.l_orderkey, r.l_linenumber, money(r).cast("double").alias("revenue")]
    return table(d, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount").add(Map(revenue))


@query(f"SELECT key, val, '<' || key || ', ' || cast(val AS VARCHAR) || '>' AS value FROM {_PAIRS}")
def map_kv_roundtrip(spark, d):
    text = pairs(d).add(Map(lambda r: kv_text(r.key, r.val)))
    return text.add(Map(lambda r: [*kv(kv_key(r.value), kv_val(r.value)), r.value]))


@query(f"SELECT key, val * 2 AS val FROM {_PAIRS}")
def map_python(spark, d):
    return pairs(d).add(PyMap(lambda x: {"key": x["key"], "val": 2 * x["val"]}, "key string, val long"))


@query("SELECT n_name AS value FROM nation, range(2)")
def flatmap_duplicate(spark, d):
    return table(d, "nation", "n_name").add(FlatMap(lambda r: duplicated(r.n_name)))


@query(f"SELECT doc_id, unnest({_TOKENS}) AS value FROM documents")
def flatmap_tokenize(spark, d):
    return table(d, "documents", "doc_id", "text").add(FlatMap(lambda r: tokens(r.text), keep=("doc_id",)))


@query("SELECT event_type AS key, unnest(range(cast(length(event_type) AS BIGINT))) AS val FROM events")
def flatmap_python(spark, d):
    return table(d, "events", "event_type").add(PyFlatMap(lambda x: ({"key": x["event_type"], "val": k} for k in range(len(x["event_type"]))), "key string, val long"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'")
def filter_flatmap(spark, d):
    return table(d, "lineitem").add(Filter(lambda r: r.l_returnflag == "R")).add(Map(lambda r: [r.l_orderkey, r.l_linenumber]))


@query("SELECT r_name FROM region")
def empty_pipe(spark, d):
    return Pipe().to(table(d, "region", "r_name")).to(Pipe())


# Reductions


@query(f"SELECT key, count(*) AS val FROM (SELECT unnest({_TOKENS}) AS key FROM documents) GROUP BY key")
def wordcount(spark, d):
    return table(d, "documents", "text").to(word_count("text"))


for _name, _kernel, _sql in (("sum", "sum", "sum(val)"), ("max", "max", "max(val)"), ("min", "min", "min(val)"), ("count", "count", "count(val)"), ("xor", "xor", "bit_xor(val)")):
    QUERIES[f"rbk_{_name}"] = lambda spark, d, k=_kernel: pairs(d).add(ReduceByKey(k)).compile(spark)
    SQL[f"rbk_{_name}"] = _rbk(_sql)


@query(f"SELECT key, string_agg(cast(val AS VARCHAR), ',' ORDER BY val) AS val FROM {_PAIRS} GROUP BY key")
def rbk_concat(spark, d):
    lists = pairs(d).add(Map(lambda r: kv(r.key, F.array(r.val)))).add(ReduceByKey("concat"))
    return lists.add(Map(lambda r: kv(r.key, F.array_join(F.array_sort(r.val), ","))))


@query(_rbk("bit_xor(val)"))
def rbk_expr_kernel(spark, d):
    return pairs(d).add(bare()).add(ReduceByKey(lambda a, b: a.bitwiseXOR(b)))


@query(_rbk("sum(val)"))
def rbk_python(spark, d):
    return pairs(d).add(ReduceByKey(Python(lambda a, b: a + b)))


@query("SELECT l_returnflag AS key, cast(sum(cast(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS val FROM lineitem GROUP BY ALL")
def rbk_sum_fact(spark, d):
    money = table(d, "lineitem", "l_returnflag", "l_extendedprice").add(Map(lambda r: kv(r.l_returnflag, r.l_extendedprice.cast("decimal(18,2)"))))
    return money.add(ReduceByKey("sum")).add(Map(lambda r: kv(r.key, r.val.cast("double"))))


@query(_window("sum(val)", 2))
def rbk_window_sum_2(spark, d):
    return pairs(d).add(ReduceByKey("sum").window(2))


@query(_window("max(val)", 8))
def rbk_window_max_8(spark, d):
    return pairs(d).add(ReduceByKey("max").window(8))


@query(_window("max(val)", 8))
def rbk_window_split(spark, d):
    return pairs(d).add(ReduceByKey("max").window(8, split=True))


@query(_window("sum(val)", 1))
def rbk_window_size1(spark, d):
    return pairs(d).add(ReduceByKey("sum").window(1))


@query(f"SELECT key, list_reduce(list(val ORDER BY seq), lambda a, b: a * 3 + b) AS val FROM (SELECT key, val, seq, (row_number() OVER (PARTITION BY key ORDER BY seq) - 1) // 4 AS w FROM {_PAIRS}) GROUP BY key, w")
def rbk_window_expr_4(spark, d):
    return pairs(d).add(ReduceByKey(lambda a, b: a * 3 + b).window(4))


@query("SELECT count(*) AS n, cast(sum(cast(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS quantity, max(l_extendedprice) AS top FROM lineitem")
def fold_stats(spark, d):
    folds = {"n": F.count("*"), "quantity": F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double"), "top": F.max("l_extendedprice")}
    return table(d, "lineitem", "l_quantity", "l_extendedprice").add(FoldReduce(folds))


@query("SELECT count(*) AS n, max(l_linenumber) AS top FROM lineitem")
def fold_python(spark, d):
    fold = lambda s, x: {"n": s["n"] + 1, "top": max(s["top"], x["l_linenumber"])}
    merge = lambda a, b: {"n": a["n"] + b["n"], "top": max(a["top"], b["top"])}
    return table(d, "lineitem", "l_linenumber").add(PyFoldReduce(lambda: {"n": 0, "top": 0}, fold, merge, "n long, top int"))


@query("SELECT max(l_extendedprice) AS value FROM lineitem")
def reduce_global(spark, d):
    return table(d, "lineitem", "l_extendedprice").add(Map(lambda r: r.l_extendedprice)).add(Reduce("max"))


# Joins


def evens(key, a, b):
    return F.transform(repeated_if_even(a + b), lambda s: pair(key, s))


_EVENS = "SELECT key, unnest(list_transform(range(CASE WHEN s % 2 = 0 THEN abs(s % 10) ELSE 0 END), lambda i: s)) AS val FROM (SELECT l.key, l.val + r.val AS s FROM {0} l JOIN {1} r ON l.key = r.key)"


@query(_EVENS.format(_USERS, _USERS))
def join_self(spark, d):
    return users(d).pair_with(users(d), JoinFlatMapByKey(evens))


@query(_EVENS.format(_USERS, _NATIONS))
def join_open(spark, d):
    return users(d).to(Pipe().pair_with(nations(d), JoinFlatMapByKey(evens)))


@query("SELECT n_regionkey AS key, n_name || '@' || r_name AS val FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_hetero(spark, d):
    left = table(d, "nation").add(Map(lambda r: kv(r.n_regionkey, r.n_name)))
    right = table(d, "region").add(Map(lambda r: kv(r.r_regionkey, F.struct(r.r_name.alias("name")))))
    return left.pair_with(right, JoinFlatMapByKey(lambda k, a, b: F.array(pair(k, F.concat(a, F.lit("@"), b["name"])))))


@query(f"SELECT key, cast(sum(val) AS BIGINT) AS val FROM ({_EVENS.format(_USERS, _USERS)}) GROUP BY key")
def join_then_rbk(spark, d):
    return users(d).pair_with(users(d), JoinFlatMapByKey(evens)).add(ReduceByKey("sum"))


@query("SELECT o_orderpriority AS key, cast(sum(cast(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS val FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def join_fact_dim(spark, d):
    facts = table(d, "lineitem", "l_orderkey", "l_extendedprice").add(Map(lambda r: kv(r.l_orderkey, r.l_extendedprice.cast("decimal(18,2)"))))
    dims = table(d, "orders", "o_orderkey", "o_orderpriority").add(Map(lambda r: kv(r.o_orderkey, r.o_orderpriority)))
    joined = facts.pair_with(dims, JoinFlatMapByKey(lambda k, price, priority: F.array(pair(priority, price))))
    return joined.add(ReduceByKey("sum")).add(Map(lambda r: kv(r.key, r.val.cast("double"))))


@query(_EVENS.format(_USERS, _NATIONS))
def join_python(spark, d):
    def kernel(key, a, b):
        return [{"key": key, "val": a + b}] * (abs(a + b) % 10 if (a + b) % 2 == 0 else 0)

    return users(d).pair_with(nations(d), PyJoinFlatMapByKey(kernel, "key long, val long"))


# Combinators


@query("SELECT n_name AS value FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT n_name FROM nation")
def merge_union_all(spark, d):
    names = table(d, "nation").add(Map(lambda r: r.n_name))
    return names.merge(table(d, "region").add(Map(lambda r: r.r_name))).merge(names)


@query(f"SELECT key, val + 1 AS val FROM {_PAIRS} UNION ALL SELECT key, max(val) FROM {_PAIRS} GROUP BY key")
def multi_to(spark, d):
    return pairs(d).add(bare()).to(Pipe(Map(lambda r: kv(r.key, r.val + 1))), Pipe(ReduceByKey("max")))


def _grown(rows: str) -> str:
    return f"SELECT key, unnest(flatten(list_transform(range(CASE WHEN abs(val % 10) <> 0 THEN abs(val % 10) + 1 ELSE 0 END), lambda i: [val + 1, 0]))) AS val FROM ({rows})"


@query(f"SELECT key, val, count(*) AS n FROM ({_grown(_grown(_grown(f'SELECT key, val FROM {_PAIRS}')))}) GROUP BY key, val")
def iterate_flatmap_3(spark, d):
    """Each event becomes hundreds of records, few of which differ, so rounds pass numbers of equal ones on."""
    step = Pipe(FlatMap(lambda r: F.transform(grown(r.val), lambda v: pair(r.key, v)), keep=("n",))).add(Counted(of="n"))
    return pairs(d).add(bare()).add(Counted()).to(step.iterate(3))


def _joined(rows: str) -> str:
    return _EVENS.format(f"({rows})", _NATIONS)


@query(_joined(_joined(_joined(f"SELECT * FROM {_NATIONS}"))))
def iterate_join_3(spark, d):
    return nations(d).to(Pipe().pair_with(nations(d), JoinFlatMapByKey(evens)).iterate(3))


@query("SELECT cast(n_nationkey AS BIGINT) * 64 AS value FROM nation")
def iterate_until(spark, d):
    """Doubled until the largest is over 1000; the largest of 24 is after six rounds."""
    start = table(d, "nation", "n_nationkey").add(Map(lambda r: r.n_nationkey.cast("bigint")))
    return start.to(Pipe(Map(lambda r: r.value * 2)).iterate(Until(lambda before, now: now.agg(F.max("value")).first()[0] > 1000)))


_EDGES = "SELECT DISTINCT l_partkey % 100 AS src, l_suppkey % 100 AS dst FROM lineitem"
_RANKS = "r0 AS (SELECT node, cast(1 AS DOUBLE) AS rank FROM nodes)" + "".join(
    f", r{k} AS (SELECT dst AS node, sum(rank / n) * 0.85 + (1 - 0.85) / (SELECT count(*) FROM nodes) AS rank FROM r{k - 1} JOIN edges ON node = src JOIN degree USING (src) GROUP BY dst)" for k in range(1, 11)
)


@query(
    f"WITH edges AS MATERIALIZED ({_EDGES}), nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges), degree AS (SELECT src, count(*) AS n FROM edges GROUP BY src), {_RANKS} SELECT node AS key, round(rank, 6) AS val FROM r10"
)
def pagerank_10(spark, d):
    edges = spark.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_partkey") % 100).alias("src"), (F.col("l_suppkey") % 100).alias("dst")).distinct()
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    rank = page_rank(nodes.count(), framed(edges).to(links()))
    return framed(nodes).to(rank).add(Map(lambda r: kv(r.key, F.round(r.val, 6))))


def framed(df: DataFrame) -> Pipe:
    from .plans.pipe import Frame

    return Pipe(Frame(df))


# Applications


def options(d: str) -> Pipe:
    """Each line item as an option on its part, with an order."""

    def option(r):
        price = r.l_extendedprice / r.l_quantity
        return [
            r.l_partkey.alias("name"), price.alias("s"), (price * (0.8 + 0.05 * r.l_linenumber)).alias("strike"), r.l_tax.alias("r"), (0.1 + r.l_discount).alias("v"),
            (r.l_quantity / 50).alias("t"), F.when(r.l_linestatus == "O", "C").otherwise("P").alias("kind"), (r.l_orderkey * 10 + r.l_linenumber).alias("seq"),
        ]

    return table(d, "lineitem").add(Map(option))


def _normal(x: str) -> str:
    k = f"(1.0 / (1.0 + abs({x}) * 0.2316419))"
    poly = f"{k} * (0.319381530 + {k} * (-0.356563782 + {k} * (1.781477937 + {k} * (-1.821255978 + {k} * 1.330274429))))"
    tail = f"(exp(-0.5 * {x} * {x}) * 0.39894228040143270286 * ({poly}))"
    return f"(CASE WHEN {x} < 0 THEN {tail} ELSE 1.0 - {tail} END)"


@query(
    f"""
WITH o AS (SELECT l_partkey AS name, l_extendedprice / l_quantity AS s, l_extendedprice / l_quantity * (0.8 + 0.05 * l_linenumber) AS strike, l_tax AS r, 0.1 + l_discount AS v, l_quantity / 50 AS t, l_linestatus <> 'O' AS put FROM lineitem),
a AS (SELECT *, (ln(s / strike) + (r + v * v * 0.5) * t) / (v * sqrt(t)) AS d1, strike * exp(-r * t) AS later FROM o),
b AS (SELECT *, d1 - v * sqrt(t) AS d2 FROM a)
SELECT name AS key, round(max(CASE WHEN put THEN later * (1.0 - {_normal('d2')}) - s * (1.0 - {_normal('d1')}) ELSE s * {_normal('d1')} - later * {_normal('d2')} END), 6) AS val FROM b GROUP BY name
"""
)
def stock_pricing_max(spark, d):
    return options(d).to(stock_pricing()).add(Map(lambda r: kv(r.key, F.round(r.val, 6))))


@query()
def stock_pricing_variance(spark, d):
    return options(d).to(stock_pricing_windowed()).add(Map(lambda r: kv(r.key, F.round(r.val, 6))))


_TREE = " + ".join(f"{float(comb(10, j))} * power(p, {j}) * power(1 - p, {10 - j}) * greatest(s * power(up, {2 * j - 10}) - strike, 0.0)" for j in range(11))


@query(
    f"""
WITH o AS (SELECT l_partkey AS name, l_extendedprice / l_quantity AS s, l_extendedprice / l_quantity * (0.8 + 0.05 * l_linenumber) AS strike, l_tax AS r, 0.1 + l_discount AS v, l_quantity / 50 AS t FROM lineitem),
a AS (SELECT *, exp(v * sqrt(t / 10)) AS up FROM o), b AS (SELECT *, (exp(r * t / 10) - 1 / up) / (up - 1 / up) AS p FROM a)
SELECT name AS key, round(max(exp(-r * t) * ({_TREE})), 6) AS val FROM b GROUP BY name
"""
)
def stock_pricing_binomial(spark, d):
    price = Map(lambda r: kv(r.name, binomial_call(r.s, r.strike, r.r, r.v, r.t)))
    return options(d).add(price).add(ReduceByKey("max")).add(Map(lambda r: kv(r.key, F.round(r.val, 6))))


@query("SELECT cast(l_partkey AS BIGINT) AS src, cast(l_suppkey AS BIGINT) AS dst FROM lineitem WHERE l_linenumber % 3 <> 0")
def parse_edges(spark, d):
    def line(r):
        edge = F.concat(F.lit(" "), r.l_partkey.cast("string"), F.lit("\t "), r.l_suppkey.cast("string"))
        return F.when(r.l_linenumber % 3 != 0, edge).otherwise(F.concat(r.l_partkey.cast("string"), F.lit(" none")))

    return table(d, "lineitem", "l_partkey", "l_suppkey", "l_linenumber").add(Map(line)).to(parsed_edges())


@query(
    "SELECT cast(l_partkey AS VARCHAR) AS name, cast(l_orderkey % 90 + 10 AS DOUBLE) AS s, cast(l_suppkey % 90 + 10 AS DOUBLE) AS strike, cast(0.05 AS DOUBLE) AS r, cast(0 AS DOUBLE) AS divq, cast(0.25 AS DOUBLE) AS v, cast(l_linenumber AS DOUBLE) AS t, CASE WHEN l_linestatus = 'O' THEN 'C' ELSE 'P' END AS kind, cast(NULL AS DOUBLE) AS divs, cast(1.5 AS DOUBLE) AS reference FROM lineitem"
)
def parse_options(spark, d):
    def line(r):
        kind = F.when(r.l_linestatus == "O", "C").otherwise("P")
        return F.concat_ws(" ", r.l_partkey, r.l_orderkey % 90 + 10, r.l_suppkey % 90 + 10, F.lit("0.05"), F.lit("0.0"), F.lit("0.25"), r.l_linenumber, kind, F.lit("none"), F.lit("1.5"))

    return table(d, "lineitem", "l_partkey", "l_orderkey", "l_suppkey", "l_linenumber", "l_linestatus").add(Map(line)).to(parsed_options())


_NAMES = "[" + ", ".join(f"'{x}'" for x in STOCKS) + "]"


@query(
    _window(
        "max(val)",
        8,
        f"(SELECT list_intersect(list_distinct(t), {_NAMES})[1] AS key, list_sum(list_transform(t, lambda w: length(w) + 1)) AS val, seq FROM (SELECT {_TOKENS} AS t, doc_id AS seq FROM documents) WHERE len(list_intersect(list_distinct(t), {_NAMES})) = 1)",
    )
)
def stock_tweets_max(spark, d):
    texts = table(d, "documents", "text", "doc_id").add(Map(lambda r: [r.text.alias("value"), r.doc_id.alias("seq")]))
    return texts.to(stock_tweets(STOCKS))


# Files and streams


@query("SELECT unnest(string_split(text, chr(10))) AS value FROM documents")
def io_text_roundtrip(spark, d):
    path = new_path(spark, "lines")
    table(d, "documents", "text").add(Map(lambda r: r.text)).add(WriteToDisk(path)).run(spark)
    return Pipe(ReadFromFile(path))


@query(f"SELECT '(' || key || ':' || cast(val AS VARCHAR) || ')' AS value FROM {_PAIRS}")
def sink_formatter(spark, d):
    path = new_path(spark, "formatted")
    pairs(d).add(WriteToDisk(path, lambda r: F.concat(F.lit("("), r.key, F.lit(":"), r.val.cast("string"), F.lit(")")))).run(spark)
    return Pipe(ReadFromHDFS(path))


@query("SELECT '<' || cast(n_regionkey AS VARCHAR) || ', ' || cast(n_nationkey AS VARCHAR) || '>' AS value FROM nation")
def sink_one_file(spark, d):
    """The driver's file is this machine's, so the driver reads it back."""
    with tempfile.NamedTemporaryFile("r") as f:
        nations(d).add(WriteToFile(f.name)).run(spark)
        lines = f.read().splitlines()
    return spark.createDataFrame([(x,) for x in lines], "value string")


def printed(spark: SparkSession, pipe: Pipe) -> DataFrame:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        pipe.run(spark)
    return spark.createDataFrame([(x,) for x in out.getvalue().splitlines()], "value string")


@query("SELECT n_name AS value FROM nation")
def sink_stdout(spark, d):
    return printed(spark, Pipe(ReadFromStdIn(b";", file=io.BytesIO(";".join(nation_names(spark, d)).encode()))).add(WriteToStdOut()))


@query("SELECT '<' || n_name || '>' AS value FROM nation")
def sink_stdout_formatter(spark, d):
    angled = WriteToStdOut(lambda r: F.concat(F.lit("<"), r.value, F.lit(">")))
    return printed(spark, Pipe(ReadFromStdIn(b";", file=io.BytesIO(";".join(nation_names(spark, d)).encode()))).add(angled))


def served(data: bytes) -> int:
    """The port of a server that sends the bytes to who connects first, and closes."""
    s = socket.create_server(("127.0.0.1", 0))

    def serve() -> None:
        with s:
            c, _ = s.accept()
            with c:
                c.sendall(data)

    threading.Thread(target=serve, daemon=True).start()
    return s.getsockname()[1]


@query("SELECT cast(n_regionkey AS BIGINT) AS key, cast(max(n_nationkey) AS BIGINT) AS val FROM (SELECT *, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1) // 2 AS w FROM nation) GROUP BY n_regionkey, w")
def socket_window(spark, d):
    rows = spark.read.parquet(f"{d}/nation.parquet").orderBy("n_nationkey").select("n_regionkey", "n_nationkey").toLocalIterator()
    text = "".join(f"<{a}, {b}>;" for a, b in rows) + "<9, a tail that nothing ends"
    parsed = Map(lambda r: [*kv(kv_key(r.value).cast("bigint"), kv_val(r.value)), r.seq])
    return Pipe(ReadFromSocket("127.0.0.1", served(text.encode()), b";")).add(parsed).add(ReduceByKey("max").window(2)).add(Drain()).run(spark).result


def nation_names(spark: SparkSession, d: str) -> list[str]:
    return [r[0] for r in spark.read.parquet(f"{d}/nation.parquet").orderBy("n_nationkey").select("n_name").toLocalIterator()]


@query("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS seq, n_name AS value FROM nation")
def frame_delimited(spark, d):
    return Pipe(ReadFromStdIn(b";", file=io.BytesIO(";".join(nation_names(spark, d)).encode()))).add(Drain()).run(spark).result


def streamed(spark: SparkSession, d: str) -> Pipe:
    return Pipe(ReadStream(spooled(pairs(d).compile(spark), "seq"), "key string, val long, seq long"))


@query(_window("sum(val)", 2))
def stream_window_2(spark, d):
    return streamed(spark, d).add(ReduceByKey("sum").window(2)).add(Drain()).run(spark).result


@query(_window("max(val)", 8))
def stream_window_python_8(spark, d):
    return streamed(spark, d).add(ReduceByKey(Python(max)).window(8)).add(Drain()).run(spark).result


@query(f"SELECT key, val * 100 AS val FROM ({_window('sum(val)', 2)})")
def stream_window_then_map(spark, d):
    return streamed(spark, d).add(ReduceByKey("sum").window(2)).add(Map(lambda r: kv(r.key, r.val * 100))).add(Drain()).run(spark).result


@query(f"SELECT key || '!' AS value FROM ({_window('sum(val)', 2)}) WHERE val > 5")
def stream_window_then_filter(spark, d):
    windowed = streamed(spark, d).add(ReduceByKey("sum").window(2)).add(Filter(lambda r: r.val > 5))
    return windowed.add(Map(lambda r: F.concat(r.key, F.lit("!")))).add(Drain()).run(spark).result


@query(f"SELECT key, val FROM ({_window('max(val)', 8)}) UNION ALL SELECT key, -val FROM ({_window('max(val)', 8)})")
def stream_window_branches(spark, d):
    windowed = streamed(spark, d).add(ReduceByKey("max").window(8))
    return windowed.to(Pipe(bare()), Pipe(Map(lambda r: kv(r.key, -r.val)))).add(Drain()).run(spark).result


@query(SQL["rbk_window_expr_4"])
def stream_window_expr_4(spark, d):
    return streamed(spark, d).add(ReduceByKey(lambda a, b: a * 3 + b).window(4)).add(Drain()).run(spark).result


@query(f"SELECT key, string_agg(cast(val AS VARCHAR), ',' ORDER BY seq) AS val FROM (SELECT *, (row_number() OVER (PARTITION BY key ORDER BY seq) - 1) // 5 AS w FROM {_PAIRS}) GROUP BY key, w")
def stream_window_concat_5(spark, d):
    lists = streamed(spark, d).add(Map(lambda r: [*kv(r.key, F.array(r.val)), r.seq])).add(ReduceByKey("concat").window(5))
    return lists.add(Map(lambda r: kv(r.key, F.array_join(r.val, ",")))).add(Drain()).run(spark).result


@query(f"SELECT key, val + 1 AS val FROM {_PAIRS} WHERE val > 0")
def stream_map_filter(spark, d):
    return streamed(spark, d).add(Filter(lambda r: r.val > 0)).add(Map(lambda r: kv(r.key, r.val + 1))).add(Drain()).run(spark).result


@query(
    "SELECT * FROM (VALUES ('ReadTable', 'Map', ''), ('Map', 'ReduceByKey', ''), ('Map', 'Filter', ''), ('Filter', 'Merge', ''), ('ReadTable', 'Merge', ''), ('ReduceByKey', 'Merge', ''), ('Merge', 'Map', ''), ('Map', 'Map', 'again')) t(source, target, label)"
)
def pipe_graph(spark, d):
    two = pairs(d).to(Pipe(ReduceByKey("max")), Pipe(Filter(lambda r: r.val > 0)))
    return edges_of(spark, Graph(two.merge(table(d, "nation")).to(Pipe(bare()).iterate(2))))


@query("SELECT cast(n_nationkey % 7 AS BIGINT) AS key, cast(sum(n_regionkey) AS BIGINT) AS val FROM nation GROUP BY 1")
def parallelism(spark, d):
    keyed = Map(lambda r: kv((r.n_nationkey % 7).cast("bigint"), r.n_regionkey.cast("bigint"))).par(4)
    return table(d, "nation", "n_nationkey", "n_regionkey").add(keyed).add(ReduceByKey("sum").par(2))


def edges_of(spark: SparkSession, g: Graph) -> DataFrame:
    return spark.createDataFrame([(g.nodes[a], g.nodes[b], x) for a, b, x in g.edges], "source string, target string, label string")


@query()
def semantic_graph(spark, d):
    g = Graph(pairs(d).add(bare()).to(Pipe().pair_with(users(d).merge(users(d)), _Named()).iterate(2)))
    return edges_of(spark, g)


class _Named(BinaryOperator):
    """For the graph alone."""

    label = "JoinFlatMapByKey"
