"""Applications: word count, page rank, stock pricing and stock tweets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions.kernels import damped, length_with_blanks, only_name, shares, tokens, variance
from .functions.pricing import binomial_call, black_scholes, difference_call
from .operators import FlatMap, JoinFlatMapByKey, Map, ReduceByKey, Row, kv, pair
from .operators.elements import Filter
from .plans.pipe import Pipe


def word_count(column: str = "value") -> Pipe:
    """Text records to (word, count)."""
    return Pipe(FlatMap(lambda r: F.transform(tokens(r[column]), lambda w: pair(w, F.lit(1).cast("bigint"))))).add(ReduceByKey("sum"))


def links(src: str = "src", dst: str = "dst") -> Pipe:
    """Edges to (node, its targets)."""
    return Pipe(Map(lambda r: kv(r[src], F.array(r[dst])))).add(ReduceByKey("concat"))


def parsed_edges() -> Pipe:
    """Lines of two node numbers, parted by white space, to (src, dst); other lines give none."""
    parts = lambda r: F.split(F.trim(r.value), r"\s+")
    node = lambda r, k: F.get(parts(r), k).try_cast("bigint")
    return Pipe(Map(lambda r: {"src": node(r, 0), "dst": node(r, 1)})).add(Filter(lambda r: r.src.isNotNull() & r.dst.isNotNull()))


def page_rank(nodes: int, targets: Pipe, rounds: int = 10) -> Pipe:
    """Node records (column node) to (node, rank). `targets`: a pipe without input that gives (node, its targets). A node
    that nothing links to loses its rank in the first round, and the rank of one without targets goes nowhere."""
    start = Pipe(Map(lambda r: kv(r.node, F.lit(1.0))))
    step = Pipe().pair_with(targets, JoinFlatMapByKey(lambda key, rank, to: shares(rank, to))).add(ReduceByKey("sum")).add(Map(lambda r: kv(r.key, damped(r.val, nodes))))
    return start.to(step.iterate(rounds))


def parsed_options() -> Pipe:
    """Lines of ten fields, parted by white space, to options; a field that is no number is null."""
    names = ("s", "strike", "r", "divq", "v", "t", "kind", "divs", "reference")

    def fields(r: Row) -> list[Column]:
        f = F.split(F.trim(r.value), r"\s+")
        return [F.get(f, 0).alias("name"), *[(F.get(f, k) if n == "kind" else F.get(f, k).try_cast("double")).alias(n) for k, n in enumerate(names, 1)]]

    return Pipe(Map(fields))


def option_price(r: Row) -> Column:
    return black_scholes(r.s, r.strike, r.r, r.v, r.t, r.kind == "P")


def stock_pricing() -> Pipe:
    """Options (name, s, strike, r, v, t, kind) to (name, highest price)."""
    return Pipe(Map(lambda r: kv(r.name, option_price(r)))).add(ReduceByKey("max"))


def stock_pricing_windowed(size: int = 8, order_by: str = "seq") -> Pipe:
    """Options with an order to (name, highest variance of three ways to price a call) over count windows."""
    three = lambda r: [f(r.s, r.strike, r.r, r.v, r.t) for f in (lambda *x: black_scholes(*x, F.lit(False)), binomial_call, difference_call)]
    return Pipe(Map(lambda r: [*kv(r.name, variance(*three(r))), r[order_by]])).add(ReduceByKey("max").window(size, order_by))


def stock_tweets(names: list[str], size: int = 8, column: str = "value", order_by: str = "seq") -> Pipe:
    """Texts with an order to (name, greatest length) over count windows, of texts that name just one stock."""
    found = lambda r: [*kv(only_name(tokens(r[column]), names), length_with_blanks(tokens(r[column]))), r[order_by]]
    return Pipe(Map(found)).add(Filter(lambda r: r.key.isNotNull())).add(ReduceByKey("max").window(size, order_by))
