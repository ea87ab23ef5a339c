"""Applications against sequential models."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirflow.apps import links, page_rank, parsed_edges, parsed_options, stock_pricing, stock_pricing_windowed, stock_tweets, word_count
from weirflow.functions.pricing import binomial_call, black_scholes, difference_call_values
from weirflow.plans.pipe import Frame, Pipe


def lined(spark, *lines):
    return Pipe(Frame(spark.createDataFrame([(x,) for x in lines], "value string")))


def pairs(df):
    return {r.key: r.val for r in df.collect()}


def test_word_count(spark):
    out = pairs(lined(spark, "a b a", "b  ", "").to(word_count()).compile(spark))
    assert out == Counter("a b a b".split()) + Counter({"": 1})


def ranks(edges, nodes, rounds):
    targets = defaultdict(list)
    for a, b in edges:
        targets[a].append(b)
    rank = dict.fromkeys(nodes, 1.0)
    for _ in range(rounds):
        new = defaultdict(float)
        for n, r in rank.items():
            for t in targets[n]:
                new[t] += r / len(targets[n])
        rank = {n: 0.85 * s + 0.15 / len(nodes) for n, s in new.items()}
    return rank


def test_page_rank(spark):
    text = ["1 2", "1 3", "2  3", "3 1", "4 1", "5\t4", "x 1", "7", ""]
    edges = lined(spark, *text).to(parsed_edges())
    nodes = Pipe(Frame(spark.createDataFrame([(i,) for i in range(1, 6)], "node long")))
    got = pairs(nodes.to(page_rank(5, edges.to(links()), 7)).compile(spark))
    want = ranks([(1, 2), (1, 3), (2, 3), (3, 1), (4, 1), (5, 4)], range(1, 6), 7)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)
    assert 5 not in got  # nothing links to it


def normal(x):
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def exact(s, k, r, v, t, put=False):
    d1 = (math.log(s / k) + (r + v * v / 2) * t) / (v * math.sqrt(t))
    d2 = d1 - v * math.sqrt(t)
    call = s * normal(d1) - k * math.exp(-r * t) * normal(d2)
    return call - s + k * math.exp(-r * t) if put else call


OPTIONS = [(42.0, 40.0, 0.1, 0.2, 0.5), (100.0, 120.0, 0.05, 0.3, 1.0), (50.0, 50.0, 0.01, 0.15, 0.25), (100.0, 40.0, 0.03, 0.25, 1.0)]


@pytest.mark.parametrize("option", OPTIONS)
def test_pricers(spark, option):
    lits = [F.lit(x) for x in option]
    r = spark.range(1).select(black_scholes(*lits, F.lit(False)).alias("call"), black_scholes(*lits, F.lit(True)).alias("put"), binomial_call(*lits).alias("tree")).first()
    assert math.isclose(r.call, exact(*option), abs_tol=1e-4)
    assert math.isclose(r.put, exact(*option, put=True), abs_tol=1e-4)
    assert math.isclose(r.tree, exact(*option), rel_tol=0.06)
    by_grid = difference_call_values(*(np.array([x]) for x in option))[0]
    assert math.isclose(by_grid, exact(*option), rel_tol=0.03)


def test_difference_prices_of_none():
    assert len(difference_call_values(*[np.zeros(0)] * 5)) == 0


def test_stock_pricing(spark):
    text = [f"{n} {s} {k} {r} 0.0 {v} {t} {kind} 0.0 0.0" for n, (s, k, r, v, t), kind in zip("aabb", OPTIONS, "CPCP", strict=True)]
    got = pairs(lined(spark, *text).to(parsed_options()).to(stock_pricing()).compile(spark))
    price = [exact(*o, put=kind == "P") for o, kind in zip(OPTIONS, "CPCP", strict=True)]
    assert math.isclose(got["a"], max(price[:2]), abs_tol=1e-3) and math.isclose(got["b"], max(price[2:]), abs_tol=1e-3)


def test_stock_pricing_in_windows(spark):
    columns = "name string, s double, strike double, r double, v double, t double, seq long"
    df = spark.createDataFrame([("a", *OPTIONS[i % 4], i) for i in range(5)], columns)
    out = [r.val for r in Pipe(Frame(df)).to(stock_pricing_windowed(2)).compile(spark).collect()]
    lits = lambda o: [F.lit(x) for x in o]
    three = []
    for o in OPTIONS:
        r = spark.range(1).select(black_scholes(*lits(o), F.lit(False)).alias("a"), binomial_call(*lits(o)).alias("b")).first()
        three.append(float(np.var([r.a, r.b, difference_call_values(*(np.array([x]) for x in o))[0]])))
    each = [three[i % 4] for i in range(5)]
    # A window's options share a grid's steps in time, so that prices differ a little.
    assert np.allclose(sorted(out), sorted([max(each[:2]), max(each[2:4]), each[4]]), rtol=0.15, atol=0.02)


def test_stock_tweets(spark):
    text = ["AA is up", "AA AA", "BB down", "AA BB", "none", "", "AA"]
    df = spark.createDataFrame([(x, i) for i, x in enumerate(text)], "value string, seq long")
    got = sorted((r.key, r.val) for r in Pipe(Frame(df)).to(stock_tweets(["AA", "BB"], 2)).compile(spark).collect())
    assert got == [("AA", 3), ("AA", 9), ("BB", 8)]
