"""Prices of European options: in closed form, by a binomial tree and by finite differences."""

from __future__ import annotations

from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of the usual five-term polynomial for the normal distribution.
NORMAL = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
INV_SQRT_2PI = 0.39894228040143270286


def normal(x: Column) -> Column:
    """The standard normal distribution function, by a polynomial in 1 / (1 + 0.2316419 |x|)."""
    k = 1.0 / (1.0 + F.abs(x) * F.lit(0.2316419))
    poly = k * (NORMAL[0] + k * (NORMAL[1] + k * (NORMAL[2] + k * (NORMAL[3] + k * NORMAL[4]))))
    tail = F.exp(-0.5 * x * x) * F.lit(INV_SQRT_2PI) * poly
    return F.when(x < 0, tail).otherwise(1.0 - tail)


def d1(s: Column, strike: Column, r: Column, v: Column, t: Column) -> Column:
    return (F.log(s / strike) + (r + v * v * 0.5) * t) / (v * F.sqrt(t))


def black_scholes(s: Column, strike: Column, r: Column, v: Column, t: Column, put: Column) -> Column:
    a = d1(s, strike, r, v, t)
    b = a - v * F.sqrt(t)
    later = strike * F.exp(-r * t)
    call = s * normal(a) - later * normal(b)
    return F.when(put, later * (1.0 - normal(b)) - s * (1.0 - normal(a))).otherwise(call)


def binomial_call(s: Column, strike: Column, r: Column, v: Column, t: Column, steps: int = 10) -> Column:
    """A European call in a tree of `steps`: the expected payoff at the leaves, discounted."""
    dt = t / steps
    up = F.exp(v * F.sqrt(dt))
    p = (F.exp(r * dt) - 1 / up) / (up - 1 / up)
    leaves = [F.lit(float(comb(steps, j))) * F.pow(p, F.lit(j)) * F.pow(1 - p, F.lit(steps - j)) * F.greatest(s * F.pow(up, F.lit(2 * j - steps)) - strike, F.lit(0.0)) for j in range(steps + 1)]
    return F.exp(-r * t) * sum(leaves[1:], leaves[0])


def difference_call_values(s: np.ndarray, strike: np.ndarray, r: np.ndarray, v: np.ndarray, t: np.ndarray, prices: int = 50) -> np.ndarray:
    """European calls by explicit finite differences, all options at once; prices up to twice the strike, and beyond that
    the boundary's value. Each option has as many steps in time as stability asks for, so its price doesn't depend on those
    beside it. An option with a null or no volatility, strike or time has a price that is no number."""
    top = 2.0 * strike
    ds = top / prices
    fit = np.isfinite(s) & np.isfinite(ds) & np.isfinite(r) & np.isfinite(v) & np.isfinite(t) & (ds > 0)
    steps = np.where(fit, np.maximum(1, np.ceil(1.05 * (prices * prices * v**2 + r) * t)), 0).astype(int)
    # Those with the most steps first: who still takes a step is at the front.
    order = np.argsort(-steps, kind="stable")
    top, ds, r, v, t, s, strike, steps = (x[order] for x in (top, ds, r, v, t, s, strike, steps))
    dt = t / np.maximum(steps, 1)
    i = np.arange(prices + 1)[None, :]
    grid = np.maximum(i * ds[:, None] - strike[:, None], 0.0)
    rr, vv, dd = r[:, None], v[:, None], dt[:, None]
    inner = i[:, 1:-1]
    a, b, c = 0.5 * dd * (vv**2 * inner**2 - rr * inner), 1 - dd * (vv**2 * inner**2 + rr), 0.5 * dd * (vv**2 * inner**2 + rr * inner)
    for n in range(1, (int(steps[0]) if len(steps) else 0) + 1):
        m = int(np.searchsorted(-steps, -n, side="right"))
        g = grid[:m]
        g[:, 1:-1] = a[:m] * g[:, :-2] + b[:m] * g[:, 1:-1] + c[:m] * g[:, 2:]
        g[:, 0] = 0.0
        g[:, -1] = top[:m] - strike[:m] * np.exp(-r[:m] * dt[:m] * n)
    ok = steps > 0
    x = np.where(ok, s, 0.0) / np.where(ok, ds, 1.0)
    k = np.clip(x.astype(int), 0, prices - 1)
    rows = np.arange(len(s))
    between = grid[rows, k] + (x - k) * (grid[rows, k + 1] - grid[rows, k])
    out = np.empty(len(s))
    out[order] = np.where(ok, np.where(s >= top, s - strike * np.exp(-r * t), between), np.nan)
    return out


def difference_call(s: Column, strike: Column, r: Column, v: Column, t: Column) -> Column:
    def price(s: pd.Series, strike: pd.Series, r: pd.Series, v: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(difference_call_values(*(x.to_numpy(float) for x in (s, strike, r, v, t))))

    return F.pandas_udf(price, "double")(s, strike, r, v, t)
