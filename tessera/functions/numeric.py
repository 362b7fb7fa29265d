"""Distributions by mean and sd, folded normals, roots and curves. Functions of numpy arrays; as_column() makes one a column function."""

from __future__ import annotations

from collections.abc import Callable
from math import erf, exp, inf, lgamma, log, pi, sqrt

import numpy as np
import pandas as pd

from pyspark.sql import Column, functions as F


def as_column(f: Callable[..., np.ndarray], *cols: Column) -> Column:
    """f over columns as doubles, in Arrow batches; null where any is null."""

    @F.pandas_udf("double")
    def call(*xs: pd.Series) -> pd.Series:
        rows = np.column_stack([x.to_numpy(float) for x in xs])
        ok = ~np.isnan(rows).any(1)
        out = np.full(len(rows), np.nan)
        if ok.any():
            out[ok] = f(*rows[ok].T)
        return pd.Series(out).where(ok, None)

    return call(*cols)


# parameters from mean and sd


def shape_of(name: str, mean: float, sd: float) -> dict[str, float]:
    """The usual parameters of a distribution with this mean and sd; an error where there is none."""
    v = sd * sd
    if name == "norm":
        return {"mean": mean, "sd": sd}
    if name == "pois":
        return {"rate": mean}
    if name == "exp":
        return {"rate": 1 / mean}
    if name == "gamma" and mean > 0:
        return {"shape": mean * mean / v, "scale": v / mean}
    if name == "beta" and 0 < mean < 1 and v < mean * (1 - mean):
        k = mean * (1 - mean) / v - 1
        return {"a": mean * k, "b": (1 - mean) * k}
    if name == "nbinom" and v > mean > 0:
        return {"size": mean * mean / (v - mean), "prob": mean / v}
    if name == "binom" and 0 < v < mean:
        p = 1 - v / mean
        return {"size": float(round(mean / p)), "prob": p}
    raise ValueError(f"no {name} distribution of mean {mean} and sd {sd}")


def _choose(n: float, k: float) -> float:
    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)


def log_density(name: str, x: np.ndarray, mean: float, sd: float) -> np.ndarray:
    p = shape_of(name, mean, sd)

    def one(v: float) -> float:
        if name == "norm":
            return -0.5 * ((v - mean) / sd) ** 2 - log(sd * sqrt(2 * pi))
        if v < 0 or (name in ("pois", "nbinom", "binom") and v != int(v)):
            return -inf
        if name == "exp":
            return log(p["rate"]) - p["rate"] * v
        if name == "pois":
            return v * log(p["rate"]) - p["rate"] - lgamma(v + 1)
        if name == "gamma":
            return (p["shape"] - 1) * log(v) - v / p["scale"] - lgamma(p["shape"]) - p["shape"] * log(p["scale"]) if v > 0 else -inf
        if name == "beta":
            return (p["a"] - 1) * log(v) + (p["b"] - 1) * log(1 - v) + lgamma(p["a"] + p["b"]) - lgamma(p["a"]) - lgamma(p["b"]) if 0 < v < 1 else -inf
        if name == "nbinom":
            return lgamma(v + p["size"]) - lgamma(p["size"]) - lgamma(v + 1) + p["size"] * log(p["prob"]) + v * log(1 - p["prob"])
        return _choose(p["size"], v) + v * log(p["prob"]) + (p["size"] - v) * log(1 - p["prob"]) if v <= p["size"] else -inf

    return np.array([one(float(v)) for v in np.ravel(x)])


def density(name: str, x: np.ndarray, mean: float, sd: float) -> np.ndarray:
    return np.exp(log_density(name, x, mean, sd))


def _lower_gamma(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function: a power series."""
    if x <= 0:
        return 0.0
    if x > a + 60 + 12 * sqrt(a):
        return 1.0
    term = total = 1 / a
    k = a
    while term > 1e-17 * total:
        k += 1
        term *= x / k
        total += term
    return min(1.0, total * exp(a * log(x) - x - lgamma(a)))


def _lower_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function: a series in x, from the side on which it converges faster."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _lower_beta(b, a, 1 - x)
    # x^a (1-x)^b / (a B(a, b)) * sum of products (a + b + k - 1) / (a + k) x
    term = total = 1.0
    k = 0
    while term > 1e-17 * total and k < 100_000:
        k += 1
        term *= (a + b + k - 1) / (a + k) * x
        total += term
    return min(1.0, total * exp(a * log(x) + b * log(1 - x) - log(a) - lgamma(a) - lgamma(b) + lgamma(a + b)))


def cumulative(name: str, x: np.ndarray, mean: float, sd: float) -> np.ndarray:
    p = shape_of(name, mean, sd)

    def one(v: float) -> float:
        if name == "norm":
            return 0.5 * (1 + erf((v - mean) / (sd * sqrt(2))))
        if v < 0:
            return 0.0
        if name == "exp":
            return 1 - exp(-p["rate"] * v)
        if name == "gamma":
            return _lower_gamma(p["shape"], v / p["scale"])
        if name == "beta":
            return _lower_beta(p["a"], p["b"], v)
        if name == "pois":
            return 1 - _lower_gamma(np.floor(v) + 1, p["rate"])
        if name == "nbinom":
            return _lower_beta(p["size"], np.floor(v) + 1, p["prob"])
        return 1.0 if v >= p["size"] else 1 - _lower_beta(np.floor(v) + 1, p["size"] - np.floor(v), p["prob"])

    return np.array([one(float(v)) for v in np.ravel(x)])


def draw(name: str, n: int, mean: float, sd: float, seed: int) -> np.ndarray:
    p, r = shape_of(name, mean, sd), np.random.default_rng(seed)
    if name == "norm":
        return r.normal(mean, sd, n)
    if name == "exp":
        return r.exponential(mean, n)
    if name == "pois":
        return r.poisson(mean, n).astype(float)
    if name == "gamma":
        return r.gamma(p["shape"], p["scale"], n)
    if name == "beta":
        return r.beta(p["a"], p["b"], n)
    if name == "nbinom":
        return r.negative_binomial(p["size"], p["prob"], n).astype(float)
    return r.binomial(int(p["size"]), p["prob"], n).astype(float)


def two_sided(z: np.ndarray) -> np.ndarray:
    """Chance of a normal deviate as far out as z, on either side."""
    return np.array([2 * cumulative("norm", np.array([-abs(v)]), 0.0, 1.0)[0] for v in np.ravel(z)])


# folded normals


def fold(mean: float, sd: float) -> tuple[float, float]:
    """Mean and sd of the absolute value of a normal deviate."""
    m = mean * erf(mean / (sqrt(2) * sd)) + sd * sqrt(2 / pi) * exp(-(mean**2) / (2 * sd**2))
    return m, sqrt(max(0.0, mean**2 + sd**2 - m**2))


def unfold(mean: float, sd: float, tol: float = 1e-3, most: int = 500) -> tuple[float, float]:
    """The normal deviate whose absolute value has this mean and sd: its second moment is known, so the mean is the root of one increasing function."""
    second = mean**2 + sd**2
    low, high = 0.0, sqrt(second)
    for _ in range(most):
        mid = (low + high) / 2
        if fold(mid, sqrt(max(second - mid**2, 1e-300)))[0] < mean:
            low = mid
        else:
            high = mid
        if high - low <= tol * 1e-3:
            break
    return (low + high) / 2, sqrt(max(0.0, second - ((low + high) / 2) ** 2))


# roots and curves


def root(f: Callable[[float], float], low: float, high: float, tol: float = 1e-9, plateau: bool = False) -> float | tuple[float, float]:
    """Where a monotone function changes sign, by halving; with plateau, both ends of the stretch on which it is 0."""
    a, b = f(low), f(high)
    if a * b > 0:
        raise ValueError("the function has one sign at both ends")
    rising = a < b

    def edge(before: Callable[[float], bool]) -> float:
        lo, hi = low, high
        while hi - lo > tol:
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if before(f(mid)) else (lo, mid)
        return (lo + hi) / 2

    left = edge((lambda v: v < 0) if rising else (lambda v: v > 0))
    if not plateau:
        return left
    return left, edge((lambda v: v <= 0) if rising else (lambda v: v >= 0))


def loess(x: np.ndarray, y: np.ndarray, at: np.ndarray, span: float = 0.75) -> np.ndarray:
    """Local straight lines with tricube weights over the nearest span of the points."""
    k = max(3, int(np.ceil(span * len(x))))
    out = np.empty(len(at))
    for i, v in enumerate(at):
        d = np.abs(x - v)
        h = max(np.partition(d, min(k, len(d)) - 1)[min(k, len(d)) - 1], 1e-12)
        w = (1 - (d / h).clip(0, 1) ** 3) ** 3
        b = np.column_stack([np.ones_like(x), x - v])
        out[i] = np.linalg.lstsq(b.T * w @ b, b.T * w @ y, rcond=None)[0][0]
    return out


def kalman(y: np.ndarray, q: float, r: float) -> np.ndarray:
    """A level that wanders with variance q, seen with variance r: filtered forward, then smoothed backward. Missing values are passed over."""
    n = len(y)
    m, p, mp, pp = (np.empty(n) for _ in range(4))
    level, var = float(np.nanmean(y)) if n else 0.0, r * 1e3
    for k in range(n):
        mp[k], pp[k] = level, var + q
        gain = 0.0 if np.isnan(y[k]) else pp[k] / (pp[k] + r)
        level = mp[k] if np.isnan(y[k]) else mp[k] + gain * (y[k] - mp[k])
        var = (1 - gain) * pp[k]
        m[k], p[k] = level, var
    for k in range(n - 2, -1, -1):
        m[k] += p[k] / pp[k + 1] * (m[k + 1] - mp[k + 1])
    return m


def change_points(y: np.ndarray, p0: float = 0.01, draws: int = 200, seed: int = 0) -> np.ndarray:
    """Chance of a change after each place, by sampling partitions in turn: the evidence of a block is that of its values about their mean, and a change has prior p0."""
    n, r = len(y), np.random.default_rng(seed)
    if n < 2:
        return np.zeros(max(0, n - 1))
    s1, s2 = np.concatenate([[0], np.cumsum(y)]), np.concatenate([[0], np.cumsum(y * y)])
    noise = max(float(np.var(np.diff(y)) / 2), 1e-12)

    def cost(i: int, j: int) -> float:
        return (s2[j] - s2[i] - (s1[j] - s1[i]) ** 2 / (j - i)) / (2 * noise) + 0.5 * log(j - i)

    cut, hits = np.zeros(n - 1, bool), np.zeros(n - 1)
    for d in range(draws):
        ends = [0, *(np.flatnonzero(cut) + 1).tolist(), n]
        for k in range(n - 1):
            at = k + 1
            lo = max(e for e in ends if e < at)
            hi = min(e for e in ends if e > at)
            odds = log(p0 / (1 - p0)) + cost(lo, hi) - cost(lo, at) - cost(at, hi)
            on = r.random() < 1 / (1 + exp(-max(-500.0, min(500.0, odds))))
            if on != cut[k]:
                cut[k] = on
                ends = [0, *(np.flatnonzero(cut) + 1).tolist(), n]
        if d >= draws // 4:
            hits += cut
    return hits / (draws - draws // 4)
