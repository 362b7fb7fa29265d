"""Coverage against base composition, coverage bands, and correction by ratio."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

from pyspark.sql import DataFrame, functions as F

from tessera.operators import tables
from tessera.runtime import cut

LEVELS = 1000
#: Width of the curve that histograms are smoothed to.
POINTS = 1024


def aggregate(df: DataFrame, gc: str, cov: str) -> DataFrame:
    """Mean coverage and number of bins by gc in thousandths, rounded half to even: as many rows as thousandths."""
    return df.where(F.col(gc).isNotNull() & F.col(cov).isNotNull()).groupBy(F.bround(F.col(gc) * LEVELS).cast("int").alias("gc")).agg(F.avg(cov).alias("cov"), F.count("*").alias("n"))


def spline(x: np.ndarray, y: np.ndarray, w: np.ndarray, at: np.ndarray, knots: int = 20) -> np.ndarray:
    """A penalised cubic spline, its penalty chosen by generalised cross-validation."""
    inner = np.linspace(x.min(), x.max(), knots)
    width = max(1e-9, x.max() - x.min())

    def basis(v: np.ndarray) -> np.ndarray:
        v = (v - x.min()) / width
        return np.column_stack([np.ones_like(v), v, v * v, v**3, *(((v - (k - x.min()) / width).clip(0)) ** 3 for k in inner[1:-1])])

    b, d = basis(x), np.diag([0.0] * 4 + [1.0] * (knots - 2))
    gram, right, best = b.T * w @ b, b.T * w @ y, (np.inf, None)
    for lam in 10.0 ** np.arange(-6, 5):
        a = gram + lam * d
        beta = np.linalg.lstsq(a, right, rcond=None)[0]
        dof = np.trace(np.linalg.lstsq(a, gram, rcond=None)[0])
        score = len(x) * (w * (y - b @ beta) ** 2).sum() / max(1e-9, len(x) - dof) ** 2
        if score < best[0]:
            best = (score, beta)
    return basis(at) @ best[1]


def gc_model(points: list[tuple[int, float, int]], base_quantile: float = 0.0) -> np.ndarray:
    """Predicted coverage for each thousandth of gc, from aggregate's rows; the median where too few levels are known. Both ends are held at a
    baseline, below which no value falls; the cap is five times the median."""
    pts = sorted(p for p in points if p[1] is not None)
    if len(pts) < 4:
        return np.full(LEVELS + 1, float(np.median([c for _, c, _ in pts])) if pts else 1.0)
    gc, cov, n = (np.array(v, float) for v in zip(*pts))
    base = float(np.quantile(cov, base_quantile)) if base_quantile > 0 else 1.0
    x, y, w = np.concatenate([[0], gc, [LEVELS]]), np.concatenate([[base], cov, [base]]), np.concatenate([[n.max()], n, [n.max()]])
    return spline(x, y, w, np.arange(LEVELS + 1)).clip(base, max(base, 5 * float(np.median(cov))))


def correct(df: DataFrame, model: np.ndarray, gc: str, cov: str) -> DataFrame:
    """Adds pred (the model at the row's gc), rrc_raw (coverage over its median) and rrc_cor (coverage over pred). The lookup is an array of LEVELS + 1 numbers."""
    table = F.array(*[F.lit(float(v)) for v in model])
    med = tables.quantile(df, [], cov, 0.5, "_med")
    out = df.withColumn("pred", F.get(table, F.bround(F.col(gc) * LEVELS).cast("int"))).join(F.broadcast(med))
    return out.withColumn("rrc_raw", F.try_divide(F.col(cov).cast("double"), F.col("_med"))).withColumn("rrc_cor", F.try_divide(F.col(cov).cast("double"), F.col("pred"))).drop("_med")


def in_band(df: DataFrame, cov: str, lo: float, hi: float) -> DataFrame:
    """The rows whose coverage is within the limits, both included."""
    return df.where(F.col(cov).between(lo, hi))


# bands of coverage


class Histogram:
    """Values in order, and how often each occurs."""

    def __init__(self, values: np.ndarray, n: np.ndarray | None = None):
        n = np.ones(len(values)) if n is None else np.asarray(n)
        order = np.argsort(values, kind="stable")
        self.v, self.n = np.asarray(values, float)[order], n[order]
        self.upto = np.cumsum(self.n)

    @property
    def total(self) -> float:
        return float(self.upto[-1])

    def quantile(self, q: float) -> float:
        """Between the two values about the rank, linear."""
        rank = (self.total - 1) * q
        lo, hi = (self.v[np.searchsorted(self.upto, r, "right")] for r in (np.floor(rank), np.ceil(rank)))
        return float(lo + (hi - lo) * (rank - np.floor(rank)))

    def sd(self) -> float:
        mean = (self.v * self.n).sum() / self.total
        return float((((self.v - mean) ** 2 * self.n).sum() / self.total) ** 0.5)


#: Digits to which values are rounded for a histogram: whole numbers under 10,000 stay as they are.
DIGITS = 4


def histogram(df: DataFrame, value: str) -> Histogram:
    """Values rounded to DIGITS significant digits, and how often they occur: 9,000 for each power of ten at most, whatever the rows. Nulls are passed over."""
    v = F.col(value).cast("double")
    step = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(v))) - (DIGITS - 1))
    rows = df.where(v.isNotNull()).select(F.when(v == 0, 0.0).otherwise(F.round(v / step) * step).alias("v")).groupBy("v").agg(F.count("*").alias("n")).collect()
    return Histogram(np.array([r.v for r in rows]), np.array([r.n for r in rows]))


def _median(bins: Histogram, alpha: float) -> tuple[float, float]:
    m = bins.quantile(0.5)
    mad = 1.4826 * Histogram(np.abs(bins.v - m), bins.n).quantile(0.5)
    return float(np.floor(max(0.0, m - alpha * mad))), float(np.ceil(m + alpha * mad))


def density(x: np.ndarray | Histogram) -> tuple[np.ndarray, np.ndarray]:
    """A Gaussian kernel curve of POINTS points, from a histogram."""
    x = x if isinstance(x, Histogram) else Histogram(x)
    sd = x.sd() or 1.0
    q = [x.quantile(0.25), x.quantile(0.75)]
    width = 0.9 * min(sd, (q[1] - q[0]) / 1.34 or sd) * x.total**-0.2
    at = np.linspace(x.v.min() - 3 * width, x.v.max() + 3 * width, POINTS)
    count, _ = np.histogram(x.v, np.append(at, at[-1] + at[1] - at[0]), weights=x.n)
    k = np.exp(-0.5 * ((at - at[POINTS // 2]) / width) ** 2)
    return at, np.convolve(count, k / k.sum(), "same")


def _tops(bins: Histogram) -> tuple[np.ndarray, np.ndarray, list[int]]:
    at, y = density(bins)
    tops = [i for i in range(1, POINTS - 1) if y[i] > y[i - 1] and y[i] >= y[i + 1]]
    return at, y, sorted(tops, key=lambda i: -y[i]) or [int(y.argmax())]


def _poisson(bins: Histogram, alpha: float) -> tuple[float, float]:
    at, _, tops = _tops(bins)
    mode = max(0.0, float(at[tops[0]]))
    return max(0.0, mode - alpha * mode**0.5), mode + alpha * mode**0.5


def _peak(bins: Histogram, alpha: float) -> tuple[float, float]:
    at, y, tops = _tops(bins)
    slope, top = np.diff(y), tops[0]
    left = top - 1 - int(np.argmax(np.abs(slope[:top][::-1][: max(1, top)]))) if top else 0
    right = top + int(np.argmax(np.abs(slope[top:]))) if top < len(slope) else POINTS - 1
    return max(0.0, float(at[top] - alpha * (at[top] - at[max(0, left)]))), float(at[top] + alpha * (at[min(POINTS - 1, right)] - at[top]))


def _twin(bins: Histogram, alpha: float) -> tuple[float, float]:
    at, _, tops = _tops(bins)
    top, others = tops[0], sorted(tops)
    k = others.index(top)
    left, right = at[others[k - 1]] if k else at[0], at[others[k + 1]] if k + 1 < len(others) else at[-1]
    return max(0.0, float(at[top] - alpha * (at[top] - left) / 2)), float(at[top] + alpha * (right - at[top]) / 2)


BANDS: dict[str, Callable[[Histogram, float], tuple[float, float]]] = {"median": _median, "poisson": _poisson, "peak": _peak, "twin": _twin}
_TERM = re.compile(r"\s*([+-])?\s*(?:([0-9.]+)\s*\*)?\s*([a-z_]+)\s*")


def parse_band(formula: str) -> list[tuple[str, float, str]]:
    """Terms (sign, factor, model) of a formula such as `2 * poisson + median`: + takes the hull with what stands before, - the intersection."""
    out, at = [], 0
    while at < len(formula):
        m = _TERM.match(formula, at)
        if not m or m[3] not in BANDS or (out and not m[1]):
            raise ValueError(f"no band formula: {formula!r} at {at}")
        out.append((m[1] or "-", float(m[2] or 1), m[3]))
        at = m.end()
    if not out:
        raise ValueError("an empty band formula")
    return [("-", *out[0][1:]), *out[1:]]


def band(df: DataFrame, cov: str, formula: str) -> tuple[float, float]:
    """Limits of coverage by a formula. Bins of 0 are left out. The models see a histogram, of a size that doesn't grow with the rows."""
    bins = histogram(df.where(F.col(cov) > 0), cov)
    bins = bins if len(bins.v) else Histogram(np.zeros(1))
    lo, hi = -np.inf, np.inf
    for sign, alpha, name in parse_band(formula):
        a, b = BANDS[name](bins, alpha)
        lo, hi = (min(lo, a), max(hi, b)) if sign == "+" else (max(lo, a), min(hi, b))
    return lo, hi


def median_band(df: DataFrame, cov: str, alpha: float) -> DataFrame:
    """The median model's limits as one row lo, hi, by aggregates alone."""
    rows = df.where(F.col(cov) > 0)
    med = cut(tables.quantile(rows, [], cov, 0.5, "med"))  # one row
    far = rows.join(F.broadcast(med)).select(F.abs(F.col(cov) - F.col("med")).alias("far"))
    s = med.join(F.broadcast(cut(tables.quantile(far, [], "far", 0.5, "mad")))).withColumn("mad", F.col("mad") * 1.4826)
    return s.select(F.floor(F.greatest(F.lit(0.0), F.col("med") - alpha * F.col("mad"))).cast("double").alias("lo"), F.ceil(F.col("med") + alpha * F.col("mad")).cast("double").alias("hi"))


def normalise_cohort(df: DataFrame, probe: str, sample: str, depth: str, length: str, max_cv: float) -> DataFrame:
    """probe, sample, norm: depths rescaled to the same mean for each sample, probes of larger variation among samples left out, and the linear trend with
    length taken out for each sample."""
    means = df.groupBy(sample).agg(F.avg(depth).alias("_m"))
    scaled = df.join(F.broadcast(means), sample).withColumn("_d", F.try_divide(F.col(depth), F.col("_m")))
    steady = scaled.groupBy(probe).agg(F.try_divide(F.stddev_samp("_d"), F.avg("_d")).alias("_cv")).where(F.col("_cv") <= max_cv).select(probe)
    kept = scaled.join(steady, probe)
    trend = kept.groupBy(sample).agg(F.regr_slope("_d", length).alias("_b"), F.regr_intercept("_d", length).alias("_a"))
    return kept.join(F.broadcast(trend), sample).select(probe, sample, (F.col("_d") - F.col("_a") - F.col("_b") * F.col(length)).alias("norm"))
