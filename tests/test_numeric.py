import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import numeric as nm

CASES = [("norm", 2, 3), ("pois", 4, 2), ("exp", 3, 3), ("gamma", 5, 2), ("beta", 0.3, 0.1), ("nbinom", 4, 3), ("binom", 6, 2.4**0.5)]


@pytest.mark.parametrize("name,mean,sd", CASES)
def test_distributions_agree_with_their_draws(name, mean, sd):
    x = nm.draw(name, 40_000, mean, sd, 1)
    assert x.mean() == pytest.approx(mean, abs=0.06 * max(1, sd)) and x.std() == pytest.approx(sd if name != "pois" else mean**0.5, rel=0.06)
    at = np.quantile(x, [0.1, 0.4, 0.8])
    assert nm.cumulative(name, at, mean, sd) == pytest.approx([(x <= v).mean() for v in at], abs=0.012)
    if name in ("pois", "nbinom", "binom"):
        k = np.arange(0, 60)
        assert np.cumsum(nm.density(name, k, mean, sd))[::10] == pytest.approx(nm.cumulative(name, k, mean, sd)[::10], abs=1e-9)
    else:
        grid = np.linspace(at[0], at[2], 20_001)
        area = np.trapezoid(nm.density(name, grid, mean, sd), grid)
        assert area == pytest.approx(nm.cumulative(name, at[2:], mean, sd)[0] - nm.cumulative(name, at[:1], mean, sd)[0], abs=1e-6)


def test_impossible_moments_are_refused():
    for name, mean, sd in (("beta", 0.5, 0.9), ("nbinom", 4, 1), ("binom", 4, 3), ("other", 1, 1)):
        with pytest.raises(ValueError):
            nm.shape_of(name, mean, sd)


def test_folding_comes_back():
    for mean, sd in ((2.0, 1.0), (0.5, 0.4), (3.0, 0.2)):
        assert nm.unfold(*nm.fold(mean, sd)) == pytest.approx((mean, sd), abs=0.01)


def test_roots_and_curves():
    assert nm.root(lambda x: x**3 - 8, 0, 5) == pytest.approx(2, abs=1e-6)
    assert nm.root(lambda x: max(0, x - 3) + min(0, x - 1), -5, 9, plateau=True) == pytest.approx((1, 3), abs=1e-6)
    with pytest.raises(ValueError):
        nm.root(lambda x: x + 10, 0, 1)
    x = np.linspace(0, 1, 60)
    assert nm.loess(x, 3 * x + 1, np.array([0.2, 0.7]), 0.4) == pytest.approx([1.6, 3.1], abs=1e-6)
    y = np.concatenate([np.zeros(30), np.full(30, 5.0)]) + np.random.default_rng(0).normal(0, 0.3, 60)
    assert np.abs(nm.kalman(y, 0.01, 0.1)[[10, 50]] - [0, 5]).max() < 0.4
    p = nm.change_points(y)
    assert p.argmax() == 29 and p[29] > 0.9 and p[:25].max() < 0.5


def test_as_a_column(spark):
    df = spark.createDataFrame([(1.96,), (0.0,), (None,)], "z double")
    got = [r.p for r in df.select(nm.as_column(nm.two_sided, F.col("z")).alias("p")).collect()]
    assert got[0] == pytest.approx(0.05, abs=1e-4) and got[1] == pytest.approx(1) and got[2] is None
