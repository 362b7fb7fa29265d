"""What operators shuffle, hold and step through follows their input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import hmm, intervals as iv, tables, tiles

MODEL = hmm.Hmm.new([{"mean": 0.0, "sd": 1.0}, {"mean": 3.0, "sd": 1.5}, {"mean": -2.0, "sd": 0.5}], [0.1, 1e-9, 0.3])


@pytest.mark.parametrize("n", [1, 2, 1023, 1024, 1025, 1026, 4097])
def test_blocks_of_a_long_sequence_are_as_its_steps(monkeypatch, n):
    r = np.random.Generator(np.random.PCG64(n))
    x = r.normal(r.integers(-2, 4), 2, n)
    x[n // 2] = np.nan
    got = hmm._expect(MODEL, x), hmm.backward(MODEL, x)
    monkeypatch.setattr(hmm, "LONG", 1 << 40)
    want = hmm._expect(MODEL, x), hmm.backward(MODEL, x)
    assert all(np.allclose(g, w, rtol=1e-9, atol=1e-9) for g, w in zip((*got[0], got[1]), (*want[0], want[1]), strict=True))


def test_steps_of_a_long_sequence_grow_by_its_root(monkeypatch):
    calls, plain = [], hmm._lse
    monkeypatch.setattr(hmm, "_lse", lambda x, axis: calls.append(1) or plain(x, axis))
    hmm._expect(MODEL, np.zeros(40_000))
    assert len(calls) < 2_000


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_running_figures_shuffle_rows_once(spark):
    rows = tiles.tiled(spark.range(10).select((F.col("id") % 2).alias("chr"), "id"), "id")
    out = tiles.running(rows, ["chr"], ["id"], {"upto": ("sum", F.col("id"))}, after={"next": ("min", F.col("id"))})
    assert "Join" not in _plan(out) and _plan(out).count("Exchange hashpartitioning") <= 3
    assert {(r.chr, r.id, r.upto, r.next) for r in out.collect()} == {(k % 2, k, sum(range(k % 2, k + 1, 2)), k) for k in range(10)}


def test_a_row_stands_in_few_bins(spark):
    a = spark.range(5000).select(F.lit(1).alias("chr"), (F.col("id") * 7).alias("from"), (F.col("id") * 7 + F.col("id") % 50).alias("to"), "id")
    assert iv._levels(a, a, None).count() < 1.3 * a.count()


def test_quantiles_of_repeated_values_hold_each_once(spark):
    df = spark.range(9000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 4 == 0, 1.0).otherwise(F.col("id") % 7).alias("v"))
    plan = _plan(tables.trimmed_mean(df, ["g"], "v"))
    assert plan.count("HashAggregate") + plan.count("Sort ") < 60
    assert tables._counted(df, ["g"], "v").count() == 21
    for r in tables.trimmed_mean(df, ["g"], "v", 0.2, 0.7).collect():
        x = np.array([1.0 if i % 4 == 0 else i % 7 for i in range(9000) if i % 3 == r.g], float)
        lo, hi = np.quantile(x, [0.2, 0.7])
        assert abs(r["mean"] - x[(x >= lo) & (x <= hi)].mean()) < 1e-9
