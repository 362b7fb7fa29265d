import importlib

import oracle
import pytest

import __spark_entry__
from tessera.plans import catalogue

for name in __spark_entry__.CORE:
    importlib.import_module(f"tessera.plans.{name}")

pytestmark = pytest.mark.skipif(not oracle.present(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_is_as_its_sql(spark, con, name):
    oracle.same(con, catalogue.SQL[name], catalogue.QUERIES[name](spark, oracle.DATA))


@pytest.mark.parametrize("name", sorted({*catalogue.QUERIES} - {*catalogue.SQL}))
def test_query_without_sql_gives_rows(spark, name):
    assert catalogue.QUERIES[name](spark, oracle.DATA).count() > 0


def _sequences(df, by, order, value):
    out = {}
    for r in sorted(df.select(by, order, value).collect()):
        out.setdefault(r[0], []).append(r)
    return out


def test_models_without_sql_are_as_by_hand(spark):
    import numpy as np

    from tessera.operators import coverage, hmm, ordered
    from tessera.plans import model_queries, ordered_queries
    from tessera.plans.adapters import points

    run = lambda name: catalogue.QUERIES[name](spark, oracle.DATA).collect()
    daily = _sequences(ordered_queries._daily(spark, oracle.DATA), "chr", "day", "n")
    smooth = {(r.chr, r.day): r.smooth for r in run("smooth_median")}
    for c, rows in daily.items():
        want = ordered.smooth_median(np.array([r.n for r in rows], float), (3, 5))
        assert np.allclose([smooth[c, r.day] for r in rows], want)
    x = np.array([r.n for rows in daily.values() for r in rows], float)
    lo, hi = (f(g) for f, g in zip((max, min), zip(coverage._poisson(coverage.Histogram(x), 2.0), coverage._median(coverage.Histogram(x), 3.0))))
    assert sorted((r.chr, r.day) for r in run("cover_band_poisson")) == sorted((c, r.day) for c, rows in daily.items() for r in rows if lo <= r.n <= hi)
    values = _sequences(points(spark, oracle.DATA), "chr", "id", "value")
    fits, bics = {(r.chr, r.state): (r["mean"], r.sd) for r in run("hmm_fit")}, {r.chr: (r.loglike, r.bic) for r in run("hmm_bic")}
    for c in sorted(values)[:4]:
        h = hmm.fit(model_queries.MODEL, [np.array([r.value for r in values[c]], float)], most=20)
        assert np.allclose([fits[c, k + 1] for k in range(len(h.params))], [(p["mean"], p["sd"]) for p in h.params])
        assert np.allclose(bics[c], (h.loglike, hmm.bic(h, h.loglike, len(values[c]))))
    drawn, user = {r.id: r.drawn for r in run("regularise_gaussian")}, {}
    for r in points(spark, oracle.DATA).collect():
        user.setdefault(r.user_id, []).append(r)
    spread = [(drawn[r.id] - np.mean([q.value for q in rows])) / np.std([q.value for q in rows], ddof=1) for rows in user.values() if len(rows) > 5 for r in rows]
    assert abs(np.mean(spread)) < 0.1 and abs(np.std(spread) - 1) < 0.1


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
