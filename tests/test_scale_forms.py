"""Forms that spread a computation over tasks give what the plain ones give."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import maps
from tessera.operators import alleles, coverage, hmm, tables


@pytest.mark.parametrize("q", [0.0, 0.01, 0.5, 0.77, 1.0])
def test_quantiles_are_exact(spark, q):
    r = random.Random(3)
    data = [(g, r.choice([r.random() * 10**k, 5.0, -3.0, None])) for g in "abc" for k in range(6) for _ in range(r.randint(1, 60))] + [("lonely", 2.5), ("none", None)]
    df = spark.createDataFrame(data, "g string, v double").repartition(3)
    want = {g: np.quantile([v for h, v in data if h == g and v is not None], q) for g in ("a", "b", "c", "lonely")}
    got = {x.g: x["quantile"] for x in tables.quantile(df, ["g"], "v", q).collect()}
    assert set(got) == set(want) and all(abs(got[g] - want[g]) <= 1e-9 * max(1, abs(want[g])) for g in want)
    if q in (0.5, 1.0):
        whole = tables.quantile(df, [], "v", q).collect()
        assert len(whole) == 1 and abs(whole[0]["quantile"] - np.quantile([v for _, v in data if v is not None], q)) < 1e-9
        assert tables.quantile(df.limit(0), [], "v", q).count() == 0


def test_histograms_are_of_bounded_size_and_exact_for_whole_numbers(spark):
    df = spark.range(30_000).select((F.col("id") % 700 + 1).cast("double").alias("c"), (F.rand(3) * 1000).alias("x"))
    h = coverage.histogram(df, "c")
    x = np.array([r.c for r in df.select("c").collect()])
    assert h.total == 30_000 and len(h.v) == 700 and h.quantile(0.3) == np.quantile(x, 0.3) and abs(h.sd() - x.std()) < 1e-9
    assert all(np.allclose(a, b) for a, b in zip(coverage.density(h), coverage.density(x)))
    assert len(coverage.histogram(df, "x").v) < 9000 * 5
    assert coverage.band(df.limit(0), "c", "median") == (0.0, 0.0)


def test_sequences_decoded_together_are_as_each_alone(spark):
    model = hmm.Hmm.new([{"mean": 0.0, "sd": 1.0}, {"mean": 3.0, "sd": 1.5}, {"mean": -2.0, "sd": 0.5}], 0.15)
    r = np.random.Generator(np.random.PCG64(4))
    seqs = [r.normal(r.integers(-2, 4), 1.5, n) for n in (1, 40, 3, 200, 3, 17)]
    x, starts = np.concatenate(seqs), np.cumsum([0, *map(len, seqs[:-1])])
    assert hmm.viterbi_many(model, x, starts).tolist() == [s for q in seqs for s in hmm.viterbi(model, q).tolist()]
    assert np.allclose(hmm.forward_many(model, x, starts), [hmm.forward(model, q)[1] for q in seqs])
    rows = [(k if k != 2 else None, j, float(v)) for k, q in enumerate(seqs) for j, v in enumerate(q)]
    df = spark.createDataFrame(rows, "k long, j long, v double").repartition(5)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        got = {(r.k, r.j): r.state for r in hmm.decode(df, ["k"], "j", "v", model).collect()}
        likely = {r.k: (r.loglike, r.n) for r in hmm.log_likelihoods(df, ["k"], "j", "v", model).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    for k, q in enumerate(seqs):
        key = k if k != 2 else None
        assert [got[key, j] for j in range(len(q))] == (hmm.viterbi(model, q) + 1).tolist()
        assert likely[key][1] == len(q) and abs(likely[key][0] - hmm.forward(model, q)[1]) < 1e-9
    assert hmm.decode(df.limit(0), ["k"], "j", "v", model).count() == 0


def test_sorted_reads_stream_into_counts(spark, tmp_path):
    from tessera.streaming.depth import sorted_pileup

    schema = "chr int, pos long, cigar string, seq string, qual string, mapq int"
    reads = [(1, 10 * k, "3M1D2M", "acgta", "IIIII", 30) for k in range(1, 30)]
    for part in range(3):
        spark.createDataFrame(reads[part * 10 : part * 10 + 10], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = sorted_pileup(stream, 6, 20, 20).writeStream.format("memory").queryName("piled").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    want = {tuple(r) for r in alleles.pileup(spark.createDataFrame(reads, schema), 20, 20).collect()}
    got = {tuple(r) for r in spark.table("piled").collect()}
    assert got <= want and {r for r in want if r[1] < 280} <= got


def test_triangles_and_maps(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], {"a": 1, "b": 2}, {"b": 5, "c": 6})], "v array<double>, m map<string,int>, o map<string,int>")
    m = maps.from_upper(F.col("v"), 3)
    r = df.select(m.alias("m"), maps.to_upper(m, 3).alias("u"), maps.mixin(F.col("m"), F.col("o")).alias("x")).first()
    assert r.m == [[None, 1.0, 2.0], [1.0, None, 3.0], [2.0, 3.0, None]] and r.u == [1.0, 2.0, 3.0] and r.x == {"a": 1, "b": 5}
    assert tables.two_sided.__name__ and abs(df.select(tables.two_sided(F.lit(1.959964)).alias("p")).first().p - 0.05) < 1e-6
    with pytest.raises(ValueError):
        tables.objective("none", "a", "b")
