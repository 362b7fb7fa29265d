import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import dna, text
from tessera.runtime import cut
from tessera.operators import alleles, coverage, hmm, intervals as iv, ordered, ploidy, records, tables
from tessera.plans import copynumber
from tessera.sources import binary, texts


def spans(df):
    return sorted((r["chr"], r["from"], r["to"]) for r in df.collect())


def make(spark, rows):
    return spark.createDataFrame(rows, "chr long, `from` long, `to` long")


def places(rows):
    return {(c, p) for c, a, b in rows for p in range(a, b + 1)}


@pytest.fixture(scope="module")
def pair():
    r = random.Random(1)
    draw = lambda n: [(r.randint(1, 3), a, a + r.randint(0, 12)) for a in (r.randint(1, 200) for _ in range(n))]
    return draw(40), draw(30)


def test_set_algebra_is_as_on_places(spark, pair):
    a, b = pair
    x, y = make(spark, a), make(spark, b)
    for out, want in ((iv.reduce(x), places(a)), (iv.union(x, y), places(a) | places(b)), (iv.inter(x, y), places(a) & places(b)), (iv.exclude(x, y), places(a) - places(b))):
        got = spans(out)
        assert places(got) == want
        for (c, _, t), (d, f, _) in zip(got, got[1:]):
            assert c != d or f > t + 1
    assert places(spans(iv.exclude(x, y, 2))) == places(a) - places([(c, f - 2, t + 2) for c, f, t in b])


def test_joining_merges_touching_rows_and_takes_nulls(spark):
    x = make(spark, [(1, 1, 5), (1, 6, 9), (1, 12, 13), (None, 1, 2), (2, None, 3), (1, 1, 5)])
    assert spans(iv.join(x)) == [(1, 1, 9), (1, 12, 13)]
    assert spans(iv.join(x, 2)) == [(1, 1, 13)]
    assert spans(iv.join(x, 0, 3)) == [(1, 1, 9)]
    with pytest.raises(ValueError):
        iv.join(x, -1)
    empty = make(spark, [])
    assert spans(iv.reduce(empty)) == [] and spans(iv.inter(x, empty)) == [] and spans(iv.exclude(x, empty)) == [(1, 1, 9), (1, 12, 13)]


def test_overlap_nearest_and_containment(spark, pair):
    a, b = pair
    x = cut(make(spark, a).withColumn("id", F.monotonically_increasing_id()))
    y = cut(make(spark, b).withColumn("id", F.monotonically_increasing_id()))
    xs, ys = x.collect(), y.collect()
    gap = lambda p, q: max(0, q["from"] - p.to, p["from"] - q.to)
    want = {(p.id, q.id) for p in xs for q in ys if p.chr == q.chr and gap(p, q) == 0 and p["from"] <= q.to and q["from"] <= p.to}
    for bits in (None, 0, 3, 10):
        got = [(r.a_id, r.b_id) for r in iv.overlap_pairs(x, y, bits=bits).collect()]
        assert len(got) == len(want) and set(got) == want
    lists = {r.a_id: r.b_ids for r in iv.overlap(x, y).collect()}
    assert lists == {p.id: sorted(q for i, q in want if i == p.id) for p in xs}
    near = {r.a_id: (r.distance, r.ties) for r in iv.nearest(x, y).collect()}
    inside = {r.a_id: r.included for r in iv.included(x, y).collect()}
    over = {r.a_id: r.covered for r in iv.covered(x, y).collect()}
    for p in xs:
        d = [0 if (p.id, q.id) in want else gap(p, q) for q in ys if q.chr == p.chr]
        assert near[p.id] == ((min(d), d.count(min(d))) if d else (None, 0))
        assert inside[p.id] == any(q.chr == p.chr and q["from"] <= p["from"] and q.to >= p.to for q in ys)
        assert over[p.id] == (places([(p.chr, p["from"], p.to)]) <= places(b))


def test_runs_and_samples(spark):
    flags = spark.createDataFrame([(1, i, i in (2, 3, 7)) for i in range(1, 9)], "chr long, idx long, on boolean")
    assert spans(iv.runs(flags, "on", 1, 10)) == [(1, 11, 30), (1, 61, 70)]
    x = make(spark, [(1, 1, 100), (2, 1, 50)])
    got = [(r.chr, r.pos) for r in iv.sample_positions(x, 30, 4).collect()]
    assert len(got) == len(set(got)) == 30 and set(got) <= places([(1, 1, 100), (2, 1, 50)])
    assert sorted(got) == sorted((r.chr, r.pos) for r in iv.sample_positions(x, 30, 4).collect())


def test_ordered_operators_keep_columns_named_as_their_own(spark):
    df = spark.createDataFrame([(1, k, float(v), "x") for k, v in enumerate([5, 1, 9, 9, 2])], "g int, k int, n double, rn string")
    by, order = ["g"], ["k"]
    assert [r.smooth for r in ordered.running_median(df, by, order, "n", 3).orderBy("k").collect()] == [5, 5, 9, 9, 9]
    assert [r.rn for r in ordered.head(df, by, order, -2).collect()] == ["x"] * 3
    assert [r.total for r in ordered.bin_sum(df, by, order, "n", 2).orderBy("bin").collect()] == [6, 18]
    assert [r.rolled for r in ordered.roll_sum(df, by, order, "n", 2).orderBy("k").collect()] == [6, 10, 18, 11, 2]
    assert [r.k for r in ordered.local_maxima(df, by, order, "n", 0.1).orderBy("k").collect()] == [0, 2]
    assert ordered.head(df.limit(0), by, order, 3).count() == 0


def test_smoothing_ends_at_a_fixpoint():
    x = np.array([1, 9, 1, 1, 5, 5, 1, 5, 5.0])
    out = ordered.smooth_median(x, (3,))
    assert np.array_equal(ordered.smooth_median(out, (3,)), out)
    assert ordered.smooth_median(np.array([1.0]), (3,)).tolist() == [1.0]


def test_tables_and_weights(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "b", 1.0), (2, "a", 3.0), (2, None, 1.0)], "k int, s string, w double")
    assert {(r.a, r.b): r.n for r in tables.cooccurrence(df.where("s IS NOT NULL"), "k", "s").collect()} == {("a", "a"): 2, ("a", "b"): 1, ("b", "b"): 1}
    assert {r.s: r.n for r in tables.contingency(df, ["s"], {"s": ["a", "b", "c"]}).collect()} == {"a": 2, "b": 1, "c": 0}
    got = df.agg(tables.weighted_mean("k", "w").alias("m"), tables.weighted_var("k", "w").alias("v")).first()
    x = np.repeat([1, 1, 2, 2], [2, 1, 3, 1])
    assert got.m == pytest.approx(x.mean()) and got.v == pytest.approx(x.var(ddof=1))


def test_known_answer_of_the_hidden_markov_model():
    model = hmm.Hmm.new([{"mean": 1.0, "sd": 1.0}, {"mean": -1.0, "sd": 1.0}], np.array([[0.1, 0.9], [0.5, 0.5]]), [0.5, 0.5])
    x = np.array([-1.6835, 0.0635, -2.1688, 0.3043, -0.3188, -0.7835, 1.0398, -1.3558, 1.0882, 0.4050])
    assert hmm.forward(model, x)[1] == pytest.approx(-15.226179571, abs=1e-9)
    assert (hmm.viterbi(model, x) + 1).tolist() == [2, 1, 2, 1, 2, 2, 1, 2, 1, 2]
    post, _ = hmm.posteriors(model, x)
    assert np.allclose(post.sum(1), 1)


def test_fitting_finds_the_levels():
    true = hmm.Hmm.new([{"mean": 0.0, "sd": 0.5}, {"mean": 4.0, "sd": 0.5}], 0.05)
    states, x = hmm.simulate(true, 600, 3)
    start = hmm.Hmm.new([{"mean": 1.0, "sd": 1.0}, {"mean": 2.0, "sd": 1.0}], 0.2)
    fitted = hmm.fit(start, [x])
    assert sorted(round(p["mean"]) for p in fitted.params) == [0, 4]
    assert fitted.loglike >= hmm.forward(start, x)[1]
    assert (hmm.viterbi(fitted, x) == states).mean() > 0.98
    assert len(hmm.discover_levels(x, 5, 0.01).params) == 2
    assert hmm.bic(fitted, fitted.loglike, len(x)) > hmm.aic(fitted, fitted.loglike)
    assert len(hmm.viterbi(true, np.zeros(0))) == 0 and hmm.forward(true, np.array([np.nan]))[1] == pytest.approx(0)


def test_band_formulas():
    assert coverage.parse_band("2 * poisson + median - 0.5*peak") == [("-", 2.0, "poisson"), ("+", 1.0, "median"), ("-", 0.5, "peak")]
    for bad in ("", "2 * none", "poisson median", "__import__('os')"):
        with pytest.raises(ValueError):
            coverage.parse_band(bad)


def test_composition_model_follows_a_curve(spark):
    pts = [(k, 50 + 30 * np.sin(k / 300), 10) for k in range(200, 800, 5)]
    model = coverage.gc_model(pts)
    assert len(model) == 1001 and max(abs(model[k] - c) for k, c, _ in pts) < 4
    assert coverage.gc_model([]).tolist() == [1.0] * 1001


def test_ploidy_fit_finds_the_truth(spark):
    alpha, q = 0.2, 2.5
    obs = [(k, (k * (1 - alpha) + 2 * alpha) / (q * (1 - alpha) + 2 * alpha), 0.5 if k % 2 == 0 else ((k // 2 + 1) * 0.8 + 0.2) / (k * 0.8 + 0.4), 1.0 + k) for k in (1, 2, 3, 4)]
    obs = [(k, rc + 0.002 * k, af, w) for k, rc, af, w in obs]
    fitted = ploidy.fit(spark.createDataFrame(obs, "id int, rc double, af double, weight double"), ploidy.grid_of(spark, (0, 16, 2), (30, 70, 10)))
    best = ploidy.best(fitted).first()
    assert (best.alpha, best.ploidy) == (0.2, 2.5)
    assert 0 < ploidy.quality(fitted).first().quality <= 1


def test_copy_number_run_finds_a_gain(spark):
    r = random.Random(4)
    rows = [(c, k * 1000 + 1, (k + 1) * 1000, float(round(100 * (1.5 if c == 2 and 200 <= k < 400 else 1) + r.gauss(0, 4))), r.uniform(0.3, 0.6)) for c in (1, 2) for k in range(600)]
    bins = spark.createDataFrame(rows, "chr long, `from` long, `to` long, cov double, gc double")
    out = copynumber.run(spark, bins, iv.reduce(bins), copynumber.Params(band="10 * poisson", alphas=(0, 4, 2), ploidies=(40, 50, 5)))
    segs = sorted((s["chr"], s["from"], s["to"], s["delta_cn"]) for s in out.segments.collect())
    gain = [s for s in segs if s[3] > 0]
    assert len(gain) == 1 and gain[0][0] == 2 and abs(gain[0][1] - 200001) < 6000 and abs(gain[0][2] - 400000) < 6000


def test_alleles_and_pileup(spark):
    df = spark.createDataFrame([(1, 9, 0, 8, 0), (2, 12, 0, 0, 0), (3, 1, 1, 1, 1), (4, None, 20, 3, 0)], "id int, a int, c int, g int, t int")
    got = {r.id: (r.p, r.h, r.geno, r.s) for r in df.select("id", alleles.passes(2, 10).alias("p"), F.coalesce(alleles.heterozygous(2, 10), F.lit(False)).alias("h"), alleles.genotype(2).alias("geno"), alleles.genotype(2, True).alias("s")).collect()}
    assert got == {1: (True, True, "AG", "AG"), 2: (True, False, "A", "A"), 3: (False, False, "", ""), 4: (False, False, "CG", "CG")}
    reads = spark.createDataFrame([("x", 5, "2S3M1D2M", "ttACGTA", "IIIII!I", 60), ("x", 5, "3M", "ACC", "III", 5)], "chr string, pos long, cigar string, seq string, qual string, mapq long")
    rows = {r.pos: (r.a, r.c, r.g, r.t) for r in alleles.pileup(reads, 10, 20).collect()}
    assert rows == {5: (1, 0, 0, 0), 6: (0, 1, 0, 0), 7: (0, 0, 1, 0), 10: (1, 0, 0, 0)}


def test_strings_and_sequences(spark):
    df = spark.createDataFrame([(1, " ab.c. ", "acgtN"), (2, None, None), (3, "", "")], "id int, s string, d string")
    row = df.select("id", text.trim(F.col("s")).alias("t"), text.positions(F.col("s"), ".").alias("p"), text.truncate(F.col("s"), 5).alias("u"), dna.reverse_complement(F.col("d")).alias("r"), dna.count(F.col("d"), "other").alias("o"), dna.hamming(F.col("d"), F.lit("aagt")).alias("h")).orderBy("id").collect()
    assert (row[0].t, row[0].p, row[0].u, row[0].r, row[0].o, row[0].h) == ("ab.c.", [4, 6], " a...", "Nacgt", 1, 2)
    assert row[1].t is None and row[1].p is None and row[2].p == []
    assert spans(dna.allowed_runs(spark.createDataFrame([(1, "xxacgNNtt")], "chr long, t string"), "chr", "t")) == [(1, 3, 5), (1, 8, 9)]


def test_closure_ends_on_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 2), (9, None)], "child long, parent long")
    got = {(r.child, r.ancestor): r.depth for r in records.ancestors(e).collect()}
    assert got[(1, 4)] == 3 and got[(2, 2)] == 3 and len(got) == 12
    assert {(r.child, r.ancestor) for r in records.ancestors(e, 1).collect()} == {(1, 2), (2, 3), (3, 4), (4, 2)}


def test_text_sources(spark, tmp_path):
    def put(name, body):
        (tmp_path / name).write_text(body)
        return f"file://{tmp_path}/{name}"

    fa = texts.fasta(spark, put("x.fa", ">one first\nACGT\nACGT\n>none\n>two\nGGX\n"))
    got = sorted((r["index"], r["name"], r["size"], r["crc32"], r["seq"]) for r in fa.collect())
    assert [g[:3] for g in got] == [(0, "one", 8), (1, "none", 0), (2, "two", 3)] and got[0][4] == "ACGTACGT" and got[1][3] == 0
    assert spark.range(1).select(F.crc32(F.lit("The quick brown fox jumps over the lazy dog").cast("binary")).alias("c")).first().c == 0x414FA339
    parts = texts.chunks(fa, 3)
    at = spark.createDataFrame([(0, 1), (0, 4), (0, 8), (0, 9), (2, 3)], "chr int, pos long")
    assert {(r.chr, r.pos): r.symbol for r in texts.symbols_at(at, parts, 3).collect()} == {(0, 1): "A", (0, 4): "T", (0, 8): "T", (0, 9): None, (2, 3): "X"}
    bed = texts.bed(spark, put("x.bed", "# note\none  0 4\ttail\ntrack x\none 3 80\nbad line here\nwho\t1\t2\n"))
    seq = fa.select(F.col("index"), "name", "size")
    assert sorted((r["chr"], r["from"], r["to"]) for r in texts.with_index(bed, seq).collect()) == [(0, 1, 4)] and bed.count() == 3
    sam = texts.sam(spark, put("x.sam", "@HD\tVN:1\nr1\t99\tone\t3\t60\t4M\t=\t9\t10\tACGT\tIIII\tNM:i:0\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tA\tI\n"))
    assert [(r.pos, r.tags) for r in sam.orderBy("qname").collect()] == [(3, ["NM:i:0"]), (0, [])]
    assert texts.flag_counts(sam).first().mapped == 1
    gaf = texts.gaf(spark, put("x.gaf", "!c\nDB\tP1:2\ts\t\tGO:1\tr\tIEA\t\tF\tn\t\tt\tx\td\ta\nDB\tP1\ts\tNOT\tGO:2\tr\tI\t\tF\tn\t\tt\tx\td\ta\n"))
    assert [(r.id, r.go_id) for r in texts.associations(gaf, ("DB",)).collect()] == [("P1", "GO:1")]
    obo = texts.obo(spark, put("x.obo", "format-version: 1\n\n[Term]\nid: A\nname: root\n\n[Term]\nid: B\nname: kid\nis_a: A ! root\nrelationship: part_of A ! root\n\n[Typedef]\nid: t\n"))
    terms = {r.id: r for r in obo.collect()}
    assert terms["A"].parent_of == ["B"] and terms["B"].is_a == ["A"] and terms["B"].relationship == {"part_of": ["A"]}
    sw = texts.swiss(spark, put("x.dat", "ID   NAME_X   Reviewed;\nAC   P1; P2;\nAC   P3;\nDR   PDB; 1ABC; x.\nDR   PDB; 2ABC; y.\nSQ   SEQUENCE\n     MKV LL\n     AA\n//\nID   Z_Y  R;\nAC   Q1;\n//\n"))
    rec = {r.id: r for r in sw.collect()}
    assert rec["NAME_X"].accessions == ["P1", "P2", "P3"] and rec["NAME_X"].xref == {"PDB": ["1ABC", "2ABC"]} and rec["NAME_X"].seq == "MKVLLAA" and rec["Z_Y"].accessions == ["Q1"]
    snp = texts.snps(spark, put("x.txt", "CHROM\tPOS\tID\tQ\tREF\tALT\tAF\tEUR\n1\t10\ti\tq\tA\tG\t0.2\t0.4\n1\t11\ti\tq\tA\tG\t0.001\t0.4\n"))
    assert [r.pos for r in texts.filter_snps(snp, ["1"], 0.01).collect()] == [10]


def test_binary_sources(spark, tmp_path):
    binary.register(spark)
    seqs = [("one", "ACGT" * 5), ("none", ""), ("two", "GG")]
    binary.write_sequences(f"{tmp_path}/s.bin", seqs)
    got = sorted((r.chr, r["from"], r.part) for r in spark.read.format("tessera_sequence").option("path", f"{tmp_path}/s.bin").load().collect())
    assert got == [(1, 1, "ACGT" * 5), (3, 1, "GG")]
    counts = np.zeros((50, 4), int)
    counts[[3, 40]] = [[1, 0, 300, 0], [0, 0, 0, 70000]]
    binary.write_counts(f"{tmp_path}/c.bin", [("z", np.zeros((9, 4), int)), ("one", counts)])
    rows = sorted(tuple(r) for r in spark.read.format("tessera_counts").option("path", f"{tmp_path}/c.bin").load().collect())
    assert rows == [(2, 4, 1, 0, 300, 0), (2, 41, 0, 0, 0, 70000)]
    assert [e.code for e in binary.header(f"{tmp_path}/c.bin")[1]] == [0, 4]


def test_stream_drops_what_is_late(spark, tmp_path):
    from tessera.streaming.depth import windowed_sums

    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("ts timestamp, k string, v double").parquet(f"{tmp_path}/in")
    q = windowed_sums(stream, "ts", "v", "10 minutes", "5 minutes", "k").writeStream.format("memory").queryName("sums").option("checkpointLocation", f"{tmp_path}/ck").start()
    for rows in ([("2024-01-01 00:01:00", "a", 1.0), ("2024-01-01 00:02:00", "a", 2.0)], [("2024-01-01 01:00:00", "a", 5.0)], [("2024-01-01 00:01:30", "a", 9.0), ("2024-01-01 03:00:00", "b", 1.0)]):
        spark.createDataFrame(rows, "ts string, k string, v double").selectExpr("CAST(ts AS timestamp) AS ts", "k", "v").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q.processAllAvailable()
    q.stop()
    first = spark.table("sums").where("start = '2024-01-01 00:00:00'").collect()
    assert [(r.n, r.total) for r in first] == [(2, 3.0)]
