"""Sweeps over many tiles give what they give over one."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import intervals as iv, ordered as od, tiles


@pytest.fixture(scope="module")
def sets(spark):
    r = random.Random(4)

    def some(n, chrs):
        out = []
        for k in range(n):
            start = r.randint(-40, 300)
            out.append((f"id{k}", r.choice(chrs), start, start + r.choice([0, 1, 3, 9, 60])))
        return out + [("none", None, 1, 2), ("empty", "x", 9, 7)]

    schema = "id string, chr string, `from` long, `to` long"
    a, b = (spark.createDataFrame(some(n, c), schema).repartition(3).cache() for n, c in ((150, "xy"), (60, "xz")))
    return a, b


def _points(df):
    return df.where("chr IS NOT NULL").select("chr", F.col("from").alias("pos"), "id", (F.col("to") % 3).alias("state"))


CASES = {
    "join": lambda a, b: iv.join(a, 2, 3),
    "inter": iv.inter,
    "exclude": lambda a, b: iv.exclude(a, b, 1),
    "depth": lambda a, b: iv.depth(a),
    "nearest": iv.nearest,
    "neighbours": iv.neighbours,
    "included": iv.included,
    "covered": iv.covered,
    "disjoint": lambda a, b: iv.is_disjoint(iv.reduce(a), False),
    "overlapping": lambda a, b: iv.is_disjoint(a, True),
    "unsorted": lambda a, b: iv.is_unsorted(a.where("chr IS NOT NULL"), "from"),
    "sort": lambda a, b: iv.sort_index(iv._clean(a), "id"),
    "chunks": lambda a, b: iv.group_lists(a),
    "find": lambda a, b: od.find_interval(_points(a), _points(b).select("chr", F.col("pos").alias("at")), ["chr"], "pos", "at", ["id"]),
    "asof": lambda a, b: od.asof(_points(a), _points(b).select("chr", F.col("pos").alias("at"), F.col("id").alias("v")), ["chr"], "pos", "at", "v", ["id"], 20),
    "runs": lambda a, b: od.run_lengths(_points(a), ["chr"], ["pos", "id"], "state", "pos"),
    "fuse": lambda a, b: od.fuse(iv._clean(a).withColumn("state", F.col("to") % 2), ["chr"], 5),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_many_tiles_are_as_one(monkeypatch, sets, name):
    rows = []
    for bits in (40, 3):
        monkeypatch.setattr(tiles, "BITS", bits)
        rows.append(sorted(map(str, CASES[name](*sets).collect())))
    assert rows[0] == rows[1] and rows[0]


def _spans(df):
    return [(r.id, r.chr, r["from"], r["to"]) for r in df.collect() if r.chr is not None]


def test_neighbours_are_as_by_looking_at_all(sets):
    a, b = sets
    want, dist = set(), {}
    for i, c, f, t in _spans(a):
        all_ = [(max(0, y[2] - t, f - y[3]), y[0]) for y in _spans(b) if y[1] == c and y[2] <= y[3]]
        least = min(all_, default=(None,))[0]
        dist[i] = (least, sum(d == least for d, _ in all_))
        want |= {(i, j, d) for d, j in all_ if d == least}
    want = {x for x in want if x[0] != "empty"}
    got = [(r.a_id, r.b_id, r.distance) for r in iv.neighbours(a.where("id <> 'empty'"), b).collect()]
    assert len(got) == len({*got}) and {*got} == want
    assert {r.a_id: (r.distance, r.ties) for r in iv.nearest(a.where("id <> 'empty'"), b).collect()} == {i: d for i, d in dist.items() if i != "empty"}


@pytest.mark.parametrize("bits", [None, 4])
def test_overlaps_of_narrow_and_wide_rows(spark, sets, bits):
    a, b = sets
    wide = spark.createDataFrame([("wide", "x", -1000, 100_000), ("high", "y", 3, 3)], a.schema)
    a, b = a.unionByName(wide), b.unionByName(wide.withColumn("id", F.concat("id", F.lit("2"))))
    want = {(x[0], y[0], max(x[2], y[2]), min(x[3], y[3])) for x in _spans(a) for y in _spans(b) if x[1] == y[1] and max(x[2], y[2]) <= min(x[3], y[3]) and x[2] <= x[3] and y[2] <= y[3]}
    got = [(r.a_id, r.b_id, r["from"], r["to"]) for r in iv.overlap_pairs(a, b, bits=bits).collect()]
    assert len(got) == len(want) and {*got} == want


def test_position_samples_are_whole(spark):
    one = spark.createDataFrame([("x", 5, 8), ("x", 7, 9), ("y", 1, 3)], "chr string, `from` long, `to` long")
    inside = {("x", p) for p in range(5, 10)} | {("y", p) for p in range(1, 4)}
    seen = set()
    for seed in range(12):
        got = [(r.chr, r.pos) for r in iv.sample_positions(one, 4, seed).collect()]
        assert len(got) == len({*got}) == 4 and {*got} <= inside
        seen |= {*got}
    assert seen == inside
    assert iv.sample_positions(one.limit(0), 4).count() == 0
    assert {r.chunk for r in iv.group_lists(one, 2).collect()} == {0, 1}
