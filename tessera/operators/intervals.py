"""Interval algebra over DataFrames with columns chr, from, to (1-based, both ends included).

Rows with a null in chr, from or to are no intervals and drop out of results that are made of intervals, as do those that end before they begin; empty
tables give empty results. Set operations are sweeps over tiles of the axis (see tiles): rows that begin at the same place are brought together
first, so no task holds a whole chr, or more of a tile than its places. Joins of two sets meet in bins of the axis, so that no pair of rows that
cannot overlap is compared, and a pair is kept in one bin only, the one in which the later of both starts lies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.draws import draw
from tessera.operators.tiles import TILE, running, tiled

KEYS = ("chr", "from", "to")
#: Overlap joins take rows of up to 2**LEAST places as one size class, and those of up to 2**STEP times as many as the next.
LEAST, STEP = 8, 3


def _clean(df: DataFrame) -> DataFrame:
    return df.where(F.col("chr").isNotNull() & F.col("from").isNotNull() & F.col("to").isNotNull())


def _valid(df: DataFrame) -> DataFrame:
    return _clean(df).where(F.col("from") <= F.col("to"))


def join(df: DataFrame, delta: int = 0, minsize: int = 0) -> DataFrame:
    """Merges rows whose gap is delta or less; keeps those at least minsize wide. A row begins an island when it lies more than delta beyond the reach of
    all rows before it; an island is known by the last beginning at or before a row."""
    if delta < 0:
        raise ValueError("delta is negative")
    rows = tiled(_valid(df).groupBy("chr", "from").agg(F.max("to").alias("to")), "from")
    reached = running(rows, ["chr"], ["from"], {"reach": ("max", F.col("to"))}, inclusive=False)
    begins = F.when(F.coalesce(F.col("from") - F.col("reach") - 1 > delta, F.lit(True)), F.col("from"))
    # a tile's rows come down to its islands, of which the first may go on from an earlier tile
    here = Window.partitionBy("chr", TILE).orderBy("from").rowsBetween(Window.unboundedPreceding, 0)
    parts = reached.withColumn("begin", F.max(begins).over(here)).groupBy("chr", TILE, "begin").agg(F.min("from").alias("from"), F.max("to").alias("to"))
    islands = running(parts, ["chr"], ["from"], {"island": ("max", F.col("begin"))})
    merged = islands.groupBy("chr", "island").agg(F.min("from").alias("from"), F.max("to").alias("to"))
    return threshold(merged.select(*KEYS), minsize)


def reduce(df: DataFrame) -> DataFrame:
    """The union of the rows as intervals that neither overlap nor touch."""
    return join(df, 0, 0)


def threshold(df: DataFrame, minsize: int) -> DataFrame:
    return df.where(F.col("to") - F.col("from") + 1 >= minsize)


def union(a: DataFrame, b: DataFrame, minsize: int = 0) -> DataFrame:
    return join(a.select(*KEYS).unionByName(b.select(*KEYS)), 0, minsize)


def complement(df: DataFrame, within: DataFrame) -> DataFrame:
    """What of `within` (reduced) no row of df covers."""
    return exclude(within, df)


def exclude(a: DataFrame, b: DataFrame, margin: int = 0) -> DataFrame:
    """The union of a without b, b's rows being widened by margin on either side. One sweep over the ends of both: no pairs are made."""
    wide = _clean(b).select("chr", (F.col("from") - margin).alias("from"), (F.col("to") + margin).alias("to"))
    return _sweep(a, wide, lambda in_a, in_b: (in_a > 0) & (in_b == 0))


def inter(a: DataFrame, b: DataFrame, minsize: int = 0) -> DataFrame:
    """The intersection of the unions of a and b."""
    return threshold(_sweep(a, b, lambda in_a, in_b: (in_a > 0) & (in_b > 0)), minsize)


def _marks(*sets: tuple[DataFrame, str]) -> DataFrame:
    """chr, at and the sums of the named changes there: 1 where a row of a set begins, -1 after its end."""
    marks, names = None, [name for _, name in sets]
    for df, name in sets:
        df = _valid(df)
        for at, sign in ((F.col("from"), 1), (F.col("to") + 1, -1)):
            part = df.select("chr", at.alias("at"), *[F.lit(sign if n == name else 0).alias(n) for n in names])
            marks = part if marks is None else marks.unionAll(part)
    return marks.groupBy("chr", "at").agg(*[F.sum(n).alias(n) for n in names])


def _sweep(a: DataFrame, b: DataFrame, keep) -> DataFrame:
    """Stretches of the axis on which keep(number of rows of a, of b) holds, joined where they touch: from a place where it begins to the next where it ends."""
    marks = tiled(_marks((a, "da"), (b, "db")), "at")
    at = running(marks, ["chr"], ["at"], {"in_a": ("sum", F.col("da")), "in_b": ("sum", F.col("db"))})
    on, was = keep(F.col("in_a"), F.col("in_b")), keep(F.col("in_a") - F.col("da"), F.col("in_b") - F.col("db"))
    turns = at.select("chr", "at", TILE, on.alias("on"), was.alias("was")).where(F.col("on") != F.col("was"))
    spans = running(turns, ["chr"], ["at"], {"from": ("max", F.when(F.col("on"), F.col("at")))})
    return spans.where("was").select("chr", "from", (F.col("at") - 1).alias("to"))


def depth(df: DataFrame) -> DataFrame:
    """Stretches of equal depth, and the number of rows over each; depth 0 is left out. A stretch ends before the mark at which the depth changes."""
    marks = tiled(_marks((df, "d")).where("d <> 0"), "at")
    at = running(marks, ["chr"], ["at"], {"upto": ("sum", F.col("d"))})
    at = running(at, ["chr"], ["at"], {"from": ("max", F.col("at"))}, inclusive=False)
    return at.select("chr", "from", (F.col("at") - 1).alias("to"), (F.col("upto") - F.col("d")).alias("depth")).where("depth > 0")


def trim(df: DataFrame, margin: int) -> DataFrame:
    """Rows shortened by margin at both ends; those that vanish are dropped."""
    return df.withColumn("from", F.col("from") + margin).withColumn("to", F.col("to") - margin).where(F.col("from") <= F.col("to"))


def _class(start: str, end: str) -> Column:
    over = F.ceil((F.log2(F.col(end) - F.col(start) + 1) - LEAST) / STEP).cast("int")
    return LEAST + STEP * F.greatest(F.lit(0), over)


def _levels(df: DataFrame, other: DataFrame, bits: int | None) -> DataFrame:
    """Adds _level and _bin. A row's class is the power of two, of LEAST and every STEP on, that its width comes to; it stands in bins of its own class's width, two at
    most, and in those of the other side's larger classes. Most rows are much narrower than their class, and so stand in one bin."""
    if bits is not None:
        return df.withColumn("_level", F.lit(bits)).withColumn("_bin", F.explode(F.sequence(F.shiftright("from", bits), F.shiftright("to", bits))))
    present = other.select(_class("from", "to").alias("c")).agg(F.collect_set("c").alias("_present"))  # 20 classes at most
    rows = df.withColumn("_class", _class("from", "to")).join(F.broadcast(present))
    rows = rows.withColumn("_level", F.explode(F.array_union(F.array("_class"), F.filter("_present", lambda c: c > F.col("_class"))))).drop("_present", "_class")
    step = F.pow(F.lit(2.0), F.col("_level"))
    return rows.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("from") / step), F.floor(F.col("to") / step))))


def overlap_pairs(a: DataFrame, b: DataFrame, a_id: str = "id", b_id: str = "id", bits: int | None = None) -> DataFrame:
    """a_id, b_id, from and to (the common stretch) of each pair of rows that overlap. bits: one bin width of 2**bits for all, instead of size classes."""
    x0 = _valid(a).select("chr", F.col("from").cast("long").alias("from"), F.col("to").cast("long").alias("to"), F.col(a_id).alias("a_id"))
    y0 = _valid(b).select("chr", F.col("from").cast("long").alias("from"), F.col("to").cast("long").alias("to"), F.col(b_id).alias("b_id"))
    x = _levels(x0, y0, bits).withColumnsRenamed({"from": "af", "to": "at"})
    y = _levels(y0, x0, bits).withColumnsRenamed({"from": "bf", "to": "bt"})
    later = F.floor(F.greatest("af", "bf") / F.pow(F.lit(2.0), F.col("_level")))
    own = F.lit(True) if bits is not None else F.col("_level") == F.greatest(_class("af", "at"), _class("bf", "bt"))
    met = x.join(y, ["chr", "_level", "_bin"]).where((F.col("af") <= F.col("bt")) & (F.col("bf") <= F.col("at")) & (F.col("_bin") == later) & own)
    return met.select("chr", "a_id", "b_id", F.greatest("af", "bf").alias("from"), F.least("at", "bt").alias("to"))


def overlap(a: DataFrame, b: DataFrame, a_id: str = "id", b_id: str = "id") -> DataFrame:
    """For each row of a, the sorted ids of the rows of b that overlap it; empty where there are none."""
    pairs = overlap_pairs(a, b, a_id, b_id).groupBy("a_id").agg(F.sort_array(F.collect_list("b_id")).alias("b_ids"))
    out = a.select(F.col(a_id).alias("a_id")).join(pairs, "a_id", "left")
    return out.withColumn("b_ids", F.coalesce("b_ids", F.array().cast(pairs.schema["b_ids"].dataType)))


def _ends_at(b: DataFrame, *more: Column) -> tuple[DataFrame, DataFrame]:
    """chr, p, n, and more of each place at which rows begin, and at which they end."""
    return tuple(b.groupBy("chr", F.col(c).cast("long").alias("p")).agg(F.count("*").alias("n"), *more) for c in ("from", "to"))


def _sown(rows: DataFrame, marks: DataFrame, place: str, plain: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows at a place of theirs (o = 1) and marks, tiled by p, together; and the marks with one row for each tile of the rows, of which plain has the places too."""
    at, marks = tiled(rows.withColumn("p", F.col(place)).withColumn("o", F.lit(1)), "p"), tiled(marks, "p")
    return at.unionByName(marks, allowMissingColumns=True), marks.unionByName(tiled(plain, place).select("chr", TILE).distinct(), allowMissingColumns=True)


def _beside(a: DataFrame, b: DataFrame, a_id: str) -> DataFrame:
    """a_id, chr, af, at, below (p, n: the nearest end of b below the row, and how many rows end there), above (likewise), hits (rows of b that overlap). A row looks
    below from its start, and with what it found there above from its end."""
    rows = _clean(a).select("chr", F.col("from").cast("long").alias("af"), F.col("to").cast("long").alias("at"), F.col(a_id).alias("a_id"))
    starts, ends = _ends_at(_valid(b))
    ends, starts = ends.withColumnRenamed("n", "ends").withColumn("o", F.lit(2)), starts.withColumnRenamed("n", "starts").withColumn("o", F.lit(0))
    both, marks = _sown(rows, ends, "af", rows)
    up = running(both, ["chr"], ["p"], {"below": ("max", F.when(F.col("ends").isNotNull(), F.struct("p", F.col("ends").alias("n")))), "ended": ("sum", F.col("ends"))}, then=["o"], marks=marks)
    both, marks = _sown(up.where("o = 1").select("chr", "af", "at", "a_id", "below", "ended"), starts, "at", rows)
    above = {"above": ("min", F.when(F.col("starts").isNotNull(), F.struct("p", F.col("starts").alias("n"))))}
    seen = running(both, ["chr"], ["p"], {"begun": ("sum", F.col("starts"))}, then=["o"], after=above, marks=marks).where("o = 1")
    return seen.select("a_id", "chr", "af", "at", "below", "above", (F.col("begun") - F.col("ended")).alias("hits"))


def _distance() -> Column:
    return F.when(F.col("hits") > 0, F.lit(0)).otherwise(F.least(F.col("af") - F.col("below.p"), F.col("above.p") - F.col("at"))).cast("long")


def nearest(a: DataFrame, b: DataFrame, a_id: str = "id") -> DataFrame:
    """a_id, distance (0 if they overlap, null without a row of b on the chr) and ties, the number of rows of b at that distance. a_id, of any type, is unique.

    The nearest row before is the one of largest end below, the nearest after the one of least start above; the rows that overlap are those that have
    begun less those that have ended. All are running figures over both sets in one order: no pairs are made."""
    both = _beside(a, b, a_id).withColumn("distance", _distance())
    side = F.when(F.col("af") - F.col("below.p") == F.col("distance"), F.col("below.n")).otherwise(0) + F.when(F.col("above.p") - F.col("at") == F.col("distance"), F.col("above.n")).otherwise(0)
    return both.select("a_id", "distance", F.when(F.col("hits") > 0, F.col("hits")).otherwise(F.coalesce(side, F.lit(0))).cast("long").alias("ties"))


def neighbours(a: DataFrame, b: DataFrame, a_id: str = "id", b_id: str = "id") -> DataFrame:
    """a_id, b_id and distance of each row of b that is nearest to a row of a: all that overlap it at distance 0, or else all at the least distance. Ids are of any type.

    A row that none overlaps sees the nearest end below and the nearest start above from its own start. Where one row of b ends or begins, its id comes along; where
    several do, they are joined by the place."""
    rows = _clean(a).select("chr", F.col("from").cast("long").alias("af"), F.col("to").cast("long").alias("at"), F.col(a_id).alias("a_id"))
    b_rows = _valid(b).select("chr", "from", "to", F.col(b_id).alias("b_id"))
    starts, ends = _ends_at(b_rows, F.any_value("b_id").alias("b_id"))
    marks = starts.withColumn("o", F.lit(0)).unionByName(ends.withColumn("o", F.lit(2)))
    both, marks = _sown(rows, marks, "af", rows)
    side = lambda o: F.when(F.col("o") == o, F.struct("p", "n", "b_id"))
    counts = {"open": ("sum", F.when(F.col("o") == 0, F.col("n")).when(F.col("o") == 2, -F.col("n")))}
    seen = running(both, ["chr"], ["p"], {"below": ("max", side(2)), **counts}, then=["o"], after={"above": ("min", side(0))}, marks=marks)
    alone = seen.where("o = 1 AND open = 0 AND (above IS NULL OR above.p > at)").withColumn("distance", F.least(F.col("af") - F.col("below.p"), F.col("above.p") - F.col("at")))
    one = lambda name, end, far: F.struct(F.lit(end).alias("end"), far.alias("far"), *[F.col(f"{name}.{c}").alias(c) for c in ("p", "n", "b_id")])
    sides = F.array(one("below", "to", F.col("af") - F.col("below.p")), one("above", "from", F.col("above.p") - F.col("at")))
    near = alone.select("chr", "a_id", F.col("distance").cast("long").alias("distance"), F.explode(sides).alias("s")).where("s.far = distance").select("chr", "a_id", "distance", "s.*")
    several = b_rows.select("chr", F.explode(F.array(*[F.struct(F.lit(c).alias("end"), F.col(c).cast("long").alias("p")) for c in ("to", "from")])).alias("s"), "b_id").select("chr", "s.*", "b_id")
    tied = near.where("n > 1").drop("b_id").join(several, ["chr", "end", "p"])
    hits = overlap_pairs(a, b, a_id, b_id).select("a_id", "b_id", F.lit(0).cast("long").alias("distance"))
    return hits.unionByName(near.where("n = 1").select("a_id", "b_id", "distance")).unionByName(tied.select("a_id", "b_id", "distance"))


def included(a: DataFrame, b: DataFrame, a_id: str = "id") -> DataFrame:
    """a_id and included: whether one row of b contains the row. Of b's rows that start no later, the one of largest end decides."""
    rows = _clean(a).select("chr", F.col("from").cast("long").alias("p"), F.lit(1).alias("is_row"), F.lit(None).cast("long").alias("end"), F.col("to").cast("long").alias("at"), F.col(a_id).alias("a_id"))
    cover = _valid(b).groupBy("chr", F.col("from").cast("long").alias("p")).agg(F.max("to").cast("long").alias("end"))
    marks = rows.unionByName(cover.withColumn("is_row", F.lit(0)), allowMissingColumns=True)
    out = running(tiled(marks, "p"), ["chr"], ["p"], {"reach": ("max", F.col("end"))}, then=["is_row"]).where("is_row = 1")
    return out.select("a_id", F.coalesce(F.col("reach") >= F.col("at"), F.lit(False)).alias("included"))


def covered(a: DataFrame, b: DataFrame, a_id: str = "id") -> DataFrame:
    """a_id and covered: whether the union of b contains the row."""
    return included(a, reduce(b), a_id).withColumnRenamed("included", "covered")


def is_valid(df: DataFrame) -> DataFrame:
    """One row: whether all rows have 1 <= from <= to."""
    return df.agg(F.coalesce(F.bool_and((F.col("from") >= 1) & (F.col("from") <= F.col("to"))), F.lit(True)).alias("ok"))


def is_unsorted(df: DataFrame, order: str) -> DataFrame:
    """One row: whether rows of some chr, in the order of a column, step back in `from` (then `to`)."""
    rows = running(tiled(df.select("chr", order, F.struct("from", "to").alias("_at")), order), ["chr"], [order], {"_before": ("last", F.col("_at"))}, inclusive=False)
    return rows.agg(F.coalesce(F.bool_or(F.col("_at") < F.col("_before")), F.lit(False)).alias("unsorted"))


def is_disjoint(df: DataFrame, strong: bool = True) -> DataFrame:
    """One row: strong, whether no two rows overlap; weak, whether no row contains another (equal rows contain each other). Of rows that start at one place, one contains the other."""
    rows = tiled(_valid(df).groupBy("chr", "from").agg(F.max("to").alias("to"), F.count("*").alias("n")), "from")
    rows = running(rows, ["chr"], ["from"], {"reach": ("max", F.col("to"))}, inclusive=False)
    bad = (F.col("n") > 1) | F.coalesce(F.col("reach") >= F.col("from" if strong else "to"), F.lit(False))
    return rows.agg(F.coalesce(~F.bool_or(bad), F.lit(True)).alias("disjoint"))


def sort_index(df: DataFrame, *ties: str) -> DataFrame:
    """Adds idx, the place of each row within its chr by to, then from, then ties."""
    out = running(tiled(df, "to"), ["chr"], ["to", "from", *ties], {"idx": ("sum", F.lit(1).cast("long"))})
    return out.drop(TILE)


def group_lists(df: DataFrame, bits: int | None = None) -> DataFrame:
    """Each chr's intervals as one sorted text from-to,from-to,...: a group is a row by its meaning. bits: a row for each chr and stretch of 2**bits places that
    intervals begin in, numbered by chunk, for groups too large for one row; in order of chunk the texts make up the whole."""
    pairs = F.transform(F.sort_array(F.collect_list(F.struct("from", "to"))), lambda s: F.concat_ws("-", s["from"], s["to"]))
    by = ["chr"] if bits is None else ["chr", F.shiftright(F.col("from").cast("long"), bits).alias("chunk")]
    return _clean(df).groupBy(*by).agg(F.array_join(pairs, ",").alias("spans"))


def runs(df: DataFrame, flag: str, p0: int = 1, delta: int = 1, minsize: int = 0) -> DataFrame:
    """Maximal runs of true flags over consecutive idx (from 1) of each chr, as intervals p0+(i-1)*delta .. p0+(j-1)*delta+delta-1."""
    out = join(df.where(F.col(flag)).select("chr", F.col("idx").cast("long").alias("from"), F.col("idx").cast("long").alias("to")))
    return threshold(out.select("chr", (F.lit(p0) + (F.col("from") - 1) * delta).alias("from"), (F.lit(p0) + F.col("to") * delta - 1).alias("to")), minsize)


def sample_positions(df: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """chr and pos: size positions of the reduced intervals, drawn uniformly without replacement; half of all positions if that is fewer than size.

    The positions of all intervals are numbered through; numbers are drawn by hashes, repeats left out, the first `size` kept, and looked up. Of 2 * size + 64 draws
    out of 2 * size numbers or more, over size are distinct but for a chance under 2**-60; should they not be, more are drawn."""
    from tessera.operators import ordered
    from tessera.runtime import cut

    reduced = tiled(reduce(df), "from").withColumn("w", F.col("to") - F.col("from") + 1)
    placed = running(reduced, ["chr"], ["from"], {"before": ("sum", F.col("w"))}, inclusive=False)
    chrs = reduced.groupBy("chr").agg(F.sum("w").alias("w"))
    firsts = chrs.select("chr", F.coalesce(F.sum("w").over(Window.orderBy("chr").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))  # a row for each sequence
    placed = cut(placed.join(firsts, "chr").select("chr", "from", "w", (F.col("first") + F.col("before")).alias("at")))
    total = placed.agg(F.sum("w")).first()[0] or 0
    size = min(size, total // 2)
    if not size:
        return placed.select("chr", F.col("from").alias("pos")).limit(0)
    draws = 2 * size + 64
    while True:
        numbers = df.sparkSession.range(draws).select("id", F.pmod(draw(seed, "id"), F.lit(total)).alias("number"))
        drawn = numbers.groupBy("number").agg(F.min("id").alias("id")).orderBy("id").limit(size)
        if draws > 4 * size + 256 or drawn.count() == size:
            break
        draws *= 2
    found = ordered.asof(drawn, placed.withColumn("v", F.struct("chr", "from")), [], "number", "at", "v", ["id"])
    return found.select("v.chr", (F.col("v.from") + F.col("number") - F.col("found_at")).alias("pos"))
