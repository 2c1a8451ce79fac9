"""Interval operators against brute force: touching, nested, equal, very long and
empty inputs, and chromosomes present on one side only."""

import random

import pytest
from pyspark.sql import functions as F

from spanframe.operators import ranges as R
from spanframe.operators.points import region_mean

SCHEMA = "k string, chrom string, start bigint, end bigint"


def make(n, seed, span=3000):
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        s = r.randrange(span)
        rows.append((r.choice("xy"), r.choice(["chr1", "chr2", "chr3"]), s, s + r.choice([1, 5, 50, 200])))
    return rows + rows[:5]


LONG = [("x", "chr1", i * 50_000, i * 50_000 + n) for i, n in enumerate([1, 300_000, 20, 5_000_000] * 10)]
A = make(60, 1) + LONG
B = [b for b in make(40, 2) if b[1] != "chr3"] + [(k, c, s + 10_000, e + 10_000) for k, c, s, e in LONG[::-1][:20]]


@pytest.fixture(scope="module")
def a(spark):
    return spark.createDataFrame(A, SCHEMA).cache()


@pytest.fixture(scope="module")
def b(spark):
    return spark.createDataFrame(B, SCHEMA).cache()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def merged(intervals, gap):
    out = []
    for key in sorted({i[:2] for i in intervals}):
        current = None
        for i in sorted(x for x in intervals if x[:2] == key):
            if current and i[2] <= current[3] + gap:
                current[3] = max(current[3], i[3])
            else:
                if current:
                    out.append(tuple(current))
                current = list(i)
        out.append(tuple(current))
    return sorted(out)


def meet(x, y):
    return x[:2] == y[:2] and x[2] < y[3] and y[2] < x[3]


def shared(x, y):
    return min(x[3], y[3]) - max(x[2], y[2])


@pytest.mark.parametrize("gap", [0, 100, -1])
@pytest.mark.parametrize("shift", [20, 6])
def test_merge(a, gap, shift):
    assert rows(R.merge_intervals(a, ["k"], gap, shift)) == merged(A, gap)


@pytest.mark.parametrize("split_long,salt", [(True, 1), (False, 1), (True, 3)])
def test_overlap_pairs(a, b, split_long, salt):
    got = sorted(((r.k, r.chrom, r.start, r.end), (r.k, r.chrom, r.b_start, r.b_end), r.overlap_bp)
                 for r in R.range_join(a, b, ["k"], split_long=split_long, salt=salt).collect())
    assert got == sorted((x, y, shared(x, y)) for x in A for y in B if meet(x, y))


@pytest.mark.parametrize("rule", ["start", "start_closed"])
@pytest.mark.parametrize("split_long", [True, False])
def test_start_rules(a, b, rule, split_long):
    got = sorted(((r.k, r.chrom, r.start, r.end), (r.k, r.chrom, r.b_start, r.b_end))
                 for r in R.range_join(a, b, ["k"], rule=rule, split_long=split_long).collect())
    assert got == sorted((x, y) for x in A for y in B if x[:2] == y[:2] and y[2] <= x[2] < y[3] + (rule != "start"))


def test_totals_and_membership(a, b):
    want = sorted((*x, sum(meet(x, y) for y in B), sum(shared(x, y) for y in B if meet(x, y))) for x in A)
    assert rows(R.overlap_totals(a, b, ["k"])) == want
    assert rows(R.overlaps_any(a, b, ["k"])) == sorted(x for x in A if any(meet(x, y) for y in B))
    assert rows(R.overlaps_none(a, b, ["k"])) == sorted(x for x in A if not any(meet(x, y) for y in B))


@pytest.mark.parametrize("gap", [0, 50])
def test_exclude_near_is_closed(a, b, gap):
    want = [x for x in A if not any(x[:2] == y[:2] and y[2] <= x[3] + gap and y[3] >= x[2] - gap for y in B)]
    assert rows(R.exclude_near(a, b, gap, ["k"])) == sorted(want)


def short(intervals):
    return [i for i in intervals if i[3] - i[2] <= 200]


def covered(intervals):
    out = {}
    for i in short(intervals):
        out.setdefault(i[:2], set()).update(range(i[2], i[3]))
    return out


def runs(positions):
    out = []
    for p in sorted(positions):
        if out and out[-1][1] == p:
            out[-1][1] = p + 1
        else:
            out.append([p, p + 1])
    return out


def test_subtract_complement_and_metrics(spark):
    xs, ys = short(A), short(B)
    a, b = spark.createDataFrame(xs, SCHEMA), spark.createDataFrame(ys, SCHEMA)
    blocked = covered(ys)
    want = [(*x[:2], s, e) for x in xs for s, e in runs(set(range(x[2], x[3])) - blocked.get(x[:2], set()))]
    assert rows(R.subtract(a, b, ["k"])) == sorted(want)

    domain = spark.createDataFrame([("x", "chr1", 0, 9000), ("x", "chr3", 10, 20)], SCHEMA)
    want = [("x", "chr1", s, e) for s, e in runs(set(range(9000)) - blocked.get(("x", "chr1"), set()))]
    assert rows(R.complement(b.where("k = 'x'"), domain, ["k"])) == sorted(want + [("x", "chr3", 10, 20)])

    for r in R.overlap_metrics(a, b, ["k"]).collect():
        mine = {(k, p) for k, v in covered(xs).items() if k[0] == r.k for p in v}
        theirs = {(k, p) for k, v in blocked.items() if k[0] == r.k for p in v}
        assert (r.a_bp, r.b_bp, r.overlap_bp, r.union_bp) == (len(mine), len(theirs), len(mine & theirs), len(mine | theirs))


def test_depth_and_consensus(spark):
    segs = spark.createDataFrame(
        [("s1", "t", "chr1", 0, 10), ("s1", "t", "chr1", 5, 15), ("s2", "t", "chr1", 10, 20), ("s3", "t", "chr1", 15, 30)],
        "sample_id string, tool string, chrom string, start bigint, end bigint")
    got = rows(R.consensus_regions(segs))
    # s1 covers 0-15, s2 10-20, s3 15-30: support 1, 2, 2, 1 with equal neighbours joined
    assert got == [("t", "chr1", 0, 10, 1), ("t", "chr1", 10, 20, 2), ("t", "chr1", 20, 30, 1)]


def test_signal_split_means(spark):
    signal = spark.createDataFrame([("chr1", 0, 10, 1.0), ("chr1", 5, 15, 3.0), ("chr1", 15, 20, 3.0)],
                                   "chrom string, start bigint, end bigint, value double")
    assert rows(R.split_signal_overlaps(signal)) == [("chr1", 0, 5, 1.0), ("chr1", 5, 10, 2.0), ("chr1", 10, 20, 3.0)]


def test_point_flags(spark):
    pts = [("x", "chr1", p, p + n) for p in range(0, 70_000, 977) for n in (1, 2)]
    regs = [("x", "chr1", 5, 977), ("x", "chr1", 1954, 1956), ("x", "chr1", 30_000, 60_000), ("y", "chr1", 0, 99_999)]
    p, r = spark.createDataFrame(pts, SCHEMA), spark.createDataFrame(regs, SCHEMA)
    want = sorted(x for x in pts if any(meet(x, y) for y in regs))
    assert rows(R.points_in(p, r, ["k"])) == want
    assert rows(R.points_in(p, r, ["k"], "left_anti")) == sorted(set(pts) - set(want))
    flagged = R.flag_points(p, {"hit": r, "none": r.where("start < 0")}, ["k"])
    assert sorted(tuple(x)[:4] for x in flagged.where("hit AND NOT none").collect()) == want
    assert flagged.count() == len(pts)


def test_empty_sides(spark, a):
    empty = spark.createDataFrame([], SCHEMA)
    assert R.merge_intervals(empty, ["k"]).count() == 0
    assert R.overlaps_any(a, empty, ["k"]).count() == 0
    assert R.overlaps_none(a, empty, ["k"]).count() == len(A)
    assert rows(R.subtract(a, empty, ["k"])) == sorted(A)


def test_one_heavy_position(spark):
    """A third of all rows are copies at one place: scans see one row per position."""
    spread = spark.range(20_000).select(F.lit("x").alias("k"), F.lit("chr1").alias("chrom"), (F.col("id") * 10).alias("start"),
                                        (F.col("id") * 10 + 5).alias("end"))
    heavy = spark.range(10_000).select(F.lit("x").alias("k"), F.lit("chr1").alias("chrom"), F.lit(77).cast("bigint").alias("start"),
                                       F.lit(83).cast("bigint").alias("end"))
    both = spread.unionByName(heavy)
    joined = rows(R.merge_intervals(both, ["k"]))
    assert len(joined) == 20_000 and ("x", "chr1", 77, 85) in joined
    totals = R.overlap_totals(heavy.limit(1), both, ["k"]).first()
    assert totals.n_overlaps == 10_001


@pytest.mark.parametrize("name", ["overlaps_any", "overlaps_none", "exclude_near", "states_to_regions"])
def test_scans_share_their_exchange(spark, name):
    import __spark_entry__ as entry
    out = entry.queries()[name](spark, "/root/testdata/sf0.001")
    out.collect()
    assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()


def test_points_of_any_length_meet_their_first_interval(spark):
    """Lengths from 1 to a million, nested, touching and chromosome-long intervals: one row a point."""
    import random
    rng = random.Random(8)
    pts = [("s", "chr1", s, s + n) for n in (1, 2, 3, 50, 20_000, 1_000_000) for s in (rng.randrange(3_000_000) for _ in range(25))] + [("s", "chr2", 7, 8)]
    ivs = [("s", "chr1", s, s + rng.choice([1, 2, 40, 30_000])) for s in (rng.randrange(3_000_000) for _ in range(60))]
    ivs += [("s", "chr1", 100_000, 101_000), ("s", "chr1", 100_200, 100_300), ("s", "chr1", 101_000, 101_500), ("s", "chr2", 0, 240_000_000)]
    p = spark.createDataFrame(pts, "k string, chrom string, start bigint, end bigint")
    r = spark.createDataFrame(ivs, "k string, chrom string, start bigint, end bigint")
    hit = {x for x in pts if any(x[1] == y[1] and x[2] < y[3] and y[2] < x[3] for y in ivs)}
    assert rows(R.points_in(p, r, ["k"])) == sorted(x for x in pts if x in hit)
    assert rows(R.points_in(p, r, ["k"], "left_anti")) == sorted(x for x in pts if x not in hit)
    flagged = R.flag_points(p, {"hit": r}, ["k"])
    assert rows(flagged) == sorted((*x, x in hit) for x in pts)


def test_points_stay_one_row_beside_long_regions(spark):
    pts = spark.createDataFrame([("chr1", i * 10_000, i * 10_000 + 2, float(i)) for i in range(300)], "chrom string, start bigint, end bigint, beta double").withColumn("sample_id", F.lit("s"))
    regions = spark.createDataFrame([("chr1", 0, 250_000_000), ("chr1", 15_000, 95_001), ("chr1", 20_000, 20_001)], "chrom string, start bigint, end bigint").withColumn("sample_id", F.lit("s"))
    got = {(r.start, r.end): r.n_points for r in region_mean(regions, pts).collect()}
    assert got == {(0, 250_000_000): 300, (15_000, 95_001): 8, (20_000, 20_001): 1}
    plan = R.range_join(pts, regions, ["sample_id"], rule="start")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1  # the regions' bins; points have one each


def test_depth_products_are_overlaps_of_all_pairs(spark):
    import random
    rng = random.Random(9)
    data = [(k, t, "chr1", s, s + rng.randrange(1, 60)) for k in "ab" for t in "xyz" for s in (rng.randrange(300) for _ in range(40))] + [("c", "x", "chr1", 5, 9), ("c", "y", "chr1", 20, 30), ("c", "y", "chr1", 20, 30)]
    df = spark.createDataFrame(data, "sample_id string, tool string, chrom string, start bigint, end bigint")
    out = R.pairwise_matrices(df, merge_first=False)
    got = {(r.sample_id, r.tool, r.b_tool): (r.bp, r.overlap_bp, round(r.jaccard, 9)) for r in out.collect()}
    cover = {(k, t): {p for kk, tt, _, s, e in data if (kk, tt) == (k, t) for p in range(s, e)} for k, t in {(d[0], d[1]) for d in data}}
    for (k, a), mine in cover.items():
        for (kk, b), theirs in cover.items():
            if kk == k:
                shared = sum(max(0, min(x[4], y[4]) - max(x[3], y[3])) for x in data for y in data if x[:2] == (k, a) and y[:2] == (k, b))
                assert got.pop((k, a, b)) == (len(mine), shared, round(len(mine & theirs) / len(mine | theirs), 9))
    assert not got
    # the only join puts the running sums of earlier tiles to their tile
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
