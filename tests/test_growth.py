"""Steps whose memory or time must follow the input: what their plans must, and must not, hold."""

import bisect
import random
import re
import statistics

from pyspark.sql import functions as F

from spanframe.operators import association as L
from spanframe.operators import cohort as M
from spanframe.operators import fold_features as FF
from spanframe.operators import randomize as Z
from spanframe.operators import medians
from spanframe.operators import ranges as R
from spanframe.operators.scan import bracket


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_training_regions_do_not_meet_by_sample(spark):
    segments = spark.createDataFrame([("a", "chr1", 0, 10), ("b", "chr1", 500, 900), ("c", "chr1", 5000, 5100), ("a", "chr2", 0, 10)],
                                     "sample_id string, chrom string, start bigint, end bigint")
    folds = spark.createDataFrame([(0, "a", "train", "Tumor"), (0, "b", "train", "Tumor"), (0, "c", "test", "Tumor"), (1, "c", "train", "Tumor"), (1, "a", "train", "Normal")],
                                  "fold int, sample_id string, split string, binary_label string")
    out = M.training_regions(segments, folds, "Tumor")
    assert "hashpartitioning(sample_id" not in plan(out) and "BroadcastHashJoin" in plan(out)
    got = {(r.fold, r.chrom, r.start, r.end, tuple(r.samples)) for r in out.collect()}
    assert got == {(0, "chr1", 0, 900, ("a", "b")), (0, "chr2", 0, 10, ("a",)), (1, "chr1", 5000, 5100, ("c",))}


def test_features_by_mean_deal_points_once_in_tasks_that_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(R, "PACKED_ROWS", 10)
    at = [(s, "chr1", p, p + 2, b) for s, b in (("a", 0.2), ("b", 0.9)) for p in range(0, 40_000, 500) for _ in range(2)]
    points = spark.createDataFrame(at, "sample_id string, chrom string, start bigint, end bigint, beta double")
    features = spark.createDataFrame([("chr1", 0, 700, 1), ("chr1", 16_000, 33_500, 2), ("chr1", 50_000, 60_000, 3), ("chr2", 0, 700, 4)], "chrom string, start bigint, end bigint, feature_id int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = L.filter_features_by_mean(features, points, 0.5)
        assert "hashpartitioning(sample_id" not in plan(out).split("f_start")[-1] and ", 32), REPARTITION_BY_NUM" in plan(out)
        assert {(r.feature_id, round(r.mean_beta, 9)) for r in out.collect()} == {(1, 0.55), (2, 0.55)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_random_places_keep_anchors_once_a_split(spark, monkeypatch):
    sizes = spark.createDataFrame([("chr1", 3_000_000)], "chrom string, size bigint")
    anchors = spark.range(0, 3_000_000, 300).select(F.lit(0).cast("bigint").alias("split"), F.lit("chr1").alias("chrom"), F.col("id").alias("anchor_pos"))
    references = spark.createDataFrame([(0, k, "chr1", i * 10_000, i * 10_000 + n + i, n + i) for k, n in (("x", 900), ("y", 2000), ("z", 5000)) for i in range(30)],
                                       "split bigint, kind string, chrom string, start bigint, end bigint, length bigint")
    excluded = spark.createDataFrame([(0, "chr1", 1_000_000, 1_200_000), (0, "chr1", 1_200_100, 2_000_000)], "split bigint, chrom string, start bigint, end bigint")
    written = {}
    real = FF.materialize
    monkeypatch.setattr(FF, "materialize", lambda df, label="stage": written.setdefault(label, real(df, label)) if label == "anchors" else real(df, label))
    got = FF.placed_regions(references, excluded, sizes, anchors, 20, draws=2, min_points=2).collect()
    assert written["anchors"].count() == anchors.where("anchor_pos < 1000000 or anchor_pos >= 2000000").count()
    assert len(got) == 3 * 2 * 20
    for r in got:
        assert (0 <= r.start and r.end <= 1_000_000) or (2_000_000 <= r.start and r.end <= 3_000_000)
        assert r.n_points == -(-r.end // 300) - -(-r.start // 300) >= 2
        assert {"x": 900, "y": 2000, "z": 5000}[r.kind] <= r.length


def test_injection_checks_deal_both_tables_once(spark, monkeypatch):
    monkeypatch.setattr(Z, "PACKED_ROWS", 10)
    at = "sample_id string, chrom string, start bigint, end bigint, coverage bigint, meth bigint"
    old = [(s, "chr1", p, p + 2, 10, 5) for s in "abc" for p in range(0, 40_000, 800)] + [("a", "chr1", 0, 2, 10, 1), ("a", "chr1", None, 2, 10, 1)]
    new = [(s, c, p, e, 11 if s == "b" and p == 800 else n, 12 if s == "b" and p == 1600 else 3, p is not None and 700 <= p < 20_000)
           for s, c, p, e, n, _ in old if s != "c"] + [("d", "chr1", 5, 7, 0, 0, False)]
    before, after = spark.createDataFrame(old, at), spark.createDataFrame(new, f"{at}, in_truth boolean")
    truth = spark.createDataFrame([(s, "chr1", a, b) for s in "ab" for a, b in ((700, 9000), (8000, 20_000))], "sample_id string, chrom string, start bigint, end bigint")
    out = Z.injection_checks(before, after, truth)
    text = plan(out)
    assert ", 31), REPARTITION_BY_NUM" in text and text.count("Union") == 1
    got = {r.sample_id: (r.n_before, r.n_after, r.n_modified, r.n_changed_keys, r.n_out_of_range, r.n_truth, r.ok) for r in out.collect()}
    assert got == {"a": (52, 52, 24, 0, 0, 2, True), "b": (50, 50, 24, 2, 1, 2, False), "c": (50, None, None, 50, None, 0, False), "d": (None, 1, 0, 1, 0, 0, False)}
    means = {r.sample_id: (r.mean_beta_before, r.mean_beta_after) for r in out.collect()}
    assert means["a"][0] == 0.5 and abs(means["a"][1] - 0.3) < 1e-12
    assert means["c"] == (None, None) and means["d"] == (None, None)


def test_nearest_targets_from_running_frames_and_one_exchange_of_the_queries(spark):
    draw = random.Random(3)
    asked = {(c, draw.randrange(-3 << 20, 9 << 20)) for c in "xyz" for _ in range(300)} | {("x", 0), ("y", 1 << 20)}
    known = {(c, draw.randrange(0, 6 << 20)) for c in "xy" for _ in range(20)} | {("x", 0), ("y", 1 << 20), ("y", (1 << 20) + 1)}
    queries, targets = (spark.createDataFrame(sorted(rows), "chrom string, pos bigint") for rows in (asked, known))
    want = {}
    for c, p in asked:
        mine = sorted(q for k, q in known if k == c)
        low, high = bisect.bisect_right(mine, p), bisect.bisect_left(mine, p)
        want[c, p] = (mine[low - 1] if low else None, mine[high] if high < len(mine) else None)
    one = bracket(queries, targets, ["chrom"], distinct=True)
    for out in (one, bracket(queries.unionAll(queries), targets.unionAll(targets), ["chrom"])):
        assert "unboundedfollowing" not in plan(out).lower()
        rows = out.collect()
        assert {(r.chrom, r.pos): (r.prev_pos, r.next_pos) for r in rows} == want and len(rows) == len(want)
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(one))
    assert dealt and not [x for x in dealt if "pos#" in x]


def test_medians_of_written_rows_shuffle_the_middle_only(spark, monkeypatch):
    draw = random.Random(4)
    groups = {"a": [draw.lognormvariate(0, 9) for _ in range(2001)], "b": [draw.choice((-2.0, 0.0, 1.0)) for _ in range(900)], "c": [float("inf"), 1.0], None: [4.0, None, 2.0], "d": [None]}
    rows = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, value double")
    written = {}
    real = medians.materialize
    monkeypatch.setattr(medians, "materialize", lambda df, label="stage": written.setdefault(label, real(df, label)))
    got = {r.k: r.median for r in medians.long_medians(rows, ["k"], written=True).collect()}
    assert got == {k: statistics.median(x) for k, vs in groups.items() if (x := [v for v in vs if v is not None])}
    assert "value-counts" not in written and written["middle-block"].where("k = 'a'").count() < 50
