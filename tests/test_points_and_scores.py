import random
import statistics

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from spanframe.functions import bp_label, half_even, normalize_chrom, patient_id, stable_seed
from spanframe.operators import association as L
from spanframe.operators import cleaning as C
from spanframe.operators import context as G
from spanframe.operators import points as P
from spanframe.operators import scoring as B
from spanframe.operators.scan import bracket, prefix_scan, ranked


def test_prefix_scan_across_tiles(spark):
    r = random.Random(3)
    pos = sorted(r.sample(range(4000), 300))
    values = [r.randrange(10) for _ in pos]
    df = spark.createDataFrame([("c", p, v) for p, v in zip(pos, values)], "chrom string, pos bigint, v bigint")
    out = prefix_scan(df.withColumn("m", F.col("v")), ["chrom"], sums=["v"], maxes=["m"], later_mins=["m"], next_pos="nxt", shift=5)
    for i, row in enumerate(sorted(out.collect(), key=lambda x: x.pos)):
        assert row.v_before == sum(values[:i])
        assert row.m_before == (max(values[:i]) if i else None)
        assert row.m_after == (min(values[i + 1:]) if i + 1 < len(pos) else None)
        assert row.nxt == (pos[i + 1] if i + 1 < len(pos) else None)


def test_ranked(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), F.md5(F.col("id").cast("string")).alias("h"))
    got = ranked(df.withColumn("b", F.substring("h", 1, 1)), ["k"], ["h"], block="b").collect()
    for k in range(3):
        mine = sorted((r.h, r.rank) for r in got if r.k == k)
        assert [rank for _, rank in mine] == list(range(1, len(mine) + 1))


def test_bracket(spark):
    q = spark.createDataFrame([("c", p) for p in (0, 10, 25, 100)], "chrom string, pos bigint")
    t = spark.createDataFrame([("c", p) for p in (10, 20, 60)], "chrom string, pos bigint")
    got = {r.pos: (r.prev_pos, r.next_pos) for r in bracket(q, t, ["chrom"]).collect()}
    assert got == {0: (None, 10), 10: (10, 10), 25: (20, 60), 100: (60, None)}


def test_scalars(spark):
    row = spark.range(1).select(
        half_even(F.lit(2.5)).alias("a"), half_even(F.lit(3.5)).alias("b"), normalize_chrom(F.lit("CHRx")).alias("c"),
        normalize_chrom(F.lit("chrUn")).alias("d"), bp_label(F.lit(41828)).alias("e"), bp_label(F.lit(2_000_000)).alias("f"),
        bp_label(F.lit(12)).alias("g"), patient_id(F.lit("TCGA-AB-1234-01A-01D-A1B2-05")).alias("h"),
        stable_seed(42, F.lit("s1")).alias("i")).first()
    import hashlib
    assert tuple(row) == (2, 4, "chrX", None, "41.83kb", "2mb", "12bp", "TCGA-AB-1234",
                          int(hashlib.sha256(b"42:s1").hexdigest()[:8], 16))


@pytest.mark.parametrize("bad", ["", "AB-1234-01A", "TCGA-AB-123-01A", "TCGA-A-1234-01A", "TCGA-AB-1234"])
def test_bad_barcodes(spark, bad):
    with pytest.raises(PySparkException):
        spark.createDataFrame([(bad,)], "s string").select(patient_id("s")).collect()


def test_duplicates_and_betas_raise(spark):
    dup = spark.createDataFrame([("a",), ("a",)], "sample string")
    with pytest.raises(PySparkException):
        C.require_unique(dup, "sample").collect()
    with pytest.raises(PySparkException):
        C.validate_beta(spark.createDataFrame([(1.2,)], "beta double")).collect()
    with pytest.raises(ValueError):
        C.validate_layout(500, 1000, 300)


def test_region_context_keeps_empty_regions(spark):
    regions = spark.createDataFrame([("s", "t", "chr1", 0, 100), ("s", "t", "chr2", 0, 10)],
                                    "sample_id string, tool string, chrom string, start bigint, end bigint")
    points = spark.createDataFrame([("s", "chr1", p, p + 2, b) for p, b in ((0, 0.1), (50, 0.2), (99, 0.8), (100, 0.9))],
                                   "sample_id string, chrom string, start bigint, end bigint, beta double")
    got = {r.chrom: r for r in P.region_context(regions, points).collect()}
    one = got["chr1"]
    assert (one.n_points, one.n_low, one.n_intermediate, one.n_high) == (3, 1, 1, 1)
    assert one.median == 0.2 and abs(one.std - statistics.stdev([0.1, 0.2, 0.8])) < 1e-12
    assert got["chr2"].n_points == 0 and got["chr2"]["mean"] is None and got["chr2"].pct_low is None


def test_scoring_edge_rules(spark):
    s = "sample_id string, chrom string, start bigint, end bigint"
    sizes = spark.createDataFrame([("chr1", 10_000)], "chrom string, size bigint")
    truth = B.tag_truth(spark.createDataFrame([("s", "chr1", 1000, 2000), ("s", "chr1", 5000, 6000)], s))
    calls = B.tag_calls(spark.createDataFrame(
        [("s", "a", "chr1", 900, 1500), ("s", "a", "chr1", 1600, 2000), ("s", "b", "chr1", 8000, 8100), ("s", "c", "chr1", 5000, 5100)],
        "sample_id string, tool string, chrom string, start bigint, end bigint"))
    pairs = B.score_pairs(truth, calls, 100, sizes)
    first = {r.recall_id: r for r in pairs.where("tool = 'a'").collect()}
    # the call starts 100 early and ends 500 early: used slop 100 - 100 = 0
    assert (first["R1"].used_slop_bp, first["R1"].denom, first["R1"].slop_overlap_bp) == (0, 1000, 600)
    assert first["R1"].orig_overlap_bp == 500 and first["R1"].mabe_bp == 300.0
    res = {(r.tool, r.hit_level): r for r in B.region_resolution(pairs, B.caller_sizes(truth, calls)).collect()}
    assert res["a", "any"].truth_hits == 1 and res["a", "any"].recalled_hits == 2 and res["a", "any"].recall == 0.5
    # tool b has no pair at all: zeros; tool c has a pair but no majority hit: F1 is null
    assert (res["b", "any"].recall, res["b", "any"].precision, res["b", "any"].f1) == (0.0, 0.0, 0.0)
    assert res["c", "majority"].recall == 0.0 and res["c", "majority"].f1 is None
    frag = {r.tool: r for r in B.fragmentation_absorption(pairs, B.caller_sizes(truth, calls)).collect()}
    assert frag["a"].fragmentation == 2.0 and frag["a"].absolute_fragmentation == 1.0 and frag["b"].fragmentation is None


def brute_ap_auc(rows):
    ranked_scores = sorted({s for _, s in rows}, reverse=True)
    p, n = sum(t for t, _ in rows), sum(1 - t for t, _ in rows)
    ap = prev = 0.0
    for s in ranked_scores:
        tp = sum(t for t, x in rows if x >= s)
        ap += (tp / p - prev) * tp / sum(1 for _, x in rows if x >= s)
        prev = tp / p
    wins = sum((a > b) + 0.5 * (a == b) for t, a in rows if t for u, b in rows if not u)
    return ap, wins / (p * n)


def test_ap_auc_with_ties(spark):
    r = random.Random(5)
    rows = [(r.randrange(2), r.randrange(6) / 5) for _ in range(80)]
    df = spark.createDataFrame([("Tumor" if t else "Normal", "Tumor" if s > 0.5 else "Normal", s) for t, s in rows],
                               "y_true string, y_pred string, y_score double").withColumn("g", F.lit(1))
    got = B.classification_metrics(df, ["g"]).first()
    ap, auc = brute_ap_auc(rows)
    assert abs(got.average_precision - ap) < 1e-9 and abs(got.roc_auc - auc) < 1e-9
    one_class = B.classification_metrics(df.where("y_true = 'Tumor'"), ["g"]).first()
    assert one_class.roc_auc is None and one_class.mcc == 0.0


def test_nearest_feature_rules(spark):
    regions = spark.createDataFrame([("s", "t", "chr1", 0, 10), ("s", "t", "chr1", 95, 150), ("s", "t", "chr1", 220, 230),
                                     ("s", "t", "chr9", 0, 5)],
                                    "sample_id string, tool string, chrom string, start bigint, end bigint")
    feats = spark.createDataFrame([("chr1", 20, 100, 1), ("chr1", 140, 200, 2)], "chrom string, start bigint, end bigint, feature_id bigint")
    got = {(r.chrom, r.start): (r.dist_to_feature, r.dist_to_boundary, r.nearest_feature_id)
           for r in L.nearest_feature(regions, feats).collect()}
    assert got == {("chr1", 0): (10, 10, 1), ("chr1", 95): (0, 5, 2), ("chr1", 220): (20, 20, 2), ("chr9", 0): (None, None, None)}


def test_association_zero_regions(spark):
    schema = "sample_id string, tool string, chrom string, start bigint, end bigint"
    regions = spark.createDataFrame([("s", "t", "chr1", 0, 10)], schema)
    feats = spark.createDataFrame([("chr1", 5, 100, 1)], "chrom string, start bigint, end bigint, feature_id bigint")
    callers = spark.createDataFrame([("s", "t"), ("s", "silent")], "sample_id string, tool string")
    got = L.association_scores(regions, feats, callers=callers).collect()
    assert {r.score for r in got if r.tool == "silent"} == {0.0} and len(got) == 26
    assert {r.metric: r.score for r in got if r.tool == "t"}["pct_regions_overlapping_lads"] == 1.0


def test_context_near_tile_edges(spark):
    edge = 1 << 20
    pos = [edge - 400, edge - 100, edge, edge + 300, edge + 2000]
    df = spark.createDataFrame([("s", "chr1", p, p + 2, i / 10) for i, p in enumerate(pos)],
                               "sample_id string, chrom string, start bigint, end bigint, beta double")
    got = {r.start: r for r in G.context_features(df, [1000]).collect()}
    assert len(got) == 5
    for p in pos:
        near = [i / 10 for i, q in enumerate(pos) if abs(q - p) <= 500]
        assert got[p].n_1000 == len(near) and abs(got[p].mean_1000 - sum(near) / len(near)) < 1e-9


def test_context_in_wide_windows(spark):
    rng = np.random.default_rng(1)
    pos = sorted(set(rng.integers(0, 9_000_000, 400).tolist()))
    beta = rng.random(len(pos)).round(3)
    df = spark.createDataFrame([("s", "chr1", p, p + 2, float(b)) for p, b in zip(pos, beta)],
                               "sample_id string, chrom string, start bigint, end bigint, beta double")
    out = G.context_features(df, [500_000, 4_000_000])
    assert "RangeFrame" not in out._jdf.queryExecution().toString()
    at = np.array(pos)
    for r in out.collect():
        for w in (500_000, 4_000_000):
            near = beta[abs(at - r.start) <= w // 2]
            assert r[f"n_{w}"] == len(near) and abs(r[f"mean_{w}"] - near.mean()) < 1e-12 and abs(r[f"std_{w}"] - near.std()) < 1e-7
            assert abs(r[f"fraction_high_{w}"] - (near > 0.8).mean()) < 1e-12
            assert abs(r[f"fraction_intermediate_{w}"] - ((near >= 0.2) & (near <= 0.7)).mean()) < 1e-12


def test_state_runs(spark):
    states = spark.createDataFrame([("s", "chr1", i * 10, x) for i, x in enumerate("aabbaaab")],
                                   "sample_id string, chrom string, start bigint, state string")
    got = sorted((r.start, r.end, r.state, r.n_points) for r in G.states_to_regions(states, ["a", "b"], min_points=2).collect())
    assert got == [(0, 12, "a", 2), (20, 32, "b", 2), (40, 62, "a", 3)]
