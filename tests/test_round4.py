"""Tables that are far larger in memory than their files tell."""

import re

import numpy as np
from pyspark.sql import functions as F

from spanframe.operators import fold_features as FF
from spanframe.operators import ranges as R
from spanframe.session import materialize
from spanframe.sources.files import load_matrix


def joins(df):
    """(kind, first lines below) of every join of a plan."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"(SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin) \[([^\]]*)\]", text)


def test_repeated_regions_are_counted_without_a_broadcast(spark):
    rng = np.random.default_rng(4)
    at = sorted({int(x) for x in rng.integers(0, 3 << 20, 300)})
    kept = [("chr1", x, x + int(n)) for x, n in zip(at, rng.integers(1, 90_000, len(at)))]
    regions = materialize(spark.createDataFrame(kept, "chrom string, start bigint, end bigint"), "regions")
    spread = regions.withColumn("split", F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))))
    spots = sorted({int(x) for x in rng.integers(0, 3 << 20, 500)} | {x for x in at[:50]} | {e for _, _, e in kept[:50]})
    anchors = materialize(spark.createDataFrame([(s, "chr1", x) for s in (0, 1) for x in spots if s or x % 2], "split bigint, chrom string, anchor_pos bigint"), "anchors")
    out = FF.observed_regions(spread, anchors)
    assert not [on for kind, on in joins(out) if kind == "BroadcastHashJoin" and ("start#" in on or "end#" in on)]
    want = {(s, a, b): n for s in (0, 1) for _, a, b in kept if (n := sum(a <= x < b for x in spots if s or x % 2))}
    assert {(r.split, r.start, r.end): r.training_observed_points for r in out.collect()} == want
    # regions that stand more than once, and points that do
    twice = R.count_points(spread.unionAll(spread), anchors.unionAll(anchors).withColumnRenamed("anchor_pos", "start"), ["split"])
    assert sorted((r.split, r.start, r.end, r.n_points) for r in twice.where("n_points > 0").collect()) == sorted((*k, 2 * n) for k, n in want.items() for _ in range(2))


def test_probes_are_not_broadcast(spark):
    probes = materialize(spark.createDataFrame([(i, "chr1", 700 * i, 700 * i + 1, f"cg{i}") for i in range(50)], "probe_idx bigint, chrom string, start bigint, end bigint, probe string"), "probes")
    arrays = spark.createDataFrame([("S1", i % 60, 255.0 if i == 7 else float(i)) for i in range(100)], "sample_id string, probe_idx bigint, raw double")
    out = load_matrix(arrays, probes)
    assert [kind for kind, _ in joins(out)] == ["SortMergeJoin"]
    rows = out.collect()
    assert len(rows) == 90 and [r.beta for r in rows if r.probe == "cg7"].count(None) == 1
