import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanframe.operators import medians
from spanframe.operators.medians import long_medians, with_medians


@pytest.mark.parametrize("blocks,steps", [(256, 4096), (1, 3)])
def test_exact_medians(spark, monkeypatch, blocks, steps):
    monkeypatch.setattr(medians, "BLOCKS", blocks)
    monkeypatch.setattr(medians, "STEPS", steps)
    rng = np.random.default_rng(5)
    groups = {
        "even": rng.normal(size=2000).tolist(), "odd": rng.lognormal(0, 9, 1501).tolist(), "ties": rng.integers(-3, 4, 800).astype(float).tolist(), "one": [7.5], "two": [1.0, 2.0],
        "equal": [0.3] * 50, "zeros": [0.0, -0.0, 0.0], "signs": [-1e300, -1e-300, 0.0, 5e-324, 1e300, 4.0], "infinite": [float("-inf"), 1.0, 2.0, float("inf"), float("inf")],
        "close": [1 + k * 2**-52 for k in range(33)], None: [3.0, 1.0, 2.0, 9.0], "nulls": [None, None], "some": [None, 4.0, 2.0, None],
    }
    rows = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, value double").repartition(7)
    got = {r.k: r.median for r in long_medians(rows, ["k"]).collect()}
    want = {k: statistics.median(x) for k, vs in groups.items() if (x := [v for v in vs if v is not None])}
    assert got == want


def test_several_measures_at_once(spark):
    rows = spark.createDataFrame([(i % 3 or None, float(i), i * i, None) for i in range(50)], "k long, a double, b long, c double")
    stats = rows.groupBy("k").agg(F.count("*").alias("n"))
    got = {r.k: (r.n, r.ma, r.mb, r.mc) for r in with_medians(stats, rows, ["k"], {"ma": F.col("a"), "mb": F.col("b"), "mc": F.col("c")}).collect()}
    for k in (None, 1, 2):
        mine = [i for i in range(50) if (i % 3 or None) == k]
        assert got[k] == (len(mine), statistics.median(mine), statistics.median([i * i for i in mine]), None)


def test_no_buffer_of_values_in_the_plan(spark):
    from spanframe.operators.summaries import group_summary
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0)], "k string, x double")
    plan = group_summary(rows, ["k"], ["x"])._jdf.queryExecution().toString().lower()
    assert "percentile" not in plan and "median(" not in plan
