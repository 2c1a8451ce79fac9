"""Registered queries against their SQL on the small tables. FULL_SQL=1 runs all."""

import os

import pytest

import __spark_entry__ as entry
from tools.check_sql import compare, connect

SF_DIR = "/root/testdata/sf0.001"
CORE = ["merge_intervals", "subtract", "overlap_pairs", "points_in_any_region", "consensus_regions", "region_context",
        "region_resolution", "point_confusion", "nearest_feature", "classification_metrics", "group_kfold", "tag_intervals"]
SQL = entry.oracle_sql()


@pytest.mark.parametrize("name", list(SQL) if os.environ.get("FULL_SQL") else CORE)
def test_query_matches_sql(spark, name):
    got = entry.queries()[name](spark, SF_DIR).toPandas()
    verdict = compare(got, connect(SF_DIR).sql(SQL[name]).df())
    assert verdict.startswith("ok"), verdict


def test_entry(spark):
    assert entry.entry(spark).count() > 0
