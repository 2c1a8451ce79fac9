"""Rankings, samples, task tables and overviews: plans and the cases that SQL on the tables does not reach."""

import pytest
from pyspark.sql import functions as F

from spanframe.operators import cleaning as C
from spanframe.operators import cohort as M
from spanframe.operators import ranking as W
from spanframe.operators import scoring as B
from spanframe.sources import files as S


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_chunks_of_keys_with_one_long_prefix(spark):
    keys = [f"a-prefix-longer-than-fifteen-characters-{i:05d}" for i in range(1003)] + ["a"] * 4
    out = W.manifest_chunks(spark.createDataFrame([(k,) for k in keys], "k string").repartition(5), "k", 10)
    got = sorted((r.k, r.chunk) for r in out.collect())
    assert [c for _, c in got] == [(i * 10 - 1) // len(keys) + 1 for i in range(1, len(keys) + 1)]
    assert "SinglePartition" not in plan(out)
    assert W.manifest_chunks(spark.createDataFrame([], "k string"), "k", 10).count() == 0


def test_samples_shuffle_about_their_size(spark):
    df = spark.range(200_000).select(F.col("id").cast("string").alias("k"))
    out = C.downsample(df, 300, ["k"], seed=3)
    want = sorted((r.h, r.k) for r in df.withColumn("h", F.md5(F.concat(F.lit("3|"), "k"))).orderBy("h").limit(300).collect())
    assert sorted(r.k for r in out.collect()) == sorted(k for _, k in want)
    assert C.downsample(df.limit(5), 300, ["k"]).count() == 5
    few = df.withColumn("p", F.when(F.col("k").cast("long") < 7, "small").otherwise("large"))
    assert {r.p: r["count"] for r in C.downsample(few, 50, ["k"], part=["p"]).groupBy("p").count().collect()} == {"small": 7, "large": 50}


def test_a_missing_or_unknown_set_is_a_wrong_one(spark):
    results = spark.createDataFrame([("t", "PMD"), ("t", "PMD"), ("t", "odd")], "task string, feature_set string")
    placed = spark.createDataFrame([("t", "c", 0, 0, "s")], "task string, cohort_id string, repeat int, fold int, sample_id string")
    patients = spark.createDataFrame([("s", "p")], "sample_id string, patient_id string")
    row = M.completed_run_checks(results, placed, {"PMD": 2, "CGI": 1}, patients).first()
    assert (row.n_rows, row.n_wrong_sets, row.ok) == (3, 2, False)


def test_overview_of_two_classes_and_of_a_class_without_rows(spark):
    rows = [("Normal", "Normal", [0.9, 0.1]), ("Tumor", "Normal", [0.6, 0.4]), ("Tumor", "Tumor", [0.2, 0.8]), ("Normal", "Tumor", [0.5, 0.5])]
    df = spark.createDataFrame(rows, "y_true string, y_pred string, scores array<double>")
    got = {r.metric: r.value for r in B.classification_overview(df, ["Normal", "Tumor"]).collect()}
    assert (got["n_test_samples"], got["n_classes"], got["accuracy"], got["roc_auc"]) == (4.0, 2.0, 0.5, 0.75)
    assert abs(got["average_precision"] - (1 + 2 / 3) / 2) < 1e-12 and got["macro_f1"] == 0.5
    three = df.withColumn("scores", F.concat("scores", F.array(F.lit(0.0))))
    got = {r.metric: r.value for r in B.classification_overview(three, ["Normal", "Tumor", "Other"]).collect()}
    assert got["roc_auc_ovr_macro"] is None


def test_a_task_without_one_of_its_tables(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "task string, x int")
    S.write_table(rows, f"{tmp_path}/results", header=True, partition_by=["task"])
    S.write_table(rows.where("task = 'a'"), f"{tmp_path}/regions", header=True, partition_by=["task"])
    tables, summary = S.collect_task_tables(spark, str(tmp_path), {"results": "x int", "regions": "x int"})
    assert sorted((r.task, r.x) for r in tables["results"].collect()) == [("a", 1), ("b", 2), ("b", 3)]
    with pytest.raises(Exception, match="missing regions of task b"):
        summary.collect()


def test_samples_by_type_and_of_tumours_only(spark):
    from spanframe.operators.randomize import select_samples
    samples = spark.createDataFrame([(f"s{i}", f"p{i % 2}", "Solid Tissue Normal" if i % 5 == 0 else "Primary Tumor") for i in range(60)] + [("s1", "p1", "Primary Tumor")],
                                    "sample string, project_id string, sample_type string")
    only = select_samples(samples, 20, 4, tumor_only=True)
    assert only.count() == 20 and only.where("sample_type <> 'Primary Tumor'").count() == 0 and only.columns == ["sample", "project_id", "sample_type", "is_anchor"]
    typed = select_samples(samples, 20, 4, by_type=True).groupBy("project_id", "sample_type").count().collect()
    assert len(typed) == 4 and all(r["count"] >= 4 for r in typed)
    assert select_samples(samples, 48, 4, tumor_only=True).select("sample").distinct().count() == 48
