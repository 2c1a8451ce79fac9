import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from spanframe.functions.draws import beta_quantiles, digamma, gamma_quantiles, gamma_shape
from spanframe.operators import cohort as M
from spanframe.operators import randomize as Z
from spanframe.operators import ranking as W
from spanframe.operators.cleaning import labelled_samples
from spanframe.operators.summaries import cohort_manifest


def cohort(spark, tumor, normal, mixed=0):
    rows = [(f"TCGA-AA-{i:04d}-01A", "Primary Tumor", "C1") for i in range(tumor)]
    rows += [(f"TCGA-BB-{i:04d}-11A", "Solid Tissue Normal", "C1") for i in range(normal)]
    rows += [(f"TCGA-AA-{i:04d}-11A", "Solid Tissue Normal", "C1") for i in range(mixed)]
    return spark.createDataFrame(rows, "sample string, sample_type string, project_id string")


def test_folds_of_twenty_patients(spark):
    samples = labelled_samples(cohort(spark, 10, 10, 1)).withColumn("cohort_id", F.col("project_id"))
    once = M.group_kfold(samples, 5, 10, 42)
    assert once.select("repeat", "fold").distinct().count() == 50
    assert M.fold_checks(once, 5).where("NOT ok").count() == 0
    again = M.group_kfold(samples.repartition(7), 5, 10, 42)
    assert once.exceptAll(again).count() == 0 and again.exceptAll(once).count() == 0


@pytest.mark.parametrize("column", ["patient_id", "binary_label", "cohort_id"])
def test_folds_need_complete_rows(spark, column):
    samples = labelled_samples(cohort(spark, 5, 5)).withColumn("cohort_id", F.col("project_id"))
    with pytest.raises(PySparkException):
        M.group_kfold(samples.withColumn(column, F.lit(None).cast("string")), 5, 1).collect()


def test_cohort_counts(spark):
    row = cohort_manifest(labelled_samples(cohort(spark, 5, 5, 1)), 5).first()
    assert (row.n_samples, row.n_patients, row.n_tumor_patients, row.n_normal_patients, row.n_mixed_label_patients) == (11, 10, 5, 6, 1)


def test_many_samples_of_one_patient_are_not_eligible(spark):
    one = [(f"TCGA-BB-0001-11{c}", "Solid Tissue Normal", "C1") for c in "ABCDE"]
    samples = cohort(spark, 5, 0).unionByName(spark.createDataFrame(one, "sample string, sample_type string, project_id string"))
    assert cohort_manifest(labelled_samples(samples), 5).count() == 0


def test_observed_point_filter(spark):
    values = {100: (None, None), 200: (0.2, None), 300: (0.3, 0.4)}
    rows = [(s, "chr1", p, p + 1, v) for p, both in values.items() for s, v in zip(("a", "b"), both)]
    beta = spark.createDataFrame(rows, "sample_id string, chrom string, start bigint, end bigint, beta double")
    regions = spark.createDataFrame([("none", "chr1", 90, 110), ("partial", "chr1", 190, 210), ("complete", "chr1", 190, 310)],
                                    "name string, chrom string, start bigint, end bigint")
    got = {r.name: r.training_observed_points for r in M.regions_by_observed_points(regions, M.observed_points(beta)).collect()}
    assert got == {"partial": 1, "complete": 2}
    assert [r.anchor_pos for r in M.observed_points(beta, 2).collect()] == [300]


def test_sampling_without_replacement(spark):
    twice = spark.createDataFrame([("chr1", 0, 5)] * 2, "chrom string, start bigint, end bigint")
    with pytest.raises(PySparkException, match="found 1 distinct"):
        Z.sample_regions(twice, 2).collect()


def test_all_null_feature(spark):
    train = spark.createDataFrame([(1.0, None, 1), (2.0, None, 0)], "a double, b double, label int")
    with pytest.raises(ValueError, match="'b'"):
        M.train_score(train, train, ["a", "b"], trees=2)


def test_quantiles():
    u = (np.arange(20_000) + 0.5) / 20_000
    for a, b in ((13, 1.5), (1.5, 13), (5, 5), (1.2, 20)):
        x = beta_quantiles(u, a, b)
        assert abs(x.mean() - a / (a + b)) < 1e-3
        assert abs(x.var() - a * b / ((a + b) ** 2 * (a + b + 1))) < 1e-3


def test_gamma_fit():
    assert abs(digamma(1.0) + 0.5772156649) < 1e-9
    x = gamma_quantiles((np.arange(50_000) + 0.5) / 50_000, 2.5, 1000.0)
    assert abs(gamma_shape(x.mean(), np.log(x).mean()) - 2.5) < 0.02


def test_permuted_blocks(spark, monkeypatch):
    monkeypatch.setattr(Z, "BLOCK_ROWS", 7)  # many blocks per chromosome
    regions = spark.createDataFrame([("s", "t", "chr1", i * 100, i * 100 + 10 + i % 7) for i in range(60)],
                                    "sample_id string, tool string, chrom string, start bigint, end bigint")
    sizes = spark.createDataFrame([("chr1", 50_000)], "chrom string, size bigint")
    permuted = Z.permute_null(regions, sizes, 4).cache()
    checks = Z.null_checks(regions, permuted, sizes).collect()
    assert len(checks) == 4 and all(r.ok for r in checks)
    assert permuted.exceptAll(Z.permute_null(regions.repartition(5), sizes, 4)).count() == 0
    with pytest.raises(PySparkException):
        Z.permute_null(regions, sizes.withColumn("size", F.lit(10)), 1).collect()


def test_null_summary_cases(spark):
    observed = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("c", 3.0)], "k string, score double")
    nulls = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 0.0), ("b", 0.0), ("c", 3.0)], "k string, score double")
    got = {r.k: r for r in Z.null_summary(observed, nulls, ["k"]).collect()}
    assert got["a"].enrichment == 2.0 and got["a"].z_score is None
    assert got["b"].enrichment == float("inf")
    assert got["c"].z_score == 0.0 and got["c"].null_sd == 0.0


def test_shortfalls_raise(spark):
    regions = spark.createDataFrame([("chr1", 0, 10, 2, 10), ("chr1", 20, 30, 1, 10)], "chrom string, start bigint, end bigint, sample_count bigint, length bigint")
    assert W.recurrent_top(regions, 2).count() == 2
    with pytest.raises(Exception, match="asked for 3 regions, found 2"):
        W.recurrent_top(regions, 3).collect()
    samples = spark.createDataFrame([(f"s{i}", f"p{i % 2}", "Primary Tumor") for i in range(10)], "sample string, project_id string, sample_type string")
    with pytest.raises(ValueError, match="asked for 50 samples, found 10"):
        Z.select_samples(samples, 50, 2)


def test_components_of_samples_by_population_std(spark):
    import numpy as np
    rng = np.random.default_rng(2)
    x = rng.random((12, 5))
    df = spark.createDataFrame([(f"s{i}", *map(float, row)) for i, row in enumerate(x)], "sample_id string, a double, b double, c double, d double, e double")
    out, ratios = M.sample_pca(df.select("sample_id", F.array(*"abcde").alias("features")))
    z = (x - x.mean(0)) / x.std(0)
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    want = {f"s{i}": abs(u[i, :2] * s[:2]) for i in range(12)}
    for r in out.collect():
        assert np.allclose([abs(r.pc1), abs(r.pc2)], want[r.sample_id])
    assert np.allclose(ratios, (s ** 2 / (s ** 2).sum())[:2])


def test_holdout_raises_on_missing_values(spark):
    train = spark.createDataFrame([("a", 0.1, 0), ("b", None, 1)], "sample_id string, x double, label int")
    train = train.withColumn("features", F.array("x"))
    with pytest.raises(Exception, match="missing values"):
        M.holdout_classifier(train, train, ["n", "t"])
