"""Feature selection, grouped folds, models and their validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanframe.functions import key_hash, safe_divide
from spanframe.operators.ranges import count_points, merge_with_provenance
from spanframe.operators.scan import ranked
from spanframe.operators.scoring import multiclass_report
from spanframe.session import materialize


def observed_points(beta: DataFrame, min_samples: int = 1, sample: str = "sample_id") -> DataFrame:
    """Points with a value in at least ``min_samples`` samples, one anchor per midpoint."""
    counted = beta.where(F.col("beta").isNotNull()).groupBy("chrom", "start", "end").agg(
        F.countDistinct(sample).alias("n_observed")).where(F.col("n_observed") >= max(1, min_samples))
    middle = F.floor((F.col("start") + F.col("end")) / 2).cast("bigint")
    return counted.groupBy("chrom", middle.alias("anchor_pos")).agg(F.max("n_observed").alias("n_observed"))


def regions_by_observed_points(regions: DataFrame, anchors: DataFrame, min_points: int = 1) -> DataFrame:
    """Regions holding at least ``min_points`` anchors (start rule)."""
    points = anchors.select("chrom", F.col("anchor_pos").alias("start"))
    return count_points(regions, points, (), "training_observed_points").where(
        F.col("training_observed_points") >= max(1, min_points))


def training_regions(segments: DataFrame, folds: DataFrame, label: str, max_gap: int = 1000) -> DataFrame:
    """Merged regions of each fold's training samples of one label. ``folds`` has
    a row per (fold, sample) that is in training.

    The chosen rows are written first, so that Spark sees how few they are: a
    join by sample would sort all segments of a sample in one task.
    """
    chosen = folds.where((F.col("split") == "train") & (F.col("binary_label") == label)).select("fold", "sample_id")
    chosen = materialize(chosen, "training")
    return merge_with_provenance(segments.join(chosen, "sample_id"), ("fold",), "sample_id", max_gap)


def group_kfold(samples: DataFrame, k: int, repeats: int, seed: int = 42, cohort: str = "cohort_id") -> DataFrame:
    """Folds per (cohort, repeat): patients stay together, labels stay balanced.

    Patients are dealt round robin, in the order of a seeded hash, inside each
    stratum (tumor only, normal only, both); later strata start where the
    earlier ones stopped. Ranks come from hash blocks, never from one sorted
    group. Missing patients or labels raise.
    """
    required = ["sample", "patient_id", "binary_label", cohort]
    bad = F.lit(False)
    for c in required:
        bad = bad | F.col(c).isNull()
    # the check guards both join keys: a null filter on a key cannot run before it
    def guarded(column: str):
        return F.when(~bad, F.col(column)).otherwise(
            F.raise_error(F.lit("sample without patient, label or cohort")).cast("string"))

    checked = samples.select("sample", guarded("patient_id").alias("patient_id"), "binary_label",
                             guarded(cohort).alias(cohort))
    tumor, normal = (F.count_if(F.col("binary_label") == c) > 0 for c in ("Tumor", "Normal"))
    patients = checked.groupBy(cohort, "patient_id").agg(F.when(tumor & normal, 0).when(normal, 1).otherwise(2).alias("stratum"))
    part = [cohort, "repeat", "stratum"]
    repeated = (patients.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
                .withColumn("_h", key_hash(seed, "repeat", cohort, "patient_id")).withColumn("_b", F.substring("_h", 1, 3)))
    order = ranked(repeated, part, ["_h", "patient_id"], block="_b", name="_r")
    sizes = patients.groupBy(cohort).agg(F.count_if(F.col("stratum") == 0).alias("_n0"), F.count_if(F.col("stratum") == 1).alias("_n1"))
    shift = F.when(F.col("stratum") == 0, 0).when(F.col("stratum") == 1, F.col("_n0")).otherwise(F.col("_n0") + F.col("_n1"))
    dealt = order.join(sizes, cohort).withColumn("fold", F.pmod(F.col("_r") - 1 + shift, F.lit(k)).cast("bigint"))
    return checked.join(dealt.select(cohort, "patient_id", "repeat", "fold"), [cohort, "patient_id"])


def fold_checks(folds: DataFrame, k: int, cohort: str = "cohort_id") -> DataFrame:
    """Per (cohort, repeat): folds used, patients in several folds, samples placed
    other than once, folds whose test or training side lacks a class."""
    part = [cohort, "repeat"]
    split_patients = folds.groupBy(*part, "patient_id").agg(F.countDistinct("fold").alias("f")) \
        .groupBy(*part).agg(F.count_if(F.col("f") > 1).alias("n_split_patients"))
    placed = folds.groupBy(*part, "sample").agg(F.count("*").alias("c")) \
        .groupBy(*part).agg(F.count_if(F.col("c") != 1).alias("n_misplaced_samples"))
    per_fold = folds.groupBy(*part, "fold").agg(F.count_if(F.col("binary_label") == "Tumor").alias("tumor"),
                                                F.count_if(F.col("binary_label") == "Normal").alias("normal"))
    totals = per_fold.groupBy(*part).agg(F.sum("tumor").alias("all_tumor"), F.sum("normal").alias("all_normal"))
    one_sided = ((F.col("tumor") == 0) | (F.col("normal") == 0) | (F.col("all_tumor") == F.col("tumor"))
                 | (F.col("all_normal") == F.col("normal")))
    sides = per_fold.join(totals, part).groupBy(*part).agg(F.count("*").alias("n_folds"),
                                                           F.count_if(one_sided).alias("n_one_class_folds"))
    return (sides.join(split_patients, part).join(placed, part)
            .withColumn("ok", (F.col("n_folds") == k) & (F.col("n_one_class_folds") == 0)
                        & (F.col("n_split_patients") == 0) & (F.col("n_misplaced_samples") == 0)))


def split_validation(manifest: DataFrame, folds: DataFrame, k: int, repeats: int, cohort: str = "cohort_id") -> DataFrame:
    """Every eligible cohort: number of fold jobs and whether all checks hold."""
    checks = fold_checks(folds, k, cohort).groupBy(cohort).agg(
        F.sum("n_folds").alias("n_jobs"), F.min("ok").alias("folds_ok"))
    return manifest.select(cohort).join(checks, cohort, "left").na.fill(0, ["n_jobs"]).withColumn(
        "ok", F.coalesce(F.col("folds_ok"), F.lit(False)) & (F.col("n_jobs") == k * repeats)).drop("folds_ok")


def index_regions(sets: DataFrame, key: Sequence[str] = ("feature_set",)) -> DataFrame:
    """A 1-based ``region_index`` per set, in position order."""
    blocked = sets.withColumn("_b", F.struct("chrom", F.shiftright("start", 20).alias("t")))
    return ranked(blocked, list(key), ["start", "end"], block="_b", name="region_index").drop("_b")


def balanced_weights(train: DataFrame, label: str = "label") -> DataFrame:
    """Weight n / (classes * class size) per row."""
    counts = train.groupBy(label).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_t"), F.count("*").alias("_k"))
    weights = counts.crossJoin(F.broadcast(total)).select(  # one row
        label, safe_divide("_t", F.col("_k") * F.col("_n")).alias("weight"))
    return train.join(weights, label)


def check_training_features(train: DataFrame, columns: Sequence[str]) -> None:
    """A feature with no training value cannot be imputed."""
    row = train.agg(*[F.count(c).alias(c) for c in columns]).first()
    empty = [c for c in columns if not row[c]]
    if empty:
        raise ValueError(f"features without any training value: {empty}")


#: Spark's trees go no deeper; a forest without a depth limit is this deep at most.
DEEPEST = 30


def train_score(train: DataFrame, test: DataFrame, columns: Sequence[str], trees: int = 500, seed: int = 42,
                depth: int = DEEPEST) -> DataFrame:
    """Mean imputation fitted on the training side, balanced random forest, and the
    test samples' probability of Tumor (label 1)."""
    columns = list(columns)
    check_training_features(train, columns)
    weighted = balanced_weights(train)
    filled = [f"{c}_f" for c in columns]
    stages = [Imputer(inputCols=columns, outputCols=filled, strategy="mean"),
              VectorAssembler(inputCols=filled, outputCol="features"),
              RandomForestClassifier(labelCol="label", weightCol="weight", numTrees=trees, seed=seed,
                                     featureSubsetStrategy="sqrt", maxDepth=depth)]
    scored = Pipeline(stages=stages).fit(weighted).transform(test)
    return scored.withColumn("y_score", vector_to_array("probability")[1]).select(
        "sample_id", F.when(F.col("label") == 1, "Tumor").otherwise("Normal").alias("y_true"),
        F.when(F.col("prediction") == 1, "Tumor").otherwise("Normal").alias("y_pred"), "y_score")


def _vectors(df: DataFrame, features: str) -> DataFrame:
    """``_v``: the array of features as a vector; a missing value raises."""
    bad = F.exists(features, lambda x: x.isNull() | F.isnan(x))
    checked = F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit("features with missing values")).cast("array<double>")).otherwise(F.col(features))
    return df.withColumn("_v", array_to_vector(checked))


def sample_vectors(long: DataFrame, sample: str = "sample_id") -> tuple[DataFrame, int]:
    """((sample, features), number of samples) over the regions that every sample has a value of, in the order of their index."""
    n = long.select(sample).distinct().count()
    present = long.where(F.col("value").isNotNull())
    whole = present.groupBy("region_index").agg(F.count("*").alias("_n")).where(F.col("_n") == n).select("region_index")
    listed = present.join(whole, "region_index").groupBy(sample).agg(F.sort_array(F.collect_list(F.struct("region_index", "value"))).alias("_f"))
    return listed.select(sample, F.transform("_f", lambda x: x["value"]).alias("features")), n


def holdout_classifier(train: DataFrame, test: DataFrame, classes: Sequence[str], features: str = "features", trees: int = 300,
                       seed: int = 42, depth: int = DEEPEST) -> tuple[DataFrame, DataFrame]:
    """(report, predictions) of a scaled random forest with balanced class weights
    on a held-out set; ``label`` is the class index. A missing value raises."""
    stages = [StandardScaler(inputCol="_v", outputCol="_z", withMean=True),
              RandomForestClassifier(featuresCol="_z", labelCol="label", weightCol="weight", numTrees=trees, seed=seed, maxDepth=depth)]
    scored = Pipeline(stages=stages).fit(balanced_weights(_vectors(train, features))).transform(_vectors(test, features))
    names = F.array(*[F.lit(c) for c in classes])
    predictions = scored.select("sample_id", F.element_at(names, F.col("label").cast("int") + 1).alias("y_true"),
                                F.element_at(names, F.col("prediction").cast("int") + 1).alias("y_pred"),
                                vector_to_array("probability").alias("scores"))
    return multiclass_report(predictions, classes), predictions


def sample_pca(rows: DataFrame, components: int = 2, features: str = "features") -> tuple[DataFrame, list[float]]:
    """(sample components, explained ratios) of z-scored features (population std)
    after dropping those that no row has; a remaining missing value raises.
    Component signs are arbitrary.

    With more features than samples the components come from the samples' Gram
    matrix, so no task or driver holds features x features values."""
    rows = rows.where(F.exists(features, lambda x: x.isNotNull()))
    width = rows.agg(F.max(F.size(features)).alias("n")).first()["n"] or 0
    if width > rows.count():
        return _gram_pca(rows, components, features)
    # one counter a feature, over all rows
    held = rows.select(F.posexplode(features).alias("_i", "_x")).groupBy("_i").agg(F.count("_x").alias("_n")).where("_n > 0")
    kept = sorted(r["_i"] for r in held.select("_i").collect())
    if len(kept) < width:
        rows = rows.withColumn(features, F.array(*[F.col(features)[i] for i in kept]))
    scaler = StandardScaler(inputCol="_v", outputCol="_z", withMean=True, withStd=True)
    model = Pipeline(stages=[scaler, PCA(k=components, inputCol="_z", outputCol="_p")]).fit(_vectors(rows, features))
    parts = vector_to_array("_p")
    n = rows.count()
    factor = (n / (n - 1)) ** 0.5 if n > 1 else 1.0  # Spark scales by the sample std
    out = model.transform(_vectors(rows, features)).select("sample_id", *[(parts[i] * factor).alias(f"pc{i + 1}") for i in range(components)])
    return out, [float(x) for x in model.stages[-1].explainedVariance]


def _gram_pca(rows: DataFrame, components: int, features: str) -> tuple[DataFrame, list[float]]:
    """Components of few samples over many features: one row per feature, of the samples' z-scores, and its singular vectors."""
    samples = sorted(r["sample_id"] for r in rows.select("sample_id").distinct().collect())  # fewer than features
    long = rows.select("sample_id", F.posexplode(features).alias("_i", "_x"))
    listed = long.groupBy("_i").agg(F.sort_array(F.collect_list(F.struct("sample_id", "_x"))).alias("_c"))
    values = F.transform("_c", lambda c: c["_x"])
    held = listed.select("_i", values.alias("_c")).where(F.exists("_c", lambda x: x.isNotNull()))
    bad = (F.size("_c") < len(samples)) | F.coalesce(F.exists("_c", lambda x: x.isNull() | F.isnan(x)), F.lit(True))
    checked = held.withColumn("_c", F.when(bad, F.raise_error(F.lit("features with missing values")).cast("array<double>")).otherwise(F.col("_c")))
    zero, n = F.lit(0.0), float(len(samples))
    moved = checked.withColumn("_m", F.aggregate("_c", zero, lambda a, x: a + x) / n).withColumn("_c", F.transform("_c", lambda x: x - F.col("_m")))
    moved = moved.withColumn("_s", F.sqrt(F.aggregate("_c", zero, lambda a, x: a + x * x) / n))
    scaled = materialize(moved.select(F.transform("_c", lambda x: F.when(F.col("_s") > 0, x / F.col("_s")).otherwise(0.0)).alias("_z")), "scaled")
    total = scaled.agg(F.sum(F.aggregate("_z", zero, lambda a, x: a + x * x)).alias("t")).first()["t"]
    found = RowMatrix(scaled.select(F.col("_z")).rdd.map(lambda r: r["_z"]), numCols=len(samples)).computeSVD(components)
    size, turn = found.s.toArray(), found.V.toArray()
    places = [(s, *[float(turn[i, j] * size[j]) if j < len(size) else 0.0 for j in range(components)]) for i, s in enumerate(samples)]
    names = [f"pc{j + 1}" for j in range(components)]
    out = rows.sparkSession.createDataFrame(places, "sample_id string, " + ", ".join(f"{c} double" for c in names))
    return out, [float(size[j] ** 2 / total) if j < len(size) else 0.0 for j in range(components)]


def completed_run_checks(results: DataFrame, predictions: DataFrame, expected_rows: dict[str, int],
                         patients: DataFrame) -> DataFrame:
    """Per task: rows per feature set as expected (missing and unknown sets are wrong
    ones), patients in one fold per repeat, and the same folds as every other task
    of the cohort."""
    want = F.array(*[F.struct(F.lit(k).alias("feature_set"), F.lit(n).cast("bigint").alias("want")) for k, n in expected_rows.items()])
    wanted = results.select("task").distinct().select("task", F.explode(want).alias("w")).select("task", "w.*")
    rows = results.groupBy("task", "feature_set").agg(F.count("*").alias("n")).join(wanted, ["task", "feature_set"], "full").na.fill(0, ["n"]) \
        .withColumn("_bad", F.coalesce(F.col("n") != F.col("want"), F.lit(True)))
    counts = rows.groupBy("task").agg(F.sum("n").alias("n_rows"), F.count_if(F.col("_bad")).alias("n_wrong_sets"))
    placed = predictions.select("task", "cohort_id", "repeat", "fold", "sample_id").distinct().join(patients, "sample_id")
    leaks = placed.groupBy("task", "repeat", "patient_id").agg(F.countDistinct("fold").alias("f")) \
        .groupBy("task").agg(F.count_if(F.col("f") > 1).alias("n_leaking_patients"))
    tasks = placed.groupBy("cohort_id").agg(F.countDistinct("task").alias("_tasks"))
    same = placed.groupBy("cohort_id", "repeat", "fold", "sample_id").agg(F.collect_set("task").alias("_t")) \
        .join(tasks, "cohort_id").where(F.size("_t") < F.col("_tasks")) \
        .withColumn("task", F.explode("_t")).groupBy("task").agg(F.count("*").alias("n_fold_differences"))
    out = counts.join(leaks, "task", "left").join(same, "task", "left").na.fill(0, ["n_leaking_patients", "n_fold_differences"])
    return out.withColumn("ok", (F.col("n_wrong_sets") == 0) & (F.col("n_leaking_patients") == 0) & (F.col("n_fold_differences") == 0))
