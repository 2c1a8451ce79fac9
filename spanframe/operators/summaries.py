"""Report tables: grouped summaries, matrices, comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.functions import nan_to_null, safe_divide
from spanframe.operators.medians import with_medians
from spanframe.operators.ranges import merge_intervals
from spanframe.session import materialize



def _length() -> Column:
    return F.col("end") - F.col("start")


def region_stats(regions: DataFrame, sizes: DataFrame, keys: Sequence[str] = ("sample_id", "tool")) -> DataFrame:
    """Merged regions per key: count, bp, genome coverage, length distribution."""
    genome = sizes.agg(F.sum("size").alias("_genome"))
    lengths = materialize(merge_intervals(regions, keys), "merged").withColumn("_l", _length())
    stats = lengths.groupBy(*keys).agg(
        F.count("*").alias("n_regions"), F.sum("_l").alias("total_bp"), F.avg("_l").alias("mean_length"),
        F.stddev_samp("_l").alias("std_length"), F.min("_l").alias("min_length"), F.max("_l").alias("max_length"))
    stats = with_medians(stats, lengths, keys, {"median_length": F.col("_l")})
    return (stats.crossJoin(F.broadcast(genome))  # one row
            .withColumn("genome_coverage_pct", 100.0 * F.col("total_bp") / F.col("_genome")).drop("_genome"))


def segment_summary(segments: DataFrame, keys: Sequence[str] = ("sample_id", "tool")) -> DataFrame:
    """Segments as given (not merged): count, bp, length distribution."""
    lengths = segments.withColumn("_l", _length())
    stats = lengths.groupBy(*keys).agg(
        F.count("*").alias("n_segments"), F.sum("_l").alias("total_bp"), F.avg("_l").alias("mean_length_bp"),
        F.min("_l").alias("min_length_bp"), F.max("_l").alias("max_length_bp"))
    return with_medians(stats, lengths, keys, {"median_length_bp": F.col("_l")})


def long_metrics(df: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Wide metrics -> (ids, metric, value); values that are no finite number become null."""
    cast = df.select(*ids, *[nan_to_null(F.col(m).try_cast("double")).alias(m) for m in metrics])
    return cast.unpivot(list(ids), list(metrics), "metric", "value")


def group_summary(df: DataFrame, key: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Per metric and key: rows used, mean, median, max, and rows excluded as null."""
    long = long_metrics(df, key, metrics)
    stats = long.groupBy("metric", *key).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"),
        F.max("value").alias("max"), F.count_if(F.col("value").isNull()).alias("n_excluded"))
    return with_medians(stats, long, ["metric", *key], {"median": F.col("value")})


def per_tool_summary(df: DataFrame, key: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row per key: mean, median, std, min, max of every metric, nulls skipped."""
    values = {m: nan_to_null(F.col(m).cast("double")) for m in metrics}
    aggs = []
    for m, v in values.items():
        aggs += [F.avg(v).alias(f"{m}_mean"), F.stddev_samp(v).alias(f"{m}_std"), F.min(v).alias(f"{m}_min"), F.max(v).alias(f"{m}_max")]
    return with_medians(df.groupBy(*key).agg(*aggs), df, key, {f"{m}_median": v for m, v in values.items()})


def cohort_manifest(samples: DataFrame, min_splits: int, include: Sequence[str] | None = None,
                    exclude: Sequence[str] | None = None, eligible_only: bool = True) -> DataFrame:
    """Sample and distinct patient counts per cohort and label, mixed-label
    patients, eligibility (enough patients of both labels)."""
    per_patient = samples.groupBy(F.col("project_id").alias("cohort_id"), "patient_id").agg(
        F.count_if(F.col("binary_label") == "Tumor").alias("t"), F.count_if(F.col("binary_label") == "Normal").alias("n"))
    counts = per_patient.groupBy("cohort_id").agg(
        F.sum(F.col("t") + F.col("n")).alias("n_samples"), F.sum("t").alias("n_tumor_samples"),
        F.sum("n").alias("n_normal_samples"), F.count("*").alias("n_patients"),
        F.count_if(F.col("t") > 0).alias("n_tumor_patients"), F.count_if(F.col("n") > 0).alias("n_normal_patients"),
        F.count_if((F.col("t") > 0) & (F.col("n") > 0)).alias("n_mixed_label_patients"))
    if include:
        counts = counts.where(F.col("cohort_id").isin(list(include)))
    if exclude:
        counts = counts.where(~F.col("cohort_id").isin(list(exclude)))
    ok = (F.col("n_tumor_patients") >= min_splits) & (F.col("n_normal_patients") >= min_splits)
    return counts.where(ok) if eligible_only else counts.withColumn("is_eligible", ok)


def classification_summary(scores: DataFrame, metrics: Sequence[str],
                           keys: Sequence[str] = ("feature_set", "n_features")) -> DataFrame:
    """Mean, std, n and sem of each metric per feature set and size."""
    return (long_metrics(scores, keys, metrics).groupBy(*keys, "metric")
            .agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count("value").alias("n"))
            .withColumn("sem", safe_divide("std", F.sqrt("n"))))


def summary_across_cohorts(summary: DataFrame, keys: Sequence[str] = ("feature_set", "n_features", "metric"),
                           cohort: str = "cohort_id") -> DataFrame:
    """Mean of cohort means, their std (null -> 0), number of cohorts, sem."""
    per_cohort = summary.groupBy(*keys, cohort).agg(F.avg("mean").alias("mean"))
    return (per_cohort.groupBy(*keys).agg(F.avg("mean").alias("mean_score"),
                                          F.coalesce(F.stddev_samp("mean"), F.lit(0.0)).alias("std"),
                                          F.count(cohort).alias("n_cohorts"))
            .withColumn("sem", safe_divide("std", F.sqrt("n_cohorts"))))


def metric_matrix(df: DataFrame, row: Sequence[str], column: str, values: Sequence[str], value: str = "mean") -> DataFrame:
    """Mean per (row, column) as a report matrix with a row mean, best rows first."""
    wide = df.groupBy(*row).pivot(column, list(values)).agg(F.avg(value))
    present = [F.col(f"`{v}`") for v in values]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in present[1:]), F.coalesce(present[0], F.lit(0.0)))
    n = sum((c.isNotNull().cast("int") for c in present[1:]), present[0].isNotNull().cast("int"))
    return wide.withColumn("row_mean", safe_divide(total, n)).orderBy(F.desc_nulls_last("row_mean"), *row)


def consistent_values(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """One value per key; several different ones raise."""
    return df.groupBy(*keys).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi")).select(
        *keys, F.when(F.col("_lo").eqNullSafe(F.col("_hi")), F.col("_lo"))
        .otherwise(F.raise_error(F.lit(f"inconsistent {column}"))).alias(column))


def runtime_ratio(runs: DataFrame, kinds: Sequence[str], key: str = "sample_id", kind: str = "hmm_type",
                  seconds: str = "runtime_sec") -> DataFrame:
    """Seconds per key and kind side by side, first over second; keys missing one are dropped."""
    first, second = kinds
    wide = runs.groupBy(key).pivot(kind, list(kinds)).agg(F.first(seconds, ignorenulls=True)).na.drop()
    return wide.withColumn("ratio", safe_divide(first, second))


def value_count_delta(original: DataFrame, randomized: DataFrame, column: str = "chrom") -> DataFrame:
    """Rows per value in both tables (0 when absent) and the difference."""
    a = original.groupBy(column).agg(F.count("*").alias("original"))
    b = randomized.groupBy(column).agg(F.count("*").alias("randomized"))
    return (a.join(b, column, "full_outer").na.fill(0, ["original", "randomized"])
            .withColumn("delta", F.col("randomized") - F.col("original")))


def sample_distribution(samples: DataFrame, by: str, id_column: str = "sample") -> DataFrame:
    """Distinct samples per value, most frequent first."""
    return (samples.select(id_column, by).distinct().groupBy(by).agg(F.count("*").alias("n_samples"))
            .orderBy(F.desc("n_samples"), by))


def null_table_average(real: DataFrame, nulls: DataFrame, keys: Sequence[str], value: str = "score") -> DataFrame:
    """Mean, std (null -> 0) and n over random repeats, and real minus random."""
    stats = nulls.groupBy(*keys).agg(F.avg(value).alias("random_mean"),
                                     F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("random_std"),
                                     F.count(value).alias("n_repeats"))
    return real.join(stats, list(keys), "left").withColumn("delta", F.col(value) - F.col("random_mean"))
