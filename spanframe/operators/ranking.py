"""Ranking, ordering, lookup, key and comparison tables."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanframe.functions import safe_divide
from spanframe.operators.scan import ranked
from spanframe.session import materialize

# Parts of metric names where a lower value is better.
LOWER_IS_BETTER = ("_mabe", "_distance_from_1", "avg_false_pmd_beta", "mean_false_pmds_called")
# Metrics whose best value is 1 -> the distance that orders them.
NEAR_ONE = {
    "fragmentation_mean": "fragmentation_distance_from_1_mean",
    "absorption_mean": "absorption_distance_from_1_mean",
    "absolute_fragmentation_mean": "absolute_fragmentation_distance_from_1_mean",
    "absolute_absorption_mean": "absolute_absorption_distance_from_1_mean",
}


def rank_configs(scores: DataFrame, group: str, config: str, order: Sequence[str]) -> DataFrame:
    """Configurations of each group ranked by the order columns, all descending,
    then by name. Score ranges are the blocks of the ranking."""
    block = (-F.floor(F.coalesce(F.col(order[0]), F.lit(-1e6)) * 1024)).cast("bigint")
    rows = scores.withColumn("_block", block)
    by = [*[F.desc_nulls_last(c) for c in order], config]
    return ranked(rows, [group], by, block="_block", name="rank").drop("_block")


def f1_like(df: DataFrame, group: str, config: str, member: str) -> DataFrame:
    """Mean recall, precision and F1 per configuration, over members."""
    p, r = F.col("bp_precision"), F.col("bp_recall")
    return (df.withColumn("_f", safe_divide(2 * p * r, p + r)).groupBy(group, config)
            .agg(F.countDistinct(member).alias("n_samples"), F.avg("_f").alias("mean_f1_like"),
                 F.avg(r).alias("mean_bp_recall"), F.avg(p).alias("mean_bp_precision")))


def end_overlap_mean(df: DataFrame, group: str, config: str, member: str, percent: str = "pct_regions_with_lad_at_either_end", count: str = "n_regions") -> DataFrame:
    """Mean percent of regions with a feature at either end, and mean number of regions, per configuration."""
    return df.groupBy(group, config).agg(F.countDistinct(member).alias("n_samples"), F.avg(percent).alias("mean_pct_lad_end_overlap"), F.avg(count).alias("mean_n_regions"))


def composite_mean(df: DataFrame, group: str, config: str, parts: Sequence[str]) -> DataFrame:
    """Means of the parts and their average, per configuration."""
    means = df.groupBy(group, config).agg(*[F.avg(c).alias(f"mean_{c}") for c in parts])
    total = reduce(lambda x, y: x + y, [F.col(f"mean_{c}") for c in parts])
    return means.withColumn("composite_score", total / len(parts))


def best_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]]) -> DataFrame:
    """First row per key in ``order`` ((column, descending)...); remaining columns
    break ties. ``min`` of a struct combines before the shuffle, so one heavy key
    is no heavy task."""
    rest = [c for c in df.columns if c not in keys]
    named = [c for c, _ in order]
    fields = [(-F.col(c) if down else F.col(c)).alias(f"_o{i}") for i, (c, down) in enumerate(order)]
    ties = [F.col(c) for c in rest if c not in named]
    packed = F.struct(*fields, *ties, *[F.col(c) for c in named])
    out = df.groupBy(*keys).agg(F.min(packed).alias("_b"))
    return out.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def recurrent_top(regions: DataFrame, n: int, exactly: bool = True) -> DataFrame:
    """The n regions found in most samples, longer first, then by position; fewer
    raises, or with ``exactly=False`` gives all there are."""
    top = regions.orderBy(F.desc("sample_count"), F.desc("length"), "chrom", "start").limit(n)
    if not exactly:
        return top
    found = top.agg(F.count("*").alias("_n")).select(F.when(F.col("_n") == n, True).otherwise(F.raise_error(
        F.concat(F.lit(f"asked for {n} regions, found "), F.col("_n").cast("string")))).cast("boolean").alias("_ok"))
    return top.crossJoin(F.broadcast(found)).where("_ok").drop("_ok")  # one row


def top_variance(features: DataFrame, n: int, feature: str = "region_index", sample: str = "sample_id",
                 value: str = "value") -> DataFrame:
    """The n features with the largest variance, as z-scores (0 where std is 0)."""
    stats = features.groupBy(feature).agg(F.var_samp(value).alias("variance"), F.avg(value).alias("_m"),
                                          F.stddev_pop(value).alias("_s"))
    top = stats.where("variance IS NOT NULL").orderBy(F.desc("variance"), feature).limit(n)
    z = F.when(F.col("_s") == 0, 0.0).otherwise(safe_divide(F.col(value) - F.col("_m"), "_s"))
    return features.join(top, feature).select(sample, feature, "variance", z.alias("z"))


def largest_gap(summary: DataFrame, subject: str, others: Sequence[str], scope: str = "cohort_id") -> DataFrame:
    """Per scope: the size where ``subject`` beats the best other set by most
    (smallest size on a tie). Scopes where it never wins are absent."""
    mine = summary.where(F.col("feature_set") == subject).select(scope, "n_features", F.col("mean").alias("subject_mean"))
    best = (summary.where(F.col("feature_set").isin(list(others))).groupBy(scope, "n_features")
            .agg(F.min(F.struct((-F.col("mean")).alias("m"), "feature_set")).alias("_b"))
            .select(scope, "n_features", F.col("_b.feature_set").alias("best_other_feature_set"),
                    (-F.col("_b.m")).alias("best_other_mean")))
    gap = mine.join(best, [scope, "n_features"]).withColumn("difference", F.col("best_other_mean") - F.col("subject_mean")) \
        .where("difference < 0")
    return (gap.groupBy(scope).agg(F.min(F.struct("difference", "n_features", "subject_mean", "best_other_feature_set",
                                                  "best_other_mean")).alias("g"))
            .select(scope, "g.*").withColumn("absolute_difference", F.abs("difference")))


def order_tools(summary: DataFrame, metric: str, priority: Sequence[str] = ()) -> DataFrame:
    """Tools in the metric's direction (near-1 metrics by distance), ties by fixed
    priority and name; adds ``position``."""
    column = NEAR_ONE.get(metric, metric)
    rising = re.search("|".join(map(re.escape, LOWER_IS_BETTER)), column)
    key = F.asc_nulls_last(column) if rising else F.desc_nulls_last(column)
    place = F.coalesce(F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("tool")), F.lit(0)) if priority \
        else F.lit(0)
    place = F.when(place == 0, len(priority) + 1).otherwise(place)
    by = Window.orderBy(key, place, "tool")  # one row per tool: a report table
    return summary.withColumn("position", F.row_number().over(by).cast("bigint"))


def order_cohorts(scores: DataFrame, cohorts: DataFrame, feature_set: str) -> DataFrame:
    """Cohorts by mean score of one feature set, then original rank; cohorts
    without scores come last. ``cohorts``: (cohort_id, original_rank)."""
    means = scores.where(F.col("feature_set") == feature_set).groupBy("cohort_id").agg(F.avg("mcc").alias("mean_score"))
    return cohorts.join(means, "cohort_id", "left").orderBy(F.desc_nulls_last("mean_score"), "original_rank")


def run_table(results: DataFrame) -> DataFrame:
    """Distinct (draw, repeat, fold, split) runs with a padded key and 0-based index."""
    runs = ["feature_draw", "repeat", "fold", "split"]
    distinct = results.select(*[F.col(c).cast("bigint") for c in runs]).distinct()
    keyed = distinct.withColumn("run_key", F.format_string("draw%02d|repeat%02d|fold%02d|split%04d", *runs)) \
        .withColumn("_b", F.struct("feature_draw", "repeat"))
    return ranked(keyed, [], runs, block="_b", name="column_index") \
        .withColumn("column_index", F.col("column_index") - 1).drop("_b")


def fold_choices(predictions: DataFrame, required: Sequence[str], n_features: int, feature_draw: int = 0,
                 only_complete: bool = False) -> DataFrame:
    """Feature sets available per fold, which required ones are missing, and whether all are there."""
    chosen = predictions.where((F.col("n_features") == n_features) & (F.col("feature_draw") == feature_draw))
    out = (chosen.groupBy("split", "repeat", "fold").agg(F.array_sort(F.collect_set("feature_set")).alias("feature_sets"))
           .withColumn("n_available", F.size("feature_sets").cast("bigint"))
           .withColumn("missing", F.array_except(F.array(*[F.lit(r) for r in required]), "feature_sets"))
           .withColumn("is_complete", F.size("missing") == 0))
    return out.where("is_complete") if only_complete else out


def lookup_summary(summary: DataFrame, metric: str, aliases: dict[str, str], **filters) -> DataFrame:
    """Rows of one metric (by name or alias) matching the filters, best first."""
    rows = summary.where(F.col("metric") == aliases.get(metric, metric))
    for column, value in filters.items():
        rows = rows.where(F.col(column) == value)
    return rows.orderBy(F.desc_nulls_last("mean"), "feature_set", "n_features")


def manifest_chunks(manifest: DataFrame, key: str, chunks: int) -> DataFrame:
    """1-based chunk of each manifest row in key order: chunk i holds rows
    floor((i-1)n/k) to floor(in/k).

    Spark samples the keys for range boundaries, so keys with one long common
    prefix still spread; a row's place is its place in its range after the rows of
    the ranges before. Only the ranges' sizes reach the driver.
    """
    held = materialize(manifest.repartitionByRange(key).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = sorted((r["_range"], r["n"]) for r in held.groupBy("_range").agg(F.count("*").alias("n")).collect())
    total, offsets = 0, []
    for number, n in sizes:
        offsets += [F.lit(number), F.lit(total).cast("bigint")]
        total += n
    if not total:
        return manifest.withColumn("chunk", F.lit(None).cast("bigint")).limit(0)
    place = F.create_map(*offsets)[F.col("_range")] + F.row_number().over(Window.partitionBy("_range").orderBy(key))
    return held.withColumn("chunk", F.floor((place * chunks - 1) / F.lit(total)).cast("bigint") + 1).drop("_range")


def stack_tools(tables: dict[str, DataFrame]) -> DataFrame:
    """All tools' regions in one table, with the tool name."""
    parts = [df.select("chrom", "start", "end").withColumn("tool", F.lit(name)) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def distinct_across(tables: Sequence[DataFrame]) -> DataFrame:
    """Distinct rows over shards."""
    return reduce(DataFrame.unionByName, tables).distinct()


# ----------------------------------------------------------- table comparison

def enrich(df: DataFrame, extra: DataFrame, on: Sequence[str], defaults: dict) -> DataFrame:
    """Left join with defaults for rows without a partner."""
    return df.join(extra, list(on), "left").na.fill(defaults)


def compare_runs(left: DataFrame, right: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Two runs side by side with deltas; a key occurring twice in a run raises."""
    def once(df: DataFrame, suffix: str) -> DataFrame:
        grouped = df.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.first(m).alias(f"{m}_{suffix}") for m in metrics])
        return grouped.withColumn("_n", F.when(F.col("_n") == 1, 1).otherwise(
            F.raise_error(F.lit("duplicate key in run")).cast("int"))).where("_n = 1").drop("_n")

    out = once(left, "left").join(once(right, "right"), list(keys), "full_outer")
    for m in metrics:
        out = out.withColumn(f"{m}_delta", F.col(f"{m}_right") - F.col(f"{m}_left"))
    return out


def expand_draws(results: DataFrame, deterministic: Sequence[str]) -> DataFrame:
    """Rows of deterministic feature sets repeated for every draw present in their
    run; an existing row of that draw wins."""
    run = ["cohort_id", "repeat", "fold", "split"]
    key = ["cohort_id", "feature_set", "feature_draw", "repeat", "fold", "split"]
    draws = results.select(*run, F.col("feature_draw").alias("_d")).distinct()
    fixed = results.where(F.col("feature_set").isin(list(deterministic)))
    copies = fixed.join(draws, run).where("_d <> feature_draw").withColumn("_first", F.lit(1)) \
        .withColumn("feature_draw", F.col("_d")).drop("_d")
    both = results.withColumn("_first", F.lit(0)).unionByName(copies)
    return best_per_key(both, key, [("_first", False)]).drop("_first")


def completeness(expected: DataFrame, names: dict[str, Sequence[str]], present: DataFrame) -> DataFrame:
    """Status per expected key: every row of ``expected`` with every combination
    of the listed ``names`` (tools, tracks: a few constants per column)."""
    grid = expected
    for column, values in names.items():
        grid = grid.withColumn(column, F.explode(F.array(*[F.lit(v) for v in values])))
    have = present.select(*grid.columns).distinct().withColumn("_have", F.lit(True))
    return grid.join(have, grid.columns, "left").withColumn(
        "status", F.when(F.col("_have"), "present").otherwise("missing")).drop("_have")
