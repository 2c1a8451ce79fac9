"""Point measurements aggregated inside regions, bins and profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.functions import HIGH_CUTOFF, LOW_CUTOFF, safe_divide
from spanframe.operators.cleaning import validate_layout
from spanframe.operators.ranges import merge_intervals, overlap_totals, range_join, subtract
from spanframe.session import materialize


def _coords(keys: Sequence[str]) -> list[str]:
    return [*keys, "chrom", "start", "end"]


def _by_region(pairs: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """Aggregate (point, region) pairs per region, whose columns carry ``r_``."""
    return (pairs.groupBy(*keys, "chrom", "r_start", "r_end").agg(*aggs)
            .withColumnRenamed("r_start", "start").withColumnRenamed("r_end", "end"))


def region_context(regions: DataFrame, points: DataFrame, keys: Sequence[str] = ("sample_id",),
                   by: Sequence[str] = ("tool",), low: float = LOW_CUTOFF, high: float = HIGH_CUTOFF,
                   merged: bool = True, value: str = "beta") -> DataFrame:
    """Points by start in every region: count, mean, median, std, class counts and shares.

    ``keys`` join regions with points, ``by`` are further region keys. Regions
    without points stay, with nulls. With merged regions a point meets at most
    one region per ``by`` value. Each point takes exactly one bin, partial
    aggregates run before the shuffle, and the exact median holds one counter
    per distinct value.
    """
    part = [*keys, *by]
    distinct = regions.select(*_coords(part)).distinct()
    right = distinct.select(*keys, "chrom", *by, "start", "end")
    pairs = range_join(points.select(*keys, "chrom", "start", value), right, keys, rule="start", prefix="r_",
                       split_long=not merged)
    for c in by:
        pairs = pairs.withColumnRenamed(f"r_{c}", c)
    v = F.col(value)
    stats = _by_region(
        pairs, part, F.count("*").alias("n_points"), F.avg(v).alias("mean"), F.median(v).alias("median"),
        F.stddev_samp(v).alias("std"), F.count_if(v < low).alias("n_low"),
        F.count_if((v >= low) & (v <= high)).alias("n_intermediate"), F.count_if(v > high).alias("n_high"))
    counts = ["n_points", "n_low", "n_intermediate", "n_high"]
    out = regions.join(stats, _coords(part), "left").na.fill(0, counts)
    out = out.withColumn("region_length_bp", F.col("end") - F.col("start"))
    for c in ("low", "intermediate", "high"):
        out = out.withColumn(f"pct_{c}", safe_divide(F.col(f"n_{c}") * 100.0, "n_points"))
    return out


def missing_between_tools(regions: DataFrame, focus: Sequence[str], others: Sequence[str],
                          keys: Sequence[str] = ("sample_id",), tool: str = "tool") -> DataFrame:
    """For tool pairs of one ``focus`` and one other tool: pieces of ``tool`` that
    ``other_tool`` lacks, both directions."""
    merged = materialize(merge_intervals(regions, [*keys, tool]), "merged")
    names = [F.array(*[F.lit(n) for n in group]) for group in (others, focus)]
    opposite = F.when(F.col(tool).isin(list(focus)), names[0]).when(F.col(tool).isin(list(others)), names[1])
    asked = merged.withColumn("other_tool", F.explode(opposite))
    blockers = merged.withColumnRenamed(tool, "other_tool")
    return subtract(asked, blockers, [*keys, "other_tool"])


def missing_context(regions: DataFrame, points: DataFrame, focus: Sequence[str], others: Sequence[str],
                    keys: Sequence[str] = ("sample_id",), tool: str = "tool") -> DataFrame:
    pieces = materialize(missing_between_tools(regions, focus, others, keys, tool), "pieces")
    return region_context(pieces, points, keys, (tool, "other_tool"))


def region_mean(regions: DataFrame, points: DataFrame, keys: Sequence[str] = ("sample_id",),
                by: Sequence[str] = (), value: str = "beta", split_long: bool = False) -> DataFrame:
    """Mean over overlapping points; regions without any are absent.

    Points with equal coordinates are combined before the join, equal regions
    are joined once, so copies on either side never multiply.
    """
    part = [*keys, *by]
    packed = points.groupBy(*_coords(keys)).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    distinct = regions.select(*keys, "chrom", *by, "start", "end").distinct()
    pairs = range_join(packed, distinct, keys, prefix="r_", split_long=split_long)
    for c in by:
        pairs = pairs.withColumnRenamed(f"r_{c}", c)
    out = _by_region(pairs, part, safe_divide(F.sum("_s"), F.sum("_n")).alias("mean_beta"),
                     F.sum("_n").alias("n_points"))
    return out.where("n_points > 0")


def region_point_summary(regions: DataFrame, points: DataFrame, keys: Sequence[str] = ("sample_id",),
                         by: Sequence[str] = ("tool",), value: str = "beta") -> DataFrame:
    """Points by start in every region: count including missing values, mean over present ones."""
    part = [*keys, *by]
    packed = points.groupBy(*keys, "chrom", "start").agg(
        F.count("*").alias("_n"), F.sum(value).alias("_s"), F.count(value).alias("_v"))
    distinct = regions.select(*keys, "chrom", *by, "start", "end").distinct()
    pairs = range_join(packed, distinct, keys, rule="start", prefix="r_")
    for c in by:
        pairs = pairs.withColumnRenamed(f"r_{c}", c)
    stats = _by_region(pairs, part, F.sum("_n").alias("point_count"),
                       safe_divide(F.sum("_s"), F.sum("_v")).alias("mean_beta"))
    return regions.join(stats, _coords(part), "left").na.fill(0, ["point_count"])


def region_features(beta: DataFrame, regions: DataFrame, sample: str = "sample_id") -> DataFrame:
    """Long sample x region matrix of mean values; a region on a measured
    chromosome without any present value has a null row.

    Regions apply to every sample, so they are joined on position alone; Spark
    broadcasts the region side when it is below its size limit.
    """
    distinct = regions.select("region_index", "chrom", "start", "end")
    pairs = range_join(beta.where(F.col("beta").isNotNull()).select(sample, "chrom", "start", "end", "beta"), distinct,
                       prefix="r_", split_long=False)
    means = pairs.groupBy(sample, F.col("r_region_index").alias("region_index")).agg(F.avg("beta").alias("value"))
    grid = beta.select(sample, "chrom").distinct().join(distinct.select("chrom", "region_index"), "chrom").drop("chrom")
    return grid.join(means, [sample, "region_index"], "left")


def feature_matrix(features: DataFrame, region_indexes: Sequence[int], sample: str = "sample_id") -> DataFrame:
    """Wide form for reports and models: one column ``region_<i>`` per index."""
    wide = features.groupBy(sample).pivot("region_index", list(region_indexes)).agg(F.first("value"))
    for i in region_indexes:
        wide = wide.withColumnRenamed(str(i), f"region_{i}")
    return wide


def probe_values(signal: DataFrame, probes: DataFrame, id_column: str = "probe") -> DataFrame:
    """Length-weighted mean of a signal over each probe; probes without signal are absent."""
    pairs = range_join(signal, probes, prefix="p_")
    return pairs.groupBy(F.col(f"p_{id_column}").alias(id_column)).agg(
        safe_divide(F.sum(F.col("value") * F.col("overlap_bp")), F.sum("overlap_bp")).alias("value")) \
        .where("value IS NOT NULL")


def binned_track(points: DataFrame, bin_bp: int, keys: Sequence[str] = (), value: str = "beta") -> DataFrame:
    """Mean and count per fixed bin, with the bin's midpoint."""
    return (points.withColumn("bin", F.floor(F.col("start") / bin_bp).cast("bigint"))
            .groupBy(*keys, "chrom", "bin").agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
            .withColumn("midpoint", F.col("bin") * bin_bp + bin_bp // 2))


# Aggregates of the bin values over all regions.
PROFILE_STATISTICS = {"mean": F.avg, "median": F.median, "min": F.min, "max": F.max, "std": F.stddev_pop, "sum": F.sum}


def scaled_bins(regions: DataFrame, flank_bp: int, body_bp: int, bin_bp: int) -> DataFrame:
    """Per region: flank bins of ``bin_bp`` and body bins scaled to ``body_bp / bin_bp`` parts."""
    validate_layout(flank_bp, body_bp, bin_bp)
    flank_n, body_n = flank_bp // bin_bp, body_bp // bin_bp
    total = 2 * flank_n + body_n
    s, e, i = F.col("start"), F.col("end"), F.col("bin")
    b = i - flank_n
    length = e - s

    def edge(k: Column) -> Column:
        return F.when(k < 0, s + k * bin_bp).when(k > body_n, e + (k - body_n) * bin_bp) \
            .otherwise(s + F.floor(length * k / body_n)).cast("bigint")

    return (regions.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(total - 1))))
            .withColumn("bin_start", F.greatest(edge(b), F.lit(0).cast("bigint"))).withColumn("bin_end", edge(b + 1))
            .where("bin_end > bin_start"))


def scaled_profile(regions: DataFrame, signal: DataFrame, flank_bp: int, body_bp: int, bin_bp: int,
                   by: Sequence[str] = ("tool",), statistic: str = "mean", missing_as_zero: bool = False) -> DataFrame:
    """Average profile of a signal around regions: length-weighted value per
    (region, bin), then ``statistic`` per bin over regions."""
    bins = scaled_bins(regions.select(*by, "chrom", "start", "end").distinct(), flank_bp, body_bp, bin_bp)
    spans = bins.select("chrom", *by, F.col("start").alias("region_start"), F.col("end").alias("region_end"), "bin",
                        F.col("bin_start").alias("start"), F.col("bin_end").alias("end"))
    ids = ["chrom", *by, "region_start", "region_end", "bin"]
    values = (range_join(spans, signal).groupBy(*ids)
              .agg(safe_divide(F.sum(F.col("b_value") * F.col("overlap_bp")), F.sum("overlap_bp")).alias("value")))
    full = spans.select(*ids).join(values, ids, "left")
    if missing_as_zero:
        full = full.na.fill(0.0, ["value"])
    return full.groupBy(*by, "bin").agg(PROFILE_STATISTICS[statistic]("value").alias("value"),
                                        F.count("value").alias("n_regions"))


def overlap_categories(query: DataFrame, target: DataFrame, query_points: DataFrame, target_points: DataFrame,
                       threshold: int | float, keys: Sequence[str] = ("sample_id",), side: str = "query") -> DataFrame:
    """Per query region: how much of it ``target`` covers and its category.

    ``threshold``: an int is base pairs, a float a fraction of the region.
    ``side="query"`` labels shared / unique, ``side="target"`` labels captured /
    missed (regions the other platform does not recover).
    """
    if isinstance(threshold, bool) or threshold <= 0 or (isinstance(threshold, float) and threshold > 1):
        raise ValueError(f"threshold: {threshold!r}")
    coords = _coords(keys)
    merged = materialize(merge_intervals(target, keys), "merged")
    spots = materialize(query.select(*coords).distinct(), "spots")
    covered = overlap_totals(spots, merged, keys, count="_pieces", bp="covered_bp").drop("_pieces")
    counted = overlap_totals(spots, target, keys, count="n_overlaps", bp="_bp").drop("_bp")
    # the largest single overlap needs pairs; equal targets give the same overlap
    largest = (range_join(spots, target.select(*coords).distinct(), keys)
               .groupBy(*coords).agg(F.max("overlap_bp").alias("max_overlap_bp")))
    length = F.col("end") - F.col("start")
    fraction = F.col("covered_bp") / F.greatest(length, F.lit(1))
    enough = F.col("covered_bp") >= threshold if isinstance(threshold, int) else fraction >= threshold
    yes, no = ("shared", "unique") if side == "query" else ("captured", "missed")
    out = (query.join(covered, coords).join(counted, coords).join(largest, coords, "left").na.fill(0, ["max_overlap_bp"])
           .withColumn("region_length_bp", length)
           .withColumn("covered_fraction", fraction)
           .withColumn("category", F.when(enough, yes).otherwise(no))
           .withColumn("n_qualifying_overlaps", F.when(enough, F.col("n_overlaps")).otherwise(0)))
    own = region_point_summary(spots, query_points, keys, ()) \
        .withColumnRenamed("point_count", "n_query_points").withColumnRenamed("mean_beta", "avg_beta")
    other = region_point_summary(spots, target_points, keys, ()) \
        .select(*coords, F.col("point_count").alias("n_target_points"))
    reduction = 1.0 - F.try_divide(F.col("n_query_points").cast("double"), F.col("n_target_points").cast("double"))
    return (out.join(own, coords).join(other, coords)
            .withColumn("point_reduction_fraction",
                        F.when(F.col("n_target_points") > 0, F.least(F.greatest(reduction, F.lit(0.0)), F.lit(1.0)))))


def category_totals(categories: DataFrame, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Regions and bp per key and category, with an all-keys total row per category."""
    return (categories.withColumn("_len", F.col("end") - F.col("start")).rollup("category", *keys)
            .agg(F.count("*").alias("n_regions"), F.sum("_len").alias("bp"))
            .where("category IS NOT NULL"))


def signal_enrichment(regions: DataFrame, signal: DataFrame, peaks: DataFrame, sizes: DataFrame,
                      keys: Sequence[str] = ("tool",)) -> DataFrame:
    """Mean signal inside merged regions over the genome-wide mean, and the share
    of peak bp inside regions over the regions' share of the genome."""
    merged = materialize(merge_intervals(regions, keys), "merged")
    inside = (range_join(signal, merged.select("chrom", *keys, "start", "end"), prefix="r_")
              .groupBy(*[F.col(f"r_{k}").alias(k) for k in keys])
              .agg(safe_divide(F.sum(F.col("value") * F.col("overlap_bp")), F.sum("overlap_bp")).alias("region_mean")))
    width = F.col("end") - F.col("start")
    overall = signal.agg(safe_divide(F.sum(F.col("value") * width), F.sum(width)).alias("genome_mean"))
    merged_peaks = materialize(merge_intervals(peaks), "peaks")
    peak_total = merged_peaks.agg(F.sum(width).alias("peak_bp"))
    genome = sizes.agg(F.sum("size").alias("genome_bp"))
    shared = overlap_totals(merged, merged_peaks, (), count="_n", bp="_bp").groupBy(*keys).agg(
        F.sum(width).alias("region_bp"), F.sum("_bp").alias("peak_overlap_bp"))
    out = shared.join(inside, list(keys), "left")
    for one_row in (overall, peak_total, genome):
        out = out.crossJoin(F.broadcast(one_row))
    return (out.withColumn("signal_ratio", safe_divide("region_mean", "genome_mean"))
            .withColumn("peak_overlap_fraction", safe_divide("peak_overlap_bp", "peak_bp"))
            .withColumn("baseline_fraction", safe_divide("region_bp", "genome_bp"))
            .withColumn("peak_ratio", safe_divide("peak_overlap_fraction", "baseline_fraction")))
