"""Distance to, and association with, a feature track."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanframe.functions import f1_score, safe_divide
from spanframe.operators.points import region_mean
from spanframe.operators.medians import with_medians
from spanframe.operators.ranges import (boundaries, end_windows, merge_intervals, overlap_totals,
                                        overlaps_any, range_join)
from spanframe.operators.scan import bracket
from spanframe.session import materialize

NEAR_BP = 150_000
# Metric name -> (analysis mode, threshold in bp).
ASSOCIATION_METRICS = {
    "pct_regions_overlapping_lads": ("overlap", 0),
    "pct_regions_overlapping_lads_gte_150kb": ("overlap", NEAR_BP),
    "avg_distance_to_nearest_lad": ("distance", 0),
    "avg_distance_to_nearest_lad_boundary": ("distance", 0),
    "avg_distance_to_nearest_lad_boundary_non_overlapping": ("distance", 0),
    "avg_lads_per_overlapping_pmd": ("overlap", 0),
    "avg_lad_per_pmd": ("overlap", 0),
    "pct_regions_with_boundary_within_150kb_of_lad_boundary": ("distance", NEAR_BP),
    "pct_non_overlapping_regions_within_150kb_of_lad_boundary": ("distance", NEAR_BP),
    "pct_regions_sharing_lad": ("overlap", 0),
    "pmd_coverage_by_lads": ("overlap", 0),
    "pct_lads_overlapping": ("overlap", 0),
    "lad_coverage_by_pmds": ("overlap", 0),
}


def nearest_distance(queries: DataFrame, targets: DataFrame, keys: Sequence[str] = (), name: str = "distance") -> DataFrame:
    """Query positions (keys, chrom, pos) with the distance to the nearest target
    position; infinity where the chromosome has none."""
    part = [*keys, "chrom"]
    near = bracket(queries, targets, part)
    gap = F.least(F.col("pos") - F.col("prev_pos"), F.col("next_pos") - F.col("pos")).cast("double")
    return near.select(*part, "pos", F.coalesce(gap, F.lit(float("inf"))).alias(name))


def _nearest_edge(regions: DataFrame, features: DataFrame, feature_id: str) -> DataFrame:
    """``regions`` with the closest feature boundary to either end (``_best``: d, pos; ties by position) and its feature (``_fid``)."""
    edges = features.select("chrom", F.explode(F.array("start", "end")).alias("pos"), F.col(feature_id).alias("_fid"))
    edges = edges.groupBy("chrom", "pos").agg(F.min("_fid").alias("_fid"))
    ends = regions.select("chrom", F.explode(F.array("start", "end")).alias("pos"))
    near = bracket(ends, edges, ["chrom"])
    low = near.select("chrom", F.col("pos").alias("start"), F.col("prev_pos").alias("_p1"), F.col("next_pos").alias("_n1"))
    high = near.select("chrom", F.col("pos").alias("end"), F.col("prev_pos").alias("_p2"), F.col("next_pos").alias("_n2"))

    def candidate(at, edge):
        return F.when(F.col(edge).isNotNull(), F.struct(F.abs(F.col(at) - F.col(edge)).alias("d"), F.col(edge).alias("pos")))

    best = F.least(candidate("start", "_p1"), candidate("start", "_n1"), candidate("end", "_p2"), candidate("end", "_n2"))
    placed = regions.join(low, ["chrom", "start"]).join(high, ["chrom", "end"]).withColumn("_best", best)
    return placed.withColumn("pos", F.col("_best.pos")).join(edges, ["chrom", "pos"], "left").select(*regions.columns, "_best", "_fid")


def nearest_feature(regions: DataFrame, features: DataFrame, keys: Sequence[str] = ("sample_id", "tool"),
                    feature_id: str = "feature_id") -> DataFrame:
    """Per region: endpoint-to-endpoint distance to the nearest feature boundary,
    the same with 0 for overlapping regions, and the nearest feature's id.

    ``features`` are disjoint. Overlapping regions name the feature with the
    largest overlap, ties by id; others the closest boundary, ties by position.
    """
    coords = [*keys, "chrom", "start", "end"]
    placed = _nearest_edge(regions, features, feature_id)
    largest = (range_join(regions.select(*coords), features.select("chrom", "start", "end", F.col(feature_id).alias("id")))
               .groupBy(*coords).agg(F.min(F.struct((-F.col("overlap_bp")).alias("o"), F.col("b_id").alias("id"))).alias("_top")))
    joined = placed.join(largest, coords, "left")
    hit = F.col("_top").isNotNull()
    return joined.select(
        *regions.columns, F.when(hit, F.lit(0).cast("bigint")).otherwise(F.col("_best.d")).alias("dist_to_feature"),
        F.col("_best.d").alias("dist_to_boundary"), F.coalesce(F.col("_top.id"), F.col("_fid")).alias("nearest_feature_id"))


def boundary_metrics(regions: DataFrame, features: DataFrame, thresholds: Sequence[int],
                     keys: Sequence[str] = ("sample_id", "tool")) -> DataFrame:
    """Median nearest-boundary distance each way, and precision, recall, F1 of
    boundaries within each threshold, per key."""
    keys = list(keys)
    region_edges = materialize(boundaries(regions, keys), "edges")
    feature_edges = materialize(boundaries(features), "edges")
    # boundaries on a chromosome a key has no regions on are out of reach: they
    # count in the recall denominator only, so an equi-join on chrom is enough
    asked = region_edges.select(*keys, "chrom").distinct().join(feature_edges, "chrom")
    near = bracket(region_edges.select("chrom", "pos").distinct(), feature_edges, ["chrom"], distinct=True)
    forward = region_edges.join(near, ["chrom", "pos"]).withColumn(
        "d", F.least(F.col("pos") - F.col("prev_pos"), F.col("next_pos") - F.col("pos")))
    backward = bracket(asked, region_edges, [*keys, "chrom"], distinct=True).withColumn(
        "d", F.least(F.col("pos") - F.col("prev_pos"), F.col("next_pos") - F.col("pos")))
    total = feature_edges.agg(F.count("*").alias("n_feature_boundaries"))

    def side(df, median, hits):
        far = materialize(df.select(*keys, "d"), "distances")
        stats = far.groupBy(*keys).agg(F.count("*").alias(f"_{hits}"), *[F.count_if(F.col("d") <= t).alias(f"_{hits}_{t}") for t in thresholds])
        return with_medians(stats, far, keys, {median: F.col("d")}, written=True)

    out = (side(forward, "median_region_to_feature_bp", "near")
           .join(side(backward, "median_feature_to_region_bp", "reached"), keys, "left")
           .crossJoin(F.broadcast(total))  # one row
           .withColumnRenamed("_near", "n_region_boundaries"))
    for t in thresholds:
        out = out.withColumn(f"boundary_precision_{t}", safe_divide(f"_near_{t}", "n_region_boundaries")) \
            .withColumn(f"boundary_recall_{t}", safe_divide(F.coalesce(f"_reached_{t}", F.lit(0)), "n_feature_boundaries"))
    for t in thresholds:
        out = out.withColumn(f"boundary_f1_{t}", f1_score(f"boundary_precision_{t}", f"boundary_recall_{t}"))
    return out.drop("_reached", *[f"_{h}_{t}" for h in ("near", "reached") for t in thresholds])


def _touched(features: DataFrame, regions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Features each key's regions overlap, with the number of those regions.
    Both sides are merged, so pairs number at most regions + features per key."""
    coords = ["chrom", "start", "end"]
    pairs = range_join(regions.select(*keys, *coords), features.select(*coords), prefix="f_", split_long=False)
    return pairs.groupBy(*keys, "chrom", F.col("f_start").alias("start"), F.col("f_end").alias("end")).agg(
        F.count("*").alias("n_regions"))


def feature_association(regions: DataFrame, features: DataFrame, window_bp: int,
                        keys: Sequence[str] = ("sample_id", "tool")) -> DataFrame:
    """Regions with a feature in either end window, features touched, and regions
    that share a feature with another region."""
    if window_bp <= 0:
        raise ValueError("window_bp must be positive")
    keys = list(keys)
    merged, feats = materialize(merge_intervals(regions, keys), "merged"), materialize(merge_intervals(features), "features")
    windows = end_windows(merged, window_bp).select(
        *keys, "chrom", F.col("start").alias("_s"), F.col("win_start").alias("start"), F.col("win_end").alias("end"))
    matched = overlaps_any(windows, feats).select(*keys, "chrom", "_s").distinct().groupBy(*keys).agg(
        F.count("*").alias("regions_with_feature_at_either_end"))
    touched = materialize(_touched(feats, merged, keys), "touched")
    n_touched = touched.groupBy(*keys).agg(F.count("*").alias("features_touched"))
    sharing = overlaps_any(merged, touched.where("n_regions >= 2"), keys).groupBy(*keys).agg(
        F.count("*").alias("regions_sharing_feature"))
    out = merged.groupBy(*keys).agg(F.count("*").alias("n_regions"))
    for part in (matched, n_touched, sharing):
        out = out.join(part, keys, "left")
    counts = ["regions_with_feature_at_either_end", "features_touched", "regions_sharing_feature"]
    out = out.na.fill(0, counts).crossJoin(F.broadcast(feats.agg(F.count("*").alias("n_features"))))  # one row
    for name, total in zip(counts, ("n_regions", "n_features", "n_regions")):
        out = out.withColumn(f"pct_{name}", safe_divide(F.col(name) * 100.0, total))
        out = out.withColumn(f"not_{name}", F.col(total) - F.col(name))
    return out


def _details(regions: DataFrame, features: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(region details, regions of each feature per key), both from one join of regions and features."""
    coords = [*keys, "chrom", "start", "end"]
    spots = regions.groupBy(*coords).agg(F.count("*").alias("_copies"))
    pairs = materialize(range_join(spots, features.select("chrom", "start", "end", "feature_id"), prefix="f_"), "pairs")
    held = pairs.groupBy(*keys, "f_feature_id").agg(F.sum("_copies").alias("_regions"))
    top = F.min(F.struct((-F.col("overlap_bp")).alias("o"), F.col("f_feature_id").alias("id")))
    met = pairs.join(held, [*keys, "f_feature_id"]).groupBy(*coords).agg(
        F.count("*").alias("n_features"), F.sum("overlap_bp").alias("total_overlap_bp"), F.max(F.col("_regions") > 1).alias("shares_feature"), top.alias("_top"))
    near = _nearest_edge(spots.drop("_copies"), features, "feature_id")
    hit, length = F.col("_top").isNotNull(), F.col("end") - F.col("start")
    joined = regions.join(near, coords).join(met, coords, "left")
    out = joined.select(
        *regions.columns, F.coalesce("total_overlap_bp", F.lit(0)).alias("total_overlap_bp"), F.coalesce("n_features", F.lit(0)).alias("n_features"),
        F.coalesce("shares_feature", F.lit(False)).alias("shares_feature"),
        F.when(hit, F.lit(0).cast("bigint")).otherwise(F.col("_best.d")).alias("dist_to_feature"), F.col("_best.d").alias("dist_to_boundary"),
        F.coalesce(F.col("_top.id"), F.col("_fid")).alias("nearest_feature_id"), length.alias("region_length"),
        F.coalesce(safe_divide("total_overlap_bp", length), F.lit(0.0)).alias("overlap_fraction"), hit.alias("overlaps_feature"))
    return out, held


def region_detail(regions: DataFrame, features: DataFrame, keys: Sequence[str] = ("sample_id", "tool")) -> DataFrame:
    """Per region: feature overlap, number of features, distances, nearest id and
    whether it shares a feature with another region of its key. ``features``
    carry a ``feature_id`` and are disjoint."""
    return _details(regions, features, list(keys))[0]


def association_scores(regions: DataFrame, features: DataFrame, keys: Sequence[str] = ("sample_id", "tool"),
                       callers: DataFrame | None = None) -> DataFrame:
    """The 13 association metrics per key in long form, with mode, threshold and
    the number of regions passing. A key without regions scores 0 throughout."""
    keys = list(keys)
    detail, held = _details(regions, features, keys)
    n_touched = held.groupBy(*keys).agg(F.count("*").alias("_features_hit"))
    near, free = F.col("dist_to_boundary") <= NEAR_BP, F.col("dist_to_feature") > 0
    has = F.col("dist_to_boundary").isNotNull()
    hit = F.col("overlaps_feature")
    agg = detail.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.count_if(hit).alias("_hit"),
        F.count_if(F.col("total_overlap_bp") >= NEAR_BP).alias("_hit_long"),
        F.avg("dist_to_feature").alias("_d"), F.avg("dist_to_boundary").alias("_db"),
        F.avg(F.when(free, F.col("dist_to_boundary"))).alias("_db_free"),
        F.avg(F.when(hit, F.col("n_features"))).alias("_per_hit"), F.avg("n_features").alias("_per"),
        F.count_if(has).alias("_has"), F.count_if(has & near).alias("_near"),
        F.count_if(free & has).alias("_free_has"), F.count_if(free & has & near).alias("_free_near"),
        F.count_if(F.col("shares_feature")).alias("_share"), F.sum("region_length").alias("_bp"),
        F.sum("total_overlap_bp").alias("_obp"))
    totals = features.agg(F.count("*").alias("_nf"), F.sum(F.col("end") - F.col("start")).alias("_fbp"))
    out = agg.join(n_touched, keys, "left").na.fill(0, ["_features_hit"])
    if callers is not None:
        out = callers.select(*keys).distinct().join(out, keys, "left")
    out = out.crossJoin(F.broadcast(totals))  # one row
    zero, none = F.lit(0.0), F.lit(None).cast("bigint")

    def part(top, bottom):
        return F.coalesce(safe_divide(top, bottom), zero)

    values = {
        "pct_regions_overlapping_lads": (part("_hit", "_n"), F.col("_hit")),
        "pct_regions_overlapping_lads_gte_150kb": (part("_hit_long", "_n"), F.col("_hit_long")),
        "avg_distance_to_nearest_lad": (F.col("_d"), none),
        "avg_distance_to_nearest_lad_boundary": (F.col("_db"), none),
        "avg_distance_to_nearest_lad_boundary_non_overlapping": (F.col("_db_free"), none),
        "avg_lads_per_overlapping_pmd": (F.coalesce("_per_hit", zero), none),
        "avg_lad_per_pmd": (F.coalesce("_per", zero), none),
        "pct_regions_with_boundary_within_150kb_of_lad_boundary": (part("_near", "_has"), F.col("_near")),
        "pct_non_overlapping_regions_within_150kb_of_lad_boundary": (part("_free_near", "_free_has"), F.col("_free_near")),
        "pct_regions_sharing_lad": (part("_share", "_hit"), F.col("_share")),
        "pmd_coverage_by_lads": (part("_obp", "_bp"), none),
        "pct_lads_overlapping": (part("_features_hit", "_nf"), F.col("_features_hit")),
        "lad_coverage_by_pmds": (part("_obp", "_fbp"), none),
    }
    empty = F.col("_n").isNull()
    rows = F.array(*[
        F.struct(F.lit(name).alias("metric"), F.lit(ASSOCIATION_METRICS[name][0]).alias("analysis_mode"),
                 F.lit(ASSOCIATION_METRICS[name][1]).alias("threshold_bp"),
                 F.when(empty, zero).otherwise(score).alias("score"),
                 F.when(empty, F.lit(0).cast("bigint")).otherwise(passing.cast("bigint")).alias("n_regions_passing"))
        for name, (score, passing) in values.items()])
    return out.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def overlap_by_sample(segments: DataFrame, features: DataFrame, keys: Sequence[str] = ("sample_id", "tool")) -> DataFrame:
    """Segments with feature overlap and the share of bp inside features, per key."""
    per = overlap_totals(segments, features.select("chrom", "start", "end"), (), count="_n", bp="_bp")
    return (per.groupBy(*keys).agg(
        F.count("*").alias("n_segments"), F.count_if(F.col("_bp") > 0).alias("segments_with_overlap"),
        F.sum(F.col("end") - F.col("start")).alias("total_bp"), F.sum("_bp").alias("feature_overlap_bp"))
        .withColumn("fraction_segments_with_overlap", safe_divide("segments_with_overlap", "n_segments"))
        .withColumn("fraction_bp_in_features", safe_divide("feature_overlap_bp", "total_bp")))


def filter_features_by_mean(features: DataFrame, points: DataFrame, minimum: float, sample: str = "sample_id") -> DataFrame:
    """Features whose mean (over samples of the per-sample means) reaches the
    minimum; all of them when none does."""
    place = [sample, "chrom", "start", "end"]
    pairs = range_join(points.select(*place, "beta"), features.select("chrom", "start", "end").distinct(), prefix="f_", split_long=False,
                       pack=(place, [F.sum("beta").alias("_s"), F.count("beta").alias("_n")]))
    per_sample = (pairs.groupBy(sample, "chrom", F.col("f_start").alias("start"), F.col("f_end").alias("end"))
                  .agg(safe_divide(F.sum("_s"), F.sum("_n")).alias("mean_beta")).where("mean_beta IS NOT NULL"))
    means = per_sample.groupBy("chrom", "start", "end").agg(F.avg("mean_beta").alias("mean_beta"))
    any_pass = means.agg(F.coalesce(F.max(F.col("mean_beta") >= minimum), F.lit(False)).alias("_any"))
    return (features.join(means, ["chrom", "start", "end"], "left").crossJoin(F.broadcast(any_pass))
            .where(~F.col("_any") | (F.col("mean_beta") >= minimum)).drop("_any"))


def feature_set_difference(features: DataFrame, a: DataFrame, b: DataFrame, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Features overlapped by ``a`` and not by ``b`` per key, with the number of a
    regions on them and an export name."""
    keys = list(keys)
    coords = ["chrom", "start", "end"]

    def hit(regions):
        pairs = range_join(regions.select(*keys, *coords), features.select(*coords, "feature_id"), prefix="f_")
        return pairs.groupBy(*keys, F.col("f_feature_id").alias("feature_id")).agg(F.count("*").alias("n_regions"))

    only = hit(a).join(hit(b).drop("n_regions"), [*keys, "feature_id"], "left_anti")
    return only.join(features.select("feature_id", *coords), "feature_id").withColumn(
        "name", F.concat_ws("_", *keys, F.lit("feature"), F.col("feature_id").cast("string")))
