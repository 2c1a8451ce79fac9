"""Benchmark scoring of called regions against a truth set, for all samples and
tools in one job. ``truth`` is keyed by sample, ``calls`` by sample and tool."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.functions import f1_score, safe_divide
from spanframe.operators.cleaning import tag_intervals
from spanframe.operators.points import region_mean
from spanframe.operators.medians import with_medians
from spanframe.operators.ranges import (first_covers, flag_points, is_first_cover, merge_intervals, overlap_metrics, overlap_totals, overlaps_none,
                                        range_join, slop, tagged_depth)
from spanframe.operators.scan import prefix_scan
from spanframe.session import materialize

SAMPLE = ("sample_id",)
CALLER = ("sample_id", "tool")
# Share of a truth region a call must recover.
HIT_LEVELS = {"any": None, "majority": 0.50, "super_majority": 0.75}


def tag_truth(truth: DataFrame) -> DataFrame:
    return tag_intervals(truth, SAMPLE, "T").withColumnRenamed("id", "truth_id")


def tag_calls(calls: DataFrame) -> DataFrame:
    return tag_intervals(calls, CALLER, "R").withColumnRenamed("id", "recall_id")


def score_pairs(truth: DataFrame, calls: DataFrame, tolerance: int, sizes: DataFrame) -> DataFrame:
    """Pairs of tagged calls and tolerance-extended truth regions.

    Used slop is signed (a call inside the truth region lowers the denominator);
    the overlap with the unextended truth is plain arithmetic, not a second join.
    """
    wide = truth.select("sample_id", "chrom", "start", "end", "truth_id", F.col("start").alias("truth_start"),
                        F.col("end").alias("truth_end"), F.col("len").alias("truth_len"))
    if tolerance > 0:
        wide = slop(wide, tolerance, sizes)
    pairs = range_join(calls, wide, SAMPLE, prefix="t_")
    ts, te = F.col("t_truth_start"), F.col("t_truth_end")

    def used(column: Column) -> Column:
        return F.least(F.greatest(column, F.lit(-tolerance)), F.lit(tolerance))

    out = pairs.select(
        "sample_id", "tool", "chrom", F.col("t_truth_id").alias("truth_id"), "recall_id",
        ts.alias("truth_start"), te.alias("truth_end"), F.col("t_truth_len").alias("truth_len"),
        F.col("start").alias("recall_start"), F.col("end").alias("recall_end"), F.col("len").alias("recall_len"),
        F.col("overlap_bp").alias("slop_overlap_bp"),
        F.greatest(F.least(te, F.col("end")) - F.greatest(ts, F.col("start")), F.lit(0)).alias("orig_overlap_bp"),
        used(ts - F.col("start")).alias("left_slop_bp"), used(F.col("end") - te).alias("right_slop_bp"))
    pct = F.when(F.col("denom") > 0, safe_divide("slop_overlap_bp", "denom")).otherwise(F.lit(0.0))
    return (out.withColumn("used_slop_bp", F.col("left_slop_bp") + F.col("right_slop_bp"))
            .withColumn("denom", F.col("truth_len") + F.col("used_slop_bp"))
            .withColumn("truth_pct_overlap", pct)
            .withColumn("start_error_bp", F.abs(F.col("recall_start") - F.col("truth_start")))
            .withColumn("end_error_bp", F.abs(F.col("recall_end") - F.col("truth_end")))
            .withColumn("mabe_bp", (F.col("start_error_bp") + F.col("end_error_bp")) / 2.0)
            .withColumn("hit_any", F.col("slop_overlap_bp") >= 1)
            .withColumn("hit_majority", F.col("truth_pct_overlap") >= 0.50)
            .withColumn("hit_super_majority", F.col("truth_pct_overlap") >= 0.75))


def caller_sizes(truth: DataFrame, calls: DataFrame, callers: DataFrame | None = None) -> DataFrame:
    """(sample, tool, n_truth, n_calls) for every caller, also those without calls."""
    n_calls = calls.groupBy(*CALLER).agg(F.count("*").alias("n_calls"))
    if callers is not None:
        n_calls = callers.select(*CALLER).distinct().join(n_calls, list(CALLER), "left")
    n_truth = truth.groupBy(*SAMPLE).agg(F.count("*").alias("n_truth"))
    return n_calls.join(n_truth, list(SAMPLE), "left").na.fill(0, ["n_truth", "n_calls"])


def region_resolution(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per caller and hit level: recall, precision, F1, mean recovered share of a
    truth region (misses count 0) and mean boundary error of the best matches.

    The best match is the largest share, then the largest overlap, then the
    smallest id (as text): a ``min`` over a struct, so it combines map side.
    """
    levels = F.array(*[F.struct(F.lit(k).alias("hit_level"), F.col(f"hit_{k}").alias("hit")) for k in HIT_LEVELS])
    hits = pairs.withColumn("_l", F.explode(levels)).where("_l.hit").withColumn("hit_level", F.col("_l.hit_level"))
    key = [*CALLER, "hit_level"]
    best = F.min(F.struct((-F.col("truth_pct_overlap")).alias("pct"), (-F.col("slop_overlap_bp")).alias("bp"), "recall_id",
                          "mabe_bp"))
    by_truth = (hits.groupBy(*key, "truth_id").agg(best.alias("b")).groupBy(*key)
                .agg(F.count("*").alias("truth_hits"), F.sum(F.least(F.lit(1.0), -F.col("b.pct"))).alias("_share"),
                     F.avg("b.mabe_bp").alias("mabe")))
    by_call = hits.groupBy(*key, "recall_id").agg(F.lit(1)).groupBy(*key).agg(F.count("*").alias("recalled_hits"))
    paired = pairs.select(*CALLER).distinct().withColumn("_paired", F.lit(True))
    grid = sizes.withColumn("hit_level", F.explode(F.array(*[F.lit(k) for k in HIT_LEVELS])))
    out = (grid.join(by_truth, key, "left").join(by_call, key, "left").join(paired, list(CALLER), "left")
           .na.fill(0, ["truth_hits", "recalled_hits"]))
    recall, precision = safe_divide("truth_hits", "n_truth"), safe_divide("recalled_hits", "n_calls")
    no_pairs = F.col("_paired").isNull()
    return (out.withColumn("recall", F.when(no_pairs, 0.0).otherwise(recall))
            .withColumn("precision", F.when(no_pairs, 0.0).otherwise(precision))
            .withColumn("f1", F.when(no_pairs, 0.0).otherwise(f1_score("precision", "recall")))
            .withColumn("per_region_recall_fraction", safe_divide(F.coalesce("_share", F.lit(0.0)), "n_truth"))
            .select(*key, "n_truth", "n_calls", "truth_hits", "recalled_hits", "recall", "precision", "f1",
                    "per_region_recall_fraction", "mabe"))


def hit_level_for(threshold: float) -> str:
    return "any" if threshold <= 0 else "super_majority" if threshold >= 0.75 else "majority"


def point_confusion(points: DataFrame, truth: DataFrame, calls: DataFrame, tolerance: int, sizes: DataFrame,
                    callers: DataFrame | None = None) -> DataFrame:
    """Confusion counts over points (the ``bp_`` names count points, not bases).

    Points in the tolerance band around truth regions are left out. Points with
    equal coordinates are counted once and weighted.
    """
    weighted = points.groupBy(*SAMPLE, "chrom", "start", "end").agg(F.count("*").alias("w"))
    sets = {"is_truth": truth}
    if tolerance > 0:
        wide = slop(truth.select(*SAMPLE, "chrom", "start", "end"), tolerance, sizes)
        sets["_band"] = tagged_depth({"wide": wide, "inner": truth}, SAMPLE).where("wide > 0 AND inner = 0")
    scored = flag_points(weighted, sets, SAMPLE)
    if tolerance > 0:
        scored = scored.where("NOT _band").drop("_band")
    scored = materialize(scored, "scored")  # read for the totals and for the calls
    totals = scored.groupBy(*SAMPLE).agg(
        F.sum("w").alias("n"), F.coalesce(F.sum(F.when(F.col("is_truth"), F.col("w"))), F.lit(0)).alias("n_truth"))
    merged = first_covers(calls, CALLER)
    called = (range_join(scored, merged, SAMPLE, prefix="c_", split_long=False)
              .where(is_first_cover(F.col("start"), F.col("c_before"))).withColumnRenamed("c_tool", "tool").groupBy(*CALLER)
              .agg(F.sum("w").alias("n_pred"),
                   F.coalesce(F.sum(F.when(F.col("is_truth"), F.col("w"))), F.lit(0)).alias("bp_tp")))
    every = (callers if callers is not None else calls).select(*CALLER).distinct()
    out = every.join(totals, list(SAMPLE), "left").join(called, list(CALLER), "left") \
        .na.fill(0, ["n", "n_truth", "n_pred", "bp_tp"])
    out = (out.withColumn("bp_fp", F.col("n_pred") - F.col("bp_tp")).withColumn("bp_fn", F.col("n_truth") - F.col("bp_tp"))
           .withColumn("bp_tn", F.col("n") - F.col("n_truth") - F.col("n_pred") + F.col("bp_tp")))
    tp, fp, fn, tn = (F.col(f"bp_{k}") for k in ("tp", "fp", "fn", "tn"))
    return (out.withColumn("bp_precision", safe_divide(tp, tp + fp)).withColumn("bp_recall", safe_divide(tp, tp + fn))
            .withColumn("bp_f1", f1_score("bp_precision", "bp_recall"))
            .withColumn("bp_jaccard", safe_divide(tp, tp + fp + fn))
            .withColumn("bp_specificity", safe_divide(tn, tn + fp))
            .withColumn("bp_accuracy", safe_divide(tp + tn, "n"))
            .drop("n", "n_truth", "n_pred"))


def fragmentation_absorption(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Mean calls per truth region and truth regions per call, over hit ones and
    over all, with the distance from 1."""
    hits = pairs.where("hit_any")

    def side(one: str, other: str, prefix: str) -> DataFrame:
        per = hits.groupBy(*CALLER, one).agg(F.countDistinct(other).alias("_k"))
        return per.groupBy(*CALLER).agg(F.avg("_k").alias(prefix), F.sum("_k").alias(f"_{prefix}_sum"))

    out = (sizes.join(side("truth_id", "recall_id", "fragmentation"), list(CALLER), "left")
           .join(side("recall_id", "truth_id", "absorption"), list(CALLER), "left"))
    for name, n in (("fragmentation", "n_truth"), ("absorption", "n_calls")):
        total = F.coalesce(f"_{name}_sum", F.lit(0))
        out = (out.withColumn(f"absolute_{name}", safe_divide(total, n))
               .withColumn(f"{name}_distance_from_1", F.abs(F.col(name) - 1.0))
               .withColumn(f"absolute_{name}_distance_from_1", F.abs(F.col(f"absolute_{name}") - 1.0)).drop(f"_{name}_sum"))
    return out.drop("n_truth", "n_calls")


def directional_fragmentation(segments: DataFrame, first: str, second: str) -> DataFrame:
    """How one tool's segments split over the other's, both ways, per sample."""
    out = None
    for source, target in ((first, second), (second, first)):
        a = segments.where(F.col("tool") == source).select(*SAMPLE, "chrom", "start", "end")
        b = segments.where(F.col("tool") == target).select(*SAMPLE, "chrom", "start", "end")
        n = F.col("n_overlaps")
        counted = materialize(overlap_totals(a, b, SAMPLE), "overlaps").withColumn("_len", F.col("end") - F.col("start"))
        stats = (counted.groupBy(*SAMPLE)
                 .agg(F.count("*").alias("n_source_segments"), F.avg(n).alias("mean_target_overlaps"),
                      F.avg((n > 1).cast("double")).alias("fraction_split_gt1"),
                      F.avg((n > 0).cast("double")).alias("fraction_any_overlap"),
                      F.avg("overlap_bp").alias("mean_overlap_bp"),
                      F.avg(safe_divide("overlap_bp", "_len")).alias("mean_overlap_fraction")))
        stats = with_medians(stats, counted, SAMPLE, {"median_target_overlaps": n})
        every = segments.select(*SAMPLE).distinct()
        rows = (every.join(stats, list(SAMPLE), "left").na.fill(0, ["n_source_segments"])
                .withColumn("source_tool", F.lit(source)).withColumn("target_tool", F.lit(target)))
        out = rows if out is None else out.unionByName(rows)
    return out


def false_positive_regions(truth: DataFrame, calls: DataFrame, tolerance: int, sizes: DataFrame) -> DataFrame:
    """Calls that touch no tolerance-extended truth region."""
    wide = truth.select(*SAMPLE, "chrom", "start", "end")
    return overlaps_none(calls, slop(wide, tolerance, sizes) if tolerance > 0 else wide, SAMPLE)


def false_region_betas(false_regions: DataFrame, points: DataFrame) -> DataFrame:
    """False positive regions with their number of points and mean beta."""
    means = region_mean(false_regions, points, SAMPLE, ("tool",))
    on = [*CALLER, "chrom", "start", "end"]
    return false_regions.join(means, on, "left").na.fill(0, ["n_points"])


def recovery_metrics(truth: DataFrame, calls: DataFrame, points: DataFrame, tolerance: int, sizes: DataFrame) -> DataFrame:
    """One wide row per sample and tool from all scores above."""
    tagged_truth, tagged_calls = materialize(tag_truth(truth), "truth"), materialize(tag_calls(calls), "calls")
    pairs = materialize(score_pairs(tagged_truth, tagged_calls, tolerance, sizes), "pairs")
    counts = caller_sizes(tagged_truth, tagged_calls)
    measures = ["truth_hits", "recalled_hits", "recall", "precision", "f1", "per_region_recall_fraction", "mabe"]
    resolution = region_resolution(pairs, counts).groupBy(*CALLER).pivot("hit_level", list(HIT_LEVELS)).agg(
        *[F.first(m).alias(m) for m in measures])
    wrong = materialize(false_positive_regions(truth, calls, tolerance, sizes), "false")
    # a region's mean over its points, then the mean over regions that have points
    valued = points if "beta" in points.columns else points.withColumn("beta", safe_divide("meth", "coverage"))
    falses = false_region_betas(wrong, valued).groupBy(*CALLER).agg(
        F.count("*").alias("n_false_regions"), F.sum(F.col("end") - F.col("start")).alias("false_region_bp"), F.avg("mean_beta").alias("avg_false_pmd_beta"))
    on = list(CALLER)
    return (counts.join(resolution, on).join(fragmentation_absorption(pairs, counts), on)
            .join(point_confusion(points, truth, calls, tolerance, sizes), on)
            .join(falses, on, "left").na.fill(0, ["n_false_regions", "false_region_bp"]))


def bp_precision_recall(truth: DataFrame, calls: DataFrame, keys: Sequence[str] = SAMPLE) -> DataFrame:
    """Merged overlap over called bp and over truth bp."""
    m = overlap_metrics(truth, calls, keys)
    return (m.select(*keys, F.col("a_bp").alias("truth_bp"), F.col("b_bp").alias("called_bp"), "overlap_bp",
                     F.col("b_fraction").alias("precision"), F.col("a_fraction").alias("recall"))
            .withColumn("f1", f1_score("precision", "recall")))


# ----------------------------------------------------- classification scores

def classification_metrics(predictions: DataFrame, keys: Sequence[str], positive="Tumor", y_true: str = "y_true",
                           y_pred: str = "y_pred", y_score: str = "y_score") -> DataFrame:
    """Balanced accuracy, macro F1, MCC, average precision and ROC AUC per group,
    and the same five for always saying positive.

    The ranked scores come from counts per distinct score and a tiled running
    sum, so ties are exact and no group is sorted in one task. With one class
    only, AUC is null.
    """
    keys = list(keys)
    is_pos, said_pos = F.col(y_true) == positive, F.col(y_pred) == positive
    counts = predictions.groupBy(*keys).agg(
        F.count_if(is_pos & said_pos).alias("tp"), F.count_if(~is_pos & said_pos).alias("fp"),
        F.count_if(is_pos & ~said_pos).alias("fn"), F.count_if(~is_pos & ~said_pos).alias("tn"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    zero = F.lit(0.0)
    sensitivity, specificity = safe_divide(tp, tp + fn), safe_divide(tn, tn + fp)
    f1_pos = F.coalesce(safe_divide(2 * tp, 2 * tp + fp + fn), zero)
    f1_neg = F.coalesce(safe_divide(2 * tn, 2 * tn + fn + fp), zero)
    positives, negatives = tp + fn, fp + tn
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    base = counts.select(
        *keys, "tp", "fp", "fn", "tn",
        F.coalesce((sensitivity + specificity) / 2, sensitivity, specificity).alias("balanced_accuracy"),
        ((f1_pos + f1_neg) / 2).alias("macro_f1"),
        F.coalesce(safe_divide(tp * tn - fp * fn, root), zero).alias("mcc"),
        # a classifier that always says positive
        safe_divide(positives, positives + negatives).alias("always_positive_average_precision"),
        F.when((positives > 0) & (negatives > 0), 0.5).when(positives > 0, 1.0).otherwise(0.0).alias("always_positive_balanced_accuracy"),
        F.when(negatives == 0, 1.0).otherwise(positives / (2 * positives + negatives)).alias("always_positive_macro_f1"),
        zero.alias("always_positive_mcc"),
        F.when((positives > 0) & (negatives > 0), 0.5).alias("always_positive_roc_auc"))

    per_score = predictions.groupBy(*keys, (-F.col(y_score)).alias("pos")).agg(
        F.count_if(is_pos).alias("p"), F.count_if(~is_pos).alias("n"))
    ranked = prefix_scan(per_score, keys, sums=["p", "n"], tile=F.floor(F.col("pos") * 4096).cast("bigint"))
    above = F.col("p_before") + F.col("p")
    curves = ranked.groupBy(*keys).agg(
        F.sum("p").alias("_p"), F.sum("n").alias("_n"),
        F.sum(F.col("p") * above / (above + F.col("n_before") + F.col("n"))).alias("_ap"),
        F.sum(F.col("n") * (F.col("p_before") + F.col("p") / 2.0)).alias("_auc"))
    return (base.join(curves, keys).withColumn("average_precision", safe_divide("_ap", "_p"))
            .withColumn("roc_auc", safe_divide("_auc", F.col("_p") * F.col("_n"))).drop("_p", "_n", "_ap", "_auc"))


def confusion_matrix(predictions: DataFrame, classes: Sequence[str], y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """One row per true class, one column per predicted class."""
    wide = predictions.groupBy(y_true).pivot(y_pred, list(classes)).agg(F.count(F.lit(1)))
    return wide.na.fill(0, list(classes))


def multiclass_report(predictions: DataFrame, classes: Sequence[str], y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Precision, recall, F1 and support per class, then macro and micro rows."""
    truth, said = F.col(y_true), F.col(y_pred)
    per = (predictions.withColumn("class", F.explode(F.array(*[F.lit(c) for c in classes]))).groupBy("class")
           .agg(F.count_if((truth == F.col("class")) & (said == F.col("class"))).alias("tp"),
                F.count_if((truth != F.col("class")) & (said == F.col("class"))).alias("fp"),
                F.count_if((truth == F.col("class")) & (said != F.col("class"))).alias("fn")))
    zero = F.lit(0.0)
    scored = (per.withColumn("precision", F.coalesce(safe_divide("tp", F.col("tp") + F.col("fp")), zero))
              .withColumn("recall", F.coalesce(safe_divide("tp", F.col("tp") + F.col("fn")), zero))
              .withColumn("f1", F.coalesce(f1_score("precision", "recall"), zero))
              .withColumn("support", F.col("tp") + F.col("fn")))
    columns = ["class", "precision", "recall", "f1", "support"]
    macro = scored.agg(F.lit("macro").alias("class"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")],
                       F.sum("support").alias("support"))
    micro_p = safe_divide(F.sum("tp"), F.sum(F.col("tp") + F.col("fp")))
    micro_r = safe_divide(F.sum("tp"), F.sum(F.col("tp") + F.col("fn")))
    micro = scored.agg(F.lit("micro").alias("class"), micro_p.alias("precision"), micro_r.alias("recall"),
                       F.sum("support").alias("support")).withColumn("f1", f1_score("precision", "recall"))
    return scored.select(*columns).unionByName(macro.select(*columns)).unionByName(micro.select(*columns))


def class_counts(train: DataFrame, test: DataFrame, label: str = "label") -> DataFrame:
    """(split, label, count) of both sides."""
    sides = [df.groupBy(label).agg(F.count("*").alias("count")).select(F.lit(name).alias("split"), F.col(label).alias("label"), "count") for name, df in (("train", train), ("test", test))]
    return sides[0].unionByName(sides[1])


def classification_overview(predictions: DataFrame, classes: Sequence[str], y_true: str = "y_true", y_pred: str = "y_pred", scores: str = "scores") -> DataFrame:
    """(metric, value) rows: samples, classes, accuracy, macro and micro scores, and AUC and average
    precision: of the class named like ``normal`` (else the last) with two classes, else the macro mean
    of one against the rest. A mean over classes of which one has no rows, or all, is null."""
    report = multiclass_report(predictions, classes, y_true, y_pred)
    rest = one_vs_rest(predictions, classes, y_true, scores)
    totals = predictions.agg(F.count("*").cast("double").alias("n_test_samples"), F.lit(float(len(classes))).alias("n_classes"),
                             F.avg((F.col(y_true) == F.col(y_pred)).cast("double")).alias("accuracy"))
    wide = report.where(F.col("class").isin("macro", "micro")).groupBy().agg(*[
        F.max(F.when(F.col("class") == k, F.col(c))).alias(f"{k}_{c}") for k in ("macro", "micro") for c in ("f1", "precision")])
    if len(classes) == 2:
        one = next((c for c in classes if "normal" in c.lower()), classes[-1])
        ranks = rest.where(F.col("class") == one).groupBy().agg(F.max("roc_auc").alias("roc_auc"), F.max("average_precision").alias("average_precision"))
    else:
        whole = F.count("roc_auc") == len(classes)
        ranks = rest.groupBy().agg(F.when(whole, F.avg("roc_auc")).alias("roc_auc_ovr_macro"), F.when(whole, F.avg("average_precision")).alias("average_precision_macro"))
    every = totals.crossJoin(F.broadcast(wide)).crossJoin(F.broadcast(ranks))  # one row each
    return every.unpivot([], every.columns, "metric", "value")


def one_vs_rest(predictions: DataFrame, classes: Sequence[str], y_true: str = "y_true", scores: str = "scores") -> DataFrame:
    """AUC and average precision of each class against the rest; ``scores`` is an
    array in class order."""
    rows = predictions.select(F.col(y_true), F.posexplode(F.col(scores)).alias("_i", "y_score"))
    name = F.element_at(F.array(*[F.lit(c) for c in classes]), F.col("_i") + 1)
    rows = rows.withColumn("class", name).withColumn("y_pred", F.lit("rest")) \
        .withColumn("y_true", F.when(F.col(y_true) == F.col("class"), "one").otherwise("rest"))
    out = classification_metrics(rows, ["class"], positive="one")
    return out.select("class", "roc_auc", "average_precision")
