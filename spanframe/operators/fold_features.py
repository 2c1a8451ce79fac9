"""Region sets of every training fold, and the classification benchmark over them.

All folds, sizes and draws are rows of the same tables, keyed by ``split`` (the
number of a fold among all repeats): one plan makes every set, and no set sees a
test sample. Sizes are nested prefixes: a draw has one order of its regions, and the
set of size n is its first n.

Tables: ``assigned`` has a row per (repeat, sample) with the fold that tests it
(``sample_id, patient_id, binary_label, repeat, fold``); members have a row per
(split, sample) with ``is_test``; sets have a row per region,
``split, feature_set, n_features, feature_draw, region_index, chrom, start, end``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanframe.functions import key_hash, unit_hash
from spanframe.functions.draws import gamma_quantiles, gamma_shape
from spanframe.operators.cohort import DEEPEST, balanced_weights, index_regions
from spanframe.operators.points import region_features
from spanframe.operators.ranges import BIN_SHIFT, complement, count_points, label_points, mark_overlaps, merge_intervals, range_join
from spanframe.operators.scan import prefix_scan, ranked
from spanframe.operators.scoring import classification_metrics
from spanframe.session import materialize

SPLIT = ["split"]
SET = ["split", "feature_set", "n_features", "feature_draw"]
COORDS = ["chrom", "start", "end"]
#: The sets of one fold: recurrent regions, the same at random, islands, and random places of both lengths.
SETS = ["PMD", "Random PMD", "CGI", "Random long", "Random short"]
#: Attempts of each round; a slot without a place after all of them raises.
ROUNDS = (4, 12, 48, 192)


# --------------------------------------------------------------- training data

def fold_members(assigned: DataFrame, k: int) -> DataFrame:
    """Samples of every split, in training or in test."""
    folds = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    out = assigned.withColumn("_fold", folds)
    return out.select((F.col("repeat") * k + F.col("_fold")).cast("bigint").alias("split"), F.col("repeat").cast("bigint").alias("repeat"),
                      F.col("_fold").cast("bigint").alias("fold"), "sample_id", "patient_id", "binary_label",
                      (F.col("fold") == F.col("_fold")).alias("is_test"))


def fold_anchors(beta: DataFrame, assigned: DataFrame, k: int, repeats: int, min_samples: int = 1) -> DataFrame:
    """(split, chrom, anchor_pos): points observed in enough training samples of each split.

    A split's training count is the count over all samples less that over its
    test samples, so values are repeated once a repeat instead of once a split.
    """
    point = COORDS
    studied = assigned.select("sample_id").distinct()
    seen = beta.where(F.col("beta").isNotNull()).select("sample_id", *point).distinct().join(studied, "sample_id")
    total = seen.groupBy(*point).agg(F.count("*").alias("_all"))
    tests = assigned.select("sample_id", (F.col("repeat") * k + F.col("fold")).cast("bigint").alias("split"))
    tested = seen.join(tests, "sample_id").groupBy("split", *point).agg(F.count("*").alias("_test"))
    every = F.transform(F.sequence(F.lit(0), F.lit(k * repeats - 1)), lambda x: x.cast("bigint"))
    spread = total.select("*", F.explode(every).alias("split"))
    kept = spread.join(tested, ["split", *point], "left").where(F.col("_all") - F.coalesce("_test", F.lit(0)) >= max(1, min_samples))
    middle = F.floor((F.col("start") + F.col("end")) / 2).cast("bigint")
    return kept.select("split", "chrom", middle.alias("anchor_pos")).distinct()


def fold_regions(segments: DataFrame, members: DataFrame, label: str, max_gap: int = 1000) -> DataFrame:
    """Merged regions of each split's training samples of one label, with the number of samples that have one there."""
    chosen = members.where(~F.col("is_test") & (F.col("binary_label") == label)).select("split", "sample_id")
    mine = segments.select("sample_id", *COORDS).join(chosen, "sample_id")
    merged = merge_intervals(mine, SPLIT, max_gap)
    starts = mine.select("split", "chrom", "start", F.col("sample_id").alias("_member")).distinct()
    found = range_join(starts, merged, SPLIT, rule="start", prefix="m_", split_long=False)
    return (found.groupBy("split", "chrom", F.col("m_start").alias("start"), F.col("m_end").alias("end"))
            .agg(F.countDistinct("_member").alias("sample_count")).withColumn("length", F.col("end") - F.col("start")))


def observed_regions(regions: DataFrame, anchors: DataFrame, min_points: int = 1) -> DataFrame:
    """Regions with at least ``min_points`` anchors of their split."""
    points = anchors.select("split", "chrom", F.col("anchor_pos").alias("start"))
    return count_points(regions, points, SPLIT, "training_observed_points").where(F.col("training_observed_points") >= max(1, min_points))


# ------------------------------------------------------------------------ sets

def _recurrent_order() -> list[Column]:
    return [F.desc("sample_count"), F.desc("length"), F.col("chrom"), F.col("start")]


def recurrent_sets(tumor: DataFrame, normal: DataFrame, sizes: Sequence[int], proximity: int | None = 1000) -> DataFrame:
    """For each split and size n: the n most recurrent regions that none of the n most recurrent normal regions comes near.

    Sizes are nested on the normal side, so one join finds for each region the
    best rank among the normal regions near it; it is out of the sets of that
    size and more. ``proximity=None`` excludes nothing.
    """
    usable = tumor.withColumn("_near", F.lit(None).cast("int"))
    if proximity is not None:
        place = F.row_number().over(Window.partitionBy("split").orderBy(*_recurrent_order()))
        top = normal.withColumn("rank", place).where(F.col("rank") <= max(sizes))
        wide = top.select("split", "chrom", F.greatest(F.col("start") - proximity - 1, F.lit(0)).alias("start"), (F.col("end") + proximity + 1).alias("end"), "rank")
        near = range_join(tumor.select("split", *COORDS), wide, SPLIT, prefix="n_").groupBy("split", *COORDS).agg(F.min("n_rank").alias("_near"))
        usable = tumor.join(near, ["split", *COORDS], "left")
    sized = usable.withColumn("n_features", F.explode(F.array(*[F.lit(n) for n in sizes])))
    sized = sized.where(F.col("_near").isNull() | (F.col("_near") > F.col("n_features"))).drop("_near")
    place = F.row_number().over(Window.partitionBy("split", "n_features").orderBy(*_recurrent_order()))
    out = sized.withColumn("_r", place).where((F.col("_r") <= max(sizes)) & (F.col("_r") <= F.col("n_features")))
    return out.withColumn("feature_set", F.lit("PMD")).withColumn("feature_draw", F.lit(0)).withColumn("region_index", F.col("_r") - 1).drop("_r")


def drawn_sets(regions: DataFrame, sizes: Sequence[int], draws: int, seed: int, name: str) -> DataFrame:
    """For each split, draw and size: distinct regions in the order of a seeded hash, without replacement."""
    drawn = regions.dropDuplicates(["split", *COORDS]).withColumn("feature_draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    order = key_hash(f"{seed}-{name}", "split", "feature_draw", *COORDS)
    place = F.row_number().over(Window.partitionBy("split", "feature_draw").orderBy(order))
    # only the first rows of a partition's groups are shuffled
    first = drawn.withColumn("_r", place).where(F.col("_r") <= max(sizes))
    out = first.withColumn("n_features", F.explode(F.array(*[F.lit(n) for n in sizes]))).where(F.col("_r") <= F.col("n_features"))
    return out.withColumn("feature_set", F.lit(name)).withColumn("region_index", F.col("_r") - 1).drop("_r")


def length_fits(references: DataFrame) -> DataFrame:
    """Gamma fit (location 0) of the lengths per (split, kind); one row each, with its 25 % quantile as least length of a free place."""
    n = F.col("length").cast("double")
    stats = references.groupBy("split", "kind").agg(F.count("*").alias("n_reference"), F.avg(n).alias("mean_length"), F.avg(F.log(n)).alias("mean_log_length"),
                                                    F.min("length").alias("min_length"), F.max("length").alias("max_length"))

    @F.pandas_udf("shape double, scale double, min_realistic_length bigint")
    def fit(mean: pd.Series, mean_log: pd.Series) -> pd.DataFrame:
        rows = []
        for m, g in zip(mean, mean_log):
            if np.log(m) - g < 1e-9:  # all lengths equal: a gamma of no width
                rows.append((1e9, m / 1e9, max(1, round(m))))
                continue
            shape = gamma_shape(m, g)
            rows.append((shape, m / shape, max(1, round(float(gamma_quantiles(np.array([0.25]), shape, m / shape)[0])))))
        return pd.DataFrame(rows, columns=["shape", "scale", "min_realistic_length"])

    return stats.withColumn("_f", fit("mean_length", "mean_log_length")).select(*stats.columns, "_f.*")


def _lengths(u: Column) -> Column:
    @F.pandas_udf("double")
    def draw(values: pd.Series, shape: pd.Series, scale: pd.Series) -> pd.Series:
        out = np.empty(len(values))
        pairs = pd.MultiIndex.from_arrays([shape, scale])
        for (a, b), rows in pd.Series(np.arange(len(values)), index=pairs).groupby(level=[0, 1]):
            at = rows.to_numpy()
            out[at] = a * b if a >= 1e9 else gamma_quantiles(values.to_numpy()[at], a, b)
        return pd.Series(out)

    length = F.rint(draw(u, F.col("shape"), F.col("scale"))).cast("bigint")
    return F.greatest(F.least(F.greatest(length, F.col("min_length")), F.col("max_length")), F.lit(1).cast("bigint"))


def placed_regions(references: DataFrame, excluded: DataFrame, sizes: DataFrame, anchors: DataFrame, n: int, draws: int = 1,
                   seed: int = 42, min_points: int = 1, splits: int = 1, rounds: Sequence[int] = ROUNDS) -> DataFrame:
    """``n`` random regions for each (split, kind, draw), none overlapping another of its draw.

    ``references`` (split, kind, chrom, start, end, length) give chromosome
    frequencies and lengths, ``excluded`` and ``anchors`` are per split. An attempt
    draws a length and a chromosome, then a place: a uniform position in the free
    pieces of that chromosome counts only where the length still fits, so a piece
    is chosen in proportion to the starts it offers; the region is set around a
    random anchor of the piece. Should that fail, the attempt takes any chromosome.

    All slots of all keys share the rounds. A round makes candidates for the open
    slots only; a slot takes its first one that is clear of all accepted regions of
    its draw, and of new ones that overlap the lowest slot stays.
    """
    kinds = ["split", "kind"]
    part = [*kinds, "chrom"]
    fits = materialize(length_fits(references), "fits")
    every = F.transform(F.sequence(F.lit(0), F.lit(splits - 1)), lambda x: x.cast("bigint"))
    extent = sizes.select(F.explode(every).alias("split"), "chrom", F.lit(0).cast("bigint").alias("start"), F.col("size").cast("bigint").alias("end"))
    gaps = complement(excluded.select("split", *COORDS), extent, SPLIT).withColumn("pool_start", F.col("start")).withColumn("pool_end", F.col("end"))
    spots = anchors.select("split", "chrom", F.col("anchor_pos").alias("start"), (F.col("anchor_pos") + 1).alias("end"))
    # cut into bins, gaps and pieces are many times what their files tell: they are not left to Spark's size check
    inside = label_points(spots, gaps.hint("merge"), SPLIT, ["pool_start", "pool_end"]).where(F.col("pool_start").isNotNull())
    # anchors are kept once a split, whatever the number of kinds: only the choice of pieces depends on a kind's lengths
    shortest = fits.groupBy("split").agg(F.min("min_realistic_length").alias("_least"))
    inside = inside.join(shortest, "split").where(F.col("pool_end") - F.col("pool_start") >= F.col("_least"))
    tiled = inside.select("split", "chrom", F.col("start").alias("anchor"), "pool_start", "pool_end", F.shiftright("start", 20).alias("_t"))
    places = materialize(ranked(materialize(tiled, "inside"), ["split", "chrom"], ["anchor"], block="_t").drop("_t"), "anchors")
    pieces = places.groupBy("split", "chrom", F.col("pool_start").alias("pos"), "pool_end").agg(
        F.count("*").alias("n_anchors"), (F.min("rank") - 1).alias("n_anchors_before"))
    pieces = pieces.withColumn("free", F.col("pool_end") - F.col("pos"))
    pieces = pieces.join(fits.select(*kinds, "min_realistic_length"), "split").where(F.col("free") >= F.col("min_realistic_length")).drop("min_realistic_length")
    pieces = prefix_scan(pieces, part, sums=["free"])
    pieces = materialize(pieces.withColumnRenamed("pos", "pool_start"), "pieces")
    # one row per key: its chromosomes, with reference frequency and free positions
    weights = references.groupBy(*part).agg(F.count("*").alias("w")).join(pieces.groupBy(*part).agg(F.sum("free").alias("free")), part, "full").na.fill(0, ["w", "free"])
    table = weights.groupBy(*kinds).agg(F.array_sort(F.collect_list(F.struct("chrom", "w", "free"))).alias("c"))
    drawn = materialize(fits.join(table, kinds), "chromosomes")
    axis = pieces.select(*part, F.col("free_before").alias("start"), (F.col("free_before") + F.col("free")).alias("end"),
                         "pool_start", "pool_end", "n_anchors", "n_anchors_before")
    slot = [*kinds, "draw", "slot"]
    observed = anchors.select("split", "chrom", F.col("anchor_pos").alias("start"))
    todo = materialize(fits.select(*kinds).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
                       .withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))), "slots")
    accepted, first = None, 0
    for batch in rounds:
        candidates = _candidates(todo.join(drawn, kinds), first, 2 * batch, slot, axis, places, seed)
        first += 2 * batch
        counted = _count_near(materialize(candidates, "candidates"), observed).where(F.col("n_points") >= max(1, min_points))
        group = [*kinds, "draw"]
        if accepted is not None:
            counted = mark_overlaps(counted, accepted, group, name="_hit").where("NOT _hit")
        chosen = counted.groupBy(*slot).agg(F.min_by(F.struct(*COORDS, "n_points"), "try").alias("p"))
        chosen = materialize(chosen.select(*slot, "p.*"), "chosen")
        clusters = merge_intervals(chosen, group, -1).withColumn("_cluster", F.col("start"))
        marked = label_points(chosen, clusters, group, ["_cluster"])
        new = marked.groupBy(*group, "chrom", "_cluster").agg(F.min(F.struct("slot", "start", "end", "n_points")).alias("p"))
        new = new.select(*group, "p.slot", "chrom", "p.start", "p.end", "p.n_points")
        accepted = materialize(new if accepted is None else accepted.unionByName(new), "accepted")
        todo = materialize(todo.join(accepted.select(*slot), slot, "left_anti"), "slots")
        if todo.isEmpty():
            return accepted.withColumn("length", F.col("end") - F.col("start"))
    raise ValueError(f"{todo.count()} random regions found no place in {sum(rounds)} attempts")


def _count_near(candidates: DataFrame, observed: DataFrame) -> DataFrame:
    """``candidates`` with their number of points (``n_points``).

    Only points in bins that a candidate touches are scanned: few candidates are
    broadcast, and the points then stay where they are.
    """
    bins = F.sequence(F.shiftright("start", BIN_SHIFT), F.shiftright(F.col("end") - 1, BIN_SHIFT))
    touched = candidates.select("split", "chrom", F.explode(bins).alias("_bin")).distinct()
    near = observed.withColumn("_bin", F.shiftright("start", BIN_SHIFT)).join(materialize(touched, "bins"), ["split", "chrom", "_bin"], "left_semi")
    return count_points(candidates, near.drop("_bin"), SPLIT, name="n_points")


def _candidates(todo: DataFrame, first: int, tries: int, slot: list[str], axis: DataFrame, places: DataFrame, seed: int) -> DataFrame:
    key = [*slot, "try"]
    anywhere = F.col("try") % 2 == 1
    attempt = [*[F.col(c) for c in slot], F.shiftright("try", 1).alias("attempt")]
    u = {x: unit_hash(f"{seed}-{x}", *attempt) for x in "cl"} | {x: unit_hash(f"{seed}-{x}", *key) for x in "pas"}

    def weight(x: Column) -> Column:
        return F.when(anywhere, x.free).otherwise(x.w)

    total = F.aggregate("c", F.lit(0).cast("bigint"), lambda acc, x: acc + weight(x))
    nothing = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("string").alias("chrom"), F.lit(0).cast("bigint").alias("free"))
    pick = F.aggregate("c", nothing, lambda acc, x: F.when(
        acc.chrom.isNull() & (acc.seen + weight(x) > F.col("target")), F.struct((acc.seen + weight(x)).alias("seen"), x.chrom.alias("chrom"), x.free.alias("free")))
        .otherwise(F.struct((acc.seen + weight(x)).alias("seen"), acc.chrom.alias("chrom"), acc.free.alias("free"))))
    asked = todo.withColumn("try", F.explode(F.sequence(F.lit(first), F.lit(first + tries - 1))))
    asked = asked.withColumn("length", _lengths(u["l"])).withColumn("target", F.floor(u["c"] * total).cast("bigint")).withColumn("p", pick)
    asked = asked.where("p.free > 0").select(*key, "length", F.col("p.chrom").alias("chrom"), F.floor(u["p"] * F.col("p.free")).cast("bigint").alias("start"))
    asked = asked.withColumn("end", F.col("start") + 1)
    held = label_points(asked, axis.withColumn("axis_end", F.col("end")).hint("merge"), ["split", "kind"], ["axis_end", "pool_start", "pool_end", "n_anchors", "n_anchors_before"])
    fits = held.where(F.col("start") + F.col("length") <= F.col("axis_end"))
    number = (F.col("n_anchors_before") + F.floor(u["a"] * F.col("n_anchors")) + 1).cast("bigint")
    spot = fits.select(*key, "chrom", "length", "pool_start", "pool_end", number.alias("rank"))
    low = F.greatest("pool_start", F.col("anchor") - F.col("length") + 1)
    high = F.least(F.col("pool_end") - F.col("length"), F.col("anchor"))
    return (spot.join(places.select("split", "chrom", "rank", "anchor").hint("merge"), ["split", "chrom", "rank"]).withColumn("_lo", low).withColumn("_hi", high)
            .where("_lo <= _hi").withColumn("start", F.col("_lo") + F.floor(u["s"] * (F.col("_hi") - F.col("_lo") + 1)).cast("bigint"))
            .withColumn("end", F.col("start") + F.col("length")).select(*key, *COORDS))


def random_sets(placed: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """Placed regions as sets: the first n slots of a draw, by position."""
    out = placed.withColumn("n_features", F.explode(F.array(*[F.lit(n) for n in sizes]))).where(F.col("slot") < F.col("n_features"))
    order = Window.partitionBy("split", "kind", "draw", "n_features").orderBy("chrom", "start")
    return out.withColumn("region_index", F.row_number().over(order) - 1).withColumnRenamed("kind", "feature_set").withColumnRenamed("draw", "feature_draw") \
        .withColumnRenamed("n_points", "training_observed_points").drop("slot")


def complete(sets: DataFrame, members: DataFrame, names: Sequence[str], sizes: Sequence[int], draws: int) -> DataFrame:
    """The sets, all of full size; one that is short or missing raises."""
    want = members.select("split").distinct().withColumn("feature_set", F.explode(F.array(*[F.lit(x) for x in names])))
    want = want.withColumn("n_features", F.explode(F.array(*[F.lit(n) for n in sizes])))
    want = want.withColumn("feature_draw", F.explode(F.when(F.col("feature_set") == "PMD", F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(draws - 1)))))
    have = want.join(sets.groupBy(*SET).agg(F.count("*").alias("_n")), SET, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    short = F.concat(F.col("feature_set"), F.lit(" has "), F.col("_n"), F.lit(" distinct eligible regions, but "), F.col("n_features"), F.lit(" were requested"))
    for row in have.where("_n < n_features").select(short.alias("m")).limit(1).collect():
        raise ValueError(row["m"])
    return sets


def fold_feature_sets(beta: DataFrame, segments: DataFrame, islands: DataFrame, assigned: DataFrame, sizes_of_chroms: DataFrame, k: int, repeats: int,
                      sizes: Sequence[int], draws: int = 1, seed: int = 42, exclude_top_normal: bool = True, min_points: int = 1,
                      min_random_points: int = 1, names: Sequence[str] = SETS, max_gap: int = 1000, proximity: int = 1000) -> DataFrame:
    """All region sets of all splits, sizes and draws, from training samples only. Too few regions raise."""
    members = materialize(fold_members(assigned, k), "members")
    anchors = materialize(fold_anchors(beta, assigned, k, repeats), "anchors")
    whole = materialize(fold_regions(segments, members, "Tumor", max_gap), "regions")
    tumor = materialize(observed_regions(whole, anchors, min_points), "tumor")
    every = F.transform(F.sequence(F.lit(0), F.lit(k * repeats - 1)), lambda x: x.cast("bigint"))
    spread = islands.select(*COORDS).distinct().select(F.explode(every).alias("split"), *COORDS).withColumn("length", F.col("end") - F.col("start"))
    eligible = materialize(observed_regions(spread, anchors, min_points).withColumn("sample_count", F.lit(None).cast("bigint")), "islands")
    normal = observed_regions(fold_regions(segments, members, "Normal", max_gap), anchors, min_points)
    out = ["split", "feature_set", F.col("n_features").cast("bigint").alias("n_features"), F.col("feature_draw").cast("bigint").alias("feature_draw"),
           F.col("region_index").cast("bigint").alias("region_index"), *COORDS, "length", "training_observed_points", "sample_count"]
    parts = []
    if "PMD" in names:
        parts.append(recurrent_sets(tumor, materialize(normal, "normal"), sizes, proximity if exclude_top_normal else None))
    if "Random PMD" in names:
        parts.append(drawn_sets(tumor, sizes, draws, seed, "Random PMD"))
    if "CGI" in names:
        parts.append(drawn_sets(eligible, sizes, draws, seed, "CGI"))
    kinds = {"Random long": tumor, "Random short": eligible}
    references = [df.select("split", F.lit(name).alias("kind"), *COORDS, "length") for name, df in kinds.items() if name in names]
    if references:
        together = references[0] if len(references) == 1 else references[0].unionByName(references[1])
        placed = placed_regions(together, whole, sizes_of_chroms, anchors, max(sizes), draws, seed, min_random_points, k * repeats)
        parts.append(random_sets(placed, sizes).withColumn("sample_count", F.lit(None).cast("bigint")))
    sets = None
    for p in parts:
        sets = p.select(*out) if sets is None else sets.unionByName(p.select(*out))
    return complete(materialize(sets, "sets"), members, names, sizes, draws)


# ------------------------------------------------------------------- benchmark

def fold_vectors(beta: DataFrame, members: DataFrame, sets: DataFrame) -> DataFrame:
    """(set key, sample, is_test, label, features): mean values of the set's regions, missing ones filled with the training mean.

    A region's mean in a sample is computed once, whatever the number of sets that
    hold it. A region without any training value raises.
    """
    numbered = index_regions(sets.select(*COORDS).distinct().withColumn("feature_set", F.lit("all"))).drop("feature_set")
    numbered = materialize(numbered, "numbered")
    means = region_features(beta, numbered).where(F.col("value").isNotNull())
    cells = sets.select(*SET, F.col("region_index").alias("_i"), *COORDS).join(numbered, COORDS).select(*SET, "_i", "region_index")
    grid = cells.join(members.select("split", "sample_id", "is_test", "binary_label"), "split").join(means, ["sample_id", "region_index"], "left")
    grid = materialize(grid, "cells")
    known = grid.groupBy(*SET, "_i").agg(F.avg(F.when(~F.col("is_test"), F.col("value"))).alias("_mean"))
    known = known.withColumn("_mean", F.when(F.col("_mean").isNotNull(), F.col("_mean")).otherwise(F.raise_error(
        F.concat(F.col("feature_set"), F.lit(": no observed values of region "), F.col("_i"), F.lit(" in training"))).cast("double")))
    filled = grid.join(known, [*SET, "_i"]).withColumn("value", F.coalesce("value", "_mean"))
    # n_features entries a row
    listed = filled.groupBy(*SET, "sample_id", "is_test", "binary_label").agg(F.sort_array(F.collect_list(F.struct("_i", "value"))).alias("_f"))
    return listed.withColumn("features", F.transform("_f", lambda x: x["value"])).drop("_f")


def fold_predictions(vectors: DataFrame, members: DataFrame, sizes: Sequence[int], trees: int = 500, seed: int = 42, depth: int = DEEPEST) -> DataFrame:
    """Test samples of every set: a balanced random forest each, and the baseline that always says cancer.

    Spark fits one forest after the other, each over its set's vectors.
    """
    held = materialize(vectors.withColumn("label", (F.col("binary_label") == "Tumor").cast("double")), "vectors")
    keys = held.select(*SET).distinct().orderBy(*SET).collect()  # one row a model
    parts = []
    for key in keys:
        mine = held.where(" AND ".join(f"{c} = {key[c]!r}" for c in SET)).withColumn("features", array_to_vector("features"))
        forest = RandomForestClassifier(labelCol="label", weightCol="weight", numTrees=trees, seed=seed + key["split"] * 100_000 + key["n_features"] * 100 + key["feature_draw"],
                                        featureSubsetStrategy="sqrt", maxDepth=depth)
        model = Pipeline(stages=[forest]).fit(balanced_weights(mine.where("NOT is_test")))
        scored = model.transform(mine.where("is_test"))
        parts.append(scored.select(*SET, "sample_id", F.col("prediction").cast("int").alias("y_pred"), vector_to_array("probability")[1].alias("y_score")))
    test = members.where("is_test")
    always = test.select("split", F.lit("Always cancer").alias("feature_set"), F.explode(F.array(*[F.lit(n).cast("bigint") for n in sizes])).alias("n_features"),
                         F.lit(0).cast("bigint").alias("feature_draw"), "sample_id", F.lit(1).alias("y_pred"), F.lit(1.0).alias("y_score"))
    out = always
    for p in parts:
        out = out.unionByName(p)
    truth = (F.col("binary_label") == "Tumor").cast("int")
    named = out.join(test.select("split", "repeat", "fold", "sample_id", "patient_id", "binary_label"), ["split", "sample_id"])
    return named.select(F.format_string("repeat_%02d_fold_%02d_split_%04d", "repeat", "fold", "split").alias("fold_key"), "split", "repeat", "fold", "sample_id", "patient_id",
                        F.col("binary_label").alias("sample_label"), truth.alias("y_true"), "feature_draw", "feature_set", "n_features", "y_pred", "y_score",
                        (truth == F.col("y_pred")).alias("correct"))


def fold_scores(predictions: DataFrame) -> DataFrame:
    """One row of metrics per (split, set, size, draw)."""
    keys = ["split", "repeat", "fold", "feature_draw", "feature_set", "n_features"]
    scores = classification_metrics(predictions, keys, positive=1)
    return scores.select(*keys, "tp", "fp", "fn", "tn", "balanced_accuracy", "average_precision", "macro_f1", "mcc", "roc_auc")


def run_fold_benchmark(beta: DataFrame, segments: DataFrame, islands: DataFrame, assigned: DataFrame, sizes_of_chroms: DataFrame, k: int, repeats: int,
                       sizes: Sequence[int], draws: int = 1, trees: int = 500, seed: int = 42, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scores, predictions, chosen regions) over all splits, sizes, sets and draws."""
    members = materialize(fold_members(assigned, k), "members")
    sets = fold_feature_sets(beta, segments, islands, assigned, sizes_of_chroms, k, repeats, sizes, draws, seed, **options)
    chosen = sets.join(members.select("split", "repeat", "fold").distinct(), "split")
    predictions = materialize(fold_predictions(fold_vectors(beta, members, sets), members, sizes, trees, seed), "predictions")
    return fold_scores(predictions), predictions, chosen
