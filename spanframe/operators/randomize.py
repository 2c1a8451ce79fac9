"""Backgrounds, checks of injected truth, permutation nulls and random regions.

Draws depend on keys and a seed only. Python works on column batches, or on
groups whose size has a fixed bound (stated at each use).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.functions import clip, half_even, key_hash, safe_divide, stable_seed, unit_hash
from spanframe.functions.draws import beta_draw, gamma_quantiles, gamma_shape
from spanframe.operators.cleaning import downsample
from spanframe.operators.points import region_mean
from spanframe.operators.ranges import (BIN_SHIFT, PACKED_ROWS, annotate_with_sources, depth_segments, flag_points, label_slotted,
                                        mark_overlaps, merge_intervals, overlap_totals, supported_spans)
from spanframe.operators.scan import ranked
from spanframe.session import materialize

SAMPLE = ("sample_id",)

# Settings of the segments that truth regions may take.
PLACEMENT = {
    "min_len_bp": 150_000, "min_gap_bp": 1_000_000,
    "end_buffer_frac": 0.10, "center_buffer_frac": 0.10,
}
# The Beta of replaced points.
BACKGROUND_BETA = (13.0, 1.5)


# ------------------------------------------------------------------ background

def candidate_filter(regions: DataFrame, points: DataFrame, low: float = 0.2, high: float = 0.7,
                     keys: Sequence[str] = SAMPLE) -> DataFrame:
    """Regions with their mean beta and decision; those without points are dropped."""
    means = region_mean(regions, points, keys).drop("n_points")
    return means.withColumn("decision", F.when(F.col("mean_beta").between(low, high), "remove").otherwise("keep"))


def replace_points(points: DataFrame, regions: DataFrame, seed: int = 42, keys: Sequence[str] = SAMPLE) -> DataFrame:
    """Points inside ``regions`` get a new high beta; others stay. Adds ``modified``."""
    flagged = flag_points(points, {"modified": regions}, keys)
    beta = beta_draw(unit_hash(seed, *keys, "chrom", "start", "end"), *BACKGROUND_BETA)
    fresh = clip(half_even(beta * F.col("coverage")), 0, F.col("coverage"))
    return flagged.withColumn("meth", F.when(F.col("modified"), fresh).otherwise(F.col("meth")).cast("bigint"))


def clean_background(regions: DataFrame, points: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(normalised points, one summary row per sample): union of all tools, merged,
    annotated with its tools, filtered by mean beta, replaced."""
    union = materialize(annotate_with_sources(merge_intervals(regions, SAMPLE), regions, SAMPLE), "union")
    decided = materialize(candidate_filter(union.select(*SAMPLE, "chrom", "start", "end"), points), "decided")
    removed = decided.where("decision = 'remove'")
    clean = materialize(replace_points(points, removed, seed), "clean")
    steps = [
        regions.groupBy(*SAMPLE).agg(F.countDistinct("tool").alias("n_tools")),
        union.groupBy(*SAMPLE).agg(F.count("*").alias("n_candidates")),
        decided.groupBy(*SAMPLE).agg(F.count_if(F.col("decision") == "remove").alias("n_removed"),
                                     F.count_if(F.col("decision") == "keep").alias("n_kept")),
        clean.groupBy(*SAMPLE).agg(F.count("*").alias("n_points"), F.count_if(F.col("modified")).alias("n_modified")),
    ]
    summary = steps[0]
    for step in steps[1:]:
        summary = summary.join(step, list(SAMPLE), "left")
    return clean, summary


# --------------------------------------------------------------------- placing

def placement_segments(points: DataFrame, config: dict | None = None, keys: Sequence[str] = SAMPLE) -> DataFrame:
    """Allowed segments of each supported span: without both ends and the centre,
    at least ``min_len_bp`` long, with the number of regions that can fit."""
    c = {**PLACEMENT, **(config or {})}
    spans = supported_spans(points, keys, c["min_len_bp"])
    s, e = F.col("start"), F.col("end")
    span = (e - s).cast("double")
    edge = half_even(span * c["end_buffer_frac"])
    middle, half = s + span / 2.0, half_even(span * c["center_buffer_frac"]) / 2.0
    pieces = F.array(F.struct((s + edge).alias("start"), half_even(middle - half).alias("end")),
                     F.struct(half_even(middle + half).alias("start"), (e - edge).alias("end")))
    out = spans.select(*keys, "chrom", F.explode(pieces).alias("p")).select(*keys, "chrom", "p.*")
    length = F.col("end") - F.col("start")
    return (out.where(length >= c["min_len_bp"])
            .withColumn("capacity", F.floor((length + c["min_gap_bp"]) / (c["min_len_bp"] + c["min_gap_bp"])).cast("bigint")))


def injection_checks(before: DataFrame, after: DataFrame, truth: DataFrame) -> DataFrame:
    """Per sample: same rows, coordinates and coverage, meth within coverage, truth
    and modified rows present, mean beta inside truth before and after.

    Rows of both tables are dealt by bin once, in a number of tasks that grows with
    ``before``; that exchange serves the comparison, the counts and the join with truth.
    """
    part = [*SAMPLE, "chrom"]
    key = [*part, "start", "end", "coverage"]
    none = F.lit(None).cast("boolean")
    both = before.select(*key, "meth", F.lit(True).alias("_old"), none.alias("in_truth")).unionByName(
        after.select(*key, "meth", F.lit(False).alias("_old"), F.col("in_truth")))
    tasks = max(int(before.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-2 * before.count() // PACKED_ROWS))
    dealt = both.withColumn("_slot", F.shiftright("start", BIN_SHIFT) * 4).repartition(tasks, *part, "_slot")
    ratio, old, new = safe_divide("meth", "coverage"), F.col("_old"), ~F.col("_old")
    old_ratio, new_ratio = F.when(old, ratio), F.when(new & F.col("in_truth"), ratio)
    rows = dealt.groupBy(*key, "_slot").agg(
        F.count_if(old).alias("_before"), F.count_if(new).alias("_after"), F.count_if(new & F.col("in_truth")).alias("_modified"),
        F.count_if(new & ((F.col("meth") < 0) | (F.col("meth") > F.col("coverage")))).alias("_out_of_range"),
        F.sum(old_ratio).alias("_old_sum"), F.count(old_ratio).alias("_old_n"), F.sum(new_ratio).alias("_new_sum"), F.count(new_ratio).alias("_new_n"))
    inside = F.col("_in").isNotNull()
    told = label_slotted(rows, merge_intervals(truth, SAMPLE).withColumn("_in", F.lit(True)), SAMPLE, ["_in"]).groupBy(*SAMPLE).agg(
        F.sum("_before").alias("_before"), F.sum("_after").alias("_after"), F.sum("_modified").alias("_modified"),
        F.sum("_out_of_range").alias("_out_of_range"), F.count_if(F.col("_before") != F.col("_after")).alias("n_changed_keys"),
        safe_divide(F.sum(F.when(inside, F.col("_old_sum"))), F.sum(F.when(inside, F.col("_old_n")))).alias("mean_beta_before"),
        safe_divide(F.sum("_new_sum"), F.sum("_new_n")).alias("mean_beta_after"))
    # a table without rows of a sample has no counts for it
    some = F.col("_after") > 0
    stats = told.select(*SAMPLE, F.when(F.col("_before") > 0, F.col("_before")).alias("n_before"), "mean_beta_before", F.when(some, F.col("_after")).alias("n_after"),
                        F.when(some, F.col("_modified")).alias("n_modified"), F.when(some, F.col("_out_of_range")).alias("n_out_of_range"),
                        "mean_beta_after", "n_changed_keys")
    n_truth = truth.groupBy(*SAMPLE).agg(F.count("*").alias("n_truth"))
    out = stats.join(n_truth, list(SAMPLE), "left").na.fill(0, ["n_truth"])
    return out.withColumn("ok", (F.col("n_before") == F.col("n_after")) & (F.col("n_changed_keys") == 0)
                          & (F.col("n_out_of_range") == 0) & (F.col("n_truth") > 0) & (F.col("n_modified") > 0))


# ------------------------------------------------------------------------ nulls

BLOCK_ROWS = 5_000


def permute_null(regions: DataFrame, sizes: DataFrame, n_permutations: int, seed: int = 0,
                 keys: Sequence[str] = ("sample_id", "tool")) -> DataFrame:
    """Random placements that keep each chromosome's region count and lengths:
    shuffled order, free space spread over the gaps as an equal multinomial.

    The shuffled order is cut into blocks of about ``BLOCK_ROWS`` regions. One
    small group per (key, chrom, permutation) splits the free space over its
    blocks; one group per block then spreads its share over its gaps. Together
    that is the same multinomial, and no group grows with the chromosome.
    Permutations of a single block skip the first step.
    """
    lanes = int(regions.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def spread_out(df: DataFrame, *group: str) -> DataFrame:
        """Small rows, costly groups: a numbered lane keeps partitions from being coalesced by size."""
        return df.withColumn("_lane", F.pmod(F.xxhash64(*group), F.lit(lanes)).cast("int")).repartition(lanes, "_lane")

    part = [*keys, "chrom"]
    whole = [*part, "perm"]
    rows = regions.groupBy(*part, "start", "end").agg(F.count("*").alias("_copies")) \
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies")))) \
        .select(*part, "start", "end", "copy", (F.col("end") - F.col("start")).alias("length"))
    totals = rows.groupBy(*part).agg(F.count("*").alias("n"), F.sum("length").alias("bp")).join(
        sizes.select("chrom", "size"), "chrom", "left")
    free = F.when(F.col("size") >= F.col("bp"), F.col("size") - F.col("bp")).otherwise(
        F.raise_error(F.concat(F.lit("regions do not fit on "), F.col("chrom"))).cast("bigint"))
    totals = totals.withColumn("free", free).withColumn("blocks", F.ceil(F.col("n") / BLOCK_ROWS)).drop("bp", "size")
    order = unit_hash(seed, "perm", *part, "start", "end", "copy")
    shuffled = (rows.join(totals, part).withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(n_permutations - 1))))
                .withColumn("u", order).withColumn("block", F.floor(F.col("u") * F.col("blocks")).cast("bigint")))
    blocks = shuffled.groupBy(*whole, "block").agg(
        F.count("*").alias("n_b"), F.sum("length").alias("bp_b"), F.first("n").alias("n"), F.first("free").alias("free"),
        F.first("blocks").alias("blocks")).where("blocks > 1")

    def split(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block")
        rng = np.random.default_rng(int(group["_seed"].iloc[0]))
        n = int(group["n"].iloc[0])
        weights = np.append(group["n_b"].to_numpy(), 1) / (n + 1)  # the last gap follows the last region
        share = rng.multinomial(int(group["free"].iloc[0]), weights)[:-1]
        used = share + group["bp_b"].to_numpy()
        return group.assign(free_b=share, at=np.concatenate([[0], np.cumsum(used)[:-1]]))[
            [*whole, "block", "free_b", "at"]]

    key_types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in shuffled.select(*whole).schema.fields)
    seeded = blocks.withColumn("_seed", stable_seed(seed, F.concat_ws("|", *whole)))
    shares = spread_out(seeded, *whole).groupBy("_lane", *whole).applyInPandas(split, f"{key_types}, block bigint, free_b bigint, at bigint")

    def spread(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("u")
        rng = np.random.default_rng(int(group["_seed"].iloc[0]))
        n, lengths = len(group), group["length"].to_numpy()
        if group["blocks"].iloc[0] == 1:
            gaps, at = rng.multinomial(int(group["free"].iloc[0]), np.full(n + 1, 1 / (n + 1)))[:-1], 0
        else:
            gaps, at = rng.multinomial(int(group["free_b"].iloc[0]), np.full(n, 1 / n)), int(group["at"].iloc[0])
        starts = at + np.cumsum(gaps) + np.concatenate([[0], np.cumsum(lengths)[:-1]])
        return group.assign(start=starts, end=starts + lengths)[[*whole, "start", "end"]]

    placed = shuffled.select(*whole, "block", "u", "length", "blocks", "free").join(shares, [*whole, "block"], "left") \
        .withColumn("_seed", stable_seed(seed, F.concat_ws("|", *whole, "block")))
    return spread_out(placed, *whole, "block").groupBy("_lane", *whole, "block").applyInPandas(spread, f"{key_types}, start bigint, end bigint")


def null_checks(observed: DataFrame, permuted: DataFrame, sizes: DataFrame,
                keys: Sequence[str] = ("sample_id", "tool")) -> DataFrame:
    """Per key and permutation: same count, same chromosome counts and length
    multiset, inside bounds, positive length, disjoint."""
    keys = list(keys)
    length = (F.col("end") - F.col("start")).alias("length")
    want = observed.select(*keys, "chrom", length).groupBy(*keys, "chrom", "length").agg(F.count("*").alias("w"))
    # every (key, perm) that exists must show every observed length
    want = permuted.select(*keys, "perm").distinct().join(want, keys)
    have = permuted.select(*keys, "perm", "chrom", length).groupBy(*keys, "perm", "chrom", "length").agg(F.count("*").alias("h"))
    diff = want.join(have, [*keys, "perm", "chrom", "length"], "full_outer").na.fill(0, ["w", "h"]) \
        .groupBy(*keys, "perm").agg(F.sum("w").alias("n_observed"), F.sum("h").alias("n_permuted"),
                                    F.count_if(F.col("w") != F.col("h")).alias("n_length_differences"))
    bounds = permuted.join(sizes, "chrom").groupBy(*keys, "perm").agg(
        F.count_if((F.col("start") < 0) | (F.col("end") > F.col("size"))).alias("n_out_of_bounds"),
        F.count_if(F.col("end") <= F.col("start")).alias("n_not_positive"))
    deepest = depth_segments(permuted, [*keys, "perm"]).groupBy(*keys, "perm").agg(F.max("depth").alias("max_depth"))
    return (diff.join(bounds, [*keys, "perm"]).join(deepest, [*keys, "perm"])
            .withColumn("ok", (F.col("n_length_differences") == 0) & (F.col("n_out_of_bounds") == 0)
                        & (F.col("n_not_positive") == 0) & (F.col("max_depth") <= 1)))


def null_summary(observed: DataFrame, null_values: DataFrame, keys: Sequence[str], value: str = "score") -> DataFrame:
    """Null mean and sd, enrichment (infinity when only the null mean is 0) and z
    (0 when sd is 0 and the values agree, else null)."""
    v = F.when(~F.isnan(value), F.col(value))
    stats = null_values.groupBy(*keys).agg(F.avg(v).alias("null_mean"), F.stddev_samp(v).alias("_sd"), F.count(v).alias("n_null"))
    out = observed.select(*keys, F.col(value).alias("observed")).join(stats, list(keys), "left")
    o, m = F.col("observed"), F.col("null_mean")
    sd = F.when(F.col("n_null") == 1, 0.0).otherwise(F.col("_sd"))
    return (out.withColumn("null_sd", sd)
            .withColumn("enrichment", F.when(m == 0, F.when(o != 0, F.lit(float("inf")))).otherwise(safe_divide(o, m)))
            .withColumn("z_score", F.when(F.col("null_sd") == 0, F.when(o == m, 0.0))
                        .otherwise(safe_divide(o - m, "null_sd"))).drop("_sd"))


# ------------------------------------------------------------- random regions

def randomize_globally(regions: DataFrame, points: DataFrame, seed: int = 42, keys: Sequence[str] = ("sample_id", "tool"),
                       tries: Sequence[int] = (8, 64, 512, 4416)) -> DataFrame:
    """A random place of the same length for every region, within the observed
    bounds of its chromosome and clear of the original regions.

    Tries are batches of hashed candidates over the regions still unplaced;
    what no try can place takes the least-overlapping of 512 even steps.
    """
    part = [*keys, "chrom"]
    originals = materialize(regions.select(*part, "start", "end"), "originals")
    bounds = points.groupBy("chrom").agg(F.min("start").alias("lo"), F.max("end").alias("hi"))
    ids = [*part, "rid"]
    numbered = originals.withColumn("_h", key_hash(seed, *part, "start", "end")).withColumn("_b", F.substring("_h", 1, 3))
    todo = materialize(ranked(numbered, part, ["_h", "start", "end"], block="_b", name="rid").join(bounds, "chrom")
                       .select(*ids, (F.col("end") - F.col("start")).alias("length"), "lo",
                               F.greatest(F.col("hi") - (F.col("end") - F.col("start")), "lo").alias("top")), "todo")
    parts, offset = [], 0
    for n in tries:
        spot = F.col("lo") + F.floor(unit_hash(seed, *ids, "t") * (F.col("top") - F.col("lo") + 1)).cast("bigint")
        tried = (todo.withColumn("t", F.explode(F.sequence(F.lit(offset), F.lit(offset + n - 1)))).withColumn("start", spot)
                 .withColumn("end", F.col("start") + F.col("length")))
        free = mark_overlaps(tried, originals, keys, name="_hit").where("NOT _hit")
        placed = materialize(free.groupBy(*ids).agg(F.min_by(F.struct("start", "end"), "t").alias("p"))
                             .select(*ids, "p.start", "p.end", F.lit("non_overlapping").alias("placement_mode"),
                                     F.lit(0).cast("bigint").alias("overlap_bp_with_original")), "placed")
        parts.append(placed)
        todo = materialize(todo.join(placed.select(*ids), ids, "left_anti"), "todo")
        offset += n
    step = F.col("lo") + F.floor((F.col("top") - F.col("lo")) * F.col("g") / 511).cast("bigint")
    grid = (todo.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(511)))).withColumn("start", step)
            .withColumn("end", F.col("start") + F.col("length")).select(*ids, "start", "end").distinct())
    scored = overlap_totals(grid, originals, keys, count="_n", bp="overlap")
    parts.append(scored.groupBy(*ids).agg(F.min(F.struct("overlap", "start", "end")).alias("p"))
                 .select(*ids, "p.start", "p.end", F.lit("best_effort_overlap").alias("placement_mode"),
                         F.col("p.overlap").alias("overlap_bp_with_original")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("rid")


def randomized_summary(originals: DataFrame, randomized: DataFrame, points: DataFrame,
                       keys: Sequence[str] = ("sample_id", "tool")) -> DataFrame:
    """Counts that show what a randomisation preserved and how much it overlaps, and
    whether every chromosome has as many regions, and every length, as before."""
    keys = list(keys)

    def preserved(name: str, what: Column) -> DataFrame:
        both = originals.select(*keys, what.alias("_w"), F.lit(1).alias("_d")).unionByName(randomized.select(*keys, what.alias("_w"), F.lit(-1).alias("_d")))
        return (both.groupBy(*keys, "_w").agg(F.sum("_d").alias("_d")).groupBy(*keys)
                .agg((F.count_if(F.col("_d") != 0) == 0).alias(name)))

    bounds = points.groupBy("chrom").agg(F.min("start").alias("lo"), F.max("end").alias("hi"))
    bp = F.sum(F.col("end") - F.col("start"))
    a = originals.groupBy(*keys).agg(F.count("*").alias("n_original"), bp.alias("original_bp"))
    scored = overlap_totals(randomized, originals.select(*keys, "chrom", "start", "end"), keys, count="_n", bp="_o")
    b = scored.join(bounds, "chrom").groupBy(*keys).agg(
        F.count("*").alias("n_randomized"), bp.alias("randomized_bp"),
        F.count_if((F.col("start") >= F.col("lo")) & (F.col("end") <= F.col("hi"))).alias("n_in_bounds"),
        F.count_if(F.col("_o") > 0).alias("n_overlapping"),
        F.count_if(F.col("placement_mode") == "best_effort_overlap").alias("n_best_effort"), F.sum("_o").alias("overlap_bp"))
    return (a.join(b, keys, "left").join(preserved("chromosomes_preserved", F.col("chrom")), keys, "left")
            .join(preserved("lengths_preserved", F.col("end") - F.col("start")), keys, "left"))


def length_statistics(regions: DataFrame) -> DataFrame:
    """One row: what the gamma fit needs, from one aggregation."""
    n = (F.col("end") - F.col("start")).cast("double")
    return regions.agg(F.count("*").alias("n_observations"), F.avg(n).alias("mean_length"),
                       F.avg(F.log(n)).alias("mean_log_length"), F.coalesce(F.var_samp(n), F.lit(0.0)).alias("variance"),
                       F.min(n).alias("min_length"), F.max(n).alias("max_length"))


def fit_gamma_lengths(regions: DataFrame) -> dict:
    """Gamma fit (location 0) of the lengths, with the 25 % quantile as the
    smallest realistic length. The driver sees one row of aggregates."""
    row = length_statistics(regions).first()
    if not row["n_observations"]:
        raise ValueError("no regions to fit")
    shape = gamma_shape(row["mean_length"], row["mean_log_length"])
    fit = {**row.asDict(), "shape": shape, "scale": row["mean_length"] / shape}
    fit["min_realistic_length"] = max(1, int(round(float(gamma_quantiles(np.array([0.25]), shape, fit["scale"])[0]))))
    return fit


def sample_regions(regions: DataFrame, n: int, seed: int = 42, part: Sequence[str] = ()) -> DataFrame:
    """Exactly ``n`` distinct coordinates per ``part``; fewer available raises."""
    coords = [*part, "chrom", "start", "end"]
    distinct = regions.select(*coords).distinct()
    enough = distinct.groupBy(*part).agg(F.count("*").alias("_n")) if part else distinct.agg(F.count("*").alias("_n"))
    checked = enough.withColumn("_ok", F.when(F.col("_n") >= n, True).otherwise(F.raise_error(
        F.concat(F.lit(f"asked for {n} regions, found "), F.col("_n").cast("string"), F.lit(" distinct"))).cast("boolean")))
    chosen = downsample(distinct, n, coords, seed, part)
    if part:
        return chosen.join(checked.drop("_n"), list(part)).where("_ok").select(*coords)
    return chosen.crossJoin(F.broadcast(checked.drop("_n"))).where("_ok").select(*coords)  # one row


def select_samples(samples: DataFrame, n: int, min_group_size: int, seed: int = 42, group: str = "project_id",
                   anchor: str | None = None, all_normals_above: int = 800, tumor_only: bool = False, by_type: bool = False) -> DataFrame:
    """Stratified choice of samples: a minimum per eligible group, the rest in
    rounds over the groups with room, one optional anchor sample in place of the
    last chosen; all normals are added for large requests. Too few raises.

    ``tumor_only`` chooses among primary tumours; ``by_type`` makes groups of
    ``group`` and sample type.
    """
    normals = samples.where("sample_type = 'Solid Tissue Normal'")
    columns = samples.columns
    if tumor_only:
        samples = samples.where("sample_type = 'Primary Tumor'")
    samples = samples.dropDuplicates(["sample"])
    if by_type:
        samples, group = samples.withColumn("_group", F.concat_ws(" | ", group, "sample_type")), "_group"
    hashed = samples.withColumn("_h", key_hash(seed, "sample")).withColumn("_b", F.substring("_h", 1, 4))
    inside = ranked(hashed, [group], ["_h"], block="_b", name="_r")
    sizes = inside.groupBy(group).agg(F.count("*").alias("_size")).where(F.col("_size") >= min_group_size)
    groups = sizes.count()
    if not groups or n < groups * min_group_size:
        raise ValueError(f"{n} samples cannot give {min_group_size} to each of {groups} groups")
    eligible = inside.join(sizes, group)
    have = sizes.agg(F.sum("_size").alias("n")).first()["n"]
    if have < n:
        raise ValueError(f"asked for {n} samples, found {have} in groups of {min_group_size} or more")
    # round k offers every group's k-th sample; inside a round the hash decides
    by_round = eligible.withColumn("_round", F.greatest(F.col("_r"), F.lit(min_group_size).cast("bigint")))
    # anchor first: it is always chosen when eligible
    first = [F.when(F.col("sample") == F.lit(anchor), 0).otherwise(1)] if anchor else []
    chosen = by_round.orderBy(*first, "_round", "_h").limit(n).select(*columns)
    if n > all_normals_above:
        chosen = chosen.unionByName(normals.join(chosen.select("sample"), "sample", "left_anti"))
    return chosen.withColumn("is_anchor", F.coalesce(F.col("sample") == F.lit(anchor), F.lit(False)))
