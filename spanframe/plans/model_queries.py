"""Randomisation, cohort and context queries."""

from __future__ import annotations

from math import lgamma

import numpy as np
from pyspark.sql import functions as F

from spanframe.functions.draws import digamma
from spanframe.operators import cleaning as C
from spanframe.operators import cohort as M
from spanframe.operators import context as G
from spanframe.operators import fold_features as FF
from spanframe.operators import randomize as Z
from spanframe.operators import ranges as R
from spanframe.operators.points import region_features
from spanframe.operators.summaries import cohort_manifest
from spanframe.plans.interval_queries import DISTINCT_POINTS, SAME_SAMPLE
from spanframe.plans.registry import CTE, merge_sql, query, rounded
from spanframe.plans.summary_queries import matrix
from spanframe.plans.table_queries import md5_sql
from spanframe.session import materialize

ST = ["sample_id", "tool"]


# -------------------------------------------------------------- randomisation

CTE["decided"] = f"""
    SELECT a.sample_id, a.chrom, a.start, a."end", avg(b.beta) AS m FROM sample_union a JOIN beta_points b ON {SAME_SAMPLE} GROUP BY ALL"""


@query("candidate_filter", "R2", """
    SELECT sample_id, chrom, start, "end", round(m, 9) AS mean_beta,
           CASE WHEN m BETWEEN 0.2 AND 0.7 THEN 'remove' ELSE 'keep' END AS decision FROM decided""")
def _(t):
    union = materialize(R.merge_intervals(t.regions, ["sample_id"]), "union")
    return rounded(Z.candidate_filter(union, t.beta_points), 9, "mean_beta")


@query("replace_points", "R3", f"""
    WITH f AS (SELECT a.*, EXISTS (SELECT 1 FROM truth b WHERE {SAME_SAMPLE}) AS modified FROM points a)
    SELECT sample_id, modified, count(*) AS n, CAST(sum(CASE WHEN modified THEN 0 ELSE meth END) AS BIGINT) AS untouched_meth,
           CAST(sum(coverage) AS BIGINT) AS coverage, CAST(0 AS BIGINT) AS n_out_of_range,
           true AS mean_in_range FROM f GROUP BY sample_id, modified""")
def _(t):
    out = Z.replace_points(t.points, t.truth)
    mean = F.avg(F.col("meth") / F.col("coverage"))
    # Beta(13, 1.5) has mean 13 / 14.5
    return (out.groupBy("sample_id", "modified").agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("modified"), 0).otherwise(F.col("meth"))).alias("untouched_meth"),
        F.sum("coverage").alias("coverage"),
        F.count_if((F.col("meth") < 0) | (F.col("meth") > F.col("coverage"))).alias("n_out_of_range"), mean.alias("_m"))
        .withColumn("mean_in_range", ~F.col("modified") | (F.abs(F.col("_m") - 13 / 14.5) < 0.05)).drop("_m"))


@query("clean_background", "R16", f"""
    WITH a AS (SELECT sample_id, count(DISTINCT tool) AS n_tools FROM regions GROUP BY ALL),
         b AS (SELECT sample_id, count(*) AS n_candidates FROM sample_union GROUP BY ALL),
         c AS (SELECT sample_id, count(*) FILTER (m BETWEEN 0.2 AND 0.7) AS n_removed,
                      count(*) FILTER (NOT m BETWEEN 0.2 AND 0.7) AS n_kept FROM decided GROUP BY ALL),
         r AS (SELECT * FROM decided WHERE m BETWEEN 0.2 AND 0.7),
         d AS (SELECT a.sample_id, count(*) AS n_points, count(*) FILTER (EXISTS (SELECT 1 FROM r b WHERE {SAME_SAMPLE})) AS n_modified
               FROM points a GROUP BY ALL)
    SELECT a.sample_id, n_tools, n_candidates, n_removed, n_kept, n_points, n_modified
    FROM a JOIN b ON a.sample_id = b.sample_id JOIN c ON a.sample_id = c.sample_id JOIN d ON a.sample_id = d.sample_id""")
def _(t):
    return Z.clean_background(t.regions, t.beta_points)[1]


SMALL = {"min_len_bp": 20_000, "max_len_bp": 400_000, "min_gap_bp": 20_000, "length_mean_bp": 60_000, "length_std_bp": 40_000}
CTE["spans"] = merge_sql(DISTINCT_POINTS, "sample_id", 19_999)
CTE["segments"] = """
    SELECT sample_id, chrom, s AS start, e AS "end" FROM (
        SELECT sample_id, chrom, start + CAST(round_even(("end" - start) * 0.1, 0) AS BIGINT) AS s,
               CAST(round_even(start + ("end" - start) / 2.0 - round_even(("end" - start) * 0.1, 0) / 2.0, 0) AS BIGINT) AS e FROM spans
        UNION ALL
        SELECT sample_id, chrom, CAST(round_even(start + ("end" - start) / 2.0 + round_even(("end" - start) * 0.1, 0) / 2.0, 0) AS BIGINT),
               "end" - CAST(round_even(("end" - start) * 0.1, 0) AS BIGINT) FROM spans) WHERE e - s >= 20000"""


@query("placement_segments", "R4, I3", """
    SELECT *, ("end" - start + 20000) // 40000 AS capacity FROM segments""")
def _(t):
    return Z.placement_segments(t.points, SMALL)


CTE["changed"] = """
    SELECT sample_id, chrom, start, "end", CASE WHEN sample_id = 'P' AND start % 900 = 0 THEN coverage + 1 ELSE coverage END AS coverage,
           CASE WHEN sample_id = 'F' THEN coverage - meth WHEN sample_id = 'O' AND start % 700 = 0 THEN coverage + 1 ELSE meth END AS meth,
           EXISTS (SELECT 1 FROM merged_features f WHERE f.chrom = p.chrom AND f.start <= p.start AND p.start < f."end") AS in_truth FROM points p"""


@query("injection_checks", "B15", """
    WITH d AS (SELECT sample_id, count(*) AS n FROM (
             SELECT sample_id, chrom, start, "end", coverage, sum(d) AS d FROM (
                 SELECT sample_id, chrom, start, "end", coverage, 1 AS d FROM points UNION ALL
                 SELECT sample_id, chrom, start, "end", coverage, -1 FROM changed) GROUP BY ALL HAVING sum(d) <> 0) GROUP BY sample_id),
         b AS (SELECT sample_id, count(*) AS n_before FROM points GROUP BY sample_id),
         c AS (SELECT sample_id, count(*) AS n_after, count(*) FILTER (in_truth) AS n_modified,
                      count(*) FILTER (meth < 0 OR meth > coverage) AS n_out_of_range,
                      round(avg(meth / coverage) FILTER (in_truth), 9) AS mean_beta_after FROM changed GROUP BY sample_id)
    SELECT sample_id, n_before, n_after, n_modified, coalesce(d.n, 0) AS n_changed_keys, n_out_of_range, mean_beta_after,
           (SELECT count(*) FROM merged_features) AS n_truth, n_before = n_after AND d.n IS NULL AND n_out_of_range = 0 AND n_modified > 0 AS ok
    FROM b JOIN c USING (sample_id) LEFT JOIN d USING (sample_id)""")
def _(t):
    # one sample changed as it should be, one with values out of range, one with other coverage
    truth = t.merged_features.select(F.explode(F.array(*[F.lit(x) for x in "FOP"])).alias("sample_id"), "chrom", "start", "end")
    marked = R.label_points(t.points, truth.withColumn("in_truth", F.lit(True)), ["sample_id"], ["in_truth"])
    after = marked.select(
        "sample_id", "chrom", "start", "end", F.expr("IF(sample_id = 'P' AND start % 900 = 0, coverage + 1, coverage)").alias("coverage"),
        F.expr("CASE WHEN sample_id = 'F' THEN coverage - meth WHEN sample_id = 'O' AND start % 700 = 0 THEN coverage + 1 ELSE meth END").alias("meth"),
        F.coalesce("in_truth", F.lit(False)).alias("in_truth"))
    return rounded(Z.injection_checks(t.points, after, truth), 9, "mean_beta_after").drop("mean_beta_before")


def wide_sizes(t):
    return t.sizes.withColumn("size", F.col("size") * 20)


@query("permute_null", "R7, R8", """
    SELECT sample_id, tool, CAST(p AS INTEGER) AS perm, count(*) AS n_observed, count(*) AS n_permuted, true AS ok
    FROM merged CROSS JOIN range(0, 3) AS r(p) GROUP BY sample_id, tool, p""")
def _(t):
    permuted = materialize(Z.permute_null(t.merged, wide_sizes(t), 3), "permuted")
    return Z.null_checks(t.merged, permuted, wide_sizes(t)).select(*ST, "perm", "n_observed", "n_permuted", "ok")


@query("null_summary", "R9", """
    WITH o AS (SELECT cohort_id, feature_set, avg(mcc) AS score FROM scores WHERE feature_draw = 0 GROUP BY ALL),
         d AS (SELECT cohort_id, feature_set, feature_draw, avg(mcc) AS score FROM scores WHERE feature_draw > 0 GROUP BY ALL),
         s AS (SELECT cohort_id, feature_set, avg(score) AS m, CASE WHEN count(score) = 1 THEN 0 ELSE stddev_samp(score) END AS sd,
                      count(score) AS n FROM d GROUP BY ALL)
    SELECT o.cohort_id, o.feature_set, round(o.score, 9) AS observed, round(s.m, 9) AS null_mean, s.n AS n_null,
           round(s.sd, 9) AS null_sd, round(CASE WHEN s.m = 0 THEN NULL ELSE o.score / s.m END, 6) AS enrichment,
           round(CASE WHEN s.sd = 0 THEN NULL ELSE (o.score - s.m) / s.sd END, 6) AS z_score
    FROM o LEFT JOIN s ON s.cohort_id = o.cohort_id AND s.feature_set = o.feature_set""")
def _(t):
    from spanframe.plans.summary_queries import scores
    keys = ["cohort_id", "feature_set"]
    draws = scores(t).groupBy(*keys, "feature_draw").agg(F.avg("mcc").alias("score"))
    out = Z.null_summary(draws.where("feature_draw = 0"), draws.where("feature_draw > 0"), keys)
    return rounded(rounded(out, 9, "observed", "null_mean", "null_sd"), 6, "enrichment", "z_score")


@query("randomize_globally", "R10", """
    SELECT sample_id, tool, count(*) AS n_original, CAST(sum("end" - start) AS BIGINT) AS original_bp, count(*) AS n_randomized,
           CAST(sum("end" - start) AS BIGINT) AS randomized_bp, count(*) AS n_in_bounds, true AS chromosomes_preserved,
           true AS lengths_preserved FROM merged GROUP BY ALL""")
def _(t):
    moved = materialize(Z.randomize_globally(t.merged, t.points), "moved")
    return Z.randomized_summary(t.merged, moved, t.points).select(
        *ST, "n_original", "original_bp", "n_randomized", "randomized_bp", "n_in_bounds", "chromosomes_preserved", "lengths_preserved")


@query("length_statistics", "R11", """
    SELECT count(*) AS n_observations, round(avg("end" - start), 4) AS mean_length, round(avg(ln("end" - start)), 9) AS mean_log_length,
           round(var_samp("end" - start), 2) AS variance, CAST(min("end" - start) AS DOUBLE) AS min_length,
           CAST(max("end" - start) AS DOUBLE) AS max_length FROM regions""")
def _(t):
    out = Z.length_statistics(t.regions)
    return rounded(rounded(rounded(out, 4, "mean_length"), 9, "mean_log_length"), 2, "variance")


@query("fit_gamma_lengths", "R11", """
    SELECT round(avg("end" - start), 4) AS mean_length, count(*) AS n_observations, true AS stationary, true AS quarter FROM regions""")
def _(t):
    """At the maximum of the likelihood: shape * scale is the mean, and log(shape) - digamma(shape) the gap between log mean and mean log.
    The least realistic length is the gamma's 25 % quantile."""
    fit = Z.fit_gamma_lengths(t.regions)
    gap = np.log(fit["mean_length"]) - fit["mean_log_length"]
    stationary = abs(np.log(fit["shape"]) - digamma(fit["shape"]) - gap) < 1e-9
    x = (np.arange(200_000) + 0.5) / 200_000 * fit["min_realistic_length"]
    mass = float(np.exp((fit["shape"] - 1) * np.log(x) - x / fit["scale"] - lgamma(fit["shape"]) - fit["shape"] * np.log(fit["scale"])).mean() * fit["min_realistic_length"])
    return t.regions.agg(F.round(F.lit(fit["shape"] * fit["scale"]), 4).alias("mean_length"), F.count("*").alias("n_observations"),
                         F.lit(bool(stationary)).alias("stationary"), F.lit(abs(mass - 0.25) < 1e-3).alias("quarter"))


@query("random_matched_regions", "R12, R11, I5", """
    SELECT tool, d AS draw, CAST(20 AS BIGINT) AS n, min("end" - start) AS min_length, max("end" - start) AS max_length, count(*) AS n_reference,
           CAST(0 AS BIGINT) AS n_on_excluded, CAST(0 AS BIGINT) AS n_overlapping, CAST(0 AS BIGINT) AS n_outside
    FROM regions CROSS JOIN (SELECT x AS d FROM range(0, 2) AS t(x)) AS q GROUP BY tool, d""")
def _(t):
    """Every tool's regions as reference, all features excluded, two points or more; the places themselves are random."""
    reference = t.regions.select(F.lit(0).cast("bigint").alias("split"), F.col("tool").alias("kind"), "chrom", "start", "end", (F.col("end") - F.col("start")).alias("length"))
    sizes = materialize(t.sizes, "sizes")
    excluded = t.merged_features.withColumn("split", F.lit(0).cast("bigint"))
    anchors = materialize(t.points.select(F.lit(0).cast("bigint").alias("split"), "chrom", F.col("start").alias("anchor_pos")).distinct(), "points")
    found = materialize(FF.placed_regions(reference, excluded, sizes, anchors, 20, draws=2, min_points=2).drop("split"), "random")
    marked = R.mark_overlaps(found, t.merged_features, (), name="_x")
    marked = R.overlap_totals(marked, found.select("kind", "draw", "chrom", "start", "end"), ["kind", "draw"], count="_own")
    lengths = reference.groupBy("kind").agg(F.min("length").alias("min_length"), F.max("length").alias("max_length"), F.count("*").alias("n_reference"))
    marked = marked.join(lengths, "kind").join(sizes, "chrom")
    wrong = (F.col("n_points") < 2) | (F.col("end") > F.col("size")) | (F.col("start") < 0) | ~F.col("length").between(F.col("min_length"), F.col("max_length"))
    return marked.groupBy(F.col("kind").alias("tool"), F.col("draw").cast("bigint").alias("draw"), "min_length", "max_length", "n_reference").agg(
        F.count("*").alias("n"), F.count_if("_x").alias("n_on_excluded"), F.count_if(F.col("_own") > 1).alias("n_overlapping"), F.count_if(wrong).alias("n_outside"))


@query("sample_regions", "R13", f"""
    SELECT tool, chrom, start, "end" FROM (
        SELECT *, row_number() OVER (PARTITION BY tool ORDER BY {md5_sql(42, 'tool', 'chrom', 'start', '"end"')}) AS k
        FROM (SELECT DISTINCT tool, chrom, start, "end" FROM regions)) WHERE k <= 100""")
def _(t):
    return Z.sample_regions(t.regions, 100, part=["tool"])


@query("select_samples", "R14", f"""
    WITH r AS (SELECT *, {md5_sql(42, 'sample')} AS h FROM samples),
         k AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY h) AS i, count(*) OVER (PARTITION BY project_id) AS c FROM r),
         p AS (SELECT * FROM k WHERE c >= 5 ORDER BY greatest(i, 5), h LIMIT 60)
    SELECT sample, project_id FROM p""")
def _(t):
    return Z.select_samples(t.samples, 60, 5).select("sample", "project_id")


@query("select_tumor_samples", "R14", f"""
    WITH r AS (SELECT *, {md5_sql(42, 'sample')} AS h FROM samples WHERE sample_type = 'Primary Tumor'),
         k AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY h) AS i, count(*) OVER (PARTITION BY project_id) AS c FROM r),
         p AS (SELECT * FROM k WHERE c >= 5 ORDER BY greatest(i, 5), h LIMIT 60)
    SELECT sample, project_id, sample_type FROM p""")
def _(t):
    return Z.select_samples(t.samples, 60, 5, tumor_only=True).select("sample", "project_id", "sample_type")


@query("select_samples_by_type", "R14", f"""
    WITH r AS (SELECT *, concat(project_id, ' | ', sample_type) AS g, {md5_sql(42, 'sample')} AS h FROM samples),
         k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY h) AS i, count(*) OVER (PARTITION BY g) AS c FROM r),
         p AS (SELECT * FROM k WHERE c >= 5 ORDER BY greatest(i, 5), h LIMIT 150)
    SELECT sample, project_id, sample_type FROM p""")
def _(t):
    return Z.select_samples(t.samples, 150, 5, by_type=True).select("sample", "project_id", "sample_type")


# --------------------------------------------------------------------- cohorts

CTE["observed"] = """
    SELECT chrom, (start + "end") // 2 AS anchor_pos, max(n) AS n_observed FROM (
        SELECT chrom, start, "end", count(DISTINCT sample_id) AS n FROM matrix WHERE beta IS NOT NULL GROUP BY ALL)
    WHERE n >= 10 GROUP BY ALL"""


@query("observed_points", "M1", "SELECT * FROM observed")
def _(t):
    return M.observed_points(matrix(t), 10)


@query("regions_by_observed_points", "M2", """
    SELECT r.region_id, count(o.anchor_pos) AS training_observed_points FROM regions r JOIN observed o
    ON o.chrom = r.chrom AND o.anchor_pos >= r.start AND o.anchor_pos < r."end" GROUP BY r.region_id HAVING count(o.anchor_pos) >= 5""")
def _(t):
    out = M.regions_by_observed_points(t.regions, M.observed_points(matrix(t), 10), 5)
    return out.select("region_id", "training_observed_points")


CTE["fold_segments"] = """
    SELECT f.fold, r.* FROM regions r JOIN (SELECT 'F' AS sample_id, 0 AS fold UNION ALL SELECT 'O', 0 UNION ALL SELECT 'O', 1
        UNION ALL SELECT 'P', 1) f ON f.sample_id = r.sample_id"""
CTE["fold_merged"] = merge_sql("fold_segments", "fold", 1000)


@query("training_regions", "M3, I2", """
    SELECT m.fold, m.chrom, m.start, m."end", m."end" - m.start AS length, count(DISTINCT s.sample_id) AS sample_count
    FROM fold_merged m JOIN fold_segments s ON s.fold = m.fold AND s.chrom = m.chrom AND s.start >= m.start AND s.start < m."end"
    GROUP BY ALL""")
def _(t):
    folds = t.spark.createDataFrame(
        [(0, "F", "train", "Tumor"), (0, "O", "train", "Tumor"), (0, "P", "test", "Tumor"), (1, "F", "train", "Normal"),
         (1, "O", "train", "Tumor"), (1, "P", "train", "Tumor")], "fold int, sample_id string, split string, binary_label string")
    return M.training_regions(t.regions, folds, "Tumor").drop("samples")


CTE["patients"] = """
    SELECT cohort_id, patient_id, CASE WHEN bool_or(binary_label = 'Tumor') AND bool_or(binary_label = 'Normal') THEN 0
           WHEN bool_or(binary_label = 'Normal') THEN 1 ELSE 2 END AS stratum FROM labelled GROUP BY ALL"""
CTE["folds"] = f"""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY cohort_id, repeat, stratum
                      ORDER BY {md5_sql(42, 'repeat', 'cohort_id', 'patient_id')}) AS i
               FROM patients CROSS JOIN (SELECT CAST(x AS INTEGER) AS repeat FROM range(0, 3) AS t(x)) AS q),
         n AS (SELECT cohort_id, count(*) FILTER (stratum = 0) AS n0, count(*) FILTER (stratum = 1) AS n1 FROM patients GROUP BY ALL)
    SELECT l.sample, l.patient_id, l.binary_label, l.cohort_id, r.repeat,
           (r.i - 1 + CASE WHEN stratum = 0 THEN 0 WHEN stratum = 1 THEN n0 ELSE n0 + n1 END) % 5 AS fold
    FROM labelled l JOIN r ON r.cohort_id = l.cohort_id AND r.patient_id = l.patient_id JOIN n ON n.cohort_id = l.cohort_id"""


def labelled(t):
    return C.labelled_samples(t.samples).withColumn("cohort_id", F.col("project_id"))


@query("group_kfold", "M4", "SELECT * FROM folds")
def _(t):
    return M.group_kfold(labelled(t), 5, 3)


@query("split_validation", "M11, M4", """
    SELECT cohort_id, CAST(15 AS BIGINT) AS n_jobs, true AS ok FROM (
        SELECT cohort_id, count(*) FILTER (stratum IN (0, 2)) AS t, count(*) FILTER (stratum IN (0, 1)) AS n FROM patients GROUP BY ALL)
    WHERE t >= 5 AND n >= 5""")
def _(t):
    samples = C.labelled_samples(t.samples)
    folds = materialize(M.group_kfold(labelled(t), 5, 3), "folds")
    return M.split_validation(cohort_manifest(samples, 5), folds, 5, 3)


# ---------------------------------------------------- region sets of every fold

FOLDS, REPEATS, SIZES, DRAWS = 2, 2, [5, 20], 2
CTE["study"] = """
    SELECT DISTINCT sample_id, concat('P', CAST(CAST(substr(sample_id, 2) AS BIGINT) // 2 AS VARCHAR)) AS patient_id,
           CASE WHEN CAST(substr(sample_id, 2) AS BIGINT) % 3 = 0 THEN 'Normal' ELSE 'Tumor' END AS binary_label, 'all' AS cohort_id FROM matrix"""
CTE["study_patients"] = """
    SELECT patient_id, CASE WHEN bool_or(binary_label = 'Tumor') AND bool_or(binary_label = 'Normal') THEN 0
           WHEN bool_or(binary_label = 'Normal') THEN 1 ELSE 2 END AS stratum FROM study GROUP BY ALL"""
CTE["study_dealt"] = f"""
    SELECT patient_id, repeat, (row_number() OVER (PARTITION BY repeat, stratum ORDER BY {md5_sql(42, 'repeat', "'all'", 'patient_id')}) - 1
           + CASE stratum WHEN 0 THEN 0 WHEN 1 THEN (SELECT count(*) FROM study_patients WHERE stratum = 0)
                          ELSE (SELECT count(*) FROM study_patients WHERE stratum < 2) END) % {FOLDS} AS fold
    FROM study_patients CROSS JOIN (SELECT CAST(x AS INTEGER) AS repeat FROM range(0, {REPEATS}) AS t(x)) AS q"""
CTE["fold_members"] = f"""
    SELECT CAST(repeat * {FOLDS} + f AS BIGINT) AS split, CAST(repeat AS BIGINT) AS repeat, CAST(f AS BIGINT) AS fold, sample_id, patient_id, binary_label, fold = f AS is_test
    FROM study JOIN study_dealt USING (patient_id) CROSS JOIN (SELECT x AS f FROM range(0, {FOLDS}) AS t(x)) AS q"""
CTE["fold_anchors"] = """
    SELECT DISTINCT split, chrom, (start + "end") // 2 AS anchor_pos FROM matrix JOIN fold_members USING (sample_id) WHERE beta IS NOT NULL AND NOT is_test"""
CTE["train_segments"] = """
    SELECT split, binary_label, sample_id, chrom, start, "end" FROM cohort_segments JOIN fold_members USING (sample_id) WHERE NOT is_test"""
CTE["train_merged"] = merge_sql("train_segments", "split, binary_label", 1000)
CTE["train_regions"] = """
    SELECT m.split, m.binary_label, m.chrom, m.start, m."end", count(DISTINCT s.sample_id) AS sample_count, m."end" - m.start AS length
    FROM train_merged m JOIN train_segments s ON s.split = m.split AND s.binary_label = m.binary_label AND s.chrom = m.chrom AND s.start >= m.start AND s.start < m."end"
    GROUP BY ALL"""
CTE["seen_regions"] = """
    SELECT r.*, (SELECT count(*) FROM fold_anchors a WHERE a.split = r.split AND a.chrom = r.chrom AND a.anchor_pos >= r.start AND a.anchor_pos < r."end")
           AS training_observed_points FROM train_regions r"""
CTE["eligible_tumor"] = "SELECT * FROM seen_regions WHERE binary_label = 'Tumor' AND training_observed_points > 0"
CTE["eligible_normal"] = """
    SELECT *, row_number() OVER (PARTITION BY split ORDER BY sample_count DESC, length DESC, chrom, start) AS place
    FROM seen_regions WHERE binary_label = 'Normal' AND training_observed_points > 0"""
CTE["eligible_islands"] = """
    SELECT * FROM (SELECT split, chrom, start, "end", "end" - start AS length,
        (SELECT count(*) FROM fold_anchors a WHERE a.split = s.split AND a.chrom = f.chrom AND a.anchor_pos >= f.start AND a.anchor_pos < f."end") AS training_observed_points
        FROM (SELECT DISTINCT chrom, start, "end" FROM features) f CROSS JOIN (SELECT DISTINCT split FROM fold_members) s) WHERE training_observed_points > 0"""
CTE["set_sizes"] = f"SELECT CAST(unnest({SIZES}) AS BIGINT) AS n_features"
CTE["pmd_sets"] = """
    SELECT split, 'PMD' AS feature_set, n_features, 0 AS feature_draw, row_number() OVER (PARTITION BY split, n_features
           ORDER BY sample_count DESC, length DESC, chrom, start) - 1 AS region_index, chrom, start, "end", length, training_observed_points, sample_count
    FROM eligible_tumor a CROSS JOIN set_sizes WHERE NOT EXISTS (SELECT 1 FROM eligible_normal b WHERE b.split = a.split AND b.chrom = a.chrom
        AND b.place <= n_features AND b.start <= a."end" + 1000 AND b."end" >= a.start - 1000)"""


def drawn_sql(source: str, name: str, count: str) -> str:
    return f"""
    SELECT split, '{name}' AS feature_set, n_features, feature_draw, place - 1 AS region_index, chrom, start, "end", length, training_observed_points, {count} AS sample_count
    FROM (SELECT *, row_number() OVER (PARTITION BY split, feature_draw ORDER BY {md5_sql(f'42-{name}', 'split', 'feature_draw', 'chrom', 'start', '"end"')}) AS place
          FROM {source} CROSS JOIN (SELECT x AS feature_draw FROM range(0, {DRAWS}) AS t(x)) AS q) CROSS JOIN set_sizes WHERE place <= n_features"""


CTE["random_pmd_sets"] = drawn_sql("eligible_tumor", "Random PMD", "sample_count")
CTE["island_sets"] = drawn_sql("eligible_islands", "CGI", "CAST(NULL AS BIGINT)")
CTE["fold_sets"] = """
    SELECT * FROM pmd_sets WHERE region_index < n_features UNION ALL SELECT * FROM random_pmd_sets UNION ALL SELECT * FROM island_sets"""


def assigned(t, beta=None):
    """Grouped folds of the array samples: patients of two samples, every third sample normal."""
    number = F.substring("sample_id", 2, 9).cast("bigint")
    samples = (materialize(matrix(t), "matrix") if beta is None else beta).select("sample_id").distinct().select(
        F.col("sample_id").alias("sample"), F.concat(F.lit("P"), F.expr("CAST(substr(sample_id, 2) AS BIGINT) DIV 2")).alias("patient_id"),
        F.when(number % 3 == 0, "Normal").otherwise("Tumor").alias("binary_label"), F.lit("all").alias("cohort_id"))
    return materialize(M.group_kfold(samples, FOLDS, REPEATS).withColumnRenamed("sample", "sample_id"), "assigned")


def fold_sets(t, names, sizes=SIZES, draws=DRAWS, beta=None, cohort=None):
    beta = materialize(matrix(t), "matrix") if beta is None else beta
    cohort = assigned(t, beta) if cohort is None else cohort
    return FF.fold_feature_sets(beta, t.cohort_segments, t.features, cohort, t.sizes, FOLDS, REPEATS, sizes, draws, names=names)


@query("fold_anchors", "M1, M4", "SELECT split, chrom, anchor_pos FROM fold_anchors")
def _(t):
    return FF.fold_anchors(matrix(t), assigned(t), FOLDS, REPEATS)


# the sets of this query's SQL: equal segments are one row before they are merged, so that no tie decides where a region starts
CTE["set_merged"] = merge_sql('(SELECT DISTINCT split, binary_label, chrom, start, "end" FROM train_segments)', "split, binary_label", 1000)
for _name, _from in {"regions": "train_regions", "seen": "seen_regions", "tumor": "eligible_tumor", "normal": "eligible_normal", "pmd": "pmd_sets",
                     "random_pmd": "random_pmd_sets", "all": "fold_sets"}.items():
    _text = CTE[_from]
    for _old, _new in {"train_merged": "set_merged", "train_regions": "set_regions", "seen_regions": "set_seen", "eligible_tumor": "set_tumor",
                       "eligible_normal": "set_normal", "random_pmd_sets": "set_random_pmd", " pmd_sets": " set_pmd"}.items():
        _text = _text.replace(_old, _new)
    CTE[f"set_{_name}"] = _text


@query("fold_feature_sets", "M5, M7, M2, M3, W3, R13, I11", "SELECT * FROM set_all")
def _(t):
    return fold_sets(t, ["PMD", "Random PMD", "CGI"])


CTE["length_kinds"] = """
    SELECT split, 'Random long' AS feature_set, length FROM eligible_tumor UNION ALL SELECT split, 'Random short', length FROM eligible_islands"""


@query("fold_random_regions", "M5, R11, R12, I5", f"""
    SELECT split, feature_set, n_features, d AS feature_draw, n_features AS n_regions, min_length, max_length, n_reference, CAST(0 AS BIGINT) AS n_overlapping,
           CAST(0 AS BIGINT) AS n_on_training, CAST(0 AS BIGINT) AS n_without_point, CAST(0 AS BIGINT) AS n_outside, true AS lengths_follow
    FROM (SELECT split, feature_set, min(length) AS min_length, max(length) AS max_length, count(*) AS n_reference FROM length_kinds GROUP BY ALL)
    CROSS JOIN set_sizes CROSS JOIN (SELECT x AS d FROM range(0, {DRAWS}) AS t(x)) AS q""")
def _(t):
    """Sizes and reference lengths by set, and counts of what must not be: the placements themselves are random."""
    beta = materialize(matrix(t), "matrix")
    cohort = assigned(t, beta)
    members = materialize(FF.fold_members(cohort, FOLDS), "members")
    sets = materialize(fold_sets(t, ["Random long", "Random short"], beta=beta, cohort=cohort), "sets")
    anchors = materialize(FF.fold_anchors(beta, cohort, FOLDS, REPEATS), "anchors")
    whole = materialize(FF.fold_regions(t.cohort_segments, members, "Tumor"), "whole")
    tumor = FF.observed_regions(whole, anchors).select("split", F.lit("Random long").alias("feature_set"), "length")
    every = F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(FOLDS * REPEATS)]))
    islands = t.features.select("chrom", "start", "end").distinct().select(every.alias("split"), "chrom", "start", "end").withColumn("length", F.col("end") - F.col("start"))
    short = FF.observed_regions(islands, anchors).select("split", F.lit("Random short").alias("feature_set"), "length")
    kinds = tumor.unionByName(short).groupBy("split", "feature_set").agg(
        F.min("length").alias("min_length"), F.max("length").alias("max_length"), F.count("*").alias("n_reference"), F.avg("length").alias("mean_length"))
    marked = R.mark_overlaps(sets, whole.select("split", "chrom", "start", "end"), ["split"], name="on_training")
    marked = R.count_points(marked, anchors.select("split", "chrom", F.col("anchor_pos").alias("start")), ["split"], "n_points")
    marked = R.overlap_totals(marked, sets.select(*FF.SET, "chrom", "start", "end"), FF.SET, count="n_own")
    marked = marked.join(t.sizes, "chrom").join(kinds, ["split", "feature_set"])
    out = marked.groupBy(*FF.SET, "min_length", "max_length", "n_reference").agg(
        F.count("*").alias("n_regions"), F.count_if(F.col("n_own") > 1).alias("n_overlapping"), F.count_if("on_training").alias("n_on_training"),
        F.count_if((F.col("n_points") < 1) | (F.col("n_points") != F.col("training_observed_points"))).alias("n_without_point"),
        F.count_if((F.col("start") < 0) | (F.col("end") > F.col("size")) | (F.col("length") < F.col("min_length")) | (F.col("length") > F.col("max_length"))
                   | (F.col("length") != F.col("end") - F.col("start"))).alias("n_outside"),
        (F.avg("length") / F.avg("mean_length")).alias("_ratio"))
    # a mean of five lengths or more lies within a factor of four of its gamma's mean
    return out.withColumn("lengths_follow", F.col("_ratio").between(0.25, 4)).drop("_ratio")


CTE["benchmark_sets"] = """
    SELECT unnest(['Always cancer', 'PMD', 'Random PMD', 'CGI', 'Random long', 'Random short']) AS feature_set"""


@query("fold_benchmark", "M6, M7, A7, B16", """
    WITH n AS (SELECT split, repeat, fold, count(*) FILTER (binary_label = 'Tumor') AS positives, count(*) FILTER (binary_label = 'Normal') AS negatives
               FROM fold_members WHERE is_test AND repeat = 0 GROUP BY ALL)
    SELECT split, repeat, fold, CAST(0 AS BIGINT) AS feature_draw, feature_set, CAST(5 AS BIGINT) AS n_features, positives, negatives, true AS in_range,
           CASE WHEN feature_set = 'Always cancer' THEN round(positives / (2 * positives + negatives), 9) END AS always_macro_f1,
           CASE WHEN feature_set = 'Always cancer' THEN round(positives / (positives + negatives), 9) END AS always_precision
    FROM n CROSS JOIN benchmark_sets""")
def _(t):
    """Forests are random, so their rows are held to what must be so: test classes counted, scores within their ranges."""
    once = assigned(t).where("repeat = 0")
    scores, _, _ = FF.run_fold_benchmark(materialize(matrix(t), "matrix"), t.cohort_segments, t.features, once, t.sizes, FOLDS, 1, [5], trees=100)
    always = F.col("feature_set") == "Always cancer"
    inside = F.col("balanced_accuracy").between(0, 1) & F.col("roc_auc").between(0, 1) & F.col("average_precision").between(0, 1) & F.col("mcc").between(-1, 1)
    return scores.select("split", "repeat", "fold", "feature_draw", "feature_set", "n_features", (F.col("tp") + F.col("fn")).alias("positives"),
                         (F.col("tn") + F.col("fp")).alias("negatives"), inside.alias("in_range"),
                         F.when(always, F.round("macro_f1", 9)).alias("always_macro_f1"), F.when(always, F.round("average_precision", 9)).alias("always_precision"))


def vectors(t):
    """Mean values of the cohort's samples over all regions with two observed points or more that no sample lacks."""
    beta = materialize(matrix(t), "matrix")
    regions = M.regions_by_observed_points(t.merged_features, M.observed_points(beta, 10), 2)
    indexed = materialize(M.index_regions(regions.withColumn("feature_set", F.lit("all"))).drop("feature_set"), "indexed")
    rows, _ = M.sample_vectors(materialize(region_features(beta, indexed), "features"))
    number = F.substring("sample_id", 2, 9).cast("bigint")
    return materialize(rows.withColumn("label", F.when(number % 3 == 0, 0).otherwise(1)).withColumn("fold", F.floor(number / 2) % 2), "vectors")


CTE["held_out"] = """
    SELECT CASE WHEN binary_label = 'Normal' THEN 'Normal' ELSE 'Tumor' END AS class, count(*) AS n FROM study
    WHERE (CAST(substr(sample_id, 2) AS BIGINT) // 2) % 2 = 1 GROUP BY ALL"""


@query("holdout_classifier", "M8, B17", """
    SELECT class, n AS support, true AS in_range FROM held_out
    UNION ALL SELECT unnest(['macro', 'micro']), CAST(sum(n) AS BIGINT), true FROM held_out""")
def _(t):
    rows = vectors(t)
    report, _ = M.holdout_classifier(rows.where("fold = 0"), rows.where("fold = 1"), ["Normal", "Tumor"])
    inside = F.col("precision").between(0, 1) & F.col("recall").between(0, 1) & F.col("f1").between(0, 1)
    return report.select("class", "support", inside.alias("in_range"))


@query("sample_pca", "M9", """
    SELECT count(DISTINCT sample_id) AS n_samples, 0.0 AS mean_pc1, 0.0 AS mean_pc2, 0.0 AS dot, true AS ordered, true AS explained_fits FROM matrix""")
def _(t):
    """Components have arbitrary signs; checked: mean 0, no correlation, variances in order and as the explained ratios say."""
    out, ratios = M.sample_pca(vectors(t))
    squares = [F.sum(F.col(c) * F.col(c)) for c in ("pc1", "pc2")]
    total = squares[0] / ratios[0]
    return out.agg(F.count("*").alias("n_samples"), F.abs(F.round(F.avg("pc1"), 6)).alias("mean_pc1"), F.abs(F.round(F.avg("pc2"), 6)).alias("mean_pc2"),
                   F.abs(F.round(F.avg(F.col("pc1") * F.col("pc2")), 6)).alias("dot"), (squares[0] >= squares[1]).alias("ordered"),
                   (F.abs(squares[1] / total - ratios[1]) < 1e-6).alias("explained_fits"))


# tasks of four cohorts over the same folds: whole runs; one without a set; one set short of rows; one with moved patients
CTE["task_rows"] = f"""
    SELECT c AS cohort_id, concat(c, '_', CAST(n_features AS VARCHAR)) AS task, feature_set, split FROM
        (SELECT unnest(['whole', 'missing', 'short', 'moved']) AS c), set_sizes, (SELECT DISTINCT split FROM fold_members),
        (SELECT 'PMD' AS feature_set UNION ALL SELECT 'Always cancer' UNION ALL SELECT 'CGI' FROM range(0, {DRAWS}))
    WHERE NOT (n_features = 5 AND (c = 'missing' AND feature_set = 'CGI' OR c = 'short' AND feature_set = 'PMD' AND split = 0))"""
CTE["task_samples"] = f"""
    SELECT c AS cohort_id, concat(c, '_', CAST(n_features AS VARCHAR)) AS task, repeat, sample_id, patient_id,
           CASE WHEN c = 'moved' AND n_features = 5 AND CAST(substr(sample_id, 2) AS BIGINT) % 14 = 0 THEN ({FOLDS} - 1) - fold ELSE fold END AS fold
    FROM (SELECT unnest(['whole', 'missing', 'short', 'moved']) AS c), set_sizes, (SELECT * FROM fold_members WHERE is_test)"""


@query("completed_run_checks", "M10", f"""
    WITH n AS (SELECT count(DISTINCT split) AS n FROM fold_members),
         w AS (SELECT task, 'PMD' AS feature_set, n AS want FROM (SELECT DISTINCT task FROM task_rows), n UNION ALL SELECT task, 'Always cancer', n FROM (SELECT DISTINCT task FROM task_rows), n
               UNION ALL SELECT task, 'CGI', n * {DRAWS} FROM (SELECT DISTINCT task FROM task_rows), n),
         c AS (SELECT w.task, sum(coalesce(r.k, 0)) AS n_rows, count(*) FILTER (coalesce(r.k, 0) <> want) AS n_wrong_sets
               FROM w LEFT JOIN (SELECT task, feature_set, count(*) AS k FROM task_rows GROUP BY ALL) r ON r.task = w.task AND r.feature_set = w.feature_set GROUP BY w.task),
         l AS (SELECT task, count(*) FILTER (f > 1) AS n FROM (SELECT task, repeat, patient_id, count(DISTINCT fold) AS f FROM task_samples GROUP BY ALL) GROUP BY task),
         d AS (SELECT a.task, count(*) FILTER (b.n < 2) AS n FROM task_samples a
               JOIN (SELECT cohort_id, repeat, fold, sample_id, count(DISTINCT task) AS n FROM task_samples GROUP BY ALL) b
               ON b.cohort_id = a.cohort_id AND b.repeat = a.repeat AND b.fold = a.fold AND b.sample_id = a.sample_id GROUP BY a.task)
    SELECT c.task, CAST(n_rows AS BIGINT) AS n_rows, n_wrong_sets, l.n AS n_leaking_patients, d.n AS n_fold_differences, n_wrong_sets = 0 AND l.n = 0 AND d.n = 0 AS ok
    FROM c JOIN l ON l.task = c.task JOIN d ON d.task = c.task""")
def _(t):
    members = materialize(FF.fold_members(assigned(t), FOLDS).where("is_test"), "tests")
    cases = F.explode(F.array(*[F.lit(c) for c in ("whole", "missing", "short", "moved")]))
    sizes = F.explode(F.array(*[F.lit(n) for n in SIZES]))

    def tasks(df):
        return df.withColumn("cohort_id", cases).withColumn("n", sizes).withColumn("task", F.concat_ws("_", "cohort_id", "n"))

    sets = F.explode(F.array(F.lit("PMD"), F.lit("Always cancer"), *[F.lit("CGI")] * DRAWS))
    small = F.col("n") == 5
    lacking = small & ((F.col("cohort_id") == "missing") & (F.col("feature_set") == "CGI") | (F.col("cohort_id") == "short") & (F.col("feature_set") == "PMD") & (F.col("split") == 0))
    results = tasks(members.select("split").distinct()).withColumn("feature_set", sets).where(~lacking)
    number = F.substring("sample_id", 2, 9).cast("bigint")
    moved = small & (F.col("cohort_id") == "moved") & (number % 14 == 0)
    placed = tasks(members).withColumn("fold", F.when(moved, FOLDS - 1 - F.col("fold")).otherwise(F.col("fold")))
    runs_of = FOLDS * REPEATS
    return M.completed_run_checks(results, placed.drop("patient_id"), {"PMD": runs_of, "Always cancer": runs_of, "CGI": runs_of * DRAWS},
                                  members.select("sample_id", "patient_id").distinct())


# --------------------------------------------------------------------- context

CTE["ctx"] = """
    SELECT sample_id, chrom, start, beta, count(*) OVER w AS n, avg(beta) OVER w AS m, stddev_pop(beta) OVER w AS sd,
           avg(CASE WHEN beta > 0.8 THEN 1.0 ELSE 0.0 END) OVER w AS fh,
           avg(CASE WHEN beta >= 0.2 AND beta <= 0.7 THEN 1.0 ELSE 0.0 END) OVER w AS fi
    FROM beta_points WINDOW w AS (PARTITION BY sample_id, chrom ORDER BY start RANGE BETWEEN 5000 PRECEDING AND 5000 FOLLOWING)"""
CTE["ctx_one"] = """
    SELECT sample_id, chrom, start, round(avg(beta), 9) AS beta, any_value(n) AS n, round(any_value(m), 9) AS m,
           round(any_value(sd), 6) AS sd, round(any_value(fh), 9) AS fh, round(any_value(fi), 9) AS fi
    FROM ctx GROUP BY sample_id, chrom, start"""
CTE["states"] = """
    SELECT *, CASE WHEN fi >= 0.5604250370335937 AND sd <= 0.26418485236146244 AND fh <= 0.2462720810967043 THEN 'partial'
                   WHEN beta <= 0.28953450344841725 THEN 'low' WHEN beta >= 0.694195675252982 THEN 'high' ELSE 'other' END AS state FROM ctx_one"""
CTE["state_runs"] = """
    SELECT sample_id, chrom, state, min(start) AS start, max(start) + 2 AS "end", count(*) AS n_points FROM (
        SELECT *, sum(fresh) OVER (PARTITION BY sample_id, chrom ORDER BY start) AS run FROM (
            SELECT *, CASE WHEN state = lag(state) OVER (PARTITION BY sample_id, chrom ORDER BY start) THEN 0 ELSE 1 END AS fresh
            FROM states)) GROUP BY sample_id, chrom, state, run HAVING count(*) >= 5"""
STATES = ["partial", "low", "high", "other"]


@query("context_features", "G1", """
    SELECT sample_id, chrom, start, beta, CAST(n AS BIGINT) AS n_10000, m AS mean_10000, sd AS std_10000,
           fh AS fraction_high_10000, fi AS fraction_intermediate_10000 FROM ctx_one""")
def _(t):
    return contexts(t)


def contexts(t):
    out = G.context_features(t.beta_points, [10_000])
    out = rounded(out, 9, "beta", "mean_10000", "fraction_high_10000", "fraction_intermediate_10000")
    return rounded(out, 6, "std_10000")


def ruled(t):
    return materialize(G.states_by_rule(contexts(t), 10_000), "states")


@query("states_by_rule", "G2", "SELECT sample_id, chrom, start, state FROM states")
def _(t):
    return ruled(t).select("sample_id", "chrom", "start", "state")


@query("states_by_cluster", "G3")
def _(t):
    features = materialize(G.context_features(t.beta_points, [10_000]), "features")
    out = G.states_by_cluster(features, ["beta", "mean_10000", "std_10000", "fraction_high_10000", "fraction_intermediate_10000"])
    return out.groupBy("state").agg(F.count("*").alias("n"), F.round(F.avg("beta"), 6).alias("mean_beta"))


@query("states_to_regions", "G4", "SELECT * FROM state_runs")
def _(t):
    return G.states_to_regions(ruled(t), STATES)


CTE["partial_runs"] = "SELECT * FROM state_runs WHERE state = 'partial'"
CTE["gap_merged"] = merge_sql("partial_runs", "sample_id", 20_000)


@query("clean_regions", "G5", """
    SELECT g.sample_id, g.chrom, g.start, g."end", count(*) AS point_count, round(avg(p.beta), 9) AS mean_beta
    FROM gap_merged g JOIN beta_points p ON p.sample_id = g.sample_id AND p.chrom = g.chrom AND p.start >= g.start AND p.start < g."end"
    WHERE g."end" - g.start >= 5000 GROUP BY ALL HAVING count(*) >= 6""")
def _(t):
    partial = G.states_to_regions(ruled(t), STATES).where("state = 'partial'")
    return rounded(G.clean_regions(partial, t.beta_points, merge_gap=20_000), 9, "mean_beta")


@query("point_states", "G7", """
    SELECT p.point_id, CAST(EXISTS (SELECT 1 FROM sample_union r WHERE r.sample_id = p.sample_id AND r.chrom = p.chrom
        AND r.start <= p.start AND p.start <= r."end") AS INTEGER) AS state FROM points p""")
def _(t):
    return G.point_states(t.points, t.regions).select("point_id", "state")

