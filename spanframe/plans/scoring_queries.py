"""Truth scoring, association, comparison and ranking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanframe.operators import association as L
from spanframe.operators import cleaning as C
from spanframe.operators import ranges as R
from spanframe.operators import ranking as W
from spanframe.operators import scoring as B
from spanframe.plans.interval_queries import HITS, SAME_SAMPLE
from spanframe.plans.registry import CTE, merge_sql, query, rounded
from spanframe.plans.summary_queries import matrix, scores, shared_regions
from spanframe.session import materialize
from spanframe.sources.tables import table

ST = ["sample_id", "tool"]
TOL = 1000

CTE["tagged_truth"] = """SELECT *, "end" - start AS len, concat('T', CAST(row_number() OVER (
    PARTITION BY sample_id ORDER BY chrom, start, "end") AS VARCHAR)) AS truth_id FROM truth"""
CTE["tagged_calls"] = """SELECT *, "end" - start AS len, concat('R', CAST(row_number() OVER (
    PARTITION BY sample_id, tool ORDER BY chrom, start, "end") AS VARCHAR)) AS recall_id FROM calls"""
CTE["wide_truth"] = f"""SELECT t.sample_id, t.chrom, greatest(t.start - {TOL}, 0) AS start,
    least(t."end" + {TOL}, s.size) AS "end" FROM truth t JOIN sizes s ON t.chrom = s.chrom"""
CTE["raw_pairs"] = f"""
    SELECT c.sample_id, c.tool, c.chrom, t.truth_id, c.recall_id, t.start AS truth_start, t."end" AS truth_end,
           t.len AS truth_len, c.start AS recall_start, c."end" AS recall_end, c.len AS recall_len,
           least(c."end", least(t."end" + {TOL}, s.size)) - greatest(c.start, greatest(t.start - {TOL}, 0)) AS slop_overlap_bp,
           greatest(least(c."end", t."end") - greatest(c.start, t.start), 0) AS orig_overlap_bp,
           least(greatest(t.start - c.start, -{TOL}), {TOL}) AS left_slop_bp,
           least(greatest(c."end" - t."end", -{TOL}), {TOL}) AS right_slop_bp
    FROM tagged_calls c JOIN tagged_truth t ON c.sample_id = t.sample_id AND c.chrom = t.chrom JOIN sizes s ON s.chrom = t.chrom
    WHERE c.start < least(t."end" + {TOL}, s.size) AND c."end" > greatest(t.start - {TOL}, 0)"""
CTE["pairs"] = """
    SELECT *, left_slop_bp + right_slop_bp AS used_slop_bp, truth_len + left_slop_bp + right_slop_bp AS denom,
           CASE WHEN truth_len + left_slop_bp + right_slop_bp > 0
                THEN slop_overlap_bp / (truth_len + left_slop_bp + right_slop_bp) ELSE 0 END AS truth_pct_overlap,
           abs(recall_start - truth_start) AS start_error_bp, abs(recall_end - truth_end) AS end_error_bp,
           (abs(recall_start - truth_start) + abs(recall_end - truth_end)) / 2 AS mabe_bp
    FROM raw_pairs"""


def tagged(t):
    return materialize(B.tag_truth(t.truth), "truth"), materialize(B.tag_calls(t.calls), "calls")


def pairs(t, tags=None):
    truth, calls = tags or tagged(t)
    return B.score_pairs(truth, calls, TOL, t.sizes)


@query("score_pairs", "B1", """
    SELECT * REPLACE (round(truth_pct_overlap, 9) AS truth_pct_overlap), true AS hit_any,
           truth_pct_overlap >= 0.5 AS hit_majority, truth_pct_overlap >= 0.75 AS hit_super_majority FROM pairs""")
def _(t):
    return rounded(pairs(t), 9, "truth_pct_overlap")


CTE["caller_counts"] = """
    SELECT c.sample_id, c.tool, n_truth, n_calls FROM (SELECT sample_id, tool, count(*) AS n_calls FROM calls GROUP BY ALL) AS c
    JOIN (SELECT sample_id, count(*) AS n_truth FROM truth GROUP BY ALL) AS t ON t.sample_id = c.sample_id"""
CTE["level_hits"] = """
    SELECT *, 'any' AS hit_level FROM pairs UNION ALL SELECT *, 'majority' FROM pairs WHERE truth_pct_overlap >= 0.5
    UNION ALL SELECT *, 'super_majority' FROM pairs WHERE truth_pct_overlap >= 0.75"""
CTE["best_hits"] = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, tool, hit_level, truth_id
    ORDER BY truth_pct_overlap DESC, slop_overlap_bp DESC, recall_id) AS k FROM level_hits) WHERE k = 1"""


@query("region_resolution", "B2, W2", """
    WITH g AS (SELECT *, unnest(['any', 'majority', 'super_majority']) AS hit_level FROM caller_counts),
         b AS (SELECT sample_id, tool, hit_level, count(*) AS truth_hits, sum(least(1, truth_pct_overlap)) AS share,
                      avg(mabe_bp) AS mabe FROM best_hits GROUP BY ALL),
         r AS (SELECT sample_id, tool, hit_level, count(DISTINCT recall_id) AS recalled_hits FROM level_hits GROUP BY ALL),
         j AS (SELECT g.*, coalesce(truth_hits, 0) AS truth_hits, coalesce(recalled_hits, 0) AS recalled_hits, share, mabe
               FROM g LEFT JOIN b ON b.sample_id = g.sample_id AND b.tool = g.tool AND b.hit_level = g.hit_level
               LEFT JOIN r ON r.sample_id = g.sample_id AND r.tool = g.tool AND r.hit_level = g.hit_level)
    SELECT sample_id, tool, hit_level, n_truth, n_calls, truth_hits, recalled_hits, round(truth_hits / n_truth, 9) AS recall,
           round(recalled_hits / n_calls, 9) AS precision,
           round(2 * (truth_hits / n_truth) * (recalled_hits / n_calls)
                 / nullif(truth_hits / n_truth + recalled_hits / n_calls, 0), 9) AS f1,
           round(coalesce(share, 0) / n_truth, 9) AS per_region_recall_fraction, round(mabe, 4) AS mabe FROM j""")
def _(t):
    truth, calls = tagged(t)
    out = B.region_resolution(materialize(pairs(t, (truth, calls)), "pairs"), B.caller_sizes(truth, calls))
    return rounded(rounded(out, 9, "recall", "precision", "f1", "per_region_recall_fraction"), 4, "mabe")


CTE["weighted"] = f"""
    SELECT sample_id, chrom, start, "end", count(*) AS w FROM points a
    WHERE NOT EXISTS (SELECT 1 FROM (
        SELECT w.sample_id, w.chrom, w.start, w."end" FROM band w) b WHERE {SAME_SAMPLE}) GROUP BY ALL"""
CTE["band"] = f"""
    WITH wt AS ({merge_sql('wide_truth', 'sample_id')}),
         gaps AS (SELECT sample_id, chrom, coalesce(lag("end") OVER (PARTITION BY sample_id, chrom ORDER BY start), -1) AS start,
                         start AS "end" FROM truth
                  UNION ALL SELECT sample_id, chrom, max("end"), 1000000000000 FROM truth GROUP BY ALL)
    SELECT a.sample_id, a.chrom, greatest(a.start, b.start) AS start, least(a."end", b."end") AS "end"
    FROM wt a JOIN gaps b ON {SAME_SAMPLE}"""
CTE["scorable"] = f"""SELECT a.*, EXISTS (SELECT 1 FROM truth b WHERE {SAME_SAMPLE}) AS is_truth FROM weighted a"""
CTE["confusion"] = f"""
    WITH tot AS (SELECT sample_id, sum(w) AS n, sum(w) FILTER (is_truth) AS nt FROM scorable GROUP BY ALL),
         pr AS (SELECT sample_id, tool, sum(w) AS np, coalesce(sum(w) FILTER (is_truth), 0) AS tp FROM (
                    SELECT DISTINCT a.sample_id, b.tool, a.chrom, a.start, a."end", a.w, a.is_truth
                    FROM scorable a JOIN calls b ON {SAME_SAMPLE}) GROUP BY ALL)
    SELECT pr.sample_id, pr.tool, CAST(tp AS BIGINT) AS bp_tp, CAST(np - tp AS BIGINT) AS bp_fp,
           CAST(nt - tp AS BIGINT) AS bp_fn, CAST(n - nt - np + tp AS BIGINT) AS bp_tn
    FROM pr JOIN tot ON tot.sample_id = pr.sample_id"""


@query("point_confusion", "B3", """
    SELECT *, round(bp_tp / (bp_tp + bp_fp), 9) AS bp_precision, round(bp_tp / (bp_tp + bp_fn), 9) AS bp_recall,
           round(2 * bp_tp / (2 * bp_tp + bp_fp + bp_fn), 9) AS bp_f1, round(bp_tp / (bp_tp + bp_fp + bp_fn), 9) AS bp_jaccard,
           round(bp_tn / (bp_tn + bp_fp), 9) AS bp_specificity,
           round((bp_tp + bp_tn) / (bp_tp + bp_tn + bp_fp + bp_fn), 9) AS bp_accuracy FROM confusion""")
def _(t):
    out = B.point_confusion(t.points, t.truth, t.calls, TOL, t.sizes)
    return rounded(out, 9, *[c for c in out.columns if c.startswith("bp_") and c[3:] not in ("tp", "fp", "fn", "tn")])


@query("fragmentation_absorption", "B4", """
    WITH a AS (SELECT sample_id, tool, avg(k) AS m, sum(k) AS s FROM (SELECT sample_id, tool, truth_id, count(DISTINCT recall_id) AS k
               FROM pairs GROUP BY ALL) GROUP BY ALL),
         b AS (SELECT sample_id, tool, avg(k) AS m, sum(k) AS s FROM (SELECT sample_id, tool, recall_id, count(DISTINCT truth_id) AS k
               FROM pairs GROUP BY ALL) GROUP BY ALL)
    SELECT c.sample_id, c.tool, round(a.m, 9) AS fragmentation, round(b.m, 9) AS absorption,
           round(abs(a.m - 1), 9) AS fragmentation_distance_from_1, round(abs(b.m - 1), 9) AS absorption_distance_from_1,
           round(a.s / n_truth, 9) AS absolute_fragmentation, round(b.s / n_calls, 9) AS absolute_absorption,
           round(abs(a.s / n_truth - 1), 9) AS absolute_fragmentation_distance_from_1,
           round(abs(b.s / n_calls - 1), 9) AS absolute_absorption_distance_from_1
    FROM caller_counts c JOIN a ON a.sample_id = c.sample_id AND a.tool = c.tool
    JOIN b ON b.sample_id = c.sample_id AND b.tool = c.tool""")
def _(t):
    truth, calls = tagged(t)
    out = B.fragmentation_absorption(materialize(pairs(t, (truth, calls)), "pairs"), B.caller_sizes(truth, calls))
    return rounded(out, 9, *[c for c in out.columns if c not in ST])


def direction_sql(source: str, target: str) -> str:
    return f"""
    SELECT sample_id, '{source}' AS source_tool, '{target}' AS target_tool, count(*) AS n_source_segments,
           round(avg(n), 9) AS mean_target_overlaps, CAST(median(n) AS DOUBLE) AS median_target_overlaps,
           round(avg(CASE WHEN n > 1 THEN 1.0 ELSE 0.0 END), 9) AS fraction_split_gt1,
           round(avg(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END), 9) AS fraction_any_overlap, round(avg(bp), 4) AS mean_overlap_bp,
           round(avg(bp / len), 9) AS mean_overlap_fraction
    FROM (SELECT a.region_id, a.sample_id, a."end" - a.start AS len, count(b.region_id) AS n,
                 sum(CASE WHEN b.start IS NULL THEN 0 ELSE least(a."end", b."end") - greatest(a.start, b.start) END) AS bp
          FROM (SELECT * FROM regions WHERE tool = '{source}') a LEFT JOIN (SELECT * FROM regions WHERE tool = '{target}') b
          ON {SAME_SAMPLE} GROUP BY ALL) GROUP BY sample_id"""


@query("directional_fragmentation", "B5", direction_sql("1", "2") + " UNION ALL " + direction_sql("2", "1"))
def _(t):
    out = B.directional_fragmentation(t.regions, "1", "2")
    return rounded(rounded(out, 9, "mean_target_overlaps", "fraction_split_gt1", "fraction_any_overlap",
                           "mean_overlap_fraction"), 4, "mean_overlap_bp")


CTE["false_calls"] = f"SELECT * FROM calls a WHERE NOT EXISTS (SELECT 1 FROM wide_truth b WHERE {SAME_SAMPLE})"


@query("false_positive_regions", "B6", "SELECT * FROM false_calls")
def _(t):
    return B.false_positive_regions(t.truth, t.calls, TOL, t.sizes)


@query("false_region_betas", "B6", f"""
    SELECT a.sample_id, a.tool, a.chrom, a.start, a."end", count(b.beta) AS n_points, round(avg(b.beta), 9) AS mean_beta
    FROM false_calls a LEFT JOIN beta_points b ON {SAME_SAMPLE} GROUP BY ALL""")
def _(t):
    false = B.false_positive_regions(t.truth, t.calls, TOL, t.sizes)
    return rounded(B.false_region_betas(false, t.beta_points), 9, "mean_beta")


CTE["false_betas"] = f"""
    SELECT a.sample_id, a.tool, a.chrom, a.start, a."end", avg(b.beta) AS mean_beta FROM false_calls a LEFT JOIN beta_points b ON {SAME_SAMPLE} GROUP BY ALL"""


@query("recovery_metrics", "B7, J1", """
    WITH any_hits AS (SELECT sample_id, tool, count(*) AS h, avg(mabe_bp) AS m FROM best_hits WHERE hit_level = 'any' GROUP BY ALL),
         f AS (SELECT sample_id, tool, count(*) AS n, sum("end" - start) AS bp FROM false_calls GROUP BY ALL)
    SELECT c.sample_id, c.tool, c.n_truth, c.n_calls, a.h AS any_truth_hits, round(a.h / c.n_truth, 9) AS any_recall,
           round(a.m, 4) AS any_mabe, x.bp_tp, x.bp_fp, x.bp_fn, x.bp_tn, coalesce(f.n, 0) AS n_false_regions,
           CAST(coalesce(f.bp, 0) AS BIGINT) AS false_region_bp, round(m.b, 9) AS avg_false_pmd_beta
    FROM caller_counts c JOIN any_hits a ON a.sample_id = c.sample_id AND a.tool = c.tool
    JOIN confusion x ON x.sample_id = c.sample_id AND x.tool = c.tool
    LEFT JOIN f ON f.sample_id = c.sample_id AND f.tool = c.tool
    LEFT JOIN (SELECT sample_id, tool, avg(mean_beta) AS b FROM false_betas GROUP BY ALL) m ON m.sample_id = c.sample_id AND m.tool = c.tool""")
def _(t):
    out = B.recovery_metrics(t.truth, t.calls, t.points, TOL, t.sizes)
    return rounded(rounded(out, 9, "any_recall", "avg_false_pmd_beta"), 4, "any_mabe").select(
        *ST, "n_truth", "n_calls", "any_truth_hits", "any_recall", "any_mabe", "bp_tp", "bp_fp", "bp_fn", "bp_tn",
        "n_false_regions", "false_region_bp", "avg_false_pmd_beta")


@query("bp_precision_recall", "B8", f"""
    WITH tb AS (SELECT sample_id, sum("end" - start) AS bp FROM truth GROUP BY sample_id),
         cb AS (SELECT sample_id, sum("end" - start) AS bp FROM all_calls GROUP BY sample_id),
         o AS (SELECT a.sample_id, sum(least(a."end", b."end") - greatest(a.start, b.start)) AS bp
               FROM truth a JOIN all_calls b ON {SAME_SAMPLE} GROUP BY a.sample_id)
    SELECT tb.sample_id, CAST(tb.bp AS BIGINT) AS truth_bp, CAST(cb.bp AS BIGINT) AS called_bp, CAST(o.bp AS BIGINT) AS overlap_bp,
           round(o.bp / cb.bp, 9) AS precision, round(o.bp / tb.bp, 9) AS recall, round(2 * o.bp / (cb.bp + tb.bp), 9) AS f1
    FROM tb JOIN cb ON tb.sample_id = cb.sample_id JOIN o ON tb.sample_id = o.sample_id""")
def _(t):
    return rounded(B.bp_precision_recall(t.truth, t.calls), 9, "precision", "recall", "f1")


# -------------------------------------------------------------- association

CTE["region_edges"] = """SELECT sample_id, tool, chrom, start AS pos FROM merged
    UNION SELECT sample_id, tool, chrom, "end" FROM merged"""
CTE["feature_edges"] = """SELECT chrom, start AS pos FROM merged_features UNION SELECT chrom, "end" FROM merged_features"""
CTE["forward_near"] = """
    SELECT r.sample_id, r.tool, r.chrom, r.pos, least(r.pos - p.pos, n.pos - r.pos) AS d FROM region_edges r
    ASOF LEFT JOIN feature_edges p ON r.chrom = p.chrom AND r.pos >= p.pos
    ASOF LEFT JOIN feature_edges n ON r.chrom = n.chrom AND r.pos <= n.pos"""
CTE["asked_edges"] = """SELECT DISTINCT r.sample_id, r.tool, f.chrom, f.pos
    FROM (SELECT DISTINCT sample_id, tool, chrom FROM region_edges) r JOIN feature_edges f ON r.chrom = f.chrom"""
CTE["backward_near"] = """
    SELECT r.sample_id, r.tool, r.chrom, r.pos, least(r.pos - p.pos, n.pos - r.pos) AS d FROM asked_edges r
    ASOF LEFT JOIN region_edges p ON r.sample_id = p.sample_id AND r.tool = p.tool AND r.chrom = p.chrom AND r.pos >= p.pos
    ASOF LEFT JOIN region_edges n ON r.sample_id = n.sample_id AND r.tool = n.tool AND r.chrom = n.chrom AND r.pos <= n.pos"""


@query("nearest_distance", "J5", """
    SELECT sample_id, tool, chrom, pos, coalesce(CAST(d AS DOUBLE), CAST('Infinity' AS DOUBLE)) AS distance FROM backward_near""")
def _(t):
    mine = R.boundaries(t.regions, ST)
    asked = mine.select(*ST, "chrom").distinct().join(R.boundaries(t.features), "chrom")
    return L.nearest_distance(asked, mine, ST)


@query("boundary_metrics", "B9", """
    WITH f AS (SELECT sample_id, tool, count(*) AS n, median(d) AS m, count(*) FILTER (d <= 500) AS a, count(*) FILTER (d <= 5000) AS b
               FROM forward_near GROUP BY ALL),
         g AS (SELECT sample_id, tool, median(d) AS m, count(*) FILTER (d <= 500) AS a, count(*) FILTER (d <= 5000) AS b
               FROM backward_near GROUP BY ALL), k AS (SELECT count(*) AS n FROM feature_edges)
    SELECT f.sample_id, f.tool, f.n AS n_region_boundaries, k.n AS n_feature_boundaries, f.m AS median_region_to_feature_bp,
           g.m AS median_feature_to_region_bp, round(f.a / f.n, 9) AS boundary_precision_500, round(g.a / k.n, 9) AS boundary_recall_500,
           round(2 * (f.a / f.n) * (g.a / k.n) / nullif(f.a / f.n + g.a / k.n, 0), 9) AS boundary_f1_500,
           round(f.b / f.n, 9) AS boundary_precision_5000, round(g.b / k.n, 9) AS boundary_recall_5000,
           round(2 * (f.b / f.n) * (g.b / k.n) / nullif(f.b / f.n + g.b / k.n, 0), 9) AS boundary_f1_5000
    FROM f JOIN g ON f.sample_id = g.sample_id AND f.tool = g.tool CROSS JOIN k""")
def _(t):
    out = L.boundary_metrics(t.regions, t.features, [500, 5000])
    return rounded(out, 9, *[c for c in out.columns if c.startswith("boundary_")])


CTE["lads"] = "SELECT *, row_number() OVER (ORDER BY chrom, start) AS feature_id FROM merged_features"
CTE["lad_pairs"] = f"""
    SELECT a.sample_id, a.tool, a.chrom, a.start, a."end", b.feature_id, b.start AS f_start,
           least(a."end", b."end") - greatest(a.start, b.start) AS bp FROM merged a JOIN lads b ON {HITS}"""
CTE["lad_dist"] = """
    SELECT a.sample_id, a.tool, a.chrom, a.start, a."end",
           min(least(abs(a.start - b.start), abs(a.start - b."end"), abs(a."end" - b.start), abs(a."end" - b."end"))) AS db
    FROM merged a LEFT JOIN lads b ON a.chrom = b.chrom GROUP BY ALL"""
CTE["shared_lads"] = "SELECT sample_id, tool, feature_id FROM lad_pairs GROUP BY ALL HAVING count(*) > 1"
CTE["lad_detail"] = """
    WITH o AS (SELECT sample_id, tool, chrom, start, "end", sum(p.bp) AS bp, count(*) AS n FROM lad_pairs p GROUP BY ALL),
         s AS (SELECT DISTINCT p.sample_id, p.tool, p.chrom, p.start FROM lad_pairs p JOIN shared_lads x
               ON x.sample_id = p.sample_id AND x.tool = p.tool AND x.feature_id = p.feature_id)
    SELECT d.sample_id, d.tool, d.chrom, d.start, d."end", coalesce(o.bp, 0) AS bp, coalesce(o.n, 0) AS n, d.db,
           CASE WHEN o.n > 0 THEN 0 ELSE d.db END AS dl, s.start IS NOT NULL AS shares
    FROM lad_dist d LEFT JOIN o ON o.sample_id = d.sample_id AND o.tool = d.tool AND o.chrom = d.chrom AND o.start = d.start
    LEFT JOIN s ON s.sample_id = d.sample_id AND s.tool = d.tool AND s.chrom = d.chrom AND s.start = d.start"""


def lads(t):
    return materialize(C.tag_intervals(t.merged_features, prefix="").select(
        "chrom", "start", "end", F.col("id").cast("bigint").alias("feature_id")), "lads")


@query("nearest_feature", "J6", """
    WITH c AS (SELECT a.sample_id, a.tool, a.chrom, a.start, a."end", b.feature_id,
                      least(abs(a.start - b.start), abs(a.start - b."end"), abs(a."end" - b.start), abs(a."end" - b."end")) AS d,
                      least(a."end", b."end") - greatest(a.start, b.start) AS bp
               FROM merged a JOIN lads b ON a.chrom = b.chrom),
         k AS (SELECT *, row_number() OVER (PARTITION BY sample_id, tool, chrom, start
                      ORDER BY greatest(bp, 0) DESC, CASE WHEN bp > 0 THEN 0 ELSE d END, feature_id) AS i FROM c)
    SELECT d.sample_id, d.tool, d.chrom, d.start, d."end", CAST(d.dl AS BIGINT) AS dist_to_feature, d.db AS dist_to_boundary,
           k.feature_id AS nearest_feature_id
    FROM lad_detail d LEFT JOIN k ON k.i = 1 AND k.sample_id = d.sample_id AND k.tool = d.tool AND k.chrom = d.chrom AND k.start = d.start""")
def _(t):
    return L.nearest_feature(t.merged, lads(t))


@query("region_detail", "B12", """
    SELECT sample_id, tool, chrom, start, "end", "end" - start AS region_length, CAST(bp AS BIGINT) AS total_overlap_bp,
           n AS n_features, round(bp / ("end" - start), 9) AS overlap_fraction, n > 0 AS overlaps_feature, shares AS shares_feature
    FROM lad_detail""")
def _(t):
    out = L.region_detail(t.merged, lads(t))
    return rounded(out, 9, "overlap_fraction").drop("dist_to_feature", "dist_to_boundary", "nearest_feature_id")


CTE["lad_agg"] = """
    SELECT d.sample_id, d.tool, count(*) AS n, count(*) FILTER (d.n > 0) AS hit, count(*) FILTER (bp >= 150000) AS hit_long,
           avg(dl) AS d, avg(db) AS db, avg(db) FILTER (dl > 0) AS dbf, avg(d.n) FILTER (d.n > 0) AS ph, avg(d.n) AS p,
           count(db) AS has, count(*) FILTER (db <= 150000) AS near, count(*) FILTER (dl > 0) AS fhas,
           count(*) FILTER (dl > 0 AND db <= 150000) AS fnear, count(*) FILTER (shares) AS sh, sum("end" - start) AS rbp, sum(bp) AS obp,
           (SELECT count(DISTINCT feature_id) FROM lad_pairs x WHERE x.sample_id = d.sample_id AND x.tool = d.tool) AS fh,
           (SELECT count(*) FROM lads) AS nf, (SELECT sum("end" - start) FROM lads) AS fbp
    FROM lad_detail d GROUP BY d.sample_id, d.tool"""
_ROWS = [
    ("pct_regions_overlapping_lads", "overlap", 0, "hit / n", "hit"),
    ("pct_regions_overlapping_lads_gte_150kb", "overlap", 150000, "hit_long / n", "hit_long"),
    ("avg_distance_to_nearest_lad", "distance", 0, "d", "NULL"),
    ("avg_distance_to_nearest_lad_boundary", "distance", 0, "db", "NULL"),
    ("avg_distance_to_nearest_lad_boundary_non_overlapping", "distance", 0, "dbf", "NULL"),
    ("avg_lads_per_overlapping_pmd", "overlap", 0, "coalesce(ph, 0)", "NULL"),
    ("avg_lad_per_pmd", "overlap", 0, "p", "NULL"),
    ("pct_regions_with_boundary_within_150kb_of_lad_boundary", "distance", 150000, "coalesce(near / nullif(has, 0), 0)", "near"),
    ("pct_non_overlapping_regions_within_150kb_of_lad_boundary", "distance", 150000, "coalesce(fnear / nullif(fhas, 0), 0)", "fnear"),
    ("pct_regions_sharing_lad", "overlap", 0, "coalesce(sh / nullif(hit, 0), 0)", "sh"),
    ("pmd_coverage_by_lads", "overlap", 0, "obp / rbp", "NULL"),
    ("pct_lads_overlapping", "overlap", 0, "fh / nf", "fh"),
    ("lad_coverage_by_pmds", "overlap", 0, "obp / fbp", "NULL"),
]


@query("association_scores", "B11", " UNION ALL ".join(
    f"""SELECT sample_id, tool, '{m}' AS metric, '{mode}' AS analysis_mode, CAST({th} AS INTEGER) AS threshold_bp,
        round({expr}, 4) AS score, CAST({n} AS BIGINT) AS n_regions_passing FROM lad_agg""" for m, mode, th, expr, n in _ROWS))
def _(t):
    return rounded(L.association_scores(t.merged, lads(t)), 4, "score")


@query("feature_association", "B10", f"""
    WITH m AS (SELECT DISTINCT a.sample_id, a.tool, a.chrom, w.start FROM windows w
               JOIN (SELECT sample_id, tool, chrom, win_start AS start, win_end AS "end", start AS s FROM windows) a
                    ON a.sample_id = w.sample_id AND a.tool = w.tool AND a.chrom = w.chrom AND a.s = w.start
               JOIN merged_features b ON {HITS}),
         r AS (SELECT sample_id, tool, count(*) AS n FROM merged GROUP BY ALL),
         e AS (SELECT sample_id, tool, count(*) AS n FROM m GROUP BY ALL),
         t AS (SELECT sample_id, tool, count(DISTINCT feature_id) AS n FROM lad_pairs GROUP BY ALL),
         s AS (SELECT sample_id, tool, count(*) FILTER (shares) AS n FROM lad_detail GROUP BY ALL),
         k AS (SELECT count(*) AS n FROM merged_features)
    SELECT r.sample_id, r.tool, r.n AS n_regions, k.n AS n_features, coalesce(e.n, 0) AS regions_with_feature_at_either_end,
           coalesce(t.n, 0) AS features_touched, coalesce(s.n, 0) AS regions_sharing_feature,
           round(100.0 * coalesce(e.n, 0) / r.n, 9) AS pct_regions_with_feature_at_either_end,
           round(100.0 * coalesce(t.n, 0) / k.n, 9) AS pct_features_touched,
           round(100.0 * coalesce(s.n, 0) / r.n, 9) AS pct_regions_sharing_feature,
           r.n - coalesce(e.n, 0) AS not_regions_with_feature_at_either_end, k.n - coalesce(t.n, 0) AS not_features_touched,
           r.n - coalesce(s.n, 0) AS not_regions_sharing_feature
    FROM r CROSS JOIN k LEFT JOIN e ON e.sample_id = r.sample_id AND e.tool = r.tool
    LEFT JOIN t ON t.sample_id = r.sample_id AND t.tool = r.tool LEFT JOIN s ON s.sample_id = r.sample_id AND s.tool = r.tool""")
def _(t):
    out = L.feature_association(t.regions, t.features, 5000)
    return rounded(out, 9, *[c for c in out.columns if c.startswith("pct_")])


@query("overlap_by_sample", "B13", f"""
    WITH o AS (SELECT a.region_id, a.sample_id, a.tool, a."end" - a.start AS len,
                      sum(CASE WHEN b.start IS NULL THEN 0 ELSE least(a."end", b."end") - greatest(a.start, b.start) END) AS bp
               FROM regions a LEFT JOIN features b ON {HITS} GROUP BY ALL)
    SELECT sample_id, tool, count(*) AS n_segments, count(*) FILTER (bp > 0) AS segments_with_overlap,
           CAST(sum(len) AS BIGINT) AS total_bp, CAST(sum(bp) AS BIGINT) AS feature_overlap_bp,
           round(count(*) FILTER (bp > 0) / count(*), 9) AS fraction_segments_with_overlap,
           round(sum(bp) / sum(len), 9) AS fraction_bp_in_features FROM o GROUP BY ALL""")
def _(t):
    return rounded(L.overlap_by_sample(t.regions, t.features), 9, "fraction_segments_with_overlap", "fraction_bp_in_features")


@query("filter_features_by_mean", "B14", f"""
    WITH s AS (SELECT b.feature_id, a.sample_id, avg(a.beta) AS m FROM beta_points a JOIN features b ON {HITS} GROUP BY ALL),
         f AS (SELECT feature_id, avg(m) AS mean_beta FROM s GROUP BY ALL)
    SELECT x.chrom, x.start, x."end", x.feature_id, round(f.mean_beta, 9) AS mean_beta
    FROM features x JOIN f ON f.feature_id = x.feature_id WHERE f.mean_beta >= 0.5""")
def _(t):
    return rounded(L.filter_features_by_mean(t.features, t.beta_points, 0.5), 9, "mean_beta")


@query("feature_set_difference", "J4", f"""
    WITH a AS (SELECT a.sample_id, b.feature_id, count(*) AS n FROM merged a JOIN features b ON {HITS} WHERE a.tool = '1' GROUP BY ALL),
         c AS (SELECT DISTINCT a.sample_id, b.feature_id FROM merged a JOIN features b ON {HITS} WHERE a.tool = '2')
    SELECT a.sample_id, a.feature_id, a.n AS n_regions, f.chrom, f.start, f."end",
           concat(a.sample_id, '_feature_', CAST(a.feature_id AS VARCHAR)) AS name
    FROM a JOIN features f ON f.feature_id = a.feature_id
    WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.sample_id = a.sample_id AND c.feature_id = a.feature_id)""")
def _(t):
    m = t.merged
    return L.feature_set_difference(t.features, m.where("tool = '1'"), m.where("tool = '2'"))


# ----------------------------------------------------- classification scores

CTE["preds"] = """
    SELECT o_custkey % 5 AS fold, CASE WHEN o_orderkey * 31 % 10 < 4 THEN 'Normal' ELSE 'Tumor' END AS y_true,
           CASE WHEN (o_orderkey * 31 % 10 + o_custkey % 7) / 16.0 >= 0.5 THEN 'Tumor' ELSE 'Normal' END AS y_pred,
           (o_orderkey * 31 % 10 + o_custkey % 7) / 16.0 AS y_score FROM orders"""


def preds(t):
    o = table(t.spark, t.sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    score = ((k * 31) % 10 + c % 7) / 16.0
    return o.select((c % 5).alias("fold"), F.when((k * 31) % 10 < 4, "Normal").otherwise("Tumor").alias("y_true"),
                    F.when(score >= 0.5, "Tumor").otherwise("Normal").alias("y_pred"), score.alias("y_score"))


@query("classification_metrics", "B16", """
    WITH c AS (SELECT fold, count(*) FILTER (y_true = 'Tumor' AND y_pred = 'Tumor') AS tp,
                      count(*) FILTER (y_true = 'Normal' AND y_pred = 'Tumor') AS fp,
                      count(*) FILTER (y_true = 'Tumor' AND y_pred = 'Normal') AS fn,
                      count(*) FILTER (y_true = 'Normal' AND y_pred = 'Normal') AS tn FROM preds GROUP BY fold),
         s AS (SELECT fold, y_score, count(*) FILTER (y_true = 'Tumor') AS p, count(*) FILTER (y_true = 'Normal') AS n
               FROM preds GROUP BY ALL),
         k AS (SELECT *, sum(p) OVER w AS cp, sum(n) OVER w AS cn FROM s WINDOW w AS (PARTITION BY fold ORDER BY y_score DESC)),
         a AS (SELECT fold, sum(p * cp / (cp + cn)) / sum(p) AS ap, sum(n * (cp - p / 2)) / (sum(p) * sum(n)) AS auc FROM k GROUP BY fold)
    SELECT c.*, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 9) AS balanced_accuracy,
           round((2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fn + fp)) / 2, 9) AS macro_f1,
           round((CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn)
                 / sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)), 9) AS mcc,
           round((tp + fn) / (tp + fp + fn + tn), 9) AS always_positive_average_precision,
           CASE WHEN tp + fn = 0 THEN CAST(0 AS DOUBLE) WHEN fp + tn = 0 THEN 1 ELSE 0.5 END AS always_positive_balanced_accuracy,
           CASE WHEN fp + tn = 0 THEN 1.0 ELSE round((tp + fn) / (2 * (tp + fn) + fp + tn), 9) END AS always_positive_macro_f1,
           CAST(0 AS DOUBLE) AS always_positive_mcc,
           CASE WHEN tp + fn > 0 AND fp + tn > 0 THEN CAST(0.5 AS DOUBLE) END AS always_positive_roc_auc,
           round(ap, 9) AS average_precision, round(auc, 9) AS roc_auc
    FROM c JOIN a ON a.fold = c.fold""")
def _(t):
    out = B.classification_metrics(preds(t), ["fold"])
    return rounded(out, 9, "balanced_accuracy", "macro_f1", "mcc", "always_positive_average_precision", "always_positive_macro_f1",
                   "average_precision", "roc_auc")


CTE["multi"] = """
    SELECT o_orderstatus AS y_true, substr('FOPFOO', CAST(o_orderkey % 6 AS INTEGER) + 1, 1) AS y_pred,
           o_custkey % 11 / 11.0 AS s1, o_custkey % 13 / 13.0 AS s2, o_orderkey % 17 / 17.0 AS s3 FROM orders"""
CLASSES = ["F", "O", "P"]


def multi(t):
    o = table(t.spark, t.sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(F.col("o_orderstatus").alias("y_true"),
                    F.substring(F.lit("FOPFOO"), (k % 6).cast("int") + 1, F.lit(1)).alias("y_pred"),
                    F.array(c % 11 / 11.0, c % 13 / 13.0, k % 17 / 17.0).alias("scores"))


@query("confusion_matrix", "B17", """
    SELECT y_true, count(*) FILTER (y_pred = 'F') AS "F", count(*) FILTER (y_pred = 'O') AS "O",
           count(*) FILTER (y_pred = 'P') AS "P" FROM multi GROUP BY y_true""")
def _(t):
    return B.confusion_matrix(multi(t), CLASSES)


CTE["class_counts"] = """
    SELECT c.class, count(*) FILTER (y_true = c.class AND y_pred = c.class) AS tp,
           count(*) FILTER (y_true <> c.class AND y_pred = c.class) AS fp,
           count(*) FILTER (y_true = c.class AND y_pred <> c.class) AS fn
    FROM multi CROSS JOIN (SELECT unnest(['F', 'O', 'P']) AS class) c GROUP BY c.class"""
CTE["class_scores"] = """
    SELECT class, tp / (tp + fp) AS p, tp / (tp + fn) AS r, 2 * tp / (2 * tp + fp + fn) AS f, tp + fn AS support, tp, fp, fn
    FROM class_counts"""


@query("multiclass_report", "B17", """
    SELECT class, round(p, 9) AS precision, round(r, 9) AS recall, round(f, 9) AS f1, support FROM class_scores
    UNION ALL SELECT 'macro', round(avg(p), 9), round(avg(r), 9), round(avg(f), 9), CAST(sum(support) AS BIGINT) FROM class_scores
    UNION ALL SELECT 'micro', round(sum(tp) / sum(tp + fp), 9), round(sum(tp) / sum(tp + fn), 9),
                     round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 9), CAST(sum(support) AS BIGINT) FROM class_scores""")
def _(t):
    return rounded(B.multiclass_report(multi(t), CLASSES), 9, "precision", "recall", "f1")


@query("one_vs_rest", "B17", """
    WITH l AS (SELECT 'F' AS class, y_true = 'F' AS t, s1 AS s FROM multi UNION ALL SELECT 'O', y_true = 'O', s2 FROM multi
               UNION ALL SELECT 'P', y_true = 'P', s3 FROM multi),
         g AS (SELECT class, s, count(*) FILTER (t) AS p, count(*) FILTER (NOT t) AS n FROM l GROUP BY ALL),
         k AS (SELECT *, sum(p) OVER w AS cp, sum(n) OVER w AS cn FROM g WINDOW w AS (PARTITION BY class ORDER BY s DESC))
    SELECT class, round(sum(n * (cp - p / 2)) / (sum(p) * sum(n)), 9) AS roc_auc,
           round(sum(p * cp / (cp + cn)) / sum(p), 9) AS average_precision FROM k GROUP BY class""")
def _(t):
    return rounded(B.one_vs_rest(multi(t), CLASSES), 9, "roc_auc", "average_precision")


CTE["class_ranks"] = """
    WITH l AS (SELECT 'F' AS class, y_true = 'F' AS t, s1 AS s FROM multi UNION ALL SELECT 'O', y_true = 'O', s2 FROM multi
               UNION ALL SELECT 'P', y_true = 'P', s3 FROM multi),
         g AS (SELECT class, s, count(*) FILTER (t) AS p, count(*) FILTER (NOT t) AS n FROM l GROUP BY ALL),
         k AS (SELECT *, sum(p) OVER w AS cp, sum(n) OVER w AS cn FROM g WINDOW w AS (PARTITION BY class ORDER BY s DESC))
    SELECT class, sum(n * (cp - p / 2)) / (sum(p) * sum(n)) AS roc_auc, sum(p * cp / (cp + cn)) / sum(p) AS average_precision FROM k GROUP BY class"""


@query("classification_overview", "B17, M8", """
    WITH t AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) AS a FROM multi),
         m AS (SELECT avg(p) AS p, avg(f) AS f, sum(tp) / sum(tp + fp) AS mp, 2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) AS mf FROM class_scores),
         r AS (SELECT avg(roc_auc) AS u, avg(average_precision) AS v FROM class_ranks)
    SELECT unnest(['n_test_samples', 'n_classes', 'accuracy', 'macro_f1', 'macro_precision', 'micro_f1', 'micro_precision', 'roc_auc_ovr_macro', 'average_precision_macro']) AS metric,
           round(unnest([n, 3.0, a, f, p, mf, mp, u, v]), 9) AS value FROM t, m, r""")
def _(t):
    return rounded(B.classification_overview(multi(t), CLASSES), 9, "value")


@query("class_counts", "B17", """
    SELECT CASE WHEN s1 < 0.5 THEN 'train' ELSE 'test' END AS split, y_true AS label, count(*) AS count FROM multi GROUP BY ALL""")
def _(t):
    rows = multi(t).withColumn("label", F.col("y_true"))
    low = F.col("scores")[0] < 0.5
    return B.class_counts(rows.where(low), rows.where(~low))


# --------------------------------------------------- ranking and comparisons

CTE["configs"] = """
    SELECT concat('cfg', CAST(o_custkey % 25 AS VARCHAR)) AS config_name, o_orderstatus AS platform, o_custkey AS sample,
           (o_orderkey * 7919 % 1000) / 1000.0 AS bp_precision, (o_orderkey * 104729 % 1000) / 1000.0 AS bp_recall FROM orders"""


def configs(t):
    o = table(t.spark, t.sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(F.concat(F.lit("cfg"), (c % 25).cast("string")).alias("config_name"), F.col("o_orderstatus").alias("platform"),
                    c.alias("sample"), ((k * 7919) % 1000 / 1000.0).alias("bp_precision"),
                    ((k * 104729) % 1000 / 1000.0).alias("bp_recall"))


@query("rank_configs_by_f1", "W1", """
    WITH c AS (SELECT platform, config_name, count(DISTINCT sample) AS n_samples,
                      avg(2 * bp_precision * bp_recall / nullif(bp_precision + bp_recall, 0)) AS f, avg(bp_recall) AS r,
                      avg(bp_precision) AS p FROM configs GROUP BY ALL)
    SELECT platform, config_name, n_samples, round(f, 9) AS mean_f1_like, round(r, 9) AS mean_bp_recall,
           round(p, 9) AS mean_bp_precision,
           row_number() OVER (PARTITION BY platform ORDER BY f DESC, r DESC, p DESC, config_name) AS rank FROM c""")
def _(t):
    scored = W.f1_like(configs(t), "platform", "config_name", "sample")
    columns = ["mean_f1_like", "mean_bp_recall", "mean_bp_precision"]
    return rounded(W.rank_configs(scored, "platform", "config_name", columns), 9, *columns)


@query("rank_configs_by_composite", "W1", """
    WITH c AS (SELECT platform, config_name, avg(bp_precision) AS p, avg(bp_recall) AS r FROM configs GROUP BY ALL)
    SELECT platform, config_name, round((p + r) / 2, 9) AS composite_score, round(p, 9) AS mean_bp_precision,
           round(r, 9) AS mean_bp_recall,
           row_number() OVER (PARTITION BY platform ORDER BY (p + r) / 2 DESC, p DESC, config_name) AS rank FROM c""")
def _(t):
    scored = W.composite_mean(configs(t), "platform", "config_name", ["bp_precision", "bp_recall"])
    out = W.rank_configs(scored, "platform", "config_name", ["composite_score", "mean_bp_precision"])
    return rounded(out, 9, "composite_score", "mean_bp_precision", "mean_bp_recall")


CTE["sweep"] = """
    SELECT config_name, platform, sample, bp_precision AS signal_ratio, bp_recall AS peak_ratio, bp_precision * bp_recall AS peak_overlap_fraction,
           100 * bp_recall AS pct_regions_with_lad_at_either_end, CAST(1000 * bp_precision AS BIGINT) AS n_regions FROM configs"""


def sweep(t):
    p, r = F.col("bp_precision"), F.col("bp_recall")
    return configs(t).select("config_name", "platform", "sample", p.alias("signal_ratio"), r.alias("peak_ratio"), (p * r).alias("peak_overlap_fraction"),
                             (100 * r).alias("pct_regions_with_lad_at_either_end"), F.round(1000 * p).cast("bigint").alias("n_regions"))


@query("rank_configs_by_three_ratios", "W1", """
    WITH c AS (SELECT platform, config_name, round(avg(signal_ratio), 9) AS s, round(avg(peak_ratio), 9) AS p, round(avg(peak_overlap_fraction), 9) AS o FROM sweep GROUP BY ALL)
    SELECT platform, config_name, round((s + p + o) / 3, 8) AS composite_score, s AS mean_signal_ratio, p AS mean_peak_ratio, o AS mean_peak_overlap_fraction,
           row_number() OVER (PARTITION BY platform ORDER BY round((s + p + o) / 3, 8) DESC, s DESC, p DESC, config_name) AS rank FROM c""")
def _(t):
    parts = ["signal_ratio", "peak_ratio", "peak_overlap_fraction"]
    scored = rounded(W.composite_mean(sweep(t), "platform", "config_name", parts), 9, *[f"mean_{c}" for c in parts])
    total = sum((F.col(f"mean_{c}") for c in parts[1:]), F.col(f"mean_{parts[0]}"))
    scored = scored.withColumn("composite_score", F.round(total / 3, 8))
    return W.rank_configs(scored, "platform", "config_name", ["composite_score", "mean_signal_ratio", "mean_peak_ratio"])


@query("rank_configs_by_end_overlap", "W1", """
    WITH c AS (SELECT platform, config_name, count(DISTINCT sample) AS n_samples, round(avg(pct_regions_with_lad_at_either_end), 9) AS p, round(avg(n_regions), 9) AS n FROM sweep GROUP BY ALL)
    SELECT platform, config_name, n_samples, p AS mean_pct_lad_end_overlap, n AS mean_n_regions,
           row_number() OVER (PARTITION BY platform ORDER BY p DESC, n DESC, config_name) AS rank FROM c""")
def _(t):
    columns = ["mean_pct_lad_end_overlap", "mean_n_regions"]
    scored = rounded(W.end_overlap_mean(sweep(t), "platform", "config_name", "sample"), 9, *columns)
    return W.rank_configs(scored, "platform", "config_name", columns)


@query("best_per_key", "W2", """
    SELECT sample_id, tool, chrom, start, "end", region_id FROM (
        SELECT *, row_number() OVER (PARTITION BY sample_id, tool, chrom ORDER BY "end" - start DESC, start, region_id) AS k FROM regions)
    WHERE k = 1""")
def _(t):
    rows = t.regions.withColumn("len", F.col("end") - F.col("start"))
    return W.best_per_key(rows, ["sample_id", "tool", "chrom"], [("len", True), ("start", False), ("region_id", False)]).drop("len")


CTE["fuzzy_all"] = merge_sql("regions", "", 1000)


@query("recurrent_top", "W3", """
    SELECT f.chrom, f.start, f."end", f."end" - f.start AS length, count(DISTINCT r.sample_id) AS sample_count
    FROM fuzzy_all f JOIN regions r ON r.chrom = f.chrom AND r.start >= f.start AND r.start < f."end" GROUP BY ALL
    ORDER BY sample_count DESC, length DESC, f.chrom, f.start LIMIT 100""")
def _(t):
    return W.recurrent_top(R.merge_with_provenance(t.regions), 100, exactly=False).drop("samples")


@query("top_variance", "W4", f"""
    WITH m AS (SELECT a.sample_id, b.region_index, avg(a.beta) AS v FROM matrix a JOIN shared_regions b ON {HITS}
               WHERE a.beta IS NOT NULL GROUP BY ALL),
         s AS (SELECT region_index, var_samp(v) AS variance, avg(v) AS mu, stddev_pop(v) AS sd FROM m GROUP BY region_index),
         k AS (SELECT * FROM s WHERE variance IS NOT NULL ORDER BY variance DESC, region_index LIMIT 50)
    SELECT m.sample_id, m.region_index, round(k.variance, 9) AS variance,
           round(CASE WHEN sd = 0 THEN 0 ELSE (v - mu) / sd END, 6) AS z FROM m JOIN k ON m.region_index = k.region_index""")
def _(t):
    from spanframe.operators.points import region_features
    found = region_features(matrix(t), shared_regions(t)).where("value IS NOT NULL")
    return rounded(rounded(W.top_variance(found, 50), 9, "variance"), 6, "z")


CTE["cohort_means"] = """SELECT cohort_id, feature_set, n_features, round(avg(mcc), 9) AS mean FROM scores GROUP BY ALL"""


def cohort_means(t):
    return rounded(scores(t).groupBy("cohort_id", "feature_set", "n_features").agg(F.avg("mcc").alias("mean")), 9, "mean")


@query("largest_gap", "W5", """
    WITH b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cohort_id, n_features ORDER BY mean DESC, feature_set) AS k
               FROM cohort_means WHERE feature_set IN ('set1', 'set2')) WHERE k = 1),
         g AS (SELECT m.cohort_id, m.n_features, m.mean AS subject_mean, b.feature_set AS best_other_feature_set,
                      b.mean AS best_other_mean, b.mean - m.mean AS difference
               FROM cohort_means m JOIN b ON b.cohort_id = m.cohort_id AND b.n_features = m.n_features WHERE m.feature_set = 'set3'
               AND b.mean < m.mean)
    SELECT * EXCLUDE (k) REPLACE (round(difference, 6) AS difference), round(abs(difference), 6) AS absolute_difference FROM (
        SELECT *, row_number() OVER (PARTITION BY cohort_id ORDER BY difference, n_features) AS k FROM g) WHERE k = 1""")
def _(t):
    return rounded(W.largest_gap(cohort_means(t), "set3", ["set1", "set2"]), 6, "difference", "absolute_difference")


@query("order_tools", "W6", """
    WITH s AS (SELECT tool, avg("end" - start) / 20000 AS m FROM regions GROUP BY tool)
    SELECT tool, round(m, 9) AS fragmentation_mean, round(abs(m - 1), 9) AS fragmentation_distance_from_1_mean,
           row_number() OVER (ORDER BY abs(m - 1), CASE WHEN tool = '3' THEN 1 ELSE 2 END, tool) AS position FROM s""")
def _(t):
    s = t.regions.groupBy("tool").agg((F.avg(F.col("end") - F.col("start")) / 20000).alias("fragmentation_mean")) \
        .withColumn("fragmentation_distance_from_1_mean", F.abs(F.col("fragmentation_mean") - 1))
    return rounded(W.order_tools(s, "fragmentation_mean", ["3"]), 9, "fragmentation_mean", "fragmentation_distance_from_1_mean")


@query("order_cohorts", "W7", """
    SELECT c.cohort_id, c.original_rank, round(avg(s.mcc), 9) AS mean_score
    FROM (SELECT cohort_id, row_number() OVER (ORDER BY cohort_id) AS original_rank FROM (SELECT DISTINCT cohort_id FROM scores)) c
    LEFT JOIN scores s ON s.cohort_id = c.cohort_id AND s.feature_set = 'set1' GROUP BY ALL""")
def _(t):
    s = scores(t)
    cohorts = s.select("cohort_id").distinct().withColumn("original_rank", F.substring("cohort_id", 2, 9).cast("bigint") + 1)
    return rounded(W.order_cohorts(s, cohorts, "set1"), 9, "mean_score")


CTE["runs"] = """
    SELECT concat('C', CAST(o_custkey % 7 AS VARCHAR)) AS cohort_id, concat('set', substr(o_orderpriority, 1, 1)) AS feature_set,
           CASE WHEN substr(o_orderpriority, 1, 1) = '1' THEN 0 ELSE o_orderkey % 10 END AS feature_draw,
           o_custkey % 10 AS repeat, o_orderkey % 5 AS fold, (o_custkey % 10) * 5 + o_orderkey % 5 AS split,
           CAST(10 AS INTEGER) AS n_features, max((o_orderkey * 7919 % 1000) / 1000.0) AS score FROM orders GROUP BY ALL"""


def runs(t):
    o = table(t.spark, t.sf_dir, "orders")
    k, c, p = F.col("o_orderkey"), F.col("o_custkey"), F.substring("o_orderpriority", 1, 1)
    return (o.select(F.concat(F.lit("C"), (c % 7).cast("string")).alias("cohort_id"), F.concat(F.lit("set"), p).alias("feature_set"),
                     F.when(p == "1", F.lit(0).cast("bigint")).otherwise(k % 10).alias("feature_draw"), (c % 10).alias("repeat"),
                     (k % 5).alias("fold"), ((c % 10) * 5 + k % 5).alias("split"), F.lit(10).alias("n_features"),
                     ((k * 7919) % 1000 / 1000.0).alias("score"))
            .groupBy("cohort_id", "feature_set", "feature_draw", "repeat", "fold", "split", "n_features")
            .agg(F.max("score").alias("score")))


@query("run_table", "W8", """
    SELECT feature_draw, repeat, fold, split,
           format('draw{:02d}|repeat{:02d}|fold{:02d}|split{:04d}', feature_draw, repeat, fold, split) AS run_key,
           row_number() OVER (ORDER BY feature_draw, repeat, fold, split) - 1 AS column_index
    FROM (SELECT DISTINCT feature_draw, repeat, fold, split FROM runs)""")
def _(t):
    return W.run_table(runs(t))


@query("fold_choices", "W8", """
    WITH c AS (SELECT split, repeat, fold, list_sort(list(DISTINCT feature_set)) AS f FROM runs
               WHERE n_features = 10 AND feature_draw = 3 GROUP BY ALL)
    SELECT split, repeat, fold, array_to_string(f, ',') AS feature_sets, CAST(len(f) AS BIGINT) AS n_available,
           array_to_string(list_filter(['set2', 'set3', 'set9'], lambda x: NOT list_contains(f, x)), ',') AS missing,
           list_has_all(f, ['set2', 'set3', 'set9']) AS is_complete FROM c""")
def _(t):
    out = W.fold_choices(runs(t), ["set2", "set3", "set9"], 10, 3)
    return out.withColumn("feature_sets", F.concat_ws(",", "feature_sets")).withColumn("missing", F.concat_ws(",", "missing"))


@query("lookup_summary", "W9", """
    SELECT feature_set, n_features, metric, round(avg(value), 9) AS mean, count(value) AS n FROM score_rows
    WHERE metric = 'roc_auc' AND n_features = 15 GROUP BY feature_set, n_features, metric""")
def _(t):
    from spanframe.operators.summaries import classification_summary
    s = classification_summary(scores(t), ["mcc", "roc_auc"]).drop("std", "sem")
    return rounded(W.lookup_summary(s, "auc", {"auc": "roc_auc"}, n_features=15), 9, "mean")


@query("manifest_chunks", "W10", """
    SELECT sample, ((row_number() OVER (ORDER BY sample)) * 100 - 1) // (SELECT count(*) FROM samples) + 1 AS chunk FROM samples""")
def _(t):
    return W.manifest_chunks(t.samples.select("sample"), "sample", 100)


@query("stack_tools", "W11", """
    SELECT tool, count(*) AS n, CAST(sum("end" - start) AS BIGINT) AS bp FROM regions GROUP BY tool""")
def _(t):
    r = t.regions
    stacked = W.stack_tools({k: r.where(F.col("tool") == k) for k in ("1", "2", "3", "4", "5")})
    return stacked.groupBy("tool").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("bp"))


@query("distinct_across", "W12", 'SELECT DISTINCT chrom, start, "end" FROM regions')
def _(t):
    r = t.regions.select("tool", "chrom", "start", "end")
    return W.distinct_across([r.where(F.col("tool") == k).drop("tool") for k in ("1", "2", "3", "4", "5")])


@query("enrich_with_default", "J1", """
    SELECT r.region_id, coalesce(f.n_features, 0) AS n_features, coalesce(f.label, 'none') AS label FROM regions r
    LEFT JOIN (SELECT feature_id AS region_id, "end" - start AS n_features, 'feature' AS label FROM features) f ON f.region_id = r.region_id""")
def _(t):
    extra = t.features.select(F.col("feature_id").alias("region_id"), (F.col("end") - F.col("start")).alias("n_features"),
                              F.lit("feature").alias("label"))
    return W.enrich(t.regions.select("region_id"), extra, ["region_id"], {"n_features": 0, "label": "none"})


@query("compare_runs", "J2", """
    WITH a AS (SELECT cohort_id, feature_set, n_features, avg(mcc) AS m FROM scores WHERE feature_draw < 5 GROUP BY ALL),
         b AS (SELECT cohort_id, feature_set, n_features, avg(mcc) AS m FROM scores WHERE feature_draw >= 5 GROUP BY ALL)
    SELECT coalesce(a.cohort_id, b.cohort_id) AS cohort_id, coalesce(a.feature_set, b.feature_set) AS feature_set,
           coalesce(a.n_features, b.n_features) AS n_features, round(a.m, 9) AS mcc_left, round(b.m, 9) AS mcc_right,
           round(b.m - a.m, 9) AS mcc_delta
    FROM a FULL JOIN b ON a.cohort_id = b.cohort_id AND a.feature_set = b.feature_set AND a.n_features = b.n_features""")
def _(t):
    keys = ["cohort_id", "feature_set", "n_features"]
    a, b = (scores(t).where(w).groupBy(*keys).agg(F.avg("mcc").alias("mcc")) for w in ("feature_draw < 5", "feature_draw >= 5"))
    return rounded(W.compare_runs(a, b, keys, ["mcc"]), 9, "mcc_left", "mcc_right", "mcc_delta")


@query("expand_draws", "J7", """
    WITH d AS (SELECT DISTINCT cohort_id, repeat, fold, split, feature_draw AS draw FROM runs)
    SELECT cohort_id, feature_set, feature_draw, repeat, fold, split, n_features, score FROM runs
    UNION ALL SELECT r.cohort_id, r.feature_set, d.draw, r.repeat, r.fold, r.split, r.n_features, r.score
    FROM runs r JOIN d ON d.cohort_id = r.cohort_id AND d.repeat = r.repeat AND d.fold = r.fold AND d.split = r.split
    WHERE r.feature_set = 'set1' AND d.draw <> r.feature_draw""")
def _(t):
    return W.expand_draws(runs(t), ["set1"])


@query("completeness", "J8", """
    SELECT s.chrom, k.tool, CASE WHEN EXISTS (SELECT 1 FROM regions r WHERE r.chrom = s.chrom AND r.tool = k.tool
        AND r.sample_id = 'P' AND r."end" - r.start > 20300) THEN 'present' ELSE 'missing' END AS status
    FROM sizes s CROSS JOIN (SELECT DISTINCT tool FROM regions) k""")
def _(t):
    have = t.regions.where('sample_id = "P" AND end - start > 20300')
    return W.completeness(t.sizes.select("chrom"), {"tool": ["1", "2", "3", "4", "5"]}, have)


