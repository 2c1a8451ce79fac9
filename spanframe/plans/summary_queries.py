"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanframe.operators import cleaning as C
from spanframe.operators import points as P
from spanframe.operators import summaries as A
from spanframe.plans.interval_queries import HITS, SAME_SAMPLE
from spanframe.plans.registry import CTE, merge_sql, query, rounded

ST = ["sample_id", "tool"]
IN_REGION = 'p.sample_id = r.sample_id AND p.chrom = r.chrom AND p.start >= r.start AND p.start < r."end"'


@query("region_stats", "A1", """
    SELECT sample_id, tool, count(*) AS n_regions, CAST(sum("end" - start) AS BIGINT) AS total_bp,
           round(100.0 * sum("end" - start) / (SELECT sum(size) FROM sizes), 6) AS genome_coverage_pct,
           round(avg("end" - start), 4) AS mean_length, median("end" - start) AS median_length,
           round(stddev_samp("end" - start), 4) AS std_length, min("end" - start) AS min_length, max("end" - start) AS max_length
    FROM merged GROUP BY ALL""")
def _(t):
    out = A.region_stats(t.regions, t.sizes)
    return rounded(rounded(out, 6, "genome_coverage_pct"), 4, "mean_length", "std_length")


@query("segment_summary", "A2", """
    SELECT sample_id, tool, count(*) AS n_segments, CAST(sum("end" - start) AS BIGINT) AS total_bp,
           round(avg("end" - start), 4) AS mean_length_bp, median("end" - start) AS median_length_bp,
           min("end" - start) AS min_length_bp, max("end" - start) AS max_length_bp
    FROM regions GROUP BY ALL""")
def _(t):
    return rounded(A.segment_summary(t.regions), 4, "mean_length_bp")


def context_sql(source: str, keys: str) -> str:
    on = " AND ".join(f"s.{k} = r.{k}" for k in [*keys.split(", "), "chrom", "start", '"end"'])
    cols = ", ".join(f"r.{k}" for k in keys.split(", "))
    return f"""
    WITH s AS (SELECT {cols}, r.chrom, r.start, r."end", count(*) AS n, avg(beta) AS mean, median(beta) AS median,
                      stddev_samp(beta) AS std, count(*) FILTER (beta < 0.2) AS low,
                      count(*) FILTER (beta >= 0.2 AND beta <= 0.7) AS mid, count(*) FILTER (beta > 0.7) AS high
               FROM {source} r JOIN beta_points p ON {IN_REGION} GROUP BY ALL)
    SELECT {cols}, r.chrom, r.start, r."end", r."end" - r.start AS region_length_bp, coalesce(s.n, 0) AS n_points,
           round(s.mean, 9) AS mean, round(s.median, 9) AS median, round(s.std, 9) AS std, coalesce(low, 0) AS n_low,
           coalesce(mid, 0) AS n_intermediate, coalesce(high, 0) AS n_high, round(low * 100.0 / n, 9) AS pct_low,
           round(mid * 100.0 / n, 9) AS pct_intermediate, round(high * 100.0 / n, 9) AS pct_high
    FROM {source} r LEFT JOIN s ON {on}"""


def rounded_context(df):
    return rounded(df, 9, "mean", "median", "std", "pct_low", "pct_intermediate", "pct_high")


@query("region_context", "A3", context_sql("merged", "sample_id, tool"))
def _(t):
    return rounded_context(P.region_context(t.merged, t.beta_points))


CTE["sample_gaps"] = """
    SELECT sample_id, tool, chrom, coalesce(lag("end") OVER w, -1) AS start, start AS "end" FROM merged
        WINDOW w AS (PARTITION BY sample_id, tool, chrom ORDER BY start)
    UNION ALL SELECT sample_id, tool, chrom, max("end"), 1000000000000 FROM merged GROUP BY ALL
    UNION ALL SELECT k.sample_id, k.tool, c.chrom, -1, 1000000000000
        FROM (SELECT DISTINCT sample_id, tool FROM merged) AS k CROSS JOIN (SELECT DISTINCT chrom FROM merged) AS c
        WHERE NOT EXISTS (SELECT 1 FROM merged m WHERE m.sample_id = k.sample_id AND m.tool = k.tool AND m.chrom = c.chrom)"""
CTE["tool_missing"] = f"""
    SELECT a.sample_id, a.tool, b.tool AS other_tool, a.chrom, greatest(a.start, b.start) AS start,
           least(a."end", b."end") AS "end"
    FROM merged a JOIN sample_gaps b ON {SAME_SAMPLE} AND (a.tool IN ('1', '2')) <> (b.tool IN ('1', '2'))"""


@query("missing_between_tools", "A4, I4", """
    SELECT sample_id, tool, other_tool, count(*) AS n_pieces, CAST(sum("end" - start) AS BIGINT) AS bp
    FROM tool_missing GROUP BY ALL""")
def _(t):
    pieces = P.missing_between_tools(t.regions, ["1", "2"], ["3", "4", "5"])
    return pieces.groupBy(*ST, "other_tool").agg(F.count("*").alias("n_pieces"),
                                                 F.sum(F.col("end") - F.col("start")).alias("bp"))


@query("missing_context", "A4", context_sql("tool_missing", "sample_id, tool, other_tool"))
def _(t):
    return rounded_context(P.missing_context(t.regions, t.beta_points, ["1", "2"], ["3", "4", "5"]))


@query("region_mean", "A5", f"""
    SELECT a.sample_id, a.chrom, b.start, b."end", round(avg(a.beta), 9) AS mean_beta, count(*) AS n_points
    FROM beta_points a JOIN (SELECT DISTINCT sample_id, chrom, start, "end" FROM regions) b ON {SAME_SAMPLE} GROUP BY ALL""")
def _(t):
    return rounded(P.region_mean(t.regions, t.beta_points), 9, "mean_beta")


@query("region_point_summary", "A6", f"""
    WITH s AS (SELECT r.sample_id, r.tool, r.chrom, r.start, r."end", count(*) AS n,
                      avg(CASE WHEN p.coverage > 5 THEN p.beta END) AS m
               FROM merged r JOIN beta_points p ON {IN_REGION} GROUP BY ALL)
    SELECT r.sample_id, r.tool, r.chrom, r.start, r."end", coalesce(s.n, 0) AS point_count, round(s.m, 9) AS mean_beta
    FROM merged r LEFT JOIN s ON s.sample_id = r.sample_id AND s.tool = r.tool AND s.chrom = r.chrom AND s.start = r.start""")
def _(t):
    points = t.beta_points.withColumn("beta", F.when(F.col("coverage") > 5, F.col("beta")))
    return rounded(P.region_point_summary(t.merged, points), 9, "mean_beta")


CTE["matrix"] = """
    SELECT a.sample_id, p.chrom, p.start, p."end", CASE WHEN a.raw <> 255 THEN a.raw / 100.0 END AS beta
    FROM arrays a JOIN probes p ON a.probe_idx = p.probe_idx"""
CTE["shared_regions"] = """SELECT *, row_number() OVER (ORDER BY chrom, start) AS region_index
    FROM merged_features"""


def matrix(t):
    from spanframe.sources.files import load_matrix
    return load_matrix(t.arrays, t.probes)


def shared_regions(t):
    return C.tag_intervals(t.merged_features, prefix="").withColumn("region_index", F.col("id").cast("bigint"))


@query("region_features", "A7", f"""
    WITH m AS (SELECT a.sample_id, b.region_index, avg(a.beta) AS v FROM matrix a JOIN shared_regions b ON {HITS}
               WHERE a.beta IS NOT NULL GROUP BY ALL)
    SELECT s.sample_id, r.region_index, round(m.v, 9) AS value
    FROM (SELECT DISTINCT sample_id, chrom FROM matrix) AS s JOIN shared_regions r ON r.chrom = s.chrom
    LEFT JOIN m ON m.sample_id = s.sample_id AND m.region_index = r.region_index""")
def _(t):
    return rounded(P.region_features(matrix(t), shared_regions(t)), 9, "value")


@query("probe_values", "A8", f"""
    WITH o AS (SELECT b.probe, a.value, least(a."end", b."end") - greatest(a.start, b.start) AS w
               FROM signal a JOIN (SELECT probe, chrom, start, "end" + 400 AS "end" FROM probes) b ON {HITS})
    SELECT probe, round(sum(value * w) / sum(w), 6) AS value FROM o GROUP BY probe""")
def _(t):
    wide = t.probes.withColumn("end", F.col("end") + 400)
    return rounded(P.probe_values(t.signal, wide), 6, "value")


@query("binned_track", "A9", """
    SELECT sample_id, chrom, start // 50000 AS bin, round(avg(beta), 9) AS mean, count(*) AS n,
           (start // 50000) * 50000 + 25000 AS midpoint FROM beta_points GROUP BY ALL""")
def _(t):
    return rounded(P.binned_track(t.beta_points, 50_000, ["sample_id"]), 9, "mean")


CTE["profile_bins"] = """
    SELECT m.tool, m.chrom, m.start AS rs, m."end" AS re, i AS bin,
           greatest(CASE WHEN i < 5 THEN m.start + (i - 5) * 1000
                         WHEN i - 5 > 10 THEN m."end" + (i - 15) * 1000
                         ELSE m.start + ((m."end" - m.start) * (i - 5)) // 10 END, 0) AS start,
           CASE WHEN i + 1 < 5 THEN m.start + (i - 4) * 1000
                WHEN i - 4 > 10 THEN m."end" + (i - 14) * 1000
                ELSE m.start + ((m."end" - m.start) * (i - 4)) // 10 END AS "end"
    FROM profile_regions m CROSS JOIN range(0, 20) AS b(i)"""
CTE["profile_regions"] = merge_sql('(SELECT DISTINCT tool, chrom, start, "end" FROM regions)', "tool")


@query("scaled_profile", "A10", f"""
    WITH v AS (SELECT a.tool, a.chrom, a.rs, a.re, a.bin,
                      sum(b.value * (least(a."end", b."end") - greatest(a.start, b.start))) /
                      sum(least(a."end", b."end") - greatest(a.start, b.start)) AS value
               FROM (SELECT * FROM profile_bins WHERE "end" > start) a LEFT JOIN signal b ON {HITS} GROUP BY ALL)
    SELECT tool, CAST(bin AS INTEGER) AS bin, round(avg(value), 6) AS value, count(value) AS n_regions FROM v GROUP BY ALL""")
def _(t):
    from spanframe.operators.ranges import merge_intervals
    return rounded(P.scaled_profile(merge_intervals(t.regions, ["tool"]), t.signal, 5_000, 10_000, 1_000), 6, "value")


CTE["seg"] = 'SELECT *, "end" - start AS length_bp, CASE WHEN region_id % 7 = 0 THEN NULL ELSE start / 1000.0 END AS pos_kb FROM regions'


def seg(t):
    return (t.regions.withColumn("length_bp", F.col("end") - F.col("start"))
            .withColumn("pos_kb", F.when(F.col("region_id") % 7 != 0, F.col("start") / 1000.0)))


@query("group_summary", "A11", """
    SELECT 'length_bp' AS metric, tool, count(length_bp) AS n, round(avg(length_bp), 4) AS mean,
           CAST(median(length_bp) AS DOUBLE) AS median, CAST(max(length_bp) AS DOUBLE) AS max,
           count(*) - count(length_bp) AS n_excluded FROM seg GROUP BY tool
    UNION ALL SELECT 'pos_kb', tool, count(pos_kb), round(avg(pos_kb), 4), round(median(pos_kb), 6), CAST(max(pos_kb) AS DOUBLE),
           count(*) - count(pos_kb) FROM seg GROUP BY tool""")
def _(t):
    return rounded(rounded(A.group_summary(seg(t), ["tool"], ["length_bp", "pos_kb"]), 4, "mean"), 6, "median")


@query("per_tool_summary", "A12", """
    SELECT tool, round(avg(length_bp), 4) AS length_bp_mean, CAST(median(length_bp) AS DOUBLE) AS length_bp_median,
           round(stddev_samp(length_bp), 4) AS length_bp_std, CAST(min(length_bp) AS DOUBLE) AS length_bp_min,
           CAST(max(length_bp) AS DOUBLE) AS length_bp_max, round(avg(pos_kb), 4) AS pos_kb_mean,
           round(median(pos_kb), 6) AS pos_kb_median, round(stddev_samp(pos_kb), 4) AS pos_kb_std,
           CAST(min(pos_kb) AS DOUBLE) AS pos_kb_min, CAST(max(pos_kb) AS DOUBLE) AS pos_kb_max
    FROM seg GROUP BY tool""")
def _(t):
    out = A.per_tool_summary(seg(t), ["tool"], ["length_bp", "pos_kb"])
    return rounded(rounded(out, 4, "length_bp_mean", "length_bp_std", "pos_kb_mean", "pos_kb_std"), 6, "pos_kb_median")


CTE["labelled"] = """
    SELECT *, substr(sample, 1, 12) AS patient_id, project_id AS cohort_id,
           CASE WHEN sample_type = 'Solid Tissue Normal' THEN 'Normal' ELSE 'Tumor' END AS binary_label FROM samples"""


@query("cohort_manifest", "A13", """
    WITH p AS (SELECT cohort_id, patient_id, count(*) FILTER (binary_label = 'Tumor') AS t,
                      count(*) FILTER (binary_label = 'Normal') AS n FROM labelled GROUP BY ALL)
    SELECT cohort_id, CAST(sum(t + n) AS BIGINT) AS n_samples, CAST(sum(t) AS BIGINT) AS n_tumor_samples,
           CAST(sum(n) AS BIGINT) AS n_normal_samples, count(*) AS n_patients, count(*) FILTER (t > 0) AS n_tumor_patients,
           count(*) FILTER (n > 0) AS n_normal_patients, count(*) FILTER (t > 0 AND n > 0) AS n_mixed_label_patients
    FROM p GROUP BY cohort_id HAVING count(*) FILTER (t > 0) >= 5 AND count(*) FILTER (n > 0) >= 5""")
def _(t):
    return A.cohort_manifest(C.labelled_samples(t.samples), 5)


# score table: one row per order, feature set, size and cohort
CTE["scores"] = """
    SELECT concat('C', CAST(o_custkey % 7 AS VARCHAR)) AS cohort_id, concat('set', substr(o_orderpriority, 1, 1)) AS feature_set,
           CAST(o_custkey % 3 * 10 + 5 AS BIGINT) AS n_features, CAST(o_orderkey % 10 AS BIGINT) AS feature_draw,
           (o_orderkey * 7919 % 1000) / 1000.0 AS mcc,
           CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE (o_orderkey * 104729 % 1000) / 1000.0 END AS roc_auc
    FROM orders"""


def scores(t):
    from spanframe.sources.tables import table
    o = table(t.spark, t.sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(F.concat(F.lit("C"), (F.col("o_custkey") % 7).cast("string")).alias("cohort_id"),
                    F.concat(F.lit("set"), F.substring("o_orderpriority", 1, 1)).alias("feature_set"),
                    (F.col("o_custkey") % 3 * 10 + 5).alias("n_features"), (k % 10).alias("feature_draw"),
                    ((k * 7919) % 1000 / 1000.0).alias("mcc"),
                    F.when(k % 17 != 0, (k * 104729) % 1000 / 1000.0).alias("roc_auc"))


CTE["score_rows"] = """
    SELECT feature_set, n_features, cohort_id, feature_draw, 'mcc' AS metric, mcc AS value FROM scores UNION ALL
    SELECT feature_set, n_features, cohort_id, feature_draw, 'roc_auc', roc_auc FROM scores"""


@query("classification_summary", "A14", """
    SELECT feature_set, n_features, metric, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
           count(value) AS n, round(stddev_samp(value) / sqrt(count(value)), 6) AS sem
    FROM score_rows GROUP BY feature_set, n_features, metric""")
def _(t):
    return rounded(A.classification_summary(scores(t), ["mcc", "roc_auc"]), 6, "mean", "std", "sem")


@query("summary_across_cohorts", "A15", """
    WITH c AS (SELECT feature_set, n_features, metric, cohort_id, avg(value) AS m FROM score_rows GROUP BY ALL)
    SELECT feature_set, n_features, metric, round(avg(m), 6) AS mean_score, round(coalesce(stddev_samp(m), 0), 6) AS std,
           count(cohort_id) AS n_cohorts, round(coalesce(stddev_samp(m), 0) / sqrt(count(cohort_id)), 6) AS sem
    FROM c GROUP BY feature_set, n_features, metric""")
def _(t):
    per = A.classification_summary(scores(t), ["mcc", "roc_auc"], ("cohort_id", "feature_set", "n_features"))
    return rounded(A.summary_across_cohorts(per), 6, "mean_score", "std", "sem")


@query("metric_matrix", "A16", """
    WITH c AS (SELECT cohort_id, avg(mcc) FILTER (feature_set = 'set1') AS set1, avg(mcc) FILTER (feature_set = 'set2') AS set2,
                      avg(mcc) FILTER (feature_set = 'set3') AS set3 FROM scores GROUP BY cohort_id)
    SELECT cohort_id, round(set1, 6) AS set1, round(set2, 6) AS set2, round(set3, 6) AS set3,
           round((set1 + set2 + set3) / 3, 6) AS row_mean FROM c""")
def _(t):
    sets = ["set1", "set2", "set3"]
    return rounded(A.metric_matrix(scores(t), ["cohort_id"], "feature_set", sets, "mcc"), 6, *sets, "row_mean")


@query("runtime_ratio", "A17", """
    WITH r AS (SELECT o_custkey AS sample_id, max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS ct,
                      max(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS sticky FROM orders GROUP BY o_custkey)
    SELECT *, round(ct / sticky, 6) AS ratio FROM r WHERE ct IS NOT NULL AND sticky IS NOT NULL""")
def _(t):
    from spanframe.sources.tables import table
    runs = (table(t.spark, t.sf_dir, "orders").where("o_orderstatus IN ('F', 'O')")
            .select(F.col("o_custkey").alias("sample_id"),
                    F.when(F.col("o_orderstatus") == "F", "ct").otherwise("sticky").alias("hmm_type"), "o_totalprice")
            .groupBy("sample_id", "hmm_type").agg(F.max("o_totalprice").alias("runtime_sec")))
    return rounded(A.runtime_ratio(runs, ["ct", "sticky"]), 6, "ratio")


CTE["queries18"] = "SELECT DISTINCT sample_id, chrom, start, \"end\" FROM calls WHERE tool = '2'"
CTE["covered18"] = f"""
    SELECT a.sample_id, a.chrom, a.start, a."end", sum(least(a."end", b."end") - greatest(a.start, b.start)) AS bp
    FROM queries18 a JOIN truth b ON {SAME_SAMPLE} GROUP BY ALL"""
CTE["pairs18"] = f"""
    SELECT a.sample_id, a.chrom, a.start, a."end", count(*) AS n, max(least(a."end", b."end") - greatest(a.start, b.start)) AS mx
    FROM queries18 a JOIN (SELECT * FROM regions WHERE tool = '1') b ON {SAME_SAMPLE} GROUP BY ALL"""
CTE["points18"] = f"""
    SELECT r.sample_id, r.chrom, r.start, r."end", count(*) FILTER (p.coverage > 25) AS nq,
           avg(p.beta) FILTER (p.coverage > 25) AS m, count(*) AS nt
    FROM queries18 r JOIN beta_points p ON {IN_REGION} GROUP BY ALL"""
CTE["categories"] = """
    SELECT q.sample_id, q.chrom, q.start, q."end", CAST(coalesce(c.bp, 0) AS BIGINT) AS covered_bp,
           coalesce(x.n, 0) AS n_overlaps, CAST(coalesce(x.mx, 0) AS BIGINT) AS max_overlap_bp,
           q."end" - q.start AS region_length_bp, round(coalesce(c.bp, 0) / (q."end" - q.start), 6) AS covered_fraction,
           CASE WHEN coalesce(c.bp, 0) / (q."end" - q.start) >= 0.5 THEN 'shared' ELSE 'unique' END AS category,
           CASE WHEN coalesce(c.bp, 0) / (q."end" - q.start) >= 0.5 THEN coalesce(x.n, 0) ELSE 0 END AS n_qualifying_overlaps,
           coalesce(p.nq, 0) AS n_query_points, round(p.m, 9) AS avg_beta, coalesce(p.nt, 0) AS n_target_points,
           CASE WHEN p.nt > 0 THEN round(least(greatest(1 - p.nq / p.nt, 0), 1), 6) END AS point_reduction_fraction
    FROM queries18 q
    LEFT JOIN covered18 c ON c.sample_id = q.sample_id AND c.chrom = q.chrom AND c.start = q.start AND c."end" = q."end"
    LEFT JOIN pairs18 x ON x.sample_id = q.sample_id AND x.chrom = q.chrom AND x.start = q.start AND x."end" = q."end"
    LEFT JOIN points18 p ON p.sample_id = q.sample_id AND p.chrom = q.chrom AND p.start = q.start AND p."end" = q."end" """


def categories(t):
    q = t.calls.where("tool = '2'").select("sample_id", "chrom", "start", "end")
    target = t.regions.where("tool = '1'").select("sample_id", "chrom", "start", "end")
    return P.overlap_categories(q, target, t.beta_points.where("coverage > 25"), t.beta_points, 0.5)


@query("overlap_categories", "A18", "SELECT * FROM categories")
def _(t):
    return rounded(rounded(categories(t), 6, "covered_fraction", "point_reduction_fraction"), 9, "avg_beta")


@query("category_totals", "A18, A19", """
    SELECT category, sample_id, count(*) AS n_regions, CAST(sum(region_length_bp) AS BIGINT) AS bp FROM categories
    GROUP BY category, sample_id
    UNION ALL SELECT category, NULL, count(*), CAST(sum(region_length_bp) AS BIGINT) FROM categories GROUP BY category""")
def _(t):
    return P.category_totals(categories(t))


@query("category_metrics", "A19", """
    SELECT category, 'covered_bp' AS metric, count(covered_bp) AS n, round(avg(covered_bp), 4) AS mean,
           CAST(median(covered_bp) AS DOUBLE) AS median, CAST(max(covered_bp) AS DOUBLE) AS max, CAST(0 AS BIGINT) AS n_excluded
    FROM categories GROUP BY category
    UNION ALL SELECT category, 'region_length_bp', count(*), round(avg(region_length_bp), 4), CAST(median(region_length_bp) AS DOUBLE),
           CAST(max(region_length_bp) AS DOUBLE), 0 FROM categories GROUP BY category""")
def _(t):
    return rounded(A.group_summary(categories(t), ["category"], ["covered_bp", "region_length_bp"]), 4, "mean")


@query("value_count_delta", "A20", """
    WITH a AS (SELECT chrom, count(*) AS original FROM regions WHERE tool = '1' GROUP BY chrom),
         b AS (SELECT chrom, count(*) AS randomized FROM regions WHERE tool = '2' GROUP BY chrom)
    SELECT coalesce(a.chrom, b.chrom) AS chrom, coalesce(original, 0) AS original, coalesce(randomized, 0) AS randomized,
           coalesce(randomized, 0) - coalesce(original, 0) AS delta FROM a FULL JOIN b ON a.chrom = b.chrom""")
def _(t):
    return A.value_count_delta(t.regions.where("tool = '1'"), t.regions.where("tool = '2'"))


@query("sample_distribution", "A21", """
    SELECT sample_type, count(DISTINCT sample) AS n_samples FROM samples GROUP BY sample_type""")
def _(t):
    return A.sample_distribution(t.samples, "sample_type")


@query("null_table_average", "A22", """
    WITH r AS (SELECT cohort_id, feature_set, avg(mcc) AS score FROM scores WHERE feature_draw = 0 GROUP BY ALL),
         d AS (SELECT cohort_id, feature_set, feature_draw, avg(mcc) AS score FROM scores WHERE feature_draw > 0 GROUP BY ALL),
         n AS (SELECT cohort_id, feature_set, avg(score) AS m, coalesce(stddev_samp(score), 0) AS s, count(score) AS k FROM d GROUP BY ALL)
    SELECT r.cohort_id, r.feature_set, round(r.score, 6) AS score, round(n.m, 6) AS random_mean, round(n.s, 6) AS random_std,
           n.k AS n_repeats, round(r.score - n.m, 6) AS delta
    FROM r LEFT JOIN n ON r.cohort_id = n.cohort_id AND r.feature_set = n.feature_set""")
def _(t):
    keys = ["cohort_id", "feature_set"]
    draws = scores(t).groupBy(*keys, "feature_draw").agg(F.avg("mcc").alias("score"))
    real = draws.where("feature_draw = 0").drop("feature_draw")
    out = A.null_table_average(real, draws.where("feature_draw > 0"), keys)
    return rounded(out, 6, "score", "random_mean", "random_std", "delta")


@query("signal_enrichment", "G8", f"""
    WITH i AS (SELECT b.tool, sum(a.value * (least(a."end", b."end") - greatest(a.start, b.start))) /
                      sum(least(a."end", b."end") - greatest(a.start, b.start)) AS region_mean
               FROM signal a JOIN pool b ON {HITS} GROUP BY b.tool),
         p AS (SELECT a.tool, sum(least(a."end", b."end") - greatest(a.start, b.start)) AS bp
               FROM pool a JOIN merged_features b ON {HITS} GROUP BY a.tool),
         r AS (SELECT tool, sum("end" - start) AS bp FROM pool GROUP BY tool)
    SELECT r.tool, CAST(r.bp AS BIGINT) AS region_bp, CAST(p.bp AS BIGINT) AS peak_overlap_bp,
           round(i.region_mean / (SELECT sum(value * ("end" - start)) / sum("end" - start) FROM signal), 6) AS signal_ratio,
           round(p.bp / (SELECT sum("end" - start) FROM merged_features), 6) AS peak_overlap_fraction,
           round((p.bp / (SELECT sum("end" - start) FROM merged_features)) / (r.bp / (SELECT sum(size) FROM sizes)), 6) AS peak_ratio
    FROM r JOIN i ON r.tool = i.tool JOIN p ON r.tool = p.tool""")
def _(t):
    out = P.signal_enrichment(t.regions, t.signal, t.features, t.sizes)
    return rounded(out, 6, "signal_ratio", "peak_overlap_fraction", "peak_ratio").select(
        "tool", "region_bp", "peak_overlap_bp", "signal_ratio", "peak_overlap_fraction", "peak_ratio")
