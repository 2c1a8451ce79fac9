"""Interval algebra queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanframe.operators import ranges as R
from spanframe.plans.registry import CTE, merge_sql, query, rounded

SAMPLE_TOOL = ["sample_id", "tool"]
HITS = 'a.chrom = b.chrom AND a.start < b."end" AND b.start < a."end"'
SAME_SAMPLE = f"a.sample_id = b.sample_id AND {HITS}"


@query("merge_intervals", "I1", "SELECT * FROM merged")
def _(t):
    return R.merge_intervals(t.regions, SAMPLE_TOOL)


@query("merge_intervals_bridging_gaps", "I1", merge_sql("regions", "sample_id, tool", 1000))
def _(t):
    return R.merge_intervals(t.regions, SAMPLE_TOOL, max_gap=1000)


@query("merge_intervals_strict", "I1", merge_sql("regions", "sample_id", -1))
def _(t):
    return R.merge_intervals(t.regions, ["sample_id"], max_gap=-1)


CTE["fuzzy"] = merge_sql("regions", "tool", 1000)


@query("merge_with_provenance", "I2", """
    SELECT f.tool, f.chrom, f.start, f."end", f."end" - f.start AS length,
           string_agg(DISTINCT r.sample_id, ',' ORDER BY r.sample_id) AS samples,
           count(DISTINCT r.sample_id) AS sample_count
    FROM fuzzy f JOIN regions r ON r.tool = f.tool AND r.chrom = f.chrom AND r.start >= f.start AND r.start < f."end"
    GROUP BY ALL""")
def _(t):
    return R.merge_with_provenance(t.regions, ["tool"]).withColumn("samples", F.concat_ws(",", "samples"))


# equal points are one row: a running sum over tied rows would leave to chance which of them opens a span
DISTINCT_POINTS = '(SELECT DISTINCT sample_id, chrom, start, "end" FROM points)'


@query("supported_spans", "I3", merge_sql(DISTINCT_POINTS, "sample_id", 2999))
def _(t):
    return R.supported_spans(t.points, ["sample_id"], min_gap=3000)


CTE["feature_gaps"] = """
    SELECT chrom, coalesce(lag("end") OVER w, -1000000000) AS start, start AS "end" FROM merged_features
        WINDOW w AS (PARTITION BY chrom ORDER BY start)
    UNION ALL SELECT chrom, max("end"), 1000000000000 FROM merged_features GROUP BY chrom
    UNION ALL SELECT chrom, -1000000000, 1000000000000 FROM (SELECT DISTINCT chrom FROM regions)
        WHERE chrom NOT IN (SELECT chrom FROM features)"""


@query("subtract", "I4", f"""
    SELECT a.sample_id, a.tool, a.region_id, a.chrom, greatest(a.start, b.start) AS start,
           least(a."end", b."end") AS "end"
    FROM regions a JOIN feature_gaps b ON {HITS}""")
def _(t):
    return R.subtract(t.regions, t.features)


@query("complement", "I5", """
    WITH edges AS (SELECT chrom, start, "end" FROM merged_features
                   UNION ALL SELECT chrom, size, size FROM sizes),
         g AS (SELECT chrom, coalesce(lag("end") OVER (PARTITION BY chrom ORDER BY start), 0) AS start,
                      start AS "end" FROM edges)
    SELECT * FROM g WHERE "end" - start >= 500""")
def _(t):
    return R.complement(t.features, R.whole_chroms(t.sizes), min_length=500)


@query("overlap_pairs", "I6", f"""
    SELECT a.region_id, a.chrom, a.start, a."end", b.feature_id, b.start AS b_start, b."end" AS b_end,
           least(a."end", b."end") - greatest(a.start, b.start) AS overlap_bp
    FROM regions a JOIN features b ON {HITS}""")
def _(t):
    return (R.overlap_pairs(t.regions, t.features)
            .select("region_id", "chrom", "start", "end", F.col("b_feature_id").alias("feature_id"),
                    "b_start", "b_end", "overlap_bp"))


@query("points_with_features", "I7", f"""
    SELECT a.point_id, a.chrom, a.start, a.meth, a.coverage, b.feature_id, b.start AS b_start, b."end" AS b_end
    FROM points a JOIN features b ON {HITS}""")
def _(t):
    return (R.range_join(t.points, t.features)
            .select("point_id", "chrom", "start", "meth", "coverage", F.col("b_feature_id").alias("feature_id"),
                    "b_start", "b_end"))


@query("intersect_pieces", "I8", f"""
    SELECT a.sample_id, a.tool, a.region_id, a.chrom, greatest(a.start, b.start) AS start,
           least(a."end", b."end") AS "end"
    FROM regions a JOIN features b ON {HITS}""")
def _(t):
    return R.intersect_pieces(t.regions, t.features)


@query("overlaps_any", "I9", f"SELECT * FROM regions a WHERE EXISTS (SELECT 1 FROM features b WHERE {HITS})")
def _(t):
    return R.overlaps_any(t.regions, t.features)


@query("points_in_any_region", "I9", f"SELECT * FROM points a WHERE EXISTS (SELECT 1 FROM merged b WHERE {SAME_SAMPLE})")
def _(t):
    return R.points_in(t.points, t.regions, ["sample_id"])


@query("overlaps_none", "I10", f"SELECT * FROM regions a WHERE NOT EXISTS (SELECT 1 FROM features b WHERE {HITS})")
def _(t):
    return R.overlaps_none(t.regions, t.features)


@query("exclude_near", "I11", """
    SELECT * FROM regions a WHERE NOT EXISTS (SELECT 1 FROM features b
        WHERE a.chrom = b.chrom AND b.start <= a."end" + 1000 AND b."end" >= a.start - 1000)""")
def _(t):
    return R.exclude_near(t.regions, t.features, 1000)


@query("slop", "I12", """
    SELECT r.sample_id, r.tool, r.chrom, greatest(r.start - 10000, 0) AS start,
           least(r."end" + 10000, s.size) AS "end", r.region_id
    FROM regions r JOIN sizes s ON r.chrom = s.chrom""")
def _(t):
    return R.slop(t.regions, 10_000, t.sizes)


CTE["all_calls"] = merge_sql("(SELECT * FROM regions WHERE tool <> '1')", "sample_id")


@query("overlap_metrics", "I13", f"""
    WITH tb AS (SELECT sample_id, sum("end" - start) AS bp FROM truth GROUP BY sample_id),
         cb AS (SELECT sample_id, sum("end" - start) AS bp FROM all_calls GROUP BY sample_id),
         o AS (SELECT a.sample_id, sum(least(a."end", b."end") - greatest(a.start, b.start)) AS bp
               FROM truth a JOIN all_calls b ON {SAME_SAMPLE} GROUP BY a.sample_id)
    SELECT tb.sample_id, CAST(tb.bp AS BIGINT) AS a_bp, CAST(cb.bp AS BIGINT) AS b_bp,
           CAST(o.bp AS BIGINT) AS overlap_bp, CAST(tb.bp + cb.bp - o.bp AS BIGINT) AS union_bp,
           round(o.bp / tb.bp, 6) AS a_fraction, round(o.bp / cb.bp, 6) AS b_fraction,
           round(o.bp / (tb.bp + cb.bp - o.bp), 6) AS jaccard
    FROM tb JOIN cb ON tb.sample_id = cb.sample_id JOIN o ON tb.sample_id = o.sample_id""")
def _(t):
    calls = t.regions.where("tool <> '1'")
    return rounded(R.overlap_metrics(t.truth, calls, ["sample_id"]), 6, "a_fraction", "b_fraction", "jaccard")


@query("pairwise_matrices", "I14", f"""
    WITH bp AS (SELECT sample_id, tool, sum("end" - start) AS bp FROM merged GROUP BY sample_id, tool),
         o AS (SELECT a.sample_id, a.tool, b.tool AS b_tool,
                      sum(least(a."end", b."end") - greatest(a.start, b.start)) AS ov
               FROM merged a JOIN merged b ON {SAME_SAMPLE} GROUP BY ALL)
    SELECT x.sample_id, x.tool, y.tool AS b_tool, CAST(x.bp AS BIGINT) AS bp, CAST(y.bp AS BIGINT) AS b_bp,
           CAST(coalesce(o.ov, 0) AS BIGINT) AS overlap_bp, round(coalesce(o.ov, 0) / x.bp, 6) AS pct_cover,
           round(coalesce(o.ov, 0) / (x.bp + y.bp - coalesce(o.ov, 0)), 6) AS jaccard
    FROM bp x JOIN bp y ON x.sample_id = y.sample_id
    LEFT JOIN o ON o.sample_id = x.sample_id AND o.tool = x.tool AND o.b_tool = y.tool""")
def _(t):
    return rounded(R.pairwise_matrices(t.regions), 6, "pct_cover", "jaccard")


@query("pairwise_matrices_unmerged", "I14", f"""
    WITH bp AS (SELECT sample_id, tool, sum("end" - start) AS bp FROM merged GROUP BY sample_id, tool),
         o AS (SELECT a.sample_id, a.tool, b.tool AS b_tool,
                      sum(least(a."end", b."end") - greatest(a.start, b.start)) AS ov
               FROM regions a JOIN regions b ON {SAME_SAMPLE} GROUP BY ALL)
    SELECT x.sample_id, x.tool, y.tool AS b_tool, CAST(coalesce(o.ov, 0) AS BIGINT) AS overlap_bp,
           round(coalesce(o.ov, 0) / x.bp, 6) AS pct_cover
    FROM bp x JOIN bp y ON x.sample_id = y.sample_id
    LEFT JOIN o ON o.sample_id = x.sample_id AND o.tool = x.tool AND o.b_tool = y.tool""")
def _(t):
    out = R.pairwise_matrices(t.regions, merge_first=False)
    return rounded(out, 6, "pct_cover").select("sample_id", "tool", "b_tool", "overlap_bp", "pct_cover")


@query("genome_coverage_pct", "I15", """
    SELECT sample_id, tool, CAST(sum("end" - start) AS BIGINT) AS covered_bp,
           (SELECT CAST(sum(size) AS BIGINT) FROM sizes) AS genome_bp,
           round(100.0 * sum("end" - start) / (SELECT sum(size) FROM sizes), 6) AS coverage_pct
    FROM merged GROUP BY sample_id, tool""")
def _(t):
    return rounded(R.genome_coverage_pct(t.regions, t.sizes, SAMPLE_TOOL), 6, "coverage_pct")


CTE["cuts"] = """SELECT DISTINCT tool, chrom, pos FROM (
    SELECT tool, chrom, start AS pos FROM merged UNION ALL SELECT tool, chrom, "end" FROM merged)"""
CTE["cut_pieces"] = """SELECT tool, chrom, pos AS start, lead(pos) OVER (PARTITION BY tool, chrom ORDER BY pos) AS "end"
    FROM cuts"""
CTE["supported"] = """
    SELECT p.tool, p.chrom, p.start, p."end", count(DISTINCT m.sample_id) AS n
    FROM cut_pieces p JOIN merged m ON m.tool = p.tool AND m.chrom = p.chrom AND m.start < p."end" AND m."end" > p.start
    GROUP BY ALL"""
CTE["consensus"] = merge_sql("supported", "tool, n")


@query("consensus_regions", "I16", """
    SELECT tool, chrom, start, "end", n AS n_supporting_samples FROM consensus""")
def _(t):
    return R.consensus_regions(t.regions)


CTE["support_cutoff"] = "SELECT greatest(2, CAST(ceil(count(DISTINCT sample_id) / 2) AS BIGINT)) AS cutoff FROM regions"


@query("consensus_consistency", "I17", """
    WITH tot AS (SELECT sample_id, tool, sum("end" - start) AS total_bp FROM regions GROUP BY ALL),
         o AS (SELECT a.sample_id, a.tool, sum(least(a."end", b."end") - greatest(a.start, b.start)) AS all_bp,
                      sum(CASE WHEN b.n >= (SELECT cutoff FROM support_cutoff)
                          THEN least(a."end", b."end") - greatest(a.start, b.start) ELSE 0 END) AS high_bp
               FROM regions a JOIN consensus b ON a.tool = b.tool AND a.chrom = b.chrom
                    AND a.start < b."end" AND b.start < a."end" GROUP BY ALL)
    SELECT tot.sample_id, tot.tool, CAST(total_bp AS BIGINT) AS total_bp, CAST(all_bp AS BIGINT) AS consensus_overlap_bp,
           (SELECT cutoff FROM support_cutoff) AS high_support_cutoff,
           CAST(high_bp AS BIGINT) AS high_support_overlap_bp,
           round(all_bp / total_bp, 6) AS fraction_bp_in_consensus,
           round(high_bp / total_bp, 6) AS fraction_bp_in_high_support_consensus
    FROM tot JOIN o ON tot.sample_id = o.sample_id AND tot.tool = o.tool""")
def _(t):
    return rounded(R.consensus_consistency(t.regions), 6, "fraction_bp_in_consensus",
                   "fraction_bp_in_high_support_consensus")


CTE["loci"] = merge_sql("(SELECT * FROM regions WHERE tool IN ('1', '2', '3'))", "sample_id", -1)
CTE["locus_bits"] = """
    SELECT l.sample_id, l.chrom, l.start, l."end", CAST(max(CASE WHEN r.tool = '1' THEN 1 ELSE 0 END) AS INTEGER) AS in_1,
           CAST(max(CASE WHEN r.tool = '2' THEN 1 ELSE 0 END) AS INTEGER) AS in_2,
           CAST(max(CASE WHEN r.tool = '3' THEN 1 ELSE 0 END) AS INTEGER) AS in_3
    FROM loci l JOIN regions r ON r.sample_id = l.sample_id AND r.chrom = l.chrom AND r.tool IN ('1', '2', '3')
         AND r.start >= l.start AND r.start < l."end" GROUP BY ALL"""


@query("membership", "I18", """
    SELECT *, concat(CAST(in_1 AS VARCHAR), CAST(in_2 AS VARCHAR), CAST(in_3 AS VARCHAR)) AS subset_key
    FROM locus_bits""")
def _(t):
    chosen = t.regions.where(F.col("tool").isin("1", "2", "3"))
    return R.membership(chosen, ["1", "2", "3"], keys=["sample_id"])


@query("subset_counts", "I19", """
    WITH k AS (SELECT concat(CAST((i // 4) % 2 AS VARCHAR), CAST((i // 2) % 2 AS VARCHAR), CAST(i % 2 AS VARCHAR))
                      AS subset_key, i FROM range(1, 8) AS r(i)),
         c AS (SELECT concat(CAST(in_1 AS VARCHAR), CAST(in_2 AS VARCHAR), CAST(in_3 AS VARCHAR)) AS subset_key,
                      count(*) AS n FROM locus_bits GROUP BY ALL)
    SELECT k.subset_key, coalesce(c.n, 0) AS n_loci,
           CAST((i // 4) % 2 + (i // 2) % 2 + i % 2 AS BIGINT) AS n_sets,
           concat_ws('&', CASE WHEN (i // 4) % 2 = 1 THEN '1' END, CASE WHEN (i // 2) % 2 = 1 THEN '2' END,
                     CASE WHEN i % 2 = 1 THEN '3' END) AS label
    FROM k LEFT JOIN c ON k.subset_key = c.subset_key""")
def _(t):
    chosen = t.regions.where(F.col("tool").isin("1", "2", "3"))
    return R.subset_counts(R.membership(chosen, ["1", "2", "3"], keys=["sample_id"]), ["1", "2", "3"])


CTE["sample_union"] = merge_sql("regions", "sample_id")


@query("annotate_with_sources", "I20", f"""
    SELECT a.sample_id, a.chrom, a.start, a."end", string_agg(DISTINCT b.tool, ', ' ORDER BY b.tool) AS tools,
           count(DISTINCT b.tool) AS n_tools
    FROM sample_union a JOIN merged b ON {SAME_SAMPLE} GROUP BY ALL""")
def _(t):
    return R.annotate_with_sources(R.merge_intervals(t.regions, ["sample_id"]), t.regions, ["sample_id"])


CTE["signal_cuts"] = """SELECT DISTINCT chrom, pos FROM (
    SELECT chrom, start AS pos FROM signal UNION ALL SELECT chrom, "end" FROM signal)"""
CTE["signal_pieces"] = """
    SELECT p.chrom, p.start, p."end", round(avg(s.value), 9) AS value FROM (
        SELECT chrom, pos AS start, lead(pos) OVER (PARTITION BY chrom ORDER BY pos) AS "end" FROM signal_cuts) p
    JOIN signal s ON s.chrom = p.chrom AND s.start < p."end" AND s."end" > p.start GROUP BY p.chrom, p.start, p."end" """


@query("split_signal_overlaps", "I21", f"""
    SELECT chrom, start, "end", round(value, 6) AS value FROM ({merge_sql('signal_pieces', 'value')})""")
def _(t):
    return rounded(R.split_signal_overlaps(t.signal), 6, "value")


@query("binary_signal", "I22", "SELECT *, CAST(1.0 AS DOUBLE) AS value FROM merged")
def _(t):
    return R.binary_signal(t.regions, 1.0, SAMPLE_TOOL)


CTE["windows"] = """
    SELECT sample_id, tool, chrom, start, "end", start AS win_start, "end" AS win_end, 'merged' AS window_label
    FROM merged WHERE greatest(start, "end" - 5000) <= least("end", start + 5000)
    UNION ALL SELECT sample_id, tool, chrom, start, "end", start, least("end", start + 5000), 'start'
    FROM merged WHERE greatest(start, "end" - 5000) > least("end", start + 5000)
    UNION ALL SELECT sample_id, tool, chrom, start, "end", greatest(start, "end" - 5000), "end", 'end'
    FROM merged WHERE greatest(start, "end" - 5000) > least("end", start + 5000)"""


@query("end_windows", "I23", "SELECT *, win_end - win_start AS length FROM windows")
def _(t):
    return R.end_windows(t.merged, 5000)


@query("boundaries", "I24", """
    SELECT sample_id, tool, chrom, start AS pos FROM merged
    UNION SELECT sample_id, tool, chrom, "end" FROM merged""")
def _(t):
    return R.boundaries(t.regions, SAMPLE_TOOL)


CTE["blocks"] = """
    SELECT chrom, start, "end", concat('dst', substr(chrom, 4)) AS dst_chrom, start + 7777 AS dst_start,
           CASE WHEN start % 2 = 0 THEN '+' ELSE '-' END AS strand FROM merged_features"""


@query("liftover", "I25", f"""
    SELECT a.region_id, a.sample_id, a.tool, b.dst_chrom AS chrom,
           CASE WHEN b.strand = '+' THEN b.dst_start + greatest(a.start, b.start) - b.start
                ELSE b.dst_start + b."end" - least(a."end", b."end") END AS start,
           CASE WHEN b.strand = '+' THEN b.dst_start + least(a."end", b."end") - b.start
                ELSE b.dst_start + b."end" - greatest(a.start, b.start) END AS "end"
    FROM regions a JOIN blocks b ON {HITS}""")
def _(t):
    blocks = t.merged_features.select(
        "chrom", "start", "end", F.concat(F.lit("dst"), F.substring("chrom", 4, 10)).alias("dst_chrom"),
        (F.col("start") + 7777).alias("dst_start"),
        F.when(F.col("start") % 2 == 0, "+").otherwise("-").alias("strand"))
    return R.liftover(t.regions, blocks)


CTE["pool"] = merge_sql("regions", "tool")


@query("pooled_regions", "I26", """
    WITH c AS (SELECT tool, count(*) FILTER ("end" - start >= 20000) AS n_kept,
                      count(*) FILTER ("end" - start < 20000) AS n_excluded FROM pool GROUP BY tool)
    SELECT p.tool, p.chrom, p.start, p."end", c.n_kept, c.n_excluded, 'default' AS settings
    FROM pool p JOIN c ON p.tool = c.tool WHERE p."end" - p.start >= 20000""")
def _(t):
    return R.pooled_regions(t.regions.withColumn("settings", F.lit("default")), min_length=20_000)
