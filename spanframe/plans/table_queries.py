"""Source, sink and cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanframe.functions import CANONICAL_CHROMS, bp_label, chrom_rank, normalize_chrom, stable_seed
from spanframe.operators import cleaning as C
from spanframe.operators import ranges as R
from spanframe.plans.registry import CTE, query, rounded
from spanframe.session import fresh_dir
from spanframe.sources import files as S

CANON = ", ".join(f"'{c}'" for c in CANONICAL_CHROMS)


def md5_sql(seed, *columns: str) -> str:
    return f"md5(concat_ws('|', '{seed}', {', '.join(f'CAST({c} AS VARCHAR)' for c in columns)}))"


# ------------------------------------------------------------ sources, sinks

@query("read_bed", "S1, S10", 'SELECT chrom, start, "end" FROM regions')
def _(t):
    path = S.write_table(t.regions.select("chrom", "start", "end", "tool"), fresh_dir(t.spark, "bed"))
    return S.read_bed(t.spark, path)


@query("read_bedgraph", "S2, S10", "SELECT * FROM signal")
def _(t):
    return S.read_bedgraph(t.spark, S.write_table(t.signal, fresh_dir(t.spark, "bedgraph")))


@query("read_tool_regions", "S3", """
    SELECT sample_id, tool, chrom, start, "end" FROM regions
    WHERE tool IN ('1', '2') OR (tool = '3' AND region_id % 2 = 0)""")
def _(t):
    root = fresh_dir(t.spark, "tools")
    r = t.regions
    bed3 = r.where("tool = '1'").select("sample_id", "chrom", "start", "end")
    bed4 = r.where("tool = '2'").select("sample_id", "chrom", "start", "end", F.lit("x").alias("label"))
    category = F.when(F.col("region_id") % 2 == 0, "PMD").otherwise("other")
    stats = r.where("tool = '3'").select("sample_id", "chrom", "start", "end", F.lit(1).alias("n"),
                                         F.lit(0.5).alias("m"), F.lit(0.1).alias("s"), category.alias("category"))
    registry = []
    for tool, df, layout, header in (("1", bed3, "bed3", False), ("2", bed4, "bed4", True), ("3", stats, "stats7", False)):
        path = S.write_table(df, f"{root}/{tool}", header=header, partition_by=["sample_id"])
        registry.append({"tool": tool, "layout": layout, "header": header, "path": path})
    registry[2]["category"] = "PMD"
    return S.read_tool_regions(t.spark, registry)


@query("read_wgbs", "S4", """
    SELECT chrom, start, "end", meth, coverage FROM points UNION ALL
    SELECT chrom, start, "end", meth, coverage FROM points""")
def _(t):
    root = fresh_dir(t.spark, "wgbs")
    p = t.points
    five = p.select("chrom", "start", "end", "coverage", (F.col("meth") / F.col("coverage") * 100.0).alias("pct"))
    six = p.select("chrom", "start", "end", (F.col("meth") / F.col("coverage")).alias("beta"), "coverage",
                   F.lit("CG").alias("context"))
    S.write_table(five, f"{root}/five", gzip=True)
    S.write_table(six, f"{root}/six", gzip=True)
    return S.read_wgbs(t.spark, [f"{root}/five", f"{root}/six"])


@query("read_sample_table", "S5", "SELECT * FROM samples WHERE project_id IN ('TCGA-C1', 'TCGA-C2')")
def _(t):
    path = S.write_table(t.samples, fresh_dir(t.spark, "samples"), header=True)
    return S.read_sample_table(t.spark, path, ["TCGA-C1", "TCGA-C2"])


@query("load_matrix", "S6", """
    SELECT a.sample_id, p.chrom, p.start, p."end", p.probe,
           CASE WHEN a.raw <> 255 THEN a.raw / 100.0 END AS beta
    FROM arrays a JOIN probes p ON a.probe_idx = p.probe_idx""")
def _(t):
    return S.load_matrix(t.arrays, t.probes)


@query("read_chrom_sizes", "S7, S10", "SELECT * FROM sizes")
def _(t):
    return S.read_chrom_sizes(t.spark, S.write_table(t.sizes, fresh_dir(t.spark, "sizes")))


@query("read_for_chrom", "S8", "SELECT * FROM points WHERE chrom = 'chr7'")
def _(t):
    return S.read_for_chrom(t.spark, S.write_track(t.points, fresh_dir(t.spark, "track")), "chr7")


@query("collect_outputs", "S9", "SELECT concat(sample_id, '_', tool) AS task, count(*) AS n_rows FROM regions GROUP BY ALL")
def _(t):
    rows = t.regions.withColumn("task", F.concat_ws("_", "sample_id", "tool")).select("task", "chrom", "start", "end")
    root = S.write_table(rows, fresh_dir(t.spark, "tasks"), header=True, partition_by=["task"])
    return S.rows_per_task(S.collect_outputs(t.spark, root, S.BED))


@query("collect_task_tables", "S9", """
    SELECT concat(sample_id, '_', tool) AS task, count(*) AS n_results_rows, count(DISTINCT (chrom, start, "end")) AS n_regions_rows,
           count(DISTINCT chrom) AS n_predictions_rows FROM regions GROUP BY ALL""")
def _(t):
    """Three tables of every task written, found again and counted."""
    rows = t.regions.withColumn("task", F.concat_ws("_", "sample_id", "tool"))
    written = {"results": rows.select("task", "chrom", "start", "end"), "regions": rows.select("task", "chrom", "start", "end").distinct(),
               "predictions": rows.select("task", "chrom").distinct()}
    root = fresh_dir(t.spark, "task-tables")
    for name, df in written.items():
        S.write_table(df, f"{root}/{name}", header=True, partition_by=["task"])
    return S.collect_task_tables(t.spark, root, {"results": S.BED, "regions": S.BED, "predictions": "chrom string"})[1]


@query("export_tracks", "S11", """
    SELECT sample_id, concat('tool_', tool) AS track, count(*) AS n_regions FROM merged GROUP BY ALL
    UNION ALL SELECT 'shared', 'consensus', count(*) FROM consensus
    UNION ALL SELECT 'shared', 'high_support', count(*) FROM consensus WHERE n >= (SELECT cutoff FROM support_cutoff)""")
def _(t):
    own = t.merged.select("sample_id", F.concat(F.lit("tool_"), "tool").alias("track"), "chrom", "start", "end")
    consensus = R.consensus_regions(t.regions)
    cutoff = t.regions.agg(F.greatest(F.lit(2), F.ceil(F.countDistinct("sample_id") / 2)).alias("cutoff"))
    strong = consensus.crossJoin(F.broadcast(cutoff)).where("n_supporting_samples >= cutoff")  # one row
    shared = [df.select(F.lit("shared").alias("sample_id"), F.lit(name).alias("track"), "chrom", "start", "end")
              for name, df in (("consensus", consensus), ("high_support", strong))]
    return S.export_tracks(own.unionByName(shared[0]).unionByName(shared[1]), fresh_dir(t.spark, "tracks"))


@query("finalize_shards", "S12", """
    SELECT sample_id, n_regions, 'ok' AS status FROM (
        SELECT sample_id, count(*) AS n_regions FROM regions WHERE sample_id <> 'P' GROUP BY sample_id)
    UNION ALL SELECT DISTINCT sample_id, CAST(NULL AS BIGINT), 'missing_shard' FROM regions WHERE sample_id = 'P'""")
def _(t):
    done = t.regions.where("sample_id <> 'P'").groupBy("sample_id").agg(F.count("*").alias("n_regions"))
    path = S.write_shards(done, fresh_dir(t.spark, "shards"))
    return S.finalize_shards(t.spark, path, t.regions.select("sample_id")).select("sample_id", "n_regions", "status")


@query("point_level_layout", "S13", """
    SELECT chrom, start AS pos, '+' AS strand, 'CpG' AS context, round(meth / coverage, 9) AS level, coverage FROM points""")
def _(t):
    return rounded(S.point_level_layout(t.points), 9, "level")


@query("one_based_counts_layout", "S13",
       'SELECT chrom, start + 1 AS pos, coverage AS "T", meth AS "M" FROM points WHERE coverage > 0')
def _(t):
    return S.one_based_counts_layout(t.points)


@query("percent_layout", "S13", 'SELECT chrom, start, "end", round(meth / coverage * 100.0, 9) AS percent FROM points')
def _(t):
    return rounded(S.percent_layout(t.points), 9, "percent")


# ------------------------------------------------------------------ cleaning

CTE["messy"] = """
    SELECT CASE WHEN region_id % 50 = 0 THEN NULL ELSE chrom END AS chr,
           CASE WHEN region_id % 41 = 0 THEN 'n/a' ELSE CAST(start - 3000 AS VARCHAR) END AS beg,
           CASE WHEN region_id % 37 = 0 THEN CAST(start - 4000 AS VARCHAR) ELSE CAST("end" AS VARCHAR) END AS "end"
    FROM regions"""


def messy(t):
    i = F.col("region_id")
    return t.regions.select(
        F.when(i % 50 != 0, F.col("chrom")).alias("chr"),
        F.when(i % 41 == 0, "n/a").otherwise((F.col("start") - 3000).cast("string")).alias("beg"),
        F.when(i % 37 == 0, (F.col("start") - 4000).cast("string")).otherwise(F.col("end").cast("string")).alias("end"))


@query("clean_intervals", "C1", """
    SELECT *, "end" - start AS length FROM (
        SELECT chr AS chrom, greatest(TRY_CAST(beg AS BIGINT), 0) AS start, TRY_CAST("end" AS BIGINT) AS "end" FROM messy
        WHERE chr IS NOT NULL AND TRY_CAST(beg AS BIGINT) IS NOT NULL AND TRY_CAST("end" AS BIGINT) IS NOT NULL)
    WHERE "end" > start""")
def _(t):
    return C.clean_intervals(messy(t))


@query("clip_to_genome", "C2", """
    SELECT r.sample_id, r.tool, r.region_id, r.chrom, r.start, least(r."end", s.size - 50000) AS "end"
    FROM regions r JOIN sizes s ON r.chrom = s.chrom WHERE least(r."end", s.size - 50000) > r.start""")
def _(t):
    return C.clip_to_genome(t.regions, t.sizes.withColumn("size", F.col("size") - 50_000))


@query("normalize_chrom", "C3", """
    SELECT region_id, CASE WHEN region_id % 6 = 3 THEN NULL ELSE chrom END AS chrom FROM regions""")
def _(t):
    form = F.col("region_id") % 6
    bare = F.substring("chrom", 4, 2)
    raw = (F.when(form == 0, bare).when(form == 1, F.concat(F.lit("CHR"), bare)).when(form == 2, F.concat(F.lit(" "), bare))
           .when(form == 3, F.concat("chrom", F.lit("_random"))).otherwise(F.col("chrom")))
    return t.regions.select("region_id", normalize_chrom(raw).alias("chrom"))


@query("finalize_points", "C4", """
    SELECT chrom, start, "end", CASE WHEN point_id % 11 = 0 THEN coverage ELSE meth END AS meth, coverage FROM points
    WHERE point_id % 13 <> 0""")
def _(t):
    i = F.col("point_id")
    raw = t.points.select(
        "chrom", F.col("start").cast("string"), F.col("end").cast("string"),
        F.when(i % 11 == 0, F.col("coverage") + 5).otherwise(F.col("meth")).cast("string").alias("meth"),
        F.when(i % 13 == 0, "bad").otherwise(F.col("coverage").cast("string")).alias("coverage"))
    return C.finalize_points(raw)


@query("add_beta", "C5", """
    SELECT point_id, CASE WHEN coverage > 5 THEN round(meth / coverage, 9) END AS beta_null,
           CASE WHEN coverage > 5 THEN round(meth / coverage, 9) ELSE 0 END AS beta_zero FROM points""")
def _(t):
    masked = t.points.withColumn("coverage", F.when(F.col("coverage") > 5, F.col("coverage")).otherwise(0))
    both = C.add_beta(C.add_beta(masked).withColumnRenamed("beta", "beta_null"), "zero")
    return rounded(both.withColumnRenamed("beta", "beta_zero"), 9, "beta_null", "beta_zero") \
        .select("point_id", "beta_null", "beta_zero")


@query("validate_beta", "C6", """
    SELECT point_id, round(meth / coverage * 2.5, 9) AS beta FROM points WHERE meth / coverage * 2.5 BETWEEN 0 AND 1""")
def _(t):
    stretched = t.beta_points.select("point_id", (F.col("beta") * 2.5).alias("beta"))
    return rounded(C.validate_beta(C.validate_beta(stretched, "filter")), 9, "beta")


@query("collapse_duplicates", "C7", """
    SELECT sample_id, chrom, start, "end", round(avg(beta), 9) AS beta FROM beta_points GROUP BY ALL""")
def _(t):
    return rounded(C.collapse_duplicates(t.beta_points, ["sample_id"]), 9, "beta")


@query("disjoint_check", "C8", """
    WITH o AS (SELECT sample_id, tool, start < lag("end") OVER (PARTITION BY sample_id, tool, chrom ORDER BY start, "end") AS bad
               FROM regions)
    SELECT sample_id, tool, NOT bool_or(coalesce(bad, false)) AS is_disjoint FROM o GROUP BY ALL
    UNION ALL SELECT DISTINCT sample_id, 'merged', true FROM merged""")
def _(t):
    keys = ["sample_id", "tool"]
    merged = R.merge_intervals(t.regions, keys[:1]).withColumn("tool", F.lit("merged"))
    return C.disjoint_check(t.regions.select(*keys, "chrom", "start", "end").unionByName(merged), keys).drop("max_depth")


@query("annotate_removed", "C9, G6", """
    SELECT point_id, CASE WHEN coverage <= 0 THEN 'zero_coverage' ELSE 'coverage_below_10' END AS reason
    FROM points WHERE coverage < 10""")
def _(t):
    return C.annotate_removed(t.points, 10).select("point_id", "reason")


@query("reverse_intersection", "C10, J3", """
    SELECT DISTINCT sample_id, chrom, start, "end", 'not_retained' AS reason FROM points p
    WHERE NOT EXISTS (SELECT 1 FROM points q WHERE q.sample_id = p.sample_id AND q.chrom = p.chrom
                      AND q.start = p.start AND q.coverage >= 10)""")
def _(t):
    return C.reverse_intersection(t.points, t.points.where("coverage >= 10"), "not_retained", ["sample_id"])


@query("match_removed", "C11", """
    WITH removed AS (SELECT DISTINCT sample_id, chrom, start FROM points WHERE coverage < 10)
    SELECT p.point_id, r.start IS NOT NULL AS is_removed,
           CASE WHEN r.start IS NOT NULL THEN 'coverage_below_10' END AS reason
    FROM points p LEFT JOIN removed r ON r.sample_id = p.sample_id AND r.chrom = p.chrom AND r.start = p.start""")
def _(t):
    return C.match_removed(t.points, C.annotate_removed(t.points, 10), ["sample_id"]) \
        .select("point_id", "is_removed", "reason")


@query("min_length_filter", "C12", """
    SELECT sample_id, tool, count(*) FILTER ("end" - start >= 10000) AS n_kept,
           count(*) FILTER ("end" - start < 10000) AS n_excluded FROM regions GROUP BY ALL""")
def _(t):
    return C.min_length_filter(t.regions, 10_000, ["sample_id", "tool"])[1]


@query("sort_by_chrom_order", "C13", """
    SELECT region_id, CAST(substr(chrom, 4) AS INTEGER) AS rank FROM regions ORDER BY rank, start, "end", region_id""")
def _(t):
    return C.sort_by_chrom_order(t.regions, "region_id").select("region_id", chrom_rank("chrom").alias("rank"))


@query("patient_and_label", "C14, C15", """
    SELECT sample, substr(sample, 1, 12) AS patient_id,
           CASE WHEN sample_type = 'Solid Tissue Normal' THEN 'Normal' ELSE 'Tumor' END AS binary_label FROM samples""")
def _(t):
    return C.labelled_samples(t.samples).select("sample", "patient_id", "binary_label")


@query("duplicate_ids", "C15", """
    SELECT patient_id, n FROM (SELECT substr(sample, 1, 12) AS patient_id, count(*) AS n FROM samples GROUP BY ALL)
    WHERE n > 1""")
def _(t):
    return C.duplicate_ids(C.labelled_samples(t.samples), "patient_id")


@query("downsample", "C16", f"""
    SELECT sample_id, point_id FROM (
        SELECT sample_id, point_id, row_number() OVER (PARTITION BY sample_id ORDER BY {md5_sql(7, 'point_id')}) AS k FROM points)
    WHERE k <= 500""")
def _(t):
    return C.downsample(t.points, 500, ["point_id"], seed=7, part=["sample_id"]).select("sample_id", "point_id")


@query("map_tools", "C17", """
    SELECT r.region_id, concat('tool_', r.tool) AS tool_id, concat('Tool ', r.tool) AS label,
           5 - CAST(r.tool AS INTEGER) AS rank_order FROM regions r WHERE r.tool <> '5'""")
def _(t):
    dims = t.spark.createDataFrame([(str(i), f"tool_{i}", f"Tool {i}", 5 - i) for i in range(1, 5)],
                                   "raw string, tool_id string, label string, rank_order int")
    return C.map_tools(t.regions, dims).select("region_id", "tool_id", "label", "rank_order")


@query("tag_intervals", "C19", """
    SELECT sample_id, tool, chrom, start, "end", "end" - start AS len,
           concat('R', CAST(row_number() OVER (PARTITION BY sample_id, tool ORDER BY chrom, start, "end") AS VARCHAR)) AS id
    FROM regions""")
def _(t):
    return C.tag_intervals(t.regions, ["sample_id", "tool"], "R")


@query("eligible_manifest", "C20", """
    SELECT *, concat_ws('/', 'arrays', project_id, methylation_file) AS array_path FROM samples
    WHERE project_descriptor IS NOT NULL AND methylation_file IS NOT NULL""")
def _(t):
    return C.eligible_manifest(t.samples, "arrays")


@query("window_of_track", "C21, C18", """
    SELECT point_id, start, CASE WHEN beta < 0.2 THEN 'low' WHEN beta <= 0.7 THEN 'intermediate' ELSE 'high' END AS meth_class
    FROM beta_points WHERE chrom = 'chr3' AND start BETWEEN 100000 AND 1500000""")
def _(t):
    C.validate_layout(5_000, 10_000, 1_000)
    return C.window_of_track(t.beta_points, "chr3", 100_000, 1_500_000).select("point_id", "start", "meth_class")


@query("scalar_labels", "R1", """
    SELECT region_id, CAST(concat('0x', substr(sha256(concat('42:', CAST(region_id AS VARCHAR))), 1, 8)) AS BIGINT) AS seed,
           CASE WHEN "end" - start >= 1000 THEN concat(CAST(("end" - start) // 1000 AS VARCHAR), 'kb+')
                ELSE concat(CAST("end" - start AS VARCHAR), 'bp') END AS label
    FROM regions""")
def _(t):
    n = F.col("end") - F.col("start")
    whole = bp_label(n - n % 1000)
    label = F.when(n >= 1000, F.concat(whole, F.lit("+"))).otherwise(bp_label(n))
    return t.regions.select("region_id", stable_seed(42, "region_id").alias("seed"), label.alias("label"))
