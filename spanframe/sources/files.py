"""Readers and writers of the interval file layouts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.functions import AUTOSOMES, CANONICAL_CHROMS, half_even, safe_divide

BED = "chrom STRING, start BIGINT, `end` BIGINT"
BEDGRAPH = BED + ", value DOUBLE"
SIZES = "chrom STRING, size BIGINT"

# Column layouts of region files, by layout name.
REGION_LAYOUTS = {
    "bed3": BED,
    "bed4": BED + ", label STRING",
    "bed6": BED + ", label STRING, score DOUBLE, strand STRING",
    "stats7": BED + ", num_cpgs BIGINT, meth DOUBLE, std DOUBLE, category STRING",
}


def _tsv(spark: SparkSession, paths, schema: str, header: bool = False) -> DataFrame:
    return (spark.read.schema(schema).option("sep", "\t").option("header", header)
            .option("recursiveFileLookup", True).csv(paths))


def read_bed(spark: SparkSession, path) -> DataFrame:
    """First three columns of headerless BED; extra columns are never parsed."""
    return _tsv(spark, path, BED)


def read_bedgraph(spark: SparkSession, path) -> DataFrame:
    return _tsv(spark, path, BEDGRAPH)


def read_chrom_sizes(spark: SparkSession, path, canonical_only: bool = True) -> DataFrame:
    sizes = _tsv(spark, path, SIZES)
    return sizes.where(F.col("chrom").isin(CANONICAL_CHROMS)) if canonical_only else sizes


def read_tool_regions(spark: SparkSession, registry: Sequence[dict]) -> DataFrame:
    """All tools' region files as (sample_id, tool, chrom, start, end).

    One scan per layout family, not per file: ``registry`` rows are dicts with
    tool, layout, header, path (a folder of ``<sample>.*`` files per tool) and,
    optionally, the category to keep.
    """
    out = None
    for row in registry:
        rows = _tsv(spark, row["path"], REGION_LAYOUTS[row["layout"]], row.get("header", False))
        if row.get("category"):
            rows = rows.where(F.col("category") == row["category"])
        part = rows.select(
            F.regexp_extract(F.col("_metadata.file_path"), r"/sample_id=([^/]+)/", 1).alias("sample_id"),
            F.lit(row["tool"]).alias("tool"), "chrom", "start", "end")
        out = part if out is None else out.unionByName(part)
    return out


def read_wgbs(spark: SparkSession, path) -> DataFrame:
    """Points from 5-column (coverage, percent) or 6-column (beta, coverage,
    context) text, gzip or plain; any other width raises."""
    f = F.split("value", "\t")
    width = F.size(f)
    fields = spark.read.text(path).select(f.alias("f"), width.alias("w"))

    def at(i, kind):
        return F.get("f", F.lit(i)).try_cast(kind)

    coverage = F.when(F.col("w") == 5, at(3, "bigint")).when(F.col("w") == 6, at(4, "bigint")).otherwise(
        F.raise_error(F.concat(F.lit("expected 5 or 6 columns, got "), F.col("w").cast("string"))).cast("bigint"))
    meth = F.when(F.col("w") == 5, half_even(at(4, "double") / 100.0 * at(3, "bigint"))) \
        .otherwise(half_even(at(3, "double") * at(4, "bigint")))
    return (fields.select(F.get("f", F.lit(0)).alias("chrom"), at(1, "bigint").alias("start"),
                          at(2, "bigint").alias("end"), meth.alias("meth"), coverage.alias("coverage"))
            .where(F.col("chrom").isin(CANONICAL_CHROMS)))


def read_sample_table(spark: SparkSession, path, projects: Sequence[str] | None = None) -> DataFrame:
    """Sample manifest with header; optionally only some projects."""
    samples = spark.read.option("header", True).option("sep", "\t").csv(path)
    for old, new in (("sample_id", "sample"), ("project", "project_id")):
        if old in samples.columns and new not in samples.columns:
            samples = samples.withColumnRenamed(old, new)
    return samples.where(F.col("project_id").isin(list(projects))) if projects else samples


def load_matrix(arrays: DataFrame, probes: DataFrame, check_length: bool = False) -> DataFrame:
    """Long sample x point table: values by probe position, 255 is missing, 0..100 -> 0..1.

    ``check_length`` raises for a sample whose number of values is not the
    number of probes.
    """
    if check_length:
        n = probes.agg(F.count("*").alias("_probes"))
        counted = arrays.groupBy("sample_id").agg(F.count("*").alias("_n")).crossJoin(F.broadcast(n))  # one row
        ok = counted.select("sample_id", F.when(F.col("_n") == F.col("_probes"), True).otherwise(
            F.raise_error(F.concat(F.lit("array length differs for "), F.col("sample_id"))).cast("boolean")).alias("_ok"))
        arrays = arrays.join(ok, "sample_id").where("_ok").drop("_ok")
    # the file of the probes tells too little of their size: they grow too, so they are not broadcast by it
    return (arrays.join(probes.hint("merge"), "probe_idx")
            .select("sample_id", "chrom", "start", "end", "probe",
                    F.when(F.col("raw") != 255, F.col("raw") / 100.0).alias("beta")))


def read_for_chrom(spark: SparkSession, path: str, chrom: str) -> DataFrame:
    """One chromosome of a track saved with ``partitionBy('chrom')``: only its files are read."""
    return spark.read.parquet(path).where(F.col("chrom") == chrom)


def collect_outputs(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Stack the header TSVs of all ``task=<key>`` folders below ``root``, tagged with the task."""
    rows = (spark.read.schema(schema).option("header", True).option("sep", "\t")
            .option("recursiveFileLookup", True).csv(root))
    return rows.withColumn("task", F.regexp_extract(F.col("_metadata.file_path"), r"/task=([^/]+)/", 1))


def collect_task_tables(spark: SparkSession, root: str, schemas: dict[str, str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables by name, one row a task) of folders ``<name>/task=<key>`` below ``root``.

    Each table is stacked over its tasks and tagged with them; the summary counts
    the rows of every table. A task that lacks a table raises when it is read.
    """
    tables = {name: collect_outputs(spark, f"{root}/{name}", schema) for name, schema in schemas.items()}
    counted = None
    for name, df in tables.items():
        rows = df.groupBy("task").agg(F.count("*").alias("n")).withColumn("table", F.lit(name))
        counted = rows if counted is None else counted.unionByName(rows)
    wide = counted.groupBy("task").agg(*[F.max(F.when(F.col("table") == k, F.col("n"))).alias(f"n_{k}_rows") for k in schemas])
    checked = [F.coalesce(f"n_{k}_rows", F.raise_error(F.concat(F.lit(f"missing {k} of task "), F.col("task"))).cast("bigint")).alias(f"n_{k}_rows") for k in schemas]
    return tables, wide.select("task", *checked)


def rows_per_task(outputs: DataFrame) -> DataFrame:
    return outputs.groupBy("task").agg(F.count("*").alias("n_rows"))


def write_table(df: DataFrame, path: str, header: bool = False, partition_by: Sequence[str] = (),
                gzip: bool = False) -> str:
    """Tab-separated text (BED, bedGraph, report tables)."""
    writer = df.write.mode("overwrite").option("sep", "\t").option("header", header)
    if gzip:
        writer = writer.option("compression", "gzip")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path)
    return path


def write_track(df: DataFrame, path: str, by: Sequence[str] = ("chrom",)) -> str:
    """Parquet by chromosome, sorted by position so row-group statistics prune ranges."""
    (df.repartitionByRange(*by, "start").sortWithinPartitions(*by, "start")
     .write.mode("overwrite").partitionBy(*by).parquet(path))
    return path


def export_tracks(tracks: DataFrame, path: str) -> DataFrame:
    """Write (sample_id, track, chrom, start, end) partitioned by both, and return
    the track manifest with region counts."""
    tracks.write.mode("overwrite").partitionBy("sample_id", "track").parquet(path)
    return tracks.sparkSession.read.parquet(path).groupBy("sample_id", "track").agg(F.count("*").alias("n_regions"))


def write_shards(df: DataFrame, path: str, key: str = "sample_id") -> str:
    """One shard per key; rerunning a key replaces only its own shard."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path))
    return path


def finalize_shards(spark: SparkSession, path: str, manifest: DataFrame, key: str = "sample_id") -> DataFrame:
    """Merged shards plus a status row for every manifest key without one."""
    shards = spark.read.parquet(path).withColumn("status", F.lit("ok"))
    missing = manifest.select(key).distinct().join(shards.select(key).distinct(), key, "left_anti") \
        .withColumn("status", F.lit("missing_shard"))
    return shards.unionByName(missing, allowMissingColumns=True)


# ------------------------------------------------- layouts other tools expect

def point_level_layout(points: DataFrame) -> DataFrame:
    """(chrom, pos, strand, context, level, coverage); zero coverage has level 0."""
    level = F.coalesce(safe_divide("meth", "coverage"), F.lit(0.0))
    return points.select("chrom", F.col("start").alias("pos"), F.lit("+").alias("strand"),
                         F.lit("CpG").alias("context"), level.alias("level"), "coverage")


def one_based_counts_layout(points: DataFrame) -> DataFrame:
    """(chrom, pos, T, M): 1-based, autosomes, covered points only."""
    return (points.where(F.col("chrom").isin(AUTOSOMES) & (F.col("coverage") > 0))
            .select("chrom", (F.col("start") + 1).alias("pos"), F.col("coverage").alias("T"), F.col("meth").alias("M")))


def percent_layout(points: DataFrame) -> DataFrame:
    """(chrom, start, end, percent) of covered points, 0..100."""
    return points.select("chrom", "start", "end", (safe_divide("meth", "coverage") * 100.0).alias("percent")) \
        .where("percent IS NOT NULL")


