"""Cleaning, projection and filtering of interval and point tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanframe.functions import (beta_class, beta_value, chrom_rank, clip, key_hash,
                                 normalize_chrom, patient_id, sample_label)
from spanframe.operators.ranges import depth_segments, merge_intervals
from spanframe.operators.scan import ranked, tile_of

# Other names of the coordinate columns.
ALIASES = {
    "chrom": ("chrom", "chr", "CpG_chrm", "chromosome"),
    "start": ("start", "CpG_beg", "chromStart", "beg"),
    "end": ("end", "CpG_end", "chromEnd"),
}


def canonical_columns(df: DataFrame) -> DataFrame:
    """Rename coordinate aliases to chrom, start, end."""
    for name, aliases in ALIASES.items():
        found = next((a for a in aliases if a in df.columns), None)
        if found is None:
            raise ValueError(f"no {name} column among {df.columns}")
        df = df.withColumnRenamed(found, name)
    return df


def clean_intervals(df: DataFrame, chroms: Sequence[str] | None = None) -> DataFrame:
    """Cast, drop nulls, clip start at 0, drop empty rows, add ``length``."""
    out = (canonical_columns(df)
           .withColumn("start", F.col("start").try_cast("bigint"))
           .withColumn("end", F.col("end").try_cast("bigint"))
           .na.drop(subset=["chrom", "start", "end"])
           .withColumn("start", F.greatest("start", F.lit(0).cast("bigint")))
           .where("end > start"))
    if chroms is not None:
        out = out.where(F.col("chrom").isin(list(chroms)))
    return out.withColumn("length", F.col("end") - F.col("start"))


def clip_to_genome(df: DataFrame, sizes: DataFrame, keys: Sequence[str] = (), merge: bool = False) -> DataFrame:
    """Keep known chroms, clip to [0, size]; optionally merge."""
    clipped = (df.join(sizes.select("chrom", F.col("size").alias("_size")), "chrom")
               .withColumn("start", F.greatest("start", F.lit(0).cast("bigint")))
               .withColumn("end", F.least("end", "_size")).where("end > start").select(*df.columns))
    return merge_intervals(clipped, keys) if merge else clipped


def canonical_only(df: DataFrame, column: str = "chrom") -> DataFrame:
    return df.withColumn(column, normalize_chrom(column)).where(F.col(column).isNotNull())


def finalize_points(df: DataFrame) -> DataFrame:
    """Numeric casts, drop invalid rows, clip meth to [0, coverage]."""
    numeric = ["start", "end", "meth", "coverage"]
    return (df.withColumns({c: F.col(c).try_cast("bigint") for c in numeric})
            .na.drop(subset=["chrom", *numeric])
            .where("start >= 0 AND end > start AND coverage >= 0")
            .withColumn("meth", clip("meth", 0, F.col("coverage")).cast("bigint")))


def add_beta(df: DataFrame, zero_coverage: str = "null") -> DataFrame:
    """``beta = meth / coverage``; zero coverage: ``null``, ``zero`` or ``drop``."""
    if zero_coverage not in ("null", "zero", "drop"):
        raise ValueError(f"zero_coverage: {zero_coverage!r}")
    out = df.withColumn("beta", beta_value(zero_coverage=zero_coverage))
    return out.where(F.col("beta").isNotNull()) if zero_coverage == "drop" else out


def validate_beta(df: DataFrame, on_bad: str = "raise", column: str = "beta") -> DataFrame:
    """Values outside [0, 1] raise while the query runs, or are filtered out."""
    ok = F.col(column).isNull() | F.col(column).between(0.0, 1.0)
    if on_bad == "filter":
        return df.where(ok)
    message = F.concat(F.lit("value outside [0, 1]: "), F.col(column).cast("string"))
    return df.withColumn(column, F.when(ok, F.col(column)).otherwise(F.raise_error(message).cast("double")))


def collapse_duplicates(df: DataFrame, keys: Sequence[str] = (), column: str = "beta", strict: bool = False) -> DataFrame:
    """One row per coordinate with the mean value; ``strict`` raises on conflicts."""
    coords = [*keys, "chrom", "start", "end"]
    if not strict:
        return df.groupBy(*coords).agg(F.avg(column).alias(column))
    low, high = F.min(column), F.max(column)
    return df.groupBy(*coords).agg(
        F.when(low.eqNullSafe(high), low)
        .otherwise(F.raise_error(F.lit("conflicting values at one coordinate")).cast("double")).alias(column))


def disjoint_check(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per key: deepest overlap and whether the intervals are disjoint."""
    deepest = F.max("depth").alias("max_depth")
    pieces = depth_segments(df, keys)
    out = pieces.groupBy(*keys).agg(deepest) if keys else pieces.agg(deepest)
    return out.withColumn("is_disjoint", F.col("max_depth") <= 1)


def removal_reason(coverage: Column | str = "coverage", min_coverage: int = 10) -> Column:
    c = F.col(coverage) if isinstance(coverage, str) else coverage
    return (F.when(c.isNull(), "missing_coverage").when(c <= 0, "zero_coverage")
            .when(c < min_coverage, f"coverage_below_{min_coverage}").otherwise("kept"))


def annotate_removed(points: DataFrame, min_coverage: int = 10) -> DataFrame:
    """Removed points with the reason."""
    return points.withColumn("reason", removal_reason(min_coverage=min_coverage)).where("reason <> 'kept'")


def reverse_intersection(source: DataFrame, retained: DataFrame, reason: str, keys: Sequence[str] = ()) -> DataFrame:
    """Coordinates of ``source`` that ``retained`` lacks, once each, with the reason."""
    coords = [*keys, "chrom", "start", "end"]
    return (source.select(*coords).distinct().join(retained.select(*coords), coords, "left_anti")
            .withColumn("reason", F.lit(reason)))


def match_removed(points: DataFrame, removed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Each point with a removed flag and its reason (the first by name, if several)."""
    coords = [*keys, "chrom", "start", "end"]
    one = removed.groupBy(*coords).agg(F.min("reason").alias("reason"))
    return points.join(one, coords, "left").withColumn("is_removed", F.col("reason").isNotNull())


def min_length_filter(df: DataFrame, bp: int, keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows of at least ``bp``, kept and excluded counts per key)."""
    long_enough = F.col("end") - F.col("start") >= bp
    counts = df.groupBy(*keys).agg(F.count_if(long_enough).alias("n_kept"),
                                   F.count_if(~long_enough).alias("n_excluded"))
    return df.where(long_enough), counts


def sort_by_chrom_order(df: DataFrame, *then: str) -> DataFrame:
    """Canonical chromosome order, then start and end: a range-partitioned sort."""
    return df.orderBy(chrom_rank("chrom"), "chrom", "start", "end", *then)


def labelled_samples(samples: DataFrame) -> DataFrame:
    """Patient id and Normal/Tumor label; a bad barcode raises."""
    return (samples.withColumn("patient_id", patient_id("sample"))
            .withColumn("binary_label", sample_label("sample_type")))


def duplicate_ids(df: DataFrame, column: str = "sample") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(df: DataFrame, column: str) -> DataFrame:
    """``df`` if ``column`` is unique; otherwise the query raises when it runs."""
    checked = df.groupBy(column).agg(F.count("*").alias("_n")).select(
        column, F.when(F.col("_n") == 1, F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit("duplicate id: "), F.col(column).cast("string"))).cast("boolean")).alias("_ok"))
    return df.join(checked, column).where("_ok").select(*df.columns)


def downsample(df: DataFrame, n: int, key: Sequence[str], seed: int = 0, part: Sequence[str] = ()) -> DataFrame:
    """Exactly min(n, rows) rows per ``part``, chosen by a hash of the row's key.

    A histogram over 65,536 hash blocks, counted map side, tells the block in which
    the n-th row falls; only rows up to that block are shuffled and ranked, about
    n and not the table.
    """
    part = list(part)
    hashed = df.withColumn("_h", key_hash(seed, *key)).withColumn("_b", F.substring("_h", 1, 4))
    running = Window.partitionBy(*part).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = hashed.groupBy(*part, "_b").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(running), F.lit(0)))
    needed = blocks.where(F.col("_before") < n)
    if part:
        near = hashed.join(F.broadcast(needed.groupBy(*part).agg(F.max("_b").alias("_cut"))), part)  # one row a part: the table itself is not shuffled by it
    else:
        near = hashed.crossJoin(F.broadcast(needed.agg(F.max("_b").alias("_cut"))))  # one row
    near = near.where(F.col("_b") <= F.col("_cut"))
    return ranked(near, part, ["_h"], block="_b", name="_rank").where(F.col("_rank") <= n).select(*df.columns)


def map_tools(df: DataFrame, mapping: DataFrame, raw: str = "tool") -> DataFrame:
    """Canonical id, label and rank from a (raw, tool_id, label, rank_order)
    dimension table; unknown tools are dropped. Rows keep no order: sort the
    report by ``rank_order`` where it is shown."""
    return df.join(mapping.withColumnRenamed("raw", raw), raw)


def tag_intervals(df: DataFrame, keys: Sequence[str] = (), prefix: str = "T", first: int = 1) -> DataFrame:
    """String ids ``T1, T2, ...`` in (chrom, start, end) order per key, and ``len``.

    Equal rows are counted first and expanded again after numbering, so copies
    of one interval never meet in a window; blocks are (chrom, tile).
    """
    keys = list(keys)
    coords = df.groupBy(*keys, "chrom", "start", "end").agg(F.count("*").alias("_n")) \
        .withColumn("_block", F.struct(F.col("chrom"), tile_of("start").alias("tile")))
    up_to_here = Window.unboundedPreceding
    across = Window.partitionBy(*keys).orderBy("_block").rowsBetween(up_to_here, -1)
    within = Window.partitionBy(*keys, "_block").orderBy("start", "end").rowsBetween(up_to_here, -1)
    offsets = coords.groupBy(*keys, "_block").agg(F.sum("_n").alias("_s")) \
        .select(*keys, "_block", F.coalesce(F.sum("_s").over(across), F.lit(0)).alias("_offset"))
    numbered = coords.withColumn("_w", F.coalesce(F.sum("_n").over(within), F.lit(0))) \
        .join(offsets, [*keys, "_block"]).withColumn("_first", F.col("_offset") + F.col("_w") + first)
    return (numbered.withColumn("_id", F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_n") - 1)))
            .select(*keys, "chrom", "start", "end", F.concat(F.lit(prefix), F.col("_id").cast("string")).alias("id"),
                    (F.col("end") - F.col("start")).alias("len")))


def eligible_manifest(samples: DataFrame, root: str) -> DataFrame:
    """Samples usable for segmentation: barcode and project prefixes, no missing
    descriptor or file; duplicate ids raise; adds the derived array path."""
    kept = samples.where(
        F.col("sample").startswith("TCGA-") & F.col("project_id").startswith("TCGA-")
        & F.col("project_descriptor").isNotNull() & F.col("methylation_file").isNotNull())
    return require_unique(kept, "sample").withColumn(
        "array_path", F.concat_ws("/", F.lit(root), F.col("project_id"), F.col("methylation_file")))


def window_of_track(points: DataFrame, chrom: str, low: int, high: int, column: str = "beta") -> DataFrame:
    """Points of a position range, with the low/intermediate/high class."""
    return (points.where((F.col("chrom") == chrom) & F.col("start").between(low, high))
            .withColumn("meth_class", beta_class(column)))


def validate_layout(flank_bp: int, body_bp: int, bin_bp: int) -> int:
    """Bins per profile; flank and body must be whole numbers of bins."""
    if bin_bp <= 0 or flank_bp < 0 or body_bp <= 0:
        raise ValueError("bin and body must be positive, flank not negative")
    if flank_bp % bin_bp or body_bp % bin_bp:
        raise ValueError(f"flank {flank_bp} and body {body_bp} must be multiples of the bin {bin_bp}")
    return (2 * flank_bp + body_bp) // bin_bp


