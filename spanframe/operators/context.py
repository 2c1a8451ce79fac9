"""Context features of points, states, and regions made from states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanframe.functions import HIGH_CUTOFF, LOW_CUTOFF, safe_divide
from spanframe.operators.points import region_point_summary
from spanframe.operators.ranges import label_points, merge_intervals
from spanframe.operators.scan import TILE_SHIFT, prefix_scan

SAMPLE = ("sample_id",)

# Cut-offs of the rule-based states (the last three for windows of 500 kb).
RULE_CUTOFFS = {"beta_low_max": 0.28953450344841725, "beta_high_min": 0.694195675252982,
                "int_min": 0.5604250370335937, "std_max": 0.26418485236146244, "high_max": 0.2462720810967043}
# Fixed value: above it a point counts as high; the intermediate band ends at HIGH_CUTOFF.
SURELY_HIGH = 0.8


def context_features(points: DataFrame, windows: Sequence[int], keys: Sequence[str] = SAMPLE, low: float = LOW_CUTOFF,
                     int_high: float = HIGH_CUTOFF, high: float = SURELY_HIGH, value: str = "beta") -> DataFrame:
    """Per position: its value and, per window size, the number, mean, std and
    shares of high (over ``high``) and intermediate (``low`` to ``int_high``)
    points within half a window either side. Values lie between 0 and 1.

    Rows go to tiles of four windows or more, and within half a window of an edge to
    the tile beyond it too: one exchange of narrow rows. There a window's sums are the
    running sums up to its end less those before its start, so the work follows the
    number of positions whatever the window. Sums are whole numbers, so a difference
    of two is the sum of what lies between: values with 15 places in two parts, and
    values of 11 places with their squares in three, for the spread (33 million points
    of one tile fit).
    """
    part = [*keys, "chrom"]
    v = F.col(value)
    fine, coarse = F.round(v * 1e15).cast("bigint"), F.round(v * 1e11).cast("bigint")
    high_part, low_part = F.shiftright(coarse, 19), coarse.bitwiseAND((1 << 19) - 1)
    sums = {"n": F.count(v), "sh": F.sum(F.shiftright(fine, 25)), "sl": F.sum(fine.bitwiseAND((1 << 25) - 1)), "q": F.sum(coarse),
            "aa": F.sum(high_part * high_part), "ab": F.sum(high_part * low_part), "bb": F.sum(low_part * low_part),
            "nh": F.count_if(v > high), "ni": F.count_if((v >= low) & (v <= int_high))}
    zero = F.lit(0).cast("bigint")
    reach = max(w // 2 for w in windows)
    shift = max(TILE_SHIFT, (8 * reach).bit_length())
    tiles = F.sequence(F.shiftright(F.col("start") - reach, shift), F.shiftright(F.col("start") + reach, shift))
    tiled = points.select(*part, F.col("start").cast("bigint").alias("start"), v.alias(value)).select("*", F.explode_outer(tiles).alias("_tile"))
    # narrow rows become wide ones: a number of tasks that grows with the input, and that is not coalesced by the size of narrow rows
    tiled = tiled.repartition(max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8 * points.rdd.getNumPartitions()), *part, "_tile")
    packed = tiled.groupBy(*part, "_tile", "start").agg(*[F.coalesce(x, zero).alias(c) for c, x in sums.items()], F.sum(v).alias("_sum"))
    # a row for each position and, for each window, one just before it (of sign -1) and one just after it
    marks = [(0, F.lit(1), F.lit(None).cast("int"), 0)] + [(at, F.lit(0), F.lit(w), sign) for w in windows for at, sign in ((-(w // 2), -1), (w // 2 + 1, 1))]
    rows = F.array(*[F.struct((F.col("start") + at).alias("pos"), own.alias("own"), w.cast("int").alias("w"), F.lit(sign).alias("sign")) for at, own, w, sign in marks])
    sofar = Window.partitionBy(*part, "_tile").orderBy("pos", "own").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    asked = packed.select("*", F.explode(rows).alias("m")).select(*packed.columns, "m.*").select(
        *part, "_tile", "start", "own", "w", "sign", "n", "_sum", *[F.sum(F.col(c) * F.col("own")).over(sofar).alias(f"{c}_sofar") for c in sums])
    mine = asked.where(F.col("_tile").eqNullSafe(F.shiftright("start", shift)))
    inside = mine.groupBy(*part, "_tile", "start").agg(
        F.max("n").alias("n"), F.max("_sum").alias("_sum"), *[F.sum(F.when(F.col("w") == w, F.col(f"{c}_sofar") * F.col("sign"))).alias(f"{c}_{w}") for w in windows for c in sums])
    out = [F.try_divide(F.col("_sum"), F.col("n")).alias(value)]
    for w in windows:
        n, sh, sl, q, aa, ab, bb = (F.col(f"{c}_{w}").cast("double") for c in ("n", "sh", "sl", "q", "aa", "ab", "bb"))
        mean, rough = safe_divide((sh * float(1 << 25) + sl) / 1e15, n), safe_divide(q, n)
        squares = aa * float(1 << 38) + ab * float(1 << 20) + bb
        spread = F.sqrt(F.greatest(safe_divide(squares, n) - rough * rough, F.lit(0.0))) / 1e11
        out += [F.col(f"n_{w}"), mean.alias(f"mean_{w}"), spread.alias(f"std_{w}"),
                safe_divide(F.col(f"nh_{w}"), n).alias(f"fraction_high_{w}"),
                safe_divide(F.col(f"ni_{w}"), n).alias(f"fraction_intermediate_{w}")]
    return inside.select(*part, "start", *out)


def states_by_rule(features: DataFrame, window: int, cutoffs: dict | None = None, value: str = "beta") -> DataFrame:
    """Low, high, partial (many intermediate neighbours, low spread, few high) or other."""
    c = {**RULE_CUTOFFS, **(cutoffs or {})}
    partial = ((F.col(f"fraction_intermediate_{window}") >= c["int_min"]) & (F.col(f"std_{window}") <= c["std_max"])
               & (F.col(f"fraction_high_{window}") <= c["high_max"]))
    return features.withColumn("state", F.when(partial, "partial").when(F.col(value) <= c["beta_low_max"], "low")
                               .when(F.col(value) >= c["beta_high_min"], "high").otherwise("other"))


def states_by_cluster(features: DataFrame, columns: Sequence[str], k: int = 4, components: int = 2, seed: int = 42) -> DataFrame:
    """k-means states over scaled principal components, numbered by mean value so
    that the numbers do not depend on the initialisation order."""
    usable = features.na.drop(subset=list(columns))
    pipeline = Pipeline(stages=[
        VectorAssembler(inputCols=list(columns), outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True),
        PCA(k=components, inputCol="_scaled", outputCol="_pcs"),
        KMeans(k=k, seed=seed, featuresCol="_pcs", predictionCol="_cluster")])
    assigned = pipeline.fit(usable).transform(usable).drop("_raw", "_scaled", "_pcs")
    means = assigned.groupBy("_cluster").agg(F.avg(columns[0]).alias("_m"))
    ranks = means.withColumn("state", F.row_number().over(Window.orderBy("_m", "_cluster")) - 1)  # k rows
    return assigned.join(F.broadcast(ranks.select("_cluster", "state")), "_cluster").drop("_cluster")


def states_to_regions(states: DataFrame, names: Sequence[str], keys: Sequence[str] = SAMPLE, min_points: int = 5,
                      width: int = 2) -> DataFrame:
    """Runs of equal state over consecutive positions, with at least ``min_points``;
    a run ends ``width`` (the length of a point) after its last position.

    A run is identified by how many positions of *other* states come before it,
    which needs running counts only. ``states`` has one row per position.
    """
    part = [*keys, "chrom"]
    counted = states.select(*part, F.col("start").alias("pos"), "state",
                            *[(F.col("state") == n).cast("bigint").alias(f"is_{i}") for i, n in enumerate(names)])
    scanned = prefix_scan(counted, part, sums=[f"is_{i}" for i in range(len(names))])
    others = sum((F.when(F.col("state") != n, F.col(f"is_{i}_before")).otherwise(0) for i, n in enumerate(names)), F.lit(0))
    return (scanned.groupBy(*part, "state", others.alias("_run"))
            .agg(F.min("pos").alias("start"), (F.max("pos") + width).alias("end"), F.count("*").alias("n_points"))
            .where(F.col("n_points") >= min_points).drop("_run"))


def clean_regions(regions: DataFrame, points: DataFrame, min_points: int = 6, min_length: int = 5_000,
                  merge_gap: int = 100_000, keys: Sequence[str] = SAMPLE) -> DataFrame:
    """Merge over gaps, then keep regions that are long enough and hold enough points."""
    merged = merge_intervals(regions, keys, merge_gap).where(F.col("end") - F.col("start") >= min_length)
    return region_point_summary(merged, points, keys, ()).where(F.col("point_count") >= min_points)


def point_states(points: DataFrame, regions: DataFrame, keys: Sequence[str] = SAMPLE) -> DataFrame:
    """1 for points whose start lies in a region, its end included, else 0."""
    merged = merge_intervals(regions, keys).withColumn("_in", F.lit(1))
    return label_points(points, merged, keys, ["_in"], closed=True).withColumn("state", F.coalesce("_in", F.lit(0))).drop("_in")
