"""Ordered scans along a coordinate that never put a whole chromosome in one task.

A plain ``Window.partitionBy(chrom).orderBy(pos)`` sends every row of a
chromosome to one task. Here a coordinate axis is cut into tiles of
``2**TILE_SHIFT`` positions and scanned in two steps:

1. inside a tile, with a window. Callers pass one row per position (they
   ``groupBy`` the position first, which combines map side), so a tile never
   holds more than ``2**TILE_SHIFT`` rows, however skewed the input;
2. across tiles, with a window over one summary row per tile. A chromosome of
   250 Mb has about 240 of them.

The tile summary is joined back on (part, tile). Both branches start from the
same exchange, which Spark reuses.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILE_SHIFT = 20
#: A position below all others.
BEFORE_ALL = -(1 << 62)


def tile_of(pos: str, shift: int = TILE_SHIFT) -> Column:
    """Tile number. Never null, so no null filter is pushed below the exchange of
    only one of the two branches, which would keep Spark from reusing it."""
    return F.coalesce(F.shiftright(pos, shift), F.lit(-1).cast("bigint"))


def prefix_scan(df: DataFrame, part: Sequence[str], *, pos: str = "pos",
                sums: Sequence[str] = (), maxes: Sequence[str] = (), later_mins: Sequence[str] = (),
                next_pos: str | None = None, shift: int = TILE_SHIFT, tile: Column | None = None) -> DataFrame:
    """Running values along ``pos``; ``df`` has one row per (part, pos).

    Adds ``<c>_before`` (sum, 0 when none, or max, null when none) over smaller
    positions, ``<c>_after`` (min over larger positions) and, in ``next_pos``,
    the next larger position. ``tile`` replaces the default tile number for
    axes that are not base positions; it must not decrease along ``pos``.
    """
    part = list(part)
    tiled = df.withColumn("_tile", tile_of(pos, shift) if tile is None else tile).repartition(*part, "_tile")

    across = Window.partitionBy(*part).orderBy("_tile")
    within = Window.partitionBy(*part, "_tile").orderBy(pos)
    summary, carried, final = [], [], []
    start, end = Window.unboundedPreceding, Window.unboundedFollowing

    for c in sums:
        summary.append(F.sum(c).alias(f"_t_{c}"))
        carried.append(F.coalesce(F.sum(f"_t_{c}").over(across.rowsBetween(start, -1)), F.lit(0)).alias(f"_c_{c}"))
        final.append((F.col(f"_c_{c}") + F.coalesce(F.col(f"_w_{c}"), F.lit(0))).alias(f"{c}_before"))
    for c in maxes:
        summary.append(F.max(c).alias(f"_t_{c}"))
        carried.append(F.max(f"_t_{c}").over(across.rowsBetween(start, -1)).alias(f"_c_{c}"))
        final.append(F.greatest(f"_c_{c}", f"_w_{c}").alias(f"{c}_before"))
    for c in later_mins:
        summary.append(F.min(c).alias(f"_n_{c}"))
        carried.append(F.min(f"_n_{c}").over(across.rowsBetween(1, end)).alias(f"_cn_{c}"))
        final.append(F.least(f"_cn_{c}", f"_wn_{c}").alias(f"{c}_after"))
    if next_pos:
        summary.append(F.min(pos).alias("_t_first"))
        carried.append(F.lead("_t_first").over(across).alias("_c_first"))
        final.append(F.coalesce("_w_next", "_c_first").alias(next_pos))

    # a column that only one branch reads would be pruned from the other, and the exchange made twice
    extra = [c for c in df.columns if c not in {*part, *sums, *maxes, *later_mins}]
    carry = tiled.groupBy(*part, "_tile").agg(*summary, F.max(F.xxhash64(*extra)).alias("_x")).where("_x IS NOT NULL")
    carry = carry.select(*part, "_tile", *carried)
    local = tiled.select(
        *tiled.columns,
        *[F.sum(c).over(within.rowsBetween(start, -1)).alias(f"_w_{c}") for c in sums],
        *[F.max(c).over(within.rowsBetween(start, -1)).alias(f"_w_{c}") for c in maxes],
        *[F.min(c).over(within.rowsBetween(1, end)).alias(f"_wn_{c}") for c in later_mins],
        *([F.lead(pos).over(within).alias("_w_next")] if next_pos else []),
    )
    return local.join(carry, [*part, "_tile"]).select(*df.columns, *final)


def ranked(df: DataFrame, part: Sequence[str], order: Sequence[str], *, block: str,
           name: str = "rank") -> DataFrame:
    """1-based row number per ``part`` without one window per part.

    ``block`` is a column that cuts a part into ordered, bounded pieces (a tile
    of the sort key, or leading digits of a hash used as the sort key); rows
    are numbered inside a block and shifted by the rows of earlier blocks.
    """
    part = list(part)
    sizes = df.groupBy(*part, block).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*part).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*part, block, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(*part, block).orderBy(*order)
    numbered = df.withColumn("_rn", F.row_number().over(within))
    return (numbered.join(offsets, [*part, block])
            .select(*df.columns, (F.col("_offset") + F.col("_rn")).cast("bigint").alias(name)))


def bracket(queries: DataFrame, targets: DataFrame, part: Sequence[str], *, distinct: bool = False) -> DataFrame:
    """Distinct (part, pos) of ``queries`` with the nearest target position at or
    below (``prev_pos``) and at or above (``next_pos``); null when there is none.

    A target carries the next one, and a mark before the first position the first
    one, so a running maximum tells both sides and no frame reaches to the end of
    its tile. ``distinct``: both sides hold each (part, pos) once already, and are
    dealt by tile without being grouped by position before.
    """
    part = list(part)
    none = F.lit(None).cast("bigint")
    if not distinct:
        queries, targets = queries.select(*part, "pos").distinct(), targets.select(*part, "pos").distinct()
    ahead = prefix_scan(targets.select(*part, "pos"), part, next_pos="u")
    first = targets.groupBy(*part).agg(F.min("pos").alias("u"))
    marks = (queries.select(*part, "pos", none.alias("t"), none.alias("u"), F.lit(1).alias("q"))
             .unionByName(ahead.select(*part, "pos", F.col("pos").alias("t"), "u", F.lit(0).alias("q")))
             .unionByName(first.select(*part, F.lit(BEFORE_ALL).alias("pos"), none.alias("t"), "u", F.lit(0).alias("q"))))
    tiled = marks.withColumn("_tile", tile_of("pos")).repartition(*part, "_tile")
    across = Window.partitionBy(*part).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    # of equal positions the target comes first; at most one row of each kind has a position
    within = Window.partitionBy(*part, "_tile").orderBy("pos", "q").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carry = tiled.groupBy(*part, "_tile").agg(F.max("t").alias("_t"), F.max("u").alias("_u"), F.max(F.xxhash64("pos", "q")).alias("_x")).where("_x IS NOT NULL")
    carry = carry.select(*part, "_tile", F.max("_t").over(across).alias("_ct"), F.max("_u").over(across).alias("_cu"))
    local = tiled.select(*part, "_tile", "pos", "q", F.max("t").over(within).alias("_wt"), F.max("u").over(within).alias("_wu")).where("q = 1")
    low, high = F.greatest("_ct", "_wt"), F.greatest("_cu", "_wu")
    return local.join(carry, [*part, "_tile"]).select(
        *part, "pos", low.alias("prev_pos"), F.when(low == F.col("pos"), low).when(high > F.col("pos"), high).alias("next_pos"))
