"""Exact medians of a few large groups, by counting instead of gathering.

``median`` keeps all distinct values of a group in one buffer. Here rows are first
counted by (group, value), which combines map side and spreads a group over all
tasks (rows that are written already are not: only those of the middle block are
counted by value); then the middle is found in three narrowing steps: by
blocks of values (256 for each doubling), by 4,096 even steps of the block that
holds the middle, and by the values of that step. All groups and all measures take
the same steps, and what a window sorts is a histogram.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanframe.session import materialize

#: Blocks for each doubling of a value, even steps of a block, and a number past all logarithms' blocks.
BLOCKS, STEPS, FAR = 256, 4096, 1_000_000


def _block(value: Column) -> Column:
    """A whole number that never falls as the value rises."""
    size = F.floor(F.log2(F.abs(value)) * BLOCKS) + FAR
    size = F.when(F.abs(value) == float("inf"), F.lit(2 * FAR)).otherwise(size)
    return F.when(value == 0, F.lit(0)).when(value > 0, size).otherwise(-size).cast("bigint")


def _narrow(counts: DataFrame, part: Sequence[str], order: str, *more: Column) -> DataFrame:
    """Of the counts, ordered inside ``part``, those that hold one of the two middle places; ``before`` counts what is left of them."""
    running = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("before", F.col("base") + F.coalesce(F.sum("n").over(running), F.lit(0)))
    low, high = F.expr("(total + 1) DIV 2"), F.expr("total DIV 2 + 1")
    return placed.where((F.col("before") < high) & (F.col("before") + F.col("n") >= low)).select(*part, order, "before", "total", *more)


def _met(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join on columns that may be null; ``right`` gives its other columns."""
    names = {c: f"_r_{c}" for c in on}
    same = [F.col(c).eqNullSafe(F.col(names[c])) for c in on]
    return left.join(right.withColumnsRenamed(names), same).drop(*names.values())


def long_medians(values: DataFrame, keys: Sequence[str], value: str = "value", name: str = "median", written: bool = False) -> DataFrame:
    """(keys, median) of ``value``; nulls are skipped, NaN must not occur, keys may be null. Groups without values are absent.

    ``written``: ``values`` are rows of a written table, which is read twice instead of being shuffled by value. Of such
    rows only those of the blocks that hold the middle are shuffled.
    """
    keys = list(keys)
    v = F.col("_v")
    counts = values.select(*keys, F.col(value).cast("double").alias("_v")).where(v.isNotNull())
    if written:
        counts = counts.withColumn("n", F.lit(1).cast("bigint")).withColumn("_block", _block(v))
    else:
        counts = materialize(counts.groupBy(*keys, "_v").agg(F.count("*").alias("n")).withColumn("_block", _block(v)), "value-counts")
    group = Window.partitionBy(*keys)
    blocks = counts.groupBy(*keys, "_block").agg(F.sum("n").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    blocks = blocks.withColumn("total", F.sum("n").over(group)).withColumn("base", F.lit(0).cast("bigint"))
    chosen = _narrow(blocks, keys, "_block", F.col("_lo"), F.col("_hi"))
    if written:
        middle = _met(counts, materialize(chosen, "middle-blocks"), [*keys, "_block"])
        inside = middle.groupBy(*keys, "_block", "_v", "before", "total", "_lo", "_hi").agg(F.sum("n").alias("n"))
    else:
        inside = _met(counts, chosen, [*keys, "_block"])
    width = F.col("_hi") - F.col("_lo")
    step = F.when((width > 0) & (width < float("inf")), F.floor((v - F.col("_lo")) / width * STEPS)).otherwise(F.lit(0)).cast("bigint")
    inside = materialize(inside.withColumn("_step", step), "middle-block")
    steps = inside.groupBy(*keys, "_block", "_step", "before", "total").agg(F.sum("n").alias("n")).withColumnRenamed("before", "base")
    chosen = _narrow(steps, [*keys, "_block"], "_step").withColumnRenamed("before", "base")
    left = _met(inside.drop("before", "total"), chosen, [*keys, "_block", "_step"])
    found = _narrow(left, [*keys, "_block", "_step"], "_v")
    # one row if both middle places hold one value, else two
    return found.groupBy(*keys).agg(((F.min("_v") + F.max("_v")) / 2).alias(name))


def with_medians(stats: DataFrame, rows: DataFrame, keys: Sequence[str], columns: dict[str, Column], written: bool = False) -> DataFrame:
    """``stats`` (a row per keys) with the median of each of ``columns`` (name -> expression over ``rows``; ``written`` as above)."""
    keys = list(keys)
    entries = F.array(*[F.struct(F.lit(k).alias("_metric"), v.cast("double").alias("value")) for k, v in columns.items()])
    long = rows.select(*keys, F.explode(entries).alias("_e")).select(*keys, "_e.*")
    medians = long_medians(long, [*keys, "_metric"], written=written)
    wide = medians.groupBy(*keys).agg(*[F.max(F.when(F.col("_metric") == k, F.col("median"))).alias(k) for k in columns])
    names = {c: f"_r_{c}" for c in keys}
    same = [F.col(c).eqNullSafe(F.col(names[c])) for c in keys]
    return stats.join(wide.withColumnsRenamed(names), same, "left").drop(*names.values())
