"""The most frequent values of a large table of counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def commonest(counts: DataFrame, value: str, times: str, k: int) -> DataFrame:
    """The ``k`` rows with the largest ``times`` (ties: the smaller ``value``).

    A histogram over steps of a sixteenth of a doubling, at most about a
    thousand rows, says where the cut lies; only rows at or above it are sorted,
    so no task gets every partition's best ``k``. ``counts`` is read twice and
    should be a written table.
    """
    step = F.floor(F.log2(times) * 16).cast("int")
    histogram = sorted(((r["s"], r["n"]) for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()), reverse=True)
    cut, total = 0, 0
    for cut, n in histogram:
        total += n
        if total >= k:
            break
    return counts.where(step >= cut).orderBy(F.desc(times), value).limit(k)
