"""Registry of named queries: a Spark callable, the operators it shows, and the
SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.operators import ranges
from spanframe.session import materialize, ship_package
from spanframe.sources.tables import VIEW_SQL, duck_text, view


class Tables:
    """The views of one data folder, plus the derived tables most queries start from."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        ship_package(spark)

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEW_SQL:
            self.__dict__[name] = view(self.spark, self.sf_dir, name)
            return self.__dict__[name]
        raise AttributeError(name)

    # written once per instance: most queries read these more than once
    @cached_property
    def merged(self) -> DataFrame:
        return materialize(ranges.merge_intervals(self.regions, ["sample_id", "tool"]), "merged")

    @cached_property
    def merged_features(self) -> DataFrame:
        return materialize(ranges.merge_intervals(self.features), "features")

    @cached_property
    def truth(self) -> DataFrame:
        """Tool 1's merged regions, one truth set per sample."""
        return self.merged.where("tool = '1'").drop("tool")

    @cached_property
    def calls(self) -> DataFrame:
        """The other tools' merged regions."""
        return self.merged.where("tool <> '1'")

    @cached_property
    def beta_points(self) -> DataFrame:
        return self.points.withColumn("beta", F.col("meth") / F.col("coverage"))


@dataclass(frozen=True)
class Query:
    name: str
    ops: str
    run: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, ops: str, sql: str | None = None):
    def add(fn):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, ops, fn, sql)
        return fn
    return add


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round result columns: sums of doubles depend on the order of addition."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --------------------------------------------------------------- SQL library

def merge_sql(source: str, keys: str = "", max_gap: int = 0) -> str:
    part = f"{keys}, chrom" if keys else "chrom"
    return f"""SELECT {part}, min(start) AS start, max("end") AS "end" FROM (
        SELECT *, sum(fresh) OVER (PARTITION BY {part} ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM (
            SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY {part} ORDER BY start, "end"
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {max_gap} THEN 0 ELSE 1 END AS fresh
            FROM {source}) AS m1) AS m2 GROUP BY {part}, island"""


CTE: dict[str, str] = {
    "merged": merge_sql("regions", "sample_id, tool"),
    "merged_features": merge_sql("features"),
    "truth": merge_sql("(SELECT * FROM regions WHERE tool = '1')", "sample_id"),
    "calls": merge_sql("(SELECT * FROM regions WHERE tool <> '1')", "sample_id, tool"),
    "beta_points": "SELECT *, meth / coverage AS beta FROM points",
}


def oracle_text(sql: str) -> str:
    """Prefix the views and library tables a statement names."""
    library = {**{k: duck_text(v) for k, v in VIEW_SQL.items()}, **CTE}
    needed: list[str] = []

    def visit(text: str) -> None:
        # names in FROM / JOIN position only
        for name in re.findall(r"(?:FROM|JOIN|,)\s+(\w+)", text):
            if name in library and name not in needed:
                visit(library[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    head = ",\n".join(f"{n} AS ({library[n]})" for n in needed)
    body = sql.strip()
    if not head:
        return body
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"
