"""Interval views over the driver tables (integer arithmetic on whole tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# One text per view, valid in Spark SQL and DuckDB alike: the queries and the
# checking SQL read the same definition.
VIEW_SQL = {
    "points": """
        SELECT translate(l_returnflag, 'ANR', 'FOP') AS sample_id,
               concat('chr', CAST(l_suppkey % 22 + 1 AS {text})) AS chrom,
               CAST(l_partkey * 1000 + l_linenumber * 100 AS BIGINT) AS start,
               CAST(l_partkey * 1000 + l_linenumber * 100 + 2 AS BIGINT) AS {end},
               CAST(floor(l_quantity * l_discount * 10) AS BIGINT) AS meth,
               CAST(l_quantity AS BIGINT) AS coverage,
               CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS point_id
        FROM lineitem""",
    "regions": """
        SELECT o_orderstatus AS sample_id, substr(o_orderpriority, 1, 1) AS tool,
               concat('chr', CAST(o_custkey % 22 + 1 AS {text})) AS chrom,
               CAST((o_orderkey * 131) % 2000000 AS BIGINT) AS start,
               CAST((o_orderkey * 131) % 2000000 + 500 + (o_custkey * 37) % 20000 AS BIGINT) AS {end},
               CAST(o_orderkey AS BIGINT) AS region_id
        FROM orders""",
    "features": """
        SELECT concat('chr', CAST(p_partkey % 22 + 1 AS {text})) AS chrom,
               CAST(p_partkey * 997 AS BIGINT) AS start,
               CAST(p_partkey * 997 + 1000 + p_size * 400 AS BIGINT) AS {end},
               CAST(p_partkey AS BIGINT) AS feature_id
        FROM part""",
    # chromosome sizes: past the last region, feature and point
    "sizes": """
        SELECT chrom, CAST(max(e) + 5000 AS BIGINT) AS size FROM (
            SELECT concat('chr', CAST(l_suppkey % 22 + 1 AS {text})) AS chrom,
                   l_partkey * 1000 + l_linenumber * 100 + 2 AS e FROM lineitem
            UNION ALL
            SELECT concat('chr', CAST(o_custkey % 22 + 1 AS {text})),
                   (o_orderkey * 131) % 2000000 + 500 + (o_custkey * 37) % 20000 FROM orders
            UNION ALL
            SELECT concat('chr', CAST(p_partkey % 22 + 1 AS {text})), p_partkey * 997 + 1000 + p_size * 400 FROM part
        ) AS u GROUP BY chrom""",
    # value track: overlapping rows on purpose
    "signal": """
        SELECT concat('chr', CAST(ps_chrom % 22 + 1 AS {text})) AS chrom, start, {end}, value FROM (
            SELECT c_custkey AS ps_chrom, CAST((c_custkey * 613) % 1500000 AS BIGINT) AS start,
                   CAST((c_custkey * 613) % 1500000 + 800 + (c_custkey * 17) % 3000 AS BIGINT) AS {end},
                   CAST(floor(c_acctbal) AS DOUBLE) / 8 AS value
            FROM customer) AS c""",
    # one array: a value in 0..100 (255 = missing) per sample and probe
    "arrays": """
        SELECT concat('S', CAST(l_suppkey % 40 AS {text})) AS sample_id,
               CAST(l_partkey AS BIGINT) AS probe_idx,
               CASE WHEN l_discount = 0 THEN 255.0 ELSE CAST(floor(l_quantity * l_discount * 20) AS DOUBLE) END AS raw
        FROM lineitem""",
    # probes by position: index -> coordinates
    "probes": """
        SELECT CAST(p_partkey AS BIGINT) AS probe_idx,
               concat('chr', CAST(p_partkey % 3 + 1 AS {text})) AS chrom,
               CAST(p_partkey * 700 AS BIGINT) AS start, CAST(p_partkey * 700 + 1 AS BIGINT) AS {end},
               concat('cg', lpad(CAST(p_partkey AS {text}), 8, '0')) AS probe
        FROM part""",
    # regions called in each sample of the arrays, at loci that samples share
    "cohort_segments": """
        SELECT concat('S', CAST(o_orderkey % 40 AS {text})) AS sample_id,
               concat('chr', CAST((o_orderkey // 40) % 3 + 1 AS {text})) AS chrom,
               CAST((o_custkey % 199 // 4) * 28000 + o_custkey % 199 % 4 * 2800 + o_orderkey % 50 AS BIGINT) AS start,
               CAST((o_custkey % 199 // 4) * 28000 + o_custkey % 199 % 4 * 2800 + o_orderkey % 50 + 300 + (o_orderkey * 37) % 1400 AS BIGINT) AS {end}
        FROM orders""",
    # biological samples of patients, by barcode
    "samples": """
        SELECT concat('TCGA-', 'A', CAST((o_custkey // 10000) % 10 AS {text}), '-',
                      lpad(CAST(o_custkey % 10000 AS {text}), 4, '0'), '-01A-',
                      lpad(CAST(o_orderkey AS {text}), 10, '0')) AS sample,
               CASE WHEN substr(o_orderpriority, 1, 1) = '1' THEN 'Solid Tissue Normal'
                    WHEN substr(o_orderpriority, 1, 1) = '5' THEN 'Metastatic' ELSE 'Primary Tumor' END AS sample_type,
               concat('TCGA-C', CAST(o_custkey % 7 AS {text})) AS project_id,
               CASE WHEN o_orderstatus = 'P' THEN NULL ELSE concat('cohort ', CAST(o_custkey % 7 AS {text})) END
                    AS project_descriptor,
               CASE WHEN o_shippriority_flag THEN NULL ELSE concat('m', CAST(o_orderkey AS {text})) END
                    AS methylation_file
        FROM (SELECT *, (o_orderkey % 9 = 0) AS o_shippriority_flag FROM orders) AS o""",
}

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def spark_text(sql: str) -> str:
    return sql.replace("{text}", "STRING").replace("{end}", "`end`").replace("//", "DIV")


def duck_text(sql: str) -> str:
    return sql.replace("{text}", "VARCHAR").replace("{end}", '"end"')


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view of ``VIEW_SQL`` over the parquet tables of ``sf_dir``."""
    sql = spark_text(VIEW_SQL[name])
    used = {t: table(spark, sf_dir, t) for t in TABLES if f" {t}" in sql}
    for t in used:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(sql, **used)
