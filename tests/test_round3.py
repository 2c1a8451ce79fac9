"""Shapes that larger tables bring: wide vectors, nearly equal lengths, few regions, tied rows, bins without signal."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from spanframe.functions.draws import gamma_quantiles, gamma_shape
from spanframe.llm import toxicity
from spanframe.llm.ngram_join import similar_groups
from spanframe.operators import cleaning as C
from spanframe.operators import cohort as M
from spanframe.operators import context as G
from spanframe.operators import fold_features as FF
from spanframe.operators import ranking as W
from spanframe.plans.interval_queries import DISTINCT_POINTS
from spanframe.plans.registry import merge_sql
from tools.check_sql import compare, connect


def test_components_over_more_features_than_a_covariance_holds(spark):
    n, width = 5, 66_000
    x = np.random.default_rng(3).random((n, width))
    x[:, 7] = 0.5  # no spread
    rows = spark.createDataFrame([(f"s{i}", [float(v) for v in row]) for i, row in enumerate(x)], "sample_id string, features array<double>")
    out, ratios = M.sample_pca(rows)
    spread = x.std(0)
    z = (x - x.mean(0)) / np.where(spread > 0, spread, 1)
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    for r in out.collect():
        assert np.allclose([abs(r.pc1), abs(r.pc2)], abs(u[int(r.sample_id[1:]), :2] * s[:2]))
    assert np.allclose(ratios, (s ** 2 / (s ** 2).sum())[:2])


def test_wide_components_drop_empty_features_and_raise_on_missing_values(spark):
    rows = spark.createDataFrame([("a", [1.0, None, 2.0, 4.0]), ("b", [2.0, None, 1.0, 3.0]), ("c", [4.0, None, 0.0, 3.5])], "sample_id string, features array<double>")
    z = np.array([[1, 2, 4], [2, 1, 3], [4, 0, 3.5]])
    z = (z - z.mean(0)) / z.std(0)
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    got = {r.sample_id: abs(r.pc1) for r in M.sample_pca(rows)[0].collect()}
    assert np.allclose([got[c] for c in "abc"], abs(u[:, 0] * s[0]))
    holed = rows.withColumn("features", F.when(F.col("sample_id") == "a", F.array(*[F.lit(x) for x in (1.0, None, None, 4.0)])).otherwise(F.col("features")))
    with pytest.raises(Exception, match="missing values"):
        M.sample_pca(holed)


@pytest.mark.parametrize("shape", [130.0, 5000.0, 1e7])
def test_gammas_of_large_shape(shape):
    u = (np.arange(200_000) + 0.5) / 200_000
    x = gamma_quantiles(u, shape, 1.0)
    assert abs(x.mean() / shape - 1) < 1e-4 and abs(x.std() / np.sqrt(shape) - 1) < 1e-2
    assert abs(gamma_shape(shape, np.log(shape) - 1 / (2 * shape) - 1 / (12 * shape ** 2)) / shape - 1) < 1e-4


def test_nearly_equal_lengths_are_fitted(spark):
    rows = spark.createDataFrame([(0, "k", 1_000_000 + 100 * i) for i in range(40)], "split bigint, kind string, length bigint")
    fit = FF.length_fits(rows).first()
    assert abs(fit.shape * fit.scale / 1_001_950 - 1) < 1e-6
    assert 1_000_000 < fit.min_realistic_length < 1_001_950


def test_recurrent_regions_of_which_there_are_few(spark):
    regions = spark.createDataFrame([("chr1", 0, 10, 2, 10), ("chr1", 20, 30, 1, 10)], "chrom string, start bigint, end bigint, sample_count bigint, length bigint")
    assert [r.start for r in W.recurrent_top(regions, 3, exactly=False).collect()] == [0, 20]
    assert W.recurrent_top(regions, 1, exactly=False).count() == 1


def test_tied_points_open_one_span():
    con = duckdb.connect()
    # spans of one to three points, every point many times, in mixed order
    con.execute("""CREATE TABLE points AS SELECT 'P' AS sample_id, 'chr1' AS chrom, p * 10000 + q * 1000 AS start, p * 10000 + q * 1000 + 2 AS "end"
                   FROM range(0, 40000) a(p), range(0, 3) b(q), range(0, 12) c(copy) WHERE q <= p % 3 ORDER BY hash(p * 100 + q * 20 + copy)""")
    got = con.sql(f"""SELECT count(*), CAST(sum("end" - start) AS BIGINT) FROM ({merge_sql(DISTINCT_POINTS, "sample_id", 2999)})""").fetchall()
    assert got == [(40_000, sum(p % 3 * 1000 + 2 for p in range(40_000)))]


def test_profile_keeps_bins_without_signal(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT CAST(o AS BIGINT) AS o_orderkey, CAST(21 AS BIGINT) AS o_custkey, 'F' AS o_orderstatus, '1-URGENT' AS o_orderpriority
                    FROM (VALUES (1000), (3000)) t(o)) TO '{tmp_path}/orders.parquet' (FORMAT parquet)""")
    con.execute(f"COPY (SELECT 0 AS r_regionkey) TO '{tmp_path}/region.parquet' (FORMAT parquet)")
    con.execute(f"""COPY (SELECT CAST(219 AS BIGINT) AS c_custkey, 80.0 AS c_acctbal) TO '{tmp_path}/customer.parquet' (FORMAT parquet)""")
    con = duckdb.connect()
    for t in ("orders", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got = entry.queries()["scaled_profile"](spark, str(tmp_path)).toPandas()
    want = con.sql(entry.oracle_sql()["scaled_profile"]).df()
    assert len(got) == 20 and got["n_regions"].min() == 0 and got["n_regions"].max() > 0
    assert compare(got, want).startswith("ok")


@pytest.mark.parametrize("percent", [55, 60, 70, 75, 80])
def test_short_texts_of_frequent_words_link(spark, percent):
    rng = np.random.default_rng(percent)
    words = [f"w{i}" for i in range(40)]
    sets = [set(rng.choice(words[:12] if i % 2 else words, rng.integers(2, 7), replace=False)) for i in range(60)]
    docs = [" ".join(sorted(s)) for s in sets] + ["w%d x%d" % (w, i) for i in range(12) for w in range(40)]  # every word stands often, so it is frequent
    sets = [set(d.split()) for d in docs]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    got = similar_groups(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), words=1, percent=percent)
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: root(i) for i in range(len(sets))}


def test_toxicity_counts_every_labelled_row(spark, monkeypatch):
    # 5,000 clean texts and 1,250 toxic ones: more than the sample that training used to take
    rows = [(i, f"wort{i % 300} wort{i % 7} " + ("grumpf" if i % 5 == 0 else "gut"), "de") for i in range(6250)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _, _ in rows], "doc_id long, toxic int")
    seen = []
    real = toxicity._counts
    monkeypatch.setattr(toxicity, "_counts", lambda *args: seen.append(real(*args)) or seen[-1])
    model = toxicity.fit(docs, labels, epochs=2)
    times, _ = seen[0]
    used = docs.select("doc_id").where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) != 0)
    assert times[0, :, :].max() == used.where("doc_id % 5 <> 0").count() and times[0, 1].max() == used.where("doc_id % 5 = 0").count()
    again = toxicity.fit(docs.repartition(5), labels, epochs=2)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(got[i].predicted == (i % 5 == 0) for i, _, _ in rows)
    assert {r.doc_id: r.predicted for r in toxicity.score(docs, again).collect()} == {i: r.predicted for i, r in got.items()}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_context_takes_one_exchange_and_windows_across_tiles(spark):
    rng = np.random.default_rng(5)
    at = np.sort(rng.integers(2**20 - 30_000, 2**20 + 30_000, 400))
    beta = rng.random(400)
    df = spark.createDataFrame([("s", "chr1", int(p), float(b)) for p, b in zip(at, beta)], "sample_id string, chrom string, start bigint, beta double")
    out = G.context_features(df, [10_000, 40_000])
    assert plan(out).count("Exchange") == 1
    rows = out.collect()
    assert sorted(r.start for r in rows) == sorted(set(at.tolist()))
    for r in rows:
        for w in (10_000, 40_000):
            own = beta[abs(at - r.start) <= w // 2]
            assert r[f"n_{w}"] == len(own)
            assert np.allclose([r[f"mean_{w}"], r[f"std_{w}"], r[f"fraction_high_{w}"]], [own.mean(), own.std(), (own > 0.8).mean()])


def test_downsample_does_not_shuffle_the_table_by_part(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("p"), "id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = C.downsample(df, 50, ["id"], part=["p"])
        assert "BroadcastHashJoin" in plan(out)
        assert {r.p: r["count"] for r in out.groupBy("p").count().collect()} == {0: 50, 1: 50, 2: 50}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
