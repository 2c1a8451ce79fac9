import numpy as np
import pytest
from pyspark.sql import functions as F

from spanframe.operators import fold_features as FF

K, REPEATS = 2, 1
COORDS = "chrom string, start bigint, `end` bigint"


@pytest.fixture(scope="module")
def study(spark):
    """12 patients; two observed points everywhere, regions at loci that samples share."""
    rng = np.random.default_rng(3)
    samples = [(f"s{i:02d}", f"p{i:02d}", "Tumor" if i % 2 else "Normal", 0, (i // 2) % 2) for i in range(12)]
    points = [("chr1", 100 * k, 100 * k + 2) for k in range(1, 400)] + [("chr2", 150 * k, 150 * k + 2) for k in range(1, 200)]
    values = [(s, c, a, b, None if rng.random() < 0.1 else float(rng.random() + (y == "Tumor"))) for s, _, y, _, _ in samples for c, a, b in points]
    segments = [(s, c, x, x + int(rng.integers(150, 900))) for s, _, y, _, _ in samples for c in ("chr1", "chr2") for x in range(500, 20_000, 4000) if rng.random() < (0.8 if y == "Tumor" else 0.2)]
    islands = [("chr1", x, x + 200 + x % 300) for x in range(0, 39_000, 1500)] + [("chr3", 5, 500)]
    make = spark.createDataFrame
    return {"beta": make(values, f"sample_id string, {COORDS}, beta double").cache(), "segments": make(segments, f"sample_id string, {COORDS}"),
            "islands": make(islands, COORDS), "assigned": make(samples, "sample_id string, patient_id string, binary_label string, repeat int, fold int"),
            "sizes_of_chroms": make([("chr1", 40_000), ("chr2", 30_000), ("chr3", 1000)], "chrom string, size bigint"), "k": K, "repeats": REPEATS}


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_training_anchors_are_those_of_training_samples(study):
    got = rows(FF.fold_anchors(study["beta"], study["assigned"], K, REPEATS, 3), "split", "chrom", "anchor_pos")
    fold = {r.sample_id: r.fold for r in study["assigned"].collect()}
    seen = {}
    for r in study["beta"].where("beta IS NOT NULL").collect():
        for split in range(K):
            if fold[r.sample_id] != split:
                seen.setdefault((split, r.chrom, (r.start + r.end) // 2), set()).add(r.sample_id)
    assert got == sorted(k for k, v in seen.items() if len(v) >= 3)


def merged(intervals, gap):
    out = []
    for s, e in sorted(intervals):
        if out and s <= out[-1][1] + gap:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def training(study, split, label):
    who = {r.sample_id for r in study["assigned"].collect() if r.fold != split and r.binary_label == label}
    mine = [r for r in study["segments"].collect() if r.sample_id in who]
    return [(c, s, e, len({r.sample_id for r in mine if r.chrom == c and s <= r.start < e})) for c in ("chr1", "chr2") for s, e in merged([(r.start, r.end) for r in mine if r.chrom == c], 1000)]


def test_sets_against_plain_python(study):
    sets = FF.fold_feature_sets(**study, sizes=[2, 4], draws=2).collect()
    by = {}
    for r in sets:
        by.setdefault((r.split, r.feature_set, r.n_features, r.feature_draw), []).append(r)
    assert set(by) == {(s, f, n, d) for s in range(K) for f in FF.SETS for n in (2, 4) for d in range(1 if f == "PMD" else 2)}
    for (split, name, n, draw), found in by.items():
        assert len(found) == n and sorted(r.region_index for r in found) == list(range(n))
        found.sort(key=lambda r: r.region_index)
        tumor, normal = training(study, split, "Tumor"), training(study, split, "Normal")

        def best(regions):
            return sorted(regions, key=lambda r: (-r[3], -(r[2] - r[1]), r[0], r[1]))

        places = [(r.chrom, r.start, r.end) for r in found]
        if name == "PMD":
            away = [t for t in tumor if not any(b[0] == t[0] and b[1] <= t[2] + 1000 and b[2] >= t[1] - 1000 for b in best(normal)[:n])]
            assert [(*p, r.sample_count) for p, r in zip(places, found)] == best(away)[:n]
        elif name in ("Random PMD", "CGI"):
            pool = {t[:3] for t in tumor} if name == "Random PMD" else {tuple(r) for r in study["islands"].collect()}
            assert len(set(places)) == n and set(places) <= pool and "chr3" not in {p[0] for p in places}
            if n == 2:  # sizes are prefixes of one draw
                longer = sorted(by[split, name, 4, draw], key=lambda r: r.region_index)
                assert places == [(r.chrom, r.start, r.end) for r in longer[:2]]
        else:
            lengths = [t[2] - t[1] for t in tumor] if name == "Random long" else [r.end - r.start for r in study["islands"].collect() if r.chrom == "chr1"]
            assert places == sorted(places)
            for i, (c, s, e) in enumerate(places):
                assert min(lengths) <= e - s <= max(lengths) and found[i].training_observed_points >= 1
                assert not any(t[0] == c and t[1] < e and s < t[2] for t in tumor)
                assert not any(o[0] == c and o[1] < e and s < o[2] for j, o in enumerate(places) if j != i)


def test_test_samples_shape_no_set(study):
    fold = study["assigned"].select("sample_id", F.col("fold").alias("_f"))
    beta = study["beta"].join(fold, "sample_id").withColumn("beta", F.when(F.col("_f") == 0, None).otherwise(F.col("beta"))).drop("_f")
    segments = study["segments"].join(fold, "sample_id").where("_f <> 0").drop("_f")
    members = FF.fold_members(study["assigned"], K)
    for label in ("Tumor", "Normal"):
        a, b = (rows(FF.fold_regions(x, members, label).where("split = 0"), "chrom", "start", "end", "sample_count") for x in (study["segments"], segments))
        assert a == b
    a, b = (rows(FF.fold_anchors(x, study["assigned"], K, REPEATS).where("split = 0"), "chrom", "anchor_pos") for x in (study["beta"], beta))
    assert a == b


def test_small_run_gives_twelve_rows(study):
    scores, predictions, chosen = FF.run_fold_benchmark(**study, sizes=[2], trees=10)
    assert scores.count() == 12
    got = predictions.collect()
    assert len(got) == 12 * 6 and {r.patient_id for r in got} == {f"p{i:02d}" for i in range(12)}
    assert {r.fold_key for r in got} == {"repeat_00_fold_00_split_0000", "repeat_00_fold_01_split_0001"}
    assert all(r.y_pred == 1 and r.y_score == 1.0 for r in got if r.feature_set == "Always cancer")
    assert all(r.correct == (r.y_true == r.y_pred) for r in got)
    # tumours are a whole unit above the normals
    assert all(r.balanced_accuracy == 1.0 for r in scores.where("feature_set <> 'Always cancer'").collect())
    assert chosen.count() == 2 * 5 * 2


def test_vectors_are_filled_with_training_means(spark):
    beta = spark.createDataFrame([("a", "chr1", 10, 12, 0.2), ("b", "chr1", 10, 12, 0.6), ("c", "chr1", 10, 12, None), ("c", "chr1", 90, 92, 0.5)], f"sample_id string, {COORDS}, beta double")
    members = spark.createDataFrame([(0, 0, 0, s, s, "Tumor", s == "c") for s in "abc"], "split bigint, repeat bigint, fold bigint, sample_id string, patient_id string, binary_label string, is_test boolean")
    sets = spark.createDataFrame([(0, "PMD", 1, 0, 0, "chr1", 0, 50)], "split bigint, feature_set string, n_features bigint, feature_draw bigint, region_index bigint, " + COORDS)
    got = {r.sample_id: r.features for r in FF.fold_vectors(beta, members, sets).collect()}
    assert got == {"a": [0.2], "b": [0.6], "c": [0.4]}
    empty = sets.withColumn("start", F.lit(60).cast("bigint")).withColumn("end", F.lit(70).cast("bigint"))
    with pytest.raises(Exception, match="no observed values"):
        FF.fold_vectors(beta, members, empty).collect()


def test_shortfalls_raise(study):
    with pytest.raises(ValueError, match="distinct eligible regions, but 50 were requested"):
        FF.fold_feature_sets(**study, sizes=[50], names=["CGI"])
    with pytest.raises(ValueError, match="found no place"):
        anchors = FF.fold_anchors(study["beta"], study["assigned"], K, REPEATS)
        whole = FF.fold_regions(study["segments"], FF.fold_members(study["assigned"], K), "Tumor")
        long = whole.withColumn("kind", F.lit("x")).withColumn("length", F.lit(9000).cast("bigint"))
        FF.placed_regions(long, whole, study["sizes_of_chroms"], anchors, 30, splits=K, rounds=(2, 4))
