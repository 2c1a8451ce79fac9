"""Operators 2, 6 and 8: held-out accuracy, exact arithmetic on small cases, hard rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanframe.llm import language, lm_score, toxicity
from spanframe.llm.queries import QUERIES
from tests.llm.conftest import HARD

SF = "/root/testdata/sf0.01"


def test_kneser_ney_sums_to_one():
    models = language.fit_models({"xx": (["abab", "abc", "bcb", "a"], np.array([3.0, 2, 1, 5]))})
    # after "a" the known symbols and all unknown ones together have probability one
    for before in ("", "a", "ab", "zz"):
        total = 0.0
        known = "abc"
        base = language._padded  # words are scored whole, so read one step off as a difference
        assert base is not None
        whole = {c: _word_prefix_loss(models, before + c) for c in known}
        start = _word_prefix_loss(models, before)
        total = sum(math.exp(start - whole[c]) for c in known)
        end = math.exp(start - _loss(models, before)) if before else 0.0
        other = (language.ALPHABET - len(known) - 1) * math.exp(start - _word_prefix_loss(models, before + "π"))
        nothing = math.exp(start - _word_prefix_loss(models, before + chr(language.WORD_END))) if not before else 0.0
        assert total + end + nothing + other == pytest.approx(1, abs=1e-4)


def _loss(models, word):
    points = np.array([ord(c) for c in word], np.uint32)
    return float(models.losses(points, np.array([0]), np.array([len(word)]))[0, 0])


def _word_prefix_loss(models, word):
    """Loss of the letters alone, without the word's end."""
    symbols = np.array([language.WORD_START, *map(ord, word)], np.uint32)
    place = np.arange(len(symbols))
    hashes = language.gram_hashes(symbols)
    log = models._level(0, hashes[0], None, np.full((len(symbols), 1), -np.log(language.ALPHABET), np.float32), np.ones(len(symbols), bool))
    for n in range(1, language.ORDER):
        before = np.zeros_like(hashes[0])
        before[1:] = hashes[n - 1][:-1]
        log = models._level(n, hashes[n], before, log, place >= n)
    log[0] = 0
    return -float(log.sum())


def test_language_held_out(spark):
    got = QUERIES["op2_language_id"](spark, SF).where("held_out")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    row = got.join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"), F.max("score").alias("top"), F.min("score").alias("low")).first()
    assert row["right"] > 0.98 and 0 <= row["low"] <= row["top"] <= 1


def test_language_rejects_what_is_far(spark, make):
    rng = random.Random(1)
    word = {"aa": lambda: "".join(rng.choice(["ba", "lo", "mi"]) for _ in range(3)), "bb": lambda: "".join(rng.choice(["xut", "zek", "vop"]) for _ in range(2))}
    rows = [(k, " ".join(word[name]() for _ in range(80)), name) for name in word for k in range(60)]
    labelled = spark.createDataFrame([(i + 1000 * (n == "bb"), t, n) for i, t, n in rows], "doc_id long, text string, lang string")
    models = language.fit(labelled)
    assert models.languages == ["aa", "bb"]
    docs = make([*HARD, (20, "balomi milolo " * 30), (21, "XUTZEK vopvop " * 30), (22, "жщц ъыь эюя " * 30)], score="clash", rejected=1)
    got = language.predict(docs, models)
    assert got.count() == 13 and set(got.columns) == {*docs.columns, "lang_pred", "cross_entropy", "n_symbols"}
    by = {r.doc_id: r for r in got.where("doc_id is not null").collect()}
    for i in (1, 2, 3):
        assert (by[i].lang_pred, by[i].score, by[i].rejected, by[i].cross_entropy) == ("und", 0.0, True, None)
    assert (by[20].lang_pred, by[20].rejected) == ("aa", False) and (by[21].lang_pred, by[21].rejected) == ("bb", False)
    assert by[22].rejected and by[22].lang_pred in ("aa", "bb")
    assert language.predict(docs.limit(0), models).count() == 0
    nothing = language.fit(labelled.limit(0))
    assert {r.lang_pred for r in language.predict(docs, nothing).collect()} == {"und"}


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op8_toxicity"](spark, sf)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    x = got.where("held_out").join(labels, "doc_id").toPandas()
    assert ((x.predicted == 1) == (x.score >= 0.3)).all()
    hit = ((x.predicted == 1) & (x.toxic == 1)).sum()
    assert hit / (x.predicted == 1).sum() > 0.85 and hit / (x.toxic == 1).sum() > 0.65


def test_toxicity_learns_words_and_stems(spark, make):
    rng = random.Random(4)
    plain = [f"wort{k}" for k in range(400)]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(40)]
        bad = i % 3 == 0
        if bad:
            words[rng.randrange(40)] = rng.choice(["grumpf", f"schlonz{rng.randrange(10**6)}"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs = make(rows, lang="de")
    labelled = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, labelled.unionAll(spark.createDataFrame([(None, 1), (3, None), (10**9, 1)], "doc_id long, toxic int")))
    test = make([(1, "wort1 wort2 GRUMPF wort3"), (2, "wort1 wort2 wort3"), (3, "wort9 Schlonz77 wort8"), (4, ""), (5, None), (6, "wort1 " * 300_000 + "grumpf"), (None, "wort5")], score="clash")
    by = {r.doc_id: r for r in toxicity.score(test, model).collect()}
    assert [by[i].predicted for i in (1, 2, 3, 6)] == [1, 0, 1, 1]
    assert by[4].score == by[5].score and 0 <= by[4].score < 0.3
    assert toxicity.score(test.limit(0), model).count() == 0
    untrained = toxicity.fit(docs.limit(0), labelled)
    assert {r.predicted for r in toxicity.score(test, untrained).collect()} == {0}


def test_lm_losses_by_hand(spark, make):
    docs = make([(1, "a b a b"), (2, "a b"), (3, "B c!"), (4, None), (5, ""), (None, "c c")], score="clash")
    target = spark.createDataFrame([(1,), (2,), (2,), (None,), (77,)], "doc_id long")
    got = {r.doc_id: r for r in lm_score.score_documents(docs, target, words=3, classes=2).collect()}
    size = 3 + 2 + 1

    def prob(texts, before, word):
        pairs, uni = {}, {}
        for text in texts:
            prev = "^"
            for w in text.split():
                pairs[prev, w] = pairs.get((prev, w), 0) + 1
                uni[w] = uni.get(w, 0) + 1
                prev = w
        one = (uni.get(word, 0) + 1) / (sum(uni.values()) + size)
        own = {b: n for (a, b), n in pairs.items() if a == before}
        return (own.get(word, 0) + len(own) * one) / (sum(own.values()) + len(own)) if own else one

    background, wanted = ["a b a b", "a b", "b c", "c c"], ["a b a b", "a b"]
    for i, words in ((1, ["a", "b", "a", "b"]), (3, ["b", "c"]), (None, ["c", "c"])):
        for column, texts in (("loss_target", wanted), ("loss_background", background)):
            mean = sum(-math.log(prob(texts, a, b)) for a, b in zip(["^", *words], words)) / len(words)
            assert got[i][column] == pytest.approx(mean, abs=1e-5)
        assert got[i].score == pytest.approx(got[i].loss_target - got[i].loss_background)
    assert got[1].score < got[3].score
    for i in (4, 5):
        assert (got[i].n_tokens, got[i].loss_target, got[i].score) == (0, None, None)
    assert lm_score.score_documents(docs.limit(0), target).count() == 0
    assert lm_score.score_documents(make(HARD), target.limit(0)).count() == 10


def test_lm_models_all_words(spark, make):
    rng = random.Random(6)
    # every word is far below the commonest 2,000, and only rare words tell the target
    common = [f"c{k}" for k in range(2500)]
    docs = [(i, " ".join(x for k in range(60) for x in (rng.choice(common), f"{'ab'[i % 2]}{(31 * i + k) % 3000}"))) for i in range(400)]
    frame, target = make(docs), spark.createDataFrame([(i,) for i in range(0, 200, 2)], "doc_id long")
    got = {r.doc_id: r for r in lm_score.score_documents(frame, target).collect()}
    pairs, uni, before = ({}, {}), ({}, {}), ({}, {})
    for i, text in docs:
        for m in (0, 1) if i < 200 and i % 2 == 0 else (1,):
            for a, b in zip(["^", *text.split()], text.split()):
                pairs[m][a, b] = pairs[m].get((a, b), 0) + 1
                uni[m][b] = uni[m].get(b, 0) + 1
    for m in (0, 1):
        for (a, _), n in pairs[m].items():
            total, kinds = before[m].get(a, (0, 0))
            before[m][a] = total + n, kinds + 1
    size = len(uni[1]) + 1
    assert size > 5000
    for i, text in docs:
        for m, column in ((0, "loss_target"), (1, "loss_background")):
            loss = 0.0
            for a, b in zip(["^", *text.split()], text.split()):
                one = (uni[m].get(b, 0) + 1) / (sum(uni[m].values()) + size)
                total, kinds = before[m].get(a, (0, 0))
                loss -= math.log((pairs[m].get((a, b), 0) + kinds * one) / (total + kinds) if total else one)
            assert got[i][column] == pytest.approx(loss / 120, abs=1e-5)


def test_lm_tells_quality(spark):
    got = QUERIES["op6_lm_scoring"](spark, SF)
    x = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    good, bad = x[x.quality == 1].score.values, x[x.quality == 0].score.values
    assert (good[:, None] < bad[None]).mean() > 0.95
