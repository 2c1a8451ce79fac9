"""Operator 6: blocks and cells of any size give the same counts, and texts are not moved."""

import random

import numpy as np

from spanframe.llm import lm_score


def test_packed_arrays():
    rng = np.random.default_rng(1)
    arrays = [np.sort(rng.integers(0, 1 << 63, 1000).astype(np.uint64)), np.zeros(0, np.uint64), np.array([(1 << 64) - 1], np.uint64), rng.integers(0, 5, 7)]
    assert [x.tolist() for x in lm_score.unpack(lm_score.pack(*arrays))] == [x.tolist() for x in arrays]
    assert [x.tolist() for x in lm_score.unpack(lm_score.pack(np.zeros(0, np.uint64)))] == [[]]


def test_cells_of_any_size(spark, make, monkeypatch):
    rng = random.Random(3)
    common = ["the", "of", "and"]
    docs = [(i if i % 9 else None, " ".join(rng.choice(common) if rng.random() < 0.6 else f"w{rng.randrange(300)}" for _ in range(rng.choice([0, 1, 5, 80])))) for i in range(300)]
    docs += [(7, docs[7][1]), (10**12, None)]
    frame, target = make(docs).repartition(5), spark.createDataFrame([(i,) for i in range(0, 200, 3)] + [(None,), (5 * 10**9,)], "doc_id long")

    def scored():
        return sorted((r.doc_id or -1, r.n_tokens, round(r.loss_target or -1.0, 9), round(r.loss_background or -1.0, 9), round(r.score or -1.0, 9))
                      for r in lm_score.score_documents(frame, target).collect())

    want = scored()
    assert len(want) == 302
    written = {}
    real = lm_score.materialize
    monkeypatch.setattr(lm_score, "materialize", lambda df, label="stage": written.setdefault(label, real(df, label)))
    for name, value in (("BLOCK_BYTES", 1000), ("GROUP", 100), ("STRIDE", 16)):
        monkeypatch.setattr(lm_score, name, value)
    monkeypatch.setattr(lm_score, "row_slices", lambda marks: [(i, min(i + 4, len(marks) - 1)) for i in range(0, len(marks) - 1, 4)])
    assert scored() == want
    pairs = written["pairs"].where("block is not null")
    assert written["blocks"].count() > 10 and pairs.select("bucket").distinct().count() > 10 and written["words"].select("bucket").distinct().count() > 3
    # followers of one common word are in several groups
    assert max(len(lm_score.unpack(r.payload)[0]) for r in pairs.collect()) < 400
    assert not [t for t in written.values() if "text" in t.columns]
