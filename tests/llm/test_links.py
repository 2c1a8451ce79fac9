"""Operator 4: the number of links, against all pairs."""

import random

import numpy as np
import pytest

from spanframe.llm import ngram_join
from tests.llm.test_duplicates import WORD, edited, lower


def brute_links(docs):
    sets = {}
    for i, text in docs:
        words = WORD.findall(lower(text or ""))
        sets[i] = frozenset(tuple(words[k: k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])
    every = set(sets.values()) - {frozenset()}
    n = {a: sum(a != b and 100 * len(a & b) >= 80 * len(a | b) for b in every) for a in every}
    return {i: n.get(s, 0) for i, s in sets.items()}


@pytest.mark.parametrize("bounds", [(1 << 20, 2048), (900, 7)])
def test_every_link_is_counted(make, monkeypatch, bounds):
    monkeypatch.setattr(ngram_join, "CELL_TOKENS", bounds[0])
    monkeypatch.setattr(ngram_join, "CELL_ROWS", bounds[1])
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(2000)]
    docs = []
    for base, copies in ((150, 60), (150, 25), (40, 12), (12, 8), (9, 3), (300, 2), (6, 1)):
        words = [rng.choice(vocabulary) for _ in range(base)]
        docs += [(len(docs) + k, edited(rng, words[: base - rng.randrange(1 + base // 8)], rng.choice([0, 0.005, 0.01, 0.02]))) for k in range(copies)]
    chain = [rng.choice(vocabulary) for _ in range(400)]
    docs += [(len(docs) + k, " ".join(chain[5 * k: 5 * k + 100])) for k in range(40)]  # neighbours link, ends do not
    docs += [(len(docs) + k, t) for k, t in enumerate((docs[0][1], docs[3][1].upper(), "", None))]
    got = {r.doc_id: r.n_links for r in ngram_join.similar_groups(make(docs)).collect()}
    want = brute_links(docs)
    assert got == want and max(want.values()) > 30


def test_intersections(monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(ngram_join, "COLUMNS", 8)
    monkeypatch.setattr(ngram_join, "PLACES", 50)
    for spread in (30, 300, 3000):
        sides = [[np.unique(rng.integers(0, spread, rng.integers(1, 40))) for _ in range(n)] for n in (20, 33)]
        flat = [(np.arange(len(x)).repeat([len(t) for t in x]), np.concatenate(x), len(x)) for x in sides]
        assert ngram_join.intersections(*flat[0], *flat[1]).tolist() == [[len(np.intersect1d(a, b)) for b in sides[1]] for a in sides[0]]
