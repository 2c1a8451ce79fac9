"""Operators 3, 4 and 5 against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanframe.llm import exact_dedup, line_dedup, ngram_join
from spanframe.llm.components import components
from tests.llm.conftest import HARD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute_groups(docs):
    sets = {}
    for i, text in docs:
        words = WORD.findall(lower(text or ""))
        sets[i] = {tuple(words[k: k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inverse = {}
    for i, s in sets.items():
        for t in s:
            inverse.setdefault(t, []).append(i)
    for i, s in sets.items():
        for j, k in Counter(j for t in s for j in inverse[t] if j < i).items():
            if 100 * k >= 80 * (len(s) + len(sets[j]) - k):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_perfect_hash_finds_members_and_tells_strangers():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 256, (5000, 32), dtype=np.uint8)
    keys[1, :16] = keys[0, :16]  # alike in what places them: listed
    made, slot = exact_dedup.PerfectHash.build(exact_dedup._words(keys))
    assert sorted(slot) == list(range(5000))
    have = np.empty_like(keys)
    have[slot] = keys
    at, listed = made.slots(exact_dedup._words(keys))
    for i in range(5000):
        assert at[i] == slot[i] or slot[i] in listed
    strange = rng.integers(0, 256, (2000, 32), dtype=np.uint8)
    at, listed = made.slots(exact_dedup._words(strange))
    assert not (have[np.maximum(at, 0)] == strange).all(1).any()
    empty, slot = exact_dedup.PerfectHash.build(np.zeros((0, 4), np.uint64))
    assert len(slot) == 0 and (empty.slots(exact_dedup._words(strange))[0] == -1).all()


@pytest.mark.parametrize("history", ["doc_id < 3", "false", "true"])
def test_exact_dedup(make, history):
    docs = make([*HARD, (9, ""), (0, "no id")], keep_id="clash", digest=1)
    got = exact_dedup.dedup(docs, F.expr(history)).collect()
    assert len(got) == 12
    texts = Counter((r.text or "") for r in docs.collect())
    best = {}
    for r in docs.collect():
        best[r.text or ""] = max([x for x in (best.get(r.text or ""), r.doc_id) if x is not None], default=None)
    sums = {hashlib.sha256(t.encode()).hexdigest(): t for t in texts}
    for r in got:
        text = sums[r.text_sha256]
        assert (r.keep_id, r.group_size, r.kept) == (best[text], texts[text], r.doc_id == best[text])
    assert exact_dedup.dedup(docs.limit(0), F.expr(history)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(200)] + [(5, k) for k in range(6, 90)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def edited(rng, words, share):
    return " ".join(w if rng.random() > share else f"x{rng.randrange(10**6)}" for w in words)


def test_ngram_join_against_all_pairs(make):
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(3000)]
    shared = [" ".join(rng.choice(vocabulary) for _ in range(30)) for _ in range(4)]
    docs, n = [], 0
    for group in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 5, 6, 8, 12, 60, 150]))]
        for _ in range(rng.randint(1, 12)):
            docs.append((n, edited(rng, base, rng.choice([0, 0.005, 0.01, 0.02, 0.05]))))
            n += 1
    for _ in range(60):  # texts made of shared passages only
        docs.append((n, "\n".join(rng.sample(shared, rng.randint(1, 4)))))
        n += 1
    for k in range(4, 9):  # one token more each time: similar from four tokens on
        docs.append((n, " ".join(f"q{j}" for j in range(k + 4))))
        n += 1
    docs += [(n, "One two THREE"), (n + 1, "one Two three"), (n + 2, "one two"), (n + 3, ""), (n + 4, None)]
    want = brute_groups(docs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_groups(make(docs)).collect()}
    assert got == want


def test_signatures_are_shared_by_similar_sets():
    rng = np.random.default_rng(7)
    missed = 0
    for _ in range(3000):
        n = int(rng.integers(4, 60))
        a = np.unique(rng.integers(1, 1 << 62, n).astype(np.uint64))
        out = int(rng.integers(0, len(a) // 5 + 1))
        more = int(rng.integers(0, len(a) // 4 + 1))
        b = np.unique(np.concatenate([rng.permutation(a)[out:], rng.integers(1, 1 << 62, more).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both < 80 * (len(a) + len(b) - both):
            continue
        often = rng.random(1 << 12) < rng.random()
        kind = [often[(x >> np.uint64(20)).astype(np.int64) & 4095] for x in (a, b)]
        missed += not set(ngram_join.signature(a, kind[0], 80).tolist()) & set(ngram_join.signature(b, kind[1], 80).tolist())
        least = ngram_join.fewest_differences(ngram_join.parity_sketch(a), ngram_join.parity_sketch(b))
        assert least <= len(a) + len(b) - 2 * both
    assert missed == 0


def test_near_copies_are_ruled_out_without_pairs(make, monkeypatch):
    rng = random.Random(5)
    base = [f"b{k}" for k in range(150)]
    docs = []
    for n in range(240):  # one word in about forty, as rare as the edits of large groups are: many of these copies link with none
        words = list(base)
        for at in rng.sample(range(0, 150, 6), rng.choice([0, 1, 2, 3, 4, 5])):
            words[at] = f"x{n}y{at}"
        docs.append((n, " ".join(words)))
    looked_at = []

    def linked(pairs, *rest):
        looked_at.append(pairs.count())
        return whole(pairs, *rest)

    whole = ngram_join._linked
    monkeypatch.setattr(ngram_join, "_linked", linked)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_groups(make(docs)).collect()}
    assert got == brute_groups(docs)
    assert sum(looked_at) <= 10 * len(docs)


def test_lists_of_pairs_hold_what_reaches():
    rng = np.random.default_rng(3)
    seen = 0
    for _ in range(3000):
        n = int(rng.integers(4, 80))
        a = np.unique(rng.integers(1, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.concatenate([rng.permutation(a)[int(rng.integers(0, len(a) // 6 + 1)):], rng.integers(1, 1 << 62, int(rng.integers(0, len(a) // 6 + 1))).astype(np.uint64)]))
        both = np.intersect1d(a, b)
        if 100 * len(both) < 80 * (len(a) + len(b) - len(both)):
            continue
        # what both hold is frequent, and some of the rest
        kinds = [np.isin(x, both) | (x >> np.uint64(20) & np.uint64(3) == 0) for x in (a, b)]
        signs = [ngram_join.signature(x, k, 80) for x, k in zip((a, b), kinds)]
        assert any(s & np.uint64(1) for s in np.intersect1d(*signs))
        far = [ngram_join.reach(len(x), int((~k).sum()), 80) for x, k in zip((a, b), kinds)]
        assert far[0] >= 80 * len(b) and far[1] >= 80 * len(a)
        # the first pair that both list stands early enough in both
        pairs = [s[s & np.uint64(1) == 1] for s in signs]
        first = [int(np.flatnonzero(np.isin(p, pairs[1 - k]))[0]) for k, p in enumerate(pairs)]
        rare = [int((~k).sum()) for k in kinds]
        assert ngram_join.meets(len(a), rare[0], first[0], len(b), rare[1], 80) and ngram_join.meets(len(b), rare[1], first[1], len(a), rare[0], 80)
        seen += 1
    assert seen > 300


def test_ngram_join_hard_rows(make):
    docs = make([(10, "a b c d e f g h i"), (11, "A B C D E F G H I"), *HARD], component_id="clash")
    got = ngram_join.similar_groups(docs).collect()
    assert len(got) == 12
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[11].component_id == 10 and by[6].component_id == 5 and by[1].component_id == 1 and by[1].n_shingles == 0 and by[3].n_shingles == 0
    assert by[4].n_shingles == 4
    assert sorted(r.n_shingles for r in got if r.doc_id is None) == [0, 1] and all(r.component_id is None for r in got if r.doc_id is None)
    assert ngram_join.similar_groups(docs.limit(0)).count() == 0


PASSAGE = "\n".join(f"This is line {k} of a passage that many documents hold in common, word for word." for k in range(5))


def test_line_dedup_cuts_later_places_only(make):
    docs = make([(3, f"Own start of three.\n{PASSAGE}\nOwn end of three."), (1, f"One begins.\nAnd goes on.\n{PASSAGE}"), (2, "Nothing shared here.\nNot at all."), (None, PASSAGE)],
                n_removed="clash", _note="x")
    got = {r.doc_id: r for r in line_dedup.remove_repeats(docs, details=True).collect()}
    assert got[1].text.endswith(PASSAGE) and got[1].n_removed == 0
    assert got[2].text == "Nothing shared here.\nNot at all."
    assert got[3].n_lines == 7 and 3 <= got[3].n_removed <= 5 and got[3].text.startswith("Own start of three.") and got[3].text.endswith("Own end of three.")
    assert got[None].n_removed >= 3
    lines = {line for r in docs.collect() for line in r.text.split("\n")}
    assert {line for r in got.values() for line in r.text.split("\n")} >= lines  # no line is lost altogether


def test_line_dedup_hard_rows(make):
    docs = make(HARD)
    got = line_dedup.remove_repeats(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == sorted((r.doc_id or 0, r.text or "") for r in docs.collect())
    assert line_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_line_dedup_is_native(make):
    plan = line_dedup.remove_repeats(make([(1, PASSAGE), (2, PASSAGE)]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def brute_gone(docs, least=100):
    """Lines of all passages of ``least`` characters or more that stand at an earlier place too, by all pairs of places."""
    lines = {i: t.split("\n") for i, t in docs}
    first, gone = {}, {}
    for i in sorted(lines):
        own = lines[i]
        for a in range(len(own)):
            for b in range(a, len(own)):
                piece = "\n".join(own[a: b + 1])
                if len(piece) >= least and first.setdefault(piece, (i, a)) != (i, a):
                    gone.setdefault(i, set()).update(range(a, b + 1))
    return {i: "\n".join(x for k, x in enumerate(own) if k not in gone.get(i, ())) for i, own in lines.items()}


def test_line_dedup_removes_whole_passages(make):
    rng = random.Random(5)

    def line(low, high):
        return "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(low, high)))

    single = line(110, 300)
    passages = [[single], *[[line(*size) for _ in range(n)] for size, n in (((60, 90), 2), ((60, 90), 2), ((20, 40), 7), ((0, 9), 60), ((1, 1), 52), ((150, 200), 3), ((30, 120), 12))]]
    passages.append([line(120, 150), "a short last line"])
    docs = [(0, single), (1, single), (2, line(150, 200))]
    for i in range(3, 60):
        docs.append((i, "\n".join(x for p in rng.sample(passages, 3) for x in [line(5, 60), *p])))
    got = {r.doc_id: r.text for r in line_dedup.remove_repeats(make(docs)).collect()}
    assert got == brute_gone(docs)
    assert got[1] == "" and all(x not in got[59].split("\n") for p in passages for x in p if len(x) > 9)


def test_line_dedup_removes_single_lines(make):
    line = "One line of a passage that several documents share, and that is long enough to be a passage by itself, word for word."
    docs = [(1, f"Before.\n{line}\nAfter."), (2, line), (3, f"Other.\n{line}\nNeighbours."), (4, f"Short.\n{line[:60]}")]
    got = {r.doc_id: r.text for r in line_dedup.remove_repeats(make(docs)).collect()}
    assert got == {1: docs[0][1], 2: "", 3: "Other.\nNeighbours.", 4: docs[3][1]}
