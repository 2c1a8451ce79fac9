"""Operators 11, 12 and 13 against brute force, and the cases their docstrings define."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanframe.llm import conversation_repair, embedding_dedup, hard_negatives
from spanframe.llm.conversation_repair import Node, Repair, before

VECTORS = "vec_id long, embedding array<float>, label int, n long, v string, `class` int, cells int, id string, row int, chunk int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, k, 1, "x", 2, 3, "y", 4, 5) for i, v, k in rows], VECTORS)


# ---------------------------------------------------------------- operator 11


def every_script(rows):
    """(cost, audit, roles) of the best script, by trying all of them with at most two inserted turns side by side."""
    found = []

    def go(i, roles, cost, audit, ins):
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            found.append((cost, audit, roles))
        options = [(i, r, 2, "I", ins + 1) for r in "ua" if ins < 2]
        if i < len(rows):
            role, _, gone, short = rows[i]
            options.append((i + 1, "", 3, "D", 0))
            if not gone:
                options.append((i + 1, role[:1], int(short), "K", 0))
                options += [(i + 1, r, 2 + int(short), "R", 0) for r in "ua"]
        for k, r, more, edit, n in options:
            if edit == "D" or (r in ("s", "u", "a") and re.fullmatch("(s?(ua)*u?)?", roles + r)):
                go(k, roles + r, cost + more, audit + edit, n)

    go(0, "", 0, "", 0)
    return min(found)


def test_repair_against_every_script(monkeypatch):
    monkeypatch.setattr(conversation_repair, "SETTLE", 2)
    rng = random.Random(11)
    for _ in range(250):
        rows = [(rng.choice(["user", "assistant", "system", "user", "assistant", "x", ""]), str(i), rng.random() < 0.15, rng.random() < 0.2) for i in range(rng.randrange(6))]
        edits = []
        programme = Repair(lambda *x: edits.append(x))
        programme.patience = 2
        for row in rows:
            programme.read(*row)
        cost = programme.finish()
        assert (cost, "".join(e for e, _, _ in edits), "".join(role[:1] for e, role, _ in edits if e != "D")) == every_script(rows), rows


def chain(letters, start=None):
    node = start or Node(None)
    for x in letters:
        node = Node(node, x)
    return node


def test_scripts_compare_like_their_letters(monkeypatch):
    rng = random.Random(5)
    for modulus in (conversation_repair._MOD, 3):  # with three hash values nearly everything collides
        monkeypatch.setattr(conversation_repair, "_MOD", modulus)
        for _ in range(400):
            shared = "".join(rng.choice("DIKR") for _ in range(rng.randrange(40)))
            a, b = ("".join(rng.choice("DK") for _ in range(rng.randrange(5))) for _ in range(2))
            root = chain(shared)
            x, y = chain(a, root), chain(b, root if rng.random() < 0.5 else chain(shared))
            assert before(x, y) == (shared + a < shared + b)


def test_open_turns_stay_few():
    rng = random.Random(6)
    programme, most = Repair(lambda *x: None), 0
    for i in range(5000):
        programme.read(rng.choice(["user", "assistant"]), "t", rng.random() < 0.05, False)
        most = max(most, len(programme.rows))
    assert most <= 64


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        if not body:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def test_conversations(spark):
    rng = random.Random(4)
    texts = ["Hello there.", "Yes!", "cut off", "", " \x0b\t", "Why?  \n", "tail.\x0c", "é…", None, "No "]
    data = []
    for conv in [*range(60), None]:
        for turn in rng.sample([None, 0, 1, 2, 3, 5, 9], rng.randrange(1, 5)):
            data.append((conv, turn, rng.choice(["user", "assistant", "system", None, "User"]), rng.choice(texts), 1, "clash"))
    data += [(70, 3, "user", "Twice.", 1, ""), (70, 3, "user", "Twice.", 1, ""), (71, None, None, None, 1, ""), (72, -2**62, "user", "a.", 1, ""), (72, 2**62, "assistant", "b.", 1, "")]
    frame = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, blank int, conv string")
    gone = spark.createDataFrame([(99, 1, "user", "dropped", 1, "")], frame.schema)
    present = F.coalesce(F.col("conv_id"), F.lit(0)) != 99
    got = {r.conv_id: r for r in conversation_repair.summarise(frame.unionAll(gone), present=present).collect()}
    assert got[99].asDict() == {"conv_id": 99, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "",
                                "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    turns = {}
    for r in conversation_repair.repair(frame.unionAll(gone), present=present).orderBy("step").collect():
        turns.setdefault(r.conv_id, []).append(r)
    by = {}
    for conv, turn, role, text, *_ in data:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    assert set(got) == {*by, 99}
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        marks = faults(rows)
        cost, audit, roles = every_script([(role, text, m in ("blank", "duplicate"), m == "truncated") for (_, role, text), m in zip(rows, marks, strict=True)])
        numbers = [t for t, _, _ in rows if t is not None]
        r = got[conv]
        assert (r.blank, r.duplicate, r.truncated, r.cost, r.audit) == (*(marks.count(k) for k in ("blank", "duplicate", "truncated")), cost, audit)
        assert r.gaps == (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0)
        assert r.illegal == sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        left, k, lines = iter(rows), 0, []
        for e in audit:
            row = None if e == "I" else next(left)
            if e != "D":
                lines.append(f"{row[1] if e == 'K' else {'u': 'user', 'a': 'assistant'}[roles[k]]}:{row[2] if row else ''}")
                k += 1
        assert r.repaired_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()
        assert [f"{x.role}:{x.text}" for x in turns[conv] if x.edit != "D"] == lines and "".join(x.edit for x in turns[conv]) == audit
    assert conversation_repair.summarise(frame.limit(0)).count() == 0


# ---------------------------------------------------------------- operator 12


def brute_links(rows, threshold):
    good = [k for k, (_, v, _) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = {k: set() for k in range(len(rows))}
    for a in good:
        for b in good:
            if a < b and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[k][1], np.float32).astype(float) for k in (a, b))
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[a].add(b)
                    links[b].add(a)
    out, seen = [], {}
    for k in range(len(rows)):
        if k not in seen:
            group, todo = {k}, [k]
            while todo:
                for n in links[todo.pop()] - group:
                    group.add(n)
                    todo.append(n)
            ids = [rows[g][0] for g in group if rows[g][0] is not None]
            seen |= dict.fromkeys(group, min(ids) if ids else None)
    for k, (i, _, _) in enumerate(rows):
        out.append((i, len(links[k]), seen[k], i is not None and i == seen[k]))
    return sorted(map(str, out))


@pytest.mark.parametrize("cell,block", [(10**6, 10**6), (20, 8), (3, 4)])
def test_near_duplicate_vectors(spark, monkeypatch, cell, block):
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", cell)
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", block)
    embedding_dedup.plan.cache_clear()
    rng = np.random.default_rng(2)
    rows = []
    for i in range(150):
        base = rng.normal(size=24)
        rows.append((1000 - 3 * i, base.tolist(), i % 4))
        for k in range(rng.integers(0, 6)):
            rows.append((2000 + 10 * i + k, (base * rng.uniform(0.1, 9) + rng.normal(size=24) * rng.uniform(0, 0.5)).tolist(), None))
    rows += [(5, [1.0, 2.0], 1), (6, [2.0, 4.0], 1), (7, [-1.0, -2.0], 1), (8, [3.0], 1), (9, [0.5], 1), (9, [0.5], 1), (None, [0.5], 1), (None, [7.0, 7.0, 7.0], 1), (10, [0.0, 0.0], 1),
             (11, [], 1), (12, None, 1), (13, [1.0, None], 1), (14, [float("nan"), 1.0], 1), (15, [float("inf"), 1.0], 1), (16, [1e30, 2e30], 1), (17, [1e-40, 2e-40], 1), (18, [-0.0, 1.0], 1), (19, [0.0, 1.0], 1)]
    frame = vectors(spark, rows)
    got = sorted(str(tuple(r)) for r in embedding_dedup.near_duplicates(frame).collect())
    assert got == brute_links(rows, 0.9)
    if cell == 20:
        assert embedding_dedup.near_duplicates(frame.limit(0)).count() == 0
    embedding_dedup.plan.cache_clear()


def test_bounds_hold_and_estimates_are_unbiased():
    rng = np.random.default_rng(3)
    dims = 48
    x, y = (embedding_dedup.units(rng.normal(size=(4000, dims))) for _ in range(2))
    y = embedding_dedup.units(x * rng.uniform(0, 3, (4000, 1)) + y)
    true = (x * y).sum(axis=1)
    ratios = []
    for seed in range(20):
        turn = embedding_dedup.rotation(dims, seed).T
        codes, factors = embedding_dedup.encode(x @ turn)
        b = (embedding_dedup.corners(codes, dims) * (y @ turn)).sum(axis=1)
        assert (embedding_dedup.upper_bounds(factors, b, dims) >= true - 1e-6).all()
        ratios.append(b / factors - true)
    assert abs(np.mean(ratios)) < 2e-3


def test_recall_at_the_threshold_itself():
    rng = np.random.default_rng(4)
    embedding_dedup.plan.cache_clear()
    shape = embedding_dedup.plan(64, 200_000, 0.9, 0.999, 12)
    x, z = (rng.normal(size=(5000, 64)) for _ in range(2))
    x = embedding_dedup.units(x)
    z = embedding_dedup.units(z - (z * x).sum(axis=1, keepdims=True) * x)
    shared = embedding_dedup.cells(x, shape, 12) == embedding_dedup.cells(0.9 * x + math.sqrt(0.19) * z, shape, 12)
    assert shape[0] and shared.any(axis=1).mean() >= 0.997


# ---------------------------------------------------------------- operator 13


def test_subset_sums_give_inner_products():
    rng = np.random.default_rng(1)
    for dims, top in ((1, 5), (8, 200), (13, 1), (64, 160), (3, 2**29)):
        a, b = (rng.integers(-top, top + 1, (n, dims)) for n in (9, 70))
        planes = int(top).bit_length() + 1
        got = hard_negatives.lookup_scores(hard_negatives.subset_sums(a), hard_negatives.pack_planes(b, planes))
        assert (got == b @ a.T).all()


def brute_negatives(rows, anchors):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v], k) for i, v, k in rows if v is not None and k is not None and all(x is not None and math.isfinite(x) for x in v)]
    ok = [r for r in ok if all(abs(x) < math.sqrt(2**62 / max(1, len(r[1]))) - 1 for x in r[1])]
    out = []
    for a in ok:
        if a[0] is None or not anchors(a[0]):
            continue
        scored = sorted(((-sum(x * y for x, y in zip(a[1], b[1], strict=True)), b[0] is None, b[0] or 0, n, b) for n, b in enumerate(ok) if b is not a and len(b[1]) == len(a[1])), key=lambda s: s[:4])
        for p in [s for s in scored if s[4][2] == a[2]][:5]:
            near = [s for s in scored if s[4][2] != a[2] and 30 * -p[0] <= 100 * -s[0] <= 90 * -p[0]][:10]
            out += [(a[0], p[4][0], rank, s[4][0], -p[0], -s[0]) for rank, s in enumerate(near, 1)]
    return sorted(map(str, out))


@pytest.mark.parametrize("chunk,block", [(1 << 16, 1 << 14), (37, 3)])
def test_hard_negatives(spark, monkeypatch, chunk, block):
    monkeypatch.setattr(hard_negatives, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", block)
    rng = np.random.default_rng(7)
    rows = [(i, (rng.normal(size=12) * 0.3 + (i % 3 == 0)).tolist(), int(rng.integers(0, 4))) for i in range(260)]
    rows += [(i, rows[i % 7][1], int(rng.integers(0, 4))) for i in range(300, 340)]  # ties
    rows += [(320, rows[3][1], 1), (320, rows[3][1], 1), (None, rows[3][1], 1), (None, rows[3][1], 2), (600, [0.5, 0.5], 1), (601, [0.25, 1.0], 1), (602, [0.25, 0.5], 2), (620, [0.0] * 12, 1),
             (640, None, 1), (660, [1.0] * 12, None), (680, [float("nan")] * 12, 1), (700, [1.0, None], 1), (720, [1e30] * 12, 1), (740, [], 1), (741, [], 1), (742, [], 2)]
    frame = vectors(spark, rows)
    got = hard_negatives.hard_negatives(frame, F.col("vec_id") % 20 == 0)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_negatives(rows, lambda i: i % 20 == 0)
    if chunk == 37:
        assert hard_negatives.hard_negatives(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0
        assert hard_negatives.hard_negatives(frame, F.lit(False)).count() == 0
