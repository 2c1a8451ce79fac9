"""Operators 9 and 10 and the pipeline."""

import hashlib
import random
import re

import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from spanframe.llm import bpe, decontaminate, surrogates
from spanframe.llm.queries import QUERIES
from tests.llm.conftest import HARD
from tests.llm.test_duplicates import brute_groups, lower

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, items):
    windows = {}
    for name, text in items:
        words = WORD.findall(lower(text or ""))
        width = min(13, len(words))
        for k in range(len(words) - width + 1 if width else 0):
            windows.setdefault(width, {}).setdefault(tuple(words[k: k + width]), set()).add("" if name is None else str(name))
    out = []
    for i, text in docs:
        words = WORD.findall(lower(text or ""))
        hit, names = set(), set()
        for width, known in windows.items():
            for k in range(len(words) - width + 1):
                if (found := known.get(tuple(words[k: k + width]))):
                    hit.update(range(k, k + width))
                    names |= found
        out.append((i, len(words), len(hit), sorted(names), bool(hit) and 20 * len(hit) >= len(words)))
    return out


def test_decontamination(spark, make, monkeypatch):
    rng = random.Random(8)
    items = [(k, " ".join(rng.choice("alpha beta gamma delta EPSILON zeta".split()) + str(rng.randrange(40)) for _ in range(rng.choice([1, 3, 12, 13, 14, 40])))) for k in range(40)]
    items += [(100, None), (101, ""), (102, "..."), (None, "a null id has words"), (7, "another text under id seven")]
    docs = []
    for i in range(150):
        words = [f"w{rng.randrange(10**5)}" for _ in range(rng.choice([5, 60, 400]))]
        for _ in range(rng.randrange(3)):
            text = rng.choice(items)[1] or ""
            part = text.split(" ")
            k = rng.randrange(len(part) + 1)
            words[rng.randrange(len(words)):0] = rng.choice([part, part[k:], [w.upper() + "!" for w in part]])
        docs.append((i, " ".join(words)))
    docs += HARD
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(str, brute(docs, items)))
    for limit in (10**6, 100):  # one broadcast, and several blocks
        monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", limit)
        got = decontaminate.find_contamination(make(docs, items="clash", n_hit=1), benchmark).collect()
        assert sorted(str((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated)) for r in got) == want
    clean = decontaminate.decontaminate(make(docs), benchmark)
    assert clean.columns == make(docs).columns
    assert clean.count() == sum(not x[4] for x in brute(docs, items))
    assert all(r.n_hit == 0 or r.n_hit < 13 for r in decontaminate.find_contamination(clean.where("doc_id < 150"), benchmark).collect())
    assert decontaminate.find_contamination(make(docs).limit(0), benchmark).count() == 0
    assert not decontaminate.find_contamination(make(docs), benchmark.limit(0)).where("n_hit > 0 or contaminated").count()


def test_only_texts_with_a_passage_are_cut_in_python(spark, make):
    passage = " ".join(f"p{i}" for i in range(13))
    long = " ".join(f"w{i}" for i in range(400))
    docs = [(i, f"{long}, {passage}. {long} {i}" if i % 10 == 0 else f"{long} {i}") for i in range(100)]
    marked = decontaminate.find_contamination(make(docs), spark.createDataFrame([(1, passage)], "item_id int, text string"))
    out = decontaminate.remove_spans(marked)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union") and re.search(r"\n\+- MapInArrow.*\n\W+(Project.*\n\W+)?Filter .*size\(hit_spans", plan), plan
    assert {r.doc_id: r.text for r in out.collect()} == {i: f"{long}, . {long} {i}" if i % 10 == 0 else t for i, t in docs}
    one = decontaminate.WindowSet([("a", 13, -5, b"x"), ("b", 13, 7, b"y")])
    assert len(one.maybe) < 1024 and one.maybe.sum() == 2


def test_decontamination_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {(i, n, h, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), c) for i, n, h, names, c in brute(docs, items)}
    assert {tuple(r) for r in QUERIES["op9_decontamination"](spark, sf).collect()} == want


PERSONAL = ("Dear Mr. John Smith, mail John.Smith+x@mail7.example.com or +1 (017) 555-7713; 030/1234567; ip 97.51.17.173 and 2001:db8:0:0:0:0:0:1, card 9807915762804490, "
            "4111 1111 1111 1111, SSN 123-45-6789, DE89 3704 0044 0532 0130 00, token = \"27660c51feb63980dfaee7464f96210544c03fc3\". "
            "Later Smith met Frau Müller and Госпожа Иванова. SMITH")


def test_surrogates_keep_type_format_and_reference(make):
    docs = make([(50, PERSONAL), (51, "Herr Smith wrote to john.smith+x@MAIL7.example.com from 97.51.17.173."), *HARD[:4], (None, "call +1 (017) 555-7713"), (9, "Version 2.0 of 2024-01-02, 3.14159, 12345, a@b")],
                n_entities="clash")
    got = {r.doc_id: r for r in surrogates.replace(docs, b"k").collect()}
    again = {r.doc_id: r for r in surrogates.replace(docs, b"k").collect()}
    other = {r.doc_id: r for r in surrogates.replace(docs, b"another").collect()}
    assert got == again and got[50].text != other[50].text
    before, after = surrogates.find(PERSONAL), surrogates.find(got[50].text)
    assert [x[2] for x in before] == [x[2] for x in after] and got[50].n_entities == len(before)
    mapped = {}
    for a, b in zip(before, after):
        assert mapped.setdefault(a[2:], b[2:]) == b[2:]
    assert len(set(mapped.values())) == len(mapped) and not set(mapped) & set(mapped.values())
    shape = lambda t: re.sub(r"\d", "0", t)
    for kind in ("phone", "card", "ssn"):
        own = [(PERSONAL[a:b], got[50].text[c:d]) for (a, b, k, _), (c, d, _, _) in zip(before, after) if k == kind]
        assert own and all(shape(x) == shape(y) for x, y in own)
    card = next(n for _, _, k, n in after if k == "card" and n[0] == "4")
    assert surrogates._luhn(card[:-1]) == int(card[-1])
    iban = next(n for _, _, k, n in after if k == "iban")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert re.search("Госпожа [А-Я]", got[50].text)
    # across documents: one person, one address, one number
    family = mapped["family", "smith"][1].capitalize()
    assert got[51].text.startswith(f"Herr {family} ") and mapped["ipv4", "97.51.17.173"][1] in got[51].text and mapped["email", "john.smith+x@mail7.example.com"][1] in got[51].text
    assert mapped["phone", "+1:10175557713"][1].rpartition(":")[2] == re.sub(r"\D", "", got[None].text)
    old = {r.doc_id: r.text for r in docs.collect()}
    for i in (1, 2, 3, 4, 9):
        assert (got[i].text, got[i].n_entities) == (old[i], 0)
    assert surrogates.replace(docs.limit(0), b"k").count() == 0


def test_surrogates_draw_again_where_they_meet(spark, make):
    # far more family names than two stems and an ending give
    names = [f"N{chr(97 + k // 26)}{chr(97 + k % 26)}ov" for k in range(26 * 26)]
    docs = make([(k, f"Herr {a} und Frau {b}") for k, (a, b) in enumerate(zip(names, reversed(names)))] * 2 + [(5000 + k, f"Mrs. Quin{k:03d}") for k in range(3)])
    rows = [(k, n) for r in docs.collect() for _, _, k, n in surrogates.find(r.text)]
    table = surrogates.assign(spark.createDataFrame(rows, "kind string, norm string"), b"k").collect()
    assert len(table) == len(set(rows)) and max(r.attempt for r in table) > 0
    assert len({(r.kind, r.surrogate) for r in table}) == len(table)
    assert not {(r.kind, r.surrogate) for r in table} & set(rows)
    known = {(r.kind, r.norm): r.surrogate for r in table}
    for old, new in zip(sorted(docs.collect(), key=lambda r: (r.doc_id, r.text)), sorted(surrogates.replace(docs, b"k").collect(), key=lambda r: r.doc_id)):
        for (a, b, kind, norm), (c, d, *_x) in zip(surrogates.find(old.text), surrogates.find(new.text)):
            assert new.text[c:d].lower() == known[kind, norm]


def test_surrogates_differ_over_all_names_and_all_digits(spark, make):
    # first names of all kinds share stems and endings, far more names than two stems and an ending give
    names = [f"N{chr(97 + k // 26 % 26)}{chr(97 + k % 26)}{'aeiou'[k // 676]}k" for k in range(5 * 676)]
    rows = [(("given-m", "given-f", "given-x", "family")[k % 4], n.lower()) for k, n in enumerate(names)]
    rows += [("given-x", surrogates.Keyed(b"k").surrogate(*rows[0], 0))]  # a real name of another kind
    rows += [(kind, f"{k:09d}") for k in range(0, 10**9, 10**6) for kind in ("ssn", "phone")]
    table = surrogates.assign(spark.createDataFrame(rows, "kind string, norm string"), b"k").collect()
    for kinds in (("family", "given-m", "given-f", "given-x"), ("ssn", "phone")):
        own = [r.surrogate for r in table if r.kind in kinds]
        assert len(own) == len(set(own)) and not set(own) & {n for k, n in rows if k in kinds}


def test_surrogates_of_a_first_name_have_one_gender(make):
    docs = make([(1, "Dr Maria Keller came."), (2, "Frau Maria Weber left."), (3, "Frau Maria Keller."), (4, "Prof. Andrea Weber"), (5, "Herr Andrea Weber"), (6, "Frau Andrea Weber")])
    got = {r.doc_id: r.text.replace(".", "").split() for r in surrogates.replace(docs, b"k").collect()}
    assert got[1][1] == got[2][1] == got[3][1] and got[4][1] == got[5][1] == got[6][1] != got[1][1]
    assert got[1][2] == got[3][2] and got[2][2] == got[4][2] == got[6][2]
    assert got[1][1].endswith(("a", "elle"))


def test_digit_permutations_are_one_to_one():
    keyed = surrogates.Keyed(b"k")
    for n in (1, 2, 3):
        assert len({keyed.permute(f"{i:0{n}d}", "x") for i in range(10**n)}) == 10**n


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "line_dedup", "near_duplicates", "decontamination", "encoding"]
    stages = dict(corpus_pipeline.STAGES)
    extra = docs.sparkSession.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "", "en", "s", 0)], docs.schema)
    one = stages["language"](spark, docs.unionAll(extra), sf)
    assert one.columns == docs.columns and one.count() == docs.count()  # only the two without letters go
    three = stages["near_duplicates"](spark, docs, sf)
    groups = brute_groups([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id for r in three.collect()} == {c for _, c in groups.values()} and three.columns == docs.columns
    four = stages["decontamination"](spark, docs, sf)
    assert {r.doc_id for r in four.collect()} == {x[0] for x in brute([(r.doc_id, r.text) for r in docs.collect()], items) if not x[4]} and four.columns == docs.columns
    final = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(final) <= {r.doc_id for r in docs.collect()}
    tokens = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    for r in docs.collect():  # texts that no stage changed
        if r.doc_id in final and final[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest():
            assert final[r.doc_id].n_tokens == len(library.encode_ordinary(r.text))
    two = stages["line_dedup"](spark, docs, sf)
    assert two.columns == docs.columns and two.where("n_chars <> length(text)").count() == 0
    assert stages["encoding"](spark, docs.limit(0), sf).count() == 0
    assert docs.where(F.col("text").isNull()).count() == 0
