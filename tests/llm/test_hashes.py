"""Texts that sums of powers modulo 2**64 cannot tell apart, and what else stands on hashes."""

import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from spanframe.llm import bpe, line_dedup, lm_score, ngram_join, token_counts, toxicity
from spanframe.llm.batches import word_hashes
from spanframe.llm.queries import QUERIES
from tests.llm.test_duplicates import brute_groups


def thue_morse(n: int) -> tuple[str, str]:
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_that_a_power_sum_confuses():
    for n in (64, 128, 1024, 2048, 4096):
        data = np.frombuffer("".join(thue_morse(n)).encode(), np.uint8)
        a, b = word_hashes(data, np.array([0, n]), np.array([n, 2 * n]))
        assert a != b


def test_such_texts_stay_apart_in_one_batch(make):
    pair = [*thue_morse(1024), *thue_morse(4096)]
    docs = make(list(enumerate(pair)) + [(9, pair[0])]).coalesce(1)
    tokens = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, P.path("byte_bpe_50k.json")).collect()}
    assert got == {**{i: len(tokens.encode(t, add_special_tokens=False).ids) for i, t in enumerate(pair)}, 9: got[0]}
    name = P.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.read_ranks(name)) if t}, special_tokens={})
    for r in bpe.encode_documents(docs, name, P.PATTERN).collect():
        text = pair[0] if r.doc_id == 9 else pair[r.doc_id]
        ids = enc.encode_ordinary(text)
        assert (r.n_tokens, r.decoded_sha256) == (len(ids), hashlib.sha256(text.encode()).hexdigest())
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    groups = {r.doc_id: r.component_id for r in ngram_join.similar_groups(docs).collect()}
    assert groups == {0: 0, 1: 1, 2: 2, 3: 3, 9: 0}
    assert len({h for h in lm_score._word_hashes(np.frombuffer("\n".join(pair).encode(), np.uint8), np.array([0, sum(map(len, pair)) + 3]))[0].tolist()}) == 4


def test_sample_of_one_text_an_id(spark, make):
    docs = make([(1, f"hot text number {i}") for i in range(3000)] + [(i, "calm words") for i in range(2, 60)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id long, toxic int")
    seen = []
    real = toxicity.train
    toxicity.train = lambda samples, *a: seen.append(len(samples)) or real(samples, *a)
    try:
        toxicity.fit(docs, labels, per_class=50, epochs=1)
    finally:
        toxicity.train = real
    assert seen == [59]


def test_ids_at_the_end_of_their_range(spark, tmp_path):
    top = 2**63 - 1
    rows = [(top, "x"), (top - 1, "x"), (top - 2, "y"), (None, "y")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.keep_id, r.group_size) for r in QUERIES["op3_exact_dedup"](spark, str(tmp_path)).collect()}
    assert got >= {(top, top, 2), (top - 1, top, 2)}


def test_repeated_rows_and_ids_in_the_near_duplicate_stage(spark, make):
    long = " ".join(f"w{i}" for i in range(60))
    docs = make([(1, long), (1, long), (1, long), (2, long + " end"), (3, "other words that stand alone here"), (3, long), (None, long), (None, "nothing like it at all, truly")], "en")
    kept = sorted(((r.doc_id, r.text) for r in corpus_pipeline.keep_one_of_each_group(spark, docs, "").collect()), key=str)
    assert kept == [(1, long), (3, "other words that stand alone here"), (None, "nothing like it at all, truly")]
    assert brute_groups is not None


def test_column_names_of_the_user_survive_line_dedup(make):
    text = "\n".join(f"a line of some length that is repeated, number {i}" for i in range(6))
    docs = make([(1, text), (2, text)], _key="k", _residue="r", _id="i", _hash="h", _gone="g")
    got = line_dedup.remove_repeats(docs).orderBy("doc_id").collect()
    assert [r.text for r in got] == [text, ""] and all((r._key, r._residue, r._id, r._hash, r._gone) == ("k", "r", "i", "h", "g") for r in got)


def test_lines_of_random_letters_keep_few_states():
    rng = np.random.default_rng(1)
    model = token_counts.read_model(P.path("byte_bpe_50k.json"))
    machine = token_counts.CountTransducer(model)
    lines = ["".join(map(chr, rng.integers(97, 123, 76))) for _ in range(4000)]
    data = np.frombuffer("".join(lines).encode(), np.uint8)
    starts = np.arange(len(lines)) * 76
    got = machine.run(data, starts, starts + 76)
    assert len(machine.states) <= 2 * machine.limit
    tokens = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert got[::400].tolist() == [len(tokens.encode(x, add_special_tokens=False).ids) for x in lines[::400]]


def test_mentions_cost_their_length_and_column_names_survive(make):
    import time

    from spanframe.llm import surrogates
    text = " ".join(f"mail user{i}@host{i}.example.com," for i in range(12_000))
    began = time.perf_counter()
    found = surrogates.find(text)
    assert len(found) == 12_000 and time.perf_counter() - began < 3
    docs = make([(1, "Mr. John Smith, john@mail.example.com"), (2, None)], _id="i", _redrawn="r")
    got = surrogates.replace(docs, b"k").orderBy("doc_id").collect()
    assert [(r._id, r._redrawn) for r in got] == [("i", "r")] * 2 and got[0].n_entities >= 2 and got[1].text is None
