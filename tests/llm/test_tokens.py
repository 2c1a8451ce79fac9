"""Operators 1 and 7 against the libraries."""

import hashlib
import random

import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanframe.llm import bpe, token_counts
from tests.llm.conftest import HARD

PARTS = ["a", "b", "th", "ing", " ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "1", "23", "é", "ß", "漢", "字", "🎉", "!", "--", " ", "́", "ё", "٣", "\x1c",
         "\x85", "st", "'ve", "'d", " '", "’", "<|endoftext|>", " ", "İ", "ǅ"]
TIKTOKEN = P.path("byte_bpe_multi_50k.tiktoken")
JSON = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(5)
    out = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    out += ["".join(chr(rng.choice([97, 98, 99, 101, 116, 104, 105, 110, 103, 115, 0xE9, 0x4E2D])) for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    return out + ["x" * 5000, "ab" * 700, " " * 3000, "", "a b " * 900_000, "<|endoftext|>" * 3]


def batch(values):
    return pa.RecordBatch.from_arrays([pa.array(values, pa.string())], names=["text"])


def test_bpe_equals_tiktoken(cases):
    tokens = bpe.read_ranks(TIKTOKEN)
    library = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    counts, ids, texts, lists = bpe.encode_batch(batch(cases), "text", bpe.Encoder(tokens), bpe.tiktoken_splitter(P.PATTERN), True)
    for k, case in enumerate(cases):
        want = library.encode_ordinary(case)
        assert lists[k] == want and counts[k] == len(want)
        assert ids[k] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert texts[k] == hashlib.sha256(case.encode()).hexdigest()


def test_counts_equal_tokenizers(cases):
    library = Tokenizer.from_file(JSON)
    model = token_counts.read_model(JSON)
    size, count = token_counts.count_batch(batch(cases), "text", token_counts.CountTransducer(model, states=4000), token_counts.library_splitter(), model["special"])
    for k, case in enumerate(cases):
        assert count[k] == len(library.encode(case, add_special_tokens=False).ids), case[:80]
        assert size[k] == len(case.encode())


def test_hard_rows(make):
    docs = make(HARD, n_tokens="clash", ids_sha256=1)
    got = bpe.encode_documents(docs, TIKTOKEN, P.PATTERN, with_ids=True)
    assert set(got.columns) == {*docs.columns, "decoded_sha256", "token_ids"}
    rows = got.where("doc_id <= 7").collect()
    assert len(rows) == 8
    by = {r.doc_id: r for r in rows}
    empty = hashlib.sha256(b"").hexdigest()
    assert by[1].n_tokens == by[2].n_tokens == 0 and by[1].ids_sha256 == empty and by[1].decoded_sha256 == empty and by[1].token_ids == []
    assert by[5].ids_sha256 == by[6].ids_sha256
    counted = {r.doc_id: r for r in token_counts.count_tokens(docs, JSON, limit=10).where("doc_id is not null").collect()}
    assert (counted[1].n_bytes, counted[1].n_tokens, counted[1].over_limit) == (0, 0, False)
    assert counted[4].over_limit and counted[4].n_bytes == 22 * 200_000
    assert bpe.encode_documents(docs.limit(0), TIKTOKEN, P.PATTERN).count() == 0
    assert token_counts.count_tokens(docs.limit(0), JSON).count() == 0


def test_lone_pieces_longer_than_a_slice():
    # one letter run without a place to cut
    tokens = bpe.read_ranks(TIKTOKEN)
    case = "ab" * 20_000
    library = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    counts, *_ = bpe.encode_batch(batch([case]), "text", bpe.Encoder(tokens), bpe.tiktoken_splitter(P.PATTERN), False)
    assert counts[0] == len(library.encode_ordinary(case))


def test_query_columns(spark):
    from spanframe.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    assert QUERIES["op1_token_counts"](spark, sf).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    got = QUERIES["op7_bpe_codec"](spark, sf)
    want = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.sha2("text", 256).alias("decoded_sha256"))
    assert got.join(want, ["doc_id", "decoded_sha256"]).count() == want.count()
