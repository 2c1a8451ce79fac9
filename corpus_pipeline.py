"""From raw documents to encoded training text, in five stages.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and
is written as Parquet and read again before the next. All stages but the last
return the columns of ``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.llm import bpe, decontaminate, language, line_dedup, ngram_join
from spanframe.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: without letters, or far from every language's model, they go.

    The models learn from the labelled documents themselves; where ``lang`` is
    null it becomes the language found.
    """
    models = language.fit(docs)
    found = language.predict(docs.select(*COLUMNS), models).where("not rejected")
    return _documents(found.withColumn("lang", F.coalesce("lang", "lang_pred")))


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that stand elsewhere already; a document of nothing else goes."""
    clean = line_dedup.remove_repeats(docs.select(*COLUMNS), details=True)
    return _documents(clean.where("n_removed = 0 or n_removed < n_lines"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the row with the smallest id (nulls last).

    Rows are numbered first, so repeated and null ids are rows like others.
    """
    numbered = materialize(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "numbered")
    groups = ngram_join.similar_groups(numbered, key="row", count_links=False).select(F.col("doc_id").alias("row"), "component_id")
    placed = groups.join(numbered.select("row", "doc_id"), "row")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    first = placed.groupBy("component_id").agg(F.min(order).alias("f"), F.count("*").alias("n")).where("n > 1").select("component_id", "f.row")
    dropped = placed.join(first.withColumnRenamed("row", "first"), "component_id").where("row <> first").select("row")
    return _documents(numbered.join(materialize(dropped, "near-duplicates"), "row", "left_anti"))


def remove_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without contaminated documents, and without benchmark passages in the others."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _documents(decontaminate.decontaminate(docs.select(*COLUMNS), benchmark))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes."""
    coded = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language", identify_language),
    ("line_dedup", remove_repeated_lines),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", remove_benchmark_passages),
    ("encoding", encode),
]

#: Models and exact near-duplicate components are beyond SQL. Tests hold single stages against brute force, and of run() only
#: that it returns ids of its input and the token counts of unchanged texts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
