"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.llm import (
    bpe, conversation_repair, decontaminate, embedding_dedup, exact_dedup, hard_negatives, language, line_dedup, lm_score, ngram_join, surrogates,
    token_counts, toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), limit=1024).drop("text")


def remainder(divisor: int) -> Column:
    # a null id is as an empty one
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", remainder(3) == 1)
    models = language.fit(docs.where("not held_out"))
    found = language.predict(docs.select("doc_id", "text", "held_out"), models)
    return found.select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "n_symbols", "rejected")


@query
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # the lower half of the id range stands for what earlier loads have seen
    edge = docs.agg(((F.min("doc_id").cast("decimal(20,0)") + F.max("doc_id")) / 2).alias("edge")).first()["edge"]
    return exact_dedup.dedup(docs, F.col("doc_id") <= F.lit(edge)).drop("known")


SQL["op3_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                         decontaminate.items_digest(F.col("items")).alias("items_sha256"), "contaminated")


@query
def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"))


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # the rule of the SQL below: cuts only, so single lines and parts of passages stay
    clean = line_dedup.remove_repeats(docs, details=True, whole=False)
    return clean.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


LINE_SQL = """lines AS (
    SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, unnest(string_split(text, chr(10))) AS line FROM documents),
cuts AS (
    SELECT doc_id, i, s, substr(md5(lag(md5(line)) OVER (PARTITION BY doc_id, s ORDER BY i) || md5(line) || s), 32, 1)
        IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') AS cut FROM lines, (VALUES ('0'), ('1'), ('2')) AS v(s)),
ends AS (
    SELECT DISTINCT a.doc_id, a.i AS f, coalesce(min(CASE WHEN b.cut THEN b.i END), max(b.i)) AS l
    FROM lines a JOIN cuts b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i + 1 AND a.i + 7 GROUP BY a.doc_id, a.i, b.s),
pieces AS (
    SELECT e.doc_id, f, l, string_agg(line, chr(10) ORDER BY i) AS piece FROM ends e JOIN lines x ON x.doc_id = e.doc_id AND x.i BETWEEN f AND l
    GROUP BY e.doc_id, f, l HAVING length(string_agg(line, chr(10) ORDER BY i)) >= 100),
ranked AS (SELECT *, row_number() OVER (PARTITION BY piece ORDER BY doc_id, f) AS place FROM pieces),
gone AS (SELECT DISTINCT x.doc_id, x.i FROM ranked r JOIN lines x ON x.doc_id = r.doc_id AND x.i BETWEEN f AND l WHERE place > 1),
cleaned AS (
    SELECT x.doc_id, count(*) AS n_lines, count(g.i) AS n_removed, string_agg(line, chr(10) ORDER BY x.i) FILTER (g.i IS NULL) AS text
    FROM lines x LEFT JOIN gone g USING (doc_id, i) GROUP BY x.doc_id)"""

SQL["op5_line_dedup"] = f"""WITH {LINE_SQL}
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(c.text, '')) AS text_sha256
FROM documents d LEFT JOIN cleaned c USING (doc_id)"""


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", remainder(4) == 2)
    model = toxicity.fit(docs.where("not held_out"), table(spark, sf_dir, "labels").where(remainder(4) != 2))
    return toxicity.score(docs.select("doc_id", "text", "held_out"), model).drop("text")


@query
def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm_score.score_documents(docs, table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"))


@query
def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a fixed key, so that runs can be compared; real use passes a secret one
    return surrogates.replace(table(spark, sf_dir, "documents").select("doc_id", "text"), secret=b"spanframe surrogate key")


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


SQL["op13_hard_negatives"] = """WITH r AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
    FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER w AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY rank <= 10"""


@query
def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


SQL["op12_embedding_dedup"] = """WITH RECURSIVE r AS (
    SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS MATERIALIZED (
    SELECT a.vec_id AS u, b.vec_id AS v FROM r a JOIN r b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (SELECT vec_id AS u, vec_id AS v FROM r UNION SELECT reach.u, e.v FROM reach JOIN e ON reach.v = e.u),
low AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u),
n AS (SELECT u, count(*) AS n_links FROM e GROUP BY u)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept
FROM embeddings d LEFT JOIN low ON low.u = d.vec_id LEFT JOIN n ON n.u = d.vec_id"""


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with planted faults by the checksum of their name; a dropped turn stays with ``present`` false."""
    space = F.lit(" ")
    name = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    fault = F.crc32(name.cast("binary")) % 20
    text = F.coalesce("text", space)
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(fault == 4, "user").otherwise(F.coalesce("role", space))
    times = F.explode(F.sequence(F.lit(1), F.when(fault == 3, 2).otherwise(1))).alias("copy")
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), (fault != 0).alias("present"), times)


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.summarise(damaged(table(spark, sf_dir, "conversations")), present=F.col("present"))


SQL["op11_conversation_repair"] = r"""WITH RECURSIVE
t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc),
convs AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
d AS (SELECT c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(x.conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
    FROM conversations x JOIN convs ON x.conv_id IS NOT DISTINCT FROM convs.conv_id),
f AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(name, ''), lambda s: ascii(s)::BIGINT)),
    lambda r, b: xor(crc[(xor(r, b) & 255) + 1], r >> 8)), 4294967295) % 20 AS fault FROM d, t),
turns AS (
    SELECT c, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM f JOIN (VALUES (1), (2)) AS v(copy) ON fault <> 0 AND (copy = 1 OR fault = 3)),
marked AS (
    SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY turn NULLS FIRST) > 1 AS again,
        right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last FROM turns),
r AS (
    SELECT *, row_number() OVER w AS i, left(role, 1) AS x, last = '' AS blank, last <> '' AND again AS dup,
        last <> '' AND NOT again AND last NOT IN ('.', '!', '?') AS short, left(role, 1) || lead(left(role, 1)) OVER w AS pair
    FROM marked WINDOW w AS (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, again)),
ins(p, q, cost, edits) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 2, 'I'), (1, 2, 2, 'I'), (2, 3, 2, 'I'), (3, 2, 2, 'I'),
    (0, 3, 4, 'II'), (1, 3, 4, 'II')),
step(p, x, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
moves AS (
    SELECT p, NULL AS x, p AS q, 3 AS cost, 'D' AS edit FROM ins WHERE p = q
    UNION ALL SELECT p, x, q, 0, 'K' FROM step
    UNION ALL SELECT p, NULL, q, 2, 'R' FROM step WHERE x <> 's'),
dp AS (
    SELECT c, 0::BIGINT AS i, 0 AS state, {'cost': 0, 'edits': ''} AS best FROM convs
    UNION ALL
    SELECT c, i, state, min({'cost': cost, 'edits': edits}) FROM (
        SELECT dp.c, r.i, moves.q AS state, dp.best.cost + ins.cost + moves.cost + CASE WHEN moves.edit <> 'D' AND r.short THEN 1 ELSE 0 END AS cost,
            dp.best.edits || ins.edits || moves.edit AS edits
        FROM dp JOIN r ON r.c = dp.c AND r.i = dp.i + 1 JOIN ins ON ins.p = dp.state
        JOIN moves ON moves.p = ins.q AND (moves.x IS NULL OR moves.x = r.x) AND (moves.edit = 'D' OR NOT (r.blank OR r.dup))) GROUP BY c, i, state),
counts AS (
    SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate,
        count(*) FILTER (short) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY c),
done AS (
    SELECT dp.c, min({'cost': dp.best.cost + ins.cost, 'edits': dp.best.edits || ins.edits}) AS best
    FROM dp LEFT JOIN counts ON counts.c = dp.c JOIN ins ON ins.p = dp.state AND ins.q IN (0, 3) WHERE dp.i = coalesce(n, 0) GROUP BY dp.c),
edits AS (
    SELECT c, j, e, count(*) FILTER (e <> 'I') OVER w AS i, count(*) FILTER (e <> 'D') OVER w AS place, count(*) FILTER (e <> 'D') OVER (PARTITION BY c) AS kept
    FROM (SELECT c, unnest(range(1, length(best.edits) + 1)) AS j, unnest(string_split(best.edits, '')) AS e FROM done WHERE best.edits <> '')
    WINDOW w AS (PARTITION BY c ORDER BY j)),
texts AS (
    SELECT edits.c, string_agg(CASE WHEN e = 'K' THEN role WHEN (place - kept % 2) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END,
        chr(10) ORDER BY j) AS repaired
    FROM edits LEFT JOIN r ON r.c = edits.c AND r.i = edits.i WHERE e <> 'D' GROUP BY edits.c)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, best.cost::BIGINT AS cost, best.edits AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM convs JOIN done USING (c) LEFT JOIN counts USING (c) LEFT JOIN texts USING (c)"""
