"""The operators of this subpackage over the test tables, each with production parameters, and their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankintel.llm import bpe, chat, fingerprint, graph_index, language, ngram_join, packing, periodic, quality, spelling, substring, topk, urls

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def _table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, root: str) -> DataFrame:
    return fingerprint.fingerprints(_table(spark, root, "documents"))


def op2_bpe(spark: SparkSession, root: str) -> DataFrame:
    return bpe.round_trip(_table(spark, root, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_packing(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack(_table(spark, root, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_ngram_join(spark: SparkSession, root: str) -> DataFrame:
    return ngram_join.components_of(_table(spark, root, "documents"))


def op5_urls(spark: SparkSession, root: str) -> DataFrame:
    return urls.judge(_table(spark, root, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


def op6_quality(spark: SparkSession, root: str) -> DataFrame:
    return quality.classify(_table(spark, root, "documents"))


def op7_chat(spark: SparkSession, root: str) -> DataFrame:
    return chat.rotate(_table(spark, root, "conversations"))


def op8_language(spark: SparkSession, root: str) -> DataFrame:
    docs = _table(spark, root, "documents")
    return language.predict_held_out(docs)


def op9_topk(spark: SparkSession, root: str) -> DataFrame:
    return topk.search(_table(spark, root, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_substring(spark: SparkSession, root: str) -> DataFrame:
    return substring.dedup(_table(spark, root, "documents"))


def op11_neighbours(spark: SparkSession, root: str) -> DataFrame:
    return graph_index.nearest(_table(spark, root, "embeddings"), F.col("vec_id") % 20 == 0)


def op12_spelling(spark: SparkSession, root: str) -> DataFrame:
    return spelling.spelling_groups(_table(spark, root, "documents"), edit=spelling.letter_dropped)


def op13_periodic(spark: SparkSession, root: str) -> DataFrame:
    return periodic.digest(_table(spark, root, "documents"), edit=periodic.planted)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    first = (op1_fingerprints, op2_bpe, op3_packing, op4_ngram_join, op5_urls, op6_quality, op7_chat)
    own = (*first, op8_language, op9_topk, op10_substring, op11_neighbours, op12_spelling, op13_periodic)
    return {query.__name__: query for query in own}


def oracle_sql() -> dict[str, str]:
    return {"op4_ngram_join": OP4, "op5_urls": OP5, "op7_chat": OP7, "op9_topk": OP9, "op10_substring": OP10}


_RULE_ROWS = ", ".join(str(rule) for rule in RULES)

OP5 = rf"""
WITH rules(rhost, rpath, rverdict) AS (VALUES {_RULE_ROWS}),
u AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '^(?s:.)*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^(?s:.)*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
d AS (SELECT DISTINCT host, path FROM u),
m AS (
  SELECT host, path, rhost || rpath AS rule, rverdict,
    row_number() OVER (PARTITION BY host, path ORDER BY length(rhost || rpath) DESC, length(rhost) DESC, rverdict DESC) AS rn
  FROM d JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, u.host, u.path, rule, coalesce(rverdict, 'allow') AS verdict
FROM u LEFT JOIN (SELECT * FROM m WHERE rn = 1) b ON u.host = b.host AND u.path = b.path
"""

OP4 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
x AS (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 2))) AS i FROM w WHERE len(words) > 0),
g AS (SELECT DISTINCT doc_id, list_aggregate(words[i:i + 3], 'string_agg', ' ') AS gram FROM x),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reached = l.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id) LEFT JOIN n USING (doc_id)
"""

OP7 = """
WITH r AS (SELECT DISTINCT conv_id, turn, role, replace(coalesce(text, ''), '<|', '< |') AS body, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM conversations WHERE role <> 'system' AND conv_id IS NOT NULL),
s AS (
  SELECT conv_id, perspective, turn, role AS speaker, text,
    CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user' END AS chat_role,
    CASE WHEN role = perspective OR role = 'system' THEN NULL ELSE role END AS name, body
  FROM r JOIN p USING (conv_id)),
t AS (
  SELECT *, '<|turn|>' || chat_role || coalesce(' ' || replace(name, '<|', '< |'), '') || '<|text|>' AS head, body || '<|end|>' AS tail FROM s),
o AS (
  SELECT *, CAST(coalesce(sum(length(head || tail)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker NULLS FIRST, text
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM t)
SELECT conv_id, perspective, turn, speaker, chat_role, name, head || tail AS segment, start,
  length(head || tail) AS length, start + length(head) AS mask_start,
  CASE WHEN chat_role = 'assistant' THEN length(tail) ELSE 0 END AS mask_length
FROM o
"""

OP9 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND b.vec_id <> a.vec_id AND len(a.q) = len(b.q)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

OP10 = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
x AS (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13),
g AS (SELECT doc_id, i, list_aggregate(words[i:i + 12], 'string_agg', ' ') AS gram FROM x),
f AS (SELECT gram, min(doc_id) AS first FROM g GROUP BY gram),
hit AS (SELECT doc_id, i FROM g JOIN f USING (gram) WHERE doc_id > first),
cut AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM hit),
c AS (SELECT doc_id, list(j) AS js FROM cut GROUP BY doc_id)
SELECT w.doc_id, len(words) AS n_words, coalesce(len(js), 0) AS n_removed,
  sha256(coalesce(list_aggregate(CASE WHEN js IS NULL THEN words ELSE
    list_transform(list_filter(range(1, len(words) + 1), lambda k: NOT list_contains(js, k)), lambda k: words[k]) END, 'string_agg', ' '), '')) AS kept_sha256
FROM w LEFT JOIN c USING (doc_id)
"""
