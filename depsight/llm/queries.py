"""The registered queries: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, line_dedup, pieces, quality, sharding, simhash, suffixes, token_files, topk, toxicity
from .common import read


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(read(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(read(spark, sf_dir, "documents"), width=3, radius=3)


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(read(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encode_round_trip(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(sharding.assign(read(spark, sf_dir, "documents"), shards=40))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op5_line_dedup": OP5, "op8_exact_topk": OP8}


OP8 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""

OP5 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, dense_rank() OVER (ORDER BY doc_id NULLS FIRST, coalesce(text, '')) AS did,
    coalesce(doc_id, -9223372036854775808) AS doc, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), e AS (SELECT rid, did, doc, unnest(ls) AS l, unnest(range(len(ls))) AS i FROM d),
t AS (
  SELECT rid, did, doc, l, i, CASE WHEN trim(l, ' ' || chr(9) || chr(13)) = '' THEN NULL ELSE
    list_transform(string_split_regex(trim(l, ' ' || chr(9) || chr(13)), '[ \t]+'), lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END) END AS ws
  FROM e
), m AS (SELECT *, concat_ws(' ', len(ws), array_to_string(ws[1:3], ' ')) AS leaf, array_to_string(ws, ' ') AS line FROM t),
k AS (SELECT leaf, line, any_value(ws) AS ws, count(DISTINCT rid) AS docs FROM m WHERE ws IS NOT NULL GROUP BY leaf, line),
o AS (SELECT leaf FROM k GROUP BY leaf HAVING count(*) > 1 AND sum(docs) >= 3 AND max(len(ws)) >= 5),
p AS (SELECT leaf, line, docs, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM k WHERE leaf IN (SELECT leaf FROM o)),
x AS (SELECT leaf, line, pos, w, sum(docs) OVER (PARTITION BY leaf, pos, w) AS weight FROM p),
y AS (SELECT leaf, line, list(weight ORDER BY weight DESC)[CAST(ceil(0.7::DOUBLE * count(*)) AS BIGINT)] AS least FROM x GROUP BY leaf, line),
z AS (
  SELECT x.line, x.leaf || chr(1) || string_agg(CASE WHEN weight >= least THEN w ELSE chr(2) END, ' ' ORDER BY pos) AS template
  FROM x JOIN y ON x.line = y.line AND x.leaf = y.leaf WHERE least >= 3 GROUP BY x.leaf, x.line
), h AS (SELECT m.rid, m.i, m.did, m.doc, coalesce(z.template, chr(3) || m.line) AS template FROM m LEFT JOIN z USING (line) WHERE m.ws IS NOT NULL),
r AS (SELECT template, min(doc) AS first FROM h GROUP BY template HAVING count(DISTINCT did) >= 3),
g AS (SELECT rid, i FROM h JOIN r USING (template) WHERE doc <> first),
s AS (SELECT m.rid, m.i, m.l, g.i IS NOT NULL AS gone FROM m LEFT JOIN g ON m.rid = g.rid AND m.i = g.i)
SELECT any_value(d.doc_id) AS doc_id, coalesce(string_agg(s.l, chr(10) ORDER BY s.i) FILTER (NOT gone), '') AS text,
  CAST(count(*) AS INTEGER) AS n_lines, CAST(count(*) FILTER (gone) AS INTEGER) AS n_dropped
FROM s JOIN d USING (rid) GROUP BY rid
"""
