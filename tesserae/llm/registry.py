"""The numbered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import oracles
from tesserae.llm.common import table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm import suffix

    return suffix.digests(table(spark, sf_dir, "documents"), length=400)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm import setjoin

    return setjoin.components_of(table(spark, sf_dir, "documents"), n=3, percent=90)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm import url_graph

    return url_graph.judged(table(spark, sf_dir, "pages"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm import mixing

    return mixing.rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), least=1.0)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm import quality_rules

    return quality_rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm import toxicity

    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm import ngram_lm

    return ngram_lm.scored(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm import quality_model

    return quality_model.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm import topk

    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5, scale=256)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, b.vec_id AS vec_id,
    CAST(list_sum(list_transform(range(1, len(q.c) + 1), lambda i: q.c[i] * b.c[i])) AS BIGINT) AS score
  FROM v q JOIN v b ON q.vec_id % 50 = 0 AND q.vec_id <> b.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INT) AS rank, vec_id, score FROM r WHERE n <= 5
"""


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm import piece_codec

    return piece_codec.digests(table(spark, sf_dir, "documents"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm import phrases

    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm import licenses

    return licenses.scan(table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm import divergence

    return divergence.audit(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {"op1_suffix_dedup": op1_suffix_dedup, "op2_ngram_jaccard": op2_ngram_jaccard, "op3_url_filter": op3_url_filter, "op4_source_mixing": op4_source_mixing, "op5_quality_rules": op5_quality_rules, "op6_toxicity": op6_toxicity, "op7_exact_topk": op7_exact_topk, "op10_quality": op10_quality, "op8_sentencepiece": op8_sentencepiece, "op9_lm_scores": op9_lm_scores, "op11_phrases": op11_phrases, "op12_licenses": op12_licenses, "op13_divergence": op13_divergence}


def oracle_sql() -> dict:
    return {"op2_ngram_jaccard": oracles.jaccard_sql(3, 90), "op3_url_filter": oracles.url_sql(), "op7_exact_topk": OP7_SQL, "op11_phrases": oracles.collocation_sql(), "op13_divergence": oracles.divergence_sql()}
