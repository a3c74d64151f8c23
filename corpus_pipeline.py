"""From raw documents to encoded ones: quality rules, near duplicates, repeated passages, mixing, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import mixing, piece_codec, quality_rules, setjoin, suffix
from tesserae.llm.common import stage, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep."""
    return quality_rules.kept(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group linked by 5-word shingles at a Jaccard of 0.8 or more."""
    return setjoin.one_of_each(docs, n=5, percent=80)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 200 bytes or more that occur elsewhere too; no document goes.

    Passages of over 50 words are to go: at about 6 bytes a word all but those of the shortest words reach that length.
    """
    out = suffix.without_repeats(docs, length=200)
    return out.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")) if "n_chars" in docs.columns else out


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the rates say that bring the languages to their target weights; rates are 1 or more, so none
    is lost."""
    return mixing.mixed(docs, table(spark, sf_dir, "labels"), least=1.0)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the round trip of every text."""
    return piece_codec.digests(docs)


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("suffix-array dedup", passages), ("mixing sources to target weights", mixture), ("SentencePiece encoding and decoding", encoded)]

#: Learned rules, components and posteriors are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
