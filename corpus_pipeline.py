"""A pipeline over documents: each stage works on all that the one before it kept.

Every stage takes whole tables, empty ones too, and passes columns on whatever
their names.  A stage's result does not depend on the order of rows; rows that
repeat are judged one by one, but where a stage says otherwise.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import variorum
from variorum.llm import byte_bpe, decontaminate, near_dedup, substring_dedup, toxicity
from variorum.llm._shared import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    variorum.ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts have the score of the intercept, very long ones are scored whole; without labels none goes.
    """
    return toxicity.without_toxic(docs, _table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that 0.8 of their five-word shingles or more link, one stays, that of the smallest doc_id.

    Null and empty texts are linked with nothing and stay, as do rows without a doc_id; rows that share the doc_id that
    stays are all kept; a similarity of just 0.8 is a link; very long texts are compared whole.
    """
    variorum.ship(spark)
    return near_dedup.without_near_duplicates(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages of 35 words that occur in several places go, from all of them; n_chars follows the text.

    Null texts stay null, shorter ones whole; repeated rows are places of their own, so they lose what they share.
    """
    variorum.ship(spark)
    return substring_dedup.without_repeats(docs)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share ten words in a row with a benchmark item, or the whole of a shorter one, go.

    Null and empty texts stay; without a benchmark all do; very long texts are compared whole.
    """
    return decontaminate.without_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of what they decode to; null counts as empty."""
    variorum.ship(spark)
    return byte_bpe.digest(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("substring_dedup", repeats), ("decontamination", contaminated), ("byte_bpe", tokens)]

#: SQL can express neither the classifier nor the merges; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every other stage is a written table."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
