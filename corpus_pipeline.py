"""The corpus pipeline: quality, language, near-duplicates, mix, tokens.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all rows that the one
before kept. ``run`` writes every stage's rows as Parquet to the shared folder and goes
on from the written table, so that a lost executor costs a re-read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slicewise.llm import bpe, langid, mixing, neardup, quality
from slicewise.llm.common import id_crc
from slicewise.llm.queries import vocabulary
from slicewise.session import durable, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior probability of good quality is at least one half."""
    return quality.keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; those without letters go."""
    return langid.keep_known(docs, langid.train(docs, id_crc("doc_id") % 5 != 0))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group alike at 0.8 on five-word shingles."""
    return neardup.keep_one(docs, k=5, percent=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, once for each copy that the mix takes."""
    return mixing.training_order(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its token ids."""
    return bpe.encode(docs, *vocabulary()).select("doc_id", "lang", "source", "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("language id", language_id),
    ("near duplicates", near_duplicates),
    ("source mix", source_mix),
    ("byte bpe", byte_bpe),
]

#: Expectation-maximisation, trained classifiers and merges are beyond SQL; tests hold the
#: stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
