"""The registered query of each operator: production parameters over the whole intended table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicewise.llm import audit, bpe, decontam, extraction, fingerprints, langid, licenses, maxent, mixing, neardup, quality, variants, warc
from slicewise.llm.common import id_crc
from slicewise.session import durable, table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary() -> tuple[str, str]:
    """Path of the rank file and the split pattern."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    first = mixed.select("doc_id", "size", "source_size", "target", "taken", F.get(F.col("copies.position"), F.lit(0)).alias("position"))
    return first.orderBy(F.asc_nulls_last("position"), "doc_id")  # range-sorted; what is not taken comes last


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(table(spark, sf_dir, "documents"), id_crc("doc_id") % 7 == 2)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    signal = durable(quality.signals(table(spark, sf_dir, "documents")), "quality-signals")
    return quality.judge(signal, quality.estimate(signal)).select(
        "doc_id", *quality.BASE, "base_failed", "kept", "posterior")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), *vocabulary())


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"), k=3, percent=85)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_crc("doc_id") % 5 == 0
    model = langid.train(docs, ~held_out)
    return langid.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = licenses.coded_segments(table(spark, sf_dir, "documents"))
    return licenses.judged(lines, *licenses.fit(lines))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group(variants.counted(table(spark, sf_dir, "documents")))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(audit.masks(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digests(decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_mixing, op2_lm_scoring, op3_fingerprints, op4_html_extraction, op5_quality_rules, op6_byte_bpe, op7_warc, op8_near_duplicates, op9_language_id,
    op10_license_scan, op11_spelling_variants, op12_filter_audit, op13_decontamination)}
