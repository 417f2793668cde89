"""Token-usage ledger: totals and averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicewise import constants as K


def with_total(calls: DataFrame) -> DataFrame:
    """Blank counts read as 0; ``total_tokens`` is their sum."""
    numbers = {c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in K.LEDGER_NUMBERS}
    first, *rest = [F.col(c) for c in K.LEDGER_NUMBERS]
    return calls.withColumns(numbers).withColumn("total_tokens", sum(rest, start=first))


def count_only(stage: Column) -> Column:
    """Stage tag of a call that only counted tokens."""
    return F.concat(stage, F.lit(" [count_only]"))


def totals_per_study(calls: DataFrame) -> DataFrame:
    numbers = [*K.LEDGER_NUMBERS, "total_tokens"]
    return calls.groupBy("study_id").agg(
        F.count(F.lit(1)).alias("calls"),
        *[F.sum(F.coalesce(F.col(c), F.lit(0))).cast("bigint").alias(c) for c in numbers])


def average_per_study(totals: DataFrame) -> DataFrame:
    return totals.agg(F.count(F.lit(1)).alias("studies"),
                      *[F.round(F.avg(c), 1).alias(f"avg_{c}") for c in ("input_tokens", "output_tokens", "total_tokens")])
