"""Reading worklist: order, row view, flags, entry upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicewise.functions import text as T
from slicewise.operators.prevalence import upsert


def tier(stat: Column, positive: Column) -> Column:
    """0 physician STAT, 1 AI positive, 2 the rest; absent flags are false."""
    return (F.when(F.coalesce(stat, F.lit(False)), 0)
            .when(F.coalesce(positive, F.lit(False)), 1).otherwise(2))


def ordered(entries: DataFrame) -> DataFrame:
    """Serving order: tier, then exam time (text), then uid."""
    return entries.orderBy(tier(F.col("physician_stat"), F.col("ai_positive")),
                           F.coalesce("exam_time", F.lit("")), "study_uid")


def row_view(entries: DataFrame) -> DataFrame:
    """What a worklist row shows."""
    t = tier(F.col("physician_stat"), F.col("ai_positive"))
    finding = F.when(F.col("ai_positive"), F.coalesce(F.nullif(F.col("dominant_class"), F.lit("")),
                                                      F.lit("ICH detected"))).otherwise(F.lit("No ICH"))
    dash = F.lit("—")
    at = F.when(F.col("prevalence") > 0, F.concat(T.fixed(F.col("prevalence") * 100, 0), F.lit("%"))).otherwise(dash)
    name = F.coalesce(F.nullif(F.col("patient_name"), F.lit("")), F.col("patient_id"))
    return entries.select(
        "study_uid", t.alias("tier"),
        F.element_at(F.array(F.lit("STAT"), F.lit("AI△ICH"), F.lit("AI neg")), t + 1).alias("badge"),
        name.alias("patient"), F.coalesce(F.nullif(F.col("indication"), F.lit("")), dash).alias("indication"),
        finding.alias("finding"),
        F.coalesce(T.fixed(F.col("prob_any"), 3), dash).alias("score"),
        F.concat(F.coalesce(T.percent(F.col("ppv")), dash), F.lit(" @"), at).alias("ppv_at"),
        F.coalesce(T.fixed(F.col("pain_index"), 2), dash).alias("pain"), "exam_time")


def priority_flags(results: DataFrame) -> DataFrame:
    pos = F.col("ai_positive")
    return results.select(
        "study_uid", pos.alias("ai_priority_flag"),
        F.when(pos, "AI_ICH_DETECTED").otherwise("AI_ICH_NEGATIVE").alias("flag_type"),
        F.when(pos, F.concat(F.lit("AI-detected "), F.col("dominant_class")))
        .otherwise("AI screening negative — routine read").alias("flag_reason"))


def upsert_entries(stored: DataFrame, incoming: DataFrame, now: str, order: str | None = None) -> DataFrame:
    """Field-wise overlay by study; new entries get defaults, every touched entry a new processed time.

    Columns missing from ``incoming`` keep their stored value. A new entry
    without an exam time takes ``now``.
    """
    stamped = incoming.withColumn("processed_time", F.lit(now))
    merged = upsert(stored, stamped, "study_uid", order=order, overlay=True)
    new = F.col("is_new")
    filled = {"physician_stat": F.lit(False), "ai_positive": F.lit(False), "exam_time": F.lit(now)}
    return merged.withColumns({c: F.when(new, F.coalesce(F.col(c), v)).otherwise(F.col(c))
                               for c, v in filled.items()})


def merge_maps(old: Column, new: Column) -> Column:
    """Overlay of two maps: the new value wins wherever the new map has the key."""
    return F.map_zip_with(F.coalesce(old, F.create_map().cast("map<string,string>")),
                          F.coalesce(new, F.create_map().cast("map<string,string>")),
                          lambda _, a, b: F.coalesce(b, a))


def find_study(entries: DataFrame, study_uid: str) -> DataFrame:
    return entries.filter(F.col("study_uid") == study_uid).limit(1)
