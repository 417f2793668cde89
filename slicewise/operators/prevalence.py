"""Prevalence store reports: totals, per location, trend, fallback, upsert."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicewise.functions import numeric as N
from slicewise.functions import text as T


def rate(n: Column, pos: Column, min_n: int) -> Column:
    """Positives over studies, six digits; null below ``min_n`` studies or on none."""
    return F.when((n >= min_n) & (n > 0), N.round_even(pos / n, 6))


def window_filter(results: DataFrame, as_of: dt.date, location: str | None = None,
                  days: int | None = None) -> DataFrame:
    """Optional filters. Blank means none; there is no upper date bound."""
    if location:
        results = results.filter(F.col("location") == location)
    if days:
        results = results.filter(F.col("exam_date") >= F.lit(as_of - dt.timedelta(days=days)))
    return results


def prevalence(results: DataFrame, as_of: dt.date, location: str | None = None,
               days: int | None = None, min_n: int = 10) -> DataFrame:
    """One row: n_total, n_positive, prevalence."""
    n, pos = F.col("n_total"), F.col("n_positive")
    return (window_filter(results, as_of, location, days)
            .agg(F.count(F.lit(1)).alias("n_total"),
                 F.coalesce(F.sum(F.col("ai_positive").cast("bigint")), F.lit(0)).alias("n_positive"))
            .withColumn("prevalence", rate(n, pos, min_n)))


def prevalence_by_location(results: DataFrame, as_of: dt.date, days: int | None = None,
                           min_n: int = 10) -> DataFrame:
    """Per location, largest first, and a total row (shown from one study on).

    The roll-up runs over one row per location, so no study row is duplicated.
    """
    per_location = (window_filter(results, as_of, None, days)
                    .groupBy("location")
                    .agg(F.count(F.lit(1)).alias("n"),
                         F.sum(F.col("ai_positive").cast("bigint")).alias("p")))
    n, pos = F.col("n_total"), F.col("n_positive")
    return (per_location.rollup("location")
            .agg(F.grouping("location").alias("is_total"),
                 F.sum("n").alias("n_total"), F.sum("p").alias("n_positive"))
            .select(F.when(F.col("is_total") == 1, "TOTAL").otherwise(F.col("location")).alias("location"),
                    F.col("is_total").cast("int").alias("is_total"), "n_total", "n_positive",
                    F.when(F.col("is_total") == 1, rate(n, pos, 1)).otherwise(rate(n, pos, min_n)).alias("prevalence"),
                    F.when(F.col("is_total") == 1, T.prevalence_text(rate(n, pos, 1), 1))
                    .otherwise(T.prevalence_text(rate(n, pos, min_n), min_n)).alias("shown"))
            .orderBy("is_total", F.desc("n_total"), "location"))


def _buckets(results: DataFrame, as_of: dt.date, period: str, n_periods: int) -> DataFrame:
    spark = results.sparkSession
    i = F.col("bucket")
    today = F.lit(as_of)
    base = spark.range(n_periods).select(F.col("id").cast("int").alias("bucket"))
    if period in ("week", "week_exclusive"):
        start_shift = 7 if period == "week" else 6
        end = F.date_sub(today, i * 7)
        rows = base.select("bucket", F.date_sub(end, start_shift).alias("start_date"), end.alias("end_date"))
        label = F.format_string("W%02d %d", F.weekofyear("end_date"), F.year("end_date"))
    elif period == "year":
        year = F.year(today) - i
        rows = base.select("bucket", F.make_date(year, F.lit(1), F.lit(1)).alias("start_date"),
                           F.make_date(year, F.lit(12), F.lit(31)).alias("end_date"))
        label = F.year("end_date").cast("string")
    elif period == "month":
        start = F.add_months(F.trunc(today, "month"), -i)
        rows = base.select("bucket", start.alias("start_date"), F.last_day(start).alias("end_date"))
        label = F.date_format("start_date", "yyyy-MM")
    else:
        raise ValueError(f"unknown period {period!r}")
    return rows.withColumn("period_label", label)


def _bucket_numbers(day: Column, as_of: dt.date, period: str) -> Column:
    """The buckets a day belongs to: arithmetic instead of a range join."""
    today = F.lit(as_of)
    if period == "year":
        return F.array(F.year(today) - F.year(day))
    if period == "month":
        return F.array((F.year(today) - F.year(day)) * 12 + F.month(today) - F.month(day))
    back = F.datediff(today, day)
    latest = F.floor(back / 7).cast("int")
    if period == "week_exclusive":
        return F.array(latest)
    # Both ends are inclusive: a boundary day also closes the bucket before it.
    return F.when(back % 7 == 0, F.array(latest, latest - 1)).otherwise(F.array(latest))


def trend(results: DataFrame, as_of: dt.date, period: str = "month", n_periods: int = 12,
          location: str | None = None, min_n: int = 10) -> DataFrame:
    """Consecutive calendar buckets, latest first, empty ones included.

    Studies are counted per day first, so what meets the bucket table is one
    row per calendar day. ``week`` shares its boundary days between neighbours;
    ``week_exclusive`` does not.
    """
    days = (window_filter(results, as_of, location).groupBy("exam_date")
            .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("ai_positive").cast("bigint")).alias("p")))
    per_bucket = (days.withColumn("bucket", F.explode(_bucket_numbers(F.col("exam_date"), as_of, period)))
                  .filter((F.col("bucket") >= 0) & (F.col("bucket") < n_periods))
                  .groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("p").alias("p")))
    n, pos = F.coalesce("n", F.lit(0)), F.coalesce("p", F.lit(0))
    return (_buckets(results, as_of, period, n_periods).join(per_bucket, "bucket", "left")
            .select("period_label", "start_date", "end_date",
                    n.alias("n_total"), pos.alias("n_positive"), rate(n, pos, min_n).alias("prevalence"))
            .orderBy(F.desc("start_date")))


def best_prevalence(results: DataFrame, as_of: dt.date, days: int | None = 365, min_n: int = 30,
                    fallback: float | None = None) -> DataFrame:
    """The prevalence to use per location, and without one (location null).

    First tier with ``min_n`` studies wins. With a location: location in the
    last ``days``, location all time, everything all time (skipped too when
    ``days`` is none). Without: everything in the last ``days``, then all time.
    Then the fallback value, else null. All tiers come from one aggregate.
    """
    recent = F.lit(True) if not days else F.col("exam_date") >= F.lit(as_of - dt.timedelta(days=days))
    positive = F.col("ai_positive").cast("bigint")
    per_location = results.groupBy("location").agg(
        F.count_if(recent).alias("n_recent"),
        F.coalesce(F.sum(F.when(recent, positive)), F.lit(0)).alias("p_recent"),
        F.count(F.lit(1)).alias("n_all"), F.sum(positive).alias("p_all"))
    sums = [F.sum(c).alias(c) for c in ("n_recent", "p_recent", "n_all", "p_all")]
    rolled = per_location.rollup("location").agg(F.grouping("location").alias("whole"), *sums)
    total = per_location.agg(F.struct(F.sum("n_all").alias("n"), F.sum("p_all").alias("p")).alias("t")).scalar()

    def source(where: Column, when: str, n: Column, p: Column) -> Column:
        return F.concat(F.lit("observed ("), where, F.lit(f", {when}, n="), n.cast("string"),
                        F.lit(", "), p.cast("string"), F.lit(" positive)"))

    local = F.concat(F.lit("local "), F.col("location"))
    everywhere = F.lit("all locations")
    last = f"last {days}d"
    is_total = F.col("whole") == 1
    n_recent, p_recent, n_all, p_all = (F.col(c) for c in ("n_recent", "p_recent", "n_all", "p_all"))
    tiers = [
        (~is_total & (n_recent >= min_n), n_recent, p_recent, source(local, last, n_recent, p_recent)),
        (~is_total & (n_all >= min_n), n_all, p_all, source(local, "all time", n_all, p_all)),
        (is_total & (n_recent >= min_n), n_recent, p_recent, source(everywhere, last, n_recent, p_recent)),
        (is_total & (n_all >= min_n), n_all, p_all, source(everywhere, "all time", n_all, p_all)),
    ]
    if days:
        n_total, p_total = F.col("_total.n"), F.col("_total.p")
        tiers.append((~is_total & (n_total >= min_n), n_total, p_total,
                      source(everywhere, "all time", n_total, p_total)))
    rate_out, source_out = None, None
    for ok, n, p, words in tiers:
        value = rate(n, p, min_n)
        rate_out = F.when(ok, value) if rate_out is None else rate_out.when(ok, value)
        source_out = F.when(ok, words) if source_out is None else source_out.when(ok, words)
    rest = "no prevalence data available" if fallback is None else "indication default (insufficient local data)"
    return (rolled.withColumn("_total", total)
            .select(F.when(~is_total, F.col("location")).alias("location"),
                    rate_out.otherwise(F.lit(fallback).cast("double")).alias("prevalence"),
                    source_out.otherwise(F.lit(rest)).alias("source")))


def upsert(stored: DataFrame, incoming: DataFrame, key: str, order: str | None = None,
           overlay: bool = False, keep_stored: tuple[str, ...] = ()) -> DataFrame:
    """Merge ``incoming`` into ``stored`` by ``key``; adds ``is_new``.

    Whole-row replacement by default; ``overlay`` replaces only the fields the
    incoming row holds (not null). With ``order`` the last incoming row per key
    wins. One full outer join; a row is new when no stored row matches.
    """
    if order:
        payload = F.struct(*incoming.columns)
        incoming = (incoming.groupBy(key).agg(F.max_by(payload, F.col(order)).alias("_row"))
                    .select("_row.*"))
    columns = [c for c in stored.columns if c != key]
    left = stored.select(F.col(key), F.struct(*columns).alias("_old"))
    right = incoming.select(F.col(key), F.struct(*[
        F.col(c) if c in incoming.columns else F.lit(None).cast(stored.schema[c].dataType).alias(c)
        for c in columns]).alias("_new"))
    has_new = F.col("_new").isNotNull()

    def pick(c: str) -> Column:
        old, new = F.col(f"_old.{c}"), F.col(f"_new.{c}")
        if overlay or c in keep_stored:
            return F.coalesce(new, old).alias(c)
        return F.when(has_new, new).otherwise(old).alias(c)

    return (left.join(right, key, "full_outer")
            .select(key, *[pick(c) for c in columns],
                    (F.col("_old").isNull() & has_new).alias("is_new")))


def known_keys(results: DataFrame, key: str = "study_uid") -> DataFrame:
    return results.select(key).distinct()
