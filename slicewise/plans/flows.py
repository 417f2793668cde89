"""End-to-end flows composed of the operators; each is one lazy plan."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slicewise import constants as K
from slicewise.functions import text as T
from slicewise.operators import bayes, evaluation, report, scores, triage
from slicewise.session import durable
from slicewise.sources import files as read_files


def result_rows(scores_: DataFrame, studies: DataFrame, processed: Column, checkpoint: str = "") -> DataFrame:
    """Scored studies as rows of the result table.

    ``studies`` brings study_uid and exam_date, and may bring patient_id,
    exam_datetime, raw_department, location and series_folder. The location is
    the department's, else the given one, normalised. The caller leaves out studies
    without an exam date; they are not dated today.
    """
    optional = ("patient_id", "exam_datetime", "raw_department", "location", "series_folder")
    have = studies.select("study_uid", F.col("exam_date").cast("date").alias("exam_date"), *[
        T.text(F.col(c)).alias(c) if c in studies.columns else F.lit("").alias(c) for c in optional])
    named = have.withColumn("_raw", F.coalesce(F.nullif("raw_department", F.lit("")), "location")).drop("location")
    return T.with_location(scores_.join(named, "study_uid"), "_raw").select(
        "study_uid", "patient_id", "exam_date",
        F.coalesce(F.nullif("exam_datetime", F.lit("")), F.col("exam_date").cast("string")).alias("exam_datetime"),
        "location", "raw_department", F.col("overall_positive").cast("int").alias("ai_positive"), "dominant_class",
        *[F.col(f"prob_{c}") for c in ("any", *K.SUBTYPES)], "series_folder", F.lit(checkpoint).alias("checkpoint"),
        processed.cast("string").alias("processed_datetime"))


def scanned_results(headers: DataFrame, scored_slices: DataFrame, existing: DataFrame, as_of: dt.date,
                    days_back: int | None = None, min_slices: int = K.MIN_SERIES_SLICES) -> DataFrame:
    """Archive scan: triage -> series choice -> scores of the chosen series -> result rows.

    ``scored_slices`` bring study_uid, series_uid and the scores; slices of other series
    and other studies take no part. Patient, exam time and department come from the
    study's first header, where the headers have them. Studies without a valid exam date
    give no result.
    """
    ready = triage.route_studies(headers, existing, as_of, days_back, min_slices, carry=carried(headers)).filter("status = 'ready'")
    return ready_results(ready, scored_slices)


#: Columns of the first header that a result takes over, where the headers have them.
CARRIED = ("study_time", "patient_id", "institutional_department")


def carried(headers: DataFrame) -> tuple[str, ...]:
    return tuple(c for c in CARRIED if c in headers.columns)


def ready_results(ready: DataFrame, scored_slices: DataFrame) -> DataFrame:
    """Result rows of ready studies (routed rows) from the scores of their chosen series."""
    dated = ready.withColumn("exam_date", F.try_to_date(F.nullif("exam_date", F.lit("")), "yyyy-MM-dd")).filter("exam_date is not null")
    day = F.date_format("exam_date", "yyyyMMdd")
    told = {"exam_datetime": T.compact_datetime(day, F.col("study_time") if "study_time" in ready.columns else F.lit(""))}
    if "institutional_department" in ready.columns:
        told["raw_department"] = F.col("institutional_department")
    dated = dated.withColumns(told)
    chosen = scored_slices.join(dated.select("study_uid", "series_uid"), ["study_uid", "series_uid"], "left_semi")
    return result_rows(scores.study_scores(chosen), dated.drop("series_uid", "slice_count"), F.lit(None))


def scored_archive(headers: DataFrame, blocks: DataFrame, make_predict, shape: tuple[int, ...], existing: DataFrame, as_of: dt.date,
                   days_back: int | None = None, min_slices: int = K.MIN_SERIES_SLICES, block: str = "block") -> tuple[DataFrame, DataFrame]:
    """Archive scan with the scorer in it: (outcomes of all studies, result rows of those without a failure).

    ``blocks`` bring study_uid, series_uid, path and the pixel block; only those of chosen
    series are scored, once. A block that the scorer refuses, or whose study's headers could
    not be read, costs its own study only, which ends as ``error`` with the reason.
    """
    routed = durable(triage.route_studies(headers, existing, as_of, days_back, min_slices, carry=carried(headers)), "routed")
    ready = routed.filter("status = 'ready'")
    chosen = blocks.join(ready.select("study_uid", "series_uid"), ["study_uid", "series_uid"], "left_semi")
    scored = durable(scores.score_isolated(chosen, make_predict, shape, block).drop(block), "scored")
    failures = scores.failed_studies(scored)
    sound = ready.join(failures, "study_uid", "left_anti")
    return triage.with_failures(routed, failures), ready_results(sound, scored)


def staged_scan(files: DataFrame, decode, existing: DataFrame, as_of: dt.date, days_back: int | None = None,
                min_slices: int = K.MIN_SERIES_SLICES, **reading) -> tuple[DataFrame, DataFrame]:
    """Triage that opens one file a study first, and the others only of studies that pass: (routed, headers read).

    ``files`` is a listing (path, and address of members of archives). Studies are their folders, so that a study whose first
    file cannot be read is rejected as itself; ``study_uid`` is what its first header says.
    Every header carries ``stage`` (1 or 2) and ``bytes_read``.
    """
    told = [c for c in ("path", "address") if c in files.columns]
    placed = durable(read_files.file_studies(files.select(told)), "listing")
    spread = placed.groupBy("study_folder").agg(*[F.min_by(c, "path").alias(c) for c in told], F.count(F.lit(1)).alias("n_files"))
    first = durable(read_files.read_heads(read_files.by_frame(spread), decode, **reading).withColumn("stage", F.lit(1)), "first-heads")
    # what grows with the studies meets in sort-merge joins: by the size of its packed files it would pass through the driver
    opened = first.hint("merge")
    uid = F.nullif(F.col("study_uid"), F.lit(""))
    known = (first.select("study_folder", uid.alias("study_uid")).join(existing.select("study_uid").distinct(), "study_uid", "left_semi")
             .select(F.col("study_folder").alias("study_uid")))
    by_folder = first.withColumn("study_uid", F.col("study_folder")).drop("study_folder", "bytes_read", "stage")
    early = triage.route_studies(by_folder, known, as_of, days_back, min_slices=1)
    # the first file alone tells rejection, date and repetition; the choice of a series needs the others
    open_ = early.filter(F.col("status").isin("ready", "no_ncct_series")).select(F.col("study_uid").alias("study_folder"))
    begun = open_.join(opened.select("study_folder", F.col("path").alias("_first")), "study_folder")
    rest = placed.join(begun.hint("merge"), "study_folder").filter(F.col("path") != F.col("_first")).drop("_first")
    second = durable(read_files.read_heads(read_files.by_frame(rest), decode, **reading).withColumn("stage", F.lit(2)), "other-heads")
    headers = first.unionByName(second)
    all_by_folder = headers.withColumn("study_uid", F.col("study_folder")).drop("study_folder", "bytes_read", "stage")
    routed = (triage.route_studies(all_by_folder, known, as_of, days_back, min_slices).drop("n_files")
              .withColumnRenamed("study_uid", "study_folder").join(spread.select("study_folder", "n_files").hint("merge"), "study_folder"))
    return routed.join(opened.select("study_folder", uid.alias("study_uid")), "study_folder"), headers


def screened(slices: DataFrame, indications: DataFrame, sensitivity: float, specificity: float,
             order: tuple[str, ...], stored_prevalence: Column | None = None, with_list: bool = False) -> DataFrame:
    """Batch run: study scores, hot range, assumed prevalence and what it means for each study.

    The stored prevalence (a scalar subquery, say) goes before the prior of the
    indication text. ``with_list`` adds ``hot_slices`` from the same pass over the slices.
    """
    listed = [scores.hot_list().alias("hot_slices")] if with_list else []
    hot = scores.hot_slices(scores.slice_index(slices, order=order)).groupBy("study_uid").agg(
        F.min("slice_index").alias("first_hot"), F.max("slice_index").alias("last_hot"), *listed)
    prior = T.indication_prior(F.col("indication"))
    assumed = prior if stored_prevalence is None else F.coalesce(stored_prevalence, prior)
    joined = (scores.study_scores(slices).join(indications.select("study_uid", "indication"), "study_uid")
              .withColumn("prevalence", assumed).join(hot, "study_uid", "left"))
    return bayes.metrics_at_prevalence(joined, F.col("prevalence"), sensitivity, specificity)


def batch_run(manifest: DataFrame, existing: DataFrame, slices: DataFrame, sensitivity: float, specificity: float,
              order: tuple[str, ...], stored_prevalence: Column | None = None) -> DataFrame:
    """Batch run over a manifest (study_uid, dominant_class, group): one row per study with its outcome.

    Studies on the worklist already are skipped, studies without slices are
    errors, the others carry what goes to the worklist and the report.
    """
    key = F.coalesce(F.nullif("dominant_class", F.lit("")), "group")
    wanted = manifest.select(
        "study_uid", "group", T.lookup(key, K.CLASS_INDICATIONS, K.DEFAULT_INDICATION).alias("indication"),
        T.lookup(key, K.CLASS_PATIENT_NAMES, F.concat(F.lit("DEMO^"), F.upper(key))).alias("patient_name"))
    seen = existing.select("study_uid").distinct().withColumn("_seen", F.lit(True))
    todo = wanted.join(seen, "study_uid", "left_anti")
    done = screened(slices.join(todo.select("study_uid"), "study_uid", "left_semi"), todo, sensitivity, specificity,
                    order, stored_prevalence)
    positive = F.col("overall_positive")
    results = report.report_text(
        done.withColumn("called", F.when(positive, F.col("dominant_class")).otherwise("")), sensitivity, specificity,
        keep=("overall_positive", "called", "prob_any", "prevalence", "ppv", "npv", "pain_index"))
    results = results.withColumnsRenamed({"overall_positive": "ai_positive", "called": "dominant_class"})
    status = (F.when(F.col("_seen"), "skipped").when(F.col("ai_positive").isNull(), "ERROR — no slices")
              .when(F.col("ai_positive"), "OK — POSITIVE").otherwise("OK — negative"))
    return (wanted.join(seen, "study_uid", "left").join(results, "study_uid", "left")
            .withColumn("status", status).drop("_seen"))


def evaluation_summary(scored: DataFrame) -> DataFrame:
    """Test-set evaluation: class metrics beside mean AUC and weighted log loss.

    Everything follows from the counts per distinct score, so the scores are
    read and shuffled once.
    """
    points = evaluation.score_points(evaluation.long_scores(evaluation.finite_rows(scored)))
    metrics = evaluation.metrics_of_points(points)
    losses = evaluation.loss_of_points(points).withColumn("w", evaluation.class_weight())
    overall = W.partitionBy(F.lit(1))  # one row per class: six at most
    weighted = F.sum(F.col("loss") * F.col("w")).over(overall) / F.sum("w").over(overall)
    joined = losses.withColumn("weighted", weighted).join(metrics, "class")
    return joined.select("class", "auc", "sensitivity", "specificity", "threshold", "n_positive", "n_total",
                         F.round(F.avg("auc").over(overall), 6).alias("mean_auc"),
                         F.round("weighted", 6).alias("weighted_log_loss"))
