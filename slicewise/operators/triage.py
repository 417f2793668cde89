"""Archive triage: study folders, header checks, series roll-up and choice."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slicewise import constants as K
from slicewise.functions import text as T


def study_folders(files: DataFrame) -> DataFrame:
    """Candidate study folders of a file listing.

    A folder that holds files counts as a series folder when a sibling holds
    files too; then the parent is the study folder, else the folder itself.
    Files are counted per folder on the map side; the rest is aggregates over
    folders, so neither a huge folder nor a huge parent meets one task whole.
    """
    dirs = files.groupBy(T.parent_path(F.col("path")).alias("dir")).agg(F.count(F.lit(1)).alias("n_files"))
    parents = dirs.groupBy(T.parent_path(F.col("dir")).alias("parent")).agg(
        F.count(F.lit(1)).alias("n_dirs"), F.min("dir").alias("only"), F.sum("n_files").alias("n_files"))
    study = F.when(F.col("n_dirs") >= 2, F.col("parent")).otherwise(F.col("only"))
    return parents.groupBy(study.alias("study_folder")).agg(F.sum("n_files").alias("n_files"))


def unvisited(folders: DataFrame, visited: DataFrame, key: str = "study_folder") -> DataFrame:
    return folders.join(visited.select(key), key, "left_anti")


def stores_complete(entries: DataFrame, stores: list[str], key: str = "image_id", store: str = "store") -> DataFrame:
    """Keys present in every one of the named stores: one bit per store, one shuffle."""
    bit = F.coalesce(*[F.when(F.col(store) == s, F.lit(1 << i)) for i, s in enumerate(stores)], F.lit(0))
    return (entries.groupBy(key).agg(F.bit_or(bit).alias("_bits"))
            .filter(F.col("_bits") == (1 << len(stores)) - 1).select(key))


def reject_reason(error: Column, modality: Column, description: Column) -> Column:
    """Why a study is not a head CT candidate; blank when it is one.

    Words of other body parts win over head words, and everything without such
    a word stays a candidate.
    """
    mod = T.strip(F.upper(T.text(modality)))
    return (F.when(error.isNotNull(), F.lit("header_read_error"))
            .when((mod != "") & (mod != "CT"), F.concat(F.lit("wrong_modality_"), mod))
            .when(T.contains_any(F.lower(T.text(description)), K.NON_HEAD_WORDS), F.lit("non_head_desc"))
            .otherwise(F.lit("")))


def file_groups(headers: DataFrame) -> DataFrame:
    """Files per study, series and readability: attributes of the first file by path, and the count.

    The only step that touches single files; study checks and series choice
    both go on from here.
    """
    uid = F.coalesce(F.col("series_uid"), F.lit("unknown"))
    attrs = [c for c in headers.columns if c not in ("study_uid", "series_uid")]
    return (headers.groupBy("study_uid", uid.alias("series_uid"), F.col("error").isNull().alias("readable"))
            .agg(F.min_by(F.struct(*attrs), F.col("path")).alias("f"), F.count(F.lit(1)).alias("slice_count"))
            .select("study_uid", "series_uid", "readable", "f.*", "slice_count")
            .withColumnRenamed("path", "first_path"))


def date_cutoff(exam_date: Column, as_of: dt.date, days_back: int | None) -> Column:
    """True for studies before the cut-off. ISO text compare; no date passes."""
    if not days_back:
        return F.lit(False)
    cutoff = (as_of - dt.timedelta(days=days_back)).isoformat()
    return (exam_date != "") & (exam_date < cutoff)


def series_rollup(headers: DataFrame) -> DataFrame:
    """One row per series: attributes of its first readable file, and the file count."""
    return _series(file_groups(headers))


def _series(groups: DataFrame) -> DataFrame:
    return (groups.filter("readable").drop("readable", "error")
            .withColumn("series_folder", T.parent_path(F.col("first_path"))))


def scored_series(series: DataFrame, min_slices: int = K.MIN_SERIES_SLICES) -> DataFrame:
    """Adds description score, numeric thickness and whether the series is an axial non-contrast head CT."""
    contrast = F.lower(T.strip(T.text(F.col("contrast_bolus_agent"))))
    first_type = F.upper(T.text(F.get("image_type", F.lit(0))))
    scored = series.withColumns({
        "score": T.description_score(F.col("series_description")),
        "thickness": T.number_or(F.col("slice_thickness"), K.UNKNOWN_THICKNESS)})
    return scored.withColumn(
        "qualifies",
        (F.upper(T.text(F.col("modality"))) == "CT")
        & contrast.isin("", "none", "n/a")
        & (first_type != "DERIVED")
        & (F.col("slice_count") >= min_slices)
        & ((F.col("score") > 0) | (T.strip(T.text(F.col("series_description"))) == "")))


def _series_rank() -> Column:
    """Score, then thinnest, then file order."""
    return F.struct((-F.col("score")).alias("a"), F.col("thickness").alias("b"), F.col("first_path").alias("c"))


def select_series(series: DataFrame, min_slices: int = K.MIN_SERIES_SLICES) -> DataFrame:
    """The best qualifying series per study.

    An aggregate, not a window: map tasks already reduce each study to one row.
    """
    able = scored_series(series, min_slices).filter("qualifies").drop("qualifies")
    return _best_per_study(able, _series_rank())


def select_series_simple(series: DataFrame) -> DataFrame:
    """Batch-run rule: CT exactly, original before derived, then thinnest."""
    derived = F.coalesce(F.get("image_type", F.lit(0)) == "DERIVED", F.lit(False)).cast("int")
    rows = series.filter(F.col("modality") == "CT").withColumn(
        "thickness", T.number_or(F.col("slice_thickness"), K.UNKNOWN_THICKNESS))
    return _best_per_study(rows, F.struct(derived.alias("a"), F.col("thickness").alias("b"),
                                          F.col("first_path").alias("c")))


def _best_per_study(rows: DataFrame, rank: Column) -> DataFrame:
    fields = [c for c in rows.columns if c != "study_uid"]
    return (rows.groupBy("study_uid").agg(F.min_by(F.struct(*fields), rank).alias("s"))
            .select("study_uid", "s.*"))


def route_studies(headers: DataFrame, existing: DataFrame, as_of: dt.date, days_back: int | None = None,
                  min_slices: int = K.MIN_SERIES_SLICES, requested: DataFrame | None = None,
                  carry: tuple[str, ...] = ()) -> DataFrame:
    """Status of every study and, where it is ready, its chosen series.

    Order: not_head_ct, date_filtered, already_processed, no_ncct_series,
    ready. An unreadable first file rejects the study. Files are aggregated to series once, and
    one more aggregate takes both the first header and the best series from them.
    With ``requested`` (study_uid) exactly those studies come back, also the ones
    without any file. ``carry`` names columns of the first header to hand on.
    """
    return route_groups(file_groups(headers), existing, as_of, days_back, min_slices, requested, carry)


def route_groups(groups: DataFrame, existing: DataFrame, as_of: dt.date, days_back: int | None = None,
                 min_slices: int = K.MIN_SERIES_SLICES, requested: DataFrame | None = None,
                 carry: tuple[str, ...] = ()) -> DataFrame:
    """:func:`route_studies` from the rows of :func:`file_groups`, wherever these were counted."""
    groups = scored_series(groups.withColumn("series_folder", T.parent_path(F.col("first_path"))), min_slices)
    able = F.col("readable") & F.col("qualifies")
    studies = groups.groupBy("study_uid").agg(
        F.min_by(F.struct("study_date", "error", "modality", "study_description", *carry), F.col("first_path")).alias("h"),
        F.min_by(F.struct("series_uid", "series_folder", "slice_count"), F.when(able, _series_rank())).alias("s"),
        F.sum("slice_count").alias("n_files"))
    checked = studies.select(
        "study_uid", "n_files", "s", T.compact_date(F.col("h.study_date")).alias("exam_date"),
        reject_reason(F.col("h.error"), F.col("h.modality"), F.col("h.study_description")).alias("reason"),
        *[F.col(f"h.{c}").alias(c) for c in carry])
    if requested is not None:
        checked = (requested.select("study_uid").distinct().join(checked, "study_uid", "left")
                   .fillna(0, ["n_files"]).fillna("", ["exam_date"]).fillna("no_dcm_files", ["reason"]))
    known = existing.select("study_uid").distinct().withColumn("_known", F.lit(True))
    status = (F.when(F.col("reason") != "", F.lit("not_head_ct"))
              .when(date_cutoff(F.col("exam_date"), as_of, days_back), F.lit("date_filtered"))
              .when(F.col("_known"), F.lit("already_processed"))
              .when(F.col("s").isNull(), F.lit("no_ncct_series")).otherwise(F.lit("ready")))
    routed = checked.join(known, "study_uid", "left").withColumn("status", status)
    picked = [F.when(F.col("status") == "ready", F.col(f"s.{c}")).alias(c) for c in ("series_uid", "series_folder", "slice_count")]
    return routed.select("study_uid", "status", "reason", "exam_date", "n_files", *picked, *carry)


def with_failures(routed: DataFrame, failures: DataFrame) -> DataFrame:
    """Outcomes after scoring: a ready study named in ``failures`` (study_uid, reason) ends as ``error`` with that reason."""
    failed = failures.select("study_uid", F.col("reason").alias("_failure"))
    broken = (F.col("status") == "ready") & F.col("_failure").isNotNull()
    return (routed.join(failed, "study_uid", "left")
            .withColumn("reason", F.when(broken, F.col("_failure")).otherwise(F.col("reason")))
            .withColumn("status", F.when(broken, F.lit("error")).otherwise(F.col("status"))).drop("_failure"))


def scan_counters(routed: DataFrame, elapsed_seconds: float | None = None) -> DataFrame:
    """Studies and slices per status, each with its share of all studies."""
    per = routed.groupBy("status").agg(F.count(F.lit(1)).alias("n_studies"),
                                       F.coalesce(F.sum("slice_count"), F.lit(0)).alias("n_slices"))
    total = F.sum("n_studies").over(W.partitionBy(F.lit(1)))  # one row per status: a handful
    out = per.select("status", "n_studies", "n_slices", F.round(F.col("n_studies") / total, 6).alias("share"))
    if elapsed_seconds:
        out = out.withColumn("slices_per_second", F.col("n_slices") / F.lit(float(elapsed_seconds)))
    return out


def run_counters(outcomes: DataFrame) -> DataFrame:
    """Batch-run outcomes per group: processed, skipped, errors."""
    s = F.col("status")
    failed = s.startswith("ERROR") | s.startswith("SKIP")
    return outcomes.groupBy("group").agg(
        F.count_if(s == "skipped").alias("skipped"), F.count_if(failed).alias("errors"),
        F.count_if((s != "skipped") & ~failed).alias("processed"))


def best_file_group(members: DataFrame) -> DataFrame:
    """Per archive the folder to use: 'thin' in its path first, then most files, then first seen."""
    groups = (members.filter(F.lower("path").endswith(".dcm"))
              .withColumn("folder", T.parent_path(F.col("path")))
              .groupBy("archive", "folder")
              .agg(F.count(F.lit(1)).alias("n_files"), F.min("position").alias("_first")))
    thin = F.lower("folder").contains("thin").cast("int")
    rank = F.struct((-thin).alias("a"), (-F.col("n_files")).alias("b"), F.col("_first").alias("c"))
    return (groups.groupBy("archive").agg(F.min_by(F.struct("folder", "n_files"), rank).alias("g"))
            .select("archive", "g.*"))


def best_group_members(members: DataFrame) -> DataFrame:
    """The files of each archive's chosen folder."""
    best = best_file_group(members).select("archive", "folder")
    return (members.filter(F.lower("path").endswith(".dcm"))
            .withColumn("folder", T.parent_path(F.col("path"))).join(best, ["archive", "folder"]))
