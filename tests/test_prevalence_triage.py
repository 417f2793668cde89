import datetime as dt

import pytest
from pyspark.sql import functions as F

from slicewise import constants as K
from slicewise import schemas
from slicewise.operators import prevalence as P
from slicewise.operators import scores, triage, worklist
from slicewise.plans import flows
from slicewise.sources import tables

DAY = dt.date(2024, 12, 30)


def results(spark, rows):
    return spark.createDataFrame(rows, "study_uid string, location string, exam_date date, ai_positive int")


def many(location, date, n, pos, tag=""):
    return [(f"{location}{date}{tag}{i}", location, date, int(i < pos)) for i in range(n)]


def test_minimum_count(spark):
    df = results(spark, many("ER", DAY, 9, 3))
    assert P.prevalence(df, DAY).first()["prevalence"] is None
    assert P.prevalence(df, DAY, min_n=9).first()["prevalence"] == 0.333333
    assert P.prevalence(df.filter("false"), DAY, min_n=0).first()["prevalence"] is None
    assert P.prevalence(df, DAY, location="", days=0).first()["n_total"] == 9


def test_future_dates_count_and_cutoff_is_inclusive(spark):
    df = results(spark, many("ER", DAY + dt.timedelta(9), 1, 0) + many("ER", DAY - dt.timedelta(7), 1, 0) + many("ER", DAY - dt.timedelta(8), 1, 0))
    assert P.prevalence(df, DAY, days=7).first()["n_total"] == 2


def test_week_buckets_share_boundary_days(spark):
    df = results(spark, many("ER", DAY - dt.timedelta(7), 2, 1) + many("ER", DAY, 1, 1))
    shared = [r["n_total"] for r in P.trend(df, DAY, "week", 3).collect()]
    apart = [r["n_total"] for r in P.trend(df, DAY, "week_exclusive", 3).collect()]
    assert shared == [3, 2, 0] and apart == [1, 2, 0]
    assert P.trend(df, DAY, "week", 1).first()["period_label"] == "W01 2024"  # ISO week, calendar year


def test_months_walk_back_over_the_year(spark):
    df = results(spark, many("ER", dt.date(2024, 2, 29), 12, 6))
    rows = P.trend(df, dt.date(2024, 3, 31), "month", 4).collect()
    assert [r["period_label"] for r in rows] == ["2024-03", "2024-02", "2024-01", "2023-12"]
    assert rows[1]["end_date"] == dt.date(2024, 2, 29) and rows[1]["prevalence"] == 0.5 and rows[0]["n_total"] == 0


def best(spark, df, **kw):
    return {r["location"]: (r["prevalence"], r["source"]) for r in P.best_prevalence(df, DAY, **kw).collect()}


def test_fallback_tiers(spark):
    old = DAY - dt.timedelta(900)
    df = results(spark, many("ER", DAY, 30, 3) + many("ICU", old, 30, 15) + many("Lab", DAY, 5, 5))
    got = best(spark, df)
    assert got["ER"] == (0.1, "observed (local ER, last 365d, n=30, 3 positive)")
    assert got["ICU"] == (0.5, "observed (local ICU, all time, n=30, 15 positive)")
    # everything in the last days would do (35 studies), but that tier is skipped with a location
    assert got["Lab"] == (round(23 / 65, 6), "observed (all locations, all time, n=65, 23 positive)")
    assert got[None] == (round(8 / 35, 6), "observed (all locations, last 365d, n=35, 8 positive)")
    few = results(spark, many("ER", DAY, 3, 1))
    assert best(spark, few, fallback=0.05)["ER"] == (0.05, "indication default (insufficient local data)")
    assert best(spark, few)[None] == (None, "no prevalence data available")


def test_upsert_replaces_whole_rows_and_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, n int, t string")
    new = spark.createDataFrame([("b", 1, None, 1), ("b", None, "z", 2), ("c", 3, "w", 1)], "k string, n int, t string, seq int")
    once = P.upsert(old, new, "k", order="seq")
    assert {tuple(r) for r in once.collect()} == {("a", 1, "x", False), ("b", None, "z", False), ("c", 3, "w", True)}
    twice = P.upsert(once.drop("is_new"), new, "k", order="seq")
    assert {tuple(r)[:3] for r in twice.collect()} == {tuple(r)[:3] for r in once.collect()}
    assert not any(r["is_new"] for r in twice.collect())


def test_worklist_overlay(spark):
    stored = spark.createDataFrame([("a", "old", True, "2024-01-01", "t0")],
                                   "study_uid string, indication string, physician_stat boolean, exam_time string, processed_time string")
    stored = stored.withColumn("ai_positive", F.lit(False))
    incoming = spark.createDataFrame([("a", True), ("b", None)], "study_uid string, ai_positive boolean")
    got = {r["study_uid"]: r for r in worklist.upsert_entries(stored, incoming, "t1").collect()}
    assert (got["a"]["indication"], got["a"]["physician_stat"], got["a"]["ai_positive"], got["a"]["processed_time"]) == ("old", True, True, "t1")
    assert (got["b"]["ai_positive"], got["b"]["physician_stat"], got["b"]["exam_time"], got["b"]["is_new"]) == (False, False, "t1", True)


def test_worklist_order(spark):
    df = spark.createDataFrame([("n", False, False, "1"), ("p2", False, True, "2"), ("p1", None, True, "1"), ("s", True, True, "9")],
                               "study_uid string, physician_stat boolean, ai_positive boolean, exam_time string")
    assert [r["study_uid"] for r in worklist.ordered(df).collect()] == ["s", "p1", "p2", "n"]


def test_merge_maps(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3", "c": "4"}), (None, {"x": "1"})], "o map<string,string>, n map<string,string>")
    got = [r[0] for r in df.select(worklist.merge_maps(F.col("o"), F.col("n"))).collect()]
    assert got == [{"a": "1", "b": "3", "c": "4"}, {"x": "1"}]


def test_study_folders(spark):
    paths = ["r/s1/a/1.dcm", "r/s1/b/1.dcm", "r/s1/b/2.dcm", "r/s2/a/1.dcm", "flat/x/1.dcm", "flat/y/1.dcm", "r/s3/1.dcm", "r/s4/1.dcm"]
    got = {r["study_folder"]: r["n_files"] for r in triage.study_folders(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    # s3 and s4 are siblings with files, so their parent becomes the study folder
    assert got == {"r/s1": 3, "r/s2/a": 1, "flat": 2, "r": 2}


HEAD = "study_uid string, series_uid string, path string, modality string, series_description string, study_description string, " \
       "slice_thickness string, contrast_bolus_agent string, image_type array<string>, study_date string, error string"


def head(study, series, n, desc="AXIAL HEAD", thick="5", modality="CT", study_desc="", contrast="", kind="ORIGINAL", date="20240101", error=None, tag=""):
    return [(study, series, f"{study}/{series}/{tag}{i:02d}.dcm", modality, desc, study_desc, thick, contrast, [kind] if kind else [], date, error) for i in range(n)]


def test_routing(spark):
    rows = (head("ready", "a", 10) + head("ready", "b", 10, desc="AXIAL HEAD W/O", thick="") + head("ready", "c", 10, desc="AXIAL HEAD W/O", thick="2.5", tag="z")
            + head("mr", "a", 10, modality="MR") + head("spine", "a", 10, study_desc="Head and Cervical Spine") + head("old", "a", 10, date="20200101")
            + head("dateless", "a", 10, date="") + head("known", "a", 10) + head("few", "a", 9) + head("contrast", "a", 10, contrast="OMNI")
            + head("derived", "a", 10, kind="DERIVED") + head("blank", "a", 10, desc="", kind=None) + head("bad", "a", 1, error="cut") + head("bad", "b", 10, tag="1"))
    df = spark.createDataFrame(rows, HEAD)
    known = spark.createDataFrame([("known",)], "study_uid string")
    got = {r["study_uid"]: r for r in triage.route_studies(df, known, DAY, 800).collect()}
    assert {k: r["status"] for k, r in got.items()} == {
        "ready": "ready", "mr": "not_head_ct", "spine": "not_head_ct", "old": "date_filtered", "dateless": "ready", "known": "already_processed",
        "few": "no_ncct_series", "contrast": "no_ncct_series", "derived": "no_ncct_series", "blank": "ready", "bad": "not_head_ct"}
    assert got["ready"]["series_uid"] == "c" and got["ready"]["series_folder"] == "ready/c"
    assert got["mr"]["reason"] == "wrong_modality_MR" and got["spine"]["reason"] == "non_head_desc" and got["bad"]["reason"] == "header_read_error"


def test_requested_studies_without_files(spark):
    df = spark.createDataFrame(head("a", "x", 10) + head("b", "x", 10), HEAD)
    none = spark.createDataFrame([], "study_uid string")
    asked = spark.createDataFrame([("a",), ("gone",)], "study_uid string")
    got = {r["study_uid"]: (r["status"], r["reason"], r["n_files"]) for r in triage.route_studies(df, none, DAY, requested=asked).collect()}
    assert got == {"a": ("ready", "", 10), "gone": ("not_head_ct", "no_dcm_files", 0)}


def test_series_ties_and_simple_rule(spark):
    rows = head("s", "b", 10, thick="x") + head("s", "a", 10, thick="99") + head("s", "d", 10, thick="1", kind="DERIVED")
    df = triage.series_rollup(spark.createDataFrame(rows, HEAD))
    assert triage.select_series(df).first()["series_uid"] == "a"
    assert triage.select_series_simple(df).first()["series_uid"] == "a"


def test_best_group(spark):
    rows = [("z", f"a/{i}.dcm", i) for i in range(5)] + [("z", f"b THIN/{i}.DCM", 10 + i) for i in range(2)] + [("z", "b THIN/x.txt", 90)]
    df = spark.createDataFrame(rows, "archive string, path string, position int")
    assert triage.best_file_group(df).first()["folder"] == "b THIN"
    assert triage.best_group_members(df).count() == 2


def test_run_counters(spark):
    df = spark.createDataFrame([("p", "OK — POSITIVE"), ("p", "skipped"), ("n", "ERROR in x"), ("n", "SKIP — gone"), ("n", "OK")], "group string, status string")
    assert {tuple(r) for r in triage.run_counters(df).collect()} == {("p", 1, 0, 1), ("n", 0, 2, 1)}


def test_result_rows(spark):
    p = {f"p_{c}": 0.1 for c in K.CLASSES}
    rows = [{"study_uid": u, **p, "p_any": v, "p_subdural": v} for u, v in (("a", 0.2), ("a", 0.91), ("b", 0.3), ("c", 0.3))]
    scored = scores.study_scores(spark.createDataFrame(rows))
    studies = spark.createDataFrame([("a", DAY, "Medical Ward", ""), ("b", DAY, "", "Neuro ICU"), ("c", DAY, None, None)],
                                    "study_uid string, exam_date date, raw_department string, location string")
    out = flows.result_rows(scored, studies, F.lit("now"))
    assert out.columns == [c.split()[0] for c in schemas.STUDY_RESULTS.replace("\n", " ").split(",")]
    got = {r["study_uid"]: r for r in out.collect()}
    assert (got["a"]["location"], got["a"]["ai_positive"], got["a"]["dominant_class"], got["a"]["prob_any"]) == ("ER", 1, "subdural hematoma", 0.91)
    assert (got["b"]["location"], got["b"]["exam_datetime"], got["c"]["location"]) == ("Neuro ICU", "2024-12-30", "Unknown")
    path = tables.new_results_store(spark)
    tables.upsert_results(spark, path, out)
    assert tables.read_results(spark, path).count() == 3


def test_batch_run_outcomes(spark):
    manifest = spark.createDataFrame([("a", "subdural", "positive"), ("b", None, "negative"), ("c", "epidural", "positive"), ("d", "", "negative")],
                                     "study_uid string, dominant_class string, group string")
    p = {f"p_{c}": 0.1 for c in K.CLASSES}
    rows = [{"study_uid": u, "z_mm": 1.0, "path": "x", **p, "p_any": v, "p_subdural": v} for u, v in (("a", 0.9), ("b", 0.2), ("c", 0.9))]
    out = flows.batch_run(manifest, manifest.filter("study_uid = 'c'"), spark.createDataFrame(rows), 0.94, 0.9453, ("path",))
    got = {r["study_uid"]: r for r in out.collect()}
    assert {k: r["status"] for k, r in got.items()} == {"a": "OK — POSITIVE", "b": "OK — negative", "c": "skipped", "d": "ERROR — no slices"}
    assert got["a"]["patient_name"] == "DEMO^SUBDURAL" and got["a"]["prevalence"] == 0.08 and got["b"]["prevalence"] == 0.02
    assert {tuple(r) for r in triage.run_counters(out).collect()} == {("positive", 1, 0, 1), ("negative", 0, 1, 1)}


def test_result_store(spark):
    path = tables.new_results_store(spark)
    assert tables.read_results(spark, path).count() == 0
    rows = results(spark, many("ER", DAY, 4, 1))
    first = tables.upsert_results(spark, path, rows)
    later = rows.limit(2).withColumn("ai_positive", F.lit(9)).withColumn("exam_date", F.lit(dt.date(2023, 1, 1)))
    second = tables.upsert_results(spark, path, later)
    assert first != second
    tables.upsert_results(spark, path, later, load=second)  # a repeated load changes nothing
    now = tables.read_results(spark, path)
    assert now.count() == 4 and now.filter("ai_positive = 9").count() == 2
    compact = tables.compact_results(spark, path)
    assert tables.read_results(spark, compact).exceptAll(now).count() == 0
    tables.upsert_results(spark, compact, rows.limit(1))
    assert tables.read_results(spark, compact).count() == 4
    with pytest.raises(ValueError):
        tables.upsert_results(spark, path, rows.withColumn("extra", F.lit(1)))


def test_archive_scan_scores_only_the_chosen_series(spark):
    """A study that is positive on its bone series only comes out negative; an undated study gives no result."""
    head = ("study_uid string, series_uid string, path string, modality string, series_description string, study_description string, "
            "slice_thickness string, contrast_bolus_agent string, image_type array<string>, study_date string, error string, "
            "patient_id string, study_time string, institutional_department string")

    def files(study, series, description, day):
        return [(study, series, f"{study}/{series}/{i}.dcm", "CT", description, "HEAD", "5", "", ["ORIGINAL"], day, None, "P7", "101500.2", "Neuro ICU")
                for i in range(3)]

    headers = spark.createDataFrame(files("a", "a.1", "AXIAL HEAD W/O", "20240105") + files("a", "a.2", "BONE RECON", "20240105")
                                    + files("b", "b.1", "AXIAL HEAD W/O", "2024"), head)
    scores = {"a.1": 0.1, "a.2": 0.9, "b.1": 0.9}
    rows = [{"study_uid": s[0], "series_uid": s, "z_mm": float(i), **{f"p_{c}": p for c in K.CLASSES}} for s, p in scores.items() for i in range(3)]
    got = flows.scanned_results(headers, spark.createDataFrame(rows), spark.createDataFrame([], "study_uid string"), dt.date(2024, 1, 31), None, 2).collect()
    assert [(r["study_uid"], r["ai_positive"], r["prob_any"], r["patient_id"], r["exam_datetime"], r["location"]) for r in got] == [
        ("a", 0, 0.1, "P7", "2024-01-05T10:15:00", "Neuro ICU")]
