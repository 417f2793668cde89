import datetime as dt

from pyspark.sql import functions as F

from slicewise.operators import prevalence
from slicewise.session import fresh_path
from slicewise.sources import tables
from slicewise.streaming import jobs

SCHEMA = "study_uid string, exam_date date, location string, ai_positive int, exam_ts timestamp"


def batch(spark, rows):
    return spark.createDataFrame([(u, d, loc, p, dt.datetime.combine(d, dt.time())) for u, d, loc, p in rows], SCHEMA)


D = dt.date(2024, 1, 1)


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def drain(writer, progress):
    q = writer.option("checkpointLocation", progress).trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None


def test_results_stream_resumes_and_upserts(spark):
    source, progress, store = (fresh_path(spark, n) for n in ("in", "progress", "store"))
    batch(spark, [("a", D, "ER", 0), ("b", D, "ER", 1)]).coalesce(1).write.mode("append").parquet(source)
    keep = ["study_uid", "exam_date", "location", "ai_positive"]
    drain(jobs.results_stream(stream(spark, source).select(*keep), store), progress)
    batch(spark, [("a", D, "ER", 1), ("c", D, "ICU", 0)]).coalesce(1).write.mode("append").parquet(source)
    drain(jobs.results_stream(stream(spark, source).select(*keep), store), progress)
    rows = {r["study_uid"]: r["ai_positive"] for r in tables.read_results(spark, store).collect()}
    assert rows == {"a": 1, "b": 1, "c": 0}
    # a repeated micro-batch writes the same load again
    tables.upsert_results(spark, store, batch(spark, [("a", D, "ER", 1), ("c", D, "ICU", 0)]).select(*keep), load="results-stream-1")
    assert tables.read_results(spark, store).count() == 3
    assert prevalence.prevalence(tables.read_results(spark, store), D, min_n=1).first()["n_positive"] == 2


def test_dedupe_over_batches(spark):
    source, progress, out = (fresh_path(spark, n) for n in ("in", "progress", "out"))
    for rows in ([("a", D, "ER", 0), ("b", D, "ER", 0)], [("a", D + dt.timedelta(2), "ER", 0), ("c", D, "ER", 1)]):
        batch(spark, rows).coalesce(1).write.mode("append").parquet(source)
    fresh = jobs.new_studies(stream(spark, source), "exam_ts")
    drain(fresh.writeStream.format("parquet").option("path", out), progress)
    assert sorted(r["study_uid"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_windowed_prevalence_takes_old_exams(spark):
    source, progress, out = (fresh_path(spark, n) for n in ("in", "progress", "out"))
    batch(spark, [("a", D, "ER", 1)]).coalesce(1).write.mode("append").parquet(source)
    batch(spark, [("b", D - dt.timedelta(300), "ER", 0), ("c", D, "ER", 0)]).coalesce(1).write.mode("append").parquet(source)

    def write(df, batch_id):
        df.withColumn("load", F.lit(batch_id).cast("bigint")).write.mode("append").parquet(out)

    drain(jobs.windowed_prevalence(stream(spark, source)).writeStream.outputMode("update").foreachBatch(write), progress)
    rows = tables.latest(spark.read.parquet(out), ["start", "location"]).collect()
    assert sorted((r["n_total"], r["n_positive"]) for r in rows) == [(1, 0), (2, 1)]


HEAD = ("study_uid string, series_uid string, path string, modality string, series_description string, study_description string, "
        "slice_thickness string, contrast_bolus_agent string, image_type array<string>, study_date string, error string")


def heads(spark, study, n):
    return spark.createDataFrame([(study, "x", f"{study}/{i}.dcm", "CT", "head", "", "5", "", ["ORIGINAL"], "20240101", None) for i in range(n)], HEAD)


def test_triage_routes_from_all_files_of_a_study(spark):
    source, visited, state = (fresh_path(spark, n) for n in ("heads", "visited", "state"))
    heads(spark, "s1", 10).coalesce(1).write.mode("append").parquet(source)
    existing = spark.createDataFrame([], "study_uid string")

    def run(progress, dry):
        df = spark.readStream.schema(HEAD).option("maxFilesPerTrigger", 1).parquet(source)
        drain(jobs.triage_stream(df, existing, visited, state, D, None, 10, dry_run=dry), progress)

    def seen():
        return sorted(tuple(r) for r in jobs.visited_studies(spark, visited, state).collect())

    run(fresh_path(spark, "p"), True)
    assert seen() == []
    progress = fresh_path(spark, "p")
    run(progress, False)
    assert seen() == [("s1", "ready")]
    # twelve files of one series in two micro-batches, and a study an earlier scan has visited
    heads(spark, "s2", 6).coalesce(1).write.mode("append").parquet(source)
    tables.mark_visited(spark.createDataFrame([("old", "ready")], tables.VISITED), visited)
    heads(spark, "old", 3).coalesce(1).write.mode("append").parquet(source)
    run(progress, False)
    assert seen() == [("old", "ready"), ("s1", "ready"), ("s2", "no_ncct_series")]
    heads(spark, "s2", 12).filter("path >= 's2/6'").coalesce(1).write.mode("append").parquet(source)
    heads(spark, "s2", 12).filter("path like 's2/1_.dcm'").coalesce(1).write.mode("append").parquet(source)
    run(progress, False)
    assert seen() == [("old", "ready"), ("s1", "ready"), ("s2", "ready")]


def test_two_writers_share_a_store(spark):
    store = fresh_path(spark, "store")
    keep = ["study_uid", "exam_date", "location", "ai_positive"]
    tables.upsert_results(spark, store, batch(spark, [("a", D, "ER", 0), ("b", D, "ER", 0)]).select(*keep))
    tables.upsert_results(spark, store, batch(spark, [("a", D, "ER", 1)]).select(*keep), load="w-0")
    tables.upsert_results(spark, store, batch(spark, [("c", D, "ER", 1)]).select(*keep), load="v-0")
    rows = {r["study_uid"]: r["ai_positive"] for r in tables.read_results(spark, store).collect()}
    assert rows == {"a": 1, "b": 0, "c": 1}
    # a repeated load keeps its version, so it does not overtake what came later
    tables.upsert_results(spark, store, batch(spark, [("c", D, "ER", 0)]).select(*keep))
    tables.upsert_results(spark, store, batch(spark, [("c", D, "ER", 1)]).select(*keep), load="v-0")
    assert {r["study_uid"]: r["ai_positive"] for r in tables.read_results(spark, store).collect()}["c"] == 0
    # in one load the row processed last wins, wherever it stands
    twice = spark.createDataFrame([("d", 1, "2024-01-02"), ("d", 0, "2024-01-01")], "study_uid string, ai_positive int, processed_datetime string")
    tables.upsert_results(spark, store, twice)
    assert tables.read_results(spark, store).filter("study_uid = 'd'").first()["ai_positive"] == 1


def test_loads_are_ordered_by_what_the_caller_states(spark):
    """No clock takes part: the load stated as later wins, whichever is written first."""
    store = fresh_path(spark, "store")
    keep = ["study_uid", "exam_date", "location", "ai_positive"]
    tables.upsert_results(spark, store, batch(spark, [("a", D, "ER", 1), ("b", D, "ER", 1)]).select(*keep), load="fast-clock", sequence=7)
    tables.upsert_results(spark, store, batch(spark, [("a", D, "ER", 0)]).select(*keep), load="slow-clock", sequence=3)
    assert {r["study_uid"]: r["ai_positive"] for r in tables.read_results(spark, store).collect()} == {"a": 1, "b": 1}
    tables.upsert_results(spark, store, batch(spark, [("b", D, "ER", 0)]).select(*keep))  # none stated: after all others
    assert {r["study_uid"]: r["ai_positive"] for r in tables.read_results(spark, store).collect()} == {"a": 1, "b": 0}


def test_worklist_stream_overlays_fields(spark):
    source, snapshot, state, progress = (fresh_path(spark, n) for n in ("entries", "snapshot", "state", "progress"))
    kind = "study_uid string, physician_stat boolean, ai_positive boolean, report_paragraph string, exam_time string"
    for rows in ([("a", True, True, "text", "1")], [("a", False, None, None, "2"), ("b", False, False, None, "3")]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(source)
    entries = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(source)
    drain(jobs.worklist_stream(entries, snapshot, state), progress)
    from slicewise.sources import documents
    got = sorted(tuple(r) for r in documents.read_worklist_snapshot(spark, snapshot, entries.schema).collect())
    assert got == [("a", False, True, "text", "2"), ("b", False, False, None, "3")]


def test_a_trigger_reads_as_many_files_as_a_shuffle_has_tasks(spark):
    sf, got = "/root/testdata/sf0.001", []
    stream = jobs.split_stream(spark, sf, "lineitem")
    drain(stream.writeStream.foreachBatch(lambda batch, batch_id: got.append((batch.count(), batch.rdd.getNumPartitions()))), fresh_path(spark, "p"))
    total, wide = spark.read.parquet(f"{sf}/lineitem.parquet").count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(got) == 3 and sum(n for n, _ in got) == total and all(n > total // 4 for n, _ in got)
    assert all(tasks >= wide // 2 for _, tasks in got)  # one file of few row groups would keep one task busy
