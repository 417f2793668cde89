"""The scoring scan: failures as values, series state, the queue of ready studies."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slicewise.operators import scores, triage
from slicewise.plans import inputs as I
from slicewise.session import durable, fresh_path, table
from slicewise.sources import tables
from slicewise.streaming import scan

SF = "/root/testdata/sf0.001"


def test_bad_blocks_are_isolated():
    calls = []

    def make():
        def predict(block):
            calls.append(len(block))
            if (block < 0).any():
                raise ValueError("block out of range")
            return np.stack([block[:, 0]] * 3, axis=1)
        return predict

    block = np.arange(64, dtype="float64")[:, None]
    block[[5, 40]] *= -1
    probs, errors = scores.isolating(make, 3)()(block)
    assert [i for i, e in enumerate(errors) if e] == [5, 40] and set(errors) == {None, "block out of range"}
    assert np.isnan(probs[[5, 40]]).all() and (np.delete(probs[:, 2], [5, 40]) == np.delete(block[:, 0], [5, 40])).all()
    assert len(calls) <= 1 + 2 * 2 * 6  # two calls a level for each bad block
    probs, errors = scores.isolating(lambda: lambda b: b[:, :2], 3)()(np.ones((4, 3)))
    assert np.isnan(probs).all() and all("shape" in e for e in errors)


def test_scores_without_failures_equal_the_plain_scorer(spark):
    blocks = I.scan_blocks(spark, SF).select("study_uid", "path", "block")
    plain = scores.score_batches(blocks, lambda: I.cubic_scorer(), (6,), "block").orderBy("path").collect()
    told = scores.score_isolated(blocks, lambda: I.cubic_scorer(), (6,), "block", batch_size=7).orderBy("path").collect()
    assert [r.asDict() | {"error": None} for r in plain] == [r.asDict() for r in told]


def parts_of(spark, folder, n):
    headers = durable(I.scan_headers(spark, SF).dropDuplicates(["path"]), "headers")
    cut = F.pmod(F.xxhash64("path"), F.lit(n))
    for i in range(n):
        headers.filter(cut == i).coalesce(1).write.mode("append").parquet(folder)
    return headers


def drained(writer, progress):
    q = writer.option("checkpointLocation", progress).trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None
    return q


def test_series_state_touches_its_own_studies_only(spark):
    source, state, visited = (fresh_path(spark, n) for n in ("heads", "state", "visited"))
    headers = parts_of(spark, source, 4)
    stream = spark.readStream.schema(headers.schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = drained(scan.triage_writer(stream, I.processed(spark, SF), visited, state, I.TRIAGE_AS_OF, I.TRIAGE_DAYS, 2), fresh_path(spark, "progress"))
    runs = [p for p in q.recentProgress if p.numInputRows]
    total = headers.count()
    assert len(runs) == 4 and sum(p.numInputRows for p in runs) == total  # every header is read once
    assert all(p.stateOperators[0].numRowsUpdated <= p.numInputRows for p in runs)
    assert runs[-1].stateOperators[0].numRowsTotal == headers.select("study_uid").distinct().count()
    want = {(r.study_uid, r.status) for r in triage.route_studies(headers, I.processed(spark, SF), I.TRIAGE_AS_OF, I.TRIAGE_DAYS, 2).collect()}
    from slicewise.streaming import jobs
    assert {tuple(r) for r in jobs.visited_studies(spark, visited, state).collect()} == want


def test_groups_are_those_of_the_batch_operator(spark):
    source, out = fresh_path(spark, "heads"), fresh_path(spark, "groups")
    headers = parts_of(spark, source, 1).withColumn("error", F.when(F.col("path").endswith("1.dcm"), "bad"))
    scan.keyed_state(spark)
    stream = spark.readStream.schema(headers.schema).parquet(source).withColumn("error", F.when(F.col("path").endswith("1.dcm"), "bad"))
    drained(scan.series_groups(stream).writeStream.outputMode("update").foreachBatch(lambda b, i: scan.append(b, i, out)), fresh_path(spark, "p"))
    want = triage.file_groups(headers)
    got = spark.read.parquet(out).select(want.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_a_study_costs_no_call_of_python(spark):
    """The engine keeps the state of the series, and what came of a series in several micro-batches is one group again."""
    source, out = fresh_path(spark, "heads"), fresh_path(spark, "groups")
    headers = parts_of(spark, source, 3)
    scan.keyed_state(spark)
    stream = spark.readStream.schema(headers.schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = drained(scan.series_groups(stream).writeStream.outputMode("update").foreachBatch(lambda b, i: scan.append(b, i, out)), fresh_path(spark, "p"))
    assert {s.operatorName for p in q.recentProgress for s in p.stateOperators} == {"stateStoreSave"}
    told = spark.read.parquet(out)
    last = told.groupBy("study_uid").agg(F.max("load").alias("load"))
    want = triage.file_groups(headers)
    got = scan.whole_groups(told.join(last, ["study_uid", "load"]).drop("load")).select(want.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_a_huge_study_reaches_its_key_as_few_rows(spark):
    """Files of one path are told apart by their headers, a null path comes last."""
    kind = "study_uid string, series_uid string, path string, modality string, error string"
    rows = [("a", f"s{i % 2}" if i % 4 else None, None if i < 8 else f"a/{i % 5000}.dcm", f"m{i}", "bad" if i % 3 == 0 else None) for i in range(9_000)]
    parts = scan.partial_groups(spark.createDataFrame(rows, kind).coalesce(1)).collect()
    want = {}
    for _, series, path, modality, error in rows:
        key = (series or "unknown", error is None)
        n, least, heads = want.get(key, (0, ("~",), set()))
        rank = (path is None, path or "")
        want[key] = (n + 1, min(least, rank) if n else rank, (heads if n and rank >= least else set()) | ({modality} if not n or rank <= least else set()))
    assert len(parts) == len(want)
    for r in parts:
        n, (no_path, path), heads = want[r.series_uid, r.readable]
        assert (r.slice_count, r.first_path) == (n, None if no_path else path) and r.head.modality in heads


READY = scan.ready_schema(("patient_id",))


def ready(spark, studies, load):
    return spark.createDataFrame([(s, "2024-01-01", 2, f"{s}.{load}", f"{s}/x", 2, "P", load) for s in studies], READY)


def test_queue_hands_on_full_groups_and_the_rest_by_timer(spark):
    source, progress, out = (fresh_path(spark, n) for n in ("ready", "progress", "handed"))

    def start():
        scan.keyed_state(spark)
        stream = spark.readStream.schema(READY).option("maxFilesPerTrigger", 1).parquet(source)
        return (scan.queued(stream, size=5, wait_ms=1500, queues=1).writeStream.outputMode("update").foreachBatch(lambda b, i: scan.append(b, i, out))
                .option("checkpointLocation", progress).trigger(processingTime="2 seconds").start())

    ready(spark, [f"s{i}" for i in range(3)], 0).coalesce(1).write.mode("append").parquet(source)
    q = start()
    scan.drain(q, lambda: any(p.numInputRows for p in q.recentProgress))  # stopped while three wait or just after
    ready(spark, ["s2", "s3", "s4"], 1).coalesce(1).write.mode("append").parquet(source)
    ready(spark, ["s9"], 2).coalesce(1).write.mode("append").parquet(source)
    scan.drain(start())
    rows = spark.read.parquet(out).collect()
    assert {r.study_uid for r in rows} == {"s0", "s1", "s2", "s3", "s4", "s9"}
    newest = max((r for r in rows if r.study_uid == "s2"), key=lambda r: r.load)
    assert newest.series_uid == "s2.1"  # the later entry counts
    assert "timer" in {r.why for r in rows if r.study_uid == "s9"}
    assert all(r.why in ("full", "timer") for r in rows)


@pytest.mark.parametrize("name", ["prevalence_by_location", "report_text", "worklist_view", "batch_run", "display_formats"])
def test_displayed_values_stay_in_generated_code(spark, name):
    """Nested displayed decimals neither blow up the plan nor fall back from generated code."""
    from slicewise.plans.queries import QUERIES
    spark.conf.set("spark.sql.codegen.fallback", "false")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        df = QUERIES[name](spark, SF)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("CASE WHEN") < 400 and len(plan) < 400_000
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
        spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_planted_failures_are_met(spark):
    rows = table(spark, SF, "lineitem").filter("l_partkey % 41 = 0 and l_linenumber = 2").count()
    assert rows > 0
    from slicewise.plans.queries import QUERIES
    states = {r.status: r.n_studies for r in QUERIES["archive_outcome_counters"](spark, SF).collect()}
    assert states["error"] > 0 and states["ready"] > 0


def test_a_result_of_an_earlier_scoring_does_not_count(spark):
    """Study a lost its exam date, b kept it, c was scored by an older routing after its last one."""
    store, state = fresh_path(spark, "store"), fresh_path(spark, "state")

    def results(studies):
        return spark.createDataFrame([(s, v) for s, v in studies], "study_uid string, dominant_class string")

    for load, found in ((0, "abc"), (1, "bc"), (2, "c")):
        tables.upsert_results(spark, store, results([(s, f"{s}{load}") for s in found]), load=f"scan-{load}")
    for load, seen in ((0, "abc"), (1, "abc")):
        scan.append(spark.createDataFrame([(s, "ready", None) for s in seen], "study_folder string, status string, reason string"), load, f"{state}/outcomes")
    scored = "study_folder string, status string, reason string, routed bigint"
    for load, routed, seen in ((0, 0, "abc"), (1, 1, "abc"), (2, 0, "c")):
        scan.append(spark.createDataFrame([(s, "processed", None, routed) for s in seen], scored), load, f"{state}/scored")
    assert {(r.study_uid, r.dominant_class) for r in scan.scanned(spark, store, state).collect()} == {("b", "b1"), ("c", "c1")}


@pytest.mark.parametrize("name, moved", [("series_rollup", 1), ("series_select_simple", 1), ("study_triage", 1), ("archive_scan", 3)])
def test_roll_ups_move_no_header_text(spark, name, moved):
    """Files are gathered by study (and pixels by series) while they are numbers; no text of theirs is dealt again by series."""
    from slicewise.plans.queries import QUERIES
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == moved
    assert not [at for at in plan.split("hashpartitioning(")[1:] if "readable" in at.split(")")[0]]


class EndedQuery:
    """A query whose thread died without leaving its exception."""

    isActive, recentProgress = False, []

    def exception(self):
        return None

    def stop(self):
        pass


def test_a_query_that_ends_on_its_own_is_a_failure():
    with pytest.raises(RuntimeError):
        scan.drain(EndedQuery())


def test_a_study_is_settled_when_its_last_routing_is_scored(spark):
    state = fresh_path(spark, "state")
    assert scan.all_scored(spark, state)
    for load, studies in ((0, ["a", "b"]), (1, ["b"])):
        scan.append(ready(spark, studies, load).drop("load"), load, f"{state}/ready")
    scored = "study_folder string, status string, reason string, routed bigint"
    scan.append(spark.createDataFrame([("a", "processed", None, 0), ("b", "processed", None, 0)], scored), 0, f"{state}/scored")
    assert not scan.all_scored(spark, state)
    scan.append(spark.createDataFrame([("b", "error", "bad", 1)], scored), 1, f"{state}/scored")
    assert scan.all_scored(spark, state)


def test_a_load_is_one_small_file(spark):
    path = fresh_path(spark, "log")
    scan.append(spark.range(100).repartition(8), 0, path)
    assert len(spark.read.parquet(path).inputFiles()) == 1
