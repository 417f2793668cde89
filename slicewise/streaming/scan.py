"""The archive scan as a stream: series state, a queue of ready studies, scoring.

Two queries share a folder. The first keeps what it has seen of every series (first
file, number of files) as keyed state, so that a micro-batch reads and routes its own
studies only, however long the stream has run. What became ready goes to a log. The second
reads the log into queues: a queue hands its studies on when ``QUEUE`` wait or its timer
fires, and they are scored, stored, and get their outcome.

A study whose files come in several batches is routed and scored anew each time; its
last outcome counts, and the result of its last scoring if that gave one (:func:`scanned`).
"""

from __future__ import annotations

import datetime as dt
import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from slicewise.operators import scores, triage
from slicewise.plans import flows
from slicewise.session import durable, fresh_path
from slicewise.sources import tables

#: Studies that make a queue hand on, what it waits for more at most, and queues side by side.
QUEUE, WAIT_MS, QUEUES = 16, 2_000, 8
OUTCOMES = "study_folder STRING, status STRING, reason STRING, load BIGINT"
#: Outcomes of scoring; ``routed`` is the load of the routing that was scored.
SCORED = f"{OUTCOMES}, routed BIGINT"
_KEYS = ["study_uid", "series_uid", "readable"]


def keyed_state(spark: SparkSession) -> None:
    """Queries that this session starts keep their state in the store that keyed state and timers need, packed."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.compression", "zstd")


def partial_groups(headers: DataFrame) -> DataFrame:
    """Files per study, series and readability within each Arrow batch, so that a huge study reaches its key as few rows.

    ``head`` holds the other header fields of the first file; of files with one path the least ``tie`` goes first.
    """
    attrs = [c for c in headers.columns if c not in ("study_uid", "series_uid", "path")]
    slim = headers.select("study_uid", F.coalesce("series_uid", F.lit("unknown")).alias("series_uid"), F.col("error").isNull().alias("readable"),
                          F.col("path").alias("first_path"), F.xxhash64(*attrs).alias("tie"), F.struct(*attrs).alias("head"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa
        import pyarrow.compute as pc
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            order = pc.sort_indices(rows, [("first_path", "ascending"), ("tie", "ascending")])
            ordered = rows.select(_KEYS).take(order).append_column("at", pa.array(range(len(order)), pa.int64()))
            by = ordered.group_by(_KEYS, use_threads=False).aggregate([("at", "min"), ("at", "count")])
            first = rows.take(order.take(by["at_min"].combine_chunks()))
            yield from first.append_column("slice_count", by["at_count"]).combine_chunks().to_batches()

    return slim.mapInArrow(step, T.StructType([*slim.schema, T.StructField("slice_count", T.LongType())]))


def series_groups(headers: DataFrame) -> DataFrame:
    """A stream of :func:`triage.file_groups` rows: those of every study that a micro-batch touches.

    The state of a study is a list of its partial groups that the engine itself keeps and appends to:
    a study costs no call of Python. A series that came in several micro-batches has a row for each, which
    :func:`whole_groups` makes one.
    """
    parts = partial_groups(headers)
    told = F.struct(*[c for c in parts.columns if c != "study_uid"])
    state = parts.groupBy("study_uid").agg(F.collect_list(told).alias("parts"))
    flat = state.select("study_uid", F.explode("parts").alias("p")).select("study_uid", "p.*")
    return flat.select("study_uid", "series_uid", "readable", "first_path", "tie", "head.*", "slice_count")


def whole_groups(parts: DataFrame) -> DataFrame:
    """One row per study, series and readability: the first file of all parts, and the number of files."""
    fields = [c for c in parts.columns if c not in (*_KEYS, "tie", "slice_count")]
    rank = F.struct(F.col("first_path").isNull().alias("a"), F.col("first_path").alias("b"), F.col("tie").alias("c"))
    return (parts.groupBy(*_KEYS).agg(F.min_by(F.struct(*fields), rank).alias("f"), F.sum("slice_count").alias("slice_count"))
            .select(*_KEYS, "f.*", "slice_count"))


def append(batch: DataFrame, batch_id: int, path: str) -> None:
    """Keep a micro-batch as one partition of few files; a repeated batch writes the same one again."""
    (batch.withColumn("load", F.lit(batch_id).cast("bigint")).hint("rebalance").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("load").parquet(path))


def triage_writer(headers: DataFrame, existing: DataFrame, visited_path: str, state_path: str, as_of: dt.date,
                  days_back: int | None, min_slices: int):
    """Route the studies that each micro-batch touches; outcomes and ready studies go to logs below ``state_path``."""
    carry = flows.carried(headers)
    keyed_state(headers.sparkSession)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = tables.read_visited(spark, visited_path).select(F.col("study_folder").alias("study_uid"))
        groups = whole_groups(batch)
        routed = triage.route_groups(groups.join(seen, "study_uid", "left_anti"), existing, as_of, days_back, min_slices, carry=carry)
        routed = durable(routed, "routed")
        append(routed.select(F.col("study_uid").alias("study_folder"), "status", "reason"), batch_id, f"{state_path}/outcomes")
        append(routed.filter("status = 'ready'").drop("status", "reason"), batch_id, f"{state_path}/ready")

    return series_groups(headers).writeStream.outputMode("update").foreachBatch(write)


def ready_schema(carry: tuple[str, ...]) -> str:
    return ("study_uid STRING, exam_date STRING, n_files BIGINT, series_uid STRING, series_folder STRING, slice_count BIGINT, "
            + "".join(f"{c} STRING, " for c in carry) + "load BIGINT")


class ReadyQueue(StatefulProcessor):
    """Studies that wait for the scorer; a study that becomes ready again replaces its older entry."""

    def __init__(self, size: int, wait_ms: int) -> None:
        self.size, self.wait_ms = size, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "studies string")

    def _entries(self) -> dict:
        held = self.waiting.get()
        return json.loads(held[0]) if held else {}

    def _hand_on(self, key, entries: dict, why: str) -> pd.DataFrame:
        self.waiting.clear()
        return pd.DataFrame([(key[0], e, why) for _, e in entries.values()], columns=["queue", "entry", "why"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        entries = self._entries()
        started = bool(entries)
        for pdf in rows:
            for study, load, entry in pdf[["study_uid", "load", "entry"]].itertuples(index=False):
                if study not in entries or entries[study][0] <= load:
                    entries[study] = (int(load), entry)
            if len(entries) >= self.size:  # batches of any size pass through; only a remainder waits
                yield self._hand_on(key, entries, "full")
                entries = {}
        if entries:
            self.waiting.update((json.dumps(entries),))
            if not started or not any(self.handle.listTimers()):
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        entries = self._entries()
        if entries:
            yield self._hand_on(key, entries, "timer")

    def close(self) -> None:
        pass


def queued(ready: DataFrame, size: int = QUEUE, wait_ms: int = WAIT_MS, queues: int = QUEUES) -> DataFrame:
    """The stream of ready studies, in the groups in which the queues hand them on."""
    told = ready.withColumn("routed", F.col("load"))
    fields = [c for c in told.columns if c != "load"]
    keyed = told.select(F.pmod(F.hash("study_uid"), F.lit(queues)).alias("queue"), "study_uid", "load", F.to_json(F.struct(*fields)).alias("entry"))
    out = keyed.groupBy("queue").transformWithStateInPandas(
        ReadyQueue(size, wait_ms), "queue int, entry string, why string", "Update", "processingTime")
    kind = T.StructType([told.schema[c] for c in fields])
    return out.withColumn("entry", F.from_json("entry", kind)).select("entry.*", "why")


def scoring_writer(ready: DataFrame, blocks: DataFrame, make_predict: Callable, shape: tuple[int, ...], store: str, state_path: str,
                   writer: str = "scan", block: str = "block", size: int = QUEUE, wait_ms: int = WAIT_MS, queues: int = QUEUES):
    """Score what the queues hand on; results go to the store, outcomes (``processed`` or ``error``) to a log."""
    def write(batch: DataFrame, batch_id: int) -> None:
        # a queue longer than an Arrow batch may hand a study on twice: its last routing counts
        studies = durable(tables.latest(batch.withColumn("_order", F.col("routed")), ["study_uid"], "_order"), "handed-on")
        if studies.isEmpty():
            return
        chosen = blocks.join(studies.select("study_uid", "series_uid"), ["study_uid", "series_uid"], "left_semi")
        scored = durable(scores.score_isolated(chosen, make_predict, shape, block).drop(block), "scored")
        failures = scores.failed_studies(scored)
        results = flows.ready_results(studies.drop("why", "routed").join(failures, "study_uid", "left_anti"), scored)
        tables.upsert_results(batch.sparkSession, store, results, load=f"{writer}-{batch_id}")
        outcome = (studies.select("study_uid", "why", "routed").join(failures, "study_uid", "left")
                   .select(F.col("study_uid").alias("study_folder"), F.when(F.col("reason").isNull(), "processed").otherwise("error").alias("status"),
                           "reason", "why", "routed"))
        append(outcome, batch_id, f"{state_path}/scored")

    keyed_state(ready.sparkSession)
    return queued(ready, size, wait_ms, queues).writeStream.outputMode("update").foreachBatch(write)


def drain(query: StreamingQuery, until: Callable[[], bool] | None = None, settled: Callable[[], bool] | None = None) -> None:
    """Wait until no input is left and no key holds state (or ``until`` says so), then stop the query between two batches.

    A queue with timers runs batches without input for as long as it lives, so it has
    no end of its own. ``settled`` tells from what was written whether a query without input is
    done. A query that ends before is a failure, also one that does not say why.
    """
    while True:
        active, done = query.isActive, query.recentProgress
        if not active:
            raise query.exception() or RuntimeError("the query ended before its input did, without a reason")
        # a restarted query may first repeat a batch without input, planned before newer files came: the second one has looked for them
        idle = len(done) > 1 and done[-1].numInputRows == 0 and not any(s.numRowsTotal for s in done[-1].stateOperators)
        if (until is not None and until()) or (idle and (settled is None or settled())):
            break
        time.sleep(0.05)
    patience = time.monotonic() + 3
    while query.isActive and query.status["isTriggerActive"] and time.monotonic() < patience:
        time.sleep(0.02)
    failed = query.exception()
    query.stop()
    if failed:
        raise failed


def all_scored(spark: SparkSession, state_path: str) -> bool:
    """Whether the last routing of every ready study has been scored."""
    ready = tables.stored(spark, f"{state_path}/ready", ready_schema(())).groupBy("study_uid").agg(F.max("load").alias("load"))
    scored = (tables.stored(spark, f"{state_path}/scored", SCORED).groupBy(F.col("study_folder").alias("study_uid"))
              .agg(F.max("routed").alias("routed")))
    return ready.join(scored, "study_uid", "left").filter("routed is null or routed < load").isEmpty()


def scanned(spark: SparkSession, store: str, state_path: str, writer: str = "scan") -> DataFrame:
    """The results of studies whose last routing was ready and whose last scoring did not fail.

    A study scored again without a result (its first file has no exam date) has none: rows of
    its earlier scorings stay in the store, but do not count.
    """
    routed = tables.latest(tables.stored(spark, f"{state_path}/outcomes", OUTCOMES), ["study_folder"])
    scored = tables.latest(tables.stored(spark, f"{state_path}/scored", SCORED).withColumn("batch", F.col("load")), ["study_folder"], "routed", ("load",))
    sound = (scored.filter("status = 'processed'").join(routed.filter("status = 'ready'").select("study_folder"), "study_folder", "left_semi")
             .select(F.col("study_folder").alias("study_uid"), F.concat(F.lit(f"{writer}-"), F.col("batch").cast("string")).alias("load")))
    rows = tables.stored(spark, store, tables.RESULT_ROWS)
    return rows.join(sound, ["study_uid", "load"], "left_semi").drop("load", "version")


def run_scan(spark: SparkSession, header_parts: list[DataFrame], source: Callable[[str], DataFrame], blocks: DataFrame, make_predict: Callable,
             shape: tuple[int, ...], existing: DataFrame, as_of: dt.date, days_back: int | None, min_slices: int) -> DataFrame:
    """Scan header files as they arrive, one part after the other; both queries are stopped and started again in between.

    ``source`` turns the folder of arrived files into the header stream.
    """
    arrived, state, store, visited = (fresh_path(spark, n) for n in ("arrived", "scan-state", "scan-results", "visited"))
    triage_progress, score_progress = fresh_path(spark, "triage-progress"), fresh_path(spark, "score-progress")
    for i, part in enumerate(header_parts):
        part.write.mode("append").parquet(arrived)
        headers = source(arrived)
        writer = triage_writer(headers, existing, visited, state, as_of, days_back, min_slices)
        writer.option("checkpointLocation", triage_progress).trigger(availableNow=True).start().awaitTermination()
        ready = spark.readStream.schema(ready_schema(flows.carried(headers))).option("maxFilesPerTrigger", 8).parquet(f"{state}/ready")
        writer = scoring_writer(ready, blocks, make_predict, shape, store, state).option("checkpointLocation", score_progress)
        if i + 1 < len(header_parts):
            # one batch (with timers ``availableNow`` has no end), never cut short: what waits in the queues is taken up from the checkpoint
            writer.trigger(once=True).start().awaitTermination()
        else:
            drain(writer.trigger(processingTime="2 seconds").start(), settled=lambda: all_scored(spark, state))
    return scanned(spark, store, state)
