"""Structured Streaming jobs over file sources.

Each job takes the trigger as options (``availableNow`` drains what is there;
a service passes ``processingTime``) and keeps its progress under a checkpoint
location in the shared folder.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slicewise.operators import worklist
from slicewise.plans import inputs as I
from slicewise.session import fresh_path, table
from slicewise.sources import documents, tables
from slicewise.streaming import scan
from slicewise.streaming.scan import append as _append

SCAN_CHUNK = 256  # files per trigger
DRAIN = {"availableNow": True}


def file_stream(spark: SparkSession, sf: str, name: str, files_per_trigger: int = SCAN_CHUNK) -> DataFrame:
    """One table of the folder as a file stream."""
    return (spark.readStream.schema(table(spark, sf, name).schema)
            .option("pathGlobFilter", f"{name}.parquet").option("maxFilesPerTrigger", files_per_trigger).parquet(sf))


def split_stream(spark: SparkSession, sf: str, name: str, files: int = 3) -> DataFrame:
    """One table of the folder dealt row by row over several triggers, each of as many files as a shuffle has tasks."""
    path, wide = fresh_path(spark, f"{name}-files"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = table(spark, sf, name)
    rows.repartition(files * wide).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", wide).parquet(path)


def _run(writer, spark: SparkSession, name: str, trigger: dict) -> None:
    query = writer.option("checkpointLocation", fresh_path(spark, f"{name}-progress")).trigger(**trigger).start()
    query.awaitTermination()


def results_stream(results: DataFrame, path: str, writer: str = "results-stream"):
    """Upsert every micro-batch into the result store; the load is named by writer and batch number."""
    def write(batch: DataFrame, batch_id: int) -> None:
        tables.upsert_results(batch.sparkSession, path, batch, load=f"{writer}-{batch_id}")
    return results.writeStream.foreachBatch(write)


def run_results_stream(spark: SparkSession, sf: str, trigger: dict = DRAIN) -> DataFrame:
    path = tables.new_results_store(spark)
    _run(results_stream(I.results_of(split_stream(spark, sf, "events")), path), spark, "results", trigger)
    return tables.read_results(spark, path).select("study_uid", "exam_date", "location", "ai_positive", "prob_any")


def windowed_prevalence(results: DataFrame, event_time: str = "exam_ts", width: str = "7 days",
                        lateness: str = "400 days") -> DataFrame:
    """Counts per window and location. Old exams are legal input, hence the long watermark.

    The result store stays the truth; this is the running view of it.
    """
    return (results.withWatermark(event_time, lateness)
            .groupBy(F.window(event_time, width).alias("w"), "location")
            .agg(F.count(F.lit(1)).alias("n_total"), F.sum(F.col("ai_positive").cast("bigint")).alias("n_positive"))
            .select(F.col("w.start").alias("start"), "location", "n_total", "n_positive"))


def run_prevalence_stream(spark: SparkSession, sf: str, trigger: dict = DRAIN) -> DataFrame:
    path = fresh_path(spark, "prevalence")
    # Midnight UTC, whatever the session's time zone: windows are cut in UTC.
    midnight = F.timestamp_seconds(F.unix_date("exam_date").cast("bigint") * 86400)
    rows = I.results_of(file_stream(spark, sf, "events")).withColumn("exam_ts", midnight)

    def write(batch: DataFrame, batch_id: int) -> None:
        _append(batch, batch_id, path)

    _run(windowed_prevalence(rows).writeStream.outputMode("update").foreachBatch(write), spark, "prevalence", trigger)
    counts = tables.latest(spark.read.parquet(path), ["start", "location"])
    start = F.date_from_unix_date(F.floor(F.unix_timestamp("start") / 86400).cast("int"))
    return counts.select(start.alias("start"), "location", "n_total", "n_positive",
                         F.round(F.col("n_positive") / F.col("n_total"), 6).alias("prevalence"))


def new_studies(results: DataFrame, arrival: str, key: str = "study_uid", lateness: str = "30 days") -> DataFrame:
    """The first arrival of every study; repeats within the watermark are dropped."""
    return results.withWatermark(arrival, lateness).dropDuplicatesWithinWatermark([key])


def run_dedupe_stream(spark: SparkSession, sf: str, trigger: dict = DRAIN) -> DataFrame:
    """The event stream sent twice, de-duplicated."""
    def arrivals() -> DataFrame:
        return file_stream(spark, sf, "events").select(
            F.col("event_id").cast("string").alias("study_uid"), F.col("ts").cast("timestamp").alias("arrived"))

    path = fresh_path(spark, "new-studies")
    writer = (new_studies(arrivals().union(arrivals()), "arrived", lateness="60 days")
              .writeStream.format("parquet").option("path", path))
    _run(writer, spark, "new-studies", trigger)
    return spark.read.parquet(path).select("study_uid", F.col("arrived").cast("timestamp_ntz").alias("arrived"))


def _kept(batch: DataFrame, batch_id: int, path: str) -> DataFrame:
    """The kept micro-batches up to this one, with their number as ``load``."""
    schema = T.StructType([*batch.schema.fields, T.StructField("load", T.LongType())])
    return batch.sparkSession.read.schema(schema).parquet(path).filter(F.col("load") <= batch_id)


def triage_stream(headers: DataFrame, existing: DataFrame, visited_path: str, state_path: str, as_of: dt.date,
                  days_back: int | None, min_slices: int, dry_run: bool = False):
    """Route the studies of every micro-batch from all their files so far.

    Files of a study may come in any number of micro-batches: the series seen so far are
    keyed state (:mod:`slicewise.streaming.scan`), and a study is routed anew whenever files of
    it arrive. Outcomes are kept per batch; :func:`visited_studies` has the last one of
    each study. Studies that an earlier scan has logged under ``visited_path`` are skipped.
    A dry run leaves nothing.
    """
    if dry_run:
        return headers.writeStream.foreachBatch(lambda batch, batch_id: None)
    return scan.triage_writer(headers, existing, visited_path, state_path, as_of, days_back, min_slices)


def visited_studies(spark: SparkSession, visited_path: str, state_path: str) -> DataFrame:
    """(study_folder, status): what earlier scans logged, and the last outcome of every study of the stream."""
    outcomes = tables.stored(spark, f"{state_path}/outcomes", scan.OUTCOMES).drop("reason")
    return tables.read_visited(spark, visited_path).unionByName(tables.latest(outcomes, ["study_folder"]))


def run_triage_stream(spark: SparkSession, sf: str, trigger: dict = DRAIN) -> DataFrame:
    path, state = fresh_path(spark, "visited"), fresh_path(spark, "triage-state")
    stream = I.headers_of(split_stream(spark, sf, "lineitem"), table(spark, sf, "part"))
    _run(triage_stream(stream, I.processed(spark, sf), path, state, I.TRIAGE_AS_OF, I.TRIAGE_DAYS, 2), spark, "triage", trigger)
    return visited_studies(spark, path, state)


def overlaid(arrivals: DataFrame, key: str = "study_uid", version: str = "load") -> DataFrame:
    """One row per key: of every field the last value that an arrival brought; null brings none."""
    fields = [c for c in arrivals.columns if c not in (key, version)]
    return arrivals.groupBy(key).agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(version, F.hash(c)))).alias(c) for c in fields]).select(key, *fields)


def worklist_stream(entries: DataFrame, snapshot_path: str, state_path: str):
    """Merge arriving entries into the worklist, field by field, and publish a snapshot in serving order.

    Arrivals are kept as one load per micro-batch; the snapshot of a batch is a
    function of the loads up to it, so a repeated batch publishes the same rows. Each
    batch has a snapshot of its own: readers keep the last one until the next is whole.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        _append(batch, batch_id, state_path)
        documents.write_worklist(overlaid(_kept(batch, batch_id, state_path)), snapshot_path, batch_id)
    return entries.writeStream.foreachBatch(write)


def run_worklist_stream(spark: SparkSession, sf: str, trigger: dict = DRAIN) -> DataFrame:
    """A served worklist polls with ``trigger={"processingTime": "15 seconds"}``."""
    snapshot, state = fresh_path(spark, "worklist"), fresh_path(spark, "worklist-state")
    stream = I.worklist_of(split_stream(spark, sf, "orders"), table(spark, sf, "customer"))
    _run(worklist_stream(stream, snapshot, state), spark, "worklist", trigger)
    shown = documents.read_worklist_snapshot(spark, snapshot, stream.schema)
    return shown.select("study_uid", worklist.tier(F.col("physician_stat"), F.col("ai_positive")).alias("tier"), "exam_time")
