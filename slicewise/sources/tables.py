"""Stored tables on the shared folder: study results, tensors, visited log.

The result store is append-only: each load is one partition folder, written
whole or not at all, and re-running a load replaces just that folder. Readers
take the latest row per study. :func:`compact_results` folds the loads.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicewise import schemas
from slicewise.functions import packed
from slicewise.session import fresh_path


def new_store(spark: SparkSession, name: str) -> str:
    return fresh_path(spark, name)


def new_results_store(spark: SparkSession) -> str:
    return new_store(spark, "study-results")


def stored(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table, or an empty one where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


RESULT_ROWS = schemas.STUDY_RESULTS + ", version BIGINT, load STRING"


def upsert_results(spark: SparkSession, path: str, rows: DataFrame, load: str | None = None, sequence: int | None = None) -> str:
    """Write one load. Columns beyond the table's are refused, missing ones are null.

    Every load has a name of its own, so that writers never replace each other's rows:
    a random one, or the writer's name and batch number, which makes a repeated batch
    harmless. ``version`` orders the loads, without any clock: it is the caller's ``sequence``, or
    one more than the store's highest; a repeated load keeps its first version. Loads of one
    version are ordered by their rows.
    """
    table = spark.createDataFrame([], schemas.STUDY_RESULTS)
    unknown = set(rows.columns) - set(table.columns)
    if unknown:
        raise ValueError(f"not in the result table: {sorted(unknown)}")
    own = F.lit(None) if load is None else F.when(F.col("load") == load, F.col("version"))
    first, highest = stored(spark, path, RESULT_ROWS).agg(F.min(own.cast("bigint")), F.coalesce(F.max("version"), F.lit(0))).first()
    version = sequence if sequence is not None else first if first is not None else highest + 1
    load = load or uuid.uuid4().hex
    aligned = rows.select(*[
        (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema])
    (aligned.withColumn("version", F.lit(version).cast("bigint")).withColumn("load", F.lit(load)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("load").parquet(path))
    return load


def latest(rows: DataFrame, keys: list[str], version: str = "load", then: tuple[str, ...] = ()) -> DataFrame:
    """The row of the highest version per key, as an aggregate (reduced on the map side).

    Rows of one version are told apart by ``then`` and, last, by their own fields, so
    that the winner is always the same.
    """
    fields = [c for c in rows.columns if c not in (*keys, version)]
    return (rows.groupBy(*keys).agg(F.max(F.struct(version, *then, *[F.col(c).alias(f"f_{c}") for c in fields])).alias("_r"))
            .select(*keys, *[F.col(f"_r.f_{c}").alias(c) for c in fields]))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The latest row of every study; in one load the one processed last."""
    rows = stored(spark, path, RESULT_ROWS)
    return latest(rows.drop("load"), ["study_uid"], "version", ("processed_datetime",))


def compact_results(spark: SparkSession, path: str) -> str:
    """Write the current rows as the first load of a new store; returns its path.

    Rows are laid out in ranges of exam date (and uid, so a busy day spans several
    files), which lets date filters skip files. Later loads go on top as before.
    """
    new = new_results_store(spark)
    (read_results(spark, path).withColumn("version", F.lit(0).cast("bigint")).withColumn("load", F.lit("compacted"))
     .repartitionByRange("exam_date", "study_uid")
     .write.partitionBy("load").parquet(new))
    return new


def save_as_table(rows: DataFrame, name: str) -> None:
    """A catalog table of results, partitioned by exam month.

    The rebalance hint gathers a month's rows into few files and lets adaptive
    execution split a month that is too large for one task.
    """
    (rows.withColumn("exam_month", F.date_format("exam_date", "yyyy-MM")).hint("rebalance", F.col("exam_month"))
     .write.mode("overwrite").partitionBy("exam_month").saveAsTable(name))


def read_tensors(spark: SparkSession, path: str) -> DataFrame:
    """The stored blocks, packed (``packed.unpack`` makes arrays of them)."""
    return stored(spark, path, schemas.TENSOR_STORE)


def append_tensors(spark: SparkSession, path: str, tensors: DataFrame) -> None:
    """Append encoded blocks, skipping (window, image) pairs that are stored already.

    Arrays in ``image_norm`` are packed on the way; blocks packed before stand in ``image_half``.
    """
    if "image_half" not in tensors.columns:
        tensors = tensors.withColumn("image_half", packed.pack(F.col("image_norm")))
    stored = read_tensors(spark, path).select("window", "image_id")
    (tensors.join(stored, ["window", "image_id"], "left_anti")
     .select("image_id", "h", "w", "image_half", "window", "split")
     .write.mode("append").partitionBy("window", "split").parquet(path))


VISITED = "study_folder STRING, status STRING"


def read_visited(spark: SparkSession, path: str) -> DataFrame:
    return stored(spark, path, VISITED)


def mark_visited(folders: DataFrame, path: str) -> None:
    """Mark folders after their outcome is stored. A dry run must not call this."""
    folders.select("study_folder", "status").write.mode("append").parquet(path)
