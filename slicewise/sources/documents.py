"""CSV and JSON documents: labels, votes, splits, manifest, metrics, worklist, ledger, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slicewise import constants as K
from slicewise import schemas
from slicewise.operators import worklist as wl
from slicewise.session import fresh_path


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Long labels; ``ord`` is the row order: file, place of the split in it, row."""
    rows = spark.read.schema(schemas.LABELS).csv(path, header=True)
    return rows.select("*", F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row")).alias("ord"))


def read_votes(spark: SparkSession, path: str) -> DataFrame:
    """Reader votes (one file) as text columns ``R1:SDH`` ... plus the row order."""
    return spark.read.csv(path, header=True).withColumn("ord", F.monotonically_increasing_id())


# ---- splits ----

def read_split_document(spark: SparkSession, path: str) -> DataFrame:
    """A three-list JSON document -> (image_id, split)."""
    doc = spark.read.schema(schemas.SPLITS).json(path, multiLine=True)
    parts = [doc.select(F.explode(f"{s}_ids").alias("image_id"), F.lit(s).alias("split")) for s in ("train", "val", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def write_splits(splits: DataFrame, path: str) -> None:
    """(image_id, split) as one folder per split: the lists can be any length."""
    splits.select("image_id", "split").write.partitionBy("split").json(path)


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("image_id STRING, split STRING").json(path)


def roundtrip_splits(splits: DataFrame) -> DataFrame:
    path = fresh_path(splits.sparkSession, "splits")
    write_splits(splits, path)
    return read_splits(splits.sparkSession, path)


# ---- manifest ----

def write_manifest(cohort: DataFrame, path: str) -> None:
    """A picked cohort (bounded by its size parameters) as one JSON row with two arrays."""
    leaf = F.concat_ws("__", F.coalesce(F.nullif("dominant_class", F.lit("")), "group"), "study_uid")
    rows = cohort.withColumn("folder", F.concat_ws("/", "group", F.when(F.col("group") == "positive", leaf)
                                                   .otherwise(F.concat(F.lit("negative__"), F.col("study_uid")))))
    pos = F.struct("study_uid", "dominant_class", "n_slices", "n_labelled", "folder")
    neg = F.struct("study_uid", "n_slices", "n_labelled", "folder")
    (rows.agg(F.array_sort(F.collect_list(F.when(F.col("group") == "positive", pos))).alias("positive"),
              F.array_sort(F.collect_list(F.when(F.col("group") == "negative", neg))).alias("negative"))
     .write.json(path))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Both arrays as rows with a ``group`` column; negatives carry the class 'negative'."""
    doc = spark.read.schema(schemas.MANIFEST).json(path, multiLine=True)
    pos = doc.select(F.explode("positive").alias("s")).select("s.*", F.lit("positive").alias("group"))
    neg = doc.select(F.explode("negative").alias("s")).select(
        "s.*", F.lit("negative").alias("dominant_class"), F.lit("negative").alias("group"))
    return pos.unionByName(neg, allowMissingColumns=True)


def roundtrip_manifest(cohort: DataFrame) -> DataFrame:
    path = fresh_path(cohort.sparkSession, "manifest")
    write_manifest(cohort, path)
    return read_manifest(cohort.sparkSession, path).select(
        "study_uid", "dominant_class", "n_slices", "n_labelled", "folder", "group")


# ---- metrics ----

METRIC_FIELDS = ["auc", "prevalence", "sensitivity", "specificity", "ppv", "npv", "lr_positive", "lr_negative",
                 "threshold", "n_positive", "n_total"]


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Class metrics (six rows at most) as one JSON document."""
    entries = F.map_from_entries(F.collect_list(F.struct("class", F.struct(*METRIC_FIELDS))))
    (metrics.agg(F.max("n_total").alias("n_test"), F.round(F.avg("auc"), 6).alias("mean_auc"), entries.alias("per_class"))
     .write.json(path))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """One row per class."""
    doc = spark.read.schema(schemas.METRICS).json(path, multiLine=True)
    return doc.select("n_test", "mean_auc", F.explode("per_class").alias("class", "m")).select(
        "class", "m.*", "n_test", "mean_auc")


def headline(metrics: DataFrame | None, spark: SparkSession) -> DataFrame:
    """One row: sensitivity and specificity of class any (4 digits) and mean AUC, with defaults."""
    base = (K.DEFAULT_SENSITIVITY, K.DEFAULT_SPECIFICITY, K.DEFAULT_MEAN_AUC)
    names = ("sensitivity", "specificity", "mean_auc")
    if metrics is None:
        return spark.range(1).select(*[F.lit(v).alias(n) for v, n in zip(base, names)])
    of_any = {n: F.max(F.when(F.col("class") == "any", F.col(n))) for n in names[:2]}
    values = [of_any["sensitivity"], of_any["specificity"], F.max("mean_auc")]
    return metrics.agg(*[F.coalesce(F.round(v, 4), F.lit(b)).alias(n) for v, b, n in zip(values, base, names)])


def roundtrip_metrics(metrics: DataFrame) -> DataFrame:
    path = fresh_path(metrics.sparkSession, "metrics")
    write_metrics(metrics, path)
    return read_metrics(metrics.sparkSession, path)


# ---- worklist ----

def read_worklist(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.WORKLIST).json(path, multiLine=True)


def read_worklist_snapshot(spark: SparkSession, path: str, schema) -> DataFrame:
    """The last snapshot that is whole."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).json(path)
    last = rows.agg(F.max("batch").alias("batch"))
    return rows.join(last, "batch", "left_semi").drop("batch")


def write_worklist(entries: DataFrame, path: str, batch: int = 0) -> None:
    """A snapshot in serving order, globally sorted across its files; earlier snapshots stay."""
    (wl.ordered(entries).withColumn("batch", F.lit(batch).cast("bigint")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("batch").json(path))


def export_results(results: DataFrame, path: str) -> None:
    """Study results without the per-slice block."""
    results.drop("per_slice_probs").write.json(path)


# ---- ledger ----

def append_ledger(calls: DataFrame, path: str) -> None:
    """Append call records as CSV part files, each with its header."""
    calls.write.mode("append").csv(path, header=True)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Blank numbers read as 0."""
    rows = spark.read.schema(schemas.LEDGER).csv(path, header=True)
    return rows.fillna(0, [*K.LEDGER_NUMBERS, "total_tokens", "latency_ms"])
