"""Slice scores -> slice order, study results, hot slices, batch scoring.

Scores are held as one double column per class (``p_<class>``).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slicewise import constants as K
from slicewise.functions import numeric as N
from slicewise.operators.ordered import scan


def score_columns(classes: list[str] = K.CLASSES, prefix: str = "p_") -> list[str]:
    return [prefix + c for c in classes]


def slice_index(slices: DataFrame, group: tuple[str, ...] = ("study_uid",), z: str = "z_mm",
                order: tuple[str, ...] = ("path",), read_error: str | None = None,
                ranges: int | None = None) -> DataFrame:
    """0-based index from the highest z down, ties in file order.

    An absent z counts as 0. Where ``read_error`` is set, the running file
    position stands in for z.
    """
    keys, files = list(group), [F.col(c) for c in order]
    rank_z: Column = F.coalesce(F.col(z), F.lit(0.0))
    if read_error:
        slices = scan(slices, keys, files, position="_file_pos", ranges=ranges)
        rank_z = F.when(F.col(read_error), F.col("_file_pos").cast("double")).otherwise(rank_z)
    placed = slices.withColumn("_z", rank_z)
    return (scan(placed, keys, [F.desc("_z"), *files], position="slice_index", ranges=ranges)
            .drop("_z", "_file_pos"))


def study_scores(slices: DataFrame, threshold: float = K.POSITIVE_AT) -> DataFrame:
    """Highest score per class and study, the call, and the dominant subtype.

    A class is called on the unrounded maximum; the dominant subtype is the
    called one with the highest *rounded* score, first in class order on ties.
    """
    top = slices.groupBy("study_uid").agg(
        F.count(F.lit(1)).alias("slice_count"),
        *[F.max(f"p_{c}").alias(f"m_{c}") for c in K.CLASSES])
    rounded = top.select("*", *[N.round_even(F.col(f"m_{c}"), 4).alias(f"prob_{c}") for c in K.CLASSES],
                         *[(F.col(f"m_{c}") >= threshold).alias(f"positive_{c}") for c in K.CLASSES])
    called = [F.when(F.col(f"positive_{c}"), F.col(f"prob_{c}")) for c in K.SUBTYPES]
    best = F.greatest(*called)
    key = F.coalesce(*[F.when(v == best, F.lit(c)) for c, v in zip(K.SUBTYPES, called)], F.lit(""))
    display = F.coalesce(*[F.when(v == best, F.lit(K.CLASS_DISPLAY[c])) for c, v in zip(K.SUBTYPES, called)],
                         F.when(F.col("positive_any"), F.lit(K.UNDETERMINED)), F.lit(""))
    return rounded.select(
        "study_uid", "slice_count",
        *[f"prob_{c}" for c in K.CLASSES], *[f"positive_{c}" for c in K.CLASSES],
        F.col("positive_any").alias("overall_positive"),
        key.alias("dominant_key"), display.alias("dominant_class"))


def study_document(scores: DataFrame) -> DataFrame:
    """The nested study result: ``study_level`` map of structs beside the scalars."""
    pairs = []
    for c in K.CLASSES:
        pairs += [F.lit(c), F.struct(F.col(f"prob_{c}").alias("prob"),
                                     F.col(f"positive_{c}").alias("positive"),
                                     F.lit(K.CLASS_DISPLAY[c]).alias("display"))]
    return scores.select("study_uid", F.col("slice_count").alias("valid_slices"),
                         F.create_map(*pairs).alias("study_level"),
                         "overall_positive", "dominant_class", "dominant_key")


def hot_slices(indexed: DataFrame, threshold: float = K.POSITIVE_AT,
               per_class: int = K.HOT_PER_CLASS) -> DataFrame:
    """The top slices of every positive class, one row per slice.

    A slice picked for several classes keeps the one with the highest score
    (class order on ties). Rank limits run before the shuffle, so a study of
    any size sends only a few rows per task.
    """
    picks = F.filter(
        F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(c).alias("cls"), F.col(f"p_{c}").alias("p"))
                  for i, c in enumerate(K.CLASSES)]),
        lambda s: s["p"] >= threshold)
    sop = F.col("sop_uid") if "sop_uid" in indexed.columns else F.lit("")
    long = indexed.select("study_uid", "slice_index", "z_mm", sop.alias("sop_uid"),
                          F.explode(picks).alias("s")).select(
        "study_uid", "slice_index", "z_mm", "sop_uid", "s.*")
    by_class = W.partitionBy("study_uid", "cls").orderBy(F.desc("p"), "slice_index")
    top = long.withColumn("rn", F.row_number().over(by_class)).filter(F.col("rn") <= per_class)
    best = top.groupBy("study_uid", "slice_index").agg(
        F.max("z_mm").alias("z_mm"), F.max("sop_uid").alias("sop_uid"),
        F.max_by(F.struct("cls", "p"), F.struct("p", -F.col("ord"))).alias("s"))
    display = F.coalesce(*[F.when(F.col("s.cls") == c, F.lit(K.CLASS_DISPLAY[c])) for c in K.CLASSES])
    return best.select("study_uid", "slice_index", N.round_even(F.col("z_mm").cast("double"), 1).alias("slice_z_mm"), "sop_uid",
                       F.col("s.cls").alias("dominant_class"), display.alias("display_class"),
                       N.round_even(F.col("s.p"), 4).alias("prob"))


def hot_slice_list(hot: DataFrame) -> DataFrame:
    """One row per study with its hot slices by index (at most three per class)."""
    return hot.groupBy("study_uid").agg(hot_list().alias("hot_slices"))


def hot_list() -> Column:
    """Aggregate of a study's hot slices: all of them in an array, by index."""
    return F.array_sort(F.collect_list(F.struct("slice_index", "slice_z_mm", "sop_uid", "dominant_class", "display_class", "prob")))


def find_slice(requests: DataFrame, slices: DataFrame) -> DataFrame:
    """Resolve (study_uid, sop_uid, slice_index): by uid (first file that has it), else by position."""
    by_uid = (slices.filter(F.col("sop_uid") != "").groupBy("study_uid", "sop_uid")
              .agg(F.min("path").alias("_p_uid")))
    by_pos = slices.select("study_uid", F.col("file_index").alias("slice_index"), F.col("path").alias("_p_pos"))
    return (requests.join(by_uid, ["study_uid", "sop_uid"], "left")
            .join(by_pos, ["study_uid", "slice_index"], "left")
            .withColumn("path", F.coalesce("_p_uid", "_p_pos")).drop("_p_uid", "_p_pos"))


def linear_scorer(weights: np.ndarray, bias: np.ndarray) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """A small scorer for tests: probabilities of a linear model on the flat block."""
    def make():
        def predict(block: np.ndarray) -> np.ndarray:
            flat = np.asarray(block, dtype="float64").reshape(len(block), -1)
            return 1.0 / (1.0 + np.exp(-(flat @ weights + bias)))
        return predict
    return make


def score_batches(tensors: DataFrame, make_predict: Callable, shape: tuple[int, ...], block: str = "image_norm",
                  batch_size: int = 32) -> DataFrame:
    """Six probabilities per block of ``shape``, in batches; the scorer is loaded once per Python worker."""
    scorer = predict_batch_udf(make_predict, return_type=T.ArrayType(T.DoubleType()),
                               batch_size=batch_size, input_tensor_shapes=[list(shape)])
    scored = tensors.withColumn("_probs", scorer(F.col(block)))
    return scored.select("*", *[F.get("_probs", F.lit(i)).alias(f"p_{c}") for i, c in enumerate(K.CLASSES)]).drop("_probs")


def isolating(make_predict: Callable, n_out: int) -> Callable:
    """A scorer that answers every block of a batch: a failing batch is halved until the bad blocks stand alone.

    Returns the probabilities (NaN for a bad block) and the message of its failure (null for
    the others). Each bad block costs about twice log2(batch size) more calls; the good ones
    keep the probabilities that they would have had.
    """
    def make():
        predict = make_predict()

        def answer(block: np.ndarray) -> tuple[np.ndarray, list]:
            try:
                probs = np.asarray(predict(block), dtype="float64")
                if probs.shape != (len(block), n_out):
                    raise ValueError(f"scorer returned shape {probs.shape}")
                return probs, [None] * len(block)
            except Exception as exc:  # recorded for its block, never raised: one bad block must not stop the scan
                if len(block) == 1:
                    return np.full((1, n_out), np.nan), [str(exc) or type(exc).__name__]
                half = len(block) // 2
                (p, e), (q, f) = answer(block[:half]), answer(block[half:])
                return np.concatenate([p, q]), e + f

        return answer
    return make


def score_isolated(blocks: DataFrame, make_predict: Callable, shape: tuple[int, ...], block: str = "image_norm",
                   batch_size: int = 32) -> DataFrame:
    """:func:`score_batches` with failures as values: ``error`` is null, or says why the block has no scores."""
    names = [f"p_{c}" for c in K.CLASSES]
    make = isolating(make_predict, len(names))

    def load():
        answer = make()

        def run(batch: np.ndarray) -> dict:
            probs, errors = answer(batch)
            return {**{n: probs[:, i] for i, n in enumerate(names)}, "error": np.array(errors, dtype=object)}
        return run

    kind = T.StructType([*[T.StructField(n, T.DoubleType()) for n in names], T.StructField("error", T.StringType())])
    scorer = predict_batch_udf(load, return_type=kind, batch_size=batch_size, input_tensor_shapes=[list(shape)])
    scored = blocks.withColumn("_s", scorer(F.col(block)))
    good = F.col("_s.error").isNull()
    return scored.select(*blocks.columns, *[F.when(good, F.col(f"_s.{n}")).alias(n) for n in names], F.col("_s.error").alias("error"))


def failed_studies(scored: DataFrame) -> DataFrame:
    """(study_uid, reason): studies with a block that has no scores, and why its first one by path has none."""
    return scored.filter("error IS NOT NULL").groupBy("study_uid").agg(F.min_by("error", "path").alias("reason"))
