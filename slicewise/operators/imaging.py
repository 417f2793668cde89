"""Per-slice array work on Arrow batches: windows, resize, augmentation, error capture.

Full-size slices hold a quarter of a million values; numpy on Arrow batches beats
per-element expressions there. Keep ``spark.sql.execution.arrow.maxRecordsPerBatch``
at a few dozen for such rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slicewise import constants as K
from slicewise.functions import numeric as N
from slicewise.functions import packed


def window_arrow(hu: Column, low: float, high: float, half: bool = True) -> Column:
    """Window encoding of whole blocks, optionally rounded to half precision."""
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def apply(batch: pd.Series) -> pd.Series:
        kind = np.float16 if half else np.float32
        return batch.map(lambda a: None if a is None else np.clip(
            (np.asarray(a, np.float32) - low) / (high - low), 0, 1).astype(kind).astype(np.float32))
    return apply(hu)


def windows_once(blocks: DataFrame, windows: dict = K.WINDOWS, hu: str = "hu", half: bool = True) -> DataFrame:
    """Several encodings from one read: one Arrow pass, one column per window."""
    names = list(windows)
    out = T.StructType([T.StructField(n, T.ArrayType(T.FloatType())) for n in names])
    kind = np.float16 if half else np.float32

    @F.pandas_udf(out)
    def apply(batch: pd.Series) -> pd.DataFrame:
        arrays = [np.asarray(a, np.float32) for a in batch]
        return pd.DataFrame({
            n: [np.clip((a - lo) / (hi - lo), 0, 1).astype(kind).astype(np.float32) for a in arrays]
            for n, (lo, hi) in windows.items()})

    return (blocks.withColumn("_w", apply(F.col(hu)))
            .select("*", *[F.col(f"_w.{n}").alias(f"{hu}_{n}") for n in names]).drop("_w"))


def axis_weights(n_in: int, n_out: int, mode: str) -> np.ndarray:
    """The (n_out, n_in) matrix of linear interpolation along one axis.

    ``corner`` maps the end points onto each other, ``half_pixel`` the pixel
    areas (edges clamped).
    """
    at = np.arange(n_out, dtype=np.float64)
    if mode == "corner":
        at = at * ((n_in - 1) / (n_out - 1)) if n_out > 1 else at * 0
    else:
        at = np.clip((at + 0.5) * (n_in / n_out) - 0.5, 0, None)
    left = np.minimum(np.floor(at).astype(int), n_in - 1)
    right = np.minimum(left + 1, n_in - 1)
    share = np.clip(at - left, 0, 1)
    weights = np.zeros((n_out, n_in))
    np.add.at(weights, (np.arange(n_out), left), 1 - share)
    np.add.at(weights, (np.arange(n_out), right), share)
    return weights


def _block_type(blocks: DataFrame, column: str) -> T.DataType:
    kind = blocks.schema[column].dataType
    return kind if isinstance(kind, T.BinaryType) else T.ArrayType(T.DoubleType())


def resize(blocks: DataFrame, size: int, mode: str = "half_pixel", column: str = "image_norm") -> DataFrame:
    """Bilinear resize of square or oblong blocks to size x size (columns h, w, ``column``).

    Packed blocks are read and written packed, arrays as arrays.
    """
    kind = _block_type(blocks, column)
    read, write = packed.codec(kind)
    spec = T.StructType([f for f in blocks.schema.fields if f.name not in ("h", "w", column)] + [
        T.StructField("h", T.IntegerType()), T.StructField("w", T.IntegerType()),
        T.StructField(column, kind)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, np.ndarray] = {}

        def along(n: int) -> np.ndarray:
            return known.setdefault(n, axis_weights(n, size, mode))

        for pdf in batches:
            out = [write((along(h) @ read(a).reshape(h, w) @ along(w).T).ravel())
                   for a, h, w in zip(pdf[column], pdf["h"], pdf["w"])]
            yield pdf.assign(**{column: out, "h": size, "w": size})[spec.names]

    return blocks.mapInPandas(run, spec)


def augment(blocks: DataFrame, copies: int = 1, jitter: float = 0.04, seed: int = 42,
            column: str = "image_norm") -> DataFrame:
    """Augmented copies: flip (p 0.5), quarter turns 0..3, additive jitter, clip.

    The parameters are columns drawn from a hash of (image, copy, seed), so a
    re-run task makes the same copies. Packed blocks give packed copies.
    """
    kind = _block_type(blocks, column)
    read, write = packed.codec(kind)
    key = F.concat_ws("|", F.col("image_id"), F.col("copy"), F.lit(str(seed)))
    drawn = (blocks.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
             .withColumns({"flip": N.unit_draw(key, "f") > 0.5,
                           "turns": F.floor(N.unit_draw(key, "t") * 4).cast("int"),
                           "shift": (N.unit_draw(key, "j") * 2 - 1) * jitter}))
    spec = T.StructType([f if f.name != column else T.StructField(column, kind)
                         for f in drawn.schema.fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done, heights, widths = [], [], []
            for a, h, w, flip, turns, shift in zip(pdf[column], pdf["h"], pdf["w"], pdf["flip"],
                                                   pdf["turns"], pdf["shift"]):
                block = read(a).reshape(h, w)
                block = np.rot90(block[:, ::-1] if flip else block, turns)
                done.append(write(np.clip(block + shift, 0.0, 1.0).ravel()))
                heights.append(block.shape[0])
                widths.append(block.shape[1])
            yield pdf.assign(**{column: done, "h": heights, "w": widths})[spec.names]

    return drawn.mapInPandas(run, spec)


def guarded(df: DataFrame, make: Callable[[], Callable[[object], np.ndarray]], source: str,
            key: str = "image_id", result: str = "values") -> DataFrame:
    """Run a per-row step that may fail: every row comes back with a status and a message.

    ``make`` sets the step up once per Python worker task.
    """
    spec = T.StructType([df.schema[key], T.StructField(result, T.ArrayType(T.DoubleType())),
                         T.StructField("status", T.StringType()), T.StructField("message", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = make()
        for pdf in batches:
            rows = []
            for k, v in zip(pdf[key], pdf[source]):
                try:
                    rows.append((k, np.asarray(step(v), np.float64), "ok", None))
                except Exception as exc:  # the message is the result here
                    rows.append((k, None, "error", str(exc)))
            yield pd.DataFrame(rows, columns=spec.names)

    return df.select(key, source).mapInPandas(run, spec)
