"""Packed blocks: half-precision values as little-endian bytes, two a cell, in row order.

Windowed slices are kept at half precision; as an array of doubles the same values take
four times the bytes. ``h`` and ``w`` beside the bytes give the shape. Packing rounds to
the nearest half, ties to even; values beyond the range become infinite, absent cells NaN;
an absent block stays absent. Unpacking and packing again gives the same bytes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

HALF = np.dtype("<f2")


def to_bytes(values: object) -> bytes:
    with np.errstate(over="ignore"):
        return np.asarray(values, np.float64).astype(HALF).tobytes()


def from_bytes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, HALF).astype(np.float64)


def codec(kind: T.DataType) -> tuple[Callable, Callable]:
    """How a step on Arrow batches reads and writes the blocks of a column of this type."""
    if isinstance(kind, T.BinaryType):
        return from_bytes, to_bytes
    return lambda values: np.asarray(values, np.float64), lambda block: block


def pack(values: Column) -> Column:
    """An array column as packed blocks."""
    @F.pandas_udf(T.BinaryType())
    def apply(batch: pd.Series) -> pd.Series:
        return batch.map(lambda a: None if a is None else to_bytes(a))
    return apply(values)


def unpack(data: Column) -> Column:
    """Packed blocks as an array column of single precision, which holds every half exactly."""
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def apply(batch: pd.Series) -> pd.Series:
        return batch.map(lambda b: None if b is None else np.frombuffer(b, HALF).astype(np.float32))
    return apply(data)


def fits(data: Column, h: Column, w: Column) -> Column:
    """Whether the bytes are those of an h x w block."""
    return F.octet_length(data) == 2 * h * w
