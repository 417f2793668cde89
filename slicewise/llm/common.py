"""What several operators share: reading text columns of Arrow batches and small column helpers.

Words are the contract's ``[^\\x20\\x09-\\x0D]+``. ``bytes.split()`` cuts at exactly
those six bytes and ``bytes.lower()`` changes exactly A-Z, so words are taken from
UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = b" \t\n\x0b\x0c\r"


def byte_texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is the empty text."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def texts_of(column: pa.Array) -> list[str]:
    """The strings of a column; null is the empty text."""
    return ["" if t is None else t for t in column.to_pylist()]


def keep_rows(df: DataFrame, text: str, verdict: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """Rows of ``df`` whose text passes ``verdict``; all columns stay as they are."""
    at = df.columns.index(text)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(verdict(batch.column(at)), pa.bool_()))

    return df.mapInArrow(step, df.schema)


def id_crc(doc_id: str) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))


def code_points(data: bytes) -> int:
    """Code points of UTF-8 bytes."""
    return len(data) if data.isascii() else int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))
