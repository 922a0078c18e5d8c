"""The byte work that has no built-in function: small Arrow and pandas helpers inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
PEAK_16_BIT = 65535.0
PERFECT_DB = 99.0


def plane_psnr(a: bytes | None, b: bytes | None) -> float | None:
    if a is None or b is None:
        return None
    if len(a) != len(b) or not a or len(a) % 2:
        return 0.0
    delta = np.frombuffer(a, "<u2").astype(np.int64) - np.frombuffer(b, "<u2")
    error = int(np.dot(delta, delta)) / delta.size
    if error <= 0:
        return PERFECT_DB
    return float(10.0 * np.log10(PEAK_16_BIT * PEAK_16_BIT / error))


@F.pandas_udf(T.DoubleType())
def psnr_planes(a: pd.Series, b: pd.Series) -> pd.Series:
    """PSNR of two frames given as 16-bit little-endian planes; different sizes give 0."""
    return pd.Series([plane_psnr(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.BinaryType())
def planar(frame: pd.Series) -> pd.Series:
    """Interleaved 16-bit RGB to three planes in a row."""
    return frame.map(
        lambda raw: None
        if raw is None
        else np.frombuffer(raw, "<u2").reshape(-1, 3).T.tobytes()
    )


@F.pandas_udf(T.BinaryType())
def repack_words(payload: pd.Series) -> pd.Series:
    """Four-byte words to three-byte little-endian samples: bytes 2, 1, 0 of each word."""
    return payload.map(
        lambda raw: None
        if raw is None
        else np.frombuffer(raw[: len(raw) // 4 * 4], np.uint8)
        .reshape(-1, 4)[:, [2, 1, 0]]
        .tobytes()
    )


def framing_fault(data: bytes) -> str | None:
    """Why 4-byte big-endian length prefixes do not tile a packet exactly, or None."""
    at, size = 0, len(data)
    if size < 8:
        return None
    while at + 4 <= size:
        length = int.from_bytes(data[at : at + 4], "big")
        if length == 0:
            return f"empty unit at {at}"
        if at + 4 + length > size:
            return f"unit at {at} runs over the end"
        at += 4 + length
    return None if at == size else f"{size - at} bytes left over"


def batches(rows: Iterator[dict], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Group an iterator of rows into Arrow batches, never more than ``size`` rows in memory."""
    pending: list[dict] = []
    for row in rows:
        pending.append(row)
        if len(pending) >= size:
            yield pa.RecordBatch.from_pylist(pending, schema=schema)
            pending = []
    if pending:
        yield pa.RecordBatch.from_pylist(pending, schema=schema)
