"""Compressed bitmaps over 32,768 positions, as binary columns.

A bitmap is stored in whichever of three forms is smallest: the sorted
positions (2 bytes each), the runs (4 bytes each) or the plain 4,096 bytes.
The first byte names the form: A, R or B.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGE_BITS = 15
SIZE = 1 << RANGE_BITS


def pack(positions: np.ndarray) -> bytes:
    """Compress sorted distinct positions."""
    pos = np.asarray(positions, dtype="<u2")
    if not len(pos):
        return b"A"
    cuts = np.flatnonzero(np.diff(pos.astype(np.int32)) != 1)
    starts, ends = pos[np.r_[0, cuts + 1]], pos[np.r_[cuts, len(pos) - 1]]
    if len(starts) * 2 < len(pos) and len(starts) * 4 < SIZE // 8:
        return b"R" + np.stack([starts, ends], axis=1).astype("<u2").tobytes()
    if len(pos) * 2 < SIZE // 8:
        return b"A" + pos.tobytes()
    dense = np.zeros(SIZE, dtype=bool)
    dense[pos] = True
    return b"B" + np.packbits(dense, bitorder="little").tobytes()


def unpack(data: bytes | None) -> np.ndarray:
    """Sorted positions of a compressed bitmap; none for null."""
    if not data:
        return np.zeros(0, dtype=np.int64)
    body = data[1:]
    if data[:1] == b"A":
        return np.frombuffer(body, dtype="<u2").astype(np.int64)
    if data[:1] == b"R":
        runs = np.frombuffer(body, dtype="<u2").astype(np.int64).reshape(-1, 2)
        return np.concatenate([np.arange(a, b + 1) for a, b in runs])
    return np.flatnonzero(np.unpackbits(np.frombuffer(body, dtype=np.uint8), bitorder="little")).astype(np.int64)


def and_not(a: bytes | None, b: bytes | None) -> bytes:
    """The positions of `a` that are not in `b`."""
    x = unpack(a)
    if b and b[:1] == b"B":
        keep = np.unpackbits(np.frombuffer(b[1:], dtype=np.uint8), bitorder="little")[x] == 0
    else:
        keep = ~np.isin(x, unpack(b), assume_unique=True)
    return pack(x[keep])


@F.pandas_udf(T.BinaryType())
def compress(dense: pd.Series) -> pd.Series:
    """From the plain bytes of `bitmap_construct_agg`."""
    return dense.map(lambda d: None if d is None else pack(np.flatnonzero(np.unpackbits(np.frombuffer(d, dtype=np.uint8), bitorder="little"))))


@F.pandas_udf(T.BinaryType())
def bitmap_and_not(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([and_not(x, y) for x, y in zip(a, b)], dtype=object)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def bitmap_positions(a: pd.Series) -> pd.Series:
    return a.map(lambda x: unpack(x).astype(np.int32))
