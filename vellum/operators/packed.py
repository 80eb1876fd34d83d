"""Vectors on their way: the bytes of a vector, or of a block of them, compressed.

Vectors of counted words are mostly zeros and take a fifth of their width or less; others lose little. Nothing is rounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that are opened at a time.
ROWS = 1024


def kind_of(df: DataFrame, vec: str) -> str:
    """How vectors are sent: in the precision they have."""
    return "<f4" if df.schema[vec].dataType.elementType.typeName() == "float" else "<f8"


def squeeze(m: np.ndarray) -> bytes:
    return pa.Codec("zstd", compression_level=1).compress(np.ascontiguousarray(m), asbytes=True)


def unsqueeze(data, kind: str, size: int) -> np.ndarray:
    """The ``size`` numbers in ``data``, read-only."""
    return np.frombuffer(pa.Codec("zstd").decompress(data, decompressed_size=size * np.dtype(kind).itemsize), kind)


def one_row(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _pack(kind: str, vecs: pa.Array) -> pa.Array:
    lens = pc.fill_null(pc.list_value_length(vecs), -1).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(vecs).to_numpy(zero_copy_only=False).astype(kind, copy=False)
    ends, codec = np.cumsum(np.maximum(lens, 0)), pa.Codec("zstd", compression_level=1)
    return pa.array([None if n < 0 else int(n).to_bytes(4, "big") + codec.compress(flat[end - n:end], asbytes=True)
                     for n, end in zip(lens.tolist(), ends.tolist(), strict=True)], pa.binary())


def packed(df: DataFrame, key: str, vec: str) -> DataFrame:
    """``(id, vec)``: the rows of ``df`` with the vector's length (four bytes) and its compressed numbers; a missing vector stays
    missing. Directly above the embedding it runs in the same Python worker, and no plain vector passes through the JVM."""
    kind = kind_of(df, vec)
    if hasattr(F, "arrow_udf"):
        @F.arrow_udf(T.BinaryType())
        def pack(vecs: pa.Array) -> pa.Array:
            return _pack(kind, vecs)
    else:  # pragma: no cover - before Spark 4.1
        @F.pandas_udf(T.BinaryType())
        def pack(vecs: pd.Series) -> pd.Series:
            return _pack(kind, pa.array(vecs, pa.list_(pa.float32() if kind == "<f4" else pa.float64()))).to_pandas()
    return df.select(F.col(key).alias("id"), pack(F.col(vec)).alias("vec"))


def counted(rows: DataFrame) -> tuple[int, int]:
    """Rows, and the width of the longest vector (1 where there is none)."""
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.conv(F.hex(F.substring("vec", 1, 4)), 16, 10).cast("int"))).first()
    return n, max(1, width or 1)


def opened(batch: pa.RecordBatch, kind: str, width: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and matrices of packed rows (id, vec, ...), ``ROWS`` at a time; a missing vector is a zero row. A vector of another width
    raises: it was made by another model."""
    codec, size = pa.Codec("zstd"), np.dtype(kind).itemsize * width
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        m = np.zeros((part.num_rows, width), kind)
        for row, data in enumerate(part.column(1).to_pylist()):
            if data is None:
                continue
            if (n := int.from_bytes(data[:4], "big")) != width:
                raise ValueError(f"vectors must have {width} entries, found one with {n}")
            m[row] = np.frombuffer(codec.decompress(memoryview(data)[4:], decompressed_size=size), kind)
        yield pa.concat_arrays([part.column(0)]), m
