"""Vectors packed into blocks, so that a task compares matrices and Spark pairs blocks instead of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors of one block at most, whatever the table: two blocks of 64 dimensions and their products are a megabyte.
ROWS = 256


def packed(df: DataFrame, key: str, vector: str, within: str | None = None) -> DataFrame:
    """``keys``, ``dim`` and ``matrix`` (doubles, row by row) of up to ``ROWS`` vectors, of one value of ``within`` (an int) if given.

    Vectors of different lengths are in different blocks; those that are null or hold a null are in blocks of ``dim`` -1
    without a matrix.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, vectors = batch.column(0), batch.column(1)
            if isinstance(keys, pa.ChunkedArray):
                keys, vectors = keys.combine_chunks(), vectors.combine_chunks()
            dims = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False).copy()
            dims[pc.list_parent_indices(vectors).to_numpy(zero_copy_only=False)[pc.list_flatten(vectors).is_null().to_numpy(zero_copy_only=False)]] = -1
            groups = batch.column(2).to_numpy(zero_copy_only=False) if within else np.zeros(len(dims), int)
            for dim, group in np.unique(np.stack([dims, groups], 1), axis=0):
                rows = np.flatnonzero((dims == dim) & (groups == group))
                for at in range(0, len(rows), ROWS):
                    part = pa.array(rows[at : at + ROWS])
                    matrix = pc.list_flatten(vectors.take(part)).to_numpy(zero_copy_only=False).tobytes() if dim >= 0 else b""
                    made = [pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), keys.take(part)), pa.array([dim], pa.int32()), pa.array([matrix], pa.binary())]
                    yield pa.RecordBatch.from_arrays(made + ([pa.array([group], pa.int32())] if within else []), ["keys", "dim", "matrix"] + ([within] if within else []))

    rows = df.select(F.col(key), F.col(vector).cast("array<double>").alias("_vector"), *([F.col(within).cast("int")] if within else []))
    return rows.mapInArrow(run, f"keys array<{kind}>, dim int, matrix binary" + (f", {within} int" if within else ""))


def unpacked(matrix: bytes, dim: int) -> np.ndarray:
    """The vectors of a block as rows."""
    return np.frombuffer(matrix, np.float64).reshape(-1, dim)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of ``a`` with all of ``b``, each summed in the order of the dimensions."""
    across, down = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    found, part = np.zeros((len(a), len(b))), np.empty((len(a), len(b)))
    for x, y in zip(across, down, strict=True):
        np.multiply(x[:, None], y[None], out=part)
        found += part
    return found
