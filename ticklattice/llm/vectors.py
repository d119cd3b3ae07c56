"""Vectors as packed bytes: what the vector operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(column: str):
    """True where the vector is not null, has no null or non-finite component and is not zero."""
    x = F.col(column)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(x.isNotNull() & ~bad & F.exists(x, lambda v: v != 0), F.lit(False))


def packed(vectors: DataFrame, column: str, *keep: str) -> DataFrame:
    """The columns in `keep`, dim, and v: the vector as bytes of 64-bit floats (32-bit ones if it has such)."""
    kinds = dict(vectors.dtypes)
    kind = "<f4" if kinds[column] == "array<float>" else "<f8"

    def run(batches):
        for b in batches:
            rows = [np.array(x, kind) for x in b.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([len(x) for x in rows], pa.int32()), pa.array([x.tobytes() for x in rows], pa.binary())], names=[*keep, "dim", "v"])

    return vectors.select(*keep, column).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "dim int", "v binary"]))


def unpacked(column, dim: int) -> np.ndarray:
    """A matrix of doubles from a column of bytes; all rows have `dim` components."""
    data = column.to_pylist()
    if not data:
        return np.zeros((0, dim))
    return np.frombuffer(b"".join(data), "<f4" if len(data[0]) == 4 * dim else "<f8").astype(np.float64).reshape(-1, dim)
