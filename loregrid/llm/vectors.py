"""Vector columns: which rows take part, copies of one vector, and numpy views."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(table: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, v, ok, h1, h2): v as doubles; ok for vectors without null or non-finite parts, not all 0.

    Vectors of another length than the most frequent one (of equally frequent ones the
    shortest) and rows without an id are not ok. h1 and h2 are equal for equal vectors.
    """
    raw = F.col(f"`{vector_column}`").cast("array<double>")
    finite: Column = F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = F.coalesce(finite & F.exists(raw, lambda x: x != 0.0) & F.col(f"`{id_column}`").isNotNull(), F.lit(False))
    rows = table.select(F.col(f"`{id_column}`").cast("long").alias("id"), raw.alias("v"), ok.alias("ok"))
    lengths = rows.where("ok").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    length = lengths.d if lengths else 0
    v = F.transform("v", lambda x: x + 0.0)  # -0.0 and 0.0 are one
    return rows.select("id", "v", (F.col("ok") & (F.size("v") == length)).alias("ok"), F.xxhash64(v).alias("h1"), F.xxhash64(F.lit(23), v).alias("h2"))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls, all of one length, as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, whatever their magnitude."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, which rounds nothing, so that their squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0))[1][:, None])


def lists(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as a list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1)))
