"""Pairs of vectors within a cosine distance, by cells around pivots."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import ship
from .retrieval import cosine

#: Pivots at most, and rows of the searched side that one unit of work holds on average at most.
PIVOTS, UNIT = 64, 4096
_SLACK = 1e-6  # of angles, for rounding


def _angles(vectors: pd.Series, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have a direction and the pivots' length, and their angles with all pivots."""
    width = pivots.shape[1] if len(pivots) else 0
    known = np.array([v is not None and len(v) == width and width > 0 for v in vectors], bool)
    out = np.full((len(vectors), len(pivots)), np.nan)
    if known.any():
        rows = np.array([np.asarray(v, dtype="float64") for v in vectors[known]])
        with np.errstate(all="ignore"):
            rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # so that no square is lost
            cos = rows @ pivots.T / np.sqrt((rows * rows).sum(axis=1))[:, None]
        out[known] = np.arccos(np.clip(cos, -1, 1))
    return np.isfinite(out).all(axis=1) & known, out


def _pivots(rows: DataFrame, most: int) -> np.ndarray:
    """Unit vectors of at most ``most`` rows, the first by a hash of the vector, of the commonest length among them."""
    whole = rows.where(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)) & F.exists("embedding", lambda x: x != 0))
    picked = [np.asarray(r.embedding, dtype="float64") for r in whole.orderBy(F.xxhash64("embedding")).limit(most).select("embedding").collect()]
    picked = [v / np.linalg.norm(v) for v in picked if np.isfinite(v).all() and 0 < np.linalg.norm(v) < np.inf]
    if not picked:
        return np.zeros((0, 0))
    lengths = [len(v) for v in picked]
    width = max(sorted(set(lengths)), key=lengths.count)
    return np.unique(np.array([v for v in picked if len(v) == width]), axis=0)


def near_pairs(left: DataFrame, right: DataFrame, most: float, hold: Callable[[DataFrame], DataFrame] = lambda rows: rows, pivots: int = PIVOTS, unit: int = UNIT) -> DataFrame:
    """(note_id, near_id, distance): all pairs of a row of ``left`` and one of ``right`` closer than ``most``, below 1.

    ``left`` has note_id and embedding, ``right`` near_id and embedding. The rows of ``right``
    lie in the cell of the pivot that they make the smallest angle with. A row of ``left``
    goes to a cell only if the triangle inequality lets it hold something near: its angle with
    the pivot lies within the cell's range widened by the angle of ``most``, and exceeds its
    smallest angle with any pivot by twice that at most. So no pair is lost, and the distance
    itself decides. A cell of many rows is dealt to units by a hash, of the vector and id,
    and a row of ``left`` goes to all units of a cell. Vectors of other lengths than the
    pivots have a cell for each length. What is null, zero or not finite is near nothing.
    Only pivots and a row for each cell, ``pivots`` of them at most, come to the driver.
    """
    spark = left.sparkSession
    ship(spark)
    reach = math.acos(1 - most) + _SLACK
    centres = _pivots(right, pivots)

    @F.pandas_udf("cell int, angle double")
    def home(vectors: pd.Series) -> pd.DataFrame:
        ok, angles = _angles(vectors, centres)
        best = np.where(ok, np.nan_to_num(angles, nan=9).argmin(axis=1), -1) if len(centres) else np.full(len(vectors), -1)
        return pd.DataFrame({"cell": best.astype("int32"), "angle": [a[c] if c >= 0 else None for a, c in zip(angles, best, strict=True)]})

    dealt = hold(right.where("embedding IS NOT NULL").select("near_id", "embedding", home("embedding").alias("h")).select("near_id", "embedding", F.when(F.col("h.cell") < 0, -F.size("embedding") - 1).otherwise(F.col("h.cell")).alias("cell"), "h.angle"))
    found = dealt.where("cell >= 0").groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("lo"), F.max("angle").alias("hi")).collect()
    low, high, units = np.full(len(centres), np.inf), np.full(len(centres), -np.inf), np.ones(max(len(centres), 1), int)
    for r in found:
        low[r.cell], high[r.cell], units[r.cell] = r.lo - reach, r.hi + reach, -(-r.n // unit)

    @F.pandas_udf("array<int>")
    def cells(vectors: pd.Series) -> pd.Series:
        ok, angles = _angles(vectors, centres)
        near = ok[:, None] & (angles >= low) & (angles <= high) & (angles <= angles.min(axis=1, keepdims=True) + 2 * reach) if len(centres) else np.zeros((len(vectors), 0), bool)
        return pd.Series([np.flatnonzero(x).astype("int32") if k else np.array([-len(v) - 1], "int32") for v, x, k in zip(vectors, near, ok, strict=True)])

    many = F.coalesce(F.element_at(F.array(*[F.lit(int(n)) for n in units]), F.when(F.col("cell") >= 0, F.col("cell") + 1)), F.lit(1))
    asked = left.where("embedding IS NOT NULL").select("note_id", F.col("embedding").alias("q"), F.explode(cells("embedding")).alias("cell"))
    asked = asked.select("note_id", "q", "cell", F.explode(F.sequence(F.lit(0), many - 1)).alias("unit"))
    searched = dealt.select("near_id", "embedding", "cell", F.pmod(F.xxhash64("near_id", "embedding"), many).cast("int").alias("unit"))
    pairs = asked.join(searched, ["cell", "unit"]).withColumn("distance", 1 - cosine(F.col("q"), F.col("embedding")))
    return pairs.where(F.col("distance") < most).select("note_id", "near_id", "distance")
