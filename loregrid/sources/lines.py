"""Lines of text files with their numbers, read in splits of any size."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.session import ship

#: A table of at most so many rows, of a path and two numbers each, is broadcast.
MOST_BLOCKS = 100_000
_UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}


def _size(setting: str) -> int:
    number, unit = re.fullmatch(r"(\d+)([a-z]*)", setting.strip().lower()).groups()
    return int(number) * _UNITS[unit]


def blocks_at_most(spark: SparkSession, root: str, pattern: str) -> int:
    """A bound of the number of splits that Spark may read the files in; lists them, reads none."""
    least = min(_size(spark.conf.get(f"spark.sql.files.{c}")) for c in ("maxPartitionBytes", "openCostInBytes"))
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return found.agg(F.sum(F.ceil(F.col("length") / max(least, 1)) + 1)).first()[0] or 0


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's position within its split, whose rows a task reads one after another."""
    last, seen = None, 0
    for batch in batches:
        if not (n := batch.num_rows):
            continue
        paths, starts = batch.column("path"), batch.column("at").to_numpy(zero_copy_only=False)
        codes = paths.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        new = np.ones(n, bool)
        new[1:] = (codes[1:] != codes[:-1]) | (starts[1:] != starts[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        position = np.arange(n) - first
        if (paths[0].as_py(), int(starts[0])) == last:
            position[first == 0] += seen
        last, seen = (paths[n - 1].as_py(), int(starts[n - 1])), int(position[n - 1]) + 1
        yield pa.record_batch([paths, batch.column("at"), batch.column("value"), pa.array(position, pa.int64())], ["path", "at", "value", "position"])


def numbered_lines(spark: SparkSession, root: str, pattern: str = "*", where: Column | None = None) -> DataFrame:
    """(path, line, value) of the lines of all files below ``root``, numbered from 1.

    A file is read in as many splits as Spark makes of it. One pass counts the lines of every
    split, and a running sum over a file's splits says how many lines come before each. Lines
    end with a line feed only; blank ones count. ``where`` is a condition on ``path`` alone,
    by which whole files are left out unread. No line is shuffled while the splits number at
    most ``MOST_BLOCKS``; with more, lines meet the counts by (path, split), which is even.
    """
    ship(spark)
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("lineSep", "\n").text(root)
    rows = read.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), "value")
    rows = rows if where is None else rows.where(where)
    before = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("path", "at").agg(F.count("*").alias("n")).select("path", "at", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    if blocks_at_most(spark, root, pattern) <= MOST_BLOCKS:
        counts = F.broadcast(counts)
    placed = rows.mapInArrow(_numbered, "path string, at long, value string, position long")
    return placed.join(counts, ["path", "at"]).select("path", (F.col("before") + F.col("position") + 1).alias("line"), "value")
