"""Shards of near equal bytes by Karmarkar-Karp differencing of indivisible groups.

Equal texts form a group, of one size however many rows it has. Groups are dealt into cells
by hash: ``CELLS``, or as many more as keep ``CELL_ROWS`` rows in each. Within a cell every
group begins as a partial partition of its own; then the two partial partitions of the
largest spread are combined, oppositely ordered, until one is left. Cells' partitions are
combined the same way, ``FAN`` cells at a time, by tasks, until at most FAN are left. Last,
all parts of these begin alone once more, together with the groups of more than a
``HEAVY``-th of an even share, so that what is small fills up what is large.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import drop, prepare, saved

CELLS, CELL_ROWS, FAN, HEAVY = 256, 20_000, 1024, 64


def difference(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine partial partitions, one a row: (sums, where): entry j of row i joins part where[i, j].

    Rows of the largest spread (largest less smallest sum) go first, the smallest part of
    the one onto the largest of the other. Ties go by row, so that reruns agree.
    """
    n, k = parts.shape
    sums = [np.sort(p, kind="stable")[::-1] for p in parts]
    place = [np.argsort(-p, kind="stable") for p in parts]  # the entry that stands at each rank
    where = np.empty((n, k), np.int64)
    heap = [(int(s[-1] - s[0]), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    parents: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    while len(heap) > 1:
        (_, i), (_, j) = heapq.heappop(heap), heapq.heappop(heap)
        total = sums[i] + sums[j][::-1]
        order = np.argsort(-total, kind="stable")
        new = len(sums)
        sums.append(total[order])
        sums[i] = sums[j] = None
        rank = np.empty(k, np.int64)
        rank[order] = np.arange(k)
        parents.append((i, j, rank, rank[::-1]))
        heapq.heappush(heap, (int(sums[new][-1] - sums[new][0]), new))
    final: dict[int, np.ndarray] = {n + len(parents) - 1 if parents else 0: np.arange(k)}
    for step in range(len(parents) - 1, -1, -1):
        at = final.pop(n + step)
        i, j, a, b = parents[step]
        final[i], final[j] = at[a], at[b]
    for i in range(n):
        where[i, place[i]] = final[i]
    return sums[-1] if parents else sums[0], where


def alone(sizes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """``difference`` of sizes that begin alone: (sums, the part of each)."""
    parts = np.zeros((len(sizes), shards), np.int64)
    parts[:, 0] = sizes
    total, where = difference(parts)
    return total, where[:, 0].astype(np.int32)


def _assign(shards: int):
    def cell(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return alone(sizes, shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def finish() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            total, part = cell(table["bytes"].to_numpy())
            sums = np.zeros(table.num_rows, np.int64)  # the cell's sums ride on its first rows
            extra = max(0, shards - table.num_rows)
            sums = np.concatenate([sums, np.zeros(extra, np.int64)])
            sums[:shards] = total
            empty = pa.nulls(extra, pa.int64())
            grow = lambda c: pa.chunked_array([*table[c].chunks, empty]) if extra else table[c]
            rank = np.where(np.arange(len(sums)) < shards, np.arange(len(sums)), -1).astype(np.int32)
            cells = np.full(len(sums), table["cell"][0].as_py(), np.int32)
            part = np.concatenate([part, np.full(extra, -1, np.int32)])
            return pa.Table.from_arrays([pa.array(cells), grow("h1"), grow("h2"), pa.array(part), pa.array(rank), pa.array(sums)], ["cell", "h1", "h2", "part", "rank", "sum"]).combine_chunks().to_batches()[0]

        for batch in batches:
            cells = batch.column(0).to_numpy()
            bounds = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if b > a:
                    if held and held[-1].column(0)[0].as_py() != cells[a]:
                        yield finish()
                        held = []
                    held.append(batch.slice(a, b - a))
        if held:
            yield finish()

    return run


def _combine(shards: int, last: bool):
    """Of the cells of each group, (cell, part, above, place): where parts go, and the group's own sums."""

    def solve(above: int, rows: list[tuple]) -> pa.RecordBatch:
        if last:
            _, place = alone(np.array([r[2] for r in rows], np.int64), shards)
            columns = [[r[0] for r in rows], [r[1] for r in rows], np.zeros(len(rows)), place, np.full(len(rows), -1)]
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in columns], ["cell", "part", "above", "place", "sum"])
        cells = sorted({r[0] for r in rows})
        sums = np.zeros((len(cells), shards), np.int64)
        index = {c: i for i, c in enumerate(cells)}
        for c, rank, total in rows:
            sums[index[c], rank] = total
        total, where = difference(sums)
        n = len(cells)
        columns = [np.repeat(cells, shards), np.tile(np.arange(shards), n), np.full(n * shards, above), where.reshape(-1), np.where(np.arange(n * shards) < shards, np.tile(total, n), -1)]
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in columns], ["cell", "part", "above", "place", "sum"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for above, cell, rank, total in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if above != now and rows:
                    yield solve(now, rows)
                    rows = []
                now = above
                rows.append((cell, rank, total))
        if rows:
            yield solve(now, rows)

    return run


def _tree(sums: DataFrame, heavy: DataFrame, shards: int, cells: int) -> DataFrame:
    """(cell, part, shard) for every part of every cell, by levels of FAN cells; ``heavy`` joins at the last."""
    spec = "cell long, part long, above long, place long, sum long"
    placed = None
    while True:
        last = cells <= FAN
        rows = sums.select(F.lit(0).cast("long").alias("above"), "cell", "rank", "sum").unionByName(heavy.select(F.lit(0).cast("long").alias("above"), "cell", "rank", "sum")) if last else sums.select(F.expr(f"cell div {FAN}").alias("above"), "cell", "rank", "sum")
        level = saved(rows.repartition("above").sortWithinPartitions("above", F.desc("sum"), "cell", "rank").mapInArrow(_combine(shards, last), spec))
        step = level.select("cell", "part", "above", "place")
        if placed is None:
            placed = step.select("cell", "part", F.col("above").alias("at"), F.col("place").alias("shard"))
        else:
            up = step.select(F.col("cell").alias("at"), F.col("part").alias("shard"), "above", "place")
            own = placed.join(up, ["at", "shard"]).select("cell", "part", F.col("above").alias("at"), F.col("place").alias("shard"))
            placed = own.unionByName(step.where("cell < 0").select("cell", "part", F.col("above").alias("at"), F.col("place").alias("shard")))
        if last:
            return placed.select(F.col("cell").cast("int").alias("cell"), F.col("part").cast("int").alias("part"), F.col("shard").cast("int").alias("shard"))
        cells = -(-cells // FAN)
        sums = level.where("sum >= 0").groupBy("above").agg(F.array_sort(F.collect_list("sum")).alias("s")).select(F.col("above").alias("cell"), F.posexplode(F.reverse("s")).alias("rank", "sum"))


def assign_shards(docs: DataFrame, shards: int = 16, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``.

    The law is ``bytes``: shards have near equal sums of size, the UTF-8 bytes of the text
    plus 1 (null: 1); equal texts, nulls included, share a shard. A group larger than an
    even share is a shard's own. Slots number each shard's rows from 0 without gaps, in
    order of a hash cell, doc_id and text hash; rows equal in all these are alike.
    text_crc32 is null where the text is; grown_shard is null under this law.
    """
    prepare(docs.sparkSession)
    text = F.col(f"`{text_column}`").cast("string")
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(17), text, F.octet_length(text)).alias("h2"))
    rows = saved(rows)
    cells = max(CELLS, rows.count() // CELL_ROWS)
    groups = saved(rows.groupBy("h1", "h2").agg(F.sum("size").alias("bytes")))
    whole = groups.agg(F.sum("bytes")).first()[0] or 0
    large = F.col("bytes") > whole // (shards * HEAVY)
    dealt = groups.where(~large).select(F.pmod(F.xxhash64("h2", "h1"), F.lit(cells)).cast("int").alias("cell"), "h1", "h2", "bytes")
    solved = dealt.repartition("cell").sortWithinPartitions("cell", F.desc("bytes"), "h1", "h2").mapInArrow(_assign(shards), "cell int, h1 long, h2 long, part int, rank int, sum long")
    number = F.row_number().over(Window.orderBy(F.desc("bytes"), "h1", "h2")) - 1  # fewer than shards * HEAVY rows
    heavy = groups.where(large).select(F.lit(-1).alias("cell"), "h1", "h2", number.alias("part"), number.alias("rank"), F.col("bytes").alias("sum"))
    solved = saved(solved.unionByName(heavy))
    drop(groups)
    known = solved.where("rank >= 0").select(F.col("cell").cast("long").alias("cell"), "rank", "sum")
    table = _tree(known.where("cell >= 0"), known.where("cell < 0"), shards, cells)
    placed = rows.join(solved.where("part >= 0").join(table, ["cell", "part"]).select("h1", "h2", "shard"), ["h1", "h2"])
    placed = saved(placed.withColumn("lane", F.pmod(F.xxhash64("doc_id", "h1"), F.lit(cells)).cast("int")))
    drop(rows, solved)
    before = Window.partitionBy("shard").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy("shard", "lane").agg(F.count("*").alias("n")).select("shard", "lane", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("shard", "lane").orderBy("doc_id", "h1", "h2")
    numbered = placed.withColumn("slot", F.row_number().over(order).cast("long") - 1).join(base, ["shard", "lane"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("slot")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table in 16 shards of near equal bytes."""
    return assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), 16)
