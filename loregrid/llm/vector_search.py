"""Approximate nearest neighbours by cross-polytope hashing.

For the largest inner product, a row x becomes the unit vector (x, sqrt(M^2 - |x|^2)) / M,
M being the largest length, and a query (q, 0) / |q|: the angle then falls as the inner
product grows. A table rotates such vectors pseudo-randomly (``ROUNDS`` times random signs
and a fast Hadamard transform, after padding to a power of two) and hashes each to its
nearest signed axis, or to the nearest axes under two rotations where that takes less work.
Every row is posted once in each of ``TABLES`` tables; a query probes those buckets of each
that lie nearest to it. Whoever meets a query in a bucket is ranked by the exact inner
product, and queries that meet fewer rows than they must return are compared with all rows.

The index is fit on at most ``SAMPLE`` numbers of sampled rows: one or two axes to a hash,
the probes that give a recall of ``RECALL`` among the sample (whose neighbours lie farther
than those among all rows), and the parts into which a bucket's rows and queries are split,
so that no task holds more than about ``UNIT`` of either however large or hot a bucket is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import prepare, saved
from .text import U64, mix
from .vectors import lists, matrix, unit, usable

NEAREST, TABLES, ROUNDS, SEED = 20, 8, 3, 1
SAMPLE, TRIED, RECALL, UNIT = 1 << 18, 256, 0.97, 8192
#: Queries of one bucket that are ranked together; a shuffled probe costs as much as so many products.
BLOCK, PROBE_COST, MOST_PROBES, MOST_BUCKETS = 1024, 50, 1024, 1 << 18


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of the rows of x, whose length is a power of two."""
    n, width = x.shape
    half = 1
    while half < width:
        pairs = x.reshape(n, width // (2 * half), 2, half)
        x = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], 2).reshape(n, width)
        half *= 2
    return x


def rotated(x: np.ndarray, which: int) -> np.ndarray:
    """Unit rows of x under one of the pseudo-rotations."""
    width = 1 << max(1, int(np.ceil(np.log2(max(2, x.shape[1])))))
    out = np.zeros((len(x), width))
    out[:, : x.shape[1]] = x
    signs = np.random.default_rng([SEED, which]).choice([-1.0, 1.0], (ROUNDS, width))
    for s in signs:
        out = hadamard(out * s) / np.sqrt(width)
    return out


def lifted(v: np.ndarray, log_most: float, query: bool) -> np.ndarray:
    """Unit vectors of one more dimension; ``log_most`` is the logarithm of the largest length."""
    if query:
        return np.concatenate([unit(v), np.zeros((len(v), 1))], 1)
    most = np.abs(v).max(1, keepdims=True)
    x = v / most * np.exp(np.log(most) - log_most)
    return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1, keepdims=True)))], 1)


def _gaps(x: np.ndarray, which: int) -> np.ndarray:
    """How much farther each signed axis is than the nearest, squared, for the rows of x."""
    y = rotated(x, which)
    sides = np.stack([-y, y], 2).reshape(len(x), 2 * y.shape[1])
    return (sides.max(1, keepdims=True) - sides) ** 2


@dataclass
class Index:
    """What is fit on the sample; ``parts`` and ``query_parts`` have a number for each bucket."""

    log_most: float
    axes: int
    probes: int
    parts: list[np.ndarray]
    query_parts: list[np.ndarray]

    def posted(self, x: np.ndarray, table: int) -> np.ndarray:
        """The bucket of each row of x."""
        bucket = np.zeros(len(x), np.int64)
        for j in range(self.axes):
            gaps = _gaps(x, TABLES * j + table)
            bucket = bucket * gaps.shape[1] + gaps.argmin(1)
        return bucket

    def probed(self, x: np.ndarray, table: int) -> np.ndarray:
        """The buckets to probe for each row of x, the nearest first."""
        out = []
        step = 64 if self.axes > 1 else 1024
        for low in range(0, len(x), step):
            gaps = _gaps(x[low : low + step], table)
            for j in range(1, self.axes):
                more = _gaps(x[low : low + step], TABLES * j + table)
                gaps = (gaps[:, :, None] + more[:, None, :]).reshape(len(gaps), -1)
            near = np.argpartition(gaps, min(self.probes, gaps.shape[1]) - 1, axis=1)[:, : self.probes]
            order = np.argsort(np.take_along_axis(gaps, near, 1), axis=1, kind="stable")
            out.append(np.take_along_axis(near, order, 1))
        return np.concatenate(out) if out else np.zeros((0, 1), np.int64)


def fit(sample: np.ndarray, log_most: float, rows: int, queries: int) -> Index:
    """The index of ``rows`` rows like those of ``sample`` for ``queries`` queries."""
    tried = sample[: min(TRIED, len(sample))]
    near = tried @ sample.T
    near[np.arange(len(tried)), np.arange(len(tried))] = -np.inf
    near = np.argsort(-near, axis=1, kind="stable")[:, : min(NEAREST, max(1, len(sample) - 1))]
    asked, posted = lifted(tried, log_most, True), lifted(sample, log_most, False)
    best, steps = [], [np.full(near.shape, np.inf), np.full(near.shape, np.inf)]
    for table in range(TABLES):
        gaps, homes = zip(*((_gaps(asked, w), _gaps(posted, w).argmin(1)) for w in (table, TABLES + table)), strict=True)
        own = [np.take_along_axis(g, h[near], 1) for g, h in zip(gaps, homes, strict=True)]
        ranked = [np.sort(g, 1) for g in gaps]
        for i in range(len(tried)):  # the rank of the neighbour's bucket among all that could be probed
            steps[0][i] = np.minimum(steps[0][i], np.searchsorted(ranked[0][i], own[0][i]))
            rest = (own[0][i] + own[1][i])[:, None] - ranked[0][i][None, :]
            steps[1][i] = np.minimum(steps[1][i], np.searchsorted(ranked[1][i], rest.reshape(-1)).reshape(rest.shape).sum(1))
    buckets = 2 * rotated(asked[:1], 0).shape[1]
    for axes, step in ((1, steps[0]), (2, steps[1])):
        probes = 1 + int(np.quantile(step, RECALL, method="higher"))
        if axes == 1 or probes <= MOST_PROBES and buckets**2 <= MOST_BUCKETS:
            best.append((probes * (PROBE_COST + rows / buckets**axes), axes, min(probes, buckets**axes)))
    _, axes, probes = min(best)
    index = Index(log_most, axes, probes, [], [])
    for table in range(TABLES):
        share = np.bincount(index.posted(posted, table), minlength=buckets**axes) / len(sample)
        wanted = np.bincount(index.probed(asked, table).reshape(-1), minlength=buckets**axes) / len(tried)
        index.parts.append(np.maximum(1, np.ceil(share * rows / UNIT)).astype(np.int32))
        index.query_parts.append(np.maximum(1, np.ceil(wanted * queries / UNIT)).astype(np.int32))
    return index


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many rows and queries a batch has, the logarithm of the largest length, and the dimension."""
    for batch in batches:
        if batch.num_rows:
            v = matrix(batch.column(0))
            most = np.abs(v).max(1, keepdims=True)
            length = np.log(most[:, 0]) + np.log(((v / most) ** 2).sum(1)) / 2
            yield pa.RecordBatch.from_pylist([{"n": len(v), "queries": int(np.count_nonzero(batch.column(1))), "log_most": float(length.max()), "d": v.shape[1]}], pa.schema({"n": pa.int64(), "queries": pa.int64(), "log_most": pa.float64(), "d": pa.int32()}))


_UNITS = "tbl int, bucket long, part int, kind int, id long, h1 long, h2 long, v array<double>"


def _spread(ids: np.ndarray, own: np.ndarray, other: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, part): each row in its own part, once for each part of the other kind."""
    mine = (mix(ids.view(U64)) % own.astype(U64)).astype(np.int64)
    row = np.repeat(np.arange(len(ids)), other)
    theirs = np.arange(len(row)) - np.repeat(np.cumsum(other) - other, other)
    return row, mine[row] * other[row] + theirs if kind else theirs * own[row] + mine[row]


def _hash(index: Index):
    """Postings (kind 1) of the rows to post; probes (kind 0) of the queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 1024):
                batch = whole.slice(low, 1024)
                v = matrix(batch.column(5))
                ids = batch.column(0).to_numpy()
                post, query = (np.flatnonzero(batch.column(i).to_numpy(zero_copy_only=False)) for i in (3, 4))
                rows, asked = lifted(v[post], index.log_most, False), lifted(v[query], index.log_most, True)
                for table in range(TABLES):
                    probes = index.probed(asked, table)
                    found = ((post, index.posted(rows, table), 1), (np.repeat(query, probes.shape[1]), probes.reshape(-1), 0))
                    for row, bucket, kind in found:
                        own, other = index.parts[table][bucket], index.query_parts[table][bucket]
                        again, part = _spread(ids[row], own, other, 1) if kind else _spread(ids[row], other, own, 0)
                        for x in range(0, len(again), 8192):
                            at = row[again[x : x + 8192]]
                            n = len(at)
                            keys = [batch.column(i).take(pa.array(at)) for i in range(3)]
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(n, table, np.int32)), pa.array(bucket[again[x : x + 8192]]), pa.array(part[x : x + 8192].astype(np.int32)), pa.array(np.full(n, kind, np.int32)), *keys, lists(v[at])],
                                ["tbl", "bucket", "part", "kind", "id", "h1", "h2", "v"],
                            )

    return run


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first part to the last whatever the batch."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


class _Bucket:
    """The queries that probe a bucket, with the nearest distinct vectors met so far."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        self.ids, self.v = ids, v
        self.row, self.score = np.zeros(0, np.int64), np.zeros(0)
        self.keys = np.zeros((0, 3), np.int64)  # id, h1 and h2 of each

    def meet(self, keys: np.ndarray, v: np.ndarray) -> None:
        k = min(NEAREST + 1, len(keys))
        for low in range(0, len(self.ids), BLOCK):
            rough = self.v[low : low + BLOCK] @ v.T
            least = np.partition(rough, len(keys) - k, axis=1)[:, len(keys) - k]
            slack = 1e-9 * (np.abs(rough).max(initial=0) + 1e-300)
            i, j = np.nonzero(rough >= least[:, None] - slack)
            self.row = np.concatenate([self.row, i + low])
            self.keys = np.concatenate([self.keys, keys[j]])
            self.score = np.concatenate([self.score, products(self.v[i + low], v[j])])
        order = np.lexsort((self.keys[:, 0], -self.score, self.row))
        row = self.row[order]
        order = order[np.arange(len(row)) - np.searchsorted(row, row) < NEAREST + 1]
        self.row, self.keys, self.score = self.row[order], self.keys[order], self.score[order]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.row]), pa.array(self.keys[:, 0]), pa.array(self.keys[:, 1]), pa.array(self.keys[:, 2]), pa.array(self.score)], ["query_id", "near", "h1", "h2", "score"])


def _rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, queries, bucket = None, [], None
    for whole in batches:
        for low in range(0, whole.num_rows, 2048):
            batch = whole.slice(low, 2048)
            table, where, part, kind = (batch.column(i).to_numpy() for i in range(4))
            keys = np.stack([batch.column(i).to_numpy() for i in (4, 5, 6)], 1)
            v = matrix(batch.column(7))
            new = np.flatnonzero(np.logical_or.reduce([np.diff(k) != 0 for k in (table, where, part, kind)])) + 1
            bounds = [0, *new.tolist(), len(table)]
            for x, y in zip(bounds[:-1], bounds[1:], strict=True):
                key = (int(table[x]), int(where[x]), int(part[x]))
                if key != now:
                    if bucket is not None:
                        yield bucket.batch()
                    now, queries, bucket = key, [], None
                if kind[x] == 0:
                    queries.append((keys[x:y, 0], v[x:y]))
                    continue
                if bucket is None and queries:
                    bucket = _Bucket(*(np.concatenate([q[k] for q in queries]) for k in range(2)))
                if bucket is not None:
                    bucket.meet(keys[x:y], v[x:y])
    if bucket is not None:
        yield bucket.batch()


def _ranked(units: DataFrame) -> DataFrame:
    """The nearest distinct vectors that queries meet in their units."""
    together = units.repartition("tbl", "bucket", "part").sortWithinPartitions("tbl", "bucket", "part", "kind")
    met = together.mapInArrow(_rank, "query_id long, near long, h1 long, h2 long, score double")
    best = met.groupBy("query_id", "near", "h1", "h2").agg(F.max("score").alias("score"))
    by_class = Window.partitionBy("query_id").orderBy(F.desc("score"), "near", "h1")
    return best.withColumn("place", F.row_number().over(by_class)).where(F.col("place") <= NEAREST + 1)


def nearest(table: DataFrame, is_query, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: the 20 nearest rows found for each query row.

    Nearness is the largest inner product of the original vectors, in double precision, ties
    to the smaller vec_id. ``is_query`` makes a condition of the id. Rows whose vector is
    null, zero, of an odd length or with null or non-finite parts take no part, nor do rows
    without an id. A query never finds its own vec_id; of rows that repeat a vec_id with one
    vector one is searched. Of copies of one vector the 21 smallest vec_ids are searched,
    more of which no query can return. A query returns 20 rows, or all candidates if there
    are fewer: one that meets too few is compared with all rows, in blocks.
    """
    spark = table.sparkSession
    prepare(spark)
    rows = saved(usable(table, id_column, vector_column).where("ok").drop("ok").dropDuplicates(["id", "h1", "h2"]))
    measured = rows.select("v", is_query(F.col("id")).alias("query")).mapInArrow(_measure, "n long, queries long, log_most double, d int")
    facts = measured.agg(F.sum("n").alias("n"), F.sum("queries").alias("queries"), F.max("log_most").alias("log_most"), F.max("d").alias("d")).first()
    if not facts.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = rows.orderBy(F.xxhash64("h1", "id"), "id", "h2").limit(max(64, SAMPLE // facts.d)).select("v").collect()
    index = fit(np.array([r.v for r in sample], np.float64), facts.log_most, facts.n, facts.queries)
    copies = Window.partitionBy("h1", "h2").orderBy("id")
    few = rows.select("id", "h1", "h2").withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= NEAREST + 1)
    classes = saved(few.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.collect_list("id").alias("ids")))
    flagged = rows.join(classes.select("h1", "h2", "rep"), ["h1", "h2"]).select("id", "h1", "h2", (F.col("id") == F.col("rep")).alias("post"), is_query(F.col("id")).alias("query"), "v").where("post OR query")

    def listed(best: DataFrame) -> DataFrame:
        found = best.join(classes, ["h1", "h2"]).select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
        final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= NEAREST).select("query_id", "rank", "vec_id", "score")

    found = saved(listed(_ranked(flagged.mapInArrow(_hash(index), _UNITS))))
    queries = rows.where(is_query(F.col("id"))).groupBy(F.col("id").alias("query_id")).agg(F.count("*").alias("own"))
    short = queries.join(found.groupBy("query_id").agg(F.count("*").alias("met")), "query_id", "left").where(F.coalesce("met", F.lit(0)) < F.least(F.lit(NEAREST), F.lit(facts.n) - F.col("own")))
    if short.isEmpty():
        return found
    short = saved(short.select("query_id"))
    lacking = short.count()
    blocks, parts = (max(1, -(-int(x) // UNIT)) for x in (lacking, facts.n))
    dealt = lambda which, n: F.pmod(F.xxhash64(F.lit(which), "id", "h1"), F.lit(n)).cast("int")
    to = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = flagged.where("query").join(short.withColumnRenamed("query_id", "id"), "id", "left_semi").withColumn("bucket", dealt(1, blocks)).withColumn("part", to(parts))
    posted = flagged.where("post").withColumn("part", dealt(2, parts)).withColumn("bucket", to(blocks))
    units = [x.select(F.lit(0).alias("tbl"), F.col("bucket").cast("long").alias("bucket"), "part", F.lit(kind).alias("kind"), "id", "h1", "h2", "v") for kind, x in enumerate((asked, posted))]
    exact = listed(_ranked(units[0].unionByName(units[1])))
    return found.join(short, "query_id", "left_anti").unionByName(exact)


def op10_vector_search(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every row of ``embeddings`` whose vec_id is divisible by 20."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 20 == 0)
