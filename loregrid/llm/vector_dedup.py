"""Near-duplicate vectors by an exact metric range join under the angle between vectors.

Pivots, chosen farthest first from a bounded sample, partition the distinct vectors. Their
number, at most ``PIVOTS``, is that of least work as estimated on the sample: more of them
prune more pairs where vectors lie in clusters, and replicate more where they do not. Each vector has its home in the cell of its nearest pivot. For a link at angle t, the
triangle inequality bounds how much farther than from its own pivot a vector can be from
its partner's: 2 t. A vector is therefore replicated to every cell of a smaller number
within that bound, and the pair is found in the smaller of its two home cells, once. Cells
are joined independently, each in units of a block of home vectors against which half of the
cell's other blocks and all replicas are streamed, so that neither a large cell nor a hot vector is
gathered. Up to ``LARGE`` vectors a block grows with the table, which then has ``UNITS`` of them, and
what is shuffled with it. Replicas are cell numbers until they are shuffled. Copies of one vector are
one vector with a multiplicity. Units return counts of links and a spanning forest of them as
they find them, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import components
from .scratch import drop, prepare, saved
from .vectors import matrix, scaled, unit, usable

COSINE = 0.9
PIVOTS, SAMPLE, STRIP = 1024, 1 << 18, 512
#: Vectors of a block: ``BLOCK`` in small tables, ``LARGE`` or ``VALUES`` numbers at most; blocks of a table between.
BLOCK, LARGE, VALUES, UNITS = 4096, 16384, 1 << 22, 64
#: Angles to pivots, and pairs of a block and a strip, that are held at once.
ANGLES, PAIRS = 1 << 20, 1 << 20
#: A shuffled vector costs as much as so many inner products (measured: 16 us and 7 to 11 ns).
SHUFFLED = 2000


def block_size(rows: int, length: int) -> int:
    """Vectors of a block in a table of ``rows`` vectors."""
    return max(1, min(LARGE, VALUES // length, max(BLOCK, rows // UNITS)))


def pivots(sample: np.ndarray) -> np.ndarray:
    """Farthest-first pivots among unit vectors."""
    chosen, far = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(PIVOTS, len(sample)):
        far = np.minimum(far, np.arccos(np.clip(sample @ sample[chosen[-1]], -1, 1)))
        if far.max() <= 1e-9:
            break
        chosen.append(int(far.argmax()))
    return sample[chosen]


def _cells(angle: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(home of each row, rows, cells): the cells of a smaller number to which rows are replicated too."""
    home = angle.argmin(1)
    near = angle - angle[np.arange(len(angle)), home][:, None] <= bound
    return home, *np.nonzero(near & (np.arange(angle.shape[1])[None, :] < home[:, None]))


def chosen_pivots(sample: np.ndarray, cosine: float, rows: int) -> np.ndarray:
    """As many of the farthest-first pivots as make the least work for ``rows`` vectors like the sample's."""
    points = pivots(sample)
    angle = np.arccos(np.clip(sample @ points.T, -1, 1))
    best, count, block = np.inf, 1, block_size(rows, sample.shape[1])
    for n in sorted({min(len(points), 1 << k) for k in range(11)}):
        home, _, cell = _cells(angle[:, :n], 2 * np.arccos(cosine) + 1e-6)
        own, more = (rows / len(sample) * np.bincount(x, minlength=n) for x in (home, cell))
        blocks = np.ceil(own / block)
        work = float((own * (own / 2 + more)).sum() + SHUFFLED * (own * (blocks + 1) / 2 + more * blocks).sum())
        if work < best:
            best, count = work, n
    return points[:count]


def _assign(points: np.ndarray, cosine: float):
    """Adds to each row its home cell, and the cells to which it is replicated too."""
    bound, step = 2 * np.arccos(cosine) + 1e-6, max(1, ANGLES // len(points))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, step):
                rows = batch.slice(low, step)
                angle = np.arccos(np.clip(unit(matrix(rows.column(2))) @ points.T, -1, 1))
                home, row, cell = _cells(angle, bound)
                ends = pa.array(np.searchsorted(row, np.arange(len(home) + 1)), pa.int32())
                again = pa.ListArray.from_arrays(ends, pa.array(cell, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(home, pa.int32()), again, *rows.columns], ["cell", "again", "id", "copies", "v"])

    return run


def _join(cosine: float):
    class Unit:
        """A block of home vectors, and what has been found for it."""

        def __init__(self, ids, copies, v):
            self.ids, self.copies, self.v = ids, copies, scaled(v)
            self.n = np.sqrt((self.v * self.v).sum(1))
            self.fast = unit(v).astype(np.float32)
            self.label, self.count = np.arange(len(ids)), np.zeros(len(ids), np.int64)

        def links(self, v: np.ndarray, after: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """(home, other) of the links with ``v``; with ``after``, those of later home vectors. All links of one of ``v`` come at once."""
            v = scaled(v)
            # a sum of d products in single precision is off by less than d times 1.2e-7
            close = self.fast @ unit(v).astype(np.float32).T >= cosine - max(1e-4, 1.3e-7 * v.shape[1])
            if after is not None:
                close &= np.arange(len(self.ids))[:, None] < np.arange(after, after + len(v))[None, :]
            found = np.count_nonzero(close)
            n = np.sqrt((v * v).sum(1))
            step, some = max(1, PAIRS // len(self.ids)) if found > PAIRS else len(v), max(1, VALUES // v.shape[1])
            for low in range(0, len(v) if found else 0, step):
                i, j = np.nonzero(close[:, low : low + step])
                j += low
                keep = np.zeros(len(i), bool)
                for x in range(0, len(i), some):
                    p, q = i[x : x + some], j[x : x + some]
                    keep[x : x + some] = np.einsum("ij,ij->i", self.v[p], v[q]) / (self.n[p] * n[q]) >= cosine
                if keep.any():
                    yield i[keep], j[keep]

        def add(self, ids, copies, v, after: int | None = None) -> Iterator[tuple]:
            for low in range(0, len(ids), STRIP):
                for i, j in self.links(v[low : low + STRIP], None if after is None else after + low):
                    self.count += np.bincount(i, weights=copies[low + j], minlength=len(self.ids)).astype(np.int64)
                    other = np.bincount(j, weights=self.copies[i], minlength=min(STRIP, len(ids) - low)).astype(np.int64)
                    order = np.argsort(j, kind="stable")
                    cut = np.flatnonzero(np.diff(j[order])) + 1
                    a, b = [], []
                    for at in np.split(order, cut):
                        k = low + int(j[at[0]])
                        mine = self.label[i[at]] if after is None else np.append(self.label[i[at]], self.label[after + k])
                        roots = np.unique(mine)
                        a += [int(self.ids[roots[0]])] * (len(roots) - 1)
                        b += self.ids[roots[1:]].tolist()
                        if len(roots) > 1:
                            self.label[np.isin(self.label, roots[1:])] = roots[0]
                        if after is None:
                            a.append(int(self.ids[roots[0]]))
                            b.append(int(ids[k]))
                    if after is None:
                        yield ids[low : low + STRIP][other > 0], other[other > 0], a, b
                    else:
                        self.count[after + low : after + low + len(other)] += other
                        yield ids[:0], other[:0], a, b

        def done(self) -> tuple:
            some = self.count > 0
            return self.ids[some], self.count[some], [], []

    def out(ids, counts, a, b) -> pa.RecordBatch:
        n, m = len(ids), len(a)
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays([pa.array(x, pa.int64()), y]) for x, y in ((ids, pa.array(a, pa.int64())), ([None] * n, pa.array(b, pa.int64())), (counts, pa.array([0] * m, pa.int64())))],
            ["a", "b", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (out(*x) for x in units(batches) if len(x[0]) or x[2])

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, home, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, part, kind, ids, copies = (batch.column(i).to_numpy() for i in range(5))
            v = matrix(batch.column(5))
            new = np.flatnonzero((np.diff(cell) != 0) | (np.diff(part) != 0) | (np.diff(kind) != 0)) + 1
            bounds = [0, *new.tolist(), len(cell)]
            for x, y in zip(bounds[:-1], bounds[1:], strict=True):
                key = (int(cell[x]), int(part[x]))
                if key != now:
                    yield from finish(home, block)
                    now, home, block = key, [], None
                if kind[x] == 0:
                    home.append((ids[x:y], copies[x:y], v[x:y]))
                    continue
                if block is None:
                    block = yield from start(home)
                if block is not None:
                    yield from block.add(ids[x:y], copies[x:y], v[x:y])
        yield from finish(home, block)

    def start(home: list):
        if not home:
            return None
        block = Unit(*(np.concatenate([h[k] for h in home]) for k in range(3)))
        home.clear()
        yield from block.add(block.ids, block.copies, block.v, after=0)
        return block

    def finish(home: list, block) -> Iterator[tuple]:
        if block is None:
            block = yield from start(home)
        if block is not None:
            yield block.done()

    return run


def _sent(cells: DataFrame, blocks: list[int]) -> DataFrame:
    """(cell, part, kind, id, copies, v): every vector in each unit, (cell, part), that it takes part in.

    ``blocks`` is the number of blocks of each cell. A vector is a home vector, of kind 0, of its own block. It is streamed
    by the blocks up to half a round before that, so each two blocks meet once, and by all blocks of the cells in ``again``.
    """
    known = F.array(*[F.lit(n) for n in blocks])

    def number(cell: Column) -> Column:
        return F.element_at(known, cell + 1)

    def to(cell: Column, part: Column, kind: Column) -> Column:
        return F.struct(cell.alias("cell"), part.cast("int").alias("part"), kind.cast("int").alias("kind"))

    n, own = F.col("blocks"), F.col("own")
    dealt = cells.withColumn("blocks", number(F.col("cell"))).withColumn("own", F.pmod(F.xxhash64("id", F.lit(41)), "blocks").cast("int"))
    last = F.floor((n - 1) / 2).cast("int") + F.when((n % 2 == 0) & (own >= n / 2), 1).otherwise(0)
    here = F.transform(F.sequence(F.lit(0), last), lambda x: to(F.col("cell"), F.pmod(own - x, n), x > 0))
    more = F.transform("again", lambda c: F.transform(F.sequence(F.lit(0), number(c) - 1), lambda p: to(c, p, F.lit(1))))
    return dealt.select(F.explode(F.concat(here, F.flatten(more))).alias("to"), "id", "copies", "v").select("to.*", "id", "copies", "v")


def near_vectors(table: DataFrame, cosine: float = COSINE, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``table``.

    Two vectors are linked if their cosine, in double precision, is at least ``cosine``
    (above 0). Vectors that are null, zero, of an odd length, or hold null or non-finite
    parts link with nothing; so do rows without an id, whose component is null and which are
    kept. Rows that repeat a vec_id count as other vectors and are one node of the graph.
    """
    spark = table.sparkSession
    prepare(spark)
    rows = saved(usable(table, id_column, vector_column))
    classes = rows.where("ok").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    known = rows.select("id", "ok", "h1", "h2").join(classes.withColumn("ok", F.lit(True)), ["ok", "h1", "h2"], "left").select("id", "rep", "copies")
    known = saved(known)
    kind = table.select(f"`{vector_column}`").schema[0].dataType.elementType
    numbers = "array<float>" if isinstance(kind, T.FloatType) else "array<double>"
    first = rows.where("ok").join(classes, ["h1", "h2"]).where("id = rep").dropDuplicates(["h1", "h2"]).select("id", "copies", F.col("v").cast(numbers).alias("v"))
    distinct = saved(first)
    facts = distinct.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    links = counts = None
    if facts.n:
        sample = distinct.orderBy(F.xxhash64("id"), "id").limit(max(64, SAMPLE // facts.d)).select("v").collect()
        points = chosen_pivots(unit(np.array([r.v for r in sample], np.float64)), cosine, facts.n)
        cells = saved(distinct.mapInArrow(_assign(points, cosine), f"cell int, again array<int>, id long, copies long, v {numbers}"))
        sizes = {r.cell: r["count"] for r in cells.groupBy("cell").count().collect()}  # at most PIVOTS rows
        block = block_size(facts.n, facts.d)
        sent = _sent(cells, [-(-sizes.get(c, 1) // block) for c in range(len(points))])
        together = sent.repartition("cell", "part").sortWithinPartitions("cell", "part", "kind")
        found = saved(together.mapInArrow(_join(cosine), "a long, b long, n long"))
        drop(cells)
        links = found.where("b IS NOT NULL").select("a", "b")
        counts = found.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    else:
        links = spark.createDataFrame([], "a long, b long")
        counts = spark.createDataFrame([], "rep long, links long")
    drop(rows, distinct)
    repeated = known.where("rep IS NOT NULL").groupBy("id").agg(F.min("rep").alias("r0"), F.max("rep").alias("r1")).where("r0 < r1")
    bridges = known.where("id <> rep").join(repeated.select("id"), "id", "left_semi").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    component = components(links.unionByName(bridges)).withColumnRenamed("node", "rep")
    out = known.join(counts, "rep", "left").join(component, "rep", "left")
    root = F.coalesce("component", "rep", "id")
    n = F.coalesce(F.col("links"), F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))
    return out.select(F.col("id").alias("vec_id"), n.alias("n_links"), root.alias("component_id"), F.coalesce(F.col("id") == root, F.lit(True)).alias("kept"))


def op9_vector_dedup(spark, sf_dir: str) -> DataFrame:
    """Links and components of the whole ``embeddings`` table at a cosine of 0.9."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
