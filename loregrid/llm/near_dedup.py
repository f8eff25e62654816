"""Near-duplicate documents by an inverted join over MinHash signature coordinates.

1. Every text becomes its set of distinct word shingles; texts with equal sets form one
   class, which its smallest doc_id stands for.
2. A class has ``COORDINATES`` min-hashes. Each (coordinate, value) is a token; pairs of
   Jaccard similarity 0.75 agree on fewer than ``MATCHES`` of 32 with probability 4e-5.
3. Prefix: two classes that share MATCHES tokens share one of each one's rarest
   s - MATCHES + 1 shared tokens (s: how many of its tokens occur elsewhere at all), so only
   those are posted, and classes with s < MATCHES take no further part.
4. Skip merging: instead of counting through all posting lists, a candidate taken from a
   prefix list has its other coordinates probed directly in both signatures.
5. First each posting list proposes its smallest and largest member to all others, and these
   stars are confirmed on the full shingle sets. Only lists which then still hold several
   components are compared member by member, between components only, in blocks of
   ``BLOCK`` that are separate tasks, so a list of any length is compared whole.
6. What is left to confirm is not written out as pairs: each task returns a spanning forest
   of its candidates, their components are clusters, and the full sets of a cluster, again
   in blocks, are compared in numpy. Tasks return a spanning forest of the links found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, salted
from .scratch import drop, prepare, saved
from .text import U64, mix, pieces, shingle_sets

COORDINATES, MATCHES, BLOCK, TEXTS = 32, 14, 2048, 256
#: Columns of the incidence matrix multiplied at once.
COLUMNS = 8192
SHINGLE = 5
_RNG = np.random.default_rng(7919)
_A = _RNG.integers(1, 1 << 63, COORDINATES, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_B = _RNG.integers(1, 1 << 63, COORDINATES, dtype=np.int64).astype(U64)


def tokens(at: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """A row of COORDINATES tokens for each non-empty set."""
    starts = at[:-1][np.diff(at) > 0]
    out = np.empty((len(starts), COORDINATES), U64)
    for i in range(COORDINATES if len(starts) else 0):
        out[:, i] = mix(np.minimum.reduceat(flat * _A[i] + _B[i], starts) ^ mix(np.array([i + 1], U64)))
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        at, flat = shingle_sets(batch.column(1), SHINGLE)
        sizes = np.diff(at)
        some = sizes > 0
        digests = []
        for salt in (0x51ED270B, 0x2545F491):
            digest = np.zeros(len(sizes), U64)
            if len(flat):
                digest[some] = np.add.reduceat(mix(flat * U64(2 * salt + 1)), at[:-1][some])
            digests.append(pa.array(digest.view(np.int64)))
        ends = np.concatenate([[0], np.cumsum(some)]) * COORDINATES
        signature = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tokens(at, flat).reshape(-1).view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes), *digests, signature], ["doc_id", "tag", "n_shingles", "d1", "d2", "tokens"])


def _forest(ids: np.ndarray, near) -> tuple[list[int], list[int]]:
    """Edges that connect what ``near(i)``, a mask for each i, connects: fewer than the ids."""
    label, a, b = np.arange(len(ids)), [], []
    for i in range(len(ids)):
        mask = near(i)
        if not mask.any():
            continue
        roots = np.unique(np.append(label[mask], label[i]))
        if len(roots) > 1:
            a += [int(ids[roots[0]])] * (len(roots) - 1)
            b += ids[roots[1:]].tolist()
            label[np.isin(label, roots[1:])] = roots[0]
    return a, b


def _grouped(batches: Iterator[pa.RecordBatch], load) -> Iterator[dict[str, np.ndarray]]:
    """The rows of each unit, whose key, bi and bj are the first columns, as ``load`` reads them."""
    held: list[dict] = []
    for batch in batches:
        keys = [batch.column(i).to_numpy() for i in range(3)]
        new = np.flatnonzero(np.logical_or.reduce([np.diff(k) != 0 for k in keys])) + 1
        bounds = [0, *new.tolist(), batch.num_rows]
        for x, y in zip(bounds[:-1], bounds[1:], strict=True):
            if y > x:
                now = tuple(int(k[x]) for k in keys)
                if held and held[0]["unit"] != now:
                    yield held
                    held = []
                held.append({"unit": now} | load(batch.slice(x, y - x)))
    if held:
        yield held


def _edges(found: tuple[list[int], list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["a", "b"])


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the candidates between components in each unit of a posting list."""

    def load(batch: pa.RecordBatch) -> dict:
        return {k: batch.column(i).to_numpy() for k, i in (("id", 3), ("c", 4), ("n", 5))} | {"t": batch.column(6).flatten().to_numpy().reshape(-1, COORDINATES)}

    for parts in _grouped(batches, load):
        ids, c, n, t = (np.concatenate([p[k] for p in parts]) for k in ("id", "c", "n", "t"))

        def near(i: int) -> np.ndarray:
            ok = (c[i] != c) & (4 * np.minimum(n[i], n) >= 3 * np.maximum(n[i], n))
            at = np.flatnonzero(ok)
            ok[at] = (t[at] == t[i]).sum(1) >= MATCHES
            return ok

        if c.min() < c.max():
            yield _edges(_forest(ids, near))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the links in each unit of a cluster, on the full shingle sets."""

    def load(batch: pa.RecordBatch) -> dict:
        sets = [shingle_sets(p.column(5), SHINGLE) for p in pieces(iter([batch]))]
        return {"id": batch.column(3).to_numpy(), "c": batch.column(4).to_numpy(), "n": np.concatenate([np.diff(at) for at, _ in sets]), "flat": np.concatenate([f for _, f in sets])}

    for parts in _grouped(batches, load):
        ids, c, n, flat = (np.concatenate([p[k] for p in parts]) for k in ("id", "c", "n", "flat"))
        if c.min() == c.max():
            continue
        owner = np.repeat(np.arange(len(ids)), n)
        _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
        often = np.cumsum(count > 1) - 1
        use = count[column] > 1
        owner, column = owner[use], often[column[use]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        both = np.zeros((len(ids), len(ids)), np.float32)  # whole numbers below 2 ** 24 are exact
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            x, y = np.searchsorted(column, [low, low + COLUMNS])
            dense = np.zeros((len(ids), COLUMNS), np.float32)
            dense[owner[x:y], column[x:y] - low] = 1
            both += dense @ dense.T
        union = n[:, None] + n[None, :] - both
        link = (both > 0) & (100 * both.astype(np.float64) >= 75 * union.astype(np.float64)) & (c[:, None] != c[None, :])
        yield _edges(_forest(ids, lambda i: link[i]))


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in pieces(pieces(iter([whole]), "text_a"), "text_b"):
            (a_at, a), (b_at, b) = (shingle_sets(batch.column(i), SHINGLE) for i in (2, 3))
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = a[a_at[i] : a_at[i + 1]], b[b_at[i] : b_at[i + 1]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = both > 0 and 100 * both >= 75 * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], ["a", "b"])


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents are linked at a Jaccard similarity of 0.75 or more over their distinct
    five-word shingles; component_id is the smallest doc_id reachable. Null, empty and
    wordless texts have no shingles and are linked with nothing. Rows that repeat a doc_id
    are one node with the links of all its texts. Rows without a doc_id have no component
    and are kept. Other columns of ``docs`` are not read, whatever their names. Keys that
    many rows share (a class of copies, a token, a hub) are dealt to several tasks.
    """
    spark = docs.sparkSession
    prepare(spark)
    text = F.col(f"`{text_column}`").cast("string")
    texts = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tag"))
    signed = saved(texts.mapInArrow(_sign, "doc_id long, tag long, n_shingles long, d1 long, d2 long, tokens array<long>"))
    same_set = ["n_shingles", "d1", "d2"]
    known = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # the number of a class stays, as it is written down
    classes = saved(known.groupBy(*same_set).agg(F.min(F.struct("doc_id", "tag")).alias("rep"), F.first("tokens").alias("tokens")).withColumn("id", F.monotonically_increasing_id()))
    reps = classes.select("id", F.col("n_shingles").alias("n"), "tokens")
    members = saved(salted(signed.select("doc_id", "tag", *same_set), classes.select(*same_set, "id"), same_set, "doc_id", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("id")).alias("id")))
    drop(signed)

    posted = saved(reps.select("id", F.explode("tokens").alias("key")))
    shared = posted.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    ordered = salted(posted, shared, ["key"], "id").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("keys"))
    postings = saved(ordered.where(F.size("keys") >= MATCHES).select("id", F.explode(F.expr(f"slice(keys, 1, size(keys) - {MATCHES - 1})")).alias("k")).select("id", F.col("k.key").alias("key")))
    drop(posted)
    candidates = postings.select("id").distinct()
    wanted = classes.join(candidates, "id", "left_semi").select("id", "rep.doc_id", "rep.tag")
    pool = saved(texts.join(wanted, ["doc_id", "tag"]).groupBy("doc_id", "tag").agg(F.first("id").alias("id"), F.first("text").alias("text")).select("id", "text"))
    signatures = saved(reps.join(candidates, "id", "left_semi"))

    def beside(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
        """``pairs`` with the columns of both ends, whose hubs may be hot."""
        for x, y in ("ab", "ba"):
            pairs = salted(pairs, table.select(F.col("id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns]), [x], y)
        return pairs

    ends = postings.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    stars = saved(salted(postings, ends, ["key"], "id").select("id", F.explode(F.array("low", "high")).alias("hub")).where("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct())
    probed = beside(stars, signatures, "n", "tokens").where(F.size(F.array_intersect("tokens_a", "tokens_b")) >= MATCHES).where("4 * least(n_a, n_b) >= 3 * greatest(n_a, n_b)")
    pairs = saved(probed.select("a", "b"))
    links = saved(beside(pairs, pool, "text").select("a", "b", "text_a", "text_b").mapInArrow(_confirm, "a long, b long").distinct())
    drop(stars, pairs)

    found = saved(components(links))
    labelled = saved(postings.join(found.withColumnRenamed("node", "id"), "id", "left").select("id", "key", F.coalesce("component", "id").alias("c")))
    mixed = labelled.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("c0 < c1")

    def units(rows: DataFrame, *columns: str) -> DataFrame:
        blocked = rows.withColumn("block", F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        return blocked.select("key", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "id", "c", *columns)

    def together(rows: DataFrame) -> DataFrame:
        return rows.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")

    lists = units(salted(labelled, mixed, ["key"], "id")).join(signatures, "id").select("key", "bi", "bj", "id", "c", "n", "tokens")
    clusters = components(together(lists).mapInArrow(_units, "a long, b long").distinct())
    labels = saved(clusters.join(found.select("node", F.col("component").alias("c")), "node", "left").select(F.col("node").alias("id"), F.col("component").alias("key"), F.coalesce("c", "node").alias("c")))
    sizes = labels.groupBy("key").agg(F.ceil(F.count("*") / TEXTS).cast("int").alias("blocks"))
    texted = units(salted(labels, sizes, ["key"], "id")).join(pool, "id").select("key", "bi", "bj", "id", "c", "text")
    more = together(texted).mapInArrow(_compare, "a long, b long")

    # a doc_id with several texts joins their classes
    placed = members.where("id IS NOT NULL").select("doc_id", "id")
    repeated = placed.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").select("doc_id", "a")
    bridges = salted(placed, repeated, ["doc_id"], "id").select("a", F.col("id").alias("b"))
    nodes = components(links.unionByName(more).unionByName(bridges))
    drop(postings, pool, signatures, links, found, labelled, labels)
    of_class = classes.select("id", F.col("rep.doc_id").alias("rep")).join(nodes.withColumnRenamed("node", "id"), "id", "left").select("id", "rep", F.coalesce("component", "id").alias("component"))
    of_class = saved(of_class)
    least = of_class.groupBy("component").agg(F.min("rep").alias("root"))
    rooted = salted(of_class, least, ["component"], "id").select("id", "root")
    out = salted(members, rooted, ["id"], "doc_id", "left")
    component = F.coalesce("root", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op1_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of the whole ``documents`` table."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
