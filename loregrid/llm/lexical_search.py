"""Ranked lexical search: a blocked sparse product of items by terms and terms by documents.

The items are a stated query set, taken in blocks of about ``ENTRIES`` (item, term) pairs,
or one item. A block's terms are its vocabulary, which tasks get as a broadcast of at most
that many hashes. Three steps for each block:

1. Every document is cut into terms, and the terms of the vocabulary are counted: a row
   (doc_id, length, terms, counts) a document, in the shared folder.
2. From these come N, L and each term's documents, and with them the terms' weights.
3. Tasks gather rows to blocks of ``POSTINGS`` counts, turn them into a term-document matrix
   of int64 impacts, and merge, for each item, the rows of its terms into its scores
   (Gustavson). The best ``k`` of a block are merged into the task's best, so a task returns
   at most k rows an item, whatever it has read; Spark ranks those.

Terms meet by 64-bit hashes of their bytes. Documents without a doc_id count in the
statistics and are ranked by nobody; so are items without an item_id. Rows that repeat an
item_id are one item of all their terms, rows that repeat a doc_id are ranked each. Null and
empty texts have no terms. Items without terms, or whose terms no document has, return no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import drop, prepare, saved
from .text import Terms, pieces, ragged

K, ENTRIES, POSTINGS = 50, 1 << 20, 1 << 21
_ITEM = pa.schema([("item_id", pa.int64()), ("term", pa.int64()), ("times", pa.int64())])
_COUNTED = pa.schema([("doc_id", pa.int64()), ("length", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])
_BEST = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


@dataclass
class Block:
    """Items by terms: the sorted hashes of the vocabulary, and each item's terms in it with their multiplicity."""

    vocabulary: np.ndarray
    items: np.ndarray
    first: np.ndarray
    terms: np.ndarray
    times: np.ndarray


@dataclass
class Weights:
    """Of each term of a vocabulary its weight; N and L are those of all documents."""

    w: np.ndarray
    n: int
    total: int


def _distinct(texts: Terms) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) for each distinct term of each text, by row and term."""
    hashes, rows = texts.hashes().view(np.int64), np.repeat(np.arange(len(texts.counts)), texts.counts)
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    at = np.flatnonzero(new)
    return rows[at], hashes[at], np.diff(np.append(at, len(rows)))


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        rows, terms, counts = _distinct(Terms(batch.column(1)))
        ids = batch.column(0).take(pa.array(rows))
        yield pa.record_batch([ids, pa.array(terms), pa.array(counts.astype(np.int64))], schema=_ITEM)


def blocks_of(items: DataFrame) -> Iterator[Block]:
    """The items in blocks, each small enough for the driver and a broadcast."""
    rows = items.where("item_id IS NOT NULL").select(F.col("item_id").cast("long"), "text")
    pairs = saved(rows.mapInArrow(_item_terms, "item_id long, term long, times long").groupBy("item_id", "term").agg(F.sum("times").alias("times")))
    n = -(-pairs.count() // ENTRIES)
    for i in range(n):
        own = pairs if n == 1 else pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i)
        found = own.toArrow()
        item, term, times = (found.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("item_id", "term", "times"))
        if not len(item):
            continue
        order = np.lexsort((term, item))
        vocabulary, at = np.unique(term[order], return_inverse=True)
        ids, first = np.unique(item[order], return_index=True)
        yield Block(vocabulary, ids, np.append(first, len(item)), at.astype(np.int32), times[order])
    drop(pairs)


def counted(docs: DataFrame, block) -> DataFrame:
    """(doc_id, length, terms, counts) of every document with a term; terms are places in the block's vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = block.value.vocabulary
        for batch in pieces(batches):
            texts = Terms(batch.column(1))
            lengths = texts.counts
            hashes = texts.hashes().view(np.int64)
            place = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
            hit = vocabulary[place] == hashes
            keys, counts = np.unique(np.repeat(np.arange(len(lengths)), lengths)[hit] * len(vocabulary) + place[hit], return_counts=True)
            rows, terms = np.divmod(keys, len(vocabulary))
            some = np.flatnonzero(lengths)
            ends = pa.array(np.append(np.searchsorted(rows, some), len(rows)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (terms, counts)]
            yield pa.record_batch([batch.column(0).take(pa.array(some)), pa.array(lengths[some].astype(np.int64)), *lists], schema=_COUNTED)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, length long, terms array<int>, counts array<int>")


def weights(rows: DataFrame, size: int) -> Weights:
    """N, L and the weights of a vocabulary of ``size`` terms from the counted rows."""
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    found = rows.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()  # at most ``size`` rows
    df = np.zeros(size, np.int64)
    df[found.column("term").to_numpy()] = found.column("count").to_numpy()
    return Weights(np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64), n, total)


def impacts(terms: np.ndarray, counts: np.ndarray, lengths: np.ndarray, known: Weights) -> np.ndarray:
    """The weight of each term times its saturated count in a document of that many terms."""
    m = 50 + (50 * lengths * known.n) // known.total
    return known.w[terms] * ((1_000_000_000 * counts) // (1000 * counts + 20 * m))


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Where the k highest scores are, equal ones by ascending id, highest first."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        where = np.flatnonzero(scores >= least)
    else:
        where = np.arange(len(scores))
    return where[np.lexsort((ids[where], -scores[where]))][:k]


def product(block: Block, known: Weights, docs: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], k: int, once: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(item, doc_ids, scores): each item's best of a block of documents.

    ``docs`` is (ids, lengths, sizes of rows, terms, counts). The matrix is kept by terms; an
    item's scores are the sum of its terms' rows, merged in one array of the block's documents.
    """
    ids, lengths, sizes, terms, counts = docs
    rows = np.repeat(np.arange(len(ids)), sizes)
    values = impacts(terms, counts.astype(np.int64), lengths[rows], known)
    order = np.argsort(terms, kind="stable")
    rows, values = rows[order], values[order]
    starts = np.searchsorted(terms[order], np.arange(len(block.vocabulary) + 1))
    sums = np.zeros(len(ids), np.int64)
    for i in range(len(block.items)):
        own = slice(block.first[i], block.first[i + 1])
        at = block.terms[own]
        n = starts[at + 1] - starts[at]
        merged = ragged(starts[at], n)
        if not len(merged):
            continue
        value = values[merged] if once else values[merged] * np.repeat(block.times[own], n)
        np.add.at(sums, rows[merged], value)
        met = np.flatnonzero(sums)
        top = best_of(ids[met], sums[met], k)
        yield i, ids[met[top]], sums[met[top]]
        sums[rows[merged]] = 0


def ranked(docs: DataFrame, items: DataFrame, k: int = K, once: bool = True) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0.

    ``once``: an item's terms count once each, else as often as the item has them.
    """
    spark = docs.sparkSession
    prepare(spark)
    found = [_ranked(spark, docs, block, k, once) for block in blocks_of(items)]
    rows = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for part in found:
        rows = rows.unionByName(part)
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return rows.withColumn("rank", place).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _ranked(spark: SparkSession, docs: DataFrame, block: Block, k: int, once: bool) -> DataFrame:
    """The best of every task for the items of a block."""
    shared = spark.sparkContext.broadcast(block)
    rows = saved(counted(docs, shared))
    known = spark.sparkContext.broadcast(weights(rows, len(block.vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        best: list = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(items.items)
        held: list[pa.RecordBatch] = []
        size = 0

        def merge() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            ids, lengths = (table.column(c).to_numpy() for c in ("doc_id", "length"))
            terms, counts = (table.column(c).combine_chunks() for c in ("terms", "counts"))
            sizes = np.diff(terms.offsets.to_numpy())
            for i, doc, score in product(items, known.value, (ids, lengths, sizes, terms.flatten().to_numpy(), counts.flatten().to_numpy()), k, once):
                doc, score = np.concatenate([best[i][0], doc]), np.concatenate([best[i][1], score])
                top = best_of(doc, score, k)
                best[i] = doc[top], score[top]
            held.clear()

        for batch in batches:
            held.append(batch)
            size += batch.num_rows + len(batch.column(2).flatten())
            if size >= POSTINGS:
                merge()
                size = 0
        if held:
            merge()
        for i in range(0, len(best), 1000):
            part = best[i : i + 1000]
            ids = np.repeat(items.items[i : i + 1000], [len(d) for d, _ in part])
            yield pa.record_batch([pa.array(ids), pa.array(np.concatenate([d for d, _ in part])), pa.array(np.concatenate([s for _, s in part]))], schema=_BEST)

    return rows.where("doc_id IS NOT NULL AND size(terms) > 0").mapInArrow(run, "item_id long, doc_id long, score long")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best of all documents for every benchmark item."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return ranked(docs, items)
