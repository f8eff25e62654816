"""Removal of repeated passages by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words of one document. Its minimiser is the smallest hash
of the runs of ``MER`` words in it. Consecutive windows with one minimiser form a
super-k-mer, which travels as one packed string to the minimiser's bucket; equal windows
have equal minimisers, so they meet there, and a sort finds each one's earliest occurrence.

A map task first does the same within each piece of its input, so that of any number of
copies one super-k-mer a piece is sent. Super-k-mers of one piece and bucket are compressed
together. A bucket is a stream: of every window its task keeps two 64-bit hashes and the
earliest start so far, and lets go at once of what begins later. Beyond ``KEPT`` windows it
hands these to a last grouping by Spark, which spills, so no bucket is held in memory
whatever its size. Windows with both hashes equal count as one (chance 1e-38 a pair).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import prepare, saved
from .text import U64, Words, mix, pieces, ragged, windows

WINDOW, MER = 20, 3
#: Text handled at once by the map side; the least number of buckets for each shuffle partition.
MAP_BYTES, BUCKETS = 4 << 20, 4
#: Bytes of input files for each bucket and each partition, and the most partitions.
BUCKET_BYTES, PARTITION_BYTES, MOST = 2 << 20, 64 << 20, 20_000
#: Windows sorted at once, and windows that a bucket's task keeps.
SORTED, KEPT = 500_000, 2_000_000
_LAST = np.iinfo(np.int64).max
_CODEC = "zstd"
_FOUND = "order_id long, tag long, start int, size int, k1 long, k2 long"


def _minimisers(words: np.ndarray) -> np.ndarray:
    """For each word the smallest hash of the runs within the window that begins there."""
    low = windows(words, MER)
    span, width = WINDOW - MER + 1, 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = span - width
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def _keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the window that begins at each word."""
    return windows(words, WINDOW), windows(mix(words ^ U64(0xA5A5F00D5EED1234)), WINDOW)


def _repeated(k1: np.ndarray, k2: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which windows also begin earlier, which are the one to keep of their kind)."""
    late, kept = np.zeros(len(k1), bool), np.ones(len(k1), bool)
    order = np.argsort(k1, kind="stable")
    like = np.zeros(len(k1) + 1, bool)
    like[1:-1] = k1[order][1:] == k1[order][:-1]
    some = order[like[1:] | like[:-1]]  # only those whose first hash recurs
    some = some[np.lexsort((start[some], doc[some], k2[some], k1[some]))]
    if len(some):
        new = np.ones(len(some), bool)
        new[1:] = (k1[some][1:] != k1[some][:-1]) | (k2[some][1:] != k2[some][:-1])
        first = some[np.flatnonzero(new)[np.cumsum(new) - 1]]
        late[some] = (doc[some] != doc[first]) | (start[some] != start[first])
        kept[some] = new
    return late, kept


def _runs(flags: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first index, length) of the runs of True within which no key but the last, a position, changes."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at
    new = np.ones(len(at), bool)
    new[1:] = np.diff(at) != 1
    for key in keys[:-1]:
        new[1:] |= key[at[1:]] != key[at[:-1]]
    new[1:] |= np.diff(keys[-1][at]) != 1
    first = np.flatnonzero(new)
    return at[first], np.diff(np.append(first, len(at)))


def _split(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec(_CODEC, 3)
        for batch in pieces(batches, limit=MAP_BYTES):
            batch = batch.take(pa.array(np.argsort(batch.column(0).to_numpy(), kind="stable")))
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            words = Words(batch.column(2))
            hashes = np.concatenate([Words(p.column(2)).hashes() for p in pieces(iter([batch]))])
            counts = np.maximum(words.counts - WINDOW + 1, 0)
            if not counts.any():
                continue
            at = ragged(words.first[:-1], counts)
            row = np.repeat(np.arange(batch.num_rows), counts)
            start = at - words.first[:-1][row]
            doc = ids[row]
            low = _minimisers(hashes)[at]
            k1, k2 = _keys(hashes)
            gone, _ = _repeated(k1[at], k2[at], doc, start)
            out: list[tuple] = []
            first, size = _runs(gone, row, start)
            if len(first):
                packed = np.stack([ids[row[first]], tags[row[first]], start[first], size]).tobytes()
                out.append((int(mix(ids[:1].view(U64))[0] % U64(buckets)), False, packed))
            first, size = _runs(~gone, row, low, start)
            bucket = (mix(low[first]) % U64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            first, size, bucket = first[order], size[order], bucket[order]
            head_ids, head_tags, head = ids[row[first]], tags[row[first]], np.stack([start[first], size + WINDOW - 1]).astype(np.int32)
            begin, end = words.starts[at[first]].tolist(), words.ends[at[first] + size + WINDOW - 2].tolist()
            data = words.data.tobytes()
            bounds = np.flatnonzero(np.append(True, np.diff(bucket) != 0)).tolist() if len(first) else []
            for x, y in zip(bounds, [*bounds[1:], len(first)], strict=True):
                text = b" ".join([data[a:b] for a, b in zip(begin[x:y], end[x:y], strict=True)])
                raw = np.int64(y - x).tobytes() + np.diff(head_ids[x:y], prepend=0).tobytes() + head_tags[x:y].tobytes() + head[:, x:y].tobytes() + text
                out.append((int(bucket[x]), True, np.int64(len(raw)).tobytes() + codec.compress(raw, asbytes=True)))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out]), pa.array([o[2] for o in out], pa.binary())], ["bucket", "packed", "payload"])

    return run


def _unpack(blob: bytes, codec: pa.Codec) -> tuple[np.ndarray, ...]:
    """(k1, k2, doc, tag, start) of every window of a payload."""
    size = int(np.frombuffer(blob[:8], np.int64)[0])
    raw = codec.decompress(blob[8:], size, asbytes=True)
    n = int(np.frombuffer(raw[:8], np.int64)[0])
    ids, tags = np.cumsum(np.frombuffer(raw, np.int64, n, 8)), np.frombuffer(raw, np.int64, n, 8 + 8 * n)
    begin, length = np.frombuffer(raw, np.int32, 2 * n, 8 + 16 * n).reshape(2, n).astype(np.int64)
    words = Words(pa.array([raw[8 + 24 * n :]], pa.large_binary())).hashes()
    count, own = length - WINDOW + 1, np.cumsum(length) - length
    at, run = ragged(own, count), np.repeat(np.arange(n), count)
    k1, k2 = _keys(words)
    return k1[at], k2[at], ids[run], tags[run], begin[run] + at - own[run]


def _bucket(payloads: Iterator[bytes], codec: pa.Codec) -> Iterator[pa.RecordBatch]:
    """Runs of windows that begin earlier elsewhere and, of a bucket that is not kept whole, its earliest windows."""
    held, pending, count, handed = [np.zeros(0, U64)] * 2 + [np.zeros(0, np.int64)] * 3, [], 0, False

    def late(parts: list[np.ndarray], gone: np.ndarray) -> pa.RecordBatch:
        doc, tag, start = (p[gone] for p in parts[2:])
        order = np.lexsort((start, tag, doc))
        doc, tag, start = doc[order], tag[order], start[order]
        first, size = _runs(np.ones(len(doc), bool), doc, tag, start)
        return _rows(doc[first], tag[first], start[first], size)

    for payload in payloads:
        pending.append(_unpack(payload, codec))
        count += len(pending[-1][0])
        if count >= SORTED:
            parts = [np.concatenate([h, *(p[i] for p in pending)]) for i, h in enumerate(held)]
            gone, kept = _repeated(parts[0], parts[1], parts[2], parts[4])
            yield late(parts, gone)
            held, pending, count = [p[kept] for p in parts], [], 0
            if len(held[0]) > KEPT:
                yield _rows(*held[2:], np.zeros(len(held[0]), np.int64), *held[:2])
                held, handed = [h[:0] for h in held], True
    parts = [np.concatenate([h, *(p[i] for p in pending)]) for i, h in enumerate(held)]
    gone, kept = _repeated(parts[0], parts[1], parts[2], parts[4])
    yield late(parts, gone)
    if handed:
        yield _rows(*(p[kept] for p in parts[2:]), np.zeros(int(kept.sum()), np.int64), parts[0][kept], parts[1][kept])


def _rows(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, size: np.ndarray, *keys: np.ndarray) -> pa.RecordBatch:
    """Runs (size above 0), or with ``keys`` windows still to be compared (size 0)."""
    own = [pa.array(k.view(np.int64)) for k in keys] or [pa.nulls(len(doc), pa.int64())] * 2
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(tag), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), *own], ["order_id", "tag", "start", "size", "k1", "k2"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec, early = pa.Codec(_CODEC), []

    def rows() -> Iterator[tuple[int, bytes]]:
        for batch in batches:
            for bucket, packed, payload in zip(*(batch.column(i) for i in range(3)), strict=True):
                if packed.as_py():
                    yield bucket.as_py(), payload.as_py()
                else:
                    early.append(np.frombuffer(payload.as_py(), np.int64).reshape(4, -1))

    for _, payloads in groupby(rows(), key=lambda r: r[0]):
        for found in _bucket((p for _, p in payloads), codec):
            yield found
            while early:
                yield _rows(*early.pop())
    while early:
        yield _rows(*early.pop())


def _cut(keep_whole: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        words, n = Words(batch.column(0)), batch.num_rows
        runs = batch.column(1)
        sizes = np.asarray(runs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
        row = np.repeat(np.arange(n), sizes)
        flat = runs.flatten()
        begin = flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64) + words.first[:-1][row]
        end = begin + flat.field(1).to_numpy(zero_copy_only=False) + WINDOW - 1
        depth = np.zeros(len(words) + 1, np.int64)
        np.add.at(depth, begin, 1)
        np.add.at(depth, end, -1)
        keep = np.cumsum(depth)[:-1] == 0
        owner = np.repeat(np.arange(n), words.counts)
        kept = np.bincount(owner[keep], minlength=n)
        # each text gets one more byte, for the space after its last word
        spread = np.full(len(words.data) + n, 0x20, np.uint8)
        spread[np.arange(len(words.data)) + np.repeat(np.arange(n), np.diff(words.offsets))] = words.data
        start, stop = (words.starts + owner)[keep], (words.ends + owner)[keep]
        spread[stop] = 0x20
        edge = np.zeros(len(spread) + 1, np.int8)
        edge[start] += 1
        edge[stop + 1] -= 1
        take = np.cumsum(edge)[:-1].astype(bool)
        last = np.flatnonzero(np.append(owner[keep][1:] != owner[keep][:-1], True)) if len(start) else np.zeros(0, np.int64)
        take[stop[last]] = False
        length = np.bincount(owner[keep], weights=(stop - start + 1), minlength=n).astype(np.int64) - (kept > 0)
        offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
        text = pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(spread[take].tobytes())])
        if keep_whole:
            text = pc.if_else(pa.array(words.counts == kept), batch.column(0), text)
        yield pa.RecordBatch.from_arrays([pa.array(words.counts.astype(np.int64)), pa.array((words.counts - kept).astype(np.int64)), text, batch.column(2)], ["n_words", "n_removed", "kept_text", "row"])


def remove_repeats(docs: DataFrame, keep_whole: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Remove each word covered by a window that also starts earlier.

    Earlier is a smaller doc_id, or the same document and a smaller start; windows are those
    of the input. Returns n_words, n_removed, kept_text (the kept words joined by one
    space) and row, a struct of all columns of ``docs`` but the text, for every input row.
    With ``keep_whole`` the kept_text of a text that loses nothing is the text itself.
    Null and empty texts have no words and an empty kept_text (null with ``keep_whole``).
    Rows without a doc_id come after all others. Rows that repeat a doc_id are told apart by
    their texts; windows at one start of one doc_id count as one occurrence, of which none
    is earlier.
    """
    spark = docs.sparkSession
    prepare(spark)
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    size = size if size < 1 << 56 else 0  # plans that do not know theirs say the largest number
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST, size // PARTITION_BYTES))
    buckets = max(BUCKETS * partitions, min(16 * MOST, size // BUCKET_BYTES))
    rest = [c for c in docs.columns if c != text_column]
    text, doc_id = F.col(f"`{text_column}`").cast("string"), F.col(f"`{id_column}`").cast("long")
    tag = F.when(doc_id.isNull(), F.xxhash64(text)).otherwise(F.hash(text).cast("long"))
    keyed = docs.select(F.coalesce(doc_id, F.lit(_LAST)).alias("order_id"), tag.alias("tag"), text.alias("text"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"))
    sent = keyed.select("order_id", "tag", "text").mapInArrow(_split(buckets), "bucket long, packed boolean, payload binary")
    found = saved(sent.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(_count, _FOUND))
    place = F.struct("order_id", "start")
    handed = found.where("size = 0").withColumn("first", F.min(place).over(Window.partitionBy("k1", "k2"))).where(place != F.col("first"))
    gone = found.where("size > 0").unionByName(handed.select(*found.columns).withColumn("size", F.lit(1)))
    runs = gone.groupBy("order_id", "tag").agg(F.collect_set(F.struct("start", "size")).alias("runs"))
    both = keyed.join(runs, ["order_id", "tag"], "left").select("text", "runs", "row")
    return both.mapInArrow(partial(_cut, keep_whole), _schema(docs, rest))


def _schema(docs: DataFrame, rest: list[str]):
    """The result of ``remove_repeats``: counts, text and a struct of the other columns."""
    row = T.StructType([docs.schema[c] for c in rest])
    return T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("row", row)])


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Words of the whole ``documents`` table that a repeated window of 20 words covers."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_repeats(docs)
    return out.select("row.doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
