"""Toxicity by a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A text's feature j is r_j * count_j / sqrt(characters), for its hashed runs of 4 and 5
characters (A-Z lower-cased), where r_j is the log of the ratio of the smoothed shares of
n-gram j in toxic and in clean training texts. Logistic regression on these features is fit
by L-BFGS on at most ``TOXIC_ROWS`` toxic and ``CLEAN_ROWS`` clean labelled rows, the first
by hash of doc_id, weighted so that the classes count as in all training labels.

The sample's n-gram counts are a table in the shared folder, which tasks stream: counts of
the classes in one pass, then for each step the loss and its slope, ``BUCKETS`` numbers in
single precision from each of a few tasks. Neither texts nor their n-grams come to the driver, so the bounds on
rows are no matter of its memory. Scoring reads whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import drop, prepare, saved
from .text import _LOWER, U64, buffers, characters, pieces

GRAMS, BUCKETS = (4, 5), 1 << 18
TOXIC_ROWS, CLEAN_ROWS = 1500, 2500
STEPS, MEMORY, PENALTY = 30, 8, 1e-7
#: Tasks that read the sample's n-gram counts, each of which returns one slope.
LANES = 8
REJECT = 0.7


@dataclass
class Model:
    """The weight of each n-gram bucket, scaled by its log-count ratio, and a bias."""

    weights: np.ndarray
    bias: float


def _characters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, code points) of a column of texts, A-Z lower-cased; null is empty."""
    offsets, data = buffers(column)
    return characters(offsets, _LOWER[data])


def _grams(points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(n, bucket of the n characters from each position on) for the lengths in GRAMS."""
    total, wide = points.astype(U64), points.astype(U64)
    for n in range(2, max(GRAMS) + 1):
        if len(wide) < n:
            return
        total = total[:-1] * U64(0x9E3779B97F4A7C55) + wide[n - 1 :]
        if n in GRAMS:
            x = (total ^ (total >> U64(29))) * U64(0xBF58476D1CE4E5B9)
            yield n, ((x >> U64(40)) & U64(BUCKETS - 1)).astype(np.int32)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        offsets, points = _characters(batch.column(1))
        index, value = [], []
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            parts = [g for _, g in _grams(points[a:b])]
            buckets, counts = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.int32), return_counts=True)
            index.append(buckets.tobytes())
            value.append((counts / np.sqrt(max(1, b - a))).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(index, pa.binary()), pa.array(value, pa.binary())], ["toxic", "index", "value"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(label, first entry, bucket, value) of the rows of each batch; rows without n-grams are left out."""
    for batch in batches:
        (at, index), (_, value) = (buffers(batch.column(i)) for i in (1, 2))
        some = np.diff(at) > 0
        label = batch.column(0).to_numpy().astype(np.float64)
        yield label, np.where(some, at[:-1] // 4, -1), index.view(np.int32), value.view(np.float32)


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one task's rows, by class: how many have each bucket, and how many there are."""
    counts, rows = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
    for label, first, index, _ in _entries(batches):
        rows += np.bincount(label.astype(np.int64), minlength=2)
        some = first >= 0
        each = np.repeat(label[some], np.diff(np.append(first[some], len(index))))
        for k in range(2):
            counts[k] += np.bincount(index[each == k], minlength=BUCKETS)
    yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()]) for c in (counts.astype(np.int32), rows)], ["counts", "rows"])


def _slopes(sent, weight: tuple[float, float]):
    """The loss of one task's rows at the weights broadcast as ``sent``, and its slope."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.frombuffer(sent.value, np.float64)
        loss, slope = 0.0, np.zeros(BUCKETS + 1)
        for label, first, index, value in _entries(batches):
            score, some = np.full(len(label), w[-1]), first >= 0
            size = np.diff(np.append(first[some], len(index)))
            if len(index):
                score[some] += np.add.reduceat(value * w[:-1][index], first[some])
            each = np.where(label == 1, weight[1], weight[0])
            error = each * (1 / (1 + np.exp(-np.clip(score, -50, 50))) - label)
            loss += float(each @ (np.logaddexp(0, score) - label * score))
            slope[:-1] += np.bincount(index, value * np.repeat(error[some], size), BUCKETS)
            slope[-1] += error.sum()
        yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([slope.astype(np.float32).tobytes()])], ["loss", "slope"])

    return run


def fit(features: DataFrame, toxic: int, clean: int) -> Model:
    """The model of a table of (toxic, index, value); ``toxic`` and ``clean`` count all labels."""
    spark = features.sparkSession
    base = float(np.log((toxic + 0.5) / (clean + 0.5)))
    found = features.mapInArrow(_shares, "counts binary, rows binary").collect()
    counts = sum((np.frombuffer(r.counts, np.int32) for r in found), np.zeros(2 * BUCKETS, np.int64)).reshape(2, BUCKETS) + 1
    rows = sum((np.frombuffer(r["rows"], np.int64) for r in found), np.zeros(2, np.int64))
    if not rows.all():
        return Model(np.zeros(BUCKETS, np.float32), base)
    ratio = np.log((counts[1] / counts[1].sum()) / (counts[0] / counts[0].sum()))
    weight = (clean / (toxic + clean) / float(rows[0]), toxic / (toxic + clean) / float(rows[1]))

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        sent = spark.sparkContext.broadcast(np.append(w[:-1] * ratio, w[-1]).tobytes())
        parts = features.mapInArrow(_slopes(sent, weight), "loss double, slope binary").collect()
        sent.destroy()
        slope = sum((np.frombuffer(r.slope, np.float32) for r in parts), np.zeros(BUCKETS + 1))
        slope[:-1] = slope[:-1] * ratio + PENALTY * w[:-1]
        return sum(r.loss for r in parts) + PENALTY / 2 * float(w[:-1] @ w[:-1]), slope

    w = minimum(loss, np.append(np.zeros(BUCKETS), base))
    return Model((w[:-1] * ratio).astype(np.float32), float(w[-1]))


def minimum(loss, w: np.ndarray) -> np.ndarray:
    """L-BFGS with halving steps, from ``w``."""
    moves: list[tuple[np.ndarray, np.ndarray, float]] = []
    now, slope = loss(w)
    for _ in range(STEPS):
        way, parts = slope.copy(), []
        for move, change, along in reversed(moves):
            parts.append(move @ way / along)
            way -= parts[-1] * change
        way *= moves[-1][2] / (moves[-1][1] @ moves[-1][1]) if moves else 1 / np.sqrt(np.abs(slope).sum() + 1e-12)
        for (move, change, along), part in zip(moves, reversed(parts), strict=True):
            way += (part - change @ way / along) * move
        step, gain = 1.0, slope @ way
        while True:
            after, new = loss(w - step * way)
            if after <= now - 1e-4 * step * gain or step < 1e-4:
                break
            step /= 2
        if not after < now:
            break
        move, change = -step * way, new - slope
        w, now, slope = w + move, after, new
        if (along := float(move @ change)) > 1e-14:
            moves = [*moves, (move, change, along)][-MEMORY:]
    return w


def train(docs: DataFrame, labels: DataFrame, usable: Column, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> Model:
    """Fit on the labelled rows of ``docs`` for which ``usable``, a condition on ``labels``, holds.

    Labels other than 0 and 1 are not used; a doc_id with several labels counts as toxic if
    any is 1. Without rows of both classes the score is the smoothed share of the toxic.
    """
    prepare(docs.sparkSession)
    known = labels.where(usable).where(F.col(label_column).isin(0, 1)).groupBy(F.col(id_column).cast("long").alias("doc_id")).agg(F.max(label_column).cast("int").alias("toxic")).where("doc_id IS NOT NULL")
    totals = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    order = [F.xxhash64("doc_id", F.lit(5)), F.col("doc_id")]
    sample = known.where("toxic = 1").orderBy(*order).limit(TOXIC_ROWS).unionByName(known.where("toxic = 0").orderBy(*order).limit(CLEAN_ROWS))
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    chosen = texts.join(F.broadcast(sample), "doc_id").select("toxic", "text")
    counted = chosen.mapInArrow(_features, "toxic int, index binary, value binary")
    features = saved(counted.repartition(LANES, F.xxhash64("index", "value")))
    model = fit(features.coalesce(LANES), totals.get(1, 0), totals.get(0, 0))
    drop(features)
    return model


def _score(model: Model, text_column: str, fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_column):
            offsets, points = _characters(batch.column(text_column))
            sizes = np.diff(offsets)
            total = np.zeros(len(sizes))
            some = sizes > 0
            for n, buckets in _grams(points):
                each = np.zeros(len(points))
                each[: len(buckets)] = model.weights[buckets]
                for back in range(1, n):  # the last n - 1 positions of a text begin no n-gram
                    ends = offsets[1:] - back
                    each[ends[ends >= offsets[:-1]]] = 0
                total[some] += np.add.reduceat(each, offsets[:-1][some])
            score = 1 / (1 + np.exp(-np.clip(total / np.sqrt(np.maximum(sizes, 1)) + model.bias, -50, 50)))
            row = pa.StructArray.from_arrays([batch.column(c) for c in fields], fields)
            yield pa.RecordBatch.from_arrays([pa.array(np.round(score, 9)), row], ["score", "row"])

    return run


def score(docs: DataFrame, model: Model, text_column: str = "text", keep_text: bool = False) -> DataFrame:
    """score, 0 to 1, for every whole text, and row: the other columns (with ``keep_text`` all).

    Null and empty texts, and texts of fewer than 4 characters, get the score of the bias
    alone. Equal texts have equal scores.
    """
    prepare(docs.sparkSession)
    fields = [f for f in docs.schema.fields if keep_text or f.name != text_column]
    schema = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("row", T.StructType(fields))])
    return docs.mapInArrow(_score(model, text_column, [f.name for f in fields]), schema)


def held_out(id_column: str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of its id as text leaves 1 on division by 3."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 3 == 1, F.lit(False))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """The toxicity of every whole text of ``documents``."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs, labels, ~held_out())
    out = score(docs.select("doc_id", "text"), model)
    return out.select("row.doc_id", held_out("row.doc_id").alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))
