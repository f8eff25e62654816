"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Each source's documents, in seeded order, are one stream of words, cut into blocks of
``BLOCK`` words. The mix is as many blocks as all sources hold, dealt to ``SHARDS`` shards:
block after block goes to the source of the highest quotient target / (2 q + 1), q being
what it has, and each shard takes the next equal share of that sequence, so a source has an
integer quota in every shard. A source's quota is then met by seeded selection among its
blocks: a permutation without memory, whole passes over all blocks first.
"""

from __future__ import annotations

import hashlib
import math
import re
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import prepare, saved

BLOCK, SHARDS = 64, 16
#: Hash lanes of a source in which its documents are put in order: the least number, and the rows for one more.
LANES, LANE_ROWS = 64, 200_000
WEIGHTS, MOST = (5, 2, 1), 3
_WORDS = r"[^\x20\x09-\x0D]+"
_WORD = re.compile(_WORDS.encode())


def targets(sizes: list[int], weights: list[float], most: int = MOST) -> list[float]:
    """Shares of sum(sizes) by weight; what exceeds ``most`` times a size is reshared until none does."""
    out, free, left = [0.0] * len(sizes), {i for i, x in enumerate(sizes) if x > 0}, Fraction(sum(sizes))
    while free:
        unit = left / sum(Fraction(weights[i]) for i in free)
        full = {i for i in free if unit * Fraction(weights[i]) > Fraction(most) * sizes[i]}
        for i in full or free:
            out[i] = float(Fraction(most) * sizes[i] if full else unit * Fraction(weights[i]))
        if not full:
            break
        left -= sum(Fraction(most) * sizes[i] for i in full)
        free -= full
    return out


def apportion(wanted: list[float], seats: int) -> list[int]:
    """Sainte-Lague: seats by highest quotients wanted / (2 q + 1), ties to the first.

    The seats below a common quotient are found at once, by bisection of the divisor; only
    the last few are dealt one by one.
    """
    if seats <= 0 or sum(wanted) <= 0:
        return [0] * len(wanted)
    low, high = 0.0, 4.0 * sum(wanted) / seats + 1.0
    given = lambda d: [math.floor(w / d + 0.5) for w in wanted]
    for _ in range(200):
        mid = (low + high) / 2
        if not low < mid < high:
            break
        low, high = (low, mid) if sum(given(mid)) <= seats else (mid, high)
    out = given(high)
    while sum(out) < seats:
        best = max(range(len(wanted)), key=lambda i: (wanted[i] / (2 * out[i] + 1), -i))
        out[best] += 1
    return out


def _permutation(key: str, n: int) -> tuple[int, int]:
    """(p, c): b -> (b * p + c) mod n is a permutation of 0 .. n - 1, chosen by ``key``."""
    raw = hashlib.sha256(key.encode()).digest()
    p = int.from_bytes(raw[:8], "big") % n or 1
    p = max(1, p % min(1 << 30, (1 << 62) // n))  # the product stays within 64 bits
    while math.gcd(p, n) != 1:
        p += 1
    return p % n if n > 1 else 0, int.from_bytes(raw[8:16], "big") % n


def mix_sources(docs: DataFrame, carry: bool = False, weights: tuple = WEIGHTS, most: int = MOST, seed: int = 11, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """doc_id, size, source, source_size, target, taken and takes for every row of ``docs``.

    Sources by code point, null last, weigh ``weights`` in turn. size counts the words of the
    text (null: 0), taken those the mix takes, repeats counted, and takes lists the runs of
    words taken as (shard, epoch, first, n): within an epoch a word is taken at most once.
    Each source comes within a block's words of its target. Texts without words are never
    taken; if no text has words all targets are 0. The order of the rows, and with it the
    mix, follows from the seed, doc_ids and texts, so reruns agree. With ``carry`` the
    result also has row, a struct of all columns of ``docs``. The driver sees a row for each
    source; where its lanes begin, of which there are more the more rows there are, is
    summed up by executors.
    """
    spark = docs.sparkSession
    text, doc_id = F.col(f"`{text_column}`").cast("string"), F.col(f"`{id_column}`").cast("long")
    size = F.coalesce(F.regexp_count(text, F.lit(_WORDS)), F.lit(0)).cast("long")
    columns = [doc_id.alias("doc_id"), size.alias("size"), F.col(f"`{source_column}`").cast("string").alias("source"), F.xxhash64(F.lit(seed), doc_id, text).alias("at")]
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    slim = saved(docs.select(*columns, *row))
    many = max(LANES, slim.count() // LANE_ROWS)
    laned = slim.withColumn("lane", F.pmod(F.shiftright("at", 7), F.lit(many)).cast("int"))
    lanes = saved(laned.groupBy("source", "lane").agg(F.sum("size").alias("words")))
    known = {r.source: r.words for r in lanes.groupBy("source").agg(F.sum("words").alias("words")).collect()}
    names = sorted(known, key=lambda s: (s is None, s or ""))
    sizes = [known[s] for s in names]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], most)
    total = round(sum(wanted) / BLOCK)
    steps = [apportion(wanted, total * (j + 1) // SHARDS) for j in range(SHARDS)]

    plan = []
    for i, s in enumerate(names):
        blocks = max(1, -(-sizes[i] // BLOCK))
        words = BLOCK * steps[-1][i]
        epochs = min(words // sizes[i], most) if sizes[i] else 0
        rest = min(blocks, round((words - epochs * sizes[i]) / BLOCK)) if sizes[i] and epochs < most else 0
        p, c = _permutation(f"{seed}:{i}:{s}", blocks)
        plan.append((i, s, sizes[i], wanted[i], blocks, epochs, rest, p, c, [x[i] for x in steps]))
    table = spark.createDataFrame(plan, "no int, name string, source_size long, target double, blocks long, epochs int, rest long, p long, c long, quotas array<long>")
    before = Window.partitionBy("source").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    bases = lanes.select("source", "lane", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base")).join(table.select("no", "name"), F.col("source").eqNullSafe(F.col("name"))).select("no", "lane", "base")

    order = Window.partitionBy("no", "lane").orderBy("at", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = laned.join(table, laned.source.eqNullSafe(table.name)).withColumn("end", F.sum("size").over(order)).join(bases, ["no", "lane"])
    placed = known.withColumn("begin", F.col("base") + F.col("end") - F.col("size")).withColumn("end", F.col("base") + F.col("end"))
    blocks = F.expr(f"""
        if(size = 0, array(), transform(sequence(begin div {BLOCK}, (end - 1) div {BLOCK}), b -> named_struct(
            'k', (b * p + c) % blocks, 'first', greatest(b * {BLOCK}, begin) - begin,
            'n', least((b + 1) * {BLOCK}, end) - greatest(b * {BLOCK}, begin))))""")
    takes = F.expr(f"""
        flatten(transform(filter(sequence(0, {most}), e -> e < epochs or e = epochs and rest > 0), e ->
            transform(filter(cut, x -> e < epochs or x.k < rest), x -> named_struct(
                'shard', least(size(filter(quotas, q -> q <= x.k + e * blocks)), {SHARDS - 1}),
                'epoch', e, 'first', x.first, 'n', x.n))))""")
    out = placed.withColumn("cut", blocks).withColumn("takes", takes)
    taken = F.expr("aggregate(takes, cast(0 as bigint), (s, x) -> s + x.n)")
    return out.select("doc_id", "size", "source", "source_size", "target", taken.alias("taken"), "takes", *["row"] * carry)


def _runs_of(texts: pd.Series, firsts: pd.Series, counts: pd.Series) -> pd.Series:
    """The words of some runs of each text, joined by one space, in time linear in the text."""
    out = []
    for text, first, n in zip(texts, firsts, counts, strict=True):
        words = [] if text is None else _WORD.findall(text)
        out.append(None if text is None else b" ".join(w for a, k in zip(first.tolist(), n.tolist(), strict=True) for w in words[a : a + k]))
    return pd.Series(out, dtype=object)


def mixed(docs: DataFrame, text_column: str = "text", **how) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each document and epoch of it.

    A row's text is the whole text where the epoch takes all its words, otherwise the words
    taken, joined by one space. Documents of which nothing is taken have no row.
    """
    prepare(docs.sparkSession)
    out = mix_sources(docs, carry=True, text_column=text_column, **how)
    epochs = out.select("row", "size", "takes", F.explode(F.array_distinct(F.col("takes.epoch"))).alias("epoch"))
    own = epochs.select("row", "size", F.expr("filter(takes, x -> x.epoch = epoch)").alias("own"))
    whole = F.expr("aggregate(own, cast(0 as bigint), (s, x) -> s + x.n) = size")
    known = F.col(f"row.`{text_column}`")
    some = F.pandas_udf(_runs_of, "binary")(F.when(~whole, known.cast("binary")), F.col("own.first"), F.col("own.n"))
    text = F.when(whole, known).otherwise(some.cast("string"))
    return own.select(*[text.alias(c) if c == text_column else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """The mix of the whole ``documents`` table by source."""
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
