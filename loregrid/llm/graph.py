"""Joins whose hot keys are dealt to several tasks, and connected components by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import drop, saved

#: Hash buckets in which keys are counted, and the rows of one that are never split.
HASHES, FEW = 4096, 1024


def bucket(*keys: str) -> Column:
    """The hash bucket of a key."""
    return F.pmod(F.xxhash64(*keys, F.lit(29)), F.lit(HASHES)).cast("int")


def salts(df: DataFrame, counts: dict[int, int]) -> dict[int, list[int]]:
    """The buckets to split, by the number of their parts: a part is at most two tasks' even share.

    Few can be: a bucket that is split holds more than that share.
    """
    share = max(FEW, 2 * sum(counts.values()) // int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts: dict[int, list[int]] = {}
    for b, n in counts.items():
        if n > share:
            parts.setdefault(-(-n // share), []).append(b)
    return parts


def spread(many: DataFrame, one: DataFrame, keys: list[str], by: str, parts: dict[int, list[int]], how: str = "inner") -> DataFrame:
    """``many`` joined with ``one`` on ``keys``, the rows of a split bucket dealt by hash of ``by``.

    The rows of ``one`` in a split bucket are repeated for each part. Which buckets are split
    changes where rows meet, never which.
    """
    if not parts:
        return many.join(one, keys, how)
    split = F.lit(1)
    for n, buckets in sorted(parts.items()):
        split = F.when(bucket(*keys).isin(buckets), n).otherwise(split)
    dealt = many.withColumn("_salt", F.pmod(F.xxhash64(by, F.lit(31)), split).cast("int"))
    repeated = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), split - 1)))
    return dealt.join(repeated, [*keys, "_salt"], how).drop("_salt")


def salted(many: DataFrame, one: DataFrame, keys: list[str], by: str, how: str = "inner") -> DataFrame:
    """``spread`` by the rows that ``many``, best a saved table, has in each bucket: HASHES counts."""
    counts = {r.b: r["count"] for r in many.groupBy(bucket(*keys).alias("b")).count().collect()}
    return spread(many, one, keys, by, salts(many, counts), how)


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node with a link.

    ``links`` has the columns a and b, both whole numbers. Each round points every node's
    larger neighbours, then its smaller ones, at the smallest it knows of (the large and
    small star of Kiveris et al., 2014), so long chains halve. The smallest is a partial
    aggregate; the joins back are dealt by the degrees of hub nodes, counted in HASHES
    buckets together with the check for the end.
    """
    edges = saved(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        ends = F.explode(F.array(F.struct(F.lit(0).alias("side"), bucket("u").alias("b"), F.xxhash64("u", "v").alias("h")), F.struct(F.lit(1).alias("side"), bucket("v").alias("b"), F.lit(0).cast("long").alias("h")))).alias("e")
        facts = edges.select(ends).groupBy("e.side", "e.b").agg(F.count("*").alias("n"), F.sum(F.col("e.h").cast("decimal(38,0)")).alias("h")).collect()
        now = (sum(r.n for r in facts), sum(int(r.h) for r in facts))
        if not facts or now == state:
            break
        state = now
        degree = [salts(edges, {r.b: r.n for r in facts if r.side == side}) for side in (0, 1)]
        lower = edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
        large = spread(edges, lower, ["v"], "u", degree[1], "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        after = saved(spread(large, least, ["u"], "v", degree[0]).select(pairs).select("e.*").where("u <> v").distinct())
        drop(edges)
        edges = after
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
