"""Filter interaction audit: what each of five filters removes in every order of them.

Native expressions give each document a mask of the filters that it fails. The first four
bits depend on the text alone. The fifth, a copy of a smaller doc_id, comes from the
smallest doc_id of each text: texts meet by SHA-256, counted per (text, part, labels) before
they do, so a text that a third of all rows hold is as many rows as there are parts and
labels. What remains is a histogram: 32 cells a part, each with its documents and how many
of them are good and toxic. Every order is read off the cells; no document is seen again.

Null texts are empty. A document without a doc_id is no copy of a smaller one, but may share
its text. Rows that repeat a doc_id with its text fail or pass together. A document with
several labels counts as good (toxic) if any of them says so; null labels say nothing. A null
part is the empty part. No documents: no rows.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
MASKS = 1 << len(FILTERS)
MIN_WORDS, MIN_DISTINCT, MAX_UPPER, SYMBOLS = 200, 50, 3, "[#$%&*|]"
_GAP = r"[\x20\x09-\x0D]+"


def text_mask(text: Column, words: Column) -> Column:
    """Bits A to D of a text that is not null and its ``words``: few words, few distinct, many capitals, a symbol."""
    n, capitals = F.size(words), F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = [
        n < MIN_WORDS,
        100 * F.size(F.array_distinct(words)).cast("long") < MIN_DISTINCT * n.cast("long"),
        100 * capitals.cast("long") > MAX_UPPER * F.length(text).cast("long"),
        text.rlike(SYMBOLS),
    ]
    return sum((F.when(failed, 1 << bit).otherwise(0) for bit, failed in enumerate(fails)), F.lit(0))


def masked(docs: DataFrame, part: str) -> DataFrame:
    """(doc_id, part, text_key, mask): one narrow row a document, with the bits of its text."""
    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    words = rows.withColumn("words", F.array_remove(F.split("text", _GAP), ""))
    return words.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("text_key"), text_mask(F.col("text"), F.col("words")).alias("mask"))


def histogram(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): the documents of each part by the filters that they fail."""
    said = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = masked(docs, part).groupBy("doc_id", "part", "text_key", "mask").agg(F.count("*").alias("n"))
    known = rows.join(said, "doc_id", "left").na.fill(0, ["good", "toxic"])
    groups = known.groupBy("text_key", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("first"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("unnamed"), F.min_by(F.struct("n"), "doc_id").getField("n").alias("at_first")
    )
    met = groups.withColumn("least", F.min("first").over(Window.partitionBy("text_key")))  # a text has as many rows as parts and labels
    own = F.col("unnamed") + F.when(F.col("first") == F.col("least"), F.col("at_first")).otherwise(0)
    cells = F.explode(F.array(F.struct(F.col("mask"), own.alias("n")), F.struct((F.col("mask") + COPY).alias("mask"), (F.col("n") - own).alias("n")))).alias("c")
    counted = met.select("part", "good", "toxic", cells)
    return counted.groupBy("part", F.col("c.mask").alias("mask")).agg(F.sum("c.n").alias("n"), F.sum(F.col("c.n") * F.col("good")).alias("good"), F.sum(F.col("c.n") * F.col("toxic")).alias("toxic"))


def _shares() -> Column:
    """In how many orders a filter comes before k - 1 others, for k from 1."""
    return F.array(*[F.lit(factorial(len(FILTERS)) // k).cast("long") for k in range(1, len(FILTERS) + 1)])


def audit(cells: DataFrame) -> DataFrame:
    """A row for each part, order and step, from the ``histogram``: the counts of the step's filter.

    kept, removed, redundant, unique_fails, good_lost, toxic_lost, and shapley: what the filter
    removes summed over all orders. A filter that a document fails with k - 1 others comes
    first among them in 1 / k of the orders.
    """
    whole = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most 32 a part
    orders = F.explode(F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])).alias("filter_order")
    steps = whole.select("*", orders).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bits = lambda letters: sum((F.when(F.instr(letters, f) > 0, 1 << i).otherwise(0) for i, f in enumerate(FILTERS)), F.lit(0))
    here = steps.withColumn("own", bits(F.substring("filter_order", F.col("step"), F.lit(1)))).withColumn("before", bits(F.substring("filter_order", F.lit(1), F.col("step") - 1)))
    own, before = F.col("own"), F.col("before")

    def total(value, when) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + F.when(when(c.mask), value(c)).otherwise(0).cast("long"))

    fails, earlier = (lambda m: m.bitwiseAND(own) != 0), (lambda m: m.bitwiseAND(before) != 0)
    removed = lambda m: fails(m) & ~earlier(m)
    return here.select(
        "part", "filter_order", "step",
        total(lambda c: c.n, lambda m: ~fails(m) & ~earlier(m)).alias("kept"),
        total(lambda c: c.n, removed).alias("removed"),
        total(lambda c: c.n, lambda m: fails(m) & earlier(m)).alias("redundant"),
        total(lambda c: c.n, lambda m: m == own).alias("unique_fails"),
        total(lambda c: c.good, removed).alias("good_lost"),
        total(lambda c: c.toxic, removed).alias("toxic_lost"),
        total(lambda c: c.n * F.element_at(_shares(), F.bit_count(c.mask)), fails).alias("shapley"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents by language."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return audit(histogram(docs, labels))
