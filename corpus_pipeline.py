"""A corpus from raw documents: filter, deduplicate, cut repeats, mix sources, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. ``run`` writes each stage's result to the shared folder and reads it
again for the next. SQL cannot express the classifier, so there is no SQL for the rows.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loregrid.llm.mixing import mixed
from loregrid.llm.near_dedup import near_duplicates
from loregrid.llm.pieces import encoded_and_checked
from loregrid.llm.scratch import saved
from loregrid.llm.substring_dedup import remove_repeats
from loregrid.llm.toxicity import REJECT, held_out, score, train


DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")


def _same_columns(stage):
    """A stage that returns the columns that it is given, whatever further ones are called."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        plain = docs.toDF(*[c if c in DOCUMENTS else f"extra_{i}" for i, c in enumerate(docs.columns)])
        return stage(spark, plain, sf_dir).toDF(*docs.columns)

    return run


def _measured(docs: DataFrame) -> DataFrame:
    """``docs`` with n_chars of the text it has now; of a null text it stays."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))


@_same_columns
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose toxicity is below the threshold; null and empty texts stay.

    The classifier learns from the labels of ``sf_dir`` but those held out, on ``docs``.
    """
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out())
    return score(docs, model, keep_text=True).where(F.col("score") < REJECT).select("row.*")


@_same_columns
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of near duplicates the document of the smallest doc_id.

    Rows without a doc_id or without words stay; rows that repeat a doc_id stay or go together.
    """
    gone = near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


@_same_columns
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words that a repeated window of 20 words covers.

    Texts that lose nothing stay as they are; of the others the kept words are joined by one
    space, and may be none.
    """
    out = remove_repeats(docs, keep_whole=True)
    return _measured(out.select(*[F.col("kept_text").alias(c) if c == "text" else F.col(f"row.{c}") for c in docs.columns]))


@_same_columns
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row for each document and epoch of which something is taken."""
    return _measured(mixed(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_ids, decoded_sha256 and lossless for every row."""
    return encoded_and_checked(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("substring dedup", cut_repeats),
    ("mixing", mix),
    ("encoding", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
