"""The driver's tables as the tables that the operators work on."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.keyword_index import KeywordIndex
from ..sources.store import Store

_INDEXES: dict[tuple[str, str], KeywordIndex] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: source is the collection, labels give trust and status, embeddings the vector."""
    docs, labels, vectors = (table(spark, sf_dir, t) for t in ("documents", "labels", "embeddings"))
    known = docs.join(labels, "doc_id", "left").join(vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    return known.select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("collection"), F.col("text").alias("content"), "lang", "embedding",
        F.when(F.col("quality") == 1, "T1").when(F.col("quality") == 0, "T3").otherwise("T4").alias("trust_level"),
        F.when(F.col("toxic") == 1, "archived").otherwise("active").alias("status"), F.lit(True).alias("current_truth"),
    )


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: ``spark.checkpoint.dir``; on one machine a temporary one will do."""
    if where := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return where
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the cluster shares")
    made = tempfile.mkdtemp(prefix="loregrid-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(made)
    return made


def held(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """``rows`` written to the shared folder and read again."""
    path = f"{shared_folder(spark)}/loregrid/{spark.sparkContext.applicationId}/held-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def keyword_index(spark: SparkSession, sf_dir: str) -> KeywordIndex:
    """The stored index of the documents, made when an application first asks for it."""
    app = spark.sparkContext.applicationId
    if (app, sf_dir) not in _INDEXES:
        root = f"{shared_folder(spark)}/loregrid/{app}/index-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
        index = KeywordIndex(Store(spark, root), id_type="long")
        index.put(table(spark, sf_dir, "documents").select(F.col("source").alias("collection"), F.col("doc_id").alias("chunk_id"), F.col("text").alias("content")))
        _INDEXES[app, sf_dir] = index
    return _INDEXES[app, sf_dir]


def matches(spark: SparkSession, sf_dir: str, phrases: list[list[str]]) -> DataFrame:
    """(chunk_id, bm25) of the documents that have any of the phrases."""
    return keyword_index(spark, sf_dir).matches(phrases).select("chunk_id", "bm25")


def kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of the engine's collections, with all that filters look at."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id"), "quality", "toxic")
    rows = chunks(spark, sf_dir).withColumnRenamed("collection", "source").join(labels, "chunk_id", "left")
    names = ["facts", "memory_cards", "documents", "codebase", "discoveries", "conversations"]
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(names) for x in (f"src{i}", k)]), F.col("source")), F.lit("runbooks"))
    good = F.coalesce(F.col("quality") == 1, F.lit(False))
    return rows.select(
        "chunk_id", kind.alias("collection"), "content", "embedding", "trust_level", F.when(F.col("toxic") == 1, "superseded").otherwise("active").alias("status"), F.lit(False).alias("current_truth"),
        F.col("lang").alias("project"), F.concat("lang", F.lit("/p")).alias("project_name"), F.col("source").alias("frontmatter_project"), F.concat(F.when(good, "kept,").otherwise(""), "lang").alias("tags"),
        F.col("lang").alias("language"), F.when(good, "config").otherwise("pattern").alias("category"), good.alias("confirmed"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as messages of sessions."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("line"), "role", F.col("text").alias("content"))


def query(spark: SparkSession, sf_dir: str) -> tuple[list[float], str]:
    """The query of the examples: vector 0, and the first three tokens of benchmark item 0."""
    v = table(spark, sf_dir, "embeddings").where("vec_id = 0").first().embedding
    words = table(spark, sf_dir, "benchmark").where("item_id = 0").select(F.slice(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_#./:-]+"), F.lit(0)), 1, 3).alias("w")).first().w
    return v, " ".join(words)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with instants, for windows and watermarks."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def marked(docs: DataFrame) -> DataFrame:
    """Documents as markdown with headings, a link and a tag."""
    body = F.concat(F.lit("# "), F.col("source"), F.lit("\n\n## "), F.col("lang"), F.lit("\n"), F.col("text"), F.lit("\nsee [["), F.col("source"), F.lit("|x]] and [["), F.col("lang"), F.lit("#part]] #"), F.col("lang"), F.lit(" `#no` #top/"), F.col("source"))
    return docs.select("doc_id", "source", "lang", body.alias("content"))


def noted(docs: DataFrame) -> DataFrame:
    """Documents with a secret, an address and a tag pair that cleaning must handle."""
    body = F.concat(F.lit("<system-reminder>hidden "), F.col("doc_id").cast("string"), F.lit("</system-reminder>\n\n\n\napi_key = abc"), F.col("doc_id").cast("string"), F.lit("xyz, mail user"), F.col("doc_id").cast("string"), F.lit("@example.org\n"), F.col("text"))
    return docs.select("doc_id", "source", "lang", body.alias("content"))
