"""Tables and checkpoints in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..plans.session import ship


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder, but only if all tasks run on this machine."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the cluster shares")
        where = tempfile.mkdtemp(prefix="loregrid-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def prepare(spark: SparkSession) -> None:
    """Before Python runs on executors: they get this package, and batches bounded in bytes."""
    ship(spark)


def _own(spark: SparkSession) -> str:
    return f"{folder(spark)}/loregrid/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to a table in the shared folder and read again: its lineage ends there."""
    spark = df.sparkSession
    path = f"{_own(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete the files of tables that ``saved`` made and that nothing reads any more."""
    for df in tables:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/loregrid/" in path:
                _delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application has saved; call it once all results are written."""
    _delete(spark, _own(spark))
