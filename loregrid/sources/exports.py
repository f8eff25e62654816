"""Exports that commit: data written by tasks, then a manifest, and a checkpoint of what is done."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .store import Conflict, Store


class Exports:
    """Named exports below ``root``, each a sequence of runs.

    A run writes its rows to a folder of its own and then publishes ``manifest-N.json`` with
    the schema, counts and folders, which is made whole or not at all. If a task fails there
    is no manifest and the folder goes; readers see committed runs alone. The keys of the
    committed rows are the checkpoint: a later run leaves them out, so that one that stopped
    is taken up by calling it again. Rows with an error are logged beside the data and are
    not part of the checkpoint, so they are tried again. Of two runs at once the later one
    to finish gets ``Conflict``.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Store(spark, root)

    def _at(self, name: str) -> str:
        return f"{self.files.root}/{name}"

    def manifests(self, name: str) -> list[dict]:
        """What each committed run recorded, in order."""
        found = sorted(n for n in self.files._names(self._at(name)) if n.startswith("manifest-"))
        return [json.loads(self.files._text(f"{self._at(name)}/{n}")) for n in found]

    def _rows(self, name: str, runs: list[dict], part: str) -> DataFrame | None:
        """The rows of some runs; a column that a run did not have yet is null."""
        out = None
        for run in runs:
            if run[part]:
                schema = StructType.fromJson(json.loads(run[f"{part}_schema"]))
                rows = self.spark.read.format(run["format"]).schema(schema).load(f"{self._at(name)}/{run[part]}")
                out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out

    def read(self, name: str) -> DataFrame | None:
        """The rows of all committed runs, or None if there is no run."""
        return self._rows(name, self.manifests(name), "data")

    def errors(self, name: str) -> DataFrame | None:
        """What the latest run logged: its key, the error and the time; None if nothing failed."""
        return self._rows(name, self.manifests(name)[-1:], "errors")

    def pending(self, name: str, rows: DataFrame, key: str) -> DataFrame:
        """``rows`` whose key no committed run has; rows without a key stay pending for good."""
        done = self.read(name)
        return rows if done is None else rows.join(done.select(key).distinct(), key, "left_anti")

    def run(self, name: str, rows: DataFrame, key: str, now: str, order: tuple[str, ...] = (), error: Column | None = None, by: str | None = None, format: str = "json") -> dict:
        """Write the pending ``rows``, sorted by ``order`` over all files, and return the manifest.

        ``error`` says what is wrong with a row, null if nothing. ``by`` names a column of
        few values whose rows the manifest counts. Rows without a key are logged as errors.
        """
        before = self.manifests(name)
        folder = f"run-{len(before) + 1:06d}-{uuid.uuid4().hex}"
        wrong = F.when(F.col(key).isNull(), "no key").otherwise(F.lit(None).cast("string") if error is None else error.cast("string"))
        try:
            self.pending(name, rows, key).withColumn("_error", wrong).write.parquet(f"{self._at(name)}/_{folder}")  # what is asked for is made once
            made = self.spark.read.parquet(f"{self._at(name)}/_{folder}")
            good, bad = made.where("_error IS NULL").drop("_error"), made.where("_error IS NOT NULL").select(key, F.col("_error").alias("error"), F.lit(now).alias("at"))
            counts = {(r.g if by else None, r.ok): r.n for r in made.groupBy((F.col(by) if by else F.lit(None)).cast("string").alias("g"), F.col("_error").isNull().alias("ok")).count().withColumnRenamed("count", "n").collect()}
            failed = sum(n for (_, ok), n in counts.items() if not ok)
            (good.repartitionByRange(*order).sortWithinPartitions(*order) if order else good).write.format(format).save(f"{self._at(name)}/{folder}")
            if failed:
                bad.write.format(format).save(f"{self._at(name)}/errors-{folder}")
            out = {
                "number": len(before) + 1, "created_at": now, "format": format, "key": key, "data": folder, "data_schema": good.schema.json(), "rows": sum(n for (_, ok), n in counts.items() if ok),
                "errors": f"errors-{folder}" if failed else None, "errors_schema": bad.schema.json(), "failed": failed, "by": {str(g): n for (g, ok), n in sorted(counts.items(), key=str) if ok} if by else {},
            }
            if not self.files._publish(f"{self._at(name)}/manifest-{out['number']:06d}.json", json.dumps(out)):
                raise Conflict(f"{name} has been exported meanwhile")
            return out
        except Exception:
            for made_folder in (folder, f"errors-{folder}"):
                self.files._delete(f"{self._at(name)}/{made_folder}")
            raise
        finally:
            self.files._delete(f"{self._at(name)}/_{folder}")

    def archive(self, root: str, now: str, pattern: str = "*.jsonl") -> dict:
        """Keep the bytes of all files below ``root``, once for each path and content; what is kept is left out.

        Files without a byte are left out too, as Spark's reader passes them over.
        """
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
        digest = F.sha2("content", 256)
        rows = found.select(F.sha2(F.concat_ws("\n", "path", digest), 256).alias("archive_id"), "path", digest.alias("content_hash"), "length", F.lit(now).alias("archived_at"), "content")
        return self.run("archive", rows, "archive_id", now, format="parquet")
