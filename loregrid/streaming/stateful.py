"""Stateful steps that hold for tables and, with a watermark, for streams alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def connections(seen: DataFrame, gap: str = "300 seconds") -> DataFrame:
    """One row for each run of sightings of a client less than ``gap`` apart."""
    return seen.groupBy("client", F.session_window("ts", gap).alias("w")).agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("n")).drop("w")


def debounced(changes: DataFrame, quiet: str = "2 seconds") -> DataFrame:
    """One row for each burst of events of a path, with the last of them, once it has been quiet."""
    return changes.groupBy("path", F.session_window("ts", quiet).alias("w")).agg(F.max("ts").alias("last_event"), F.max_by("event", "ts").alias("event"), F.count("*").alias("n")).drop("w")


def expired(created: Column, now: Column, seconds: Column) -> Column:
    """Whether the time to live is over: expired or live."""
    age = (F.unix_micros(now) - F.unix_micros(created)) / 1e6
    return F.when(age > seconds, "expired").otherwise("live")


def available_now(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Run what a stream has now through ``batch``, resuming after what earlier runs have done."""
    run = stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()


def files(spark: SparkSession, folder: str, pattern: str, at_once: int = 8) -> DataFrame:
    """New files of a folder as a stream of (path, modified, content), a few in each batch."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", at_once).load(folder)


def vanished(stored: DataFrame, listed: DataFrame) -> DataFrame:
    """Stored paths that a listing of the folder no longer has: deletions, which streams don't tell."""
    return stored.select("file_path").distinct().join(listed.select(F.col("path").alias("file_path")), "file_path", "left_anti")


def within_budget(batch: DataFrame, chunks: int) -> DataFrame:
    """The first files of a batch, by path, up to ``chunks`` chunks, and one at least."""
    from pyspark.sql import Window

    order = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return batch.withColumn("before", F.sum("n_chunks").over(order) - F.col("n_chunks")).where(F.col("before") < chunks).drop("before")


def work_items(batch: DataFrame) -> DataFrame:
    """The paths of a batch, each once, in order of their first event: a queue without duplicates."""
    return batch.groupBy("path").agg(F.min("ts").alias("first_event"), F.max_by("event", "ts").alias("event")).orderBy("first_event", "path")


class Progress:
    """Collects what a stream reports of its batches: (name, batch, rows)."""

    def __init__(self, spark: SparkSession):
        from pyspark.sql.streaming import StreamingQueryListener

        seen: list[tuple[str, int, int]] = []

        class Listener(StreamingQueryListener):
            def onQueryStarted(self, event):
                pass

            def onQueryProgress(self, event):
                seen.append((event.progress.name, event.progress.batchId, event.progress.numInputRows))

            def onQueryIdle(self, event):
                pass

            def onQueryTerminated(self, event):
                pass

        self.seen, self._spark, self._listener = seen, spark, Listener()
        spark.streams.addListener(self._listener)

    def stop(self) -> None:
        self._spark.streams.removeListener(self._listener)
