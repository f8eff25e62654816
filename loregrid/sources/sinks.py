"""What the engine writes: notes, thread exports, prompts, archives, manifests, remote pushes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import lifecycle


def export_threads(rows: DataFrame, folder: str) -> None:
    """JSON lines of each thread in a folder of its own, in order of time and row."""
    rows.repartition("thread_id").sortWithinPartitions("thread_id", "timestamp", "row_no").write.partitionBy("thread_id").mode("overwrite").json(folder)


def write_files(rows: DataFrame, path: Column, content: Column, folder: str) -> DataFrame:
    """One text file for each row, through Spark's writer: (path, written_to) of what was written.

    Spark names files itself, so each row has a folder of its name.
    """
    named = rows.select(path.alias("path"), content.alias("value"))
    named.write.partitionBy("path").mode("overwrite").option("lineSep", "\n").text(folder)
    return named.select("path", F.concat(F.lit(f"{folder}/path="), "path").alias("written_to"))


def promoted_notes(notes: DataFrame, folder: str) -> DataFrame:
    """(path, content): the markdown files of promoted notes."""
    title = text.note_title(F.col("content"))
    path = lifecycle.note_file(F.col("project"), F.col("category"), F.try_to_timestamp("created_at"), F.col("note_id"), folder)
    return notes.where("confirmed").select(path.alias("path"), lifecycle.note_markdown(title, F.col("project"), F.col("category"), F.col("severity"), F.col("content")).alias("content"))


def prompts(sessions: DataFrame, instructions: str) -> DataFrame:
    """(name, prompt): extraction prompts of packed session texts."""
    body = F.concat(F.lit(instructions + "\n\nConversation:\n\n"), "text")
    return sessions.select(F.concat(text.safe_name(F.col("session_id")), F.lit(".txt")).alias("name"), body.alias("prompt"))


def manifest(files: DataFrame, archive: str, now: str) -> DataFrame:
    """What an archive run records of every file: where it went, its size and hash."""
    name = F.concat(F.substring("content_hash", 1, 12), F.lit("_"), F.element_at(F.split("path", "/"), -1))
    return files.select("path", F.concat(F.lit(f"{archive}/"), name).alias("archived_to"), "content_hash", F.lit(now).alias("archived_at"))


def to_push(records: DataFrame, pushed: DataFrame) -> DataFrame:
    """Records whose fingerprint the other side does not have yet, once each."""
    own = records.withColumn("fingerprint", text.fingerprint(F.col("content")))
    return own.dropDuplicates(["fingerprint"]).join(pushed.select("fingerprint"), "fingerprint", "left_anti")


def push(rows: DataFrame, send) -> DataFrame:
    """(fingerprint, ok): ``send`` called with each row as a dict, on the executors, a partition at a time."""

    def run(frames):
        for frame in frames:
            yield frame[["fingerprint"]].assign(ok=[bool(send(r)) for r in frame.to_dict("records")])

    return rows.mapInPandas(run, "fingerprint string, ok boolean")


def extraction_json(cards: DataFrame, agent: str) -> DataFrame:
    """One row with the extraction document of ranked cards: a summary and the cards in their order.

    A document holds the cards of one report, whose number the extraction bounds.
    """
    card = F.struct("type", "project", "title", "body", "status", "confidence", F.col("current_truth"), F.col("needs_confirmation").alias("needs_repo_confirmation"), F.split("tags", ",").alias("tags"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("score", "title", card.alias("card"))), asc=False), lambda x: x["card"])
    summary = F.struct(F.lit(f"{agent} history").alias("title"), F.array_sort(F.collect_set("project")).alias("projects_detected"), F.concat(F.count("*").cast("string"), F.lit(" cards")).alias("summary"))
    return cards.agg(F.to_json(F.struct(summary.alias("conversation_summary"), ordered.alias("memory_cards"))).alias("payload"))
