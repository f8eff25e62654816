"""The ingest queue as a table: configured projects, what is next, and what a run did."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def configured(projects: DataFrame, state: DataFrame) -> DataFrame:
    """Every configured project with its state; missing fields get their defaults."""
    joined = projects.join(state.drop("path"), "name", "left")
    defaults = {"status": "pending", "attempts": 0, "phase": "markdown", "last_attempt_at": 0.0, "last_success_at": 0.0, "last_error": "", "markdown_index": 0, "code_index": 0, "markdown_total": 0, "code_total": 0}
    return joined.select("name", "path", *[(F.coalesce(c, F.lit(v)) if c in state.columns else F.lit(v)).alias(c) for c, v in defaults.items()])


def started(queue: DataFrame, name: str, now: float) -> DataFrame:
    """The project is running; only a start from another state counts as an attempt."""
    mine = F.col("name") == name
    attempts = F.col("attempts") + (mine & (F.col("status") != "running")).cast("int")
    return queue.withColumn("attempts", attempts).withColumn("status", F.when(mine, "running").otherwise(F.col("status"))).withColumn("last_attempt_at", F.when(mine, F.lit(now)).otherwise(F.col("last_attempt_at")))


def ended(queue: DataFrame, name: str, now: float, done: bool, error: str = "", failed: bool = False) -> DataFrame:
    """After a run: retry if it failed, done if all is, else running on; file errors leave it done."""
    mine = F.col("name") == name
    status = "retry" if failed else "done" if done else "running"
    out = queue.withColumn("status", F.when(mine, status).otherwise(F.col("status"))).withColumn("last_error", F.when(mine, error).otherwise(F.col("last_error")))
    return out if failed else out.withColumn("last_success_at", F.when(mine, F.lit(now)).otherwise(F.col("last_success_at")))


def reset(queue: DataFrame, names: list[str] | None = None, status: str | None = None) -> DataFrame:
    """Projects by name or status back to pending, with cursors at the beginning."""
    hit = F.lit(True) if names is None and status is None else F.lit(False)
    hit = hit | F.col("name").isin(names or []) | (F.col("status") == (status or ""))
    fresh = {"status": F.lit("pending"), "attempts": F.lit(0), "phase": F.lit("markdown"), "markdown_index": F.lit(0), "code_index": F.lit(0), "last_error": F.lit("")}
    return queue.select(*[F.when(hit, fresh[c]).otherwise(F.col(c)).alias(c) if c in fresh else F.col(c) for c in queue.columns])


def errors(queue: DataFrame, most: int = 10) -> DataFrame:
    """The most frequent first lines of errors."""
    first = F.substring(F.split_part(F.split_part("last_error", F.lit("\n"), F.lit(1)), F.lit(";"), F.lit(1)), 1, 120)
    return queue.where("last_error <> ''").groupBy(first.alias("error")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error").limit(most)
