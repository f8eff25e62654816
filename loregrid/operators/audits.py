"""Counts, inventories and dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed


def counts_with_total(table: DataFrame, by: str) -> DataFrame:
    """Rows of each value and, under a null value, of all."""
    return table.rollup(by).agg(F.count("*").alias("n"), F.grouping(by).cast("int").alias("is_total"))


def counts_by_sets(table: DataFrame, *columns: str) -> DataFrame:
    """Rows by each of the columns on its own, in one pass: (dimension, value, n)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.coalesce(F.expr(f"nullif(cast(`{c}` as string), '')"), F.lit("-")).alias("value")) for c in columns]))
    return table.select(pairs.alias("p")).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))


def card_audit(cards: DataFrame) -> DataFrame:
    """Totals of a table of cards: all, current, to be confirmed."""
    return cards.agg(F.count("*").alias("total"), F.count_if("current_truth").alias("current"), F.count_if("needs_confirmation").alias("to_confirm"))


def semantic_audit(records: DataFrame, notes: DataFrame, uncovered: DataFrame) -> DataFrame:
    """One row about the life cycle of records and of the notes that they come from.

    Records: by state, with a note behind them, never reviewed, superseded by nothing. Notes:
    made a record, and confirmed but not. ``uncovered`` holds the projects without a record.
    Null and empty links and dates count as none; each table is read once.
    """
    none = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    state = lambda s: F.col("status") == s
    known = F.col("status").isin("active", "archived", "superseded")
    about = records.agg(
        *[F.count_if(state(s)).alias(f"{s}_records") for s in ("active", "archived", "superseded")],
        F.count_if(known & ~none("linked_note")).alias("records_with_note"), F.count_if(known & none("reviewed_at")).alias("records_never_reviewed"),
        F.count_if(state("superseded") & none("superseded_by")).alias("superseded_by_nothing"),
    )
    of_notes = notes.agg(F.count_if(~none("linked_record")).alias("notes_with_record"), F.count_if(F.coalesce("confirmed", F.lit(False)) & none("linked_record")).alias("notes_to_promote"))
    return about.crossJoin(F.broadcast(of_notes)).crossJoin(F.broadcast(uncovered.agg(F.count("*").alias("projects_without_record"))))  # one row each


def review_candidates(records: DataFrame, as_of: str, most: int = 50) -> DataFrame:
    """Active records that nobody has reviewed, oldest first, ties by id, with their age in days."""
    made = F.try_to_timestamp(F.expr("nullif(created_at, '')"))
    rows = records.where((F.col("status") == "active") & (F.coalesce("reviewed_at", F.lit("")) == ""))
    return rows.select("record_id", "record_type", "project", F.substring("created_at", 1, 10).alias("created"), F.coalesce(age_days(made, F.lit(as_of).cast("timestamp")), F.lit(0)).alias("age_days")).orderBy(F.desc("age_days"), "record_id").limit(most)


def project_audit(projects: DataFrame) -> DataFrame:
    """One row about configured projects (position, name, kind, state, chunks) and the first one to index.

    The first is that of the smallest position among code projects that are registered and have no chunks.
    """
    code = F.col("kind") == "code"
    waiting = code & (F.col("chunks") == 0) & (F.col("state") == "registered")
    return projects.agg(
        F.count("*").alias("total_projects"), F.count_if(code).alias("code_projects"), F.count_if(code & (F.col("chunks") > 0)).alias("indexed"), F.count_if(waiting).alias("waiting"),
        F.count_if(F.col("state") == "error").alias("errored"), F.coalesce(F.min_by("name", F.when(waiting, F.struct("position", "name"))), F.lit("")).alias("next_project"),
    )


def import_summary(files: DataFrame, exchanges: DataFrame) -> DataFrame:
    """What an import of session files would add: (section, name, files, skipped, exchanges, chunks).

    ``files`` has path; ``exchanges`` has path, agent, project and chunks, a row for each
    exchange. The row of section ``all`` counts every file; those without an exchange are
    skipped. The others count by agent, by agent name, and by project, most exchanges first.
    Null agents and projects are named ``-``. Exchanges are counted by file before they meet
    the files, so that a file of any size is one row there.
    """
    named = lambda c: F.coalesce(F.col(c), F.lit("-")).alias(c)
    of_file = exchanges.select("path", named("agent"), named("project"), "chunks").groupBy("path", "agent", "project").agg(F.count("*").alias("exchanges"), F.sum("chunks").alias("chunks"))
    rows = files.select("path").distinct().join(of_file, "path", "left").withColumn("read", F.when(F.col("exchanges").isNotNull(), F.col("path")))
    sets = rows.groupingSets([[], ["agent"], ["project"]], "agent", "project").agg(
        F.grouping_id().alias("g"), F.countDistinct("path").alias("found"), F.countDistinct("read").alias("files"), F.coalesce(F.sum("exchanges"), F.lit(0)).alias("exchanges"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"))
    section = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "agent").otherwise("project")
    each = sets.where("g = 3 OR files > 0").select(section.alias("section"), F.coalesce("agent", "project", F.lit("")).alias("name"), "files", F.when(F.col("g") == 3, F.col("found") - F.col("files")).otherwise(0).alias("skipped"), "exchanges", "chunks")
    one = files.sparkSession.range(1).select(F.lit("all").alias("section"))  # without any file there is no group
    out = one.join(each, "section", "full").na.fill({"name": "", "files": 0, "skipped": 0, "exchanges": 0, "chunks": 0})
    return out.orderBy(F.col("section") != "all", "section", F.when(F.col("section") == "project", -F.col("exchanges")), "name")


def enriched_share(chunks: DataFrame, mark: str, seconds: float | None = None) -> DataFrame:
    """One row: chunks, those with a non-empty ``mark``, whole percent of them, and chunks a second if timed."""
    done = F.count_if(F.coalesce(F.col(mark), F.lit("")) != "")
    out = chunks.agg(F.count("*").alias("total"), done.alias("enriched"), (done * 100 / F.greatest(F.count("*"), F.lit(1))).cast("long").alias("percent"))
    return out if seconds is None else out.withColumn("per_second", F.round(F.col("enriched") / F.lit(max(seconds, 1e-9)), 2))


def queue_summary(queue: DataFrame) -> DataFrame:
    """One row about a queue: projects by state, percent done, last success and last attempt (null: none)."""
    state = F.coalesce("status", F.lit("pending"))
    total, done = F.count("*"), F.count_if(state == "done")
    return queue.agg(
        total.alias("total"), *[F.count_if(state == s).alias(s) for s in ("pending", "running", "retry", "done")], F.coalesce(F.round(100 * done / F.nullif(total, F.lit(0)), 1), F.lit(0.0)).alias("percent_done"),
        F.nullif(F.max("last_success_at"), F.lit(0.0)).alias("last_success_at"), F.nullif(F.max("last_attempt_at"), F.lit(0.0)).alias("last_attempt_at"),
    )


def project_stats(chunks: DataFrame, projects: DataFrame) -> DataFrame:
    """Chunks, files and last change of every configured project; those without chunks are pending."""
    found = chunks.groupBy("project_name").agg(F.count("*").alias("chunks"), F.countDistinct("file_path").alias("files"), F.max("updated_at").alias("updated_at"))
    return projects.join(found, "project_name", "left").na.fill(0, ["chunks", "files"]).withColumn("state", F.when(F.col("chunks") > 0, "indexed").otherwise("pending"))


def gaps(indexed: DataFrame, covered: DataFrame, key: str) -> DataFrame:
    """The keys that are indexed and that no covering record has."""
    return indexed.select(key).distinct().join(covered.select(key).distinct(), key, "left_anti")


def last_value(table: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Each key's value in the last row by ``order``, ties to the larger value."""
    return table.groupBy(key).agg(F.max_by(value, F.struct(order, value)).alias(value))


def top_frequent(table: DataFrame, column: str, n: int = 10) -> DataFrame:
    return table.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc(column)).limit(n)


def inventory(files: DataFrame, samples: int = 8) -> DataFrame:
    """Counts and sizes of files by source, without their contents.

    ``files`` has source, path, length and modified. A secret-named file is counted and is
    neither a candidate nor a sample.
    """
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    secret = name.rlike(fixed.SECRET_PATH)
    candidate = ~secret & (suffix.isin(fixed.SESSION_SUFFIXES) | name.rlike(fixed.SESSION_NAME))
    rows = files.withColumn("suffix", suffix).withColumn("candidate", candidate)
    return rows.groupBy("source").agg(
        F.count("*").alias("files"), F.count_if(F.col("suffix") == "jsonl").alias("jsonl"), F.count_if(F.col("suffix").isin("sqlite", "sqlite3", "db", "vscdb")).alias("sqlite"),
        F.sum("length").alias("bytes"), F.max("modified").alias("last_modified"), F.count_if("candidate").alias("candidates"),
        F.slice(F.array_sort(F.collect_set(F.when(F.col("candidate"), F.col("path")))), 1, samples).alias("samples"),
    )


def dashboard(queue: DataFrame) -> DataFrame:
    """Projects of a queue by status, with the share that is done."""
    total = queue.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "done").alias("done"))
    by = queue.groupBy("status").agg(F.count("*").alias("n"), F.max("last_success_at").alias("last_success_at"))
    return by.crossJoin(F.broadcast(total)).withColumn("percent_done", F.round(100 * F.col("done") / F.col("total"), 1)).drop("done", "total")  # one row


def next_in_queue(queue: DataFrame) -> DataFrame:
    """The project to run: running before retry before pending, fewest attempts, longest idle."""
    rank = F.when(F.col("status") == "running", 0).when(F.col("status") == "retry", 1).otherwise(2)
    return queue.where("status <> 'done'").orderBy(rank, "attempts", F.coalesce("last_attempt_at", F.lit(0.0)), "name").limit(1)


def age_days(moment: Column, as_of: Column) -> Column:
    return F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(moment)) / 86400)


def stale(records: DataFrame, as_of: str, days: int) -> DataFrame:
    """Records never reviewed, reviewed at no readable time, or ``days`` ago or more."""
    at = F.try_to_timestamp(F.expr("nullif(reviewed_at, '')"))
    return records.where(at.isNull() | (age_days(at, F.lit(as_of).cast("timestamp")) >= days))


def arg_max(table: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key by ``order``."""
    return table.withColumn("r_", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("r_ = 1").drop("r_")


def longest_prefix(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """Each path with the longest root that it begins with; roots are a small configuration.

    A root matches on whole path parts, so a path meets it under one of its own prefixes:
    an equi-join on prefixes, with no comparison of every path with every root.
    """
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    met = paths.withColumn("root", F.explode(prefixes)).join(roots, "root")
    best = met.groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    return paths.join(best, "path", "left")
