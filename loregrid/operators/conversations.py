"""Conversations: exchanges from messages, their texts, sessions, enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def exchanges(messages: DataFrame) -> DataFrame:
    """One row for each user message and what follows it up to the next.

    ``messages`` has session_id, line, role and content, and may have tools (the names that
    a message calls) and tool_errors. Messages before the first user message are dropped,
    and so are exchanges without any text. line_end includes lines of other roles.
    """
    order = Window.partitionBy("session_id").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = messages.withColumn("no", F.sum((F.col("role") == "user").cast("int")).over(order)).where("no > 0")
    said = lambda role: F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("role") == role) & (F.trim(F.coalesce("content", F.lit(""))) != ""), F.struct("line", "content")))), lambda x: x["content"]), "\n")
    tools = [F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.size("tools") > 0, F.struct("line", "tools")))), lambda x: x["tools"]))).alias("tool_names")] if "tools" in messages.columns else []
    errors = [F.sum(F.coalesce("tool_errors", F.lit(0))).alias("tool_error_count")] if "tool_errors" in messages.columns else []
    grouped = numbered.groupBy("session_id", "no").agg(F.min("line").alias("line_start"), F.max("line").alias("line_end"), said("user").alias("user_message"), said("assistant").alias("assistant_message"), F.count("*").alias("n_messages"), *tools, *errors)
    return grouped.where("user_message <> '' OR assistant_message <> ''").withColumn("exchange_id", text.exchange_id(F.col("session_id").cast("string"), F.col("line_start"), F.col("line_end")))


def embedding_text(summary: Column, user: Column, assistant: Column, tools: Column) -> Column:
    """What of an exchange is embedded: with a summary the enriched layout, else the plain one."""
    label = lambda name, value, most=None: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{name}: "), F.substring(value, 1, most) if most else value))
    plain = F.concat_ws("\n\n", label("User", user), label("Assistant", assistant), label("Tools", tools))
    rich = F.concat_ws("\n\n", label("Summary", summary), label("User", user, 800), label("Assistant", assistant, 800), label("Tools", tools))
    return F.when(F.coalesce(summary, F.lit("")) != "", rich).otherwise(plain)


def tool_results(uses: DataFrame, results: DataFrame) -> DataFrame:
    """Tool uses with their results by id within an exchange; a use without one has none."""
    own = results.select("exchange_id", "tool_use_id", F.substring(F.regexp_replace("result", "</?result>", ""), 1, 500).alias("result"), "is_error")
    return uses.join(own, ["exchange_id", "tool_use_id"], "left").withColumn("is_error", F.coalesce("is_error", F.lit(False)))


def enriched(found: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Exchanges with their enrichment by id or, failing that, by session and start; last file wins."""
    last = Window.partitionBy("key").orderBy(F.desc("file"))
    keys = enrichment.withColumn("key", F.explode(F.array_distinct(F.filter(F.array("exchange_id", "alternate_id"), lambda x: x.isNotNull()))))
    one = keys.withColumn("r", F.row_number().over(last)).where("r = 1").select(F.col("key").alias("exchange_id"), "summary", "category", "intent")
    return found.join(one, "exchange_id", "left")


def sessions(found: DataFrame) -> DataFrame:
    """Sessions: exchanges, first and last time, first non-empty texts, distinct tools, newest first."""
    first = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("timestamp"))).alias(c)
    tools = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.filter(F.transform(F.split(F.coalesce("tool_names", F.lit("")), ","), lambda x: F.trim(x)), lambda t: t != ""))))).alias("tools")
    return found.where("coalesce(session_id, '') <> ''").groupBy("session_id").agg(F.count("*").alias("exchange_count"), F.min(F.expr("nullif(timestamp, '')")).alias("first_timestamp"), F.max("timestamp").alias("last_timestamp"), first("project"), first("category"), first("summary"), tools)


def latest_sessions(found: DataFrame, limit: int) -> DataFrame:
    """The sessions of ``sessions`` with the latest last times, one at least, and in ``total`` how many there are.

    Ties go to the smaller session_id; sessions without a time come last.
    """
    known = sessions(found)
    total = known.agg(F.count("*").alias("total"))  # one row
    return known.orderBy(F.desc_nulls_last("last_timestamp"), "session_id").limit(max(limit, 1)).crossJoin(F.broadcast(total))


def packed(blocks: DataFrame, most: int) -> DataFrame:
    """The blocks of each session, in order, that fit into ``most`` characters.

    The first block that does not fit is cut to what is left if that is over 500 characters.
    """
    order = Window.partitionBy("session_id").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = blocks.withColumn("total", F.sum(F.length("block")).over(order)).withColumn("left", most - (F.col("total") - F.length("block")))
    ordered = Window.partitionBy("session_id").orderBy("position")
    over = run.withColumn("overs", F.sum((F.col("total") > most).cast("int")).over(ordered))
    kept = over.where("overs = 0 OR (overs = 1 AND left > 500)")
    return kept.withColumn("block", F.when(F.col("overs") == 0, F.col("block")).otherwise(F.expr("substring(block, 1, left)"))).drop("total", "left", "overs")


def transcript(messages: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """(session_id, text): a session as markdown, a heading for each message; of a range of lines, ends included."""
    if start is not None:
        messages = messages.where(F.col("line") >= start)
    if end is not None:
        messages = messages.where(F.col("line") <= end)
    line = F.concat(F.lit("### "), F.initcap("role"), F.lit("\n\n"), F.coalesce("content", F.lit("")))
    return messages.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", line.alias("t")))), lambda x: x["t"]), "\n\n").alias("text"))
