"""Files as tables: walks, texts, session logs, inventories, SQLite databases, notes."""

from __future__ import annotations

import base64
import json
import re
import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..plans.session import ship
from .lines import MOST_BLOCKS, blocks_at_most, numbered_lines

BLOCKS = "array<struct<type:string,text:string,id:string,name:string,input:string,thinking:string>>"


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, length, modified) of all files below ``root``; no content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return found.select("path", "length", F.col("modificationTime").alias("modified"))


def texts(spark: SparkSession, root: str, pattern: str = "*", strict: bool = True) -> DataFrame:
    """(path, content, content_hash, error) of text files; with ``strict`` undecodable ones have an error and no content."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    decoded = F.col("content").cast("string")
    valid = F.is_valid_utf8(decoded)
    content = F.when(valid, decoded) if strict else F.make_valid_utf8(decoded)
    return found.select("path", content.alias("content"), F.sha2("content", 256).alias("content_hash"), F.when(~valid & F.lit(strict), "not UTF-8").alias("error"))


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether a path meets a pattern: with a slash as itself or its prefix, else as name or any part."""
    out = F.lit(False)
    for p in patterns:
        out = out | (((path == p.rstrip("/")) | F.startswith(path, F.lit(p.rstrip("/") + "/"))) if "/" in p else F.array_contains(F.split(path, "/"), p))
    return out


def relative(path: Column, root: str) -> Column:
    """A file's path below ``root``, whatever scheme Spark puts before it."""
    return F.regexp_replace(path, rf"^[a-z]*:?/*{re.escape(root.strip('/'))}/", "")


def project_files(spark: SparkSession, root: str, ignore: list[str]) -> DataFrame:
    """The text files of a project that nothing ignores: path, content, hash, language and kind."""
    rows = texts(spark, root, strict=False).withColumn("file_path", relative(F.col("path"), root)).where(~ignored(F.col("file_path"), ignore))
    language = text.language_of(F.col("path"))
    kind = F.when(F.lower("path").endswith(".md"), "markdown").when(language != "unknown", "code").otherwise("other")
    return rows.withColumn("language", language).withColumn("kind", kind).where("kind <> 'other'")


def _agent(path: Column) -> Column:
    return F.when(path.contains("/_codex/") | path.contains("/.codex/"), "codex").when(path.contains("/.claude/"), "claude").when(path.contains("windsurf"), "windsurf").otherwise("unknown")


def _said(content: Column) -> Column:
    """The text of message content that is a string or a list of blocks."""
    blocks = F.from_json(content, BLOCKS)
    joined = F.array_join(F.filter(F.transform(blocks, lambda b: b["text"]), lambda t: t.isNotNull() & (F.trim(t) != "")), "\n")
    return F.when(F.startswith(F.ltrim(content), F.lit("[")) & blocks.isNotNull(), joined).otherwise(content)


def of_main_agent(path: Column) -> Column:
    """Whether a log is a main agent's own: not below ``subagents/``, not of an ``agent-*`` file."""
    return ~path.contains("/subagents/") & ~F.element_at(F.split(path, "/"), -1).startswith("agent-")


def log_paths(spark: SparkSession, root: str) -> DataFrame:
    """The paths of the main agents' logs below ``root``, as ``session_logs`` names them; reads none, lists no empty file."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(root)
    return found.select(F.col("_metadata.file_path").alias("path")).where(of_main_agent(F.col("path")))


def newest_files(listed: DataFrame, limit: int) -> DataFrame:
    """The files of a listing that changed last, newest first, ties by path."""
    return listed.orderBy(F.desc("modified"), "path").limit(limit)


def prompt_files(listed: DataFrame) -> DataFrame:
    """Main agents' logs of a listing in the order of their lower-case paths."""
    return listed.where(of_main_agent(F.col("path"))).orderBy(F.lower("path"), "path")


def session_logs(spark: SparkSession, root: str, agents_too: bool = False) -> DataFrame:
    """Lines of JSON session logs as messages, with their line numbers; malformed lines are skipped.

    Columns: path, session_id, line, role, content, tools, tool_errors, thinking, timestamp,
    agent, project. Logs under ``subagents/`` and of ``agent-*`` files are left out unless
    ``agents_too``. The session is the first one that a file names, else the file's stem.
    A file of any size is read in splits.
    """
    lines = numbered_lines(spark, root, "*.jsonl", None if agents_too else of_main_agent(F.col("path"))).withColumnRenamed("value", "raw").where("trim(raw) <> ''")
    get = lambda p: F.get_json_object("raw", p)
    kind = F.coalesce(get("$.type"), F.lit(""))
    role = F.when(kind == "message", F.coalesce(get("$.role"), F.lit(""))).otherwise(kind)
    content = F.coalesce(get("$.message.content"), get("$.content"), get("$.summary"))
    valid = lines.where(F.try_parse_json("raw").isNotNull()).select("path", "line", role.alias("role"), content.alias("body"), get("$.timestamp").alias("timestamp"), get("$.sessionId").alias("named"), F.coalesce(get("$.is_error").cast("boolean"), F.lit(False)).alias("is_error"))
    blocks = F.from_json("body", BLOCKS)
    tools = F.transform(F.filter(blocks, lambda b: b["type"] == "tool_use"), lambda b: b["name"])
    rows = valid.select(
        "path", "line", "role", _said(F.col("body")).alias("content"), "timestamp", "named", F.coalesce(tools, F.array().cast("array<string>")).alias("tools"),
        F.coalesce(F.exists(blocks, lambda b: b["type"] == "thinking"), F.lit(False)).alias("thinking"), ((F.col("role") == "tool_result") & F.col("is_error")).cast("int").alias("tool_errors"),
    )
    first = rows.groupBy("path").agg(F.min_by("named", F.when(F.coalesce("named", F.lit("")) != "", F.col("line"))).alias("named"))
    if blocks_at_most(spark, root, "*.jsonl") <= MOST_BLOCKS:
        first = F.broadcast(first)  # a row a file
    stem = F.regexp_extract("path", r"([^/]+)\.jsonl$", 1)
    named = rows.drop("named").join(first, "path").withColumn("session_id", F.coalesce("named", stem)).drop("named")
    return named.withColumn("agent", _agent(F.col("path"))).withColumn("project", text.project_of(F.col("path")))


def databases(spark: SparkSession, root: str, pattern: str = "*.sqlite") -> DataFrame:
    """(path, table, row_no, row): the rows of SQLite files as JSON, without secret-named columns.

    A database is opened from its bytes in the task that reads it, so it may lie in any store.
    """
    ship(spark)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in frame.itertuples(index=False):
                base = sqlite3.connect(":memory:")
                base.deserialize(bytes(content))
                names = [r[0] for r in base.execute("select name from sqlite_master where type = 'table' and name not like 'sqlite_%' order by name")]
                for name in names:
                    quoted = '"' + name.replace('"', '""') + '"'
                    columns = [r[1] for r in base.execute(f"pragma table_info({quoted})") if not re.search(fixed.SECRET_NAME, r[1])]
                    listed = ", ".join('"' + c.replace('"', '""') + '"' for c in columns) or "null"
                    rows = base.execute(f"select {listed} from {quoted} order by rowid")
                    no = 0
                    while part := rows.fetchmany(1000):
                        plain = [{c: base64.b64encode(v).decode() if isinstance(v, bytes) else v for c, v in zip(columns, r, strict=False)} for r in part]
                        yield pd.DataFrame({"path": path, "table": name, "row_no": range(no + 1, no + 1 + len(part)), "row": [json.dumps(r) for r in plain]})
                        no += len(part)
                base.close()

    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "content")
    return found.mapInPandas(run, "path string, table string, row_no long, row string")


def thread_rows(rows: DataFrame) -> DataFrame:
    """Rows of log tables as messages of threads, redacted; rows without a thread are their own."""
    get = lambda *names: F.coalesce(*[F.expr(f"nullif(get_json_object(row, '$.{n}'), '')") for n in names])
    body = get("feedback_log_body", "body", "message", "content", "text")
    clean = text.redact(body)
    thread = F.coalesce(get("thread_id", "conversation_id", "session_id"), F.concat_ws("-", "table", F.lit("row"), F.col("row_no").cast("string")))
    return rows.where(body.isNotNull()).select("path", thread.alias("thread_id"), "row_no", clean.alias("content"), get("created_at", "timestamp", "ts").alias("timestamp"), (clean != body).alias("redacted"))


def stored_items(rows: DataFrame, key: str) -> DataFrame:
    """(path, thread_id, title, position, role, content): chat threads in a key-value table of JSON.

    The value maps accounts to maps of threads, each with a title and a history.
    """
    item = rows.where(F.get_json_object("row", "$.key") == key).select("path", F.get_json_object("row", "$.value").alias("v"))
    thread = "struct<id:string,title:string,history:array<struct<entity:string,markdownText:string,text:string>>>"
    accounts = item.select("path", F.explode(F.from_json("v", f"map<string,map<string,{thread}>>")).alias("account", "threads"))
    each = accounts.select("path", F.explode("threads").alias("k", "t")).select("path", F.coalesce("t.id", "k").alias("thread_id"), "t.title", F.posexplode("t.history").alias("position", "h"))
    return each.select("path", "thread_id", "title", "position", F.lower("h.entity").alias("role"), F.coalesce(F.expr("nullif(h.markdownText, '')"), "h.text").alias("content"))


def thoughts(rows: DataFrame, since: str | None = None) -> DataFrame:
    """Chunks of records of a remote store, as its JSON dump has them (id, content, metadata, created_at), newest first."""
    rows = rows if since is None else rows.where(F.col("created_at") >= since)
    kind = F.get_json_object("metadata", "$.type")
    trust = F.when(kind.isin("decision", "reference"), "T2").when(kind.isin("observation", "task", "idea"), "T3").otherwise("T4")
    project = F.coalesce(F.get_json_object("metadata", "$.topics[0]"), F.lit(""))
    return rows.select(F.concat(F.lit(fixed.THOUGHT_ID), F.col("id").cast("string"), F.lit("_0")).alias("chunk_id"), F.concat(F.lit(fixed.THOUGHT_PATH), F.col("id").cast("string")).alias("file_path"), "content", trust.alias("trust_level"), project.alias("project"), "created_at").orderBy(F.desc("created_at"), "chunk_id")


def enrichment_files(spark: SparkSession, root: str) -> DataFrame:
    """Enrichment of exchanges, one JSON document a file; files that begin with _ are left out."""
    schema = "exchange_id string, session_id string, line_start int, line_end int, archive_path string, summary string, category string, intent string, topics string, technologies string, outcome string, complexity string"
    rows = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(root).withColumn("file", F.col("_metadata.file_path"))
    alternate = text.exchange_id(F.col("archive_path"), F.col("line_start"), F.col("line_end"))
    return rows.where(~F.element_at(F.split("file", "/"), -1).startswith("_")).withColumn("alternate_id", alternate)


def schemas(rows: DataFrame) -> DataFrame:
    """Tables of SQLite files: how many rows each has and which columns, as ``databases`` shows them."""
    return rows.groupBy("path", "table").agg(F.count("*").alias("rows"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.json_object_keys("row"))))).alias("columns"))


def log_summary(rows: DataFrame) -> DataFrame:
    """Of each log table: rows, threads, first and last time, and rows with a body."""
    get = lambda *names: F.coalesce(*[F.expr(f"nullif(get_json_object(row, '$.{n}'), '')") for n in names])
    moment = get("created_at", "timestamp", "ts")
    return rows.groupBy("path", "table").agg(F.count("*").alias("rows"), F.countDistinct(get("thread_id", "conversation_id", "session_id")).alias("threads"), F.min(moment).alias("first"), F.max(moment).alias("last"), F.count_if(get("feedback_log_body", "body", "message", "content", "text").isNotNull()).alias("with_body"))


def episodes(rows: DataFrame) -> DataFrame:
    """Exchanges of an episodic store (tables exchanges and tool_calls) with their tools, by time."""
    get = lambda n: F.get_json_object("row", f"$.{n}")
    own = rows.where("table = 'exchanges'").select(*[get(n).alias(n) for n in ("id", "project", "timestamp", "user_message", "assistant_message", "session_id")])
    tools = rows.where("table = 'tool_calls'").groupBy(get("exchange_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set(get("tool_name"))), ",").alias("tool_names"), F.count("*").alias("tool_count"), F.count_if(get("is_error").isin("1", "true")).alias("tool_error_count"))
    return own.join(tools, "id", "left").na.fill({"tool_names": "", "tool_count": 0, "tool_error_count": 0}).orderBy("timestamp", "id")


def resolved(asked: DataFrame, known: DataFrame, roots: list[str]) -> DataFrame:
    """(asked, path): the first of the candidate roots under which each asked path is known."""
    tries = F.array(*[F.struct(F.lit(i).alias("no"), F.concat(F.lit(r), "asked").alias("path")) for i, r in enumerate(["", *[f"{r.rstrip('/')}/" for r in roots]])])
    met = asked.select("asked", F.explode(tries).alias("t")).select("asked", "t.no", "t.path").join(known.select("path"), "path")
    return asked.join(met.groupBy("asked").agg(F.min_by("path", "no").alias("path")), "asked", "left")


def session_file(listed: DataFrame, session_id: str) -> DataFrame:
    """The first file, by path, whose name holds a session's id."""
    return listed.where(F.element_at(F.split("path", "/"), -1).contains(session_id)).orderBy("path").limit(1)


#: Where assistants on one machine keep their histories, below the home folder.
KNOWN_SOURCES = {"claude": ".claude/projects", "codex": ".codex/sessions", "codex-logs": ".codex/log", "windsurf": ".codeium/windsurf", "antigravity": ".gemini/antigravity", "gemini": ".gemini/tmp", "vscode": ".config/Code/User/globalStorage", "cursor": ".config/Cursor/User/globalStorage", "archive": "conversation-archive"}


def local_sources(spark: SparkSession, home: str) -> DataFrame:
    """(source, path, length, modified) of the files of all known sources below ``home``.

    Each source is listed from its own folder, as Spark leaves out hidden folders below one.
    """
    found = spark.createDataFrame([], "path string, length long, modified timestamp, source string")
    for name, folder in KNOWN_SOURCES.items():
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{home}/{folder}")
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            found = found.unionByName(listing(spark, at.toString()).withColumn("source", F.lit(name)))
    return found
