"""Queries of the audits and listings on the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audits, conversations
from ..sources import files
from . import bridge
from .bridge import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    """Register a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


@query("""
WITH l AS (SELECT doc_id, coalesce(lang, '-') AS agent, coalesce(source, '-') AS project, 1 + len(string_split(line, ' ')) // 100 AS chunks
  FROM (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> '')
SELECT 'all' AS section, '' AS name, count(DISTINCT doc_id) AS files, (SELECT count(DISTINCT doc_id) FROM documents) - count(DISTINCT doc_id) AS skipped, count(*) AS exchanges, coalesce(sum(chunks), 0)::BIGINT AS chunks FROM l
UNION ALL SELECT 'agent', agent, count(DISTINCT doc_id), 0, count(*), sum(chunks)::BIGINT FROM l GROUP BY agent
UNION ALL SELECT 'project', project, count(DISTINCT doc_id), 0, count(*), sum(chunks)::BIGINT FROM l GROUP BY project""")
def import_summary(spark, d):
    """Documents as session files, lines as exchanges, a chunk for each hundred words begun."""
    docs = table(spark, d, "documents").withColumnRenamed("doc_id", "path")
    lines = docs.select("path", F.col("lang").alias("agent"), F.col("source").alias("project"), F.explode(F.split("text", "\n")).alias("line")).where("trim(line) <> ''")
    return audits.import_summary(docs, lines.withColumn("chunks", 1 + F.floor(F.size(F.split("line", " ")) / 100)))


_RECORDS = """(SELECT doc_id, source, CASE WHEN toxic = 1 THEN 'superseded' WHEN quality = 0 THEN 'archived' ELSE 'active' END AS status,
  regexp_extract(coalesce(text, ''), '[0-9]{3}') AS linked_note, regexp_extract(coalesce(text, ''), '@[a-z]+') AS superseded_by, regexp_extract(coalesce(text, ''), '[A-Z]{4}') AS reviewed_at
  FROM documents LEFT JOIN labels USING (doc_id))"""


@query(f"""
SELECT * FROM (SELECT count(*) FILTER (status = 'active') AS active_records, count(*) FILTER (status = 'archived') AS archived_records, count(*) FILTER (status = 'superseded') AS superseded_records,
  count(*) FILTER (linked_note <> '') AS records_with_note, count(*) FILTER (reviewed_at = '') AS records_never_reviewed, count(*) FILTER (status = 'superseded' AND superseded_by = '') AS superseded_by_nothing FROM {_RECORDS}),
 (SELECT count(*) FILTER (r <> '') AS notes_with_record, count(*) FILTER (r = '' AND role = 'assistant') AS notes_to_promote FROM (SELECT role, regexp_extract(coalesce(text, ''), '[a-z]+ing') AS r FROM conversations)),
 (SELECT count(DISTINCT source) AS projects_without_record FROM documents WHERE source NOT IN (SELECT source FROM {_RECORDS} WHERE linked_note <> '' AND status = 'active' AND source IS NOT NULL))""")
def semantic_audit(spark, d):
    """Documents as records, whose links stand in their texts; conversation rows as notes."""
    found = lambda pattern: F.regexp_extract(F.coalesce("text", F.lit("")), pattern, 0)
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    status = F.when(F.col("toxic") == 1, "superseded").when(F.col("quality") == 0, "archived").otherwise("active")
    records = docs.select("source", status.alias("status"), found("[0-9]{3}").alias("linked_note"), found("@[a-z]+").alias("superseded_by"), found("[A-Z]{4}").alias("reviewed_at"))
    notes = table(spark, d, "conversations").select((F.col("role") == "assistant").alias("confirmed"), found("[a-z]+ing").alias("linked_record"))
    uncovered = audits.gaps(docs.where("source IS NOT NULL"), records.where("linked_note <> '' AND status = 'active'"), "source")
    return audits.semantic_audit(records, notes, uncovered)


@query("""
SELECT o_orderkey AS record_id, o_orderpriority AS record_type, o_custkey::VARCHAR AS project, strftime(o_orderdate, '%Y-%m-%d') AS created, floor((epoch(TIMESTAMP '2030-01-01') - epoch(o_orderdate)) / 86400)::BIGINT AS age_days
FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' ORDER BY age_days DESC, record_id LIMIT 50""")
def review_candidates(spark, d):
    """Open orders as active records, of which the urgent ones have never been reviewed."""
    rows = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("record_id"), F.col("o_orderpriority").alias("record_type"), F.col("o_custkey").cast("string").alias("project"), F.when(F.col("o_orderstatus") == "O", "active").otherwise("archived").alias("status"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"), F.when(F.col("o_orderpriority") != "1-URGENT", "2029-01-01").alias("reviewed_at"),
    )
    return audits.review_candidates(rows, "2030-01-01")


_PROJECTS = "(SELECT c_custkey AS position, c_name AS name, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'code' ELSE 'notes' END AS kind, CASE WHEN c_acctbal < 0 THEN 'error' ELSE 'registered' END AS state, coalesce(n, 0) AS chunks FROM customer LEFT JOIN (SELECT o_custkey, count(*) FILTER (o_orderpriority = '1-URGENT') AS n FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey)"


@query(f"""
SELECT count(*) AS total_projects, count(*) FILTER (kind = 'code') AS code_projects, count(*) FILTER (kind = 'code' AND chunks > 0) AS indexed, count(*) FILTER (kind = 'code' AND chunks = 0 AND state = 'registered') AS waiting,
  count(*) FILTER (state = 'error') AS errored, coalesce(arg_min(name, position) FILTER (kind = 'code' AND chunks = 0 AND state = 'registered'), '') AS next_project FROM {_PROJECTS}""")
def project_audit(spark, d):
    """Customers as projects and their urgent orders as chunks."""
    chunks = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("position")).agg(F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("chunks"))
    kind, state = F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "code").otherwise("notes"), F.when(F.col("c_acctbal") < 0, "error").otherwise("registered")
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("position"), F.col("c_name").alias("name"), kind.alias("kind"), state.alias("state"))
    return audits.project_audit(rows.join(chunks, "position", "left").na.fill(0, ["chunks"]))


_QUEUE = "(SELECT user_id, max_by(event_type, ts) AS last, max(epoch(ts)) FILTER (event_type = 'purchase')::DOUBLE AS success, max(epoch(ts))::DOUBLE AS attempt FROM events GROUP BY user_id)"


@query(f"""
SELECT count(*) AS total, count(*) FILTER (s = 'pending') AS pending, count(*) FILTER (s = 'running') AS running, count(*) FILTER (s = 'retry') AS retry, count(*) FILTER (s = 'done') AS done,
  round(100.0::DOUBLE * count(*) FILTER (s = 'done') / count(*), 1) AS percent_done, max(success) AS last_success_at, max(attempt) AS last_attempt_at
FROM (SELECT *, CASE last WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'retry' WHEN 'click' THEN 'running' ELSE 'pending' END AS s FROM {_QUEUE})""")
def queue_summary(spark, d):
    """Users as projects in a queue, whose last event says how far they are."""
    at = F.unix_micros("ts") / 1e6
    users = bridge.events(spark, d).groupBy("user_id").agg(F.max_by("event_type", "ts").alias("last"), F.max(F.when(F.col("event_type") == "purchase", at)).alias("last_success_at"), F.max(at).alias("last_attempt_at"))
    state = F.when(F.col("last") == "purchase", "done").when(F.col("last") == "error", "retry").when(F.col("last") == "click", "running")
    return audits.queue_summary(users.withColumn("status", state))


@query("SELECT count(*) AS total, count(*) FILTER (m <> '') AS enriched, 100 * count(*) FILTER (m <> '') // greatest(count(*), 1) AS percent FROM (SELECT regexp_extract(coalesce(text, ''), '@[a-z]+') AS m FROM documents)")
def enriched_share(spark, d):
    """Documents as chunks, enriched where their text holds a mention."""
    return audits.enriched_share(table(spark, d, "documents").select(F.regexp_extract("text", "@[a-z]+", 0).alias("mention")), "mention")


@query("""
WITH s AS (SELECT user_id::VARCHAR AS session_id, count(*) AS exchange_count, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_timestamp FROM events GROUP BY user_id)
SELECT *, (SELECT count(*) FROM s) AS total FROM s ORDER BY last_timestamp DESC, session_id LIMIT 20""")
def latest_sessions(spark, d):
    """The twenty latest sessions of events and how many there are."""
    rows = bridge.events(spark, d).select(F.col("user_id").cast("string").alias("session_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.lit("").alias("tool_names"), *[F.lit("").alias(c) for c in ("project", "category", "summary")])
    return conversations.latest_sessions(rows, 20).select("session_id", "exchange_count", "last_timestamp", "total")


@query("SELECT conv_id AS session_id, sha256(string_agg('### ' || upper(role[1]) || lower(role[2:]) || chr(10) || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations WHERE turn BETWEEN 1 AND 3 GROUP BY conv_id")
def transcript_range(spark, d):
    """Lines 1 to 3 of every conversation as markdown, whole texts compared by their digest."""
    return conversations.transcript(bridge.messages(spark, d), 1, 3).select("session_id", F.sha2("text", 256).alias("digest"))


@query("SELECT url AS path, length(html)::BIGINT AS modified FROM pages ORDER BY modified DESC, path LIMIT 25")
def newest_files(spark, d):
    """The 25 pages of the greatest length, which stands for the time of change."""
    return files.newest_files(table(spark, d, "pages").select(F.col("url").alias("path"), F.length("html").cast("long").alias("modified")), 25)


@query("""
WITH m AS (SELECT conv_id, turn, role, coalesce(text, '') AS t, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS no FROM conversations),
e AS (SELECT conv_id, no, min(turn) AS line_start, sum((t LIKE '%,%')::INT)::BIGINT AS tool_error_count FROM m WHERE no > 0 GROUP BY ALL HAVING bool_or(role IN ('user', 'assistant') AND trim(t) <> '')),
w AS (SELECT conv_id, no, tool, min(turn * 1000000 + pos) AS p FROM (SELECT conv_id, no, turn, unnest(ws) AS tool, generate_subscripts(ws, 1) AS pos FROM (SELECT *, regexp_extract_all(t, '[A-Z][a-z]+') AS ws FROM m WHERE no > 0 AND role = 'assistant')) GROUP BY ALL),
g AS (SELECT conv_id, no, string_agg(tool, ',' ORDER BY p) AS tools FROM w GROUP BY ALL)
SELECT conv_id AS session_id, line_start, tool_error_count, coalesce(tools, '') AS tools FROM e LEFT JOIN g USING (conv_id, no)""")
def exchange_tools(spark, d):
    """Exchanges with tools in the order of their first use (capitalised words stand for calls, commas for errors)."""
    said = F.coalesce("content", F.lit(""))
    called = F.when(F.col("role") == "assistant", F.regexp_extract_all(said, F.lit("[A-Z][a-z]+"), F.lit(0))).otherwise(F.array().cast("array<string>"))
    rows = bridge.messages(spark, d).withColumn("tools", called).withColumn("tool_errors", said.contains(",").cast("int"))
    return conversations.exchanges(rows).select("session_id", "line_start", "tool_error_count", F.array_join("tool_names", ",").alias("tools"))
