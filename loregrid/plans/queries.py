"""Queries of the retrieval and memory operators on the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import entities, fixed, text
from ..operators import access, audits, cards, chunking, conversations, lifecycle, links, queue, retrieval
from ..sources import files, sinks
from . import bridge
from .bridge import table

QUERIES, ORACLE_SQL = {}, {}
ACCENTS = f"translate(lower(text), '{text.ACCENTED}', '{text.PLAIN}')"
COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


@query(f"SELECT e.vec_id AS chunk_id, round(1 - {COS}, 6) AS distance, row_number() OVER (ORDER BY round(1 - {COS}, 9), e.vec_id)::INTEGER AS rank FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q QUALIFY rank <= 10")
def knn_topk(spark, d):
    return retrieval.nearest(_vectors(spark, d), bridge.query(spark, d)[0], 10).select("chunk_id", F.round("distance", 6).alias("distance"), "rank")


@query(f"SELECT e.vec_id AS chunk_id, e.label, round(1 - {COS}, 6) AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label = 3 ORDER BY round(1 - {COS}, 9), e.vec_id LIMIT 10")
def knn_filtered(spark, d):
    return retrieval.nearest(_vectors(spark, d), bridge.query(spark, d)[0], 10, where=F.col("label") == 3).select("chunk_id", "label", F.round("distance", 6).alias("distance"))


@query(f"SELECT e.label, e.vec_id AS chunk_id, row_number() OVER (PARTITION BY e.label ORDER BY round(1 - {COS}, 9), e.vec_id)::INTEGER AS rank FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q QUALIFY rank <= 3")
def knn_per_group(spark, d):
    return retrieval.nearest(_vectors(spark, d), bridge.query(spark, d)[0], 3, by="label").select("label", "chunk_id", "rank")


_BM25 = f"""
WITH q AS (SELECT DISTINCT lower(w) AS term FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9_#./:-]+')[1:3]) AS w FROM benchmark WHERE item_id = 0)),
d AS (SELECT doc_id, source, lang, regexp_extract_all({ACCENTS}, '[\\p{{L}}\\p{{N}}]+') AS ws FROM documents),
s AS (SELECT count(*) AS total, avg(len(ws)) AS mean FROM d),
p AS (SELECT doc_id, term, count(*) AS f FROM (SELECT doc_id, unnest(ws) AS term FROM d) JOIN q USING (term) GROUP BY ALL),
i AS (SELECT term, count(*) AS n FROM p GROUP BY term),
scored AS (SELECT p.doc_id, d.source, d.lang, round(-sum((CASE WHEN ln((total - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((total - n + 0.5) / (n + 0.5)) END) * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * len(ws) / mean))), 6) AS bm25
  FROM p JOIN i USING (term) JOIN d USING (doc_id), s GROUP BY ALL)
"""


def _chunks(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), "source", "lang")


def _phrases(spark, d):
    return retrieval.query_phrases(bridge.query(spark, d)[1])


@query(_BM25 + "SELECT doc_id, bm25 FROM scored ORDER BY bm25, doc_id LIMIT 20")
def bm25_topk(spark, d):
    return bridge.keyword_index(spark, d).top(_phrases(spark, d), 20).select(F.col("chunk_id").alias("doc_id"), "bm25")


@query(_BM25 + "SELECT doc_id, bm25 FROM scored WHERE source = 'src1' ORDER BY bm25, doc_id LIMIT 10")
def bm25_filtered(spark, d):
    return bridge.keyword_index(spark, d).top(_phrases(spark, d), 10, F.col("collection") == "src1").select(F.col("chunk_id").alias("doc_id"), "bm25")


@query(_BM25 + "SELECT lang, doc_id, round(1.0::DOUBLE / row_number() OVER (PARTITION BY lang ORDER BY bm25, doc_id), 6) AS keyword_score FROM scored QUALIFY row_number() OVER (PARTITION BY lang ORDER BY bm25, doc_id) <= 5")
def bm25_per_lang(spark, d):
    phrases = _phrases(spark, d)
    hits = retrieval.keyword_search(_chunks(spark, d), phrases, 5, by="lang", scores=bridge.matches(spark, d, phrases))
    return hits.select("lang", F.col("chunk_id").alias("doc_id"), F.round(1 / (1 + F.col("rank0")), 6).alias("keyword_score"))


@query(f"WITH d AS (SELECT doc_id, regexp_extract_all({ACCENTS}, '[\\p{{L}}\\p{{N}}]+') AS ws FROM documents) SELECT doc_id, count(*) AS f FROM (SELECT doc_id, unnest(range(1, len(ws))) AS i, ws FROM d) WHERE ws[i] = 'of' AND ws[i + 1] = 'the' GROUP BY doc_id")
def phrase_match(spark, d):
    """Documents in which the two words of a phrase stand next to each other, from stored positions."""
    return bridge.keyword_index(spark, d).phrase_counts(["of", "the"]).select(F.col("chunk_id").alias("doc_id"), "f")


_HYBRID = _BM25 + f""",
c AS (SELECT doc_id AS chunk_id, source AS collection, CASE quality WHEN 1 THEN 1.0 WHEN 0 THEN 0.85 ELSE 0.7 END::DOUBLE AS trust, coalesce(toxic, 0) <> 1 AS active FROM documents LEFT JOIN labels USING (doc_id)),
v AS (SELECT collection, chunk_id, greatest(0, least(1, 1 - dist / 2)) AS vector_score FROM (SELECT collection, chunk_id, round(1 - {COS}, 9) AS dist FROM embeddings e JOIN c ON c.chunk_id = e.vec_id, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE active) QUALIFY row_number() OVER (PARTITION BY collection ORDER BY dist, chunk_id) <= 40),
k AS (SELECT source AS collection, doc_id AS chunk_id, 1.0::DOUBLE / row_number() OVER (PARTITION BY source ORDER BY bm25, doc_id) AS keyword_score FROM scored QUALIFY row_number() OVER (PARTITION BY source ORDER BY bm25, doc_id) <= 40),
f AS (SELECT collection, chunk_id, coalesce(vector_score, 0) AS vs, coalesce(keyword_score, 0) AS ks, trust FROM (v FULL JOIN k USING (collection, chunk_id)) JOIN c USING (collection, chunk_id) WHERE active)
"""


def _searched(spark, d, k, threshold, collections=None, rows=None, **filters):
    """A hybrid search with the keywords of the stored index."""
    v, q = bridge.query(spark, d)
    phrases = retrieval.query_phrases(q)
    rows = bridge.chunks(spark, d) if rows is None else rows
    return retrieval.hybrid_search(rows.drop("content"), v, phrases, k, threshold, collections, scores=bridge.matches(spark, d, phrases), **filters).select("collection", "chunk_id", "score")


@query(_HYBRID + "SELECT collection, chunk_id, round((0.7::DOUBLE * vs + 0.3::DOUBLE * ks) * trust, 4) AS score FROM f ORDER BY score DESC, collection, chunk_id LIMIT 10")
def hybrid_search(spark, d):
    return _searched(spark, d, 10, 0.0)


@query(_HYBRID + "SELECT collection, chunk_id, round((0.7::DOUBLE * vs + 0.3::DOUBLE * ks) * trust, 4) AS score FROM f WHERE collection IN ('src1', 'src2') AND (0.7::DOUBLE * vs + 0.3::DOUBLE * ks) * trust >= 0.35 ORDER BY score DESC, collection, chunk_id LIMIT 10")
def hybrid_collections(spark, d):
    return _searched(spark, d, 10, fixed.SCORE_THRESHOLD, ["src1", "src2"])


_KINDS = ["facts", "memory_cards", "documents", "codebase", "discoveries", "conversations"]
_KIND = "CASE source " + " ".join(f"WHEN 'src{i}' THEN '{k}'" for i, k in enumerate(_KINDS)) + " ELSE 'runbooks' END"
_CARD_WEIGHT = " ".join(f"WHEN '{s}' THEN {w}::DOUBLE" for s, w in fixed.CARD_STATUS_WEIGHTS.items())


def _ruled(name: str, passing: str, sql: str, k: int, threshold: float, collections: list[str] | None = None, **filters) -> None:
    """A search under a filter, by the rules of each collection; the SQL conditions are (keyword, vector)."""
    asked = "" if collections is None else f" AND collection IN ({', '.join(repr(c) for c in collections)})"
    n = 4 * k
    ORACLE_SQL[name] = _BM25 + f""",
c AS (SELECT doc_id AS chunk_id, {_KIND} AS collection, CASE quality WHEN 1 THEN 1.0 WHEN 0 THEN 0.85 ELSE 0.7 END::DOUBLE AS trust, CASE toxic WHEN 1 THEN 'superseded' ELSE 'active' END AS status, lang AS project, lang || '/p' AS project_name,
  source AS frontmatter_project, CASE quality WHEN 1 THEN 'kept,' ELSE '' END || lang AS tags, lang AS language, CASE quality WHEN 1 THEN 'config' ELSE 'pattern' END AS category, coalesce(quality, 0) = 1 AS confirmed FROM documents LEFT JOIN labels USING (doc_id)),
v AS (SELECT collection, chunk_id, greatest(0, least(1, 1 - dist / 2)) AS vs FROM (SELECT c.*, round(1 - {COS}, 9) AS dist FROM embeddings e JOIN c ON c.chunk_id = e.vec_id, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) WHERE (collection = 'memory_cards' OR status = 'active') AND ({sql}){asked} QUALIFY row_number() OVER (PARTITION BY collection ORDER BY dist, chunk_id) <= {n}),
k AS (SELECT collection, chunk_id, 1.0::DOUBLE / row_number() OVER (PARTITION BY collection ORDER BY bm25, chunk_id) AS ks FROM scored JOIN c ON c.chunk_id = scored.doc_id WHERE ({passing}){asked} QUALIFY row_number() OVER (PARTITION BY collection ORDER BY bm25, chunk_id) <= {n}),
f AS (SELECT collection, chunk_id, (0.7::DOUBLE * coalesce(vs, 0) + 0.3::DOUBLE * coalesce(ks, 0)) * trust * CASE WHEN collection <> 'memory_cards' THEN 1.0::DOUBLE ELSE CASE status {_CARD_WEIGHT} END * 0.95::DOUBLE END AS raw FROM (v FULL JOIN k USING (collection, chunk_id)) JOIN c USING (collection, chunk_id) WHERE status = 'active')
SELECT collection, chunk_id, round(raw, 4) AS score FROM f WHERE raw >= {threshold} ORDER BY score DESC, collection, chunk_id LIMIT {k}"""

    def run(spark, d):
        return _searched(spark, d, k, threshold, collections, bridge.kinds(spark, d), **filters)

    QUERIES[name] = run


_OWN = "CASE collection WHEN 'codebase' THEN project_name ELSE project END = 'en'"
_ruled("memory_card_search", "category = 'config'", "category = 'config'", 8, 0.25, ["memory_cards"], category="config")
_ruled("record_search", _OWN, _OWN, 6, 0.35, ["facts", "runbooks", "project_overviews"], project="en")
_ruled("filter_project", _OWN, "CASE collection WHEN 'codebase' THEN project_name WHEN 'documents' THEN frontmatter_project ELSE project END = 'en'", 10, 0.0, project="en")
_TAGGED = "collection NOT IN ('facts', 'runbooks', 'project_overviews', 'memory_cards', 'documents') OR tags ILIKE '%KEPT%'"
_ruled("filter_tags", _TAGGED, _TAGGED, 10, 0.0, tags=["KEPT", "other"])
_ruled("filter_language", "collection <> 'codebase' OR language = 'en'", "collection <> 'codebase' OR language = 'en'", 10, 0.0, language="en")
_CONFIRMED = "(collection NOT IN ('memory_cards', 'discoveries', 'conversations') OR category = 'config') AND (collection <> 'discoveries' OR confirmed)"
_ruled("filter_confirmed", _CONFIRMED, _CONFIRMED, 10, 0.0, category="config", confirmed=True)


@query("SELECT doc_id, 'Project: ' || lang || chr(10) || 'Type: ' || source || chr(10) || 'Title: ' || substr(text, 1, 80) || chr(10) || 'Status: ' || CASE toxic WHEN 1 THEN 'superseded' ELSE 'active' END || chr(10) || 'Confidence: medium' || chr(10) || 'Current truth: ' || CASE WHEN coalesce(toxic, 0) <> 1 THEN 'True' ELSE 'False' END || chr(10) || 'Tags: ' || lang || ', ' || source || CASE WHEN coalesce(text, '') <> '' THEN chr(10) || 'Body: ' || text ELSE '' END || chr(10) || 'Source: ' || source AS content FROM documents LEFT JOIN labels USING (doc_id)")
def card_text(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    bad = F.coalesce(F.col("toxic"), F.lit(0)) == 1
    made = text.card_text(F.col("lang"), F.col("source"), F.substring("text", 1, 80), F.when(bad, "superseded").otherwise("active"), F.lit("medium"), ~bad, F.concat_ws(",", "lang", "source"), F.col("text"), F.lit(None).cast("string"), F.col("source"))
    return rows.select("doc_id", made.alias("content"))


@query("SELECT doc_id, CASE quality WHEN 1 THEN 1.0 WHEN 0 THEN 0.85 ELSE 0.7 END::DOUBLE AS weight FROM documents LEFT JOIN labels USING (doc_id)")
def trust_weights(spark, d):
    return bridge.chunks(spark, d).select(F.col("chunk_id").alias("doc_id"), text.trust_weight(F.col("trust_level")).alias("weight"))


@query("SELECT doc_id, substr(text, 1, 700) AS preview FROM documents")
def snippets(spark, d):
    return retrieval.snippets(_chunks(spark, d)).select(F.col("chunk_id").alias("doc_id"), "preview")


@query()
def synonym_search(spark, d):
    return bridge.keyword_index(spark, d).top(retrieval.query_phrases("test the", synonyms=True), 20).select(F.col("chunk_id").alias("doc_id"), "bm25")


_EX = """
WITH n AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS no FROM conversations),
x AS (SELECT conv_id AS session_id, no::BIGINT AS no, min(turn) AS line_start, max(turn) AS line_end, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'user' AND trim(text) <> ''), '') AS user_message,
  coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'assistant' AND trim(text) <> ''), '') AS assistant_message, count(*) AS n_messages FROM n WHERE no > 0 GROUP BY ALL),
e AS (SELECT * FROM x WHERE user_message <> '' OR assistant_message <> '')
"""


@query(_EX + "SELECT *, substr(sha256(session_id::VARCHAR || ':' || line_start || '-' || line_end), 1, 32) AS exchange_id FROM e")
def exchanges(spark, d):
    return conversations.exchanges(bridge.messages(spark, d))


@query(_EX + "SELECT session_id, no, 'User: ' || user_message || CASE WHEN assistant_message <> '' THEN chr(10) || chr(10) || 'Assistant: ' || assistant_message ELSE '' END AS text FROM e WHERE user_message <> ''")
def exchange_text(spark, d):
    rows = conversations.exchanges(bridge.messages(spark, d)).where("user_message <> ''")
    return rows.select("session_id", "no", conversations.embedding_text(F.lit(""), F.col("user_message"), F.col("assistant_message"), F.lit("")).alias("text"))


@query("SELECT user_id::VARCHAR AS session_id, count(*) AS exchange_count, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_timestamp, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_timestamp, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS tools FROM events GROUP BY user_id")
def session_summary(spark, d):
    rows = bridge.events(spark, d).select(F.col("user_id").cast("string").alias("session_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.col("event_type").alias("tool_names"), F.lit("p").alias("project"), F.lit("").alias("category"), F.lit("").alias("summary"))
    return conversations.sessions(rows).select("session_id", "exchange_count", "first_timestamp", "last_timestamp", F.array_join("tools", ",").alias("tools"))


@query("SELECT conv_id AS session_id, sum(length('### ' || upper(role[1]) || role[2:] || chr(10) || chr(10) || text))::BIGINT + 2 * (count(*) - 1) AS n FROM conversations GROUP BY conv_id")
def transcripts(spark, d):
    return conversations.transcript(bridge.messages(spark, d)).select("session_id", F.length("text").cast("long").alias("n"))


@query("WITH r AS (SELECT conv_id, turn, text, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS total FROM conversations), o AS (SELECT *, 1500 - (total - length(text)) AS room, sum((total > 1500)::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS overs FROM r) SELECT conv_id AS session_id, turn AS position, length(CASE WHEN overs = 0 THEN text ELSE substr(text, 1, room::BIGINT) END) AS n FROM o WHERE overs = 0 OR (overs = 1 AND room > 500)")
def prompt_pack(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("position"), F.col("text").alias("block"))
    return conversations.packed(rows, 1500).select("session_id", "position", F.length("block").cast("long").alias("n"))


@query("SELECT role, count(*) AS n, grouping(role)::INTEGER AS is_total FROM conversations GROUP BY ROLLUP (role)")
def stats_rollup(spark, d):
    return audits.counts_with_total(table(spark, d, "conversations"), "role")


@query("SELECT 'o_orderstatus' AS dimension, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2")
def audit_grouping_sets(spark, d):
    return audits.counts_by_sets(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


@query("SELECT count(*) AS total, count(*) FILTER (quality = 1) AS current, count(*) FILTER (toxic = 1) AS to_confirm FROM labels")
def conditional_audit(spark, d):
    return audits.card_audit(table(spark, d, "labels").select((F.col("quality") == 1).alias("current_truth"), (F.col("toxic") == 1).alias("needs_confirmation")))


@query("SELECT s.project_name, coalesce(c.chunks, 0) AS chunks, coalesce(c.files, 0) AS files, c.updated_at, CASE WHEN c.chunks > 0 THEN 'indexed' ELSE 'pending' END AS state FROM (SELECT DISTINCT source AS project_name FROM documents UNION ALL SELECT 'none') s LEFT JOIN (SELECT source AS project_name, count(*) AS chunks, count(DISTINCT lang) AS files, max(n_chars) AS updated_at FROM documents WHERE lang <> 'en' GROUP BY 1) c USING (project_name)")
def project_stats(spark, d):
    docs = table(spark, d, "documents")
    projects = docs.select(F.col("source").alias("project_name")).distinct().unionByName(spark.createDataFrame([("none",)], "project_name string"))
    return audits.project_stats(docs.where("lang <> 'en'").select(F.col("source").alias("project_name"), F.col("lang").alias("file_path"), F.col("n_chars").alias("updated_at")), projects)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def coverage_gap(spark, d):
    return audits.gaps(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def existing_ids(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels").where("quality = 1"), "doc_id", "left_semi").select("doc_id", "source")


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def enrichment_join(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).cast("int").alias("quality"))


@query("SELECT url AS path, (SELECT r FROM (VALUES ('https:'), ('https://example.org'), ('http:'), ('http://example.org'), ('https://example.com')) t(r) WHERE url = r OR starts_with(url, r || '/') ORDER BY length(r) DESC LIMIT 1) AS root FROM pages")
def longest_prefix(spark, d):
    roots = spark.createDataFrame([(r,) for r in ("https:", "https://example.org", "http:", "http://example.org", "https://example.com")], "root string")
    return audits.longest_prefix(table(spark, d, "pages").select(F.col("url").alias("path")), roots)


@query("SELECT user_id, max_by(event_type, (ts, event_type)) AS event_type FROM events GROUP BY user_id")
def last_wins(spark, d):
    return audits.last_value(table(spark, d, "events"), "user_id", "event_type", "ts")


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source DESC LIMIT 10")
def topk_projects(spark, d):
    return audits.top_frequent(table(spark, d, "documents"), "source")


@query("SELECT split_part(url, '/', 3) AS source, count(*) AS files, 0::BIGINT AS jsonl, sum(length(html))::BIGINT AS bytes, count(*) FILTER (regexp_matches(lower(split_part(url, '/', -1)), 'session|conversation|chat|transcript|history|rollout|thread|message') AND NOT regexp_matches(lower(split_part(url, '/', -1)), 'secret|token|password|passwd|credential|apikey|api_key|private[_-]?key|auth')) AS candidates FROM pages GROUP BY 1")
def inventory_counts(spark, d):
    listed = table(spark, d, "pages").select(F.split_part("url", F.lit("/"), F.lit(3)).alias("source"), F.col("url").alias("path"), F.length("html").cast("long").alias("length"), F.col("page_id").alias("modified"))
    return audits.inventory(listed).select("source", "files", "jsonl", "bytes", "candidates")


_QUEUE = "(SELECT user_id, CASE user_id % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'running' WHEN 2 THEN 'retry' ELSE 'pending' END AS status, count(*) AS attempts, max(epoch(ts))::DOUBLE AS last_success_at FROM events GROUP BY user_id)"


def _queue(spark, d):
    rows = bridge.events(spark, d).groupBy("user_id").agg(F.count("*").alias("attempts"), F.max(F.unix_micros("ts") / 1e6).alias("last_success_at"))
    status = F.when(F.col("user_id") % 4 == 0, "done").when(F.col("user_id") % 4 == 1, "running").when(F.col("user_id") % 4 == 2, "retry").otherwise("pending")
    return rows.withColumn("status", status).withColumn("name", F.col("user_id").cast("string")).withColumn("last_attempt_at", F.col("last_success_at"))


@query(f"SELECT status, count(*) AS n, round(100.0::DOUBLE * (SELECT count(*) FROM {_QUEUE} WHERE status = 'done') / (SELECT count(*) FROM {_QUEUE}), 1) AS percent_done FROM {_QUEUE} GROUP BY status")
def queue_dashboard(spark, d):
    return audits.dashboard(_queue(spark, d)).drop("last_success_at")


@query(f"SELECT user_id::VARCHAR AS name, status FROM {_QUEUE} WHERE status <> 'done' ORDER BY CASE status WHEN 'running' THEN 0 WHEN 'retry' THEN 1 ELSE 2 END, attempts, last_success_at, name LIMIT 1")
def queue_pick(spark, d):
    return audits.next_in_queue(_queue(spark, d)).select("name", "status")


@query("SELECT event_id FROM events WHERE event_id % 7 = 0 OR floor((epoch(TIMESTAMP '2030-01-01') - floor(epoch(ts))) / 86400) >= 1500")
def stale_days(spark, d):
    rows = bridge.events(spark, d).select("event_id", F.when(F.col("event_id") % 7 == 0, "never").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("reviewed_at"))
    return audits.stale(rows, "2030-01-01 00:00:00", 1500).select("event_id")


@query("SELECT * EXCLUDE (r) FROM (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1")
def identity_argmax(spark, d):
    return audits.arg_max(table(spark, d, "documents").select("doc_id", "source", "n_chars"), "source", F.desc("n_chars"), F.col("doc_id"))


@query("SELECT * EXCLUDE (r) FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) WHERE r <= 5")
def union_limit_per_branch(spark, d):
    docs = table(spark, d, "documents").select("lang", "doc_id")
    return docs.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))).where("r <= 5").drop("r")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE source END AS source FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
def upsert_merge(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return lifecycle.upsert(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 3 = 0").withColumn("source", F.lit("new")), "doc_id")


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'patched' ELSE source END AS source, lang FROM documents WHERE doc_id % 11 <> 0")
def patch_and_delete(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    after = lifecycle.patch(docs, docs.where("doc_id % 5 = 0").select("doc_id", F.lit("patched").alias("source"), F.lit(1).alias("unknown")), "doc_id")
    return lifecycle.delete(after, where=F.col("doc_id") % 11 == 0)


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents s WHERE s.doc_id % 2 = 0 AND s.source = d.source AND s.n_chars = d.n_chars)")
def changed_files(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("file_path"), F.col("n_chars").alias("content_hash"))
    return lifecycle.changed_files(docs, docs.where("doc_id % 2 = 0")).select("doc_id")


_FP = r"sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', ''), '\r\n?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'))"


@query(f"SELECT {_FP} AS fingerprint, count(*) AS n, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def fingerprint_dedupe(spark, d):
    return table(spark, d, "documents").groupBy(text.fingerprint(F.col("text")).alias("fingerprint")).agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"))


@query("SELECT doc_id, substr(sha256(source || '::' || doc_id), 1, 16) AS chunk_id FROM documents")
def chunk_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", text.chunk_id(F.col("source"), F.col("doc_id")).alias("chunk_id"))


_MARKED = "'# ' || source || chr(10) || chr(10) || '## ' || lang || chr(10) || text || chr(10) || 'see [[' || source || '|x]] and [[' || lang || '#part]] #' || lang || ' `#no` #top/' || source"
_LINKS = f"list_sort(list_distinct(list_transform(regexp_extract_all({_MARKED}, '\\[\\[([^\\]|#]+)(?:#[^\\]|]*)?\\|?[^\\]]*\\]\\]', 1), lambda x: trim(x))))"
_TAGS = f"list_sort(list_distinct(regexp_extract_all(regexp_replace(regexp_replace({_MARKED}, '```.*?```', '', 'gs'), '`[^`]+`', '', 'g'), '(?:^|\\s)#([\\w/\\-]+)', 1)))"


@query(f"SELECT doc_id, array_to_string({_LINKS}, ',') AS links, array_to_string({_TAGS}, ',') AS tags FROM documents")
def links_and_tags(spark, d):
    rows = bridge.marked(table(spark, d, "documents"))
    return rows.select("doc_id", F.array_join(text.wiki_links(F.col("content")), ",").alias("links"), F.array_join(text.inline_tags(F.col("content")), ",").alias("tags"))


@query("SELECT target, count(DISTINCT doc_id) AS backlinks FROM (SELECT doc_id, unnest(ARRAY[source, lang]) AS target FROM documents) GROUP BY target")
def backlinks(spark, d):
    rows = bridge.marked(table(spark, d, "documents")).select("doc_id", F.explode(text.wiki_links(F.col("content"))).alias("target"))
    return rows.groupBy("target").agg(F.countDistinct("doc_id").alias("backlinks"))


@query("SELECT doc_id, coalesce(trim(list_filter(string_split(text, chr(10) || chr(10)), lambda b: trim(b) <> '' AND NOT starts_with(ltrim(b), '#') AND NOT starts_with(ltrim(b), '```'))[1]), '') AS paragraph FROM documents")
def first_paragraph(spark, d):
    return table(spark, d, "documents").select("doc_id", text.first_paragraph(F.col("text")).alias("paragraph"))


_NOTED = "'<system-reminder>hidden ' || doc_id || '</system-reminder>' || repeat(chr(10), 4) || 'api_key = abc' || doc_id || 'xyz, mail user' || doc_id || '@example.org' || chr(10) || text"


@query(f"SELECT doc_id, substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_NOTED}, '<system-reminder>.*?</system-reminder>', '', 'gs'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+', ''), '\\s+$', ''), 1, 2000) AS clean FROM documents")
def clean_message(spark, d):
    return bridge.noted(table(spark, d, "documents")).select("doc_id", text.clean_message(F.col("content")).alias("clean"))


_ASSIGN = r"(?i)\b([A-Za-z0-9_.-]*(?:secret|token|password|passwd|credential|api[_-]?key|private[_-]?key|cookie|auth)[A-Za-z0-9_.-]*)\b\s*[:=]\s*([^\s,;`\"'']+)"
_VALUE = fixed.SECRET_VALUE.replace("'", "''")
_REDACT = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({_NOTED}, '{_ASSIGN}', '\\1=[REDACTED]', 'g'), '{_VALUE}', '[REDACTED]', 'g'), '{fixed.EMAIL}', '[EMAIL]', 'g'), '{fixed.PHONE}', '[PHONE]', 'g')"


@query(f"SELECT doc_id, {_REDACT} AS redacted FROM documents")
def redact_text(spark, d):
    return bridge.noted(table(spark, d, "documents")).select("doc_id", text.redact(F.col("content")).alias("redacted"))


@query(f"SELECT doc_id, regexp_matches(text, '{_ASSIGN}') OR regexp_matches(text, '{_VALUE}') AS risky FROM documents")
def credential_flag(spark, d):
    return table(spark, d, "documents").select("doc_id", text.credential_risk(F.col("text")).alias("risky"))


def _rule_sql(column: str) -> str:
    cases = " ".join(f"WHEN {' OR '.join(f'''contains({column}, '{p.replace(chr(39), chr(39) * 2)}')''' for p in phrases)} THEN '{name}'" for name, _, _, phrases in fixed.CARD_RULES)
    return f"CASE {cases} END"


_COMMAND, _PATH = (x.replace("'", "''") for x in (fixed.COMMAND, fixed.FILE_PATH))


@query(f"SELECT item_id, CASE WHEN regexp_matches(t, '{_COMMAND}') THEN 'command' WHEN regexp_matches(t, '{_PATH}') THEN 'file_path' ELSE {_rule_sql('lower(t)')} END AS type FROM (SELECT item_id, text || CASE item_id % 5 WHEN 0 THEN ' we decided so' WHEN 1 THEN ' todo: next step' WHEN 2 THEN ' it failed because of x' WHEN 3 THEN ' see /home/user/x' ELSE '' END AS t FROM benchmark)")
def classify_rules(spark, d):
    tail = F.when(F.col("item_id") % 5 == 0, " we decided so").when(F.col("item_id") % 5 == 1, " todo: next step").when(F.col("item_id") % 5 == 2, " it failed because of x").when(F.col("item_id") % 5 == 3, " see /home/user/x").otherwise("")
    return table(spark, d, "benchmark").select("item_id", text.card_type(F.concat("text", tail)).alias("type"))


@query()
def card_extraction(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.lit("p").alias("project"), "role", F.lit("2026-01-01").alias("date"), F.concat("text", F.lit("\nWe decided to prefer the second schema for item "), F.col("turn").cast("string"), F.lit(" of this conversation.")).alias("content"))
    return cards.cards(rows).select("type", "title", "score", "confidence", "status", "identity")


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))::INTEGER AS tokens FROM documents")
def token_count(spark, d):
    return table(spark, d, "documents").select("doc_id", text.word_count(F.col("text")).alias("tokens"))


@query()
def chunk_windows(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"))
    return chunking.chunk_texts(rows, 200, 40).select("id", "chunk_index", "start_line", "end_line", "tokens")


@query("SELECT doc_id::VARCHAR AS file_path, 1 AS chunk_index, 'heading_section' AS chunk_type, source AS heading_path FROM documents")
def heading_sections(spark, d):
    """Of every file parsed whole, its first section."""
    rows = bridge.marked(table(spark, d, "documents")).select(F.col("doc_id").cast("string").alias("file_path"), F.lit("a/b.md").alias("path"), "content")
    return chunking.markdown_chunks(rows).where("chunk_index = 1").select("file_path", "chunk_index", "chunk_type", "heading_path")


@query()
def heading_chunks(spark, d):
    """Of every file all chunks: its summary and every section, in windows."""
    rows = bridge.marked(table(spark, d, "documents")).select(F.col("doc_id").cast("string").alias("file_path"), F.lit("a/b.md").alias("path"), "content")
    return chunking.markdown_chunks(rows)


@query("SELECT doc_id, 'os,sys.' || source AS modules FROM documents")
def imports_extract(spark, d):
    code = F.concat(F.lit("import os\nfrom sys."), F.col("source"), F.lit(" import x\nimport os\nx = 1\n"))
    return table(spark, d, "documents").select("doc_id", text.imports(code, F.lit("python")).alias("modules"))


@query("SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value FROM events")
def json_props(spark, d):
    m = F.from_json("props", "map<string,string>")
    key = F.get(F.json_object_keys("props"), F.lit(0))
    return table(spark, d, "events").select("event_id", F.element_at(m, key).alias("first_value"))


@query(r"SELECT doc_id, no::INTEGER AS no, line FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS no FROM (SELECT doc_id, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS ls FROM documents)) WHERE no BETWEEN 2 AND 40")
def line_window(spark, d):
    """Lines 2 to 40 of every document, as a search shows what surrounds a hit."""
    lines = chunking.file_lines(table(spark, d, "documents").select(F.col("doc_id").alias("file_path"), F.col("text").alias("content")))
    return chunking.line_window(lines, 2, 39).withColumnRenamed("file_path", "doc_id")


@query("SELECT source, item.t AS tag FROM (SELECT source, unnest(from_json('[{\"t\":\"a\"},{\"t\":\"' || lang || '\"}]', '[{\"t\":\"VARCHAR\"}]')) AS item FROM documents)")
def extraction_explode(spark, d):
    payload = F.concat(F.lit('[{"t":"a"},{"t":"'), F.col("lang"), F.lit('"}]'))
    return table(spark, d, "documents").select("source", F.explode(F.from_json(payload, "array<struct<t:string>>")).alias("i")).select("source", F.col("i.t").alias("tag"))


@query("SELECT note_id, 'T2' AS trust_level, greatest(0.7, 0.9)::DOUBLE AS confidence FROM (SELECT doc_id::VARCHAR AS note_id, doc_id FROM documents) WHERE doc_id % 4 = 0")
def confirm_notes(spark, d):
    return lifecycle.confirm(_notes(spark, d), _notes(spark, d).where("cast(note_id as long) % 4 = 0"), "2026-01-01").where("confirmed").select("note_id", "trust_level", "confidence")


def _notes(spark, d):
    return table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("note_id"), F.col("source").alias("project"), F.when(F.col("lang") == "en", "workaround").when(F.col("lang") == "de", "pattern").otherwise("bug").alias("category"), F.lit("low").alias("severity"), F.col("text").alias("content"),
        F.lit(False).alias("confirmed"), F.lit(False).alias("promoted"), F.lit("T3").alias("trust_level"), F.lit(0.7).alias("confidence"), F.lit("").alias("updated_at"), F.lit("").alias("linked_record"),
    )


@query("SELECT 'semantic_' || k || '_' || substr(sha256(doc_id::VARCHAR), 1, 32) AS record_id, k AS record_type, source AS project, 0.9::DOUBLE AS confidence, doc_id::VARCHAR AS linked_note FROM (SELECT *, CASE lang WHEN 'en' THEN 'runbook' WHEN 'de' THEN 'project_overview' ELSE 'fact' END AS k FROM documents) WHERE doc_id % 4 = 0")
def promote_notes(spark, d):
    notes = lifecycle.confirm(_notes(spark, d), _notes(spark, d).where("cast(note_id as long) % 4 = 0"), "2026-01-01")
    return lifecycle.promote(notes, "2026-01-02")[1].select("record_id", "record_type", "project", "confidence", "linked_note")


@query("SELECT doc_id::VARCHAR AS record_id, CASE WHEN doc_id % 6 = 1 THEN 'superseded' ELSE 'active' END AS status, CASE WHEN doc_id % 6 = 1 THEN (doc_id + 1)::VARCHAR ELSE '' END AS superseded_by FROM documents")
def supersede_records(spark, d):
    docs = table(spark, d, "documents")
    records = docs.select(F.col("doc_id").cast("string").alias("record_id"), F.lit("active").alias("status"), F.lit("").alias("superseded_by"), F.lit("").alias("reviewed_at"))
    pairs = docs.where("doc_id % 6 = 1").select(F.col("doc_id").cast("string").alias("record_id"), (F.col("doc_id") + 1).cast("string").alias("superseded_by"))
    return lifecycle.supersede(records, pairs, "2026-01-01").drop("reviewed_at")


@query("SELECT card_id, source FROM (SELECT CASE WHEN doc_id % 2 = 1 AND doc_id - 1 IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0) THEN doc_id - 1 ELSE doc_id END::VARCHAR AS card_id, CASE WHEN doc_id % 2 = 1 THEN 'new' END AS source, doc_id FROM documents WHERE doc_id % 2 = 1 UNION ALL SELECT doc_id::VARCHAR, 'old', doc_id FROM documents WHERE doc_id % 2 = 0 AND doc_id + 1 NOT IN (SELECT doc_id FROM documents)) ")
def upsert_cards(spark, d):
    docs = table(spark, d, "documents")
    cols = lambda s: [F.col("doc_id").cast("string").alias("card_id"), F.sha2(F.floor(F.col("doc_id") / 2).cast("string"), 256).alias("content_hash"), F.lit(s).alias("source"), F.lit("t0").alias("created_at"), F.lit("t1").alias("updated_at")]
    return lifecycle.upsert_cards(docs.where("doc_id % 2 = 0").select(*cols("old")), docs.where("doc_id % 2 = 1").select(*cols("new"))).select("card_id", "source")


@query("SELECT doc_id::VARCHAR AS dst, array_to_string(list_sort(list(DISTINCT src)), ',') AS sources FROM (SELECT doc_id::VARCHAR AS src, (doc_id // 2) AS doc_id FROM documents UNION ALL SELECT doc_id::VARCHAR, doc_id // 3 FROM documents) GROUP BY 1")
def link_graph(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file_path"), F.concat(F.lit("[["), F.expr("doc_id div 2").cast("string"), F.lit("]] [["), F.expr("doc_id div 3").cast("string"), F.lit("|x]]")).alias("content"))
    return links.backlinks(links.edges(rows)).select("dst", F.array_join("sources", ",").alias("sources"))


@query("""WITH n AS (SELECT doc_id, trim(coalesce(text, ''), E' \\t\\n\\r\\x0b\\x0c') AS body, coalesce(text, '') AS own FROM documents)
SELECT a.doc_id, 'see ' || CASE WHEN b.doc_id IS NULL THEN '[Embed not found: n' || (a.doc_id // 2 + 1) || ']' ELSE b.body END || ' and [Circular embed: n' || (a.doc_id // 2 + 1) || '] ![[p.png]]' || chr(10) || a.own AS content FROM n a LEFT JOIN n b ON b.doc_id = a.doc_id // 2 + 1""")
def resolve_embeds(spark, d):
    """Every document as a note that embeds two of the others' whole texts, one of them twice, and an image."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    target = F.concat(F.lit("n"), F.expr("cast(id as long) div 2 + 1").cast("string"))
    bodies = docs.select(F.concat(F.lit("v/n"), "id", F.lit(".md")).alias("file_path"), F.concat(F.lit("---\nid: "), "id", F.lit("\n---\n"), "text").alias("content"))
    heads = docs.select(F.concat(F.lit("w/h"), "id", F.lit(".md")).alias("file_path"), F.concat(F.lit("see ![["), target, F.lit("]] and ![["), target, F.lit("]] ![[p.png]]\n"), "text").alias("content"))
    out = links.resolve_embeds(bodies.unionByName(heads), lambda rows: bridge.held(spark, rows)).where(F.col("file_path").startswith("w/"))
    return out.select(F.regexp_extract("file_path", r"(\d+)\.md", 1).cast("long").alias("doc_id"), "content")


@query("SELECT doc_id, '# ' || lang || chr(10) || 'x' || doc_id AS part FROM documents")
def section_by_heading(spark, d):
    content = F.concat(F.lit("# Intro\na\n# "), F.col("lang"), F.lit("\nx"), F.col("doc_id").cast("string"), F.lit("\n# Next\nz"))
    return table(spark, d, "documents").select("doc_id", links.section(content, F.upper("lang")).alias("part"))


def _access(spark, d):
    e = bridge.events(spark, d)
    at = F.unix_seconds("ts").cast("double")
    status = F.when(F.col("event_id") % 5 == 0, "approved").otherwise("pending")
    return e.select(F.col("event_id").cast("string").alias("session_id"), F.sha2(F.col("event_id").cast("string"), 256).alias("token_hash"), F.col("user_id").cast("string").alias("ip"), status.alias("status"), at.alias("created_at"), at.alias("updated_at"), (at + 600).alias("expires_at"), F.lit(0.0).alias("blocked_until"))


_NOW = 1704067200.0 + 15 * 86400


@query(f"SELECT user_id::VARCHAR AS ip, count(*) AS pending FROM events WHERE event_id % 5 <> 0 AND floor(epoch(ts)) > {_NOW} - 600 GROUP BY 1")
def access_pending(spark, d):
    return access.pending_counts(_access(spark, d), _NOW).select("ip", "pending")


@query(f"SELECT CASE WHEN floor(epoch(ts)) + 600 <= {_NOW} THEN 'expired' WHEN event_id % 5 = 0 THEN 'revoked' WHEN event_id % 2 = 0 THEN 'approved' ELSE 'denied' END AS status, count(*) AS n FROM events GROUP BY 1")
def access_lifecycle(spark, d):
    rows = access.expire(_access(spark, d), _NOW)
    action = F.when(F.col("session_id").cast("long") % 5 == 0, "revoke").when(F.col("session_id").cast("long") % 2 == 0, "approve").otherwise("deny")
    decided = access.decide(rows, rows.select("session_id", action.alias("action"), F.lit("t").alias("token"), F.lit(3600.0).alias("ttl")), _NOW)
    return decided.groupBy("status").agg(F.count("*").alias("n"))


@query(f"SELECT event_id::VARCHAR AS token, event_id::VARCHAR AS session_id FROM events WHERE event_id % 5 = 0 AND floor(epoch(ts)) + 600 > {_NOW}")
def access_tokens(spark, d):
    rows = _access(spark, d)
    return access.valid(rows, rows.select(F.col("session_id").alias("token")), _NOW)


@query("SELECT s.project AS name, 'p/' || s.project AS path, CASE WHEN n % 2 = 0 THEN 'done' ELSE 'pending' END AS status, CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END AS attempts FROM (SELECT source AS project, count(*) AS n FROM documents GROUP BY 1) s")
def queue_configured(spark, d):
    projects = table(spark, d, "documents").groupBy(F.col("source").alias("name")).agg(F.count("*").alias("n")).withColumn("path", F.concat(F.lit("p/"), "name"))
    state = projects.where("n % 2 = 0").select("name", "path", F.lit("done").alias("status"), F.lit(1).alias("attempts"))
    return queue.configured(projects.select("name", "path"), state).select("name", "path", "status", "attempts")


@query("SELECT 'error ' || (user_id % 7) AS error, count(*) AS n FROM (SELECT DISTINCT user_id FROM events) GROUP BY 1 ORDER BY n DESC, error LIMIT 10")
def queue_errors(spark, d):
    rows = table(spark, d, "events").select("user_id").distinct().select(F.concat(F.lit("error "), (F.col("user_id") % 7).cast("string"), F.lit("; more\nlines")).alias("last_error"))
    return queue.errors(rows)


_KEYED = "coalesce(text, '') || ' api_key = sk-' || substr(sha256(doc_id::VARCHAR), 1, 24) || ' ghp_' || substr(sha256(doc_id::VARCHAR), 1, 20 + doc_id % 3) || ' xoxb-' || (1000000000 + doc_id) || ' end'"
_SCRUB = _KEYED
for _name, _pattern, _ in reversed(fixed.RECOGNISERS):  # assignments first, as they may hold a token
    _pattern = _pattern.replace("'", "''")
    _SCRUB = f"regexp_replace({_SCRUB}, '(?i){_pattern}', '<REDACTED_{_name}>', 'g')"


@query(f"SELECT doc_id, content, len(regexp_extract_all(content, '<REDACTED_[A-Z_]+>')) AS entities FROM (SELECT doc_id, {_SCRUB} AS content FROM documents)")
def entity_scrub(spark, d):
    """Whole texts with keys of three kinds behind them, scrubbed of all that the recognisers find."""
    digest = F.sha2(F.col("doc_id").cast("string"), 256)
    body = F.concat(F.coalesce("text", F.lit("")), F.lit(" api_key = sk-"), F.substring(digest, 1, 24), F.lit(" ghp_"), F.substring(digest, F.lit(1), (20 + F.col("doc_id") % 3).cast("int")), F.lit(" xoxb-"), (1000000000 + F.col("doc_id")).cast("string"), F.lit(" end"))
    rows = table(spark, d, "documents").select("doc_id", body.alias("content"))
    return entities.scrubbed(rows).select("doc_id", "content", F.size("entities").cast("long").alias("entities"))


@query("SELECT conv_id AS exchange_id, turn AS tool_use_id, CASE WHEN turn % 2 = 0 THEN 'r' || turn END AS result, turn % 4 = 0 AS is_error FROM conversations")
def tool_results(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("exchange_id"), F.col("turn").alias("tool_use_id"))
    results = rows.where("tool_use_id % 2 = 0").select("*", F.concat(F.lit("<result>r"), F.col("tool_use_id").cast("string"), F.lit("</result>")).alias("result"), (F.col("tool_use_id") % 4 == 0).alias("is_error"))
    return conversations.tool_results(rows, results)


@query("SELECT doc_id::VARCHAR AS exchange_id, CASE WHEN doc_id % 2 = 0 THEN 's2' END AS summary FROM documents")
def enrichment_last_wins(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("exchange_id"))
    found = docs.where("cast(exchange_id as long) % 2 = 0").select(F.concat(F.lit("x"), "exchange_id").alias("exchange_id"), F.col("exchange_id").alias("alternate_id"), F.explode(F.array(F.lit("f1"), F.lit("f2"))).alias("file"))
    full = found.select("*", F.when(F.col("file") == "f2", "s2").otherwise("s1").alias("summary"), F.lit("c").alias("category"), F.lit("i").alias("intent"))
    return conversations.enriched(docs, full).select("exchange_id", "summary")


@query("SELECT sha256(fp) AS fingerprint, min(doc_id) AS doc_id FROM (SELECT doc_id, source || ' ' || lang AS fp FROM documents WHERE doc_id % 3 <> 0) WHERE fp NOT IN (SELECT source || ' ' || lang FROM documents WHERE doc_id % 50 = 0) GROUP BY 1")
def fingerprint_push(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat_ws(" ", "source", "lang").alias("content"))
    pushed = docs.where("doc_id % 50 = 0").select(text.fingerprint(F.col("content")).alias("fingerprint")).distinct()
    one = docs.where("doc_id % 3 <> 0").groupBy("content").agg(F.min("doc_id").alias("doc_id"))
    return sinks.to_push(one, pushed).select("fingerprint", "doc_id")


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'decision' WHEN 'de' THEN 'idea' END AS kind, CASE lang WHEN 'en' THEN 'T2' WHEN 'de' THEN 'T3' ELSE 'T4' END AS trust_level FROM documents WHERE doc_id >= 500")
def remote_thoughts(spark, d):
    kind = F.when(F.col("lang") == "en", "decision").when(F.col("lang") == "de", "idea")
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.to_json(F.struct(kind.alias("type"), F.array("source").alias("topics"))).alias("metadata"), F.lpad(F.col("doc_id").cast("string"), 6, "0").alias("created_at"))
    out = files.thoughts(rows, "000500").join(rows.select(F.concat(F.lit(fixed.THOUGHT_ID), F.col("id").cast("string"), F.lit("_0")).alias("chunk_id"), "metadata", F.col("id").alias("doc_id")), "chunk_id")
    return out.select("doc_id", F.get_json_object("metadata", "$.type").alias("kind"), "trust_level")


@query("SELECT doc_id, 'Summary: s' || chr(10) || chr(10) || 'User: ' || substr(text, 1, 800) AS text FROM documents WHERE text <> ''")
def enriched_text(spark, d):
    rows = table(spark, d, "documents").where("text <> ''")
    return rows.select("doc_id", conversations.embedding_text(F.lit("s"), F.col("text"), F.lit(""), F.lit("")).alias("text"))
