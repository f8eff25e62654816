"""The engine: one object whose methods ingest, search and keep a memory; results are DataFrames."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import embed, fixed, text
from .operators import audits, cards, chunking, conversations, lifecycle, near, retrieval
from .sources import files
from .sources.keyword_index import MOST_WRITES, KeywordIndex
from .sources.store import Store

CHUNKS = "collection string, chunk_id string, content string, file_path string, content_hash string, chunk_index int, chunk_type string, trust_level string, status string, current_truth boolean, project_name string, language string, heading_path string, symbol_name string, start_line int, end_line int, project string, category string, confirmed boolean, tags string, frontmatter_project string, embedding array<float>"
NOTES = "note_id string, content string, context string, project string, category string, severity string, confirmed boolean, promoted boolean, trust_level string, status string, confidence double, created_at string, updated_at string, linked_record string, embedding array<float>"
RECORDS = "record_id string, record_type string, project string, content string, trust_level string, status string, confidence double, tags array<string>, linked_note string, superseded_by string, reviewed_at string"
CARDS = "card_id string, content_hash string, type string, project string, title string, body string, why string, status string, confidence string, current_truth boolean, needs_confirmation boolean, tags string, source_date string, created_at string, updated_at string"
FILES = "file_path string, content_hash string, collection string"
LINES = "file_path string, no int, line string"
#: The collection of each record type.
RECORD_COLLECTIONS = {"fact": "facts", "runbook": "runbooks", "project_overview": "project_overviews"}
MERGE_DISTANCE = 0.1


class Engine:
    """Tables below ``root``: chunks, notes, records, cards, exchanges, files, lines, and the keyword index.

    Notes, records and cards are also among the chunks, which is what searches read. A change
    rewrites the buckets of what it changes, in its own table and in the chunks, and is one
    write of the keyword index, which is made anew after ``MOST_WRITES`` of them.
    """

    def __init__(self, spark: SparkSession, root: str, embed_texts=None, buckets: int = 16):
        self.spark, self.store, self.embed_texts = spark, Store(spark, root, buckets=buckets), embed_texts
        for name, schema, key in (("chunks", CHUNKS, "file_path"), ("notes", NOTES, "note_id"), ("records", RECORDS, "record_id"), ("cards", CARDS, "card_id"), ("files", FILES, "file_path"), ("lines", LINES, "file_path")):
            self.store.create(name, schema, key)
        self.index = KeywordIndex(self.store)

    def _vector(self, query: str) -> list[float]:
        return self.embed_texts([query])[0] if self.embed_texts else embed.hashed(query)

    def _fitted(self, rows: DataFrame) -> DataFrame:
        fields = [f.split(" ", 1) for f in CHUNKS.split(", ")]
        return rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in fields])

    def _ids(self, name: str, ids) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ids], f"{name} string")

    def _add(self, rows: DataFrame, taken: DataFrame) -> None:
        """``rows`` instead of all chunks of the files ``taken``, of which some may have none any more."""
        call = uuid.uuid4().hex
        taken = self.store.held(taken.select("file_path").distinct(), call)
        chunks = self.store.read("chunks")
        old = self.store.held(chunks.join(taken, "file_path", "left_semi"), call)
        known = old.where("embedding IS NOT NULL").select("chunk_id", "content", "embedding").dropDuplicates(["chunk_id", "content"])
        made = rows.drop("embedding").join(known, ["chunk_id", "content"], "left")
        both = self._fitted(made.where("embedding IS NOT NULL")).unionByName(self._fitted(embed.embedded(made.where("embedding IS NULL").drop("embedding"), "content", self.embed_texts)))
        full = self.store.held(both, call)  # only new contents are embedded
        self.store.rewrite("chunks", taken.unionByName(full.select("file_path")), lambda stored: stored.join(taken, "file_path", "left_anti").select(*full.columns).unionByName(full))
        self._reindex(full, old)
        self.store.release(call)

    def _reindex(self, new: DataFrame, old: DataFrame) -> None:
        """One write of the keyword index for chunks that came and went; what stayed as it was is not touched."""
        key = ["collection", "chunk_id", "content"]
        came, went = new.select(*key), old.select(*key)
        if len(self.index._writes()) >= MOST_WRITES:
            self.index.replace_all(self.store._rows("chunks", self.store.version("chunks")).select(*key))
        else:
            self.index.put(came.join(went, key, "left_anti"), went.join(came, key, "left_anti"))

    def bootstrap_index(self) -> list[str]:
        """Index the collections whose keyword index is empty; returns their names."""
        return self.index.bootstrap(self.store._rows("chunks", self.store.version("chunks")).select("collection", "chunk_id", "content"))

    def _sync_notes(self, ids: DataFrame) -> None:
        """The chunks of the given notes as the notes are now."""
        notes = self.store.read("notes").join(ids.select("note_id").distinct(), "note_id", "left_semi")
        path = F.concat(F.lit("discovery://"), "note_id")
        rows = notes.select(F.lit("discoveries").alias("collection"), F.col("note_id").alias("chunk_id"), path.alias("file_path"), "content", "trust_level", "status", F.lit(True).alias("current_truth"), "project", "category", "confirmed")
        self._add(rows, ids.select(path.alias("file_path")))

    def _sync_records(self, ids: DataFrame) -> None:
        records = self.store.read("records")
        kind = F.element_at(F.create_map(*[F.lit(x) for pair in RECORD_COLLECTIONS.items() for x in pair]), F.col("record_type"))
        path = F.concat(F.lit("semantic://"), "record_id")
        rows = records.join(ids.select("record_id").distinct(), "record_id", "left_semi").select(kind.alias("collection"), F.concat(F.lit("semantic_"), "record_type", F.lit("_"), "record_id").alias("chunk_id"), path.alias("file_path"), "content", "trust_level", "status", F.lit(True).alias("current_truth"), "project", F.array_join("tags", ",").alias("tags"))
        self._add(rows.where("collection IS NOT NULL"), ids.select(path.alias("file_path")))

    def _sync_cards(self, ids: DataFrame) -> None:
        content = text.card_text(*[F.col(c) for c in ("project", "type", "title", "status", "confidence", "current_truth", "tags", "body", "why", "source_date")])
        path = F.concat(F.lit("memory://"), "card_id")
        cards = self.store.read("cards").join(ids.select("card_id").distinct(), "card_id", "left_semi")
        rows = cards.select(F.lit("memory_cards").alias("collection"), F.concat(F.lit("memory_"), "card_id").alias("chunk_id"), path.alias("file_path"), content.alias("content"), F.lit("T3").alias("trust_level"), "status", "current_truth", "project", F.col("type").alias("category"), "tags")
        self._add(rows, ids.select(path.alias("file_path")))

    # ingest
    def ingest_vault(self, root: str, full: bool = False) -> DataFrame:
        """Markdown files below ``root``: what changed is parsed again; returns the files taken."""
        found = files.texts(self.spark, root, "*.md").where("error IS NULL").withColumnRenamed("path", "file_path")
        return self._ingest(found, "documents", F.lit(""), full, f"{root.rstrip('/')}/")

    def ingest_project(self, root: str, name: str, ignore: list[str] | None = None, full: bool = False) -> DataFrame:
        """Sources and markdown of a project; files that are gone lose their chunks."""
        found = files.project_files(self.spark, root, ignore or []).withColumn("file_path", F.concat(F.lit(f"{name}/"), "file_path"))
        return self._ingest(found, "codebase", F.lit(name), full, f"{name}/")

    def _ingest(self, found: DataFrame, collection: str, project: Column, full: bool, below: str) -> DataFrame:
        """Parse what changed of ``found``; what is stored ``below`` a folder and not found any more goes."""
        call = uuid.uuid4().hex
        known_files = self.store.read("files").where(F.col("collection") == collection)
        fresh = self.store.held((found if full else lifecycle.changed_files(found, known_files)).select("*"), call)
        plain = lambda c: F.regexp_replace(c, "^[A-Za-z]+:/*(?=/)", "")  # noqa: E731  listings name their file system, callers may not
        gone = known_files.where(plain(F.col("file_path")).startswith(plain(F.lit(below)))).join(found.select("file_path"), "file_path", "left_anti")
        taken = self.store.held(fresh.select("file_path").unionByName(gone.select("file_path")).distinct(), call)
        markdown = fresh if "kind" not in fresh.columns else fresh.where("kind = 'markdown'")
        rows = chunking.markdown_chunks(markdown.withColumn("path", F.col("file_path"))).withColumn("symbol_name", F.lit("")).withColumn("language", F.lit("markdown"))
        if "kind" in fresh.columns:
            code = chunking.code_chunks(fresh.where("kind = 'code'").withColumn("path", F.col("file_path"))).join(fresh.select("file_path", "language"), "file_path").withColumn("heading_path", F.lit(""))
            rows = rows.unionByName(code)
        known = rows.join(fresh.select("file_path", "content_hash"), "file_path")
        self._add(known.select("*", F.lit(collection).alias("collection"), text.chunk_id(F.col("file_path"), F.col("chunk_index")).alias("chunk_id"), F.lit("T1").alias("trust_level"), F.lit("active").alias("status"), project.alias("project_name"), project.alias("project")), taken)
        lines = chunking.file_lines(fresh)
        self.store.rewrite("lines", taken, lambda old: old.join(taken, "file_path", "left_anti").unionByName(lines))
        listed = fresh.select("file_path", "content_hash", F.lit(collection).alias("collection"))
        own = taken.withColumn("collection", F.lit(collection))
        self.store.rewrite("files", taken, lambda old: old.join(own, ["file_path", "collection"], "left_anti").select(*listed.columns).unionByName(listed))
        result = self.store.held(fresh.select("file_path", "content_hash"), f"results-{call}")
        self.store.release(call)
        return result

    def ingest_sessions(self, root: str) -> DataFrame:
        """Session logs as exchanges, keyed by session and first line, so that a grown one replaces itself."""
        messages = files.session_logs(self.spark, root)
        found = conversations.exchanges(messages).withColumn("user_message", text.clean_message(F.col("user_message"))).withColumn("assistant_message", text.clean_message(F.col("assistant_message"), 3000))
        about = messages.groupBy("session_id").agg(F.min("timestamp").alias("timestamp"), F.first("project").alias("project"), F.first("agent").alias("agent"))
        rows = found.join(about, "session_id")
        self.store.upsert("exchanges", rows, "session_id", "line_start")
        content = conversations.embedding_text(F.lit(""), F.col("user_message"), F.col("assistant_message"), F.array_join("tool_names", ", "))
        pieces = chunking.chunk_texts(rows.select(F.col("exchange_id").alias("id"), content.alias("content")), fixed.EXCHANGE_TOKENS, fixed.EXCHANGE_OVERLAP)
        many = pieces.groupBy("id").agg(F.count("*").alias("n"))
        named = pieces.join(many, "id").withColumn("chunk_id", F.when(F.col("n") > 1, F.concat_ws("_", "id", F.col("chunk_index").cast("string"))).otherwise(F.col("id")))
        owner = rows.select(F.col("exchange_id").alias("id"), "project", F.concat_ws("#", "session_id", F.col("line_start").cast("string")).alias("file_path"))
        self._add(named.join(owner, "id").select("chunk_id", "file_path", F.col("text").alias("content"), "chunk_index", "start_line", "end_line", F.lit("conversations").alias("collection"), F.col("project").alias("project_name"), F.lit("T3").alias("trust_level"), F.lit("active").alias("status"), "project"), owner)
        return rows

    # search
    def search(self, query: str, k: int = fixed.TOP_K, threshold: float = fixed.SCORE_THRESHOLD, collections: list[str] | None = None, **filters) -> DataFrame:
        """Hybrid search over chunks; filters: project, tags, language, category, confirmed."""
        phrases = retrieval.query_phrases(query)
        scores = self.index.matches(phrases).select("chunk_id", "bm25") if phrases else self.spark.createDataFrame([], "chunk_id string, bm25 double")
        return retrieval.hybrid_search(self.store.read("chunks"), self._vector(query), phrases, k, threshold, collections, scores=scores, **filters)

    def search_cards(self, query: str, project: str | None = None, kind: str | None = None, k: int = 8, threshold: float = 0.25) -> DataFrame:
        """Memory cards, of one type if ``kind`` is given."""
        return self.search(query, k, threshold, ["memory_cards"], project=project, category=kind)

    def search_records(self, query: str, record_type: str | None = None, project: str | None = None, k: int = 6, threshold: float = 0.35) -> DataFrame:
        """Semantic records, of one type if it is known, else of all."""
        asked = [RECORD_COLLECTIONS[record_type]] if record_type in RECORD_COLLECTIONS else list(RECORD_COLLECTIONS.values())
        return self.search(query, k, threshold, asked, project=project)

    def search_snippets(self, query: str, **how) -> DataFrame:
        return retrieval.snippets(self.search(query, **how))

    def search_conversations(self, query: str, k: int = 10, after: str | None = None, before: str | None = None) -> DataFrame:
        """Exchanges by vector alone, unclamped, with a range of times."""
        rows = self.store.read("chunks").where("collection = 'conversations'")
        if after or before:
            times = self.store.read("exchanges").select(F.concat_ws("#", "session_id", F.col("line_start").cast("string")).alias("file_path"), "timestamp")
            rows = rows.join(times, "file_path").where(F.col("timestamp").between(after or "", before or "9999"))
        return retrieval.nearest(rows, self._vector(query), k).withColumn("score", F.round(1 - F.col("distance") / 2, 4))

    def context(self, file_path: str, start: int, count: int) -> DataFrame:
        """(no, line) of ``count`` lines of a stored file from ``start`` on, within its bounds.

        ``memory://`` and the id of a card stands for the card's text. Of a file one bucket is read.
        """
        if file_path.startswith("memory://"):
            rows = chunking.file_lines(self.store.lookup("chunks", file_path))
        else:
            rows = self.store.lookup("lines", file_path)
        return chunking.line_window(rows, start, count).select("no", "line").orderBy("no")

    def project_context(self, project: str, query: str) -> DataFrame:
        """(kind, id, title, score): the best documents, sources, notes and cards for a task in a project."""
        hits = [self.search(query, k=3, threshold=0.0, collections=[c], project=p).select(F.lit(kind).alias("kind"), F.col("chunk_id").alias("id"), text.note_title(F.col("content")).alias("title"), F.col("score")) for kind, c, p in (("document", "documents", None), ("code", "codebase", project))]
        near = retrieval.nearest(self.store.read("notes").where(F.col("project") == project).withColumn("chunk_id", F.col("note_id")), self._vector(query), 5)
        notes = near.select(F.lit("note").alias("kind"), F.col("note_id").alias("id"), text.note_title(F.col("content")).alias("title"), F.round(1 - F.col("distance") / 2, 4).alias("score"))
        own = self.list_cards(5, project=project).select(F.lit("card").alias("kind"), F.col("card_id").alias("id"), "title", text.card_status_weight(F.col("status"), F.col("current_truth")).alias("score"))
        return hits[0].unionByName(hits[1]).unionByName(notes).unionByName(own)

    def project_overview(self, project: str, as_of: str, most: int = 12) -> DataFrame:
        """A project overview record made of the project's files and active records."""
        named = self.store.read("chunks").where(F.col("project_name") == project).where("chunk_type IN ('file_summary', 'module_summary')").select(F.concat(F.lit("- "), "file_path").alias("line"))
        facts = self.store.read("records").where((F.col("project") == project) & (F.col("status") == "active")).select(F.concat(F.lit("- "), text.note_title(F.col("content"))).alias("line"))
        lines = facts.orderBy("line").limit(most).unionByName(named.orderBy("line").limit(most))
        body = lines.agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("content"))
        return body.select(
            F.concat(F.lit("semantic_project_overview_"), text.short_hash(F.lit(project), 32)).alias("record_id"), F.lit("project_overview").alias("record_type"), F.lit(project).alias("project"), "content", F.lit("T2").alias("trust_level"), F.lit("active").alias("status"),
            F.lit(0.9).alias("confidence"), F.array(F.lit("overview")).alias("tags"), F.lit("").alias("linked_note"), F.lit("").alias("superseded_by"), F.lit(as_of).alias("reviewed_at"),
        )

    def bootstrap_coverage(self, as_of: str) -> list[str]:
        """Give every indexed project without an active record an overview; returns those projects."""
        missing = [r.project for r in self.coverage_gaps().orderBy("project").collect()]  # configured projects
        for project in missing:
            self.store_records(self.project_overview(project, as_of))
        return missing

    # notes, records, cards
    def store_notes(self, rows: DataFrame, as_of: str) -> None:
        """Add notes (note_id, content, context, project, category, severity); near ones are merged.

        As if they came one by one in order of their ids: each meets the stored notes and those
        before it that stay.
        """
        full = embed.embedded(rows, "content", self.embed_texts).select("note_id", "content", "context", "project", "category", "severity", "embedding")
        fresh = full.select("*", F.lit(False).alias("confirmed"), F.lit(False).alias("promoted"), F.lit("T3").alias("trust_level"), F.lit("active").alias("status"), F.lit(0.7).alias("confidence"), F.lit(as_of).alias("created_at"), F.lit(as_of).alias("updated_at"), F.lit("").alias("linked_record"))
        call = uuid.uuid4().hex
        notes = self.store.read("notes")
        fresh = self.store.held(fresh.select(*notes.columns), call)
        stored = self.store.held(self.near_notes(fresh, notes, call=call), call)
        own = self.store.held(self._close(fresh, fresh, MERGE_DISTANCE, call).where("near_id < note_id"), call)
        kept = self.store.held(self._kept(fresh.select("note_id").distinct().join(stored, "note_id", "left_anti"), own, call), call)
        met = stored.unionByName(own.join(kept.select(F.col("note_id").alias("near_id")), "near_id", "left_semi"))
        pairs = self.store.held(met.groupBy("note_id").agg(F.min_by("near_id", F.struct("distance", "near_id")).alias("near_id"), F.min("distance").alias("distance")), call)
        first, others = fresh.join(kept, "note_id", "left_semi").select(*notes.columns), fresh.join(kept, "note_id", "left_anti").select(*notes.columns)
        changed = self.store.held(kept.unionByName(pairs.select(F.col("near_id").alias("note_id"))).distinct(), call)
        self.store.rewrite("notes", changed, lambda old: lifecycle.merge_near_notes(old.unionByName(first), others, pairs))
        self._sync_notes(changed)
        self.store.release(call)

    def _kept(self, left: DataFrame, own: DataFrame, call: str) -> DataFrame:
        """note_id of those of ``left`` that stay when notes come one by one, in order of their ids.

        A note stays if it is near no earlier one that stays. Each round settles all notes whose
        earlier near ones are settled, so there are as many rounds as the longest chain has notes.
        """
        left = self.store.held(left.select("note_id"), call)
        kept = left.limit(0)
        while not left.isEmpty():
            waiting = own.join(left, "note_id", "left_semi").join(left.select(F.col("note_id").alias("near_id")), "near_id", "left_semi")
            new = self.store.held(left.join(waiting, "note_id", "left_anti"), call)
            gone = own.join(new.select(F.col("note_id").alias("near_id")), "near_id", "left_semi").select("note_id")
            kept = kept.unionByName(new)
            left = self.store.held(left.join(new.unionByName(gone), "note_id", "left_anti"), call)
        return kept

    def near_notes(self, fresh: DataFrame, notes: DataFrame, most: float = MERGE_DISTANCE, call: str | None = None) -> DataFrame:
        """(note_id, near_id, distance): each fresh note's nearest stored one closer than ``most``."""
        close = self._close(fresh, notes, most, call)
        return close.groupBy("note_id").agg(F.min_by("near_id", F.struct("distance", "near_id")).alias("near_id"), F.min("distance").alias("distance"))

    def _close(self, fresh: DataFrame, notes: DataFrame, most: float, call: str | None = None) -> DataFrame:
        """(note_id, near_id, distance): the pairs of a fresh note and another closer than ``most``."""
        hold = (lambda rows: self.store.held(rows, call)) if call else (lambda rows: rows)
        return near.near_pairs(fresh.select("note_id", "embedding"), notes.select(F.col("note_id").alias("near_id"), "embedding"), most, hold)

    def list_notes(self, project: str | None = None, category: str | None = None, confirmed: bool | None = None, limit: int = 50) -> DataFrame:
        rows = self.store.read("notes")
        for column, value in (("project", project), ("category", category), ("confirmed", confirmed)):
            rows = rows if value is None else rows.where(F.col(column) == value)
        return rows.orderBy("note_id").limit(limit)

    def confirm_notes(self, ids: list[str], as_of: str) -> None:
        asked = self._ids("note_id", ids)
        self.store.rewrite("notes", asked, lambda old: lifecycle.confirm(old, asked, as_of))
        self._sync_notes(asked)

    def reject_notes(self, ids: list[str]) -> None:
        asked = self._ids("note_id", ids)
        self.store.delete("notes", asked)
        self._sync_notes(asked)

    def update_notes(self, changes: DataFrame) -> None:
        """Non-null fields of ``changes`` (note_id, …) over those stored; a changed content is embedded again."""
        before = self.store.read("notes")
        hit = changes.join(before.select("note_id"), "note_id", "left_semi")
        if "content" in changes.columns:
            hit = embed.embedded(hit.drop("embedding"), "content", self.embed_texts).withColumn("embedding", F.when(F.col("content").isNotNull(), F.col("embedding")))
        call = uuid.uuid4().hex
        hit = self.store.held(hit, call)
        self.store.rewrite("notes", hit, lambda old: lifecycle.patch(old, hit, "note_id"))
        self._sync_notes(hit)
        self.store.release(call)

    def promote_notes(self, as_of: str) -> DataFrame:
        """Confirmed notes become records, linked both ways; returns the new records."""
        call = uuid.uuid4().hex
        notes = self.store.read("notes")
        made = self.store.held(lifecycle.promote(notes, as_of)[1].select(*self.store.version_columns("records")), f"results-{call}")
        ready = made.select(F.col("linked_note").alias("note_id"))
        self.store.upsert("records", made, "record_id")
        self.store.rewrite("notes", ready, lambda old: lifecycle.promote(old, as_of)[0])
        self._sync_notes(ready)
        self._sync_records(made)
        return made

    def store_records(self, rows: DataFrame) -> None:
        """Records by id, each also a chunk of the collection of its type."""
        self.store.upsert("records", rows, "record_id")
        self._sync_records(rows)

    def list_records(self, record_type: str | None = None, project: str | None = None, status: str | None = "active", limit: int = 50) -> DataFrame:
        """Records by id; without a type, at most ``limit`` of each type that is searched."""
        rows = self.store.read("records")
        for column, value in (("record_type", record_type), ("project", project), ("status", status)):
            rows = rows if value is None else rows.where(F.col(column) == value)
        if record_type is not None:
            return rows.orderBy("record_id").limit(limit)
        each = [rows.where(F.col("record_type") == kind).orderBy("record_id").limit(limit) for kind in RECORD_COLLECTIONS]
        return functools.reduce(DataFrame.unionByName, each)

    def supersede_records(self, pairs: dict[str, str], as_of: str) -> None:
        asked = self.spark.createDataFrame(list(pairs.items()), "record_id string, superseded_by string")
        self.store.rewrite("records", asked, lambda old: lifecycle.supersede(old, asked, as_of))
        self._sync_records(asked)

    def stale_records(self, as_of: str, days: int = 90) -> DataFrame:
        return audits.stale(self.store.read("records").where("status = 'active'"), as_of, days)

    def store_cards(self, rows: DataFrame) -> None:
        """Cards by id or content, each also a chunk."""
        call = uuid.uuid4().hex
        put = self.store.held(lifecycle.cards_to_put(self.store.read("cards"), rows), call)
        self.store.upsert("cards", put, "card_id")
        self._sync_cards(put)
        self.store.release(call)

    def set_card_status(self, ids: list[str], status: str, as_of: str, current_truth: bool | None = None) -> None:
        """The state, and if given the truth, of cards and of their chunks."""
        asked, hit = self._ids("card_id", ids), F.col("card_id").isin(ids)

        def change(old: DataFrame) -> DataFrame:
            rows = old.withColumn("status", F.when(hit, status).otherwise(F.col("status"))).withColumn("updated_at", F.when(hit, as_of).otherwise(F.col("updated_at")))
            return rows if current_truth is None else rows.withColumn("current_truth", F.when(hit, current_truth).otherwise(F.col("current_truth")))

        self.store.rewrite("cards", asked, change)
        self._sync_cards(asked)

    def list_cards(self, limit: int = 50, **equal) -> DataFrame:
        rows = self.store.read("cards")
        for column, value in equal.items():
            rows = rows.where(F.col(column) == value)
        return rows.orderBy(F.desc("source_date"), F.desc("updated_at"), "card_id").limit(limit)

    def extract_cards(self, most: int = 40) -> DataFrame:
        """Rule-made cards of all exchanges."""
        said = self.store.read("exchanges").select(F.col("exchange_id").alias("id"), "project", F.substring("timestamp", 1, 10).alias("date"), F.explode(F.create_map(F.lit("user"), "user_message", F.lit("assistant"), "assistant_message")).alias("role", "content"))
        return cards.cards(said, most)

    # audits
    def stats(self) -> DataFrame:
        return audits.counts_with_total(self.store.read("chunks"), "collection")

    def card_audit(self) -> DataFrame:
        return audits.card_audit(self.store.read("cards"))

    def record_audit(self) -> DataFrame:
        return audits.counts_by_sets(self.store.read("records"), "status", "record_type", "project")

    def semantic_audit(self) -> DataFrame:
        """One row about the life cycle of records and notes."""
        return audits.semantic_audit(self.store.read("records"), self.store.read("notes"), self.coverage_gaps())

    def enriched_share(self, seconds: float | None = None) -> DataFrame:
        """How many chunks of conversations have a category."""
        return audits.enriched_share(self.store.read("chunks").where("collection = 'conversations'"), "category", seconds)

    def import_summary(self, root: str) -> DataFrame:
        """What ``ingest_sessions`` of a folder would add, by agent and by project; nothing is written."""
        messages = files.session_logs(self.spark, root)
        about = messages.groupBy("session_id").agg(F.min("path").alias("path"), F.min_by("agent", "path").alias("agent"), F.min_by("project", "path").alias("project"))
        found = conversations.exchanges(messages).join(about, "session_id").select("path", "agent", "project", F.lit(1).alias("chunks"))
        return audits.import_summary(files.log_paths(self.spark, root), found)

    def coverage_gaps(self) -> DataFrame:
        """Indexed projects without an active record."""
        indexed = self.store.read("chunks").where("collection = 'codebase'").select(F.col("project_name").alias("project"))
        return audits.gaps(indexed, self.store.read("records").where("status = 'active'"), "project")

    def suggest_promotions(self, limit: int = 20) -> DataFrame:
        return lifecycle.suggest_promotions(self.store.read("notes"), limit)
