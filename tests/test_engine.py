"""The engine over real files: ingest, search, notes, records, cards, sources, streams."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from loregrid.engine import CARDS, RECORDS, Engine
from loregrid.functions import text
from loregrid.operators import audits, cards, conversations, lifecycle, retrieval
from loregrid.sources import files
from loregrid.streaming import stateful


@pytest.fixture()
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "store"))


def test_vault(engine, tmp_path):
    vault = tmp_path / "vault"
    vault.mkdir()
    (vault / "a.md").write_text("# Alpha\nthe quick brown fox\n## Beta\njumps over [[b|x]] #tag\n")
    (vault / "b.md").write_text("# Gamma\nlazy dogs sleep all day\n")
    (vault / "bad.md").write_bytes(b"\xff\xfe\xff")
    assert engine.ingest_vault(str(vault)).count() == 2
    hits = engine.search("lazy dogs", threshold=0.0).collect()
    assert "lazy dogs" in hits[0].content and len({h.chunk_id for h in hits}) == len(hits)
    assert engine.ingest_vault(str(vault)).count() == 0
    (vault / "b.md").write_text("# Gamma\nbusy cats\n")
    engine.ingest_vault(str(vault))
    assert engine.search("lazy dogs", threshold=0.0).where(F.col("content").contains("lazy dogs")).count() == 0
    path = engine.store.read("chunks").where(F.col("file_path").endswith("a.md")).first().file_path
    assert [r.line for r in engine.context(path, 2, 2).collect()] == ["the quick brown fox", "## Beta"]
    assert {r.n for r in engine.stats().collect()} == {5}
    assert len(engine.search_snippets("fox", threshold=0.0).first().preview) > 0


def test_project(engine, tmp_path):
    root = tmp_path / "proj"
    (root / "build").mkdir(parents=True)
    (root / "m.py").write_text("def alpha():\n    return 'needle'\n")
    (root / "r.md").write_text("# Read\nhello\n")
    (root / "c.yaml").write_text("a: 1\n")
    (root / "build" / "x.py").write_text("def hidden(): pass\n")
    engine.ingest_project(str(root), "p", ["build"])
    rows = engine.store.read("chunks").collect()
    assert {r.symbol_name for r in rows if r.language == "python"} == {"alpha", "m.py"}
    assert any(r.language == "yaml" for r in rows) and all(r.project_name == "p" for r in rows)
    assert [r.project for r in engine.coverage_gaps().collect()] == ["p"]


def test_context_returns_the_lines_of_the_file(engine, spark, tmp_path):
    root = tmp_path / "p"
    root.mkdir()
    code = ["import os", "X = 1", "", "class A:", '    """zz doc"""', "    def m(self):", "        return 2", "y = 3", "def f():", "    return " + " + ".join(["1"] * 900), "", "main = f()"]
    (root / "a.py").write_text("\n".join(code))
    engine.ingest_project(str(root), "p")
    whole = [(r.no, r.line) for r in engine.context("p/a.py", -3, 100).collect()]
    assert whole == list(enumerate(code, 1))
    assert [r.line for r in engine.context("p/a.py", 12, 5).collect()] == ["main = f()"] and engine.context("p/a.py", 13, 5).isEmpty() and engine.context("p/b.py", 1, 5).isEmpty()
    engine.store_cards(spark.createDataFrame([("c1", "h1", "todo", "p", "Pin it", "first body\nsecond body", "", "historical", "low", False, True, "", "2026-01-01", "t", "t")], CARDS))
    assert "second body" in [r.line for r in engine.context("memory://c1", 1, 50).collect()]
    assert engine.search_cards("second body", threshold=0.0).first().chunk_id == "memory_c1"
    engine.set_card_status(["c1"], "superseded", "t2")
    assert engine.search_cards("second body", threshold=0.0).isEmpty() and engine.list_cards(status="superseded").count() == 1


def test_small_changes_rewrite_little_and_leave_results_readable(engine, spark, tmp_path):
    vault = tmp_path / "vault"
    vault.mkdir()
    for name in "abc":
        (vault / f"{name}.md").write_text(f"# {name}\nwords of {name}\n")
    taken = engine.ingest_vault(str(vault))
    notes = spark.createDataFrame([(f"n{i}", f"thing{i} alpha{i} beta{i} gamma{i}", "", "p", "bug", "low") for i in range(20)], "note_id string, content string, context string, project string, category string, severity string")
    engine.store_notes(notes, "t0")
    assert taken.count() == 3
    folders = lambda t: engine.store.version(t).folders()
    before = {t: folders(t) for t in ("notes", "chunks")}
    engine.confirm_notes(["n7"], "t1")
    assert {t: len(folders(t) - before[t]) for t in before} == {"notes": 1, "chunks": 1}
    assert engine.search("thing7", threshold=0.0, collections=["discoveries"], confirmed=True).first().chunk_id == "n7"
    engine.update_notes(spark.createDataFrame([("n8", "quite another matter")], "note_id string, content string"))
    assert engine.search("another matter", threshold=0.0, collections=["discoveries"]).first().chunk_id == "n8"
    assert engine.store.lookup("notes", "n8").first().embedding == engine.store.lookup("chunks", "discovery://n8").first().embedding
    engine.store_records(spark.createDataFrame([("r1", "runbook", "p", "restart the zebra service", "T2", "active", 0.9, ["ops"], "", "", "")], RECORDS))
    assert engine.search_records("zebra", "runbook", threshold=0.0).first().chunk_id == "semantic_runbook_r1" and engine.list_records("runbook").count() == 1
    (vault / "b.md").unlink()
    engine.ingest_vault(str(vault))
    assert {r.file_path[-4] for r in engine.store.read("files").collect()} == {"a", "c"}
    assert engine.store.read("chunks").where("collection = 'documents' AND file_path LIKE '%b.md'").isEmpty() and engine.search("words of b", threshold=0.0, collections=["documents"]).where("file_path LIKE '%b.md'").isEmpty()
    assert engine.bootstrap_index() == []


def lines(*rows):
    return "\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows)


def test_sessions(engine, tmp_path):
    logs = tmp_path / "projects" / "demo"
    (logs / "subagents").mkdir(parents=True)
    said = lambda role, content, **more: {"type": role, "message": {"content": content}, "timestamp": "2026-01-02T00:00:00Z", "sessionId": "s1", **more}
    (logs / "a.jsonl").write_text(lines(said("assistant", "early"), said("user", "We decided to use the second endpoint for all requests."), "", "{broken", said("assistant", [{"type": "text", "text": "fine"}, {"type": "tool_use", "id": "t", "name": "Bash"}, {"type": "thinking", "thinking": "x"}]), {"type": "tool_result", "tool_use_id": "t", "is_error": True, "content": "no"}, said("user", "second question"), said("user", "")))
    (logs / "subagents" / "b.jsonl").write_text(lines(said("user", "hidden")))
    (logs / "agent-1.jsonl").write_text(lines(said("user", "hidden")))
    found = {r.line_start: r for r in engine.ingest_sessions(str(tmp_path / "projects")).collect()}
    assert set(found) == {2, 7} and found[2].line_end == 6 and found[2].tool_names == ["Bash"] and found[2].tool_error_count == 1
    assert found[2].assistant_message == "fine" and found[2].project == "demo"
    engine.ingest_sessions(str(tmp_path / "projects"))
    assert engine.store.read("exchanges").count() == 2
    assert engine.search_conversations("second question", k=1).first().content.startswith("User: second question")
    card = engine.extract_cards().collect()
    assert [c.type for c in card] == ["api_contract"] and card[0].score == 84 and card[0].confidence == "medium"


def test_near_notes_in_one_batch(spark, tmp_path):
    import math

    turn = {f"at {x}": [math.cos(x), math.sin(x)] for x in (0.0, 0.3, 0.6, 0.9, 1.2, 3.0, 3.1)}
    engine = Engine(spark, str(tmp_path / "store"))
    engine.embed_texts = lambda texts: [turn[t] for t in texts]
    make = lambda *rows: spark.createDataFrame([(i, f"at {x}", c, "p", "bug", "low") for i, x, c in rows], "note_id string, content string, context string, project string, category string, severity string")
    # b is near a, c near b alone, d near c, and e near d alone: one by one a, c and e stay
    engine.store_notes(make(("a", 0.0, "A"), ("b", 0.3, "B"), ("c", 0.6, "C"), ("d", 0.9, "D"), ("e", 1.2, "E"), ("f", 3.0, "F")), "t0")
    assert {r.note_id: r.context for r in engine.list_notes().collect()} == {"a": "A\n\n---\n\nB", "c": "C\n\n---\n\nD", "e": "E", "f": "F"}
    engine.store_notes(make(("g", 3.1, "G"), ("h", 3.1, "H")), "t1")
    found = {r.note_id: r for r in engine.list_notes().collect()}
    assert set(found) == {"a", "c", "e", "f"} and found["f"].context == "F\n\n---\n\nG\n\n---\n\nH" and found["f"].updated_at == "t1"


def test_notes_and_records(engine, spark):
    make = lambda *rows: spark.createDataFrame(list(rows), "note_id string, content string, context string, project string, category string, severity string")
    engine.store_notes(make(("n1", "always pin the driver version", "first", "p", "workaround", "low"), ("n2", "tables use snake case", "", "p", "pattern", "low")), "t0")
    engine.store_notes(make(("n3", "always pin the driver version", "second", "p", "workaround", "low"), ("n4", "unrelated words here", "", "q", "bug", "low")), "t1")
    notes = {r.note_id: r for r in engine.list_notes().collect()}
    assert set(notes) == {"n1", "n2", "n4"} and notes["n1"].context == "first\n\n---\n\nsecond" and notes["n1"].updated_at == "t1"
    engine.confirm_notes(["n1"], "t2")
    assert [r.record_type for r in engine.suggest_promotions().collect()] == ["runbook"]
    made = engine.promote_notes("2026-01-01 00:00:00").collect()
    assert made[0].linked_note == "n1" and engine.list_notes(confirmed=True).first().linked_record == made[0].record_id
    assert engine.promote_notes("2026-01-01 00:00:00").count() == 0
    engine.reject_notes(["n4"])
    assert engine.list_notes().count() == 2
    assert engine.stale_records("2026-03-01 00:00:00", 30).count() == 1 and engine.stale_records("2026-01-05 00:00:00", 30).count() == 0
    engine.supersede_records({made[0].record_id: "other"}, "t3")
    assert engine.store.read("records").first().status == "superseded"
    assert {r["n"] for r in engine.record_audit().collect()} == {1}
    assert len(RECORDS.split(",")) == len(made[0])


def test_cards(engine, spark):
    row = lambda i, h, t: (i, h, "todo", "p", "t", "b", "", "historical", "low", False, True, "", "2026-01-01", t, t)
    engine.store_cards(spark.createDataFrame([row("c1", "h1", "t0"), row("c2", "h2", "t0")], CARDS))
    engine.store_cards(spark.createDataFrame([row("c9", "h1", "t1"), row("c2", "h3", "t1"), row("c3", "h4", "t1")], CARDS))
    found = {r.card_id: (r.content_hash, r.created_at, r.updated_at) for r in engine.list_cards().collect()}
    assert found == {"c1": ("h1", "t0", "t1"), "c2": ("h3", "t0", "t1"), "c3": ("h4", "t1", "t1")}
    assert tuple(engine.card_audit().first()) == (3, 0, 3)
    assert engine.list_cards(type="todo", project="q").count() == 0


def test_extraction_cards(spark):
    payload = {"conversation_summary": {"title": "T", "summary": "S", "projects_detected": ["p"]}, "memory_cards": [{"type": "decision", "project": "p", "title": "x", "body": "y", "status": "active_verified", "current_truth": True}, {"type": "todo", "project": "p", "title": " ", "body": "y"}]}
    rows = spark.createDataFrame([("s", "noise ```json\n" + json.dumps(payload) + "\n```")], "source_id string, payload string")
    out = {r.type: r for r in cards.low_trust(cards.from_extraction(rows)).collect()}
    assert set(out) == {"decision", "summary"} and out["decision"].status == "active_unverified" and not out["decision"].current_truth
    assert out["decision"].card_id == "mem_" + out["decision"].content_hash[:24]


def test_databases(spark, tmp_path):
    path = tmp_path / "x.sqlite"
    with sqlite3.connect(path) as base:
        base.execute("create table logs(thread_id text, created_at text, feedback_log_body text, api_key text)")
        base.executemany("insert into logs values (?, ?, ?, ?)", [("t1", "2026", "hello password = hunter2", "k"), (None, "2027", "second", "k"), ("t1", "2028", "", "k")])
        base.execute("create table ItemTable(key text unique, value blob)")
        value = {"acc": {"k1": {"id": "", "title": "A", "history": [{"entity": "USER", "text": "hi"}, {"entity": "BOT", "markdownText": "yo"}]}}}
        base.execute("insert into ItemTable values ('chat', ?)", (json.dumps(value),))
    rows = files.databases(spark, str(tmp_path))
    assert rows.where("table = 'logs'").count() == 3 and rows.where("row like '%api_key%'").count() == 0
    found = files.thread_rows(rows.where("table = 'logs'")).collect()
    assert [(r.thread_id, r.content, r.redacted) for r in sorted(found, key=lambda r: r.row_no)] == [("t1", "hello password=[REDACTED]", True), ("logs-row-2", "second", False)]
    chat = files.stored_items(rows.where("table = 'ItemTable'").withColumn("row", F.col("row")), "chat").orderBy("position").collect()
    assert [(c.role, c.content) for c in chat] == [("user", "hi"), ("bot", "yo")]


def test_inventory(spark, tmp_path):
    for name in ("session.jsonl", "notes.txt", "token.json"):
        (tmp_path / name).write_text("x")
    found = audits.inventory(files.listing(spark, str(tmp_path)).withColumn("source", F.lit("s"))).first()
    assert (found.files, found.jsonl, found.candidates, found.bytes) == (3, 1, 1, 3) and found.samples[0].endswith("session.jsonl")


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(5):
        (tmp_path / "in" / f"{i}.md").write_text(f"# {i}\nwords {i}\n")
    seen = []
    take = lambda batch, no: seen.append(sorted(r.path[-4] for r in batch.select("path").collect()))
    run = lambda: stateful.available_now(stateful.files(spark, str(tmp_path / "in"), "*.md", 2), take, str(tmp_path / "cp"))
    run()
    assert sorted(sum(seen, [])) == list("01234") and max(map(len, seen)) <= 2
    (tmp_path / "in" / "5.md").write_text("new")
    run()
    assert seen[-1] == ["5"]
    stored = spark.createDataFrame([("a",), ("b",)], "file_path string")
    assert [r.file_path for r in stateful.vanished(stored, stored.selectExpr("file_path path").where("path = 'a'")).collect()] == ["b"]
    budget = spark.createDataFrame([("a", 500), ("b", 1), ("c", 1)], "path string, n_chunks int")
    assert [r.path for r in stateful.within_budget(budget, 400).collect()] == ["a"]


def test_watermarked_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(f"p{i % 3}", f"2026-01-01 00:00:{i % 60:02d}", "modified") for i in range(0, 60, 4)], "path string, ts string, event string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "events")).withWatermark("ts", "1 second")
    out = stateful.debounced(stream, "13 seconds").writeStream.outputMode("append").format("memory").queryName("debounced").trigger(availableNow=True).start()
    out.awaitTermination()
    want = {tuple(r) for r in stateful.debounced(rows, "13 seconds").collect()}
    assert {tuple(r) for r in spark.table("debounced").collect()} <= want


def test_text_functions(spark):
    row = spark.createDataFrame([("key sk-abcdefghijklmnop mail a.b@c.org call +1 (555) 123-4567 token: xyz \x1b[31mred",)], "t string")
    out = row.select(text.redact(F.col("t")).alias("r"), text.credential_risk(F.col("t")).alias("c")).first()
    assert out.r == "key [REDACTED] mail [EMAIL] call [PHONE] token=[REDACTED] red" and out.c
    again = spark.createDataFrame([(out.r,)], "t string").select(text.redact(F.col("t"))).first()[0]
    assert again.replace("token=[REDACTED]", "") == out.r.replace("token=[REDACTED]", "")
    say = lambda f, *v: spark.createDataFrame([v], ", ".join(f"c{i} string" for i in range(len(v)))).select(f(*[F.col(f"c{i}") for i in range(len(v))])).first()[0]
    assert say(text.card_type, "git push to /home/x") == "command" and say(text.card_type, "see /home/x for secrets") == "file_path"
    assert say(text.note_title, "**Do this. And that**\nmore") == "Do this."
    assert say(text.noise, "warning: disk") and not say(text.noise, "a plain sentence")
    assert say(text.language_of, "/x/Y.TSX") == "typescript"
    assert say(text.sentences, "- " + "word " * 10 + "\nshort\n```\ncode code code code code code code\n```") == [("word " * 10).strip()]
    assert say(text.card_title, "`one` two three four five six seven eight nine ten eleven") == "one two three four five six seven eight nine ten"


def test_search_details(spark):
    rows = spark.createDataFrame([(1, "a", "foo bar baz", [1.0, 0.0], "T1", "active", False), (2, "a", "bar foo", [0.0, 1.0], "T1", None, False), (3, "memory_cards", "foo bar", [1.0, 0.0], "T2", "historical", True), (4, "memory_cards", "foo bar", [1.0, 0.0], "T2", "superseded", True), (5, "a", "x", None, "T9", "archived", False)], "chunk_id long, collection string, content string, embedding array<double>, trust_level string, status string, current_truth boolean")
    phrase = retrieval.keyword_search(rows, retrieval.query_phrases("foo_bar ..."), 10).select("chunk_id").collect()
    assert {r.chunk_id for r in phrase} == {1, 3, 4}
    found = {r.chunk_id: r.score for r in retrieval.hybrid_search(rows, [1.0, 0.0], retrieval.query_phrases("foo"), threshold=0.0).collect()}
    assert set(found) == {1, 2, 3} and abs(found[3] - round((0.7 + 0.3) * 0.95 * 0.58, 4)) < 0.2
    assert retrieval.hybrid_search(rows, [1.0, 0.0], retrieval.query_phrases("foo"), collections=["a"], threshold=0.99).count() <= 1


def test_lifecycle_details(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    twice = lifecycle.upsert(lifecycle.upsert(t, t.where("id = 1"), "id"), t.where("id = 1"), "id")
    assert sorted(map(tuple, twice.collect())) == [(1, "a"), (2, "b")]
    assert lifecycle.delete(t).count() == 2
    name = spark.range(1).select(lifecycle.note_file(F.lit("my proj"), F.lit("bug"), F.lit("2026-01-02").cast("timestamp"), F.lit("abcdefghij"), "out"), lifecycle.note_markdown(*[F.lit(x) for x in ("T", "p", "c", "s", "body")])).first()
    assert name[0] == "out/my_proj/bug_20260102_abcdefgh.md" and name[1].startswith("---\nproject: p")
    uses = spark.createDataFrame([("e", "t1"), ("e", "t2")], "exchange_id string, tool_use_id string")
    results = spark.createDataFrame([("e", "t1", "<result>ok</result>", True)], "exchange_id string, tool_use_id string, result string, is_error boolean")
    assert sorted((r.tool_use_id, r.result, r.is_error) for r in conversations.tool_results(uses, results).collect()) == [("t1", "ok", True), ("t2", None, False)]
