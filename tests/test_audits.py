"""Audits and listings: nulls, ties, empty tables, and what the engine makes of its own tables."""

import json

from loregrid.engine import Engine
from loregrid.operators import audits, conversations


def test_import_summary_of_files_without_exchanges(spark):
    files = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "path string")
    found = spark.createDataFrame([("a", "x", "p", 2), ("a", "x", None, 1), ("b", None, "p", 1), ("gone", "x", "q", 1)], "path string, agent string, project string, chunks int")
    rows = [tuple(r) for r in audits.import_summary(files, found).collect()]
    assert rows == [("all", "", 2, 1, 3, 4), ("agent", "-", 1, 0, 1, 1), ("agent", "x", 1, 0, 2, 3), ("project", "p", 2, 0, 2, 3), ("project", "-", 1, 0, 1, 1)]
    assert [tuple(r) for r in audits.import_summary(files, found.limit(0)).collect()] == [("all", "", 0, 3, 0, 0)]
    assert [tuple(r) for r in audits.import_summary(files.limit(0), found.limit(0)).collect()] == [("all", "", 0, 0, 0, 0)]


def test_one_row_audits_of_empty_tables(spark):
    queue = spark.createDataFrame([], "status string, last_success_at double, last_attempt_at double")
    assert tuple(audits.queue_summary(queue).first()) == (0, 0, 0, 0, 0, 0.0, None, None)
    queue = spark.createDataFrame([(None, 0.0, 5.0), ("done", 0.0, 7.0), ("done", None, None)], queue.schema)
    assert tuple(audits.queue_summary(queue).first()) == (3, 1, 0, 0, 2, 66.7, None, 7.0)
    projects = spark.createDataFrame([], "position int, name string, kind string, state string, chunks int")
    assert tuple(audits.project_audit(projects).first()) == (0, 0, 0, 0, 0, "")
    projects = spark.createDataFrame([(3, "a", "code", "registered", 0), (2, "z", "code", "registered", 0), (1, "m", "code", "error", 0), (0, "n", "notes", "registered", 0), (4, "k", "code", "registered", 9)], projects.schema)
    assert tuple(audits.project_audit(projects).first()) == (5, 4, 1, 2, 1, "z")
    marks = spark.createDataFrame([("x",), ("",), (None,)], "m string")
    assert tuple(audits.enriched_share(marks, "m", 2.0).first()) == (3, 1, 33, 0.5)
    assert tuple(audits.enriched_share(marks.limit(0), "m").first()) == (0, 0, 0)


def test_review_candidates(spark):
    rows = spark.createDataFrame([("b", "t", "p", "active", "2026-01-01", ""), ("a", "t", "p", "active", "2026-01-01", None), ("c", "t", "p", "active", "nonsense", ""), ("d", "t", "p", "archived", "2020-01-01", ""), ("e", "t", "p", "active", "2020-01-01", "2021-01-01")], "record_id string, record_type string, project string, status string, created_at string, reviewed_at string")
    assert [(r.record_id, r.age_days) for r in audits.review_candidates(rows, "2026-01-11").collect()] == [("a", 10), ("b", 10), ("c", 0)]


def test_latest_sessions_and_ranges_of_lines(spark):
    rows = spark.createDataFrame([("s1", "t1"), ("s2", "t2"), ("s3", "t2"), ("s4", None), ("", "t9")], "session_id string, timestamp string").selectExpr("*", "'' AS tool_names", "'' AS project", "'' AS category", "'' AS summary")
    assert [(r.session_id, r.total) for r in conversations.latest_sessions(rows, 2).collect()] == [("s2", 4), ("s3", 4)]
    assert [r.session_id for r in conversations.latest_sessions(rows, 0).collect()] == ["s2"]
    said = spark.createDataFrame([("s", i, "user", f"t{i}") for i in range(1, 6)], "session_id string, line int, role string, content string")
    texts = {(a, b): conversations.transcript(said, a, b).first() for a, b in [(None, None), (2, 3), (5, None), (None, 1), (9, None)]}
    assert texts[9, None] is None and texts[2, 3].text == "### User\n\nt2\n\n### User\n\nt3" and texts[5, None].text == "### User\n\nt5" and texts[None, 1].text == "### User\n\nt1"


def test_audits_of_the_engine(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"), buckets=4)
    logs = tmp_path / "projects" / "demo"
    logs.mkdir(parents=True)
    said = lambda role, content: json.dumps({"type": role, "message": {"content": content}, "timestamp": "2026-01-02T00:00:00Z"})
    (logs / "a b%20.jsonl").write_text("\n".join([said("user", "one"), said("assistant", "two"), said("user", "three")]))
    (logs / "none.jsonl").write_text("{broken\n")
    (logs / "agent-1.jsonl").write_text(said("user", "hidden"))
    rows = [tuple(r) for r in engine.import_summary(str(tmp_path / "projects")).collect()]
    assert rows[0] == ("all", "", 1, 1, 2, 2) and ("project", "demo", 1, 0, 2, 2) in rows
    record = "record_id string, record_type string, project string, content string, trust_level string, status string, confidence double, tags array<string>, linked_note string, superseded_by string, reviewed_at string"
    engine.store_records(spark.createDataFrame([(f"{kind}{i}", kind, "p", f"text {kind} {i}", "T2", "superseded" if i == 2 else "active", 0.9, [], "n1" if i else "", "", "2026" if i == 1 else "") for kind in ("fact", "runbook") for i in range(3)], record))
    assert [r.record_id for r in engine.list_records(limit=1).collect()] == ["fact0", "runbook0"]
    assert engine.list_records("fact", status=None).count() == 3
    assert tuple(engine.semantic_audit().first()) == (4, 0, 2, 4, 4, 2, 0, 0, 0)
