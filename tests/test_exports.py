"""Exports: manifests, resumption, errors, failures, archives."""

import pytest
from pyspark.sql import functions as F

from loregrid.sources.exports import Exports
from loregrid.sources.store import Conflict


@pytest.fixture()
def exports(spark, tmp_path):
    return Exports(spark, str(tmp_path / "out"))


def _names(path):
    return sorted(p.name.split("-")[0] for p in path.iterdir() if not p.name.startswith("."))


def test_runs_resume_and_log_errors(spark, exports, tmp_path):
    rows = spark.createDataFrame([("b", 2, "p"), ("a", 1, "p"), ("c", 3, None), (None, 4, "q")], "id string, n int, project string")
    assert exports.read("e") is None and exports.errors("e") is None
    wrong = F.when(F.col("n") == 3, "odd one")
    first = exports.run("e", rows, "id", "t0", ("id", "n"), wrong, "project")
    assert (first["rows"], first["failed"], first["by"]) == (2, 2, {"p": 2})
    assert sorted(tuple(r) for r in exports.errors("e").collect() if r.id) == [("c", "odd one", "t0")] and exports.errors("e").count() == 2
    more = rows.unionByName(spark.createDataFrame([("d", 5, "q")], rows.schema))
    second = exports.run("e", more, "id", "t1", ("id",))
    assert (second["number"], second["rows"], second["failed"]) == (2, 2, 1)
    assert sorted(tuple(r) for r in exports.read("e").collect()) == [("a", 1, "p"), ("b", 2, "p"), ("c", 3, None), ("d", 5, "q")]
    third = exports.run("e", more.where("id IS NOT NULL"), "id", "t2")
    assert third["rows"] == 0 and exports.errors("e") is None and exports.read("e").count() == 4
    assert _names(tmp_path / "out" / "e") == ["errors", "errors", "manifest", "manifest", "manifest", "run", "run", "run"]


def test_a_failing_task_leaves_no_manifest(spark, exports, tmp_path):
    rows = spark.range(20).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") == 13, F.raise_error(F.lit("broken"))).otherwise(F.lit("ok")).alias("v"))
    with pytest.raises(Exception, match="broken"):
        exports.run("e", rows, "id", "t0")
    assert exports.manifests("e") == [] and _names(tmp_path / "out" / "e") == []
    assert exports.run("e", rows.where("id <> '13'"), "id", "t1")["rows"] == 19


def test_two_runs_at_once(spark, exports, monkeypatch, tmp_path):
    rows = spark.createDataFrame([("a", 1)], "id string, n int")
    other = Exports(spark, exports.files.root)
    pending = exports.pending

    def late(*asked):
        found = pending(*asked)
        other.run("e", rows, "id", "t0")
        return found

    monkeypatch.setattr(exports, "pending", late)
    with pytest.raises(Conflict):
        exports.run("e", rows, "id", "t1")
    assert exports.read("e").count() == 1 and _names(tmp_path / "out" / "e") == ["manifest", "run"]


def test_archive_keeps_bytes(exports, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.jsonl").write_bytes(b"\x00\xffbytes")
    (logs / "b.jsonl").write_bytes(b"b")
    (logs / "empty.jsonl").write_bytes(b"")
    assert exports.archive(str(logs), "t0")["rows"] == 2
    (logs / "a.jsonl").write_bytes(b"changed")
    assert exports.archive(str(logs), "t1")["rows"] == 1
    assert sorted((r.path[-7:], bytes(r.content), r.archived_at) for r in exports.read("archive").collect()) == [("a.jsonl", b"\x00\xffbytes", "t0"), ("a.jsonl", b"changed", "t1"), ("b.jsonl", b"b", "t0")]
