"""Numbered lines of files that are read in splits."""

import json
import random

import pytest
from pyspark.sql import functions as F

from loregrid.sources import files, lines


@pytest.fixture
def tiny_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "997b", "spark.sql.files.openCostInBytes": "8b"}
    old = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in old.items():
        spark.conf.set(n, v)


def _random_files(folder):
    rng = random.Random(5)
    texts = {"empty.jsonl": "", "feeds.jsonl": "\n\n\n", "one.jsonl": "no end", "long.jsonl": "x" * 3000 + "\n" + "y" * 2000, "returns.jsonl": "a\r\nb\rc\r\n"}
    for i in range(12):
        texts[f"deep/f{i}.jsonl"] = "\n".join(rng.choice(["", "é" * rng.randint(1, 60), "w " * rng.randint(1, 90)]) for _ in range(rng.randint(1, 80))) + rng.choice(["", "\n"])
    (folder / "deep").mkdir()
    for name, text in texts.items():
        (folder / name).write_bytes(text.encode())
    return texts


def _want(texts):
    return sorted((name.rsplit("/", 1)[-1], no, line) for name, text in texts.items() for no, line in enumerate(text.split("\n"), 1) if line or no < len(text.split("\n")))


@pytest.mark.parametrize("most", [lines.MOST_BLOCKS, 0])
def test_lines_across_borders(spark, tmp_path, tiny_splits, monkeypatch, most):
    monkeypatch.setattr(lines, "MOST_BLOCKS", most)
    texts = _random_files(tmp_path)
    found = lines.numbered_lines(spark, str(tmp_path), "*.jsonl")
    assert found.rdd.getNumPartitions() > 1
    assert sorted((r.path.rsplit("/", 1)[-1], r.line, r.value) for r in found.collect()) == _want(texts)
    blocks = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(str(tmp_path)).select("_metadata.file_path", "_metadata.file_block_start").distinct().count()
    assert 10 < blocks <= lines.blocks_at_most(spark, str(tmp_path), "*.jsonl")


def test_one_small_batch_at_a_time(spark, tmp_path):
    texts = _random_files(tmp_path)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = lines.numbered_lines(spark, str(tmp_path), "*.jsonl", ~F.col("path").contains("/deep/")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.path.rsplit("/", 1)[-1], r.line, r.value) for r in found) == _want({n: t for n, t in texts.items() if "deep" not in n})


def test_session_logs_do_not_depend_on_splits(spark, tmp_path, request):
    rng = random.Random(7)
    for i in range(3):
        rows = [rng.choice(["", "{broken", json.dumps({"type": rng.choice(["user", "assistant"]), "message": {"content": "é" * rng.randint(0, 150)}, "sessionId": f"s{i}"})]) for _ in range(60)]
        (tmp_path / f"log{i}.jsonl").write_text("\n".join(rows))
    whole = sorted(map(tuple, files.session_logs(spark, str(tmp_path)).drop("tools").collect()), key=repr)
    request.getfixturevalue("tiny_splits")
    split = files.session_logs(spark, str(tmp_path)).drop("tools").collect()
    assert sorted(map(tuple, split), key=repr) == whole
    want = [(f"log{i}", no) for i in range(3) for no, line in enumerate((tmp_path / f"log{i}.jsonl").read_text().split("\n"), 1) if line.startswith('{"')]
    assert sorted((r.path.rsplit("/", 1)[-1][:4], r.line) for r in split) == want and len(want) > 40


def test_orders_of_files(spark, tmp_path):
    listed = spark.createDataFrame([("/a/B.jsonl", 1), ("/a/a.jsonl", 3), ("/a/c.jsonl", 3), ("/a/agent-1.jsonl", 9), ("/a/subagents/x.jsonl", 9)], "path string, modified int")
    assert [r.path for r in files.newest_files(listed, 3).collect()] == ["/a/agent-1.jsonl", "/a/subagents/x.jsonl", "/a/a.jsonl"]
    assert [r.path for r in files.prompt_files(listed).collect()] == ["/a/a.jsonl", "/a/B.jsonl", "/a/c.jsonl"]
