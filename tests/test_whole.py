"""Queries over small documents that have what the test data lack, against brute force."""

import re

from loregrid.plans import registry

TEXTS = ["plain words", "a [[Far]] link and [[Near#part|name]]\n# Own\nbody one\n## Deep\nbody two", "see [[Far]]\nsee [[x|y]] end", "# Long\n" + "\n".join(f"w{i} " * 9 for i in range(120)), ""]


def documents(spark, tmp_path):
    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 3}") for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    return rows


def test_backlinks_of_whole_texts(spark, tmp_path):
    want = {}
    for i, t, lang, source in documents(spark, tmp_path):
        for x in {source, lang, *(m.strip() for m in re.findall(r"\[\[([^\]|#]+)", t))}:
            want.setdefault(x, set()).add(i)
    found = {r.target: r.backlinks for r in registry.QUERIES["backlinks"](spark, str(tmp_path)).collect()}
    assert found == {x: len(ids) for x, ids in want.items()} and found["Far"] == 2


def test_chunks_of_whole_files(spark, tmp_path):
    rows = documents(spark, tmp_path)
    found = registry.QUERIES["heading_chunks"](spark, str(tmp_path)).collect()
    for i, t, lang, source in rows:
        lines = f"# {source}\n\n## {lang}\n{t}\nsee".split("\n")
        own = [r for r in found if r.file_path == str(i)]
        assert sorted(r.chunk_index for r in own) == list(range(len(own)))
        body = [r for r in own if r.chunk_type != "file_summary"]
        for no, line in enumerate(lines[3:-1], 4):
            if line.strip() and not line.startswith("#"):
                assert any(r.start_line <= no <= r.end_line and line.strip() in r.content for r in body), (i, no)
    assert {"Own", "Deep", "Long"} <= {r.heading_path.rsplit(" > ", 1)[-1] for r in found}
