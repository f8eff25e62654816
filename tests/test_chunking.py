import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from loregrid.operators import chunking


def block(*costs):
    return "\n".join(" ".join(f"w{i}x{j}" for j in range(c)) for i, c in enumerate(costs))


def test_windows_overlap():
    out = chunking.windows(block(*[50] * 20), 400, 80)
    assert [(a, b) for _, a, b, _ in out] == [(1, 8), (8, 15), (15, 20)]


def test_windows_always_advance():
    assert [(a, b) for _, a, b, _ in chunking.windows(block(10, 395), 400, 80)] == [(1, 1), (2, 2)]
    out = chunking.windows(block(500, 10), 400, 80)
    assert [(a, n) for _, a, _, n in out] == [(1, 400), (1, 180), (2, 10)]
    assert chunking.windows("  \n ") == [] and chunking.windows(None) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=40), st.integers(2, 25), st.integers(0, 24))
def test_windows_cover_every_word(costs, most, overlap):
    text = block(*costs)
    out = chunking.windows(text, most, min(overlap, most - 1))
    assert {w for t, *_ in out for w in t.split()} == set(text.split())
    assert all(n <= most for *_, n in out if n)


def test_sections():
    text = "intro\n# A\na\n## B\nb\n```\n# no\n```\n# C\nc"
    assert [(p, a, b) for p, _, a, b in chunking.sections(text, fences=True)] == [("", 1, 1), ("A", 2, 3), ("A > B", 4, 8), ("C", 9, 10)]
    assert [p for p, *_ in chunking.sections(text)][-2:] == ["no", "C"]


def test_markdown_rows():
    text = "---\ntags: [x, y]\nproject: p\n---\nFirst words.\n\n# Head\nbody"
    rows = list(chunking.markdown_rows("v/note.md", text))
    assert rows[0][:2] == (0, "file_summary") and "First words." in rows[0][3] and "tags: x,y" in rows[0][3]
    assert [(r[1], r[2], r[4]) for r in rows[1:]] == [("paragraph", "", 5), ("heading_section", "Head", 7)]


def test_code_rows():
    code = '"""Doc."""\nimport os\n\n@wrap\ndef f():\n    return 1\n\nclass A:\n    """About."""\n    def m(self):\n        pass\n'
    rows = list(chunking.code_rows("a/b.py", code, "python"))
    assert [(k, s, a, b) for k, s, _, a, b in rows] == [("function", "f", 4, 6), ("class", "A", 8, 11), ("method", "A.m", 10, 11), ("module_summary", "b.py", 1, 11)]
    assert [r[1] for r in chunking.code_rows("x.rs", "pub fn a() {}\nstruct B;\n", "rust")] == ["a", "B", "x.rs"]
    assert [r[2] for r in chunking.code_rows("x.sql", "select 1;\n\nselect 2", "sql")] == ["select 1;", "select 2"]
    assert [(r[0], r[3], r[4]) for r in chunking.code_rows("x.yaml", "a: 1\nb: 2\n\nc: 3", "yaml")] == [("config", 1, 2), ("config", 4, 4)]
    assert [r[0] for r in chunking.code_rows("x.py", "def (:\n", "python")] == ["paragraph"]


def test_merge_small():
    assert [(a, b, n) for _, a, b, n in chunking.merge_small([("a", 1, 1, 10), ("b", 2, 2, 60), ("c", 3, 3, 70)])] == [(1, 2, 70), (3, 3, 70)]


def test_long_code_parts_are_cut_into_windows():
    body = "\n".join(f"    x{i} = {i} + {i} * y" for i in range(300))
    text = f"import os\n\n\ndef long(y):\n{body}\n    return y\n\n\ndef short():\n    return 1\n"
    lines, out = text.splitlines(), list(chunking.code_rows("a.py", text, "python"))
    parts = [r for r in out if r[1] == "long"]
    assert len(parts) > 1 and parts[0][3] == 4 and parts[-1][4] == 305 and [r[1:] for r in out if r[1] == "short"] == [("short", "def short():\n    return 1", 308, 309)]
    for kind, _, chunk, a, b in parts:
        assert kind == "function" and chunk == "\n".join(lines[a - 1 : b]) and sum(map(chunking.tokens_of, chunk.splitlines())) <= 400
    assert {n for *_, a, b in parts for n in range(a, b + 1)} == set(range(4, 306))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["", "", "a b c", "# H", "  ", "x"]), max_size=20), st.integers(3, 9))
def test_spans_are_the_lines_of_the_text(lines, most):
    text = "\n".join(lines)
    for body, a, b, _ in chunking.windows(text, most, 1):
        assert body == "\n".join(text.splitlines()[a - 1 : b])
    for _, body, a, b in chunking.sections(text):
        assert body == "\n".join(text.splitlines()[a - 1 : b])
    assert not chunking.windows("\n\na\nb") or chunking.windows("\n\na\nb") == [("a\nb", 3, 4, 2)]


def test_batches_are_bounded_in_bytes(spark):
    """300 files of 100 kB do not reach Python as one batch, and have all their chunks."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    files = spark.range(300, numPartitions=1).selectExpr("cast(id as string) AS file_path", "'b.md' AS path", "concat('# h', id, '\n', repeat('word and ', 11000)) AS content")
    chunks = chunking.markdown_chunks(files)
    sizes = files.select("content").mapInPandas(lambda frames: (pd.DataFrame({"n": [int(f["content"].str.len().sum())]}) for f in frames), "n long")
    assert max(r.n for r in sizes.collect()) < 10_000_000
    expected = len(list(chunking.markdown_rows("b.md", "# h0\n" + "word and " * 11000)))
    assert {r["count"] for r in chunks.groupBy("file_path").count().collect()} == {expected} and chunks.select("file_path").distinct().count() == 300
