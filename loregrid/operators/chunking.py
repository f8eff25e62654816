"""Chunkers and parsers that make several rows of a file: windows, markdown, code."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..plans.session import ship


def tokens_of(line: str) -> int:
    """The offline token count of a line: its words."""
    return len(line.split())


def windows(text: str | None, most: int = fixed.CHUNK_TOKENS, overlap: int = fixed.CHUNK_OVERLAP, start: int = 1) -> list[tuple[str, int, int, int]]:
    """(text, first line, last line, tokens) of windows of whole lines.

    A window takes lines while it stays within ``most`` tokens. The next one begins with the
    last lines of it that fit into ``overlap``, but always after its first line. A line of
    more than ``most`` tokens is cut into windows of ``most`` at a stride of most - overlap.
    """
    if not text or not text.strip():
        return []
    lines, out, at = text.splitlines(), [], 0
    cost = [tokens_of(x) for x in lines]
    while at < len(lines):
        if cost[at] > most:
            words, stride = lines[at].split(), max(1, most - overlap)
            for k in range(0, max(1, len(words) - overlap), stride):
                part = words[k : k + most]
                out.append((" ".join(part), start + at, start + at, len(part)))
            at += 1
            continue
        end, total = at, 0
        while end < len(lines) and (total == 0 or total + cost[end] <= most) and cost[end] <= most and total < most:
            total += cost[end]
            end += 1
        low, high = _within(lines, at, end)
        body = "\n".join(lines[low:high])
        if body.strip():
            out.append((body, start + low, start + high - 1, max(1, total)))
        if end >= len(lines):
            break
        back, kept = end, 0
        while back - 1 > at and kept < overlap and (kept == 0 or kept + cost[back - 1] <= overlap):
            back -= 1
            kept += cost[back]
        at = back
    return out


def _within(lines: list[str], low: int, high: int) -> tuple[int, int]:
    """``low`` and ``high`` without the empty lines at both ends."""
    while low < high and not lines[low]:
        low += 1
    while low < high and not lines[high - 1]:
        high -= 1
    return low, high


def merge_small(chunks: list[tuple[str, int, int, int]], least: int = 50) -> list[tuple[str, int, int, int]]:
    """Chunks of fewer than ``least`` tokens joined to the one before them."""
    out: list[tuple[str, int, int, int]] = []
    for body, first, last, n in chunks:
        if out and (n < least or out[-1][3] < least):
            old = out.pop()
            out.append((f"{old[0]}\n{body}", old[1], last, old[3] + n))
        else:
            out.append((body, first, last, n))
    return out


def sections(text: str, start: int = 1, fences: bool = False) -> list[tuple[str, str, int, int]]:
    """(heading path, text, first line, last line) of the sections of a markdown text.

    A heading ends the headings of its own and deeper levels. With ``fences`` headings
    inside fenced code do not count.
    """
    out, stack, body, first, fenced = [], [], [], start, False

    def flush() -> None:
        if "".join(body).strip():
            low, high = _within(body, 0, len(body))
            out.append((" > ".join(t for _, t in stack), "\n".join(body[low:high]), first + low, first + high - 1))

    for no, line in enumerate(text.splitlines(), start):
        fenced ^= line.lstrip().startswith("```")
        if (m := re.match(r"(#{1,6})\s+(.*\S)\s*$", line)) and not (fences and fenced):
            flush()
            level = len(m[1])
            stack = [*((n, t) for n, t in stack if n < level), (level, m[2])]
            body, first = [], no
        body.append(line)
    flush()
    return out


def front_matter(text: str) -> tuple[dict[str, str], str, int]:
    """(fields, rest, lines taken) of a text that may begin with a block of key: value lines."""
    if not (m := re.match(r"(?s)---\n(.*?)\n---\n?", text)):
        return {}, text, 0
    fields, key = {}, None
    for line in m[1].splitlines():
        if item := re.match(r"\s*-\s+(.*)", line):
            if key:
                fields[key] = f"{fields[key]},{item[1].strip()}".strip(",")
        elif pair := re.match(r"([\w-]+):\s*(.*)", line):
            key = pair[1]
            fields[key] = pair[2].strip().strip("[]\"'").replace(", ", ",")
    return fields, text[m.end() :], m[0].count("\n")


def markdown_rows(path: str, text: str | None) -> Iterator[tuple]:
    """(index, type, heading path, text, first, last): a summary, then sections in windows."""
    if not text or not text.strip():
        return
    fields, rest, taken = front_matter(text)
    parts = sections(rest, 1 + taken)
    stem = path.rsplit("/", 1)[-1].removesuffix(".md")
    heads = [p.rsplit(" > ", 1)[-1] for p, *_ in parts if p]
    first = next((b.strip() for b in rest.split("\n\n") if b.strip() and not b.lstrip().startswith(("#", "```"))), "")
    summary = [stem, *(f"{k}: {v}" for k, v in sorted(fields.items())), first, *heads]
    yield 0, "file_summary", "", "\n".join(x for x in summary if x), 1, 1
    index = 1
    for where, body, low, high in parts:
        whole = [(body, low, high, 0)] if sum(map(tokens_of, body.splitlines())) <= fixed.CHUNK_TOKENS else windows(body, start=low)
        for chunk, a, b, _ in whole:
            yield index, "heading_section" if where else "paragraph", where, chunk, a, b
            index += 1


_DEFINITIONS = {
    "javascript": r"(?m)^(?:export\s+)?(?:default\s+)?(?:async\s+)?(function|class)\s+(\w+)", "typescript": r"(?m)^(?:export\s+)?(?:abstract\s+)?(?:async\s+)?(function|class|interface)\s+(\w+)",
    "rust": r"(?m)^(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(fn|struct|enum|trait)\s+(\w+)", "go": r"(?m)^(func|type)\s+(?:\([^)]*\)\s*)?(\w+)",
    "c": r"(?m)^(?:static\s+)?[\w*]+\s+(\*?)(\w+)\s*\([^;]*\)\s*\{", "cpp": r"(?m)^(class|struct|[\w:*&<>]+)\s+([\w:]+)\s*(?:\([^;]*\)\s*)?\{", "bash": r"(?m)^(function\s+)?([\w-]+)\s*\(\)\s*\{",
}


def code_rows(path: str, text: str | None, language: str) -> Iterator[tuple]:
    """(type, symbol, text, first, last) of a source: its parts, those above ``CHUNK_TOKENS`` in windows."""
    for kind, symbol, body, low, high in _code_parts(path, text, language):
        if sum(map(tokens_of, body.splitlines())) <= fixed.CHUNK_TOKENS:
            yield kind, symbol, body, low, high
            continue
        made = kind == "module_summary" or (kind == "class" and language == "python")  # not the lines of the file
        for chunk, a, b, _ in windows(body, start=low):
            yield kind, symbol, chunk, *((low, high) if made else (a, b))


def _code_parts(path: str, text: str | None, language: str) -> Iterator[tuple]:
    """(type, symbol, text, first, last): functions, classes, methods, a module summary, whole.

    Python is parsed; other languages are cut at their definitions, and SQL, configuration
    and anything unparsable at statements or blank lines.
    """
    if not text or not text.strip():
        return
    lines = text.splitlines()
    cut = lambda a, b: "\n".join(lines[a - 1 : b])
    if language == "python":
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            tree = None
        if tree is not None:
            names = []
            for node in tree.body:
                if not isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                    continue
                begin = min([node.lineno, *(d.lineno for d in node.decorator_list)])
                names.append(node.name)
                if not isinstance(node, ast.ClassDef):
                    yield "function", node.name, cut(begin, node.end_lineno), begin, node.end_lineno
                    continue
                methods = [m for m in node.body if isinstance(m, ast.FunctionDef | ast.AsyncFunctionDef)]
                doc = ast.get_docstring(node) or ""
                yield "class", node.name, "\n".join([f"class {node.name}", doc, *(f"method {m.name}" for m in methods)]), begin, node.end_lineno
                for m in methods:
                    low = min([m.lineno, *(d.lineno for d in m.decorator_list)])
                    yield "method", f"{node.name}.{m.name}", cut(low, m.end_lineno), low, m.end_lineno
            yield "module_summary", path.rsplit("/", 1)[-1], "\n".join([path, ast.get_docstring(tree) or "", *names]), 1, len(lines)
            return
    if language in _DEFINITIONS and (found := list(re.finditer(_DEFINITIONS[language], text))):
        starts = [text.count("\n", 0, m.start()) + 1 for m in found]
        for m, a, b in zip(found, starts, [*(s - 1 for s in starts[1:]), len(lines)], strict=True):
            kind = "class" if m[1] in ("class", "struct", "interface", "enum", "trait", "type") else "function"
            yield kind, m[2], cut(a, b).rstrip(), a, b
        yield "module_summary", path.rsplit("/", 1)[-1], "\n".join([path, *(m[2] for m in found)]), 1, len(lines)
        return
    pattern = r"[^;]+;?" if language == "sql" else r"(?:[^\n]*\S[^\n]*(?:\n|$))+"
    for m in re.finditer(pattern, text):
        if m[0].strip():
            lead = len(m[0]) - len(m[0].lstrip())
            a = text.count("\n", 0, m.start() + lead) + 1
            yield "config" if language in ("yaml", "toml", "json") else "paragraph", "", m[0].strip(), a, a + m[0].strip().count("\n")


#: Characters of texts whose rows are handed on together.
HANDED = 1 << 20


def _exploded(rows: DataFrame, make, columns: list[str], schema: str, *inputs: str) -> DataFrame:
    """``make`` applied to each row's inputs; its tuples become rows, with the key column first.

    What a task holds is bounded by ``ship``'s batches, and of its results by ``HANDED`` characters.
    """
    ship(rows.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out, size = [], 0
            for key, *args in frame.itertuples(index=False):
                out += [(key, *r) for r in make(*args)]
                size += sum(len(a) for a in args if isinstance(a, str))
                if size >= HANDED or len(out) >= 2000:
                    yield pd.DataFrame(out, columns=columns)
                    out, size = [], 0
            if out:
                yield pd.DataFrame(out, columns=columns)

    return rows.select(*inputs).mapInPandas(run, schema)


def file_lines(files: DataFrame) -> DataFrame:
    """(file_path, no, line): the lines of every file (file_path, content), counted from 1."""
    return files.select("file_path", F.posexplode(F.split("content", r"\r\n|\r|\n")).alias("no", "line")).withColumn("no", F.col("no") + 1)


def line_window(lines: DataFrame, start: int, count: int) -> DataFrame:
    """``count`` lines from ``start`` on, within the bounds of the file."""
    first = max(1, start)
    return lines.where(F.col("no").between(first, start + count - 1))


def chunk_texts(rows: DataFrame, most: int = fixed.CHUNK_TOKENS, overlap: int = fixed.CHUNK_OVERLAP) -> DataFrame:
    """(id, chunk_index, text, start_line, end_line, tokens) of the windows of (id, content)."""
    make = lambda t: ((i, *w) for i, w in enumerate(windows(t, most, overlap)))
    return _exploded(rows, make, ["id", "chunk_index", "text", "start_line", "end_line", "tokens"], "id string, chunk_index int, text string, start_line int, end_line int, tokens int", "id", "content")


def markdown_chunks(files: DataFrame) -> DataFrame:
    """Chunks of markdown files (file_path, path, content): summary, sections, line spans."""
    return _exploded(files, markdown_rows, ["file_path", "chunk_index", "chunk_type", "heading_path", "content", "start_line", "end_line"], "file_path string, chunk_index int, chunk_type string, heading_path string, content string, start_line int, end_line int", "file_path", "path", "content")


def code_chunks(files: DataFrame) -> DataFrame:
    """Chunks of sources (file_path, path, content, language): symbols and their line spans."""
    make = lambda p, t, g: ((i, *r) for i, r in enumerate(code_rows(p, t, g)))
    return _exploded(files, make, ["file_path", "chunk_index", "chunk_type", "symbol_name", "content", "start_line", "end_line"], "file_path string, chunk_index int, chunk_type string, symbol_name string, content string, start_line int, end_line int", "file_path", "path", "content", "language")
