"""Scalar functions as Column expressions: ids, cleaning, redaction, links, tags, rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

#: Letters with marks and the letters they fold to, in one order.
ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def terms(text: Column) -> Column:
    """The folded words of a text, in order: runs of letters and digits.

    Texts of one byte a character have nothing to fold, which spares most of them the slow step.
    """
    low = F.lower(text)
    folded = F.when(F.octet_length(low) == F.char_length(low), low).otherwise(F.translate(low, ACCENTED, PLAIN))
    return F.regexp_extract_all(folded, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def short_hash(value: Column, length: int) -> Column:
    """The first hex digits of a SHA-256."""
    return F.substring(F.sha2(value, 256), 1, length)


def chunk_id(source: Column, index: Column) -> Column:
    return short_hash(F.concat_ws("::", source, index.cast("string")), 16)


def exchange_id(path: Column, start: Column, end: Column) -> Column:
    return short_hash(F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string")), 32)


def fingerprint(text: Column) -> Column:
    """SHA-256 of a text stripped, with line ends and runs of blank lines normalised."""
    stripped = F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", "")
    return F.sha2(F.regexp_replace(F.regexp_replace(stripped, r"\r\n?", "\n"), r"\n{3,}", "\n\n"), 256)


def clean_message(text: Column, most: int = 2000) -> Column:
    """A message without tool tags and their content, blank runs collapsed, cut to ``most``."""
    for tag in fixed.MESSAGE_TAGS:
        text = F.regexp_replace(text, f"(?s)<{tag}>.*?</{tag}>", "")
    collapsed = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return F.substring(F.regexp_replace(F.regexp_replace(collapsed, r"^\s+", ""), r"\s+$", ""), 1, most)


def redact(text: Column) -> Column:
    """Control sequences, assignments, token shapes, serials, e-mails and phones masked, in that order."""
    for pattern, mask in (
        (fixed.ANSI, ""), (fixed.SECRET_ASSIGNMENT, "$1=[REDACTED]"), (fixed.SECRET_VALUE, "[REDACTED]"),
        (fixed.DEVICE_SERIAL, "adb -s [DEVICE]"), (fixed.EMAIL, "[EMAIL]"), (fixed.PHONE, "[PHONE]"),
    ):
        text = F.regexp_replace(text, pattern, mask)
    return text


def credential_risk(text: Column) -> Column:
    return text.rlike(fixed.SECRET_ASSIGNMENT) | text.rlike(fixed.SECRET_VALUE)


def _holds(text: Column, phrases: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in phrases])


def _count(text: Column, part: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))


def noise(text: Column) -> Column:
    """Log lines, stack traces, and code-like texts."""
    low = F.lower(text)
    braces = _count(text, "{") + _count(text, "}") + _count(text, ";")
    return F.trim(text).rlike(fixed.RAW_LOG) | _holds(low, ["webpack.cache", "caching failed for pack"]) | text.rlike(fixed.STACK_TRACE) | ((F.length(text) > 120) & (braces > 18)) | (_count(text, "\\n") > 10)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def reusable(text: Column, low: Column | None = None) -> Column:
    """At least five words, no secret named but by a policy, and a signal word or a command."""
    low = F.lower(text) if low is None else low
    return (word_count(text) >= 5) & (~text.rlike(fixed.SECRET_NAME) | _holds(low, fixed.SECRET_POLICY_PHRASES)) & (_holds(low, fixed.SIGNAL_WORDS) | text.rlike(fixed.COMMAND))


def card_type(text: Column, low: Column | None = None) -> Column:
    """The type of a sentence by the first rule that holds, or null; ``low`` is it in lower case."""
    low = F.lower(text) if low is None else low
    out = F.when(text.rlike(fixed.COMMAND), "command").when(text.rlike(fixed.FILE_PATH), "file_path")
    for name, _, _, phrases in fixed.CARD_RULES:
        out = out.when(_holds(low, phrases), name)
    return out


def card_score(kind: Column) -> Column:
    out = F.when(kind == "command", fixed.COMMAND_SCORE).when(kind == "file_path", fixed.PATH_SCORE)
    for name, score, _, _ in fixed.CARD_RULES:
        out = out.when(kind == name, score)
    return out


def card_tags(kind: Column) -> Column:
    out = F.when(kind == "command", F.array(F.lit("command"), F.lit("operator-note"))).when(kind == "file_path", F.array(F.lit("file-path"), F.lit("environment")))
    for name, _, tags, _ in fixed.CARD_RULES:
        out = out.when(kind == name, F.array(*[F.lit(t) for t in tags]))
    return out


def card_status(kind: Column) -> Column:
    out = None
    for name, status in fixed.CARD_STATUS_BY_TYPE.items():
        out = (F if out is None else out).when(kind == name, status)
    return out.otherwise("historical")


def card_trust(status: Column, current: Column) -> Column:
    return F.when(current | status.isin("active_verified", "verified", "current"), "T2").when(status.isin("active", "active_unverified", "resolved", "failed", "open_unverified"), "T3").otherwise("T4")


def confidence(label: Column) -> Column:
    return F.when(label == "high", 0.9).when(label == "low", 0.35).otherwise(0.65)


def card_title(sentence: Column) -> Column:
    """The first ten words without marks, at most 88 characters."""
    words = F.filter(F.split(F.regexp_replace(sentence, r"[`*_#>]", ""), r"\s+"), lambda w: w != "")
    title = F.regexp_replace(F.array_join(F.slice(words, 1, 10), " "), r"[.,:;]+$", "")
    return F.when(F.length(title) > 88, F.concat(F.regexp_replace(F.substring(title, 1, 85), r"\s+$", ""), F.lit("..."))).otherwise(title)


def clip(text: Column, most: int) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, max(most - 3, 20))), F.lit("...")))


def card_identity(kind: Column, project: Column, body: Column) -> Column:
    """A hash of type, project and the first 24 words, for repeated extractions."""
    words = F.filter(F.split(F.regexp_replace(F.lower(body), r"[^\p{L}\p{N}_]+", " "), " "), lambda w: w != "")
    return F.sha2(F.concat(kind, F.lit(":"), F.lower(project), F.lit(":"), F.array_join(F.slice(words, 1, 24), " ")), 256)


def card_hash(*parts: Column) -> Column:
    """The content hash of a card: type, project, title, body, why, conversation, date."""
    kept = [p if i < 2 else F.trim(p) for i, p in enumerate(parts)]
    return F.sha2(F.concat_ws("\n", *[F.coalesce(p, F.lit("")) for p in kept]), 256)


def wiki_links(text: Column) -> Column:
    """The distinct targets of [[links]], sorted."""
    found = F.regexp_extract_all(text, F.lit(r"\[\[([^\]|#]+)(?:#[^\]|]*)?\|?[^\]]*\]\]"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.trim(x))))


def inline_tags(text: Column) -> Column:
    """The distinct #tags outside code, sorted."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)```.*?```", ""), r"`[^`]+`", "")
    return F.array_sort(F.array_distinct(F.regexp_extract_all(bare, F.lit(r"(?:^|\s)#([\w/\-]+)"), F.lit(1))))


def first_paragraph(text: Column) -> Column:
    """The first block that is neither heading nor fence."""
    blocks = F.filter(F.split(text, "\n\n"), lambda b: (F.trim(b) != "") & ~F.startswith(F.ltrim(b), F.lit("#")) & ~F.startswith(F.ltrim(b), F.lit("```")))
    return F.coalesce(F.trim(F.get(blocks, F.lit(0))), F.lit(""))


def note_title(text: Column) -> Column:
    """The first line up to its sentence end, without marks, at most 80 characters."""
    line = F.split_part(F.trim(text), F.lit("\n"), F.lit(1))
    sentence = F.regexp_extract(line, r"^(.*?[.!?])(?:\s|$)", 1)
    bare = F.trim(F.regexp_replace(F.when(sentence == "", line).otherwise(sentence), r"[*_`#]", ""))
    return F.substring(bare, 1, 80)


def sentences(text: Column) -> Column:
    """Candidate sentences of 24 to 700 characters: lines without fences and bullets, long ones split."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)```.*?```", ""), fixed.ANSI, "")
    lines = F.transform(F.split(bare, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:[-*+]|\d+[.)])\s+", "")))
    parts = F.flatten(F.transform(lines, lambda x: F.when(F.length(x) > 220, F.split(x, r"(?<=[.!?])\s+")).otherwise(F.array(x))))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda s: F.length(s).between(24, 700))


def imports(code: Column, language: Column) -> Column:
    """The modules that code of a language imports, distinct, sorted, joined by commas."""
    out = None
    for name, pattern in fixed.IMPORTS.items():
        found = F.regexp_extract_all(code, F.lit(pattern), F.lit(1))
        out = (F if out is None else out).when(language == name, F.array_join(F.array_sort(F.array_distinct(found)), ","))
    return out.otherwise("")


def language_of(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = None
    for name, language in fixed.LANGUAGES.items():
        out = (F if out is None else out).when(suffix == name, language)
    return out.otherwise("unknown")


def project_of(path: Column) -> Column:
    """The path part after ``projects`` or ``conversation-archive``, else empty."""
    return F.regexp_extract(path, r"/(?:projects|conversation-archive)/([^/]+)", 1)


def safe_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", "")


def trust_weight(level: Column) -> Column:
    out = None
    for name, weight in fixed.TRUST_WEIGHTS.items():
        out = (F if out is None else out).when(level == name, F.lit(weight))
    return out.otherwise(F.lit(fixed.OTHER_WEIGHT))


def card_status_weight(status: Column, current: Column) -> Column:
    out = None
    for name, weight in fixed.CARD_STATUS_WEIGHTS.items():
        out = (F if out is None else out).when(status == name, F.lit(weight))
    return out.otherwise(F.lit(fixed.OTHER_WEIGHT)) * F.when(current, F.lit(1.0)).otherwise(F.lit(fixed.NOT_CURRENT_WEIGHT))


def project_of_uri(uri: Column) -> Column:
    """The last folder of a workspace URI, decoded."""
    path = F.rtrim(F.regexp_replace(F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))), r"^[a-z-]+://[^/]*", ""), F.lit("/"))
    return F.element_at(F.split(path, "/"), -1)


def instant(value: Column) -> Column:
    """A time from epoch seconds or, above 1e10, milliseconds."""
    number = F.try_to_number(value, F.lit("9999999999999999")).cast("long")
    return F.when(number > 10_000_000_000, F.timestamp_millis(number)).otherwise(F.timestamp_seconds(number))


def line_span(source_lines: Column) -> Column:
    """(first, last) of the numbers in a description of lines such as ``L12-L20, 31``."""
    numbers = F.transform(F.regexp_extract_all(source_lines, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int"))
    return F.struct(F.array_min(numbers).alias("first"), F.array_max(numbers).alias("last"))


def first_heading(markdown: Column) -> Column:
    return F.trim(F.regexp_extract(markdown, r"(?m)^#{1,6}\s+(.+)$", 1))


def basic_category(user: Column, tools: Column, errors: Column) -> Column:
    """What an exchange is about, from its words, tools and errors; later rules win."""
    low = F.lower(F.coalesce(user, F.lit("")))
    edited = F.arrays_overlap(tools, F.array(*[F.lit(t) for t in ("Edit", "Write", "MultiEdit")]))
    rules = [(F.lit(True), "discussion"), (F.size(tools) > 0, "exploration"), (edited, "implementation"), (_holds(low, ["test", "verify"]), "testing"), (_holds(low, ["deploy", "release"]), "deployment"), ((errors > 0) | _holds(low, ["error", "bug", "fix"]), "debugging")]
    out = None
    for condition, name in reversed(rules):
        out = (F if out is None else out).when(condition, name)
    return out


def clean_for_enrichment(text: Column, most: int = 4000) -> Column:
    """A message without any paired tag and its content, cut with a mark that says so."""
    bare = F.regexp_replace(text, r"(?s)<([a-zA-Z][\w-]*)>.*?</\1>", "")
    flat = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"\n{3,}", "\n\n"), r"^\s+", ""), r"\s+$", "")
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("... [truncated]"))).otherwise(flat)


def boosted(score: Column, confirmed: Column, severity: Column) -> Column:
    """The optional boost of notes: a tenth if confirmed, a twentieth if critical, 1 at most."""
    return F.least(F.lit(1.0), score * F.when(confirmed, 1.1).otherwise(1.0) * F.when(severity == "critical", 1.05).otherwise(1.0))


def extraction_prompt(instructions: str, conversation: Column, title: Column, date: Column) -> Column:
    """What a language model is asked for one conversation."""
    return F.concat_ws("\n\n", F.lit(instructions), F.concat(F.lit("Title: "), title), F.concat(F.lit("Date: "), date), F.concat(F.lit("Conversation:\n"), conversation), F.lit("Answer with one JSON document."))


def card_text(project: Column, kind: Column, title: Column, status: Column, confidence: Column, current_truth: Column, tags: Column, body: Column, why: Column, source: Column) -> Column:
    """The text of a card that is embedded and indexed; lines without a value are left out."""
    said = lambda c: F.coalesce(c, F.lit(""))
    line = lambda label, c: F.concat(F.lit(f"{label}: "), said(c))
    some = lambda label, c: F.when(said(c) != "", line(label, c))
    truth = F.when(current_truth, "True").otherwise("False")
    return F.concat_ws("\n", line("Project", project), line("Type", kind), line("Title", title), line("Status", status), line("Confidence", confidence), line("Current truth", truth), some("Tags", F.regexp_replace(tags, r",\s*", ", ")), some("Body", body), some("Why", why), some("Source", source))
