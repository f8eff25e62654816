"""Entity redaction: recognisers, overlap, typed placeholders and counts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.session import ship
from . import fixed

_SPAN = "array<struct<start:int,size:int,less:double,name:string>>"


def _spans_of(text: Column, name: str, pattern: str, score: float) -> Column:
    """Where a recogniser's matches start, from the lengths of what lies between them."""
    pattern = f"(?i){pattern}"
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.slice(F.split(text, pattern), 1, F.size(hits)), hits, lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("size")))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))
    span = lambda s, p: F.struct((s.at + p.gap).alias("start"), p["size"].alias("size"), F.lit(-score).alias("less"), F.lit(name).alias("name"))
    return F.aggregate(pairs, begin, lambda s, p: F.struct((s.at + p.gap + p["size"]).alias("at"), F.concat(s.out, F.array(span(s, p))).alias("out")))["out"]


def spans(text: Column) -> Column:
    """(start, size, less, name) of a text's entities, in order.

    Of those that overlap the earliest stays, then the longest, then the surest: a sweep in
    that order keeps what begins at or after the end of all that it has kept.
    """
    every = F.concat(*[_spans_of(text, *r) for r in fixed.RECOGNISERS])
    ordered = F.array_sort(F.transform(every, lambda s: F.struct(s.start.alias("start"), (-s["size"]).alias("size"), s.less.alias("less"), s["name"].alias("name"))))
    begin = F.struct(F.lit(0).alias("end"), F.array().cast(_SPAN).alias("out"))
    kept = F.aggregate(ordered, begin, lambda s, c: F.when(c.start < s.end, s).otherwise(F.struct((c.start - c["size"]).alias("end"), F.concat(s.out, F.array(F.struct(c.start.alias("start"), (-c["size"]).alias("size"), c.less.alias("less"), c["name"].alias("name")))).alias("out"))))["out"]
    any_of = "(?i)" + "|".join(p for _, p, _ in fixed.RECOGNISERS)
    return F.when(text.rlike(any_of), kept).otherwise(F.array().cast(_SPAN))  # most texts have none


def masked(text: Column, found: Column) -> Column:
    """A text with a placeholder of the entity's name in place of each of the ``found`` spans."""
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(found, begin, lambda s, c: F.struct((c.start + c["size"]).alias("at"), F.concat(s.out, F.substring(text, s.at + 1, c.start - s.at), F.lit(fixed.REDACTED[0]), c["name"], F.lit(fixed.REDACTED[1])).alias("out")))
    return F.when(F.size(found) == 0, text).otherwise(F.concat(done.out, F.substring(text, done.at + 1, F.length(text))))


def scrubbed(rows: DataFrame, column: str = "content") -> DataFrame:
    """``rows`` with the column scrubbed and entities, the names of what was found, in order.

    Embeddings of scrubbed rows are those of the old text; embed again what has entities.
    """
    made = rows.withColumn("_spans", F.coalesce(spans(F.col(column)), F.array().cast(_SPAN)))
    return made.select(*[masked(F.col(column), F.col("_spans")).alias(c) if c == column else F.col(c) for c in rows.columns], F.col("_spans.name").alias("entities"))


def entity_counts(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n"))


def printable(data: bytes, least: int = 6) -> list[str]:
    """Runs of printable text in binary data, such as the strings of an unknown protocol buffer."""
    text = data.decode("utf-8", "replace")
    return [m.strip() for m in re.findall(rf"[^\x00-\x08\x0b-\x1f\x7f�]{{{least},}}", text) if m.strip()]


def printable_strings(rows: DataFrame, column: str, encoded: bool = False) -> DataFrame:
    """(id, strings) of binary or, with ``encoded``, base64 columns; strings may be base64 again, once."""
    ship(rows.sparkSession)
    data = F.try_to_binary(F.col(column), F.lit("base64")) if encoded else F.col(column)

    @F.pandas_udf("array<string>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import base64
        import binascii

        def deep(raw: bytes) -> list[str]:
            out = []
            for text in printable(raw):
                if re.fullmatch(r"[A-Za-z0-9+/=_-]{80,}", text):
                    try:
                        out += printable(base64.b64decode(text + "=" * (-len(text) % 4)))
                        continue
                    except (binascii.Error, ValueError):
                        pass
                out.append(text)
            return out

        for part in parts:
            yield pd.Series([deep(bytes(x)) if x is not None else [] for x in part])

    return rows.select("id", run(data).alias("strings"))
