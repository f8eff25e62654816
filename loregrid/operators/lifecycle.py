"""Upserts and life cycles of notes, records and cards, as plans over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def upsert(target: DataFrame, source: DataFrame, *keys: str) -> DataFrame:
    """``target`` with the rows of ``source`` in place of those of the same keys."""
    return target.join(source.select(*keys), list(keys), "left_anti").unionByName(source, allowMissingColumns=True)


def patch(target: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``target`` with the non-null values of ``changes`` over its own; unknown fields are ignored."""
    known = [c for c in changes.columns if c != key and c in target.columns]
    new = changes.select(key, *[F.col(c).alias(f"new_{c}") for c in known])
    joined = target.join(new, key, "left")
    return joined.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in known else F.col(c) for c in target.columns])


def delete(target: DataFrame, ids: DataFrame | None = None, where: Column | None = None, key: str = "chunk_id") -> DataFrame:
    """``target`` without the given ids and without rows for which ``where`` holds; neither: all of it."""
    if ids is not None:
        target = target.join(ids.select(key), key, "left_anti")
    return target if where is None else target.where(~F.coalesce(where, F.lit(False)))


def changed_files(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Files whose (path, hash) is not stored yet."""
    return found.join(stored.select("file_path", "content_hash"), ["file_path", "content_hash"], "left_anti")


def replace_files(chunks: DataFrame, fresh: DataFrame) -> DataFrame:
    """``chunks`` with all chunks of the files in ``fresh`` replaced by it."""
    return chunks.join(fresh.select("file_path").distinct(), "file_path", "left_anti").unionByName(fresh, allowMissingColumns=True)


def cards_to_put(cards: DataFrame, fresh: DataFrame) -> DataFrame:
    """``fresh`` cards, one a content; one with a stored content hash takes over that card's id and creation time."""
    last = Window.partitionBy("content_hash").orderBy(F.desc("updated_at"), "card_id")
    fresh = fresh.withColumn("r_", F.row_number().over(last)).where("r_ = 1").drop("r_")
    old = cards.groupBy("content_hash").agg(F.min_by(F.struct("card_id", "created_at"), "card_id").alias("old"))
    moved = fresh.join(old, "content_hash", "left").withColumn("card_id", F.coalesce("old.card_id", "card_id")).withColumn("created_at", F.coalesce("old.created_at", "created_at")).drop("old")
    kept = moved.join(cards.select("card_id", F.col("created_at").alias("was")), "card_id", "left").withColumn("created_at", F.coalesce("was", "created_at")).drop("was")
    return kept.select(*cards.columns)


def upsert_cards(cards: DataFrame, fresh: DataFrame) -> DataFrame:
    """Cards by id, those of ``cards_to_put`` in place of the stored ones."""
    return upsert(cards, cards_to_put(cards, fresh), "card_id")


def confirm(notes: DataFrame, ids: DataFrame, as_of: str) -> DataFrame:
    """The given notes confirmed: curated trust, confidence of 0.9 at least."""
    hit = F.col("hit").isNotNull()
    rows = notes.join(ids.select("note_id").distinct().withColumn("hit", F.lit(True)), "note_id", "left")
    return rows.withColumn("confirmed", hit | F.col("confirmed")).withColumn("trust_level", F.when(hit, "T2").otherwise(F.col("trust_level"))).withColumn("confidence", F.when(hit, F.greatest("confidence", F.lit(0.9))).otherwise(F.col("confidence"))).withColumn("updated_at", F.when(hit, as_of).otherwise(F.col("updated_at"))).drop("hit")


def record_type(category: Column) -> Column:
    """What a note of a category is promoted to."""
    return F.when(category.isin("workaround", "config"), "runbook").when(category.isin("pattern", "dependency"), "project_overview").otherwise("fact")


def suggest_promotions(notes: DataFrame, limit: int = 20) -> DataFrame:
    """Confirmed notes that are not promoted, with the type and title they would get."""
    rows = notes.where("confirmed AND NOT promoted")
    return rows.select("note_id", "project", record_type(F.col("category")).alias("record_type"), F.substring(F.split_part("content", F.lit("\n"), F.lit(1)), 1, 120).alias("title")).orderBy("note_id").limit(limit)


def promote(notes: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(notes, records): the confirmed notes promoted, and the records made of them, linked both ways."""
    ready = F.col("confirmed") & ~F.col("promoted")
    kind = record_type(F.col("category"))
    record_id = F.concat(F.lit("semantic_"), kind, F.lit("_"), text.short_hash(F.col("note_id"), 32))
    records = notes.where(ready).select(
        record_id.alias("record_id"), kind.alias("record_type"), "project", "content", F.lit("T2").alias("trust_level"), F.lit("active").alias("status"), F.greatest("confidence", F.lit(0.9)).alias("confidence"),
        F.array("category", "severity").alias("tags"), F.col("note_id").alias("linked_note"), F.lit("").alias("superseded_by"), F.lit(as_of).alias("reviewed_at"),
    )
    after = notes.withColumn("linked_record", F.when(ready, record_id).otherwise(F.col("linked_record"))).withColumn("promoted", ready | F.col("promoted"))
    return after, records


def supersede(records: DataFrame, pairs: DataFrame, as_of: str) -> DataFrame:
    """Records with those in ``pairs`` (record_id, superseded_by) superseded and reviewed now."""
    joined = records.join(pairs.select("record_id", F.col("superseded_by").alias("by")), "record_id", "left")
    hit = F.col("by").isNotNull()
    out = joined.withColumn("status", F.when(hit, "superseded").otherwise(F.col("status"))).withColumn("superseded_by", F.coalesce("by", "superseded_by")).withColumn("reviewed_at", F.when(hit, as_of).otherwise(F.col("reviewed_at")))
    return out.select(*records.columns)


def merge_near_notes(notes: DataFrame, fresh: DataFrame, pairs: DataFrame) -> DataFrame:
    """``notes`` after ``fresh`` ones came: near ones are merged, others added.

    ``pairs`` has (note_id, near_id, distance): each fresh note's nearest stored one within
    the limit. A merged note keeps its id and content; new contexts that it does not contain
    are appended in order of their ids.
    """
    close = pairs.join(fresh, "note_id").groupBy(F.col("near_id").alias("note_id")).agg(F.transform(F.array_sort(F.collect_set(F.struct("note_id", "context"))), lambda x: x["context"]).alias("contexts"), F.max("updated_at").alias("now"))
    joined = notes.join(close, "note_id", "left")
    grown = F.aggregate(F.coalesce("contexts", F.array().cast("array<string>")), F.coalesce("context", F.lit("")), lambda s, c: F.when((F.coalesce(c, F.lit("")) == "") | F.contains(s, F.coalesce(c, F.lit(""))), s).when(s == "", c).otherwise(F.concat(s, F.lit("\n\n---\n\n"), c)))
    merged = joined.withColumn("context", grown).withColumn("updated_at", F.coalesce("now", "updated_at")).select(*notes.columns)
    return merged.unionByName(fresh.join(pairs.select("note_id"), "note_id", "left_anti"), allowMissingColumns=True)


def note_file(project: Column, category: Column, created: Column, note_id: Column, folder: str) -> Column:
    """Where a promoted note is written."""
    return F.concat(F.lit(f"{folder}/"), text.safe_name(project), F.lit("/"), category, F.lit("_"), F.date_format(created, "yyyyMMdd"), F.lit("_"), F.substring(note_id, 1, 8), F.lit(".md"))


def note_markdown(title: Column, project: Column, category: Column, severity: Column, content: Column) -> Column:
    """A promoted note with its front matter."""
    return F.concat_ws("\n", F.lit("---"), F.concat(F.lit("project: "), project), F.concat(F.lit("category: "), category), F.concat(F.lit("severity: "), severity), F.lit("---"), F.lit(""), F.concat(F.lit("# "), title), F.lit(""), content)
