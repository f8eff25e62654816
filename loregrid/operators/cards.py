"""Memory cards: rules over sentences, ranking, normalising extractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

EXTRACTION = "conversation_summary struct<title:string,date:string,projects_detected:array<string>,summary:string,key_takeaways:array<string>>, memory_cards array<struct<type:string,project:string,title:string,body:string,why:string,status:string,confidence:string,current_truth:boolean,needs_repo_confirmation:boolean,source:struct<conversation_title:string,conversation_date:string,message_refs:array<string>>,tags:array<string>>>, possible_conflicts array<struct<new_item:string,conflicts_with:string,reason:string,recommended_action:string>>, discarded_noise array<struct<content_type:string,reason:string,count:bigint>>"
#: Statuses that extraction from history may set.
SAFE_STATUSES = ["active_unverified", "open_unverified", "historical", "superseded_candidate", "superseded", "failed", "resolved", "cancelled"]


def candidates(messages: DataFrame) -> DataFrame:
    """Sentences of (id, project, role, date, content) with what the rules make of them.

    verdict is credential, noise, no_signal, unclassified or card; only cards have a type.
    """
    # redaction happens before the explode: a filter that is pushed down would repeat it for every rule
    made = F.transform(text.sentences(F.col("content")), lambda x: F.struct(x.alias("sentence"), text.redact(x).alias("clean")))
    low = F.transform(made, lambda x: F.struct(x["sentence"].alias("sentence"), x["clean"].alias("clean"), F.lower(x["clean"]).alias("low")))
    each = messages.select("id", "project", "role", "date", F.posexplode(low).alias("seq", "s")).select("id", "project", "role", "date", "seq", "s.sentence", "s.clean", "s.low")
    first = each.withColumn("type", text.card_type(F.col("clean"), F.col("low")))
    verdict = F.when(text.credential_risk(F.col("sentence")), "credential").when(text.noise(F.col("sentence")), "noise").when(~text.reusable(F.col("clean"), F.col("low")), "no_signal").when(F.col("type").isNull(), "unclassified").otherwise("card")
    return first.withColumn("verdict", verdict)


def cards(messages: DataFrame, most: int = 40) -> DataFrame:
    """The best cards of messages: one for each identity, by score, date and title, descending."""
    found = candidates(messages).where("verdict = 'card'")
    kind = F.col("type")
    scored = found.select(
        "id", "seq", "project", "date", kind, text.card_title(F.col("clean")).alias("title"), text.clip(F.col("clean"), 500).alias("body"),
        (text.card_score(kind) + F.when(F.col("role") == "user", 2).otherwise(0)).alias("score"), F.when(F.col("role") == "user", "medium").otherwise("low").alias("confidence"),
        text.card_status(kind).alias("status"), F.array_join(text.card_tags(kind), ",").alias("tags"), text.card_identity(kind, F.col("project"), F.col("clean")).alias("identity"),
    )
    best = Window.partitionBy("identity").orderBy(F.desc("score"), F.desc("date"), "id", "seq")
    one = scored.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")
    flagged = one.withColumn("current_truth", F.lit(False)).withColumn("needs_confirmation", F.lit(True))
    return flagged.orderBy(F.desc("score"), F.desc("date"), F.desc("title"), "identity").limit(most)


def from_extraction(payloads: DataFrame) -> DataFrame:
    """Cards of extraction JSON (source_id, payload), and one of each summary; lists are kept."""
    parsed = payloads.select("source_id", F.from_json(F.regexp_extract("payload", r"(?s)(\{.*\})", 1), EXTRACTION).alias("p"))
    items = parsed.select("source_id", F.explode("p.memory_cards").alias("c")).select("source_id", "c.type", "c.project", "c.title", "c.body", "c.why", "c.status", "c.confidence", "c.current_truth", "c.tags")
    s = F.col("p.conversation_summary")
    summary = parsed.where(F.coalesce(s["summary"], F.lit("")) != "").select("source_id", F.lit("summary").alias("type"), F.coalesce(F.get(s["projects_detected"], F.lit(0)), F.lit("Unknown")).alias("project"), s["title"].alias("title"), s["summary"].alias("body"), F.lit("").alias("why"), F.lit("historical").alias("status"), F.lit("medium").alias("confidence"), F.lit(False).alias("current_truth"), F.array().cast("array<string>").alias("tags"))
    valid = items.unionByName(summary).where("trim(title) <> '' AND trim(body) <> ''")
    hashed = text.card_hash(F.col("type"), F.col("project"), F.col("title"), F.col("body"), F.col("why"), F.col("source_id"), F.lit(""))
    return valid.withColumn("content_hash", hashed).withColumn("card_id", F.concat(F.lit("mem_"), F.substring("content_hash", 1, 24)))


def low_trust(found: DataFrame) -> DataFrame:
    """Cards from history: never current, to be confirmed, and of a safe status."""
    status = F.when(F.col("status").isin(SAFE_STATUSES), F.col("status")).otherwise("active_unverified")
    return found.withColumn("status", status).withColumn("current_truth", F.lit(False)).withColumn("needs_confirmation", F.lit(True))


def discarded(found: DataFrame) -> DataFrame:
    """How many sentences were dropped, by reason."""
    return found.where("verdict IN ('credential', 'noise')").groupBy("verdict").agg(F.count("*").alias("n"))


def enriched_by(rows: DataFrame, ask) -> DataFrame:
    """Exchanges (exchange_id, prompt) with summary, category and intent as a model answers in JSON.

    ``ask`` takes a prompt and returns text; it runs on the executors. A failure or an
    answer without JSON leaves the fields null, for the rule-based category to fill.
    """
    import pandas as pd

    def run(frames):
        for frame in frames:
            answers = []
            for prompt in frame["prompt"]:
                try:
                    answers.append(ask(prompt))
                except Exception:  # a model that fails must not fail the batch
                    answers.append(None)
            yield pd.DataFrame({"exchange_id": frame["exchange_id"], "answer": answers})

    asked = rows.select("exchange_id", "prompt").mapInPandas(run, "exchange_id string, answer string")
    parsed = F.from_json(F.regexp_extract("answer", r"(?s)(\{.*\})", 1), "summary string, category string, intent string")
    return asked.select("exchange_id", parsed.alias("p")).select("exchange_id", "p.summary", "p.category", "p.intent")


def unsupported(sources: DataFrame) -> DataFrame:
    """(source_id, payload): the empty extraction of sources that cannot be read, which says so."""
    noise = F.array(F.struct(F.lit("source").alias("content_type"), F.lit("unsupported").alias("reason"), F.lit(1).cast("long").alias("count")))
    empty = F.struct(F.struct(F.col("source_id").alias("title"), F.lit("").alias("summary")).alias("conversation_summary"), F.array().cast("array<struct<type:string>>").alias("memory_cards"), noise.alias("discarded_noise"))
    return sources.select("source_id", F.to_json(empty).alias("payload"))
