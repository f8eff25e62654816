"""Sessions of clients with times to live: states, lookups, counts and the audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values, in seconds: pending requests, blocks of an address, and the run of one connection.
PENDING_TTL, BLOCK_TTL, CONNECTION_GAP = 600, 6 * 3600, 300


def request(sessions: DataFrame, fresh: DataFrame, now: float) -> DataFrame:
    """Pending sessions for the addresses of ``fresh`` that are neither blocked nor pending already.

    ``sessions`` has session_id, token_hash, ip, status, created_at, updated_at, expires_at
    and blocked_until, in seconds since 1970.
    """
    busy = sessions.where(((F.col("status") == "pending") & (F.col("created_at") > now - PENDING_TTL)) | (F.col("blocked_until") > now)).select("ip").distinct()
    rows = fresh.join(busy, "ip", "left_anti")
    made = rows.select("session_id", F.lit(None).cast("string").alias("token_hash"), "ip", F.lit("pending").alias("status"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"), F.lit(now + PENDING_TTL).alias("expires_at"), F.lit(0.0).alias("blocked_until"))
    return sessions.unionByName(made)


def decide(sessions: DataFrame, decisions: DataFrame, now: float) -> DataFrame:
    """Sessions after decisions (session_id, action, token, ttl): approve and deny pending, revoke approved ones."""
    joined = sessions.join(decisions, "session_id", "left")
    pending = (F.col("status") == "pending") & (F.col("expires_at") > now)
    approve, deny = pending & (F.col("action") == "approve"), pending & (F.col("action") == "deny")
    revoke = (F.col("status") == "approved") & (F.col("action") == "revoke")
    hit = F.coalesce(approve | deny | revoke, F.lit(False))
    status = F.when(approve, "approved").when(deny, "denied").when(revoke, "revoked").otherwise(F.col("status"))
    out = joined.withColumn("token_hash", F.when(approve, F.sha2("token", 256)).otherwise(F.col("token_hash"))).withColumn("expires_at", F.when(approve, now + F.col("ttl")).otherwise(F.col("expires_at")))
    out = out.withColumn("blocked_until", F.when(deny, now + BLOCK_TTL).otherwise(F.col("blocked_until"))).withColumn("updated_at", F.when(hit, now).otherwise(F.col("updated_at")))
    return out.withColumn("status", status).select(*sessions.columns)


def expire(sessions: DataFrame, now: float) -> DataFrame:
    """Pending and approved sessions whose time is over become expired."""
    over = F.col("status").isin("pending", "approved") & (F.col("expires_at") <= now)
    return sessions.withColumn("updated_at", F.when(over, now).otherwise(F.col("updated_at"))).withColumn("status", F.when(over, "expired").otherwise(F.col("status")))


def valid(sessions: DataFrame, tokens: DataFrame, now: float) -> DataFrame:
    """(token, session_id): the approved session of each token that is still good."""
    live = sessions.where((F.col("status") == "approved") & (F.col("expires_at") > now)).select("token_hash", "session_id")
    return tokens.withColumn("token_hash", F.sha2("token", 256)).join(live, "token_hash").select("token", "session_id")


def pending_counts(sessions: DataFrame, now: float) -> DataFrame:
    """Live pending requests of each address, and the most recent of them."""
    live = sessions.where((F.col("status") == "pending") & (F.col("created_at") > now - PENDING_TTL))
    return live.groupBy("ip").agg(F.count("*").alias("pending"), F.max_by("session_id", F.struct("created_at", "session_id")).alias("latest"))


def audit(log: DataFrame, before: DataFrame, after: DataFrame, now: float) -> DataFrame:
    """``log`` with an entry for every session whose status changed or that is new."""
    joined = after.alias("a").join(before.alias("b"), "session_id", "left").where("b.status IS NULL OR a.status <> b.status")
    return log.unionByName(joined.select(F.lit(now).alias("ts"), "session_id", F.col("a.ip").alias("ip"), F.col("a.status").alias("event")))


def newest(log: DataFrame, limit: int = 100) -> DataFrame:
    return log.orderBy(F.desc("ts"), "session_id").limit(limit)
