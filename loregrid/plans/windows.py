"""Batch forms of the streaming queries: windows, debounce, deduplication, expiry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import stateful
from . import bridge

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


_ISLANDS = "(SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL {gap} SECOND, true)::INT AS new FROM events))"


@query(f"SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, count(*) AS n FROM {_ISLANDS.format(gap=300)} GROUP BY user_id, no")
def dedup_window_300s(spark, d):
    out = stateful.connections(bridge.events(spark, d).select(F.col("user_id").alias("client"), "ts"), "300 seconds")
    return out.select(F.col("client").alias("user_id"), F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss").alias("first_seen"), "n")


@query(f"SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_event, count(*) AS n FROM {_ISLANDS.format(gap=3600)} GROUP BY user_id, no")
def debounce_sessions(spark, d):
    out = stateful.debounced(bridge.events(spark, d).select(F.col("user_id").alias("path"), "ts", F.col("event_type").alias("event")), "3600 seconds")
    return out.select(F.col("path").alias("user_id"), F.date_format("last_event", "yyyy-MM-dd HH:mm:ss").alias("last_event"), "n")


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling(spark, d):
    return bridge.events(spark, d).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts) - k * INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM events, (VALUES (0), (1)) t(k) GROUP BY ALL")
def sliding(spark, d):
    return bridge.events(spark, d).groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("SELECT event_id, CASE WHEN event_type = 'click' AND epoch(m) - epoch(ts) > 600 THEN 'expired' WHEN epoch(m) - epoch(ts) > 86400 THEN 'expired' ELSE 'live' END AS state FROM events, (SELECT max(ts) AS m FROM events)")
def ttl_expiry(spark, d):
    rows = bridge.events(spark, d)
    now = rows.agg(F.max("ts").alias("now"))
    ttl = F.when(F.col("event_type") == "click", 600).otherwise(86400)
    return rows.crossJoin(F.broadcast(now)).select("event_id", stateful.expired(F.col("ts"), F.col("now"), ttl).alias("state"))  # one row
