"""Queries for the streaming flows: each stream is run to its end and the final result compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.plans.catalogue import query
from sievework.streaming import flows


def stream(spark, sf_dir):
    return flows.read_files(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_dedup", "SELECT user_id, event_type, CAST(date_trunc('day', ts) AS DATE) AS day FROM events GROUP BY ALL")
def stream_dedup(spark, sf_dir):
    keyed = stream(spark, sf_dir).withColumn("day", F.to_date("ts"))
    return flows.run(flows.dedup(keyed, ["user_id", "event_type", "day"], "ts", "60 days")).select("user_id", "event_type", "day")


@query("stream_windowed_counts", "SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def stream_windowed_counts(spark, sf_dir):
    out = flows.run(flows.windowed_counts(stream(spark, sf_dir), "ts", "event_type"), "complete")
    return out.select(F.to_date("w.start").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


@query(
    "stream_sessions",
    """SELECT user_id, count(*) AS sessions, CAST(max(n) AS BIGINT) AS longest FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s
    FROM (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events)) GROUP BY user_id, s) GROUP BY user_id""",
)
def stream_sessions(spark, sf_dir):
    out = flows.run(flows.sessions(stream(spark, sf_dir), "ts", "user_id"), "complete")
    return out.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


@query(
    "stream_ledger",
    "SELECT user_id, count(*) AS seen, CAST(sum(CASE WHEN before IS NOT NULL AND before <> event_type THEN 1 ELSE 0 END) AS BIGINT) AS changes FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) GROUP BY user_id",
)
def stream_ledger(spark, sf_dir):
    out = flows.run(flows.ledger(stream(spark, sf_dir), "user_id", "event_id", "event_type"), "update")
    return out.groupBy("user_id").agg(F.max("seen").alias("seen"), F.max("changes").alias("changes"))
