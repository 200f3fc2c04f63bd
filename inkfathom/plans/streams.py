"""Queries of the streaming operators, over their whole input at once, and of diffusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfathom.operators import diffusion
from inkfathom.registry import query
from inkfathom.sources.adapters import graph_chunks, mentions, table
from inkfathom.streaming import jobs


@query("T12 W10", """
SELECT time_bucket(INTERVAL 1 MINUTE, ts) - to_minutes(k) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean
FROM events CROSS JOIN generate_series(0, 4) s(k) GROUP BY ALL""")
def window_5min_slide(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.sliding_metrics(table(spark, sf, "events"))


@query("T06", """
WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def session_gap(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.sessions(table(spark, sf, "events"))


@query("T03 T04 S14", """
SELECT event_id, CASE WHEN event_id % 4 + 1 >= 3 THEN 'dead_letter' ELSE 'requeue' END AS action FROM events
WHERE event_type = 'error' AND epoch(TIMESTAMP '2024-02-01') - floor(epoch(ts)) > 600""")
def stale_job_reaper(spark: SparkSession, sf: str) -> DataFrame:
    """Errors as jobs still in process on the first of February."""
    e = table(spark, sf, "events").where("event_type = 'error'").select(
        "event_id", F.col("ts").alias("started"), F.lit("processing").alias("state"), (F.col("event_id") % 4).alias("retries")
    )
    return jobs.stale_jobs(e, F.lit("2024-02-01").cast("timestamp")).select("event_id", "action")


@query("T03", """
SELECT event_id, event_id % 6 + 1 AS attempts, CASE WHEN event_id % 6 + 1 < 5 THEN 'again' ELSE 'dead_letter' END AS queue FROM events WHERE event_type = 'error'""")
def retry_queues(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", (F.col("event_type") == "error").alias("failed"), (F.col("event_id") % 6).alias("attempts"))
    again, dead = jobs.retried(e)
    both = again.withColumn("queue", F.lit("again")).unionByName(dead.withColumn("queue", F.lit("dead_letter")))
    return both.select("event_id", "attempts", "queue")


@query("G19")
def ppr_diffusion(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of each document, ranked anew along the entities they share (no SQL: iterative)."""
    c = graph_chunks(spark, sf).select(F.col("document_id").alias("query_id"), F.col("chunk_id").alias("id"), (F.col("price") / 1e6).alias("score"))
    m = mentions(spark, sf).select(F.col("src").alias("id"), "dst").join(c.select("query_id", "id"), "id")
    pairs = m.withColumnRenamed("id", "a").join(m.withColumnRenamed("id", "b"), ["query_id", "dst"]).where("a < b")
    edges = pairs.groupBy("query_id", "a", "b").agg(F.count("*").cast("double").alias("weight"))
    return diffusion.diffuse(c, edges).withColumn("score", F.round("score", 6))
