"""Sessions of the conversations, kept as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfathom.registry import query
from inkfathom.sources.adapters import table
from inkfathom.sources.scratch import scratch_dir
from inkfathom.streaming import sessions

#: Days from one turn of a conversation to the next: four turns are within a session's thirty.
APART = 9


@query("N01 N05 N06 T06", f"""
WITH e AS (
  SELECT CAST(conv_id AS VARCHAR) AS session_id, turn, role, text, (turn - min(turn) OVER (PARTITION BY conv_id)) // 4 AS gen,
    TIMESTAMP '2024-01-01' + INTERVAL ({APART}) DAY * turn AS moment FROM conversations),
n AS (
  SELECT *, count(*) FILTER (role = 'user') OVER w AS queries, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER w AS asked, min(moment) OVER w AS started, row_number() OVER w AS place
  FROM e WINDOW w AS (PARTITION BY session_id, gen ORDER BY turn ROWS UNBOUNDED PRECEDING)),
said AS (
  SELECT session_id, CASE role WHEN 'user' THEN 'query' WHEN 'assistant' THEN 'answer' ELSE CASE WHEN place = 1 THEN 'created' ELSE 'ensured' END END AS event, moment,
    CASE WHEN role IN ('user', 'assistant') THEN queries END AS turn, CASE WHEN role IN ('user', 'assistant') THEN text END AS text,
    CASE WHEN role = 'assistant' THEN asked END AS asked,
    CASE WHEN role = 'assistant' THEN array_to_string(list_transform(list_filter(string_split(text, ' '), lambda x: x <> '')[1:2], lambda x, i: concat(i, ':', x)), ',') END AS citations,
    started, queries AS total_queries FROM n),
ended AS (SELECT session_id, gen, min(moment) AS started, count(*) FILTER (role = 'user') AS total_queries FROM e GROUP BY ALL),
expired AS (
  SELECT session_id, 'expired' AS event, started + INTERVAL {sessions.TTL_DAYS} DAY AS moment, NULL AS turn, NULL AS text, NULL AS asked, NULL AS citations, started, total_queries
  FROM ended x WHERE EXISTS (SELECT 1 FROM ended y WHERE y.session_id = x.session_id AND y.gen > x.gen)
    OR started + INTERVAL {sessions.TTL_DAYS} DAY <= (SELECT max(moment) FROM e) - INTERVAL 1 HOUR)
SELECT session_id, event, CAST(epoch(moment) AS BIGINT) AS "at", CAST(turn AS INTEGER) AS turn, text, asked, citations, CAST(epoch(started) AS BIGINT) AS started, CAST(total_queries AS INTEGER) AS total_queries
FROM (SELECT * FROM said UNION ALL SELECT * FROM expired)""")
def session_log(spark: SparkSession, sf: str) -> DataFrame:
    """Queries with their turn, answers with what was asked and is cited, and the ends of sessions, from a stream that is drained."""
    where = f"{scratch_dir(spark)}/sessions-{uuid.uuid4().hex}"
    events = sessions.conversation_events(table(spark, sf, "conversations"), APART)
    events.write.parquet(f"{where}/in")
    provider = "spark.sql.streaming.stateStore.providerClass"
    had = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = sessions.tracked(spark.readStream.schema(events.schema).parquet(f"{where}/in"))
        q = stream.writeStream.format("parquet").option("checkpointLocation", f"{where}/mark").trigger(availableNow=True).start(f"{where}/out")
        q.awaitTermination()
    finally:
        spark.conf.unset(provider) if had is None else spark.conf.set(provider, had)
    seconds = lambda c: F.unix_seconds(c).alias(c)
    found = spark.read.schema(sessions.OUT).parquet(f"{where}/out")
    return found.select("session_id", "event", seconds("at"), "turn", "text", "asked", "citations", seconds("started"), "total_queries")
