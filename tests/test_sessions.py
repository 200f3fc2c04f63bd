"""Sessions across micro-batches: order, expiry by a timer and by the next event."""

import pytest
from pyspark.sql import functions as F

from inkfathom.shipping import ship_package
from inkfathom.streaming import sessions

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    ship_package(spark)
    yield spark
    spark.conf.unset(PROVIDER)


def test_sessions_across_batches(rocks, tmp_path):
    spark, where, schema = rocks, str(tmp_path / "in"), "session_id string, ts timestamp, kind string, user_id string, text string, sections array<string>"
    day = lambda d, h=0: f"2024-01-{d:02d} {h:02d}:00:00"
    batches = [
        # out of order within the batch; an answer goes with the query before it
        [("a", day(1, 3), "answer", None, "A1", ["s2", "s1"]), ("a", day(1, 1), "create", "u", None, None), ("a", day(1, 2), "query", "u", "Q1", None), ("b", day(2), "answer", "v", "early", None), (None, day(2), "query", "u", "no session", None)],
        # an earlier time than the last, not yet late; the turn goes on
        [("a", day(1, 4), "query", "u", "Q2", None), ("b", day(3), "query", "v", "QB", [])],
        # time goes on: b's ten days end by the timer, a's by its next event, which begins anew
        [("a", day(12), "query", "w", "Q3", None)],
        [("c", day(31), "create", "x", None, None)],
    ]
    got = []
    for n, rows in enumerate(batches):
        made = spark.createDataFrame([(s, t, k, u, x, c) for s, t, k, u, x, c in rows], schema.replace("ts timestamp", "ts string"))
        made.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(where)
        stream = sessions.tracked(spark.readStream.schema(schema).parquet(where), ttl_days=10, delay="2 days")
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start(str(tmp_path / "out"))
        assert q.awaitTermination(180), q.stop()
    got = spark.read.schema(sessions.OUT).parquet(str(tmp_path / "out")).collect()
    rows = sorted((r["session_id"], str(r["at"])[:13], r["event"], r["turn"], r["text"], r["asked"], r["citations"], r["total_queries"]) for r in got if r["event"] in ("query", "answer"))
    assert rows == [
        ("a", "2024-01-01 02", "query", 1, "Q1", None, None, 1),
        ("a", "2024-01-01 03", "answer", 1, "A1", "Q1", "1:s2,2:s1", 1),
        ("a", "2024-01-01 04", "query", 2, "Q2", None, None, 2),
        ("a", "2024-01-12 00", "query", 1, "Q3", None, None, 1),
        ("b", "2024-01-02 00", "answer", 0, "early", None, "", 0),
        ("b", "2024-01-03 00", "query", 1, "QB", None, None, 1),
    ]
    rest = sorted((r["session_id"], str(r["at"])[:13], r["event"], r["total_queries"]) for r in got if r["event"] not in ("query", "answer"))
    assert rest == [
        ("a", "2024-01-01 01", "created", 0), ("a", "2024-01-11 01", "expired", 2), ("a", "2024-01-22 00", "expired", 1),
        ("b", "2024-01-12 00", "expired", 1), ("c", "2024-01-31 00", "created", 0),
    ]
