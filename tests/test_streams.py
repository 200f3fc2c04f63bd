"""Streams end as their batch twins do; sinks and connectors keep what they promise."""

import json

from pyspark.sql import functions as F

from inkfathom.sources import connectors, sinks
from inkfathom.streaming import jobs


def drained(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    assert q.awaitTermination(120), q.stop()
    return df.sparkSession.table(name)


def source(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def test_sliding_metrics(spark, tmp_path):
    rows = [(f"2024-01-01 00:0{i}:00", "view", float(i)) for i in range(6)] + [("2024-01-02 00:00:00", "end", 0.0)]
    stream = source(spark, rows, "ts string, event_type string, value double", str(tmp_path / "in"))
    got = drained(jobs.sliding_metrics(stream), tmp_path, "slide").where("event_type = 'view'").collect()
    static = spark.read.parquet(str(tmp_path / "in"))
    want = jobs.sliding_metrics(static).where("event_type = 'view'").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_distinct_jobs(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "t", "x"), ("2024-01-01 00:00:05", "t", "x"), ("2024-01-01 00:00:06", "u", "x")]
    stream = source(spark, rows, "ts string, tag string, checksum string", str(tmp_path / "in"))
    assert drained(jobs.distinct_jobs(stream), tmp_path, "jobs").count() == 2


def test_bucket_and_breaker(spark, tmp_path):
    rows = [(f"2024-01-01 00:00:{i:02d}", "c") for i in range(4)]
    stream = source(spark, rows, "ts string, client string", str(tmp_path / "a"))
    got = drained(jobs.token_bucket(stream, per_minute=1, burst=2), tmp_path, "bucket", "append")
    assert sum(r["allowed"] for r in got.collect()) == 2
    calls = [(f"2024-01-01 00:0{i}:00", "s", i == 4) for i in range(6)]
    stream = source(spark, calls, "ts string, service string, ok boolean", str(tmp_path / "b"))
    got = drained(jobs.circuit_breaker(stream, failures=2, open_ms=90_000), tmp_path, "breaker").orderBy("ts").collect()
    assert [r["state"] for r in got] == ["closed", "closed", "open", "half_open", "open", "half_open"]


def test_bucket_across_batches(spark, tmp_path):
    """A request of an earlier time in a later batch takes from the bucket as it is; long silence fills it."""
    where = str(tmp_path / "in")
    for client, times in (("c", ["00:10", "00:11"]), ("c", ["00:05"]), ("d", ["59:00"]), ("c", ["59:30"])):
        day = "2024-01-02 05" if times[0].startswith("59") else "2024-01-01 00"
        rows = spark.createDataFrame([(f"{day}:{t}", client) for t in times], "ts string, client string")
        rows.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(where)
        stream = spark.readStream.schema("ts timestamp, client string").parquet(where)
        out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
        q = jobs.token_bucket(stream, per_minute=1, burst=2).writeStream.format("parquet").option("checkpointLocation", mark).trigger(availableNow=True).start(out)
        assert q.awaitTermination(120), q.stop()
    got = spark.read.parquet(out).orderBy("client", "ts").collect()
    assert [(r["client"], r["allowed"]) for r in got] == [("c", False), ("c", True), ("c", True), ("c", True), ("d", True)]


def test_debounce(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "p", 5), ("2024-01-01 00:00:09", "p", 6)]
    stream = source(spark, rows, "ts string, path string, length bigint", str(tmp_path / "in")).withColumnRenamed("ts", "mtime")
    q = jobs.debounce(stream, 1).writeStream.format("memory").queryName("calm").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            q.awaitTermination(1)
            if spark.table("calm").count():
                break
        assert [r["length"] for r in spark.table("calm").collect()] == [6]
    finally:
        q.stop()


def test_upsert_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), path, "k")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    for _ in range(2):
        sinks.upsert(new, path, "k")
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_connectors(spark, tmp_path):
    connectors.register(spark)
    docs = tmp_path / "docs.json"
    docs.write_text(json.dumps({"documents": [{"url": "u1", "checksum": "x"}, {"url": "u2", "checksum": "y"}]}))
    s = spark.readStream.format("polled_documents").option("url", docs.as_uri()).load()
    assert drain_some(s, tmp_path, "polled", 2) == [("u1", "x"), ("u2", "y")]
    commits = tmp_path / "commits.json"
    commits.write_text(json.dumps([{"sha": "b", "date": "2", "files": [{"filename": "docs/x.md", "status": "removed"}]}, {"sha": "a", "date": "1", "files": [{"filename": "src/y.py", "status": "added"}]}]))
    s = connectors.documents_only(spark.readStream.format("commits").option("url", commits.as_uri()).load())
    assert drain_some(s, tmp_path, "committed", 1) == [("b", "2", "docs/x.md", "deleted")]
    page = tmp_path / "page.json"
    page.write_text(json.dumps({"page_id": "p", "results": [{"type": "heading_1", "text": "T"}, {"type": "paragraph", "text": "x"}]}))
    got = spark.read.format("page_blocks").option("urls", page.as_uri()).load().collect()
    assert [(r["place"], r["type"]) for r in got] == [(0, "heading_1"), (1, "paragraph")]


def drain_some(df, tmp_path, name, n):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
    try:
        for _ in range(60):
            q.awaitTermination(1)
            if df.sparkSession.table(name).count() >= n:
                break
        return sorted(map(tuple, df.sparkSession.table(name).collect()))
    finally:
        q.stop()


def test_push_events(spark):
    p = json.dumps({"commits": [{"id": "s", "added": ["a"], "removed": ["b"], "modified": ["a", "c"]}]})
    got = connectors.push_events(spark.createDataFrame([(p,)], "payload string")).collect()
    assert sorted((r["path"], r["event"]) for r in got) == [("a", "created"), ("b", "deleted"), ("c", "updated")]
    assert not connectors.signed(b"x", b"k", "sha256=0")


def test_tasks_fetch_what_the_driver_plans(spark, tmp_path):
    """Pages of commits whose files are behind urls of their own, in partitions of two, from several tasks."""
    connectors.register(spark)
    at = lambda name: (tmp_path / name).as_uri()
    put = lambda name, said: (tmp_path / name).write_text(json.dumps(said))
    for i in range(7):
        put(f"c{i}.json", {"files": [{"filename": f"docs/{i}.md", "status": "modified"}]})
    commits = [{"sha": f"s{i}", "date": f"2024-01-0{i + 1}", "url": at(f"c{i}.json")} for i in range(7)]
    put("one.json", {"commits": commits[:5], "next": at("two.json")})
    put("two.json", {"commits": commits[5:]})
    reader = connectors.CommitReader({"url": at("one.json"), "items": "2"})
    end = reader.latestOffset()
    shares = [p.value for p in reader.partitions({"date": "2024-01-01", "sha": "s0"}, end)]
    assert end == {"date": "2024-01-07", "sha": "s6"}
    assert shares == [(at("one.json"), ["s1", "s2"]), (at("one.json"), ["s3", "s4"]), (at("two.json"), ["s5", "s6"])]
    s = spark.readStream.format("commits").option("url", at("one.json")).option("items", "2").load()
    tasks = s.withColumn("task", F.spark_partition_id())
    got = drain_some(tasks, tmp_path, "fetched", 7)
    assert sorted(r[0] for r in got) == [f"s{i}" for i in range(7)] and len({r[-1] for r in got}) == 4
    put("docs.json", {"documents": [{"url": at("c0.json"), "checksum": "1"}, {"url": at("c1.json")}, {"url": at("c2.json"), "checksum": "3"}]})
    polled = spark.readStream.format("polled_documents").option("url", at("docs.json")).option("content", "true").option("items", "1").load()
    assert [(r[1], json.loads(r[2])["files"][0]["filename"]) for r in drain_some(polled, tmp_path, "texts", 2)] == [("1", "docs/0.md"), ("3", "docs/2.md")]


def test_a_broken_feed_is_left_alone_for_a_while(tmp_path):
    now = [0.0]
    feed = tmp_path / "feed.json"
    reader = connectors.PollReader({"url": feed.as_uri(), "failures": "2"})
    reader.breaker.clock = lambda: now[0]
    assert reader.latestOffset() == {"seen": 0} and reader.breaker.state == "closed"
    assert reader.latestOffset() == {"seen": 0} and reader.breaker.state == "open"
    feed.write_text(json.dumps({"documents": [{"url": "u", "checksum": "c"}]}))
    assert reader.latestOffset() == {"seen": 0}  # not asked
    now[0] = 61.0
    assert reader.breaker.state == "half_open" and reader.latestOffset() == {"seen": 1} and reader.breaker.state == "closed"
    feed.write_text("no json")
    assert reader.latestOffset() == {"seen": 1} == reader.latestOffset() and reader.breaker.state == "open"
    now[0] = 200.0
    assert reader.latestOffset() == {"seen": 1} and reader.breaker.state == "open"  # the one try failed: open again
