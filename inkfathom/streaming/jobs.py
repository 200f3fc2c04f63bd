"""Structured Streaming: arrival, de-duplication, debouncing, retries, metrics.

Each function takes a streaming or a static DataFrame; on a static one the
watermark has no effect and the result is that of the whole stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


#: State of a client or service that is heard of no more is dropped when the watermark is so far beyond its last event.
IDLE_MS = 3_600_000


def watch(spark: SparkSession, folder: str, extensions: str = "*.{md,html}", per_trigger: int = 1000) -> DataFrame:
    """New files of a folder as path, mtime, length, content, at most ``per_trigger`` at once."""
    return (
        spark.readStream.format("binaryFile").option("pathGlobFilter", extensions).option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", per_trigger).load(folder)
        .select("path", F.col("modificationTime").alias("mtime"), "length", "content")
    )


def distinct_jobs(jobs: DataFrame, late: str = "1 day") -> DataFrame:
    """The first job of each tag and checksum within the watermark."""
    return jobs.withWatermark("ts", late).dropDuplicatesWithinWatermark(["tag", "checksum"])


def sliding_metrics(events: DataFrame, width: str = "5 minutes", slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """start, event_type, n, mean, errors of each sliding window."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width, slide).alias("w"), "event_type")
    return g.agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")).select(F.col("w.start").alias("start"), "event_type", "n", "mean")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, start, end, n of each session that a pause of ``gap`` ends."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return g.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def debounce(files: DataFrame, seconds: int = 5) -> DataFrame:
    """path, length, mtime once a file has kept both for ``seconds``; again after a change.

    State is one row a path, dropped when it has been given out.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            length, mtime = state.get
            state.remove()
            yield pd.DataFrame({"path": [key[0]], "length": [length], "mtime": [mtime]})
            return
        latest = None
        for b in batches:
            row = b.sort_values("mtime").iloc[-1]
            if latest is None or row["mtime"] >= latest["mtime"]:
                latest = row
        if latest is not None:
            state.update((int(latest["length"]), int(latest["mtime"])))
        state.setTimeoutDuration(seconds * 1000)

    rows = files.select("path", "length", F.unix_millis("mtime").alias("mtime"))
    return rows.groupBy("path").applyInPandasWithState(
        step, "path string, length bigint, mtime bigint", "length bigint, mtime bigint", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def token_bucket(requests: DataFrame, per_minute: float = 60.0, burst: int = 10, late: str = "10 minutes") -> DataFrame:
    """client, ts (ms), allowed: a bucket a client, refilled by the requests' own times.

    State goes by event time, and only when the bucket has long been full again, so that no answer depends on it.
    Requests that come more than ``late`` after newer ones of any client get no answer.
    """
    idle = max(IDLE_MS, int(burst / per_minute * 60_000))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        level, last = state.get if state.exists else (float(burst), -1)
        times, out = sorted(pd.concat(list(batches))["ms"]), []
        for ts in times:
            # a request that comes late finds the bucket as it is
            level = float(burst) if last < 0 else min(float(burst), level + max(0, ts - last) / 60000 * per_minute)
            last = max(last, ts)
            out.append(level >= 1)
            level -= 1 if level >= 1 else 0
        yield pd.DataFrame({"client": key[0], "ts": times, "allowed": out})
        state.update((level, last))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + idle)

    rows = requests.withWatermark("ts", late).select("client", "ts", F.unix_millis("ts").alias("ms"))
    return rows.groupBy("client").applyInPandasWithState(
        step, "client string, ts bigint, allowed boolean", "level double, last bigint", "append", GroupStateTimeout.EventTimeTimeout
    )


def circuit_breaker(calls: DataFrame, failures: int = 5, open_ms: int = 30_000, late: str = "10 minutes") -> DataFrame:
    """service, ts (ms), state: closed; open after so many failures on end; half_open
    for one trial when the pause is over, whose success closes it again.

    State goes by event time; a service silent for that long, and beyond its pause, starts anew as closed.
    Calls that come more than ``late`` after newer ones of any service get no answer.
    """
    idle = max(IDLE_MS, 2 * open_ms)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        failed, opened = state.get if state.exists else (0, -1)
        b, out = pd.concat(list(batches)).sort_values("ms", kind="stable"), []
        for ts, ok in zip(b["ms"], b["ok"]):
            if opened >= 0 and ts - opened < open_ms:
                out.append("open")
                continue
            trial = opened >= 0
            out.append("half_open" if trial else "closed")
            if ok:
                failed, opened = 0, -1
            else:
                failed += 1
                if trial or failed >= failures:
                    opened = int(ts)
        yield pd.DataFrame({"service": key[0], "ts": list(b["ms"]), "state": out})
        state.update((failed, opened))
        state.setTimeoutTimestamp(max(int(b["ms"].max()), state.getCurrentWatermarkMs()) + idle)

    rows = calls.withWatermark("ts", late).select("service", "ts", F.unix_millis("ts").alias("ms"), "ok")
    return rows.groupBy("service").applyInPandasWithState(
        step, "service string, ts bigint, state string", "failed int, opened bigint", "append", GroupStateTimeout.EventTimeTimeout
    )


def retried(jobs: DataFrame, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """Failed jobs to offer again with one more attempt, and those that have had their last."""
    failed = jobs.where("failed").withColumn("attempts", F.col("attempts") + 1)
    return failed.where(F.col("attempts") < most), failed.where(F.col("attempts") >= most)


def stale_jobs(jobs: DataFrame, now, timeout_seconds: int = 600, most: int = 3) -> DataFrame:
    """Jobs in process for longer than the timeout, with action requeue or dead_letter."""
    age = F.unix_timestamp(now) - F.unix_timestamp("started")
    late = jobs.where((F.col("state") == "processing") & (age > timeout_seconds))
    return late.withColumn("action", F.when(F.col("retries") + 1 >= most, "dead_letter").otherwise("requeue"))


def latest(batch: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row of each key: the last by ``order``; without an order any, as then no row is later."""
    if order is None:
        return batch.dropDuplicates([key])
    best = F.max_by(F.struct("*"), F.struct(order, F.xxhash64(F.struct("*"))))
    return batch.groupBy(F.col(key).alias("__key")).agg(best.alias("__row")).select("__row.*")


def upsert_each(stream: DataFrame, path: str, key: str, checkpoint: str, order: str | None = None):
    """A query that keeps a Parquet table at the latest row of each key, as ``order`` tells."""
    from inkfathom.sources.sinks import upsert

    return (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, _: upsert(latest(batch, key, order), path, key)).trigger(availableNow=True).start()
    )


def resumed(spark: SparkSession, folder: str, stages, start: DataFrame) -> DataFrame:
    """Runs named stages one after the other, each written under ``folder`` and read
    again; a stage whose table stands whole is not run anew."""
    jvm, rows = spark._jvm, start
    for name, stage in stages:
        path = f"{folder}/{name}"
        done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            stage(rows).write.mode("overwrite").parquet(path)
        rows = spark.read.parquet(path)
    return rows
