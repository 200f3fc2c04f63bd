"""Sessions kept by ``transformWithState``: created, asked, answered, expired.

Each session's state is a value (who, since when, until when, how many queries), a list
of queries and a map from a query's turn to its answer. A session ends ``ttl`` after it
began: by a timer once the watermark has passed that time, or at the first event after
it, which begins a new session. What comes before the watermark is dropped.

The streaming form needs Spark's RocksDB state store
(``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Fixed value: days that a session lasts.
TTL_DAYS = 30
_DAY_MS = 86_400_000
#: Of events of one time these come first.
_ORDER = {"create": 0, "query": 1, "answer": 2}

META = "user_id string, started bigint, expires bigint, last bigint, queries int"
OUT = "session_id string, event string, at timestamp, turn int, text string, asked string, citations string, started timestamp, expires timestamp, total_queries int"
_ROW = Row(*(f.split()[0] for f in OUT.split(", ")))


class Sessions(StatefulProcessor):
    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.meta = handle.getValueState("meta", META)
        self.asked = handle.getListState("asked", "turn int, text string, at bigint")
        self.answers = handle.getMapState("answers", "turn int", "text string, citations string, at bigint")

    def _row(self, key: str, event: str, at: int, meta: tuple, turn: int | None = None, text: str | None = None, asked: str | None = None, citations: str | None = None) -> Row:
        return _ROW(key, event, at, turn, text, asked, citations, meta[1], meta[2], meta[4])

    def _clear(self) -> None:
        self.meta.clear()
        self.asked.clear()
        self.answers.clear()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        """State is read once and written once a call: each access is a round trip to the JVM."""
        events = sorted(rows, key=lambda e: (e.ms, _ORDER.get(e.kind, 3), e.text is None, e.text or ""))
        before = meta = self.meta.get()
        session, said, asked, answers = key[0], None, [], {}
        known = False  # whether ``said`` is the last query's text
        for e in events:
            at = e.ms
            if meta is not None and at >= meta[2]:
                yield self._row(session, "expired", meta[2], meta)
                if before is not None:
                    self.handle.deleteTimer(before[2])
                    self._clear()
                    before = None
                meta, asked, answers = None, [], {}
            new = meta is None
            if new:
                meta, known = (e.user_id, at, at + self.ttl_ms, at, 0), True
                said = None
            user, started, expires, last, queries = meta
            meta = (user if user is not None else e.user_id, started, expires, max(last, at), queries + (e.kind == "query"))
            if e.kind == "query":
                said, known = e.text, True
                asked.append((meta[4], e.text, at))
                yield self._row(session, "query", at, meta, meta[4], e.text)
            elif e.kind == "answer":
                turn = meta[4]
                if not known:
                    said, known = next((q[1] for q in self.asked.get() if q[0] == turn), None) if turn else None, True
                cited = ",".join(f"{rank}:{s}" for rank, s in enumerate(e.sections or [], 1))
                answers[turn] = (e.text, cited, at)
                yield self._row(session, "answer", at, meta, turn, e.text, said, cited)
            else:
                yield self._row(session, "created" if new else "ensured", at, meta)
        if meta is None:
            return
        if before is None:
            self.handle.registerTimer(meta[2])
        self.meta.update(meta)
        if asked:
            self.asked.appendList(asked)
        for turn, answer in answers.items():
            self.answers.updateValue((turn,), answer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        meta = self.meta.get()
        if meta is not None and meta[2] <= expiredTimerInfo.getExpiryTimeInMs():
            self._clear()
            yield self._row(key[0], "expired", meta[2], meta)

    def close(self) -> None:
        pass


def tracked(events: DataFrame, ttl_days: float = TTL_DAYS, delay: str = "1 hour") -> DataFrame:
    """What happens in each session, a row an event, in the form of ``OUT``.

    ``events``: session_id, ts, kind (create, query or answer), user_id, text, sections (of
    an answer: what it cites, in order). A batch table or a stream. An answer is to the
    last query before it; one before any query has turn 0.
    """
    e = events.where("session_id is not null and ts is not null").withWatermark("ts", delay).withColumn("ms", F.unix_millis("ts"))
    made = e.groupBy("session_id").transformWithState(
        statefulProcessor=Sessions(int(ttl_days * _DAY_MS)), outputStructType=OUT.replace("timestamp", "bigint"), outputMode="append", timeMode="eventTime"
    )
    return made.withColumns({c: F.timestamp_millis(c) for c in ("at", "started", "expires")})


def conversation_events(turns: DataFrame, days: int) -> DataFrame:
    """Turns of conversations (conv_id, turn, role, text) as events, ``days`` apart from one turn to the next."""
    kind = F.when(F.col("role") == "user", "query").when(F.col("role") == "assistant", "answer").otherwise("create")
    at = F.timestamp_millis(F.lit(1_704_067_200_000) + F.col("turn") * days * _DAY_MS)
    words = F.slice(F.filter(F.split("text", " "), lambda w: w != ""), 1, 2)
    return turns.select(F.col("conv_id").cast("string").alias("session_id"), at.alias("ts"), kind.alias("kind"), F.lit("u").alias("user_id"), "text", words.alias("sections"))
