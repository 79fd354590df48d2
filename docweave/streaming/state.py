"""Keyed state in streams: alerts that must hold for some time, pairing of task starts with their publishes, stale tasks.

All are processors for ``transformWithState`` with event-time timers.  Rows wait in the
state until the watermark has passed them and are then taken in their event order, so
the result does not depend on how rows are cut into batches; rows behind the watermark are
late and ignored, as in every Spark window.  A key's rows of a batch are put into the state at once,
and it waits for one timer, that of its first row: when it fires, all that the watermark has
passed is taken, and the next timer is set for what is left.  State lives in RocksDB, and a query that is
started again from its checkpoint goes on where it was.

The plain versions (``ALERT_SQL``, ``STALE_SQL``, ``pairs_of``) say the same over a finished table.
"""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docweave.scratch import shared_dir
from docweave.shipping import ship
from docweave.tables import table

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MINUTE_MS = 60_000
DAY_MS = 24 * 60 * MINUTE_MS


def _minute_end(at_us: int) -> int:
    """The end of a moment's minute, in milliseconds: when the watermark has passed it, the minute is settled."""
    return (at_us // 1000 // MINUTE_MS + 1) * MINUTE_MS


class AlertState(StatefulProcessor):
    """pending → firing → resolved for each key, over tumbling windows.

    A window breaches if more than ``percent`` of its rows are bad.  The first breach makes an
    alert pending; the ``hold``-th in a row makes it firing; a window that does not breach,
    or has no rows at all, ends it: resolved if it was firing, else dropped.
    """

    def __init__(self, width_ms: int = DAY_MS, percent: float = 30.0, hold: int = 2):
        self.width, self.percent, self.hold = width_ms, percent, hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.windows = handle.getListState("windows", "start long, n long, bad long")
        self.alert = handle.getValueState("alert", "streak long, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        new: dict[int, tuple[int, int]] = {}
        for df in rows:
            start = df["at_ms"] // self.width * self.width
            for own, bad in zip(start.tolist(), df["bad"].tolist(), strict=True):
                if own + self.width <= watermark:
                    continue  # late: its window is closed
                n, b = new.get(own, (0, 0))
                new[own] = (n + 1, b + bool(bad))
        if new:
            self.windows.appendList([(own, n, b) for own, (n, b) in new.items()])
            self.handle.registerTimer(min(new) + self.width)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        held: dict[int, tuple[int, int]] = {}
        for own, n, b in self.windows.get():
            before = held.get(own, (0, 0))
            held[own] = (before[0] + n, before[1] + b)
        closed = sorted(own for own in held if own + self.width <= watermark)
        if not closed:
            return  # another timer took them
        streak, last = self.alert.get() if self.alert.exists() else (0, closed[0])
        out = []
        for start in closed:
            n, bad = held.pop(start)
            end = start + self.width
            if streak and last + self.width < start:  # windows without rows lie between
                if streak >= self.hold:
                    out.append((last + 2 * self.width, "resolved"))
                streak = 0
            if 100.0 * bad / n > self.percent:
                streak += 1
                if streak == 1:
                    out.append((end, "pending"))
                if streak == self.hold:
                    out.append((end, "firing"))
            else:
                if streak >= self.hold:
                    out.append((end, "resolved"))
                streak = 0
            last = start
        self.alert.update((streak, last))
        if held:
            self.windows.put([(own, n, b) for own, (n, b) in held.items()])
            self.handle.registerTimer(min(held) + self.width)
        else:
            self.windows.clear()
        if out:
            yield pd.DataFrame({"key": [key[0]] * len(out), "at_ms": [t for t, _ in out], "state": [s for _, s in out]})

    def close(self) -> None:
        pass


def alert_transitions(events: DataFrame, key: str, bad: str, late: str = "1 hour", width_ms: int = DAY_MS, percent: float = 30.0, hold: int = 2) -> DataFrame:
    """(key, at_ms, state) of a stream with a zoned timestamp ``at``."""
    rows = events.withWatermark("at", late).select(F.col(key).alias("key"), "at", F.unix_millis("at").alias("at_ms"), F.expr(bad).alias("bad"))
    return rows.groupBy("key").transformWithStateInPandas(AlertState(width_ms, percent, hold), "key long, at_ms long, state string", "Append", "EventTime")


#: the same over a finished table: windows that the last watermark has passed, by gaps and islands
ALERT_SQL = """
WITH w AS (
  SELECT user_id AS key, CAST(ts AS DATE) AS day, 100e0 * count(*) FILTER (WHERE event_type = 'error') / count(*) > 30 AS breach FROM events
  GROUP BY user_id, CAST(ts AS DATE) HAVING CAST(CAST(ts AS DATE) + INTERVAL 1 DAY AS TIMESTAMP) <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)
), marked AS (
  SELECT key, day, breach, day - CAST(row_number() OVER (PARTITION BY key, breach ORDER BY day) AS INTEGER) AS island FROM w
), streaks AS (
  SELECT key, min(day) AS first_day, max(day) AS last_day, count(*) AS n FROM marked WHERE breach GROUP BY key, island
), closing AS (
  SELECT s.*, (SELECT min(w.day) FROM w WHERE w.key = s.key AND w.day > s.last_day) AS next_day FROM streaks s
)
SELECT key, epoch_ms(CAST(first_day + INTERVAL 1 DAY AS TIMESTAMP)) AS at_ms, 'pending' AS state FROM streaks
UNION ALL SELECT key, epoch_ms(CAST(first_day + INTERVAL 2 DAY AS TIMESTAMP)), 'firing' FROM streaks WHERE n >= 2
UNION ALL SELECT key, epoch_ms(CAST(last_day + INTERVAL 2 DAY AS TIMESTAMP)), 'resolved' FROM closing WHERE n >= 2 AND next_day IS NOT NULL
"""


class Pairing(StatefulProcessor):
    """Each start takes the oldest publish of its key that waits and is not older than ``within_ms``.

    Publishes that no start took are given out, unmatched, when they expire.  A start
    without a waiting publish is dropped.
    """

    def __init__(self, within_ms: int = 60 * MINUTE_MS):
        self.within = within_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ahead = handle.getListState("ahead", "at_us long, id long, publish boolean")
        self.waiting = handle.getListState("waiting", "at_us long, id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        new = []
        for df in rows:
            for at, own, publish in zip(df["at_us"].tolist(), df["id"].tolist(), df["publish"].tolist(), strict=True):
                if _minute_end(at) <= watermark:
                    continue  # late: its minute is settled
                new.append((at, own, bool(publish)))
        if new:
            self.ahead.appendList(new)
            self.handle.registerTimer(_minute_end(min(new)[0]))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # all minutes that the watermark has passed at once: timers set from here fire in a later batch
        end = timerValues.getCurrentWatermarkInMs() // MINUTE_MS * MINUTE_MS * 1000
        ready, rest = [], []
        for row in self.ahead.get():
            (ready if row[0] < end else rest).append(tuple(row))
        waiting = deque(sorted(tuple(r) for r in self.waiting.get()))
        out = _settled(sorted(ready), waiting, self.within * 1000, end)
        if rest:
            self.ahead.put(rest)
            self.handle.registerTimer(_minute_end(min(rest)[0]))
        else:
            self.ahead.clear()
        if waiting:
            self.waiting.put(list(waiting))
            # the first to expire, in the minute behind its last moment
            self.handle.registerTimer(_minute_end(waiting[0][0] + self.within * 1000))
        else:
            self.waiting.clear()
        if out:
            yield pd.DataFrame(out, columns=["publish", "start", "waited_us"]).astype("Int64").assign(key=key[0])[["key", "publish", "start", "waited_us"]]

    def close(self) -> None:
        pass


def _settled(events: list[tuple[int, int, bool]], waiting: deque, within_us: int, end: int) -> list[tuple]:
    """Takes events in order against the queue; then what has expired by ``end`` leaves it."""
    out: list[tuple] = []

    def expire(now: int) -> None:
        while waiting and waiting[0][0] + within_us < now:
            out.append((waiting.popleft()[1], None, None))

    for at, own, publish in events:
        expire(at)
        if publish:
            waiting.append((at, own))
        elif waiting:
            published, first = waiting.popleft()
            out.append((first, own, at - published))
    expire(end)
    return out


def task_waits(events: DataFrame, key: str, late: str = "1 hour", within_ms: int = 60 * MINUTE_MS) -> DataFrame:
    """(key, publish, start, waited_us) of a stream (id, publish, at); start is null for a publish that expired."""
    rows = events.withWatermark("at", late).select(F.col(key).alias("key"), "id", "publish", "at", F.unix_micros("at").alias("at_us"))
    return rows.groupBy("key").transformWithStateInPandas(Pairing(within_ms), "key long, publish long, start long, waited_us long", "Append", "EventTime")


def pairs_of(events: list[tuple[int, int, bool]], watermark_us: int, within_us: int) -> list[tuple]:
    """The same for one key's finished list (at_us, id, publish), up to a watermark."""
    end = watermark_us // 60_000_000 * 60_000_000
    waiting: deque = deque()
    return _settled(sorted(e for e in events if e[0] < end), waiting, within_us, end)


class Staleness(StatefulProcessor):
    """Tasks without a sign of life: retried after each ``idle_ms``, ``retries`` times, then given up.

    A sign of life starts the count again.  Each action is given out once, with the sign that
    it counts from, when the watermark has passed it.
    """

    def __init__(self, idle_ms: int = 45 * MINUTE_MS, retries: int = 3):
        self.idle, self.retries = idle_ms, retries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ahead = handle.getListState("ahead", "at_us long")
        self.alive = handle.getValueState("alive", "last_us long, done int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        new = [at for df in rows for at in df["at_us"].tolist() if _minute_end(at) > watermark]
        if new:
            self.ahead.appendList([(at,) for at in new])
            self.handle.registerTimer(_minute_end(min(new)))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # all minutes that the watermark has passed at once: timers set from here fire in a later batch
        end = timerValues.getCurrentWatermarkInMs() // MINUTE_MS * MINUTE_MS * 1000
        seen = sorted(r[0] for r in self.ahead.get())
        ready, rest = [t for t in seen if t < end], [(t,) for t in seen if t >= end]
        last, done = self.alive.get() if self.alive.exists() else (None, 0)
        out, last, done = stale_actions(ready, last, done, end, self.idle * 1000, self.retries)
        if rest:
            self.ahead.put(rest)
            self.handle.registerTimer(_minute_end(rest[0][0]))
        else:
            self.ahead.clear()
        if last is not None:
            self.alive.update((last, done))
            if done <= self.retries:
                self.handle.registerTimer(_minute_end(last + (done + 1) * self.idle * 1000))
        if out:
            yield pd.DataFrame(out, columns=["since_us", "attempt", "action"]).assign(key=key[0])[["key", "since_us", "attempt", "action"]]

    def close(self) -> None:
        pass


def stale_actions(signs: list[int], last: int | None, done: int, end: int, idle_us: int, retries: int) -> tuple[list[tuple], int | None, int]:
    """Actions before ``end`` of a key whose signs of life come in order, and its last sign with the actions taken since."""
    out: list[tuple] = []
    for at in [*signs, None]:
        while last is not None and done <= retries and last + (done + 1) * idle_us < (end if at is None else at):
            done += 1
            out.append((last, done, "retry" if done <= retries else "error"))
        if at is not None:
            last, done = at, 0
    return out, last, done


def stale_tasks(events: DataFrame, key: str, late: str = "1 hour", idle_ms: int = 45 * MINUTE_MS, retries: int = 3) -> DataFrame:
    """(key, since_us, attempt, action) of a stream of signs of life with a zoned timestamp ``at``."""
    rows = events.withWatermark("at", late).select(F.col(key).alias("key"), "at", F.unix_micros("at").alias("at_us"))
    return rows.groupBy("key").transformWithStateInPandas(Staleness(idle_ms, retries), "key long, since_us long, attempt int, action string", "Append", "EventTime")


#: the same over a finished table: a gap of more than k times 45 minutes has k actions, four at most
STALE_SQL = """
WITH e AS (
  SELECT user_id AS key, epoch_us(ts) AS t, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS next FROM (SELECT DISTINCT user_id, ts FROM events) d
), k AS (SELECT unnest([1, 2, 3, 4]) AS k), w AS (SELECT epoch_ms(max(ts)) - 3600000 AS mark FROM events)
SELECT key, t AS since_us, k AS attempt, CASE WHEN k < 4 THEN 'retry' ELSE 'error' END AS action FROM e, k, w
WHERE (next IS NULL OR t + k * 2700000000 < next) AND ((t + k * 2700000000) // 60000000 + 1) * 60000 <= mark
"""


def run_stream(spark: SparkSession, stream: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Runs a stateful stream over what is there, into files; the same path again goes on from its checkpoint."""
    ship(spark)
    path = path or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        query = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start(path)
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(stream.schema).parquet(path)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    return rows.withColumn("at", F.col("ts").cast("timestamp"))


def q_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of users whose events are errors by more than 30 % on two days in a row."""
    return run_stream(spark, alert_transitions(_events(spark, sf_dir), "user_id", "event_type = 'error'"), "alerts")


def q_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as publishes and views as starts of a user's tasks."""
    rows = _events(spark, sf_dir).where("event_type IN ('click', 'view')").select("user_id", F.col("event_id").alias("id"), F.expr("event_type = 'click'").alias("publish"), "at")
    return run_stream(spark, task_waits(rows, "user_id"), "task-waits")


def q_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as tasks, their events as signs of life."""
    return run_stream(spark, stale_tasks(_events(spark, sf_dir), "user_id"), "stale")


QUERIES = {"stale_stream": q_stale, "alert_stream": q_alerts, "task_wait_stream": q_waits}
ORACLES = {"stale_stream": STALE_SQL, "alert_stream": ALERT_SQL}
