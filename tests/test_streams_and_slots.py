"""Versioned slots, stream ingestion, and keyed state: restarts, late rows and plain versions."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.sources.slots import Slots
from docweave.streaming import ingest, state

SCHEMA = "k long, v string"


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/{uuid.uuid4().hex}"


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def held(slots):
    return sorted(map(tuple, slots.read().collect()), key=str)


# slots ---------------------------------------------------------------------------------------------------


def test_commits_equal_a_plain_table(spark, folder):
    slots, plain, rng = Slots(spark, folder, SCHEMA, "k", slots=4), [], np.random.default_rng(4)
    assert held(slots) == []
    for n in range(12):
        pairs = [(int(k), f"r{n}") for k in rng.integers(0, 30, rng.integers(0, 9))]
        kind = ["append", "upsert", "insert", "delete"][n % 4]
        keys = {k for k, _ in pairs}
        if kind == "append":
            plain += pairs
        elif kind == "insert":
            plain += [p for p in pairs if p[0] not in {k for k, _ in plain}]
        else:
            plain = [p for p in plain if p[0] not in keys] + (pairs if kind == "upsert" else [])
        assert getattr(slots, kind)(f"run-{n}", rows(spark, *pairs))
        assert held(slots) == sorted(plain, key=str)
        assert not getattr(slots, kind)(f"run-{n}", rows(spark, (77, "again")))  # a run that was done changes nothing
    assert held(slots) == sorted(plain, key=str)
    assert slots.vacuum() > 0 and held(slots) == sorted(plain, key=str) and slots.vacuum() == 0
    assert sorted(map(tuple, slots.read([0, 1]).union(slots.read([2, 3])).collect()), key=str) == sorted(plain, key=str)


def test_null_keys_can_only_be_appended(spark, folder):
    slots = Slots(spark, folder, SCHEMA, "k", slots=3)
    slots.append("a", rows(spark, (None, "x"), (1, "y")))
    slots.upsert("b", rows(spark, (None, "z"), (1, "w")))
    assert held(slots) == [(1, "w"), (None, "x"), (None, "z")]
    slots.delete("c", rows(spark, (None, "")))
    assert len(held(slots)) == 3


@pytest.mark.parametrize("fails_at", ["data", "runs", "current"])
def test_a_killed_run_leaves_the_old_version(spark, folder, monkeypatch, fails_at):
    slots = Slots(spark, folder, SCHEMA, "k", slots=2)
    slots.append("first", rows(spark, (1, "a"), (2, "b"), (3, "c")))
    small = Slots._small

    def killed(self, data, schema, path):
        if fails_at in ("data", path.split("/")[-2]):
            raise RuntimeError("killed")
        small(self, data, schema, path)

    monkeypatch.setattr(Slots, "_small", killed)
    with pytest.raises(RuntimeError):
        slots.upsert("second", rows(spark, (1, "new"), (4, "new")))
    monkeypatch.setattr(Slots, "_small", small)
    assert held(slots) == [(1, "a"), (2, "b"), (3, "c")]
    assert not slots.done("second") and slots.upsert("second", rows(spark, (1, "new"), (4, "new")))
    assert held(slots) == [(1, "new"), (2, "b"), (3, "c"), (4, "new")]


# ingestion -----------------------------------------------------------------------------------------------


def fold_pages(batches):
    known = {}
    for batch in batches:
        last = {}
        for url, version, content in batch:
            if url is not None and (content or "").strip():
                last[url] = max(last.get(url, (-1, "")), (version, content))
        for url, (version, content) in last.items():
            if known.get(url, (None, None))[1] != content:
                known[url] = (version, content)
    return sorted((u, v, c) for u, (v, c) in known.items())


def test_stream_of_pages_is_taken_once(spark, folder):
    batches = [
        [("/a", 1, "one"), ("/b", 1, "two"), ("/a", 2, "one more"), (None, 1, "x"), ("/e", 1, "  ")],
        [("/a", 3, "one more"), ("/b", 2, "changed"), ("/c", 1, "new"), ("/e", 2, None)],
        [("/b", 3, "changed"), ("/c", 2, ""), ("/d", 1, "late")],
    ]
    schema = "url string, version int, content string"
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}-in")
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{folder}-in")
        if k != 1:  # the second and third file are taken by one start
            ingest.ingest(stream(), folder, f"{folder}-state")
    slots = Slots(spark, folder, ingest.PAGES, "url")
    got = sorted((r.url, r.version, r.content) for r in slots.read().collect())
    assert got == fold_pages(batches)
    before = slots.newest()
    assert not ingest.ingest_batch(slots, spark.createDataFrame(batches[0], schema), "pages-0")  # a replayed batch
    ingest.ingest(stream(), folder, f"{folder}-state")
    assert slots.newest() == before and sorted((r.url, r.version, r.content) for r in slots.read().collect()) == got


# keyed state ---------------------------------------------------------------------------------------------

DAY = state.DAY_MS


def fold_alerts(events, watermark_ms, percent=30.0, hold=2):
    out = []
    for key in {k for k, _, _ in events}:
        days = {}
        for k, at, bad in events:
            if k == key:
                n, b = days.get(at // DAY, (0, 0))
                days[at // DAY] = (n + 1, b + bad)
        streak = 0
        for d in range(min(days), watermark_ms // DAY):
            n, bad = days.get(d, (0, 0))
            end = (d + 1) * DAY
            if n and 100 * bad / n > percent:
                streak += 1
                out += [(key, end, s) for s in (["pending"] if streak == 1 else []) + (["firing"] if streak == hold else [])]
            else:
                # an empty window is noticed by the next one that has rows
                if streak >= hold and any(x > d or (x == d and n) for x in days if x < watermark_ms // DAY):
                    out.append((key, end, "resolved"))
                streak = 0
    return sorted(out)


def write_events(spark, folder, events, part):
    df = spark.createDataFrame([(k, at, bool(bad)) for k, at, bad in events], "who long, ms long, bad boolean")
    df.withColumn("at", F.timestamp_millis("ms")).coalesce(1).write.mode("append").parquet(f"{folder}-in")


def alert_source(spark, folder):
    return spark.readStream.schema("who long, ms long, bad boolean, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}-in")


def test_alerts_over_restarts_and_late_rows(spark, folder):
    rng = np.random.default_rng(5)
    base = 19_700 * DAY
    events = [(int(k), base + int(t), int(b)) for k, t, b in zip(rng.integers(0, 5, 900), np.sort(rng.integers(0, 14 * DAY, 900)), rng.random(900) < 0.32, strict=True)]
    events = [e for e in events if not (e[0] == 2 and 4 <= (e[1] - base) // DAY <= 6)]  # days without rows
    thirds = [events[:300], events[300:600], events[600:]]
    late = [(9, base + DAY // 2, 1)]  # days behind the watermark
    for k, part in enumerate(thirds):
        write_events(spark, folder, part + (late if k == 2 else []), k)
        state.run_stream(spark, state.alert_transitions(alert_source(spark, folder), "who", "bad"), "alerts", folder)
    got = sorted((r.key, r.at_ms, r.state) for r in spark.read.parquet(folder).collect())
    watermark = max(at for _, at, _ in events) - 3_600_000
    assert got == fold_alerts(events, watermark)
    assert {s for _, _, s in got} == {"pending", "firing", "resolved"}


def test_pairing_equals_a_fold_and_goes_on_after_a_restart(spark, folder):
    rng = np.random.default_rng(8)
    base = 19_700 * DAY * 1000
    at = np.sort(rng.integers(0, 40 * 3_600_000_000, 500))
    events = [(int(k), base + int(t), int(i), bool(p)) for i, (k, t, p) in enumerate(zip(rng.integers(0, 4, 500), at, rng.random(500) < 0.5, strict=True))]
    for part in (events[:260], events[260:]):
        df = spark.createDataFrame(part, "who long, us long, id long, publish boolean").withColumn("at", F.timestamp_micros("us"))
        df.coalesce(1).write.mode("append").parquet(f"{folder}-in")
        source = spark.readStream.schema("who long, us long, id long, publish boolean, at timestamp").parquet(f"{folder}-in")
        state.run_stream(spark, state.task_waits(source, "who"), "waits", folder)
    got = [(r.key, r.publish, r.start, r.waited_us) for r in spark.read.parquet(folder).collect()]
    watermark = (max(e[1] for e in events) // 1000 - 3_600_000) * 1000
    want = []
    for key in range(4):
        want += [(key, *p) for p in state.pairs_of([(t, i, p) for k, t, i, p in events if k == key], watermark, 3_600_000_000)]
    assert sorted(got, key=str) == sorted(want, key=str)
    taken = [x[2] for x in got if x[2] is not None]
    assert len(set(taken)) == len(taken) and len({x[1] for x in got}) == len(got)


def test_pairing_of_the_events_table(spark, sf):
    from docweave import registry

    got = {(r.key, r.publish, r.start, r.waited_us) for r in registry.queries()["task_wait_stream"](spark, sf).collect()}
    events = [(r.user_id, r.us, r.event_id, r.event_type == "click") for r in spark.read.parquet(f"{sf}/events.parquet").where("event_type IN ('click', 'view')").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).collect()]
    watermark = (max(e[1] for e in events) // 1000 - 3_600_000) * 1000
    pairs = {(k, *p) for k in {e[0] for e in events} for p in state.pairs_of([(t, i, p) for u, t, i, p in events if u == k], watermark, 3_600_000_000)}
    assert got == pairs


def test_stale_tasks_over_a_restart(spark, folder):
    rng = np.random.default_rng(6)
    base, minute = 19_700 * DAY * 1000, 60_000_000
    signs = [(int(k), base + int(t)) for k, t in zip(rng.integers(0, 6, 240), np.sort(rng.integers(0, 90 * 3_600_000_000, 240)), strict=True)]
    signs = [s for s in signs if s[0] or s[1] < base + 20 * 3_600_000_000]  # one task ends early
    for part in (signs[:110], signs[110:]):
        df = spark.createDataFrame(part, "who long, us long").withColumn("at", F.timestamp_micros("us"))
        df.coalesce(1).write.mode("append").parquet(f"{folder}-in")
        source = spark.readStream.schema("who long, us long, at timestamp").parquet(f"{folder}-in")
        state.run_stream(spark, state.stale_tasks(source, "who"), "stale", folder)
    got = sorted(tuple(r) for r in spark.read.parquet(folder).select("key", "since_us", "attempt", "action").collect())
    watermark = (max(t for _, t in signs) // 1000 - 3_600_000) * 1000
    want = []
    for key in range(6):
        own = sorted(t for k, t in signs if k == key)
        for t, after in zip(own, [*own[1:], None], strict=True):
            moments = [(k, t + k * 45 * minute) for k in range(1, 5)]
            want += [(key, t, k, "retry" if k < 4 else "error") for k, x in moments if (after is None or x < after) and (x // minute + 1) * minute <= watermark]
    assert got == sorted(want) and any(a == "error" for *_, a in got)
