"""Event-time timers: order over triggers, expiry, late rows, restart from the checkpoint, state that goes away."""

import datetime
import random

import pandas as pd
import pytest

from fleetaudit.streaming import jobs as J
from fleetaudit.streaming import timers

START = datetime.datetime(2024, 5, 1, 12, 0, tzinfo=datetime.timezone.utc)


def at(minutes):
    return START + datetime.timedelta(minutes=minutes)


class Feed:
    """A stream of Parquet files, one per trigger, and a job on it whose checkpoint survives restarts."""

    def __init__(self, spark, folder, schema, job):
        self.spark, self.folder, self.schema, self.job, self.n = spark, str(folder), schema, job, 0

    def put(self, *batches):
        """Every batch in a trigger of its own; returns all output so far."""
        for rows in batches:
            self.n += 1
            self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
            stream = self.spark.readStream.schema(self.schema).parquet(f"{self.folder}/in")
            out = J.run_available(self.job(stream), self.folder)
        return out


CHANGES = "org_id string, audit_id string, ts timestamp, status string"


def test_expiry_in_event_order_over_triggers(spark, tmp_path):
    feed = Feed(spark, tmp_path, CHANGES, J.expire_stale)
    running = J.RUNNING_LIMIT_SECONDS // 60  # 35 minutes
    got = feed.put(
        [("o", "gone", at(0), "running"), ("o", "done", at(0), "running"), ("o", "waits", at(0), "queued"), ("o", "edge", at(1), "running"),
         ("o", "twice", at(0), "running"), ("o", "back", at(5), "succeeded")],
        # out of order over triggers, within the watermark: the change of "back" came first but is the later one
        [("o", "back", at(2), "running"), ("o", "done", at(9), "succeeded"), ("o", "twice", at(8), "running")],
        [("o", "edge", at(1 + running), "succeeded"), ("o", "clock", at(60), "succeeded")])
    show = lambda df: sorted((r["audit_id"], r["status"], r["since"]) for r in df.collect())
    local = lambda m: at(m).astimezone(datetime.timezone.utc).replace(tzinfo=None)
    expected = [("gone", "failed", local(0)), ("twice", "failed", local(8))]
    assert show(got) == expected
    # late: behind the watermark of 50 minutes, so it starts nothing; after a restart the rest goes on
    got = feed.put([("o", "late", at(3), "running"), ("o", "gone", at(55), "running"), ("o", "clock", at(6 * 60 + 20), "succeeded")],
                   [("o", "clock", at(6 * 60 + 30), "succeeded")])
    assert show(got) == sorted(expected + [("waits", "failed", local(0)), ("gone", "failed", local(55))])


FINISHED = ("org_id string, repo_id string, branch string, audit_id string, ts timestamp, status string, pr_number int, score double, "
            "new_severe long, gate_passed boolean")


def plain_alerts(rows):
    out, last = [], {}
    for o, r, b, audit, ts, status, pr, score, severe, gate in sorted(rows, key=lambda x: (x[4], x[3])):
        if pr is not None or status not in ("succeeded", "failed"):
            continue
        if status == "failed":
            out.append((r, audit, "audit.failed"))
            continue
        before, passed = last.get((o, r, b), (None, None))
        if before is not None and (round(before - score, 1) >= 5 or severe):
            out.append((r, audit, "audit.regressed"))
        if not gate and passed is not False:
            out.append((r, audit, "gate.failed"))
        last[(o, r, b)] = (score, gate)
    return sorted(out)


def test_alerts_do_not_depend_on_triggers(spark, tmp_path):
    rng = random.Random(4)
    rows = [("o", f"r{rng.randrange(4)}", "main", f"a{i:04d}", at(i / 7 + rng.random()), rng.choice(["succeeded"] * 5 + ["failed", "queued"]),
             rng.choice([None, None, None, 7]), float(rng.randrange(60, 100)), rng.randrange(5) // 4, rng.random() < 0.7) for i in range(300)]
    batches = [rows[i:i + 100] for i in range(0, 300, 100)]
    for batch in batches:
        rng.shuffle(batch)
    end = [("o", "end", "main", "z", at(500), "succeeded", None, 1.0, 0, True)]
    got = Feed(spark, tmp_path, FINISHED, J.audit_alerts).put(*batches, end)
    assert sorted((r["repo_id"], r["audit_id"], r["event"]) for r in got.collect()) == plain_alerts(rows)


def test_a_counter_goes_away_with_its_window(spark, tmp_path):
    feed = Feed(spark, tmp_path, "scope string, ident string, ts timestamp", lambda s: J.first_hit_windows(s, 2, 600))
    got = feed.put([("s", "a", at(0)), ("s", "a", at(3)), ("s", "a", at(10)), ("s", "b", at(1))], [("s", "a", at(11)), ("s", "c", at(60))], [("s", "a", at(61))])
    rows = sorted((r["ident"], int((r["ts"].replace(tzinfo=datetime.timezone.utc) - START).total_seconds() // 60), r["hits"], r["over"]) for r in got.collect())
    assert rows == [("a", 0, 1, False), ("a", 3, 2, False), ("a", 10, 3, True), ("a", 11, 1, False), ("a", 61, 1, False), ("b", 1, 1, False), ("c", 60, 1, False)]
    values = spark.read.format("statestore").option("stateVarName", "window").load(f"{feed.folder}/checkpoint")
    assert {r["key"]["ident"] for r in values.select("key").collect()} == {"a", "c"}


class Memory:
    """Map and value state of one key, and how many rows the largest entry read at once had."""

    def __init__(self):
        self.map, self.value, self.timers, self.largest = {}, None, set(), 0

    def getMapState(self, *_):
        return self

    def containsKey(self, key):
        return key in self.map

    def getValue(self, key):
        self.largest = max(self.largest, self.map[key][0].count('"a'))
        return self.map[key]

    def updateValue(self, key, value):
        self.map[key] = value

    def keys(self):
        return iter(list(self.map))

    def removeKey(self, key):
        del self.map[key]

    def getValueState(self, *_):
        memory = self

        class Value:
            def exists(self):
                return memory.value is not None

            def get(self):
                return memory.value

            def update(self, value):
                memory.value = value

            def clear(self):
                memory.value = None

        return Value()

    def registerTimer(self, at_ms):
        self.timers.add(at_ms)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_a_branch_with_many_rows_is_held_a_bucket_at_a_time():
    memory, step = Memory(), timers.Alerts()
    step.init(memory)
    ts = pd.date_range("2024-05-01", periods=60_000, freq="s")
    chunks = (pd.DataFrame({"ts": ts[i:i + 10_000], "audit_id": [f"a{k}" for k in range(i, i + 10_000)], "status": "succeeded",
                            "score": [90.0 - k % 2 * 10 for k in range(10_000)], "new_severe": 0, "gate_passed": True}) for i in range(0, 60_000, 10_000))
    list(step.handleInputRows(("o", "r", "b"), chunks, None))
    assert len(memory.timers) == 1000
    watermark = int(ts[-1].timestamp() * 1000) - 600_000
    memory.largest = 0
    out = pd.concat(step.handleExpiredTimer(("o", "r", "b"), Clock(watermark), None))
    assert memory.largest == timers.BUCKET
    assert len(out) == 59_340 / 2 and set(out["event"]) == {"audit.regressed"}
    assert len(memory.map) == 11  # what the watermark has not passed


@pytest.mark.parametrize("micro, end", [(0, 60_000_000), (59_999_999, 60_000_000), (60_000_000, 120_000_000), (-1, 0)])
def test_bucket_ends(micro, end):
    assert timers.bucket_end(micro) == end


ACTIVITY = "org_id string, audit_id string, seq long, ts timestamp, msg string"


def events(spark, audits, first, n=3):
    return spark.createDataFrame([("o", a, first + i, at(first + i), f"m{first + i}") for a in audits for i in range(n)], ACTIVITY)


def test_tail_rewrites_touched_buckets_only_and_survives_restarts(spark, tmp_path):
    tail = J.ActivityTail(spark, str(tmp_path), limit=4, buckets=8)
    assert tail.read(ACTIVITY).count() == 0
    names = [f"a{i}" for i in range(60)]
    tail.merge(events(spark, names, 0), 0)
    before = tail.table.pointer()["entries"]
    assert len(before) == 8
    tail.merge(events(spark, ["a7"], 3), 1)
    after = J.ActivityTail(spark, str(tmp_path), limit=4, buckets=99).table.pointer()  # a restart keeps the number of buckets
    moved = [b for b in before if after["entries"][b] != before[b]]
    assert len(moved) == 1 and after["buckets"] == 8 and after["epoch"] == 1
    files = sorted((tmp_path / "tail").rglob("*.parquet"))
    tail.merge(events(spark, ["a7", "a8"], 100), 1)  # a replayed epoch changes nothing
    assert sorted((tmp_path / "tail").rglob("*.parquet")) == files
    rows = J.ActivityTail(spark, str(tmp_path)).read(ACTIVITY)
    assert sorted(r["seq"] for r in rows.where("audit_id = 'a7'").collect()) == [2, 3, 4, 5]
    assert rows.count() == 59 * 3 + 4 and {r["seq"] for r in tail.read(ACTIVITY, after=4).collect()} == {5}
    # an epoch that breaks before its pointer is not seen, and its replay is whole
    tail.table.write(events(spark, names, 50).selectExpr("*", "0 as bucket"), 2)
    assert tail.read(ACTIVITY).count() == rows.count()
    tail.merge(events(spark, ["a8"], 60, 1), 2)
    assert sorted(r["seq"] for r in tail.read(ACTIVITY).where("audit_id = 'a8'").collect()) == [0, 1, 2, 60]


REPORTED = "org_id string, repo_id string, fingerprint string, ts timestamp"


def prints(spark, numbers, minute):
    return spark.createDataFrame([("o", f"r{i % 3}", f"f{i}", at(minute)) for i in numbers], REPORTED)


def test_first_seen_reads_only_folders_that_may_match(spark, tmp_path, monkeypatch):
    table = J.FirstSeen(spark, str(tmp_path), buckets=16, runs=3)
    table.merge(prints(spark, range(500), 0), 0)
    asked = []
    whole = table.table.read
    monkeypatch.setattr(table.table, "read", lambda schema, buckets=None, only=None: asked.append(only) or whole(schema, buckets, only))
    table.merge(prints(spark, range(500, 520), 1), 1)  # all new: the filters keep nearly all folders closed
    opened = sum(len(e) for e in (asked[0] or {}).values()) if asked[0] and all(e == [0] for e in asked[0].values()) else 0
    assert opened <= 2
    asked.clear()
    table.merge(prints(spark, [3, 3, 600], 2), 2)  # one known: its folder, perhaps one more
    assert 1 <= sum(len(e) for e in asked[0].values()) <= 3
    table.merge(prints(spark, [3, 3, 600, 700], 9), 2)  # a replay
    monkeypatch.undo()
    for epoch, minute in ((3, 3), (4, 4), (5, 5), (6, 6)):
        table.merge(prints(spark, [*range(0, 500, 7), 1000 + epoch, 1010 + epoch], minute), epoch)
    rows = {r["fingerprint"]: r["first_seen_at"] for r in J.FirstSeen(spark, str(tmp_path)).read().collect()}
    stamp = lambda m: at(m).replace(tzinfo=None)
    expected = {f"f{i}": stamp(0) for i in range(500)} | {f"f{i}": stamp(1) for i in range(500, 520)} | {"f600": stamp(2)}
    expected |= {f"f{k + e}": stamp(e) for e in (3, 4, 5, 6) for k in (1000, 1010)}
    assert rows == expected
    assert table.read().count() == len(expected)
    assert max(len(e) for e in table.table.pointer()["entries"].values()) <= 3


def test_filters_miss_nothing_and_hit_little():
    import numpy as np

    from fleetaudit.streaming import blooms

    rng = np.random.default_rng(1)
    h = rng.integers(-2 ** 63, 2 ** 63, 20_000, dtype=np.int64)
    bits = blooms.filter_of(h[:10_000])
    assert blooms.may_have(bits, h[:10_000]).all() and blooms.may_have(bits, h[10_000:]).mean() < 0.005
    assert not blooms.may_have(blooms.filter_of(h[:0]), h[:5]).any()


def test_late_rows_are_kept_counted_and_survive_restarts(spark, tmp_path):
    batch = lambda *minutes: spark.createDataFrame([(m, at(m)) for m in minutes], "n int, ts timestamp")
    late = J.LateRows(spark, str(tmp_path))
    late.merge(batch(100, 0, 50), 0)  # nothing has been seen before
    late.merge(batch(90, 89, 120, 95), 1)
    late = J.LateRows(spark, str(tmp_path))
    late.merge(batch(109, 110, 111), 2)
    late.merge(batch(109, 110, 111), 2)  # a replay
    late.merge(batch(), 3)
    late.merge(batch(5), 4)
    got = lambda x: sorted(r["n"] for r in late.read("n int, ts timestamp", x).collect())
    assert got(True) == [5, 89, 109] and got(False) == [0, 50, 90, 95, 100, 110, 111, 120]
    assert sorted((r["epoch"], r["rows"], r["late"]) for r in late.marks().collect()) == [(0, 3, 0), (1, 4, 1), (2, 3, 1), (3, 0, 0), (4, 1, 1)]


def test_fan_out_by_channel_and_replayed(spark, tmp_path):
    alerts = spark.createDataFrame([("o", "r", "main", f"a{i}", e, None, None, None) for i, e in enumerate(["audit.failed", "gate.failed", "audit.regressed"])], J.ALERT)
    channels = spark.createDataFrame([("o", "c1", "email", ["audit.failed", "gate.failed"], True), ("o", "c2", "slack", ["gate.failed"], True),
                                      ("o", "c3", "slack", ["audit.failed"], False), ("p", "c4", "email", ["audit.failed"], True), ("o", "c5", "email", None, True)],
                                     "org_id string, channel_id string, kind string, events array<string>, enabled boolean")
    desk = J.FanOut(channels, str(tmp_path))
    for epoch in (0, 1, 1):
        desk.merge(alerts, epoch)
    rows = desk.deliveries(J.ALERT + ", channel_id string, kind string").collect()
    once = [("a0", "c1", "email"), ("a1", "c1", "email"), ("a1", "c2", "slack")]
    assert sorted((r["audit_id"], r["channel_id"], r["kind"]) for r in rows) == sorted(once * 2)
    assert spark.read.schema(J.ALERT).parquet(f"{tmp_path}/log").count() == 6


def test_a_key_of_many_sparse_rows_asks_little_of_the_state():
    from pyspark.sql import Row

    # one timer for the window that is kept, none for those that the same rows close
    memory, step = Memory(), timers.FirstHit(2, 600)
    step.init(memory)
    out = list(step.handleInputRows(("s", "a"), (Row(at=k * 3_600_000_000) for k in range(500)), None))
    assert [(r["second"], r["hits"]) for r in out] == [(k * 3600, 1) for k in range(500)]
    assert memory.timers == {(499 * 3600 + 601) * 1000}
    step.init(Memory())
    out = list(step.handleInputRows(("s", "a"), iter([Row(at=0), Row(at=None)]), None))
    assert [(r["second"], r["hits"]) for r in out] == [(timers.UNTIMED, 1), (0, 1)]

    # rows hours apart share entries, in any order of arrival, and a key has one timer at a time
    memory, step = Memory(), timers.Packed(timers.Alerts(), J.ALERT)
    step.init(memory)
    rows = [Row(at=k * 3_600_000_000, audit_id=f"a{k:03d}", status="succeeded", score=90.0 - k % 2 * 10, new_severe=0, gate_passed=True) for k in range(600)]
    random.Random(1).shuffle(rows)
    for part in (rows[:400], rows[400:]):
        assert not list(step.handleInputRows(("o", "r", "b"), iter(part), None))
    first = timers.bucket_end(0) // 1000
    assert len(memory.map) == 3 and len(memory.timers) == 2 and min(memory.timers) == first
    out = list(step.handleExpiredTimer(("o", "r", "b"), Clock(300 * 3_600_000), None))
    assert [r["audit_id"] for r in out] == [f"a{k:03d}" for k in range(1, 300, 2)]
    assert (300 * 3600 + 60) * 1000 in memory.timers
    out = list(step.handleExpiredTimer(("o", "r", "b"), Clock(700 * 3_600_000), None))
    assert [r["audit_id"] for r in out] == [f"a{k:03d}" for k in range(301, 600, 2)] and not memory.map
