"""Stateful steps with event-time timers: state that ends when its time is over, and rows taken in event-time order.

A timer fires once the watermark has passed it, so by then every row before it that is not late has come. What arrives
before its turn waits in map state, one entry per bucket of ``BUCKET`` seconds; a timer at the end of a bucket takes that
bucket's rows in order. ``Packed`` runs such a step over plain rows and lets buckets of few rows share an entry and a timer,
since calls for state cost more than the rows. A task holds one bucket of one key, or the packs that overlap, and one batch
of input at a time, however many rows a key has in a trigger. Rows behind the watermark never reach a step; ``jobs.LateRows`` keeps them aside."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import groupby, islice

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .. import vocab as V

BUCKET = 60
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SECOND = 1_000_000  # event times are whole microseconds
NEVER = -2 ** 63  # a row without a time comes before all others
UNTIMED = 93_815_945  # the second that the counter has always given for such rows, what is left of NEVER in nanoseconds
PACK, BATCH = 256, 10_000  # rows of an entry that holds several buckets, and rows taken at a time to fill such entries


def micros(ts: pd.Series) -> pd.Series:
    return ts.astype("datetime64[us]").astype("int64")


def bucket_end(at: int) -> int:
    """Microseconds at which the bucket of ``at`` ends."""
    return (at // (BUCKET * SECOND) + 1) * BUCKET * SECOND


def timed(rows: DataFrame, keys: list[str], step: StatefulProcessor, schema: str, watermark: str) -> DataFrame:
    """Run ``step`` per key with event-time timers. Timers and map state need the RocksDB state store, which this sets."""
    rows.sparkSession.conf.set(PROVIDER, ROCKS)
    return rows.withWatermark("ts", watermark).groupBy(*keys).transformWithStateInPandas(step, schema, "append", "EventTime")


def timed_rows(rows: DataFrame, keys: list[str], step: StatefulProcessor, watermark: str) -> DataFrame:
    """``timed`` for steps that take plain rows, with their time in microseconds as ``at``: a frame per key costs more than
    the few rows a key mostly has."""
    rows.sparkSession.conf.set(PROVIDER, ROCKS)
    marked = rows.withWatermark("ts", watermark).withColumn("at", F.unix_micros("ts"))
    return marked.groupBy(*keys).transformWithState(step, step.output, "append", "EventTime")


class Ordered(StatefulProcessor):
    """Rows of a key in event-time order. A subclass names the ``fields`` it keeps of a row, the ``state`` schema and the
    ``columns`` of its output, and says what a row (``take``) and the passing of time (``tick``) do."""

    fields: list[str] = []
    state = ""
    columns: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ends long", "rows string")
        self.last = handle.getValueState("last", self.state)

    def take(self, key: tuple, last: tuple | None, at: int, row: tuple, out: list[tuple]) -> tuple | None:
        raise NotImplementedError

    def tick(self, key: tuple, last: tuple | None, now: int, out: list[tuple]) -> tuple[tuple | None, int | None]:
        """The state once all rows before ``now``, the end of a bucket, are taken; and a later end of a bucket (microseconds)
        at which to look again, if ever."""
        return last, None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ends = set()
        for chunk in rows:
            at = micros(chunk["ts"])
            for end, part in chunk.assign(ts=at).groupby(at.map(bucket_end)):
                kept = [[None if pd.isna(x) else x for x in row] for row in part[["ts", *self.fields]].astype(object).itertuples(index=False)]
                old = json.loads(self.waiting.getValue((int(end),))[0]) if self.waiting.containsKey((int(end),)) else []
                self.waiting.updateValue((int(end),), (json.dumps(old + kept, default=str),))
                ends.add(int(end))
        for end in ends:
            self.handle.registerTimer(end // 1000)
        yield pd.DataFrame(columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # everything before the last bucket's end that the watermark has passed is here, so later timers find nothing left
        now = timerValues.getCurrentWatermarkInMs() * 1000 // (BUCKET * SECOND) * BUCKET * SECOND
        last, out = tuple(self.last.get()) if self.last.exists() else None, []
        for end in sorted(k[0] for k in self.waiting.keys()):
            if end <= now:
                for at, *row in sorted(json.loads(self.waiting.getValue((end,))[0]), key=lambda r: (r[0], [str(x) for x in r[1:]])):
                    last = self.take(key, last, at, tuple(row), out)
                self.waiting.removeKey((end,))
        last, again = self.tick(key, last, now, out)
        if last is not None:
            self.last.update(last)
        elif self.last.exists():
            self.last.clear()
        if again is not None:
            self.handle.registerTimer(again // 1000)
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


class Packed(StatefulProcessor):
    """An ``Ordered`` step over plain rows. Waiting rows of neighbouring buckets share an entry of map state, a pack, as long as
    they are few; a key has one timer, at the end of its first waiting bucket, which sets the next."""

    def __init__(self, step: Ordered, output: str):
        self.step, self.output = step, output

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "starts long, ends long", "rows string")
        self.last = handle.getValueState("last", self.step.state)

    def _keep(self, rows: list[list]) -> int | None:
        """Put rows aside in packs; returns the end of their first bucket."""
        packs: list[list] = []
        for end, part in groupby(sorted(rows, key=lambda r: r[0]), key=lambda r: bucket_end(r[0])):
            part = list(part)
            if packs and len(packs[-1][2]) + len(part) <= PACK:
                packs[-1][1] = end
                packs[-1][2] += part
            else:
                packs.append([end, end, part])
        for starts, ends, part in packs:
            place = (starts, ends)
            old = json.loads(self.waiting.getValue(place)[0]) if self.waiting.containsKey(place) else []
            self.waiting.updateValue(place, (json.dumps(old + part, default=str),))
        return packs[0][0] if packs else None

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        firsts = []
        while batch := list(islice(rows, BATCH)):
            firsts.append(self._keep([[NEVER if r["at"] is None else r["at"], *[x if x == x else None for x in map(r.__getitem__, self.step.fields)]]
                                      for r in batch]))
        if firsts:
            self.handle.registerTimer(min(firsts) // 1000)
        return iter(())

    def _due(self, packs: list[tuple[int, int]], now: int, left: list[list]) -> Iterator[list]:
        """The rows before ``now`` in order, a pack being read when its first bucket's turn comes; later rows go to ``left``."""
        heap: list[tuple] = []
        for place in packs:
            while heap and bucket_end(heap[0][0]) < place[0]:
                yield heappop(heap)[-1]
            for n, row in enumerate(json.loads(self.waiting.getValue(place)[0])):
                if bucket_end(row[0]) <= now:
                    heappush(heap, (row[0], [str(x) for x in row[1:]], place, n, row))
                else:
                    left.append(row)
            self.waiting.removeKey(place)
        while heap:
            yield heappop(heap)[-1]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000 // (BUCKET * SECOND) * BUCKET * SECOND
        known = self.last.get()
        last, out, left = None if known is None else tuple(known), [], []
        before = last
        packs = sorted(tuple(k) for k in self.waiting.keys())
        for at, *row in self._due([p for p in packs if p[0] <= now], now, left):
            last = self.step.take(key, last, at, tuple(row), out)
        last, again = self.step.tick(key, last, now, out)
        if last is None and before is not None:
            self.last.clear()
        elif last != before:
            self.last.update(last)
        firsts = [p[0] for p in packs if p[0] > now][:1] + ([self._keep(left)] if left else [])
        for end in {*firsts, *([] if again is None else [again])}:
            self.handle.registerTimer(end // 1000)
        return (Row(**{c: x if x == x else None for c, x in zip(self.step.columns, r)}) for r in out)

    def close(self) -> None:
        pass


class Alerts(Ordered):
    """Regressions and gate failures of a branch against the finished audit before; a failed audit leaves the state alone."""

    fields = ["audit_id", "status", "score", "new_severe", "gate_passed"]
    state = "score double, passed boolean"
    columns = ["org_id", "repo_id", "branch", "audit_id", "event", "score_before", "score_after", "new_severe"]

    def take(self, key, last, at, row, out):
        audit_id, status, score, severe, gate = row
        if status == "failed":
            out.append((*key, audit_id, "audit.failed", None, None, None))
            return last
        before, passed = last or (None, None)
        if before is not None and (round(before - score, 1) >= V.REGRESSION_POINTS or severe > 0):
            out.append((*key, audit_id, "audit.regressed", before, score, severe))
        if not gate and passed is not False:
            out.append((*key, audit_id, "gate.failed", before, score, severe))
        return float(score), bool(gate)


class Expiry(Ordered):
    """Audits that stay in an active status beyond its limit: given as failed once the limit has passed in event time. A
    finished or expired audit has no state."""

    fields = ["status"]
    state = "status string, since long"
    columns = ["org_id", "audit_id", "status", "since"]

    def __init__(self, limits: dict[str, int]):
        self.limits = limits  # seconds per active status

    def _over(self, key, last, now, out):
        if last is not None and now > last[1] + self.limits[last[0]] * SECOND:
            out.append((*key, "failed", pd.Timestamp(last[1], unit="us")))
            return None
        return last

    def take(self, key, last, at, row, out):
        self._over(key, last, at, out)
        return (row[0], at) if row[0] in self.limits else None

    def tick(self, key, last, now, out):
        last = self._over(key, last, now, out)
        return last, None if last is None else bucket_end(last[1] + self.limits[last[0]] * SECOND)


class FirstHit(StatefulProcessor):
    """A counter per key that opens at a hit and is gone ``seconds`` later; every second with hits is given at once, with the
    count so far. Its state is the open window, which a timer removes."""

    output = "scope string, ident string, second long, hits long, over boolean"

    def __init__(self, limit: int, seconds: int):
        self.limit, self.seconds = limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "opened long, count long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        tally = Counter((NEVER if row["at"] is None else row["at"]) // SECOND for row in rows)
        known, count = self.window.get() or (None, 0)
        opened, out = known, []
        for second in sorted(tally):
            if opened is None or second - opened > self.seconds:
                opened, count = second, 0
            count += tally[second]
            out.append(Row(scope=key[0], ident=key[1], second=UNTIMED if second == NEVER // SECOND else second, hits=count,
                           over=count > self.limit))
        if opened != known:  # of the windows opened here only the last is kept, so it alone needs a timer
            self.handle.registerTimer(self._ends(opened))
        self.window.update((opened, count))
        return iter(out)

    def _ends(self, opened: int) -> int:
        """Milliseconds at which no hit can fall into the window any more."""
        return (opened + self.seconds + 1) * 1000

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        window = self.window.get()
        if window is not None and self._ends(window[0]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.window.clear()
        return iter(())

    def close(self) -> None:
        pass
