"""Streaming jobs. Each builder maps a streaming DataFrame to a streaming DataFrame; ``run_available`` drives one to
the end of its input with exactly-once file output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import vocab as V
from . import blooms, timers
from .versions import Versioned

WATERMARK = "10 minutes"  # our own policy; ``LateRows`` keeps later rows in a side table
RUNNING_LIMIT_SECONDS = 6 * 300 + 300
QUEUED_LIMIT_SECONDS = 6 * 3600


def run_available(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Process everything available now, write parquet below ``folder`` and return the written table."""
    query = (stream.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out")
             .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def run_batches(stream: DataFrame, folder: str, merge: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Drive ``merge(batch, epoch)`` over everything available now."""
    query = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint")
             .foreachBatch(merge).trigger(availableNow=True).start())
    query.awaitTermination()


# --- T1 --------------------------------------------------------------------------------------------
def rate_windows(hits: DataFrame, limit: int, seconds: int) -> DataFrame:
    """Hits per (scope, ident) in fixed windows, flagged above the limit. Counts combine before the shuffle, so one
    noisy caller costs one row per task and window."""
    counted = hits.withWatermark("ts", WATERMARK).groupBy(
        F.window("ts", f"{seconds} seconds").alias("w"), "scope", "ident").agg(F.count(F.lit(1)).alias("hits"))
    return counted.select(F.col("w.start").alias("window_start"), "scope", "ident", "hits",
                          (F.col("hits") > limit).alias("over"))


def first_hit_windows(hits: DataFrame, limit: int, seconds: int) -> DataFrame:
    """Windows that open at a key's first hit and close after ``seconds``, as a counter with expiry behaves. A key whose
    window has passed has no state (see ``timers.FirstHit``)."""
    counted = timers.timed_rows(hits, ["scope", "ident"], timers.FirstHit(limit, seconds), WATERMARK)
    return counted.select("scope", "ident", F.timestamp_seconds("second").alias("ts"), "hits", "over")


# --- T2, T4 ----------------------------------------------------------------------------------------
ALERT = ("org_id string, repo_id string, branch string, audit_id string, event string, score_before double, "
         "score_after double, new_severe long")


def audit_alerts(finished: DataFrame) -> DataFrame:
    """Regressions and gate failures per branch, pull requests excluded, in event-time order as the watermark passes.

    ``finished``: org_id, repo_id, branch, audit_id, ts, status, pr_number, score, new_severe, gate_passed. State per
    branch is the last score and gate verdict and what the watermark has not passed. A failed audit alerts and leaves the
    verdict alone."""
    branch = finished.filter(F.col("pr_number").isNull() & F.col("status").isin("succeeded", "failed"))
    return timers.timed_rows(branch, ["org_id", "repo_id", "branch"], timers.Packed(timers.Alerts(), ALERT), WATERMARK)


def notify(alerts: DataFrame, channels: DataFrame) -> DataFrame:
    """Fan alerts out to the enabled channels subscribed to the event (stream-static join on the organization)."""
    wanted = channels.filter("enabled").select("org_id", "channel_id", "kind", F.explode("events").alias("event"))
    return alerts.join(wanted, ["org_id", "event"])


class FanOut:
    """Alerts of a stream to their sinks, each micro-batch read once: the log of all alerts, and deliveries by kind of
    channel. An epoch that runs again writes the same folders again."""

    def __init__(self, channels: DataFrame, folder: str):
        self.channels, self.folder = channels, folder

    def merge(self, batch: DataFrame, epoch: int) -> None:
        batch.persist()
        batch.write.mode("overwrite").parquet(f"{self.folder}/log/epoch={epoch}")
        notify(batch, self.channels).write.mode("overwrite").partitionBy("kind").parquet(f"{self.folder}/deliveries/epoch={epoch}")
        batch.unpersist()

    def deliveries(self, schema: str) -> DataFrame:
        """``schema`` has the columns of an alert and of a channel, kind included."""
        return self.channels.sparkSession.read.schema(schema).parquet(f"{self.folder}/deliveries")


class LateRows:
    """Rows behind the watermark, kept in a table of their own and counted, next to those on time. The watermark of an epoch
    follows the rows of the epochs before; it is written with the epoch, so a restart goes on with it."""

    def __init__(self, spark: SparkSession, folder: str, delay: str = WATERMARK):
        self.spark, self.folder, self.delay = spark, folder, delay

    def _seen(self, before: int):
        """The latest time of the epochs before ``before``; null without any."""
        if before == 0:
            return None
        marks = self.spark.read.schema("epoch int, seen timestamp, rows long, late long").parquet(f"{self.folder}/marks")
        return marks.where(F.col("epoch") < before).agg(F.max("seen")).first()[0]

    def merge(self, batch: DataFrame, epoch: int) -> None:
        seen = self._seen(epoch)
        watched = Observation()
        is_late = F.lit(False) if seen is None else F.col("ts") < F.lit(seen) - F.expr(f"INTERVAL {self.delay}")
        marked = batch.withColumn("late", is_late).observe(
            watched, F.count(F.lit(1)).alias("rows"), F.count_if("late").alias("late"), F.max("ts").alias("seen"))
        marked.write.mode("overwrite").partitionBy("late").parquet(f"{self.folder}/rows/epoch={epoch}")
        told = watched.get
        latest = max((t for t in (seen, told.get("seen")) if t is not None), default=None)
        self.spark.createDataFrame([(latest, told["rows"], told["late"])], "seen timestamp, rows long, late long").coalesce(1).write.mode(
            "overwrite").parquet(f"{self.folder}/marks/epoch={epoch}")

    def read(self, schema: str, late: bool) -> DataFrame:
        return self.spark.read.schema(f"{schema}, late boolean").parquet(f"{self.folder}/rows").where(F.col("late") == late).drop("late")

    def marks(self) -> DataFrame:
        return self.spark.read.schema("epoch int, seen timestamp, rows long, late long").parquet(f"{self.folder}/marks")


# --- T3 --------------------------------------------------------------------------------------------
def route_deliveries(events: DataFrame) -> DataFrame:
    """Which handler a webhook delivery goes to."""
    kind, action = F.col("event"), F.col("action")
    return events.withColumn("route", F.when(kind == "ping", "ping").when(
        (kind == "pull_request") & action.isin("opened", "synchronize", "reopened", "ready_for_review"), "audit_pull").when(
        (kind == "check_run") & (action == "rerequested"), "audit_pull").when(kind == "push", "audit_push").when(
        kind == "installation", "installation").otherwise("ignored"))


def unique_deliveries(deliveries: DataFrame) -> DataFrame:
    """First delivery of each (organization, repository, commit, pull request) within the watermark."""
    return deliveries.withWatermark("ts", WATERMARK).dropDuplicatesWithinWatermark(["org_id", "repo_id", "sha", "pr"])


def not_yet_audited(deliveries: DataFrame, audits: DataFrame) -> DataFrame:
    """Batch form: deliveries whose commit and pull request have no queued, running or succeeded audit."""
    done = audits.filter(F.col("status").isin("queued", "running", "succeeded")).select(
        "org_id", "repo_id", "sha", F.coalesce("pr_number", F.lit(0)).alias("pr")).distinct()
    return deliveries.join(done, ["org_id", "repo_id", "sha", "pr"], "left_anti")


# --- T5 --------------------------------------------------------------------------------------------
def expire_stale(changes: DataFrame) -> DataFrame:
    """Audits whose status stays queued or running past its limit in event time.

    ``changes``: org_id, audit_id, ts, status. Changes are taken in event-time order, whatever the triggers they came in;
    of changes at the same time the last in text order counts."""
    limits = {s: RUNNING_LIMIT_SECONDS if s == "running" else QUEUED_LIMIT_SECONDS for s in V.ACTIVE_STATUSES}
    step = timers.Packed(timers.Expiry(limits), "org_id string, audit_id string, status string, since timestamp")
    return timers.timed_rows(changes, ["org_id", "audit_id"], step, WATERMARK)


def stale_audits(audits: DataFrame, now: str) -> DataFrame:
    """Batch form: audits that can no longer be running."""
    moment = F.lit(now).cast("timestamp")
    running = (F.col("status") == "running") & (F.col("started_at") < moment - F.expr(
        f"INTERVAL {RUNNING_LIMIT_SECONDS} SECONDS"))
    queued = (F.col("status") == "queued") & (F.col("created_at") < moment - F.expr(
        f"INTERVAL {QUEUED_LIMIT_SECONDS} SECONDS"))
    return audits.filter(running | queued)


# --- T6 --------------------------------------------------------------------------------------------
def due_repositories(repositories: DataFrame, audits: DataFrame, now: str) -> DataFrame:
    """Repositories whose schedule asks for an audit: never audited, or the newest one is an interval (less half an
    hour) old."""
    moment = F.lit(now).cast("timestamp")
    days = F.when(F.col("schedule") == "daily", 1).when(F.col("schedule") == "weekly", 7)
    newest = audits.filter(F.col("pr_number").isNull() & F.col("status").isin("queued", "running", "succeeded")).groupBy(
        "org_id", "repo_id").agg(F.max("created_at").alias("last_at"))
    rows = repositories.filter(F.col("schedule").isin("daily", "weekly")).join(newest, ["org_id", "repo_id"], "left")
    age = F.unix_timestamp(moment) - F.unix_timestamp("last_at")
    return rows.filter(F.col("last_at").isNull() | (age >= days * 86400 - 1800))


# --- T7 --------------------------------------------------------------------------------------------
class ActivityTail:
    """Keeps the last events per audit. An epoch reads and rewrites the buckets its audits fall into; a reader needs only
    the folder."""

    KEYS = ("org_id", "audit_id")

    def __init__(self, spark: SparkSession, folder: str, limit: int = V.ACTIVITY_RING, buckets: int = 64):
        self.table, self.limit = Versioned(spark, f"{folder}/tail", buckets), limit

    def merge(self, batch: DataFrame, epoch: int) -> None:
        from ..operators.history import activity_tail

        if self.table.done(epoch):
            return
        batch.persist()
        touched = [r[0] for r in batch.select(self.table.bucket(*self.KEYS)).distinct().collect()]
        kept = self.table.read(batch.schema, touched).unionByName(batch)
        rows = activity_tail(kept, list(self.KEYS), self.limit).drop("rank").withColumn("bucket", self.table.bucket(*self.KEYS))
        entries = (self.table.pointer() or {"entries": {}})["entries"]
        self.table.commit(epoch, entries | {b: [epoch] for b in self.table.write(rows, epoch)})
        batch.unpersist()

    def read(self, schema, after: int | None = None) -> DataFrame:
        rows = self.table.read(schema)
        return rows if after is None else rows.filter(F.col("seq") > after)


# --- T8 --------------------------------------------------------------------------------------------
class FirstSeen:
    """First time each (repository, fingerprint) was reported, as a table of new fingerprints in hash buckets.

    Every folder has Bloom filters of its fingerprints. An epoch asks the filters of the buckets it touches and reads only
    folders that may hold one of its fingerprints. A bucket of more than ``runs`` folders is merged into one."""

    KEYS = ("org_id", "repo_id", "fingerprint")
    SCHEMA = "org_id string, repo_id string, fingerprint string, first_seen_at timestamp"

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64, runs: int = 8):
        self.spark, self.runs = spark, runs
        self.table = Versioned(spark, f"{folder}/first_seen", buckets)

    def read(self) -> DataFrame:
        return self.table.read(self.SCHEMA)

    def _filters(self, epoch: int) -> str:
        return f"{self.table.folder}/filters/epoch={epoch}"

    def may_hold(self, fresh: DataFrame, entries: dict[int, list[int]], touched: list[int]) -> dict[int, list[int]]:
        """The folders (bucket -> epochs) that may hold a fingerprint of ``fresh``; at most all folders of its buckets."""
        epochs = sorted({e for b in touched for e in entries.get(b, [])})
        if not epochs:
            return {}
        live = self.spark.createDataFrame([(b, e) for b in touched for e in entries.get(b, [])], "bucket int, epoch int")
        filters = self.spark.read.schema(blooms.SCHEMA).parquet(*map(self._filters, epochs)).join(F.broadcast(live), ["bucket", "epoch"])
        out: dict[int, list[int]] = {}
        for r in blooms.hits(fresh.select("bucket", blooms.hashed(*self.KEYS).alias("h")), filters).distinct().collect():
            out.setdefault(r["bucket"], []).append(r["epoch"])
        return out

    def merge(self, batch: DataFrame, epoch: int) -> None:
        if self.table.done(epoch):
            return
        found = batch.groupBy(*self.KEYS).agg(F.min("ts").alias("first_seen_at")).withColumn("bucket", self.table.bucket(*self.KEYS)).persist()
        touched = [r[0] for r in found.select("bucket").distinct().collect()]
        entries = (self.table.pointer() or {"entries": {}})["entries"]
        seen = self.may_hold(found, entries, touched)
        fresh = found.join(self.table.read(self.SCHEMA, only=seen).select(*self.KEYS), list(self.KEYS), "left_anti") if seen else found
        full = {b: entries[b] for b in touched if len(entries.get(b, [])) >= self.runs}
        if full:  # their folders go into this epoch's
            fresh = fresh.unionByName(self.table.read(self.SCHEMA, only=full).withColumn("bucket", self.table.bucket(*self.KEYS)))
        written = self.table.write(fresh, epoch)
        if written:
            rows = self.table.read(self.SCHEMA, only={b: [epoch] for b in written})
            blooms.build(rows.select(self.table.bucket(*self.KEYS).alias("bucket"), blooms.hashed(*self.KEYS).alias("h")), epoch).write.mode(
                "overwrite").parquet(self._filters(epoch))
        self.table.commit(epoch, entries | {b: ([] if b in full else entries.get(b, [])) + [epoch] for b in written})
        found.unpersist()


# --- T9 --------------------------------------------------------------------------------------------
def active_gauge(changes: DataFrame, limit: int = V.MAX_ACTIVE_AUDITS) -> DataFrame:
    """Active audits per organization from +1/-1 status changes, flagged at the limit (complete or update mode)."""
    return changes.groupBy("org_id").agg(F.sum("delta").alias("active")).withColumn("full", F.col("active") >= limit)
