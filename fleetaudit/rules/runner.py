"""Runs packs side by side, each on its own: a pack that breaks or takes too long is reported and costs the others nothing.

A pack is a set of Spark jobs under a job tag of its own, started from its own thread. Its findings are written below a
folder and count only once that write has committed, so what a broken pack had found so far never shows. When its time is
over, the jobs with its tag are cancelled; what other packs run goes on."""

from __future__ import annotations

import threading
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import redact
from ..operators import AUDIT
from .engine import Pack, applicability, union

LIMIT_SECONDS = 300.0
REASON_CHARS = 300


class AnalyzerError(Exception):
    """Raised by a pack that knows why it cannot run; the message is shown, redacted."""


@dataclass(frozen=True)
class Outcome:
    """How the run of one pack ended: ok, failed or timeout."""

    name: str
    status: str
    reason: str
    seconds: float
    folder: str = ""
    schema: StructType | None = None


def _cancel_when_late(sc, tag: str, done: threading.Event, late: threading.Event, seconds: float) -> None:
    """Waits for ``done``; after ``seconds`` cancels the jobs with ``tag``, those the pack starts later too."""
    if done.wait(seconds):
        return
    late.set()
    while not done.wait(0.5):
        sc.cancelJobsWithTag(tag)


def run_pack(pack: Pack, tables: dict[str, DataFrame], folder: str, seconds: float = LIMIT_SECONDS) -> Outcome:
    """Run one pack to its end and write its findings below ``folder``. Never raises for what the pack does."""
    sc = next(iter(tables.values())).sparkSession.sparkContext
    tag, path = f"pack-{pack.name}-{uuid.uuid4().hex}".replace(",", " "), f"{folder}/{pack.name}"
    limit = pack.seconds or seconds
    done, late, start = threading.Event(), threading.Event(), time.monotonic()
    watch = threading.Thread(target=_cancel_when_late, args=(sc, tag, done, late, limit), daemon=True)
    status, reason, schema = "ok", "", None
    sc.addJobTag(tag)
    watch.start()
    try:
        found = pack.run(tables)
        schema = found.schema
        found.write.mode("overwrite").parquet(path)
        if late.is_set() and time.monotonic() - start > limit:
            status = "timeout"
    except AnalyzerError as exc:
        status, reason = "failed", str(exc)
    except Exception as exc:  # noqa: BLE001 - one broken pack must not fail the others
        status, reason = "failed", f"internal analyzer error ({type(exc).__name__})"
        if late.is_set():
            status = "timeout"
    finally:
        done.set()
        watch.join()
        sc.removeJobTag(tag)
    if status == "timeout":
        reason = f"took more than {limit:g} seconds"
    return Outcome(pack.name, status, reason, time.monotonic() - start, path if status == "ok" else "", schema)


def run_packs(tables: dict[str, DataFrame], selected: list[Pack], folder: str, seconds: float = LIMIT_SECONDS,
              parallel: int = 4) -> tuple[DataFrame | None, list[Outcome]]:
    """The findings of all packs that ended well (None without any), and every pack's outcome, in the order selected.

    ``parallel`` packs run at a time, each for at most its own or ``seconds`` seconds. ``tables`` that several packs read
    should be written tables."""
    spark = next(iter(tables.values())).sparkSession
    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        runs = [pool.submit(inheritable_thread_target(spark)(run_pack), pack, tables, folder, seconds) for pack in selected]
        outcomes = [run.result() for run in runs]
    parts = [spark.read.schema(o.schema).parquet(o.folder) for o in outcomes if o.status == "ok"]
    return (union(parts) if parts else None), outcomes


def outcome_rows(audits: DataFrame, language_stats: DataFrame, selected: list[Pack], outcomes: list[Outcome]) -> DataFrame:
    """Per audit and pack: name, status, reason, categories. Skipped where none of the pack's languages occurs, else how
    its run ended."""
    spark = audits.sparkSession
    rows = spark.createDataFrame([(o.name, o.status, o.reason) for o in outcomes], "name string, _status string, _reason string")
    shown = F.substring(redact(F.col("_reason")), 1, REASON_CHARS)
    ran = F.col("status") == "ok"
    return applicability(audits, language_stats, selected).join(F.broadcast(rows), "name").select(
        *AUDIT, "name", F.when(ran, F.col("_status")).otherwise(F.col("status")).alias("status"),
        F.when(ran, shown).otherwise(F.col("reason")).alias("reason"), "categories")
