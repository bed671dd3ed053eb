"""Audit history: ranking, baselines, lifecycle, comparison and risk revisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions.core import portfolio_rank, severity_rank
from ..session import cut_lineage
from . import AUDIT, REPO
from .findings import top_k


def newest() -> list[Column]:
    """Newest first; equal times break on the id so the order is total."""
    return [F.col("created_at").desc(), F.col("audit_id").desc()]


def branch_audits(audits: DataFrame) -> DataFrame:
    """Succeeded audits that describe a branch: pull requests never do."""
    return audits.filter((F.col("status") == "succeeded") & F.col("pr_number").isNull())


def ranked_audits(audits: DataFrame, *, succeeded: bool, limit: int) -> DataFrame:
    rows = audits.filter(F.col("pr_number").isNull())
    if succeeded:
        rows = rows.filter(F.col("status") == "succeeded")
    return top_k(rows, REPO, newest(), limit)


def latest_audits(audits: DataFrame) -> DataFrame:
    """The newest succeeded branch audit per repository, as one mergeable aggregate."""
    fields = [c for c in audits.columns if c not in REPO]
    picked = branch_audits(audits).groupBy(*REPO).agg(
        F.max_by(F.struct(*fields), F.struct("created_at", "audit_id")).alias("_a"))
    return picked.select(*REPO, "_a.*")


def _previous(audits: DataFrame, keys: list[str], name: str, bucket: Column) -> DataFrame:
    """The newest candidate at or before each audit, other than itself.

    A repository may own a third of all audits, so no window spans a whole repository: audits are ordered within
    (key, day), and one row per day carries the last candidate of all earlier days forward.
    """
    candidate = (F.col("status") == "succeeded") & F.col("pr_number").isNull()
    at = F.when(candidate, F.struct("created_at", "audit_id"))
    rows = audits.withColumns({"_day": bucket, "_at": at})
    days = rows.filter(F.col("_at").isNotNull()).groupBy(*keys, "_day").agg(F.max("_at").alias("_last"))
    marks = rows.select(*keys, "_day").distinct().join(days, [*keys, "_day"], "left")
    carry = marks.withColumn("_carry", F.max("_last").over(
        Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1))).drop("_last")
    in_day = Window.partitionBy(*keys, "_day")
    peers = F.max("_at").over(in_day.orderBy("created_at").rangeBetween(Window.unboundedPreceding, 0))
    before = F.max("_at").over(
        in_day.orderBy("created_at", "audit_id").rowsBetween(Window.unboundedPreceding, -1))
    near = F.when(F.col("_peers.audit_id") != F.col("audit_id"), F.col("_peers")).otherwise(F.col("_before"))
    return rows.withColumns({"_peers": peers, "_before": before}).join(carry, [*keys, "_day"], "left").withColumn(
        name, F.coalesce(near, F.col("_carry"))["audit_id"]).drop("_day", "_at", "_peers", "_before", "_carry")


def with_baseline(audits: DataFrame) -> DataFrame:
    """Add ``previous_audit_id``: the newest earlier succeeded branch audit, same branch preferred."""
    day = F.to_date("created_at")
    same = _previous(audits, [*REPO, "branch"], "_same", day)
    both = _previous(same, REPO, "_any", day)
    return both.withColumn("previous_audit_id", F.coalesce("_same", "_any")).drop("_same", "_any")


def first_seen(findings: DataFrame, audits: DataFrame) -> DataFrame:
    """Per (repository, fingerprint): the first time a succeeded branch audit reported it, and by which audits."""
    return _first_seen(findings.select(*AUDIT, "fingerprint").join(branch_audits(audits).select(*AUDIT, "created_at"), AUDIT))


def _first_seen(seen: DataFrame) -> DataFrame:
    """The same of (audit, fingerprint, created_at). Rows are dealt once, as the join with them deals its other side."""
    return seen.select(*AUDIT, "fingerprint", "created_at").repartition(*REPO, "fingerprint").groupBy(
        *REPO, "fingerprint", "created_at").agg(
        F.min("audit_id").alias("lo"), F.max("audit_id").alias("hi")).groupBy(*REPO, "fingerprint").agg(
        F.min(F.struct("created_at", "lo", "hi")).alias("seen")).select(
        *REPO, "fingerprint", F.col("seen.created_at").alias("first_seen_at"),
        F.col("seen.lo").alias("first_lo"), F.col("seen.hi").alias("first_hi"))


def classify(findings: DataFrame, audits: DataFrame) -> DataFrame:
    """Add ``lifecycle``: existing (in the baseline), recurring (in an earlier audit), else new.

    ``audits`` carries ``previous_audit_id``. Every column of ``findings`` is written and moved, so a caller passes those it
    wants. Findings meet their audits once, where they lie; what can be asked for (branch audits, baselines) and the
    findings themselves are then dealt by repository and fingerprint.
    """
    good = (F.col("status") == "succeeded") & F.col("pr_number").isNull()
    runs = audits.select(*AUDIT, "created_at", "previous_audit_id", F.coalesce(good, F.lit(False)).alias("_good"), F.lit(True).alias("_run"))
    asked = audits.filter(F.col("previous_audit_id").isNotNull()).select(
        *REPO, F.col("previous_audit_id").alias("audit_id")).distinct().withColumn("_asked", F.lit(True))
    rows = cut_lineage(findings.drop("lifecycle").join(runs, AUDIT, "left").join(asked, AUDIT, "left")
                       .filter(F.col("_run") | F.col("_asked")))
    base = rows.filter("_asked").select(*REPO, F.col("audit_id").alias("previous_audit_id"), "fingerprint").repartition(
        *REPO, "fingerprint").distinct().withColumn("_in_base", F.lit(True))
    found = rows.filter("_run").drop("_run", "_asked", "_good").join(
        _first_seen(rows.filter("_good")).hint("merge"), [*REPO, "fingerprint"], "left").join(
        base.hint("merge"), [*REPO, "previous_audit_id", "fingerprint"], "left")
    other = (F.col("first_lo") != F.col("audit_id")) | (F.col("first_hi") != F.col("audit_id"))
    earlier = (F.col("first_seen_at") < F.col("created_at")) | (
        (F.col("first_seen_at") == F.col("created_at")) & other)
    return found.withColumn("lifecycle", F.when(F.col("_in_base"), "existing").when(earlier, "recurring")
                            .otherwise("new")).drop("created_at", "previous_audit_id", "_in_base", "first_seen_at",
                                                    "first_lo", "first_hi")


def resolved(findings: DataFrame, audits: DataFrame) -> DataFrame:
    """Baseline findings an audit no longer reports, with those of their fields that ``findings`` has."""
    fields = [c for c in ("rule_id", "title", "severity", "category", "file_path") if c in findings.columns]
    runs = audits.filter(F.col("previous_audit_id").isNotNull()).select(
        *REPO, "audit_id", "previous_audit_id")
    base = findings.groupBy(*AUDIT, "fingerprint").agg(F.min(F.struct(F.lit(0).alias("_at"), *fields)).alias("_f")).select(
        *REPO, F.col("audit_id").alias("previous_audit_id"), "fingerprint", *[f"_f.{c}" for c in fields])
    current = findings.select(*AUDIT, "fingerprint").distinct()
    return runs.join(base, [*REPO, "previous_audit_id"]).join(current, [*AUDIT, "fingerprint"], "left_anti")


def lifecycle_counts(classified: DataFrame, gone: DataFrame) -> DataFrame:
    counts = classified.groupBy(*AUDIT).agg(*[
        F.count(F.when(F.col("lifecycle") == name, 1)).alias(name) for name in ("new", "existing", "recurring")])
    lost = gone.groupBy(*AUDIT).agg(F.count(F.lit(1)).alias("resolved"))
    return counts.join(lost, AUDIT, "full_outer").na.fill(0)


def compare_audits(findings: DataFrame, pairs: DataFrame) -> DataFrame:
    """Fingerprints of two audits of one repository: introduced, persisting or fixed.

    ``pairs`` has (org_id, repo_id, base_id, head_id); findings of other repositories can never meet.
    """
    prints = findings.select(*AUDIT, "fingerprint").distinct()
    pair = [*REPO, "base_id", "head_id", "fingerprint"]
    base = pairs.join(prints.withColumnRenamed("audit_id", "base_id"), [*REPO, "base_id"]).select(
        *pair).withColumn("_b", F.lit(True))
    head = pairs.join(prints.withColumnRenamed("audit_id", "head_id"), [*REPO, "head_id"]).select(
        *pair).withColumn("_h", F.lit(True))
    return base.join(head, pair, "full_outer").withColumn(
        "change", F.when(F.col("_b").isNull(), "introduced").when(F.col("_h").isNull(), "fixed")
        .otherwise("persisting")).drop("_b", "_h")


def category_deltas(scores: DataFrame, pairs: DataFrame) -> DataFrame:
    """Category scores of the base next to the head's."""
    side = scores.select(*AUDIT, "category", "score")
    head = pairs.join(side.withColumnRenamed("audit_id", "head_id"), [*REPO, "head_id"]).withColumnRenamed(
        "score", "head_score")
    return head.join(side.withColumnRenamed("audit_id", "base_id").withColumnRenamed("score", "base_score"),
                     [*REPO, "base_id", "category"], "left")


def fingerprint_history(findings: DataFrame, audits: DataFrame, limit: int = 20) -> DataFrame:
    """The newest audits in which a repository reported each fingerprint."""
    rows = findings.select(*AUDIT, "fingerprint", "severity").join(audits.select(*AUDIT, "created_at"), AUDIT)
    once = rows.groupBy(*AUDIT, "fingerprint", "created_at").agg(
        F.max(F.struct(severity_rank(), "severity"))["severity"].alias("severity"))
    return top_k(once, [*REPO, "fingerprint"], newest(), limit)


def score_history(audits: DataFrame, limit: int = V.HISTORY_LENGTH) -> DataFrame:
    """The last scores per repository, oldest first, in one bounded array."""
    return ranked_audits(audits, succeeded=True, limit=limit).groupBy(*REPO).agg(
        F.array_sort(F.collect_list(F.struct("created_at", "audit_id", "overall_score", "risk_level")))
        .alias("history"))


def risk_changes(audits: DataFrame, limit: int = V.HISTORY_LENGTH) -> DataFrame:
    """Risk label changes between consecutive audits of the shown history (at most ``limit`` rows per repository)."""
    w = Window.partitionBy(*REPO).orderBy("created_at", "audit_id")
    now = F.coalesce("risk_level", F.lit(V.NOT_ASSESSED))
    rows = ranked_audits(audits, succeeded=True, limit=limit).withColumn("now", now).withColumn(
        "was", F.lag("now").over(w))
    return rows.filter(F.col("was").isNotNull() & (F.col("was") != F.col("now"))).withColumns({
        "worse": portfolio_rank("now") < portfolio_rank("was"),
        "changed_at": F.coalesce("finished_at", "created_at")})


def revision_label(index: Column) -> Column:
    """A..Z, AA, AB … for a zero-based index below 702 (two letters)."""
    def letter(i: Column) -> Column:
        return F.char(F.lit(65) + i)

    return F.when(index < 26, letter(index)).otherwise(
        F.concat(letter(F.floor(index / 26) - 1), letter(index % 26)))


def revisions(audits: DataFrame, limit: int = V.REVISION_LIMIT) -> DataFrame:
    """The newest label changes per organization, lettered from the oldest one shown."""
    order = [F.col("changed_at").desc(), F.col("repo_id"), F.col("audit_id").desc()]
    shown = top_k(risk_changes(audits).drop("rank"), ["org_id"], order, limit)
    total = F.count(F.lit(1)).over(Window.partitionBy("org_id"))
    return shown.withColumn("rev", revision_label((total - F.col("rank")).cast("int")))


def activity_tail(events: DataFrame, keys: list[str], limit: int = V.ACTIVITY_RING) -> DataFrame:
    """The last progress events per audit, as a ring keeps them."""
    return top_k(events, keys, [F.col("seq").desc()], limit)
