"""Triage decisions: validity, expiry, carry-over and the risk register."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions.core import severity_rank
from . import AUDIT, REPO
from .history import latest_audits


def dismissed() -> Column:
    return F.col("triage_status").isin(*V.TRIAGE_DISMISSED)


def check_decisions(decisions: DataFrame, today: str, max_days: int = V.TRIAGE_MAX_DAYS) -> DataFrame:
    """Add ``error`` (null when the decision stands); open and fixed clear any earlier justification.

    Columns: status, reason, owner, expires_on.
    """
    day = F.lit(today).cast("date")
    reason, owner = F.substring(F.trim(F.coalesce("reason", F.lit(""))), 1, 4000), \
        F.substring(F.trim(F.coalesce("owner", F.lit(""))), 1, 200)
    accepted, closing = F.col("status") == "accepted_risk", F.col("status").isin(*V.TRIAGE_DISMISSED)
    in_window = F.col("expires_on").between(F.date_add(day, 1), F.date_add(day, max_days))
    error = (
        F.when(~F.col("status").isin(*V.TRIAGE_STATUSES), "unknown status")
        .when(closing & (F.length(reason) < V.TRIAGE_MIN_REASON), "reason too short")
        .when(accepted & (owner == ""), "owner missing")
        .when(accepted & F.col("expires_on").isNull(), "review date missing")
        .when(closing & F.col("expires_on").isNotNull() & ~in_window, "review date out of range"))
    return decisions.withColumns({
        "error": error, "reason": F.when(closing, reason).otherwise(""),
        "owner": F.when(closing, owner).otherwise(""), "expires_on": F.when(closing, F.col("expires_on"))})


def split_decisions(decisions: DataFrame, today: str) -> tuple[DataFrame, DataFrame]:
    """Accepted decisions and the side table of rejected ones."""
    checked = check_decisions(decisions, today)
    return checked.filter(F.col("error").isNull()).drop("error"), checked.filter(F.col("error").isNotNull())


def reopen_expired(findings: DataFrame, today: str) -> DataFrame:
    """Reopen dismissed findings whose review date has come. Reason, owner and date stay, marked ``lapsed``."""
    due = dismissed() & F.col("triage_expires_on").isNotNull() & (
        F.col("triage_expires_on") <= F.lit(today).cast("date"))
    return findings.withColumn("triage_status", F.when(due, "open").otherwise(F.col("triage_status"))).withColumn(
        "lapsed", (F.col("triage_status") == "open") & F.col("triage_expires_on").isNotNull())


def carry_forward(findings: DataFrame, audits: DataFrame, today: str) -> DataFrame:
    """Give each audit the still valid dismissals of its baseline; everything else starts open."""
    fields = [c for c in ("triage_status", "triage_owner", "triage_expires_on", "triage_reason") if c in
              findings.columns]
    valid = dismissed() & (F.col("triage_expires_on").isNull()
                           | (F.col("triage_expires_on") > F.lit(today).cast("date")))
    decided = findings.filter(valid).groupBy(*AUDIT, "fingerprint").agg(
        F.min(F.struct(*fields)).alias("_t")).select(
        *REPO, F.col("audit_id").alias("previous_audit_id"), "fingerprint", "_t")
    runs = audits.select(*AUDIT, "previous_audit_id")
    rows = findings.drop(*fields).join(runs, AUDIT).join(
        decided, [*REPO, "previous_audit_id", "fingerprint"], "left")
    rows = rows.withColumns({name: F.col(f"_t.{name}") for name in fields})
    return rows.withColumn("triage_status", F.coalesce("triage_status", F.lit("open"))).drop(
        "_t", "previous_audit_id")


def risk_register(findings: DataFrame, audits: DataFrame) -> DataFrame:
    """Dismissed findings of each repository's newest succeeded branch audit. On equal times one audit is taken."""
    latest = latest_audits(audits).select(*AUDIT)
    return findings.filter(dismissed()).join(latest, AUDIT, "left_semi")


def register_order() -> list[Column]:
    """Soonest review first, undated last, then severity."""
    return [F.col("triage_expires_on").asc_nulls_last(), severity_rank().desc()]
