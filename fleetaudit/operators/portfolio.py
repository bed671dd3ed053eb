"""Portfolio rows and summaries: every repository's newest state, worst first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import core as C
from . import AUDIT, REPO
from .history import latest_audits, ranked_audits, score_history


def _scored_in(findings: DataFrame, latest: DataFrame) -> DataFrame:
    """Open or accepted scored findings of the newest audits; every portfolio aggregate reads only these."""
    return findings.filter(C.is_scored() & F.col("triage_status").isin("open", "accepted_risk")).join(
        latest.select(*AUDIT), AUDIT, "left_semi")


def triage_counts(findings: DataFrame) -> DataFrame:
    def count(status: str, severity: str) -> Column:
        hit = (F.col("triage_status") == status) & (F.col("severity") == severity)
        return F.count(F.when(hit, 1))

    return findings.groupBy(*AUDIT).agg(
        *[count("open", s).alias(f"open_{s}") for s in V.SEVERITIES],
        *[count("accepted_risk", s).alias(f"accepted_{s}") for s in V.SEVERITIES])


def accepted_owners(findings: DataFrame) -> DataFrame:
    """Owners of accepted risks in review order and the soonest review date. Owners collapse before collecting."""
    accepted = findings.filter(F.col("triage_status") == "accepted_risk")
    undated = F.lit("9999-12-31").cast("date")
    owners = accepted.groupBy(*AUDIT, "triage_owner").agg(F.min("triage_expires_on").alias("review"))
    return owners.groupBy(*AUDIT).agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("triage_owner") != "", F.struct(
            F.coalesce("review", undated).alias("at"), F.col("triage_owner").alias("owner"))))),
            lambda x: x["owner"]).alias("accepted_owners"),
        F.min("review").alias("accepted_review"))


def flagged_titles(findings: DataFrame) -> DataFrame:
    """Critical and high titles per audit; open wins over accepted."""
    return findings.filter(F.col("severity").isin("critical", "high")).groupBy(*AUDIT, "title").agg(
        F.max(F.col("triage_status") == "open").alias("open"))


def worst_per_category(findings: DataFrame) -> DataFrame:
    """The group that best explains a category: severe, open, confirmed and certain first."""
    group = ["category", "severity", "kind", "confidence", "triage_status"]
    groups = findings.filter(F.col("severity").isin("critical", "high", "medium")).groupBy(*AUDIT, *group).agg(
        F.min("title").alias("title"), F.count(F.lit(1)).alias("total"))
    key = F.struct(-C.severity_rank(), F.col("triage_status") != "open", F.col("kind") != "confirmed",
                   F.col("confidence") != "high", F.col("kind"), F.col("confidence"))
    label = F.when(F.col("kind") == "confirmed", F.lit("confirmed")).otherwise(F.translate("kind", "_", " "))
    more = F.when(F.col("total") > 1, F.concat(F.lit(", "), (F.col("total") - 1).cast("string"),
                                               F.lit(" more like it"))).otherwise("")
    accepted = F.when(F.col("triage_status") == "accepted_risk", ", accepted risk").otherwise("")
    return groups.withColumn("detail", F.concat(label, F.lit(" "), "severity", F.lit(" finding"), more, accepted)) \
        .groupBy(*AUDIT, "category").agg(F.min_by(F.struct("title", "detail"), key).alias("_w")) \
        .select(*AUDIT, "category", "_w.title", "_w.detail")


def risk_reason(scores: DataFrame, latest: DataFrame, worst: DataFrame) -> DataFrame:
    """The category that sets a repository's risk and the finding behind it."""
    level = C.risk_level(F.col("risk"))
    critical = F.col("category").isin(*V.CRITICAL_CATEGORIES)
    order = C.lookup(F.col("category"), {c: i for i, c in enumerate(V.CATEGORIES)}, "int")
    key = F.struct(-F.when(critical, level).otherwise(level - 1), ~critical, F.coalesce("score", F.lit(0)), order)
    best = scores.filter("assessed").groupBy(*AUDIT).agg(
        F.min_by(F.struct("category", "score", "ceiling_reason"), key).alias("_b")).select(*AUDIT, "_b.*")
    risky = latest.filter(F.col("risk_level").isin("Moderate", "High", "Critical")).select(*AUDIT)
    rows = best.join(risky, AUDIT, "left_semi").join(worst, [*AUDIT, "category"], "left")
    reason = F.col("ceiling_reason")
    capped = reason.contains(": ")
    return rows.select(
        *AUDIT, F.col("category").alias("reason_category"),
        F.when(capped, F.regexp_extract(reason, r"(?s)^.*?: (.*)$", 1)).otherwise(
            F.coalesce("title", F.lit(""))).alias("reason_finding"),
        F.when(capped, F.regexp_replace(F.regexp_extract(reason, r"(?s)^(.*?): ", 1), r"^.*? by ", ""))
        .when(F.col("title").isNotNull(), F.col("detail"))
        .otherwise(F.concat(F.lit("scored "), F.bround(F.col("score"), 0).cast("int").cast("string")))
        .alias("reason_detail"))


def coverage(scores: DataFrame) -> DataFrame:
    low = F.col("assessed") & (F.col("risk") == "Low")
    return scores.groupBy(*AUDIT).agg(
        F.count(F.when(F.col("assessed"), 1)).alias("assessed"), F.count(F.lit(1)).alias("cells"),
        F.min(low).alias("flat"))


def portfolio(repositories: DataFrame, audits: DataFrame, findings: DataFrame, scores: DataFrame,
              now: str) -> DataFrame:
    """One row per repository with its newest audit, newer unfinished attempt, counts, reason and state flags.

    Audits need ``overall_score`` and ``risk_level``; ``scores`` are category scores of the newest audits.
    """
    moment = F.lit(now).cast("timestamp")
    latest = latest_audits(audits)
    rows = repositories.select(*REPO, "name").join(
        latest.select(*AUDIT, "overall_score", "risk_level", "created_at",
                      F.coalesce("finished_at", "created_at").alias("checked_at")), REPO, "left")
    newest = ranked_audits(audits, succeeded=False, limit=1).select(
        *REPO, F.col("status").alias("attempt_status"), F.col("created_at").alias("_attempt_at"))
    rows = rows.join(newest, REPO, "left")
    pending = (F.col("attempt_status") != "succeeded") & (
        F.col("created_at").isNull() | (F.col("_attempt_at") > F.col("created_at")))
    history = score_history(audits).select(*REPO, "history")
    relevant = _scored_in(findings, latest)
    rows = rows.withColumn("attempt_status", F.when(pending, F.col("attempt_status"))).join(history, REPO, "left")
    for part in (triage_counts(relevant), accepted_owners(relevant), coverage(scores),
                 risk_reason(scores, latest, worst_per_category(relevant))):
        rows = rows.join(part, AUDIT, "left")
    rows = rows.na.fill(0, [f"{p}_{s}" for p in ("open", "accepted") for s in V.SEVERITIES] + ["assessed", "cells"])
    risk = F.coalesce("risk_level", F.lit(V.NOT_ASSESSED))
    before = F.when(F.size("history") >= 2, F.coalesce(
        F.get("history", F.size("history") - 2)["risk_level"], F.lit(V.NOT_ASSESSED)))
    rows = rows.withColumns({
        "risk": risk,
        "previous_risk": F.when(before != risk, before).otherwise(""),
        "average_risk": F.when(F.col("overall_score").isNull(), "").otherwise(C.risk_label(F.col("overall_score"))),
        "age_days": C.whole_days(moment, F.col("checked_at")),
    })
    due_by = F.date_add(F.to_date(moment), V.ACCEPTED_DUE_DAYS)
    rows = rows.withColumns({
        "failed": F.coalesce(F.col("attempt_status") == "failed", F.lit(False)),
        "running": F.coalesce(F.col("attempt_status").isin(*V.ACTIVE_STATUSES), F.lit(False)),
        "stale": F.coalesce(F.col("age_days") > V.STALE_AFTER_DAYS, F.lit(False)),
        "partial": F.col("audit_id").isNotNull() & (F.col("assessed") > 0) & (F.col("assessed") < F.col("cells")),
        "due": F.coalesce(F.col("accepted_review") <= due_by, F.lit(False)),
        "escalated": (F.col("average_risk") != "") & (F.col("average_risk") != F.col("risk")),
        "flat": F.coalesce("flat", F.lit(False)),
    })
    return rows.withColumn(
        "settled", (F.col("risk") == "Low") & (F.col("cells") > 0) & (F.col("assessed") == F.col("cells"))
        & F.col("attempt_status").isNull() & ~F.col("stale") & ~F.col("due")).drop("created_at", "_attempt_at",
                                                                                   "risk_level")


def portfolio_order() -> list[Column]:
    """Worst first; never-checked sorts above Low."""
    return [C.portfolio_rank("risk"), F.col("open_critical").desc(), F.col("open_high").desc(),
            F.coalesce(F.col("overall_score").cast("double"), F.lit(101.0)), F.lower("name")]


def summary(rows: DataFrame) -> DataFrame:
    """Totals per organization."""
    names = {"Critical": "critical", "High": "high", "Moderate": "moderate", V.NOT_ASSESSED: "not_assessed", "Low": "low"}
    accepted = sum((F.col(f"accepted_{s}") for s in V.SEVERITIES[1:]), F.col("accepted_critical"))
    return rows.groupBy("org_id").agg(
        F.count(F.lit(1)).alias("total"), F.max("checked_at").alias("latest_check"),
        *[F.count(F.when(F.col("risk") == risk, 1)).alias(f"risk_{name}") for risk, name in names.items()],
        *[F.count(F.when(F.col(state), 1)).alias(state) for state in ("failed", "running", "stale", "partial", "due")],
        F.sum(accepted).alias("accepted"))


def repeated_titles(findings: DataFrame, audits: DataFrame) -> DataFrame:
    """The same critical or high title in more than one repository's newest audit."""
    flagged = flagged_titles(_scored_in(findings, latest_audits(audits)))
    return flagged.groupBy("org_id", "title").agg(
        F.countDistinct("repo_id").alias("repositories"),
        F.count(F.when(F.col("open"), 1)).alias("open_in")).filter("repositories > 1")


def coverage_gaps(scores: DataFrame) -> DataFrame:
    """Categories missing in at least two and at least half of an organization's assessed repositories.

    ``scores`` holds the category scores of each repository's newest audit.
    """
    return scores.groupBy("org_id", "category").agg(
        F.count(F.when(~F.col("assessed"), 1)).alias("missing"), F.count(F.lit(1)).alias("of")).filter(
        (F.col("missing") >= 2) & (F.col("missing") * 2 >= F.col("of")))
