"""Finding identity: validation, fingerprints, duplicate merging, ordering and search."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions.core import confidence_rank, is_scored, lookup, severity_rank
from ..functions.text import normalize_line, normalize_path, rule_family
from . import AUDIT

ORD = ["analyzer", "emit_idx"]


def emission_order() -> Column:
    """Analyzers report in name order; within one analyzer findings keep their emission index."""
    return F.struct(*ORD)


def validate(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Drop findings that point outside the audited files or carry no title; clear impossible line numbers.

    ``files`` has one row per (audit, path) with ``line_count``. Findings without a path match no file and stay.
    """
    titled = findings.filter(F.trim("title") != "").withColumn("file_path", normalize_path("file_path"))
    known = files.select(*AUDIT, F.col("path").alias("file_path"), F.col("line_count").alias("_n"))
    joined = titled.join(known.hint("shuffle_hash"), [*AUDIT, "file_path"], "left").filter(
        (F.col("file_path") == "") | F.col("_n").isNotNull())
    located = F.col("file_path") != ""
    lost = located & F.col("line_start").isNotNull() & ~F.col("line_start").between(1, F.greatest("_n", F.lit(1)))
    return joined.withColumns({
        "line_start": F.when(~lost, F.col("line_start")),
        "line_end": F.when(lost, None).when(
            located & (F.col("line_end") < F.col("line_start")), F.col("line_start")).otherwise(F.col("line_end")),
    }).drop("_n")


def attach_source_line(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """Add ``source_line``, the flagged line's text; ``lines`` has one row per (audit, path, line_no)."""
    wanted = lines.select(*AUDIT, F.col("path").alias("file_path"), F.col("line_no").alias("line_start"),
                          F.col("text").alias("source_line"))
    return findings.join(wanted, [*AUDIT, "file_path", "line_start"], "left")


IDENTITY = [*AUDIT, "_key", "file_path", "_anchor"]


def _identity(findings: DataFrame) -> DataFrame:
    """What makes two findings the same: rule family, file, flagged code (or title) and line."""
    has_line = (F.col("file_path") != "") & (F.coalesce("line_start", F.lit(0)) != 0)
    return findings.withColumns({
        "_key": F.coalesce(rule_family("rule_id"), F.col("rule_id")),
        "_anchor": normalize_line(F.when(has_line, F.coalesce("source_line", F.lit(""))).otherwise(F.col("title"))),
        "_line": F.coalesce("line_start", F.lit(0))})


def _digest(index: Column) -> Column:
    return F.sha2(F.concat_ws("|", "_key", "file_path", "_anchor", index.cast("string")), 256)


def _line_index() -> Column:
    """Rank of a line among the distinct lines that share its identity; a file's size limit bounds the window."""
    return F.dense_rank().over(Window.partitionBy(*IDENTITY).orderBy("_line")) - 1


def _known_identity() -> Column:
    return reduce(and_, [F.col(c).isNotNull() for c in (*IDENTITY, "_line")])


def fingerprint(findings: DataFrame) -> DataFrame:
    """Stable identity of every single report, unmerged. Rows without a full identity have none. The rank is a running
    count over sorted rows, so a hot rule is never held in memory."""
    keyed = _identity(findings).filter(_known_identity())
    return keyed.withColumn("_idx", _line_index()).withColumn("fingerprint", _digest(F.col("_idx"))).drop(
        "_key", "_anchor", "_line", "_idx")


def merge_duplicates(findings: DataFrame, extra_first: tuple[str, ...] = ()) -> DataFrame:
    """One fingerprinted row per problem.

    * plain fields come from the first reported row; severity is the highest;
    * confidence and kind come from the first row with the highest confidence;
    * when the first row is a pattern match, the last traced data flow replaces description, evidence, kind and
      confidence, and only rows after it may raise confidence or fill in an empty evidence;
    * sources and references are ordered unions, evidence is the first non-empty one.

    Reports share a fingerprint exactly when they share identity and line, so duplicates collapse on those columns
    first (mergeable aggregates, combined map-side, first per reference list and then per problem) and the line
    rank runs on what is left. No report list is ever collected.
    """
    key = [*IDENTITY, "_line"]
    rows = _identity(findings).withColumn("_ord", emission_order())
    taint = F.col("rule_id").startswith(V.TAINT_RULE_PREFIX)
    # in the order that the first aggregate takes its rows in
    problem = Window.partitionBy(*key).orderBy("sources", "references").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("_last_taint", F.when(_known_identity(), F.max(F.when(taint, F.col("_ord"))).over(problem)))
    after = F.col("_last_taint").isNull() | (F.col("_ord") >= F.col("_last_taint"))
    fields = ["rule_id", "title", "category", "remediation", "line_start", "line_end", "analyzer", "emit_idx",
              "description", *extra_first]
    proof = F.col("evidence") != ""
    trusted = F.struct((-confidence_rank()).alias("c"), F.col("_ord").alias("o"))

    def earliest(order: Column, *cols: str) -> Column:
        return F.min(F.when(order.isNotNull(), F.struct(order.alias("at"), *cols)))

    parts = rows.groupBy(*key, "sources", "references").agg(
        earliest(F.col("_ord"), *fields).alias("first"),
        F.max(severity_rank()).alias("severity"),
        earliest(trusted, "confidence", "kind").alias("trust"),
        earliest(F.when(after, trusted), "confidence", "kind").alias("trust_after"),
        earliest(F.when(after, F.col("_ord")), "description").alias("description_after"),
        earliest(F.when(proof, F.col("_ord")), "evidence").alias("evidence"),
        earliest(F.when(proof & after, F.col("_ord")), "evidence").alias("evidence_after"),
        F.count(F.lit(1)).alias("reports"))
    merged = parts.groupBy(*key).agg(
        *[F.min(c).alias(c) for c in ("first", "trust", "trust_after", "description_after", "evidence",
                                      "evidence_after")],
        F.max("severity").alias("severity"), F.sum("reports").alias("reports"),
        F.array_sort(F.collect_list(F.struct("first.at", "sources", "references"))).alias("_lists"))
    rank_name = {rank: name for name, rank in V.SEVERITY_RANK.items()}
    traced = ~F.col("first.rule_id").startswith(V.TAINT_RULE_PREFIX)

    def pick(after_taint: str, plain: str) -> Column:
        return F.when(traced, F.col(after_taint)).otherwise(F.col(plain))

    def union(name: str) -> Column:
        return F.array_distinct(F.flatten(F.col(f"_lists.{name}"))).alias(name)

    return merged.withColumn("_idx", _line_index()).select(
        *AUDIT, _digest(F.col("_idx")).alias("fingerprint"), "file_path",
        *[f"first.{name}" for name in fields if name != "description"],
        lookup(F.col("severity"), rank_name).alias("severity"),
        pick("trust_after.confidence", "trust.confidence").alias("confidence"),
        pick("trust_after.kind", "trust.kind").alias("kind"),
        pick("description_after.description", "first.description").alias("description"),
        F.coalesce(pick("evidence_after.evidence", "evidence.evidence"), F.lit("")).alias("evidence"),
        union("sources"), union("references"), "reports")


def severity_counts(findings: DataFrame, keys: list[str] = AUDIT) -> DataFrame:
    """Scored findings per severity, zero-filled."""
    return findings.filter(is_scored()).groupBy(*keys).agg(*[
        F.count(F.when(F.col("severity") == s, 1)).alias(s) for s in V.SEVERITIES])


def report_order() -> list[Column]:
    """Engine order: severity, category, path, line."""
    return [severity_rank().desc(), F.col("category"), F.col("file_path"), F.coalesce("line_start", F.lit(0))]


def rated_report_order(likelihood: str = "false_positive_likelihood") -> list[Column]:
    """Report order: likely false positives sink within their severity; unrated counts as medium."""
    rank = lookup(F.coalesce(F.col(likelihood), F.lit("")), {"low": 0, "": 1, "medium": 1, "high": 2}, "int", 1)
    return [severity_rank().desc(), rank, F.col("category"), F.col("file_path"), F.coalesce("line_start", F.lit(0))]


def search(findings: DataFrame, *, severity=None, category=None, kind=None, lifecycle=None, triage="open",
           text=None) -> DataFrame:
    """Equality filters plus a case-insensitive substring over title, path and rule."""
    out = findings
    if severity in V.SEVERITIES:
        out = out.filter(F.col("severity") == severity)
    for name, value in (("category", category), ("kind", kind), ("lifecycle", lifecycle)):
        if value:
            out = out.filter(F.col(name) == value)
    if triage in V.TRIAGE_STATUSES:
        out = out.filter(F.col("triage_status") == triage)
    if text:
        needle = f"%{text}%"
        out = out.filter(F.col("title").ilike(needle) | F.col("file_path").ilike(needle)
                         | F.col("rule_id").ilike(needle))
    return out


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows per key. Spark prunes each task's rows to ``k`` per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def page(findings: DataFrame, order: list[Column], number: int, keys: list[str] = AUDIT,
         size: int = V.PAGE_SIZE) -> DataFrame:
    """One page per audit under a total order."""
    return top_k(findings, keys, order, number * size).filter(F.col("rank") > (number - 1) * size)


def ai_candidates(findings: DataFrame, k: int = 15) -> DataFrame:
    """What an explanation run sees first: scored, above info, most severe and most certain."""
    chosen = findings.filter(is_scored() & (F.col("severity") != "info"))
    order = [severity_rank().desc(), confidence_rank().desc(), F.col("file_path"), F.col("fingerprint")]
    return top_k(chosen, AUDIT, order, max(1, min(k, 50)))
