"""Ranks, lookups, penalties and risk labels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab as V


def lookup(col: Column, table: Mapping[str, object], sql_type: str = "string", default=None) -> Column:
    """A literal table as an expression. ``table`` is one of the fixed vocabularies, never data."""
    if len(table) > 6:  # a folded map keeps the generated method small enough for the JIT
        pairs = [F.lit(x) for item in table.items() for x in item]
        return F.coalesce(F.create_map(*pairs)[col].cast(sql_type), F.lit(default).cast(sql_type))
    out = None
    for key, value in table.items():
        literal = F.lit(value).cast(sql_type)
        out = F.when(col == key, literal) if out is None else out.when(col == key, literal)
    return out.otherwise(F.lit(default).cast(sql_type))


def severity_rank(col="severity") -> Column:
    return lookup(_c(col), V.SEVERITY_RANK, "int", -1)


def confidence_rank(col="confidence") -> Column:
    return lookup(_c(col), V.CONFIDENCE_RANK, "int", -1)


def portfolio_rank(col="risk") -> Column:
    return lookup(_c(col), V.PORTFOLIO_RANK, "int", 3)


def is_scored(kind="kind") -> Column:
    return _c(kind) != "ai_observation"


def at_or_above(severity: Column, threshold: Column) -> Column:
    return (threshold != "never") & (severity_rank(severity) >= severity_rank(threshold))


def penalty(severity="severity", confidence="confidence", kind="kind") -> Column:
    """Exact decimal penalty, so sums do not depend on the order rows arrive in."""
    return (
        lookup(_c(severity), V.SEVERITY_WEIGHT, "decimal(4,1)")
        * lookup(_c(confidence), V.CONFIDENCE_FACTOR, "decimal(3,1)")
        * lookup(_c(kind), V.KIND_FACTOR, "decimal(3,2)")
    ).cast("decimal(12,4)")


def rule_cap(severity="severity") -> Column:
    weight = lookup(_c(severity), V.SEVERITY_WEIGHT, "decimal(4,1)")
    return (weight * V.RULE_CAP_MULTIPLIER).cast("decimal(12,4)")


def strong(kind="kind", confidence="confidence") -> Column:
    return (_c(kind) == "confirmed") & (_c(confidence) == "high")


def ceiling(severity="severity", confidence="confidence", kind="kind") -> Column:
    """The score bound a finding sets on its category; null when it sets none."""
    sev, is_strong = _c(severity), strong(kind, confidence)
    out = F.lit(None).cast("int")
    for (level, needs_strong), bound in V.CEILINGS.items():
        out = F.when((sev == level) & (is_strong == F.lit(needs_strong)), F.lit(bound)).otherwise(out)
    return F.when(_c(confidence) != "low", out)


def ceiling_reason(bound: Column, severity="severity", confidence="confidence", kind="kind", title="title") -> Column:
    label = F.when(strong(kind, confidence), F.lit("confirmed")).otherwise(_c(kind))
    return F.concat(F.lit("capped at "), bound.cast("string"), F.lit(" by "), label, F.lit(" "), _c(severity),
                    F.lit(" finding: "), _c(title))


def risk_label(score: Column) -> Column:
    out = F.lit("Critical")
    for bound, label in reversed(V.RISK_STEPS):
        out = F.when(score >= bound, F.lit(label)).otherwise(out)
    return F.when(score.isNull(), F.lit(V.NOT_ASSESSED)).otherwise(out)


def risk_level(label: Column) -> Column:
    return lookup(label, {name: i for i, name in enumerate(V.RISK_LEVELS)}, "int")


def change_level(points: Column) -> Column:
    return F.when(points >= 60, "high").when(points >= 30, "medium").otherwise("low")


def change_exceeds(level: Column, maximum: Column) -> Column:
    rank = {"low": 0, "medium": 1, "high": 2}
    bound = lookup(maximum, rank, "int")
    return F.coalesce(lookup(level, rank, "int") > bound, F.lit(False))


def half_even(value: Column, digits: int) -> Column:
    """Round half to even on the exact decimal value."""
    return F.bround(value, digits)


def whole_days(later: Column, earlier: Column) -> Column:
    """Complete 24-hour periods between two instants."""
    return F.floor((F.unix_timestamp(later) - F.unix_timestamp(earlier)) / 86400).cast("int")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col
