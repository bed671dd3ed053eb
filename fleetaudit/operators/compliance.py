"""Mapping findings to controls and rolling controls up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import compliance_map as M
from ..functions.core import lookup
from ..vocab import SEVERITIES
from . import AUDIT

CWE_TEXT = r"(?i)\bCWE[-_ ]?\d{1,5}\b|cwe\.mitre\.org/data/definitions/\d{1,5}"


def matching_row(rule: Column) -> Column:
    """Index of the first mapping row that matches: exact ids by lookup, the few wildcard rows by comparison."""
    exact, wild = {}, F.lit(None).cast("int")
    for i, (pattern, *_rest) in reversed(list(enumerate(M.RULE_ROWS))):
        if "*" not in pattern:
            exact[pattern] = i
            continue
        head, _, tail = pattern.partition("*")
        hit = rule.startswith(head)
        if tail.endswith("*"):
            hit = hit & F.substr(rule, F.lit(len(head) + 1)).contains(tail[:-1])
        elif tail:
            hit = hit & rule.endswith(tail) & (F.length(rule) >= len(head) + len(tail))
        wild = F.when(hit, F.lit(i)).otherwise(wild)
    return F.least(lookup(rule, exact, "int"), wild)


def cwe_ids(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(CWE_TEXT), F.lit(0))
    return F.transform(found, lambda m: F.regexp_extract(m, r"(\d+)$", 1).cast("int"))


def _column(position: int, sql_type: str) -> Column:
    return F.array(*[F.array(*[F.lit(v) for v in row[position]]).cast(sql_type) for row in M.RULE_ROWS])


def map_findings(findings: DataFrame) -> DataFrame:
    """Add the five control arrays. Row-local: no join, no shuffle."""
    rows = findings.withColumn("_row", matching_row(F.col("rule_id")))
    text = F.concat_ws(" ", F.coalesce("description", F.lit("")), "references")

    def of_rule(position: int, sql_type: str = "array<string>") -> Column:
        return F.coalesce(F.get(_column(position, sql_type), F.col("_row")), F.array().cast(sql_type))

    def fallback(name: str) -> Column:
        table = {c: " ".join(v[name]) for c, v in M.FALLBACK_ROWS.items()}
        words = lookup(F.col("category"), table, "string", "")
        return F.filter(F.split(words, " "), lambda w: w != "")

    def or_fallback(col: Column, name: str) -> Column:
        return F.when(F.size(col) > 0, col).otherwise(fallback(name))

    owasp_of = F.create_map(*[F.lit(x) for pair in M.OWASP_OF_CWE.items() for x in pair])
    rows = rows.withColumn("_cwe", F.array_distinct(F.concat(of_rule(1, "array<int>"), cwe_ids(text))))
    rows = rows.withColumn("owasp", F.array_distinct(F.concat(
        of_rule(2), F.array_compact(F.transform("_cwe", lambda n: owasp_of[n])))))
    return rows.withColumns({
        "cwe": F.transform("_cwe", lambda n: F.concat(F.lit("CWE-"), n.cast("string"))),
        "owasp": or_fallback(F.col("owasp"), "owasp"), "asvs": of_rule(3),
        "soc2": or_fallback(of_rule(4), "soc2"), "iso27001": or_fallback(of_rule(5), "iso27001"),
    }).drop("_row", "_cwe")


def finding_controls(mapped: DataFrame) -> DataFrame:
    """One row per (finding, framework, control)."""
    def tagged(framework: str) -> Column:
        return F.transform(framework, lambda c: F.struct(F.lit(framework).alias("framework"), c.alias("control")))

    pairs = F.flatten(F.array(*[tagged(fw) for fw in M.FRAMEWORKS]))
    return mapped.withColumn("_p", F.explode(pairs)).select("*", "_p.*").drop("_p")


def summarize(mapped: DataFrame, keys: list[str] = AUDIT) -> DataFrame:
    """Findings per framework and control, by severity."""
    titles = F.create_map(*[F.lit(x) for pair in M.CONTROL_TITLES.items() for x in pair])
    return finding_controls(mapped).groupBy(*keys, "framework", "control").agg(
        F.count(F.lit(1)).alias("findings"),
        *[F.count(F.when(F.col("severity") == s, 1)).alias(s) for s in SEVERITIES]).withColumn(
        "control_title", F.coalesce(titles[F.col("control")], F.lit("")))


def control_order() -> list[Column]:
    return [F.col("findings").desc(), F.col("control")]
