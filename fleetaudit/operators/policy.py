"""Policies and gates.

A policy is one row per repository whose list columns hold at most a few hundred entries, so matching is an equi-join
on the repository followed by array functions: no finding is ever paired with rules of another repository.

``policies``: org_id, repo_id, fail_on, max_findings, max_change_risk, require_analyzers array<string>,
path_gates array<struct<pattern, fail_on>>, disable_rules array<string>,
severity_overrides array<struct<pattern, severity>>, disable_analyzers array<string>, exclude_paths array<string>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import at_or_above, change_exceeds, is_scored
from ..functions.text import glob_regex, rule_matches
from . import AUDIT, REPO

LISTS = ["require_analyzers", "disable_rules", "disable_analyzers", "exclude_paths"]


def layered(layers: DataFrame) -> DataFrame:
    """Effective policy per repository from its layers (``layer`` ascending, lowest precedence first).

    Scalars: the last layer that sets one. Lists: ordered union. Path gates: the top layer is matched first.
    Overrides: the top layer's entry for a pattern hides lower ones.
    """
    def last(name: str, default) -> Column:
        value = F.max_by(name, F.when(F.col(name).isNotNull(), F.col("layer")))
        return F.coalesce(value, F.lit(default)).alias(name)

    def pieces(name: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col(name).isNotNull(), F.struct("layer", name))))

    def top_first(name: str) -> Column:
        return F.flatten(F.reverse(pieces(name))[name]).alias(name)

    return layers.groupBy(*REPO).agg(
        last("fail_on", "high"), last("max_findings", None), last("max_change_risk", "never"),
        *[F.array_distinct(F.flatten(pieces(n)[n])).alias(n) for n in LISTS],
        top_first("path_gates"), top_first("severity_overrides"))


def compiled(policies: DataFrame) -> DataFrame:
    """Turn globs into regexes once per policy row."""
    return policies.withColumns({
        "path_gates": F.transform("path_gates", lambda g: F.struct(
            g["fail_on"].alias("fail_on"), glob_regex(g["pattern"]).alias("regex"))),
        "exclude_paths": F.transform("exclude_paths", glob_regex)})


def threshold_for(path: str = "file_path") -> Column:
    """The first path gate that matches, else the default."""
    hit = F.filter("path_gates", lambda g: (F.col(path) != "") & F.rlike(F.col(path), g["regex"]))
    return F.coalesce(F.get(hit, F.lit(0))["fail_on"], F.col("fail_on"))


def severity_override(rule: str = "rule_id") -> Column:
    """Exact entry first, else the longest matching prefix."""
    exact = F.filter("severity_overrides", lambda o: o["pattern"] == F.col(rule))
    prefix = F.filter("severity_overrides", lambda o: o["pattern"].endswith("*")
                      & rule_matches(o["pattern"], F.col(rule)))
    best = F.aggregate(
        prefix, F.struct(F.lit(-1).alias("n"), F.lit(None).cast("string").alias("s")),
        lambda acc, o: F.when(F.length(o["pattern"]) > acc["n"],
                              F.struct(F.length(o["pattern"]).alias("n"), o["severity"].alias("s"))).otherwise(acc))
    return F.coalesce(F.get(exact, F.lit(0))["severity"], best["s"])


def effects(findings: DataFrame, policies: DataFrame) -> DataFrame:
    """Mark every finding: ``effect`` is excluded, disabled, overridden or null; severity is the effective one."""
    rows = findings.join(compiled(policies).select(
        *REPO, "exclude_paths", "disable_rules", "severity_overrides"), REPO, "left")
    excluded = (F.col("file_path") != "") & F.exists("exclude_paths", lambda p: F.rlike(F.col("file_path"), p))
    disabled = F.exists("disable_rules", lambda p: rule_matches(p, F.col("rule_id")))
    rows = rows.withColumn("_to", severity_override())
    changed = F.col("_to").isNotNull() & (F.col("_to") != F.col("severity"))
    effect = F.when(excluded, "excluded").when(disabled, "disabled").when(changed, "overridden")
    note = F.concat(F.col("evidence"), F.lit("\n[policy: severity "), F.col("severity"), F.lit(" → "),
                    F.col("_to"), F.lit("]"))
    rows = rows.withColumn("effect", effect)
    over = F.col("effect") == "overridden"
    return rows.withColumns({
        "evidence": F.when(over, F.regexp_replace(note, r"^\s+|\s+$", "")).otherwise(F.col("evidence")),
        "severity": F.when(over, F.col("_to")).otherwise(F.col("severity")),
    }).drop("exclude_paths", "disable_rules", "severity_overrides", "_to")


def apply(findings: DataFrame, policies: DataFrame) -> DataFrame:
    """Findings that survive the policy, with overridden severities."""
    kept = effects(findings, policies)
    return kept.filter(F.coalesce("effect", F.lit("")).isin("", "overridden")).drop("effect")


def effect_counts(findings: DataFrame, policies: DataFrame) -> DataFrame:
    return effects(findings, policies).groupBy(*AUDIT).agg(*[
        F.count(F.when(F.col("effect") == name, 1)).alias(name) for name in ("excluded", "disabled", "overridden")])


def digest(policies: DataFrame) -> DataFrame:
    """Sixteen hex digits over the policy as JSON with sorted keys; layer names do not count."""
    def text(col: Column) -> Column:
        return F.regexp_replace(F.to_json(F.array(col)), r"^\[|\]$", "")

    def items(col: Column) -> Column:
        return F.concat(F.lit("["), F.array_join(F.transform(col, text), ", "), F.lit("]"))

    gates = F.transform("path_gates", lambda g: F.concat(
        F.lit('{"fail_on": '), text(g["fail_on"]), F.lit(', "pattern": '), text(g["pattern"]), F.lit("}")))
    first = F.array_distinct(F.transform("severity_overrides", lambda o: o["pattern"]))
    pairs = F.transform(F.array_sort(first), lambda p: F.concat(
        text(p), F.lit(": "), text(F.get(F.filter("severity_overrides", lambda o: o["pattern"] == p), F.lit(0))["severity"])))
    body = F.concat(
        F.lit('{"analyzers": {"disable": '), items(F.col("disable_analyzers")),
        F.lit('}, "gate": {"fail_on": '), text(F.col("fail_on")),
        F.lit(', "max_change_risk": '), text(F.col("max_change_risk")),
        F.lit(', "max_findings": '), F.coalesce(F.col("max_findings").cast("string"), F.lit("null")),
        F.lit(', "paths": ['), F.array_join(gates, ", "), F.lit('], "require_analyzers": '),
        items(F.col("require_analyzers")), F.lit('}, "paths": {"exclude": '), items(F.col("exclude_paths")),
        F.lit('}, "rules": {"disable": '), items(F.col("disable_rules")), F.lit(', "severity": {'),
        F.array_join(pairs, ", "), F.lit("}}}"))
    return policies.withColumn("digest", F.substring(F.sha2(body, 256), 1, 16))


def introduced(findings: DataFrame, changed: DataFrame) -> DataFrame:
    """Open scored findings a pull request brought in: new or recurring, in files it changed."""
    rows = findings.filter(is_scored() & (F.col("triage_status") == "open")
                           & F.col("lifecycle").isin("new", "recurring"))
    paths = changed.select(*AUDIT, F.col("path").alias("file_path"))
    return rows.join(paths, [*AUDIT, "file_path"], "left_semi")


def gate_candidates(findings: DataFrame, audits: DataFrame, changed: DataFrame) -> DataFrame:
    """Pull requests gate on what they introduced, branch audits on every open scored finding."""
    runs = audits.select(*AUDIT, F.col("pr_number").isNotNull().alias("_pr"))
    rows = findings.filter(is_scored() & (F.col("triage_status") == "open")).join(runs, AUDIT)
    branch = rows.filter(~F.col("_pr")).drop("_pr")
    return branch.unionByName(introduced(rows.filter("_pr").drop("_pr"), changed))


def evaluate(candidates: DataFrame, audits: DataFrame, outcomes: DataFrame, policies: DataFrame,
             change_risk: DataFrame | None = None) -> DataFrame:
    """Gate verdict per audit with its reasons. The maximum counts every candidate, not only blocking ones."""
    rows = candidates.join(compiled(policies).select(*REPO, "path_gates", "fail_on"), REPO)
    counts = rows.groupBy(*AUDIT).agg(
        F.count(F.when(at_or_above(F.col("severity"), threshold_for()), 1)).alias("blocking"),
        F.count(F.lit(1)).alias("candidates"))
    finished = outcomes.filter(F.col("status") == "ok").groupBy(*AUDIT).agg(F.collect_set("name").alias("_ok"))
    base = audits.select(*AUDIT).join(policies.select(
        *REPO, "fail_on", "max_findings", "max_change_risk", "require_analyzers"), REPO)
    base = base.join(counts, AUDIT, "left").join(finished, AUDIT, "left").na.fill(0, ["blocking", "candidates"])
    if change_risk is None:
        base = base.withColumns({"level": F.lit(None).cast("string"), "points": F.lit(None).cast("int")})
    else:
        base = base.join(change_risk.select(*AUDIT, "level", F.col("score").alias("points")), AUDIT, "left")
    missing = F.array_except("require_analyzers", F.coalesce("_ok", F.array().cast("array<string>")))
    n, total = F.col("blocking").cast("string"), F.col("candidates").cast("string")
    reasons = F.array(
        F.when(F.col("blocking") > 0, F.concat(n, F.lit(" finding(s) at or above the gate threshold"))),
        F.when(F.col("candidates") > F.col("max_findings"),
               F.concat(total, F.lit(" finding(s) exceed the maximum of "), F.col("max_findings").cast("string"))),
        F.when(F.size(missing) > 0,
               F.concat(F.lit("required analyzer(s) did not run: "), F.array_join(missing, ", "))),
        F.when(F.col("level").isNotNull() & change_exceeds(F.col("level"), F.col("max_change_risk")),
               F.concat(F.lit("change risk "), F.col("level"), F.lit(" ("), F.col("points").cast("string"),
                        F.lit(") is above the maximum "), F.col("max_change_risk"))))
    verdict = base.withColumn("reasons", F.filter(reasons, lambda r: r.isNotNull()))
    return verdict.select(*AUDIT, (F.size("reasons") == 0).alias("passed"), "blocking", "candidates", "fail_on",
                          "reasons")


def annotations(candidates: DataFrame, policies: DataFrame) -> DataFrame:
    """File-level gate notes, numbered per audit, blocking findings first."""
    from ..functions.core import severity_rank

    rows = candidates.filter(F.col("file_path") != "").join(
        compiled(policies).select(*REPO, "path_gates", "fail_on"), REPO)
    rows = rows.withColumn("blocking", at_or_above(F.col("severity"), threshold_for()))
    order = [F.col("blocking").desc(), severity_rank().desc(), F.col("file_path"), F.coalesce("line_start", F.lit(0)),
             F.col("fingerprint"), F.col("emit_idx")]
    line = F.coalesce("line_start", F.lit(1))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*AUDIT).orderBy(*order)))
    return rows.select(
        *AUDIT, "rank", F.col("file_path").alias("path"), line.alias("start_line"),
        F.greatest(line, F.coalesce("line_end", line)).alias("end_line"),
        F.when(F.col("blocking"), "failure").otherwise("warning").alias("annotation_level"),
        F.substring(F.concat(F.lit("["), F.col("severity"), F.lit("] "), F.col("title")), 1, 255).alias("title"),
        F.concat(F.substring(F.when(F.col("description") != "", F.col("description")).otherwise(F.col("title")), 1, 2000),
                 F.when(F.col("remediation") != "", F.concat(F.lit("\n\nFix: "), F.substring("remediation", 1, 1000)))
                 .otherwise("")).alias("message"))


def finding_order() -> list[Column]:
    from ..functions.core import severity_rank

    return [severity_rank().desc(), F.col("file_path"), F.coalesce("line_start", F.lit(0))]
