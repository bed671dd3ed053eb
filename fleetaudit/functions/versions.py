"""Version, specifier and CVSS expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import _c, lookup


def version_tuple(version) -> Column:
    """Numbers of a plain release such as 1.2.3 or v2.0; null for anything else."""
    text = F.regexp_extract(F.trim(_c(version)), r"^v?(\d+(?:\.\d+)*+)$", 1)
    return F.when(text != "", F.transform(F.split(text, r"\."), lambda x: x.cast("int")))


def _pad(a: Column, n: Column) -> Column:
    return F.concat(a, F.array_repeat(F.lit(0), F.greatest(n - F.size(a), F.lit(0)).cast("int")))


def _clause(v: Column, clause: Column) -> Column:
    """T, F, or U when the clause uses syntax outside the subset."""
    shape = r"^(===|==|!=|>=|<=|~=|>|<)\s*([0-9][\w.]*(?:\.\*)?)$"
    op, target = F.regexp_extract(clause, shape, 1), F.regexp_extract(clause, shape, 2)
    star = target.endswith(".*") & op.isin("==", "!=")
    prefix = version_tuple(F.regexp_replace(target, r"\.\*$", ""))
    t = version_tuple(target)
    n = F.greatest(F.size(v), F.size(t))
    a, b = _pad(v, n), _pad(t, n)
    head = F.slice(v, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0)))
    same = F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0)))
    plain = (
        F.when(op.isin("==", "==="), a == b).when(op == "!=", a != b).when(op == ">=", a >= b)
        .when(op == "<=", a <= b).when(op == ">", a > b).when(op == "<", a < b)
        .otherwise((a >= b) & (F.size(t) >= 2) & (head == same)))
    starred = (F.slice(v, F.lit(1), F.size(prefix)) == prefix) == (op == "==")
    known = F.when(star, F.when(prefix.isNotNull(), starred)).when(t.isNotNull(), plain)
    return F.when(op == "", "U").when(known.isNull(), "U").when(known, "T").otherwise("F")


def satisfies(version, spec) -> Column:
    """Whether a version meets a specifier set; null when either side cannot be judged."""
    v = version_tuple(version)
    clauses = F.filter(F.transform(F.split(_c(spec), ","), lambda s: F.trim(s)), lambda c: c != "")
    verdicts = F.transform(clauses, lambda c: _clause(v, c))
    first = F.get(F.filter(verdicts, lambda x: x != "T"), F.lit(0))
    return F.when(v.isNotNull(), F.when(first.isNull(), True).when(first == "F", False))


def behind_major(current, latest) -> Column:
    """At least one major release behind; below 1.0 a minor release counts."""
    cur, new = version_tuple(current), version_tuple(latest)
    major = (F.get(cur, F.lit(0)) > 0) | (F.get(new, F.lit(0)) > 0)
    by_major = F.get(new, F.lit(0)) > F.get(cur, F.lit(0))
    by_minor = (F.get(new, F.lit(1)) > F.get(cur, F.lit(1))) & (F.get(new, F.lit(0)) >= F.get(cur, F.lit(0)))
    return F.coalesce(F.when(major, by_major).otherwise(by_minor), F.lit(False))


# CVSS v3 metric weights.
CVSS_AV = {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2}
CVSS_AC = {"L": 0.77, "H": 0.44}
CVSS_UI = {"N": 0.85, "R": 0.62}
CVSS_PR = {"N": 0.85, "L": 0.62, "H": 0.27}
CVSS_PR_CHANGED = {"N": 0.85, "L": 0.68, "H": 0.5}
CVSS_IMPACT = {"H": 0.56, "L": 0.22, "N": 0.0}
# End of fixed values


def cvss3_base_score(vector) -> Column:
    """Base score of a CVSS 3.0/3.1 vector; null for other or incomplete vectors."""
    text = _c(vector)

    def metric(name: str) -> Column:
        return F.regexp_extract(text, rf"/{name}:([^/:]+)", 1)

    changed = metric("S") == "C"
    pr = F.when(changed, lookup(metric("PR"), CVSS_PR_CHANGED, "double")).otherwise(
        lookup(metric("PR"), CVSS_PR, "double"))
    exploit = F.lit(8.22) * lookup(metric("AV"), CVSS_AV, "double") * lookup(metric("AC"), CVSS_AC, "double") \
        * pr * lookup(metric("UI"), CVSS_UI, "double")
    kept = [F.lit(1.0) - lookup(metric(k), CVSS_IMPACT, "double") for k in ("C", "I", "A")]
    iss = F.lit(1.0) - kept[0] * kept[1] * kept[2]
    impact = F.when(changed, 7.52 * (iss - 0.029) - 3.25 * F.pow(iss - 0.02, F.lit(15.0))).otherwise(6.42 * iss)
    total = F.least(F.when(changed, 1.08).otherwise(1.0) * (impact + exploit), F.lit(10.0))
    score = F.when(impact <= 0, F.lit(0.0)).otherwise(F.ceil(F.rint(total * 100000) / 10000) / 10)
    return F.when(text.startswith("CVSS:3.") & (metric("S") != "") & exploit.isNotNull() & iss.isNotNull(), score)


def advisory_severity(label: Column, scores: Column) -> Column:
    """Label first, else the highest CVSS score, else medium."""
    named = lookup(F.upper(F.coalesce(label, F.lit(""))), {
        "CRITICAL": "critical", "HIGH": "high", "MODERATE": "medium", "MEDIUM": "medium", "LOW": "low"})
    top = F.array_max(F.transform(scores, cvss3_base_score))
    return F.coalesce(named, F.when(top >= 9, "critical").when(top >= 7, "high").when(top >= 4, "medium")
                      .when(top.isNotNull(), "low"), F.lit("medium"))
