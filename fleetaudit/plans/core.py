"""Scoring, identity and ordering plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import core as C
from ..functions import text as X
from ..operators import AUDIT
from ..operators import findings as FI
from ..operators import scoring as SC
from ..vocab import RULE_NAMESPACE as NS


def findings(t) -> DataFrame:
    """Derived findings with the list columns of the finding schema."""
    return t.findings.withColumns({
        "references": F.col("refs"), "sources": F.array("analyzer")}).drop("refs")


def outcomes(t) -> DataFrame:
    return t.outcomes.withColumn("categories", F.array("category")).drop("category")


def valid(t) -> DataFrame:
    return FI.validate(findings(t), t.files)


def identified(t) -> DataFrame:
    return FI.fingerprint(located(t))


def located(t) -> DataFrame:
    return FI.attach_source_line(valid(t), t.lines)


def merged(t) -> DataFrame:
    return FI.merge_duplicates(located(t))


# --- check SQL building blocks ---------------------------------------------------------------------
SEV_RANK = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
CONF_RANK = "CASE confidence WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END"
WEIGHT = "CASE severity WHEN 'critical' THEN 40 WHEN 'high' THEN 15 WHEN 'medium' THEN 6 WHEN 'low' THEN 2 ELSE 0 END"
# thousandths of a point, so the check sums integers
MILLI = (f"({WEIGHT}) * CASE confidence WHEN 'high' THEN 10 WHEN 'medium' THEN 7 ELSE 4 END * "
         "CASE kind WHEN 'confirmed' THEN 100 WHEN 'potential' THEN 75 WHEN 'estimate' THEN 50 ELSE 0 END")
BOUND = ("CASE WHEN confidence = 'low' THEN NULL WHEN severity = 'critical' THEN "
         "CASE WHEN kind = 'confirmed' AND confidence = 'high' THEN 35 ELSE 55 END WHEN severity = 'high' THEN "
         "CASE WHEN kind = 'confirmed' AND confidence = 'high' THEN 65 ELSE 75 END END")


def half_even_sql(num: str, den: str) -> str:
    """Integer division rounded half to even."""
    return (f"(({num}) // ({den}) + CASE WHEN 2 * (({num}) % ({den})) > ({den}) THEN 1 "
            f"WHEN 2 * (({num}) % ({den})) = ({den}) THEN (({num}) // ({den})) % 2 ELSE 0 END)")


RISK10 = "CASE WHEN {0} >= 800 THEN 'Low' WHEN {0} >= 600 THEN 'Moderate' WHEN {0} >= 400 THEN 'High' ELSE 'Critical' END"
CATS = ", ".join(f"('{c}')" for c in V.CATEGORIES)

CATEGORY_CTES = f"""
  scored AS (SELECT *, {MILLI} AS milli, {WEIGHT} AS w, {BOUND} AS bound FROM findings WHERE kind <> 'ai_observation'),
  rules_ AS (SELECT audit_id, category, rule_id, least(sum(milli), max(w) * 3000) AS pen, count(*) AS n
             FROM scored GROUP BY ALL),
  tight AS (SELECT audit_id, category, arg_min(struct_pack(b := bound, r := concat('capped at ', bound, ' by ',
              CASE WHEN kind = 'confirmed' AND confidence = 'high' THEN 'confirmed' ELSE kind END, ' ', severity,
              ' finding: ', title)), struct_pack(b := bound, a := analyzer, e := emit_idx)) AS c
            FROM scored WHERE bound IS NOT NULL GROUP BY ALL),
  cats AS (SELECT audit_id, category, sum(pen) AS pen, sum(n) AS n FROM rules_ GROUP BY ALL),
  seen AS (SELECT DISTINCT audit_id, category FROM outcomes WHERE status = 'ok'),
  grid AS (SELECT a.audit_id, c.category, s.category IS NOT NULL AS assessed, coalesce(k.pen, 0) AS pen,
                  coalesce(k.n, 0) AS findings, t.c.b AS b, t.c.r AS r,
                  greatest(0, 100000 - coalesce(k.pen, 0)) AS val
           FROM audits a CROSS JOIN (VALUES {CATS}) c(category)
           LEFT JOIN seen s ON s.audit_id = a.audit_id AND s.category = c.category
           LEFT JOIN cats k ON k.audit_id = a.audit_id AND k.category = c.category
           LEFT JOIN tight t ON t.audit_id = a.audit_id AND t.category = c.category),
  category_scores AS (
    SELECT audit_id, category, assessed, findings,
           CASE WHEN assessed THEN CASE WHEN b * 1000 < val THEN b * 10
                ELSE {half_even_sql('val', '100')} END END AS score10,
           CASE WHEN assessed THEN {half_even_sql('pen', '10')} ELSE 0 END AS pen100,
           CASE WHEN assessed AND b * 1000 < val THEN r ELSE '' END AS ceiling_reason
    FROM grid)"""

CAT_WEIGHT2 = ("CASE category WHEN 'security' THEN 6 WHEN 'dependencies' THEN 4 WHEN 'api' THEN 4 WHEN 'database' THEN 3 "
               "WHEN 'testing' THEN 3 WHEN 'devops' THEN 3 ELSE 2 END")
LEVEL = "CASE WHEN score10 >= 800 THEN 0 WHEN score10 >= 600 THEN 1 WHEN score10 >= 400 THEN 2 ELSE 3 END"

OVERALL_CTES = CATEGORY_CTES + f""",
  sums AS (SELECT audit_id, sum(score10 * {CAT_WEIGHT2}) AS s, sum({CAT_WEIGHT2}) AS w, count(*) AS n,
                  max({LEVEL} - CASE WHEN category IN ('security', 'api', 'dependencies', 'database') THEN 0 ELSE 1 END) AS fl
           FROM category_scores WHERE assessed GROUP BY 1),
  overall AS (SELECT audit_id, n, fl, {half_even_sql('s', 'w')} AS o FROM sums)"""

NORM_PATH = "regexp_replace(replace(file_path, chr(92), '/'), '^(\\./)+', '')"
VALID_CTES = f"""
  titled AS (SELECT * REPLACE ({NORM_PATH} AS file_path) FROM findings WHERE trim(title) <> ''),
  valid AS (
    SELECT f.* REPLACE (CASE WHEN f.line_start BETWEEN 1 AND greatest(x.line_count, 1) THEN f.line_start END AS line_start,
                        CASE WHEN f.line_start NOT BETWEEN 1 AND greatest(x.line_count, 1) THEN NULL
                             WHEN f.line_end < f.line_start THEN f.line_start ELSE f.line_end END AS line_end)
    FROM titled f JOIN files x ON x.audit_id = f.audit_id AND x.path = f.file_path WHERE f.file_path <> ''
    UNION ALL SELECT * FROM titled WHERE file_path = '')"""

_FAMILY_ARMS = " ".join(f"WHEN rule_id = '{rule}' THEN '{family}'" for rule, family in V.RULE_FAMILY.items())
FAMILY = (f"CASE {_FAMILY_ARMS} WHEN rule_id LIKE 'trivy:secret-%' OR (rule_id LIKE '{NS}secrets.%' AND rule_id <> "
          f"'{NS}secrets.env-file-committed') THEN 'hardcoded-secret' WHEN rule_id LIKE 'semgrep:%' THEN "
          "CASE WHEN lower(rule_id) LIKE '%sql%' THEN 'sql-injection' WHEN lower(rule_id) LIKE '%subprocess-shell%' "
          "THEN 'shell-injection' WHEN lower(rule_id) LIKE '%hardcoded%' THEN 'hardcoded-secret' "
          "WHEN lower(rule_id) LIKE '%debug%' THEN 'flask-debug' END END")
FP_CTES = VALID_CTES + f""",
  keyed AS (
    SELECT v.*, coalesce({FAMILY}, rule_id) AS k, coalesce(v.line_start, 0) AS ln,
           left(trim(regexp_replace(CASE WHEN v.file_path <> '' AND v.line_start IS NOT NULL THEN coalesce(l.text, '')
                ELSE v.title END, '\\s+', ' ', 'g')), 300) AS anchor
    FROM valid v LEFT JOIN lines l ON l.audit_id = v.audit_id AND l.path = v.file_path AND l.line_no = v.line_start),
  fp AS (SELECT * EXCLUDE (k, ln, anchor),
           sha256(concat_ws('|', k, file_path, anchor,
             dense_rank() OVER (PARTITION BY audit_id, k, file_path, anchor ORDER BY ln) - 1)) AS fingerprint
         FROM keyed)"""

# The merge written as the fold it is: a list per fingerprint, reduced in order.
MERGED_CTES = FP_CTES + f""",
  ordered AS (SELECT *, {SEV_RANK} AS sr, {CONF_RANK} AS cr, starts_with(rule_id, '{NS}taint.') AS taint,
                row_number() OVER (PARTITION BY audit_id, fingerprint ORDER BY analyzer, emit_idx) AS rn FROM fp),
  bounds AS (SELECT audit_id, fingerprint, bool_or(taint AND rn = 1) AS ft, max(CASE WHEN taint THEN rn END) AS lt
             FROM ordered GROUP BY ALL),
  ranged AS (SELECT o.*, CASE WHEN b.ft OR b.lt IS NULL THEN 1 ELSE b.lt END AS st FROM ordered o
             JOIN bounds b USING (audit_id, fingerprint)),
  merged AS (
    SELECT org_id, repo_id, audit_id, fingerprint, arg_min(rule_id, rn) AS rule_id, arg_min(title, rn) AS title,
      arg_min(category, rn) AS category, arg_min(file_path, rn) AS file_path,
      arg_min(coalesce(line_start, -1), rn) AS line0, arg_min(analyzer, rn) AS analyzer, arg_min(emit_idx, rn) AS emit_idx,
      CASE max(sr) WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'info' END AS severity,
      arg_min(confidence, (2 - cr) * 1000000 + rn) FILTER (rn >= st) AS confidence,
      arg_min(kind, (2 - cr) * 1000000 + rn) FILTER (rn >= st) AS kind,
      arg_min(description, rn) FILTER (rn >= st) AS description,
      coalesce(arg_min(evidence, rn) FILTER (rn >= st AND evidence <> ''), '') AS evidence, count(*) AS reports
    FROM ranged GROUP BY ALL)"""


def _category_plan(t):
    return SC.category_scores(findings(t), outcomes(t), t.audits).select(
        "audit_id", "category", "assessed", (F.col("score") * 10).cast("int").alias("score10"),
        (F.col("penalty") * 100).cast("long").alias("penalty100"), "findings", "risk", "ceiling_reason")


def _overall_plan(t):
    return SC.scorecard(findings(t), outcomes(t), t.audits).select(
        "audit_id", (F.col("overall") * 10).cast("int").alias("overall10"), "risk", "assessed")


def _merged_plan(t):
    return merged(t).select(
        "audit_id", "fingerprint", "rule_id", "title", "category", "severity", "confidence", "kind", "description",
        "evidence", "reports", F.array_join("sources", ",").alias("sources"),
        F.array_join("references", ",").alias("refs"))


PLANS = [
    ("scorecard_category", _category_plan, f"""WITH {CATEGORY_CTES}
        SELECT audit_id, category, assessed, score10, pen100 AS penalty100, findings, ceiling_reason,
               CASE WHEN assessed THEN {RISK10.format('score10')} ELSE 'Not assessed' END AS risk
        FROM category_scores"""),
    ("scorecard_overall", _overall_plan, f"""WITH {OVERALL_CTES}
        SELECT a.audit_id, o AS overall10, coalesce(n, 0) AS assessed,
               CASE WHEN o IS NULL THEN 'Not assessed' ELSE
               CASE greatest(fl, CASE WHEN o >= 800 THEN 0 WHEN o >= 600 THEN 1 WHEN o >= 400 THEN 2 ELSE 3 END)
                 WHEN 0 THEN 'Low' WHEN 1 THEN 'Moderate' WHEN 2 THEN 'High' ELSE 'Critical' END END AS risk
        FROM audits a LEFT JOIN overall v ON v.audit_id = a.audit_id"""),
    ("severity_counts", lambda t: FI.severity_counts(findings(t), ["audit_id"]), """
        SELECT audit_id, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high,
               count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low,
               count(*) FILTER (severity = 'info') AS info
        FROM findings WHERE kind <> 'ai_observation' GROUP BY 1"""),
    ("assessed_categories", lambda t: SC.assessed_categories(outcomes(t)).select("audit_id", "category"), """
        SELECT DISTINCT audit_id, category FROM outcomes WHERE status = 'ok'"""),
    ("validate_findings",
     lambda t: valid(t).select("audit_id", "emit_idx", "rule_id", "file_path", "line_start", "line_end"),
     f"WITH {VALID_CTES} SELECT audit_id, emit_idx, rule_id, file_path, line_start, line_end FROM valid"),
    ("fingerprints", lambda t: identified(t).select("audit_id", "emit_idx", "rule_id", "fingerprint"),
     f"WITH {FP_CTES} SELECT audit_id, emit_idx, rule_id, fingerprint FROM fp"),
    ("merge_duplicates", _merged_plan, f"""WITH {MERGED_CTES},
        srcs AS (SELECT audit_id, fingerprint, string_agg(analyzer, ',' ORDER BY o) AS sources FROM (
                   SELECT audit_id, fingerprint, analyzer, min(rn) AS o FROM ranged GROUP BY ALL) GROUP BY ALL),
        refs_ AS (SELECT audit_id, fingerprint, string_agg(r, ',' ORDER BY o) AS refs FROM (
                   SELECT audit_id, fingerprint, r, min(rn * 10 + pos) AS o FROM (
                     SELECT audit_id, fingerprint, rn, unnest(refs) AS r, generate_subscripts(refs, 1) AS pos FROM ranged)
                   GROUP BY ALL) GROUP BY ALL)
        SELECT audit_id, fingerprint, rule_id, title, category, severity, confidence, kind, description, evidence, reports,
               sources, refs
        FROM merged JOIN srcs USING (audit_id, fingerprint) JOIN refs_ USING (audit_id, fingerprint)"""),
]
