"""History, triage, policy, gate, change-risk, verification, compliance and portfolio plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import AUDIT, REPO
from ..operators import change_risk as CR
from ..operators import compliance as CO
from ..operators import findings as FI
from ..operators import history as H
from ..operators import policy as PO
from ..operators import portfolio as PF
from ..operators import scoring as SC
from ..operators import triage as TR
from ..operators import verify as VE
from .. import compliance_map as M
from .. import vocab as V
from ..vocab import RULE_NAMESPACE as NS
from ..session import cut_lineage
from .core import BOUND, CATEGORY_CTES, LEVEL, RISK10, SEV_RANK, findings, outcomes
from .views import TODAY

NOW = TODAY + " 12:00:00"


def audit_findings(t) -> DataFrame:
    return t.audit_findings.withColumns({
        "references": F.col("refs"), "sources": F.array("analyzer")}).drop("refs")


def shared_findings(t) -> DataFrame:
    """The same, written once for a query that reads them on several ways."""
    if "findings_table" not in vars(t):
        t.findings_table = cut_lineage(audit_findings(t))
    return t.findings_table


def prints(t, *more: str) -> DataFrame:
    """Audit and fingerprint of the findings, and the columns of ``more``: no text is moved that nobody reads."""
    return audit_findings(t).select(*AUDIT, "fingerprint", *more)


def based(t) -> DataFrame:
    """The audits with their baselines, in a table: what tells a finding's lifecycle of them."""
    return cut_lineage(H.with_baseline(t.audits.select(*AUDIT, "branch", "status", "pr_number", "created_at")))


def audits(t) -> DataFrame:
    return t.audits.withColumn("overall_score", (F.col("score10") / 10).cast("decimal(5,1)"))


def day(col: str):
    return F.date_format(col, "yyyy-MM-dd")


# --- check SQL building blocks ---------------------------------------------------------------------
GOOD = "status = 'succeeded' AND pr_number IS NULL"
BASE_CTES = f"""
  based AS (
    SELECT a.*, coalesce(
      (SELECT max(struct_pack(c := p.created_at, i := p.audit_id)) FROM audits p WHERE p.repo_id = a.repo_id
         AND p.status = 'succeeded' AND p.pr_number IS NULL AND p.branch = a.branch AND p.audit_id <> a.audit_id
         AND p.created_at <= a.created_at),
      (SELECT max(struct_pack(c := p.created_at, i := p.audit_id)) FROM audits p WHERE p.repo_id = a.repo_id
         AND p.status = 'succeeded' AND p.pr_number IS NULL AND p.audit_id <> a.audit_id
         AND p.created_at <= a.created_at)).i AS previous_audit_id
    FROM audits a)"""
# the same with window frames, which need no look-up per audit
FRAME = "ORDER BY created_at RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE CURRENT ROW"
BASE_WINDOW = f"""
  runs_good AS MATERIALIZED (SELECT *, CASE WHEN {GOOD} THEN struct_pack(c := created_at, i := audit_id) END AS good FROM audits),
  based AS MATERIALIZED (
    SELECT *, coalesce(max(good) OVER (PARTITION BY repo_id, branch {FRAME}), max(good) OVER (PARTITION BY repo_id {FRAME})).i AS previous_audit_id
    FROM runs_good)"""
LATEST_CTE = f"latest AS (SELECT repo_id, arg_max(audit_id, struct_pack(c := created_at, i := audit_id)) AS audit_id FROM audits WHERE {GOOD} GROUP BY 1)"

CLASSIFY_SQL = f"""WITH {BASE_CTES},
  runs AS (SELECT DISTINCT a.repo_id, f.fingerprint, a.audit_id, a.created_at FROM audit_findings f
           JOIN audits a USING (audit_id) WHERE a.status = 'succeeded' AND a.pr_number IS NULL),
  prints AS (SELECT DISTINCT audit_id, fingerprint FROM audit_findings),
  labelled AS (
    SELECT f.audit_id, f.emit_idx, f.rule_id, f.fingerprint,
      CASE WHEN p.audit_id IS NOT NULL THEN 'existing'
           WHEN EXISTS (SELECT 1 FROM runs r WHERE r.repo_id = b.repo_id AND r.fingerprint = f.fingerprint
                        AND r.audit_id <> f.audit_id AND r.created_at <= b.created_at) THEN 'recurring'
           ELSE 'new' END AS lifecycle
    FROM audit_findings f JOIN based b USING (audit_id)
    LEFT JOIN prints p ON p.audit_id = b.previous_audit_id AND p.fingerprint = f.fingerprint),
  gone AS (
    SELECT b.audit_id, p.fingerprint FROM based b JOIN prints p ON p.audit_id = b.previous_audit_id
    WHERE NOT EXISTS (SELECT 1 FROM prints c WHERE c.audit_id = b.audit_id AND c.fingerprint = p.fingerprint))"""


def policy_layers(t) -> DataFrame:
    """Two layers per repository: the organization's default below the repository's own."""
    org, repo = F.col("org_id").cast("int"), F.col("repo_id").cast("int")

    def texts(*items: str):
        return F.array(*[F.lit(i) for i in items]).cast("array<string>")

    def entries(names: tuple[str, str], *items: tuple[str, str]):
        return F.array(*[F.struct(F.lit(a).alias(names[0]), F.lit(b).alias(names[1])) for a, b in items])

    gate, sev = ("pattern", "fail_on"), ("pattern", "severity")
    none_gate = F.array().cast("array<struct<pattern:string,fail_on:string>>")
    none_sev = F.array().cast("array<struct<pattern:string,severity:string>>")
    top = t.repositories.select(
        *REPO, F.lit(1).alias("layer"),
        F.when(repo % 3 == 0, "critical").when(repo % 3 == 1, "medium").alias("fail_on"),
        F.when(repo % 4 == 0, F.lit(2)).alias("max_findings"), F.when(repo % 2 == 0, "medium").alias("max_change_risk"),
        texts("api").alias("require_analyzers"),
        F.when(repo % 5 == 0, texts("bandit:*")).otherwise(texts()).alias("disable_rules"),
        texts().alias("disable_analyzers"),
        F.when(repo % 6 == 0, texts("src/m1*")).otherwise(texts()).alias("exclude_paths"),
        F.when(repo % 2 == 1, entries(gate, ("src/auth*", "low"))).otherwise(none_gate).alias("path_gates"),
        F.when(repo % 7 == 0, entries(sev, ("bandit:B105", "critical"), (NS + "devops.*", "low")))
        .otherwise(none_sev).alias("severity_overrides"))
    base = t.repositories.select(
        *REPO, F.lit(0).alias("layer"), F.when(org % 2 == 0, "medium").alias("fail_on"),
        F.lit(None).cast("int").alias("max_findings"), F.lit(None).cast("string").alias("max_change_risk"),
        F.when(org % 3 == 0, texts("api", "bandit")).otherwise(texts()).alias("require_analyzers"),
        texts("mypy:arg-type").alias("disable_rules"), texts("mypy").alias("disable_analyzers"),
        F.when(org % 4 == 0, texts("tests/**")).otherwise(texts()).alias("exclude_paths"),
        entries(gate, ("src/**", "high"), ("src/auth*", "never")).alias("path_gates"),
        entries(sev, (NS + "devops.*", "high"), (NS + "devops.k8s-*", "medium"), ("bandit:*", "low"))
        .alias("severity_overrides"))
    return base.unionByName(top)


ORG, REP = "CAST(org_id AS INT)", "CAST(repo_id AS INT)"
POLICY_CTES = f"""
  pol AS (SELECT org_id, repo_id,
      coalesce(CASE {REP} % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'medium' END, CASE WHEN {ORG} % 2 = 0 THEN 'medium' END,
               'high') AS fail_on,
      CASE WHEN {REP} % 4 = 0 THEN 2 END AS max_findings,
      CASE WHEN {REP} % 2 = 0 THEN 'medium' ELSE 'never' END AS max_change_risk,
      CASE WHEN {ORG} % 3 = 0 THEN ['api', 'bandit'] ELSE ['api'] END AS required
    FROM repositories),
  effects AS (SELECT f.*,
      CASE WHEN ({ORG} % 4 = 0 AND file_path LIKE 'tests/%') OR ({REP} % 6 = 0 AND file_path LIKE 'src/m1%') THEN 'excluded'
           WHEN rule_id = 'mypy:arg-type' OR ({REP} % 5 = 0 AND rule_id LIKE 'bandit:%') THEN 'disabled' END AS drop_effect,
      CASE WHEN {REP} % 7 = 0 AND rule_id = 'bandit:B105' THEN 'critical'
           WHEN rule_id LIKE '{NS}devops.k8s-%' THEN 'medium'
           WHEN rule_id LIKE '{NS}devops.%' THEN CASE WHEN {REP} % 7 = 0 THEN 'low' ELSE 'high' END
           WHEN rule_id LIKE 'bandit:%' THEN 'low' END AS to_sev
    FROM audit_findings f),
  applied AS (SELECT * EXCLUDE (severity), coalesce(to_sev, severity) AS severity,
      CASE WHEN drop_effect IS NOT NULL THEN drop_effect WHEN to_sev <> severity THEN 'overridden' END AS effect
    FROM effects)"""
THRESHOLD = f"""CASE WHEN {REP} % 2 = 1 AND file_path LIKE 'src/auth%' THEN 'low' WHEN file_path LIKE 'src/%' THEN 'high'
                ELSE fail_on END"""


def rank_of(expr: str) -> str:
    return SEV_RANK.replace("CASE severity", f"CASE ({expr})")


def changed_files(t) -> DataFrame:
    """Files a pull request touches: the audit's source files with derived line counts."""
    prs = t.audits.filter("pr_number IS NOT NULL").select(*AUDIT)
    return t.lines.join(prs, AUDIT, "left_semi").groupBy(*AUDIT, "path").agg(
        (F.sum("line_no") * 40).alias("additions"), F.count(F.lit(1)).alias("deletions"),
        F.min("line_no").alias("seq"))


CHANGED_CTE = """changed AS (SELECT l.audit_id, path, sum(line_no) * 40 AS additions, count(*) AS deletions,
                   min(line_no) AS seq FROM lines l JOIN audits a USING (audit_id) WHERE a.pr_number IS NOT NULL GROUP BY ALL)"""
INTRO_CTE = """intro AS (SELECT f.* FROM audit_findings f JOIN changed c ON c.audit_id = f.audit_id AND c.path = f.file_path
                 WHERE kind <> 'ai_observation' AND triage_status = 'open' AND lifecycle IN ('new', 'recurring'))"""


def change_risk(t) -> DataFrame:
    files = changed_files(t)
    prs = t.audits.filter("pr_number IS NOT NULL")
    return CR.assess(files, PO.introduced(shared_findings(t), files), prs)


AUTH_RE = V.SENSITIVE_AREAS[0][2]
CHANGE_CTES = f"""{CHANGED_CTE}, {INTRO_CTE},
  flagged AS (SELECT *, regexp_matches(lower(path), '(^|/)(tests?|__tests__|specs?|testing|fixtures|e2e)/|(^|/)test_[^/]*$') AS is_test,
                regexp_matches(path, '{AUTH_RE}') AS auth FROM changed),
  sized AS (SELECT audit_id, sum(additions + deletions) AS lines, count(*) AS n,
              count(*) FILTER (regexp_matches(path, '[.](py|js)$') AND NOT is_test) AS code, count(*) FILTER (is_test) AS tests,
              count(*) FILTER (auth AND NOT is_test) AS auth FROM flagged GROUP BY 1),
  pts AS (SELECT audit_id, sum(CASE severity WHEN 'critical' THEN 15 WHEN 'high' THEN 10 WHEN 'medium' THEN 4
              WHEN 'low' THEN 1 ELSE 0 END) AS p, count(*) FILTER (rule_id LIKE '%:ai-code.%') AS ai FROM intro GROUP BY 1),
  risk AS (SELECT a.audit_id, least(100,
      CASE WHEN lines > 1000 THEN 25 WHEN lines > 400 THEN 15 WHEN lines > 150 THEN 8 ELSE 0 END
      + CASE WHEN n > 30 THEN 10 WHEN n > 10 THEN 5 ELSE 0 END + CASE WHEN auth > 0 THEN 15 ELSE 0 END
      + CASE WHEN code > 0 AND tests = 0 THEN 15 ELSE 0 END + least(30, coalesce(p, 0)) + least(15, 5 * coalesce(ai, 0)))
      AS score FROM (SELECT * FROM audits WHERE pr_number IS NOT NULL) a LEFT JOIN sized USING (audit_id)
      LEFT JOIN pts USING (audit_id)),
  risk0 AS (SELECT audit_id, coalesce(score, 0) AS score FROM risk)"""


def fix_pairs(t) -> DataFrame:
    """Each audit with a baseline is read as the re-audit of a fix to its baseline."""
    return H.with_baseline(t.audits.select(*AUDIT, "branch", "status", "pr_number", "created_at")).filter(
        F.col("previous_audit_id").isNotNull()).select(*REPO, "audit_id", "previous_audit_id")


FIX_COLUMNS = ["file_path", "rule_id", "severity", "fingerprint", "line_start"]


def fix_runs(t, *more: str):
    """The findings before and after every re-audit, read once: a finding is tagged with the run and the side it is on. It keeps
    the columns the comparison reads and those of ``more``, and lies by run, as every step of the comparison wants it."""
    pairs = cut_lineage(fix_pairs(t))
    sides = F.array(F.struct(F.col("previous_audit_id").alias("source"), F.lit(True).alias("before")),
                    F.struct(F.col("audit_id").alias("source"), F.lit(False).alias("before")))
    roles = pairs.select(*AUDIT, F.explode(sides).alias("r")).select(*AUDIT, "r.source", "r.before")
    found = audit_findings(t).select(*REPO, F.col("audit_id").alias("source"), *FIX_COLUMNS, *more)
    tagged = cut_lineage(found.join(roles, [*REPO, "source"]).drop("source")).repartition(*AUDIT)
    baseline, after = tagged.filter("before").drop("before"), tagged.filter("NOT before").drop("before")
    changed = baseline.filter(F.col("file_path") != "").select(*AUDIT, F.col("file_path").alias("path")).distinct()
    targets = baseline.filter(F.col("severity").isin("critical", "high"))
    failed = outcomes(t).filter(F.col("status") != "ok").join(pairs.select(*AUDIT), AUDIT, "left_semi")
    judged, introduced = VE.compare(targets, baseline, after, changed, AUDIT)
    return judged, introduced, failed, baseline, changed


FIX_CTES = f"""{BASE_CTES},
  basef AS (SELECT b.audit_id, f.* EXCLUDE (audit_id) FROM based b JOIN audit_findings f ON f.audit_id = b.previous_audit_id),
  afterf AS (SELECT f.* FROM audit_findings f JOIN based b USING (audit_id) WHERE b.previous_audit_id IS NOT NULL),
  scope AS (SELECT DISTINCT audit_id, file_path FROM basef WHERE file_path <> ''),
  bn AS (SELECT audit_id, file_path, rule_id, count(*) AS n FROM basef JOIN scope USING (audit_id, file_path) GROUP BY ALL),
  an AS (SELECT audit_id, file_path, rule_id, count(*) AS n FROM afterf JOIN scope USING (audit_id, file_path) GROUP BY ALL),
  judged AS (SELECT t.audit_id, t.emit_idx, NOT EXISTS (SELECT 1 FROM afterf a WHERE a.audit_id = t.audit_id AND a.fingerprint = t.fingerprint)
               AND coalesce(an.n, 0) < coalesce(bn.n, 0) AS resolved
             FROM basef t LEFT JOIN bn ON bn.audit_id = t.audit_id AND bn.file_path = t.file_path AND bn.rule_id = t.rule_id
             LEFT JOIN an ON an.audit_id = t.audit_id AND an.file_path = t.file_path AND an.rule_id = t.rule_id
             WHERE t.severity IN ('critical', 'high')),
  fresh AS (SELECT a.*, row_number() OVER (PARTITION BY a.audit_id, a.file_path, a.rule_id ORDER BY coalesce(line_start, 0), fingerprint) AS rn
            FROM afterf a JOIN scope USING (audit_id, file_path)
            WHERE NOT EXISTS (SELECT 1 FROM basef b WHERE b.audit_id = a.audit_id AND b.fingerprint = a.fingerprint)),
  introduced AS (SELECT f.audit_id, f.rule_id, f.file_path, f.line_start FROM fresh f
                 JOIN an ON an.audit_id = f.audit_id AND an.file_path = f.file_path AND an.rule_id = f.rule_id
                 LEFT JOIN bn ON bn.audit_id = f.audit_id AND bn.file_path = f.file_path AND bn.rule_id = f.rule_id
                 WHERE rn <= an.n - coalesce(bn.n, 0))"""


def _verdict_plan(t):
    judged, introduced, failed, _, _ = fix_runs(t)
    return VE.verdict(judged, introduced, failed, AUDIT).select(
        "audit_id", "resolved", "still_present", "introduced", "incomplete", "verdict")


def mapped(t) -> DataFrame:
    return CO.map_findings(audit_findings(t))


def _row_values() -> str:
    rows = []
    for i, (pattern, cwe, owasp, asvs, soc2, iso) in enumerate(M.RULE_ROWS):
        lists = [" ".join(map(str, x)) for x in (cwe, owasp, asvs, soc2, iso)]
        rows.append(f"({i}, '{pattern}', " + ", ".join(f"'{x}'" for x in lists) + ")")
    return ", ".join(rows)


_FB = ", ".join(f"('{c}', '{' '.join(v['owasp'])}', '{' '.join(v['soc2'])}', '{' '.join(v['iso27001'])}')"
                for c, v in M.FALLBACK_ROWS.items())
_OWM = ", ".join(f"{n}: '{o}'" for n, o in M.OWASP_OF_CWE.items())
# glob rows as GLOB patterns: the star crosses every character in a rule id
COMPLIANCE_CTES = f"""
  rows_ AS (SELECT * FROM (VALUES {_row_values()}) r(i, pattern, cwe, owasp, asvs, soc2, iso)),
  rids AS (SELECT DISTINCT rule_id FROM audit_findings),
  hit AS (SELECT rule_id, min(i) AS i FROM rids JOIN rows_ ON rule_id GLOB pattern GROUP BY 1),
  fb AS (SELECT * FROM (VALUES {_FB}) x(category, fowasp, fsoc2, fiso)),
  texts AS (SELECT f.org_id, f.kind, f.triage_status, f.audit_id, f.emit_idx, f.rule_id, f.category, f.severity, coalesce(r.cwe, '') AS rcwe, coalesce(r.owasp, '') AS rowasp,
              coalesce(r.asvs, '') AS rasvs, coalesce(r.soc2, '') AS rsoc2, coalesce(r.iso, '') AS riso,
              regexp_extract(description, '(?i)CWE[-_ ]?([0-9]+)', 1) AS dcwe
            FROM audit_findings f LEFT JOIN hit USING (rule_id) LEFT JOIN rows_ r ON r.i = hit.i),
  cwes AS (SELECT * EXCLUDE (rcwe, dcwe), CASE WHEN dcwe = '' OR list_contains(string_split(rcwe, ' '), dcwe) THEN rcwe
             ELSE trim(concat(rcwe, ' ', dcwe)) END AS cwe FROM texts),
  mapped AS (SELECT c.org_id, c.kind, c.triage_status, c.audit_id, c.emit_idx, c.rule_id, c.severity, cwe, rasvs AS asvs,
      CASE WHEN rsoc2 <> '' THEN rsoc2 ELSE fsoc2 END AS soc2, CASE WHEN riso <> '' THEN riso ELSE fiso END AS iso27001,
      CASE WHEN oo <> '' THEN oo ELSE fowasp END AS owasp
    FROM (SELECT c.*, array_to_string(list_distinct_ordered, ' ') AS oo FROM (
            SELECT c.*, list_filter(list_transform(range(1, len(al) + 1), lambda p: CASE WHEN list_position(al, al[p]) = p THEN al[p] END),
                                    lambda v: v IS NOT NULL) AS list_distinct_ordered
            FROM (SELECT c.*, list_concat(CASE WHEN rowasp = '' THEN [] ELSE string_split(rowasp, ' ') END,
                    list_filter(list_transform(CASE WHEN cwe = '' THEN [] ELSE string_split(cwe, ' ') END,
                      lambda n: (MAP {{{_OWM}}})[CAST(n AS INT)]), lambda v: v IS NOT NULL)) AS al
                  FROM cwes c) c) c) c
    LEFT JOIN fb USING (category))"""


def latest_scores(t) -> DataFrame:
    """Category scores of each repository's newest succeeded branch audit."""
    latest = H.latest_audits(audits(t))
    keep = latest.select(*AUDIT)
    return SC.category_scores(findings(t).join(keep, AUDIT, "left_semi"),
                              outcomes(t).join(keep, AUDIT, "left_semi"), latest)


def portfolio(t) -> DataFrame:
    return PF.portfolio(t.repositories, audits(t), shared_findings(t), latest_scores(t), NOW)


def _portfolio_plan(t):
    return portfolio(t).select(
        "org_id", "repo_id", "audit_id", "risk", "previous_risk", "average_risk", "attempt_status", "age_days",
        "open_critical", "open_high", "accepted_critical", "accepted_high",
        F.array_join("accepted_owners", ",").alias("owners"), day("accepted_review").alias("review"),
        "assessed", "flat", "failed", "running", "stale", "partial", "due", "escalated", "settled",
        "reason_category", "reason_finding", "reason_detail")


PORTFOLIO_CTES = f"""{CATEGORY_CTES}, {LATEST_CTE},
  la AS (SELECT a.* FROM audits a JOIN latest l ON l.audit_id = a.audit_id),
  att AS (SELECT repo_id, arg_max(status, struct_pack(c := created_at, i := audit_id)) AS st, max(created_at) AS at
          FROM audits WHERE pr_number IS NULL GROUP BY 1),
  hist AS (SELECT repo_id, risk_level, row_number() OVER (PARTITION BY repo_id ORDER BY created_at DESC, audit_id DESC) AS rn
           FROM audits WHERE {GOOD}),
  rel AS (SELECT f.* FROM audit_findings f JOIN la USING (audit_id) WHERE f.kind <> 'ai_observation'
            AND f.triage_status IN ('open', 'accepted_risk')),
  cnt AS (SELECT audit_id, count(*) FILTER (triage_status = 'open' AND severity = 'critical') AS oc,
            count(*) FILTER (triage_status = 'open' AND severity = 'high') AS oh,
            count(*) FILTER (triage_status <> 'open' AND severity = 'critical') AS ac,
            count(*) FILTER (triage_status <> 'open' AND severity = 'high') AS ah,
            count(*) FILTER (triage_status <> 'open') AS accepted FROM rel GROUP BY 1),
  own AS (SELECT audit_id, string_agg(triage_owner, ',' ORDER BY d NULLS LAST, triage_owner) AS owners, min(d) AS review FROM (
            SELECT audit_id, triage_owner, min(triage_expires_on) AS d FROM rel WHERE triage_status = 'accepted_risk' GROUP BY ALL) GROUP BY 1),
  grp AS (SELECT audit_id, category, severity, kind, confidence, triage_status, min(title) AS title, count(*) AS n FROM rel
          WHERE severity IN ('critical', 'high', 'medium') GROUP BY ALL),
  worst AS (SELECT * FROM grp QUALIFY row_number() OVER (PARTITION BY audit_id, category ORDER BY {SEV_RANK} DESC,
            triage_status <> 'open', kind <> 'confirmed', confidence <> 'high', kind, confidence) = 1),
  cs AS (SELECT c.*, {LEVEL} AS lv, category IN ('security', 'api', 'dependencies', 'database') AS crit,
           list_position([{', '.join(f"'{c}'" for c in V.CATEGORIES)}], category) AS pos FROM category_scores c WHERE audit_id IN (SELECT audit_id FROM la)),
  best AS (SELECT * FROM cs WHERE assessed QUALIFY row_number() OVER (PARTITION BY audit_id
            ORDER BY lv - CASE WHEN crit THEN 0 ELSE 1 END DESC, crit DESC, score10, pos) = 1),
  cov AS (SELECT audit_id, count(*) FILTER (assessed) AS assessed, bool_and(assessed AND lv = 0) AS flat FROM cs GROUP BY 1),
  rows_ AS (
    SELECT r.org_id, r.repo_id, r.name, la.audit_id, la.score10, coalesce(la.finished_at, la.created_at) AS checked_at,
      coalesce(la.risk_level, 'Not assessed') AS risk,
      CASE WHEN h.risk_level <> la.risk_level THEN h.risk_level ELSE '' END AS previous_risk,
      CASE WHEN la.audit_id IS NULL THEN '' ELSE {RISK10.format('la.score10')} END AS average_risk,
      CASE WHEN att.st <> 'succeeded' AND (la.created_at IS NULL OR att.at > la.created_at) THEN att.st END AS attempt_status,
      CAST(floor(epoch(TIMESTAMP '{NOW}' - coalesce(la.finished_at, la.created_at)) / 86400) AS INT) AS age_days,
      coalesce(oc, 0) AS open_critical, coalesce(oh, 0) AS open_high, coalesce(ac, 0) AS accepted_critical,
      coalesce(ah, 0) AS accepted_high, coalesce(accepted, 0) AS accepted, owners, review, coalesce(cov.assessed, 0) AS assessed,
      coalesce(flat, false) AS flat, b.category AS bcat,
      b.ceiling_reason AS breason, b.score10 AS bscore, w.title AS wtitle,
      concat(CASE WHEN w.kind = 'confirmed' THEN 'confirmed' ELSE replace(w.kind, '_', ' ') END, ' ', w.severity, ' finding',
        CASE WHEN w.n > 1 THEN concat(', ', w.n - 1, ' more like it') ELSE '' END,
        CASE WHEN w.triage_status = 'accepted_risk' THEN ', accepted risk' ELSE '' END) AS wdetail
    FROM repositories r LEFT JOIN la ON la.repo_id = r.repo_id LEFT JOIN att ON att.repo_id = r.repo_id
    LEFT JOIN hist h ON h.repo_id = r.repo_id AND h.rn = 2
    LEFT JOIN cnt ON cnt.audit_id = la.audit_id LEFT JOIN own ON own.audit_id = la.audit_id LEFT JOIN cov ON cov.audit_id = la.audit_id
    LEFT JOIN best b ON b.audit_id = la.audit_id AND la.risk_level <> 'Low'
    LEFT JOIN worst w ON w.audit_id = la.audit_id AND w.category = b.category),
  prow AS (SELECT *, coalesce(attempt_status = 'failed', false) AS failed, coalesce(attempt_status IN ('queued', 'running'), false) AS running,
      coalesce(age_days > 30, false) AS stale, audit_id IS NOT NULL AND assessed > 0 AND assessed < 10 AS partial,
      coalesce(review <= DATE '{TODAY}' + 14, false) AS due FROM rows_)"""

CONTROL_SELECT = " UNION ALL ".join(
    f"SELECT org_id, kind, triage_status, severity, '{fw}' AS framework, unnest(string_split({fw}, ' ')) AS control FROM mapped WHERE {fw} <> ''"
    for fw in ("cwe", "owasp", "asvs", "soc2", "iso27001"))


def _gate_plan(t):
    files = changed_files(t)
    rows = PO.gate_candidates(shared_findings(t), t.audits, files)
    policies = PO.layered(policy_layers(t))
    return PO.evaluate(rows, t.audits, outcomes(t), policies, change_risk(t)).select(
        "audit_id", "passed", "blocking", "candidates", "fail_on", F.array_join("reasons", "; ").alias("reasons"))


def _triage_decisions(t) -> DataFrame:
    rows = t.audit_findings
    return rows.select(
        "audit_id", "emit_idx", F.col("triage_status").alias("status"),
        F.when(F.col("emit_idx") % 2 == 0, F.concat(F.lit("Because of "), "title")).otherwise("ok").alias("reason"),
        F.col("triage_owner").alias("owner"), F.col("triage_expires_on").alias("expires_on"))


PLANS = [
    ("ranked_audits", lambda t: H.ranked_audits(t.audits, succeeded=True, limit=3).select(
        "repo_id", "audit_id", "rank"), f"""
        SELECT repo_id, audit_id, row_number() OVER (PARTITION BY repo_id ORDER BY created_at DESC, audit_id DESC) AS rank
        FROM audits WHERE {GOOD} QUALIFY rank <= 3"""),
    ("score_history", lambda t: H.score_history(audits(t)).select(
        "repo_id", F.array_join(F.transform("history", lambda h: h["audit_id"]), ",").alias("audits"),
        F.array_join(F.transform("history", lambda h: h["risk_level"]), ",").alias("risks")), f"""
        SELECT repo_id, string_agg(audit_id, ',' ORDER BY created_at, audit_id) AS audits,
               string_agg(risk_level, ',' ORDER BY created_at, audit_id) AS risks
        FROM (SELECT * FROM audits WHERE {GOOD}
              QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY created_at DESC, audit_id DESC) <= 10)
        GROUP BY 1"""),
    ("risk_revisions", lambda t: H.revisions(audits(t)).select(
        "org_id", "repo_id", "audit_id", "was", "now", "worse", "rev"), f"""
        WITH h AS (SELECT * FROM audits WHERE {GOOD}
                   QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY created_at DESC, audit_id DESC) <= 10),
        c AS (SELECT *, lag(risk_level) OVER (PARTITION BY repo_id ORDER BY created_at, audit_id) AS was FROM h),
        d AS (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY coalesce(finished_at, created_at) DESC, repo_id,
                audit_id DESC) AS rn FROM c WHERE was <> risk_level),
        r AS (SELECT org_id, repo_id, audit_id, was, risk_level AS now, count(*) OVER (PARTITION BY org_id) - rn AS k,
                list_position(['Critical', 'High', 'Moderate', 'Not assessed', 'Low'], risk_level)
                  < list_position(['Critical', 'High', 'Moderate', 'Not assessed', 'Low'], was) AS worse FROM d WHERE rn <= 12)
        SELECT org_id, repo_id, audit_id, was, now, worse, chr(CAST(65 + k AS INT)) AS rev FROM r"""),
    ("baseline_asof", lambda t: H.with_baseline(t.audits).select("audit_id", "previous_audit_id"),
     f"WITH {BASE_CTES} SELECT audit_id, previous_audit_id FROM based"),
    ("lifecycle", lambda t: H.classify(prints(t, "emit_idx", "rule_id"), based(t)).select(
        "audit_id", "emit_idx", "rule_id", "lifecycle"),
     f"{CLASSIFY_SQL} SELECT audit_id, emit_idx, rule_id, lifecycle FROM labelled"),
    ("resolved", lambda t: H.resolved(shared_findings(t), cut_lineage(H.with_baseline(t.audits))).select(
        "audit_id", "fingerprint"), f"{CLASSIFY_SQL} SELECT audit_id, fingerprint FROM gone"),
    ("lifecycle_counts", lambda t: (lambda f, a: H.lifecycle_counts(H.classify(f, a), H.resolved(f, a)))(
        prints(t), based(t)).select("audit_id", "new", "existing", "recurring", "resolved"),
     f"""{CLASSIFY_SQL}, c AS (SELECT audit_id, count(*) FILTER (lifecycle = 'new') AS n, count(*) FILTER (lifecycle = 'existing') AS e,
           count(*) FILTER (lifecycle = 'recurring') AS r FROM labelled GROUP BY 1),
         g AS (SELECT audit_id, count(*) AS g FROM gone GROUP BY 1)
        SELECT audit_id, coalesce(n, 0) AS new, coalesce(e, 0) AS existing, coalesce(r, 0) AS recurring, coalesce(g, 0) AS resolved
        FROM c FULL OUTER JOIN g USING (audit_id)"""),
    ("audit_compare", lambda t: H.compare_audits(shared_findings(t), fix_pairs(t).select(
        *REPO, F.col("previous_audit_id").alias("base_id"), F.col("audit_id").alias("head_id"))).select(
        "base_id", "head_id", "fingerprint", "change"), f"""WITH {BASE_CTES},
        prints AS (SELECT DISTINCT audit_id, fingerprint FROM audit_findings),
        b AS (SELECT b.previous_audit_id AS base_id, b.audit_id AS head_id, fingerprint FROM based b JOIN prints p ON p.audit_id = b.previous_audit_id),
        h AS (SELECT b.previous_audit_id AS base_id, b.audit_id AS head_id, fingerprint FROM based b JOIN prints p ON p.audit_id = b.audit_id
              WHERE b.previous_audit_id IS NOT NULL)
        SELECT base_id, head_id, fingerprint, CASE WHEN b.tag IS NULL THEN 'introduced' WHEN h.tag IS NULL THEN 'fixed' ELSE 'persisting' END AS change
        FROM (SELECT *, 1 AS tag FROM b) b FULL OUTER JOIN (SELECT *, 1 AS tag FROM h) h USING (base_id, head_id, fingerprint)"""),
    ("category_deltas", lambda t: H.category_deltas(
        SC.category_scores(findings(t), outcomes(t), t.audits), fix_pairs(t).select(
            *REPO, F.col("previous_audit_id").alias("base_id"), F.col("audit_id").alias("head_id"))).select(
        "base_id", "head_id", "category", (F.col("base_score") * 10).cast("int").alias("base10"),
        (F.col("head_score") * 10).cast("int").alias("head10")), f"""WITH {BASE_WINDOW},
        {CATEGORY_CTES.replace('category_scores AS (', 'category_scores AS MATERIALIZED (')}
        SELECT b.previous_audit_id AS base_id, b.audit_id AS head_id, h.category, p.score10 AS base10, h.score10 AS head10
        FROM based b JOIN category_scores h ON h.audit_id = b.audit_id
        JOIN category_scores p ON p.audit_id = b.previous_audit_id AND p.category = h.category"""),
    ("fingerprint_history", lambda t: H.fingerprint_history(audit_findings(t), t.audits).select(
        "repo_id", "fingerprint", "audit_id", "severity", "rank"), f"""
        SELECT repo_id, fingerprint, audit_id, severity, rank FROM (
          SELECT f.repo_id, f.fingerprint, f.audit_id, a.created_at, arg_max(severity, {SEV_RANK}) AS severity,
            row_number() OVER (PARTITION BY f.repo_id, f.fingerprint ORDER BY a.created_at DESC, f.audit_id DESC) AS rank
          FROM audit_findings f JOIN audits a USING (audit_id) GROUP BY f.repo_id, f.fingerprint, f.audit_id, a.created_at)
        WHERE rank <= 20"""),
    ("risk_register", lambda t: TR.risk_register(audit_findings(t), t.audits).select(
        "repo_id", "audit_id", "emit_idx", "triage_status", day("triage_expires_on").alias("review")), f"""
        WITH {LATEST_CTE} SELECT f.repo_id, f.audit_id, emit_idx, triage_status, CAST(triage_expires_on AS VARCHAR) AS review
        FROM audit_findings f JOIN latest l ON l.audit_id = f.audit_id
        WHERE triage_status IN ('accepted_risk', 'false_positive')"""),
    ("triage_carry", lambda t: TR.carry_forward(audit_findings(t), H.with_baseline(t.audits), TODAY).select(
        "audit_id", "emit_idx", "triage_status", "triage_owner", day("triage_expires_on").alias("review")),
     f"""WITH {BASE_CTES}, dec AS (
          SELECT audit_id, fingerprint, min(struct_pack(s := triage_status, o := triage_owner, e := coalesce(triage_expires_on, DATE '0001-01-01'))) AS d
          FROM audit_findings WHERE triage_status IN ('accepted_risk', 'false_positive')
            AND (triage_expires_on IS NULL OR triage_expires_on > DATE '{TODAY}') GROUP BY ALL)
        SELECT f.audit_id, f.emit_idx, coalesce(d.d.s, 'open') AS triage_status, d.d.o AS triage_owner,
               CASE WHEN d.d.e > DATE '0001-01-01' THEN CAST(d.d.e AS VARCHAR) END AS review
        FROM audit_findings f JOIN based b USING (audit_id) LEFT JOIN dec d ON d.audit_id = b.previous_audit_id AND d.fingerprint = f.fingerprint"""),
    ("triage_expired", lambda t: TR.reopen_expired(audit_findings(t), TODAY).select(
        "audit_id", "emit_idx", "triage_status", "lapsed"), f"""
        WITH r AS (SELECT audit_id, emit_idx, triage_expires_on AS e, CASE WHEN triage_status IN ('accepted_risk', 'false_positive')
          AND triage_expires_on <= DATE '{TODAY}' THEN 'open' ELSE triage_status END AS triage_status FROM audit_findings)
        SELECT audit_id, emit_idx, triage_status, triage_status = 'open' AND e IS NOT NULL AS lapsed FROM r"""),
    ("triage_validity", lambda t: TR.check_decisions(_triage_decisions(t), TODAY).select(
        "audit_id", "emit_idx", "error", "reason", "owner", day("expires_on").alias("expires_on")), f"""
        WITH d AS (SELECT audit_id, emit_idx, triage_status AS s, triage_status IN ('accepted_risk', 'false_positive') AS closing,
            trim(CASE WHEN emit_idx % 2 = 0 THEN concat('Because of ', title) ELSE 'ok' END) AS reason,
            triage_owner AS owner, triage_expires_on AS e FROM audit_findings)
        SELECT audit_id, emit_idx, CASE WHEN closing AND length(reason) < 10 THEN 'reason too short'
            WHEN s = 'accepted_risk' AND owner = '' THEN 'owner missing' WHEN s = 'accepted_risk' AND e IS NULL THEN 'review date missing'
            WHEN closing AND NOT (e BETWEEN DATE '{TODAY}' + 1 AND DATE '{TODAY}' + 365) THEN 'review date out of range' END AS error,
          CASE WHEN closing THEN reason ELSE '' END AS reason, CASE WHEN closing THEN owner ELSE '' END AS owner,
          CASE WHEN closing THEN CAST(e AS VARCHAR) END AS expires_on FROM d"""),
    ("policy_apply", lambda t: PO.effects(audit_findings(t), PO.layered(policy_layers(t))).select(
        "audit_id", "emit_idx", "effect", "severity"),
     f"""WITH {POLICY_CTES} SELECT audit_id, emit_idx, effect,
           CASE WHEN drop_effect IS NULL THEN severity ELSE (SELECT e.severity FROM effects e WHERE e.audit_id = a.audit_id AND e.emit_idx = a.emit_idx LIMIT 1) END AS severity
         FROM applied a"""),
    ("policy_effects", lambda t: PO.effect_counts(audit_findings(t), PO.layered(policy_layers(t))).select(
        "audit_id", "excluded", "disabled", "overridden"), f"""WITH {POLICY_CTES}
        SELECT audit_id, count(*) FILTER (effect = 'excluded') AS excluded, count(*) FILTER (effect = 'disabled') AS disabled,
               count(*) FILTER (effect = 'overridden') AS overridden FROM applied GROUP BY 1"""),
    ("path_threshold", lambda t: audit_findings(t).join(PO.compiled(PO.layered(policy_layers(t))).select(
        *REPO, "path_gates", "fail_on"), REPO).select("audit_id", "emit_idx", PO.threshold_for().alias("threshold")),
     f"""WITH {POLICY_CTES} SELECT audit_id, emit_idx, {THRESHOLD} AS threshold FROM audit_findings JOIN pol USING (org_id, repo_id)"""),
    ("policy_layers", lambda t: PO.digest(PO.layered(policy_layers(t))).select(
        "org_id", "repo_id", "fail_on", "max_findings", "max_change_risk", "digest"), f"""WITH {POLICY_CTES},
        js AS (SELECT org_id, repo_id, fail_on, max_findings, max_change_risk, concat(
          '{{"analyzers": {{"disable": ["mypy"]}}, "gate": {{"fail_on": "', fail_on, '", "max_change_risk": "', max_change_risk,
          '", "max_findings": ', coalesce(CAST(max_findings AS VARCHAR), 'null'), ', "paths": [',
          CASE WHEN {REP} % 2 = 1 THEN '{{"fail_on": "low", "pattern": "src/auth*"}}, ' ELSE '' END,
          '{{"fail_on": "high", "pattern": "src/**"}}, {{"fail_on": "never", "pattern": "src/auth*"}}], "require_analyzers": ',
          CASE WHEN {ORG} % 3 = 0 THEN '["api", "bandit"]' ELSE '["api"]' END, '}}, "paths": {{"exclude": [',
          concat_ws(', ', CASE WHEN {ORG} % 4 = 0 THEN '"tests/**"' END, CASE WHEN {REP} % 6 = 0 THEN '"src/m1*"' END), ']}}, "rules": {{"disable": ["mypy:arg-type"',
          CASE WHEN {REP} % 5 = 0 THEN ', "bandit:*"' ELSE '' END, '], "severity": {{"bandit:*": "low", ',
          CASE WHEN {REP} % 7 = 0 THEN '"bandit:B105": "critical", ' ELSE '' END, '"{NS}devops.*": "',
          CASE WHEN {REP} % 7 = 0 THEN 'low' ELSE 'high' END, '", "{NS}devops.k8s-*": "medium"}}}}}}') AS body FROM pol)
        SELECT org_id, repo_id, fail_on, max_findings, max_change_risk, left(sha256(body), 16) AS digest FROM js"""),
    ("pr_summary", lambda t: FI.severity_counts(PO.introduced(audit_findings(t), changed_files(t)), ["audit_id"]),
     f"""WITH {CHANGED_CTE}, {INTRO_CTE} SELECT audit_id, count(*) FILTER (severity = 'critical') AS critical,
           count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium,
           count(*) FILTER (severity = 'low') AS low, count(*) FILTER (severity = 'info') AS info FROM intro GROUP BY 1"""),
    ("change_risk", lambda t: change_risk(t).select("audit_id", "score", "level"), f"""WITH {CHANGE_CTES}
        SELECT audit_id, score, CASE WHEN score >= 60 THEN 'high' WHEN score >= 30 THEN 'medium' ELSE 'low' END AS level FROM risk0"""),
    ("gate", _gate_plan, f"""WITH {POLICY_CTES}, {CHANGE_CTES},
        cand AS (SELECT f.* FROM audit_findings f JOIN audits a USING (audit_id) WHERE a.pr_number IS NULL
                   AND kind <> 'ai_observation' AND triage_status = 'open'
                 UNION ALL SELECT * FROM intro),
        blk AS (SELECT audit_id, count(*) AS n, count(*) FILTER (thr <> 'never' AND {SEV_RANK} >= {rank_of('thr')}) AS b
                FROM (SELECT c.*, {THRESHOLD} AS thr FROM cand c JOIN pol USING (org_id, repo_id)) GROUP BY 1),
        oks AS (SELECT audit_id, list(DISTINCT name) AS ok FROM outcomes WHERE status = 'ok' GROUP BY 1),
        j AS (SELECT a.audit_id, p.*, coalesce(n, 0) AS n, coalesce(b, 0) AS b, r.score,
                CASE WHEN r.score >= 60 THEN 'high' WHEN r.score >= 30 THEN 'medium' ELSE 'low' END AS level,
                list_filter(p.required, lambda x: NOT list_contains(coalesce(o.ok, []), x)) AS missing
              FROM audits a JOIN pol p USING (org_id, repo_id) LEFT JOIN blk USING (audit_id) LEFT JOIN oks o USING (audit_id)
              LEFT JOIN risk0 r USING (audit_id)),
        k AS (SELECT *, concat_ws('; ', CASE WHEN b > 0 THEN concat(b, ' finding(s) at or above the gate threshold') END,
                CASE WHEN n > max_findings THEN concat(n, ' finding(s) exceed the maximum of ', max_findings) END,
                CASE WHEN len(missing) > 0 THEN concat('required analyzer(s) did not run: ', array_to_string(missing, ', ')) END,
                CASE WHEN score IS NOT NULL AND max_change_risk = 'medium' AND level = 'high' THEN
                  concat('change risk high (', score, ') is above the maximum medium') END) AS reasons FROM j)
        SELECT audit_id, reasons = '' AS passed, b AS blocking, n AS candidates, fail_on, reasons FROM k"""),
    ("gate_annotations", lambda t: PO.annotations(
        PO.gate_candidates(audit_findings(t), t.audits, changed_files(t)), PO.layered(policy_layers(t))).select(
        "audit_id", "rank", "path", "start_line", "end_line", "annotation_level", "title"), f"""
        WITH {POLICY_CTES}, {CHANGED_CTE}, {INTRO_CTE},
        cand AS (SELECT f.* FROM audit_findings f JOIN audits a USING (audit_id) WHERE a.pr_number IS NULL
                   AND kind <> 'ai_observation' AND triage_status = 'open' UNION ALL SELECT * FROM intro),
        g AS (SELECT *, coalesce(thr <> 'never' AND {SEV_RANK} >= {rank_of('thr')}, false) AS b FROM (
                SELECT c.*, {THRESHOLD} AS thr FROM cand c JOIN pol USING (org_id, repo_id)) WHERE file_path <> '')
        SELECT audit_id, row_number() OVER (PARTITION BY audit_id ORDER BY b DESC, {SEV_RANK} DESC, file_path, coalesce(line_start, 0),
                 fingerprint, emit_idx) AS rank, file_path AS path, coalesce(line_start, 1) AS start_line,
               greatest(coalesce(line_start, 1), coalesce(line_end, line_start, 1)) AS end_line,
               CASE WHEN b THEN 'failure' ELSE 'warning' END AS annotation_level, concat('[', severity, '] ', title) AS title
        FROM g"""),
    ("fix_resolution", lambda t: fix_runs(t, "emit_idx")[0].select("audit_id", "emit_idx", "resolved"),
     f"WITH {FIX_CTES} SELECT audit_id, emit_idx, resolved FROM judged"),
    ("fix_introduced", lambda t: fix_runs(t)[1].select("audit_id", "rule_id", "file_path", "line_start"),
     f"WITH {FIX_CTES} SELECT audit_id, rule_id, file_path, line_start FROM introduced"),
    ("fix_verdict", _verdict_plan, f"""WITH {FIX_CTES},
        j AS (SELECT audit_id, count(*) FILTER (resolved) AS resolved, count(*) FILTER (NOT resolved) AS still_present FROM judged GROUP BY 1),
        i AS (SELECT audit_id, count(*) AS introduced FROM introduced GROUP BY 1),
        o AS (SELECT audit_id, count(*) AS incomplete FROM outcomes WHERE status <> 'ok' GROUP BY 1)
        SELECT audit_id, resolved, still_present, coalesce(introduced, 0) AS introduced, coalesce(incomplete, 0) AS incomplete,
          CASE WHEN introduced > 0 THEN 'regressed' WHEN incomplete > 0 THEN 'incomplete' WHEN still_present = 0 THEN 'passed'
               ELSE 'partial' END AS verdict FROM j LEFT JOIN i USING (audit_id) LEFT JOIN o USING (audit_id)"""),
    ("analyzers_to_rerun", lambda t: (lambda r: VE.analyzers_to_rerun(
        outcomes(t), r[3], r[4], ["dependencies", "trivy"], AUDIT))(fix_runs(t, "sources")).select(
        "audit_id", F.array_join("analyzers", ",").alias("analyzers")), f"""WITH {FIX_CTES},
        ok AS (SELECT DISTINCT audit_id, name FROM outcomes WHERE status = 'ok'),
        rel AS (SELECT DISTINCT audit_id, analyzer AS name FROM basef JOIN scope USING (audit_id, file_path))
        SELECT audit_id, string_agg(name, ',' ORDER BY name) AS analyzers FROM ok o
        WHERE name NOT IN ('dependencies', 'trivy') OR EXISTS (SELECT 1 FROM rel r WHERE r.audit_id = o.audit_id AND r.name = o.name)
        GROUP BY 1"""),
    ("compliance_mapping", lambda t: mapped(t).select(
        "audit_id", "emit_idx", *[F.array_join(F.transform(fw, lambda x: F.replace(x, F.lit("CWE-"), F.lit(""))), " ").alias(fw)
                                  for fw in M.FRAMEWORKS]),
     f"WITH {COMPLIANCE_CTES} SELECT audit_id, emit_idx, cwe, owasp, asvs, soc2, iso27001 FROM mapped"),
    ("compliance_controls", lambda t: CO.summarize(mapped(t).filter(
        "kind <> 'ai_observation' AND triage_status = 'open'"), ["org_id"]).select(
        "org_id", "framework", F.replace("control", F.lit("CWE-"), F.lit("")).alias("control"), "findings", "critical", "high"),
     f"""WITH {COMPLIANCE_CTES}, pairs AS ({CONTROL_SELECT})
        SELECT org_id, framework, control, count(*) AS findings, count(*) FILTER (severity = 'critical') AS critical,
               count(*) FILTER (severity = 'high') AS high
        FROM pairs WHERE kind <> 'ai_observation' AND triage_status = 'open' GROUP BY ALL"""),
    ("portfolio", _portfolio_plan, f"""WITH {PORTFOLIO_CTES}
        SELECT org_id, repo_id, audit_id, risk, coalesce(previous_risk, '') AS previous_risk, average_risk, attempt_status, age_days, open_critical,
          open_high, accepted_critical, accepted_high, owners, CAST(review AS VARCHAR) AS review, assessed, flat, failed, running, stale,
          partial, due, average_risk <> '' AND average_risk <> risk AS escalated,
          risk = 'Low' AND assessed = 10 AND attempt_status IS NULL AND NOT stale AND NOT due AS settled, bcat AS reason_category,
          CASE WHEN bcat IS NULL THEN NULL WHEN contains(breason, ': ') THEN substr(breason, strpos(breason, ': ') + 2)
               ELSE coalesce(wtitle, '') END AS reason_finding,
          CASE WHEN bcat IS NULL THEN NULL WHEN contains(breason, ': ') THEN
                 regexp_replace(left(breason, strpos(breason, ': ') - 1), '^.*? by ', '')
               WHEN wtitle IS NOT NULL THEN wdetail ELSE concat('scored ', CAST(round_even(bscore / 10.0, 0) AS INT)) END AS reason_detail
        FROM prow"""),
    ("portfolio_summary", lambda t: PF.summary(portfolio(t)).withColumn(
        "latest_check", F.date_format("latest_check", "yyyy-MM-dd HH:mm:ss")), f"""WITH {PORTFOLIO_CTES}
        SELECT org_id, count(*) AS total, CAST(max(checked_at) AS VARCHAR) AS latest_check,
          count(*) FILTER (risk = 'Critical') AS risk_critical, count(*) FILTER (risk = 'High') AS risk_high,
          count(*) FILTER (risk = 'Moderate') AS risk_moderate, count(*) FILTER (risk = 'Not assessed') AS risk_not_assessed,
          count(*) FILTER (risk = 'Low') AS risk_low, count(*) FILTER (failed) AS failed, count(*) FILTER (running) AS running,
          count(*) FILTER (stale) AS stale, count(*) FILTER (partial) AS partial, count(*) FILTER (due) AS due,
          CAST(sum(accepted) AS BIGINT) AS accepted FROM prow GROUP BY 1"""),
    ("cross_repo_patterns", lambda t: PF.repeated_titles(audit_findings(t), t.audits), f"""WITH {LATEST_CTE},
        x AS (SELECT f.org_id, f.repo_id, title, bool_or(triage_status = 'open') AS o FROM audit_findings f JOIN latest l ON l.audit_id = f.audit_id
              WHERE kind <> 'ai_observation' AND severity IN ('critical', 'high') AND triage_status IN ('open', 'accepted_risk') GROUP BY ALL)
        SELECT org_id, title, count(*) AS repositories, count(*) FILTER (o) AS open_in FROM x GROUP BY ALL HAVING count(*) > 1"""),
    ("coverage_gaps", lambda t: PF.coverage_gaps(latest_scores(t)), f"""WITH {CATEGORY_CTES}, {LATEST_CTE}
        SELECT a.org_id, category, count(*) FILTER (NOT assessed) AS missing, count(*) AS "of" FROM category_scores c
        JOIN latest l ON l.audit_id = c.audit_id JOIN audits a ON a.audit_id = c.audit_id
        GROUP BY ALL HAVING count(*) FILTER (NOT assessed) >= 2 AND count(*) FILTER (NOT assessed) * 2 >= count(*)"""),
    ("finding_search", lambda t: FI.search(audit_findings(t), severity="high", text="issue 1").select(
        "audit_id", "emit_idx", "title"), """
        SELECT audit_id, emit_idx, title FROM audit_findings WHERE severity = 'high' AND triage_status = 'open'
          AND (title ILIKE '%issue 1%' OR file_path ILIKE '%issue 1%' OR rule_id ILIKE '%issue 1%')"""),
    ("ai_selection", lambda t: FI.ai_candidates(audit_findings(t), 2).select("audit_id", "rank", "severity", "fingerprint"),
     f"""SELECT audit_id, severity, fingerprint, row_number() OVER (PARTITION BY audit_id ORDER BY {SEV_RANK} DESC,
           CASE confidence WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END DESC, file_path, fingerprint) AS rank
         FROM audit_findings WHERE kind <> 'ai_observation' AND severity <> 'info' QUALIFY rank <= 2"""),
    ("findings_page", lambda t: FI.page(audit_findings(t), [*FI.report_order(), F.col("emit_idx")], 2, ["org_id"]).select(
        "org_id", "emit_idx", "audit_id", "rank"), f"""
        SELECT org_id, emit_idx, audit_id, row_number() OVER (PARTITION BY org_id ORDER BY {SEV_RANK} DESC, category, file_path,
          coalesce(line_start, 0), emit_idx) AS rank FROM audit_findings QUALIFY rank BETWEEN 51 AND 100"""),
]
