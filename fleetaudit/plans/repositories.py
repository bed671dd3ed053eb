"""Plans over file sets: manifests, pins, rule packs, text scans, languages."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import text as X
from ..functions import versions as VR
from ..operators import AUDIT
from ..operators import dependencies as D
from ..operators import languages as L
from ..rules import code as CODE
from ..rules import devops as DO
from ..rules import packs as PK
from ..rules import testing as TE
from ..rules import web as WEB
from ..rules import runner as RN
from ..rules.engine import Pack, Rule, applicability, packs, scan, with_snippets
from ..session import scratch_folder
from ..sources import manifests as MF
from ..sources import reports as RP
from ..sources.files import explode_lines
from ..vocab import RULE_NAMESPACE as NS

K = "CAST(repo_id AS INT)"
KC = "(SELECT c_custkey AS k, CAST(c_custkey AS STRING) AS repo_id FROM customer) cust"
LINES = ("flines AS (SELECT org_id, repo_id, path, unnest(string_split(text, chr(10))) AS text, "
         "generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM repo_files WHERE text <> '')")
DLINES = ("dlines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, "
          "generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)")


def lines(t) -> DataFrame:
    return explode_lines(t.repo_files)


def tables(t, *need: str) -> dict[str, DataFrame]:
    return PK.prepare(t.repo_files, need=need)


def _found(df: DataFrame) -> DataFrame:
    return df.select("repo_id", F.expr(f"substring(rule_id, {len(NS) + 1})").alias("rule"), "file_path", "line_start")


# One token per customer, composed from its key in both engines, so that no file holds one.
KEYED_TEXT = """concat('key: ', CASE c_custkey % 9 WHEN 0 THEN concat('AK', 'IA', upper(substr(md5(CAST(c_custkey AS STRING)), 1, 16)))
    WHEN 1 THEN concat('gh', 'p_', md5(CAST(c_custkey AS STRING)))
    WHEN 2 THEN concat('github', '_pat_', md5(CAST(c_custkey AS STRING)), md5(CAST(c_custkey AS STRING)))
    WHEN 3 THEN concat('sk-', 'ant-', md5(CAST(c_custkey AS STRING))) WHEN 4 THEN concat('xo', 'xb-', md5(CAST(c_custkey AS STRING)))
    WHEN 5 THEN concat('sk_', 'live_', md5(CAST(c_custkey AS STRING))) WHEN 6 THEN concat('AI', 'za', md5(CAST(c_custkey AS STRING)), 'abc')
    WHEN 7 THEN concat('postgres://user:', md5(CAST(c_custkey AS STRING)), '@host/db') ELSE 'nothing' END)"""


def _texts(t) -> DataFrame:
    """Every given text (documents, pages, conversation turns), and a keyed one per customer."""
    def part(df: DataFrame, name: str, key, text: str) -> DataFrame:
        return df.select(F.lit(name).alias("kind"), key.cast("string").alias("id"), F.col(text).alias("text"))

    return part(t.documents, "document", F.col("doc_id"), "text").unionByName(
        part(t.pages, "page", F.col("page_id"), "html")).unionByName(
        part(t.conversations, "turn", F.concat("conv_id", F.lit("-"), "turn"), "text")).unionByName(
        part(t.customer.withColumn("text", F.expr(KEYED_TEXT)), "key", F.col("c_custkey"), "text"))


TEXTS = f"""texts AS (SELECT 'document' AS kind, CAST(doc_id AS VARCHAR) AS id, text FROM documents
    UNION ALL SELECT 'page', CAST(page_id AS VARCHAR), html FROM pages
    UNION ALL SELECT 'turn', concat(conv_id, '-', turn), text FROM conversations
    UNION ALL SELECT 'key', CAST(c_custkey AS VARCHAR), {KEYED_TEXT} FROM customer)"""
# RE2 has no look-around; the scan patterns need none
SCAN = " OR ".join(f"regexp_matches(text, '{p.removeprefix('()')}')" for n, p in V.SECRET_PATTERNS if n not in V.REDACT_ONLY)


def _versions(t) -> DataFrame:
    version = F.concat(F.when(F.col("p_size") % 9 == 0, "x").otherwise(""), (F.col("p_size") % 5).cast("string"), F.lit("."),
                       (F.col("p_partkey") % 7).cast("string"), F.when(F.col("p_partkey") % 2 == 0, ".0").otherwise(""))
    specs = [">=2.1,<4", "==3.*", "!=3.*", "~=2.2", "==2.3", "<=1.5", ">2", "^2.0", ""]
    spec = F.get(F.array(*[F.lit(s) for s in specs]), (F.col("p_partkey") % len(specs)).cast("int"))
    return t.part.select("p_partkey", version.alias("version"), spec.alias("spec"))


def _vectors(t) -> DataFrame:
    def pick(values: str, col: str, step: int):
        return F.get(F.split(F.lit(values), ","), (F.floor(F.col(col) / step) % len(values.split(","))).cast("int"))

    vector = F.concat(
        F.lit("CVSS:3.1/AV:"), pick("N,A,L,P", "p_partkey", 1), F.lit("/AC:"), pick("L,H", "p_partkey", 4), F.lit("/PR:"),
        pick("N,L,H", "p_partkey", 8), F.lit("/UI:"), pick("N,R", "p_partkey", 24), F.lit("/S:"), pick("U,C", "p_partkey", 48),
        F.lit("/C:"), pick("H,L,N", "p_partkey", 96), F.lit("/I:"), pick("H,L,N", "p_size", 1), F.lit("/A:"),
        pick("H,L,N", "p_size", 3))
    return t.part.select("p_partkey", F.when(F.col("p_partkey") % 50 == 0, "CVSS:2.0/AV:N").otherwise(vector).alias("vector"))


def advisories(t) -> DataFrame:
    """One advisory per part, on the versions the requirement files pin."""
    key = F.col("p_partkey")
    fixed = F.concat(F.lit("9."), (key % 3).cast("string"))
    record = F.to_json(F.struct(
        F.concat(F.lit("GHSA-"), key.cast("string")).alias("id"),
        F.when(key % 2 == 0, F.array(F.lit("X-1"), F.concat(F.lit("CVE-2024-"), key.cast("string")))).otherwise(
            F.array().cast("array<string>")).alias("aliases"),
        F.concat(F.lit("Flaw in "), "p_name").alias("summary"),
        F.struct(F.when(key % 3 == 0, "HIGH").when(key % 3 == 1, "MODERATE").alias("severity")).alias("database_specific"),
        F.array(F.struct(F.lit("CVSS_V3").alias("type"), F.lit("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H").alias("score"))).alias("severity"),
        F.array(F.struct(F.array(F.struct(F.array(F.struct(F.lit("0").alias("introduced")).withField("fixed", fixed)).alias("events")))
                         .alias("ranges"))).alias("affected")))
    raw = t.part.select(
        F.lit("PyPI").alias("ecosystem"), F.when(key % 2 == 0, "PyYAML").otherwise("flask").alias("name"),
        F.when(key % 2 == 0, F.concat((F.col("p_size") % 5).cast("string"), F.lit("."), (key % 7).cast("string"))).otherwise(
            F.concat((F.col("p_size") % 4).cast("string"), F.lit(".0"))).alias("version"), record.alias("record"))
    return RP.advisories(raw)


ADV = """adv AS (SELECT concat('GHSA-', p_partkey) AS vid, CASE WHEN p_partkey % 2 = 0 THEN 'PyYAML' ELSE 'flask' END AS name,
    CASE WHEN p_partkey % 2 = 0 THEN concat(p_size % 5, '.', p_partkey % 7) ELSE concat(p_size % 4, '.0') END AS version,
    CASE WHEN p_partkey % 2 = 0 THEN concat('CVE-2024-', p_partkey) ELSE concat('GHSA-', p_partkey) END AS shown,
    CASE p_partkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'critical' END AS severity FROM part)"""
PINS = """pins AS (SELECT repo_id, 'PyPI' AS ecosystem, name, version, source FROM (
      SELECT repo_id, 'flask' AS name, '1.0' AS version, 'requirements.txt' AS source FROM cust WHERE k % 3 = 0
      UNION ALL SELECT repo_id, 'flask', '2.0', 'requirements.txt' FROM cust WHERE k % 6 = 0
      UNION ALL SELECT repo_id, 'reqeusts', '1.0', 'requirements.txt' FROM cust
      UNION ALL SELECT repo_id, 'requests', '2.1', 'requirements.txt' FROM cust
      UNION ALL SELECT repo_id, 'idna', '3.4', 'poetry.lock' FROM cust WHERE k % 7 = 0
      UNION ALL SELECT repo_id, arg_min(n, src), v, min(src) FROM (
        SELECT repo_id, 'PyYAML' AS n, concat(k % 5, '.', k % 7) AS v, 'requirements.txt' AS src FROM cust
        UNION ALL SELECT repo_id, 'pyyaml', concat(k % 4, '.', k % 7), 'requirements-dev.txt' FROM cust WHERE k % 2 = 0
        UNION ALL SELECT repo_id, 'PyYAML', concat(k % 3, '.1'), 'poetry.lock' FROM cust WHERE k % 7 = 0) GROUP BY repo_id, v)
    UNION ALL SELECT repo_id, 'npm', name, version, source FROM (
      SELECT repo_id, 'express' AS name, concat('4.', k % 9, '.0') AS version, 'package-lock.json' AS source FROM cust WHERE k % 3 = 0
      UNION ALL SELECT repo_id, 'express', '3.0.0', 'package-lock.json' FROM cust WHERE k % 3 = 0
      UNION ALL SELECT repo_id, 'express', '4.1.0', 'yarn.lock' FROM cust WHERE k % 3 = 1
      UNION ALL SELECT repo_id, '@scope/pkg', concat('1.2.', k % 6), 'yarn.lock' FROM cust WHERE k % 3 = 1
      UNION ALL SELECT repo_id, 'express', concat('4.0.', k % 5), 'pnpm-lock.yaml' FROM cust WHERE k % 3 = 2
      UNION ALL SELECT repo_id, '@s/p', concat('2.0.', k % 2), 'pnpm-lock.yaml' FROM cust WHERE k % 3 = 2))"""
CUST = "cust AS (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS repo_id FROM customer)"


def bandit_reports(t) -> DataFrame:
    """One report per audit, built from its derived findings."""
    item = F.struct(
        F.concat(F.lit("B"), (F.lit(100) + F.col("emit_idx") % 700).cast("string")).alias("test_id"),
        F.lit("some_check").alias("test_name"), F.concat(F.lit("./"), F.translate("file_path", "\\", "/")).alias("filename"),
        F.when(F.col("severity") == "critical", "HIGH").otherwise(F.upper("severity")).alias("issue_severity"),
        F.upper("confidence").alias("issue_confidence"), F.col("title").alias("issue_text"),
        F.struct(F.lit(79).alias("id"), F.lit("https://cwe/79").alias("link")).alias("issue_cwe"),
        F.lit("https://more").alias("more_info"), F.coalesce("line_start", F.lit(1)).alias("line_number"),
        F.array(F.coalesce("line_start", F.lit(1)), F.coalesce("line_start", F.lit(1)) + 2).alias("line_range"))
    rows = t.findings.filter("file_path <> ''").groupBy(*AUDIT).agg(F.collect_list(item).alias("results"))
    return rows.select(*AUDIT, F.to_json(F.struct("results")).alias("report"))


def eslint_reports(t) -> DataFrame:
    message = F.struct(
        F.when(F.col("emit_idx") % 5 == 0, F.lit(None)).when(F.col("emit_idx") % 5 == 1, "no-eval").otherwise("eqeqeq").alias("ruleId"),
        F.col("title").alias("message"), (F.col("emit_idx") % 2 + 1).cast("int").alias("severity"),
        F.coalesce("line_start", F.lit(1)).alias("line"))
    per_file = t.findings.filter("file_path <> ''").groupBy(*AUDIT, F.translate("file_path", "\\", "/").alias("filePath")).agg(
        F.collect_list(message).alias("messages"))
    return per_file.groupBy(*AUDIT).agg(F.collect_list(F.struct("filePath", "messages")).alias("r")).select(
        *AUDIT, F.to_json("r").alias("report"))


def line_reports(t, kind: str) -> DataFrame:
    """mypy (JSON lines) or tsc (text lines) output per audit."""
    path = F.translate("file_path", "\\", "/")
    if kind == "mypy":
        line = F.to_json(F.struct(
            path.alias("file"), F.coalesce("line_start", F.lit(0)).alias("line"),
            F.when(F.col("emit_idx") % 3 == 0, "note").otherwise("error").alias("severity"),
            F.when(F.col("emit_idx") % 7 == 0, "name-defined").otherwise("arg-type").alias("code"), F.col("title").alias("message")))
    else:
        line = F.concat(path, F.lit("("), F.coalesce("line_start", F.lit(1)).cast("string"), F.lit(",3): error TS"),
                        (F.lit(2300) + F.col("emit_idx") % 9).cast("string"), F.lit(": "), F.trim("title"))
    return t.findings.groupBy(*AUDIT).agg(F.array_join(F.collect_list(line), "\n").alias("report"))


PATH_SQL = "regexp_replace(replace(file_path, chr(92), '/'), '^(\\./)+', '')"
TEST_SQL = f"regexp_matches(lower({PATH_SQL}), '(^|/)tests/|(^|/)test_')"


def semgrep_reports(t) -> DataFrame:
    meta = F.struct(F.when(F.col("emit_idx") % 2 == 0, "security").otherwise("best-practice").alias("category"),
                    F.upper("confidence").alias("confidence"), F.array(F.lit("CWE-89")).alias("cwe"))
    item = F.struct(
        F.concat(F.lit("py.lang."), F.col("category")).alias("check_id"), F.translate("file_path", "\\", "/").alias("path"),
        F.struct(F.coalesce("line_start", F.lit(1)).alias("line")).alias("start"),
        F.struct(F.coalesce("line_start", F.lit(1)).alias("line")).alias("end"),
        F.struct(F.col("title").alias("message"), F.when(F.col("severity").isin("critical", "high"), "ERROR").otherwise(
            "WARNING").alias("severity"), meta.alias("metadata")).alias("extra"))
    return t.findings.groupBy(*AUDIT).agg(F.collect_list(item).alias("results")).select(
        *AUDIT, F.to_json(F.struct("results")).alias("report"))


def trivy_reports(t) -> DataFrame:
    even = F.col("emit_idx") % 2 == 0
    vuln = F.when(even, F.struct(
        F.concat(F.lit("CVE-"), F.col("emit_idx").cast("string")).alias("VulnerabilityID"), F.lit("pkg").alias("PkgName"),
        F.lit("1.0").alias("InstalledVersion"), F.upper("severity").alias("Severity")))
    mis = F.when(~even, F.struct(
        F.lit("DS002").alias("ID"), F.when(F.col("emit_idx") % 3 == 0, "PASS").otherwise("FAIL").alias("Status"),
        F.col("title").alias("Title"), F.upper("severity").alias("Severity"),
        F.struct(F.col("line_start").alias("StartLine")).alias("CauseMetadata")))
    per_file = t.findings.groupBy(*AUDIT, F.translate("file_path", "\\", "/").alias("Target")).agg(
        F.collect_list(vuln).alias("Vulnerabilities"), F.collect_list(mis).alias("Misconfigurations"))
    return per_file.groupBy(*AUDIT).agg(F.collect_list(F.struct("Target", "Vulnerabilities", "Misconfigurations")).alias("Results")).select(
        *AUDIT, F.to_json(F.struct("Results")).alias("report"))


def ruff_reports(t) -> DataFrame:
    item = F.struct(
        F.when(F.col("emit_idx") % 4 == 0, "F821").when(F.col("emit_idx") % 4 == 1, "E999").otherwise("B018").alias("code"),
        F.translate("file_path", "\\", "/").alias("filename"), F.col("title").alias("message"),
        F.struct(F.coalesce("line_start", F.lit(1)).alias("row")).alias("location"))
    return t.findings.groupBy(*AUDIT).agg(F.collect_list(item).alias("r")).select(*AUDIT, F.to_json("r").alias("report"))


def _report(df: DataFrame) -> DataFrame:
    return df.select("audit_id", "rule_id", "severity", "confidence", "kind", "file_path", "line_start")


def _near_names(t) -> DataFrame:
    """Distinct words of all documents, as package names of one ecosystem."""
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("name")
    return t.documents.select(F.lit("words").alias("ecosystem"), words).distinct()


def _popular(t) -> DataFrame:
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("name")
    rows = t.benchmark.select("item_id", words).groupBy("name").agg(F.min("item_id").alias("seq"))
    return rows.select(F.lit("words").alias("ecosystem"), "name", F.struct("seq", "name").alias("seq"))


def _reachability(t) -> DataFrame:
    """Pinned packages with advisories, judged against the imports and declarations of their repository."""
    direct = MF.python_declared(t.repo_files).select(*AUDIT, F.col("dist").alias("package"))
    pins = D.pin_reachability(MF.collect_pins(t.repo_files), D.external_imports(lines(t)), direct)
    return D.reachability(D.vulnerabilities(pins, advisories(t)))


def _registry(t) -> DataFrame:
    """Registry documents for names the repositories declare, derived from the supplier table."""
    n = F.col("s_suppkey")
    doc = F.to_json(F.struct(
        F.struct(F.concat((n % 9).cast("string"), F.lit(".1")).alias("version")).alias("info"),
        F.map_from_arrays(F.array(F.lit("1.0")), F.array(F.array(F.struct(F.concat(
            F.lit("2001-0"), (n % 9 + 1).cast("string"), F.lit("-15T00:00:00Z")).alias("upload_time_iso_8601"))))).alias("releases")))
    name = F.get(F.split(F.lit("flask,pyyaml,requests,reqeusts"), ","), (n % 4).cast("int"))
    rows = t.supplier.select(F.lit("PyPI").alias("ecosystem"), name.alias("name"), "s_suppkey",
                             F.when(n % 4 == 3, "missing").otherwise("ok").alias("status"), doc.alias("document"))
    first = rows.groupBy("ecosystem", "name").agg(F.min_by(F.struct("status", "document"), "s_suppkey").alias("d"))
    return RP.registry(first.select("ecosystem", "name", "d.status", "d.document"))


def _declared(t) -> DataFrame:
    return MF.requirement_entries(t.repo_files).select(*AUDIT, "path", F.lit("PyPI").alias("ecosystem"), X.python_package("name").alias("name")).distinct()


def _snippets(t) -> DataFrame:
    rows = lines(t)
    found = WEB.performance({"files": t.repo_files, "lines": rows}).unionByName(CODE.secrets(rows))
    return with_snippets(found.withColumn("evidence", F.lit("")), rows)


PASSWORD = Rule("password-mentioned", "Password mentioned", "security", "low", "low", "finding", "password")


def _stuck(lines: DataFrame) -> DataFrame:
    def wait(batches):
        import time

        for batch in batches:
            time.sleep(3600)
            yield batch

    return lines.mapInPandas(wait, lines.schema)


def _isolated(t) -> DataFrame:
    """Five packs over the conversations at once: one that ends well, one that breaks in a task, one that gives its reason,
    one that never ends, and one whose language does not occur."""
    files = t.conversations.select(F.lit("o").alias("org_id"), F.col("conv_id").cast("string").alias("repo_id"), F.lit("a").alias("audit_id"),
                                   F.concat(F.lit("turn-"), "turn", F.lit(".txt")).alias("path"), F.col("text"))
    tables = {"files": files, "lines": explode_lines(files)}

    def refuse(_):
        raise RN.AnalyzerError("no access with password = hunter2hunter2")

    broken = F.when(F.length("text") >= 0, F.raise_error(F.lit("broken in a task"))).otherwise(F.col("text"))
    selected = [Pack("mentions", "Mentions", ("security",), lambda x: scan(x["lines"], [PASSWORD], "mentions")),
                Pack("broken", "Broken", ("security",), lambda x: scan(x["lines"].withColumn("text", broken), [PASSWORD], "broken")),
                Pack("refused", "Refused", ("security",), refuse),
                Pack("stuck", "Stuck", ("security",), lambda x: scan(_stuck(x["lines"]), [PASSWORD], "stuck"), seconds=5),
                Pack("cobol", "Cobol", ("security",), lambda x: scan(x["lines"], [PASSWORD], "cobol"), languages=("COBOL",))]
    found, outcomes = RN.run_packs(tables, selected, scratch_folder(t.spark, "packs"))
    audits = files.select(*AUDIT).distinct()
    rows = RN.outcome_rows(audits, L.language_stats(files), selected, outcomes).groupBy("name", "status", "reason").agg(F.count("*").alias("audits"))
    counts = found.groupBy(F.col("analyzer").alias("name")).agg(F.count("*").alias("findings"))
    shown = F.when(F.col("status") == "ok", F.coalesce("findings", F.lit(0))).otherwise(0)
    return rows.join(counts, "name", "left").select("name", "status", "reason", "audits", shown.alias("findings"))


PLANS = [
    ("file_lines", lambda t: lines(t).select("repo_id", "path", "line_no", "text"),
     f"WITH {LINES} SELECT repo_id, path, line_no, text FROM flines"),
    ("language_stats", lambda t: L.language_stats(t.repo_files).select("repo_id", "lang", "files", "lines"), f"""
        WITH x AS (SELECT repo_id, text, CASE WHEN path LIKE '%.js' THEN 'javascript' WHEN path LIKE '%.ts' THEN 'typescript'
              WHEN path LIKE '%.py' THEN 'python' WHEN path = 'Dockerfile' THEN 'dockerfile' END AS lang FROM repo_files)
        SELECT repo_id, lang, count(*) AS files, CAST(sum(CASE WHEN text = '' THEN 0 ELSE
          length(text) - length(replace(text, chr(10), '')) + 1 END) AS BIGINT) AS lines FROM x WHERE lang IS NOT NULL GROUP BY ALL"""),
    ("primary_language", lambda t: L.primary_language(L.language_stats(t.repo_files)).select("repo_id", "primary"), f"""
        WITH x AS (SELECT repo_id, CASE WHEN path LIKE '%.js' THEN 'javascript' WHEN path LIKE '%.ts' THEN 'typescript' ELSE 'python' END AS lang,
          sum(CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) END) AS n FROM repo_files
          WHERE path LIKE '%.js' OR path LIKE '%.ts' OR path LIKE '%.py' GROUP BY ALL)
        SELECT repo_id, arg_min(lang, struct_pack(a := -n, b := lang)) AS "primary" FROM x GROUP BY 1"""),
    ("frameworks", lambda t: L.frameworks(t.repo_files).select("repo_id", "framework"), """
        SELECT CAST(c_custkey AS VARCHAR) AS repo_id, unnest(['flask', 'express', 'jest']) AS framework FROM customer
        UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'pytest' FROM customer WHERE c_custkey % 2 = 0"""),
    ("analyzer_outcomes", lambda t: applicability(
        t.repo_files.select(*AUDIT).distinct(), L.language_stats(t.repo_files), packs()).groupBy("name", "status").agg(
        F.count(F.lit(1)).alias("audits")), None),
    ("isolated_packs", _isolated, """
        WITH a AS (SELECT count(DISTINCT conv_id) AS audits FROM conversations),
        l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM conversations),
        o(name, status, reason) AS (VALUES ('mentions', 'ok', ''), ('broken', 'failed', 'internal analyzer error (SparkRuntimeException)'),
          ('refused', 'failed', 'no access with password = [REDACTED]'), ('stuck', 'timeout', 'took more than 5 seconds'),
          ('cobol', 'skipped', 'no COBOL files detected'))
        SELECT name, status, reason, audits, CASE status WHEN 'ok' THEN (SELECT count(*) FROM l WHERE line LIKE '%password%') ELSE 0 END AS findings
        FROM o, a"""),
    ("requirement_entries", lambda t: MF.requirement_entries(t.repo_files).select("repo_id", "path", "line_no", "name", "spec"),
     f"""WITH {LINES}, r AS (SELECT *, trim(split_part(text, '#', 1)) AS s FROM flines WHERE path LIKE 'requirements%.txt')
        SELECT repo_id, path, line_no, regexp_extract(s, '^([A-Za-z0-9][A-Za-z0-9._-]*)', 1) AS name,
          trim(split_part(regexp_replace(s, '^[A-Za-z0-9][A-Za-z0-9._-]*(\\[[^\\]]*\\])?\\s*', ''), ';', 1)) AS spec
        FROM r WHERE s <> '' AND s NOT LIKE '-%' AND NOT regexp_matches(s, 'git\\+|https?://')"""),
    ("package_json_entries", lambda t: MF.npm_registry_names(MF.package_json_entries(t.repo_files)).select(
        "repo_id", "section", "name", "registry_name"), f"""WITH {CUST}
        SELECT repo_id, 'dependencies' AS section, 'express' AS name, 'express' AS registry_name FROM cust
        UNION ALL SELECT repo_id, 'dependencies', 'left-pad', 'real-pad' FROM cust
        UNION ALL SELECT repo_id, 'dependencies', 'any', 'any' FROM cust WHERE k % 3 = 0
        UNION ALL SELECT repo_id, 'devDependencies', 'jest', 'jest' FROM cust
        UNION ALL SELECT repo_id, 'devDependencies', 'express', 'express' FROM cust WHERE k % 5 = 0"""),
    ("pinned_dependencies", lambda t: MF.collect_pins(t.repo_files).select("repo_id", "ecosystem", "name", "version", "source"),
     f"WITH {CUST}, {PINS} SELECT repo_id, ecosystem, name, version, source FROM pins"),
    ("pyproject_entries", lambda t: MF.pyproject_entries(t.repo_files).select("repo_id", "dep_group", "name", "spec", "valid"),
     f"""WITH {CUST} SELECT repo_id, CASE WHEN k % 25 = 0 THEN NULL ELSE 'dependencies' END AS dep_group,
          CASE WHEN k % 25 > 0 THEN 'pyyaml' END AS name, CASE WHEN k % 25 > 0 THEN concat('>=', k % 3, '.2') END AS spec,
          k % 25 > 0 AS valid FROM cust WHERE k % 5 = 0
        UNION ALL SELECT repo_id, 'dependencies', 'attrs', '', true FROM cust WHERE k % 5 = 0 AND k % 25 > 0"""),
    ("unpinned_requirements", lambda t: D.unpinned_requirements(t.repo_files).select(
        "repo_id", "file_path", "line_start", "severity", "evidence"), f"""WITH {CUST}
        SELECT repo_id, 'requirements.txt' AS file_path, 1 AS line_start, 'low' AS severity,
          concat('unpinned: ', CASE WHEN k % 3 = 1 THEN 'flask' ELSE 'Flask' END) AS evidence FROM cust WHERE k % 3 > 0 AND k % 7 > 0
        UNION ALL SELECT repo_id, 'requirements-dev.txt', 2, 'medium', 'unpinned: pytest, numpy, pandas, scipy' FROM cust
          WHERE k % 2 = 0 AND k % 7 > 0"""),
    ("vcs_requirements", lambda t: _found(D.vcs_requirements(t.repo_files)), f"""WITH {CUST}
        SELECT repo_id, 'dependencies.vcs-dependency' AS rule, 'requirements.txt' AS file_path, 4 AS line_start FROM cust WHERE k % 4 < 2"""),
    ("duplicate_declarations", lambda t: D.duplicate_declarations(t.repo_files).select("repo_id", "file_path", "title"), f"""
        WITH {CUST} SELECT repo_id, 'requirements.txt' AS file_path, '''flask'' is declared more than once in requirements.txt' AS title
          FROM cust WHERE k % 6 = 0
        UNION ALL SELECT repo_id, 'package.json', '''express'' is declared more than once in both dependencies and devDependencies'
          FROM cust WHERE k % 5 = 0"""),
    ("conflicting_pins", lambda t: D.python_conflicts(t.repo_files).select("repo_id", "title"), f"""WITH {CUST},
        flask AS (SELECT repo_id, '''flask'' is pinned to different versions' AS title FROM cust WHERE k % 6 = 0),
        yaml AS (SELECT repo_id, '''pyyaml'' is pinned to different versions' AS title FROM cust WHERE k % 2 = 0 AND k % 5 <> k % 4),
        p AS (SELECT repo_id, k, k % 5 AS a, k % 7 AS b, 'requirements.txt' AS f, 3 AS o FROM cust
              UNION ALL SELECT repo_id, k, k % 4, k % 7, 'requirements-dev.txt', 2 FROM cust WHERE k % 2 = 0
              UNION ALL SELECT repo_id, k, k % 3, 1, 'poetry.lock', 1 FROM cust WHERE k % 7 = 0),
        bad AS (SELECT * FROM p WHERE k % 5 = 0 AND k % 25 > 0 AND (a < k % 3 OR (a = k % 3 AND b < 2))
                QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY o) = 1)
        SELECT * FROM flask UNION ALL SELECT * FROM yaml
        UNION ALL SELECT repo_id, concat('''pyyaml'' ', a, '.', b, ' in ', f, ' violates pyproject.toml (>=', k % 3, '.2)') FROM bad"""),
    ("lockfile_drift", lambda t: D.lock_drift(t.repo_files).select("repo_id", "lock", "name"), f"""WITH {CUST},
        want AS (SELECT repo_id, k, 'express' AS name, CASE WHEN k % 5 = 0 THEN '1.0.0' ELSE concat('^', k % 4, '.0.0') END AS spec FROM cust
          UNION ALL SELECT repo_id, k, 'left-pad', 'npm:real-pad@1.0' FROM cust UNION ALL SELECT repo_id, k, 'lib', 'file:../lib' FROM cust
          UNION ALL SELECT repo_id, k, 'any', '*' FROM cust WHERE k % 3 = 0 UNION ALL SELECT repo_id, k, 'jest', '29.0.0' FROM cust)
        SELECT repo_id, 'package-lock.json' AS lock, name FROM want WHERE k % 3 = 0 AND name = 'express' AND spec <> concat('^', k % 2, '.0.0')
        UNION ALL SELECT repo_id, 'yarn.lock', name FROM want WHERE k % 3 = 1 AND name <> 'lib' AND (name <> 'express' OR k % 5 = 0)
        UNION ALL SELECT repo_id, 'pnpm-lock.yaml', name FROM want WHERE k % 3 = 2 AND NOT (name = 'express' AND spec = concat('^', k % 2, '.0.0'))"""),
    ("lockfile_rules", lambda t: D.lockfile_rules(t.repo_files).select("repo_id", "title", "evidence"), f"""WITH {CUST}
        SELECT repo_id, '1 package(s) installed in several versions (package-lock.json)' AS title,
          concat('express: 3.0.0, 4.', k % 9, '.0') AS evidence FROM cust WHERE k % 3 = 0"""),
    ("js_manifest_rules", lambda t: D.js_manifest_rules(t.repo_files).select("repo_id", "title", "evidence"), f"""WITH {CUST}
        SELECT repo_id, concat(CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END, ' dependency(ies) with wildcard or non-registry version') AS title,
          CASE WHEN k % 3 = 0 THEN 'any@*, lib@file:../lib' ELSE 'lib@file:../lib' END AS evidence FROM cust"""),
    ("unused_packages", lambda t: D.unused(t.repo_files).select("repo_id", "path", "name"), f"""WITH {CUST}
        SELECT repo_id, 'requirements.txt' AS path, 'reqeusts' AS name FROM cust
        UNION ALL SELECT repo_id, 'pyproject.toml', 'attrs' FROM cust WHERE k % 5 = 0 AND k % 25 > 0"""),
    ("dependency_hygiene", lambda t: _found(D.hygiene(t.repo_files)), None),
    ("version_satisfies", lambda t: _versions(t).select("p_partkey", VR.satisfies("version", "spec").alias("ok")), """
        WITH v AS (SELECT p_partkey, p_size % 9 = 0 AS bad, p_size % 5 AS a, p_partkey % 7 AS b, p_partkey % 9 AS s FROM part)
        SELECT p_partkey, CASE WHEN bad THEN NULL ELSE CASE s
          WHEN 0 THEN (a > 2 OR (a = 2 AND b >= 1)) AND a < 4 WHEN 1 THEN a = 3 WHEN 2 THEN a <> 3 WHEN 3 THEN a = 2 AND b >= 2
          WHEN 4 THEN a = 2 AND b = 3 WHEN 5 THEN a < 1 OR (a = 1 AND b <= 5) WHEN 6 THEN a > 2 OR (a = 2 AND b > 0)
          WHEN 7 THEN NULL ELSE true END END AS ok FROM v"""),
    ("cvss_scores", lambda t: _vectors(t).select("p_partkey", F.round(VR.cvss3_base_score("vector") * 10).cast("int").alias("score10")), """
        WITH v AS (SELECT p_partkey AS p, [0.85, 0.62, 0.55, 0.2][p_partkey % 4 + 1] AS av, [0.77, 0.44][p_partkey // 4 % 2 + 1] AS ac,
            p_partkey // 8 % 3 AS pr, [0.85, 0.62][p_partkey // 24 % 2 + 1] AS ui, p_partkey // 48 % 2 = 1 AS ch,
            [0.56, 0.22, 0.0][p_partkey // 96 % 3 + 1] AS c, [0.56, 0.22, 0.0][p_size % 3 + 1] AS i, [0.56, 0.22, 0.0][p_size // 3 % 3 + 1] AS a FROM part),
        w AS (SELECT p, ch, 8.22::DOUBLE * av * ac * CASE WHEN pr = 0 THEN 0.85 WHEN pr = 1 THEN CASE WHEN ch THEN 0.68 ELSE 0.62 END
                ELSE CASE WHEN ch THEN 0.5 ELSE 0.27 END END * ui AS e, 1::DOUBLE - (1 - c) * (1 - i) * (1 - a) AS s FROM v),
        x AS (SELECT p, ch, e, CASE WHEN ch THEN 7.52::DOUBLE * (s - 0.029) - 3.25 * pow(s - 0.02, 15) ELSE 6.42::DOUBLE * s END AS m FROM w)
        SELECT p AS p_partkey, CASE WHEN p % 50 = 0 THEN NULL WHEN m <= 0 THEN 0 ELSE
          CAST(ceil(round(least(CASE WHEN ch THEN 1.08::DOUBLE ELSE 1 END * (m + e), 10) * 100000) / 10000) AS INT) END AS score10 FROM x"""),
    ("pins_vs_advisories", lambda t: D.vulnerabilities(MF.collect_pins(t.repo_files), advisories(t)).select(
        "repo_id", "rule_id", "severity", "title", "file_path"), f"""WITH {CUST}, {PINS}, {ADV}
        SELECT repo_id, concat('vuln:', shown) AS rule_id, severity, concat(p.name, ' ', p.version, ': ', shown) AS title, source AS file_path
        FROM pins p JOIN adv ON adv.name = p.name AND adv.version = p.version AND p.ecosystem = 'PyPI'"""),
    ("reachability", lambda t: _reachability(t).select("repo_id", "rule_id", "title", "reachability", "confidence"), f"""
        WITH {CUST}, {PINS}, {ADV}
        SELECT repo_id, concat('vuln:', shown) AS rule_id, concat(p.name, ' ', p.version, ': ', shown) AS title,
          CASE WHEN lower(p.name) = 'pyyaml' THEN 'imported' ELSE 'not-imported' END AS reachability,
          CASE WHEN lower(p.name) = 'pyyaml' THEN 'high' ELSE 'medium' END AS confidence
        FROM pins p JOIN adv ON adv.name = p.name AND adv.version = p.version AND p.ecosystem = 'PyPI'"""),
    ("registry_checks", lambda t: D.registry_findings(_declared(t), _registry(t), "2001-05-01").select("repo_id", "file_path", "title"), f"""
        WITH {CUST}, reg AS (SELECT s_suppkey % 4 AS c, min(s_suppkey) AS n FROM supplier GROUP BY 1),
        d AS (SELECT r.c, r.n, 31 * 0 AS z, date_diff('day', make_date(2001, CAST(n % 9 + 1 AS INT), 15), DATE '2001-05-01') AS age FROM reg r)
        SELECT repo_id, 'requirements.txt' AS file_path, 'Dependency ''reqeusts'' does not exist on PyPI' AS title FROM cust
        UNION ALL SELECT repo_id, f, concat('Dependency ''', CASE c WHEN 0 THEN 'flask' WHEN 1 THEN 'pyyaml' ELSE 'requests' END,
          ''' was first published ', greatest(age, 0), ' day(s) ago')
        FROM d JOIN (SELECT repo_id, k, 'requirements.txt' AS f FROM cust UNION ALL SELECT repo_id, k, 'requirements-dev.txt' FROM cust WHERE k % 2 = 0) x
          ON f = 'requirements.txt' OR c = 1 WHERE c < 3 AND age < 30"""),
    ("outdated", lambda t: D.outdated(MF.collect_pins(t.repo_files).withColumn("name", F.lower("name")), _registry(t)).select(
        "repo_id", "file_path", "title"), f"""WITH {CUST}, {PINS},
        reg AS (SELECT CASE s_suppkey % 4 WHEN 0 THEN 'flask' WHEN 1 THEN 'pyyaml' ELSE 'requests' END AS name, min(s_suppkey) % 9 AS mj
                FROM supplier WHERE s_suppkey % 4 < 3 GROUP BY 1)
        SELECT repo_id, source AS file_path, concat(count(*), ' dependency(ies) are major versions behind') AS title
        FROM pins p JOIN reg ON reg.name = lower(p.name) AND p.ecosystem = 'PyPI'
        WHERE CASE WHEN CAST(split_part(version, '.', 1) AS INT) > 0 OR mj > 0 THEN mj > CAST(split_part(version, '.', 1) AS INT)
              ELSE 1 > CAST(split_part(version, '.', 2) AS INT) END GROUP BY ALL"""),
    ("undeclared_imports", lambda t: D.undeclared_imports(lines(t), t.repo_files, sorted(sys.stdlib_module_names)).select(
        "repo_id", "file_path", "line_start", "title"), f"""WITH {CUST}
        SELECT repo_id, 'app/services.py' AS file_path, 2 AS line_start, 'Import of undeclared package ''boto3''' AS title FROM cust WHERE k % 3 = 0
        UNION ALL SELECT repo_id, 'app/models.py', 1, 'Import of undeclared package ''sqlalchemy''' FROM cust
        UNION ALL SELECT repo_id, 'src/util.ts', 3, 'Import of undeclared package ''lodash''' FROM cust"""),
    ("lookalike_names", lambda t: D.lookalikes(_near_names(t), _popular(t)).select("name", "target"), """
        WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS name FROM documents),
          p AS (SELECT name, min(item_id) AS seq FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS name FROM benchmark) GROUP BY name),
          asked AS (SELECT name, CASE WHEN length(name) < 10 THEN 1 ELSE 2 END AS edits FROM w WHERE length(name) >= 5 AND name NOT IN (SELECT name FROM p)),
          met AS (SELECT a.name, a.edits, p.name AS target, p.seq FROM asked a JOIN p ON left(a.name, 1) = left(p.name, 1)
            UNION SELECT a.name, a.edits, p.name, p.seq FROM asked a JOIN p ON right(a.name, 1) = right(p.name, 1))
        SELECT name, target FROM met WHERE abs(length(name) - length(target)) <= edits AND damerau_levenshtein(name, target) <= edits
        QUALIFY row_number() OVER (PARTITION BY name ORDER BY seq, target) = 1"""),
    ("secret_scan", lambda t: _texts(t).filter(X.contains_secret("text")).select("kind", "id"),
     f"WITH {TEXTS} SELECT kind, id FROM texts WHERE {SCAN}"),
    ("redact_text", lambda t: _texts(t).select("kind", "id", X.redact("text").alias("masked")).filter(
        F.col("masked").contains(V.REDACTED)), None),
    ("repository_secrets", lambda t: _found(CODE.secrets(lines(t))), f"""WITH {CUST}
        SELECT repo_id, 'secrets.aws-access-key' AS rule, 'app/services.py' AS file_path, 4 AS line_start FROM cust WHERE k % 9 = 0"""),
    ("placeholders", lambda t: _found(CODE.placeholders(lines(t))), f"""WITH {CUST}
        SELECT repo_id, 'ai-code.placeholder-logic' AS rule, 'src/util.ts' AS file_path, 2 AS line_start FROM cust WHERE k % 4 = 0"""),
    ("js_tests", lambda t: _found(CODE.js_tests(t.repo_files)), f"""WITH {CUST}
        SELECT repo_id, 'ai-code.tautological-assertion' AS rule, 'tests/server.test.js' AS file_path, 2 AS line_start FROM cust WHERE k % 4 = 0
        UNION ALL SELECT repo_id, 'ai-code.tests-without-expect', 'tests/server.test.js', 1 FROM cust WHERE k % 4 = 2"""),
    ("duplicate_blocks", lambda t: CODE.duplicate_windows(t.doc_files).groupBy("org_id", "repo_id", "hash").agg(
        F.count(F.lit(1)).alias("copies")).filter("copies > 1").select(F.col("org_id").alias("lang"), F.col("repo_id").alias("source"), "hash", "copies"),
     f"""WITH {DLINES}, n AS (SELECT doc_id, line_no, trim(regexp_replace(text, '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+', ' ', 'g')) AS s FROM dlines),
        kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS rn FROM n WHERE length(s) > 3
                 AND NOT regexp_matches(s, '^(import |from |#|//|\\}}|\\)|\\])')),
        w AS (SELECT doc_id, list(s) OVER (PARTITION BY doc_id ORDER BY rn ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS l FROM kept),
        h AS (SELECT DISTINCT doc_id, sha1(array_to_string(l, chr(10))) AS hash FROM w WHERE len(l) = 12)
        SELECT lang, source, hash, count(*) AS copies FROM h JOIN documents USING (doc_id) GROUP BY ALL HAVING count(*) > 1"""),
    ("maintainability_rules", lambda t: _found(CODE.maintainability(tables(t))), f"""WITH {CUST}
        SELECT repo_id, 'maintainability.swallowed-exception' AS rule, 'src/server.js' AS file_path,
          CAST(7 + CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END AS INT) AS line_start FROM cust WHERE k % 5 = 0
        UNION ALL SELECT repo_id, 'maintainability.no-readme', '', NULL FROM cust WHERE k % 3 = 0
        UNION ALL SELECT repo_id, 'maintainability.thin-readme', 'README.md', NULL FROM cust WHERE k % 3 = 1"""),
    ("dockerfile_rules", lambda t: _found(DO.scan(lines(t), DO.DOCKER_LINES, "devops").unionByName(DO.dockerfiles(t.repo_files))),
     f"""WITH {CUST}, d AS (SELECT *, CASE WHEN k % 3 = 2 THEN 5 ELSE 1 END AS last,
            4 + CASE WHEN k % 3 = 2 THEN 1 ELSE 0 END AS u, CASE WHEN k % 4 < 2 THEN 1 ELSE 0 END AS us, CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS h FROM cust)
        SELECT repo_id, 'devops.dockerfile-unpinned-base' AS rule, 'Dockerfile' AS file_path, 1 AS line_start FROM d WHERE k % 3 <> 1
        UNION ALL SELECT repo_id, 'devops.dockerfile-secret-in-env', 'Dockerfile', 2 FROM d WHERE k % 4 = 1
        UNION ALL SELECT repo_id, 'devops.dockerfile-curl-pipe-shell', 'Dockerfile', 3 FROM d WHERE k % 5 = 1
        UNION ALL SELECT repo_id, 'devops.dockerfile-add-url', 'Dockerfile', 4 FROM d WHERE k % 6 = 1
        UNION ALL SELECT repo_id, 'devops.dockerfile-runs-as-root', 'Dockerfile', last FROM d WHERE k % 4 <> 1
        UNION ALL SELECT repo_id, 'devops.dockerfile-no-healthcheck', 'Dockerfile', NULL FROM d WHERE k % 2 = 1
        UNION ALL SELECT repo_id, 'devops.dev-server-in-production', 'Dockerfile', CAST(u + us + h + 1 AS INT) FROM d WHERE k % 7 = 0"""),
    ("compose_rules", lambda t: _found(DO.scan(lines(t), DO.COMPOSE_LINES, "devops").unionByName(DO.compose_limits(t.repo_files))),
     f"""WITH {CUST} SELECT repo_id, 'devops.compose-db-port-exposed' AS rule, 'docker-compose.yml' AS file_path, 4 AS line_start FROM cust
          WHERE k % 2 = 1 AND k % 3 = 0
        UNION ALL SELECT repo_id, 'devops.compose-privileged', 'docker-compose.yml', 6 FROM cust WHERE k % 2 = 1 AND k % 5 = 0
        UNION ALL SELECT repo_id, 'devops.compose-no-resource-limits', 'docker-compose.yml', 2 FROM cust WHERE k % 2 = 1"""),
    ("workflow_rules", lambda t: _found(DO.workflows(t.repo_files)), f"""WITH {CUST}
        SELECT repo_id, 'devops.gha-default-permissions' AS rule, '.github/workflows/ci.yml' AS file_path, CAST(NULL AS INT) AS line_start FROM cust WHERE k % 3 <> 2
        UNION ALL SELECT repo_id, 'devops.gha-unpinned-actions', '.github/workflows/ci.yml', 9 FROM cust WHERE k % 3 <> 2 AND k % 7 = 0"""),
    ("job_closure", lambda t: DO.workflow_jobs(t.repo_files).select("repo_id", "name", F.array_join("closure", ",").alias("closure")),
     f"""WITH RECURSIVE {CUST}, wf AS (SELECT * FROM cust WHERE k % 3 <> 2),
        job AS (SELECT repo_id, unnest(['test', 'build', 'deploy']) AS name FROM wf),
        need AS (SELECT repo_id, 'build' AS a, 'test' AS b FROM wf UNION ALL SELECT repo_id, 'deploy', 'build' FROM wf WHERE k % 4 > 0),
        reach AS (SELECT repo_id, a, b FROM need UNION SELECT r.repo_id, r.a, n.b FROM reach r JOIN need n ON n.repo_id = r.repo_id AND n.a = r.b)
        SELECT j.repo_id, j.name, coalesce(string_agg(b, ',' ORDER BY b), '') AS closure FROM job j
        LEFT JOIN reach r ON r.repo_id = j.repo_id AND r.a = j.name GROUP BY ALL"""),
    ("deployment_rules", lambda t: _found(DO.deployment(t.repo_files)), f"""WITH {CUST}, wf AS (SELECT * FROM cust WHERE k % 3 <> 2)
        SELECT repo_id, 'devops.deploy-without-test-gate' AS rule, '.github/workflows/ci.yml' AS file_path, 6 AS line_start FROM wf
          WHERE k % 2 = 1 OR k % 4 = 0
        UNION ALL SELECT repo_id, unnest(['devops.no-environment-separation', 'devops.no-rollback-strategy']), '.github/workflows/ci.yml', 6 FROM wf"""),
    ("pipeline_presence", lambda t: _found(DO.pipeline_presence(t.repo_files)), f"""WITH {CUST}
        SELECT repo_id, 'devops.no-ci' AS rule, '' AS file_path, CAST(NULL AS INT) AS line_start FROM cust WHERE k % 3 = 2
        UNION ALL SELECT repo_id, 'devops.ci-no-tests', '.github/workflows/ci.yml', NULL FROM cust WHERE k % 3 <> 2 AND k % 2 = 1
        UNION ALL SELECT repo_id, 'devops.missing-dockerignore', '', NULL FROM cust"""),
    ("api_rules", lambda t: _found(WEB.api_security(tables(t, "frameworks"))), f"""WITH {CUST}
        SELECT repo_id, 'api.cors-wildcard' AS rule, 'src/server.js' AS file_path, 3 AS line_start FROM cust WHERE k % 3 = 0
        UNION ALL SELECT repo_id, 'api.tls-verify-disabled', 'src/server.js', 4 FROM cust WHERE k % 4 = 0
        UNION ALL SELECT repo_id, 'api.express-no-helmet', '', NULL FROM cust"""),
    ("configuration_rules", lambda t: _found(WEB.configuration(tables(t, "frameworks"))), f"""WITH {CUST}
        SELECT repo_id, 'config.hardcoded-endpoint' AS rule, 'src/server.js' AS file_path, CAST(7 + CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END AS INT) AS line_start
        FROM cust WHERE k % 6 = 0"""),
    ("routes", lambda t: TE.routes(t.repo_files).select("repo_id", "path", "line_no", "verb", "route"), f"""WITH {CUST}
        SELECT repo_id, 'src/server.js' AS path, CAST(4 + CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END AS INT) AS line_no, 'POST' AS verb,
          '/payments/:id' AS route FROM cust"""),
    ("api_design_rules", lambda t: TE.api_design(tables(t)).select("repo_id", "title"), f"""WITH {CUST}
        SELECT repo_id, 'Payment or order endpoint without idempotency: POST /payments/:id' AS title FROM cust"""),
    ("testing_rules", lambda t: _found(TE.testing(tables(t, "profile"))).select("repo_id", "rule", "file_path"), f"""WITH {CUST}
        SELECT repo_id, 'testing.no-tests' AS rule, '' AS file_path FROM cust WHERE k % 2 = 1
        UNION ALL SELECT repo_id, 'testing.npm-default-test-script', 'package.json' FROM cust WHERE k % 8 = 0
        UNION ALL SELECT repo_id, 'testing.missing-api-tests', 'src/server.js' FROM cust WHERE k % 2 = 0"""),
    ("test_ratio", lambda t: TE.test_ratio(TE.code_sizes(t.repo_files)).select(
        "repo_id", "source_lines", "test_lines", "tests", "sources"), f"""WITH {LINES},
        c AS (SELECT repo_id, path LIKE 'tests/%' AS t, count(*) FILTER (trim(text) <> '') AS n, count(DISTINCT path) AS f FROM flines
              WHERE path LIKE '%.py' OR path LIKE '%.js' OR path LIKE '%.ts' GROUP BY ALL)
        SELECT repo_id, CAST(sum(n) FILTER (NOT t) AS BIGINT) AS source_lines, CAST(coalesce(sum(n) FILTER (t), 0) AS BIGINT) AS test_lines,
          CAST(coalesce(sum(f) FILTER (t), 0) AS BIGINT) AS tests, CAST(sum(f) FILTER (NOT t) + 1 AS BIGINT) AS sources FROM c GROUP BY 1"""),
    ("observability_rules", lambda t: _found(packs(["observability"])[0].run(tables(t, "frameworks"))), f"""WITH {CUST}
        SELECT repo_id, unnest(['devops.no-health-endpoint', 'devops.no-metrics', 'devops.no-error-tracking', 'devops.no-tracing',
          'devops.no-request-id']) AS rule, '' AS file_path, CAST(NULL AS INT) AS line_start FROM cust
        UNION ALL SELECT repo_id, 'devops.print-logging', 'src/server.js', CAST(5 + CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END AS INT) FROM cust"""),
    ("app_profile", lambda t: L.app_profile(t.repo_files).select("repo_id", "aspect", "name", "path"), None),
    ("check_applicability", lambda t: L.check_applicability(
        L.app_profile(t.repo_files), t.repo_files.select(*AUDIT).distinct()).select("repo_id", "check", "applies", "reason"), None),
    ("evidence_snippets", lambda t: _snippets(t).select("repo_id", "file_path", "line_start", "evidence"), None),
    ("bandit_report", lambda t: _report(RP.bandit(bandit_reports(t))), f"""
        SELECT audit_id, concat('bandit:B', 100 + emit_idx % 700) AS rule_id, CASE WHEN {TEST_SQL} THEN 'low'
            WHEN severity IN ('critical', 'high') THEN 'high' WHEN severity = 'medium' THEN 'medium' ELSE 'low' END AS severity, confidence,
          CASE WHEN confidence = 'high' AND 100 + emit_idx % 700 IN (201, 501, 502, 503, 504, 505, 507, 413) THEN 'confirmed' ELSE 'potential' END AS kind,
          {PATH_SQL} AS file_path, coalesce(line_start, 1) AS line_start FROM findings WHERE file_path <> ''"""),
    ("ruff_report", lambda t: _report(RP.ruff(ruff_reports(t))), f"""
        SELECT audit_id, concat('ruff:', CASE emit_idx % 4 WHEN 0 THEN 'F821' WHEN 1 THEN 'E999' ELSE 'B018' END) AS rule_id,
          CASE emit_idx % 4 WHEN 0 THEN 'medium' WHEN 1 THEN 'high' ELSE 'low' END AS severity, 'high' AS confidence, 'confirmed' AS kind,
          {PATH_SQL} AS file_path, coalesce(line_start, 1) AS line_start FROM findings"""),
    ("semgrep_report", lambda t: RP.semgrep(semgrep_reports(t)).select("audit_id", "rule_id", "category", "severity", "confidence", "kind",
                                                                        "line_start", "description"), """
        SELECT audit_id, concat('semgrep:py.lang.', category) AS rule_id,
          CASE WHEN emit_idx % 2 = 0 OR category = 'security' THEN 'security' ELSE 'maintainability' END AS category,
          CASE WHEN severity IN ('critical', 'high') THEN 'high' ELSE 'medium' END AS severity, confidence,
          CASE WHEN confidence = 'high' THEN 'confirmed' ELSE 'potential' END AS kind, coalesce(line_start, 1) AS line_start,
          concat(title, ' (CWE-89)') AS description FROM findings"""),
    ("trivy_report", lambda t: RP.trivy(trivy_reports(t)).select("audit_id", "rule_id", "severity", "category", "file_path", "line_start"), f"""
        SELECT audit_id, CASE WHEN emit_idx % 2 = 0 THEN concat('vuln:CVE-', emit_idx) ELSE 'trivy:DS002' END AS rule_id,
          CASE WHEN severity = 'info' THEN 'low' ELSE severity END AS severity,
          CASE WHEN emit_idx % 2 = 0 THEN 'dependencies' ELSE 'devops' END AS category, {PATH_SQL} AS file_path,
          CASE WHEN emit_idx % 2 = 1 THEN line_start END AS line_start
        FROM findings WHERE emit_idx % 2 = 0 OR emit_idx % 3 <> 0"""),
    ("mypy_report", lambda t: _report(RP.mypy(line_reports(t, "mypy"))), f"""
        SELECT audit_id, 'mypy:arg-type' AS rule_id, 'medium' AS severity, 'medium' AS confidence, 'potential' AS kind,
          {PATH_SQL} AS file_path, line_start FROM findings WHERE emit_idx % 3 <> 0 AND emit_idx % 7 <> 0 AND line_start >= 1"""),
    ("tsc_report", lambda t: _report(RP.tsc(line_reports(t, "tsc"))), f"""
        SELECT audit_id, concat('tsc:TS', 2300 + emit_idx % 9) AS rule_id, 'medium' AS severity, 'medium' AS confidence, 'potential' AS kind,
          {PATH_SQL} AS file_path, coalesce(line_start, 1) AS line_start FROM findings WHERE emit_idx % 9 NOT IN (4, 7) AND file_path <> '' AND trim(title) <> ''"""),
    ("eslint_report", lambda t: _report(RP.eslint(eslint_reports(t))), f"""
        SELECT audit_id, CASE emit_idx % 5 WHEN 0 THEN 'eslint:parse-error' WHEN 1 THEN 'eslint:no-eval' ELSE 'eslint:eqeqeq' END AS rule_id,
          CASE WHEN emit_idx % 5 = 0 THEN 'low' WHEN emit_idx % 5 = 1 THEN 'high' WHEN emit_idx % 2 = 1 THEN 'medium' ELSE 'low' END AS severity,
          CASE WHEN emit_idx % 5 = 0 THEN 'low' ELSE 'high' END AS confidence, CASE WHEN emit_idx % 5 = 0 THEN 'potential' ELSE 'confirmed' END AS kind,
          {PATH_SQL} AS file_path, coalesce(line_start, 1) AS line_start FROM findings WHERE file_path <> ''"""),
]
