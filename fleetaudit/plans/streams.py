"""Streaming plans: the events table is read as a stream, written with exactly-once output and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import AUDIT
from ..operators import ai as AI
from ..session import scratch_folder
from ..sources import documents as DOC
from ..sources import sinks as SK
from ..streaming import jobs as J
from .core import SEV_RANK
from .governance import COMPLIANCE_CTES, CONTROL_SELECT, TODAY, audit_findings, mapped

ORG = "3"
NOW = TODAY + " 12:00:00"


def _scratch(t) -> str:
    return scratch_folder(t.spark, "stream")


def event_stream(t) -> DataFrame:
    rows = t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/events*.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _stamp(col: str):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


def hits(events: DataFrame) -> DataFrame:
    return events.select("ts", F.col("event_type").alias("scope"), F.col("user_id").cast("string").alias("ident"))


def finished(events: DataFrame) -> DataFrame:
    """Finished audits read out of the events: one branch per user, score from the value."""
    return events.select(
        F.lit("org").alias("org_id"), F.col("user_id").cast("string").alias("repo_id"), F.lit("main").alias("branch"),
        F.col("event_id").cast("string").alias("audit_id"), "ts",
        F.when(F.col("event_type") == "error", "failed").otherwise("succeeded").alias("status"),
        F.lit(None).cast("int").alias("pr_number"), F.floor(F.col("value")).cast("double").alias("score"),
        (F.col("event_id") % 11 == 0).cast("long").alias("new_severe"), (F.col("event_id") % 3 > 0).alias("gate_passed"))


def deliveries(events: DataFrame) -> DataFrame:
    n = F.col("event_id")
    kind = F.get(F.split(F.lit("push,pull_request,check_run,ping,installation,release"), ","), (n % 6).cast("int"))
    action = F.get(F.split(F.lit("opened,closed,rerequested,synchronize,labeled"), ","), (n % 5).cast("int"))
    return events.select("ts", kind.alias("event"), action.alias("action"), (F.col("user_id") % 7).cast("string").alias("org_id"),
                         F.col("user_id").cast("string").alias("repo_id"), F.col("event_type").alias("sha"), F.lit(0).alias("pr"))


def changes(events: DataFrame) -> DataFrame:
    status = F.when(F.col("event_type") == "click", "running").when(F.col("event_type") == "view", "queued").otherwise("succeeded")
    return events.select(F.lit("org").alias("org_id"), F.col("user_id").cast("string").alias("audit_id"), "ts", status.alias("status"))


def activity(events: DataFrame) -> DataFrame:
    return events.select(F.lit("org").alias("org_id"), F.col("user_id").cast("string").alias("audit_id"),
                         F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("msg"))


def reported(events: DataFrame) -> DataFrame:
    return events.select(F.lit("org").alias("org_id"), F.col("user_id").cast("string").alias("repo_id"), F.concat_ws(
        ":", "event_type", (F.col("event_id") % 5).cast("string")).alias("fingerprint"), "ts")


def _tail(t) -> DataFrame:
    folder = _scratch(t)
    tail = J.ActivityTail(t.spark, folder)
    stream = activity(event_stream(t))
    J.run_batches(stream, folder, tail.merge)
    return tail.read(stream.schema).select("audit_id", "seq", "msg")


def _first_seen(t) -> DataFrame:
    folder = _scratch(t)
    table = J.FirstSeen(t.spark, folder)
    J.run_batches(reported(event_stream(t)), folder, table.merge)
    return table.read().select("repo_id", "fingerprint", _stamp("first_seen_at").alias("first_seen_at"))


def _gauge(t) -> DataFrame:
    delta = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", -1).otherwise(0).cast("long")
    stream = J.active_gauge(event_stream(t).select((F.col("user_id") % 7).cast("string").alias("org_id"), delta.alias("delta")), 5)
    folder = _scratch(t)
    schema = stream.schema
    last = {}

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/gauge/epoch={epoch}")
        last["path"] = f"{folder}/gauge/epoch={epoch}"

    J.run_batches(stream, folder, keep, "complete")
    return t.spark.read.schema(schema).parquet(last["path"])


def _decisions(t) -> DataFrame:
    """Events about the audit of their number, odd ones about its first finding."""
    key = F.col("event_id").cast("string")
    events = t.events.select(
        F.col("ts").alias("created_at"), F.col("event_type").alias("action"), F.col("user_id").cast("string").alias("actor"),
        key.alias("audit_id"), F.when(F.col("event_id") % 2 == 1, F.concat(F.lit("f-"), key, F.lit("-1"))).otherwise(key).alias("target_id"),
        F.col("props").alias("details"))
    runs = t.audits.select(*AUDIT)
    events = events.join(runs.select("org_id", "audit_id"), "audit_id").drop("audit_id")
    found = audit_findings(t).select(*AUDIT, F.concat(F.lit("f-"), F.col("audit_id"), F.lit("-"), F.col("emit_idx").cast("string")).alias("finding_id"))
    return SK.decisions_csv(events, found, runs)


def _report(t) -> DataFrame:
    """The report lines, read back from their JSON."""
    lines = SK.report_lines(audit_findings(t), t.audits).withColumn("j", F.from_json(
        "value", "branch string, count int, rule_id string, fingerprint string, title string, severity string, file_path string, "
                 "line_start int, triage_status string"))
    return lines.select("audit_id", "section", "rank", "j.branch", F.col("j.count").alias("n"), "j.rule_id", "j.fingerprint", "j.title",
                        "j.severity", "j.file_path", "j.line_start", "j.triage_status")


def _channels(t) -> DataFrame:
    """Two channels of the events' organization, one of them not enabled, and one of each nation's."""
    rows = t.nation.select(F.col("n_name").alias("org_id"), F.concat(F.lit("c-"), "n_nationkey").alias("channel_id"), F.lit("email").alias("kind"),
                           F.array(F.lit("audit.failed")).alias("events"), F.lit(True).alias("enabled"))
    own = t.region.select(F.lit("org").alias("org_id"), F.concat(F.lit("r-"), "r_regionkey").alias("channel_id"),
                          F.when(F.col("r_regionkey") % 2 == 0, "slack").otherwise("webhook").alias("kind"),
                          F.when(F.col("r_regionkey") < 2, F.array(F.lit("audit.failed"), F.lit("gate.failed"))).otherwise(F.array(F.lit("audit.regressed"))).alias("events"),
                          (F.col("r_regionkey") != 3).alias("enabled"))
    return rows.unionByName(own)


def _alert_deliveries(t) -> DataFrame:
    folder = _scratch(t)
    desk = J.FanOut(_channels(t), folder)
    J.run_batches(J.audit_alerts(finished(event_stream(t))), folder, desk.merge)
    return desk.deliveries(J.ALERT + ", channel_id string, kind string").select("repo_id", "audit_id", "event", "channel_id", "kind")


def _late_rows(t) -> DataFrame:
    """The events in four triggers by their number, so that many come after later ones."""
    folder = _scratch(t)
    late = J.LateRows(t.spark, folder)
    names = ["event_id", "ts", "user_id"]
    for part in range(4):
        t.events.where(F.col("event_id") % 4 == part).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id").coalesce(1).write.mode(
            "append").parquet(f"{folder}/in")
        schema = t.spark.read.parquet(f"{folder}/in").select(*names).schema
        J.run_batches(t.spark.readStream.schema(schema).parquet(f"{folder}/in"), folder, late.merge)
    kept = late.read("event_id long, ts timestamp, user_id long", late=True)
    told = late.marks().agg(F.sum("late")).first()[0]
    return kept.groupBy("user_id").agg(F.count("*").alias("late"), F.max("event_id").alias("last")).withColumn("told", F.lit(told))


def _tenant_findings(t) -> DataFrame:
    """All findings in monthly batches, the even months twice; read back for one organization."""
    folder = scratch_folder(t.spark, "findings")
    runs = t.audits.select("org_id", "audit_id", F.date_format("created_at", "yyyy-MM").alias("batch"))
    found = audit_findings(t)
    SK.write_findings(found, runs, folder)
    SK.write_findings(found, runs.where(F.substring("batch", 6, 2).cast("int") % 2 == 0), folder)
    schema = "audit_id string, rule_id string, severity string, title string, org_id string, batch string"
    return SK.read_findings(t.spark, folder, schema, ORG).groupBy("audit_id", "batch").agg(F.count("*").alias("findings"), F.max("title").alias("title"))


def _sarif_files(t) -> DataFrame:
    """The SARIF file of every audit, read back."""
    folder = scratch_folder(t.spark, "sarif")
    DOC.write_sarif(audit_findings(t), t.audits, folder)
    rows = DOC.read_documents(t.spark, folder, "version string, runs array<struct<tool: struct<driver: struct<rules: array<struct<id: string>>>>, "
                              "results: array<struct<ruleId: string, level: string>>>>")
    run = F.get("document.runs", F.lit(0))
    return rows.select(F.regexp_extract("path", "([^/]+)[.]sarif$", 1).alias("audit_id"), F.col("document.version").alias("version"),
                       F.size(run["tool"]["driver"]["rules"]).alias("rules"), F.size(run["results"]).alias("results"),
                       F.size(F.filter(run["results"], lambda r: r["level"] == "error")).alias("errors"))


def _report_files(t) -> DataFrame:
    """The JSON report of every audit, read back."""
    folder = scratch_folder(t.spark, "reports")
    DOC.write_reports(audit_findings(t), t.audits, folder)
    rows = DOC.read_documents(t.spark, folder, "audit_id string, branch string, count int, findings array<struct<rule_id: string, severity: string>>")
    return rows.select("document.audit_id", "document.branch", F.col("document.count").alias("n"), F.size("document.findings").alias("listed"),
                       F.get("document.findings", F.lit(0))["severity"].alias("worst"))


def _responses(t) -> DataFrame:
    """Model answers for every request batch, derived from the payload ids: unknown, repeated and empty ones mixed in."""
    batches = AI.request_batches(audit_findings(t), 4, 2)
    item = lambda i, text: F.struct(i.alias("id"), text.alias("explanation"))
    answers = F.concat(
        F.transform("ids", lambda i: item(i, F.concat(F.lit("About "), i, F.lit(" password = hunter22")))),
        F.transform("ids", lambda i: item(i, F.lit("again"))), F.array(item(F.lit("F99"), F.lit("unknown"))))
    return batches.select(*AUDIT, "batch", "ids", F.to_json(F.struct(answers.alias("explanations"))).alias("response"))


def _explained(t) -> DataFrame:
    rows = _responses(t)
    return AI.explanations(rows.select(*AUDIT, "batch", "response"), rows.select(*AUDIT, "batch", F.explode("ids").alias("id")))


def _assistant(t) -> DataFrame:
    """Assistant turns read as summary responses; nothing in them is trusted."""
    return t.conversations.filter("role = 'assistant'").select(
        F.lit("o").alias("org_id"), F.col("conv_id").cast("string").alias("repo_id"), F.col("turn").cast("string").alias("audit_id"),
        F.to_json(F.struct(F.lit("s").alias("summary"), F.array(
            F.struct(F.substring("text", 1, 50).alias("title"), F.col("text").alias("description"), F.lit("security").alias("category"),
                     F.lit("src/x.py").alias("file_path")),
            F.struct(F.lit("t").alias("title"), F.lit("d").alias("description"), F.lit("nonsense").alias("category"), F.lit("").alias("file_path")))
            .alias("observations"))).alias("response"))


ALERT_SQL = """
    WITH f AS (SELECT CAST(user_id AS VARCHAR) AS repo_id, CAST(event_id AS VARCHAR) AS audit_id, ts, event_type = 'error' AS bad,
                 floor(value) AS score, event_id % 11 = 0 AS severe, event_id % 3 > 0 AS passed FROM events
               WHERE time_bucket(INTERVAL '1 minute', ts) + INTERVAL '1 minute' < (SELECT max(ts) - INTERVAL '10 minutes' FROM events)),
    g AS (SELECT *, lag(score) OVER w AS before, lag(passed) OVER w AS was FROM f WHERE NOT bad WINDOW w AS (PARTITION BY repo_id ORDER BY ts, audit_id))
    SELECT repo_id, audit_id, 'audit.failed' AS event FROM f WHERE bad
    UNION ALL SELECT repo_id, audit_id, 'audit.regressed' FROM g WHERE before IS NOT NULL AND (before - score >= 5 OR severe)
    UNION ALL SELECT repo_id, audit_id, 'gate.failed' FROM g WHERE NOT passed AND coalesce(was, true)"""
SEC = "date_trunc('second', ts)"
PLANS = [
    ("rate_windows", lambda t: J.run_available(J.rate_windows(hits(event_stream(t)), 2, 3600), _scratch(t)).select(
        _stamp("window_start").alias("window_start"), "scope", "ident", "hits", "over"), """
        WITH w AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS s, event_type AS scope, CAST(user_id AS VARCHAR) AS ident, count(*) AS hits
                   FROM events GROUP BY ALL)
        SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, scope, ident, hits, hits > 2 AS over FROM w
        WHERE s + INTERVAL '1 hour' <= (SELECT max(ts) - INTERVAL '10 minutes' FROM events)"""),
    ("first_hit_windows", lambda t: J.run_available(J.first_hit_windows(hits(event_stream(t)), 2, 3600), _scratch(t)).select(
        "scope", "ident", _stamp("ts").alias("ts"), "hits", "over"), f"""
        WITH RECURSIVE s AS (SELECT event_type AS scope, CAST(user_id AS VARCHAR) AS ident, {SEC} AS ts, count(*) AS n FROM events
            GROUP BY ALL),
        o AS (SELECT *, row_number() OVER (PARTITION BY scope, ident ORDER BY ts) AS rn FROM s),
        f AS (SELECT scope, ident, rn, ts, ts AS opened, n AS hits FROM o WHERE rn = 1
              UNION ALL SELECT o.scope, o.ident, o.rn, o.ts, CASE WHEN epoch(o.ts) - epoch(f.opened) > 3600 THEN o.ts ELSE f.opened END,
                CASE WHEN epoch(o.ts) - epoch(f.opened) > 3600 THEN o.n ELSE f.hits + o.n END
              FROM f JOIN o ON o.scope = f.scope AND o.ident = f.ident AND o.rn = f.rn + 1)
        SELECT scope, ident, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, CAST(hits AS BIGINT) AS hits, hits > 2 AS over FROM f"""),
    ("audit_alerts", lambda t: J.run_available(J.audit_alerts(finished(event_stream(t))), _scratch(t)).select(
        "repo_id", "audit_id", "event"), ALERT_SQL),
    ("dedupe_deliveries", lambda t: J.route_deliveries(deliveries(t.events)).groupBy("repo_id", "sha", "pr", "route").agg(
        F.min("ts").alias("_t")).select("repo_id", "sha", "pr", "route"), """
        SELECT DISTINCT CAST(user_id AS VARCHAR) AS repo_id, event_type AS sha, 0 AS pr, CASE event_id % 6 WHEN 3 THEN 'ping'
          WHEN 0 THEN 'audit_push' WHEN 4 THEN 'installation' WHEN 1 THEN CASE WHEN event_id % 5 IN (0, 3) THEN 'audit_pull' ELSE 'ignored' END
          WHEN 2 THEN CASE WHEN event_id % 5 = 2 THEN 'audit_pull' ELSE 'ignored' END ELSE 'ignored' END AS route FROM events"""),
    ("dedupe_within_watermark", lambda t: J.run_available(J.unique_deliveries(deliveries(event_stream(t))), _scratch(t)).select(
        "repo_id", "sha"), None),
    ("already_audited", lambda t: J.not_yet_audited(
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("c_nationkey").cast("string").alias("org_id"), F.col("o_custkey").cast("string").alias("repo_id"),
            (F.col("o_orderkey") % 100).alias("sha"), F.lit(0).cast("long").alias("pr"), "o_orderkey"),
        t.audits.select("org_id", "repo_id", F.col("sha_no").alias("sha"), "pr_number", "status")).select("repo_id", "o_orderkey"), """
        SELECT CAST(o_custkey AS VARCHAR) AS repo_id, o_orderkey FROM orders o WHERE NOT EXISTS (
          SELECT 1 FROM orders x WHERE x.o_custkey = o.o_custkey AND x.o_orderkey % 100 = o.o_orderkey % 100 AND x.o_orderkey % 7 > 0
            AND x.o_orderstatus IN ('F', 'O'))"""),
    ("expired_in_stream", lambda t: J.run_available(J.expire_stale(changes(event_stream(t))), _scratch(t)).select(
        "audit_id", "status", _stamp("since").alias("since")), """
        WITH c AS (SELECT CAST(user_id AS VARCHAR) AS audit_id, ts, CASE event_type WHEN 'click' THEN 'running' WHEN 'view' THEN 'queued'
                ELSE 'succeeded' END AS status FROM events),
        n AS (SELECT *, lead(ts) OVER (PARTITION BY audit_id ORDER BY ts, status) AS next,
                ts + CASE status WHEN 'running' THEN INTERVAL 2100 SECOND ELSE INTERVAL 6 HOUR END AS ends FROM c)
        SELECT audit_id, 'failed' AS status, strftime(ts, '%Y-%m-%d %H:%M:%S') AS since FROM n
        WHERE status <> 'succeeded' AND (next IS NULL OR next > ends)
          AND time_bucket(INTERVAL '1 minute', ends) + INTERVAL '1 minute' < (SELECT max(ts) - INTERVAL '10 minutes' FROM events)"""),
    ("stale_audits", lambda t: J.stale_audits(t.audits, NOW).select("audit_id"), f"""
        SELECT audit_id FROM audits WHERE status = 'running' AND started_at < TIMESTAMP '{NOW}' - INTERVAL 2100 SECOND"""),
    ("due_repositories", lambda t: J.due_repositories(t.repositories, t.audits, NOW).select("repo_id", "schedule"), f"""
        WITH n AS (SELECT repo_id, max(created_at) AS a FROM audits WHERE pr_number IS NULL AND status IN ('running', 'succeeded') GROUP BY 1)
        SELECT r.repo_id, schedule FROM repositories r LEFT JOIN n ON n.repo_id = r.repo_id WHERE schedule <> 'off' AND (a IS NULL OR
          epoch(TIMESTAMP '{NOW}') - epoch(a) >= CASE schedule WHEN 'daily' THEN 86400 ELSE 604800 END - 1800)"""),
    ("activity_tail", _tail, """
        SELECT CAST(user_id AS VARCHAR) AS audit_id, event_id AS seq, event_type AS msg FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 400"""),
    ("first_seen", _first_seen, """
        SELECT CAST(user_id AS VARCHAR) AS repo_id, concat(event_type, ':', event_id % 5) AS fingerprint,
          strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen_at FROM events GROUP BY ALL"""),
    ("active_gauge", _gauge, """
        SELECT CAST(user_id % 7 AS VARCHAR) AS org_id, CAST(sum(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN -1 ELSE 0 END) AS BIGINT) AS active,
          sum(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN -1 ELSE 0 END) >= 5 AS "full" FROM events GROUP BY 1"""),
    ("new_rules", lambda t: SK.new_rules(audit_findings(t), audit_findings(t).filter("rule_id LIKE 'bandit:%'").select("rule_id").distinct()).select(
        "rule_id", "tool", "category", "title", "default_severity"), """
        WITH o AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY org_id, repo_id, audit_id, analyzer, emit_idx) AS rn FROM audit_findings)
        SELECT rule_id, split_part(rule_id, ':', 1) AS tool, category, title, severity AS default_severity FROM o
        WHERE rn = 1 AND rule_id NOT LIKE 'bandit:%'"""),
    ("findings_csv", lambda t: SK.findings_csv(mapped(t)).select("audit_id", "rule_id", "title", "triage_status", "triage_review_date", "fingerprint"), """
        SELECT audit_id, rule_id, title, triage_status, coalesce(CAST(triage_expires_on AS VARCHAR), '') AS triage_review_date, fingerprint
        FROM audit_findings"""),
    ("controls_csv", lambda t: SK.controls_csv(mapped(t)).groupBy("framework").agg(F.sum("open_findings").alias("findings")), f"""
        WITH {COMPLIANCE_CTES}, pairs AS ({CONTROL_SELECT})
        SELECT CASE framework WHEN 'cwe' THEN 'CWE' WHEN 'owasp' THEN 'OWASP Top 10 (2021)' WHEN 'asvs' THEN 'OWASP ASVS 4.0'
            WHEN 'soc2' THEN 'SOC 2 (TSC 2017)' ELSE 'ISO/IEC 27001:2022 Annex A' END AS framework, count(*) AS findings
        FROM pairs WHERE kind <> 'ai_observation' AND triage_status = 'open' GROUP BY 1"""),
    ("risk_register_csv", lambda t: SK.risk_register_csv(audit_findings(t)).select("audit_id", "title", "location", "status", "owner", "review_date"), """
        SELECT audit_id, title, CASE WHEN file_path = '' THEN '(repository)' WHEN line_start IS NULL THEN file_path
            ELSE concat(file_path, ':', line_start) END AS location, triage_status AS status, triage_owner AS owner,
          coalesce(CAST(triage_expires_on AS VARCHAR), '') AS review_date FROM audit_findings
        WHERE triage_status IN ('accepted_risk', 'false_positive')"""),
    ("decision_log", lambda t: _decisions(t).select("audit_id", "time", "action", "actor", "details"), """
        SELECT a.audit_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS time, event_type AS action, CAST(user_id AS VARCHAR) AS actor, props AS details
        FROM events e JOIN audits a ON a.audit_id = CAST(e.event_id AS VARCHAR)
        WHERE event_id % 2 = 0 OR EXISTS (SELECT 1 FROM audit_findings f WHERE f.audit_id = a.audit_id AND f.emit_idx = 1)"""),
    ("report_lines", lambda t: _report(t), f"""
        SELECT audit_id, 'audit' AS section, CAST(0 AS INT) AS rank, branch, CAST(count(f.emit_idx) AS INT) AS n, CAST(NULL AS VARCHAR) AS rule_id,
          CAST(NULL AS VARCHAR) AS fingerprint, CAST(NULL AS VARCHAR) AS title, CAST(NULL AS VARCHAR) AS severity, CAST(NULL AS VARCHAR) AS file_path,
          CAST(NULL AS INT) AS line_start, CAST(NULL AS VARCHAR) AS triage_status
        FROM audits a LEFT JOIN (SELECT audit_id, emit_idx FROM audit_findings WHERE triage_status = 'open') f USING (audit_id) GROUP BY audit_id, branch
        UNION ALL SELECT audit_id, 'finding', CAST(row_number() OVER (PARTITION BY audit_id ORDER BY {SEV_RANK} DESC, category, file_path,
            coalesce(line_start, 0), fingerprint, emit_idx) AS INT), NULL, NULL, rule_id, fingerprint, title, severity, file_path, line_start, triage_status
        FROM audit_findings WHERE triage_status = 'open'"""),
    ("sarif_results", lambda t: SK.sarif_results(audit_findings(t)).select(
        "audit_id", "rule_id", F.col("result.level").alias("level"), F.col("result.message.text").alias("message"),
        F.get("result.locations", F.lit(0))["physicalLocation"]["artifactLocation"]["uri"].alias("uri"),
        F.get("result.locations", F.lit(0))["physicalLocation"]["region"]["startLine"].alias("start_line"),
        F.col("result.suppressions").isNotNull().alias("suppressed")), """
        SELECT audit_id, rule_id, CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level,
          concat(title, '. ', description, ' Remediation: ', remediation) AS message, nullif(file_path, '') AS uri,
          CASE WHEN file_path <> '' THEN line_start END AS start_line, triage_status <> 'open' AS suppressed
        FROM audit_findings WHERE kind <> 'ai_observation' AND triage_status <> 'fixed'"""),
    ("sarif_rules", lambda t: SK.sarif_rules(audit_findings(t)).select(
        "audit_id", "rule_id", F.col("rule.shortDescription.text").alias("title"), F.col("rule.properties.category").alias("category"),
        F.col("rule.properties.security-severity").alias("score")), f"""
        WITH o AS (SELECT *, row_number() OVER (PARTITION BY audit_id, rule_id ORDER BY {SEV_RANK} DESC, category, file_path, coalesce(line_start, 0),
            fingerprint) AS rn FROM audit_findings WHERE kind <> 'ai_observation')
        SELECT audit_id, rule_id, left(title, 200) AS title, category, CASE severity WHEN 'critical' THEN '9.5' WHEN 'high' THEN '8.0'
          WHEN 'medium' THEN '5.5' WHEN 'low' THEN '3.0' ELSE '0.0' END AS score FROM o WHERE rn = 1"""),
    ("sarif_lines", lambda t: SK.sarif_lines(audit_findings(t)).select(
        "audit_id", "section", F.coalesce(F.get_json_object("value", "$.ruleId"), F.get_json_object("value", "$.id")).alias("rule_id"),
        F.get_json_object("value", "$.partialFingerprints.fingerprint/v1").alias("fingerprint"),
        F.get_json_object("value", "$.properties.severity").alias("severity")), """
        WITH s AS (SELECT * FROM audit_findings WHERE triage_status <> 'fixed' AND kind <> 'ai_observation')
        SELECT DISTINCT audit_id, 'rule' AS section, rule_id, CAST(NULL AS VARCHAR) AS fingerprint, CAST(NULL AS VARCHAR) AS severity FROM s
        UNION ALL SELECT audit_id, 'result', rule_id, fingerprint, severity FROM s"""),
    ("alert_deliveries", _alert_deliveries, f"""
        WITH alerts AS ({ALERT_SQL}),
        channels AS (SELECT concat('r-', r_regionkey) AS channel_id, CASE WHEN r_regionkey % 2 = 0 THEN 'slack' ELSE 'webhook' END AS kind,
            unnest(CASE WHEN r_regionkey < 2 THEN ['audit.failed', 'gate.failed'] ELSE ['audit.regressed'] END) AS event
          FROM region WHERE r_regionkey <> 3)
        SELECT repo_id, audit_id, event, channel_id, kind FROM alerts JOIN channels USING (event)"""),
    ("late_rows", _late_rows, """
        WITH e AS (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id, event_id % 4 AS part FROM events),
        m AS (SELECT part, max(ts) AS latest FROM e GROUP BY 1),
        l AS (SELECT user_id, event_id FROM e WHERE ts < (SELECT max(latest) FROM m WHERE m.part < e.part) - INTERVAL 10 MINUTE)
        SELECT user_id, count(*) AS late, max(event_id) AS last, (SELECT count(*) FROM l)::BIGINT AS told FROM l GROUP BY user_id"""),
    ("tenant_findings", _tenant_findings, f"""
        SELECT f.audit_id, strftime(a.created_at, '%Y-%m') AS batch, count(*) AS findings, max(title) AS title
        FROM audit_findings f JOIN audits a USING (audit_id) WHERE a.org_id = '{ORG}' GROUP BY ALL"""),
    ("sarif_files", _sarif_files, """
        WITH s AS (SELECT * FROM audit_findings WHERE triage_status <> 'fixed' AND kind <> 'ai_observation')
        SELECT a.audit_id, '2.1.0' AS version, CAST(count(DISTINCT rule_id) AS INT) AS rules, CAST(count(s.audit_id) AS INT) AS results,
          CAST(count(*) FILTER (severity IN ('critical', 'high')) AS INT) AS errors
        FROM audits a LEFT JOIN s ON s.audit_id = a.audit_id GROUP BY a.audit_id"""),
    ("report_files", _report_files, f"""
        SELECT a.audit_id, any_value(a.branch) AS branch, CAST(count(f.audit_id) AS INT) AS n, CAST(count(f.audit_id) AS INT) AS listed,
          arg_max(severity, {SEV_RANK}) AS worst
        FROM audits a LEFT JOIN (SELECT * FROM audit_findings WHERE triage_status = 'open') f ON f.audit_id = a.audit_id GROUP BY a.audit_id"""),
    ("ai_explanations", lambda t: _explained(t).select("audit_id", "batch", "id", "explanation"), f"""
        WITH c AS (SELECT audit_id, row_number() OVER (PARTITION BY audit_id ORDER BY {SEV_RANK} DESC,
             CASE confidence WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END DESC, file_path, fingerprint) AS rank
           FROM audit_findings WHERE kind <> 'ai_observation' AND severity <> 'info' QUALIFY rank <= 4)
        SELECT audit_id, CAST((rank - 1) // 2 AS INT) AS batch, concat('F', rank) AS id, concat('About F', rank, ' password = [REDACTED]') AS explanation FROM c"""),
    ("ai_observations", lambda t: AI.observations(_assistant(t), t.repo_files).select("repo_id", "audit_id", "category", "kind", "file_path"), """
        SELECT CAST(conv_id AS VARCHAR) AS repo_id, CAST(turn AS VARCHAR) AS audit_id, 'security' AS category, 'ai_observation' AS kind, '' AS file_path
        FROM conversations WHERE role = 'assistant' AND trim(left(text, 50)) <> '' AND trim(text) <> ''"""),
    ("unlinked_findings", lambda t: AI.unlinked(audit_findings(t), audit_findings(t).filter("triage_status = 'fixed'").select(
        "org_id", "repo_id", "fingerprint").distinct()).select("audit_id", "emit_idx"), """
        SELECT audit_id, emit_idx FROM audit_findings f WHERE NOT EXISTS (SELECT 1 FROM audit_findings x WHERE x.repo_id = f.repo_id
          AND x.fingerprint = f.fingerprint AND x.triage_status = 'fixed')"""),
    ("report_visibility", lambda t: SK.visible(audit_findings(t), "dismissed").groupBy("triage_status").agg(F.count(F.lit(1)).alias("n")), """
        SELECT triage_status, count(*) AS n FROM audit_findings WHERE triage_status <> 'fixed' GROUP BY 1"""),
]
