"""Operability evidence: what a repository's code never mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename, is_test_path
from ..operators import AUDIT
from ..session import cut_lineage
from .engine import Pack, Rule, emit, emit_each, line_of, register, union

NAME = "observability"

# Frameworks and hints.
WEB_FRAMEWORKS = ["flask", "django", "fastapi", "express", "nestjs", "fastify", "koa", "starlette"]
MANIFESTS = ["requirements.txt", "pyproject.toml", "Pipfile", "setup.cfg", "setup.py", "package.json"]
_WORD = r"_?(?:health(?:z|check|-check|_check)?|livez|readyz|ready|readiness|liveness|alive|status|ping)"
HEALTH = rf"""(?i)["'`][^"'`\s]*/{_WORD}/?["'`]|\b(?:re_)?path\(\s*r?["']\^?{_WORD}/?\$?["']"""
METRICS = (r"(?i)prometheus|opentelemetry|statsd|datadog|ddtrace|dd-trace|newrelic|prom-client|"
           r"micrometer|aws_embedded_metrics|cloudwatch|['\"`]/metrics\b")
ERROR_TRACKING = (r"(?i)sentry|rollbar|bugsnag|raygun|airbrake|honeybadger|appsignal|newrelic|ddtrace|dd-trace|"
                  r"elastic-apm|elasticapm|opentelemetry|errorreporting|google\.cloud\.error_reporting|"
                  r"applicationinsights|logrocket|highlight\.io")
TRACING = (r"(?i)opentelemetry|ddtrace|dd-trace|newrelic|honeycomb|elastic-apm|elasticapm|aws_xray|aws-xray|zipkin|"
           r"jaeger|traces_sample_rate|tracesSampleRate|applicationinsights|cloud-trace|google\.cloud\.trace")
REQUEST_ID = (r"(?i)request[-_]?id|correlation[-_]?id|traceparent|trace_id|x-amzn-trace-id|opentelemetry|"
              r"asgi[-_]correlation|express-request-id|cls-rtracer")
LOGGER = r"(?i)\b(?:winston|pino|bunyan|log4js|loglevel|signale|consola|tslog|@nestjs/common)\b"
PY_LOGGING = r"(?m)^\s*(?:import logging|from logging|import structlog|from loguru)"
TEXT_LOGGING = (r"(?im)^\s*(?:import logging|from logging import|from loguru import)|"
                r"\b(?:winston|log4js|loglevel|signale|consola|tslog)\b")
STRUCTURED = (r"(?i)structlog|python-json-logger|pythonjsonlogger|json_log_formatter|jsonlogger|JsonFormatter|"
              r"ecs[-_]logging|logstash|serialize\s*=\s*True|google\.cloud\.logging|watchtower|\bpino\b|\bbunyan\b|"
              r"format\.json\(|ecs-winston|@elastic/ecs|logfmt|JSONRenderer|json_logs|ExtraAdder|EventRenamer")
AUTH = (r"(?i)login_required|flask_login|flask-login|current_user|passport|next-auth|@auth/|django\.contrib\.auth|"
        r"jsonwebtoken|\bpyjwt\b|\bjwt\.(?:encode|sign)|bcrypt|argon2|LoginManager|OAuth2PasswordBearer|auth0|"
        r"@clerk/|supabase\.auth|firebase-admin|authenticate\(|check_password|verify_password")
AUDIT_LOG = (r"(?i)audit|simple_history|django-simple-history|reversion|paper_?trail|activity_?log|security_?log|"
             r"security_?event|ActivityLog|event_?store")
JOBS = (r"(?m)^\s*(?:from|import)\s+(celery|rq|dramatiq|huey|arq|apscheduler|django_q|taskiq)\b|"
        r"""(?:require\(\s*|from\s+)['"](bull|bullmq|bee-queue|agenda|node-cron|node-schedule|kue|graphile-worker|"""
        r"""pg-boss|@nestjs/bull|@nestjs/bullmq|@nestjs/schedule|inngest|@trigger\.dev/sdk)['"]""")
JOB_MONITOR = (r"(?i)flower|task_failure|task_retry|on_failure|celery[-_]exporter|sentry|rq[-_]dashboard|"
               r"failure_callback|bull-board|@bull-board|bull-arena|\.on\(\s*['\"](?:failed|error)['\"]|OnQueueFailed|"
               r"OnWorkerEvent|dead[-_ ]?letter|cronitor|healthchecks\.io|hc-ping\.com|opentelemetry|prometheus|"
               r"datadog|ddtrace|newrelic|EVENT_JOB_ERROR|add_listener|on_job_failure|failure_ttl")
ROUTE = r"@\w+\.(?:route|get|post|put|patch|delete)\(|\b(?:app|router)\.(?:get|post|put|patch|delete)\("
PY_PRINT = r"(?m)^\s*print\("
JS_CONSOLE = r"\bconsole\.(?:log|error|warn|info)\("
CODE = r"\.(?:py|js|ts|mjs|cjs)$"
# End of fixed values


def _r(seq: int, name: str, title: str, severity: str = "low", confidence: str = "medium", kind: str = "potential",
       remediation: str = "") -> Rule:
    return Rule(f"devops.{name}", title, "observability", severity, confidence, kind, seq=seq, remediation=remediation)


NO_LOGGING = _r(1, "no-logging", "No logging framework usage detected (Python)", remediation="Adopt structured logging.")
ABSENT = {
    "_metrics": _r(3, "no-metrics", "No application metrics instrumentation detected", remediation="Export metrics."),
    "_errors": _r(4, "no-error-tracking", "No error tracking detected", remediation="Add an error tracker."),
    "_tracing": _r(5, "no-tracing", "No distributed tracing detected", "info", remediation="Instrument the service."),
    "_request": _r(6, "no-request-id", "No request/correlation id propagation detected", "info",
                   remediation="Log a request id."),
}
NO_HEALTH = _r(2, "no-health-endpoint", "No health-check endpoint detected", remediation="Expose health endpoints.")
PLAIN_LOGS = _r(7, "unstructured-logging", "Logs are plain text, not structured", remediation="Log JSON objects.")
PRINTS = _r(8, "print-logging", "Server code logs with print/console instead of a logger", kind="confirmed",
            remediation="Use a logger.")
NO_AUDIT = _r(9, "no-audit-log", "No audit logging of security-relevant actions detected", confidence="low",
              remediation="Write audit records.")
NO_JOB_MONITOR = _r(10, "no-job-monitoring", "Background jobs without failure monitoring",
                    remediation="Report job failures.")


def evidence_flags(files: DataFrame) -> DataFrame:
    """One row per audit: which hints its code and manifests contain. A single mergeable aggregation."""
    code = F.col("path").rlike(CODE) & ~is_test_path("path") & ~F.col("path").contains("node_modules/")
    corpus = code | basename("path").isin(*MANIFESTS)
    text, python = F.col("text"), code & F.col("path").endswith(".py")

    def seen(where, pattern):
        return F.coalesce(F.max(F.when(where, text.rlike(pattern))), F.lit(False))

    return files.groupBy(*AUDIT).agg(
        F.count(F.when(python, 1)).alias("_py"), seen(python, PY_LOGGING).alias("_logging"),
        seen(code, HEALTH).alias("_health"), seen(corpus, METRICS).alias("_metrics"),
        seen(corpus, ERROR_TRACKING).alias("_errors"), seen(corpus, TRACING).alias("_tracing"),
        seen(corpus, REQUEST_ID).alias("_request"), seen(corpus, TEXT_LOGGING).alias("_text"),
        seen(corpus, STRUCTURED).alias("_structured"), seen(corpus, AUTH).alias("_auth"),
        seen(corpus, AUDIT_LOG).alias("_audit"), seen(corpus, JOB_MONITOR).alias("_monitor"),
        seen(corpus, LOGGER).alias("_logger"),
        F.min(F.when(code & text.rlike(JOBS), F.col("path"))).alias("_job_path"))


def run(tables: dict[str, DataFrame]) -> DataFrame:
    """``frameworks``: (audit, framework) rows decide which repositories are web services."""
    files = tables["files"]
    web = tables["frameworks"].filter(F.col("framework").isin(*WEB_FRAMEWORKS)).select(*AUDIT).distinct()
    flags = cut_lineage(evidence_flags(files).join(web.withColumn("_web", F.lit(True)), AUDIT, "left").na.fill(
        False, ["_web"]))
    is_web = F.col("_web")
    parts = [emit_each(flags, NAME, [
        ((F.col("_py") >= 5) & ~F.col("_logging"), NO_LOGGING), (is_web & ~F.col("_health"), NO_HEALTH),
        *[(is_web & ~F.col(flag), rule) for flag, rule in ABSENT.items()],
        (is_web & F.col("_text") & ~F.col("_structured"), PLAIN_LOGS),
        (is_web & F.col("_auth") & ~F.col("_audit"), NO_AUDIT)])]
    code = files.filter(F.col("path").rlike(CODE) & ~is_test_path("path") & ~F.col("path").contains("node_modules/"))
    routed = code.filter(F.col("text").rlike(ROUTE)).join(flags.filter(is_web).select(*AUDIT, "_logger"), AUDIT)
    at = F.when(F.col("path").endswith(".py"), line_of("text", PY_PRINT)).when(
        ~F.col("_logger"), line_of("text", JS_CONSOLE))
    parts.append(emit(routed.withColumn("_at", at).filter(F.col("_at").isNotNull()), NAME, PRINTS, path=F.col("path"),
                      line=F.col("_at")))
    silent = flags.filter(F.col("_job_path").isNotNull() & ~F.col("_monitor")).select(
        *AUDIT, F.col("_job_path").alias("path"))
    jobs = code.join(silent, [*AUDIT, "path"])
    lib = F.coalesce(F.nullif(F.regexp_extract("text", JOBS, 1), F.lit("")), F.regexp_extract("text", JOBS, 2))
    parts.append(emit(jobs, NAME, NO_JOB_MONITOR, path=F.col("path"), line=line_of("text", JOBS), title=F.concat(
        F.lit("Background jobs ("), lib, F.lit(") without failure monitoring"))))
    return union(parts)


register(Pack(NAME, "Observability (logging, errors, tracing, metrics, audit, jobs)", ("observability",), run))
