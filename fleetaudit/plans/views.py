"""Audit-shaped views over the given tables.

Each view is one SELECT in the SQL subset Spark and DuckDB share, so the Spark query and its check read the same
rows. Views only project and join; every operator lives in ``fleetaudit.operators``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..vocab import RULE_NAMESPACE as NS

BASE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
               "embeddings", "pages", "benchmark", "labels", "conversations"]

TODAY = "2001-09-01"

# Rule ids and categories the derived findings use.
RULES = [
    ("bandit:B105", "security"), ("ruff:S105", "security"), (NS + "secrets.aws-access-key", "security"),
    ("bandit:B608", "security"), (NS + "taint.sql-injection", "security"),
    (NS + "database.sql-string-formatting", "database"), ("semgrep:python.lang.sql-format", "security"),
    ("trivy:secret-github-pat", "security"), ("bandit:B602", "security"),
    (NS + "taint.command-injection", "security"), (NS + "api.cors-wildcard", "api"),
    (NS + "api.no-rate-limiting", "api"), (NS + "ai-code.placeholder-logic", "maintainability"),
    (NS + "ai-code.lookalike-package", "dependencies"), ("vuln:CVE-2021-1001", "dependencies"),
    (NS + "dependencies.unpinned-python", "dependencies"), (NS + "devops.gha-unpinned-actions", "devops"),
    (NS + "devops.compose-privileged", "devops"), (NS + "devops.k8s-no-resource-limits", "devops"),
    (NS + "devops.no-logging", "observability"), (NS + "testing.no-tests", "testing"),
    (NS + "architecture.import-cycle", "architecture"), (NS + "performance.sync-io-in-server", "performance"),
    (NS + "maintainability.large-file", "maintainability"), (NS + "database.money-as-float", "database"),
    ("mypy:arg-type", "maintainability"), ("eslint:no-eval", "security"), (NS + "auth.express-no-csrf", "security"),
    (NS + "config.hardcoded-endpoint", "maintainability"), ("bandit:B324", "security"),
]


def _pick(expr: str, values: list[str]) -> str:
    return f"split_part('{'|'.join(values)}', '|', CAST({expr} AS INT) + 1)"


_RULE = _pick(f"l_partkey % {len(RULES)}", [r for r, _ in RULES])
_CATEGORY = _pick(f"l_partkey % {len(RULES)}", [c for _, c in RULES])

VIEWS: dict[str, str] = {
    "organizations": "SELECT CAST(n_nationkey AS STRING) AS org_id, n_name AS name FROM nation",
    "repositories": """
        SELECT CAST(c_nationkey AS STRING) AS org_id, CAST(c_custkey AS STRING) AS repo_id,
               lower(c_name) AS name,
               CASE c_custkey % 3 WHEN 0 THEN 'off' WHEN 1 THEN 'daily' ELSE 'weekly' END AS schedule
        FROM customer""",
    "audits": """
        SELECT CAST(c_nationkey AS STRING) AS org_id, CAST(o_custkey AS STRING) AS repo_id,
               CAST(o_orderkey AS STRING) AS audit_id,
               CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'release' ELSE 'main' END AS branch,
               CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
               CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey % 1000 + 1 END AS pr_number,
               CAST(CAST(floor(o_totalprice) AS BIGINT) % 1001 AS INT) AS score10,
               CASE WHEN CAST(floor(o_totalprice) AS BIGINT) % 1001 >= 800 THEN 'Low'
                    WHEN CAST(floor(o_totalprice) AS BIGINT) % 1001 >= 600 THEN 'Moderate'
                    WHEN CAST(floor(o_totalprice) AS BIGINT) % 1001 >= 400 THEN 'High'
                    ELSE 'Critical' END AS risk_level,
               o_orderdate AS created_at, o_orderdate AS started_at,
               CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 1 HOUR END AS finished_at,
               o_orderkey % 100 AS sha_no
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "findings": f"""
        SELECT CAST(c_nationkey AS STRING) AS org_id, CAST(o_custkey AS STRING) AS repo_id,
               CAST(l_orderkey AS STRING) AS audit_id,
               CASE WHEN rule_id LIKE '{NS}%' THEN split_part(substr(rule_id, {len(NS) + 1}), '.', 1)
                    WHEN rule_id LIKE 'vuln:%' THEN 'dependencies'
                    ELSE split_part(rule_id, ':', 1) END AS analyzer,
               (CAST(l_linenumber AS BIGINT) * 1000003 + l_partkey) * 100003 + l_suppkey AS emit_idx,
               rule_id,
               CASE WHEN l_partkey % 61 = 0 THEN ' '
                    ELSE concat('Issue ', CAST(l_partkey % 30 AS STRING), '/', CAST(l_suppkey % 3 AS STRING))
               END AS title,
               {_CATEGORY} AS category,
               CASE WHEN l_quantity <= 3 THEN 'critical' WHEN l_quantity <= 10 THEN 'high'
                    WHEN l_quantity <= 25 THEN 'medium' WHEN l_quantity <= 40 THEN 'low' ELSE 'info' END AS severity,
               CASE WHEN round(l_tax * 100) <= 2 THEN 'low' WHEN round(l_tax * 100) <= 5 THEN 'medium'
                    ELSE 'high' END AS confidence,
               CASE WHEN round(l_tax * 100) = 8 AND l_returnflag = 'R' THEN 'ai_observation'
                    WHEN l_returnflag = 'A' THEN 'confirmed' WHEN l_returnflag = 'N' THEN 'potential'
                    ELSE 'estimate' END AS kind,
               concat('Reported by check ', CAST(l_partkey % 30 AS STRING),
                      CASE WHEN l_suppkey % 9 = 0 THEN ' (CWE-79)' WHEN l_suppkey % 9 = 1 THEN ' see CWE_502'
                           ELSE '' END) AS description,
               concat('Fix ', CAST(l_partkey % 30 AS STRING)) AS remediation,
               CASE WHEN l_suppkey % 11 = 0 THEN ''
                    WHEN l_suppkey % 4 = 0 THEN concat('./src/m', CAST(l_suppkey % 3 AS STRING), '.py')
                    WHEN l_suppkey % 4 = 1 THEN concat('src/m', CAST(l_suppkey % 3 AS STRING), '.py')
                    WHEN l_suppkey % 4 = 2 THEN concat('tests/test_m', CAST(l_suppkey % 3 AS STRING), '.py')
                    ELSE concat('src', chr(92), 'auth', CAST(l_suppkey % 2 AS STRING), '.js') END AS file_path,
               CASE WHEN l_suppkey % 11 > 0
                    THEN l_linenumber + CASE WHEN round(l_discount * 100) >= 9 THEN 100 ELSE 0 END END AS line_start,
               CASE WHEN l_suppkey % 11 > 0 THEN CAST(l_linenumber + l_suppkey % 3 - 1 AS INT) END AS line_end,
               CASE WHEN l_partkey % 30 = 14
                    THEN concat(CASE l_suppkey % 4 WHEN 0 THEN 'requests' WHEN 1 THEN 'PyYAML'
                                     WHEN 2 THEN '@scope/pkg' ELSE 'left_pad' END, '==1.0 fixed in 2.0')
                    WHEN l_linenumber % 3 = 0 THEN ''
                    ELSE concat('ev-', CAST(l_partkey % 7 AS STRING)) END AS evidence,
               split(concat('https://ref/', CAST(l_partkey % 3 AS STRING), ',https://ref/x',
                            CAST(l_suppkey % 2 AS STRING)), ',') AS refs,
               CASE CAST(round(l_discount * 100) AS INT) WHEN 2 THEN 'accepted_risk' WHEN 3 THEN 'false_positive'
                    WHEN 4 THEN 'fixed' ELSE 'open' END AS triage_status,
               CASE CAST(round(l_discount * 100) AS INT) WHEN 2 THEN concat('team-', CAST(l_suppkey % 5 AS STRING))
                    ELSE '' END AS triage_owner,
               CASE WHEN round(l_discount * 100) IN (2, 3) AND l_suppkey % 10 > 0
                    THEN CAST(l_shipdate AS DATE) + CAST((l_suppkey % 7) * 60 AS INT) END AS triage_expires_on,
               CASE WHEN l_partkey % 4 = 0 THEN 'existing' WHEN l_partkey % 4 = 1 THEN 'recurring'
                    ELSE 'new' END AS lifecycle
        FROM (SELECT *, {_RULE} AS rule_id FROM lineitem) reported
        JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""",
    "lines": """
        SELECT CAST(c_nationkey AS STRING) AS org_id, CAST(o_custkey AS STRING) AS repo_id,
               CAST(l_orderkey AS STRING) AS audit_id,
               CASE WHEN l_suppkey % 4 IN (0, 1) THEN concat('src/m', CAST(l_suppkey % 3 AS STRING), '.py')
                    WHEN l_suppkey % 4 = 2 THEN concat('tests/test_m', CAST(l_suppkey % 3 AS STRING), '.py')
                    ELSE concat('src/auth', CAST(l_suppkey % 2 AS STRING), '.js') END AS path,
               l_linenumber AS line_no,
               min(concat('  call', chr(9), ' x', CAST(l_partkey % 3 AS STRING), ' ')) AS text
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        WHERE round(l_discount * 100) <> 8
        GROUP BY 1, 2, 3, 4, 5""",
    "files": """
        SELECT org_id, repo_id, audit_id, path, max(line_no) AS line_count FROM lines GROUP BY 1, 2, 3, 4""",
    "audit_findings": """
        SELECT findings.*, concat_ws('|', rule_id, file_path, title) AS fingerprint FROM findings""",
    "outcomes": """
        SELECT org_id, repo_id, audit_id, analyzer AS name,
               CASE WHEN max(emit_idx % 13) = 0 THEN 'failed' ELSE 'ok' END AS status, category
        FROM findings GROUP BY org_id, repo_id, audit_id, analyzer, category""",
}


# --- repositories' files: one set per customer row, texts composed from its key ------------------------------------
def _text(*lines: str) -> str:
    return "concat_ws(chr(10), " + ", ".join(lines) + ")"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_FILES = {
    "requirements.txt": ("true", _text(
        "CASE k % 3 WHEN 0 THEN 'flask==1.0' WHEN 1 THEN 'flask>=1.0' ELSE 'Flask' END",
        "concat('PyYAML==', CAST(k % 5 AS STRING), '.', CAST(k % 7 AS STRING))",
        _q('requests[security] == 2.1 ; python_version > "3"'),
        "CASE k % 4 WHEN 0 THEN 'git+https://example.com/x.git' WHEN 1 THEN '-e git+https://example.com/y' ELSE '-r base.txt' END",
        "CASE WHEN k % 6 = 0 THEN 'flask==2.0' END", "'# a comment'", "'reqeusts==1.0'")),
    "requirements-dev.txt": ("k % 2 = 0", _text(
        "concat('pyyaml==', CAST(k % 4 AS STRING), '.', CAST(k % 7 AS STRING))", "'pytest'", "'numpy'", "'pandas'", "'scipy'")),
    "poetry.lock": ("k % 7 = 0", _text(
        "'[[package]]'", _q('name = "PyYAML"'), "concat('version = ', chr(34), CAST(k % 3 AS STRING), '.1', chr(34))", "''",
        "'[package.dependencies]'", _q('version = "9"'), "'[[package]]'", _q('name = "idna"'), _q('version = "3.4"'))),
    "pyproject.toml": ("k % 5 = 0", _text(
        "'[project]'", "'name = \"x\"'", "concat('dependencies = [\"pyyaml>=', CAST(k % 3 AS STRING), '.2\", \"attrs\"]')",
        "CASE WHEN k % 25 = 0 THEN 'broken = [' END")),
    "package.json": ("true", (
        "concat('{\"dependencies\": {\"express\": \"^', CAST(k % 4 AS STRING), '.0.0\", \"left-pad\": \"npm:real-pad@1.0\", "
        "\"lib\": \"file:../lib\"', CASE WHEN k % 3 = 0 THEN ', \"any\": \"*\"' ELSE '' END, '}, \"devDependencies\": {\"jest\": \"29.0.0\"', "
        "CASE WHEN k % 5 = 0 THEN ', \"express\": \"1.0.0\"' ELSE '' END, '}, \"scripts\": {\"test\": \"', "
        "CASE WHEN k % 8 = 0 THEN 'echo no test specified' ELSE 'jest' END, '\"}}')")),
    "package-lock.json": ("k % 3 = 0", (
        "concat('{\"packages\": {\"\": {\"dependencies\": {\"express\": \"^', CAST(k % 2 AS STRING), '.0.0\", \"left-pad\": \"npm:real-pad@1.0\", "
        "\"lib\": \"file:../lib\", \"any\": \"*\"}, \"devDependencies\": {\"jest\": \"29.0.0\"}}, \"node_modules/express\": {\"version\": \"4.', "
        "CAST(k % 9 AS STRING), '.0\"}, \"node_modules/a/node_modules/express\": {\"version\": \"3.0.0\"}, "
        "\"node_modules/lib\": {\"link\": true, \"version\": \"1.0.0\"}}}')")),
    "yarn.lock": ("k % 3 = 1", _text(
        "'# yarn lockfile v1'", "concat('express@^', CAST(k % 4 AS STRING), '.0.0:')", "'  version \"4.1.0\"'",
        "'  dependencies:'", "'    qs \"^6\"'", "''", "'\"@scope/pkg@^1.0.0\", \"@scope/pkg@^1.2.0\":'",
        "concat('  version \"1.2.', CAST(k % 6 AS STRING), '\"')")),
    "pnpm-lock.yaml": ("k % 3 = 2", _text(
        "'lockfileVersion: 9'", "'importers:'", "'  .:'", "'    dependencies:'", "'      express:'",
        "concat('        specifier: ^', CAST(k % 2 AS STRING), '.0.0')", "'        version: 4.0.0'", "'packages:'",
        "concat('  express@4.0.', CAST(k % 5 AS STRING), ':')", "'    resolution: x'",
        "concat('  /@s/p@2.0.', CAST(k % 2 AS STRING), '(peer@1.0.0):')", "'    resolution: y'")),
    "Dockerfile": ("true", _text(
        "CASE k % 3 WHEN 0 THEN 'FROM python' WHEN 1 THEN 'FROM python:3.12' ELSE 'FROM --platform=linux/amd64 node:latest AS base' END",
        "CASE WHEN k % 4 = 1 THEN 'ENV DB_PASSWORD=hunter22' ELSE 'ENV DB_PASSWORD_FILE=/run/secrets/x' END",
        "CASE WHEN k % 5 = 1 THEN 'RUN curl https://x.sh | sh' ELSE 'RUN make' END",
        "CASE WHEN k % 6 = 1 THEN 'ADD https://x/y.tgz /' ELSE 'ADD x /' END",
        "CASE WHEN k % 3 = 2 THEN 'FROM base' END",
        "CASE k % 4 WHEN 0 THEN 'USER root' WHEN 1 THEN 'USER app' END",
        "CASE WHEN k % 2 = 0 THEN 'HEALTHCHECK CMD true' END",
        "CASE WHEN k % 7 = 0 THEN 'CMD flask run' ELSE 'CMD gunicorn app' END")),
    "docker-compose.yml": ("k % 2 = 1", _text(
        "'services:'", "'  db:'", "'    ports:'", "CASE WHEN k % 3 = 0 THEN '      - \"5432:5432\"' ELSE '      - \"127.0.0.1:5432:5432\"' END",
        "'  app:'", "CASE WHEN k % 5 = 0 THEN '    privileged: true' ELSE '    mem_limit: 1g' END")),
    ".github/workflows/ci.yml": ("k % 3 <> 2", _text(
        "'jobs:'", "'  test:'", "CASE WHEN k % 2 = 0 THEN '    run: pytest' ELSE '    run: make' END", "'  build:'",
        "'    needs: test'", "'  deploy:'", "CASE WHEN k % 4 = 0 THEN '    needs: []' ELSE '    needs: [build]' END",
        "'    run: kubectl apply'", "CASE WHEN k % 7 = 0 THEN '    uses: actions/checkout@v4' END")),
    "src/server.js": ("true", _text(
        "'import express from \"express\"'", "'import util from \"./util\"'",
        "CASE WHEN k % 3 = 0 THEN 'app.use(cors())' ELSE 'app.use(cors({ origin: list }))' END",
        "CASE WHEN k % 4 = 0 THEN 'const opts = { rejectUnauthorized: false }' END",
        "'app.post(\"/payments/:id\", (req, res) => {'", "'  console.log(process.env.STRIPE_KEY)'", "'})'",
        "CASE WHEN k % 6 = 0 THEN 'fetch(\"http://localhost:3000/x\")' END",
        "CASE WHEN k % 5 = 0 THEN 'try { x() } catch (e) {}' END", "'throw new Error(\"a\")'")),
    "src/util.ts": ("true", _text(
        "CASE WHEN k % 2 = 0 THEN 'import a from \"./server\"' ELSE 'export const a = 1' END",
        "CASE WHEN k % 4 = 0 THEN '// TODO: implement this' ELSE '// fine' END", "'import lodash from \"lodash/fp\"'")),
    "app/services.py": ("true", _text(
        "'import yaml'", "CASE WHEN k % 3 = 0 THEN 'import boto3' ELSE 'import os' END", "'from app import models'",
        "concat('token = ', chr(34), CASE WHEN k % 9 = 0 THEN concat('AKIA', 'ABCDEFGHIJKLMNOP') ELSE 'x' END, chr(34))")),
    "app/models.py": ("true", _text(
        "'import sqlalchemy'", "CASE WHEN k % 2 = 0 THEN 'from .services import run' ELSE 'x = 1' END")),
    "app/__init__.py": ("true", "''"),
    "tests/server.test.js": ("k % 2 = 0", _text(
        "'test(\"a\", () => {'", "CASE WHEN k % 4 = 0 THEN '  expect(true).toBe(true)' ELSE '  call()' END", "'})'")),
    "README.md": ("k % 3 > 0", "CASE WHEN k % 3 = 1 THEN '# x' ELSE concat_ws(chr(10), '1', '2', '3', '4', '5', '6', '7', 'STRIPE_KEY') END"),
}

VIEWS["repo_files"] = "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT CAST(n AS STRING) AS org_id, CAST(k AS STRING) AS repo_id, 'head' AS audit_id, '{path}' AS path, {text} AS text "
    f"FROM (SELECT c_custkey AS k, c_nationkey AS n FROM customer) keyed WHERE {cond}"
    for path, (cond, text) in _FILES.items()) + ") every_file"

VIEWS["doc_files"] = """
    SELECT lang AS org_id, source AS repo_id, 'head' AS audit_id,
           concat('src/', CAST(doc_id AS STRING), '.py') AS path, text FROM documents"""

VIEWS["edges"] = """
    SELECT DISTINCT CAST(c_nationkey AS STRING) AS org_id, CAST(o_custkey AS STRING) AS repo_id, 'head' AS audit_id,
           concat('pkg', CAST(l_suppkey % 6 AS STRING), '/m', CAST(l_suppkey % 40 AS STRING), '.py') AS src,
           concat('pkg', CAST(l_partkey % 6 AS STRING), '/m', CAST(l_partkey % 40 AS STRING), '.py') AS dst
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"""

# Catalogue of every customer's schema, varied by its key.
VIEWS["schema_columns"] = """
    SELECT CAST(n AS STRING) AS org_id, CAST(k AS STRING) AS repo_id, model, tbl, col, type, nullable, pk, is_unique, fk_tbl, fk_col,
           on_delete, orm, 'models.py' AS file, line FROM (
      SELECT k, n, 'User' AS model, 'users' AS tbl, 'id' AS col, 'BigInteger' AS type, false AS nullable, true AS pk, true AS is_unique,
             CAST(NULL AS STRING) AS fk_tbl, CAST(NULL AS STRING) AS fk_col, CAST(NULL AS STRING) AS on_delete,
             'sqlalchemy' AS orm, 1 AS line FROM (SELECT c_custkey AS k, c_nationkey AS n FROM customer) a
      UNION ALL SELECT k, n, 'User', 'users', 'email', 'String(80)', false, false, k % 2 = 0, NULL, NULL, NULL, 'sqlalchemy', 2
        FROM (SELECT c_custkey AS k, c_nationkey AS n FROM customer) a
      UNION ALL SELECT k, n, 'User', 'users', 'post_count', 'Integer', false, false, false, NULL, NULL, NULL, 'sqlalchemy', 3
        FROM (SELECT c_custkey AS k, c_nationkey AS n FROM customer) a WHERE k % 3 = 0
      UNION ALL SELECT k, n, 'Post', 'posts', 'id', 'Integer', false, k % 5 > 0, k % 5 > 0, NULL, NULL, NULL, 'sqlalchemy', 5
        FROM (SELECT c_custkey AS k, c_nationkey AS n FROM customer) a
      UNION ALL SELECT k, n, 'Post', 'posts', 'user_id', CASE k % 3 WHEN 0 THEN 'BigInteger' WHEN 1 THEN 'Integer' ELSE 'String' END,
             k % 2 = 0, false, false, 'users', 'id', CASE WHEN k % 4 = 1 THEN 'SET NULL' END, 'sqlalchemy', 6
        FROM (SELECT c_custkey AS k, c_nationkey AS n FROM customer) a
      UNION ALL SELECT k, n, 'Post', 'posts', 'user_email', 'String', true, false, false, NULL, NULL, NULL, 'sqlalchemy', 7
        FROM (SELECT c_custkey AS k, c_nationkey AS n FROM customer) a WHERE k % 4 = 0
      UNION ALL SELECT k, n, 'Post', 'posts', 'price_total', CASE WHEN k % 6 = 0 THEN 'Float' ELSE 'Numeric(10, 2)' END, true, false, false,
             NULL, NULL, NULL, 'sqlalchemy', 8 FROM (SELECT c_custkey AS k, c_nationkey AS n FROM customer) a
      UNION ALL SELECT k, n, 'Note', 'notes', 'post_id', CASE WHEN k % 2 = 0 THEN 'Integer' ELSE 'String' END, true, false, false, NULL, NULL,
             NULL, 'sqlalchemy', 9 FROM (SELECT c_custkey AS k, c_nationkey AS n FROM customer) a
      UNION ALL SELECT k, n, 'Note', 'notes', 'item_id', 'Integer', true, false, false, NULL, NULL, NULL, 'sqlalchemy', 10
        FROM (SELECT c_custkey AS k, c_nationkey AS n FROM customer) a) cols"""
VIEWS["schema_indexes"] = """
    SELECT CAST(c_nationkey AS STRING) AS org_id, CAST(c_custkey AS STRING) AS repo_id, 'posts' AS tbl, 0 AS idx_seq,
           split('user_id,id', ',') AS cols, c_custkey % 14 = 0 AS is_unique FROM customer WHERE c_custkey % 7 = 0"""
VIEWS["schema_dialects"] = """
    SELECT CAST(c_nationkey AS STRING) AS org_id, CAST(c_custkey AS STRING) AS repo_id,
           CASE c_custkey % 4 WHEN 0 THEN 'postgresql' WHEN 1 THEN 'mysql' ELSE 'sqlite' END AS dialect
    FROM customer WHERE c_custkey % 5 > 0"""

VIEWS["migration_ops"] = """
    SELECT org_id, repo_id, tool, mig_seq, op_seq, kind, tbl, col, not_null, dflt, wherex, reads, to_type, downgrade FROM (
      SELECT CAST(c_nationkey AS STRING) AS org_id, CAST(o_custkey AS STRING) AS repo_id, 'alembic' AS tool, l_orderkey AS mig_seq,
             (CAST(l_linenumber AS BIGINT) * 1000003 + l_partkey) * 100003 + l_suppkey AS op_seq,
             split_part('drop_table|drop_column|truncate|delete|add_column|create_index|alter_type|set_not_null|add_fk|add_unique|update|create_table|rename_column',
                        '|', CAST(l_partkey % 13 AS INT) + 1) AS kind,
             split_part('users|posts|notes', '|', CAST(l_suppkey % 3 AS INT) + 1) AS tbl,
             split_part('id|email|user_id|gone', '|', CAST(l_suppkey % 4 AS INT) + 1) AS col,
             CASE WHEN l_quantity > 20 THEN 'true' ELSE 'false' END AS not_null,
             CASE WHEN l_linenumber % 2 = 0 THEN 'true' ELSE 'false' END AS dflt,
             CASE WHEN l_linenumber % 3 = 0 THEN 'true' ELSE 'false' END AS wherex,
             CASE WHEN l_linenumber % 2 = 0 THEN 'email,gone' ELSE 'users' END AS reads,
             CASE WHEN l_linenumber % 2 = 0 THEN 'varchar(90)' ELSE 'varchar(10)' END AS to_type,
             CASE WHEN l_orderkey % 4 = 0 THEN 'empty' ELSE 'present' END AS downgrade
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey) ops"""

# The same join as Spark builds it: orders meet customers first, and the reported rows are dealt by the audit they belong to, so
# what groups or joins them by audit finds them together. Integers are equal exactly when their digits are.
_OWNERS = [
    ("JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey",
     "JOIN (SELECT *, CAST(o_orderkey AS STRING) AS o_audit FROM orders JOIN customer ON o_custkey = c_custkey) owned "
     "ON CAST(l_orderkey AS STRING) = o_audit"),
    ("CAST(l_orderkey AS STRING) AS audit_id", "o_audit AS audit_id"),
]

_READS = re.compile(r"\b(?:FROM|JOIN)\s+([a-z_]+)\b")


def with_clause(names: list[str]) -> str:
    """CTE list of the given views and the views they read, dependencies first."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered or name not in VIEWS:
            return
        for ref in dict.fromkeys(_READS.findall(VIEWS[name])):
            if ref != name:
                visit(ref)
        ordered.append(name)

    for name in names:
        visit(name)
    return ", ".join(f"{name} AS ({VIEWS[name]})" for name in ordered)


def oracle(sql: str) -> str:
    """Check query with the views it mentions put in front."""
    used = [n for n in dict.fromkeys(_READS.findall(sql)) if n in VIEWS]
    views = with_clause(used)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        body, prefix = body[14:].strip(), "WITH RECURSIVE "
    elif body.upper().startswith("WITH"):
        body, prefix = body[4:].strip(), "WITH "
    else:
        return f"WITH {views} {body}" if views else body
    return prefix + (views + ", " if views else "") + body


class Tables:
    """Reads base tables and views of one scale-factor folder."""


    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name in VIEWS:
            return self.sql(f"SELECT * FROM {name}")
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        """Run a view-level SELECT with base tables bound as CTEs (no session-wide names)."""
        used = [n for n in dict.fromkeys(_READS.findall(text)) if n in VIEWS]
        views = with_clause(used)
        body = f"WITH {views} {text}" if views else text
        if "l_orderkey" in body:
            for written, built in _OWNERS:
                body = body.replace(written, built)
            # a join by audit and more takes rows dealt by audit as they lie; they are narrow when dealt and grow to ten
            # times that in the same task, so few of them make a task's share
            self.spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
            self.spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4m")
        tables = [n for n in BASE_TABLES if n in _READS.findall(body)]
        bound = ", ".join(f"{n} AS (SELECT * FROM parquet.`{self.folder}/{n}.parquet`)" for n in tables)
        return self.spark.sql(f"WITH {bound}, {body[5:]}" if views else f"WITH {bound} {body}")
