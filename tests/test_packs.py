"""Positive and negative repositories per rule pack."""

import pytest

from fleetaudit.rules.engine import packs
from fleetaudit.rules.packs import prepare

DOCKERFILE = """FROM python
ENV DB_PASSWORD=hunter22
RUN curl https://x.sh | sh
FROM python AS app
ADD https://x/y.tgz /
CMD flask run
"""
WORKFLOW = """name: ci
on: push
jobs:
  test:
    steps:
      - uses: actions/checkout@v4
      - run: echo "${{ github.event.issue.title }}"
  build:
    needs: lint
    steps:
      - run: make
  deploy:
    needs: [build]
    steps:
      - run: kubectl apply -f k8s
"""
COMPOSE = """services:
  db:
    image: postgres
    ports:
      - "5432:5432"
  app:
    privileged: true
    mem_limit: 1g
"""
K8S = """apiVersion: apps/v1
kind: Deployment
metadata:
  name: web
spec:
  template:
    spec:
      containers:
        - image: web:latest
"""
SERVER = """const session = require('express-session')
const users = {}
app.use(session({ secret: 's' }))
app.use(cors())
app.post('/login', requireAuth, (req, res) => {
  users[req.body.id] = 1
  console.log(req.body.password)
  res.cookie('session_token', token)
  fs.readFileSync('x')
})
app.get('/orders/:id', requireAuth, (req, res) => {
  Order.findById(req.params.id)
  try { x() } catch (e) {}
  res.status(500).json({ error: err.stack })
})
const key = process.env.STRIPE_KEY
const other = process.env.OTHER_KEY
const third = process.env.THIRD_KEY
fetch("http://localhost:3000/x")
"""


def rules(files, names=None):
    tables = prepare(files)
    out = set()
    for pack in packs(names):
        for r in pack.run(tables).select("rule_id", "file_path", "line_start").collect():
            out.add((r.rule_id.split(":", 1)[1], r.file_path, r.line_start))
    return out


def test_devops_rules(repo):
    files = repo({"Dockerfile": DOCKERFILE, ".github/workflows/ci.yml": WORKFLOW, "docker-compose.yml": COMPOSE,
                  "k8s/web.yaml": K8S})
    got = rules(files, ["devops"])
    for want in [
        ("devops.dockerfile-unpinned-base", "Dockerfile", 1), ("devops.dockerfile-secret-in-env", "Dockerfile", 2),
        ("devops.dockerfile-curl-pipe-shell", "Dockerfile", 3), ("devops.dockerfile-add-url", "Dockerfile", 5),
        ("devops.dockerfile-runs-as-root", "Dockerfile", 4), ("devops.dockerfile-no-healthcheck", "Dockerfile", None),
        ("devops.missing-dockerignore", "", None), ("devops.dev-server-in-production", "Dockerfile", 6),
        ("devops.gha-default-permissions", ".github/workflows/ci.yml", None),
        ("devops.gha-script-injection", ".github/workflows/ci.yml", 7),
        ("devops.gha-unpinned-actions", ".github/workflows/ci.yml", 6),
        ("devops.ci-no-tests", ".github/workflows/ci.yml", None),
        ("devops.deploy-without-test-gate", ".github/workflows/ci.yml", 12),
        ("devops.no-rollback-strategy", ".github/workflows/ci.yml", 12),
        ("devops.no-environment-separation", ".github/workflows/ci.yml", 12),
        ("devops.compose-db-port-exposed", "docker-compose.yml", 5), ("devops.compose-privileged", "docker-compose.yml", 7),
        ("devops.compose-no-resource-limits", "docker-compose.yml", 2),
        ("devops.k8s-no-resource-limits", "k8s/web.yaml", 2), ("devops.k8s-no-probes", "k8s/web.yaml", 2),
        ("devops.k8s-runs-as-root", "k8s/web.yaml", 2), ("devops.k8s-unpinned-image", "k8s/web.yaml", 9),
    ]:
        assert want in got, want
    assert not any(r == "devops.no-ci" for r, _, _ in got)


def test_pinned_container_is_quiet(repo):
    files = repo({"Dockerfile": "FROM python:3.12\nUSER app\nHEALTHCHECK CMD true\n", ".dockerignore": ".git\n",
                  ".github/workflows/ci.yml": "permissions: read-all\njobs:\n  t:\n    steps:\n      - run: pytest\n"})
    assert rules(files, ["devops"]) == set()


def test_needs_closure(repo):
    from fleetaudit.rules.devops import workflow_jobs

    rows = {r.name: r.closure for r in workflow_jobs(repo({".github/workflows/c.yml": (
        "jobs:\n  a:\n    steps: []\n  b:\n    needs: a\n  c:\n    needs:\n      - b\n  d:\n    needs: [c, zzz]\n")})).collect()}
    assert rows == {"a": [], "b": ["a"], "c": ["a", "b"], "d": ["a", "b", "c"]}


def test_web_rules(repo):
    files = repo({"package.json": '{"dependencies": {"express": "1.0.0", "express-session": "1"}}', "src/server.js": SERVER})
    got = rules(files, ["api", "auth", "configuration", "performance", "maintainability"])
    path = "src/server.js"
    for want in [
        ("api.cors-wildcard", path, 4), ("api.insecure-cookie", path, 8), ("api.sensitive-data-logged", path, 7),
        ("api.error-details-exposed", path, 14), ("api.idor-unscoped-lookup", path, 12), ("api.express-no-helmet", "", None),
        ("api.no-rate-limiting", "", None), ("auth.express-no-csrf", path, 5), ("config.hardcoded-endpoint", path, 19),
        ("config.no-env-example", path, 17), ("performance.sync-io-in-server", path, 9),
        ("performance.in-process-state", path, 6), ("performance.memory-session-store", path, 3),
        ("maintainability.swallowed-exception", path, 13),
    ]:
        assert want in got, (want, sorted(got))


def test_observability_and_testing(repo):
    files = repo({"requirements.txt": "flask==1.0\n", "app.py": "import flask\n@app.route('/x')\ndef x():\n    pass\nprint(1)\n"})
    got = {r for r, _, _ in rules(files, ["observability", "testing"])}
    assert {"devops.no-health-endpoint", "devops.no-metrics", "devops.no-error-tracking", "devops.no-tracing",
            "devops.no-request-id", "devops.print-logging", "testing.no-tests"} <= got


def test_critical_paths_and_error_paths(repo):
    src = "throw new Error('a')\nthrow new Error('b')\napp.post('/payments/:id', (req, res) => {})\napp.post('/login', h)\n"
    files = repo({"src/billing.js": src, "src/auth.js": "export const a = 1\n",
                  "tests/auth.test.js": "import request from 'supertest'\ntest('a', () => { request(app).post('/login') })\n"})
    got = rules(files, ["testing"])
    assert ("testing.untested-critical-paths", "src/billing.js", None) in got or any(
        r == "testing.untested-critical-paths" for r, _, _ in got)
    from fleetaudit.rules.testing import untested_critical

    what = {r.what for r in untested_critical(files).collect()}
    assert what == {"module src/billing.js", "endpoint POST /payments/:id"}


def test_secrets_and_placeholders(repo):
    files = repo({"a.py": "x = 1\nkey = 'AKIA" + "A" * 16 + "'\n# TODO implement this\npassword = 'changeme'\n",
                  "tests/test_a.py": "# in a real application this differs\n"})
    got = rules(files, ["secrets", "ai_code"])
    assert got == {("secrets.aws-access-key", "a.py", 2), ("ai-code.placeholder-logic", "a.py", 3),
                   ("ai-code.placeholder-value", "a.py", 4)}


def test_duplicated_code_and_readme(repo):
    block = "\n".join(f"value_{i} = compute({i})" for i in range(14))
    files = repo({"a.py": block, "b.py": block + "\nextra = 1\n", "c.py": "pass\n"})
    got = rules(files, ["maintainability"])
    assert ("maintainability.duplicated-code", "a.py", 1) in got
    assert ("maintainability.no-readme", "", None) in got
    assert sum(r == "maintainability.duplicated-code" for r, _, _ in got) == 1


def test_architecture(repo):
    files = repo({"app/__init__.py": "", "app/models.py": "from app.services import x\n",
                  "app/services.py": "from .models import y\nimport app.routes\n",
                  "app/routes.py": "@app.route('/x')\ndef x():\n    db.session.commit()\n",
                  "web/a.js": "import b from './b'\n", "web/b.ts": "import a from './a'\n"})
    got = rules(files, ["architecture"])
    assert ("architecture.import-cycle", "app/models.py", None) in got
    assert ("architecture.import-cycle", "web/a.js", None) in got
    assert ("architecture.dependency-direction", "app/services.py", None) in got
    assert ("architecture.data-access-in-handlers", "app/routes.py", 3) in got


def test_registry_rejects_unknown_names():
    with pytest.raises(ValueError, match="unknown"):
        packs(["nope"])
