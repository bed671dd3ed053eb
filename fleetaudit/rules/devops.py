"""Container, Compose, workflow, Kubernetes and deployment rules.

Configuration files are parsed inside their own row: blocks come from splitting the text, stages and jobs from array
functions, so nothing here shuffles except the per-repository existence rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename, let, split_lines, yaml_section
from ..operators import AUDIT
from ..operators.findings import top_k
from ..session import cut_lineage
from ..sources.files import explode_lines
from .engine import Pack, Rule, emit, emit_each, finding, line_of, register, scan, selects, union

NAME = "devops"

# File classes and patterns.
CI_MARKERS = (r"^(?:\.github/workflows/|\.gitlab-ci\.yml|Jenkinsfile|\.circleci/config\.yml|azure-pipelines\.yml|"
              r"bitbucket-pipelines\.yml|\.travis\.yml|\.buildkite/|\.drone\.yml)")
DOCKERFILE = r"(?:^|/)Dockerfile[^/]*$|\.dockerfile$"
COMPOSE = r"(?:^|/)(?:docker-compose|compose)\.ya?ml$"
WORKFLOW = r"^\.github/workflows/.*\.ya?ml$"
SECRET_ENV = r"(?i)^\s*(?:ENV|ARG)\s+\w*(?:PASSWORD|SECRET|TOKEN|API_?KEY|PRIVATE_KEY)\w*[ =]\s*\S+"
SECRET_FILE = r"(?i)^\s*(?:ENV|ARG)\s+\w*_(?:FILE|PATH|DIR)\b"
PIPE_SHELL = r"(?:curl|wget)[^|]*\|\s*(?:sudo\s+)?(?:ba)?sh\b"
ADD_URL = r"(?i)^\s*ADD\s(?=.*\bhttps?://)"
DB_PORT = r"""^\s*-\s*["']?(?:0\.0\.0\.0:)?\d+:(?:5432|3306|6379|27017|9200|11211|5672|1433)(?!\d)["']?"""
LIMITS = r"(?m)^\s*(?:mem_limit|memswap_limit|cpus|mem_reservation|limits)\s*:"
UNTRUSTED = (
    r"\$\{\{\s*github\.event\.(?:issue\.title|issue\.body|pull_request\.title|pull_request\.body|comment\.body|"
    r"review\.body|review_comment\.body|pages\.[^}]*\.page_name|commits\.[^}]*\.message|head_commit\.message|"
    r"head_commit\.author\.(?:email|name)|pull_request\.head\.ref|pull_request\.head\.label|workflow_run\.head_branch)")
ACTION_USES = r"^\s*-?\s*uses:\s*([^@\s]+)@([^\s#]+)"
SCRIPT_KEY = r"^\s*(?:-\s+)?(?:run|script)\s*:(.*)$"
TEST_COMMAND = (
    r"(?i)\bpytest\b|\bunittest\b|\btox\b|\bnox\b|manage\.py\s+test|\b(?:npm|pnpm|yarn|bun)\s+(?:run\s+)?"
    r"(?:test|ci|check|verify)\b|\bnpx\s+(?:jest|vitest|mocha|playwright|cypress)|\bjest\b|\bvitest\b|\bmocha\b|"
    r"\bgo\s+test\b|\bcargo\s+test\b|\bmvnw?\s+(?:-\S+\s+)*+(?:test|verify|install)\b|\bgradlew?\s(?s:.*?)(?<=\s)"
    r"(?:test|check|build)\b|\bmake\s+(?:test|check|ci)\b|\bphpunit\b|\brspec\b|\bdotnet\s+test\b|"
    r"\bplaywright\s+test\b|\bcypress\s+run\b|\bctest\b|\bbazel\s+test\b")
DEPLOY_COMMAND = (
    r"(?i)\bkubectl\s+(?:apply|set\s+image|rollout\s+restart|replace)|\bhelm\s+(?:upgrade|install)\b|"
    r"\bterraform\s+apply\b|\bfly(?:ctl)?\s+deploy\b|\bvercel\b[^\n]*--prod|\bnetlify\s+deploy\b|"
    r"\baws\s+ecs\s+update-service\b|\baws\s+deploy\b|\bgcloud\s+(?:run|app|functions)\s+deploy\b|"
    r"\b(?:serverless|sls)\s+deploy\b|\bheroku\s+container:release\b|git\s+push\s+heroku|\beb\s+deploy\b|"
    r"\baz\s+webapp\b|\brailway\s+up\b|api\.render\.com/deploy|appleboy/ssh-action|\bssh\s+[^\n]*@|\brsync\s")
ROLLBACK = (r"(?i)roll[- ]?back|rollout\s+undo|helm\s+rollback|--atomic|blue[- ]?green|canary|"
            r"previous\s+(?:release|version|image|deployment)|revert\s+(?:the\s+)?deploy|"
            r"deployment_circuit_breaker|deploymentCircuitBreaker")
ENV_NAME = r"(?i)\b(?:staging|stage|preview|pre-?prod|qa|uat|sandbox)\b"
MUTABLE_IMAGE = (r"(?i)(?:docker\s+push\s+|--image[= ]|set\s+image\s+\S+=|image:\s*)[\"']?[\w./${}:-]+:latest\b")
DEBUG_SETTING = (
    r"""(?i)\b(?:DEBUG|FLASK_DEBUG|APP_DEBUG|DJANGO_DEBUG)\s*[=:]\s*["']?(?:1|true|yes|on)\b["']?|"""
    r"""\b(?:FLASK_ENV|NODE_ENV|APP_ENV|RAILS_ENV|ENVIRONMENT)\s*[=:]\s*["']?(?:development|dev)\b""")
K8S_DEBUG_ENV = (
    r"""(?i)(?:name|key):\s*["']?(?:DEBUG|FLASK_DEBUG|APP_DEBUG|DJANGO_DEBUG)["']?\s*\n\s*value:\s*["']?"""
    r"""(?:1|true|yes|on)\b|(?:name|key):\s*["']?(?:FLASK_ENV|NODE_ENV|APP_ENV|RAILS_ENV)["']?\s*\n\s*value:\s*"""
    r"""["']?(?:development|dev)\b""")
DEV_SERVER = (
    r"(?i)\bflask[\"',\s]+run\b|manage\.py\b[\"',\s]+runserver\b|\b(?:npm|pnpm|yarn|bun)[\"',\s]+(?:run[\"',\s]+)?dev\b|"
    r"\bnodemon\b|\bng[\"',\s]+serve\b|\bnext[\"',\s]+dev\b|\bvite[\"',\s]*(?:$|[\"\]]|--)|\b(?:uvicorn|gunicorn)\b"
    r"[^\n]*--reload\b|http\.server\b|webpack-dev-server|react-scripts[\"',\s]+start\b|--debug\b")
PROD_FILE = (r"(?i)(?:^|/)\.env\.(?:prod|production)(?:\.[\w-]+)?$|(?:^|/)(?:docker-)?compose[.-](?:prod|production)"
             r"[\w.-]*\.ya?ml$|(?-i)(?:^|/)(?:render\.yaml|fly\.toml|app\.yaml|Procfile|railway\.json|railway\.toml)$")
DEV_DOCKERFILE = (r"(?i)(?:^|/)(?:Dockerfile[.-](?:dev|development|local|test)|(?:dev|development|local|test)"
                  r"\.dockerfile)$")
K8S_WORKLOAD = r"(?m)^kind:\s*(Deployment|StatefulSet|DaemonSet|Job|CronJob|Pod|ReplicaSet)\s*$"
K8S_IMAGE = r"""(?m)^\s*-?\s*image:\s*["']?([^\s"'#]+)"""
# End of fixed values


def _r(seq: int, name: str, title: str, severity: str, confidence: str = "high", kind: str = "confirmed",
       **extra: str) -> Rule:
    return Rule(f"devops.{name}", title, "devops", severity, confidence, kind, seq=seq, **extra)


DOCKER_LINES = [
    _r(1, "dockerfile-secret-in-env", "Secret baked into image via ENV/ARG", "high", "medium", pattern=SECRET_ENV,
       unless=SECRET_FILE, path=DOCKERFILE, remediation="Pass secrets at runtime or as build secrets."),
    _r(2, "dockerfile-curl-pipe-shell", "Remote script piped to a shell", "medium", pattern=PIPE_SHELL,
       path=DOCKERFILE, remediation="Verify a checksum before executing."),
    _r(3, "dockerfile-add-url", "ADD with a remote URL", "low", pattern=ADD_URL, path=DOCKERFILE,
       remediation="Download with verification or COPY local files."),
]
UNPINNED_BASE = _r(4, "dockerfile-unpinned-base", "Base image is not pinned", "low", remediation="Pin a version tag.")
AS_ROOT = _r(5, "dockerfile-runs-as-root", "Container runs as root", "medium", remediation="Add an unprivileged USER.")
NO_HEALTHCHECK = _r(6, "dockerfile-no-healthcheck", "Dockerfile has no HEALTHCHECK", "info",
                    remediation="Add a HEALTHCHECK or probes.")
NO_IGNORE = _r(7, "missing-dockerignore", "Dockerfile without .dockerignore", "low", remediation="Add a .dockerignore.")
COMPOSE_LINES = [
    _r(8, "compose-privileged", "Privileged container", "high", pattern=r"^\s*privileged:\s*true", path=COMPOSE,
       remediation="Grant only the capabilities needed."),
    _r(9, "compose-db-port-exposed", "Data store port published on all interfaces", "medium", "medium",
       pattern=DB_PORT, path=COMPOSE, remediation="Bind the port to 127.0.0.1."),
    _r(10, "compose-docker-socket", "Docker socket mounted into container", "high",
       pattern=r"/var/run/docker\.sock", path=COMPOSE, remediation="Use a constrained proxy."),
]
COMPOSE_LIMITS = _r(11, "compose-no-resource-limits", "Compose services without memory/CPU limits", "low", "medium",
                    "potential", remediation="Set limits.")
PR_TARGET = _r(12, "gha-pull-request-target-checkout", "pull_request_target workflow checks out untrusted PR code",
               "high", pattern=r"(?s)(?=.*pull_request_target).*ref:\s*\$\{\{\s*github\.event\.pull_request\.head",
               path=WORKFLOW, remediation="Do not run pull-request code with secrets.")
GHA_PERMISSIONS = _r(13, "gha-default-permissions", "Workflow does not restrict GITHUB_TOKEN permissions", "low",
                     unless=r"(?m)^\s*permissions\s*:", path=WORKFLOW, remediation="Add read-only permissions.")
GHA_INJECTION = _r(14, "gha-script-injection", "Untrusted event data interpolated into a workflow", "high", "medium",
                   remediation="Pass the value through an environment variable.")
GHA_UNPINNED = _r(15, "gha-unpinned-actions", "Actions not pinned", "low", remediation="Pin full commit SHAs.")
NO_CI = _r(16, "no-ci", "No CI/CD pipeline configuration found", "medium", remediation="Add a pipeline.")
CI_NO_TESTS = _r(17, "ci-no-tests", "CI pipeline does not run tests", "medium", "medium", "potential",
                 remediation="Run the tests before merge.")
NO_TEST_GATE = _r(18, "deploy-without-test-gate", "Deploy job without a test job", "low", "medium", "potential",
                  remediation="Make the deploy job need the test job.")
MUTABLE_TAG = _r(19, "deploy-mutable-tag", "Deployment uses the mutable `:latest` image tag", "low",
                 remediation="Deploy version tags.")
NO_ENVIRONMENTS = _r(20, "no-environment-separation", "Deployments go straight to a single environment", "low",
                     "medium", "potential", remediation="Deploy to staging first.")
NO_ROLLBACK = _r(21, "no-rollback-strategy", "No rollback strategy found", "low", "medium", "potential",
                 remediation="Document the rollback command.")
K8S_LIMITS = _r(22, "k8s-no-resource-limits", "No resource limits", "low", remediation="Set resources.limits.")
K8S_PROBES = _r(23, "k8s-no-probes", "No probes", "low", remediation="Add readiness and liveness probes.")
K8S_ROOT = _r(24, "k8s-runs-as-root", "May run as root", "medium", remediation="Set runAsNonRoot.")
K8S_PRIVILEGED = _r(25, "k8s-privileged", "Privileged container", "high", remediation="Remove privileged mode.")
K8S_UNPINNED = _r(26, "k8s-unpinned-image", "Unpinned image", "low", remediation="Reference a version tag.")
DEBUG_CONFIG = _r(27, "debug-in-deployment-config", "Debug/development mode set in deployment configuration",
                  "medium", remediation="Turn debug off in deployment files.")
DEV_START = _r(28, "dev-server-in-production", "Container/platform starts a development server", "medium",
               remediation="Start a production server.")


def _numbered(text: str = "text") -> Column:
    """Lines of a file as structs of number and text."""
    return F.transform(split_lines(text), lambda t, i: F.struct((i + 1).alias("n"), t.alias("t")))


def dockerfiles(files: DataFrame) -> DataFrame:
    """Dockerfile rules that need stages: base images, final user, health check, debug and start command."""
    rows = files.filter(F.col("path").rlike(DOCKERFILE)).withColumn("_l", _numbered())
    froms = F.filter("_l", lambda x: F.upper(F.trim(x["t"])).startswith("FROM "))
    rows = rows.withColumn("_from", F.transform(froms, lambda x: F.struct(
        x["n"].alias("n"), F.filter(F.split(F.trim(x["t"]), r"\s+"), lambda w: ~w.startswith("--")).alias("w"))))
    names = F.transform("_from", lambda x: F.struct(x["n"].alias("n"), F.when(
        (F.size(x["w"]) >= 4) & (F.upper(F.get(x["w"], F.lit(2))) == "AS"), F.lower(F.get(x["w"], F.lit(3)))).alias("name")))
    rows = rows.withColumn("_names", names)

    def loose(x: Column) -> Column:
        image = F.coalesce(F.get(x["w"], F.lit(1)), F.lit(""))
        tag = F.element_at(F.split(image, "/"), -1)
        earlier = F.exists("_names", lambda s: (s["n"] < x["n"]) & (s["name"] == F.lower(image)))
        return (~F.coalesce(earlier, F.lit(False)) & (F.lower(image) != "scratch") & ~image.contains("$")
                & ~image.contains("@sha256:") & (~tag.contains(":") | tag.endswith(":latest")))

    path = F.col("path")
    bases = F.transform(F.filter("_from", loose), lambda f: finding(UNPINNED_BASE, path=path, line=f["n"]))
    last = F.coalesce(F.array_max(F.transform("_from", lambda x: x["n"])), F.lit(1))
    rows = rows.withColumns({"_last": last, "_bases": bases})
    final = F.filter("_l", lambda x: x["n"] >= F.col("_last"))
    users = F.transform(F.filter(final, lambda x: F.upper(F.trim(x["t"])).startswith("USER ")),
                        lambda x: F.trim(F.regexp_extract(F.trim(x["t"]), r"^\S+\s+(.*)$", 1)))
    user = F.element_at(F.concat(F.array(F.lit("root")), users), -1)
    health = F.exists("_l", lambda x: F.upper(F.trim(x["t"])).startswith("HEALTHCHECK"))
    debug = F.filter(final, lambda x: F.upper(F.trim(x["t"])).startswith("ENV ") & F.regexp_replace(
        F.trim(x["t"]), r"(?i)^ENV\s+(\w+)\s+(?!.*=)", "$1=").rlike(DEBUG_SETTING))
    start = F.filter(final, lambda x: F.upper(F.trim(x["t"])).rlike("^(?:CMD|ENTRYPOINT)") & F.trim(x["t"]).rlike(DEV_SERVER))
    live = ~path.rlike(DEV_DOCKERFILE)
    rows = rows.withColumns({
        "_user": user, "_health": health, "_debug": F.when(live, F.get(debug, F.lit(0))["n"]),
        "_start": F.when(live, F.array_max(F.transform(start, lambda x: x["n"])))})
    staged = F.size("_from") > 0
    return emit_each(rows, NAME, [
        (staged & F.col("_user").isin("root", "0", "0:0"), AS_ROOT, {"path": path, "line": F.col("_last")}),
        (staged & ~F.col("_health"), NO_HEALTHCHECK, {"path": path}),
        (F.col("_debug").isNotNull(), DEBUG_CONFIG, {"path": path, "line": F.col("_debug")}),
        (F.col("_start").isNotNull(), DEV_START, {"path": path, "line": F.col("_start")}),
    ], (F.col("_bases"),))


def yaml_children(files: DataFrame, key: str) -> DataFrame:
    """Children of a top-level YAML mapping: (audit, path, name, line_no, block). Blank and comment lines are left out.

    One walk over the numbered lines of a file; a child's block is a slice of them, so the work grows with the file only."""
    def starts(lines: Column, test) -> Column:
        return F.array_position(F.transform(lines, test), True).cast("int")

    def body(lines: Column) -> Column:
        return let(starts(lines, lambda x: x["t"].rlike(rf"^{key}\s*:[ \t]*$")), lambda at: F.when(at > 0, let(
            F.slice(lines, at + 1, F.size(lines)), lambda rest: let(starts(rest, lambda x: ~x["t"].rlike("^[ \t]")), lambda end: F.when(
                end > 0, F.slice(rest, 1, end - 1)).otherwise(rest)))))

    def children(own: Column) -> Column:
        indent = F.length(F.regexp_extract(F.get(own, F.lit(0))["t"], r"^([ \t]+)", 1))
        head = F.concat(F.lit("^[ \t]{"), indent.cast("string"), F.lit("}[^ \t]"))
        heads = F.filter(F.transform(own, lambda x, k: F.struct(k.alias("k"), x["n"].alias("n"), x["t"].alias("t"))), lambda x: F.rlike(x["t"], head))
        return let(heads, lambda hs: F.transform(hs, lambda h, j: F.struct(
            F.regexp_extract(h["t"], r"""^\s*["']?([\w.-]+)["']?\s*:\s*$""", 1).alias("name"), h["n"].alias("line_no"),
            F.array_join(F.transform(F.slice(own, h["k"] + 2, F.coalesce(F.get(hs, j + 1)["k"], F.size(own)) - h["k"] - 1),
                                     lambda x: x["t"]), "\n").alias("block"))))

    lines = F.transform(F.split("text", "\n"), lambda t, i: F.struct((i + 1).alias("n"), t.alias("t")))
    kept = F.filter(lines, lambda x: ~x["t"].rlike(r"^[ \t]*(?:#.*)?$"))
    found = let(kept, lambda every: let(body(every), lambda own: F.when(F.size(own) > 0, children(own))))
    rows = files.select(*AUDIT, "path", F.explode(found).alias("c")).select(*AUDIT, "path", "c.name", "c.line_no", "c.block")
    return rows.filter(F.col("name") != "")


def compose_limits(files: DataFrame) -> DataFrame:
    services = yaml_children(files.filter(F.col("path").rlike(COMPOSE)), "services").filter(~F.col("block").rlike(LIMITS))
    keys = [*AUDIT, "path"]
    first = top_k(services, keys, [F.col("line_no"), F.col("name")], 15).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("line_no", "name"))).alias("names"))
    rows = services.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("line_no")).join(first, keys)
    return emit(rows, NAME, COMPOSE_LIMITS, path=F.col("path"), line=F.col("line_no"),
                title=F.concat(F.col("n").cast("string"), F.lit(" Compose service(s) without memory/CPU limits")),
                evidence=F.concat(F.lit("no limits: "), F.array_join(F.col("names.name"), ", ")))


def workflows(files: DataFrame) -> DataFrame:
    """Token permissions, untrusted checkouts, script injection and unpinned actions."""
    flows = files.filter(F.col("path").rlike(WORKFLOW))
    path = F.col("path")

    def loose(x: Column) -> Column:
        action, ref = F.regexp_extract(x["t"], ACTION_USES, 1), F.regexp_extract(x["t"], ACTION_USES, 2)
        return (action != "") & ~action.startswith("./") & ~ref.rlike("^[0-9a-f]{40}$")

    # a line runs when it carries the run/script key inline, or lies deeper than the key that opened a block scalar
    rows = flows.withColumn("_l", _numbered())
    rows = rows.withColumns({"_u": F.filter("_l", loose), "_x": F.aggregate(
        "_l", F.struct(F.lit(-1).alias("open"), F.array().cast("array<int>").alias("hits")), _step)})
    injected = F.transform(F.col("_x.hits"), lambda n: finding(GHA_INJECTION, path=path, line=n))
    return emit_each(rows, NAME, [
        (selects(PR_TARGET), PR_TARGET, {"path": path, "line": line_of("text", r"pull_request\.head")}),
        (selects(GHA_PERMISSIONS), GHA_PERMISSIONS, {"path": path}),
        (F.size("_u") > 0, GHA_UNPINNED, {"path": path, "line": F.get("_u", F.lit(0))["n"], "title": F.concat(
            F.size("_u").cast("string"), F.lit(" third-party action reference(s) not pinned to a commit SHA"))}),
    ], (injected,))


def _step(acc: Column, x: Column) -> Column:
    lead = F.length(F.regexp_extract(x["t"], r"^([ \t]*)", 1))
    still = F.when((acc["open"] >= 0) & (F.trim(x["t"]) != "") & (lead <= acc["open"]), F.lit(-1)).otherwise(acc["open"])
    value = F.trim(F.regexp_extract(x["t"], SCRIPT_KEY, 1))
    is_key = x["t"].rlike(SCRIPT_KEY)
    scalar = is_key & value.rlike(r"^[|>][-+]?\s*(?:#.*)?$")
    runs = (still >= 0) | (is_key & ~scalar)
    key_at = F.length(F.regexp_extract(x["t"], r"^(\s*(?:-\s+)?)(?:run|script)\s*:", 1))
    return F.struct(
        F.when(scalar, key_at).otherwise(still).cast("int").alias("open"),
        F.when(runs & x["t"].rlike(UNTRUSTED), F.concat(acc["hits"], F.array(x["n"].cast("int")))).otherwise(acc["hits"])
        .alias("hits"))


def workflow_jobs(files: DataFrame) -> DataFrame:
    """Jobs of every workflow with what they need, directly and transitively.

    The closure stays inside the workflow's row: a workflow has a bounded number of jobs, so expanding the needs
    once per job reaches the fixpoint without any join.
    """
    jobs = yaml_children(files.filter(F.col("path").rlike(WORKFLOW)), "jobs")
    inline = F.regexp_extract("block", r"(?m)^\s+needs\s*:[ \t]*(\S.*)$", 1)
    listed = F.regexp_extract("block", r"(?m)^\s+needs\s*:[ \t]*\n((?:\s+-\s*[\"']?[\w.-]+.*(?:\n|\z))++)", 1)
    needs = F.regexp_extract_all(F.when(inline != "", inline).otherwise(
        F.regexp_replace(listed, r"(?m)^\s+-\s*[\"']?([\w.-]+).*$", "$1")), F.lit(r"[\w.-]+"), F.lit(0))
    jobs = jobs.withColumn("needs", needs)
    graph = jobs.groupBy(*AUDIT, "path").agg(F.map_from_entries(F.collect_list(F.struct("name", "needs"))).alias("g"))
    rows = jobs.join(graph, [*AUDIT, "path"])
    known = F.filter("needs", lambda n: F.map_contains_key("g", n))
    closure = F.aggregate(F.map_keys("g"), known, lambda acc, _: F.array_distinct(F.concat(acc, F.flatten(
        F.transform(acc, lambda j: F.filter(F.col("g")[j], lambda n: F.map_contains_key("g", n)))))))
    return rows.withColumn("closure", F.array_sort(closure)).drop("g")


def deployment(files: DataFrame) -> DataFrame:
    """Deploy jobs: test gate, mutable tags, environments and rollback."""
    jobs = workflow_jobs(files).withColumn("tests", F.col("block").rlike(TEST_COMMAND))
    tested = jobs.groupBy(*AUDIT, "path").agg(F.collect_set(F.when(F.col("tests"), F.col("name"))).alias("_tested"))
    chained = files.filter(F.col("path").rlike(WORKFLOW)).select(
        *AUDIT, "path", F.col("text").rlike(r"(?m)^\s*workflow_run\s*:").alias("_chained"))
    deploys = jobs.filter(F.col("block").rlike(DEPLOY_COMMAND) | F.col("name").rlike("(?i)deploy")).join(
        tested, [*AUDIT, "path"]).join(chained, [*AUDIT, "path"])
    open_gate = deploys.filter(~F.col("_chained") & ~F.col("tests") & ~F.arrays_overlap("closure", "_tested"))
    gate = emit(open_gate, NAME, NO_TEST_GATE, path=F.col("path"), line=F.col("line_no"), title=F.concat(
        F.lit("Deploy job `"), F.col("name"), F.lit("` does not depend on a test job")))
    mutable = deploys.withColumn("_at", line_of("block", MUTABLE_IMAGE)).filter(F.col("_at").isNotNull())
    tags = emit(mutable, NAME, MUTABLE_TAG, path=F.col("path"), line=F.col("line_no") + F.col("_at"))
    is_doc = F.lower("path").rlike(r"\.(?:md|rst|txt|sh|yml|yaml)$") | basename("path").isin("Makefile", "justfile", "Procfile")
    hints = files.groupBy(*AUDIT).agg(
        F.max(is_doc & F.col("text").rlike(ROLLBACK)).alias("_rollback"),
        F.max(F.col("path").rlike(ENV_NAME) | (F.col("path").rlike(WORKFLOW) & F.col("text").rlike(ENV_NAME))).alias("_envs"))
    first = deploys.groupBy(*AUDIT).agg(
        F.min(F.struct("path", "line_no")).alias("_any"),
        F.min(F.when(~F.col("block").rlike(r"(?m)^\s+environment\s*:"), F.struct("path", "line_no"))).alias("_bare"))
    rows = first.join(hints, AUDIT)
    return union([gate, tags, emit_each(rows, NAME, [
        (F.col("_bare").isNotNull() & ~F.col("_envs"), NO_ENVIRONMENTS,
         {"path": F.col("_bare.path"), "line": F.col("_bare.line_no")}),
        (~F.col("_rollback"), NO_ROLLBACK, {"path": F.col("_any.path"), "line": F.col("_any.line_no")})])])


def pipeline_presence(files: DataFrame) -> DataFrame:
    """Repositories without CI, CI without tests, and Dockerfiles without an ignore file."""
    ci = F.col("path").rlike(CI_MARKERS)
    flags = files.groupBy(*AUDIT).agg(
        F.max(ci).alias("_ci"), F.max(ci & F.col("text").rlike(TEST_COMMAND)).alias("_tests"),
        F.min(F.when(ci, F.col("path"))).alias("_first"), F.max(F.col("path").rlike(DOCKERFILE)).alias("_docker"),
        F.max(basename("path") == ".dockerignore").alias("_ignore"))
    return emit_each(flags, NAME, [
        (~F.col("_ci"), NO_CI), (F.col("_ci") & ~F.col("_tests"), CI_NO_TESTS, {"path": F.col("_first")}),
        (F.col("_docker") & ~F.col("_ignore"), NO_IGNORE)])


def kubernetes(files: DataFrame) -> DataFrame:
    """Workload documents: limits, probes, user, privileges, images and debug settings."""
    rows = files.filter(F.col("path").rlike(r"\.ya?ml$") & ~F.col("path").startswith(".github/")
                        & ~F.col("path").contains("node_modules/") & F.col("text").rlike(K8S_WORKLOAD)
                        & F.col("text").contains("containers:"))
    docs = F.split("text", r"(?m)^---\s*$")
    rows = rows.select(*AUDIT, "path", F.posexplode(docs).alias("_i", "doc"), docs.alias("_docs"))
    before = F.aggregate(F.slice("_docs", F.lit(1), F.col("_i")), F.lit(0), lambda acc, d: acc + F.length(d)
                         - F.length(F.replace(d, F.lit("\n"), F.lit(""))))
    rows = rows.withColumn("_base", before).filter(
        F.col("doc").rlike(K8S_WORKLOAD) & F.col("doc").contains("containers:") & ~F.col("doc").contains("{{"))
    kind = F.regexp_extract("doc", K8S_WORKLOAD, 1)
    name = F.regexp_extract(yaml_section(F.col("doc"), "metadata"), r"(?m)^[ \t]+name:\s*[\"']?([\w.-]+)", 1)
    rows = rows.withColumns({
        "kind_": kind, "label": F.concat(kind, F.lit(" `"), F.when(name == "", "?").otherwise(name), F.lit("`")),
        "line_no": F.col("_base") + line_of("doc", K8S_WORKLOAD),
        "image": F.get(F.filter(F.regexp_extract_all("doc", F.lit(K8S_IMAGE), F.lit(1)), _floating), F.lit(0))})

    doc = F.col("doc")
    explicit = doc.rlike(r"(?m)^\s*runAsUser:\s*0\s*$")
    debug = line_of("doc", K8S_DEBUG_ENV)
    head = F.call_function("substring_index", doc, F.col("image"), F.lit(1))
    image_line = F.col("_base") + F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1
    here = {"path": F.col("path"), "line": F.col("line_no")}

    def says(words: str) -> dict[str, Column]:
        return {**here, "title": F.concat("label", F.lit(words))}

    return emit_each(rows, NAME, [
        (~doc.rlike(r"(?m)^\s+limits\s*:"), K8S_LIMITS, says(" has no resource limits")),
        (F.col("kind_").isin("Deployment", "StatefulSet", "DaemonSet") & ~doc.rlike(r"livenessProbe|readinessProbe|startupProbe"),
         K8S_PROBES, says(" has no liveness/readiness probes")),
        (explicit | ~doc.rlike(r"runAsNonRoot:\s*true|runAsUser:\s*[1-9]"), K8S_ROOT, {
            **says(" may run containers as root"), "confidence": F.when(explicit, "high").otherwise("medium"),
            "kind": F.when(explicit, "confirmed").otherwise("potential")}),
        (doc.rlike(r"(?m)^\s*privileged:\s*true"), K8S_PRIVILEGED, says(" runs a privileged container")),
        (F.col("image").isNotNull(), K8S_UNPINNED, {**says(" uses an unpinned image"), "line": image_line}),
        (debug.isNotNull(), DEBUG_CONFIG, {**here, "line": F.col("_base") + debug}),
    ])


def _floating(image: Column) -> Column:
    tag = F.element_at(F.split(image, "/"), -1)
    return ~image.contains("@sha256:") & ~image.contains("$") & (~tag.contains(":") | tag.endswith(":latest"))


def deployment_config(files: DataFrame) -> DataFrame:
    """Debug settings and development servers in platform and production files."""
    rows = files.filter(F.col("path").rlike(PROD_FILE))
    at = F.coalesce(line_of("text", DEBUG_SETTING), line_of("text", K8S_DEBUG_ENV))
    web = F.when(basename("path") == "Procfile", F.get(F.filter(_numbered(), lambda x: (
        x["t"].rlike(r"^\s*(?:web|worker)\s*:") & x["t"].rlike(DEV_SERVER))), F.lit(0))["n"])
    return emit_each(rows.withColumns({"_at": at, "_web": web}), NAME, [
        (F.col("_at").isNotNull(), DEBUG_CONFIG, {"path": F.col("path"), "line": F.col("_at")}),
        (F.col("_web").isNotNull(), DEV_START, {"path": F.col("path"), "line": F.col("_web")})])


def config_set(files: DataFrame) -> DataFrame:
    """Container, pipeline and platform files only, written once for the rules below."""
    path = F.col("path")
    return cut_lineage(files.filter(
        path.rlike(DOCKERFILE) | path.rlike(CI_MARKERS) | path.rlike(PROD_FILE) | path.rlike(r"\.ya?ml$")
        | (basename("path") == ".dockerignore")).select(*AUDIT, "path", "text"))


def run(tables: dict[str, DataFrame]) -> DataFrame:
    files, config = tables["files"], config_set(tables["files"])
    every = tables["files"].select(*AUDIT).distinct().withColumns({"path": F.lit(""), "text": F.lit("")})
    return union([
        scan(explode_lines(config), [*DOCKER_LINES, *COMPOSE_LINES], NAME), dockerfiles(config), compose_limits(config),
        workflows(config), deployment(files), pipeline_presence(config.unionByName(every)), kubernetes(config),
        deployment_config(config)])


register(Pack(NAME, "DevOps & deployment configuration", ("devops",), run))
