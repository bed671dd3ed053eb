"""Inputs far longer than any stack: no pattern may need a frame per repetition, and nothing is cut."""

import pytest
from pyspark.sql import functions as F

from fleetaudit.functions import text as X
from fleetaudit.functions.versions import version_tuple
from fleetaudit.operators import graph as G
from fleetaudit.rules import code as CODE
from fleetaudit.rules import devops as DO
from fleetaudit.rules import testing as T
from fleetaudit.rules import web as W
from fleetaudit.sources import manifests as MF
from fleetaudit.sources import reports as RP

N = 20_000
WIDE = 200_000


def test_pnpm_lock_of_many_packages(repo):
    packages = "".join(f"  'p{i}@1.0.{i}':\n    resolution: x\n" for i in range(N))
    importers = "importers:\n  .:\n    dependencies:\n" + "".join(f"      p{i}:\n        specifier: ^{i}\n        version: 1\n" for i in range(N))
    files = repo({"pnpm-lock.yaml": f"lockfileVersion: 6\n\n{importers}\npackages:\n\n{packages}\nsnapshots:\n  z@1.0.0:\n    x: 1\n"})
    assert MF.pnpm_versions(files).count() == N
    rows = {r["name"]: r["spec"] for r in MF.pnpm_specifiers(files).collect()}
    assert len(rows) == N and rows["p7"] == "^7"
    old = repo({"pnpm-lock.yaml": "specifiers:\n" + "".join(f"  p{i}: ^{i}\n" for i in range(N)) + "\npackages:\n\n  /a/1.0.0_b:\n    d: 1\n"})
    assert MF.pnpm_specifiers(old).count() == N
    assert [(r["name"], r["version"]) for r in MF.pnpm_versions(old).collect()] == [("a", "1.0.0")]


def test_yarn_and_poetry_locks_of_many_packages(repo):
    yarn = "".join(f'p{i}@^1.0.0:\n  version "1.0.{i}"\n\n' for i in range(N))
    poetry = "".join(f'[[package]]\nname = "p{i}"\nversion = "1.{i}"\n\n' for i in range(N))
    files = repo({"yarn.lock": yarn, "poetry.lock": poetry})
    assert MF.yarn_lock_entries(files).count() == N and MF.toml_lock_packages(files).count() == N


def test_compose_and_workflow_of_many_children(repo):
    compose = "version: '3'\nservices:\n" + "".join(f"  s{i}:\n    image: x\n" for i in range(N)) + "volumes:\n  v:\n"
    rows = DO.compose_limits(repo({"docker-compose.yml": compose})).collect()
    assert [r["title"] for r in rows] == [f"{N} Compose service(s) without memory/CPU limits"] and rows[0]["line_start"] == 3
    jobs = "on: push\njobs:\n" + "".join(f"  j{i}:\n    steps:\n      - run: echo\n" for i in range(2000))
    needs = "  last:\n    needs:\n" + "".join(f"      - j{i}\n" for i in range(2000)) + "    steps:\n      - run: kubectl apply\n"
    found = DO.yaml_children(repo({".github/workflows/ci.yml": jobs + needs}), "jobs")
    assert found.count() == 2001
    steps = "jobs:\n  a:\n    steps:\n" + "".join(f"      - run: echo {i}\n" for i in range(N))
    assert DO.yaml_children(repo({".github/workflows/ci.yml": steps}), "jobs").count() == 1


def test_kubernetes_metadata_of_many_lines(repo):
    labels = "".join(f"    l{i}: x\n" for i in range(N))
    text = f"apiVersion: apps/v1\nkind: Deployment\nmetadata:\n  labels:\n{labels}  name: web\nspec:\n  containers:\n    - image: a:1.0\n"
    assert {r["title"] for r in DO.kubernetes(repo({"k8s/web.yaml": text})).collect()} >= {"Deployment `web` has no resource limits"}


@pytest.mark.parametrize("pattern, text", [
    (W.IDENTIFIER, "a" + ".b" * WIDE), (W.GLOBAL_AUTH, "app.use(" + "a, " * WIDE + "auth)"), (T.TEST_URL, "'/" + "x" * WIDE + "'"),
    (T.TEST_URL, "'/" + "${a}" * WIDE), (G.PY_ROUTE, "@a" + ".b" * WIDE + ".get("), (T.PY_ROUTE_PATH, "@a" + ".b" * WIDE + ".get('x')"),
    (DO.TEST_COMMAND, "gradle " + "x " * WIDE + "test"), (DO.TEST_COMMAND, "mvn " + "-x " * WIDE + "verify"), (T.CI_TESTS, "mvn " + "-x " * WIDE + "test"),
], ids=lambda v: v[:24])
def test_patterns_on_long_texts(spark, pattern, text):
    row = spark.createDataFrame([(text,)], "t string").select(F.col("t").rlike(pattern).alias("hit")).first()
    assert row["hit"] in (True, False)


def test_log_calls_and_paths_on_long_texts(spark, repo):
    line = "logger.info('" + "x\\'" * WIDE + "', password)\n" + "console.log(\"" + "y" * WIDE + "\", user.token)\n"
    rows = W.logged_credentials(repo({"src/a.js": line})).collect()
    assert {r["line_start"] for r in rows} == {1, 2}
    many = "".join(f"console.log(password{i} + user.password)\n" for i in range(50))
    assert W.logged_credentials(repo({"src/a.js": many})).count() == 50
    df = spark.createDataFrame([("./" * WIDE + "a", "1" + ".2" * WIDE)], "p string, v string")
    assert df.select(X.norm_path("p") if hasattr(X, "norm_path") else F.length("p")).first() is not None
    assert df.select(version_tuple(F.col("v"))).first() is not None


def test_gradle_and_routes_still_match(spark):
    def hits(pattern, text):
        return spark.createDataFrame([(text,)], "t string").select(F.col("t").rlike(pattern)).first()[0]

    assert hits(DO.TEST_COMMAND, "./gradlew clean test") and hits(DO.TEST_COMMAND, "gradle build") and not hits(DO.TEST_COMMAND, "gradle jar latest")
    assert hits(G.PY_ROUTE, "@bp.api.get(") and hits(G.PY_ROUTE, "@app.route(") and not hits(G.PY_ROUTE, "@app.other(")
    assert hits(W.GLOBAL_AUTH, "app.use('/x', a, requireAuth)") and not hits(W.GLOBAL_AUTH, "app.use(authRouter)")


def test_nothing_is_cut(repo, spark):
    block = "\n".join(f"value_{i} = compute({i})" for i in range(20))
    files = {f"src/m{a}_{b}.py": block.replace("compute", f"compute{a}") for a in range(45) for b in range(2)}
    files["src/long_a.py"] = files["src/long_b.py"] = "\n".join(f"row_{i} = {i} + base" for i in range(6000))
    assert CODE.duplicated_code(repo(files)).count() == 46
    report = "[" + ",".join('{"code":"E1","filename":"a.py","message":"m","url":"","location":{"row":%d}}' % i for i in range(3000)) + "]"
    reports = spark.createDataFrame([("o", "r", "a", report)], "org_id string, repo_id string, audit_id string, report string")
    assert RP.ruff(reports).count() == 3000
    lines = "\n".join(f"src/a.ts({i},1): error TS2345: bad" for i in range(1, 500))
    assert RP.tsc(spark.createDataFrame([("o", "r", "a", lines)], reports.schema)).count() == 499
    body = '[{"filePath":"a.js","messages":[' + ",".join('{"ruleId":"r","message":"m","severity":2,"line":%d}' % i for i in range(300)) + "]}]"
    rows = RP.eslint(spark.createDataFrame([("o", "r", "a", body)], reports.schema))
    assert rows.select("emit_idx").distinct().count() == 300


def test_route_bodies_are_read_whole(repo):
    filler = "  work();\n" * 100
    text = f"app.get('/x/:id', requireAuth, (req, res) => {{\n{filler}  Item.findById(req.params.id);\n{filler}  if (req.user.id) return;\n}});\n"
    late = f"app.get('/y/:id', requireAuth, (req, res) => {{\n{filler}  Item.findById(req.params.id);\n}});\n"
    rows = W.unscoped_lookups(repo({"src/a.js": text + late})).collect()
    assert [r["line_start"] for r in rows] == [306]


def test_migration_of_many_steps(spark):
    """What an earlier step of the same migration did is told by name: first steps, never later or other migrations' ones."""
    from fleetaudit.operators import catalogue as CA

    n, kinds = 100_000, F.array(*(F.lit(k) for k in ("update", "set_not_null", "drop_column", "insert", "run_python", "create_table")))
    step = F.col("id")
    many = spark.range(n).select(F.lit(1).alias("mig_seq"), step.alias("op_seq"), F.element_at(kinds, (step % 2 + 1).cast("int")).alias("kind"),
                                 F.lit("t").alias("tbl"), F.format_string("c%d", F.floor(step / 2)).alias("col"), F.lit("x").alias("reads"))
    few = spark.createDataFrame([
        (2, 1, "drop_column", "t", "a", ""), (2, 2, "insert", "u", "z", "b,a"), (2, 3, "drop_column", "t", "b", ""), (2, 3, "insert", "u", "z", "c"),
        (2, 4, "drop_column", "t", "bc", ""), (2, 5, "drop_column", "new", "a", ""), (2, 6, "create_table", "new", None, ""),
        (3, 1, "set_not_null", "t", "c0", ""), (3, 2, "update", "t", "c0", ""), (3, 3, "set_not_null", "t", "c0", ""), (3, 4, "drop_table", "t", None, ""),
        (4, 1, "run_python", "t", "", ""), (4, 2, "drop_table", "v", None, ""), (5, 1, "drop_table", "?", None, "")],
        "mig_seq int, op_seq long, kind string, tbl string, col string, reads string")
    ops = many.unionByName(few).select(
        F.lit("o").alias("org_id"), F.lit("r").alias("repo_id"), F.lit("sql").alias("tool"), "*", F.create_map(F.lit("reads"), "reads").alias("detail"),
        F.lit(None).cast("string").alias("downgrade"), F.concat("mig_seq", F.lit(".sql")).alias("file"), F.col("op_seq").alias("line"))
    columns = spark.createDataFrame([], "org_id string, repo_id string, orm string, tbl string, col string")
    dialects = spark.createDataFrame([], "org_id string, repo_id string, dialect string")
    found = CA.migration_issues(ops, columns, dialects)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "collect_set(kind" not in plan
    seen = {(r["file"], r["line"]): r["severity"] for r in found.filter("file <> '1.sql'").collect()}
    assert seen == {("2.sql", 1): "medium", ("2.sql", 3): "low", ("2.sql", 4): "medium", ("3.sql", 1): "medium", ("3.sql", 2): "low",
                    ("3.sql", 3): "low", ("3.sql", 4): "medium", ("4.sql", 2): "low"}
    assert {(r["severity"], r["count"]) for r in found.filter("file = '1.sql' and title like 'SET NOT NULL%'").groupBy("severity").count().collect()} == {
        ("low", n // 2)}
