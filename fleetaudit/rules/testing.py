"""Test presence, ratio, kinds of tests, critical paths, error paths, and API surface rules over routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions.core import lookup
from ..functions.text import basename, is_test_path, language, path_tokens, split_lines, stem, url_segments
from ..operators import AUDIT
from ..operators.findings import top_k
from ..operators.graph import EXEMPT_DIRS, is_controller
from ..session import cut_lineage
from .engine import Pack, Rule, emit, emit_each, line_of, register, union

NAME = "testing"

# Patterns, names and limits.
SOURCE = r"(?i)\.(?:py|ts|tsx|js|jsx|mjs|cjs)$"
CI_FILES = (r"^(?:\.github/workflows/|(?:\.gitlab-ci\.yml|Jenkinsfile|\.circleci/config\.yml|azure-pipelines\.yml|"
            r"bitbucket-pipelines\.yml)$)")
CI_TESTS = (r"\b(?:pytest|tox|nox|python -m unittest|npm (?:run )?test|npm t\b|yarn test|pnpm test|jest|vitest|mocha|"
            r"go test|cargo test|mvn (?:-\S+ )*+test|gradlew? test|\./gradlew test|bundle exec rspec|rspec|phpunit|"
            r"dotnet test|make test|playwright test|cypress run)\b")
NPM_PLACEHOLDER = "no test specified"
API_CLIENT = (
    r"\btest_client\(|\bTestClient\(|\bAsyncClient\(|\bAPIClient\(|\bAPIRequestFactory\(|\bRequestFactory\(|"
    r"\bclient\.(?:get|post|put|patch|delete|options|head)\(|\bLiveServerTestCase\b|"
    r"from\s+django\.test\s+import[^\n]*\bClient\b|\bsupertest\b|\brequest\(\s*(?:app|server)\b|"
    r"\.inject\(\s*\{|\bapp\.request\(|\bnew\s+(?:Next)?Request\(|\bpactum\b|"
    r"\b(?:fetch|axios\.\w+|requests\.\w+|httpx\.\w+)\(\s*[\"'`]https?://(?:localhost|127\.0\.0\.1)")
INTEGRATION_PATH = r"(?i)(?:^|[/_.-])(?:integration|e2e|functional|acceptance|end[-_]?to[-_]?end)(?:[/_.-]|s/)"
DB_IN_TESTS = (
    r"\bcreate_all\(|\bdrop_all\(|\bdb\.session\b|\bsessionmaker\(|\bcreate_engine\(|testcontainers|"
    r"pytest\.mark\.django_db|from\s+django\.test\s+import[^\n]*\b(?:TestCase|TransactionTestCase)\b|"
    r"\bsqlite:|:memory:|DATABASE_UR[LI]|\bmongomock\b|mongodb-memory-server|MongoMemoryServer|fakeredis|"
    r"\bmongoose\.connect\(|\bsequelize\.sync\(|\bknex\.migrate|\bprisma\.\w+\.(?:create|deleteMany|findMany)\(|"
    r"\bTest\.createTestingModule\(|\bnew\s+Pool\(|\bdef\s+(?:db|database|db_session|session)\s*\(")
ERROR_CHECK = (
    r"pytest\.raises|assertRaises|\braises\(|status(?:_code)?\s*(?:==|!=|>=?|<=?|,)\s*[45]\d\d\b|"
    r"\b[45]\d\d\s*==\s*\w+\.status|\bHTTP_[45]\d\d(?:_|\b)|"
    r"HTTPStatus\.(?:BAD_REQUEST|UNAUTHORIZED|FORBIDDEN|NOT_FOUND|CONFLICT|UNPROCESSABLE_ENTITY|"
    r"INTERNAL_SERVER_ERROR)|\.expect\(\s*[45]\d\d\b|\btoThrow|\brejects\b|toBeRejected|assert\.(?:throws|rejects)|"
    r"\.(?:toBe|toEqual|toStrictEqual|equal|equals|is)\(\s*[45]\d\d\b")
JS_ERROR_SITE = r"\bthrow\b|\.status\(\s*[45]\d\d\b|\bsendStatus\(\s*[45]\d\d\b|\bstatus:\s*[45]\d\d\b"
JS_MATCHER = r"\.\s*((?:not\s*\.\s*)?to[A-Z]\w*)\s*\("
JS_TEST_BLOCK = (r"(?m)^\s*(?:it|test)(?:\.only)?\s*\(\s*[\"'`][^\n]*?(?:=>|function\s*\w*\s*\([^)]*\))\s*\{")
WEAK_MATCHERS = ["toBeTruthy", "toBeDefined", "toBeInstanceOf", "not.toBeNull", "not.toBeUndefined", "not.toBeFalsy"]
CRITICAL_NAMES = [
    "auth", "authentication", "authenticate", "login", "logout", "signin", "signout", "signup", "register",
    "registration", "password", "passwords", "oauth", "token", "tokens", "jwt", "permission", "permissions",
    "rbac", "acl", "payment", "payments", "pay", "billing", "checkout", "charge", "charges", "refund", "refunds",
    "invoice", "invoices", "subscription", "subscriptions", "webhook", "webhooks", "stripe", "paypal", "transfer",
    "transfers", "wallet", "withdraw", "withdrawal", "deposit",
]
GENERIC_MODULES = ["__init__", "__main__", "index", "main", "app", "conftest"]
LANGUAGE_GROUPS = {"typescript": "javascript", "vue": "javascript", "svelte": "javascript"}
PY_ROUTE_PATH = (r"""(?m)^\s*@\w+(?:\.(?!(?:route|get|post|put|patch|delete|api_route)\()\w+)*+"""
                 r"""\.(route|get|post|put|patch|delete|api_route)\(\s*[rf]?["']([^"']*)["']""")
JS_ROUTE_PATH = (r"""\b(?:app|router|server|api|\w+Router)\.(get|post|put|patch|delete|all)\(\s*["'`](/[^"'`\n]*)["'`]""")
DJANGO_PATH = r"""\b(?:re_)?path\(\s*r?["']([^"']*)["']"""
NEST_PREFIX = r"""@Controller\(\s*["'`]([^"'`]*)["'`]"""
NEST_ROUTE = r"""@(Get|Post|Put|Patch|Delete|All)\(\s*(?:["'`]([^"'`]*)["'`])?\s*\)"""
TEST_URL = r"""["'`](?:https?://[^/"'`\s]*)?(/(?:\$?\{[^{}\n]*\}|[^\s\\{"'`])*+)"""
VERSION_SEGMENT = r"(?i)(?:^|/)v\d+(?:\.\d+)?(?:/|$)|\{version\}|<(?:\w+:)?version>|:version\b"
VERSION_CODE = (r"(?i)api[_-]?version|accept-version|versioning|enableVersioning|@Version\(|"
                r"application/vnd\.")
IDEMPOTENCY = r"(?i)idempoten"
MONEY_WORDS = ["pay", "payment", "payments", "charge", "charges", "checkout", "order", "orders", "purchase",
               "purchases", "transfer", "transfers", "payout", "payouts", "refund", "refunds", "withdraw",
               "withdrawal", "withdrawals", "deposit", "deposits", "invoice", "invoices", "subscribe", "subscription",
               "subscriptions", "billing", "transaction", "transactions", "booking", "bookings", "reservation",
               "reservations", "donate", "donation", "donations", "remit", "topup"]
NOT_A_CREATE = ["webhook", "webhooks", "callback", "hook", "hooks", "notify", "ipn", "search", "query", "preview",
                "quote", "estimate", "calculate", "validate", "verify", "status", "filter", "lookup", "export",
                "report", "reports", "cancel", "list"]
JS_ERROR_BODY = r"\.status\(\s*[45]\d\d\s*\)\s*\.(?:json|send)\(\s*\{\s*([^{}]*)"
RATIO_MIN, LANGUAGE_MIN, SUITE_SITES, MODULE_SITES, SETUP_STATEMENTS, SETUP_TESTS = 200, 500, 5, 2, 3, 3
MIN_API_ROUTES, LISTED = 5, 12
# End of fixed values


def _r(seq: int, name: str, title: str, severity: str, confidence: str = "medium", kind: str = "potential",
       prefix: str = "testing", category: str = "testing") -> Rule:
    return Rule(f"{prefix}.{name}", title, category, severity, confidence, kind, seq=seq)


NO_TESTS = _r(1, "no-tests", "No automated tests found", "high", "high", "confirmed")
NO_LANGUAGE = _r(2, "language-without-tests", "No tests for a language", "low", "high", "confirmed")
LOW_RATIO = _r(3, "low-test-ratio", "Very low test-to-code ratio", "medium")
MODEST_RATIO = _r(4, "modest-test-ratio", "Modest test-to-code ratio", "low")
NPM_TEST = _r(5, "npm-default-test-script", "npm test script is the default placeholder", "medium", "high", "confirmed")
CI_SKIPS = _r(6, "ci-does-not-run-tests", "CI does not appear to run the test suite", "medium")
NO_API_TESTS = _r(7, "missing-api-tests", "No API tests", "medium")
NO_INTEGRATION = _r(8, "missing-integration-tests", "No integration tests against the datastore", "medium")
CRITICAL = _r(9, "untested-critical-paths", "Critical paths without tests", "medium")
NO_ERROR_TESTS = _r(10, "no-error-path-tests", "Tests only cover the happy path", "medium")
ERROR_PATHS = _r(11, "untested-error-paths", "Error paths are not tested", "low")
SETUP = _r(12, "duplicated-test-setup", "Test setup is copied", "low")
WEAK = _r(13, "weak-assertions", "Tests only make weak assertions", "low")
UNVERSIONED = _r(1, "unversioned", "API routes without versioning", "low", "low", prefix="api", category="api")
NOT_IDEMPOTENT = _r(2, "missing-idempotency", "Payment or order endpoint without idempotency", "medium", "low",
                    prefix="api", category="api")
ERROR_FORMAT = _r(3, "inconsistent-error-format", "Error responses differ", "low", prefix="api", category="api")


def _filled() -> Column:
    return F.size(F.filter(split_lines("text"), lambda t: F.trim(t) != ""))


def code_sizes(files: DataFrame) -> DataFrame:
    """(audit, path, lang, test, lines): non-blank lines of every code file."""
    lang = language("path")
    group = F.coalesce(lookup(lang, LANGUAGE_GROUPS), lang)
    return files.filter(lang.isin(*V.CODE_LANGUAGES)).select(
        *AUDIT, "path", group.alias("lang"), is_test_path("path").alias("test"), _filled().alias("lines"))


def test_ratio(sizes: DataFrame) -> DataFrame:
    """Source and test lines per audit."""
    return sizes.groupBy(*AUDIT).agg(
        F.sum(F.when(~F.col("test"), F.col("lines")).otherwise(0)).alias("source_lines"),
        F.sum(F.when(F.col("test"), F.col("lines")).otherwise(0)).alias("test_lines"),
        F.count(F.when(F.col("test"), 1)).alias("tests"), F.count(F.when(~F.col("test"), 1)).alias("sources"))


def presence(files: DataFrame) -> DataFrame:
    """Missing tests, ratios and languages nobody tests."""
    sizes = cut_lineage(code_sizes(files))
    total = test_ratio(sizes)
    ratio = F.col("test_lines") / F.greatest(F.col("source_lines"), F.lit(1))
    by_lang = sizes.groupBy(*AUDIT, "lang").agg(
        F.sum(F.when(~F.col("test"), F.col("lines")).otherwise(0)).alias("loc"),
        F.count(F.when(F.col("test"), 1)).alias("_t"), F.min(F.when(~F.col("test"), F.col("path"))).alias("_first"))
    untested = by_lang.filter((F.col("_t") == 0) & (F.col("loc") >= LANGUAGE_MIN)).join(
        total.filter("tests > 0").select(*AUDIT), AUDIT, "left_semi")
    judged = (F.col("tests") > 0) & (F.col("source_lines") >= RATIO_MIN)
    return emit_each(total, NAME, [
        (F.col("tests") == 0, NO_TESTS, {"evidence": F.concat(
            F.lit("0 test files; "), F.col("sources").cast("string"), F.lit(" source files ("),
            F.col("source_lines").cast("string"), F.lit(" non-blank lines)"))}),
        (judged & (ratio < 0.1), LOW_RATIO), (judged & (ratio >= 0.1) & (ratio < 0.3), MODEST_RATIO),
    ]).unionByName(emit(untested, NAME, NO_LANGUAGE, path=F.col("_first"),
                        title=F.concat(F.lit("No tests for the "), F.col("lang"), F.lit(" code"))))


def scripts_and_ci(files: DataFrame) -> DataFrame:
    script = F.get_json_object("text", "$.scripts.test")
    npm = files.filter((basename("path") == "package.json") & script.contains(NPM_PLACEHOLDER))
    ci = F.col("path").rlike(CI_FILES)
    flags = files.groupBy(*AUDIT).agg(
        F.max(language("path").isin(*V.CODE_LANGUAGES) & is_test_path("path")).alias("_tests"),
        F.min(F.when(ci, F.col("path"))).alias("_ci"),
        F.max(F.when(ci, F.col("text").rlike(CI_TESTS))).alias("_runs"))
    return emit(npm, NAME, NPM_TEST, path=F.col("path")).unionByName(
        emit(flags.filter(F.col("_tests") & F.col("_ci").isNotNull() & ~F.col("_runs")), NAME, CI_SKIPS, path=F.col("_ci")))


def routes(files: DataFrame) -> DataFrame:
    """(audit, path, line_no, verb, route) of decorator, Express-style, Nest and Django routes."""
    def found(rows: DataFrame, pattern: str, verb: Column | None, group: int, prefix: Column | None = None) -> DataFrame:
        lines = rows.select(*AUDIT, "path", "text", F.posexplode(split_lines("text")).alias("_i", "_t"))
        hits = lines.select(*AUDIT, "path", (F.col("_i") + 1).alias("line_no"), *([prefix.alias("_p")] if prefix is not None else []),
                            F.explode(F.regexp_extract_all("_t", F.lit(pattern), F.lit(0))).alias("_m"))
        route = F.regexp_extract("_m", pattern, group)
        if prefix is not None:
            route = F.concat(F.lit("/"), F.array_join(F.filter(F.array(
                F.regexp_replace("_p", "^/+|/+$", ""), F.regexp_replace(route, "^/+|/+$", "")), lambda x: x != ""), "/"))
        return hits.select(*AUDIT, "path", "line_no", (F.lit("") if verb is None else verb).alias("verb"), route.alias("route"))

    py = files.filter(F.col("path").endswith(".py") & ~is_test_path("path"))
    js = files.filter(F.col("path").rlike(r"(?i)\.(?:ts|tsx|js|jsx|mjs|cjs)$") & ~is_test_path("path"))
    method = F.upper(F.regexp_extract("_m", PY_ROUTE_PATH, 1))
    flask = found(py, PY_ROUTE_PATH, F.when(method.isin("ROUTE", "API_ROUTE"), "").otherwise(method), 2)
    express = found(js, JS_ROUTE_PATH, F.upper(F.regexp_extract("_m", JS_ROUTE_PATH, 1)), 2)
    nest = found(js.filter(F.col("text").contains("@Controller(")), NEST_ROUTE,
                 F.upper(F.regexp_extract("_m", NEST_ROUTE, 1)), 2, F.regexp_extract("text", NEST_PREFIX, 1))
    django = found(files.filter(basename("path") == "urls.py"), DJANGO_PATH, None, 1)
    django = django.withColumn("route", F.concat(F.lit("/"), F.regexp_replace("route", r"^\^+|\$+$", "")))
    return union([flask, express, nest, django])


def _module(path="path") -> Column:
    return F.lower(F.substring_index(basename(path), ".", 1))


def _subject(path="path") -> Column:
    return F.regexp_replace(F.regexp_replace(_module(path), "^test_", ""), "_test$", "")


def _sources(files: DataFrame) -> DataFrame:
    exempt = F.arrays_overlap(F.split(F.lower(F.regexp_extract("path", r"^(.*)/[^/]*$", 1)), "/"),
                              F.array(*[F.lit(d) for d in EXEMPT_DIRS]))
    return files.filter(F.col("path").rlike(SOURCE) & ~is_test_path("path")).withColumn("_exempt", exempt)


def kinds(files: DataFrame, profile: DataFrame) -> DataFrame:
    """Suites without API tests or without integration tests."""
    tests = files.filter(language("path").isin(*V.CODE_LANGUAGES) & is_test_path("path"))
    suite = tests.groupBy(*AUDIT).agg(
        F.max(F.col("text").rlike(API_CLIENT)).alias("_api"),
        F.max(F.col("path").rlike(INTEGRATION_PATH) | F.col("text").rlike(DB_IN_TESTS)).alias("_db"))
    handlers = _sources(files).filter(is_controller()).groupBy(*AUDIT).agg(
        F.count(F.lit(1)).alias("n"), F.min("path").alias("_first"))
    stores = profile.filter("aspect = 'datastore'").select(*AUDIT).distinct()
    big = test_ratio(code_sizes(files)).filter(F.col("source_lines") >= RATIO_MIN).select(*AUDIT)
    return emit(handlers.join(suite.filter(~F.col("_api")), AUDIT), NAME, NO_API_TESTS, path=F.col("_first"), title=F.concat(
        F.lit("No API tests for "), F.col("n").cast("string"), F.lit(" route handler module(s)"))).unionByName(
        emit(suite.filter(~F.col("_db")).join(stores, AUDIT, "left_semi").join(big, AUDIT, "left_semi"), NAME, NO_INTEGRATION))


def untested_critical(files: DataFrame) -> DataFrame:
    """Critical modules and endpoints no test names, imports or calls: (audit, path, line_no, what).

    Mentions are distinct word tokens of the tests, endpoints meet test URLs on (audit, last route segments): both are
    equi-joins, so a large suite is never searched once per module.
    """
    tests = files.filter(language("path").isin(*V.CODE_LANGUAGES) & is_test_path("path"))
    words = tests.select(*AUDIT, F.explode(F.array_distinct(F.transform(
        F.regexp_extract_all("text", F.lit(r"\w+"), F.lit(0)), F.lower))).alias("name")).distinct()
    named = tests.select(*AUDIT, _subject().alias("name")).distinct()
    source = _sources(files).filter(~F.col("_exempt")).withColumn("name", _module()).filter(
        ~F.col("name").isin(*GENERIC_MODULES)
        & F.arrays_overlap(path_tokens(stem("path")), F.array(*[F.lit(c) for c in CRITICAL_NAMES])))
    tested = tests.select(*AUDIT).distinct()
    modules = source.join(tested, AUDIT, "left_semi").join(words, [*AUDIT, "name"], "left_anti").join(
        named, [*AUDIT, "name"], "left_anti").select(
        *AUDIT, "path", F.lit(None).cast("int").alias("line_no"), F.concat(F.lit("module "), "path").alias("what"))
    api = tests.filter(F.col("text").rlike(API_CLIENT)).select(*AUDIT).distinct()
    table = routes(files).withColumn("segs", url_segments("route"))
    crit = F.arrays_overlap(F.split(F.lower("route"), "[^a-z]+"), F.array(*[F.lit(c) for c in CRITICAL_NAMES]))
    table = table.filter(crit & F.exists("segs", lambda s: s != "*")).join(api, AUDIT, "left_semi")
    urls = tests.select(*AUDIT, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(TEST_URL), F.lit(1)))).alias("url"))
    urls = urls.select(*AUDIT, F.explode(F.when(F.col("url").endswith("/"), F.array(
        url_segments("url"), F.concat(url_segments("url"), F.array(F.lit("*"))))).otherwise(
        F.array(url_segments("url")))).alias("u")).distinct()
    # every suffix of a URL is a candidate; wildcards on either side are checked after the length join
    tails = urls.select(*AUDIT, F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("u"), F.lit(1))),
                        lambda k: F.slice("u", -k, k))).alias("tail")).filter(F.size("tail") > 0).distinct()
    tails = tails.withColumns({"n": F.size("tail"), "anchor": _anchor("tail")})
    probe = table.withColumn("n", F.size("segs")).withColumn("anchor", F.explode(F.array_distinct(F.concat(
        F.array(_anchor("segs")), F.array(F.lit("*"))))))
    wild = tails.withColumn("anchor", F.lit("*")).filter(F.exists("tail", lambda s: s == "*"))
    match = F.forall(F.zip_with("segs", "tail", lambda a, b: (a == b) | (a == "*") | (b == "*")), lambda x: x)
    called = probe.join(tails.unionByName(wild).distinct(), [*AUDIT, "n", "anchor"]).filter(match).select(
        *AUDIT, "path", "line_no", "route").distinct()
    endpoints = table.join(called, [*AUDIT, "path", "line_no", "route"], "left_anti").select(
        *AUDIT, "path", "line_no", F.concat(F.lit("endpoint "), F.when(
            F.col("verb") != "", F.concat("verb", F.lit(" "))).otherwise(""), "route").alias("what"))
    return modules.unionByName(endpoints)


def _anchor(segs: str) -> Column:
    """Last literal segment of a route."""
    return F.coalesce(F.element_at(F.filter(segs, lambda s: s != "*"), -1), F.lit("*"))


def critical_paths(files: DataFrame) -> DataFrame:
    rows = untested_critical(files).groupBy(*AUDIT).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("path", "line_no")).alias("at"))
    return emit(rows, NAME, CRITICAL, path=F.col("at.path"), line=F.col("at.line_no"),
                title=F.concat(F.col("n").cast("string"), F.lit(" critical path(s) without tests")))


def error_paths(files: DataFrame) -> DataFrame:
    """Suites that never expect an error, and modules whose own tests never do (JavaScript error sites)."""
    tests = files.filter(language("path").isin(*V.CODE_LANGUAGES) & is_test_path("path")).select(
        *AUDIT, _subject().alias("name"), F.col("text").rlike(ERROR_CHECK).alias("_checks"))
    suite = tests.groupBy(*AUDIT).agg(F.max("_checks").alias("_checks"))
    sites = _sources(files).filter(~F.col("_exempt") & ~F.col("path").endswith(".py")).select(
        *AUDIT, "path", _module().alias("name"), F.regexp_count("text", F.lit(JS_ERROR_SITE)).alias("n"),
        line_of("text", JS_ERROR_SITE).alias("line_no")).filter("n > 0")
    total = sites.groupBy(*AUDIT).agg(
        F.sum("n").alias("total"), F.min(F.struct(-F.col("n"), F.col("path"), F.col("line_no"))).alias("top"))
    happy = total.filter(F.col("total") >= SUITE_SITES).join(suite.filter(~F.col("_checks")), AUDIT)
    own = tests.filter(~F.col("name").isin(*GENERIC_MODULES)).groupBy(*AUDIT, "name").agg(F.max("_checks").alias("_own"))
    blind = sites.filter(F.col("n") >= MODULE_SITES).join(suite.filter("_checks").select(*AUDIT), AUDIT, "left_semi").join(
        own.filter(~F.col("_own")), [*AUDIT, "name"])
    return emit(happy, NAME, NO_ERROR_TESTS, path=F.col("top.path"), line=F.col("top.line_no")).unionByName(
        emit(blind, NAME, ERROR_PATHS, path=F.col("path"), line=F.col("line_no"),
             title=F.concat(F.lit("Error paths in "), F.col("path"), F.lit(" are not tested"))))


def weak_assertions(files: DataFrame) -> DataFrame:
    tests = files.filter(F.col("path").rlike(r"(?i)\.(?:ts|tsx|js|jsx|mjs|cjs)$") & is_test_path("path"))
    names = F.transform(F.regexp_extract_all("text", F.lit(JS_MATCHER), F.lit(1)), lambda m: F.regexp_replace(m, r"\s+", ""))
    rows = tests.withColumn("_m", names).filter((F.size("_m") > 0) & F.forall("_m", lambda m: m.isin(*WEAK_MATCHERS)))
    return emit(rows, NAME, WEAK, path=F.col("path"))


def duplicated_setup(files: DataFrame) -> DataFrame:
    """The same first three statements opening at least three JavaScript tests of an audit."""
    tests = files.filter(F.col("path").rlike(r"(?i)\.(?:ts|tsx|js|jsx|mjs|cjs)$") & is_test_path("path"))
    rows = tests.select(*AUDIT, "path", F.posexplode(F.split("text", JS_TEST_BLOCK)).alias("_i", "body")).filter("_i > 0")
    lines = F.filter(F.transform(F.split("body", "\n"), lambda s: F.trim(s)), lambda t: (t != "") & ~t.startswith("//"))
    rows = rows.withColumn("_h", F.slice(lines, 1, SETUP_STATEMENTS)).filter(
        (F.size("_h") == SETUP_STATEMENTS) & ~F.exists("_h", lambda t: t.rlike(r"^\}|^expect\(|^assert")))
    heads = rows.groupBy(*AUDIT, F.sha1(F.array_join("_h", "\n")).alias("head")).agg(
        F.count(F.lit(1)).alias("n"), F.min("path").alias("path")).filter(F.col("n") >= SETUP_TESTS)
    return emit(heads, NAME, SETUP, path=F.col("path"),
                title=F.concat(F.lit("Test setup is copied into "), F.col("n").cast("string"), F.lit(" tests")))


def testing(tables: dict[str, DataFrame]) -> DataFrame:
    files = tables["files"]
    return union([presence(files), scripts_and_ci(files), kinds(files, tables["profile"]), critical_paths(files),
                  error_paths(files), weak_assertions(files), duplicated_setup(files)])


register(Pack(NAME, "Testing practices", ("testing",), testing, tuple(V.CODE_LANGUAGES)))


# --- API design ------------------------------------------------------------------------------------
def versioning(files: DataFrame, table: DataFrame) -> DataFrame:
    coded = files.filter(F.col("text").rlike(VERSION_CODE)).select(*AUDIT).distinct()
    rows = table.filter(~F.col("route").rlike("(?i)graphql")).groupBy(*AUDIT).agg(
        F.count(F.when(F.col("route").startswith("/api"), 1)).alias("n"),
        F.max(F.col("route").rlike(VERSION_SEGMENT)).alias("_v"),
        F.min(F.when(F.col("route").startswith("/api"), F.struct("path", "line_no"))).alias("at")).filter(
        (F.col("n") >= MIN_API_ROUTES) & ~F.col("_v")).join(coded, AUDIT, "left_anti")
    return emit(rows, "api_design", UNVERSIONED, path=F.col("at.path"), line=F.col("at.line_no"),
                title=F.concat(F.col("n").cast("string"), F.lit(" API routes without versioning")))


def idempotency(files: DataFrame, table: DataFrame) -> DataFrame:
    handled = files.filter(F.col("text").rlike(IDEMPOTENCY)).select(*AUDIT).distinct()
    words = F.split(F.lower("route"), "[^a-z]+")
    rows = table.filter(
        (F.col("verb") == "POST") & F.arrays_overlap(words, F.array(*[F.lit(w) for w in MONEY_WORDS]))
        & ~F.arrays_overlap(words, F.array(*[F.lit(w) for w in NOT_A_CREATE]))).join(handled, AUDIT, "left_anti")
    return emit(rows, "api_design", NOT_IDEMPOTENT, path=F.col("path"), line=F.col("line_no"), title=F.concat(
        F.lit("Payment or order endpoint without idempotency: POST "), F.col("route")))


def error_formats(files: DataFrame) -> DataFrame:
    """Error bodies by their field names; the second most common shape is the outlier."""
    js = files.filter(F.col("path").rlike(r"(?i)\.(?:ts|tsx|js|jsx|mjs|cjs)$") & ~is_test_path("path"))
    rows = js.select(*AUDIT, "path", F.posexplode(split_lines("text")).alias("_i", "_t")).select(
        *AUDIT, "path", (F.col("_i") + 1).alias("line_no"), F.regexp_extract("_t", JS_ERROR_BODY, 1).alias("_b")).filter("_b <> ''")
    keys = F.array_sort(F.array_distinct(F.regexp_extract_all("_b", F.lit(r"(?:^|,)\s*[\"']?(\w+)[\"']?\s*(?=:|,|$|\})"), F.lit(1))))
    shapes = rows.groupBy(*AUDIT, F.array_join(keys, ", ").alias("shape")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("path", "line_no")).alias("at"))
    totals = shapes.groupBy(*AUDIT).agg(F.count(F.lit(1)).alias("shapes"), F.sum("n").alias("errors")).filter(
        (F.col("shapes") >= 2) & (F.col("errors") >= 4))
    second = top_k(shapes, AUDIT, [F.col("n").desc(), F.col("shape")], 2).filter("rank = 2")
    rows = second.join(totals, AUDIT)
    return emit(rows, "api_design", ERROR_FORMAT, path=F.col("at.path"), line=F.col("at.line_no"), title=F.concat(
        F.lit("Error responses use "), F.col("shapes").cast("string"), F.lit(" different formats")))


def api_design(tables: dict[str, DataFrame]) -> DataFrame:
    files = tables["files"]
    table = routes(files)
    return union([versioning(files, table), idempotency(files, table), error_formats(files)])


register(Pack("api_design", "API design", ("api",), api_design))
