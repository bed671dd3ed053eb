"""JavaScript line rules of the API, authentication, configuration and performance packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename, is_test_path, split_lines
from ..operators import AUDIT
from .engine import Pack, Rule, emit, emit_each, first_per_file, line_of, register, scan, union

# Patterns.
JS = r"(?i)\.(?:js|jsx|ts|tsx|mjs|cjs)$"
VENDORED = r"node_modules/"
CORS = r"\bcors\(\s*\)|origin\s*:\s*(?:['\"`]\*['\"`]|true\b)"
MASS_ASSIGNMENT = r"\b(?:create|update|insert|new\s+\w+|findOneAndUpdate|updateOne)\(\s*req\.body\s*[,)]"
TLS_OFF = r"rejectUnauthorized\s*:\s*false|NODE_TLS_REJECT_UNAUTHORIZED\s*=\s*['\"]?0"
JWT_NONE = r"(?i)algorithms\s*:\s*\[[^\]]*['\"]none['\"]"
ERROR_LEAK = r"\bres\.(?:status\(\s*\d+\s*\)\.)?(?:send|json|end|write)\([^;]*\b(?:err|error|e|ex)\.stack\b"
CLIENT_FILENAME = (r"(?:\b(?:cb|callback|done)\s*\(\s*null\s*,[^)]*|path\.(?:join|resolve)\([^)]*|"
                   r"(?:writeFile|createWriteStream|rename|\.mv)\w*\([^)]*)\boriginalname\b")
COOKIE_OFF = r"\b(httpOnly|secure)\s*:\s*false\b"
COOKIE_CONTEXT = r"(?i)cookie|session"
BARE_COOKIE = r"""\bres\.cookie\(\s*["'`]([\w.-]+)["'`]\s*,\s*[^,()]+(?:\([^()]*\))?\s*\)"""
SENSITIVE_COOKIE = r"(?i)(?:sess|token|auth|jwt|sid|remember|login|refresh|access|identity)"
LOG_CALL = (r"\b(?:console|logger|log|winston|pino|this\.logger)\.(?:log|info|warn|error|debug|trace)\s*\((.*)$")
IDENTIFIER = r"[A-Za-z_$][\w$]*+(?:\??\.[A-Za-z_$][\w$]*+)*+"
SENSITIVE_WORD = (r"(?:^|_)(?:password|passwd|passphrase|secret|secret_key|api_key|apikey|token|bearer|"
                  r"authorization|credential|credentials|private_key|card_number|cvv|cvc|ssn)(?:_|$)")
HARMLESS_PREFIX = ["is", "has", "num", "n", "len", "count", "max", "min", "should", "use", "needs", "show"]
HARMLESS_SUFFIX = [
    "id", "ids", "count", "len", "length", "type", "url", "uri", "expires", "expiry", "exp", "at", "hash", "hashed",
    "name", "field", "fields", "policy", "min", "max", "valid", "ok", "required", "set", "changed", "reset",
    "strength", "prefix", "hint", "label", "endpoint", "path", "file", "ttl", "age", "lifetime", "version", "status",
    "error", "errors", "scope", "scopes", "kind", "format", "size", "index", "idx", "usage", "limit", "mask",
    "masked", "redacted",
]
MASKING = (r"(?i)(?:mask|redact|hash|digest|\blen\b|\bbool\b|\btype\b|truncat|obfuscat|fingerprint|censor|scrub|"
           r"sanitiz|anonymi)")
ANY_ROUTE = r"""\b(?:app|router|server)\.(get|post|put|patch|delete|all)\(\s*["'`]([^"'`]+)["'`]\s*,(.*)$"""
AUTH_HINT = r"(?i)(?:auth|jwt|passport|session|requireUser|isAuthenticated|protect|guard|verify)"
GLOBAL_AUTH = (r"\.use\(\s*(?:[\"'`][^\"'`]*[\"'`]\s*,\s*)?(?:[\w.$]+\s*,\s*){0,40}(?![\w$]*(?:Router|Routes|router|routes)\b)"
               r"[\w.$]*(?:auth|Auth|jwt|Jwt|JWT|passport|requireUser|isAuthenticated|protect|guard|Guard)[\w.$]*\s*[(,)]")
LOOKUP_BY_PARAM = (r"\.(?:findById|findByPk|findOne|findUnique|findFirst|findOneBy|getById|findByIdAndUpdate|findByIdAndDelete|deleteOne|"
                   r"updateOne|update|delete|destroy)\([^;]*req\.params")
OWNERSHIP = (r"(?i)(?:req\.user|req\.auth|res\.locals\.(?:user|session)|owner|tenant|orgId|organizationId|\b403\b|"
             r"forbidden|authoriz|permission|can\(|ability|policy)")
RATE_LIMIT = r"(?i)rate-?limit|slow-down|throttl"
ERROR_HANDLER = (r"\(\s*(?:err|error|e)\s*(?::\s*\w+)?\s*,\s*req\w*\s*(?::\s*\w+)?\s*,\s*res\w*\s*"
                 r"(?::\s*\w+)?\s*,\s*next\w*|setErrorHandler\(")
ENV_READ = r"\b(?:process\.env|import\.meta\.env)(?:\.([A-Za-z_]\w*)|\[\s*[\"'`]([A-Za-z_]\w*)[\"'`]\s*\])"
LOCAL_ENDPOINT = (r"""(?i)["'`](?:[a-z][a-z0-9+.-]*://)(?:[^@/\s"'`]+@)?(?:localhost|127\.0\.0\.1|"""
                  r"""10\.\d{1,3}\.\d{1,3}\.\d{1,3}|192\.168\.\d{1,3}\.\d{1,3}|172\.(?:1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3})"""
                  r"""(?::\d+)?""")
NOT_AN_ENDPOINT = r"(?i)\b(?:placeholder|default\w*|example)\b|\bvalue\s*:|process\.env|import\.meta\.env"
MACHINE_PATH = (r"""["'`](?:/home/[^/\s"'`]+/|/Users/[^/\s"'`]+/|[A-Za-z]:\\\\(?:Users|Documents and Settings)\\\\)""")
PLATFORM_VARS = [
    "PATH", "HOME", "USER", "USERNAME", "USERPROFILE", "TMPDIR", "TEMP", "TMP", "PWD", "SHELL", "LANG",
    "LC_ALL", "TERM", "HOSTNAME", "CI", "NODE_ENV", "PYTHONPATH", "PYTHONUNBUFFERED", "VIRTUAL_ENV",
    "APPDATA", "LOCALAPPDATA", "PROGRAMFILES", "SYSTEMROOT", "COMSPEC", "EDITOR", "DEBUG", "TZ",
    "XDG_CONFIG_HOME", "XDG_CACHE_HOME", "XDG_DATA_HOME", "KUBERNETES_SERVICE_HOST", "DYNO",
]
PLATFORM_PREFIX = (r"^(?:GITHUB_|RUNNER_|npm_|VERCEL_|RENDER_|HEROKU_|AWS_LAMBDA_|NETLIFY_|PYTEST_|COVERAGE_|VSCODE_|"
                   r"JEST_)")
ENV_EXAMPLES = [".env.example", ".env.sample", ".env.template", ".env.dist", ".env.defaults", "example.env",
                "env.example", "sample.env", ".env.local.example", ".env.development.example"]
DOC_FILE = r"\.(?:md|rst|txt|adoc|yml|yaml|toml|ini|cfg|json|tf|env)$|(?:^|/)(?:Dockerfile|Procfile|Makefile|Jenkinsfile)$"
NOT_DOCS = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "uv.lock", "Pipfile.lock",
            "requirements.txt", "tsconfig.json", ".env"]
API_DOC = (r"(?i)openapi|swagger|flasgger|apispec|flask_smorest|flask-smorest|drf_spectacular|drf_yasg|spectree|"
           r"@nestjs/swagger|fastify-swagger|@fastify/swagger|tsoa|redoc")
API_DOC_FILE = (r"(?i)(?:^|/)(?:openapi|swagger)[^/]*\.(?:ya?ml|json)$|(?:^|/)docs?/api(?:\.md|/)|(?:^|/)API\.md$")
PY_ROUTE = r"(?m)^\s*@\w+\.(?:route|get|post|put|patch|delete|api_route)\("
JS_ROUTE = r"\b(?:app|router|server)\.(?:get|post|put|patch|delete)\(\s*[\"'`]/"
NOSQL = (r"\.(?:find|findOne|findOneAndUpdate|findOneAndDelete|updateOne|updateMany|deleteOne|deleteMany|"
         r"countDocuments|exists|replaceOne)\(\s*(?:req\.(?:body|query)\b(?!\.)|"
         r"\{[^}]*:\s*req\.(?:body|query)\.[\w$]+\s*[,}])")
NOSQL_SANITIZED = r"mongo-sanitize|mongoSanitize|sanitizeFilter|express-mongo-sanitize"
CSRF_LIBS = r"\b(?:csurf|csrf-csrf|lusca|tiny-csrf|csrf-sync|doubleCsrf|csrfSync|csrfProtection)\b"
SAME_SITE = r"""(?i)sameSite\s*:\s*["'`]?(?:strict|lax)"""
MUTATING_ROUTE = r"""\b(?:app|router|server)\.(?:post|put|patch|delete)\(\s*["'`]([^"'`]+)["'`]\s*,\s*(.*)$"""
SERVER = r"\b(?:app|router)\.(?:get|post|put|patch|delete)\("
SYNC_IO = r"\b(?:readFileSync|writeFileSync|execSync|pbkdf2Sync|scryptSync)\("
STATE_DECL = (r"^(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=\s*(?:\{\s*\}|\[\s*\]|new\s+(?:Map|Set)\s*"
              r"(?:<[^>]*>)?\(\s*\))\s*;?\s*$")
STATE_NAME = (r"(?i)(?:cache|session|store|state|users|items|data|db|records|counter|count|queue|jobs|tokens|carts?|"
              r"orders|visits|memory|registry|buffer|pending|seen|results|messages|rooms|clients)")
BODY_LIMIT = r"""(?i)\blimit\s*:\s*['"](\d+(?:\.\d+)?)\s*(mb|gb)['"]"""
LARGE_BODY_MB, MIN_ROUTES = 10, 5
# End of fixed values


def _rule(prefix: str, category: str):
    def make(seq: int, name: str, title: str, severity: str, confidence: str = "medium", kind: str = "potential",
             **kw) -> Rule:
        kw.setdefault("category", category)
        return Rule(f"{prefix}.{name}", title, severity=severity, confidence=confidence, kind=kind, seq=seq, **kw)
    return make


_api, _auth, _perf, _conf = (_rule("api", "api"), _rule("auth", "security"), _rule("performance", "performance"),
                             _rule("config", "maintainability"))
SEC = {"category": "security"}
API_LINES = [
    _api(1, "upload-client-filename", "Uploaded file stored under the client's file name", "high",
         pattern=CLIENT_FILENAME, path=JS, remediation="Generate the stored name.", **SEC),
    _api(2, "error-details-exposed", "Stack trace returned to the client", "medium", "high", "confirmed",
         pattern=ERROR_LEAK, path=JS, remediation="Return a generic message.", **SEC),
    _api(3, "tls-verify-disabled", "TLS certificate verification disabled", "high", "high", "confirmed",
         pattern=TLS_OFF, path=JS, remediation="Keep verification on.", **SEC),
    _api(4, "jwt-verification-disabled", "JWT 'none' algorithm accepted", "critical", "high", "confirmed",
         pattern=JWT_NONE, path=JS, remediation="Allow-list algorithms.", **SEC),
    _api(5, "mass-assignment", "Request body passed directly to the data layer", "medium",
         pattern=MASS_ASSIGNMENT, path=JS, remediation="Pick allowed fields."),
]
WILDCARD = _api(6, "cors-wildcard", "CORS allows any origin", "medium", kind="confirmed", remediation="List origins.")
COOKIE = _api(7, "insecure-cookie", "Insecure cookie", "medium", remediation="Set httpOnly and secure.", **SEC)
LOGGED = _api(8, "sensitive-data-logged", "Credential written to a log", "medium", remediation="Mask the value.", **SEC)
UPLOAD = _api(9, "upload-unvalidated", "multer upload without a fileFilter", "medium",
              remediation="Allow-list types and limit the size.", **SEC)
IDOR = _api(10, "idor-unscoped-lookup", "Object loaded by URL parameter", "medium", "low",
            remediation="Check ownership.", **SEC)
NO_HELMET = _api(11, "express-no-helmet", "Express app without security headers middleware", "low",
                 remediation="Add helmet().")
NO_RATE = _api(12, "no-rate-limiting", "No rate limiting detected", "low", "low", remediation="Rate-limit logins.")
NO_HANDLER = _api(13, "no-error-handler", "Express app without an error-handling middleware", "low",
                  remediation="Add an error handler.")
NOSQL_RULE = _auth(1, "nosql-injection", "MongoDB query built from request body/query values", "high",
                   remediation="Validate and cast the input.")
NO_CSRF = _auth(2, "express-no-csrf", "Cookie-authenticated Express app without CSRF protection", "medium", "low",
                remediation="Set sameSite and add CSRF tokens.")
DJANGO_CSRF = _auth(3, "django-csrf-middleware-missing", "Django CsrfViewMiddleware is not enabled", "medium",
                    kind="confirmed", remediation="Add the middleware.")
UNHASHED = _auth(4, "password-stored-unhashed", "Password field with no password hashing in the app", "high",
                 remediation="Hash with argon2id, scrypt or bcrypt.")
SYNC = _perf(1, "sync-io-in-server", "Synchronous I/O in a server module", "low", kind="estimate", pattern=SYNC_IO,
             path=JS, remediation="Use the async API.")
STATE = _perf(2, "in-process-state", "Server stores state in a module variable", "medium", kind="estimate",
              remediation="Keep shared state outside the process.")
SESSION = _perf(3, "memory-session-store", "express-session uses the default in-memory store", "medium", "high",
                "confirmed", remediation="Configure a shared store.")
UPLOAD_DISK = _perf(4, "local-file-storage", "Uploaded files saved to the local filesystem", "low", kind="estimate",
                    remediation="Use object storage.")
BODY = _perf(5, "large-body-limit", "Request body limit raised", "low", "high", "confirmed",
             remediation="Keep body limits small.")
BUFFERED = _perf(6, "request-buffered-in-memory", "Request body buffered in memory without a size limit", "medium",
                 kind="estimate", remediation="Enforce a maximum size.")
ENDPOINT = _conf(1, "hardcoded-endpoint", "Local or private network address hardcoded", "low",
                 pattern=LOCAL_ENDPOINT, unless=NOT_AN_ENDPOINT, path=JS, category="devops",
                 remediation="Read it from configuration.")
MACHINE = _conf(2, "machine-specific-path", "Absolute path to a user's home directory", "low", "high", "confirmed",
                pattern=MACHINE_PATH, path=JS, category="devops", remediation="Use configured paths.")
NO_EXAMPLE = _conf(3, "no-env-example", "Undocumented environment variables", "low", "high", "confirmed",
                   remediation="Add a .env.example.")
UNDOCUMENTED = _conf(4, "undocumented-env-var", "Undocumented environment variable", "low", kind="confirmed",
                     remediation="Document the variable.")
NO_CONTRACT = _conf(5, "undocumented-api", "HTTP routes without an API contract", "low",
                    remediation="Publish an OpenAPI document.")


def js_files(files: DataFrame) -> DataFrame:
    return files.filter(F.col("path").rlike(JS) & ~F.col("path").rlike(VENDORED) & ~is_test_path("path"))


def _numbered() -> Column:
    return F.transform(split_lines("text"), lambda t, i: F.struct((i + 1).alias("n"), t.alias("t")))


def _line_hits(files: DataFrame, pick) -> DataFrame:
    """Explode the lines of each file for which ``pick(line struct)`` yields a non-null value."""
    rows = files.withColumn("_l", _numbered())
    hits = F.filter(F.transform("_l", lambda x: F.struct(x["n"].alias("n"), pick(x).alias("v"))),
                    lambda h: h["v"].isNotNull())
    return rows.withColumn("_h", F.explode(hits)).select("*", F.col("_h.n").alias("line_no"), F.col("_h.v").alias("v")).drop(
        "_l", "_h")


def cookies(files: DataFrame) -> DataFrame:
    """Cookie flags turned off near cookie code, and session cookies set without options."""
    def off(x: Column) -> Column:
        first = F.greatest(x["n"] - 3, F.lit(1))
        near = F.array_join(F.transform(F.slice("_l", first, x["n"] - first + 1), lambda y: y["t"]), "\n")
        flags = F.array_sort(F.array_distinct(F.regexp_extract_all(x["t"], F.lit(COOKIE_OFF), F.lit(1))))
        return F.when((F.size(flags) > 0) & near.rlike(COOKIE_CONTEXT), F.array_join(F.transform(
            flags, lambda f: F.concat(f, F.lit(": false"))), ", "))

    def bare(x: Column) -> Column:
        name = F.regexp_extract(x["t"], BARE_COOKIE, 1)
        return F.when(name.rlike(SENSITIVE_COOKIE) & ~name.rlike("(?i)csrf|xsrf"), name)

    flagged, plain = _line_hits(files.filter(F.col("text").rlike(COOKIE_OFF)), off), _line_hits(files, bare)
    return emit(flagged, "api", COOKIE, path=F.col("path"), line=F.col("line_no"),
                title=F.concat(F.lit("Cookie option "), F.col("v"))).unionByName(
        emit(plain, "api", COOKIE, path=F.col("path"), line=F.col("line_no"),
             title=F.concat(F.lit("Cookie `"), F.col("v"), F.lit("` set without options"))))


def logged_credentials(files: DataFrame) -> DataFrame:
    """Log calls whose arguments name a credential."""
    def leak(x: Column) -> Column:
        args = F.regexp_replace(F.regexp_extract(x["t"], LOG_CALL, 1), r"'(?:[^'\\]++|\\.)*+'|\"(?:[^\"\\]++|\\.)*+\"", "")
        names = F.regexp_extract_all(args, F.lit(IDENTIFIER), F.lit(0))

        def risky(name: Column) -> Column:
            last = F.regexp_extract(name, r"([\w$]+)$", 1)
            word = F.lower(F.regexp_replace(last, r"(?<=[a-z0-9])(?=[A-Z])", "_"))
            parts = F.split(word, "_")
            return word.rlike(SENSITIVE_WORD) & ~F.get(parts, F.lit(0)).isin(*HARMLESS_PREFIX) \
                & ~F.element_at(parts, -1).isin(*HARMLESS_SUFFIX)

        return F.when(~args.rlike(MASKING), F.get(F.filter(names, risky), F.lit(0)))

    rows = files.withColumn("_l", _numbered())
    hits = F.filter(F.transform("_l", lambda x: F.struct(x["n"].alias("n"), leak(x).alias("v"))), lambda h: h["v"].isNotNull())
    rows = rows.withColumn("_h", F.explode(hits))
    return emit(rows, "api", LOGGED, path=F.col("path"), line=F.col("_h.n"),
                title=F.concat(F.lit("Credential `"), F.col("_h.v"), F.lit("` written to a log")))


def unscoped_lookups(files: DataFrame) -> DataFrame:
    """Authenticated routes that load an object by URL parameter with no sign of an ownership check."""
    rows = files.filter(F.col("text").rlike("(?m)" + ANY_ROUTE)).withColumn("_l", _numbered())
    starts = F.filter("_l", lambda x: x["t"].rlike(ANY_ROUTE))
    rows = rows.withColumn("_s", starts)
    rows = rows.withColumn("_s", F.transform("_s", lambda s, k: F.struct(
        s["n"].alias("n"), s["t"].alias("t"),
        F.coalesce(F.get("_s", k + 1)["n"], F.size("_l") + 1).alias("end"))))
    rows = rows.withColumn("_g", F.col("text").rlike(GLOBAL_AUTH)).select("*", F.explode("_s").alias("s"))
    body = F.slice("_l", F.col("s.n"), F.col("s.end") - F.col("s.n"))
    scoped = F.exists(body, lambda x: x["t"].rlike(OWNERSHIP))
    hit = F.get(F.filter(body, lambda x: x["t"].rlike(LOOKUP_BY_PARAM)), F.lit(0))["n"]
    authed = F.col("_g") | F.regexp_extract("s.t", ANY_ROUTE, 3).rlike(AUTH_HINT)
    rows = rows.withColumn("_hit", F.when(authed & ~scoped, hit)).filter(F.col("_hit").isNotNull())
    return emit(rows, "api", IDOR, path=F.col("path"), line=F.col("_hit"), title=F.concat(
        F.lit("Object loaded by URL parameter without an ownership check: "),
        F.upper(F.regexp_extract("s.t", ANY_ROUTE, 1)), F.lit(" "), F.regexp_extract("s.t", ANY_ROUTE, 2)))


def api_security(tables: dict[str, DataFrame]) -> DataFrame:
    files, lines = js_files(tables["files"]), js_files(tables["lines"])
    wild = _line_hits(files, lambda x: F.when(x["t"].rlike(CORS), F.lit(1)))
    creds = F.col("text").contains("credentials: true") | F.col("text").contains("credentials:true")
    open_upload = files.filter(F.col("text").rlike(r"\bmulter\s*\(") & ~F.col("text").contains("fileFilter"))
    express = tables["frameworks"].filter("framework = 'express'").select(*AUDIT).distinct()
    flags = files.groupBy(*AUDIT).agg(
        F.max(F.col("text").contains("helmet")).alias("_helmet"), F.max(F.col("text").rlike(RATE_LIMIT)).alias("_rate"),
        F.max(F.lower("text").contains("login")).alias("_login"),
        F.max(F.col("text").rlike(ERROR_HANDLER)).alias("_handler"),
        F.sum(F.regexp_count("text", F.lit(JS_ROUTE))).alias("_routes")).join(express, AUDIT, "left_semi")
    return union([
        scan(lines, API_LINES, "api"),
        emit(wild, "api", WILDCARD, path=F.col("path"), line=F.col("line_no"),
             title=F.when(creds, "CORS allows any origin with credentials").otherwise(WILDCARD.title),
             severity=F.when(creds, "high").otherwise("medium")),
        cookies(files), logged_credentials(files),
        emit(open_upload, "api", UPLOAD, path=F.col("path"), line=line_of("text", r"\bmulter\s*\("),
             title=F.concat(F.lit(UPLOAD.title), F.when(F.col("text").contains("limits"), "").otherwise(" or size limits"))),
        unscoped_lookups(files),
        emit_each(flags, "api", [
            (~F.col("_helmet"), NO_HELMET),
            (~F.col("_rate") & (F.col("_login") | (F.col("_routes") >= MIN_ROUTES)), NO_RATE),
            (~F.col("_handler") & (F.col("_routes") >= 3), NO_HANDLER)])])


def auth(tables: dict[str, DataFrame]) -> DataFrame:
    """``profile``: (audit, aspect, name, path) evidence rows, aspects auth / datastore / framework / password."""
    files, profile = js_files(tables["files"]), tables["profile"]

    def having(aspect: str, name: str | None = None) -> DataFrame:
        rows = profile.filter(F.col("aspect") == aspect)
        return (rows if name is None else rows.filter(F.col("name") == name)).select(*AUDIT).distinct()

    clean = tables["files"].filter(basename("path") == "package.json").filter(
        F.col("text").rlike(NOSQL_SANITIZED)).select(*AUDIT).distinct()
    mongo = files.filter(~F.col("text").rlike(NOSQL_SANITIZED)).join(having("datastore", "mongodb"), AUDIT, "left_semi") \
        .join(clean, AUDIT, "left_anti")
    queries = _line_hits(mongo, lambda x: F.when(x["t"].rlike(NOSQL), F.lit(1)))
    cookie = having("auth", "cookie")
    protected = tables["files"].filter(F.col("path").rlike(JS) | (basename("path") == "package.json")).filter(
        F.col("text").rlike(CSRF_LIBS) | F.col("text").rlike(SAME_SITE)).select(*AUDIT).distinct()
    routes = files.withColumn("_at", line_of("text", "(?m)" + MUTATING_ROUTE)).filter(F.col("_at").isNotNull()).groupBy(
        *AUDIT).agg(F.min(F.struct("path", "_at")).alias("at"))
    open_forms = routes.join(cookie, AUDIT, "left_semi").join(having("framework", "express"), AUDIT, "left_semi").join(
        protected, AUDIT, "left_anti")
    code = tables["files"].filter(F.col("path").endswith(".py")).withColumn(
        "text", F.regexp_replace("text", r"(?m)#.*$", ""))
    settings = code.withColumn("_at", line_of("text", r"(?m)^\s*MIDDLEWARE\s*(?:\+?=)")).filter(
        F.col("_at").isNotNull()).groupBy(*AUDIT).agg(F.min(F.struct("path", "_at")).alias("at"))
    enabled = code.filter(F.col("text").contains("CsrfViewMiddleware")).select(*AUDIT).distinct()
    django = settings.join(cookie, AUDIT, "left_semi").join(having("framework", "django"), AUDIT, "left_semi").join(
        enabled, AUDIT, "left_anti")
    stored = profile.filter("aspect = 'password_column'").groupBy(*AUDIT).agg(F.min("path").alias("path")).join(
        having("password_hashing"), AUDIT, "left_anti")
    return union([
        emit(queries, "auth", NOSQL_RULE, path=F.col("path"), line=F.col("line_no")),
        emit(open_forms, "auth", NO_CSRF, path=F.col("at.path"), line=F.col("at._at")),
        emit(django, "auth", DJANGO_CSRF, path=F.col("at.path"), line=F.col("at._at")),
        emit(stored, "auth", UNHASHED, path=F.col("path"))])


def performance(tables: dict[str, DataFrame]) -> DataFrame:
    files, lines = js_files(tables["files"]), js_files(tables["lines"])
    servers = files.filter(F.col("text").rlike(SERVER))
    sync = scan(lines.join(servers.select(*AUDIT, "path"), [*AUDIT, "path"], "left_semi"), [SYNC], "performance")
    rows = servers.withColumn("_l", _numbered())
    decl = F.filter(F.transform("_l", lambda x: F.struct(
        x["n"].alias("n"), F.regexp_extract(x["t"], STATE_DECL, 1).alias("name"))),
        lambda d: (d["name"] != "") & d["name"].rlike(STATE_NAME))
    rows = rows.withColumn("d", F.explode(decl))
    write = F.concat(F.lit(r"\b"), F.col("d.name"), F.lit(r"(?:\[[^\]]+\]\s*=[^=]|\.(?:push|set|add)\()"))
    first = F.get(F.filter("_l", lambda x: (x["n"] > F.col("d.n")) & F.rlike(x["t"], write)), F.lit(0))["n"]
    kept = rows.withColumn("_w", first).filter(F.col("_w").isNotNull())
    size = F.regexp_extract
    limit = _line_hits(files, lambda x: F.when(
        x["t"].rlike("(?i)json|urlencoded|raw|text|bodyParser|bodyLimit") & x["t"].rlike(BODY_LIMIT),
        size(x["t"], BODY_LIMIT, 1).cast("double") * F.when(F.lower(size(x["t"], BODY_LIMIT, 2)) == "gb", 1024).otherwise(1)))
    limit = limit.filter(F.col("v") >= LARGE_BODY_MB)
    mb = F.regexp_replace(F.col("v").cast("string"), r"\.0$", "")
    path, text = F.col("path"), F.col("text")
    session = (text.rlike(r"""require\(\s*["']express-session["']\s*\)|from\s+["']express-session["']""")
               & text.rlike(r"\bsession\(\s*\{") & ~text.rlike(r"\bstore\s*:"))
    buffered = (text.rlike(SERVER) & ~text.rlike(r"(?i)maxBytes|max_?(?:body_?)?size|(?:byteLength|length|size|received)\s*>")
                & text.rlike(r"\.push\(\s*chunk|\+=\s*chunk|Buffer\.concat") & text.rlike(r"""\.on\(\s*['"]data['"]"""))
    whole = emit_each(files, "performance", [
        (session, SESSION, {"path": path, "line": line_of("text", r"\bsession\(\s*\{")}),
        (text.rlike(r"\bmulter\(\s*\{\s*dest\s*:|multer\.diskStorage\("), UPLOAD_DISK,
         {"path": path, "line": line_of("text", r"multer\(\s*\{\s*dest|diskStorage")}),
        (buffered, BUFFERED, {"path": path, "line": line_of("text", r"""\.on\(\s*['"]data['"]""")})])
    return union([
        sync, whole,
        emit(kept, "performance", STATE, path=path, line=F.col("_w"),
             title=F.concat(F.lit("Server stores state in module-level `"), F.col("d.name"), F.lit("`"))),
        emit(limit, "performance", BODY, path=path, line=F.col("line_no"),
             title=F.concat(F.lit("Request body limit raised to "), mb, F.lit(" MB")))])


def environment_reads(lines: DataFrame) -> DataFrame:
    """First read of every application variable: (audit, name, path, line_no)."""
    both = F.regexp_extract_all("text", F.lit(ENV_READ), F.lit(0))
    rows = lines.select(*AUDIT, "path", "line_no", F.explode(both).alias("_m"))
    name = F.concat(F.regexp_extract("_m", ENV_READ, 1), F.regexp_extract("_m", ENV_READ, 2))
    rows = rows.withColumn("name", name).filter(
        F.col("name").rlike("^[A-Z][A-Z0-9_]+$") & ~F.col("name").isin(*PLATFORM_VARS) & ~F.col("name").rlike(PLATFORM_PREFIX))
    return rows.groupBy(*AUDIT, "name").agg(F.min(F.struct("path", "line_no")).alias("at")).select(
        *AUDIT, "name", "at.path", "at.line_no")


def undocumented_variables(files: DataFrame, lines: DataFrame) -> DataFrame:
    """Variables no documentation names. Documented words are distinct tokens, so the anti-join stays small."""
    reads = environment_reads(js_files(lines))
    name = basename("path")
    docs = files.filter((F.col("path").rlike(DOC_FILE) | name.isin(*ENV_EXAMPLES)) & ~name.isin(*NOT_DOCS)
                        & ~is_test_path("path"))
    words = docs.select(*AUDIT, F.explode(F.array_distinct(F.regexp_extract_all(
        "text", F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))).alias("name")).distinct()
    missing = reads.join(words, [*AUDIT, "name"], "left_anti")
    example = files.filter(name.isin(*ENV_EXAMPLES)).select(*AUDIT).distinct()
    bare = missing.join(example, AUDIT, "left_anti").groupBy(*AUDIT).agg(
        F.count(F.lit(1)).alias("n"), F.min_by(F.struct("path", "line_no"), "name").alias("at")).filter("n >= 3")
    listed = missing.join(example, AUDIT, "left_semi")
    return emit(bare, "configuration", NO_EXAMPLE, path=F.col("at.path"), line=F.col("at.line_no"),
                title=F.concat(F.col("n").cast("string"), F.lit(
                    " environment variable(s) used but no .env.example and no documentation")),
                severity=F.when(F.col("n") >= 5, "medium").otherwise("low")).unionByName(
        emit(listed, "configuration", UNDOCUMENTED, path=F.col("path"), line=F.col("line_no"),
             title=F.concat(F.lit("Environment variable "), F.col("name"), F.lit(" is not documented"))))


def api_contract(files: DataFrame, frameworks: DataFrame) -> DataFrame:
    name, text = basename("path"), F.col("text")
    manifest = name.isin("requirements.txt", "pyproject.toml", "package.json", "Pipfile")
    python, script = F.col("path").endswith(".py"), F.col("path").rlike(JS)
    rows = files.groupBy(*AUDIT).agg(
        F.sum(F.when(python, F.regexp_count("text", F.lit(PY_ROUTE))).when(
            script, F.regexp_count("text", F.lit(JS_ROUTE))).otherwise(0)).alias("n"),
        F.max(F.col("path").rlike(API_DOC_FILE) | ((manifest | python | script) & text.rlike(API_DOC))).alias("_doc"))
    fast = frameworks.filter("framework = 'fastapi'").select(*AUDIT).distinct()
    rows = rows.filter((F.col("n") >= 5) & ~F.col("_doc")).join(fast, AUDIT, "left_anti")
    return emit(rows, "configuration", NO_CONTRACT,
                title=F.concat(F.col("n").cast("string"), F.lit(" HTTP routes without an API contract")))


def configuration(tables: dict[str, DataFrame]) -> DataFrame:
    literals = first_per_file(scan(js_files(tables["lines"]), [ENDPOINT, MACHINE], "configuration")).drop(
        "sites", "site_lines")
    return union([literals, undocumented_variables(tables["files"], tables["lines"]),
                  api_contract(tables["files"], tables["frameworks"])])


register(Pack("api", "API security", ("api", "security"), api_security))
register(Pack("auth", "Authentication", ("security",), auth))
register(Pack("performance", "Performance", ("performance",), performance))
register(Pack("configuration", "Configuration", ("maintainability", "devops"), configuration))
