"""Secrets, placeholders, JavaScript tests and maintainability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions.text import contains_secret, is_test_path, language, redact, split_lines
from ..operators import AUDIT
from .engine import Pack, Rule, emit, emit_each, first_per_file, line_of, register, scan, union

# Patterns and limits.
JS = r"(?i)\.(?:js|jsx|ts|tsx|mjs|cjs)$"
CODE = r"(?i)\.(?:py|js|jsx|ts|tsx|mjs|cjs)$"
NOT_CODE_DIRS = r"^(?:docs|doc|examples|example|samples|fixtures)/|node_modules/"
PLACEHOLDER_COMMENT = (
    r"(?i)(?:#|//|/\*|\*)\s*.*?\b("
    r"in a real(?:-world)? (?:application|app|implementation|system|project|scenario)"
    r"|in (?:a )?production,? you (?:would|should|'d)"
    r"|(?:replace|swap) (?:this|it) with (?:a |an |the |your )?(?:real|actual|proper)"
    r"|(?:mock|dummy|fake|placeholder|simplified|simulated) (?:implementation|logic|data|response|version)"
    r"|todo:?\s*(?:implement|add (?:real|proper|actual)|replace)"
    r"|for now,? (?:just |we )?(?:return|simulate|mock|hard-?code|pretend))")
PLACEHOLDER_VALUE = (
    r"""(?i)(?:[=:(,]\s*|^\s*)["'](?:your[-_ ]?(?:api[-_ ]?key|secret(?:[-_ ]?key)?|token|password|key)(?:[-_ ]?here)?"""
    r"""|<\s*your[^>]{1,40}>|changeme|change[-_]me|replace[-_]me|xxx+|todo|insert[-_ ][a-z_ -]{1,30}here)["']""")
NOT_IMPLEMENTED = r"(?i)throw\s+new\s+Error\(\s*['\"`](?:not\s+implemented|todo|implement\s+me)"
JS_TEST_CALL = r"(?m)^\s*(?:it|test)(?:\.(?:only|skip|each\([^)]*\)))?\s*\("
JS_ASSERT = r"\b(?:expect|assert|should)\b|\.toBe|\.toEqual|t\.(?:is|true|deepEqual)"
JS_TAUTOLOGY = r"expect\(\s*(true|1|false|null)\s*\)\s*\.\s*(?:toBe|toEqual|toStrictEqual)\(\s*\1\s*\)"
DEBT_MARKER = r"(?i)(?:#|//|/\*|\*)\s*(?:TODO|FIXME|HACK|XXX)\b"
EMPTY_CATCH = (r"\bcatch\s*(?:\(\s*\w*\s*\))?\s*\{\s*\}|\.catch\(\s*(?:\(\s*\w*\s*\)|\w+)\s*=>\s*"
               r"(?:\{\s*\}|null|undefined)\s*\)|\.catch\(\s*function\s*\(\s*\w*\s*\)\s*\{\s*\}\s*\)")
FILE_LINES, DUPLICATE_WINDOW = 1000, 12
# End of fixed values


def _m(seq: int, name: str, title: str, severity: str, confidence: str = "high", kind: str = "confirmed", **kw) -> Rule:
    return Rule(f"maintainability.{name}", title, "maintainability", severity, confidence, kind, seq=seq, **kw)


def _a(seq: int, name: str, title: str, category: str, severity: str, confidence: str = "medium",
       kind: str = "potential", **kw) -> Rule:
    return Rule(f"ai-code.{name}", title, category, severity, confidence, kind, seq=seq, **kw)


# --- secrets ---------------------------------------------------------------------------------------
def _secret_rule(seq: int, name: str) -> Rule:
    return Rule(f"secrets.{name.replace('_', '-')}", f"Credential in source ({name.replace('_', ' ')})", "security",
                "high", "high", "confirmed", pattern=dict(V.SECRET_PATTERNS)[name], seq=seq,
                remediation="Revoke the value and load it at runtime.")


SECRET_RULES = [_secret_rule(i, name) for i, (name, _) in enumerate(V.SECRET_PATTERNS)
                if name not in (*V.REDACT_ONLY, "private_key")]
PRIVATE_KEY = Rule("secrets.private-key", "Private key in source", "security", "high", "high", "confirmed",
                   seq=99, remediation="Revoke the key and load it at runtime.")
PRIVATE_KEY_START = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"


def secrets(lines: DataFrame) -> DataFrame:
    """Provider-format credentials per line; a private key is reported at its first line."""
    keys = lines.filter(F.col("text").rlike(PRIVATE_KEY_START))
    found = scan(lines, SECRET_RULES, "secrets").unionByName(
        emit(keys, "secrets", PRIVATE_KEY, path=F.col("path"), line=F.col("line_no")))
    return found


def secret_texts(rows: DataFrame, text: str = "text") -> DataFrame:
    """Whole texts with a secret flag and their masked form."""
    return rows.withColumns({"has_secret": contains_secret(text), "masked": redact(text)})


register(Pack("secrets", "Secrets", ("security",), lambda t: secrets(t["lines"])))

# --- placeholders and JavaScript tests -------------------------------------------------------------
LOGIC = _a(1, "placeholder-logic", "Placeholder comments", "maintainability", "medium", pattern=PLACEHOLDER_COMMENT,
           path=CODE, not_path=NOT_CODE_DIRS, remediation="Implement it or fail explicitly.")
VALUE = _a(2, "placeholder-value", "Placeholder value or not-implemented error", "maintainability", "medium",
           pattern=PLACEHOLDER_VALUE, path=CODE, not_path=NOT_CODE_DIRS, remediation="Load real values.")
NOT_DONE = _a(2, "placeholder-value", "Placeholder value or not-implemented error", "maintainability", "medium",
              pattern=NOT_IMPLEMENTED, unless=PLACEHOLDER_VALUE, path=JS, not_path=NOT_CODE_DIRS,
              remediation="Load real values.")
TAUTOLOGY = _a(3, "tautological-assertion", "Assertions that can never fail", "testing", "medium", "high", "confirmed",
               remediation="Assert on real results.")
NO_EXPECT = _a(4, "tests-without-expect", "Tests without any assertion", "testing", "low",
               remediation="Assert on results and errors.")


def placeholders(lines: DataFrame) -> DataFrame:
    """One finding per file and rule, at its first line."""
    code = lines.filter(~is_test_path("path"))
    found = first_per_file(scan(code, [LOGIC, VALUE, NOT_DONE], "ai_code"))
    logic = F.col("rule_id") == LOGIC.rule_id
    return found.withColumns({
        "title": F.when(logic, F.concat(F.col("sites").cast("string"), F.lit(" placeholder comment(s)"))).otherwise(
            F.col("title")),
        "description": F.concat(F.lit("Lines "), F.array_join(F.col("site_lines").cast("array<string>"), ", ")),
    }).drop("sites", "site_lines")


def js_tests(files: DataFrame) -> DataFrame:
    """Tautological assertions, and test files that never assert."""
    tests = files.filter(F.col("path").rlike(JS) & is_test_path("path") & ~F.col("path").contains("node_modules/"))
    calls = F.regexp_count("text", F.lit(JS_TEST_CALL))
    return emit_each(tests, "ai_code", [
        (F.col("text").rlike(JS_TAUTOLOGY), TAUTOLOGY, {"path": F.col("path"), "line": line_of("text", JS_TAUTOLOGY)}),
        ((calls > 0) & ~F.col("text").rlike(JS_ASSERT), NO_EXPECT, {
            "path": F.col("path"), "line": line_of("text", JS_TEST_CALL),
            "title": F.concat(calls.cast("string"), F.lit(" test(s) without any assertion"))})])


register(Pack("ai_code", "AI-generated code patterns", ("dependencies", "maintainability", "testing"),
              lambda t: placeholders(t["lines"]).unionByName(js_tests(t["files"]))))

# --- maintainability -------------------------------------------------------------------------------
CATCH = _m(1, "swallowed-exception", "Empty catch block silently swallows errors", "medium", pattern=EMPTY_CATCH,
           path=JS, remediation="Log or rethrow the error.")
LARGE = _m(2, "large-file", "Very large source file", "low", remediation="Split the file by responsibility.")
DUPLICATED = _m(3, "duplicated-code", "Duplicated code block", "low", remediation="Extract the shared logic.")
DEBT = _m(4, "debt-markers", "Debt markers", "info", remediation="Move markers to tracked issues.")
NO_README = _m(5, "no-readme", "No README at the repository root", "low", remediation="Add a README.")
THIN_README = _m(6, "thin-readme", "README is minimal", "info", remediation="Document setup and operation.")


def code_files(files: DataFrame) -> DataFrame:
    return files.filter(language("path").isin(*V.CODE_LANGUAGES))


def kept_lines() -> Column:
    """Numbered, space-normalised lines that carry code."""
    spaces = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"
    rows = F.transform(split_lines("text"), lambda t, i: F.struct(
        (i + 1).alias("n"), F.trim(F.regexp_replace(t, spaces, " ")).alias("t")))
    return F.filter(rows, lambda x: (F.length(x["t"]) > 3) & ~x["t"].rlike(r"^(?:import |from |#|//|\}|\)|\])"))


def duplicate_windows(files: DataFrame, window: int = DUPLICATE_WINDOW) -> DataFrame:
    """(hash, path, line_no) of every window of kept lines, once per file and hash.

    Windows are cut inside the file's row with array slices: no shuffle until equal hashes meet.
    """
    rows = files.select(*AUDIT, "path", kept_lines().alias("_l")).filter(F.size("_l") >= window)
    starts = rows.select(*AUDIT, "path", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("_l") - window + 1), lambda k: F.struct(
            F.element_at("_l", k)["n"].alias("line_no"),
            F.sha1(F.array_join(F.transform(F.slice("_l", k, F.lit(window)), lambda x: x["t"]), "\n")).alias("hash")))
    ).alias("w"))
    return starts.groupBy(*AUDIT, "w.hash", "path").agg(F.min("w.line_no").alias("line_no"))


def duplicate_blocks(files: DataFrame) -> DataFrame:
    """Blocks found in two or more files: (audit, hash, copies, path, line_no of the first copy).

    Copies are counted and the first ones kept with mergeable aggregates; a block copied into a third of all files
    stays one row per task. The set of files is named by two independent sums of 64-bit hashes: two sets of one size are
    taken for one with a probability of about 2^-128.
    """
    return duplicate_windows(files).groupBy(*AUDIT, "hash").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("path", "line_no")).alias("_first"),
        F.struct(*(F.sum(F.xxhash64(F.lit(i), "path").cast("decimal(38,0)")).alias(f"s{i}") for i in range(2))).alias("_set")
    ).filter("copies > 1").select(
        *AUDIT, "hash", "copies", "_first.path", "_first.line_no", "_set")


def duplicated_code(files: DataFrame) -> DataFrame:
    """One finding per set of files that share a block."""
    blocks = duplicate_blocks(files)
    rows = blocks.groupBy(*AUDIT, "copies", "_set").agg(F.min(F.struct("path", "line_no", "hash")).alias("b"))
    return emit(rows, "maintainability", DUPLICATED, path=F.col("b.path"), line=F.col("b.line_no"), title=F.concat(
        F.lit(f"Duplicated code block ({DUPLICATE_WINDOW}+ lines, "), F.col("copies").cast("string"), F.lit(" copies)")))


def debt_markers(lines: DataFrame) -> DataFrame:
    rows = lines.filter(language("path").isin(*V.CODE_LANGUAGES) & F.col("text").rlike(DEBT_MARKER)).groupBy(*AUDIT).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("path", "line_no")).alias("at")).filter("n >= 10")
    n = F.col("n").cast("string")
    return emit(rows, "maintainability", DEBT, path=F.col("at.path"), line=F.col("at.line_no"),
                title=F.concat(n, F.lit(" TODO/FIXME/HACK markers")),
                severity=F.when(F.col("n") < 50, "info").otherwise("low"),
                evidence=F.concat(n, F.lit(" markers; first at "), F.col("at.path"), F.lit(":"),
                                  F.col("at.line_no").cast("string")))


def large_files(files: DataFrame) -> DataFrame:
    rows = code_files(files).filter(~is_test_path("path")).withColumn("n", F.size(split_lines("text"))).filter(
        F.col("n") > FILE_LINES)
    n = F.col("n").cast("string")
    return emit(rows, "maintainability", LARGE, path=F.col("path"),
                title=F.concat(F.lit("Very large source file ("), n, F.lit(" lines)")),
                evidence=F.concat("path", F.lit(": "), n, F.lit(" lines")))


def readme(files: DataFrame) -> DataFrame:
    is_readme = ~F.col("path").contains("/") & F.lower("path").startswith("readme")
    filled = F.size(F.filter(split_lines("text"), lambda t: F.trim(t) != ""))
    rows = files.groupBy(*AUDIT).agg(
        F.max(language("path").isin(*V.CODE_LANGUAGES)).alias("_code"),
        F.min(F.when(is_readme, F.struct("path", filled.alias("n")))).alias("_r")).filter("_code")
    return emit_each(rows, "maintainability", [
        (F.col("_r").isNull(), NO_README), (F.col("_r.n") < 8, THIN_README, {"path": F.col("_r.path")})])


def maintainability(tables: dict[str, DataFrame]) -> DataFrame:
    files, lines = tables["files"], tables["lines"]
    source = code_files(files).filter(~is_test_path("path"))
    return union([
        scan(lines.filter(~is_test_path("path")), [CATCH], "maintainability"), large_files(files),
        duplicated_code(source), debt_markers(lines), readme(files)])


register(Pack("maintainability", "Maintainability & technical debt", ("maintainability",), maintainability))
