"""Text functions: redaction, normalisation, paths, rule families, globs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab as V
from .core import _c, lookup

WHITESPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def redact(col) -> Column:
    """Mask every secret pattern in order, keeping the prefix each pattern marks as harmless."""
    out = _c(col)
    for _name, pattern in V.SECRET_PATTERNS:
        out = F.regexp_replace(out, "(?d)" + pattern, "$1" + V.REDACTED)
    return out


def contains_secret(col) -> Column:
    col = _c(col)
    hit = F.lit(False)
    for name, pattern in V.SECRET_PATTERNS:
        if name not in V.REDACT_ONLY:
            hit = hit | col.rlike(pattern)
    return F.coalesce(hit, F.lit(False))


def normalize_line(col) -> Column:
    return F.substring(F.trim(F.regexp_replace(_c(col), WHITESPACE, " ")), 1, 300)


def yaml_section(text: Column, key: str, indent: str = "") -> Column:
    """Body of a YAML mapping key (a pattern) at a given indent: the lines below it that are blank or lie deeper; empty
    without the key. It goes line by line, as a pattern that repeats whole lines needs a stack frame for each."""
    lines = F.split(text, "\n")

    def below(every: Column) -> Column:
        return let(F.array_position(F.transform(every, lambda t: t.rlike(rf"^{indent}{key}:[ \t]*$")), True), lambda at: F.when(
            at > 0, let(F.slice(every, at.cast("int") + 1, F.size(every)), upto)).otherwise(""))

    def upto(rest: Column) -> Column:
        out = F.array_position(F.transform(rest, lambda t: (t != "") & ~t.rlike(rf"^{indent}[ \t]")), True).cast("int")
        return F.array_join(F.when(out > 0, F.slice(rest, 1, out - 1)).otherwise(rest), "\n")

    return let(lines, below)


def let(value: Column, body) -> Column:
    """``body`` over ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def split_lines(col) -> Column:
    """Lines of a text, without the empty piece after a final line break."""
    parts = F.split(_c(col), LINE_BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def line_count(col) -> Column:
    """Newline count, plus one for an unterminated last line."""
    col = _c(col)
    breaks = F.length(col) - F.length(F.replace(col, F.lit("\n"), F.lit("")))
    return (breaks + F.when((col == "") | col.endswith("\n"), 0).otherwise(1)).cast("long")


def normalize_path(col) -> Column:
    return F.regexp_replace(F.translate(_c(col), "\\", "/"), r"^(?:\./)++", "")


def relative_path(col, root: str) -> Column:
    """A tool-reported path relative to ``root``."""
    path = F.translate(_c(col), "\\", "/")
    prefix = root.replace("\\", "/").rstrip("/") + "/"
    inside = F.lower(path).startswith(prefix.lower())
    return normalize_path(F.when(inside, F.substr(path, F.lit(len(prefix) + 1))).otherwise(path))


def basename(col) -> Column:
    return F.element_at(F.split(_c(col), "/"), -1)


def dirname(col) -> Column:
    return F.regexp_extract(_c(col), r"^(.*)/[^/]*$", 1)


def stem(col) -> Column:
    return F.regexp_replace(basename(col), r"\.[^.]*$", "")


def suffix(col) -> Column:
    return F.lower(F.regexp_extract(basename(col), r"[^.](\.[^.]+)$", 1))


def shared_prefix_length(a: Column, b: Column) -> Column:
    """How many leading directories two paths share."""
    left, right = F.split(dirname(a), "/"), F.split(dirname(b), "/")
    pairs = F.transform(
        F.sequence(F.lit(0), F.least(F.size(left), F.size(right)) - 1),
        lambda i: F.get(left, i) == F.get(right, i),
    )
    miss = F.array_position(pairs, False)
    return F.when(miss == 0, F.size(pairs)).otherwise((miss - 1).cast("int"))


def is_test_path(col) -> Column:
    parts = F.split(F.lower(_c(col)), "/")
    name = F.element_at(parts, -1)
    folders = F.slice(parts, 1, F.size(parts) - 1)
    return (
        F.arrays_overlap(folders, F.array(*[F.lit(d) for d in V.TEST_DIRS]))
        | name.startswith("test_") | (name == "tests.py")
        | name.rlike(r"(_test\.py|_test\.go|conftest\.py)$") | name.contains(".test.") | name.contains(".spec.")
    )


def rule_family(col) -> Column:
    """The cross-tool family of a rule, or null."""
    rule = _c(col)
    table = V.RULE_FAMILY
    secret = rule.startswith(V.TRIVY_SECRET_PREFIX) | (
        rule.startswith(V.SECRET_RULE_PREFIX) & (rule != V.SECRET_RULE_EXCEPTION))
    semgrep = F.lit(None).cast("string")
    for needle, family in reversed(V.SEMGREP_FAMILIES):
        semgrep = F.when(F.lower(rule).contains(needle), F.lit(family)).otherwise(semgrep)
    return F.coalesce(
        lookup(rule, table),
        F.when(secret, F.lit("hardcoded-secret")),
        F.when(rule.startswith("semgrep:"), semgrep),
    )


def rule_matches(pattern: Column, rule: Column) -> Column:
    """Exact id, or a prefix when the pattern ends with a star."""
    return F.when(pattern.endswith("*"), rule.startswith(F.substr(pattern, F.lit(1), F.length(pattern) - 1))) \
        .otherwise(rule == pattern)


def _glob_body(glob: Column) -> Column:
    """Regex of a shell glob in which a star crosses directory separators."""
    quoted = F.regexp_replace(glob, r"([\\.^$+(){}|])", r"\\$1")
    classes = F.regexp_replace(quoted, r"\[!", "[^")
    unclosed = F.regexp_replace(classes, r"\[(?![^\]]+\])", r"\\[")
    return F.replace(F.regexp_replace(unclosed, r"\*+", ".*"), F.lit("?"), F.lit("."))


def glob_regex(glob: Column) -> Column:
    """Compile a path glob once, in the policy table. Leading dots and slashes of the glob are dropped, a final
    ``/**`` also matches everything below the folder, and ``**/`` also matches no folder at all."""
    pattern = F.regexp_replace(F.trim(glob), r"^[./]+", "")
    below = F.when(
        pattern.endswith("/**"),
        F.concat(F.lit("|"), F.regexp_replace(F.substr(pattern, F.lit(1), F.length(pattern) - 3),
                                              r"([\\.^$+(){}|\[\]?*])", r"\\$1"), F.lit("/.*")),
    ).otherwise("")
    flat = F.when(pattern.contains("**/"),
                  F.concat(F.lit("|"), _glob_body(F.replace(pattern, F.lit("**/"), F.lit(""))))).otherwise("")
    return F.concat(F.lit("^(?s:"), _glob_body(pattern), below, flat, F.lit(r")\z"))


def language(path) -> Column:
    """Language by file suffix, Dockerfiles by name."""
    table = V.LANGUAGE_OF_SUFFIX
    name = basename(path)
    by_name = F.when((name == "Dockerfile") | name.startswith("Dockerfile."), F.lit("dockerfile"))
    return F.coalesce(lookup(suffix(path), table), by_name)


def is_manifest(path) -> Column:
    name = basename(path)
    return name.isin(*V.MANIFESTS) | (name.startswith("requirements") & name.endswith(".txt"))


def location(path, line) -> Column:
    path, line = _c(path), _c(line)
    return F.when(path == "", F.lit("(repository)")) \
        .when(line.isNotNull(), F.concat(path, F.lit(":"), line.cast("string"))).otherwise(path)


def csv_safe(col) -> Column:
    """Quote a leading formula character so a spreadsheet shows text."""
    col = _c(col)
    return F.when(col.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), col)).otherwise(col)


def prompt_safe(col, tag: str = "untrusted_repository_content") -> Column:
    """Redact, then break any opening or closing tag of the quoted block inside the data."""
    closed = F.replace(redact(F.coalesce(_c(col), F.lit(""))), F.lit(f"</{tag}"), F.lit(f"</{tag}_"))
    return F.replace(closed, F.lit(f"<{tag}"), F.lit(f"<{tag}_"))


def python_package(col) -> Column:
    return F.lower(F.regexp_replace(_c(col), r"[-_.]+", "-"))


def snake(col) -> Column:
    return F.lower(F.regexp_replace(_c(col), r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_"))


def path_tokens(col) -> Column:
    """Lower-case words of a name: camel humps and separators split."""
    humps = F.regexp_replace(_c(col), r"([a-z0-9])([A-Z])", "$1_$2")
    return F.filter(F.split(F.lower(humps), r"[._\-]+"), lambda t: t != "")


def url_segments(col) -> Column:
    """Route segments in lower case, parameters collapsed to a star."""
    parts = F.filter(F.split(F.regexp_replace(_c(col), r"(?s)[?#].*$", ""), "/"), lambda p: p != "")
    return F.transform(parts, lambda p: F.when(p.rlike(r"[<{(:*$\[]"), F.lit("*")).otherwise(F.lower(p)))
