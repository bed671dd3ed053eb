"""How rules become findings: line rules, file rules, repository rules, evidence snippets and the pack registry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import redact
from ..operators import AUDIT
from ..vocab import builtin

SNIPPET_CONTEXT, SNIPPET_LINE, SNIPPET_TOTAL = 2, 240, 800


@dataclass(frozen=True)
class Rule:
    """One rule of a pack. ``pattern`` must match, ``unless`` must not; ``path``/``not_path`` select files."""

    rule: str
    title: str
    category: str
    severity: str
    confidence: str
    kind: str
    pattern: str = ""
    unless: str = ""
    path: str = ""
    not_path: str = ""
    description: str = ""
    remediation: str = ""
    seq: int = 0

    @property
    def rule_id(self) -> str:
        return self.rule if ":" in self.rule else builtin(self.rule)


def selects(rule: Rule, text: str = "text") -> Column:
    """Whether a rule applies to a row of (path, text)."""
    cond = F.lit(True)
    if rule.path:
        cond = cond & F.col("path").rlike(rule.path)
    if rule.not_path:
        cond = cond & ~F.col("path").rlike(rule.not_path)
    if rule.pattern:
        cond = cond & F.col(text).rlike(rule.pattern)
    if rule.unless:
        cond = cond & ~F.col(text).rlike(rule.unless)
    return cond


def finding(rule: Rule, *, path: Column | None = None, line: Column | None = None, title: Column | None = None,
            severity: Column | None = None, confidence: Column | None = None, kind: Column | None = None,
            evidence: Column | None = None, description: Column | None = None) -> Column:
    """One finding as a struct. The emission index orders by rule, then line."""
    line = (F.lit(None) if line is None else line).cast("int")
    text = F.lit("") if evidence is None else F.substring(redact(evidence), 1, SNIPPET_TOTAL)

    def given(value: Column | None, default: str) -> Column:
        return F.lit(default) if value is None else value

    return F.struct(
        (F.lit(rule.seq).cast("long") * 1_000_000_000 + F.coalesce(line, F.lit(0))).alias("emit_idx"),
        F.lit(rule.rule_id).alias("rule_id"), F.substring(given(title, rule.title), 1, 300).alias("title"),
        F.lit(rule.category).alias("category"), given(severity, rule.severity).alias("severity"),
        given(confidence, rule.confidence).alias("confidence"), given(kind, rule.kind).alias("kind"),
        given(description, rule.description).alias("description"), F.lit(rule.remediation).alias("remediation"),
        given(path, "").alias("file_path"), line.alias("line_start"), line.alias("line_end"), text.alias("evidence"))


def _stamped(rows: DataFrame, analyzer: str, struct: Column) -> DataFrame:
    return rows.select(*AUDIT, F.lit(analyzer).alias("analyzer"), struct.alias("_f")).select(
        *AUDIT, "analyzer", "_f.*", F.array().cast("array<string>").alias("references"),
        F.array(F.lit(analyzer)).alias("sources"))


def emit(rows: DataFrame, analyzer: str, rule: Rule, **fields: Column) -> DataFrame:
    """One finding of one rule per row."""
    return _stamped(rows, analyzer, finding(rule, **fields))


def emit_each(rows: DataFrame, analyzer: str, cases: list[tuple], lists: tuple[Column, ...] = ()) -> DataFrame:
    """Findings of several rules in one pass: ``cases`` are (condition, rule[, fields]); ``lists`` are arrays of
    ``finding`` structs for rules that may hit a row more than once."""
    hits = F.array_compact(F.array(*[
        F.when(case[0], finding(case[1], **(case[2] if len(case) > 2 else {}))) for case in cases]))
    every = F.concat(hits, *lists) if lists else hits
    return _stamped(rows, analyzer, F.explode(every))


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def scan(rows: DataFrame, rules: list[Rule], analyzer: str, line: str | None = "line_no") -> DataFrame:
    """All matches of many rules in one pass over lines or files: no join and no shuffle, each text is read once."""
    hits = F.array_compact(F.array(*[F.when(selects(r), F.lit(i)) for i, r in enumerate(rules)]))
    matched = rows.withColumn("_r", F.explode(hits))

    def field(name: str) -> Column:
        return F.get(F.array(*[F.lit(getattr(r, name)) for r in rules]), F.col("_r"))

    at = (F.col(line) if line else F.lit(None)).cast("int")
    return matched.select(
        *AUDIT, F.lit(analyzer).alias("analyzer"),
        (field("seq").cast("long") * 1_000_000_000 + F.coalesce(at, F.lit(0))).alias("emit_idx"),
        field("rule_id").alias("rule_id"), field("title").alias("title"), field("category").alias("category"),
        field("severity").alias("severity"), field("confidence").alias("confidence"), field("kind").alias("kind"),
        field("description").alias("description"), field("remediation").alias("remediation"),
        F.col("path").alias("file_path"), at.alias("line_start"), at.alias("line_end"), F.lit("").alias("evidence"),
        F.array().cast("array<string>").alias("references"), F.array(F.lit(analyzer)).alias("sources"))


def first_per_file(findings: DataFrame) -> DataFrame:
    """Keep the first line of each (file, rule) and say how many there were and where."""
    from ..operators.findings import top_k

    keys = [*AUDIT, "file_path", "rule_id"]
    rows = findings.groupBy(*keys).agg(
        F.min_by(F.struct(*[c for c in findings.columns if c not in keys]), "line_start").alias("_f"), F.count(F.lit(1)).alias("sites"))
    lines = top_k(findings.select(*keys, "line_start").distinct(), keys, [F.col("line_start")], 10).groupBy(*keys).agg(
        F.array_sort(F.collect_list("line_start")).alias("site_lines"))
    return rows.join(lines, keys, "left").select(*keys, "_f.*", "sites", F.coalesce(
        "site_lines", F.array().cast("array<int>")).alias("site_lines"))


def line_of(text: str, pattern: str) -> Column:
    """Line number of a pattern's first match in a whole text (null without a match)."""
    at = F.regexp_instr(F.col(text), F.lit(pattern))
    head = F.substr(F.col(text), F.lit(1), at - 1)
    return F.when(at > 0, F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1)


def with_snippets(findings: DataFrame, lines: DataFrame, context: int = SNIPPET_CONTEXT) -> DataFrame:
    """Fill empty evidence with the numbered, redacted lines around the finding.

    Each located finding asks for its few neighbour lines by number, so the join stays an equi-join on
    (audit, path, line) and never pairs a finding with a whole file.
    """
    key = [*AUDIT, "file_path", "line_start"]
    spots = findings.filter((F.col("evidence") == "") & F.col("line_start").isNotNull()).select(*key).distinct()
    wanted = spots.withColumn("line_no", F.explode(F.sequence(
        F.greatest(F.lit(1), F.col("line_start") - context), F.col("line_start") + context)))
    text = lines.select(*AUDIT, F.col("path").alias("file_path"), "line_no", "text")
    found = wanted.join(text, [*AUDIT, "file_path", "line_no"]).groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("_l"))
    width = F.length(F.array_max(F.transform("_l", lambda x: x["line_no"])).cast("string"))
    body = F.array_join(F.transform("_l", lambda x: F.concat(
        F.lpad(x["line_no"].cast("string"), width, " "), F.lit(" | "), F.substring(x["text"], 1, SNIPPET_LINE))), "\n")
    snippets = found.filter(F.exists("_l", lambda x: x["line_no"] == F.col("line_start"))).select(
        *key, F.substring(redact(body), 1, SNIPPET_TOTAL).alias("_snippet"))
    return findings.join(snippets, key, "left").withColumn(
        "evidence", F.when(F.col("evidence") == "", F.coalesce("_snippet", F.lit(""))).otherwise(
            F.col("evidence"))).drop("_snippet")


@dataclass(frozen=True)
class Pack:
    """A registered analyzer: a function from tables to findings, with what it covers and needs."""

    name: str
    title: str
    categories: tuple[str, ...]
    run: Callable[[dict[str, DataFrame]], DataFrame]
    languages: tuple[str, ...] = ()
    seconds: float | None = None  # time limit of its own


_REGISTRY: dict[str, Pack] = {}


def register(pack: Pack) -> Pack:
    if pack.name in _REGISTRY:
        raise ValueError(f"analyzer {pack.name!r} is registered twice")
    _REGISTRY[pack.name] = pack
    return pack


def packs(names: list[str] | None = None) -> list[Pack]:
    """Registered packs in name order; unknown names are an error."""
    if names is None:
        names = list(_REGISTRY)
    unknown = sorted(set(names) - set(_REGISTRY))
    if unknown:
        raise ValueError(f"unknown analyzers: {', '.join(unknown)}")
    return [_REGISTRY[n] for n in sorted(names)]


def applicability(audits: DataFrame, language_stats: DataFrame, selected: list[Pack]) -> DataFrame:
    """Outcome rows: a pack is skipped, with the reason, where none of its languages occurs."""
    have = language_stats.groupBy(*AUDIT).agg(F.collect_set("lang").alias("_langs"))
    base = audits.select(*AUDIT).join(have, AUDIT, "left")
    none = F.array().cast("array<string>")
    rows = base.withColumn("p", F.explode(F.array(*[
        F.struct(F.lit(p.name).alias("name"), F.array(*[F.lit(c) for c in p.categories]).alias("categories"),
                 F.array(*[F.lit(x) for x in p.languages]).cast("array<string>").alias("languages"))
        for p in selected])))
    ok = (F.size("p.languages") == 0) | F.arrays_overlap("p.languages", F.coalesce("_langs", none))
    return rows.select(
        *AUDIT, "p.name", F.when(ok, "ok").otherwise("skipped").alias("status"),
        F.when(ok, "").otherwise(F.concat(F.lit("no "), F.array_join("p.languages", "/"), F.lit(" files detected")))
        .alias("reason"), "p.categories")
