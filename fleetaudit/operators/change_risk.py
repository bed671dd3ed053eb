"""How much scrutiny a pull request deserves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions.core import change_level, lookup
from ..functions.text import is_test_path, language
from . import AUDIT
from .findings import top_k


def _areas(files: DataFrame) -> DataFrame:
    """Points per sensitive area, in fixed order, cut where the running total reaches the cap (six rows at most
    per audit, so the window is bounded)."""
    hits = files.filter(~is_test_path("path")).select(*AUDIT, "path", "seq", F.explode(F.array_compact(F.array(*[
        F.when(F.col("path").rlike(pattern), F.struct(
            F.lit(i).alias("area"), F.lit(name).alias("name"), F.lit(points).alias("full")))
        for i, (name, points, pattern) in enumerate(V.SENSITIVE_AREAS)]))).alias("a")).select(
        *AUDIT, "path", "seq", "a.*")
    counts = hits.groupBy(*AUDIT, "area", "name", "full").agg(F.count(F.lit(1)).alias("hits"))
    shown = top_k(hits, [*AUDIT, "area"], [F.col("seq"), F.col("path")], 3).groupBy(*AUDIT, "area").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("shown"))
    w = Window.partitionBy(*AUDIT).orderBy("area").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum("full").over(w), F.lit(0))
    points = F.greatest(F.lit(0), F.least(F.col("full"), F.lit(V.SENSITIVE_CAP) - spent)).cast("int")
    more = F.when(F.col("hits") > 3, F.concat(F.lit(" and "), (F.col("hits") - 3).cast("string"), F.lit(" more"))) \
        .otherwise("")
    return counts.withColumn("points", points).filter("points > 0").join(shown, [*AUDIT, "area"]).select(
        *AUDIT, "area", F.lit("sensitive area").alias("factor"), "points",
        F.concat("name", F.lit(": "), F.array_join("shown", ", "), more).alias("detail"))


def assess(files: DataFrame, introduced: DataFrame, audits: DataFrame) -> DataFrame:
    """Score, level and named factors per audit.

    ``files``: (audit, path, additions, deletions, seq). ``introduced``: findings with severity and rule_id.
    """
    lang_code = language("path").isin(*V.CODE_LANGUAGES)
    size = files.groupBy(*AUDIT).agg(
        F.sum(F.col("additions") + F.col("deletions")).alias("lines"), F.count(F.lit(1)).alias("n"),
        F.count(F.when(lang_code & ~is_test_path("path"), 1)).alias("code"),
        F.count(F.when(is_test_path("path"), 1)).alias("tests"))
    areas = _areas(files).groupBy(*AUDIT).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("area", "factor", "points", "detail"))),
                    lambda x: F.struct(x["factor"], x["points"], x["detail"])).alias("areas"))
    points = lookup(F.col("severity"), V.INTRODUCED_POINTS, "int", 0)
    found = introduced.groupBy(*AUDIT).agg(
        F.sum(points).alias("found"),
        F.count(F.when(F.col("rule_id").contains(":ai-code."), 1)).alias("ai"),
        *[F.count(F.when(F.col("severity") == s, 1)).alias(s) for s in V.SEVERITIES])
    rows = audits.select(*AUDIT).join(size, AUDIT, "left").join(areas, AUDIT, "left").join(found, AUDIT, "left")
    rows = rows.na.fill(0, ["lines", "n", "code", "tests", "found", "ai", *V.SEVERITIES])

    def factor(name: str, pts, detail):
        return F.when(pts > 0, F.struct(
            F.lit(name).alias("factor"), pts.cast("int").alias("points"), detail.alias("detail")))

    def text(col: str, words: str):
        return F.concat(F.col(col).cast("string"), F.lit(words))

    by_lines = F.when(F.col("lines") > 1000, 25).when(F.col("lines") > 400, 15).when(F.col("lines") > 150, 8).otherwise(0)
    by_files = F.when(F.col("n") > 30, 10).when(F.col("n") > 10, 5).otherwise(0)
    untested = F.when((F.col("code") > 0) & (F.col("tests") == 0), 15).otherwise(0)
    severities = F.array_join(F.array_compact(F.array(*[
        F.when(F.col(s) > 0, F.concat(F.col(s).cast("string"), F.lit(f" {s}"))) for s in V.SEVERITIES])), ", ")
    before = F.array(factor("size", by_lines, text("lines", " changed lines")),
                     factor("size", by_files, text("n", " changed files")))
    after = F.array(
        factor("tests", untested, text("code", " source file(s) changed, no test file changed")),
        factor("introduced findings", F.least(F.lit(30), F.col("found")), severities),
        factor("AI-generated code patterns", F.least(F.lit(15), F.col("ai") * 5),
               text("ai", " finding(s) typical of generated code")))
    none = F.array().cast("array<struct<factor:string,points:int,detail:string>>")
    factors = F.filter(F.concat(before, F.coalesce("areas", none), after), lambda f: f.isNotNull())
    rows = rows.withColumn("factors", factors)
    score = F.least(F.lit(100), F.aggregate("factors", F.lit(0), lambda acc, f: acc + f["points"]))
    return rows.select(*AUDIT, score.alias("score"), "factors").withColumn("level", change_level(F.col("score")))
