"""Did a fix work? Compares the findings of an audit with those of its re-audit in the changed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def compare(targets: DataFrame, baseline: DataFrame, after: DataFrame, changed: DataFrame,
            key: list[str]) -> tuple[DataFrame, DataFrame]:
    """``key`` names one fix run and is present in all four inputs.

    Returns (targets with ``resolved``, introduced findings). A target is resolved when its fingerprint is gone and
    its (file, rule) count fell. A new fingerprint is introduced only within the count increase, by line.
    """
    spot = [*key, "file_path", "rule_id"]
    scope = changed.select(*key, F.col("path").alias("file_path")).distinct()
    before_n = baseline.join(scope, [*key, "file_path"], "left_semi").groupBy(*spot).agg(
        F.count(F.lit(1)).alias("before_n"))
    in_scope = after.join(scope, [*key, "file_path"], "left_semi")
    after_n = in_scope.groupBy(*spot).agg(F.count(F.lit(1)).alias("after_n"))
    still = after.select(*key, "fingerprint").distinct().withColumn("_still", F.lit(True))
    judged = targets.join(still, [*key, "fingerprint"], "left").join(before_n, spot, "left").join(
        after_n, spot, "left").na.fill(0, ["before_n", "after_n"])
    judged = judged.withColumn(
        "resolved", F.col("_still").isNull() & (F.col("after_n") < F.col("before_n"))).drop("_still")
    known = baseline.select(*key, "fingerprint").distinct()
    budget = after_n.join(before_n, spot, "left").select(
        *spot, (F.col("after_n") - F.coalesce("before_n", F.lit(0))).alias("budget")).filter("budget > 0")
    order = Window.partitionBy(*spot).orderBy(F.coalesce("line_start", F.lit(0)), "fingerprint")
    fresh = in_scope.join(known, [*key, "fingerprint"], "left_anti").join(budget, spot)
    introduced = fresh.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= F.col("budget")).drop(
        "_rn", "budget")
    return judged.drop("before_n", "after_n"), introduced


def verdict(judged: DataFrame, introduced: DataFrame, incomplete: DataFrame, key: list[str]) -> DataFrame:
    """regressed > incomplete > passed (nothing left) > partial."""
    left = judged.groupBy(*key).agg(
        F.count(F.when(F.col("resolved"), 1)).alias("resolved"),
        F.count(F.when(~F.col("resolved"), 1)).alias("still_present"))
    new = introduced.groupBy(*key).agg(F.count(F.lit(1)).alias("introduced"))
    gaps = incomplete.groupBy(*key).agg(F.count(F.lit(1)).alias("incomplete"))
    rows = left.join(new, key, "left").join(gaps, key, "left").na.fill(0)
    return rows.withColumn(
        "verdict", F.when(F.col("introduced") > 0, "regressed").when(F.col("incomplete") > 0, "incomplete")
        .when(F.col("still_present") == 0, "passed").otherwise("partial"))


def analyzers_to_rerun(outcomes: DataFrame, baseline: DataFrame, changed: DataFrame, skip: list[str],
                       key: list[str]) -> DataFrame:
    """Analyzers that finished, minus ``skip`` unless one of those reported a finding in a changed file."""
    ok = outcomes.filter(F.col("status") == "ok").select(*key, F.col("name").alias("analyzer")).distinct()
    scope = changed.select(*key, F.col("path").alias("file_path")).distinct()
    relevant = baseline.join(scope, [*key, "file_path"], "left_semi").select(
        *key, F.explode("sources").alias("analyzer")).distinct()
    skipped = ok.filter(F.col("analyzer").isin(*skip)).join(relevant, [*key, "analyzer"], "left_anti")
    return ok.join(skipped, [*key, "analyzer"], "left_anti").groupBy(*key).agg(
        F.array_sort(F.collect_set("analyzer")).alias("analyzers"))
