"""Category and overall scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import core as C
from . import AUDIT


def assessed_categories(outcomes: DataFrame) -> DataFrame:
    """Categories covered by at least one analyzer that finished."""
    return outcomes.filter(F.col("status") == "ok").select(
        *AUDIT, F.explode("categories").alias("category")).distinct()


def category_scores(findings: DataFrame, outcomes: DataFrame, audits: DataFrame) -> DataFrame:
    """Ten rows per audit. A rule's penalties are capped at three times its heaviest severity; the tightest
    ceiling then bounds the category. Two mergeable aggregations: per rule, then per category."""
    rules = findings.filter(C.is_scored()).groupBy(*AUDIT, "category", "rule_id").agg(
        F.sum(C.penalty()).alias("_sum"), F.max(C.rule_cap()).alias("_cap"),
        F.count(F.lit(1)).alias("_n"),
        F.min(F.when(C.ceiling().isNotNull(),
                     F.struct(C.ceiling().alias("bound"), F.col("analyzer"), F.col("emit_idx"),
                              C.ceiling_reason(C.ceiling()).alias("reason")))).alias("_ceiling"))
    cats = rules.groupBy(*AUDIT, "category").agg(
        F.sum(F.least("_sum", "_cap")).alias("_penalty"), F.sum("_n").alias("findings"),
        F.min("_ceiling").alias("_ceiling"))
    grid = audits.select(*AUDIT).withColumn(
        "category", F.explode(F.array(*[F.lit(c) for c in V.CATEGORIES])))
    seen = assessed_categories(outcomes).withColumn("assessed", F.lit(True))
    joined = grid.join(seen, [*AUDIT, "category"], "left").join(cats, [*AUDIT, "category"], "left")
    assessed = F.coalesce("assessed", F.lit(False))
    penalty = F.coalesce("_penalty", F.lit(0).cast("decimal(22,4)"))
    value = F.greatest(F.lit(0).cast("decimal(22,4)"), F.lit(100) - penalty)
    capped = F.col("_ceiling.bound").isNotNull() & (value > F.col("_ceiling.bound"))
    score = C.half_even(F.when(capped, F.col("_ceiling.bound")).otherwise(value).cast("decimal(22,4)"), 1)
    return joined.select(
        *AUDIT, "category", assessed.alias("assessed"),
        F.when(assessed, score).cast("decimal(5,1)").alias("score"),
        F.when(assessed, C.half_even(penalty, 2)).otherwise(0).cast("decimal(22,2)").alias("penalty"),
        F.coalesce("findings", F.lit(0)).alias("findings"),
        F.when(assessed & capped, F.col("_ceiling.reason")).otherwise("").alias("ceiling_reason"),
    ).withColumn("risk", C.risk_label(F.col("score")))


def overall_scores(categories: DataFrame) -> DataFrame:
    """Weighted mean of assessed categories; the label never hides a worse category."""
    weight = C.lookup(F.col("category"), V.CATEGORY_WEIGHT, "decimal(2,1)")
    level = C.risk_level(F.col("risk"))
    floor = F.when(F.col("category").isin(*V.CRITICAL_CATEGORIES), level).otherwise(level - 1)
    rows = categories.filter("assessed")
    sums = rows.groupBy(*AUDIT).agg(
        F.sum((F.col("score") * weight).cast("decimal(12,2)")).alias("_s"), F.sum(weight).alias("_w"),
        F.max(floor).alias("_floor"), F.count(F.lit(1)).alias("assessed"))
    overall = C.half_even((F.col("_s") / F.col("_w")).cast("decimal(30,12)"), 1).cast("decimal(5,1)")
    scored = sums.withColumn("overall", overall)
    names = {i: n for i, n in enumerate(V.RISK_LEVELS)}
    risk = C.lookup(F.greatest(C.risk_level(C.risk_label(F.col("overall"))), F.col("_floor")), names)
    return scored.select(*AUDIT, "overall", risk.alias("risk"), "assessed")


def scorecard(findings: DataFrame, outcomes: DataFrame, audits: DataFrame) -> DataFrame:
    """Overall row per audit, including audits in which nothing could be assessed."""
    overall = overall_scores(category_scores(findings, outcomes, audits))
    return audits.select(*AUDIT).join(overall, AUDIT, "left").withColumns({
        "risk": F.coalesce("risk", F.lit(V.NOT_ASSESSED)), "assessed": F.coalesce("assessed", F.lit(0))})
