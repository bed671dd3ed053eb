"""Explanation requests and the guard around model responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions.text import location, prompt_safe, redact
from . import AUDIT
from .findings import ai_candidates

# Response limits.
TEXT, STEP, PATCH, STEPS, SUMMARY, RISKS, RISK = 2000, 500, 4000, 5, 3000, 5, 300
LIKELIHOODS = ["low", "medium", "high"]
# End of fixed values

EXPLANATIONS = ("explanations array<struct<id:string,explanation:string,remediation_steps:array<string>,"
                "suggested_patch:string,false_positive_likelihood:string>>")
SUMMARIES = ("summary string, top_risks array<string>, observations array<struct<title:string,description:string,"
             "category:string,file_path:string>>")


def request_batches(findings: DataFrame, k: int = 15, size: int = 5) -> DataFrame:
    """Payload batches for the chosen findings of each audit: at most ``k`` rows, ``size`` per request."""
    rows = ai_candidates(findings, k).withColumn("id", F.concat(F.lit("F"), F.col("rank").cast("string")))
    payload = F.struct(
        "id", F.col("rule_id").alias("rule"), prompt_safe("title").alias("title"), "severity", "kind", "category",
        prompt_safe(location("file_path", "line_start")).alias("location"),
        F.substring(prompt_safe("description"), 1, 800).alias("description"),
        F.substring(prompt_safe("evidence"), 1, 600).alias("evidence"))
    rows = rows.withColumns({"batch": F.floor((F.col("rank") - 1) / size).cast("int"), "_p": payload})
    return rows.groupBy(*AUDIT, "batch").agg(
        F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("rank", "_p"))), lambda x: x["_p"])).alias("payload"),
        F.sort_array(F.collect_set("id")).alias("ids"))


def _clean(col, limit: int):
    return F.trim(F.substring(redact(F.coalesce(col, F.lit(""))), 1, limit))


def explanations(responses: DataFrame, allowed: DataFrame) -> DataFrame:
    """Validated explanations: known ids only, the first per id, every text redacted and shortened.

    ``responses`` (audit, batch, response); ``allowed`` (audit, batch, id). Unreadable responses give no row.
    """
    items = responses.select(*AUDIT, "batch", F.posexplode(F.from_json("response", EXPLANATIONS)["explanations"]).alias(
        "_i", "e")).withColumn("id", F.col("e.id"))
    rows = items.join(allowed, [*AUDIT, "batch", "id"], "left_semi").withColumn(
        "explanation", _clean(F.col("e.explanation"), TEXT)).filter("explanation <> ''")
    first = Window.partitionBy(*AUDIT, "batch", "id").orderBy("_i")
    rows = rows.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") == 1)
    steps = F.filter(F.transform(F.slice(F.coalesce("e.remediation_steps", F.array().cast("array<string>")), 1, STEPS),
                                 lambda s: _clean(s, STEP)), lambda s: s != "")
    likely = F.col("e.false_positive_likelihood")
    return rows.select(*AUDIT, "batch", "id", "explanation", steps.alias("remediation_steps"),
                       _clean(F.col("e.suggested_patch"), PATCH).alias("suggested_patch"),
                       F.when(likely.isin(*LIKELIHOODS), likely).otherwise("").alias("false_positive_likelihood"))


def observations(responses: DataFrame, files: DataFrame) -> DataFrame:
    """Unscored observations out of summary responses: known categories, unknown files blanked."""
    parsed = responses.withColumn("s", F.from_json("response", SUMMARIES)).filter(F.col("s.summary").isNotNull())
    rows = parsed.select(*AUDIT, F.posexplode("s.observations").alias("emit_idx", "o")).select(
        *AUDIT, F.col("emit_idx").cast("long").alias("emit_idx"), _clean(F.col("o.title"), 200).alias("title"),
        _clean(F.col("o.description"), 1500).alias("description"), F.col("o.category").alias("category"),
        F.coalesce("o.file_path", F.lit("")).alias("file_path"))
    rows = rows.filter(F.col("category").isin(*V.CATEGORIES) & (F.col("title") != "") & (F.col("description") != ""))
    known = files.select(*AUDIT, F.col("path").alias("file_path")).distinct().withColumn("_known", F.lit(True))
    rows = rows.join(known, [*AUDIT, "file_path"], "left")
    none = F.lit(None).cast("int")
    return rows.select(
        *AUDIT, F.lit("ai").alias("analyzer"), "emit_idx", F.lit("ai:observation").alias("rule_id"), "title", "category",
        F.lit("info").alias("severity"), F.lit("low").alias("confidence"), F.lit("ai_observation").alias("kind"),
        "description", F.lit("Review manually; generated by a model and not scored.").alias("remediation"),
        F.when(F.col("_known"), F.col("file_path")).otherwise("").alias("file_path"), none.alias("line_start"),
        none.alias("line_end"), F.lit("").alias("evidence"), F.array().cast("array<string>").alias("references"),
        F.array(F.lit("ai")).alias("sources"))


def attach(findings: DataFrame, explained: DataFrame) -> DataFrame:
    """Copy nothing but the explanation onto findings; severity, kind and place cannot change.

    ``explained`` has (audit, fingerprint, explanation, …).
    """
    fields = [c for c in explained.columns if c not in (*AUDIT, "fingerprint")]
    rows = explained.select(*AUDIT, "fingerprint", F.struct(*fields).alias("ai_explanation"))
    return findings.drop("ai_explanation").join(rows, [*AUDIT, "fingerprint"], "left")


def unlinked(findings: DataFrame, links: DataFrame) -> DataFrame:
    """Findings without an issue link of their repository and fingerprint."""
    return findings.join(links.select("org_id", "repo_id", "fingerprint"), ["org_id", "repo_id", "fingerprint"], "left_anti")
