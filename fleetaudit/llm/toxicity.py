"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

Features are the presence of hashed character n-grams (UTF-8 bytes of the lowered text). Training counts, for each
feature, the labelled texts of either class that have it; the log ratio of the two (smoothed) frequencies scales the
feature. The features whose ratio stands furthest from zero by its own error are kept, and a logistic regression with a
quadratic penalty is fitted on them. Counting and choosing are Spark aggregates over the training sample; what reaches the
driver is the chosen features and the sample's rows over them, both bounded by parameters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_class, documents, pieces, written

SIZES = (4, 5, 6)
HASH_BITS = 22
WINDOW = 1 << 20


def grams(text: str) -> Iterator[np.ndarray]:
    """Hashed n-grams of a text, window by window and size by size, repeats included."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)
    for lo in range(0, len(raw), WINDOW):
        b = raw[lo:lo + WINDOW + max(SIZES) - 1].astype(np.uint32)
        if len(b) < SIZES[0]:
            continue
        rolled = b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24)
        for size in SIZES:
            if size > SIZES[0]:
                if len(b) < size:
                    break
                rolled = rolled[:-1] * np.uint32(0x9E3779B1) + b[size - 1:] * np.uint32(0x85EBCA77)
            mixed = rolled * np.uint32(0xC2B2AE3D)
            mixed ^= mixed >> np.uint32(15)
            yield mixed * np.uint32(0x27D4EB2F) >> np.uint32(32 - HASH_BITS)


def features(text: str) -> np.ndarray:
    """The distinct features of a text, ascending."""
    parts = list(grams(text))
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint32)


@dataclass
class Model:
    """Log-odds of a text: ``bias`` plus the weights of its chosen features."""

    chosen: np.ndarray  # ascending
    weights: np.ndarray
    bias: float

    def scorer(self):
        known = np.zeros(1 << HASH_BITS, np.uint8)
        known[self.chosen] = 1

        def score(text: str) -> float:
            hits = [g[known[g] > 0] for g in grams(text)]
            found = np.unique(np.concatenate(hits)) if hits else np.empty(0, np.uint32)
            total = self.bias + float(self.weights[np.searchsorted(self.chosen, found)].sum())
            return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))

        return score


def training_sample(docs: DataFrame, labels: DataFrame, label: str, keep, limit: int) -> DataFrame:
    """(doc_id, text, y): at most ``limit`` labelled documents in the order of a hash of their ids. Labels that are
    null don't count; several labels of an id count as their majority, 1 on a tie."""
    y = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y"))
         .where(keep(F.col("doc_id")) & F.col("y").isNotNull() & F.col("doc_id").isNotNull())
         .groupBy("doc_id").agg(F.when(F.avg("y") >= 0.5, 1).otherwise(0).alias("y")))
    few = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return docs.join(few, "doc_id")


def fit_logistic(x_rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, penalty: float, rounds: int = 150):
    """Weights on ``scale * presence`` and the bias, by full-batch steps with per-coordinate step sizes."""
    if not len(y):
        return np.zeros(len(scale)), 0.0
    lengths = np.array([len(r) for r in x_rows])
    column = np.concatenate(x_rows).astype(np.int64) if lengths.sum() else np.empty(0, np.int64)
    row = np.repeat(np.arange(len(y)), lengths)
    values = scale[column]
    rate = (y.sum() + 0.5) / (len(y) + 1)
    w, bias = np.zeros(len(scale)), float(np.log(rate / (1 - rate)))
    first, second = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, rounds + 1):
        margin = bias + np.bincount(row, values * w[column], len(y))
        gap = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y
        grad = np.append(np.bincount(column, values * gap[row], len(w)) / len(y) + penalty * w, gap.mean())
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad ** 2
        move = 0.05 * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return w, float(bias)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", keep=lambda doc_id: F.lit(True),
          sample: int = 12_000, n_features: int = 3_000, smoothing: float = 1.0, penalty: float = 1e-4) -> Model:
    """Fit on at most ``sample`` labelled documents for which ``keep(doc_id)`` holds (the documented bound).

    Without any labelled text the model scores 0.5 everywhere."""
    spark = docs.sparkSession
    rows = written(training_sample(documents(docs), labels, label, keep, sample), "toxicity_sample")
    size = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((2, 1 << HASH_BITS), np.int32)
        for batch in pieces(batches):
            for text, y in zip(batch["text"], batch["y"]):
                counts[y, features(text)] += 1
        feature = np.flatnonzero(counts.any(axis=0))
        for lo in range(0, len(feature), 200_000):
            some = feature[lo:lo + 200_000]
            yield pd.DataFrame({"feature": some, "pos": counts[1, some], "neg": counts[0, some]})

    p, q = F.col("pos") + smoothing, F.col("neg") + smoothing
    chosen = (rows.select("text", "y").mapInPandas(count, "feature int, pos long, neg long")
              .groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where("pos + neg >= 3")
              .withColumn("ratio", F.log(p / (n1 + 2 * smoothing)) - F.log(q / (n0 + 2 * smoothing)))
              .withColumn("weight", F.abs("ratio") / F.sqrt(1 / p + 1 / q))
              .orderBy(F.desc("weight"), "feature").limit(n_features).select("feature", "ratio"))
    table = chosen.toPandas().sort_values("feature")
    ids, ratio = table["feature"].to_numpy(np.uint32), table["ratio"].to_numpy(float)
    shared = spark.sparkContext.broadcast(ids)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = np.zeros(1 << HASH_BITS, np.uint8)
        known[shared.value] = 1
        for batch in pieces(batches):
            own = []
            for text in batch["text"]:
                found = features(text)
                own.append(np.searchsorted(shared.value, found[known[found] > 0]).astype("<u2").tobytes())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "own": own, "y": batch["y"]})

    # bounded by sample x n_features, and far smaller: the features a text really has
    data = rows.mapInPandas(project, "doc_id long, own binary, y int").toPandas().sort_values("doc_id", kind="stable")
    weights, bias = fit_logistic([np.frombuffer(x, "<u2") for x in data["own"]], data["y"].to_numpy(float), ratio, penalty)
    return Model(ids, weights * ratio, bias)


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score (0 to 1) and predicted of every whole text; null and empty texts get the bias's score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value.scorer()
        for batch in pieces(batches):
            got = np.array([own(t) for t in batch["text"]])
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": got,
                                "predicted": (got >= threshold).astype("int32")})

    return documents(docs).mapInPandas(run, "doc_id long, score double, predicted int")


def held_out_scores(docs: DataFrame, labels: DataFrame, modulus: int = 4, fold: int = 2) -> DataFrame:
    """Scores of all documents by a model that learns only from ids outside ``fold``: doc_id, held_out, score,
    predicted."""
    model = train(docs, labels, keep=lambda doc_id: crc_class(doc_id, modulus) != fold)
    scored = score(docs, model)
    return scored.select("doc_id", (crc_class(F.col("doc_id"), modulus) == fold).alias("held_out"), "score", "predicted")
