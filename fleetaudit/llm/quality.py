"""Quality: random Fourier features of document statistics, ridge scores from partition-summed normal equations, isotonic
calibration.

Each whole text gives a few statistics. Standardised, they go through cosines of random directions, whose inner products
approximate a Gaussian kernel. The normal equations of ridge regression on those are sums over rows: every task sums its
own, Spark adds the tasks, and the driver solves one system of fixed size. Scores are binned, counted per bin, and the
pool-adjacent-violators step over the bins makes them monotone class frequencies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_class, documents, pieces, written

N_STATS = 21
_UPPER, _LOWER = slice(65, 91), slice(97, 123)
_SENTENCE = (ord("."), ord("!"), ord("?"))


def statistics(text: str) -> list[float]:
    """Statistics of a whole text; all are defined for an empty one."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, len(raw))
    count = np.bincount(raw, minlength=256)
    share = count / n
    words = text.split()
    m = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    distinct = len(set(words))
    lines = [x for x in text.split("\n") if x.strip()]
    k = max(1, len(lines))
    line_lengths = np.fromiter(map(len, lines), np.float64, len(lines)) if lines else np.zeros(1)
    letters = max(1, int(count[_UPPER].sum() + count[_LOWER].sum()))
    seen = share[share > 0]
    marks = sum(int(count[c]) for c in _SENTENCE)
    return [
        np.log1p(len(raw)), np.log1p(len(words)), float(lengths.mean()), float(lengths.std()),
        float((lengths <= 3).sum()) / m, float((lengths >= 12).sum()) / m, distinct / m,
        count[_UPPER].sum() / letters, share[48:58].sum(), share[128:].sum(), share[ord(",")] + share[ord(".")],
        share[ord("!")] + share[ord("?")], sum(share[ord(c)] for c in "#$%&*@^~+=<>\\"), sum(share[ord(c)] for c in "|/_{}[]"),
        share[32], share[10], np.log1p(float(line_lengths.mean())), len(set(lines)) / k,
        sum(x.rstrip()[-1:] in ".!?\"'" for x in lines) / k, np.log1p(m / max(1, marks)),
        float(-(seen * np.log2(seen)).sum()),
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and x (array of double) of every whole text; a null text is empty."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pieces(batches):
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "x": [list(map(float, statistics(t))) for t in batch["text"]]})

    return documents(docs, id_col, text_col).mapInPandas(run, "doc_id long, x array<double>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    at: np.ndarray  # calibration: raw scores, ascending
    to: np.ndarray  # and the class frequencies they stand for

    def map(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        cosines = np.sqrt(2 / len(self.phase)) * np.cos(z @ self.directions + self.phase)
        return np.hstack([cosines, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.map(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.at, self.to)


def _matrix(batch: pd.DataFrame) -> np.ndarray:
    return np.vstack(batch["x"].to_list()) if len(batch) else np.empty((0, N_STATS))


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the nondecreasing values nearest to ``value`` under ``weight``."""
    blocks: list[list[float]] = []
    for v, w in zip(value, weight):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v1, w1, n1 = blocks.pop()
            v0, w0, n0 = blocks.pop()
            blocks.append([(v0 * w0 + v1 * w1) / (w0 + w1), w0 + w1, n0 + n1])
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def train(stats: DataFrame, labels: DataFrame, label: str = "quality", keep=lambda doc_id: F.lit(True),
          n_directions: int = 160, width: float = 0.18, ridge: float = 1e-3, bins: int = 400, seed: int = 7) -> Model:
    """Fit on all labelled rows of ``stats`` for which ``keep(doc_id)`` holds. Null labels don't count; several labels of
    an id count as their majority, 1 on a tie. Without labelled rows every score is 0.5."""
    spark = stats.sparkSession
    y = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y"))
         .where(keep(F.col("doc_id")) & F.col("y").isNotNull() & F.col("doc_id").isNotNull())
         .groupBy("doc_id").agg(F.when(F.avg("y") >= 0.5, 1.0).otherwise(0.0).alias("y")))
    rows = written(stats.join(y, "doc_id").select("x", "y"), "quality_rows")
    sums = rows.agg(F.count("*").alias("n"), *(f(F.col("x")[i]).alias(f"{f.__name__}{i}")
                                              for i in range(N_STATS) for f in (F.avg, F.stddev_pop))).first()
    random = np.random.default_rng(seed)
    directions = random.normal(0, np.sqrt(2 * width) / np.sqrt(2), (N_STATS, n_directions))
    phase = random.uniform(0, 2 * np.pi, n_directions)
    n = sums["n"]
    if not n:
        return Model(np.zeros(N_STATS), np.ones(N_STATS), directions, phase, np.zeros(n_directions + 1),
                     np.array([0.0]), np.array([0.5]))
    mean = np.array([sums[f"avg{i}"] for i in range(N_STATS)])
    scale = np.array([sums[f"stddev_pop{i}"] or 0.0 for i in range(N_STATS)])
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), directions, phase, np.zeros(n_directions + 1),
                  np.array([0.0]), np.array([0.5]))
    shared = spark.sparkContext.broadcast(model)
    size = n_directions + 1
    upper = np.triu_indices(size)

    def equations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram, side = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            features = shared.value.map(_matrix(batch))
            gram += features.T @ features
            side += features.T @ batch["y"].to_numpy(float)
        yield pd.DataFrame({"i": np.append(upper[0], np.arange(size)), "j": np.append(upper[1], np.full(size, size)),
                            "value": np.append(gram[upper], side)})

    summed = (rows.mapInPandas(equations, "i int, j int, value double")
              .groupBy("i", "j").agg(F.sum("value").alias("value")).toPandas())
    full = np.zeros((size, size + 1))
    full[summed["i"], summed["j"]] = summed["value"]
    gram = full[:, :size] + np.triu(full[:, :size], 1).T
    penalty = ridge * n * np.eye(size)
    penalty[-1, -1] = 0
    weights = np.linalg.solve(gram + penalty + 1e-9 * np.eye(size), full[:, size])
    fitted = Model(mean, model.scale, directions, phase, weights, model.at, model.to)
    shared_fit = spark.sparkContext.broadcast(fitted)

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = np.clip(shared_fit.value.raw(_matrix(batch)), -0.5, 1.5)
            yield pd.DataFrame({"bin": np.floor((raw + 0.5) * bins / 2).astype("int32"), "raw": raw, "y": batch["y"]})

    hist = (rows.mapInPandas(binned, "bin int, raw double, y double").groupBy("bin")
            .agg(F.count("*").alias("n"), F.avg("y").alias("y"), F.avg("raw").alias("raw")).orderBy("bin").toPandas())
    fitted.at = hist["raw"].to_numpy(float)
    fitted.to = isotonic(hist["y"].to_numpy(float), hist["n"].to_numpy(float))
    return fitted


def score(stats: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, score (0 to 1) and predicted per row of ``stats``."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = np.clip(shared.value.score(_matrix(batch)), 0, 1)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": got,
                                "predicted": (got >= threshold).astype("int32")})

    return stats.mapInPandas(run, "doc_id long, score double, predicted int")


def held_out_scores(docs: DataFrame, labels: DataFrame, modulus: int = 3, fold: int = 1) -> DataFrame:
    """Scores of all documents by a model that learns only from ids outside ``fold``: doc_id, held_out, score,
    predicted."""
    stats = written(document_statistics(docs), "quality_statistics")
    model = train(stats, labels, keep=lambda doc_id: crc_class(doc_id, modulus) != fold)
    return score(stats, model).select(
        "doc_id", (crc_class(F.col("doc_id"), modulus) == fold).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, modulus: int = 3, fold: int = 1, id_col: str = "doc_id",
              text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose whole text (null: empty) scores ``threshold`` or more, all columns kept. The model learns
    from the labelled ids outside ``fold``; statistics of a row are made where the row is, so nothing else moves."""
    keep = lambda doc_id: crc_class(doc_id, modulus) != fold
    marked = labels.where(keep(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    model = train(written(document_statistics(documents(docs, id_col, text_col).join(marked, "doc_id", "left_semi")), "quality_statistics"),
                  labels, keep=keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def quality(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype="float64")
        return pd.Series(shared.value.score(np.array([statistics(t) for t in texts], float)))

    return docs.where(quality(F.coalesce(F.col(text_col), F.lit(""))) >= threshold)
