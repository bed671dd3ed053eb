"""Nearest neighbours by cosine: a vantage-point tree per shard, pruned by the triangle inequality.

On unit vectors the largest cosine is the smallest Euclidean distance, which is a metric. Rows are dealt over shards by a
hash of id and vector, equal rows counted first, so a shard has a bounded expected size whatever the vectors are. A cell is one
shard and one block of queries; it builds the shard's tree and a query skips a branch whose nearest possible distance, times ``factor``, exceeds the k-th
distance it has. Vectors are scaled by powers of two, which is exact, so neither large nor tiny components overflow. Factor one is exact search; larger factors skip more. Each shard hands on k candidates per query, scored
on the original vectors in double precision, and Spark ranks them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

LEAF = 64
SLACK = 1e-9  # distances carry rounding errors; a branch is skipped only when it is farther by more than this


class Tree:
    """A vantage-point tree over unit vectors. Nodes split at the median distance; rows at equal distances stay in a
    leaf when no split separates them."""

    def __init__(self, unit: np.ndarray):
        self.unit = unit
        self.nodes: list[tuple] = []
        self.root = self._build(np.arange(len(unit)))

    def _build(self, rows: np.ndarray) -> int:
        """The number of the built node. An explicit stack keeps lopsided trees from recursing deeply."""
        first = len(self.nodes)
        stack = [(rows, None, 0)]
        while stack:
            rows, parent, side = stack.pop()
            at = len(self.nodes)
            if parent is not None:
                self.nodes[parent][side] = at
            if len(rows) <= LEAF:
                self.nodes.append([rows])
                continue
            point = self.unit[rows[0]]
            distance = np.sqrt(np.maximum(0, ((self.unit[rows] - point) ** 2).sum(axis=1)))
            radius = float(np.median(distance))
            inside = distance <= radius
            if inside.all():
                inside = distance < radius
            if not inside.any() or inside.all():
                self.nodes.append([rows])
                continue
            near, far = distance[inside], distance[~inside]
            self.nodes.append([rows[0], float(near.max()), float(far.min()), float(far.max()), -1, -1])
            stack.append((rows[inside], at, 4))
            stack.append((rows[~inside], at, 5))
        return first

    def search(self, query: np.ndarray, k: int, factor: float) -> np.ndarray:
        """Rows that may be among the ``k`` nearest to ``query``: all nearer than the k-th, and its ties. With factor one
        none is missing."""
        bound = np.inf
        rows: list[np.ndarray] = []
        distances: list[np.ndarray] = []
        best = np.empty(0)
        stack = [(0.0, self.root)]
        while stack:
            least, at = stack.pop()
            if least * factor > bound + SLACK:
                continue
            node = self.nodes[at]
            if len(node) == 1:
                some = node[0]
                d = np.sqrt(np.maximum(0, ((self.unit[some] - query) ** 2).sum(axis=1)))
                keep = d <= bound + SLACK
                rows.append(some[keep])
                distances.append(d[keep])
                best = np.sort(np.concatenate((best, d[keep])))[:k]
                if len(best) == k:
                    bound = best[-1]
                continue
            point, near_max, far_min, far_max, inner, outer = node
            gap = float(np.sqrt(max(0.0, ((self.unit[point] - query) ** 2).sum())))
            branches = [(max(0.0, gap - near_max), inner), (max(0.0, far_min - gap, gap - far_max), outer)]
            branches.sort(reverse=True)
            stack.extend(branches)
        if not rows:
            return np.empty(0, np.int64)
        row, d = np.concatenate(rows), np.concatenate(distances)
        return row[d <= bound + SLACK]


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id and v of the vectors that take part: not null, not zero, all components finite. A null id takes no part."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
            .where(F.col("id").isNotNull() & F.col("v").isNotNull())
            .where(finite).where(F.exists("v", lambda x: x != 0)))


def _scaled(data: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component to between a half and one."""
    return np.ldexp(data, -np.frexp(np.abs(data).max(axis=1, keepdims=True))[1])


def _unit(scaled: np.ndarray) -> np.ndarray:
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _cosines(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosines by sums along rows, the same for equal vectors wherever they stand."""
    return (rows * query).sum(axis=1) / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((query * query).sum()))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, factor: float = 1.0, shard_rows: int = 4096,
            query_block: int = 512) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` nearest rows, itself (its id) apart.

    Both sides have columns id and v (see ``usable``). Vectors of different lengths never meet. Candidate rows that are
    repeated all count. A query row that is repeated is asked once; queries of one id and different vectors are ranked
    each on its own. A shard holds about ``shard_rows`` rows, a cell one shard and a block of
    about ``query_block`` queries."""
    rows = written(vectors.groupBy("id", "v").agg(F.count("*").alias("n")), "vectors")
    asked = written(queries.select("id", "v").distinct(), "queries")
    shards = max(1, -(-rows.count() // shard_rows))
    blocks = max(1, -(-asked.count() // query_block))
    # a shard's rows go to one cell per block of queries and the other way round: rows x blocks and queries x shards
    left = (rows.withColumn("dim", F.size("v")).withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int"))
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    right = (asked.withColumn("query_key", F.xxhash64("v")).withColumn("dim", F.size("v")).withColumn("block", F.pmod(F.xxhash64(F.lit(1), "id", "v"), F.lit(blocks)).cast("int"))
             .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))

    def cell(key: tuple, own: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(ask):
            order = np.argsort(own["id"].to_numpy(), kind="stable")
            ids = own["id"].to_numpy()[order]
            times = np.minimum(own["n"].to_numpy()[order], k)
            data = _scaled(np.vstack(own["v"].to_list()).astype(float)[order])
            tree = Tree(_unit(data))
            asks = _scaled(np.vstack(ask["v"].to_list()).astype(float))
            for query_id, query_key, vector, unit in zip(ask["id"], ask["query_key"], asks, _unit(asks)):
                found = tree.search(unit, k + int((ids == query_id).sum()), factor)
                found = found[ids[found] != query_id]
                score = _cosines(vector, data[found])
                few = np.lexsort((ids[found], -score))[:k]
                few = np.repeat(few, times[found[few]])[:k]
                out.append(pd.DataFrame({"query_id": query_id, "query_key": query_key, "vec_id": ids[found][few], "score": score[few]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(
            {n: pd.Series(dtype="float64" if n == "score" else "int64") for n in ("query_id", "query_key", "vec_id", "score")})

    keys = ["dim", "shard", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        cell, "query_id long, query_key long, vec_id long, score double")
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
