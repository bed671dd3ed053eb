"""Centroid clustering (Lloyd's rounds on integers) over a vector approximation file.

Every vector is kept twice: in full, and as a few bits per dimension that name one of ``2 ** bits`` cells with about equal
numbers of vectors. Against a centroid, a table per dimension holds the least and the largest share of the squared
distance a cell allows, so a look-up per dimension gives an interval of the distance. (All intervals leave out the
vector's own squared length: it is the same for every centroid, and without it they are narrow, as centroids are short.)
Where one centroid's interval lies below all others the approximation decides. Full vectors are fetched, by an equi-join
on their keys, only where intervals overlap or a vector changes its cluster, for the sums the centroids are kept by.

The arithmetic is exact: components are the integers ``floor(scale * x)``, sums travel as signed digits of 40 bits, and
what no 64-bit integer holds is computed with Python's. Borders of cells are doubles and only steer what is fetched; their
intervals are widened by more than the rounding."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

NARROW = 1 << 27  # components below this keep squared distances of up to 64 dimensions within a long
DIGIT = 40
LONGEST = (1 << 63) - 1


def integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of every component, as int64 or, if a component is too large for exact sums, as Python integers."""
    if not vectors.size:
        return np.zeros(vectors.shape, np.int64)
    if np.abs(vectors).max() < NARROW / scale:
        return np.floor(vectors * scale).astype(np.int64)
    # from 2 ** 53 on a double is a whole number
    return np.array([[int(x) * scale if abs(x) >= 2.0 ** 53 else int(np.floor(x * scale)) for x in row] for row in vectors.tolist()], object)


def squares(points: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Squared distance of every point to a centroid."""
    if points.dtype == object or centroid.dtype == object:
        points, centroid = points.astype(object), centroid.astype(object)
    return ((points - centroid) ** 2).sum(axis=1)


def _array(centroids: list[list[int]]) -> list[np.ndarray]:
    return [np.array(c, np.int64 if max(map(abs, c), default=0) < NARROW else object) for c in centroids]


class Cells:
    """Borders of the cells of every dimension: ``edges[j]`` ascending, the outer ones the least and largest values."""

    def __init__(self, edges: np.ndarray, bits: int):
        self.edges, self.bits = edges, bits

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """The cell of every component, packed in ``bits`` each, a row of bytes per vector."""
        cell = np.stack([np.searchsorted(self.edges[j, 1:-1], vectors[:, j], side="right") for j in range(vectors.shape[1])], axis=1)
        wide = (cell[:, :, None] >> np.arange(self.bits)) & 1
        return np.packbits(wide.reshape(len(vectors), -1).astype(np.uint8), axis=1)

    def decode(self, rows: np.ndarray, dims: int) -> np.ndarray:
        wide = np.unpackbits(rows, axis=1, count=dims * self.bits).reshape(len(rows), dims, self.bits)
        return (wide.astype(np.int64) << np.arange(self.bits)).sum(axis=2)

    def tables(self, centroid: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
        """(dims, cells) tables of the least and largest share of a dimension in the squared distance to ``centroid``, less
        the vector's own squared length. A component's integer may lie one below the scaled double."""
        c = centroid.astype(float)[:, None]
        ends = [c * c - 2 * c * x for x in (self.edges[:, :-1] * scale - 1, self.edges[:, 1:] * scale)]
        least, most = np.minimum(*ends), np.maximum(*ends)
        slack = 1e-12 * (np.maximum(np.abs(least), np.abs(most)) + c * c)
        return least - slack, most + slack

    def nearest(self, cell: np.ndarray, centroids: list[np.ndarray], scale: int) -> np.ndarray:
        """The number of the centroid that is nearest whatever the vectors of these cells are, or -1."""
        dims = np.arange(cell.shape[1])
        least, most = (np.empty((len(centroids), len(cell))) for _ in range(2))
        with np.errstate(over="ignore", invalid="ignore"):
            for k, centroid in enumerate(centroids):
                near, far = self.tables(centroid, scale)
                least[k], most[k] = near[dims, cell].sum(axis=1), far[dims, cell].sum(axis=1)
            best = most.argmin(axis=0)
            at = np.arange(len(cell))
            bound = most[best, at]
            least[best, at] = np.inf
            return np.where(np.isfinite(bound) & (least.min(axis=0) > bound), best, -1)


def nearest(points: np.ndarray, centroids: list[np.ndarray]) -> np.ndarray:
    """The nearest centroid of every point by exact distances, ties to the smaller number."""
    best = squares(points, centroids[0])
    at = np.zeros(len(points), np.int64)
    for k, centroid in enumerate(centroids[1:], 1):
        d = squares(points, centroid)
        closer = (d < best).astype(bool)
        at[closer], best = k, np.where(closer, d, best)
    return at


def usable(vectors: DataFrame, dims: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and v of the vectors with exactly ``dims`` components, none null or non-finite."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(F.col(id_col).alias("vec_id"), v.alias("v")).where((F.size("v") == dims) & finite)


def _edges(full: DataFrame, dims: int, bits: int) -> np.ndarray:
    """Cell borders by approximate quantiles, one bounded sketch per dimension; the ends are exact."""
    share = [i / 2 ** bits for i in range(1, 2 ** bits)]
    row = full.agg(*(F.struct(F.min(F.get("v", F.lit(j))), F.percentile_approx(F.get("v", F.lit(j)), share, 2000), F.max(F.get("v", F.lit(j)))).alias(f"e{j}")
                     for j in range(dims))).first()
    return np.array([[e[0], *e[1], e[2]] for e in row])


def _digits(sums: list[int], at: int) -> list[int]:
    return [(abs(s) >> DIGIT * at & (1 << DIGIT) - 1) * (1 if s >= 0 else -1) for s in sums]


def _changes(fetched: DataFrame, dims: int, scale: int, centroids: list[np.ndarray]) -> tuple[str, object]:
    """Schema and function of the pass over fetched vectors (key, old, new, v): decides those with new = -1, gives those that
    change their cluster, and rows of digits of what the changes add to the sums of the clusters, a task's together."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = [[0] * dims for _ in centroids]
        counts = [0] * len(centroids)
        empty = [None]
        for batch in batches:
            points = integers(np.vstack(batch["v"].to_list()), scale)
            old, new = batch["old"].to_numpy(), batch["new"].to_numpy().copy()
            open_ = new < 0
            new[open_] = nearest(points[open_], centroids)
            for k in range(len(centroids)):
                for rows, sign in (((new == k) & (old != k), 1), ((old == k) & (new != k), -1)):
                    if rows.any():
                        counts[k] += sign * int(rows.sum())
                        sums[k] = [s + sign * int(x) for s, x in zip(sums[k], points[rows].sum(axis=0).tolist())]
            moved = batch["key"][new != old]
            yield pd.DataFrame({"key": moved, "new": new[new != old], "digit": -1, "count": 0, "sums": empty * len(moved)}).astype({"sums": object})
        out = [(None, k, at, counts[k] if at == 0 else 0, _digits(sums[k], at)) for k in range(len(centroids))
               for at in range(max(1, max(-(-abs(s).bit_length() // DIGIT) for s in sums[k])))]
        yield pd.DataFrame(out, columns=["key", "new", "digit", "count", "sums"]).astype({"key": "Int64"})

    return "key long, new int, digit int, count long, sums array<long>", run


def cluster(vectors: DataFrame, clusters: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, salt: str = "3",
            bits: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of every usable vector.

    The first centroids are the vectors with the smallest sha256 of ``salt:vec_id`` (of equal ids, the smaller vectors; a
    null id is an empty text), fewer if there are fewer vectors. Each round assigns every vector to its nearest centroid
    (ties: the smaller number) and replaces the centroids that have vectors by the floor of their mean. Repeated rows are
    vectors of their own. A distance or sum of distances that no long holds is null."""
    full = written(usable(vectors, dims, id_col, vector_col).withColumn("key", F.monotonically_increasing_id()), "vectors")
    named = F.sha2(F.concat(F.lit(salt + ":"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = full.select(named.alias("h"), "v").orderBy("h", "v").limit(clusters).collect()
    out = "vec_id {}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string".format(full.schema["vec_id"].dataType.simpleString())
    if not first:
        return full.sparkSession.createDataFrame([], out)
    centroids = [[int(x) for x in row] for row in integers(np.array([r["v"] for r in first]), scale).tolist()]
    cells = Cells(_edges(full, dims, bits), bits)

    def approximate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            codes = cells.encode(np.vstack(batch["v"].to_list())) if len(batch) else []
            yield pd.DataFrame({"key": batch["key"], "code": [c.tobytes() for c in codes], "old": -1})

    state = written(full.select("key", "v").mapInPandas(approximate, "key long, code binary, old int"), "approximations")
    sums, counts = [[0] * dims for _ in centroids], [0] * len(centroids)

    def decide(state: DataFrame, at: list[np.ndarray]) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    rows = np.frombuffer(b"".join(batch["code"]), np.uint8).reshape(len(batch), -1)
                    yield batch.assign(new=cells.nearest(cells.decode(rows, dims), at, scale))

        return state.mapInPandas(run, "key long, code binary, old int, new int")

    for _ in range(rounds):
        at = _array(centroids)
        asked = decide(state, at).where("new < 0 or new <> old").select("key", "old", "new")
        schema, run = _changes(full, dims, scale, at)
        changed = written(asked.join(full.select("key", "v"), "key").mapInPandas(run, schema), "changes")
        per = (changed.where("digit >= 0").groupBy("new", "digit")
               .agg(F.sum("count").alias("count"), *(F.sum(F.get("sums", F.lit(j))).alias(f"s{j}") for j in range(dims))).collect())
        for r in per:
            counts[r["new"]] += r["count"]
            for j in range(dims):
                sums[r["new"]][j] += r[f"s{j}"] << DIGIT * r["digit"]
        centroids = [[s // n for s in own] if n else c for own, n, c in zip(sums, counts, centroids)]
        moved = changed.where("digit < 0").select("key", F.col("new").alias("exact"))
        state = written(state.join(moved, "key", "left").select("key", "code", F.coalesce("exact", "old").alias("old")), "approximations")

    last = _array(centroids)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                points, of = integers(np.vstack(batch["v"].to_list()), scale), batch["new"].to_numpy().copy()
                of[of < 0] = nearest(points[of < 0], last)
                distance = np.zeros(len(points), object)
                for k, centroid in enumerate(last):
                    distance[of == k] = squares(points[of == k], centroid)
                yield pd.DataFrame({"key": batch["key"], "vec_id": batch["vec_id"], "cluster": of,
                                    "distance": pd.array([int(d) if d <= LONGEST else None for d in distance], "Int64")})

    near = full.join(decide(state, last).select("key", "new"), "key")
    rows = written(near.mapInPandas(measure, "key long, vec_id {}, cluster int, distance long".format(full.schema["vec_id"].dataType.simpleString())), "clustered")
    whole = F.sum(F.col("distance").cast("decimal(38, 0)"))
    total = F.when(F.count("*") == F.count("distance"), whole).alias("total")
    per = {r["cluster"]: r["total"] for r in rows.groupBy("cluster").agg(total).collect()}
    known = [None if t is None else int(t) for t in per.values()]
    every = None if None in known or sum(known) > LONGEST else sum(known)
    # one row per cluster
    named = rows.sparkSession.createDataFrame(
        [(k, int(t) if t is not None and t <= LONGEST else None, every, hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest())
         for k, t in per.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
