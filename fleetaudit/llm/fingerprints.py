"""Document fingerprints: bottom-k sketches of five-word shingles.

A sketch is the sorted list of the ``k`` smallest distinct hashes (63 bits) of a text's shingles. Sketches of the parts
of a document merge into the sketch of the whole (parts overlap by four words, or differ in the shingles across a
border). Two sketches estimate resemblance, containment and the number of distinct shingles. A text of fewer words than
a shingle has one shingle, the whole word sequence; a text without words has none, and two such texts are alike.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, pieces

WORDS = 5
K = 128
_TOP = np.float64(2.0 ** 63)


def shingle_hashes(text: str, words: int = WORDS) -> np.ndarray:
    """A 63-bit hash of every shingle, repeats included."""
    parts = text.lower().split()
    if not parts:
        return np.empty(0, np.int64)
    digest = xxhash.xxh3_64_intdigest
    own = np.array([digest(p) for p in map(str.encode, parts)], np.uint64)
    width = min(words, len(own))
    mixed = np.zeros(len(own) - width + 1, np.uint64)
    for i in range(width):
        mixed = (mixed ^ own[i:i + len(mixed)]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    if width < words:
        mixed ^= np.uint64(width)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return (mixed >> np.uint64(1)).astype(np.int64)


def bottom_k(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The ``k`` smallest distinct values, ascending."""
    if len(hashes) > 4 * k:
        # distinct values below a cut that leaves enough of them; all of them when repeats make it too few
        few = np.unique(np.partition(hashes, 2 * k)[:2 * k])
        if len(few) >= k:
            return few[:k]
    return np.unique(hashes)[:k]


def sketch(text: str | None, k: int = K) -> np.ndarray:
    return bottom_k(shingle_hashes(text or ""), k)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of both parts' shingles together."""
    return np.union1d(a, b)[:k]


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Distinct shingles: exact below ``k``, else estimated from the k-th smallest hash."""
    return float(len(a)) if len(a) < k else (k - 1) * _TOP / max(float(a[k - 1]), 1.0)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard likeness of the shingle sets; exact if both have fewer than ``k``. Two empty sets are alike."""
    union = merge(a, b, k)
    if not len(union):
        return 1.0
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.count_nonzero(both <= union[-1])) / len(union)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of ``a``'s shingles that ``b`` has; 1 for an empty ``a``."""
    if not len(a):
        return 1.0
    likeness = resemblance(a, b, k)
    shared = likeness / (1 + likeness) * (distinct_count(a, k) + distinct_count(b, k))
    return min(1.0, shared / distinct_count(a, k))


def to_text(a: np.ndarray) -> str:
    """The sketch as text: base64 of its hashes as little-endian 64-bit integers."""
    return base64.b64encode(a.astype("<i8").tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<i8")


def document_sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """doc_id and hashes (array of long, ascending) of every whole text; a null text is empty."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pieces(batches):
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "hashes": [sketch(t, k) for t in batch["text"]]})

    return documents(docs, id_col, text_col).mapInPandas(run, "doc_id long, hashes array<long>")


def merge_parts(sketches: DataFrame, key: str | list[str], hashes: str = "hashes", k: int = K) -> DataFrame:
    """One sketch per key from the sketches of its parts. Every task keeps the ``k`` smallest hashes of a key before the
    shuffle, so a key with very many parts stays small."""
    keys = [key] if isinstance(key, str) else list(key)
    values = sketches.select(*keys, F.explode(hashes).alias("_hash"))
    rank = F.dense_rank().over(Window.partitionBy(*keys).orderBy("_hash"))
    few = values.withColumn("_rank", rank).where(F.col("_rank") <= k)
    joined = few.groupBy(*keys).agg(F.array_sort(F.collect_set("_hash")).alias(hashes))
    none = F.array().cast("array<bigint>")
    return (sketches.select(*keys).distinct().join(joined, keys, "left")
            .withColumn(hashes, F.coalesce(hashes, none)))


def edited_text(text: str, following: str) -> str:
    """``text`` with its last quarter (floor) replaced by the first as many code points of the next document."""
    quarter = len(text) // 4
    return text[:len(text) - quarter] + following[:quarter]


def _bucket(key: Column, borders: list[int]) -> Column:
    if not borders:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, borders)), lambda b: b <= key))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Every document in ascending id order by ranges: rows (bucket, visitor, doc_id, text), where the last row of a
    bucket, a visitor, is the first document of the next bucket that has any (the first of all behind the last).

    Only bucket borders (quantiles of the ids) reach the driver. Equal ids stand in text order; null ids come first."""
    spark = docs.sparkSession
    rows = documents(docs, id_col, text_col)
    low = -(1 << 63)
    key = F.coalesce("doc_id", F.lit(low))
    buckets = buckets or 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = ", ".join(f"{i / buckets:.9f}D" for i in range(1, buckets))
    borders = rows.select(F.expr(f"percentile_approx(doc_id, array({shares}), 20000)").alias("q")).first()["q"] or []
    borders = sorted({int(b) for b in borders})
    placed = rows.withColumn("bucket", _bucket(key, borders)).withColumn("visitor", F.lit(False))
    # one row per bucket: its smallest id, and where a copy of that document goes
    heads = placed.groupBy("bucket").agg(F.min(key).alias("head"))
    order = Window.orderBy("bucket")
    target = F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(Window.partitionBy()))
    heads = heads.select("head", F.col("bucket").alias("own"), target.alias("target"))
    visits = (placed.join(F.broadcast(heads), (F.col("bucket") == F.col("own")) & (key == F.col("head")))
              .groupBy("target").agg(F.min(F.struct("doc_id", "text")).alias("first"))
              .select("first.doc_id", "first.text", F.col("target").alias("bucket"), F.lit(True).alias("visitor")))
    return placed.unionByName(visits).repartitionByRange("bucket").sortWithinPartitions("bucket", "visitor", "doc_id", "text")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Fingerprint of every whole text and of its edited text (see ``edited_text``), and how alike they are to the text.

    ``near_edited`` and ``near_next`` are resemblances by sketch; ``kept`` is the containment of the text's shingles in
    the edited text; ``n_shingles`` estimates the distinct shingles."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting = None  # (bucket, doc_id, text, sketch)
        for batch in pieces(batches):
            rows = []
            for bucket, visitor, key, text in zip(batch["bucket"], batch["visitor"], batch["doc_id"], batch["text"]):
                own = sketch(text, k)
                if waiting is not None and waiting[0] == bucket:
                    _, before, old, a = waiting
                    changed = edited_text(old, text)
                    b = a if changed == old else sketch(changed, k)
                    rows.append((before, len(old), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
                                 to_text(a), to_text(b), resemblance(a, b, k), resemblance(a, own, k), containment(a, b, k),
                                 distinct_count(a, k)))
                waiting = None if visitor else (bucket, key, text, own)
            out = pd.DataFrame(rows, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                                              "near_edited", "near_next", "kept", "n_shingles"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return with_next(docs, id_col, text_col).mapInPandas(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double, kept double, n_shingles double")
