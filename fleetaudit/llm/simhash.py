"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most three bits differ in at most three of their eight bytes, so they share at
least five positional bytes. The lists of single bytes hold a 256th of all fingerprints each and would pair with the
square of the input. The index therefore keeps the intersections of four such lists: the 14 blocks of the Steiner system
S(3, 4, 8) hold every set of three positions, and their complements are blocks too, so whichever three bytes differ, the
pair agrees on the four bytes of some block. Candidates of a list are tallied (shared positional bytes per pair), those
with five or more are verified on the bits.

Copies are one fingerprint. A list of many fingerprints is cut into chunks, and every pair of chunks is a cell of its
own, so no task holds a whole list; a cell hands on a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, fresh, pieces, written
from .components import components

WORDS, SEED, BITS, POSITIONS = 3, 42, 3, 8
LEAST_SHARED = POSITIONS - BITS


def blocks() -> list[tuple[int, ...]]:
    """The 14 blocks of S(3, 4, 8): four-sets of three-bit numbers that cancel under exclusive or."""
    return [s for s in combinations(range(POSITIONS), 4) if s[0] ^ s[1] ^ s[2] ^ s[3] == 0]


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of a text (see ``fingerprints``)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(WORDS, len(words))
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    hashes = np.array([digest(view[s:e], SEED) for s, e in zip(starts.tolist(), ends[width - 1:].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 8192):
        part = hashes[lo:lo + 8192]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key (a 64-bit hash of the text) and fp (the fingerprint's bits as a long) of every whole text: A-Z
    lowered, words between ASCII white space, three-word shingles with repeats, XXH64 with seed 42, a bit set if over
    half the hashes have it. Fewer words make one shingle; a null, empty or blank text has fingerprint zero."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pieces(batches):
            fp = np.array([fingerprint(t) for t in batch["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64").to_numpy(), "text_key": batch["text_key"].to_numpy(), "fp": fp})

    keyed = documents(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))
    return keyed.mapInPandas(run, "doc_id long, text_key long, fp long")


def _forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of the graph that joins fingerprints of few differing bits (indexes into ``fps``)."""
    open_ = np.arange(len(fps))
    out: list[tuple[int, int]] = []
    frontier: list[int] = []
    while len(open_):
        if not frontier:
            frontier.append(int(open_[0]))
            open_ = open_[1:]
        at = frontier.pop()
        differ = fps[open_] ^ fps[at]
        shared = (differ.view(np.uint8).reshape(-1, POSITIONS) == 0).sum(axis=1)
        near = shared >= LEAST_SHARED
        near[near] = np.bitwise_count(differ[near]) <= BITS
        if near.any():
            hit = open_[near].tolist()
            out.extend((at, h) for h in hit)
            frontier.extend(hit)
            open_ = open_[~near]
    return out


def _pairs(fps: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal ``group``: neighbours for runs of two, a spanning forest for longer ones."""
    border = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(border, len(group)))
    two = border[size == 2]
    differ = fps[two] ^ fps[two + 1]
    shared = (differ.view(np.uint8).reshape(-1, POSITIONS) == 0).sum(axis=1) if len(two) else np.empty(0)
    near = two[(shared >= LEAST_SHARED) & (np.bitwise_count(differ) <= BITS)]
    a, b = [near], [near + 1]
    for at, n in zip(border[size > 2].tolist(), size[size > 2].tolist()):
        links = np.array(_forest(fps[at:at + n]), np.int64).reshape(-1, 2) + at
        a.append(links[:, 0])
        b.append(links[:, 1])
    return fps[np.concatenate(a)], fps[np.concatenate(b)]


def links(distinct: DataFrame, chunk: int = 4096) -> DataFrame:
    """Distinct pairs a < b (as signed longs) that connect exactly the fingerprints of at most three differing bits.

    ``distinct`` has one row per fingerprint, column fp. ``chunk`` bounds what half a cell holds."""
    def part(position: int):
        return F.shiftrightunsigned("fp", 8 * position).bitwiseAND(F.lit(255))

    keys = [sum((part(p) * (1 << 8 * i) for i, p in enumerate(block)), F.lit(0)) + F.lit(n << 32)
            for n, block in enumerate(blocks())]
    index = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = index.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    listed = index.join(sizes, "key")
    chunks = F.ceil(F.col("n") / chunk).cast("int")
    own = F.pmod(F.xxhash64("fp"), chunks).cast("int")
    cells = (listed.select("key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other"))
             .select("key", "fp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            frame = batch if held is None else pd.concat([held, batch], ignore_index=True)
            cell = frame[["key", "i", "j"]].to_numpy()
            change = np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1
            if not len(change):
                held = frame
                continue
            held, frame = frame.iloc[change[-1]:], frame.iloc[:change[-1]]
            yield linked(frame)
        if held is not None and len(held):
            yield linked(held)

    def linked(frame: pd.DataFrame) -> pd.DataFrame:
        cell = frame[["key", "i", "j"]].to_numpy()
        group = np.concatenate(([0], np.cumsum((cell[1:] != cell[:-1]).any(axis=1))))
        a, b = _pairs(frame["fp"].to_numpy().view(np.uint64), group)
        a, b = a.view(np.int64), b.view(np.int64)
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return (cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "fp")
            .mapInPandas(run, "a long, b long").distinct())


def _grouped(found: DataFrame) -> DataFrame:
    """fp, root (a fingerprint that names the component) and least (its smallest id) of every distinct fingerprint."""
    distinct = written(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash_distinct")
    return components(links(distinct.select("fp")), distinct.select(F.col("fp").alias("node"), "least")).withColumnRenamed("node", "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id, the smallest id reachable over links, per row.

    Null ids never name a component unless it has no other id; repeated rows are kept as they are."""
    found = written(fingerprints(docs, id_col, text_col), "simhash")
    return found.join(written(_grouped(found), "simhash_groups"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, all columns kept: that of the smallest id (a null id comes first), of these
    the smallest hash of the text, of equal rows any one."""
    key, text_key, turn = (fresh(docs, n) for n in ("near_key", "near_text_key", "near_turn"))
    found = written(fingerprints(docs, id_col, text_col), "simhash")
    grouped = found.join(written(_grouped(found), "simhash_groups"), "fp")
    first = written(grouped.groupBy("root").agg(F.min(F.struct("doc_id", "text_key")).alias("f"))
                    .select(F.col("f.doc_id").alias(key), F.col("f.text_key").alias(text_key)).distinct(), "simhash_kept")
    text = F.coalesce(F.col(text_col), F.lit(""))
    one = docs.join(first, F.col(id_col).cast("long").eqNullSafe(F.col(key)) & (F.xxhash64(text) == F.col(text_key)))
    order = Window.partitionBy(key, text_key).orderBy(text_key)
    return one.withColumn(turn, F.row_number().over(order)).where(F.col(turn) == 1).drop(key, text_key, turn)
