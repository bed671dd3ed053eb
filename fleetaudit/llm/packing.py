"""Packing documents into sequences of a fixed length: configuration linear program over the length histogram.

A configuration is a multiset of lengths that fits one sequence. The program chooses how many sequences use each, so
that every length is covered and the fewest sequences are used. It is solved by multiplicative weights: prices per length
rise while a length lags behind in coverage, and a knapsack dynamic program finds the configuration of the highest price.
The solution is rounded down, and what the rounding leaves is placed best fit first, still on the histogram. All this
works on at most ``capacity`` numbers. Spark does the work that grows with the input: counting, numbering the pieces of
each length and giving them their places."""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, part_id, pieces, written
from .subwords import encoder

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def best_configuration(prices: np.ndarray) -> np.ndarray:
    """Knapsack by dynamic programming: the lengths (each any number of times) of the highest total price within
    ``len(prices) - 1``. ``prices[s]`` is the price of length ``s``, minus infinity where there is none."""
    capacity = len(prices) - 1
    best, taken = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    own = prices[1:]
    for c in range(1, capacity + 1):
        total = own[:c] + best[c - 1::-1]
        k = int(total.argmax())
        if total[k] > best[c - 1]:
            best[c], taken[c] = total[k], k + 1
        else:
            best[c] = best[c - 1]
    counts, c = np.zeros(capacity + 1, np.int64), capacity
    while c > 0:
        if taken[c]:
            counts[taken[c]] += 1
            c -= taken[c]
        else:
            c -= 1
    return counts


def fractional(demand: np.ndarray, rounds: int, rate: float = 4.0, share: float = 0.5) -> list[tuple[np.ndarray, float]]:
    """Multiplicative weights: (configuration, amount) pairs covering nearly all of ``demand`` (count per length).

    A length's weight is its size times ``exp(rate * uncovered share)``. Each round adds the best configuration in the
    amount that covers ``share`` of what is left of the scarcest of its lengths."""
    sizes = np.arange(len(demand), dtype=float)
    left, found = demand.astype(float), []
    total = float((sizes * demand).sum())
    for _ in range(rounds):
        open_ = left >= 0.5
        if not open_.any() or float((sizes * left).sum()) <= 0.002 * total:
            break
        lag = np.divide(left, demand, out=np.zeros_like(left), where=demand > 0)
        prices = np.where(open_, sizes * np.exp(rate * (lag - 1)), -np.inf)
        chosen = best_configuration(prices)
        if not chosen.any():
            break
        used = chosen > 0
        limit = float((left[used] / chosen[used]).min())
        amount = limit if limit < 2 else share * limit
        found.append((chosen, amount))
        left -= chosen * amount
    return found


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[Counter, int]]:
    """Best fit, longest first, on counts: groups of equal sequences are split as lengths are added to them."""
    groups: list[tuple[Counter, int]] = []
    room: dict[int, list[int]] = {}
    free: list[int] = []

    def add(config: Counter, count: int, rest: int) -> None:
        groups.append((config, count))
        if rest not in room:
            room[rest] = []
            bisect.insort(free, rest)
        room[rest].append(len(groups) - 1)

    for size in np.flatnonzero(left)[::-1]:
        n, size = int(left[size]), int(size)
        while n:
            k = bisect.bisect_left(free, size)
            if k == len(free):
                each = capacity // size
                whole, rest = divmod(n, each)
                if whole:
                    add(Counter({size: each}), whole, capacity - each * size)
                if rest:
                    add(Counter({size: rest}), 1, capacity - rest * size)
                break
            at = free[k]
            g = room[at].pop()
            if not room[at]:
                del room[at]
                free.pop(k)
            config, count = groups[g]
            groups[g] = (config, 0)
            each = min(at // size, -(-n // count))
            filled = min(count, n // each)
            n -= filled * each
            if filled:
                add(config + Counter({size: each}), filled, at - each * size)
            if filled < count:
                if n and n < each:
                    add(config + Counter({size: n}), 1, at - n * size)
                    filled, n = filled + 1, 0
                if filled < count:
                    add(config, count - filled, at)
    return [(c, k) for c, k in groups if k]


def plan(histogram: dict[int, int], capacity: int, rounds: int = 500) -> list[tuple[dict[int, int], int]]:
    """(configuration, number of sequences) pairs that hold every piece of ``histogram`` (length: count) exactly once."""
    demand = np.zeros(capacity + 1, np.int64)
    for length, count in histogram.items():
        if length < 1 or length > capacity:
            raise ValueError(f"length {length} doesn't fit {capacity}")
        demand[length] = count
    left, out = demand.copy(), []
    for chosen, amount in fractional(demand, rounds):
        used = chosen > 0
        whole = min(int(amount + 1e-9), int((left[used] // chosen[used]).min()))
        if whole > 0:
            left -= chosen * whole
            out.append(({int(s): int(chosen[s]) for s in np.flatnonzero(chosen)}, whole))
    return out + [(dict(c), k) for c, k in best_fit(left, capacity)]


def places(configs: list[tuple[dict[int, int], int]]) -> pd.DataFrame:
    """For each length, which of its pieces (numbered from 0) go where: pieces from ``lo`` on stand ``each`` to a
    sequence, in sequences from ``sequence`` on, one after the other from ``offset``."""
    rows, next_of, sequence = [], Counter(), 0
    for config, count in configs:
        offset = 0
        for size in sorted(config, reverse=True):
            rows.append((size, next_of[size], config[size], sequence, offset))
            next_of[size] += config[size] * count
            offset += size * config[size]
        sequence += count
    frame = pd.DataFrame(rows, columns=["length", "lo", "each", "sequence", "offset"])
    return frame.astype("int64").sort_values(["length", "lo"], ignore_index=True)


def cut_documents(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece. A document is its ids and ``end_id``; one longer than ``capacity`` is cut so that all pieces
    but the first have ``capacity`` ids. ``nth`` numbers the pieces of one length within the task ``part``."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, part, seen = encoder(tokenizer_path), part_id(), Counter()
        for batch in pieces(batches):
            rows = []
            for key, ids in zip(batch["doc_id"], words.encode(list(batch["text"]))):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                start, length = 0, len(ids) % capacity or capacity
                for piece in range(-(-len(ids) // capacity)):
                    rows.append((key, piece, start, length, zlib.crc32(ids[start:start + length].tobytes()), part,
                                 seen[length]))
                    seen[length] += 1
                    start, length = start + length, capacity
            frame = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return documents(docs, id_col, text_col).mapInPandas(cut, PIECE_SCHEMA)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 2048, rounds: int = 500,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is a piece of the end id alone; repeated rows are packed as often as they stand there; no rows
    give no sequences. The histogram (at most ``capacity`` rows) and the plan made of it are all the driver sees."""
    spark = docs.sparkSession
    cut = written(cut_documents(docs, tokenizer_path, end_id, capacity, id_col, text_col), "pieces")
    counts = written(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "piece_counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = places(plan(histogram, capacity, rounds))
    shared = spark.sparkContext.broadcast({n: table[n].to_numpy() for n in table.columns})
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = cut.join(bases, ["part", "length"]).withColumn("nth", F.col("nth") + F.col("base"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = shared.value
        # one sorted key per interval: pieces of a length are numbered without gaps, so the last start at or below fits
        start_of = np.searchsorted(t["length"], np.arange(capacity + 2))
        for batch in batches:
            length, nth = batch["length"].to_numpy(), batch["nth"].to_numpy()
            row = np.empty(len(batch), np.int64)
            for size in np.unique(length):
                own = np.flatnonzero(length == size)
                lo, hi = start_of[size], start_of[size + 1]
                row[own] = lo + np.searchsorted(t["lo"][lo:hi], nth[own], side="right") - 1
            inside = nth - t["lo"][row]
            batch["sequence_id"] = t["sequence"][row] + inside // t["each"][row]
            batch["offset"] = t["offset"][row] + inside % t["each"][row] * length
            yield batch[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "nth").mapInPandas(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
