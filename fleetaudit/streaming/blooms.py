"""Bloom filters of hashed keys per bucket, built and asked in sorted streams: a task holds the filters of one bucket."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "bucket int, epoch int, bits binary"
PER_KEY, PROBES = 16, 6  # one false hit in about a thousand
MOST = 1_000_000  # keys of one filter


def hashed(*keys: str) -> Column:
    """Independent of the hash that deals keys over buckets."""
    return F.xxhash64(F.lit(1), *keys)


def _places(h: np.ndarray, size: int) -> np.ndarray:
    h = h.view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return ((h + step * np.arange(PROBES, dtype=np.uint64)[:, None]) % np.uint64(size)).astype(np.int64)


def filter_of(h: np.ndarray) -> bytes:
    bits = np.zeros(max(64, -(-PER_KEY * len(h) // 8) * 8), np.uint8)
    bits[_places(h, len(bits)).ravel()] = 1
    return np.packbits(bits).tobytes()


def may_have(bits: bytes, h: np.ndarray) -> np.ndarray:
    places = _places(h, 8 * len(bits))
    raw = np.frombuffer(bits, np.uint8)
    return ((raw[places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1).all(axis=0)


def build(rows: DataFrame, epoch: int) -> DataFrame:
    """Filters of ``rows`` (bucket, h); a bucket of very many keys has several."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, held, n = None, [], 0

        def close() -> pd.DataFrame:
            return pd.DataFrame({"bucket": [of], "epoch": [epoch], "bits": [filter_of(np.concatenate(held))]})

        for batch in batches:
            for bucket, part in batch.groupby("bucket", sort=True):
                if held and (bucket != of or n >= MOST):
                    yield close()
                    held, n = [], 0
                of = bucket
                held.append(part["h"].to_numpy(np.int64))
                n += len(part)
        if held:
            yield close()

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(run, SCHEMA)


def hits(keys: DataFrame, filters: DataFrame) -> DataFrame:
    """(bucket, epoch) of the filters that may have one of ``keys`` (bucket, h). Filters and keys meet in one stream sorted
    by bucket, filters first."""
    none = F.lit(None)
    both = filters.select("bucket", "epoch", "bits", F.lit(0).cast("long").alias("h")).unionByName(
        keys.select("bucket", none.cast("int").alias("epoch"), none.cast("binary").alias("bits"), "h"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, own = None, []
        for batch in batches:
            for bucket, part in batch.groupby("bucket", sort=True):
                if bucket != of:
                    of, own = bucket, []
                listed = part["bits"].notna()
                own += [(int(e), bytes(b)) for e, b in zip(part["epoch"][listed], part["bits"][listed])]
                asked = part["h"][~listed]
                if len(asked) and own:
                    h = asked.to_numpy(np.int64)
                    found = sorted({e for e, bits in own if may_have(bits, h).any()})
                    yield pd.DataFrame({"bucket": [bucket] * len(found), "epoch": found})

    return both.repartition("bucket").sortWithinPartitions("bucket", F.col("bits").isNull()).mapInPandas(run, "bucket int, epoch int")
