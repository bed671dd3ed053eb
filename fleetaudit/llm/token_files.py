"""Token files: fixed-width bit packing with block offsets.

A file set is a Parquet table of frames below one folder, so any store Spark writes to holds it, commits are atomic and
a lost executor leaves nothing half written. A frame holds whole documents of one part, in ascending id order; parts
follow each other in id order. Its payload is:

    magic "FWB1", u8 bits per id, u32 ids per block, u64 number of ids, u64 byte offset of every block, then the blocks

(little endian; offsets count from the end of the offset list). A block packs its ids at ``bits`` bits each, lowest bit
first, and is padded to a whole byte. Block ``i // per_block`` holds id ``i``, so any range is read without the rest.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, part_id, pieces
from .subwords import encoder

MAGIC = b"FWB1"
HEAD = struct.Struct("<4sBIQ")
FRAME_SCHEMA = ("part int, frame int, first long, n_ids long, doc_ids array<long>, doc_lengths array<long>, "
                "payload binary")


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold every id below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int, per_block: int = 4096) -> bytes:
    """The payload of ``ids`` (all below ``2 ** bits``)."""
    ids = np.ascontiguousarray(ids, "<u4")
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    blocks = []
    for lo in range(0, len(ids), per_block):
        part = ids[lo:lo + per_block]
        if bits in (8, 16, 32):
            blocks.append(part.astype(f"<u{bits // 8}").tobytes())
        else:
            planes = (part[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
            blocks.append(np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes())
    offsets = np.cumsum([0, *map(len, blocks)])[:-1].astype("<u8")
    return HEAD.pack(MAGIC, bits, per_block, len(ids)) + offsets.tobytes() + b"".join(blocks)


def unpack(payload: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a payload; reads the blocks they lie in only."""
    magic, bits, per_block, n = HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a token frame")
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.empty(0, "<u4")
    n_blocks = -(-n // per_block)
    offsets = np.frombuffer(payload, "<u8", n_blocks, HEAD.size)
    base = HEAD.size + 8 * n_blocks
    out = []
    for block in range(start // per_block, (stop - 1) // per_block + 1):
        count = min(per_block, n - block * per_block)
        at = base + int(offsets[block])
        if bits in (8, 16, 32):
            ids = np.frombuffer(payload, f"<u{bits // 8}", count, at).astype("<u4")
        else:
            raw = np.frombuffer(payload, np.uint8, -(-count * bits // 8), at)
            planes = np.unpackbits(raw, count=count * bits, bitorder="little").reshape(count, bits)
            ids = (planes.astype("<u4") << np.arange(bits, dtype="<u4")).sum(axis=1, dtype="<u4")
        out.append(ids)
    ids = np.concatenate(out)
    skip = start // per_block * per_block
    return ids[start - skip:stop - skip]


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, vocabulary: int,
                      id_col: str = "doc_id", text_col: str = "text", frame_ids: int = 1 << 18) -> None:
    """Encode every whole text, append ``end_id`` and write the frames below ``folder`` in ascending id order.

    A null text is empty (its ids are the end id alone); a null id comes first; repeated ids stand in text order. A
    frame is closed at the first document that brings it to ``frame_ids`` ids, so a task holds one frame at a time."""
    bits = bits_for(vocabulary)

    def frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, part, frame, first = encoder(tokenizer_path), part_id(), 0, 0
        held: list[np.ndarray] = []
        keys: list[int | None] = []
        n = 0

        def close() -> pd.DataFrame:
            nonlocal frame, first, n
            row = pd.DataFrame({"part": [part], "frame": [frame], "first": [first], "n_ids": [n], "doc_ids": [list(keys)],
                                "doc_lengths": [[len(x) for x in held]], "payload": [pack(np.concatenate(held), bits)]})
            frame, first, n = frame + 1, first + n, 0
            held.clear()
            keys.clear()
            return row

        for batch in pieces(batches):
            for key, ids in zip(batch["doc_id"], words.encode(list(batch["text"]))):
                held.append(np.append(ids, np.uint32(end_id)))
                keys.append(None if pd.isna(key) else int(key))
                n += len(held[-1])
                if n >= frame_ids:
                    yield close()
        if held:
            yield close()

    (documents(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
     .mapInPandas(frames, FRAME_SCHEMA).write.parquet(folder))


def read_token_files(spark, folder: str) -> DataFrame:
    """The frames with ``base``, the number of ids in all parts before their own (one row per part is summed)."""
    frames = spark.read.schema(FRAME_SCHEMA).parquet(folder)
    parts = frames.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return frames.join(bases, "part")


def document_ids(frames: DataFrame) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids = unpack(row.payload)
                lengths = np.asarray(row.doc_lengths, np.int64)
                ends = np.cumsum(lengths)
                yield pd.DataFrame({
                    "doc_id": pd.array([None if pd.isna(k) else int(k) for k in row.doc_ids], "Int64"),
                    "start": row.base + row.first + ends - lengths, "n_tokens": lengths,
                    "ids_crc32": [zlib.crc32(ids[e - m:e].tobytes()) for e, m in zip(ends, lengths)]})

    small = frames.select("base", "first", "doc_ids", "doc_lengths", "payload")
    return small.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
