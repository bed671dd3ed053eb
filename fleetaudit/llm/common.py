"""Helpers the operators of this package share: table access, scratch tables, text batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetaudit.session import scratch_folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table below the shared checkpoint folder, read back. Work that several consumers read is done
    once, and a lost executor costs only the tasks it was running."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, so extra columns of any name never clash. A null text is empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_class(id_col: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus


def part_id() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def pieces(frames: Iterator[pd.DataFrame], chars: int = 8_000_000, text: str = "text") -> Iterator[pd.DataFrame]:
    """Cut incoming frames so that one holds at most about ``chars`` characters (never less than a row)."""
    for frame in frames:
        if not len(frame):
            continue
        group = frame[text].str.len().cumsum() // chars
        if group.iloc[-1] == group.iloc[0]:
            yield frame
        else:
            for _, part in frame.groupby(group, sort=True):
                yield part
