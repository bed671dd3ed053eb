"""Tables that micro-batches rewrite a part of: hash buckets, one folder per epoch and bucket, and a pointer file per epoch
that names the folders a reader sees.

An epoch first writes its folders and then its pointer, which is renamed into place and never changed; readers and the
next epoch see all of an epoch or nothing. An epoch whose pointer stands is not written again, so a replay changes
nothing. The pointer has one entry per bucket, however many rows there are."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Versioned:
    """``buckets`` is fixed by the first epoch; later ones use what the pointer says."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder = spark, folder
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self.buckets = (self.pointer() or {}).get("buckets", buckets)

    def bucket(self, *keys: str) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

    def data(self, epoch: int, bucket: int | None = None) -> str:
        return f"{self.folder}/data/epoch={epoch}" + ("" if bucket is None else f"/bucket={bucket}")

    def _epochs(self) -> list[int]:
        home = self._path(f"{self.folder}/pointers")
        names = [f.getPath().getName() for f in self._fs.listStatus(home)] if self._fs.exists(home) else []
        return sorted(int(m[1]) for m in (re.fullmatch(r"(\d+)\.json", n) for n in names) if m)

    def pointer(self) -> dict | None:
        """The newest pointer: epoch, buckets and entries (bucket -> epochs whose folders hold it)."""
        epochs = self._epochs()
        if not epochs:
            return None
        stream = self._fs.open(self._path(f"{self.folder}/pointers/{epochs[-1]}.json"))
        try:
            found = json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()
        return found | {"entries": {int(b): e for b, e in found["entries"].items()}}

    def done(self, epoch: int) -> bool:
        return bool(self._epochs()) and self._epochs()[-1] >= epoch

    def commit(self, epoch: int, entries: dict[int, list[int]]) -> None:
        name = f"{self.folder}/pointers/{epoch}.json"
        out = self._fs.create(self._path(name + ".tmp"), True)
        try:
            out.write(bytearray(json.dumps({"epoch": epoch, "buckets": self.buckets, "entries": entries}).encode()))
        finally:
            out.close()
        if not self._fs.rename(self._path(name + ".tmp"), self._path(name)):
            raise OSError(f"{name} was not put in place")
        for old in self._epochs()[:-2]:  # a reader may still hold the one before
            self._fs.delete(self._path(f"{self.folder}/pointers/{old}.json"), False)

    def written(self, epoch: int) -> list[int]:
        """The buckets an epoch has folders of."""
        home = self._path(self.data(epoch))
        names = [f.getPath().getName() for f in self._fs.listStatus(home)] if self._fs.exists(home) else []
        return sorted(int(m[1]) for m in (re.fullmatch(r"bucket=(\d+)", n) for n in names) if m)

    def write(self, rows: DataFrame, epoch: int) -> list[int]:
        """Write ``rows``, which have a column bucket, as the folders of ``epoch``; returns their buckets."""
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(self.data(epoch))
        return self.written(epoch)

    def read(self, schema: str, buckets: list[int] | None = None, only: dict[int, list[int]] | None = None) -> DataFrame:
        """Rows of all buckets, of some, or of some folders (bucket -> epochs)."""
        entries = only if only is not None else (self.pointer() or {"entries": {}})["entries"]
        folders = [self.data(e, b) for b, epochs in entries.items() if buckets is None or b in buckets for e in epochs]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)
