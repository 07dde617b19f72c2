"""Tables in versions: a state change reads the last version, and writes the next one whole or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .readers import SourceError


class Conflict(SourceError):
    """Another writer has committed the version that a change was to become."""


class Versions:
    """A table as a folder of versions v000001, v000002, ... A version is written beside them and renamed when complete.

    A rename to a name that is there fails, so of two changes of one version one is committed; the other one is to read
    again. Readers of an older version are never disturbed. Batches replace whole versions: changes are meant to be large.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    def _place(self, name: str):
        where = self._hadoop.Path(f"{self.path}/{name}")
        return where, where.getFileSystem(self._conf)

    def last(self) -> int:
        """The number of the last version, 0 for none."""
        where, fs = self._place("")
        if not fs.exists(where):
            return 0
        names = [f.getPath().getName() for f in fs.listStatus(where)]
        return max((int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{version or self.last():06d}")

    def commit(self, df: DataFrame, base: int) -> int:
        """Write df as the version after `base`."""
        draft, fs = self._place(f".draft-{uuid.uuid4().hex}")
        df.write.parquet(draft.toString())
        target, _ = self._place(f"v{base + 1:06d}")
        if fs.exists(target) or not fs.rename(draft, target):
            fs.delete(draft, True)
            raise Conflict(f"{target} is there")
        return base + 1

    def change(self, fn: Callable[[DataFrame], DataFrame], tries: int = 3) -> DataFrame:
        """Commit fn of the last version, again from the start if another writer was first; returns the new version."""
        for left in range(tries - 1, -1, -1):
            base = self.last()
            try:
                return self.read(self.commit(fn(self.read(base)), base))
            except Conflict:
                if not left:
                    raise
        raise AssertionError("unreachable")
