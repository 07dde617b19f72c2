"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[2]
_SHIPPED: set[str] = set()
_LOCAL: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of this session hold no more than BATCH_ROWS rows and about BATCH_BYTES bytes: texts may be long.

    Plans are made lazily, so the two settings stay as they are set here; smaller ones of the caller are kept.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def ship_package(spark: SparkSession) -> None:
    """Make this package importable by Python workers that were not started next to it."""
    bound_batches(spark)
    places = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or any(p and os.path.realpath(p) == str(ROOT) for p in places):
        return
    target = os.path.join(os.path.realpath(tempfile.mkdtemp()), "strataq_package.zip")
    with zipfile.ZipFile(target, "w") as out:
        for f in sorted((ROOT / "strataq").rglob("*.py")):
            out.write(f, f.relative_to(ROOT))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def release_memory() -> None:
    """Give freed memory back: Python workers are reused, and what one stage holds on to is missed in the next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library, which has no such call


def trimmed(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """fn over the batches of a partition, with its memory released at the end."""

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            release_memory()

    return run


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch | None],
              schema: str, rows: int = 512) -> DataFrame:
    """Apply fn to slices of at most `rows` rows, so a worker holds one slice and its results at a time."""
    ship_package(df.sparkSession)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                out = fn(batch.slice(start, rows))
                if out is None:
                    continue
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    return df.mapInArrow(trimmed(run), schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; without one a local session takes a temporary one, a cluster none."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place:
        existing = spark.sparkContext._jsc.sc().getCheckpointDir()
        if existing.isDefined():
            return existing.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        place = _LOCAL.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="strataq-shared-"))
    return place


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: the lineage ends there and survives lost executors.

    The table stays until drop_cuts, as results are read lazily.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/strataq-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cuts_so_far(spark: SparkSession) -> int:
    return len(_WRITTEN.get(spark.sparkContext.applicationId, []))


def drop_cuts(spark: SparkSession, first: int = 0, last: int | None = None) -> int:
    """Delete the tables that cut has written, or those numbered first to last; for when nothing reads them any more."""
    paths = _WRITTEN.get(spark.sparkContext.applicationId, [])
    gone = paths[first:last]
    conf, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    for p in gone:
        where = jvm.org.apache.hadoop.fs.Path(p)
        where.getFileSystem(conf).delete(where, True)
    del paths[first:last]
    return len(gone)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [t or "" for t in column(batch, name).to_pylist()]


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

