"""Streaming operators on a batch of rows that is replayed as a file stream: inventory group I."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming import ops
from .base import Tables, query


def place(t: Tables) -> str:
    """A folder for files of a query: in the shared folder that the session names, or a temporary one in a local session."""
    base = t.spark.conf.get("spark.checkpoint.dir", None) or t.spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not t.spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp()
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def replayed(df: DataFrame, path: str, files: int = 100) -> DataFrame:
    df.write.parquet(f"{path}/in")
    return ops.file_stream(df.sparkSession, f"{path}/in", df.schema, files)


def drained(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Write all that a stream has to give to the shared folder and read it."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


@query("I03", "SELECT user_id, event_type, count(*) > 0 AS seen FROM events GROUP BY 1, 2")
def stream_inbox(t: Tables):
    p = place(t)
    rows = t.events.select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    out = ops.inbox(replayed(rows, p), ["user_id", "event_type"], "ts", "60 days")
    return drained(out, p).select("user_id", "event_type", F.lit(True).alias("seen"))


@query("I01 I04 A38", "SELECT (event_id % 9 = 0) AS poison, count(*) AS n FROM events GROUP BY 1")
def stream_quarantine(t: Tables):
    p = place(t)
    rows = t.events.select("event_id", F.when(F.col("event_id") % 9 == 0, F.lit("{torn")).otherwise(F.col("props")).alias("props"))
    ops.relay(replayed(rows, p), "props", f"{p}/good", f"{p}/bad", f"{p}/state").awaitTermination()
    good, bad = t.spark.read.parquet(f"{p}/good"), t.spark.read.parquet(f"{p}/bad")
    return good.agg(F.count("*").alias("n")).withColumn("poison", F.lit(False)).unionByName(bad.agg(F.count("*").alias("n")).withColumn("poison", F.lit(True)))


@query("I24 I18", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_demand(t: Tables):
    p = place(t)

    def sample(batch, number):
        batch.groupBy("event_type").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{p}/samples/batch={number}")

    ops.demand(sample, replayed(t.events.select("event_id", "event_type"), p), f"{p}/state").awaitTermination()
    return t.spark.read.parquet(f"{p}/samples").groupBy("event_type").agg(F.sum("n").alias("n"))
