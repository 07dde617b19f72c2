"""Streaming operators. Sources are file streams here; strataq.sources.readers.kafka_options has the Kafka form."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.replay import Step


def file_stream(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def inbox(events: DataFrame, key: list[str], clock: str, delay: str = "1 hour") -> DataFrame:
    """First delivery of an event alone; state is dropped once the watermark has passed."""
    return events.withWatermark(clock, delay).dropDuplicatesWithinWatermark(key)


def split_poison(batch: DataFrame, payload: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose payload is a JSON document, and the others with a reason."""
    parsed = F.try_parse_json(payload)
    good = batch.where(parsed.isNotNull())
    bad = batch.where(parsed.isNull()).withColumn("reason", F.when(F.col(payload).isNull(), "NULL_PAYLOAD").otherwise("MALFORMED_PAYLOAD"))
    return good, bad


def relay(events: DataFrame, payload: str, good_path: str, bad_path: str, checkpoint: str) -> StreamingQuery:
    """At-least-once relay with quarantine. A batch written again replaces itself, since it has a folder of its own."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        good, bad = split_poison(batch, payload)
        good.write.mode("overwrite").parquet(f"{good_path}/batch={number}")
        bad.write.mode("overwrite").parquet(f"{bad_path}/batch={number}")
        batch.unpersist()

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, clock: str, length: str, slide: str | None, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """Counts by tumbling or sliding window and keys; late rows beyond the watermark are dropped."""
    window = F.window(clock, length, slide) if slide else F.window(clock, length)
    out = events.withWatermark(clock, delay).groupBy(window, *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def sessions(events: DataFrame, clock: str, gap: str, keys: list[str], delay: str = "1 hour") -> DataFrame:
    out = events.withWatermark(clock, delay).groupBy(F.session_window(clock, gap), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def stateful_fold(events: DataFrame, key: str, order: str, step: Step, start: dict, state_schema: str, fields: list[str]) -> DataFrame:
    """The fold of strataq.operators.replay across batches: rows of a batch are put in order, and rows at or below the last
    order seen are STALE. Output: key, order, outcome.

    state_schema is the DDL of the fields of `start`; `fields` are the columns that step reads.
    """
    names = list(start)

    def run(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, values = -1, dict(start)
        if state.exists:
            last, *rest = state.get
            values = dict(zip(names, rest))
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        out = []
        for row in rows.to_dict("records"):
            if row[order] <= last:
                out.append((keys[0], row[order], "STALE"))
                continue
            values, result = step(values, row)
            last = int(row[order])
            out.append((keys[0], row[order], result))
        state.update((last, *(values[n] for n in names)))
        yield pd.DataFrame(out, columns=[key, order, "outcome"])

    schema = events.schema
    kind = schema[key].dataType.simpleString()
    return events.select(key, order, *fields).groupBy(key).applyInPandasWithState(
        run, f"{key} {kind}, {order} bigint, outcome string", f"last bigint, {state_schema}", "append", GroupStateTimeout.NoTimeout)


def first_terminal(events: DataFrame, key: str, clock: str, terminal, delay: str = "1 hour") -> DataFrame:
    """The first terminal row of each key that the stream shows."""
    return events.where(terminal).withWatermark(clock, delay).dropDuplicatesWithinWatermark([key])


def demand(sample: Callable[[DataFrame, int], None], events: DataFrame, checkpoint: str) -> StreamingQuery:
    """Calls sample(batch, number) on every micro-batch: a fresh aggregate a trigger."""
    return events.writeStream.foreachBatch(sample).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def collect(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and return what it put out; for tests and small results."""
    spark = stream.sparkSession
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
