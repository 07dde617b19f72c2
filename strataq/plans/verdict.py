"""Snapshot to verdict: an immutable trace directory, its manifest, all rules, one action."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import invariants
from ..sources import readers, schemas


def verdict(spark: SparkSession, path: str, manifest: DataFrame | None = None) -> DataFrame:
    """Violations of a stored trace as (rule, key); tables that differ from the manifest are violations too."""
    trace = schemas.read_trace(spark, path)
    found = invariants.check(trace)
    if manifest is not None:
        wrong = readers.snapshot_problems(readers.snapshot(trace), manifest)
        found = found.unionByName(wrong.select(F.concat(F.lit("snapshot "), "problem").alias("rule"), F.col("name").alias("key")))
    return found


def counts(violations: DataFrame) -> DataFrame:
    return violations.groupBy("rule").agg(F.count("*").alias("violations"))
