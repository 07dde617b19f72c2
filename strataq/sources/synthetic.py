"""Synthetic sources: small fixtures made of ranges and expressions, the same on every run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SERVICES = ("checkout", "search", "billing", "gateway", "ledger")
SIGNALS = ("latency", "errors", "saturation")


def pick(values: tuple[str, ...], i):
    return F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))


def corpus(spark: SparkSession, documents: int = 60, chunks: int = 5) -> DataFrame:
    """Documents of a few chunks; every fourth document is superseded by the next version."""
    i = F.floor(F.col("id") / chunks)
    j = F.col("id") % chunks
    service, signal = pick(SERVICES, i), pick(SIGNALS, i)
    return spark.range(documents * chunks).select(
        F.format_string("doc-%03d", i).alias("document_id"), F.format_string("doc-%03d-c%d", i, j).alias("chunk_id"),
        F.concat(F.lit("v"), (i % 4 + 1).cast("string")).alias("version"), service.alias("service"),
        F.concat_ws(" ", F.lit("runbook for"), service, F.lit("when"), signal, F.lit("step"), j.cast("string")).alias("text"))


def labelled_queries(spark: SparkSession, development: int = 40, held_out: int = 120, answerable_share: int = 4) -> DataFrame:
    """Queries with a split; one in `answerable_share` has no answer."""
    i = F.col("id")
    return spark.range(development + held_out).select(
        F.format_string("q-%03d", i).alias("query_id"), F.when(i < development, "development").otherwise("held_out").alias("split"),
        F.concat_ws(" ", pick(SERVICES, i), pick(SIGNALS, i)).alias("query"), (i % answerable_share != 0).alias("answerable"))


def incident_cases(spark: SparkSession, families: int = 5, cases: int = 6, development: int = 2) -> DataFrame:
    """Families of cases: the first of each family are for development, the others held out, as the id says."""
    k = F.col("id") % cases
    family = pick(SERVICES, F.floor(F.col("id") / cases))
    split = F.when(k < development, "development").otherwise("heldout")
    return spark.range(families * cases).select(
        F.format_string("%s-%s-%02d", F.substring(split, 1, 3), F.substring(family, 1, 4), k + 1).alias("case_id"),
        family.alias("family"), k.alias("index"), split.alias("split"))


def solvable_cases(spark: SparkSession, development: int = 40, held_out: int = 120, seed: int = 56) -> DataFrame:
    """Cases with one right answer, drawn by digests of the seed: a service, a signal and a version, the directive that
    answers them, and a distractor of another version."""
    i = F.col("id")
    draw = lambda n: F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), i), 256), 1 + 4 * n, 4), 16, 10).cast("long")
    service, signal, version = pick(SERVICES, draw(0)), pick(SIGNALS, draw(1)), draw(2) % 4 + 1
    return spark.range(development + held_out).select(
        F.format_string("case-%03d", i).alias("case_id"), F.when(i < development, "development").otherwise("heldout").alias("split"),
        F.concat_ws("/", service, F.concat(F.lit("v"), version.cast("string")), signal).alias("answer_key"),
        F.concat_ws("/", service, F.concat(F.lit("v"), (version % 4 + 1).cast("string")), signal).alias("distractor_key"))


def seeded_workflow(spark: SparkSession, seeds: int) -> DataFrame:
    """seed -> four integers and their sum, from digests."""
    part = lambda n: F.conv(F.substring(F.sha2(F.col("id").cast("string"), 256), 1 + 4 * n, 4), 16, 10).cast("long") % 100
    out = spark.range(seeds).select(F.col("id").alias("seed"), *(part(n).alias(f"n{n}") for n in range(4)))
    return out.withColumn("total", F.col("n0") + F.col("n1") + F.col("n2") + F.col("n3"))
