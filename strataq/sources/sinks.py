"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import SourceError, snapshot


def append_csv(df: DataFrame, path: str) -> None:
    """Append rows, refusing if the files there have another header."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        there = spark.read.option("header", True).csv(path).columns
        if there != df.columns:
            raise SourceError(f"{path} has columns {there}")
    df.write.mode("append").option("header", True).csv(path)


def write_once(df: DataFrame, path: str) -> None:
    """Write a unit that must not be there yet."""
    df.write.mode("errorifexists").parquet(path)


def write_units(df: DataFrame, path: str, unit: str) -> list[str]:
    """Write the units of df that are not there yet, a folder for each, and leave all others alone; gives the new ones.

    Units are counted by their names, which are few; a folder counts when its rows have been committed.
    """
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    have = {f.getPath().getName().removeprefix(f"{unit}=") for f in fs.listStatus(where)} if fs.exists(where) else set()
    new = sorted(r[0] for r in df.select(F.col(unit).cast("string")).distinct().collect() if r[0] not in have)
    if new:
        df.where(F.col(unit).cast("string").isin(new)).write.mode("append").partitionBy(unit).parquet(path)
    return new


def pack(tables: dict[str, DataFrame], path: str) -> None:
    """Compressed tables and a manifest of their rows and digests, each written once."""
    for name, df in tables.items():
        df.write.mode("errorifexists").option("compression", "zstd").parquet(f"{path}/{name}")
    write_once(snapshot(tables).coalesce(1), f"{path}/manifest")


def unpack(spark: SparkSession, path: str, names: list[str]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The manifest of a pack and its tables, for snapshot_problems to compare."""
    return spark.read.parquet(f"{path}/manifest"), {n: spark.read.parquet(f"{path}/{n}") for n in names}


def write_bytes(spark: SparkSession, path: str, raw: bytes) -> None:
    """A small file, written through the session's file systems."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, False)
    try:
        out.write(bytearray(raw))
    finally:
        out.close()


def prometheus(df: DataFrame, name: str, value: str, labels: list[str]) -> DataFrame:
    """Metric rows as exposition lines."""
    escaped = lambda c: F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    pairs = F.concat_ws(",", *(F.concat(F.lit(f'{c}="'), escaped(c), F.lit('"')) for c in labels))
    return df.select(F.concat(F.lit(name + "{"), pairs, F.lit("} "), F.col(value).cast("string")).alias("line")).orderBy("line")


def markdown(rows: list[dict]) -> str:
    """A small collected result as a table."""
    if not rows:
        return ""
    names = list(rows[0])
    line = lambda xs: "| " + " | ".join("" if x is None else str(x) for x in xs) + " |"
    return "\n".join([line(names), line("---" for _ in names), *(line(r[n] for n in names) for r in rows)])


def kafka_rows(df: DataFrame, topic: str) -> DataFrame:
    """Rows for a Kafka sink: key, value, headers and topic."""
    header = lambda k, c: F.struct(F.lit(k).alias("key"), F.col(c).cast("string").cast("binary").alias("value"))
    return df.select(F.col("event_id").cast("binary").alias("key"), F.to_json(F.struct("*")).cast("binary").alias("value"),
                     F.array(header("event-id", "event_id"), header("event-type", "event_type"),
                             header("schema-version", "schema_version")).alias("headers"), F.lit(topic).alias("topic"))
