"""Strict readers: what a file holds must be what its schema says."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string


class SourceError(ValueError):
    """A source breaks its contract."""


def schema_of(ddl: str | StructType) -> StructType:
    return ddl if isinstance(ddl, StructType) else _parse_datatype_string(ddl)


def read_csv(spark: SparkSession, path: str, ddl: str | StructType) -> DataFrame:
    """CSV with a header that names the columns in order; ragged rows and malformed values fail."""
    schema = schema_of(ddl)
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One id a line; a repeated id fails, blank lines are left out."""
    ids = spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''")
    if ids.groupBy("id").count().where("count > 1").limit(1).count():
        raise SourceError(f"{path} repeats an id")
    return ids


def json_keys(text: Column) -> Column:
    return F.json_object_keys(text)


def decode_json(df: DataFrame, text: str, ddl: str | StructType, name: str = "value") -> DataFrame:
    """Typed rows of a column of JSON objects: unknown, missing and null fields are named in `problems`."""
    schema = schema_of(ddl)
    names = F.array(*(F.lit(f.name) for f in schema))
    keys = json_keys(F.col(text))
    out = df.withColumn(name, F.from_json(text, schema)).withColumn("_keys", F.coalesce(keys, F.array().cast("array<string>")))
    nulls = F.array_compact(F.array(*(F.when(F.col(f"{name}.`{f.name}`").isNull(), F.lit(f"null:{f.name}")) for f in schema)))
    unknown = F.transform(F.array_except("_keys", names), lambda k: F.concat(F.lit("unknown:"), k))
    missing = F.transform(F.array_except(names, "_keys"), lambda k: F.concat(F.lit("missing:"), k))
    broken = F.when(keys.isNull(), F.array(F.lit("malformed"))).otherwise(F.array().cast("array<string>"))
    return out.withColumn("problems", F.array_sort(F.concat(broken, unknown, missing, F.array_except(
        nulls, F.transform(F.array_except(names, "_keys"), lambda k: F.concat(F.lit("null:"), k)))))).drop("_keys")


def read_jsonl(spark: SparkSession, path: str, ddl: str | StructType) -> DataFrame:
    """JSON lines of exactly the schema's fields; anything else fails."""
    schema = schema_of(ddl)
    raw = spark.read.text(path).where(F.trim("value") != "").withColumnRenamed("value", "_text")
    rows = decode_json(raw, "_text", schema)
    bad = rows.where(F.exists("problems", lambda p: ~p.startswith("null:"))).select("problems").limit(1).collect()
    if bad:
        raise SourceError(f"{path}: {', '.join(bad[0][0])}")
    return rows.select("value.*")


def fault_runs(trace: DataFrame, version: str = "fault-trace.v1") -> DataFrame:
    """One row a run of a fault trace, with what is wrong with it: version, sequence from 1 on without gaps, one seed."""
    from ..operators.sequence import by

    rows = trace.withColumn("_gap", F.col("sequence") != F.row_number().over(by(["run_id"], "sequence")))
    out = rows.groupBy("run_id").agg(
        F.count("*").alias("events"), F.max_by("event", "sequence").alias("last_event"), F.min("seed").alias("seed"),
        F.max_by("boundary", F.when(F.col("boundary") != "", F.col("sequence"))).alias("boundary"),
        F.bool_or(F.coalesce("bounded", F.lit(False))).alias("bounded"),
        F.bool_or("_gap").alias("gap"), (F.count_distinct("seed") > 1).alias("seeds_differ"),
        F.bool_or(F.col("schema_version") != version).alias("other_version"))
    return out


def read_journal(spark: SparkSession, path: str, line_number: Column | None = None) -> DataFrame:
    """JSON lines whose last line may be torn; a malformed line before it fails. Columns: line, text.

    Lines are numbered within each file by their byte order, which whole-file reading keeps.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("_file"), F.posexplode(F.split("value", "\n")).alias("line", "text"))
    rows = files.where(F.trim("text") != "").withColumn("_ok", F.try_parse_json("text").isNotNull())
    last = rows.groupBy("_file").agg(F.max("line").alias("_good"), F.max(F.when(~F.col("_ok"), F.col("line"))).alias("_bad"),
                                     F.count_if(~F.col("_ok")).alias("_n"))
    if last.where("_n > 1 OR _bad < _good").limit(1).count():
        raise SourceError(f"{path} is malformed before its last line")
    return rows.where("_ok").select("line", "text")


def log_fields(df: DataFrame, text: str, fields: dict[str, str]) -> DataFrame:
    """Fields of log lines by JSON path; lines that are no JSON objects go."""
    start = F.regexp_extract(text, r"(\{.*\})\s*$", 1)
    rows = df.withColumn("_json", start).where(F.try_parse_json("_json").isNotNull() & (F.col("_json") != ""))
    return rows.select(*df.columns, *(F.get_json_object("_json", p).alias(n) for n, p in fields.items()))


def container_lines(df: DataFrame, text: str, fields: dict[str, str]) -> DataFrame:
    """Lines of container logs, '<time> <stream> <F or P> <body>': stamp, stream, and fields of a JSON body or null."""
    pattern = r"^(\S+) (stdout|stderr) [FP] (.*)$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    rows = df.where(F.col(text).rlike(pattern)).select(part(1).alias("_stamp"), part(2).alias("stream"), part(3).alias("_body"))
    return rows.select(F.col("_stamp").try_cast("timestamp").alias("stamp"), "stream", *(
        F.when(F.try_parse_json("_body").isNotNull(), F.get_json_object("_body", p)).alias(n) for n, p in fields.items()))


def read_framed(spark: SparkSession, path: str) -> DataFrame:
    """Records of length-framed, hash-checked journals: file, sequence, payload, valid.

    A record is a 4-byte big-endian length, a SHA-256 digest and the payload. A torn last record is left out.
    """
    import pyarrow as pa

    def run(batches):
        import hashlib

        for batch in batches:
            out = []
            for file, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at, i = 0, 0
                while at + 36 <= len(raw):
                    size = int.from_bytes(raw[at:at + 4], "big")
                    body = raw[at + 36:at + 36 + size]
                    if len(body) < size:
                        break
                    out.append((file, i, body, hashlib.sha256(body).digest() == raw[at + 4:at + 36]))
                    at, i = at + 36 + size, i + 1
            cols = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                cols, (pa.string(), pa.int64(), pa.binary(), pa.bool_()))], ["file", "sequence", "payload", "valid"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, sequence long, payload binary, valid boolean")


def kafka_options(servers: str, topic: str) -> dict[str, str]:
    """Options of a Kafka source with headers; the connector is supplied by the cluster."""
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, "includeHeaders": "true", "startingOffsets": "earliest"}


def event_headers(df: DataFrame) -> DataFrame:
    """event_id, event_type and schema_version from message headers; a missing version is -1, the sign of poison."""
    safe = lambda k: F.when(F.exists("headers", lambda h: h["key"] == k), F.try_element_at(
        F.transform(F.filter("headers", lambda h: h["key"] == k), lambda h: h["value"].cast("string")), F.lit(1)))
    return df.select("*", safe("event-id").alias("event_id"), safe("event-type").alias("event_type"),
                     F.coalesce(safe("schema-version").try_cast("int"), F.lit(-1)).alias("schema_version"))


def snapshot_digest(df: DataFrame) -> DataFrame:
    """Rows and a digest of a table that no order of rows changes: the sums of eight parts of row digests."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("long")) for i in range(8)]
    whole = F.sha2(F.concat_ws(",", *(F.coalesce(p, F.lit(0)).cast("string") for p in parts)), 256)
    return df.agg(F.count("*").alias("rows"), whole.alias("digest"))


def snapshot(tables: dict[str, DataFrame]) -> DataFrame:
    """name, rows and digest of every table."""
    one = [snapshot_digest(df).select(F.lit(n).alias("name"), "rows", "digest") for n, df in sorted(tables.items())]
    return reduce(lambda a, b: a.unionByName(b), one)


def snapshot_problems(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Tables that are missing or whose rows or digest differ from the manifest."""
    m = manifest.select("name", F.col("rows").alias("_rows"), F.col("digest").alias("_digest"))
    both = m.join(found, "name", "left")
    problem = F.when(F.col("digest").isNull(), "missing").when(F.col("rows") != F.col("_rows"), "count").when(
        F.col("digest") != F.col("_digest"), "digest")
    return both.withColumn("problem", problem).where("problem IS NOT NULL").select("name", "problem")


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """Names of the parquet tables in a directory."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    names = sorted(f.getPath().getName() for f in found)
    return spark.createDataFrame([(n.removesuffix(".parquet"),) for n in names if n.endswith(".parquet")], "name string")


def ordered_digests(tables: dict[str, DataFrame]) -> DataFrame:
    """relation, rows and the digest of its rows as JSON lines in byte order; rows meet in one, so for small relations."""
    one = []
    for name, df in tables.items():
        rows = F.array_sort(F.collect_list(F.to_json(F.struct(*df.columns))))
        one.append(df.agg(F.lit(name).alias("relation"), F.count("*").alias("rows"), F.sha2(F.array_join(rows, "\n"), 256).alias("digest")))
    return reduce(lambda a, b: a.unionByName(b), one)


def row_json(df: DataFrame) -> DataFrame:
    """Rows as JSON text, in the order of that text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("row")).orderBy("row")
