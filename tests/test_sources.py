import hashlib
import json

import pytest
from pyspark.sql import functions as F

from strataq.plans import verdict
from strataq.sources import readers, sinks
from strataq.sources.schemas import VIEWS, trace_of


def write(path, lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_csv_is_strict(spark, tmp_path):
    good = write(tmp_path / "a.csv", ["id,v", "1,2.5", "2,3.5"])
    assert readers.read_csv(spark, good, "id int, v double").count() == 2
    for lines in (["id,v", "1,x"], ["other,v", "1,2"]):
        with pytest.raises(Exception):
            readers.read_csv(spark, write(tmp_path / "b.csv", lines), "id int, v double").collect()


def test_ids_repeat(spark, tmp_path):
    assert readers.read_ids(spark, write(tmp_path / "a.txt", ["x", "", " y "])).count() == 2
    with pytest.raises(readers.SourceError):
        readers.read_ids(spark, write(tmp_path / "b.txt", ["x", "x"]))


def test_jsonl_is_closed(spark, tmp_path):
    rows = readers.read_jsonl(spark, write(tmp_path / "a.jsonl", ['{"a":1,"b":"x"}', '{"a":2,"b":null}']), "a int, b string")
    assert sorted(tuple(r) for r in rows.collect()) == [(1, "x"), (2, None)]
    for line in ('{"a":1}', '{"a":1,"b":"x","c":2}', "{torn"):
        with pytest.raises(readers.SourceError):
            readers.read_jsonl(spark, write(tmp_path / "b.jsonl", [line]), "a int, b string")


def test_decode_names_problems(spark):
    df = spark.createDataFrame([('{"a":1,"b":"x"}',), ('{"a":null,"c":1}',), ("no",)], "t string")
    assert [r["problems"] for r in readers.decode_json(df, "t", "a int, b string").collect()] == [[], ["missing:b", "null:a", "unknown:c"], ["malformed", "missing:a", "missing:b"]]


def test_journal_tail(spark, tmp_path):
    assert readers.read_journal(spark, write(tmp_path / "a", ['{"a":1}', '{"a":2}', '{"a":'])).count() == 2
    with pytest.raises(readers.SourceError):
        readers.read_journal(spark, write(tmp_path / "b", ['{"a":1}', '{"a":', '{"a":3}']))


def test_framed_records(spark, tmp_path):
    def frame(body, wrong=False):
        return len(body).to_bytes(4, "big") + (b"\0" * 32 if wrong else hashlib.sha256(body).digest()) + body

    (tmp_path / "j").write_bytes(frame(b"one") + frame(b"two", True) + frame(b"three")[:-2])
    assert [(r["sequence"], bytes(r["payload"]), r["valid"]) for r in readers.read_framed(spark, str(tmp_path / "j")).collect()] == [(0, b"one", True), (1, b"two", False)]


def test_log_fields_and_headers(spark):
    df = spark.createDataFrame([('x stdout F {"m": "t", "d": 5}',), ("noise",)], "line string")
    assert [tuple(r) for r in readers.log_fields(df, "line", {"d": "$.d"}).select("d").collect()] == [("5",)]
    k = spark.createDataFrame([([("event-id", bytearray(b"e")), ("schema-version", bytearray(b"2"))],), ([("event-id", bytearray(b"f"))],)], "headers array<struct<key:string,value:binary>>")
    assert [(r["event_id"], r["schema_version"]) for r in readers.event_headers(k).collect()] == [("e", 2), ("f", -1)]


def test_snapshot_digest_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "a int, b string")
    m = readers.snapshot({"t": a})
    assert readers.snapshot_problems(readers.snapshot({"t": a.orderBy(F.desc("a"))}), m).count() == 0
    found = readers.snapshot_problems(readers.snapshot({"t": a.distinct()}), m).collect()
    assert [tuple(r) for r in found] == [("t", "count")]
    assert [tuple(r) for r in readers.snapshot_problems(readers.snapshot({"u": a}), m).collect()] == [("t", "missing")]


def test_append_refuses_drift(spark, tmp_path):
    p = f"file://{tmp_path}/out"
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    sinks.append_csv(df, p)
    sinks.append_csv(df, p)
    assert spark.read.option("header", True).csv(p).count() == 2
    with pytest.raises(readers.SourceError):
        sinks.append_csv(df.withColumnRenamed("b", "c"), p)
    with pytest.raises(Exception):
        sinks.write_once(df, p)


def test_lines(spark):
    df = spark.createDataFrame([('a"b', 2)], "l string, n int")
    assert sinks.prometheus(df, "m", "n", ["l"]).first()[0] == 'm{l="a\\"b"} 2'
    assert sinks.markdown([{"a": 1, "b": None}]) == "| a | b |\n| --- | --- |\n| 1 |  |"


def test_stored_trace(spark, tmp_path):
    trace = trace_of(spark, {"workflows": [dict(workflow_id="w", state="RUNNABLE", revision=1)]})
    for name, df in trace.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    manifest = readers.snapshot(trace)
    assert verdict.verdict(spark, str(tmp_path), manifest).count() == 0
    wrong = manifest.withColumn("rows", F.when(F.col("name") == "workflows", 5).otherwise(F.col("rows")))
    assert [tuple(r) for r in verdict.verdict(spark, str(tmp_path), wrong).collect()] == [("snapshot count", "workflows")]
    assert json.dumps(sorted(VIEWS)) and set(trace) == set(VIEWS)
