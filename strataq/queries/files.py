"""Sources and sinks, written to the shared folder and read again: inventory group A."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import time as C
from ..operators import relational as R
from ..sources import readers, sinks
from ..streaming import ops
from .base import Tables, query
from .streams import place, replayed

NAMES = "benchmark conversations customer documents embeddings events labels lineitem nation orders pages part region supplier".split()


@query("A21", f"SELECT table_name AS name FROM information_schema.tables WHERE table_name IN ({', '.join(repr(n) for n in NAMES)})")
def catalog(t: Tables):
    return readers.catalog(t.spark, t.dir)


@query("A20 A23", " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS rows, 'same' AS state FROM {n}" for n in NAMES))
def snapshot_gate(t: Tables):
    """Every table of the directory: its rows, and whether a second reading in another order has the same digest."""
    names = [r["name"] for r in readers.catalog(t.spark, t.dir).collect()]
    first = readers.snapshot({n: getattr(t, n) for n in names})
    again = readers.snapshot({n: getattr(t, n).repartition(3) for n in names})
    wrong = readers.snapshot_problems(again, first)
    return first.join(wrong, "name", "left").select("name", "rows", F.coalesce("problem", F.lit("same")).alias("state"))


@query("A22", "SELECT to_json({'n_nationkey': n_nationkey, 'n_name': n_name, 'n_regionkey': n_regionkey})::VARCHAR AS row FROM nation")
def row_export(t: Tables):
    return readers.row_json(t.nation.select("n_nationkey", "n_name", "n_regionkey"))


@query("A24", " UNION ALL ".join(
    f"SELECT '{n}' AS relation, count(*) AS rows, sha256(string_agg(j, chr(10) ORDER BY j)) AS digest FROM (SELECT to_json({{{', '.join(repr(c) + ': ' + c for c in cs.split())}}})::VARCHAR AS j FROM {n})"
    for n, cs in (("region", "r_regionkey r_name"), ("nation", "n_nationkey n_name n_regionkey"), ("supplier", "s_suppkey s_name s_nationkey"),
                  ("customer", "c_custkey c_name c_mktsegment"), ("part", "p_partkey p_brand p_size"), ("labels", "doc_id quality toxic"))))
def relation_digests(t: Tables):
    keep = {"region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "supplier": "s_suppkey s_name s_nationkey",
            "customer": "c_custkey c_name c_mktsegment", "part": "p_partkey p_brand p_size", "labels": "doc_id quality toxic"}
    return readers.ordered_digests({n: getattr(t, n).select(*cs.split()) for n, cs in keep.items()})


@query("A27", "SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def strict_csv(t: Tables):
    p = f"{place(t)}/csv"
    t.supplier.select("s_suppkey", "s_name", "s_nationkey").write.option("header", True).csv(p)
    return readers.read_csv(t.spark, p, "s_suppkey bigint, s_name string, s_nationkey int")


@query("A28", """SELECT CAST(o_orderkey % 4 AS BIGINT) AS arm, count(*) AS offered, count(*) FILTER (WHERE o_orderstatus = 'F') AS ended FROM orders
WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1""")
def window_csv(t: Tables):
    p = f"{place(t)}/csv"
    t.orders.select("o_orderkey", C.micros(F.col("o_orderdate")).alias("us"), "o_orderstatus").write.option("header", True).csv(p)
    rows = readers.read_csv(t.spark, p, "o_orderkey bigint, us bigint, o_orderstatus string").where("us >= 820454400000000 AND us < 852076800000000")
    return rows.groupBy((F.col("o_orderkey") % 4).alias("arm")).agg(F.count("*").alias("offered"), F.count_if(F.col("o_orderstatus") == "F").alias("ended"))


@query("A29", "SELECT 'c' || c_custkey::VARCHAR AS id FROM customer")
def id_list(t: Tables):
    p = f"{place(t)}/ids"
    t.customer.select(F.concat(F.lit(" c"), F.col("c_custkey").cast("string"))).write.text(p)
    return readers.read_ids(t.spark, p)


@query("A30", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1, 2")
def observer_log(t: Tables):
    p = f"{place(t)}/log"
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity")
    for k in (1, 2):  # an observation each
        sinks.append_csv(rows.where(F.col("l_linenumber") == k), p)
    return t.spark.read.option("header", True).csv(p).groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("A31", "SELECT true AS refused, count(*) AS rows FROM nation")
def header_drift(t: Tables):
    p = f"{place(t)}/log"
    rows = t.nation.select("n_nationkey", "n_name")
    sinks.append_csv(rows, p)
    try:
        sinks.append_csv(rows.withColumnRenamed("n_name", "name"), p)
        refused = False
    except readers.SourceError:
        refused = True
    return t.spark.read.option("header", True).csv(p).agg(F.lit(refused).alias("refused"), F.count("*").alias("rows"))


@query("A33", "SELECT CAST(event_id AS BIGINT) AS event_id, event_type FROM events WHERE event_id % 50 <> 49 AND event_id < 50 * (SELECT count(*) // 50 FROM events)")
def torn_journal(t: Tables):
    """One journal for each 50 events, whose last line is torn."""
    p = f"{place(t)}/journal"
    full = t.events.count() // 50
    line = F.when(F.col("event_id") % 50 == 49, F.lit('{"event_id": 1')).otherwise(F.to_json(F.struct("event_id", "event_type")))
    rows = t.events.select("event_id", F.expr("event_id div 50").alias("file"), line.alias("line")).where(F.col("file") < full)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "line"))), lambda r: r["line"]), "\n")
    files = rows.groupBy("file").agg(text.alias("value")).repartition(8, "file").sortWithinPartitions("file")
    files.write.partitionBy("file").text(p)
    out = readers.read_journal(t.spark, p)
    return out.select(F.from_json("text", "event_id bigint, event_type string").alias("v")).select("v.*")


@query("A34 H04", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'unknown:x' WHEN 2 THEN 'missing:b' WHEN 3 THEN 'null:b' ELSE 'malformed,missing:a,missing:b' END AS problems FROM events""")
def strict_decode(t: Tables):
    """Typed objects, and what is wrong with them; an object that holds a key twice is malformed."""
    k = F.col("event_id") % 5
    text = F.when(k == 0, '{"a": 1, "b": "x"}').when(k == 1, '{"a": 1, "b": "x", "x": 2}').when(k == 2, '{"a": 1}').when(
        k == 3, '{"a": 1, "b": null}').otherwise('{"a": 1, "a": 2, "b": "x"}')
    valid = F.when(F.try_parse_json(text).isNotNull(), text).otherwise("{")
    return readers.decode_json(t.events.select("event_id", valid.alias("text")), "text", "a int, b string").select(
        "event_id", F.array_join("problems", ",").alias("problems"))


@query("A35", "SELECT event_id, CAST(user_id AS VARCHAR) AS duration FROM events WHERE event_type = 'click'")
def timing_log(t: Tables):
    body = F.to_json(F.struct(F.lit("txn").alias("msg"), F.col("user_id").alias("duration_ms"), "event_id"))
    lines = t.events.select(F.when(F.col("event_type") == "click", F.concat(F.lit("INFO "), body)).otherwise("noise {not json}").alias("value"))
    p = f"{place(t)}/log"
    lines.write.text(p)
    found = readers.log_fields(t.spark.read.text(p), "value", {"event_id": "$.event_id", "duration": "$.duration_ms", "msg": "$.msg"})
    return found.where("msg = 'txn'").select(F.col("event_id").cast("long").alias("event_id"), "duration")


@query("A36", "SELECT event_id, epoch_us(ts) AS us, CASE WHEN event_id % 2 = 0 THEN 'stdout' ELSE 'stderr' END AS stream, event_type AS event FROM events WHERE event_id % 7 <> 0")
def container_lines(t: Tables):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    body = F.to_json(F.struct(F.col("event_type").alias("event"), "event_id"))
    line = F.concat_ws(" ", stamp, F.when(F.col("event_id") % 2 == 0, "stdout").otherwise("stderr"), F.lit("F"), F.when(F.col("event_id") % 7 == 0, "started").otherwise(body))
    rows = readers.container_lines(t.events.select(line.alias("value")), "value", {"event": "$.event", "event_id": "$.event_id"})
    return rows.where("event_id IS NOT NULL").select(F.col("event_id").cast("long").alias("event_id"), C.micros(F.col("stamp")).alias("us"), "stream", "event")


@query("A37", """SELECT event_type, CASE WHEN event_id % 6 = 0 THEN -1 ELSE 2 END AS schema_version, count(*) AS n FROM events GROUP BY 1, 2""")
def message_headers(t: Tables):
    head = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").cast("binary").alias("value"))
    named = F.array(head("event-id", F.col("event_id")), head("event-type", F.col("event_type")))
    version = F.when(F.col("event_id") % 6 == 0, named).otherwise(F.concat(named, F.array(head("schema-version", F.lit(2)))))
    return readers.event_headers(t.events.select(version.alias("headers"))).groupBy("event_type", "schema_version").agg(F.count("*").alias("n"))


@query("A39", "SELECT CAST(event_id % 3 AS BIGINT) AS part, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY 1")
def replayed_broker(t: Tables):
    """A broker of files, one a micro-batch: what a consumer of each partition has read when the stream is drained."""
    from .streams import drained

    p = place(t)
    part = (F.col("event_id") % 3).alias("part")
    out = drained(replayed(t.events.select("event_id", part).repartition(3, "part"), p, files=1), p)
    return out.groupBy("part").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@query("A42", """WITH r AS (SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1), l AS (SELECT 2 + row_number() OVER (ORDER BY p) AS line, '| ' || p || ' | ' || n::VARCHAR || ' |' AS text FROM r)
SELECT * FROM l UNION ALL SELECT 1, '| priority | orders |' UNION ALL SELECT 2, '| --- | --- |'""")
def report(t: Tables):
    n = t.orders.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("orders")).orderBy("priority")
    text = sinks.markdown([r.asDict() for r in n.collect()])
    return t.spark.createDataFrame([(i, x) for i, x in enumerate(text.split("\n"), 1)], "line long, text string")


@query("A43", "SELECT 'part' AS name, count(*) AS rows, true AS verified FROM part UNION ALL SELECT 'supplier', count(*), true FROM supplier")
def verified_pack(t: Tables):
    """Tables packed once, with a manifest of digests, and checked against it when they are read again."""
    p = place(t)
    tables = {n: getattr(t, n) for n in ("part", "supplier")}
    sinks.pack(tables, p)
    manifest, found = sinks.unpack(t.spark, p, list(tables))
    wrong = readers.snapshot_problems(readers.snapshot(found), manifest)
    return manifest.join(wrong, "name", "left").select("name", "rows", F.col("problem").isNull().alias("verified"))


@query("A55", "SELECT n_nationkey - 1 AS sequence, n_name AS payload, n_nationkey % 5 <> 0 AS valid FROM nation WHERE n_nationkey BETWEEN 1 AND 23")
def framed_journal(t: Tables):
    """A journal of length-framed records: some with a wrong digest, the last torn."""
    import hashlib

    p, raw = f"{place(t)}/journal", b""
    for r in t.nation.where("n_nationkey > 0").orderBy("n_nationkey").collect():
        body = r["n_name"].encode()
        raw += len(body).to_bytes(4, "big") + (hashlib.sha256(body).digest() if r["n_nationkey"] % 5 else bytes(32)) + body
    sinks.write_bytes(t.spark, f"{p}/segment", raw[:-3])
    return readers.read_framed(t.spark, p).select("sequence", F.col("payload").cast("string").alias("payload"), "valid")


@query("A14", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey = 11 ORDER BY o_orderdate, o_orderkey")
def obligation_history(t: Tables):
    return R.lookup(t.orders, o_custkey=11).orderBy("o_orderdate", "o_orderkey").select("o_orderkey", "o_orderstatus")


@query("A15", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 7 = 0 ORDER BY o_orderdate, o_orderkey LIMIT 50")
def global_obligations(t: Tables):
    part = F.expr("CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey % 16 END")
    return R.first_rows(t.orders.where("o_orderstatus = 'O'").where(part.isNull()), ["o_orderdate", "o_orderkey"], 50).select("o_orderkey")


@query("A47", """SELECT event_id FROM events WHERE user_id % 16 = 3 AND (event_type = 'signup' OR (event_type = 'view' AND ts <= TIMESTAMP '2024-01-15'))
ORDER BY ts, event_id LIMIT 40""")
def pending_wakeups(t: Tables):
    state = F.when(F.col("event_type") == "signup", "PENDING").when(F.col("event_type") == "view", "CLAIMED").otherwise("CONSUMED")
    now = F.lit("2024-01-15").cast("timestamp_ntz")
    rows = t.events.where("user_id % 16 = 3").where(R.claimable(state, F.col("ts"), F.lit(None).cast("timestamp_ntz"), now))
    return R.first_rows(rows, ["ts", "event_id"], 40).select("event_id")


@query("A19", "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_suppkey = 5 AND l_partkey % 2 = 0 ORDER BY l_orderkey, l_linenumber")
def effect_calls(t: Tables):
    return R.lookup(t.lineitem, l_suppkey=5).where("l_partkey % 2 = 0").orderBy("l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "l_returnflag")


@query("I26", "SELECT user_id, event_type AS kind, count(*) AS delivered, count(*) FILTER (WHERE value > 100) AS failed FROM events GROUP BY 1, 2")
def worker_batches(t: Tables):
    """Tasks of a topic, polled in micro-batches and each run once: delivered and failed by worker and kind."""
    p = place(t)

    def work(batch, number):
        batch.withColumn("ok", F.col("value") <= 100).write.mode("overwrite").parquet(f"{p}/done/batch={number}")

    ops.demand(work, replayed(t.events.select("user_id", "event_type", "value"), p), f"{p}/state").awaitTermination()
    done = t.spark.read.parquet(f"{p}/done")
    return done.groupBy("user_id", F.col("event_type").alias("kind")).agg(F.count("*").alias("delivered"), F.count_if(~F.col("ok")).alias("failed"))
