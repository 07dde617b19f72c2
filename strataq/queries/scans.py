"""Scans, predicates, sorts and limits: inventory groups A, B and F."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import time as C
from ..operators import relational as R
from ..sources import sinks
from .base import Tables, query


@query("A01", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey = 42")
def point_lookup(t: Tables):
    return R.lookup(t.customer, c_custkey=42).select("c_custkey", "c_name", "c_mktsegment")


@query("A48", "SELECT event_id AS next_offset, user_id AS part FROM events WHERE event_id = 99")
def offset_lookup(t: Tables):
    return R.lookup(t.events, event_id=99).select(F.col("event_id").alias("next_offset"), F.col("user_id").alias("part"))


@query("A49", "SELECT o_orderkey AS intent, o_orderstatus AS decision, o_totalprice AS amount FROM orders WHERE o_orderkey = 33")
def intent_lookup(t: Tables):
    return R.lookup(t.orders, o_orderkey=33).select(F.col("o_orderkey").alias("intent"), F.col("o_orderstatus").alias("decision"), F.col("o_totalprice").alias("amount"))


@query("A50", "SELECT l_orderkey, l_linenumber, l_returnflag AS outcome FROM lineitem WHERE l_orderkey = 5 AND l_partkey % 2 = 1")
def effect_lookup(t: Tables):
    return R.lookup(t.lineitem, l_orderkey=5).where("l_partkey % 2 = 1").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("outcome"))


@query("A05 A16", "SELECT conv_id, turn, role FROM conversations WHERE conv_id = 3 ORDER BY turn")
def ordered_turns(t: Tables):
    return R.lookup(t.conversations, conv_id=3).orderBy("turn").select("conv_id", "turn", "role")


@query("A17 A18", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_custkey = 8 AND o_orderstatus <> 'P' ORDER BY o_orderdate, o_orderkey")
def approval_scan(t: Tables):
    return R.lookup(t.orders, o_custkey=8).where("o_orderstatus <> 'P'").orderBy("o_orderdate", "o_orderkey").select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("A02", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey = 7 AND l_linenumber = 2")
def composite_lookup(t: Tables):
    return R.lookup(t.lineitem, l_orderkey=7, l_linenumber=2).select("l_orderkey", "l_linenumber", "l_partkey")


@query("A03 B09 H36", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'error'")
def json_props(t: Tables):
    return t.events.where("event_type = 'error'").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("A04", "SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_orderkey = 100")
def child_scan(t: Tables):
    return R.lookup(t.lineitem, l_orderkey=100).select("l_orderkey", "l_linenumber", "l_suppkey").orderBy("l_linenumber", "l_suppkey")


@query("A06 A08", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey > 5000 ORDER BY o_orderkey LIMIT 100")
def keyset_page(t: Tables):
    return R.page_after(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderkey", 5000, 100)


@query("A07 C13", """SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey
AND o_orderstatus = 'P' AND o_totalprice > 450000) OR EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_totalprice < 2000)""")
def runtime_work_or_exists(t: Tables):
    o = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    return R.either_exists(t.customer.select("c_custkey"), "c_custkey", [
        o.where("o_orderstatus = 'P' AND o_totalprice > 450000"), o.where("o_totalprice < 2000")])


@query("A09 A10 A12", """SELECT event_id, user_id, c_name FROM events JOIN customer ON user_id = c_custkey
WHERE event_type = 'purchase' ORDER BY ts, event_id LIMIT 200""")
def inbox_scan(t: Tables):
    e = t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    c = t.customer.select(F.col("c_custkey").alias("user_id"), "c_name")
    return R.first_rows(e.join(c, "user_id"), ["ts", "event_id"], 200).select("event_id", "user_id", "c_name")


@query("A11 B07 B08", """SELECT event_id, coalesce(json_extract_string(props, '$.missing'), '') AS reason,
coalesce(json_extract_string(props, '$.k') IS NOT NULL, false) AS has_k FROM events""")
def null_defaults(t: Tables):
    return t.events.select("event_id", F.coalesce(F.get_json_object("props", "$.missing"), F.lit("")).alias("reason"),
                           F.get_json_object("props", "$.k").isNotNull().alias("has_k"))


@query("A13", """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey % 16 END AS part FROM orders
WHERE o_orderstatus = 'O' AND (o_orderkey % 7 = 0 OR o_custkey % 16 = 3)""")
def open_obligations(t: Tables):
    rows = t.orders.where("o_orderstatus = 'O'").select("o_orderkey", F.expr(
        "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey % 16 END").alias("part"))
    return rows.where(R.global_or(F.col("part"), 3))


@query("A25 A26 D10", """SELECT n_regionkey, count(*) AS children, string_agg(n_nationkey::VARCHAR || ':' || n_name, ',' ORDER BY n_nationkey) AS listing
FROM nation GROUP BY 1""")
def ordered_children(t: Tables):
    rows = F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name")))
    return t.nation.groupBy("n_regionkey").agg(F.count("*").alias("children"), F.array_join(F.transform(
        rows, lambda r: F.concat_ws(":", r["n_nationkey"], r["n_name"])), ",").alias("listing"))


@query("A41", """SELECT 'orders_total{priority="' || o_orderpriority || '",status="' || o_orderstatus || '"} ' || count(*)::VARCHAR AS line
FROM orders GROUP BY o_orderpriority, o_orderstatus""")
def metric_lines(t: Tables):
    n = t.orders.groupBy(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    return sinks.prometheus(n, "orders_total", "n", ["priority", "status"])


@query("A46 A63", """SELECT i, CAST(floor(i * 1000000000.0 / 3) AS BIGINT) AS offset_ns,
CASE WHEN i % 10 = 8 THEN 'echo' WHEN i % 10 = 9 THEN 'add' ELSE 'sleep' END AS activity FROM range(1000) AS r(i)""")
def arrival_plan(t: Tables):
    i = F.col("id")
    return t.spark.range(1000).select(i.alias("i"), F.floor(i * F.lit(1000000000.0) / 3).alias("offset_ns"),
                                      F.when(i % 10 == 8, "echo").when(i % 10 == 9, "add").otherwise("sleep").alias("activity"))


@query("A51", """SELECT c_custkey, coalesce(max(CAST(o_orderkey % 5 AS BIGINT)), 3) AS budget FROM customer
LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 480000 GROUP BY 1""")
def policy_with_default(t: Tables):
    o = t.orders.where("o_totalprice > 480000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.col("o_orderkey") % 5).alias("b"))
    return t.customer.select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("b", F.lit(3)).cast("long").alias("budget"))


@query("A53", """SELECT k AS o_orderkey, o_orderkey IS NOT NULL AS found FROM (SELECT DISTINCT l_orderkey * 2 AS k FROM lineitem) LEFT JOIN orders ON o_orderkey = k""")
def submission_reconciliation(t: Tables):
    ids = t.lineitem.select((F.col("l_orderkey") * 2).alias("o_orderkey")).distinct()
    have = t.orders.select("o_orderkey").distinct().withColumn("found", F.lit(True))
    return ids.join(have, "o_orderkey", "left").fillna(False, ["found"])


@query("B01 D03 C08", """SELECT count(*) FILTER (WHERE o_orderstatus = 'P') AS dispatchable, count(*) FILTER (WHERE o_orderstatus = 'O') AS claimed,
greatest(coalesce(max(epoch_us(TIMESTAMP '1998-01-01')) - min(epoch_us(o_orderdate)) FILTER (WHERE o_orderstatus = 'P'), 0), 0) / 1000000.0 AS oldest_age
FROM orders WHERE o_orderstatus IN ('P', 'O') AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')
AND EXISTS (SELECT 1 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = o_custkey AND n_regionkey = 1)""")
def demand_sample(t: Tables):
    c = t.customer.withColumnRenamed("c_custkey", "o_custkey")
    building = c.where("c_mktsegment = 'BUILDING'")
    asia = c.join(t.nation.where("n_regionkey = 1"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = R.having(R.having(t.orders.where("o_orderstatus IN ('P', 'O')"), building, ["o_custkey"]), asia, ["o_custkey"])
    age = F.lit(883612800000000) - F.min(F.when(F.col("o_orderstatus") == "P", C.micros(F.col("o_orderdate"))))
    return rows.agg(F.expr("count(*) FILTER (WHERE o_orderstatus = 'P')").alias("dispatchable"),
                    F.expr("count(*) FILTER (WHERE o_orderstatus = 'O')").alias("claimed"),
                    (F.greatest(F.coalesce(age, F.lit(0)), F.lit(0)) / 1e6).alias("oldest_age"))


@query("B02", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_totalprice > 400000")
def optional_predicate(t: Tables):
    out, since, status = t.orders, "1996-01-01", None
    if since is not None:
        out = out.where(F.col("o_orderdate") >= F.lit(since).cast("timestamp_ntz"))
    if status is not None:
        out = out.where(F.col("o_orderstatus") == status)
    return out.where("o_totalprice > 400000").select("o_orderkey")


@query("B03 F01 I02", """SELECT event_id FROM events WHERE (event_type = 'signup' OR (event_type = 'error' AND ts <= TIMESTAMP '2024-01-10'))
AND value > 100 ORDER BY ts, event_id LIMIT 50""")
def claim_batch(t: Tables):
    state = F.when(F.col("event_type") == "signup", "PENDING").when(F.col("event_type") == "error", "CLAIMED")
    now = F.lit("2024-01-10").cast("timestamp_ntz")
    due = F.when(F.col("value") > 100, F.lit(None)).otherwise(F.lit("2999-01-01")).cast("timestamp_ntz")
    return R.first_rows(t.events.where(R.claimable(state, F.col("ts"), due, now)), ["ts", "event_id"], 50).select("event_id")


@query("B05", """SELECT o_orderkey, TIMESTAMP '1997-06-01' < o_orderdate AS live, sha256(o_orderkey::VARCHAR || chr(0) || o_orderstatus) AS scope FROM orders
WHERE o_orderdate <= TIMESTAMP '1998-01-01'""")
def grant_liveness(t: Tables):
    from ..functions.hashing import joined_digest

    rows = t.orders.where(F.col("o_orderdate") <= F.lit("1998-01-01").cast("timestamp_ntz"))
    return rows.select("o_orderkey", (F.lit("1997-06-01").cast("timestamp_ntz") < F.col("o_orderdate")).alias("live"),
                       joined_digest(F.col("o_orderkey"), F.col("o_orderstatus")).alias("scope"))


@query("B10 B16 B21", "SELECT o_orderkey AS workflow_id, o_orderstatus AS state FROM orders WHERE o_orderpriority = '1-URGENT'")
def closed_projection(t: Tables):
    return t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("workflow_id"), F.col("o_orderstatus").alias("state"))


@query("B11 B12 K34", """SELECT event_id, CASE WHEN event_type = 'purchase' AND value > 50 THEN 'terminal' WHEN event_type = 'error' THEN 'receipt'
WHEN value < 10 THEN 'cancel' WHEN event_type = 'signup' THEN 'claim' ELSE 'transition' END AS kind FROM events""")
def history_kind(t: Tables):
    from ..operators.invariants import first_reason

    kind, value = F.col("event_type"), F.col("value")
    return t.events.select("event_id", F.coalesce(first_reason([
        ("terminal", (kind == "purchase") & (value > 50)), ("receipt", kind == "error"), ("cancel", value < 10),
        ("claim", kind == "signup")]), F.lit("transition")).alias("kind"))


@query("B13 B14", """SELECT event_id, user_id FROM events WHERE user_id = 7 AND event_type = 'error' ORDER BY event_id LIMIT 20""")
def log_filter(t: Tables):
    return R.first_rows(R.lookup(t.events, user_id=7, event_type="error").select("event_id", "user_id"), ["event_id"], 20)


@query("B15", """SELECT CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'other' END AS label, count(*) AS n FROM events GROUP BY 1""")
def bounded_labels(t: Tables):
    return t.events.groupBy(R.bounded_label(F.col("event_type"), ("click", "view")).alias("label")).agg(F.count("*").alias("n"))


@query("B19 H27", "SELECT event_id, value IS NOT NULL AND NOT isnan(value) AND value >= 0 AND value <= 60 AS valid FROM events")
def poll_gap_valid(t: Tables):
    return t.events.select("event_id", (C.finite(F.col("value")) & (F.col("value") <= 60)).alias("valid"))


@query("B20 C09 D17", """SELECT c_custkey, coalesce((SELECT o_orderstatus FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000
ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1), 'unknown') AS state FROM customer""")
def lateral_top1(t: Tables):
    o = t.orders.where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderkey", "o_orderstatus")
    out = R.with_latest(t.customer.select("c_custkey"), o, ["c_custkey"], ["o_orderdate", "o_orderkey"])
    return out.select("c_custkey", F.coalesce("o_orderstatus", F.lit("unknown")).alias("state"))


@query("B22 C14", """SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('P', 'O') AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def runnable_discovery(t: Tables):
    ids = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return R.restrict(t.orders.where("o_orderstatus IN ('P', 'O')").select("o_orderkey", "o_custkey"), ids, "o_custkey").select("o_orderkey")


@query("F02 F03", "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id LIMIT 1")
def latest_one(t: Tables):
    return t.events.orderBy(F.desc("ts"), "event_id").limit(1).select("event_id", "user_id")


@query("F04 F05 C02", """SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '1996-06-30' ORDER BY o_orderdate, o_orderkey LIMIT 100""")
def due_attempts(t: Tables):
    o = t.orders.where((F.col("o_orderstatus") == "O") & (F.col("o_orderdate") <= F.lit("1996-06-30").cast("timestamp_ntz")))
    out = o.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return R.first_rows(out, ["o_orderdate", "o_orderkey"], 100).select("o_orderkey", "c_name", "n_name")


@query("F06 F08 F09", """SELECT p_brand, p_partkey, rank FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand
ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 3""")
def topk_per_group(t: Tables):
    return R.top_per_group(t.part, ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")], 3).select(
        "p_brand", "p_partkey", F.col("rank").cast("long").alias("rank"))


@query("F10", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def deterministic_sort(t: Tables):
    return t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n")).orderBy("o_orderpriority")


@query("F11", """SELECT s_suppkey FROM supplier WHERE s_acctbal > 0 ORDER BY sha256('410041' || ':' || s_suppkey::VARCHAR), s_suppkey LIMIT 1""")
def seeded_target(t: Tables):
    order = F.sha2(F.concat(F.lit("410041:"), F.col("s_suppkey").cast("string")), 256)
    return t.supplier.where("s_acctbal > 0").orderBy(order, "s_suppkey").limit(1).select("s_suppkey")


@query("H17 H10 A40", "SELECT doc_id, substr(text, 1, 240) AS snippet FROM documents WHERE lang = 'en'")
def snippets(t: Tables):
    return t.documents.where("lang = 'en'").select("doc_id", T.snippet(F.col("text")).alias("snippet"))
