"""Joins and sets: inventory groups C and G."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import time as C
from ..operators import relational as R
from ..operators import sequence as S
from .base import Tables, query


@query("C01 C05 C07", """SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey""")
def inner_join(t: Tables):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("C03 C04 C06", """SELECT l_orderkey, l_linenumber, p_brand, s_name, n_name FROM lineitem JOIN part ON l_partkey = p_partkey
JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""")
def join_chain(t: Tables):
    out = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return out.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("l_orderkey", "l_linenumber", "p_brand", "s_name", "n_name")


@query("C12", "SELECT n_nationkey, n_name FROM nation WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9900)")
def referenced_definitions(t: Tables):
    c = t.customer.where("c_acctbal > 9900").select(F.col("c_nationkey").alias("n_nationkey"))
    return R.having(t.nation, c, ["n_nationkey"]).select("n_nationkey", "n_name")


@query("C15", """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')""")
def unknown_reference(t: Tables):
    known = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return R.lacking(t.lineitem, known, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("C16 K05", """SELECT DISTINCT user_id, CAST(floor(epoch_us(ts) / 86400000000) AS BIGINT) AS day FROM events e WHERE event_type = 'purchase' AND NOT EXISTS
(SELECT 1 FROM events c WHERE c.event_type = 'click' AND c.user_id = e.user_id AND floor(epoch_us(c.ts) / 86400000000) = floor(epoch_us(e.ts) / 86400000000))""")
def missing_obligation(t: Tables):
    rows = t.events.select("user_id", "event_type", F.floor(C.micros(F.col("ts")) / 86400000000).alias("day"))
    need = rows.where("event_type = 'purchase'").select("user_id", "day").distinct()
    return R.lacking(need, rows.where("event_type = 'click'"), ["user_id", "day"])


@query("C18 C19", """SELECT DISTINCT e.event_id FROM events s, events m, events e WHERE s.user_id = m.user_id AND m.user_id = e.user_id
AND s.event_type = 'signup' AND m.event_type = 'error' AND e.event_type = 'purchase' AND s.ts < m.ts AND m.ts < e.ts""")
def between_self_join(t: Tables):
    kind = F.col("event_type")
    return R.between_self_join(t.events, "user_id", "ts", kind == "signup", kind == "error", kind == "purchase").select("event_id")


@query("C20", """SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1""")
def epoch_latest(t: Tables):
    return R.latest(t.orders.select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("C21 E34", """SELECT e.event_id, (SELECT max(s.event_id) FROM events s WHERE s.user_id = e.user_id AND s.event_type = 'signup' AND s.ts =
(SELECT max(x.ts) FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'signup' AND x.ts <= e.ts)) AS owner FROM events e WHERE e.event_type = 'error'""")
def asof_ownership(t: Tables):
    e = t.events.select("event_id", "user_id", "event_type", C.micros(F.col("ts")).alias("us"))
    right = e.where("event_type = 'signup'").select("user_id", F.col("us").alias("at"), F.col("event_id").alias("owner"))
    return S.asof(e.where("event_type = 'error'").drop("event_type"), right, ["user_id"], "us", "at", ["owner"]).select("event_id", F.col("asof_owner").alias("owner"))


@query("C22", """SELECT e.event_id, (SELECT max(epoch_us(x.ts)) FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'view' AND x.ts < e.ts) AS before_at,
(SELECT min(epoch_us(x.ts)) FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'view' AND x.ts > e.ts) AS after_at FROM events e WHERE e.event_type = 'purchase'""")
def bracket_join(t: Tables):
    e = t.events.select("event_id", "user_id", "event_type", C.micros(F.col("ts")).alias("us"))
    right = e.where("event_type = 'view'").select("user_id", F.col("us").alias("at"))
    out = S.bracket(e.where("event_type = 'purchase'").drop("event_type"), right, ["user_id"], "us", "at", [])
    return out.select("event_id", "before_at", "after_at")


@query("C23 C25 K27", """WITH iv AS (SELECT o_orderkey, min(epoch_us(o_orderdate)) AS s, max(epoch_us(l_shipdate)) AS e FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1),
inst AS (SELECT DISTINCT epoch_us(o_orderdate) + 43200000000 AS t FROM orders)
SELECT t, (SELECT count(*) FROM iv WHERE s <= t AND t < e) AS active FROM inst""")
def active_intervals(t: Tables):
    rows = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    iv = rows.groupBy("o_orderkey").agg(C.micros(F.min("o_orderdate")).alias("s"), C.micros(F.max("l_shipdate")).alias("e"))
    at = t.orders.select((C.micros(F.col("o_orderdate")) + 43200000000).alias("t")).distinct()
    # An interval that ends before it starts holds nothing.
    return S.active_at(iv.where("s < e"), "s", "e", at, "t")


@query("C24 K26", """WITH iv AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, epoch_us(l_shipdate) AS s, epoch_us(l_shipdate) + 86400000000 * l_linenumber AS e FROM lineitem),
w AS (SELECT *, max(e) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM iv)
SELECT l_suppkey, count(*) AS overlapping FROM w WHERE s < high GROUP BY 1""")
def interval_overlaps(t: Tables):
    us = C.micros(F.col("l_shipdate"))
    iv = t.lineitem.select("l_suppkey", us.alias("s"), (us + F.lit(86400000000) * F.col("l_linenumber")).alias("e"))
    return S.overlaps(iv, ["l_suppkey"], "s", "e").groupBy("l_suppkey").agg(F.count("*").alias("overlapping"))


@query("C26 E30", """SELECT CAST(floor((epoch_us(ts) - 1704067200000000) * 6.0 / 2592000000000) AS INTEGER) AS bin, event_type, count(*) AS n FROM events
WHERE epoch_us(ts) >= 1704067200000000 AND epoch_us(ts) < 1704067200000000 + 2592000000000 GROUP BY 1, 2""")
def bins6(t: Tables):
    b = S.bins(C.micros(F.col("ts")), 1704067200000000, 2592000000000, 6)
    return t.events.select(b.alias("bin"), "event_type").where("bin IS NOT NULL").groupBy("bin", "event_type").agg(F.count("*").alias("n"))


@query("C27", """SELECT rule, count(*) AS n FROM (
SELECT 'start without end' AS rule FROM orders WHERE o_orderpriority <> '1-URGENT' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
UNION ALL SELECT 'end without start' FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R') WHERE k NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority <> '1-URGENT')
UNION ALL SELECT 'start without attempt' FROM orders WHERE o_orderpriority <> '1-URGENT' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) GROUP BY 1""")
def witness_join(t: Tables):
    from ..operators.invariants import witness

    starts = t.orders.where("o_orderpriority <> '1-URGENT'").select(F.col("o_orderkey").alias("invocation"), F.col("o_custkey").alias("owner"))
    ends = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("invocation")).distinct()
    attempts = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("owner"))
    return witness(starts, ends, attempts, "invocation", ["owner"]).groupBy("rule").agg(F.count("*").alias("n"))


@query("C32 D25 C31", """WITH m AS (SELECT l_linestatus, l_returnflag, median(l_extendedprice) AS v FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY 1, 2)
SELECT a.l_linestatus, round(a.v, 6) AS "A", round(r.v, 6) AS "R", round(r.v - a.v, 6) AS delta FROM m a JOIN m r USING (l_linestatus) WHERE a.l_returnflag = 'A' AND r.l_returnflag = 'R'""")
def off_on_pairs(t: Tables):
    m = t.lineitem.where("l_returnflag IN ('R', 'A')").groupBy("l_linestatus", "l_returnflag").agg(F.median("l_extendedprice").alias("v"))
    p = R.pair_arms(m, ["l_linestatus"], "l_returnflag", ("A", "R"), F.col("v"))
    return p.select("l_linestatus", F.round("A", 6).alias("A"), F.round("R", 6).alias("R"), F.round(F.col("R") - F.col("A"), 6).alias("delta"))


@query("C33", """SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS "both", count(*) FILTER (WHERE quality = 1 AND toxic <> 1) AS left_only,
count(*) FILTER (WHERE quality <> 1 AND toxic = 1) AS right_only, count(*) FILTER (WHERE quality <> 1 AND toxic <> 1) AS neither FROM labels""")
def paired_binary(t: Tables):
    return R.paired_binary(t.labels, t.labels, "doc_id", F.col("quality") == 1, F.col("toxic") == 1)


@query("C34", "SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') THEN 'R' ELSE o_orderstatus END AS state FROM orders")
def update_from(t: Tables):
    flag = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("hit", F.lit(True))
    return t.orders.join(flag, "o_orderkey", "left").select("o_orderkey", F.when(F.col("hit"), "R").otherwise(F.col("o_orderstatus")).alias("state"))


@query("C35 I16 I17", """SELECT r_regionkey, coalesce((SELECT bool_and(EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000))
FROM nation WHERE n_regionkey = r_regionkey), false) AS ready FROM region""")
def dag_barrier(t: Tables):
    need = t.nation.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.collect_list("n_nationkey").alias("deps"))
    nodes = t.region.join(need, "r_regionkey", "left")
    done = t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.bool_or(F.col("s_acctbal") > 5000).alias("ok"))
    return R.ready(nodes, "r_regionkey", "deps", done, "n_nationkey", F.col("ok")).select("r_regionkey", "ready")


@query("C10", """WITH q AS (SELECT avg(p_retailprice) AS m FROM part) SELECT p_partkey FROM part, q WHERE p_retailprice > m * 1.02""")
def one_row_cross(t: Tables):
    q = t.part.agg(F.avg("p_retailprice").alias("m"))
    return t.part.crossJoin(F.broadcast(q)).where("p_retailprice > m * 1.02").select("p_partkey")


@query("C17 G03 G08", """WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01'), b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01')
SELECT (SELECT count(*) FROM a WHERE o_custkey NOT IN (SELECT * FROM b)) AS left_only, (SELECT count(*) FROM b WHERE o_custkey NOT IN (SELECT * FROM a)) AS right_only,
(SELECT count(*) FROM a WHERE o_custkey NOT IN (SELECT * FROM b)) + (SELECT count(*) FROM b WHERE o_custkey NOT IN (SELECT * FROM a)) = 0 AS equal""")
def set_equality(t: Tables):
    d = F.col("o_orderdate")
    return R.same_ids(t.orders.where(d < F.lit("1997-01-01").cast("timestamp_ntz")), t.orders.where(d >= F.lit("1999-01-01").cast("timestamp_ntz")), "o_custkey")


@query("G01 G02 G10", """SELECT 'order' AS source, epoch_us(o_orderdate) AS us FROM orders WHERE o_totalprice > 450000 UNION ALL
SELECT 'line', epoch_us(l_shipdate) FROM lineitem WHERE l_quantity > 49 UNION ALL SELECT 'event', epoch_us(ts) FROM events WHERE value > 200""")
def union_times(t: Tables):
    one = lambda df, name, c: df.select(F.lit(name).alias("source"), C.micros(F.col(c)).alias("us"))
    return one(t.orders.where("o_totalprice > 450000"), "order", "o_orderdate").unionByName(
        one(t.lineitem.where("l_quantity > 49"), "line", "l_shipdate")).unionByName(one(t.events.where("value > 200"), "event", "ts"))


@query("G04", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_difference(t: Tables):
    return t.customer.select("c_custkey").subtract(t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")))


@query("G05", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 400000")
def set_intersection(t: Tables):
    return t.orders.where("o_orderstatus = 'F'").select("o_custkey").intersect(t.orders.where("o_totalprice > 400000").select("o_custkey"))


@query("G06", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(t: Tables):
    return t.customer.select(F.col("c_nationkey").alias("k")).unionByName(t.supplier.select(F.col("s_nationkey").alias("k"))).distinct()


@query("G07", "SELECT count(*) = 0 AS subset FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)")
def subset_gate(t: Tables):
    out = R.lacking(t.customer.select(F.col("c_nationkey").alias("n_nationkey")), t.nation, ["n_nationkey"])
    return out.agg((F.count("*") == 0).alias("subset"))
