"""Aggregates: inventory group D."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import time as C
from ..operators import relational as R
from ..operators import sequence as S
from ..operators import stats
from .base import Tables, query

NIBBLE = "CAST(position(substr(sha256({0}), 16, 1) IN '0123456789abcdef') - 1 AS INTEGER)"


@query("G01 H01", f"""WITH p AS (SELECT c_custkey, {NIBBLE.format('c_name')} AS part FROM customer),
o AS (SELECT CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE part END AS part, epoch_us(o_orderdate) AS us, o_orderstatus AS st FROM orders JOIN p ON o_custkey = c_custkey),
s AS (SELECT part, us, st = 'P' AS pending, 'outbox' AS src FROM o WHERE st IN ('P', 'F') UNION ALL SELECT part, us, true, 'wakeups' FROM o WHERE st = 'O')
SELECT q.part AS partition_id, count(*) FILTER (WHERE src = 'outbox' AND pending) AS outbox, count(*) FILTER (WHERE src = 'wakeups' AND pending) AS wakeups,
greatest((1009843200000000 - min(us)) / 1000000.0, 0) AS oldest_age FROM (SELECT DISTINCT part FROM s WHERE part IS NOT NULL) q JOIN s ON s.part = q.part OR s.part IS NULL GROUP BY 1""")
def backlog_by_partition(t: Tables):
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), H.partition_of(F.col("c_name")).alias("part"))
    o = t.orders.join(c, "o_custkey").select(F.when(F.col("o_orderkey") % 11 != 0, F.col("part")).alias("part"), C.micros(F.col("o_orderdate")).alias("us"), "o_orderstatus")
    return R.backlog({"outbox": o.where("o_orderstatus IN ('P', 'F')").withColumn("pending", F.col("o_orderstatus") == "P"),
                      "wakeups": o.where("o_orderstatus = 'O'").withColumn("pending", F.lit(True))}, "part", "us", 1009843200000000)


@query("D01", "SELECT count(*) AS n FROM events WHERE event_type = 'error'")
def filtered_count(t: Tables):
    return t.events.where("event_type = 'error'").agg(F.count("*").alias("n"))


@query("D04 D13", "SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS terminal, count(*) FILTER (WHERE o_orderstatus <> 'F') AS live FROM orders GROUP BY 1")
def terminal_counts(t: Tables):
    return t.orders.groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("terminal"), F.count_if(F.col("o_orderstatus") != "F").alias("live"))


@query("D06 D12 I21", """SELECT o_custkey, count(*) AS n, count(*) > 12 AS over_limit, NOT (count(*) >= 12 OR count(*) FILTER (WHERE o_orderstatus = 'P') >= 6) AS admits FROM orders GROUP BY 1""")
def limit_gates(t: Tables):
    out = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "P").alias("p"))
    return out.select("o_custkey", "n", R.over_limit(F.col("n"), 12).alias("over_limit"), R.admits(F.col("n"), F.col("p"), 12, 6).alias("admits"))


@query("D07", "SELECT coalesce(CAST(sum(n - 1) AS BIGINT), 0) AS duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def duplicate_calls(t: Tables):
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))


@query("D08 D09", "SELECT user_id, event_type, count(*) AS n, min(event_id) AS low, max(event_id) AS high FROM events GROUP BY 1, 2")
def owner_summary(t: Tables):
    return t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("low"), F.max("event_id").alias("high"))


@query("D11", "SELECT c_custkey, coalesce(max(o_orderkey), 0) + 1 AS next FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def next_number(t: Tables):
    m = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("m"))
    return t.customer.select("c_custkey").join(m, "c_custkey", "left").select("c_custkey", (F.coalesce("m", F.lit(0)) + 1).alias("next"))


@query("D14", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def distinct_rows(t: Tables):
    return t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query("D15 K02", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicates(t: Tables):
    return R.duplicates(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("D16 K38", "SELECT p_name, count(DISTINCT p_brand || '/' || p_type) AS identities FROM part GROUP BY 1 HAVING count(DISTINCT p_brand || '/' || p_type) > 1")
def key_identity_conflict(t: Tables):
    return R.conflicting(t.part, ["p_name"], ["p_brand", "p_type"])


@query("D18 D20 D21", """SELECT user_id % 4 AS role, event_type, count(*) AS n, count(*) FILTER (WHERE value > 100) AS errors FROM events GROUP BY 1, 2""")
def role_errors(t: Tables):
    return t.events.groupBy((F.col("user_id") % 4).alias("role"), "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 100).alias("errors"))


@query("D19", """SELECT event_type, count(*) AS offered, round(count(*) / 720.0, 9) AS per_hour, round(count(*) FILTER (WHERE value <= 50) / count(*)::DOUBLE, 9) AS accepted FROM events GROUP BY 1""")
def outcome_rates(t: Tables):
    n = F.count("*")
    return t.events.groupBy("event_type").agg(n.alias("offered"), F.round(n / F.lit(720.0), 9).alias("per_hour"), F.round(F.count_if(F.col("value") <= 50) / n, 9).alias("accepted"))


@query("D22 D33 D34", """SELECT user_id, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, CAST(sum(greatest(60, CAST(ceil(value) AS BIGINT))) AS BIGINT) AS billable FROM events GROUP BY 1""")
def ledger_sum(t: Tables):
    return t.events.groupBy("user_id").agg(stats.exact_sum("value", 2).cast("double").alias("total"), F.sum(stats.billable_seconds(F.col("value"))).alias("billable"))


@query("D23 D24 D39", """SELECT l_suppkey, CAST(sum(greatest(least(epoch_us(l_shipdate) + 86400000000 * l_linenumber, 946684800000000) - greatest(epoch_us(l_shipdate), 852076800000000), 0)) AS BIGINT) AS busy_us
FROM lineitem GROUP BY 1""")
def busy_seconds(t: Tables):
    s = C.micros(F.col("l_shipdate"))
    return t.lineitem.groupBy("l_suppkey").agg(F.sum(S.clipped_seconds(s, s + F.lit(86400000000) * F.col("l_linenumber"), 852076800000000, 946684800000000)).alias("busy_us"))


@query("D26", """SELECT l_returnflag, count(*) AS n, quantile_disc(l_quantity, 0.5) AS p50, quantile_disc(l_quantity, 0.95) AS p95,
array_to_string(list_sort(list_distinct(list(l_linestatus))), ',') AS hosts FROM lineitem GROUP BY 1""")
def block_summary(t: Tables):
    return t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("n"), stats.nearest_rank("l_quantity", 0.5).alias("p50"), stats.nearest_rank("l_quantity", 0.95).alias("p95"),
                                                  F.array_join(F.array_sort(F.collect_set("l_linestatus")), ",").alias("hosts"))


@query("D28", """SELECT lang, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS safe, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS correct,
count(*) FILTER (WHERE quality = 0) AS abstained FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def primary_summary(t: Tables):
    q, x = F.col("quality"), F.col("toxic")
    return t.documents.select("doc_id", "lang").join(t.labels, "doc_id").groupBy("lang").agg(
        F.count("*").alias("n"), F.count_if(q == 1).alias("safe"), F.count_if((q == 1) & (x == 0)).alias("correct"), F.count_if(q == 0).alias("abstained"))


@query("D31", "SELECT p_brand, round((max(p_retailprice) - min(p_retailprice)) / median(p_retailprice) * 100, 6) AS spread FROM part GROUP BY 1")
def profile_spread(t: Tables):
    return t.part.groupBy("p_brand").agg(F.round(stats.spread_percent("p_retailprice"), 6).alias("spread"))


@query("D32 D36 D37", """SELECT l_linenumber, count(*) AS n, min(epoch_us(l_shipdate) - epoch_us(o_orderdate)) AS low, CAST(median(epoch_us(l_shipdate) - epoch_us(o_orderdate)) AS DOUBLE) AS mid,
max(epoch_us(l_shipdate) - epoch_us(o_orderdate)) AS high FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""")
def stage_timings(t: Tables):
    d = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_linenumber", (C.micros(F.col("l_shipdate")) - C.micros(F.col("o_orderdate"))).alias("d"))
    return d.groupBy("l_linenumber").agg(F.count("*").alias("n"), F.min("d").alias("low"), F.median("d").alias("mid"), F.max("d").alias("high"))


@query("D35 D40 D41", """SELECT o_orderstatus, len_, count(*) AS orders FROM (SELECT o_orderkey, o_orderstatus, count(l_orderkey) AS len_ FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2) GROUP BY 1, 2""")
def list_sizes(t: Tables):
    n = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return t.orders.join(n, "o_orderkey", "left").select("o_orderstatus", F.coalesce("n", F.lit(0)).alias("len_")).groupBy("o_orderstatus", "len_").agg(F.count("*").alias("orders"))


@query("D44", """SELECT event_id, CAST(sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS DOUBLE) AS spent, sum(c) OVER (PARTITION BY user_id ORDER BY event_id) <= 0.05 AS within FROM
(SELECT event_id, user_id, CAST((event_id * 3.0 + user_id * 15.0) / 1000000 AS DECIMAL(18,8)) AS c FROM events)""")
def spend_ledger(t: Tables):
    cost = stats.token_cost(F.col("event_id"), F.col("user_id"), "3.0", "15.0").cast("decimal(18,8)")
    out = R.running_cap(t.events, "user_id", "event_id", cost, 0.05)
    return out.select("event_id", F.col("spent").cast("double").alias("spent"), "within")


@query("2.O", """SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)""")
def ext_rollup(t: Tables):
    return t.orders.rollup("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


@query("2.O I28", """SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def ext_windows(t: Tables):
    return t.events.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n")).select(
        C.micros(F.col("w.start")).alias("start_us"), "event_type", "n")
