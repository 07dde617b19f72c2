"""Ordered histories: inventory group E, with replays of I and N."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import time as C
from ..operators import replay
from ..operators import sequence as S
from .base import Tables, query

US = "epoch_us(ts)"


def events(t: Tables):
    return t.events.select("event_id", "user_id", "event_type", "value", C.micros(F.col("ts")).alias("us"))


@query("E01 K01", """WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), w AS (SELECT *, coalesce(lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) + 1, 1) AS expected FROM l)
SELECT l_orderkey, l_linenumber, CAST(expected AS BIGINT) AS expected FROM w WHERE l_linenumber <> expected""")
def contiguous_lines(t: Tables):
    return S.contiguity(t.lineitem.select("l_orderkey", "l_linenumber").distinct(), ["l_orderkey"], "l_linenumber")


@query("E06", """WITH w AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)),
b AS (SELECT l_orderkey, min(k) FILTER (WHERE k <> l_linenumber) AS gap, count(*) AS n FROM w GROUP BY 1) SELECT l_orderkey, coalesce(gap - 1, n) AS held FROM b WHERE coalesce(gap - 1, n) > 0""")
def attempt_prefix(t: Tables):
    rows = S.valid_prefix(t.lineitem.select("l_orderkey", "l_linenumber").distinct(), ["l_orderkey"], "l_linenumber")
    return rows.groupBy("l_orderkey").agg(F.count("*").alias("held"))


@query("E07 I15", """WITH w AS (SELECT conv_id, turn, coalesce(lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) + 1, 0) AS expected FROM conversations) SELECT * FROM w WHERE turn <> expected""")
def contiguous_turns(t: Tables):
    return S.contiguity(t.conversations.select("conv_id", "turn"), ["conv_id"], "turn", 0)


@query("E02", """WITH w AS (SELECT conv_id, turn, role, coalesce(lag(CASE WHEN role = 'assistant' THEN 'user' WHEN role = 'user' THEN 'assistant' ELSE 'user' END) OVER (PARTITION BY conv_id ORDER BY turn), 'user') AS expected FROM conversations)
SELECT * FROM w WHERE role <> expected""")
def role_chain(t: Tables):
    rows = t.conversations.select("conv_id", "turn", "role", F.when(F.col("role") == "user", "assistant").otherwise("user").alias("next"))
    return S.chain_breaks(rows, ["conv_id"], "turn", "role", "next", "user").drop("next")


@query("E03 I09 N11", """WITH w AS (SELECT conv_id, turn, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS old, role AS new FROM conversations)
SELECT * FROM w WHERE old IS NOT NULL AND old || '>' || new NOT IN ('system>user', 'user>assistant', 'assistant>user')""")
def illegal_roles(t: Tables):
    rows = t.conversations.select("conv_id", "turn", F.lag("role").over(S.by(["conv_id"], "turn")).alias("old"), F.col("role").alias("new")).where("old IS NOT NULL")
    return S.illegal_steps(rows, "old", "new", [("system", "user"), ("user", "assistant"), ("assistant", "user")])


@query("E04", f"""WITH w AS (SELECT event_id, user_id, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, floor({US} / 86400000000) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done FROM events)
SELECT event_id, user_id FROM w WHERE done = 1""")
def after_terminal(t: Tables):
    rows = events(t).withColumn("day", F.floor(F.col("us") / 86400000000))
    return S.after_terminal(rows, ["user_id", "day"], ["us", "event_id"], F.col("event_type") == "purchase").select("event_id", "user_id")


@query("E05", """WITH w AS (SELECT o_orderkey, o_custkey, o_totalprice, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest FROM orders)
SELECT o_orderkey, highest FROM w WHERE o_totalprice < highest""")
def monotone_running_max(t: Tables):
    return S.epoch_regressions(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice").select("o_orderkey", "highest")


@query("E08 I23", """WITH w AS (SELECT o_custkey, o_orderkey, sha256(o_orderstatus) AS digest, lag(sha256(o_orderstatus)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS old_digest FROM orders)
SELECT o_custkey, o_orderkey, old_digest, digest FROM w WHERE old_digest IS NULL OR old_digest <> digest""")
def change_journal(t: Tables):
    rows = t.orders.select("o_custkey", "o_orderkey", F.sha2("o_orderstatus", 256).alias("digest"))
    return S.changes(rows, ["o_custkey"], ["o_orderkey"], "digest").select("o_custkey", "o_orderkey", "old_digest", "digest")


@query("E26", """SELECT user_id, count(*) FILTER (WHERE event_id > 500 AND value < 20) AS stale, count(*) AS rows FROM (SELECT event_id, user_id, CAST(floor(value) AS BIGINT) AS value FROM events) GROUP BY 1""")
def fence_report(t: Tables):
    rows = t.events.select("event_id", "user_id", F.floor("value").alias("epoch"))
    return S.fenced(rows, ["user_id"], "event_id", "epoch", 500, 20)


@query("E10", f"""SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS index, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) > 1 AS reexecution FROM events""")
def reexecution_rank(t: Tables):
    return S.execution_rank(events(t), ["user_id", "event_type"], ["us", "event_id"]).select("event_id", F.col("index").cast("long").alias("index"), "reexecution")


@query("E11 I25", """SELECT user_id, event_type, min_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2""")
def first_invocation(t: Tables):
    return S.first_of(events(t), ["user_id", "event_type"], ["us", "event_id"], ["event_id"])


@query("E12", """SELECT o_orderkey, greatest(coalesce(f, a, s) - s, 0) AS low, coalesce(f, d) - s AS high FROM (SELECT o_orderkey, epoch_us(o_orderdate) AS s,
(SELECT min(epoch_us(l_shipdate)) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'N') AS f, (SELECT max(epoch_us(l_shipdate)) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A') AS a,
(SELECT max(epoch_us(l_shipdate)) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS d FROM orders)""")
def censored_bounds(t: Tables):
    us, flag = C.micros(F.col("l_shipdate")), F.col("l_returnflag")
    m = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min(F.when(flag == "N", us)).alias("f"), F.max(F.when(flag == "A", us)).alias("a"), F.max(F.when(flag == "R", us)).alias("d"))
    rows = t.orders.join(m, "o_orderkey", "left").withColumn("s", C.micros(F.col("o_orderdate")))
    low, high = S.censored_bounds(F.col("s"), F.col("f"), F.col("d"), F.col("a"))
    return rows.select("o_orderkey", low.alias("low"), high.alias("high"))


@query("E14 E16", f"""SELECT user_id, CAST(max(g) AS BIGINT) AS max_gap, CAST(min(g) AS BIGINT) AS min_gap FROM (SELECT user_id, {US} - lag({US}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events) GROUP BY 1""")
def poll_gaps(t: Tables):
    return S.gaps(events(t), ["user_id"], ["us", "event_id"], "us").groupBy("user_id").agg(F.max("gap").alias("max_gap"), F.min("gap").alias("min_gap"))


@query("E15", f"""WITH w AS (SELECT user_id, {US} - lag({US}) OVER o AS g, coalesce(max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done
FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, max(g) AS max_gap FROM w WHERE done = 0 GROUP BY 1""")
def gap_until_terminal(t: Tables):
    return S.largest_gap_until(events(t), ["user_id"], ["us", "event_id"], "us", F.col("event_type") == "purchase")


@query("E17 E18 E21", f"""WITH f AS (SELECT user_id, min({US}) FILTER (WHERE event_type = 'signup') AS signup, min({US}) FILTER (WHERE event_type = 'view') AS "view", min({US}) FILTER (WHERE event_type = 'purchase') AS purchase FROM events GROUP BY 1)
SELECT user_id, signup, "view", purchase, "view" - signup AS signup_to_view, purchase - "view" AS view_to_purchase FROM f""")
def phase_decomposition(t: Tables):
    return S.phases(events(t), ["user_id"], "event_type", "us", ["signup", "view", "purchase"])


@query("E19 E20 E36", """WITH w AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS former FROM events) SELECT event_id, former FROM w WHERE former IS NOT NULL AND former <> event_type""")
def takeovers(t: Tables):
    return S.takeovers(events(t), ["user_id"], ["us", "event_id"], "event_type").select("event_id", "former")


@query("E22 E23 E36", f"""SELECT e.event_id, (SELECT min(epoch_us(x.ts)) FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'click' AND x.ts > e.ts) - epoch_us(e.ts) AS delay FROM events e WHERE e.event_type = 'error'""")
def recovery_delay(t: Tables):
    e = events(t)
    right = e.where("event_type = 'click'").select("user_id", F.col("us").alias("at"))
    out = S.first_after(e.where("event_type = 'error'"), right, ["user_id"], "us", "at", [])
    return out.select("event_id", (F.col("asof_at") - F.col("us")).alias("delay"))


@query("E24", """WITH w AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_orderkey, CAST(CASE WHEN i >= (3 * n) // 4 THEN 3 WHEN i >= (2 * n) // 4 THEN 2 WHEN i >= n // 4 THEN 1 ELSE 0 END AS INTEGER) AS slice FROM w""")
def slices(t: Tables):
    return S.slices(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], 4).select("o_orderkey", "slice")


@query("E25", """WITH w AS (SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT p_brand, p_partkey, p_retailprice FROM w WHERE k = ceil(0.9 * n)""")
def arg_percentile(t: Tables):
    return S.arg_percentile(t.part.select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], "p_retailprice", "p_partkey", 0.9)


@query("E27 I05", """WITH b AS (SELECT user_id % 8 AS part, event_id // 16 AS off FROM events), d AS (SELECT DISTINCT part, off FROM b WHERE off >= part), w AS (SELECT part, off, off - part - (row_number() OVER (PARTITION BY part ORDER BY off) - 1) AS run FROM d),
n AS (SELECT part, count(*) FILTER (WHERE run = 0) AS n FROM w GROUP BY 1) SELECT p.part, p.part + coalesce(n.n, 0) AS next_offset FROM (SELECT DISTINCT part FROM b) p LEFT JOIN n USING (part)""")
def offset_watermark(t: Tables):
    rows = t.events.select((F.col("user_id") % 8).alias("part"), F.expr("event_id div 16").alias("off"))
    return S.watermark(rows, ["part"], "off", F.col("part"))


@query("E28 K07 K31", """WITH d AS (SELECT DISTINCT user_id, event_id // 4 AS off FROM events), w AS (SELECT *, off - row_number() OVER (PARTITION BY user_id ORDER BY off) AS g FROM d)
SELECT user_id, min(off) AS first, max(off) AS last, count(*) AS size FROM w GROUP BY user_id, g""")
def islands(t: Tables):
    return S.islands(t.events.select("user_id", F.expr("event_id div 4").alias("off")), ["user_id"], "off")


@query("E29", f"""SELECT event_id, abs({US} - (1704067200000000 + (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * 12960000000)) <= 86400000000 AS on_time FROM events""")
def arrival_schedule(t: Tables):
    k = F.row_number().over(S.by(["user_id"], "us", "event_id")) - 1
    return events(t).withColumn("k", k).select("event_id", (F.abs(F.col("us") - (F.lit(1704067200000000) + F.col("k") * F.lit(12960000000))) <= 86400000000).alias("on_time"))


@query("E31", """WITH m AS (SELECT user_id, count(*) / 720.0 AS rate, avg(value) FILTER (WHERE event_id < 300) AS a, avg(value) FILTER (WHERE event_id > 600) AS b, count(*) FILTER (WHERE event_type = 'error') AS backlog FROM events GROUP BY 1)
SELECT user_id, coalesce(rate < 0.95 * 0.1, false) AS throughput, backlog > 0 AS backlog, coalesce(b > 1.5 * a, false) AS drift FROM m""")
def saturation(t: Tables):
    from ..operators import stats

    m = t.events.groupBy("user_id").agg((F.count("*") / 720.0).alias("rate"), F.avg(F.when(F.col("event_id") < 300, F.col("value"))).alias("a"),
                                        F.avg(F.when(F.col("event_id") > 600, F.col("value"))).alias("b"), F.count_if(F.col("event_type") == "error").alias("n"))
    m = m.withColumn("t", stats.triggers(F.col("rate"), F.lit(0.1), F.col("n"), F.col("a"), F.col("b")))
    return m.select("user_id", *(F.array_contains("t", n).alias(n) for n in ("throughput", "backlog", "drift")))


@query("E32 I25", f"""SELECT user_id, min({US}) AS us FROM events WHERE event_type = 'purchase' GROUP BY 1""")
def terminal_series(t: Tables):
    return S.first_terminal(events(t), ["user_id"], ["us", "event_id"], F.col("event_type") == "purchase").select("user_id", "us")


@query("E35 E37 K24", """SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1 HAVING count(*) <> 2 OR max_by(role, -turn) <> 'user' OR max_by(role, turn) <> 'assistant'""")
def exact_sequence(t: Tables):
    return S.exact_sequence(t.conversations, ["conv_id"], ["turn"], "role", ["user", "assistant"]).select("conv_id", "n")


@query("I03", """SELECT event_id, CASE WHEN row_number() OVER w = 1 THEN 'ACCEPTED' WHEN event_type = first_value(event_type) OVER w THEN 'REPEATED' ELSE 'CONFLICT' END AS outcome FROM events
WINDOW w AS (PARTITION BY user_id, floor(epoch_us(ts) / 3600000000) ORDER BY ts, event_id)""")
def dedup_first(t: Tables):
    rows = events(t).withColumn("hour", F.floor(F.col("us") / 3600000000))
    return replay.submit_once(rows, ["user_id", "hour"], ["us", "event_id"], "event_type").select("event_id", "outcome")


@query("I11", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'REDISPATCH' WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN 'RECONCILE'
WHEN o_orderstatus = 'O' AND o_orderkey % 5 < 3 THEN 'REPLACE' WHEN o_orderstatus = 'O' THEN 'FAIL' ELSE 'IGNORE' END AS outcome FROM orders""")
def timeout_classes(t: Tables):
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "DISPATCHABLE").when(F.col("o_orderstatus") == "O", "CLAIMED").otherwise("SUCCEEDED").alias("state"),
                           F.when(F.col("o_orderpriority") == "1-URGENT", "EXTERNAL").otherwise("PURE").alias("effect_class"), (F.col("o_orderkey") % 5).alias("retries_used"), F.lit(3).alias("budget"))
    return rows.select("o_orderkey", replay.timeout_class().alias("outcome"))


@query("I20", """SELECT coalesce(n.k, o.k) AS k, coalesce(n.v, o.v) AS v FROM (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_acctbal < 5000) o
FULL JOIN (SELECT c_custkey AS k, 'NEW' AS v FROM customer WHERE c_acctbal > 2000) n ON o.k = n.k""")
def upsert(t: Tables):
    from ..operators.relational import upsert as merge

    c = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"), "c_acctbal")
    return merge(c.where("c_acctbal < 5000").drop("c_acctbal"), c.where("c_acctbal > 2000").select("k", F.lit("NEW").alias("v")), ["k"])


@query("N01", """SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 200000)""")
def insert_if_absent(t: Tables):
    from ..operators.relational import insert_if_absent as insert

    o = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    return insert(o.where("o_totalprice > 200000"), o.where("o_orderstatus = 'O'"), ["o_orderkey"], "o_orderstatus")[0].select("o_orderkey")


@query("I29", """SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'error') WHERE k <= 100""")
def pending_drain(t: Tables):
    from ..operators.relational import top_per_group

    return top_per_group(events(t).where("event_type = 'error'"), ["user_id"], [F.asc("us"), F.asc("event_id")], 100).select("user_id", "event_id")


@query("I16", """WITH RECURSIVE e AS (SELECT n_nationkey::VARCHAR AS src, (n_nationkey + 5)::VARCHAR AS dst FROM nation WHERE n_nationkey + 5 < 25), w AS (SELECT '0' AS node, 0 AS depth UNION ALL SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node)
SELECT node, min(depth) AS depth FROM w GROUP BY 1""")
def reachable_nodes(t: Tables):
    from ..operators.relational import reachable

    n = F.col("n_nationkey")
    t.nation.where("n_nationkey + 5 < 25").select(n.cast("string").alias("src"), (n + 5).cast("string").alias("dst")).createOrReplaceTempView("strataq_edges")
    return reachable(t.spark, "strataq_edges", "0")
