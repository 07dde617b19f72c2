"""State changes, written as versions and read again, and folds against recursive SQL: inventory groups I and N."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import time as C
from ..operators import changes as N
from ..operators import relational as R
from ..operators import replay
from ..operators import sequence as S
from ..sources import sinks
from ..sources.store import Versions
from ..streaming import ops
from .base import Tables, query
from .sequences import events
from .streams import drained, place, replayed


def stored(t: Tables, state, change):
    """The version that a change makes of a state: both are written."""
    table = Versions(t.spark, f"{place(t)}/table")
    table.commit(state, 0)
    return table.change(change)


def union(*frames):
    return reduce(lambda a, b: a.unionByName(b), frames)


@query("N01", "WITH s AS (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_acctbal < 5000) SELECT * FROM s UNION ALL SELECT c_custkey, 'NEW' FROM customer WHERE c_acctbal > 2000 AND c_custkey NOT IN (SELECT k FROM s)")
def insert_once(t: Tables):
    c = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"), "c_acctbal")
    batch = c.where("c_acctbal > 2000").select("k", F.lit("NEW").alias("v"))
    return stored(t, c.where("c_acctbal < 5000").drop("c_acctbal"), lambda s: N.insert_once(s, batch.unionByName(batch), ["k"]))


@query("N02", """WITH s AS (SELECT c_custkey AS k, c_mktsegment AS d FROM customer WHERE c_custkey % 3 = 0), b AS (SELECT o_custkey AS k, o_orderkey AS o, CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority ELSE c_mktsegment END AS d FROM orders JOIN customer ON o_custkey = c_custkey),
r AS (SELECT b.*, s.d AS held, row_number() OVER (PARTITION BY b.k ORDER BY o) AS i, first_value(b.d) OVER (PARTITION BY b.k ORDER BY o) AS f FROM b LEFT JOIN s USING (k)), x AS (SELECT *, CASE WHEN held IS NULL AND i = 1 THEN 'ACCEPTED' WHEN d = coalesce(held, f) THEN 'REPEATED' ELSE 'CONFLICT' END AS outcome FROM r)
SELECT outcome, count(*) AS n FROM x GROUP BY 1 UNION ALL SELECT 'HELD', (SELECT count(*) FROM s) + (SELECT count(*) FROM x WHERE outcome = 'ACCEPTED')""")
def idempotent_submit(t: Tables):
    c = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("d"))
    batch = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("o"), "o_orderpriority").join(c, "k").select(
        "k", "o", F.when(F.col("o") % 4 == 0, F.col("o_orderpriority")).otherwise(F.col("d")).alias("d"))
    held = c.where("k % 3 = 0")
    done = N.submit(held, batch, ["k"], "o", "d")
    after = stored(t, held, lambda s: s.unionByName(done.where("outcome = 'ACCEPTED'").select("k", "d")))
    return done.groupBy("outcome").agg(F.count("*").alias("n")).unionByName(after.agg(F.lit("HELD").alias("outcome"), F.count("*").alias("n")))


@query("N03", """WITH a AS (SELECT l_orderkey AS k, l_linenumber AS number, l_linestatus = 'O' AS cur FROM lineitem), q AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'P'),
s AS (SELECT k, number, cur AND k NOT IN (SELECT k FROM q) AS cur FROM a UNION ALL SELECT k, coalesce((SELECT max(number) FROM a WHERE a.k = q.k), 0) + 1, true FROM q)
SELECT k, count(*) AS attempts, CAST(max(number) AS BIGINT) AS top, count(*) FILTER (WHERE cur) AS current FROM s GROUP BY 1""")
def new_attempts(t: Tables):
    a = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("number"), (F.col("l_linestatus") == "O").alias("is_current"))
    asked = t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("k"))
    after = stored(t, a, lambda s: N.create_attempts(s, asked, ["k"]))
    return after.groupBy("k").agg(F.count("*").alias("attempts"), F.max("number").alias("top"), F.count_if("is_current").alias("current"))


@query("N04", """WITH s AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 <> 0 THEN (c_custkey % 3)::VARCHAR END AS held FROM customer WHERE c_custkey % 7 <> 0), b AS (SELECT o_custkey AS k, o_orderkey AS o, (o_orderkey % 3)::VARCHAR AS q FROM orders),
r AS (SELECT b.*, s.k IS NOT NULL AS there, held, row_number() OVER w AS i, first_value(q) OVER w AS f FROM b LEFT JOIN s USING (k) WINDOW w AS (PARTITION BY b.k ORDER BY o)), x AS (SELECT *, CASE WHEN NOT there THEN 'NO_ATTEMPT' WHEN held IS NULL AND i = 1 THEN 'CLAIMED' WHEN q = coalesce(held, f) THEN 'REPEATED' ELSE 'CONFLICT' END AS outcome FROM r)
SELECT outcome, count(*) AS n FROM x GROUP BY 1 UNION ALL SELECT 'HELD', (SELECT count(held) FROM s) + (SELECT count(*) FROM x WHERE outcome = 'CLAIMED')""")
def claims(t: Tables):
    k = F.col("c_custkey")
    s = t.customer.where("c_custkey % 7 <> 0").select(k.alias("k"), F.when(k % 4 != 0, (k % 3).cast("string")).alias("request_id"))
    asked = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("o"), (F.col("o_orderkey") % 3).cast("string").alias("request_id"))
    done = N.claim(s, asked, ["k"], "o")
    won = done.where("outcome = 'CLAIMED'").select("k", "request_id")
    after = stored(t, s, lambda x: R.upsert(x, won, ["k"]))
    return done.groupBy("outcome").agg(F.count("*").alias("n")).unionByName(after.agg(F.lit("HELD").alias("outcome"), F.count("request_id").alias("n")))


@query("N05", """WITH s AS (SELECT c_custkey AS k, c_custkey % 3 AS owner, 100 * (c_custkey % 50) AS deadline, c_custkey % 5 <> 0 AS cur FROM customer)
SELECT k, greatest(deadline, coalesce((SELECT max(o_orderkey % 6000) + 1000 FROM orders WHERE o_custkey = k AND cur AND o_orderkey % 3 = owner AND o_orderkey % 6000 < deadline), 0)) AS deadline FROM s""")
def heartbeats(t: Tables):
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    s = t.customer.select(k.alias("k"), (k % 3).alias("owner"), (100 * (k % 50)).alias("deadline"), (k % 5 != 0).alias("is_current"))
    beats = t.orders.select(F.col("o_custkey").alias("k"), (o % 3).alias("owner"), (o % 6000).alias("at"))
    return stored(t, s, lambda x: N.heartbeat(x, beats, ["k"], 1000)).select("k", "deadline")


@query("N06", """WITH s AS (SELECT c_custkey AS k, c_custkey % 3 AS held FROM customer WHERE c_custkey % 2 = 0), r AS (SELECT o_custkey AS k, o_orderkey % 3 AS x, held, row_number() OVER w AS i, first_value(o_orderkey % 3) OVER w AS f FROM orders LEFT JOIN s ON k = o_custkey WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
x AS (SELECT CASE WHEN held IS NULL AND i = 1 THEN 'RECORDED' WHEN x = coalesce(held, f) THEN 'REPEATED' ELSE 'CONFLICT' END AS outcome FROM r)
SELECT outcome, count(*) AS n FROM x GROUP BY 1 UNION ALL SELECT 'HELD', (SELECT count(*) FROM s) + (SELECT count(*) FROM x WHERE outcome = 'RECORDED')""")
def result_receipts(t: Tables):
    s = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.format_string('{"a": 1, "b": %d}', F.col("c_custkey") % 3).alias("body"))
    results = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("o"), F.format_string('{"b":%d,"a":1}', F.col("o_orderkey") % 3).alias("body"))
    done = N.record_results(s, results, ["k"], "o", "body")
    after = stored(t, s, lambda x: x.unionByName(done.where("outcome = 'RECORDED'").select("k", "body")))
    return done.groupBy("outcome").agg(F.count("*").alias("n")).unionByName(after.agg(F.lit("HELD").alias("outcome"), F.count("*").alias("n")))


OUTBOX = "SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'CLAIMED' WHEN 'O' THEN 'PENDING' ELSE 'PUBLISHED' END AS publish_state FROM orders"


def outbox(t: Tables):
    s = F.col("o_orderstatus")
    return t.orders.select(F.col("o_orderkey").alias("k"), F.when(s == "F", "CLAIMED").when(s == "O", "PENDING").otherwise("PUBLISHED").alias("publish_state"), F.lit(0).alias("tries"))


@query("N07", f"""WITH o AS ({OUTBOX}), x AS (SELECT publish_state AS p, publish_state = 'CLAIMED' AND k % 3 <> 0 AS mine, k % 5 <> 0 AS ok FROM o)
SELECT CASE WHEN mine AND ok THEN 'PUBLISHED' WHEN mine THEN 'PENDING' ELSE p END AS publish_state, CAST(mine AND NOT ok AS INTEGER) AS tries, count(*) AS n FROM x GROUP BY 1, 2""")
def publications(t: Tables):
    o = outbox(t)
    sent = o.where("k % 3 <> 0").select("k", (F.col("k") % 5 != 0).alias("delivered"))
    return stored(t, o, lambda s: N.finalize(s, sent, ["k"])).groupBy("publish_state", "tries").agg(F.count("*").alias("n"))


@query("N08", f"""WITH o AS ({OUTBOX}), x AS (SELECT k, CASE WHEN k % 9 = 0 AND publish_state <> 'PUBLISHED' THEN 'QUARANTINED' ELSE publish_state END AS s FROM o), i AS (SELECT k, 'RESOLVED' AS s FROM o WHERE k % 18 = 0),
j AS (SELECT * FROM i UNION ALL SELECT k, 'OPEN' FROM x WHERE s = 'QUARANTINED' AND k NOT IN (SELECT k FROM i)) SELECT 'outbox' AS side, s AS state, count(*) AS n FROM x GROUP BY 2 UNION ALL SELECT 'items', s, count(*) FROM j GROUP BY 2""")
def quarantined(t: Tables):
    o = outbox(t)
    poison = o.where("k % 9 = 0").select("k")
    items = o.where("k % 18 = 0").select(F.lit("POISON_RECORD").alias("kind"), F.concat(F.lit("outbox/"), F.col("k").cast("string")).alias("reference"), F.lit("RESOLVED").alias("status"))
    one = stored(t, o, lambda s: N.quarantine(s, poison, ["k"], items)[0])
    two = stored(t, items, lambda s: N.quarantine(o, poison, ["k"], s)[1])
    count = lambda df, side, c: df.groupBy(F.col(c).alias("state")).agg(F.count("*").alias("n")).withColumn("side", F.lit(side))
    return count(one, "outbox", "publish_state").unionByName(count(two, "items", "status"))


@query("N09", """WITH i AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'OPEN' WHEN 'O' THEN 'RESOLVED' ELSE 'ABANDONED' END AS s FROM orders)
SELECT CASE WHEN s = 'OPEN' AND k % 6 = 0 THEN 'RESOLVED' WHEN s = 'OPEN' AND k % 6 = 2 THEN 'ABANDONED' ELSE s END AS status, count(*) AS n FROM i GROUP BY 1""")
def resolved_items(t: Tables):
    s, k = F.col("o_orderstatus"), F.col("k")
    items = t.orders.select(F.col("o_orderkey").alias("k"), F.when(s == "F", "OPEN").when(s == "O", "RESOLVED").otherwise("ABANDONED").alias("status"))
    decided = items.where("k % 2 = 0").select("k", F.when(k % 6 == 0, "RESOLVED").when(k % 6 == 2, "ABANDONED").otherwise("OTHER").alias("decision"))
    return stored(t, items, lambda x: N.resolve(x, decided, ["k"])).groupBy("status").agg(F.count("*").alias("n"))


@query("N10", """WITH i AS (SELECT o_orderkey AS k, o_orderpriority AS target, (o_custkey % 5)::VARCHAR AS rev, sha256(o_orderpriority || chr(0) || o_orderstatus || chr(0) || (o_custkey % 5)::VARCHAR) AS d, CASE WHEN o_orderstatus = 'F' THEN 'REJECTED' ELSE 'PENDING' END AS s FROM orders),
x AS (SELECT *, s = 'PENDING' AND k % 2 = 0 AND k % 6 <> 0 AS fits FROM i)
SELECT CASE WHEN fits AND k % 4 = 0 THEN 'APPROVED' WHEN fits THEN 'REJECTED' ELSE s END AS decision, CASE WHEN fits AND k % 4 = 0 THEN 'GRANTED' ELSE 'NOT_GRANTED' END AS dispatch, count(*) AS n, max(CASE WHEN fits AND k % 4 = 0 THEN sha256(d || chr(0) || rev || chr(0) || target) END) AS scope FROM x GROUP BY 1, 2""")
def approvals(t: Tables):
    from ..functions.hashing import joined_digest

    k = F.col("k")
    i = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("target"), F.col("o_orderstatus").alias("arguments"), (F.col("o_custkey") % 5).cast("string").alias("revision"),
                        F.when(F.col("o_orderstatus") == "F", "REJECTED").otherwise("PENDING").alias("decision"), F.lit("NOT_GRANTED").alias("dispatch"), F.lit(None).cast("string").alias("grant_scope"))
    decided = i.where("k % 2 = 0").select("k", F.when(k % 4 == 0, "APPROVED").otherwise("REJECTED").alias("decision"),
                                          F.when(k % 6 == 0, F.lit("other")).otherwise(joined_digest(F.col("target"), F.col("arguments"), F.col("revision"))).alias("proposal"))
    return stored(t, i, lambda s: N.decide(s, decided, ["k"])).groupBy("decision", "dispatch").agg(F.count("*").alias("n"), F.max("grant_scope").alias("scope"))


@query("N11", """WITH p AS (SELECT c_custkey AS k, c_mktsegment = 'BUILDING' AS done FROM customer), g AS (SELECT k FROM p WHERE k % 3 = 0 AND NOT done)
SELECT 'parent' AS side, CASE WHEN k IN (SELECT k FROM g) THEN 'CANCELED' WHEN done THEN 'SUCCEEDED' ELSE 'RUNNABLE' END AS state, count(*) AS n FROM p GROUP BY 2
UNION ALL SELECT 'child', CASE WHEN o_orderstatus = 'F' THEN 'SUCCEEDED' WHEN o_custkey IN (SELECT k FROM g) THEN 'CANCELED' ELSE 'RUNNABLE' END, count(*) FROM orders GROUP BY 2""")
def cancellations(t: Tables):
    from ..operators.invariants import TERMINAL

    p = t.customer.select(F.col("c_custkey").alias("k"), F.when(F.col("c_mktsegment") == "BUILDING", "SUCCEEDED").otherwise("RUNNABLE").alias("state"))
    c = t.orders.select(F.col("o_custkey").alias("k"), F.when(F.col("o_orderstatus") == "F", "SUCCEEDED").otherwise("RUNNABLE").alias("state"))
    asked = p.where("k % 3 = 0").select("k")
    one, two = stored(t, p, lambda s: N.cancel(s, c, asked, "k", TERMINAL)[0]), stored(t, c, lambda s: N.cancel(p, s, asked, "k", TERMINAL)[1])
    count = lambda df, side: df.groupBy("state").agg(F.count("*").alias("n")).withColumn("side", F.lit(side))
    return count(one, "parent").unionByName(count(two, "child"))


@query("N13", """WITH e AS (SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'O' THEN 'OUTCOME_UNKNOWN' ELSE 'APPLIED' END AS o FROM orders), x AS (SELECT k, o, CASE WHEN o = 'OUTCOME_UNKNOWN' AND k % 4 = 0 THEN 'APPLIED' WHEN o = 'OUTCOME_UNKNOWN' AND k % 4 = 2 THEN 'ABANDONED' ELSE o END AS s FROM e)
SELECT 'effect' AS side, s AS outcome, count(*) AS n FROM x GROUP BY 2 UNION ALL SELECT 'audit', s, count(*) FROM x WHERE o <> s GROUP BY 2""")
def unknown_effects(t: Tables):
    k = F.col("k")
    e = t.orders.select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderstatus") == "O", "OUTCOME_UNKNOWN").otherwise("APPLIED").alias("outcome"))
    found = e.where("k % 2 = 0 OR k % 8 = 1").select("k", F.when(k % 4 == 0, True).when(k % 4 == 2, False).alias("found"))
    none = t.spark.createDataFrame([], "k long, old string, new string").withColumn("k", F.col("k").cast(e.schema["k"].dataType))
    one, two = (stored(t, s, lambda x, i=i: N.resolve_unknown(*((x, found, ["k"], none) if i == 0 else (e, found, ["k"], x)))[i]) for i, s in ((0, e), (1, none)))
    return one.groupBy("outcome").agg(F.count("*").alias("n")).withColumn("side", F.lit("effect")).unionByName(
        two.groupBy(F.col("new").alias("outcome")).agg(F.count("*").alias("n")).withColumn("side", F.lit("audit")))


@query("N14", """WITH s AS (SELECT s_suppkey AS k, s_nationkey AS r, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS fence FROM supplier), q AS (SELECT CASE WHEN c_custkey % 4 = 0 THEN c_custkey ELSE 1000000 + c_custkey END AS k, c_nationkey AS r, -c_custkey AS o FROM customer),
n AS (SELECT k, r, coalesce((SELECT max(fence) FROM s WHERE s.r = q.r), 0) + row_number() OVER (PARTITION BY r ORDER BY o, k) AS fence FROM q WHERE k NOT IN (SELECT k FROM s)) SELECT * FROM s UNION ALL SELECT * FROM n""")
def sink_fences(t: Tables):
    s = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("r"), F.row_number().over(S.by(["s_nationkey"], "s_suppkey")).cast("long").alias("fence"))
    c = F.col("c_custkey")
    q = t.customer.select(F.when(c % 4 == 0, c).otherwise(c + 1000000).alias("k"), F.col("c_nationkey").alias("r"), (-c).alias("o"))
    return stored(t, s, lambda x: N.allocate(x, q.unionByName(q), "k", "r", "o"))


@query("N15", """WITH e AS (SELECT user_id AS u, event_type AS y, epoch_us(ts)::HUGEINT * 10000000000 + event_id AS z FROM events WHERE value <= 60), a AS (SELECT u, min(z) AS z FROM e WHERE y = 'signup' GROUP BY 1), b AS (SELECT u, min(e.z) AS z FROM e JOIN a USING (u) WHERE y = 'view' AND e.z > a.z GROUP BY 1),
c AS (SELECT u, min(e.z) AS z FROM e JOIN b USING (u) WHERE y = 'click' AND e.z > b.z GROUP BY 1), d AS (SELECT u, min(e.z) AS z FROM e JOIN c USING (u) WHERE y = 'purchase' AND e.z > c.z GROUP BY 1)
SELECT user_id, CASE WHEN d.z IS NOT NULL THEN 'purchase' WHEN c.z IS NOT NULL THEN 'click' WHEN b.z IS NOT NULL THEN 'view' WHEN a.z IS NOT NULL THEN 'signup' END AS reached FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN a ON a.u = user_id LEFT JOIN b ON b.u = user_id LEFT JOIN c ON c.u = user_id LEFT JOIN d ON d.u = user_id""")
def dispatch_stages(t: Tables):
    return N.staged(events(t), ["user_id"], ["us", "event_id"], "event_type", ["signup", "view", "click", "purchase"], F.col("value") <= 60)


@query("N16", "SELECT CAST(n_regionkey AS INTEGER) AS unit, count(*) AS rows, CASE WHEN n_regionkey < 3 THEN 'first' ELSE 'resumed' END AS run FROM nation GROUP BY 1, 3")
def write_once_units(t: Tables):
    """Units are written once: a second run after an abort writes the missing ones, and leaves the others alone."""
    p = f"{place(t)}/units"
    rows = t.nation.select(F.col("n_regionkey").cast("int").alias("unit"), "n_name")
    sinks.write_units(rows.where("unit < 3").withColumn("run", F.lit("first")), p, "unit")
    sinks.write_units(rows.withColumn("run", F.lit("resumed")), p, "unit")
    return t.spark.read.parquet(p).groupBy("unit", "run").agg(F.count("*").alias("rows"))


STEPS = "CASE event_type WHEN 'signup' THEN 'RUNNABLE' WHEN 'view' THEN 'WAITING_ACTIVITY' WHEN 'click' THEN 'WAITING_TIMER' WHEN 'error' THEN 'RECONCILIATION_REQUIRED' ELSE 'SUCCEEDED' END"
MACHINE = """WITH RECURSIVE r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, {steps} AS target, {expected} AS expected FROM events),
f AS (SELECT DISTINCT user_id, 0::BIGINT AS i, 'RUNNABLE' AS st, 0::BIGINT AS rev, 0::BIGINT AS event_id, '' AS target, 0::BIGINT AS expected, '' AS outcome FROM events UNION ALL
SELECT user_id, i, CASE WHEN o = 'APPLIED' THEN target ELSE st END, CASE WHEN o = 'APPLIED' THEN rev + 1 ELSE rev END, event_id, target, expected, o FROM (SELECT r.user_id, r.i, f.st, f.rev, r.event_id, r.target, r.expected,
CASE WHEN f.st = 'SUCCEEDED' THEN 'TERMINAL' WHEN r.expected <> f.rev THEN 'STALE' WHEN f.st || '>' || r.target IN ('RUNNABLE>RUNNABLE', 'RUNNABLE>WAITING_ACTIVITY', 'RUNNABLE>WAITING_TIMER', 'RUNNABLE>SUCCEEDED', 'WAITING_ACTIVITY>WAITING_ACTIVITY',
'WAITING_ACTIVITY>RECONCILIATION_REQUIRED', 'WAITING_TIMER>RUNNABLE', 'RECONCILIATION_REQUIRED>RUNNABLE') THEN 'APPLIED' ELSE 'ILLEGAL' END AS o FROM f JOIN r ON r.user_id = f.user_id AND r.i = f.i + 1))"""


def transitions(t: Tables, *order: str):
    state = F.create_map(*[F.lit(x) for x in ("signup", "RUNNABLE", "view", "WAITING_ACTIVITY", "click", "WAITING_TIMER", "error", "RECONCILIATION_REQUIRED", "purchase", "SUCCEEDED")])
    return events(t).select("user_id", "event_id", state[F.col("event_type")].alias("target"), (F.row_number().over(S.by(["user_id"], *order)) - 1).cast("long").alias("expected"))


@query("I08", MACHINE.format(steps=STEPS, expected="row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1") + " SELECT user_id, event_id, target, expected, outcome FROM f WHERE i > 0")
def state_fold(t: Tables):
    return replay.replay_machine(transitions(t, "us", "event_id"), ["user_id"], ["event_id"])


@query("I09 I22", MACHINE.format(steps=STEPS, expected="row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1") + " SELECT user_id, event_id, outcome FROM f WHERE i > 0")
def stream_fold(t: Tables):
    p = place(t)
    out = ops.stateful_fold(replayed(transitions(t, "event_id"), p), "user_id", "event_id", replay.machine_step(), {"state": "RUNNABLE", "revision": 0},
                            "state string, revision bigint", ["target", "expected"])
    return drained(out, p)


@query("I07", """WITH RECURSIVE r AS (SELECT user_id % 16 AS part, event_id, row_number() OVER (PARTITION BY user_id % 16 ORDER BY event_id) AS i, CASE event_type WHEN 'signup' THEN 'release' WHEN 'view' THEN 'renew' ELSE 'acquire' END AS a, user_id AS owner, epoch_us(ts) AS tm FROM events),
f AS (SELECT DISTINCT part, 0::BIGINT AS i, -1::BIGINT AS who, 0::BIGINT AS till, 0::BIGINT AS epoch, 0::BIGINT AS event_id, '' AS outcome FROM r UNION ALL
SELECT part, i, CASE WHEN o = 'RELEASED' THEN -1 WHEN o LIKE 'EPOCH%' THEN owner ELSE who END, CASE WHEN o = 'RELEASED' THEN 0 WHEN o LIKE 'EPOCH%' OR o = 'RENEWED' THEN tm + 36000000000 ELSE till END, CASE WHEN o LIKE 'EPOCH%' THEN e2 ELSE epoch END, event_id, o FROM (
SELECT *, CASE WHEN a = 'acquire' AND held AND NOT mine THEN 'HELD' WHEN a = 'acquire' THEN 'EPOCH_' || e2 WHEN NOT (held AND mine) THEN 'LOST' WHEN a = 'renew' THEN 'RENEWED' ELSE 'RELEASED' END AS o FROM (
SELECT r.part, r.i, f.who, f.till, f.epoch, r.event_id, r.a, r.owner, r.tm, f.who <> -1 AND r.tm < f.till AS held, f.who = r.owner AS mine, f.epoch + CASE WHEN f.who = r.owner AND r.tm < f.till THEN 0 ELSE 1 END AS e2 FROM f JOIN r ON r.part = f.part AND r.i = f.i + 1)))
SELECT part, event_id, outcome FROM f WHERE i > 0""")
def lease_fold(t: Tables):
    kind = F.col("event_type")
    rows = events(t).select((F.col("user_id") % 16).alias("part"), "event_id", F.when(kind == "signup", "release").when(kind == "view", "renew").otherwise("acquire").alias("action"),
                            F.col("user_id").cast("string").alias("owner"), F.col("us").alias("at"), F.lit(36000000000).alias("ttl"))
    return replay.replay_leases(rows, ["part"], ["event_id"]).select("part", "event_id", "outcome")


ATTEMPTS = """WITH RECURSIVE r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, CASE event_type WHEN 'signup' THEN 'create' WHEN 'view' THEN 'claim' WHEN 'click' THEN 'heartbeat' WHEN 'error' THEN 'timeout' ELSE 'result' END AS a, event_id % 3 AS q FROM events),
f AS (SELECT DISTINCT user_id, 0::BIGINT AS i, false AS cur, -1::BIGINT AS own, 0::BIGINT AS num, false AS fin, 0::BIGINT AS event_id, '' AS a, '' AS outcome FROM events UNION ALL
SELECT user_id, i, CASE WHEN o LIKE 'ATTEMPT%' THEN true WHEN o IN ('TIMED_OUT', 'SUCCEEDED') THEN false ELSE cur END, CASE WHEN o LIKE 'ATTEMPT%' OR o = 'TIMED_OUT' THEN -1 WHEN o = 'CLAIMED' THEN q ELSE own END, CASE WHEN o LIKE 'ATTEMPT%' THEN num + 1 ELSE num END, fin OR o = 'SUCCEEDED', event_id, a, o FROM (
SELECT r.user_id, r.i, f.cur, f.own, f.num, f.fin, r.event_id, r.a, r.q, CASE WHEN f.fin AND r.a = 'result' THEN 'LATE_EVIDENCE' WHEN f.fin THEN 'TERMINAL' WHEN r.a = 'create' AND f.cur THEN 'CURRENT_EXISTS' WHEN r.a = 'create' AND f.num > 3 THEN 'BUDGET_SPENT' WHEN r.a = 'create' THEN 'ATTEMPT_' || (f.num + 1)
WHEN NOT f.cur THEN 'NO_ATTEMPT' WHEN r.a = 'claim' AND f.own = -1 THEN 'CLAIMED' WHEN r.a = 'claim' AND f.own = r.q THEN 'CLAIM_REPEATED' WHEN r.a = 'claim' THEN 'CLAIM_CONFLICT' WHEN r.a = 'timeout' THEN 'TIMED_OUT' WHEN f.own <> r.q THEN 'NOT_OWNER' WHEN r.a = 'heartbeat' THEN 'EXTENDED' ELSE 'SUCCEEDED' END AS o
FROM f JOIN r ON r.user_id = f.user_id AND r.i = f.i + 1))"""


@query("I14 I12", ATTEMPTS + " SELECT user_id, event_id, a AS action, outcome FROM f WHERE i > 0")
def attempt_fold(t: Tables):
    action = F.create_map(*[F.lit(x) for x in ("signup", "create", "view", "claim", "click", "heartbeat", "error", "timeout", "purchase", "result")])
    rows = t.events.select("user_id", "event_id", action[F.col("event_type")].alias("action"), (F.col("event_id") % 3).cast("string").alias("request_id"))
    return replay.replay_attempts(rows, ["user_id"], ["event_id"]).select("user_id", "event_id", "action", "outcome")


@query("N12", """WITH RECURSIVE r AS (SELECT l_suppkey AS s, l_orderkey, l_linenumber, l_partkey AS p, l_returnflag AS g, l_orderkey % 5 AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey::VARCHAR, l_returnflag) AS i FROM lineitem),
f AS (SELECT DISTINCT s, 0::BIGINT AS i, 0::BIGINT AS fence, 0::BIGINT AS rev, MAP {} ::MAP(BIGINT, VARCHAR) AS known, 0::BIGINT AS l_orderkey, 0::BIGINT AS l_linenumber, 0::BIGINT AS p, '' AS outcome FROM r UNION ALL
SELECT s, i, CASE WHEN o IN ('REJECTED', 'APPLIED') THEN l_linenumber ELSE fence END, CASE WHEN o = 'APPLIED' THEN rev + 1 ELSE rev END, CASE WHEN o = 'APPLIED' THEN map_concat(known, MAP {p: g}) ELSE known END, l_orderkey, l_linenumber, p, o FROM (
SELECT r.s, r.i, f.fence, f.rev, f.known, r.l_orderkey, r.l_linenumber, r.p, r.g, CASE WHEN f.known[r.p] = r.g THEN 'DUPLICATE' WHEN f.known[r.p] IS NOT NULL THEN 'CONFLICT' WHEN r.l_linenumber < f.fence THEN 'FENCED' WHEN r.v <> f.rev THEN 'REJECTED' ELSE 'APPLIED' END AS o
FROM f JOIN r ON r.s = f.s AND r.i = f.i + 1)) SELECT s AS l_suppkey, l_orderkey, l_linenumber, p AS l_partkey, outcome FROM f WHERE i > 0""")
def effect_fold(t: Tables):
    rows = t.lineitem.select("l_suppkey", "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.col("l_partkey").cast("string").alias("effect_key"), F.col("l_returnflag").alias("argument_hash"),
                             F.col("l_linenumber").cast("long").alias("fence"), (F.col("l_orderkey") % 5).alias("revision"))
    out = replay.replay_effects(rows, ["l_suppkey"], ["l_orderkey", "l_linenumber", "effect_key", "argument_hash"])
    return out.select("l_suppkey", "l_orderkey", "l_linenumber", F.col("effect_key").cast("long").alias("l_partkey"), "outcome")


@query("I06", "SELECT part, count(*) AS pending FROM (SELECT DISTINCT user_id, event_type, user_id % 16 AS part FROM events WHERE event_type <> 'view') GROUP BY 1")
def stream_wakeups(t: Tables):
    """A wakeup for each (user, kind), inserted once however often its event is delivered, and queued by partition."""
    p = place(t)
    rows = t.events.where("event_type <> 'view'").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    once = drained(ops.inbox(replayed(rows, p), ["user_id", "event_type"], "ts", "60 days"), p)
    return once.groupBy((F.col("user_id") % 16).alias("part")).agg(F.count("*").alias("pending"))


@query("I10", """SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_returnflag = 'N' THEN 'SUCCEEDED' WHEN l_returnflag = 'R' AND l_linenumber <= 3 AND l_shipdate <= TIMESTAMP '1997-01-01' THEN 'RETRY' WHEN l_returnflag = 'R' THEN 'FAILED' ELSE 'RECONCILE' END AS next FROM lineitem""")
def consumed_results(t: Tables):
    out = replay.consume(F.col("l_returnflag"), F.col("l_linenumber"), F.lit(3), F.col("l_shipdate"), F.lit("1997-01-01").cast("timestamp_ntz"), ok="N", retryable="R")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", out.alias("next"))


@query("I13", """SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_orderdate + to_days(CAST(o_orderkey % 30 AS INTEGER)) <= TIMESTAMP '1997-01-01' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1)""")
def due_timers(t: Tables):
    """Timers that are due and have not fired yet; firing them again gives nothing."""
    timers = t.orders.where("o_orderstatus <> 'P'").select("o_orderkey", F.expr("o_orderdate + make_dt_interval(CAST(o_orderkey % 30 AS INT))").alias("due"))
    fired = t.lineitem.where("l_returnflag = 'R' AND l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"))
    due = R.lacking(timers.where(F.col("due") <= F.lit("1997-01-01").cast("timestamp_ntz")), fired, ["o_orderkey"]).select("o_orderkey")
    after = stored(t, fired.distinct(), lambda s: N.insert_once(s.withColumn("_x", F.lit(1)), due.withColumn("_x", F.lit(1)), ["o_orderkey"]).drop("_x"))
    return R.lacking(after, fired, ["o_orderkey"])


@query("I11", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'REDISPATCH' WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN 'RECONCILE' WHEN o_orderstatus = 'O' AND o_orderkey % 5 < 3 THEN 'REPLACE' WHEN o_orderstatus = 'O' THEN 'FAIL' ELSE 'IGNORE' END AS outcome
FROM orders WHERE o_orderdate <= TIMESTAMP '1997-01-01'""")
def late_deadlines(t: Tables):
    s = F.col("o_orderstatus")
    rows = t.orders.where(F.col("o_orderdate") <= F.lit("1997-01-01").cast("timestamp_ntz")).select(
        "o_orderkey", F.when(s == "P", "DISPATCHABLE").when(s == "O", "CLAIMED").otherwise("SUCCEEDED").alias("state"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "EXTERNAL").otherwise("PURE").alias("effect_class"), (F.col("o_orderkey") % 5).alias("retries_used"), F.lit(3).alias("budget"))
    return rows.select("o_orderkey", replay.timeout_class().alias("outcome"))


@query("I19", """WITH n AS (SELECT 'EXPIRED_ATTEMPT' AS kind, o_orderkey AS r FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 300000 UNION ALL SELECT 'DUE_TIMER', o_orderkey FROM orders WHERE o_orderstatus = 'P' UNION ALL
SELECT 'PENDING_OUTBOX', event_id FROM events WHERE event_type = 'click' AND value > 100 UNION ALL SELECT 'LOST_WAKEUP', event_id FROM events WHERE event_type = 'view' AND value > 100 UNION ALL SELECT 'POISON_RECORD', event_id FROM events WHERE event_type = 'error' AND value > 100),
o AS (SELECT 'DUE_TIMER' AS kind, o_orderkey AS r FROM orders WHERE o_orderkey % 3 = 0)
SELECT coalesce(n.kind, o.kind) AS kind, CASE WHEN n.kind IS NULL THEN 'old' ELSE 'new' END AS detail, count(*) AS items FROM n FULL JOIN o ON n.kind = o.kind AND n.r = o.r GROUP BY 1, 2""")
def reconciler_pass(t: Tables):
    """Five selections of what is overdue, as obligations by (kind, reference) over those that are there."""
    o, e = t.orders.select(F.col("o_orderkey").alias("k"), "o_orderstatus", "o_totalprice"), t.events.select(F.col("event_id").alias("k"), "event_type", "value")
    pick = lambda kind, df: df.select(F.lit(kind).alias("kind"), F.col("k").cast("string").alias("reference"), F.lit("new").alias("detail"))
    found = union(pick("EXPIRED_ATTEMPT", o.where("o_orderstatus = 'O' AND o_totalprice > 300000")), pick("DUE_TIMER", o.where("o_orderstatus = 'P'")),
                  *(pick(kind, e.where((F.col("event_type") == name) & (F.col("value") > 100))) for kind, name in (("PENDING_OUTBOX", "click"), ("LOST_WAKEUP", "view"), ("POISON_RECORD", "error"))))
    old = pick("DUE_TIMER", o.where("k % 3 = 0")).withColumn("detail", F.lit("old"))
    return stored(t, old, lambda s: R.upsert(s, found, ["kind", "reference"])).groupBy("kind", "detail").agg(F.count("*").alias("items"))


@query("I20", """SELECT coalesce(n.k, o.k) AS k, coalesce(n.v, o.v) AS v FROM (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_acctbal < 5000) o FULL JOIN (SELECT c_custkey AS k, 'NEW' AS v FROM customer WHERE c_acctbal > 2000) n ON o.k = n.k""")
def upserted_obligations(t: Tables):
    c = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"), "c_acctbal")
    return stored(t, c.where("c_acctbal < 5000").drop("c_acctbal"), lambda s: R.upsert(s, c.where("c_acctbal > 2000").select("k", F.lit("NEW").alias("v")), ["k"]))


@query("I30", """WITH s AS (SELECT o_custkey AS w, o_orderkey AS k, o_orderstatus = 'F' AS ok, lead(o_orderkey) OVER w AS nx, lead(o_orderstatus) OVER w AS ns FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT k, CASE WHEN nx IS NULL THEN 'FINISH' ELSE 'ADVANCE' END AS action FROM s WHERE ok AND (nx IS NULL OR ns = 'P')""")
def node_recovery(t: Tables):
    """After a crash: a succeeded node whose successor hasn't begun is advanced, and the last one finishes its workflow."""
    w = S.by(["o_custkey"], "o_orderdate", "o_orderkey")
    rows = t.orders.select(F.col("o_orderkey").alias("k"), "o_orderstatus", F.lead("o_orderkey").over(w).alias("nx"), F.lead("o_orderstatus").over(w).alias("ns"))
    return rows.where("o_orderstatus = 'F' AND (nx IS NULL OR ns = 'P')").select("k", F.when(F.col("nx").isNull(), "FINISH").otherwise("ADVANCE").alias("action"))


@query("I31", """WITH h AS (SELECT o_custkey AS w, o_orderkey % 10 AS r, count(*) AS n FROM orders GROUP BY 1, 2), o AS (SELECT user_id AS w, event_id % 10 AS r, count(*) AS n FROM events GROUP BY 1, 2)
SELECT coalesce(h.w, o.w) AS workflow, coalesce(h.r, o.r) AS revision, coalesce(h.n, 0) AS history, coalesce(o.n, 0) AS outbox FROM h FULL JOIN o ON h.w = o.w AND h.r = o.r WHERE h.n IS DISTINCT FROM 1 OR o.n IS DISTINCT FROM 1""")
def append_pairs(t: Tables):
    """Revisions without exactly one history row and one outbox row."""
    h = t.orders.groupBy(F.col("o_custkey").alias("workflow"), (F.col("o_orderkey") % 10).alias("revision")).agg(F.count("*").alias("history"))
    o = t.events.groupBy(F.col("user_id").alias("workflow"), (F.col("event_id") % 10).alias("revision")).agg(F.count("*").alias("outbox"))
    both = h.join(o, ["workflow", "revision"], "full").fillna(0, ["history", "outbox"])
    return both.where("history <> 1 OR outbox <> 1")


@query("I22", """SELECT event_type AS log, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS commit_order FROM events""")
def commit_order(t: Tables):
    return events(t).select(F.col("event_type").alias("log"), "event_id", F.row_number().over(Window.partitionBy("event_type").orderBy("us", "event_id")).cast("long").alias("commit_order"))


@query("E13", """WITH s AS (SELECT user_id AS u, min(ts) AS at_ FROM events WHERE event_type = 'signup' GROUP BY 1), c AS (SELECT e.user_id AS u, e.event_id, e.ts > s.at_ AS stale FROM events e JOIN s ON s.u = e.user_id WHERE e.event_type = 'purchase')
SELECT u AS user_id, count(*) FILTER (WHERE NOT stale) AS winners, count(*) FILTER (WHERE stale) AS stale FROM c GROUP BY 1""")
def winner_counts(t: Tables):
    e = t.events.select("user_id", "event_type", C.micros(F.col("ts")).alias("us"))
    ended = e.where("event_type = 'signup'").groupBy("user_id").agg(F.min("us").alias("ended"))
    late = F.col("us") > F.col("ended")
    return e.where("event_type = 'purchase'").join(ended, "user_id").groupBy("user_id").agg(F.count_if(~late).alias("winners"), F.count_if(late).alias("stale"))


@query("E09", """WITH w AS (SELECT s_nationkey AS r, s_suppkey AS f, s_suppkey * 7 % 31 AS o, lag(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey * 7 % 31, s_suppkey) AS p, count(*) OVER (PARTITION BY s_nationkey, s_suppkey % 9) AS same FROM supplier)
SELECT r, count(*) FILTER (WHERE f <= p) AS backwards, count(*) FILTER (WHERE same > 1) AS shared FROM w GROUP BY 1""")
def allocation_fences(t: Tables):
    """Fences of a resource that don't advance in order of allocation, and those that stand twice."""
    k = F.col("s_suppkey")
    rows = t.supplier.select(F.col("s_nationkey").alias("r"), k.alias("f"), (k * 7 % 31).alias("o"), (k % 9).alias("slot"))
    rows = rows.withColumn("p", F.lag("f").over(S.by(["r"], "o", "f"))).withColumn("same", F.count("*").over(Window.partitionBy("r", "slot")))
    return rows.groupBy("r").agg(F.count_if(F.col("f") <= F.col("p")).alias("backwards"), F.count_if(F.col("same") > 1).alias("shared"))
