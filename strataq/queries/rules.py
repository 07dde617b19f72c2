"""Invariant rules on driver tables in workflow roles: inventory group K."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import time as C
from ..operators import invariants as I
from ..operators import sequence as S
from ..sources import readers
from .base import Tables, query


def trace(t: Tables) -> dict:
    """The driver tables in the roles of a trace: customers' orders are histories, lines are attempts, events are messages."""
    from ..sources.schemas import trace_of

    views = trace_of(t.spark, {})
    k = F.row_number().over(S.by(["o_custkey"], "o_orderdate", "o_orderkey")).cast("long")
    state = F.when(F.col("o_orderstatus") == "F", "SUCCEEDED").when(F.col("o_orderstatus") == "P", "RUNNABLE").otherwise("WAITING_ACTIVITY")
    h = t.orders.select(F.col("o_custkey").cast("string").alias("workflow_id"), k.alias("revision"),
                        F.when(F.col("o_orderpriority") == "1-URGENT", "user").otherwise("scheduler").alias("actor_kind"),
                        F.floor(F.col("o_totalprice") / 100000).alias("scheduler_epoch"), state.alias("new_state"), F.lit("RESULT_CONSUMED").alias("reason"))
    views["history"] = h.withColumn("old_state", F.coalesce(F.lag("new_state").over(S.by(["workflow_id"], "revision")), F.lit("")))
    views["attempts"] = t.lineitem.select(
        F.col("l_orderkey").cast("string").alias("workflow_id"), F.lit("n").alias("node_id"), F.lit(0).alias("iteration"), F.col("l_linenumber").cast("long").alias("attempt_number"),
        F.when(F.col("l_returnflag") == "R", "CLAIMED").when(F.col("l_returnflag") == "A", "TIMED_OUT").otherwise("SUCCEEDED").alias("state"),
        F.lit("t").alias("claim_token"), F.lit("w").alias("worker_id"), F.when(F.col("l_quantity") > 25, "r").otherwise("").alias("worker_request_id"), F.lit("").alias("outcome"),
        (F.col("l_linestatus") == "O").alias("is_current"), (F.col("l_discount") > 0.05).alias("result_recorded"))
    views["submissions"] = t.customer.select(F.col("c_mktsegment").alias("namespace"), F.col("c_nationkey").cast("string").alias("key"), F.col("c_name").alias("hash"), F.col("c_custkey").cast("string").alias("workflow_id"))
    views["outbox"] = t.events.select(F.col("user_id").cast("string").alias("workflow_id"), F.col("event_id").cast("string").alias("event_id"), F.lit(1).cast("long").alias("aggregate_revision"),
                                      F.when(F.col("event_type") == "error", "attempt.dispatch").otherwise("workflow.created").alias("event_type"), F.lit("durable-agent.events.v1").alias("topic"),
                                      F.when(F.col("event_type") == "click", "QUARANTINED").otherwise("PUBLISHED").alias("publish_state"), (F.col("value") >= 1).alias("payload_valid"))
    return views


HISTORY = """WITH k AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r, o_orderpriority = '1-URGENT' AS human, CAST(floor(o_totalprice / 100000) AS BIGINT) AS e,
CASE o_orderstatus WHEN 'F' THEN 'S' WHEN 'P' THEN 'R' ELSE 'W' END AS s FROM orders), w AS (SELECT *, lag(s) OVER (PARTITION BY o_custkey ORDER BY r) AS p FROM k),
x AS (SELECT *, max(CASE WHEN s = 'S' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done FROM w),
g AS (SELECT o_custkey, r, e, max(e) OVER (PARTITION BY o_custkey ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM k WHERE NOT human AND e > 0), v AS (
SELECT 'history start' AS rule FROM w WHERE r = 1 AND s <> 'R' UNION ALL SELECT 'illegal transition' FROM w WHERE p IS NOT NULL AND p || s NOT IN ('RR', 'RW', 'RS', 'WW', 'WR')
UNION ALL SELECT 'history after terminal' FROM x WHERE done = 1 UNION ALL SELECT 'scheduler without epoch' FROM k WHERE NOT human AND e <= 0
UNION ALL SELECT 'epoch without scheduler' FROM k WHERE human UNION ALL SELECT 'epoch backwards' FROM g WHERE e < h)
SELECT rule, count(*) AS violations FROM v GROUP BY 1"""


def counted(df):
    return df.groupBy("rule").agg(F.count("*").alias("violations"))


@query("K01 K03 E01 E02 E03 E04 E05", HISTORY)
def invariants_history(t: Tables):
    return counted(I.check(trace(t), ["history"]))


@query("K03 E06 K33", """WITH a AS (SELECT l_orderkey AS k, l_linenumber AS n, l_returnflag AS f, l_linestatus = 'O' AS cur, l_discount > 0.05 AS rec, l_quantity > 25 AS own FROM lineitem),
o AS (SELECT k, n, row_number() OVER (PARTITION BY k ORDER BY n) AS i, lag(n) OVER (PARTITION BY k ORDER BY n) AS p FROM a),
v AS (SELECT 'terminal attempt current' AS rule FROM a WHERE cur AND f <> 'R' UNION ALL SELECT 'claim without owner' FROM a WHERE f = 'R' AND NOT own
UNION ALL SELECT 'result on settled attempt' FROM a WHERE rec AND f = 'A' UNION ALL SELECT 'attempt contiguity' FROM (SELECT DISTINCT k FROM o WHERE n <> coalesce(p + 1, 1)))
SELECT rule, count(*) AS violations FROM v GROUP BY 1""")
def invariants_attempts(t: Tables):
    return counted(I.check(trace(t), ["attempts"]).where("rule <> 'several current attempts'"))


@query("K02 D16", """WITH v AS (SELECT 'submission key conflict' AS rule FROM customer GROUP BY c_mktsegment, c_nationkey HAVING count(DISTINCT c_name) > 1) SELECT rule, count(*) AS violations FROM v GROUP BY 1""")
def invariants_submissions(t: Tables):
    return counted(I.check(trace(t), ["submissions", "results"]))


@query("K04 K08 K11", """WITH v AS (SELECT 'event identity' AS rule FROM events WHERE value < 1 UNION ALL SELECT 'event topic' FROM events WHERE event_type = 'error'
UNION ALL SELECT 'event of unknown workflow' FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer) UNION ALL
SELECT 'missing event' FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE NOT (r = 1 AND o_custkey IN (SELECT user_id FROM events))
UNION ALL SELECT 'quarantine without item' FROM events WHERE event_type = 'click') SELECT rule, count(*) AS violations FROM v GROUP BY 1""")
def invariants_transport(t: Tables):
    return counted(I.check(trace(t), ["transport"]))


@query("K28", """WITH v AS (SELECT 'created event' AS boundary, user_id AS w FROM events WHERE event_type <> 'error' UNION SELECT 'dispatch event', user_id FROM events WHERE event_type = 'error' UNION SELECT 'published event', user_id FROM events WHERE event_type <> 'click'
UNION SELECT 'quarantined event', user_id FROM events WHERE event_type = 'click' UNION SELECT 'claimed attempt', l_orderkey FROM lineitem WHERE l_returnflag = 'R' UNION SELECT 'timed out attempt', l_orderkey FROM lineitem WHERE l_returnflag = 'A'
UNION SELECT 'succeeded attempt', l_orderkey FROM lineitem WHERE l_returnflag = 'N' UNION SELECT 'current attempt', l_orderkey FROM lineitem WHERE l_linestatus = 'O' UNION SELECT 'recorded result', l_orderkey FROM lineitem WHERE l_discount > 0.05
UNION SELECT 'replacement attempt', l_orderkey FROM lineitem WHERE l_linenumber > 1 UNION SELECT 'consumed result', o_custkey FROM orders UNION SELECT 'scheduler transition', o_custkey FROM orders WHERE o_orderpriority <> '1-URGENT'
UNION SELECT 'terminal state', o_custkey FROM orders WHERE o_orderstatus = 'F') SELECT boundary, count(*) AS workflows FROM v GROUP BY 1""")
def boundary_predicates(t: Tables):
    from ..operators.evidence import boundary_rows

    return boundary_rows(trace(t)).groupBy("boundary").agg(F.count("*").alias("workflows"))


@query("K06", """SELECT kind, CASE WHEN kind IN ('attempt.dispatch', 'attempt.redispatch') THEN 'durable-agent.tasks.v1' WHEN kind <> 'unheard.of' THEN 'durable-agent.events.v1' END AS topic FROM (VALUES ('workflow.created'), ('attempt.dispatch'),
('attempt.redispatch'), ('activity.result'), ('workflow.result_consumed'), ('graph.advanced'), ('timer.scheduled'), ('workflow.canceled'), ('approval.requested'), ('approval.decided'), ('approval.granted'), ('approval.rejected'), ('cancellation.requested'),
('effect.applied'), ('reconciliation.required'), ('reconciliation.resolved'), ('unheard.of')) v(kind)""")
def topic_registry(t: Tables):
    rows = t.spark.createDataFrame([(k,) for k in (*I.EVENT_TYPES, "unheard.of")], "kind string")
    return rows.select("kind", I.topic_of(F.col("kind")).alias("topic"))


@query("K09", """WITH i AS (SELECT event_id, event_type, CASE event_id % 15 WHEN 0 THEN 'POISON' ELSE 'PENDING_OUTBOX' END AS kind, event_id % 2 = 0 AS open, event_id % 35 = 0 AS gone FROM events WHERE event_id % 5 = 0)
SELECT 'published but open' AS rule, count(*) AS violations FROM i WHERE kind = 'PENDING_OUTBOX' AND open AND NOT gone AND event_type <> 'click' HAVING count(*) > 0 UNION ALL SELECT 'item of unknown event', count(*) FROM i WHERE kind = 'PENDING_OUTBOX' AND gone HAVING count(*) > 0
UNION ALL SELECT 'item kind', count(*) FROM i WHERE kind = 'POISON' HAVING count(*) > 0""")
def open_items(t: Tables):
    v, k = trace(t), F.col("event_id")
    v["reconciliation"] = t.events.where("event_id % 5 = 0").select(
        F.col("user_id").cast("string").alias("workflow_id"), F.when(k % 15 == 0, "POISON").otherwise("PENDING_OUTBOX").alias("kind"),
        F.concat(F.lit("outbox/"), F.when(k % 35 == 0, "x").otherwise(""), k.cast("string")).alias("reference"), F.when(k % 2 == 0, "OPEN").otherwise("RESOLVED").alias("status"))
    return counted(I.check(v, ["transport"]).where("rule IN ('published but open', 'item of unknown event', 'item kind')"))


EFFECTS = """WITH e AS (SELECT o_orderkey AS k, o_orderpriority AS res, CASE o_orderstatus WHEN 'F' THEN 'APPLIED' WHEN 'O' THEN 'OUTCOME_UNKNOWN' ELSE 'X' END AS o, k % 4 <> 0 AS receipt, k % 17 = 0 AS scopeless FROM orders),
a AS (SELECT k, CASE WHEN k % 11 = 0 THEN 'other' ELSE res END AS target, k % 3 <> 0 AS yes, k % 7 <> 0 AS sent, k % 13 = 0 AS wrong, CASE WHEN k % 19 = 0 THEN 'b' ELSE 'a' END AS arg FROM e WHERE k % 5 <> 0),
j AS (SELECT * FROM e JOIN a USING (k) WHERE o = 'APPLIED'), v AS (SELECT 'effect without receipt' AS rule FROM e WHERE o = 'APPLIED' AND NOT receipt UNION ALL SELECT 'effect outcome' FROM e WHERE o = 'X' UNION ALL SELECT 'grant without approval' FROM a WHERE NOT yes
UNION ALL SELECT 'proposal digest' FROM a WHERE wrong UNION ALL SELECT 'effect without intent' FROM e WHERE o = 'APPLIED' AND k % 5 = 0 UNION ALL SELECT 'effect not dispatched' FROM j WHERE NOT yes OR NOT sent UNION ALL SELECT 'effect resource' FROM j WHERE target <> res
UNION ALL SELECT 'effect arguments' FROM j WHERE arg <> 'a' UNION ALL SELECT 'effect scope' FROM j WHERE scopeless) SELECT rule, count(*) AS violations FROM v GROUP BY 1"""


@query("K10 H06 H07", EFFECTS)
def effect_evidence(t: Tables):
    from ..functions.hashing import joined_digest

    v, k = trace(t), F.col("o_orderkey")
    name, status, res = k.cast("string"), F.col("o_orderstatus"), F.col("o_orderpriority")
    target = F.when(k % 11 == 0, "other").otherwise(res)
    arg = F.when(k % 19 == 0, "b").otherwise("a")
    proposal = F.when(k % 13 == 0, "wrong").otherwise(joined_digest(target, arg, F.lit("7")))
    scope = joined_digest(proposal, F.lit("7"), name, target)
    v["effects"] = t.orders.select(
        F.col("o_custkey").cast("string").alias("workflow_id"), name.alias("intent_id"), name.alias("logical_effect_key"), F.lit("a").alias("argument_hash"), F.lit(1).alias("attempt_number"),
        F.when(k % 17 == 0, "none").otherwise(scope).alias("grant_scope_hash"), res.alias("resource_id"), F.when(status == "F", "APPLIED").when(status == "O", "OUTCOME_UNKNOWN").otherwise("X").alias("outcome"), (k % 4 != 0).alias("receipt_present"))
    v["approvals"] = t.orders.where("o_orderkey % 5 <> 0").select(
        name.alias("intent_id"), F.col("o_custkey").cast("string").alias("workflow_id"), F.lit("n").alias("node_id"), F.lit(0).alias("iteration"), proposal.alias("proposal_hash"), target.alias("target"), F.lit(True).alias("arguments_valid"),
        arg.alias("canonical_argument_hash"), F.lit("7").alias("expected_resource_revision"), F.when(k % 3 != 0, "APPROVED").otherwise("PENDING").alias("decision"), F.when(k % 7 != 0, "DISPATCHED").otherwise("GRANTED").alias("dispatch_status"),
        scope.alias("grant_scope_hash"), F.lit("g").alias("grant_token"))
    return counted(I.check(v, ["effects"]))


@query("K12 K13", """WITH h AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT 'accepted without history' AS rule, count(*) AS violations FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM h) HAVING count(*) > 0
UNION ALL SELECT 'final state', count(*) FROM customer JOIN h ON c_custkey = o_custkey WHERE n <> 10 HAVING count(*) > 0""")
def submission_reconcile(t: Tables):
    v = trace(t)
    last = v["history"].groupBy("workflow_id").agg(F.max_by("new_state", "revision").alias("state")).withColumn("revision", F.lit(10).cast("long"))
    return counted(I.reconcile(v["submissions"], v["history"], last))


@query("K19 E35", """WITH n AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS terminals, count(*) FILTER (WHERE o_totalprice > 490000) AS lost FROM orders GROUP BY 1)
SELECT c_custkey, coalesce(terminals, 0) AS terminals, coalesce(lost, 0) AS lost FROM customer LEFT JOIN n ON o_custkey = c_custkey WHERE coalesce(terminals, 0) <> 1 OR coalesce(lost, 0) > 0""")
def window_reconciliation(t: Tables):
    o = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    return I.one_terminal(t.customer, o, "c_custkey", F.col("o_orderstatus") == "F", F.col("o_totalprice") > 490000)


@query("K15 C21 E34", """SELECT count(*) FILTER (WHERE owner IS NULL) AS unowned, count(*) AS claims FROM (SELECT (SELECT max(s.ts) FROM events s WHERE s.user_id = e.user_id AND s.event_type = 'signup' AND s.ts <= e.ts) AS owner FROM events e WHERE e.event_type <> 'signup')""")
def lifecycle_ownership(t: Tables):
    e = t.events.select("user_id", "event_type", C.micros(F.col("ts")).alias("us"))
    out = S.asof(e.where("event_type <> 'signup'"), e.where("event_type = 'signup'").select("user_id", F.col("us").alias("at")), ["user_id"], "us", "at", [])
    return out.agg(F.count_if(F.col("asof_at").isNull()).alias("unowned"), F.count("*").alias("claims"))


@query("K16 A32 A56", """SELECT conv_id::VARCHAR AS run_id, count(*) AS events, bool_or(turn <> k) AS gap FROM (SELECT conv_id, turn + 1 AS turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) GROUP BY 1""")
def fault_runs(t: Tables):
    rows = t.conversations.select(F.lit("fault-trace.v1").alias("schema_version"), F.col("conv_id").cast("string").alias("run_id"), (F.col("turn") + 1).cast("int").alias("sequence"),
                                  F.lit(1).alias("seed"), F.col("role").alias("event"), F.col("role").alias("boundary"), F.lit(True).alias("bounded"))
    return readers.fault_runs(rows).select("run_id", "events", "gap")


@query("K18", "SELECT * FROM (VALUES ('fencing', true), ('kernel faults', false), ('restart', true)) AS v(item, covered)")
def coverage(t: Tables):
    return I.coverage(t.spark, {"fencing": True, "restart": True, "kernel faults": False})


@query("K26", """SELECT e.event_id, count(c.event_id) AS holders FROM events e LEFT JOIN events c ON c.user_id = e.user_id AND c.event_type = 'signup' AND epoch_us(c.ts) <= epoch_us(e.ts) AND epoch_us(e.ts) < epoch_us(c.ts) + 86400000000
WHERE e.event_type = 'error' GROUP BY 1""")
def session_containment(t: Tables):
    e = t.events.select("event_id", "user_id", "event_type", C.micros(F.col("ts")).alias("us"))
    day = F.lit(86400000000)
    step = e.where("event_type = 'signup'")
    rows = step.select("user_id", "us", F.lit(0).alias("turn"), F.lit(1).alias("d"), F.lit(None).cast("bigint").alias("event_id")).unionByName(
        step.select("user_id", (F.col("us") + day).alias("us"), F.lit(0).alias("turn"), F.lit(-1).alias("d"), F.lit(None).cast("bigint").alias("event_id"))).unionByName(
        e.where("event_type = 'error'").select("user_id", "us", F.lit(1).alias("turn"), F.lit(0).alias("d"), "event_id"))
    run = F.sum("d").over(S.by(["user_id"], "us", "turn").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("holders", run).where("event_id IS NOT NULL").select("event_id", "holders")


@query("K30", """SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, o_orderstatus, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders) WHERE p = 'P' AND o_orderstatus = 'F'""")
def consumed_next_revision(t: Tables):
    p = F.lag("o_orderstatus").over(S.by(["o_custkey"], "o_orderdate", "o_orderkey"))
    return t.orders.withColumn("p", p).where("p = 'P' AND o_orderstatus = 'F'").select("o_custkey", "o_orderkey")


@query("K37 L05", """SELECT event_type, quantile_disc(value, 0.5) AS low_median, quantile_disc(value, 0.5) BETWEEN 0 AND 60 AS held FROM events GROUP BY 1""")
def clock_skew(t: Tables):
    from ..operators.stats import median_low

    return t.events.groupBy("event_type").agg(median_low("value").alias("low_median")).withColumn("held", F.col("low_median").between(0, 60))


@query("K41", "SELECT n_nationkey, n_name, 'frozen' AS side FROM nation WHERE n_regionkey = 0")
def frozen_difference(t: Tables):
    n = t.nation.select("n_nationkey", "n_name", "n_regionkey")
    return I.same_result(n.drop("n_regionkey"), n.where("n_regionkey <> 0").drop("n_regionkey"))
