"""Evidence verdicts on driver tables in the roles of claims, calls, records and sessions: inventory groups B, C and K."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import time as C
from ..operators import evidence as E
from ..operators import sequence as S
from .base import Tables, query


def counted(df):
    return df.groupBy("rule").agg(F.count("*").alias("violations"))


def sql(parts: str, **rules: str) -> str:
    """Violations by rule: each rule is a query whose rows are its violations."""
    union = " UNION ALL ".join(f"SELECT '{name.replace('_', ' ')}' AS rule, count(*) AS violations FROM ({body}) HAVING count(*) > 0" for name, body in rules.items())
    return f"WITH {parts} SELECT rule, violations FROM ({union})"


@query("C30", sql(
    "a AS (SELECT conv_id, conv_id % 5 AS s, role, length(text) % 2 AS d, row_number() OVER (PARTITION BY conv_id % 5 ORDER BY conv_id, turn) - 1 AS k, (conv_id * 7 + turn) % 23 <> 0 AS seen FROM conversations), x AS (SELECT * FROM a WHERE seen)",
    sequence_gap="SELECT s FROM x GROUP BY s HAVING count(*) <> max(k) + 1",
    high_water="SELECT s FROM a GROUP BY s HAVING count(*) IS DISTINCT FROM max(k) FILTER (WHERE seen) + 1",
    event_order="SELECT conv_id FROM x GROUP BY 1 HAVING string_agg(role, ',' ORDER BY k) <> 'user,assistant'",
    forwarded_bytes="SELECT conv_id FROM x GROUP BY 1 HAVING count(DISTINCT d) > 1"))
def exchange_pairs(t: Tables):
    a = t.conversations.select("conv_id", "turn", "role", (F.col("conv_id") % 5).alias("session"), (F.length("text") % 2).alias("digest"))
    a = a.withColumn("number", F.row_number().over(S.by(["session"], "conv_id", "turn")) - 1)
    sealed = a.groupBy("session").agg(F.count("*").alias("high_water"))
    return counted(E.exchanges(a.where("(conv_id * 7 + turn) % 23 <> 0"), "session", "number", "conv_id", "role", "digest", sealed, ["user", "assistant"]))


@query("C27 K14", sql(
    "s AS (SELECT o_orderkey AS i, o_custkey AS c FROM orders WHERE o_orderpriority <> '1-URGENT'), e AS (SELECT l_orderkey AS i FROM lineitem WHERE l_returnflag = 'R')",
    start_without_end="SELECT i FROM s WHERE i NOT IN (SELECT i FROM e)", end_without_start="SELECT DISTINCT i FROM e WHERE i NOT IN (SELECT i FROM s)",
    several_ends="SELECT i FROM e GROUP BY i HAVING count(*) > 1",
    start_without_attempt="SELECT i FROM s WHERE c NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
    receipt_without_start="SELECT c_custkey FROM customer WHERE c_acctbal > 5000 AND c_custkey NOT IN (SELECT c FROM s)"))
def witness_ledger(t: Tables):
    starts = t.orders.where("o_orderpriority <> '1-URGENT'").select(F.col("o_orderkey").alias("i"), F.col("o_custkey").alias("c"))
    ends = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("i"))
    c = t.customer.select(F.col("c_custkey").alias("c"), "c_acctbal")
    out = E.witness_ledger(starts, ends, c.where("c_acctbal > 0"), c.where("c_acctbal > 5000"), "i", ["c"])
    return counted(out.where("rule <> 'end without start'").unionByName(out.where("rule = 'end without start'").distinct()))


@query("C28 K17", sql(
    "f AS (SELECT user_id AS u, CASE event_id % 4 WHEN 0 THEN 'claim' WHEN 1 THEN 'commit' WHEN 2 THEN 'ack' ELSE 'other' END AS b FROM events WHERE event_type = 'error')",
    unknown_boundary="SELECT u FROM f WHERE b = 'other'", no_evidence_at_claim="SELECT u FROM f WHERE b = 'claim' AND u NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 100)",
    no_evidence_at_commit="SELECT u FROM f WHERE b = 'commit' AND u NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 100)",
    no_evidence_at_ack="SELECT u FROM f WHERE b = 'ack' AND u NOT IN (SELECT user_id FROM events WHERE event_type = 'view' AND value > 100)"))
def fault_evidence(t: Tables):
    k = F.col("event_id") % 4
    faults = t.events.where("event_type = 'error'").select("user_id", F.when(k == 0, "claim").when(k == 1, "commit").when(k == 2, "ack").otherwise("other").alias("boundary"))
    left = lambda kind: t.events.where((F.col("event_type") == kind) & (F.col("value") > 100)).select("user_id")
    return counted(E.fault_boundaries(faults, {"claim": left("signup"), "commit": left("purchase"), "ack": left("view")}, "user_id"))


@query("C29", sql(
    "a AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s FROM orders WHERE o_orderkey % 10 <> 0), b AS (SELECT o_orderkey AS k, o_custkey AS c, CASE WHEN o_orderkey % 100 = 7 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 15 <> 0)",
    request_without_call="SELECT k FROM a WHERE k NOT IN (SELECT k FROM b)", call_without_request="SELECT k FROM b WHERE k NOT IN (SELECT k FROM a)",
    columns_differ="SELECT k FROM a JOIN b USING (k) WHERE a.c <> b.c OR a.s <> b.s"))
def ingress_sink(t: Tables):
    o = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderstatus").alias("s"))
    calls = o.where("k % 15 <> 0").withColumn("s", F.when(F.col("k") % 100 == 7, "X").otherwise(F.col("s")))
    return counted(E.ingress_and_sink(o.where("k % 10 <> 0"), calls, "k", ["c", "s"]))


@query("K20", sql(
    "c AS (SELECT l_orderkey AS k, l_returnflag = 'A' AS ok FROM lineitem WHERE l_linenumber <= 2), p AS (SELECT k FROM c WHERE ok), j AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F'), r AS (SELECT o_orderkey AS k FROM orders WHERE o_totalprice > 100000)",
    applied_without_entry="SELECT DISTINCT k FROM p WHERE k NOT IN (SELECT k FROM j)", entry_without_applied_call="SELECT k FROM j WHERE k NOT IN (SELECT k FROM p)",
    applied_twice="SELECT k FROM p GROUP BY k HAVING count(*) > 1", applied_without_receipt="SELECT DISTINCT k FROM p WHERE k NOT IN (SELECT k FROM r)",
    receipt_without_applied_call="SELECT DISTINCT k FROM c WHERE k NOT IN (SELECT k FROM p) AND k IN (SELECT k FROM r)"))
def mutation_ledger(t: Tables):
    calls = t.lineitem.where("l_linenumber <= 2").select(F.col("l_orderkey").alias("k"), "l_returnflag")
    o = t.orders.select(F.col("o_orderkey").alias("k"), "o_orderstatus", "o_totalprice")
    return counted(E.mutations(calls, o.where("o_orderstatus = 'F'"), o.where("o_totalprice > 100000"), "k", F.col("l_returnflag") == "A"))


@query("K22", sql(
    """b AS (SELECT user_id % 4 AS p, event_id AS e, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS o FROM events), n AS (SELECT DISTINCT p, 60 + 10 * p AS nx FROM b),
l AS (SELECT p, o, e, nx FROM b JOIN n USING (p) WHERE e % 97 <> 5 AND o < nx), i AS (SELECT p, o, CASE WHEN e % 29 = 0 THEN e + 1 ELSE e END AS ie, CASE WHEN e % 2 = 0 THEN 'ACCEPTED' ELSE 'STALE' END AS d FROM b WHERE e % 31 <> 0)""",
    low_range="SELECT p FROM n WHERE nx <> (SELECT count(*) FROM l WHERE l.p = n.p)", no_disposition="SELECT p, o FROM l WHERE (p, o) NOT IN (SELECT (p, o) FROM i)",
    other_event="SELECT p FROM l JOIN i USING (p, o) WHERE ie <> e", last_not_accepted="SELECT p FROM l JOIN i USING (p, o) WHERE o = nx - 1 AND d <> 'ACCEPTED'"))
def offset_evidence(t: Tables):
    b = t.events.select((F.col("user_id") % 4).alias("part"), "event_id")
    b = b.withColumn("off", F.row_number().over(S.by(["part"], "event_id")) - 1)
    k = F.col("event_id")
    inbox = b.where("event_id % 31 <> 0").select("part", "off", F.when(k % 29 == 0, k + 1).otherwise(k).alias("event_id"), F.when(k % 2 == 0, "ACCEPTED").otherwise("STALE").alias("disposition"))
    position = b.select("part").distinct().withColumn("next_offset", 60 + 10 * F.col("part"))
    return counted(E.offsets(b.where("event_id % 97 <> 5"), inbox, position, "part", "off", "event_id"))


@query("K23", sql(
    "p AS (SELECT o_orderkey AS e, o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_orderkey AS e, CASE WHEN o_orderkey % 50 = 0 THEN o_custkey + 1 ELSE o_custkey END AS k FROM orders WHERE o_totalprice > 50000)",
    published_without_record="SELECT e FROM p WHERE e NOT IN (SELECT e FROM b)", record_without_publication="SELECT e FROM b WHERE e NOT IN (SELECT e FROM p)",
    record_key="SELECT e FROM p JOIN b USING (e) WHERE p.k <> b.k"))
def relay_evidence(t: Tables):
    o = t.orders.select(F.col("o_orderkey").alias("e"), F.col("o_custkey").alias("k"), "o_orderstatus", "o_totalprice")
    broker = o.where("o_totalprice > 50000").withColumn("k", F.when(F.col("e") % 50 == 0, F.col("k") + 1).otherwise(F.col("k")))
    return counted(E.relay(o.where("o_orderstatus = 'F'").select("e", "k"), broker, "e", "k"))


@query("K29", sql(
    """h AS (SELECT o_orderkey AS k, o_custkey AS w, o_orderstatus = 'O' AS claimed, o_orderkey % 9 <> 0 AS cur FROM orders WHERE o_totalprice > 150000),
a AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 40 = 3 THEN -1 ELSE o_custkey END AS w FROM orders WHERE o_orderkey % 20 <> 0 UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 33 = 1)""",
    claim_audit="SELECT k FROM h WHERE (SELECT count(*) FROM a WHERE a.k = h.k) <> 1", claim_identity="SELECT DISTINCT k FROM h JOIN a USING (k) WHERE a.w <> h.w",
    claim_state="SELECT k FROM h WHERE NOT claimed OR NOT cur", result_at_hold="SELECT k FROM h WHERE k IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1)",
    invocation_at_hold="SELECT k FROM h WHERE k IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F' AND l_linenumber = 2)"))
def claim_at_hold(t: Tables):
    o = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("w"), "o_orderstatus", "o_totalprice")
    held = o.where("o_totalprice > 150000").select("k", "w", F.lit(True).alias("held"), F.when(F.col("o_orderstatus") == "O", "CLAIMED").otherwise("TIMED_OUT").alias("state"), (F.col("k") % 9 != 0).alias("is_current"))
    audits = o.where("k % 20 <> 0").select("k", F.when(F.col("k") % 40 == 3, -1).otherwise(F.col("w")).alias("w")).unionByName(o.where("k % 33 = 1").select("k", "w"))
    lines = t.lineitem.withColumnRenamed("l_orderkey", "k")
    return counted(E.claims_at_hold(held, audits, lines.where("l_returnflag = 'R' AND l_linenumber = 1"), lines.where("l_linestatus = 'F' AND l_linenumber = 2"), ["k"], ["w"]))


@query("K29 K36", sql(
    """a AS (SELECT l_orderkey AS k, l_linenumber AS n, CASE l_returnflag WHEN 'R' THEN 'TIMED_OUT' WHEN 'A' THEN 'SUCCEEDED' ELSE 'CLAIMED' END AS s, epoch_us(l_shipdate) AS at FROM lineitem WHERE l_linenumber <= 2), x AS (SELECT * FROM a WHERE n = 1), y AS (SELECT * FROM a WHERE n = 2),
st AS (SELECT l_orderkey AS k, l_linenumber AS n FROM lineitem WHERE l_linenumber <= 2 AND l_quantity > 40)""",
    expired_claim="SELECT k FROM x WHERE s <> 'TIMED_OUT'", replacement="SELECT x.k FROM x LEFT JOIN y USING (k) WHERE y.s IS NULL OR y.s <> 'SUCCEEDED'",
    replaced_before_the_deadline="SELECT k FROM x JOIN y USING (k) WHERE y.at < x.at + 86400000000", expired_attempt_started="SELECT DISTINCT k FROM st WHERE n = 1",
    replacement_not_started="SELECT k FROM x WHERE k NOT IN (SELECT k FROM st WHERE n = 2)"))
def claim_after(t: Tables):
    flag, us = F.col("l_returnflag"), C.micros(F.col("l_shipdate"))
    lines = t.lineitem.where("l_linenumber <= 2").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), "l_quantity", us.alias("made"), (us + 86400000000).alias("deadline"),
                                                         F.when(flag == "R", "TIMED_OUT").when(flag == "A", "SUCCEEDED").otherwise("CLAIMED").alias("state"))
    return counted(E.claims_after(lines, lines.where("l_quantity > 40").select("k", "n"), ["k"], "n", "deadline", "made"))


HISTORY = """h AS (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r, CASE o_orderstatus WHEN 'F' THEN 'RESULT_CONSUMED' WHEN 'P' THEN 'ATTEMPT_RESULT_RECORDED' ELSE 'OTHER' END AS reason,
o_orderpriority AS owner, o_orderkey % 7 AS epoch FROM orders)"""


def history(t: Tables):
    status = F.col("o_orderstatus")
    return t.orders.select(F.col("o_custkey").alias("k"), F.row_number().over(S.by(["o_custkey"], "o_orderdate", "o_orderkey")).cast("long").alias("r"),
                           F.when(status == "F", "RESULT_CONSUMED").when(status == "P", "ATTEMPT_RESULT_RECORDED").otherwise("OTHER").alias("reason"),
                           F.col("o_orderpriority").alias("owner"), (F.col("o_orderkey") % 7).alias("epoch"))


@query("K30", sql(HISTORY + ", g AS (SELECT c_custkey AS k, max(r) AS last, max(r) FILTER (WHERE reason = 'ATTEMPT_RESULT_RECORDED') AS rec, count(*) FILTER (WHERE reason = 'RESULT_CONSUMED') AS used FROM customer LEFT JOIN h ON k = c_custkey GROUP BY 1)",
    no_result_record="SELECT k FROM g WHERE rec IS NULL", not_the_last_revision="SELECT k FROM g WHERE rec <> last", consumed_at_hold="SELECT k FROM g WHERE used > 0"))
def receipt_at_hold(t: Tables):
    return counted(E.receipts_at_hold(t.customer.select(F.col("c_custkey").alias("k")), history(t), "k", "r"))


@query("K30", sql(HISTORY + """, b AS (SELECT k, r, owner, epoch, reason FROM h WHERE r = 3), f AS (SELECT k, epoch AS e2, owner AS o2 FROM h WHERE r = 3 AND k % 6 <> 0), u AS (SELECT k, r, owner, epoch FROM h WHERE reason = 'RESULT_CONSUMED' AND r BETWEEN 4 AND 5)""",
    receipt_changed="SELECT k FROM b LEFT JOIN f USING (k) WHERE epoch IS DISTINCT FROM e2 OR owner IS DISTINCT FROM o2", consumption="SELECT k FROM b WHERE (SELECT count(*) FROM u WHERE u.k = b.k) <> 1",
    not_the_next_revision="SELECT b.k FROM b JOIN u USING (k) WHERE u.r <> b.r + 1", epoch_not_advanced="SELECT b.k FROM b JOIN u USING (k) WHERE u.epoch <= b.epoch",
    owner_unchanged="SELECT b.k FROM b JOIN u USING (k) WHERE u.owner = b.owner"))
def receipt_after(t: Tables):
    h = history(t)
    before = h.where("r = 3").select("k", "r", "owner", "epoch")
    return counted(E.receipts_after(before, before.where("k % 6 <> 0"), h.where("r BETWEEN 4 AND 5"), "k", "r", ["epoch", "owner"]))


@query("K21", sql(
    "w AS (SELECT l_orderkey AS k, l_linenumber AS o, l_suppkey % 4 AS epoch, l_partkey % 3 AS ses FROM lineitem), t AS (SELECT o_orderkey AS k, 2 AS tm, 1 AS oe, o_custkey % 3 AS os FROM orders WHERE o_orderstatus = 'F')",
    old_epoch="SELECT k FROM w JOIN t USING (k) WHERE o > tm AND epoch <= oe", old_session="SELECT k FROM w JOIN t USING (k) WHERE o > tm AND ses = os"))
def stale_writes(t: Tables):
    writes = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("o"), (F.col("l_suppkey") % 4).alias("epoch"), (F.col("l_partkey") % 3).alias("session"))
    taken = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"), F.lit(2).alias("taken_at"), F.lit(1).alias("old_epoch"), (F.col("o_custkey") % 3).alias("old_session"))
    return counted(E.stale_writes_rejected(writes, taken, "k", "o"))


@query("K32", sql(
    """l AS (SELECT o_orderkey AS x, o_custkey % 9 AS epoch, o_orderpriority AS owner FROM orders), a AS (SELECT o_orderkey AS x, CASE WHEN o_orderkey % 64 = 1 THEN 99 ELSE o_custkey % 9 END AS epoch, o_orderpriority AS owner FROM orders WHERE o_orderkey % 45 <> 0),
c AS (SELECT event_id AS c, user_id % 5 AS e, 3 AS live, CASE WHEN event_id % 6 = 0 THEN 'APPLIED' WHEN user_id % 5 < 3 THEN 'STALE_EPOCH' WHEN event_id % 17 = 0 THEN 'STALE_EPOCH' ELSE 'APPLIED' END AS o FROM events)""",
    write_without_audit="SELECT x FROM l WHERE x NOT IN (SELECT x FROM a)", audit_differs="SELECT x FROM l JOIN a USING (x) WHERE a.epoch <> l.epoch OR a.owner <> l.owner",
    stale_call_not_rejected="SELECT c FROM c WHERE e < live AND o <> 'STALE_EPOCH'", live_call_rejected="SELECT c FROM c WHERE e >= live AND o = 'STALE_EPOCH'"))
def lease_commits(t: Tables):
    x = F.col("o_orderkey")
    leases = t.orders.select(x.alias("x"), (F.col("o_custkey") % 9).alias("epoch"), F.col("o_orderpriority").alias("owner"))
    audits = leases.where("x % 45 <> 0").withColumn("epoch", F.when(F.col("x") % 64 == 1, 99).otherwise(F.col("epoch")))
    k, e = F.col("event_id"), F.col("user_id") % 5
    calls = t.events.select(k.alias("call_id"), e.alias("epoch"), F.lit(3).alias("live_epoch"),
                            F.when(k % 6 == 0, "APPLIED").when((e < 3) | (k % 17 == 0), "STALE_EPOCH").otherwise("APPLIED").alias("outcome"))
    return counted(E.lease_commits(leases, audits, calls, "x", ["epoch", "owner"]))


@query("K35", sql(
    """a AS (SELECT user_id AS k, event_id AS e, event_type AS t FROM events), p AS (SELECT * FROM a WHERE t IN ('signup', 'view') AND e % 3 = 0), q AS (SELECT * FROM a WHERE t IN ('signup', 'click') AND e % 4 = 0), c AS (SELECT k FROM p WHERE t = 'signup' UNION ALL SELECT k FROM q WHERE t = 'signup'),
r AS (SELECT DISTINCT k FROM a WHERE t = 'error'), s AS (SELECT DISTINCT k FROM a WHERE t = 'error' AND e % 2 = 0 OR t = 'purchase')""",
    pending_and_published="SELECT DISTINCT k FROM p WHERE k IN (SELECT k FROM q)", created_event="SELECT c_custkey FROM customer WHERE (SELECT count(*) FROM c WHERE c.k = c_custkey) <> 1",
    lost_over_the_restart="SELECT k FROM r WHERE k NOT IN (SELECT k FROM s)", new_over_the_restart="SELECT k FROM s WHERE k NOT IN (SELECT k FROM r)"))
def backlog_evidence(t: Tables):
    a = t.events.select(F.col("user_id").alias("k"), "event_id", F.when(F.col("event_type") == "signup", "workflow.created").otherwise(F.col("event_type")).alias("event_type"))
    pending, published = a.where("event_type IN ('workflow.created', 'view') AND event_id % 3 = 0"), a.where("event_type IN ('workflow.created', 'click') AND event_id % 4 = 0")
    retained, restarted = a.where("event_type = 'error'").select("k").distinct(), a.where("event_type = 'error' AND event_id % 2 = 0 OR event_type = 'purchase'").select("k").distinct()
    return counted(E.backlog(pending, published, t.customer.select(F.col("c_custkey").alias("k")), retained, restarted, "k"))


@query("K36", sql(
    """o AS (SELECT o_orderkey AS k, epoch_us(o_orderdate) AS us, o_orderstatus AS s, o_totalprice AS p FROM orders WHERE o_custkey % 3 = 0), a AS (SELECT k FROM o WHERE s = 'F'), c AS (SELECT k FROM o WHERE s = 'F' AND k % 13 <> 0 OR k % 29 = 0),
b AS (SELECT k, CASE WHEN k % 11 <> 0 THEN us + 31536000000000 END AS tm FROM o WHERE s = 'P')""",
    offer_outside_the_window="SELECT k FROM o WHERE us < 852076800000000 OR us >= 883612800000000", accepted_but_not_counted="SELECT k FROM a WHERE k NOT IN (SELECT k FROM c)",
    counted_but_not_accepted="SELECT k FROM c WHERE k NOT IN (SELECT k FROM a)", published_before_the_boundary="SELECT k FROM b WHERE tm < 883612800000000", not_drained="SELECT k FROM b WHERE tm IS NULL"))
def restart_verdict(t: Tables):
    o = t.orders.where("o_custkey % 3 = 0").select(F.col("o_orderkey").alias("k"), C.micros(F.col("o_orderdate")).alias("us"), F.col("o_orderstatus").alias("s"))
    backlog = o.where("s = 'P'").withColumn("published_at", F.when(F.col("k") % 11 != 0, F.col("us") + 31536000000000))
    return counted(E.restart_cell(o, o.where("s = 'F'"), o.where("s = 'F' AND k % 13 <> 0 OR k % 29 = 0"), backlog, "k", "us", 852076800000000, 883612800000000))


@query("K25", sql(
    "p AS (SELECT c_custkey AS k, 100 * (c_custkey % 50) AS due FROM customer), s AS (SELECT o_custkey AS k, o_orderkey % 6000 AS tm FROM orders WHERE o_orderpriority = '1-URGENT')",
    stop_record="SELECT k FROM p WHERE (SELECT count(*) FROM s WHERE s.k = p.k) <> 1", unplanned_stop="SELECT k FROM s WHERE k NOT IN (SELECT k FROM p)",
    early_stop="SELECT p.k FROM p JOIN s USING (k) WHERE tm < due", late_stop="SELECT p.k FROM p JOIN s USING (k) WHERE tm > due + 1000"))
def stop_evidence(t: Tables):
    plan = t.customer.select(F.col("c_custkey").alias("k"), (100 * (F.col("c_custkey") % 50)).alias("due"))
    stops = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 6000).alias("at"))
    return counted(E.stop_schedule(stops, plan, "k", 1000))


@query("K39", """SELECT e.event_id, count(c.event_id) AS sessions FROM events e LEFT JOIN events c ON c.user_id = e.user_id AND c.event_type = 'view' AND epoch_us(c.ts) <= epoch_us(e.ts) AND epoch_us(e.ts) < epoch_us(c.ts) + 43200000000 * (1 + c.event_id % 3)
WHERE e.event_type = 'error' GROUP BY 1""")
def process_sessions(t: Tables):
    e = t.events.select("event_id", "user_id", "event_type", C.micros(F.col("ts")).alias("us"))
    sessions = e.where("event_type = 'view'").select("user_id", F.col("us").alias("began"), (F.col("us") + F.lit(43200000000) * (1 + F.col("event_id") % 3)).alias("ended"))
    return E.single_session(e.where("event_type = 'error'"), sessions, "user_id", "event_id", "us")


@query("K40", sql(
    """p AS (SELECT doc_id AS k, text AS c, n_chars AS n FROM documents WHERE text IS NOT NULL AND doc_id % 10 <> 0), s AS (SELECT doc_id AS k, strlen(text) + (doc_id % 17 = 1)::INT AS z, sha256(CASE WHEN doc_id % 19 = 2 THEN text || '!' ELSE text END) AS g, CASE WHEN doc_id % 23 = 3 THEN n_chars + 1 ELSE n_chars END AS m FROM documents WHERE text IS NOT NULL)""",
    no_prefix="SELECT k FROM s WHERE k NOT IN (SELECT k FROM p)", length="SELECT k FROM s JOIN p USING (k) WHERE strlen(c) <> z",
    digest="SELECT k FROM s JOIN p USING (k) WHERE strlen(c) = z AND sha256(c) <> g", rows="SELECT k FROM s JOIN p USING (k) WHERE n <> m"))
def seal_check(t: Tables):
    k, raw = F.col("doc_id"), F.col("text").cast("binary")
    d = t.documents.where("text IS NOT NULL")
    prefixes = d.where("doc_id % 10 <> 0").select(k.alias("k"), raw.alias("content"), F.col("n_chars").alias("rows"))
    other = F.when(k % 19 == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    sealed = d.select(k.alias("k"), (F.length(raw) + (k % 17 == 1).cast("int")).alias("size"), F.sha2(other, 256).alias("digest"), F.when(k % 23 == 3, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("lines"))
    return counted(E.seals(prefixes, sealed, "k"))


@query("K42", sql(
    "l AS (SELECT c_custkey AS k, 900000000000000 + 1000000 * c_custkey AS x, c_custkey % 4 AS e FROM customer WHERE c_custkey % 8 <> 0), t AS (SELECT o_custkey AS k, epoch_us(o_orderdate) AS tm, o_custkey % 4 + 1 + (o_orderkey % 25 = 0)::INT AS n, o_orderpriority <> '1-URGENT' AS c FROM orders)",
    no_lease="SELECT k FROM t WHERE k NOT IN (SELECT k FROM l)", epoch_step="SELECT k FROM t JOIN l USING (k) WHERE n <> e + 1", taken_before_expiry="SELECT k FROM t JOIN l USING (k) WHERE c AND tm < x"))
def lease_safety(t: Tables):
    k = F.col("c_custkey")
    leases = t.customer.where("c_custkey % 8 <> 0").select(k.alias("k"), (F.lit(900000000000000) + 1000000 * k).alias("expires"), (k % 4).alias("epoch"))
    taken = t.orders.select(F.col("o_custkey").alias("k"), C.micros(F.col("o_orderdate")).alias("at"), (F.col("o_custkey") % 4 + 1 + (F.col("o_orderkey") % 25 == 0).cast("int")).alias("new_epoch"), (F.col("o_orderpriority") != "1-URGENT").alias("checked"))
    return counted(E.mutual_exclusion(leases, taken, "k", F.col("checked")))


@query("B04", "SELECT o_orderkey FROM orders WHERE CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate END <= TIMESTAMP '1995-06-30'")
def due_deadlines(t: Tables):
    deadline = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate"))
    return t.orders.where(deadline.isNotNull() & (deadline <= F.lit("1995-06-30").cast("timestamp_ntz"))).select("o_orderkey")


@query("B05", "SELECT o_orderkey, TIMESTAMP '1997-06-01' < o_orderdate AS live FROM orders")
def live_grants(t: Tables):
    return t.orders.select("o_orderkey", (F.lit("1997-06-01").cast("timestamp_ntz") < F.col("o_orderdate")).alias("live"))


@query("B06", """SELECT o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderstatus = 'F' AND o_custkey % 4 = 1 AND o_orderkey % 3 <> 0 AND TIMESTAMP '1994-01-01' < o_orderdate""")
def exact_grants(t: Tables):
    c = F.col
    parts = (c("token"), c("intent"), c("target"), c("arguments"))
    grants = t.orders.select("o_orderkey", F.col("o_orderkey").cast("string").alias("token"), F.col("o_orderstatus").alias("intent"), F.col("o_orderpriority").alias("target"),
                             (F.col("o_custkey") % 4).cast("string").alias("arguments"), F.col("o_orderdate").alias("expires_at"))
    made = E.grant_scope(F.when(F.col("o_orderkey") % 3 == 0, F.lit("other")).otherwise(c("token")), *parts[1:])
    asked = {"target": "2-HIGH", "intent": "F", "arguments": "1"}
    return E.exact_grants(grants.withColumn("scope_hash", made), asked, E.grant_scope(*parts), F.lit("1994-01-01").cast("timestamp_ntz")).select("o_orderkey")


@query("B17", """SELECT coalesce(CASE WHEN o_orderstatus <> 'F' THEN 'state' WHEN o_orderkey % 3 = 0 THEN 'scope' WHEN NOT TIMESTAMP '1995-01-01' < o_orderdate THEN 'expired' WHEN o_custkey % 5 = 0 THEN 'target' END, 'valid') AS problem, count(*) AS n FROM orders GROUP BY 1""")
def grant_validation(t: Tables):
    k = F.col("o_orderkey")
    scope = E.grant_scope(k, F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_custkey"))
    stored = F.when(k % 3 == 0, F.lit("-")).otherwise(scope)
    wanted = F.when(F.col("o_custkey") % 5 == 0, F.lit("other")).otherwise(F.col("o_orderpriority"))
    problem = E.grant_problem(F.when(F.col("o_orderstatus") == "F", "GRANTED").otherwise("CANCELED"), scope, stored, F.col("o_orderdate"), F.col("o_orderpriority"), wanted, F.lit("1995-01-01").cast("timestamp_ntz"))
    return t.orders.select(F.coalesce(problem, F.lit("valid")).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


@query("B18", """SELECT o_custkey, min(o_orderkey) AS intent, epoch_us(max(o_orderdate)) AS until FROM orders WHERE o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate < TIMESTAMP '1996-06-01' AND o_orderstatus <> 'P' GROUP BY 1""")
def campaign_window(t: Tables):
    d, at = F.col("o_orderdate"), lambda x: F.lit(x).cast("timestamp_ntz")
    rows = t.orders.where((d >= at("1996-03-01")) & (d < at("1996-06-01")) & (F.col("o_orderstatus") != "P"))
    return rows.groupBy("o_custkey").agg(F.min("o_orderkey").alias("intent"), C.micros(F.max("o_orderdate")).alias("until"))


@query("C11", """WITH sampled AS (SELECT max(ts) AS now FROM events) SELECT event_id, epoch_us(now) - epoch_us(ts) AS age FROM events CROSS JOIN sampled WHERE event_type = 'signup'""")
def clock_cross(t: Tables):
    now = t.events.agg(F.max("ts").alias("now"))  # one row
    rows = t.events.where("event_type = 'signup'").select("event_id", "ts").join(F.broadcast(now))
    return rows.select("event_id", (C.micros(F.col("now")) - C.micros(F.col("ts"))).alias("age"))
