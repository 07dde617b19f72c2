"""Evidence rows and synthetic sources: what is left of inventory groups A and E."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import time as C
from ..operators import sequence as S
from ..sources import synthetic
from .base import Tables, query


@query("A44", """SELECT format('doc-{:03d}', i // 5) AS document_id, format('doc-{:03d}-c{}', i // 5, i % 5) AS chunk_id, 'v' || (i // 5 % 4 + 1)::VARCHAR AS version,
['checkout', 'search', 'billing', 'gateway', 'ledger'][(i // 5) % 5 + 1] AS service,
'runbook for ' || ['checkout', 'search', 'billing', 'gateway', 'ledger'][(i // 5) % 5 + 1] || ' when ' || ['latency', 'errors', 'saturation'][(i // 5) % 3 + 1] || ' step ' || (i % 5)::VARCHAR AS text FROM range(300) AS r(i)""")
def synthetic_corpus(t: Tables):
    return synthetic.corpus(t.spark)


@query("A45 M26", """SELECT format('q-{:03d}', i) AS query_id, CASE WHEN i < 40 THEN 'development' ELSE 'held_out' END AS split,
['checkout', 'search', 'billing', 'gateway', 'ledger'][i % 5 + 1] || ' ' || ['latency', 'errors', 'saturation'][i % 3 + 1] AS query, i % 4 <> 0 AS answerable FROM range(160) AS r(i)""")
def synthetic_queries(t: Tables):
    return synthetic.labelled_queries(t.spark)


NAMES = "['checkout', 'search', 'billing', 'gateway', 'ledger']"


@query("A60", f"""WITH c AS (SELECT {NAMES}[i // 6 + 1] AS family, i % 6 AS index, CASE WHEN i % 6 < 2 THEN 'development' ELSE 'heldout' END AS split FROM range(30) AS r(i))
SELECT substr(split, 1, 3) || '-' || substr(family, 1, 4) || '-0' || (index + 1)::VARCHAR AS case_id, family, index, split FROM c""")
def synthetic_cases(t: Tables):
    return synthetic.incident_cases(t.spark)


@query("A61", f"""WITH d AS (SELECT i, sha256('56:' || i::VARCHAR) AS h FROM range(160) AS r(i)), n AS (SELECT i, CAST('0x' || substr(h, 1, 4) AS BIGINT) % 5 AS a, CAST('0x' || substr(h, 5, 4) AS BIGINT) % 3 AS b, CAST('0x' || substr(h, 9, 4) AS BIGINT) % 4 + 1 AS v FROM d)
SELECT format('case-{{:03d}}', i) AS case_id, CASE WHEN i < 40 THEN 'development' ELSE 'heldout' END AS split, {NAMES}[a + 1] || '/v' || v || '/' || ['latency', 'errors', 'saturation'][b + 1] AS answer_key,
{NAMES}[a + 1] || '/v' || (v % 4 + 1) || '/' || ['latency', 'errors', 'saturation'][b + 1] AS distractor_key FROM n""")
def solvable_cases(t: Tables):
    return synthetic.solvable_cases(t.spark)


@query("A62", """WITH d AS (SELECT i, sha256(i::VARCHAR) AS h FROM range(100) AS r(i)), n AS (SELECT i AS seed, CAST('0x' || substr(h, 1, 4) AS BIGINT) % 100 AS n0, CAST('0x' || substr(h, 5, 4) AS BIGINT) % 100 AS n1, CAST('0x' || substr(h, 9, 4) AS BIGINT) % 100 AS n2,
CAST('0x' || substr(h, 13, 4) AS BIGINT) % 100 AS n3 FROM d) SELECT *, n0 + n1 + n2 + n3 AS total FROM n""")
def synthetic_workflows(t: Tables):
    return synthetic.seeded_workflow(t.spark, 100)


@query("E33", r"""SELECT user_id, min_by(k, (ts, event_id)) AS first, max_by(k, (ts, event_id)) AS last, max_by(k, (ts, event_id)) > min_by(k, (ts, event_id)) AS risen
FROM (SELECT *, CAST(regexp_extract(props, '(\d+)', 1) AS BIGINT) AS k FROM events) GROUP BY 1""")
def counter_rise(t: Tables):
    rows = t.events.select("user_id", "ts", "event_id", F.regexp_extract("props", r"(\d+)", 1).cast("long").alias("k"))
    o = F.struct("ts", "event_id")
    out = rows.groupBy("user_id").agg(F.min_by("k", o).alias("first"), F.max_by("k", o).alias("last"))
    return out.withColumn("risen", F.col("last") > F.col("first"))


@query("E38", """SELECT e.event_id, (SELECT min(epoch_us(p.ts)) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'view' AND p.ts > e.ts) IS NOT NULL AS restored FROM events e WHERE e.event_type = 'error'""")
def restoration_proof(t: Tables):
    e = t.events.select("event_id", "user_id", "event_type", C.micros(F.col("ts")).alias("us"))
    probes = e.where("event_type = 'view'").select("user_id", F.col("us").alias("at"))
    return S.first_after(e.where("event_type = 'error'"), probes, ["user_id"], "us", "at", []).select("event_id", F.col("asof_at").isNotNull().alias("restored"))


@query("A52", "SELECT event_id, user_id, (epoch_us(ts) - 1704067200000000) / 1000000.0 AS seconds FROM events WHERE event_type IN ('signup', 'error')")
def lease_audit_export(t: Tables):
    rows = t.events.where("event_type IN ('signup', 'error')").orderBy("event_id")
    return rows.select("event_id", "user_id", ((C.micros(F.col("ts")) - F.lit(1704067200000000)) / 1e6).alias("seconds"))


@query("A54 A57", """SELECT conv_id, count(*) AS events, min(turn) AS first_turn, max(turn) AS last_turn, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY 1""")
def session_rows(t: Tables):
    roles = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda r: r["role"])
    return t.conversations.groupBy("conv_id").agg(F.count("*").alias("events"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.array_join(roles, ",").alias("roles"))


@query("A58", """WITH a AS (SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem), b AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT a.l_orderkey, a.l_linenumber, a.l_suppkey, b.n = 1 AS exact FROM a JOIN b USING (l_orderkey, l_linenumber)""")
def durable_claims(t: Tables):
    n = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    return t.lineitem.join(n, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_suppkey", (F.col("n") == 1).alias("exact"))


@query("A59", """SELECT o.o_orderkey, (SELECT min(x.o_orderdate) FROM orders x WHERE x.o_custkey = o.o_custkey AND x.o_orderstatus = 'F' AND x.o_orderdate > o.o_orderdate) IS NOT NULL AS followed FROM orders o WHERE o.o_orderstatus = 'P'""")
def callback_rows(t: Tables):
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", C.micros(F.col("o_orderdate")).alias("us"))
    later = o.where("o_orderstatus = 'F'").select("o_custkey", F.col("us").alias("at"))
    return S.first_after(o.where("o_orderstatus = 'P'"), later, ["o_custkey"], "us", "at", []).select("o_orderkey", F.col("asof_at").isNotNull().alias("followed"))
