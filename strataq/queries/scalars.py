"""Scalar functions: inventory groups H and J."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import registry
from ..functions import text as T
from ..functions import time as C
from .base import Tables, query


@query("H01", """SELECT c_custkey, CAST(position(substr(sha256(c_name), 16, 1) IN '0123456789abcdef') - 1 AS INTEGER) AS part FROM customer""")
def partition_hash(t: Tables):
    return t.customer.select("c_custkey", H.partition_of(F.col("c_name")).alias("part"))


@query("H06 H07 H40", """SELECT o_orderkey, sha256(o_orderstatus || chr(0) || o_orderpriority || chr(0) || o_custkey::VARCHAR) AS proposal,
sha256(o_orderpriority || chr(0) || o_orderstatus || chr(0) || o_custkey::VARCHAR || chr(0) || o_orderkey::VARCHAR) AS scope FROM orders""")
def scope_hash(t: Tables):
    c = F.col
    return t.orders.select("o_orderkey", H.proposal_digest(c("o_orderstatus"), c("o_orderpriority"), c("o_custkey")).alias("proposal"),
                           H.scope_digest(c("o_orderpriority"), c("o_orderstatus"), c("o_custkey"), c("o_orderkey")).alias("scope"))


@query("H05", """SELECT a.event_id, json_extract_string(a.props, '$.k') = json_extract_string(b.props, '$.k') AS equal FROM events a
JOIN events b ON b.event_id = a.event_id + 1""")
def json_equality(t: Tables):
    b = t.events.select((F.col("event_id") - 1).alias("event_id"), F.col("props").alias("other"))
    return t.events.join(b, "event_id").select("event_id", H.json_equal(F.col("props"), F.col("other")).alias("equal"))


@query("H08 H09 G09", "SELECT doc_id, sha256(text) AS digest FROM documents")
def content_hash(t: Tables):
    return t.documents.select("doc_id", H.content_digest(F.col("text")).alias("digest"))


@query("H10 H11", """SELECT item_id, len(ts) AS n_tokens, array_to_string(list_sort(list_distinct(ts)), ' ') AS terms FROM (
SELECT item_id, regexp_extract_all(regexp_replace(lower(text), '[^ -~]', ' ', 'g'), '[a-z0-9_]+') AS ts FROM benchmark)""")
def tokens(t: Tables):
    clean = F.regexp_replace(F.lower("text"), "[^ -~]", " ")
    ts = T.tokens(clean)
    return t.benchmark.select("item_id", F.size(ts).cast("long").alias("n_tokens"), F.array_join(F.sort_array(F.array_distinct(ts)), " ").alias("terms"))


@query("H12 H13", """WITH d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS ts FROM documents)
SELECT doc_id, list_contains(ts, 'the') AND list_contains(ts, 'and') AS every, list_contains(ts, 'der') OR list_contains(ts, 'les') AS some FROM d""")
def token_match(t: Tables):
    d = t.documents.select("doc_id", T.token_set(F.col("text")).alias("ts"))
    words = lambda *w: F.array(*map(F.lit, w))
    return d.select("doc_id", T.matches_all(F.col("ts"), words("the", "and")).alias("every"), T.matches_any(F.col("ts"), words("der", "les")).alias("some"))


@query("H14", """WITH t AS (SELECT item_id, unnest(regexp_extract_all(regexp_replace(lower(text), '[^ -~]', ' ', 'g'), '[a-z0-9_]+')) AS t FROM benchmark),
h AS (SELECT item_id, CAST('0x' || substr(sha256(t), 1, 8) AS BIGINT) % 64 AS place,
CASE WHEN substr(sha256(t), 10, 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS s FROM t)
SELECT item_id, place, sum(s) AS weight FROM h GROUP BY 1, 2 HAVING sum(s) <> 0""")
def hash_embedding(t: Tables):
    clean = t.benchmark.select("item_id", F.regexp_replace(F.lower("text"), "[^ -~]", " ").alias("text"))
    return T.hashed_weights(clean, "item_id", "text")


@query("H15", """WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, q), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) /
(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(q, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS cosine
FROM embeddings, q""")
def cosine_to_first(t: Tables):
    q = t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return t.embeddings.join(F.broadcast(q)).select("vec_id", F.round(T.cosine(F.col("embedding"), F.col("q")), 6).alias("cosine"))


@query("H18 H19 D42", r"""SELECT doc_id, len(regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b')) AS email FROM documents
WHERE regexp_matches(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b')""")
def redaction(t: Tables):
    return t.documents.select("doc_id", T.redaction_counts(F.col("text"))["email"].cast("long").alias("email")).where("email > 0")


REDACTED = "text"
for _pattern, _mark in ((r"\b(?:sk|pk|token|secret)_[A-Za-z0-9_-]{8,}\b", "[REDACTED:SECRET]"), (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[REDACTED:EMAIL]"),
                        (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[REDACTED:IP]"), (r"\bCANARY_(?:SECRET|PII)_[A-Z0-9_-]+\b", "[REDACTED:CANARY]")):
    REDACTED = f"regexp_replace({REDACTED}, '{_pattern}', '{_mark}', 'g')"


@query("H18 H19", f"""WITH r AS (SELECT doc_id, {REDACTED} AS text FROM documents) SELECT doc_id, text, concat_ws(',', CASE WHEN contains(text, '[REDACTED:SECRET]') THEN 'secret' END, CASE WHEN contains(text, '[REDACTED:EMAIL]') THEN 'email' END,
CASE WHEN contains(text, '[REDACTED:IP]') THEN 'ip' END, CASE WHEN contains(text, '[REDACTED:CANARY]') THEN 'canary' END) AS leaks FROM r""")
def redacted_text(t: Tables):
    return t.documents.select("doc_id", T.redacted(F.col("text")).alias("text"), F.array_join(T.leak_categories(F.col("text")), ",").alias("leaks"))


@query("D42 H44", """SELECT doc_id, CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS BIGINT) AS hits,
contains(lower(text), 'licensed under') OR contains(lower(text), 'worthless') AS phrase FROM documents""")
def surface_measure(t: Tables):
    return t.documents.select("doc_id", T.occurrences(F.col("text"), "the").alias("hits"),
                              T.phrase_match(F.col("text"), ["licensed under", "worthless"]).alias("phrase"))


@query("H20 H46", """SELECT event_id, epoch_us(ts) * 1000 AS nanos FROM events""")
def stamp_parse(t: Tables):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return t.events.select("event_id", C.nanos_of(text).alias("nanos"))


@query("H21 H22", """SELECT o_orderkey, (epoch_us(TIMESTAMP '1998-08-02') - epoch_us(o_orderdate)) / 1000000.0 AS age,
epoch_us(o_orderdate + INTERVAL 90 SECOND) AS due FROM orders""")
def time_arithmetic(t: Tables):
    d = F.col("o_orderdate")
    return t.orders.select("o_orderkey", C.seconds_between(F.lit("1998-08-02").cast("timestamp_ntz"), d).alias("age"),
                           C.micros(C.plus_seconds(d, F.lit(90))).alias("due"))


@query("H23 H24", """SELECT event_id, user_id * 1000 + 7 - CAST(floor((event_id + event_id + 5) / 2) AS BIGINT) AS clock_offset,
CAST(3 AS BIGINT) AS half, event_id <= user_id AND user_id <= event_id + 5 AS held FROM events""")
def clock_probe(t: Tables):
    a, b, remote = F.col("event_id"), F.col("event_id") + 5, F.col("user_id") * 1000 + 7
    off, half = C.clock_offset(a, remote, b)
    return t.events.select("event_id", off.alias("clock_offset"), half.alias("half"), C.probe_holds(a, F.col("user_id"), b).alias("held"))


@query("H25 H26", """SELECT event_id, greatest(value - 50, 0) AS clamped, ceil(value * 2) / 2 AS half, ceil(value * 1000) / 1000 AS milli FROM events""")
def ceil_grid(t: Tables):
    v = F.col("value")
    return t.events.select("event_id", C.at_least_zero(v - 50).alias("clamped"), C.ceil_to(v, 2).alias("half"), C.ceil_to(v, 1000).alias("milli"))


@query("H29", """SELECT c_custkey, '00-' || substr(sha256(c_custkey::VARCHAR), 1, 32) || '-' || substr(sha256(c_custkey::VARCHAR), 33, 16) || '-01' AS trace,
c_name || '|' || c_nationkey::VARCHAR || '|' || c_mktsegment AS frame, true AS hex FROM customer""")
def derived_ids(t: Tables):
    k = F.col("c_custkey")
    return t.customer.select("c_custkey", H.traceparent(k).alias("trace"), H.pipe_frame(F.col("c_name"), F.col("c_nationkey"), F.col("c_mktsegment")).alias("frame"),
                             H.is_hex_digest(F.sha2(k.cast("string"), 256)).alias("hex"))


@query("H30 H31", """SELECT p_partkey, CAST(regexp_extract('v' || p_size::VARCHAR, '^v(\\d+)$', 1) AS INTEGER) AS version, p_brand AS brand, p_type AS kind FROM part""".replace("\\\\", "\\"))
def fact_parse(t: Tables):
    line = F.concat(F.lit("brand: "), F.col("p_brand"), F.lit(" | kind: old | kind: "), F.col("p_type"), F.lit("."))
    f = T.facts(line)
    return t.part.select("p_partkey", H.version_number(F.concat(F.lit("v"), F.col("p_size").cast("string"))).alias("version"), f["brand"].alias("brand"), f["kind"].alias("kind"))


@query("H32 M23", """SELECT o_custkey, min(o_orderstatus) AS o_orderstatus FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 1""")
def incident_key(t: Tables):
    from ..operators.retrieval import single_answer

    return single_answer(t.orders, ["o_custkey"], "o_orderstatus")


@query("H33 H34 H35", """SELECT n_nationkey AS node, n_nationkey + 1 AS missing FROM nation WHERE n_nationkey + 1 NOT IN (SELECT n_nationkey FROM nation)""")
def graph_references(t: Tables):
    nodes = t.nation.select(F.col("n_nationkey").alias("node"), F.array(F.col("n_nationkey") + 1).alias("next"))
    edges = nodes.select("node", F.explode("next").alias("missing"))
    return edges.join(nodes.select(F.col("node").alias("missing")), "missing", "left_anti").select("node", "missing")


@query("H38", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '{"status":"' || o_orderstatus || '"}' ELSE 'NO_PROPOSAL' END AS signature FROM orders""")
def proposal_signature(t: Tables):
    return t.orders.select("o_orderkey", H.signature(F.when(F.col("o_orderstatus") == "F", F.struct(F.col("o_orderstatus").alias("status")))).alias("signature"))


@query("H45", "SELECT event_id, json_extract_string(props, '$.k') IN ('1', '2', '3') AS declared FROM events")
def branch_choice(t: Tables):
    return t.events.select("event_id", F.array_contains(F.array(F.lit("1"), F.lit("2"), F.lit("3")), F.get_json_object("props", "$.k")).alias("declared"))


@query("J02 J03", "SELECT o_orderkey, o_custkey AS echoed, o_orderkey + o_custkey AS total FROM orders")
def pure_activities(t: Tables):
    return t.orders.select("o_orderkey", registry.echo(F.col("o_custkey")).alias("echoed"), registry.add(F.array("o_orderkey", "o_custkey")).alias("total"))


@query("J09 J10", "SELECT o_orderkey, TIMESTAMP '1997-01-01' < o_orderdate AS live FROM orders")
def sql_function(t: Tables):
    registry.register_sql(t.spark)
    return t.orders.select("o_orderkey", F.expr("grant_is_live(TIMESTAMP_NTZ'1997-01-01 00:00:00', o_orderdate)").alias("live"))
