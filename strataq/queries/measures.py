"""Summaries, schedules and retrieval studies, a query for each: inventory groups D, H, J, L and M."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import registry
from ..functions import text as T
from ..functions import time as C
from ..operators import retrieval as R
from ..operators import stats as X
from ..plans import search
from .base import Tables, query
from .retrieving import KEYWORD, RANK, texts
from .statistics import WILSON


@query("D02", """WITH e AS (SELECT user_id % 16 AS part, event_type AS t, epoch_us(ts) AS us, value FROM events)
SELECT part, count(*) FILTER (WHERE t = 'signup') AS outbox, count(*) FILTER (WHERE t = 'view') AS inbox, count(*) FILTER (WHERE t = 'click') AS wakeups, count(*) FILTER (WHERE t = 'error') AS items,
count(*) FILTER (WHERE t = 'purchase' AND value > 50) AS attempts, (1709251200000000 - min(us)) / 1000000.0 AS oldest_age FROM e GROUP BY 1""")
def partition_counts(t: Tables):
    e, kind = t.events.withColumn("part", F.col("user_id") % 16), F.col("event_type")
    n = {"outbox": kind == "signup", "inbox": kind == "view", "wakeups": kind == "click", "items": kind == "error", "attempts": (kind == "purchase") & (F.col("value") > 50)}
    return e.groupBy("part").agg(*(F.count_if(c).alias(k) for k, c in n.items()), ((F.lit(1709251200000000) - F.min(C.micros(F.col("ts")))) / 1e6).alias("oldest_age"))


@query("D05", """SELECT n_nationkey, coalesce((883612800000000 - least((SELECT min(epoch_us(o_orderdate)) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = n_nationkey AND o_orderstatus = 'P' AND o_totalprice > 400000),
(SELECT min(epoch_us(l_shipdate)) FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey = n_nationkey AND l_quantity > 49))) / 1000000.0, 0) AS oldest_age FROM nation""")
def oldest_age(t: Tables):
    o = t.orders.where("o_orderstatus = 'P' AND o_totalprice > 400000").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(
        F.col("c_nationkey").alias("n_nationkey")).agg(C.micros(F.min("o_orderdate")).alias("a"))
    li = t.lineitem.where("l_quantity > 49").join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(
        F.col("s_nationkey").alias("n_nationkey")).agg(C.micros(F.min("l_shipdate")).alias("b"))
    both = t.nation.select("n_nationkey").join(o, "n_nationkey", "left").join(li, "n_nationkey", "left")
    return both.select("n_nationkey", F.coalesce((F.lit(883612800000000) - F.least("a", "b")) / 1e6, F.lit(0.0)).alias("oldest_age"))


@query("D29", """SELECT coalesce(l_returnflag, '*') AS arm, coalesce(l_shipmode, '*') AS family, count(*) AS n, quantile_disc(l_quantity, 0.5) AS p50 FROM (SELECT *, CASE l_linenumber % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS l_shipmode FROM lineitem)
GROUP BY GROUPING SETS ((l_returnflag), (l_returnflag, l_shipmode))""")
def arm_by_family(t: Tables):
    k = F.col("l_linenumber") % 3
    rows = t.lineitem.select(F.col("l_returnflag").alias("arm"), F.when(k == 0, "a").when(k == 1, "b").otherwise("c").alias("family"), "l_quantity")
    every = rows.withColumn("family", F.explode(F.array(F.lit("*"), "family")))
    return every.groupBy("arm", "family").agg(F.count("*").alias("n"), X.nearest_rank("l_quantity", 0.5).alias("p50"))


@query("D30", """WITH r AS (SELECT user_id % 6 AS cell, event_id % 37 = 0 AS missed, event_type = 'error' AS ambiguous, value FROM events)
SELECT cell, count(*) FILTER (WHERE NOT missed AND NOT ambiguous) AS accepted, count(*) FILTER (WHERE missed) AS missed, count(*) FILTER (WHERE ambiguous AND NOT missed) AS ambiguous, quantile_disc(value, 0.99) AS p99, max(value) AS worst,
concat_ws(',', CASE WHEN count(*) FILTER (WHERE missed) > 0 THEN 'missed' END, CASE WHEN count(*) FILTER (WHERE ambiguous AND NOT missed) > 30 THEN 'ambiguous' END, CASE WHEN quantile_disc(value, 0.99) > 50 THEN 'delay' END) AS reasons FROM r GROUP BY 1""")
def load_summary(t: Tables):
    missed, bad = F.col("event_id") % 37 == 0, F.col("event_type") == "error"
    out = t.events.groupBy((F.col("user_id") % 6).alias("cell")).agg(
        F.count_if(~missed & ~bad).alias("accepted"), F.count_if(missed).alias("missed"), F.count_if(bad & ~missed).alias("ambiguous"), X.nearest_rank("value", 0.99).alias("p99"), F.max("value").alias("worst"))
    return out.withColumn("reasons", F.concat_ws(",", F.when(F.col("missed") > 0, "missed"), F.when(F.col("ambiguous") > 30, "ambiguous"), F.when(F.col("p99") > 50, "delay")))


@query("D38", f"""WITH c AS (SELECT o_orderpriority AS setting, o_orderstatus AS failure, count(*)::DOUBLE AS n, count(*) FILTER (WHERE o_totalprice > 200000) AS s FROM orders GROUP BY 1, 2), d AS (SELECT setting, failure, n, s / n AS p FROM c)
SELECT setting, failure, CAST(n AS BIGINT) AS n, round(low, 9) AS low, round(high, 9) AS high FROM (SELECT setting, failure, n, {WILSON} FROM d)""")
def arm_by_condition(t: Tables):
    c = t.orders.groupBy(F.col("o_orderpriority").alias("setting"), F.col("o_orderstatus").alias("failure")).agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 200000).alias("s"))
    low, high = X.wilson(F.col("s"), F.col("n"))
    return c.select("setting", "failure", "n", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query("D28", """SELECT coalesce(lang, 'all') AS category, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS safe, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS correct, count(*) FILTER (WHERE quality = 0) AS abstained
FROM documents JOIN labels USING (doc_id) WHERE lang IS NOT NULL GROUP BY ROLLUP (lang)""")
def category_totals(t: Tables):
    q, x = F.col("quality"), F.col("toxic")
    rows = t.documents.where("lang IS NOT NULL").select("doc_id", "lang").join(t.labels, "doc_id")
    out = rows.rollup("lang").agg(F.count("*").alias("n"), F.count_if(q == 1).alias("safe"), F.count_if((q == 1) & (x == 0)).alias("correct"), F.count_if(q == 0).alias("abstained"))
    return out.select(F.coalesce("lang", F.lit("all")).alias("category"), "n", "safe", "correct", "abstained")


@query("D43", """WITH o AS (SELECT o_orderkey AS k, o_orderpriority AS arm, o_orderstatus AS s FROM orders), p AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'A')
SELECT arm, count(*) AS proposed, count(p.k) AS approved, count(*) FILTER (WHERE s = 'F') AS completed, count(*) FILTER (WHERE s = 'F' AND p.k IS NULL) AS unapproved FROM o LEFT JOIN p USING (k) GROUP BY 1""")
def approval_enforcement(t: Tables):
    p = t.lineitem.where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("ok", F.lit(True))
    rows, done, ok = t.orders.join(p, "o_orderkey", "left"), F.col("o_orderstatus") == "F", F.col("ok").isNotNull()
    return rows.groupBy(F.col("o_orderpriority").alias("arm")).agg(F.count("*").alias("proposed"), F.count_if(ok).alias("approved"), F.count_if(done).alias("completed"), F.count_if(done & ~ok).alias("unapproved"))


@query("M21", """SELECT user_id % 3 AS arm, event_type AS outcome, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY user_id % 3), 9) AS share, round(avg(value), 6) AS mean_cost FROM events GROUP BY 1, 2""")
def agent_summary(t: Tables):
    from pyspark.sql import Window

    n = t.events.groupBy((F.col("user_id") % 3).alias("arm"), F.col("event_type").alias("outcome")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_cost"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("arm")), 9))


@query("M27", """WITH o AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'P' THEN 'ABSTAINED' ELSE 'FAILED' END AS state, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey % 3 END AS expected, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey % 3 ELSE 9 END AS actual,
EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS receipt FROM orders)
SELECT state, count(*) FILTER (WHERE (state = 'ABSTAINED' AND expected IS NULL) OR (state = 'COMPLETED' AND actual IS NOT DISTINCT FROM expected AND receipt)) AS safe, count(*) AS n FROM o GROUP BY 1""")
def safe_outcomes(t: Tables):
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    r = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("receipt", F.lit(1))
    rows = t.orders.join(r, "o_orderkey", "left").select(
        F.when(s == "F", "COMPLETED").when(s == "P", "ABSTAINED").otherwise("FAILED").alias("state"), F.when(k % 4 != 0, F.col("o_custkey") % 3).alias("expected"),
        F.when(k % 5 != 0, F.col("o_custkey") % 3).otherwise(9).alias("actual"), "receipt")
    safe = X.safe_end_to_end(F.col("state"), F.col("expected"), F.col("actual"), F.col("receipt"))
    return rows.groupBy("state").agg(F.count_if(safe).alias("safe"), F.count("*").alias("n"))


@query("M22 D27", """WITH r AS (SELECT o_custkey % 2 AS profile, o_custkey AS k, o_orderkey % 3 AS c, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 4 END AS sig, CASE WHEN o_orderkey % 5 = 0 THEN 2 END AS wrong, CASE WHEN o_orderkey % 7 = 0 THEN 'ABSTAINED' ELSE 'COMPLETED' END AS st, o_orderkey % 2 AS dx, o_orderkey FROM orders),
f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY k, c ORDER BY o_orderkey) = 1),
w AS (SELECT a.profile, a.sig AS s1, b.sig AS s2, x.sig AS s3, x.wrong AS wr, x.st, a.dx AS d1, b.dx AS d2, x.dx AS d3 FROM f a JOIN f b USING (k) JOIN f x USING (k) WHERE a.c = 0 AND b.c = 1 AND x.c = 2), v AS (SELECT *, wr IS NOT NULL AND s3 IS NOT DISTINCT FROM wr AS attack FROM w), y AS (SELECT *, NOT attack AND s1 IS NOT NULL AND st = 'ABSTAINED' AS silent FROM v)
SELECT profile, count(*) AS cases, count(*) FILTER (WHERE s1 IS DISTINCT FROM s2) AS clean_changes, count(*) FILTER (WHERE s1 IS DISTINCT FROM s3) AS injected_changes, count(*) FILTER (WHERE s1 IS DISTINCT FROM s3) - count(*) FILTER (WHERE s1 IS DISTINCT FROM s2) AS excess,
count(*) FILTER (WHERE attack) AS attacks, count(*) FILTER (WHERE silent) AS abstentions, count(*) FILTER (WHERE NOT attack AND NOT silent AND s1 IS DISTINCT FROM s3) AS other_changes, count(*) FILTER (WHERE d1 <> d2) AS clean_divergence, count(*) FILTER (WHERE d1 <> d3) AS injected_divergence FROM y GROUP BY 1""")
def injection_matrix(t: Tables):
    k, c = F.col("o_orderkey"), F.col("o_orderkey") % 3
    rows = t.orders.select((F.col("o_custkey") % 2).alias("profile"), F.col("o_custkey").alias("case"), "o_orderkey", F.when(c == 0, "clean-a").when(c == 1, "clean-b").otherwise("injected").alias("condition"),
                           F.when(k % 7 != 0, k % 4).alias("signature"), F.when(k % 5 == 0, F.lit(2).cast("long")).alias("wrong"), F.when(k % 7 == 0, "ABSTAINED").otherwise("COMPLETED").alias("state"), (k % 2).alias("diagnosis"))
    first = rows.groupBy("profile", "case", "condition").agg(F.min_by(F.struct("signature", "wrong", "state", "diagnosis"), "o_orderkey").alias("r")).select("profile", "case", "condition", "r.*")
    return X.injections(first, "profile", "case")


@query("L15", """SELECT user_id % 3 AS arm, count(*) AS n, quantile_disc(value, 0.5) AS p50, round(count(*) FILTER (WHERE value <= 60) / count(*)::DOUBLE, 9) AS within, round(count(*) / 2592000.0, 12) AS per_second,
round(sum(CAST(value AS DECIMAL(18,2)))::DOUBLE / count(*), 9) AS cost FROM events GROUP BY 1""")
def episode_metrics(t: Tables):
    n = F.count("*")
    return t.events.groupBy((F.col("user_id") % 3).alias("arm")).agg(n.alias("n"), X.nearest_rank("value", 0.5).alias("p50"), F.round(F.count_if(F.col("value") <= 60) / n, 9).alias("within"),
                                                                     F.round(n / F.lit(2592000.0), 12).alias("per_second"), F.round(X.exact_sum("value", 2).cast("double") / n, 9).alias("cost"))


@query("L11", """WITH c AS (SELECT ['short', 'medium', 'long'][1 + i // 4] AS arm, i % 4 AS cell FROM range(12) r(i)), m AS (SELECT *, CASE arm WHEN 'short' THEN 0.5 WHEN 'medium' THEN 8.0 ELSE 40.0 END AS busy, CASE arm WHEN 'short' THEN 4.0 WHEN 'medium' THEN 0.5 ELSE 0.1 END AS r FROM c),
u AS (SELECT arm, cell, CASE WHEN cell = 0 THEN 1 / greatest(1.0, busy) ELSE 0.25 * r END::DOUBLE AS warm, CASE WHEN cell = 0 THEN 1 / greatest(1.0, busy) ELSE 0.5 * r END::DOUBLE AS measured FROM m)
SELECT arm, cell, round(warm, 9) AS warm, round(measured, 9) AS measured, round(1380 + 200 / measured, 6) AS seconds FROM u""")
def pilot_reservations(t: Tables):
    i = F.col("id")
    arm = F.element_at(F.array(*map(F.lit, ("short", "medium", "long"))), (F.floor(i / 4) + 1).cast("int"))
    cells = t.spark.range(12).select(arm.alias("arm"), (i % 4).alias("cell"))
    warm, measured = X.planned_rates(F.col("arm"), F.col("cell"), {"short": 0.5, "medium": 8.0, "long": 40.0}, {"short": 4.0, "medium": 0.5, "long": 0.1})
    return cells.select("arm", "cell", F.round(warm, 9).alias("warm"), F.round(measured, 9).alias("measured"), F.round(X.reservation(measured), 6).alias("seconds"))


@query("L21", """WITH RECURSIVE j AS (SELECT row_number() OVER (ORDER BY n_nationkey) AS i, (n_nationkey * 37) % 11 + 1.5 AS d FROM nation), p AS (SELECT 0::BIGINT AS i, -1.0::DOUBLE AS room, 0 AS job
UNION ALL SELECT j.i, CASE WHEN j.d > p.room THEN 20 - j.d ELSE p.room - j.d END, CASE WHEN j.d > p.room THEN p.job + 1 ELSE p.job END FROM p JOIN j ON j.i = p.i + 1)
SELECT job, count(*) AS units, sum(j.d)::DOUBLE + 3 AS seconds FROM p JOIN j USING (i) GROUP BY 1""")
def packed_jobs(t: Tables):
    d = [float((r["n_nationkey"] * 37) % 11 + 1.5) for r in t.nation.select("n_nationkey").orderBy("n_nationkey").collect()]
    jobs = [(k, len(job), sum(d[i] for i in job) + 3) for k, job in enumerate(X.next_fit(d, 20.0), 1)]
    return t.spark.createDataFrame(jobs, "job int, units long, seconds double")


@query("L24", r"""WITH s AS (SELECT l_returnflag AS f, l_linenumber AS n, min(l_quantity) AS a, median(l_quantity) AS m, max(l_quantity) AS z, count(*) AS c FROM lineitem GROUP BY 1, 2)
SELECT CASE WHEN c < 5 THEN f || '/' || n || 'ms unresolved' ELSE f || '/' || n || 'ms takeover' || printf(' %.1f ms [%.1f, %.1f]', m, a, z) END AS line FROM s""")
def recovery_lines(t: Tables):
    s = t.lineitem.groupBy("l_returnflag", "l_linenumber").agg(F.min("l_quantity").alias("a"), F.median("l_quantity").alias("m"), F.max("l_quantity").alias("z"), F.count("*").alias("c"))
    label = F.concat("l_returnflag", F.lit("/"), F.col("l_linenumber").cast("string"), F.lit("ms "))
    return s.select(F.when(F.col("c") < 5, F.concat(label, F.lit("unresolved"))).otherwise(X.range_text(F.concat(label, F.lit("takeover")), F.col("a"), F.col("m"), F.col("z"))).alias("line"))


@query("L27", """WITH e AS (SELECT CASE WHEN event_type = 'click' THEN 'short' ELSE 'long' END AS arm, CAST(floor(value) AS BIGINT) AS s FROM events)
SELECT round(sum(s) + 12 * 300.0 + 1710, 4)::DOUBLE AS frozen, round(sum(s) * 1.391046343::DOUBLE + 12 * 334.944495::DOUBLE + 1710, 4) AS inflated, round(sum(s * CASE WHEN arm = 'short' THEN 1.391 ELSE 1.063 END::DOUBLE) + 12 * 320.5 + 1710, 4)::DOUBLE AS volume_matched FROM e""")
def schedule_totals(t: Tables):
    e = t.events.select(F.when(F.col("event_type") == "click", "short").otherwise("long").alias("arm"), F.floor("value").alias("s"))
    out = X.sensitivities(e, "arm", "s", 12, 300.0, 320.5, 1710.0)
    return out.select(*(F.round(c, 4).alias(c) for c in out.columns))


@query("L28", """SELECT event_type, round(greatest(max(value), 64) * 3.0, 6) AS need, greatest(max(value), 64) * 3.0 <= 400 AS fits FROM events GROUP BY 1""")
def capacity_projection(t: Tables):
    need, fits = X.capacity(F.max("value"), 64, 400)
    return t.events.groupBy("event_type").agg(F.round(need, 6).alias("need"), fits.alias("fits"))


@query("L29", """SELECT user_id % 4 AS arm, event_type AS cell, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.99) AS p99, max(event_id % 50) AS polling_error, count(*) >= 200 AS enough FROM events GROUP BY 1, 2""")
def pilot_cells(t: Tables):
    rows = t.events.select((F.col("user_id") % 4).alias("arm"), F.col("event_type").alias("cell"), "value", (F.col("event_id") % 50).alias("error"))
    return X.cell_summary(rows, ["arm", "cell"], "value", "error")


QUERY4 = "array_to_string(regexp_extract_all(regexp_replace(lower(text), '[^ -~]', ' ', 'g'), '[a-z0-9_]+')[1:4], ' ')"
FULL_TEXT = """q AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(query, '[a-z0-9_]+'))) AS t FROM (SELECT item_id, {q} AS query FROM benchmark)), n AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS k FROM q),
d AS (SELECT doc_id, regexp_extract_all(regexp_replace(lower(text), '[^ -~]', ' ', 'g'), '[a-z0-9_]+') AS ts FROM documents), w AS (SELECT doc_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS at_ FROM d),
h AS (SELECT query_id, doc_id, t, k, list_sort(list_distinct(list(least(at_, 16383))))[1:256] AS ps FROM n JOIN w USING (t) GROUP BY 1, 2, 3, 4), f AS (SELECT *, count(*) OVER (PARTITION BY query_id, doc_id) AS m FROM h), g AS (SELECT * FROM f WHERE m = k),
p AS (SELECT query_id, doc_id, t, unnest(ps) AS x FROM g WHERE k > 1), c AS (SELECT a.query_id, a.doc_id, abs(a.x - b.x) AS z FROM p a JOIN p b ON a.query_id = b.query_id AND a.doc_id = b.doc_id AND a.t < b.t AND a.x <> b.x),
o AS (SELECT query_id, doc_id, unnest(ps) AS x, unnest(range(1, len(ps) + 1)) AS i FROM g WHERE k = 1),
s AS (SELECT query_id, doc_id, round(1 - exp(sum(ln(1 - 0.1::DOUBLE * sqrt(CASE WHEN z > 100 THEN 1e-30 ELSE 1.0 / (1.005 + 0.05 * exp(z / 1.5 - 2)) END)))), 6) AS score FROM c GROUP BY 1, 2
UNION ALL SELECT query_id, doc_id, round(sum(0.1::DOUBLE / (i * i)) / 1.64493406685, 6) FROM o GROUP BY 1, 2)""".replace("{q}", QUERY4)


def first_words(t: Tables):
    """Queries of the first four words of each test item."""
    q, d = texts(t)
    return q.select("query_id", F.array_join(F.slice(T.tokens(F.col("query")), 1, 4), " ").alias("query")), d


@query("M03 F06", f"WITH {FULL_TEXT} SELECT query_id, doc_id, score, rank FROM (SELECT *, {RANK.format('doc_id')} AS rank FROM s) WHERE rank <= 5")
def full_text(t: Tables):
    q, d = first_words(t)
    return R.full_text_search(q, d, "doc_id").withColumn("rank", F.col("rank").cast("long"))


HASHED = """x AS (SELECT 'q' AS side, item_id AS id, regexp_extract_all(regexp_replace(lower(text), '[^ -~]', ' ', 'g'), '[a-z0-9_]+') AS ts FROM benchmark UNION ALL SELECT 'd', doc_id, regexp_extract_all(regexp_replace(lower(text), '[^ -~]', ' ', 'g'), '[a-z0-9_]+') FROM documents),
y AS (SELECT side, id, unnest(ts) AS t FROM x), y2 AS (SELECT side, id, t, count(*) AS c FROM y GROUP BY 1, 2, 3), u AS (SELECT DISTINCT t, sha256(t) AS h FROM y2),
z AS (SELECT side, id, CAST('0x' || substr(h, 1, 8) AS BIGINT) % 64 AS place, sum(c * CASE WHEN substr(h, 10, 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS w FROM y2 JOIN u USING (t) GROUP BY 1, 2, 3),
nz AS (SELECT side, id, sqrt(sum(w * w)) AS norm FROM z GROUP BY 1, 2), e AS (SELECT a.id AS query_id, b.id AS doc_id, round(sum(a.w * b.w) / any_value(na.norm) / any_value(nb.norm), 8) AS score FROM z a JOIN z b ON a.place = b.place AND a.side = 'q' AND b.side = 'd'
JOIN nz na ON na.side = 'q' AND na.id = a.id JOIN nz nb ON nb.side = 'd' AND nb.id = b.id GROUP BY 1, 2)"""
FUSED = f"""{KEYWORD}, {HASHED}, ak AS (SELECT * FROM (SELECT query_id, doc_id, score, {RANK.format('doc_id')} AS rank FROM s) WHERE rank <= 5),
ad AS (SELECT * FROM (SELECT query_id, doc_id, score, {RANK.format('doc_id')} AS rank FROM e) WHERE rank <= 5),
fu AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score FROM (SELECT query_id, doc_id, rank FROM ak UNION ALL SELECT query_id, doc_id, rank FROM ad) GROUP BY 1, 2)"""


@query("M06", f"WITH {FUSED} SELECT query_id, doc_id, score, rank FROM (SELECT *, {RANK.format('doc_id')} AS rank FROM fu) WHERE rank <= 5")
def rank_fusion(t: Tables):
    """Keyword and dense arms over the same documents, fused."""
    q, d = texts(t)
    return search.rankings(q, d, "doc_id")["hybrid"].withColumn("rank", F.col("rank").cast("long"))


@query("M07", f"""WITH {FUSED}, ok AS (SELECT query_id FROM ak GROUP BY 1 HAVING max(score) >= 0.75 UNION SELECT query_id FROM ad GROUP BY 1 HAVING max(score) >= 0.45)
SELECT query_id, doc_id, score, rank FROM (SELECT *, {RANK.format('doc_id')} AS rank FROM fu) WHERE rank <= 5 AND query_id IN (SELECT query_id FROM ok)""")
def hybrid_delivery(t: Tables):
    q, d = texts(t)
    return search.search(q, d, "doc_id", "hybrid").select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query("M08", "SELECT item_id AS query_id, 0 AS delivered, false AS sufficient, 'no_retrieval_arm' AS reason FROM benchmark")
def control_arm(t: Tables):
    """What each query gets of the control arm: nothing, as a response of its own."""
    return search.control(t.benchmark.select(F.col("item_id").alias("query_id")))


PER_QUERY = """q AS (SELECT n_nationkey AS id, n_nationkey % 4 <> 0 AS answerable, (n_nationkey * 7 % 11) / 10.0::DOUBLE AS ks, (n_nationkey * 5 % 13) / 12.0::DOUBLE AS ds, (n_nationkey % 3) / 2.0::DOUBLE AS kr, (n_nationkey % 5) / 4.0::DOUBLE AS dr, 1.0::DOUBLE AS hr FROM nation)"""
JOINT = PER_QUERY + """, a AS (SELECT DISTINCT ks AS x FROM q UNION ALL SELECT max(ks) + greatest(abs(max(ks)), 1e-300) * 2.0 ** -52 FROM q), b AS (SELECT DISTINCT ds AS y FROM q UNION ALL SELECT max(ds) + greatest(abs(max(ds)), 1e-300) * 2.0 ** -52 FROM q),
r AS (SELECT x, y, answerable AS an, ks >= x AS k, ds >= y AS d, ks >= x OR ds >= y AS h, kr, dr, hr FROM q, a, b), g AS (SELECT x, y, count(*) FILTER (WHERE an)::DOUBLE AS yes, count(*) FILTER (WHERE NOT an)::DOUBLE AS no, count(*) FILTER (WHERE an AND k) AS tk, count(*) FILTER (WHERE an AND d) AS td, count(*) FILTER (WHERE an AND h) AS th,
count(*) FILTER (WHERE NOT an AND k) AS fk, count(*) FILTER (WHERE NOT an AND d) AS fd, count(*) FILTER (WHERE NOT an AND h) AS fh, coalesce(sum(kr) FILTER (WHERE an AND k), 0) AS rk, coalesce(sum(dr) FILTER (WHERE an AND d), 0) AS rd, coalesce(sum(hr) FILTER (WHERE an AND h), 0) AS rh FROM r GROUP BY 1, 2),
v AS (SELECT x, y, round(((tk / yes + 1 - fk / no) / 2 + (td / yes + 1 - fd / no) / 2 + (th / yes + 1 - fh / no) / 2) / 3, 8) AS accuracy, round((fk + fd + fh) / no, 8) AS false_positives, round((rk + rd + rh) / yes / 3, 8) AS recall FROM g)"""


@query("M17", f"WITH {JOINT} SELECT x AS keyword_threshold, y AS dense_threshold, accuracy, false_positives, recall FROM v ORDER BY accuracy DESC, false_positives, recall DESC, x, y LIMIT 1")
def joint_thresholds(t: Tables):
    n = F.col("n_nationkey")
    q = t.nation.select((n % 4 != 0).alias("answerable"), (n * 7 % 11 / 10.0).alias("keyword_score"), (n * 5 % 13 / 12.0).alias("dense_score"),
                        (n % 3 / 2.0).alias("keyword_recall"), (n % 5 / 4.0).alias("dense_recall"), F.lit(1.0).alias("hybrid_recall"))
    return R.best_pair(R.joint_grid(q, ("keyword", "dense")))


ARMS = """a AS (SELECT p_brand AS query_id, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part), b AS (SELECT p_brand AS query_id, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS rank FROM part),
g AS (SELECT * FROM (VALUES (3), (5)) t(top_k), (VALUES (2), (10)) e(ef), (VALUES (30), (60), (90)) r(rrf_k)), u AS (SELECT g.*, query_id, p_partkey, rank FROM a, g WHERE rank <= top_k UNION ALL SELECT g.*, query_id, p_partkey, rank FROM b, g WHERE rank <= top_k AND rank <= ef),
c AS (SELECT top_k, ef, rrf_k, query_id, p_partkey, round(sum(1.0::DOUBLE / (rrf_k + rank)), 8) AS score FROM u GROUP BY 1, 2, 3, 4, 5), f AS (SELECT *, row_number() OVER (PARTITION BY top_k, ef, rrf_k, query_id ORDER BY score DESC, p_partkey) AS rank FROM c QUALIFY rank <= top_k)"""


def setting_candidates(t: Tables):
    part = t.part.select(F.col("p_brand").alias("query_id"), "p_partkey", "p_retailprice", "p_size")
    arm = lambda c: R.ranked(part.select("query_id", "p_partkey", F.col(c).alias("score")), 10, "p_partkey").select("query_id", "p_partkey", "rank")
    grid = t.spark.createDataFrame([(k, e, r) for k in (3, 5) for e in (2, 10) for r in (30, 60, 90)], "top_k int, ef int, rrf_k int")
    return R.candidates(arm("p_retailprice"), arm("p_size"), "p_partkey", grid)


@query("M25", f"WITH {ARMS} SELECT top_k, ef, rrf_k, query_id, p_partkey, score, rank FROM f")
def grid_candidates(t: Tables):
    return setting_candidates(t).withColumn("rank", F.col("rank").cast("long"))


@query("M18", f"""WITH {ARMS}, n AS (SELECT p_brand AS query_id, p_partkey FROM part WHERE p_partkey % 3 = 0), k AS (SELECT query_id, count(*) AS need FROM n GROUP BY 1), h AS (SELECT top_k, ef, rrf_k, query_id, count(*) AS found, min(rank) AS first FROM f JOIN n USING (query_id, p_partkey) GROUP BY 1, 2, 3, 4),
s AS (SELECT g.top_k, g.ef, g.rrf_k, round(avg(coalesce(found, 0) / need::DOUBLE), 8) AS recall, round(avg(coalesce(1.0::DOUBLE / first, 0)), 8) AS mrr FROM g CROSS JOIN k LEFT JOIN h ON h.top_k = g.top_k AND h.ef = g.ef AND h.rrf_k = g.rrf_k AND h.query_id = k.query_id GROUP BY 1, 2, 3)
SELECT top_k, ef, rrf_k, recall, mrr FROM s ORDER BY recall DESC, mrr DESC, top_k, ef, abs(rrf_k - 60), rrf_k LIMIT 1""")
def best_parameters(t: Tables):
    relevant = t.part.where("p_partkey % 3 = 0").select(F.col("p_brand").alias("query_id"), "p_partkey")
    return R.best_setting(setting_candidates(t), relevant, "p_partkey")


CANONICAL = """sha256('{"a":{"k":' || json_extract_string(props, '$.k') || '},"b":[1.0,"x"]}')"""


def proposals(t: Tables):
    """JSON with keys out of order and space in it."""
    return t.events.select("event_id", F.concat(F.lit('{"b": [1.0, "x"], "a": '), F.col("props"), F.lit(" }")).alias("json"))


@query("H02", f"SELECT event_id, {CANONICAL} AS hash FROM events")
def canonical_json(t: Tables):
    return proposals(t).select("event_id", H.canonical_digest_udf()(F.col("json")).alias("hash"))


@query("H03", f"SELECT event_id, 'sub-v1:' || {CANONICAL} AS hash FROM events")
def submission_hash(t: Tables):
    return proposals(t).select("event_id", H.submission_digest(H.canonical_digest_udf()(F.col("json"))).alias("hash"))


@query("H39", f"SELECT event_id, sha256(event_type || chr(0) || {CANONICAL} || chr(0) || user_id::VARCHAR) AS hash FROM events")
def proposal_hash(t: Tables):
    rows = t.events.select("event_id", "event_type", "user_id").join(proposals(t), "event_id")
    return rows.select("event_id", H.proposal_digest(F.col("event_type"), H.canonical_digest_udf()(F.col("json")), F.col("user_id")).alias("hash"))


@query("H41", "SELECT event_id, event_id % 8 IN (0, 5) AS valid FROM events")
def argument_domain(t: Tables):
    """Arguments of whole numbers within 2^53 alone, none written -0, and no key twice, at any depth."""
    k = F.col("event_id") % 8
    texts_ = ('{"a": [1, "x", null, true]}', '{"a": 1.5}', '{"a": {"b": -0}}', '{"a": 1, "a": 2}', '{"a": [9007199254740992]}', '{"a": {"b": -9007199254740991}}', '{"a": 1e3}', "{torn")
    json_ = F.element_at(F.array(*map(F.lit, texts_)), (k + 1).cast("int"))
    return t.events.select("event_id", H.plain_arguments_udf()(json_).alias("valid"))


@query("H16", "SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: printf('%.9g', x::DOUBLE)), ',') || ']' AS vector FROM embeddings")
def vector_text(t: Tables):
    return t.embeddings.select("vec_id", T.vector_literal(F.col("embedding")).alias("vector"))


@query("H28", "SELECT count(*) AS ids, true AS formed, count(*) AS different FROM orders")
def random_ids(t: Tables):
    """Random identifiers: as many different ones as rows, all of version 4."""
    ids = t.orders.select(F.uuid().alias("id"))
    form = F.col("id").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")
    return ids.agg(F.count("*").alias("ids"), F.bool_and(form).alias("formed"), F.count_distinct("id").alias("different"))


@query("H37", "SELECT c_custkey, c_name || '|' || c_nationkey::VARCHAR || '|' || coalesce(CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END, '') AS frame FROM customer")
def pipe_frames(t: Tables):
    return t.customer.select("c_custkey", H.pipe_frame(F.col("c_name"), F.col("c_nationkey"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment"))).alias("frame"))


@query("H42", "SELECT l_orderkey, l_linenumber, l_orderkey::VARCHAR || '/' || l_linenumber::VARCHAR || '/' || l_returnflag AS key, count(*) AS n FROM lineitem GROUP BY 1, 2, 3")
def attempt_keys(t: Tables):
    """Keys by struct, which no separator in a part can confuse, and as text for reports."""
    rows = t.lineitem.groupBy(F.struct("l_orderkey", "l_linenumber", "l_returnflag").alias("k")).agg(F.count("*").alias("n"))
    return rows.select("k.l_orderkey", "k.l_linenumber", F.concat_ws("/", "k.l_orderkey", "k.l_linenumber", "k.l_returnflag").alias("key"), "n")


@query("H43", "SELECT s_suppkey, s_suppkey % 4 = 0 AS valid FROM supplier")
def hex_digests(t: Tables):
    h, k = F.sha2(F.col("s_suppkey").cast("string"), 256), F.col("s_suppkey") % 4
    text = F.when(k == 0, h).when(k == 1, F.substring(h, 1, 63)).when(k == 2, F.concat(F.substring(h, 1, 63), F.lit("g"))).otherwise(F.lit(None).cast("string"))
    return t.supplier.select("s_suppkey", H.is_hex_digest(text).alias("valid"))


def nested(text: str, rounds: int, body: str) -> str:
    for i in range(rounds):
        text = body.replace("{x}", text).replace("{i}", str(i))
    return text


@query("J04", f"SELECT n_nationkey, {nested('encode(n_name)', 5, 'unhex(sha256({x}))').removeprefix('unhex(')[:-1]} AS digest FROM nation")
def hash_rounds(t: Tables):
    return t.nation.select("n_nationkey", registry.default_activities().column("cpu_work", 1)(F.col("n_name"), 5).alias("digest"))


@query("J05", """WITH RECURSIVE b AS (SELECT n_nationkey, 0 AS r, string_agg(printf('%02x', ((n_nationkey + i) % 256)::INT), '' ORDER BY i) AS h FROM nation, range(256) t(i) GROUP BY 1
UNION ALL SELECT n_nationkey, r + 1, sha256(unhex(h)) || substr(h, 65) FROM b WHERE r < 3) SELECT n_nationkey, substr(h, 1, 64) AS digest FROM b WHERE r = 3""")
def block_hash(t: Tables):
    return t.nation.select("n_nationkey", registry.default_activities().column("sha256_workload", 1)(F.col("n_nationkey"), 3).alias("digest"))


@query("J06", f"SELECT n_nationkey, {nested('sha256(n_name)', 4, chr(115) + 'ha256({x} || chr(58) || {i})')} AS digest FROM nation")
def digest_chain(t: Tables):
    return t.nation.select("n_nationkey", registry.default_activities().column("chunk_digest", 1)(F.col("n_name"), 4).alias("digest"))


SHIFTS = """x AS (SELECT n_nationkey AS k, 0 AS r, greatest(n_nationkey, 1)::HUGEINT AS v FROM nation UNION ALL SELECT k, r + 1, xor(c, (c << 17) & 18446744073709551615) FROM (SELECT k, r, xor(b, b >> 7) AS c FROM (SELECT k, r, xor(v, (v << 13) & 18446744073709551615) AS b FROM x)) WHERE r < 16)"""


@query("J07", f"WITH RECURSIVE {SHIFTS} SELECT k AS n_nationkey, CASE WHEN v >= 9223372036854775808 THEN v - 18446744073709551616 ELSE v END::BIGINT AS value FROM x WHERE r = 16")
def shift_rounds(t: Tables):
    return t.nation.select("n_nationkey", registry.default_activities().column("busy_work", 1)(F.col("n_nationkey"), 16).alias("value"))


@query("J01 J08", "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN sha256(unhex(sha256(s_suppkey::VARCHAR))) WHEN 1 THEN sha256(sha256(sha256(s_suppkey::VARCHAR) || ':0') || ':1') END AS result FROM supplier")
def run_activities(t: Tables):
    """Each row names its activity by name and version; a name that isn't registered gives null."""
    k = F.col("s_suppkey")
    name = F.when(k % 3 == 0, "cpu_work@1").when(k % 3 == 1, "chunk_digest@1").otherwise("cpu_work@2")
    known = registry.Activities()
    known.register("cpu_work", 1, registry.sha_rounds)
    known.register("chunk_digest", 1, registry.chunk_chain)
    return t.supplier.select("s_suppkey", known.run(name, k, F.lit(2)).alias("result"))


@query("J11", "SELECT event_id, event_id % 6 IN (0, 3) AS allowed FROM events")
def tool_gate(t: Tables):
    text = lambda **kw: F.create_map(*(F.lit(x).cast("string") for kv in kw.items() for x in kv))
    calls = [("search", text(query="q", arm="dense")), ("search", text(query="q")), ("drop", text(table="t")), ("query_logs", text(run_id="r", case_id="c", service="s", level="error")),
             ("search", text(query="q", arm="dense", other="x")), ("remediation_status", text(run_id="r", resource_id=None))]
    at = (F.col("event_id") % 6 + 1).cast("int")
    method, arguments = F.element_at(F.array(*(F.lit(m) for m, _ in calls)), at), F.element_at(F.array(*(a for _, a in calls)), at)
    return t.events.select("event_id", registry.gate(method, arguments).alias("allowed"))


@query("J12", "SELECT l_returnflag, quantile_disc(l_extendedprice, 0.9) AS p90 FROM lineitem GROUP BY 1")
def aggregate_function(t: Tables):
    """A registered aggregate, from SQL."""
    registry.register_sql(t.spark)
    t.lineitem.select("l_returnflag", "l_extendedprice").createOrReplaceTempView("strataq_lines")
    return t.spark.sql("SELECT l_returnflag, nearest_rank(l_extendedprice, 0.9D) AS p90 FROM strataq_lines GROUP BY l_returnflag")
