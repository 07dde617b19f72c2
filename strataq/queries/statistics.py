"""Statistics: inventory group L."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats as X
from ..operators.relational import if_small
from .base import Tables, query

WILSON = """greatest(0, (p + {z} * {z} / (2 * n)) / (1 + {z} * {z} / n) - {z} * sqrt(p * (1 - p) / n + {z} * {z} / (4 * n * n)) / (1 + {z} * {z} / n)) AS low,
least(1, (p + {z} * {z} / (2 * n)) / (1 + {z} * {z} / n) + {z} * sqrt(p * (1 - p) / n + {z} * {z} / (4 * n * n)) / (1 + {z} * {z} / n)) AS high""".replace("{z}", "1.959963984540054::DOUBLE")


@query("L01", """SELECT l_returnflag, quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.9) AS p90, quantile_disc(l_extendedprice, 0.95) AS p95,
quantile_disc(l_extendedprice, 0.99) AS p99 FROM lineitem GROUP BY 1""")
def nearest_rank(t: Tables):
    return t.lineitem.groupBy("l_returnflag").agg(*(X.nearest_rank("l_extendedprice", p).alias(n) for n, p in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))))


@query("L02 L03 L04", """SELECT o_orderpriority, round(median(o_totalprice), 6) AS mid, quantile_disc(o_totalprice, 0.5) AS low, list_sort(list(o_totalprice))[CAST(count(*) // 2 AS BIGINT) + 1] AS high FROM orders GROUP BY 1""")
def medians4(t: Tables):
    return t.orders.groupBy("o_orderpriority").agg(F.round(X.median_interpolated("o_totalprice"), 6).alias("mid"), X.median_low("o_totalprice").alias("low"), X.median_high("o_totalprice").alias("high"))


@query("L06", """WITH e AS (SELECT event_type, user_id % 3 AS arm, CASE WHEN value < 5 THEN NULL ELSE value END AS v FROM events)
SELECT event_type, arm, count(v) AS n, count(*) - count(v) AS missing, quantile_disc(v, 0.5) AS p50, quantile_disc(v, 0.9) AS p90, max(v) AS max,
CASE WHEN count(v) >= 200 AND arm <> 2 THEN quantile_disc(v, 0.99) END AS p99, CASE WHEN count(v) >= 200 AND arm <> 2 THEN 'OK' ELSE 'NOT ESTIMATED' END AS p99_status FROM e GROUP BY 1, 2""")
def population(t: Tables):
    e = t.events.select("event_type", (F.col("user_id") % 3).alias("arm"), F.when(F.col("value") >= 5, F.col("value")).alias("v"))
    return X.population(e, ["event_type", "arm"], "v", F.col("arm") == 2)


@query("L07", f"""WITH c AS (SELECT lang, count(*) FILTER (WHERE quality = 1) AS s, count(*)::DOUBLE AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1), d AS (SELECT lang, s / n AS p, n FROM c)
SELECT lang, round(low, 9) AS low, round(high, 9) AS high FROM (SELECT lang, {WILSON} FROM d)""")
def wilson(t: Tables):
    c = t.documents.select("doc_id", "lang").join(t.labels, "doc_id").groupBy("lang").agg(F.count_if(F.col("quality") == 1).alias("s"), F.count("*").alias("n"))
    low, high = X.wilson(F.col("s"), F.col("n"))
    return c.select("lang", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query("L08 L09 L17", """WITH p AS (SELECT l_returnflag AS family, l_linenumber AS repeat, quantile_disc(l_quantity, 0.95) AS p95, quantile_disc(l_quantity, 0.99) AS p99, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT family, CAST(sum(n) AS BIGINT) AS n, sum(n) >= 300 AS enough, ceil(greatest(2.5, 2 * max(p95) + 1) * 2) / 2 AS objective, ceil(1000 * 2 * max(p99)) / 1000 AS pilot FROM p GROUP BY 1""")
def slo(t: Tables):
    p = t.lineitem.groupBy(F.col("l_returnflag").alias("family"), "l_linenumber").agg(X.nearest_rank("l_quantity", 0.95).alias("p95"), X.nearest_rank("l_quantity", 0.99).alias("p99"), F.count("*").alias("n"))
    return p.groupBy("family").agg(F.sum("n").alias("n"), (F.sum("n") >= 300).alias("enough"), X.objective(F.max("p95")).alias("objective"), X.pilot_objective(F.max("p99")).alias("pilot"))


@query("L10", """SELECT event_type, round(4 / greatest(sum(CAST(value AS DECIMAL(18,2)))::DOUBLE / count(*), 0.01), 9) AS rate, round(sum(CAST(value AS DECIMAL(18,2)))::DOUBLE * 1.391, 4) AS planned,
round(greatest(max(value), 64) * 1.5 * 2, 6) AS need, greatest(max(value), 64) * 1.5 * 2 <= 4000 AS fits FROM events GROUP BY 1""")
def reference_rate(t: Tables):
    busy = X.exact_sum("value", 2).cast("double")
    need, fits = X.capacity(F.max("value"), 64, 4000)
    return t.events.groupBy("event_type").agg(F.round(X.reference_rate(busy, F.count("*")), 9).alias("rate"), F.round(busy * 1.391, 4).alias("planned"), F.round(need, 6).alias("need"), fits.alias("fits"))


@query("L12", """WITH m AS (SELECT p_size AS k, median(p_retailprice) AS m FROM part GROUP BY 1) SELECT coalesce(min(k) FILTER (WHERE m >= 1000), max(k)) AS k FROM m""")
def candidate(t: Tables):
    return X.candidate(t.part.groupBy(F.col("p_size").alias("k")).agg(F.median("p_retailprice").alias("m")), "k", "m", 1000.0)


@query("L13 L14 L16", """WITH m AS (SELECT user_id, median(value) AS m, sum(CAST(value AS DECIMAL(18,2)))::DOUBLE / 100 AS busy FROM events GROUP BY 1)
SELECT user_id, round(greatest(5, 0.1 * busy), 9) AS bound, m <= greatest(5, 0.1 * busy) AS go FROM m""")
def go_no_go(t: Tables):
    m = t.events.groupBy("user_id").agg(F.median("value").alias("m"), (X.exact_sum("value", 2).cast("double") / 100).alias("busy"))
    bound, go = X.excess(F.col("m"), F.col("busy"))
    return m.select("user_id", F.round(bound, 9).alias("bound"), go.alias("go"))


@query("L18 L19 L25", """WITH s AS (SELECT p_brand, min(p_retailprice) AS low, median(p_retailprice) AS mid, max(p_retailprice) AS high FROM part GROUP BY 1)
SELECT a.p_brand AS a, b.p_brand AS b, a.low > b.high OR b.low > a.high AS separated, round(a.mid - b.mid, 6) AS difference, round(a.mid / b.mid, 9) AS ratio FROM s a JOIN s b ON a.p_brand < b.p_brand""")
def effect_conclusion(t: Tables):
    s = t.part.groupBy("p_brand").agg(F.min("p_retailprice").alias("low"), F.median("p_retailprice").alias("mid"), F.max("p_retailprice").alias("high"))
    a, b = (s.select(*(F.col(c).alias(f"{n}_{c}") for c in s.columns)) for n in "ab")
    both = a.join(if_small(b), F.col("a_p_brand") < F.col("b_p_brand"))
    return both.select(F.col("a_p_brand").alias("a"), F.col("b_p_brand").alias("b"), X.separated(F.col("a_low"), F.col("a_high"), F.col("b_low"), F.col("b_high")).alias("separated"),
                       F.round(F.col("a_mid") - F.col("b_mid"), 6).alias("difference"), F.round(F.col("a_mid") / F.col("b_mid"), 9).alias("ratio"))


@query("L20 L23 L26", """WITH r AS (SELECT event_type, user_id, median(value) AS m FROM events GROUP BY 1, 2) SELECT event_type, count(*) AS runs, round(min(m), 6) AS low, round(median(m), 6) AS mid, round(max(m), 6) AS high FROM r GROUP BY 1""")
def range_over_runs(t: Tables):
    r = t.events.groupBy("event_type", "user_id").agg(F.median("value").alias("m"))
    return r.groupBy("event_type").agg(F.count("*").alias("runs"), F.round(F.min("m"), 6).alias("low"), F.round(F.median("m"), 6).alias("mid"), F.round(F.max("m"), 6).alias("high"))


@query("L22", "SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY sha256('7:' || s_suppkey::VARCHAR), s_suppkey) AS slot FROM supplier")
def balanced_schedule(t: Tables):
    from pyspark.sql import Window

    order = F.sha2(F.concat(F.lit("7:"), F.col("s_suppkey").cast("string")), 256)
    return t.supplier.select("s_suppkey", F.row_number().over(Window.partitionBy("s_nationkey").orderBy(order, "s_suppkey")).cast("long").alias("slot"))


@query("L30", """SELECT n_name, round(avg(c_acctbal) FILTER (WHERE c_mktsegment = 'BUILDING'), 6) AS building, round(avg(c_acctbal) FILTER (WHERE c_mktsegment = 'MACHINERY'), 6) AS machinery
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def headline_table(t: Tables):
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    out = rows.groupBy("n_name").pivot("c_mktsegment", ["BUILDING", "MACHINERY"]).agg(F.round(F.avg("c_acctbal"), 6))
    return out.withColumnsRenamed({"BUILDING": "building", "MACHINERY": "machinery"})
