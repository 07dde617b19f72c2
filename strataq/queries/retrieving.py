"""Retrieval and evaluation: inventory group M."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as R
from .base import Tables, query

CLEAN = "regexp_replace(lower(text), '[^ -~]', ' ', 'g')"
KEYWORD = f"""q AS (SELECT item_id AS query_id, regexp_extract_all({CLEAN}, '[a-z0-9_]+') AS ts FROM benchmark),
n AS (SELECT query_id, len(list_distinct(ts)) AS k, unnest(ts) AS t FROM q), d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all({CLEAN}, '[a-z0-9_]+'))) AS t FROM documents),
s AS (SELECT query_id, doc_id, round(count(*)::DOUBLE / any_value(k), 8) AS score, count(DISTINCT t) AS m, any_value(k) AS k FROM n JOIN d USING (t) GROUP BY 1, 2)"""
RANK = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {0})"
DENSE = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS u FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, c.label, q.label AS wanted, round(list_sum(list_transform(list_zip(q.u, c.u), lambda x: x[1] * x[2])), 8) AS score FROM v q, v c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)"""


def texts(t: Tables):
    # DuckDB's lower-case I with a dot is i alone; here it would be i and a combining dot, which splits a word.
    clean = F.regexp_replace(F.lower(F.replace("text", F.lit("\u0130"), F.lit("i"))), "[^ -~]", " ")
    return (t.benchmark.select(F.col("item_id").alias("query_id"), clean.alias("query")),
            t.documents.select("doc_id", clean.alias("text")))


def vectors(t: Tables):
    return t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), t.embeddings.select("vec_id", "embedding")


@query("M01 M02 M04", f"WITH {KEYWORD} SELECT query_id, doc_id, score, rank FROM (SELECT *, {RANK.format('doc_id')} AS rank FROM s) WHERE rank <= 5")
def keyword_search(t: Tables):
    q, d = texts(t)
    return R.keyword_search(q, d, "doc_id").withColumn("rank", F.col("rank").cast("long"))


@query("M01", f"WITH {KEYWORD} SELECT query_id, doc_id, score, rank FROM (SELECT *, {RANK.format('doc_id')} AS rank FROM s WHERE m = k) WHERE rank <= 5")
def keyword_every(t: Tables):
    q, d = texts(t)
    return R.keyword_search(q, d, "doc_id", every=True).withColumn("rank", F.col("rank").cast("long"))


@query("M05 F07 H15", f"WITH {DENSE} SELECT query_id, vec_id, score, rank FROM (SELECT query_id, vec_id, score, {RANK.format('vec_id')} AS rank FROM s) WHERE rank <= 5")
def dense_search(t: Tables):
    q, c = vectors(t)
    return R.dense_search(q, c, "vec_id", "embedding", exclude_self=True).withColumn("rank", F.col("rank").cast("long"))


@query("M02 M09", f"WITH {KEYWORD}, r AS (SELECT *, {RANK.format('doc_id')} AS rank FROM s) SELECT query_id, max(score) AS top, max(score) >= 0.75 AS sufficient FROM r WHERE rank <= 5 GROUP BY 1")
def sufficiency(t: Tables):
    q, d = texts(t)
    return R.gate(R.keyword_search(q, d, "doc_id"), 0.75)


MEASURES = f"""WITH {DENSE}, r AS (SELECT *, {RANK.format('vec_id')} AS rank FROM s), p AS (SELECT query_id, count(*) FILTER (WHERE label = wanted) AS relevant, count(*) FILTER (WHERE label = wanted AND rank <= 5) AS found,
min(rank) FILTER (WHERE label = wanted AND rank <= 5) AS first_rank FROM r GROUP BY 1)"""


def per_query(t: Tables):
    q, c = vectors(t)
    lab = t.embeddings.select("vec_id", "label")
    rel = lab.join(F.broadcast(lab.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label")), "label").where("query_id <> vec_id")
    return R.measures(q, R.dense_search(q, c, "vec_id", "embedding", exclude_self=True), rel, "vec_id")


@query("M10 M11 M12", MEASURES + """ SELECT query_id, relevant, found, first_rank, found > 0 AS hit, round(found / relevant::DOUBLE, 9) AS recall, round(coalesce(1.0::DOUBLE / first_rank, 0), 9) AS rr FROM p""")
def retrieval_measures(t: Tables):
    return per_query(t).select("query_id", "relevant", "found", F.col("first_rank").cast("long").alias("first_rank"), "hit", F.round("recall", 9).alias("recall"), F.round("rr", 9).alias("rr"))


@query("M13 M28 M29", MEASURES + """ SELECT query_id % 80 = 0 AS development, count(*) AS queries, count(*) FILTER (WHERE relevant > 0) AS answerable, round(count(*) FILTER (WHERE found > 0) / count(*)::DOUBLE, 6) AS hit_rate,
round(avg(found / relevant::DOUBLE), 6) AS recall, round(avg(found / relevant::DOUBLE), 6) AS recall_all, round(avg(coalesce(1.0::DOUBLE / first_rank, 0)), 6) AS mrr FROM p GROUP BY 1""")
def split_scores(t: Tables):
    return R.summary(per_query(t).withColumn("development", F.col("query_id") % 80 == 0), ["development"])


@query("M14 M15", f"""WITH {KEYWORD}, r AS (SELECT *, {RANK.format('doc_id')} AS rank FROM s), g AS (SELECT query_id, max(score) >= 0.75 AS ok, bool_or(doc_id % 2 = 1) AS distracted FROM r WHERE rank <= 5 GROUP BY 1)
SELECT count(*) FILTER (WHERE ok AND query_id % 2 = 1) / greatest(count(*) FILTER (WHERE query_id % 2 = 1), 1)::DOUBLE AS false_positive, count(*) FILTER (WHERE distracted) / greatest(count(*), 1)::DOUBLE AS distracted FROM g""")
def false_positive_rate(t: Tables):
    q, d = texts(t)
    g = R.keyword_search(q, d, "doc_id").groupBy("query_id").agg((F.max("score") >= 0.75).alias("ok"), F.bool_or(F.col("doc_id") % 2 == 1).alias("x"))
    odd = F.col("query_id") % 2 == 1
    return g.agg((F.count_if(F.col("ok") & odd) / F.greatest(F.count_if(odd), F.lit(1))).alias("false_positive"), (F.count_if("x") / F.greatest(F.count("*"), F.lit(1))).alias("distracted"))


GRID = """e AS (SELECT doc_id, quality = 1 AS truth, round(n_chars / 100.0, 0) AS score FROM documents JOIN labels USING (doc_id)), g AS (SELECT DISTINCT score AS threshold FROM e),
b AS (SELECT threshold, count(*) FILTER (WHERE truth AND score >= threshold) AS tp, count(*) FILTER (WHERE NOT truth AND score >= threshold) AS fp, count(*) FILTER (WHERE truth) AS p, count(*) FILTER (WHERE NOT truth) AS n FROM e, g GROUP BY 1)"""


def scored(t: Tables):
    return t.documents.select("doc_id", F.round(F.col("n_chars") / 100.0, 0).alias("score")).join(t.labels, "doc_id")


@query("M16", f"WITH {GRID} SELECT threshold::DOUBLE AS threshold, tp, fp, round((tp / p::DOUBLE + 1 - fp / n::DOUBLE) / 2, 8) AS balanced_accuracy FROM b")
def threshold_grid(t: Tables):
    e = scored(t)
    return R.threshold_grid(e, "score", F.col("quality") == 1, e.select(F.col("score").alias("threshold")).distinct())


@query("M20", f"WITH {GRID} SELECT threshold::DOUBLE AS threshold, tp, fp, round((tp / p::DOUBLE + 1 - fp / n::DOUBLE) / 2, 8) AS balanced_accuracy FROM b ORDER BY 4 DESC, fp, tp DESC, threshold LIMIT 1")
def best_threshold(t: Tables):
    e = scored(t)
    return R.best_threshold(R.threshold_grid(e, "score", F.col("quality") == 1, e.select(F.col("score").alias("threshold")).distinct()))


@query("M19", """SELECT count(*) AS candidates, max(threshold) > (SELECT max(value) FROM events) AS above FROM (SELECT DISTINCT value AS threshold FROM events UNION ALL SELECT max(value) * (1 + 1e-15) FROM events)""")
def threshold_candidates(t: Tables):
    c = R.threshold_candidates(t.events, "value")
    top = t.events.agg(F.max("value").alias("m"))
    return c.agg(F.count("*").alias("candidates"), F.max("threshold").alias("h")).join(F.broadcast(top)).select("candidates", (F.col("h") > F.col("m")).alias("above"))


DIGEST = "sha256(to_json({'doc_id': doc_id, 'digest': sha256(coalesce(text, ''))})::VARCHAR)"


@query("M24", "SELECT count(*) AS rows, count(DISTINCT doc_id) AS keys, " + ", ".join(
    f"CAST(sum(CAST('0x' || substr({DIGEST}, {1 + 8 * i}, 8) AS BIGINT)) AS BIGINT) AS digest_{i}" for i in range(4)) + " FROM documents")
def corpus_manifest(t: Tables):
    rows = t.documents.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"))
    return R.manifest(rows, "doc_id", "digest")


@query("M30", """SELECT item_id, count(*) AS n FROM benchmark GROUP BY 1 HAVING count(DISTINCT text) > 1""")
def query_map_conflicts(t: Tables):
    from ..operators.relational import conflicting

    return conflicting(t.benchmark, ["item_id"], ["text"]).select("item_id", F.col("identities").alias("n"))
