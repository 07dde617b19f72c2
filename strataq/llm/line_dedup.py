"""Line dedup by site-relative frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, parallelism


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                ratio: float = 0.02, min_pages: int = 5, broadcast_rows: int = 50_000, copies_once: bool = False) -> DataFrame:
    """Drop the lines that more than `ratio` of a host's pages hold, on `min_pages` pages at least.

    Returns all columns of docs, with the text shortened, and n_lines, n_dropped (long; columns of docs of these names
    are replaced). Lines are compared without outer spaces; blank lines stay. A page counts once for a line that it
    repeats, and every occurrence goes. A null host is the host ''. A null text stays null with 0 lines; a text whose
    lines all go becomes ''. Repeated rows are pages of their own; an empty table gives an empty result.

    The lines of a page are made distinct inside its row, so counting needs one shuffle of (host, hash) with partial
    sums, which a hot host doesn't skew. A host has at most (mean lines a page) / ratio such lines. They are broadcast
    if counted to be at most `broadcast_rows`; else both sides are dealt by host and a salt.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    lines = F.split(F.col(text_col), "\n", -1)
    keys = F.transform(lines, lambda x: F.when(F.trim(x) != "", F.xxhash64(F.trim(x))))
    host = F.coalesce(F.col(host_col).cast("string"), F.lit(""))
    pages = docs.select(host.alias("h"), F.array_compact(F.array_distinct(keys)).alias("ks"))
    if copies_once:
        pages = pages.distinct()
    totals = pages.groupBy("h").agg(F.count("*").alias("total"))
    counts = pages.select("h", F.explode("ks").alias("k")).groupBy("h", "k").agg(F.count("*").alias("n"))
    common = counts.where(F.col("n") >= min_pages).join(totals, "h").where(F.col("n") > ratio * F.col("total"))
    common = cut(common.groupBy("h").agg(F.collect_list("k").alias("drop")).select(F.col("h").alias("_host"), "drop"))
    size = common.agg(F.coalesce(F.sum(F.size("drop")), F.lit(0)).alias("n")).first()["n"]
    # The arrays of this row are named after nothing that docs may hold.
    mark = "_strataq_line_dedup"
    rows = docs.select(F.struct(*names).alias(mark), host.alias("_host"),
                       (F.xxhash64(id_col, text_col) if size > broadcast_rows else F.lit(0)).alias("_salt"))
    if size <= broadcast_rows:
        rows = rows.join(F.broadcast(common), "_host", "left")
    else:
        salts = parallelism(spark)
        rows = rows.withColumn("_salt", F.pmod("_salt", F.lit(salts)).cast("int"))
        many = common.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        rows = rows.join(many, ["_host", "_salt"], "left")
    text = F.col(f"{mark}.`{text_col}`")
    parts = F.split(text, "\n", -1)
    key = lambda x: F.xxhash64(F.trim(x))
    hit = F.array_intersect(F.transform(parts, key), F.coalesce("drop", F.array().cast("array<bigint>")))
    kept = F.filter(parts, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("_hit"), key(x)))
    rows = rows.withColumn("_hit", F.coalesce(hit, F.array().cast("array<bigint>")))
    rows = rows.withColumn("_kept", F.when(F.size("_hit") > 0, kept).otherwise(parts))
    n = lambda a: F.coalesce(F.size(a), F.lit(0)).cast("long")
    total = F.when(text.isNull(), 0).otherwise(n(parts)).cast("long")
    left = F.when(text.isNull(), 0).otherwise(n("_kept")).cast("long")
    return rows.select(
        *(F.when(text.isNotNull(), F.array_join("_kept", "\n")).alias(c) if c == text_col else F.col(f"{mark}.`{c}`").alias(c)
          for c in names),
        total.alias("n_lines"), (total - left).alias("n_dropped"))


ORACLE = """
WITH l AS (
  SELECT doc_id, coalesce(source, '') AS host, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL),
t AS (SELECT coalesce(source, '') AS host, count(*) AS total FROM documents GROUP BY 1),
b AS (
  SELECT host, k FROM (
    SELECT host, trim(line, ' ') AS k, count(DISTINCT doc_id) AS n FROM l WHERE trim(line, ' ') <> '' GROUP BY 1, 2)
  JOIN t USING (host) WHERE n >= 5 AND n > 0.02 * total),
m AS (
  SELECT l.doc_id, l.pos, l.line, b.k IS NOT NULL AS gone
  FROM l LEFT JOIN b ON l.host = b.host AND trim(l.line, ' ') = b.k),
a AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text
  FROM m GROUP BY 1)
SELECT d.doc_id, coalesce(a.n_lines, 0) AS n_lines, coalesce(a.n_dropped, 0) AS n_dropped, a.text AS text
FROM documents d LEFT JOIN a USING (doc_id)
"""
