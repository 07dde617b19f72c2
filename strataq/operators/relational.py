"""Selections, joins, aggregates and sets over workflow-style tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000


def lookup(df: DataFrame, **keys: object) -> DataFrame:
    """Rows whose columns equal the given values; the filter reaches the scan."""
    for name, value in keys.items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def page_after(df: DataFrame, key: str, cursor: object, limit: int) -> DataFrame:
    """The next `limit` rows by key after a cursor."""
    return df.where(F.col(key) > F.lit(cursor)).orderBy(key).limit(limit)


def first_rows(df: DataFrame, order: Sequence[str | Column], limit: int) -> DataFrame:
    return df.orderBy(*order).limit(limit)


def claimable(state: Column, expiry: Column, due: Column, as_of: Column) -> Column:
    """PENDING, or CLAIMED with a claim that has run out; and due by now."""
    open_ = (state == "PENDING") | ((state == "CLAIMED") & (expiry <= as_of))
    return open_ & (due.isNull() | (due <= as_of))


def global_or(column: Column, value: object) -> Column:
    """Rows of a partition, and those that belong to all."""
    return (column == F.lit(value)) | column.isNull()


def bounded_label(column: Column, known: Iterable[str], other: str = "other") -> Column:
    return F.when(column.isin(*known), column).otherwise(F.lit(other))


def having(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(right.select(*on), list(on), "left_semi")


def lacking(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(right.select(*on), list(on), "left_anti")


def restrict(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of some ids. A list counted to be short is broadcast, a longer one is shuffled."""
    ids = ids.select(key).distinct()
    small = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(ids) if small else ids, key, "left_semi")


def if_small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """df, to be broadcast if it is counted to have at most `most` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def either_exists(df: DataFrame, key: str, others: Sequence[DataFrame]) -> DataFrame:
    """Rows with a match in any of some tables: one semi-join with the union of their keys."""
    keys = others[0].select(key)
    for o in others[1:]:
        keys = keys.unionByName(o.select(key))
    return df.join(keys, key, "left_semi")


def latest(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest order in each group, by an aggregate: no group is sorted."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_best"))
    return best.select(*key, *(F.col(f"_best.{c}").alias(c) for c in rest))


def with_latest(left: DataFrame, right: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """left with the newest row of right for each key, kept where there is none."""
    return left.join(latest(right, key, order), list(key), "left")


def top_per_group(df: DataFrame, key: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col(rank) <= k)


def between_self_join(df: DataFrame, key: str, order: str, start: Column, middle: Column, end: Column) -> DataFrame:
    """Rows `end` of a key that have a `middle` row strictly between themselves and a `start` row.

    The earliest start and the latest middle before each row decide, so one window pass replaces the self-join.
    """
    w = Window.partitionBy(key).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("_start", F.min(F.when(start, F.col(order))).over(before))
    out = out.withColumn("_middle", F.max(F.when(middle, F.col(order))).over(before))
    return out.where(end & (F.col("_start") < F.col("_middle"))).drop("_start", "_middle")


def backlog(sources: dict[str, DataFrame], partition: str, created: str, as_of_us: int) -> DataFrame:
    """Counts by source and the oldest age in seconds for every partition; rows with none count in each.

    Each source has partition (null: all of them), created (microseconds) and pending: whether the row is counted. Rows
    that are not counted still age.
    """
    rows = None
    for name, df in sources.items():
        one = df.select(F.col(partition).alias("part"), F.col(created).alias("us"), F.col("pending"), F.lit(name).alias("source"))
        rows = one if rows is None else rows.unionByName(one)
    sums = [F.count_if(F.col("pending") & (F.col("source") == n)).alias(n) for n in sources]
    part = rows.groupBy("part").agg(*sums, F.min("us").alias("oldest"))
    common = part.where(F.col("part").isNull()).select(*(F.col(n).alias(f"all_{n}") for n in sources), F.col("oldest").alias("all_oldest"))
    common = common.groupBy().agg(*(F.coalesce(F.sum(f"all_{n}"), F.lit(0)).alias(f"all_{n}") for n in sources),
                                  F.min("all_oldest").alias("all_oldest"))
    out = part.where(F.col("part").isNotNull()).join(F.broadcast(common))
    age = (F.lit(as_of_us) - F.least("oldest", "all_oldest")) / 1e6
    return out.select(F.col("part").alias("partition_id"), *((F.col(n) + F.col(f"all_{n}")).alias(n) for n in sources),
                      F.greatest(F.coalesce(age, F.lit(0.0)), F.lit(0.0)).alias("oldest_age"))


def over_limit(count: Column, limit: int) -> Column:
    """Strictly more than the limit; a limit of 0 is none."""
    return F.lit(False) if limit == 0 else count > limit


def admits(active: Column, pending: Column, most_active: int, most_pending: int) -> Column:
    """Room on both counts; a count at its cap has none."""
    return ~((active >= most_active) | (pending >= most_pending))


def duplicates(df: DataFrame, key: Sequence[str], count: str = "n") -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias(count)).where(F.col(count) > 1)


def conflicting(df: DataFrame, key: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Keys that stand for more than one distinct value."""
    return df.groupBy(*key).agg(F.count_distinct(F.struct(*values)).alias("identities")).where("identities > 1")


def same_ids(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: ids of left alone, of right alone, and whether the sets are equal."""
    a = left.select(key).distinct().withColumn("_a", F.lit(1))
    b = right.select(key).distinct().withColumn("_b", F.lit(1))
    both = a.join(b, key, "full_outer")
    out = both.agg(F.count_if(F.col("_b").isNull()).alias("left_only"), F.count_if(F.col("_a").isNull()).alias("right_only"))
    return out.withColumn("equal", (F.col("left_only") == 0) & (F.col("right_only") == 0))


def pair_arms(df: DataFrame, key: Sequence[str], arm: str, arms: tuple[str, str], value: Column) -> DataFrame:
    """One row for each key with the value of both arms; keys that lack one go."""
    one = {a: F.max(F.when(F.col(arm) == a, value)).alias(a) for a in arms}
    return df.groupBy(*key).agg(*one.values()).where(" AND ".join(f"`{a}` IS NOT NULL" for a in arms))


def paired_binary(left: DataFrame, right: DataFrame, key: str, left_flag: Column, right_flag: Column) -> DataFrame:
    """Of keys on both sides: how many hold on both, on one or on neither."""
    both = left.select(key, left_flag.alias("_l")).join(right.select(key, right_flag.alias("_r")), key)
    l, r = F.col("_l"), F.col("_r")
    return both.agg(F.count_if(l & r).alias("both"), F.count_if(l & ~r).alias("left_only"), F.count_if(~l & r).alias("right_only"),
                    F.count_if(~l & ~r).alias("neither"))


def ready(nodes: DataFrame, key: str, dependencies: str, states: DataFrame, state_key: str, done: Column) -> DataFrame:
    """Nodes whose dependencies are all done; one without any is not ready."""
    need = nodes.select(key, F.explode(dependencies).alias(state_key))
    have = states.select(state_key, done.alias("_done"))
    found = need.join(have, state_key, "left").groupBy(key).agg(F.bool_and(F.coalesce("_done", F.lit(False))).alias("_ready"))
    return nodes.join(found, key, "left").withColumn("ready", F.coalesce("_ready", F.lit(False))).drop("_ready")


def ordered_json(df: DataFrame, key: Sequence[str], order: Sequence[str], columns: Sequence[str], name: str) -> DataFrame:
    """Child rows of each key as one JSON array in order. A group's rows meet in one row: for bounded groups only."""
    item = F.struct(*order, *(c for c in columns if c not in order))
    rows = F.sort_array(F.collect_list(item))
    return df.groupBy(*key).agg(F.to_json(rows).alias(name))


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """new over old by key: a full outer join, written to a new place by the caller."""
    rest = [c for c in old.columns if c not in key]
    o = old.select(*key, F.struct(*rest).alias("_old"))
    n = new.select(*key, F.struct(*rest).alias("_new"))
    both = o.join(n, list(key), "full_outer")
    return both.select(*key, *(F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")).alias(c) for c in rest))


def insert_if_absent(old: DataFrame, new: DataFrame, key: Sequence[str], digest: str) -> tuple[DataFrame, DataFrame]:
    """Rows to append, and keys whose digest differs from that already there."""
    fresh = new.join(old.select(*key), list(key), "left_anti").dropDuplicates(list(key))
    clash = new.select(*key, F.col(digest).alias("_new")).join(old.select(*key, F.col(digest).alias("_old")), list(key))
    return fresh, clash.where("_new <> _old").select(*key)


def running_cap(df: DataFrame, key: str, order: str, amount: Column, cap: float) -> DataFrame:
    """Amounts with their running total, and whether the total is still within the cap."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("spent", F.sum(amount).over(w)).withColumn("within", F.col("spent") <= cap)


def reachable(spark, edges: str, start: object, limit: int = 64) -> DataFrame:
    """Nodes reached from a start over a view of edges (src, dst), by a recursive query."""
    return spark.sql(f"""
        WITH RECURSIVE walk(node, depth) AS (
          SELECT CAST({start!r} AS STRING), 0
          UNION ALL
          SELECT e.dst, w.depth + 1 FROM walk w JOIN {edges} e ON e.src = w.node WHERE w.depth < {limit})
        SELECT node, min(depth) AS depth FROM walk GROUP BY node""")
