"""Ordered histories: contiguity, chains, as-of, islands, intervals, slices. All are window expressions by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by(key: Sequence[str], *order: str | Column):
    return Window.partitionBy(*key).orderBy(*order)


def before(window):
    return window.rowsBetween(Window.unboundedPreceding, -1)


def contiguity(df: DataFrame, key: Sequence[str], number: str, start: int = 1) -> DataFrame:
    """Rows whose number isn't that of the row before plus one, or not `start` in the first row."""
    prev = F.lag(number).over(by(key, number))
    return df.withColumn("expected", F.coalesce(prev + 1, F.lit(start)).cast("long")).where(F.col(number) != F.col("expected"))


def valid_prefix(df: DataFrame, key: Sequence[str], number: str, start: int = 1) -> DataFrame:
    """Rows before the first gap: those whose number is their place in the order, as of all rows before them."""
    w = by(key, number)
    place = F.row_number().over(w) - 1 + start
    held = F.bool_and(F.col(number) == F.col("_place")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_place", place).withColumn("_held", held).where("_held").drop("_place", "_held")


def chain_breaks(df: DataFrame, key: Sequence[str], order: str, old: str, new: str, first: str = "") -> DataFrame:
    """Rows whose old value isn't the new value of the row before; `first` in the first row."""
    prev = F.lag(new).over(by(key, order))
    return df.withColumn("expected", F.coalesce(prev, F.lit(first))).where(F.col(old) != F.col("expected"))


def illegal_steps(df: DataFrame, old: str, new: str, legal: Sequence[tuple[str, str]]) -> DataFrame:
    steps = F.array(*(F.lit(f"{a}>{b}") for a, b in legal))
    return df.where(~F.array_contains(steps, F.concat_ws(">", old, new)))


def after_terminal(df: DataFrame, key: Sequence[str], order: Sequence[str], terminal: Column) -> DataFrame:
    """Rows that follow a terminal one."""
    return df.withColumn("_end", F.max(terminal.cast("int")).over(before(by(key, *order)))).where("_end = 1").drop("_end")


def epoch_regressions(df: DataFrame, key: Sequence[str], order: Sequence[str], epoch: str) -> DataFrame:
    """Rows with an epoch below the greatest before them; such a row doesn't lower what later rows are held to."""
    w = before(by(key, *order))
    return df.withColumn("highest", F.max(epoch).over(w)).where(F.col(epoch) < F.col("highest"))


def linked_chain(df: DataFrame, key: Sequence[str], order: str, old_revision: str, old_hash: str, revision: str, digest: str):
    """Rows whose old revision and hash are not those that the row before ended with."""
    w = by(key, order)
    return df.withColumn("_r", F.lag(revision).over(w)).withColumn("_h", F.lag(digest).over(w)).where(
        F.col("_r").isNotNull() & ((F.col(old_revision) != F.col("_r")) | (F.col(old_hash) != F.col("_h")))).drop("_r", "_h")


def execution_rank(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """index within the key; every row after the first is a re-execution."""
    return df.withColumn("index", F.row_number().over(by(key, *order)) - 1).withColumn("reexecution", F.col("index") > 0)


def first_of(df: DataFrame, key: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_f")).select(
        *key, *(F.col(f"_f.{c}").alias(c) for c in columns))


def censored_bounds(start: Column, finish: Column, death: Column, alive: Column) -> tuple[Column, Column]:
    """Least and greatest duration: exact once finished; else from the last sign of life to the death, if any."""
    low = F.coalesce(finish, alive, start) - start
    return F.greatest(low, low * 0), F.coalesce(finish, death) - start


def gaps(df: DataFrame, key: Sequence[str], order: Sequence[str], clock: str) -> DataFrame:
    """gap to the row before; null in the first row."""
    return df.withColumn("gap", F.col(clock) - F.lag(clock).over(by(key, *order)))


def largest_gap_until(df: DataFrame, key: Sequence[str], order: Sequence[str], clock: str, stop: Column) -> DataFrame:
    """The largest gap of each key up to its first stop row, that row included."""
    w = by(key, *order)
    done = F.coalesce(F.max(stop.cast("int")).over(before(w)), F.lit(0))
    return gaps(df, key, order, clock).withColumn("_done", done).where("_done = 0").groupBy(*key).agg(F.max("gap").alias("max_gap"))


def phases(df: DataFrame, key: Sequence[str], name: str, clock: str, steps: Sequence[str]) -> DataFrame:
    """First time of every step by key, and the time from each step to the next."""
    out = df.groupBy(*key).agg(*(F.min(F.when(F.col(name) == s, F.col(clock))).alias(s) for s in steps))
    return out.select(*key, *steps, *((F.col(b) - F.col(a)).alias(f"{a}_to_{b}") for a, b in zip(steps, steps[1:])))


def asof(left: DataFrame, right: DataFrame, key: Sequence[str], left_time: str, right_time: str, columns: Sequence[str],
         forward: bool = False, strict: bool = False) -> DataFrame:
    """left with the columns of the nearest row of right at or before (forward: at or after) its time, or null.

    Both sides are laid into one ordered history by key, and the last right row is carried along: one shuffle, no range
    join. `strict` leaves out equal times.
    """
    l = left.select(*key, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"),
                    F.lit(None).cast(right.select(F.struct(right_time, *columns).alias("r")).schema[0].dataType).alias("_r"))
    r = right.select(*key, F.col(right_time).alias("_t"), F.lit(0).alias("_side"),
                     F.lit(None).cast(left.select(F.struct(*left.columns).alias("l")).schema[0].dataType).alias("_l"),
                     F.struct(right_time, *columns).alias("_r"))
    rows = l.unionByName(r)
    # Rows of right come first among equal times, unless equal times don't count.
    turn = F.asc("_side") if not strict else F.desc("_side")
    order = [F.desc("_t"), turn] if forward else [F.asc("_t"), turn]
    # Among rows of right at one time, the greatest in its columns wins whatever the direction.
    w = Window.partitionBy(*key).orderBy(*order, F.asc("_r")).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("_m", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    return found.select(*(F.col(f"_l.{c}").alias(c) for c in left.columns), F.col(f"_m.{right_time}").alias(f"asof_{right_time}"),
                        *(F.col(f"_m.{c}").alias(f"asof_{c}") for c in columns))


def bracket(left: DataFrame, right: DataFrame, key: Sequence[str], left_time: str, right_time: str, columns: Sequence[str]):
    """Nearest rows of right strictly before and strictly after each row of left."""
    low = asof(left, right, key, left_time, right_time, columns, strict=True)
    names = {f"asof_{c}": f"before_{c}" for c in (right_time, *columns)}
    low = low.withColumnsRenamed(names)
    high = asof(low, right, key, left_time, right_time, columns, forward=True, strict=True)
    return high.withColumnsRenamed({f"asof_{c}": f"after_{c}" for c in (right_time, *columns)})


def active_at(intervals: DataFrame, start: str, end: str, instants: DataFrame, at: str) -> DataFrame:
    """How many half-open intervals hold each instant; an interval without an end is open.

    Starts and ends are counted as steps and summed in order of time, so no pair of interval and instant is formed. Days
    carry the sums: within a day the order is by time, and earlier days enter as one number each.
    """
    step = intervals.select(F.col(start).alias("_t"), F.lit(1).alias("_d"), F.lit(None).cast("string").alias("_at")).unionByName(
        intervals.where(F.col(end).isNotNull()).select(F.col(end).alias("_t"), F.lit(-1).alias("_d"), F.lit(None).cast("string").alias("_at")))
    asked = instants.select(F.col(at).alias("_t"), F.lit(0).alias("_d"), F.lit("x").alias("_at"))
    rows = step.unionByName(asked).withColumn("_day", F.floor(F.col("_t") / 86_400_000_000))
    days = rows.groupBy("_day").agg(F.sum("_d").alias("_sum"))
    days = days.withColumn("_base", F.coalesce(F.sum("_sum").over(before(Window.orderBy("_day"))), F.lit(0)))
    w = Window.partitionBy("_day").orderBy("_t").rangeBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_in", F.sum("_d").over(w)).where("_at IS NOT NULL").join(days.select("_day", "_base"), "_day")
    return rows.select(F.col("_t").alias(at), (F.col("_base") + F.col("_in")).alias("active"))


def overlaps(df: DataFrame, key: Sequence[str], start: str, end: str) -> DataFrame:
    """Rows that begin before an earlier row of their key has ended."""
    w = before(by(key, start, end))
    return df.withColumn("_high", F.max(end).over(w)).where(F.col(start) < F.col("_high")).drop("_high")


def clipped_seconds(start: Column, end: Column, low: int, high: int) -> Column:
    """Length of an interval within a window, in the unit of the clock."""
    return F.greatest(F.least(F.coalesce(end, F.lit(high)), F.lit(high)) - F.greatest(start, F.lit(low)), F.lit(0))


def bins(clock: Column, start: int, length: int, n: int) -> Column:
    """Which of n equal half-open bins holds a time; null outside."""
    b = F.floor((clock - start) * n / length)
    return F.when((b >= 0) & (b < n), b).cast("int")


def islands(df: DataFrame, key: Sequence[str], number: str) -> DataFrame:
    """Runs of consecutive distinct numbers by key: first, last and size."""
    rows = df.select(*key, number).distinct()
    rows = rows.withColumn("_g", F.col(number) - F.row_number().over(by(key, number)))
    return rows.groupBy(*key, "_g").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count("*").alias("size")).drop("_g")


def watermark(df: DataFrame, key: Sequence[str], offset: str, next_offset: Column) -> DataFrame:
    """The next offset of each key after its contiguous run from next_offset; later runs are held back."""
    rows = df.withColumn("_next", next_offset).where(F.col(offset) >= F.col("_next")).select(*key, offset, "_next").distinct()
    rows = rows.withColumn("_run", F.col(offset) - F.col("_next") - (F.row_number().over(by(key, offset)) - 1))
    run = rows.groupBy(*key).agg(F.max("_next").alias("_next"), F.count_if(F.col("_run") == 0).alias("_n"))
    start = df.withColumn("_next", next_offset).groupBy(*key).agg(F.max("_next").alias("_base"))
    return start.join(run, list(key), "left").select(*key, (F.col("_base") + F.coalesce("_n", F.lit(0))).alias("next_offset"))


def slices(df: DataFrame, key: Sequence[str], order: Sequence[str], n: int, name: str = "slice") -> DataFrame:
    """n slices by place: slice i holds the rows from i*N//n to (i+1)*N//n. Unlike ntile, short slices come first."""
    w = Window.partitionBy(*key)
    i = F.row_number().over(by(key, *order)) - 1
    size = F.count("*").over(w)
    # The slice of row i is the greatest s with s*N//n <= i.
    return df.withColumn("_i", i).withColumn("_n", size).withColumn(
        name, F.floor((n * (F.col("_i") + 1) - 1) / F.col("_n")).cast("int")).drop("_i", "_n")


def arg_percentile(df: DataFrame, key: Sequence[str], value: str, tie: str, p: float) -> DataFrame:
    """The row at the nearest rank of p, ties by another column."""
    rank = F.row_number().over(by(key, value, tie))
    size = F.count("*").over(Window.partitionBy(*key))
    return df.withColumn("_k", rank).withColumn("_n", size).where(F.col("_k") == F.ceil(F.lit(p) * F.col("_n"))).drop("_k", "_n")


def fenced(df: DataFrame, key: Sequence[str], order: str, epoch: str, recovery: int, current: int) -> DataFrame:
    """Rows after the recovery point that carry an epoch older than the current one, by key."""
    late = (F.col(order) > recovery) & (F.col(epoch) < current)
    return df.groupBy(*key).agg(F.count_if(late).alias("stale"), F.count("*").alias("rows"))


def takeovers(df: DataFrame, key: Sequence[str], order: Sequence[str], owner: str) -> DataFrame:
    """Rows where the owner differs from that of the row before, with the former owner."""
    return df.withColumn("former", F.lag(owner).over(by(key, *order))).where(F.col("former").isNotNull() & (F.col("former") != F.col(owner)))


def first_after(left: DataFrame, right: DataFrame, key: Sequence[str], left_time: str, right_time: str, columns: Sequence[str]):
    """The first row of right strictly after each row of left."""
    return asof(left, right, key, left_time, right_time, columns, forward=True, strict=True)


def changes(df: DataFrame, key: Sequence[str], order: Sequence[str], digest: str) -> DataFrame:
    """Rows whose digest differs from the one before: old and new, for a change journal."""
    old = F.lag(digest).over(by(key, *order))
    return df.withColumn("old_digest", old).where(F.col("old_digest").isNull() | (F.col("old_digest") != F.col(digest)))


def first_terminal(df: DataFrame, key: Sequence[str], order: Sequence[str], terminal: Column) -> DataFrame:
    return df.where(terminal).withColumn("_k", F.row_number().over(by(key, *order))).where("_k = 1").drop("_k")


def exact_sequence(df: DataFrame, key: Sequence[str], order: Sequence[str], name: str, expected: Sequence[str]) -> DataFrame:
    """Keys whose ordered names are not exactly the expected ones; counts and mismatches decide, no list is gathered."""
    want = F.array(*(F.lit(x) for x in expected))
    i = F.row_number().over(by(key, *order))
    rows = df.withColumn("_i", i).withColumn("_ok", F.coalesce(F.try_element_at(want, "_i") == F.col(name), F.lit(False)))
    out = rows.groupBy(*key).agg(F.count("*").alias("n"), F.count_if(~F.col("_ok")).alias("wrong"))
    return out.where((F.col("n") != len(expected)) | (F.col("wrong") > 0))
