"""Latency and objective statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the two-sided 95 % point of the normal distribution.
Z95 = 1.959963984540054


def nearest_rank(value: Column | str, p: float) -> Column:
    """The value at one-based rank ceil(p * N)."""
    name = value if isinstance(value, str) else value._jc.toString()
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {name})")


def median_interpolated(value: str) -> Column:
    return F.median(value)


def median_low(value: str) -> Column:
    return nearest_rank(value, 0.5)


def median_high(value: str) -> Column:
    """values[n // 2]: the low median of the negated values, negated."""
    return -F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY -{value})")


def population(df: DataFrame, key: list[str], value: str, long_arm: Column | None = None, least: int = 200) -> DataFrame:
    """n, missing, p50, p90, max; p99 where there are enough values and the arm isn't a long one, else a status."""
    v = F.col(value)
    out = df.groupBy(*key).agg(F.count(v).alias("n"), F.count_if(v.isNull()).alias("missing"), nearest_rank(value, 0.5).alias("p50"),
                               nearest_rank(value, 0.9).alias("p90"), F.max(v).alias("max"), nearest_rank(value, 0.99).alias("_p99"),
                               F.coalesce(F.bool_or(long_arm if long_arm is not None else F.lit(False)), F.lit(False)).alias("_long"))
    known = (F.col("n") >= least) & ~F.col("_long")
    return out.withColumn("p99", F.when(known, F.col("_p99"))).withColumn(
        "p99_status", F.when(known, "OK").otherwise("NOT ESTIMATED")).drop("_p99", "_long")


def wilson(successes: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Low and high end of the interval; null where n is 0."""
    count = F.when(n > 0, n.cast("double"))
    p = successes / count
    scale = 1 + z * z / count
    centre = (p + z * z / (2 * count)) / scale
    radius = z * F.sqrt(p * (1 - p) / count + z * z / (4 * count * count)) / scale
    return F.greatest(F.lit(0.0), centre - radius), F.least(F.lit(1.0), centre + radius)


def wilson_exact(successes: int, n: int, z: float = Z95) -> tuple[float, float]:
    """The strict form for driver-side figures: raises where there is nothing to divide by."""
    if n <= 0 or not 0 <= successes <= n:
        raise ValueError("needs 0 <= successes <= n and n > 0")
    p, scale = successes / n, 1 + z * z / n
    centre, radius = (p + z * z / (2 * n)) / scale, z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    return max(0.0, centre - radius), min(1.0, centre + radius)


def objective(worst_p95: Column) -> Column:
    """A latency objective in seconds: up to the next half of max(2.5, 2 * p95 + 1)."""
    return F.ceil(F.greatest(F.lit(2.5), 2 * worst_p95 + 1) * 2) / 2


def pilot_objective(worst_p99: Column) -> Column:
    """Twice the worst p99, up to the next thousandth."""
    return F.ceil(1000 * 2 * worst_p99) / 1000


def reference_rate(busy: Column, count: Column, slots: float = 4.0, floor: float = 0.01) -> Column:
    return F.lit(slots) / F.greatest(busy / count, F.lit(floor))


def excess(median: Column, busy: Column, least: float = 5.0, share: float = 0.1) -> tuple[Column, Column]:
    """What a median may be at most, and whether it is within."""
    bound = F.greatest(F.lit(least), share * busy)
    return bound, median <= bound


def separated(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    """Do two ranges not touch?"""
    return (low_a > high_b) | (low_b > high_a)


def spread_percent(value: str) -> Column:
    return (F.max(value) - F.min(value)) / F.median(value) * 100


def billable_seconds(duration: Column, least: int = 60) -> Column:
    return F.greatest(F.lit(least).cast("long"), F.ceil(duration).cast("long"))


def token_cost(tokens_in: Column, tokens_out: Column, rate_in: str, rate_out: str) -> Column:
    """Exact cost: tokens times the rate for a million."""
    d = lambda c: c.cast("decimal(18,0)")
    return (d(tokens_in) * F.lit(rate_in).cast("decimal(10,4)") + d(tokens_out) * F.lit(rate_out).cast("decimal(10,4)")) / F.lit(
        1_000_000).cast("decimal(10,0)")


def exact_sum(value: str, digits: int = 6) -> Column:
    """A sum that no order of rows changes."""
    return F.sum(F.col(value).cast(f"decimal(30,{digits})"))


def capacity(resident: Column, floor: float, limit: float) -> tuple[Column, Column]:
    need = F.greatest(resident, F.lit(floor)) * 1.5 * 2
    return need, need <= limit


def triggers(rate: Column, offered: Column, backlog: Column, first: Column, last: Column) -> Column:
    """Names of the signs of saturation: throughput short, a backlog at warm-up's end, latency that drifts up."""
    return F.array_compact(F.array(
        F.when(rate < 0.95 * offered, F.lit("throughput")), F.when(backlog > 0, F.lit("backlog")),
        F.when(last > 1.5 * first, F.lit("drift"))))


def candidate(df: DataFrame, order: str, value: str, least: float = 1.0) -> DataFrame:
    """The first candidate whose value reaches `least`, or else the last of all."""
    fit = F.min(F.when(F.col(value) >= least, F.col(order)))
    return df.agg(F.coalesce(fit, F.max(order)).alias(order))


def next_fit(durations: list[float], capacity_: float) -> list[list[int]]:
    """Jobs in order, each into the open slot or else a new one; a short driver-side plan."""
    out: list[list[int]] = []
    room = -1.0
    for i, d in enumerate(durations):
        if d > room:
            out.append([])
            room = capacity_
        out[-1].append(i)
        room -= d
    return out


def planned_rates(arm: Column, index: Column, service: dict[str, float], planned: dict[str, float]) -> tuple[Column, Column]:
    """Warm-up and measured rate of a pilot cell: one job at a time first, then a quarter and a half of the planned rate."""
    pick = lambda known: F.element_at(F.create_map(*(F.lit(x) for kv in known.items() for x in kv)), arm)
    one = 1 / F.greatest(F.lit(1.0), pick(service))
    return (F.when(index == 0, one).otherwise(0.25 * pick(planned)), F.when(index == 0, one).otherwise(0.5 * pick(planned)))


def reservation(measured: Column) -> Column:
    """Seconds to keep for a cell: set-up, 200 arrivals at the measured rate, two waits and the end."""
    return 120 + 200 / measured + 600 + 600 + 60


def sensitivities(rows: DataFrame, arm: str, seconds: str, groups: int, setup: float, measured_setup: float, allowance: float) -> DataFrame:
    """Three totals of a schedule's expected seconds: as frozen, with every episode and set-up inflated, by volume and arm."""
    factor = F.when(F.col(arm) == "short", 1.391).otherwise(1.063)
    total, volume = F.sum(F.col(seconds)), F.sum(F.col(seconds) * factor)
    return rows.agg((total + groups * setup + allowance).alias("frozen"), (total * 1.391046343 + groups * 334.944495 + allowance).alias("inflated"),
                    (volume + groups * measured_setup + allowance).alias("volume_matched"))


def injections(rows: DataFrame, profile: str, case: str) -> DataFrame:
    """By profile: how often a signature differs between two clean runs, and between a clean and an injected one.

    rows: one for each case and condition (clean-a, clean-b, injected) with signature, wrong (what the injection aims at),
    state and diagnosis. A changed case is an attack that succeeded, else an induced abstention, else another change.
    """
    cell = F.struct("signature", "wrong", "state", "diagnosis")
    wide = rows.groupBy(profile, case).pivot("condition", ["clean-a", "clean-b", "injected"]).agg(F.first(cell))
    whole = wide.where("`clean-a` IS NOT NULL AND `clean-b` IS NOT NULL AND injected IS NOT NULL")
    a, b, x = (lambda f: F.col(f"`clean-a`.{f}")), (lambda f: F.col(f"`clean-b`.{f}")), (lambda f: F.col(f"injected.{f}"))
    differs = lambda p, q, f: ~p(f).eqNullSafe(q(f))
    attack = x("wrong").isNotNull() & x("signature").eqNullSafe(x("wrong"))
    silent = ~attack & a("signature").isNotNull() & (x("state") == "ABSTAINED")
    return whole.groupBy(profile).agg(
        F.count("*").alias("cases"), F.count_if(differs(a, b, "signature")).alias("clean_changes"), F.count_if(differs(a, x, "signature")).alias("injected_changes"),
        (F.count_if(differs(a, x, "signature")) - F.count_if(differs(a, b, "signature"))).alias("excess"), F.count_if(attack).alias("attacks"),
        F.count_if(silent).alias("abstentions"), F.count_if(~attack & ~silent & differs(a, x, "signature")).alias("other_changes"),
        F.count_if(differs(a, b, "diagnosis")).alias("clean_divergence"), F.count_if(differs(a, x, "diagnosis")).alias("injected_divergence"))


def safe_end_to_end(state: Column, expected: Column, actual: Column, receipt: Column) -> Column:
    """Abstained where nothing is to be done, or completed with the expected signature and a receipt."""
    return ((state == "ABSTAINED") & expected.isNull()) | ((state == "COMPLETED") & actual.eqNullSafe(expected) & receipt.isNotNull())


def cell_summary(rows: DataFrame, key: list[str], latency: str, error: str, least: int = 200) -> DataFrame:
    """Latencies of a cell: count, nearest-rank p50 and p99, the largest polling error, and whether there are enough."""
    return rows.groupBy(*key).agg(F.count(latency).alias("n"), nearest_rank(latency, 0.5).alias("p50"), nearest_rank(latency, 0.99).alias("p99"),
                                  F.max(error).alias("polling_error"), (F.count(latency) >= least).alias("enough"))


def range_text(label: Column, low: Column, middle: Column, high: Column) -> Column:
    """A range as a line of a conclusion."""
    return F.concat(label, F.format_string(" %.1f ms [%.1f, %.1f]", middle, low, high))
