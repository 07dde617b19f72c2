"""Time functions. Clocks are parameters: nothing here reads the wall clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    """Microseconds since the epoch; a zone-free stamp is read as UTC, whatever the session zone is."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / 1e6


def plus_seconds(ts: Column, seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds.cast("int"), ts)


def parse_rfc3339(text: Column) -> Column:
    return F.try_to_timestamp(text)


def nanos_of(text: Column) -> Column:
    """Nanoseconds since the epoch of an RFC 3339 stamp with Z; the fraction keeps nine digits."""
    whole = F.unix_timestamp(F.try_to_timestamp(F.concat(F.substring(text, 1, 19), F.lit("Z"))))
    part = F.rpad(F.regexp_extract(text, r"\.(\d{1,9})", 1), 9, "0")
    return whole * 1_000_000_000 + F.when(F.length(F.trim(part)) == 9, part.try_cast("long")).otherwise(0)


def clock_offset(before: Column, remote: Column, after: Column) -> tuple[Column, Column]:
    """Offset of a remote clock against the middle of a probe, and the half-width of the doubt, in whole units."""
    middle = F.floor((before + after) / 2)
    return (remote - middle).cast("long"), F.ceil((after - before) / 2).cast("long")


def probe_holds(before: Column, at: Column, after: Column) -> Column:
    return (before <= at) & (at <= after)


def ceil_to(x: Column, steps: int) -> Column:
    """Up to the next multiple of 1/steps."""
    return F.ceil(x * steps) / steps


def finite(x: Column, least: float | None = 0.0) -> Column:
    fine = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return fine if least is None else fine & (x >= least)


def at_least_zero(x: Column) -> Column:
    return F.greatest(x, F.lit(0))
