"""User-defined functions: named activities, table functions and a gate for callers."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

def rounds_of(n: Column | int) -> Column:
    """1..n, and nothing for no rounds."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def sha_rounds(seed: Column, rounds: Column | int) -> Column:
    """SHA-256 applied to itself `rounds` times, from the seed's text, as hex."""
    start = seed.cast("string").cast("binary")
    return F.lower(F.hex(F.aggregate(rounds_of(rounds), start, lambda x, _: F.unhex(F.sha2(x, 256)))))


def block_workload(seed: Column, rounds: Column | int) -> Column:
    """SHA-256 over a block of 256 bytes, whose start takes each digest in turn; the last digest as hex."""
    bytes_ = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.lpad(F.hex(F.pmod(seed + i, F.lit(256)).cast("long")), 2, "0"))
    block = F.unhex(F.array_join(bytes_, ""))
    after = F.aggregate(rounds_of(rounds), block, lambda b, _: F.concat(F.unhex(F.sha2(b, 256)), F.substring(b, 33, 224)))
    return F.lower(F.hex(F.substring(after, 1, 32)))


def chunk_chain(seed: Column, chunks: Column | int) -> Column:
    """A chain of digests: each is that of the one before, ':' and the number of the chunk."""
    return F.aggregate(rounds_of(chunks), F.sha2(seed.cast("string"), 256),
                       lambda d, i: F.sha2(F.concat_ws(":", d, (i - 1).cast("string")), 256))


def xorshift(seed: Column, rounds: Column | int) -> Column:
    """xorshift64, as a signed 64-bit number; a seed of 0 counts as 1."""
    def step(x: Column, _: Column) -> Column:
        x = x.bitwiseXOR(F.shiftleft(x, 13))
        x = x.bitwiseXOR(F.shiftrightunsigned(x, 7))
        return x.bitwiseXOR(F.shiftleft(x, 17))

    start = F.when(seed == 0, F.lit(1)).otherwise(seed).cast("long")
    return F.aggregate(rounds_of(rounds), start, step)


def echo(value: Column) -> Column:
    return value


def add(values: Column) -> Column:
    """Sum of an array."""
    return F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))


class Activities:
    """name@version -> function of columns. Names are registered once and looked up exactly."""

    def __init__(self) -> None:
        self._known: dict[str, Callable[..., Column]] = {}

    def register(self, name: str, version: int, fn: Callable[..., Column]) -> None:
        key = f"{name}@{version}"
        if key in self._known:
            raise ValueError(f"{key} is registered")
        self._known[key] = fn

    def column(self, name: str, version: int) -> Callable[..., Column]:
        return self._known[f"{name}@{version}"]

    def names(self) -> list[str]:
        return sorted(self._known)

    def run(self, activity: Column, *arguments: Column) -> Column:
        """The result, as text, of the activity that each row names; an unknown name fails that row alone, with null."""
        out = F.lit(None).cast("string")
        for key, fn in self._known.items():
            out = F.when(activity == key, fn(*arguments).cast("string")).otherwise(out)
        return out


def default_activities() -> Activities:
    out = Activities()
    out.register("cpu_work", 1, sha_rounds)
    out.register("sha256_workload", 1, block_workload)
    out.register("chunk_digest", 1, chunk_chain)
    out.register("busy_work", 1, xorshift)
    return out


def register_sql(spark: SparkSession) -> None:
    """The grant test as an SQL function and the nearest-rank percentile as an aggregate function for SQL."""
    @F.pandas_udf("double")
    def nearest(values: pd.Series, share: pd.Series) -> float:
        held = values.dropna().sort_values()
        return float(held.iloc[max(0, math.ceil(share.iloc[0] * len(held)) - 1)]) if len(held) else None

    spark.udf.register("nearest_rank", nearest)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION grant_is_live(sampled TIMESTAMP, expires TIMESTAMP) "
              "RETURNS BOOLEAN RETURN sampled < expires")


# Tool calls that a caller may make: method -> required text arguments.
TOOLS = {
    "query_logs": ("run_id", "case_id", "service"),
    "query_metrics": ("run_id", "case_id", "service"),
    "search": ("query", "arm"),
    "remediation_status": ("run_id", "resource_id"),
}


def gate(method: Column, arguments: Column) -> Column:
    """allowed_call over columns: a method's name, and its arguments as a map of text."""
    out = F.lit(False)
    keys = F.map_keys(arguments)
    for name, needed in TOOLS.items():
        must, may = (F.array(*map(F.lit, x)) for x in (needed, (*needed, "level", "metric")))
        fits = (F.size(F.array_except(must, keys)) == 0) & (F.size(F.array_except(keys, may)) == 0) & F.forall(F.map_values(arguments), lambda v: v.isNotNull())
        out = F.when(method == name, fits).otherwise(out)
    return out


def allowed_call(method: str, arguments: dict[str, str]) -> bool:
    """Is the method listed, with its arguments given as text and no other but level and metric?"""
    if method not in TOOLS:
        return False
    needed = set(TOOLS[method])
    return needed <= set(arguments) <= needed | {"level", "metric"} and all(isinstance(v, str) for v in arguments.values())
