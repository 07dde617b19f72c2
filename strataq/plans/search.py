"""Query text to ranked evidence to measures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import fingerprint
from ..operators import retrieval as R


@dataclass(frozen=True)
class Settings:
    top_k: int = 5
    dimension: int = 64
    keyword_threshold: float = 0.75
    dense_threshold: float = 0.45
    constant: int = 60

    def fingerprint(self) -> str:
        return fingerprint(self.__dict__)


def rankings(queries: DataFrame, documents: DataFrame, item: str, s: Settings = Settings()) -> dict[str, DataFrame]:
    """Top-k of every arm. queries: query_id, query; documents: item, text."""
    keyword = R.keyword_search(queries, documents, item, s.top_k)
    dense = R.hashed_search(queries, documents, item, s.top_k, s.dimension)
    return {"keyword": keyword, "dense": dense, "hybrid": R.fuse([keyword, dense], item, s.top_k, s.constant)}


def search(queries: DataFrame, documents: DataFrame, item: str, arm: str, s: Settings = Settings(), withhold: bool = True) -> DataFrame:
    """Delivered hits of one arm. Hybrid passes if either constituent does. With withhold=False hits are only labelled."""
    found = rankings(queries, documents, item, s)
    passes = {"keyword": R.gate(found["keyword"], s.keyword_threshold), "dense": R.gate(found["dense"], s.dense_threshold)}
    names = [arm] if arm in passes else list(passes)
    ok = None
    for n in names:
        one = passes[n].where("sufficient").select("query_id")
        ok = one if ok is None else ok.unionByName(one)
    ok = ok.distinct().withColumn("sufficient", F.lit(True))
    out = found[arm].join(ok, "query_id", "left").withColumn("sufficient", F.coalesce("sufficient", F.lit(False)))
    return out.where("sufficient") if withhold else out


def control(queries: DataFrame) -> DataFrame:
    """The response of the control arm to each query: nothing delivered, and why."""
    return queries.select("query_id", F.lit(0).alias("delivered"), F.lit(False).alias("sufficient"), F.lit("no_retrieval_arm").alias("reason"))


def nothing(queries: DataFrame) -> DataFrame:
    """The control arm: no hits."""
    return queries.select("query_id", F.lit(None).cast("bigint").alias("item"), F.lit(None).cast("int").alias("rank"),
                          F.lit(None).cast("double").alias("score")).limit(0)
