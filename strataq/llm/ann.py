"""Approximate nearest neighbours by adaptive dimension scan."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, cut, map_arrow, ship_package


@dataclass
class Index:
    """A rotation, list centres and the bounded sample, all rotated; a pure function of the sample and the seed."""

    rotation: np.ndarray
    centres: np.ndarray
    sample: np.ndarray
    sample_ids: np.ndarray
    sample_lists: np.ndarray


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.maximum(d, 0)


def fit(x: np.ndarray, ids: np.ndarray, lists: int, seed: int, rounds: int = 8) -> Index:
    rng = np.random.default_rng(seed)
    d = x.shape[1] if x.ndim == 2 and len(x) else 1
    rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
    if not len(x):
        return Index(rotation, np.zeros((1, d)), np.zeros((0, d)), ids, ids)
    r = x @ rotation
    distinct = np.unique(r, axis=0)
    lists = max(1, min(lists, len(distinct)))
    centres = distinct[rng.choice(len(distinct), lists, replace=False)]
    for _ in range(rounds):
        near = squares(r, centres).argmin(1)
        n = np.bincount(near, minlength=lists)
        sums = np.stack([np.bincount(near, r[:, j], lists) for j in range(d)], 1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return Index(rotation, centres, r, ids, squares(r, centres).argmin(1))


def adaptive_scan(q: np.ndarray, v: list[np.ndarray], bound: float, k: int, block: int, epsilon: float,
                  first: np.ndarray | None = None) -> np.ndarray:
    """Rows of v that may be among the k nearest of q; both rotated, v stored by column blocks.

    After t of d dimensions a row is abandoned if its partial squared distance, scaled by d/t, is above
    bound * (1 + epsilon / sqrt(t))^2: under a random rotation, the chance that a true neighbour fails this test falls
    exponentially in epsilon squared. The last test is exact but for rounding. `first` may hold the partial distances of
    the first block, which are made for many queries at once.
    """
    d = len(q)
    live = np.arange(len(v[0]))
    partial = np.zeros(len(live))
    for b, part in enumerate(v):
        t = min(d, (b + 1) * block)
        if first is not None and not b:
            partial = first
        else:
            diff = part[live] - q[b * block:t]
            partial = partial + np.einsum("ij,ij->i", diff, diff)
        if t == d:
            if len(live) > k:
                bound = min(bound, np.partition(partial, k - 1)[k - 1])
            stay = partial <= bound * (1 + 1e-9) + 1e-12
        else:
            stay = partial * (d / t) <= bound * (1 + epsilon / np.sqrt(t)) ** 2 * (1 + 1e-9) + 1e-12
        if not stay.all():
            live, partial = live[stay], partial[stay]
        if not len(live):
            break
    return live


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
           sample_rows: int = 8192, most_lists: int = 1024, probe_share: float = 0.65, least_probes: int = 32,
           block: int = 16, epsilon: float = 2.1, rows_per_block: int = 4096, queries_per_block: int = 1024,
           seed: int = 7) -> DataFrame:
    """The k nearest rows found for every query by Euclidean distance: query_id, rank (from 1), vec_id, score.

    Ties go to the smaller id; a row is no neighbour of a query with its own id. Null ids and vectors that are null,
    empty, zero, hold null or non-finite components or have not the commonest length take no part. Repeated rows are
    candidates each, but a query id asks once, with the smallest of its vectors; with fewer than k candidates all are
    returned; an empty table gives an empty result. Extra columns are not read.

    Rotation and list centres are fitted on at most `sample_rows` vectors (smallest hash of the id), and every vector is
    indexed. A query probes its nearest lists, `least_probes` and `probe_share` of them at least, and more until they
    hold more than k rows. The k-th distance to sample rows in these lists bounds the scan from the start. Lists are dealt in blocks
    of `rows_per_block` rows by a hash of the id, and their queries in blocks too, so no list is ever one task's.
    """
    spark = vectors.sparkSession
    ship_package(spark)

    def valid(df: DataFrame) -> DataFrame:
        v = F.col("v")
        fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        df = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        return df.where(F.col("id").isNotNull() & v.isNotNull() & fine & F.exists(v, lambda x: x != 0.0))

    base = valid(vectors)
    sizes = base.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    d, n = (sizes[0]["d"], sizes[0]["n"]) if sizes else (1, 0)
    base = base.where(F.size("v") == d)
    asked = valid(queries).where(F.size("v") == d).groupBy("id").agg(F.min("v").alias("v"))
    ids = base.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(sample_rows).toPandas()
    x = np.array(ids["v"].tolist(), np.float64).reshape(-1, d)
    index = spark.sparkContext.broadcast(
        fit(x, ids["id"].to_numpy(np.int64), int(min(most_lists, max(1, n ** 0.5))), seed))

    def rows(batch: pa.RecordBatch) -> np.ndarray:
        return column(batch, "v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)

    def packed(x: np.ndarray) -> pa.Array:
        return pa.array([r.tobytes() for r in np.ascontiguousarray(x, "<f8")], pa.binary())

    def assign(batch: pa.RecordBatch) -> pa.RecordBatch:
        v = rows(batch)
        near = squares(v @ index.value.rotation, index.value.centres).argmin(1).astype(np.int32)
        return pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(near), packed(v)], ["id", "list", "v"])

    placed = cut(map_arrow(base, assign, "id long, list int, v binary", rows=2048))
    held = {r["list"]: r["n"] for r in placed.groupBy("list").agg(F.count("*").alias("n")).collect()}
    lists = len(index.value.centres)
    counts = np.array([held.get(i, 0) for i in range(lists)])
    blocks = np.maximum(1, -(-counts // rows_per_block))
    probes = max(least_probes, int(np.ceil(probe_share * lists)))

    def probe(batch: pa.RecordBatch) -> pa.RecordBatch:
        v, at = rows(batch), column(batch, "id").to_numpy(zero_copy_only=False)
        r = v @ index.value.rotation
        order = squares(r, index.value.centres).argsort(1, kind="stable")
        order_n = np.cumsum(counts[order], 1)
        take = np.maximum(probes, (order_n <= k).sum(1) + 1)
        bound = np.full(len(v), np.inf)
        if len(index.value.sample) > k and len(v):
            s = squares(r, index.value.sample)
            s[at[:, None] == index.value.sample_ids[None, :]] = np.inf
            probed = np.zeros((len(v), lists), bool)
            np.put_along_axis(probed, order, np.arange(lists)[None, :] < take[:, None], 1)
            s[~probed[:, index.value.sample_lists]] = np.inf
            bound = np.partition(s, k - 1, axis=1)[:, k - 1] * (1 + 1e-6) + 1e-9
        who = np.repeat(np.arange(len(v)), np.minimum(take, lists))
        lists_of = np.concatenate([o[:m] for o, m in zip(order, take)]) if len(v) else np.zeros(0, int)
        full = counts[lists_of] > 0
        who, lists_of = who[full], lists_of[full]
        return pa.RecordBatch.from_arrays(
            [pa.array(at[who]), pa.array(lists_of.astype(np.int32)), pa.array(bound[who]), packed(v).take(pa.array(who))],
            ["id", "list", "bound", "v"])

    aimed = cut(map_arrow(asked, probe, "id long, list int, bound double, v binary", rows=256))
    many = {r["list"]: r["n"] for r in aimed.groupBy("list").agg(F.count("*").alias("n")).collect()}
    chunks = np.array([max(1, -(-many.get(i, 0) // queries_per_block)) for i in range(lists)])
    deal = spark.createDataFrame([(i, int(b), int(c)) for i, (b, c) in enumerate(zip(blocks, chunks)) if many.get(i)]
                                 or [(-1, 1, 1)], "list int, blocks int, chunks int")
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = aimed.join(F.broadcast(deal), "list").withColumn("chunk", part("id", "chunks")).withColumn("block", each("blocks"))
    right = placed.join(F.broadcast(deal), "list").withColumn("block", part("id", "blocks")).withColumn("chunk", each("chunks"))
    key = ["list", "block", "chunk"]

    def scan(one: pa.Table, other: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if one.num_rows and other.num_rows:
            as_rows = lambda t: np.frombuffer(b"".join(t.column("v").to_pylist()), "<f8").reshape(-1, d)
            qs, vs = as_rows(one), as_rows(other)
            q_ids, v_ids = one.column("id").to_numpy(), other.column("id").to_numpy()
            turned = vs @ index.value.rotation
            columns = [np.ascontiguousarray(turned[:, a:a + block]) for a in range(0, d, block)]
            bounds, turned = one.column("bound").to_numpy(), qs @ index.value.rotation
            order = np.sort(v_ids)
            own = np.searchsorted(order, q_ids, "right") - np.searchsorted(order, q_ids, "left")
            for at in range(0, len(qs), 128):
                first = squares(turned[at:at + 128, :block], columns[0])
                for i, partial in enumerate(first, at):
                    near = adaptive_scan(turned[i], columns, bounds[i], k + int(own[i]), block, epsilon, partial)
                    near = near[v_ids[near] != q_ids[i]]
                    if len(near):
                        score = np.sqrt(((vs[near] - qs[i]) ** 2).sum(1))
                        best = np.lexsort((v_ids[near], score))[:k]
                        out.append((np.full(len(best), q_ids[i]), v_ids[near[best]], score[best]))
        a, b, c = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    found = left.drop("blocks", "chunks").groupBy(*key).cogroup(right.drop("blocks", "chunks").groupBy(*key)).applyInArrow(
        scan, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(ids: np.ndarray, x: np.ndarray, asked: np.ndarray, k: int) -> dict[int, list[tuple[int, float]]]:
    """All distances, for tests."""
    out = {}
    for i in asked:
        score = np.sqrt(((x - x[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, score)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(score[j])) for j in order]
    return out
