"""Operators against brute force in plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from strataq.functions import hashing, registry, text
from strataq.operators import relational, replay, retrieval, sequence, stats


def test_partition_vectors(spark):
    known = {"workflow-0001": 8, "workflow-0002": 14, "incident-2026-09-14-a": 0, "retry-key/abc": 0, "wf-é-日本": 3}
    rows = spark.createDataFrame([(k,) for k in known], "k string").select("k", hashing.partition_of(F.col("k")).alias("p")).collect()
    assert {r["k"]: r["p"] for r in rows} == known
    assert spark.createDataFrame([("",)], "k string").select(hashing.partition_of(F.col("k"))).first()[0] is None


def test_canonical_json_keeps_numbers():
    assert hashing.canonical_json('{"b": 1.0, "a": [1, 1e2, true, null, "é"]}') == '{"a":[1,1e2,true,null,"é"],"b":1.0}'
    assert hashing.canonical_json('{"a":1,"a":2}') is None and hashing.canonical_json("{") is None and hashing.canonical_json(None) is None
    assert hashing.canonical_digest('{"a":1.0}') != hashing.canonical_digest('{"a":1}')


def test_redaction_order(spark):
    t = "mail me@x.org from 10.0.0.1 with token_ABCDEFGH12 and CANARY_PII_A1"
    df = spark.createDataFrame([(t,)], "t string")
    got = df.select(text.redacted(F.col("t")).alias("r"), text.leak_categories(F.col("t")).alias("c")).first()
    assert got["r"] == "mail [REDACTED:EMAIL] from [REDACTED:IP] with [REDACTED:SECRET] and [REDACTED:CANARY]"
    assert got["c"] == ["secret", "email", "ip", "canary"]


def test_asof_against_brute_force(spark):
    rng = random.Random(3)
    left = [(i, rng.randrange(4), rng.randrange(40)) for i in range(120)]
    right = [(k, t, t * 10 + k) for k in range(4) for t in sorted(rng.sample(range(40), 9))]
    l = spark.createDataFrame(left, "id int, k int, t int")
    r = spark.createDataFrame(right, "k int, at int, v int")
    for forward in (False, True):
        for strict in (False, True):
            got = {x["id"]: x["asof_v"] for x in sequence.asof(l, r, ["k"], "t", "at", ["v"], forward, strict).collect()}
            for i, k, t in left:
                fit = [(at, v) for kk, at, v in right if kk == k and ((at < t or (at == t and not strict)) if not forward else (at > t or (at == t and not strict)))]
                want = (min(fit) if forward else max(fit))[1] if fit else None
                assert got[i] == want, (forward, strict, i)


def test_watermark(spark):
    rows = [("a", 3), ("a", 4), ("a", 4), ("a", 6), ("b", 9), ("c", 1), ("c", 3)]
    df = spark.createDataFrame(rows, "p string, o long")
    got = dict(sequence.watermark(df, ["p"], "o", F.lit(3).cast("long")).collect())
    assert got == {"a": 5, "b": 3, "c": 4}


def test_slices_differ_from_ntile(spark):
    df = spark.createDataFrame([(i,) for i in range(6)], "i int").withColumn("k", F.lit(0))
    got = [r["slice"] for r in sequence.slices(df, ["k"], ["i"], 4).orderBy("i").collect()]
    assert got == [0, 1, 1, 2, 3, 3]


def test_active_at(spark):
    rng = random.Random(5)
    day = 86_400_000_000
    iv = [(s, s + rng.randrange(1, 5 * day) if rng.random() < .8 else None) for s in (rng.randrange(9 * day) for _ in range(60))]
    at = sorted({rng.randrange(12 * day) for _ in range(30)} | {iv[0][0]})
    got = dict(sequence.active_at(spark.createDataFrame(iv, "s long, e long"), "s", "e", spark.createDataFrame([(x,) for x in at], "t long"), "t").collect())
    assert got == {x: sum(s <= x and (e is None or x < e) for s, e in iv) for x in at}


def test_ready_needs_dependencies(spark):
    nodes = spark.createDataFrame([("a", ["x", "y"]), ("b", ["x"]), ("c", []), ("d", None)], "n string, deps array<string>")
    states = spark.createDataFrame([("x", "SUCCEEDED"), ("y", "FAILED")], "dep string, state string")
    got = {r["n"]: r["ready"] for r in relational.ready(nodes, "n", "deps", states, "dep", F.col("state") == "SUCCEEDED").collect()}
    assert got == {"a": False, "b": True, "c": False, "d": False}


def test_medians_and_wilson(spark):
    df = spark.createDataFrame([(float(x),) for x in (4, 1, 3, 2)], "x double")
    r = df.agg(stats.median_interpolated("x"), stats.median_low("x"), stats.median_high("x"), stats.nearest_rank("x", 0.51)).first()
    assert tuple(r) == (2.5, 2.0, 3.0, 3.0)
    low, high = stats.wilson_exact(7, 10)
    w = spark.range(1).select(*stats.wilson(F.lit(7), F.lit(10)), *stats.wilson(F.lit(0), F.lit(0))).first()
    assert abs(w[0] - low) < 1e-12 and abs(w[1] - high) < 1e-12
    assert w[2] is None or w[2] == 0.0
    assert stats.next_fit([3, 3, 5, 1], 6) == [[0, 1], [2, 3]]


def test_keyword_score_counts_repeats(spark):
    d = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "doc_id int, text string")
    q = spark.createDataFrame([(0, "alpha alpha beta delta")], "query_id int, query string")
    assert [(r["doc_id"], r["score"]) for r in retrieval.keyword_search(q, d, "doc_id").collect()] == [(1, 1.0)]


def test_fusion_ties_by_id(spark):
    one = spark.createDataFrame([(0, 1, 1), (0, 2, 2)], "query_id int, item int, rank int")
    two = spark.createDataFrame([(0, 2, 1), (0, 1, 2)], "query_id int, item int, rank int")
    assert [r["item"] for r in retrieval.fuse([one, two], "item").orderBy("rank").collect()] == [1, 2]


def test_threshold_candidates_reach_beyond(spark):
    df = spark.createDataFrame([(0.5,), (0.25,), (0.5,)], "s double")
    got = sorted(r[0] for r in retrieval.threshold_candidates(df, "s").collect())
    assert got[:2] == [0.25, 0.5] and got[2] > 0.5 and len(got) == 3
    assert retrieval.threshold_candidates(df.limit(0), "s").collect()[0][0] == float("inf")


def test_machine_rejects_stale_and_illegal(spark):
    rows = [("w", 1, 0, "WAITING_TIMER"), ("w", 2, 0, "RUNNABLE"), ("w", 3, 1, "SUCCEEDED"), ("w", 4, 1, "RUNNABLE"), ("w", 5, 2, "SUCCEEDED"), ("w", 6, 3, "RUNNABLE")]
    df = spark.createDataFrame(rows, "k string, i long, expected long, target string")
    got = [r["outcome"] for r in replay.replay_machine(df, ["k"], ["i"]).orderBy("i").collect()]
    assert got == ["APPLIED", "STALE", "ILLEGAL", "APPLIED", "APPLIED", "TERMINAL"]


def test_effect_and_lease_folds(spark):
    e = [("r", 1, "k1", "a", 1, 0), ("r", 2, "k1", "a", 1, 0), ("r", 3, "k1", "b", 1, 0), ("r", 4, "k2", "a", 3, 5), ("r", 5, "k3", "a", 2, 1), ("r", 6, "k4", "a", 3, 1)]
    df = spark.createDataFrame(e, "res string, i long, effect_key string, argument_hash string, fence long, revision long")
    assert [r["outcome"] for r in replay.replay_effects(df, ["res"], ["i"]).orderBy("i").collect()] == ["APPLIED", "DUPLICATE", "CONFLICT", "REJECTED", "FENCED", "APPLIED"]
    l = [("p", 1, "acquire", "a", 0, 10), ("p", 2, "acquire", "b", 5, 10), ("p", 3, "renew", "a", 8, 10), ("p", 4, "acquire", "b", 20, 10), ("p", 5, "release", "a", 21, 10), ("p", 6, "release", "b", 22, 10)]
    df = spark.createDataFrame(l, "p string, i long, action string, owner string, at long, ttl long")
    assert [r["outcome"] for r in replay.replay_leases(df, ["p"], ["i"]).orderBy("i").collect()] == ["EPOCH_1", "HELD", "RENEWED", "EPOCH_2", "LOST", "RELEASED"]


def test_registry(spark):
    known = registry.default_activities()
    assert known.names() == ["busy_work@1", "chunk_digest@1", "cpu_work@1", "sha256_workload@1"]
    one = F.lit(1).cast("long")
    assert spark.range(1).select(registry.xorshift(one, 1)).first()[0] == 0x40822041
    digest = hashlib.sha256(hashlib.sha256(b"1").digest()).hexdigest()
    got = spark.range(1).select(registry.sha_rounds(one, 2), registry.sha_rounds(one, 0), registry.block_workload(one, 1), registry.chunk_chain(one, 1)).first()
    chain = hashlib.sha256(f"{hashlib.sha256(b'1').hexdigest()}:0".encode()).hexdigest()
    assert tuple(got) == (digest, "31", hashlib.sha256(bytes((1 + i) % 256 for i in range(256))).hexdigest(), chain)
    with pytest.raises(ValueError):
        known.register("cpu_work", 1, registry.echo)
    assert registry.allowed_call("search", {"query": "q", "arm": "dense"}) and not registry.allowed_call("drop", {})
    assert not registry.allowed_call("search", {"query": "q"}) and not registry.allowed_call("search", {"query": "q", "arm": "x", "other": "y"})


def test_upsert_keeps_nulls(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    assert sorted(tuple(r) for r in relational.upsert(old, new, ["k"]).collect()) == [(1, "a"), (2, None), (3, "c")]


def test_admission_and_limits(spark):
    r = spark.range(1).select(relational.over_limit(F.lit(5), 5), relational.over_limit(F.lit(6), 5), relational.over_limit(F.lit(9), 0),
                              relational.admits(F.lit(4), F.lit(0), 4, 9), relational.admits(F.lit(3), F.lit(8), 4, 9)).first()
    assert tuple(r) == (False, True, False, False, True)
