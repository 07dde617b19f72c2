"""Versions, units, evidence and retrieval grids on small tables, with what each must refuse."""

import random

import pytest
from pyspark.sql import functions as F

from strataq.operators import changes, evidence, retrieval
from strataq.sources import readers, sinks
from strataq.sources.store import Conflict, Versions


def test_versions_refuse_a_second_writer(spark, tmp_path):
    table = Versions(spark, f"file://{tmp_path}/t")
    assert table.last() == 0
    one = spark.createDataFrame([(1, "a")], "k int, v string")
    assert table.commit(one, 0) == 1 and table.last() == 1
    assert table.change(lambda s: s.unionByName(spark.createDataFrame([(2, "b")], "k int, v string"))).count() == 2
    with pytest.raises(Conflict):
        table.commit(one, 1)
    assert table.last() == 2 and table.read(1).count() == 1
    calls = []

    def racing(s):
        if not calls:
            table.commit(s, 2)  # another writer is first
        calls.append(s.count())
        return s.where("k = 1")

    assert table.change(racing).count() == 1 and len(calls) == 2 and table.last() == 4


def test_units_are_written_once(spark, tmp_path):
    df = spark.createDataFrame([(u, i) for u in range(3) for i in range(2)], "unit int, i int")
    p = f"file://{tmp_path}/units"
    assert sinks.write_units(df.where("unit < 2"), p, "unit") == ["0", "1"]
    assert sinks.write_units(df, p, "unit") == ["2"] and sinks.write_units(df, p, "unit") == []
    assert spark.read.parquet(p).count() == 6


def test_each_journal_may_be_torn(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"j{i}").write_text('{"a":1}\n' * (i + 1) + ('{"a"' if i else ""))
    assert readers.read_journal(spark, str(tmp_path)).count() == 6
    (tmp_path / "j3").write_text('{"a"\n{"a":1}\n')
    with pytest.raises(readers.SourceError):
        readers.read_journal(spark, str(tmp_path))


def test_insert_and_submit_twice(spark):
    state = spark.createDataFrame([(1, "a")], "k int, d string")
    batch = spark.createDataFrame([(1, 1, "a"), (1, 2, "x"), (2, 3, "b"), (2, 4, "b"), (2, 5, "c")], "k int, o int, d string")
    got = {r["o"]: r["outcome"] for r in changes.submit(state, batch, ["k"], "o", "d").collect()}
    assert got == {1: "REPEATED", 2: "CONFLICT", 3: "ACCEPTED", 4: "REPEATED", 5: "CONFLICT"}
    assert sorted(tuple(r) for r in changes.insert_once(state, batch.select("k", "d"), ["k"]).collect()) == [(1, "a"), (2, "b")]


def test_exchange_rules(spark):
    rows = [("s", i, "d", e, "h") for i, e in enumerate(("recv", "send"))]
    schema = "s string, n int, d string, e string, h string"
    sealed = spark.createDataFrame([("s", 2)], "s string, high_water int")
    check = lambda r, w=sealed: {v["rule"] for v in evidence.exchanges(spark.createDataFrame(r, schema), "s", "n", "d", "e", "h", w, ["recv", "send"]).collect()}
    assert check(rows) == set()
    assert check([rows[0], ("s", 1, "d", "send", "x")]) == {"forwarded bytes"}
    assert check([rows[0], ("s", 2, "d", "send", "h")]) == {"sequence gap", "high water"}
    assert check(rows[::-1][:1]) == {"sequence gap", "event order"}
    assert check([rows[0], ("s", 1, "d", "recv", "h")]) == {"event order"}


def test_seals_and_sessions(spark):
    prefixes = spark.createDataFrame([("a", bytearray(b"xy"), 2)], "k string, content binary, rows int")
    digest = prefixes.select(F.sha2("content", 256)).first()[0]
    check = lambda *row: {v["rule"] for v in evidence.seals(prefixes, spark.createDataFrame([row], "k string, size int, digest string, lines int"), "k").collect()}
    assert check("a", 2, digest, 2) == set() and check("a", 3, digest, 2) == {"length"} and check("b", 2, digest, 2) == {"no prefix"}
    assert check("a", 2, "0", 3) == {"digest", "rows"}
    events = spark.createDataFrame([(1, "p", 5), (2, "p", 10), (3, "q", 5)], "e int, k string, at int")
    sessions = spark.createDataFrame([("p", 0, 10), ("p", 4, 6)], "k string, began int, ended int")
    assert {r["e"]: r["sessions"] for r in evidence.single_session(events, sessions, "k", "e", "at").collect()} == {1: 2, 2: 0, 3: 0}


def test_full_text_rank_has_the_published_values(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c d a"), (3, "a"), (4, "b"), (5, None)], "doc_id int, text string")
    queries = spark.createDataFrame([(1, "a b"), (2, "b"), (3, "zz"), (4, "")], "query_id int, query string")
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in retrieval.full_text_search(queries, docs, "doc_id").collect()}
    assert got[1, 1] == 0.099103 and got[2, 4] == 0.060793  # ts_rank gives 0.09910322 and 0.06079271
    assert set(got) == {(1, 1), (1, 2), (2, 1), (2, 2), (2, 4)} and got[1, 2] < got[1, 1]


def test_threshold_grid_against_counting(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(20) / 4, rng.random() < 0.5) for _ in range(200)]
    grid = [-1.0, 0.0, 0.3, 2.25, 2.26, 9.0]
    df = spark.createDataFrame(rows, "s double, t boolean")
    out = retrieval.threshold_grid(df, "s", F.col("t"), spark.createDataFrame([(g,) for g in grid], "threshold double")).collect()
    assert {r["threshold"]: (r["tp"], r["fp"]) for r in out} == {g: (sum(t for s, t in rows if s >= g), sum(not t for s, t in rows if s >= g)) for g in grid}


def test_dense_search_against_all_pairs(spark):
    rng = random.Random(2)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(60)] + [(60, [0.0] * 6), (61, None)]
    vectors[40] = (40, vectors[3][1])
    corpus = spark.createDataFrame(vectors, "id long, v array<double>")
    queries = corpus.where("id < 5").withColumnRenamed("id", "query_id")
    got = {}
    for r in retrieval.dense_search(queries, corpus.repartition(3), "id", "v", k=4, exclude_self=True).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    unit = lambda v: [x / (sum(y * y for y in v) ** 0.5 or 1) for x in v] if v else [0.0] * 6
    for q in range(5):
        want = sorted(((-round(sum(a * b for a, b in zip(unit(vectors[q][1]), unit(v))), 8), i) for i, v in vectors if i != q))[:4]
        assert [(i, s) for _, i, s in sorted(got[q])] == [(i, -s) for s, i in want]
