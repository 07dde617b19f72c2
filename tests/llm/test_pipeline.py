"""The pipeline, stage by stage, on a small table and on the smallest test data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stage_columns_and_effects(spark, tmp_path):
    long_ = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    item = " ".join(f"exam{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(30))
    rows = [(1, long_, "en", "s", 1), (2, long_ + " tail", "en", "s", 1), (3, "12 34", "en", "s", 1), (4, "some words before " + item, "en", "s", 1), (5, None, "en", "s", None), (6, "plain words", "en", None, 1)]
    rows += [(10 + i, f"own number line {chr(97 + i)}\nshared footer line", "en", "t", 1) for i in range(8)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        seen[name] = docs
        if name != "best_fit_packing":
            assert docs.columns == COLUMNS
    ids = {n: {r["doc_id"] for r in d.select("doc_id").collect()} for n, d in seen.items()}
    tails = set(range(10, 18))
    assert ids["language_id"] == {1, 2, 4, 6} | tails
    assert seen["line_dedup"].where("text like '%footer%'").count() == 0 and ids["line_dedup"] == ids["language_id"]
    assert ids["jaccard_join"] == {1, 4, 6} | tails
    assert ids["decontaminate"] == {1, 6} | tails == ids["best_fit_packing"]
    assert sum(r["length"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sum(r["length"] for r in seen["best_fit_packing"].collect())


def test_one_copy_of_a_large_group_keeps_its_text(spark, tmp_path):
    word = lambda i: f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}"
    page = lambda k: "\n".join(" ".join(f"w{word(40 * k + 10 * i + j)}" for j in range(10)) for i in range(4))
    rows = [(i, page(0) if i < 12 else page(i) + "\nshared footer line", "en", "big", 1) for i in range(300)]
    rows += [(1000 + i, page(400) if i < 6 else page(400 + i), "en", "small", 1) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    cleaned = corpus_pipeline.lines(spark, docs, "")
    assert cleaned.where("text like '%footer%'").count() == 0
    cleaned.write.parquet(f"{tmp_path}/lines")
    left = corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"{tmp_path}/lines"), "").collect()
    assert sum(r["text"] == page(0) for r in left) == 1 and sum(r["text"] == page(400) for r in left) == 1
    assert len(left) == 289 + 15 and all(r["text"] for r in left)


ODD = [(1, "plain words of some page", "en", "s", 5, "a"), (1, "plain words of some page", "en", "s", 5, "a"), (1, "another text of this id", "en", "s", 5, "b"), (2, None, "en", "s", None, "c"),
       (3, "", "fr", None, 0, None), (None, "no id but words", None, "s", 1, "d"), (None, "no id but words", None, "s", 1, "d"), (4, "word " * 30000, "en", "s", 2, "e"), (5, " \n ", "en", "s", 3, "f"), (6, "plain words of some page", "en", "t", 5, "g")]


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_rows(spark, tmp_path, k):
    """Nulls in any column, empty and long texts, repeated rows, one id with two texts, clashing names; then no rows at all."""
    extra = ("score", "held_out", "lang_pred", "n_lines", "n_dropped", "_rest", "_row0", "_id0", "_k0", "id", "k", "key", "row", "spans", "h", "drop", "rank", "length", "task")
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long, own string").withColumns({c: F.lit("clash") for c in extra})
    spark.createDataFrame([(0, "an item that nobody holds at all"), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = corpus_pipeline.STAGES[k][1]
    out = stage(spark, docs, str(tmp_path))
    rows = out.collect()
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    if k == 4:
        assert sorted((r["doc_id"] or 0) for r in rows if r["piece"] == 0) == sorted((r[0] or 0) for r in ODD)
        return
    assert out.columns == docs.columns and all(r[c] == "clash" for r in rows for c in extra)
    texts = [(r["doc_id"], r["text"], r["source"], r["own"]) for r in rows]
    given = [(r[0], r[1], r[3], r[5]) for r in ODD]
    lone = lambda rows: sorted(map(str, rows))
    if k == 0:
        assert lone(texts) == lone(r for r in given if r[1] and r[1].strip()) and {r["lang"] for r in rows} <= {"en", "fr"}
    elif k == 1:
        assert lone(texts) == lone(given) and {r["n_chars"] for r in rows if r["text"] is None} == {None}
    elif k == 2:
        # ids 1 and 6 share a text; id 1 stands three times, with two texts
        assert lone(texts) == lone([*given[1:4], *given[4:9]])
    else:
        assert lone(texts) == lone(given)


def test_pipeline_on_test_data(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    fill = np.zeros(1 + max(r["sequence_id"] for r in out), np.int64)
    for r in out:
        fill[r["sequence_id"]] += r["length"]
    assert (fill <= 2048).all() and (fill[:-1] > 0).all()
