"""Searches and vector texts on odd rows, against the SQL of their queries."""

import hashlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

duckdb = pytest.importorskip("duckdb")

from strataq.queries import base  # noqa: E402
from tests.test_queries import rows_of  # noqa: E402

base.load()


def place(token):
    h = hashlib.sha256(token.encode()).digest()
    return int.from_bytes(h[:4], "big") % 64, h[4] % 2


def against_sql(spark, folder, name, **tables):
    con = duckdb.connect()
    for t, rows in tables.items():
        pq.write_table(rows, folder / f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    df = base.QUERIES[name](spark, str(folder))
    cur = con.execute(base.SQL[name])
    names = [c[0] for c in cur.description]
    got, want = rows_of(df.columns, df.collect()), rows_of(names, cur.fetchall())
    assert got == want
    return want


@pytest.mark.parametrize("name", ["rank_fusion", "hybrid_delivery"])
def test_texts_that_cancel_out_or_hold_no_token(spark, tmp_path, name):
    words = [f"w{i}" for i in range(400)]
    a, b = next((x, y) for x in words for y in words if place(x)[0] == place(y)[0] and place(x)[1] != place(y)[1])
    texts = [f"{a} {b}", "", None, "...", "alpha beta", "beta alpha", "gamma", "alpha gamma delta", "Alpha beta beta İx", "beta", "delta epsilon"]
    documents = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})
    queries = ["alpha beta", "", None, "!!", f"{a} {b}", "gamma", f"{a} alpha beta gamma", "nothing of it"]
    found = against_sql(spark, tmp_path, name, documents=documents, benchmark=pa.table({"item_id": pa.array(range(len(queries)), pa.int64()), "text": queries}))
    assert found and not {"1.0", "2.0", "3.0"} & {r[1] for r in found}


@pytest.mark.parametrize("name", ["rank_fusion", "hybrid_delivery"])
def test_rows_of_one_id_are_one_text(spark, tmp_path, name):
    documents = pa.table({"doc_id": pa.array([1, 1, 2, 3, 4, None], pa.int64()), "text": ["alpha beta", "gamma", "alpha", "beta gamma", "delta", None]})
    against_sql(spark, tmp_path, name, documents=documents, benchmark=pa.table({"item_id": pa.array([0, 1], pa.int64()), "text": ["alpha beta gamma", "delta"]}))


def test_vector_texts_round_the_exact_value(spark, tmp_path):
    vectors = [[0.1494140625, 0.0415039062, 0.15039062499], [2.5, -0.0, 1e-5, 1e10, 123456789.5], [], None, [None], [1.0, None, 2.0], [float("nan"), float("inf"), float("-inf")]]
    rows = pa.table({"vec_id": pa.array(range(len(vectors)), pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array([0] * len(vectors), pa.int32())})
    assert "[0.149414062," in against_sql(spark, tmp_path, "vector_text", embeddings=rows)[0][1]
