"""Dense search, exact by tiles and by an inverted file, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.operators import retrieve, vectors


def plain(queries, rows, k, ok=lambda q, d: True):
    out = {}
    for q, x in queries:
        sims = sorted(((-round(float(np.dot(np.array(x, float), np.array(v, float))), 9), d) for d, v in rows if v is not None and len(v) == len(x) and ok(q, d)))
        out[q] = [(d, -s) for s, d in sims[:k]]
    return {q: h for q, h in out.items() if h}


def hits(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.doc_id, r.similarity))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(0)
    centers = r.normal(size=(20, 12))
    rows = centers[r.integers(0, 20, 3000)] + 0.4 * r.normal(size=(3000, 12))
    rows = (rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.float32)
    rows[100:140] = rows[100]  # copies: ties by id
    docs = [(i, x.tolist()) for i, x in enumerate(rows)]
    return docs, spark.createDataFrame(docs, "doc_id long, embedding array<float>").repartition(3)


@pytest.mark.parametrize("sent", [True, False])
def test_exact(spark, data, monkeypatch, sent):
    if not sent:
        monkeypatch.setattr(vectors, "SENT", 0)
    monkeypatch.setattr(vectors, "TILE", 50)
    docs, df = data
    q = [(i, docs[i * 7 + 100][1]) for i in range(120)]
    asked = spark.createDataFrame(q, "query_id long, embedding array<float>")
    assert hits(retrieve.dense(asked, df, 7)) == plain(q, docs, 7)
    assert hits(retrieve.dense(asked.limit(3), df.where("doc_id < 4"), 7)) == plain(q[:3], docs[:4], 7)


def test_restricted(spark, data):
    docs, df = data
    q = [(i, docs[i][1]) for i in range(40)]
    asked = spark.createDataFrame([(i, x, None if i % 3 == 0 else f"p{i % 4}", None if i % 2 else "t1") for i, x in q], "query_id long, embedding array<float>, want_p string, want_t string")
    has = spark.createDataFrame([(i, f"p{i % 5}" if i % 11 else None, f"t{i % 2}") for i, _ in docs], "doc_id long, has_p string, has_t string")
    ok = lambda i, d: (i % 3 == 0 or (d % 11 != 0 and f"p{i % 4}" == f"p{d % 5}")) and (i % 2 == 1 or d % 2 == 1)
    match = [("want_p", "has_p"), ("want_t", "has_t")]
    assert hits(retrieve.dense(asked, df, 5, match=match, attributes=has)) == plain(q, docs, 5, ok)
    allowed = spark.range(0, 3000, 2).withColumnRenamed("id", "doc_id")
    assert hits(retrieve.dense(asked, df, 5, allowed)) == plain(q, docs, 5, lambda i, d: d % 2 == 0)


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, []), (4, [1.0, 0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [0.0, 0.0]), (8, [float("inf"), 1.0]), (9, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "doc_id long, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0])], "query_id long, embedding array<float>")
    assert hits(retrieve.dense(asked, df, 3)) == {1: [(1, 1.0), (9, 1.0), (7, 0.0)]}
    assert retrieve.dense(asked, df.limit(0), 3).count() == 0 and retrieve.dense(asked.limit(0), df, 3).count() == 0


def test_inverted_file(spark, data, tmp_path):
    docs, df = data
    vectors.write_ivf(df, f"{tmp_path}/ivf")
    ix = vectors.read_ivf(spark, f"{tmp_path}/ivf")
    assert ix.rows.count() == 3000 and len(ix.centroids) == 55 and ix.probes < 30
    # every row is in the folder of its nearest centroid
    own = {r.doc_id: r.cell for r in ix.rows.select("doc_id", "cell").collect()}
    near = (np.array([x for _, x in docs]) @ ix.centroids.T).argmax(axis=1)
    assert all(own[i] == c for i, c in enumerate(near.tolist()))
    q = [(i, docs[i * 9][1]) for i in range(300)]
    asked = spark.createDataFrame(q, "query_id long, embedding array<float>")
    got, want = hits(retrieve.dense(asked, ix, 5)), plain(q, docs, 5)
    found = sum(len(set(got[i]) & set(want[i])) for i in want)
    assert found >= 0.9 * sum(map(len, want.values()))
    # all cells give the exact result, with the same restrictions
    assert hits(vectors.probed(asked, ix, 5, probes=10**6)) == want
    has = df.select("doc_id", (F.col("doc_id") % 5).cast("string").alias("has"))
    some = asked.withColumn("want", (F.col("query_id") % 6).cast("string"))
    got = hits(vectors.probed(some, ix, 5, match=[("want", "has")], attributes=has, probes=10**6))
    assert got == plain(q, docs, 5, lambda i, d: i % 6 == d % 5)


def test_inverted_file_of_odd_tables(spark, tmp_path):
    kind = "doc_id string, embedding array<double>"
    for i, rows in enumerate([[], [("a", [1.0, 0.0])], [("a", [1.0, 0.0]), ("b", None), ("c", [1.0]), ("d", [0.0, 0.0]), ("e", [1.0, 0.0])] * 2]):
        vectors.write_ivf(spark.createDataFrame(rows, kind), f"{tmp_path}/{i}")
        ix = vectors.read_ivf(spark, f"{tmp_path}/{i}")
        got = vectors.probed(spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>"), ix, 3, probes=99).select("doc_id").collect()
        assert [r[0] for r in got] == [[], ["a"], ["a", "a", "e"]][i]


def test_probes_read_their_folders_alone(spark, data, tmp_path):
    _, df = data
    vectors.write_ivf(df, f"{tmp_path}/ivf")
    ix = vectors.read_ivf(spark, f"{tmp_path}/ivf")
    plan = vectors.probed(df.limit(1).select(F.col("doc_id").alias("query_id"), "embedding"), ix, 5, probes=1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [(cell" in plan or "cell#" in plan.split("PartitionFilters")[1][:60]
