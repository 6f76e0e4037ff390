import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import topk
from pagemill.llm.topk import ORACLE, Tree, op10_exact_topk, top_k
from tests.llm.sql import same


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_against_sql(spark, sf):
    assert same(op10_exact_topk(spark, f"/root/testdata/{sf}"), ORACLE["op10_exact_topk"], f"/root/testdata/{sf}")


def brute(ids, x, qid, q, k):
    out = []
    for i, v in zip(qid, q, strict=True):
        s = sorted((-int(a), int(j)) for a, j in zip(x @ v, ids, strict=True) if j != i)[:k]
        out += [(int(i), j, -a) for a, j in s]
    return out


@pytest.mark.parametrize("spread", [1, 3, 200, 10**8])
def test_tree_with_ties(spread):
    r = np.random.default_rng(spread)
    x = r.integers(-spread, spread + 1, (700, 5))
    x[100:400] = x[7]
    ids = r.permutation(700)
    q, qid = x[:40], ids[:40]
    none = np.full(40, -(1 << 63), np.int64)
    want = brute(ids, x, qid, q, 4)
    assert Tree(ids, x).search(qid, q, 4, none) == want
    kth = np.array([w[2] for w in want[3::4]])
    assert Tree(ids, x).search(qid, q, 4, kth) == want


def test_odd_rows_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 20)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 4)
    r = np.random.default_rng(5)
    good = [(i, [float(v) for v in r.normal(size=3)]) for i in range(150)]
    good += [(150 + i, list(good[0][1])) for i in range(60)]
    odd = [(500, None), (510, []), (520, [1.0, None, 2.0]), (530, [1.0, float("nan"), 0.0]), (540, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (550, [1.0, 2.0]), (551, [3.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in good + odd], "vec_id long, embedding array<double>, score int")
    got = {}
    for t in top_k(df, F.col("vec_id") % 10 == 0, k=5).collect():
        got.setdefault(t.query_id, []).append((t.rank, t.vec_id, t.score))
    ids = np.array([i for i, _ in good])
    x = np.floor(256 * np.array([v for _, v in good])).astype(np.int64)
    pick = ids % 10 == 0
    want = {}
    for i, j, s in brute(ids, x, ids[pick], x[pick], 5):
        want.setdefault(i, []).append((len(want.get(i, [])) + 1, j, s))
    want[550] = [(1, 551, 256 * 768 + 512 * 512)]
    assert {q: sorted(v) for q, v in got.items()} == want
    assert top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
