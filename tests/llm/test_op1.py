import numpy as np
import pytest

from pagemill.llm import embedding_dedup
from pagemill.llm.embedding_dedup import ORACLE, near_vectors, op1_embedding_dedup, quantise
from tests.llm.sql import same


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_against_sql(spark, sf):
    assert same(op1_embedding_dedup(spark, f"/root/testdata/{sf}"), ORACLE["op1_embedding_dedup"], f"/root/testdata/{sf}")


def test_bounds_hold():
    x = np.random.default_rng(0).normal(size=(300, 16)) * 10.0 ** np.arange(-100, 200)[:, None]
    t = quantise(x)
    u = x / np.abs(x).max(axis=1, keepdims=True)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = t["scale"][:, None] * t["scale"] * (t["q"].astype(int) @ t["q"].astype(int).T)
    slack = t["m"][:, None] * t["e"] + t["e"][:, None] * (t["m"] + t["e"])
    assert (np.abs(u @ u.T - near) <= slack + 1e-12).all()


def brute(rows, least):
    ok = [i for i, (k, v) in enumerate(rows) if k is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(rows[i][1]) / np.linalg.norm(rows[i][1]) for i in ok}
    links = {i: [j for j in ok if j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least] for i in ok}
    out = []
    for i, (k, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        comp = min((rows[j][0] for j in seen), default=None) if k is not None else None
        out.append((k, len(links.get(i, [])), comp, k is not None and k == comp))
    return out


def test_several_tiles_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE_ROWS", 25)
    monkeypatch.setattr(embedding_dedup, "STRIP_ROWS", 7)
    r = np.random.default_rng(2)
    rows = [(int(i), r.normal(size=4).tolist()) for i in r.permutation(130)]
    rows += [(200 + i, rows[3][1]) for i in range(30)] + [rows[3], rows[9], rows[9]]
    rows += [(300, None), (301, []), (302, [0.0] * 4), (303, [1.0, None, 0.0, 0.0]), (304, [float("nan")] * 4), (305, [float("-inf"), 0.0, 0.0, 0.0]), (None, rows[0][1]), (306, [1.0, 2.0]), (307, [2.0, 4.1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, n_links string")
    got = [tuple(t) for t in near_vectors(df, 0.9).collect()]
    key = lambda t: tuple((x is None, x) for x in t)
    assert sorted(got, key=key) == sorted(brute(rows, 0.9), key=key)
    assert near_vectors(df.limit(0)).count() == 0
