import random

from pagemill.llm.shelf import components


def test_components_against_union_find(spark):
    r = random.Random(6)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(70)] + [(2000, 2000 + i) for i in range(1, 60)] + [(5, 5)]
    top = {}

    def root(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        top[max(a, b)] = min(a, b)
    want = sorted((x, root(x)) for x in top if any(x in e and e[0] != e[1] for e in edges))
    df = spark.createDataFrame(edges, "a long, b long")
    assert sorted(map(tuple, components(df).collect())) == want
    assert components(df.limit(0)).count() == 0
