"""Blocks of postings, and searches that open few of them, against plain sums."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagemill.config import RetrievalConfig
from pagemill.operators import dealt, index, postings, retrieve

#: All searches go by blocks here.
CFG = RetrievalConfig(plain_postings=0)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(3)
    common = ["aa", "bb", "cc", "dd"]
    docs = []
    for i in range(1500):
        words = r.choices(common, weights=[8, 4, 2, 1], k=r.randint(0, 30)) + [f"w{min(int(r.expovariate(0.02)), 700)}" for _ in range(r.randint(0, 12))]
        r.shuffle(words)
        docs.append((i, " ".join(words)))
    docs[7] = (7, "aa " * 40 + "w1 w2 w3")
    return docs + [(7, "aa aa"), (2000, None), (2001, "")]


@pytest.fixture(scope="module", params=[10**6, 100])
def built(spark, corpus, tmp_path_factory, request):
    """With and without hot terms."""
    path = str(tmp_path_factory.mktemp("ix"))
    postings.write(spark.createDataFrame(corpus, "doc_id long, text string").repartition(5), path, hot=request.param)
    return index.read_index(spark, path)


def tokens(corpus):
    out = {}
    for i, t in corpus:
        c = Counter((t or "").split())
        out.setdefault(i, []).append(c)
    return {i: (sum(cs, Counter()), max(sum(c.values()) for c in cs)) for i, cs in out.items()}


def brute(corpus, queries, k, cfg=CFG, allowed=None):
    docs = tokens(corpus)
    n, total = len(corpus), sum(sum(c.values()) for c, _ in docs.values())
    avg = total / n
    df = Counter(t for c, _ in docs.values() for t in c)
    out = {}
    for q, text in queries:
        scores = {}
        for i, (c, dl) in docs.items():
            if allowed is not None and i not in allowed:
                continue
            s = sum(m * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * (cfg.k1 + 1) / (c[t] + cfg.k1 * (1 - cfg.b + cfg.b * max(dl, 1) / avg)) for t, m in Counter(text.split()).items() if c[t])
            if s:
                scores[i] = round(s, 9)
        out[q] = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


def same(df, want):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    for q, hits in want.items():
        mine = got.get(q, [])
        assert [i for i, _ in mine] == [i for i, _ in hits], q
        assert all(abs(a - b) < 1e-8 for (_, a), (_, b) in zip(mine, hits, strict=True))


QUERIES = [(1, "aa"), (2, "aa bb cc dd"), (3, "aa bb w1 w2 w3 w4 w5"), (4, "w650 aa"), (5, "nothing"), (6, "aa aa aa w10 w11"), (7, "w1 w2 w3 w5 w8 w13 w21 w34 w55 aa bb cc dd"), (8, "w700 w699"), (9, "")]


@pytest.mark.parametrize("k", [1, 5, 3000])
def test_top_k_equals_plain_sums(spark, corpus, built, k):
    q = spark.createDataFrame(QUERIES, "query_id long, query string")
    same(retrieve.bm25(q, built, k, CFG), brute(corpus, QUERIES, k))


def test_other_parameters_need_no_other_blocks(spark, corpus, built):
    cfg = RetrievalConfig(k1=0.4, b=0.1, plain_postings=0)
    q = spark.createDataFrame(QUERIES, "query_id long, query string")
    same(retrieve.bm25(q, built, 5, cfg), brute(corpus, QUERIES, 5, cfg))


def test_restricted_search(spark, corpus, built):
    q = spark.createDataFrame(QUERIES, "query_id long, query string")
    allowed = spark.range(0, 1500, 3).withColumnRenamed("id", "doc_id")
    same(retrieve.bm25(q, built, 5, CFG, allowed=allowed), brute(corpus, QUERIES, 5, allowed=set(range(0, 1500, 3))))
    only = lambda rows: rows.where((F.col("doc_id") % 7 == F.col("query_id") % 7))
    for qid, text in QUERIES:
        one = q.where(F.col("query_id") == qid)
        same(retrieve.bm25(one, built, 5, CFG, only=only), brute(corpus, [(qid, text)], 5, allowed={i for i in range(3000) if i % 7 == qid % 7}))


def test_few_postings_of_frequent_terms_are_opened(spark, built):
    q = spark.createDataFrame([(1, "w150 w151 aa bb cc dd"), (2, "aa bb")], "query_id long, query string")
    rows = {r.query_id: r for r in postings.search(retrieve.query_terms(q), built, retrieve.term_score, 1, CFG).opened().collect()}
    assert rows[1].postings > 2000 and rows[1].opened < rows[1].postings / 3


def test_few_postings_are_scored_one_by_one(spark, corpus, built, monkeypatch):
    monkeypatch.setattr(postings, "Search", None)
    q = spark.createDataFrame(QUERIES, "query_id long, query string")
    same(retrieve.bm25(q, built, 5), brute(corpus, QUERIES, 5))


def test_blocks(spark, corpus, built):
    docs = tokens(corpus)
    rows = built.blocks.collect()
    seen = Counter()
    for r in rows:
        assert r.n == len(r.rows) and r.tokens == sum(x.tf for x in r.rows) and r.n < 3 * postings.BLOCK
        for x in r.rows:
            assert docs[x.doc_id][0][r.term] == x.tf and docs[x.doc_id][1] == x.dl
            seen[x.doc_id, r.term] += 1
        pairs = {(x.tf, x.dl) for x in r.rows}
        corners = {p for p in pairs if not any(o != p and o[0] >= p[0] and o[1] <= p[1] for o in pairs)}
        assert {tuple(p) for p in r.frontier} == corners
    assert set(seen) == {(i, t) for i, (c, _) in docs.items() for t in c} and set(seen.values()) == {1}
    terms = {r.term: r for r in built.terms.collect()}
    assert {t: r.df for t, r in terms.items()} == Counter(t for _, t in seen)


def test_an_empty_corpus(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id string, text string")
    index.write_index(docs, f"{tmp_path}/ix")
    ix = index.read_index(spark, f"{tmp_path}/ix")
    q = spark.createDataFrame([(1, "aa")], "query_id long, query string")
    assert retrieve.bm25(q, ix, 5, CFG).count() == 0 and ix.postings.count() == 0


#: Searches by postings dealt out by document, in several parts.
DEALT = RetrievalConfig(plain_postings=1)


@pytest.mark.parametrize("k", [1, 5, 3000])
def test_dealt_postings_equal_plain_sums(spark, corpus, built, k, monkeypatch):
    monkeypatch.setattr(dealt, "POSTINGS", 2000)
    monkeypatch.setattr(postings.Search, "__init__", None)  # goes by no search
    q = spark.createDataFrame(QUERIES, "query_id long, query string")
    same(retrieve.bm25(q, built, k, DEALT), brute(corpus, QUERIES, k, DEALT))
    some = set(range(0, 1500, 3))
    allowed = spark.createDataFrame([(i,) for i in [*some, 99999]], "doc_id long")
    same(retrieve.bm25(q, built, k, DEALT, allowed), brute(corpus, QUERIES, k, DEALT, some))
    wants = q.withColumn("want", F.when(F.col("query_id") % 3 == 0, None).otherwise((F.col("query_id") % 3).cast("string")))
    have = spark.range(2010).select(F.col("id").alias("doc_id"), (F.col("id") % 4).cast("string").alias("has"))
    got = retrieve.bm25(wants, built, k, DEALT, match=[("want", "has")], attributes=have)
    for rest in range(3):
        mine = [x for x in QUERIES if x[0] % 3 == rest]
        same(got.where(F.col("query_id") % 3 == rest), brute(corpus, mine, k, DEALT, None if rest == 0 else set(range(rest, 2010, 4))))


def test_dealt_postings_move_once(spark, corpus, built, monkeypatch):
    """A hundred queries of the same words move no more postings than one."""
    moved = []
    monkeypatch.setattr(dealt, "top", lambda asked, names, found, size, *rest: moved.append((found.count(), size)) or asked.selectExpr("query_id", "1L as doc_id", "1.0D as score"))
    for n in (1, 100):
        q = spark.createDataFrame([(i, "aa bb w1") for i in range(n)], "query_id long, query string")
        retrieve.bm25(q, built, 5, DEALT).count()
    assert moved[0] == moved[1] and moved[0][0] == moved[0][1]


def test_a_part_of_the_index_stays_small(spark):
    """A task makes the postings of some 8 million characters, however many
    there are in all and whatever the number of cores."""
    for n in (40, 160):
        docs = spark.range(n).select(F.col("id").alias("doc_id"), F.expr("repeat('x', 1048576)").alias("text"))
        to = postings.layout(docs, "doc_id", "text")
        assert n / (to.buckets * to.spread) <= 10
