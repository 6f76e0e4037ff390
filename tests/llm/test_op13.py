import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from pagemill.llm.periodic_runs import SQL, collapsed, frequent, lag_counts, op13_periodic_runs, periodic_runs, runs
from tests.llm.sql import same

SF = "/root/testdata/sf0.001"


def brute_runs(ws, times=4, least=6):
    """Every maximal stretch of every period, the smallest period of each."""
    n, found = len(ws), {}
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            if ws[i] != ws[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and ws[j] == ws[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in found.items())


def brute(doc_id, text, seeded):
    ws = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    n = len(ws)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if seeded and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)]
    found = brute_runs(ws)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(w for i, w in enumerate(ws) if i not in gone)))


def rows(df):
    return sorted(((r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in df.collect()), key=lambda r: [(x is None, x) for x in r])


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = rows(op13_periodic_runs(spark, SF))
    assert got == sorted(brute(r.doc_id, r.text, True) for r in docs)
    assert sum(r[1] for r in got) > 5


def test_sql(spark):
    assert same(op13_periodic_runs(spark, SF), SQL, SF) > 0


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_random_words(seed):
    r = random.Random(seed)
    for _ in range(60):
        ws = []
        while len(ws) < r.choice([3, 6, 7, 40, 150, 400]):
            if r.random() < 0.5:
                ws += r.choices("abc"[: r.randint(1, 3)], k=r.randint(1, 9))
            else:
                unit = r.choices("abcdefgh", k=r.randint(1, 12))
                ws += (unit * 12)[: r.randint(1, 9 * len(unit))] * r.randint(1, 2)
        number = {}
        ids = np.array([number.setdefault(w, len(number)) for w in ws])
        for times, least in ((4, 6), (2, 2), (3, 10)):
            got = runs(ids, times, least)
            assert got == brute_runs(ws, times, least), ws
        gone = {i for s, m, q in got for i in range(s + q, s + m)}
        assert np.flatnonzero(~collapsed(len(ws), got)).tolist() == sorted(gone)


def test_lags_are_exact_both_ways():
    r = np.random.default_rng(1)
    for n, kinds in ((500, 3), (3000, 40), (5000, 4000), (4000, 1)):
        ids = np.minimum(r.integers(0, kinds, n), r.integers(0, kinds, n))
        want = [0] + [int((ids[q:] == ids[:-q]).sum()) for q in range(1, n // 4 + 1)]
        assert lag_counts(ids, n // 4).tolist() == want
    # of these some words count by transform, some by pairs
    often = np.concatenate([np.full(20, 450), np.full(2000, 3)])
    assert sorted(frequent(often, 16384)) == list(range(20))
    ids = r.permutation(np.repeat(np.arange(len(often)), often))
    assert lag_counts(ids, 3000).tolist() == [0] + [int((ids[q:] == ids[:-q]).sum()) for q in range(1, 3001)]


def test_a_long_text_of_one_word_and_of_one_line():
    assert runs(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]
    assert runs(np.tile(np.arange(50), 4000)) == [(0, 200_000, 50)]


def test_odd_rows(spark):
    texts = [None, "", "  ", "a", "a a a a a", "a a a a a a", "a b " * 4, "x " + "a b c\t" * 4 + "\n y", "é ü " * 5, "a b " * 6, "b a a a a a a b", "w\x1cw " * 7, "p q r " * 30000]
    docs = [*enumerate(texts), (3, "twice twice"), (None, "no id " * 6), (None, None)]
    df = spark.createDataFrame([(i, t, "n", [1], 2) for i, t in docs], "doc_id long, text string, runs string, steepest array<int>, n_words int").repartition(3)
    got = {}
    for r in periodic_runs(df).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, [tuple(x) for x in r.runs], r.steepest and tuple(r.steepest), r.collapsed))
    want = {}
    for i, t in docs:
        ws = [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]
        found = brute_runs(ws) if len(ws) < 1000 else [(0, 90000, 3)]
        gone = {k for s, m, q in found for k in range(s + q, s + m)}
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        want.setdefault(i, []).append((len(ws), found, best, " ".join(w for k, w in enumerate(ws) if k not in gone)))
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in want.items()}
    assert periodic_runs(df.limit(0)).count() == 0


def test_seeded_query_with_odd_rows(spark, tmp_path):
    docs = [(i, t) for i in range(60) for t in ["one two three four five six seven eight nine ten eleven twelve " * (i % 4)]] + [(100, None), (101, ""), (107, " \t "), (None, "a " * 9)]
    docs += [(i, f"{i} single") for i in range(200, 260)] + [(i, None) for i in range(260, 300)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = rows(op13_periodic_runs(spark, str(tmp_path)))
    want = [brute(i, t, i is not None) for i, t in docs]
    assert got == sorted(want, key=lambda r: [(x is None, x) for x in r])
    assert same(op13_periodic_runs(spark, str(tmp_path)), SQL, str(tmp_path)) == len(docs)
