import hashlib
import random
import re

import numpy as np

from pagemill.llm import suffix_dedup
from pagemill.llm.suffix_dedup import Family, anchors, merge_ranges, op3_suffix_dedup, segments, symbols, without_repeats

SF = "/root/testdata/sf0.001"


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for (doc, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((doc, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def brute_shared(rows, words):
    """Words of each row that a run of `words` words covers which another row has."""
    texts = [[w.lower() for w in re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode())] for _, t in rows]
    held = {}
    for n, t in enumerate(texts):
        for i in range(len(t) - words + 1):
            held.setdefault(hash(tuple(t[i : i + words])), set()).add(n)
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - words + 1):
            if len(held[hash(tuple(t[i : i + words]))]) > 1:
                gone[i : i + words] = b"\1" * words
        out.append(sum(gone))
    return [(doc, n) for (doc, _), n in zip(rows, out, strict=True)]


def whole(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=str)


def shared(df):
    return sorted(((r.doc_id, r.n_shared_words) for r in df.collect()), key=str)


def brute_hashed(rows, length):
    """brute() by hashes of windows, for tables of some megabytes."""
    texts = [(t or "").encode() for _, t in rows]
    n = [max(0, len(t) - length + 1) for t in texts]
    h = np.fromiter((hash(t[i : i + length]) for t, k in zip(texts, n, strict=True) for i in range(k)), np.int64, sum(n))
    _, at, c = np.unique(h, return_inverse=True, return_counts=True)
    twice, out, p = c[at] > 1, [], 0
    for (doc, _), t, k in zip(rows, texts, n, strict=True):
        ends = np.zeros(len(t) + 1, np.int64)
        w = np.flatnonzero(twice[p : p + k])
        np.add.at(ends, w, 1)
        np.add.at(ends, w + length, -1)
        gone = np.cumsum(ends)[: len(t)] > 0
        p += k
        spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
        out.append((doc, len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def test_whole_table_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = op3_suffix_dedup(spark, SF).cache()
    assert whole(got) == brute(rows, 400) == brute_hashed(rows, 400)
    assert shared(got) == sorted(brute_shared(rows, 50), key=str)


def test_larger_table_against_brute_force(spark):
    larger = SF.replace("0.001", "0.01")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{larger}/documents.parquet").collect()]
    got = op3_suffix_dedup(spark, larger).cache()
    assert whole(got) == brute_hashed(rows, 400)
    assert shared(got) == sorted(brute_shared(rows, 50), key=str)


def fixture():
    r = random.Random(9)
    passage = "".join(r.choice("abcd é") for _ in range(330))
    rows = []
    for i in range(160):
        t = "".join(r.choice("abcdefgh\nü") for _ in range(r.randrange(0, 900)))
        k = r.randrange(0, len(t) + 1)
        rows.append((i, t[:k] + passage[: r.randrange(331)] * (i % 3) + t[k:]))
    rows += [(200, "xy" * 700), (201, "a" * 900), (202, None), (203, ""), (None, rows[5][1]), (204, rows[7][1] + rows[8][1]), (204, "short"), (205, "short")]
    return rows


def test_shared_passages_and_odd_rows(spark, monkeypatch):
    rows = fixture()
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id long, text string, n_spans int, key string, kind string")
    want, words = brute(rows, 150), sorted(brute_shared(rows, 4), key=str)
    got = without_repeats(df, 150, 4).cache()
    assert whole(got) == want and shared(got) == words
    monkeypatch.setattr(suffix_dedup, "CHUNK", 300)
    monkeypatch.setattr(suffix_dedup, "BATCHES", 7)
    monkeypatch.setattr(suffix_dedup, "STEPS", (3, 1))
    got = without_repeats(df, 150, 4).cache()
    assert whole(got) == want and shared(got) == words
    assert without_repeats(df.limit(0)).count() == 0


def test_one_passage_in_very_many_texts(spark):
    r = random.Random(4)
    passage = "".join(r.choice("abcdefg ") for _ in range(700))
    rows = [(i, "".join(r.choice("hijkl \n") for _ in range(40)) + passage[i % 3 :] + f" {i * 7919}") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = without_repeats(df, 400, 20).cache()
    assert whole(got) == brute_hashed(rows, 400) and shared(got) == sorted(brute_shared(rows, 20), key=str)


def test_small_batches(spark):
    rows = fixture()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert whole(without_repeats(df, 150)) == brute(rows, 150)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_family_finds_heads_at_two_places(spark):
    r = np.random.default_rng(0)
    f, keys = Family(), []
    for b in range(5):
        k = r.integers(0, 300, 50)
        f.add(spark.createDataFrame([(int(x), 0, 100 * b + i // 2) for i, x in enumerate(k)], "core long, more long, who long"))
        keys += [(int(x), 100 * b + i // 2) for i, x in enumerate(k)]
    places = {}
    for x, who in keys:
        places.setdefault(x, set()).add(who)
    assert sorted(m.core for m in f.matches().collect()) == sorted(x for x, p in places.items() if len(p) > 1)
    assert [n for n, _ in f.levels] == [4, 1]
    level = [x.core for x in f.levels[0][1].coalesce(1).collect()]
    assert len(level) == len(set(level))
    f.close()


def test_equal_windows_have_equal_anchors():
    r = random.Random(2)
    common = bytes(r.randrange(256) for _ in range(260))
    a, b = bytes(r.randrange(256) for _ in range(777)) + common + b"z" * 300, common + bytes(500)
    whos, at, lo, hi, h = anchors([symbols(t, 0) for t in (a, b, b"tiny")], 200, 50)
    cover = {(w, i): (int(x), p - i) for w, p, l, u, x in zip(whos, at, lo, hi, h, strict=True) for i in range(l, u + 1)}
    assert len(cover) == len(a) + len(b) - 398
    for i in range(61):
        assert cover[0, 777 + i] == cover[1, i]
    got = [(i, off, len(p)) for g in segments([symbols(t, 0) for t in (b"q" * 2500, b"", b"x" * 100)], 200, 1000) for i, off, p in g]
    assert got == [(0, 0, 1199), (0, 1000, 1199), (0, 2000, 500), (1, 0, 0), (2, 0, 100)]
    assert (symbols(b"One  two\tthree", 1) == symbols(b"one two three", 1)).all() and len(symbols(b" \n", 1)) == 0
    assert merge_ranges([(5, 9), (0, 5), (20, 22)]) == [(0, 9), (20, 22)]
