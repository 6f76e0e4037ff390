import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np

from pagemill.llm.resampling import SLICE, SQL, features, op11_importance_resampling, resample
from tests.llm.sql import same

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def grams(text, longest=2):
    ws = WORDS.findall((text or "").translate(LOWER))
    return len(ws), [" ".join(ws[i : i + n]) for n in range(1, longest + 1) for i in range(len(ws) - n + 1)]


def brute(docs, target, least=20, percent=25):
    """(id, n_features, weight, score, rank) by plain counting."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s = Counter(bucket(f) for _, t in docs for f in grams(t)[1])
    t = Counter(bucket(f) for x in target for f in grams(x)[1])
    ss, tt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ss + 10000) / ((s[b] + 1) * (tt + 10000)))) for b in range(10000)]
    rows, can = [], []
    for i, text in docs:
        n, fs = grams(text)
        w = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if n >= least:
            can.append(rows[-1])
    can.sort(key=lambda r: (-r[3], (r[0] is not None, r[0]), r[1]))
    for k in range(percent * len(can) // 100):
        can[k][4] = k + 1
    return rows


def collected(df):
    return [[r.doc_id, r.n_features, r.weight, r.score, r["rank"]] for r in df.collect()]


def ordered(rows):
    return sorted(rows, key=lambda r: [(x is None, x) for x in r])


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert ordered(collected(op11_importance_resampling(spark, SF))) == ordered(brute(docs, target))


def test_sql(spark):
    assert same(op11_importance_resampling(spark, SF), SQL, SF) > 0


def test_odd_rows(spark):
    texts = [None, "", " ", "A", "a b", "\x00a\x7fB", "é ü Ü 日本 語", "x" * 200 + " y " + "Z" * 65 + " " + "q" * 64, "word " * 30, "word " * 30, "other words here " * 2000, "z" * (SLICE + 10) + " end", "1 2 3 " * 10]
    docs = [*enumerate(texts), (8, "word " * 30), (None, "word " * 25), (None, None)]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in docs], "doc_id long, text string, rank int, score int, n int")
    target = ["word other", None, "日本"]
    to = spark.createDataFrame([(x,) for x in target], "text string")
    assert ordered(collected(resample(df, to))) == ordered(brute(docs, target))
    assert ordered(collected(resample(df.repartition(7), to))) == ordered(brute(docs, target))
    assert ordered(collected(resample(df, to.limit(0)))) == ordered(brute(docs, []))
    assert resample(df.limit(0), to).count() == 0
    assert ordered(collected(resample(df, to, percent=100))) == ordered(brute(docs, target, percent=100))


def test_ties_go_to_the_smaller_id_and_many_scores_keep_their_order(spark):
    docs = [(i // 3, f"w{i % 3} " * 20) for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    to = spark.createDataFrame([("w1 w1",)], "text string")
    assert ordered(collected(resample(df, to, percent=60))) == ordered(brute(docs, ["w1 w1"], percent=60))


def test_longer_runs_of_words():
    texts = ["a bc def ghi", "", "one", "x y", "a b c d e"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    n_words, out = features(data, offsets, 2**32 - 1, 4)
    assert n_words.tolist() == [4, 0, 1, 2, 5]
    for n, (got, place) in enumerate(out, 1):
        for k, t in enumerate(texts):
            ws = t.split()
            want = [zlib.crc32(" ".join(ws[i : i + n]).encode()) % (2**32 - 1) for i in range(len(ws) - n + 1)]
            assert got[place[k] : place[k + 1]].tolist() == want
