from math import log1p
from zlib import crc32

from pagemill.llm.toxicity import Lexicon, _sigmoid, features, fit, fold, hits, learn, op5_toxicity, score

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    rows = op5_toxicity(spark, SF).collect()
    assert len(rows) == len({r.doc_id for r in rows}) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    test = [(label[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in label]
    hit = sum(a and b for a, b in test)
    assert hit >= 0.75 * sum(a for a, _ in test)
    assert sum(b and not a for a, b in test) <= 0.03 * sum(not a for a, _ in test)


def test_folding_and_exceptions():
    lex = Lexicon({" moron ": 3.0, " idio": 2.0}, [" not moron "], (0.0, 1.0, 0.0))
    auto = lex.automaton()
    for t in ["You MORON!", "m0r0n", "mоrоn", "a mo​ron.", "ｍｏｒｏｎ"]:
        assert len(hits(fold(t), auto)) == 1, t
    assert not hits(fold("not moron, oxymoron, morons"), auto)
    assert len(hits(fold("Idiotic 1d10ts"), auto)) == 2
    assert features(fold("moron " + "x " * 99), auto)[1] > features(fold("moron"), auto)[1]


def test_learns_beginnings():
    texts = [f"some plain text number {i} with words" for i in range(60)] + [f"some plain vequ{chr(97 + i % 26)}{chr(97 + i % 7)} text" for i in range(60)]
    lex = learn(texts, [0] * 60 + [1] * 60)
    assert " vequ" in lex.weights and hits(fold("unseen vequzzz"), lex.automaton())


def test_odd_rows(spark):
    rows = [(1, None, 0.5), (2, "", 0.5), (None, "moron", 0.5), (3, "moron " * 50000, 0.5), (3, "moron", 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    lex = Lexicon({" moron ": 3.0}, [], (-1.0, 2.0, -0.1))
    got = sorted(((r.doc_id or 0, r.predicted) for r in score(df, lex).collect()))
    assert got == [(0, 1), (1, 0), (2, 0), (3, 1), (3, 1)]
    assert score(df, Lexicon()).where("score <> 0").count() == 0
    assert learn([], []).weights == {}
    assert score(df.limit(0), lex).count() == 0


def test_against_brute_force(spark):
    small = SF.replace("0.1", "0.01")
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{small}/labels.parquet").collect() if r.toxic in (0, 1)}
    train = sorted(i for i in label if i in docs and crc32(str(i).encode()) % 5)
    lex = learn([docs[i] for i in train], [label[i] for i in train])
    own = fit(spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet"))
    assert (own.weights, own.exceptions) == (lex.weights, lex.exceptions) and lex.weights
    assert max(abs(a - b) for a, b in zip(own.model, lex.model, strict=True)) < 1e-9
    for r in op5_toxicity(spark, small).collect():
        found = naive_hits(fold(docs[r.doc_id]), lex)
        assert r.n_hits == len(found)
        words = len(fold(docs[r.doc_id]).split())
        want = _sigmoid(lex.model[0] + lex.model[1] * log1p(sum(found.values()) / max(words, 1) ** 0.5))
        assert abs(r.score - want) < 1e-9


def naive_hits(folded, lex):
    """The heaviest term at each place, by looking each one up everywhere."""
    at = {}
    for term, w in lex.weights.items():
        i = folded.find(term)
        while i >= 0:
            if w > at.get(i, (0.0, 0))[0]:
                at[i] = (w, i + len(term))
            i = folded.find(term, i + 1)
    spared = []
    for p in lex.exceptions:
        i = folded.find(p)
        while i >= 0:
            spared.append((i, i + len(p)))
            i = folded.find(p, i + 1)
    return {i: w for i, (w, e) in at.items() if not any(a <= i and e <= b for a, b in spared)}


def test_rows_that_share_an_id_and_both_labels(spark):
    rows = [(i, f"plain words here number {i}") for i in range(40)] + [(100 + i, f"plain vequ{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]} words") for i in range(40)] + [(0, None), (None, "x"), (100, None)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, y int")
    labels = spark.createDataFrame([(i, int(i >= 100)) for i, _ in rows if i is not None] + [(100, 0), (None, 1)], "doc_id long, toxic int")
    a, b = fit(docs, labels), fit(docs.repartition(7), labels)
    assert a == b and " vequ" in a.weights
    assert fit(docs.limit(0), labels).weights == {}


def test_longer_texts_with_the_same_hits_score_less(spark):
    texts = [f"plain words {i} of a text" for i in range(60)] + [f"a vequ{chr(97 + i % 26)}{chr(97 + i % 7)} text" for i in range(60)]
    lex = learn(texts, [0] * 60 + [1] * 60)
    assert lex.model[1] > 0 and lex.model[2] == 0
    df = spark.createDataFrame([(n, "vequzz " + "word " * n) for n in (0, 3, 30, 300, 3000)], "doc_id long, text string")
    got = [r.score for r in score(df, lex).orderBy("doc_id").collect()]
    assert got == sorted(got, reverse=True) and len(set(got)) == len(got)
