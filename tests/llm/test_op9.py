from math import exp, log
from zlib import crc32

from pagemill.llm.language_id import LEAST, Scorer, fit, grams, identify, learn, op9_language_id, words

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = op9_language_id(spark, SF).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(lang)
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    test = [lang[r.doc_id] == r.lang_pred for r in rows if r.held_out]
    assert sum(test) >= 0.97 * len(test)


def test_backs_off_to_shorter_grams():
    s = Scorer(learn(["the thing that"] * 5 + ["der die das"] * 5, ["en"] * 5 + ["de"] * 5), most=3)
    assert s("the")[0] == "en" and s("thinker")[0] == "en" and s("dieser")[0] == "de"
    assert s("12 34") == ("und", 0.0) and s(None) == ("und", 0.0) and s("")[0] == "und"
    assert 0 < s("zzz")[1] <= 1 and s("日本")[0] in ("de", "en")


def test_odd_rows(spark):
    rows = [(1, None, "en", "x"), (2, "", None, "x"), (None, "the", "en", "x"), (4, "the " * 60000, "en", "x"), (4, "the", None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    model = learn(["the thing"] * 5 + ["der die"] * 5, ["en"] * 5 + ["de"] * 5)
    assert sorted((r.doc_id or 0, r.lang_pred) for r in identify(df, model).collect()) == [(0, "en"), (1, "und"), (2, "und"), (4, "en"), (4, "en")]
    empty = df.limit(0)
    assert identify(empty, fit(empty)).count() == 0


def test_a_word_counts_to_its_end():
    s = Scorer(learn(["abcabcabc xyz"] * 5 + ["uvwuvwuvw xyz"] * 5, ["a"] * 5 + ["u"] * 5))
    assert s("xyz" * 100 + "abc" * 3000)[0] == "a" and s("xyz" * 100 + "uvw" * 3000)[0] == "u"
    long = s("uvw" * 100 + "abc" * 3000)
    assert long[0] == "a" and long[1] > 0.5


def test_every_language_is_learned(spark):
    rows = [(i, f"w{'abcdefghij'[v // 100]}{'klmnopqrst'[v // 10 % 10]}{'uvwxyzabcd'[v % 10]} " * 5, f"l{v:03}") for i, v in enumerate(v for v in range(405) for _ in range(6))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit(df)
    assert len(model.langs) == 405
    lang = {i: v for i, _, v in rows}
    got = identify(df, model).collect()
    assert all(r.lang_pred == lang[r.doc_id] for r in got)


def test_against_brute_force(spark):
    """The fitted model and every prediction, by plain counting."""
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    train = [(t, v) for i, t, v in docs if t is not None and v is not None and crc32(str(i).encode()) % 4 != 2]
    langs = sorted({v for _, v in train})
    seen = [{} for _ in LEAST]
    for t, v in train:
        for w in words(t):
            for n in range(len(LEAST)):
                for g in [w] if n == 0 else grams(w, n):
                    c = seen[n].setdefault(g, dict.fromkeys(langs, 0))
                    c[v] += 1
    sums = [{v: sum(c[v] for c in table.values()) for v in langs} for table in seen]
    known = [{g: c for g, c in table.items() if sum(c.values()) >= least} for table, least in zip(seen, LEAST, strict=True)]
    model = fit(spark.read.parquet(f"{SF}/documents.parquet"))
    assert model.langs == langs and [len(t) for t in (model.word, *model.gram)] == [len(t) for t in known]

    def logs(n, g):
        return [log((known[n][g][v] + 0.5) / (sums[n][v] + 0.5 * len(known[n]) + 1)) for v in langs]

    def of_word(w):
        if w in known[0]:
            return logs(0, w)
        for n in range(len(LEAST) - 1, 0, -1):
            some = [logs(n, g) for g in grams(w, n) if g in known[n]]
            if some:
                return [sum(x) / len(some) for x in zip(*some, strict=True)]
        return [0.0] * len(langs)

    cache = {}
    text = {i: t for i, t, _ in docs}
    for r in op9_language_id(spark, SF).collect():
        if not any(map(str.isalpha, text[r.doc_id] or "")):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        total = [0.0] * len(langs)
        for w in words(text[r.doc_id]):
            if w not in cache:
                cache[w] = of_word(w)
            total = [a + b for a, b in zip(total, cache[w], strict=True)]
        best = max(total)
        share = 1 / sum(exp(max(t - best, -700)) for t in total)
        assert abs(r.score - share) < 1e-6
        assert r.lang_pred == langs[total.index(best)] or share < 0.5 + 1e-6


def test_sample_of_a_large_language(spark):
    rows = [(i, f"alpha beta w{i}", "en") for i in range(3000)] + [(5000 + i, "gamma", "de") for i in range(3)] + [(1, "zz", "en"), (None, "x", "en"), (9000, "x", None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, size int")
    a, b = fit(docs, per_lang=50), fit(docs.repartition(5), per_lang=50)
    assert a == b and a.langs == ["de", "en"]


def test_repeated_rows_leave_every_language_its_documents(spark):
    rows = [(i % 3, "der die das", "de") for i in range(4000)] + [(1000 + i, f"the thing w{i}", "en") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert fit(docs, per_lang=50).langs == ["de", "en"]
    # of a share that holds too few, all count
    few = [(i, f"w{i} v", "xx") for i in range(400)]
    model = fit(spark.createDataFrame(few, "doc_id long, text string, lang string"), per_lang=299)
    assert model.langs == ["xx"]
