"""Phrases in texts against a loop over all pairs."""

import random
import re

import pytest

from pagemill.operators import agent
from pagemill.operators.phrases import occurrences


@pytest.mark.parametrize("whole", [True, False])
def test_occurrences_equal_a_loop(spark, whole):
    rng = random.Random(5)
    words = ["a", "ab", "abc", "bab", "b_a", "7", "x7", "été", "(", ").", "\\E", "ab-c", "", " ", "😀"]
    make = lambda n: rng.choice([" ", "", "-", "  "]).join(rng.choice(words) for _ in range(n))
    texts = [(i if i else None, make(rng.randint(0, 12))) for i in range(150)] + [(900, None), (900, "ab abc"), (901, "")]
    phrases = [(i, make(rng.randint(1, 4))) for i in range(120)] + [(500, None), (501, ""), (502, "ab"), (503, "ab"), (504, "("), (505, "bc")]
    t = spark.createDataFrame(texts, "id long, text string")
    p = spark.createDataFrame(phrases, "pid long, phrase string")
    got = sorted((str(r.id), r.pid) for r in occurrences(t, "id", "text", p, "phrase", whole).collect())

    def meets(text, phrase):
        if not whole:
            return phrase in text
        edge = lambda i: (i > 0 and is_word(text[i - 1])) != (i < len(text) and is_word(text[i]))
        is_word = lambda c: c == "_" or c.isalnum()
        return any(edge(m.start()) and edge(m.start() + len(phrase)) for m in re.finditer(f"(?={re.escape(phrase)})", text))

    want = sorted({(str(i), j) for i, text in texts for j, ph in phrases if text and ph and meets(text, ph)})
    assert got == want and len(want) > 200


def test_a_hundred_thousand_aliases_without_a_nested_loop(spark):
    names = spark.range(40000).selectExpr("concat('Plan', id, ' Cover', id % 7, ' Gold') as product")
    aliases = agent.product_aliases(names)
    assert aliases.count() >= 100000
    said = spark.range(200).selectExpr("id as query_id", "concat('Is plan', id * 3, ' cover', (id * 3) % 7, ' good, or PLAN', id, '?') as query")
    found = agent.match_products(said, aliases)
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {r.query_id: r.products for r in found.collect()}
    assert len(got) == 200 and all(p == sorted({f"Plan{n} Cover{n % 7} Gold" for n in (q, q * 3)}) for q, p in got.items())
    few = agent.match_products(said.limit(5), aliases.where("alias like 'plan1%'"), few=True)
    assert few.count() == agent.match_products(said.limit(5), aliases.where("alias like 'plan1%'")).count()


def test_phrases_of_frequent_words_meet_few_texts(spark):
    """Every text has every word of every phrase, but few phrases: texts that
    have one word of a phrase aren't rows each."""
    words = [f"w{i}" for i in range(60)]
    stated = [(f"{a} {b}",) for i, a in enumerate(words) for b in words[i + 1 :]] + [(" ".join(words[i : i + 5]),) for i in range(56)]
    said = [(i, " ".join(words[::-1]) + (f" w{i % 50} w{i % 50 + 1} w{i % 50 + 2}, w{i % 50 + 3} w{i % 50 + 4}" if i % 5 else "")) for i in range(500)]
    texts, phrases = spark.createDataFrame(said, "id long, text string"), spark.createDataFrame(stated, "phrase string")
    sc = spark.sparkContext
    sc.setJobGroup("frequent words", "")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for larger tables
    try:
        got = sorted((r.id, r.phrase) for r in occurrences(texts, "id", "text", phrases, "phrase").collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert got == sorted((i, p) for i, t in said for (p,) in stated if f" {p} " in f" {t} ".replace(",", " , ")) and len(got) == 1600
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = {k for j in sc.statusTracker().getJobIdsForGroup("frequent words") for k in sc.statusTracker().getJobInfo(j).stageIds}
    written = 0
    for k in stages:
        written += sc._jsc.sc().statusStore().lastStageAttempt(k).shuffleWriteRecords()
    assert 0 < written < 100_000
