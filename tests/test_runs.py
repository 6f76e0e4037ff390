"""Terms and their counts by bytes, against the column expression."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from pagemill.functions import runs
from pagemill.functions.text import tokenize
from pagemill.operators import index, postings

ODD = ["", None, "a", "ab", "a b", "The the THE cat-9 x7", "été Élan naïve", "Kelvin İstanbul 10K", "日本 ab1日本c2", "ab\ncd\tef\x00gh", "😀ok😀", "x" * 70, "they were 10,000.5 of us", " lead trail "]


def rows_of(spark, n=400):
    r = random.Random(11)
    return [(i if i % 50 else None, r.choice(["", " ", "-"]).join(t for t in r.choices(ODD, k=r.randint(1, 6)) if t) if i % 7 else r.choice(ODD)) for i in range(n)]


def test_counts_equal_the_tokens(spark, monkeypatch):
    """Texts are worked on in pieces of 64 bytes here, so they end anywhere."""
    docs = spark.createDataFrame(rows_of(spark), "doc_id long, text string").repartition(3)
    want = Counter()
    for r in docs.select("doc_id", tokenize(F.col("text")).alias("t")).collect():
        want.update((r.doc_id, t, n, len(r.t)) for t, n in Counter(r.t).items())
    for other in (tokenize, lambda c: tokenize(c)):
        for size in (64, 4 << 20):
            monkeypatch.setattr(runs, "BYTES", size)
            got = Counter((r.doc_id, r.term, r.tf, r.dl) for r in runs.term_counts(docs, tokenizer=other).collect())
            assert got == want and len(want) > 300


def test_blocks_hold_every_posting_once(spark, tmp_path, monkeypatch):
    """Ids that several rows share, null ones too, add up; hot terms are made in
    parts; what a task has is put into blocks a little at a time."""
    rows = [(d, t) for d, t in rows_of(spark, 900) if t]
    docs = spark.createDataFrame(rows + rows[:200], "doc_id long, text string").repartition(4)
    want = {(r.doc_id, r.term): (r.tf, r.dl) for r in index.build_terms(docs).postings.collect()}
    monkeypatch.setattr(postings, "AT_ONCE", 100)
    for hot in (10**6, 64):
        path = str(tmp_path / str(hot))
        postings.write(docs, path, hot=hot)
        ix = index.read_index(spark, path)
        got = ix.postings.collect()
        assert {(r.doc_id, r.term): (r.tf, r.dl) for r in got} == want and len(got) == len(want)
        for b in ix.blocks.withColumn("own", F.transform("rows", lambda r: postings.cell(postings.place(r["doc_id"]), F.col("bits")))).collect():
            best = [(x.tf, x.dl) for x in b.rows if not any((y.tf, -y.dl) != (x.tf, -x.dl) and y.tf >= x.tf and y.dl <= x.dl for y in b.rows)]
            assert set(b.own) == {b.cell} and b.n == len(b.rows) and b.tokens == sum(x.tf for x in b.rows)
            assert [(x.tf, x.dl) for x in b.frontier] == sorted(set(best), key=lambda x: -x[0])
        df = Counter(t for _, t in want)
        assert {r.term: r.df for r in ix.terms.collect()} == df


def test_a_row_a_term_is_shuffled(spark):
    """What the index build shuffles is a row a term of some texts, not a row a
    posting."""
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("alpha beta gamma").alias("text")).coalesce(1)
    rows = runs.packed_counts(docs, postings.place("doc_id"), {})
    assert rows.count() == 3 and rows.agg(F.sum(F.size("ids"))).first()[0] == 6000


def test_tokens_of_texts_are_packed(spark):
    """A token that many texts share is a row, not a row a text; ids may be null
    or shared, and every character is in a token."""
    docs = spark.createDataFrame(rows_of(spark), "doc_id long, text string").coalesce(1)
    got = runs.packed_tokens(docs, "doc_id", "text")
    want = Counter((i, t) for i, text in rows_of(spark) for t in set(re.findall(r"[A-Za-z0-9_]+|[^A-Za-z0-9_]", text or "")))
    assert Counter((i, r.token) for r in got.collect() for i in r.ids) == want
    assert got.count() == len({t for _, t in want})
