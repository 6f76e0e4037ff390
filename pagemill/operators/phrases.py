"""Where stated phrases occur in texts, for any number of either.

An index of the phrases has one key of each, the rarest among the phrases;
texts meet it by theirs, an equi-join, and what meets is verified on the whole
text. Tokens are runs of letters a-z, digits and _ and, for phrases without
one, single other characters. A phrase between word boundaries has for a key up
to three runs in succession, for those of frequent words would meet most texts
by one; a phrase anywhere has one token."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.runs import packed_tokens, packed_windows, widest_windows

_RUNS = "[A-Za-z0-9_]+"


def as_words(text: Column, phrase: Column) -> Column:
    """Whether phrase stands in text between word boundaries."""
    return F.regexp_like(text, F.concat(F.lit(r"\b\Q"), F.replace(phrase, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\b")))


def _runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_RUNS), 0)


def _sure(phrase: Column) -> Column:
    """Tokens that a text has as tokens of its own wherever the phrase occurs:
    the runs at the phrase's ends may go on in the text, so those inside alone.
    A phrase of no run has its characters."""
    inner = F.regexp_replace(phrase, f"^{_RUNS}|{_RUNS}$", "")
    single = F.regexp_extract_all(phrase, F.lit("[^A-Za-z0-9_]"), 0)
    return F.array_distinct(F.when(F.size(_runs(phrase)) > 0, _runs(inner)).otherwise(single))


def _longest(runs: Column) -> Column:
    return F.array_max(F.transform(runs, lambda r: F.struct(F.length(r).alias("n"), r.alias("r"))))["r"]


def _distinct(phrases: DataFrame, column: str) -> DataFrame:
    return phrases.select(F.col(column).alias("phrase")).where(F.length("phrase") > 0).distinct()


def window_index(phrases: DataFrame, column: str) -> DataFrame:
    """(key, phrase): every distinct phrase under the rarest of its widest
    windows among the phrases. A text has that window wherever the phrase stands
    between word boundaries, as its runs are whole there."""
    each = widest_windows(_distinct(phrases, column), "phrase")
    n = each.groupBy("key").agg(F.count("*").alias("_n"))
    return each.join(n, "key").groupBy("phrase").agg(F.min_by("key", F.struct("_n", "key")).alias("key")).select("key", "phrase")


def phrase_index(phrases: DataFrame, column: str) -> DataFrame:
    """(token, part, phrase): every distinct phrase under the rarest of its
    sure tokens among the phrases, the longest of several; one that has none
    by its longest run instead, as `part` of a token."""
    rows = _distinct(phrases, column)
    each = rows.select("phrase", F.explode(_sure(F.col("phrase"))).alias("token"))
    n = each.groupBy("token").agg(F.count("*").alias("_n"))
    sure = each.join(n, "token").groupBy("phrase").agg(F.min_by("token", F.struct("_n", -F.length("token"), "token")).alias("token"))
    part = F.when(F.col("token").isNull(), _longest(_runs(F.col("phrase"))))
    return rows.join(sure, "phrase", "left").select("token", part.alias("part"), "phrase")


def _grams(run: Column) -> Column:
    """The distinct substrings of one to three characters."""
    of = lambda n: F.transform(F.sequence(F.lit(1), F.length(run) - n + 1), lambda i: F.substring(run, i, F.lit(n)))
    none = F.expr("cast(array() as array<string>)")
    return F.array_distinct(F.flatten(F.array(*[F.when(F.length(run) >= n, of(n)).otherwise(none) for n in (1, 2, 3)])))


def occurrences(texts: DataFrame, id_col: str, text_col: str, phrases: DataFrame, column: str, whole: bool = True) -> DataFrame:
    """(id_col, *phrases) of the phrases that occur in each text, each pair
    once; with `whole` between word boundaries, else anywhere. Case counts.

    Texts are tokenised, a row a key of some texts, and read once more to
    verify. What stands inside longer words is found in the vocabulary first,
    by substrings of up to three characters, so no phrase has to meet every
    text. Empty and null phrases and texts meet nothing; a null id is an id
    like any other."""
    if whole:
        met = packed_windows(texts, id_col, text_col).join(window_index(phrases, column), "key").select(F.explode("ids").alias("_id"), "phrase")
    else:
        index = phrase_index(phrases, column)
        said = packed_tokens(texts, id_col, text_col)
        met = said.join(index.where("token is not null").select("token", "phrase"), "token").select(F.explode("ids").alias("_id"), "phrase")
        parts = index.where("token is null").withColumn("gram", F.left("part", F.lit(3)))
        words = said.select("token").distinct().withColumn("gram", F.explode(_grams(F.col("token"))))
        longer = words.join(parts.select("gram", "part", "phrase"), "gram").where(F.contains("token", "part")).select("token", "phrase")
        met = met.unionByName(said.join(longer, "token").select(F.explode("ids").alias("_id"), "phrase"))
    test = as_words if whole else F.contains
    rows = texts.select(F.col(id_col).alias("_own"), F.col(text_col).alias("_text"))
    found = met.distinct().join(rows, F.expr("_id <=> _own")).where(test(F.col("_text"), F.col("phrase"))).select("_id", F.col("phrase").alias("_p")).distinct()
    return found.join(phrases, F.col("_p") == F.col(column)).select(F.col("_id").alias(id_col), *[F.col(c) for c in phrases.columns])
