"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text."""

from __future__ import annotations

import ast
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from pagemill.llm.shelf import drop, put, table

# Letters that look like Latin ones, and digits or signs that
# stand for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o",
    "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "ԁ": "d", "ɡ": "g", "ո": "n", "ѵ": "v", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ϲ": "c",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
#: Joiners and other signs that don't part a word.
UNSEEN = "­​‌‍⁠﻿"


def _folding() -> dict[int, str | None]:
    out: dict[int, str | None] = {i: " " for i in range(128) if not chr(i).isalpha()}
    out |= {ord(a): b for a, b in (HOMOGLYPHS | SUBSTITUTES).items()}
    out |= {0xFF21 + i: chr(97 + i) for i in range(26)} | {0xFF41 + i: chr(97 + i) for i in range(26)}  # full-width letters
    out |= {ord(c): None for c in UNSEEN} | {ord(c): " " for c in " «»“”„‘’¿¡…–—"}
    return out


FOLDING = _folding()


def fold(text: str) -> str:
    """Words in lower case between single-character gaps, look-alikes and
    digit substitutions undone, a gap at either end."""
    return f" {text.lower().translate(FOLDING)} "


@dataclass
class Lexicon:
    """weights: by term (a gap, then a word's beginning or a whole word and a
    gap); exceptions: phrases inside which terms don't count; model: bias,
    slope of the normalised hits and of the length (0 unless given)."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    model: tuple[float, float, float] = (-9.0, 0.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton | None:
        if not self.weights:
            return None
        a = ahocorasick.Automaton()
        for t, w in self.weights.items():
            a.add_word(t, (len(t), w))
        for p in self.exceptions:
            a.add_word(p, (len(p), -1.0))
        a.make_automaton()
        return a


def hits(folded: str, automaton: ahocorasick.Automaton | None) -> list[tuple[int, int, float]]:
    """(start, end, weight) of the terms found; the heaviest where terms begin
    together, none inside an exception."""
    if automaton is None:
        return []
    best: dict[int, tuple[int, float]] = {}
    spared = []
    for end, (n, w) in automaton.iter(folded):
        start = end - n + 1
        if w < 0:
            spared.append((start, end + 1))
        elif start not in best or w > best[start][1]:
            best[start] = (end + 1, w)
    return [(s, e, w) for s, (e, w) in best.items() if not any(a <= s and e <= b for a, b in spared)]


def features(folded: str, automaton: ahocorasick.Automaton | None) -> tuple[float, float]:
    """log1p of the weight found over the square root of the words, log1p of
    the words."""
    return _features(sum(w for _, _, w in hits(folded, automaton)), folded)


def _features(found: float, folded: str) -> tuple[float, float]:
    n = len(folded.split())
    return math.log1p(found / math.sqrt(max(n, 1))), math.log1p(n)


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def terms_of(folded: str) -> set[str]:
    """Words, and word beginnings of 4 to 8 letters."""
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in range(4, min(8, len(w)) + 1))
    return out


def contexts_of(folded: str, auto: ahocorasick.Automaton | None) -> set[tuple[str, str]]:
    """Each term found, with the words before and after it."""
    return {(folded[s:e], " ".join((folded[max(0, s - 60) : s].rpartition(" ")[2], folded[s + 1 : s + 60].partition(" ")[0]))) for s, e, _ in hits(folded, auto)}


def phrases_of(folded: str, auto: ahocorasick.Automaton | None) -> set[str]:
    """Phrases of two words that begin or end with a term's word."""
    out = set()
    for s, _, _ in hits(folded, auto):
        rest, before = folded[s : s + 200].split(), folded[max(0, s - 100) : s].split()
        if len(rest) > 1:
            out.add(f" {rest[0]} {rest[1]} ")
        if before and rest:
            out.add(f" {before[-1]} {rest[0]} ")
    return out


def weigh(df: dict[str, tuple[int, int]], n: tuple[int, int], min_docs: int = 4, min_gain: float = 25.0) -> dict[str, float]:
    """Weights of terms, given their document frequencies (clean, toxic) and
    the numbers of documents: those that differ by a G statistic of at least
    min_gain in favour of toxic ones; a longer term that says no more than its
    beginning goes."""
    weights: dict[str, float] = {}
    for term in sorted((t for t, c in df.items() if c[1] >= min_docs), key=lambda t: (len(t.strip()), len(t), t)):
        c, t = df[term]
        if t * n[0] < 8 * c * n[1]:
            continue
        gain = 0.0
        for seen, of in ((t, n[1]), (c, n[0])):
            for k, total in ((seen, t + c), (of - seen, n[0] + n[1] - t - c)):
                if k:
                    gain += 2 * k * math.log(k * (n[0] + n[1]) / (of * total))
        if gain < min_gain:
            continue
        w = math.log((t + 0.5) / (n[1] + 1)) - math.log((c + 0.5) / (n[0] + 1))
        if any(weights.get(term[: k + 1], 0) >= w - 0.7 for k in range(4, len(term.strip()) + 1)):
            continue
        weights[term] = w
    return weights


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Bias and slopes of a ridge fit by Newton's steps."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(b)), x.T @ (y - p) - 0.5 * b)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(b.tolist())


def learn_counts(n: tuple[int, int], count, min_docs: int = 4) -> Lexicon:
    """A lexicon from n (clean, toxic) labelled texts. count(of, least, clean)
    gives {item: (clean, toxic) texts} of the items that `of` finds in folded
    texts, `least` toxic ones at least, clean texts left out if not asked. A term goes that few different pairs
    of neighbours show for its frequency (copies of a text repeat it, not its
    use). Phrases of two words around a term that occur in clean texts alone
    become exceptions. A logistic fit scales the hits, normalised by length."""
    if not all(n):
        return Lexicon()
    df = count(terms_of, least=min_docs)
    weights = weigh(df, n, min_docs)
    auto = Lexicon(weights).automaton()
    seen = Counter(term for term, _ in count(lambda t: contexts_of(t, auto), clean=False))
    out = Lexicon({t: w for t, w in sorted(weights.items(), key=lambda x: (-x[1], x[0])) if seen[t] >= max(min_docs, min(30, df[t][1] / 4))})
    auto = out.automaton()
    out.exceptions = sorted(p for p, (c, t) in count(lambda t: phrases_of(t, auto)).items() if c >= 3 and not t)
    auto = out.automaton()
    points = count(lambda t: [features(t, auto)[0]])
    rows = sorted((f, y, k) for f, by in points.items() for y, k in enumerate(by) if k)
    x = np.array([f for f, _, k in rows for _ in range(k)])
    out.model = (*logistic(x, np.array([y for _, y, k in rows for _ in range(k)], float)), 0.0)
    return out


def learn(texts: list[str], toxic: list[int]) -> Lexicon:
    """The lexicon of texts held in memory; fit() counts in Spark."""
    folded = [fold(t) for t in texts]

    def count(of, least: int = 0, clean: bool = True) -> dict:
        out: dict = {}
        for t, y in zip(folded, toxic, strict=True):
            if y or clean:
                for item in of(t):
                    c = out.get(item, (0, 0))
                    out[item] = (c[0] + (not y), c[1] + bool(y))
        return {k: c for k, c in out.items() if c[1] >= least}

    return learn_counts((sum(not y for y in toxic), sum(map(bool, toxic))), count)


def held_out(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = 4000) -> Lexicon:
    """The lexicon of at most per_class labelled documents of each class, those
    of least id hash, outside the held-out fifth. Rows that share an id are one
    document, that of least text; an id labelled both ways is toxic. The
    sample's size is bounded, so its ids are broadcast; its texts are counted
    in Spark and the driver reads counts."""
    known = labels.where("toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").alias("y")).where(~held_out("id"))
    picked = None
    for v in (0, 1):
        part = known.where(F.col("y") == v).orderBy(F.xxhash64("id"), "id").limit(per_class)
        picked = part if picked is None else picked.unionAll(part)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(picked), "id")
    rows = put(texts.groupBy("id").agg(F.min("text").alias("text"), F.max("y").cast("int").alias("y")).select("text", "y"), "labelled")

    def count(of, least: int = 0, clean: bool = True) -> dict:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = (Counter(), Counter())
            for b in batches:
                for t, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                    seen[y].update(map(repr, of(fold(t.as_py()))))
                    if len(seen[0]) + len(seen[1]) > 50_000:  # a worker keeps what it once took
                        yield told(seen)
                        seen = (Counter(), Counter())
            yield told(seen)

        def told(seen: tuple[Counter, Counter]) -> pa.RecordBatch:
            items = sorted(seen[0].keys() | seen[1].keys())
            return pa.RecordBatch.from_arrays([pa.array(items, pa.string()), *[pa.array([seen[y][i] for i in items], pa.int64()) for y in (0, 1)]], names=["item", "clean", "toxic"])

        asked = rows if clean else rows.where("y = 1")
        found = asked.mapInArrow(run, "item string, clean long, toxic long").groupBy("item").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        found = found.where(F.col("toxic") >= least)
        return {ast.literal_eval(r.item): (r.clean, r.toxic) for r in found.collect()}

    n = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    out = learn_counts((n.get(0, 0), n.get(1, 0)), count)
    drop(rows)
    return out


def _scored(docs: DataFrame, lexicon: Lexicon, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """id, score, predicted, n_hits, and the columns of keep as k0, k1, ..."""
    bias, slope, length = lexicon.model
    # the text goes to Python once, also where it is kept
    others = [i for i, c in enumerate(keep) if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = lexicon.automaton()
        for b in batches:
            scores, found = [], []
            for t in b.column(1):
                folded = fold(t.as_py() or "")
                h = hits(folded, auto)
                found.append(len(h))
                hit, size = _features(sum(w for _, _, w in h), folded)
                scores.append(_sigmoid(bias + slope * hit + length * size) if auto else 0.0)
            columns = [b.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(found, pa.int64())]
            kept = [b.column(2 + others.index(i)) if i in others else b.column(1) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays(columns + kept, names=["id", "score", "predicted", "n_hits", *[f"k{i}" for i in range(len(keep))]])

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *[F.col(f"`{keep[i]}`").alias(f"k{i}") for i in others])
    kinds = [StructField(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(keep)]
    schema = StructType([StructField("id", LongType()), StructField("score", DoubleType()), StructField("predicted", IntegerType()), StructField("n_hits", LongType()), *kinds])
    return picked.mapInArrow(run, schema)


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, score (0 to 1), predicted (1 if score >= 0.5) and n_hits, one
    row per row of docs.

    score is the logistic of the log of the found weight over the square root
    of the words: the same hits count less in a longer text. Null texts count as empty; null
    ids and repeated rows pass; extra columns are left out.
    """
    return _scored(docs, lexicon, id_col, text_col, []).withColumnRenamed("id", id_col)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, lexicon).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", "n_hits")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the lexicon doesn't reject, their columns as given,
    whatever they are named. Null and empty texts stay; rows of null id, and
    rows that share an id or all else, are each judged by their own text; an
    empty table stays empty."""
    lexicon = fit(docs, table(spark, sf_dir, "labels"))
    kept = _scored(docs, lexicon, "doc_id", "text", docs.columns).where("predicted = 0")
    return kept.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)])


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLE: dict[str, str] = {}
