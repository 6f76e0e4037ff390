"""Language identification: words first, then ever shorter character n-grams."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.llm.shelf import drop, put, table

LONGEST = 5
#: n-grams of a word that are summed at once.
PIECE = 1000
GAPS = {i: " " for i in range(128) if not chr(i).isalpha()} | {ord(c): " " for c in " «»“”„‘’¿¡…–—"}


def words(text: str) -> list[str]:
    return text.lower().translate(GAPS).split()


def grams(word: str, n: int) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + n] for i in range(len(w) - n + 1)] or [w]


@dataclass
class Model:
    """Per language natural logs of relative frequencies, add-half smoothed."""

    langs: list[str]
    word: dict[str, list[float]]
    gram: list[dict[str, list[float]]]


#: Times that a word (0) or n-gram (1 to LONGEST) must occur to be known.
LEAST = [3] + [2] * LONGEST


def count(texts: list[str], langs: list[str]) -> Counter:
    """Counts of (language, 0, word) and (language, n, n-gram)."""
    word: Counter = Counter()
    for t, v in zip(texts, langs, strict=True):
        for w in words(t):
            word[v, 0, w] += 1
    out = Counter(word)
    for (v, _, w), k in word.items():
        for n in range(1, LONGEST + 1):
            for g in grams(w, n):
                out[v, n, g] += k
    return out


def model_of(names: list[str], totals: dict[tuple[str, int], int], kept: list[dict[str, dict[str, int]]]) -> Model:
    """totals: counts by (language, n), of rare ones too; kept: by n, those of
    the words or n-grams that are known, by language."""
    tables = []
    for n, table in enumerate(kept):
        sums = [totals.get((v, n), 0) + 0.5 * len(table) + 1 for v in names]
        tables.append({k: [math.log((c.get(v, 0) + 0.5) / s) for v, s in zip(names, sums, strict=True)] for k, c in table.items()})
    return Model(names, tables[0], tables[1:])


def learn(texts: list[str], langs: list[str]) -> Model:
    """The model of texts held in memory; fit() counts in Spark."""
    totals: Counter = Counter()
    by: list[dict[str, dict[str, int]]] = [{} for _ in LEAST]
    for (v, n, g), k in count(texts, langs).items():
        totals[v, n] += k
        by[n].setdefault(g, {})[v] = k
    kept = [{g: c for g, c in t.items() if sum(c.values()) >= least} for t, least in zip(by, LEAST, strict=True)]
    return model_of(sorted(set(langs)), totals, kept)


class Scorer:
    """Sums each word's logs; those of words met are kept, up to `most`."""

    def __init__(self, model: Model, most: int = 300_000):
        self.model, self.most = model, most
        self.unknown = [0.0] * len(model.langs)
        self.row: dict[str, int] = {}
        self.logs = np.zeros((0, len(model.langs)))

    def _logs(self, w: str) -> list[float]:
        """A known word's own logs, else the mean over its known grams of the
        greatest length that has any."""
        got = self.model.word.get(w)
        for n in range(LONGEST, 0, -1):
            if got is not None:
                return got
            got = self._mean(w, n)
        return got or self.unknown

    def _mean(self, w: str, n: int) -> list[float] | None:
        """The mean over w's known n-grams, if any, PIECE of them at a time."""
        whole, known, total, count = f"^{w}$", self.model.gram[n - 1], 0.0, 0
        for at in range(0, max(len(whole) - n + 1, 1), PIECE):
            piece = [x for g in range(at, min(at + PIECE, max(len(whole) - n + 1, 1))) if (x := known.get(whole[g : g + n])) is not None]
            if piece:
                total, count = total + np.sum(piece, axis=0), count + len(piece)
        return (total / count).tolist() if count else None

    def __call__(self, text: str | None) -> tuple[str, float]:
        m = self.model
        if not text or not m.langs or not any(map(str.isalpha, text)):
            return "und", 0.0
        ws = words(text)
        if len(self.row) > self.most:
            self.row, self.logs = {}, np.zeros((0, len(m.langs)))
        new = [w for w in dict.fromkeys(ws) if w not in self.row]
        if new:
            used = len(self.row)
            if used + len(new) > len(self.logs):
                self.logs = np.concatenate([self.logs, np.zeros((max(len(new), len(self.logs), 1000), len(m.langs)))])
            self.logs[used : used + len(new)] = [self._logs(w) for w in new]
            self.row.update(zip(new, range(used, used + len(new)), strict=True))
        total = self.logs[list(map(self.row.__getitem__, ws))].sum(axis=0)
        best = int(total.argmax())
        return m.langs[best], float(1 / np.exp(np.clip(total - total[best], -700, 0)).sum())


def held_out(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int) -> DataFrame:
    """(id, text, v) of at most per_lang documents of each language, those of
    least id hash outside the held-out quarter. Rows that share id and language
    are one document, that of least text, however often they are repeated. Of a
    large language a share of the ids that should hold them several times over
    is ranked, so no task sorts it whole; where a share does not, all are."""
    train = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("v")).where("id is not null and text is not null and v is not null").where(~held_out("id"))
    named = put(train.select("id", "v").distinct(), "ids")
    share = F.xxhash64("id") / 2.0**64 + 0.5 < 4.0 * per_lang / F.col("size")
    sizes = named.groupBy("v").agg(F.count("*").alias("size"))
    sizes = named.join(F.broadcast(sizes), "v").groupBy("v", "size").agg(F.count_if(share).alias("within"))  # a row a language, as the model has
    low = named.join(F.broadcast(sizes), "v").where(share | (F.col("within") < F.least(F.lit(per_lang), F.col("size")))).select("id", "v")
    ranked = low.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy(F.xxhash64("id"), "id")))
    ids = ranked.where(F.col("n") <= per_lang).select("id", "v")
    return train.join(F.broadcast(ids), ["id", "v"], "left_semi").groupBy("id", "v").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 1500) -> Model:
    """A model of sample(). Its texts are counted in Spark; the driver reads
    the counts of what is known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, langs, size = [], [], 0
            for i, v in enumerate(b.column(1).to_pylist()):
                texts.append(b.column(0)[i].as_py())
                langs.append(v)
                size += len(texts[-1])
                if size > 100_000 or i + 1 == b.num_rows:  # a worker keeps what it once took
                    rows = list(count(texts, langs).items())
                    yield pa.RecordBatch.from_arrays([pa.array([k[j] for k, _ in rows], t) for j, t in ((0, pa.string()), (1, pa.int32()), (2, pa.string()))] + [pa.array([c for _, c in rows], pa.int64())], names=["v", "n", "g", "c"])
                    texts, langs, size = [], [], 0

    picked = put(sample(docs, id_col, text_col, lang_col, per_lang), "sample")
    counts = put(picked.select("text", "v").mapInArrow(run, "v string, n int, g string, c long").groupBy("v", "n", "g").agg(F.sum("c").alias("c")), "counts")
    names = sorted(r.v for r in picked.select("v").distinct().collect())
    totals = {(r.v, r.n): r.c for r in counts.groupBy("v", "n").agg(F.sum("c").alias("c")).collect()}
    known = counts.groupBy("n", "g").agg(F.sum("c").alias("t"), F.map_from_entries(F.collect_list(F.struct("v", "c"))).alias("by")).where(F.col("t") >= F.array(*[F.lit(x) for x in LEAST])[F.col("n")])
    kept: list[dict[str, dict[str, int]]] = [{} for _ in LEAST]
    for r in known.select("n", "g", "by").collect():
        kept[r.n][r.g] = r.by
    drop(picked)
    drop(counts)
    return model_of(names, totals, kept)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred, score per row: the language of greatest likelihood
    and its share of the likelihoods (0 to 1), of equal ones the first by name.
    Null texts and those without a
    letter are `und` at score 0, as all are when nothing was learned. Null ids,
    repeated rows and extra columns do no harm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            out = [scorer(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in out], pa.string()), pa.array([y for _, y in out], pa.float64())], names=["id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, lang_pred string, score double").select(F.col("id").alias(id_col), "lang_pred", "score")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs)).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


QUERIES = {"op9_language_id": op9_language_id}
ORACLE: dict[str, str] = {}
