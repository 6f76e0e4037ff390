"""Periodic runs of words: lags counted heavy and light, islands scanned only
where a lag has enough matches."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.resampling import crc_sql
from pagemill.llm.shelf import table

#: Characters of texts that a task gathers before it gives rows.
BLOCK = 4 << 20


#: What a call costs in steps of a loop over an array, about.
CALL = 4000


def frequent(often: np.ndarray, size: int) -> np.ndarray:
    """The most frequent words, as many as make the count of lags cheapest: a
    transform each costs size * log2(size) steps, the others' pairs half their
    counts squared, in as many rounds as the most frequent of them has."""
    by = np.argsort(-often, kind="stable")
    f = often[by].astype(np.float64)
    pairs = np.append(np.cumsum((f * f)[::-1])[::-1] / 2, 0)
    cost = np.arange(len(f) + 1) * (size * size.bit_length() + CALL) + np.append(f, 0) * CALL + 4 * pairs
    return by[: int(cost.argmin())]


def lag_counts(ids: np.ndarray, longest: int) -> np.ndarray:
    """matches[q], 0 < q <= longest: how many places i have the same word at i
    and i + q. Exact.

    Words that occur often count by autocorrelation (their transforms' powers
    add up, one inverse transform gives all lags; sums are whole numbers below
    2 ** 52, so rounding is exact), others by the differences of the places of
    each with those after it.
    """
    n = len(ids)
    often = np.bincount(ids)
    size = 1 << (n + longest - 1).bit_length()
    heavy = frequent(often, size)
    matches = np.zeros(longest + 1, np.int64)
    if len(heavy):
        power = np.zeros(size // 2 + 1)
        for w in heavy:
            f = np.fft.rfft(ids == w, size)
            power += f.real**2 + f.imag**2
        matches += np.rint(np.fft.irfft(power, size)[: longest + 1]).astype(np.int64)
    order = np.argsort(ids, kind="stable")
    rare = often > 1
    rare[heavy] = False
    light = order[rare[ids[order]]]
    word = ids[light]
    here = np.arange(len(light))
    k = 1
    while len(here := here[here + k < len(light)]):  # each place with the k-th after it, while that is the same word and near
        lag = light[here + k] - light[here]
        near = (word[here + k] == word[here]) & (lag <= longest)
        here = here[near]
        matches += np.bincount(lag[near], minlength=longest + 1)
        k += 1
    matches[0] = 0
    return matches


def runs(ids: np.ndarray, times: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal runs of at least `times` (2 or
    more) periods and `least` words, by start and period; period is a run's
    smallest.

    A run of period q has length - q matches of lag q, so only lags with that
    many are scanned, the least first. A run found of period p explains its
    matches of lags 2p, 3p and so on; another run of such a lag q shares none
    of them (q words of both would give that one the period p too), so what is
    left tells whether to scan q.
    """
    n = len(ids)
    longest = n // times
    if n < least or longest < 1:
        return []
    q = np.arange(longest + 1)
    need = np.maximum(least - q, (times - 1) * q)
    left = lag_counts(ids, longest)
    found: dict[tuple[int, int], int] = {}
    for p in np.flatnonzero(left[1:] >= need[1:]) + 1:
        if left[p] < need[p]:
            continue
        ends = np.concatenate([[-1], np.flatnonzero(ids[:-p] != ids[p:]), [n - p]])
        islands = np.flatnonzero(np.diff(ends) - 1 >= need[p])
        for start, stop in zip((ends[islands] + 1).tolist(), (ends[islands + 1] + p).tolist(), strict=True):
            if (start, stop) not in found:
                found[start, stop] = int(p)
                more = q[2 * p : stop - start : p]
                left[more] -= stop - start - more
    return sorted((start, stop - start, p) for (start, stop), p in found.items())


def collapsed(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run contains after its first
    period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, p in found:
        change[start + p] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def steepest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length / period, compared exactly; ties go to
    the smallest start, then period (the order of runs())."""
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


RUN = "struct<start: long, length: long, period: long>"


def periodic_runs(docs: DataFrame, times: int = 4, least: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, runs array<struct<start, length, period>>, steepest
    struct, collapsed string) of each row: its text's maximal periodic runs of
    words (see runs()), that of the greatest exponent (see steepest()), null
    without any, and the text's words without those that a run repeats, joined
    by one space. Words are parted by ASCII white space.

    Texts are independent, so nothing is shuffled. Memory grows with the
    longest single text: some 40 bytes a word beside its own. Null and empty
    texts have no words and no runs; null ids and repeated rows are kept; other
    columns are left out, whatever they are named; an empty table gives no row.
    """
    if times < 2:
        raise ValueError("a run is at least two periods long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        struct = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

        def structs(rows: list) -> pa.Array:
            cols = zip(*[r or (None,) * 3 for r in rows], strict=True) if rows else [[]] * 3
            return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], fields=list(struct), mask=pa.array([r is None for r in rows], pa.bool_()))

        for b in batches:
            out, size, at = [], 0, 0
            for i, t in enumerate(b.column(1)):
                raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                words = raw.split()
                number: dict[bytes, int] = {}
                ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
                found = runs(ids, times, least)
                if found:
                    words = [words[k] for k in np.flatnonzero(collapsed(len(ids), found)).tolist()]
                out.append((len(ids), found, steepest(found), b" ".join(words)))
                size += len(raw)
                if size > BLOCK or i + 1 == b.num_rows:
                    offsets = np.concatenate([[0], np.cumsum([len(r[1]) for r in out])])
                    every = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs(list(chain.from_iterable(r[1] for r in out))))
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).slice(at, len(out)), pa.array([r[0] for r in out], pa.int64()), every, structs([r[2] for r in out]), pa.array([r[3] for r in out], pa.binary()).cast(pa.string())],
                        names=["id", "n_words", "runs", "steepest", "collapsed"],
                    )
                    out, size, at = [], 0, i + 1

    got = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, n_words long, runs array<{RUN}>, steepest {RUN}, collapsed string")
    return got.select(F.col("id").alias(id_col), "n_words", "runs", "steepest", "collapsed")


def with_repeats(text: Column, doc_id: Column) -> Column:
    """text, or for a tenth of the ids (by CRC-32) its words up to a place and
    then over and over the words from there on: each word i >= a becomes word
    a + (i - a) % p. These are runs that the query is sure to meet."""
    h = F.crc32(doc_id.cast("string"))
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def repeated(ws: Column) -> Column:
        n, g = F.size(ws).cast("long"), F.floor(h / 10)
        a = F.try_mod(g, n)
        p = 1 + F.floor((n - a) / (3 + g % 8))
        parts = F.concat(F.slice(ws, 1, a.cast("int")), F.transform(F.sequence(F.lit(0).cast("long"), n - a - 1), lambda i: F.get(ws, (a + i % p).cast("int"))))
        return F.when(n > 0, F.array_join(parts, " ")).otherwise(text)

    # a list of one, so that the words are worked out once
    return F.when(h % 10 == 0, F.get(F.transform(F.array(words), repeated), 0)).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = periodic_runs(docs.select("doc_id", with_repeats(F.col("text"), F.col("doc_id")).alias("text")))
    line = lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n"))
    best = F.col("steepest")
    return got.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best.start.alias("start"),
        best.length.alias("length"),
        best.period.alias("period"),
        F.expr("1000 * steepest.length div steepest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


SQL = f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
h AS (SELECT *, len(ws) AS n, {crc_sql("doc_id::VARCHAR")} AS h FROM w),
a AS (SELECT *, h // 10 AS g, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
o AS (SELECT r, n, a, p, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM p),
t AS (SELECT o.r, o.i, o.n, coalesce(s.word, o.word) AS word FROM o LEFT JOIN o s ON s.r = o.r AND o.i >= o.a AND s.i = o.a + (o.i - o.a) % o.p),
m AS (SELECT x.r, x.i, y.i - x.i AS q FROM t x JOIN t y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
g AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM m),
u AS (SELECT r, q, min(i) AS s, count(*) + q AS len FROM g GROUP BY r, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
f AS (SELECT r, s, len, min(q) AS q FROM u GROUP BY r, s, len),
c AS (SELECT t.r, string_agg(word, ' ' ORDER BY i) AS kept FROM t WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.r = t.r AND t.i >= f.s + f.q AND t.i < f.s + f.len) GROUP BY t.r),
b AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM f GROUP BY r),
best AS (SELECT x.* FROM (SELECT f.*, row_number() OVER (PARTITION BY r ORDER BY len::DOUBLE / q DESC, s, q) AS k FROM f) x WHERE k = 1)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS "start", best.len::BIGINT AS length, best.q::BIGINT AS period, (1000 * best.len // best.q)::BIGINT AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM w LEFT JOIN b USING (r) LEFT JOIN best USING (r) LEFT JOIN c USING (r)
"""

QUERIES = {"op13_periodic_runs": op13_periodic_runs}
ORACLE = {"op13_periodic_runs": SQL}
