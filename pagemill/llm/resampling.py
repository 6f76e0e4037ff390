"""Importance resampling towards a target distribution, over hashed n-grams
that a byte automaton finds in Arrow buffers."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.llm.shelf import put, table

#: What the automaton knows of a byte: what it becomes (A-Z are lower-cased)
#: and whether it is part of a word (digits, letters, all beyond ASCII).
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
WORD = np.array([b > 127 or chr(b).isalnum() for b in range(256)])
#: Bytes of text that are taken at once (a longer text alone).
SLICE = 4 << 20
#: Bytes of a word that all words take together; a longer one's rest is taken
#: on its own.
TOGETHER = 64
INIT = np.uint32(0xFFFFFFFF)


def crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ np.uint32(0xEDB88320), t >> 1)
    return t


STEP = crc_table()


def step(state: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return STEP[(state ^ byte) & np.uint32(255)] ^ state >> np.uint32(8)


def advance(state: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
    """Takes state[i] over the lengths[i] bytes of data from starts[i], all i
    simultaneously. lengths fall, so those still under way are a prefix."""
    longest = int(lengths[0]) if len(lengths) else 0
    left = len(lengths) - np.searchsorted(lengths[::-1], np.arange(min(longest, TOGETHER)), side="right")
    for j, n in enumerate(left.tolist()):
        state[:n] = step(state[:n], data[starts[:n] + j])
    for i in range(len(lengths) - np.searchsorted(lengths[::-1], TOGETHER, side="right")):
        rest = data[starts[i] + TOGETHER : starts[i] + lengths[i]]
        state[i] = INIT ^ np.uint32(zlib.crc32(rest, int(state[i] ^ INIT)))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words of the texts that lie end to end in data:
    where a text begins or ends, so does a word."""
    part = WORD[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = part[:-1], part[1:]
    begins = offsets[:-1][offsets[1:] > offsets[:-1]]
    before[begins] = False
    after[begins[begins > 0] - 1] = False
    return np.flatnonzero(part & ~before), np.flatnonzero(part & ~after) + 1


def features(data: np.ndarray, offsets: np.ndarray, buckets: int, longest: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """n_words of each text, and for each n from 1 to `longest` (buckets of all
    n-grams, at which of them each text's begin, with their number last)."""
    starts, ends = words(data, offsets)
    data = LOWER[data]
    first = np.searchsorted(starts, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    order = np.argsort(starts - ends, kind="stable")
    state = np.full(len(starts) + 1, INIT, np.uint32)
    out = []
    for n in range(1, longest + 1):
        # of the (n-1)-gram that begins at each word; its next word is taken now
        state = state[:-1] if n == 1 else step(state[:-1], np.uint32(ord(" ")))
        last = order[order >= n - 1]
        run = state[last - (n - 1)]
        advance(run, data, starts[last], (ends - starts)[last])
        state[last - (n - 1)] = run
        same = text[: len(state)] == text[n - 1 :]  # n-grams don't cross texts
        at = np.concatenate([[0], np.cumsum(same)])
        out.append((((state ^ INIT) % np.uint32(buckets))[same], at[np.minimum(first, len(same))]))
    return np.diff(first), out


def slices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, offsets of texts) of a column of texts, SLICE bytes at a time or
    a longer text alone. Nulls are empty."""
    column = pc.fill_null(column, "")
    _, ends, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1)
        yield data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def bucket_counts(texts: DataFrame, text_col: str, buckets: int, longest: int) -> np.ndarray:
    """How many of all texts' n-grams fall into each bucket. Each task adds its
    own up and gives at most `buckets` rows; the driver reads `buckets`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for data, offsets in slices(b.column(0)):
                for got, _ in features(data, offsets, buckets, longest)[1]:
                    total += np.bincount(got, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=["bucket", "n"])

    rows = texts.select(F.col(text_col).cast("string")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's shares, add-one smoothed."""
    n, s, t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, longest: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n_words, n_features, weight) of each row: weight is the floored
    mean of its n-grams' gains, 0 without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_features, weight = [], [], []
            for data, offsets in slices(b.column(1)):
                count, grams = features(data, offsets, len(gain), longest)
                n, total = np.zeros(len(count), np.int64), np.zeros(len(count), np.int64)
                for got, place in grams:
                    n += np.diff(place)
                    total += np.diff(np.concatenate([[0], np.cumsum(gain[got])])[place])
                n_words.append(count)
                n_features.append(n)
                weight.append(total // np.maximum(n, 1))
            cols = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in (n_words, n_features, weight)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["id", "n_words", "n_features", "weight"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string")).mapInArrow(run, "id long, n_words long, n_features long, weight long")


def gumbel(seed: int) -> Column:
    """Thousandths of the Gumbel noise of a row's id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


#: Neighbouring scores whose counts are added up together.
CELL = 256


def places(drawable: DataFrame) -> DataFrame:
    """(score, above): how many rows have a greater score. Scores are
    thousandths between bounds that the logs set (some 90,000 values at any
    size), so this is small; it is summed within cells of CELL and over them."""
    n = drawable.groupBy("score").agg(F.count("*").alias("n")).withColumn("cell", F.floor(F.col("score") / CELL))
    ahead = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = n.groupBy("cell").agg(F.sum("n").alias("n"))
    cells = cells.select("cell", ahead(Window.orderBy(F.desc("cell"))).alias("before"))
    within = n.withColumn("own", ahead(Window.partitionBy("cell").orderBy(F.desc("score"))))
    return within.join(F.broadcast(cells), "cell").select("score", (F.col("before") + F.col("own")).alias("above"))


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 25,
    least_words: int = 20,
    buckets: int = 10_000,
    longest: int = 2,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
) -> DataFrame:
    """(id_col, n_words, n_features, weight, score, rank) of each row of docs.

    The features of a text are its runs of 1 to `longest` words, repeats
    counted, each hashed into a bucket by CRC-32. A bucket's gain is the log
    ratio of its share in `target` to that in docs; a row's weight the floored
    mean over its features. Of the rows with least_words words `percent` are
    drawn without replacement, with odds of exp(weight): the greatest sums of
    weight and Gumbel noise, all in thousandths, ties to the smaller id. rank
    counts them from 1 and is null for all others.

    Two passes over the texts (counts, then weights), neither of which shuffles
    them; ranks need no total sort, for a score's place is the count above it
    and only rows of one score are ordered together.

    Null and empty texts have no feature and weight 0; null ids share the noise
    of an empty id and come first among ties; repeated rows count and are drawn
    each; other columns are left out, whatever they are named; an empty table
    gives no row, an empty target gains by docs' counts alone.
    """
    gain = gains(bucket_counts(docs, text_col, buckets, longest), bucket_counts(target, target_col, buckets, longest))
    scored = put(weigh(docs, gain, longest, id_col, text_col).withColumn("score", F.col("weight") + gumbel(seed)), "scored")
    drawable = scored.where(F.col("n_words") >= least_words)
    wanted = drawable.count() * percent // 100
    rows = scored.join(F.broadcast(places(drawable)), "score", "left")
    may = (F.col("n_words") >= least_words) & (F.col("above") < wanted)
    rank = F.col("above") + F.row_number().over(Window.partitionBy("score").orderBy("id", "n_features"))
    drawn = rows.where(may).withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    rest = rows.where(~F.coalesce(may, F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", F.col("rank").cast("long"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


def _half_byte_table() -> list[int]:
    out = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ 0xEDB88320 if c & 1 else c >> 1
        out.append(c)
    return out


def crc_sql(text: str) -> str:
    """DuckDB SQL of the CRC-32 of a string expression's UTF-8 bytes, half a
    byte at a time, the low half first."""
    h = f"hex(encode({text}))"
    halves = f"list_transform(range(0, length({h})), lambda i: instr('0123456789ABCDEF', substr({h}, (i + 2 - 2 * (i % 2))::BIGINT, 1)) - 1)"
    return f"xor(list_reduce({halves}, lambda s, b: xor({_half_byte_table()}[(xor(s, b) & 15) + 1], s >> 4)::BIGINT, 4294967295::BIGINT), 4294967295::BIGINT)"


SQL = f"""
WITH w AS (
  SELECT 0 AS side, doc_id AS id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents
  UNION ALL
  SELECT 1, item_id, -row_number() OVER (), regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark),
one AS (SELECT side, r, unnest(ws) AS f, generate_subscripts(ws, 1) AS i FROM w),
two AS (SELECT side, r, f || ' ' || lead(f) OVER (PARTITION BY r ORDER BY i) AS f FROM one),
f AS (SELECT side, r, f FROM one UNION ALL SELECT side, r, f FROM two WHERE f IS NOT NULL),
names AS (SELECT f, {crc_sql("f")} % 10000 AS b FROM (SELECT DISTINCT f FROM f)),
hits AS (SELECT side, r, b FROM f JOIN names USING (f)),
n AS (SELECT b, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM hits GROUP BY b),
tot AS (SELECT coalesce(sum(s), 0)::DOUBLE AS ss, coalesce(sum(t), 0)::DOUBLE AS tt FROM n),
gain AS (SELECT b, floor(1000 * ln((t + 1.0::DOUBLE) * (ss + 10000) / ((s + 1.0::DOUBLE) * (tt + 10000))))::BIGINT AS g FROM n, tot),
sums AS (SELECT r, count(*) AS n_features, sum(g)::BIGINT AS g FROM hits JOIN gain USING (b) WHERE side = 0 GROUP BY r),
d AS (
  SELECT id AS doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, CASE WHEN n_features IS NULL THEN 0 ELSE (g - ((g % n_features) + n_features) % n_features) // n_features END AS weight,
         list_reduce(list_transform(range(1, 9), lambda i: instr('0123456789abcdef', substr(sha256('7:' || coalesce(id::VARCHAR, '')), i::BIGINT, 1)) - 1), lambda a, b: a * 16 + b)::DOUBLE AS h
  FROM w LEFT JOIN sums USING (r) WHERE side = 0),
s AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM d),
k AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_words >= 20) OVER () AS n FROM s)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN n_words >= 20 AND place <= 25 * n // 100 THEN place END::BIGINT AS rank FROM k
"""

QUERIES = {"op11_importance_resampling": op11_importance_resampling}
ORACLE = {"op11_importance_resampling": SQL}
