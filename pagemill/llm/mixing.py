"""Mixing sources to target weights by Pfair scheduling: rows in DataFrame
functions alone, the blocks' slots by a heap on the driver."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.llm.shelf import put, table

#: Where set, only so many sources, the largest, are scheduled on their own.
MOST_SOURCES: int | None = None
#: About how many slots a cycle of rounded weights has.
CYCLE = 1000
OTHER = "(other)"


def weigh(sizes: DataFrame, weights: dict[str, float] | None, temper: float) -> DataFrame:
    """sizes with w, the weight of each source group: that given, else size **
    temper scaled among those without one. One of 0 or less is 1e-9."""
    w = F.pow(F.col("size").cast("double"), F.lit(temper))
    if weights:
        given = F.create_map(*[F.lit(float(x) if i else x) for kv in weights.items() for i, x in enumerate(kv)])
        mean = sum(weights.values()) / len(weights)
        w = F.coalesce(given[F.col("grp")], mean * w / F.avg(w).over(Window.partitionBy(F.lit(1))))
    return sizes.withColumn("w", F.when(w > 0, w).otherwise(1e-9))


def shares(sizes: DataFrame, weights: dict[str, float] | None, temper: float) -> DataFrame:
    """(grp, a): slots a cycle for each source group, one at least: its weight
    rounded."""
    total = F.sum("w").over(Window.partitionBy(F.lit(1)))
    return weigh(sizes, weights, temper).select("grp", F.greatest(F.lit(1), F.floor(CYCLE * F.col("w") / total + 0.5)).cast("int").alias("a"))


def pfair(a: list[int], blocks: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
    """(s, k, release, deadline, slot) of each of the blocks[s] blocks of
    source s, whose weight is a[s] / sum(a), by slot.

    Block k is released at floor(k / weight) and due by ceil((k + 1) / weight).
    Each slot goes to the released block with the earliest deadline. The
    weights add up to 1, so every deadline is met and no source is ever a whole
    block ahead of or behind its weight until it ends. The work grows with the
    blocks, not with slots or sources.
    """
    total, t = sum(a), 0
    waiting, ready = [(0, s, 0) for s, n in enumerate(blocks) if n], []
    while waiting or ready:
        if not ready:
            t = max(t, waiting[0][0])
        while waiting and waiting[0][0] <= t:
            release, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * total // a[s]), s, k, release))
        due, s, k, release = heapq.heappop(ready)
        yield s, k, release, due, t
        t += 1
        if k + 1 < blocks[s]:
            heapq.heappush(waiting, ((k + 1) * total // a[s], s, k + 1))


def schedule(a: DataFrame) -> DataFrame:
    """(grp, a, cycle, k, at): the k-th block of a group within a cycle runs in
    slot `at` of it. At the end of a cycle all stand at zero, so the next is
    the same."""
    got = sorted(map(tuple, a.select("grp", "a").collect()))
    n = [x for _, x in got]
    rows = [(*got[s], sum(n), k, t) for s, k, _, _, t in pfair(n, n)]
    return a.sparkSession.createDataFrame(rows, "grp string, a int, cycle int, k int, at int", verifySchema=False)


def whole_schedule(weighed: DataFrame, block_chars: int) -> DataFrame:
    """(grp, mix_block, mix_release, mix_deadline, mix_slot) of every block of
    (grp, size, w) rows, w taken exactly. The driver holds a row per block."""
    got = sorted(map(tuple, weighed.select("grp", "size", "w").collect()))
    exact = [Fraction(w) for _, _, w in got]
    unit = max((x.denominator for x in exact), default=1)  # powers of two
    rows = [(got[s][0], *rest) for s, *rest in pfair([int(x * unit) for x in exact], [-(-size // block_chars) for _, size, _ in got])]
    slots = put(weighed.sparkSession.createDataFrame(rows, "grp string, mix_block long, mix_release long, mix_deadline long, mix_slot long", verifySchema=False), "slots")
    return F.broadcast(slots) if len(rows) < 1_000_000 else slots


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    temper: float = 0.5,
    block_chars: int = 65_536,
    rounded: bool = False,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """docs with mix_source, mix_block, mix_release, mix_deadline, mix_slot and
    mix_offset (characters of its source since the block's begin): read by
    (mix_slot, mix_offset), the sources interleave by weight.

    A source's documents, in the order of their ids' md5, are laid end to end;
    block b holds those that begin in its b-th run of block_chars characters
    (a longer document uses up the blocks that it covers). Positions come from
    sums within (source, first three hex digits) and running sums over these
    at most 4096 cells of a source, so a source of any size spreads over many
    tasks. When a source ends, its slots stay empty and the others go on.

    Weights are taken exactly over the whole schedule; `rounded` takes them as
    whole slots of a cycle of about CYCLE that repeats.

    Null sources are one source, every source is scheduled by its own
    weight (unless MOST_SOURCES is set: those beyond it share one group), null and empty texts count one character, null ids sort first,
    repeated rows follow each other, other columns pass unchanged (a column
    named mix_... is replaced), an empty table stays empty.
    """
    kept = [c for c in docs.columns if not c.startswith("mix_")]
    src = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    key = F.coalesce(F.md5(F.col(id_col).cast("string")), F.lit(""))
    n = F.greatest(F.char_length(F.coalesce(F.col(text_col), F.lit(""))), F.lit(1)).cast("long")
    # the given columns travel as numbered ones, so no helper's name meets theirs
    rows = docs.select(*[F.col(f"`{c}`").alias(f"mix_own_{i}") for i, c in enumerate(kept)], src.alias("mix_source"), key.alias("mix_key"), F.substring(key, 1, 3).alias("mix_cell"), n.alias("mix_n"))
    own_id = f"mix_own_{kept.index(id_col)}"

    cells = put(rows.groupBy("mix_source", "mix_cell").agg(F.sum("mix_n").alias("size")), "cells")
    totals = cells.groupBy("mix_source").agg(F.sum("size").alias("size"))
    if MOST_SOURCES is None:
        grouped = lambda df: df.withColumn("grp", F.col("mix_source"))
    else:
        large = totals.orderBy(F.desc("size"), "mix_source").limit(MOST_SOURCES).select("mix_source", F.col("mix_source").alias("grp"))
        grouped = lambda df: df.join(F.broadcast(large), "mix_source", "left").withColumn("grp", F.coalesce("grp", F.lit(OTHER)))
    cells = grouped(cells)
    # of the sources that share a group the cells interleave, so a cell's begin
    # is the sum over (cell, source) before it in the group
    by_cell = cells.groupBy("grp", "mix_cell").agg(F.sum("size").alias("size"))
    run = Window.partitionBy("grp").orderBy("mix_cell").rowsBetween(Window.unboundedPreceding, -1)
    begins = by_cell.withColumn("begin", F.coalesce(F.sum("size").over(run), F.lit(0))).select("grp", "mix_cell", "begin")
    sizes = by_cell.groupBy("grp").agg(F.sum("size").alias("size"))

    within = Window.partitionBy("grp", "mix_cell").orderBy("mix_key", own_id, "mix_source", "mix_n").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        grouped(rows)
        .withColumn("mix_before", F.coalesce(F.sum("mix_n").over(within), F.lit(0)))
        .join(begins, ["grp", "mix_cell"])
        .withColumn("mix_begin", F.col("begin") + F.col("mix_before"))
        .withColumn("mix_block", F.expr(f"mix_begin div {block_chars}"))
    )
    if rounded:
        plan = put(schedule(shares(sizes, weights, temper)), "cycle")
        placed = (
            placed.join(plan.select("grp", F.col("a").alias("mix_a"), "cycle").distinct(), "grp")
            .withColumn("k", F.expr("cast(mix_block % mix_a as int)"))
            .join(plan.select("grp", "k", "at"), ["grp", "k"])
            .withColumn("mix_release", F.expr("mix_block * cycle div mix_a"))
            .withColumn("mix_deadline", F.expr("((mix_block + 1) * cycle + mix_a - 1) div mix_a"))
            .withColumn("mix_slot", F.expr("mix_block div mix_a * cycle + at"))
        )
    else:
        placed = placed.join(whole_schedule(weigh(sizes, weights, temper), block_chars), ["grp", "mix_block"])
    return placed.select(*[F.col(f"mix_own_{i}").alias(c) for i, c in enumerate(kept)], F.col("grp").alias("mix_source"), "mix_block", "mix_release", "mix_deadline", "mix_slot", F.expr(f"mix_begin % {block_chars}").alias("mix_offset"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "mix_source", "mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_offset")


def in_mixed_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs, whole and as they are, in the order of the mixture: null sources
    are one source, repeated rows follow each other, whatever other columns
    are named; an empty table stays empty."""
    numbered = docs.select("doc_id", "source", "text", *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "source", "text")])
    mixed = mix(numbered).sort("mix_slot", "mix_offset")
    return mixed.select(*[F.col(c if c in ("doc_id", "source", "text") else f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


QUERIES = {"op2_mixing": op2_mixing}
ORACLE = {
    "op2_mixing": """
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS src, coalesce(md5(CAST(doc_id AS VARCHAR)), '') AS h,
         greatest(length(coalesce(text, '')), 1) AS n FROM documents),
pos AS (
  SELECT *, coalesce(sum(n) OVER (PARTITION BY src ORDER BY h, doc_id, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b0 FROM d),
wt AS (SELECT src, CAST(pow(CAST(sum(n) AS DOUBLE), 0.5) * pow(2.0, 52) AS HUGEINT) AS a, CAST((sum(n) + 65535) // 65536 AS BIGINT) AS blocks FROM d GROUP BY src),
g AS (SELECT list(src ORDER BY src) AS srcs, list(a ORDER BY src) AS aa, list(blocks ORDER BY src) AS nn, CAST(sum(a) AS HUGEINT) AS cyc, CAST(sum(blocks) AS BIGINT) AS every FROM wt),
edf AS (
  SELECT CAST(-1 AS BIGINT) AS t, list_transform(aa, lambda x: CAST(0 AS BIGINT)) AS c, CAST(0 AS BIGINT) AS pick FROM g
  UNION ALL
  SELECT t + 1, list_transform(c, lambda v, i: CASE WHEN i = p THEN v + 1 ELSE v END), p
  FROM (SELECT t, c, coalesce(CAST(list_min(list_filter(list_transform(range(1, len(aa) + 1), lambda s:
          CASE WHEN c[s] < nn[s] AND (c[s] * cyc) // aa[s] <= t + 1 THEN (((c[s] + 1) * cyc + aa[s] - 1) // aa[s]) * 100000 + s END), lambda z: z IS NOT NULL)) % 100000 AS BIGINT), 0) AS p
        FROM edf, g WHERE list_sum(c) < every)),
slots AS (
  SELECT srcs[pick] AS src, t AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS k FROM edf, g WHERE pick > 0),
blk AS (SELECT doc_id, pos.src, CAST(b0 // 65536 AS BIGINT) AS b, CAST(b0 % 65536 AS BIGINT) AS off, a, cyc FROM pos JOIN wt ON pos.src = wt.src, g)
SELECT doc_id, blk.src AS mix_source, b AS mix_block, CAST((b * cyc) // a AS BIGINT) AS mix_release, CAST(((b + 1) * cyc + a - 1) // a AS BIGINT) AS mix_deadline,
       slot AS mix_slot, off AS mix_offset
FROM blk JOIN slots ON blk.src = slots.src AND b = slots.k
"""
}
