"""Dense search by matrix products of tiles, and an inverted file of vectors.

Rows are packed into tiles (ids and a matrix as bytes), queries likewise; Spark
brings together the tiles that meet, and one product scores all their pairs.
Exact search lets all tiles meet all queries; the inverted file only those of
the cells whose centroids are nearest to a query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.sources import store

#: Vectors of a tile, and bytes of queries' tiles that Spark may send to every
#: task.
TILE, SENT = 1024, 64 << 20


def tiles(rows: DataFrame, ids: list[str], vector: str, marks: list[Column], by: list[str], size: int = TILE) -> DataFrame:
    """(by..., ids array<struct<ids...>>, marks array<bigint>, dim, x binary) of
    up to `size` rows each: each task packs its own rows as they come, so
    nothing is shuffled; ids stay Spark's, vectors become one matrix. Rows
    without a vector are left out."""
    one = [F.struct(*ids).alias("_id"), F.array(*[F.when(m.isNotNull(), F.xxhash64(m)).otherwise(F.lit(0)) for m in marks] or [F.lit(0)]).cast("array<bigint>").alias("_marks")]
    kept = rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(*by, *one, F.col(vector).cast("array<double>").alias("_v"))
    kinds = dict(kept.dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in by] + [f"ids array<{kinds['_id']}>", "marks array<bigint>", "dim int", "x binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def record(key: tuple) -> pa.RecordBatch:
            id_parts, mark_parts, x = held.pop(key)
            own = pa.concat_arrays(id_parts)
            cols = [pa.array([k], t) for k, t in zip(key, types, strict=True)]
            listed = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
            return pa.RecordBatch.from_arrays([*cols, listed, pa.array([np.concatenate(mark_parts).ravel()], pa.list_(pa.int64())), pa.array([x[0].shape[1]], pa.int32()), pa.array([np.concatenate(x).tobytes()], pa.binary())], names=[*by, "ids", "marks", "dim", "x"])

        types: list = []
        for b in batches:
            types = [b.column(i).type for i in range(len(by))]
            v = b.column(len(by) + 2)
            dims = np.diff(v.offsets.to_numpy())
            flat = v.flatten().to_numpy(zero_copy_only=False)
            begins = np.cumsum(dims) - dims
            marked = b.column(len(by) + 1).flatten().to_numpy().reshape(b.num_rows, -1)
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*[b.column(j).to_pylist() for j in range(len(by))], dims.tolist(), strict=True)):
                groups.setdefault(key, []).append(i)
            for (*key, dim), at in groups.items():
                for lo in range(0, len(at), size):
                    some = np.array(at[lo : lo + size])
                    k = tuple(key)
                    if k in held and (sum(map(len, held[k][0])) + len(some) > size or held[k][2][0].shape[1] != dim):
                        yield record(k)
                    got = held.setdefault(k, [[], [], []])
                    got[0].append(b.column(len(by)).take(pa.array(some)))
                    got[1].append(marked[some])
                    got[2].append(flat[begins[some][:, None] + np.arange(dim)])
            while len(held) > 256:  # cells of few rows must not pile up
                yield record(next(iter(held)))
        for k in list(held):
            yield record(k)

    return kept.mapInArrow(run, schema)


def best_of_tiles(pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, similarity) of the best k rows of each query within
    the pairs of tiles (q_ids, q_marks, q_x, ids, marks, x, dim) that a task
    meets: one product a pair, then the task's own best so far."""
    q_kind, d_kind = (pairs.schema[c].dataType.elementType.fields[0].dataType.simpleString() for c in ("q_ids", "ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}  # of a tile of queries, the k greatest so far
        for b in batches:
            cols = {c: b.column(i) for i, c in enumerate(["q_ids", "q_marks", "q_dim", "q_x", "ids", "marks", "dim", "x"])}
            for i in range(b.num_rows):
                dim = cols["dim"][i].as_py()
                if cols["q_dim"][i].as_py() != dim:
                    continue
                q, x = (np.frombuffer(cols[c][i].as_buffer(), np.float64).reshape(-1, dim) for c in ("q_x", "x"))
                sims = np.round(q @ x.T, 9)
                want, have = (cols[c][i].values.to_numpy().reshape(n, -1) for c, n in (("q_marks", len(q)), ("marks", len(x))))
                for m in range(want.shape[1]):
                    sims[(want[:, m, None] != 0) & (want[:, m, None] != have[None, :, m])] = -np.inf
                sims[~np.isfinite(sims)] = -np.inf
                key = hash(cols["q_x"][i].as_buffer().to_pybytes())
                old = best.get(key, np.full((len(q), k), -np.inf))
                top = np.partition(np.concatenate([old, sims], axis=1), len(x), axis=1)[:, len(x) :]
                if len(best) > 64:
                    best.clear()
                best[key] = top
                # all that are as good as the k-th so far, as ties are settled by id later
                r, c = np.nonzero((sims >= top.min(axis=1)[:, None]) & (sims > -np.inf))
                q_ids, d_ids = cols["q_ids"][i].values.field(0), cols["ids"][i].values.field(0)
                yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(r)), d_ids.take(pa.array(c)), pa.array(sims[r, c])], names=["query_id", "doc_id", "similarity"])

    found = pairs.select("q_ids", "q_marks", "q_dim", "q_x", "ids", "marks", "dim", "x").mapInArrow(run, f"query_id {q_kind}, doc_id {d_kind}, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "doc_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _queries(asked: DataFrame, want: list[Column], by: list[str], size: int = TILE) -> DataFrame:
    q = tiles(asked, ["query_id"], "embedding", want, by, size)
    return q.select(*by, *[F.col(c).alias(f"q_{c}") for c in ("ids", "marks", "dim", "x")])


def _sent(df: DataFrame, rows: int, dim: int) -> DataFrame:
    """df, sent to every task if its vectors are few."""
    return F.broadcast(df) if rows * max(dim, 1) * 8 <= SENT else df


def exact(asked: DataFrame, rows: DataFrame, k: int, match: list[tuple[str, str]] | None = None) -> DataFrame:
    """(query_id, doc_id, rank, similarity): the k rows (doc_id, embedding) of
    greatest inner product with each query (query_id, embedding), in double
    precision to nine places, ties to the smaller id. The queries are a stated
    set; packed, they are sent to all tasks where they are few, and dealt out
    with the rows' tiles where not.

    match: pairs (column of asked, column of rows); where a query's is not
    null, only rows that have the same value count (compared by 64-bit hash).
    Null and empty vectors and those with a null or non-finite component are
    never found, those of other lengths don't meet."""
    match = match or []
    n, dim = asked.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    q = _queries(asked.coalesce(1) if n <= TILE else asked, [F.col(a) for a, _ in match], [])
    x = tiles(rows, ["doc_id"], "embedding", [F.col(b) for _, b in match], [])
    return best_of_tiles(x.crossJoin(_sent(q, n, dim)), k)  # tiles, not rows, and all against the stated set


#: Vectors that an inverted file is fitted on, and queries of the sample that
#: tell how many cells to probe.
SAMPLE, TRIALS, ROUNDS, MOST_CELLS = 16_384, 256, 10, 4096


@dataclass(frozen=True)
class VectorIndex:
    """An inverted file: rows (cell, doc_id, embedding) in folders by cell, the
    cells' centroids, and how many of them a search probes."""

    rows: DataFrame
    centroids: np.ndarray
    probes: int


def fit(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centroids of unit vectors: spherical k-means, begun with spread rows."""
    centroids = sample[np.linspace(0, len(sample) - 1, cells).astype(int)]
    for _ in range(ROUNDS):
        own = (sample @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centroids)
    return centroids


def probes_for(sample: np.ndarray, centroids: np.ndarray, k: int, recall: float) -> int:
    """The least number of cells that find this share of the k nearest of the
    sample's first vectors within the sample."""
    q = sample[:TRIALS]
    sims = q @ sample.T
    np.fill_diagonal(sims[:, : len(q)], -np.inf)
    near = np.argpartition(-sims, min(k, len(sample) - 1), axis=1)[:, : min(k, len(sample) - 1)]
    own = (sample @ centroids.T).argmax(axis=1)
    order = np.argsort(-(q @ centroids.T), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centroids))[None, :], axis=1)
    depth = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
    return int(depth[min(len(depth) - 1, math.ceil(recall * len(depth)) - 1)]) + 1 if len(depth) else 1


def write_ivf(vectors: DataFrame, path: str, cells: int | None = None, recall: float = 0.97, k: int = 5) -> None:
    """The inverted file of vectors (doc_id, embedding) as tables below path.

    Centroids (about the square root of the rows, MOST_CELLS at most) are
    fitted on the SAMPLE rows of least id hash; every row is then dealt to its
    nearest, and a search probes as many cells as find `recall` of the k
    nearest of sampled vectors within the sample. A cell of many rows (copies
    of one vector, say) is written by several tasks. Rows without a vector, or
    with one of another length than most, are left out."""
    spark = vectors.sparkSession
    rows = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).select("doc_id", F.col("embedding").cast("array<float>").alias("embedding"))
    dim = (rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first() or [1])[0]
    rows = rows.where(F.size("embedding") == dim)
    n = rows.count()
    got = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).collect()
    sample = np.array([r.embedding for r in got], np.float64).reshape(-1, dim)
    norm = np.linalg.norm(sample, axis=1, keepdims=True)
    sample = sample / np.where(norm > 0, norm, 1)
    cells = max(1, min(cells or round(math.sqrt(n)), MOST_CELLS, len(sample)))
    centroids = fit(sample, cells) if len(sample) else np.zeros((1, dim))
    probes = probes_for(sample, centroids, k, recall) if len(sample) > 1 else 1
    dealt = nearest(rows, "embedding", centroids, 1, ["doc_id", "embedding"]).withColumnRenamed("cells", "cell").withColumn("cell", F.get("cell", 0))
    # tasks of even size: a large cell is split over several, small ones share one
    dealt.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    spark.createDataFrame([(probes, dict(rows.dtypes)["doc_id"])], "probes int, id_type string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def read_ivf(spark: SparkSession, path: str) -> VectorIndex:
    meta = spark.read.parquet(f"{path}/meta").first()
    centroids = np.array([r.centroid for r in spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()], np.float64)
    rows = spark.read.schema(f"doc_id {meta.id_type}, embedding array<float>, cell int").parquet(f"{path}/rows")
    return VectorIndex(rows, centroids, meta.probes)


def nearest(rows: DataFrame, vector: str, centroids: np.ndarray, n: int, keep: list[str]) -> DataFrame:
    """rows' columns `keep` and cells, the n centroids nearest to each vector,
    the nearest first. Vectors of another length than theirs have none."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(len(keep))
            dims = np.diff(x.offsets.to_numpy())
            fits = np.flatnonzero(dims == centroids.shape[1])
            out = np.zeros((b.num_rows, n), np.int32)
            if len(fits):
                flat, begins = x.flatten().to_numpy(zero_copy_only=False), np.cumsum(dims) - dims
                near = flat[begins[fits][:, None] + np.arange(centroids.shape[1])].astype(np.float64) @ centroids.T
                out[fits] = np.argsort(-near, axis=1, kind="stable")[:, :n]
            offsets = np.concatenate([[0], np.cumsum(np.where(dims == centroids.shape[1], n, 0))])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(out[fits].ravel(), pa.int32()))], names=[*keep, "cells"])

    schema = ", ".join([f"{c} {kinds[c]}" for c in keep] + ["cells array<int>"])
    return rows.where(F.col(vector).isNotNull()).select(*keep, F.col(vector).alias("_v")).mapInArrow(run, schema)


def probed(asked: DataFrame, index: VectorIndex, k: int, allowed: DataFrame | None = None, match: list[tuple[str, str]] | None = None, attributes: DataFrame | None = None, probes: int | None = None) -> DataFrame:
    """exact()'s rows and columns, found in the cells nearest to each query
    alone: an equi-join of tiles by cell, so only the folders of cells that
    some query probes are read. attributes has the columns that match names."""
    match = match or []
    n = min(probes or index.probes, len(index.centroids))
    rows = index.rows if allowed is None else index.rows.join(allowed.select("doc_id"), "doc_id", "left_semi")
    rows = rows if attributes is None else rows.join(attributes, "doc_id")
    want = [a for a, _ in match]
    # few queries share a cell: their tiles are packed after they are dealt by it
    dealt = nearest(asked, "embedding", index.centroids, n, ["query_id", "embedding", *want]).withColumn("cell", F.explode("cells")).drop("cells")
    dealt = store.keep(dealt, "probes")
    cells = [r.cell for r in dealt.select("cell").distinct().collect()]  # MOST_CELLS at most
    q = _queries(dealt.repartition("cell"), [F.col(a) for a in want], ["cell"])
    x = tiles(rows.where(F.col("cell").isin(cells)), ["doc_id"], "embedding", [F.col(b) for _, b in match], ["cell"])
    return best_of_tiles(x.join(_sent(q, dealt.count(), index.centroids.shape[1]), "cell"), k)
