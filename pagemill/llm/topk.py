"""Exact top-k inner products over KD-trees, one per shard of the vectors."""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.llm.shelf import put, table

LEAF, SHARD_ROWS, BLOCK_ROWS = 64, 8192, 512


def valid(vec: str) -> F.Column:
    """Not null, not empty, no null or non-finite component."""
    v = F.col(vec)
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


class Tree:
    """A KD-tree over integer vectors: median splits along the widest side of
    a node's tight bounding box, LEAF rows a leaf; each node also has its least
    id. Arrays by node: low, high, left (-1 in a leaf), begin, end, least."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.lexsort((ids,))
        self.ids, self.x = ids[order], x[order]
        nodes: list[list] = []
        stack = [(0, len(ids), -1)]
        perm = np.arange(len(ids))
        while stack:
            a, b, parent = stack.pop()
            own = self.x[perm[a:b]]
            low, high = own.min(axis=0), own.max(axis=0)
            if parent >= 0 and nodes[parent][2] < 0:
                nodes[parent][2] = len(nodes)
            elif parent >= 0:
                nodes[parent][6] = len(nodes)
            nodes.append([low, high, -1, a, b, int(self.ids[perm[a:b]].min()), -1])
            side = int((high.astype(np.float64) - low).argmax())
            if b - a > LEAF and high[side] > low[side]:
                mid = (b - a) // 2
                perm[a:b] = perm[a:b][np.argpartition(own[:, side], mid)]
                here = len(nodes) - 1
                stack += [(a + mid, b, here), (a, a + mid, here)]
        self.ids, self.x = self.ids[perm], self.x[perm]
        self.low, self.high = np.array([n[0] for n in nodes]), np.array([n[1] for n in nodes])
        self.left, self.right = [n[2] for n in nodes], [n[6] for n in nodes]
        self.begin, self.end, self.least = [n[3] for n in nodes], [n[4] for n in nodes], [n[5] for n in nodes]

    LISTS = ("left", "right", "begin", "end", "least")

    def pack(self) -> bytes:
        lists = {k: np.array(getattr(self, k), np.int64) for k in self.LISTS}
        return _pack(ids=self.ids, x=self.x, low=self.low, high=self.high, **lists)

    @classmethod
    def unpack(cls, blob: bytes) -> Tree:
        out = cls.__new__(cls)
        for k, v in _unpack(blob).items():
            setattr(out, k, v.tolist() if k in cls.LISTS else v)
        return out

    def search(self, qid: np.ndarray, q: np.ndarray, k: int, known: np.ndarray) -> list[tuple[int, int, int]]:
        """(query id, id, score) of each query's k best here, best first, the
        query's own id left out. A row below known (a kth score found before)
        can't be among the k best of all and may be missing.

        Boxes give an upper bound of the inner product; nodes are opened best
        bound first until none can beat the kth score, where an equal bound
        counts only with a smaller id.
        """
        work = np.float64 if float(np.abs(q).max(initial=0)) * float(np.abs(self.x).max(initial=0)) * q.shape[1] < 2**52 else object
        x, qs = self.x.astype(work), q.astype(work)
        bounds = np.maximum(qs, 0) @ self.high.astype(work).T + np.minimum(qs, 0) @ self.low.astype(work).T
        out = []
        for i in range(len(q)):
            bound, me, mine = bounds[i], int(qid[i]), qs[i]
            best: list[tuple[int, int]] = []  # a heap of (score, -id), worst first
            worst = (int(known[i]), -(1 << 63)) if known[i] > -(1 << 63) else None
            heap = [(-bound[0], 0)]
            while heap:
                b, n = heapq.heappop(heap)
                if worst is not None and (int(-b), -self.least[n]) < worst:
                    if -b < worst[0]:
                        break
                    continue
                if self.left[n] >= 0:
                    for c in (self.left[n], self.right[n]):
                        heapq.heappush(heap, (-bound[c], c))
                    continue
                s = x[self.begin[n] : self.end[n]] @ mine
                for j in range(len(s)) if worst is None else np.flatnonzero(s >= worst[0]).tolist():
                    row = (int(s[j]), -int(self.ids[self.begin[n] + j]))
                    if -row[1] == me or (worst is not None and row < worst):
                        continue
                    heapq.heappush(best, row) if len(best) < k else heapq.heappushpop(best, row)
                    if len(best) == k and (worst is None or best[0] > worst):
                        worst = best[0]
            out += [(me, -j, s) for s, j in sorted(best, reverse=True)]
        return out


def _pack(**arrays: np.ndarray) -> bytes:
    f = io.BytesIO()
    np.savez(f, **arrays)
    return f.getvalue()


def _unpack(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob)) as f:
        return {k: f[k] for k in f.files}


def narrow(x: np.ndarray) -> np.ndarray:
    """The same integers in as few bytes as hold them all."""
    top = max(-int(x.min(initial=0)) - 1, int(x.max(initial=0)))
    return x.astype(next(t for t, n in ((np.int8, 7), (np.int16, 15), (np.int32, 31), (np.int64, 63)) if top < 1 << n))


def blocks(rows: DataFrame, size: int, tree: bool) -> DataFrame:
    """(dim, part, blob) of (id, v array<long>): rows of a dimension dealt by
    hash into parts of about `size`, each one binary row, as a tree or plain."""
    parts = rows.groupBy("dim").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size)).cast("int").alias("parts"))
    dealt = rows.join(parts, "dim").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        ids, x = f["id"].to_numpy(np.int64), narrow(np.stack(f["v"].to_numpy()).astype(np.int64))
        blob = Tree(ids, x).pack() if tree else _pack(ids=ids, x=x)
        return pd.DataFrame({"dim": [f["dim"].iloc[0]], "part": [f["part"].iloc[0]], "blob": [blob]})

    return dealt.select("dim", "part", "id", "v").groupBy("dim", "part").applyInPandas(run, "dim int, part int, blob binary")


def top_k(vectors: DataFrame, is_query: F.Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that is_query picks its k
    rows of greatest integer inner product, of floor(scale * x) components,
    ties to the smaller id; fewer where there are fewer.

    Candidates are dealt into shards of about SHARD_ROWS, queries into blocks
    of BLOCK_ROWS. First each block searches one shard of its own; the kth
    scores found go with it to all others, whose trees (each built once) it
    then searches with that bound, a block and a shard a task. Only k rows a query and shard leave
    a task. The blocks meet every shard, as a stated query set must; the boxes
    decide how much of a shard is read.

    Vectors that are null, empty or hold null or non-finite components take no
    part, nor do null ids; vectors of different length don't meet; rows of a
    query's own id aren't its candidates; repeated rows each count. Scores
    beyond 64 bits are not supported. Extra columns are ignored; no query, no row.
    """
    whole = vectors.where(valid(vec_col) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"),
        F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * scale)).alias("v"),
        F.size(vec_col).alias("dim"),
        is_query.alias("asks"),
    )
    shards = put(blocks(whole.select("id", "v", "dim"), SHARD_ROWS, True), "shards")
    asked = put(blocks(whole.where("asks").select("id", "v", "dim"), BLOCK_ROWS, False), "queries")
    # shards and blocks meet by key (dim, shard, block), each task one such pair
    n_shards = shards.groupBy("dim").agg(F.count("*").cast("int").alias("shards"))
    n_blocks = asked.groupBy("dim").agg(F.count("*").cast("int").alias("blocks"))
    pairs = (
        shards.join(n_blocks, "dim")
        .select("dim", F.col("part").alias("shard"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("blob").alias("tree"))
        .join(
            asked.join(n_shards, "dim").select("dim", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.col("part").alias("block"), "blob", "shards"),
            ["dim", "shard", "block"],
        )
        .withColumn("home", F.col("shard") == F.pmod(F.col("block"), F.col("shards")))
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.itertuples():
                tree, q = Tree.unpack(row.tree), _unpack(row.blob)
                known = np.full(len(q["ids"]), -(1 << 63), np.int64)
                if row.known is not None:
                    kth = _unpack(row.known)
                    known = pd.Series(kth["kth"], kth["ids"]).groupby(level=0).max().reindex(q["ids"]).fillna(-(1 << 63)).to_numpy(np.int64)
                got = tree.search(q["ids"], q["x"], k, known)
                yield pd.DataFrame(got, columns=["query_id", "vec_id", "score"]).assign(dim=row.dim, block=row.block)

    found = "query_id long, vec_id long, score long, dim int, block int"
    home = put(pairs.where("home").select("dim", "block", "tree", "blob", F.lit(None).cast("binary").alias("known")).mapInPandas(run, found), "home")

    def bound(f: pd.DataFrame) -> pd.DataFrame:
        best = f.sort_values("score", ascending=False).groupby("query_id")["score"].nth(k - 1)
        ids = f.loc[best.index, "query_id"].to_numpy(np.int64)
        return pd.DataFrame({"dim": [f["dim"].iloc[0]], "block": [f["block"].iloc[0]], "known": [_pack(ids=ids, kth=best.to_numpy(np.int64))]})

    kth = home.groupBy("dim", "block").applyInPandas(bound, "dim int, block int, known binary")
    rest = pairs.where("not home").join(kth, ["dim", "block"], "left").select("dim", "shard", "block", "tree", "blob", "known")
    both = home.unionByName(rest.repartition("dim", "shard", "block").mapInPandas(run, found))
    # k is small: each task keeps its best k a query before the shuffle
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return both.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES = {"op10_exact_topk": op10_exact_topk}
ORACLE = {
    "op10_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
}
