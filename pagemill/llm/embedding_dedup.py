"""Near-duplicate embeddings by quantised tile products with error bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.shelf import components, put, table
from pagemill.llm.topk import _pack, _unpack, valid

#: Tiles that vectors are dealt into until a tile would pass so many rows or
#: bytes; rows of a tile multiplied at once.
TILES, TILE_ROWS, TILE_BYTES, STRIP_ROWS = 8, 65_536, 16_000_000, 256


def quantise(x: np.ndarray) -> dict[str, np.ndarray]:
    """Rows as int8 of their unit vectors: q, scale, the norm of scale * q and
    the norm of what rounding left out, so that for rows a and b
    |cos(a, b) - scale_a * scale_b * q_a.q_b| <= m_a * e_b + e_a * m_b + e_a * e_b."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    u = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    scale = np.abs(u).max(axis=1) / 127
    q = np.rint(u / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return {"q": q, "scale": scale, "m": np.sqrt((back * back).sum(axis=1)), "e": np.sqrt(((u - back) ** 2).sum(axis=1)) + 1e-12}


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    a = a / np.abs(a).max(axis=1, keepdims=True)
    b = b / np.abs(b).max(axis=1, keepdims=True)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def link_tiles(a: dict, b: dict, same: bool, least: float) -> pd.DataFrame:
    """Of two tiles: per row that links, (id, how many vectors of the other
    tile it links to, the least id that links reach within the two)."""
    na, nb = len(a["ids"]), len(b["ids"])
    ids = a["ids"] if same else np.concatenate([a["ids"], b["ids"]])
    label = np.arange(len(ids))
    count = np.zeros(len(ids), np.int64)
    shift = 0 if same else na
    exact = np.float32 if a["q"].shape[1] * 127 * 127 < 2**24 else np.float64
    qb = b["q"].astype(exact).T
    sb, mb, eb = (b[k].astype(np.float32) for k in ("scale", "m", "e"))
    for lo in range(0, na, STRIP_ROWS):
        hi = min(na, lo + STRIP_ROWS)
        sa, ma, ea = (a[k][lo:hi, None].astype(np.float32) for k in ("scale", "m", "e"))
        near = (a["q"][lo:hi].astype(exact) @ qb).astype(np.float32) * sa * sb
        slack = ma * eb + ea * (mb + eb) + np.float32(1e-5)  # the last: rounding of this line and the one above
        r, c = np.nonzero(near + slack >= least)
        sure = near[r, c] - slack[r, c] >= least
        for at in range(0, len(r), 100_000):
            part = np.flatnonzero(~sure[at : at + 100_000]) + at
            if len(part):
                sure[part] = cosines(a["x"][lo + r[part]], b["x"][c[part]]) >= least
        r, c = r[sure] + lo, c[sure]
        if same:
            r, c = r[r != c], c[r != c]
        np.add.at(count, r, b["w"][c])
        if not same:
            np.add.at(count, shift + c, a["w"][r])
        cuts = np.flatnonzero(np.diff(r, prepend=-1))
        for k, i in enumerate(cuts):
            row, cols = r[i], shift + c[i : cuts[k + 1] if k + 1 < len(cuts) else len(r)]
            seen = np.unique(np.append(label[cols], label[row]))
            if len(seen) > 1:
                label[np.isin(label, seen)] = seen[0]
    least_id = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least_id, label, ids)
    has = count > 0
    return pd.DataFrame({"id": ids[has], "n": count[has], "root": least_id[label][has]})


def near_vectors(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id_col, n_links, component_id, kept) per row: how many other vectors
    have cosine >= least, the smallest id that links reach, whether it is it.

    Equal vectors are one node that weighs as many as they are, so a group of
    copies never meets itself. Nodes are dealt by hash into TILES tiles, more
    only where one would pass TILE_ROWS or TILE_BYTES, as each vector is sent once a tile;
    each pair of tiles is one task, which quantises them, decides almost all
    pairs from int8 products and their bounds, the rest in double precision,
    and returns counts and a least reachable id a row, never pairs.

    Null, empty and zero vectors and those with null or non-finite components
    link with nothing (component their own id). Vectors of different length
    don't meet. Repeated rows are vectors of their own (an id that stands for
    different vectors joins their components). Null ids link with
    nothing, component null, kept false. Extra columns are ignored.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("x"))
    able = rows.where(valid("x") & F.col("id").isNotNull()).where(F.exists("x", lambda v: v != 0))
    nodes = put(able.groupBy("x").agg(F.min("id").alias("id"), F.count("*").alias("w")), "nodes")
    sized = nodes.withColumn("dim", F.size("x"))
    parts = sized.groupBy("dim").agg(F.greatest(F.least(F.lit(TILES), F.count("*")), F.ceil(F.count("*") / TILE_ROWS), F.ceil(F.count("*") * F.col("dim") * 4 / TILE_BYTES)).cast("int").alias("parts"))

    def tile(f: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(f["x"].to_numpy())
        blob = _pack(ids=f["id"].to_numpy(np.int64), w=f["w"].to_numpy(np.int64), x=x)
        return pd.DataFrame({"dim": [f["dim"].iloc[0]], "parts": [f["parts"].iloc[0]], "part": [f["part"].iloc[0]], "blob": [blob]})

    dealt = sized.join(parts, "dim").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    tiles = put(dealt.groupBy("dim", "parts", "part").applyInPandas(tile, "dim int, parts int, part int, blob binary"), "tiles")
    first = tiles.select("dim", F.col("part").alias("i"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("j"), F.col("blob").alias("a"))
    second = tiles.select("dim", F.explode(F.sequence(F.lit(0), "part")).alias("i"), F.col("part").alias("j"), F.col("blob").alias("b"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for t in f.itertuples():
                a, b = _unpack(t.a), _unpack(t.b)
                yield link_tiles(a | quantise(a["x"]), b | quantise(b["x"]), t.i == t.j, least)

    pairs = first.join(second, ["dim", "i", "j"]).repartition("dim", "i", "j")
    links = put(pairs.mapInPandas(run, "id long, n long, root long"), "links")
    comp = components(links.select(F.col("id").alias("a"), F.col("root").alias("b")))
    of = (
        nodes.select(F.col("x").alias("nx"), F.col("id").alias("node"), "w")
        .join(links.groupBy(F.col("id").alias("node")).agg(F.sum("n").alias("n")), "node", "left")
        .join(comp, "node", "left")
        .select("nx", F.coalesce("component", "node").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n"))
    )
    out = rows.join(of, (F.col("x") == F.col("nx")) & F.col("id").isNotNull(), "left")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(False)).alias("kept"),
    )


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op1_embedding_dedup": op1_embedding_dedup}
ORACLE = {
    "op1_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e LEFT JOIN c ON e.vec_id = c.a LEFT JOIN n ON e.vec_id = n.a
"""
}
