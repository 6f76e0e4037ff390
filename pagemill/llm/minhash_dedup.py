"""MinHash near-duplicate detection: one-permutation hashing with optimal
densification, banded buckets and star-shaped candidate edges."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.shelf import components, drop, put, table
from pagemill.llm.shingles import U, mix, shingle_sets

#: 40 bands of 6 bins: a pair at similarity 0.85 shares no band with
#: probability (1 - 0.85**6)**40, about 6e-9.
BANDS, ROWS = 40, 6


def _donors(bins: int, tries: int = 64) -> np.ndarray:
    """For each try and bin the bin that an empty one asks (universal hash)."""
    i = np.arange(tries * bins, dtype=U)
    return ((mix(i * U(0x632BE59BD9B4E019) + U(7)) >> U(32)) * U(bins) >> U(32)).astype(np.int64).reshape(tries, bins)


_DONORS: dict[int, np.ndarray] = {}


def signature(s: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation signature of sorted distinct fingerprints: the least
    value of each of `bins` equal ranges; an empty bin takes the value of the
    first filled bin that its own hash sequence names (the least of all when
    64 tries name none, as can happen to sets of a few shingles)."""
    which = ((s >> U(32)) * U(bins) >> U(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(which, prepend=-1))
    sig, full = np.zeros(bins, U), np.zeros(bins, bool)
    sig[which[first]] = s[first]
    full[which[first]] = True
    if not full.all():
        donors = _DONORS.setdefault(bins, _donors(bins))
        empty = np.flatnonzero(~full)
        asked = donors[:, empty]
        ok = full[asked]
        hit = ok.argmax(axis=0)
        sig[empty] = np.where(ok.any(axis=0), sig[asked[hit, np.arange(len(empty))]], s[0])
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    m = mix(sig.reshape(bands, rows) * (np.arange(rows, dtype=U) * U(2) + U(0x9E3779B97F4A7C15)))
    return mix(m.sum(axis=1, dtype=U) + np.arange(bands, dtype=U)).astype(np.int64)


def pieces(texts: pa.Array, most: int = 1_000_000) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, UTF-8 texts) of runs of rows of bounded total bytes (one row
    at least); nulls are empty."""
    size = np.cumsum(np.concatenate([[0], pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)]))
    raw, at = texts.cast(pa.binary()), 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(size, size[at] + most, "right")) - 1)
        yield at, [t or b"" for t in raw[at:end].to_pylist()]
        at = end


def sketch(docs: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int) -> DataFrame:
    """(id, n_shingles, digest of the shingle set, band keys) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, texts in pieces(b.column(1)):
                sets = shingle_sets(texts, width)
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                keys = [band_keys(signature(s, bands * rows), bands, rows) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[lo : lo + len(sets)], pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["id", "n_shingles", "digest", "keys"],
                )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, "id long, n_shingles long, digest binary, keys array<long>"
    )


def verify(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Of pairs (a, b) those with 100 * intersection >= percent * union of
    their whole shingle sets. texts: (id, text), unique ids."""
    rows = (
        pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
        .join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        .select("a", "b", "text_a", "text_b")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_b, set_b = None, None
        for batch in batches:
            bs = batch.column(1).to_pylist()
            for lo, texts in pieces(batch.column(2)):
                hit = []
                for i, s in enumerate(shingle_sets(texts, width), lo):
                    if bs[i] != last_b:
                        last_b, set_b = bs[i], shingle_sets([(batch.column(3)[i].as_py() or "").encode()], width)[0]
                    both = int((set_b[np.minimum(np.searchsorted(set_b, s), len(set_b) - 1)] == s).sum()) if len(set_b) else 0
                    hit.append(100 * both >= percent * (len(s) + len(set_b) - both))
                n = len(hit)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo : lo + n], batch.column(1)[lo : lo + n], pa.array(hit, pa.bool_())], names=["a", "b", "linked"])

    return rows.mapInArrow(run, "a long, b long, linked boolean")


#: Most nodes of one tile of cross_links().
TILE = 256


def cross_links(stars: DataFrame, comp: DataFrame, sizes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between nodes of different components among nodes that
    shared buckets connect, enough of them to join the components.

    Nodes are dealt by bucket-connected group and size class (sets that link
    differ in size by the similarity at most, so by one class at most) into
    tiles of about TILE nodes; each pair of tiles of a group with classes at
    most one apart is one task, which multiplies the tiles' incidence matrices
    and returns a spanning forest of the links, never the pairs.
    """
    group = components(stars)
    base = (
        group.select(F.col("node"), F.col("component").alias("grp"))
        .join(sizes, "node")
        .join(comp, "node", "left")
        .select("node", "grp", F.coalesce("component", "node").alias("comp"), F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int").alias("cls"))
    )
    torn = base.groupBy("grp").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("grp")
    base = put(base.join(torn, "grp"), "torn")
    tiles = base.groupBy("grp", "cls").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    near = (
        base.join(tiles, ["grp", "cls"])
        .join(tiles.select("grp", (F.col("cls") - 1).alias("cls"), F.col("tiles").alias("above")), ["grp", "cls"], "left")
        .join(tiles.select("grp", (F.col("cls") + 1).alias("cls"), F.col("tiles").alias("below")), ["grp", "cls"], "left")
        .withColumn("t", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    )
    none = F.expr("cast(array() as array<struct<c:int,i:int,d:int,j:int>>)")
    own = F.expr("transform(sequence(0, tiles - 1), k -> struct(cls as c, least(t, k) as i, cls as d, greatest(t, k) as j))")
    up = F.when(F.col("above") > 0, F.expr("transform(sequence(0, above - 1), k -> struct(cls as c, t as i, cls + 1 as d, k as j))")).otherwise(none)
    down = F.when(F.col("below") > 0, F.expr("transform(sequence(0, below - 1), k -> struct(cls - 1 as c, k as i, cls as d, t as j))")).otherwise(none)
    rows = near.select("node", "grp", "comp", F.explode(F.concat(own, up, down)).alias("p")).join(texts.select(F.col("id").alias("node"), "text"), "node").select("node", "grp", "comp", "text", "p.*")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        comps = f["comp"].to_numpy()
        if (comps == comps[0]).all():
            return none
        nodes, sets = f["node"].to_numpy(), []
        for _, texts in pieces(pa.array(f["text"], pa.string())):
            sets += shingle_sets(texts, width)
        n = np.array([len(s) for s in sets], np.int64)
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
        word, at, df = np.unique(flat, return_inverse=True, return_counts=True)
        keep = df[at] > 1
        column = np.cumsum(df > 1) - 1
        row, col = owner[keep], column[at[keep]]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        both = np.zeros((len(sets), len(sets)), np.float32)
        step = 8192
        cuts = np.searchsorted(col, np.arange(0, int(col[-1]) + 1 + step, step)) if len(col) else [0]
        for k in range(len(cuts) - 1):
            m = np.zeros((len(sets), step), np.float32)
            m[row[cuts[k] : cuts[k + 1]], col[cuts[k] : cuts[k + 1]] - k * step] = 1
            both += m @ m.T
        both = both.astype(np.int64)
        link = 100 * both >= percent * (n[:, None] + n[None, :] - both)
        label = np.unique(comps, return_inverse=True)[1]
        out = []
        for i in range(len(sets)):
            for other in np.unique(label[link[i]]):
                if other != label[i]:
                    j = int(np.flatnonzero(link[i] & (label == other))[0])
                    out.append((max(nodes[i], nodes[j]), min(nodes[i], nodes[j])))
                    label[label == other] = label[i]
        return pd.DataFrame(out, columns=["a", "b"]) if out else none

    return rows.groupBy("grp", "c", "i", "d", "j").applyInPandas(run, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """Classes of near-duplicate documents.

    Documents link when 100 * |A & B| >= percent * |A | B| of their distinct
    width-word shingles. Returns (id_col, n_shingles, component_id, kept) per
    row: component_id is the smallest id that links reach.

    1. One Arrow pass makes each row's set digest and band keys. Rows with
       equal sets become one node, so copies never meet in a bucket.
    2. Bucket minima are pre-aggregated and joined back, giving one candidate
       edge from each node of a bucket to its least node: pair counts stay
       linear in bucket sizes.
    3. Edges are confirmed on whole sets and components are taken.
    4. cross_links() looks for links that the star shape missed between nodes
       that buckets connect but confirmed links don't.

    Null or blank texts have no shingles and link with nothing; null ids stay
    alone with component null, kept false; rows that share an id share its
    component. Extra columns are ignored.
    """
    sk = put(sketch(docs, id_col, text_col, width, bands, rows), "sketch")
    nodes = sk.where("digest is not null and id is not null").groupBy("digest").agg(F.min("id").alias("node"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"))
    keyed = put(nodes.select("node", "n", F.posexplode("keys").alias("band", "key")), "bands")
    least = keyed.groupBy("band", "key").agg(F.min("node").alias("b"), F.count("*").alias("c")).where("c > 1").drop("c")
    shared = put(keyed.join(least, ["band", "key"]), "buckets")
    stars = shared.where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    first_id = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    tested = put(verify(stars, first_id, width, percent), "tested")
    comp = put(components(tested.where("linked").select("a", "b")), "components")
    extra = put(cross_links(stars, comp, nodes.select("node", "n"), first_id, width, percent), "cross")
    if extra.limit(1).count():
        comp = put(components(tested.where("linked").select("a", "b").unionByName(extra)), "components")
    # written, so that the join below reads two plain shuffles: that of the rows
    # can then be split where one set has very many copies
    class_of = put(
        nodes.select("digest", "node")
        .join(comp, "node", "left")
        .select("digest", F.coalesce("component", "node").alias("component")),
        "classes",
    )
    for t in (keyed, shared, tested, extra):
        drop(t)
    return (
        sk.select("id", "n_shingles", "digest")
        .join(class_of, "digest", "left")
        .select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
    )


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that a document of smaller id stands for (five-word
    shingles, similarity 0.8). Rows of null id or without words stay; rows that
    share an id are one document and stay or go together."""
    gone = near_duplicates(docs).where(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


QUERIES = {"op7_minhash_dedup": op7_minhash_dedup}
ORACLE: dict[str, str] = {}
