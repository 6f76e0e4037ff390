"""Lexical and dense retrieval, fusion and reranking, for many queries at once.

Hits carry query_id, doc_id, rank and scores. Every ranking ends with a
tiebreak, so results don't depend on partitioning.
"""

from __future__ import annotations

from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.config import RetrievalConfig
from pagemill.functions.text import tokenize
from pagemill.operators import dealt, postings, vectors
from pagemill.operators.index import TermIndex, with_blocks, with_idf
from pagemill.sources import store


def metadata_filter(where: dict | None) -> Column | None:
    """A predicate of nested $and, $or and equality clauses ({"lang": "en"} or
    {"lang": {"$eq": "en"}}); values compare as strings, null counts as ""."""
    if not where:
        return None
    parts = []
    for key, value in where.items():
        if key in ("$and", "$or"):
            inner = [c for c in map(metadata_filter, value) if c is not None]
            if inner:
                parts.append(reduce(lambda a, b: a & b if key == "$and" else a | b, inner))
        else:
            want = value.get("$eq") if isinstance(value, dict) else value
            parts.append(F.coalesce(F.col(key).cast("string"), F.lit("")) == F.lit("" if want is None else str(want)))
    return reduce(lambda a, b: a & b, parts) if parts else None


def _ranked(df: DataFrame, k: int, *order: Column, by: str = "query_id") -> DataFrame:
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def query_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(tokenize(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def term_score(tf: Column, dl: Column, avgdl: Column, cfg: RetrievalConfig) -> Column:
    norm = 1 - cfg.b + cfg.b * F.greatest(dl, F.lit(1)) / F.when(avgdl > 0, avgdl).otherwise(1.0)
    return tf * (cfg.k1 + 1) / (tf + cfg.k1 * norm)


def score_terms(queries: DataFrame, index: TermIndex, cfg: RetrievalConfig | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score) of every document that has a query term."""
    cfg = cfg or RetrievalConfig()
    found = with_idf(query_terms(queries), index)
    if allowed is not None:
        found = found.join(allowed.select("doc_id"), "doc_id", "left_semi")
    return (
        found.crossJoin(F.broadcast(index.corpus.select("avgdl")))  # one-row side
        .groupBy("query_id", "doc_id")
        .agg(F.round(F.sum(F.col("qtf") * F.col("idf") * term_score(F.col("tf"), F.col("dl"), F.col("avgdl"), cfg)), 9).alias("score"))
    )


def bm25(queries: DataFrame, index: TermIndex, k: int, cfg: RetrievalConfig | None = None, allowed: DataFrame | None = None, only=None, match: list[tuple[str, str]] | None = None, attributes: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, rank, score): documents by summed term scores, query
    terms counted as often as they stand. An equi-join on terms, so documents
    without a query term are never touched; allowed (doc_id) filters before
    scoring, only (a function of the scored rows) before ranking. match pairs
    columns of queries with columns of attributes (doc_id, ...) that must agree
    where the query's is not null; where they are given they say the same as
    `only`, in a form that whoever scores a document can judge. Where the terms
    of the batch have more than cfg.plain_postings in an index of blocks,
    postings are dealt out by document; where that is 0, only those blocks are
    opened that can hold one of the first k, unless bounds leave most of them
    to open."""
    cfg = cfg or RetrievalConfig()
    if k <= 0:
        return score_terms(queries, index, cfg).withColumn("rank", F.lit(0)).limit(0)
    size = 0 if index.blocks is None else query_terms(queries).join(index.terms.select("term", "df"), "term").agg(F.sum("df")).first()[0] or 0
    by_match = match is not None and all(w in queries.columns for w, _ in match)
    if size > cfg.plain_postings and cfg.plain_postings > 0 and (only is None or by_match):
        scored = dealt_scores(query_terms(queries), index, k, cfg, allowed, queries, match, attributes) if by_match else dealt_scores(query_terms(queries), index, k, cfg, allowed)
    elif size > cfg.plain_postings:
        found = postings.search(query_terms(queries), index, term_score, k, cfg, restriction(allowed, only))
        by_blocks = only is not None or not found.loose()
        scored = found.scores() if by_blocks else dealt_scores(query_terms(queries), index, k, cfg, allowed)
    else:
        scored = score_terms(queries, index, cfg, allowed)
        scored = scored if only is None else only(scored)
    return _ranked(scored, k, F.desc("score"), F.col("doc_id"))


def dealt_scores(terms: DataFrame, index: TermIndex, k: int, cfg: RetrievalConfig, allowed: DataFrame | None = None, wants: DataFrame | None = None, match: list[tuple[str, str]] | None = None, attributes: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score) of at least the first k documents of terms
    (query_id, term, qtf), by postings dealt out by document."""
    stats = index.terms.select("term", "df", "idf")
    names = store.keep(terms.select("term").distinct().join(stats, "term").withColumn("tno", F.monotonically_increasing_id()), "numbered_terms")
    asked = terms.join(names.select("term", "idf"), "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("w"))
    size = names.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    found = with_blocks(names.select("term", "tno"), index).crossJoin(F.broadcast(index.corpus.select("avgdl")))  # one-row side
    found = found.select("tno", "doc_id", term_score(F.col("tf"), F.col("dl"), F.col("avgdl"), cfg).alias("v"))
    docs = attributes
    if allowed is not None:
        docs = allowed.select("doc_id") if attributes is None else attributes.join(allowed.select("doc_id"), "doc_id", "left_semi")
    if wants is not None and match:
        wants = wants.select("query_id", *[w for w, _ in match])
    return dealt.top(asked, names.select("term", "tno"), found, size, k, docs, wants if match else None, match)


def restriction(allowed: DataFrame | None, only):
    """One function of rows (query_id, doc_id, ...), or None."""
    if allowed is None and only is None:
        return None
    ids = None if allowed is None else allowed.select("doc_id")

    def keep(rows: DataFrame) -> DataFrame:
        rows = rows if ids is None else rows.join(ids, "doc_id", "left_semi")
        return rows if only is None else only(rows)

    return keep


def dense(query_vectors: DataFrame, rows: DataFrame | vectors.VectorIndex, k: int, allowed: DataFrame | None = None, match: list[tuple[str, str]] | None = None, attributes: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, rank, similarity): the rows of greatest inner product
    with each query, exactly, or within the cells that an inverted file probes.
    allowed (doc_id) restricts the rows; match pairs columns of query_vectors
    with columns of attributes (doc_id, ...) that must agree where the query's
    is not null."""
    if isinstance(rows, vectors.VectorIndex):
        return vectors.probed(query_vectors, rows, k, allowed, match, attributes)
    rows = rows if allowed is None else rows.join(allowed.select("doc_id"), "doc_id", "left_semi")
    return vectors.exact(query_vectors, rows if attributes is None else rows.join(attributes, "doc_id"), k, match)


def fuse(semantic: DataFrame, keyword: DataFrame, cfg: RetrievalConfig) -> DataFrame:
    """(query_id, doc_id, fused_rank, fused_score, similarity, keyword_score,
    sources). Reciprocal ranks, or scores scaled within each list (a constant
    list counts 1) weighed alpha to 1 - alpha; by score to six places, then
    first seen, the semantic list first."""
    s = semantic.select("query_id", "doc_id", "rank", F.col("similarity"), F.lit(None).cast("double").alias("keyword_score"), F.lit(0).alias("src"), F.col("similarity").alias("raw"))
    w = keyword.select("query_id", "doc_id", "rank", F.lit(None).cast("double").alias("similarity"), F.col("score").alias("keyword_score"), F.lit(1).alias("src"), F.col("score").alias("raw"))
    both = s.unionByName(w)
    if cfg.fusion == "rrf":
        part = 1.0 / (cfg.rrf_k + F.col("rank"))
    else:
        pool = Window.partitionBy("query_id", "src")
        lo, hi = F.min("raw").over(pool), F.max("raw").over(pool)
        scaled = F.when(hi - lo < 1e-12, 1.0).otherwise((F.col("raw") - lo) / F.nullif(hi - lo, F.lit(0.0)))
        part = F.when(F.col("src") == 0, F.lit(cfg.alpha)).otherwise(1.0 - cfg.alpha) * scaled
    fused = (
        both.withColumn("part", part)
        .groupBy("query_id", "doc_id")
        .agg(
            F.round(F.sum("part"), 6).alias("fused_score"),
            F.max("similarity").alias("similarity"),
            F.max("keyword_score").alias("keyword_score"),
            F.min(F.struct("src", "rank")).alias("seen"),
            F.array_sort(F.collect_set(F.when(F.col("src") == 0, "semantic").otherwise("keyword"))).alias("sources"),
        )
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("fused_score"), "seen", "doc_id")
    return fused.withColumn("fused_rank", F.row_number().over(order)).drop("seen")


def first_of_each(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keeps of rows with equal keys the first by order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def lexical_rerank(queries: DataFrame, pool: DataFrame, docs: DataFrame, index: TermIndex | None, k: int, cfg: RetrievalConfig) -> DataFrame:
    """pool reordered by a blend of lexical score, similarity and term coverage,
    each scaled within its query (a constant one counts 0). A known keyword
    score is the lexical one; others are computed over distinct query terms:
    with the index's idf and mean length, or, without one, with idf 1 and the
    pool's mean length (an empty text counts 1)."""
    terms = query_terms(queries).select("query_id", "term")
    n_terms = terms.groupBy("query_id").agg(F.count("*").alias("n_terms"))
    if index is not None:
        own = with_idf(terms, index).crossJoin(F.broadcast(index.corpus.select("avgdl"))).join(pool.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")
    else:
        toks = pool.select("query_id", "doc_id").join(docs.select("doc_id", tokenize(F.col("text")).alias("toks")), "doc_id").withColumn("dl", F.size("toks"))
        toks = toks.withColumn("avgdl", F.avg(F.greatest("dl", F.lit(1))).over(Window.partitionBy("query_id")))
        own = toks.select("query_id", "doc_id", "dl", "avgdl", F.explode("toks").alias("term")).join(terms, ["query_id", "term"], "left_semi").groupBy("query_id", "doc_id", "term").agg(F.count("*").alias("tf"), F.max("dl").alias("dl"), F.max("avgdl").alias("avgdl")).withColumn("idf", F.lit(1.0))
    found = own.groupBy("query_id", "doc_id").agg(F.sum(F.col("idf") * term_score(F.col("tf"), F.col("dl"), F.col("avgdl"), cfg)).alias("lex"), F.count("*").alias("seen_terms"))
    rows = (
        pool.join(found, ["query_id", "doc_id"], "left")
        .join(n_terms, "query_id", "left")
        .withColumn("lex", F.coalesce("keyword_score", F.round("lex", 9), F.lit(0.0)))
        .withColumn("sem", F.coalesce("similarity", F.lit(0.0)))
        .withColumn("cov", F.coalesce(F.try_divide(F.col("seen_terms").cast("double"), F.col("n_terms").cast("double")), F.lit(0.0)))
    )
    w = Window.partitionBy("query_id")
    for c in ("lex", "sem", "cov"):
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        rows = rows.withColumn(f"{c}_n", F.when(hi - lo < 1e-12, 0.0).otherwise((F.col(c) - lo) / F.nullif(hi - lo, F.lit(0.0))))
    blend = cfg.lexical_weight * F.col("lex_n") + cfg.semantic_weight * F.col("sem_n") + cfg.coverage_weight * F.col("cov_n")
    rows = rows.withColumn("rerank_score", F.round(blend, 6)).withColumn("_s", F.round(blend, 9))
    return _ranked(rows, k, F.desc("_s"), F.col("fused_rank")).select("query_id", "doc_id", "rank", "rerank_score", "fused_score", "fused_rank", "similarity", "keyword_score")


class Reranker(Protocol):
    """What a reranking model offers: hits to hits, with rerank_score."""

    name: str

    def rerank(self, queries: DataFrame, pool: DataFrame, k: int) -> DataFrame: ...


class PairReranker:
    """Reranks by a model that scores (query, text) pairs, given as a pandas
    UDF's function of two string Series to one of doubles."""

    def __init__(self, name: str, score, docs: DataFrame):
        self.name, self.score, self.docs = name, F.pandas_udf(score, "double"), docs

    def rerank(self, queries: DataFrame, pool: DataFrame, k: int) -> DataFrame:
        rows = pool.join(queries, "query_id").join(self.docs.select("doc_id", "text"), "doc_id")
        rows = rows.withColumn("rerank_score", self.score("query", "text")).drop("query", "text")
        return _ranked(rows, k, F.desc("rerank_score"), F.col("fused_rank"))


class LexicalReranker:
    name = "lexical"

    def __init__(self, index: TermIndex | None, docs: DataFrame, cfg: RetrievalConfig | None = None):
        self.index, self.docs, self.cfg = index, docs, cfg or RetrievalConfig()

    def rerank(self, queries: DataFrame, pool: DataFrame, k: int) -> DataFrame:
        return lexical_rerank(queries, pool, self.docs, self.index, k, self.cfg)


def build_reranker(kind: str, index: TermIndex | None, docs: DataFrame, cfg: RetrievalConfig | None = None, load=None) -> Reranker | None:
    """none or off; lexical (also fallback, bm25); cross-encoder, which falls
    back to lexical where load() can't give a pair scorer."""
    kind = (kind or "none").lower()
    if kind in ("none", "off"):
        return None
    if kind in ("lexical", "fallback", "bm25"):
        return LexicalReranker(index, docs, cfg)
    if kind == "cross-encoder":
        try:
            return PairReranker("cross-encoder", load(), docs)
        except Exception:
            return LexicalReranker(index, docs, cfg)
    raise ValueError(f"unknown reranker: {kind}")


def hybrid(queries: DataFrame, query_vectors: DataFrame | None, index: TermIndex, rows: DataFrame | vectors.VectorIndex | None, cfg: RetrievalConfig, k: int | None = None, reranker: Reranker | None = None, allowed: DataFrame | None = None, only=None, match: list[tuple[str, str]] | None = None, attributes: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, rank, ...): the mode's lists over a candidate pool,
    fused, optionally reranked, cut to k. A mode whose index is missing adds
    an empty list. What restricts hits is `only` for the lexical list (or
    match, where queries have its columns) and match (see dense()) for the
    other."""
    k = k or cfg.default_k
    pool = max(cfg.candidate_k, k)
    kind = dict((index.postings if index is not None else getattr(rows, "rows", rows)).dtypes)["doc_id"]
    empty = queries.select("query_id", F.lit(None).cast(kind).alias("doc_id"), F.lit(None).cast("int").alias("rank")).limit(0)
    sem = dense(query_vectors, rows, pool, allowed, match, attributes) if cfg.mode != "keyword" and rows is not None and query_vectors is not None else empty.withColumn("similarity", F.lit(None).cast("double"))
    key = bm25(queries, index, pool, cfg, allowed, only, match, attributes) if cfg.mode != "semantic" and index is not None else empty.withColumn("score", F.lit(None).cast("double"))
    return ranked(queries, sem, key, cfg, k, reranker)


def ranked(queries: DataFrame, semantic: DataFrame, keyword: DataFrame, cfg: RetrievalConfig, k: int, reranker: Reranker | None = None) -> DataFrame:
    """hybrid()'s fusion, reranking and cut of two candidate lists; the mode
    says which of them counts."""
    pool = max(cfg.candidate_k, k)
    if cfg.mode == "keyword":
        semantic = semantic.limit(0)
    if cfg.mode == "semantic":
        keyword = keyword.limit(0)
    fused = fuse(semantic, keyword, cfg).where(F.col("fused_rank") <= pool)
    if reranker is not None:
        return reranker.rerank(queries, fused, k)
    return fused.where(F.col("fused_rank") <= k).withColumn("rank", F.col("fused_rank"))
