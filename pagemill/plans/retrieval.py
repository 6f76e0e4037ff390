"""Queries over term statistics, retrieval, fusion, reranking and metrics."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.config import RetrievalConfig
from pagemill.functions.text import RETRIEVAL_STOPWORDS, tokenize
from pagemill.operators import evaluate as E
from pagemill.operators import index as I
from pagemill.operators import postings as PO
from pagemill.operators import retrieve as R
from pagemill.operators import vectors as V
from pagemill.plans import tables as T
from pagemill.sources import store
from pagemill.streaming import segments as S

CFG = RetrievalConfig()
POOL, K = CFG.candidate_k, CFG.default_k
SW = "[" + ", ".join(f"'{w}'" for w in RETRIEVAL_STOPWORDS) + "]"


def tok(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9]+'), lambda x: length(x) > 1 AND NOT list_contains({SW}, x))"


INDEX_SQL = f"""
toks AS (SELECT doc_id, {tok('text')} AS toks FROM documents),
post AS (SELECT doc_id, term, count(*) AS tf, max(dl) AS dl FROM (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM toks) GROUP BY doc_id, term),
cs AS (SELECT count(*) AS n_docs, CAST(sum(len(toks)) AS BIGINT) AS total_terms, CAST(sum(len(toks)) AS DOUBLE) / count(*) AS avgdl FROM toks),
ts AS (SELECT term, count(*) AS df, ln(1 + ((SELECT n_docs FROM cs) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post GROUP BY term),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({tok('text')}) AS term FROM benchmark) GROUP BY query_id, term)"""
NORM = "tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * greatest(dl, 1) / avgdl))"


def bm_sql(k: int, where: str = "") -> str:
    keep = f"WHERE doc_id IN (SELECT doc_id FROM documents WHERE {where})" if where else ""
    return f"""
kws AS (SELECT query_id, doc_id, round(sum(qtf * idf * {NORM}), 9) AS score
        FROM qt JOIN ts USING (term) JOIN post USING (term), cs {keep} GROUP BY query_id, doc_id),
kw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM kws) WHERE rank <= {k})"""


def sem_sql(k: int) -> str:
    return f"""
sims AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id,
  round(list_dot_product(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(v.embedding, lambda x: CAST(x AS DOUBLE))), 9) AS similarity
  FROM embeddings v, embeddings q WHERE q.vec_id IN (SELECT item_id FROM benchmark)),
sem AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS rank FROM sims) WHERE rank <= {k})"""


def fuse_sql(kind: str) -> str:
    part = (
        "1.0::DOUBLE / (60 + rank)"
        if kind == "rrf"
        else "(CASE WHEN src = 0 THEN 0.5 ELSE 0.5 END) * (CASE WHEN hi - lo < 1e-12 THEN 1.0 ELSE (raw - lo) / (hi - lo) END)"
    )
    return f"""
pool AS (SELECT *, min(raw) OVER (PARTITION BY query_id, src) AS lo, max(raw) OVER (PARTITION BY query_id, src) AS hi FROM (
  SELECT query_id, doc_id, rank, similarity, NULL::DOUBLE AS keyword_score, 0 AS src, similarity AS raw FROM sem
  UNION ALL SELECT query_id, doc_id, rank, NULL, score, 1, score FROM kw)),
fused AS (SELECT query_id, doc_id, round(sum({part}), 6) AS fused_score, max(similarity) AS similarity, max(keyword_score) AS keyword_score, min(src * 1000 + rank) AS seen FROM pool GROUP BY query_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, seen, doc_id) AS fused_rank FROM fused)"""


RERANK_SQL = f"""
cand AS (SELECT * FROM ranked WHERE fused_rank <= {POOL}),
nt AS (SELECT query_id, count(*) AS n_terms FROM qt GROUP BY query_id),
lx AS (SELECT query_id, doc_id, round(sum(idf * {NORM}), 9) AS lex FROM cand JOIN post USING (doc_id) JOIN qt USING (query_id, term) JOIN ts USING (term), cs GROUP BY query_id, doc_id),
feat AS (SELECT cand.*, coalesce(keyword_score, lex, 0.0) AS l, coalesce(similarity, 0.0) AS s FROM cand LEFT JOIN lx USING (query_id, doc_id)),
nrm AS (SELECT *, min(l) OVER w AS ll, max(l) OVER w AS lh, min(s) OVER w AS sl, max(s) OVER w AS sh FROM feat WINDOW w AS (PARTITION BY query_id)),
rr AS (SELECT query_id, doc_id, fused_rank, 0.2 * (CASE WHEN lh - ll < 1e-12 THEN 0.0 ELSE (l - ll) / (lh - ll) END) + 0.8 * (CASE WHEN sh - sl < 1e-12 THEN 0.0 ELSE (s - sl) / (sh - sl) END) AS sc FROM nrm),
rer AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sc, 9) DESC, fused_rank) AS rank FROM rr)"""
QRELS_SQL = "qrels AS (SELECT item_id AS query_id, doc_id FROM documents d JOIN benchmark b ON length(b.text) > 0 AND contains(d.text, b.text))"


def metrics_sql(hits: str, name: str) -> str:
    return f"""
{name}_f AS (SELECT h.query_id, h.rank, CASE WHEN r.doc_id IS NULL THEN 0 ELSE 1 END AS rel FROM {hits} h LEFT JOIN qrels r ON h.query_id = r.query_id AND h.doc_id = r.doc_id WHERE h.rank <= {K}),
{name}_c AS (SELECT *, sum(rel) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS cum FROM {name}_f),
{name}_p AS (SELECT query_id, count(*) AS n, sum(rel) AS found, sum(rel / log2(rank + 1.0)) AS dcg, min(CASE WHEN rel = 1 THEN rank END) AS first, sum(rel * cum / CAST(rank AS DOUBLE)) AS ap FROM {name}_c GROUP BY query_id),
{name}_r AS (SELECT query_id, count(*) AS n_relevant FROM qrels GROUP BY query_id),
{name} AS (SELECT b.item_id AS query_id, coalesce(n_relevant, 0) AS n_relevant,
  CASE WHEN n_relevant > 0 THEN coalesce(CAST(found AS DOUBLE) / n, 0.0) ELSE 0.0 END AS precision,
  CASE WHEN n_relevant > 0 THEN coalesce(CAST(found AS DOUBLE) / n_relevant, 0.0) ELSE 0.0 END AS recall,
  CASE WHEN found > 0 THEN 1.0 ELSE 0.0 END AS hit,
  round(CASE WHEN n_relevant > 0 THEN coalesce(dcg / list_sum(list_transform(range(1, least(n_relevant, {K}) + 1), lambda i: 1 / log2(i + 1.0))), 0.0) ELSE 0.0 END, 6) AS ndcg,
  coalesce(1.0 / first, 0.0)::DOUBLE AS mrr,
  round(CASE WHEN n_relevant > 0 THEN coalesce(ap / n_relevant, 0.0) ELSE 0.0 END, 6) AS map
  FROM benchmark b LEFT JOIN {name}_r r ON b.item_id = r.query_id LEFT JOIN {name}_p p ON b.item_id = p.query_id)"""


MEANS = ", ".join(f"round(avg({m}), 4) AS {m}" for m in E.METRICS)


def _index(spark: SparkSession, sf: str) -> I.TermIndex:
    """The documents' index: written when first asked for, read from then on."""

    def build() -> str:
        path = store.fresh_path(spark, "index")
        I.write_index(T.documents(spark, sf), path)
        return path

    return I.read_index(spark, store.once(spark, ("index", sf), build))


def _kept(spark: SparkSession, sf: str, label: str, make) -> DataFrame:
    """A small result that several queries start from, written once."""
    return store.once(spark, (label, sf), lambda: store.keep(make(), label))


def _lists(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The pools of the dense and of the lexical retriever."""
    sem = _kept(spark, sf, "semantic", lambda: R.dense(T.query_vectors(spark, sf), T.vectors(spark, sf), POOL))
    key = _kept(spark, sf, "keyword", lambda: R.bm25(T.queries(spark, sf), _index(spark, sf), POOL, CFG))
    return sem, key


def _qrels(spark: SparkSession, sf: str) -> DataFrame:
    return _kept(spark, sf, "qrels", lambda: T.qrels(spark, sf))


def tokenize_stats(spark: SparkSession, sf: str) -> DataFrame:
    toks = T.documents(spark, sf).select("doc_id", tokenize(F.col("text")).alias("t"))
    return toks.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


def term_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _index(spark, sf).terms.select("term", "df", F.round("idf", 9).alias("idf"))


def segment_terms(spark: SparkSession, sf: str) -> DataFrame:
    """term_stats of an index that came by batches: all documents in a former
    state, then those of even ids as they are now, then the others."""
    d = T.documents(spark, sf).select(F.col("doc_id").alias("chunk_id"), "text")
    base = store.fresh_path(spark, "segments")
    former = d.withColumn("text", F.concat(F.lit("superseded "), F.coalesce("text", F.lit(""))))
    for n, batch in enumerate((former, d.where("chunk_id % 2 = 0"), d.where("chunk_id % 2 <> 0"))):
        S.add(spark, base, batch, "batches", n)
    return S.read(spark, base).terms.select("term", "df", F.round("idf", 9).alias("idf"))


def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    i = _index(spark, sf)
    return i.corpus.select("n_docs", "total_terms").crossJoin(F.broadcast(i.terms.agg(F.count("*").alias("unique_terms"))))


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return R.bm25(T.queries(spark, sf), _index(spark, sf), K, CFG).select("query_id", F.col("rank").cast("long"), "doc_id", F.round("score", 6).alias("score"))


def bm25_block_max(spark: SparkSession, sf: str) -> DataFrame:
    """bm25_topk by the search that opens blocks in rounds."""
    return R.bm25(T.queries(spark, sf), _index(spark, sf), K, replace(CFG, plain_postings=0)).select("query_id", F.col("rank").cast("long"), "doc_id", F.round("score", 6).alias("score"))


def bm25_rows_opened(spark: SparkSession, sf: str) -> DataFrame:
    """How many postings the terms of each query have, and how many of them a
    search for its first five documents opens."""
    i = _index(spark, sf)
    return PO.search(R.query_terms(T.queries(spark, sf)), i, R.term_score, K, CFG).opened()


def block_heads(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks added up by term, their frontiers' corners by value."""
    b = _index(spark, sf).blocks
    return b.groupBy("term").agg(F.sum("n").cast("long").alias("df"), F.sum("tokens").alias("tokens"), F.max(F.get("frontier", 0)["tf"]).alias("most"), F.min(F.element_at("frontier", -1)["dl"]).alias("shortest"))


def bm25_filtered(spark: SparkSession, sf: str) -> DataFrame:
    allowed = T.documents(spark, sf).where(R.metadata_filter({"$and": [{"lang": {"$eq": "en"}}, {"$or": [{"source": "src1"}, {"source": "src2"}, {"source": "src3"}]}]}))
    return R.bm25(T.queries(spark, sf), _index(spark, sf), K, CFG, allowed).select("query_id", F.col("rank").cast("long"), "doc_id", F.round("score", 6).alias("score"))


def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    return R.dense(T.query_vectors(spark, sf), T.vectors(spark, sf), K).select("query_id", F.col("rank").cast("long"), "doc_id", F.round("similarity", 6).alias("similarity"))


def _ivf(spark: SparkSession, sf: str) -> V.VectorIndex:
    """The vectors' inverted file, written when first asked for."""

    def build() -> str:
        path = store.fresh_path(spark, "ivf")
        V.write_ivf(T.vectors(spark, sf), path, k=K)
        return path

    return V.read_ivf(spark, store.once(spark, ("ivf", sf), build))


def dense_ivf(spark: SparkSession, sf: str) -> DataFrame:
    """The dense search within the cells that the inverted file probes."""
    return R.dense(T.query_vectors(spark, sf), _ivf(spark, sf), K).select("query_id", F.col("rank").cast("long"), "doc_id", F.round("similarity", 6).alias("similarity"))


def ivf_recall(spark: SparkSession, sf: str) -> DataFrame:
    """How many of the exact first five the inverted file has; whether that is
    nine tenths of them, and every one of its scores exact."""
    q = T.query_vectors(spark, sf)
    want = R.dense(q, T.vectors(spark, sf), K).select("query_id", "doc_id", F.col("similarity").alias("exact"))
    both = want.join(R.dense(q, _ivf(spark, sf), K).select("query_id", "doc_id", "similarity"), ["query_id", "doc_id"], "left")
    return both.agg(F.count_distinct("query_id").alias("n_queries"), F.count("*").alias("n_exact"), (F.count("similarity") >= 0.9 * F.count("*")).alias("enough"), F.coalesce(F.every(F.abs(F.col("similarity") - F.col("exact")) < 1e-6), F.lit(True)).alias("scores_agree"))


def _hits(spark: SparkSession, sf: str, **kw) -> DataFrame:
    cfg, index = replace(CFG, **kw), _index(spark, sf)
    rr = R.build_reranker(cfg.rerank, index, T.documents(spark, sf), cfg)
    return R.ranked(T.queries(spark, sf), *_lists(spark, sf), cfg, K, rr)


def hybrid_rrf(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(spark, sf).select("query_id", F.col("rank").cast("long"), "doc_id", "fused_score", F.array_join("sources", "+").alias("sources"))


def hybrid_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(spark, sf, fusion="weighted").select("query_id", F.col("rank").cast("long"), "doc_id", "fused_score")


def rerank_without_index(spark: SparkSession, sf: str) -> DataFrame:
    """The semantic list reranked by a scorer that knows no corpus."""
    return _hits(spark, sf, mode="semantic", rerank="none").transform(lambda h: R.lexical_rerank(T.queries(spark, sf), h, T.documents(spark, sf), None, K, replace(CFG, lexical_weight=0.5, semantic_weight=0.3, coverage_weight=0.2))).select("query_id", F.col("rank").cast("long"), "doc_id", "rerank_score")


def index_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Postings as they are read back: per document its terms and length."""
    return _index(spark, sf).postings.groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.sum("tf").alias("n_tokens"), F.max("dl").cast("long").alias("dl"))


def rerank_lexical(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(spark, sf, rerank="lexical").select("query_id", F.col("rank").cast("long"), "doc_id", "rerank_score")


def _metrics(spark: SparkSession, sf: str, **kw) -> DataFrame:
    return E.retrieval_metrics(_hits(spark, sf, **kw), _qrels(spark, sf), T.queries(spark, sf), K)


def retrieval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _metrics(spark, sf)


def retrieval_macro(spark: SparkSession, sf: str) -> DataFrame:
    return E.macro(_metrics(spark, sf))


def retrieval_by_category(spark: SparkSession, sf: str) -> DataFrame:
    cat = T.queries(spark, sf).select("query_id", F.when(F.length("query") > 300, "long").otherwise("short").alias("category"))
    return E.macro(_metrics(spark, sf, mode="keyword").join(cat, "query_id"), ["category"])


def missed_relevant(spark: SparkSession, sf: str) -> DataFrame:
    return E.missed(_hits(spark, sf), _qrels(spark, sf), K)


def mode_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return E.compare_modes({m: _metrics(spark, sf, mode=m) for m in ("semantic", "keyword", "hybrid")}, "semantic")


def ablation_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Macro metrics of the default and of five overlays."""
    overlays = {"default": {}, "keyword_only": {"mode": "keyword"}, "semantic_only": {"mode": "semantic"}, "weighted": {"fusion": "weighted"}, "lexical_rerank": {"rerank": "lexical"}}
    return E.ablation(overlays, lambda o: E.macro(_metrics(spark, sf, **o)))


QUERIES = {f.__name__: f for f in (tokenize_stats, term_stats, segment_terms, corpus_stats, bm25_topk, bm25_block_max, bm25_rows_opened, block_heads, bm25_filtered, dense_topk, dense_ivf, ivf_recall, hybrid_rrf, hybrid_weighted, rerank_lexical, rerank_without_index, index_round_trip, retrieval_metrics, retrieval_macro, retrieval_by_category, missed_relevant, mode_comparison, ablation_grid)}
_W = f"WITH {INDEX_SQL}"
_ALL = f"{_W}, {bm_sql(POOL)}, {sem_sql(POOL)}, "
_HY = f"{_ALL} {fuse_sql('rrf')}, hy AS (SELECT query_id, doc_id, fused_rank AS rank FROM ranked WHERE fused_rank <= {K}), {QRELS_SQL}, {metrics_sql('hy', 'mh')}"
_MODES = f"{_HY}, ks AS (SELECT query_id, doc_id, rank FROM kw), ss AS (SELECT query_id, doc_id, rank FROM sem), {metrics_sql('ks', 'mk')}, {metrics_sql('ss', 'ms')}"


def _macro_of(m: str) -> str:
    return f"(SELECT count(*) AS n_queries, {MEANS} FROM {m} WHERE n_relevant > 0)"


ORACLE = {
    "tokenize_stats": f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, {tok('text')} AS t FROM documents)",
    "term_stats": f"{_W} SELECT term, df, round(idf, 9) AS idf FROM ts",
    "segment_terms": f"{_W} SELECT term, df, round(idf, 9) AS idf FROM ts",
    "corpus_stats": f"{_W} SELECT n_docs, total_terms, (SELECT count(*) FROM ts) AS unique_terms FROM cs",
    "bm25_topk": f"{_W}, {bm_sql(K)} SELECT query_id, rank, doc_id, round(score, 6) AS score FROM kw",
    "bm25_block_max": f"{_W}, {bm_sql(K)} SELECT query_id, rank, doc_id, round(score, 6) AS score FROM kw",
    "block_heads": f"{_W} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tokens, CAST(max(tf) AS BIGINT) AS most, CAST(min(dl) AS BIGINT) AS shortest FROM post GROUP BY term",
    "bm25_filtered": f"{_W}, " + bm_sql(K, "lang = 'en' AND source IN ('src1', 'src2', 'src3')") + " SELECT query_id, rank, doc_id, round(score, 6) AS score FROM kw",
    "dense_topk": f"WITH {sem_sql(K)} SELECT query_id, rank, doc_id, round(similarity, 6) AS similarity FROM sem",
    "ivf_recall": f"WITH {sem_sql(K)} SELECT count(DISTINCT query_id) AS n_queries, count(*) AS n_exact, true AS enough, true AS scores_agree FROM sem",
    "hybrid_rrf": f"{_ALL} {fuse_sql('rrf')} SELECT query_id, fused_rank AS rank, doc_id, fused_score, CASE WHEN similarity IS NULL THEN 'keyword' WHEN keyword_score IS NULL THEN 'semantic' ELSE 'keyword+semantic' END AS sources FROM ranked WHERE fused_rank <= {K}",
    "hybrid_weighted": f"{_ALL} {fuse_sql('weighted')} SELECT query_id, fused_rank AS rank, doc_id, fused_score FROM ranked WHERE fused_rank <= {K}",
    "rerank_lexical": f"{_ALL} {fuse_sql('rrf')}, {RERANK_SQL} SELECT query_id, rank, doc_id, round(sc, 6) AS rerank_score FROM rer WHERE rank <= {K}",
    "rerank_without_index": f"""{_ALL} {fuse_sql('rrf')}, s5 AS (SELECT query_id, doc_id, rank AS fused_rank, similarity FROM sem WHERE rank <= {K}),
dls AS (SELECT s5.*, len(toks) AS dl0, avg(greatest(len(toks), 1)) OVER (PARTITION BY query_id) AS avg0 FROM s5 JOIN toks USING (doc_id)),
lx1 AS (SELECT query_id, doc_id, sum(tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * greatest(dl0, 1) / avg0))) AS lex, count(*) AS seen FROM dls JOIN post USING (doc_id) JOIN qt USING (query_id, term) GROUP BY query_id, doc_id),
nt1 AS (SELECT query_id, count(*) AS n_terms FROM qt GROUP BY query_id),
f1 AS (SELECT s5.*, coalesce(round(lex, 9), 0.0) AS l, coalesce(similarity, 0.0) AS s, coalesce(CAST(seen AS DOUBLE) / n_terms, 0.0) AS c FROM s5 LEFT JOIN lx1 USING (query_id, doc_id) LEFT JOIN nt1 USING (query_id)),
g1 AS (SELECT *, min(l) OVER w AS ll, max(l) OVER w AS lh, min(s) OVER w AS sl, max(s) OVER w AS sh, min(c) OVER w AS cl, max(c) OVER w AS ch FROM f1 WINDOW w AS (PARTITION BY query_id)),
h1 AS (SELECT *, 0.5 * (CASE WHEN lh - ll < 1e-12 THEN 0.0 ELSE (l - ll) / (lh - ll) END) + 0.3 * (CASE WHEN sh - sl < 1e-12 THEN 0.0 ELSE (s - sl) / (sh - sl) END) + 0.2 * (CASE WHEN ch - cl < 1e-12 THEN 0.0 ELSE (c - cl) / (ch - cl) END) AS sc FROM g1)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(sc, 9) DESC, fused_rank) AS rank, doc_id, round(sc, 6) AS rerank_score FROM h1""",
    "index_round_trip": f"{_W} SELECT doc_id, count(*) AS n_terms, CAST(sum(tf) AS BIGINT) AS n_tokens, CAST(max(dl) AS BIGINT) AS dl FROM post GROUP BY doc_id",
    "retrieval_metrics": f"{_HY} SELECT * FROM mh",
    "retrieval_macro": f"{_HY} SELECT * FROM {_macro_of('mh')}",
    "retrieval_by_category": f"{_W}, {bm_sql(POOL)}, ks AS (SELECT query_id, doc_id, rank FROM kw), {QRELS_SQL}, {metrics_sql('ks', 'mk')} SELECT CASE WHEN length(b.text) > 300 THEN 'long' ELSE 'short' END AS category, count(*) AS n_queries, {MEANS} FROM mk JOIN benchmark b ON mk.query_id = b.item_id WHERE n_relevant > 0 GROUP BY 1",
    "missed_relevant": f"{_HY} SELECT query_id, doc_id FROM qrels r WHERE NOT EXISTS (SELECT 1 FROM hy WHERE hy.query_id = r.query_id AND hy.doc_id = r.doc_id)",
    "mode_comparison": f"{_MODES}, "
    + ", ".join(f"{v} AS (SELECT metric, value FROM (SELECT {', '.join(f'coalesce({m}, NULL) AS {m}' for m in E.METRICS)} FROM {_macro_of(m_)}) UNPIVOT (value FOR metric IN ({', '.join(E.METRICS)})))" for v, m_ in (("us", "ms"), ("uk", "mk"), ("uh", "mh")))
    + " SELECT us.metric, us.value AS semantic, uk.value AS keyword, uh.value AS hybrid, round(uk.value - us.value, 4) AS keyword_gain, round(uh.value - us.value, 4) AS hybrid_gain FROM us JOIN uk USING (metric) JOIN uh USING (metric)",
}
ORACLE["ablation_grid"] = (
    f"{_MODES}, wfd AS (WITH {fuse_sql('weighted')} SELECT query_id, doc_id, fused_rank AS rank FROM ranked WHERE fused_rank <= {K}), {metrics_sql('wfd', 'mw')}, {RERANK_SQL}, rk AS (SELECT query_id, doc_id, rank FROM rer WHERE rank <= {K}), {metrics_sql('rk', 'mr')} "
    + " UNION ALL ".join(f"SELECT '{label}' AS label, * FROM {_macro_of(m)}" for label, m in (("default", "mh"), ("keyword_only", "mk"), ("semantic_only", "ms"), ("weighted", "mw"), ("lexical_rerank", "mr")))
)
