"""Term statistics and the vector table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.runs import term_counts
from pagemill.functions.text import tokenize
from pagemill.operators import postings


@dataclass(frozen=True)
class TermIndex:
    """postings (doc_id, term, tf, dl), terms (term, df, idf), corpus (n_docs,
    total_terms, avgdl): all of the whole corpus, so a filter over documents
    changes neither idf nor average length."""

    postings: DataFrame
    terms: DataFrame
    corpus: DataFrame
    #: Of a persisted index: its blocks (see postings.py), in so many folders.
    blocks: DataFrame | None = None
    buckets: int = 1


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer=tokenize) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), tokenizer(F.col(text_col)).alias("toks"))


def build_terms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer=tokenize, unique: bool = False) -> TermIndex:
    """Postings are made within each row; where ids are not known to be unique,
    a shuffle adds up rows that share one."""
    rows = term_counts(docs, id_col, text_col, tokenizer).withColumn("dl", F.col("dl").cast("int"))
    corpus = docs.agg(F.count("*").alias("n_docs")).crossJoin(F.broadcast(rows.agg(F.coalesce(F.sum("tf"), F.lit(0)).cast("long").alias("total_terms"))))  # one-row sides
    corpus = corpus.withColumn("avgdl", F.try_divide(F.col("total_terms").cast("double"), F.col("n_docs").cast("double")))
    if not unique:
        rows = rows.groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"), F.max("dl").alias("dl"))
    return TermIndex(rows, with_df(rows.groupBy("term").agg(F.count("*").alias("df")), corpus), corpus)


def with_df(df: DataFrame, corpus: DataFrame) -> DataFrame:
    """(term, df, idf) of (term, df), given the corpus row."""
    n, d = F.col("n_docs"), F.col("df")
    return df.crossJoin(F.broadcast(corpus.select("n_docs"))).select("term", "df", F.log(1 + (n - d + 0.5) / (d + 0.5)).alias("idf"))  # one-row side


def write_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer=tokenize) -> None:
    """docs' index as tables: postings in blocks with their greatest impact, in
    folders by term; terms; and the corpus row."""
    postings.write(docs, path, id_col, text_col, tokenizer)


def read_index(spark: SparkSession, path: str) -> TermIndex:
    """What write_index() wrote. A missing one raises."""
    corpus = spark.read.parquet(f"{path}/corpus")
    row = corpus.select("buckets", "id_type").first()
    return of_blocks(postings.read_blocks(spark, path, row.id_type), spark.read.parquet(f"{path}/terms"), corpus, row.buckets)


def of_blocks(blocks: DataFrame, terms: DataFrame, corpus: DataFrame, buckets: int) -> TermIndex:
    rows = blocks.select("term", F.explode("rows").alias("r")).select("r.doc_id", "term", "r.tf", "r.dl")
    return TermIndex(rows, terms, corpus, blocks, buckets)


def with_idf(terms: DataFrame, index: TermIndex) -> DataFrame:
    """terms (term, ...) joined to their postings and idf. What a batch of
    queries asks for is small next to the postings: of persisted ones only the
    blocks of its terms are opened."""
    return with_blocks(terms.join(index.terms.select("term", "df", "idf"), "term"), index)


def with_blocks(known: DataFrame, index: TermIndex) -> DataFrame:
    """known (term, ...) joined to their postings."""
    if index.blocks is None:
        return known.join(index.postings, "term")
    found = known.withColumn("bucket", postings.bucket("term", index.buckets)).join(index.blocks.select("bucket", "term", "rows"), ["bucket", "term"])
    return found.withColumn("r", F.explode("rows")).select(*known.columns, "r.doc_id", "r.tf", "r.dl")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def hashed_vectors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dim: int = 64) -> DataFrame:
    """A deterministic stand-in for a learned embedding: signed hashed term
    counts, of unit length. Empty texts give zero vectors."""
    toks = docs.select(F.col(id_col).alias("chunk_id"), tokenize(F.col(text_col)).alias("toks"))
    signed = toks.select("chunk_id", F.explode_outer("toks").alias("t")).select("chunk_id", F.pmod(F.xxhash64("t"), F.lit(dim)).cast("int").alias("i"), F.when(F.col("t").isNull(), 0.0).when(F.xxhash64("t", F.lit(1)) % 2 == 0, 1.0).otherwise(-1.0).alias("s"))
    cells = signed.groupBy("chunk_id", "i").agg(F.sum("s").alias("v")).groupBy("chunk_id").agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce("i", F.lit(0)), "v"))).alias("m"))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    norm = F.sqrt(F.aggregate(F.col("raw"), F.lit(0.0), lambda s, v: s + v * v))
    return cells.withColumn("raw", raw).withColumn("norm", norm).select("chunk_id", F.transform("raw", lambda v: F.when(F.col("norm") > 0, v / F.col("norm")).otherwise(0.0).cast("float")).alias("embedding"))


def index_stats(index: TermIndex, vectors: DataFrame | None = None, chunks: DataFrame | None = None) -> DataFrame:
    """One row: documents, distinct terms, mean length to two places; vectors
    and, of chunks (document_id), the sorted distinct document ids."""
    out = index.corpus.select("n_docs", F.bround("avgdl", 2).alias("avgdl")).crossJoin(F.broadcast(index.terms.agg(F.count("*").alias("unique_terms"))))
    if vectors is not None:
        out = out.crossJoin(F.broadcast(vectors.agg(F.count("*").alias("n_vectors"))))
    if chunks is not None:
        out = out.crossJoin(F.broadcast(chunks.agg(F.sort_array(F.collect_set("document_id")).alias("document_ids"))))
    return out
