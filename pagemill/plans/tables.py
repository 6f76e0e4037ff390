"""How the synthetic tables stand in for the engine's own: documents are the
corpus, benchmark passages the queries, and a query's relevant documents are
those that contain its passage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators.phrases import occurrences


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return v.join(queries(spark, sf_dir).select("query_id"), "query_id", "left_semi")


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A passage's documents: those that contain it, met by its rarest token."""
    return occurrences(documents(spark, sf_dir), "doc_id", "text", queries(spark, sf_dir), "query", whole=False).select("query_id", "doc_id")
