"""Entry points: from files to an index, from questions to answers and reports."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.config import EngineConfig
from pagemill.operators import agent, answer, chunking, evaluate, index, ingest, retrieve
from pagemill.sources import io, store


@dataclass(frozen=True)
class Ingested:
    """Canonical blocks, chunks, the registry and the report of a corpus."""

    blocks: DataFrame
    chunks: DataFrame
    registry: DataFrame
    report: DataFrame


def ingest_blocks(extracted: DataFrame, files: DataFrame, out: str, ocr: DataFrame | None = None, inspected: DataFrame | None = None, cfg: EngineConfig | None = None) -> Ingested:
    """Extracted blocks (path, page_number, block_id, text, bbox, page_height,
    ...) of files (path[, checksum]) to blocks, chunks, registry and report,
    written below out. A file without blocks is registered as failed; it stops
    nothing."""
    cfg = cfg or EngineConfig()
    spark = extracted.sparkSession
    pages = extracted.withColumnRenamed("path", "document_id").groupBy("document_id", "page_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_id", "text"))), lambda x: x["text"]), "\n").alias("text"))
    covers = ingest.cover_texts(pages).select(F.col("document_id").alias("path"), F.col("cover_text").alias("text"))
    registered = store.keep(ingest.registry(files.join(covers, "path", "left")), "registry")
    io.write_registry(registered, f"{out}/registry")
    named = extracted.join(registered.select("path", "document_id"), "path").drop("path")
    blocks = ingest.normalize_pages(named, ocr)
    blocks.write.mode("overwrite").parquet(f"{out}/blocks")
    blocks = spark.read.parquet(f"{out}/blocks")
    outcome = blocks.groupBy("document_id").agg(F.lit("success").alias("status"))
    io.write_registry(registered, f"{out}/registry", outcome)
    meta = registered.withColumnRenamed("path", "source_path")
    chunks = chunking.chunk(blocks, meta, cfg.chunking)
    chunks.write.mode("overwrite").parquet(f"{out}/chunks")
    signals = ingest.page_signals(blocks).select("document_id", "page_number", "char_count", "n_tables")
    used = blocks.groupBy("document_id", "page_number").agg(F.max("ocr_used").alias("ocr_used")) if "ocr_used" in blocks.columns else signals.select("document_id", "page_number", F.lit(False).alias("ocr_used"))
    seen = inspected if inspected is not None else signals.select("document_id", "page_number", "char_count", F.lit(0).alias("image_count"))
    report = ingest.document_report(signals.join(used, ["document_id", "page_number"], "left"), seen, registered.select("document_id", "filename", "insurer", "product", "uin", "duplicate_of"))
    return Ingested(blocks, spark.read.parquet(f"{out}/chunks"), registered, report)


def build_index(chunks: DataFrame, out: str, embed: Callable[[DataFrame], DataFrame] | None = None) -> tuple[index.TermIndex, DataFrame]:
    """The term index and the vectors (chunk_id, embedding) of chunks, written
    below out; embed gives the vectors (hashed ones unless told otherwise)."""
    spark = chunks.sparkSession
    index.write_index(chunking.index_text(chunks), f"{out}/index", "chunk_id")
    vectors = (embed or (lambda c: index.hashed_vectors(c, "chunk_id", "context_text")))(chunks)
    vectors.write.mode("overwrite").parquet(f"{out}/vectors")
    return open_index(spark, out)


def open_index(spark: SparkSession, out: str) -> tuple[index.TermIndex, DataFrame]:
    return index.read_index(spark, f"{out}/index"), spark.read.parquet(f"{out}/vectors")


def search(queries: DataFrame, terms: index.TermIndex, vectors: DataFrame | None, query_vectors: DataFrame | None, docs: DataFrame, cfg: EngineConfig | None = None, k: int | None = None, where: dict | None = None) -> DataFrame:
    """Hits of queries by the configured mode, fusion and reranker, where
    docs (doc_id, text, ...) fit the metadata filter."""
    cfg = cfg or EngineConfig()
    fits = retrieve.metadata_filter(where)
    reranker = retrieve.build_reranker(cfg.retrieval.rerank, terms, docs, cfg.retrieval)
    return retrieve.hybrid(queries, query_vectors, terms, vectors, cfg.retrieval, k, reranker, None if fits is None else docs.where(fits))


def analyze_queries(queries: DataFrame, corpus: answer.Corpus) -> tuple[DataFrame, DataFrame]:
    """Analyses and plans, without retrieving."""
    found = answer.analyze(queries, corpus)
    return found, agent.plan(found, corpus.products, corpus.cfg.retrieval.default_k, corpus.cfg.agent)


def answer_queries(queries: DataFrame, corpus: answer.Corpus, generator: answer.Generator | None = None) -> DataFrame:
    """Responses without a claim check."""
    return answer.unverified(answer.run(queries, corpus, generator))


def answer_and_verify(queries: DataFrame, corpus: answer.Corpus, generator: answer.Generator | None = None, second=None) -> DataFrame:
    """Responses with their claims checked."""
    return answer.verified(answer.run(queries, corpus, generator), corpus, second)


def evaluate_pipelines(eval_set: DataFrame, runners: dict[str, Callable[[DataFrame], DataFrame]], checkpoint: str | None = None, limit: int | None = None) -> DataFrame:
    """Records of every runner (a function of the eval set), of the first
    `limit` questions by position. With a checkpoint folder, questions that it
    has for a label aren't run again."""
    spark, rows = eval_set.sparkSession, io.first_of(eval_set, limit)
    out = None
    for label, run in runners.items():
        todo, old = rows, None
        if checkpoint is not None and store.exists(spark, checkpoint):
            old = io.read_checkpoint(spark, checkpoint, label)
            todo = io.pending(rows.withColumn("query_id", F.col("query_id").cast("string")), old).select("query_id").join(rows.withColumn("_k", F.col("query_id").cast("string")).withColumnRenamed("query_id", "_id"), F.col("query_id") == F.col("_k")).drop("query_id", "_k").withColumnRenamed("_id", "query_id")
        new = store.keep(run(todo), "records")
        if checkpoint is not None:
            io.write_checkpoint(new, checkpoint)
        both = new if old is None else new.unionByName(old.select(*[F.col(c).cast(t).alias(c) for c, t in new.dtypes]))
        out = both if out is None else out.unionByName(both)
    return out


def ablate(run: Callable[[EngineConfig], DataFrame], cfg: EngineConfig | None = None, overlays: dict[str, dict] | None = None) -> DataFrame:
    """Metrics of run(configuration) under each overlay, by label, with the
    mean time of each component and what the runs used."""
    base = cfg or EngineConfig()
    configs = {label: base.overlay(o) for label, o in (overlays or evaluate.PIPELINE_OVERLAYS).items()}

    def measured(c: EngineConfig) -> DataFrame:
        rows = store.keep(run(c), "ablation")
        spent = rows.agg(*[F.coalesce(F.avg(F.col("latency_ms")[x]), F.lit(0.0)).alias(f"{x}_ms") for x in ("analysis", "retrieval", "generation", "verification")], *[F.coalesce(F.sum(F.col("usage")[x]), F.lit(0)).cast("long").alias(x) for x in answer.NO_USE])
        return evaluate.pipeline_metrics(evaluate.with_total(rows)).crossJoin(F.broadcast(spent))  # a row each

    return evaluate.ablation(configs, measured)


def report(spark: SparkSession, records: DataFrame, path: str, title: str = "Evaluation") -> str:
    """The report of records as JSON and Markdown: metrics by pipeline and by
    category, times of components, use, failure codes and rates."""
    timed = records if "total_ms" in records.columns else evaluate.with_total(records)
    coded = evaluate.failure_codes(timed)
    tables = {
        "metrics": evaluate.pipeline_metrics(timed, ["label"]).orderBy("label"),
        "by_category": evaluate.pipeline_metrics(timed, ["label", "category"]).orderBy("label", "category"),
        "components": evaluate.components_of(records, ["label"]).orderBy("label", "component"),
        "usage": evaluate.usage_of(records, ["label"]).orderBy("label", "counter"),
        "failures": coded.select("label", F.explode("codes").alias("code")).groupBy("code").pivot("label").count().orderBy("code"),
        "rates": evaluate.failure_summary(coded),
    }
    return io.write_report(spark, path, title, tables)
