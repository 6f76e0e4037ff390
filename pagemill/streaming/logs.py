"""Structured Streaming over request logs, and incremental index upkeep."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators.index import build_terms
from pagemill.sources import store
from pagemill.sources.io import upsert


def log_stream(spark: SparkSession, path: str, schema: str, fmt: str = "json", glob: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """New files of a folder as they come."""
    r = spark.readStream.schema(schema).format(fmt)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.load(path)


def windowed(log: DataFrame, ts: str, by: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts, sums and extremes of tumbling windows; rows that come more than
    `late` after the newest are dropped, which bounds the state."""
    w = F.window(ts, width)
    log = log.withColumn(ts, F.col(ts).cast("timestamp"))
    return log.withWatermark(ts, late).groupBy(w.alias("w"), F.col(by)).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("largest")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "total", "largest")


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Runs what is there now to its end, once; restarts go on from checkpoint."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start().awaitTermination()


def maintain_index(spark: SparkSession, chunks: DataFrame, base: str, id_col: str = "chunk_id") -> Callable[[], None]:
    """A run that takes a stream of chunks (id_col, text, ...) into base's
    current version: chunks by key, postings of what changed, and terms.

    Each batch writes a new version beside the old and then names it in
    base/current, one file put in place by a rename: readers see whole versions
    and a batch that runs again gives the same one. The version before stays
    for those that read it, the one before that goes. Only a missing name means
    that there is no index yet; any other error stops the run.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        old, version = store.read_text(spark, f"{base}/current"), f"{base}/v{batch_id}"
        if old == version:
            return
        fresh = upsert(batch.limit(0), batch, id_col)
        rows = upsert(spark.read.parquet(f"{old}/chunks"), batch, id_col) if old else fresh
        rows.write.mode("overwrite").parquet(f"{version}/chunks")
        postings = build_terms(fresh, id_col).postings
        if old:
            kept = spark.read.parquet(f"{old}/postings").join(fresh.select(F.col(id_col).alias("doc_id")), "doc_id", "left_anti")
            postings = kept.unionByName(postings)
        postings.write.mode("overwrite").parquet(f"{version}/postings")
        n = spark.read.parquet(f"{version}/chunks").count()
        df = spark.read.parquet(f"{version}/postings").groupBy("term").agg(F.count("*").alias("df"))
        df.select("term", "df", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")).write.mode("overwrite").parquet(f"{version}/terms")
        store.write_text(spark, f"{base}/current", version)
        if old:
            for gone in _versions(spark, base) - {old, version}:
                store.delete(spark, f"{base}/{gone.rpartition('/')[2]}")

    return lambda: run_available(chunks, f"{base}/checkpoint", each)


def _versions(spark: SparkSession, base: str) -> set[str]:
    fs, p = store.filesystem(spark, base)
    return {f"{base}/{f.getPath().getName()}" for f in fs.listStatus(p) if f.getPath().getName()[:1] == "v" and f.getPath().getName()[1:].isdigit()}
