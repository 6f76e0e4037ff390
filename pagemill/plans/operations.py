"""Queries over runs, failures, logs and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators import evaluate as E
from pagemill.plans import tables as T
from pagemill.sources import store
from pagemill.streaming import logs as L

# One run a document, its fields by arithmetic on the id, the same in SQL.
_FIELDS = {
    "answerable": "doc_id % 9 <> 0",
    "abstained": "doc_id % 5 = 0",
    "category": "CASE doc_id % 4 WHEN 0 THEN 'comparison' WHEN 1 THEN 'coverage' ELSE 'factual' END",
    "query_type": "CASE doc_id % 6 WHEN 0 THEN 'product_comparison' WHEN 1 THEN 'out_of_domain' WHEN 2 THEN 'multi_step' ELSE 'coverage' END",
    "claims": "CAST(doc_id % 7 AS INT)",
    "contradicted": "CAST(CASE WHEN doc_id % 7 > 3 AND doc_id % 3 = 0 THEN 1 ELSE 0 END AS INT)",
    "insufficient": "CAST(CASE WHEN doc_id % 7 > 2 AND doc_id % 4 = 1 THEN 2 ELSE 0 END AS INT)",
    "unresolved_citations": "CAST(CASE WHEN doc_id % 17 = 3 THEN 1 ELSE 0 END AS INT)",
    "unsupported_stripped": "CAST(CASE WHEN doc_id % 8 = 1 THEN 1 ELSE 0 END AS INT)",
    "contradicted_kept": "CAST(CASE WHEN doc_id % 23 = 4 THEN 1 ELSE 0 END AS INT)",
    "degenerate": "doc_id % 29 = 0",
    "plan_empty": "doc_id % 31 = 1",
    "answered_with_relevant_evidence": "doc_id % 3 <> 1",
    "supported_rate": "CAST(doc_id % 5 AS DOUBLE) / 4",
    "total_ms": "CAST(doc_id % 1000 AS DOUBLE)",
}
_SETS = {"relevant_chunk_ids": ["doc_id % 5", "doc_id % 3 + 1"], "evidence_chunk_ids": ["doc_id % 4", "doc_id % 7 + 2"], "retrieval_top_chunk_ids": ["doc_id % 2", "doc_id % 6"], "evidence_products": ["doc_id % 2", "doc_id % 4"]}


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    d = T.documents(spark, sf).select("doc_id")
    for k, v in _FIELDS.items():
        d = d.withColumn(k, F.expr(v))
    for k, v in _SETS.items():
        d = d.withColumn(k, F.array_distinct(F.array(*[F.expr(f"cast({x} as string)") for x in v])))
    return d


def taxonomy_codes(spark: SparkSession, sf: str) -> DataFrame:
    return E.failure_codes(_runs(spark, sf)).select("doc_id", F.array_join("codes", ",").alias("codes"), "failed")


def taxonomy_counts(spark: SparkSession, sf: str) -> DataFrame:
    return E.failure_counts(E.failure_codes(_runs(spark, sf)))


def pipeline_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return E.pipeline_metrics(_runs(spark, sf))


def pipeline_by_category(spark: SparkSession, sf: str) -> DataFrame:
    return E.pipeline_metrics(_runs(spark, sf), ["category"])


def latency_components(spark: SparkSession, sf: str) -> DataFrame:
    return E.latency_components(T.table(spark, sf, "events"), "event_type", "value")


def usage_diff(spark: SparkSession, sf: str) -> DataFrame:
    log = T.table(spark, sf, "events").select("event_id", "user_id", (F.col("event_id") * 3).alias("calls"), (F.col("event_id") * 7 + F.col("user_id")).alias("tokens"))
    return E.usage_diff(log, ["calls", "tokens"], "user_id", ["event_id"]).select("event_id", "calls_diff", "tokens_diff")


def log_stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    """The event log as a stream, run to its end: hourly windows by type."""
    base = store.fresh_path(spark, "log-windows")
    schema = spark.read.parquet(f"{sf}/events.parquet").schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    stream = L.windowed(L.log_stream(spark, sf, schema, "parquet", "events.parquet"), "ts", "event_type", "value")
    L.run_available(stream, f"{base}/checkpoint", lambda df, i: df.write.mode("overwrite").parquet(f"{base}/out"), "complete")
    out = spark.read.parquet(f"{base}/out")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"), "largest")


def log_stream_late(spark: SparkSession, sf: str) -> DataFrame:
    """The event log dealt into files, the third with rows older than the
    watermark allows, in append mode: windows close, late rows are dropped. (A
    batch drops by the watermark that the batch before it began with.)"""
    base = store.fresh_path(spark, "log-late")
    e = T.table(spark, sf, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    day = F.to_date("ts")
    first = e.where("event_id % 2 = 0")
    start = first.agg(F.min("ts")).first()[0]
    for n, part in enumerate((first.where("event_id % 4 = 0"), first.where("event_id % 4 = 2"), e.where("event_id % 2 = 1").where(day == F.to_date(F.lit(start))), first.orderBy(F.desc("ts")).limit(1).withColumn("ts", F.col("ts") + F.expr("interval 30 days")))):
        part.coalesce(1).write.mode("overwrite").parquet(f"{base}/in/part={n}")
    out = None
    stream = L.windowed(spark.readStream.schema("event_id long, event_type string, ts timestamp, value double, part int").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{base}/in"), "ts", "event_type", "value", "1 day", "2 days")
    L.run_available(stream, f"{base}/checkpoint", lambda df, i: df.write.mode("append").parquet(f"{base}/out"), "append")
    out = spark.read.parquet(f"{base}/out")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def run_components(spark: SparkSession, sf: str) -> DataFrame:
    """Times of runs by component, from their maps."""
    d = T.documents(spark, sf).select("doc_id", F.create_map(F.lit("retrieval"), (F.col("doc_id") % 97).cast("double"), F.lit("generation"), (F.col("doc_id") % 13).cast("double"), F.lit("total"), (F.col("doc_id") % 97 + F.col("doc_id") % 13).cast("double")).alias("latency_ms"))
    return E.components_of(d)


def run_usage(spark: SparkSession, sf: str) -> DataFrame:
    d = T.documents(spark, sf).select("lang", F.create_map(F.lit("calls"), F.lit(1).cast("long"), F.lit("prompt_tokens"), F.col("n_chars").cast("long")).alias("usage"))
    return E.usage_of(d, ["lang"])


QUERIES = {f.__name__: f for f in (taxonomy_codes, taxonomy_counts, pipeline_metrics, pipeline_by_category, latency_components, usage_diff, log_stream_windows, log_stream_late, run_components, run_usage)}

_R = (
    "WITH r0 AS (SELECT doc_id, "
    + ", ".join(f"{v} AS {k}" for k, v in _FIELDS.items())
    + ", "
    + ", ".join(f"list_distinct([{', '.join(v)}]) AS {k}" for k, v in _SETS.items())
    + " FROM documents), r AS (SELECT *, len(list_intersect(relevant_chunk_ids, evidence_chunk_ids)) AS hits, len(list_intersect(relevant_chunk_ids, retrieval_top_chunk_ids)) AS seen, claims = 0 AND (NOT abstained OR degenerate) AS silent, insufficient + contradicted AS bad FROM r0)"
)
CODES = {
    "F1": "answerable AND hits = 0",
    "F2": "answerable AND hits > 0 AND len(relevant_chunk_ids) > hits",
    "F3": "answerable AND hits = 0 AND seen > 0",
    "F4": "answerable AND query_type = 'out_of_domain'",
    "F5": "answerable AND NOT abstained AND plan_empty",
    "F6": "answerable AND silent",
    "F7": "answerable AND NOT silent AND claims > 0 AND bad > 0 AND NOT abstained",
    "F8": "answerable AND unresolved_citations > 0",
    "F9": "answerable AND contradicted_kept > 0",
    "F10": "answerable AND abstained",
    "F11": "answerable AND abstained AND hits > 0 AND bad = 0 AND claims = 0",
    "F12": "answerable AND category = 'comparison' AND query_type IN ('product_comparison', 'recommendation', 'multi_step') AND len(evidence_products) < 2 AND NOT abstained",
    "F13": "answerable AND contradicted > 0",
    "F14": "NOT answerable AND NOT abstained",
    "F15": "unsupported_stripped > 0",
    "F16": "NOT answerable AND abstained",
}
_C = f"{_R}, c AS (SELECT doc_id, list_filter([{', '.join(f'CASE WHEN {v} THEN {k!r} END' for k, v in CODES.items())}], lambda x: x IS NOT NULL) AS codes FROM r)"
_PM = """count(*) FILTER (answerable) AS answerable_queries, count(*) FILTER (answerable AND NOT abstained) AS answered,
 coalesce(round(count(*) FILTER (answerable AND NOT abstained) / CAST(nullif(count(*) FILTER (answerable), 0) AS DOUBLE), 4), 0.0) AS answer_rate,
 count(*) FILTER (NOT answerable) AS ood_probes, count(*) FILTER (NOT answerable AND abstained) AS ood_abstained, count(*) FILTER (answerable AND abstained) AS abstentions_on_answerable,
 count(*) FILTER (answerable AND NOT abstained AND answered_with_relevant_evidence) AS answered_correct,
 coalesce(round(count(*) FILTER (answerable AND NOT abstained AND answered_with_relevant_evidence) / CAST(nullif(count(*) FILTER (answerable AND NOT abstained), 0) AS DOUBLE), 4), 0.0) AS answered_correct_rate,
 CAST(sum(claims) AS BIGINT) AS total_fact_claims, coalesce(round(sum(bad) / CAST(nullif(sum(claims), 0) AS DOUBLE), 4), 0.0) AS unsupported_claim_rate,
 coalesce(round(avg(supported_rate) FILTER (answerable AND NOT abstained), 4), 0.0) AS mean_supported_rate, count(*) FILTER (unsupported_stripped > 0 OR contradicted > 0) AS queries_with_unsupported_claims,
 round(avg(total_ms) FILTER (total_ms > 0), 4) AS mean_ms, median(total_ms) FILTER (total_ms > 0) AS median_ms, max(total_ms) FILTER (total_ms > 0) AS max_ms"""
ORACLE = {
    "taxonomy_codes": f"{_C} SELECT doc_id, array_to_string(codes, ',') AS codes, len(list_filter(codes, lambda x: x NOT IN ('F15', 'F16'))) > 0 AS failed FROM c",
    "taxonomy_counts": f"{_C} SELECT code, count(*) AS n FROM (SELECT unnest(codes) AS code FROM c) GROUP BY code",
    "pipeline_metrics": f"{_R} SELECT {_PM} FROM r",
    "pipeline_by_category": f"{_R} SELECT category, {_PM} FROM r GROUP BY category",
    "latency_components": "SELECT event_type AS component, count(*) AS n, round(avg(value), 4) AS mean_ms, median(value) AS median_ms, max(value) AS max_ms FROM events WHERE value > 0 GROUP BY event_type",
    "usage_diff": "SELECT event_id, event_id * 3 - coalesce(lag(event_id * 3) OVER w, 0) AS calls_diff, event_id * 7 + user_id - coalesce(lag(event_id * 7 + user_id) OVER w, 0) AS tokens_diff FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)",
    "run_components": """WITH r AS (SELECT doc_id % 97 AS a, doc_id % 13 AS b FROM documents), c AS (SELECT 'retrieval' AS component, CAST(a AS DOUBLE) AS ms FROM r UNION ALL SELECT 'generation', b FROM r UNION ALL SELECT 'total', a + b FROM r)
SELECT component, count(*) AS n, round(avg(ms), 4) AS mean_ms, median(ms) AS median_ms, max(ms) AS max_ms FROM c WHERE ms > 0 GROUP BY component""",
    "run_usage": "SELECT lang, 'calls' AS counter, count(*) AS total FROM documents GROUP BY lang UNION ALL SELECT lang, 'prompt_tokens', CAST(sum(n_chars) AS BIGINT) FROM documents GROUP BY lang",
    "log_stream_late": """WITH e AS (SELECT *, date_trunc('day', ts) AS d FROM events), f AS (SELECT * FROM e WHERE event_id % 2 = 0), m AS (SELECT date_trunc('day', min(ts)) AS first, max(ts) AS top FROM f),
k AS (SELECT f.* FROM f UNION ALL SELECT e.* FROM e, m WHERE event_id % 2 = 1 AND d = first AND d + INTERVAL 1 DAY > top - INTERVAL 2 DAY)
SELECT strftime(d, '%Y-%m-%d') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM k GROUP BY 1, 2""",
    "log_stream_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total, max(value) AS largest FROM events GROUP BY 1, 2",
}
