"""Retrieval metrics, pipeline metrics and the failure taxonomy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ["precision", "recall", "hit", "ndcg", "mrr", "map"]


def retrieval_metrics(hits: DataFrame, qrels: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Per query (n_relevant and) precision of what was returned, recall, hit,
    nDCG, reciprocal rank and average precision, of the list cut to k. Queries
    without relevant documents score 0."""
    n_rel = qrels.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    flagged = hits.where(F.col("rank") <= k).select("query_id", "doc_id", "rank").join(qrels.select("query_id", "doc_id", F.lit(1).alias("rel")), ["query_id", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    run = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per = (
        flagged.withColumn("cum", F.sum("rel").over(run))
        .groupBy("query_id")
        .agg(
            F.count("*").alias("n"),
            F.sum("rel").alias("found"),
            F.sum(F.col("rel") / F.log2(F.col("rank") + 1.0)).alias("dcg"),
            F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"),
            F.sum(F.col("rel") * F.col("cum") / F.col("rank")).alias("ap"),
        )
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.col("n_relevant"), F.lit(k))).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    rows = queries.select("query_id").distinct().join(n_rel, "query_id", "left").join(per, "query_id", "left").withColumn("n_relevant", F.coalesce("n_relevant", F.lit(0)))
    some = F.col("n_relevant") > 0
    zero = lambda c: F.coalesce(F.when(some, c), F.lit(0.0)).cast("double")
    return rows.select(
        "query_id",
        "n_relevant",
        zero(F.try_divide(F.col("found").cast("double"), F.col("n").cast("double"))).alias("precision"),
        zero(F.try_divide(F.col("found").cast("double"), F.col("n_relevant").cast("double"))).alias("recall"),
        zero(F.when(F.col("found") > 0, 1.0)).alias("hit"),
        F.round(zero(F.col("dcg") / ideal), 6).alias("ndcg"),
        zero(F.try_divide(F.lit(1.0), F.col("first").cast("double"))).alias("mrr"),
        F.round(zero(F.try_divide(F.col("ap"), F.col("n_relevant").cast("double"))), 6).alias("map"),
    )


def macro(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means over answerable queries to four places, of all or by columns."""
    rows = metrics.where("n_relevant > 0")
    return (rows.groupBy(*by) if by else rows.groupBy()).agg(F.count("*").alias("n_queries"), *[F.round(F.avg(m), 4).alias(m) for m in METRICS])


def missed(hits: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    return qrels.select("query_id", "doc_id").join(hits.where(F.col("rank") <= k).select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")


def compare_modes(by_mode: dict[str, DataFrame], baseline: str) -> DataFrame:
    """One row a metric: each mode's macro value and its gain on the baseline."""
    rows = None
    for label, m in by_mode.items():
        one = macro(m).select(F.lit(label).alias("label"), F.explode(F.map_from_arrays(F.array(*[F.lit(x) for x in METRICS]), F.array(*METRICS))).alias("metric", "value"))
        rows = one if rows is None else rows.unionByName(one)
    wide = rows.groupBy("metric").pivot("label", list(by_mode)).agg(F.max("value"))
    for label in by_mode:
        if label != baseline:
            wide = wide.withColumn(f"{label}_gain", F.round(F.col(label) - F.col(baseline), 4))
    return wide


def _has(code: str, when: Column) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.lit(code))


def failure_codes(runs: DataFrame) -> DataFrame:
    """runs with codes (array, F1 to F16 in order) and failed (any code but F15
    and F16). Missing counts are 0, missing lists empty."""
    none = F.expr("cast(array() as array<string>)")
    arr = lambda c: F.array_distinct(F.coalesce(F.col(c).cast("array<string>"), none))
    num = lambda c: F.coalesce(F.col(c), F.lit(0))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    rel, ev = arr("relevant_chunk_ids"), arr("evidence_chunk_ids")
    top = F.when(F.size(arr("retrieval_top_chunk_ids")) > 0, arr("retrieval_top_chunk_ids")).otherwise(ev)
    hits = F.size(F.array_intersect(rel, ev))
    ans, abst = flag("answerable"), flag("abstained")
    claims, bad = num("claims"), num("insufficient") + num("contradicted")
    silent = (claims == 0) & (~abst | flag("degenerate"))
    codes = F.array_compact(
        F.array(
            _has("F1", ans & (hits == 0) & (F.size(rel) > 0)),
            _has("F2", ans & (hits > 0) & (F.size(rel) > hits)),
            _has("F3", ans & (hits == 0) & F.arrays_overlap(rel, top)),
            _has("F4", ans & (F.col("query_type") == "out_of_domain")),
            _has("F5", ans & ~abst & flag("plan_empty")),
            _has("F6", ans & silent),
            _has("F7", ans & ~silent & (claims > 0) & (bad > 0) & ~abst),
            _has("F8", ans & (num("unresolved_citations") > 0)),
            _has("F9", ans & (num("contradicted_kept") > 0)),
            _has("F10", ans & abst),
            _has("F11", ans & abst & (hits > 0) & (bad == 0) & (claims == 0)),
            _has("F12", ans & (F.col("category") == "comparison") & F.col("query_type").isin("product_comparison", "recommendation", "multi_step") & (F.size(arr("evidence_products")) < 2) & ~abst),
            _has("F13", ans & (num("contradicted") > 0)),
            _has("F14", ~ans & ~abst),
            _has("F15", num("unsupported_stripped") > 0),
            _has("F16", ~ans & abst),
        )
    )
    out = runs.withColumn("codes", codes)
    return out.withColumn("failed", F.size(F.array_except("codes", F.array(F.lit("F15"), F.lit("F16")))) > 0)


def failure_counts(coded: DataFrame) -> DataFrame:
    return coded.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n"))


def pipeline_metrics(runs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts, rates (to four places) and total latency of runs."""
    ans, abst = F.coalesce("answerable", F.lit(False)), F.coalesce("abstained", F.lit(False))
    good = F.coalesce("answered_with_relevant_evidence", F.lit(False))
    total = F.when(F.col("total_ms") > 0, F.col("total_ms"))
    n = lambda c: F.count_if(c)
    rate = lambda a, b: F.coalesce(F.round(F.try_divide(a.cast("double"), b.cast("double")), 4), F.lit(0.0))
    bad, claims = F.coalesce(F.sum(F.col("contradicted") + F.col("insufficient")), F.lit(0)), F.coalesce(F.sum("claims"), F.lit(0))
    g = runs.groupBy(*by) if by else runs.groupBy()
    return g.agg(
        n(ans).alias("answerable_queries"),
        n(ans & ~abst).alias("answered"),
        rate(n(ans & ~abst), n(ans)).alias("answer_rate"),
        n(~ans).alias("ood_probes"),
        n(~ans & abst).alias("ood_abstained"),
        n(ans & abst).alias("abstentions_on_answerable"),
        n(ans & ~abst & good).alias("answered_correct"),
        rate(n(ans & ~abst & good), n(ans & ~abst)).alias("answered_correct_rate"),
        claims.cast("long").alias("total_fact_claims"),
        rate(bad, claims).alias("unsupported_claim_rate"),
        F.coalesce(F.round(F.avg(F.when(ans & ~abst, F.col("supported_rate"))), 4), F.lit(0.0)).alias("mean_supported_rate"),
        n((F.col("unsupported_stripped") > 0) | (F.col("contradicted") > 0)).alias("queries_with_unsupported_claims"),
        F.round(F.avg(total), 4).alias("mean_ms"),
        F.median(total).alias("median_ms"),
        F.max(total).alias("max_ms"),
    )


def latency_components(rows: DataFrame, component: str, ms: str) -> DataFrame:
    """Mean, median and max of the positive times of each component."""
    return rows.where(F.col(ms) > 0).groupBy(F.col(component).alias("component")).agg(F.count("*").alias("n"), F.round(F.avg(ms), 4).alias("mean_ms"), F.median(ms).alias("median_ms"), F.max(ms).alias("max_ms"))


def usage_diff(log: DataFrame, counters: list[str], by: str, order: list[str]) -> DataFrame:
    """Each counter's growth since the former snapshot of the same `by`."""
    w = Window.partitionBy(by).orderBy(*order)
    return log.select(*log.columns, *[(F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0))).alias(f"{c}_diff") for c in counters])


def ablation(configs: dict, run) -> DataFrame:
    """run(config) of each configuration, under its label."""
    out = None
    for label, cfg in configs.items():
        one = run(cfg).withColumn("label", F.lit(label))
        out = one if out is None else out.unionByName(one)
    return out


def run_records(label: str, eval_set: DataFrame, responses: DataFrame, checked: DataFrame, cited: DataFrame, products: DataFrame, retrieved: DataFrame | None = None) -> DataFrame:
    """One record a question (schemas.CHECKPOINT's columns but times and use),
    the same for every pipeline.

    eval_set: query_id, query, category, relevant (ids as strings); responses:
    query_id, query_type, abstained, clarification, final_answer, n_steps,
    supported_rate; checked: claims with kind, verdict, reason; cited:
    query_id, marker, doc_id; products: doc_id, product. With retrieved
    (query_id, rank, doc_id) the evidence is what was cited, or else all that
    was retrieved, and contradictions count as stripped as well: a pipeline
    without a handler."""
    none = F.expr("cast(array() as array<string>)")
    listed = lambda df, by, name: df.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(by, F.col("doc_id").cast("string").alias("d")))), lambda x: x["d"]).alias(name))
    fact = checked.where("kind = 'fact'").groupBy("query_id").agg(*[F.count_if(F.col("verdict") == v).cast("int").alias(v) for v in ("supported", "contradicted", "insufficient")], F.count("*").cast("int").alias("claims"))
    loose = checked.groupBy("query_id").agg(F.count_if(F.col("reason").startswith("unresolved")).cast("int").alias("unresolved_citations"))
    shown = cited if retrieved is None else retrieved
    named = shown.select("query_id", "doc_id").join(products, "doc_id").where("product <> ''").groupBy("query_id").agg(F.sort_array(F.collect_set("product")).alias("evidence_products"))
    rows = eval_set.join(responses.select("query_id", "query_type", "abstained", "clarification", "final_answer", "n_steps", F.col("supported_rate").alias("_rate")), "query_id", "left")
    for t in (fact, loose, named, listed(cited, "marker", "cited"), *([] if retrieved is None else [listed(retrieved, "rank", "found")])):
        rows = rows.join(t, "query_id", "left")
    for c in ("claims", "supported", "contradicted", "insufficient", "unresolved_citations"):
        rows = rows.withColumn(c, F.coalesce(c, F.lit(0)))
    some = F.array_sort(F.array_distinct(F.coalesce("cited", none)))
    if retrieved is not None:
        found = F.coalesce("found", none)
        some = F.when(F.size(some) > 0, some).otherwise(found)
    abstained = F.coalesce("abstained", F.lit(True))
    relevant = F.coalesce("relevant", none)
    hit = (F.size(relevant) > 0) & F.arrays_overlap(relevant, "evidence_chunk_ids")
    rate = F.coalesce("_rate", F.lit(0.0)) if retrieved is None else F.coalesce(F.round(F.try_divide(F.col("supported").cast("double"), F.col("claims").cast("double")), 4), F.lit(0.0))
    rows = rows.withColumn("evidence_chunk_ids", some)
    return rows.select(
        F.lit(label).alias("label"),
        F.col("query_id").cast("string").alias("qid"),
        "query",
        "category",
        (F.size(relevant) > 0).alias("answerable"),
        "query_type",
        abstained.alias("abstained"),
        "clarification",
        "final_answer",
        "claims",
        "supported",
        "contradicted",
        "insufficient",
        rate.alias("supported_rate"),
        "unresolved_citations",
        (F.col("insufficient") if retrieved is None else F.col("insufficient") + F.col("contradicted")).alias("unsupported_stripped"),
        F.lit(0).alias("contradicted_kept"),
        relevant.alias("relevant_chunk_ids"),
        "evidence_chunk_ids",
        (F.coalesce("cited", none) if retrieved is None else F.coalesce("found", none)).alias("retrieval_top_chunk_ids"),
        F.coalesce("evidence_products", none).alias("evidence_products"),
        ((F.coalesce("n_steps", F.lit(0)) == 0) & ~abstained & F.lit(retrieved is None)).alias("plan_empty"),
        ((F.col("claims") == 0) & ~abstained).alias("degenerate"),
        (~abstained & hit).alias("answered_with_relevant_evidence"),
    )


def failure_summary(coded: DataFrame) -> DataFrame:
    """Queries, failed ones and their share to four places."""
    n, bad = F.count("*"), F.count_if("failed")
    return coded.agg(n.alias("num_queries"), bad.alias("num_failed"), F.coalesce(F.round(F.try_divide(bad.cast("double"), n.cast("double")), 4), F.lit(0.0)).alias("failure_rate"))


def with_total(runs: DataFrame) -> DataFrame:
    """runs with total_ms, the sum of their components' times."""
    return runs.withColumn("total_ms", F.aggregate(F.map_values("latency_ms"), F.lit(0.0), lambda a, x: a + x))


def components_of(runs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Times of runs (latency_ms: a map of component to ms) by component."""
    keys = by or []
    each = runs.select(*keys, F.explode("latency_ms").alias("component", "ms")).where("ms > 0")
    return each.groupBy(*keys, "component").agg(F.count("*").alias("n"), F.round(F.avg("ms"), 4).alias("mean_ms"), F.median("ms").alias("median_ms"), F.max("ms").alias("max_ms"))


def usage_of(runs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """What runs used (usage: a map of counter to number), summed."""
    keys = by or []
    return runs.select(*keys, F.explode("usage").alias("counter", "n")).groupBy(*keys, "counter").agg(F.sum("n").alias("total"))


#: What each overlay of the pipeline changes, by configuration section.
PIPELINE_OVERLAYS: dict[str, dict] = {
    "default": {},
    "no_rerank": {"retrieval": {"rerank": "none"}},
    "keyword_only": {"retrieval": {"mode": "keyword"}},
    "semantic_only": {"retrieval": {"mode": "semantic"}},
    "no_strip": {"grounding": {"strip_unsupported": False}},
    "rules_only": {"grounding": {"second_pass": False}},
}
