"""Evidence budgets, interleaving, extractive answers and citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.config import GenerationConfig
from pagemill.functions.text import excerpt, is_refusal, markers

# Fixed value: what an answer says when there is no evidence.
REFUSAL = "The policy documents provided do not contain this information."


def evidence_blocks(hits: DataFrame, cfg: GenerationConfig | None = None, limit: int | None = None) -> DataFrame:
    """hits (query_id, rank, label, text) with the block shown for each, cut at
    the first that would pass the character budget; the first always stays."""
    cfg = cfg or GenerationConfig()
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] Source: "), F.col("label"), F.lit("\n"), excerpt(F.col("text"), cfg.excerpt_chars))
    run = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = hits.withColumn("block", block).withColumn("used_chars", F.sum(F.length("block")).over(run))
    return out.where((F.col("used_chars") <= (limit or cfg.evidence_chars)) | (F.col("rank") == 1))


def interleave(hits: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """hits (query_id, product, rank) in turns of one a product: wanted ones
    (query_id, product, pos) first, then by first appearance; adds marker."""
    first = F.min("rank").over(Window.partitionBy("query_id", "product"))
    rows = hits.withColumn("_turn", F.row_number().over(Window.partitionBy("query_id", "product").orderBy("rank"))).withColumn("_first", first)
    rows = rows.withColumn("_pos", F.lit(None).cast("int")) if wanted is None else rows.join(wanted.select("query_id", "product", F.col("pos").alias("_pos")), ["query_id", "product"], "left")
    order = Window.partitionBy("query_id").orderBy("_turn", F.col("_pos").asc_nulls_last(), "_first")
    return rows.withColumn("marker", F.row_number().over(order)).drop("_turn", "_first", "_pos")


def extractive_answers(queries: DataFrame, hits: DataFrame, cfg: GenerationConfig | None = None) -> DataFrame:
    """(query_id, answer, abstained): up to two sentences of each of the first
    six hits (query_id, rank, text), each with its marker; else the refusal."""
    cfg = cfg or GenerationConfig()
    flat = F.replace(F.trim("text"), F.lit("\n"), F.lit(" "))
    parts = F.slice(F.filter(F.transform(F.split(flat, r"\. "), lambda s: F.trim(s)), lambda s: F.length(s) >= 15), 1, cfg.extractive_sentences)
    lines = F.transform(parts, lambda s: F.concat(F.regexp_replace(s, r"\.+$", ""), F.lit(". ["), F.col("rank").cast("string"), F.lit("]")))
    per = hits.where(F.col("rank") <= cfg.extractive_chunks).select("query_id", "rank", F.array_join(lines, "\n").alias("part")).where("part <> ''")
    made = per.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "part"))), lambda x: x["part"]), "\n").alias("answer"))
    out = queries.select("query_id").join(made, "query_id", "left")
    bad = F.col("answer").isNull() | is_refusal(F.col("answer"))
    return out.select("query_id", F.when(bad, REFUSAL).otherwise(F.col("answer")).alias("answer"), bad.alias("abstained"))


def generate(queries: DataFrame, evidence: DataFrame, model) -> DataFrame:
    """Answers of a model, a function of an iterator of pandas frames (query_id,
    query, prompt) to frames (query_id, answer); queries without evidence get
    the refusal and never reach it."""
    prompt = evidence.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "\n\n").alias("prompt"))
    made = queries.join(prompt, "query_id").select("query_id", "query", "prompt").mapInPandas(model, "query_id long, answer string")
    out = queries.select("query_id").join(made, "query_id", "left")
    return out.select("query_id", F.coalesce("answer", F.lit(REFUSAL)).alias("answer"), (F.col("answer").isNull() | is_refusal(F.col("answer"))).alias("abstained"))


def prompts(queries: DataFrame, blocks: DataFrame, comparison: DataFrame | None = None) -> DataFrame:
    """(query_id, query, prompt) of evidence blocks (query_id, rank, block);
    comparison (query_id, products, criteria) heads those that compare."""
    shown = blocks.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "\n\n").alias("shown"))
    rows = queries.select("query_id", "query").join(shown, "query_id")
    head = F.lit("")
    if comparison is not None:
        named = lambda c, none: F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise(none)
        rows = rows.join(comparison.select("query_id", "products", "criteria"), "query_id", "left")
        head = F.when(F.col("products").isNotNull(), F.concat(F.lit("Compare: "), named("products", "(all that are shown)"), F.lit("\nBy: "), named("criteria", "(as asked)"), F.lit("\n\n"))).otherwise("")
    rules = "\n\nAnswer from these excerpts alone, each statement with the number of its excerpt in brackets. If they hold no answer, say: " + REFUSAL
    return rows.select("query_id", "query", F.concat(head, F.lit("Excerpts:\n"), F.col("shown"), F.lit("\n\nQuestion: "), F.col("query"), F.lit(rules)).alias("prompt"))


def comparison_blocks(hits: DataFrame, wanted: DataFrame | None = None, cfg: GenerationConfig | None = None) -> DataFrame:
    """hits (query_id, product, rank, label, text) in turns of one a product,
    numbered anew, with the block shown for each as far as comparison_chars
    reach; rank is the new number."""
    cfg = cfg or GenerationConfig()
    named = hits.withColumn("product", F.coalesce(F.nullif("product", F.lit("")), F.lit("(unspecified)")))
    turns = interleave(named, wanted).withColumn("rank", F.col("marker")).drop("marker")
    return evidence_blocks(turns, cfg, cfg.comparison_chars)


def citations(answers: DataFrame, shown: DataFrame) -> DataFrame:
    """(query_id, marker, doc_id) of the markers in answers that name a shown
    block (query_id, rank, doc_id); others don't resolve."""
    used = answers.select("query_id", F.explode(markers(F.col("answer"))).alias("marker"))
    return used.join(shown.select("query_id", F.col("rank").alias("marker"), "doc_id"), ["query_id", "marker"])


def unresolved(answers: DataFrame, shown: DataFrame) -> DataFrame:
    used = answers.select("query_id", F.explode(markers(F.col("answer"))).alias("marker"))
    return used.join(shown.select("query_id", F.col("rank").alias("marker")), ["query_id", "marker"], "left_anti")


def aligned_evidence(cited: DataFrame, docs: DataFrame, cfg: GenerationConfig | None = None) -> DataFrame:
    """(query_id, marker, doc_id, text) for every marker from 1 to the largest
    cited: the document's text, else the citation's excerpt, else empty."""
    cfg = cfg or GenerationConfig()
    top = cited.groupBy("query_id").agg(F.max("marker").alias("m"))
    every = top.select("query_id", F.explode(F.sequence(F.lit(1), "m")).alias("marker"))
    rows = every.join(cited, ["query_id", "marker"], "left").join(docs.select("doc_id", "text"), "doc_id", "left")
    shown = F.left("excerpt", F.lit(cfg.citation_excerpt_chars)) if "excerpt" in cited.columns else F.lit(None).cast("string")
    return rows.select("query_id", "marker", "doc_id", F.coalesce("text", shown, F.lit("")).alias("text"))
