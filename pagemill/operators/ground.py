"""Claims of answers, their verification against cited evidence, and the response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.config import GroundingConfig
from pagemill.functions.text import containment, content_tokens, excerpt, is_refusal, markers, numbers, sentences, shorten, strip, without_markers

# Headings under which a line concludes, and what a heading is.
CONCLUSIONS = ["conclusion", "summary", "recommendation", "verdict", "caveat", "note"]
HEADING = r"^\s*\**\s*[A-Za-z][A-Za-z /-]{2,48}:\**\s*$"
# The questions asked back.
QUESTIONS = {
    "coverage": "Could you name the treatment or expense you want coverage checked for (e.g. cataract, maternity, room rent)?",
    "waiting_period": "Could you name the specific procedure or illness whose waiting period you need?",
    "exclusion": "Could you name the treatment, condition or activity you want checked for exclusion?",
    "eligibility": "Could you share the applicant's age (and the product, if you have one in mind)?",
    "policy_information": "Could you restate the question with the specific section or term you need (e.g. free look period, grace period)?",
    "multi_step": "Could you split the question so I can verify each part against the policy documents?",
}
ANY_QUESTION = "Could you restate the question with the specific term, procedure or product it should be checked against?"
# How a question back begins.
NO_EVIDENCE = "No matching policy evidence was retrieved for this question."
NO_SUPPORT = "No retrieved excerpt supports the key part of this question."


def claims(answers: DataFrame, cfg: GroundingConfig | None = None) -> DataFrame:
    """(query_id, claim_index, line, kind, section, text, markers): sentences of
    the lines of answers. Heading lines set the section; sentences under a
    concluding one are conclusions; a citation that stands alone belongs to the
    sentence before it; what is short or has no letter is left out."""
    cfg = cfg or GroundingConfig()
    lines = answers.select("query_id", F.posexplode(F.split("answer", "\r\n|\r|\n")).alias("i", "raw")).select("query_id", (F.col("i") + 1).alias("line"), strip(F.col("raw")).alias("t")).where("t <> ''")
    title = F.trim(F.regexp_replace(F.btrim("t", F.lit(" *")), ":+$", ""))
    is_head = F.col("t").rlike(HEADING) & (title != "")
    run = Window.partitionBy("query_id").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    under = lines.withColumn("head", is_head).withColumn("section", F.coalesce(F.last(F.when(is_head, F.lower(title)), ignorenulls=True).over(run), F.lit(""))).where("not head")
    body = F.regexp_replace(F.regexp_replace("t", r"^\d+\.\s+", ""), r"^[-*•]\s*", "")
    segs = under.withColumn("body", body).select("query_id", "line", "section", F.posexplode(F.when(F.col("body").rlike("^[-*•]"), F.array("body")).otherwise(sentences(F.col("body")))).alias("j", "seg"))
    own = without_markers(F.col("seg"))
    at = Window.partitionBy("query_id", "line").orderBy("j").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grouped = segs.withColumn("own", own).withColumn("g", F.sum(F.when((F.col("own") != "") | (F.col("j") == 0), 1).otherwise(0)).over(at))
    merged = grouped.groupBy("query_id", "line", "section", "g").agg(F.min(F.struct("j", "own"))["own"].alias("text"), F.array_sort(F.collect_list(F.struct("j", markers(F.col("seg")).alias("m")))).alias("ms"))
    marks = F.array_distinct(F.flatten(F.transform("ms", lambda x: x["m"])))
    kind = F.when(F.exists(F.array(*[F.lit(c) for c in CONCLUSIONS]), lambda c: F.col("section").contains(c)), "conclusion").otherwise("fact")
    kept = merged.where((F.length("text") >= cfg.min_claim_chars) & F.col("text").rlike(r"\p{L}"))
    order = Window.partitionBy("query_id").orderBy("line", "g")
    return kept.select("query_id", F.row_number().over(order).alias("claim_index"), "line", kind.alias("kind"), "section", "text", marks.alias("markers"))


def verify(found: DataFrame, evidence: DataFrame, cfg: GroundingConfig | None = None) -> DataFrame:
    """claims with verdict (supported, contradicted, insufficient, not_verified),
    support_score and reason. evidence: query_id, marker, text. Numbers that no
    cited text shares contradict before containment can support."""
    cfg = cfg or GroundingConfig()
    ev = evidence.select("query_id", "marker", content_tokens(F.col("text"), cfg.stopwords).alias("et"), numbers(F.col("text")).alias("en"))
    cited = found.select("query_id", "claim_index", "text", F.explode("markers").alias("marker")).join(ev, ["query_id", "marker"])
    score = cited.withColumn("s", containment(content_tokens(F.col("text"), cfg.stopwords), F.col("et"))).groupBy("query_id", "claim_index").agg(F.max("s").alias("best"), F.array_distinct(F.flatten(F.collect_list("en"))).alias("seen"))
    rows = found.join(score, ["query_id", "claim_index"], "left").join(evidence.select("query_id").distinct().withColumn("has", F.lit(True)), "query_id", "left")
    own = numbers(F.col("text"))
    clash = (F.size(own) > 0) & (F.size("seen") > 0) & ~F.arrays_overlap(own, "seen") & F.lit(cfg.number_strict)
    concl = (F.col("kind") == "conclusion") & F.lit(not cfg.verify_conclusions)
    verdict = F.when(concl, "not_verified").when(F.col("best").isNull(), "insufficient").when(clash, "contradicted").when(F.col("best") >= cfg.support_threshold, "supported").otherwise("insufficient")
    reason = (
        F.when(concl, "conclusion")
        .when(F.size("markers") == 0, "uncited claim")
        .when(F.col("has").isNull(), "no evidence available")
        .when(F.col("best").isNull(), "unresolved citation")
        .when(clash, "numbers not in cited evidence")
        .when(F.col("best") >= cfg.support_threshold, "content contained")
        .otherwise("content not contained")
    )
    return rows.select(*found.columns, verdict.alias("verdict"), F.when(~concl & F.col("best").isNotNull(), F.round("best", 4)).otherwise(0.0).alias("support_score"), reason.alias("reason"))


def opinion_prompts(verified: DataFrame, evidence: DataFrame, cfg: GroundingConfig | None = None) -> DataFrame:
    """(query_id, prompt) of queries with pending verdicts: every excerpt, cut
    to excerpt_chars, and every claim with what it cites. evidence: query_id,
    marker, doc_id, text."""
    cfg = cfg or GroundingConfig()
    line = F.concat(F.lit("["), F.col("marker").cast("string"), F.lit("] ("), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(")\n"), excerpt(strip(F.col("text")), cfg.excerpt_chars))
    shown = evidence.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("marker", line.alias("l")))), lambda x: x["l"]), "\n\n").alias("shown"))
    cites = F.when(F.size("markers") > 0, F.concat(F.lit("["), F.array_join("markers", ", "), F.lit("]"))).otherwise("none")
    said = F.concat(F.lit("CLAIM "), F.col("claim_index").cast("string"), F.lit(": "), F.col("text"), F.lit(" (cites: "), cites, F.lit(")"))
    asked = verified.withColumn("pending", F.col("verdict").isin("insufficient", "contradicted")).groupBy("query_id").agg(F.max("pending").alias("pending"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("claim_index", said.alias("l")))), lambda x: x["l"]), "\n").alias("claims")).where("pending")
    return asked.join(shown, "query_id", "left").select("query_id", F.concat(F.lit("Excerpts:\n"), F.coalesce("shown", F.lit("")), F.lit("\n\nClaims:\n"), F.col("claims"), F.lit("\n\nAnswer one line per claim: CLAIM <number>: supported, contradicted or insufficient")).alias("prompt"))


def parse_verdicts(replies: DataFrame) -> DataFrame:
    """(query_id, claim_index, verdict) of replies (query_id, raw): lines like
    `CLAIM 3: supported`, in any case, with a colon or a dash; the last one of
    a claim counts."""
    pattern = r"(?i)CLAIM\s*(\d+)\s*[:\-]\s*(supported|contradicted|insufficient)"
    found = replies.select("query_id", F.posexplode(F.regexp_extract_all(F.coalesce("raw", F.lit("")), F.lit(pattern), 0)).alias("i", "m"))
    each = found.select("query_id", "i", F.regexp_extract("m", pattern, 1).cast("int").alias("claim_index"), F.lower(F.regexp_extract("m", pattern, 2)).alias("verdict"))
    return each.groupBy("query_id", "claim_index").agg(F.max_by("verdict", "i").alias("verdict"))


def merge_verdicts(verified: DataFrame, said: DataFrame) -> DataFrame:
    """Pending verdicts (insufficient, contradicted) with what was said of them
    (query_id, claim_index, verdict). A contradiction is lifted by `supported`
    only; an insufficient claim takes any verdict named; silence changes nothing."""
    known = said.select("query_id", "claim_index", F.lower(F.trim("verdict")).alias("_v")).where(F.col("_v").isin("supported", "contradicted", "insufficient"))
    new = F.when((F.col("verdict") == "contradicted") & (F.col("_v") == "supported"), "supported").when((F.col("verdict") == "insufficient") & F.col("_v").isNotNull(), F.col("_v")).otherwise(F.col("verdict"))
    return verified.join(known, ["query_id", "claim_index"], "left").withColumn("verdict", new).drop("_v")


def second_opinion(verified: DataFrame, model) -> DataFrame:
    """merge_verdicts() of what model says: a function of an iterator of pandas
    frames (query_id, claim_index, text) to frames with verdict."""
    ask = verified.where(F.col("verdict").isin("insufficient", "contradicted")).select("query_id", "claim_index", "text")
    return merge_verdicts(verified, ask.mapInPandas(model, "query_id long, claim_index int, verdict string"))


def clarification(query_type: Column, evidence_count: Column) -> Column:
    ask = F.lit(ANY_QUESTION)
    for k, q in QUESTIONS.items():
        ask = F.when(query_type == k, F.lit(q)).otherwise(ask)
    return F.concat(F.when(evidence_count == 0, NO_EVIDENCE).otherwise(NO_SUPPORT), F.lit(" "), ask)


def shape(answers: DataFrame, verified: DataFrame, cfg: GroundingConfig | None = None) -> DataFrame:
    """(query_id, final_answer, abstained, supported_rate, counts, clarification,
    notes) of answers (query_id, answer, query_type, evidence_count).

    Lines of unsupported facts and of contradicted claims go; an answer whose
    facts hold too rarely, or that has no claim at all, gives way to a question
    back, unless it is the generator's own refusal. Answers that come marked
    abstained pass as they are."""
    cfg = cfg or GroundingConfig()
    declined = F.coalesce(F.col("_declined"), F.lit(False))
    answers = answers.withColumn("_declined", F.col("abstained") if "abstained" in answers.columns else F.lit(False)).drop("abstained")
    v = F.col("verdict")
    fact = F.col("kind") == "fact"
    bad = ((v == "insufficient") & fact) | (v == "contradicted")
    per = verified.groupBy("query_id").agg(
        F.count("*").alias("claims"),
        F.count_if(v == "supported").alias("supported"),
        F.count_if(v == "contradicted").alias("contradicted"),
        F.count_if((v == "insufficient") & fact).alias("insufficient"),
        F.count_if(fact & (v != "not_verified")).alias("facts"),
        F.array_sort(F.collect_set(F.when(bad, F.col("line")))).alias("drop"),
        F.transform(F.array_sort(F.collect_list(F.when((v == "insufficient") & fact, F.struct("claim_index", "text")))), lambda x: shorten(x["text"], cfg.note_chars)).alias("weak"),
        F.transform(F.array_sort(F.collect_list(F.when(v == "contradicted", F.struct("claim_index", "text")))), lambda x: shorten(x["text"], cfg.note_chars)).alias("wrong"),
    )
    rows = answers.join(per, "query_id", "left")
    for c in ("claims", "supported", "contradicted", "insufficient", "facts"):
        rows = rows.withColumn(c, F.coalesce(c, F.lit(0)).cast("long"))
    rate = F.coalesce(F.try_divide(F.col("supported").cast("double"), F.col("facts").cast("double")), F.lit(0.0))
    silent, refused = F.col("claims") == 0, is_refusal(F.col("answer"))
    weak = (F.col("facts") > 0) & ((F.col("supported") == 0) | (rate < cfg.min_supported_rate))
    lines = F.split("answer", "\r\n|\r|\n")
    numbered = F.transform(lines, lambda x, i: F.struct((i + 1).alias("n"), x.alias("t")))
    kept = F.filter(numbered, lambda x: ~F.array_contains(F.coalesce("drop", F.expr("cast(array() as array<int>)")), x["n"]) & (strip(x["t"]) != ""))
    stripped = strip(F.array_join(F.transform(kept, lambda x: x["t"]), "\n"))
    strips = ~declined & F.lit(cfg.strip_unsupported) & (F.col("insufficient") + F.col("contradicted") > 0)
    back = clarification(F.col("query_type"), F.col("evidence_count"))
    asks = ~declined & ((silent & ~refused) | (~silent & weak))
    final = F.when(asks, F.concat(F.lit("I could not verify an answer. "), back)).when(strips & (stripped != ""), stripped).otherwise(F.col("answer"))
    quoted = F.array_join(F.transform(F.slice(F.col("weak"), 1, cfg.max_note_claims), lambda s: F.concat(F.lit('"'), s, F.lit('"'))), "; ")
    notes = F.array_compact(
        F.array(
            F.when(silent, F.when(refused, "Generator abstained: no evidence in the corpus.").otherwise("No verifiable statements could be extracted from the generated answer.")),
            F.when(F.col("contradicted") > 0, F.concat(F.lit("Removed as in conflict with the cited evidence: "), F.array_join("wrong", "; "))),
            F.when(F.col("insufficient") > 0, F.concat(F.lit("Removed as not verified: "), quoted, F.when(F.size("weak") > cfg.max_note_claims, F.concat(F.lit("; and "), (F.size("weak") - cfg.max_note_claims).cast("string"), F.lit(" more"))).otherwise(""))),
        )
    )
    return rows.select("query_id", final.alias("final_answer"), (declined | silent | weak).alias("abstained"), F.round(rate, 4).alias("supported_rate"), "claims", "supported", "contradicted", "insufficient", F.when(asks, back).alias("clarification"), notes.alias("notes"))
