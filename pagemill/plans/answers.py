"""Queries over analysis, planning, execution, answers, claims and responses."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.config import AgentConfig, GroundingConfig, RetrievalConfig
from pagemill.functions.text import GROUNDING_STOPWORDS, citation_label
from pagemill.operators import agent as A
from pagemill.operators import answer as W
from pagemill.operators import evaluate as E
from pagemill.operators import generate as N
from pagemill.operators import ground as V
from pagemill.operators import retrieve as R
from pagemill.plans import retrieval as P
from pagemill.plans import tables as T
from pagemill.plans.operations import CODES
from pagemill.sources import store

PRODUCTS = ["Aurora Health Shield", "Borealis Care Plan", "Cedar Family Floater", "my:Delta Secure", "Aurora Travel Guard"]
QUESTIONS = [
    "What is the waiting period for cataract surgery?",
    "Is maternity covered under Borealis Care Plan?",
    "Compare Cedar Family Floater and my:Delta Secure on room rent",
    "Which policy should I buy? I am 34 years old and want maternity with low waiting period, 10 lakh cover",
    "What are the exclusions and what is the entry age?",
    "Who won the cricket match yesterday?",
    "Tell me a story about dragons",
    "Please compare all policies on coverage and waiting period",
    "recommend something",
    "How many days is the grace period for premium payment?",
    "Does the borealis plan exclude dental treatment; is ambulance payable?",
    "For a person aged 61 suggest the best plan with 1.5 crore sum insured and a 2 year term",
    "compare prices",
    "Where can I see the definition of hospital?",
    "What about age limit, moratorium and benefit of aurora health?",
    "best for me: affordable premium, opd cover, age: 45",
]


def _turns(spark: SparkSession, sf: str, openings: list[str]) -> DataFrame:
    """What users say in the conversations, each turn after one of the openings."""
    opening = F.element_at(F.array(*[F.lit(x) for x in openings]), (F.col("conv_id") % len(openings) + 1).cast("int"))
    return T.table(spark, sf, "conversations").where("role = 'user' and text is not null").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.concat(opening, F.col("text")).alias("query"))


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    return _turns(spark, sf, [f"{q} " for q in QUESTIONS])


def _products(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p,) for p in PRODUCTS], "product string")


def _names(spark: SparkSession, sf: str) -> DataFrame:
    """As many product names as there are openings of three words in documents, and the fixed ones."""
    opening = F.array_join(F.slice(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0), 1, 3), " ")
    return T.documents(spark, sf).select(opening.alias("product")).unionByName(_products(spark))


def product_aliases(spark: SparkSession, sf: str) -> DataFrame:
    return A.product_aliases(_names(spark, sf))


def match_products(spark: SparkSession, sf: str) -> DataFrame:
    return A.match_products(_questions(spark, sf), A.product_aliases(_names(spark, sf))).select("query_id", F.array_join("products", "|").alias("products"))


def _analysed(spark: SparkSession, q: DataFrame) -> DataFrame:
    return A.analyze(q, A.match_products(q, A.product_aliases(_products(spark)), few=True))


def _analysis(spark: SparkSession, sf: str) -> DataFrame:
    return _analysed(spark, _questions(spark, sf))


def analyze_queries(spark: SparkSession, sf: str) -> DataFrame:
    return _analysis(spark, sf).select("query_id", "query_type", "confidence", "is_complex", *[F.array_join(c, "|").alias(c) for c in ("criteria", "products", "matched_cues", "detected_types")])


def requirements(spark: SparkSession, sf: str) -> DataFrame:
    r = _questions(spark, sf).select("query_id", A.requirements(F.col("query")).alias("r"))
    return r.select("query_id", F.col("r.age").alias("age"), F.col("r.sum_insured").alias("sum_insured"), F.col("r.objective").alias("objective"), F.array_join("r.priorities", "|").alias("priorities"), F.col("r.tenure").alias("tenure"))


def plan_steps(spark: SparkSession, sf: str) -> DataFrame:
    return A.plan(_analysis(spark, sf), PRODUCTS).select("query_id", "step_id", "query", "product", F.array_join("criteria", "|").alias("criteria"), "top_k")


def clarifications(spark: SparkSession, sf: str) -> DataFrame:
    a = _analysis(spark, sf)
    return A.needs_clarification(a, A.plan(a, PRODUCTS))


def _executed(spark: SparkSession, sf: str, cfg: AgentConfig | None = None) -> DataFrame:
    return A.execute(_steps(spark, sf), P._index(spark, sf), T.documents(spark, sf), "source", cfg)


def _steps(spark: SparkSession, sf: str) -> DataFrame:
    return T.queries(spark, sf).select("query_id", "query", F.posexplode(F.array(F.lit(None).cast("string"), F.lit("src0"), F.lit("src1"))).alias("i", "product")).select("query_id", (F.col("i") + 1).alias("step_id"), "query", "product", F.lit(4).alias("top_k"))


def execute_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Three steps a query (of any source, and of two sources), four hits each."""
    return _executed(spark, sf).select("query_id", "step_id", F.col("rank").cast("long"), "doc_id", F.round("score", 6).alias("score"))


def evidence_by_product(spark: SparkSession, sf: str) -> DataFrame:
    return A.by_product(_executed(spark, sf), T.documents(spark, sf), "source").select("query_id", "product", F.array_join("doc_ids", ",").alias("doc_ids"))


def _shown(spark: SparkSession, sf: str) -> DataFrame:
    """Eight hits a query with their texts; written once, as what is answered,
    claimed and cited all starts from them."""
    return P._kept(spark, sf, "shown", lambda: _eight(spark, sf))


def _eight(spark: SparkSession, sf: str) -> DataFrame:
    d = T.documents(spark, sf)
    hits = R.bm25(T.queries(spark, sf), P._index(spark, sf), 8, P.CFG).select("query_id", "rank", "doc_id")
    label = citation_label(F.col("source"), F.lit(None).cast("string"), F.col("doc_id").cast("string"), F.lit(1), F.lit(1), F.col("lang"), F.lit(None).cast("array<string>"))
    return hits.join(d.select("doc_id", "text", "source", label.alias("label")), "doc_id")


def evidence_budget(spark: SparkSession, sf: str) -> DataFrame:
    return N.evidence_blocks(_shown(spark, sf)).select("query_id", F.col("rank").cast("long"), "doc_id", F.col("used_chars").cast("long"), F.md5("block").alias("block_md5"))


def interleave_products(spark: SparkSession, sf: str) -> DataFrame:
    rows = _shown(spark, sf).select("query_id", "rank", "doc_id", F.col("source").alias("product"))
    wanted = T.queries(spark, sf).select("query_id", F.lit("src0").alias("product"), F.lit(1).alias("pos"))
    return N.interleave(rows, wanted).select("query_id", F.col("marker").cast("long"), "doc_id", "product")


def extractive_answer(spark: SparkSession, sf: str) -> DataFrame:
    return N.extractive_answers(T.queries(spark, sf), _shown(spark, sf)).select("query_id", F.md5("answer").alias("answer_md5"), "abstained")


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    """Extractive answers, some with lines added that check each verdict."""
    a = N.extractive_answers(T.queries(spark, sf), _shown(spark, sf))
    more = F.when(F.col("query_id") % 4 == 0, "\nKey points:\n- The limit is 77041 days in total. [1]\n2. Nobody said this at all [19]").when(F.col("query_id") % 4 == 1, "\n**Summary:**\nIt all holds together well. [1]\nSo be it!").when(F.col("query_id") % 4 == 2, "\nA claim without any source. And one more such claim here").otherwise("")
    return a.select("query_id", F.concat("answer", more).alias("answer"))


def _claims(spark: SparkSession, sf: str) -> DataFrame:
    return V.claims(_answers(spark, sf))


def claims(spark: SparkSession, sf: str) -> DataFrame:
    return _claims(spark, sf).select("query_id", F.col("claim_index").cast("long"), F.col("line").cast("long"), "kind", "section", F.md5("text").alias("text_md5"), F.array_join("markers", ",").alias("markers"))


def conversation_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Claims an assistant makes, counted a conversation."""
    c = T.table(spark, sf, "conversations").where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("answer"))
    return V.claims(c).groupBy("query_id").agg(F.count("*").alias("claims"), F.sum(F.length("text")).cast("long").alias("chars"))


def citations(spark: SparkSession, sf: str) -> DataFrame:
    return N.citations(_answers(spark, sf), _shown(spark, sf)).select("query_id", F.col("marker").cast("long"), "doc_id")


def unresolved_citations(spark: SparkSession, sf: str) -> DataFrame:
    return N.unresolved(_answers(spark, sf), _shown(spark, sf)).select("query_id", F.col("marker").cast("long"))


def aligned_evidence(spark: SparkSession, sf: str) -> DataFrame:
    cited = N.citations(_answers(spark, sf), _shown(spark, sf)).where("marker % 3 <> 1")
    return N.aligned_evidence(cited, T.documents(spark, sf)).select("query_id", F.col("marker").cast("long"), "doc_id", F.md5("text").alias("text_md5"))


#: The queries below were written for containment without these words.
WITH_STOPWORDS = GroundingConfig(stopwords=tuple(GROUNDING_STOPWORDS))


def _verified(spark: SparkSession, sf: str, cfg: GroundingConfig = WITH_STOPWORDS) -> DataFrame:
    return V.verify(_claims(spark, sf), _shown(spark, sf).select("query_id", F.col("rank").alias("marker"), "text"), cfg)


def verify_claims_all_words(spark: SparkSession, sf: str) -> DataFrame:
    """The default: every token of three characters counts."""
    return _verified(spark, sf, GroundingConfig()).select("query_id", F.col("claim_index").cast("long"), "verdict", "support_score")


def second_opinions(spark: SparkSession, sf: str) -> DataFrame:
    """Replies, made from the ids, parsed and merged into the verdicts."""
    v = _verified(spark, sf)
    said = F.concat(F.lit("CLAIM 1: SUPPORTED\nclaim 2 - contradicted\nCLAIM 3: maybe\nCLAIM "), (F.col("query_id") % 7).cast("string"), F.lit(": Insufficient\nCLAIM 4: supported"))
    replies = T.queries(spark, sf).where("query_id % 3 <> 2").select("query_id", said.alias("raw"))
    return V.merge_verdicts(v, V.parse_verdicts(replies)).select("query_id", F.col("claim_index").cast("long"), "verdict")


def verify_claims(spark: SparkSession, sf: str) -> DataFrame:
    return _verified(spark, sf).select("query_id", F.col("claim_index").cast("long"), "verdict", "support_score")


def shape_response(spark: SparkSession, sf: str) -> DataFrame:
    """The whole offline path: retrieve, quote, verify, answer."""
    a = _answers(spark, sf).select("query_id", "answer", F.when(F.col("query_id") % 2 == 0, "coverage").otherwise("other").alias("query_type"), F.lit(6).alias("evidence_count"))
    s = V.shape(a, _verified(spark, sf))
    return s.select("query_id", F.md5("final_answer").alias("final_md5"), "abstained", F.round("supported_rate", 3).alias("supported_rate"), "claims", "supported", "contradicted", "insufficient", "clarification")


def execute_budget(spark: SparkSession, sf: str) -> DataFrame:
    """The steps of execute_plan with room for seven hits a query: later steps
    fetch what is left, and lose what earlier ones had."""
    return _executed(spark, sf, AgentConfig(max_evidence_chunks=7)).select("query_id", "step_id", F.col("rank").cast("long"), "doc_id", F.round("score", 6).alias("score"))


def execute_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """The same steps over both retrievers, each within the step's source."""
    steps = _steps(spark, sf)
    v = T.query_vectors(spark, sf).join(steps.select("query_id", "step_id"), "query_id")
    got = A.execute(steps, P._index(spark, sf), T.documents(spark, sf), "source", AgentConfig(max_evidence_chunks=9), RetrievalConfig(), T.vectors(spark, sf), v)
    return got.select("query_id", "step_id", F.col("rank").cast("long"), "doc_id", "score")


def execute_hybrid_default(spark: SparkSession, sf: str) -> DataFrame:
    """The same with the default configuration: room for 80 hits a query, pools
    of 20 a step."""
    steps = _steps(spark, sf)
    v = T.query_vectors(spark, sf).join(steps.select("query_id", "step_id"), "query_id")
    got = A.execute(steps, P._index(spark, sf), T.documents(spark, sf), "source", vectors=T.vectors(spark, sf), step_vectors=v)
    return got.select("query_id", "step_id", F.col("rank").cast("long"), "doc_id", "score")


def refine_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Analyses of the questions, unsure ones refined by replies of all kinds."""
    reply = (
        F.when(F.col("query_id") % 4 == 0, 'Sure: {"query_type": " Exclusion ", "criteria": ["coverage", "colour"], "products": ["X"], "requirements": {"age": 41, "sum_insured": "5 lakh", "priorities": ["p"]}} ok')
        .when(F.col("query_id") % 4 == 1, "no object here")
        .when(F.col("query_id") % 4 == 2, '{"query_type": "bogus"}')
        .otherwise('{"query_type": "multi_step", "criteria": []}')
    )
    a = _analysis(spark, sf)
    r = A.refine_with_replies(a, a.select("query_id", reply.alias("raw")), AgentConfig(llm_confidence_threshold=0.7))
    return r.select("query_id", "query_type", "confidence", "is_complex", *[F.array_join(c, "|").alias(c) for c in ("criteria", "products", "matched_cues")], F.col("requirements.age").alias("age"), F.col("requirements.sum_insured").alias("sum_insured"), F.array_join("requirements.priorities", "|").alias("priorities"))


def _said(spark: SparkSession, sf: str) -> DataFrame:
    return _turns(spark, sf, _OPENINGS)


_OPENINGS = ["", "What is the waiting period for ", "Compare Cedar Family Floater and my:Delta Secure on ", "recommend a plan with 10 lakh cover, age: 45, for ", "Are these exclusions and is the entry age fine: ", "who won "]


def analyze_conversations(spark: SparkSession, sf: str) -> DataFrame:
    q = _said(spark, sf)
    a = _analysed(spark, q)
    return a.select("query_id", "query_type", "confidence", "is_complex", F.array_join("criteria", "|").alias("criteria"), F.array_join("products", "|").alias("products"), F.col("requirements.age").alias("age"), F.col("requirements.sum_insured").alias("sum_insured"))


def plan_conversations(spark: SparkSession, sf: str) -> DataFrame:
    """How many steps each question takes, and on which products."""
    q = _said(spark, sf)
    steps = A.plan(_analysed(spark, q), PRODUCTS)
    return steps.groupBy("query_id").agg(F.count("*").alias("n_steps"), F.count_distinct("product").alias("n_products"), F.sum(F.length("query")).cast("long").alias("chars"))


SOURCES = ["src0", "src1", "src2", "src3"]
_ASKED = ["Is this covered: ", "", "Compare the policies src1 and src2 on coverage of ", "recommend something like "]


def _questions_of_all_kinds(spark: SparkSession, sf: str) -> DataFrame:
    opening = F.element_at(F.array(*[F.lit(x) for x in _ASKED]), (F.col("query_id") % len(_ASKED) + 1).cast("int"))
    return T.queries(spark, sf).select("query_id", F.concat(opening, F.col("query")).alias("query"))


def _corpus(spark: SparkSession, sf: str) -> W.Corpus:
    return W.Corpus(T.documents(spark, sf), P._index(spark, sf), "source", SOURCES)


def _run(spark: SparkSession, sf: str) -> W.Run:
    return store.once(spark, ("run", sf), lambda: W.run(_questions_of_all_kinds(spark, sf), _corpus(spark, sf)))


def answer_routes(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf).routed.select("query_id", "query_type", "route", "n_steps", F.md5("short_answer").alias("short_md5"))


def agent_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Questions of all kinds through the pipeline without a claim check."""
    return W.unverified(_run(spark, sf)).select("query_id", "query_type", "route", F.md5("final_answer").alias("final_md5"), "abstained", F.md5("clarification").alias("clarification_md5"), "evidence_count", "n_citations")


def answer_and_verify(spark: SparkSession, sf: str) -> DataFrame:
    """The same with their claims checked."""
    out = W.verified(_run(spark, sf), _corpus(spark, sf))
    return out.select("query_id", "query_type", "route", F.md5("final_answer").alias("final_md5"), "abstained", "evidence_count", "claims", "supported", "contradicted", "insufficient", F.round("supported_rate", 3).alias("supported_rate"))


def _eval_set(spark: SparkSession, sf: str) -> DataFrame:
    rel = P._qrels(spark, sf).groupBy("query_id").agg(F.array_sort(F.collect_set(F.col("doc_id").cast("string"))).alias("relevant"))
    kind = F.when(F.col("query_id") % 3 == 0, "comparison").when(F.col("query_id") % 3 == 1, "coverage").otherwise("factual")
    return _questions_of_all_kinds(spark, sf).withColumn("category", kind).join(rel, "query_id", "left")


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """Both pipelines' records of the questions."""

    def make() -> DataFrame:
        c, e = _corpus(spark, sf), _eval_set(spark, sf)
        plain = replace(c, vectors=T.vectors(spark, sf))
        return store.keep(W.full_records(e, c).unionByName(W.baseline_records(e, T.query_vectors(spark, sf), plain)), "records")

    return store.once(spark, ("records", sf), make)


def pipeline_records(spark: SparkSession, sf: str) -> DataFrame:
    r = E.failure_codes(_records(spark, sf))
    return r.select("label", F.col("qid").cast("long").alias("query_id"), "category", "answerable", "query_type", "abstained", "claims", "supported", "contradicted", "insufficient", F.round("supported_rate", 3).alias("supported_rate"), "unsupported_stripped", F.array_join("evidence_chunk_ids", ",").alias("evidence"), F.array_join("retrieval_top_chunk_ids", ",").alias("top"), F.array_join("evidence_products", ",").alias("products"), "answered_with_relevant_evidence", F.array_join("codes", ",").alias("codes"), "failed")


def pipeline_times(spark: SparkSession, sf: str) -> DataFrame:
    """Whether every record that was retrieved for has the times of all its
    components, whether the parts sum up to the totals, and what was used."""
    r = E.with_total(_records(spark, sf))
    parts = E.components_of(r, ["label"]).groupBy("label").agg(F.sum(F.col("n") * F.col("mean_ms")).alias("parts"))
    used = E.usage_of(r, ["label"]).groupBy("label").agg(F.sum("total").alias("used"))
    every = F.col("latency_ms")["retrieval"].isNull() | ((F.col("latency_ms")["retrieval"] > 0) & (F.col("latency_ms")["generation"] > 0) & (F.col("latency_ms")["verification"] > 0))
    all_ = r.groupBy("label").agg(F.count("*").alias("n"), F.every((F.col("total_ms") > 0) & every).alias("timed"), F.sum("total_ms").alias("total"))
    return all_.join(parts, "label").join(used, "label").select("label", "n", "timed", (F.abs(F.col("total") - F.col("parts")) <= 0.0001 * F.col("n") * 4).alias("sums_agree"), "used")


def failure_rates(spark: SparkSession, sf: str) -> DataFrame:
    both = None
    for label in ("full", "baseline"):
        one = E.failure_summary(E.failure_codes(_records(spark, sf).where(F.col("label") == label))).withColumn("label", F.lit(label))
        both = one if both is None else both.unionByName(one)
    return both


def product_list(spark: SparkSession, sf: str) -> DataFrame:
    """Sources as products, in the order in which the documents name them."""
    return A.product_list(T.documents(spark, sf), "source", "doc_id")


def api_responses(spark: SparkSession, sf: str) -> DataFrame:
    """What a service would return, read back from its JSON."""
    r = _run(spark, sf)
    body = W.respond(W.unverified(r), r.citations)
    part = lambda p: F.get_json_object("body", p)
    return body.select("query_id", F.md5(part("$.answer")).alias("answer_md5"), part("$.query_type").alias("query_type"), part("$.abstained").alias("abstained"), part("$.evidence_count").cast("long").alias("evidence_count"), F.regexp_count("body", F.lit('"n":[0-9]+')).cast("long").alias("citations"), F.md5(part("$.clarification")).alias("clarification_md5"))


QUERIES = {f.__name__: f for f in (product_aliases, match_products, analyze_queries, requirements, plan_steps, clarifications, execute_plan, execute_budget, execute_hybrid, execute_hybrid_default, refine_replies, analyze_conversations, plan_conversations, answer_routes, agent_answers, answer_and_verify, pipeline_records, pipeline_times, failure_rates, product_list, api_responses, evidence_by_product, evidence_budget, interleave_products, extractive_answer, claims, conversation_claims, citations, unresolved_citations, aligned_evidence, verify_claims, verify_claims_all_words, second_opinions, shape_response)}

_L = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
_turns_sql = lambda xs: f"q AS (SELECT conv_id * 1000 + turn AS query_id, {_L(xs)}[conv_id % {len(xs)} + 1] || text AS query FROM conversations WHERE role = 'user' AND text IS NOT NULL)"
_Q = _turns_sql([f"{q} " for q in QUESTIONS])
_ALIAS = f"""pr AS (SELECT unnest({_L(PRODUCTS)}) AS product),
w AS (SELECT product, lower(product) AS base, list_filter(regexp_extract_all(lower(product), '[a-z0-9]+'), lambda x: length(x) >= 4 AND NOT list_contains({_L(A.ALIAS_STOPWORDS)}, x)) AS w FROM pr),
al0 AS (SELECT DISTINCT product, unnest(list_filter(list_concat([base], w, [CASE WHEN len(w) >= 2 THEN w[1] || ' ' || w[2] END]), lambda x: x IS NOT NULL)) AS alias FROM w),
al AS (SELECT alias, min(product) AS product FROM al0 GROUP BY alias HAVING count(DISTINCT product) = 1)"""
_NAMED = _ALIAS.replace(f"SELECT unnest({_L(PRODUCTS)}) AS product", f"SELECT DISTINCT product FROM (SELECT array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+')[1:3], ' ') AS product FROM documents WHERE text IS NOT NULL UNION ALL SELECT unnest({_L(PRODUCTS)})) WHERE product <> ''")
_MATCH = f"{_Q}, {_ALIAS}, mt AS (SELECT query_id, list(DISTINCT product ORDER BY product) AS products FROM q JOIN al ON regexp_matches(lower(query), '\\b\\Q' || alias || '\\E\\b') GROUP BY query_id)"
_N = lambda cues: f"len(list_filter({_L(cues)}, lambda c: contains(t, c)))"
_FAM = [*A.FAMILIES, "policy_information"]
_CRIT = "list_filter([" + ", ".join(f"CASE WHEN len(list_filter({_L(v)}, lambda c: contains(t, c))) > 0 THEN '{k}' END" for k, v in A.CRITERIA.items()) + "], lambda x: x IS NOT NULL)"
_ANALYZE = f"""{_MATCH}, a0 AS (SELECT q.query_id, query, ' ' || lower(query) || ' ' AS t, coalesce(products, []::VARCHAR[]) AS products FROM q LEFT JOIN mt USING (query_id)),
a1 AS (SELECT *, {", ".join(f"{_N(v)} {'+ CASE WHEN len(products) >= 2 THEN 1 ELSE 0 END' if k == 'product_comparison' else ''} AS n_{k}" for k, v in A.CUES.items())} FROM a0),
a2 AS (SELECT *, len(products) = 0 AND {" + ".join(f"n_{k}" for k in [*A.FAMILIES, "product_comparison", "recommendation"])} = 0 AND ({_N(A.OUT_OF_DOMAIN)} > 0 OR {_N(A.DOMAIN_TERMS)} = 0) AS ood,
  list_filter([{", ".join(f"CASE WHEN n_{k} > 0 THEN '{k}' END" for k in A.FAMILIES)}], lambda x: x IS NOT NULL) AS pos, greatest({", ".join(f"n_{k}" for k in _FAM)}) AS top, {" + ".join(f"n_{k}" for k in _FAM)} AS strong,
  list_filter([{", ".join(f"CASE WHEN n_{k} > 0 THEN '{k}:' || n_{k} END" for k in [*A.FAMILIES, "product_comparison", "recommendation"])}], lambda x: x IS NOT NULL) AS matched,
  list_filter([{", ".join(f"CASE WHEN n_{k} > 0 THEN '{k}' END" for k in [*A.FAMILIES, "product_comparison", "recommendation"])}], lambda x: x IS NOT NULL) AS detected, {_CRIT} AS crit FROM a1),
a3 AS (SELECT *, CASE {" ".join(f"WHEN top > 0 AND n_{k} = top THEN '{k}'" for k in _FAM)} ELSE 'waiting_period' END AS best FROM a2),
an AS (SELECT query_id, query, t, products,
  CASE WHEN ood THEN 'out_of_domain' WHEN n_product_comparison > 0 THEN 'product_comparison' WHEN n_recommendation > 0 THEN 'recommendation' WHEN len(pos) >= 2 THEN 'multi_step' ELSE best END AS query_type,
  round(CASE WHEN ood THEN 0.6 WHEN n_product_comparison > 0 THEN least(1.0, 0.55 + 0.15 * n_product_comparison) WHEN n_recommendation > 0 THEN least(1.0, 0.55 + 0.15 * n_recommendation) WHEN len(pos) >= 2 THEN least(1.0, 0.5 + 0.1 * strong) WHEN top > 0 THEN least(1.0, 0.45 + 0.15 * top) ELSE 0.3 END, 4)::DOUBLE AS confidence,
  NOT ood AND (n_product_comparison > 0 OR n_recommendation > 0 OR len(pos) >= 2) AS is_complex,
  CASE WHEN ood THEN [] WHEN n_product_comparison = 0 AND n_recommendation > 0 AND len(crit) = 0 THEN {_L(A.RECOMMENDED_CRITERIA)} ELSE crit END AS criteria, matched,
  CASE WHEN ood THEN [] WHEN n_product_comparison > 0 OR n_recommendation > 0 THEN detected WHEN len(pos) >= 2 THEN pos WHEN top > 0 THEN [best] ELSE [] END AS types FROM a3)"""
_REQ = f"""r0 AS (SELECT query_id, query, lower(query) AS t FROM q),
rq AS (SELECT query_id, list_filter([TRY_CAST(nullif(regexp_extract(t, '(\\d{{1,3}})\\s*[-\\s]?years?[-\\s]?old', 1), '') AS INT), TRY_CAST(nullif(regexp_extract(t, '\\baged?\\s*(?:of|:)?\\s*(\\d{{1,3}})\\b', 1), '') AS INT)], lambda x: x > 0 AND x < 120)[1] AS age,
  nullif(regexp_extract(t, '(\\d+(?:\\.\\d+)?)\\s*(?:lakhs?|lac|crore|cr)\\b', 1), '') || CASE WHEN regexp_extract(t, '\\d+(?:\\.\\d+)?\\s*(lakhs?|lac|crore|cr)\\b', 1) LIKE 'cr%' THEN ' crore' ELSE ' lakh' END AS sum_insured,
  list_filter({_L(A.OBJECTIVES)}, lambda o: contains(t, o))[1] AS objective,
  list_filter([{", ".join(f"CASE WHEN len(list_filter({_L(v)}, lambda p: contains(t, p))) > 0 THEN '{k}' END" for k, v in A.PRIORITIES.items())}], lambda x: x IS NOT NULL) AS priorities,
  nullif(regexp_extract(t, '(\\d{{1,2}})\\s*(?:year|yr)s?\\s*(?:term|tenure|plan)', 1), '') || ' years' AS tenure FROM r0)"""
_ALLP = _L(sorted(PRODUCTS)[:4])
_PLAN = f"""{_ANALYZE}, {_REQ},
p0 AS (SELECT an.*, rq.age, rq.objective, rq.age IS NULL AND sum_insured IS NULL AND objective IS NULL AND len(priorities) = 0 AND tenure IS NULL AS bare,
  CASE WHEN query_type = 'product_comparison' AND len(products) < 2 THEN CASE WHEN len(list_filter({_L(A.ALL_PRODUCTS_CUES)}, lambda c: contains(lower(query), c))) > 0 THEN {_ALLP} ELSE [] END WHEN len(products) > 0 THEN products[1:4] ELSE {_ALLP} END AS named,
  CASE WHEN len(criteria) > 0 THEN criteria ELSE {_L(A.DEFAULT_CRITERIA)} END AS cr FROM an JOIN rq USING (query_id)),
grid AS (SELECT query_id, (pi - 1) * len(cr) + ci AS step_id, named[pi] AS product, cr[ci] AS criterion, query_type, age, objective FROM p0, generate_series(1, len(named)) g(pi), generate_series(1, len(cr)) h(ci)
  WHERE (query_type = 'product_comparison' AND len(named) >= 2) OR (query_type = 'recommendation' AND NOT bare)),
ms AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(query, '\\s*(?:;|\\band\\b|\\?)\\s+', chr(1), 'g'), chr(1)), lambda s: trim(s, ' ?.')), lambda s: len(regexp_split_to_array(s, '\\s+')) >= 2) AS parts FROM p0 WHERE query_type = 'multi_step'),
ml AS (SELECT query_id, criteria, CASE WHEN len(parts) >= 2 THEN parts WHEN len(types) >= 2 THEN list_transform(types, lambda d: replace(d, '_', ' ') || ' for: ' || query) ELSE [query] END AS l FROM ms),
steps AS (
  SELECT query_id, step_id, criterion || ' — ' || product || CASE WHEN query_type = 'recommendation' AND ((criterion IN ('eligibility', 'coverage') AND age IS NOT NULL) OR (criterion = 'coverage' AND objective IS NOT NULL))
    THEN ' (' || concat_ws(', ', CASE WHEN age IS NOT NULL THEN 'age ' || age END, CASE WHEN criterion = 'coverage' THEN objective END) || ')' ELSE '' END AS query, product, criterion AS criteria FROM grid WHERE step_id <= 24
  UNION ALL SELECT query_id, i, l[i], NULL, array_to_string(criteria, '|') FROM ml, generate_series(1, len(l)) g(i)
  UNION ALL SELECT query_id, 1, query, NULL, array_to_string(criteria, '|') FROM p0 WHERE query_type NOT IN ('out_of_domain', 'product_comparison', 'recommendation', 'multi_step'))"""
_EXEC = f"""WITH {P.INDEX_SQL},
kws AS (SELECT query_id, doc_id, round(sum(qtf * idf * {P.NORM}), 9) AS score FROM qt JOIN ts USING (term) JOIN post USING (term), cs GROUP BY query_id, doc_id),
st AS (SELECT * FROM (VALUES (1, NULL), (2, 'src0'), (3, 'src1')) v(step_id, product)),
sh AS (SELECT query_id, step_id, doc_id, score, source, row_number() OVER (PARTITION BY query_id, step_id ORDER BY score DESC, doc_id) AS rank FROM kws JOIN documents USING (doc_id), st WHERE product IS NULL OR product = source),
ex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY step_id) AS n FROM sh WHERE rank <= 4) WHERE n = 1)"""
# Rule by rule: step 1 fetches its first hits; step 2 as many as are left of the
# room, less those that step 1 had; step 3 likewise.
def _budget_sql(lists: str, room: int, top: int) -> str:
    """bud (query_id, step_id, rank, doc_id, score) of ranked hits of three steps."""
    return f"""
b1 AS (SELECT * FROM {lists} WHERE step_id = 1 AND rank <= least({top}, {room})),
n1 AS (SELECT item_id AS query_id, (SELECT count(*) FROM b1 WHERE b1.query_id = item_id) AS n FROM benchmark),
b2 AS (SELECT l.* FROM {lists} l JOIN n1 ON l.query_id = n1.query_id WHERE step_id = 2 AND rank <= least({top}, {room} - n) AND NOT EXISTS (SELECT 1 FROM b1 WHERE b1.query_id = l.query_id AND b1.doc_id = l.doc_id)),
n2 AS (SELECT n1.query_id, n + (SELECT count(*) FROM b2 WHERE b2.query_id = n1.query_id) AS n FROM n1),
b3 AS (SELECT l.* FROM {lists} l JOIN n2 ON l.query_id = n2.query_id WHERE step_id = 3 AND rank <= least({top}, {room} - n) AND NOT EXISTS (SELECT 1 FROM b1 WHERE b1.query_id = l.query_id AND b1.doc_id = l.doc_id) AND NOT EXISTS (SELECT 1 FROM b2 WHERE b2.query_id = l.query_id AND b2.doc_id = l.doc_id)),
bud AS (SELECT * FROM b1 UNION ALL SELECT * FROM b2 UNION ALL SELECT * FROM b3)"""


_HYB = f"""WITH {P.INDEX_SQL},
st AS (SELECT * FROM (VALUES (1, NULL), (2, 'src0'), (3, 'src1')) v(step_id, product)),
kws AS (SELECT query_id, doc_id, round(sum(qtf * idf * {P.NORM}), 9) AS score FROM qt JOIN ts USING (term) JOIN post USING (term), cs GROUP BY query_id, doc_id),
sims AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round(list_dot_product(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(v.embedding, lambda x: CAST(x AS DOUBLE))), 9) AS score FROM embeddings v, embeddings q WHERE q.vec_id IN (SELECT item_id FROM benchmark)),
li AS (SELECT *, row_number() OVER (PARTITION BY src, query_id, step_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT src, query_id, step_id, doc_id, score FROM (SELECT 0 AS src, * FROM sims UNION ALL SELECT 1, * FROM kws) JOIN documents USING (doc_id), st WHERE product IS NULL OR product = source)),
fu AS (SELECT query_id, step_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, min(src * 1000 + rank) AS seen FROM li WHERE rank <= 20 GROUP BY query_id, step_id, doc_id),
fr AS (SELECT query_id, step_id, doc_id, score, row_number() OVER (PARTITION BY query_id, step_id ORDER BY score DESC, seen, doc_id) AS rank FROM fu)"""
_REPLY = "[CASE query_id % 4 WHEN 0 THEN 'exclusion' WHEN 3 THEN 'multi_step' END][1]"
_OPEN = lambda xs: f"{_L(xs)}"
_SAID = _turns_sql(_OPENINGS)
_KINDS = f"q AS (SELECT item_id AS query_id, {_L(_ASKED)}[item_id % {len(_ASKED)} + 1] || text AS query FROM benchmark)"
_KPLAN = _PLAN.replace(_Q, _KINDS).replace(_L(PRODUCTS), _L(SOURCES)).replace(_ALLP, _L(SOURCES))
_ROUTE = f"""{_KPLAN}, ns AS (SELECT query_id, count(*) AS n_steps FROM steps GROUP BY query_id),
rt AS (SELECT an.query_id, an.query, query_type, coalesce(n_steps, 0) AS n_steps, CASE WHEN query_type = 'out_of_domain' THEN 'out_of_domain' WHEN n_steps IS NULL THEN 'clarify' ELSE 'retrieve' END AS route FROM an LEFT JOIN ns ON an.query_id = ns.query_id),
ro AS (SELECT *, CASE WHEN route = 'clarify' THEN CASE WHEN query_type = 'product_comparison' THEN '{W.ASK_PRODUCTS}' ELSE '{W.ASK_NEEDS.replace("'", "''")}' END END AS ask FROM rt),
r1 AS (SELECT *, CASE WHEN route = 'out_of_domain' THEN '{W.OUT_OF_DOMAIN}' ELSE ask END AS short FROM ro)"""
_KRUN = f"""{_ROUTE}, {P.INDEX_SQL.replace("qt AS", "qt_unused AS")},
stq AS (SELECT query_id, step_id, term, count(*) AS qtf FROM (SELECT query_id, step_id, unnest({P.tok('query')}) AS term FROM steps) GROUP BY query_id, step_id, term),
sk AS (SELECT stq.query_id, step_id, doc_id, round(sum(qtf * idf * {P.NORM}), 9) AS score FROM stq JOIN ts USING (term) JOIN post USING (term), cs GROUP BY stq.query_id, step_id, doc_id),
sr AS (SELECT sk.*, row_number() OVER (PARTITION BY sk.query_id, sk.step_id ORDER BY score DESC, sk.doc_id) AS rank FROM sk JOIN steps ON sk.query_id = steps.query_id AND sk.step_id = steps.step_id JOIN documents d ON sk.doc_id = d.doc_id WHERE steps.product IS NULL OR steps.product = d.source),
so AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY step_id) AS first FROM sr WHERE rank <= 5) WHERE first = 1),
shown AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY step_id, rank) AS rank, doc_id, text FROM so JOIN documents USING (doc_id)),
s6 AS (SELECT query_id, rank, list_filter(list_transform(string_split(replace(trim(text), chr(10), ' '), '. '), lambda s: trim(s)), lambda s: length(s) >= 15)[1:2] AS l FROM shown WHERE rank <= 6),
pt AS (SELECT query_id, rank, array_to_string(list_transform(l, lambda s: regexp_replace(s, '\\.+$', '') || '. [' || rank || ']'), chr(10)) AS part FROM s6 WHERE len(l) > 0),
ea AS (SELECT r1.query_id, string_agg(part, chr(10) ORDER BY rank) AS answer FROM r1 LEFT JOIN pt ON r1.query_id = pt.query_id WHERE route = 'retrieve' GROUP BY r1.query_id),
ans AS (SELECT query_id, coalesce(answer, '{N.REFUSAL}') AS answer, answer IS NULL AS declined FROM ea),
ec AS (SELECT query_id, count(*) AS evidence_count FROM shown GROUP BY query_id),
um AS (SELECT DISTINCT query_id, CAST(unnest(regexp_extract_all(answer, '\\[(\\d{{1,2}})\\]', 1)) AS BIGINT) AS marker FROM ans),
nc AS (SELECT um.query_id, count(*) AS n_citations FROM um JOIN shown ON um.query_id = shown.query_id AND marker = rank GROUP BY um.query_id)"""
_SHOWN = f"WITH {P.INDEX_SQL}, {P.bm_sql(8)}, shown AS (SELECT query_id, rank, doc_id, text, source, source || ' — p. 1 — ' || lang AS label FROM kw JOIN documents USING (doc_id))"
_ANS = f"""{_SHOWN},
s6 AS (SELECT query_id, rank, list_filter(list_transform(string_split(replace(trim(text), chr(10), ' '), '. '), lambda s: trim(s)), lambda s: length(s) >= 15)[1:2] AS l FROM shown WHERE rank <= 6),
pt AS (SELECT query_id, rank, array_to_string(list_transform(l, lambda s: regexp_replace(s, '\\.+$', '') || '. [' || rank || ']'), chr(10)) AS part FROM s6 WHERE len(l) > 0),
ea AS (SELECT item_id AS query_id, string_agg(part, chr(10) ORDER BY rank) AS answer FROM benchmark LEFT JOIN pt ON item_id = query_id GROUP BY item_id),
ex AS (SELECT query_id, coalesce(answer, '{N.REFUSAL}') AS answer, answer IS NULL AS abstained FROM ea),
ans AS (SELECT query_id, answer || CASE query_id % 4 WHEN 0 THEN chr(10) || 'Key points:' || chr(10) || '- The limit is 77041 days in total. [1]' || chr(10) || '2. Nobody said this at all [19]' WHEN 1 THEN chr(10) || '**Summary:**' || chr(10) || 'It all holds together well. [1]' || chr(10) || 'So be it!' WHEN 2 THEN chr(10) || 'A claim without any source. And one more such claim here' ELSE '' END AS answer FROM ex)"""


def _claims_sql(answers: str) -> str:
    return f"""
ln AS (SELECT query_id, i AS line, trim(l[i]) AS t FROM (SELECT query_id, string_split(answer, chr(10)) AS l FROM {answers}), generate_series(1, len(l)) g(i) WHERE trim(l[i]) <> ''),
hd AS (SELECT *, trim(regexp_replace(trim(t, ' *'), ':+$', '')) AS title, regexp_matches(t, '^\\s*\\**\\s*[A-Za-z][A-Za-z /-]{{2,48}}:\\**\\s*$') AS head FROM ln),
sc AS (SELECT *, coalesce(last_value(CASE WHEN head THEN lower(title) END IGNORE NULLS) OVER (PARTITION BY query_id ORDER BY line ROWS UNBOUNDED PRECEDING), '') AS section FROM hd),
bd AS (SELECT query_id, line, section, regexp_replace(regexp_replace(t, '^\\d+\\.\\s+', ''), '^[-*•]\\s*', '') AS b FROM sc WHERE NOT head),
sg AS (SELECT query_id, line, section, j, s[j] AS seg FROM (SELECT *, CASE WHEN regexp_matches(b, '^[-*•]') THEN [b] ELSE string_split(regexp_replace(b, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) END AS s FROM bd), generate_series(1, len(s)) g(j)),
ow AS (SELECT *, trim(regexp_replace(seg, '\\[\\d{{1,2}}\\]', '', 'g'), ' *') AS own, list_transform(regexp_extract_all(seg, '\\[(\\d{{1,2}})\\]', 1), lambda m: CAST(m AS INT)) AS ms FROM sg),
gr AS (SELECT *, sum(CASE WHEN own <> '' OR j = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id, line ORDER BY j ROWS UNBOUNDED PRECEDING) AS g FROM ow),
mg AS (SELECT query_id, line, section, g, arg_min(own, j) AS text, flatten(list(ms ORDER BY j)) AS m0 FROM gr GROUP BY query_id, line, section, g),
cl AS (SELECT query_id, line, section, text, list_filter(m0, lambda x, i: list_position(m0, x) = i) AS markers, CASE WHEN len(list_filter({_L(V.CONCLUSIONS)}, lambda c: contains(section, c))) > 0 THEN 'conclusion' ELSE 'fact' END AS kind,
  row_number() OVER (PARTITION BY query_id ORDER BY line, g) AS claim_index FROM mg WHERE length(text) >= 12 AND regexp_matches(text, '\\p{{L}}'))"""


def _ct(x: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]{{3,}}')), lambda z: NOT list_contains({_L(GROUNDING_STOPWORDS)}, z))"


_NUM = "list_distinct(regexp_extract_all({0}, '\\b\\d+(?:\\.\\d+)?\\b'))"
_VER = f"""{_ANS}, {_claims_sql('ans')},
ev AS (SELECT query_id, rank AS marker, {_ct('text')} AS et, {_NUM.format('text')} AS en FROM shown),
ci AS (SELECT c.query_id, c.claim_index, c.ct, ev.et, ev.en FROM (SELECT query_id, claim_index, {_ct('text')} AS ct, unnest(markers) AS marker FROM cl) c JOIN ev ON c.query_id = ev.query_id AND c.marker = ev.marker),
cs2 AS (SELECT query_id, claim_index, max(CASE WHEN len(ct) = 0 THEN 0.0 WHEN len(list_intersect(ct, et)) <= 1 AND len(ct) > 1 THEN 0.0 ELSE len(list_intersect(ct, et)) / CAST(len(ct) AS DOUBLE) END) AS best, list_distinct(flatten(list(en))) AS seen FROM ci GROUP BY query_id, claim_index),
vr AS (SELECT cl.*, {_NUM.format('cl.text')} AS own, best, seen FROM cl LEFT JOIN cs2 USING (query_id, claim_index)),
vd AS (SELECT *, CASE WHEN kind = 'conclusion' THEN 'not_verified' WHEN best IS NULL THEN 'insufficient' WHEN len(own) > 0 AND len(seen) > 0 AND len(list_intersect(own, seen)) = 0 THEN 'contradicted' WHEN best >= 0.35 THEN 'supported' ELSE 'insufficient' END AS verdict FROM vr)"""
# every token of three characters, none dropped
_VER_ALL = _VER.replace(f", lambda z: NOT list_contains({_L(GROUNDING_STOPWORDS)}, z)", ", lambda z: true")
_KVER = f"""{_KRUN}, stood AS (SELECT query_id, answer FROM ans WHERE NOT declined), {_claims_sql('stood')},
ev AS (SELECT query_id, rank AS marker, {_ct('text').replace(f", lambda z: NOT list_contains({_L(GROUNDING_STOPWORDS)}, z)", ", lambda z: true")} AS et, {_NUM.format('text')} AS en FROM shown),
{_VER_ALL[_VER_ALL.index("ci AS ("):]}, pq AS (SELECT query_id, count(*) AS claims, count(*) FILTER (verdict = 'supported') AS supported, count(*) FILTER (verdict = 'contradicted') AS contradicted, count(*) FILTER (verdict = 'insufficient' AND kind = 'fact') AS insufficient,
  count(*) FILTER (kind = 'fact' AND verdict <> 'not_verified') AS facts, list(line) FILTER ((verdict = 'insufficient' AND kind = 'fact') OR verdict = 'contradicted') AS dropped FROM vd GROUP BY query_id),
rw AS (SELECT a.query_id, a.answer, declined, coalesce(claims, 0) AS claims, coalesce(supported, 0) AS supported, coalesce(contradicted, 0) AS contradicted, coalesce(insufficient, 0) AS insufficient, coalesce(facts, 0) AS facts, coalesce(dropped, []) AS dropped,
  coalesce(CAST(supported AS DOUBLE) / nullif(facts, 0), 0.0) AS rate, contains(lower(a.answer), 'do not contain this information') AS refused FROM ans a LEFT JOIN pq USING (query_id)),
fl AS (SELECT rw.*, claims = 0 AS silent, facts > 0 AND (supported = 0 OR rate < 0.5) AS weak, CASE WHEN coalesce(evidence_count, 0) = 0 THEN '{V.NO_EVIDENCE} ' ELSE '{V.NO_SUPPORT} ' END || CASE query_type {" ".join("WHEN '" + k + "' THEN '" + v.replace("'", "''") + "'" for k, v in V.QUESTIONS.items())} ELSE '{V.ANY_QUESTION}' END AS back,
  trim(array_to_string(list_filter(string_split(answer, chr(10)), lambda x, i: NOT list_contains(dropped, i) AND trim(x) <> ''), chr(10))) AS kept FROM rw JOIN r1 ON rw.query_id = r1.query_id LEFT JOIN ec ON rw.query_id = ec.query_id),
fi AS (SELECT *, NOT declined AND ((silent AND NOT refused) OR (NOT silent AND weak)) AS asks FROM fl)"""
# Verdicts on the answers that quote the dense hits, as the measure of the plain way.
_BASE = f"""{P.sem_sql(5)}, bs AS (SELECT query_id, rank, doc_id, text, source FROM sem JOIN documents USING (doc_id)),
b6 AS (SELECT query_id, rank, list_filter(list_transform(string_split(replace(trim(text), chr(10), ' '), '. '), lambda s: trim(s)), lambda s: length(s) >= 15)[1:2] AS l FROM bs),
bp AS (SELECT query_id, rank, array_to_string(list_transform(l, lambda s: regexp_replace(s, '\\.+$', '') || '. [' || rank || ']'), chr(10)) AS part FROM b6 WHERE len(l) > 0),
ba AS (SELECT item_id AS query_id, string_agg(part, chr(10) ORDER BY rank) AS a FROM benchmark LEFT JOIN bp ON item_id = query_id GROUP BY item_id),
bans AS (SELECT query_id, a AS answer FROM ba WHERE a IS NOT NULL)"""


def _record_sql(label: str, vd: str, abstained: str, query_type: str, steps: str, evidence: str, top: str, products: str, rate: str, stripped: str) -> str:
    """rec_<label>: the record of every question, from its parts."""
    return f"""
fc_{label} AS (SELECT query_id, count(*) FILTER (kind = 'fact') AS claims, count(*) FILTER (kind = 'fact' AND verdict = 'supported') AS supported, count(*) FILTER (kind = 'fact' AND verdict = 'contradicted') AS contradicted, count(*) FILTER (kind = 'fact' AND verdict = 'insufficient') AS insufficient FROM {vd} GROUP BY query_id),
r0_{label} AS (SELECT item_id AS query_id, CASE item_id % 3 WHEN 0 THEN 'comparison' WHEN 1 THEN 'coverage' ELSE 'factual' END AS category, coalesce((SELECT list(DISTINCT CAST(doc_id AS VARCHAR)) FROM qrels WHERE qrels.query_id = item_id), []) AS relevant_chunk_ids,
  {query_type} AS query_type, {abstained} AS abstained, {steps} AS n_steps, coalesce({evidence}, []) AS evidence_chunk_ids, coalesce({top}, []) AS retrieval_top_chunk_ids, coalesce({products}, []) AS evidence_products, {rate} AS given_rate,
  coalesce(claims, 0) AS claims, coalesce(supported, 0) AS supported, coalesce(contradicted, 0) AS contradicted, coalesce(insufficient, 0) AS insufficient FROM benchmark LEFT JOIN fc_{label} ON item_id = query_id),
r1_{label} AS (SELECT *, len(relevant_chunk_ids) > 0 AS answerable, 0 AS unresolved_citations, 0 AS contradicted_kept, {stripped} AS unsupported_stripped, coalesce(given_rate, coalesce(round(supported / CAST(nullif(claims, 0) AS DOUBLE), 4), 0.0)) AS supported_rate, claims = 0 AND NOT abstained AS degenerate, {"n_steps = 0 AND NOT abstained" if label == "full" else "false"} AS plan_empty FROM r0_{label}),
r_{label} AS (SELECT *, len(list_intersect(relevant_chunk_ids, evidence_chunk_ids)) AS hits, len(list_intersect(relevant_chunk_ids, CASE WHEN len(retrieval_top_chunk_ids) > 0 THEN retrieval_top_chunk_ids ELSE evidence_chunk_ids END)) AS seen, claims = 0 AND (NOT abstained OR degenerate) AS silent, insufficient + contradicted AS bad FROM r1_{label}),
rec_{label} AS (SELECT '{label}' AS label, *, list_filter([{', '.join(f'CASE WHEN {v} THEN {k!r} END' for k, v in CODES.items())}], lambda x: x IS NOT NULL) AS codes, NOT abstained AND answerable AND hits > 0 AS used FROM r_{label})"""


_ids = lambda rows, order: f"(SELECT list(CAST(doc_id AS VARCHAR) ORDER BY {order}) FROM {rows} WHERE query_id = item_id)"
_RECORDS = f"""WITH {_KVER}, {P.QRELS_SQL}, cit AS (SELECT um.query_id, marker, doc_id, source FROM um JOIN shown ON um.query_id = shown.query_id AND marker = rank JOIN documents USING (doc_id)),
{_record_sql('full', 'vd', "coalesce((SELECT declined OR silent OR weak FROM fi WHERE fi.query_id = item_id), true)", "(SELECT query_type FROM r1 WHERE r1.query_id = item_id)", "(SELECT n_steps FROM r1 WHERE r1.query_id = item_id)", "list_sort(list_distinct(" + _ids('cit', 'marker') + "))", _ids('cit', 'marker'), "(SELECT list(DISTINCT source ORDER BY source) FROM cit WHERE query_id = item_id AND source <> '')", "coalesce((SELECT round(rate, 4) FROM fi WHERE fi.query_id = item_id), 0.0)", "insufficient")}"""
_BASED = f"""WITH {_BASE}, {_claims_sql('bans')}, ev AS (SELECT query_id, rank AS marker, {_ct('text').replace(f", lambda z: NOT list_contains({_L(GROUNDING_STOPWORDS)}, z)", ", lambda z: true")} AS et, {_NUM.format('text')} AS en FROM bs), {_VER_ALL[_VER_ALL.index("ci AS ("):]}, {P.QRELS_SQL},
um AS (SELECT DISTINCT query_id, CAST(unnest(regexp_extract_all(answer, '\\[(\\d{{1,2}})\\]', 1)) AS BIGINT) AS marker FROM bans), cit AS (SELECT um.query_id, marker, doc_id FROM um JOIN bs ON um.query_id = bs.query_id AND marker = rank),
{_record_sql('baseline', 'vd', "(SELECT a IS NULL FROM ba WHERE ba.query_id = item_id)", "'policy_information'", "0", "coalesce(list_sort(list_distinct(" + _ids('cit', 'marker') + ")), " + _ids('bs', 'rank') + ")", _ids('bs', 'rank'), "(SELECT list(DISTINCT source ORDER BY source) FROM bs WHERE query_id = item_id AND source <> '')", "NULL", "insufficient + contradicted")}"""
_SHOWREC = "SELECT label, query_id, category, answerable, query_type, abstained, CAST(claims AS INT) AS claims, CAST(supported AS INT) AS supported, CAST(contradicted AS INT) AS contradicted, CAST(insufficient AS INT) AS insufficient, round(supported_rate, 3) AS supported_rate, CAST(unsupported_stripped AS INT) AS unsupported_stripped, array_to_string(evidence_chunk_ids, ',') AS evidence, array_to_string(retrieval_top_chunk_ids, ',') AS top, array_to_string(evidence_products, ',') AS products, used AS answered_with_relevant_evidence, array_to_string(codes, ',') AS codes, len(list_filter(codes, lambda x: x NOT IN ('F15', 'F16'))) > 0 AS failed FROM rec_"
_RATE = "SELECT '{0}' AS label, count(*) AS num_queries, count(*) FILTER (failed) AS num_failed, coalesce(round(count(*) FILTER (failed) / CAST(nullif(count(*), 0) AS DOUBLE), 4), 0.0) AS failure_rate FROM ({1})"
ORACLE = {
    "product_aliases": f"WITH {_NAMED} SELECT alias, product FROM al",
    "match_products": f"""WITH {_Q}, {_NAMED}, m AS (SELECT DISTINCT query_id, product FROM (SELECT query_id, lower(query) AS t FROM q) JOIN al ON CASE WHEN contains(t, alias) THEN regexp_matches(t, '(^|[^\\p{{L}}\\p{{Nd}}_])\\Q' || alias || '\\E($|[^\\p{{L}}\\p{{Nd}}_])') ELSE false END)
SELECT query_id, string_agg(product, '|' ORDER BY product) AS products FROM m GROUP BY query_id""",
    "analyze_queries": f"WITH {_ANALYZE} SELECT query_id, query_type, confidence, is_complex, array_to_string(criteria, '|') AS criteria, array_to_string(products, '|') AS products, array_to_string(matched, '|') AS matched_cues, array_to_string(types, '|') AS detected_types FROM an",
    "requirements": f"WITH {_Q}, {_REQ} SELECT query_id, age, sum_insured, objective, array_to_string(priorities, '|') AS priorities, tenure FROM rq",
    "plan_steps": f"WITH {_PLAN} SELECT query_id, CAST(step_id AS INT) AS step_id, query, product, criteria, CAST(5 AS INT) AS top_k FROM steps",
    "clarifications": f"WITH {_PLAN} SELECT query_id, query_type FROM an WHERE query_type <> 'out_of_domain' AND query_id NOT IN (SELECT query_id FROM steps)",
    "execute_plan": f"{_EXEC} SELECT query_id, step_id, rank, doc_id, round(score, 6) AS score FROM ex",
    "execute_budget": f"{_EXEC}, {_budget_sql('sh', 7, 4)} SELECT query_id, step_id, rank, doc_id, round(score, 6) AS score FROM bud",
    "execute_hybrid": f"{_HYB}, {_budget_sql('fr', 9, 4)} SELECT query_id, step_id, rank, doc_id, score FROM bud",
    "execute_hybrid_default": f"{_HYB}, {_budget_sql('fr', 80, 4)} SELECT query_id, step_id, rank, doc_id, score FROM bud",
    "refine_replies": f"""WITH {_ANALYZE}, {_REQ}, j AS (SELECT an.*, rq.age, rq.sum_insured, rq.priorities, confidence < 0.7 AND query_id % 4 IN (0, 3) AS turned FROM an JOIN rq USING (query_id))
SELECT query_id, CASE WHEN NOT turned THEN query_type WHEN query_id % 4 = 0 THEN 'exclusion' ELSE 'multi_step' END AS query_type, CASE WHEN turned THEN 0.7::DOUBLE ELSE confidence END AS confidence, CASE WHEN turned THEN query_id % 4 = 3 ELSE is_complex END AS is_complex,
CASE WHEN turned AND query_id % 4 = 0 THEN 'coverage' ELSE array_to_string(criteria, '|') END AS criteria, CASE WHEN turned AND query_id % 4 = 0 THEN 'X' ELSE array_to_string(products, '|') END AS products, array_to_string(CASE WHEN turned THEN matched || ['llm'] ELSE matched END, '|') AS matched_cues,
CASE WHEN turned AND query_id % 4 = 0 THEN coalesce(age, 41) ELSE age END AS age, CASE WHEN turned AND query_id % 4 = 0 THEN coalesce(sum_insured, '5 lakh') ELSE sum_insured END AS sum_insured, CASE WHEN turned AND query_id % 4 = 0 AND len(priorities) = 0 THEN 'p' ELSE array_to_string(priorities, '|') END AS priorities FROM j""",
    "analyze_conversations": f"WITH {_ANALYZE}, {_REQ} SELECT an.query_id, query_type, confidence, is_complex, array_to_string(criteria, '|') AS criteria, array_to_string(products, '|') AS products, age, sum_insured FROM an JOIN rq USING (query_id)".replace(_Q, _SAID),
    "plan_conversations": f"WITH {_PLAN} SELECT query_id, count(*) AS n_steps, count(DISTINCT product) AS n_products, CAST(sum(length(query)) AS BIGINT) AS chars FROM steps GROUP BY query_id".replace(_Q, _SAID),
    "pipeline_times": "SELECT label, count(*) AS n, true AS timed, true AS sums_agree, 0::BIGINT AS used FROM benchmark, (VALUES ('full'), ('baseline')) v(label) GROUP BY label",
    "answer_routes": f"WITH {_ROUTE} SELECT query_id, query_type, route, n_steps, md5(short) AS short_md5 FROM r1",
    "agent_answers": f"WITH {_KRUN} SELECT r1.query_id, query_type, route, md5(coalesce(short, answer)) AS final_md5, coalesce(declined, true) AS abstained, md5(ask) AS clarification_md5, coalesce(evidence_count, 0) AS evidence_count, coalesce(n_citations, 0) AS n_citations FROM r1 LEFT JOIN ans ON r1.query_id = ans.query_id LEFT JOIN ec ON r1.query_id = ec.query_id LEFT JOIN nc ON r1.query_id = nc.query_id",
    "answer_and_verify": f"""WITH {_KVER} SELECT r1.query_id, r1.query_type, r1.route, md5(coalesce(r1.short, CASE WHEN asks THEN 'I could not verify an answer. ' || back WHEN NOT declined AND insufficient + contradicted > 0 AND kept <> '' THEN kept ELSE answer END)) AS final_md5,
coalesce(declined OR silent OR weak, true) AS abstained, coalesce(ec.evidence_count, 0) AS evidence_count, coalesce(claims, 0) AS claims, coalesce(supported, 0) AS supported, coalesce(contradicted, 0) AS contradicted, coalesce(insufficient, 0) AS insufficient, coalesce(round(round(rate, 4), 3), 0.0) AS supported_rate
FROM r1 LEFT JOIN fi ON r1.query_id = fi.query_id LEFT JOIN ec ON r1.query_id = ec.query_id""",
    "pipeline_records": f"SELECT * FROM ({_RECORDS} {_SHOWREC}full) UNION ALL SELECT * FROM ({_BASED} {_SHOWREC}baseline)",
    "failure_rates": f"{_RATE.format('full', f'{_RECORDS} {_SHOWREC}full')} UNION ALL {_RATE.format('baseline', f'{_BASED} {_SHOWREC}baseline')}",
    "product_list": "SELECT source AS product, CAST(row_number() OVER (ORDER BY min(doc_id), source) AS INT) AS pos FROM documents WHERE source <> '' GROUP BY source",
    "api_responses": f"WITH {_KRUN} SELECT r1.query_id, md5(coalesce(short, answer)) AS answer_md5, query_type, CAST(coalesce(declined, true) AS VARCHAR) AS abstained, coalesce(evidence_count, 0) AS evidence_count, coalesce(n_citations, 0) AS citations, md5(ask) AS clarification_md5 FROM r1 LEFT JOIN ans ON r1.query_id = ans.query_id LEFT JOIN ec ON r1.query_id = ec.query_id LEFT JOIN nc ON r1.query_id = nc.query_id",
    "evidence_by_product": f"{_EXEC} SELECT query_id, source AS product, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY step_id, rank) AS doc_ids FROM ex GROUP BY query_id, source",
    "evidence_budget": f"""{_SHOWN}, bl AS (SELECT query_id, rank, doc_id, '[' || rank || '] Source: ' || label || chr(10) || CASE WHEN length(text) > 1200 THEN rtrim(left(text, 1200)) || '…' ELSE text END AS block FROM shown),
u AS (SELECT *, CAST(sum(length(block)) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used_chars FROM bl) SELECT query_id, rank, doc_id, used_chars, md5(block) AS block_md5 FROM u WHERE used_chars <= 6000 OR rank = 1""",
    "interleave_products": f"""{_SHOWN}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS turn, min(rank) OVER (PARTITION BY query_id, source) AS first FROM shown)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY turn, CASE WHEN source = 'src0' THEN 0 ELSE 1 END, first) AS marker, doc_id, source AS product FROM t""",
    "extractive_answer": f"{_ANS} SELECT query_id, md5(answer) AS answer_md5, abstained FROM ex",
    "claims": f"{_ANS}, {_claims_sql('ans')} SELECT query_id, claim_index, line, kind, section, md5(text) AS text_md5, array_to_string(markers, ',') AS markers FROM cl",
    "conversation_claims": f"WITH cv AS (SELECT conv_id * 1000 + turn AS query_id, text AS answer FROM conversations WHERE role = 'assistant'), {_claims_sql('cv')} SELECT query_id, count(*) AS claims, CAST(sum(length(text)) AS BIGINT) AS chars FROM cl GROUP BY query_id",
    "citations": f"{_ANS}, um AS (SELECT DISTINCT query_id, CAST(unnest(regexp_extract_all(answer, '\\[(\\d{{1,2}})\\]', 1)) AS BIGINT) AS marker FROM ans) SELECT um.query_id, marker, doc_id FROM um JOIN shown ON um.query_id = shown.query_id AND marker = rank",
    "unresolved_citations": f"{_ANS}, um AS (SELECT DISTINCT query_id, CAST(unnest(regexp_extract_all(answer, '\\[(\\d{{1,2}})\\]', 1)) AS BIGINT) AS marker FROM ans) SELECT um.query_id, marker FROM um LEFT JOIN shown ON um.query_id = shown.query_id AND marker = rank WHERE shown.rank IS NULL",
    "aligned_evidence": f"""{_ANS}, um AS (SELECT DISTINCT query_id, CAST(unnest(regexp_extract_all(answer, '\\[(\\d{{1,2}})\\]', 1)) AS BIGINT) AS marker FROM ans), ct AS (SELECT um.query_id, marker, doc_id FROM um JOIN shown ON um.query_id = shown.query_id AND marker = rank WHERE marker % 3 <> 1),
ev AS (SELECT query_id, unnest(range(1, max(marker) + 1)) AS marker FROM ct GROUP BY query_id) SELECT ev.query_id, ev.marker, ct.doc_id, md5(coalesce(d.text, '')) AS text_md5 FROM ev LEFT JOIN ct ON ev.query_id = ct.query_id AND ev.marker = ct.marker LEFT JOIN documents d ON ct.doc_id = d.doc_id""",
    "verify_claims": f"{_VER} SELECT query_id, claim_index, verdict, CASE WHEN kind <> 'conclusion' AND best IS NOT NULL THEN round(best, 4) ELSE 0.0 END AS support_score FROM vd",
    "verify_claims_all_words": f"{_VER_ALL} SELECT query_id, claim_index, verdict, CASE WHEN kind <> 'conclusion' AND best IS NOT NULL THEN round(best, 4) ELSE 0.0 END AS support_score FROM vd",
    "second_opinions": f"""{_VER}, rp AS (SELECT item_id AS query_id, [1, 2, item_id % 7, 4] AS ix, ['supported', 'contradicted', 'insufficient', 'supported'] AS vs FROM benchmark WHERE item_id % 3 <> 2),
sd AS (SELECT query_id, c, arg_max(v, i) AS said FROM (SELECT query_id, i, ix[i] AS c, vs[i] AS v FROM rp, generate_series(1, 4) g(i)) GROUP BY query_id, c)
SELECT vd.query_id, claim_index, CASE WHEN verdict = 'contradicted' AND said = 'supported' THEN 'supported' WHEN verdict = 'insufficient' AND said IS NOT NULL THEN said ELSE verdict END AS verdict FROM vd LEFT JOIN sd ON vd.query_id = sd.query_id AND vd.claim_index = sd.c""",
    "shape_response": f"""{_VER}, pq AS (SELECT query_id, count(*) AS claims, count(*) FILTER (verdict = 'supported') AS supported, count(*) FILTER (verdict = 'contradicted') AS contradicted, count(*) FILTER (verdict = 'insufficient' AND kind = 'fact') AS insufficient,
  count(*) FILTER (kind = 'fact' AND verdict <> 'not_verified') AS facts, list(line) FILTER ((verdict = 'insufficient' AND kind = 'fact') OR verdict = 'contradicted') AS dropped FROM vd GROUP BY query_id),
rw AS (SELECT a.query_id, a.answer, coalesce(claims, 0) AS claims, coalesce(supported, 0) AS supported, coalesce(contradicted, 0) AS contradicted, coalesce(insufficient, 0) AS insufficient, coalesce(facts, 0) AS facts, coalesce(dropped, []) AS dropped,
  coalesce(CAST(supported AS DOUBLE) / nullif(facts, 0), 0.0) AS rate, contains(lower(a.answer), 'do not contain this information') AS refused FROM ans a LEFT JOIN pq USING (query_id)),
fl AS (SELECT *, claims = 0 AS silent, facts > 0 AND (supported = 0 OR rate < 0.5) AS weak, '{V.NO_SUPPORT} ' || CASE WHEN query_id % 2 = 0 THEN '{V.QUESTIONS["coverage"]}' ELSE '{V.ANY_QUESTION}' END AS back,
  trim(array_to_string(list_filter(string_split(answer, chr(10)), lambda x, i: NOT list_contains(dropped, i) AND trim(x) <> ''), chr(10))) AS kept FROM rw),
fi AS (SELECT *, (silent AND NOT refused) OR (NOT silent AND weak) AS asks FROM fl)
SELECT query_id, md5(CASE WHEN asks THEN 'I could not verify an answer. ' || back WHEN insufficient + contradicted > 0 AND kept <> '' THEN kept ELSE answer END) AS final_md5, silent OR weak AS abstained, round(round(rate, 4), 3) AS supported_rate, claims, supported, contradicted, insufficient, CASE WHEN asks THEN back END AS clarification FROM fi""",
}
