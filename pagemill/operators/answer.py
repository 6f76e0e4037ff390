"""Questions to answers: analysis, plan, retrieval, generation, verification and
response, for all questions of a batch at once. Which way a question takes is a
column, not control flow."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.config import EngineConfig
from pagemill.functions.text import citation_label
from pagemill.operators import agent, evaluate, generate, ground, retrieve
from pagemill.operators.index import TermIndex
from pagemill.sources.store import keep

#: A list of products up to this length is matched in one stage, without an index.
FEW_PRODUCTS = 100

# Answers to questions that are never retrieved for.
OUT_OF_DOMAIN = (
    "This question is outside the insurance policy knowledge base I support. I can only answer from the ingested insurance policy documents — "
    "for example coverage, exclusions, waiting periods, eligibility and product comparisons."
)
ASK_PRODUCTS = "Which policies would you like me to compare? Please name at least two (for example, the Digit Health Insurance Policy and Elevate)."
ASK_NEEDS = (
    "To recommend a policy I need the applicant's age and the cover you care about (for example hospitalization or maternity). Any priority such as a "
    "low waiting period or a lower premium also helps."
)

#: (queries, evidence) to (query_id, answer, abstained[, usage]), usage being a
#: map of counters. evidence: query_id, rank, doc_id, text, label, product, block.
Generator = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class Corpus:
    """What questions are asked of: docs (doc_id, text and product_col; also
    document_id, chunk_type, filename, page_start, page_end, section,
    clause_ids where it has them), its index, and, for hybrid retrieval,
    vectors and a function that gives (query_id, step_id, embedding) of steps."""

    docs: DataFrame
    index: TermIndex
    product_col: str
    products: list[str]
    vectors: DataFrame | None = None
    embed_steps: Callable[[DataFrame], DataFrame] | None = None
    reranker: object | None = None
    cfg: EngineConfig = field(default_factory=EngineConfig)


def analyze(queries: DataFrame, corpus: Corpus) -> DataFrame:
    names = queries.sparkSession.createDataFrame([(p,) for p in corpus.products], "product string")
    found = agent.match_products(queries, agent.product_aliases(names), len(corpus.products) <= FEW_PRODUCTS)
    return agent.analyze(queries, found, corpus.cfg.agent)


def route(analysis: DataFrame, steps: DataFrame) -> DataFrame:
    """analysis with route (out_of_domain, clarify or retrieve) and, for the
    first two, their answer; the second's is a question back."""
    n = steps.groupBy("query_id").agg(F.count("*").alias("n_steps"))
    rows = analysis.join(n, "query_id", "left").withColumn("n_steps", F.coalesce("n_steps", F.lit(0)))
    way = F.when(F.col("query_type") == "out_of_domain", "out_of_domain").when(F.col("n_steps") == 0, "clarify").otherwise("retrieve")
    ask = F.when(F.col("query_type") == "product_comparison", ASK_PRODUCTS).otherwise(ASK_NEEDS)
    return rows.withColumn("route", way).withColumn("clarification", F.when(F.col("route") == "clarify", ask)).withColumn("short_answer", F.when(F.col("route") == "out_of_domain", OUT_OF_DOMAIN).otherwise(F.col("clarification")))


def label_of(docs: DataFrame, product_col: str) -> Column:
    has = lambda c, kind: F.col(c).cast(kind) if c in docs.columns else F.lit(None).cast(kind)
    return citation_label(F.col(product_col), has("filename", "string"), F.col("doc_id").cast("string"), has("page_start", "int"), has("page_end", "int"), has("section", "string"), has("clause_ids", "array<string>"))


def evidence(steps: DataFrame, corpus: Corpus) -> DataFrame:
    """(query_id, rank, doc_id, text, label, product): what the steps' hits
    say, numbered in the order of steps."""
    step_vectors = corpus.embed_steps(steps) if corpus.vectors is not None and corpus.embed_steps is not None else None
    hits = agent.execute(steps, corpus.index, corpus.docs, corpus.product_col, corpus.cfg.agent, corpus.cfg.retrieval, corpus.vectors, step_vectors, corpus.reranker)
    numbered = hits.select("query_id", "doc_id", F.row_number().over(Window.partitionBy("query_id").orderBy("step_id", "rank")).alias("rank"))
    return numbered.join(corpus.docs.select("doc_id", "text", F.col(corpus.product_col).cast("string").alias("product"), label_of(corpus.docs, corpus.product_col).alias("label")), "doc_id")


def extractive(cfg: EngineConfig) -> Generator:
    return lambda queries, shown: generate.extractive_answers(queries, shown, cfg.generation)


def by_model(model) -> Generator:
    """A generator of a text model: a function of an iterator of pandas frames
    (query_id, query, prompt) to frames (query_id, answer[, prompt_tokens,
    completion_tokens]). It is shown blocks within a budget, in turns of one a
    product for questions that compare. Tokens that it doesn't count are counted
    as words."""

    def counted(frames):
        for f in model(frames):
            yield f.reindex(columns=["query_id", "answer", "prompt_tokens", "completion_tokens"]).astype({"prompt_tokens": "Int64", "completion_tokens": "Int64"})

    def answers(queries: DataFrame, shown: DataFrame) -> DataFrame:
        asked = generate.prompts(queries, shown, queries.where("compares").select("query_id", "products", "criteria"))
        made = asked.mapInPandas(counted, "query_id long, answer string, prompt_tokens long, completion_tokens long")
        out = queries.select("query_id").join(made, "query_id", "left").join(asked.select("query_id", "prompt"), "query_id", "left")
        words = lambda c: F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")).cast("long")
        used = F.create_map(F.lit("calls"), F.lit(1).cast("long"), F.lit("prompt_tokens"), F.coalesce("prompt_tokens", words("prompt")), F.lit("completion_tokens"), F.coalesce("completion_tokens", words("answer")))
        return out.select("query_id", F.coalesce("answer", F.lit(generate.REFUSAL)).alias("answer"), (F.col("answer").isNull() | generate.is_refusal(F.col("answer"))).alias("abstained"), used.alias("usage"))

    answers.blocks = True
    return answers


def blocks_of(routed: DataFrame, found: DataFrame, cfg: EngineConfig) -> DataFrame:
    """What a model is shown of the evidence, numbered as it is shown."""
    asks = routed.select("query_id", "products", F.col("query_type").isin("product_comparison", "recommendation").alias("compares"))
    rows = found.join(asks.select("query_id", "compares"), "query_id")
    wanted = asks.where("compares").select("query_id", F.posexplode("products").alias("pos", "product"))
    plain = generate.evidence_blocks(rows.where("not compares").drop("compares"), cfg.generation)
    turns = generate.comparison_blocks(rows.where("compares").drop("compares"), wanted, cfg.generation)
    return plain.unionByName(turns.select(*plain.columns))


@dataclass(frozen=True)
class Run:
    """The tables of a batch: analysis with routes, steps, evidence, answers
    (query_id, answer, abstained) of retrieved questions, citations, what
    generation used (query_id, usage), and how many ms each component took."""

    routed: DataFrame
    steps: DataFrame
    shown: DataFrame
    answers: DataFrame
    citations: DataFrame
    usage: DataFrame | None = None
    ms: dict[str, float] = field(default_factory=dict)


def timed(ms: dict[str, float], component: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What make() gives, a table that it writes; the time goes to ms."""
    begin = time.perf_counter()
    out = make()
    ms[component] = ms.get(component, 0.0) + (time.perf_counter() - begin) * 1000
    return out


NO_USE = {"calls": 0, "prompt_tokens": 0, "completion_tokens": 0}


def with_measures(records: DataFrame, ms: dict[str, float], retrieved: DataFrame, usage: DataFrame | None) -> DataFrame:
    """records with latency_ms and usage. A batch is worked on as a whole, so a
    question's time in a component is the component's, shared by the questions
    that went through it: analysis by all, the others by those retrieved for
    (query_id). The shares add up to what was measured."""
    ids = retrieved.select(F.col("query_id").cast("string").alias("qid"), F.lit(True).alias("_in"))
    n, inside = records.count(), ids.count()
    part = lambda c: F.lit(ms.get(c, 0.0) / max(n, 1)) if c == "analysis" else F.when(F.col("_in"), ms.get(c, 0.0) / max(inside, 1))
    latency = F.create_map(*[x for c in ms for x in (F.lit(c), part(c))])
    none = F.create_map(*[F.lit(x) if isinstance(x, str) else F.lit(x).cast("long") for kv in NO_USE.items() for x in kv])
    rows = records.join(ids, "qid", "left").withColumn("latency_ms", F.map_filter(latency, lambda k, v: v.isNotNull()))
    if usage is None:
        return rows.withColumn("usage", none).drop("_in")
    used = usage.select(F.col("query_id").cast("string").alias("qid"), "usage")
    return rows.join(used, "qid", "left").withColumn("usage", F.coalesce("usage", none)).drop("_in")


def run(queries: DataFrame, corpus: Corpus, generator: Generator | None = None, k: int | None = None) -> Run:
    """Analysis, plan, retrieval and generation. Questions out of domain and
    those to clarify reach neither retrieval nor the generator."""
    cfg, ms = corpus.cfg, {}
    analysis = timed(ms, "analysis", lambda: keep(analyze(queries, corpus), "analysis"))
    steps = timed(ms, "analysis", lambda: keep(agent.plan(analysis, corpus.products, k or cfg.retrieval.default_k, cfg.agent), "steps"))
    routed = route(analysis, steps)
    # what is shown and answered is a few rows a question that much starts from
    shown = timed(ms, "retrieval", lambda: keep(evidence(steps, corpus), "evidence"))
    if getattr(generator, "blocks", False):
        shown = timed(ms, "generation", lambda: keep(blocks_of(routed, shown, cfg), "blocks"))
    asked = routed.where("route = 'retrieve'").select("query_id", "query", "products", "criteria", F.col("query_type").isin("product_comparison", "recommendation").alias("compares"))
    answers = timed(ms, "generation", lambda: keep((generator or extractive(cfg))(asked, shown), "answers"))
    usage = answers.select("query_id", "usage") if "usage" in answers.columns else None
    answers = answers.drop("usage")
    return Run(routed, steps, shown, answers, generate.citations(answers, shown), usage, ms)


RESPONSE = ["query_id", "query", "query_type", "route", "answer", "final_answer", "abstained", "clarification", "products", "criteria", "evidence_count", "n_citations", "claims", "supported", "contradicted", "insufficient", "supported_rate", "notes"]


def _counts(r: Run) -> DataFrame:
    n = r.shown.groupBy("query_id").agg(F.count("*").alias("evidence_count"))
    c = r.citations.groupBy("query_id").agg(F.count("*").alias("n_citations"))
    rows = r.routed.select("query_id", "query", "query_type", "route", "short_answer", "clarification", "products", "criteria")
    for t in (n, c):
        rows = rows.join(t, "query_id", "left")
    return rows.withColumn("evidence_count", F.coalesce("evidence_count", F.lit(0)).cast("long")).withColumn("n_citations", F.coalesce("n_citations", F.lit(0)).cast("long"))


def unverified(r: Run) -> DataFrame:
    """Responses without a claim check: short answers as they are, else what
    was generated."""
    rows = _counts(r).join(r.answers.select("query_id", F.col("answer").alias("_a"), F.col("abstained").alias("_b")), "query_id", "left")
    none = {"claims": "long", "supported": "long", "contradicted": "long", "insufficient": "long"}
    rows = rows.withColumn("answer", F.coalesce("short_answer", "_a")).withColumn("final_answer", F.col("answer")).withColumn("abstained", F.coalesce("_b", F.lit(True)))
    for c, t in none.items():
        rows = rows.withColumn(c, F.lit(0).cast(t))
    return rows.withColumn("supported_rate", F.lit(0.0)).withColumn("notes", F.expr("cast(array() as array<string>)")).select(*RESPONSE)


def claims_of(r: Run, corpus: Corpus, second=None) -> DataFrame:
    """Verdicts on the claims of answers that the generator stands by, against
    what they cite; second (as ground.second_opinion's model) judges pending
    ones again."""
    cfg = corpus.cfg.grounding
    stood = r.answers.where("not abstained").select("query_id", "answer")
    aligned = generate.aligned_evidence(r.citations, corpus.docs, corpus.cfg.generation)
    found = timed(r.ms, "verification", lambda: keep(ground.verify(ground.claims(stood, cfg), aligned, cfg), "verdicts"))
    if second is None or not cfg.second_pass:
        return found
    # a model is asked once: all that needs its verdicts reads them
    return timed(r.ms, "verification", lambda: keep(ground.second_opinion(found, second), "opinions"))


def verified(r: Run, corpus: Corpus, second=None, checked: DataFrame | None = None) -> DataFrame:
    """Responses with their claims checked: unsupported lines go, weak answers
    give way to a question back, short answers and refusals pass. checked:
    claims_of() the run, if they are known."""
    checked = claims_of(r, corpus, second) if checked is None else checked
    rows = _counts(r)
    said = r.answers.join(rows.select("query_id", "query_type", "evidence_count"), "query_id")
    shaped = ground.shape(said, checked, corpus.cfg.grounding)
    took = r.answers.select("query_id", F.col("answer").alias("_a")).join(shaped.withColumnRenamed("abstained", "_b").withColumnRenamed("clarification", "_c"), "query_id")
    rows = rows.join(took, "query_id", "left").withColumn("answer", F.coalesce("short_answer", "_a")).withColumn("final_answer", F.coalesce("short_answer", "final_answer")).withColumn("abstained", F.coalesce("_b", F.lit(True))).withColumn("clarification", F.coalesce("clarification", "_c"))
    for c in ("claims", "supported", "contradicted", "insufficient"):
        rows = rows.withColumn(c, F.coalesce(c, F.lit(0)).cast("long"))
    return rows.withColumn("supported_rate", F.coalesce("supported_rate", F.lit(0.0))).withColumn("notes", F.coalesce("notes", F.expr("cast(array() as array<string>)"))).select(*RESPONSE)


def full_records(eval_set: DataFrame, corpus: Corpus, label: str = "full", generator: Generator | None = None, second=None, k: int | None = None) -> DataFrame:
    """evaluate.run_records() of the whole pipeline. eval_set: query_id, query,
    category, relevant."""
    r = run(eval_set.select("query_id", "query"), corpus, generator, k)
    checked = claims_of(r, corpus, second)
    said = verified(r, corpus, second, checked).join(r.routed.select("query_id", "n_steps"), "query_id")
    records = evaluate.run_records(label, eval_set, said, checked, r.citations, corpus.docs.select("doc_id", F.col(corpus.product_col).alias("product")))
    return with_measures(records, r.ms, r.answers, r.usage)


def baseline_records(eval_set: DataFrame, query_vectors: DataFrame, corpus: Corpus, label: str = "baseline", generator: Generator | None = None, k: int | None = None) -> DataFrame:
    """The same of the plain way: dense retrieval, one answer, and the rules'
    verdicts on it as a measure only."""
    cfg = corpus.cfg
    ms: dict[str, float] = {}
    hits = retrieve.dense(query_vectors, corpus.vectors, k or cfg.retrieval.default_k)
    found = timed(ms, "retrieval", lambda: keep(hits.select("query_id", "rank", "doc_id").join(corpus.docs.select("doc_id", "text", F.col(corpus.product_col).cast("string").alias("product"), label_of(corpus.docs, corpus.product_col).alias("label")), "doc_id"), "retrieved"))
    answers = timed(ms, "generation", lambda: keep((generator or extractive(cfg))(eval_set.select("query_id", "query"), found), "answers"))
    usage = answers.select("query_id", "usage") if "usage" in answers.columns else None
    answers = answers.drop("usage")
    stood = answers.where("not abstained").select("query_id", "answer")
    checked = timed(ms, "verification", lambda: keep(ground.verify(ground.claims(stood, cfg.grounding), found.select("query_id", F.col("rank").alias("marker"), "text"), cfg.grounding), "verdicts"))
    said = answers.select("query_id", F.lit("policy_information").alias("query_type"), "abstained", F.lit(None).cast("string").alias("clarification"), F.col("answer").alias("final_answer"), F.lit(0).alias("n_steps"), F.lit(0.0).alias("supported_rate"))
    records = evaluate.run_records(label, eval_set, said, checked, generate.citations(answers, found), corpus.docs.select("doc_id", F.col(corpus.product_col).alias("product")), found.select("query_id", "rank", "doc_id"))
    return with_measures(records, ms, answers, usage)


def respond(responses: DataFrame, cited: DataFrame | None = None, mode: str = "extractive") -> DataFrame:
    """(query_id, body): each response as the JSON object that a service
    returns: citations numbered from 1, counts under `grounding`, the answer
    the final one where there is one."""
    rows = responses
    if cited is None:
        rows = rows.withColumn("_l", F.expr("cast(array() as array<struct<marker:int,doc_id:string>>)"))
    else:
        lists = cited.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("marker", F.col("doc_id").cast("string").alias("doc_id")))).alias("_l"))
        rows = rows.join(lists, "query_id", "left")
    each = F.transform(F.coalesce("_l", F.expr("cast(array() as array<struct<marker:int,doc_id:string>>)")), lambda x, i: F.struct((i + 1).alias("n"), x["marker"].alias("marker"), x["doc_id"].alias("chunk_id")))
    grounding = F.struct("supported", "contradicted", "insufficient", F.col("claims").alias("total"), F.col("notes").alias("note"))
    answer = F.coalesce(F.nullif("final_answer", F.lit("")), "answer", F.lit(""))
    body = F.struct("query", answer.alias("answer"), "query_type", F.lit(mode).alias("llm_mode"), "products", "criteria", each.alias("citations"), "abstained", "clarification", grounding.alias("grounding"), "evidence_count")
    return rows.select("query_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("body"))
