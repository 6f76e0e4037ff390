"""Query analysis by rules, requirements, product matching, planning and execution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.config import AgentConfig, RetrievalConfig
from pagemill.functions.text import count_cues, words_of
from pagemill.operators.index import TermIndex
from pagemill.operators.phrases import as_words, occurrences
from pagemill.operators.retrieve import bm25, hybrid

# Phrases that mark what a question asks for.
CUES = {
    "waiting_period": ["waiting period", "wait period", "waiting time", "moratorium", "pre-existing", "pre existing"],
    "exclusion": ["exclusion", "exclude", "excluded", "not covered", "does not cover", "will not cover", "is not covered", "not payable", "not reimbursable"],
    "eligibility": ["eligib", "entry age", "age limit", "who can buy", "can i buy", "minimum age", "maximum age", "renewal age", "age criteria"],
    "coverage": [
        "cover", "coverage", "benefit", "payable", "reimburse", "sum insured", "room rent", "ambulance", "maternity", "ayush", "day care",
        "critical illness", "organ donor", "domiciliary", "consumable", "deductible", "restoration", "cashless", "pre-hospitalization", "post-hospitalization",
    ],
    "policy_information": ["what is", "how do", "how does", "how many", "when ", "where ", "who ", "definition", "means", "policy wording"],
    "product_comparison": ["compare", "comparison", "versus", " vs ", "which is better", "which one is better", "difference between", "better than"],
    "recommendation": ["recommend", "suggest", "best policy", "best plan", "which policy should", "which plan should", "best for me", "suitable for", "should i buy"],
}
# Words of the domain, and of what lies outside.
DOMAIN_TERMS = [
    "insurance", "policy", "premium", "claim", "insured", "insurer", "hospital", "hospitalisation", "hospitalization", "network", "cashless", "tpa",
    "irdai", "sum insured", "cover", "coverage", "benefit", "waiting", "exclusion", "exclude", "deductible", "co-payment", "copayment", "renewal",
    "portability", "migration", "nomination", "grievance", "ombudsman", "scheme", "free look", "grace period", "moratorium", "room rent", "sub-limit",
    "sub limit", "maternity", "ayush", "cataract", "pre-existing", "pre existing", "restoration", "recharge", "bonus", "treatment", "medical", "expense",
    "ambulance", "organ", "disease", "illness", "injury", "surgery", "eligib", "disclosure", "fraud", "day care",
]
OUT_OF_DOMAIN = [
    "stock market", "share price", "cricket", "weather forecast", "recipe", "capital of", "who won", "python code", "write a function", "javascript",
    "football", "movie", "cryptocurrency", "bitcoin",
]
# What a criterion is called, the criteria taken by default, and
# words for goals and priorities.
CRITERIA = {
    "coverage": ["cover", "coverage", "benefit"],
    "eligibility": ["eligib", "age"],
    "exclusions": ["exclusion", "exclude", "excluded"],
    "waiting period": ["waiting", "moratorium", "pre-existing"],
    "benefits": ["benefit", "benefits"],
    "limitations": ["limit", "sub-limit", "sub limit", "cap"],
}
DEFAULT_CRITERIA = ["coverage", "waiting period", "exclusions", "eligibility"]
RECOMMENDED_CRITERIA = ["coverage", "eligibility", "waiting period"]
ALL_PRODUCTS_CUES = ["all", "these", "every", "various", "different", "the policies", "the plans", "policies"]
OBJECTIVES = ["hospitalization", "maternity", "critical illness", "day care", "ayush", "organ donor", "ambulance", "domiciliary", "opd"]
PRIORITIES = {
    "low waiting period": ["low waiting period", "shorter waiting", "short waiting", "low waiting"],
    "cheaper premium": ["cheaper premium", "low premium", "affordable premium", "lower premium"],
    "higher sum insured": ["higher sum insured", "high sum insured", "larger cover"],
    "fewer exclusions": ["fewer exclusions", "less exclusions", "minimal exclusions"],
}
# Words that name no product.
ALIAS_STOPWORDS = ["policy", "insurance", "health", "general", "the", "and", "of", "ltd", "limited", "company"]
#: Families a question can combine, in order of precedence.
FAMILIES = ["waiting_period", "exclusion", "eligibility", "coverage"]


def product_list(docs: DataFrame, product_col: str, order: str | None = None) -> DataFrame:
    """(product, pos) of the products that docs name, each once: by name, or in
    the order in which they first appear by `order`."""
    named = docs.where(F.coalesce(F.col(product_col).cast("string"), F.lit("")) != "").groupBy(F.col(product_col).cast("string").alias("product"))
    found = named.agg((F.min(order) if order else F.lit(0)).alias("_first"))
    return found.withColumn("pos", F.row_number().over(Window.orderBy("_first", "product"))).select("product", "pos")  # a row a product


def product_aliases(products: DataFrame) -> DataFrame:
    """(alias, product) of (product): the whole name, its words of four letters
    or more, its first two of these; none that two products share."""
    base = F.trim(F.regexp_replace(F.lower("product"), r"\s+", " "))
    stop = words_of(ALIAS_STOPWORDS)
    rows = products.where("product <> ''").select("product").distinct().withColumn("base", base)
    words = F.filter(F.regexp_extract_all("base", F.lit("[a-z0-9]+"), 0), lambda t: (F.length(t) >= 4) & ~F.array_contains(stop, t))
    pair = F.when(F.size("w") >= 2, F.concat(F.get("w", F.lit(0)), F.lit(" "), F.get("w", F.lit(1))))
    named = rows.withColumn("w", words).select("product", F.explode(F.array_compact(F.array_distinct(F.concat(F.array("base"), F.col("w"), F.array(pair))))).alias("alias"))
    return named.groupBy("alias").agg(F.min("product").alias("product"), F.count_distinct("product").alias("n")).where("n = 1 and alias <> ''").select("alias", "product")


def match_products(queries: DataFrame, aliases: DataFrame, few: bool = False) -> DataFrame:
    """(query_id, products) whose aliases stand as words in the query. Aliases
    are met by their rarest tokens; with `few`, for lists that the caller knows
    to be short, every query meets every alias instead."""
    said = queries.select("query_id", F.lower("query").alias("query"))
    if few:
        found = said.join(F.broadcast(aliases), as_words(F.col("query"), F.col("alias")))
    else:
        found = occurrences(said, "query_id", "query", aliases, "alias")
    return found.select("query_id", "product").distinct().groupBy("query_id").agg(F.sort_array(F.collect_list("product")).alias("products"))


def requirements(query: Column) -> Column:
    """struct(age, sum_insured, objective, priorities, tenure) of a question."""
    t = F.lower(query)
    age = lambda p: F.expr("try_cast({} as int)".format("null")) if p is None else F.nullif(F.regexp_extract(t, p, 1), F.lit("")).cast("int")
    ages = F.array(age(r"(\d{1,3})\s*[-\s]?years?[-\s]?old"), age(r"\baged?\s*(?:of|:)?\s*(\d{1,3})\b"))
    amount = F.regexp_extract(query, r"(?i)(\d+(?:\.\d+)?)\s*(?:lakhs?|lac|crore|cr)\b", 1)
    unit = F.lower(F.regexp_extract(query, r"(?i)\d+(?:\.\d+)?\s*(lakhs?|lac|crore|cr)\b", 1))
    tenure = F.regexp_extract(t, r"(\d{1,2})\s*(?:year|yr)s?\s*(?:term|tenure|plan)", 1)
    return F.struct(
        F.get(F.filter(ages, lambda a: (a > 0) & (a < 120)), F.lit(0)).alias("age"),
        F.when(amount != "", F.concat(amount, F.when(unit.startswith("cr"), " crore").otherwise(" lakh"))).alias("sum_insured"),
        F.get(F.filter(words_of(OBJECTIVES), lambda o: t.contains(o)), F.lit(0)).alias("objective"),
        F.array_compact(F.array(*[F.when(F.exists(words_of(v), lambda p: t.contains(p)), F.lit(k)) for k, v in PRIORITIES.items()])).alias("priorities"),
        F.when(tenure != "", F.concat(tenure, F.lit(" years"))).alias("tenure"),
    )


def _criteria(text: Column, whole_words: bool) -> Column:
    def named(words: list[str]) -> Column:
        if whole_words:
            return text.rlike("|".join(rf"\b{w}" for w in words if w not in ("age", "cap")) + (r"|\bage\b" if "age" in words else "") + (r"|\bcap\b" if "cap" in words else ""))
        return F.exists(words_of(words), lambda w: text.contains(w))

    return F.array_compact(F.array(*[F.when(named(v), F.lit(k)) for k, v in CRITERIA.items()]))


def analyze(queries: DataFrame, products: DataFrame | None = None, cfg: AgentConfig | None = None) -> DataFrame:
    """(query_id, query, query_type, confidence, is_complex, criteria, products,
    matched_cues, detected_types, requirements): counts of cues decide. products
    (query_id, products) adds those that a query names."""
    cfg = cfg or AgentConfig()
    none = F.expr("cast(array() as array<string>)")
    rows = queries if products is None else queries.join(products, "query_id", "left")
    if products is None:
        rows = rows.withColumn("products", none)
    rows = rows.withColumn("products", F.coalesce("products", none)).withColumn("_t", F.concat(F.lit(" "), F.lower("query"), F.lit(" ")))
    t = F.col("_t")
    for k, cues in CUES.items():
        rows = rows.withColumn(f"n_{k}", count_cues(t, cues))
    n = {k: F.col(f"n_{k}") for k in CUES}
    rows = rows.withColumn("n_product_comparison", n["product_comparison"] + F.when(F.size("products") >= 2, 1).otherwise(0))
    cues = sum((n[k] for k in [*FAMILIES, "product_comparison", "recommendation"]), F.lit(0))
    ood = (F.size("products") == 0) & (cues == 0) & ((count_cues(t, OUT_OF_DOMAIN) > 0) | (count_cues(t, DOMAIN_TERMS) == 0))
    positive = F.array_compact(F.array(*[F.when(n[k] > 0, F.lit(k)) for k in FAMILIES]))
    several = F.size(positive) >= 2
    top = F.greatest(*[n[k] for k in [*FAMILIES, "policy_information"]])
    best = F.lit("waiting_period")
    for k in reversed([*FAMILIES, "policy_information"]):
        best = F.when((n[k] == top) & (top > 0), F.lit(k)).otherwise(best)
    compared, advised = n["product_comparison"] > 0, n["recommendation"] > 0
    kind = F.when(ood, "out_of_domain").when(compared, "product_comparison").when(advised, "recommendation").when(several, "multi_step").otherwise(best)
    cap = lambda c: F.least(F.lit(1.0), c)
    strong = sum((n[k] for k in [*FAMILIES, "policy_information"]), F.lit(0))
    conf = (
        F.when(ood, 0.6)
        .when(compared, cap(0.55 + 0.15 * n["product_comparison"]))
        .when(advised, cap(0.55 + 0.15 * n["recommendation"]))
        .when(several, cap(0.5 + 0.1 * strong))
        .when(top > 0, cap(0.45 + 0.15 * top))
        .otherwise(0.3)
    )
    noted = [*FAMILIES, "product_comparison", "recommendation"]
    matched = F.array_compact(F.array(*[F.when(n[k] > 0, F.concat(F.lit(f"{k}:"), n[k].cast("string"))) for k in noted]))
    detected = F.array_compact(F.array(*[F.when(n[k] > 0, F.lit(k)) for k in noted]))
    found = _criteria(t, cfg.word_boundary)
    criteria = F.when(ood, none).when(~compared & advised & (F.size(found) == 0), words_of(RECOMMENDED_CRITERIA)).otherwise(found)
    types = F.when(ood, none).when(compared | advised, detected).when(several, positive).when(top > 0, F.array(best)).otherwise(none)
    return rows.select(
        "query_id",
        "query",
        kind.alias("query_type"),
        F.round(conf, 4).alias("confidence"),
        (~ood & (compared | advised | several)).alias("is_complex"),
        criteria.alias("criteria"),
        "products",
        matched.alias("matched_cues"),
        types.alias("detected_types"),
        requirements(F.col("query")).alias("requirements"),
    )


def refine(analysis: DataFrame, model, cfg: AgentConfig | None = None) -> DataFrame:
    """analysis with unsure rows (confidence below the threshold) judged again
    by model, a function of an iterator of pandas frames (query_id, query) to
    frames (query_id, query_type, confidence); what it doesn't return, or where
    it fails to name a type, stays as the rules have it."""
    cfg = cfg or AgentConfig()
    unsure = analysis.where(F.col("confidence") < cfg.llm_confidence_threshold).select("query_id", "query")
    new = unsure.mapInPandas(model, "query_id long, query_type string, confidence double").where(F.col("query_type").isin("out_of_domain", "multi_step", *CUES))
    new = new.select("query_id", F.col("query_type").alias("_q"), F.col("confidence").alias("_c"))
    return analysis.join(new, "query_id", "left").withColumn("query_type", F.coalesce("_q", "query_type")).withColumn("confidence", F.coalesce("_c", "confidence")).drop("_q", "_c")


REPLY = "query_type string, criteria array<string>, products array<string>, requirements struct<age:double,sum_insured:string,coverage_objective:string,priorities:array<string>>"


def json_object(raw: Column) -> Column:
    """What stands from the first brace to the last of a reply, null if none."""
    return F.nullif(F.regexp_extract(F.coalesce(raw, F.lit("")), r"(?s)\{.*\}", 0), F.lit(""))


def refine_with_replies(analysis: DataFrame, replies: DataFrame, cfg: AgentConfig | None = None) -> DataFrame:
    """analysis with the rows that replies (query_id, raw) judge anew, where
    their confidence is below the threshold. A reply is a JSON object somewhere
    in a text; one that can't be read, or that names no known type, changes
    nothing. What the rules found of a person's requirements stays, the rest is
    taken; criteria and products are the reply's where it has any."""
    cfg = cfg or AgentConfig()
    said = replies.select("query_id", F.from_json(json_object(F.col("raw")), REPLY).alias("_j")).where("_j is not null").withColumn("_t", F.lower(F.trim("_j.query_type"))).where(F.col("_t").isin("out_of_domain", "multi_step", *CUES))
    rows = analysis.join(said, "query_id", "left").withColumn("_on", F.col("_t").isNotNull() & (F.col("confidence") < cfg.llm_confidence_threshold))
    known = F.filter("_j.criteria", lambda c: F.array_contains(words_of(list(CRITERIA)), c))
    some = lambda new, old: F.when(F.col("_on") & (F.coalesce(F.size(new), F.lit(0)) > 0), new).otherwise(old)
    pick = lambda old, new: F.when(F.col("_on"), F.coalesce(old, new)).otherwise(old)
    r, j = F.col("requirements"), F.col("_j.requirements")
    needs = F.struct(
        pick(r["age"], j["age"].cast("int")).alias("age"),
        pick(r["sum_insured"], F.nullif(j["sum_insured"], F.lit(""))).alias("sum_insured"),
        pick(r["objective"], F.nullif(j["coverage_objective"], F.lit(""))).alias("objective"),
        F.when(F.col("_on") & (F.size(r["priorities"]) == 0), F.coalesce(j["priorities"], r["priorities"])).otherwise(r["priorities"]).alias("priorities"),
        r["tenure"].alias("tenure"),
    )
    complex_ = F.col("_t").isin("product_comparison", "recommendation", "multi_step")
    return rows.select(
        "query_id",
        "query",
        F.when(F.col("_on"), F.col("_t")).otherwise(F.col("query_type")).alias("query_type"),
        F.when(F.col("_on"), F.lit(cfg.llm_confidence)).otherwise(F.col("confidence")).alias("confidence"),
        F.when(F.col("_on"), complex_).otherwise(F.col("is_complex")).alias("is_complex"),
        some(known, F.col("criteria")).alias("criteria"),
        some(F.col("_j.products"), F.col("products")).alias("products"),
        F.when(F.col("_on"), F.array_append("matched_cues", F.lit("llm"))).otherwise(F.col("matched_cues")).alias("matched_cues"),
        "detected_types",
        needs.alias("requirements"),
    )


def plan(analysis: DataFrame, products: list[str], k: int = 5, cfg: AgentConfig | None = None) -> DataFrame:
    """(query_id, step_id, query, product, criteria, top_k) steps; questions out
    of domain or to be clarified have none."""
    cfg = cfg or AgentConfig()
    everything = words_of(sorted(products)[: cfg.max_products]) if products else F.expr("cast(array() as array<string>)")
    r = F.col("requirements")
    bare = r["age"].isNull() & r["sum_insured"].isNull() & r["objective"].isNull() & (F.size(r["priorities"]) == 0) & r["tenure"].isNull()
    wants_all = F.exists(words_of(ALL_PRODUCTS_CUES), lambda c: F.lower("query").contains(c))
    compared = F.col("query_type") == "product_comparison"
    named = F.when(compared & (F.size("products") < 2), F.when(wants_all & F.lit(len(products) >= 2), everything).otherwise(F.expr("cast(array() as array<string>)"))).when(F.size("products") > 0, F.slice("products", 1, cfg.max_products)).otherwise(everything)
    criteria = F.when(F.size("criteria") > 0, F.col("criteria")).otherwise(words_of(DEFAULT_CRITERIA))
    advised = (F.col("query_type") == "recommendation") & ~bare
    extra = lambda c: F.array_compact(F.array(F.when(advised & c.isin("eligibility", "coverage") & r["age"].isNotNull(), F.concat(F.lit("age "), r["age"].cast("string"))), F.when(advised & (c == "coverage"), r["objective"])))
    text = lambda c, p: F.concat(c, F.lit(" — "), p, F.when(F.size(extra(c)) > 0, F.concat(F.lit(" ("), F.array_join(extra(c), ", "), F.lit(")"))).otherwise(""))
    grid = F.slice(F.flatten(F.transform(named, lambda p: F.transform(criteria, lambda c: F.struct(text(c, p).alias("query"), p.alias("product"), F.array(c).alias("criteria"))))), 1, cfg.max_steps)
    parts = F.filter(F.transform(F.split("query", r"\s*(?:;|\band\b|\?)\s+"), lambda s: F.btrim(s, F.lit(" ?."))), lambda s: F.size(F.split(s, r"\s+")) >= 2)
    facets = F.transform("detected_types", lambda d: F.concat(F.replace(d, F.lit("_"), F.lit(" ")), F.lit(" for: "), F.col("query")))
    many = F.when(F.size(parts) >= 2, parts).when(F.size(facets) >= 2, facets).otherwise(F.array("query"))
    free = lambda q: F.struct(q.alias("query"), F.lit(None).cast("string").alias("product"), F.col("criteria").alias("criteria"))
    none = F.slice(grid, 1, 0)
    steps = (
        F.when(F.col("query_type") == "out_of_domain", none)
        .when(compared, F.when(F.size(named) >= 2, grid).otherwise(none))
        .when(F.col("query_type") == "recommendation", F.when(bare, none).otherwise(grid))
        .when(F.col("query_type") == "multi_step", F.slice(F.transform(many, free), 1, cfg.max_steps))
        .otherwise(F.array(free(F.col("query"))))
    )
    return analysis.select("query_id", F.posexplode(steps).alias("i", "s")).select("query_id", (F.col("i") + 1).alias("step_id"), "s.query", "s.product", "s.criteria", F.lit(k).alias("top_k"))


def needs_clarification(analysis: DataFrame, steps: DataFrame) -> DataFrame:
    """Questions in domain that a plan has no step for."""
    return analysis.where("query_type <> 'out_of_domain'").join(steps.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "query_type")


def execute(steps: DataFrame, index: TermIndex, docs: DataFrame, product_col: str, cfg: AgentConfig | None = None, rcfg: RetrievalConfig | None = None, vectors: DataFrame | None = None, step_vectors: DataFrame | None = None, reranker=None) -> DataFrame:
    """(query_id, step_id, rank, doc_id, score): every step's hits, in the order
    of steps, a document in the first step that has it.

    Step by step a query may fetch min(top_k, what is left of
    max_evidence_chunks) hits; those that a step before had are dropped after
    that and leave their room to later steps. Steps may name a product, a
    document_id and a chunk_type (columns of docs; null asks for none).

    All steps of all queries are scored in one join on terms and, where
    vectors and step_vectors (query_id, step_id, embedding) are given, one
    dense search for each pool size, max(candidate_k, top_k) of a step as a
    single search has it; what a step asks for restricts the scored rows by
    equi-joins before they are ranked. Where less than top_k is left of the
    room, the first of the same ranking are taken.
    """
    cfg, rcfg = cfg or AgentConfig(), rcfg or RetrievalConfig()
    wants = {"product": product_col, "document_id": "document_id", "chunk_type": "chunk_type"}
    wants = {w: c for w, c in wants.items() if w in steps.columns and c in docs.columns}
    flat = steps.withColumn("sid", F.struct("query_id", "step_id"))
    wanting = [F.col(w).cast("string").alias(f"want_{w}") for w in wants]
    by_step = flat.select(F.col("sid").alias("query_id"), "query", F.greatest(F.col("top_k").cast("int"), F.lit(0)).alias("top_k"), *wanting)
    asked = flat.select(F.col("sid").alias("query_id"), *wanting)
    match = [(f"want_{w}", f"has_{w}") for w in wants]
    have = docs.select("doc_id", *[F.col(c).cast("string").alias(f"has_{w}") for w, c in wants.items()])

    def only(scored: DataFrame) -> DataFrame:
        rows = scored.join(asked, "query_id").join(have, "doc_id")
        for w in wants:
            rows = rows.where(F.col(f"want_{w}").isNull() | (F.col(f"want_{w}") == F.col(f"has_{w}")))
        return rows.select(*scored.columns)

    # a step's pool follows from its own top_k, never from the room for evidence
    room, wanted = cfg.max_evidence_chunks, sorted(r.top_k for r in by_step.select("top_k").distinct().collect())
    if vectors is None or step_vectors is None:
        hits = bm25(by_step, index, max(wanted, default=0), rcfg, only=only, match=match, attributes=have).select("query_id", "doc_id", "rank", "score")
    else:
        asked_vectors = step_vectors.select(F.struct("query_id", "step_id").alias("query_id"), "embedding").join(asked, "query_id")
        hits = None
        for pool in sorted({max(rcfg.candidate_k, k) for k in wanted} or {rcfg.candidate_k}):
            own = by_step.where(F.greatest("top_k", F.lit(rcfg.candidate_k)) == pool)
            found = hybrid(own, asked_vectors.join(own.select("query_id"), "query_id", "left_semi"), index, vectors, rcfg, pool, reranker, only=only, match=match, attributes=have if wants else None)
            found = found.select("query_id", "doc_id", "rank", F.col("rerank_score" if reranker is not None else "fused_score").alias("score"))
            hits = found if hits is None else hits.unionByName(found)
    lists = hits.select("query_id.query_id", "query_id.step_id", F.struct("rank", "doc_id", "score").alias("h")).groupBy("query_id", "step_id").agg(F.array_sort(F.collect_list("h")).alias("hits"))
    ordered = steps.select("query_id", "step_id", "top_k").join(lists, ["query_id", "step_id"]).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("step_id", "top_k", "hits"))).alias("steps"))

    def fetch(state, step):
        seen = F.transform(state, lambda x: x["doc_id"])
        left = F.greatest(F.lit(room) - F.size(state), F.lit(0))
        fresh = F.filter(F.slice(step["hits"], 1, F.least(step["top_k"].cast("int"), left)), lambda h: ~F.array_contains(seen, h["doc_id"]))
        return F.concat(state, F.transform(fresh, lambda h: F.struct(step["step_id"].alias("step_id"), h["rank"].alias("rank"), h["doc_id"].alias("doc_id"), h["score"].alias("score"))))

    none = F.transform(F.slice(F.get("steps", F.lit(0))["hits"], 1, 0), lambda h: F.struct(F.get("steps", F.lit(0))["step_id"].alias("step_id"), h["rank"].alias("rank"), h["doc_id"].alias("doc_id"), h["score"].alias("score")))
    return ordered.select("query_id", F.explode(F.aggregate("steps", none, fetch)).alias("x")).select("query_id", "x.*")


def by_product(hits: DataFrame, docs: DataFrame, product_col: str) -> DataFrame:
    """Each query's evidence grouped by product, in order."""
    rows = hits.join(docs.select("doc_id", F.col(product_col).alias("product")), "doc_id")
    return rows.groupBy("query_id", "product").agg(F.transform(F.array_sort(F.collect_list(F.struct("step_id", "rank", "doc_id"))), lambda x: x["doc_id"]).alias("doc_ids"))
