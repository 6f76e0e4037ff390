"""Entry points end to end, on fixtures."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

import pagemill
from pagemill import engine
from pagemill.config import AgentConfig, EngineConfig, GroundingConfig, RetrievalConfig
from pagemill.functions import pages as H
from pagemill.operators import agent, answer, evaluate, generate, ground, index, ingest, retrieve
from pagemill.sources import io, store
from pagemill.streaming import logs

TEXT = {
    "Aurora Shield": "Cataract surgery has a waiting period of 24 months. Room rent is covered up to 5000 rupees a day.",
    "Borealis Plan": "Maternity is covered after a waiting period of 36 months. Dental treatment is excluded from all cover.",
}


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.createDataFrame([(i, t, p, f"D{i}") for i, (p, t) in enumerate(TEXT.items(), 1)], "doc_id long, text string, product string, document_id string")
    return answer.Corpus(docs, index.build_terms(docs), "product", sorted(TEXT))


@pytest.fixture
def queries(spark):
    return spark.createDataFrame(
        [(1, "What is the waiting period for cataract surgery?"), (2, "Who won the cricket match?"), (3, "recommend something"), (4, "Compare Aurora Shield and Borealis Plan on waiting period"), (5, "compare prices"), (6, "Is zyzzyx covered by xylophone cover?")],
        "query_id long, query string",
    )


def test_responses_of_all_routes(corpus, queries):
    got = {r.query_id: r for r in engine.answer_and_verify(queries, corpus).collect()}
    assert got[2].route == "out_of_domain" and got[2].final_answer == answer.OUT_OF_DOMAIN and got[2].abstained
    assert got[3].clarification == answer.ASK_NEEDS == got[3].final_answer and got[5].clarification == answer.ASK_PRODUCTS
    assert got[1].route == "retrieve" and "24 months" in got[1].final_answer and not got[1].abstained and got[1].supported_rate == 1.0
    assert got[4].query_type == "product_comparison" and got[4].evidence_count == 2 and got[4].products == ["Aurora Shield", "Borealis Plan"]
    plain = {r.query_id: r for r in engine.answer_queries(queries, corpus).collect()}
    assert plain[1].claims == 0 and plain[1].answer == got[1].answer and plain[2].final_answer == answer.OUT_OF_DOMAIN
    run = answer.run(queries, corpus)
    body = {r.query_id: json.loads(r.body) for r in answer.respond(answer.verified(run, corpus), run.citations).collect()}
    assert body[1]["citations"][0]["n"] == 1 and body[1]["grounding"]["total"] == got[1].claims and body[2]["citations"] == []
    analyses, steps = engine.analyze_queries(queries, corpus)
    assert analyses.count() == 6 and steps.where("query_id in (2, 3, 5)").count() == 0


def test_a_model_answers_and_gives_second_opinions(spark, corpus, queries):
    def model(frames):
        for f in frames:
            assert not f["query_id"].isin([2, 3, 5]).any() and f["prompt"].str.contains("Question: ").all()
            yield pd.DataFrame({"query_id": f["query_id"], "answer": ["The moon is made of cheese today. [1]"] * len(f)})

    def judge(frames):
        for f in frames:
            yield pd.DataFrame({"query_id": f["query_id"], "claim_index": f["claim_index"], "verdict": ["Supported "] * len(f)})

    by = answer.by_model(model)
    weak = {r.query_id: r for r in engine.answer_and_verify(queries, corpus, by).collect()}
    assert weak[1].abstained and weak[1].insufficient == 1 and weak[1].final_answer.startswith("I could not verify")
    firm = {r.query_id: r for r in engine.answer_and_verify(queries, corpus, by, judge).collect()}
    assert not firm[1].abstained and firm[1].supported == 1
    off = answer.Corpus(corpus.docs, corpus.index, "product", corpus.products, cfg=EngineConfig(grounding=GroundingConfig(second_pass=False)))
    assert engine.answer_and_verify(queries.where("query_id = 1"), off, by, judge).first().insufficient == 1


def test_prompts(spark, corpus):
    claims = spark.createDataFrame([(1, 1, "A claim", [1], "insufficient"), (1, 2, "Other", [], "supported"), (2, 1, "Fine", [1], "supported")], "query_id long, claim_index int, text string, markers array<int>, verdict string")
    shown = spark.createDataFrame([(1, 1, 7, "x" * 600), (2, 1, 8, "y")], "query_id long, marker int, doc_id long, text string")
    got = ground.opinion_prompts(claims, shown).collect()
    assert len(got) == 1 and "[1] (7)\n" + "x" * 500 + "…" in got[0].prompt and "CLAIM 1: A claim (cites: [1])\nCLAIM 2: Other (cites: none)" in got[0].prompt
    replies = spark.createDataFrame([(1, "claim 1 - SUPPORTED\nCLAIM 1: contradicted"), (2, None)], "query_id long, raw string")
    assert [tuple(r) for r in ground.parse_verdicts(replies).collect()] == [(1, 1, "contradicted")]
    hits = spark.createDataFrame([(1, "A", i, "la", f"t{i}" * 900) for i in range(1, 4)] + [(1, "B", i, "lb", "u") for i in range(4, 6)], "query_id long, product string, rank int, label string, text string")
    blocks = generate.comparison_blocks(hits).orderBy("rank").collect()
    assert [b.product for b in blocks] == ["A", "B", "A", "B", "A"] and blocks[0].block.startswith("[1] Source: la")
    wanted = spark.createDataFrame([(1, ["A", "B"], [])], "query_id long, products array<string>, criteria array<string>")
    text = generate.prompts(spark.createDataFrame([(1, "why?")], "query_id long, query string"), generate.comparison_blocks(hits), wanted).first().prompt
    assert text.startswith("Compare: A, B\nBy: (as asked)") and "Question: why?" in text


def test_executor_takes_what_is_left(spark, corpus):
    docs = spark.createDataFrame([(i, "same words here" + " more" * (i % 3), "p", "t1" if i % 2 else "t2") for i in range(10)], "doc_id long, text string, product string, chunk_type string")
    ix = index.build_terms(docs)
    steps = spark.createDataFrame([(1, 1, "same words", None, 4, None), (1, 2, "same words", None, 4, "t1"), (1, 3, "more", "p", 9, None), (2, 1, "zzz", None, 4, None), (2, 2, "words", "q", 4, None), (2, 3, "words", "p", 2, None)], "query_id long, step_id int, query string, product string, top_k int, chunk_type string")
    got = agent.execute(steps, ix, docs, "product", AgentConfig(max_evidence_chunks=6)).collect()
    one = [(r.step_id, r.doc_id) for r in sorted((r for r in got if r.query_id == 1), key=lambda r: (r.step_id, r.rank))]
    first = [d for s, d in one if s == 1]
    assert len(first) == 4 and len(one) <= 6
    # step 2 may fetch two of type t1; those that step 1 had are lost, not replaced
    ranked = [r.doc_id for r in retrieve.bm25(spark.createDataFrame([(1, "same words")], "query_id long, query string"), ix, 10).orderBy("rank").collect() if r.doc_id % 2]
    assert [d for s, d in one if s == 2] == [d for d in ranked[:2] if d not in first]
    assert sorted(r.step_id for r in got if r.query_id == 2) == [3, 3]


def test_replies_are_read_where_they_can_be(spark):
    a = agent.analyze(spark.createDataFrame([(i, "tell me of premium") for i in range(5)], "query_id long, query string"))
    raw = ['x {"query_type": "EXCLUSION", "requirements": {"age": 30.0}} y', "{broken", '{"query_type": "nothing"}', None, "[]"]
    r = {x.query_id: x for x in agent.refine_with_replies(a, spark.createDataFrame(list(enumerate(raw)), "query_id long, raw string")).collect()}
    assert r[0].query_type == "exclusion" and r[0].confidence == 0.7 and r[0].requirements.age == 30 and r[0].matched_cues[-1] == "llm"
    assert {r[i].query_type for i in (1, 2, 3, 4)} == {a.first().query_type}


def test_ingestion_to_search(spark, tmp_path):
    rows = []
    for d in ("/c/b.pdf", "/c/a.pdf", "/c/z.pdf"):
        for p in (1, 2, 3):
            rows.append((d, p, "k0", "Star Health and Allied", [0.0, 10.0, 300.0, 20.0], 800.0))
            rows.append((d, p, "k1", f"A. COVERAGE TERMS part {p}", [0.0, 200.0, 300.0, 210.0], 800.0))
            rows.append((d, p, "k2", f"Benefit number {p} of {'a different file' if d == '/c/z.pdf' else 'the file'} is payable in full.", [0.0, 300.0, 300.0, 310.0], 800.0))
    extracted = spark.createDataFrame(rows, "path string, page_number int, block_id string, text string, bbox array<double>, page_height double")
    files = spark.createDataFrame([(d,) for d in ("/c/b.pdf", "/c/a.pdf", "/c/z.pdf", "/c/lost.pdf")], "path string")
    out = f"file://{tmp_path}/corpus"
    got = engine.ingest_blocks(extracted, files, out)
    reg = {r.path: r for r in got.registry.collect()}
    assert [reg[f"/c/{n}.pdf"].document_id for n in ("a", "b", "lost", "z")] == ["DOC-001", "DOC-002", "DOC-003", "DOC-004"]
    assert reg["/c/b.pdf"].duplicate_of == "DOC-001" and reg["/c/a.pdf"].insurer.startswith("Star Health")
    status = {r["document_id"]: r["status"] for r in spark.read.json(f"{out}/registry").collect()}
    assert status == {"DOC-001": "success", "DOC-002": "success", "DOC-003": "failed", "DOC-004": "success"}
    assert got.blocks.where("is_repeated").count() == 9 and not got.chunks.where("text like '%Star Health%'").count()
    assert {r.document_id: r.pages for r in got.report.collect()}["DOC-003"] == 0
    terms, vectors = engine.build_index(got.chunks, out)
    docs = got.chunks.withColumnRenamed("chunk_id", "doc_id")
    hits = engine.search(spark.createDataFrame([(1, "benefit payable different")], "query_id long, query string"), terms, None, None, docs, EngineConfig(retrieval=RetrievalConfig(mode="keyword", rerank="lexical")), 2, {"document_id": "DOC-004"}).collect()
    assert hits and all(h.doc_id.startswith("DOC-004") for h in hits) and vectors.count() == docs.count()
    stats = index.index_stats(terms, vectors, got.chunks).first()
    assert stats.document_ids == ["DOC-001", "DOC-002", "DOC-004"]


def test_records_checkpoint_and_report(spark, corpus, queries, tmp_path):
    e = queries.withColumn("category", F.lit("c")).withColumn("relevant", F.when(F.col("query_id") != 2, F.array(F.lit("1")))).withColumn("pos", F.col("query_id"))
    v = index.hashed_vectors(corpus.docs).withColumnRenamed("chunk_id", "doc_id")
    qv = index.hashed_vectors(queries.withColumnRenamed("query", "text"), "query_id").withColumnRenamed("chunk_id", "query_id")
    dense = answer.Corpus(corpus.docs, corpus.index, "product", corpus.products, v)
    asked = []

    def full(part):
        asked.append(sorted(r.query_id for r in part.collect()))
        return answer.full_records(part.drop("pos"), corpus)

    runners = {"full": full, "baseline": lambda part: answer.baseline_records(part.drop("pos"), qv.join(part.select("query_id"), "query_id", "left_semi"), dense)}
    path = f"file://{tmp_path}/done"
    first = engine.evaluate_pipelines(e, runners, path, limit=3)
    assert first.count() == 6
    both = engine.evaluate_pipelines(e, runners, path)
    assert asked == [[1, 2, 3], [4, 5, 6]] and both.count() == 12
    one = {(r.label, r.qid): r for r in both.collect()}
    assert one["full", "1"].answered_with_relevant_evidence and one["full", "2"].answerable is False and one["baseline", "1"].query_type == "policy_information"
    text = engine.report(spark, both, f"{tmp_path}/report", "Run")
    assert text.startswith("# Run") and "| full |" in text and json.loads((tmp_path / "report.json").read_text())["rates"][0]["num_queries"] == 12
    grid = engine.ablate(lambda c: answer.full_records(e.drop("pos"), answer.Corpus(corpus.docs, corpus.index, "product", corpus.products, cfg=c)), overlays={"default": {}, "no_strip": evaluate.PIPELINE_OVERLAYS["no_strip"]})
    assert {r.label for r in grid.collect()} == {"default", "no_strip"}
    assert all(r.retrieval_ms > 0 and r.verification_ms > 0 and r.mean_ms > 0 and r.calls == 0 for r in grid.collect())
    assert "## components" in text and "| full | retrieval |" in text.replace("  ", " ")
    assert set(pagemill.__all__) <= set(dir(pagemill))


def test_page_functions(spark):
    t = spark.createDataFrame([("a\tb\nc\td and some more text here to be long",), ("x\n     y\n          zz and some more text to be long enough",), ("1. Clause\nTITLE LINE",), ("short",), (None,)], "t string")
    got = [tuple(r) for r in t.select(H.table_method(F.col("t")), H.table_method(F.col("t"), True), H.has_clauses(F.col("t")), H.has_heading_line(F.col("t"))).collect()]
    assert got == [("tab_separated", "tab_separated", False, False), (None, "aligned_columns", False, False), (None, None, True, True), (None, None, False, False), (None, None, False, False)]
    m = spark.createDataFrame([({"a": "1", "b": None}, ["F1", None])], "m map<string,string>, f array<string>")
    r = m.select(H.without_nulls(F.col("m")).alias("m"), H.font_list(F.col("f")).alias("f")).first()
    assert r.m == {"a": "1"} and [(x.name, x.size) for x in r.f] == [("F1", 12.0), ("unknown", 12.0)]
    p = spark.createDataFrame([("d", i, f"page {i}") for i in range(1, 9)], "document_id string, page_number int, text string")
    c = ingest.cover_texts(p).first()
    assert c.cover_text.split("\n") == [f"page {i}" for i in (1, 2, 3, 4, 5, 8)] and c.first_text == "page 1\npage 2"
    n = ingest.numbered(spark.createDataFrame([(f"p{i * 7919 % 1000:04}",) for i in range(900)], "path string"), "path", 8)
    rows = sorted((r.n, r.path) for r in n.collect())
    assert [r[0] for r in rows] == list(range(1, 901)) and [r[1] for r in rows] == sorted(r[1] for r in rows)
    boxes = spark.createDataFrame([("d", 1, "b", [5.4, 9.6]), ("d", 1, "a", [100.0, 2.0]), ("d", 1, "c", [1.0, 10.4])], "document_id string, page_number int, block_id string, bbox array<double>")
    assert [r.block_id for r in ingest.reading_order(boxes).orderBy("reading_order").collect()] == ["a", "c", "b"]


def test_sinks(spark, tmp_path):
    path = f"file://{tmp_path}"
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, v string")
    assert io.write_json(df, f"{path}/j") == 2
    assert io.open_table(spark, f"{path}/t", "id long, v string").count() == 0
    df.write.mode("append").parquet(f"{path}/t")
    assert io.open_table(spark, f"{path}/t", "id long, v string").count() == 2
    io.reset(spark, f"{path}/t")
    io.reset(spark, f"{path}/t")
    assert not store.exists(spark, f"{path}/t")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "id long, v string, at int")
    got = {r.id: r.v for r in io.upsert(df.withColumn("at", F.lit(0)), new, "id", "at").collect()}
    assert got == {1: "a", 2: "y", 3: "z"}
    rows = spark.createDataFrame([("c1", "t", "", "1,2", 0.25, 3, 4), ("c2", "t", "S", "", 0.5, 0, 0)], "chunk_id string, context_text string, section string, clause_ids string, distance double, page_start int, page_end int")
    h = {r.chunk_id: r for r in io.hits_of_store(rows).collect()}
    assert h["c1"].clause_ids == ["1", "2"] and h["c1"].section is None and h["c1"].similarity == 0.75 and h["c2"].clause_ids == []
    assert json.loads(io.as_json(df, "id").where("id = 2").first().body) == {"id": 2, "v": None}
    blocks = spark.createDataFrame([("d1", 1, 0, "t"), ("d2", 1, 0, "u")], "document_id string, page_number int, reading_order int, text string")
    io.write_documents(blocks, f"{path}/docs", 2)
    assert spark.read.json(f"{path}/docs").count() == 2
    store.write_text(spark, f"{path}/note", "one")
    store.write_text(spark, f"{path}/note", "two")
    assert store.read_text(spark, f"{path}/note") == "two" and store.read_text(spark, f"{path}/none") is None


def test_incremental_index_keeps_whole_versions(spark, tmp_path):
    base, src = f"file://{tmp_path}/ix", tmp_path / "in"
    src.mkdir()
    df = lambda rows: spark.createDataFrame(rows, "chunk_id long, text string")
    run = logs.maintain_index(spark, spark.readStream.schema("chunk_id long, text string").json(str(src)), base)
    for n, rows in enumerate([[(1, "alpha beta"), (2, "beta")], [(2, "gamma"), (3, "alpha")], [(4, "beta beta")]]):
        df(rows).write.mode("append").json(str(src))
        run()
        now = store.read_text(spark, f"{base}/current")
        assert now.endswith(f"v{n}")
    whole = spark.read.parquet(f"{now}/chunks")
    assert {r.chunk_id: r.text for r in whole.collect()} == {1: "alpha beta", 2: "gamma", 3: "alpha", 4: "beta beta"}
    fresh = index.build_terms(whole, "chunk_id")
    for part in ("postings", "terms"):
        cols = ["doc_id", "term", "tf", "dl"] if part == "postings" else ["term", "df"]
        assert sorted(map(tuple, spark.read.parquet(f"{now}/{part}").select(*cols).collect())) == sorted(map(tuple, getattr(fresh, part).select(*cols).collect()))
    assert sorted(p.name for p in (tmp_path / "ix").iterdir() if p.name.startswith("v")) == ["v1", "v2"]


def test_times_and_use_of_a_run_and_one_opinion_a_claim(spark, corpus, queries, tmp_path):
    """A model's tokens are summed, shares add up to what was measured, and a
    second opinion is asked for once."""
    import pandas as pd

    def model(frames):
        for f in frames:
            yield pd.DataFrame({"query_id": f["query_id"], "answer": "A claim that nothing supports at all. [1]", "prompt_tokens": [7] * len(f)})

    log = tmp_path / "asked"
    log.mkdir()

    def second(frames):
        import uuid

        for f in frames:
            (log / uuid.uuid4().hex).write_text("\n".join(map(str, f.iloc[:, 0])))
            yield pd.DataFrame({"query_id": f["query_id"], "claim_index": f["claim_index"], "verdict": "insufficient"})

    e = queries.withColumn("category", F.lit("c")).withColumn("relevant", F.array(F.lit("1")))
    ms = []
    whole = answer.with_measures
    answer.with_measures = lambda records, took, *a: (ms.append(dict(took)), whole(records, took, *a))[1]
    try:
        rows = answer.full_records(e, corpus, generator=answer.by_model(model), second=second).collect()
    finally:
        answer.with_measures = whole
    used = [r.usage for r in rows if r.usage["calls"]]
    assert used and all(u["prompt_tokens"] == 7 and u["completion_tokens"] == 8 for u in used)
    for c in ("analysis", "retrieval", "generation", "verification"):
        assert abs(sum(r.latency_ms.get(c, 0.0) for r in rows) - ms[0][c]) < 1e-6 and ms[0][c] > 0
    lines = [x for f in log.iterdir() for x in f.read_text().split("\n") if x]  # each answer makes one claim
    assert lines and len(lines) == len(set(lines))


def test_the_last_append_of_a_checkpoint_wins(spark, tmp_path):
    path = tmp_path / "done"
    for answer_ in ("first", "second", "third"):
        io.write_checkpoint(spark.createDataFrame([("a", "1", answer_), ("a", answer_, "x")], "label string, qid string, final_answer string").coalesce(1), f"file://{path}")
    # file names say nothing of the order, and a torn tail is passed over
    for n, f in enumerate(sorted(path.glob("append=*/part-*.json"))):
        f.rename(f.with_name(f"part-{9 - n}.json"))
    (path / "append=000000000004").mkdir()
    (path / "append=000000000004" / "part-0.json").write_text('{"label": "a", "qid": "1", "final_ans')
    got = {r.qid: r.final_answer for r in io.read_checkpoint(spark, f"file://{path}", "a").collect()}
    assert got == {"1": "third", "first": "x", "second": "x", "third": "x"}
