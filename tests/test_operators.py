"""Operators on small fixtures, against values worked out by hand or in plain Python."""

import json
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagemill.config import ChunkConfig, EngineConfig, RetrievalConfig, deep_merge, load_layers
from pagemill.functions import text as X
from pagemill.functions import udtf
from pagemill.functions.text import sentences, tokenize
from pagemill.operators import agent, chunking, evaluate, generate, ground, index, ingest, retrieve
from pagemill.plans import ingestion
from pagemill.sources import adapters, io
from pagemill.streaming import logs


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_config_layers(tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"x": {"k": 1, "l": 2}, "y": 3}))
    (tmp_path / "b.json").write_text(json.dumps({"base_config": "a.json", "x": {"l": 5}}))
    assert load_layers(f"{tmp_path}/b.json") == {"x": {"k": 1, "l": 5}, "y": 3}
    assert deep_merge({"a": 1}, {"a": {"b": 2}}) == {"a": {"b": 2}}
    assert EngineConfig().overlay({"retrieval": {"mode": "keyword"}}).retrieval.mode == "keyword"
    with pytest.raises(ValueError):
        EngineConfig().overlay({"none": {}})
    for bad in ({"mode": "x"}, {"fusion": "x"}, {"lexical_weight": -1.0}, {"lexical_weight": 0.0, "semantic_weight": 0.0}):
        with pytest.raises(ValueError):
            RetrievalConfig(**bad)


def test_text_functions(spark):
    t = spark.createDataFrame([("1.2.3 Title", "  a\tb \x07 \n c  ", "See [2] and [1] and [2]. 3.5 of 30"), ("IV. x", None, ""), ("A.b", "", "x")], "a string, b string, c string")
    assert [r[0] for r in rows(t, X.clause_number(F.col("a")))] == ["1.2.3", "IV", None]
    assert rows(t, X.normalize_text(F.col("b")))[0][0] == "a b\n c"
    assert rows(t, X.markers(F.col("c")), X.numbers(F.col("c")))[0] == ([2, 1], ["2", "1", "3.5", "30"])
    one = spark.range(1)
    assert rows(one, X.containment(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a"))), X.containment(F.array(F.lit("a")), F.array(F.lit("a"))))[0] == (0.0, 1.0)
    assert rows(one, X.citation_label(F.lit("P"), F.lit("f"), F.lit("d"), F.lit(2), F.lit(3), F.lit("S"), F.array(*[F.lit(str(i)) for i in range(6)])))[0][0] == "P — pp. 2-3 — S — clauses 0, 1, 2, 3"


def test_metadata_of_texts_and_file_names(spark):
    got = {r.id: r for r in ingestion.metadata_extract(spark, "").collect()}
    assert (got[1].insurer[:4], got[1].product, got[1].uin, got[1].document_type, got[1].version, got[1].review_flags) == ("HDFC", "my:Optima Secure", "HDFHLIP26058V082526", "Policy Wording", "3", "")
    assert got[2].product == "Care Plus" and got[2].insurer.startswith("Go Digit") and got[2].document_type == "Policy Clause" and "uin_not_found" in got[2].review_flags and "mismatch" in got[2].review_flags
    assert got[3].uin == "SHAHLIP26044V092526" and got[3].product == "Star Comprehensive" and got[3].version == "12" and got[3].document_type == "Prospectus"
    assert got[4].insurer.startswith("Tata") and got[4].uin_low_confidence and got[4].product == "MediCare"
    assert got[5].product == "unknown" or got[5].product == "the best one" or got[5].review_flags
    assert got[6].document_type == "Policy Wording" and "document_type_inferred" in got[6].review_flags
    reg = {r.filename: r for r in ingestion.registry(spark, "").collect()}
    assert reg["zz.pdf"].duplicate_of and "exact_duplicate" in reg["zz.pdf"].review_flags


BLOCKS = "document_id string, page_number int, reading_order int, type string, subtype string, text string, heading_level int, clause_id string"


def test_chunker(spark):
    cfg = ChunkConfig(target_chars=40, max_chars=60, min_chars=8)
    b = [
        ("d", 1, 0, "header", None, "running head", None, None),
        ("d", 1, 1, "heading", "section_heading", "GENERAL TERMS", 1, None),
        ("d", 1, 2, "heading", "subsection_heading_l2", "Scope", 2, None),
        ("d", 1, 3, "clause", "numbered_clause", "1. " + "a" * 30, None, "1"),
        ("d", 1, 4, "clause", "numbered_clause", "2. " + "b" * 30, None, "2"),
        ("d", 2, 1, "table", "tab_separated", "x\ty", None, None),
        ("d", 2, 2, "paragraph", None, "Tiny.", None, None),
        ("d", 2, 3, "paragraph", None, ". ".join("word" * 5 for _ in range(6)) + ".", None, None),
        ("d", 2, 4, "clause", "numbered_clause", "B. DEFINITIONS Some copy", None, "B"),
        ("e", 1, 1, "paragraph", None, " ", None, None),
    ]
    meta = spark.createDataFrame([("d", "Prod", "/x/y/f.pdf")], "document_id string, product string, source_path string")
    got = chunking.chunk(spark.createDataFrame(b, BLOCKS), meta, cfg).orderBy("chunk_id").collect()
    assert [c.chunk_id for c in got] == [f"d::c{i:04d}" for i in range(len(got))]
    assert got[0].text.startswith("GENERAL TERMS\nScope\n1. aaa") and got[0].section == "GENERAL TERMS" and got[0].clause_ids == ["1"]
    assert got[1].clause_ids == ["2"] and got[1].subsection == "Scope" and got[1].context_text.startswith("Prod > GENERAL TERMS > Scope\n2. b")
    assert got[2].chunk_type == "table" and got[2].text == "x\ty"
    assert got[-1].section == "B. DEFINITIONS" and got[-1].page_start == 2 and got[-1].source_path == "f.pdf"
    assert got[-1].context_text == "Prod\nB. DEFINITIONS Some copy"
    assert all(c.char_count <= 68 for c in got) and not any("running" in c.text for c in got)
    assert "Tiny." in got[3].text
    s = chunking.store_rows(chunking.chunk(spark.createDataFrame(b, BLOCKS), meta, cfg)).where("chunk_id = 'd::c0000'").collect()[0]
    assert s.clause_ids == "1" and s.insurer == ""
    assert chunking.chunk(spark.createDataFrame(b, BLOCKS).limit(0)).count() == 0


def test_split_long():
    for t in ["a b " * 400, "x" * 500, "One two. " * 90, "p1 " * 30 + "\n\n" + "p2 " * 60 + "\n \n" + "q" * 10, ""]:
        got = chunking.split_long(t, 100)
        assert "".join("".join(got).split()) == "".join(t.split())
        assert all(len(p) <= 100 for p in got) or len(t) <= 100


def test_bands_structure_and_report(spark):
    b = spark.createDataFrame([("d", p, o, t, y) for p in (1, 2, 3) for o, t, y in ((0, "Head", 0.05), (1, f"Body {p}", 0.5), (2, f"page {p}", 0.95))], "document_id string, page_number int, reading_order int, text string, y double").withColumn("type", F.lit("paragraph"))
    bands = ingest.repeated_bands(b)
    assert rows(bands, "band", "text", "frequency", "pages") == [("header", "Head", 3, [1, 2, 3])]
    marked = ingest.mark_bands(b, bands)
    assert marked.where("type = 'header'").count() == 3 and ingest.body_blocks(marked).count() == 6
    r = {x.document_id: x for x in ingest.extraction_report(spark.createDataFrame([("a", 10, 2, False), ("a", 0, 0, True), ("b", 5, 1, False)], "document_id string, char_count int, word_count int, ocr_used boolean")).collect()}
    assert (r[None].pages, r[None].text_pages, r["a"].ocr_pages) == (3, 2, 1)
    ocr = spark.createDataFrame([("d", 1, "scanned"), ("z", 1, "lone")], "document_id string, page_number int, ocr_text string")
    assert ingest.with_ocr(b.drop("y"), ocr).where("ocr_used").count() == 2


def test_filters_and_rerankers(spark):
    d = spark.createDataFrame([(1, "en", "alpha beta"), (2, "de", "alpha"), (3, None, "gamma delta")], "doc_id long, lang string, text string")
    q = spark.createDataFrame([(1, "alpha gamma"), (2, "zzz the")], "query_id long, query string")
    ix = index.build_terms(d)
    f = retrieve.metadata_filter({"$or": [{"lang": "en"}, {"lang": {"$eq": None}}]})
    assert [r[1] for r in rows(retrieve.bm25(q, ix, 5, allowed=d.where(f)), "rank", "doc_id")] == [3, 1]
    assert retrieve.metadata_filter({}) is None and retrieve.bm25(q, ix, 0).count() == 0
    assert retrieve.hybrid(q, None, ix, None, RetrievalConfig()).count() == 3
    assert retrieve.build_reranker("off", ix, d) is None
    assert retrieve.build_reranker("cross-encoder", ix, d, load=lambda: 1 / 0).name == "lexical"
    with pytest.raises(ValueError):
        retrieve.build_reranker("x", ix, d)
    pair = retrieve.build_reranker("cross-encoder", ix, d, load=lambda: lambda a, b: b.str.len().astype("float64"))
    assert [r[0] for r in rows(retrieve.hybrid(q, None, ix, None, RetrievalConfig(), 2, pair), "doc_id")] == [3, 1]
    v = index.hashed_vectors(d)
    assert rows(v.where("chunk_id = 2"), index.dot(F.col("embedding"), F.col("embedding")))[0][0] == pytest.approx(1.0, abs=1e-6)


def test_metrics(spark):
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (1, 13, 4)], "query_id long, doc_id long, rank int")
    rel = spark.createDataFrame([(1, 11), (1, 13), (1, 99)], "query_id long, doc_id long")
    q = spark.createDataFrame([(1, "a"), (2, "b")], "query_id long, query string")
    m = {r.query_id: r for r in evaluate.retrieval_metrics(hits, rel, q, 4).collect()}
    assert (m[1].precision, m[1].recall, m[1].hit, m[1].mrr) == (0.5, pytest.approx(2 / 3), 1.0, 0.5)
    assert m[1].map == pytest.approx((0.5 + 0.5) / 3, abs=1e-6) and m[2].n_relevant == 0 and m[2].ndcg == 0.0


def test_claims_verdicts_and_response(spark):
    a = "Intro line stands here without source.\nKey facts:\n- Cataract surgery is covered after 24 months. [1]\n1. Cataract surgery needs 36 months. [1] [7]\nRoom rent claims vanish\nConclusion:\nTherefore choose it wisely. [1]"
    ans = spark.createDataFrame([(1, a, "coverage", 1), (2, "The policy documents provided do not contain this information.", "", 0), (3, "[1]", "x", 1)], "query_id long, answer string, query_type string, evidence_count int")
    ev = spark.createDataFrame([(1, 1, "Cataract surgery is covered after a waiting period of 24 months.")], "query_id long, marker int, text string")
    c = ground.claims(ans)
    v = ground.verify(c, ev)
    got = {r.claim_index: (r.verdict, r.reason, r.line) for r in v.where("query_id = 1").collect()}
    assert [got[i][0] for i in range(1, 6)] == ["insufficient", "supported", "contradicted", "insufficient", "not_verified"]
    assert got[1][1] == "uncited claim" and got[3][2] == 4
    s = {r.query_id: r for r in ground.shape(ans, v).collect()}
    assert s[1].abstained and s[1].clarification.startswith(ground.NO_SUPPORT)
    assert s[2].abstained and ground.NO_EVIDENCE in s[2].final_answer  # a refusal is a sentence like others,
    said = ground.shape(ans.withColumn("abstained", F.lit(True)), v).where("query_id = 2").collect()[0]
    assert said.abstained and said.final_answer.startswith("The policy")  # unless the generator marked it
    assert s[3].abstained and s[3].clarification.endswith(ground.ANY_QUESTION)

    def model(frames):
        for f in frames:
            yield pd.DataFrame({"query_id": f["query_id"], "claim_index": f["claim_index"], "verdict": " Supported "})

    again = ground.second_opinion(v, model)
    assert again.where("query_id = 1 and verdict = 'supported'").count() == 4
    kept = ground.shape(ans, again).where("query_id = 1").collect()[0]
    assert not kept.abstained


def test_generation_and_refinement(spark):
    q = spark.createDataFrame([(1, "a?"), (2, "b?")], "query_id long, query string")
    hits = spark.createDataFrame([(1, 1, "L", "text one"), (1, 2, "L", "y" * 5000)], "query_id long, rank int, label string, text string")
    ev = generate.evidence_blocks(hits, limit=100)
    assert ev.count() == 1

    def model(frames):
        for f in frames:
            yield pd.DataFrame({"query_id": f["query_id"], "answer": "It says " + f["prompt"].str[:3]})

    got = {r.query_id: (r.answer, r.abstained) for r in generate.generate(q, ev, model).collect()}
    assert got[1] == ("It says [1]", False) and got[2] == (generate.REFUSAL, True)
    an = agent.analyze(q)

    def judge(frames):
        for f in frames:
            yield pd.DataFrame({"query_id": f["query_id"].head(1), "query_type": "coverage", "confidence": 0.9})

    low = an.withColumn("confidence", F.lit(0.3))
    assert {r[0] for r in rows(agent.refine(low, judge), "query_type")} <= {"coverage", "out_of_domain"}


def test_files_round_trip(spark, tmp_path):
    b = spark.createDataFrame([("d1", 1, 1, "paragraph", "b"), ("d1", 1, 0, "paragraph", "a"), ("d1", 2, 0, "paragraph", "c")], "document_id string, page_number int, reading_order int, type string, text string")
    doc = ingest.nest(b).withColumn("filename", F.lit("f.pdf"))
    io.write_json(doc, f"{tmp_path}/docs")
    back = ingest.flatten(io.read_documents(spark, f"{tmp_path}/docs"))
    assert sorted(rows(back, "page_number", "reading_order", "text")) == [(1, 0, "a"), (1, 1, "b"), (2, 0, "c")]
    with pytest.raises(Exception):
        io.read_documents(spark, f"{tmp_path}/none")
    for name, content in (("o.json", {"queries": [{"qid": "q1", "query": "x", "relevant_chunk_ids": ["c1", "c2"]}]}), ("l.json", [{"id": "q2", "query": "y"}])):
        (tmp_path / name).write_text(json.dumps(content))
    e = io.read_eval_set(spark, f"{tmp_path}/o.json").unionByName(io.read_eval_set(spark, f"{tmp_path}/l.json"))
    assert sorted(rows(e, "query_id", "relevant")) == [("q1", ["c1", "c2"]), ("q2", [])] and io.qrels_of(e).count() == 2
    (tmp_path / "ck.jsonl").write_text('{"label":"a","qid":"1","claims":1}\n{"label":"a","qid":"1","claims":2}\n{"label":"b","qid":"2"}\n{"label":"a","qid":')
    done = io.read_checkpoint(spark, f"{tmp_path}/ck.jsonl", "a")
    assert rows(done, "qid", "claims") == [("1", 2)]
    assert rows(io.pending(e.select(F.regexp_replace("query_id", "q", "").alias("query_id")), done), "query_id") == [("2",)]
    (tmp_path / "pdfs" / "raw").mkdir(parents=True)
    for p in ("pdfs/b.PDF", "pdfs/a.pdf", "pdfs/raw/c.pdf", "pdfs/n.txt"):
        (tmp_path / p).write_bytes(b"x")
    assert io.with_checksum(io.discover(spark, f"{tmp_path}/pdfs")).count() == 2
    assert io.markdown([{"a": 1, "b": None}, {"a": 0.5, "b": "x"}]) == "| a | b |\n|---|---|\n| 1 |  |\n| 0.5000 | x |"
    assert adapters.ocr_engine() is None or adapters.ocr_engine()
    assert isinstance(adapters.pdf_available(), bool)


def test_incremental_index(spark, tmp_path):
    src, base = tmp_path / "in", f"file://{tmp_path}/base"
    src.mkdir()
    schema = "chunk_id string, text string"
    for i, lines in enumerate(([("a", "red apple"), ("b", "green pear")], [("a", "blue plum"), ("c", "red plum")])):
        (src / f"{i}.json").write_text("\n".join(json.dumps({"chunk_id": k, "text": t}) for k, t in lines))
        logs.maintain_index(spark, logs.log_stream(spark, str(src), schema), base)()
    now = spark.read.text(f"{base}/current").first()[0]
    assert sorted(rows(spark.read.parquet(f"{now}/chunks"), "chunk_id", "text")) == [("a", "blue plum"), ("b", "green pear"), ("c", "red plum")]
    assert {r[0]: r[1] for r in rows(spark.read.parquet(f"{now}/terms"), "term", "df")}["plum"] == 2


def test_table_functions(spark):
    udtf.register(spark)
    spark.createDataFrame([("The red Apple. So it is",)], "text string").createOrReplaceTempView("udtf_docs")
    assert [r[0] for r in spark.sql("select t.term from udtf_docs, lateral terms(text) t order by pos").collect()] == ["red", "apple", "so"]
    assert spark.sql("select s.* from udtf_docs, lateral sentences_of(text) s").count() == 2
    assert spark.sql("select p.* from udtf_docs, lateral pieces_of(text, 8) p").count() >= 3


def _plain_chunks(blocks, cfg):
    """Chunk texts and clauses of one document by lists: fill, join back, join
    ahead, join the last."""
    raw, cur, section, sub, prior = [], None, None, None, None
    for page, kind, text, clause, is_sec, is_sub, title in blocks:
        marker, ct = is_sec or is_sub, "table" if kind == "table" else "prose"
        if is_sec:
            section, sub = title, None
        elif is_sub:
            sub = text
        pieces = chunking.split_long(text, cfg.max_chars)
        turn = prior is None or prior[0] != ct or (marker and not prior[1]) or len(text) > cfg.max_chars
        for i, x in enumerate(pieces):
            if (turn and i == 0) or i or (kind == "clause" and cur["size"] >= cfg.target_chars) or cur["size"] + len(x) > cfg.max_chars:
                cur = {"texts": [], "size": 0, "type": ct, "section": section, "sub": sub, "clauses": []}
                raw.append(cur)
            cur["texts"].append(x)
            cur["size"] += len(x)
            if clause and clause not in cur["clauses"]:
                cur["clauses"].append(clause)
        prior = ct, marker and len(pieces) == 1
    l = [{**c, "text": "\n".join(c["texts"]).strip()} for c in raw]
    room = cfg.max_chars + cfg.min_chars
    small = lambda c: len(c["text"]) < cfg.min_chars and c["type"] != "table"

    def join(a, b, lead, other):
        return {**lead, "text": a["text"] + "\n" + b["text"], "sub": lead["sub"] or other["sub"], "clauses": list(dict.fromkeys(lead["clauses"] + other["clauses"]))}

    out = []
    for x in l:
        p = out[-1] if out else None
        if p and small(x) and x["type"] == p["type"] and x["section"] == p["section"] and len(p["text"]) + len(x["text"]) <= room:
            out[-1] = join(p, x, p, x)
        else:
            out.append(x)
    l, out = out, []
    for x in l:
        p = out[-1] if out else None
        if p and small(p) and x["type"] == p["type"] and (x["section"] or "") == (p["section"] or "") and len(p["text"]) + len(x["text"]) <= room:
            out[-1] = join(p, x, x, p)
        else:
            out.append(x)
    if len(out) > 1 and small(out[-1]) and (out[-1]["section"] or "") == (out[-2]["section"] or "") and len(out[-1]["text"]) + len(out[-2]["text"]) <= room:
        out[-2:] = [join(out[-2], out[-1], out[-2], out[-1])]
    return [(c["text"], c["type"], c["section"], c["sub"], tuple(c["clauses"])) for c in out]


def test_the_pass_gives_what_lists_give():
    import random

    r = random.Random(4)
    cfg = ChunkConfig(target_chars=60, max_chars=90, min_chars=25)
    for _ in range(300):
        blocks = []
        for i in range(r.randint(0, 25)):
            kind = r.choices(["paragraph", "clause", "table", "heading"], weights=[6, 3, 1, 2])[0]
            sec = kind == "heading" and r.random() < 0.5
            text = r.choice(["x" * r.randint(1, 30), "word. " * r.randint(1, 40), "A b. " * 3 + "\n\n" + "c " * r.randint(1, 90)]).strip()
            blocks.append((i // 4, kind, text, f"{i % 5}" if kind == "clause" else None, sec, kind == "heading" and not sec, f"S{i % 2}" if sec else None))
        c = chunking.Chunker(cfg)
        for b in blocks:
            c.block("d", *b)
        c.finish()
        assert [(k.text, k.chunk_type, k.section, k.subsection, k.clause_ids) for _, _, k in c.out] == _plain_chunks(blocks, cfg)
        assert [n for _, n, _ in c.out] == list(range(len(c.out)))


def test_a_document_of_many_blocks_takes_time_in_proportion(spark):
    """One document of 200,000 blocks beside a few small ones."""
    n = 200_000
    long = spark.range(n).select(F.lit("long").alias("document_id"), (F.col("id") / 100).cast("int").alias("page_number"), (F.col("id") % 100).cast("int").alias("reading_order"), F.when(F.col("id") % 50 == 0, "heading").otherwise("paragraph").alias("type"), F.when(F.col("id") % 50 == 0, "section_heading").alias("subtype"), F.concat(F.lit("Block number "), F.col("id"), F.lit(" of a long text.")).alias("text"))
    short = spark.createDataFrame([(f"s{i}", 1, 1, "paragraph", None, "Short one.") for i in range(5)], "document_id string, page_number int, reading_order int, type string, subtype string, text string")
    got = chunking.chunk(long.unionByName(short).repartition(8)).select("document_id", "chunk_id", "text", "section").collect()
    mine = sorted((x for x in got if x.document_id == "long"), key=lambda x: int(x.chunk_id.rpartition("::c")[2]))
    assert len(got) - len(mine) == 5
    said = [int(w) for x in mine for w in re.findall(r"Block number (\d+)", x.text)]
    assert said == list(range(n))
    assert all(x.section == f"Block number {int(re.search(r'(\d+)', x.text)[1]) // 50 * 50} of a long text." for x in mine[:200])


def test_page_sets_of_many_pages(spark):
    """A line on a million pages, twice on some, in any order of numbers."""
    many = spark.range(-40000, 960000).selectExpr("'d' as document_id", "id as page_number", "'line' as text", "0.0D as y")
    few = spark.createDataFrame([("d", n, "odd", 0.95) for n in (7, 7, 0, -32768, 32768, 32769, None)] + [("d", 1, "once", 0.0), ("e", None, "x", 0.0), ("e", None, "x", 0.0)], "document_id string, page_number long, text string, y double")
    sets = ingest.page_sets(many.withColumn("band", F.lit("header")).repartition(7), ["document_id", "band", "text"])
    assert sets.agg(F.sum(F.bitmap_count("bitmap")), F.max(F.length("bitmap"))).first()[:] == (1000000, 4096) and sets.count() == 32
    got = {r.text: r for r in ingest.repeated_bands(few.unionByName(many), 0.0).collect()}
    assert set(got) == {"line", "odd", "x"} and got["line"].pages == list(range(-40000, 960000)) and got["line"].frequency == 1000000
    assert got["odd"].pages == [-32768, 0, 7, 32768, 32769] and got["odd"].frequency == 7 and got["x"].pages == []


def test_table_functions_of_tables(spark):
    udtf.register(spark)
    texts = [(1, "The red Apple. So it is!  Yes no"), (2, None), (3, ""), (4, "x y. " * 40), (None, "Blue plum")]
    df = spark.createDataFrame(texts, "id long, text string")
    df.createOrReplaceTempView("udtf_texts")
    for partition in ("", " PARTITION BY id"):
        for name, column, want in (("terms_of", "term", tokenize(F.col("text"))), ("sentences_in", "sentence", sentences(F.coalesce("text", F.lit(""))))):
            got = spark.sql(f"select id, pos, {column} from {name}(table(select id, text from udtf_texts){partition})")
            assert sorted(got.collect(), key=str) == sorted(df.select("id", F.posexplode(want).alias("pos", column)).collect(), key=str)
    pieces = spark.sql("select * from pieces_in(table(select id, text, 20 as size from udtf_texts)) order by id, pos").collect()
    assert [(r.id, r.pos, r.piece) for r in pieces] == [(i, n, p) for i, t in sorted(texts, key=lambda x: x[0] or 0) for n, p in enumerate(chunking.split_long(t or "", 20))]
    assert spark.sql("select * from terms_of(table(select id, text from udtf_texts where false))").count() == 0


def test_chunks_within_the_limit(spark, tmp_path):
    """Two pieces that fill a chunk to the last character, and the line break
    that joins them."""
    line = lambda n: "x" * n
    texts = [(1, "\n".join([line(650), line(650), line(119)])), (2, "\n".join(["y"] * 1200)), (3, "\n".join([line(1200), line(100), line(120)])), (4, "\n".join([line(700), line(500), line(110), line(109)]))]
    spark.createDataFrame([(i, t, "en", "src0") for i, t in texts], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = ingestion.chunk_invariants(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.bare_chars, r.numbered, r.fits) for r in got} == {(i, len(t.replace("\n", "")), True, True) for i, t in texts}


def test_quoted_sentences_keep_their_characters(spark):
    """The n-th sentence was trimmed of the digits of n, too."""
    q = spark.createDataFrame([(1, "?")], "query_id long, query string")
    hits = spark.createDataFrame([(1, 1, "Licensed under CC BY-NC 4.0.\n10 days is the term of version 1.1. And no more")], "query_id long, rank int, text string")
    assert generate.extractive_answers(q, hits).first().answer == "Licensed under CC BY-NC 4.0. [1]\n10 days is the term of version 1.1. [1]"
