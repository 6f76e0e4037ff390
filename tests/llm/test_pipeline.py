import corpus_pipeline
from pagemill.llm import mixing, packing, pii, toxicity
from pagemill.llm.shelf import put, table
from tests.llm.test_op7 import brute

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    lexicon = toxicity.fit(docs, table(spark, SF, "labels"))
    auto = lexicon.automaton()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = put(stage(spark, docs, SF), name)
        assert docs.columns == columns
        after = [r for r in docs.collect()]
        assert len(after) == len({r.doc_id for r in after})
        if name == "toxicity":
            bad = {i for i, r in before.items() if auto and toxicity._sigmoid(sum(a * b for a, b in zip(lexicon.model, (1, *toxicity.features(toxicity.fold(r.text or ""), auto)), strict=True))) >= 0.5}
            assert {r.doc_id for r in after} == set(before) - bad
        elif name == "near_duplicates":
            kept = {i for i, _, _, k in brute([(i, r.text) for i, r in before.items()], 5, 80) if k}
            assert {r.doc_id for r in after} == kept
        elif name == "personal_data":
            assert len(after) == len(before)
            for r in after:
                assert not [s for s in pii.base_spans(r.text or "") if s[2] in ("email", "card")]
                assert r.n_chars == len(r.text) and (r.text == before[r.doc_id].text or pii.base_spans(before[r.doc_id].text))
        else:
            assert {r.doc_id: r for r in after} == before
            slot = {r.doc_id: (r.mix_slot, r.mix_offset) for r in mixing.mix(docs).collect()}
            order = [slot[r.doc_id] for r in after]
            assert sum(a > b for a, b in zip(order, order[1:], strict=False)) <= 8  # files may be read in any order
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
    assert sum(r.length for r in rows) == sum({r.doc_id: r.doc_tokens for r in rows}.values())


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).columns == packing.COLUMNS


def test_sequences_follow_the_mixture_over_many_files(spark, tmp_path):
    rows = [(i, f"s{i % 3}", f"word{i} " * (300 if i % 3 else 900)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    slots = mixing.mix(docs)
    slot = {r.doc_id: (r.mix_slot, r.mix_offset) for r in slots.select("doc_id", "mix_slot", "mix_offset").collect()}
    # many files of unequal size, the late slots' largest: Spark deals those first
    for i, (low, high) in enumerate([(0, 5), (5, 12), (12, 10**9)]):
        slots.where(f"mix_slot >= {low} and mix_slot < {high}").select(*docs.columns).repartition(3).write.mode("append").parquet(str(tmp_path / "docs"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several partitions of little data
    try:
        got = packing.packed(spark, spark.read.parquet(str(tmp_path / "docs")), SF).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.doc_id for r in got} == set(slot)
    by_part = {}
    for r in got:
        by_part.setdefault(r.sequence_id >> 32, []).append(slot[r.doc_id])
    parts = [by_part[p] for p in sorted(by_part)]
    assert len(parts) > 1
    assert all(max(a) < min(b) for a, b in zip(parts, parts[1:], strict=False))


CLASHING = ["grp", "cycle", "at", "begin", "size", "w", "id", "key", "score", "predicted", "n_hits", "k0", "c3", "node", "component", "digest", "component_id", "kept", "mix_slot", "mix_offset", "mix_source", "mix_key", "mix_own_0", "base", "spans", "left", "sequence_id"]


def test_clashing_columns_nulls_and_empty_tables_in_every_stage(spark):
    rows = [(i, f"some words of text number {i} and {i * 7919 % 1000} more of them here", None if i % 5 == 0 else f"s{i % 3}") for i in range(40)]
    rows += [(100, None, "s1"), (101, "", "s1"), (None, "a text without an id", "s2"), (None, "a text without an id", "s2"), (102, "the same row", None), (102, "the same row", None), (103, "long " * 60_000, "s0")]
    docs = spark.createDataFrame([(*r, "en", 5, *[f"{c}{n}" for c in CLASHING]) for n, r in enumerate(rows)], "doc_id long, text string, source string, lang string, n_chars int, " + ", ".join(f"{c} string" for c in CLASHING))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        got = {tuple(r[c] for c in CLASHING): (r.doc_id, r.text, r.source) for r in out.collect()}
        want = {tuple(f"{c}{n}" for c in CLASHING): r for n, r in enumerate(rows)}
        assert got.items() <= want.items(), name
        assert len(got) == len(rows), name
        assert stage(spark, docs.limit(0), SF).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sum(1 for r in packed if r.start == 0) == len(rows)
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0
