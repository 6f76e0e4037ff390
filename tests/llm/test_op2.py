import duckdb

from pagemill.llm import mixing
from pagemill.llm.mixing import ORACLE, mix, op2_mixing, schedule, shares

SF = "/root/testdata/sf0.01"


def test_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet{'/*.parquet' if __import__('os').path.isdir(SF + '/documents.parquet') else ''}')")
    got = op2_mixing(spark, SF)
    cols = sorted(got.columns)
    want = con.execute(f"select {', '.join(cols)} from ({ORACLE['op2_mixing']})").fetchall()
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(want)


def test_deviation_is_below_one_block(spark):
    sizes = spark.createDataFrame([("a", 9_000_000), ("b", 250_000), ("c", 1_000), ("d", 1), ("e", 70_000), ("f", 70_000)], "grp string, size long")
    for weights in (None, {"a": 0.1, "b": 0.7, "c": 0.2}):
        rows = schedule(shares(sizes, weights, 0.5)).collect()
        cycle = rows[0].cycle
        by_slot = {r["at"]: r for r in rows}
        assert sorted(by_slot) == list(range(cycle))
        done, a = {}, {r.grp: r.a for r in rows}
        assert set(a) == {"a", "b", "c", "d", "e", "f"}
        for t in range(cycle):
            r = by_slot[t]
            assert r.k == done.get(r.grp, 0)
            done[r.grp] = r.k + 1
            for g, w in a.items():
                assert abs(done.get(g, 0) - (t + 1) * w / cycle) < 1
            assert r.k * cycle // r.a <= t < -(-(r.k + 1) * cycle // r.a)


def test_no_python_in_the_plan(spark):
    plan = op2_mixing(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_odd_rows(spark):
    rows = [(1, "a", None, 5), (2, None, "x", 5), (None, "a", "y" * 200_000, 5), (3, "a", "", 5), (3, "a", "", 5), (4, "b", "z" * 70_000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, mix_slot int")
    out = mix(df)
    got = out.collect()
    assert len(got) == 6 and {r.mix_source for r in got} == {"a", "", "b"}
    assert len({(r.mix_slot, r.mix_offset, r.mix_source) for r in got}) == 6
    assert mix(df.limit(0)).count() == 0


def test_small_sources_share_a_group(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 2)
    rows = [(i, f"s{min(i % 7, 4)}", "x" * (1 + i % 50) * 100) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mix(df, block_chars=5000).collect()
    assert sorted(r.doc_id for r in got) == list(range(300))
    assert len({r.mix_source for r in got}) == 3 and {r.mix_source for r in got} > {"(other)"}
    for g in {r.mix_source for r in got}:
        own = sorted((r.mix_slot, r.mix_offset, len(r.text)) for r in got if r.mix_source == g)
        assert len({(s, o) for s, o, _ in own}) == len(own)
        blocks = sorted((r.mix_block, r.mix_offset, len(r.text)) for r in got if r.mix_source == g)
        at = 0
        for b, o, n in blocks:
            assert b * 5000 + o == at
            at += n


def test_deviation_from_the_target_weight(spark):
    from fractions import Fraction

    weights = {"a": 48.496, "b": 0.2, "c": 951.304}
    sizes = spark.createDataFrame([("a", 400_000), ("b", 2_000), ("c", 8_000_000)], "grp string, size long")
    rows = sorted(mixing.whole_schedule(mixing.weigh(sizes, weights, 0.5), 1000).collect(), key=lambda r: r.mix_slot)
    assert [sum(r.grp == g for r in rows) for g in "abc"] == [400, 2, 8000]
    assert len({r.mix_slot for r in rows}) == len(rows)
    total, left, done = sum(map(Fraction, weights.values())), {"a": 400, "b": 2, "c": 8000}, dict.fromkeys("abc", 0)
    at = {r.mix_slot: r for r in rows}
    for t in range(max(at) + 1):
        if t in at:
            r = at[t]
            w = Fraction(weights[r.grp]) / total
            assert r.mix_block == done[r.grp] and r.mix_release == r.mix_block // w and r.mix_deadline == -(-(r.mix_block + 1) // w)
            assert r.mix_release <= t < r.mix_deadline
            done[r.grp] += 1
        for g, n in done.items():
            assert n == left[g] or abs(n - (t + 1) * Fraction(weights[g]) / total) < 1, (t, g)


def test_mix_takes_the_weight_exactly(spark):
    df = spark.createDataFrame([(i, "a" if i % 100 else "b", "x" * 10) for i in range(4000)], "doc_id long, source string, text string")
    got = mix(df, {"a": 4095 / 4096, "b": 1 / 4096}, block_chars=10).where("mix_source = 'b'").orderBy("mix_block").collect()
    assert [r.mix_release for r in got[:3]] == [0, 4096, 8192]  # a cycle of 1000 gave 1000, 2000


def test_every_source_is_scheduled(spark):
    df = spark.range(1200).selectExpr("id as doc_id", "concat('s', id % 300) as source", "repeat('x', cast(5 + id % 7 as int)) as text")
    for rounded in (False, True):
        got = mix(df, {"s299": 50.0, "s0": 1.0}, block_chars=10, rounded=rounded).collect()
        assert {r.mix_source for r in got} == {f"s{i}" for i in range(300)}
        assert all(r.mix_source == f"s{r.doc_id % 300}" for r in got) and len(got) == 1200
        taken = {(r.mix_slot, r.mix_source) for r in got}
        assert len(taken) == len({s for s, _ in taken})
        assert all(r.mix_release <= r.mix_slot < r.mix_deadline for r in got)
