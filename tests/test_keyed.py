"""The keyed table against upsert() of whole tables, its files, and crashes."""

import pytest
from pyspark.sql import functions as F

from pagemill.sources import io, keyed, store


def _table(spark, base):
    return sorted((r.id is not None, r.id or 0, r.v) for r in keyed.read(spark, base).collect())


def _files(spark, base):
    return {f.path for f in keyed.state(spark, base).folders if f.path}


def test_merges_equal_upserts_and_leave_other_folders_alone(spark, tmp_path):
    base = f"file://{tmp_path}/t"
    first = spark.range(4000).select("id", F.concat(F.lit("a"), "id").alias("v"))
    s = keyed.merge(spark, base, first, "id", rows_per_folder=200)
    assert s.number == 1 and len(s.folders) >= 16 and sum(f.rows for f in s.folders) == 4000
    before = _files(spark, base)
    batch = spark.createDataFrame([(7, "x"), (7, "y"), (5000, "z"), (None, "n")], "id long, v string")
    whole = io.upsert(first, batch, "id")
    keyed.merge(spark, base, batch, "id", rows_per_folder=200)
    assert _table(spark, base) == sorted((r.id is not None, r.id or 0, r.v) for r in whole.collect())
    after = _files(spark, base)
    assert len(before - after) <= 3 and len(after - before) <= 3
    got = _table(spark, base)
    again = keyed.merge(spark, base, batch, "id", rows_per_folder=200)
    assert _table(spark, base) == got and sum(f.rows for f in again.folders) == 4002
    keyed.merge(spark, base, batch.limit(0), "id", rows_per_folder=200)
    assert _files(spark, base) == {f.path for f in again.folders if f.path}
    assert keyed.read(spark, base, 3).count() == 4002


def test_folders_divide_as_the_table_grows(spark, tmp_path):
    base, seen = f"file://{tmp_path}/t", 0
    for i in range(4):
        rows = spark.range(seen, seen + 600).select("id", F.lit(i).alias("v"))
        s = keyed.merge(spark, base, rows, "id", rows_per_folder=150)
        seen += 600
        assert sum(f.rows for f in s.folders) == seen
    assert max(f.rows for f in s.folders) <= 300 + 150
    # the folders' bits cover every hash once
    assert sum(2.0 ** -f.depth for f in s.folders) == 1.0
    assert keyed.read(spark, base).agg(F.count_distinct("id")).first()[0] == seen


def test_columns_come_and_go(spark, tmp_path):
    base = f"file://{tmp_path}/t"
    keyed.merge(spark, base, spark.createDataFrame([(1, "a", {"k": 1})], "id long, v string, m map<string,int>"), "id")
    keyed.merge(spark, base, spark.createDataFrame([(1, 2.5), (2, None)], "id int, w double"), "id")
    keyed.merge(spark, base, spark.createDataFrame([(3, "c", 1), (3, "d", 2), (3, "e", None)], "id int, v string, at int"), "id", order="at")
    got = {r.id: (r.v, r.w, r.m, r["at"]) for r in keyed.read(spark, base).collect()}
    assert got == {1: (None, 2.5, None, None), 2: (None, None, None, None), 3: ("d", None, None, 2)}
    with pytest.raises(ValueError):
        keyed.merge(spark, base, spark.range(1).withColumn("fold_code", F.lit(1)), "id")
    with pytest.raises(ValueError):
        keyed.merge(spark, base, spark.range(1).withColumn("v", F.lit("x")), "v")
    with pytest.raises(FileNotFoundError):
        keyed.read(spark, f"file://{tmp_path}/none")


@pytest.mark.parametrize("step", ["rows", "manifest"])
def test_a_merge_that_ends_half_way_changes_nothing(spark, tmp_path, monkeypatch, step):
    base = f"file://{tmp_path}/t"
    keyed.merge(spark, base, spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string"), "id")
    batch = spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string")

    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(*((keyed, "_placed", fail) if step == "rows" else (store, "create_text", fail)))
        with pytest.raises(RuntimeError):
            keyed.merge(spark, base, batch, "id")
    assert _table(spark, base) == [(True, 1, "a"), (True, 2, "b")]
    states = {1: keyed.state(spark, base).folders, 2: keyed.merge(spark, base, batch, "id").folders}
    states[3] = states[2]
    assert _table(spark, base) == [(True, 1, "a"), (True, 2, "c"), (True, 3, "d")]
    # what the lost run wrote goes with the next sweep
    keyed.merge(spark, base, batch.limit(0), "id")
    fs, p = store.filesystem(spark, f"{base}/data")
    named = {f.path.split("/")[1] for n in (1, 2, 3) for f in states[n] if f.path}
    assert {f.getPath().getName() for f in fs.listStatus(p)} <= named


def test_two_writers(spark, tmp_path, monkeypatch):
    base = f"file://{tmp_path}/t"
    keyed.merge(spark, base, spark.createDataFrame([(1, "a")], "id long, v string"), "id")
    old, real = keyed.state(spark, base), keyed.state
    keyed.merge(spark, base, spark.createDataFrame([(2, "b")], "id long, v string"), "id")
    with monkeypatch.context() as m:
        m.setattr(keyed, "state", lambda s, b, n=None: old if n is None else real(s, b, n))
        with pytest.raises(FileExistsError):
            keyed.merge(spark, base, spark.createDataFrame([(3, "c")], "id long, v string"), "id")
    assert _table(spark, base) == [(True, 1, "a"), (True, 2, "b")]
