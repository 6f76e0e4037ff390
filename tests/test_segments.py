"""An index that grows by segments, against one built anew from what counts."""

import random

import pytest
from pyspark.sql import functions as F

from pagemill.operators import index
from pagemill.sources import store
from pagemill.streaming import segments


def frame(spark, rows):
    return spark.createDataFrame(rows, "chunk_id long, text string, deleted boolean")


def check(spark, base, want):
    chunks = {r.chunk_id: r.text for r in segments.read_chunks(spark, base).collect()}
    assert chunks == want
    ix = segments.read(spark, base)
    fresh = index.build_terms(spark.createDataFrame(list(want.items()), "chunk_id long, text string"), "chunk_id")
    rows = lambda df, cols: sorted(map(tuple, df.select(*cols).collect()))
    assert rows(ix.postings, ["doc_id", "term", "tf", "dl"]) == rows(fresh.postings, ["doc_id", "term", "tf", "dl"])
    assert rows(ix.terms.withColumn("idf", F.round("idf", 9)), ["term", "df", "idf"]) == rows(fresh.terms.withColumn("idf", F.round("idf", 9)), ["term", "df", "idf"])
    assert rows(ix.corpus, ["n_docs", "total_terms"]) == rows(fresh.corpus, ["n_docs", "total_terms"])


def test_any_batches_equal_an_index_built_anew(spark, tmp_path):
    r, base, want = random.Random(1), f"file://{tmp_path}/ix", {}
    levels = set()
    for n in range(6):
        rows = []
        for i in r.sample(range(12), r.randint(1, 5)):
            gone = r.random() < 0.25
            rows.append((i, " ".join(r.choices(["alpha", "beta", "gamma", "delta", "eps"], k=r.randint(0, 4))), gone))
            want.pop(i, None)
            if not gone:
                want[i] = rows[-1][1]
        m = segments.add(spark, base, frame(spark, rows), "s", n)
        assert segments.add(spark, base, frame(spark, [(99, "again", False)]), "s", n) == m  # a batch that runs again
        levels.add(tuple(s.level for s in m.segments))
        if n in (2, 5):
            check(spark, base, want)
    assert (1,) in levels and (1, 0, 0) in levels


def test_what_is_written_grows_with_the_batch(spark, tmp_path):
    base = f"file://{tmp_path}/ix"
    m = segments.add(spark, base, frame(spark, [(i, f"text number {i} of many words {i * 7} {i * 11}", False) for i in range(5000)]), "s", 0)
    size = lambda s: sum(f.stat().st_size for f in (tmp_path / "ix" / "segments" / s.name).rglob("*.parquet"))
    n = segments.add(spark, base, frame(spark, [(17, "another text", False)]), "s", 1)
    assert n.segments[0] == m.segments[0] and size(n.segments[1]) * 10 < size(n.segments[0])
    assert segments.read(spark, base).terms.where("term = '17'").count() == 0


@pytest.mark.parametrize("step", ["postings", "terms", "commit"])
def test_a_crash_between_steps_loses_nothing(spark, tmp_path, monkeypatch, step):
    base = f"file://{tmp_path}/ix"
    segments.add(spark, base, frame(spark, [(1, "alpha", False), (2, "beta", False)]), "s", 0)
    with monkeypatch.context() as patch:
        name = {"postings": "build_terms", "terms": "Segment", "commit": "commit"}[step]
        patch.setattr(segments, name, lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            segments.add(spark, base, frame(spark, [(2, "gamma", False)]), "s", 1)
    check(spark, base, {1: "alpha", 2: "beta"})
    segments.add(spark, base, frame(spark, [(2, "gamma", False)]), "s", 1)
    check(spark, base, {1: "alpha", 2: "gamma"})
    assert len(list((tmp_path / "ix" / "segments").iterdir())) == 2  # what the crash left is gone


def test_of_two_writers_one_fails(spark, tmp_path):
    base = f"file://{tmp_path}/ix"
    segments.commit(spark, base, segments.Manifest(1, {"a": 0}))
    with pytest.raises(FileExistsError):
        segments.commit(spark, base, segments.Manifest(1, {"b": 0}))
    assert segments.read_manifest(spark, base).batches == {"a": 0}
    with pytest.raises(FileNotFoundError):
        segments.read(spark, f"file://{tmp_path}/none")


def test_a_stream_and_then_another(spark, tmp_path):
    base, src = f"file://{tmp_path}/ix", tmp_path / "in"
    src.mkdir()
    run = segments.maintain(spark, spark.readStream.schema("chunk_id long, text string").json(str(src)), base)
    df = lambda rows: spark.createDataFrame(rows, "chunk_id long, text string")
    for rows in ([(1, "alpha beta"), (2, "beta")], [(2, "gamma"), (3, "alpha")]):
        df(rows).write.mode("append").json(str(src))
        run()
    check(spark, base, {1: "alpha beta", 2: "gamma", 3: "alpha"})
    # a new checkpoint over the same index: its batch 0 counts
    store.delete(spark, f"{base}/checkpoint")
    other = tmp_path / "other"
    df([(4, "delta")]).write.json(str(other))
    segments.maintain(spark, spark.readStream.schema("chunk_id long, text string").json(str(other)), base)()
    check(spark, base, {1: "alpha beta", 2: "gamma", 3: "alpha", 4: "delta"})
    assert len(segments.read_manifest(spark, base).batches) == 2


def test_former_texts_are_not_written_again(spark, tmp_path, monkeypatch):
    """What a batch replaces is noted by id; its texts are counted, not kept."""
    base, kept = f"file://{tmp_path}/ix", {}
    segments.add(spark, base, frame(spark, [(1, "alpha beta", False), (2, "beta", False), (3, "beta", False)]), "s", 0)
    plain = store.keep
    monkeypatch.setattr(store, "keep", lambda df, label: kept.setdefault(label, plain(df, label)))
    segments.add(spark, base, frame(spark, [(1, "gamma", False), (2, "", True)]), "s", 1)
    assert set(kept["old"].columns) == {"doc_id", "void_in"} and kept["old"].schema["doc_id"].dataType.simpleString() == "bigint"
    check(spark, base, {1: "gamma", 3: "beta"})
