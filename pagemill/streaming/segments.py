"""An index that grows by batches: immutable segments under numbered manifests.

A batch writes one segment: its chunks, their postings, how it changes each
term's document count, and which older segments' rows it makes void. A manifest
names the segments that count and sums what the corpus row needs; it is created
under the next number, never replaced, so readers see whole states and of two
writers one fails. Where the last FAN segments are of one level they are merged
into one of the next before the manifest is written: a row is rewritten as
often as the index has levels. What a crash leaves has no manifest, counts for
nothing and is deleted by the next batch.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators.index import TermIndex, build_terms, with_df
from pagemill.sources import store
from pagemill.sources.io import upsert
from pagemill.streaming.logs import run_available

#: Segments of a level that make one of the next, and manifests that are kept
#: for those who read an older state.
FAN, KEPT = 4, 2


@dataclass(frozen=True)
class Segment:
    name: str
    level: int
    #: What this segment adds to the corpus: documents and terms.
    docs: int
    terms: int


@dataclass(frozen=True)
class Manifest:
    number: int = 0
    #: The last batch of each stream, by the stream's id.
    batches: dict[str, int] = field(default_factory=dict)
    segments: tuple[Segment, ...] = ()
    schema: str = ""


def _numbers(spark: SparkSession, base: str) -> list[int]:
    if not store.exists(spark, f"{base}/manifests"):
        return []
    fs, p = store.filesystem(spark, f"{base}/manifests")
    return sorted(int(n[:-5]) for f in fs.listStatus(p) if (n := f.getPath().getName()).endswith(".json") and n[:-5].isdigit())


def read_manifest(spark: SparkSession, base: str, number: int | None = None) -> Manifest:
    """The manifest of that number, the last one unless told; an empty one
    where there is none yet. Any other error is raised."""
    if number is None:
        number = max(_numbers(spark, base), default=0)
    if number == 0:
        return Manifest()
    got = json.loads(store.read_text(spark, f"{base}/manifests/{number:012d}.json"))
    return Manifest(got["number"], got["batches"], tuple(Segment(**s) for s in got["segments"]), got["schema"])


def commit(spark: SparkSession, base: str, m: Manifest) -> None:
    """Writes m under its number. Another manifest of that number is an error,
    and m counts for nothing."""
    store.create_text(spark, f"{base}/manifests/{m.number:012d}.json", json.dumps(asdict(m)))


def _table(spark: SparkSession, base: str, segments: tuple[Segment, ...], part: str, schema: str) -> DataFrame:
    """A part of all these segments, with the segment that each row is in."""
    some = [spark.read.schema(schema).parquet(f"{base}/segments/{s.name}/{part}").withColumn("segment", F.lit(s.name)) for s in segments]
    return reduce(DataFrame.unionByName, some) if some else spark.createDataFrame([], f"{schema}, segment string")


def _id_type(schema: str, id_col: str) -> str:
    return next(f.split()[1] for f in schema.split(", ") if f.split()[0] == id_col)


def _void(spark: SparkSession, base: str, m: Manifest, id_type: str) -> DataFrame:
    """(doc_id, segment) of rows that later segments have made void."""
    return _table(spark, base, m.segments, "void", f"doc_id {id_type}, void_in string").select("doc_id", F.col("void_in").alias("segment"))


def read_chunks(spark: SparkSession, base: str, id_col: str = "chunk_id", m: Manifest | None = None) -> DataFrame:
    """The chunks that count now, with the segment that each is in."""
    m = m or read_manifest(spark, base)
    if not m.schema:
        raise FileNotFoundError(f"no index at {base}")
    rows = _table(spark, base, m.segments, "chunks", m.schema)
    gone = _void(spark, base, m, _id_type(m.schema, id_col)).withColumnRenamed("doc_id", id_col)
    return rows.join(gone, [id_col, "segment"], "left_anti")


def _postings(spark: SparkSession, base: str, m: Manifest, segments: tuple[Segment, ...], id_type: str) -> DataFrame:
    rows = _table(spark, base, segments, "postings", f"doc_id {id_type}, term string, tf long, dl int")
    return rows.join(_void(spark, base, m, id_type), ["doc_id", "segment"], "left_anti")


def read(spark: SparkSession, base: str, id_col: str = "chunk_id", number: int | None = None) -> TermIndex:
    """The index of a manifest's state, the last one's unless told: document
    counts are sums of what the segments changed."""
    m = read_manifest(spark, base, number)
    if not m.schema:
        raise FileNotFoundError(f"no index at {base}")
    docs, total = sum(s.docs for s in m.segments), sum(s.terms for s in m.segments)
    corpus = spark.range(1).select(F.lit(docs).cast("long").alias("n_docs"), F.lit(total).cast("long").alias("total_terms"), F.lit(total / docs if docs else None).cast("double").alias("avgdl"))
    df = _table(spark, base, m.segments, "terms", "term string, change long").groupBy("term").agg(F.sum("change").alias("df")).where("df > 0")
    return TermIndex(_postings(spark, base, m, m.segments, _id_type(m.schema, id_col)).drop("segment"), with_df(df, corpus), corpus)


def add(spark: SparkSession, base: str, batch: DataFrame, stream: str, batch_id: int, id_col: str = "chunk_id") -> Manifest:
    """Takes a batch of chunks (id_col, text, ...) into base: those of known ids
    replace the former ones, and those whose column `deleted`, if there is one,
    is true are taken out. Of several rows of an id that of greatest hash
    counts. A batch that its stream has committed before changes nothing.

    What is written grows with the batch, merges apart. Former rows of the
    batch's ids are looked up, as their terms no longer count."""
    m = read_manifest(spark, base)
    if m.batches.get(stream, -1) >= batch_id:
        return m
    _sweep(spark, base)
    deleted = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in batch.columns else F.lit(False)
    rows = store.keep(upsert(batch.limit(0), batch, id_col).withColumn("_gone", deleted), "batch")
    new = rows.where("not _gone").drop("_gone", "deleted")
    schema = m.schema or ", ".join(f"{c} {t}" for c, t in new.dtypes)
    id_type = _id_type(schema, id_col)
    name, ids = uuid.uuid4().hex, rows.select(F.col(id_col).alias("doc_id"))
    path = f"{base}/segments/{name}"
    old = former = None
    if m.segments:
        # ids alone are met first; of the texts, only those of rows found are moved
        found = read_chunks(spark, base, id_col, m).select(id_col, "segment").join(rows.select(id_col), id_col, "left_semi")
        old = store.keep(found.select(F.col(id_col).alias("doc_id"), F.col("segment").alias("void_in")), "old")
        old.write.parquet(f"{path}/void")
        texts = _table(spark, base, m.segments, "chunks", m.schema).select(F.col(id_col).alias("doc_id"), "text", F.col("segment").alias("void_in"))
        counted = build_terms(texts.join(old, ["doc_id", "void_in"], "left_semi"), unique=True).postings
        former = store.keep(counted.groupBy("term").agg((-F.count("*")).alias("change"), F.sum("tf").alias("tokens")), "former")
    else:
        ids.limit(0).withColumn("void_in", F.lit("")).write.parquet(f"{path}/void")
    new.select(*[F.col(f.split()[0]) for f in schema.split(", ")]).write.parquet(f"{path}/chunks")
    build_terms(new, id_col, unique=True).postings.write.parquet(f"{path}/postings")  # a row an id, since upsert()
    postings = spark.read.parquet(f"{path}/postings")
    change = postings.groupBy("term").agg(F.count("*").alias("change"))
    docs, total = new.count(), postings.agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0]
    if old is not None:
        docs, total = docs - old.count(), total - former.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
        change = change.unionByName(former.select("term", "change")).groupBy("term").agg(F.sum("change").alias("change")).where("change <> 0")
    change.write.parquet(f"{path}/terms")
    done = Manifest(m.number + 1, m.batches | {stream: batch_id}, (*m.segments, Segment(name, 0, docs, total)), schema)
    while len(done.segments) >= FAN and len({s.level for s in done.segments[-FAN:]}) == 1:
        done = Manifest(done.number, done.batches, (*done.segments[:-FAN], _merge(spark, base, done, id_type, id_col)), schema)
    commit(spark, base, done)
    for kept in (rows, old, former):
        if kept is not None:
            store.drop(kept)
    return done


def _merge(spark: SparkSession, base: str, m: Manifest, id_type: str, id_col: str) -> Segment:
    """One segment of the next level out of m's last FAN: the rows that count,
    the changes summed, and what is void in segments before them."""
    last = m.segments[-FAN:]
    name = uuid.uuid4().hex
    path, names = f"{base}/segments/{name}", [s.name for s in last]
    void = _table(spark, base, last, "void", f"doc_id {id_type}, void_in string").drop("segment")
    void.where(~F.col("void_in").isin(names)).write.parquet(f"{path}/void")
    read_chunks(spark, base, id_col, m).where(F.col("segment").isin(names)).drop("segment").write.parquet(f"{path}/chunks")
    _postings(spark, base, m, last, id_type).drop("segment").write.parquet(f"{path}/postings")
    _table(spark, base, last, "terms", "term string, change long").groupBy("term").agg(F.sum("change").alias("change")).where("change <> 0").write.parquet(f"{path}/terms")
    return Segment(name, last[0].level + 1, sum(s.docs for s in last), sum(s.terms for s in last))


def _sweep(spark: SparkSession, base: str) -> None:
    """Deletes manifests but the last KEPT, and segments that none of these
    names: merged ones, and what a crash has left."""
    numbers = _numbers(spark, base)
    used = {s.name for n in numbers[-KEPT:] for s in read_manifest(spark, base, n).segments}
    for n in numbers[:-KEPT]:
        store.delete(spark, f"{base}/manifests/{n:012d}.json")
    if store.exists(spark, f"{base}/segments"):
        fs, p = store.filesystem(spark, f"{base}/segments")
        for f in fs.listStatus(p):
            if f.getPath().getName() not in used:
                fs.delete(f.getPath(), True)


def maintain(spark: SparkSession, chunks: DataFrame, base: str, id_col: str = "chunk_id") -> Callable[[], None]:
    """A run that takes a stream of chunks into base. Batches are told apart by
    the stream's own id, as its checkpoint has it: a new checkpoint begins a
    new stream over the same index, and loses no batch to the old one's."""
    checkpoint = f"{base}/checkpoint"

    def each(batch: DataFrame, batch_id: int) -> None:
        stream = json.loads(store.read_text(spark, f"{checkpoint}/metadata"))["id"]
        add(spark, base, batch, stream, batch_id, id_col)

    return lambda: run_available(chunks, checkpoint, each)
