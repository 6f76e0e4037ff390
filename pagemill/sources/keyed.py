"""A table in hash folders that batches are merged into by key.

A folder holds the rows whose key's hash ends in its bits, and divides when it
outgrows `rows_per_folder`. A merge reads and writes only the folders that the
batch's keys fall in; all others keep their files. What the table consists of
stands in numbered manifests that are created and never replaced, so a reader
sees the table before a merge or after it, a merge that ends at any step
leaves the former table, and of two merges at once one fails at the manifest
and can be run again. One writer is assumed for sweeping."""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagemill.sources import store

#: Manifests whose files are kept for readers that opened them.
KEPT = 2
#: Columns that name folders; a table can't have them itself.
DEPTH, CODE = "fold_depth", "fold_code"


@dataclass(frozen=True)
class Folder:
    """The rows whose hash ends in the `depth` bits of code; without a path, none."""

    depth: int
    code: int
    path: str | None = None
    rows: int = 0


@dataclass(frozen=True)
class State:
    number: int = 0
    key: str = ""
    schema: str = ""
    folders: tuple[Folder, ...] = (Folder(0, 0),)


def _numbers(spark: SparkSession, base: str) -> list[int]:
    if not store.exists(spark, f"{base}/manifests"):
        return []
    fs, p = store.filesystem(spark, f"{base}/manifests")
    names = (f.getPath().getName() for f in fs.listStatus(p))
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def state(spark: SparkSession, base: str, number: int | None = None) -> State:
    """The manifest of that number, the last unless told; an empty table where
    there is none."""
    if number is None:
        number = max(_numbers(spark, base), default=0)
    if number == 0:
        return State()
    got = json.loads(store.read_text(spark, f"{base}/manifests/{number:012d}.json"))
    return State(got["number"], got["key"], got["schema"], tuple(Folder(**f) for f in got["folders"]))


def read(spark: SparkSession, base: str, number: int | None = None) -> DataFrame:
    """The table's rows. A table that no merge has made is an error."""
    s = state(spark, base, number)
    if not s.schema:
        raise FileNotFoundError(f"no table at {base}")
    return _rows(spark, base, s.schema, s.folders)


def latest(rows: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row a key: that of greatest `order` (nulls least), then of greatest
    hash. Combined before the shuffle, so a hot key is one row a task."""
    plain = [c for c, t in rows.dtypes if not t.startswith(("map", "variant"))]
    by = F.struct(*([F.col(order).alias("o")] if order else []), F.xxhash64(*plain).alias("h"))
    return rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*rows.columns), by).alias("_row")).select("_row.*")


def merge(spark: SparkSession, base: str, new: DataFrame, key: str, order: str | None = None, rows_per_folder: int = 1_000_000) -> State:
    """Puts new's rows in place of those of equal key, or beside the others.
    Of several new rows of a key latest() decides; null is a key like any
    other. Columns that new lacks become null in its rows, those that the table
    lacks are added to it. The same batch again gives the same table."""
    if clash := {DEPTH, CODE} & set(new.columns):
        raise ValueError(f"columns {sorted(clash)} name folders")
    s = state(spark, base)
    if s.key and s.key != key:
        raise ValueError(f"the table at {base} has the key {s.key}, not {key}")
    _sweep(spark, base)
    schema = StructType.fromJson(json.loads(s.schema)) if s.schema else StructType()
    kinds = {f.name: f.dataType for f in schema}
    for f in new.schema:
        if f.name not in kinds:
            schema.add(f.name, f.dataType, True)
            kinds[f.name] = f.dataType
    cast = [(F.col(c) if c in new.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()]
    fresh = store.keep(latest(new.select(*cast), key, order), "fresh")
    met = _placed(fresh, key, s.folders).groupBy(DEPTH, CODE).count().collect()  # a row a folder
    more = {(r[DEPTH], r[CODE]): r["count"] for r in met}
    kept = tuple(f for f in s.folders if (f.depth, f.code) not in more)
    open_ = tuple(f for f in s.folders if (f.depth, f.code) in more)
    heirs = tuple(h for f in open_ for h in _divided(f, more[f.depth, f.code], rows_per_folder))
    done: dict[tuple[int, int], Folder] = {}
    if heirs:
        name = f"data/{uuid.uuid4().hex}"
        former = _rows(spark, base, schema.json(), open_).alias("a")
        stay = former.join(fresh.select(F.col(key).alias("_new")), F.expr(f"a.`{key}` <=> _new"), "left_anti")
        rows = _placed(stay.unionByName(fresh), key, heirs)
        rows.repartition(len(heirs), DEPTH, CODE).write.partitionBy(DEPTH, CODE).parquet(f"{base}/{name}")
        written = spark.read.parquet(f"{base}/{name}").groupBy(DEPTH, CODE).count().collect()  # from footers
        done = {(r[DEPTH], r[CODE]): Folder(r[DEPTH], r[CODE], f"{name}/{DEPTH}={r[DEPTH]}/{CODE}={r[CODE]}", r["count"]) for r in written}
    store.drop(fresh)
    out = State(s.number + 1, key, schema.json(), (*kept, *(done.get((h.depth, h.code), h) for h in heirs)))
    store.create_text(spark, f"{base}/manifests/{out.number:012d}.json", json.dumps(asdict(out)))
    return out


def _divided(f: Folder, more: int, room: int) -> list[Folder]:
    """The folder itself, or those it divides into."""
    n = f.rows + more
    levels = math.ceil(math.log2(n / room)) if n > 2 * room else 0
    return [Folder(f.depth + levels, f.code | i << f.depth) for i in range(1 << levels)]


def _placed(rows: DataFrame, key: str, folders: tuple[Folder, ...]) -> DataFrame:
    """rows with the folder that each falls in: one equi-join, as many copies
    before it as there are different depths."""
    spark = rows.sparkSession
    known = spark.createDataFrame([(f.depth, f.code) for f in folders], f"{DEPTH} int, {CODE} long")
    depths = F.array(*[F.lit(d) for d in sorted({f.depth for f in folders})])
    return rows.withColumn(DEPTH, F.explode(depths)).withColumn(CODE, _bits(F.xxhash64(key), F.col(DEPTH))).join(known, [DEPTH, CODE])


def _bits(h: Column, depth: Column) -> Column:
    return h.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), depth) - 1)


def _rows(spark: SparkSession, base: str, schema: str, folders: tuple[Folder, ...]) -> DataFrame:
    kind = StructType.fromJson(json.loads(schema))
    paths = [f"{base}/{f.path}" for f in folders if f.path]
    return spark.read.schema(kind).parquet(*paths) if paths else spark.createDataFrame([], kind)


def _sweep(spark: SparkSession, base: str) -> None:
    """Deletes manifests but the last KEPT, and folders that none of these
    names: replaced ones, and what a crash has left."""
    numbers = _numbers(spark, base)
    used = {f.path for n in numbers[-KEPT:] for f in state(spark, base, n).folders if f.path}
    for n in numbers[:-KEPT]:
        store.delete(spark, f"{base}/manifests/{n:012d}.json")
    if not store.exists(spark, f"{base}/data"):
        return
    whole = {p.split("/")[1] for p in used}
    fs, p = store.filesystem(spark, f"{base}/data")
    for run in fs.listStatus(p):
        name = run.getPath().getName()
        if name not in whole:
            fs.delete(run.getPath(), True)
            continue
        for d in fs.globStatus(store.filesystem(spark, f"{base}/data/{name}/{DEPTH}=*/{CODE}=*")[1]):
            at = d.getPath()
            if f"data/{name}/{at.getParent().getName()}/{at.getName()}" not in used:
                fs.delete(at, True)
