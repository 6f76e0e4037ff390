"""Readers and writers of the engine's files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from pagemill import schemas as S
from pagemill.operators.index import TermIndex, index_stats, read_index
from pagemill.operators.ingest import nest, with_status
from pagemill.sources import store

PRUNED = ("normalized", "extracted", "raw")


def discover(spark: SparkSession, root: str, suffix: str = ".pdf") -> DataFrame:
    """(path, content, length) of files below root with the suffix, in any
    case, outside pruned folders, by path; contents are read only if used."""
    pattern = "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
    return files.where(~F.col("path").rlike("/(" + "|".join(PRUNED) + ")/")).select("path", "length", "content").dropDuplicates(["path"])


def with_checksum(files: DataFrame) -> DataFrame:
    return files.withColumn("checksum", F.sha2("content", 256))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Nested canonical documents, one JSON file each. An absent folder raises
    at once; so does one without a document."""
    out = spark.read.schema(S.DOCUMENT).option("multiLine", True).json(path)
    if out.limit(1).count() == 0:
        raise ValueError(f"no documents in {path}")
    return out


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.CHUNKS).option("mode", "FAILFAST").json(path).where("chunk_id is not null")


def read_eval_set(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query, category, relevant, pos) of an object with `queries`
    or of a bare list; a query's id is `id` or `qid`."""
    query = f"struct<{', '.join(c.replace(' ', ':', 1) for c in S.EVAL_QUERY.split(', '))}>"
    text = spark.read.text(path, wholetext=True)
    wrapped = F.when(F.ltrim(F.regexp_replace("value", r"^\s+", "")).startswith("["), F.concat(F.lit('{"queries":'), F.col("value"), F.lit("}"))).otherwise(F.col("value"))
    rows = text.select(F.from_json(wrapped, f"queries array<{query}>").alias("j")).select(F.posexplode("j.queries").alias("pos", "q"))
    return rows.select(F.coalesce("q.id", "q.qid").alias("query_id"), "q.query", F.coalesce("q.category", F.lit("")).alias("category"), F.coalesce("q.relevant_chunk_ids", F.expr("cast(array() as array<string>)")).alias("relevant"), "pos")


def qrels_of(eval_set: DataFrame) -> DataFrame:
    return eval_set.select("query_id", F.explode("relevant").alias("doc_id")).distinct()


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"documents array<struct<{', '.join(c.replace(' ', ':', 1) for c in S.REGISTRY.split(', '))}>>").option("multiLine", True).json(path).select(F.explode("documents").alias("d")).select("d.*")


def read_ocr(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, page_number, ocr_text, confidences) of OCR documents."""
    docs = spark.read.schema(S.OCR_DOCUMENT).option("multiLine", True).json(path)
    return docs.select("document_id", F.explode("ocr_pages").alias("p")).select("document_id", "p.page_number", "p.ocr_used", "p.ocr_text", "p.ocr_confidence_mean", "p.ocr_confidence_min")


def read_checkpoint(spark: SparkSession, path: str, label: str) -> DataFrame:
    """Finished queries of a label; torn lines are dropped and of a query id
    the last append wins, within it the last file position."""
    append = F.coalesce(F.nullif(F.regexp_extract(F.input_file_name(), r"append=(\d+)", 1), F.lit("")).cast("long"), F.lit(0))
    rows = spark.read.schema(S.CHECKPOINT).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).json(path).withColumn("_at", F.struct(append.alias("n"), F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i")))
    w = Window.partitionBy("qid").orderBy(F.desc("_at"))
    return rows.where((F.col("label") == label) & F.col("qid").isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_at")


def first_of(rows: DataFrame, n: int | None, by: str = "pos") -> DataFrame:
    """The first n by position, all if n is None."""
    return rows if n is None else rows.orderBy(by).limit(n)


def pending(queries: DataFrame, finished: DataFrame) -> DataFrame:
    """Queries that no finished row has."""
    return queries.join(finished.select(F.col("qid").alias("query_id")), "query_id", "left_anti")


def read_postings(spark: SparkSession, path: str) -> TermIndex:
    """A persisted term index, as index.write_index() leaves it."""
    return read_index(spark, path)


def open_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at path, made empty where there is none."""
    if not store.exists(spark, path):
        spark.createDataFrame([], schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def reset(spark: SparkSession, path: str) -> None:
    """Deletes what is at path; nothing there is no error."""
    if store.exists(spark, path):
        store.delete(spark, path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> int:
    """Writes df as JSON lines and returns how many rows that were, counted as
    they are written."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).json(path)
    return seen.get["n"]


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_checkpoint(rows: DataFrame, path: str) -> None:
    """Finished records, appended under the next number: files of an append are
    whole or not there, of two writers of a number one fails, and
    read_checkpoint() passes over what a crash elsewhere has torn."""
    spark, last = rows.sparkSession, 0
    if store.exists(spark, path):
        fs, p = store.filesystem(spark, path)
        names = (f.getPath().getName() for f in fs.listStatus(p))
        last = max((int(n[7:]) for n in names if n.startswith("append=") and n[7:].isdigit()), default=0)
    rows.write.mode("error").json(f"{path}/append={last + 1:012d}")


def write_registry(rows: DataFrame, path: str, outcome: DataFrame | None = None) -> int:
    """The registry, first with every document pending, later, given the
    outcome (document_id, status), with what became of it."""
    return write_json(with_status(rows, outcome), path)


def write_documents(blocks: DataFrame, path: str, parts: int = 64) -> None:
    """Nested documents as JSON lines, sorted by id within `parts` folders."""
    whole = nest(blocks).withColumn("part", F.pmod(F.xxhash64("document_id"), F.lit(parts)))
    whole.repartition("part").sortWithinPartitions("part", "document_id").write.mode("overwrite").partitionBy("part").json(path)


def write_stats(index: TermIndex, path: str, vectors: DataFrame | None = None, chunks: DataFrame | None = None) -> int:
    return write_json(index_stats(index, vectors, chunks), path)


def write_report(spark: SparkSession, path: str, title: str, tables: dict[str, DataFrame]) -> str:
    """A report of small tables as path.json and path.md; gives the latter's text."""
    got = {name: [r.asDict(recursive=True) for r in df.collect()] for name, df in tables.items()}
    text = "\n\n".join([f"# {title}", *(f"## {name}\n\n{markdown(rows)}" for name, rows in got.items())]) + "\n"
    store.write_text(spark, f"{path}.json", json.dumps({"title": title, **got}, default=str, indent=2, ensure_ascii=False))
    store.write_text(spark, f"{path}.md", text)
    return text


def upsert(existing: DataFrame, new: DataFrame, key: str = "chunk_id", order: str | None = None) -> DataFrame:
    """existing with the rows of new added or put in place of those of equal
    key. Of several new rows of a key the one of greatest `order` counts, then
    that of greatest hash, so a run that is repeated gives the same."""
    plain = [c for c, t in new.dtypes if not t.startswith(("map", "variant"))]
    last = Window.partitionBy(key).orderBy(*([F.desc(order)] if order else []), F.desc(F.xxhash64(*plain)))
    fresh = new.withColumn("_last", F.row_number().over(last)).where("_last = 1").drop("_last")
    return existing.join(fresh.select(key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def hits_of_store(rows: DataFrame) -> DataFrame:
    """Rows of scalar metadata (chunking.store_rows(), with a distance) as hits:
    lists from their commas, empty texts as null, similarity 1 - distance."""
    text = [c for c, t in rows.dtypes if t == "string" and c not in ("chunk_id", "context_text", "clause_ids")]
    out = rows.withColumn("clause_ids", F.filter(F.split("clause_ids", ","), lambda c: c != "")).withColumn("similarity", 1 - F.col("distance").cast("double"))
    for c in text:
        out = out.withColumn(c, F.nullif(c, F.lit("")))
    return out.withColumn("page_start", F.col("page_start").cast("int")).withColumn("page_end", F.col("page_end").cast("int"))


def as_json(rows: DataFrame, key: str) -> DataFrame:
    """(key, body): each row as a JSON object, nulls kept."""
    return rows.select(key, F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("body"))


def markdown(rows: list[dict], columns: list[str] | None = None) -> str:
    """A small collected result as a Markdown table."""
    if not rows:
        return ""
    columns = columns or list(rows[0])
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in rows])
