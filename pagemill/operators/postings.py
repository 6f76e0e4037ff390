"""Postings in blocks with their greatest impact, and top-k search that opens
only the blocks that can matter.

A block holds the postings of one term whose documents' hashed ids share their
first bits: as many bits as give about BLOCK postings, so a document's block is
known by an equality, and a term that every document has spreads over as many
rows as a rare one has postings. Beside its postings a block has its frontier:
the (tf, dl) pairs that no other of the block beats in both. The greatest score
of a block is that of one of them, whatever k1, b and the mean length are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.config import RetrievalConfig
from pagemill.functions.runs import packed_counts, term_counts
from pagemill.functions.text import tokenize
from pagemill.sources import store

#: Postings of a block, about; of a term, beyond which several tasks make its
#: blocks; characters of text whose postings make a folder, a file, and a task
#: where there is room for more.
BLOCK, HOT, FOLDER_CHARS, FILE_CHARS, TASK_CHARS = 16, 1_000_000, 16 << 30, 8 << 20, 1 << 20
#: Parts that each task's terms are dealt into, so that tasks are even.
DEALS = 16
#: Scores this much apart count as equal while blocks are left out.
SLACK = 1e-6


def place(doc_id: Column | str) -> Column:
    """Where a document stands in the order of hashed ids: uniform, so its
    first bits deal documents evenly."""
    return F.xxhash64(doc_id)


def cell(at: Column, bits: Column) -> Column:
    """The first `bits` bits of a place."""
    return F.when(bits > 0, F.call_function("shiftrightunsigned", at, 64 - bits)).otherwise(F.lit(0).cast("long"))


def bits_of(df: Column) -> Column:
    """Bits that part df postings into blocks of about BLOCK."""
    return F.greatest(F.lit(0), F.ceil(F.log2(df / F.lit(float(BLOCK))))).cast("int")


def bucket(term: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def frontier(rows: Column) -> Column:
    """The (tf, dl) pairs of rows that none of them beats: tf falling, dl
    falling too. A score rises with tf and falls with dl, so one of them has
    the greatest."""
    pairs = F.array_sort(F.transform(rows, lambda r: F.struct((-r["tf"]).alias("tf"), r["dl"].alias("dl"))))

    def step(kept: Column, p: Column) -> Column:
        return F.when((F.size(kept) == 0) | (p["dl"] < F.get(kept, F.size(kept) - 1)["dl"]), F.array_append(kept, p)).otherwise(kept)

    first = F.aggregate(pairs, F.slice(pairs, 1, 0), step)
    return F.transform(first, lambda p: F.struct((-p["tf"]).alias("tf"), p["dl"].alias("dl")))


@dataclass(frozen=True)
class Layout:
    """How a corpus' postings are dealt out: folders, files of one, and the
    terms, with their bits, whose blocks several tasks make, if any, each
    2 ** wide of them."""

    buckets: int
    spread: int
    hot: dict[str, int]
    wide: int


def layout(docs: DataFrame, id_col: str, text_col: str, tokenizer=tokenize, hot: int = HOT) -> Layout:
    """From the size of the texts; terms are counted only where a corpus is
    large enough to have hot ones."""
    n, chars = docs.agg(F.count("*"), F.coalesce(F.sum(F.length(text_col)), F.lit(0))).first()
    counts = {}
    if n > hot:
        seen = term_counts(docs, id_col, text_col, tokenizer).groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") > hot)
        counts = {r.term: r.hot_bits for r in seen.select("term", bits_of(F.col("df")).alias("hot_bits")).collect()}  # one a million postings at most
    buckets = 1
    while buckets * FOLDER_CHARS < chars:
        buckets *= 2
    spread = max(1, chars // buckets // FILE_CHARS, min(docs.sparkSession.sparkContext.defaultParallelism // buckets, chars // TASK_CHARS))
    return Layout(buckets, spread, counts, max(0, (hot // BLOCK).bit_length() - 2))


def parts_of(table: pa.Table) -> np.ndarray:
    """Where the rows of another (term, part) begin."""
    term, part = table["term"].combine_chunks(), table["part"].to_numpy()
    other = pc.not_equal(term.slice(1), term.slice(0, len(term) - 1)).to_numpy(zero_copy_only=False) | (part[1:] != part[:-1])
    return np.concatenate([[0], np.flatnonzero(other) + 1])


def in_blocks(table: pa.Table, hot: dict[str, int]) -> pa.RecordBatch:
    """blocks()' rows of whole parts of terms: packed_counts() in the order of
    term and part. hot: how many bits part the terms that have several parts."""
    table = table.combine_chunks()
    parts = parts_of(table)
    lists = {c: table[c].combine_chunks() for c in ("places", "ids", "tfs", "dls")}
    long = pc.list_value_length(lists["places"]).to_numpy()
    group = np.repeat(np.cumsum(np.bincount(parts, minlength=len(table))) - 1, long)
    place, tf, dl = (lists[c].flatten().to_numpy() for c in ("places", "tfs", "dls"))
    ids, place, tf, dl = lists["ids"].flatten(), place.view(np.uint64), tf.astype(np.int64), dl.astype(np.int64)
    order = np.lexsort((place, group))
    same = (place[order][1:] == place[order][:-1]) & (group[order][1:] == group[order][:-1])
    if same.any():  # rows that share an id add up; other ids hardly ever share a place
        order = pc.sort_indices(pa.table({"g": group, "p": place, "i": ids}), sort_keys=[("g", "ascending"), ("p", "ascending"), ("i", "ascending")]).to_numpy()
    group, place, tf, dl, ids = group[order], place[order], tf[order], dl[order], ids.take(pa.array(order))
    if same.any():
        a, b = ids.slice(1), ids.slice(0, len(ids) - 1)
        equal = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
        kept = np.concatenate([[0], np.flatnonzero(~(same & equal)) + 1])
        group, place, tf, dl, ids = group[kept], place[kept], np.add.reduceat(tf, kept), np.maximum.reduceat(dl, kept), ids.take(pa.array(kept))
    begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    terms, buckets = (table[c].combine_chunks().take(pa.array(parts)) for c in ("term", "bucket"))
    sizes = np.diff(np.append(begins, len(place)))
    given = np.array([hot.get(t, -1) for t in terms.to_pylist()]) if hot else np.full(len(sizes), -1)
    bits = np.where(given >= 0, given, np.maximum(0, np.ceil(np.log2(sizes / BLOCK)))).astype(np.int64)
    each = np.repeat(bits, sizes)
    cells = np.where(each > 0, place >> (64 - each).clip(0, 63).astype(np.uint64), 0).astype(np.int64)
    change = np.ones(len(place), bool)
    change[1:] = cells[1:] != cells[:-1]
    change[begins] = True
    first = np.flatnonzero(change)
    n = np.diff(np.append(first, len(place)))
    # the frontier: by falling tf and rising dl, those of less dl than all before them in the block
    block = np.cumsum(change) - 1
    order = np.lexsort((dl, -tf, block))
    low = dl[order] - block[order] * (int(dl.max(initial=0)) + 1)
    edge = np.ones(len(low), bool)
    edge[1:] = low[1:] < np.minimum.accumulate(low)[:-1]
    order = order[edge]
    pair = lambda at: [pa.array(tf[at]), pa.array(dl[at])]
    listed = lambda counts, values: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), values)
    whole = np.arange(len(place))
    frontiers = listed(np.bincount(block[order], minlength=len(first)), pa.StructArray.from_arrays(pair(order), names=["tf", "dl"]))
    rows = listed(n, pa.StructArray.from_arrays([ids, *pair(whole)], names=["doc_id", "tf", "dl"]))
    term, bucket = (x.take(pa.array(group[first])) for x in (terms, buckets))
    return pa.RecordBatch.from_arrays([bucket, term, pa.array(each[first].astype(np.int32)), pa.array(cells[first]), pa.array(n.astype(np.int32)), pa.array(np.add.reduceat(tf, first)), frontiers, rows], names=["bucket", "term", "bits", "cell", "n", "tokens", "frontier", "rows"])


#: Postings that are put into blocks at once, unless a term has more.
AT_ONCE = 1 << 18


def blocks(docs: DataFrame, to: Layout, id_col: str = "doc_id", text_col: str = "text", tokenizer=tokenize) -> DataFrame:
    """(bucket, term, bits, cell, n, tokens, frontier, rows) of docs' postings,
    a task's by term and cell; rows are array<struct<doc_id, tf, dl>>. Texts
    are tokenised and counted once, and one shuffle brings a term's postings
    together (a hot one's, those of neighbouring cells). Rows that share an id
    add up."""
    hot, wide = to.hot, to.wide
    rows = packed_counts(docs, place(id_col), {t: b - wide for t, b in hot.items() if b > wide}, id_col, text_col, tokenizer)
    deal = F.pmod(F.xxhash64("term", "part"), F.lit(to.spread * DEALS)).cast("int")
    dealt = rows.withColumn("bucket", bucket("term", to.buckets)).repartition(to.buckets * to.spread, "bucket", deal).sortWithinPartitions("bucket", "term", "part")
    kind = dict(docs.dtypes)[id_col]
    schema = f"bucket int, term string, bits int, cell long, n int, tokens long, frontier array<struct<tf: long, dl: long>>, rows array<struct<doc_id: {kind}, tf: long, dl: long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0  # what is held is the last part of a term, until its end is seen
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            n += pc.sum(pc.list_value_length(b.column("places"))).as_py()
            if n < AT_ONCE:
                continue
            table = pa.Table.from_batches(held)
            cut = int(parts_of(table)[-1])
            if cut:
                yield in_blocks(table.slice(0, cut), hot)
            held, n = table.slice(cut).combine_chunks().to_batches(), 0
        if held:
            yield in_blocks(pa.Table.from_batches(held), hot)

    return dealt.mapInArrow(run, schema)


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer=tokenize, hot: int = HOT) -> None:
    """docs' index as tables: blocks in folders by term, written once; then,
    from the blocks' heads alone, the corpus row and the terms."""
    spark = docs.sparkSession
    to = layout(docs, id_col, text_col, tokenizer, hot)
    made = blocks(docs, to, id_col, text_col, tokenizer)
    if to.buckets == 1:  # a folder of its own needs no sort by folder
        made.drop("bucket").write.mode("overwrite").parquet(f"{path}/blocks/bucket=0")
    else:
        made.sortWithinPartitions("bucket", "term", "cell").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/blocks")
    heads = read_blocks(spark, path, dict(docs.dtypes)[id_col]).drop("rows")
    corpus = docs.agg(F.count("*").alias("n_docs")).crossJoin(F.broadcast(heads.agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("total_terms"))))
    corpus = corpus.withColumn("avgdl", F.try_divide(F.col("total_terms").cast("double"), F.col("n_docs").cast("double"))).withColumn("buckets", F.lit(to.buckets)).withColumn("id_type", F.lit(dict(docs.dtypes)[id_col]))
    corpus.coalesce(1).write.mode("overwrite").parquet(f"{path}/corpus")
    terms_of(heads, spark.read.parquet(f"{path}/corpus")).write.mode("overwrite").parquet(f"{path}/terms")


def terms_of(heads: DataFrame, corpus: DataFrame) -> DataFrame:
    """(term, df, bits, frontier, idf): a term's frontier is that of its blocks'
    frontiers, those of a hot one merged by tasks before they meet."""
    # what is alone, as of most terms, is its own frontier
    merged = F.when(F.count("*") == 1, F.first("frontier")).otherwise(frontier(F.flatten(F.collect_list("frontier"))))
    some = heads.withColumn("piece", F.shiftright("cell", 10)).groupBy("term", "piece").agg(F.sum("n").alias("df"), F.max("bits").alias("bits"), merged.alias("frontier"))
    df = some.groupBy("term").agg(F.sum("df").cast("long").alias("df"), F.max("bits").alias("bits"), merged.alias("frontier"))
    n, d = F.col("n_docs"), F.col("df")
    return df.crossJoin(F.broadcast(corpus.select("n_docs"))).select("term", "df", "bits", "frontier", F.log(1 + (n - d + 0.5) / (d + 0.5)).alias("idf"))  # one-row side


def read_blocks(spark: SparkSession, path: str, id_type: str) -> DataFrame:
    schema = f"term string, bits int, cell long, n int, tokens long, frontier array<struct<tf: long, dl: long>>, rows array<struct<doc_id: {id_type}, tf: long, dl: long>>, bucket int"
    return spark.read.schema(schema).parquet(f"{path}/blocks")


def impact(pairs: Column, score) -> Column:
    """The greatest of score(tf, dl) over a frontier."""
    return F.array_max(F.transform(pairs, lambda p: score(p["tf"], p["dl"])))


class Search:
    """Top-k documents of a batch of queries over an index's blocks.

    terms has a row for each term of a query that the index knows: query_id,
    term, w (count in the query times idf), score(tf, dl) being what w is
    multiplied by. keep, if given, restricts scored rows (query_id, doc_id, ...)
    before anything is ranked.
    """

    #: Postings of a query's rarest terms that give its first threshold.
    SEED = 1024

    def __init__(self, terms: DataFrame, blocks: DataFrame, buckets: int, score, k: int, keep=None):
        self.blocks, self.buckets, self.score, self.k, self._limits = blocks, buckets, score, k, None
        self.keep, self.all = keep or (lambda rows: rows), keep is None
        ub = F.col("w") * impact(F.col("frontier"), score)
        by = Window.partitionBy("query_id").orderBy(F.desc("ub"), "term")
        rare = Window.partitionBy("query_id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, 0)
        rows = terms.withColumn("ub", ub).withColumn("bucket", bucket("term", buckets))
        rows = rows.withColumn("rest", F.coalesce(F.sum("ub").over(by.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0)))
        rows = rows.withColumn("seed", F.sum("df").over(rare) <= self.SEED).withColumn("first", F.row_number().over(by) == 1)
        self.terms = store.keep(rows.select("query_id", "term", "bucket", "w", "df", "bits", "avgdl", "ub", "rest", "seed", "first"), "query_terms")

    def _found(self, opened: DataFrame, more: list[str]) -> DataFrame:
        """(query_id, doc_id, part, ...): the postings of opened blocks, scored."""
        rows = opened.select("query_id", "term", "w", "avgdl", *more, F.explode("rows").alias("r"))
        return self.keep(rows.select("query_id", F.col("r.doc_id").alias("doc_id"), "term", *more, (F.col("w") * self.score(F.col("r.tf"), F.col("r.dl"))).alias("part")))

    def seeds(self) -> DataFrame:
        return self.terms.where("seed").join(self.blocks.select("bucket", "term", "cell", "rows", "n"), ["bucket", "term"])

    def _kth(self, rows: DataFrame, value: str) -> DataFrame:
        """(query_id, low): the k-th greatest value of each query that has k."""
        top = rows.withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(value)))).where(F.col("i") <= self.k)
        return top.groupBy("query_id").agg(F.count("*").alias("n"), F.min(value).alias("low")).where(F.col("n") == self.k).select("query_id", "low")

    def trials(self) -> tuple[DataFrame, DataFrame]:
        """The best documents within a query's rarest terms (query_id, doc_id,
        part), twice k of them, and the blocks of its other terms for them."""
        parts = self._found(self.seeds(), []).groupBy("query_id", "doc_id").agg(F.sum("part").alias("part"))
        top = store.keep(parts.withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("part"), "doc_id"))).where(F.col("i") <= 2 * self.k).drop("i"), "trials")
        return top, self._at(top.select("query_id", "doc_id").join(self.terms.where("not seed"), "query_id"), ["rows", "n"])

    def threshold(self) -> DataFrame:
        """(query_id, low): no document of the top k has less. The k-th
        greatest score of the trials, or the k-th greatest bound of a block of
        the query's greatest term, for each block has a posting that has it
        (unless rows are restricted)."""
        top, more = self.trials()
        low = self._kth(self._summed(top, more), "part")
        if self.all:
            bound = F.col("w") * impact(F.col("frontier"), self.score)
            heads = self.terms.where("first").join(self.blocks.select("bucket", "term", "frontier"), ["bucket", "term"])
            low = low.unionByName(self._kth(heads.select("query_id", bound.alias("bound")), "bound"))
        return low.groupBy("query_id").agg(F.max("low").alias("low"))

    def _at(self, rows: DataFrame, columns: list[str]) -> DataFrame:
        """rows (query_id, doc_id, a term's columns) with the block that has the
        document's posting of the term, if any has."""
        at = rows.withColumn("cell", cell(place("doc_id"), F.col("bits")))
        return at.join(self.blocks.select("bucket", "term", "cell", *columns), ["bucket", "term", "cell"])

    def _summed(self, parts: DataFrame, opened: DataFrame) -> DataFrame:
        """parts (query_id, doc_id, part) with what their documents have in the
        blocks that were opened for them added."""
        hit = F.get(F.filter("rows", lambda r: r["doc_id"] == F.col("doc_id")), 0)
        more = opened.withColumn("r", hit).where("r is not null").select("query_id", "doc_id", (F.col("w") * self.score(F.col("r.tf"), F.col("r.dl"))).alias("part"))
        return parts.select("query_id", "doc_id", "part").unionByName(more).groupBy("query_id", "doc_id").agg(F.sum("part").alias("part"))

    def limits(self) -> DataFrame:
        """The terms with `least`, what a posting must add for its document to
        be found by it, and `miss`, what a document that is found may have of
        it unopened. Terms stand by falling bound; a document of the top k is
        found by the first of its terms, for those behind that add up to `rest`
        at most. So a term whose bound is below `least` opens no block."""
        least = F.coalesce(F.col("low") - SLACK, F.lit(float("-inf"))) - F.col("rest")
        miss = F.when(F.col("ub") >= F.col("least"), F.least("ub", F.greatest("least", F.lit(0.0)))).otherwise(F.col("ub"))
        return self.terms.join(self.threshold(), "query_id", "left").withColumn("least", least).withColumn("miss", miss)

    def discoveries(self, limits: DataFrame) -> DataFrame:
        bound = F.col("w") * impact(F.col("frontier"), self.score)
        asked = limits.where("ub >= least").select("query_id", "term", "bucket", "w", "avgdl", "least", "miss")
        return asked.join(self.blocks.select("bucket", "term", "cell", "rows", "n", "frontier"), ["bucket", "term"]).where(bound >= F.col("least"))

    def survivors(self, limits: DataFrame) -> DataFrame:
        """(query_id, doc_id, part, open): documents that may be of the top k,
        first by the bounds of the terms of which something is unopened and
        that they were not found by (open), then by those of the very blocks
        that have them, of which the heads alone are read."""
        total = limits.groupBy("query_id").agg(F.max("low").alias("low"), F.sum("miss").alias("all_miss"), F.collect_list(F.when(F.col("miss") > 0, F.col("term"))).alias("unsure"))
        seen = self._found(self.discoveries(limits), ["miss"]).groupBy("query_id", "doc_id").agg(F.sum("part").alias("part"), F.sum("miss").alias("found_miss"), F.collect_list(F.when(F.col("miss") > 0, F.col("term"))).alias("found"))
        may = F.col("low").isNull() | (F.col("most") >= F.col("low") - SLACK)
        rows = seen.join(total, "query_id").withColumn("most", F.col("part") + F.col("all_miss") - F.col("found_miss")).where(may)
        rows = store.keep(rows.select("query_id", "doc_id", "part", "low", F.array_except("unsure", "found").alias("open")), "candidates")
        bound = F.col("w") * impact(F.col("frontier"), self.score)
        asked = rows.select("query_id", "doc_id", F.explode("open").alias("term")).join(self.terms, ["query_id", "term"])
        more = self._at(asked, ["frontier"]).groupBy("query_id", "doc_id").agg(F.sum(bound).alias("more"), F.collect_list("term").alias("there"))
        rows = rows.join(more, ["query_id", "doc_id"], "left").withColumn("most", F.col("part") + F.coalesce("more", F.lit(0.0))).where(may)
        return store.keep(rows.select("query_id", "doc_id", "part", F.coalesce("there", F.slice("open", 1, 0)).alias("open")), "survivors")

    def lookups(self, survivors: DataFrame) -> DataFrame:
        """Survivors' blocks of what is still open of them."""
        asked = survivors.select("query_id", "doc_id", F.explode("open").alias("term"))
        return self._at(asked.join(self.terms, ["query_id", "term"]), ["rows", "n"])

    #: One block of so many is looked at to tell whether bounds pay.
    SAMPLE = 64

    def loose(self) -> bool:
        """Whether bounds leave over half of the postings to open, told from
        the heads of some blocks. Nothing but the way to the result hangs on
        it."""
        self._limits = store.keep(self.limits(), "limits")
        some = self.blocks.select("bucket", "term", "cell", "n", "frontier").where(F.pmod(F.xxhash64("term", "cell"), F.lit(self.SAMPLE)) == 0)
        bound = F.col("w") * impact(F.col("frontier"), self.score)
        opens = (F.col("ub") >= F.col("least")) & (bound >= F.col("least"))
        n = self._limits.join(some, ["bucket", "term"]).agg(F.sum(F.when(opens, F.col("n")).otherwise(0)).alias("opened"), F.sum("n").alias("all")).first()
        return (n["opened"] or 0) > 0.5 * (n["all"] or 0)

    def scores(self) -> DataFrame:
        """(query_id, doc_id, score) of at least the top k documents."""
        left = self.survivors(self._limits or store.keep(self.limits(), "limits"))
        return self._summed(left, self.lookups(left)).select("query_id", "doc_id", F.round("part", 9).alias("score"))

    def opened(self) -> DataFrame:
        """(query_id, n_terms, postings, opened): how many postings a query's
        terms have, and how many of them the search reads."""
        limits = store.keep(self.limits(), "limits")
        blocks = [self.seeds(), self.trials()[1], self.discoveries(limits), self.lookups(self.survivors(limits))]
        rows = reduce(DataFrame.unionByName, [b.select("query_id", "term", "cell", "n").distinct() for b in blocks]).groupBy("query_id").agg(F.sum("n").alias("opened"))
        asked = self.terms.groupBy("query_id").agg(F.count("*").alias("n_terms"), F.sum("df").alias("postings"))
        return asked.join(rows, "query_id", "left").select("query_id", "n_terms", "postings", F.coalesce("opened", F.lit(0)).alias("opened"))


def search(terms: DataFrame, index, score, k: int, cfg: RetrievalConfig, keep=None) -> Search:
    """terms (query_id, term, qtf) against an index that has blocks."""
    known = terms.join(index.terms, "term").crossJoin(F.broadcast(index.corpus.select("avgdl")))  # one-row side
    known = known.withColumn("w", F.col("qtf") * F.col("idf"))
    return Search(known, index.blocks, index.buckets, lambda tf, dl: score(tf, dl, F.col("avgdl"), cfg), k, keep)
