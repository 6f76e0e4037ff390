"""Exact top-k of a batch of queries over postings dealt out by document.

Scoring by a shuffle on (query, document) moves a row for every posting of
every query. Here a term's postings are moved once, however many queries share
it, to the part that their document is dealt to. A part has all that is known
of its documents, so it scores them for every query and gives k rows a query:
what is moved grows with the postings of the batch's distinct terms, what comes
back with the parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.sources import store

#: Postings of a part, about.
POSTINGS = 500_000
#: Kinds of rows that meet in a part.
TERM, POSTING, DOCUMENT, QUERY = range(4)


def _part(doc_id: Column | str, parts: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(parts)).cast("int")


def top(asked: DataFrame, names: DataFrame, postings: DataFrame, size: int, k: int, documents: DataFrame | None = None, wants: DataFrame | None = None, match: list[tuple[str, str]] | None = None) -> DataFrame:
    """(query_id, doc_id, score): at least the first k documents of each query
    by the sum of w * v over its terms, to nine places, then by doc_id; no more
    than k from a part.

    asked: query_id, term, w. names: term, tno, which postings (tno, doc_id, v)
    have in its place, about `size` rows, one a term and document. documents
    (doc_id, ...), if given, are all that may be found; match pairs columns of
    wants (query_id, ...) with columns of documents that must agree where the
    query's is not null."""
    match, parts = match or [], max(1, -(-int(size) // POSTINGS))
    kind = dict(postings.dtypes)["doc_id"]
    queries = asked.select("query_id").distinct() if wants is None else wants.join(asked.select("query_id").distinct(), "query_id")
    queries = store.keep(queries.withColumn("qno", F.monotonically_increasing_id()), "numbered_queries")
    every = F.broadcast(asked.sparkSession.range(parts).select(F.col("id").cast("int").alias("part")))  # a number a part

    # plain columns: Arrow's size of a list is counted anew for every row
    types = {"tno": "long", "qno": "long", "doc_id": kind, "v": "double"} | {f"a{i}": "string" for i in range(len(match))}

    def rows(df: DataFrame, what: int, **given: Column) -> DataFrame:
        return df.select("part", F.lit(what).cast("int").alias("kind"), *[given.get(c, F.lit(None)).cast(t).alias(c) for c, t in types.items()])

    texts = lambda cols: {f"a{i}": F.col(c) for i, c in enumerate(cols)}
    named = asked.join(queries.select("query_id", "qno"), "query_id").join(names, "term").select("tno", "qno", "w")
    meet = rows(named.crossJoin(every), TERM, tno=F.col("tno"), qno=F.col("qno"), v=F.col("w"))
    meet = meet.unionByName(rows(postings.withColumn("part", _part("doc_id", parts)), POSTING, tno=F.col("tno"), doc_id=F.col("doc_id"), v=F.col("v")))
    if match:
        meet = meet.unionByName(rows(queries.crossJoin(every), QUERY, qno=F.col("qno"), **texts([w for w, _ in match])))
    if documents is not None:
        meet = meet.unionByName(rows(documents.withColumn("part", _part("doc_id", parts)), DOCUMENT, doc_id=F.col("doc_id"), **texts([h for _, h in match])))
    restricted, width = documents is not None, len(match)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            table = pa.Table.from_batches(got)
            for p in np.unique(table["part"].to_numpy()):
                yield scored(table.filter(pc.equal(table["part"], int(p))).combine_chunks(), k, restricted, width)

    best = meet.repartition(parts, "part").mapInArrow(run, f"qno long, doc_id {kind}, score double")
    return best.join(queries.select("qno", "query_id"), "qno").select("query_id", "doc_id", "score")


def scored(table: pa.Table, k: int, restricted: bool, width: int) -> pa.RecordBatch:
    """(qno, doc_id, score) of a part: each query's first k."""
    of = {what: table.filter(pc.equal(table["kind"], what)) for what in (TERM, POSTING, DOCUMENT, QUERY)}
    ids = of[POSTING]["doc_id"].combine_chunks()
    known = ids.unique()
    known = known.take(pc.sort_indices(known, null_placement="at_start"))
    place = pc.index_in(ids, value_set=known).to_numpy()
    order = np.argsort(of[POSTING]["tno"].to_numpy(), kind="stable")
    tno, place, v = of[POSTING]["tno"].to_numpy()[order], place[order], of[POSTING]["v"].to_numpy()[order]
    qno, term, w = (of[TERM][c].to_numpy() for c in ("qno", "tno", "v"))
    # the terms of a query one after another, in the same order in every part
    by = np.lexsort((term, qno))
    qno, term, w = qno[by], term[by], w[by]
    lo, hi = np.searchsorted(tno, term, "left"), np.searchsorted(tno, term, "right")
    at = columns = wanted = None
    if restricted:
        at = pc.index_in(of[DOCUMENT]["doc_id"].combine_chunks(), value_set=known)
        have = pc.is_valid(at).to_numpy(zero_copy_only=False)
        at = at.filter(pa.array(have)).to_numpy()
        columns = [of[DOCUMENT][f"a{i}"].combine_chunks().filter(pa.array(have)).dictionary_encode() for i in range(width)]
        codes = [dict(zip(c.dictionary.to_pylist(), range(len(c.dictionary)), strict=True)) for c in columns]
        columns = [pc.fill_null(c.indices, -1).to_numpy() for c in columns]
        wanted = dict(zip(of[QUERY]["qno"].to_pylist(), zip(*[of[QUERY][f"a{i}"].to_pylist() for i in range(width)], strict=True), strict=True)) if width else {}
    sums, out = np.zeros(len(known)), []
    starts = np.flatnonzero(np.r_[True, qno[1:] != qno[:-1]]) if len(qno) else []
    for a, b in zip(starts, [*starts[1:], len(qno)], strict=True):
        sums[:] = 0
        for i in range(a, b):
            sums[place[lo[i] : hi[i]]] += w[i] * v[lo[i] : hi[i]]
        hits = sums > 0
        if restricted:
            fits = np.ones(len(at), bool)
            for i, want in enumerate(wanted.get(int(qno[a]), ())):
                if want is not None:
                    fits &= columns[i] == codes[i].get(want, -2)
            may = np.zeros(len(known), bool)
            may[at[fits]] = True
            hits &= may
        hits = np.flatnonzero(hits)
        score = np.floor(sums[hits] * 1e9 + 0.5) / 1e9
        if len(hits) > k:
            among = score >= -np.partition(-score, k - 1)[k - 1]
            hits, score = hits[among], score[among]
        first = np.lexsort((hits, -score))[:k]
        out.append((np.full(len(first), qno[a]), hits[first], score[first]))
    q, d, s = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), known.take(pa.array(d, pa.int64())), pa.array(s)], names=["qno", "doc_id", "score"])
