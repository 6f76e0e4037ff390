"""Table functions for SQL: of one row (LATERAL), or of a table's rows by
Arrow batches, partitioned as the caller says or not at all."""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf, udtf

from pagemill.functions.text import RETRIEVAL_STOPWORDS

_TOKEN = re.compile("[a-z0-9]+")
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+", re.ASCII)
_STOP = frozenset(RETRIEVAL_STOPWORDS)


@udtf(returnType="pos int, term string")
class Terms:
    """SELECT t.* FROM docs, LATERAL terms(docs.text) t"""

    def eval(self, text: str):
        kept = (w for w in _TOKEN.findall((text or "").lower()) if len(w) > 1 and w not in _STOP)
        yield from enumerate(kept)


@udtf(returnType="pos int, sentence string")
class Sentences:
    def eval(self, text: str):
        yield from enumerate(_SENTENCE_END.split(text or ""))


@udtf(returnType="pos int, piece string")
class Pieces:
    """A text as pieces of at most `limit` characters."""

    def eval(self, text: str, limit: int):
        from pagemill.operators.chunking import split_long

        yield from enumerate(split_long(text or "", limit))


def _spread(ids: pa.Array, lists: list[list[str]], name: str) -> pa.Table:
    """A row an item: its id, its place in its list and itself."""
    sizes = np.fromiter((len(x) for x in lists), np.int64, len(lists))
    starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
    items = pa.array([s for x in lists for s in x], pa.string())
    owner = ids.cast(pa.int64()).take(pa.array(np.repeat(np.arange(len(lists)), sizes)))
    return pa.table({"id": owner, "pos": pa.array((np.arange(len(items)) - starts).astype(np.int32)), name: items})


class _OfTable:
    """A table function over the rows (id, text) of a table argument, a batch at
    a time; of a null text it makes what it makes of an empty one."""

    name: str

    def items(self, text: str) -> list[str]:
        raise NotImplementedError

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        texts = rows.column(1).to_pylist()
        yield _spread(rows.column(0), [self.items(t or "") for t in texts], self.name)


@arrow_udtf(returnType="id long, pos int, term string")
class TermsOf(_OfTable):
    """SELECT * FROM terms_of(TABLE(SELECT doc_id, text FROM docs))"""

    name = "term"

    def items(self, text: str) -> list[str]:
        return [w for w in _TOKEN.findall(text.lower()) if len(w) > 1 and w not in _STOP]


@arrow_udtf(returnType="id long, pos int, sentence string")
class SentencesIn(_OfTable):
    name = "sentence"

    def items(self, text: str) -> list[str]:
        return _SENTENCE_END.split(text)


@arrow_udtf(returnType="id long, pos int, piece string")
class PiecesIn:
    """Pieces of at most `size` characters, which the table's third column names."""

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        from pagemill.operators.chunking import split_long

        texts, sizes = rows.column(1).to_pylist(), rows.column(2).to_pylist()
        yield _spread(rows.column(0), [list(split_long(t or "", n)) for t, n in zip(texts, sizes)], "piece")


def register(spark: SparkSession) -> None:
    spark.udtf.register("terms", Terms)
    spark.udtf.register("sentences_of", Sentences)
    spark.udtf.register("pieces_of", Pieces)
    spark.udtf.register("terms_of", TermsOf)
    spark.udtf.register("sentences_in", SentencesIn)
    spark.udtf.register("pieces_in", PiecesIn)
