"""A training corpus from raw documents: toxic ones go, one of each group of
near copies stays, personal data is masked, sources are mixed to their target
weights, and what is left is packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagemill.llm.minhash_dedup import without_near_copies
from pagemill.llm.mixing import in_mixed_order
from pagemill.llm.packing import packed
from pagemill.llm.pii import without_personal_data
from pagemill.llm.shelf import drop, put, table
from pagemill.llm.toxicity import without_toxic

#: (name, function of (spark, docs, sf_dir)); each but the last returns the
#: columns of docs.
STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_copies),
    ("personal_data", without_personal_data),
    ("mixing", in_mixed_order),
    ("packing", packed),
]

#: Lexicon learning, sketches and tokenisation have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir, each written before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        done = put(stage(spark, docs, sf_dir), name)
        drop(docs)  # the former stage's table, which nothing reads any more
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
