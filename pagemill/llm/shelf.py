"""Shared storage and small DataFrame helpers of the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir of the
    cluster; a temporary one only where that is unset on a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="pagemill-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def put(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Writes df as a table in the shared folder, in a folder for each value of
    `by`, and reads it again: lineage ends there and a lost executor costs
    nothing that was already written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shelf_path = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes a table that put() wrote and nothing reads any more."""
    path = getattr(df, "_shelf_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a long, b long) as (node, component),
    component being the smallest node that links reach.

    Alternating large-star and small-star rounds; each round is two
    aggregations over the edges, which shrink towards one star per component.
    Minima are pre-aggregated before each shuffle, and joining them back is an
    ordinary equi-join, so a node with very many links is split by AQE.
    """
    cur = put(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct(),
        "edges",
    )
    for _ in range(max_rounds):
        # large star: every larger neighbour of u points at u's least neighbour
        both = cur.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
            cur.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        # small star: u and its smaller neighbours point at the least of them
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(low, "hi")
            .select(F.explode(F.array(F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")), F.struct("hi", F.col("m").alias("lo")))).alias("e"))
            .select("e.hi", "e.lo")
            .where("hi <> lo")
            .distinct()
        )
        new = put(small, "edges")
        # done when every node has one parent and no parent has a parent
        tops = new.select(F.col("lo").alias("hi")).distinct()
        bad = new.groupBy("hi").count().where("count > 1").select("hi").union(new.join(tops, "hi", "left_semi").select("hi")).limit(1).count()
        drop(cur)
        cur = new
        if not bad:
            break
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
        cur.select("lo").distinct().select(F.col("lo").alias("node"), F.col("lo").alias("component"))
    )
