"""Shared pieces: table access, written intermediate tables, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeframe.session import shared_dir

_WRITTEN: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, keep: int = 0) -> None:
    """Remove the intermediate tables written so far but for the first ``keep``: once results that rest on them are stored."""
    while len(_WRITTEN) > keep:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def settled(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """``make()`` written and read back, and all intermediate tables that it wrote itself removed."""
    before = len(_WRITTEN)
    made = materialize(make(), label)
    path = _WRITTEN.pop()
    release(spark, before)
    _WRITTEN.append(path)
    return made


def spread(df: DataFrame) -> DataFrame:
    """Deal rows evenly over as many partitions as a shuffle has: for small rows that each make many."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def connected(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (node, root), root the smallest node.

    Alternates large-star and small-star rounds; each is a shuffle of the edges with partial
    minima, so a hub costs no single task. Only a count and a checksum reach the driver.
    Nodes without an edge have no row; loops and repeated edges are ignored. Nulls are ignored.
    """
    now = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialize(now, "edges")
    seen = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = materialize(large, "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialize(moved.union(low.select("a", F.col("m").alias("b"))).distinct(), "small")
        check = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(check) == seen:
            break
        seen = tuple(check)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
