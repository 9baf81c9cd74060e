"""Helpers that the corpus operators share: lineage cuts, graph components, table reading."""

from __future__ import annotations

import os
import tempfile
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.session import shared_folder, spread

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, read by Spark alone (the folder may be in a remote store)."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """The same, dealt out by key where a small table's files would leave cores idle."""
    return spread(table(spark, sf_dir, name), key)


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors where PYTHONPATH does not already do it."""
    sc = spark.sparkContext
    if getattr(sc, "_corvane_shipped", False):
        return
    sc._corvane_shipped = True
    paths = [os.path.realpath(p or ".") for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if os.path.realpath(_ROOT) in paths or os.path.realpath(os.getcwd()) == os.path.realpath(_ROOT):
        return
    import shutil

    base = os.path.join(tempfile.mkdtemp(prefix="corvane-"), "corvane")
    sc.addPyFile(shutil.make_archive(base, "zip", _ROOT, "corvane"))


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def connected_components(edges: DataFrame, src: str = "u", dst: str = "v") -> DataFrame:
    """Components of an undirected graph given as edges of longs: rows (node, root), root the smallest node.

    Alternating large-star and small-star passes; every pass only joins each node's smallest neighbour
    back on, so no neighbourhood is gathered in one place, and the edge set never grows. Nulls and loops
    are ignored; nodes without edges are not returned; no edges give an empty result.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def star(e: DataFrame, large: bool) -> DataFrame:
        """e: directed pairs (u, v) to consider at u. Links v (larger ones if large, else all and u) to u's least."""
        least = e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = e.join(least, "u")
        if large:
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        return out.where("u > v").distinct()

    def mark(e: DataFrame) -> tuple:
        r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    e = edges.select(F.greatest(src, dst).cast("long").alias("u"), F.least(src, dst).cast("long").alias("v")).where("u > v").distinct()
    e = cut(e)
    seen = mark(e)
    while seen[0]:
        e = cut(star(star(both(e), True), False))
        now = mark(e)
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
