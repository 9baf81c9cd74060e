"""Keyed ledgers: records from CSV rows, idempotent appends, union of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REVIEW = ["id", "source", "url", "date", "rating", "text"]


def records(raw: DataFrame, order: str | None = None) -> DataFrame:
    """Headers lower-cased and trimmed, cells trimmed, missing cells empty, blank rows dropped, __line numbered from 2.

    order: a column with the record's place in its file (from 0, blank rows not counted).
    """
    cols = [c for c in raw.columns if c != order]
    out = raw.select(*[F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(c.strip().lower()) for c in cols], *([F.col(order)] if order else []))
    if len(cols) == 1:
        out = out.where(F.col(cols[0].strip().lower()) != "")
    return out.withColumn("__line", (F.col(order) + 2).cast("int")).drop(order) if order else out


def append(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """The rows of new whose key the ledger lacks, in the ledger's columns; repeats inside new all stay."""
    fresh = new.join(old.select(key).distinct(), key, "left_anti")
    have = set(fresh.columns)
    return fresh.select(*[F.col(c) if c in have else F.lit("").alias(c) for c in old.columns])


def appended(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """One row: added, skipped."""
    known = old.select(key).distinct().withColumn("_known", F.lit(1))
    return new.join(known, key, "left").agg(F.count_if(F.col("_known").isNull()).alias("added"), F.count_if(F.col("_known").isNotNull()).alias("skipped"))


def union_sources(frames: list[DataFrame], columns: list[str] = REVIEW) -> DataFrame:
    """One schema from several sources; missing columns are empty."""
    out = None
    for f in frames:
        have = set(f.columns)
        f = f.select(*[F.col(c).cast("string").alias(c) if c in have else F.lit("").alias(c) for c in columns])
        out = f if out is None else out.unionByName(f)
    return out
