"""Evidence checks of review themes: which rows and quotes exist, what themes weigh, what no theme covers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import fold, round_half_up
from corvane.functions.urls import host

KINDS = ("hate", "missing", "unsolved", "love")
LOVE, OTHER, UNRATED = (0.2, 0.2, 0.3, 0.6, 0.9, 1.0), (1.0, 1.0, 0.8, 0.5, 0.3, 0.2), 0.6
ANALYSIS = "themes array<struct<id:string,kind:string,label:string,summary:string,rows:array<string>,quotes:array<struct<row:string,text:string>>>>"


def blank(c: str) -> Column:
    """The column, null where it is empty."""
    return F.nullif(F.col(c), F.lit(""))


def usable(reviews: DataFrame, pos: str = "pos") -> DataFrame:
    """Rows with url and text; a missing id becomes row- and the row's line in its file (pos counts from 0)."""
    kept = reviews.where(blank("url").isNotNull() & blank("text").isNotNull())
    return kept.withColumn("id", F.coalesce(blank("id"), F.concat(F.lit("row-"), (F.col(pos) + 2).cast("string"))))


def dropped(reviews: DataFrame) -> DataFrame:
    return reviews.agg(F.count_if(blank("url").isNull() | blank("text").isNull()).alias("dropped"))


def months_back(now: Column, months: int) -> Column:
    """The same day some months earlier; a day that month lacks runs over into the next."""
    return F.date_add(F.add_months(F.trunc(now, "MM"), -months), F.day(now) - 1)


def review_date(d: Column) -> Column:
    """A date, or the first of a month given as YYYY-MM; null if it is neither."""
    return F.try_to_date(F.when(F.length(d) == 7, F.concat(d, F.lit("-01"))).otherwise(d))


def weight(rating: Column, kind: Column, date: Column, cutoff: Column) -> Column:
    """Weight of a review in a theme: by rating, low ones heavy except for love; half if older than the cutoff."""
    r = rating.try_cast("double")
    at = F.floor(r + 0.5).cast("int")
    pick = lambda table: F.when((at >= 0) & (at <= 5), F.element_at(F.array(*[F.lit(x) for x in table]), at + 1)).otherwise(F.lit(UNRATED))
    base = F.when(r.isNull(), F.lit(UNRATED)).when(kind == "love", pick(LOVE)).otherwise(pick(OTHER))
    return base * F.when(review_date(date) < cutoff, F.lit(0.5)).otherwise(F.lit(1.0))


def cited(themes: DataFrame) -> DataFrame:
    """(theme, kind, id) distinct row ids of each theme."""
    return themes.select(F.col("id").alias("theme"), "kind", F.explode_outer(F.array_distinct("rows")).alias("id"))


def by_id(rows: DataFrame, pos: str = "pos") -> DataFrame:
    """One row an id, the last one."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc(pos)))).where("_n = 1").drop("_n")


def theme_rows(rows: DataFrame, themes: DataFrame) -> DataFrame:
    return cited(themes).join(by_id(rows), "id")


def theme_summary(rows: DataFrame, themes: DataFrame, now: dt.date, months: int = 18) -> DataFrame:
    """theme, kind, label, reviews, sources, weight, thin; heaviest first, themes without rows included."""
    source = F.lower(F.coalesce(blank("source"), host(F.col("url"))))
    w = weight(F.col("rating"), F.col("kind"), F.col("date"), months_back(F.lit(now), months))
    agg = theme_rows(rows, themes).groupBy("theme").agg(F.count("*").alias("reviews"), F.array_sort(F.collect_set(source)).alias("sources"), F.sum(w.cast("decimal(18,4)")).cast("double").alias("w"))
    base = themes.select(F.col("id").alias("theme"), "kind", F.coalesce("label", "id").alias("label"), F.monotonically_increasing_id().alias("ord"))
    out = base.join(agg, "theme", "left").withColumn("reviews", F.coalesce("reviews", F.lit(0)))
    out = out.withColumn("sources", F.coalesce("sources", F.array().cast("array<string>"))).withColumn("weight", round_half_up(F.coalesce("w", F.lit(0.0)), 1))
    out = out.withColumn("thin", (F.col("reviews") < 3) | (F.size("sources") < 2))
    return out.orderBy(F.desc("weight"), "ord").drop("w", "ord")


def errors(rows: DataFrame, themes: DataFrame) -> DataFrame:
    """(theme, rule, detail): unknown kinds and rows, themes without rows, quotes that are not in their row or not listed."""
    own = by_id(rows).select("id", "text")
    c = cited(themes).where("id is not null")
    kinds = themes.where(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False))).select(F.col("id").alias("theme"), F.lit("kind").alias("rule"), F.col("kind").alias("detail"))
    unknown = c.join(own, "id", "left_anti").select("theme", F.lit("unknown-row").alias("rule"), F.col("id").alias("detail"))
    real = c.join(own, "id", "left_semi").select("theme").distinct()
    none = themes.select(F.col("id").alias("theme")).join(real, "theme", "left_anti").select("theme", F.lit("no-rows").alias("rule"), F.lit(None).cast("string").alias("detail"))
    q = themes.select(F.col("id").alias("theme"), "rows", F.explode("quotes").alias("q")).select("theme", "rows", F.col("q.row").alias("id"), F.col("q.text").alias("quote"))
    joined = q.join(own, "id", "left")
    said = F.contains(F.lower(fold(F.col("text"))), F.lower(fold(F.col("quote"))))
    rule = F.when(F.col("text").isNull(), "unknown-quote-row").when(~said, "not-word-for-word").when(~F.array_contains("rows", F.col("id")), "unlisted-row")
    quotes = joined.select("theme", rule.alias("rule"), F.concat_ws(": ", "id", F.substring("quote", 1, 60)).alias("detail")).where("rule is not null")
    return kinds.unionByName(unknown).unionByName(none).unionByName(quotes)


def low(rows: DataFrame) -> DataFrame:
    r = F.col("rating").try_cast("double")
    return rows.where((r > 0) & (r <= 2))


def uncovered(rows: DataFrame, themes: DataFrame) -> DataFrame:
    """Reviews of one or two stars that no theme cites."""
    return low(rows).join(cited(themes).select("id").distinct(), "id", "left_anti")


def first_uncovered(rows: DataFrame, themes: DataFrame, most: int = 15) -> DataFrame:
    return uncovered(rows, themes).orderBy("pos").limit(most).select("id", "rating", "url", F.substring("text", 1, 220).alias("text"))


def coverage(rows: DataFrame, themes: DataFrame) -> DataFrame:
    """One row: percentage of low reviews that a theme cites, null if there are none."""
    hit = low(rows).join(cited(themes).select("id").distinct().withColumn("hit", F.lit(1)), "id", "left")
    n = F.count("*")
    return hit.agg(F.when(n > 0, round_half_up(F.count("hit") / n * 100)).cast("long").alias("coverage"))


def sources(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.lower(F.coalesce(blank("source"), F.lit("unknown"))).alias("source")).agg(F.count("*").alias("n"))


def sample(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("reviews"), F.min(blank("date")).alias("first"), F.max(blank("date")).alias("last"))
