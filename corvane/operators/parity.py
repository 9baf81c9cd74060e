"""Weighted completion of a feature matrix, measured metrics and the verdict over both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import round_half_up

WEIGHT, DONE = {"must": 3, "should": 2, "could": 1}, {"yes": 1.0, "partial": 0.5, "no": 0.0}
BAR, TIE = 80, 0.02


def choose(c: Column, table: dict, otherwise) -> Column:
    out = F
    for k, v in table.items():
        out = out.when(c == k, F.lit(v))
    return out.otherwise(F.lit(otherwise))


def typed(features: DataFrame) -> DataFrame:
    """features with lower-case enums, weight w, completion d, is_fix (the original lacks it) and scored."""
    low = lambda c, d="": F.lower(F.coalesce(c, F.lit(d)))
    out = features.withColumn("priority_", low("priority")).withColumn("clone_", low("clone")).withColumn("original_", low("original", "yes"))
    out = out.withColumn("w", choose(F.col("priority_"), WEIGHT, 1)).withColumn("d", choose(F.col("clone_"), DONE, 0.0))
    out = out.withColumn("is_fix", F.col("original_") == "no").withColumn("scored", ~F.col("is_fix") & (F.col("clone_") != "skip"))
    return out.withColumn("area_", F.coalesce(F.nullif("area", F.lit("")), F.lit("general")))


def score_of(got: Column, total: Column) -> Column:
    return F.when(total > 0, round_half_up(got / total * 100, 1)).otherwise(F.lit(0.0))


def by_area(features: DataFrame) -> DataFrame:
    """area (null for all), score, musts, musts_done: one pass by grouping sets."""
    t = typed(features).where("scored")
    got, total = F.sum(F.col("w") * F.col("d")), F.sum("w")
    must = F.col("priority_") == "must"
    out = t.rollup("area_").agg(score_of(got, total).alias("score"), F.count_if(must).alias("musts"), F.count_if(must & (F.col("clone_") == "yes")).alias("musts_done"), F.grouping("area_").alias("g"))
    return out.select(F.when(F.col("g") == 0, F.col("area_")).alias("area"), "score", "musts", "musts_done").orderBy(F.col("area").isNull().desc(), "score", "area")


def problems(features: DataFrame) -> DataFrame:
    """(line, problem, value) of rows outside the enums or skipped without a reason."""
    t = typed(features)
    bad = [
        (~F.col("priority_").isin(*WEIGHT), "priority", F.col("priority")),
        (~F.col("clone_").isin(*DONE, "skip"), "clone", F.col("clone")),
        ((F.col("clone_") == "skip") & F.nullif(F.coalesce("notes", F.lit("")), F.lit("")).isNull(), "skip-reason", F.col("feature")),
    ]
    found = F.filter(F.array(*[F.when(c, F.struct(F.lit(p).alias("problem"), v.alias("value"))) for c, p, v in bad]), lambda x: x.isNotNull())
    return t.select("__line", F.explode(found).alias("p")).select(F.col("__line").alias("line"), "p.problem", "p.value")


def missing(features: DataFrame) -> DataFrame:
    """Scored features not done, must first."""
    t = typed(features).where("scored and clone_ <> 'yes'")
    return t.orderBy(choose(F.col("priority_"), {"must": 0, "should": 1, "could": 2}, 3), "__line").select("id", "feature", "priority", "clone", "notes")


def fixes(features: DataFrame) -> DataFrame:
    return typed(features).where("is_fix").agg(F.count_if(F.col("clone_") == "yes").alias("built"), F.count("*").alias("planned"))


def number(c: Column) -> Column:
    """A number; empty text counts as 0, other text as null."""
    return F.when(F.trim(c.cast("string")) == "", F.lit(0.0)).otherwise(c.try_cast("double"))


def metrics(beat: DataFrame) -> DataFrame:
    """name, better, result: win, loss, tie or unmeasured, by the relative change in the better direction."""
    o, c = number(F.col("original")), number(F.col("clone"))
    better = F.coalesce("better", F.lit("lower"))
    delta = F.when(better == "lower", o - c).otherwise(c - o) / F.greatest(F.abs(o), F.lit(1e-9))
    result = F.when(o.isNull() | c.isNull(), "unmeasured").when(delta > TIE, "win").when(delta < -TIE, "loss").otherwise("tie")
    return beat.select("name", "original", "clone", better.alias("better"), result.alias("result"))


def verdict(features: DataFrame, beat: DataFrame | None = None) -> DataFrame:
    """One row: parity, musts, musts_done, built, planned, wins, losses, verdict, why."""
    total = by_area(features).where("area is null").select(F.col("score").alias("parity"), "musts", "musts_done")
    spark = features.sparkSession
    zero = spark.createDataFrame([(0,)], "one int")
    total = zero.join(total, F.lit(True), "left").na.fill({"parity": 0.0, "musts": 0, "musts_done": 0}).drop("one")
    if beat is None:
        beat = spark.createDataFrame([], "name string, original double, clone double, better string")
    m = metrics(beat).agg(F.count("*").alias("measured"), F.count_if(F.col("result") == "win").alias("wins"), F.count_if(F.col("result") == "loss").alias("losses"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("result") == "loss", F.col("name")))), ", ").alias("lost"))
    one = total.join(fixes(features), F.lit(True)).join(m, F.lit(True))  # one row each
    ship = (F.col("musts_done") == F.col("musts")) & (F.col("parity") >= BAR)
    needed = F.least(F.lit(3), F.col("planned"))
    better = ship & (F.col("planned") > 0) & (F.col("built") >= needed) & (F.col("losses") == 0) & (F.col("wins") > 0)
    text = lambda *p: F.concat(*[F.lit(x) if not isinstance(x, Column) else x.cast("string") for x in p])
    c = F.col
    reasons = F.array(
        F.when(c("planned") == 0, "no fixes planned from research").when(c("built") < needed, text(c("built"), " of ", needed, " fixes built")),
        F.when(c("measured") == 0, "nothing measured").when(c("wins") == 0, "no measured win"),
        F.when(c("losses") > 0, text(c("losses"), " metric(s) worse than the original: ", c("lost"))),
    )
    why = (
        F.when(~ship & (c("musts_done") < c("musts")), text(c("musts") - c("musts_done"), " must-have(s) not done"))
        .when(~ship, text("parity ", c("parity"), " is under 80"))
        .when(better, text(c("built"), " fix(es) built, ", c("wins"), " measured win(s), no losses"))
        .otherwise(F.array_join(reasons, "; "))
    )
    name = F.when(~ship, "not shippable").when(better, "better than the original").otherwise("shippable")
    return one.select("parity", "musts", "musts_done", "built", "planned", "wins", "losses", name.alias("verdict"), why.alias("why"))


def by_priority(features: DataFrame) -> DataFrame:
    """area by must, should, could: counts of features that the original has."""
    t = typed(features).where(~F.col("is_fix"))
    return t.groupBy(F.col("area_").alias("area")).pivot("priority_", list(WEIGHT)).count().na.fill(0)
