"""Staged checks: every check is a row (stage, mode, ord, name, status, detail, fix); a stage passes if none failed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STRUCTURE_BAR = {"app": 60, "site": 80, "feature": 0, "migrate": 90}
CRITIC_BAR = {"app": 28, "site": 30, "feature": 28, "migrate": 0}
PIXEL_BAR, REVIEW_BAR = 95, 30
STAGES = ("research", "design", "build", "launch")
SCHEMA = "stage string, mode string, ord int, name string, status string, detail string, fix string"
#: Modes in which a check applies; in the others it is skipped.
APPLIES = {
    ("research", "reviews"): ("app", "feature"), ("research", "measured"): ("app", "site", "migrate"),
    ("design", "*"): ("app", "site", "feature"), ("build", "structure"): ("app", "site", "migrate"), ("build", "pixels"): ("migrate",),
    ("build", "urls"): ("migrate",), ("build", "critic"): ("app", "site", "feature"), ("build", "copy"): ("app", "site", "feature"),
    ("build", "sweep"): ("app", "site", "feature"), ("build", "parity"): ("app", "feature"), ("launch", "brand"): ("app", "site"), ("launch", "better"): ("app",),
}


def check(facts: DataFrame, stage: str, mode: str, ord_: int, name: str, ok: Column, detail: Column | str, fix: str) -> DataFrame:
    """One check row from a one-row table of facts; a check that does not apply in the mode is skipped."""
    modes = APPLIES.get((stage, name)) or APPLIES.get((stage, "*"))
    status = F.lit("skip") if modes and mode not in modes else F.when(F.coalesce(ok, F.lit(False)), "pass").otherwise("fail")
    d = detail if isinstance(detail, Column) else F.lit(detail)
    return facts.select(F.lit(stage).alias("stage"), F.lit(mode).alias("mode"), F.lit(ord_).alias("ord"), F.lit(name).alias("name"), status.alias("status"), d.cast("string").alias("detail"), F.lit(fix).alias("fix"))


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def research(facts: DataFrame, mode: str) -> DataFrame:
    """facts: sources, reviews, pain_errors, themes, verdict_given, measurements, recon_filled, features, feature_problems, unsourced, musts."""
    c, n = F.col, "research"
    return union([
        check(facts, n, mode, 1, "sources", c("sources") >= 3, c("sources"), "Read three sources or more."),
        check(facts, n, mode, 2, "reviews", c("reviews") >= REVIEW_BAR, c("reviews"), "Collect reviews with link and text."),
        check(facts, n, mode, 3, "pains", (c("pain_errors") == 0) & (c("themes") >= 3), F.concat_ws(" errors, ", "pain_errors", "themes"), "Fix what does not check out."),
        check(facts, n, mode, 4, "verdict", c("verdict_given"), c("verdict_given"), "Write the decision."),
        check(facts, n, mode, 5, "measured", c("measurements") >= 1, c("measurements"), "Measure a page."),
        check(facts, n, mode, 6, "recon", c("recon_filled"), c("recon_filled"), "Fill in the template."),
        check(facts, n, mode, 7, "features", (c("features") >= 5) & (c("feature_problems") == 0) & (c("unsourced") == 0) & (c("musts") >= 1), c("features"), "Complete the matrix."),
    ])


def design(facts: DataFrame, mode: str) -> DataFrame:
    """facts: measured_system, lint_errors, design_md, and host_design: whether a feature keeps its host's own design."""
    c, n = F.col, "design"
    host = F.coalesce(c("host_design"), F.lit(False)) & F.lit(mode == "feature") if "host_design" in facts.columns else F.lit(False)
    return union([
        check(facts, n, mode, 1, "measured system", c("measured_system"), c("measured_system"), "Summarise the measurements."),
        check(facts, n, mode, 2, "lint", host | (c("lint_errors") == 0), c("lint_errors"), "Fix the design."),
        check(facts, n, mode, 3, "document", c("design_md"), c("design_md"), "Write the design document."),
    ])


def build(facts: DataFrame, mode: str) -> DataFrame:
    """facts: clone_measured, structure, pixels, self_pixels, urls_failing, critic_total, critic_least, hard_rejects, copy_errors, copy_warnings, sweep_errors, parity_verdict, open_severe."""
    c, n = F.col, "build"
    bar = F.coalesce(F.least(F.lit(float(PIXEL_BAR)), c("self_pixels") - 2), F.lit(float(PIXEL_BAR)))
    return union([
        check(facts, n, mode, 1, "measured", c("clone_measured"), c("clone_measured"), "Measure the clone."),
        check(facts, n, mode, 2, "structure", c("structure") >= STRUCTURE_BAR[mode], c("structure"), "Bring the structure closer."),
        check(facts, n, mode, 3, "pixels", c("pixels") >= bar, c("pixels"), "Bring the pixels closer."),
        check(facts, n, mode, 4, "urls", c("urls_failing") == 0, c("urls_failing"), "Fix the URLs that fail."),
        check(facts, n, mode, 5, "critic", (c("hard_rejects") == 0) & (c("critic_total") >= CRITIC_BAR[mode]) & (c("critic_least") >= 3), c("critic_total"), "Fix the weakest screen."),
        check(facts, n, mode, 6, "copy", (c("copy_errors") == 0) & (c("copy_warnings") <= 3), F.concat_ws(" errors, ", "copy_errors", "copy_warnings"), "Fix the copy."),
        check(facts, n, mode, 7, "sweep", c("sweep_errors") == 0, c("sweep_errors"), "Remove what is left of the original."),
        check(facts, n, mode, 8, "parity", c("parity_verdict") != "not shippable", c("parity_verdict"), "Build what is missing."),
        check(facts, n, mode, 9, "bugs", c("open_severe") == 0, c("open_severe"), "Close severe bugs."),
    ])


def launch(facts: DataFrame, mode: str) -> DataFrame:
    """facts: brand_checked, parity_verdict, copy_errors, copy_warnings, listing_errors, sweep_errors."""
    c, n = F.col, "launch"
    return union([
        check(facts, n, mode, 1, "brand", c("brand_checked"), c("brand_checked"), "Check the name and note the date."),
        check(facts, n, mode, 2, "better", c("parity_verdict") == "better than the original", c("parity_verdict"), "Build fixes and measure."),
        check(facts, n, mode, 3, "landing copy", (c("copy_errors") == 0) & (c("copy_warnings") <= 3), c("copy_errors"), "Fix the landing page."),
        check(facts, n, mode, 4, "listing", c("listing_errors") == 0, c("listing_errors"), "Fix the listing."),
        check(facts, n, mode, 5, "sweep", c("sweep_errors") == 0, c("sweep_errors"), "Remove what is left of the original."),
    ])


def passes(checks: DataFrame) -> DataFrame:
    """stage, mode, passed, next_action (the fix of the first failed check)."""
    failed = F.col("status") == "fail"
    return checks.groupBy("stage", "mode").agg((~F.bool_or(failed)).alias("passed"), F.min_by("fix", F.when(failed, F.col("ord"))).alias("next_action"))


STATE = "stage string, mode string, gates map<string,struct<passed:boolean,at:string>>"


def new_state(spark: SparkSession, mode: str) -> DataFrame:
    """The state of a project that starts."""
    return spark.createDataFrame([(STAGES[0], mode, {})], STATE)


def save_state(state: DataFrame, path: str) -> None:
    """A one-row state as a JSON file."""
    state.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def load_state(spark: SparkSession, path: str) -> DataFrame:
    """A saved state; a stage that does not exist reads as the first one."""
    s = spark.read.schema(STATE).json(path)
    known = F.coalesce(F.col("stage").isin(*STAGES), F.lit(False))
    return s.select(F.when(known, F.col("stage")).otherwise(STAGES[0]).alias("stage"), "mode", F.coalesce("gates", F.create_map().cast("map<string,struct<passed:boolean,at:string>>")).alias("gates"))


def advance(state: DataFrame, result: DataFrame, now: Column) -> DataFrame:
    """A state row (stage, gates map) after a gate: the result is recorded, a passed stage moves on."""
    order = F.array(*[F.lit(s) for s in STAGES])
    j = state.join(result.select("stage", "passed"), "stage", "left")
    gate = F.map_from_arrays(F.array("stage"), F.array(F.struct(F.coalesce("passed", F.lit(False)).alias("passed"), now.alias("at"))))
    nxt = F.coalesce(F.try_element_at(order, F.array_position(order, F.col("stage")).cast("int") + 1), F.col("stage"))
    # the gates first: beside a new column stage, Spark would take that one for the stage inside the lambda
    j = j.withColumn("gates", F.map_concat(F.map_filter("gates", lambda k, _: k != F.col("stage")), gate))
    return j.select(F.when(F.col("passed"), nxt).otherwise(F.col("stage")).alias("stage"), "gates")


def open_severe(bugs: DataFrame) -> DataFrame:
    return bugs.where(F.lower("severity").rlike("^s[12]$") & ~F.lower("status").rlike("^(fixed|closed|done|wontfix)$"))


def filled(text: Column) -> Column:
    return ~F.contains(text, F.lit("{{"))


def decision(text: Column) -> Column:
    """Whether a line gives the decision."""
    return text.rlike(r"(?im)^Decision:\s*(?:no-go|go, rescoped|go)(?:[^a-z]|$)")


def critic(screens: DataFrame, bar: int) -> DataFrame:
    """screens with passes: no hard reject, total at the bar, every score three or more."""
    ok = (F.size("hardRejects") == 0) & (F.col("total") >= bar) & F.forall(F.map_values("scores"), lambda v: v >= 3)
    return screens.withColumn("passes", ok)


def copy_reduce(totals: DataFrame) -> DataFrame:
    """Errors summed, warnings at their worst, over pages."""
    return totals.agg(F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"), F.coalesce(F.max("warnings"), F.lit(0)).alias("warnings"))


def facts_row(spark: SparkSession, **facts) -> DataFrame:
    return spark.createDataFrame([tuple(facts.values())], list(facts))
