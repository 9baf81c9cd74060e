"""Design system summaries over page measurements: colours, type, fonts, spacing, motion.

Inputs are tables exploded from measurements (one row a page and value); outputs are small tables. Weighted counts
are plain grouped sums; greedy colour clustering depends on order and runs on one group's few dozen colours.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import color as C
from corvane.functions.text import round_half_up

COUNTERS = ("text", "bg", "border", "icon", "action", "label")
COLOR_WEIGHT = {"text": 1, "bg": 1, "border": 10, "icon": 5, "action": 40, "label": 10}
CLUSTER_DISTANCE, CLUSTER_ALPHA, MOST_COLORS = 2.5, 0.15, 2000


def value_counts(values: DataFrame, key: list[str], value: str = "value", count: str = "count", top: int | None = None) -> DataFrame:
    """Summed counts of each value within key, largest first; ties by value. top keeps so many of each key.

    Without a key the rank is over all values: with top it is taken of the first ones alone, which are sorted apart.
    """
    out = values.groupBy(*key, value).agg(F.sum(count).alias(count))
    if not key and top:
        out = out.orderBy(F.desc(count), value).limit(top)
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(count), value)) if key else F.row_number().over(Window.orderBy(F.desc(count), value))
    out = out.withColumn("rank", rank)
    return out.where(F.col("rank") <= top) if top else out


def share(x: Column, key: list[str], places: int = 1) -> Column:
    """Percentage of the key's total."""
    return round_half_up(x / F.sum(x).over(Window.partitionBy(*key)) * 100, places)


def canvas_vote(pages: DataFrame, key: list[str]) -> DataFrame:
    """The most frequent canvas of each key, white if there is none."""
    g = pages.where("canvas is not null").groupBy(*key, "canvas").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    best = g.groupBy(*key).agg(F.max_by("canvas", F.struct("n", -F.col("first"))).alias("canvas"))
    return pages.select(*key).distinct().join(best, key, "left").withColumn("canvas", F.coalesce("canvas", F.lit("#ffffff")))


def color_usage(colors: DataFrame, key: list[str], canvas: str = "canvas") -> DataFrame:
    """Counters of each colour; translucent colours are laid over the canvas first."""
    summed = colors.groupBy(*key, canvas, "hex").agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in COUNTERS])
    own, ground = C.parse_hex(F.col("hex")), F.coalesce(C.parse_hex(F.col(canvas)), C.parse_hex(F.lit("#ffffff")))
    solid = F.when(own["a"] < 1, C.to_hex(C.over(own, ground))).otherwise(F.col("hex"))
    return summed.withColumn("hex", solid)


def color_weight() -> Column:
    return sum((F.col(c) * w for c, w in list(COLOR_WEIGHT.items())[1:]), F.col("text") * 1)


def cluster_colors(usage: DataFrame, key: list[str]) -> DataFrame:
    """Greedy clusters in order of weight: a colour joins the first cluster that is near and as opaque.

    One key's clusters are found in one task; only the MOST_COLORS heaviest colours of a key take part, far more than
    a page's measurement holds, so that a task's work is bounded.
    """
    heavy = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(color_weight()), "hex"))
    usage = usage.withColumn("_heavy", heavy).where(F.col("_heavy") <= MOST_COLORS).drop("_heavy")
    with_lab = usage.withColumn("c", C.parse_hex(F.col("hex"))).where("c is not null").withColumn("lab", C.oklab(F.col("c")))
    flat = with_lab.select(*key, "hex", *COUNTERS, color_weight().cast("double").alias("w"), F.col("c.a").alias("alpha"), F.col("lab.l").alias("l_"), F.col("lab.a").alias("a_"), F.col("lab.b").alias("b_"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in flat.schema if f.name in (*key, "hex", *COUNTERS)) + ", rank int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[dict] = []
        for r in pdf.sort_values(["w", "hex"], ascending=[False, True], kind="stable").to_dict("records"):
            for o in out:
                gap = ((o["l_"] - r["l_"]) ** 2 + (o["a_"] - r["a_"]) ** 2 + (o["b_"] - r["b_"]) ** 2) ** 0.5 * 100
                if abs(o["alpha"] - r["alpha"]) < CLUSTER_ALPHA and gap < CLUSTER_DISTANCE:
                    for c in COUNTERS:
                        o[c] += r[c]
                    break
            else:
                out.append(dict(r))
        return pd.DataFrame([{k: o[k] for k in (*key, "hex", *COUNTERS)} | {"rank": i + 1} for i, o in enumerate(out)])

    return flat.groupBy(*key).applyInPandas(run, schema)


def color_roles(colors: DataFrame, key: list[str], canvas: str = "canvas") -> DataFrame:
    """ink, ink_soft, surface, accent, on_accent, border, brand (six at most) of each key, by ordered rules."""
    white_ground = lambda x: F.coalesce(C.parse_hex(x), C.parse_hex(F.lit("#ffffff")))

    def derived(v: Column) -> Column:
        lab = C.oklab(v["c"])
        off = C.distance(lab, C.oklab(v["ground"]))
        return F.struct(v["c"].alias("c"), lab.alias("lab"), C.contrast(v["c"], v["ground"]).alias("k"), C.chroma(lab).alias("chroma"), off.alias("off"), (v["c"]["a"] >= 0.95).alias("solid"))

    both = F.struct(C.parse_hex(F.col("hex")).alias("c"), white_ground(F.col(canvas)).alias("ground"))
    # exploding an array of one makes the derived values columns, so that what follows does not compute them again
    c = colors.withColumn("_d", F.explode(F.array(C.let(both, derived)))).select(*colors.columns, "_d.*")
    w = Window.partitionBy(*key)
    c = c.withColumn("all_text", F.greatest(F.lit(1), F.sum(F.when(F.col("solid"), F.col("text")).otherwise(0)).over(w)))
    c = c.withColumn("textual", F.col("solid") & (F.col("text") >= F.col("all_text") * 0.08))
    pos = -F.col("rank")
    arg = lambda when, *order: F.max_by(F.struct("hex", "lab", "k", "c", "chroma"), F.when(when, F.struct(*order, pos)))
    ink = F.coalesce(
        arg(F.col("textual") & (F.col("k") >= 7), F.col("text")).over(w),
        arg(F.col("textual"), F.col("k")).over(w),
        arg(F.col("solid") & (F.col("text") > 0), F.col("text")).over(w),
    )
    c = c.withColumn("ink", ink)
    filled = F.col("solid") & (F.col("action") > 0) & (F.col("off") >= 10)
    c = c.withColumn("most", F.coalesce(F.max(F.when(filled, F.col("action"))).over(w), F.lit(0)))
    chromatic = F.col("chroma") >= 0.06
    accent = F.coalesce(
        arg(filled & chromatic & (F.col("action") >= F.greatest(F.lit(2.0), F.col("most") * 0.15)), F.col("action")).over(w),
        arg(filled, F.col("action")).over(w),
        arg(F.col("solid") & (F.col("label") > 0) & chromatic, F.col("label")).over(w),
    )
    c = c.withColumn("accent", accent)
    soft = F.col("textual") & (F.col("hex") != F.col("ink.hex")) & (C.distance(F.col("lab"), F.col("ink.lab")) >= 5) & (F.col("k") >= 3) & (F.col("k") < F.col("ink.k"))
    other = F.col("solid") & chromatic & (F.coalesce(F.col("hex") != F.col("accent.hex"), F.lit(True))) & (F.col("action") + F.col("label") + F.col("text") + F.col("bg") > 0)
    weight = F.col("action") * 40 + F.col("label") * 10 + F.col("bg") + F.col("text")
    white, black = C.parse_hex(F.lit("#ffffff")), C.parse_hex(F.lit("#111111"))
    one = c.groupBy(*key, canvas).agg(
        F.first("ink").alias("ink_"), F.first("accent").alias("accent_"),
        F.max_by("hex", F.when(soft, F.struct("text", pos))).alias("ink_soft"),
        F.max_by("hex", F.when(F.col("solid") & (F.col("bg") > 0) & (F.col("off") >= 2), F.struct("bg", pos))).alias("surface"),
        F.max_by("hex", F.when(F.col("border") > 0, F.struct("border", pos))).alias("border"),
        F.array_sort(F.collect_list(F.when(other, F.struct((-weight).alias("w"), "rank", "hex")))).alias("others"),
    )
    dark = F.when(C.contrast(F.col("ink_.c"), white) > 1.5, F.col("ink_.c")).otherwise(black)
    on = F.when(C.contrast(white, F.col("accent_.c")) >= C.contrast(F.coalesce(dark, black), F.col("accent_.c")), F.lit("#ffffff")).otherwise(F.coalesce(F.col("ink_.hex"), F.lit("#111111")))
    lead = F.when(F.col("accent_.chroma") >= 0.03, F.array("accent_.hex")).otherwise(F.array().cast("array<string>"))
    brand = F.slice(F.concat(lead, F.transform("others", lambda x: x["hex"])), 1, 6)
    return one.select(*key, canvas, F.col("ink_.hex").alias("ink"), "ink_soft", "surface", F.col("accent_.hex").alias("accent"), F.when(F.col("accent_").isNotNull(), on).alias("on_accent"), "border", brand.alias("brand"))


def type_scale(types: DataFrame, key: list[str], least: float = 0.004) -> DataFrame:
    """For each rounded size: chars, share, and the line height, weight and family with most chars."""
    t = types.withColumn("px", round_half_up(F.regexp_extract("size", r"([0-9.]+)", 1).try_cast("double")).cast("int"))
    g = [*key, "px"]
    out = t.groupBy(*g).agg(F.sum("chars").alias("chars"))
    for c in ("lineHeight", "weight", "family"):
        per = t.groupBy(*g, c).agg(F.sum("chars").alias("n"))
        out = out.join(per.groupBy(*g).agg(F.max_by(c, F.struct("n", c)).alias(c)), g)
    w = Window.partitionBy(*key)
    out = out.withColumn("part", F.col("chars") / F.sum("chars").over(w)).withColumn("body", F.max_by("px", F.struct("chars", -F.col("px"))).over(w))
    return out.where(F.col("part") >= least).withColumn("share", round_half_up(F.col("part") * 100, 1)).drop("part")


def used_for(types: DataFrame, key: list[str], top: int = 3) -> DataFrame:
    """The tags most used at each size, from a map of tag to count."""
    t = types.withColumn("px", round_half_up(F.regexp_extract("size", r"([0-9.]+)", 1).try_cast("double")).cast("int"))
    per = t.select(*key, "px", F.explode("tags").alias("tag", "n")).groupBy(*key, "px", "tag").agg(F.sum("n").alias("n"))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "tag"))), 1, top)
    return per.groupBy(*key, "px").agg(F.transform(best, lambda x: x["tag"]).alias("used_for"))


def mean_ratio(scale: DataFrame, key: list[str]) -> DataFrame:
    """Mean ratio of consecutive sizes from the body size up."""
    steps = scale.where("px >= body").withColumn("ratio", F.col("px") / F.lag("px").over(Window.partitionBy(*key).orderBy("px")))
    return steps.groupBy(*key).agg(round_half_up(F.avg("ratio"), 2).alias("ratio"))


def font_shares(fonts: DataFrame, key: list[str]) -> DataFrame:
    """Share of characters and sorted weights of each family, from a map of weight to count."""
    chars = fonts.groupBy(*key, "family").agg(F.sum("chars").alias("chars"))
    weights = fonts.select(*key, "family", F.explode_outer("weights").alias("weight", "n")).groupBy(*key, "family").agg(F.array_sort(F.collect_set("weight")).alias("weights"))
    return chars.withColumn("share", share(F.col("chars"), key)).join(weights, [*key, "family"])


def spacing_base(values: DataFrame, key: list[str]) -> DataFrame:
    """First of 8, 4, 2 of which at least 0.7 of the weighted values from 4 up are multiples, else 1."""
    v = values.where("value >= 4")
    total = F.greatest(F.sum("count"), F.lit(1))
    part = {b: F.sum(F.when(F.col("value") % b == 0, F.col("count")).otherwise(0)) / total for b in (8, 4, 2)}
    base = F.when(part[8] >= 0.7, 8).when(part[4] >= 0.7, 4).when(part[2] >= 0.7, 2).otherwise(1)
    best = F.when(part[8] >= 0.7, part[8]).when(part[4] >= 0.7, part[4]).when(part[2] >= 0.7, part[2]).otherwise(1.0)
    return v.groupBy(*key).agg(base.alias("base"), best.alias("share"))


def spacing_scale(values: DataFrame, key: list[str], least: float = 0.01) -> DataFrame:
    """Values that make up at least a hundredth of the spacing, ascending."""
    g = values.groupBy(*key, "value").agg(F.sum("count").alias("count"))
    g = g.withColumn("part", F.col("count") / F.sum("count").over(Window.partitionBy(*key))).where(F.col("part") >= least)
    return g.groupBy(*key).agg(F.array_sort(F.collect_set("value")).alias("scale"))


def page_totals(pages: DataFrame, key: list[str]) -> DataFrame:
    """Distinct gradients, keyframe animations in all, and the first logo."""
    return pages.groupBy(*key).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("gradients", F.array().cast("array<string>")))))).alias("gradients"),
        F.sum(F.coalesce("animations", F.lit(0))).alias("animations"),
        F.min_by("logo", F.when(F.col("logo").isNotNull(), F.col("pos"))).alias("logo"),
    )


def widest(pages: DataFrame, key: list[str]) -> DataFrame:
    """Only the measurements at the greatest width."""
    return pages.withColumn("_w", F.max("width").over(Window.partitionBy(*key))).where("width = _w").drop("_w")
