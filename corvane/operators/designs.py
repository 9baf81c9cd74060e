"""Lint of design documents: required roles, contrast, distance from another brand's colours, scales, references.

A design document is one row: design_id, name, maps colors, dark, rounded, spacing (string to string), typography
(string to struct fontFamily, fontSize, ...) and components (string to map). Findings are design_id, level, rule, detail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import color as C
from corvane.session import small

# Role pairs with their contrast, and typefaces free to use.
PAIRS = [
    ("ink", "canvas", "text"), ("ink-soft", "canvas", "text"), ("ink", "surface", "text"), ("ink-soft", "surface", "text"),
    ("on-accent", "accent", "text"), ("accent", "canvas", "ui"), ("border-input", "canvas", "ui"),
]
MIN_CONTRAST = {"text": 4.5, "large": 3.0, "ui": 3.0}
OPEN_FONTS = (
    "inter", "roboto", "open sans", "lato", "montserrat", "poppins", "source sans 3", "ibm plex sans", "geist", "manrope", "dm sans",
    "work sans", "nunito", "raleway", "system-ui", "sans-serif", "serif", "monospace",
)
NEEDED, WANTED = ("canvas", "ink", "accent"), ("surface", "ink-soft", "on-accent", "border")


def overlay(a: Column, b: Column) -> Column:
    """Right-biased union of two maps, without relying on a session setting."""
    b = F.coalesce(b, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def roles(designs: DataFrame) -> DataFrame:
    """design_id, mode (light, dark), role, raw, c (colour, null if unreadable), lab. Dark roles lie over light ones."""
    light = designs.select("design_id", F.lit("light").alias("mode"), F.explode("colors").alias("role", "raw"))
    dark = designs.where("dark is not null").select("design_id", F.lit("dark").alias("mode"), F.explode(overlay(F.col("colors"), F.col("dark"))).alias("role", "raw"))
    out = light.unionByName(dark).withColumn("p", C.parse_color(F.col("raw")))
    out = out.withColumn("c", F.when(F.col("p.r").isNotNull(), F.col("p"))).drop("p")
    return out.withColumn("lab", F.when(F.col("c").isNotNull(), C.oklab(F.col("c"))))


def finding(rows: DataFrame, level: Column | str, rule: str, detail: Column) -> DataFrame:
    level = F.lit(level) if isinstance(level, str) else level
    return rows.select("design_id", level.alias("level"), F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))


def missing_roles(designs: DataFrame) -> DataFrame:
    want = F.array(*[F.struct(F.lit("error").alias("level"), F.lit(r).alias("role")) for r in NEEDED], *[F.struct(F.lit("warning").alias("level"), F.lit(r).alias("role")) for r in WANTED])
    lost = F.filter(want, lambda w: F.coalesce(F.try_element_at("colors", w["role"]), F.lit("")) == "")
    return finding(designs.withColumn("w", F.explode(lost)), F.col("w.level"), "roles", F.col("w.role"))


def unreadable(r: DataFrame) -> DataFrame:
    return finding(r.where("c is null"), "error", "invalid-color", F.concat_ws(" ", "role", "raw")).distinct()


def contrast_pairs(designs: DataFrame) -> DataFrame:
    """Pairs of the design, or the default ones, as design_id, fg, bg, level."""
    default = F.array(*[F.array(*[F.lit(x) for x in p]) for p in PAIRS])
    own = F.when(F.size(F.coalesce("pairs", F.array().cast("array<array<string>>"))) > 0, F.col("pairs")).otherwise(default) if "pairs" in designs.columns else default
    p = designs.select("design_id", F.explode(own).alias("p"))
    return p.select("design_id", F.col("p")[0].alias("fg"), F.col("p")[1].alias("bg"), F.coalesce(F.try_element_at("p", F.lit(3)), F.lit("text")).alias("kind"))


def low_contrast(designs: DataFrame, r: DataFrame) -> DataFrame:
    """Pairs below their contrast, in light and dark; pairs with a missing or unreadable role are left out."""
    side = lambda n: r.where("c is not null").select("design_id", "mode", F.col("role").alias(n), F.col("c").alias(f"{n}_c"))
    j = contrast_pairs(designs).join(side("fg"), ["design_id", "fg"]).join(side("bg"), ["design_id", "mode", "bg"])
    least = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in MIN_CONTRAST.items() for x in kv]), F.col("kind")), F.lit(4.5))
    j = j.withColumn("k", C.contrast(F.col("fg_c"), F.col("bg_c"))).withColumn("least", least)
    return finding(j.where("k < least"), "error", "contrast", F.format_string("%s: %s on %s: %.2f:1, needs %s:1", "mode", "fg", "bg", "k", F.col("least").cast("string")))


def too_close(r: DataFrame, theirs: DataFrame) -> DataFrame:
    """Colours near another brand's (theirs: color, lab): the accent by distance or family, others by distance alone."""
    mine = r.where("mode = 'light' and lab is not null").withColumn("chroma", C.chroma(F.col("lab"))).withColumn("hue", C.hue(F.col("lab")))
    t = theirs.select(F.col("color").alias("their"), F.col("lab").alias("t_lab")).withColumn("t_chroma", C.chroma(F.col("t_lab"))).withColumn("t_hue", C.hue(F.col("t_lab")))
    j = mine.join(small(t), F.lit(True))  # a brand has a handful of colours
    j = j.withColumn("d", C.distance(F.col("lab"), F.col("t_lab")))
    family = (F.col("chroma") >= 0.06) & (F.col("t_chroma") >= 0.06) & (C.hue_gap(F.col("hue"), F.col("t_hue")) < 25)
    accent = (F.col("role") == "accent") & ((F.col("d") < 10) | ((F.col("d") < 20) & family))
    other = (F.col("role") != "accent") & (F.col("chroma") >= 0.06) & (F.col("d") < 8)
    level = F.when(F.col("role") == "accent", "error").otherwise("warning")
    return finding(j.where(accent | other), level, "too-close", F.format_string("%s %s is %.1f from %s", "role", "raw", "d", "their"))


def color_traps(r: DataFrame) -> DataFrame:
    light = r.where("mode = 'light' and lab is not null")
    h = C.hue(F.col("lab"))
    violet = light.where((F.col("role") == "accent") & (C.chroma(F.col("lab")) >= 0.1) & (h >= 270) & (h <= 310))
    black = light.where(F.col("role").isin("ink", "canvas") & (C.to_hex(F.col("c")) == "#000000"))
    return finding(violet, "warning", "ai-violet", F.col("raw")).unionByName(finding(black, "warning", "pure-black", F.col("role")))


def number(c: Column) -> Column:
    return F.regexp_extract(c, r"^\s*([0-9.]+)", 1).try_cast("double")


def scales(designs: DataFrame) -> DataFrame:
    """Findings on cardinalities: text sizes, typefaces, body size, corners, spacing."""
    empty = F.array().cast("array<string>")
    values = lambda c: F.coalesce(F.map_values(c), empty) if c in designs.columns else empty
    sizes = F.filter(F.transform(F.map_values("typography"), lambda t: number(t["fontSize"])), lambda n: n > 0)
    family = F.array_distinct(F.filter(F.transform(F.map_values("typography"), lambda t: F.trim(F.regexp_replace(F.element_at(F.split(t["fontFamily"], ","), 1), "[\"']", ""))), lambda f: f != ""))
    body = F.filter(F.map_entries("typography"), lambda e: e["key"].rlike("(?i)body|text|base|p$"))
    radii = F.array_distinct(F.filter(values("rounded"), lambda x: ~x.rlike("9999|50%|full")))
    space = F.filter(F.transform(values("spacing"), number), lambda n: n > 0)
    multiples = lambda b: F.size(F.filter(space, lambda s: s % b == 0)) >= F.size(space) * 0.8
    d = designs.select("design_id", F.coalesce("name", F.lit("")).alias("name"), sizes.alias("sizes"), family.alias("families"), number(F.get(body, F.lit(0))["value"]["fontSize"]).alias("body"), radii.alias("radii"), space.alias("space"), F.coalesce(multiples(8) | multiples(4) | multiples(2), F.lit(False)).alias("rhythm"))
    say = lambda when, rule, detail: F.when(when, F.struct(F.lit(rule).alias("rule"), detail.cast("string").alias("detail")))
    found = F.array(
        say(F.col("name") == "", "name", F.lit("no name")),
        say(F.size("sizes") < 4, "type-scale", F.size("sizes")),
        say((F.size("sizes") >= 2) & (F.array_max("sizes") / F.array_min("sizes") < 2), "type-scale", F.array_max("sizes") / F.array_min("sizes")),
        say(F.size("families") > 3, "fonts", F.size("families")),
        say((F.size("families") == 1) & F.get("families", F.lit(0)).rlike("(?i)^inter(?![A-Za-z0-9_])"), "fonts", F.get("families", F.lit(0))),
        say((F.col("body") < 14) | (F.col("body") > 20), "body-size", F.col("body")),
        say(F.size("radii") > 4, "corners", F.size("radii")),
        say(F.size("space") == 0, "spacing", F.lit("none")),
        say((F.size("space") > 0) & ~F.col("rhythm"), "spacing", F.lit("no base")),
    )
    rows = d.withColumn("f", F.explode(F.filter(found, lambda x: x.isNotNull())))
    return rows.select("design_id", F.lit("warning").alias("level"), "f.rule", "f.detail")


def families(designs: DataFrame) -> DataFrame:
    f = F.trim(F.regexp_replace(F.element_at(F.split("t.fontFamily", ","), 1), "[\"']", ""))
    return designs.select("design_id", F.explode(F.map_values("typography")).alias("t")).select("design_id", f.alias("family")).where("family <> ''").distinct()


def their_fonts(designs: DataFrame, fonts: DataFrame, top: int = 2) -> DataFrame:
    """Typefaces of the design that are among the measured page's first two (fonts: family, chars) and not free."""
    first = fonts.orderBy(F.desc("chars"), "family").limit(top).select(F.lower("family").alias("low"))
    mine = families(designs).withColumn("low", F.lower("family")).where(~F.col("low").isin(*OPEN_FONTS))
    return finding(mine.join(first, "low", "left_semi"), "error", "their-font", F.col("family"))


def missing_tokens(designs: DataFrame) -> DataFrame:
    """References {group.name} in components that no group defines."""
    keys = lambda g: F.transform(F.coalesce(F.map_keys(g), F.array().cast("array<string>")), lambda k: F.concat(F.lit(f"{g}."), k))
    groups = [g for g in ("colors", "typography", "rounded", "spacing") if g in designs.columns]
    defined = designs.select("design_id", F.explode(F.flatten(F.array(*[keys(g) for g in groups]))).alias("ref"))
    props = designs.select("design_id", F.explode("components").alias("component", "props")).select("design_id", "component", F.explode(F.map_values("props")).alias("v"))
    refs = props.select("design_id", "component", F.explode(F.regexp_extract_all("v", F.lit(r"\{([^}]+)\}"), F.lit(1))).alias("ref"))
    return finding(refs.join(defined, ["design_id", "ref"], "left_anti"), "error", "missing-token", F.concat_ws(" ", "component", "ref"))


def lint(designs: DataFrame, theirs: DataFrame | None = None, fonts: DataFrame | None = None) -> DataFrame:
    """All findings."""
    r = roles(designs)
    parts = [missing_roles(designs), unreadable(r), low_contrast(designs, r), color_traps(r), scales(designs), missing_tokens(designs)]
    if theirs is not None:
        parts.append(too_close(r, theirs))
    if fonts is not None:
        parts.append(their_fonts(designs, fonts))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def nearest_brand(colors: DataFrame, brand: DataFrame, key: str = "color_id") -> DataFrame:
    """Each colour (key, lab) with the nearest of a small table of brand colours (color, lab) and the distance.

    The brand's colours are one array beside each row, so no rows are made for the pairs; repeated keys meet after they are dealt
    out, where each task sorts its share only.
    """
    theirs = brand.agg(F.collect_list(F.struct("color", F.col("lab").alias("t_lab"))).alias("_theirs")).where(F.size("_theirs") > 0)
    of = lambda t: C.let(C.distance(F.col("lab"), t["t_lab"]), lambda d: F.struct(d.isNull().alias("none"), d.alias("d"), t["color"].alias("their")))
    near = colors.crossJoin(F.broadcast(theirs)).select(key, F.array_min(F.transform("_theirs", of)).alias("_near"))
    best = near.repartition(key).groupBy(key).agg(F.min("_near").alias("_near"))
    return best.select(key, F.col("_near.their").alias("nearest"), F.col("_near.d").alias("distance"))


def ranked(findings: DataFrame) -> DataFrame:
    w = Window.partitionBy("design_id").orderBy(F.col("level") != "error", "rule", "detail")
    return findings.withColumn("rank", F.row_number().over(w))
