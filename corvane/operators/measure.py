"""Reductions of page measurements: elements, interactions, accessibility, links, breakpoints.

Elements are rows page, pos, tag, and what a browser computed for them; acquisition is not part of the engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import round_half_up, squash
from corvane.functions.urls import longest_ms

FOCUS = ("boxShadow", "borderColor", "backgroundColor", "color", "textDecoration")


def visible(w: Column, h: Column, x: Column, page_w: Column, display: Column, visibility: Column, opacity: Column) -> Column:
    """At least 1 px, shown, and inside the page horizontally."""
    return (w >= 1) & (h >= 1) & (display != "none") & (visibility != "hidden") & (opacity != 0) & (x + w >= 0) & (x <= page_w + 1)


def role(tag: Column, aria: Column, type_: Column, looks_like_button: Column) -> Column:
    """A node's role from its tag, its aria role and its look."""
    a = F.lower(F.coalesce(aria, F.lit("")))
    roles = {"banner": "header", "navigation": "nav", "main": "main", "contentinfo": "footer", "complementary": "aside", "dialog": "dialog", "form": "form", "button": "button", "tab": "tab", "table": "table", "grid": "table", "list": "list", "img": "image", "link": "link", "textbox": "input", "searchbox": "input", "combobox": "input", "checkbox": "input", "radio": "input", "switch": "input"}
    tags = {"header": "header", "nav": "nav", "main": "main", "footer": "footer", "aside": "aside", "dialog": "dialog", "form": "form", "h1": "h1", "h2": "h2", "h3": "h3", "h4": "h4", "button": "button", "select": "input", "textarea": "input", "table": "table", "ul": "list", "ol": "list", "img": "image", "picture": "image", "svg": "image", "video": "video", "canvas": "canvas", "iframe": "embed", "embed": "embed", "object": "embed"}
    pick = lambda d, c: F.try_element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), c)
    own = F.when(tag == "input", F.when(F.lower(F.coalesce(type_, F.lit("text"))).isin("submit", "button", "reset", "image"), "button").otherwise("input")).when(tag == "a", F.when(looks_like_button, "button").otherwise("link")).otherwise(pick(tags, tag))
    return F.coalesce(pick(roles, a), own)


def text_kind(role_: Column, in_nav: Column, in_footer: Column) -> Column:
    return F.when(role_.isin("h1", "h2", "h3", "h4"), "heading").when(role_ == "button", "button").when(in_nav, "nav").when(in_footer, "footer").otherwise("text")


def accessible_name(e: DataFrame) -> Column:
    """First of label, labelled-by text, alt, title, placeholder, own text; squashed, 80 characters."""
    return F.substring(squash(F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("aria_label", "labelled_by", "alt", "title", "placeholder", "text")])), 1, 80)


def fill_color(background: Column, image: Column) -> Column:
    """Background colour, else the first stop of a gradient."""
    stop = F.regexp_extract(F.coalesce(image, F.lit("")), r"(?i)(rgba?\([^)]*\)|#[0-9a-f]{3,8}(?![A-Za-z0-9_])|oklch\([^)]*\)|oklab\([^)]*\)|hsla?\([^)]*\))", 1)
    clear = background.isNull() | background.isin("", "transparent", "none", "rgba(0, 0, 0, 0)")
    return F.when(~clear, background).when(F.contains(F.coalesce(image, F.lit("")), F.lit("gradient")), F.nullif(stop, F.lit("")))


def page_colors(e: DataFrame) -> DataFrame:
    """Six usage counters of each colour of a page: characters, area, borders, icons, actions, labels."""
    parts = [
        ("color", F.col("chars"), "text"), ("fill", F.greatest(F.lit(1), round_half_up(F.col("w") * F.col("h") / 1000)).cast("long"), "bg"),
        ("border_color", F.lit(1), "border"), ("icon_color", F.lit(1), "icon"), ("action_color", F.lit(1), "action"), ("label_color", F.lit(1), "label"),
    ]
    long = F.filter(F.array(*[F.struct(F.col(c).alias("hex"), F.lit(n).alias("kind"), v.cast("long").alias("n")) for c, v, n in parts]), lambda x: x["hex"].isNotNull())
    rows = e.select("page", F.explode(long).alias("u")).select("page", "u.*")
    return rows.groupBy("page", "hex").agg(*[F.sum(F.when(F.col("kind") == n, F.col("n")).otherwise(0)).alias(n) for _, _, n in parts])


def page_type(e: DataFrame) -> DataFrame:
    """count and chars of each combination of size, line height, weight, family and letter spacing."""
    return e.where("chars > 0").groupBy("page", "size", "line_height", "weight", "family", "letter_spacing").agg(F.count("*").alias("count"), F.sum("chars").alias("chars"))


def page_histogram(e: DataFrame, columns: dict[str, int]) -> DataFrame:
    """property, value, count of rounded pixel values above 0 and up to each property's bound."""
    pairs = F.array(*[F.struct(F.lit(c).alias("property"), round_half_up(F.col(c)).cast("int").alias("value"), F.lit(most).alias("most")) for c, most in columns.items()])
    rows = e.select("page", F.explode(pairs).alias("v")).select("page", "v.*").where("value > 0 and value <= most")
    return rows.groupBy("page", "property", "value").agg(F.count("*").alias("count"))


def block_text(nodes: DataFrame, most: int = 400) -> DataFrame:
    """Text nodes (page, block, pos, text) joined under their block in document order, repeats of a page left out."""
    joined = nodes.groupBy("page", "block").agg(F.min("pos").alias("pos"), squash(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ")).alias("t"))
    joined = joined.where("t <> ''").withColumn("t", F.substring("t", 1, most))
    first = F.row_number().over(Window.partitionBy("page", "t").orderBy("pos"))
    return joined.withColumn("_n", first).where("_n = 1").drop("_n")


def heading_skips(e: DataFrame) -> DataFrame:
    """Headings more than one level below the one before."""
    h = e.where(F.col("tag").rlike("^h[1-6]$")).withColumn("level", F.substring("tag", 2, 1).cast("int"))
    before = F.lag("level").over(Window.partitionBy("page").orderBy("pos"))
    return h.withColumn("before", before).where("level - before > 1")


def accessibility(e: DataFrame) -> DataFrame:
    """h1, heading skips, images without alt, buttons without name, inputs without label of each page."""
    skips = heading_skips(e).groupBy("page").agg(F.count("*").alias("heading_skips"))
    n = e.groupBy("page").agg(
        F.count_if(F.col("tag") == "h1").alias("h1"),
        F.count_if((F.col("tag") == "img") & F.col("alt").isNull()).alias("images_without_alt"),
        F.count_if((F.col("role") == "button") & (F.coalesce("name", F.lit("")) == "")).alias("buttons_without_name"),
        F.count_if((F.col("role") == "input") & (F.coalesce("name", F.lit("")) == "")).alias("inputs_without_label"),
    )
    return n.join(skips, "page", "left").na.fill({"heading_skips": 0})


def link_sets(links: DataFrame, most_internal: int = 400, most_hosts: int = 100) -> DataFrame:
    """Distinct internal paths and external hosts of each page (page, host, link_host, path), sorted and capped."""
    own = F.col("link_host") == F.col("host")
    return links.groupBy("page").agg(
        F.slice(F.array_sort(F.collect_set(F.when(own, F.col("path")))), 1, most_internal).alias("internal"),
        F.slice(F.array_sort(F.collect_set(F.when(~own, F.col("link_host")))), 1, most_hosts).alias("external"),
    )


def breakpoints(css: DataFrame) -> DataFrame:
    """Widths in media queries (page, css), in px, em and rem at 16 px, 240 to 3000."""
    q = F.regexp_extract_all("css", F.lit(r"(?i)(?:min|max)-width\s*:\s*([0-9.]+(?:px|em|rem))"), F.lit(1))
    v = F.regexp_extract("q", r"([0-9.]+)", 1).try_cast("double") * F.when(F.col("q").rlike("(?i)px$"), 1).otherwise(16)
    rows = css.select("page", F.explode(q).alias("q")).withColumn("value", round_half_up(v).cast("int")).where("value between 240 and 3000")
    return rows.groupBy("page", "value").agg(F.count("*").alias("count"))


def style_change(before: Column, after: Column) -> Column:
    """Map of the properties whose values differ to [before, after]."""
    both = F.map_zip_with(before, after, lambda _, a, b: F.array(a, b))
    return F.map_filter(both, lambda _, v: ~v[0].eqNullSafe(v[1]))


def focus_visible(base: Column, focused: Column) -> Column:
    """An outline is drawn, or one of five properties changed."""
    outline = (F.coalesce(F.try_element_at(focused, F.lit("outlineStyle")), F.lit("none")) != "none") & (F.coalesce(F.regexp_extract(F.try_element_at(focused, F.lit("outlineWidth")), r"([0-9.]+)", 1).try_cast("double"), F.lit(0.0)) > 0)
    changed = [~F.try_element_at(base, F.lit(p)).eqNullSafe(F.try_element_at(focused, F.lit(p))) for p in FOCUS]
    out = outline
    for c in changed:
        out = out | c
    return out


def reveals(e: DataFrame) -> DataFrame:
    """Elements that a scroll revealed: from under 0.5 to at least 0.9 opacity, or no longer shifted."""
    return e.where(((F.col("opacity_before") < 0.5) & (F.col("opacity_after") >= 0.9)) | (F.col("shifted_before") & ~F.col("shifted_after")))


def hover_summary(targets: DataFrame) -> DataFrame:
    """page, checked, changed of hovered targets (page, changes map)."""
    return targets.groupBy("page").agg(F.count("*").alias("checked"), F.count_if(F.size("changes") > 0).alias("changed"))


def hover_properties(targets: DataFrame) -> DataFrame:
    rows = targets.select("page", F.explode(F.map_keys("changes")).alias("p")).withColumn("property", F.regexp_replace("p", "^inner ", ""))
    return rows.groupBy("page", "property").agg(F.count("*").alias("n"))


def hover_durations(targets: DataFrame) -> DataFrame:
    return targets.withColumn("ms", longest_ms(F.col("duration"))).where("ms > 0 and size(changes) > 0").groupBy("page", F.col("ms").cast("int").alias("ms")).agg(F.count("*").alias("n"))


def focus_summary(stops: DataFrame, most: int = 15) -> DataFrame:
    """visited, visible, labels of stops without a visible focus, and whether the first stop skips to content."""
    lost = F.slice(F.transform(F.array_sort(F.collect_list(F.when(~F.col("visible"), F.struct("pos", "label")))), lambda x: x["label"]), 1, most)
    skip = F.min_by(F.col("label").rlike("(?i)skip"), "pos")
    return stops.groupBy("page").agg(F.count("*").alias("visited"), F.count_if("visible").alias("visible"), lost.alias("without"), F.coalesce(skip, F.lit(False)).alias("skip_link"))


def focus_ratio(original: DataFrame, clone: DataFrame) -> DataFrame:
    """Whether the clone shows focus on a smaller share of stops than the original."""
    share = lambda d, n: d.select("page", (F.col("visible") / F.greatest(F.lit(1), F.col("visited"))).alias(n))
    return share(original, "original").join(share(clone, "clone"), "page").withColumn("loss", F.col("clone") < F.col("original"))


def hover_targets(nodes: DataFrame, most: int) -> DataFrame:
    """Buttons, then tall links, then the rest; the first of each page."""
    rank = F.when(F.col("role") == "button", 0).when((F.col("role") == "link") & (F.col("h") >= 40), 1).otherwise(2)
    return nodes.withColumn("_n", F.row_number().over(Window.partitionBy("page").orderBy(rank, "pos"))).where(F.col("_n") <= most).drop("_n")


def first_changes(children: DataFrame) -> DataFrame:
    """For each target and property the first of itself and its children whose style differs (target, child, changes)."""
    rows = children.select("target", "child", F.explode("changes").alias("property", "change"))
    return rows.groupBy("target", "property").agg(F.min_by("change", "child").alias("change"), F.min("child").alias("child"))


def frame_times(frames: DataFrame, times: DataFrame) -> DataFrame:
    """Frame files (pos, file) with their timestamps (pos, seconds) by place, null where there is none."""
    s = F.col("seconds")
    clock = F.format_string("%d:%02d", F.floor(s / 60).cast("int"), F.floor(s % 60).cast("int"))
    return frames.join(times, "pos", "left").select("pos", "file", "seconds", F.when(s.isNotNull(), clock).alias("clock")).orderBy("pos")
