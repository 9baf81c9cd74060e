"""Design lint, listings, sweeps, staged checks, colours, structure and screenshots, with values made from table keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import color as C
from corvane.functions import png
from corvane.functions.text import round_half_up
from corvane.operators import designs, gates, lint, structure, sweep, tokens, visual
from corvane.plans.common import table
from corvane.plans.measures import _K, _keys, _pick, _sql_pick, key
from corvane.plans.systems import _BRAND, BRAND, _hex, _sql_lab, _sql_lin, structure_self
from corvane.sources import feeds


def supplier() -> Column:
    return F.col("s_suppkey")



def _strings(**values: Column) -> Column:
    """A map of the entries whose value is not null."""
    return F.map_filter(F.create_map(*[x for k, v in values.items() for x in (F.lit(k.replace("_", "-")), v)]), lambda _, v: v.isNotNull())


def _designs(spark: SparkSession, d: str) -> DataFrame:
    """A design document for each supplier."""
    s = table(spark, d, "supplier")
    font = lambda family, size: F.struct(family.alias("fontFamily"), size.alias("fontSize"))
    typography = F.create_map(
        F.lit("title"), font(F.lit("'Inter', serif"), F.lit("32px")), F.lit("body"), font(_pick(["Inter", '"Grotesk X", arial', "Serif Z"], supplier()), F.concat((supplier() % 30 + 8).cast("string"), F.lit("px"))),
        F.lit("label"), font(F.when(supplier() % 2 == 0, F.lit("Mono Q")).otherwise(F.lit("Inter")), F.when(supplier() % 7 == 0, F.lit("auto")).otherwise(F.lit("12px"))), F.lit("small"), font(F.lit("Other"), F.lit("11px")),
    )
    rounded = _strings(sm=F.lit("2px"), md=F.lit("4px"), lg=F.when(supplier() % 3 == 0, "8px"), xl=F.when(supplier() % 3 == 0, "12px"), xx=F.when(supplier() % 6 == 0, "20px"), pill=F.lit("9999px"))
    spacing = F.when(supplier() % 4 == 0, F.create_map().cast("map<string,string>")).otherwise(_strings(a=F.lit("8px"), b=F.concat((supplier() % 5 * 4 + 1).cast("string"), F.lit("px")), c=F.when(supplier() % 2 == 0, "3px")))
    props = _strings(fill=F.lit("{colors.accent}"), pad=F.lit("{spacing.a} {spacing.zz}"), text=F.lit("plain {typography.body}"), edge=F.lit("{rounded.xl}"))
    pairs = F.when(supplier() % 10 == 0, F.array(F.array(F.lit("ink"), F.lit("accent"), F.lit("large")), F.array(F.lit("ink"), F.lit("bad"))))
    return s.select(
        supplier().cast("string").alias("design_id"), F.when(supplier() % 9 != 0, "Name").alias("name"),
        _strings(canvas=_pick(["#ffffff", "#ffffff", "#000000"], supplier()), ink=_hex(supplier()), accent=F.when(supplier() % 4 != 3, _hex(supplier() + 1)), surface=F.when(supplier() % 5 == 0, "#fafafa"), ink_soft=F.when(supplier() % 2 == 0, "#777777"), bad=F.when(supplier() % 6 == 0, "not a colour")).alias("colors"),
        F.when(supplier() % 2 == 0, F.create_map(F.lit("canvas"), F.lit("#111111"))).alias("dark"), typography.alias("typography"), rounded.alias("rounded"), spacing.alias("spacing"),
        F.create_map(F.lit("button"), props).alias("components"), pairs.alias("pairs"),
    )


def design_roles(spark: SparkSession, d: str) -> DataFrame:
    """Colours by mode; dark ones lie over light ones."""
    return designs.roles(_designs(spark, d)).select("design_id", "mode", "role", "raw", F.col("c").isNotNull().alias("readable"))


def design_missing_roles(spark: SparkSession, d: str) -> DataFrame:
    return designs.missing_roles(_designs(spark, d))


def design_unreadable(spark: SparkSession, d: str) -> DataFrame:
    return designs.unreadable(designs.roles(_designs(spark, d)))


def design_contrast(spark: SparkSession, d: str) -> DataFrame:
    own = _designs(spark, d)
    return designs.low_contrast(own, designs.roles(own))


def design_too_close(spark: SparkSession, d: str) -> DataFrame:
    brand = spark.createDataFrame([(x,) for x in BRAND], "color string").withColumn("lab", C.oklab(C.parse_hex(F.col("color"))))
    return designs.too_close(designs.roles(_designs(spark, d)), brand)


def design_traps(spark: SparkSession, d: str) -> DataFrame:
    return designs.color_traps(designs.roles(_designs(spark, d)))


def design_scales(spark: SparkSession, d: str) -> DataFrame:
    s = designs.scales(_designs(spark, d))
    return s.select("design_id", "level", "rule", F.when(F.col("rule").isin("type-scale", "body-size"), F.col("detail").try_cast("double").cast("string")).otherwise(F.col("detail")).alias("detail"))


def design_their_fonts(spark: SparkSession, d: str) -> DataFrame:
    fonts = spark.createDataFrame([("Grotesk X", 900), ("inter", 800), ("Serif Z", 700)], "family string, chars long")
    return designs.their_fonts(_designs(spark, d), fonts)


def design_missing_tokens(spark: SparkSession, d: str) -> DataFrame:
    return designs.missing_tokens(_designs(spark, d))


def design_ranked(spark: SparkSession, d: str) -> DataFrame:
    """Findings of roles and tokens, numbered within each design."""
    own = _designs(spark, d)
    r = designs.ranked(designs.missing_roles(own).unionByName(designs.missing_tokens(own)))
    return r.select("design_id", "rule", "detail", F.col("rank").cast("long").alias("rank"))


FIELDS = ["appStore.name", "appStore.subtitle", "googlePlay.shortDescription", "googlePlay.title", "appStore.description", "appStore.unknown"]
VALUES = ["Plain Notes", "The best notes for you", "", "SHOUTING", "Notes by TheOrigin", "A name that is far longer than thirty characters", "Note ⭐"]


def listing_lint(spark: SparkSession, d: str) -> DataFrame:
    where = F.split(_pick(FIELDS, key()), r"\.")
    rows = _keys(spark, d).select(key().cast("string").alias("listing_id"), where[0].alias("store"), where[1].alias("field"), _pick(VALUES, F.floor(key() / 6)).alias("value"))
    return lint.lint_listing(rows, ["TheOrigin"])


WORDS = [("notes, tasks", "Day Notes", "Plan"), ("notes,plan,notes", "Day", "Plan"), ("alpha,beta", "Day", None), ("", "Day", "Plan"), (None, "Day", "Plan")]


def listing_keywords(spark: SparkSession, d: str) -> DataFrame:
    rows = _keys(spark, d).withColumn("f", F.explode(F.array(F.lit("keywords"), F.lit("name"), F.lit("subtitle"))))
    at = lambda i: _pick([w[i] for w in WORDS], key())
    value = F.when(F.col("f") == "keywords", at(0)).when(F.col("f") == "name", at(1)).otherwise(at(2))
    rows = rows.select(key().cast("string").alias("listing_id"), F.lit("appStore").alias("store"), F.col("f").alias("field"), value.alias("value")).where("value is not null")
    return lint.lint_keywords(rows).select("listing_id", "message")


SAID = ["Used by 5,000 teams", "Join 20k users today", "Rated 4.8 stars", "Loved by the team at TheOrigin", "Plain words here", "As seen on TV", "The-Origin helps", "Theorigin"]


def lint_claims(spark: SparkSession, d: str) -> DataFrame:
    """Proof that a stated claim backs, proof that none does, and the original's name."""
    items = _keys(spark, d).select("page", "k", _pick(SAID, key()).alias("t")).select(F.col("page").alias("source_id"), key().alias("pos"), F.lit("text").alias("kind"), "t")
    found = lint.predicates(lint.prepared(items), avoid=["TheOrigin"], claims=["We have 20k users today in 3 countries", "4.8 stars on the store"])
    return lint.ordered(found).select("source_id", "pos", "level", "rule")


def lint_said_totals(spark: SparkSession, d: str) -> DataFrame:
    """Errors, warnings and notes of the said things by page, and whether the page passes."""
    items = _keys(spark, d).select(F.col("page").alias("source_id"), key().alias("pos"), F.when(key() % 3 == 0, "button").otherwise("text").alias("kind"), _pick([*SAID, "Oops, wrong", "OK!"], F.floor(key() / 40)).alias("t"))
    return lint.totals(lint.predicates(lint.prepared(items), avoid=["TheOrigin"]))


def lint_dashes(spark: SparkSession, d: str) -> DataFrame:
    items = _keys(spark, d).select(F.col("page").alias("source_id"), key().alias("pos"), F.lit("text").alias("kind"), _pick(["a — b", "c", "d - e"], F.floor(key() / 400)).alias("t"))
    return lint.em_dashes(lint.prepared(items)).select("source_id", "pos", "text", "detail")


def lint_heading_case(spark: SparkSession, d: str) -> DataFrame:
    """Title and sentence case among the whole first lines of documents, by language."""
    docs = table(spark, d, "documents")
    first = F.element_at(F.split("text", "\n"), 1)
    items = docs.select(F.col("lang").alias("source_id"), F.col("doc_id").alias("pos"), F.lit("heading").alias("kind"), first.alias("t"))
    return lint.mixed_case(lint.prepared(items)).select("source_id", "detail")


def copy_items(spark: SparkSession, d: str) -> DataFrame:
    """What a reader sees in files of six sorts made from documents."""
    doc = table(spark, d, "documents")
    i, src = F.col("doc_id"), F.col("source")
    title = F.to_json(F.struct(F.struct(src.alias("subTitle"), F.array("lang").alias("tags")).alias("page"), F.lit("x").alias("note")))
    measured = F.to_json(F.struct(F.array(F.struct(F.lit("button").alias("kind"), src.alias("t")), F.struct(F.lit(None).cast("string").alias("kind"), F.col("lang").alias("t"))).alias("text")))
    sweep_ = F.lit('{"scroll": {"a": "s"}, "hover": ["h"], "focus": {"f": 1}, "label": "no copy"}')
    html = F.concat(F.lit("<h2>Head &amp; "), src, F.lit("</h2><p>Body <b>of</b> it</p>"))
    md = F.concat(F.lit("# Head "), src, F.lit("\n\n```\n<!-- no -->\n- item [link](http://x) `code`\n"))
    n = (i % 6).cast("int")
    ext = F.element_at(F.array(*[F.lit(x) for x in (".json", ".m.JSON", ".s.json", ".html", ".md", ".b.json")]), n + 1)
    content = F.element_at(F.array(title, measured, sweep_, html, md, F.lit("{broken")), n + 1)
    return lint.items_of_files(doc.select(F.concat(F.lit("dir/"), i.cast("string"), ext).alias("path"), content.alias("content")))


def file_name_hits(spark: SparkSession, d: str) -> DataFrame:
    paths = _keys(spark, d).select(F.concat(F.lit("src/TheOrigin/"), _pick(["theOriginLogo.svg", "the-origin.css", "theoriginal.md", "origin.md"], key()), F.when(key() < 8, "").otherwise(key().cast("string"))).alias("path"))
    return sweep.file_name_hits(paths, sweep.names(spark.createDataFrame([("TheOrigin",)], "name string"))).select("path", "text", "detail")


def original_texts(spark: SparkSession, d: str) -> DataFrame:
    """Measured texts, crawled pages and app notes as one set of originals, each text once."""
    c = table(spark, d, "conversations")
    apps = _keys(spark, d).select(F.when(key() % 2 == 0, F.concat(F.lit("app "), (key() % 100).cast("string"))).alias("description"), F.lit("").alias("notes"))
    out = sweep.original_texts(c.select(F.col("text").alias("t")), table(spark, d, "benchmark"), apps)
    return out.groupBy(F.length("text").cast("long").alias("chars")).agg(F.count("*").alias("n"))


def domain_states(spark: SparkSession, d: str) -> DataFrame:
    """States of domains made of order keys, from recorded answers of two registries and of name servers."""
    k = _keys(spark, d)
    names = k.select(F.concat(F.lit("Name"), key().cast("string"), F.lit(".Old")).alias("name"), _pick(["COM", "org", "zz"], key()).alias("tld"))
    bases = spark.createDataFrame([("com", "https://one.example/"), ("org", "https://two.example")], "tld string, base string")
    label = F.concat(F.lit("name"), key().cast("string"))
    registry = k.where("k % 4 <> 0").select(F.concat(F.when(key() % 3 == 0, "https://one.example/domain/").otherwise("https://two.example/domain/"), label, F.when(key() % 3 == 0, ".com").otherwise(".org")).alias("url"), _pick(["404", "200", "500"], F.floor(key() / 3)).cast("int").alias("status"))
    dns = k.select(F.concat(label, _pick([".com", ".org", ".zz"], key())).alias("domain"), _pick(["0", "3", "2", "5"], F.floor(key() / 9)).cast("int").alias("status"), (key() % 2).alias("answers"))
    return feeds.domain_states(names, bases, registry, dns).select("domain", F.coalesce("base", F.lit("")).alias("base"), "state")


HOSTS = ["cdn.origin.example", "origin.example", "notorigin.example", "www.Other.example", "x.y.other.example", "free.example"]


def host_hits(spark: SparkSession, d: str) -> DataFrame:
    avoid = sweep.domains(spark.createDataFrame([("https://www.origin.example/",)], "domain string"), spark.createDataFrame([("OTHER.example",), ("origin.example",), ("",)], "domain string"))
    h = sweep.host_hits(_keys(spark, d).select(F.col("page").alias("path"), _pick(HOSTS, key()).alias("host")), avoid)
    return h.groupBy("path", "text", "detail").agg(F.count("*").alias("n"))


def avoid_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of two lists as words, each once."""
    a, b = table(spark, d, "part").select(F.col("p_name").alias("name")), table(spark, d, "part").select(F.initcap("p_name").alias("name")).union(table(spark, d, "customer").select(F.lit(" -- ").alias("name")))
    return sweep.names(a, b).select(F.array_join("words", " ").alias("words"))


def avoid_colors(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "part").select(_hex(F.col("p_partkey") % 90).alias("color"))
    return sweep.colors(a, a.select(F.lit("none of them").alias("color")), a).select("color", round_half_up(F.col("lab.l"), 6).alias("l"))


EXTENSIONS = [".css", ".TSX", ".png", ".md", ""]


def color_hits(spark: SparkSession, d: str) -> DataFrame:
    """Colours within three of a brand colour's blue, in code files."""
    near = F.concat(F.lit("#00"), F.lower(F.lpad(F.hex(key() % 20 + 97), 2, "0")), F.lit("ff"))
    rows = _keys(spark, d).select(F.concat(F.lit("f"), key().cast("string"), _pick(EXTENSIONS, key())).alias("path"), F.lit(1).alias("line"), F.concat(F.lit("a { color: "), near, F.lit("; border: 1px rgb(0, 107, 255) }")).alias("text"))
    hit = sweep.color_hits(rows, sweep.colors(spark.createDataFrame([("#006bff",)], "color string")))
    return hit.select("path", "detail")


def _path(k: Column, one: str, sep: str) -> Column:
    """A long drawing path of a key, in one of two ways of writing."""
    return F.concat(F.lit("M" + sep), k.cast("string"), F.repeat(F.lit(f"{sep}L{sep}{one}{sep}2.5"), 12), F.lit("z"))


def path_hits(spark: SparkSession, d: str) -> DataFrame:
    """Drawing paths that equal known ones but for how they are written."""
    known = spark.createDataFrame([(i,) for i in (1, 2, 2, 5)], "i long").select(F.concat(F.lit("logo"), F.col("i").cast("string")).alias("path"), F.lit(1).alias("line"), F.concat(F.lit('<path d="'), _path(F.col("i"), "3.04", " "), F.lit('"/>')).alias("text"))
    known = sweep.drawing_paths(known).select("hash", F.col("path").alias("file"))
    mine = _keys(spark, d).select(F.concat(F.lit("p"), key().cast("string")).alias("path"), F.lit(7).alias("line"), F.concat(F.lit("<path d='"), _path(key() % 8, "3.0", ","), F.lit("'/>")).alias("text"))
    return sweep.path_hits(mine, known).select("path", "line", "detail")


def image_hits(spark: SparkSession, d: str) -> DataFrame:
    image = lambda k: F.concat(F.lit("image "), k.cast("string")).cast("binary")
    k = _keys(spark, d)
    mine = k.select(F.concat(F.lit("mine/"), key().cast("string")).alias("path"), image(key() % 50).alias("content"))
    theirs = k.where("k < 30").select(F.concat(F.lit("theirs/"), F.lpad(key().cast("string"), 3, "0")).alias("path"), image(F.floor(key() / 3)).alias("content"))
    return sweep.image_hits(mine, theirs).select("path", "detail")


LINES = ["plain", "ok // sweep-allow", "has token X here", "other"]


def sweep_levels(spark: SparkSession, d: str) -> DataFrame:
    """Hits with their level: a mark, an allowed path or text excuses names, domains, colours and drawings only."""
    hits = _keys(spark, d).select(_pick(["name", "copy", "color", "image", "runtime", "svg"], F.floor(key() / 4)).alias("kind"), F.concat(_pick(["src/a/", "docs/", "src/ab/"], F.floor(key() / 24)), key().cast("string")).alias("path"), F.lit(1).alias("line"), _pick(LINES, key()).alias("text"), F.lit("x").alias("detail"))
    return sweep.tag(hits, ["src/a", "token X"]).groupBy("kind", "text", F.regexp_extract("path", r"^(.*)/\d+$", 1).alias("folder"), "level").agg(F.count("*").alias("n"))


def sweep_report(spark: SparkSession, d: str) -> DataFrame:
    """The first 80 hits, errors first (a top-k report)."""
    hits = _keys(spark, d).select(_pick(["copy", "name", "runtime"], key()).alias("kind"), _pick(["error", "allowed"], F.floor(key() / 3)).alias("level"), F.lpad(key().cast("string"), 9, "0").alias("path"), F.lit(1).alias("line"), F.lit("x").alias("detail"))
    return sweep.ordered(hits).select("kind", "level", "path")


MARKUP = ["<p>Words that a reader sees</p>", 'const t = "Four words stand in here"', 'const u = "nospaceshereatallinthistext"', "<p>short</p>", "x = `A template of four words`; y = 'Another one of four words'"]


def source_strings(spark: SparkSession, d: str) -> DataFrame:
    rows = _keys(spark, d).select(F.col("page").alias("path"), key().alias("line"), _pick(MARKUP, key()).alias("text"))
    return sweep.source_strings(rows).groupBy("string").agg(F.count("*").alias("n"))


def severe_bugs(spark: SparkSession, d: str) -> DataFrame:
    b = _keys(spark, d).select("k", _pick(["S1", "s2", "S3", "S12", ""], key()).alias("severity"), _pick(["open", "Fixed", "wontfix", "fixed later"], F.floor(key() / 5)).alias("status"))
    return gates.open_severe(b)


NOTES = ["Decision: go", "x\nDecision:   GO, rescoped", "Decision: maybe", "the Decision: go", "Decision: gone", "{{decision}}", "decision: no-go."]


def decisions(spark: SparkSession, d: str) -> DataFrame:
    return _keys(spark, d).select("k", _pick(NOTES, key()).alias("t")).groupBy("t").agg(F.count_if(gates.decision(F.col("t"))).alias("decided"), F.count_if(gates.filled(F.col("t"))).alias("filled"))


def critic_screens(spark: SparkSession, d: str) -> DataFrame:
    s = _keys(spark, d).select("k", F.when(key() % 5 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("hardRejects"), (key() % 36).alias("total"), F.create_map(F.lit("a"), key() % 7, F.lit("b"), F.lit(4).cast("long")).alias("scores"))
    return gates.critic(s, 28).where("passes").select("k", "total")


def gate_advance(spark: SparkSession, d: str) -> DataFrame:
    """States of all stages after gates that half of them passed."""
    stage = F.element_at(F.array(*[F.lit(x) for x in gates.STAGES]), (key() % 4 + 1).cast("int"))
    state = _keys(spark, d).where("k < 4").select(stage.alias("stage"), F.create_map(F.lit("research"), F.struct(F.lit(False).alias("passed"), F.lit("then").alias("at"))).alias("gates"))
    result = _keys(spark, d).where("k in (0, 1, 3)").select(stage.alias("stage"), (key() != 1).alias("passed"))
    a = gates.advance(state, result, F.lit("now"))
    return a.select("stage", F.array_join(F.array_sort(F.transform(F.map_entries("gates"), lambda e: F.concat_ws(" ", e["key"], e["value"]["passed"].cast("string"), e["value"]["at"]))), ",").alias("gates"))


MODES = ("app", "site", "feature", "migrate")


def _facts(spark: SparkSession, d: str) -> DataFrame:
    """One row of facts, counted from orders and suppliers."""
    o, s = table(spark, d, "orders"), table(spark, d, "supplier")
    n = o.agg(F.count("*").alias("n"), F.countDistinct("o_orderpriority").alias("p")).crossJoin(s.agg(F.count("*").alias("s")))  # one row by one row
    c = F.col
    return n.select(
        (c("n") > 0).alias("measured_system"), (c("p") - 5).alias("lint_errors"), F.lit(False).alias("design_md"), (c("n") > 0).alias("clone_measured"), F.lit(85.0).alias("structure"), F.lit(93.0).alias("pixels"),
        F.lit(94.5).alias("self_pixels"), (c("p") - 4).alias("urls_failing"), F.lit(29).alias("critic_total"), F.lit(3).alias("critic_least"), F.lit(0).alias("hard_rejects"), F.lit(0).alias("copy_errors"), (c("p") - 2).alias("copy_warnings"),
        F.lit(1).alias("sweep_errors"), F.lit("shippable").alias("parity_verdict"), F.lit(0).alias("open_severe"), F.lit(True).alias("brand_checked"), F.lit(0).alias("listing_errors"),
    )


def gate_stages(spark: SparkSession, d: str) -> DataFrame:
    """Design, build and launch checks in all modes."""
    f = _facts(spark, d)
    return gates.union([stage(f, m) for stage in (gates.design, gates.build, gates.launch) for m in MODES]).select("stage", "mode", F.col("ord").cast("long").alias("ord"), "status")


def gate_stage_passes(spark: SparkSession, d: str) -> DataFrame:
    f = _facts(spark, d)
    return gates.passes(gates.union([stage(f, m) for stage in (gates.design, gates.build, gates.launch) for m in MODES])).select("stage", "mode", "passed")


NOTATIONS = ["rgb({0}, 20, 30)", "rgba({0} 20 30 / 50%)", "#0a0{1}", "RED", "rgb(300, -5, {0})", "hsl({0}deg 100% 50%", "oklch(0)", "transparent", "hsl(120, 100%, 50%)"]


def color_grammar(spark: SparkSession, d: str) -> DataFrame:
    s = F.lit(None).cast("string")
    for i, n in enumerate(NOTATIONS):
        s = F.when(key() % len(NOTATIONS) == i, F.replace(F.replace(F.lit(n), F.lit("{0}"), (key() % 100).cast("string")), F.lit("{1}"), (key() % 10).cast("string"))).otherwise(s)
    c = _keys(spark, d).select("k", C.parse_color(s).alias("c"))
    return c.select("k", F.coalesce("c.r", F.lit(-1.0)).alias("r"), F.coalesce("c.g", F.lit(-1.0)).alias("g"), F.coalesce("c.b", F.lit(-1.0)).alias("b"), F.coalesce("c.a", F.lit(-1.0)).alias("a"))


def color_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    """Gaps of hues, colours laid over others, and the notations in a text."""
    v = lambda m: (key() * m % 256).cast("double")
    fg, bg = C.rgba(v(3), v(5), v(7), F.lit(0.25)), C.rgba(v(11), v(13), v(17), F.lit(1.0))
    text = F.concat(F.repeat(F.lit("#abc "), (key() % 4).cast("int")), F.lit("rgb(1, 2, 3) #12345 #a1b2c3d4 #"), key().cast("string"))
    return _keys(spark, d).select("k", C.hue_gap((key() * 7 % 360).cast("double"), (key() * 11 % 360).cast("double")).alias("gap"), C.to_hex(C.over(fg, bg)).alias("over"), C.to_hex(C.rgba(v(3), v(5), v(7), (key() % 2 / 2).cast("double"))).alias("hex"), F.element_at(C.colors_in_text(text), 1).alias("first"))


PALETTE = ["#111827", "#6b7280", "#006bff", "#f3f4f6", "#ff5a1f", "#d1d5db", "#0a8f4d", "#fefefe", "#7c3aed"]


def color_roles_ranked(spark: SparkSession, d: str) -> DataFrame:
    """Roles of nine colours a page, with counters that leave some roles empty and make others tie."""
    n = F.floor(key() / 40)
    p = F.substring("page", 2, 9).cast("long")
    uses = {"text": (p * 7 + n * 13) % 50 * (n % 3 < 2).cast("int"), "bg": (p + n * 5) % 9, "border": (p * 3 + n) % 4, "icon": F.lit(0), "action": (p + n) % 5 * (p % 4 > 0).cast("int"), "label": (p * n) % 3}
    c = _keys(spark, d).where("k < 360").select("page", _pick(PALETTE, n).alias("hex"), F.lit("#ffffff").alias("canvas"), (n + 1).cast("int").alias("rank"), *[v.cast("long").alias(c) for c, v in uses.items()])
    r = tokens.color_roles(c, ["page"])
    return r.select("page", *[F.coalesce(x, F.lit("")).alias(x) for x in ("ink", "ink_soft", "surface", "accent", "on_accent", "border")], F.array_join("brand", ",").alias("brand"))


def design_distances(spark: SparkSession, d: str) -> DataFrame:
    """OKLab distance of each part's colour from the next part's."""
    p = table(spark, d, "part").select("p_partkey", C.oklab(C.parse_hex(_hex(F.col("p_partkey")))).alias("x"), C.oklab(C.parse_hex(_hex(F.col("p_partkey") + 1))).alias("y"))
    return p.select("p_partkey", round_half_up(C.distance(F.col("x"), F.col("y")), 4).alias("distance"))


def structure_moves(spark: SparkSession, d: str) -> DataFrame:
    """Pages against copies of which the lower half is pushed below the first screen: nodes that cross the fold."""
    node = _keys(spark, d).where("k < 2000").select(F.col("page").alias("pair_id"), F.lit("button").alias("role"), F.lit(0).alias("x"), (F.floor(key() / 40) * 40).alias("y"), F.lit(200).alias("w"), F.lit(40).alias("h"), F.concat(F.lit("n"), key().cast("string")).alias("name"), key().alias("pos"))
    pushed = node.withColumn("y", F.when(F.col("y") >= 600, F.col("y") + 300).otherwise(F.col("y")))
    nodes = node.withColumn("side", F.lit("a")).unionByName(pushed.withColumn("side", F.lit("b")))
    pages = node.select("pair_id").distinct().withColumn("side", F.explode(F.array(F.lit("a"), F.lit("b")))).selectExpr("*", "1440 AS view_w", "900 AS view_h", "4000 AS page_h")
    matched = structure.match_nodes(structure.keep_nodes(nodes, ["pair_id", "side"]), pages)
    return structure.moved_across_fold(nodes, matched, pages).select("pair_id", "name", "to")


IMAGE = (720, 320)


def _images(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Grey pages with a dark frame; b has a red cell at column `cell` of row 5 where the key is odd."""
    for pdf in batches:
        out = []
        for k in pdf["k"]:
            a = np.full((IMAGE[1], IMAGE[0], 4), 255, np.uint8)
            a[8:12, :, :3] = 0
            b = a.copy()
            if k % 2:
                x = k % 45 * 16
                b[80:96, x : x + 16, :3] = (255, 0, 0)
            out.append((str(k), png.encode(a), png.encode(b), "0,80,720,16" if k % 4 == 3 else ""))
        yield pd.DataFrame(out, columns=["pair_id", "a", "b", "masks"])


def image_compare(spark: SparkSession, d: str) -> DataFrame:
    """Screenshots of 45 by 20 cells, pixel by pixel: equal ones, ones that differ in a cell, ones where that row is masked."""
    k = _keys(spark, d).where("k < 100").repartition(spark.sparkContext.defaultParallelism, "k").select("k")
    r = visual.compare_pairs(k.mapInPandas(_images, "pair_id string, a binary, b binary, masks string"), pixel=True)
    one = F.get("regions", F.lit(0))
    bar = visual.calibrated_bar(r.withColumn("self_score", F.col("score")))
    return bar.select("pair_id", "mode", "score", "height_ratio", F.coalesce(F.concat_ws(",", one["x"], one["y"], one["w"], one["h"], one["cells"]), F.lit("")).alias("region"), F.size("drift").cast("long").alias("drift"), "bar")


_D = "SELECT s_suppkey AS k, s_suppkey::VARCHAR AS id FROM supplier"
_DHEX = lambda k: f"printf('#%02x%02x%02x', ({k} * 37) % 256, ({k} * 91) % 256, ({k} * 151) % 256)"
_LIGHT = f"""l AS (SELECT id, k, role, raw FROM (SELECT id, k, unnest(['canvas', 'ink', 'accent', 'surface', 'ink-soft', 'bad']) AS role, unnest([{_sql_pick(["#ffffff", "#ffffff", "#000000"])}, {_DHEX("k")},
  CASE WHEN k % 4 <> 3 THEN {_DHEX("(k + 1)")} END, CASE WHEN k % 5 = 0 THEN '#fafafa' END, CASE WHEN k % 2 = 0 THEN '#777777' END, CASE WHEN k % 6 = 0 THEN 'not a colour' END]) AS raw FROM ({_D})) WHERE raw IS NOT NULL)"""
_ROLES = f"""WITH {_LIGHT}, r AS (SELECT id, k, 'light' AS mode, role, raw FROM l UNION ALL SELECT id, k, 'dark', role, CASE WHEN role = 'canvas' THEN '#111111' ELSE raw END FROM l WHERE k % 2 = 0),
 c AS (SELECT *, ('0x' || substr(raw, 2, 2))::INTEGER AS r, ('0x' || substr(raw, 4, 2))::INTEGER AS g, ('0x' || substr(raw, 6, 2))::INTEGER AS b FROM r WHERE raw <> 'not a colour')"""
_LUM = f"0.2126 * {_sql_lin('r')} + 0.7152 * {_sql_lin('g')} + 0.0722 * {_sql_lin('b')}"
_PAIRS = f"""p AS (SELECT id, fg, bg, CASE kind WHEN 'text' THEN 4.5 ELSE 3.0 END AS least FROM ({_D}), (VALUES {', '.join(f"('{a}', '{b}', '{k}')" for a, b, k in designs.PAIRS)}) v(fg, bg, kind) WHERE k % 10 <> 0
  UNION ALL SELECT id, 'ink', 'accent', 3.0 FROM ({_D}) WHERE k % 10 = 0)"""
_CLOSE = f"""{_ROLES}, m AS ({_sql_lab("SELECT * FROM c WHERE mode = 'light'")}), t AS ({_sql_lab(_BRAND)}),
 h AS (SELECT *, sqrt(a_ * a_ + b_ * b_) AS ch, (degrees(atan2(b_, a_)) + 360) % 360 AS hu FROM m), u AS (SELECT *, sqrt(a_ * a_ + b_ * b_) AS ch, (degrees(atan2(b_, a_)) + 360) % 360 AS hu FROM t),
 j AS (SELECT h.*, u.color, sqrt((h.l_ - u.l_) ** 2 + (h.a_ - u.a_) ** 2 + (h.b_ - u.b_) ** 2) * 100 AS d, u.ch AS tch, abs((h.hu - u.hu + 540) % 360 - 180) AS gap FROM h, u)"""
_MISSING = f"""{_ROLES} SELECT d.id AS design_id, v.level, 'roles' AS rule, v.role AS detail FROM ({_D}) d, (VALUES ('error', 'canvas'), ('error', 'ink'), ('error', 'accent'), ('warning', 'surface'), ('warning', 'ink-soft'), ('warning', 'on-accent'), ('warning', 'border')) v(level, role)
 WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.id = d.id AND l.role = v.role)"""
_TOKENS = f"""SELECT id AS design_id, 'error' AS level, 'missing-token' AS rule, unnest(list_filter([CASE WHEN k % 4 = 3 THEN 'button colors.accent' END, CASE WHEN k % 4 = 0 THEN 'button spacing.a' END, 'button spacing.zz', CASE WHEN k % 3 <> 0 THEN 'button rounded.xl' END], lambda x: x IS NOT NULL)) AS detail FROM ({_D})"""
_SAYS = """CASE WHEN v = '' THEN CASE WHEN field IN ('name', 'title', 'description') THEN [['error', 'Empty.']] ELSE [] END ELSE
  list_filter([CASE WHEN length(v) > lim THEN ['error', length(v) || ' characters, the limit is ' || lim || '.'] END,
   CASE WHEN field <> 'description' AND v = 'The best notes for you' THEN ['warning', 'Ranking or price claims in a short field are a common rejection reason.'] END,
   CASE WHEN field IN ('name', 'title') AND v = 'Note ⭐' THEN ['error', 'No emoji in the name.'] END,
   CASE WHEN field <> 'description' AND v = 'SHOUTING' THEN ['warning', 'All caps reads as shouting and is often rejected.'] END,
   CASE WHEN v = 'Notes by TheOrigin' THEN ['error', 'Holds the original''s name ("the origin").'] END], lambda x: x IS NOT NULL) END"""
_PASS = {
    ("design", 1): "pass", ("design", 2): "pass", ("design", 3): "fail", ("build", 1): "pass", ("build", 2): {"app": "pass", "site": "pass", "feature": "skip", "migrate": "fail"},
    ("build", 3): {"migrate": "pass"}, ("build", 4): {"migrate": "fail"}, ("build", 5): {"app": "pass", "site": "fail", "feature": "pass"}, ("build", 6): "pass", ("build", 7): "fail",
    ("build", 8): "pass", ("build", 9): "pass", ("launch", 1): "pass", ("launch", 2): {"app": "fail"}, ("launch", 3): "pass", ("launch", 4): "pass", ("launch", 5): "fail",
}
_ONLY = {("design", 1): 3, ("design", 2): 3, ("design", 3): 3, ("build", 6): 3, ("build", 7): 3}


def _expected() -> Iterator[tuple[str, str, int, str]]:
    """Status of every check in every mode for the facts above, where the tables have five order priorities."""
    skipped = {("build", 8): ("site", "migrate"), ("launch", 1): ("feature", "migrate")}
    for (stage, n), status in _PASS.items():
        for m in MODES:
            if isinstance(status, dict):
                yield stage, m, n, status.get(m, "skip")
            else:
                out = m == "migrate" and (stage, n) in _ONLY or m in skipped.get((stage, n), ())
                yield stage, m, n, "skip" if out else status


_GATES = "SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{m}', {n}::BIGINT, '{x}')" for s, m, n, x in _expected()) + ") t(stage, mode, ord, status)"

QUERIES = {
    f.__name__: f
    for f in (
        design_roles, design_missing_roles, design_unreadable, design_contrast, design_too_close, design_traps, design_scales, design_their_fonts, design_missing_tokens,
        design_ranked, listing_lint, listing_keywords, lint_claims, lint_said_totals, lint_dashes, lint_heading_case, copy_items, file_name_hits, original_texts, domain_states, host_hits, avoid_names, avoid_colors, color_hits, path_hits, image_hits,
        sweep_levels, sweep_report, source_strings, severe_bugs, decisions, critic_screens, gate_advance, gate_stages, gate_stage_passes, color_grammar, color_arithmetic, color_roles_ranked,
        design_distances, structure_moves, image_compare,
    )
} | {"structure_self": structure_self}

ORACLES = {
    "design_roles": f"{_ROLES} SELECT id AS design_id, mode, role, raw, raw <> 'not a colour' AS readable FROM r",
    "design_missing_roles": _MISSING,
    "design_unreadable": f"{_ROLES} SELECT DISTINCT id AS design_id, 'error' AS level, 'invalid-color' AS rule, role || ' ' || raw AS detail FROM r WHERE raw = 'not a colour'",
    "design_contrast": f"""{_ROLES}, y AS (SELECT id, mode, role, {_LUM} AS y FROM c), {_PAIRS},
        j AS (SELECT p.*, a.mode, (greatest(a.y, b.y) + 0.05) / (least(a.y, b.y) + 0.05) AS x FROM p JOIN y a ON a.id = p.id AND a.role = fg JOIN y b ON b.id = p.id AND b.role = bg AND b.mode = a.mode)
        SELECT id AS design_id, 'error' AS level, 'contrast' AS rule, printf('%s: %s on %s: %.2f:1, needs %.1f:1', mode, fg, bg, x, least::DOUBLE) AS detail FROM j WHERE x < least""",
    "design_too_close": f"""{_CLOSE} SELECT id AS design_id, CASE WHEN role = 'accent' THEN 'error' ELSE 'warning' END AS level, 'too-close' AS rule, printf('%s %s is %.1f from %s', role, raw, d, color) AS detail FROM j
        WHERE (role = 'accent' AND (d < 10 OR (d < 20 AND ch >= 0.06 AND tch >= 0.06 AND gap < 25))) OR (role <> 'accent' AND ch >= 0.06 AND d < 8)""",
    "design_traps": f"""{_CLOSE} SELECT id AS design_id, 'warning' AS level, 'ai-violet' AS rule, raw AS detail FROM h WHERE role = 'accent' AND ch >= 0.1 AND hu BETWEEN 270 AND 310
        UNION ALL SELECT id, 'warning', 'pure-black', role FROM h WHERE role IN ('ink', 'canvas') AND raw = '#000000'""",
    "design_scales": f"""WITH s AS (SELECT id, k, k % 30 + 8 AS body, CASE WHEN k % 7 = 0 THEN 3 ELSE 4 END AS sizes,
          len(list_distinct(['Inter', [ 'Inter', 'Grotesk X', 'Serif Z'][k % 3 + 1], CASE WHEN k % 2 = 0 THEN 'Mono Q' ELSE 'Inter' END, 'Other'])) AS fam, 2 + CASE WHEN k % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END AS radii,
          list_filter([8, k % 5 * 4 + 1, CASE WHEN k % 2 = 0 THEN 3 END], lambda x: x IS NOT NULL) AS sp FROM ({_D}))
        SELECT id AS design_id, 'warning' AS level, rule, detail FROM (
          SELECT id, 'name' AS rule, 'no name' AS detail FROM s WHERE k % 9 = 0
          UNION ALL SELECT id, 'type-scale', sizes::DOUBLE::VARCHAR FROM s WHERE sizes < 4
          UNION ALL SELECT id, 'type-scale', NULL FROM s WHERE greatest(32, body) / least(11, body) < 2
          UNION ALL SELECT id, 'fonts', fam::VARCHAR FROM s WHERE fam > 3
          UNION ALL SELECT id, 'body-size', body::DOUBLE::VARCHAR FROM s WHERE body < 14 OR body > 20
          UNION ALL SELECT id, 'corners', radii::VARCHAR FROM s WHERE radii > 4
          UNION ALL SELECT id, 'spacing', 'none' FROM s WHERE k % 4 = 0
          UNION ALL SELECT id, 'spacing', 'no base' FROM s WHERE k % 4 <> 0 AND len(list_filter(sp, lambda x: x % 2 = 0)) / len(sp) < 0.8)""",
    "design_their_fonts": f"SELECT id AS design_id, 'error' AS level, 'their-font' AS rule, 'Grotesk X' AS detail FROM ({_D}) WHERE k % 3 = 1",
    "design_missing_tokens": _TOKENS,
    "design_ranked": f"SELECT design_id, rule, detail, row_number() OVER (PARTITION BY design_id ORDER BY level <> 'error', rule, detail) AS rank FROM (SELECT * FROM ({_MISSING}) UNION ALL SELECT * FROM ({_TOKENS}))",
    "listing_lint": f"""SELECT k::VARCHAR AS listing_id, x[1] AS level, w AS field, x[2] AS message FROM (SELECT k, w, unnest({_SAYS}) AS x FROM (
        SELECT k, w, v, split_part(w, '.', 2) AS field, CASE split_part(w, '.', 2) WHEN 'shortDescription' THEN 80 WHEN 'description' THEN 4000 ELSE 30 END AS lim FROM (SELECT k, {_sql_pick(FIELDS)} AS w, {_sql_pick(VALUES, '(k // 6)')} AS v FROM ({_K})) WHERE w <> 'appStore.unknown'))""",
    "listing_keywords": f"""SELECT k::VARCHAR AS listing_id, unnest(CASE k % 5 WHEN 0 THEN ['Spaces after commas waste characters.', 'Already in the name or subtitle: notes.'] WHEN 1 THEN ['Already in the name or subtitle: plan.', 'Repeated: notes.'] ELSE [] END) AS message FROM ({_K})""",
    "lint_claims": f"""SELECT page AS source_id, k AS pos, x[1] AS level, x[2] AS rule FROM (SELECT page, k, unnest(CASE k % 8 WHEN 0 THEN [['error', 'proof:user-count'], ['error', 'proof:trusted-by']] WHEN 3 THEN [['error', 'proof:trusted-by'], ['error', 'their-name']]
        WHEN 5 THEN [['error', 'proof:as-seen-in']] WHEN 6 THEN [['error', 'their-name']] ELSE [] END) AS x FROM ({_K}))""",
    "lint_said_totals": f"""SELECT page AS source_id, sum(e)::BIGINT AS errors, sum(w)::BIGINT AS warnings, 0::BIGINT AS notes, sum(e) = 0 AND sum(w) <= 3 AS passes FROM (
        SELECT page, [2, 1, 1, 2, 0, 1, 1, 0, 0, 0][n + 1] AS e, CASE WHEN n = 8 THEN 1 WHEN n = 9 AND k % 3 = 0 THEN 2 ELSE 0 END AS w FROM (SELECT page, k, (k // 40) % 10 AS n FROM ({_K}))) WHERE e + w > 0 GROUP BY 1""",
    "lint_dashes": f"""SELECT page AS source_id, min(k) AS pos, 'a — b' AS text, count(*) || ' em dash' || CASE WHEN count(*) > 1 THEN 'es' ELSE '' END AS detail FROM ({_K}) WHERE (k // 400) % 3 = 0 GROUP BY 1""",
    "lint_heading_case": r"""WITH h AS (SELECT lang, trim(regexp_replace(coalesce(string_split(text, chr(10))[1], ''), '\s+', ' ', 'g')) AS t FROM documents),
        w AS (SELECT lang, list_filter(string_split(t, ' ')[2:], lambda x: NOT list_contains(['a','an','and','as','at','but','by','for','in','of','on','or','the','to','with','vs'], lower(x)) AND regexp_matches(x, '^\p{L}')) AS x FROM h WHERE t <> '' AND len(string_split(t, ' ')) >= 3),
        f AS (SELECT lang, len(x) >= 2 AND len(list_filter(x, lambda v: regexp_matches(v, '^\p{Lu}'))) / greatest(len(x), 1) >= 0.7 AS title FROM w),
        g AS (SELECT lang, count(*) FILTER (WHERE title) AS a, count(*) FILTER (WHERE NOT title) AS b FROM f GROUP BY 1)
        SELECT lang AS source_id, a || ' headings in Title Case and ' || b || ' in sentence case.' AS detail FROM g WHERE a >= 2 AND b >= 2""",
    "copy_items": """WITH f AS (SELECT doc_id, 'dir/' || doc_id AS p, doc_id::VARCHAR AS b, source AS s, lang AS l, doc_id % 6 AS n FROM documents)
        SELECT p || '.json' AS source_id, 0::BIGINT AS pos, 'text' AS kind, 'x' AS t, b || '.json note' AS "where" FROM f WHERE n = 0
        UNION ALL SELECT p || '.json', 1, 'heading', s, b || '.json page.subTitle' FROM f WHERE n = 0 UNION ALL SELECT p || '.json', 2, 'text', l, b || '.json page.tags[0]' FROM f WHERE n = 0
        UNION ALL SELECT p || '.m.JSON', 0, 'button', s, b || '.m.JSON' FROM f WHERE n = 1 UNION ALL SELECT p || '.m.JSON', 1, 'text', l, b || '.m.JSON' FROM f WHERE n = 1
        UNION ALL SELECT p || '.html', 0, 'heading', 'Head & ' || s, b || '.html:1' FROM f WHERE n = 3 UNION ALL SELECT p || '.html', 2, 'text', 'Body of it', b || '.html:3' FROM f WHERE n = 3
        UNION ALL SELECT p || '.md', 0, 'heading', 'Head ' || s, b || '.md:1' FROM f WHERE n = 4 UNION ALL SELECT p || '.md', 2, 'text', '`', b || '.md:3' FROM f WHERE n = 4 UNION ALL SELECT p || '.md', 4, 'text', 'item link', b || '.md:5' FROM f WHERE n = 4""",
    "file_name_hits": f"SELECT 'src/TheOrigin/' || f AS path, f AS text, 'the origin' AS detail FROM (SELECT k, {_sql_pick(['theOriginLogo.svg', 'the-origin.css', 'theoriginal.md', 'origin.md'])} || CASE WHEN k < 8 THEN '' ELSE k::VARCHAR END AS f FROM ({_K})) WHERE k % 4 < 2",
    "original_texts": f"SELECT length(t)::BIGINT AS chars, count(*)::BIGINT AS n FROM (SELECT text AS t FROM conversations UNION SELECT text FROM benchmark UNION SELECT 'app ' || (k % 100) FROM ({_K}) WHERE k % 2 = 0) WHERE coalesce(t, '') <> '' GROUP BY 1",
    "domain_states": f"""SELECT 'name' || k || ['.com', '.org', '.zz'][k % 3 + 1] AS domain, ['https://one.example/', 'https://two.example', ''][k % 3 + 1] AS base,
        CASE WHEN k % 3 < 2 AND k % 4 <> 0 AND (k // 3) % 3 = 0 THEN 'free' WHEN k % 3 < 2 AND k % 4 <> 0 AND (k // 3) % 3 = 1 THEN 'taken' WHEN (k // 9) % 4 = 1 THEN 'free' WHEN (k // 9) % 4 = 0 AND k % 2 > 0 THEN 'taken' WHEN (k // 9) % 4 = 2 THEN 'taken' ELSE 'unknown' END AS state FROM ({_K})""",
    "host_hits": f"""SELECT page AS path, h AS text, CASE WHEN contains(h, 'origin') THEN 'origin.example' ELSE 'other.example' END AS detail, count(*)::BIGINT AS n FROM (SELECT page, {_sql_pick(HOSTS)} AS h FROM ({_K})) WHERE h NOT IN ('notorigin.example', 'free.example') GROUP BY ALL""",
    "avoid_names": "SELECT DISTINCT lower(p_name) AS words FROM part",
    "avoid_colors": f"SELECT DISTINCT printf('#%02x%02x%02x', r, g, b) AS color, floor(l_ * 1000000.0 + 0.5) / 1000000.0 AS l FROM ({_sql_lab('SELECT (k * 37) % 256 AS r, (k * 91) % 256 AS g, (k * 151) % 256 AS b FROM (SELECT DISTINCT p_partkey % 90 AS k FROM part)')})",
    "color_hits": f"""WITH n AS ({_sql_lab(f"SELECT k, 0 AS r, k % 20 + 97 AS g, 255 AS b FROM ({_K})")}), t AS ({_sql_lab("SELECT 0 AS r, 107 AS g, 255 AS b")}), f AS (SELECT k, 'f' || k || {_sql_pick(EXTENSIONS)} AS path, n.g AS gg, sqrt((n.l_ - t.l_) ** 2 + (n.a_ - t.a_) ** 2 + (n.b_ - t.b_) ** 2) * 100 AS d FROM n, t)
        SELECT path, printf('#00%02xff ~ #006bff', gg) AS detail FROM f WHERE d < 3 AND k % 5 NOT IN (2, 4) UNION ALL SELECT path, 'rgb(0, 107, 255) ~ #006bff' FROM f WHERE k % 5 NOT IN (2, 4)""",
    "path_hits": f"SELECT 'p' || k AS path, 7::INTEGER AS line, 'logo' || (k % 8) AS detail FROM ({_K}) WHERE k % 8 IN (1, 2, 5)",
    "image_hits": f"SELECT 'mine/' || k AS path, 'theirs/' || lpad((k % 50 * 3)::VARCHAR, 3, '0') AS detail FROM ({_K}) WHERE k % 50 < 10",
    "sweep_levels": f"""SELECT kind, text, folder, CASE WHEN kind IN ('name', 'color', 'svg') AND (text IN ('ok // sweep-allow', 'has token X here') OR folder = 'src/a') THEN 'allowed' ELSE 'error' END AS level, count(*)::BIGINT AS n
        FROM (SELECT {_sql_pick(["name", "copy", "color", "image", "runtime", "svg"], "(k // 4)")} AS kind, {_sql_pick(LINES)} AS text, {_sql_pick(["src/a", "docs", "src/ab"], "(k // 24)")} AS folder FROM ({_K})) GROUP BY ALL""",
    "sweep_report": f"""SELECT kind, level, path FROM (SELECT {_sql_pick(["copy", "name", "runtime"])} AS kind, {_sql_pick(["error", "allowed"], "(k // 3)")} AS level, lpad(k::VARCHAR, 9, '0') AS path FROM ({_K})) ORDER BY level <> 'error', CASE kind WHEN 'runtime' THEN 1 WHEN 'name' THEN 2 ELSE 3 END, path LIMIT 80""",
    "source_strings": f"""SELECT string, count(*)::BIGINT AS n FROM (SELECT unnest(CASE k % 5 WHEN 0 THEN ['Words that a reader sees'] WHEN 1 THEN ['Four words stand in here'] WHEN 4 THEN ['A template of four words', 'Another one of four words'] ELSE [] END) AS string FROM ({_K})) GROUP BY 1""",
    "severe_bugs": f"""SELECT * FROM (SELECT k, {_sql_pick(["S1", "s2", "S3", "S12", ""])} AS severity, {_sql_pick(["open", "Fixed", "wontfix", "fixed later"], "(k // 5)")} AS status FROM ({_K})) WHERE severity IN ('S1', 's2') AND status IN ('open', 'fixed later')""",
    "decisions": f"""SELECT t, count(*) FILTER (WHERE m IN (0, 1, 6))::BIGINT AS decided, count(*) FILTER (WHERE m <> 5)::BIGINT AS filled FROM (SELECT k % 7 AS m, {_sql_pick(NOTES)} AS t FROM ({_K})) GROUP BY 1""",
    "critic_screens": f"SELECT k, k % 36 AS total FROM ({_K}) WHERE k % 5 <> 0 AND k % 36 >= 28 AND k % 7 >= 3",
    "gate_advance": "SELECT * FROM (VALUES ('design', 'research true now'), ('design', 'design false now,research false then'), ('build', 'build false now,research false then'), ('launch', 'launch true now,research false then')) t(stage, gates)",
    "gate_stages": _GATES,
    "gate_stage_passes": f"SELECT stage, mode, NOT bool_or(status = 'fail') AS passed FROM ({_GATES}) GROUP BY ALL",
    "color_grammar": f"""SELECT k, x[1]::DOUBLE AS r, x[2]::DOUBLE AS g, x[3]::DOUBLE AS b, x[4]::DOUBLE AS a FROM (SELECT k, CASE k % 9 WHEN 0 THEN [k % 100, 20, 30, 1] WHEN 1 THEN [k % 100, 20, 30, 0.5] WHEN 2 THEN [0, 170, 0, (k % 10) * 17 / 255.0::DOUBLE] WHEN 3 THEN [255, 0, 0, 1] WHEN 4 THEN [255, 0, k % 100, 1]
        WHEN 7 THEN [0, 0, 0, 0] WHEN 8 THEN [0, 255, 0, 1] ELSE [-1, -1, -1, -1] END AS x FROM ({_K}))""",
    "color_arithmetic": f"""SELECT k, abs((k * 7 % 360 - k * 11 % 360 + 900) % 360 - 180)::DOUBLE AS gap,
        printf('#%02x%02x%02x', floor(k * 3 % 256 * 0.25::DOUBLE + k * 11 % 256 * 0.75::DOUBLE + 0.5)::INTEGER, floor(k * 5 % 256 * 0.25::DOUBLE + k * 13 % 256 * 0.75::DOUBLE + 0.5)::INTEGER, floor(k * 7 % 256 * 0.25::DOUBLE + k * 17 % 256 * 0.75::DOUBLE + 0.5)::INTEGER) AS over,
        printf('#%02x%02x%02x', k * 3 % 256, k * 5 % 256, k * 7 % 256) || CASE WHEN k % 2 = 0 THEN '00' ELSE '80' END AS hex, CASE WHEN k % 4 > 0 THEN '#abc' ELSE 'rgb(1, 2, 3)' END AS first FROM ({_K})""",
    "color_roles_ranked": f"""WITH raw AS (SELECT page, substr(page, 2)::BIGINT AS p, k // 40 AS n FROM ({_K}) WHERE k < 360),
        v AS (SELECT page, n + 1 AS rank, {_sql_pick(PALETTE, 'n')} AS hex, (p * 7 + n * 13) % 50 * CASE WHEN n % 3 < 2 THEN 1 ELSE 0 END AS text, (p + n * 5) % 9 AS bg, (p * 3 + n) % 4 AS border, (p + n) % 5 * CASE WHEN p % 4 > 0 THEN 1 ELSE 0 END AS action, (p * n) % 3 AS label FROM raw),
        m AS ({_sql_lab("SELECT *, ('0x' || substr(hex, 2, 2))::INTEGER AS r, ('0x' || substr(hex, 4, 2))::INTEGER AS g, ('0x' || substr(hex, 6, 2))::INTEGER AS b FROM v")}),
        w AS ({_sql_lab("SELECT 255 AS r, 255 AS g, 255 AS b")}),
        c AS (SELECT m.*, sqrt(m.a_ ** 2 + m.b_ ** 2) AS ch, sqrt((m.l_ - w.l_) ** 2 + (m.a_ - w.a_) ** 2 + (m.b_ - w.b_) ** 2) * 100 AS o, 0.2126 * m.lr + 0.7152 * m.lg + 0.0722 * m.lb AS y, 1.05 / (0.2126 * m.lr + 0.7152 * m.lg + 0.0722 * m.lb + 0.05) AS k,
          text >= greatest(1, sum(text) OVER (PARTITION BY page)) * 0.08 AS textual FROM m, w),
        f AS (SELECT *, action > 0 AND o >= 10 AS filled, coalesce(max(action) FILTER (WHERE action > 0 AND o >= 10) OVER (PARTITION BY page), 0) AS most FROM c),
        one AS (SELECT page, coalesce(arg_max(rank, (text, -rank)) FILTER (WHERE textual AND k >= 7), arg_max(rank, (k, -rank)) FILTER (WHERE textual), arg_max(rank, (text, -rank)) FILTER (WHERE text > 0)) AS ink,
          coalesce(arg_max(rank, (action, -rank)) FILTER (WHERE filled AND ch >= 0.06 AND action >= greatest(2, most * 0.15)), arg_max(rank, (action, -rank)) FILTER (WHERE filled), arg_max(rank, (label, -rank)) FILTER (WHERE label > 0 AND ch >= 0.06)) AS accent,
          arg_max(hex, (bg, -rank)) FILTER (WHERE bg > 0 AND o >= 2) AS surface, arg_max(hex, (border, -rank)) FILTER (WHERE border > 0) AS border FROM f GROUP BY 1),
        t AS (SELECT one.page, one.surface, one.border, i.hex AS ih, i.y AS iy, i.k AS ik, i.l_ AS il, i.a_ AS ia, i.b_ AS ib, a.hex AS ah, a.y AS ay, a.ch AS ac FROM one LEFT JOIN f i ON i.page = one.page AND i.rank = one.ink LEFT JOIN f a ON a.page = one.page AND a.rank = one.accent),
        s AS (SELECT f.page, arg_max(hex, (text, -rank)) FILTER (WHERE textual AND hex <> ih AND sqrt((f.l_ - il) ** 2 + (f.a_ - ia) ** 2 + (f.b_ - ib) ** 2) * 100 >= 5 AND k >= 3 AND k < ik) AS soft,
          coalesce(list(hex ORDER BY action * 40 + label * 10 + bg + text DESC, rank) FILTER (WHERE ch >= 0.06 AND coalesce(hex <> ah, true) AND action + label + text + bg > 0), []) AS others FROM f JOIN t USING (page) GROUP BY 1)
        SELECT page, coalesce(ih, '') AS ink, coalesce(soft, '') AS ink_soft, coalesce(surface, '') AS surface, coalesce(ah, '') AS accent, coalesce(border, '') AS border,
          CASE WHEN ah IS NULL THEN '' WHEN 1.05 / (ay + 0.05) >= (greatest(d, ay) + 0.05) / (least(d, ay) + 0.05) THEN '#ffffff' ELSE coalesce(ih, '#111111') END AS on_accent,
          array_to_string(list_slice(list_concat(CASE WHEN ac >= 0.03 THEN [ah] ELSE [] END, others), 1, 6), ',') AS brand
        FROM (SELECT t.*, soft, others, CASE WHEN 1.05 / (iy + 0.05) > 1.5 THEN iy ELSE ({_sql_lin('17')}) END AS d FROM t JOIN s USING (page))""",
    "design_distances": f"""WITH x AS ({_sql_lab("SELECT p_partkey AS k, (p_partkey * 37) % 256 AS r, (p_partkey * 91) % 256 AS g, (p_partkey * 151) % 256 AS b FROM part")}), y AS ({_sql_lab("SELECT p_partkey AS k, ((p_partkey + 1) * 37) % 256 AS r, ((p_partkey + 1) * 91) % 256 AS g, ((p_partkey + 1) * 151) % 256 AS b FROM part")})
        SELECT x.k AS p_partkey, floor(sqrt((x.l_ - y.l_) ** 2 + (x.a_ - y.a_) ** 2 + (x.b_ - y.b_) ** 2) * 1000000.0 + 0.5) / 10000.0 AS distance FROM x JOIN y USING (k)""",
    "structure_moves": f"""SELECT page AS pair_id, 'n' || k AS name, floor(((k // 40) * 40 + 300) / 4000 * 100 + 0.5)::BIGINT || '% down the page, left' AS "to" FROM ({_K}) WHERE k < 2000 AND (k // 40) * 40 BETWEEN 600 AND 899""",
    "image_compare": f"""SELECT k::VARCHAR AS pair_id, 'pixel' AS mode, s AS score, 1.0::DOUBLE AS height_ratio, CASE WHEN k % 4 = 1 THEN (k % 45 * 16) || ',80,16,16,1' ELSE '' END AS region, 0::BIGINT AS drift, least(95.0::DOUBLE, s - 2) AS bar
        FROM (SELECT k, CASE WHEN k % 4 = 1 THEN floor((1 - 1 / 900.0::DOUBLE) * 1000 + 0.5) / 10 ELSE 100.0::DOUBLE END AS s FROM ({_K}) WHERE k < 100)""",
    "structure_self": f"""WITH n AS (SELECT l_suppkey, l_returnflag = 'R' AS gone, l_linenumber AS i, [3.0, 3.0, 3.0, 2.0, 0.5, 1.0, 2.0][l_linenumber] AS w FROM lineitem WHERE l_linenumber BETWEEN 1 AND 7)
        SELECT l_suppkey::VARCHAR AS pair_id, floor(sum(w) FILTER (WHERE NOT gone) / sum(w) * 100 + 0.5)::BIGINT AS score, floor(coalesce(count(*) FILTER (WHERE NOT gone AND i IN (1, 2, 3, 7)), 0) / count(*) FILTER (WHERE i IN (1, 2, 3, 7)) * 100 + 0.5)::BIGINT AS order_score, count(*) FILTER (WHERE gone)::BIGINT AS missing FROM n GROUP BY 1""",
}
