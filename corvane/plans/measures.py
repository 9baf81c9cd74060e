"""Page measurements, interactions, structure, files and feeds: order and part keys give every value by plain arithmetic.

Each query shapes rows of a table into what the operator takes, and its SQL states the expected result over the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import html as H
from corvane.functions import text as T
from corvane.functions import urls as U
from corvane.operators import ledger, measure, reviews, tokens
from corvane.plans.common import _q, table
from corvane.sources import feeds, files


def _keys(spark: SparkSession, d: str) -> DataFrame:
    """k (the order key), page (one of 40)."""
    k = F.col("o_orderkey").cast("long")
    return table(spark, d, "orders").select(k.alias("k"), F.concat(F.lit("p"), (k % 40).cast("string")).alias("page"))


def _pick(values: list[str | None], k: Column) -> Column:
    """The value at place k modulo their number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values)).cast("int") + 1)


def _sql_pick(values: list[str | None], k: str = "k") -> str:
    return "([" + ", ".join("NULL" if v is None else _q(v) for v in values) + f"])[({k} % {len(values)}) + 1]"



def key() -> Column:
    return F.col("k")


_K = "SELECT o_orderkey AS k, 'p' || (o_orderkey % 40) AS page FROM orders"


def visible_elements(spark: SparkSession, d: str) -> DataFrame:
    v = measure.visible(key() % 3, key() % 5, key() % 2000 - 300, F.lit(1440), _pick(["block", "none", "flex", "grid", "inline"], key()), _pick(["visible"] * 6 + ["hidden"], key()), key() % 13)
    return _keys(spark, d).withColumn("v", v).groupBy("page").agg(F.count_if("v").alias("visible"), F.count("*").alias("n"))


TAGS = ["input", "a", "h1", "h4", "svg", "ol", "video", "span", "iframe", "nav", "select"]
ARIA = [None, "banner", None, "grid", "none", None, "SearchBox"]
TYPES = [None, "submit", "text", "IMAGE", "checkbox"]


def node_roles(spark: SparkSession, d: str) -> DataFrame:
    r = measure.role(_pick(TAGS, key()), _pick(ARIA, key()), _pick(TYPES, key()), key() % 2 == 0)
    return _keys(spark, d).select(_pick(TAGS, key()).alias("tag"), F.coalesce(r, F.lit("")).alias("role")).groupBy("tag", "role").agg(F.count("*").alias("n"))


KINDS = ["h1", "h4", "button", "link", "list"]


def text_kinds(spark: SparkSession, d: str) -> DataFrame:
    kind = measure.text_kind(_pick(KINDS, key()), key() % 3 == 0, key() % 4 == 0)
    return _keys(spark, d).groupBy(_pick(KINDS, key()).alias("role"), kind.alias("kind")).agg(F.count("*").alias("n"))


NAMES = {"aria_label": ["", "Close  it", ""], "labelled_by": [None, "", "Label"], "alt": [None, None, "", "Picture of\na hill"], "title": ["", "Title", None, "", ""], "placeholder": [None], "text": ["own   text "]}


def accessible_names(spark: SparkSession, d: str) -> DataFrame:
    e = _keys(spark, d).select("k", *[_pick(v, key()).alias(c) for c, v in NAMES.items()])
    return e.groupBy(measure.accessible_name(e).alias("name")).agg(F.count("*").alias("n"))


BACKS = ["#fff", "transparent", "rgba(0, 0, 0, 0)", None, ""]
IMAGES = [None, "linear-gradient(90deg, rgb(1, 2, 3) 0%, #ffffff 90%)", "url(x.png)", "radial-gradient(#00ff7f, red)", "linear-gradient(red, blue)"]


def fill_colors(spark: SparkSession, d: str) -> DataFrame:
    f = measure.fill_color(_pick(BACKS, key()), _pick(IMAGES, F.floor(key() / 5)))
    return _keys(spark, d).groupBy(F.coalesce(f, F.lit("none")).alias("fill")).agg(F.count("*").alias("n"))


def _tint(m: int) -> Column:
    return F.when(key() % m == 0, F.concat(F.lit("#00000"), (key() % 9).cast("string")))


def page_colors(spark: SparkSession, d: str) -> DataFrame:
    e = _keys(spark, d).select("page", F.concat(F.lit("#00000"), (key() % 7).cast("string")).alias("color"), (key() % 50).alias("chars"), _tint(2).alias("fill"), (key() % 100).alias("w"), (key() % 60).alias("h"), _tint(3).alias("border_color"), _tint(5).alias("icon_color"), _tint(7).alias("action_color"), _tint(11).alias("label_color"))
    return measure.page_colors(e)


def page_type(spark: SparkSession, d: str) -> DataFrame:
    e = _keys(spark, d).select("page", (key() % 5).alias("chars"), _pick(["12px", "16px", "24px"], key()).alias("size"), _pick(["1.5", "normal"], key()).alias("line_height"), F.lit("400").alias("weight"), _pick(["Inter", "Serif"], F.floor(key() / 3)).alias("family"), F.lit("0").alias("letter_spacing"))
    return measure.page_type(e)


def page_histogram(spark: SparkSession, d: str) -> DataFrame:
    e = _keys(spark, d).select("page", (key() % 37 / 2.0).alias("radius"), (key() % 90 - 10).cast("double").alias("gap"))
    return measure.page_histogram(e, {"radius": 16, "gap": 64})


def block_texts(spark: SparkSession, d: str) -> DataFrame:
    n = _keys(spark, d).select("page", F.floor(key() / 120).alias("block"), key().alias("pos"), F.concat(F.lit(" w"), (key() % 3).cast("string")).alias("text"))
    return measure.block_text(n, most=9).select("page", "block", "pos", F.col("t").alias("text"))


def accessibility(spark: SparkSession, d: str) -> DataFrame:
    e = _keys(spark, d).select("page", key().alias("pos"), _pick(["h1", "img", "h2", "p", "h4", "button", "input"], F.floor(key() / 40)).alias("tag"), _pick([None, "", "x"], F.floor(key() / 40)).alias("alt"), _pick(["", None, "button", "input"], F.floor(key() / 40)).alias("role"), _pick(["", None, "name"], F.floor(key() / 160)).alias("name"))
    return measure.accessibility(e)


def link_sets(spark: SparkSession, d: str) -> DataFrame:
    e = _keys(spark, d).select("page", F.lit("h0.example").alias("host"), F.concat(F.lit("h"), (F.floor(key() / 40) % 9).cast("string"), F.lit(".example")).alias("link_host"), F.concat(F.lit("/"), key().cast("string")).alias("path"))
    s = measure.link_sets(e, most_internal=5, most_hosts=4)
    return s.select("page", F.array_join("internal", ",").alias("internal"), F.array_join("external", ",").alias("external"))


def focus_shown(spark: SparkSession, d: str) -> DataFrame:
    style = lambda c, o, w: F.create_map(F.lit("color"), c, F.lit("outlineStyle"), o, F.lit("outlineWidth"), w)
    base = style(F.lit("red"), F.lit("none"), F.lit("0px"))
    v = measure.focus_visible(base, style(_pick(["red", "red", "blue"], key()), _pick(["none", "solid"], key()), _pick(["0px", "2px", "1px", "thick"], key())))
    return _keys(spark, d).groupBy("page").agg(F.count_if(v).alias("visible"))


def reveals(spark: SparkSession, d: str) -> DataFrame:
    e = _keys(spark, d).select("page", "k", (key() % 10 / 10.0).alias("opacity_before"), (key() % 7 / 6.0).alias("opacity_after"), (key() % 3 == 0).alias("shifted_before"), (key() % 4 == 0).alias("shifted_after"))
    return measure.reveals(e).groupBy("page").agg(F.count("*").alias("n"))


def _targets(spark: SparkSession, d: str) -> DataFrame:
    change = F.array(F.lit("a"), F.lit("b"))
    two = F.create_map(F.lit("color"), change, F.lit("inner opacity"), change)
    one = F.create_map(F.lit("inner color"), change)
    changes = F.when(key() % 3 == 0, two).when(key() % 3 == 1, one).otherwise(F.create_map().cast("map<string,array<string>>"))
    return _keys(spark, d).select("page", "k", changes.alias("changes"), F.concat((key() % 4 * 100).cast("string"), F.lit("ms, 0.1s")).alias("duration"))


def hover_summary(spark: SparkSession, d: str) -> DataFrame:
    return measure.hover_summary(_targets(spark, d))


def hover_properties(spark: SparkSession, d: str) -> DataFrame:
    return measure.hover_properties(_targets(spark, d))


def hover_durations(spark: SparkSession, d: str) -> DataFrame:
    return measure.hover_durations(_targets(spark, d))


def _stops(spark: SparkSession, d: str, m: int) -> DataFrame:
    label = F.when(key() < 40, _pick(["Skip to content", "Home"], key())).otherwise(F.concat(F.lit("stop "), key().cast("string")))
    return _keys(spark, d).select("page", key().alias("pos"), label.alias("label"), (F.floor(key() / 40) % m != 0).alias("visible"))


def focus_summary(spark: SparkSession, d: str) -> DataFrame:
    s = measure.focus_summary(_stops(spark, d, 3), most=4)
    return s.select("page", "visited", "visible", F.array_join("without", ",").alias("without"), "skip_link")


def focus_ratio(spark: SparkSession, d: str) -> DataFrame:
    r = measure.focus_ratio(measure.focus_summary(_stops(spark, d, 3)), measure.focus_summary(_stops(spark, d, 2)))
    return r.select("page", T.round_half_up(F.col("original"), 6).alias("original"), T.round_half_up(F.col("clone"), 6).alias("clone"), "loss")


def hover_targets(spark: SparkSession, d: str) -> DataFrame:
    """The first five targets of each page (a top-k choice)."""
    n = _keys(spark, d).select("page", key().alias("pos"), _pick(["link", "image", "link", "button"], F.floor(key() / 40)).alias("role"), (F.floor(key() / 40) % 70).alias("h"))
    return measure.hover_targets(n, 5).select("page", "pos", "role")


def first_changes(spark: SparkSession, d: str) -> DataFrame:
    changes = F.create_map(_pick(["color", "width"], F.floor(key() / 40)), F.concat(F.lit("c"), key().cast("string")))
    c = _keys(spark, d).where("k % 3 <> 0").select(F.col("page").alias("target"), key().alias("child"), changes.alias("changes"))
    return measure.first_changes(c)


def frame_times(spark: SparkSession, d: str) -> DataFrame:
    k = _keys(spark, d)
    f = k.select(key().alias("pos"), F.concat(F.lit("f"), key().cast("string"), F.lit(".png")).alias("file"))
    t = k.where("k % 4 <> 0").select(key().alias("pos"), (key() * 7 / 2.0).alias("seconds"))
    return measure.frame_times(f, t)


def canvas_votes(spark: SparkSession, d: str) -> DataFrame:
    p = _keys(spark, d).select("page", key().alias("pos"), F.when(F.col("page") != "p3", _pick(["#ffffff", None, "#fafafa", "#000000"], F.floor(key() / 40) % 7)).alias("canvas"))
    return tokens.canvas_vote(p, ["page"])


def color_usage(spark: SparkSession, d: str) -> DataFrame:
    """Opaque and half-transparent blues over white and black canvases."""
    hexed = F.when(key() % 2 == 0, F.concat(F.lit("#0000"), F.lpad(F.lower(F.hex(key() % 200)), 2, "0"))).otherwise(F.lit("#0000ff80"))
    c = _keys(spark, d).select("page", hexed.alias("hex"), F.when(key() % 40 < 20, "#ffffff").otherwise("#000000").alias("canvas"), *[(key() % (i + 3)).alias(n) for i, n in enumerate(tokens.COUNTERS)])
    return tokens.color_usage(c, ["page"])


def used_for(spark: SparkSession, d: str) -> DataFrame:
    t = _keys(spark, d).select("page", F.concat((key() % 3 + 12).cast("string"), F.lit("px")).alias("size"), F.create_map(_pick(["p", "a", "li", "td", "b"], F.floor(key() / 40) % 11), F.lit(1), F.lit("q"), (key() % 2).cast("int")).alias("tags"))
    return tokens.used_for(t, ["page"]).select("page", F.col("px").cast("long").alias("px"), F.array_join("used_for", ",").alias("used_for"))


def page_totals(spark: SparkSession, d: str) -> DataFrame:
    p = _keys(spark, d).select("page", key().alias("pos"), F.when(key() % 3 == 0, F.array(F.concat(F.lit("g"), (F.floor(key() / 40) % 5).cast("string")))).alias("gradients"), F.when(key() % 2 == 0, key() % 4).alias("animations"), F.when(key() >= 100, F.concat(F.lit("logo"), key().cast("string"))).alias("logo"))
    return tokens.page_totals(p, ["page"]).select("page", F.array_join("gradients", ",").alias("gradients"), "animations", "logo")


def widest_pages(spark: SparkSession, d: str) -> DataFrame:
    p = _keys(spark, d).select("page", "k", _pick(["390", "1440", "768"], F.floor(key() / 40)).cast("int").alias("width"))
    return tokens.widest(p, ["page"]).groupBy("page", "width").agg(F.count("*").alias("n"))


def review_ids(spark: SparkSession, d: str) -> DataFrame:
    """Reviews of which every third lacks an id and every fifth a text."""
    r = _keys(spark, d).select(F.when(key() % 3 == 0, "").otherwise(key().cast("string")).alias("id"), F.lit("u").alias("url"), F.when(key() % 5 == 0, "").otherwise("t").alias("text"), key().alias("pos"))
    return reviews.usable(r).select("id", "pos")


def ledger_records(spark: SparkSession, d: str) -> DataFrame:
    raw = _keys(spark, d).select(F.concat(F.lit(" "), key().cast("string"), F.lit("  ")).alias(" Id "), F.when(key() % 2 == 0, F.lit(" x ")).alias("NAME"), key().cast("int").alias("at"))
    return ledger.records(raw, "at").select("id", "name", F.col("__line").cast("long").alias("line"))


CELLS = ["plain", "a,b", 'say "x"', "", "two\nlines"]


def csv_lines(spark: SparkSession, d: str) -> DataFrame:
    r = _keys(spark, d).select("k", _pick(CELLS, key()).alias("a"), _pick([*CELLS, None], F.floor(key() / 5)).alias("b"))
    return r.select("k", files.csv_line(["k", "a", "b"]).alias("line"))


def csv_records(spark: SparkSession, d: str) -> DataFrame:
    """Every page's rows as one CSV text, read back."""
    r = _keys(spark, d).where("k < 400").select("k", "page", _pick(CELLS, F.floor(key() / 40)).alias("a"))
    line = F.struct("k", files.csv_line(["k", "a"]).alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\r\n")
    t = r.groupBy("page").agg(text.alias("t"))
    t.createOrReplaceTempView("corvane_csv_texts")
    spark.udtf.register("corvane_tolerant_csv", files.TolerantCsv)
    return spark.sql("SELECT page, CAST(pos AS BIGINT) AS pos, cells[0] AS k, cells[1] AS a, CAST(size(cells) AS BIGINT) AS n FROM corvane_csv_texts, LATERAL corvane_tolerant_csv(t)")


def json_leaves(spark: SparkSession, d: str) -> DataFrame:
    doc = F.to_json(F.struct(F.concat(F.lit("n"), key().cast("string")).alias("name"), F.array(F.lit("x"), key().cast("string")).alias("tags"), F.struct(key().alias("count"), F.lit("deep").alias("note")).alias("more")))
    _keys(spark, d).select("k", doc.alias("t")).createOrReplaceTempView("corvane_json_texts")
    spark.udtf.register("corvane_json_leaves", files.JsonLeaves)
    return spark.sql("SELECT k, key, value FROM corvane_json_texts, LATERAL corvane_json_leaves(t)")


def json_ld_types(spark: SparkSession, d: str) -> DataFrame:
    one = F.concat(F.lit('{"@graph": [{"@type": "A'), (key() % 5).cast("string"), F.lit('", "author": {"@type": ["Person", "A0"]}}]}'))
    _keys(spark, d).select("k", F.when(key() % 4 == 0, F.lit("{broken")).otherwise(one).alias("t")).createOrReplaceTempView("corvane_ld_texts")
    spark.udtf.register("corvane_ld_types", files.JsonLdTypes)
    return spark.sql("SELECT type, count(*) AS n FROM corvane_ld_texts, LATERAL corvane_ld_types(t) GROUP BY type")


def image_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Measurements of even keys and images of keys divisible by three, joined by stem."""
    k = _keys(spark, d)
    path = lambda ext: F.concat(F.lit("/m/"), key().cast("string"), F.lit(ext))
    return files.with_images(k.where("k % 2 = 0").select(path(".json").alias("path")).union(k.where("k % 3 = 0").select(path(".png").alias("path"))))


def binary_texts(spark: SparkSession, d: str) -> DataFrame:
    c = F.when(key() % 3 == 0, F.encode(F.concat(F.lit("a"), F.decode(F.unhex(F.lit("00")), "UTF-8")), "UTF-8")).otherwise(F.encode(key().cast("string"), "UTF-8"))
    return _keys(spark, d).groupBy("page").agg(F.count_if(files.is_binary(c)).alias("binary"))


def folder_files(spark: SparkSession, d: str) -> DataFrame:
    """The tables' own files, by an extension in another letter case."""
    return files.files_in(spark, d, [".PARQUET"]).select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"))


def review_feed(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as entries of an app's review feed."""
    c = table(spark, d, "conversations")
    label = lambda x: F.struct(x.cast("string").alias("label"))
    rating = F.when(F.col("turn") > 0, F.col("turn") % 5 + 1)
    entry = F.struct(label(F.concat_ws(".", "conv_id", "turn")).alias("id"), label(F.col("role")).alias("title"), label(F.col("text")).alias("content"), label(F.lit("2024-05-06T07:08:09Z")).alias("updated"), label(rating).alias("im:rating"))
    f = c.groupBy("conv_id").agg(F.collect_list(entry).alias("entry"))
    return feeds.review_rows(f.select(F.lit("77").alias("app_id"), F.lit("fr").alias("country"), F.struct("entry").alias("feed")))


def comment_feed(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as hits of a comment search; some have a title and a story only."""
    c = table(spark, d, "conversations")
    html = F.concat(F.lit("<p>"), F.col("text"), F.lit("</p>&#33;&amp;"))
    own = F.col("turn") % 2 == 0
    hit = F.struct(F.concat_ws("x", "conv_id", "turn").alias("objectID"), F.lit("2024-05-06T07").alias("created_at"), F.when(~own, F.col("role")).alias("title"), F.when(~own, F.lit("<i>s</i>")).alias("story_text"), F.when(own, html).alias("comment_text"))
    rows = feeds.comment_rows(c.groupBy("conv_id").agg(F.collect_list(hit).alias("hits")))
    return rows.select("id", "url", "date", "rating", F.length("text").cast("long").alias("n_chars"), F.endswith("text", F.lit("!&")).alias("decoded"))


def app_lookups(spark: SparkSession, d: str) -> DataFrame:
    """Parts as apps, nine a lookup, of which eight are taken (the limit of a lookup)."""
    p = table(spark, d, "part")
    app = F.struct(F.col("p_partkey").cast("string").alias("trackId"), F.col("p_name").alias("trackName"), F.col("p_brand").alias("artistName"), F.col("p_size").cast("string").alias("price"))
    g = p.groupBy(F.floor(F.col("p_partkey") / 9).alias("g")).agg(F.array_sort(F.collect_list(app)).alias("results"))
    ordered = F.transform(F.array_sort(F.transform("results", lambda r: F.struct(r["trackId"].cast("long").alias("at"), r.alias("r")))), lambda x: x["r"])
    return feeds.app_rows(g.select(F.to_json(F.struct(ordered.alias("results"))).alias("json"))).select("id", "name", "developer", "price", F.coalesce("currency", F.lit("")).alias("currency"))


SERVICES = [(["com", "net"], ["https://one.example/"]), (["org"], ["https://two.example/", "https://three.example/"]), (["io", "dev", "app"], ["https://four.example/"])]


def domain_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Names of customers as domains: the registry of the top level, and what its recorded answers say."""
    boot = spark.createDataFrame([([list(t), list(b)],) for t, b in SERVICES], "services array<array<string>>").groupBy().agg(F.collect_list("services").alias("services"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.col("c_name"), F.lit(".Co.UK ")).alias("s")).withColumn("label", U.domain_label(F.col("s"))).withColumn("tld", _pick(["com", "org", "dev", "zz"], key()))
    j = c.join(F.broadcast(feeds.registry_bases(boot)), "tld", "left")  # a few registries
    status = U.domain_status(_pick(["404", "200", "429", None], F.floor(key() / 4)).cast("int"), _pick(["3", "0", "2", "1", None], F.floor(key() / 16)).cast("int"), key() % 2)
    return j.select("k", "label", "tld", F.coalesce("base", F.lit("")).alias("base"), status.alias("status"))


def product_names(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    return p.select("page_id", U.name_of(F.col("url")).alias("name"), U.in_section(F.col("url"), "blog.tionsh.example.net", "/en/").alias("inside"))


def app_ids(spark: SparkSession, d: str) -> DataFrame:
    s = F.when(key() % 3 == 0, F.concat(F.lit(" "), (key() + 100_000).cast("string"))).when(key() % 3 == 1, F.concat(F.lit("https://apps.example/app/x/id"), key().cast("string"), F.lit("?l=en"))).otherwise(key().cast("string"))
    return _keys(spark, d).select("k", F.coalesce(U.app_id(s), F.lit("")).alias("app"))


def entities_decoded(spark: SparkSession, d: str) -> DataFrame:
    s = F.concat(F.lit("&#"), (key() % 500 + 200).cast("string"), F.lit(";&#x"), F.lower(F.hex(key() % 500 + 200)), F.lit("; &amp;lt; &nope; &COPY; &#1114112;"))
    return _keys(spark, d).select("k", H.decode_entities(s).alias("text"))


def texts_shortened(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents")
    md = F.concat(F.lit("# Title\n\n## Part "), F.col("doc_id").cast("string"), F.lit("\ntext\n### Deep"))
    return s.select("doc_id", T.truncate(F.col("source"), 4).alias("short"), T.demote_headings(md).alias("demoted"), T.markdown_visible(F.concat(F.lit("- see [the "), F.col("lang"), F.lit("](http://x) and `code` now"))).alias("seen"))


def half_up(spark: SparkSession, d: str) -> DataFrame:
    x = (key() - 5000) / 8.0
    return _keys(spark, d).select("k", T.round_half_up(x).alias("whole"), T.round_half_up(x, 2).alias("cents"))


_REVIEW_TEXT = "CASE WHEN title <> '' AND NOT starts_with(body, title) THEN title || '. ' || body ELSE body END"
_SQ = lambda c: rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"
_TARGETS = f"SELECT *, k % 3 AS m, greatest(k % 4 * 100.0::DOUBLE, 100.0) AS ms FROM ({_K})"
_E = {c: _sql_pick(v) for c, v in NAMES.items()}
_ROLE = {"input": None, "h1": "h1", "h4": "h4", "svg": "image", "ol": "list", "video": "video", "span": "", "iframe": "embed", "nav": "nav", "select": "input"}

QUERIES = {
    f.__name__: f
    for f in (
        visible_elements, node_roles, text_kinds, accessible_names, fill_colors, page_colors, page_type, page_histogram, block_texts, accessibility, link_sets,
        focus_shown, reveals, hover_summary, hover_properties, hover_durations, focus_summary, focus_ratio, hover_targets, first_changes, frame_times, canvas_votes,
        color_usage, used_for, page_totals, widest_pages, review_ids, ledger_records, csv_lines, csv_records, json_leaves, json_ld_types, image_pairs, binary_texts,
        folder_files, review_feed, comment_feed, app_lookups, domain_lookup, product_names, app_ids, entities_decoded, texts_shortened, half_up,
    )
}

ORACLES = {
    "visible_elements": f"""SELECT page, count(*) FILTER (WHERE k % 3 >= 1 AND k % 5 >= 1 AND k % 5 <> 1 AND k % 7 <> 6 AND k % 13 <> 0 AND k % 2000 - 300 + k % 3 >= 0 AND k % 2000 - 300 <= 1441)::BIGINT AS visible, count(*)::BIGINT AS n FROM ({_K}) GROUP BY 1""",
    "node_roles": f"""SELECT tag, CASE WHEN aria = 'banner' THEN 'header' WHEN aria = 'grid' THEN 'table' WHEN aria = 'SearchBox' THEN 'input'
        WHEN tag = 'input' THEN CASE WHEN lower(type) IN ('submit', 'image') THEN 'button' ELSE 'input' END WHEN tag = 'a' THEN CASE WHEN k % 2 = 0 THEN 'button' ELSE 'link' END
        {' '.join(f"WHEN tag = '{t}' THEN '{r}'" for t, r in _ROLE.items() if r is not None)} ELSE '' END AS role, count(*)::BIGINT AS n
        FROM (SELECT k, {_sql_pick(TAGS)} AS tag, {_sql_pick(ARIA)} AS aria, {_sql_pick(TYPES)} AS type FROM ({_K})) GROUP BY ALL""",
    "text_kinds": f"""SELECT role, CASE WHEN role IN ('h1', 'h4') THEN 'heading' WHEN role = 'button' THEN 'button' WHEN k % 3 = 0 THEN 'nav' WHEN k % 4 = 0 THEN 'footer' ELSE 'text' END AS kind, count(*)::BIGINT AS n FROM (SELECT k, {_sql_pick(KINDS)} AS role FROM ({_K})) GROUP BY ALL""",
    "accessible_names": f"""SELECT {_SQ('coalesce(' + ', '.join(f"nullif({x}, '')" for x in _E.values()) + ')')} AS name, count(*)::BIGINT AS n FROM ({_K}) GROUP BY 1""",
    "fill_colors": f"""SELECT CASE WHEN b = '#fff' THEN b WHEN i = 1 THEN 'rgb(1, 2, 3)' WHEN i = 3 THEN '#00ff7f' ELSE 'none' END AS fill, count(*)::BIGINT AS n FROM (SELECT {_sql_pick(BACKS)} AS b, (k // 5) % 5 AS i FROM ({_K})) GROUP BY 1""",
    "page_colors": f"""WITH u AS (SELECT page, '#00000' || (k % 7) AS hex, k % 50 AS t, 0 AS b, 0 AS o, 0 AS i, 0 AS a, 0 AS l FROM ({_K})
        {' '.join(f"UNION ALL SELECT page, '#00000' || (k % 9), 0, {v[0]}, {v[1]}, {v[2]}, {v[3]}, {v[4]} FROM ({_K}) WHERE k % {m} = 0" for m, v in {2: ("greatest(1, floor((k % 100) * (k % 60) / 1000 + 0.5))", 0, 0, 0, 0), 3: (0, 1, 0, 0, 0), 5: (0, 0, 1, 0, 0), 7: (0, 0, 0, 1, 0), 11: (0, 0, 0, 0, 1)}.items())})
        SELECT page, hex, sum(t)::BIGINT AS text, sum(b)::BIGINT AS bg, sum(o)::BIGINT AS border, sum(i)::BIGINT AS icon, sum(a)::BIGINT AS action, sum(l)::BIGINT AS label FROM u GROUP BY ALL""",
    "page_type": f"""SELECT page, {_sql_pick(['12px', '16px', '24px'])} AS size, {_sql_pick(['1.5', 'normal'])} AS line_height, '400' AS weight, {_sql_pick(['Inter', 'Serif'], '(k // 3)')} AS family, '0' AS letter_spacing, count(*)::BIGINT AS count, sum(k % 5)::BIGINT AS chars FROM ({_K}) WHERE k % 5 > 0 GROUP BY ALL""",
    "page_histogram": f"""SELECT page, 'radius' AS property, floor((k % 37) / 2.0 + 0.5)::INTEGER AS value, count(*)::BIGINT AS count FROM ({_K}) WHERE floor((k % 37) / 2.0 + 0.5) BETWEEN 1 AND 16 GROUP BY ALL
        UNION ALL SELECT page, 'gap', (k % 90 - 10)::INTEGER, count(*)::BIGINT FROM ({_K}) WHERE k % 90 - 10 BETWEEN 1 AND 64 GROUP BY ALL""",
    "block_texts": f"""SELECT page, block, pos, t AS text FROM (SELECT page, k // 120 AS block, min(k) AS pos, left(string_agg('w' || (k % 3), ' ' ORDER BY k), 9) AS t FROM ({_K}) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY page, t ORDER BY pos) = 1""",
    "accessibility": f"""WITH e AS (SELECT page, k, {_sql_pick(["h1", "img", "h2", "p", "h4", "button", "input"], "(k // 40)")} AS tag, {_sql_pick([None, "", "x"], "(k // 40)")} AS alt, {_sql_pick(["", None, "button", "input"], "(k // 40)")} AS role, coalesce({_sql_pick(["", None, "name"], "(k // 160)")}, '') AS name FROM ({_K})),
        s AS (SELECT page, count(*) FILTER (WHERE l - b > 1) AS skips FROM (SELECT page, substr(tag, 2, 1)::INTEGER AS l, lag(substr(tag, 2, 1)::INTEGER) OVER (PARTITION BY page ORDER BY k) AS b FROM e WHERE tag IN ('h1', 'h2', 'h4')) GROUP BY 1)
        SELECT e.page, count(*) FILTER (WHERE tag = 'h1')::BIGINT AS h1, count(*) FILTER (WHERE tag = 'img' AND alt IS NULL)::BIGINT AS images_without_alt, count(*) FILTER (WHERE role = 'button' AND name = '')::BIGINT AS buttons_without_name,
        count(*) FILTER (WHERE role = 'input' AND name = '')::BIGINT AS inputs_without_label, coalesce(any_value(skips), 0)::BIGINT AS heading_skips FROM e LEFT JOIN s USING (page) GROUP BY 1""",
    "link_sets": f"""SELECT page, array_to_string(list_slice(list_sort(coalesce(list('/' || k) FILTER (WHERE (k // 40) % 9 = 0), [])), 1, 5), ',') AS internal,
        array_to_string(list_slice(list_sort(coalesce(list(DISTINCT 'h' || ((k // 40) % 9) || '.example') FILTER (WHERE (k // 40) % 9 <> 0), [])), 1, 4), ',') AS external FROM ({_K}) GROUP BY 1""",
    "focus_shown": f"SELECT page, count(*) FILTER (WHERE k % 3 = 2 OR (k % 2 = 1 AND k % 4 = 1))::BIGINT AS visible FROM ({_K}) GROUP BY 1",
    "reveals": f"SELECT page, count(*)::BIGINT AS n FROM ({_K}) WHERE (k % 10 < 5 AND k % 7 = 6) OR (k % 3 = 0 AND k % 4 <> 0) GROUP BY 1",
    "hover_summary": f"SELECT page, count(*)::BIGINT AS checked, count(*) FILTER (WHERE k % 3 < 2)::BIGINT AS changed FROM ({_K}) GROUP BY 1",
    "hover_properties": f"SELECT page, property, count(*)::BIGINT AS n FROM (SELECT page, unnest(CASE k % 3 WHEN 0 THEN ['color', 'opacity'] WHEN 1 THEN ['color'] ELSE [] END) AS property FROM ({_K})) GROUP BY ALL",
    "hover_durations": f"SELECT page, ms::INTEGER AS ms, count(*)::BIGINT AS n FROM ({_TARGETS}) WHERE m < 2 GROUP BY ALL",
    "focus_summary": f"""SELECT page, count(*)::BIGINT AS visited, count(*) FILTER (WHERE (k // 40) % 3 <> 0)::BIGINT AS visible, array_to_string(list_slice(list(label ORDER BY k) FILTER (WHERE (k // 40) % 3 = 0), 1, 4), ',') AS without, arg_min(label, k) = 'Skip to content' AS skip_link
        FROM (SELECT *, CASE WHEN k < 40 THEN {_sql_pick(["Skip to content", "Home"])} ELSE 'stop ' || k END AS label FROM ({_K})) GROUP BY 1""",
    "focus_ratio": f"""SELECT page, floor(a * 1000000.0 + 0.5) / 1000000.0 AS original, floor(b * 1000000.0 + 0.5) / 1000000.0 AS clone, b < a AS loss FROM (SELECT page, count(*) FILTER (WHERE (k // 40) % 3 <> 0) / count(*) AS a, count(*) FILTER (WHERE (k // 40) % 2 <> 0) / count(*) AS b FROM ({_K}) GROUP BY 1)""",
    "hover_targets": f"""SELECT page, k AS pos, role FROM (SELECT page, k, {_sql_pick(["link", "image", "link", "button"], "(k // 40)")} AS role, (k // 40) % 70 AS h FROM ({_K})) QUALIFY row_number() OVER (PARTITION BY page ORDER BY CASE WHEN role = 'button' THEN 0 WHEN role = 'link' AND h >= 40 THEN 1 ELSE 2 END, k) <= 5""",
    "first_changes": f"""SELECT page AS target, {_sql_pick(["color", "width"], "(k // 40)")} AS property, 'c' || min(k) AS change, min(k) AS child FROM ({_K}) WHERE k % 3 <> 0 GROUP BY ALL""",
    "frame_times": f"""SELECT k AS pos, 'f' || k || '.png' AS file, CASE WHEN k % 4 <> 0 THEN k * 7 / 2.0::DOUBLE END AS seconds, CASE WHEN k % 4 <> 0 THEN printf('%d:%02d', (k * 7 // 120)::BIGINT, ((k * 7 // 2) % 60)::BIGINT) END AS clock FROM ({_K})""",
    "canvas_votes": f"""WITH v AS (SELECT page, k, CASE WHEN page <> 'p3' THEN {_sql_pick(["#ffffff", None, "#fafafa", "#000000"], "((k // 40) % 7)")} END AS canvas FROM ({_K})), g AS (SELECT page, canvas, count(*) AS n, min(k) AS f FROM v WHERE canvas IS NOT NULL GROUP BY ALL)
        SELECT p.page, coalesce(b.canvas, '#ffffff') AS canvas FROM (SELECT DISTINCT page FROM v) p LEFT JOIN (SELECT page, arg_max(canvas, (n, -f)) AS canvas FROM g GROUP BY 1) b USING (page)""",
    "color_usage": f"""SELECT page, canvas, hex, {', '.join(f'sum({c})::BIGINT AS {c}' for c in tokens.COUNTERS)} FROM (SELECT page, CASE WHEN k % 40 < 20 THEN '#ffffff' ELSE '#000000' END AS canvas,
        CASE WHEN k % 2 = 0 THEN printf('#0000%02x', k % 200) WHEN k % 40 < 20 THEN '#7f7fff' ELSE '#000080' END AS hex, {', '.join(f'k % {i + 3} AS {c}' for i, c in enumerate(tokens.COUNTERS))} FROM ({_K})) GROUP BY ALL""",
    "used_for": f"""WITH t AS (SELECT page, k % 3 + 12 AS px, unnest([{{'tag': {_sql_pick(["p", "a", "li", "td", "b"], "((k // 40) % 11)")}, 'n': 1}}, {{'tag': 'q', 'n': (k % 2)::INTEGER}}]) AS x FROM ({_K})), g AS (SELECT page, px, x.tag AS tag, sum(x.n) AS n FROM t GROUP BY ALL)
        SELECT page, px, array_to_string(list_slice(list(tag ORDER BY n DESC, tag), 1, 3), ',') AS used_for FROM g GROUP BY ALL""",
    "page_totals": f"""SELECT page, array_to_string(list_sort(coalesce(list(DISTINCT 'g' || ((k // 40) % 5)) FILTER (WHERE k % 3 = 0), [])), ',') AS gradients, sum(CASE WHEN k % 2 = 0 THEN k % 4 ELSE 0 END)::BIGINT AS animations, 'logo' || min(k) FILTER (WHERE k >= 100) AS logo FROM ({_K}) GROUP BY 1""",
    "widest_pages": f"""SELECT page, width::INTEGER AS width, count(*)::BIGINT AS n FROM (SELECT page, {_sql_pick(["390", "1440", "768"], "(k // 40)")}::INTEGER AS width FROM ({_K})) GROUP BY ALL HAVING width = 1440""",
    "review_ids": f"SELECT CASE WHEN k % 3 = 0 THEN 'row-' || (k + 2) ELSE k::VARCHAR END AS id, k AS pos FROM ({_K}) WHERE k % 5 <> 0",
    "ledger_records": f"SELECT k::VARCHAR AS id, CASE WHEN k % 2 = 0 THEN 'x' ELSE '' END AS name, k + 2 AS line FROM ({_K})",
    "csv_lines": f"""SELECT k, k || ',' || {_sql_pick(['plain', '"a,b"', '"say ""x"""', '', chr(34) + 'two' + chr(10) + 'lines' + chr(34)])} || ',' || {_sql_pick(['plain', '"a,b"', '"say ""x"""', '', chr(34) + 'two' + chr(10) + 'lines' + chr(34), ''], "(k // 5)")} AS line FROM ({_K})""",
    "csv_records": f"SELECT page, row_number() OVER (PARTITION BY page ORDER BY k) - 1 AS pos, k::VARCHAR AS k, {_sql_pick(CELLS, '(k // 40)')} AS a, 2::BIGINT AS n FROM ({_K}) WHERE k < 400",
    "json_leaves": f"SELECT k, unnest(['name', 'tags[0]', 'tags[1]', 'more.note']) AS key, unnest(['n' || k, 'x', k::VARCHAR, 'deep']) AS value FROM ({_K})",
    "json_ld_types": f"SELECT type, count(*)::BIGINT AS n FROM (SELECT unnest(list_distinct(['A' || (k % 5), 'Person', 'A0'])) AS type FROM ({_K}) WHERE k % 4 <> 0) GROUP BY 1",
    "image_pairs": f"SELECT '/m/' || k AS stem, '/m/' || k || '.json' AS json, '/m/' || k || '.png' AS png FROM ({_K}) WHERE k % 6 = 0",
    "binary_texts": f"""SELECT page, count(*) FILTER (WHERE k % 3 = 0)::BIGINT AS "binary" FROM ({_K}) GROUP BY 1""",
    "folder_files": "SELECT t || '.parquet' AS file FROM (SELECT unnest(['region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations']) AS t)",
    "review_feed": f"""SELECT 'as-fr-' || conv_id || '.' || turn AS id, 'app-store' AS source, 'https://apps.apple.com/fr/app/id77?see-all=reviews' AS url, '2024-05-06' AS date, (turn % 5 + 1)::VARCHAR AS rating, {_REVIEW_TEXT} AS text
        FROM (SELECT *, {_SQ('role')} AS title, {_SQ('text')} AS body FROM conversations WHERE turn > 0)""",
    "comment_feed": f"""SELECT 'hn-' || conv_id || 'x' || turn AS id, 'https://news.ycombinator.com/item?id=' || conv_id || 'x' || turn AS url, '2024-05-06' AS date, '' AS rating, length({_SQ("text")})::BIGINT + 3 AS n_chars, true AS decoded
        FROM conversations WHERE turn % 2 = 0 AND length({_SQ("text")}) + 3 >= 20""",
    "app_lookups": """SELECT p_partkey::VARCHAR AS id, p_name AS name, p_brand AS developer, p_size::VARCHAR AS price, '' AS currency FROM part QUALIFY row_number() OVER (PARTITION BY p_partkey // 9 ORDER BY p_partkey) <= 8""",
    "domain_lookup": f"""SELECT k, label, tld, CASE tld WHEN 'com' THEN 'https://one.example/' WHEN 'org' THEN 'https://two.example/' WHEN 'dev' THEN 'https://four.example/' ELSE '' END AS base,
        CASE WHEN r = '404' THEN 'free' WHEN r = '200' THEN 'taken' WHEN n = '3' THEN 'free' WHEN n = '0' AND k % 2 > 0 THEN 'taken' WHEN n = '2' THEN 'taken' ELSE 'unknown' END AS status
        FROM (SELECT c_custkey AS k, regexp_replace(lower(c_name), '[^a-z0-9-]', '', 'g') AS label, {_sql_pick(["com", "org", "dev", "zz"], "c_custkey")} AS tld, {_sql_pick(["404", "200", "429", None], "(c_custkey // 4)")} AS r, {_sql_pick(["3", "0", "2", "1", None], "(c_custkey // 16)")} AS n FROM customer)""",
    "product_names": r"""SELECT page_id, upper(left(l, 1)) || substr(l, 2) AS name, h = 'blog.tionsh.example.net' AND (p = '/en' OR starts_with(p, '/en/')) AND NOT regexp_matches(p, '\.(png|jpe?g|gif|webp|avif|svg|ico|css|js|mjs|json|xml|pdf|zip|mp4|webm|mp3|woff2?|ttf)(\?|$)', 'i') AS inside
        FROM (SELECT page_id, string_split(regexp_replace(lower(h), '^(?:www|app|help|docs)\.', ''), '.')[1] AS l, h, p FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS h, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS p FROM pages))""",
    "app_ids": f"SELECT k, CASE k % 3 WHEN 0 THEN (k + 100000)::VARCHAR WHEN 1 THEN k::VARCHAR ELSE CASE WHEN k >= 100000 THEN k::VARCHAR ELSE '' END END AS app FROM ({_K})",
    "entities_decoded": f"SELECT k, chr((k % 500 + 200)::INTEGER) || chr((k % 500 + 200)::INTEGER) || ' &lt; &nope; (c) &#1114112;' AS text FROM ({_K})",
    "texts_shortened": "SELECT doc_id, CASE WHEN length(source) > 4 THEN left(source, 3) || '…' ELSE source END AS short, '### Part ' || doc_id || chr(10) || 'text' || chr(10) || '#### Deep' AS demoted, 'see the ' || lang || ' and   now' AS seen FROM documents",
    "half_up": f"SELECT k, floor((k - 5000) / 8.0 + 0.5)::DOUBLE AS whole, floor((k - 5000) / 8.0 * 100 + 0.5)::DOUBLE / 100 AS cents FROM ({_K})",
}
