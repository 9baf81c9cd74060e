"""Design-system, colour, structure, ledger and window queries over the driver's tables used as analogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import color as C
from corvane.functions.text import round_half_up
from corvane.functions.urls import longest_ms, path_hash
from corvane.operators import designs, ledger, measure, migrate, structure, sweep, tokens
from corvane.plans.common import sql_round, table
from corvane.streaming import ledger as streams


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.col("p_brand").alias("page"), (F.col("p_size") * 2).alias("value"), F.lit(1).cast("long").alias("count"))


def spacing_base(spark: SparkSession, d: str) -> DataFrame:
    return tokens.spacing_base(_sizes(spark, d), ["page"]).select("page", F.col("base").cast("long").alias("base"), round_half_up(F.col("share"), 6).alias("share"))


def spacing_scale(spark: SparkSession, d: str) -> DataFrame:
    return tokens.spacing_scale(_sizes(spark, d), ["page"], 0.02).select("page", F.array_join(F.transform("scale", lambda x: x.cast("string")), ",").alias("scale"))


def value_counts(spark: SparkSession, d: str) -> DataFrame:
    """The six most frequent values of each page (a top-k summary)."""
    return tokens.value_counts(_sizes(spark, d), ["page"], top=6).select("page", F.col("value").cast("long").alias("value"), "count", F.col("rank").cast("long").alias("rank"))


def font_shares(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.substring("p_brand", 1, 7).alias("page"), F.col("p_type").alias("family"), F.col("p_size").cast("long").alias("chars"), F.create_map(F.col("p_brand"), F.lit(1)).alias("weights"))
    return tokens.font_shares(p, ["page"]).select("page", "family", "chars", "share", F.array_join("weights", "/").alias("weights"))


def type_scale(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    t = li.select(F.col("l_returnflag").alias("page"), F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("px")).alias("size"), F.col("l_linestatus").alias("lineHeight"), F.col("l_linenumber").cast("string").alias("weight"), F.substring(F.col("l_suppkey").cast("string"), 1, 1).alias("family"), F.lit(1).cast("long").alias("chars"))
    s = tokens.type_scale(t, ["page"])
    return s.select("page", F.col("px").cast("long").alias("px"), "chars", "lineHeight", "weight", "family", F.col("body").cast("long").alias("body"), "share")


def type_ratio(spark: SparkSession, d: str) -> DataFrame:
    s = type_scale(spark, d)
    return tokens.mean_ratio(s, ["page"])


def _hex(k):
    """A deterministic colour of a key."""
    part = lambda m: F.lower(F.lpad(F.hex(F.pmod(k * m, F.lit(256)).cast("long")), 2, "0"))
    return F.concat(F.lit("#"), part(37), part(91), part(151))


def color_metrics(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", _hex(F.col("p_partkey")).alias("hex")).withColumn("c", C.parse_hex(F.col("hex"))).withColumn("lab", C.oklab(F.col("c")))
    white = C.parse_hex(F.lit("#ffffff"))
    r = lambda x: round_half_up(x, 6)
    return p.select("p_partkey", "hex", r(F.col("lab.l")).alias("l"), r(C.chroma(F.col("lab"))).alias("chroma"), r(C.hue(F.col("lab"))).alias("hue"), r(C.contrast(F.col("c"), white)).alias("contrast"))


BRAND = ["#006bff", "#ff5a1f", "#0a8f4d", "#7c3aed"]


def nearest_brand(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("color_id")).repartition("color_id")  # one file is one task's work otherwise
    p = p.select("color_id", C.oklab(C.parse_hex(_hex(F.col("color_id")))).alias("lab"))
    b = spark.createDataFrame([(x,) for x in BRAND], "color string").withColumn("lab", C.oklab(C.parse_hex(F.col("color"))))
    return designs.nearest_brand(p, b).select("color_id", "nearest", round_half_up(F.col("distance"), 4).alias("distance"))


def color_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Greedy clusters of each brand's colours, in order of weight."""
    p = table(spark, d, "part").select(F.col("p_brand").alias("page"), _hex(F.col("p_partkey")).alias("hex"), F.lit("#ffffff").alias("canvas"), *[(F.pmod(F.col("p_partkey"), F.lit(i + 2))).cast("long").alias(c) for i, c in enumerate(tokens.COUNTERS)])
    return tokens.cluster_colors(tokens.color_usage(p, ["page"]), ["page"])


def color_roles(spark: SparkSession, d: str) -> DataFrame:
    c = color_clusters(spark, d).withColumn("canvas", F.lit("#ffffff"))
    r = tokens.color_roles(c, ["page"])
    return r.select("page", "ink", "ink_soft", "surface", "accent", "on_accent", "border", F.array_join("brand", ",").alias("brand"))


def path_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints of drawing paths made from prices; formatting and the second decimal do not matter."""
    o = table(spark, d, "orders")
    path = F.concat(F.lit("M"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit(" L "), (F.col("o_orderkey") % 100).cast("string"), F.lit(",0z"))
    return o.select("o_orderkey", path_hash(path).alias("hash"))


def name_hits(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents that hold a name from a small list as a run of words."""
    avoid = sweep.names(spark.createDataFrame([("TheAnd",), ("of-the",), ("Licensed under",)], "name string"))
    rows = sweep.lines(table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content")))
    return sweep.name_hits(rows, avoid).groupBy("detail").agg(F.count("*").alias("n"), F.countDistinct("path").alias("files"))


def domain_hits(spark: SparkSession, d: str) -> DataFrame:
    avoid = sweep.domains(spark.createDataFrame([("mail1.example.com",), ("https://www.MAIL2.example.com/x",)], "domain string"))
    rows = sweep.lines(table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content")))
    return sweep.domain_hits(rows, avoid).select(F.col("path").alias("doc_id"), F.col("line").cast("long").alias("line"), "detail")


def _views_and_purchases(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Views as new rows, purchases as the ledger, both keyed by user and day."""
    e = table(spark, d, "events").withColumn("key", F.concat_ws("@", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")))
    e = e.select("event_id", "key", "event_type")
    return e.where("event_type = 'view'"), e.where("event_type = 'purchase'")


def ledger_append(spark: SparkSession, d: str) -> DataFrame:
    """Views on days without a purchase: the anti join of an append."""
    return ledger.append(*_views_and_purchases(spark, d), "key")


def ledger_counts(spark: SparkSession, d: str) -> DataFrame:
    return ledger.appended(*_views_and_purchases(spark, d), "key")


def ledger_union(spark: SparkSession, d: str) -> DataFrame:
    """Documents and conversations as one review ledger."""
    a = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source"), F.col("lang").alias("rating"))
    b = table(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.col("role").alias("source"), F.col("text"))
    return ledger.union_sources([a, b]).groupBy("source", "rating").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    w = streams.tumbling(e, "1 hour")
    return w.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", round_half_up(F.col("total"), 2).alias("total"))


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = streams.sessions(table(spark, d, "events"), "30 minutes")
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


def duration_lists(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("ms, 0."), F.col("l_linenumber").cast("string"), F.lit("s")).alias("t"))
    return li.select("l_orderkey", "l_linenumber", longest_ms(F.col("t")).alias("ms"))


def breakpoints(spark: SparkSession, d: str) -> DataFrame:
    css = table(spark, d, "part").select(F.col("p_brand").alias("page"), F.concat(F.lit("@media (min-width: "), F.col("p_size").cast("string"), F.lit("em) and (max-width:"), (F.col("p_size") * 50).cast("string"), F.lit("px){}")).alias("css"))
    return measure.breakpoints(css).select("page", F.col("value").cast("long").alias("value"), "count")


def heading_skips(spark: SparkSession, d: str) -> DataFrame:
    """Line numbers as heading levels in the order of suppliers."""
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_suppkey").alias("pos"), F.concat(F.lit("h"), F.col("l_linenumber").cast("string")).alias("tag"))
    e = e.groupBy("page", "pos").agg(F.min("tag").alias("tag"))
    return measure.heading_skips(e).select("page", "pos", F.col("level").cast("long").alias("level"), F.col("before").cast("long").alias("before"))


def style_changes(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    before = F.create_map(F.lit("color"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"))
    after = F.create_map(F.lit("color"), F.lit("Brand#11"), F.lit("size"), F.lit("10"))
    return p.select("p_partkey", F.array_join(F.array_sort(F.map_keys(measure.style_change(before, after))), ",").alias("changed"))


def structure_self(spark: SparkSession, d: str) -> DataFrame:
    """A page for each supplier, its lines as nodes, against itself less the returned lines: score, order, missing nodes."""
    names = F.array(*[F.lit(r) for r in ("header", "nav", "h1", "button", "link", "image", "footer")])
    place = F.row_number().over(Window.partitionBy("pair_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate"))
    li = table(spark, d, "lineitem").withColumn("pair_id", F.col("l_suppkey").cast("string"))
    # sides are exploded, since a union would lose the partitioning by pair
    sides = F.explode(F.when(F.col("l_returnflag") != "R", F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))))
    nodes = li.withColumn("n", place.cast("long")).select(
        "pair_id", F.element_at(names, F.col("l_linenumber")).alias("role"), F.lit(0).alias("x"), (F.col("n") * 20).alias("y"),
        F.lit(200).alias("w"), F.lit(40).alias("h"), F.col("l_partkey").cast("string").alias("name"), F.col("n").alias("pos"), sides.alias("side"),
    )
    size = li.groupBy("pair_id").agg((F.count("*") * 20 + 40).alias("page_h"))  # below the last node
    pages = size.withColumn("side", F.explode(F.array(F.lit("a"), F.lit("b")))).selectExpr("*", "1440 AS view_w", "900 AS view_h")
    matched = structure.match_nodes(nodes, pages).persist()
    roles = structure.by_role(nodes, matched)
    lost = structure.unmatched(nodes, matched, pages, "a").groupBy("pair_id").agg(F.count("*").alias("missing"))
    out = structure.structure_score(roles).join(structure.order_score(nodes), "pair_id").join(lost, "pair_id", "left")
    return out.select("pair_id", "score", "order_score", F.coalesce("missing", F.lit(0)).alias("missing"))


def crawl_totals(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    state = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "blocked").otherwise("ok")
    return migrate.crawl_totals(e.select(state.alias("state"), F.lit(50).alias("words")))


def position_labels(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    x, y, w = F.col("l_partkey") % 1440, F.col("l_suppkey") * 20, F.col("l_quantity") * 20
    label = structure.position_label(x, y, w, F.lit(1440), F.lit(900), F.lit(4000))
    return li.select(label.alias("where")).groupBy("where").agg(F.count("*").alias("n"))


_RGB = "SELECT p_partkey, (p_partkey * 37) % 256 AS r, (p_partkey * 91) % 256 AS g, (p_partkey * 151) % 256 AS b FROM part"


def _sql_lin(c: str) -> str:
    return f"(CASE WHEN {c} / 255.0::DOUBLE <= 0.04045 THEN {c} / 255.0::DOUBLE / 12.92 ELSE pow(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END)"


def _sql_lab(src: str) -> str:
    cone = ", ".join(f"cbrt({m[0]} * lr + {m[1]} * lg + {m[2]} * lb) AS {n}" for m, n in zip(C.TO_CONE, ("q1", "q2", "q3"), strict=True))
    lab = ", ".join(f"({m[0]}) * q1 + ({m[1]}) * q2 + ({m[2]}) * q3 AS {n}" for m, n in zip(C.TO_LAB, ("l_", "a_", "b_"), strict=True))
    lin = ", ".join(f"{_sql_lin(c)} AS l{c}" for c in "rgb")
    return f"SELECT *, {lab} FROM (SELECT *, {cone} FROM (SELECT *, {lin} FROM ({src})))"


def _clusters() -> str:
    """Greedy clusters, one colour after the other: a list of clusters a page is carried from rank to rank."""
    c = tokens.COUNTERS
    struct = lambda src: "{" + ", ".join(f"'{n}': {src}{n}" for n in ("hex", "l_", "a_", "b_", *c)) + "}"
    added = "{" + ", ".join([*(f"'{n}': o.{n}" for n in ("hex", "l_", "a_", "b_")), *(f"'{n}': o.{n} + r.{n}" for n in c)]) + "}"
    rgb = f"SELECT p_brand AS page, {', '.join(f'p_partkey % {i + 2} AS {n}' for i, n in enumerate(c))}, (p_partkey * 37) % 256 AS r, (p_partkey * 91) % 256 AS g, (p_partkey * 151) % 256 AS b FROM part"
    weight = " + ".join(f"{n} * {w}" for n, w in tokens.COLOR_WEIGHT.items())
    return f"""WITH RECURSIVE u AS (SELECT page, printf('#%02x%02x%02x', r, g, b) AS hex, any_value(l_) AS l_, any_value(a_) AS a_, any_value(b_) AS b_, {', '.join(f'sum({n})::BIGINT AS {n}' for n in c)} FROM ({_sql_lab(rgb)}) GROUP BY page, hex),
        r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY {weight} DESC, hex) AS i FROM u),
        s(page, i, cl) AS (SELECT page, i, [{struct('')}] FROM r WHERE i = 1 UNION ALL
          SELECT page, i, CASE WHEN p IS NULL OR p = 0 THEN list_append(cl, {struct('r.')}) ELSE list_transform(cl, lambda o, k: CASE WHEN k = p THEN {added} ELSE o END) END
          FROM (SELECT r.page, r.i, s.cl, r, list_position(list_transform(s.cl, lambda o: sqrt((o.l_ - r.l_) ** 2 + (o.a_ - r.a_) ** 2 + (o.b_ - r.b_) ** 2) * 100 < {tokens.CLUSTER_DISTANCE}), true) AS p FROM s JOIN r ON r.page = s.page AND r.i = s.i + 1)),
        f AS (SELECT page, arg_max(cl, i) AS cl FROM s GROUP BY 1)
        SELECT page, x.hex AS hex, {', '.join(f'x.{n} AS {n}' for n in c)}, k::INTEGER AS rank FROM (SELECT page, unnest(cl) AS x, unnest(range(1, len(cl) + 1)) AS k FROM f)"""


_BRAND = "SELECT * FROM (VALUES " + ", ".join(f"('{x}', {int(x[1:3], 16)}, {int(x[3:5], 16)}, {int(x[5:7], 16)})" for x in BRAND) + ") t(color, r, g, b)"
_SIZES = "SELECT p_brand AS page, p_size * 2 AS value FROM part"
_TYPE = "SELECT l_returnflag AS page, l_quantity::INTEGER AS px, l_linestatus AS lh, l_linenumber::VARCHAR AS weight, substr(l_suppkey::VARCHAR, 1, 1) AS family FROM lineitem"
_SCALE = f"""WITH t AS ({_TYPE}), g AS (SELECT page, px, count(*)::BIGINT AS chars FROM t GROUP BY ALL),
  a AS (SELECT page, px, arg_max(lh, (n, lh)) AS lh FROM (SELECT page, px, lh, count(*) AS n FROM t GROUP BY ALL) GROUP BY ALL),
  b AS (SELECT page, px, arg_max(weight, (n, weight)) AS weight FROM (SELECT page, px, weight, count(*) AS n FROM t GROUP BY ALL) GROUP BY ALL),
  c AS (SELECT page, px, arg_max(family, (n, family)) AS family FROM (SELECT page, px, family, count(*) AS n FROM t GROUP BY ALL) GROUP BY ALL),
  s AS (SELECT *, chars / sum(chars) OVER (PARTITION BY page) AS part, first_value(px) OVER (PARTITION BY page ORDER BY chars DESC, px) AS body FROM g JOIN a USING (page, px) JOIN b USING (page, px) JOIN c USING (page, px))
  SELECT page, px::BIGINT AS px, chars, lh AS "lineHeight", weight, family, body::BIGINT AS body, floor(part * 1000 + 0.5) / 10 AS share FROM s WHERE part >= 0.004"""
_WORDS = r"list_filter(string_split_regex(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '([a-z\d])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '([A-Za-z])(\d)', '\1 \2', 'g'), '(\d)([A-Za-z])', '\1 \2', 'g')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_LINES = "SELECT doc_id, unnest(range(1, len(l) + 1)) AS n, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"
_KEYED = "SELECT event_id, user_id || '@' || strftime(ts, '%Y-%m-%d') AS key, event_type FROM events"
_NEW = f"SELECT * FROM ({_KEYED}) WHERE event_type = 'view'"
_OLD = f"SELECT key FROM ({_KEYED}) WHERE event_type = 'purchase'"

QUERIES = {
    "spacing_base": spacing_base, "spacing_scale": spacing_scale, "value_counts": value_counts, "font_shares": font_shares, "type_scale": type_scale,
    "type_ratio": type_ratio, "color_metrics": color_metrics, "nearest_brand": nearest_brand, "color_clusters": color_clusters, "color_roles": color_roles,
    "path_hashes": path_hashes, "name_hits": name_hits, "domain_hits": domain_hits, "ledger_append": ledger_append, "ledger_counts": ledger_counts,
    "ledger_union": ledger_union, "event_windows": event_windows, "event_sessions": event_sessions, "duration_lists": duration_lists, "breakpoints": breakpoints,
    "heading_skips": heading_skips, "style_changes": style_changes, "crawl_totals": crawl_totals, "position_labels": position_labels,
}

ORACLES = {
    "spacing_base": f"""SELECT page, CASE WHEN s8 >= 0.7 THEN 8 WHEN s4 >= 0.7 THEN 4 WHEN s2 >= 0.7 THEN 2 ELSE 1 END::BIGINT AS base, {sql_round('CASE WHEN s8 >= 0.7 THEN s8 WHEN s4 >= 0.7 THEN s4 WHEN s2 >= 0.7 THEN s2 ELSE 1.0 END', 6)} AS share
        FROM (SELECT page, count(*) FILTER (WHERE value % 8 = 0) / count(*) AS s8, count(*) FILTER (WHERE value % 4 = 0) / count(*) AS s4, count(*) FILTER (WHERE value % 2 = 0) / count(*) AS s2 FROM ({_SIZES}) WHERE value >= 4 GROUP BY 1)""",
    "spacing_scale": f"""SELECT page, string_agg(value::VARCHAR, ',' ORDER BY value) AS scale FROM (SELECT page, value, n / sum(n) OVER (PARTITION BY page) AS part FROM (SELECT page, value, count(*) AS n FROM ({_SIZES}) GROUP BY page, value)) WHERE part >= 0.02 GROUP BY 1""",
    "value_counts": f"SELECT page, value::BIGINT AS value, n::BIGINT AS count, rank::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY n DESC, value) AS rank FROM (SELECT page, value, count(*) AS n FROM ({_SIZES}) GROUP BY page, value)) WHERE rank <= 6",
    "font_shares": """SELECT page, family, chars, floor(chars / sum(chars) OVER (PARTITION BY page) * 100 * 10 + 0.5) / 10 AS share, weights FROM (
        SELECT substr(p_brand, 1, 7) AS page, p_type AS family, sum(p_size)::BIGINT AS chars, array_to_string(list_sort(list(DISTINCT p_brand)), '/') AS weights FROM part GROUP BY ALL)""",
    "type_scale": _SCALE,
    "type_ratio": f"SELECT page, floor(avg(px / before) * 100 + 0.5) / 100 AS ratio FROM (SELECT page, px, lag(px) OVER (PARTITION BY page ORDER BY px) AS before FROM ({_SCALE}) WHERE px >= body) GROUP BY 1",
    "color_metrics": f"""SELECT p_partkey, printf('#%02x%02x%02x', r, g, b) AS hex, {sql_round('l_', 6)} AS l, {sql_round('sqrt(a_ * a_ + b_ * b_)', 6)} AS chroma,
        {sql_round('(degrees(atan2(b_, a_)) + 360) - 360 * floor((degrees(atan2(b_, a_)) + 360) / 360)', 6)} AS hue, {sql_round('1.05 / (0.2126 * lr + 0.7152 * lg + 0.0722 * lb + 0.05)', 6)} AS contrast FROM ({_sql_lab(_RGB)})""",
    "nearest_brand": f"""SELECT p_partkey AS color_id, arg_min(color, (d, color)) AS nearest, {sql_round('min(d)', 4)} AS distance FROM (
        SELECT p_partkey, color, sqrt((p.l_ - q.l_) * (p.l_ - q.l_) + (p.a_ - q.a_) * (p.a_ - q.a_) + (p.b_ - q.b_) * (p.b_ - q.b_)) * 100 AS d FROM ({_sql_lab(_RGB)}) p, ({_sql_lab(_BRAND)}) q) GROUP BY 1""",
    "color_clusters": _clusters(),
    "path_hashes": """SELECT o_orderkey, substr(sha1('M ' || regexp_replace(printf('%.1f', floor(o_totalprice::DECIMAL(18,2)::DOUBLE * 10 + 0.5) / 10), '\\.0$', '') || ' L ' || (o_orderkey % 100) || ' 0 z'), 1, 16) AS hash FROM orders""",
    "name_hits": f"""SELECT detail, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS files FROM (SELECT doc_id, ' ' || array_to_string({_WORDS}, ' ') || ' ' AS w FROM ({_LINES}) WHERE length(line) <= 4000), (VALUES ('the and'), ('of the'), ('licensed under')) v(detail) WHERE contains(w, ' ' || detail || ' ') GROUP BY 1""",
    "domain_hits": f"SELECT doc_id, n::BIGINT AS line, detail FROM ({_LINES}), (VALUES ('mail1.example.com'), ('mail2.example.com')) v(detail) WHERE length(line) <= 4000 AND contains(lower(line), detail)",
    "ledger_append": f"SELECT event_id, key, event_type FROM ({_NEW}) WHERE key NOT IN ({_OLD})",
    "ledger_counts": f"SELECT count(*) FILTER (WHERE key NOT IN ({_OLD}))::BIGINT AS added, count(*) FILTER (WHERE key IN ({_OLD}))::BIGINT AS skipped FROM ({_NEW})",
    "ledger_union": """SELECT source, rating, count(*)::BIGINT AS n, sum(length(text))::BIGINT AS chars FROM (SELECT source, lang AS rating, '' AS text FROM documents UNION ALL SELECT role, '', text FROM conversations) GROUP BY ALL""",
    "event_windows": f"""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*)::BIGINT AS n, {sql_round('sum(value)', 2)} AS total FROM events GROUP BY 1, 2""",
    "event_sessions": """SELECT user_id, sum(fresh)::BIGINT AS sessions, count(*)::BIGINT AS events FROM (SELECT user_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events) GROUP BY 1""",
    "duration_lists": "SELECT l_orderkey, l_linenumber, greatest(l_quantity::INTEGER::DOUBLE, ('0.' || l_linenumber)::DOUBLE * 1000) AS ms FROM lineitem",
    "breakpoints": "SELECT page, value::BIGINT AS value, count(*)::BIGINT AS count FROM (SELECT p_brand AS page, unnest([p_size * 16, p_size * 50]) AS value FROM part) WHERE value BETWEEN 240 AND 3000 GROUP BY ALL",
    "heading_skips": """SELECT * FROM (SELECT page, pos, level, lag(level) OVER (PARTITION BY page ORDER BY pos) AS before FROM (SELECT l_orderkey AS page, l_suppkey AS pos, min(l_linenumber)::BIGINT AS level FROM lineitem GROUP BY ALL HAVING min(l_linenumber) <= 6)) WHERE level - before > 1""",
    "style_changes": "SELECT p_partkey, concat_ws(',', CASE WHEN p_brand <> 'Brand#11' THEN 'color' END, CASE WHEN p_size <> 10 THEN 'size' END) AS changed FROM part",
    "crawl_totals": "SELECT count(*) FILTER (WHERE event_type NOT IN ('error', 'signup'))::BIGINT AS pages, count(*) FILTER (WHERE event_type = 'signup')::BIGINT AS blocked, count(*) FILTER (WHERE event_type = 'error')::BIGINT AS failed, false AS near_empty FROM events",
    "position_labels": """SELECT "where", count(*)::BIGINT AS n FROM (SELECT CASE WHEN y < 120 THEN 'top bar' WHEN y < 900 THEN 'first screen' ELSE floor(y / 4000 * 100 + 0.5)::BIGINT || '% down the page' END || ', ' ||
        CASE WHEN w > 864 THEN 'full width' WHEN (x + w / 2) / 1440 < 0.36 THEN 'left' WHEN (x + w / 2) / 1440 > 0.64 THEN 'right' ELSE 'center' END AS "where" FROM (SELECT l_partkey % 1440 AS x, l_suppkey * 20 AS y, l_quantity * 20 AS w FROM lineitem)) GROUP BY 1""",
}
