"""HTML, URL, robots and crawl queries over `pages`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import html as H
from corvane.functions import urls as U
from corvane.operators import migrate
from corvane.plans.common import sql_squash, table


def page_text(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    return p.select("page_id", H.html_to_text(H.content_of(F.col("html")), H.decode_named).alias("text"))


def page_heads(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "pages").select("page_id", H.head_of(F.col("html"), H.decode_named).alias("h"))
    return h.select("page_id", "h.title", "h.description", "h.canonical", "h.robots", "h.og_title", "h.h1")


def page_hrefs(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", F.posexplode(H.hrefs(F.col("html"))).alias("pos", "href"))
    return p.where(~F.col("href").rlike("(?i)^(?:mailto:|tel:|javascript:|data:|#)")).select("page_id", F.col("pos").cast("long").alias("pos"), "href")


def page_links(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", F.explode(H.links_of(F.col("html"), F.col("url"))).alias("link"))
    return p.groupBy("page_id").agg(F.count("*").alias("n_links"), F.min("link").alias("first_link"))


def page_entities(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "pages").select(F.explode(F.regexp_extract_all("html", F.lit("(&#?[A-Za-z0-9]+;)"), F.lit(1))).alias("entity"))
    return e.groupBy("entity").agg(F.count("*").alias("n"))


def page_technologies(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "pages").select("page_id", F.explode(H.technologies(F.col("html"))).alias("technology", "present"))
    return t.groupBy("technology").agg(F.count_if("present").alias("n"))


def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", U.normalize(u).alias("normal"), U.host(u).alias("host"), U.canonical_path(u).alias("path"), U.path_and_query(u).alias("path_query"))


def url_first_sighting(spark: SparkSession, d: str) -> DataFrame:
    """The first page of each normalised URL."""
    p = table(spark, d, "pages").select("page_id", U.normalize(F.col("url")).alias("url"))
    return p.groupBy("url").agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))


def url_hosts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").groupBy(U.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"), F.countDistinct(U.canonical_path(F.col("url"))).alias("paths"))


def url_section(spark: SparkSession, d: str) -> DataFrame:
    """Pages of each host in the section /en."""
    p = table(spark, d, "pages").withColumn("h", F.try_parse_url("url", F.lit("HOST")))
    inside = U.in_section(F.col("url"), F.col("h"), "/en")
    return p.groupBy("h").agg(F.count_if(inside).alias("inside"), F.count("*").alias("n")).withColumnRenamed("h", "host")


ROBOTS = """User-agent: *
Disallow: /en/1
Allow: /en/12
Disallow: /*/9$

User-agent: tester
Disallow: /fr
"""


def robots_allowed(spark: SparkSession, d: str) -> DataFrame:
    """Which page paths a policy allows for an agent that it does not name."""
    pages = table(spark, d, "pages").select("page_id", F.lit("all").alias("host"), U.path_and_query(F.col("url")).alias("path"))
    policy = spark.createDataFrame([("all", ROBOTS)], "host string, text string")
    rules = migrate.rules_for(migrate.robots_lines(policy), "corvane")
    return migrate.allowed(pages, rules).select("page_id", "path", "allowed")


def _hop(c):
    return F.concat(F.lit("http://x.example/"), c.cast("string"))


def _hops(spark: SparkSession, d: str) -> DataFrame:
    """A link table: the half of every order key links to the key, after even ones to odd ones."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("k"))
    return o.select(_hop(F.floor(F.col("k") / 2)).alias("src"), _hop(F.col("k")).alias("dst"), (F.col("k") % 2).alias("pos")).where("src <> dst")


def crawl_levels(spark: SparkSession, d: str) -> DataFrame:
    """Breadth-first levels of everything that the link table reaches from key 1."""
    start = spark.createDataFrame([("http://x.example/1",)], "url string")
    return migrate.crawl(start, _hops(spark, d)).select("url", F.col("level").cast("long").alias("level"))


CRAWL_ROBOTS = "User-agent: *\nDisallow: /*3$\n"


def _crawled(spark: SparkSession, d: str, most: int, slow: int) -> DataFrame:
    """A crawl from key 1: keys that end in 3 are forbidden, every eleventh is missing, some ask to slow down."""
    k = F.col("k")
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("k"))
    paths = o.select("k", F.lit("all").alias("host"), F.concat(F.lit("/"), k.cast("string")).alias("path"))
    rules = migrate.rules_for(migrate.robots_lines(spark.createDataFrame([("all", CRAWL_ROBOTS)], "host string, text string")), "corvane")
    answers = migrate.allowed(paths, rules).select(_hop(k).alias("url"), "allowed", F.when(k % 11 == 5, 404).otherwise(200).alias("status"), F.when(k % slow == 4, 2).otherwise(0).alias("slow"))
    start = spark.createDataFrame([("http://x.example/1", 0)], "url string, pos long")
    return migrate.crawl_queue(start, _hops(spark, d), answers, most)


def crawl_queue(spark: SparkSession, d: str) -> DataFrame:
    """The state and level of every page that a crawl of 60 pages met (the page limit is a crawl's own)."""
    c = _crawled(spark, d, 60, 10**9)
    return c.select("url", F.col("level").cast("long").alias("level"), "state", F.array_join("place", ".").alias("place"))


def crawl_queue_totals(spark: SparkSession, d: str) -> DataFrame:
    """Counts of a crawl that stops where a fourth answer asks to slow down."""
    return migrate.queue_totals(_crawled(spark, d, 100_000, 50))


def sitemap_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages under /docs of a sitemap and of an index, one level deep; nations are the pages."""
    n = table(spark, d, "nation")
    loc = lambda u: F.concat(F.lit("<url><loc> "), u, F.lit(" </loc></url>"))
    page = F.concat(F.when(F.col("n_nationkey") % 5 == 4, "http://b.example/docs/").when(F.col("n_nationkey") % 5 == 3, "http://a.example/blog/").otherwise("http://a.example/docs/"), F.col("n_nationkey").cast("string"), F.lit("/?utm_x=1&amp;q=2"))
    one = n.agg(F.array_join(F.array_sort(F.collect_list(loc(page))), "").alias("xml"))
    index = "<sitemapindex>" + "".join(f"<sitemap><loc>http://a.example/{p}.xml</loc></sitemap>" for p in ("docs", "docs-2", "other", "more")) + "</sitemapindex>"
    more = "".join(f"<url><loc>http://a.example/docs{x}</loc></url>" for x in ("", "/deep#x", "-other/1"))
    fixed = spark.createDataFrame([("http://a.example/i.xml", 1, index), ("http://a.example/docs-2.xml", None, more), ("http://a.example/other.xml", None, more.replace("deep", "never"))], "url string, pos int, xml string")
    maps = one.select(F.lit("http://a.example/s.xml").alias("url"), F.lit(0).alias("pos"), "xml").unionByName(fixed)
    return migrate.sitemap_pages(maps, "a.example", "/docs").select("url")


def redirect_trace(spark: SparkSession, d: str) -> DataFrame:
    """Chains over recorded answers: keys divisible by 3 redirect to their third, others answer 200."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("k")).where("k > 0")
    third = F.col("k") % 3 == 0
    hops = o.select(_hop(F.col("k")).alias("url"), F.when(third, 301).otherwise(200).alias("status"), F.when(third, _hop(F.floor(F.col("k") / 3))).alias("location"))
    t = migrate.trace(o.select(_hop(F.col("k")).alias("url")), hops)
    return t.groupBy("status", "hops").agg(F.count("*").alias("n"))


def migration_check(spark: SparkSession, d: str) -> DataFrame:
    """Old pages against the same pages with every fifth title changed and every seventh lost."""
    p = table(spark, d, "pages").withColumn("path_", U.path_and_query(F.col("url")))
    p = p.groupBy("path_").agg(F.min("page_id").alias("page_id"), F.min_by("html", "page_id").alias("html")).withColumn("url", F.concat(F.lit("http://old.example"), "path_"))
    h = p.withColumn("h", H.head_of(F.col("html"), H.decode_named))
    head = ["title", "description", "og_title", "h1", "canonical", "robots"]
    old = h.select("url", F.lit(200).alias("status"), *[F.col(f"h.{c}").alias(c) for c in head])
    title = F.when(F.col("page_id") % 5 == 0, F.concat("h.title", F.lit(" new"))).otherwise(F.col("h.title"))
    new = h.where("page_id % 7 <> 0").select("url", F.lit(200).alias("status"), F.lit(0).alias("hops"), title.alias("title"), *[F.col(f"h.{c}").alias(c) for c in head[1:]])
    return migrate.migration_totals(migrate.compare_pages(old, new))


def _named(t: str) -> str:
    for name, value in sorted(H.ENTITIES.items(), key=lambda kv: kv[0] == "amp"):
        v = value.replace("'", "''").replace("\\", "\\\\")
        t = f"regexp_replace({t}, '&{name};', '{v}', 'gi')"
    return t


def _drop(t: str, tags: list[str]) -> str:
    for x in tags:
        t = rf"regexp_replace({t}, '<{x}\b[^>]*>.*?</{x}\s*>', ' ', 'gis')"
    return t


def _content() -> str:
    clean = _drop("regexp_replace(html, '<!--.*?-->', ' ', 'gs')", ["script", "style", "noscript", "template", "svg", "iframe", "head"])
    return f"SELECT page_id, regexp_extract({clean}, '<article\\b[^>]*>(.*?)</article\\s*>', 1, 'is') AS c FROM pages"


def _to_text(t: str) -> str:
    t = rf"regexp_replace({t}, '<br\s*/?>', chr(10), 'gi')"
    for level in range(1, 7):
        t = rf"regexp_replace({t}, '<h{level}\b[^>]*>(.*?)</h{level}\s*>', chr(10) || chr(10) || '{'#' * level} \1' || chr(10) || chr(10), 'gis')"
    t = rf"regexp_replace({t}, '<li\b[^>]*>', chr(10) || '- ', 'gi')"
    t = rf"regexp_replace({t}, '</(?:{H.CLOSERS})\s*>', chr(10) || chr(10), 'gi')"
    t = rf"regexp_replace({t}, '<(?:td|th)\b[^>]*>', ' | ', 'gi')"
    t = rf"regexp_replace({t}, '<hr\b[^>]*>', chr(10) || chr(10) || '---' || chr(10) || chr(10), 'gi')"
    t = _named(f"regexp_replace({t}, '<[^>]+>', ' ', 'g')")
    t = rf"array_to_string(list_transform(string_split({t}, chr(10)), lambda l: trim(regexp_replace(l, '[ \t\f\v]+', ' ', 'g'))), chr(10))"
    return rf"regexp_replace(regexp_replace({t}, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


_HOST = r"lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1))"
_WWW = rf"regexp_replace({_HOST}, '^www\.', '')"
_PATH = r"regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)"
_QUERY = r"regexp_extract(url, '^[^?#]*\?([^#]*)', 1)"
_CPATH = f"regexp_replace({_PATH}, '/$', '')"
_PQ = rf"(CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END || CASE WHEN regexp_matches(url, '^[^?#]*\?') THEN '?' || {_QUERY} ELSE '' END)"
_NORMAL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])(?:(?:utm_[^=&]*|ref|source|fbclid|gclid)(?:=[^&]*)?(?:&|$))+', '\1', 'g'), '[?&]+$', ''), '/+$', '')"


def _pick(t: str) -> str:
    return f"trim({_named(t)})"


_HEAD = rf"""SELECT page_id, {sql_squash(_named(r"regexp_extract(hd, '<title\b[^>]*>(.*?)</title\s*>', 1, 'is')"))} AS title,
  '' AS description, '' AS canonical, '' AS robots, '' AS og_title,
  {sql_squash(_named(r"regexp_replace(regexp_extract(html, '<h1\b[^>]*>(.*?)</h1\s*>', 1, 'is'), '<[^>]+>', ' ', 'g')"))} AS h1
  FROM (SELECT page_id, html, url, regexp_extract(html, '<head\b[^>]*>(.*?)</head\s*>', 1, 'is') AS hd FROM pages)"""

QUERIES = {
    "page_text": page_text, "page_heads": page_heads, "page_hrefs": page_hrefs, "page_links": page_links, "page_entities": page_entities,
    "page_technologies": page_technologies, "url_normalize": url_normalize, "url_first_sighting": url_first_sighting, "url_hosts": url_hosts,
    "url_section": url_section, "robots_allowed": robots_allowed, "crawl_levels": crawl_levels, "crawl_queue": crawl_queue, "crawl_queue_totals": crawl_queue_totals,
    "sitemap_pages": sitemap_pages, "redirect_trace": redirect_trace, "migration_check": migration_check,
}

#: Pages that a crawl of the link table from key 1 meets, in the order of its queue: by level, then by key.
_WALK = """w(k, level, place, state) AS (
   SELECT 1::BIGINT, 0::BIGINT, '0', 'ok' UNION ALL
   SELECT o_orderkey, level + 1, place || '.' || (o_orderkey % 2), CASE WHEN o_orderkey % 10 = 3 THEN 'blocked' WHEN o_orderkey % 11 = 5 THEN 'failed' ELSE 'ok' END
   FROM w JOIN (SELECT DISTINCT o_orderkey FROM orders) ON o_orderkey // 2 = k AND o_orderkey <> k WHERE state = 'ok')"""

ORACLES = {
    "page_links": rf"""SELECT page_id, count(DISTINCT link)::BIGINT AS n_links, min(link) AS first_link FROM (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || unnest(list_transform(regexp_extract_all(html, '<a\b[^>]*\bhref\s*=\s*("[^"]*"|''[^'']*''|[^\s>"'']+)', 1, 'i'), lambda x: trim(x, chr(34) || chr(39)))) AS link FROM pages) GROUP BY 1""",
    "page_text": f"SELECT page_id, {_to_text('c')} AS text FROM ({_content()})",
    "page_heads": _HEAD,
    "page_hrefs": r"""SELECT page_id, (pos - 1)::BIGINT AS pos, href FROM (SELECT page_id, unnest(range(1, len(h) + 1)) AS pos, unnest(h) AS href FROM (
        SELECT page_id, list_transform(regexp_extract_all(html, '<a\b[^>]*\bhref\s*=\s*("[^"]*"|''[^'']*''|[^\s>"'']+)', 1, 'i'), lambda x: trim(x, '"''')) AS h FROM pages))
        WHERE NOT regexp_matches(href, '^(?:mailto:|tel:|javascript:|data:|#)', 'i')""",
    "page_entities": "SELECT entity, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(html, '&#?[A-Za-z0-9]+;')) AS entity FROM pages) GROUP BY 1",
    "page_technologies": " UNION ALL ".join(f"SELECT '{k}' AS technology, count(*) FILTER (WHERE regexp_matches(html, '{p}'))::BIGINT AS n FROM pages" for k, p in H.TECHNOLOGIES.items()),
    "url_normalize": f"SELECT page_id, {_NORMAL} AS normal, {_WWW} AS host, {_CPATH} AS path, {_PQ} AS path_query FROM pages",
    "url_first_sighting": f"SELECT {_NORMAL} AS url, min(page_id) AS page_id, count(*)::BIGINT AS n FROM pages GROUP BY 1",
    "url_hosts": f"SELECT {_WWW} AS host, count(*)::BIGINT AS n, count(DISTINCT {_CPATH})::BIGINT AS paths FROM pages GROUP BY 1",
    "url_section": rf"""SELECT {_HOST} AS host, count(*) FILTER (WHERE ({_PATH} = '/en' OR starts_with({_PATH}, '/en/')) AND NOT regexp_matches({_PATH}, '\.(png|jpe?g|gif|webp|avif|svg|ico|css|js|mjs|json|xml|pdf|zip|mp4|webm|mp3|woff2?|ttf)(\?|$)', 'i'))::BIGINT AS inside, count(*)::BIGINT AS n FROM pages GROUP BY 1""",
    "robots_allowed": rf"""SELECT page_id, {_PQ} AS path, CASE WHEN regexp_matches({_PQ}, '^/en/12') THEN true WHEN regexp_matches({_PQ}, '^/en/1') THEN false WHEN regexp_matches({_PQ}, '^/.*/9$') THEN false ELSE true END AS allowed FROM pages""",
    "crawl_levels": """WITH RECURSIVE w(k, level) AS (SELECT 1::BIGINT, 0::BIGINT UNION ALL SELECT o_orderkey, level + 1 FROM w JOIN (SELECT DISTINCT o_orderkey FROM orders) ON o_orderkey // 2 = k AND o_orderkey <> k)
        SELECT 'http://x.example/' || k AS url, level FROM w""",
    "crawl_queue": f"""WITH RECURSIVE {_WALK}, n AS (SELECT *, count(*) FILTER (WHERE state = 'ok') OVER (ORDER BY level, k) AS read FROM w),
        t AS (SELECT *, read < 60 OR (read = 60 AND state = 'ok') AS taken FROM n)
        SELECT 'http://x.example/' || k AS url, level, CASE WHEN taken THEN state ELSE 'left' END AS state, place FROM t WHERE taken OR k // 2 IN (SELECT k FROM t WHERE taken)""",
    "crawl_queue_totals": f"""WITH RECURSIVE {_WALK}, n AS (SELECT *, sum(CASE WHEN k % 50 = 4 AND state <> 'blocked' THEN 2 ELSE 0 END) OVER (ORDER BY level, k) AS asked FROM w),
        t AS (SELECT *, asked <= 3 AS taken FROM n), s AS (SELECT min(k) AS k FROM t WHERE NOT taken)
        SELECT count(*) FILTER (WHERE taken AND state = 'ok')::BIGINT AS pages, count(*) FILTER (WHERE taken AND state = 'blocked')::BIGINT AS blocked, count(*) FILTER (WHERE taken AND state = 'failed')::BIGINT AS failed,
        count(*) FILTER (WHERE NOT taken AND t.k <> s.k AND t.k // 2 IN (SELECT k FROM t WHERE taken))::BIGINT AS "left" FROM t, s""",
    "sitemap_pages": "SELECT 'http://a.example/docs/' || n_nationkey || '/?q=2' AS url FROM nation WHERE n_nationkey % 5 < 3 UNION SELECT unnest(['http://a.example/docs', 'http://a.example/docs/deep'])",
    "redirect_trace": """WITH RECURSIVE w(k, cur, hops) AS (SELECT o_orderkey, o_orderkey, 0 FROM orders WHERE o_orderkey > 0 UNION ALL SELECT k, cur // 3, hops + 1 FROM w WHERE cur % 3 = 0 AND cur IN (SELECT o_orderkey FROM orders) AND hops < 6),
        f AS (SELECT k, arg_max(cur, hops) AS cur, max(hops) AS hops FROM w GROUP BY k)
        SELECT CASE WHEN hops >= 6 THEN 310 WHEN cur IN (SELECT o_orderkey FROM orders WHERE o_orderkey > 0) THEN CASE WHEN cur % 3 = 0 THEN 310 ELSE 200 END ELSE 0 END::INTEGER AS status, hops::INTEGER AS hops, count(*)::BIGINT AS n FROM f GROUP BY ALL""",
    "migration_check": f"""WITH p AS (SELECT {_PQ} AS pq, min(page_id) AS id FROM pages GROUP BY 1)
        SELECT count(*)::BIGINT AS checked, count(*) FILTER (WHERE id % 7 = 0)::BIGINT AS failing, count(*) FILTER (WHERE id % 7 <> 0 AND id % 5 = 0)::BIGINT AS drifted FROM p""",
}
