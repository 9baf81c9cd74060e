"""Migration and crawling: page pairs by path, redirect chains, robots rules, a crawl frontier over recorded links."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.html import sitemap_urls
from corvane.functions.text import squash
from corvane.functions.urls import canonical_path, normalize, path_and_query, robots_pattern
from corvane.session import SMALL_ROWS, shared_folder

MOST_HOPS, LOOP, SETTLE, MOST_SLOWDOWNS = 6, 310, 8, 3


def compare_pages(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, changed, noindex, ok for pages joined on path and query.

    Sides are url, status, hops and the head fields title, description, og_title, h1, canonical, robots.
    """
    keys = ("title", "description", "og_title", "h1")
    a = old.withColumn("path", path_and_query(F.col("url")))
    b = new.withColumn("path", path_and_query(F.col("url")))
    a = a.select("path", *[F.col(c).alias(f"o_{c}") for c in ("status", *keys, "canonical", "robots")])
    b = b.select("path", *[F.col(c).alias(f"n_{c}") for c in ("status", "hops", *keys, "canonical", "robots")])
    j = a.join(b, "path", "left")
    both = F.col("n_title").isNotNull()
    diff = [F.when(both & (squash(F.col(f"o_{k}")) != squash(F.col(f"n_{k}"))), F.lit(k)) for k in keys]
    diff.append(F.when(both & (canonical_path(F.col("o_canonical")) != canonical_path(F.col("n_canonical"))), F.lit("canonical")))
    noindex = F.coalesce(F.col("n_robots").rlike("(?i)noindex") & ~F.coalesce(F.col("o_robots").rlike("(?i)noindex"), F.lit(False)), F.lit(False))
    ok = F.coalesce((F.col("n_status") == 200) & (F.col("n_hops") <= 1) & ~noindex, F.lit(False))
    changed = F.filter(F.array(*diff), lambda x: x.isNotNull())
    return j.select("path", F.col("o_status").alias("old"), F.coalesce("n_status", F.lit(0)).alias("new"), changed.alias("changed"), noindex.alias("noindex"), ok.alias("ok"))


def migration_totals(checks: DataFrame) -> DataFrame:
    return checks.agg(F.count("*").alias("checked"), F.count_if(~F.col("ok")).alias("failing"), F.count_if(F.size("changed") > 0).alias("drifted"))


def trace(urls: DataFrame, hops: DataFrame, most: int = MOST_HOPS) -> DataFrame:
    """url, final, status, hops: follows a table of recorded answers (url, status, location) a bounded number of times.

    No answer gives status 0, a chain that does not end 310.
    """
    answers = hops.select(F.col("url").alias("at"), F.col("status").alias("got"), "location")
    cur = urls.select("url", F.col("url").alias("at"), F.lit(0).alias("hops"), F.lit(None).cast("int").alias("status"))
    for _ in range(most):
        j = cur.join(answers, "at", "left")
        moved = F.col("status").isNull() & F.col("got").between(300, 399) & F.col("location").isNotNull()
        status = F.when(F.col("status").isNotNull(), F.col("status")).when(moved, F.lit(None)).otherwise(F.coalesce("got", F.lit(0)))
        cur = j.select("url", F.when(moved, F.col("location")).otherwise(F.col("at")).alias("at"), (F.col("hops") + moved.cast("int")).alias("hops"), status.cast("int").alias("status"))
    return cur.select("url", F.col("at").alias("final"), F.coalesce("status", F.lit(LOOP)).alias("status"), "hops")


def robots_lines(policies: DataFrame, key: str = "host", text: str = "text") -> DataFrame:
    """key, grp, agent (null for rules), allow, path: groups are runs of agent lines and the rules after them."""
    lines = policies.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\r?\n")).alias("pos", "raw"))
    line = F.trim(F.regexp_replace("raw", "#.*$", ""))
    lines = lines.withColumn("line", line).where(F.contains("line", F.lit(":")))
    lines = lines.withColumn("k", F.lower(F.trim(F.substring_index("line", ":", 1)))).withColumn("v", F.trim(F.expr("substring(line, instr(line, ':') + 1)")))
    w = Window.partitionBy(key).orderBy("pos")
    # sitemap lines are global and do not part a run of agents
    rules = lines.where("k <> 'sitemap'").withColumn("agent_line", F.col("k") == "user-agent")
    rules = rules.withColumn("starts", (F.col("agent_line") & ~F.coalesce(F.lag("agent_line").over(w), F.lit(False))).cast("int"))
    rules = rules.withColumn("grp", F.sum("starts").over(w)).where("grp > 0")
    kept = F.col("agent_line") | (F.col("k") == "allow") | ((F.col("k") == "disallow") & (F.col("v") != ""))
    return rules.where(kept).select(key, "grp", F.when(F.col("agent_line"), F.lower("v")).alias("agent"), F.when(~F.col("agent_line"), F.col("k") == "allow").alias("allow"), F.when(~F.col("agent_line"), F.col("v")).alias("path"))


def robots_sitemaps(policies: DataFrame, key: str = "host", text: str = "text") -> DataFrame:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?im)^\s*sitemap\s*:\s*([^#\r\n]*)"), F.lit(1))
    return policies.select(key, F.explode(found).alias("sitemap")).select(key, F.trim("sitemap").alias("sitemap"))


def rules_for(parsed: DataFrame, agent: str, key: str = "host") -> DataFrame:
    """The rules of the groups that name the agent, else of those for all."""
    groups = parsed.where("agent is not null").groupBy(key, "grp").agg(F.max((F.col("agent") == agent.lower()).cast("int")).alias("named"), F.max((F.col("agent") == "*").cast("int")).alias("star"))
    groups = groups.withColumn("any_named", F.max("named").over(Window.partitionBy(key)))
    chosen = groups.where("named = 1 or (any_named = 0 and star = 1)").select(key, "grp")
    return parsed.where("path is not null").join(chosen, [key, "grp"]).select(key, "allow", "path")


def allowed(paths: DataFrame, rules: DataFrame, key: str = "host", path: str = "path") -> DataFrame:
    """paths with `allowed`: the longest matching rule decides, allow on a tie, no rule allows."""
    r = rules.select(key, "allow", F.col("path").alias("rule")).withColumn("pattern", robots_pattern(F.col("rule"))).withColumn("len", F.length(F.replace("rule", F.lit("*"), F.lit(""))))
    # rules are grouped by host first, so a path meets its own host's rules only, in one array
    per = r.groupBy(key).agg(F.collect_list(F.struct("len", "allow", "pattern")).alias("rules"))
    j = paths.join(per, key, "left")
    hit = F.filter(F.coalesce("rules", F.array().cast("array<struct<len:int,allow:boolean,pattern:string>>")), lambda x: F.regexp_like(F.col(path), x["pattern"]))
    best = F.array_max(F.transform(hit, lambda x: F.struct(x["len"].alias("len"), x["allow"].alias("allow"))))
    return j.withColumn("allowed", (F.col(path) == "/robots.txt") | F.coalesce(best["allow"], F.lit(True))).drop("rules")


def _settled(df: DataFrame, key: str | None = None) -> DataFrame:
    """Reliable checkpoint in the shared folder, in the order of key within partitions where one is given.

    It is planned without adaptive execution: only then does Spark remember how the rows are dealt out and sorted, so that a later
    join on the same key neither shuffles nor sorts them again.
    """
    spark = df.sparkSession
    shared_folder(spark)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return (df if key is None else df.sortWithinPartitions(key)).checkpoint(eager=True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def _dealt(df: DataFrame, key: str) -> DataFrame:
    """df dealt out by key to as many partitions as joins and aggregates have."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def crawl(start: DataFrame, links: DataFrame, ok: Column | None = None, most: int | None = None, depth: int | None = None) -> DataFrame:
    """Breadth-first levels over a table of recorded links (src, dst): url, level; each normalised URL once.

    It ends where no link leads to a new page, or at `most` pages or `depth` levels where these are given; pages beyond
    `most` go by URL. The driver keeps only the number of pages per level; frontier and visited set stay distributed.
    Links are dealt out by source once and pages by URL, so each level shuffles only the URLs that it finds. Each level is
    checkpointed, and the visited set every SETTLE levels, so that plans do not grow with the depth.
    """
    edges = _dealt(links.select(normalize(F.col("src")).alias("src"), normalize(F.col("dst")).alias("dst")), "src").distinct()
    if ok is not None:
        edges = edges.where(ok)
    edges = _settled(edges, "src")
    frontier = _settled(_dealt(start.select(normalize(F.col("url")).alias("url")), "url").distinct().withColumn("level", F.lit(0)), "url")
    if most is not None:
        frontier = _settled(_dealt(frontier.orderBy("url").limit(most), "url"), "url")
    visited, n = [frontier], frontier.count()  # parts of the visited set
    got = n
    for level in count(1):
        if most is not None and n >= most or depth is not None and level > depth:
            break
        near = F.broadcast(frontier) if got <= SMALL_ROWS else frontier
        step = near.join(edges, near["url"] == edges["src"]).select(F.col("dst").alias("url")).distinct()
        for part in visited:
            step = step.join(part.select("url"), "url", "left_anti")
        step = _settled(step.withColumn("level", F.lit(level)), "url")
        got = step.count()
        if not got:
            break
        if most is not None and got > most - n:
            step, got = _settled(_dealt(step.orderBy("url").limit(most - n), "url"), "url"), most - n
        visited, frontier, n = [*visited, step], step, n + got
        if level % SETTLE == 0:
            visited = [_settled(_dealt(_union(visited), "url"), "url")]
    return _union(visited)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def crawl_queue(start: DataFrame, links: DataFrame, answers: DataFrame, most: int = 150, slowdowns: int = MOST_SLOWDOWNS) -> DataFrame:
    """url, level, place, state of a crawl that takes pages first in, first out, over recorded links and answers.

    start: url, pos; links: src, dst, pos; answers: url, allowed, status, slow (how often 429 came before the status).
    A page that robots rules forbid is blocked, one without status 200 failed; both lead nowhere. The crawl stops after
    `most` pages read, or at the page where more than `slowdowns` answers in all asked to slow down. What was found and
    not taken from the queue is left. place is the way of link positions to a page: a level in the order of places is
    the order of the queue, so no global numbering is needed. The driver keeps counts and the place of the stop only.
    """
    edges = _dealt(links.select(normalize(F.col("src")).alias("src"), normalize(F.col("dst")).alias("dst"), "pos"), "src")
    edges = _settled(edges.groupBy("src", "dst").agg(F.min("pos").alias("pos")), "src")
    known = _settled(_dealt(answers.select(normalize(F.col("url")).alias("url"), "allowed", "status", F.coalesce("slow", F.lit(0)).alias("slow")), "url"), "url")
    found = start.groupBy(normalize(F.col("url")).alias("url")).agg(F.min(F.array(F.col("pos").cast("long"))).alias("place"))
    visited, read, asked = None, 0, 0
    for level in count():
        state = F.when(~F.coalesce("allowed", F.lit(True)), "blocked").when(F.col("status") == 200, "ok").otherwise("failed")
        rows = _settled(found.join(known, "url", "left").select("url", F.lit(level).alias("level"), "place", state.alias("state"), F.when(F.col("allowed"), F.col("slow")).otherwise(0).alias("slow")))
        if rows.isEmpty():
            break
        stop = None  # (place, whether its page is still taken)
        last = [r["place"] for r in rows.where("state = 'ok'").orderBy("place").select("place").limit(max(0, most - read)).collect()]  # at most `most`
        if read + len(last) >= most:
            stop = (last[-1] if last else [], True)
        for r in rows.where("slow > 0").orderBy("place").limit(slowdowns + 1 - asked).collect():
            if stop and r["place"] > stop[0]:
                break
            asked += r["slow"]
            if asked > slowdowns:
                stop = (r["place"], False)
                break
        rows = rows.drop("slow")
        if stop:
            at = F.lit(None).cast("array<long>") if not stop[0] else F.array(*[F.lit(x).cast("long") for x in stop[0]])
            before = F.coalesce((F.col("place") <= at) if stop[1] else (F.col("place") < at), F.lit(False))
            dropped = F.coalesce((F.col("place") == at) & F.lit(not stop[1]), F.lit(False))  # taken from the queue, not put back
            rows = rows.where(~dropped).withColumn("state", F.when(before, F.col("state")).otherwise("left"))
        visited = rows if visited is None else visited.unionByName(rows)
        if level % SETTLE == SETTLE - 1:
            visited = _settled(visited)
        read += len(last)
        nxt = rows.where("state = 'ok'").select(F.col("url").alias("src"), "place").join(edges, "src").select(F.col("dst").alias("url"), F.concat("place", F.array(F.col("pos").cast("long"))).alias("place"))
        found = nxt.groupBy("url").agg(F.min("place").alias("place")).join(visited.select("url"), "url", "left_anti")
        if stop:
            visited = visited.unionByName(found.select("url", F.lit(level + 1).alias("level"), "place", F.lit("left").alias("state")))
            break
    if visited is None:
        return found.select("url", F.lit(0).alias("level"), "place", F.lit("left").alias("state")).limit(0)
    return visited


def queue_totals(crawled: DataFrame) -> DataFrame:
    """pages, blocked, failed, left of a crawl_queue."""
    n = {"ok": "pages", "blocked": "blocked", "failed": "failed", "left": "left"}
    return crawled.agg(*[F.count_if(F.col("state") == k).alias(v) for k, v in n.items()])


def sitemap_pages(maps: DataFrame, host: str, prefix: str, most: int = 5) -> DataFrame:
    """url, pos of the pages that recorded sitemaps (url, pos, xml) list on a host below a prefix; pos orders the top ones.

    Of the first `most` maps, those that are an index are followed one level: to maps whose path holds the prefix's last
    part, or to all if an index names three or fewer, `most` at most.
    """
    part = prefix.rstrip("/").rsplit("/", 1)[-1]
    top = maps.where("pos is not null").orderBy("pos").limit(most).select("pos", sitemap_urls(F.col("xml")).alias("urls"), F.col("xml").rlike("(?i)<sitemapindex").alias("index"))
    direct = top.where("not index").select("pos", F.posexplode("urls").alias("at", "url"))
    near = F.filter("urls", lambda u: (F.size("urls") <= 3) | F.contains(F.coalesce(F.try_parse_url(u, F.lit("PATH")), F.lit("")), F.lit(part)))
    nested = top.where("index").select("pos", F.posexplode(F.slice(near, 1, most)).alias("nest", "url"))
    inner = maps.select("url", sitemap_urls(F.col("xml")).alias("urls"))
    nested = nested.join(inner, "url").select("pos", "nest", F.posexplode("urls").alias("at", "url"))
    both = direct.select(F.array(F.col("pos").cast("long"), F.lit(0).cast("long"), F.col("at").cast("long")).alias("pos"), "url").unionByName(nested.select(F.array(F.col("pos").cast("long"), F.col("nest").cast("long"), F.col("at").cast("long")).alias("pos"), "url"))
    path = F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit(""))
    p = prefix.rstrip("/")
    inside = (F.try_parse_url("url", F.lit("HOST")) == host) & ((path == p) | F.startswith(path, F.lit(p + "/")))
    return both.where(inside).groupBy(normalize(F.col("url")).alias("url")).agg(F.min("pos").alias("pos"))


def crawl_totals(pages: DataFrame) -> DataFrame:
    """pages, blocked, failed, and whether every page is nearly empty (under 40 words)."""
    ok = F.col("state") == "ok"
    return pages.agg(F.count_if(ok).alias("pages"), F.count_if(F.col("state") == "blocked").alias("blocked"), F.count_if(F.col("state") == "failed").alias("failed"), F.coalesce(F.bool_and(F.when(ok, F.col("words") < 40)), F.lit(False)).alias("near_empty"))
