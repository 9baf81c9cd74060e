"""Review evidence, parity, metrics and staged checks over the driver's tables used as analogues."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import gates, parity, reviews
from corvane.plans.common import sql_round, table

NOW, MONTHS = dt.date(1998, 8, 31), 18


def _reviews(spark: SparkSession, d: str) -> DataFrame:
    """Orders as reviews: priority 1-5 as rating, status as source, an empty url where the key is divisible by 11."""
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("source"),
        F.when(F.col("o_orderkey") % 11 == 0, "").otherwise("http://r.example/x").alias("url"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.substring("o_orderpriority", 1, 1).alias("rating"),
        F.concat(F.lit("Order — of “"), F.col("o_orderpriority"), F.lit("”")).alias("text"), F.col("o_orderkey").cast("long").alias("pos"), F.col("o_custkey"),
    )


def _themes(spark: SparkSession, d: str) -> DataFrame:
    """A theme for each customer: it cites the customer's orders that are not open."""
    r = _reviews(spark, d).join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey").where("source <> 'O'")
    quote = F.struct(F.col("id").alias("row"), F.when(F.col("pos") % 3 == 0, F.lit("order - of \"5")).otherwise(F.lit("order - of")).alias("text"))
    t = r.groupBy("o_custkey", "c_mktsegment").agg(F.collect_list("id").alias("rows"), F.collect_list(quote).alias("quotes"))
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "love").when(F.col("c_mktsegment") == "MACHINERY", "odd").otherwise("hate")
    return t.select(F.col("o_custkey").cast("string").alias("id"), kind.alias("kind"), F.lit(None).cast("string").alias("label"), F.lit("").alias("summary"), "rows", "quotes")


def theme_summary(spark: SparkSession, d: str) -> DataFrame:
    s = reviews.theme_summary(reviews.usable(_reviews(spark, d)), _themes(spark, d), NOW, MONTHS)
    return s.select("theme", "kind", "reviews", F.array_join("sources", ",").alias("sources"), "weight", "thin")


def theme_errors(spark: SparkSession, d: str) -> DataFrame:
    return reviews.errors(reviews.usable(_reviews(spark, d)), _themes(spark, d)).groupBy("rule").agg(F.count("*").alias("n"))


def review_coverage(spark: SparkSession, d: str) -> DataFrame:
    rows, t = reviews.usable(_reviews(spark, d)), _themes(spark, d)
    return reviews.coverage(rows, t).join(reviews.uncovered(rows, t).agg(F.count("*").alias("uncovered")), F.lit(True)).join(reviews.dropped(_reviews(spark, d)), F.lit(True))


def review_first_uncovered(spark: SparkSession, d: str) -> DataFrame:
    """The first 15 low reviews that no theme cites (a top-k report)."""
    return reviews.first_uncovered(reviews.usable(_reviews(spark, d)), _themes(spark, d))


def review_sources(spark: SparkSession, d: str) -> DataFrame:
    return reviews.sources(reviews.usable(_reviews(spark, d)))


def review_sample(spark: SparkSession, d: str) -> DataFrame:
    return reviews.sample(reviews.usable(_reviews(spark, d)))


def _features(spark: SparkSession, d: str) -> DataFrame:
    """Orders as features: priority, status and market segment as priority, completion and area."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    o = table(spark, d, "orders").join(c, "o_custkey")
    p, k = F.substring("o_orderpriority", 1, 1), F.col("o_orderkey")
    return o.select(
        k.cast("string").alias("id"), F.col("o_orderpriority").alias("feature"), F.col("c_mktsegment").alias("area"),
        F.when(p == "1", "Must").when(p == "2", "should").when(p == "3", "could").otherwise("later").alias("priority"),
        F.when(k % 10 == 0, "no").otherwise("yes").alias("original"), F.when(F.col("o_orderstatus") == "F", "yes").when(F.col("o_orderstatus") == "O", "Partial").otherwise(F.when(k % 2 == 0, "no").otherwise("skip")).alias("clone"),
        F.lit("").alias("source"), F.when(k % 3 == 0, "").otherwise("why").alias("notes"), k.cast("int").alias("__line"),
    )


def parity_areas(spark: SparkSession, d: str) -> DataFrame:
    return parity.by_area(_features(spark, d))


def parity_problems(spark: SparkSession, d: str) -> DataFrame:
    return parity.problems(_features(spark, d)).groupBy("problem", "value").agg(F.count("*").alias("n"))


def parity_missing(spark: SparkSession, d: str) -> DataFrame:
    return parity.missing(_features(spark, d))


def parity_pivot(spark: SparkSession, d: str) -> DataFrame:
    return parity.by_priority(_features(spark, d))


def _beat(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    g = p.groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 2).alias("original"), F.round(F.max("p_size"), 2).cast("double").alias("m"), F.count("*").alias("n"))
    return g.select(F.col("p_brand").alias("name"), F.col("n").cast("double").alias("original"), (F.col("m") * 2).alias("clone"), F.when(F.col("n") % 2 == 0, "higher").otherwise("lower").alias("better"))


def beat_metrics(spark: SparkSession, d: str) -> DataFrame:
    return parity.metrics(_beat(spark, d)).select("name", "better", "result")


def parity_verdict(spark: SparkSession, d: str) -> DataFrame:
    return parity.verdict(_features(spark, d), _beat(spark, d)).select("parity", "musts", "musts_done", "built", "planned", "wins", "losses", "verdict")


def gate_checks(spark: SparkSession, d: str) -> DataFrame:
    """Research checks with facts counted from the tables, in all modes."""
    rows = reviews.usable(_reviews(spark, d))
    facts = rows.agg(F.countDistinct("source").alias("sources"), F.count("*").alias("reviews"))
    themes = _themes(spark, d).agg(F.count("*").alias("themes"), F.lit(0).alias("pain_errors"))
    feats = _features(spark, d).agg(F.count("*").alias("features"), F.count_if(F.lower("priority") == "must").alias("musts"))
    one = facts.join(themes, F.lit(True)).join(feats, F.lit(True))
    one = one.select("*", F.lit(True).alias("verdict_given"), F.lit(0).alias("measurements"), F.lit(True).alias("recon_filled"), F.lit(0).alias("feature_problems"), F.lit(0).alias("unsourced"))
    return gates.union([gates.research(one, m) for m in ("app", "site", "feature", "migrate")]).select("stage", "mode", "ord", "name", "status", "detail")


def gate_passes(spark: SparkSession, d: str) -> DataFrame:
    c = gate_checks(spark, d).withColumn("fix", F.col("name"))
    return gates.passes(c)


def findings_totals(spark: SparkSession, d: str) -> DataFrame:
    """Sum of errors and worst warnings over line statuses used as findings."""
    li = table(spark, d, "lineitem")
    t = li.groupBy(F.col("l_suppkey").alias("page")).agg(F.count_if(F.col("l_returnflag") == "R").alias("errors"), F.count_if(F.col("l_linestatus") == "O").alias("warnings"))
    return gates.copy_reduce(t)


_R = """r AS (SELECT o_orderkey::VARCHAR AS id, o_orderstatus AS source, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'http://r.example/x' END AS url,
  strftime(o_orderdate, '%Y-%m-%d') AS date, substr(o_orderpriority, 1, 1) AS rating, o_orderkey AS pos, o_custkey, o_orderpriority FROM orders),
 u AS (SELECT * FROM r WHERE url <> ''),
 ids AS (SELECT o_custkey::VARCHAR AS theme, CASE c_mktsegment WHEN 'BUILDING' THEN 'love' WHEN 'MACHINERY' THEN 'odd' ELSE 'hate' END AS kind, r.id, r.pos, o_orderpriority
  FROM r JOIN customer ON c_custkey = o_custkey WHERE source <> 'O')"""
_CUT = "DATE '1997-03-03'"  # 31 August 1998 less 18 months: 31 February runs over to 3 March
_W = f"""(CASE WHEN kind = 'love' THEN [0.2, 0.2, 0.3, 0.6, 0.9, 1.0][u.rating::INTEGER + 1] ELSE [1.0, 1.0, 0.8, 0.5, 0.3, 0.2][u.rating::INTEGER + 1] END::DOUBLE * CASE WHEN u.date::DATE < {_CUT} THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END)"""
_F = """f AS (SELECT o_orderkey AS id, o_orderpriority AS feature, c_mktsegment AS area, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Must' WHEN '2' THEN 'should' WHEN '3' THEN 'could' ELSE 'later' END AS priority,
  o_orderkey % 10 = 0 AS fix, CASE o_orderstatus WHEN 'F' THEN 'yes' WHEN 'O' THEN 'Partial' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'no' ELSE 'skip' END END AS clone,
  CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'why' END AS notes FROM orders JOIN customer ON c_custkey = o_custkey),
 s AS (SELECT *, CASE lower(priority) WHEN 'must' THEN 3 WHEN 'should' THEN 2 ELSE 1 END AS w, CASE lower(clone) WHEN 'yes' THEN 1.0 WHEN 'partial' THEN 0.5 ELSE 0.0 END::DOUBLE AS d FROM f WHERE NOT fix AND clone <> 'skip')"""
_B = """b AS (SELECT p_brand AS name, count(*)::DOUBLE AS o, max(p_size) * 2.0::DOUBLE AS c, count(*) % 2 = 0 AS higher FROM part GROUP BY 1),
 m AS (SELECT name, CASE WHEN higher THEN 'higher' ELSE 'lower' END AS better, (CASE WHEN higher THEN c - o ELSE o - c END) / greatest(abs(o), 1e-9) AS x FROM b),
 mm AS (SELECT name, better, CASE WHEN x > 0.02 THEN 'win' WHEN x < -0.02 THEN 'loss' ELSE 'tie' END AS result FROM m)"""
_CHECKS = """n AS (SELECT (SELECT count(DISTINCT source) FROM u) AS sources, (SELECT count(*) FROM u) AS reviews, (SELECT count(DISTINCT theme) FROM ids) AS themes,
  (SELECT count(*) FROM f) AS features, (SELECT count(*) FROM f WHERE priority = 'Must') AS musts),
 k AS (SELECT m.mode, c.* FROM n, (VALUES ('app'), ('site'), ('feature'), ('migrate')) m(mode), LATERAL (VALUES
  (1, 'sources', sources >= 3, sources::VARCHAR, 'all'), (2, 'reviews', reviews >= 30, reviews::VARCHAR, 'app feature'), (3, 'pains', themes >= 3, '0 errors, ' || themes, 'all'),
  (4, 'verdict', true, 'true', 'all'), (5, 'measured', false, '0', 'app site migrate'), (6, 'recon', true, 'true', 'all'), (7, 'features', features >= 5 AND musts >= 1, features::VARCHAR, 'all')) c(ord, name, ok, detail, modes)),
 ck AS (SELECT 'research' AS stage, mode, ord::INTEGER AS ord, name, CASE WHEN modes <> 'all' AND NOT contains(modes, mode) THEN 'skip' WHEN ok THEN 'pass' ELSE 'fail' END AS status, detail FROM k)"""

QUERIES = {
    "theme_summary": theme_summary, "theme_errors": theme_errors, "review_coverage": review_coverage, "review_first_uncovered": review_first_uncovered,
    "review_sources": review_sources, "review_sample": review_sample, "parity_areas": parity_areas, "parity_problems": parity_problems,
    "parity_missing": parity_missing, "parity_pivot": parity_pivot, "beat_metrics": beat_metrics, "parity_verdict": parity_verdict,
    "gate_checks": gate_checks, "gate_passes": gate_passes, "findings_totals": findings_totals,
}

ORACLES = {
    "theme_summary": f"""WITH {_R}, j AS (SELECT theme, kind, u.source, {_W} AS w FROM ids JOIN u USING (id)),
        g AS (SELECT i.theme, i.kind, count(w)::BIGINT AS reviews, coalesce(list_sort(list(DISTINCT lower(source)) FILTER (WHERE source IS NOT NULL)), []) AS s, coalesce(sum(w::DECIMAL(18,4)), 0)::DOUBLE AS w FROM (SELECT DISTINCT theme, kind FROM ids) i LEFT JOIN j USING (theme, kind) GROUP BY ALL)
        SELECT theme, kind, reviews, array_to_string(s, ',') AS sources, {sql_round('w', 1)} AS weight, reviews < 3 OR len(s) < 2 AS thin FROM g""",
    "theme_errors": f"""WITH {_R}, e AS (
        SELECT theme, 'unknown-row' AS rule FROM ids WHERE id NOT IN (SELECT id FROM u)
        UNION ALL SELECT theme, 'kind' FROM (SELECT DISTINCT theme, kind FROM ids) WHERE kind = 'odd'
        UNION ALL SELECT theme, 'no-rows' FROM (SELECT DISTINCT theme FROM ids) WHERE theme NOT IN (SELECT theme FROM ids WHERE id IN (SELECT id FROM u))
        UNION ALL SELECT theme, 'unknown-quote-row' FROM ids WHERE id NOT IN (SELECT id FROM u)
        UNION ALL SELECT theme, 'not-word-for-word' FROM ids WHERE id IN (SELECT id FROM u) AND pos % 3 = 0 AND substr(o_orderpriority, 1, 1) <> '5')
        SELECT rule, count(*)::BIGINT AS n FROM e GROUP BY ALL""",
    "review_coverage": f"""WITH {_R}, low AS (SELECT *, id IN (SELECT id FROM ids) AS hit FROM u WHERE rating::INTEGER BETWEEN 1 AND 2)
        SELECT floor(count(*) FILTER (WHERE hit) / count(*) * 100 + 0.5)::BIGINT AS coverage, count(*) FILTER (WHERE NOT hit)::BIGINT AS uncovered, (SELECT count(*) FROM r WHERE url = '')::BIGINT AS dropped FROM low""",
    "review_first_uncovered": f"""WITH {_R} SELECT id, rating, url, 'Order — of “' || o_orderpriority || '”' AS text FROM u WHERE rating::INTEGER BETWEEN 1 AND 2 AND id NOT IN (SELECT id FROM ids) ORDER BY pos LIMIT 15""",
    "review_sources": f"WITH {_R} SELECT lower(source) AS source, count(*)::BIGINT AS n FROM u GROUP BY 1",
    "review_sample": f"WITH {_R} SELECT count(*)::BIGINT AS reviews, min(date) AS first, max(date) AS last FROM u",
    "parity_areas": f"""WITH {_F} SELECT area, {sql_round('sum(w * d) / sum(w) * 100', 1)} AS score, count(*) FILTER (WHERE priority = 'Must')::BIGINT AS musts, count(*) FILTER (WHERE priority = 'Must' AND clone = 'yes')::BIGINT AS musts_done FROM s GROUP BY GROUPING SETS ((), (area))""",
    "parity_problems": f"""WITH {_F} SELECT problem, value, count(*)::BIGINT AS n FROM (SELECT 'priority' AS problem, lower(priority) AS value FROM f WHERE priority = 'later' UNION ALL SELECT 'skip-reason', feature FROM f WHERE clone = 'skip' AND notes = '') GROUP BY ALL""",
    "parity_missing": f"WITH {_F} SELECT id::VARCHAR AS id, feature, priority, clone, notes FROM s WHERE clone <> 'yes'",
    "parity_pivot": f"""WITH {_F} SELECT area, count(*) FILTER (WHERE lower(priority) = 'must')::BIGINT AS must, count(*) FILTER (WHERE priority = 'should')::BIGINT AS should, count(*) FILTER (WHERE priority = 'could')::BIGINT AS could FROM f WHERE NOT fix GROUP BY 1""",
    "beat_metrics": f"WITH {_B} SELECT * FROM mm",
    "parity_verdict": f"""WITH {_F}, {_B}, a AS (SELECT {sql_round('sum(w * d) / sum(w) * 100', 1)} AS parity, count(*) FILTER (WHERE priority = 'Must')::BIGINT AS musts, count(*) FILTER (WHERE priority = 'Must' AND clone = 'yes')::BIGINT AS musts_done FROM s),
        x AS (SELECT count(*) FILTER (WHERE clone = 'yes')::BIGINT AS built, count(*)::BIGINT AS planned FROM f WHERE fix), y AS (SELECT count(*) FILTER (WHERE result = 'win')::BIGINT AS wins, count(*) FILTER (WHERE result = 'loss')::BIGINT AS losses FROM mm)
        SELECT *, CASE WHEN musts_done < musts OR parity < 80 THEN 'not shippable' WHEN planned > 0 AND built >= least(3, planned) AND losses = 0 AND wins > 0 THEN 'better than the original' ELSE 'shippable' END AS verdict FROM a, x, y""",
    "gate_checks": f"WITH {_R}, {_F}, {_CHECKS} SELECT * FROM ck",
    "gate_passes": f"WITH {_R}, {_F}, {_CHECKS} SELECT stage, mode, NOT bool_or(status = 'fail') AS passed, arg_min(name, ord) FILTER (WHERE status = 'fail') AS next_action FROM ck GROUP BY ALL",
    "findings_totals": "SELECT sum(e)::BIGINT AS errors, max(w)::BIGINT AS warnings FROM (SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS e, count(*) FILTER (WHERE l_linestatus = 'O') AS w FROM lineitem GROUP BY 1)",
}
