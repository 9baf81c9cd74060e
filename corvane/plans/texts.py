"""Text queries: sentences, shingles, copied sentences, slugs, edit distance, lint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import copy_rules as R
from corvane.operators import lint, similarity
from corvane.operators.tokens import value_counts
from corvane.plans.common import _q, sql_fold, sql_sentences, sql_shingles, sql_squash, sql_words, table


def copy_hits(spark: SparkSession, d: str) -> DataFrame:
    return similarity.copy_hits(table(spark, d, "documents"), table(spark, d, "benchmark"))


def copy_hits_capped(spark: SparkSession, d: str) -> DataFrame:
    capped = similarity.cap_per_group(copy_hits(spark, d), ["doc_id"], ["sent_pos"], 2)
    return capped.select("doc_id", "sent_pos", "containment", "shared", "rank", "rest")


def text_stats(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    w = table(spark, d, "documents").select("doc_id", T.words(t).alias("w"), T.sentences(t).alias("s"))
    return w.select("doc_id", F.size("w").cast("long").alias("n_words"), F.size("s").cast("long").alias("n_sentences"), F.size(T.shingles(F.col("w"), 5)).cast("long").alias("n_shingles"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


def comparable_sentences(spark: SparkSession, d: str) -> DataFrame:
    s = similarity.comparable(table(spark, d, "benchmark"), ["item_id"])
    return s.select("item_id", "sent_pos", "sentence", F.size("w").cast("long").alias("n_words"))


def slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.slug(F.col("text")).alias("slug"))


def ident_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", F.array_join(T.ident_words(F.col("c_name")), " ").alias("words"), T.contains_run(T.ident_words(F.col("c_name")), F.array(F.lit("customer"))).alias("named"))


def name_similarity(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    before = F.lag("p_name").over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    return p.withColumn("before", before).where("before is not null").select("p_partkey", T.round_half_up(T.similarity(F.col("p_name"), F.col("before")), 6).alias("similarity"))


def grapheme_lengths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", T.graphemes(F.col("text")).cast("long").alias("n_graphemes"), F.length("text").cast("long").alias("n_chars"))


def top_words(spark: SparkSession, d: str) -> DataFrame:
    """The 25 most frequent words of each language (a top-k report)."""
    w = table(spark, d, "documents").select("lang", F.explode(T.words(F.col("text"))).alias("value")).withColumn("count", F.lit(1))
    return value_counts(w, ["lang"], top=25).select("lang", "value", F.col("count").cast("long").alias("count"), F.col("rank").cast("long").alias("rank"))


def exact_copies(spark: SparkSession, d: str) -> DataFrame:
    doc = table(spark, d, "documents").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("digest"))
    g = doc.groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"))
    return g.where("copies > 1")


def _items(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    kind = F.when(F.col("role") == "user", "heading").when(F.col("role") == "assistant", "text").otherwise("button")
    return c.select(F.col("conv_id").cast("string").alias("source_id"), F.col("turn").cast("long").alias("pos"), kind.alias("kind"), F.col("text").alias("t"))


#: Words of the synthetic corpus as extra rules, since the default ones hardly occur in it.
EXTRA_WORDS = [("the", 1, "say which"), ("and", 2, "split it"), ("with", 3, "say how")]


def lint_predicates(spark: SparkSession, d: str) -> DataFrame:
    return lint.predicates(lint.prepared(_items(spark, d))).select("source_id", "pos", "level", "rule")


def lint_tally(spark: SparkSession, d: str) -> DataFrame:
    m = lint.matches(lint.prepared(_items(spark, d)), words=EXTRA_WORDS, patterns=[])
    return lint.tally(m).select("source_id", "pos", "level", "rule", "detail")


def lint_rules_join(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame([(w, lint.word_rule(w), t, f) for w, t, f in EXTRA_WORDS], "rule string, pattern string, tier int, advice string")
    m = lint.matches_of_rules(lint.prepared(_items(spark, d)), rules)
    return m.groupBy("rule", "tier").agg(F.count("*").alias("n"))


def lint_totals(spark: SparkSession, d: str) -> DataFrame:
    return lint.totals(lint.predicates(lint.prepared(_items(spark, d))))


def lint_repeated_cta(spark: SparkSession, d: str) -> DataFrame:
    """Repeated labels, with document sources as labels of the same button."""
    docs = table(spark, d, "documents")
    items = docs.select(F.col("lang").alias("source_id"), F.col("doc_id").alias("pos"), F.lit("button").alias("kind"), F.col("source").alias("t"))
    return lint.repeated_cta(lint.prepared(items)).select("source_id", "pos", "text", "detail")


def _comparable(key: str, table_: str) -> str:
    generic = "[" + ", ".join("[" + ", ".join(_q(w) for w in sorted(set(p.split()))) + "]" for p in similarity.GENERIC_PHRASES) + "]"
    return f"""
SELECT * FROM (
  SELECT key, (z[1] - 1)::INTEGER AS sent_pos, x[z[1]] AS sentence, {sql_words('x[z[1]]')} AS w
  FROM (SELECT key, x, unnest(list_transform(range(1, len(x) + 1), lambda i: [i])) AS z FROM (SELECT {key} AS key, {sql_sentences('text')} AS x FROM {table_})))
WHERE len(w) >= 6 AND NOT list_bool_or(list_transform({generic}, lambda p: len(list_filter(w, lambda x: list_contains(p, x))) / len(w) >= 0.7))
"""


_HITS = f"""
WITH mine AS ({_comparable('doc_id', 'documents')}),
theirs AS ({_comparable('item_id', 'benchmark')}),
og AS (SELECT DISTINCT key AS item_id, sent_pos AS o_pos, sentence AS original, unnest({sql_shingles('w', 5)}) AS gram FROM theirs),
mg AS (SELECT key AS doc_id, sent_pos, sentence, len(w) - 4 AS n, unnest(list_zip({sql_shingles('w', 5)}, range(0, len(w) - 4))) AS g FROM mine),
hit AS (SELECT doc_id, sent_pos, sentence, n, g[2] AS pos FROM mg WHERE g[1] IN (SELECT gram FROM og)),
isl AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, sent_pos ORDER BY pos) AS isle FROM hit),
runs AS (SELECT doc_id, sent_pos, sentence, n, isle, count(*) AS run FROM isl GROUP BY ALL),
sc AS (SELECT doc_id, sent_pos, sentence, n, sum(run)::BIGINT AS hits, (max(run) + 4)::BIGINT AS shared FROM runs GROUP BY ALL),
votes AS (SELECT doc_id, sent_pos, item_id, o_pos, original, count(*) AS v, min(g[2]) AS f FROM mg JOIN og ON og.gram = g[1] GROUP BY ALL),
best AS (SELECT * FROM votes QUALIFY row_number() OVER (PARTITION BY doc_id, sent_pos ORDER BY v DESC, f, item_id, o_pos) = 1)
SELECT sc.doc_id, sc.sent_pos, sc.sentence, best.original, floor(hits / n * 100 + 0.5)::BIGINT AS containment, shared
FROM sc JOIN best USING (doc_id, sent_pos) WHERE hits / n >= 0.5 OR shared >= 10
"""
_ITEMS = f"""
SELECT conv_id::VARCHAR AS source_id, turn AS pos, CASE role WHEN 'user' THEN 'heading' WHEN 'assistant' THEN 'text' ELSE 'button' END AS kind, {sql_squash('text')} AS t
FROM conversations WHERE {sql_squash('text')} <> ''
"""


def _re2(pattern: str) -> str:
    """A rule's pattern for an engine whose \\b is ASCII."""
    return _q(pattern)


_FOUND = " UNION ALL ".join(
    ["SELECT source_id, pos, 'error' AS level, 'placeholder' AS rule FROM p WHERE " + " OR ".join(f"regexp_matches(t, {_re2(x)}, '{'i' if i else 'c'}')" for x, i in R.PLACEHOLDERS)]
    + [f"SELECT source_id, pos, 'error', 'proof:{i}' FROM p WHERE regexp_matches(low, {_re2(x)}, 'i')" for i, x in R.PROOF]
    + [
        "SELECT source_id, pos, 'warning', 'exclamation' FROM p WHERE kind IN ('heading', 'button') AND contains(t, '!')",
        "SELECT source_id, pos, 'warning', 'emoji' FROM p WHERE kind IN ('heading', 'button') AND regexp_matches(t, '" + T.EMOJI.replace("'", "''") + "')",
        rf"SELECT source_id, pos, 'warning', 'generic-button' FROM p WHERE kind = 'button' AND trim(regexp_replace(low, '[^\p{{L}}\p{{N}} ]', '', 'g')) IN ({', '.join(_q(b) for b in R.GENERIC_BUTTONS)})",
        "SELECT source_id, pos, 'warning', 'vague-error' FROM p WHERE " + " OR ".join(f"contains(low, {_q(v)})" for v in R.VAGUE_ERRORS),
    ]
)
_PREPARED = f"WITH items AS ({_ITEMS}), p AS (SELECT *, lower({sql_fold('t')}) AS low FROM items)"
_MATCH = "m AS (" + " UNION ALL ".join(rf"SELECT *, 'word:{w}' AS rule, {t} AS tier, {_q(f)} AS advice FROM p WHERE regexp_matches(low, '(?:^|[^\p{{L}}-]){w}(?:[^\p{{L}}-]|$)')" for w, t, f in EXTRA_WORDS) + ")"

QUERIES = {
    "copy_hits": copy_hits, "copy_hits_capped": copy_hits_capped, "text_stats": text_stats, "comparable_sentences": comparable_sentences, "slugs": slugs,
    "ident_words": ident_words, "name_similarity": name_similarity, "grapheme_lengths": grapheme_lengths, "top_words": top_words, "exact_copies": exact_copies,
    "lint_predicates": lint_predicates, "lint_tally": lint_tally, "lint_rules_join": lint_rules_join, "lint_totals": lint_totals,
    "lint_repeated_cta": lint_repeated_cta,
}

ORACLES = {
    "copy_hits": _HITS,
    "copy_hits_capped": f"""SELECT doc_id, sent_pos, containment, shared, rank::INTEGER AS rank, greatest(0, n - 2)::BIGINT AS rest FROM (
        SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sent_pos) AS rank, count(*) OVER (PARTITION BY doc_id) AS n FROM ({_HITS})) WHERE rank <= 2""",
    "text_stats": f"""SELECT doc_id, len(w)::BIGINT AS n_words, len(s)::BIGINT AS n_sentences, greatest(len(w) - 4, 0)::BIGINT AS n_shingles, len(list_distinct(w))::BIGINT AS n_distinct
        FROM (SELECT doc_id, {sql_words('text')} AS w, {sql_sentences('text')} AS s FROM documents)""",
    "comparable_sentences": f"SELECT key AS item_id, sent_pos, sentence, len(w)::BIGINT AS n_words FROM ({_comparable('item_id', 'benchmark')})",
    "slugs": f"""SELECT doc_id, coalesce(nullif(regexp_replace(substr(regexp_replace(regexp_replace(regexp_replace(lower({sql_fold('text')}), '^https?://', ''), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), '-+$', ''), ''), 'page') AS slug FROM documents""",
    "ident_words": r"""SELECT c_custkey, array_to_string(w, ' ') AS words, list_contains(w, 'customer') AS named FROM (
        SELECT c_custkey, list_filter(string_split_regex(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(c_name, '([a-z\d])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '([A-Za-z])(\d)', '\1 \2', 'g'), '(\d)([A-Za-z])', '\1 \2', 'g')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM customer)""",
    "name_similarity": """SELECT p_partkey, floor((CASE WHEN greatest(length(p_name), length(b)) = 0 THEN 1.0 ELSE 1 - levenshtein(lower(p_name), lower(b)) / greatest(length(p_name), length(b)) END) * 1000000.0 + 0.5) / 1000000.0 AS similarity
        FROM (SELECT p_partkey, p_name, lag(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS b FROM part) WHERE b IS NOT NULL""",
    "grapheme_lengths": "SELECT conv_id, turn, length_grapheme(text)::BIGINT AS n_graphemes, length(text)::BIGINT AS n_chars FROM conversations",
    "top_words": f"""SELECT lang, value, count, rank FROM (SELECT lang, value, count(*)::BIGINT AS count, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, value)::BIGINT AS rank
        FROM (SELECT lang, unnest({sql_words('text')}) AS value FROM documents) GROUP BY lang, value) WHERE rank <= 25""",
    "exact_copies": "SELECT sha256(text) AS digest, count(*)::BIGINT AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "lint_predicates": f"{_PREPARED} {_FOUND}",
    "lint_totals": f"""{_PREPARED}, f AS ({_FOUND}), n AS (SELECT source_id, count(*) FILTER (WHERE level = 'error')::BIGINT AS errors, count(*) FILTER (WHERE level = 'warning')::BIGINT AS warnings, count(*) FILTER (WHERE level = 'note')::BIGINT AS notes FROM f GROUP BY 1)
        SELECT *, errors = 0 AND warnings <= 3 AS passes FROM n""",
    "lint_tally": f"""{_PREPARED}, {_MATCH}, g AS (SELECT source_id, rule, tier, advice, count(*) AS n, min(pos) AS pos, arg_min(kind, pos) IN ('heading', 'button') AS control FROM m GROUP BY ALL)
        SELECT source_id, pos, CASE WHEN tier = 1 THEN 'warning' WHEN tier = 2 AND n >= 2 THEN 'warning' ELSE 'note' END AS level, rule,
               CASE WHEN tier = 3 OR n = 1 THEN advice ELSE advice || ' (' || n || ' times)' END AS detail FROM g WHERE NOT (tier = 1 AND control)
        UNION ALL SELECT source_id, pos, 'warning', rule, advice FROM m WHERE tier = 1 AND kind IN ('heading', 'button')""",
    "lint_rules_join": f"{_PREPARED}, {_MATCH} SELECT replace(rule, 'word:', '') AS rule, tier::INTEGER AS tier, count(*)::BIGINT AS n FROM m GROUP BY ALL",
    "lint_repeated_cta": """SELECT lang AS source_id, min(doc_id) AS pos, arg_min(source, doc_id) AS text, '"' || arg_min(source, doc_id) || '" is on ' || count(*) || ' buttons.' AS detail FROM documents GROUP BY lang, source HAVING count(*) >= 3""",
}
