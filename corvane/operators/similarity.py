"""Copied sentences: word 5-gram containment and longest shared run against a set of originals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import round_half_up, sentences, words
from corvane.session import small

GRAM, LEAST_WORDS, GENERIC_SHARE = 5, 6, 0.7
LEAST_CONTAINMENT, LEAST_RUN = 0.5, 10
BROADCAST_CHARS, FLAGGED_ROWS = 4_000_000, 200_000

# Phrases that every product writes the same way.
GENERIC_PHRASES = [
    "by continuing you agree to our terms of service and privacy policy",
    "by signing up you agree to our terms of service and privacy policy",
    "all rights reserved",
    "forgot your password",
    "don't have an account sign up",
    "already have an account sign in",
    "already have an account log in",
    "we use cookies to improve your experience",
    "this site uses cookies",
    "enter your email address",
    "enter your email to get started",
    "remember me",
    "sign in with google",
    "continue with google",
    "continue with apple",
    "sign up with google",
    "check your email for a link to reset your password",
    "we sent you an email",
    "please enter a valid email address",
    "this field is required",
    "page not found",
    "the page you are looking for doesn't exist",
    "no results found",
    "are you sure you want to delete this",
    "this action cannot be undone",
    "changes saved",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "contact us",
    "frequently asked questions",
    "cancel anytime",
    "no credit card required",
    "start your free trial",
]


def is_generic(w: Column, phrases: list[str] = GENERIC_PHRASES, share: float = GENERIC_SHARE) -> Column:
    """Whether some phrase's words make up the share of w, repeats counted.

    The words of all phrases together are tried first, by one hash lookup a word; few sentences go further.
    """
    own = [sorted(set(p.split())) for p in phrases]
    part = lambda words_: F.size(F.filter(w, lambda x: x.isin(*words_))) / F.size(w) >= share
    some = part(sorted({x for p in own for x in p}))
    for_any = part(own[0])
    for p in own[1:]:
        for_any = for_any | part(p)
    return some & for_any


def comparable(texts: DataFrame, keys: list[str], text: str = "text", phrases: list[str] = GENERIC_PHRASES) -> DataFrame:
    """keys, sent_pos, sentence, w (words): sentences of six words or more that are not generic.

    Words are computed before the sentences are exploded, so that later references read a column.
    """
    pairs = F.transform(sentences(F.col(text)), lambda s: F.struct(s.alias("sentence"), words(s).alias("w")))
    s = texts.select(*keys, F.posexplode(pairs).alias("sent_pos", "s")).select(*keys, "sent_pos", "s.sentence", "s.w")
    s = s.where(F.size("w") >= LEAST_WORDS)
    return s.where(~is_generic(F.col("w"), phrases)) if phrases else s


def gram_keys(w: Column, n: int = GRAM) -> Column:
    """64-bit hashes of the word n-grams, in order."""
    return F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(n)]))


def longest_run(places: Column) -> Column:
    """Length of the longest run of consecutive numbers in a sorted array of distinct ones."""
    start = F.struct(F.lit(-2).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(a: Column, p: Column) -> Column:
        run = F.when(p == a["last"] + 1, a["run"] + 1).otherwise(F.lit(1))
        return F.struct(p.alias("last"), run.alias("run"), F.greatest(a["most"], run).alias("most"))

    return F.aggregate(places, start, step, lambda a: a["most"])


def copy_hits(texts: DataFrame, originals: DataFrame, key: str = "doc_id", original_key: str = "item_id", phrases: list[str] = GENERIC_PHRASES) -> DataFrame:
    """key, sent_pos, sentence, original, containment (percent), shared (words in a row).

    A sentence counts if half of its 5-grams, or ten words in a row, stand in the originals; its original is the one
    with most of them. Both sides are numbers until the end: texts become (key, sentence, place, gram hash) rows, and
    only those whose gram the originals have are shuffled, once, by key; runs come from each sentence's array of
    places. The flagged sentences then fetch their text, and phrases that everyone writes are left out. The originals'
    grams are broadcast while their text is short, else both sides are shuffled by gram. Equal hashes count as equal
    grams (64 bits).
    """
    source = comparable(originals, [original_key], phrases=phrases)
    index = source.select(F.explode(gram_keys(F.col("w"))).alias("gram"), F.col(original_key).alias("o_key"), F.col("sent_pos").alias("o_pos")).distinct()
    size = originals.agg(F.sum(F.length("text"))).first()[0] or 0
    mine = comparable(texts, [key], phrases=[])
    rows = mine.select(key, "sent_pos", (F.size("w") - GRAM + 1).alias("n"), F.posexplode(gram_keys(F.col("w"))).alias("pos", "gram"))
    found = rows.join(F.broadcast(index) if size <= BROADCAST_CHARS else index, "gram").repartition(key)
    votes = found.groupBy(key, "sent_pos", "n", "o_key", "o_pos").agg(F.collect_set("pos").alias("places"))
    rank = F.struct(F.size("places").alias("votes"), (-F.array_min("places")).alias("first"), (-F.col("o_key")).alias("o"), (-F.col("o_pos")).alias("p"))
    per = votes.groupBy(key, "sent_pos", "n").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"), F.max_by(F.struct("o_key", "o_pos"), rank).alias("best"))
    per = per.withColumn("hits", F.size("places")).withColumn("shared", (longest_run(F.col("places")) + GRAM - 1).cast("long"))
    flagged = per.where((F.col("hits") / F.col("n") >= LEAST_CONTAINMENT) | (F.col("shared") >= LEAST_RUN))
    percent = round_half_up(F.col("hits") / F.col("n") * 100).cast("long")
    flagged = flagged.select(F.col(key).alias("_key"), F.col("sent_pos").alias("_pos"), percent.alias("containment"), "shared", "best.o_key", "best.o_pos").persist()
    flagged = small(flagged, FLAGGED_ROWS)  # so that few flagged sentences fetch their text without a shuffle of all texts
    text = texts.select(key, "text").join(flagged, F.col(key) == F.col("_key")).withColumn("sentence", F.element_at(sentences(F.col("text")), F.col("_pos") + 1))
    text = text.where(~is_generic(words(F.col("sentence")), phrases)) if phrases else text
    named = source.select(F.col(original_key).alias("o_key"), F.col("sent_pos").alias("o_pos"), F.col("sentence").alias("original"))
    return text.join(named, ["o_key", "o_pos"]).select(key, F.col("_pos").alias("sent_pos"), "sentence", "original", "containment", "shared")


def cap_per_group(hits: DataFrame, group: list[str], order: list, most: int = 5) -> DataFrame:
    """The first rows of each group and, on each, how many more the group has."""
    w = Window.partitionBy(*group)
    ranked = hits.withColumn("rank", F.row_number().over(w.orderBy(*order))).withColumn("rest", F.greatest(F.lit(0), F.count("*").over(w) - most))
    return ranked.where(F.col("rank") <= most)
