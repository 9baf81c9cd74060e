"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Each source gets a mean repetition rate so that its expected share of all characters equals its target weight.
A document's number of copies is a Poisson variable with that mean, found by inverting the distribution at a
uniform number hashed from seed and doc_id, so that the result does not depend on partitions or retries. Copies
are exploded and shuffled globally by a second hash: partition by its high part, sorted within. A mean above
MOST_RATE is drawn as a sum of independent draws of equal means, so rates have no upper bound; copies are exploded
in runs of RUN numbers, so that no row holds a long array.

Only one row a source is aggregated (after partial sums in every partition). That table is broadcast while the
number of sources is at most BROADCAST_SOURCES; beyond it is joined with salted keys, so that a source with a
third of all rows spreads over SALTS tasks.

The input's columns travel as one struct, so none of their names can clash with the operator's own.

Defined results: null and empty texts weigh nothing and take their source's rate; null sources form one source;
repeated rows (same doc_id) get the same number of copies; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import cut

BROADCAST_SOURCES, SALTS, RUN = 10_000, 64, 10_000
TASK_CHARS = 64_000_000  # characters of the result that one task of the last sort holds
MOST_RATE = 500.0  # the largest mean of a single draw: exp(-mean) stays far from the least double
SEED = "mix-1"
ADDED = ("mix_rate", "mix_copy", "mix_key")


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 48 bits of an MD5 digest."""
    digest = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(2**48))


def poisson_inverse(u: Column, mean: Column) -> Column:
    """Least k whose cumulative Poisson probability exceeds u; the search is long enough for u < 1 - 2**-48."""
    most = F.ceil(mean + 9 * F.sqrt(mean) + 30).cast("int")
    start = F.struct(F.lit(0).cast("int").alias("k"), F.exp(-mean).alias("p"), F.exp(-mean).alias("c"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * mean / k
        return F.when(s["c"] > u, s).otherwise(F.struct(k.alias("k"), p.alias("p"), (s["c"] + p).alias("c")))

    return F.aggregate(F.sequence(F.lit(1), most), start, step, lambda s: s["k"])


def poisson(mean: Column, *parts: Column) -> Column:
    """Poisson number of any mean from hashes of parts: one draw up to MOST_RATE, else the sum of several of equal means."""
    pieces = F.greatest(F.ceil(mean / MOST_RATE), F.lit(1).cast("long"))

    def add(n: Column, i: Column) -> Column:
        u = F.when(i == 0, uniform(*parts)).otherwise(uniform(*parts, i.cast("string")))
        return n + poisson_inverse(u, mean / pieces)

    return F.aggregate(F.sequence(F.lit(0).cast("long"), pieces - 1), F.lit(0).cast("long"), add)


def _source(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def _rates(docs: DataFrame, weights: dict[str, float], other: float, total: float | None) -> tuple[DataFrame, float]:
    size = F.sum(F.length(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("chars")
    w = F.lit(float(other))
    for name, value in weights.items():
        w = F.when(F.col("mix_source") == name, F.lit(float(value))).otherwise(w)
    per = cut(docs.groupBy(_source(F.col("source")).alias("mix_source")).agg(size).withColumn("w", w))
    chars, weight = per.agg(F.sum("chars"), F.sum(F.when(F.col("chars") > 0, F.col("w")))).first()
    goal = float(total if total is not None else chars or 0)
    rate = F.when(F.col("chars") > 0, F.lit(goal) * F.col("w") / F.lit(float(weight or 1)) / F.col("chars")).otherwise(F.lit(1.0))
    return per.select("mix_source", rate.alias("mix_rate")), goal


def rates(docs: DataFrame, weights: dict[str, float], other: float = 1.0, total: float | None = None) -> DataFrame:
    """(mix_source, mix_rate): mean repetitions that bring each source to its share of `total` (by default all) characters.

    Sources not named in weights have weight `other`. Sources without characters get rate 1.
    """
    return _rates(docs, weights, other, total)[0]


def draw(docs: DataFrame, weights: dict[str, float], other: float = 1.0, total: float | None = None, seed: str = SEED, partitions: int | None = None) -> DataFrame:
    """(doc, mix_rate, mix_copy, mix_key): each copy's row as struct `doc`, in global random order by mix_key.

    The order is cut into `partitions` tasks, by default one for each TASK_CHARS characters of the result, and no
    fewer than spark.sql.shuffle.partitions.
    """
    spark = docs.sparkSession
    rate, goal = _rates(docs, weights, other, total)
    keyed = docs.select(F.struct("*").alias("doc"), _source(F.col("source")).alias("mix_source"), F.col("doc_id").cast("string").alias("mix_id"))
    if rate.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        joined = keyed.join(F.broadcast(rate), "mix_source")
    else:
        salted = rate.withColumn("mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.withColumn("mix_salt", F.pmod(F.xxhash64("mix_id"), F.lit(SALTS)).cast("int")).join(salted, ["mix_source", "mix_salt"])
    doc = F.coalesce("mix_id", F.lit(""))
    copies = poisson(F.col("mix_rate"), F.lit(seed), doc)
    out = joined.withColumn("mix_copies", copies).where("mix_copies > 0")
    out = out.withColumn("mix_from", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies"), F.lit(RUN).cast("long"))))
    out = out.withColumn("mix_copy", F.explode(F.sequence(F.col("mix_from").cast("int"), F.least(F.col("mix_from") + RUN - 1, "mix_copies").cast("int"))))
    out = out.withColumn("mix_key", F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), doc, F.col("mix_copy").cast("string")).cast("binary")))
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(goal // TASK_CHARS) + 1)
    out = out.select("doc", F.round("mix_rate", 6).alias("mix_rate"), "mix_copy", "mix_key")
    return out.repartition(n, F.substring("mix_key", 1, 8)).sortWithinPartitions("mix_key")


def mix(docs: DataFrame, weights: dict[str, float], other: float = 1.0, total: float | None = None, seed: str = SEED, partitions: int | None = None) -> DataFrame:
    """Copies of docs in global random order: its columns, then mix_rate, mix_copy (from 1) and mix_key (the order).

    Columns of docs with a name of the three are replaced.
    """
    own = [c for c in docs.columns if c.lower() not in ADDED]
    return draw(docs.select(own), weights, other, total, seed, partitions).select("doc.*", *ADDED)


def mix_rows(docs: DataFrame, weights: dict[str, float], other: float = 1.0, total: float | None = None, seed: str = SEED, partitions: int | None = None) -> DataFrame:
    """The same copies with the columns of docs alone, whatever their names."""
    return draw(docs, weights, other, total, seed, partitions).select("doc.*")


# Production parameters of the registered query: sources src0 to src4 are wanted twice as much as the others.
TARGET = {f"src{i}": 2.0 for i in range(5)}

ORACLE = f"""
WITH docs AS (SELECT doc_id, text, lang, source, n_chars, coalesce(source, '') AS s FROM documents),
per AS (
  SELECT s, sum(length(coalesce(text, ''))) AS chars,
         CASE WHEN s IN ({', '.join(f"'{k}'" for k in TARGET)}) THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM docs GROUP BY s),
tot AS (SELECT sum(chars)::DOUBLE AS all_chars, sum(w) FILTER (WHERE chars > 0) AS all_w FROM per),
rate AS (
  SELECT s, r, greatest(ceil(r / {MOST_RATE}), 1)::BIGINT AS pieces, r / greatest(ceil(r / {MOST_RATE}), 1) AS m
  FROM (SELECT s, CASE WHEN chars > 0 THEN all_chars * w / all_w / chars ELSE 1.0 END AS r FROM per, tot)),
drawn AS (
  SELECT doc_id, text, lang, source, n_chars, s, r, i,
         ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '') || CASE WHEN i = 0 THEN '' ELSE '|' || i::VARCHAR END), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 AS u
  FROM (SELECT d.*, rate.r, unnest(range(0, rate.pieces)) AS i FROM docs d JOIN rate ON d.s = rate.s)),
steps AS (
  SELECT s, k, sum(CASE WHEN k = 0 THEN exp(-m) ELSE exp(-m + k * ln(m) - lgamma(k + 1)) END) OVER (PARTITION BY s ORDER BY k) AS c
  FROM (SELECT s, m, unnest(range(0, ceil(m + 9 * sqrt(m) + 31)::BIGINT)) AS k FROM rate)),
n AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, d.r, count(*) FILTER (WHERE st.c <= d.u) AS copies
  FROM drawn d JOIN steps st ON st.s = d.s GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, round(r, 6) AS mix_rate, c::INTEGER AS mix_copy,
       md5('{SEED}|order|' || coalesce(doc_id::VARCHAR, '') || '|' || c::VARCHAR) AS mix_key
FROM (SELECT *, unnest(range(1, copies + 1)) AS c FROM n WHERE copies > 0)
"""
