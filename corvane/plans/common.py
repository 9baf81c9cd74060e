"""Table access and SQL fragments that several plans' oracles share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.functions.text import DASHES, QUOTES
from corvane.session import spread

#: Tables whose rows cost much more to work on than to read, and their keys.
TEXTS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, TEXTS[name]) if name in TEXTS else df


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_squash(t: str) -> str:
    return rf"trim(regexp_replace(coalesce({t}, ''), '\s+', ' ', 'g'))"


def sql_fold(t: str) -> str:
    plain = "".join(QUOTES.values()) + "-" * len(DASHES) + " "
    return sql_squash(f"replace(translate(coalesce({t}, ''), {_q(''.join(QUOTES) + DASHES + chr(160))}, {_q(plain)}), '…', '...')")


def sql_words(t: str) -> str:
    parts = rf"string_split_regex(lower({sql_fold(t)}), '[^\p{{L}}\p{{N}}'']+')"
    return f"list_filter(list_transform({parts}, lambda w: trim(w, '''')), lambda w: w <> '')"


def sql_sentences(t: str) -> str:
    split = rf"string_split_regex(regexp_replace(coalesce({t}, ''), '([.!?])\s+', '\1' || chr(10), 'g'), '\n+')"
    return f"list_filter(list_transform({split}, lambda s: {sql_squash('s')}), lambda s: s <> '')"


def sql_shingles(w: str, n: int) -> str:
    return f"list_transform(range(1, greatest(len({w}) - {n} + 2, 1)), lambda i: array_to_string(list_slice({w}, i, i + {n - 1}), ' '))"


def sql_round(x: str, places: int = 0) -> str:
    k = float(10**places)
    return f"(floor(({x}) * {k} + 0.5) / {k})"
