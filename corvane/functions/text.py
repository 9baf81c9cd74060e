"""Text functions, Column to Column. Patterns are written for Java's regular expressions.

White space means every Unicode space; word boundaries are spelled out as ASCII look-arounds, because Java's \\b
follows Unicode. Lengths count code points.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPACE = r"(?U)\s+"
NOT_WORD = r"[^\p{L}\p{N}']+"
# Characters that compare as plain ones.
QUOTES = {"‘": "'", "’": "'", "‚": "'", "‛": "'", "′": "'", "“": '"', "”": '"', "„": '"', "‟": '"', "″": '"'}
DASHES = "‐‑‒–—―−"
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B50}\x{2B55}\x{231A}\x{231B}\x{23E9}-\x{23F3}\x{1F004}\x{1F0CF}\x{1F1E6}-\x{1F1FF}©®]"


def squash(s: Column) -> Column:
    """Runs of white space become one blank, ends are trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(s, F.lit("")), SPACE, " "))


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility normalisation, for text that is not plain ASCII (Spark has no such function)."""
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFKC", x))


def fold(s: Column, normalize: bool = False) -> Column:
    """Typographic quotes, dashes and ellipses become plain ones; normalize adds NFKC, at the cost of Python."""
    s = F.coalesce(s, F.lit(""))
    if normalize:
        s = nfkc(s)
    plain = "".join(QUOTES.values()) + "-" * len(DASHES) + " "
    s = F.translate(s, "".join(QUOTES) + DASHES + "\u00a0", plain)
    return squash(F.replace(s, F.lit("…"), F.lit("...")))


def words(s: Column, normalize: bool = False) -> Column:
    """Lower-case words of letters, digits and inner apostrophes."""
    parts = F.split(F.lower(fold(s, normalize)), NOT_WORD)
    return F.filter(F.transform(parts, lambda w: F.regexp_replace(w, "^'+|'+$", "")), lambda w: w != "")


def ident_words(s: Column) -> Column:
    """The words inside an identifier: camelCase, ACRONYMWord and digit edges split, lower case."""
    s = F.coalesce(s, F.lit(""))
    for edge in (r"([a-z\d])([A-Z])", r"([A-Z]+)([A-Z][a-z])", r"([A-Za-z])(\d)", r"(\d)([A-Za-z])"):
        s = F.regexp_replace(s, edge, "$1 $2")
    return F.filter(F.split(F.lower(s), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def contains_run(hay: Column, needle: Column) -> Column:
    """Whether array needle stands in array hay as one run; an empty needle does not."""
    pad = lambda a: F.concat(F.lit(" "), F.array_join(a, " "), F.lit(" "))
    return (F.size(needle) > 0) & F.contains(pad(hay), pad(needle))


def sentences(s: Column) -> Column:
    """Parts after . ! ? and white space, or at line breaks, squashed, without empty ones."""
    parts = F.split(F.coalesce(s, F.lit("")), r"(?<=[.!?])(?U:\s)+|\n+")
    return F.filter(F.transform(parts, squash), lambda x: x != "")


def shingles(w: Column, n: int) -> Column:
    """Word n-grams joined by blanks; none if there are fewer words."""
    grams = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
    return F.when(F.size(w) >= n, grams).otherwise(F.array().cast("array<string>"))


def slug(s: Column, most: int = 60) -> Column:
    """A file-safe name, `page` if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(fold(s)), "^https?://", ""), "[^a-z0-9]+", "-")
    s = F.regexp_replace(F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, most), "-+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("page"))


def graphemes(s: Column) -> Column:
    """User-perceived characters."""
    return F.regexp_count(F.coalesce(s, F.lit("")), F.lit(r"\X"))


def has_emoji(s: Column) -> Column:
    return F.coalesce(s, F.lit("")).rlike(EMOJI)


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length, in any letter case; two empty strings are alike."""
    a, b = F.lower(a), F.lower(b)
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longer)


def round_half_up(x: Column, places: int = 0) -> Column:
    """.5 goes towards plus infinity, also below zero."""
    k = float(10**places)
    return F.floor(x * k + 0.5) / k


def truncate(s: Column, width: int) -> Column:
    """Longer strings end in an ellipsis within the width."""
    return F.when(F.length(s) > width, F.concat(F.substring(s, 1, width - 1), F.lit("…"))).otherwise(s)


def button_label(s: Column) -> Column:
    """Lower case, letters, digits and blanks only."""
    return F.trim(F.regexp_replace(F.lower(fold(s)), r"[^\p{L}\p{N} ]", ""))


def markdown_visible(line: Column) -> Column:
    """The text a reader sees of a markdown line: link labels, no inline code, no heading or list mark."""
    s = F.regexp_replace(line, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    s = F.regexp_replace(F.regexp_replace(s, "`[^`]*`", " "), r"^#{1,6}\s+|^[-*]\s+", "")
    return F.trim(s)


def demote_headings(s: Column) -> Column:
    """Without the title line, every heading one level deeper."""
    return F.regexp_replace(F.regexp_replace(s, r"(?m)\A# .*\n+", ""), r"(?m)^(#+ )", "#$1")
