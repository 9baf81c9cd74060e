"""Leak sweep: names, domains, colours, drawing paths and images of the original in a project's files.

Files are rows path, content or path, line, text. Avoid-lists are tiny dimension tables written by hand, so theta
joins against them broadcast the list; fingerprint joins are plain equi joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import color as C
from corvane.functions.text import contains_run, ident_words
from corvane.functions.urls import PATH_ATTRIBUTE, host, path_hash
from corvane.session import small

LONG_LINE, COLOR_DISTANCE, IMAGE_BYTES = 4000, 3.0, 20_000_000
CODE = r"(?i)\.(css|scss|sass|less|tsx?|jsx?|mjs|cjs|json|html?|svg|vue|svelte|astro|mdx?|ya?ml|toml|txt)$"
KIND_RANK = ("runtime", "image", "svg", "name", "domain", "color", "copy")
ALLOW_MARK = "sweep-allow"


def names(*lists: DataFrame) -> DataFrame:
    """Distinct identifier-word lists of all names."""
    out = lists[0].select("name")
    for x in lists[1:]:
        out = out.union(x.select("name"))
    return out.select(ident_words(F.col("name")).alias("words")).where(F.size("words") > 0).distinct()


def domains(*lists: DataFrame) -> DataFrame:
    """Distinct hosts without www. of domains or URLs."""
    out = lists[0].select("domain")
    for x in lists[1:]:
        out = out.union(x.select("domain"))
    d = F.coalesce(host(F.col("domain")), F.regexp_replace(F.lower(F.trim("domain")), r"^www\.", ""))
    return out.select(d.alias("domain")).where("domain <> ''").distinct()


def colors(*lists: DataFrame) -> DataFrame:
    """Distinct readable colours with their OKLab values."""
    out = lists[0].select("color")
    for x in lists[1:]:
        out = out.union(x.select("color"))
    return out.distinct().withColumn("c", C.parse_color(F.col("color"))).where("c.r is not null").select("color", C.oklab(F.col("c")).alias("lab"))


def lines(files: DataFrame) -> DataFrame:
    """path, line, text of text files, lines over the limit left out."""
    rows = files.select("path", F.posexplode(F.split("content", "\n")).alias("pos", "text"))
    return rows.select("path", (F.col("pos") + 1).alias("line"), "text").where(F.length("text") <= LONG_LINE)


def name_hits(rows: DataFrame, avoid: DataFrame) -> DataFrame:
    hit = rows.withColumn("w", ident_words(F.col("text"))).join(small(avoid), contains_run(F.col("w"), F.col("words")))
    return hit.select(F.lit("name").alias("kind"), "path", "line", "text", F.array_join("words", " ").alias("detail"))


def file_name_hits(paths: DataFrame, avoid: DataFrame) -> DataFrame:
    """Files whose own name holds an avoided name; line 0."""
    base = F.regexp_extract("path", r"([^/]*)$", 1)
    hit = paths.select("path", base.alias("text")).withColumn("w", ident_words(F.col("text"))).join(small(avoid), contains_run(F.col("w"), F.col("words")))
    return hit.select(F.lit("name").alias("kind"), "path", F.lit(0).alias("line"), "text", F.array_join("words", " ").alias("detail"))


def original_texts(measured: DataFrame, crawled: DataFrame, apps: DataFrame) -> DataFrame:
    """text_id, text of the original's words: measured texts (t), crawled pages (text), app descriptions and notes."""
    parts = [measured.select(F.col("t").alias("text")), crawled.select("text"), apps.select(F.col("description").alias("text")), apps.select(F.col("notes").alias("text"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("coalesce(text, '') <> ''").select(F.xxhash64("text").alias("text_id"), "text").distinct()


def domain_hits(rows: DataFrame, avoid: DataFrame) -> DataFrame:
    hit = rows.join(small(avoid), F.contains(F.lower("text"), F.col("domain")))
    return hit.select(F.lit("domain").alias("kind"), "path", "line", "text", F.col("domain").alias("detail"))


def host_hits(hosts: DataFrame, avoid: DataFrame) -> DataFrame:
    """Requested hosts equal to or below an avoided domain."""
    h = F.regexp_replace(F.lower("host"), r"^www\.", "")
    hit = hosts.join(small(avoid), (h == F.col("domain")) | F.endswith(h, F.concat(F.lit("."), F.col("domain"))))
    return hit.select(F.lit("runtime").alias("kind"), "path", F.lit(0).alias("line"), F.col("host").alias("text"), F.col("domain").alias("detail"))


def color_hits(rows: DataFrame, brand: DataFrame, distance: float = COLOR_DISTANCE) -> DataFrame:
    """Colours written in code files that are near a brand colour."""
    found = rows.where(F.col("path").rlike(CODE)).withColumn("raw", F.explode(C.colors_in_text(F.col("text"))))
    found = found.withColumn("c", C.parse_color(F.col("raw"))).where("c.r is not null").withColumn("lab_", C.oklab(F.col("c")))
    hit = found.join(small(brand), C.distance(F.col("lab_"), F.col("lab")) < distance)
    return hit.select(F.lit("color").alias("kind"), "path", "line", "text", F.concat_ws(" ~ ", "raw", "color").alias("detail"))


def drawing_paths(rows: DataFrame) -> DataFrame:
    """path, line, d, hash of long drawing paths."""
    three = [F.regexp_extract_all("text", F.lit(PATH_ATTRIBUTE), F.lit(i)) for i in (1, 2, 3)]
    d = F.filter(F.concat(*three), lambda x: F.length(x) >= 80)
    return rows.where(F.contains("text", F.lit("d"))).select("path", "line", "text", F.explode(d).alias("d")).withColumn("hash", path_hash(F.col("d")))


def path_hits(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Drawing paths whose fingerprint the original has; known: hash, file."""
    last = known.groupBy("hash").agg(F.max("file").alias("file"))
    hit = drawing_paths(rows).join(last, "hash")
    return hit.select(F.lit("svg").alias("kind"), "path", "line", F.substring("text", 1, 90).alias("text"), F.col("file").alias("detail"))


def image_hits(mine: DataFrame, theirs: DataFrame, most: int = IMAGE_BYTES) -> DataFrame:
    """Images equal byte for byte; both sides are path, content."""
    digest = lambda d: d.where(F.octet_length("content") < most).withColumn("digest", F.sha2("content", 256))
    a, b = digest(mine).select("path", "digest"), digest(theirs).groupBy("digest").agg(F.min("path").alias("detail"))
    return a.join(b, "digest").select(F.lit("image").alias("kind"), "path", F.lit(0).alias("line"), F.lit("").alias("text"), "detail")


def tag(hits: DataFrame, allow: list[str] = ()) -> DataFrame:
    """level error or allowed: by a mark on the line, or an allowed path, path prefix or text; some kinds never are."""
    a = F.array(*[F.lit(x) for x in allow]).cast("array<string>")
    covered = F.exists(a, lambda x: (F.col("path") == x) | F.startswith("path", F.concat(F.rtrim(x, F.lit("/")), F.lit("/"))) | F.contains("text", x))
    free = (F.contains("text", F.lit(ALLOW_MARK)) | covered) & ~F.col("kind").isin("runtime", "copy", "image")
    return hits.withColumn("level", F.when(F.coalesce(free, F.lit(False)), "allowed").otherwise("error"))


def ordered(hits: DataFrame, most: int = 80) -> DataFrame:
    rank = F.array_position(F.array(*[F.lit(k) for k in KIND_RANK]), F.col("kind"))
    return hits.orderBy(F.col("level") != "error", rank, "path", "line", "detail").limit(most)


def source_strings(rows: DataFrame) -> DataFrame:
    """Readable strings in markup-like source: element text and quoted strings, 20 characters and 4 words or more."""
    element = F.regexp_extract_all("text", F.lit(r">([^<>{}]{20,})<"), F.lit(1))
    quoted = F.concat(*[F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in (r'"([^"\n]{20,})"', r"'([^'\n]{20,})'", r"`([^`\n]{20,})`")])
    quoted = F.filter(quoted, lambda s: F.size(F.split(F.trim(s), r"\s+")) >= 4)
    return rows.select("path", "line", F.explode(F.array_distinct(F.concat(element, quoted))).alias("string"))
