"""Shaping of recorded feeds: app reviews, app lookups, comment searches, registry bootstraps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.html import decode_entities, html_to_text
from corvane.functions.text import squash
from corvane.functions.urls import domain_label, domain_status

LABEL = "struct<label:string>"
REVIEW_FEED = f"feed struct<entry:array<struct<id:{LABEL},title:{LABEL},content:{LABEL},updated:{LABEL},`im:rating`:{LABEL}>>>"
COMMENT = "hits array<struct<objectID:string,created_at:string,title:string,story_text:string,comment_text:string>>"
LEAST_COMMENT = 20


def review_rows(feeds: DataFrame) -> DataFrame:
    """Rows id, source, url, date, rating, text of review feeds (app_id, country, feed); entries without rating go."""
    e = feeds.select("app_id", "country", F.explode("feed.entry").alias("e")).where(F.col("e.`im:rating`.label").isNotNull())
    title, body = squash(F.col("e.title.label")), squash(F.col("e.content.label"))
    text = F.when((title != "") & ~F.startswith(body, title), F.concat_ws(". ", title, body)).otherwise(body)
    url = F.concat(F.lit("https://apps.apple.com/"), "country", F.lit("/app/id"), "app_id", F.lit("?see-all=reviews"))
    return e.select(
        F.concat_ws("-", F.lit("as"), "country", "e.id.label").alias("id"), F.lit("app-store").alias("source"), url.alias("url"),
        F.substring("e.updated.label", 1, 10).alias("date"), F.col("e.`im:rating`.label").alias("rating"), text.alias("text"),
    )


def comment_rows(results: DataFrame, since: str | None = None) -> DataFrame:
    """Rows of comment searches (hits): the comment, or title and story; HTML stripped, 20 characters or more.

    since: a day (YYYY-MM-DD) from which hits count; older ones go before their text is worked on.
    """
    h = results.select(F.explode("hits").alias("h"))
    h = h.where(F.substring("h.created_at", 1, 10) >= since) if since else h
    raw = F.coalesce("h.comment_text", F.concat_ws(" ", F.coalesce("h.title", F.lit("")), F.coalesce("h.story_text", F.lit(""))))
    text = squash(html_to_text(decode_entities(raw)))
    out = h.select(
        F.concat(F.lit("hn-"), "h.objectID").alias("id"), F.lit("hn").alias("source"), F.concat(F.lit("https://news.ycombinator.com/item?id="), "h.objectID").alias("url"),
        F.substring("h.created_at", 1, 10).alias("date"), F.lit("").alias("rating"), text.alias("text"),
    )
    return out.where(F.length("text") >= LEAST_COMMENT)


APP_FIELDS = {
    "id": "trackId", "name": "trackName", "developer": "artistName", "price": "price", "currency": "currency", "rating": "averageUserRating",
    "ratings": "userRatingCount", "version": "version", "updated": "currentVersionReleaseDate", "released": "releaseDate", "genre": "primaryGenreName",
    "genres": "genres", "languages": "languageCodesISO2A", "size": "fileSizeBytes", "minimum_os": "minimumOsVersion", "content_rating": "trackContentRating",
    "url": "trackViewUrl", "icon": "artworkUrl512", "notes": "releaseNotes", "description": "description",
}


def app_rows(lookups: DataFrame, most: int = 8) -> DataFrame:
    """At most `most` apps a lookup (text column json), twenty fields each, null where absent."""
    r = lookups.select(F.posexplode(F.from_json("json", "struct<results:array<map<string,string>>>")["results"]).alias("pos", "r")).where(F.col("pos") < most)
    return r.select(*[F.try_element_at("r", F.lit(field)).alias(name) for name, field in APP_FIELDS.items()])


def registry_bases(bootstrap: DataFrame) -> DataFrame:
    """tld, base of a registry bootstrap (services: array of [tlds, bases])."""
    s = bootstrap.select(F.explode("services").alias("s"))
    return s.select(F.explode(F.col("s")[0]).alias("tld"), F.element_at(F.col("s")[1], 1).alias("base"))


def domain_states(names: DataFrame, bases: DataFrame, registry: DataFrame, dns: DataFrame) -> DataFrame:
    """domain, base, state of names and top levels (name, tld): free, taken or unknown.

    The registry of the top level (bases: tld, base) is asked first (registry: url, status), then the name servers
    (dns: domain, status, answers); both are tables of recorded answers.
    """
    q = names.select(domain_label(F.col("name")).alias("label"), F.lower("tld").alias("tld")).where("label <> ''").distinct()
    q = q.join(bases, "tld", "left").select(F.concat_ws(".", "label", "tld").alias("domain"), "base")
    q = q.withColumn("url", F.concat(F.regexp_replace("base", "/+$", ""), F.lit("/domain/"), "domain"))
    q = q.join(registry.select("url", F.col("status").alias("asked")), "url", "left").join(dns.select("domain", F.col("status").alias("dns"), "answers"), "domain", "left")
    return q.select("domain", "base", domain_status(F.col("asked"), F.col("dns"), F.col("answers")).alias("state"))
