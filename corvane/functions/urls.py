"""URLs, hosts, robots rules and identifiers."""

from __future__ import annotations

from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TRACKING = "utm_[^=&]*|ref|source|fbclid|gclid"
ASSETS = r"(?i)\.(png|jpe?g|gif|webp|avif|svg|ico|css|js|mjs|json|xml|pdf|zip|mp4|webm|mp3|woff2?|ttf)(\?|$)"


def host(url: Column) -> Column:
    """Lower-case host without www., null if the URL has none."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def normalize(url: Column) -> Column:
    """Without fragment, tracking parameters and trailing slash."""
    u = F.regexp_replace(url, "#.*$", "")
    u = F.regexp_replace(u, rf"(?<=[?&])(?:{TRACKING})(?:=[^&]*)?(?:&|$)", "")
    return F.regexp_replace(F.regexp_replace(u, "[?&]+$", ""), "/+$", "")


@F.pandas_udf(StringType())
def normalize_exact(url: pd.Series) -> pd.Series:
    """normalize() through a URL parser: parameters are re-serialised."""

    def one(u: str | None) -> str | None:
        if u is None:
            return None
        try:
            p = urlsplit(u)
        except ValueError:
            return u
        kept = [(k, v) for k, v in parse_qsl(p.query, keep_blank_values=True) if not k.startswith("utm_") and k not in ("ref", "source", "fbclid", "gclid")]
        return urlunsplit((p.scheme, p.netloc.lower(), p.path.rstrip("/"), urlencode(kept), ""))

    return url.map(one)


def canonical_path(url: Column) -> Column:
    """Path without trailing slash; the text itself if it is no URL."""
    return F.coalesce(F.regexp_replace(F.try_parse_url(url, F.lit("PATH")), "/$", ""), url)


def path_and_query(url: Column) -> Column:
    query = F.try_parse_url(url, F.lit("QUERY"))
    path = F.coalesce(F.nullif(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/"))
    return F.concat(path, F.coalesce(F.concat(F.lit("?"), query), F.lit("")))


def in_section(url: Column, host_: str | Column, prefix: str) -> Column:
    """Same host, path equal to the prefix or below it, and no asset."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    p = prefix.rstrip("/")
    below = (path == p) | F.startswith(path, F.lit(p + "/"))
    return (F.try_parse_url(url, F.lit("HOST")) == host_) & below & ~path.rlike(ASSETS)


def domain_label(s: Column) -> Column:
    """A bare domain label: lower case, top level and other characters off."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(s)), r"\.[a-z.]+$", ""), "[^a-z0-9-]", "")


def name_of(url: Column) -> Column:
    """A product name from a URL: host without www, app, help, docs and top level, capitalised."""
    label = F.element_at(F.split(F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^(?:www|app|help|docs)\.", ""), r"\."), 1)
    return F.concat(F.upper(F.substring(label, 1, 1)), F.substring(label, 2, 255))


def app_id(s: Column) -> Column:
    """Six digits or more, or the digits after /id; null otherwise."""
    return F.when(F.trim(s).rlike(r"^\d{6,}$"), F.trim(s)).otherwise(F.nullif(F.regexp_extract(s, r"/id(\d+)", 1), F.lit("")))


def domain_status(registry: Column, dns: Column, answers: Column) -> Column:
    """free, taken or unknown from a registry's HTTP status, else from a DNS status and its number of records."""
    return (
        F.when(registry == 404, F.lit("free"))
        .when(registry == 200, F.lit("taken"))
        .when(dns == 3, F.lit("free"))
        .when((dns == 0) & (answers > 0), F.lit("taken"))
        .when(dns == 2, F.lit("taken"))
        .otherwise(F.lit("unknown"))
    )


def robots_pattern(path: Column) -> Column:
    """A robots rule's path as an anchored regular expression: * is any run, a last $ is the end."""
    ends = F.endswith(path, F.lit("$"))
    body = F.when(ends, F.substring(path, F.lit(1), F.length(path) - 1)).otherwise(path)
    quoted = F.replace(F.regexp_replace(body, r"([.+?^${}()|\[\]\\])", r"\\$1"), F.lit("*"), F.lit(".*"))
    return F.concat(F.lit("^"), quoted, F.when(ends, F.lit("$")).otherwise(F.lit("")))


def path_key(d: Column) -> Column:
    """A drawing path's letters and numbers, numbers to one place, so that formatting does not matter."""
    tokens = F.regexp_extract_all(F.coalesce(d, F.lit("")), F.lit(r"([a-zA-Z]|-?(?:\d+\.?\d*|\.\d+)(?:e-?\d+)?)"), F.lit(1))

    def short(t: Column) -> Column:
        v = F.floor(t.try_cast("double") * 10 + 0.5) / 10
        return F.when(t.rlike("^[a-zA-Z]$"), t).otherwise(F.regexp_replace(F.format_string("%.1f", v), r"\.0$|^-(?=0\.0$)", ""))

    return F.array_join(F.transform(tokens, short), " ")


def path_hash(d: Column) -> Column:
    return F.substring(F.sha1(path_key(d).cast("binary")), 1, 16)


PATH_ATTRIBUTE = r"""(?<![A-Za-z0-9_])d\s*=\s*(?:"([^"]{80,})"|'([^']{80,})'|\{\s*["'`]([^"'`]{80,})["'`]\s*\})"""


def longest_ms(s: Column) -> Column:
    """The longest of a comma list of CSS durations, in milliseconds."""

    def one(x: Column) -> Column:
        v = F.regexp_extract(x, r"([0-9.]+)", 1).try_cast("double")
        return F.when(F.trim(x).rlike(r"[0-9]ms$"), v).otherwise(v * 1000)

    return F.array_max(F.transform(F.split(s, ","), one))
