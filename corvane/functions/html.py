"""HTML to text, links and head tags with regular expressions; code point entities need one Arrow function."""

from __future__ import annotations

import re
from urllib.parse import urldefrag, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Named entities and what they read as.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "mdash": "-", "ndash": "-", "hellip": "...",
    "rsquo": "'", "lsquo": "'", "ldquo": '"', "rdquo": '"', "copy": "(c)", "reg": "(R)", "trade": "(TM)", "middot": "·",
    "bull": "•", "laquo": "«", "raquo": "»", "times": "×", "rarr": "→", "larr": "←", "check": "✓",
}
_ENTITY = re.compile(r"&(#x[0-9a-f]+|#\d+|[a-z]+);", re.I)
# Elements after which a blank line stands.
CLOSERS = "p|div|section|article|ul|ol|table|tr|blockquote|pre|figure|details|summary|dl|dt|dd"


def decode_one(s: str) -> str:
    def one(m: re.Match) -> str:
        k = m[1].lower()
        if k[0] != "#":
            return ENTITIES.get(k, m[0])
        code = int(k[2:], 16) if k[1] == "x" else int(k[1:])
        return chr(code) if code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else m[0]

    return _ENTITY.sub(one, s)


@F.pandas_udf(T.StringType())
def decode_entities(s: pd.Series) -> pd.Series:
    """Named, decimal and hexadecimal entities in one pass; unknown ones stay."""
    return s.map(lambda x: x if x is None else decode_one(x))


def decode_named(s: Column) -> Column:
    """The named entities alone, without Python: &amp; last, so that nothing is decoded twice."""
    for name, value in sorted(ENTITIES.items(), key=lambda kv: kv[0] == "amp"):
        s = F.regexp_replace(s, f"(?i)&{name};", value.replace("$", "\\$"))
    return s


def drop_blocks(s: Column, tags: list[str]) -> Column:
    for t in tags:
        s = F.regexp_replace(s, rf"(?is)<{t}(?![A-Za-z0-9_])[^>]*>.*?</{t}\s*>", " ")
    return s


def content_of(html: Column) -> Column:
    """The main element, else the element with role main, else the article, else the body without page furniture."""
    clean = drop_blocks(F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<!--.*?-->", " "), ["script", "style", "noscript", "template", "svg", "iframe", "head"])
    inner = lambda tag: F.regexp_extract(clean, rf"(?is)<{tag}(?![A-Za-z0-9_])[^>]*>(.*?)</{tag}\s*>", 1)
    has = lambda tag: clean.rlike(rf"(?is)<{tag}(?![A-Za-z0-9_])[^>]*>.*?</{tag}\s*>")
    role = r"""(?is)<[a-z]+(?![A-Za-z0-9_])[^>]*role=["']main["'][^>]*>(.*)"""
    body = r"(?is)<body(?![A-Za-z0-9_])[^>]*>(.*?)(?:</body\s*>|$)"
    whole = F.when(clean.rlike(body), F.regexp_extract(clean, body, 1)).otherwise(clean)
    return (
        F.when(has("main"), drop_blocks(inner("main"), ["nav", "aside"]))
        .when(clean.rlike(role), drop_blocks(F.regexp_extract(clean, role, 1), ["nav", "aside"]))
        .when(has("article"), inner("article"))
        .otherwise(drop_blocks(whole, ["header", "nav", "footer", "aside", "form"]))
    )


def html_to_text(html: Column, decode=decode_entities) -> Column:
    """Readable text: # for headings, - for items, | for cells, --- for rules, a blank line after blocks."""
    s = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?i)<br\s*/?>", "\n")
    for level in range(1, 7):
        tag = rf"(?is)<h{level}(?![A-Za-z0-9_])[^>]*>(.*?)</h{level}\s*>"
        s = F.regexp_replace(s, tag, "\n\n" + "#" * level + " $1\n\n")
    s = F.regexp_replace(s, r"(?i)<li(?![A-Za-z0-9_])[^>]*>", "\n- ")
    s = F.regexp_replace(s, rf"(?i)</(?:{CLOSERS})\s*>", "\n\n")
    s = F.regexp_replace(s, r"(?i)<(?:td|th)(?![A-Za-z0-9_])[^>]*>", " | ")
    s = F.regexp_replace(s, r"(?i)<hr(?![A-Za-z0-9_])[^>]*>", "\n\n---\n\n")
    s = decode(F.regexp_replace(s, "<[^>]+>", " "))
    lines = F.transform(F.split(s, "\n"), lambda l: F.trim(F.regexp_replace(l, r"[ \t\f\x0B]+", " ")))
    s = F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n")
    return F.regexp_replace(s, r"^\s+|\s+$", "")


HREF = r"""(?i)<a(?![A-Za-z0-9_])[^>]*(?<![A-Za-z0-9_])href\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""


def hrefs(html: Column) -> Column:
    """href values of links, as written, quotes off."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(HREF), F.lit(1))
    return F.transform(found, lambda h: F.trim(F.regexp_replace(h, """^["']|["']$""", "")))


@F.pandas_udf(T.ArrayType(T.StringType()))
def links_of(html: pd.Series, base: pd.Series) -> pd.Series:
    """Distinct absolute link targets without fragment, in order; mail, phone, script and data links are left out."""
    href = re.compile(HREF)

    def one(h: str | None, b: str | None) -> list[str]:
        out: dict[str, None] = {}
        for m in href.finditer(h or ""):
            v = decode_one(m[1].strip("\"'").strip())
            if not v or re.match(r"(?i)mailto:|tel:|javascript:|data:|#", v):
                continue
            try:
                full = urldefrag(urljoin(b or "", v))[0]
                if urlsplit(full).netloc:
                    out[full if urlsplit(full).path else full + "/"] = None
            except ValueError:
                continue
        return list(out)

    return pd.Series([one(h, b) for h, b in zip(html, base, strict=True)])


def head_of(html: Column, decode=decode_entities) -> Column:
    """struct title, description, canonical, robots, og_title, og_description, og_image, h1; absent ones are empty."""
    html = F.coalesce(html, F.lit(""))
    whole = r"(?is)<head(?![A-Za-z0-9_])[^>]*>(.*?)</head\s*>"
    head = F.when(html.rlike(whole), F.regexp_extract(html, whole, 1)).otherwise(html)
    tidy = lambda s: F.trim(F.regexp_replace(decode(s), r"(?U)\s+", " "))
    metas = F.regexp_extract_all(head, F.lit(r"(?i)(<meta(?![A-Za-z0-9_])[^>]*>)"), F.lit(1))
    links = F.regexp_extract_all(head, F.lit(r"(?i)(<link(?![A-Za-z0-9_])[^>]*>)"), F.lit(1))

    def value(tag: Column, name: str) -> Column:
        quoted = F.regexp_extract(tag, rf"""(?i){name}\s*=\s*("[^"]*"|'[^']*')""", 1)
        return F.regexp_replace(quoted, """^["']|["']$""", "")

    def meta(key: str) -> Column:
        mine = F.filter(metas, lambda t: t.rlike(rf"""(?i)(?:name|property)\s*=\s*["']{key}["']"""))
        return tidy(F.coalesce(value(F.get(mine, F.lit(0)), "content"), F.lit("")))

    canonical = F.filter(links, lambda t: t.rlike(r"""(?i)rel\s*=\s*["']canonical["']"""))
    h1 = F.regexp_extract(html, r"(?is)<h1(?![A-Za-z0-9_])[^>]*>(.*?)</h1\s*>", 1)
    return F.struct(
        tidy(F.regexp_extract(head, r"(?is)<title(?![A-Za-z0-9_])[^>]*>(.*?)</title\s*>", 1)).alias("title"),
        meta("description").alias("description"),
        F.coalesce(value(F.get(canonical, F.lit(0)), "href"), F.lit("")).alias("canonical"),
        meta("robots").alias("robots"),
        meta("og:title").alias("og_title"),
        meta("og:description").alias("og_description"),
        meta("og:image").alias("og_image"),
        tidy(F.regexp_replace(h1, "<[^>]+>", " ")).alias("h1"),
    )


def sitemap_urls(xml: Column) -> Column:
    """loc values of a sitemap or a sitemap index."""
    return F.transform(F.regexp_extract_all(F.coalesce(xml, F.lit("")), F.lit(r"(?i)<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1)), decode_named)


# Signals of technologies in a page's source.
TECHNOLOGIES = {
    "next": "/_next/|__NEXT_DATA__", "nuxt": "/_nuxt/|__NUXT__", "gatsby": "___gatsby", "react": "data-reactroot|react(?:-dom)?(?:\\.production)?(?:\\.min)?\\.js",
    "vue": "data-v-[0-9a-f]{6,8}|vue(?:\\.min)?\\.js", "angular": "ng-version=", "svelte": "svelte-[a-z0-9]{5,}", "wordpress": "/wp-content/", "webflow": "data-wf-(?:site|page)",
    "shopify": "cdn\\.shopify\\.com", "squarespace": "squarespace\\.com", "wix": "wixstatic\\.com", "framer": "framerusercontent\\.com", "tailwind": "--tw-|tailwind", "bootstrap": "bootstrap(?:\\.min)?\\.(?:css|js)",
}


def technologies(html: Column) -> Column:
    """Map of technology to presence."""
    return F.create_map(*[x for k, p in TECHNOLOGIES.items() for x in (F.lit(k), F.coalesce(html, F.lit("")).rlike(p))])
