"""Main-text extraction with a site style tree.

The DOMs of a host's pages are merged: a tree node is a path of element styles (tag, id, classes). For every node
the tree knows on how many pages it stands, how its child sequences vary (presentation), how the texts below it
vary (content), and how their numbers of blocks and words vary (shape). With c_i pages showing variant
i and m in all, an importance is 1 - sum(c_i log c_i) / (m log m): 0 if all pages look alike there, 1 if all differ.
Two sorts of nodes are furniture and are removed from every page as whole branches: static ones, unimportant in
presentation and content; and, outside article and main elements, slots, whose text changes from page to page
(rotating adverts, generated menus) but neither in presentation nor in shape, and which hold little of a page's text.

A host's own tree decides for nodes on at least LEAST_PAGES of its pages; for others the tree of all hosts together
does, so a host of few pages is treated by the same rule. Markup is the prior: elements whose tag or role declares
them furniture, or whose class or id consists of furniture names alone, have importance 0 by definition, and plain
text elements (paragraphs, headings, list items) count as part of what they stand in. If a page has a main element
with text, that is where its text is; text outside an article stays where the tree does not remove it.

Statistics are sums per (host, node, variant) and then per (host, node), combined before each shuffle; a host with
a third of all pages is no larger than its distinct variants in any one task's partial sums.

Defined results: null and empty html give an empty text; a page whose every block would go keeps its unpruned
text; null urls share one host; repeated rows give repeated results.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import cut

LEAST_PAGES, SHIPPED_NODES = 10, 200_000
STATIC_IMPORTANCE = 0.1  # below it a node is static
SLOT_IMPORTANCE, SLOT_SPREAD, SLOT_SHARE = 0.8, 2.5, 0.2  # below all three (the second an entropy in nats, of about 12 shapes) a node is a slot
ALL_HOSTS = "*"  # stands for the tree of all hosts; no host name

# HTML element classes and names that declare furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style noscript template textarea iframe title svg math select button object audio video canvas"
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary "
    "table tbody td tfoot th thead title tr ul".split()
)
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th figcaption".split())
NOISE_TAGS = frozenset("nav footer aside form head menu dialog".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners sponsor sponsored promo promotion "
    "nav navbar navigation menu menus breadcrumb breadcrumbs masthead footer sidebar aside widget widgets related "
    "recommended share sharing social cookie cookies consent gdpr notice notices popup modal overlay newsletter "
    "subscribe subscription signup login comment comments respond reply replies disqus discussion pagination pager "
    "toolbar copyright".split()
)
# Words that say nothing by themselves in a class or id beside furniture names.
NEUTRAL_NAMES = frozenset(
    "area bar block box button buttons button container content form global group header icons inner item items left line link links list main "
    "message outer page panel post posts right row section site slot small tools top bottom unit wrap wrapper".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<({RAW.replace(' ', '|')})(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?(?=[\s/]|\Z)""", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


class Element:
    __slots__ = ("tag", "key", "noise", "inside", "plain", "children", "above")

    def __init__(self, tag: str, key: int, noise: bool, inside: int, plain: bool, above: tuple):
        self.tag, self.key, self.noise, self.inside, self.plain, self.above = tag, key, noise, inside, plain, above
        self.children: list[str] = []


def host_of(url: str | None) -> str:
    try:
        host = (urlsplit(url or "").hostname or "").removeprefix("www.")
    except ValueError:
        return ""
    return "" if host == ALL_HOSTS else host


def furniture_name(name: str, inside: int) -> bool:
    """Whether a class or id names furniture: one of its words does, and no other word says anything else."""
    words = [w for w in map(str.lower, NAME.findall(name)) if not w.isdigit()]
    named = [w in NOISE_NAMES or w == "header" and not inside for w in words]
    return any(named) and all(n or w in NEUTRAL_NAMES for n, w in zip(named, words, strict=True))


def style_of(tag: str, attributes: str, inside: int) -> tuple[str, bool, bool]:
    """An element's style (tag, id, classes), whether it declares itself furniture, whether it is a main element."""
    if not attributes.strip():
        return tag, tag in NOISE_TAGS or tag == "header" and not inside, tag == "main"
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    names = f"{found.get('class', '')} {found.get('id', '')}"
    style = " ".join([tag, *sorted(found.get("class", "").split()), f"#{re.sub(r'[0-9]+', '', found['id'])}" if found.get("id") else ""])
    role = found.get("role", "").lower()
    noise = tag in NOISE_TAGS or tag == "header" and not inside or role in NOISE_ROLES
    noise |= "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    if tag not in ("html", "body", "article", "main"):
        noise |= any(furniture_name(n, inside) for n in names.split())
    return style, noise, tag == "main" or role == "main"


class Page:
    """One page's blocks, in order, and its elements for the tree.

    blocks: (text, element keys from the root down that may be pruned, 1 in main + 2 in an article, noise).
    nodes: per element key its child sequence; texts: per element key the block texts below it, and where it stands.
    Without `prior` only what is hidden counts as noise, so that the tree alone decides.
    """

    def __init__(self, html: str | None, prior: bool = True):
        self.prior = prior
        self.blocks: list[tuple[str, tuple, int, bool]] = []
        self.nodes: list[tuple[int, str]] = []
        self.texts: list[tuple[int, str, int]] = []
        self.stack = [Element("", 0, False, 0, False, ())]
        self.buffer: list[str] = []
        self.parse(html or "")

    def parse(self, html: str) -> None:
        at = 0
        for m in TOKEN.finditer(html):
            if m.start() > at:
                self.buffer.append(html[at : m.start()])
            at = m.end()
            tag = m[3] or m[6]
            if tag:
                tag = tag.lower()
                if m[2] or m[5]:
                    self.close(tag)
                else:
                    self.open(tag, m[4] or m[7] or "")
            elif m[1] and m[1].lower() not in ("script", "style", "svg", "math"):
                self.buffer.append(" ")
        self.buffer.append(html[at:])
        while len(self.stack) > 1:
            self.pop()
        self.end_block()

    def open(self, tag: str, attributes: str) -> None:
        if tag in VOID:
            if tag in ("br", "wbr"):
                self.buffer.append(" " if tag == "br" else "")
            elif tag == "hr":
                self.end_block()
            return
        if tag in BLOCKS:
            self.end_block()
            self.close_implied(tag)
        top = self.stack[-1]
        style, noise, main = style_of(tag, attributes, top.inside)
        top.children.append(style)
        key = xxhash.xxh64_intdigest(style, top.key) >> 1
        inside = top.inside | (1 if main else 0) | (2 if tag == "article" else 0)
        noise = noise if self.prior else tag == "head"
        plain = tag in TEXTUAL and style == tag or tag in ("html", "body", "article", "main") or tag not in BLOCKS
        self.stack.append(Element(tag, key, noise or top.noise, inside, plain, top.above if plain else (*top.above, key)))

    def close_implied(self, tag: str) -> None:
        shut = CLOSES.get(tag, set())
        for i in range(len(self.stack) - 1, 0, -1):
            t = self.stack[i].tag
            if t == "p" or t in shut:
                while len(self.stack) > i:
                    self.pop()
                if t != "p" and tag not in ("tr", "td", "th"):
                    return
            elif t in SCOPES.get(tag, ()) or t in BLOCKS and not shut:
                return

    def close(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                if tag in BLOCKS:
                    self.end_block()
                while len(self.stack) > i:
                    self.pop()
                return

    def pop(self) -> None:
        e = self.stack[-1]
        if e.tag in BLOCKS:
            self.end_block()
            self.nodes.append((e.key, "\n".join(e.children)))
        self.stack.pop()

    def end_block(self) -> None:
        if not self.buffer:
            return
        text = " ".join(htmllib.unescape("".join(self.buffer)).split())
        self.buffer = []
        if text:
            e = next(x for x in reversed(self.stack) if x.tag in BLOCKS or not x.tag)
            noise = e.noise or self.stack[-1].noise
            self.blocks.append((text, e.above, e.inside, noise))
            for key in e.above or (e.key,):
                self.texts.append((key, text, e.inside))

    def main_text(self, low: set[int] | frozenset[int]) -> str:
        """Blocks of the main element, if it has any, else of the page, without furniture and low branches."""
        kept = [b for b in self.blocks if not b[3]]
        if any(b[2] & 1 for b in kept):
            kept = [b for b in kept if b[2] & 1]
        pruned = [b for b in kept if low.isdisjoint(b[1])] if low else kept
        return "\n".join(b[0] for b in pruned or kept)


def _signed(text: str) -> int:
    return xxhash.xxh64_intdigest(text) >> 1


PRESENTATION, CONTENT, SHAPE, SHARE, INSIDE = range(5)  # kinds of statistics; the last two are sums and maxima, not variants


def page_statistics(page: Page) -> dict[tuple[int, int, int], int]:
    """(node, kind, variant) -> count of one page; shares in millionths of the page's characters."""
    out = dict.fromkeys(((k, PRESENTATION, _signed(s)) for k, s in page.nodes), 1)
    texts: dict[int, list[str]] = {}
    within: dict[int, int] = {}
    for key, t, inside in page.texts:
        texts.setdefault(key, []).append(t)
        within[key] = max(within.get(key, 0), int(inside > 0))
    whole = sum(len(b[0]) for b in page.blocks) or 1
    for k, t in texts.items():
        out[k, CONTENT, _signed("\n".join(t))] = 1
        out[k, SHAPE, _signed(" ".join(str(x.count(" ")) for x in t))] = 1
        out[k, SHARE, 0] = 1_000_000 * sum(map(len, t)) // whole
        out[k, INSIDE, 0] = within[k]
    return out


def _statistics(prior: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: Counter = Counter()
            for url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                host = host_of(url)
                for (node, kind, variant), n in page_statistics(Page(html, prior)).items():
                    counts[host, node, kind, variant] += n
                    counts[ALL_HOSTS, node, kind, variant] += n
            if counts:
                cols = list(zip(*counts, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64()), pa.array(list(counts.values()), pa.int64())], ["host", "node", "kind", "variant", "c"])

    return run


def style_tree(pages: DataFrame, prior: bool = True) -> DataFrame:
    """(host, node, pages, presentation, content, shape, spread, share, inside) of every merged node: its importances, the
    entropy of its shape, its mean share of a page's text, and whether it stands in an article or main element; null
    where it has none of a kind."""
    rows = pages.select(F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(_statistics(prior), "host string, node long, kind int, variant long, c long")
    per = rows.groupBy("host", "node", "kind", "variant").agg(F.sum("c").alias("c"))
    m, log = F.sum("c"), F.sum(F.when(F.col("kind") < SHARE, F.col("c") * F.log(F.col("c").cast("double"))))
    kind = per.groupBy("host", "node", "kind").agg(m.alias("m"), log.alias("clogc"))
    imp = F.when(F.col("m") > 1, 1 - F.col("clogc") / (F.col("m") * F.log(F.col("m").cast("double")))).otherwise(F.lit(1.0))
    pick = lambda k, x=imp: F.max(F.when(F.col("kind") == k, x))
    n = F.max(F.when(F.col("kind") < SHARE, F.col("m")))
    share = pick(SHARE, F.col("m")) / pick(CONTENT, F.col("m")) / 1_000_000
    spread = F.log(F.col("m").cast("double")) - F.col("clogc") / F.col("m")
    return kind.groupBy("host", "node").agg(n.alias("pages"), pick(PRESENTATION).alias("presentation"), pick(CONTENT).alias("content"), pick(SHAPE).alias("shape"), pick(SHAPE, spread).alias("spread"), share.alias("share"), (pick(INSIDE, F.col("m")) > 0).alias("inside"))


def judged_nodes(pages: DataFrame, least_pages: int = LEAST_PAGES, prior: bool = True) -> DataFrame:
    """(host, node, low) of nodes with texts on enough pages: whether they are static or slots."""
    look = F.coalesce("presentation", F.lit(0.0))
    static = (look < STATIC_IMPORTANCE) & (F.col("content") < STATIC_IMPORTANCE)
    slot = ~F.col("inside") & (F.greatest(look, "shape") < SLOT_IMPORTANCE) & (F.col("spread") < SLOT_SPREAD) & (F.col("share") < SLOT_SHARE)
    tree = style_tree(pages, prior).where((F.col("pages") >= least_pages) & F.col("content").isNotNull())
    return tree.select("host", "node", (static | slot).alias("low"))


def low_nodes(pages: DataFrame, least_pages: int = LEAST_PAGES, prior: bool = True) -> DataFrame:
    """(host, node, low): the low nodes of every host and of ALL_HOSTS, and nodes low there that a host's own tree keeps."""
    judged = cut(judged_nodes(pages, least_pages, prior))  # read three times below
    own, every = judged.where(F.col("host") != ALL_HOSTS), judged.where((F.col("host") == ALL_HOSTS) & F.col("low"))
    spared = own.where(~F.col("low")).join(every.select("node"), "node", "left_semi").select("host", "node", "low")
    return own.where("low").unionByName(every).unionByName(spared)


class Low:
    """Which nodes go from a host's pages."""

    def __init__(self, rows: Iterator[tuple[str, int, bool]]):
        self.low: dict[str, set[int]] = {}
        self.spared: dict[str, set[int]] = {}
        for host, node, low in rows:
            (self.low if low else self.spared).setdefault(host, set()).add(node)
        self.of = lru_cache(1000)(self._of)

    def __reduce__(self):
        return Low, ([(h, n, low) for low, of in ((True, self.low), (False, self.spared)) for h, s in of.items() for n in s],)

    def _of(self, host: str) -> frozenset[int]:
        every = self.low.get(ALL_HOSTS, set()) - self.spared.get(host, set())
        return frozenset(every | self.low.get(host, set()))


SCHEMA = "page_id long, url string, text string, n_chars long"


def _batch(b: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])


def _extract_shipped(low: Low, prior: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _batch(b, [Page(h, prior).main_text(low.of(host_of(u))) for u, h in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)])

    return run


def _extract_joined(prior: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, htmls, found = (b.column(i).to_pylist() for i in (1, 2, 3))
            yield _batch(b, [Page(h, prior).main_text(Low((r["host"], r["node"], r["low"]) for r in n or ()).of(host_of(u))) for u, h, n in zip(hosts, htmls, found, strict=True)])

    return run


def _page_nodes(prior: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = {(k, host, n) for k, u, h in zip(*(c.to_pylist() for c in b.columns), strict=True) for _, above, _, _ in Page(h, prior).blocks for n in above for host in (host_of(u), ALL_HOSTS)}
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], ["page_key", "host", "node"])

    return run


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES, shipped: int = SHIPPED_NODES, prior: bool = True) -> DataFrame:
    """page_id, url, text, n_chars of every row.

    Up to `shipped` judged nodes go to the tasks by value; more are joined to each page's own nodes instead. Without
    `prior` no tag, role or name declares furniture, and the tree alone removes it.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    low = cut(low_nodes(pages, least_pages, prior))
    if low.limit(shipped + 1).count() <= shipped:
        return rows.mapInArrow(_extract_shipped(Low([tuple(r) for r in low.collect()]), prior), SCHEMA)
    keyed = rows.withColumn("page_key", F.xxhash64("url", "html"))
    nodes = keyed.select("page_key", "url", "html").mapInArrow(_page_nodes(prior), "page_key long, host string, node long").distinct()
    found = nodes.join(low, ["host", "node"]).groupBy("page_key").agg(F.collect_set(F.struct("host", "node", "low")).alias("low"))  # at most a page's nodes, twice
    return keyed.join(found, "page_key", "left").select("page_id", "url", "html", "low").mapInArrow(_extract_joined(prior), SCHEMA)
