"""Copy and store-listing lint: rules as predicates over items, findings in one common schema.

Items are rows source_id, pos, kind (heading, button, nav, text), t. Literal rules become predicates of one
projection behind a cheap combined test; rule tables given as DataFrames become a theta join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.html import html_to_text
from corvane.functions.text import button_label, contains_run, fold, graphemes, has_emoji, ident_words, markdown_visible, squash
from corvane.operators import copy_rules as R
from corvane.session import small
from corvane.sources.files import JsonLeaves

FINDING = "source_id string, pos long, level string, rule string, text string, detail string"
EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
LEVELS = {"error": 0, "warning": 1, "note": 2}


def ascii_edges(pattern: str) -> str:
    """A pattern whose \\b mean ASCII word boundaries."""
    return pattern.replace(r"\b", EDGE)


def word_rule(word: str) -> str:
    return rf"(?iu)(?:^|[^\p{{L}}-]){word.replace('-', '[- ]?')}(?:[^\p{{L}}-]|$)"


def move_rule(pattern: str) -> str:
    return "(?i)" + ascii_edges(pattern)


def items_of_markdown(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines a reader sees: headings and text, without comments, fences and markup."""
    lines = docs.select(F.col(key).cast("string").alias("source_id"), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("pos", "line"))
    kind = F.when(F.col("line").rlike(r"^#{1,6}\s"), "heading").otherwise("text")
    t = markdown_visible(F.col("line"))
    rows = lines.select("source_id", F.col("pos").cast("long").alias("pos"), kind.alias("kind"), t.alias("t"))
    return rows.where("t <> '' and not startswith(t, '<!--') and not startswith(t, '```')")


HEADING_KEY = "(?i)name|title|subtitle|heading"
MEASURED = "text array<struct<kind:string,t:string>>, scroll string, hover string, focus string"


def items_of_files(rows: DataFrame) -> DataFrame:
    """source_id, pos, kind, t, where of files (path, content), by what each file is.

    JSON with a list of texts is a measurement and gives its items; JSON with scroll, hover and focus is an interaction
    sweep and gives none; other JSON gives its string leaves, headings where the key says so. HTML is read as text, and
    it and all else as lines of markdown. Broken JSON gives nothing.
    """
    base = F.regexp_extract("path", r"([^/]*)$", 1)
    of_json, of_html = F.lower("path").endswith(".json"), F.col("path").rlike(r"(?i)\.html?$")
    f = rows.select(F.col("path").alias("source_id"), base.alias("base"), "content", of_json.alias("json"), of_html.alias("html"))
    j = f.where("json").withColumn("m", F.from_json("content", MEASURED)).where("m.scroll is null or m.hover is null or m.focus is null")
    listed = j.where("m.text is not null").select("source_id", "base", F.posexplode("m.text").alias("pos", "x"))
    listed = listed.select("source_id", F.col("pos").cast("long").alias("pos"), F.coalesce("x.kind", F.lit("text")).alias("kind"), F.col("x.t").alias("t"), F.col("base").alias("where"))
    leaves = j.where("m.text is null").select("source_id", "base", "content").lateralJoin(JsonLeaves(F.col("content").outer()))
    at = F.row_number().over(Window.partitionBy("source_id").orderBy("key")) - 1
    leaves = leaves.select("source_id", at.cast("long").alias("pos"), F.when(F.col("key").rlike(HEADING_KEY), "heading").otherwise("text").alias("kind"), F.col("value").alias("t"), F.concat_ws(" ", "base", "key").alias("where"))
    text = F.when(F.col("html"), html_to_text(F.col("content"))).otherwise(F.col("content"))
    lines = f.where("not json").withColumn("content", text)
    marked = items_of_markdown(lines, "source_id", "content").join(lines.select("source_id", "base"), "source_id")
    marked = marked.select("source_id", "pos", "kind", "t", F.concat_ws(":", "base", (F.col("pos") + 1).cast("string")).alias("where"))
    return listed.unionByName(leaves).unionByName(marked)


def prepared(items: DataFrame) -> DataFrame:
    out = items.withColumn("t", squash(F.col("t"))).where("t <> ''")
    return out.withColumn("low", F.lower(fold(F.col("t")))).withColumn("control", F.col("kind").isin("heading", "button", "nav"))


def matches(items: DataFrame, words=R.WORDS, patterns=R.PATTERNS) -> DataFrame:
    """prepared items with one row for each word or move rule that matches: rule, tier, advice."""
    rules = [(f"word:{w}", word_rule(w), tier, fix) for w, tier, fix in words] + [(f"move:{i}", move_rule(p), tier, fix) for i, p, tier, fix in patterns]
    any_word = r"(?iu)" + "|".join(w.replace("-", "[- ]?") for w, _, _ in words) if words else "(?!)"
    any_move = "|".join(f"(?:{move_rule(p)})" for _, p, _, _ in patterns) or "(?!)"
    hit = [F.when(F.col("low").rlike(p), F.struct(F.lit(r).alias("rule"), F.lit(t).alias("tier"), F.lit(f).alias("advice"))) for r, p, t, f in rules]
    found = F.filter(F.array(*hit), lambda x: x.isNotNull())
    some = items.where(F.col("low").rlike(any_word) | F.col("low").rlike(any_move))
    return some.withColumn("m", F.explode(found)).select("*", "m.*").drop("m")


def matches_of_rules(items: DataFrame, rules: DataFrame) -> DataFrame:
    """The same for a table of rules (rule, pattern, tier, advice), by theta join; the rules are small by nature."""
    return items.join(small(rules), F.expr("low RLIKE pattern")).drop("pattern")


def tally(m: DataFrame) -> DataFrame:
    """Findings of word and move rules: a tier's number of sightings decides the level."""
    base = m.select("source_id", "pos", "kind", "t", "control", "rule", "tier", "advice")
    per = base.groupBy("source_id", "rule", "tier", "advice").agg(F.count("*").alias("n"), F.min_by(F.struct("pos", "t", "control"), "pos").alias("first"))
    times = F.when(F.col("n") > 1, F.concat(F.lit(" ("), F.col("n").cast("string"), F.lit(" times)"))).otherwise(F.lit(""))
    level = F.when((F.col("tier") == 1) & ~F.col("first.control"), "warning").when((F.col("tier") == 2) & (F.col("n") >= 2), "warning").when(F.col("tier") >= 2, "note")
    detail = F.when(F.col("tier") == 3, F.col("advice")).otherwise(F.concat("advice", times))
    body = per.select("source_id", F.col("first.pos").alias("pos"), level.alias("level"), "rule", F.substring("first.t", 1, 90).alias("text"), detail.alias("detail")).where("level is not null")
    on_control = base.where("control and tier = 1").select("source_id", "pos", F.lit("warning").alias("level"), "rule", F.substring("t", 1, 90).alias("text"), F.col("advice").alias("detail"))
    return body.unionByName(on_control)


def predicates(items: DataFrame, avoid: list[str] = (), claims: list[str] = ()) -> DataFrame:
    """Findings of item-level predicates: placeholders, names, proof, exclamation marks, emoji, buttons, errors."""
    t, low, control = F.col("t"), F.col("low"), F.col("control")
    placeholder = [t.rlike(("(?i)" if i else "") + ascii_edges(p)) for p, i in R.PLACEHOLDERS]
    any_of = lambda cs: cs[0] if len(cs) == 1 else cs[0] | any_of(cs[1:])
    find = lambda when, level, rule, detail: F.when(when, F.struct(F.lit(level).alias("level"), F.lit(rule).alias("rule"), F.lit(detail).alias("detail")))
    ident = ident_words(t)
    backed = F.array(*[F.lit(c.lower()) for c in claims]) if claims else F.array().cast("array<string>")

    def unproved(pattern: str) -> Column:
        said = F.regexp_extract(low, "(" + move_rule(pattern).removeprefix("(?i)") + ")", 1)
        return low.rlike(move_rule(pattern)) & ~F.exists(backed, lambda c: F.contains(c, said) | F.contains(low, c))

    found = [find(any_of(placeholder), "error", "placeholder", "Replace it with the real thing before anyone sees it.")]
    for name in avoid:
        needle = F.array(*[F.lit(w) for w in _ident(name)]).cast("array<string>")
        found.append(find(contains_run(ident, needle), "error", "their-name", f'The original\'s name ("{" ".join(_ident(name))}") is in your copy.'))
    found += [find(unproved(p), "error", f"proof:{i}", "Back it with a source, or cut it.") for i, p in R.PROOF]
    found += [
        find(control & F.contains(t, F.lit("!")), "warning", "exclamation", "Let the words carry the energy."),
        find(control & has_emoji(t), "warning", "emoji", "Use an icon from your icon set, or nothing."),
        find((F.col("kind") == "button") & button_label(t).isin(*R.GENERIC_BUTTONS), "warning", "generic-button", "Say the action and its object."),
        find(any_of([F.contains(low, F.lit(v)) for v in R.VAGUE_ERRORS]), "warning", "vague-error", "Say what happened and what to do next."),
    ]
    rows = items.select("source_id", "pos", F.substring("t", 1, 90).alias("text"), F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("f"))
    return rows.select("source_id", "pos", "f.level", "f.rule", "text", "f.detail")


def _ident(name: str) -> list[str]:
    import re

    for edge in (r"([a-z\d])([A-Z])", r"([A-Z]+)([A-Z][a-z])", r"([A-Za-z])(\d)", r"(\d)([A-Za-z])"):
        name = re.sub(edge, r"\1 \2", name)
    return [w for w in re.split(r"[\W_]+", name.lower()) if w]


def repeated_cta(items: DataFrame, least: int = 3, most_words: int = 4) -> DataFrame:
    """One finding for a label that stands on at least three buttons."""
    b = items.where("kind = 'button'").withColumn("label", button_label(F.col("t"))).where("label <> ''")
    g = b.groupBy("source_id", "label").agg(F.count("*").alias("n"), F.min_by(F.struct("pos", "t"), "pos").alias("first"))
    g = g.where((F.col("n") >= least) & (F.size(F.split("label", " ")) <= most_words))
    detail = F.concat(F.lit('"'), "first.t", F.lit('" is on '), F.col("n").cast("string"), F.lit(" buttons."))
    return g.select("source_id", "first.pos", F.lit("warning").alias("level"), F.lit("repeated-cta").alias("rule"), F.substring("first.t", 1, 90).alias("text"), detail.alias("detail"))


def em_dashes(items: DataFrame) -> DataFrame:
    g = items.where(F.contains("t", F.lit("\u2014"))).groupBy("source_id").agg(F.count("*").alias("n"), F.min_by(F.struct("pos", "t"), "pos").alias("first"))
    return g.select("source_id", "first.pos", F.lit("warning").alias("level"), F.lit("em-dash").alias("rule"), F.substring("first.t", 1, 90).alias("text"), F.concat(F.col("n").cast("string"), F.lit(" em dash"), F.when(F.col("n") > 1, "es").otherwise("")).alias("detail"))


# Words that stay small in title case.
SMALL = "a an and as at but by for in of on or the to with vs".split()


def is_title_case(s: Column) -> Column:
    """Two significant words or more after the first, 0.7 of them capitalised."""
    words = F.split(squash(s), " ")
    w = F.filter(F.slice(words, 2, F.size(words)), lambda x: ~F.lower(x).isin(*SMALL) & x.rlike(r"^\p{L}"))
    return (F.size(w) >= 2) & (F.size(F.filter(w, lambda x: x.rlike(r"^\p{Lu}"))) / F.size(w) >= 0.7)


def mixed_case(items: DataFrame) -> DataFrame:
    """A note where two headings or more are in title case and two or more are not."""
    h = items.where((F.col("kind") == "heading") & (F.size(F.split("t", " ")) >= 3)).withColumn("title", is_title_case(F.col("t")))
    g = h.groupBy("source_id").agg(F.count_if("title").alias("a"), F.count_if(~F.col("title")).alias("b"), F.min_by(F.struct("pos", "t"), F.when(F.col("title"), F.col("pos"))).alias("first"))
    detail = F.concat(F.col("a").cast("string"), F.lit(" headings in Title Case and "), F.col("b").cast("string"), F.lit(" in sentence case."))
    return g.where("a >= 2 and b >= 2").select("source_id", "first.pos", F.lit("note").alias("level"), F.lit("mixed-case").alias("rule"), F.substring("first.t", 1, 90).alias("text"), detail.alias("detail"))


def check_copy(items: DataFrame, avoid: list[str] = (), claims: list[str] = (), dashes_ok: bool = False) -> DataFrame:
    """All findings of a table of items."""
    p = prepared(items)
    parts = [predicates(p, list(avoid), list(claims)), tally(matches(p)), repeated_cta(p), mixed_case(p)]
    if not dashes_ok:
        parts.append(em_dashes(p))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def ordered(findings: DataFrame) -> DataFrame:
    """Errors first, then warnings, then notes; within, by place."""
    rank = F.when(F.col("level") == "error", 0).when(F.col("level") == "warning", 1).otherwise(2)
    return findings.orderBy(rank, "source_id", "pos", "rule")


def totals(findings: DataFrame, most_warnings: int = 3) -> DataFrame:
    """errors, warnings, notes and whether that passes, for each source."""
    n = {k: F.count_if(F.col("level") == k).alias(f"{k}s") for k in LEVELS}
    out = findings.groupBy("source_id").agg(*n.values())
    return out.withColumn("passes", (F.col("errors") == 0) & (F.col("warnings") <= most_warnings))


# Limits of store fields, in characters.
LIMITS = {
    "appStore": {"name": 30, "subtitle": 30, "promotionalText": 170, "keywords": 100, "description": 4000},
    "googlePlay": {"title": 30, "shortDescription": 80, "fullDescription": 4000},
}
SHORT = ("name", "title", "subtitle", "shortDescription", "promotionalText")


def lint_listing(listings: DataFrame, avoid: list[str] = ()) -> DataFrame:
    """(listing_id, level, field, message) for rows listing_id, store, field, value."""
    limit = F.create_map(*[x for s, fields in LIMITS.items() for f, n in fields.items() for x in (F.lit(f"{s}.{f}"), F.lit(n))])
    rows = listings.withColumn("where", F.concat_ws(".", "store", "field")).withColumn("limit", F.try_element_at(limit, F.col("where"))).where("limit is not null")
    v, short, n = F.coalesce(F.col("value"), F.lit("")), F.col("field").isin(*SHORT), graphemes(F.col("value"))
    full = v != ""
    say = lambda when, level, msg: F.when(when, F.struct(F.lit(level).alias("level"), (msg if isinstance(msg, Column) else F.lit(msg)).alias("message")))
    claims = r"(?i)(^|[^A-Za-z0-9_#])(#1|no\.? ?1)(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(best|top|number one|free|cheapest|leading)(?![A-Za-z0-9_])"
    found = [
        say(~full & F.col("field").isin("name", "title", "description", "fullDescription"), "error", "Empty."),
        say(full & (n > F.col("limit")), "error", F.concat(n.cast("string"), F.lit(" characters, the limit is "), F.col("limit").cast("string"), F.lit("."))),
        say(full & short & v.rlike(claims), "warning", "Ranking or price claims in a short field are a common rejection reason."),
        say(full & F.col("field").isin("name", "title") & has_emoji(v), "error", "No emoji in the name."),
        say(full & short & v.rlike("^[^a-z]*[A-Z]{4,}[^a-z]*$"), "warning", "All caps reads as shouting and is often rejected."),
    ]
    for name in avoid:
        w = _ident(name)
        found.append(say(contains_run(ident_words(v), F.array(*[F.lit(x) for x in w])), "error", f'Holds the original\'s name ("{" ".join(w)}").'))
    fields = rows.select("listing_id", F.col("where").alias("field"), F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("f")).select("listing_id", "f.level", "field", "f.message")
    return fields.unionByName(lint_keywords(listings))


def lint_keywords(listings: DataFrame) -> DataFrame:
    """Keyword list of the first store: blanks after commas, words already in name or subtitle, repeats."""
    own = listings.where("store = 'appStore'")
    by = own.groupBy("listing_id").pivot("field", ["name", "subtitle", "keywords"]).agg(F.first("value")).where("coalesce(keywords, '') <> ''")
    used = ident_words(F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("subtitle", F.lit(""))))
    parts = F.filter(F.transform(F.split("keywords", ","), lambda k: F.lower(F.trim(k))), lambda k: k != "")
    by = by.withColumn("used", used).withColumn("parts", parts)
    again = F.filter("parts", lambda k: F.forall(ident_words(k), lambda w: F.array_contains(F.col("used"), w)))
    twice = F.array_distinct(F.filter("parts", lambda k, i: F.array_position(F.col("parts"), k) <= i))
    say = lambda when, msg: F.when(when, msg)
    messages = F.array(
        say(F.col("keywords").rlike(r",(?U:\s)"), F.lit("Spaces after commas waste characters.")),
        say(F.size(again) > 0, F.concat(F.lit("Already in the name or subtitle: "), F.array_join(again, ", "), F.lit("."))),
        say(F.size(twice) > 0, F.concat(F.lit("Repeated: "), F.array_join(twice, ", "), F.lit("."))),
    )
    return by.select("listing_id", F.lit("warning").alias("level"), F.lit("appStore.keywords").alias("field"), F.explode(F.filter(messages, lambda m: m.isNotNull())).alias("message"))
