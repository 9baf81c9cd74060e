"""PII surrogates in DataFrame functions only: keyed, type-consistent replacements.

Detected entities (e-mail and IP addresses, phone, card and social security numbers, person names after a title or
with a known first name) are replaced in place. Replacements come from a keyed cipher that keeps formats: each
character moves within its own class (digits, vowels, consonants, accented letters, Cyrillic vowels and
consonants) by a step hashed from the key, the entity's type and the characters before it, once forwards and once
backwards. That map is one-to-one on strings of a format, so distinct entities keep distinct replacements however
large the corpus is, and equal entities (in any letter case, a number with or without its country code) get the
same one everywhere, without any shuffle or table of entities. Known first names move within the list of their
gender and script by a keyed step, also one-to-one; other names that would land on such a listed name are moved on
until they do not, the collision check that keeps the union of both maps one-to-one. Numbers keep separators,
country code, first digit class and, for cards, issuer digit and check digit; names keep title, gender, script,
case and length. `collisions` checks a corpus for replacements that two entities share.
A name after a first name takes initials, further names and hyphenated or several surnames. Its surnames are replaced
wherever else they stand in the same text; such mentions are not counted in n_name.

Defined results: null text gives null text and no entities, texts without entities stay as they are, every row gives
one row; texts are handled whole.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = "surrogate-key-1"

# Character classes.
VOWELS, CONSONANTS, DIGITS = "aeiou", "bcdfghjklmnpqrstvwxyz", "0123456789"
ACCENTED = "àáâãäåæçèéêëìíîïñòóôõöœùúûüýÿ"
CYRILLIC_VOWELS, CYRILLIC_CONSONANTS = "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь"
CLASSES = (VOWELS, CONSONANTS, DIGITS, ACCENTED, CYRILLIC_VOWELS, CYRILLIC_CONSONANTS)
# First names by gender and script, and titles.
FIRST_NAMES = {
    "male": "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Paul Steven Andrew Kevin Brian George Edward Pierre Jean Jacques Luc Hans Karl Peter Klaus Jürgen Stefan Juan Carlos José Luis Miguel Pedro Jorge Antonio Marco".split(),
    "female": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Ashley Emily Donna Michelle Carol Amanda Melissa Marie Claire Sophie Camille Ingrid Anna Petra Sabine Ursula Monika María Carmen Ana Lucía Elena Isabel Laura Rosa Sofía".split(),
    "cyrillic_male": "Александр Сергей Дмитрий Андрей Алексей Иван Михаил Николай Павел Владимир".split(),
    "cyrillic_female": "Анна Мария Елена Ольга Наталья Татьяна Ирина Екатерина Светлана Юлия".split(),
}
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Mme Señor Señora Sr Sra Господин Госпожа".split()

_FIRST = "|".join(sorted((n for names in FIRST_NAMES.values() for n in names), key=len, reverse=True))
_MORE = r"(?:(?:[ -]\p{Lu}\.)*[ -]\p{Lu}\p{L}+)"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._+-])[A-Za-z0-9._+-]++@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "card": r"(?<!\d)[3-6](?:\d{3}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{12,18})(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|(?<![\w+])\+(?=(?:[ .()-]{0,2}\d){7,15}(?!\d))\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,6}(?<=\d)(?!\d)",
    "name": rf"(?<!\p{{L}})(?=\p{{Lu}})(?:(?:{'|'.join(TITLES)})\.?(?: \p{{Lu}}\.)* \p{{Lu}}\p{{L}}+{_MORE}*|(?:{_FIRST}){_MORE}+)(?!\p{{L}})",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A cheap test that every text with an entity passes; names are tried at capital letters alone.
HINT = rf"[0-9@]|(?<!\p{{L}})(?=\p{{Lu}})(?:(?:{'|'.join(TITLES)})\.? |(?:{_FIRST})[ -])"
#: One group a kind, and what stands in for a match: marks round it and between its groups, noncharacters that texts do not hold.
GROUPED = "|".join(f"({p})" for p in PATTERNS.values())
MARK, GROUP = "\ufdd0", "\ufdd1"


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _step(key: str, label: str, before: str) -> str:
    """SQL: a number hashed from the key, the label and what stands before."""
    return f"cast(conv(substr(md5(cast(concat({_lit(f'{key}|{label}|')}, {before}) AS binary)), 1, 8), 16, 10) AS bigint)"


def _moved(c: str, step: str, classes: tuple[str, ...] = CLASSES) -> str:
    """SQL: character c moved within its class."""
    cases = " ".join(f"WHEN locate({c}, {_lit(a)}) > 0 THEN substr({_lit(a)}, cast(pmod(locate({c}, {_lit(a)}) - 1 + {step}, {len(a)}) AS int) + 1, 1)" for a in classes)
    return f"CASE {cases} ELSE {c} END"


def _pass(s: str, key: str, label: str, first: tuple[str, ...] | None = None) -> str:
    """SQL: one pass of the cipher over lower-case string s; `first`: other classes for the first character."""
    step = _step(key, label, "a.p")
    moved = _moved("c", step)
    if first:
        moved = f"IF(a.p = '', {_moved('c', step, first)}, {moved})"
    return (
        f"aggregate(filter(split({s}, ''), c -> c <> ''), struct('' AS p, '' AS o), "
        f"(a, c) -> struct(concat(a.p, c) AS p, concat(a.o, {moved}) AS o), a -> a.o)"
    )


def _cipher(s: str, key: str, label: str, first: tuple[str, ...] | None = None) -> str:
    """SQL: both passes; the first character, if its class is narrowed, moves in the forward pass alone."""
    forward = _pass(s, key, label + ">", first)
    if not first:
        return f"reverse({_pass(f'reverse({forward})', key, label + '<')})"
    return f"element_at(transform(array({forward}), f -> concat(substr(f, 1, 1), reverse({_pass('reverse(substr(f, 2))', key, label + '<')}))), 1)"


def _recased(m: str, o: str) -> str:
    """SQL: o in the letter case of m, character by character."""
    return (
        f"element_at(transform(array({o}), o -> array_join(transform(sequence(1, length({m})), i -> "
        f"IF(substr({m}, i, 1) <> lower(substr({m}, i, 1)) AND length(upper(substr(o, i, 1))) = 1, upper(substr(o, i, 1)), substr(o, i, 1))), '')), 1)"
    )


def _digits_into(m: str, digits: str) -> str:
    """SQL: m with its digits replaced, in order, by those of another string of as many."""
    return (
        f"element_at(transform(array({digits}), d -> aggregate(filter(split({m}, ''), c -> c <> ''), struct(1 AS i, '' AS o), "
        "(a, c) -> IF(c BETWEEN '0' AND '9', struct(a.i + 1 AS i, concat(a.o, substr(d, a.i, 1)) AS o), struct(a.i AS i, concat(a.o, c) AS o)), a -> a.o)), 1)"
    )


def _luhn(body: str) -> str:
    """SQL: the check digit that makes body, a string of digits, valid."""
    doubled = "IF(a.i % 2 = 1, (cast(c AS int) * 2) div 10 + (cast(c AS int) * 2) % 10, cast(c AS int))"
    total = (
        f"aggregate(filter(split(reverse({body}), ''), c -> c <> ''), struct(cast(1 AS int) AS i, cast(0 AS int) AS t), "
        f"(a, c) -> struct(a.i + 1 AS i, a.t + cast({doubled} AS int) AS t), a -> a.t)"
    )
    return f"pmod(10 - pmod({total}, 10), 10)"


def _email(m: str, key: str) -> str:
    body = f"regexp_replace({m}, '\\\\.[A-Za-z]+$', '')"
    return f"concat({_recased(body, _cipher(f'lower({body})', key, 'email'))}, regexp_extract({m}, '\\\\.[A-Za-z]+$', 0))"


def _ip(m: str, key: str) -> str:
    """Octet by octet, each moved by a step hashed from those before it, forwards and backwards."""

    def run(octets: str, label: str) -> str:
        step = _step(key, label, "a.p")
        return (
            f"aggregate({octets}, struct('' AS p, cast(array() AS array<int>) AS o), (a, n) -> struct(concat(a.p, '.', cast(n AS string)) AS p, "
            f"array_append(a.o, cast(pmod(n + {step}, 256) AS int)) AS o), a -> a.o)"
        )

    forward = run(f"transform(split({m}, '[.]'), x -> cast(x AS int))", "ip>")
    both = run(f"reverse({forward})", "ip<")
    return f"array_join(transform(reverse({both}), x -> cast(x AS string)), '.')"


def _plain_digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _card(m: str, key: str) -> str:
    """First digit stays; the rest moves; the last digit keeps its distance from the valid check digit."""
    d = _plain_digits(m)
    body = f"concat(substr({d}, 1, 1), {_cipher(f'substr({d}, 2, length({d}) - 2)', key, 'card')})"
    last = f"pmod({_luhn('n')} + cast(right({d}, 1) AS int) - {_luhn(f'left({d}, length({d}) - 1)')}, 10)"
    return _digits_into(m, f"element_at(transform(array({body}), n -> concat(n, cast({last} AS string))), 1)")


# Country codes of one and of two digits; all others have three.
CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()


def _national(m: str) -> str:
    """SQL: the digits of phone number m without its country code, which a plus sign marks."""
    short = "|".join(CODES)
    return f"IF(startswith({m}, '+'), regexp_replace({_plain_digits(m)}, '^(?:{short}|[0-9]{{3}})', ''), {_plain_digits(m)})"


def _phone(m: str, key: str) -> str:
    """The national digits move, the first of them among 2 to 9 or among 0 and 1; a country code stays."""
    d, own = _plain_digits(m), _national(m)
    return _digits_into(m, f"concat(left({d}, length({d}) - length({own})), {_cipher(own, key, 'phone', ('23456789', '01'))})")


def _ssn(m: str, key: str) -> str:
    return _digits_into(m, _cipher(_plain_digits(m), key, "ssn"))


def moved_first_names(key: str) -> dict[str, str]:
    """Lower-case first name -> replacement: a keyed step round the list of its gender and script."""
    out = {}
    for label, names in FIRST_NAMES.items():
        step = 1 + int(hashlib.md5(f"{key}|{label}".encode()).hexdigest()[:8], 16) % (len(names) - 1)
        out |= {n.lower(): names[(i + step) % len(names)] for i, n in enumerate(names)}
    return out


def _name(m: str, key: str) -> str:
    """Word by word: titles stay, listed first names move in their list, others by the cipher, past listed names."""
    moved = moved_first_names(key)
    table = "map(" + ", ".join(f"{_lit(a)}, {_lit(b)}" for a, b in moved.items()) + ")"
    listed = "array(" + ", ".join(_lit(a) for a in moved) + ")"
    title = "array(" + ", ".join(_lit(t.lower()) for t in TITLES) + ")"
    walk = f"aggregate(sequence(1, {len(moved)}), z, (y, i) -> IF(array_contains({listed}, y), {_cipher('y', key, 'name')}, y))"
    again = f"element_at(transform(array({_cipher('lower(w)', key, 'name')}), z -> IF(array_contains({listed}, z), {walk}, z)), 1)"
    first = f"IF(w = upper(w), upper({table}[lower(w)]), {table}[lower(w)])"
    word = f"IF(array_contains({title}, rtrim('.', lower(w))), w, coalesce({first}, {_recased('w', again)}))"
    # separators are single blanks or hyphens: words and separators alternate
    words, gaps = f"split({m}, '[ -]')", f"regexp_extract_all({m}, '[ -]', 0)"
    return f"array_join(zip_with(transform({words}, w -> {word}), {gaps}, (w, g) -> concat(w, coalesce(g, ''))), '')"


REPLACE = {"email": _email, "ip": _ip, "card": _card, "ssn": _ssn, "phone": _phone, "name": _name}


def _kind(m: str) -> str:
    tests = " ".join(f"WHEN {m} RLIKE {_lit(f'^(?:{p})$')} THEN {_lit(k)}" for k, p in PATTERNS.items())
    return f"CASE {tests} END"


def surrogate(kind: str, value: str, key: str = KEY) -> str:
    """SQL expression: the replacement of SQL expression `value`, by SQL expression `kind`."""
    return f"CASE {kind} " + " ".join(f"WHEN {_lit(k)} THEN {f(value, key)}" for k, f in REPLACE.items()) + f" ELSE {value} END"


def _found(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with pii_values and pii_kinds, the entities of the text in order, and pii_gaps, what stands between them.

    One pass of the patterns marks every match and its kind; the marked text is then split. A text that holds one of
    the marks itself is matched, split and told apart by kinds in passes of their own.
    """
    t = F.col(text)
    marked = F.regexp_replace(t, F.lit(GROUPED), F.lit(MARK + GROUP.join(f"${i + 1}" for i in range(len(PATTERNS))) + MARK))
    odd = F.contains(t, F.lit(MARK)) | F.contains(t, F.lit(GROUP))
    none = F.array().cast("array<string>")
    rows = docs.withColumn("pii_parts", F.when(t.rlike(HINT) & ~odd, F.split(marked, MARK, -1)).otherwise(F.when(t.isNotNull() & ~odd, F.array(t))))
    hits = F.transform(F.filter("pii_parts", lambda x, i: i % 2 == 1), lambda e: F.split(e, GROUP, -1))
    rows = rows.withColumn("pii_hits", hits)
    kinds = F.array(*[F.lit(k) for k in PATTERNS])
    kind = F.transform("pii_hits", lambda e: F.element_at(kinds, F.array_position(F.transform(e, lambda g: g != ""), True).cast("int")))
    values = F.regexp_extract_all(t, F.lit(ANY), F.lit(0))
    rows = rows.withColumn("pii_values", F.when(F.coalesce(odd, F.lit(False)), values).otherwise(F.coalesce(F.transform("pii_hits", lambda e: F.array_join(e, "")), none)))
    rows = rows.withColumn("pii_kinds", F.when(F.coalesce(odd, F.lit(False)), F.expr(f"transform(pii_values, m -> {_kind('m')})")).otherwise(F.coalesce(kind, none)))
    gaps = F.when(odd, F.split(t, ANY, -1)).otherwise(F.filter("pii_parts", lambda x, i: i % 2 == 0))
    return rows.withColumn("pii_gaps", gaps).drop("pii_parts", "pii_hits")


def _surnames() -> str:
    """SQL: the words of the names in pii_values without titles, listed first names and initials."""
    other = "array(" + ", ".join(_lit(w.lower()) for w in [*TITLES, *(n for names in FIRST_NAMES.values() for n in names)]) + ")"
    names = "flatten(transform(filter(pii_values, (m, i) -> pii_kinds[i] = 'name'), m -> split(m, '[ -]')))"
    return f"array_distinct(filter({names}, w -> w RLIKE '^\\\\p{{L}}{{2,}}$' AND NOT array_contains({other}, lower(w))))"


def _mentions(g: str, key: str) -> str:
    """SQL: g, a text between entities, with the surnames of pattern pii_bare replaced as in full names."""
    return (
        f"IF(pii_bare IS NULL OR NOT {g} RLIKE pii_bare, {g}, array_join(zip_with(split({g}, pii_bare, -1), regexp_extract_all({g}, pii_bare, 0), "
        f"(t, s) -> concat(t, IF(s IS NULL, '', {_name('s', key)}))), ''))"
    )


def replace_pii(docs: DataFrame, key: str = KEY) -> DataFrame:
    """docs with surrogates in text, n_chars (where it is a column) brought up to date, and n_email, n_ip, n_card, n_ssn, n_phone, n_name, n_entities.

    Columns of docs with these names or starting with pii_ are replaced.
    """
    counts = [f"n_{k}" for k in PATTERNS]
    own = [c for c in docs.columns if c not in (*counts, "n_entities") and not c.startswith("pii_")]
    rows = _found(docs.select(own))
    new = f"zip_with(pii_kinds, pii_values, (k, m) -> {surrogate('k', 'm', key)})"
    rows = rows.withColumn("pii_surnames", F.expr(f"IF(array_contains(pii_kinds, 'name'), {_surnames()}, array())"))
    rows = rows.withColumn("pii_bare", F.expr("IF(size(pii_surnames) > 0, concat('(?<!\\\\p{L})(?:', array_join(pii_surnames, '|'), ')(?!\\\\p{L})'), NULL)"))
    gaps = F.expr(f"transform(pii_gaps, g -> {_mentions('g', key)})")
    text = F.when(F.size("pii_values") > 0, F.array_join(F.zip_with(gaps, F.expr(new), lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))), "")).otherwise(F.col("text"))
    n = [F.expr(f"size(filter(pii_kinds, x -> x = '{k}'))").cast("long").alias(f"n_{k}") for k in PATTERNS]
    out = rows.select(*[text.alias("text") if c == "text" else F.col(c) for c in own], *n, F.size("pii_values").cast("long").alias("n_entities"))
    if "n_chars" in own:  # replaced address octets may be longer or shorter
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def collisions(docs: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, replacement, n): replacements that n > 1 different entities of a corpus share; empty if all is well."""
    canon = F.expr("CASE WHEN kind IN ('card', 'ssn') THEN regexp_replace(value, '[^0-9]', '') WHEN kind = 'phone' THEN " + _national('value') + " WHEN kind = 'ip' THEN array_join(transform(split(value, '[.]'), x -> cast(cast(x AS int) AS string)), '.') ELSE lower(value) END")
    ents = _found(docs.select("text")).select(F.explode(F.arrays_zip("pii_kinds", "pii_values")).alias("e"))
    ents = ents.select(F.col("e.pii_kinds").alias("kind"), F.col("e.pii_values").alias("value"))
    ents = ents.withColumn("entity", canon).groupBy("kind", "entity").agg(F.min("value").alias("value"))
    made = ents.withColumn("value", F.expr(surrogate("kind", "value", key))).withColumn("replacement", canon)
    return made.groupBy("kind", "replacement").agg(F.count("*").alias("n")).where("n > 1")
