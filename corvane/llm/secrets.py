"""Secret scan: fixed patterns plus character Markov models compared by log-likelihood ratio.

Two first-order character models, one of random strings and one of ordinary identifiers, are trained from
labelled samples: of the documents themselves, the values that fixed patterns find are random strings and all other
words of identifier characters are ordinary (`corpus_samples`, at most SAMPLE distinct values of each label, the
first in hash order over all documents), together with made strings of both sorts (`labelled_samples`), so that a
corpus without secrets has a model too. A long run of identifier characters is a secret where the random model
explains it better by more than a threshold per character. The models' spans come on top of the fixed patterns';
those stay as they are.

Defined results: null and empty texts have no spans; every row gives one row, whatever repeats; whole texts are
scanned. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import cut

KINDS = ("assign", "access", "hex", "markov")
# The base patterns.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, so the same spans as [0-9a-f]+ of 24 or more
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
MIN_RUN, THRESHOLD = 20, 0.35
SAMPLE, MOST_VALUE, A_TEXT = 4000, 200, 4  # values of a label, characters of a value, ordinary words taken of one text

# Words of all initial letters from which ordinary identifiers are made.
WORDS = (
    "account action address admin alert amount angle apply array author backup balance batch before binary block "
    "border branch bridge buffer builder button cache call category center change channel check child class client "
    "cloud cluster code column command comment common config connect content context control convert copy count "
    "create cursor customer data database date debug default delete depth device dialog directory display document "
    "domain download draft driver dynamic editor element email enable encode engine entity entry error event example "
    "export factory feature field file filter find first folder footer format frame function general global graph "
    "group handler header height history icon image import index input insert install item key label language layout "
    "length level library limit line link list loader local location login manager map master match member memory "
    "menu message method metric model module monitor name network node notice number object option order output owner "
    "package page panel parent parser path pattern people person picture project property query queue quick quota "
    "radio random range rate read reader ready record redirect reduce reference refresh region register relation "
    "release reload remote remove render repeat replace reply report request require reset resize resolve resource "
    "response result retry return review right role root route router row rule runtime safe sample save scale scan "
    "schedule schema scope screen script scroll search second section select send sequence serial server service "
    "session setting setup shadow shape share shift show sign simple single size skip sleep slice slot small socket "
    "sort source space speed split stack stage start state static status step stock stop storage store stream string "
    "style subject submit success suffix summary support switch symbol sync system table tag target task team "
    "template term test text theme thread ticket time timeout title toggle tool top topic total trace track traffic "
    "transfer transform tree trigger trim type unique unit unlock update upgrade upload usage user utility valid "
    "value variable vector vendor verify version video view visible visit voice volume wait wallet warning watch "
    "water weak web weight wheel white widget width window wire wizard word work worker world wrap write xaxis xml "
    "yaml year yellow yield zero zip zone zoom ability absolute accept access active adapter after agent aggregate "
    "archive argument assert asset assign async attach attribute audio audit average axis back bind body boolean "
    "bound browser bucket bulk bundle byte calendar camera cancel capacity capture card cart catalog chain chart "
    "chunk clear click clock clone close collect color compare compile complete compress compute condition confirm "
    "constant container contract core country coverage crawl credit current decode deliver deploy detail detect diff "
    "digest disable disk dispatch distance drop duplicate duration edge emit empty encrypt endpoint energy escape "
    "evaluate exact except exchange execute exist exit expand expect expire explain expression extend external "
    "extract fail fetch finish fix flag flat flow flush font force forward frequency front gateway generate grant "
    "grid guard hash health hidden hook host hover identity ignore inner instance integer interface internal interval "
    "invoice issue iterator job join journal json jump keyboard kernel kind large last latency launch layer lazy leaf "
    "legacy letter life listen live lock log loop lower machine mail margin mask math matrix measure merge meta "
    "middle migration minute mirror mobile mode money month mouse move multiple mutex native nested next normal null "
    "offset online open operation optional origin overflow parallel parameter partition password patch payment "
    "pending permission phone pixel plan platform play plugin point policy pool popup port position post power prefix "
    "prepare preview price primary print priority private process product profile program progress promise protocol "
    "provider proxy public publish pull purchase push"
).split()


def labelled_samples(seed: int = 7, n: int = 4000, words: Sequence[str] = WORDS) -> list[tuple[str, int]]:
    """n made random strings (label 1) and n made identifiers (label 0) of `words`; a caller may pass real ones instead."""
    r, out = random.Random(seed), []
    sets = ["0123456789abcdef", ALPHABET[:62], ALPHABET[:62] + "+/", ALPHABET[:26] + "0123456789", ALPHABET[:26] + "234567", ALPHABET[:62] + "-_"]
    for i in range(n):
        s = sets[i % len(sets)]
        out.append(("".join(r.choice(s) for _ in range(r.randint(20, 64))), 1))
    for i in range(n):
        parts = [r.choice(words) for _ in range(r.randint(2, 7))]
        if i % 3 == 0:
            parts.insert(r.randint(0, len(parts)), str(r.choice([r.randint(0, 99), r.randint(1990, 2035), r.randint(0, 99999)])))
        joined = ["_".join(parts), "-".join(parts), "/".join(parts), "".join(p.capitalize() for p in parts), "_".join(parts).upper(), "".join(parts)]
        s = r.choice(joined)
        out.append((f"{s}-{r.randint(2000, 2035)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}" if i % 17 == 0 else s, 0))
    out += [("".join(r.choice("0123456789") for _ in range(r.randint(20, 30))), 0) for _ in range(n // 20)]
    out += [(r.choice("=-_+/") * r.randint(20, 60), 0) for _ in range(n // 20)]
    return out


WORDLIKE = re.compile(r"[A-Za-z0-9+/_=-]{6,}")


def labelled_of(text: str) -> list[tuple[int, str, int]]:
    """(label, value, rank) of one text: values that fixed patterns find, and ordinary words outside them, the A_TEXT of least rank."""
    base = base_spans(text)
    out = [(1, (ASSIGN.match(text, a).group(2) if k == 0 else text[a:b])[:MOST_VALUE], 0) for a, k, b in base]
    words = {w[:MOST_VALUE] for m in WORDLIKE.finditer(text) if len(w := m.group()) and not any(a < m.end() and m.start() < b for a, _, b in base)}
    out += [(0, w, 0) for w in sorted(words, key=_rank)[:A_TEXT]]
    return [(label, v, _rank(v)) for label, v, _ in out]


def _rank(value: str) -> int:
    return xxhash.xxh64_intdigest(value) >> 1


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = sorted({x for t in b.column(0).to_pylist() if t for x in labelled_of(t)})
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], ["label", "value", "rank"])


def corpus_samples(docs: DataFrame, most: int = SAMPLE) -> list[tuple[str, int]]:
    """(value, label) of the distinct values of least hash among all documents, at most `most` of each label."""
    rows = cut(docs.select(F.col("text").cast("string")).mapInArrow(_labelled, "label int, value string, rank long").distinct())
    parts = [rows.where(F.col("label") == k).orderBy("rank", "value").limit(most) for k in (0, 1)]
    return sorted((r["value"], r["label"]) for r in parts[0].unionByName(parts[1]).collect())  # at most 2 * most short values


def learn(docs: DataFrame, most: int = SAMPLE) -> np.ndarray:
    """The ratio of the two models, trained on the documents' own labelled values and on made ones."""
    return train([*corpus_samples(docs, most), *labelled_samples()])


def train(samples: Iterable[tuple[str, int]]) -> np.ndarray:
    """Log-likelihood ratio of each character pair, random over ordinary; the last row is the start of a string."""
    size, at = len(ALPHABET), {c: i for i, c in enumerate(ALPHABET)}
    counts = np.full((2, size + 1, size), 0.05)
    for s, label in samples:
        before = size
        for c in s:
            if (now := at.get(c)) is not None:
                counts[int(label), before, now] += 1
                before = now
    models = np.log(counts / counts.sum(2, keepdims=True))
    return models[1] - models[0]


@lru_cache(4)
def default_model() -> np.ndarray:
    return train(labelled_samples())


def ratio(s: str, model: np.ndarray) -> float:
    """Mean log-likelihood ratio a character."""
    codes = np.frombuffer(s.encode("ascii"), np.uint8)
    at = _CODES[codes]
    return float(model[np.concatenate(([len(ALPHABET)], at[:-1])), at].mean())


_CODES = np.zeros(128, np.int64)
for _i, _c in enumerate(ALPHABET):
    _CODES[ord(_c)] = _i


def _keyed(text: str) -> bool:
    low = text.lower()
    return any(k in low for k in KEYWORDS)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, sorted."""
    out = []
    if ("=" in text or ":" in text) and _keyed(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def markov_spans(text: str, base: list[tuple[int, int, int]], model: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, int, int]]:
    """Runs that the random model explains better and that no fixed pattern's span already holds."""
    out, at, reach = [], 0, 0
    for m in RUN.finditer(text):
        while at < len(base) and reach < m.end():  # spans are sorted, so what holds the run ends at the furthest end before it
            if base[at][0] > m.start():
                break
            reach = max(reach, base[at][2])
            at += 1
        if reach < m.end() and ratio(m.group(), model) > threshold:
            out.append((m.start(), 3, m.end()))
    return out


def scan(text: str | None, model: np.ndarray | None = None, threshold: float = THRESHOLD) -> tuple[list, list]:
    """(base spans, all spans) of a text, each (start, kind, end) in order."""
    text = text or ""
    if not any(len(w) >= 11 for w in text.split()) and not ("=" in text or ":" in text):
        return [], []
    base = base_spans(text)
    more = markov_spans(text, base, default_model() if model is None else model, threshold)
    return base, sorted(base + more)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str | None, model: np.ndarray | None = None, mark: str = "[SECRET]") -> str | None:
    """The text with each group of overlapping spans replaced by a mark; null stays null."""
    spans = scan(text, model)[1]
    if not spans:
        return text
    out, at, end = [], 0, 0
    merged: list[list[int]] = []
    for a, _, b in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[at:a], mark]
        at = end = b
    return "".join(out) + text[end:]


def _scan(model: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for t in b.column(1).to_pylist():
                base, all_ = scan(t, model)
                for k in range(3):
                    cols[k].append(sum(x[1] == k for x in base))
                cols[3].append(hashlib.sha256(joined(base).encode()).hexdigest())
                cols[4].append(joined(all_))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def find_secrets(docs: DataFrame, model: np.ndarray | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row; without a model one is learned from docs."""
    model = learn(docs) if model is None else model
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scan(model), schema)


def _redact(model: np.ndarray, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([redact(t, model) for t in b.column(at).to_pylist()], b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(b.columns)], schema=b.schema)

    return run


def redact_secrets(docs: DataFrame, model: np.ndarray | None = None) -> DataFrame:
    """docs with every secret span replaced by a mark, and n_chars (where it is a column) brought up to date."""
    model = learn(docs) if model is None else model
    out = docs.mapInArrow(_redact(model, docs.columns.index("text")), docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)
