"""Toxicity by a linear-chain conditional random field over word tokens.

Two tags, plain and toxic. Token labels come from the document labels: features (words and word beginnings) that
cover toxic documents and no plain ones are picked greedily, and their tokens are the labelled toxic tokens. All of
the field's weights (emissions, transitions, start) are then fitted together to those sequences: the conditional
likelihood's exact gradient, observed less expected counts, is climbed by L-BFGS until it is flat. Words whose
features have no weight all share one emission, so forward-backward runs over a document's weighted words only and
crosses the runs between them by a power of the transition matrix, in closed form; so do the expected counts of the
transitions inside a run. Costs follow the number of weighted words. Marginals aggregate to a document score (a
logistic of the expected number of toxic tokens and the greatest marginal) and to the offending offsets.

The model is fitted on a bounded sample of labelled rows: at most SAMPLE documents of each label, the first in hash
order of doc_id among those that have a text of at most SAMPLE_CHARS (longer texts are left out of the fit, never of
the scoring). Of a doc_id's several texts the least counts, so the driver never gets more than 2 * SAMPLE texts.

Defined results: null and empty texts have no tokens and get the score of a document without evidence; every row
gets one row, whatever repeats; without labelled rows of both kinds every score is 0. Spans are code points, end
exclusive, in order.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import cut

SAMPLE, SAMPLE_CHARS = 1500, 6_000
WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6, 7)
REMEMBERED = 300_000


def features(word: str) -> list[str]:
    """The word itself and its beginnings."""
    return ["=" + word] + ["^" + word[:k] for k in PREFIXES if len(word) >= k]


def fold(doc_id: Column) -> Column:
    """0 to 4; rows of fold 0 are held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def weak_features(docs: list[list[str]], y: list[int], least: int = 3, covers: int = 3, cost: float = 2.0) -> list[str]:
    """Features that mark the toxic documents: greedy cover, each document up to `covers` times.

    A feature's gain is the number of toxic documents it newly covers less `cost` times the number it would cover
    if it were as frequent there as in plain documents.
    """
    n1, n0 = max(1, sum(y)), max(1, len(y) - sum(y))
    rows = [sorted({f for w in set(words) for f in features(w)}) for words, label in zip(docs, y, strict=True) if label]
    common = {f for f, n in Counter(f for r in rows for f in r).items() if n >= least}
    holds: dict[str, set[int]] = defaultdict(set)
    for i, r in enumerate(rows):
        for f in r:
            if f in common:
                holds[f].add(i)
    plain: Counter = Counter()
    for words, label in zip(docs, y, strict=True):
        if not label:
            plain.update(common.intersection(f for w in set(words) for f in features(w)))
    loss = {f: cost * plain[f] * n1 / n0 for f in common}
    open_ = {f: s for f, s in holds.items() if len(s) - loss[f] >= least}
    need, demand, out = max(2.0, 0.004 * n1), [covers] * len(rows), []
    while open_:
        # on a tie the longer beginning, then the alphabet
        best = max(open_, key=lambda f: (len(open_[f]) - loss[f], len(f), f))
        if len(open_[best]) - loss[best] < need:
            break
        out.append(best)
        full = set()
        for i in open_.pop(best):
            demand[i] -= 1
            if not demand[i]:
                full.add(i)
        inner = [f for f in open_ if f[0] + best[1:] == f[: len(best)] and best[0] == "^"]
        for f in inner:  # what a chosen beginning already holds
            del open_[f]
        open_ = {f: t for f, s in open_.items() if len(t := s - full if full else s) - loss[f] >= need}
    return out


class Field:
    """Weights of a fitted field; small, and sent to the tasks by value."""

    def __init__(self, weights: dict[str, float], transition: np.ndarray, start: np.ndarray, plain: float):
        self.weights, self.transition, self.start, self.plain = weights, transition, start, plain
        self.known: dict[str, float | None] = {}
        self.logistic, self.least_score = np.zeros(4), 0.0
        m = np.exp(transition) * np.exp([0.0, plain])[None, :]
        val, vec = np.linalg.eig(m)
        self.eigen = val.real, vec.real, np.linalg.inv(vec).real

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def emission(self, word: str) -> float | None:
        """Score of tag toxic over plain beyond the shared one, None for a word without weighted features."""
        known = self.known
        if word in known:
            return known[word]
        got = [self.weights[f] for f in features(word) if f in self.weights]
        if len(known) > REMEMBERED:
            known.clear()
        known[word] = out = sum(got) if got else None
        return out

    def step(self, r: int) -> np.ndarray:
        """The r-th power of the matrix that crosses one unweighted word, scaled by its greatest eigenvalue."""
        val, vec, inv = self.eigen
        return (vec * (val / val.max()) ** r) @ inv

    def marginals(self, at: list[int], scores: list[float], n: int) -> tuple[np.ndarray, float]:
        """Toxic marginals of the weighted words at places `at` of n words, and their sum."""
        if not at:
            return np.zeros(0), 0.0
        m, moves = np.exp(self.transition), []
        a = np.exp(self.start) * np.exp([0.0, self.plain])
        alpha, before = [], -1
        for p, s in zip(at, scores, strict=True):
            e = np.exp(np.array([0.0, self.plain + s]))
            if before < 0:
                v = np.exp(self.start) * e if p == 0 else (a @ self.step(p - 1) @ m) * e
                t = None
            else:
                t = self.step(p - before - 1) @ m * e[None, :]
                v = alpha[-1] @ t
            alpha.append(v / v.sum())
            moves.append(t)
            before = p
        beta = self.step(n - 1 - at[-1]) @ np.ones(2)
        out = np.zeros(len(at))
        for i in range(len(at) - 1, -1, -1):
            g = alpha[i] * beta
            out[i] = g[1] / g.sum()
            if i:
                beta = moves[i] @ beta
                beta = beta / beta.sum()
        return np.clip(out, 0.0, 1.0), float(np.clip(out, 0.0, 1.0).sum())

    def read(self, text: str) -> tuple[list[int], list[float], int]:
        """Places and scores of the weighted words, and the number of words."""
        words = WORD.findall(text.lower())
        known, emission = self.known, self.emission
        at, scores = [], []
        for i, w in enumerate(words):
            s = known[w] if w in known else emission(w)
            if s is not None:
                at.append(i)
                scores.append(s)
        return at, scores, len(words)

    def evidence(self, text: str) -> list[float]:
        """One, expected number of toxic tokens (log), its rate among the words (log), and the greatest marginal."""
        at, scores, n = self.read(text)
        p, total = self.marginals(at, scores, n)
        return [1.0, math.log1p(total), math.log1p(1000 * total / (n + 50)), float(p.max()) if len(p) else 0.0]

    def score(self, text: str | None) -> float:
        return float(1 / (1 + math.exp(-float(np.clip(self.logistic @ self.evidence(text or ""), -50, 50)))))

    def spans(self, text: str | None, least: float = 0.5) -> list[tuple[int, int, float]]:
        """Offending offsets: (start, end, marginal) of words whose marginal is at least `least`."""
        low = (text or "").lower()
        if len(low) != len(text or ""):  # a letter whose lower case is longer moves offsets; lower letter by letter
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text or "")
        found = list(WORD.finditer(low))
        hit = [(i, s) for i, m in enumerate(found) if (s := self.emission(m.group())) is not None]
        p, _ = self.marginals([i for i, _ in hit], [s for _, s in hit], len(found))
        return [(found[i].start(), found[i].end(), float(q)) for (i, _), q in zip(hit, p, strict=True) if q >= least]


class Sequences:
    """Labelled tag sequences as segments: so many unweighted steps, then a weighted word, then the last steps.

    hits: per sequence its weighted words' places, features and tags; all counts the gradient needs come from here.
    """

    def __init__(self, seqs: list[list[str]], tags: list[np.ndarray], names: list[str]):
        at = {f: i for i, f in enumerate(names)}
        rows = [(w, t) for w, t in zip(seqs, tags, strict=True) if len(t)]
        self.n, self.f = len(rows), len(names)
        self.pairs, self.first, self.on = np.zeros((2, 2)), np.zeros(2), np.zeros(len(names))
        self.toxic, known, hits = 0.0, {}, []
        for words, t in rows:
            self.first[int(t[0])] += 1
            np.add.at(self.pairs, (t[:-1], t[1:]), 1)
            self.toxic += float(t.sum())
            mine = []
            for i, w in enumerate(words):
                if w not in known:
                    known[w] = [at[f] for f in features(w) if f in at]
                if known[w]:
                    mine.append((i, known[w]))
                    self.on[known[w]] += t[i]
            hits.append(mine)
        order = sorted(range(self.n), key=lambda r: -len(hits[r]))  # most hits first: a segment's sequences are the first ones
        rows, hits = [rows[r] for r in order], [hits[r] for r in order]
        most = max(map(len, hits), default=0)
        self.active = [sum(len(h) >= j for h in hits) for j in range(most + 1)]
        self.steps, self.width = np.zeros((self.n, most + 1), np.int64), most
        place, feature = [], []
        for r, ((words, _), mine) in enumerate(zip(rows, hits, strict=True)):
            before = 0
            for j, (i, fs) in enumerate(mine):
                self.steps[r, j] = i - before
                before = i
                place += [r * most + j] * len(fs)
                feature += fs
            self.steps[r, len(mine)] = len(words) - 1 - before
        self.place, self.feature = np.array(place, np.int64), np.array(feature, np.int64)

    def likelihood(self, x: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
        """Penalised log-likelihood and its gradient at x: word weights, the four transitions, the two starts, the shared emission."""
        f = self.f
        trans, start, plain = x[f : f + 4].reshape(2, 2), x[f + 4 : f + 6], x[f + 6]
        emit = np.bincount(self.place, x[self.feature], self.n * self.width).reshape(self.n, self.width)
        up = np.exp(np.array([0.0, plain]))
        step = np.exp(trans) * up[None, :]
        val, vec = np.linalg.eig(step)
        val, vec = val.real, vec.real
        inv, top = np.linalg.inv(vec), val.max()
        low = val / top

        def across(v: np.ndarray, n: np.ndarray) -> np.ndarray:
            return (v @ vec * low[None, :] ** n[:, None]) @ inv

        alpha = np.tile(np.exp(start) * up, (self.n, 1))
        log_z = np.log(alpha.sum(1)) + self.steps.sum(1) * math.log(top)
        alpha /= alpha.sum(1, keepdims=True)
        before, after = [], []  # at each segment's beginning, and at its word
        boost = np.stack([np.ones(emit.shape), np.exp(emit)], 2)  # 1 where a sequence has no such word
        for j, c in enumerate(self.active):
            before.append(alpha[:c].copy())
            now = across(alpha[:c], self.steps[:c, j])
            if j < self.width:
                now = now * boost[:c, j]
            total = now.sum(1, keepdims=True)
            log_z[:c] += np.log(total[:, 0])
            alpha[:c] = now / total
            after.append(alpha[:c].copy())
        beta, pairs, on, toxic = np.ones((self.n, 2)), np.zeros((2, 2)), np.zeros((self.n, self.width)), 0.0
        scaled = step / top
        for j in range(self.width, -1, -1):
            c = self.active[j]
            n, back = self.steps[:c, j], beta[:c]
            if j < self.width:
                g = after[j] * back
                on[:c, j] = g[:, 1] / g.sum(1)
                back = back * boost[:c, j]
            u, v = before[j] @ vec, back @ inv.T
            # sums over i of low_k^i low_m^(n-1-i), the steps before and after each step of the run
            ran = np.maximum(n - 1, 0)
            same = [n * low[k] ** ran for k in (0, 1)]
            gap = low[0] - low[1]
            cross = (low[0] ** n - low[1] ** n) / gap if abs(gap) > 1e-12 else same[0]
            near = (v * low[None, :] ** n[:, None]) @ vec.T
            z = (before[j] * near).sum(1)
            mixed = np.array([[(u[:, k] * (same[k] if k == m else cross) * v[:, m] / z).sum() for m in (0, 1)] for k in (0, 1)])
            got = scaled * (inv.T @ mixed @ vec.T)
            pairs += got
            toxic += float(got[:, 1].sum())
            beta[:c] = near / near.sum(1, keepdims=True)
        g0 = before[0] * beta
        head = (g0 / g0.sum(1, keepdims=True)).sum(0)
        expect = np.bincount(self.feature, on.reshape(-1)[self.place], f)
        value = float(self.on @ x[:f] + (self.pairs * trans).sum() + self.first @ start + self.toxic * plain - log_z.sum())
        grad = np.concatenate([self.on - expect, (self.pairs - pairs).reshape(-1), self.first - head, [self.toxic - toxic - head[1]]])
        return value - l2 / 2 * float(x @ x), grad - l2 * x


def climb(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int = 200, memory: int = 10, flat: float = 1e-7) -> np.ndarray:
    """A maximum of a concave function by L-BFGS with halved steps."""
    value, g = f(x)
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if np.abs(g).max() < flat * max(1.0, abs(value)):
            break
        d, back = g.copy(), []
        for s, y in reversed(kept):
            back.append(a := (s @ d) / (s @ y))
            d = d - a * y
        if kept:
            s, y = kept[-1]
            d = d * (s @ y) / (y @ y)
        for (s, y), a in zip(kept, reversed(back), strict=True):
            d = d + (a - (y @ d) / (s @ y)) * s
        rate = 1.0 if kept else min(1.0, 1.0 / np.abs(g).sum())
        while rate > 1e-12:
            new, h = f(x + rate * d)
            if new >= value + 1e-4 * rate * float(g @ d):
                break
            rate /= 2
        else:
            break
        s, y = rate * d, g - h
        if s @ y > 1e-12:
            kept = [*kept[-memory + 1 :], (s, y)]
        gain, x, value, g = new - value, x + s, new, h
        if gain < flat * abs(value):
            break
    return x


def fit_field(seqs: list[list[str]], tags: list[np.ndarray], names: list[str], l2: float = 0.5) -> Field:
    """The field of greatest penalised likelihood of labelled tag sequences, from a start at the counts' own ratios."""
    data = Sequences(seqs, tags, names)
    pairs, first = data.pairs + 0.5, data.first + 0.5
    x = np.concatenate([np.zeros(len(names)), np.log(pairs / pairs.sum(1, keepdims=True)).reshape(-1), np.log(first / first.sum()), [0.0]])
    x = climb(lambda v: data.likelihood(v, l2), x)
    n = len(names)
    return Field(dict(zip(names, x[:n].tolist(), strict=True)), x[n : n + 4].reshape(2, 2), x[n + 4 : n + 6], float(x[n + 6]))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2) -> np.ndarray:
    """Newton's method; the columns of x are a one and the evidence."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + l2 * w
        h = (x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(rows: list[tuple[str, int]]) -> Field | None:
    """A field from (text, label) rows; None unless both labels occur."""
    y = [int(label) for _, label in rows]
    if len(set(y)) < 2:
        return None
    docs = [WORD.findall((t or "").lower()) for t, _ in rows]
    names = weak_features(docs, y)
    marked = set(names)
    tags = [np.array([bool(marked.intersection(features(w))) for w in words], np.int64) if label else np.zeros(len(words), np.int64) for words, label in zip(docs, y, strict=True)]
    field = fit_field(docs, tags, names)
    field.logistic = fit_logistic(np.array([field.evidence(t or "") for t, _ in rows]), np.array(y, float))
    field.least_score = field.score("")  # texts that score no more have no weighted word
    return field


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Field | None:
    """A field from the labelled rows outside fold 0; reads at most `sample` texts of each label."""
    own = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)")
    own = own.where(fold(F.col("id")) != 0).groupBy("id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where(F.length("text") <= chars)
    own = cut(own.join(texts.select("id"), "id", "left_semi"))  # ids alone
    parts = [own.where(F.col("toxic") == label).orderBy(F.xxhash64("id"), "id").limit(sample) for label in (0, 1)]
    ids = F.broadcast(parts[0].unionByName(parts[1]))  # at most 2 * sample ids
    rows = texts.join(ids, "id").groupBy("id", "toxic").agg(F.min("text").alias("text")).collect()
    return fit([(r["text"], r["toxic"]) for r in sorted(rows, key=lambda r: r["id"])])


def _score(field: Field | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            s = [field.score(t) if field else 0.0 for t in texts]
            spans = [",".join(f"{a}:{z}" for a, z, _ in field.spans(t)) if field and v > field.least_score else "" for t, v in zip(texts, s, strict=True)]
            cols = [b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array([int(v >= 0.5) for v in s], pa.int32()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "score", "predicted", "spans"])

    return run


def score(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, held_out, score, predicted, spans (start:end of the offending words, comma-joined) of every row."""
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("long"), held, F.col("text").cast("string"))
    return rows.mapInArrow(_score(field), "doc_id long, held_out boolean, score double, predicted int, spans string")


def _keep(field: Field | None, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([not field or field.score(t) < 0.5 for t in b.column(at).to_pylist()], pa.bool_()))

    return run


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that the field scores 0.5 or more."""
    field = learn(docs, labels)
    return docs.mapInArrow(_keep(field, docs.columns.index("text")), docs.schema)
