"""Order-preserving packing of documents into training sequences by dynamic programming.

The token stream of a partition, in its order, is cut into windows of at most 2048 tokens. A window's cost is its
padding plus a penalty for what its end truncates: nothing at a document's end, little at a sentence's end, more
on a grid of other places. With f(j) the least cost of a stream cut at j, f(j) = pen(j) + 2048 - j +
min over i in [j - 2048, j) of f(i) + i, and a monotone queue keeps that sliding minimum in constant time a cut.

The stream is solved in blocks of bounded length; what follows a block's last full window joins the next block,
so blocks do not cost padding. A partition's last tokens take either one padded window or windows of
powers of two, which need no padding. No row leaves its partition, so nothing is shuffled and no memory grows
with the input beyond one block and one document.

Defined results: null and empty texts are one token, the end token; repeated rows are packed each; a document may
span sequences and appears in pieces whose ids, in order, are the document's.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.tokens import Encoder, encoder

WINDOW, END_ID = 2048, 1
BLOCK, GRID = 400_000, 16
SENTENCE_PENALTY, TRUNCATION_PENALTY = 4.0, 32.0


def sentence_ends(enc: Encoder) -> np.ndarray:
    """Per id, whether a sentence may end after it."""
    return np.array([s.rstrip(b" ")[-1:] in (b".", b"!", b"?", b"\n") for s in enc.letters])


def cuts(n: int, doc_ends: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window may end, ascending, and their penalties."""
    penalty = np.full(n + 1, np.inf)
    penalty[::GRID] = TRUNCATION_PENALTY
    penalty[1:][sentence] = SENTENCE_PENALTY
    penalty[doc_ends] = 0.0
    penalty[[0, n]] = 0.0
    at = np.flatnonzero(np.isfinite(penalty))
    return at, penalty[at]


def best_cuts(at: np.ndarray, penalty: np.ndarray, window: int = WINDOW) -> list[int]:
    """Ends of the cheapest windows that cover the stream; at[0] is 0."""
    places, pens = at.tolist(), penalty.tolist()
    key, back = [0.0] * len(places), [0] * len(places)  # key: least cost of a cut there, plus its place
    queue: deque[int] = deque([0])
    for j in range(1, len(places)):
        p = places[j]
        while places[queue[0]] < p - window:
            queue.popleft()
        i = queue[0]
        back[j] = i
        k = key[j] = key[i] + window + pens[j]
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j)
    out, j = [], len(places) - 1
    while j:
        out.append(places[j])
        j = back[j]
    return out[::-1]


def tail_cuts(n: int, window: int = WINDOW) -> list[int]:
    """Ends of the windows for a partition's last n <= window tokens: one, or powers of two if those cost less."""
    powers = [1 << k for k in range(window.bit_length() - 1, -1, -1) if n >> k & 1]
    if not powers or (len(powers) - 1) * TRUNCATION_PENALTY >= window - n:
        return [n] if n else []
    return np.cumsum(powers).tolist()


class Packer:
    """Packs one stream of (doc_id, ids); yields pieces (doc_id, start, length, crc32, doc_tokens, sequence, offset)."""

    def __init__(self, ends: np.ndarray, first: int, block: int = BLOCK):
        self.is_end, self.sequence, self.block = ends, first, block
        self.docs: list[tuple] = []  # doc_id, ids not yet packed, ids of it packed before, its tokens
        self.held = 0

    def add(self, doc_id, ids: np.ndarray) -> Iterator[tuple]:
        self.docs.append((doc_id, ids, 0, len(ids)))
        self.held += len(ids)
        if self.held >= self.block:
            yield from self.flush(False)

    def flush(self, last: bool) -> Iterator[tuple]:
        if not self.docs:
            return
        ids = np.concatenate([d[1] for d in self.docs])
        doc_ends = np.cumsum([len(d[1]) for d in self.docs])
        windows = best_cuts(*cuts(len(ids), doc_ends, self.is_end[ids]))
        rest = windows[-2] if len(windows) > 1 else 0  # the last window waits for more
        windows.pop()
        if last:
            windows += [rest + c for c in tail_cuts(len(ids) - rest)]
        yield from self.pieces(ids, doc_ends, windows)
        self.drop(windows[-1] if windows else 0)

    def pieces(self, ids: np.ndarray, doc_ends: np.ndarray, windows: list[int]) -> Iterator[tuple]:
        raw = np.ascontiguousarray(ids, "<u4")
        a, d, begin = 0, 0, 0
        for w in windows:
            offset = 0
            while a < w:
                doc_id, _, done, total = self.docs[d]
                b = min(w, int(doc_ends[d]))
                yield doc_id, done + a - begin, b - a, zlib.crc32(raw[a:b]), total, self.sequence, offset
                offset += b - a
                a = b
                if a == doc_ends[d]:
                    d, begin = d + 1, a
            self.sequence += 1

    def drop(self, n: int) -> None:
        self.held -= n
        kept = []
        for doc_id, ids, done, total in self.docs:
            gone = min(n, len(ids))
            n -= gone
            if gone < len(ids):
                kept.append((doc_id, ids[gone:], done + gone, total))
        self.docs = kept


FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack(vocabulary: str, end_id: int):
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), FIELDS, strict=True)], [n for n, _ in FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        packer = Packer(sentence_ends(enc), TaskContext.get().partitionId() << 32)
        for b in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = enc.ids(text or "")
                ids.append(end_id)
                rows.extend(packer.add(doc_id, np.array(ids, np.uint32)))
            if rows:
                yield batch(rows)
        if rows := list(packer.flush(True)):
            yield batch(rows)

    return run


def in_ranges(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs as ranges of their key, one a core, if their files would leave cores idle; a larger table stays as it is."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartitionByRange(cores, key).sortWithinPartitions(key) if docs.rdd.getNumPartitions() < cores else docs


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k", end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents; see SCHEMA. sequence_id holds the partition in its upper half."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_pack(vocabulary, end_id), SCHEMA)
