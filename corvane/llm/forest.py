"""Approximate nearest neighbours with a hash-prefix forest (LSH forest).

Every vector gets one long hash string a tree: the signs of 64 random projections. A tree is a sorted array of
these strings. A query descends each tree to its longest prefix match, then all trees ascend together, one bit at
a time, and take in every string that shares the query's prefix. The ascent goes on at least until LEAST_CANDIDATES
are held, and ends at the depth where a neighbour as near as the k-th best found so far would have shared a prefix
in some tree with probability CAUGHT: with angle a, depth d and L trees, 1 - (1 - (1 - a/pi)^d)^L. So the work
follows the data: near neighbours end the ascent early, at long prefixes, while on independent random directions,
whose nearest neighbours lie at 60 degrees and more, the prefix that finds them is six bits long and holds half of
all rows. Candidates are scored exactly in double precision.

Scale: vectors are dealt into shards by a hash of their id, each shard small enough for one task's memory, and
queries into blocks; each (shard, block) cell is one group that builds the shard's forest and answers the block,
so neither a shard nor a block grows with the input. Every shard gives each query its best k, and k a shard are
merged; as a shard holds a random part of a query's k neighbours, its ascent aims at that many only. Inside a shard
equal vectors are indexed once with their k + 1 smallest ids, which is exact for a top k with ties to the smaller
id and keeps a group of copies from filling the candidates.

Inner products of vectors of unequal length are reduced to angles: indexed vectors get one more component,
sqrt(longest ** 2 - own ** 2), queries get 0 there.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components
take no part, as query or candidate; fewer candidates than k give all of them; repeated ids count as rows, but a
row never finds its own id; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TREES, BITS, SEED = 48, 64, 11
SHARD_ROWS, LEAST_SHARD, BLOCK_ROWS = 50_000, 4_000, 20_000
LEAST_CANDIDATES, CAUGHT = 400, 0.9

SCHEMA = "query_id long, vec_id long, score double"


@lru_cache(4)
def projections(dim: int, trees: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim + 1, trees * BITS)).astype(np.float32)


def hashes(x: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """(trees, rows) hash strings as unsigned integers, first bit highest; x has the reduction's last component."""
    p, out = projections(x.shape[1] - 1, trees, seed), np.empty((trees, len(x)), np.uint64)
    for t in range(trees):
        for a in range(0, len(x), 8192):
            bits = np.packbits(x[a : a + 8192].astype(np.float32) @ p[:, t * BITS : (t + 1) * BITS] > 0, axis=1)
            out[t, a : a + 8192] = np.ascontiguousarray(bits).view(">u8")[:, 0]
    return out


class Forest:
    def __init__(self, x: np.ndarray, trees: int = TREES, seed: int = SEED):
        self.x, self.trees, self.seed = x, trees, seed
        norms = np.sqrt((x * x).sum(1))
        longest = norms.max(initial=0.0)
        more = np.sqrt(np.maximum(longest**2 - norms**2, 0.0))
        h = hashes(np.column_stack([x, more]), trees, seed)
        self.order = np.argsort(h, axis=1, kind="stable")
        self.sorted = np.take_along_axis(h, self.order, axis=1)

    def ranges(self, h: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Per tree and query, the part of the sorted array that shares the first `depth` bits."""
        lo, hi = np.empty(h.shape, np.int64), np.empty(h.shape, np.int64)
        if depth == 0:
            lo[:], hi[:] = 0, self.sorted.shape[1]
            return lo, hi
        mask = np.uint64((2**BITS - 1) << (BITS - depth) & (2**BITS - 1))
        for t in range(self.trees):
            first = h[t] & mask
            lo[t] = np.searchsorted(self.sorted[t], first, "left")
            hi[t] = np.searchsorted(self.sorted[t], first | ~mask, "right")
        return lo, hi

    def ascend(self, h: np.ndarray, least: int) -> np.ndarray:
        """Greatest depth at which each query's ranges hold `least` strings, counted over all trees; found by halving, as counts only grow on the way up."""
        low, high = np.zeros(h.shape[1], np.int64), np.full(h.shape[1], BITS, np.int64)
        while (low < high).any():
            middle = (low + high + 1) // 2
            enough = np.zeros(h.shape[1], bool)
            for d in np.unique(middle).tolist():
                at = np.flatnonzero(middle == d)
                lo, hi = self.ranges(h[:, at], d)
                enough[at] = (hi - lo).sum(0) >= least
            low, high = np.where(enough, middle, low), np.where(enough, high, middle - 1)
        return low

    def within(self, h: np.ndarray, depth: int) -> Iterator[np.ndarray]:
        """For each query the places of all rows that share `depth` bits with it in some tree."""
        lo, hi = self.ranges(h, depth)
        mark = np.zeros(self.sorted.shape[1], bool)
        for i in range(h.shape[1]):
            mark[np.concatenate([self.order[t, a:b] for t, (a, b) in enumerate(zip(lo[:, i].tolist(), hi[:, i].tolist(), strict=True))])] = True
            found = np.flatnonzero(mark)
            mark[found] = False
            yield found


def depth_for(cosine: float, trees: int, caught: float = CAUGHT) -> int:
    """Greatest depth at which a neighbour of that cosine shares a prefix in some tree with probability `caught`."""
    same = 1 - math.acos(min(1.0, max(-1.0, cosine))) / math.pi
    need = -math.expm1(math.log1p(-caught) / trees)
    return BITS if same >= 1 else min(BITS, int(math.log(need) / math.log(same))) if same > 0 else 0


def answer(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, aim: int | None = None, caught: float = CAUGHT, trees: int = TREES, seed: int = SEED) -> pd.DataFrame:
    """Best k of one shard for each query: (query_id, vec_id, score). The ascent ends for the aim-th best, by default the k-th."""
    order = np.lexsort((ids, *x.T[::-1]))
    ids, x = ids[order], x[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]).any(1)
    first = np.flatnonzero(new)
    ends = np.append(first[1:], len(x))
    forest = Forest(x[first], trees, seed)
    aim, least = min(aim or k, k) + 1, max(LEAST_CANDIDATES, 4 * k)
    longest = float(np.sqrt((forest.x * forest.x).sum(1)).max(initial=0.0))
    out: list[tuple] = []

    def report(name: int, v: np.ndarray, c: np.ndarray, s: np.ndarray) -> None:
        if len(c) > k + 1:
            edge = np.partition(s, len(s) - k - 1)[len(s) - k - 1]
            c = c[s >= edge - 1e-9 * max(1.0, abs(edge))]
        s = (forest.x[c] * v).sum(1)  # each row by itself, so equal vectors score alike
        best: list[tuple] = []
        for value, place in sorted(zip((-s).tolist(), c.tolist(), strict=True)):
            if len(best) > k and value > best[-1][0]:
                break
            best += [(value, v) for v in ids[first[place] : min(ends[place], first[place] + k + 1)].tolist() if v != name][:k]
        best.sort()
        out.extend((name, v, -value) for value, v in best[:k])

    for a in range(0, len(q), 256):
        block = q[a : a + 256]
        h = hashes(np.column_stack([block, np.zeros(len(block))]), trees, seed)
        length = longest * np.sqrt((block * block).sum(1))
        depth, sims = forest.ascend(h, least), None
        open_ = np.arange(len(block))
        while len(open_):  # all trees ascend together; queries at one depth are looked up at once
            above = []
            for d in np.unique(depth[open_]).tolist():
                at = open_[depth[open_] == d]
                for i, c in zip(at.tolist(), forest.within(h[:, at], d), strict=True):
                    if sims is None and 8 * len(c) > len(first):  # so many candidates that one product for the block costs less
                        sims = block @ forest.x.T
                    s = sims[i][c] if sims is not None else forest.x[c] @ block[i]
                    reach = float(np.partition(s, len(s) - aim)[len(s) - aim] / length[i]) if len(c) >= aim else -1.0
                    stop = depth_for(reach, trees, caught)
                    if d > stop:
                        depth[i] = max(stop, d - 3)  # not at once: better finds on the way may end the ascent sooner
                        above.append(i)
                    else:
                        report(int(query_ids[a + i]), block[i], c, s)
            open_ = np.array(above, np.int64)
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def _cell(k: int, aim: int, caught: float, trees: int, seed: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(data: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(data) or not len(queries):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        rows = [np.stack(d["v"].to_numpy()).astype(np.float64) for d in (data, queries)]
        return answer(data["id"].to_numpy(np.int64), rows[0], queries["id"].to_numpy(np.int64), rows[1], k, aim, caught, trees, seed)

    return run


def usable(vectors: DataFrame, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """(id, v) of vectors that are neither null nor zero nor hold null or non-finite components."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(col).cast("array<double>").alias("v")).where("id is not null and v is not null and size(v) > 0")
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where(finite & F.exists("v", lambda c: c != 0))


def of_common_length(rows: DataFrame) -> DataFrame:
    """Rows whose vector has the most frequent length (the smaller on a tie); lengths are few, one sum for each."""
    top = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (top["n"] if top else 0))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, caught: float = CAUGHT, trees: int = TREES, seed: int = SEED, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, narrow: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest by inner product. vectors, queries: (id, v).

    narrow: the vectors were single-precision numbers, and travel as such.
    """
    spark = vectors.sparkSession
    n, n_queries = vectors.count(), queries.count()
    spread = max(2, spark.sparkContext.defaultParallelism)
    # cells of bounded size; a small table is still spread over the cores, by smaller shards and then by query blocks
    shards, blocks = max(-(-n // shard_rows), min(spread, n // LEAST_SHARD), 1), max(1, -(-n_queries // block_rows))
    blocks = max(blocks, min(-(-spread // shards), -(-n_queries // 64) or 1))
    share = k / shards  # of a query's k neighbours, in a shard, on average
    aim = min(k, math.ceil(share + 3 * math.sqrt(share)))
    deal = lambda m: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(m)).cast("int")
    v = F.col("v").cast("array<float>") if narrow else F.col("v")
    data = vectors.select("id", v.alias("v"), deal(shards).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asked = queries.select("id", v.alias("v"), deal(blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    cell = ["shard", "block"]
    found = data.groupBy(*cell).cogroup(asked.groupBy(*cell)).applyInPandas(_cell(k, aim, caught, trees, seed), SCHEMA)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """search() for the vectors whose vec_id is divisible by `every`, among all."""
    rows = of_common_length(usable(vectors))
    return search(rows, rows.where(F.pmod("id", F.lit(every)) == 0), k, narrow=dict(vectors.dtypes)["embedding"] == "array<float>")
