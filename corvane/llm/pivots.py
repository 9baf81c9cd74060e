"""Embedding near-dedup with a pivot-permutation index.

Every vector is described by its nearest reference points (pivots), in order of nearness. The inverted index holds a
list of vectors for every pivot, of those that have it in the first `prefix_of` places of their order; two vectors
meet in a list if their prefixes share its pivot. A pair that meets in several lists is taken in the one whose
number is the least of its common pivots: there the count of common pivots of smaller number is 0. What is retrieved
is verified by cosine in double precision.

The number of pivots grows with the square root of the number of vectors (`pivots_for`), so lists grow like the root
as well, and the prefix with its logarithm. Measured on independent random directions of 64 dimensions, where pivots
help least, two vectors of cosine exactly 0.9 share a pivot with probability 0.995 at 2,048 pivots and prefix 7, and
0.996 at 4,096 and 8; closer ones more surely. There are at most MOST_PIVOTS, a bound on what the tasks are sent;
beyond it lists grow in proportion.

Equal vectors are one node with a weight. A list longer than BLOCK is split into blocks, and its pairs of blocks
are separate tasks' work; tasks return per vector the weight linked and the smallest id of the local component,
never pairs. Pivots are a sample of the vectors, no two closer than PIVOT_COSINE, filled up with random directions;
every vector is indexed.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components
link with nothing; rows of one vec_id are one vector of that name; rows without vec_id get no links and stay; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import connected_components, cut
from corvane.llm.forest import of_common_length, usable

COSINE = 0.9
LEAST_PIVOTS, MOST_PIVOTS, PIVOTS_PER_ROOT, PIVOT_COSINE, SEED = 128, 65_536, 8.0, 0.8, 5
BLOCK, PAIRS = 2048, 200_000


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # first by the greatest component, so squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def pivots_for(n: int) -> int:
    """A power of two near PIVOTS_PER_ROOT times the root of n."""
    return int(min(MOST_PIVOTS, max(LEAST_PIVOTS, 2 ** math.ceil(math.log2(PIVOTS_PER_ROOT * math.sqrt(max(n, 1)))))))


def prefix_of(m: int) -> int:
    """Places of a vector's order of m pivots that are indexed."""
    return max(6, math.ceil(math.log2(m)) - 4)


def choose_pivots(sample: np.ndarray, m: int, dim: int = 0, seed: int = SEED) -> np.ndarray:
    """Up to m sample vectors no two of which are near, in the sample's order, then random directions."""
    chosen = np.zeros((0, sample.shape[1] if len(sample) else dim))
    for a in range(0, len(sample), 512):
        v = unit(sample[a : a + 512])
        if len(chosen):
            v = v[(v @ chosen.T).max(1) <= PIVOT_COSINE]
        near, keep = v @ v.T > PIVOT_COSINE, np.ones(len(v), bool)
        for i in range(len(v)):
            keep[i] = not (near[i, :i] & keep[:i]).any()
        chosen = np.vstack([chosen, v[keep]])[:m]
    more = np.random.default_rng(seed).standard_normal((m - len(chosen), chosen.shape[1]))
    return np.vstack([chosen, unit(more)]) if len(more) else chosen


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, s: int) -> np.ndarray:
    """(rows, s) numbers of the nearest pivots, nearest first."""
    sims = unit(x).astype(np.float32) @ pivots.T.astype(np.float32)
    part = np.argpartition(-sims, s - 1, axis=1)[:, :s]
    order = np.argsort(-np.take_along_axis(sims, part, 1), axis=1, kind="stable")
    return np.take_along_axis(part, order, 1)


def _describe(pivots: np.ndarray, s: int):
    @F.pandas_udf("array<int>")
    def run(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        x = np.stack(v.to_numpy()).astype(np.float64)
        rows = max(1, 4_000_000 // len(pivots))  # similarities held at once
        return pd.Series(list(np.vstack([nearest_pivots(x[a : a + rows], pivots, s) for a in range(0, len(x), rows)]).astype(np.int32)))

    return run


def local_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest row number of each row's component, from links i - j."""
    label = np.arange(n)
    while len(i):
        least = np.minimum(label[i], label[j])
        now = label.copy()
        np.minimum.at(now, i, least)
        np.minimum.at(now, j, least)
        now = now[now]
        if (now == label).all():
            break
        label = now
    return label


def first_common(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """Whether rows of prefixes a and b have no pivot of smaller number than p in common."""
    out = np.empty(len(a), bool)
    for i in range(0, len(a), PAIRS):
        x, y = a[i : i + PAIRS, :, None], b[i : i + PAIRS, None, :]
        out[i : i + PAIRS] = ~((x == y) & (x < p)).any((1, 2))
    return out


def link_cell(ids: np.ndarray, weights: np.ndarray, x: np.ndarray, perms: np.ndarray, side: np.ndarray, p: int, cosine: float = COSINE) -> tuple[np.ndarray, np.ndarray]:
    """Linked weight and local component's smallest id of each row, for the pairs that belong to list p.

    side: block of each row; with two blocks only pairs across them count.
    """
    order = np.argsort(ids, kind="stable")
    ids, weights, x, perms, side = ids[order], weights[order], unit(x[order]), perms[order], side[order]
    a, b = (np.flatnonzero(side == side.min()), np.flatnonzero(side == side.max()))
    i, j = np.nonzero(x[a] @ x[b].T >= cosine)
    i, j = a[i], b[j]
    if side.min() == side.max():
        up = i < j
        i, j = i[up], j[up]
    own = first_common(perms[i], perms[j], p)
    i, j = i[own], j[own]
    linked = np.bincount(i, weights[j], len(ids)) + np.bincount(j, weights[i], len(ids))
    back = np.empty(len(ids), np.int64)
    back[order] = np.arange(len(ids))
    return linked[back].astype(np.int64), ids[local_labels(len(ids), i, j)][back]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _cells(cosine: float):
    """Reads rows sorted by (p, lo, hi), one cell in memory at a time, and links each."""

    def link(keys: np.ndarray, ids: np.ndarray, weights: np.ndarray, x: np.ndarray, near: np.ndarray, own: np.ndarray) -> tuple | None:
        p, lo, hi = keys[0].tolist()
        if len(ids) < 2 or lo != hi and (own == own[0]).all():
            return None
        linked, label = link_cell(ids, weights.astype(np.float64), x.astype(np.float64), near, own, p, cosine)
        keep = linked > 0
        return ids[keep], linked[keep], label[keep]

    def batch(parts: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*parts, strict=True)], ["id", "linked", "label"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for b in batches:
            col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            now = [np.column_stack([col[n].to_numpy() for n in ("p", "lo", "hi")]), col["id"].to_numpy(), col["weight"].to_numpy(), _matrix(col["v"]), _matrix(col["near"]), col["own"].to_numpy()]
            if held is not None:
                now = [np.concatenate(z) for z in zip(held, now, strict=True)]
            edges = np.flatnonzero((now[0][1:] != now[0][:-1]).any(1)) + 1
            begin, parts = 0, []
            for e in edges.tolist():
                if got := link(*(z[begin:e] for z in now)):
                    parts.append(got)
                begin = e
            held = [z[begin:] for z in now]
            if parts:
                yield batch(parts)
        if held is not None and len(held[1]) and (got := link(*held)):
            yield batch([got])

    return run


def links(nodes: DataFrame, pivots: np.ndarray, cosine: float = COSINE, block: int = BLOCK, narrow: bool = False) -> DataFrame:
    """(id, linked, label) parts for nodes (id, v, weight); a node's linked weights sum up over its rows.

    narrow: the vectors were single-precision numbers, and travel as such.
    """
    near = nodes.withColumn("near", _describe(pivots, min(prefix_of(len(pivots)), len(pivots)))("v"))
    near = near.withColumn("v", F.col("v").cast("array<float>")) if narrow else near
    # there are as many lists as pivots, so the long ones, at most MOST_PIVOTS, are few enough to send to every task
    long = near.select(F.explode("near").alias("p")).groupBy("p").count().where(F.col("count") > block)
    long = cut(long.select("p", F.ceil(F.col("count") / block).cast("int").alias("n")))
    posted = near.select("id", "v", "weight", "near", F.explode("near").alias("p"))
    posted = posted.join(F.broadcast(long), "p", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    own = F.pmod(F.xxhash64("id", F.lit(SEED)), F.col("n")).cast("int")
    posted = posted.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    cell = ["p", "lo", "hi"]
    cells = posted.select("p", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "id", "weight", "v", "near", "own")
    return cells.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(_cells(cosine), "id long, linked long, label long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, pivots: int | None = None, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    rows = of_common_length(usable(vectors))
    classes = cut(rows.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("weight")))
    m = pivots or pivots_for(classes.count())
    sample = [r["v"] for r in classes.orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(m).collect()]  # at most MOST_PIVOTS
    narrow = dict(vectors.dtypes)["embedding"] == "array<float>"
    members = rows.join(classes.select("v", F.col("id").alias("first")), "v").select("id", "first")
    if sample:
        found = cut(links(classes, choose_pivots(np.array(sample, float), m), cosine, block, narrow))
        linked = found.groupBy("id").agg(F.sum("linked").alias("linked"))
        # one name in several classes (rows of one vec_id with other vectors) ties them together
        tied = members.where("id <> first").select(F.col("id").alias("u"), F.col("first").alias("v"))
        edges = found.where("label <> id").select(F.col("id").alias("u"), F.col("label").alias("v"))
        roots = connected_components(edges.unionByName(tied))
    else:
        return vectors.select(F.col("vec_id").cast("long"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    n = classes.join(linked, "id", "left").select(F.col("id").alias("first"), (F.col("weight") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    n = n.groupBy("first").agg(F.max("n_links").alias("n_links"))
    per = members.join(n, "first").groupBy("id").agg(F.max("n_links").alias("n_links"))
    per = per.join(roots.select(F.col("node").alias("id"), "root"), "id", "left")
    out = vectors.select(F.col("vec_id").cast("long").alias("id")).join(per, "id", "left")
    root = F.coalesce("root", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), F.coalesce(root == F.col("id"), F.lit(True)).alias("kept"))
