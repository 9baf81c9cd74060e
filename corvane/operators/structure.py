"""Structural comparison of two pages: order-preserving best matching of nodes by role, landmark order, positions.

Matching is a dynamic program over one pair's nodes of one role; it runs over many such groups at a time. Everything
around it is joins and sums. Nodes are rows pair_id, side (a the original, b the clone), role, x, y, w,
h, name, pos; pages are rows pair_id, side, view_w, view_h, page_h.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from corvane.functions.text import round_half_up

# Weights of roles, and the landmarks whose order counts.
WEIGHTS = {
    "header": 3.0, "nav": 3.0, "main": 1.0, "footer": 2.0, "aside": 2.0, "dialog": 2.0, "form": 2.0, "h1": 3.0, "h2": 2.0, "h3": 1.0, "h4": 0.5,
    "button": 2.0, "input": 2.0, "tab": 1.0, "table": 2.0, "list": 1.0, "image": 1.0, "video": 1.5, "canvas": 1.5, "embed": 1.0, "link": 0.5,
}
LANDMARKS = ("header", "nav", "main", "footer", "h1", "h2", "form", "table")
MOST_DX, MOST_DW, MOST_DY, NAME_BONUS = 0.3, 0.4, 0.2, 0.15
DEFAULT_WIDTH, MOST_NODES = 1440, 1500
#: Cells of the matrices that are worked on at once, if more than one group is.
MOST_CELLS = 250_000


def similarities(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
    """Matrix of similarities, -inf where two nodes cannot match."""
    width, ha, hb = (a["view_w"].iloc[0] or DEFAULT_WIDTH), (a["page_h"].iloc[0] or 1), (b["page_h"].iloc[0] or 1)
    gap = lambda u, v: np.abs(u[:, None] - v[None, :])
    col = lambda d, c: d[c].to_numpy(np.float64)
    dx, dw = gap(col(a, "x"), col(b, "x")) / width, gap(col(a, "w"), col(b, "w")) / width
    dy = gap(col(a, "y") / ha, col(b, "y") / hb)
    na, nb = (d["name"].fillna("").str.lower().to_numpy(object) for d in (a, b))
    same = (na[:, None] == nb[None, :]) & (na != "")[:, None]
    s = 1 - (dx + dw + dy) + NAME_BONUS * same
    return np.where((dx > MOST_DX) | (dw > MOST_DW) | (dy > MOST_DY) | (s <= 0), -np.inf, s)


def best_matching(s: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of the non-crossing matching with the greatest sum; a match is preferred, then leaving out a row."""
    n, m = s.shape
    best = np.zeros((n + 1, m + 1))
    for i in range(1, n + 1):
        take = np.maximum(best[i - 1, 1:], best[i - 1, :-1] + s[i - 1])
        best[i, 1:] = np.maximum.accumulate(take)
    out, i, j = [], n, m
    while i and j:
        if np.isfinite(s[i - 1, j - 1]) and abs(best[i, j] - best[i - 1, j - 1] - s[i - 1, j - 1]) < 1e-9:
            out.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif best[i, j] == best[i - 1, j]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _matched(d: pd.DataFrame) -> pd.DataFrame:
    """Matches of whole groups (pair_id, role), which come one after another, in order of side, y, x, pos.

    Groups of like size are laid over each other, so that the dynamic program runs over many of them at once; as in best_matching,
    a match is preferred, then leaving out a row.
    """
    col = lambda c: d[c].to_numpy(np.float64)
    low = d["name"].fillna("").str.lower().to_numpy(object)
    name = np.where(low == "", -1, pd.factorize(low)[0])
    x, y, w, pos, view, height = *map(col, "xyw"), d["pos"].to_numpy(), col("view_w"), col("page_h")
    view, height = np.where(view == 0, DEFAULT_WIDTH, view), np.where(height == 0, 1, height)
    start = _starts(d["pair_id"].to_numpy(object), d["role"].to_numpy(object))
    n = np.add.reduceat((d["side"] == "a").to_numpy(np.int64), start) if len(d) else start
    m = np.diff(np.append(start, len(d))) - n
    both = np.flatnonzero((n > 0) & (m > 0))
    both = both[np.lexsort((m[both], n[both]))]
    out: list[tuple[np.ndarray, np.ndarray]] = []
    while len(both):
        cells = np.maximum.accumulate(n[both]) * np.maximum.accumulate(m[both]) * np.arange(1, len(both) + 1)
        g, both = np.split(both, [max(1, int(np.searchsorted(cells, MOST_CELLS, "right")))])
        out.append(_match_groups(g, start, n, m, x, y, w, name, view, height))
    at = [np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in (0, 1)]
    return pd.DataFrame({"pair_id": d["pair_id"].to_numpy(object)[at[0]], "role": d["role"].to_numpy(object)[at[0]], "a_pos": pos[at[0]], "b_pos": pos[at[1]]})


def _match_groups(g, start, n, m, x, y, w, name, view, height) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of matched nodes of the groups g."""
    n, m, sa = n[g], m[g], start[g]
    sb, all_ = sa + n, np.arange(len(g))
    i, j = np.arange(n.max()), np.arange(m.max())
    a, b = sa[:, None] + np.minimum(i, n[:, None] - 1), sb[:, None] + np.minimum(j, m[:, None] - 1)
    gap = lambda u, v: np.abs(u[:, :, None] - v[:, None, :])
    width, ha, hb = view[sa][:, None, None], height[sa][:, None], height[sb][:, None]
    dx, dw, dy = gap(x[a], x[b]) / width, gap(w[a], w[b]) / width, gap(y[a] / ha, y[b] / hb)
    s = 1 - (dx + dw + dy) + NAME_BONUS * ((name[a][:, :, None] == name[b][:, None, :]) & (name[a] >= 0)[:, :, None])
    outside = (i >= n[:, None])[:, :, None] | (j >= m[:, None])[:, None, :]
    s[outside | (dx > MOST_DX) | (dw > MOST_DW) | (dy > MOST_DY) | (s <= 0)] = -np.inf
    best = np.zeros((len(g), len(i) + 1, len(j) + 1))
    for k in range(1, len(i) + 1):
        np.maximum.accumulate(np.maximum(best[:, k - 1, 1:], best[:, k - 1, :-1] + s[:, k - 1]), axis=1, out=best[:, k, 1:])
    p, q, found = n.copy(), m.copy(), []
    while len(all_):
        here, was = best[all_, p, q], s[all_, p - 1, q - 1]
        hit = np.isfinite(was) & (np.abs(here - best[all_, p - 1, q - 1] - np.where(np.isfinite(was), was, 0)) < 1e-9)
        up = ~hit & (here == best[all_, p - 1, q])
        found.append((sa[all_[hit]] + p[hit] - 1, sb[all_[hit]] + q[hit] - 1))
        p, q = p - (hit | up), q - ~up
        on = (p > 0) & (q > 0)
        all_, p, q = all_[on], p[on], q[on]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def match_nodes(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """pair_id, role, a_pos, b_pos of matched nodes.

    A page's nodes are the MOST_NODES of most weight, as its measurement keeps them, so a group's matrix is bounded. Groups come to
    Python sorted, many in a batch; a batch's last group waits for the rest of it.
    """
    # one row of pages for a pair, so that nodes which lie by pair already are not dealt out again for the join
    of = lambda s, c: F.first(F.when(F.col("side") == s, F.col(c)), ignorenulls=True)
    page = pages.groupBy("pair_id").agg(F.collect_set("side").alias("_sides"), *[of(s, c).alias(f"_{s}_{c}") for s in "ab" for c in ("view_w", "page_h")])
    full = keep_nodes(nodes.where(F.col("role").isin(*WEIGHTS)), ["pair_id", "side"]).join(page, "pair_id").where(F.array_contains("_sides", F.col("side")))
    full = full.withColumns({c: F.when(F.col("side") == "a", F.col(f"_a_{c}")).otherwise(F.col(f"_b_{c}")) for c in ("view_w", "page_h")})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for d in batches:
            d = d if rest is None or not len(rest) else pd.concat([rest, d], ignore_index=True)
            if len(d):
                last = _starts(d["pair_id"].to_numpy(object), d["role"].to_numpy(object))[-1]
                yield _matched(d.iloc[:last].reset_index(drop=True))
                rest = d.iloc[last:]
        if rest is not None and len(rest):
            yield _matched(rest.reset_index(drop=True))

    order = [F.asc_nulls_last(c) for c in ("pair_id", "role", "side", "y", "x", "pos")]
    rows = full.select(F.col("pair_id").cast("string").alias("pair_id"), "role", "side", "pos", "x", "y", "w", "name", "view_w", "page_h")
    return rows.where("side in ('a', 'b')").repartition("pair_id").sortWithinPartitions(*order).mapInPandas(run, "pair_id string, role string, a_pos long, b_pos long")


def position_label(x: Column, y: Column, w: Column, view_w: Column, view_h: Column, page_h: Column) -> Column:
    """Where a node is: top bar, first screen or how far down; full width, left, right or center."""
    width = F.when(view_w > 0, view_w).otherwise(F.lit(DEFAULT_WIDTH))
    middle = (x + w / 2) / width
    side = F.when(w > width * 0.6, "full width").when(middle < 0.36, "left").when(middle > 0.64, "right").otherwise("center")
    down = F.concat(round_half_up(y / page_h * 100).cast("long").cast("string"), F.lit("% down the page"))
    return F.concat_ws(", ", F.when(y < 120, "top bar").when(y < view_h, "first screen").otherwise(down), side)


def weight(role: Column, weights: dict[str, float] = WEIGHTS) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in weights.items() for v in kv]), role), F.lit(0.0))


def by_role(nodes: DataFrame, matched: DataFrame) -> DataFrame:
    """pair_id, role, original, clone, matched."""
    n = nodes.where(F.col("role").isin(*WEIGHTS)).groupBy("pair_id", "role").agg(F.count_if(F.col("side") == "a").alias("original"), F.count_if(F.col("side") == "b").alias("clone"))
    m = matched.groupBy("pair_id", "role").agg(F.count("*").alias("matched"))
    return n.join(m, ["pair_id", "role"], "left").na.fill({"matched": 0})


def structure_score(roles: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Weighted share of the original's nodes that the clone has, in percent; a caller may bring its own weights."""
    w = weight(F.col("role"), weights)
    total = F.sum(w * F.col("original"))
    return roles.groupBy("pair_id").agg(F.when(total > 0, round_half_up(F.sum(w * F.col("matched")) / total * 100)).otherwise(F.lit(100.0)).cast("long").alias("score"))


@F.pandas_udf(IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two arrays, of many rows at a time."""
    n, m = a.map(len).to_numpy(), b.map(len).to_numpy()
    codes = pd.factorize(np.concatenate([*a, *b]), use_na_sentinel=False)[0] if n.sum() + m.sum() else np.zeros(1, np.int64)
    x0, y0 = np.cumsum(n) - n, n.sum() + np.cumsum(m) - m
    out, both = np.zeros(len(a), np.int32), np.flatnonzero((n > 0) & (m > 0))
    both = both[np.lexsort((m[both], n[both]))]
    while len(both):
        cells = np.maximum.accumulate(m[both]) * np.arange(1, len(both) + 1)
        g, both = np.split(both, [max(1, int(np.searchsorted(cells, MOST_CELLS // 16, "right")))])
        j, row = np.arange(m[g].max()), np.zeros((len(g), m[g].max() + 1), np.int32)
        ys = np.where(j < m[g][:, None], codes[y0[g][:, None] + np.minimum(j, m[g][:, None] - 1)], -1)
        for k in range(n[g].max()):
            v = np.where(k < n[g], codes[x0[g] + np.minimum(k, n[g] - 1)], -2)
            row[:, 1:] = np.maximum.accumulate(np.maximum(row[:, 1:], row[:, :-1] + (ys == v[:, None])), axis=1)
        out[g] = row[:, -1]
    return pd.Series(out)


def order_score(nodes: DataFrame) -> DataFrame:
    """How much of the original's landmark order the clone keeps, in percent; of the nodes that match_nodes takes."""
    nodes = keep_nodes(nodes, ["pair_id", "side"])
    seq = lambda s: F.transform(F.array_sort(F.collect_list(F.when((F.col("side") == s) & F.col("role").isin(*LANDMARKS), F.struct("y", "pos", "role")))), lambda x: F.array_position(F.array(*[F.lit(r) for r in LANDMARKS]), x["role"]))
    g = nodes.groupBy("pair_id").agg(seq("a").alias("a"), seq("b").alias("b"))
    share = round_half_up(lcs_length("a", "b") / F.size("a") * 100)
    return g.select("pair_id", F.when(F.size("a") > 0, share).otherwise(F.lit(100.0)).cast("long").alias("order_score"))


def unmatched(nodes: DataFrame, matched: DataFrame, pages: DataFrame, side: str) -> DataFrame:
    """missing (side a) or added (side b) nodes with their place, heaviest roles first."""
    key = matched.select("pair_id", F.col(f"{side}_pos").alias("pos"))
    rest = nodes.where((F.col("side") == side) & F.col("role").isin(*WEIGHTS)).join(key, ["pair_id", "pos"], "left_anti")
    rest = rest.join(pages.where(F.col("side") == side).drop("side"), "pair_id")
    place = position_label(*[F.col(c) for c in ("x", "y", "w", "view_w", "view_h", "page_h")])
    return rest.select("pair_id", "role", "pos", place.alias("where"), F.coalesce("name", F.lit("")).alias("name"), F.concat_ws("x", "w", "h").alias("size")).orderBy("pair_id", F.desc(weight(F.col("role"))), "pos")


def moved_across_fold(nodes: DataFrame, matched: DataFrame, pages: DataFrame) -> DataFrame:
    """Matched nodes of which one is on the first screen and the other is not."""
    full = nodes.join(pages, ["pair_id", "side"])
    side = lambda s: full.where(F.col("side") == s).select("pair_id", F.col("pos").alias(f"{s}_pos"), F.col("name").alias(f"{s}_name"), (F.col("y") < F.col("view_h")).alias(f"{s}_up"), position_label(*[F.col(c) for c in ("x", "y", "w", "view_w", "view_h", "page_h")]).alias(f"{s}_where"))
    j = matched.join(side("a"), ["pair_id", "a_pos"]).join(side("b"), ["pair_id", "b_pos"])
    return j.where("a_up <> b_up").select("pair_id", "role", F.coalesce("a_name", F.lit("")).alias("name"), F.col("a_where").alias("from"), F.col("b_where").alias("to"))


def keep_nodes(nodes: DataFrame, key: list[str], most: int = MOST_NODES) -> DataFrame:
    """The nodes of most weight, in document order."""
    w = Window.partitionBy(*key).orderBy(F.desc(weight(F.col("role"))), "pos")
    return nodes.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")
