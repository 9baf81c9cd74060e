"""Visual comparison of two screenshots: rows aligned by banded time warping, then cells compared.

One call handles one pair; pairs run in parallel. Everything is bounded by the image size after resizing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import png

WIDTH, CELL, ROW, EDGE = 720, 16, 4, 60
SHIFT_COST, PIXEL_GAP, PIXEL_SHARE = 0.08, 24, 0.02
FAINT, ABSOLUTE, RELATIVE = 0.01, 0.03, 0.6
MOST_REGIONS, MOST_DRIFT = 10, 20
NEIGHBOURS = ((1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (-1, -1))
SCHEMA = "pair_id string, mode string, score double, height_ratio double, regions array<struct<x:int,y:int,w:int,h:int,cells:int>>, drift array<struct<from_y:int,shift:int>>, heatmap binary"


def density(edges: np.ndarray) -> np.ndarray:
    """(columns, height + 1) running number of edge pixels in each 16-px column."""
    h, w = edges.shape
    cols = -(-w // CELL)
    on = np.zeros((h, cols * CELL), np.int64)
    on[:, :w] = edges > EDGE
    out = np.zeros((cols, h + 1))
    out[:, 1:] = on.reshape(h, cols, CELL).sum(2).cumsum(0).T
    return out


def share_of(run: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> np.ndarray:
    """Edge share of each column between rows y0 and y1, clipped to the image."""
    h = run.shape[1] - 1
    lo, hi = np.clip(y0, 0, h), np.clip(y1, 0, h)
    return np.where(hi > lo, (run[:, hi] - run[:, lo]) / (CELL * np.maximum(1, hi - lo)), 0.0)


def align(fa: np.ndarray, fb: np.ndarray) -> np.ndarray:
    """For each row of a its row in b: least summed difference plus a cost for every shift, within a band."""
    na, nb = len(fa), len(fb)
    band = min(400, max(100, abs(na - nb) + 25))
    span = 2 * band + 1
    total, move = np.full((na, span), np.inf), np.zeros((na, span), np.int8)
    for i in range(na):
        j = i - band + np.arange(span)
        ok = (j >= 0) & (j < nb)
        here = np.full(span, np.inf)
        here[ok] = np.abs(fb[j[ok]] - fa[i]).sum(1)
        best, way = np.full(span, np.inf), np.zeros(span, np.int8)
        if i:
            best, way = total[i - 1].copy(), np.where(np.isfinite(total[i - 1]) & (j > 0), 1, 0).astype(np.int8)
            best[way == 0] = np.inf
            down = np.append(total[i - 1, 1:], np.inf) + SHIFT_COST
            less = down < best
            best[less], way[less] = down[less], 2
        # steps along b: row[k] = here[k] + min(best[k], row[k - 1] + SHIFT_COST) is a running minimum once the sums
        # of here and of the steps are taken off
        run = np.flatnonzero(ok)
        at, cost = best[run], here[run]
        if i == 0 and j[run[0]] == 0:
            at[0] = 0.0
        paid = np.cumsum(cost) - cost + SHIFT_COST * np.arange(len(run))
        least = np.minimum.accumulate(at - paid)
        total[i, run] = least + paid + cost
        along = np.append(np.inf, total[i, run[:-1]]) + SHIFT_COST
        way[run[along < at - 1e-12]] = 3
        move[i] = way
    end = nb - 1 - (na - 1 - band)
    if not 0 <= end < span or not np.isfinite(total[-1, end]):
        end = int(np.argmin(total[-1]))
    match, i, k = np.full(na, -1), na - 1, end
    while i >= 0 and 0 <= k < span:
        j = i - band + k
        match[i] = j if match[i] < 0 else min(match[i], j)
        way = move[i, k]
        if way == 1:
            i -= 1
        elif way == 2:
            i, k = i - 1, k + 1
        elif way == 3:
            k -= 1
        else:
            break
    match[0] = max(match[0], 0)
    for i in range(1, na):
        if match[i] < 0:
            match[i] = match[i - 1] + 1
    return match


def regions(diff: np.ndarray, scale: float) -> list[dict]:
    """Bounding boxes of connected differing cells, largest first."""
    todo, out = set(map(tuple, np.argwhere(diff).tolist())), []
    for seed in sorted(todo):
        if seed not in todo:
            continue
        todo.discard(seed)
        stack, cells = [seed], []
        while stack:
            y, x = stack.pop()
            cells.append((y, x))
            for dx, dy in NEIGHBOURS:
                if (n := (y + dy, x + dx)) in todo:
                    todo.discard(n)
                    stack.append(n)
        ys, xs = [c[0] for c in cells], [c[1] for c in cells]
        size = lambda v: int(np.floor(v * CELL * scale + 0.5))
        out.append({"x": size(min(xs)), "y": size(min(ys)), "w": size(max(xs) - min(xs) + 1), "h": size(max(ys) - min(ys) + 1), "cells": len(cells)})
    return sorted(out, key=lambda r: -r["cells"])[:MOST_REGIONS]


def compare(a: np.ndarray, b: np.ndarray, pixel: bool = False, masks: list[tuple] = (), width: int = WIDTH) -> dict:
    """mode, score, height_ratio, regions, drift, heatmap for two images."""
    scale = a.shape[1] / width
    A, B = png.resize(a, width), png.resize(b, width)
    run_a, run_b = density(png.sobel(png.luma(A))), density(png.sobel(png.luma(B)))
    cols, rows = run_a.shape[0], -(-A.shape[0] // CELL)
    feature = lambda run, h: share_of(run, y := np.arange(-(-h // ROW)) * ROW, y + ROW).T
    match = align(feature(run_a, A.shape[0]), feature(run_b, B.shape[0]))
    at = np.minimum(len(match) - 1, (np.arange(rows) * CELL + CELL // 2) // ROW)
    offsets = match[at] * ROW - at * ROW
    diff, compared = np.zeros((rows, cols), bool), 0
    for cy in range(rows):
        y0, o = cy * CELL, int(offsets[cy])
        if y0 + o >= B.shape[0]:
            break
        da, db = (share_of(r, np.array([y]), np.array([y + CELL]))[:, 0] for r, y in ((run_a, y0), (run_b, y0 + o)))
        for cx in range(cols):
            left, top, size = cx * CELL * scale, y0 * scale, CELL * scale
            if any(left + size > x and left < x + w and top + size > y and top < y + h for x, y, w, h in masks):
                continue
            if pixel:
                y1 = min(A.shape[0], y0 + CELL, B.shape[0] - o)
                xs = slice(cx * CELL, min(width, (cx + 1) * CELL))
                if y1 <= max(y0, -o):
                    continue
                p, q = A[max(y0, -o) : y1, xs, :3].astype(int), B[max(y0, -o) + o : y1 + o, xs, :3].astype(int)
                differs = (np.abs(p - q).max(2) > PIXEL_GAP).mean() > PIXEL_SHARE
            else:
                if da[cx] < FAINT and db[cx] < FAINT:
                    continue
                gap = abs(da[cx] - db[cx])
                differs = gap > ABSOLUTE and gap / max(da[cx], db[cx]) > RELATIVE
            compared += 1
            diff[cy, cx] = differs
    share = 1 - diff.sum() / compared if compared else 1.0
    half_up = lambda v, k=1: float(np.floor(v * k + 0.5) / k)
    before = np.concatenate([[0], offsets[:-1]])
    drift = [{"from_y": int(half_up(i * CELL * scale)), "shift": int(half_up(offsets[i] * scale))} for i in np.flatnonzero(offsets != before)]
    gray = png.luma(A)
    hot = np.kron(diff, np.ones((CELL, CELL), bool))[: A.shape[0], :width]
    heat = np.full((*gray.shape, 4), 255, np.uint8)
    heat[..., 0] = np.where(hot, 220, gray * 0.55 + 100)
    heat[..., 1] = heat[..., 2] = np.where(hot, 40 + gray * 0.2, gray * 0.55 + 100)
    return {"mode": "pixel" if pixel else "layout", "score": half_up(share * 100, 10), "height_ratio": half_up(b.shape[0] / a.shape[0], 100), "regions": regions(diff, scale), "drift": drift[:MOST_DRIFT], "heatmap": png.encode(heat)}


def parse_masks(text: str | None) -> list[tuple]:
    """x,y,w,h;... as tuples, others left out."""
    out = []
    for part in (text or "").split(";"):
        try:
            v = tuple(float(x) for x in part.split(","))
        except ValueError:
            continue
        if len(v) == 4:
            out.append(v)
    return out


def compare_pairs(pairs: DataFrame, pixel: bool = False) -> DataFrame:
    """pairs (pair_id, a, b: PNG bytes, masks text) to SCHEMA; unreadable images give a null score."""

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                try:
                    got = compare(png.decode(r.a), png.decode(r.b), pixel, parse_masks(r.masks))
                except (ValueError, TypeError):
                    got = {"mode": "pixel" if pixel else "layout", "score": None, "height_ratio": None, "regions": [], "drift": [], "heatmap": None}
                out.append({"pair_id": r.pair_id} | got)
            yield pd.DataFrame(out, columns=["pair_id", "mode", "score", "height_ratio", "regions", "drift", "heatmap"])

    return pairs.select(F.col("pair_id").cast("string").alias("pair_id"), "a", "b", "masks").mapInPandas(run, SCHEMA)


def calibrated_bar(pairs: DataFrame, most: float = 95.0, slack: float = 2.0):
    """pairs (pair_id, self_score): the bar that a page's own variance sets."""
    return pairs.withColumn("bar", F.least(F.lit(most), F.col("self_score") - slack))
