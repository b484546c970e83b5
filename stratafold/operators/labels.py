"""Nearest place of another label, for many labellings of the same places.

Places go to every task once, ordered as a tree of boxes that halves them; a labelling is a task. A node knows its box and its least and largest label. Nodes of queries walk down the
tree beside the nodes that can hold an answer of theirs, all of a level at once, so the work of a labelling follows the places and their logarithm and no row is made for a
place and a labelling. ``MAX_PLACES`` at most (about 60 bytes each in a task); beyond, ``nn.nearest`` takes over.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.functions.geometry import EARTH_RADIUS
from stratafold.operators.nn import _unit_np

MAX_PLACES = 10_000_000
LEAF = 8
CHUNK_LEVELS = 11
BLOCK = 1 << 17


@dataclass
class Tree:
    """Places in the order of a tree whose leaves hold ``leaf`` each; ``row`` is a place's row in the input, -1 for those that only fill up the last ones."""

    row: np.ndarray
    x: np.ndarray
    y: np.ndarray
    low: list[np.ndarray]
    high: list[np.ndarray]
    leaf: int
    longlat: bool


def tree(x: np.ndarray, y: np.ndarray, longlat: bool) -> Tree:
    n = len(x)
    levels = max(0, int(np.log2(n / LEAF))) if n > LEAF else 0
    leaf = -(-n >> levels)
    total = leaf << levels
    fill = np.minimum(np.arange(total), n - 1)
    place = (_unit_np(x, y) if longlat else np.stack([x, y], 1))[fill]
    order = np.arange(total)
    for level in range(levels):
        nodes, size = 1 << level, total >> level
        p = place[order].reshape(nodes, size, -1)
        axis = np.argmax(p.max(1) - p.min(1), 1)
        part = np.argpartition(np.take_along_axis(p, axis[:, None, None], 2)[:, :, 0], size // 2, axis=1)
        order = np.take_along_axis(order.reshape(nodes, size), part, 1).ravel()
    place = place[order].reshape(1 << levels, leaf, -1)
    low, high = [place.min(1)], [place.max(1)]
    for _ in range(levels):
        low.append(np.minimum(low[-1][::2], low[-1][1::2]))
        high.append(np.maximum(high[-1][::2], high[-1][1::2]))
    return Tree(np.where(order < n, order, -1), x[fill][order], y[fill][order], low[::-1], high[::-1], leaf, longlat)


def _begins(a: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)


def _prune(t: Tree, level: int, a: np.ndarray, b: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs of nodes (rising in ``a``) those that can hold the nearest of another label, with squares of their least and largest distances."""
    near = far = 0.0
    for k in range(t.low[level].shape[1]):
        la, ha, lb, hb = t.low[level][a, k], t.high[level][a, k], t.low[level][b, k], t.high[level][b, k]
        near = near + np.maximum(np.maximum(lb - ha, la - hb), 0) ** 2
        far = far + np.maximum(hb - la, ha - lb) ** 2
    la, ha, lb, hb = least[a], most[a], least[b], most[b]
    some, one = (ha >= 0) & (hb >= 0), lb == hb
    may = some & ~(one & (la == ha) & (la == lb))
    sure = some & (~one | (lb < la) | (lb > ha))
    begins = _begins(a)
    bound = np.minimum.reduceat(np.where(sure, far, np.inf), begins) if len(a) else far
    keep = may & (near <= np.repeat(bound, np.diff(np.r_[begins, len(a)])) * (1 + 1e-9) + 1e-15)
    return a[keep], b[keep], near[keep], far[keep]


def _gaps(t: Tree, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Least squared distance (on degrees, half its chord's square) of each place in the leaf ``a`` to those of another label in the leaf ``b``."""
    m = t.leaf
    x, y, label = t.x.reshape(-1, m), t.y.reshape(-1, m), label.reshape(-1, m)
    out = np.empty((len(a), m))
    for at in range(0, len(a), max(1, BLOCK // (m * m))):
        s = slice(at, at + max(1, BLOCK // (m * m)))
        qx, qy, rx, ry = x[a[s]][:, :, None], y[a[s]][:, :, None], x[b[s]][:, None], y[b[s]][:, None]
        if t.longlat:
            la, lb = np.radians(qy), np.radians(ry)
            d = np.sin((lb - la) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin((np.radians(rx) - np.radians(qx)) / 2) ** 2
        else:
            d = (qx - rx) ** 2 + (qy - ry) ** 2
        theirs = label[b[s]][:, None]
        d[(label[a[s]][:, :, None] == theirs) | (theirs < 0)] = np.inf
        out[s] = d.min(2)
    return out


def apart(t: Tree, label: np.ndarray) -> np.ndarray:
    """Distance of each place (in the tree's order) to the nearest one of another ``label``, infinite where there is none; labels below 0 are in nobody's way."""
    levels, m = len(t.low) - 1, t.leaf
    label = np.where(t.row >= 0, label, -1)
    big = np.iinfo(np.int64).max
    least, most = [np.where(label < 0, big, label).reshape(-1, m).min(1)], [label.reshape(-1, m).max(1)]
    for _ in range(levels):
        least.append(np.minimum(least[-1][::2], least[-1][1::2]))
        most.append(np.maximum(most[-1][::2], most[-1][1::2]))
    least, most = least[::-1], most[::-1]
    best = np.full((1 << levels, m), np.inf)
    top = max(0, levels - CHUNK_LEVELS)
    for node in range(1 << top):
        b = np.arange(1 << top)
        a = np.full(len(b), node)
        a, b, near, far = _prune(t, top, a, b, least[top], most[top])
        for level in range(top + 1, levels + 1):
            begins = _begins(a)
            count = np.repeat(np.diff(np.r_[begins, len(a)]), 2)  # each parent's list serves both its children
            rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - np.repeat(begins, 2), count)
            child = np.repeat(np.stack([2 * a[begins], 2 * a[begins] + 1], 1).ravel(), count)
            a, b = np.repeat(child, 2), np.stack([2 * b[rows], 2 * b[rows] + 1], 1).ravel()
            a, b, near, far = _prune(t, level, a, b, least[level], most[level])
        if not len(a):
            continue
        begins = _begins(a)
        length = np.diff(np.r_[begins, len(a)])
        hit = np.flatnonzero(far == np.repeat(np.minimum.reduceat(far, begins), length))
        first = hit[_begins(a[hit])]
        leaves = a[begins]
        best[leaves] = _gaps(t, a[first], b[first], label)
        reach = np.where(label.reshape(-1, m)[leaves] >= 0, best[leaves], 0).max(1) * (4 if t.longlat else 1)
        rest = near <= np.repeat(reach, length) * (1 + 1e-9) + 1e-15
        rest[first] = False
        a, b = a[rest], b[rest]
        if len(a):
            begins = _begins(a)
            best[a[begins]] = np.minimum(best[a[begins]], np.minimum.reduceat(_gaps(t, a, b, label), begins, axis=0))
    best = np.where(label >= 0, best.ravel(), np.inf)
    if not t.longlat:
        return np.sqrt(best)
    return np.where(np.isfinite(best), 2 * EARTH_RADIUS * np.arcsin(np.sqrt(np.minimum(best, 1))), np.inf)


def area_between(d: np.ndarray, values: np.ndarray, counts: np.ndarray) -> float:
    """The Wasserstein distance of ``d`` from the rising ``values`` with their ``counts``."""
    mine, n = np.unique(d, return_counts=True)
    v = np.union1d(mine, values)
    share = lambda of, n: np.r_[0, np.cumsum(n)][np.searchsorted(of, v, side="right")] / n.sum()
    return float(np.sum(np.abs(share(mine, n) - share(values, counts))[:-1] * np.diff(v)))


def gather(points: DataFrame, longlat: bool, *more: str) -> tuple[Tree, pd.DataFrame] | None:
    """The tree of ``points`` (id, x, y) and its rows with the columns ``more``; nothing where they are too many or a place is missing."""
    held = points.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), *more)
    if not 0 < held.count() <= MAX_PLACES:
        return None
    rows = held.toPandas()
    x, y = rows["x"].to_numpy(float), rows["y"].to_numpy(float)
    return (tree(x, y, longlat), rows) if np.isfinite(x).all() and np.isfinite(y).all() else None


def apart_by_candidate(folded: DataFrame, points: DataFrame, longlat: bool) -> DataFrame | None:
    """(candidate, id, d) of ``folded`` (candidate, id, fold): each of its ``points``' nearest point of another fold; nothing where ``gather`` has nothing."""
    got = gather(points, longlat)
    if got is None:
        return None
    t, ids = got[0], got[1]["id"].to_numpy(np.int64)
    sort = np.argsort(ids, kind="stable")
    at = np.empty(len(ids), np.int64)  # a row's place in the tree
    at[t.row[t.row >= 0]] = np.flatnonzero(t.row >= 0)
    held = folded.sparkSession.sparkContext.broadcast((t, ids[sort], at[sort]))

    def measure(g: pd.DataFrame) -> pd.DataFrame:
        t, ids, at = held.value
        g = g[g["fold"].notna()]
        where = at[np.searchsorted(ids, g["id"].to_numpy(np.int64))]
        label = np.full(len(t.row), -1, np.int64)
        label[where] = np.unique(g["fold"].to_numpy(), return_inverse=True)[1]
        d = apart(t, label)[where]
        return pd.DataFrame({"candidate": g["candidate"], "id": g["id"], "d": d})[np.isfinite(d)]

    kind = dict(folded.dtypes)
    return folded.select("candidate", "id", "fold").groupBy("candidate").applyInPandas(measure, f"candidate {kind['candidate']}, id {kind['id']}, d double")
