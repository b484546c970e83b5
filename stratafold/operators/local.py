"""Kernels for what is sequential by nature. Their inputs have stated limits; everything around them is distributed."""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd

from stratafold.functions.geometry import EARTH_RADIUS
from stratafold.operators import nn

MAX_LOCAL = 100_000
MAX_TARGETS = 1_000_000
WARD_MATRIX = 5000
RANGES = 400


def sorted_distances(xy: np.ndarray, longlat: bool = False) -> np.ndarray:
    """Each point's distances to all others in rising order, (n, n - 1): 8 bytes a pair."""
    n = len(xy)
    out = np.empty((n, max(n - 1, 0)))
    for k in range(n):
        if longlat:
            lon, lat = np.radians(xy).T
            h = np.sin((lat - lat[k]) / 2) ** 2 + np.cos(lat[k]) * np.cos(lat) * np.sin((lon - lon[k]) / 2) ** 2
            d = 2 * EARTH_RADIUS * np.arcsin(np.sqrt(np.minimum(h, 1)))
        else:
            d = np.sqrt((xy[:, 0] - xy[k, 0]) ** 2 + (xy[:, 1] - xy[k, 1]) ** 2)
        out[k] = np.sort(np.delete(d, k))
    return out


class Near:
    """``sorted_distances`` as far as they are asked for: [i, k] is the k-th distance of point i. A point's first ones come from the runs of points around it."""

    def __init__(self, xy: np.ndarray, longlat: bool = False):
        self.xy, self.longlat, self.shape = xy, longlat, (len(xy), max(len(xy) - 1, 0))
        ids = np.arange(len(xy))
        self.leaves = nn._leaves([xy[:, 0], xy[:, 1], ids, ids, ids], False, longlat, nn.LOCAL_TILE) if len(xy) else None
        self.rows: dict[int, np.ndarray] = {}

    def __getitem__(self, at: tuple[int, int]) -> float:
        i, k = at
        row = self.rows.get(i)
        if row is None or len(row) <= k:
            row = self.rows[i] = self._row(i, max(4, 2 * (k + 1)))
        return float(row[k])

    def _row(self, i: int, least: int) -> np.ndarray:
        r, tiles = self.leaves.r, self.leaves.tiles
        x, y = self.xy[i]
        p = tiles.place(np.array([x]), np.array([y]))
        near = np.sqrt(nn._bounds(p[0], p[0], tiles, slice(None))[0])
        take = 9
        while True:
            whole = take >= len(near)
            some = np.arange(len(near)) if whole else np.argpartition(near, take)[: take + 1]
            edge = np.inf if whole else near[some[take]]  # nothing outside lies nearer
            size = self.leaves.size[some[:take] if not whole else some]
            start = self.leaves.start[some[:take] if not whole else some]
            rows = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
            rows = rows[r[3][rows] != i]
            d = np.sort(nn._apart(x, y, r[0][rows], r[1][rows], self.longlat))
            d = d if whole else d[tiles.reach(d) * (1 + 1e-9) <= edge]
            if whole or len(d) >= least:
                return d[:least].copy()
            take *= 2


def match_distances(near: np.ndarray | Near, gij: np.ndarray, weights: np.ndarray, phi: float, min_train: float) -> np.ndarray:
    """Nearest-neighbour distance matching (Mila et al. 2022): each point's exclusion distance.

    ``near``: a row for each point, its distances to all others in rising order. ``gij``: the distinct distances from prediction places in rising order, with their
    ``weights``. The point with the smallest current distance gives up that neighbour as long as the share of points at or below the
    distance, less itself, is not under the share of ``gij`` there, and more than ``min_train`` of its others stay. Ties go to the first point.
    """
    n = near.shape[0]
    at = [0] * n
    current = np.array([near[i, 0] for i in range(n)]) if near.shape[1] else np.full(n, np.inf)
    ordered, total = sorted(current.tolist()), np.concatenate([[0], np.cumsum(weights)])
    queue = list(zip(current.tolist(), range(n), strict=True))
    heapq.heapify(queue)
    floor = -1.0
    while queue:
        r, i = heapq.heappop(queue)
        if r > phi:
            break
        if current[i] != r or r <= floor:
            continue
        share = total[np.searchsorted(gij, r, side="right")] / total[-1] if total[-1] else 0.0
        below = (bisect.bisect_right(ordered, r) - 1) / n
        left = (n - 1 - at[i]) / n  # a point is a column of its own row, never counted
        if below >= share and left > min_train and at[i] < near.shape[1]:
            ordered.pop(bisect.bisect_left(ordered, r))
            at[i] += 1
            current[i] = near[i, at[i]] if at[i] < near.shape[1] else np.inf
            bisect.insort(ordered, float(current[i]))
            heapq.heappush(queue, (float(current[i]), i))
        else:
            floor = r  # all points at this distance would fail alike; the next larger distance is next
    return current


class Unheld:
    """Points of leave-one-out folds by their different combinations of values, which are few where values come from a raster; for ``similarity_loo``.

    A fold's held points are counted by combination: lumps of points whose box lies within the fold's exclusion as a whole, and the points of lumps on its edge.
    """

    NEXT = 64

    def __init__(self, x: np.ndarray, y: np.ndarray, values: np.ndarray, longlat: bool):
        self.values, code = np.unique(values + 0.0, axis=0, return_inverse=True, equal_nan=True)  # no negative zeros
        code = code.reshape(len(x))
        order, start = nn._parts(x, y, code, 64)
        self.x, self.y, self.code, self.start, self.longlat = x[order], y[order], code[order], start, longlat
        self.length = np.diff(np.r_[start, len(x)])
        place = nn._unit_np(self.x, self.y) if longlat else np.stack([self.x, self.y], 1)
        none = np.zeros(len(start), np.int64)
        self.tiles = nn.Tiles(none, none, np.minimum.reduceat(place, start), np.maximum.reduceat(place, start), none, none > 0, longlat)
        self.first = np.flatnonzero(np.r_[True, np.diff(self.code[start]) != 0])  # of each combination, its first lump
        self.n = np.bincount(code, minlength=len(self.values))
        self.place_of = {v.tobytes(): k for k, v in enumerate(self.values)}

    def _parts(self, b: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
        """Some folds, the number of their points' combination, and their training counts by combination."""
        step, many = max(1, (1 << 20) // len(self.start)), len(self.values)
        for at in range(0, len(b), step):
            q = b.iloc[at : at + step]
            x, y, beyond = (q[c].to_numpy(float) for c in ("x", "y", "beyond"))
            p, reach = self.tiles.place(x, y)[:, None], self.tiles.reach(beyond)[:, None]
            near, far = nn._bounds(p, p, self.tiles, slice(None))
            inside = far <= (reach * (1 - 1e-9)) ** 2 - 1e-12
            held = np.add.reduceat(inside * self.length, self.first, axis=1)
            i, j = np.nonzero(~inside & (near <= (reach * (1 + 1e-9)) ** 2 + 1e-12))
            for k in range(0, len(i), 1 << 14):
                who, lump = i[k : k + (1 << 14)], j[k : k + (1 << 14)]
                n = self.length[lump]
                rows = np.repeat(self.start[lump] - np.cumsum(n) + n, n) + np.arange(n.sum())
                who = np.repeat(who, n)
                hit = nn._apart(x[who], y[who], self.x[rows], self.y[rows], self.longlat) <= beyond[who]
                held += np.bincount(who[hit] * many + self.code[rows[hit]], minlength=len(q) * many).reshape(len(q), many)
            own = np.array([np.asarray(f, float) for f in q["features"]]).reshape(len(q), -1) + 0.0
            yield q, own, self.n - held

    def mess(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """(id, fold, b, mess): each target's similarity to its training in each band that it has a value of."""
        sorts = []
        for k in range(self.values.shape[1]):
            v = self.values[:, k]
            order = np.argsort(v, kind="stable")
            order = order[~np.isnan(v[order])]
            sorts.append((order, v[order]))
        for b in batches:
            for q, own, train in self._parts(b):
                for k, (order, v) in enumerate(sorts):
                    mine, some = own[:, k], train[:, order]
                    total = some.sum(1)
                    ok = ~np.isnan(mine) & (total > 0)
                    if not ok.any():
                        continue
                    mine, some, total = mine[ok], some[ok], total[ok]
                    below = np.concatenate([np.zeros((len(mine), 1)), np.cumsum(some, 1)], 1)[np.arange(len(mine)), np.searchsorted(v, mine, side="right")]
                    lo, hi = v[(some > 0).argmax(1)], v[len(v) - 1 - (some[:, ::-1] > 0).argmax(1)]
                    f = below * 100 / total
                    wide = np.where(hi > lo, hi - lo, np.nan)
                    out = np.where(f == 0, (mine - lo) * 100 / wide, np.where(f == 100, (hi - mine) * 100 / wide, np.where(f <= 50, 2 * f, 200 - 2 * f) + 0 * wide))
                    ids = q["id"].to_numpy()[ok]
                    yield pd.DataFrame({"id": ids, "fold": ids, "b": np.full(len(ids), k, np.int32), "mess": out})

    def sample(self, grid: np.ndarray, kind: str) -> None:
        """The baseline's places: for each different one how often it is, and its ``NEXT`` nearest combinations."""
        self.kind = kind
        self.grid, self.weight = np.unique(grid, axis=0, return_counts=True)
        keep = min(self.NEXT, len(self.values))
        self.order, self.gap = np.empty((len(self.grid), keep), np.int64), np.empty((len(self.grid), keep))
        step = max(1, (1 << 21) // len(self.values))
        for at in range(0, len(self.grid), step):
            d = self._gaps(self.grid[at : at + step])
            order = np.argpartition(d, keep - 1, axis=1)[:, :keep]
            order = np.take_along_axis(order, np.argsort(np.take_along_axis(d, order, 1), axis=1), 1)
            self.order[at : at + step], self.gap[at : at + step] = order, np.take_along_axis(d, order, 1)

    def _gaps(self, a: np.ndarray) -> np.ndarray:
        d = nn._gaps(a, self.values, self.kind)
        return d if self.kind == "L1" else np.sqrt(d)

    def metric(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """(id, fold, value) of L1 and L2: the fold's baseline less the distance of its point to the nearest training point."""
        for b in batches:
            for q, own, train in self._parts(b):
                value = np.full(len(q), np.nan)
                for i, (f, some) in enumerate(zip(own, train, strict=True)):
                    free = some > 0
                    near = self._gaps(f[None])[0][free].min(initial=np.inf)
                    if not np.isfinite(near):
                        continue
                    free[self.place_of[f.tobytes()]] = True
                    value[i] = self._baseline(free) - near
                ok = ~np.isnan(value)
                ids = q["id"].to_numpy()[ok]
                yield pd.DataFrame({"id": ids, "fold": ids, "value": value[ok]})

    def _baseline(self, free: np.ndarray) -> float:
        hit = free[self.order[:, 0]]
        total = float((self.gap[hit, 0] * self.weight[hit]).sum())
        rest = np.flatnonzero(~hit)
        if len(rest) and self.order.shape[1] > 1:
            ok = free[self.order[rest, 1:]]
            which, found = ok.argmax(1), ok.any(1)
            total += float((self.gap[rest[found], which[found] + 1] * self.weight[rest[found]]).sum())
            rest = rest[~found]
        for at in range(0, len(rest), 256):  # all of the nearest are left out: look at every combination
            total += float((np.where(free[None], self._gaps(self.grid[rest[at : at + 256]]), np.inf).min(1) * self.weight[rest[at : at + 256]]).sum())
        return total / float(self.weight.sum())


def _matrix_merges(points: np.ndarray) -> list[tuple[float, int, int]]:
    n = len(points)
    d = ((points[:, None] - points[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    size, alive, chain, merges = np.ones(n), np.ones(n, bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            a = chain[-1]
            b = int(np.argmin(d[a]))
            if len(chain) > 1 and d[a, chain[-2]] <= d[a, b]:
                b = chain[-2]
            if len(chain) > 1 and b == chain[-2]:
                break
            chain.append(b)
        a, b = sorted((chain.pop(), chain.pop()))
        merges.append((d[a, b], a, b))
        s = size[a] + size[b] + size
        new = ((size[a] + size) * d[a] + (size[b] + size) * d[b] - size * d[a, b]) / s
        new[~alive] = np.inf
        d[a], d[:, a] = new, new
        d[b] = d[:, b] = np.inf
        d[a, a] = np.inf
        size[a] += size[b]
        alive[b] = False
    return merges


def _centre_merges(points: np.ndarray) -> list[tuple[float, int, int]]:
    """The same merges by cluster centres: the distance of two is 2 s t / (s + t) times that of their centres, squared."""
    n, dim = points.shape
    centre = np.ascontiguousarray(points.T, float)
    size, name, alive = np.ones(n), np.arange(n), np.ones(n, bool)
    chain: list[int] = []
    merges = []

    def gaps(a: int) -> np.ndarray:
        d = np.zeros(len(size))
        for k in range(dim):
            gap = centre[k] - centre[k, a]
            gap *= gap
            d += gap
        d *= 2 * size * size[a] / (size + size[a])
        d[~alive] = np.inf
        d[a] = np.inf
        return d

    left = n
    while left > 1:
        if left < 0.75 * len(size):  # those that are gone leave the arrays
            place = np.cumsum(alive) - 1
            chain = [int(place[c]) for c in chain]
            centre, size, name = np.ascontiguousarray(centre[:, alive]), size[alive], name[alive]
            alive = np.ones(len(size), bool)
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            a = chain[-1]
            d = gaps(a)
            b = int(np.argmin(d))
            if len(chain) > 1 and d[chain[-2]] <= d[b]:
                b = chain[-2]
            if len(chain) > 1 and b == chain[-2]:
                break
            chain.append(b)
        a, b = sorted((chain.pop(), chain.pop()))
        merges.append((float(d[a] if np.isfinite(d[a]) else d[b]), int(name[a]), int(name[b])))
        centre[:, a] = (size[a] * centre[:, a] + size[b] * centre[:, b]) / (size[a] + size[b])
        size[a] += size[b]
        alive[b] = False
        left -= 1
    return merges


def ward(points: np.ndarray, counts: list[int]) -> dict[int, np.ndarray]:
    """Ward clusters of ``points`` for each number in ``counts``, by the nearest-neighbour chain; labels follow first members from 1.

    ``WARD_MATRIX`` points or fewer have a matrix of distances; more are merged by their centres, in memory that follows their number and time that follows its square.
    """
    n = len(points)
    if n > MAX_LOCAL:
        raise ValueError(f"hierarchical clustering takes {MAX_LOCAL} points at most, not {n}")
    merges = _matrix_merges(points) if n <= WARD_MATRIX else _centre_merges(points)
    merges.sort(key=lambda m: m[0])
    out = {}
    for k in counts:
        root = np.arange(n)

        def find(i: int, root=root) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for _, a, b in merges[: n - k]:
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
        roots = np.array([find(i) for i in range(n)])
        order = {r: j + 1 for j, r in enumerate(dict.fromkeys(roots.tolist()))}
        out[k] = np.array([order[r] for r in roots.tolist()])
    return out


def fit_variogram(dist: np.ndarray, gamma: np.ndarray, pairs: np.ndarray) -> dict[str, float | str]:
    """Weighted least squares (pairs over squared distance) of spherical, exponential and gaussian models over a grid of ranges; the best of all.

    Given a range and a model, nugget and sill are linear, solved in closed form, and kept at zero or more. Fits whose errors agree in nine digits are
    equal, and the first counts: models in the order above, smaller ranges, a nugget before none. So a flat variogram has a definite range.
    """
    w = pairs / np.maximum(dist, 1e-12) ** 2
    shapes = {
        "Sph": lambda h, r: np.where(h < r, 1.5 * h / r - 0.5 * (h / r) ** 3, 1.0),
        "Exp": lambda h, r: 1 - np.exp(-h / r),
        "Gau": lambda h, r: 1 - np.exp(-((h / r) ** 2)),
    }
    low, high = np.log(max(dist.min() / 2, 1e-12)), np.log(dist.max() * 2)
    best: dict[str, float | str] = {"sse": np.inf}
    s0, sg = w.sum(), (w * gamma).sum()
    scale = (w * gamma**2).sum()
    for model, shape in shapes.items():
        for r in np.exp(low + (high - low) * np.arange(RANGES) / (RANGES - 1)):
            f = shape(dist, r)
            sf, sff, sfg = (w * f).sum(), (w * f * f).sum(), (w * f * gamma).sum()
            det = s0 * sff - sf * sf
            fits = [((sg - (c := (s0 * sfg - sf * sg) / det) * sf) / s0, c)] if det > 1e-9 * s0 * sff else []
            for c0, c1 in [*fits, (0.0, sfg / sff)]:
                if c0 < 0 or c1 < 0:
                    continue
                sse = float((w * (c0 + c1 * f - gamma) ** 2).sum())
                if round(sse / scale, 9) < best["sse"] if scale else sse < best["sse"]:
                    best = {"sse": round(sse / scale, 9) if scale else sse, "model": model, "range": float(r), "nugget": float(c0), "sill": float(c1)}
    return best
