"""Geometry as arithmetic on doubles: distances, cells, hexagons and polygons."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_RADIUS = 6371008.8


def squared(ax: str, ay: str, bx: str, by: str) -> Column:
    dx, dy = F.col(ax) - F.col(bx), F.col(ay) - F.col(by)
    return (dx * dx + dy * dy).cast("double")


def haversine(ax: str, ay: str, bx: str, by: str) -> Column:
    """Great-circle metres between degrees."""
    lat = (F.radians(by) - F.radians(ay)) / 2
    lon = (F.radians(bx) - F.radians(ax)) / 2
    h = F.pow(F.sin(lat), 2) + F.cos(F.radians(ay)) * F.cos(F.radians(by)) * F.pow(F.sin(lon), 2)
    return F.lit(2 * EARTH_RADIUS) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def distance(ax: str, ay: str, bx: str, by: str, longlat: bool = False) -> Column:
    return haversine(ax, ay, bx, by) if longlat else F.sqrt(squared(ax, ay, bx, by))


def diagonal(bbox: tuple[float, float, float, float], longlat: bool = False) -> float:
    x0, y0, x1, y1 = bbox
    if not longlat:
        return math.hypot(x1 - x0, y1 - y0)
    a, b = math.radians(y0), math.radians(y1)
    h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(x1 - x0) / 2) ** 2
    return 2 * EARTH_RADIUS * math.asin(math.sqrt(min(1.0, h)))


def square_cell(x: Column, y: Column, xmin: float, ymax: float, w: float, h: float, nrow: int, ncol: int) -> tuple[Column, Column]:
    """(row from the top, column) of half-open cells whose last row and column are closed."""
    col = F.greatest(F.lit(0), F.least(F.floor((x - F.lit(xmin)) / F.lit(w)), F.lit(ncol - 1)))
    row = F.greatest(F.lit(0), F.least(F.floor((F.lit(ymax) - y) / F.lit(h)), F.lit(nrow - 1)))
    return row.cast("int"), col.cast("int")


def hexagon(x: Column, y: Column, xmin: float, ymin: float, size: float | Column, flat_top: bool = False) -> tuple[Column, Column]:
    """(row, column) of the nearest centre of a hexagonal tiling whose flats are ``size`` apart; ties go to the lower row, then column.

    Centres are ``size`` apart in a row, rows size * sqrt(3) / 2 apart, odd rows shifted by half a ``size``; ``flat_top`` swaps the axes.
    """
    u, v = ((y - F.lit(ymin)), (x - F.lit(xmin))) if flat_top else ((x - F.lit(xmin)), (y - F.lit(ymin)))
    height = size * math.sqrt(3) / 2
    base, tries = F.floor(v / F.lit(height)), []
    for d in (0, 1):
        row = base + d
        shift = F.pmod(row, F.lit(2)) * F.lit(size / 2)
        first = F.floor((u - shift) / F.lit(size))
        for e in (0, 1):
            col = first + e
            cx, cy = col * F.lit(size) + shift, row * F.lit(height)
            tries.append(F.struct(F.round((u - cx) * (u - cx) + (v - cy) * (v - cy), 9).alias("d"), row.cast("int").alias("row"), col.cast("int").alias("col")))
    best = F.array_min(F.array(*tries))
    return best["row"], best["col"]


def hexagon_np(x: np.ndarray, y: np.ndarray, xmin: float, ymin: float, size: float) -> tuple[np.ndarray, np.ndarray]:
    """``hexagon`` of arrays, by the same operations."""
    u, v = x - xmin, y - ymin
    height = size * math.sqrt(3) / 2
    base, best = np.floor(v / height), None
    for d in (0, 1):
        row = base + d
        shift = np.mod(row, 2) * (size / 2)
        first = np.floor((u - shift) / size)
        for e in (0, 1):
            col = first + e
            cx, cy = col * size + shift, row * height
            gap = (u - cx) * (u - cx) + (v - cy) * (v - cy)
            gap = np.where(gap < 4e6, np.round(gap, 9), gap)  # larger doubles have no ninth digit to round
            if best is None:
                best = gap, row, col
            else:  # rows and columns rise from try to try, so that only less is better
                less = gap < best[0]
                best = tuple(np.where(less, a, b) for a, b in zip((gap, row, col), best, strict=True))
    return best[1].astype(np.int64), best[2].astype(np.int64)


def hex_centre(row: Column, col: Column, xmin: float, ymin: float, size: float, flat_top: bool = False) -> tuple[Column, Column]:
    u = col * F.lit(size) + F.pmod(row, F.lit(2)) * F.lit(size / 2)
    v = row * F.lit(size * math.sqrt(3) / 2)
    return (v + xmin, u + ymin) if flat_top else (u + xmin, v + ymin)


def in_ring(x: str, y: str, ring: list[tuple[float, float]]) -> Column:
    """Whether a point lies in a polygon given as numbers, edges included, by counting crossings."""
    px, py = F.col(x), F.col(y)
    odd, edge = F.lit(False), F.lit(False)
    for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True):
        turn = (px - ax) * (by - ay) - (py - ay) * (bx - ax)
        edge = edge | ((turn == 0) & px.between(min(ax, bx), max(ax, bx)) & py.between(min(ay, by), max(ay, by)))
        if ay != by:
            cross = ((F.lit(ay) > py) != (F.lit(by) > py)) & (px < (py - ay) * ((bx - ax) / (by - ay)) + ax)
            odd = odd != cross
    return odd | edge


def in_polygon(x: str, y: str, ring: str) -> Column:
    """The same for a column of rings, array<struct<x, y>>."""
    n = F.size(ring)

    def crossing(state: Column, i: Column) -> Column:
        a, b = F.get(F.col(ring), i), F.get(F.col(ring), F.pmod(i + 1, n))
        px, py = F.col(x), F.col(y)
        turn = (px - a["x"]) * (b["y"] - a["y"]) - (py - a["y"]) * (b["x"] - a["x"])
        on = (turn == 0) & px.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & py.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))
        cross = ((a["y"] > py) != (b["y"] > py)) & (px < (py - a["y"]) * (b["x"] - a["x"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"])
        return F.struct((state["odd"] != F.coalesce(cross, F.lit(False))).alias("odd"), (state["edge"] | on).alias("edge"))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.struct(F.lit(False).alias("odd"), F.lit(False).alias("edge")), crossing, lambda s: s["odd"] | s["edge"])


def neighbours(x: Column, y: Column, width: float) -> Column:
    """The nine cells around a point in a grid of ``width``, as an array of (gx, gy)."""
    gx, gy = F.floor(x / F.lit(width)), F.floor(y / F.lit(width))
    return F.array(*(F.struct((gx + i).alias("gx"), (gy + j).alias("gy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))


def with_cell(df: DataFrame, width: float, x: str = "x", y: str = "y") -> DataFrame:
    return df.withColumn("gx", F.floor(F.col(x) / F.lit(width))).withColumn("gy", F.floor(F.col(y) / F.lit(width)))
