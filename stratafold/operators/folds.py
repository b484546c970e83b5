"""The six fold constructors.

Each returns a ``Folds`` of lazily evaluated tables. k-fold methods carry (id, fold); leave-one-out methods carry the sparse pairs that
are *not* in training, from which train sets, of quadratic size, derive on demand.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratafold.functions.geometry import diagonal, distance, hex_centre, hexagon, in_polygon, square_cell
from stratafold.operators import balance, nn
from stratafold.operators.response import Response, loo_summary, records, response
from stratafold.sources import points as P


@dataclass
class Folds:
    """A set of folds. ``table``: (id, fold) of k-fold methods, or (fold, id, role) beside the training rows of leave-one-out ones."""

    kind: str
    k: int | None
    table: DataFrame
    records: DataFrame
    points: P.Points
    response: Response
    params: dict[str, Any] = field(default_factory=dict)
    extra: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def loo(self) -> bool:
        return self.kind in ("buffer", "nndm")

    def compared(self) -> P.Points:
        """The points that diagnostics compare: presences alone for presence-background folds, else all."""
        column = self.params.get("column")
        if self.params.get("presence_bg") and column in self.points.df.columns:
            return self.points.with_df(self.points.df.filter(F.col(column) == 1))
        return self.points

    def folds_list(self) -> DataFrame:
        """(fold, id, role) with every training row: k times the points, or their square for leave-one-out folds."""
        if not self.loo:
            folds = self.points.df.sparkSession.range(1, self.k + 1).select(F.col("id").cast("int").alias("p"))
            pairs = self.table.filter("fold is not null").crossJoin(F.broadcast(folds))
            return pairs.select(F.col("p").alias("fold"), "id", F.when(F.col("fold") == F.col("p"), "test").otherwise("train").alias("role"))
        if self.kind == "buffer":  # by distance, in the tasks that hold the points: neither the pairs within the buffer nor an exchange of all pairs
            places = self.points.df.select("id", "x", "y")
            parts = max(nn.spread(places), 256)
            fold = self.extra["targets"].join(places.select(F.col("id").alias("fold"), F.col("x").alias("__x"), F.col("y").alias("__y")), "fold").repartition(parts)
            far = ~(distance("__x", "__y", "x", "y", self.points.longlat) <= F.lit(self.params["size"]))
            train = fold.join(F.broadcast(places), far | far.isNull()).select("fold", "id", F.lit("train").alias("role"))
            return train.unionByName(self.table.filter("role = 'test'").select("fold", "id", "role"))
        targets = self.extra["targets"].select(F.col("fold"))
        every = targets.join(self.points.df.select("id"), F.lit(True))
        train = every.join(self.extra["held"].select("fold", "id"), ["fold", "id"], "left_anti").withColumn("role", F.lit("train"))
        return train.unionByName(self.table.filter("role = 'test'").select("fold", "id", "role"))

    def biomod_table(self) -> DataFrame:
        """(id, RUN1, ..., RUNk), true in training; null for points without a fold."""
        if self.loo:
            raise ValueError("leave-one-out folds have no biomod table")
        return self.table.select("id", *((F.col("fold") != p).alias(f"RUN{p}") for p in range(1, self.k + 1)))

    def caret(self) -> DataFrame:
        """(fold, index, indexOut): ids in training and test, sorted."""
        ids = lambda r: F.sort_array(F.collect_list(F.when(F.col("role") == r, F.col("id"))))
        return self.folds_list().groupBy("fold").agg(ids("train").alias("index"), ids("test").alias("indexOut"))

    def with_features(self, features: DataFrame) -> DataFrame:
        """Every (fold, role) row with its features, for models fitted fold by fold."""
        return self.folds_list().join(features, "id")

    def empty_cells(self) -> DataFrame:
        """(fold, cell): record cells without a point."""
        names = [c for c in self.records.columns if c != "fold"]
        cells = F.explode(F.array(*(F.struct(F.lit(n).alias("cell"), F.col(n).alias("n")) for n in names)))
        return self.records.select("fold", cells.alias("c")).filter("c.n < 1").select("fold", "c.cell")

    def summary(self) -> DataFrame:
        return loo_summary(self.records) if self.loo else self.records

    def describe(self, cap: int = 12) -> str:
        """The text that printing shows: kind, parameters, and up to ``cap`` (6 for leave-one-out) rows of records."""
        cap = 6 if self.loo else cap
        rows = self.records.orderBy("fold").limit(cap + 1).collect()
        lines = [f"{self.kind} folds" + (f", k = {self.k}" if self.k else ""), *(f"  {a}: {b}" for a, b in self.params.items()), *(str(r.asDict()) for r in rows[:cap])]
        return "\n".join(lines + (["... more folds"] if len(rows) > cap else []))

    __str__ = describe


def _kfold(kind: str, points: P.Points, table: DataFrame, res: Response, k: int, params: dict, extra: dict | None = None) -> Folds:
    tagged = res.df.select("id", "cls").join(table.select("id", "fold"), "id", "left")
    return Folds(kind, k, table.select("id", F.col("fold").cast("int").alias("fold")), records(tagged, res.classes, k), points, res, params, extra or {})


def _check_k(k: int, most: int, what: str) -> None:
    if not isinstance(k, int) or k < 2 or k > most:
        raise ValueError(f"k must be a whole number from 2 to the number of {what} ({most}), not {k}")


@dataclass
class Grid:
    """A tiling: ``key`` gives (row, column) columns of a point, ``ids`` the number of a cell."""

    hexagonal: bool
    xmin: float
    ymax: float
    ymin: float
    width: float
    height: float
    nrow: int
    ncol: int
    flat_top: bool = False

    def place(self, df: DataFrame) -> DataFrame:
        if self.hexagonal:
            row, col = hexagon(F.col("x"), F.col("y"), self.xmin, self.ymin, self.width, self.flat_top)
        else:
            row, col = square_cell(F.col("x"), F.col("y"), self.xmin, self.ymax, self.width, self.height, self.nrow, self.ncol)
        return df.withColumn("row", row).withColumn("col", col)


def make_grid(bbox: tuple[float, float, float, float], longlat: bool = False, hexagonal: bool = True, flat_top: bool = False, size: float | None = None, rows_cols: tuple[int, int] = (10, 10), offset: tuple[float, float] = (0.0, 0.0), extend: float = 0.0, deg_to_metre: float = P.DEG_TO_METRE) -> Grid:
    """A tiling of ``bbox``. ``size`` is in metres and turned into degrees first, the offset's share after; without it ``rows_cols`` decide.

    Square cells by size are centred on the box, moved by the offset's fraction of a cell, with a column or row more where that uncovers points. ``extend``,
    at most five per cent, widens the box on each side without changing the number of cells. Hexagons by rows take the x range over rows as size.
    """
    x0, y0, x1, y1 = bbox
    xr, yr = x1 - x0, y1 - y0
    if size is not None:
        size = size / deg_to_metre if longlat else float(size)
        if size <= 0:
            raise ValueError("size must be positive")
    ox, oy = (abs(o) % 1 for o in offset)
    if hexagonal:
        width = size or xr / max(1, rows_cols[0]) or 1.0
        move = [0.0 if size is None or o in (0.0, 1.0) else (1 - o) * width for o in (ox, oy)]
        return Grid(True, x0 - move[0], y1, y0 - move[1], width, width, 0, 0, flat_top)
    e = min(5.0, abs(extend)) / 100
    if size is None:
        nrow, ncol = (max(1, int(n)) for n in rows_cols)
        left, right, low, high = x0, x1, y0, y1
        w, h = xr / ncol or 1.0, yr / nrow or 1.0
    else:
        ncol, nrow = max(1, math.ceil(xr / size)), max(1, math.ceil(yr / size))
        px, py = (ncol * size - xr) / 2, (nrow * size - yr) / 2
        left, right, low, high = x0 - px + ox * size, x1 + px + ox * size, y0 - py + oy * size, y1 + py + oy * size
        if left > x0:
            left, ncol = left - size, ncol + 1
        if low > y0:
            low, nrow = low - size, nrow + 1
        w = h = size
    if e:
        left, right, low, high = left - e * xr, right + e * xr, low - e * yr, high + e * yr
        w, h = (right - left) / ncol, (high - low) / nrow
    return Grid(False, left, high, low, w, h, nrow, ncol, flat_top)


def spatial(
    x: P.Points, column: str | None = None, r: P.Raster | None = None, k: int = 5, hexagon: bool = True, flat_top: bool = False, size: float | None = None, rows_cols: tuple[int, int] = (10, 10),
    selection: str = "random", iteration: object = 100, balance_folds: bool = True, presence_bg: bool = False, user_blocks: DataFrame | None = None, folds_column: str | None = None,
    deg_to_metre: float = P.DEG_TO_METRE, offset: tuple[float, float] = (0.0, 0.0), extend: float = 0.0, seed: int = 0, num_bins: int | None = 4,
) -> Folds:
    """Blocks of space as folds. ``user_blocks``: (block_id, ring array<struct<x, y>>, and ``folds_column``), a bounded table of polygons.

    A point on an edge between user blocks belongs to the smallest block id; a point in none has no fold.
    """
    if selection not in ("random", "systematic", "checkerboard", "predefined"):
        raise ValueError(f"unknown selection {selection!r}")
    if user_blocks is not None and selection == "checkerboard":
        warnings.warn("user blocks have no checkerboard; selection is random", stacklevel=2)
        selection = "random"
    if hexagon and selection in ("checkerboard", "predefined"):
        warnings.warn(f"hexagons cannot be {selection}; selection is random", stacklevel=2)
        selection = "random"
    if selection == "predefined" and (user_blocks is None or folds_column is None):
        raise ValueError("predefined selection needs user_blocks and a folds_column")
    if selection == "checkerboard":
        k = 2
    column = P.check_column(x.df, column)
    P.presences(x.df, column, presence_bg)
    x = x.guess_crs()
    res, own = response(x.df, column, num_bins), {"column": column, "presence_bg": presence_bg}
    if user_blocks is not None:
        extra_cols = [folds_column] if folds_column else []
        hit = in_polygons(x.df.select("id", "x", "y"), user_blocks.select("block_id", "ring", *extra_cols))
        keyed = hit.groupBy("id").agg(F.min(F.struct(F.col("block_id").alias("key"), *extra_cols)).alias("b")).select("id", "b.*")
        order = ["key"]
    else:
        if r is not None and not r.contains(x):
            raise ValueError("the points are not within the raster")
        grid = make_grid(r.extent if r is not None else x.bbox(), x.longlat, hexagon, flat_top, size, rows_cols, offset, extend, deg_to_metre)
        keyed = grid.place(x.df.select("id", "x", "y")).withColumn("key", F.struct("row", "col"))
        order = ["key"]
    if selection == "checkerboard":
        table = keyed.select("id", ((F.col("row") + F.col("col") + 1) % 2 + 1).alias("fold"))
        return _kfold("spatial", x, table, res, k, {"selection": selection, "size": size, **own}, {"blocks": keyed})
    if selection == "predefined":
        table = keyed.select("id", F.col(folds_column).cast("int").alias("fold"))
        return _kfold("spatial", x, table, res, k, {"selection": selection, **own}, {"blocks": keyed})
    occupied = keyed.select("key").distinct()
    if hexagon and user_blocks is None:
        _, cy = hex_centre(F.col("key.row"), F.col("key.col"), grid.xmin, grid.ymin, grid.width, flat_top)
        order = [F.round(cy, 9), "key"] if selection == "systematic" else ["key"]
    numbered = occupied.withColumn("block_id", F.row_number().over(Window.orderBy(*order)).cast("int"))
    n = numbered.count()
    _check_k(k, n, "blocks that hold points")
    blocks = keyed.join(numbered, "key").select("id", "block_id")
    if selection == "systematic":
        table = blocks.select("id", "block_id", ((F.col("block_id") - 1) % k + 1).alias("fold"))
    else:
        tagged = res.df.select("id", "cls").join(blocks, "id")
        won = balance.balanced(tagged, "block_id", res.classes, k, P.iterations(iteration) if balance_folds else 1, seed, presence_bg, n)
        table = blocks.join(won.withColumnRenamed("piece", "block_id"), "block_id")
    return _kfold("spatial", x, table, res, k, {"selection": selection, "size": size, "blocks": n, **own}, {"blocks": blocks})


def in_polygons(points: DataFrame, polygons: DataFrame, most_cells: int = 64) -> DataFrame:
    """``points`` (id, x, y) beside the ``polygons`` (ring, ...) that hold them, edges included.

    Both meet in grid cells as wide as an average polygon, or the widest over ``most_cells``: an equi-join, whatever the number of polygons.
    """
    side = lambda f, c: f(F.transform("ring", lambda p: p[c]))
    boxed = polygons.select("*", side(F.array_min, "x").alias("__x0"), side(F.array_max, "x").alias("__x1"), side(F.array_min, "y").alias("__y0"), side(F.array_max, "y").alias("__y1"))
    wide = F.greatest(F.col("__x1") - F.col("__x0"), F.col("__y1") - F.col("__y0")).cast("double")
    mean, most = boxed.agg(F.avg(wide), F.max(wide)).first()
    width = F.lit(max(mean or 0.0, (most or 0.0) / most_cells) or 1.0)
    cell = lambda c: F.floor(F.col(c) / width)
    spread = boxed.withColumn("__gx", F.explode(F.sequence(cell("__x0"), cell("__x1")))).withColumn("__gy", F.explode(F.sequence(cell("__y0"), cell("__y1"))))
    placed = points.withColumn("__gx", cell("x")).withColumn("__gy", cell("y"))
    near = placed.join(spread, ["__gx", "__gy"]).filter(F.col("x").between(F.col("__x0"), F.col("__x1")) & F.col("y").between(F.col("__y0"), F.col("__y1")) & in_polygon("x", "y", "ring"))
    return near.drop("__gx", "__gy", "__x0", "__x1", "__y0", "__y1")


def group(x: P.Points, group_col: str, column: str | None = None, k: int | None = None, balance_folds: bool = False, iteration: object = 100, seed: int = 0, num_bins: int | None = 4) -> Folds:
    """Groups as folds: one each, or merged to k, round robin in sorted order or by the search."""
    group_col = P.check_group_column(x.df, group_col)
    column = P.check_column(x.df, column)
    res = response(x.df, column, num_bins)
    groups = x.df.select(F.col(group_col).alias("g")).distinct().withColumn("piece", F.row_number().over(Window.orderBy("g")).cast("int"))
    n = groups.count()
    coded = x.df.select("id", F.col(group_col).alias("g")).join(groups, "g").select("id", "piece")
    if k is None or k >= n:
        return _kfold("group", x, coded.select("id", F.col("piece").alias("fold")), res, n, {"type": "Leave-group-out", "groups": n})
    _check_k(k, n, "groups")
    if balance_folds:
        won = balance.balanced(res.df.select("id", "cls").join(coded, "id"), "piece", res.classes, k, P.iterations(iteration), seed, n=n)
        table = coded.join(won, "piece").select("id", "fold")
    else:
        table = coded.select("id", ((F.col("piece") - 1) % k + 1).alias("fold"))
    return _kfold("group", x, table, res, k, {"type": "Grouped (merged to k folds)", "groups": n})


def _loo(kind: str, x: P.Points, res: Response, targets: DataFrame, held: DataFrame, tests: DataFrame, params: dict, extra: dict, counted: DataFrame | None = None) -> Folds:
    """``targets``: (fold); ``held``: (fold, id) not in training; ``tests``: (fold, id). Train counts are totals less the held pairs.

    ``counted`` (fold, out..., test...) has the counts of held and test points where they are known without the pairs.
    """
    cls = res.df.select("id", "cls")
    names = res.classes or [None]
    count = lambda c: F.count("*") if c is None else F.count_if(F.col("cls") == c)
    name = lambda p, c: p if c is None else f"{p}_{c}"
    totals = cls.agg(*(count(c).alias(name("__total", c)) for c in names))
    if counted is None:
        outs = held.join(cls, "id").groupBy("fold").agg(*(count(c).alias(name("__out", c)) for c in names))
        ins = tests.join(cls, "id").groupBy("fold").agg(*(count(c).alias(name("test", c)) for c in names))
        counted = targets.join(outs, "fold", "left").join(ins, "fold", "left").fillna(0)
    table = counted.crossJoin(F.broadcast(totals))
    rec = table.select("fold", *((F.col(name("__total", c)) - F.col(name("__out", c))).alias(name("train", c)) for c in names), *(name("test", c) for c in names))
    return Folds(kind, None, tests.withColumn("role", F.lit("test")), rec, x, res, params, {"targets": targets, "held": held, **extra})


def buffer(x: P.Points, size: float, column: str | None = None, presence_bg: bool = False, add_bg: bool = False, num_bins: int | None = 4) -> Folds:
    """A fold for each point (or presence): it is the test, and training is what lies farther than ``size``.

    With ``add_bg`` backgrounds within the buffer are tests as well. The fold's name is the target's id. Records come from counts; the held pairs, a square in the
    number of points, are made only where they are asked for.
    """
    x.require_crs()
    column = P.check_column(x.df, column)
    targets = P.presences(x.df, column, presence_bg)
    res = response(x.df, column, num_bins)
    held = nn.within(targets, x.df, size, x.longlat).select(F.col("i").alias("fold"), F.col("j").alias("id"))
    tests = targets.select(F.col("id").alias("fold"), "id")
    if presence_bg and add_bg:
        tests = tests.unionByName(held.join(x.df.filter(F.col(column) == 0).select("id"), "id").select("fold", "id"))
    own = res.df.join(targets.select("id"), "id", "left_semi") if presence_bg else res.df
    near = nn.counts_within(targets, res.df, size, res.classes, x.longlat).join(own.select(F.col("id").alias("fold"), F.col("cls").alias("__cls")), "fold")
    kinds = list(enumerate(res.classes)) or [(None, None)]
    backgrounds = F.col(f"n_{res.classes.index('0')}") if presence_bg and add_bg and "0" in res.classes else F.lit(0).cast("long")
    mine = lambda c: F.lit(1).cast("long") if c is None else F.coalesce((F.col("__cls") == c).cast("long"), F.lit(0)) + (backgrounds if c == "0" else F.lit(0))
    name = lambda p, c: p if c is None else f"{p}_{c}"
    counted = near.select("fold", *(F.col("n" if k is None else f"n_{k}").alias(name("__out", c)) for k, c in kinds), *(mine(c).alias(name("test", c)) for _, c in kinds))
    return _loo("buffer", x, res, targets.select(F.col("id").alias("fold")), held, tests, {"size": size, "column": column, "presence_bg": presence_bg, "add_bg": add_bg}, {"exclusion": targets.select(F.col("id").alias("fold"), F.lit(float(size)).alias("exclusion_distance"))}, counted)


def nndm_folds(x: P.Points, exclusion: DataFrame, column: str | None, presence_bg: bool, add_bg: bool, num_bins: int | None, params: dict) -> Folds:
    """Leave-one-out folds whose training is farther than each target's own exclusion distance; ``exclusion``: (fold, exclusion_distance)."""
    res = response(x.df, column, num_bins)
    targets = P.presences(x.df, column, presence_bg)
    most = 2 * diagonal(x.bbox(), x.longlat) + 1.0
    far = min(exclusion.agg(F.max("exclusion_distance")).first()[0] or 1.0, most)
    near = nn.within(targets, x.df, far, x.longlat).withColumnRenamed("i", "fold")
    held = near.join(exclusion.select("fold", "exclusion_distance"), "fold").filter(F.col("d") <= F.col("exclusion_distance")).select("fold", F.col("j").alias("id"))
    held = held.unionByName(targets.select(F.col("id").alias("fold"), "id")).distinct()
    tests = targets.select(F.col("id").alias("fold"), "id")
    if presence_bg and add_bg:
        tests = tests.unionByName(held.join(x.df.filter(F.col(column) == 0).select("id"), "id").select("fold", "id"))
    return _loo("nndm", x, res, targets.select(F.col("id").alias("fold")), held, tests, params | {"column": column, "presence_bg": presence_bg, "add_bg": add_bg}, {"exclusion": exclusion})


def to_long(folds: Folds, num_plots: list[int] | None = None, combine_folds: bool = False) -> DataFrame:
    """(id, x, y, fold, role) for maps: 1 in training, 0 in test, null if left out; with ``combine_folds`` (id, x, y, fold), a row a point."""
    check_folds(folds)
    spark = folds.points.df.sparkSession
    if combine_folds:
        if folds.loo:
            raise ValueError("folds of one point each cannot be combined to one map")
        return folds.points.df.select("id", "x", "y").join(folds.table, "id", "left")
    if folds.loo:
        shown = folds.extra["targets"].orderBy("fold").limit(10) if num_plots is None else folds.extra["targets"].filter(F.col("fold").isin(num_plots))
    else:
        shown = spark.createDataFrame([(p,) for p in P.check_folds_to_plot(num_plots, folds.k)], "fold int")
    every = folds.points.df.select("id", "x", "y").crossJoin(F.broadcast(shown))  # ten folds, or those that are named
    if not folds.loo:
        mine = folds.table.select("id", F.col("fold").alias("own"))
        return every.join(mine, "id", "left").select("id", "x", "y", "fold", (F.col("own") != F.col("fold")).cast("int").alias("role"))
    if folds.kind == "buffer":  # by distance: the shown folds alone, and no pairs
        places = folds.points.df.select(F.col("id").alias("fold"), F.col("x").alias("__x"), F.col("y").alias("__y"))
        near = distance("__x", "__y", "x", "y", folds.points.longlat) <= F.lit(folds.params["size"])
        column, add_bg = folds.params["column"], folds.params["presence_bg"] and folds.params["add_bg"]
        test = (F.col("id") == F.col("fold")) | (near & (F.col("__occ") == 0) if add_bg else F.lit(False))
        points = folds.points.df.select("id", "x", "y", *([F.col(column).alias("__occ")] if add_bg else []))
        tagged = points.crossJoin(F.broadcast(shown.join(places, "fold")))
        return tagged.select("id", "x", "y", "fold", F.when(test, 0).when(~near | near.isNull(), 1).alias("role"))
    held = folds.extra["held"].withColumn("out", F.lit(1))
    tests = folds.table.select("fold", "id").withColumn("test", F.lit(1))
    tagged = every.join(held, ["fold", "id"], "left").join(tests, ["fold", "id"], "left")
    return tagged.select("id", "x", "y", "fold", F.when(F.col("test") == 1, 0).when(F.col("out").isNull(), 1).alias("role"))


def check_folds(folds: object) -> None:
    if not isinstance(folds, Folds):
        raise TypeError(f"folds must come from a fold constructor, not {type(folds).__name__}")


def check_matches(folds: Folds, x: P.Points) -> None:
    """The points must be those that the folds were made from, by number."""
    check_folds(folds)
    if folds.points.df.count() != x.df.count():
        raise ValueError("the points do not match the folds")


def distances_matrix(x: P.Points, num: int = 5000) -> DataFrame:
    """(i, j, d) of all pairs, for small tables only."""
    if x.df.count() > num:
        raise ValueError(f"all pairs of more than {num} points are not made; use the joins of nn")
    a, b = (x.df.select(F.col("id").alias(n), F.col("x").alias(f"{n}x"), F.col("y").alias(f"{n}y")) for n in ("i", "j"))
    return a.crossJoin(b).select("i", "j", distance("ix", "iy", "jx", "jy", x.longlat).alias("d"))
