"""Sample points, gridded covariates and prediction points, with the checks that guard them."""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_CLASSES = 15
DEG_TO_METRE = 111325.0


@dataclass
class Points:
    """A table of points: ``id`` (unique long), ``x``, ``y`` and any attributes. ``crs`` is a name, ``longlat`` its kind."""

    df: DataFrame
    crs: str | None = None
    longlat: bool = False

    def __post_init__(self) -> None:
        missing = {"id", "x", "y"} - set(self.df.columns)
        if missing:
            raise ValueError(f"points need the columns id, x and y; missing: {sorted(missing)}")

    def with_df(self, df: DataFrame) -> Points:
        return Points(df, self.crs, self.longlat)

    def bbox(self) -> tuple[float, float, float, float]:
        """xmin, ymin, xmax, ymax, in one aggregate."""
        r = self.df.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
        if r[0] is None:
            raise ValueError("there are no points")
        return tuple(map(float, r))

    def count(self) -> int:
        return self.df.count()

    def require_crs(self) -> None:
        if self.crs is None:
            raise ValueError("the points need a coordinate reference system")

    def guess_crs(self) -> Points:
        """Geographic, with a warning, where no system is set and all coordinates lie within degrees."""
        if self.crs is not None:
            return self
        x0, y0, x1, y1 = self.bbox()
        lonlat = x0 >= -180 and x1 <= 180 and y0 >= -90 and y1 <= 90
        warnings.warn(f"no coordinate reference system is set; taken as {'geographic' if lonlat else 'projected'}", stacklevel=2)
        return Points(self.df, None, lonlat)


def same_crs(a: str | None, b: str | None) -> bool:
    """Two undefined systems are equal, a defined and an undefined one are not."""
    return a == b


def read_csv(spark: SparkSession, path: str, schema: str, crs: str | None = None) -> Points:
    """Points from a CSV with a header; ``id`` is added as 1 to n, in file order, where the schema has none.

    A row's number is its place in its input partition after the rows of all partitions before: no task orders the whole file.
    """
    df = spark.read.csv(path, header=True, schema=schema)
    if "id" not in df.columns:
        from pyspark.sql import Window

        placed = df.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
        before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
        counts = placed.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
        place = F.row_number().over(Window.partitionBy("__part").orderBy("__at"))
        df = placed.join(F.broadcast(counts), "__part").withColumn("id", (F.col("__before") + place).cast("long")).drop("__part", "__at", "__before")
    return Points(df, crs)


def read_parquet(spark: SparkSession, path: str, crs: str | None = None, longlat: bool = False) -> Points:
    return Points(spark.read.parquet(path), crs, longlat)


@dataclass
class Raster:
    """A gridded table (``row`` from the top, ``col`` from the left, 0-based, and the bands), and the grid's place."""

    df: DataFrame
    xmin: float
    ymax: float
    xres: float
    yres: float
    nrow: int
    ncol: int
    crs: str | None = None
    bands: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        if not all(map(math.isfinite, (self.xmin, self.ymax, self.xres, self.yres))) or self.xres <= 0 or self.yres <= 0 or self.nrow < 1 or self.ncol < 1:
            raise ValueError("the raster's extent is not finite or has no area")
        self.bands = self.bands or [c for c in self.df.columns if c not in ("row", "col", "x", "y")]

    def check_numeric(self) -> None:
        bad = [f.name for f in self.df.schema if f.name in self.bands and not isinstance(f.dataType, T.NumericType)]
        if bad:
            raise ValueError(f"layers that are not numeric: {', '.join(bad)}")

    @property
    def extent(self) -> tuple[float, float, float, float]:
        return self.xmin, self.ymax - self.nrow * self.yres, self.xmin + self.ncol * self.xres, self.ymax

    def cell(self, x: str = "x", y: str = "y") -> tuple[F.Column, F.Column]:
        """Row and column of a point; points on the last edge belong to the last cell."""
        col = F.least(F.floor((F.col(x) - self.xmin) / self.xres), F.lit(self.ncol - 1))
        row = F.least(F.floor((F.lit(self.ymax) - F.col(y)) / self.yres), F.lit(self.nrow - 1))
        return row.cast("int"), col.cast("int")

    def extract(self, df: DataFrame, bands: list[str] | None = None) -> DataFrame:
        """``df`` with the band values of each point's cell, null outside: an equi-join on the cell."""
        row, col = self.cell()
        cells = self.df.select(F.col("row").cast("int").alias("__row"), F.col("col").cast("int").alias("__col"), *(bands or self.bands))
        return df.withColumn("__row", row).withColumn("__col", col).join(cells, ["__row", "__col"], "left").drop("__row", "__col")

    def contains(self, points: Points) -> bool:
        """Whether the points' bounding box lies inside the raster's extent, edges included."""
        x0, y0, x1, y1 = points.bbox()
        a, b, c, d = self.extent
        return x0 >= a and y0 >= b and x1 <= c and y1 <= d

    def centres(self) -> DataFrame:
        return self.df.withColumn("x", F.lit(self.xmin) + (F.col("col") + 0.5) * self.xres).withColumn("y", F.lit(self.ymax) - (F.col("row") + 0.5) * self.yres)

    def usable(self, bands: list[str] | None = None) -> DataFrame:
        return self.centres().dropna(subset=bands or self.bands)

    def clamp(self, size: int) -> int:
        """The sample size, at most the usable cells; they are only counted where the grid is not far larger."""
        if self.nrow * self.ncol >= 5 * size:
            return size
        return min(size, self.usable().count())

    def regular_sample(self, size: int) -> DataFrame:
        """Every s-th row and column that has values, s = ceil(sqrt(cells / size)); it may hold fewer than ``size``."""
        s = max(1, math.ceil(math.sqrt(self.nrow * self.ncol / size)))
        o = s // 2
        return self.usable([self.bands[0]]).filter((F.col("row") % s == o) & (F.col("col") % s == o))

    def numbered_sample(self, size: int, seed: int = 0) -> DataFrame:
        """``random_sample`` with the cells' numbers as ``id``."""
        return self.random_sample(self.clamp(size), seed).withColumn("id", F.col("row").cast("long") * self.ncol + F.col("col"))

    def random_sample(self, size: int, seed: int = 0) -> DataFrame:
        """``size`` usable cells in the order of a seeded hash: the same at every partitioning."""
        return self.usable().orderBy(F.md5(F.concat_ws(":", F.lit(seed), "row", "col"))).limit(size)


def polygon_sample(spark: SparkSession, ring: list[tuple[float, float]], size: int, sampling: str = "regular", seed: int = 0) -> DataFrame:
    """(id, x, y) inside a polygon: about ``size`` points of a regular lattice, or ``size`` seeded random ones."""
    from stratafold.functions.geometry import in_ring

    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], ring[0]], strict=True))) / 2
    if area <= 0:
        raise ValueError("the polygon has no area")
    if sampling == "random":
        share = area / ((max(xs) - min(xs)) * (max(ys) - min(ys)))
        uniform = lambda tag: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit(tag), "id")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
        drawn = spark.range(math.ceil(1.5 * size / share) + 200).select("id", (F.lit(min(xs)) + uniform("x") * (max(xs) - min(xs))).alias("x"), (F.lit(min(ys)) + uniform("y") * (max(ys) - min(ys))).alias("y"))
        return drawn.filter(in_ring("x", "y", ring)).orderBy("id").limit(size)
    step = math.sqrt(area / size)
    nx, ny = math.ceil((max(xs) - min(xs)) / step), math.ceil((max(ys) - min(ys)) / step)
    lattice = spark.range(nx * ny).select(F.col("id"), (F.lit(min(xs)) + (F.col("id") % nx + 0.5) * step).alias("x"), (F.lit(min(ys)) + (F.floor(F.col("id") / nx) + 0.5) * step).alias("y"))
    return lattice.filter(in_ring("x", "y", ring))


def prediction_points(spark: SparkSession, pred_points: Points | DataFrame | None = None, model_domain: list[tuple[float, float]] | None = None, r: Raster | None = None, num_sample: int = 10_000, sampling: str = "regular", seed: int = 0, x: Points | None = None, domain_crs: str | None = None) -> DataFrame:
    """(id, x, y) from the first source that is given: points, a polygon, or the first layer of a raster. Reference systems must be those of the sample ``x``.

    A bare table, and a polygon without ``domain_crs``, are taken to be in its system.
    """
    if sampling not in ("regular", "random"):
        raise ValueError(f"unknown sampling {sampling!r}")
    if r is not None and x is not None:
        check_crs(x.crs, r.crs, "r")
    if pred_points is not None:
        if isinstance(pred_points, Points):
            if x is not None:
                check_crs(x.crs, pred_points.crs, "pred_points")
            pred_points = pred_points.df
        return pred_points.select("id", "x", "y")
    if model_domain is not None:
        if domain_crs is not None and x is not None:
            check_crs(x.crs, domain_crs, "model_domain")
        return polygon_sample(spark, model_domain, num_sample, sampling, seed)
    if r is not None:
        df = r.regular_sample(num_sample) if sampling == "regular" else r.random_sample(r.clamp(num_sample), seed)
        return df.select((F.col("row").cast("long") * r.ncol + F.col("col")).alias("id"), "x", "y")
    raise ValueError("give pred_points, model_domain or r to say where predictions are made")


def check_crs(a: str | None, b: str | None, name: str) -> None:
    if not same_crs(a, b):
        raise ValueError(f"the coordinate reference systems of the points ({a}) and of {name} ({b}) must match")


def check_column(df: DataFrame, column: str | None) -> str | None:
    """The column if the table has it; else a warning and None."""
    if column is not None and column not in df.columns:
        warnings.warn(f"there is no column {column!r}; it is ignored", stacklevel=2)
        return None
    return column


def check_group_column(df: DataFrame, column: object) -> str:
    if not isinstance(column, str) or column not in df.columns:
        raise ValueError("the group column must be the name of a column of the points")
    r = df.agg(F.sum(F.col(column).isNull().cast("int")), F.countDistinct(column)).first()
    if r[0]:
        raise ValueError("the group column has missing values")
    if r[1] < 2:
        raise ValueError("the group column needs two groups or more")
    return column


def presences(df: DataFrame, column: str | None, presence_bg: bool) -> DataFrame:
    """All rows, or those of value 1 of a column that must hold 0 and 1 alone."""
    if not presence_bg:
        return df
    if column is None or not isinstance(df.schema[column].dataType, T.NumericType):
        raise ValueError("presence-background data need a numeric column of 0 and 1")
    if df.filter(F.col(column).isNull() | ~F.col(column).isin(0, 1)).limit(1).count():
        raise ValueError("presence-background data must be 0 or 1, without missing values")
    return df.filter(F.col(column) == 1)


def check_classes(n: int, column: str) -> None:
    if n > MAX_CLASSES:
        warnings.warn(f"{column!r} has more than {MAX_CLASSES} classes; is it a binary or categorical response?", stacklevel=3)


def check_count(k: int, n: int, what: str = "points") -> None:
    if k > n:
        raise ValueError(f"{k} clusters are more than the {n} {what}; lower k or k_multiplier")


def iterations(value: object, name: str = "iteration") -> int:
    """A whole number of one or more; text that reads as a number counts."""
    try:
        return max(1, abs(int(value)))
    except (TypeError, ValueError):
        raise ValueError(f"{name} must be a natural number") from None


def check_folds_to_plot(num_plots: list[int] | None, k: int) -> list[int]:
    kept = [p for p in (num_plots or range(1, min(k, 10) + 1)) if 1 <= p <= k]
    if not kept:
        raise ValueError(f"num_plots holds none of the {k} folds")
    return kept
