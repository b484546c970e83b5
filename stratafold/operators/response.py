"""Responses: binning of continuous values, and record counts of folds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratafold.sources.points import check_classes


def check_num_bins(num_bins: object) -> int | None:
    if num_bins is None:
        return None
    if not isinstance(num_bins, int) or isinstance(num_bins, bool) or num_bins < 2:
        raise ValueError("num_bins must be a whole number of 2 or more")
    return num_bins


def quantile_breaks(df: DataFrame, column: str, num_bins: int) -> list[float]:
    """Distinct interpolated quantiles, rounded to nine places so that values on a break compare alike everywhere."""
    at = [k / num_bins for k in range(num_bins + 1)]
    found = df.agg(F.percentile(column, F.array(*map(F.lit, at)))).first()[0]
    return sorted({round(v, 9) for v in found or []})


def bin_label(column: str, breaks: list[float]) -> Column:
    """Q1, Q2, ...: right-closed bins, the lowest with its left end."""
    label = F.lit(f"Q{max(1, len(breaks) - 1)}")
    for k in range(len(breaks) - 2, 0, -1):
        label = F.when(F.col(column) <= F.lit(breaks[k]), f"Q{k}").otherwise(label)
    return F.when(F.col(column).isNotNull(), label)


@dataclass
class Response:
    """The table with its class column ``cls`` (text, null where the value is), the classes in order, and the bins if there are any."""

    df: DataFrame
    classes: list[str]
    bins: list[tuple[str, float, float]] | None = None

    @property
    def train_test(self) -> bool:
        return not self.classes


def response(df: DataFrame, column: str | None, num_bins: int | None = 4) -> Response:
    """Numeric columns are binned if they have more than ``num_bins`` values and any is not whole, or more than 15."""
    num_bins = check_num_bins(num_bins)
    if column is None:
        return Response(df.withColumn("cls", F.lit(None).cast("string")), [])
    if num_bins and isinstance(df.schema[column].dataType, T.NumericType):
        r = df.agg(F.countDistinct(column), F.max((F.col(column) != F.floor(column)).cast("int"))).first()
        if r[0] > num_bins and (r[1] == 1 or r[0] > 15):
            breaks = quantile_breaks(df, column, num_bins)
            labels = [f"Q{k}" for k in range(1, max(2, len(breaks)))]
            return Response(df.withColumn("cls", bin_label(column, breaks)), labels, list(zip(labels, breaks, breaks[1:], strict=False)))
    values = [x[0] for x in df.select(column).distinct().filter(F.col(column).isNotNull()).orderBy(column).collect()]
    check_classes(len(values), column)
    return Response(df.withColumn("cls", F.col(column).cast("string")), [str(v) for v in values])


def records(df: DataFrame, classes: list[str], k: int) -> DataFrame:
    """(fold, train..., test...) of folds in which each point is tested once: train counts are totals less the fold's own.

    ``df`` holds (fold, cls). Points without a fold are in neither part; each class and fold has its column and row, zero or not.
    """
    inside = df.filter("fold is not null")
    folds = df.sparkSession.range(1, k + 1).select(F.col("id").cast("int").alias("fold"))
    tests = [F.count("*").alias("test")] if not classes else [F.count_if(F.col("cls") == c).alias(f"test_{c}") for c in classes]
    by_fold = inside.groupBy(F.col("fold").cast("int").alias("fold")).agg(*tests)
    names = by_fold.columns[1:]
    totals = by_fold.agg(*(F.sum(n).alias(f"__{n}") for n in names))
    full = folds.join(by_fold, "fold", "left").fillna(0).crossJoin(F.broadcast(totals))
    return full.select("fold", *((F.coalesce(F.col(f"__{n}"), F.lit(0)) - F.col(n)).alias(n.replace("test", "train", 1)) for n in names), *names)


def loo_summary(table: DataFrame) -> DataFrame:
    """(stat, ...): smallest, mean and largest count of each column of a leave-one-out record table."""
    names = [c for c in table.columns if c != "fold"]
    one = table.agg(*(f(F.col(n).cast("double")).alias(f"{s}__{n}") for n in names for s, f in (("min", F.min), ("mean", F.avg), ("max", F.max))))
    stats = F.explode(F.array(*(F.struct(F.lit(s).alias("stat"), *(F.col(f"{s}__{n}").alias(n) for n in names)) for s in ("min", "mean", "max"))))
    return one.select(stats.alias("s")).select("s.*")
