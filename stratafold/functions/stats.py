"""Rounding, curves and distances between distributions, as plans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratafold.state import settle

FEW_ROWS = 100_000


def signif(value: Column, digits: int = 4) -> Column:
    """Rounded to significant digits; zero and null stay."""
    step = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(value))) - (digits - 1))
    return F.when((value == 0) | value.isNull(), value).otherwise(F.round(value / step) * step)


def _edges(df: DataFrame, value: str, parts: int) -> list[float]:
    """Quantiles of a numeric column, ``parts`` - 1 at most."""
    found = df.agg(F.percentile_approx(value, [k / parts for k in range(1, parts)], 10_000)).first()[0] if parts > 1 else []
    return sorted(set(found or []))


def bucketed(df: DataFrame, value: str, edges: dict[int, list[float]] | list[float], name: str, of: str | None = None) -> DataFrame:
    """``df`` with ``name``: how many of the rising ``edges``, those of the row's ``of`` where it is given, lie below a value that is not null."""
    own = {k: np.array(v, float) for k, v in edges.items()} if isinstance(edges, dict) else {0: np.array(edges, float)}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, out = b.column(b.schema.get_field_index(value)).to_numpy(zero_copy_only=False).astype(float), np.zeros(b.num_rows, np.int32)
            which = b.column(b.schema.get_field_index(of)).to_numpy(zero_copy_only=False) if of else np.zeros(b.num_rows, np.int32)
            for k in np.unique(which):
                rows = which == k
                out[rows] = np.searchsorted(own[int(k)], v[rows], side="left")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], [*b.schema.names, name])

    return df.mapInArrow(place, T.StructType([*df.schema.fields, T.StructField(name, T.IntegerType())]))


def running(df: DataFrame, keys: list[str], value: str, sums: list[str]) -> DataFrame:
    """``df`` with, within ``keys`` and in the order of ``value`` (distinct there, not null): cum_<s> up to and with a row, all_<s>, and the ``next`` value.

    Rows are dealt to ranges of ``value``, summed there, and moved by the totals of the ranges before: no task orders a whole key. ``FEW_ROWS`` rows or
    fewer are ordered by key as they are.
    """
    df = settle(df, "running")
    if df.count() <= FEW_ROWS:
        order, whole = Window.partitionBy(*keys).orderBy(value), Window.partitionBy(*keys)
        inside = order.rowsBetween(Window.unboundedPreceding, 0)
        return df.select(*df.columns, *(F.sum(s).over(inside).alias(f"cum_{s}") for s in sums), *(F.sum(s).over(whole).alias(f"all_{s}") for s in sums), F.lead(value).over(order).alias("next"))
    parts = min(512, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = bucketed(df, value, _edges(df, value, parts), "__bucket")
    totals = dealt.groupBy(*keys, "__bucket").agg(*(F.sum(s).alias(f"__{s}") for s in sums), F.min(value).alias("__low"))
    by_bucket, whole = Window.partitionBy(*keys).orderBy("__bucket"), Window.partitionBy(*keys)  # a row for each range
    before = by_bucket.rowsBetween(Window.unboundedPreceding, -1)
    moved = totals.select(*keys, "__bucket", *(F.coalesce(F.sum(f"__{s}").over(before), F.lit(0)).alias(f"__before_{s}") for s in sums), *(F.sum(f"__{s}").over(whole).alias(f"all_{s}") for s in sums), F.lead("__low").over(by_bucket).alias("__after"))
    joined = dealt.join(moved, [*keys, "__bucket"])
    order = Window.partitionBy(*keys, "__bucket").orderBy(value)
    inside = order.rowsBetween(Window.unboundedPreceding, 0)
    cum = [(F.col(f"__before_{s}") + F.sum(s).over(inside)).alias(f"cum_{s}") for s in sums]
    return joined.select(*df.columns, *cum, *(f"all_{s}" for s in sums), F.coalesce(F.lead(value).over(order), F.col("__after")).alias("next"))


def hash_rank(df: DataFrame, keys: list[str], seed: int, *names: str) -> DataFrame:
    """``df`` with ``rank``: 1, 2, ... within ``keys``, in the order of the MD5 of ``seed`` and the columns ``names``, joined by colons.

    The order is cut at the hash's first digits, so that ranks are counts of the ranges before and places in a range.
    """
    df = df.withColumn("__h", F.md5(F.concat_ws(":", F.lit(seed), *names)))
    parts = min(4096, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.withColumn("__bucket", F.floor(F.conv(F.substring("__h", 1, 3), 16, 10).cast("int") * parts / 4096))
    counts = dealt.groupBy(*keys, "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    moved = counts.select(*keys, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy(*keys, "__bucket").orderBy("__h", *names))
    return dealt.join(moved, [*keys, "__bucket"]).withColumn("rank", F.col("__before") + place).drop("__h", "__bucket", "__before")


def cumulated(a: DataFrame, b: DataFrame, value: str = "d") -> DataFrame:
    """(v, fa, fb, n, m, next): both empirical distribution functions at each distinct value of either, right-continuous, and the next value."""
    tag = lambda df, n: df.select(F.col(value).cast("double").alias("v"), F.lit(n).alias("of")).filter("v is not null")
    by_value = tag(a, 1).unionByName(tag(b, 2)).groupBy("v").agg(F.count_if(F.col("of") == 1).alias("na"), F.count_if(F.col("of") == 2).alias("nb"))
    return running(by_value, [], "v", ["na", "nb"]).select("v", (F.col("cum_na") / F.col("all_na")).alias("fa"), (F.col("cum_nb") / F.col("all_nb")).alias("fb"), F.col("all_na").alias("n"), F.col("all_nb").alias("m"), "next")


def wasserstein(a: DataFrame, b: DataFrame, value: str = "d") -> DataFrame:
    """One row (w): the area between both distribution functions."""
    return cumulated(a, b, value).agg(F.coalesce(F.sum(F.abs(F.col("fa") - F.col("fb")) * (F.col("next") - F.col("v"))), F.lit(0.0)).alias("w"))


def ks_greater(a: DataFrame, b: DataFrame, value: str = "d") -> DataFrame:
    """One row (d_plus, p_value, n, m): the one-sided statistic max(Fa - Fb) with its asymptotic p-value."""
    found = cumulated(a, b, value).agg(F.greatest(F.max(F.col("fa") - F.col("fb")), F.lit(0.0)).alias("d_plus"), F.max("n").alias("n"), F.max("m").alias("m"))
    return found.select("d_plus", F.exp(F.lit(-2.0) * F.col("d_plus") * F.col("d_plus") * (F.col("n") * F.col("m") / (F.col("n") + F.col("m")))).alias("p_value"), "n", "m")


def ecdf_grid(curves: DataFrame, points: int = 200) -> DataFrame:
    """(curve, r, f): each curve's distribution function at ``points`` even steps from 0 to the largest value of any.

    ``curves`` holds (curve, d). Values are counted into the first step that reaches them, and the counts are summed along the grid.
    """
    top = curves.agg(F.max("d").cast("double").alias("top"))
    placed = curves.filter("d is not null").crossJoin(F.broadcast(top)).withColumn("k", F.when(F.col("top") == 0, 0).otherwise(F.ceil(F.round(F.col("d") / F.col("top") * (points - 1), 9))).cast("int"))
    counts = placed.groupBy("curve", "k").agg(F.count("*").alias("n"))
    grid = counts.select("curve").distinct().crossJoin(F.broadcast(top)).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    running = Window.partitionBy("curve").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    filled = grid.join(counts, ["curve", "k"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return filled.select("curve", (F.col("k") * F.col("top") / (points - 1)).alias("r"), (F.sum("n").over(running) / F.sum("n").over(Window.partitionBy("curve"))).alias("f"))
