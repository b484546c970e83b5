"""k-means folds, in space or over covariates."""

from __future__ import annotations

import warnings

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.operators import balance
from stratafold.operators.folds import Folds, _kfold
from stratafold.operators.response import response
from stratafold.sources import points as P
from stratafold.state import settle


def scales(df: DataFrame, names: list[str]) -> dict[str, tuple[float, float]]:
    """(mean, deviation) of columns; a deviation of zero or null counts as none."""
    r = df.agg(*(f(F.col(n).cast("double")) for n in names for f in (F.avg, F.stddev_samp))).first()
    return {n: (r[2 * i] or 0.0, r[2 * i + 1] or 0.0) for i, n in enumerate(names)}


def standard(name: str, scale: dict[str, tuple[float, float]], unit: bool = False) -> Column:
    """z-score; a column without variance is zero, or only centred with ``unit``."""
    mean, sd = scale[name]
    centred = F.col(name).cast("double") - F.lit(mean)
    return centred / F.lit(sd) if sd > 0 else (centred if unit else F.lit(0.0))


def features(df: DataFrame, bands: list[str], scale: dict[str, tuple[float, float]] | None, xy: dict[str, tuple[float, float]] | None, weight: float = 0.0) -> Column:
    """An array: the bands, and with a weight the standardised place, so that squared distance is (1 - w) env / p + w geo / 2."""
    env = [standard(b, scale) if scale else F.col(b).cast("double") for b in bands]
    if not weight:
        return F.array(*env)
    e, g = ((1 - weight) / len(bands)) ** 0.5, (weight / 2) ** 0.5
    return F.array(*(c * F.lit(e) for c in env), *(standard(n, xy) * F.lit(g) for n in ("x", "y")))


def kmeans(train: DataFrame, k: int, starts: int = 25, steps: int = 500, seed: int = 0):
    """The model of least cost over ``starts`` seeds; ``train`` holds a vector column ``features``."""
    train = train.persist()
    try:
        models = [KMeans(k=k, maxIter=steps, seed=seed + s, initMode="k-means||").fit(train) for s in range(starts)]
    finally:
        train.unpersist()
    return min(models, key=lambda m: m.summary.trainingCost)


def lloyd(train: DataFrame, k: int, starts: int = 25, steps: int = 500, seed: int = 0, tol: float = 1e-4) -> list[list[float]]:
    """The centres of least cost over ``starts`` seeds, each begun at ``k`` different rows of ``train`` (an array column ``features``), or as many as there are.

    All starts share a pass over the rows for each step, until no centre of theirs moves by more than ``tol``. Rows are packed once, in blocks of numbers.
    """
    drawn = train.select("features").distinct().orderBy(F.xxhash64(F.lit(seed), "features"), "features").limit(2 * k * starts)
    first = np.array([r[0] for r in drawn.collect()], float)
    k = min(k, len(first))
    dim, rng = first.shape[1], np.random.default_rng(seed)
    centres = np.stack([first[rng.permutation(len(first))[:k]] for _ in range(starts)])

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"block": [np.array(b["features"].to_list(), float).tobytes()]})

    def turn(batches: Iterator[pd.DataFrame], at: np.ndarray) -> Iterator[pd.DataFrame]:
        m = len(at)
        out, flat = np.zeros((m, k, dim + 2)), at.reshape(m * k, dim)
        square = (flat * flat).sum(1)
        for b in batches:
            for block in b["block"]:
                rows = np.frombuffer(block).reshape(-1, dim)
                for u in range(0, len(rows), 2000):
                    x = rows[u : u + 2000]
                    d = (square - 2 * (x @ flat.T)).reshape(len(x), m, k)
                    own = d.argmin(2) + np.arange(m) * k
                    cost = np.maximum(np.take_along_axis(d, (own - np.arange(m) * k)[:, :, None], 2)[:, :, 0] + (x * x).sum(1)[:, None], 0)
                    own, many = own.ravel(), m * k
                    for c in range(dim):
                        out[:, :, c] += np.bincount(own, np.repeat(x[:, c], m), many).reshape(m, k)
                    out[:, :, dim] += np.bincount(own, minlength=many).reshape(m, k)
                    out[:, :, dim + 1] += np.bincount(own, cost.ravel(), many).reshape(m, k)
        yield pd.DataFrame({"sums": [out.tobytes()]})

    blocks = train.select("features").repartition(train.sparkSession.sparkContext.defaultParallelism).mapInPandas(pack, "block binary").persist()
    try:
        pass_over = lambda at: sum(np.frombuffer(r[0]) for r in blocks.mapInPandas(lambda b: turn(b, at), "sums binary").collect()).reshape(len(at), k, dim + 2)
        moving = np.arange(starts)
        for _ in range(steps):
            sums = pass_over(centres[moving])
            n = sums[:, :, dim : dim + 1]
            new = np.where(n > 0, sums[:, :, :dim] / np.maximum(n, 1), centres[moving])
            moved = np.sqrt(((new - centres[moving]) ** 2).sum(2)).max(1) > tol
            centres[moving] = new
            moving = moving[moved]
            if not len(moving):
                break
        cost = pass_over(centres)[:, :, dim + 1].sum(1)
    finally:
        blocks.unpersist()
    return centres[int(cost.argmin())].tolist()


def assign(df: DataFrame, centres: list[list[float]]) -> DataFrame:
    """(id, cluster, d2): the nearest of a few given centres of ``features``; equal distances go to the first."""
    gaps = [F.struct(F.aggregate(F.zip_with("features", F.array(*(F.lit(float(v)) for v in c)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v).alias("d2"), F.lit(i + 1).alias("cluster")) for i, c in enumerate(centres)]
    return df.withColumn("best", F.array_min(F.array(*gaps))).select("id", F.col("best.cluster").alias("cluster"), F.col("best.d2").alias("d2"))


def cluster(
    x: P.Points, column: str | None = None, r: P.Raster | None = None, k: int = 5, scale: bool = True, raster_cluster: bool = False, num_sample: int = 10_000, spatial_weight: float = 0.0,
    balance_folds: bool = False, presence_bg: bool = False, k_multiplier: int = 5, iteration: object = 100, seed: int = 0, num_bins: int | None = 4, starts: int = 25, centres: list[list[float]] | None = None,
) -> Folds:
    """Folds by k-means: on places without ``r``, on its bands with it. The seed rules both clusters and search.

    With balance, min(k * k_multiplier, n) clusters are dealt to k folds by the search; without it each cluster is a fold, empty ones too. Given ``centres``, in the
    space that is clustered, are clusters as they are: points go to the nearest, and no search for centres is made.
    """
    column = P.check_column(x.df, column)
    P.presences(x.df, column, presence_bg)
    if r is None:
        if spatial_weight:
            warnings.warn("spatial_weight is used with a raster only", stacklevel=2)
        if x.longlat:
            warnings.warn("k-means on degrees is not a distance in metres", stacklevel=2)
        df = x.df.withColumn("features", F.array(F.col("x").cast("double"), F.col("y").cast("double")))
        train = df
    else:
        if not 0 <= spatial_weight <= 1:
            raise ValueError("spatial_weight is between 0 and 1")
        r.check_numeric()
        got = r.extract(x.df)
        if got.filter(" or ".join(f"`{b}` is null" for b in r.bands)).limit(1).count():
            raise ValueError("some points have no raster value")
        sample = r.random_sample(r.clamp(num_sample), seed) if raster_cluster else None
        env = scales(r.df.dropna(subset=r.bands), r.bands) if scale else None
        both = got.select("x", "y", *r.bands).unionByName(sample.select("x", "y", *r.bands)) if raster_cluster else got
        xy = scales(both, ["x", "y"]) if spatial_weight else None
        df = got.withColumn("features", features(got, r.bands, env, xy, spatial_weight))
        train = both.withColumn("features", features(both, r.bands, env, xy, spatial_weight)) if raster_cluster else df
    n = x.df.count()
    P.check_count(k, n)
    many = min(k * k_multiplier, n) if balance_folds else k
    if centres is not None:
        if len(centres) != many:
            raise ValueError(f"{many} centres are needed, not {len(centres)}")
        labels = assign(df.select("id", "features"), centres).select("id", "cluster")
    else:
        labels = assign(df.select("id", "features"), lloyd(train, many, starts, seed=seed)).select("id", "cluster")
    res = response(x.df, column, num_bins)
    own = {"column": column, "presence_bg": presence_bg}
    kind = "Environmental Cluster" if r is not None else "Spatial Cluster"
    if not balance_folds:
        return _kfold("cluster", x, labels.select("id", F.col("cluster").alias("fold")), res, k, {"type": kind, **own})
    labels = settle(labels, "clusters")
    used = labels.select("cluster").distinct().orderBy("cluster").collect()
    number = F.create_map(*(v for i, row in enumerate(used) for v in (F.lit(row[0]), F.lit(i + 1))))
    dense = labels.withColumn("piece", number[F.col("cluster")])
    won = balance.balanced(res.df.select("id", "cls").join(dense, "id"), "piece", res.classes, k, P.iterations(iteration), seed, presence_bg, len(used))
    return _kfold("cluster", x, dense.join(won, "piece").select("id", "fold"), res, k, {"type": kind, "clusters": len(used), **own})
