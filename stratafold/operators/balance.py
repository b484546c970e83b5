"""Assignment of pieces (blocks, groups, clusters) to folds by a seeded search for the most even one.

The search is one query. Points are first counted to (piece, class), after which their number no longer matters; the iterations are a key. Each
iteration deals the pieces by the order of a hash, is scored, and the smallest score of the earliest iteration wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def candidates(pieces: DataFrame, n: int, k: int, iterations: int, seed: int = 0) -> DataFrame:
    """(iter, piece, fold) for ``pieces`` numbered 1 to n: whole rounds are dealt evenly, each piece of the rest gets a fold of its own."""
    spark = pieces.sparkSession
    iters = spark.range(1, iterations + 1).select(F.col("id").cast("int").alias("iter"))
    full = n // k * k
    dealt = pieces.select("piece").crossJoin(F.broadcast(iters)).withColumn("h", F.md5(F.concat_ws(":", F.lit(seed), "iter", "piece")))
    by = Window.partitionBy("iter").orderBy("h")
    even = dealt.filter(F.col("piece") <= full).select("iter", "piece", ((F.row_number().over(by) - 1) % k + 1).cast("int").alias("fold"))
    if full == n:
        return even
    rest = dealt.filter(F.col("piece") > full).select("iter", "piece", (F.col("piece") - full).cast("int").alias("rank"))
    folds = spark.range(1, k + 1).select(F.col("id").cast("int").alias("fold")).crossJoin(iters).withColumn("h", F.md5(F.concat_ws(":", F.lit(seed), "iter", F.lit("f"), "fold")))
    order = folds.select("iter", "fold", F.row_number().over(by).alias("rank"))
    return even.unionByName(rest.join(order, ["iter", "rank"]).select("iter", "piece", "fold"))


def scores(assigned: DataFrame, counts: DataFrame, classes: list[str], k: int, presence_only: bool = False) -> DataFrame:
    """(iter, empty, imbalance) of (iter, piece, fold) with (piece, cls, n); ``presence_only`` looks at class 1 alone.

    empty: test cells without a record, over classes with k records or more. imbalance: sum of (test - n / k) squared over n / k.
    """
    seen = [c for c in classes if c == "1"] if presence_only else classes
    spark = assigned.sparkSession
    own = counts.filter(F.col("cls").isin(seen)) if classes else counts.withColumn("cls", F.lit("all"))
    cells = assigned.join(own, "piece").groupBy("iter", "fold", "cls").agg(F.sum("n").alias("t"))
    totals = own.groupBy("cls").agg(F.sum("n").alias("total")).filter("total > 0")
    folds = spark.range(1, k + 1).select(F.col("id").cast("int").alias("fold"))
    grid = assigned.select("iter").distinct().crossJoin(F.broadcast(folds)).crossJoin(F.broadcast(totals))
    full = grid.join(cells, ["iter", "fold", "cls"], "left").withColumn("t", F.coalesce("t", F.lit(0)))
    fair = F.col("total") / k
    return full.groupBy("iter").agg(F.count_if((F.col("t") == 0) & (F.col("total") >= k)).alias("empty"), F.sum((F.col("t") - fair) * (F.col("t") - fair) / fair).alias("imbalance"))


def best(scored: DataFrame) -> DataFrame:
    """The row with fewest empty cells, then least imbalance, then the earliest iteration."""
    one = scored.agg(F.min(F.struct("empty", F.round("imbalance", 9).alias("imbalance"), "iter")).alias("b"))
    return one.select("b.empty", "b.imbalance", "b.iter")


def balanced(points: DataFrame, piece: str, classes: list[str], k: int, iterations: int, seed: int = 0, presence_only: bool = False, n: int | None = None) -> DataFrame:
    """(piece, fold) of the best of ``iterations`` assignments; ``points`` holds (piece, cls), pieces numbered from 1 without gaps."""
    counts = points.groupBy(F.col(piece).alias("piece"), "cls").agg(F.count("*").alias("n"))
    pieces = counts.select("piece").distinct()
    n = pieces.count() if n is None else n
    assigned = candidates(pieces, n, k, iterations, seed)
    if iterations == 1:
        return assigned.select("piece", "fold")
    winner = best(scores(assigned, counts, classes, k, presence_only))
    return assigned.join(F.broadcast(winner.select("iter")), "iter").select("piece", "fold")
