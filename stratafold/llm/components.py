"""Connected components by alternating large-star and small-star rounds.

Minima are partial aggregates and the joins that carry them back are plain equi-joins, which adaptive
execution splits on hot keys, so a component that holds most of the nodes is not gathered in one task.
``FEW_LINKS`` links or fewer are joined up on the driver instead, with the same result: each round would write a table.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.llm.common import settle

FEW_LINKS = 100_000


def forest(n: int, links: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest position linked to each, for links that come in blocks; memory stays with n and one block."""
    root = np.arange(n)
    for a, b in links:
        while True:
            ra, rb = root[a], root[b]
            if len(open_ := np.flatnonzero(ra != rb)) == 0:
                break
            a, b = a[open_], b[open_]
            ra, rb = ra[open_], rb[open_]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while not np.array_equal(jump := root[root], root):
                root = jump
    return root


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")


def _large_star(edges: DataFrame) -> DataFrame:
    both = _both(edges)
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    hung = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.select("a", F.col("m").alias("b")))


def _on_driver(edges: DataFrame) -> DataFrame:
    found = edges.toArrow()
    nodes, at = np.unique(np.concatenate([found[c].to_numpy() for c in "ab"]), return_inverse=True)
    root = nodes[forest(len(nodes), [(at[: len(found)], at[len(found) :])])]
    return edges.sparkSession.createDataFrame(pa.table({"node": pa.array(nodes, pa.int64()), "root": pa.array(root, pa.int64())}))


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root) for each node that has an edge to another; root is the smallest node of its component.

    Self-edges and rows with a null end link nothing. Repeated edges count once. No edges give no rows.
    ``edges`` (longs) is read twice. Rounds grow with the logarithm of the longest path.
    """
    now = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).filter("a <> b")
    if now.count() <= FEW_LINKS:
        return _on_driver(now)
    now, before = settle(now.distinct(), "links"), None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if not seen[0] or seen == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        before = seen
        now = settle(_small_star(_large_star(now)).filter("a <> b").distinct(), "links")
