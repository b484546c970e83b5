"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Statistics are scaled by the training rows' mean and deviation, mapped to cosines of random projections, whose inner products
approach a Gaussian kernel, and weighted by ridge regression. Its normal equations are sums over rows: each partition
adds up its own, and the sums meet in a tree. A fold of the training rows is kept out of the sums and calibrates the ridge scores by
pool-adjacent-violators over their histogram. All labelled training rows count; what reaches the driver is of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.llm.common import batch, fold, settle, sized, texts, utf8
from stratafold.llm.docstats import NAMES, document_stats

FEATURES = 256
WIDTH = 6.0  # of the Gaussian kernel, in deviations
RIDGE = 1e-3  # a row
SEED = 20
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 1
THRESHOLD = 0.3
BINS = 512
TREE = 64

_STATS = pa.schema([("doc_id", pa.int64()), ("stats", pa.list_(pa.float32()))])


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sized(batches, "text"):
        yield batch({"doc_id": b["doc_id"], "stats": [document_stats(x) for x in utf8(b["text"])]}, _STATS)


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats): the document statistics of whole texts; those of empty and null texts are zeros."""
    return texts(docs).mapInArrow(_stats, "doc_id long, stats array<float>")


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(float)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None = None
    edges: np.ndarray | None = None  # isotonic: ridge scores and their calibrated values
    values: np.ndarray | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        w, shift = rng.normal(size=(len(NAMES), FEATURES)) / WIDTH, rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.column_stack([np.cos(z @ w + shift) * np.sqrt(2 / FEATURES), np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights if self.weights is not None else np.full(len(x), 0.5)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated, in [0, 1]; a thousandth follows the ridge score, so that it orders rows inside a calibrated step."""
        raw = np.clip(self.raw(x), 0, 1)
        if self.values is None:
            return raw
        return np.clip(0.999 * np.interp(raw, self.edges, self.values) + 0.001 * raw, 0, 1)


def _sums(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    total = np.zeros((FEATURES + 1, FEATURES + 2))
    for b in batches:
        z, y = model.features(matrix(b["stats"])), b["quality"].to_numpy(zero_copy_only=False)
        total += z.T @ np.column_stack([z, y])
    yield batch({"slot": [TaskContext.get().partitionId()], "sums": [total.tobytes()]}, pa.schema([("slot", pa.int64()), ("sums", pa.binary())]))


def _add(rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py()) for x in rows["sums"])
    return pa.table({"slot": rows["slot"][:1], "sums": pa.array([total.tobytes()], pa.binary())})


def normal_equations(rows: DataFrame, model: Model) -> np.ndarray:
    """Sums over (stats, quality) rows, a matrix per partition, ``TREE`` of them at a time."""
    sums = rows.mapInArrow(partial(_sums, model=model), "slot long, sums binary")
    parts = rows.rdd.getNumPartitions()
    while parts > TREE:
        parts = -(-parts // TREE)
        sums = sums.withColumn("slot", F.col("slot") % parts).groupBy("slot").applyInArrow(lambda t: _add(t), "slot long, sums binary")
    return sum((np.frombuffer(bytes(r["sums"])) for r in sums.toLocalIterator()), np.zeros((FEATURES + 1) * (FEATURES + 2))).reshape(FEATURES + 1, FEATURES + 2)


def isotonic(at: np.ndarray, n: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the rising values nearest to ``ones / n`` with weights ``n``, for rising ``at``."""
    blocks: list[list[float]] = []
    for count, one in zip(n.tolist(), ones.tolist(), strict=True):
        blocks.append([count, one, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            count, one, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + count, blocks[-1][1] + one, blocks[-1][2] + k]
    return np.concatenate([np.full(int(k), one / count) for count, one, k in blocks]) if blocks else at[:0]


def _raw(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw = np.clip(model.raw(matrix(b["stats"])), 0, 1)
        yield batch({"bin": np.minimum((raw * BINS).astype(int), BINS - 1), "quality": b["quality"]}, pa.schema([("bin", pa.int32()), ("quality", pa.int32())]))


def train(stats: DataFrame, labels: DataFrame) -> Model:
    """A model of quality from ``stats`` and all labels outside the held-out fold; without both classes it scores 0.5."""
    known = labels.filter("quality in (0, 1) and doc_id is not null").filter(fold("doc_id", FOLDS) != HELD_OUT).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    rows = settle(stats.join(known, "doc_id").withColumn("part", fold("doc_id", FOLDS)), "labelled")
    cells = [f(F.col("stats")[k].cast("double")) for k in range(len(NAMES)) for f in (F.avg, F.stddev_pop)]
    seen = list(rows.agg(F.min("quality"), F.max("quality"), *cells).first())
    moments = np.array([x if x is not None else 0.0 for x in seen[2:]]).reshape(-1, 2)
    model = Model(moments[:, 0], np.where(moments[:, 1] > 1e-9, moments[:, 1], 1.0))
    if seen[0] == seen[1]:
        return model
    sums = normal_equations(rows.filter(F.col("part") != CALIBRATION), model)
    n = max(1.0, sums[-1, -2])
    model.weights = np.linalg.solve(sums[:, :-1] / n + RIDGE * np.eye(FEATURES + 1), sums[:, -1] / n)
    bins = rows.filter(F.col("part") == CALIBRATION).mapInArrow(partial(_raw, model=model), "bin int, quality int").groupBy("bin").agg(F.count("*").alias("n"), F.sum("quality").alias("ones")).orderBy("bin").collect()
    if bins:
        at, count, ones = (np.array(x, float) for x in zip(*bins, strict=True))
        model.edges, model.values = (at + 0.5) / BINS, isotonic(at, count, ones)
    return model


OUT = "doc_id long, held_out boolean, score double, predicted int"
_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            score = model.score(matrix(b["stats"]))
            yield batch({"doc_id": b["doc_id"], "held_out": b["held_out"], "score": score, "predicted": score >= THRESHOLD}, _OUT.set(3, pa.field("predicted", pa.bool_()))).cast(_OUT)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs``; labels of the held-out fold are never read."""
    stats = settle(statistics(docs), "statistics")
    model = train(stats, labels)
    return stats.withColumn("held_out", fold("doc_id", FOLDS) == HELD_OUT).mapInArrow(partial(_score, model=model), OUT)


def _keep(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for b in sized(batches, "text"):
        x = np.array([document_stats(t) for t in utf8(b["text"])], np.float32).astype(float)
        yield b.filter(pa.array(model.score(x) >= THRESHOLD))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are predicted to be of quality, with all their columns."""
    known = labels.filter("quality in (0, 1)").select("doc_id", "quality")
    return docs.mapInArrow(partial(_keep, model=train(settle(statistics(docs), "statistics"), known)), docs.schema)
