import zlib

import numpy as np

from stratafold.llm import quality


def test_isotonic_is_the_nearest_rising_fit():
    rng = np.random.default_rng(0)
    for n in range(1, 30):
        count, rate = rng.integers(1, 9, n).astype(float), rng.random(n)
        got = quality.isotonic(np.arange(n), count, count * rate)
        # max-min formula
        want = [max(min((count[a : b + 1] * rate[a : b + 1]).sum() / count[a : b + 1].sum() for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        assert np.allclose(got, want)


def test_kernel():
    m = quality.Model(np.zeros(len(quality.NAMES)), np.ones(len(quality.NAMES)))
    x = np.random.default_rng(1).normal(size=(20, len(quality.NAMES))) * 2
    z = m.features(x)[:, :-1]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * quality.WIDTH**2))
    assert np.abs(z @ z.T - want).max() < 0.25


def test_sums_and_held_out_accuracy(spark, tables):
    docs, labels = tables["documents"], tables["labels"]
    stats = quality.statistics(docs).cache()
    rows = stats.join(labels.select("doc_id", "quality"), "doc_id").repartition(9)
    model = quality.Model(np.zeros(len(quality.NAMES)), np.ones(len(quality.NAMES)))
    local = rows.toPandas()
    z = model.features(np.array(local["stats"].tolist(), float))
    old, quality.TREE = quality.TREE, 2
    try:
        got = quality.normal_equations(rows, model)
    finally:
        quality.TREE = old
    assert np.allclose(got, z.T @ np.column_stack([z, local["quality"]]))
    out = quality.classify(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")).toPandas()
    truth = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas().set_index("doc_id")["quality"]
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]).all()
    assert out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.3)).all()
    held = out[out.held_out & out.doc_id.isin(truth.index)]
    assert (held.predicted == truth[held.doc_id].to_numpy()).mean() > 0.95


def test_edges(spark, tables):
    rows = [(1, None, 5), (2, "", 5), (2, "", 5), (3, "w " * 20000, 5), (None, "a b", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = quality.classify(docs, none).collect()
    assert len(out) == 5 and {r["score"] for r in out} == {0.5}
    assert quality.keep(docs, none).columns == docs.columns and quality.keep(docs, none).count() == 5
    assert quality.classify(docs.limit(0), tables["labels"]).count() == 0
