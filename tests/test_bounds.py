"""Work and memory that grow no faster than the input, with the results of brute force."""

import numpy as np
import pytest

from stratafold.functions import geometry
from stratafold.operators import nn


def _great_circle(a, b):
    la, lb = np.radians(a[:, 1])[:, None], np.radians(b[:, 1])[None]
    h = np.sin((lb - la) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin(np.radians(b[:, 0][None] - a[:, 0][:, None]) / 2) ** 2
    return 2 * geometry.EARTH_RADIUS * np.arcsin(np.sqrt(np.minimum(h, 1)))


@pytest.mark.parametrize("longlat", [False, True])
@pytest.mark.parametrize("rule", ["id", "blocks", "mixed", "far", "none"])
def test_nearest_compares_few_references(monkeypatch, rule, longlat):
    rng, met = np.random.default_rng(2), []
    best = nn._best
    monkeypatch.setattr(nn, "_best", lambda q, r, *a: met.append(len(q[0]) * len(r[0])) or best(q, r, *a))
    n = 6000
    place = np.unique(np.floor(rng.random((n, 2)) ** 2 * 1000), axis=0) / (20 if longlat else 1)
    n, (x, y) = len(place), place.T
    ids = np.arange(n)
    key = {"id": ids, "blocks": (x > x.mean()) * 2 + (y > y.mean()), "mixed": rng.integers(0, 3, n)}.get(rule, np.zeros(n, int)).astype(np.int64)
    beyond = rng.integers(0, 3, n) * (1000.0 if longlat else 5.0) if rule == "far" else np.full(n, -1.0)
    differ = rule in ("id", "blocks", "mixed")
    leaves = nn._leaves([x, y, key, ids, ids], differ, longlat, nn.LOCAL_TILE)
    d, _ = nn._seek([x, y, key, beyond], leaves, differ)
    all_pairs = _great_circle(place, place) if longlat else np.sqrt(((place[:, None] - place[None]) ** 2).sum(2))
    all_pairs[all_pairs <= beyond[:, None]] = np.inf
    if differ:
        all_pairs[key[:, None] == key[None]] = np.inf
    assert np.allclose(d, all_pairs.min(1), rtol=1e-9, atol=1e-6)
    assert sum(met) < 1000 * n


def test_equal_features_are_compared_once(spark, monkeypatch):
    rows = [(i, float(i % 7), float(i % 3), i % 4) for i in range(400)] + [(400, 50.0, 1.0, 0)]
    df = spark.createDataFrame(rows, "id long, a double, b double, fold int").selectExpr("id", "fold", "array(a, b) as features")
    for kind, norm in (("L1", lambda a, b: abs(a[1] - b[1]) + abs(a[2] - b[2])), ("L2", lambda a, b: ((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) ** 0.5)):
        for differ, at in (("id", 0), ("fold", 3)):
            got = {r["id"]: r["d"] for r in nn.in_features(df, df, differ, kind=kind).collect()}
            assert got == {a[0]: pytest.approx(min(norm(a, b) for b in rows if a[at] != b[at])) for a in rows}
    settled, settle = {}, nn.settle
    monkeypatch.setattr(nn, "settle", lambda d, name: settled.setdefault(name, settle(d, name)))
    nn.in_features(df, df, "id")
    assert {n: d.count() for n, d in settled.items()} == {"features-of-references": 22, "features-of-queries": 22}


def test_feature_block_is_exact():
    import pandas as pd

    rng = np.random.default_rng(4)
    a, b = rng.normal(1000, 1, (300, 20)), rng.normal(1000, 1, (200, 20))
    b[7] = a[5] + 1e-9
    q = pd.DataFrame({"q": range(300), "group": 0, "key": rng.integers(0, 3, 300), "features": list(a)})
    r = pd.DataFrame({"r": range(200), "group": 0, "key": rng.integers(0, 3, 200), "features": list(b), "several": False})
    want = ((a[:, None] - b[None]) ** 2).sum(2)
    want[q["key"].to_numpy()[:, None] == r["key"].to_numpy()[None]] = np.inf
    got = nn._feature_block(q, r, "L2", True)["t"].to_numpy()
    assert np.allclose(got, want.min(1), rtol=1e-12)


@pytest.mark.parametrize("longlat", [False, True])
def test_buffer_records_are_counts(spark, longlat):
    from stratafold.operators import folds
    from stratafold.sources import points as P

    rng = np.random.default_rng(8)
    rows = [(i, float(a), float(b), int(o)) for i, (a, b, o) in enumerate(zip(rng.integers(0, 40, 300), rng.integers(0, 40, 300), rng.integers(0, 2, 300), strict=True))]
    x = P.Points(spark.createDataFrame(rows, "id long, x double, y double, occ int"), "geographic" if longlat else "plane", longlat)
    at = np.array([r[1:3] for r in rows])
    near = (_great_circle(at, at) if longlat else np.sqrt(((at[:, None] - at[None]) ** 2).sum(2))) <= (700_000 if longlat else 10)
    occ = np.array([r[3] for r in rows])
    for add_bg in (False, True):
        f = folds.buffer(x, 700_000 if longlat else 10, "occ", presence_bg=True, add_bg=add_bg)
        got = {r["fold"]: tuple(r[c] for c in ("train_0", "train_1", "test_0", "test_1")) for r in f.records.collect()}
        bg = near[:, occ == 0].sum(1)
        assert got == {i: (int((occ == 0).sum() - bg[i]), int((~near[i] & (occ == 1)).sum()), int(bg[i]) * add_bg, 1) for i in range(300) if occ[i]}
        assert "Generate explode" not in f.records._jdf.queryExecution().optimizedPlan().toString()  # no cells meet, so no pairs
        kept = f.folds_list().filter("role = 'train'").collect()
        assert {(r["fold"], r["id"]) for r in kept} == {(i, j) for i in range(300) if occ[i] for j in range(300) if not near[i, j]}
        shown = {(r["fold"], r["id"]): r["role"] for r in folds.to_long(f).collect()}
        first = [i for i in range(300) if occ[i]][:10]
        assert shown == {(i, j): 0 if i == j or (add_bg and near[i, j] and not occ[j]) else None if near[i, j] else 1 for i in first for j in range(300)}


def test_near_gives_the_sorted_distances():
    from stratafold.operators import local

    rng = np.random.default_rng(6)
    for longlat in (False, True):
        xy = np.concatenate([rng.integers(0, 60, (700, 2)), np.full((40, 2), 7)]).astype(float)
        near, want = local.Near(xy, longlat), local.sorted_distances(xy, longlat)
        got = np.array([[near[i, k] for k in (0, 1, 5, 60, 738)] for i in range(len(xy))])
        assert near.shape == want.shape and np.allclose(got, want[:, [0, 1, 5, 60, 738]], rtol=1e-12, atol=1e-6 if longlat else 1e-12)


def test_ward_by_centres_is_ward_by_matrix():
    from stratafold.operators import local

    points = np.random.default_rng(9).normal(size=(400, 3))
    a, b = (sorted(f(points)) for f in (local._matrix_merges, local._centre_merges))
    assert [m[1:] for m in a] == [m[1:] for m in b] and np.allclose([m[0] for m in a], [m[0] for m in b])
    assert len(set(local.ward(np.random.default_rng(1).normal(size=(local.WARD_MATRIX + 1, 2)), [7])[7].tolist())) == 7


def test_left_out_similarity_makes_no_pairs(spark, monkeypatch):
    """Leave-one-out L1 and MESS against brute force, with the pairs within the buffer out of reach."""
    from stratafold.operators import diagnose, folds
    from stratafold.sources import points as P

    rng = np.random.default_rng(12)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.random((80, 2)) * 10)]
    x = P.Points(spark.createDataFrame(rows, "id long, x double, y double"), "plane")
    grid = [(r, c, float((r * 7 + c * 3) % 11), float(r - c)) for r in range(10) for c in range(10)]
    raster = P.Raster(spark.createDataFrame(grid, "row int, col int, u double, v double"), 0.0, 10.0, 1.0, 1.0, 10, 10, "plane")
    f = folds.buffer(x, 4.0)
    f.extra["held"] = None
    cells = np.array([g[2:] for g in grid])
    z = (cells - cells.mean(0)) / cells.std(0, ddof=1)
    of = [int(10.0 - b) * 10 + int(a) for _, a, b in rows]
    apart = np.sqrt(((np.array(rows)[:, None, 1:] - np.array(rows)[None, :, 1:]) ** 2).sum(2)) > 4
    got = {r["id"]: r["value"] for r in diagnose.similarity(f, raster, "L1")["values"].collect()}
    gap = np.abs(z[:, None] - z[of][None]).sum(2)
    for i in range(80):
        pool = apart[i] | (np.arange(80) == i)
        assert got[i] == pytest.approx(gap[:, pool].min(1).mean() - np.abs(z[of][i] - z[of][apart[i]]).sum(1).min())
    assert len(diagnose.similarity(f, raster)["values"].collect()) == 80


def test_starts_share_their_passes(spark):
    from stratafold.operators import cluster

    rng = np.random.default_rng(3)
    points = np.concatenate([rng.normal(c, 0.1, (50, 2)) for c in ((0, 0), (5, 0), (0, 5))])
    df = spark.createDataFrame([(p.tolist(),) for p in points], "features array<double>")
    got = sorted(np.round(cluster.lloyd(df, 3, 8), 6).tolist())
    assert np.allclose(got, sorted(np.round([points[i : i + 50].mean(0) for i in (0, 50, 100)], 6).tolist()), atol=1e-3)
    assert len(cluster.lloyd(df.limit(1), 3, 2)) == 1


@pytest.mark.parametrize("longlat", [False, True])
def test_labels_apart(longlat):
    from stratafold.operators import labels

    rng = np.random.default_rng(3)
    for n in (1, 9, 700):
        x, y, label = rng.integers(0, 40, n) / 2.0, rng.integers(0, 40, n) / 2.0, rng.integers(-1, 4, n)
        for given in (label, (x > 10) + 2 * (y > 10)):
            t = labels.tree(x, y, longlat)
            found, real = np.full(n, np.nan), t.row >= 0
            found[t.row[real]] = labels.apart(t, given[np.maximum(t.row, 0)])[real]
            want = nn._apart(x[:, None], y[:, None], x[None], y[None], longlat)
            want[(given[:, None] == given[None]) | (given[None] < 0) | (given[:, None] < 0)] = np.inf
            np.testing.assert_allclose(found, want.min(1), rtol=1e-12)


def test_block_candidates_make_no_rows(spark, monkeypatch):
    from stratafold.functions.stats import wasserstein
    from stratafold.operators import diagnose, labels, matching
    from stratafold.plans import catalogue

    d = "/root/testdata/sf0.01"
    x, pred = catalogue.clustered(spark, d), catalogue.suppliers(spark, d)
    monkeypatch.setattr(matching, "nearest_apart", None)  # rows for each candidate would fail
    found = matching.knndm(x, pred, "occ", k=4, nk_len=12)
    monkeypatch.undo()
    monkeypatch.setattr(labels, "MAX_PLACES", 0)
    want = matching.knndm(x, pred, "occ", k=4, nk_len=12)
    assert found.params["candidate"] == want.params["candidate"] and found.params["w"] == pytest.approx(want.params["w"], abs=1e-9)
    assert sorted(found.table.collect()) == sorted(want.table.collect())
    near = diagnose.test_to_train(found, x.df.select("id", "x", "y"))
    assert wasserstein(near, found.extra["gij"]).first()["w"] == pytest.approx(found.params["w"], abs=1e-6)


def test_random_draws_have_no_search_of_rows(spark, monkeypatch):
    from stratafold.operators import diagnose

    points = spark.createDataFrame([(i, float(i * 7 % 31), float(i * 11 % 37)) for i in range(300)], "id long, x double, y double")
    folded = diagnose.random_folds(points, 3, 4).withColumnRenamed("draw", "candidate")
    want = sorted(nn.nearest(folded.join(points, "id"), folded.join(points, "id"), "fold", "candidate").select("candidate", "id", "d").collect())
    monkeypatch.setattr(nn, "nearest", None)
    assert sorted(diagnose.nearest_apart(folded, points).collect()) == want


@pytest.mark.parametrize("cutoff", [7.0, 23.5, 90.0])
def test_variogram_of_a_lattice_looks_at_no_pair(spark, monkeypatch, cutoff):
    from stratafold.operators import scale
    from stratafold.sources.points import Points

    rng = np.random.default_rng(6)
    rows = [(i, float(a - 20), float(b + 5), None if i % 9 == 0 else float(v) + 5000, i % 2) for i, (a, b, v) in enumerate(zip(rng.integers(0, 50, 600), rng.integers(0, 70, 600), rng.integers(0, 10**6, 600) / 100, strict=True))]
    x = Points(spark.createDataFrame(rows, "id long, x double, y double, v double, w int"), "local plane")
    want = sorted(scale.variograms(x, ["v", "w"], cutoff).collect())
    monkeypatch.setattr(scale, "PAIRS_A_CELL", 0)
    monkeypatch.setattr(scale, "SLAB_CELLS", 1000)
    monkeypatch.setattr(scale, "_pair_bins", None)
    found = sorted(scale.variograms(x, ["v", "w"], cutoff).collect())
    assert [r[:3] for r in found] == [r[:3] for r in want]
    np.testing.assert_allclose([r[3:] for r in found], [r[3:] for r in want], rtol=1e-10)
