import itertools
import math
import warnings

import numpy as np
import pytest

from stratafold.functions import geometry, stats
from stratafold.operators import balance, cluster, diagnose, folds, local, matching, nn, scale
from stratafold.operators.response import check_num_bins, records, response
from stratafold.plans import catalogue
from stratafold.sources import points as P

DIR = "/root/testdata/sf0.001"


def plane(spark, rows, schema="id long, x double, y double, occ int"):
    return P.Points(spark.createDataFrame(rows, schema), "plane")


@pytest.fixture(scope="module")
def lattice(spark):
    return plane(spark, [(6 * (a - 1) + b, float(a), float(b), (6 * (a - 1) + b - 1) % 2) for a in range(1, 7) for b in range(1, 7)])


@pytest.fixture(scope="module")
def sites(spark):
    rows, n = [], 0
    for g, size in enumerate((2, 3, 4, 2, 5, 3), 1):
        for _ in range(size):
            n += 1
            rows.append((n, float(n), float(n % 5 + g), (n - 1) % 2, f"site_{g:02d}"))
    return plane(spark, rows, "id long, x double, y double, occ int, site string")


def brute_matching(d, gij, phi, least):
    """The state machine on a dense matrix."""
    n = len(d)
    x = d.copy()
    np.fill_diagonal(x, np.nan)
    near = np.nanmin(x, 1)
    r, i = near.min(), int(near.argmin())
    while r <= phi:
        share, below = (gij <= r).mean(), ((near <= r).sum() - 1) / n
        if below >= share and (~np.isnan(x[i])).sum() / n > least:
            x[i, int(np.nanargmin(x[i]))] = np.nan
            near[i] = np.nanmin(x[i]) if not np.isnan(x[i]).all() else np.inf
            ok = near >= r
        else:
            ok = near > r
            if not ok.any():
                break
        r = near[ok].min()
        i = int(np.flatnonzero(ok & (near == r))[0])
    return near


def test_matching_kernel():
    rng = np.random.default_rng(4)
    for n, phi, least in ((6, 3.0, 0.05), (25, 4.0, 0.05), (25, 50.0, 0.5), (40, 6.0, 0.9), (30, 2.0, 0.05)):
        p = rng.integers(0, 12, (n, 2)).astype(float) if n != 30 else rng.random((n, 2)) * 10
        g = rng.random((50, 2)) * 20
        d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
        gij = np.sqrt(((g[:, None] - p[None]) ** 2).sum(2)).min(1)
        got = local.match_distances(local.sorted_distances(p), *np.unique(gij, return_counts=True), phi, least)
        assert np.allclose(got, brute_matching(d, gij, phi, least))


def test_nndm_folds(spark, lattice):
    pred = spark.createDataFrame([(i, 0.35 * i, 7 - 0.3 * i) for i in range(20)], "id long, x double, y double")
    f = matching.nndm(lattice, pred, 2.0, "occ")
    x = {r["id"]: (r["x"], r["y"]) for r in lattice.df.collect()}
    ids = sorted(x)
    d = np.array([[math.dist(x[a], x[b]) for b in ids] for a in ids])
    gij = np.array([min(math.dist((r["x"], r["y"]), q) for q in x.values()) for r in pred.collect()])
    out = {r["fold"]: r["exclusion_distance"] for r in f.extra["exclusion"].collect()}
    assert np.allclose([out[i] for i in ids], brute_matching(d, gij, 2.0, 0.05))
    train = {}
    for r in f.folds_list().collect():
        train.setdefault(r["fold"], {}).setdefault(r["role"], set()).add(r["id"])
    for i in ids:
        assert train[i]["test"] == {i}
        assert train[i].get("train", set()) == {j for j in ids if d[ids.index(i), ids.index(j)] > out[i]} - {i}


def test_ward_is_greedy():
    rng = np.random.default_rng(0)
    p = rng.random((25, 2))
    groups = [[i] for i in range(25)]
    cost = lambda a, b: len(a) * len(b) / (len(a) + len(b)) * ((p[a].mean(0) - p[b].mean(0)) ** 2).sum()
    cuts = local.ward(p, list(range(2, 20)))
    while len(groups) > 2:
        a, b = min(itertools.combinations(range(len(groups)), 2), key=lambda ab: cost(groups[ab[0]], groups[ab[1]]))
        groups = [g for k, g in enumerate(groups) if k not in (a, b)] + [groups[a] + groups[b]]
        if len(groups) in cuts:
            got = {frozenset(np.flatnonzero(cuts[len(groups)] == c).tolist()) for c in set(cuts[len(groups)].tolist())}
            assert got == set(map(frozenset, groups))
    with pytest.raises(ValueError):
        local.ward(np.zeros((local.MAX_LOCAL + 1, 2)), [2])


def test_nearest_is_brute_force(spark):
    rng = np.random.default_rng(7)
    for n, m, spread in ((60, 80, 100), (40, 1, 10), (50, 50, 1)):
        q, r = rng.integers(0, spread, (n, 2)), np.concatenate([rng.integers(0, spread, (m, 2)), [[spread * 900, 5]]])
        dq, dr = (spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(t.tolist())], "id long, x double, y double") for t in (q, r))
        got = {x["id"]: (x["d"], x["ref"]) for x in nn.nearest(dq, dr).collect()}
        for k in range(n):
            d = np.sqrt(((r - q[k]) ** 2).sum(1))
            assert abs(got[k][0] - d.min()) < 1e-9 and got[k][1] == int(np.flatnonzero(np.isclose(d, d.min()))[0])
        pairs = {(x["i"], x["j"]) for x in nn.within(dq, dr, spread / 4).collect()}
        assert pairs == {(i, j) for i in range(n) for j in range(len(r)) if ((r[j] - q[i]) ** 2).sum() <= (spread / 4) ** 2}
    none = nn.nearest(dq, dr.limit(0)).collect()
    assert len(none) == n and all(x["d"] is None for x in none)


def test_nearest_rules_in_both_forms(spark, monkeypatch):
    """Other fold, same group, farther than a bound, repeated places and degrees, with tiles at hand and with distributed ones."""
    rng = np.random.default_rng(3)
    for longlat in (False, True):
        rows = [(i, *map(float, rng.integers(0, 9, 2)), int(rng.integers(0, 3)), int(rng.integers(0, 2)), float(rng.integers(0, 4)) * (90_000 if longlat else 1)) for i in range(120)]
        rows += [(200 + i, 4.0, 4.0, 1, 0, 0.5) for i in range(60)]
        df = spark.createDataFrame(rows, "id long, x double, y double, fold int, part int, far double")

        def dist(a, b):
            if not longlat:
                return math.dist(a[1:3], b[1:3])
            la, lb = math.radians(a[2]), math.radians(b[2])
            h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
            return 2 * geometry.EARTH_RADIUS * math.asin(math.sqrt(min(1.0, h)))

        rules = {
            ("fold", None, None): lambda a, b: a[3] != b[3],
            ("id", None, None): lambda a, b: a[0] != b[0],
            ("fold", "part", None): lambda a, b: a[3] != b[3] and a[4] == b[4],
            (None, None, "far"): lambda a, b: dist(a, b) > a[5],
        }
        for local_refs, tile in ((nn.LOCAL_REFS, 4), (0, 4)):
            monkeypatch.setattr(nn, "LOCAL_REFS", local_refs)
            monkeypatch.setattr(nn, "LOCAL_TILE", tile)
            monkeypatch.setattr(nn, "TILE_REFS", tile)
            monkeypatch.setattr(nn, "TILE_QUERIES", 50)
            for (differ, same, beyond), ok in rules.items():
                got = {r["id"]: r for r in nn.nearest(df, df, differ, same, beyond, longlat).collect()}
                assert len(got) == len(rows)
                for a in rows:
                    best = min(((dist(a, b), b[0]) for b in rows if ok(a, b)), default=(None, None))
                    assert got[a[0]]["d"] == pytest.approx(best[0], abs=1e-6 if longlat else 1e-9)
                    if differ != "id" and not longlat:
                        assert got[a[0]]["ref"] == best[1]
        monkeypatch.undo()


def test_running_sums_and_ranks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(k, float(v), int(rng.integers(1, 5))) for k in (1, 2) for v in set(rng.integers(0, 500, 80).tolist())]
    df = spark.createDataFrame(rows, "k int, v double, n int")
    for few in (stats.FEW_ROWS, 0):
        monkeypatch.setattr(stats, "FEW_ROWS", few)
        got = stats.running(df, ["k"], "v", ["n"]).collect()
        assert len(got) == len(rows)
        for r in got:
            mine = [x for x in rows if x[0] == r["k"]]
            later = [x[1] for x in mine if x[1] > r["v"]]
            assert (r["cum_n"], r["all_n"], r["next"]) == (sum(x[2] for x in mine if x[1] <= r["v"]), sum(x[2] for x in mine), min(later, default=None))
    import hashlib

    order = lambda k: {v: i for i, v in enumerate(sorted((x[1] for x in rows if x[0] == k), key=lambda v: hashlib.md5(f"7:{v}".encode()).hexdigest()), 1)}
    assert all(order(r["k"])[r["v"]] == r["rank"] for r in stats.hash_rank(df, ["k"], 7, "v").collect())


def test_sources_and_guards(spark, lattice, tmp_path):
    square = [(0.0, 0.0), (8.0, 0.0), (8.0, 4.0), (0.0, 4.0)]
    regular, drawn = P.prediction_points(spark, model_domain=square, num_sample=32), P.prediction_points(spark, model_domain=square, num_sample=50, sampling="random", seed=4)
    assert regular.count() == 32 and drawn.count() == 50
    assert all(0 <= r["x"] <= 8 and 0 <= r["y"] <= 4 for r in drawn.collect())
    for wrong in (P.Points(lattice.df, "elsewhere"), P.Points(lattice.df, None)):
        with pytest.raises(ValueError, match="must match"):
            matching.nndm(lattice, wrong, 2.0)
    with pytest.raises(ValueError, match="pred_points, model_domain or r"):
        matching.knndm(lattice)
    with pytest.raises(TypeError):
        diagnose.distances("folds", lattice)
    with pytest.raises(ValueError, match="do not match"):
        f = folds.spatial(lattice, hexagon=False, rows_cols=(3, 3), selection="systematic", k=3)
        diagnose.distances(f, lattice, x=lattice.with_df(lattice.df.limit(5)))
    with pytest.warns(UserWarning, match="15 classes"):
        response(lattice.df, "id", None)
    report = diagnose.distances(f, lattice, num_random=2)
    assert "distances" in report.describe() and "W" in report.describe()
    (tmp_path / "p.csv").write_text("x,y\n" + "\n".join(f"{i},{-i}" for i in range(500)))
    read = P.read_csv(spark.newSession(), str(tmp_path / "p.csv"), "x double, y double")
    assert [(r["id"], r["x"]) for r in read.df.orderBy("id").collect()] == [(i + 1, float(i)) for i in range(500)]
    ring = [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)]
    polygons = spark.createDataFrame([(i, [(a + 0.5 * i, b) for a, b in ring]) for i in range(40)], "block_id int, ring array<struct<x:double,y:double>>")
    hits = {(r["id"], r["block_id"]) for r in folds.in_polygons(lattice.df.select("id", "x", "y"), polygons).collect()}
    assert hits == {(r["id"], i) for r in lattice.df.collect() for i in range(40) if 1 + 0.5 * i <= r["x"] <= 3 + 0.5 * i and 1 <= r["y"] <= 3}


def test_great_circle(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0), (2, 179.9, 10.0)], "id long, x double, y double")
    b = spark.createDataFrame([(7, 1.0, 0.0), (8, -179.9, 10.0)], "id long, x double, y double")
    got = {r["id"]: r for r in nn.nearest(a, b, longlat=True).collect()}
    assert got[1]["ref"] == 7 and abs(got[1]["d"] - geometry.EARTH_RADIUS * math.radians(1)) < 1e-3 and got[2]["ref"] == 8
    assert {(r["i"], r["j"]) for r in nn.within(a, b, 150_000, True).collect()} == {(1, 7), (2, 8)}


def test_small_grid_designs(spark, lattice):
    f = folds.spatial(lattice, "occ", hexagon=False, rows_cols=(3, 3), selection="systematic", k=3)
    assert f.table.count() == 36 and f.k == 3
    assert {r["train_0"] + r["test_0"] for r in f.records.collect()} == {18}
    assert [r["fold"] for r in f.records.orderBy("fold").collect()] == [1, 2, 3]
    assert "systematic" in f.describe() and f.biomod_table().columns == ["id", "RUN1", "RUN2", "RUN3"]
    lists = f.caret().collect()
    assert all(not set(r["index"]) & set(r["indexOut"]) and len(r["index"]) + len(r["indexOut"]) == 36 for r in lists)
    b = folds.buffer(lattice, 1.5, "occ")
    assert b.records.count() == 36 and b.extra["held"].filter("fold = 15").count() == 9
    assert [r["stat"] for r in b.summary().collect()] == ["min", "mean", "max"]
    k = cluster.cluster(lattice, "occ", k=3, starts=2)
    assert k.table.select("fold").distinct().count() == 3
    long = folds.to_long(f, [2])
    assert long.count() == 36 and {r["role"] for r in long.collect()} == {0, 1}
    folds.check_matches(f, lattice)
    assert folds.distances_matrix(lattice).count() == 36 * 36


def test_points_in_blocks_and_hexagons(spark):
    x = catalogue.customers(spark, DIR)
    bbox = x.bbox()
    for flat in (False, True):
        g = folds.make_grid(bbox, size=700, flat_top=flat)
        r = g.place(x.df)
        cx, cy = geometry.hex_centre(r["row"], r["col"], g.xmin, g.ymin, 700, flat)
        far = r.select((((r["x"] - cx) ** 2 + (r["y"] - cy) ** 2) ** 0.5).alias("d")).agg({"d": "max"}).first()[0]
        assert far <= 700 / math.sqrt(3) + 1e-6
    g = folds.make_grid((0, 0, 10, 10), hexagonal=False, size=3, offset=(0.5, 0))
    assert (g.ncol, g.nrow) == (5, 4) and g.xmin <= 0 and g.xmin + g.ncol * 3 >= 10
    e = folds.make_grid((0, 0, 10, 10), hexagonal=False, rows_cols=(2, 5), extend=50)
    assert (e.nrow, e.ncol) == (2, 5) and abs(e.width - 2.2) < 1e-12 and abs(e.xmin + 0.5) < 1e-12


def test_polygons(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, 3.0), (3, 2.0, 1.0), (4, 0.0, 2.0), (5, 3.5, 3.0), (6, 5.0, 1.0)], "id long, x double, y double")
    assert {r["id"] for r in pts.filter(geometry.in_ring("x", "y", ring)).collect()} == {1, 3, 4, 5}
    col = pts.crossJoin(spark.createDataFrame([(ring,)], "ring array<struct<x:double,y:double>>"))
    assert {r["id"] for r in col.filter(geometry.in_polygon("x", "y", "ring")).collect()} == {1, 3, 4, 5}
    lattice = P.polygon_sample(spark, [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)], 100)
    assert lattice.count() == 100


def test_selection_rules(spark, lattice):
    with pytest.warns(UserWarning):
        folds.spatial(lattice, "occ", selection="checkerboard", rows_cols=(3, 3), k=3, iteration=3)
    with pytest.raises(ValueError):
        folds.spatial(lattice, selection="predefined", hexagon=False)
    with pytest.raises(ValueError):
        folds.spatial(lattice, hexagon=False, rows_cols=(1, 1), k=3)
    with pytest.raises(ValueError):
        folds.spatial(lattice, selection="other")
    with pytest.raises(ValueError):
        folds.buffer(P.Points(lattice.df), 1.0)
    with pytest.warns(UserWarning):
        assert len(folds.spatial(lattice, "gone", hexagon=False, rows_cols=(3, 3), k=3).records.columns) == 3
    with pytest.raises(ValueError):
        P.Points(lattice.df.drop("x"))
    assert P.iterations("2") == 2 and P.iterations(-3) == 3 and P.iterations(0) == 1
    for bad in ("x", None):
        with pytest.raises(ValueError):
            P.iterations(bad)
    with pytest.raises(ValueError):
        P.check_folds_to_plot([9], 3)
    with pytest.warns(UserWarning):
        assert P.Points(lattice.df).guess_crs().longlat


def test_presence_values(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 0.5, "a"), (2, 1.0, 1.0, 1.0, "b"), (3, 1.0, 2.0, None, "c")], "id long, x double, y double, v double, t string")
    for column in ("v", "t", None):
        with pytest.raises(ValueError):
            P.presences(df, column, True)
    assert P.presences(df.filter("id = 2"), "v", True).count() == 1


def test_groups(spark, sites):
    f = folds.group(sites, "site", "occ")
    assert f.k == 6 and f.params["type"] == "Leave-group-out"
    m = folds.group(sites, "site", "occ", k=3)
    t = m.table.join(sites.df, "id")
    assert t.groupBy("site").agg({"fold": "min"}).count() == 6 and t.select("site", "fold").distinct().count() == 6
    with pytest.raises(ValueError):
        folds.group(sites, "none")
    with pytest.raises(ValueError):
        folds.group(sites, "site", k=1)
    rows = [(3 * g + j, float(g), float(j), o, f"s{g}") for g, o in enumerate((0, 0, 1, 0, 0, 1, 0, 0, 1)) for j in range(3)]
    nine = plane(spark, rows, "id long, x double, y double, occ int, site string")
    assert folds.group(nine, "site", "occ", k=3).empty_cells().count() > 0
    assert folds.group(nine, "site", "occ", k=3, balance_folds=True).empty_cells().count() == 0


def test_even_split_scores_zero(spark):
    counts = spark.createDataFrame([(p, c, 2) for p in range(1, 5) for c in "01"], "piece int, cls string, n long")
    assigned = spark.createDataFrame([(1, p, p) for p in range(1, 5)], "iter int, piece int, fold int")
    assert tuple(balance.scores(assigned, counts, ["0", "1"], 4).first())[1:] == (0, 0.0)


def test_responses(spark):
    df = lambda v: spark.createDataFrame([(i, 0.0, 0.0, x) for i, x in enumerate(v)], "id long, x double, y double, v double")
    assert response(df([float(i) + 0.5 for i in range(40)]), "v").classes == ["Q1", "Q2", "Q3", "Q4"]
    assert len(response(df([i % 5 + 1.0 for i in range(40)]), "v").classes) == 5
    assert len(response(df([i / 2 for i in range(21)]), "v", None).classes) == 21
    assert len(response(df([0.0] * 40 + [1.0] * 40 + [2 + i / 20 for i in range(20)]), "v").classes) < 4
    for bad in (1, 2.5, True):
        with pytest.raises(ValueError):
            check_num_bins(bad)
    r = response(spark.createDataFrame([(1, 1, "a"), (2, 2, None), (3, None, "a")], "id long, fold int, v string"), "v")
    assert [tuple(x) for x in records(r.df, r.classes, 2).orderBy("fold").collect()] == [(1, 0, 1), (2, 1, 0)]


def test_warning_rules(spark):
    rec = spark.createDataFrame([(1, 100, 0, 10, 0), (2, 100, 60, 10, 30), (3, 100, 60, 2, 1), (4, 100, 60, 10, 29)], "fold int, train_0 int, train_1 int, test_0 int, test_1 int")
    dist = spark.createDataFrame([(1, 95.0), (2, 40.0), (3, 92.0), (4, 10.0)], "fold int, pct_below_pred double")
    got = diagnose.fold_warnings(rec, ["0", "1"], 4, dist=dist).collect()
    types = {(r["fold"], r["type"]) for r in got}
    assert {(1, "class_missing_train"), (1, "single_class_test"), (3, "tiny_test"), (1, "high_leakage"), (3, "high_leakage")} <= types
    assert any(t == "imbalance" for _, t in types) and {f for f, t in types if t == "high_leakage"} == {1, 3}
    assert [(r["fold"], r["type"]) for r in got] == sorted((r["fold"], r["type"]) for r in got)
    assert diagnose.fold_warnings(rec, ["0", "1"], 4, loo=True).count() == 0


def test_kndm_invariants(spark):
    x = catalogue.clustered(spark, "/root/testdata/sf0.01")
    x = x.with_df(x.df.filter("x < 6000 and y < 6000"))
    pred = catalogue.suppliers(spark, "/root/testdata/sf0.01").df
    f = matching.knndm(x, pred, "occ", k=4, nk_len=6)
    n = f.table.count()
    assert n == x.df.count() and f.params["clustering"] == "blocks"
    assert {r["fold"] for r in f.table.select("fold").distinct().collect()} == {1, 2, 3, 4}
    assert f.table.groupBy("fold").count().agg({"count": "max"}).first()[0] <= 0.5 * n
    blocks = f.extra["blocks"]
    assert blocks.count() == blocks.select("block").distinct().count()
    assert f.empty_cells().count() == 0
    even = plane(spark, [(i, float(i % 20), float(i // 20), i % 2) for i in range(400)])
    assert matching.knndm(even, even.df.select("id", "x", "y"), k=4).params["clustering"] == "random"
    with pytest.raises(ValueError):
        matching.knndm(even, even.df, k=1)


def test_rasters(spark, lattice):
    df = spark.range(49).selectExpr("cast(floor(id / 7) as int) as row", "cast(id % 7 as int) as col", "cast(id + 1 as double) as v")
    r = P.Raster(df, 0.0, 7.0, 1.0, 1.0, 7, 7)
    assert {x["id"]: x["v"] for x in r.extract(lattice.df).collect()}[1] == 44.0
    assert r.contains(lattice) and r.clamp(10_000) == 49 and r.clamp(5) == 5
    assert r.random_sample(10, 3).count() == 10 and r.random_sample(10, 3).collect() == r.random_sample(10, 3).collect()
    assert 0 < r.regular_sample(12).count() <= 16
    with pytest.raises(ValueError):
        P.Raster(df, 0.0, 7.0, 0.0, 1.0, 7, 7)
    with pytest.raises(ValueError):
        P.Raster(df.withColumn("v", df["v"].cast("string")), 0.0, 7.0, 1.0, 1.0, 7, 7).check_numeric()
    with pytest.raises(ValueError):
        P.prediction_points(spark)
    assert P.prediction_points(spark, r=r, num_sample=12).count() > 0
    f = folds.spatial(lattice, "occ", hexagon=False, rows_cols=(3, 3), selection="systematic", k=3)
    for method in ("MESS", "L1", "L2"):
        assert diagnose.similarity(f, r, method)["extrapolation"].count() == 3
    loo = diagnose.similarity(folds.buffer(lattice, 1.5), r)
    assert loo["values"].count() == 36
    report = diagnose.summary(f, lattice.df.select("id", "x", "y"), r)
    assert {"records", "distances", "W", "extrapolation", "warnings"} <= set(report.tables)
    w = diagnose.distances(folds.buffer(lattice, 1.5), lattice.df.select("id", "x", "y"))["W"]
    assert {x["curve"] for x in w.collect()} == {"CV", "LOO"}


def test_scales(spark):
    rng = np.random.default_rng(1)
    h = np.linspace(1, 60, 15)
    fit = local.fit_variogram(h, 2 + 5 * np.where(h < 30, 1.5 * h / 30 - 0.5 * (h / 30) ** 3, 1), np.full(15, 100.0))
    assert fit["model"] == "Sph" and abs(fit["range"] - 30) < 1 and abs(fit["sill"] - 5) < 0.2
    x = plane(spark, [(i, float(a), float(b), i % 2) for i, (a, b) in enumerate(rng.random((80, 2)) * 100)])
    assert scale.spatial_autocor(x, ["occ"])["range"] > 0
    sizes = scale.block_sizes(x)
    assert sizes["min"] < sizes["value"] < sizes["max"] and len(scale.sweep_sizes(x)) == 10
    with pytest.raises(ValueError):
        scale.spatial_autocor(x, [])
    with pytest.raises(ValueError):
        scale.spatial_autocor(P.Points(x.df), ["occ"])


def test_rounding(spark):
    df = spark.createDataFrame([(0.0,), (123456.0,), (0.00123456,), (-98765.0,), (None,)], "v double")
    got = [r[0] for r in df.select(stats.signif(df["v"])).collect()]
    assert got[0] == 0 and got[1] == 123500 and abs(got[2] - 0.001235) < 1e-12 and got[3] == -98770 and got[4] is None


def test_entry_without_the_subpackage(tmp_path):
    """The registry works where the optional parts are gone."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/stratafold", tmp_path / "stratafold", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'nn_loo_gj' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_silence(spark, lattice):
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        folds.spatial(lattice, "occ", hexagon=False, rows_cols=(3, 3), selection="systematic", k=3)


def test_autocor_bins_the_pairs_of_all_points(spark):
    n = 5200  # more than a raster's sample
    x = plane(spark, [(i, float(i), 0.0, i % 2) for i in range(n)])
    found = scale.spatial_autocor(x, ["occ"])["variograms"]["occ"]
    assert found.agg({"np": "sum"}).first()[0] == sum(n - d for d in range(1, int(scale.CUTOFF * (n - 1)) + 1))
