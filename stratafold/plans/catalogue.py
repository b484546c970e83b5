"""Queries over the driver's tables, one or more for each operator, and the same results as SQL.

The tables have no coordinates; integer ones follow from the keys, so that squared distances are exact in any engine.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.functions import stats
from stratafold.operators import balance, cluster, diagnose, folds, matching, nn, scale
from stratafold.operators.response import records, response
from stratafold.sources.points import Points, Raster

CLASSES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
BANDS = [f"b{k:02d}" for k in range(1, 65)]  # all values of an embedding
CENTRES = [[1000.0, 1000.0], [5000.0, 2000.0], [8000.0, 8000.0], [2000.0, 9000.0], [5000.0, 5000.0]]
SIZES = [500.0, 1000.0, 2000.0]


def customers(spark: SparkSession, d: str) -> Points:
    t = spark.read.parquet(f"{d}/customer.parquet")
    key = F.col("c_custkey").cast("long")
    return Points(
        t.select(key.alias("id"), ((key * 7919) % 10007).alias("x"), ((key * 104729) % 10009).alias("y"), F.col("c_mktsegment").alias("cls_name"), F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), 1).otherwise(0).alias("occ"), F.col("c_acctbal").cast("double").alias("val"), F.col("c_nationkey").alias("grp")),
        "local plane",
    )


def clustered(spark: SparkSession, d: str) -> Points:
    """All customers, drawn towards one corner."""
    x = customers(spark, d)
    return x.with_df(x.df.withColumn("x", F.floor(F.col("x") * F.col("x") * F.col("x") / (10007 * 10007))).withColumn("y", F.floor(F.col("y") * F.col("y") * F.col("y") / (10009 * 10009))))


def degrees(x: Points) -> Points:
    """The same points on degrees, ten by ten of them."""
    return Points(x.df.withColumn("x", F.col("x") / 1000.0).withColumn("y", F.col("y") / 1000.0), "geographic", True)


def suppliers(spark: SparkSession, d: str) -> Points:
    t = spark.read.parquet(f"{d}/supplier.parquet")
    key = F.col("s_suppkey").cast("long")
    return Points(t.select(key.alias("id"), ((key * 7919) % 10007).alias("x"), ((key * 104729) % 10009).alias("y"), F.concat(F.lit("c"), (F.col("s_nationkey") % 3).cast("string")).alias("cls_name"), (F.col("s_nationkey") % 2).cast("int").alias("occ"), F.col("s_acctbal").cast("double").alias("val")), "local plane")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/embeddings.parquet")
    return t.select(F.col("vec_id").alias("id"), (F.col("vec_id") % 5 + 1).cast("int").alias("fold"), F.col("label"), *(F.col("embedding")[k].cast("double").alias(b) for k, b in enumerate(BANDS)))


def covariates(spark: SparkSession) -> Raster:
    """A smooth 50 by 50 grid over the customers' square."""
    cells = spark.range(2500).select(F.floor(F.col("id") / 50).cast("int").alias("row"), (F.col("id") % 50).cast("int").alias("col"))
    df = cells.select("row", "col", F.sin(F.col("row") / 7.0).alias("warm"), (F.cos(F.col("col") / 5.0) + F.col("row") / 50.0).alias("wet"))
    return Raster(df, 0.0, 10010.0, 200.2, 200.2, 50, 50, "local plane")


C = "(SELECT c_custkey AS id, (c_custkey*7919)%10007 AS x, (c_custkey*104729)%10009 AS y, c_mktsegment AS cls, CASE WHEN c_mktsegment IN ('BUILDING','MACHINERY') THEN 1 ELSE 0 END AS occ, c_acctbal::DOUBLE AS val, c_nationkey AS grp FROM customer)"
S = "(SELECT s_suppkey AS id, (s_suppkey*7919)%10007 AS x, (s_suppkey*104729)%10009 AS y, 'c' || (s_nationkey%3) AS cls, s_nationkey%2 AS occ, s_acctbal::DOUBLE AS val FROM supplier)"
V = "(SELECT vec_id AS id, vec_id%5+1 AS fold, label, " + ", ".join(f"embedding[{k + 1}]::DOUBLE AS {b}" for k, b in enumerate(BANDS)) + " FROM embeddings)"
CC = f"(SELECT id, floor(x*x*x/(10007*10007))::BIGINT AS x, floor(y*y*y/(10009*10009))::BIGINT AS y, occ FROM {C})"
R = f"(SELECT r, c, sin(r/7.0) AS warm, cos(c/5.0)+r/50.0 AS wet FROM range(0, 50) AS ra(r), range(0, 50) AS rb(c))"


def _grid10(spark: SparkSession, d: str) -> folds.Folds:
    return folds.spatial(customers(spark, d), "cls_name", hexagon=False, rows_cols=(10, 10), selection="systematic", k=5)


def _grid_degrees(spark: SparkSession, d: str) -> folds.Folds:
    return folds.spatial(degrees(customers(spark, d)), "cls_name", hexagon=False, rows_cols=(10, 10), selection="systematic", k=5)


def _grid_presences(spark: SparkSession, d: str) -> folds.Folds:
    return folds.spatial(customers(spark, d), "occ", hexagon=False, rows_cols=(10, 10), selection="systematic", k=5, presence_bg=True)


_CELLS = f"""box AS (SELECT min(x)::DOUBLE AS x0, max(x)::DOUBLE AS x1, min(y)::DOUBLE AS y0, max(y)::DOUBLE AS y1 FROM {C}),
cells AS (SELECT p.*, least(floor((y1-y)/((y1-y0)/10)), 9)::INT AS r, least(floor((x-x0)/((x1-x0)/10)), 9)::INT AS c FROM {C} p, box),
blocks AS (SELECT r, c, row_number() OVER (ORDER BY r, c) AS block_id FROM (SELECT DISTINCT r, c FROM cells))"""
_FOLD5 = f"{_CELLS}, folded AS (SELECT id, x, y, cls, occ, block_id, (block_id-1)%5+1 AS fold FROM cells JOIN blocks USING (r, c))"


def _records(source: str, classes: list[str], k: int) -> str:
    """Record counts of ``source`` (fold, cls) as SQL."""
    test = ", ".join(f"count(*) FILTER (WHERE s.fold=f.fold AND s.cls='{c}') AS \"test_{c}\"" for c in classes)
    train = ", ".join(f"count(*) FILTER (WHERE s.fold<>f.fold AND s.cls='{c}') AS \"train_{c}\"" for c in classes)
    return f"SELECT f.fold::INT AS fold, {train}, {test} FROM range(1, {k + 1}) AS f(fold), {source} s GROUP BY f.fold"


def _search(pieces: str, k: int, iterations: int, seed: int, classes: str) -> str:
    """The balanced search as SQL over ``pieces`` (piece, cls, n); ends in won (piece, fold)."""
    return f"""pc AS ({pieces}), ids AS (SELECT DISTINCT piece FROM pc), num AS (SELECT count(*) AS b, count(*)//{k}*{k} AS full_b FROM ids),
its AS (SELECT iter FROM range(1, {iterations + 1}) AS t(iter)),
even AS (SELECT iter, piece, (row_number() OVER (PARTITION BY iter ORDER BY md5('{seed}:' || iter || ':' || piece))-1)%{k}+1 AS fold FROM ids, its, num WHERE piece <= full_b),
ford AS (SELECT iter, fold, row_number() OVER (PARTITION BY iter ORDER BY md5('{seed}:' || iter || ':f:' || fold)) AS rk FROM its, range(1, {k + 1}) AS f(fold)),
asg AS (SELECT * FROM even UNION ALL SELECT o.iter, i.piece, o.fold FROM ids i, num, ford o WHERE i.piece > full_b AND o.rk = i.piece - full_b),
tot AS (SELECT cls, sum(n) AS total FROM pc WHERE cls IN ({classes}) GROUP BY cls),
cnt AS (SELECT iter, fold, cls, sum(n) AS t FROM asg JOIN pc USING (piece) WHERE cls IN ({classes}) GROUP BY ALL),
sc AS (SELECT i.iter, count(*) FILTER (WHERE coalesce(t,0)=0 AND total>={k}) AS e, round(sum((coalesce(t,0)-total/{k}::DOUBLE)*(coalesce(t,0)-total/{k}::DOUBLE)/(total/{k}::DOUBLE)), 9) AS im
 FROM its i CROSS JOIN range(1, {k + 1}) AS f(fold) CROSS JOIN tot LEFT JOIN cnt ON cnt.iter=i.iter AND cnt.fold=f.fold AND cnt.cls=tot.cls GROUP BY i.iter),
won AS (SELECT piece, fold FROM asg WHERE iter = (SELECT iter FROM sc ORDER BY e, im, iter LIMIT 1))"""


_ALL = ", ".join(f"'{c}'" for c in CLASSES)
_HEX_H = repr(900 * math.sqrt(3) / 2)
_NN = "SELECT a.id, round(sqrt(min((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))::DOUBLE), 6) AS d FROM {a} a, {b} b WHERE {on} GROUP BY a.id"
_GIJ = f"(SELECT s.id, sqrt(min((s.x-c.x)*(s.x-c.x)+(s.y-c.y)*(s.y-c.y))::DOUBLE) AS d FROM {S} s, {C} c GROUP BY s.id)"
_GJ = f"(SELECT a.id, sqrt(min((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))::DOUBLE) AS d FROM {C} a, {C} b WHERE a.id<>b.id GROUP BY a.id)"
_STAR = "(SELECT a.id, a.fold, sqrt(min((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))::DOUBLE) AS d FROM folded a, folded b WHERE a.fold<>b.fold GROUP BY a.id, a.fold)"
_STEPS = """u AS (SELECT v, count(*) FILTER (WHERE o=1) AS na, count(*) FILTER (WHERE o=2) AS nb FROM (SELECT d AS v, 1 AS o FROM {a} UNION ALL SELECT d, 2 FROM {b}) GROUP BY v),
st AS (SELECT v, sum(na) OVER w / (SELECT sum(na) FROM u)::DOUBLE AS fa, sum(nb) OVER w / (SELECT sum(nb) FROM u)::DOUBLE AS fb, lead(v) OVER (ORDER BY v) - v AS width FROM u WINDOW w AS (ORDER BY v ROWS UNBOUNDED PRECEDING))"""
_SIGNIF = "CASE WHEN {v}=0 THEN 0 ELSE round({v}/pow(10, floor(log10(abs({v})))-3))*pow(10, floor(log10(abs({v})))-3) END"


def _within(targets: str, size: int) -> str:
    return f"SELECT a.id AS fold, b.id AS id, b.cls, b.occ FROM {targets} a, {S} b WHERE (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= {size * size}"


def _loo_records(targets: str, classes: list[str], field: str, size: int, add_bg: bool) -> str:
    far = f"(a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) > {size * size}"
    test = f"(a.id=b.id OR (b.occ=0 AND NOT ({far})))" if add_bg else "a.id=b.id"
    cells = [f"count(*) FILTER (WHERE {w} AND b.{field}::VARCHAR='{c}') AS \"{n}_{c}\"" for n, w in (("train", far), ("test", test)) for c in classes]
    return f"SELECT a.id AS fold, {', '.join(cells)} FROM {targets} a, {S} b GROUP BY a.id"


_LONG = "(SELECT vec_id AS id, vec_id%5+1 AS fold, format('b{:02d}', k) AS band, embedding[k]::DOUBLE AS v FROM embeddings, range(1, 65) AS t(k))"
_MESS_VALUE = "CASE WHEN hi>lo THEN CASE WHEN f=0 THEN (v-lo)*100/(hi-lo) WHEN f=100 THEN (hi-v)*100/(hi-lo) WHEN f<=50 THEN 2*f ELSE 200-2*f END END"


def _mess(long: str, test: str = "true", train: str = "a.fold<>b.fold") -> str:
    """MESS as SQL over ``long`` (id, fold, band, v), ending in m (id, fold, band, mess) and pt (id, fold, value, limiting)."""
    return f"""l AS ({long}), r AS (SELECT a.id, a.fold, a.band, a.v, 100.0*count(*) FILTER (WHERE b.v<=a.v)/count(*) AS f, min(b.v) AS lo, max(b.v) AS hi FROM l a JOIN l b ON a.band=b.band AND {train} WHERE {test} GROUP BY ALL),
m AS (SELECT id, fold, band, {_MESS_VALUE} AS mess FROM r),
pt AS (SELECT id, fold, min(mess) AS value, arg_min(band, (mess, band)) AS limiting FROM m WHERE mess IS NOT NULL GROUP BY id, fold)"""


_MESS = _mess(f"SELECT * FROM {_LONG}")
_EXTRAPOLATION = """lim AS (SELECT fold, limiting, row_number() OVER (PARTITION BY fold ORDER BY count(*) DESC, limiting) AS k FROM pt WHERE value<0 GROUP BY fold, limiting)
SELECT pt.fold::INT AS fold, count(*) AS n_test, round(avg((value<0)::INT)*100, 1) AS pct_novel, round(min(value), 2) AS min, round(quantile_cont(value, 0.5), 2) AS median, any_value(lim.limiting) AS limiting_var FROM pt LEFT JOIN lim ON lim.fold=pt.fold AND k=1 GROUP BY pt.fold"""


def _extracted(points: str, cols: str) -> str:
    """``points`` with their raster values as SQL."""
    return f"SELECT {cols}, warm, wet FROM (SELECT *, least(floor((10010.0-y)/200.2), 49)::INT AS rr, least(floor(x/200.2), 49)::INT AS cc FROM {points}) p JOIN {R} g ON g.r=rr AND g.c=cc"


def _bands_long(points: str, cols: str) -> str:
    return f"SELECT {cols}, 'warm' AS band, warm AS v FROM {points} UNION ALL SELECT {cols}, 'wet', wet FROM {points}"


def _similarity_loo(kind: str) -> str:
    z = ", ".join(f"({b}-(SELECT avg({b}) FROM g))/(SELECT stddev_samp({b}) FROM g) AS {b}" for b in ("warm", "wet"))
    gap = "abs(a.warm-b.warm)+abs(a.wet-b.wet)" if kind == "L1" else "sqrt((a.warm-b.warm)*(a.warm-b.warm)+(a.wet-b.wet)*(a.wet-b.wet))"
    far = "(t.x-b.x)*(t.x-b.x)+(t.y-b.y)*(t.y-b.y) > 4000000"
    return f"""WITH g AS (SELECT * FROM {R}), p0 AS ({_extracted(S, "id, x, y")}), p AS (SELECT id, x, y, {z} FROM p0), s AS (SELECT r*50+c AS cell, {z} FROM g),
base AS (SELECT fold, avg(d) AS base FROM (SELECT t.id AS fold, a.cell, min({gap}) AS d FROM p t, s a, p b WHERE b.id=t.id OR {far} GROUP BY ALL) GROUP BY fold),
near AS (SELECT t.id AS fold, min({gap.replace('a.', 't.')}) AS d FROM p t, p b WHERE {far} GROUP BY t.id) SELECT fold AS id, fold, round(base-d, 6) AS value FROM base JOIN near USING (fold)"""


_PLANE, _GLOBE = "sqrt(((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))::DOUBLE)", (
    "2*6371008.8*asin(sqrt(least(1.0, pow(sin((radians(b.y)-radians(a.y))/2), 2)+cos(radians(a.y))*cos(radians(b.y))*pow(sin((radians(b.x)-radians(a.x))/2), 2))))"
)


def _distance_sql(points: str, pred: str, d: str = _PLANE) -> str:
    """gij, gj and star of the systematic folds of ``points`` (a table with fold) as SQL."""
    return f"gij AS (SELECT a.id, min({d}) AS d FROM {pred} a, {points} b GROUP BY a.id), gj AS (SELECT a.id, min({d}) AS d FROM {points} a, {points} b WHERE a.id<>b.id GROUP BY a.id), star AS (SELECT a.id, a.fold, min({d}) AS d FROM {points} a, {points} b WHERE a.fold<>b.fold GROUP BY a.id, a.fold)"


def _distance_rows(digits: int) -> str:
    sig = {c: _SIGNIF.format(v=v) for c, v in {"min": "min(d)", "q1": "quantile_cont(d, 0.25)", "median": "quantile_cont(d, 0.5)", "q3": "quantile_cont(d, 0.75)", "max": "max(d)"}.items()}
    return f"SELECT fold::INT AS fold, count(*) AS n_test, {', '.join(f'round({v}, {digits}) AS {n}' for n, v in sig.items())}, round(avg((d<(SELECT quantile_cont(d, 0.5) FROM gij))::INT)*100, 1) AS pct_below_pred FROM star GROUP BY fold"


def _w_sql(a: str, b: str = "gij") -> str:
    return f"(WITH {_STEPS.format(a=a, b=b)} SELECT coalesce(sum(abs(fa-fb)*width), 0) FROM st)"


def _knndm_sql(points: str, pred: str, k: int, d: str) -> str:
    """Block candidates, merged, scored and compared as SQL; ``points``: (id, x, y, occ)."""
    tries = ", ".join(f"row(round((x-x0-(c{a}{b}*size+(r{a}%2)*(size/2)))*(x-x0-(c{a}{b}*size+(r{a}%2)*(size/2)))+(y-y0-r{a}*h)*(y-y0-r{a}*h), 9), r{a}, c{a}{b})" for a in "01" for b in "01")
    return f"""WITH p AS (SELECT id, x::DOUBLE AS x, y::DOUBLE AS y, occ FROM {points}), n AS (SELECT count(*) AS n FROM p), box AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p),
gij AS (SELECT a.id, min({d}) AS d FROM {pred} a, p b GROUP BY a.id),
nb AS (SELECT DISTINCT round_even(exp(ln(2)+j/99.0*(ln(greatest(3, ceil(sqrt(n))))-ln(2))), 0) AS nb FROM range(0, 100) AS t(j), n),
cand AS (SELECT row_number() OVER (ORDER BY nb) AS candidate, sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0))/nb AS size FROM nb, box),
e0 AS (SELECT *, size*{math.sqrt(3)!r}/2 AS h FROM cand), e1 AS (SELECT p.*, candidate, size, h, x0, y0, floor((y-y0)/h)::BIGINT AS r0, floor((y-y0)/h)::BIGINT+1 AS r1 FROM p, e0, box),
e2 AS (SELECT *, floor((x-x0-(r0%2)*(size/2))/size)::BIGINT AS c00, floor((x-x0-(r0%2)*(size/2))/size)::BIGINT+1 AS c01, floor((x-x0-(r1%2)*(size/2))/size)::BIGINT AS c10, floor((x-x0-(r1%2)*(size/2))/size)::BIGINT+1 AS c11 FROM e1),
e3 AS (SELECT candidate, id, x, y, occ, least({tries}) AS b FROM e2), lab AS (SELECT candidate, id, x, y, occ, format('{{:09d}}:{{:09d}}', b[2], b[3]) AS cluster FROM e3),
v AS (SELECT var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS c FROM p), ev AS (SELECT *, (a+c)/2+sqrt((a-c)*(a-c)/4+b*b) AS l FROM v),
dir AS (SELECT CASE WHEN a>=c THEN l-c ELSE b END AS u, CASE WHEN a>=c THEN b ELSE l-a END AS w FROM ev), ax AS (SELECT u/sqrt(u*u+w*w)*s AS ax, w/sqrt(u*u+w*w)*s AS ay FROM (SELECT *, CASE WHEN (CASE WHEN abs(u)>=abs(w) THEN u ELSE w END)>=0 THEN 1 ELSE -1 END AS s FROM dir)),
g AS (SELECT candidate, cluster, count(*) AS size, round(avg(x*ax+y*ay), 6) AS pc FROM lab, ax GROUP BY ALL), bg AS (SELECT g.*, (size>=n/{k}.0)::INT AS big FROM g, n),
o AS (SELECT *, sum(big) OVER c AS bigs, count(*) OVER c AS al, sum(big) OVER w AS rb, sum(1-big) OVER w AS rs FROM bg WINDOW c AS (PARTITION BY candidate), w AS (PARTITION BY candidate ORDER BY pc, cluster ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, CASE WHEN big=1 THEN rb WHEN bigs<{k} THEN bigs+1+(rs-1)%greatest(1, {k}-bigs) END AS fold FROM o),
ld AS (SELECT candidate, count(fold) AS used, max(load) AS most FROM (SELECT candidate, fold, sum(size) AS load FROM f GROUP BY ALL) GROUP BY candidate),
good AS (SELECT candidate, cluster, fold::INT AS fold FROM f JOIN ld USING (candidate), n WHERE al>={k} AND bigs<={k} AND fold IS NOT NULL AND used={k} AND most<=0.5*n),
fd AS (SELECT candidate, id, x, y, occ, fold FROM lab JOIN good USING (candidate, cluster)),
st AS (SELECT a.candidate, a.id, min({d}) AS d FROM fd a JOIN fd b ON a.candidate=b.candidate AND a.fold<>b.fold GROUP BY ALL),
u AS (SELECT candidate, v, sum(na) AS na, sum(nb) AS nb FROM (SELECT candidate, d AS v, 1 AS na, 0 AS nb FROM st UNION ALL SELECT candidate, d, 0, 1 FROM gij, (SELECT DISTINCT candidate FROM fd)) GROUP BY ALL),
sp AS (SELECT candidate, abs(sum(na) OVER w/(sum(na) OVER c)::DOUBLE-sum(nb) OVER w/(sum(nb) OVER c)::DOUBLE)*(lead(v) OVER (PARTITION BY candidate ORDER BY v)-v) AS a FROM u WINDOW w AS (PARTITION BY candidate ORDER BY v ROWS UNBOUNDED PRECEDING), c AS (PARTITION BY candidate)),
sw AS (SELECT candidate, round(coalesce(sum(a), 0), 9) AS w FROM sp GROUP BY candidate), cl AS (SELECT candidate, count(DISTINCT (fold, occ))={k}*2 AS complete FROM fd GROUP BY candidate)
SELECT id, fold FROM fd WHERE candidate=(SELECT candidate FROM sw JOIN cl USING (candidate) ORDER BY NOT complete, w, candidate LIMIT 1)"""


_NNDM = f"""WITH RECURSIVE s AS (SELECT id, x, y FROM {S}), n AS (SELECT count(*) AS n FROM s), g AS (SELECT sqrt(min((c.x-s.x)*(c.x-s.x)+(c.y-s.y)*(c.y-s.y))::DOUBLE) AS d FROM {C} c, s GROUP BY c.id),
pairs AS (SELECT a.id, row_number() OVER (PARTITION BY a.id ORDER BY (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS pos, sqrt(((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))::DOUBLE) AS d FROM s a, s b WHERE a.id<>b.id),
cdf AS (SELECT d, (SELECT count(*) FROM g WHERE g.d<=p.d)/(SELECT count(*) FROM g)::DOUBLE AS share FROM (SELECT DISTINCT d FROM pairs) p),
near AS (SELECT id, pos, d, share FROM pairs JOIN cdf USING (d) UNION ALL SELECT id, n, 1e300::DOUBLE, 1.0::DOUBLE FROM s, n),
st AS (SELECT 0 AS step, id, 1::BIGINT AS pos, -1.0::DOUBLE AS fl FROM s UNION ALL
 SELECT step+1, id, CASE WHEN ok AND id=pick THEN pos+1 ELSE pos END, CASE WHEN ok THEN fl ELSE r END FROM (
  SELECT *, (below-1)/n::DOUBLE>=share AND (n-ppos)/n::DOUBLE>0.05 AS ok FROM (
   SELECT *, sum((cur<=r)::INT) OVER () AS below, max(CASE WHEN id=pick THEN pos END) OVER () AS ppos, max(CASE WHEN id=pick THEN sh END) OVER () AS share FROM (
    SELECT *, min(CASE WHEN cur=r THEN id END) OVER () AS pick FROM (
     SELECT st.step, st.id, st.pos, st.fl, near.d AS cur, near.share AS sh, n.n, min(CASE WHEN near.d>st.fl AND near.d<=3000 THEN near.d END) OVER () AS r FROM st JOIN near ON near.id=st.id AND near.pos=st.pos, n)))) WHERE r IS NOT NULL)
SELECT st.id AS fold, st.id AS test_id, round(d, 6) AS exclusion_distance FROM st JOIN near USING (id, pos) WHERE step=(SELECT max(step) FROM st)"""

_AUTOCOR = f"""WITH box AS (SELECT min(x)::DOUBLE AS x0, max(x)::DOUBLE AS x1, min(y)::DOUBLE AS y0, max(y)::DOUBLE AS y1 FROM {C}), cut AS (SELECT 0.35*sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)) AS cut FROM box),
pr AS (SELECT sqrt(((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))::DOUBLE) AS d, a.val-b.val AS zv, (a.occ-b.occ)::DOUBLE AS zo FROM {C} a JOIN {C} b ON a.id<b.id),
bn AS (SELECT least(15, greatest(1, ceil(round(d/(cut/15), 9)))) AS bin, count(*) AS np, avg(d) AS dist, avg(zv*zv)/2 AS gv, avg(zo*zo)/2 AS go FROM pr, cut WHERE d>0 AND d<=cut GROUP BY 1),
b AS (SELECT 'val' AS layer, dist, gv AS gamma, np/(dist*dist) AS w FROM bn UNION ALL SELECT 'occ', dist, go, np/(dist*dist) FROM bn),
rg AS (SELECT layer, k, exp(low+(high-low)*k/399.0) AS r FROM (SELECT layer, ln(min(dist)/2) AS low, ln(max(dist)*2) AS high FROM b GROUP BY layer), range(0, 400) AS t(k)),
fx AS (SELECT layer, k, r, m.i, dist, gamma, w, CASE m.i WHEN 0 THEN (CASE WHEN dist<r THEN 1.5*dist/r-0.5*pow(dist/r, 3) ELSE 1.0 END) WHEN 1 THEN 1-exp(-dist/r) ELSE 1-exp(-(dist/r)*(dist/r)) END AS f FROM rg JOIN b USING (layer), (VALUES (0), (1), (2)) AS m(i)),
sm AS (SELECT layer, k, r, i, sum(w) AS s0, sum(w*gamma) AS sg, sum(w*f) AS sf, sum(w*f*f) AS sff, sum(w*f*gamma) AS sfg, sum(w*gamma*gamma) AS sc FROM fx GROUP BY ALL),
ft AS (SELECT *, 0 AS plain, (sg-(s0*sfg-sf*sg)/(s0*sff-sf*sf)*sf)/s0 AS c0, (s0*sfg-sf*sg)/(s0*sff-sf*sf) AS c1 FROM sm WHERE s0*sff-sf*sf>1e-9*s0*sff UNION ALL SELECT *, 1, 0.0, sfg/sff FROM sm),
er AS (SELECT ft.layer, ft.k, ft.r, ft.i, plain, c1, round(sum(w*(c0+c1*f-gamma)*(c0+c1*f-gamma))/any_value(sc), 9) AS sse FROM ft JOIN fx ON fx.layer=ft.layer AND fx.k=ft.k AND fx.i=ft.i WHERE c0>=0 AND c1>=0 GROUP BY ALL),
bs AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY sse, i, k, plain) AS n FROM er)
SELECT layer, CASE i WHEN 0 THEN 'Sph' WHEN 1 THEN 'Exp' ELSE 'Gau' END AS model, round(r, 3) AS range, round(c1, 4) AS sill FROM bs WHERE n=1"""


def _similarity(kind: str) -> str:
    z = ", ".join(f"({b}-(SELECT avg({b}) FROM {V} WHERE label=0))/(SELECT stddev_samp({b}) FROM {V} WHERE label=0) AS {b}" for b in BANDS)
    gap = "+".join(f"abs(a.{b}-b.{b})" if kind == "L1" else f"(a.{b}-b.{b})*(a.{b}-b.{b})" for b in BANDS)
    d = f"min({gap})" if kind == "L1" else f"sqrt(min({gap}))"
    return f"""WITH z AS (SELECT id, fold, label, {z} FROM {V}), base AS (SELECT avg(d) AS base FROM (SELECT {d} AS d FROM z a, z b WHERE a.label=0 GROUP BY a.id))
SELECT a.id, a.fold::INT AS fold, round((SELECT base FROM base) - {d}, 6) AS value FROM z a, z b WHERE a.fold<>b.fold GROUP BY a.id, a.fold"""


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


def _distance_report(s: SparkSession, d: str) -> DataFrame:
    f = _grid10(s, d)
    points = f.points.df.select("id", "x", "y")
    gij = nn.nearest(suppliers(s, d).df, points)
    out = diagnose.distance_table(diagnose.test_to_train(f, points), gij.agg(F.percentile("d", F.lit(0.5)).alias("m")))
    return _rounded(out, 4, "min", "q1", "median", "q3", "max")


def _ecdf(s: SparkSession, d: str) -> DataFrame:
    c = customers(s, d).df
    gij, gj = nn.nearest(suppliers(s, d).df, c), nn.loo(c)
    both = gij.select(F.lit("Prediction").alias("curve"), "d").unionByName(gj.select(F.lit("LOO").alias("curve"), "d"))
    return _rounded(stats.ecdf_grid(both), 6, "r", "f")


def _small_folds(s: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    res = response(customers(s, d).df.withColumn("fold", (F.col("id") % 300 + 1).cast("int")), "occ")
    return records(res.df, res.classes, 300), res.classes


def _clusters(s: SparkSession, d: str) -> DataFrame:
    c = customers(s, d).df
    name = F.when((F.col("x") < 5000) & (F.col("y") < 5000), 0).otherwise(1 + F.floor(F.col("x") / 1000) * 11 + F.floor(F.col("y") / 1000))
    return matching.merge_clusters(c.select(F.lit(1).alias("candidate"), name.cast("int").alias("cluster"), "id", "x", "y"), 5)


def _rect(x0: float, y0: float, x1: float, y1: float) -> list[tuple[float, float]]:
    return [(float(x), float(y)) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]


def _predefined(s: SparkSession, d: str) -> DataFrame:
    rows = [(1, _rect(0, 0, 5000, 5000), 1), (2, _rect(5000, 0, 10010, 5000), 2), (3, _rect(0, 5000, 5000, 10010), 2), (4, _rect(5000, 5000, 9000, 10010), 1)]
    blocks = s.createDataFrame(rows, "block_id int, ring array<struct<x:double,y:double>>, f int")
    return folds.spatial(customers(s, d), "occ", hexagon=False, selection="predefined", user_blocks=blocks, folds_column="f", k=2).table


def _search_folds(column: str, presence: bool) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: folds.spatial(customers(s, d), column, hexagon=False, rows_cols=(10, 10), k=7, iteration=50, presence_bg=presence, seed=1).table


def _scores(s: SparkSession, d: str) -> DataFrame:
    f = _grid10(s, d)
    tagged = f.response.df.select("id", "cls").join(f.extra["blocks"], "id")
    counts = tagged.groupBy(F.col("block_id").alias("piece"), "cls").agg(F.count("*").alias("n"))
    pieces = counts.select("piece").distinct()
    return _rounded(balance.scores(balance.candidates(pieces, pieces.count(), 7, 50, 1), counts, CLASSES, 7), 6, "imbalance")


def _sql_pieces(cls: str) -> str:
    return f"SELECT block_id AS piece, {cls}::VARCHAR AS cls, count(*) AS n FROM folded GROUP BY ALL"


_QUANT = f"q AS (SELECT [round(quantile_cont(val, 0.25), 9), round(quantile_cont(val, 0.5), 9), round(quantile_cont(val, 0.75), 9)] AS b FROM {C}), t AS (SELECT id%4+1 AS fold, CASE WHEN val<=b[1] THEN 'Q1' WHEN val<=b[2] THEN 'Q2' WHEN val<=b[3] THEN 'Q3' ELSE 'Q4' END AS cls FROM {C}, q)"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "spatial_square_systematic": lambda s, d: _grid10(s, d).records,
        "spatial_square_size_offset": lambda s, d: folds.spatial(customers(s, d), hexagon=False, size=900, offset=(0.3, 0.2), selection="systematic", k=5).table,
        "spatial_checkerboard": lambda s, d: folds.spatial(customers(s, d), hexagon=False, rows_cols=(8, 6), selection="checkerboard", extend=2).table,
        "spatial_random_balanced": _search_folds("cls_name", False),
        "spatial_random_presence_bg": _search_folds("occ", True),
        "balance_scores": _scores,
        "spatial_hex_systematic": lambda s, d: folds.spatial(customers(s, d), "cls_name", size=900, selection="systematic", k=5).table,
        "spatial_hex_records": lambda s, d: folds.spatial(customers(s, d), "cls_name", size=900, selection="systematic", k=5).records,
        "spatial_predefined": _predefined,
        "biomod_table": lambda s, d: _grid10(s, d).biomod_table(),
        "folds_list_counts": lambda s, d: _grid10(s, d).folds_list().groupBy("fold", "role").agg(F.count("*").alias("n"), F.sum("id").alias("ids")),
        "records_by_class": lambda s, d: records(response(customers(s, d).df.withColumn("fold", (F.col("id") % 4 + 1).cast("int")), "cls_name").df, CLASSES, 4),
        "records_quantile_bins": lambda s, d: (lambda r: records(r.df, r.classes, 4))(response(customers(s, d).df.withColumn("fold", (F.col("id") % 4 + 1).cast("int")), "val")),
        "group_lgo": lambda s, d: folds.group(customers(s, d), "grp", "cls_name").records,
        "group_merge_k": lambda s, d: folds.group(customers(s, d), "grp", "cls_name", k=6).records,
        "group_balanced": lambda s, d: folds.group(customers(s, d), "grp", "cls_name", k=6, balance_folds=True, iteration=40, seed=3).table,
        "buffer_loo_records": lambda s, d: folds.buffer(suppliers(s, d), 2000, "cls_name").records,
        "buffer_presence_bg": lambda s, d: folds.buffer(suppliers(s, d), 2000, "occ", presence_bg=True).records,
        "buffer_add_bg": lambda s, d: folds.buffer(suppliers(s, d), 2000, "occ", presence_bg=True, add_bg=True).records,
        "buffer_summary": lambda s, d: _rounded(folds.buffer(suppliers(s, d), 2000).summary(), 6, "train", "test"),
        "buffer_train_pairs": lambda s, d: folds.buffer(suppliers(s, d), 2000).folds_list(),
        "nn_loo_gj": lambda s, d: _rounded(nn.loo(customers(s, d).df).select("id", "d"), 6, "d"),
        "nn_pred_gij": lambda s, d: _rounded(nn.nearest(suppliers(s, d).df, customers(s, d).df).select("id", "d"), 6, "d"),
        "nn_cross_fold_gjstar": lambda s, d: _rounded(diagnose.test_to_train(_grid10(s, d), customers(s, d).df.select("id", "x", "y")), 6, "d"),
        "ecdf_curves": _ecdf,
        "wasserstein_w": lambda s, d: _rounded(stats.wasserstein(nn.loo(customers(s, d).df), nn.nearest(suppliers(s, d).df, customers(s, d).df)), 4, "w"),
        "ks_gate": lambda s, d: _rounded(stats.ks_greater(nn.loo(customers(s, d).df), nn.nearest(suppliers(s, d).df, customers(s, d).df)).select("d_plus", "p_value"), 6, "d_plus", "p_value"),
        "distance_summary": _distance_report,
        "distance_w": lambda s, d: _rounded(diagnose.distances(_grid10(s, d), suppliers(s, d), seed=5)["W"], 4, "w"),
        "distance_random_ecdf": lambda s, d: _rounded(diagnose.distances(_grid10(s, d), suppliers(s, d), seed=5)["random_ecdf"], 6, "r", "mean", "low", "high"),
        "distance_longlat": lambda s, d: _rounded(diagnose.distances(_grid_degrees(s, d), degrees(suppliers(s, d)), add_random=False)["distances"], 3, "min", "q1", "median", "q3", "max"),
        "distance_longlat_w": lambda s, d: _rounded(diagnose.distances(_grid_degrees(s, d), degrees(suppliers(s, d)), add_random=False)["W"], 3, "w"),
        "distance_presence_bg": lambda s, d: _rounded(diagnose.distances(_grid_presences(s, d), suppliers(s, d), add_random=False)["distances"], 4, "min", "q1", "median", "q3", "max"),
        "distance_loo": lambda s, d: _rounded(diagnose.distances(folds.buffer(suppliers(s, d), 2000), customers(s, d))["star"], 6, "d"),
        "distance_feature": lambda s, d: _rounded(diagnose.distances(_grid10(s, d), suppliers(s, d), add_random=False, space="feature", r=covariates(s))["star"], 6, "d"),
        "feature_nn": lambda s, d: (lambda v: _rounded(nn.in_features(v, v, "id"), 6, "d"))(vectors(s, d).select("id", F.array(*BANDS).alias("features"))),
        "mess_values": lambda s, d: _rounded(diagnose.mess(vectors(s, d), BANDS), 6, "mess"),
        "mess_extrapolation": lambda s, d: diagnose.extrapolation(diagnose.mess_points(diagnose.mess(vectors(s, d), BANDS)), True),
        "mess_overall": lambda s, d: diagnose.overall_novelty(diagnose.mess_points(diagnose.mess(vectors(s, d), BANDS))),
        "similarity_l1": lambda s, d: (lambda v: _rounded(diagnose.metric_similarity(v, v.filter("label = 0"), BANDS, cluster.scales(v.filter("label = 0"), BANDS), "L1"), 6, "value"))(vectors(s, d)),
        "similarity_l2": lambda s, d: (lambda v: _rounded(diagnose.metric_similarity(v, v.filter("label = 0"), BANDS, cluster.scales(v.filter("label = 0"), BANDS), "L2"), 6, "value"))(vectors(s, d)),
        "summary_warnings": lambda s, d: diagnose.fold_warnings(*_small_folds(s, d), 300),
        "merge_clusters_pc1": _clusters,
        "kmeans_assign_step": lambda s, d: cluster.assign(customers(s, d).df.select("id", F.array(F.col("x").cast("double"), F.col("y").cast("double")).alias("features")), CENTRES).select("id", "cluster", "d2"),
        "variogram_empirical": lambda s, d: _rounded(scale.variogram(customers(s, d), "val", 1500.0), 4, "dist", "gamma"),
        "block_size_sweep": lambda s, d: _rounded(scale.block_sweep(customers(s, d), SIZES), 6, "avg_points"),
        "plot_long": lambda s, d: folds.to_long(folds.buffer(suppliers(s, d), 2000, "cls_name")),
        "plot_combined": lambda s, d: folds.to_long(_grid10(s, d), combine_folds=True),
        "knndm_blocks_folds": lambda s, d: matching.knndm(clustered(s, d), suppliers(s, d), "occ", k=4).table,
        "knndm_longlat": lambda s, d: matching.knndm(degrees(clustered(s, d)), degrees(suppliers(s, d)), "occ", k=4).table,
        "knndm_hierarchical": lambda s, d: matching.knndm(suppliers(s, d), clustered(s, d), clustering="hierarchical", k=4).table,
        "nndm_exclusion": lambda s, d: _rounded(matching.nndm(suppliers(s, d), customers(s, d), 3000).extra["exclusion"], 6, "exclusion_distance"),
        "cluster_kmeans_folds": lambda s, d: cluster.cluster(customers(s, d), "occ", k=5, seed=1).records,
        "cluster_given_centres": lambda s, d: cluster.cluster(customers(s, d), "cls_name", k=5, centres=CENTRES).records,
        "cluster_env_weighted": lambda s, d: cluster.cluster(customers(s, d), "occ", covariates(s), k=4, spatial_weight=0.5, balance_folds=True).records,
        "similarity_raster_mess": lambda s, d: diagnose.similarity(_grid10(s, d), covariates(s))["extrapolation"],
        "similarity_presence_bg": lambda s, d: diagnose.similarity(_grid_presences(s, d), covariates(s))["extrapolation"],
        "similarity_loo_mess": lambda s, d: _rounded(diagnose.similarity(folds.buffer(suppliers(s, d), 2000), covariates(s))["values"].select("id", "fold", "value"), 6, "value"),
        "similarity_loo_l1": lambda s, d: _rounded(diagnose.similarity(folds.buffer(suppliers(s, d), 2000), covariates(s), "L1")["values"], 6, "value"),
        "similarity_loo_l2": lambda s, d: _rounded(diagnose.similarity(folds.buffer(suppliers(s, d), 2000), covariates(s), "L2")["values"], 6, "value"),
        "autocor_ranges": lambda s, d: _rounded(_rounded(scale.spatial_autocor(customers(s, d), ["val", "occ"])["table"], 3, "range"), 4, "sill"),
    }


def oracle_sql() -> dict[str, str]:
    size = f"""WITH box AS (SELECT min(x)::DOUBLE AS x0, max(x)::DOUBLE AS x1, min(y)::DOUBLE AS y0, max(y)::DOUBLE AS y1 FROM {C}),
g AS (SELECT *, greatest(1, ceil((x1-x0)/900))::INT AS nc, greatest(1, ceil((y1-y0)/900))::INT AS nr FROM box),
h AS (SELECT *, x0-(nc*900-(x1-x0))/2+0.3::DOUBLE*900 AS l, y0-(nr*900-(y1-y0))/2+0.2::DOUBLE*900 AS b, y1+(nr*900-(y1-y0))/2+0.2::DOUBLE*900 AS t FROM g),
k AS (SELECT *, CASE WHEN l>x0 THEN l-900 ELSE l END AS l2, CASE WHEN l>x0 THEN nc+1 ELSE nc END AS nc2, CASE WHEN b>y0 THEN nr+1 ELSE nr END AS nr2 FROM h),
c AS (SELECT id, greatest(0, least(floor((t-y)/900), nr2-1))::INT AS r, greatest(0, least(floor((x-l2)/900), nc2-1))::INT AS c FROM {C}, k),
bl AS (SELECT r, c, row_number() OVER (ORDER BY r, c) AS n FROM (SELECT DISTINCT r, c FROM c)) SELECT id, ((n-1)%5+1)::INT AS fold FROM c JOIN bl USING (r, c)"""
    checker = f"""WITH box AS (SELECT min(x)::DOUBLE AS x0, max(x)::DOUBLE AS x1, min(y)::DOUBLE AS y0, max(y)::DOUBLE AS y1 FROM {C}),
e AS (SELECT x0-0.02::DOUBLE*(x1-x0) AS l, x1+0.02::DOUBLE*(x1-x0) AS r, y0-0.02::DOUBLE*(y1-y0) AS b, y1+0.02::DOUBLE*(y1-y0) AS t FROM box),
c AS (SELECT id, greatest(0, least(floor((t-y)/((t-b)/8)), 7))::INT AS r, greatest(0, least(floor((x-l)/((e.r-l)/6)), 5))::INT AS c FROM {C}, e) SELECT id, ((r+c+1)%2+1)::INT AS fold FROM c"""
    tries = ", ".join(f"(round((x-x0-(c{a}{b}*900.0+(r{a}%2)*450.0))*(x-x0-(c{a}{b}*900.0+(r{a}%2)*450.0))+(y-y0-r{a}*{_HEX_H})*(y-y0-r{a}*{_HEX_H}), 9), r{a}, c{a}{b})" for a in "01" for b in "01")
    hexes = f"""box AS (SELECT min(x)::DOUBLE AS x0, min(y)::DOUBLE AS y0 FROM {C}),
h0 AS (SELECT p.*, x0, y0, floor((y-y0)/{_HEX_H})::BIGINT AS r0, floor((y-y0)/{_HEX_H})::BIGINT+1 AS r1 FROM {C} p, box),
h1 AS (SELECT *, floor((x-x0-(r0%2)*450.0)/900.0)::BIGINT AS c00, floor((x-x0-(r0%2)*450.0)/900.0)::BIGINT+1 AS c01, floor((x-x0-(r1%2)*450.0)/900.0)::BIGINT AS c10, floor((x-x0-(r1%2)*450.0)/900.0)::BIGINT+1 AS c11 FROM h0),
h2 AS (SELECT id, cls, y0, least({tries.replace('(round', 'row(round')}) AS b FROM h1),
h3 AS (SELECT id, cls, b[2] AS r, b[3] AS c, round(b[2]*{_HEX_H}+y0, 9) AS cy FROM h2),
hb AS (SELECT r, c, row_number() OVER (ORDER BY cy, r, c) AS n FROM (SELECT DISTINCT r, c, cy FROM h3)),
hf AS (SELECT id, cls, ((n-1)%5+1)::INT AS fold FROM h3 JOIN hb USING (r, c))"""
    grp = f"g AS (SELECT grp, row_number() OVER (ORDER BY grp) AS n FROM (SELECT DISTINCT grp FROM {C}))"
    pres = f"(SELECT * FROM {S} WHERE occ=1)"
    ks = _STEPS.format(a=_GJ, b=_GIJ)
    runs = ", ".join(f"fold<>{p} AS \"RUN{p}\"" for p in range(1, 6))
    assign = ", ".join(f"row((x-{a})*(x-{a})+(y-{b})*(y-{b}), {i + 1})" for i, (a, b) in enumerate(CENTRES))
    sizes = " UNION ALL ".join(f"SELECT {s}::DOUBLE AS size, floor((t.y1-y)/{s}) AS r, floor((x-t.x0)/{s}) AS c FROM {C}, t" for s in SIZES)
    w = _w_sql
    drawn = f"dr AS (SELECT p.id, p.x, p.y, t.draw, (row_number() OVER (PARTITION BY draw ORDER BY md5('5:' || draw || ':' || p.id))-1)%5+1 AS fold FROM {C} p, range(1, 11) AS t(draw))"
    apart = f"ap AS (SELECT a.draw, a.id, min({_PLANE}) AS d FROM dr a JOIN dr b ON a.draw=b.draw AND a.fold<>b.fold GROUP BY ALL)"
    ds = [f"(SELECT d FROM ap WHERE draw={k})" for k in range(1, 11)]
    dcells = f"""lp AS (SELECT id, x/1000.0 AS x, y/1000.0 AS y FROM {C}), lbox AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM lp),
lc AS (SELECT lp.*, least(floor((y1-y)/((y1-y0)/10)), 9)::INT AS r, least(floor((x-x0)/((x1-x0)/10)), 9)::INT AS c FROM lp, lbox), lb AS (SELECT r, c, row_number() OVER (ORDER BY r, c) AS n FROM (SELECT DISTINCT r, c FROM lc)),
folded AS (SELECT id, x, y, (n-1)%5+1 AS fold FROM lc JOIN lb USING (r, c)), ls AS (SELECT id, x/1000.0 AS x, y/1000.0 AS y FROM {S})"""
    shown = f"(SELECT id FROM {S} ORDER BY id LIMIT 10)"
    loo_long = f"p AS ({_extracted(S, 'id, x, y')}), lx AS ({_bands_long('p', 'id, id AS fold, x, y')})"
    feats = f"p0 AS ({_extracted('folded', 'id, fold')}), mo AS (SELECT avg(warm) AS a, stddev_samp(warm) AS b, avg(wet) AS c, stddev_samp(wet) AS e FROM p0), zf AS (SELECT id, fold, (warm-a)/b AS x, (wet-c)/e AS y FROM p0, mo)"
    low = " OR ".join(f"(t{c}+e{c}>=600 AND e{c}>0 AND e{c}<0.25*(t{c}+e{c})/300)" for c in "01")
    lows = "concat_ws(', ', " + ", ".join(f"CASE WHEN t{c}+e{c}>=600 AND e{c}>0 AND e{c}<0.25*(t{c}+e{c})/300 THEN '{c}' END" for c in "01") + ")"
    warn = f"""WITH rec AS ({_records(f"(SELECT id%300+1 AS fold, occ::VARCHAR AS cls FROM {C})", ["0", "1"], 300)}), r AS (SELECT fold, train_0 AS t0, train_1 AS t1, test_0 AS e0, test_1 AS e1, test_0+test_1 AS n FROM rec)
SELECT fold, 'empty_test' AS type, 'no test points' AS message FROM r WHERE n=0
UNION ALL SELECT fold, 'single_class_test', 'the test set has one class only' FROM r WHERE n>0 AND (e0>0)::INT+(e1>0)::INT<=1
UNION ALL SELECT fold, 'class_missing_train', 'no training points of: ' || concat_ws(', ', CASE WHEN t0=0 THEN '0' END, CASE WHEN t1=0 THEN '1' END) FROM r WHERE n>0 AND (t0=0 OR t1=0)
UNION ALL SELECT fold, 'tiny_test', 'test points: ' || n FROM r WHERE n>0 AND n<5
UNION ALL SELECT fold, 'imbalance', 'few test points of: ' || {lows} FROM r WHERE n>0 AND ({low})"""
    merge = f"""WITH p AS (SELECT id, x, CASE WHEN x<5000 AND y<5000 THEN 0 ELSE 1+floor(x/1000)::INT*11+floor(y/1000)::INT END AS cluster FROM {C}), n AS (SELECT count(*) AS n FROM p),
g AS (SELECT cluster, count(*) AS size, round(avg(x), 6) AS mx FROM p GROUP BY cluster), b AS (SELECT g.*, (size>=n/5.0)::INT AS big FROM g, n),
q AS (SELECT *, sum(big) OVER () AS bigs, count(*) OVER () AS al, sum(big) OVER w AS rb, sum(1-big) OVER w AS rs FROM b WINDOW w AS (ORDER BY mx, cluster ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, CASE WHEN big=1 THEN rb WHEN bigs<5 THEN bigs+1+(rs-1)%greatest(1, 5-bigs) END AS fold FROM q),
l AS (SELECT count(*) AS used, max(load) AS most FROM (SELECT fold, sum(size) AS load FROM f GROUP BY fold))
SELECT 1 AS candidate, cluster::INT AS cluster, fold::INT AS fold FROM f, l, n WHERE al>=5 AND bigs<=5 AND used=5 AND most<=0.5*n"""
    return {
        "spatial_square_systematic": f"WITH {_FOLD5} {_records('folded', CLASSES, 5)}",
        "spatial_square_size_offset": size,
        "spatial_checkerboard": checker,
        "spatial_random_balanced": f"WITH {_FOLD5}, {_search(_sql_pieces('cls'), 7, 50, 1, _ALL)} SELECT id, won.fold::INT AS fold FROM folded JOIN won ON piece=block_id",
        "spatial_random_presence_bg": f"WITH {_FOLD5}, {_search(_sql_pieces('occ'), 7, 50, 1, chr(39) + '1' + chr(39))} SELECT id, won.fold::INT AS fold FROM folded JOIN won ON piece=block_id",
        "balance_scores": f"WITH {_FOLD5}, {_search(_sql_pieces('cls'), 7, 50, 1, _ALL)} SELECT iter::INT AS iter, e AS empty, round(im, 6) AS imbalance FROM sc",
        "spatial_hex_systematic": f"WITH {hexes} SELECT id, fold FROM hf",
        "spatial_hex_records": f"WITH {hexes} {_records('hf', CLASSES, 5)}",
        "spatial_predefined": f"SELECT id, CASE WHEN x<=5000 AND y<=5000 THEN 1 WHEN x>=5000 AND y<=5000 THEN 2 WHEN x<=5000 THEN 2 WHEN x<=9000 THEN 1 END AS fold FROM {C} WHERE y<=5000 OR x<=9000",
        "biomod_table": f"WITH {_FOLD5} SELECT id, {runs} FROM folded",
        "folds_list_counts": f"WITH {_FOLD5} SELECT p AS fold, CASE WHEN fold=p THEN 'test' ELSE 'train' END AS role, count(*) AS n, sum(id)::BIGINT AS ids FROM folded, (SELECT p::INT AS p FROM range(1, 6) AS t(p)) GROUP BY ALL",
        "records_by_class": _records(f"(SELECT id%4+1 AS fold, cls FROM {C})", CLASSES, 4),
        "records_quantile_bins": f"WITH {_QUANT} {_records('t', ['Q1', 'Q2', 'Q3', 'Q4'], 4)}",
        "group_lgo": f"WITH {grp}, t AS (SELECT n AS fold, cls FROM {C} p JOIN g USING (grp)) {_records('t', CLASSES, 25)}",
        "group_merge_k": f"WITH {grp}, t AS (SELECT (n-1)%6+1 AS fold, cls FROM {C} p JOIN g USING (grp)) {_records('t', CLASSES, 6)}",
        "group_balanced": f"WITH {grp}, t AS (SELECT id, n AS piece, cls FROM {C} p JOIN g USING (grp)), {_search('SELECT piece, cls, count(*) AS n FROM t GROUP BY ALL', 6, 40, 3, _ALL)} SELECT id, won.fold::INT AS fold FROM t JOIN won USING (piece)",
        "buffer_loo_records": _loo_records(S, ["c0", "c1", "c2"], "cls", 2000, False),
        "buffer_presence_bg": _loo_records(pres, ["0", "1"], "occ", 2000, False),
        "buffer_add_bg": _loo_records(pres, ["0", "1"], "occ", 2000, True),
        "buffer_summary": f"WITH t AS (SELECT a.id, count(*) FILTER (WHERE (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) > 4000000)::DOUBLE AS train FROM {S} a, {S} b GROUP BY a.id) SELECT 'min' AS stat, min(train) AS train, 1.0::DOUBLE AS test FROM t UNION ALL SELECT 'mean', round(avg(train), 6), 1.0 FROM t UNION ALL SELECT 'max', max(train), 1.0 FROM t",
        "buffer_train_pairs": f"SELECT a.id AS fold, b.id AS id, CASE WHEN a.id=b.id THEN 'test' ELSE 'train' END AS role FROM {S} a, {S} b WHERE a.id=b.id OR (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) > 4000000",
        "nn_loo_gj": _NN.format(a=C, b=C, on="a.id<>b.id"),
        "nn_pred_gij": _NN.format(a=S, b=C, on="true"),
        "nn_cross_fold_gjstar": f"WITH {_FOLD5} SELECT fold::INT AS fold, id, round(d, 6) AS d FROM {_STAR}",
        "ecdf_curves": f"WITH a AS (SELECT 'Prediction' AS curve, d FROM {_GIJ} UNION ALL SELECT 'LOO', d FROM {_GJ}), t AS (SELECT max(d) AS top FROM a), k AS (SELECT k FROM range(0, 200) AS r(k)) SELECT curve, round(k.k*top/199, 6) AS r, round(count(*) FILTER (WHERE ceil(round(d/top*199, 9)) <= k.k)/count(*)::DOUBLE, 6) AS f FROM a, t, k GROUP BY curve, k.k, top",
        "wasserstein_w": f"WITH {ks} SELECT round(coalesce(sum(abs(fa-fb)*width), 0), 4) AS w FROM st",
        "ks_gate": f"WITH {ks}, g AS (SELECT greatest(max(fa-fb), 0) AS d FROM st), c AS (SELECT sum(na) AS n, sum(nb) AS m FROM u) SELECT round(d, 6) AS d_plus, round(exp(-2.0*d*d*(n*m/(n+m)::DOUBLE)), 6) AS p_value FROM g, c",
        "distance_summary": f"WITH {_FOLD5}, {_distance_sql('folded', S)} {_distance_rows(4)}",
        "distance_w": f"WITH {_FOLD5}, {_distance_sql('folded', S)}, {drawn}, {apart} SELECT 'CV' AS curve, round({w('star')}, 4) AS w UNION ALL SELECT 'LOO', round({w('gj')}, 4) UNION ALL SELECT 'Random', round(({' + '.join(map(w, ds))})/10, 4)",
        "distance_random_ecdf": f"WITH {_FOLD5}, {_distance_sql('folded', S)}, {drawn}, {apart}, t AS (SELECT max(d) AS top FROM (SELECT d FROM gij UNION ALL SELECT d FROM gj UNION ALL SELECT d FROM star UNION ALL SELECT d FROM ap)), e AS (SELECT draw, k.k, top, count(*) FILTER (WHERE ceil(round(d/top*199, 9)) <= k.k)/count(*)::DOUBLE AS f FROM ap, t, range(0, 200) AS k(k) GROUP BY ALL) SELECT round(k*top/199, 6) AS r, round(avg(f), 6) AS mean, round(quantile_cont(f, 0.1), 6) AS low, round(quantile_cont(f, 0.9), 6) AS high FROM e GROUP BY k, top",
        "distance_longlat": f"WITH {dcells}, {_distance_sql('folded', 'ls', _GLOBE)} {_distance_rows(3)}",
        "distance_longlat_w": f"WITH {dcells}, {_distance_sql('folded', 'ls', _GLOBE)} SELECT 'CV' AS curve, round({w('star')}, 3) AS w UNION ALL SELECT 'LOO', round({w('gj')}, 3)",
        "distance_presence_bg": f"WITH {_FOLD5}, pr AS (SELECT * FROM folded WHERE occ=1), {_distance_sql('pr', S)} {_distance_rows(4)}",
        "distance_loo": f"SELECT a.id AS fold, a.id, round(min({_PLANE}), 6) AS d FROM {S} a, {S} b WHERE (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) > 4000000 GROUP BY a.id",
        "distance_feature": f"WITH {_FOLD5}, {feats} SELECT a.fold::INT AS fold, a.id, round(min({_PLANE}), 6) AS d FROM zf a, zf b WHERE a.fold<>b.fold GROUP BY a.id, a.fold",
        "feature_nn": f"SELECT a.id, round(sqrt(min({'+'.join(f'(a.{b}-b.{b})*(a.{b}-b.{b})' for b in BANDS)})), 6) AS d FROM {V} a, {V} b WHERE a.id<>b.id GROUP BY a.id",
        "mess_values": f"WITH {_MESS} SELECT id, fold::INT AS fold, band, round(mess, 6) AS mess FROM m",
        "mess_extrapolation": f"WITH {_MESS}, {_EXTRAPOLATION}",
        "similarity_raster_mess": f"WITH {_FOLD5}, xt AS ({_extracted('folded', 'id, fold')}), {_mess(_bands_long('xt', 'id, fold'))}, {_EXTRAPOLATION}",
        "similarity_presence_bg": f"WITH {_FOLD5}, xt AS ({_extracted('(SELECT * FROM folded WHERE occ=1)', 'id, fold')}), {_mess(_bands_long('xt', 'id, fold'))}, {_EXTRAPOLATION}",
        "similarity_loo_mess": f"WITH {loo_long}, {_mess('SELECT * FROM lx', train='(a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) > 4000000')} SELECT id, fold, round(value, 6) AS value FROM pt",
        "similarity_loo_l1": _similarity_loo("L1"),
        "similarity_loo_l2": _similarity_loo("L2"),
        "knndm_blocks_folds": _knndm_sql(CC, S, 4, _PLANE),
        "knndm_longlat": _knndm_sql(f"(SELECT id, x/1000.0 AS x, y/1000.0 AS y, occ FROM {CC})", f"(SELECT id, x/1000.0 AS x, y/1000.0 AS y FROM {S})", 4, _GLOBE),
        "nndm_exclusion": _NNDM,
        "autocor_ranges": _AUTOCOR,
        "cluster_given_centres": f"WITH t AS (SELECT b[2] AS fold, cls FROM (SELECT cls, least({assign}) AS b FROM {C})) {_records('t', CLASSES, 5)}",
        "plot_combined": f"WITH {_FOLD5} SELECT id, x, y, fold::INT AS fold FROM folded",
        "mess_overall": f"WITH {_MESS} SELECT round(avg((value<0)::INT)*100, 1) AS pct_novel FROM pt",
        "similarity_l1": _similarity("L1"),
        "similarity_l2": _similarity("L2"),
        "summary_warnings": warn,
        "merge_clusters_pc1": merge,
        "kmeans_assign_step": f"SELECT id, b[2]::INT AS cluster, b[1]::DOUBLE AS d2 FROM (SELECT id, least({assign}) AS b FROM {C})",
        "variogram_empirical": f"WITH p AS (SELECT sqrt(((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))::DOUBLE) AS d, a.val-b.val AS z FROM {C} a JOIN {C} b ON a.id<b.id AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) BETWEEN 1 AND 2250000) SELECT greatest(1, ceil(round(d/100.0, 9)))::INT AS bin, count(*) AS np, round(avg(d), 4) AS dist, round(avg(z*z)/2, 4) AS gamma FROM p GROUP BY 1",
        "block_size_sweep": f"WITH t AS (SELECT min(x)::DOUBLE AS x0, max(y)::DOUBLE AS y1 FROM {C}), c AS (SELECT size, r, c, count(*) AS n FROM ({sizes}) GROUP BY ALL) SELECT size, count(*) AS blocks, min(n) AS min_points, max(n) AS max_points, round(avg(n), 6) AS avg_points FROM c GROUP BY size",
        "plot_long": f"SELECT b.id, b.x, b.y, a.id AS fold, CASE WHEN a.id=b.id THEN 0 WHEN (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) > 4000000 THEN 1 END AS role FROM {S} a, {S} b WHERE a.id IN {shown}",
    }
