import math
import random

import pytest
from pyspark.sql import functions as F

from habitat_spark.operators import evaluate as E
from habitat_spark.operators import fields as G
from habitat_spark.operators import match as M
from habitat_spark.operators import stations as ST
from habitat_spark.operators import surfaces as U
from habitat_spark.sources import adapters as A

from .conftest import SMALL


def test_snap_equals_naive(spark):
    # gaps in the grid and stations between, on and beyond its cells
    cells = [(i, i % 4, i // 4, y) for i in range(16) for y in (2000, 2001) if (i * 7 + y) % 5]
    lattice = M.Lattice(0, 0, 100, 100, 4, 4)
    grid = spark.createDataFrame([(c, ix, iy, ix * 100, iy * 100, y, 1, float(c)) for c, ix, iy, y in cells], "cell int, ix int, iy int, lon_u long, lat_u long, year int, month int, v double")
    rng = random.Random(3)
    points = spark.createDataFrame([(i, rng.randrange(-150, 500, 50), rng.randrange(-150, 500, 50), rng.choice([2000, 2001, 2002]), 1) for i in range(200)], "id int, lon_u long, lat_u long, year int, month int")
    for left in (True, False):
        a = M.nearest(points, ["id"], grid, ["v"], lattice, left=left).select("id", "cell", "dist2", "v")
        b = M.nearest_naive(points, ["id"], grid, ["v"], left=left).select("id", "cell", "dist2", "v")
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) if not left else sorted(a.collect(), key=repr) == sorted(b.collect(), key=repr)


def test_threshold_and_labels(spark):
    df = spark.range(1, 1001).select(F.col("id").cast("double").alias("abundance"))
    assert ST.threshold(df, 0.9) == pytest.approx(900.1)
    assert ST.labelled(df, 900.1).filter("patch = 'patch'").count() == 100
    assert ST.threshold(df, absolute=1234) == 1234
    for bad in (spark.range(200).select(F.lit(0.0).alias("abundance")), spark.range(200).select(F.lit(7.0).alias("abundance"))):
        with pytest.raises(ValueError):
            ST.threshold(bad)
    with pytest.raises(ValueError):
        ST.labelled(df.limit(50), 10.0)


def test_percentiles_in_passes(spark, monkeypatch):
    monkeypatch.setattr(ST, "FEW", 7)
    rng = random.Random(4)
    for values in ([rng.gauss(0, 100) for _ in range(3001)], [float(rng.randrange(30)) for _ in range(800)], [1.0], [5.0] * 40 + [9.0] * 60, [rng.random() * (i % 3 == 0) for i in range(2000)]):
        df = spark.createDataFrame([(v,) for v in [*values, None]], "abundance double").repartition(3)
        for share in (0.0, 0.1, 0.37, 0.5, 0.9, 1.0):
            v = sorted(values)
            at = share * (len(v) - 1)
            low = int(at)
            want = v[low] + (v[min(low + 1, len(v) - 1)] - v[low]) * (at - low)
            assert ST.percentile_of(df, share) == pytest.approx(want), (share, len(values))
    assert ST.percentile_of(spark.createDataFrame([], "abundance double"), 0.5) is None


def test_distance_equals_all_pairs(spark):
    rng = random.Random(9)
    cells = [(iy * 9 + ix, ix, iy, y) for y in (2000, 2001, 2002) for ix in range(9) for iy in range(7) if rng.random() < 0.8]
    marked = {c for c in cells if rng.random() < {2000: 0.3, 2001: 0.04, 2002: 0.0}[c[3]]}
    rows = [(c, ix, iy, -70_000_000 + 250_000 * ix, 40_000_000 + 250_000 * iy, y, 1, (c, ix, iy, y) in marked) for c, ix, iy, y in cells]
    df = spark.createDataFrame(rows, "cell int, ix int, iy int, lon_u long, lat_u long, year int, month int, m boolean")
    got = {(r["cell"], r["year"]): r["d"] for r in G.distance_to(df, F.col("m"), "d").collect()}
    for c, _, _, lon, lat, y, _, _ in rows:
        near = [math.hypot((lon - r[3]) / 1e6 * math.cos(math.radians(lat / 1e6)), (lat - r[4]) / 1e6) * G.KM_PER_DEGREE for r in rows if r[7] and r[5] == y]
        assert got[c, y] == (pytest.approx(min(near)) if near else None)


def test_curves_of_folds(spark):
    rng = random.Random(2)
    data = [(rng.randrange(3), rng.random(), rng.randrange(2)) for _ in range(300)]
    got = {r["fold"]: r for r in E.fold_values(spark.createDataFrame(data, "fold int, score double, label int")).collect()}
    for f in range(3):
        own = [(s, y) for k, s, y in data if k == f]
        p, n = sum(y for _, y in own), sum(1 - y for _, y in own)
        assert got[f]["roc_auc"] == pytest.approx(sum((a > b) + (a == b) / 2 for a, y in own for b, z in own if y and not z) / p / n)
        assert got[f]["sens"] == pytest.approx(sum(y for s, y in own if s >= 0.5) / p) and got[f]["spec"] == pytest.approx(sum(1 - y for s, y in own if s < 0.5) / n)


def test_novelty_by_brute_force(spark):
    rng = random.Random(11)
    train = [(round(rng.gauss(10, 3), 2), rng.choice([1.0, 1.0, 2.0, 5.0])) for _ in range(700)]
    rows = [(i, None if i % 17 == 0 else round(rng.gauss(10, 5), 2), rng.choice([0.0, 1.0, 1.5, 2.0, 5.0, 6.0])) for i in range(200)]
    got = {r["id"]: r for r in U.novelty(spark.createDataFrame(rows, "id int, a double, b double"), spark.createDataFrame(train, "a double, b double"), ["a", "b"], ["id"]).collect()}

    def similarity(x, values):
        if x is None:
            return None
        below, low, high = sum(v < x for v in values), min(values), max(values)
        f = 100 * below / len(values)
        return 100 * (x - low) / (high - low) if below == 0 else 2 * f if f <= 50 else 2 * (100 - f) if f < 100 else 100 * (high - x) / (high - low)

    for i, *xs in rows:
        sims = [similarity(x, [t[k] for t in train]) for k, x in enumerate(xs)]
        set_ = [s for s in sims if s is not None]
        assert got[i]["novelty"] == (pytest.approx(min(set_)) if len(set_) == 2 else None)
        assert got[i]["novel_variable"] == "ab"[sims.index(min(set_))]


def test_best_cutoff_is_the_best(spark):
    rng = random.Random(1)
    for _ in range(4):
        data = [(rng.randrange(8) / 8, rng.randrange(2)) for _ in range(60)]
        df = spark.createDataFrame(data, "score double, label int")
        p, n = sum(y for _, y in data), sum(1 - y for _, y in data)
        best = max(sum(y for s, y in data if s >= c) / p - sum(1 - y for s, y in data if s >= c) / n for c, _ in data)
        got = E.best_cutoff(df).first()
        assert got["tss"] == pytest.approx(best)
        wins = sum((a > b) + (a == b) / 2 for a, y in data for b, z in data if y and not z)
        assert E.roc_auc(df).first()[0] == pytest.approx(wins / p / n)
    assert E.best_cutoff(spark.createDataFrame([(0.5, 1)], "score double, label int")).count() == 0


def test_novelty(spark):
    train = spark.createDataFrame([(4.0, 0.2), (8.0, 0.5), (12.0, 1.0), (16.0, 2.0)], "sst double, chl double")
    grid = spark.createDataFrame([(1, -2.0, 0.6), (2, 4.0, 0.6), (3, 10.0, 0.6), (4, 25.0, 0.6), (5, 10.0, 9.0), (6, None, 0.6)], "id int, sst double, chl double")
    got = {r["id"]: r for r in U.novelty(grid, train, ["sst", "chl"], ["id"]).collect()}
    assert got[1]["novelty"] == -50 and got[1]["novel_variable"] == "sst"
    assert got[2]["novelty"] == 0 and got[3]["novelty"] > 0
    assert got[4]["novelty"] == -75 and got[5]["novel_variable"] == "chl" and got[5]["novelty"] < 0
    assert got[6]["novelty"] is None and got[6]["novel_variable"] == "chl"


def test_steps(spark):
    df = spark.createDataFrame([(c, 2018, m, float(10 * c + m)) for c in (1, 2) for m in (6, 7, 8)], "cell int, year int, month int, sst double")
    got = {(r["cell"], r["month"]): r["sst_lag1"] for r in G.lagged(df, "sst").collect()}
    assert got[1, 6] is None and got[2, 7] == 26
    assert {r["sst_dt"] for r in G.temporal_gradient(df, "sst").collect()} == {None, 1.0}
    gaps = df.withColumn("sst", F.when(F.col("month") != 7, F.col("sst")))
    assert {r["month"]: r["sst_int"] for r in G.integral_strict(gaps.filter("cell = 1"), "sst").collect()} == {6: 16.0, 7: None, 8: None}


def test_regridding_round_trip(spark):
    g = A.grid(spark, SMALL)
    c = G.upscaled(g, "chl", 2, "max")
    assert G.downscaled_nearest(c, "chl", 2).count() == 4 * c.count()
    assert G.spacing(spark.createDataFrame([(0, 0), (500_000, 100_000), (1_000_000, 200_000)], "lon_u long, lat_u long")).first()["spacing"] == 0.5


def test_gap_fill(spark):
    df = spark.createDataFrame([(1.0, 5.0), (None, 5.0), (None, None)], "chl double, model double")
    assert [tuple(r) for r in M.filled(df, "chl", "model").select("chl", "chl_source").collect()] == [(1.0, "satellite"), (5.0, "model"), (None, None)]


def test_folds_are_even(spark):
    f = E.stratified_folds(A.scores(spark, SMALL), 5)
    sizes = [r["count"] for r in f.groupBy("label", "fold").count().filter("label = 0").collect()]
    assert max(sizes) - min(sizes) <= 1 and len(sizes) == 5


def test_idw_beyond_its_reach(spark):
    """Cells far from all coarse ones look at every one of the step."""
    coarse = spark.createDataFrame([(1, 1, x, y, float(v)) for x, y, v in ((0, 0, 1), (100, 0, 2), (0, 100, 3), (100, 100, 4), (200, 0, 9))], "year int, month int, lon_u long, lat_u long, v double")
    fine = spark.createDataFrame([(0, 1, 1, 40, 30), (1, 1, 1, 5000, 0), (2, 1, 1, 0, 0), (3, 1, 2, 0, 0)], "cell int, year int, month int, lon_u long, lat_u long")
    got = {r["cell"]: r["v"] for r in G.downscaled_idw(fine, coarse, "v").collect()}
    for c, _, m, x, y in fine.collect():
        near = sorted(((x - r["lon_u"]) ** 2 + (y - r["lat_u"]) ** 2, r["lon_u"], r["lat_u"], r["v"]) for r in coarse.collect())[:4]
        if m == 1:
            w = [1 / max(d / 1e12, 1e-12) for d, *_ in near]
            assert got[c] == pytest.approx(sum(a * r[3] for a, r in zip(w, near)) / sum(w))
    assert set(got) == {0, 1, 2}


def test_idw_around_a_gap(spark):
    """Coarse cells that leave a wide gap, of two steps; one of them has fewer than k. Cells of the gap see few tiles of its rim."""
    from collections import defaultdict

    rim = [(m, x * 100, y * 100, float((7 * x + 13 * y) % 17)) for m in (1, 2) for x in range(-30, 30) for y in range(-30, 30) if max(abs(x), abs(y)) > 22 and (m == 1 or (x, y) in ((-30, -30), (29, 5)))]
    coarse = spark.createDataFrame([(1, *r) for r in rim], "year int, month int, lon_u long, lat_u long, v double")
    places = [(m, x * 130 + 7, y * 130) for m in (1, 2) for x in range(-24, 24) for y in range(-24, 24)] + [(1, 0, 0), (1, -50, -50), (1, 9000, 0)]  # ties in the middle, one far outside
    fine = spark.createDataFrame([(i, 1, *p) for i, p in enumerate(places)], "cell int, year int, month int, lon_u long, lat_u long")
    got = {r["cell"]: r["v"] for r in G.downscaled_idw(fine, coarse, "v").collect()}
    for i, (m, x, y) in enumerate(places):
        near = sorted(((x - a) ** 2 + (y - b) ** 2, a, b, v) for n, a, b, v in rim if n == m)[:4]
        w = [1 / max(d / 1e12, 1e-12) for d, *_ in near]
        assert got[i] == pytest.approx(sum(a * r[3] for a, r in zip(w, near)) / sum(w)), places[i]
    tile = lambda df, x, y: df.select("year", "month", F.col(x).alias("x"), F.col(y).alias("y"), F.floor((F.col(x) + 3000) / 300).alias("tx"), F.floor((F.col(y) + 3000) / 300).alias("ty"))
    inside = fine.filter((F.abs("lon_u") < 1500) & (F.abs("lat_u") < 1500) & (F.col("month") == 1))
    tiles = G.nearest_tiles(tile(inside, "lon_u", "lat_u"), tile(coarse, "lon_u", "lat_u"), ["year", "month"], 4, 3).collect()
    seen = defaultdict(int)
    for t in tiles:
        seen[t["a_tx"], t["a_ty"]] += 1
    every = len({(x // 300, y // 300) for m, x, y, _ in rim if m == 1})
    assert sum(seen.values()) / len(seen) < every / 5  # those in the middle of all see the whole rim, most a part of it


def test_no_hot_slot(spark):
    """Half of all cells hold one value and a tenth lie outside the training range: no window gets much more than its share."""
    cells = spark.range(4000).select(F.col("id").alias("cell"), F.when(F.col("id") % 2 == 0, 0.0).when(F.col("id") % 10 == 1, 9.0 + F.col("id") / 1000).otherwise(F.rand(1)).alias("x"))
    train = spark.range(1000).select(F.when(F.col("id") % 2 == 0, 0.0).otherwise(F.rand(2)).alias("x"))
    long = train.select(F.lit("x").alias("variable"), F.col("x").alias("v")).groupBy("variable", "v").agg(F.count("*").alias("c"))
    sizes = [r["count"] for r in U.slotted(long, 16).groupBy("slot").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * sum(sizes) / 16
    below = {r["v"]: r["below"] for r in U.counted_below(long, 16).collect()}
    values = sorted(r["x"] for r in train.collect())
    assert all(n == sum(x < v for x in values) for v, n in below.items())
    got = U.novelty(cells, train, ["x"], ["cell"])
    assert got.count() == 4000 and got.filter("novelty < 0").count() == cells.filter(F.col("x") > train.agg(F.max("x")).first()[0]).count() >= 400


def test_running_totals_of_crowded_scores(spark):
    """Nearly all scores lie near zero: the curve is right, and so are the curves of folds."""
    df = spark.range(900).select((F.col("id") % 3).cast("int").alias("fold"), F.pow(F.lit(10.0), -F.lit(3.0) - F.col("id") / 300).alias("score"), (F.rand(4) < 0.3).cast("int").alias("label")).cache()
    rows = df.collect()
    for keys, of in (((), lambda r: ()), (("fold",), lambda r: (r["fold"],))):
        for r in E.roc_curve(df, keys).collect():
            mine = [x for x in rows if of(x) == of(r)]
            p, q = (sum(x["label"] == k for x in mine) for k in (1, 0))
            assert r["sensitivity"] == pytest.approx(sum(x["label"] == 1 and x["score"] >= r["score"] for x in mine) / p)
            assert r["specificity"] == pytest.approx(1 - sum(x["label"] == 0 and x["score"] >= r["score"] for x in mine) / q)


def test_step_percentiles(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    data = [(2000 + int(g), 1, float(x)) for g in range(3) for x in np.round(rng.normal(size=(200, 1, 57)[g]), 1 if g else 3)]
    df = spark.createDataFrame([*data, (2009, 1, None)], "year int, month int, v double")
    for share in (0.0, 0.31, 0.5, 1.0):
        got = {r["year"]: r["percentile"] for r in G.step_percentiles(df, "v", share, slots=8).collect()}
        assert got == pytest.approx({y: np.quantile([x for a, _, x in data if a == y], share) for y in (2000, 2001, 2002)})


def test_envelope():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (1, 2, 30):
        x = np.sort(rng.choice(1000, n, replace=False)) / 100
        h, at = rng.uniform(0, 5, n), rng.uniform(-2, 12, 60)
        assert G.envelope(x, h, at, 0.7) == pytest.approx((0.7 * (at[:, None] - x) ** 2 + h).min(1), abs=1e-12)
