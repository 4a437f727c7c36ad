"""Exponents by tiles against a whole step in numpy."""

import numpy as np
import pytest

from habitat_spark.operators import lyapunov as L

KM = L.KM


def whole(a, b, x, y, h, steps):
    ny, nx = a.shape
    for _ in range(steps):
        x, y = L._moved(a, b, x, y, h, 0, 0, (ny, nx))
    return x, y


@pytest.fixture(scope="module")
def currents(spark):
    rng = np.random.default_rng(3)
    ny, nx, rows = 21, 34, []
    field = {}
    for month in (1, 2):
        u, v = np.zeros((ny, nx)), np.zeros((ny, nx))
        for j in range(ny):
            for i in range(nx):
                if rng.random() < 0.04:
                    continue  # a missing cell
                u[j, i], v[j, i] = 1.5 * np.sin(j / 3 + month) + rng.normal(0, 0.2), 1.5 * np.cos(i / 4)
                gone = rng.random() < 0.02
                rows.append((j * nx + i, i, j, int(40e6 + 250_000 * j), 2000, month, None if gone else float(u[j, i]), float(v[j, i])))
                u[j, i] = 0 if gone else u[j, i]
        field[month] = u, v
    rows += [(k, k, 0, 40_000_000, 2001, 1, 0.5, 0.5) for k in range(4)]  # a step of one line
    return spark.createDataFrame(rows, "cell int, ix int, iy int, lat_u int, year int, month int, u double, v double").repartition(3).cache(), field


def scaled(u, v):
    lat = 40 + 0.25 * np.arange(u.shape[0])[:, None]
    km = 0.25 * KM
    return -u * 86.4 / (km * np.cos(np.radians(lat))), -v * 86.4 / km


@pytest.mark.parametrize("tile", [5, 256])
def test_ftle_in_tiles(currents, tile):
    df, field = currents
    got = {(r["year"], r["month"], r["cell"]): r["ftle"] for r in L.ftle(df, "u", "v", 250_000, tile=tile).collect()}
    assert len(got) == df.count() and all(np.isnan(got[2001, 1, k]) for k in range(4))
    for month, (u, v) in field.items():
        a, b = scaled(u, v)
        y, x = np.mgrid[0 : a.shape[0], 0 : a.shape[1]].astype(float)
        x, y = whole(a, b, x.ravel(), y.ravel(), 0.5, 20)
        gx, gy = np.gradient(x.reshape(a.shape)), np.gradient(y.reshape(a.shape))
        c11, c12, c22 = gx[1] ** 2 + gy[1] ** 2, gx[1] * gx[0] + gy[1] * gy[0], gx[0] ** 2 + gy[0] ** 2
        want = np.log(np.sqrt((c11 + c22) / 2 + np.sqrt(((c11 - c22) / 2) ** 2 + c12**2))) / 10
        mine = {k[2]: r for k, r in got.items() if k[:2] == (2000, month)}
        assert [mine[k] for k in mine] == pytest.approx([want.ravel()[k] for k in mine], abs=1e-9)


@pytest.mark.parametrize("tile", [7, 256])
def test_fsle_in_tiles(currents, tile):
    df, field = currents
    got = {(r["year"], r["month"], r["cell"]): r["fsle"] for r in L.fsle(df, "u", "v", 250_000, days=6.0, tile=tile).collect()}
    seen = 0
    for month, (u, v) in field.items():
        a, b = scaled(u, v)
        y, x = np.mgrid[0 : a.shape[0], 0 : a.shape[1]].astype(float)
        rate = np.zeros(a.shape)
        for day in range(1, 7):
            x, y = (z.reshape(a.shape) for z in whole(a, b, x.ravel(), y.ravel(), 0.5, 2))
            far = np.zeros(a.shape)
            far[:, :-1] = np.hypot(np.diff(x, axis=1), np.diff(y, axis=1))
            far[:-1] = np.maximum(far[:-1], np.hypot(np.diff(x, axis=0), np.diff(y, axis=0)))
            rate = np.where((rate == 0) & (far >= 2.0), np.log(2.0) / day, rate)
        mine = {k[2]: r for k, r in got.items() if k[:2] == (2000, month)}
        assert [mine[k] for k in mine] == pytest.approx([rate.ravel()[k] for k in mine], abs=1e-12)
        seen += sum(r > 0 for r in mine.values())
    assert seen > 50


def test_currents_that_are_too_fast(spark):
    df = spark.createDataFrame([(i, i % 3, i // 3, 40_000_000, 2000, 1, 1e4, 0.0) for i in range(9)], "cell int, ix int, iy int, lat_u int, year int, month int, u double, v double")
    with pytest.raises(ValueError):
        L.ftle(df, "u", "v", 250_000)
