"""The additive model against dense penalised least squares, its criteria against plain ones, bases and links."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from habitat_spark.plans import additive as A
from habitat_spark.plans import bases as B
from habitat_spark.plans import models as MD
from habitat_spark.plans.links import LINKS, chi_squared_tail, normal


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(4)
    n = 1500
    a, b, c, day = rng.normal(5, 2, n), rng.uniform(0, 1, n), rng.normal(size=n), rng.integers(1, 366, n)
    eta = -2.2 + np.sin(a) + 1.5 * b + 0.8 * np.cos(2 * np.pi * day / 365)
    y = (rng.uniform(size=n) < 1 / (1 + np.exp(-eta))).astype(int)
    flag = rng.integers(0, 3, n)
    rows = [(i, int(y[i]), *map(float, (a[i], b[i], c[i], day[i], flag[i], 0.1 * b[i]))) for i in range(n)]
    return spark.createDataFrame(rows, "station_id long, label int, a double, b double, c double, jday double, flag double, _offset double").repartition(4).cache()


def columns(df, *names):
    rows = df.select("label", *names, "_offset").toPandas()
    return rows[list(names)].to_numpy(float), rows["label"].to_numpy(float), rows["_offset"].to_numpy(float)


def dense(x, y, offset, model):
    """Coefficients by dense penalised least squares at the model's own smoothing parameters."""
    m = np.column_stack([np.ones(len(y)), *(b.values(x[:, i]) for i, b in enumerate(model.terms))])
    s = np.zeros((m.shape[1],) * 2)
    for b in model.terms:
        for k, q in zip(model.parameters.get(b.name, []), b.penalties):
            s[model.columns[b.name], model.columns[b.name]] += k * q
    beta = np.zeros(m.shape[1])
    beta[0] = LINKS[model.link].start(y.mean())
    link = LINKS[model.link]
    def worth(v):
        mean = link.mean(m @ v + offset)
        if (mean >= 1).any():
            return np.inf
        mean = np.clip(mean, 1e-12, 1 - 1e-12)
        return -2 * (y * np.log(mean) + (1 - y) * np.log(1 - mean)).sum() + v @ s @ v
    for _ in range(300):
        eta = m @ beta + offset
        mu, d = np.clip(link.mean(eta), 1e-12, 1 - 1e-12), link.slope(eta)
        w = d * d / (mu * (1 - mu))
        z = m @ beta + (y - mu) / d
        new = np.linalg.lstsq(m.T @ (m * w[:, None]) + s, m.T @ (w * z), rcond=None)[0]
        while worth(new) > worth(beta) + 1e-9:
            new = (new + beta) / 2
        if np.abs(m @ (new - beta)).max() < 1e-11:
            break
        beta = new
    return m, s, w, z, beta


def places(df, name):
    return np.quantile(df.select(name).toPandas()[name], np.linspace(0, 1, 101))


@pytest.mark.parametrize("method, link, kind", [("REML", "logit", "tp"), ("ML", "probit", "cr"), ("GCV.Cp", "cloglog", "ps"), ("P-REML", "cauchit", "cs"), ("REML", "log", "ts")])
def test_dense_solution(sample, method, link, kind):
    names = ("a", "b", "flag", "jday")
    terms = [B.smooth("a", kind, 10, places(sample, "a")), B.smooth("b", kind, 8, places(sample, "b")), B.linear("flag", 1.0, 0.8), B.smooth("jday", "cc", 8, places(sample, "jday"))]
    model = A.fitted(sample, terms, link, method)
    x, y, offset = columns(sample, *names)
    m, s, w, z, beta = dense(x, y, offset, model)
    assert np.abs(m @ (model.beta - beta)).max() < 1e-6
    assert np.abs(m[:, model.columns["a"]].mean(0)).max() < 1e-9
    inverse = np.linalg.inv(m.T @ (m * w[:, None]) + s)
    assert np.abs(inverse - model.covariance).max() < 1e-5 * np.abs(inverse).max()
    edf = np.diag(inverse @ (m.T @ (m * w[:, None])))
    for name in names:
        assert abs(model.freedom(name) - edf[model.columns[name]].sum()) < 1e-4
    assert model.freedom("a") > model.freedom("b") and model.freedom("flag") == pytest.approx(1, abs=1e-6)
    # a Wald test from values at the rows
    at = model.columns["a"]
    f, v = m[:, at] @ beta[at], m[:, at] @ inverse[at, at] @ m[:, at].T
    influence = inverse @ (m.T @ (m * w[:, None]))
    reference = (2 * np.diag(influence) - np.diag(influence @ influence))[at].sum()
    size, axes = np.linalg.eigh(v)
    rank = round(reference)
    want = (((axes[:, ::-1][:, :rank].T @ f) ** 2) / size[::-1][:rank]).sum()
    statistic, ref, p = model.wald("a")
    assert statistic == pytest.approx(want, rel=1e-4) and ref == pytest.approx(reference, rel=1e-4) and p == pytest.approx(chi_squared_tail(want, rank), rel=1e-2, abs=1e-12)
    assert p < 1e-6


@pytest.mark.parametrize("method", ["REML", "ML", "GCV.Cp"])
@pytest.mark.parametrize("shrink", [False, True])
def test_criteria(method, shrink):
    rng = np.random.default_rng(2)
    n = 300
    x, t = rng.uniform(0, 1, n), rng.normal(size=n)
    terms = [B.smooth(k, "cr", 7, np.quantile(v, np.linspace(0, 1, 101))) for k, v in (("x", x), ("t", t))]
    terms = [b.centred(b.values(v).mean(0)) for b, v in zip(terms, (x, t))]
    terms = [b.with_null_penalty() for b in terms] if shrink else terms
    m = np.column_stack([np.ones(n), *(b.values(v) for b, v in zip(terms, (x, t)))])
    w, z = rng.uniform(0.1, 0.3, n), np.sin(6 * x) + rng.normal(size=n) * 2
    sums = A.Sums(m.T @ (m * w[:, None]), m.T @ (w * z), float((w * z * z).sum()), 0.0, n, 0)
    penalties = []
    for i, b in enumerate(terms):
        for q in b.penalties:
            whole = np.zeros((m.shape[1],) * 2)
            whole[1 + 6 * i : 7 + 6 * i, 1 + 6 * i : 7 + 6 * i] = q
            penalties.append(whole)
    criterion = A.Criterion(method, penalties)
    rho = np.linspace(-1, 2, len(penalties))

    def plain(r):
        s = sum(math.exp(k) * q for k, q in zip(r, penalties))
        beta = np.linalg.solve(sums.gram + s, sums.right)
        error = (w * (z - m @ beta) ** 2).sum()
        if method == "GCV.Cp":
            return (error + 2 * np.trace(np.linalg.solve(sums.gram + s, sums.gram))) / n
        # the likelihood of z as a normal variable, up to a constant, with free directions integrated over or not
        values, vectors = np.linalg.eigh(sum(penalties))
        random, fixed = vectors[:, values > 1e-9 * values[-1]], vectors[:, values <= 1e-9 * values[-1]]
        spread = m @ random @ np.linalg.inv(random.T @ s @ random) @ random.T @ m.T + np.diag(1 / w)
        inner = np.linalg.inv(spread)
        flat = m @ fixed
        g = np.linalg.solve(flat.T @ inner @ flat, flat.T @ inner @ z)
        out = (z - flat @ g) @ inner @ (z - flat @ g) + np.linalg.slogdet(spread)[1]
        return (out + (np.linalg.slogdet(flat.T @ inner @ flat)[1] if method == "REML" else 0)) / 2

    value, gradient, hessian = criterion.at(rho, sums)
    other = rho + 0.3
    assert value - criterion.at(other, sums)[0] == pytest.approx(plain(rho) - plain(other), rel=1e-6, abs=1e-9)
    e = 1e-4 * np.eye(len(rho))
    assert gradient == pytest.approx([(plain(rho + d) - plain(rho - d)) / 2e-4 for d in e], rel=1e-4, abs=1e-7)
    assert hessian == pytest.approx(np.array([(criterion.at(rho + d, sums)[1] - criterion.at(rho - d, sums)[1]) / 2e-4 for d in e]), rel=1e-3, abs=1e-6)
    best = criterion.best(rho, sums)
    for d in 50 * e:
        assert plain(best) <= min(plain(np.clip(best + d, -18, 18)), plain(np.clip(best - d, -18, 18))) + 1e-9 * abs(value)


def test_bases():
    rng = np.random.default_rng(0)
    x = np.sort(rng.normal(5, 3, 500))
    q = np.quantile(x, np.linspace(0, 1, 101))
    for kind in B.NAMES:
        b = B.smooth("x", kind, 10, q)
        g = np.linspace(x[0] - 1, x[-1] + 1, 20001)
        v = b.values(g)
        h = g[1] - g[0]
        one, two = np.diff(v, axis=0) / h, np.diff(v, 2, axis=0) / h**2
        assert np.abs(np.diff(one, axis=0)).max() < 0.05 * np.abs(one).max()  # no corner
        if kind in ("tp", "cr", "cc"):  # the penalty is the energy, in some unit
            inside = (g[1:-1] > x[0]) & (g[1:-1] < x[-1])
            c = rng.normal(size=(b.size, 3))
            ratio = ((two[inside] @ c) ** 2).sum(0) * h / np.einsum("ik,ij,jk->k", c, b.penalties[0], c)
            assert ratio == pytest.approx(ratio[0], rel=1e-3)
            line = np.linalg.lstsq(v[1:-1][inside], np.column_stack([np.ones(inside.sum()), g[1:-1][inside]]), rcond=None)
            assert kind == "cc" or line[1].max() < 1e-6
        if kind != "cc":
            assert np.abs(np.diff(b.values(np.array([20.0, 21, 22, 23])), 2, axis=0)).max() < 1e-6
        assert np.linalg.matrix_rank(b.penalties[0], tol=1e-9 * np.linalg.norm(b.penalties[0], 2)) == {"ts": 10, "cs": 10}.get(kind, 8)
    b = B.smooth("x", "cc", 10, q)
    low, high, e = q[0], q[-1], 1e-6
    ends = b.values(np.array([low, low + e, high - e]))
    assert np.abs(ends[0] - ends[2]).max() < 1e-4 and np.abs((ends[1] - ends[0]) - (ends[0] - ends[2])).max() < 1e-9  # value and slope meet
    with pytest.raises(ValueError):
        B.smooth("x", "cr", 10, np.array([1.0, 2.0, 2.0]))


def test_normal_and_chi_squared():
    x = np.linspace(-9, 9, 501)
    assert normal(x) == pytest.approx([0.5 * math.erfc(-t / math.sqrt(2)) for t in x], rel=1e-9, abs=1e-15)
    assert chi_squared_tail(18.307038053275146, 10) == pytest.approx(0.05, rel=1e-9)
    assert chi_squared_tail(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-9)


@pytest.mark.parametrize("link", list(LINKS))
def test_scores_and_links(spark, sample, link):
    bs = {"a": "tp", "b": "ps", "jday": "cc"}
    model = MD.fit(sample, ["a", "b", "flag", "jday"], MD.Spec(type="gam", link=link, bs=bs, method="REML"))
    got = model.score(sample).toPandas()
    m = A.design(model.additive.terms, got[["a", "b", "flag", "jday"]].to_numpy(float))
    assert np.minimum(LINKS[link].mean(m @ model.additive.beta), 1) == pytest.approx(got["score"].to_numpy(), abs=1e-9)
    assert [b.kind for b in model.additive.terms] == ["tp", "ps", "linear", "cc"]
    far = spark.createDataFrame([(1, 99.0, -3.0, 9.0, 800.0), (2, None, 0.5, 1.0, 3.0)], "station_id long, a double, b double, flag double, jday double")
    assert [r["score"] is None for r in model.score(far).orderBy("station_id").collect()] == [False, True]
    terms = MD.smooth_terms(model).collect()
    assert {r["term"] for r in terms} == {"a", "b", "jday"} and all(0 <= r["p_value"] <= 1 for r in terms)


@pytest.mark.parametrize("link", ["cauchit", "log"])
def test_straight_links(sample, link):
    model = MD.fit(sample, ["a", "b", "c"], MD.Spec(type="glm", link=link))
    x, y, offset = columns(sample, "a", "b", "c")
    m, _, w, _, beta = dense(x, y, 0 * offset, model.additive)
    assert np.abs(beta - model.additive.beta).max() < 1e-6
    error = np.sqrt(np.diag(np.linalg.inv(m.T @ (m * w[:, None]))))[1:]
    rows = {r["variable"]: r for r in MD.coefficients(model).collect()}
    assert [rows[k]["std_error"] for k in "abc"] == pytest.approx(error, rel=1e-4)
    assert [rows[k]["estimate"] for k in "abc"] == pytest.approx(beta[1:], abs=1e-6)


def test_terms_vanish_and_weigh(sample):
    plain = MD.fit(sample, ["a", "c"], MD.Spec(type="gam", method="REML")).additive
    shrunk = MD.fit(sample, ["a", "c"], MD.Spec(type="gam", method="REML", shrink=True)).additive
    dear = MD.fit(sample, ["a", "c"], MD.Spec(type="gam", gamma=4.0)).additive
    cheap = MD.fit(sample, ["a", "c"], MD.Spec(type="gam", gamma=0.5)).additive
    assert plain.freedom("c") > 0.9 and shrunk.freedom("c") < 0.7 < 3 < shrunk.freedom("a")
    assert dear.freedom("a") + dear.freedom("c") < cheap.freedom("a") + cheap.freedom("c")


def test_offsets_and_one_class(spark, sample):
    moved = sample.withColumn("effort", F.exp("_offset"))
    model = MD.fit(moved, ["a", "effort"], MD.Spec(type="gam", offset="effort", offset_transform="log"))
    x, y, offset = columns(sample, "a")
    assert np.abs(dense(x, y, offset, model.additive)[4] - model.additive.beta).max() < 1e-5
    with pytest.raises(ValueError):
        MD.fit(sample.filter("label = 0"), ["a"], MD.Spec(type="gam"))


def test_equal_rows_are_fitted_as_one_with_their_count(spark, monkeypatch):
    rows = spark.range(3000).selectExpr("id as station_id", "(id * 7919 % 13) / 13.0D as a", "(id * 31 % 11) / 11.0D as b").withColumn("label", (F.rand(3) < 0.2 + 0.5 * F.col("a")).cast("int"))
    spec = MD.Spec(type="gam", method="REML")
    read = []
    fitted = A.fitted

    def counted(df, terms, *settings):
        read.append((df.count(), df.agg(F.sum("_n")).first()[0], terms))
        return fitted(df, terms, *settings)

    monkeypatch.setattr(A, "fitted", counted)
    model = MD.fit(rows, ["a", "b"], spec)
    assert read[0][0] <= 2 * 13 * 11 and read[0][1] == 3000
    plain = fitted(rows.select("a", "b", "label", F.lit(0.0).alias("_offset")), read[0][2], "logit", "REML")
    m = A.design(model.additive.terms, np.array([[0.1, 0.2], [0.9, 0.5]]))
    assert model.additive.rows == plain.rows == 3000
    assert m @ model.additive.beta == pytest.approx(A.design(plain.terms, np.array([[0.1, 0.2], [0.9, 0.5]])) @ plain.beta, abs=1e-6)


def test_power_of_equal_values(spark):
    rows = spark.range(2000).selectExpr("cast(1 + id * id % 17 as double) as v")
    counts = rows.groupBy("v").agg(F.count("*").alias("_n"))
    for kind in MD.POWERS:
        a, b = (df.orderBy("lam").toPandas()["log_likelihood"].to_numpy() for df in (MD.power_profile(rows, "v", kind), MD.power_profile(counts, "v", kind, count="_n")))
        assert a == pytest.approx(b, rel=1e-9)
