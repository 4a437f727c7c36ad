"""Bootstrap bounds by ranges of scores against replicates of whole tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from habitat_spark.plans import models as MD


def plain(score, label, cutoff, times, seed=0):
    """Bounds from rows drawn one by one."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(times):
        at = rng.integers(0, score.size, score.size)
        s, y = score[at], label[at]
        p, q = (y == 1).sum(), (y == 0).sum()
        values = np.unique(s)[::-1]
        tp, fp = (np.array([(s[y == k] >= v).sum() for v in values]) for k in (1, 0))
        sens, spec, prec = tp / p, 1 - fp / q, tp / (tp + fp)
        ranks = np.mean((s[y == 1][:, None] > s[y == 0]) + 0.5 * (s[y == 1][:, None] == s[y == 0]))
        pr = (np.diff(sens, prepend=0) * (prec + np.concatenate([[1.0], prec[:-1]])) / 2).sum()
        row = [ranks, pr, values[np.argmax(sens + spec)]]
        for v in (0.5, cutoff):
            a, b = (s[y == 1] >= v).sum(), (s[y == 0] >= v).sum()
            row += [a / p, 1 - b / q, a / (a + b) if a + b else np.nan]
        out.append(row)
    return dict(zip(["roc_auc", "pr_auc", "cutoff", "sens_half", "spec_half", "precision_half", "sens_best", "spec_best", "precision_best"], np.nanpercentile(out, [2.5, 97.5], axis=0).T))


@pytest.mark.parametrize("most", [100_000, 20])
def test_ranges_give_the_same_distribution(spark, most):
    rng = np.random.default_rng(5)
    label = (rng.random(400) < 0.3).astype(int)
    score = np.round(np.clip(rng.normal(0.35 + 0.25 * label, 0.2), 0, 1), 2)
    df = spark.createDataFrame([(float(s), int(y)) for s, y in zip(score, label)], "score double, label int").repartition(3)
    got = {r["series"]: (r["lower"], r["upper"], r["n"]) for r in MD.bootstrap(df, 0.4, 1500, most=most).collect()}
    assert len(got) == 11 and {x[2] for x in got.values()} == {1500}
    for name, want in plain(score, label, 0.4, 1500).items():
        assert got[name][:2] == pytest.approx(want, abs=0.035), name


def test_ends_of_ranges(spark):
    df = spark.range(300).select((F.col("id") / 1000).alias("score"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    got = {r["series"]: r for r in MD.bootstrap(df, 0.299, 200, most=7).collect()}
    assert got["sens_half"]["upper"] == 0 and got["spec_half"]["lower"] == 1 and "precision_half" not in got
    assert 0 < got["spec_best"]["lower"] <= got["spec_best"]["upper"] <= 1
    with pytest.raises(ValueError):
        MD.bootstrap(df, 0.5, 50)
    with pytest.raises(ValueError):
        MD.bootstrap(df.limit(0), 0.5, 100)
