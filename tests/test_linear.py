"""Several least squares fits against one at a time."""

import numpy as np
import pytest

from sitewise.operators.linear import least_squares


def plain(x, y):
    known = ~np.isnan(y)
    x, y = x[known], y[known]
    x = np.where(np.isnan(x), np.nanmean(x, axis=0), x)
    sd = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1)
    w = np.linalg.lstsq(z, y - y.mean(), rcond=None)[0]
    fit = y.mean() + z @ w
    return w, 1 - ((y - fit) ** 2).sum() / ((y - y.mean()) ** 2).sum(), len(y)


def test_fits_equal_separate_ones(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(1e4, 3, (60, 3))
    x[:, 2] = rng.integers(0, 2, 60)
    y = np.stack([x[:, 0] * 0.2 - x[:, 2] + rng.normal(size=60), rng.normal(size=60)], axis=1)
    x[rng.random((60, 3)) < 0.1] = np.nan
    y[rng.random((60, 2)) < 0.2] = np.nan
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in np.hstack([x, y])]
    df = spark.createDataFrame(rows, "a double, b double, c double, u double, v double")
    sets = {"all": ["a", "b", "c"], "one": ["c"], "two": ["b", "a"]}
    got = {(r.target, r.inputs, r.feature): r for r in least_squares(df, ["u", "v"], sets).collect()}
    assert len(got) == 12
    for j, t in enumerate(("u", "v")):
        for name, own in sets.items():
            w, r2, n = plain(x[:, ["abc".index(c) for c in own]], y[:, j])
            for c, weight in zip(own, w):
                assert got[t, name, c].weight == pytest.approx(weight, abs=1e-7) and got[t, name, c].r2 == pytest.approx(r2, abs=1e-7) and got[t, name, c].n == n


def test_dependent_constant_and_missing_columns(spark):
    rows = [(float(i), 2.0 * i, 5.0, 3.0 * i + 1, 1.0, None) for i in range(20)]
    df = spark.createDataFrame(rows, "a double, b double, c double, u double, v double, w double")
    got = least_squares(df, ["u", "v", "w"], {"all": ["a", "b", "c"]}).collect()
    assert {r.target for r in got} == {"u", "v"}
    own = {r.feature: r for r in got if r.target == "u"}
    assert own["a"].weight == pytest.approx(own["b"].weight) and own["c"].weight == pytest.approx(0) and own["a"].r2 == pytest.approx(1)
    assert all(r.r2 is None and abs(r.weight) < 1e-9 for r in got if r.target == "v")
    assert least_squares(df.limit(0), ["u"], {"all": ["a"]}).collect() == []
