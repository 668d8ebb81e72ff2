"""Fitted models against numpy and against Spark's own estimator."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sitewise.operators import models, pooled, prep
from sitewise.sources import tables

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(0)
    n = 1500
    f = pd.DataFrame({"id": np.arange(n), "site": rng.integers(0, 4, n), "a": rng.normal(size=n), "b": 1 + 3 * rng.normal(size=n), "c": rng.integers(0, 4, n).astype(float)})
    f["y"] = (rng.random(n) < 1 / (1 + np.exp(-(f.a - 0.3 * f.b)))).astype(int)
    f.loc[rng.random(n) < 0.1, "a"] = np.nan
    f.loc[f.site == 3, "y"] = 0  # one class
    f.loc[f.site == 2, "c"] = np.nan  # never measured
    return f


@pytest.fixture(scope="module")
def df(spark, frame):
    rows = frame.astype(object).where(frame.notna(), None).values.tolist()
    return spark.createDataFrame(rows, "id long, site long, a double, b double, c double, y long")


def newton(g, c=1.0):
    x = g[FEATURES].copy()
    x = x.fillna(x.mean()).fillna(0.0)
    sd = x.std(ddof=0).replace(0, 1)
    x = np.column_stack([np.ones(len(x)), (x - x.mean()) / sd])
    y, w, ridge = g.y.to_numpy(), np.zeros(4), np.diag([0, 1, 1, 1]) / c
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        w = w - np.linalg.lstsq((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w, rcond=None)[0]
    return w


@pytest.mark.parametrize("c", [1.0, 0.01, 1e4])
def test_joint_fit_equals_separate_fits(df, frame, c):
    got = models.fit_logistic(df, "site", "y", FEATURES, c=c).toPandas().set_index("site")
    for site in (0, 1, 2):
        want = newton(frame[frame.site == site], c)
        np.testing.assert_allclose([got.loc[site].intercept, *got.loc[site].coef], want, atol=1e-5)
    assert got.loc[3].coef is None and np.isnan(got.loc[3].intercept)


def test_joint_fit_equals_sparks_estimator(df):
    rows = prep.standardize(df.filter("site <> 3"), FEATURES).withColumn("model", F.lit("all"))
    ours = models.fit_logistic(rows, "model", "y", FEATURES).collect()[0]
    theirs = pooled.fit_pooled_logistic(rows, "y", FEATURES).stages[-1]
    np.testing.assert_allclose(ours.coef, theirs.coefficients.toArray(), atol=1e-4)
    assert ours.intercept == pytest.approx(theirs.intercept, abs=1e-4)


def test_salted_newton_sums_give_the_same_model(spark, df):
    plain = models.fit_logistic(df, "site", "y", FEATURES).toPandas().set_index("site")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        salted = models.fit_logistic(df, "site", "y", FEATURES).toPandas().set_index("site")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    for site in (0, 1, 2):
        np.testing.assert_allclose(plain.loc[site].coef, salted.loc[site].coef, atol=1e-8)


def test_many_features_take_the_matrix_path(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 25))
    y = (rng.random(400) < 1 / (1 + np.exp(-x[:, 0] + x[:, 3]))).astype(int)
    names = [f"f{i}" for i in range(25)]
    wide = pd.DataFrame(x, columns=names).assign(y=y, site=np.arange(400) % 2)
    assert 1 + 26 + 26 * 27 // 2 > models.WIDE
    got = models.fit_logistic(spark.createDataFrame(wide), "site", "y", names).toPandas().set_index("site")
    for site, g in wide.groupby("site"):
        z = (g[names] - g[names].mean()) / g[names].std(ddof=0)
        z, w, ridge = np.column_stack([np.ones(len(g)), z]), np.zeros(26), np.diag([0] + [1] * 25)
        for _ in range(60):
            p = 1 / (1 + np.exp(-z @ w))
            w = w - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (p - g.y) + ridge @ w)
        np.testing.assert_allclose([got.loc[site].intercept, *got.loc[site].coef], w, atol=1e-6)


def test_scores_are_probabilities_and_null_for_one_class(df):
    out = models.score(df, models.fit_logistic(df, "site", "y", FEATURES), "site", FEATURES)
    assert out.filter("site = 3 and p is not null").count() == 0
    assert out.filter("site <> 3 and not (p > 0 and p < 1)").count() == 0
    assert out.count() == df.count()


def test_imputation_and_scaling(df, frame):
    got = prep.standardize(df, FEATURES, ["site"]).toPandas().set_index("id").sort_index()
    for site, g in frame.groupby("site"):
        x = g[FEATURES]
        x = x.fillna(x.mean()).fillna(0.0)
        want = (x - x.mean()) / x.std(ddof=0).replace(0, 1)
        np.testing.assert_allclose(got.loc[g.id, FEATURES].to_numpy(), want.to_numpy(), atol=1e-9)


def test_warm_start_gives_the_same_model(df):
    rows = df.filter("site <> 3")
    near = models.fit_logistic(rows.withColumn("m", F.lit(0)), "m", "y", FEATURES)
    cold, warm = (models.fit_logistic(rows, "site", "y", FEATURES, warm=w).toPandas().set_index("site") for w in (None, near))
    for site in (0, 1, 2):
        np.testing.assert_allclose(cold.loc[site].coef, warm.loc[site].coef, atol=1e-7)


def test_separable_rows_converge(spark):
    rows = [(1, float(i), int(i >= 10)) for i in range(20)]
    df = spark.createDataFrame(rows, "m long, x double, y int")
    fitted = models.fit_logistic(df, "m", "y", ["x"], c=1000.0).collect()[0]
    assert np.isfinite(fitted.coef[0]) and fitted.coef[0] > 0


def test_saved_model_scores_the_same(spark, df):
    rows = prep.standardize(df, FEATURES)
    model = pooled.fit_pooled_logistic(rows, "y", FEATURES)
    again = tables.load_model(tables.save_model(model, spark))
    assert list(model.stages[-1].coefficients) == list(again.stages[-1].coefficients)


TRAINED = ["site_retrain", "cv_metrics", "loso_metrics", "source_transfer", "boosted_trees"]


@pytest.mark.parametrize("name", TRAINED)
def test_trained_queries_give_metrics(spark, folder, name):
    rows = entry.queries()[name](spark, folder).collect()
    assert rows
    for r in rows:
        assert r["count"] > 0 and 0 <= r.outcome <= r["count"]
        assert r.auc is None or 0 <= r.auc <= 1


@pytest.mark.parametrize("name", ["logistic_cv", "model_roundtrip", "local_learning_curve"])
def test_other_trained_queries_run(spark, folder, name):
    rows = entry.queries()[name](spark, folder).collect()
    assert rows
    if name == "logistic_cv":
        assert len(rows) == 10 and sum(r.best for r in rows) == 1
    if name == "model_roundtrip":
        assert all(r.agree == r.n for r in rows)
