"""Rows whose group is missing are a group like any other."""

import math

import pytest
from pyspark.sql import functions as F

from sitewise.operators import models, prep, resample, summary

ROWS = [(i, None if i % 3 == 0 else i % 3, i % 2, float(i % 7) if i % 5 else None, float(i * i % 11)) for i in range(60)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "id int, site int, y int, a double, b double")


def by_site(column):
    groups = {}
    for r in ROWS:
        groups.setdefault(r[1], []).append(r[column])
    return groups


def test_impute_and_standardise(rows):
    means = {s: sum(v for v in own if v is not None) / sum(v is not None for v in own) for s, own in by_site(3).items()}
    got = {r.id: r for r in prep.impute_mean(rows, ["a"], ["site"]).collect()}
    assert len(got) == 60 and all(math.isclose(got[i].a, means[s] if a is None else a) for i, s, _, a, _ in ROWS)
    scaled = prep.standardize(rows, ["a", "b"], ["site"]).groupBy("site").agg(F.count("*").alias("n"), F.avg("b").alias("m"), F.stddev_pop("b").alias("s")).collect()
    assert {r.site for r in scaled} == {None, 1, 2} and all(r.n == 20 and abs(r.m) < 1e-9 and abs(r.s - 1) < 1e-9 for r in scaled)


def test_categorical_table(rows):
    got = summary.categorical_table(rows, ["site"], ["y"]).collect()
    assert sum(r.n for r in got) == 60 and {r.site for r in got} == {None, 1, 2}
    assert all(math.isclose(sum(r.pct for r in got if r.site == s), 100) for s in (None, 1, 2))


def test_spread_order(rows):
    got = resample.spread_order(rows, ["site"], ["id"], "y", 5).collect()
    assert len(got) == 60
    for s in (None, 1, 2):
        assert sorted(r.place for r in got if r.site == s) == list(range(20))


def test_models_of_missing_groups(rows):
    fitted = models.fit_logistic(rows, "site", "y", ["a", "b"])
    assert {r.site: (r.n_rows, r.converged) for r in fitted.collect()} == {s: (20, True) for s in (None, 1, 2)}
    alone = models.fit_logistic(rows.filter("site is null").withColumn("site", F.lit(9)), "site", "y", ["a", "b"]).first()
    same = fitted.filter("site is null").first()
    assert all(math.isclose(x, y, abs_tol=1e-6) for x, y in zip(alone.coef, same.coef))
    assert models.score(rows, fitted, "site", ["a", "b"]).filter("p is null").isEmpty()
    rescaled = models.score_rescaled(rows, fitted.filter("site = 1"), ["site"], ["a", "b"], keep_imputer=True)
    assert rescaled.filter("p is not null").count() == 60
