"""Curves of nested training sets: whole families in a task give what the pass over all rows gives, and leave the driver no state."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewise.operators import matrix, models, nested
from sitewise.operators.metrics import evaluate
from sitewise.operators.nested import UPTO, TrainingSets
from sitewise.queries.fits import curve_scores

FEATURES = ["a", "b", "c"]
FAMILIES, STEPS = 5, 40


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(9)
    out = []
    for i in range(700):
        a, b, c = rng.normal(5, 2), rng.normal(-100, 30), rng.normal()
        y = int(rng.random() < 1 / (1 + np.exp(-(a - 5) + (b + 100) / 40)))
        # family 3 has few rows, family 4 none; some rows come twice
        codes = [int(v) for v in rng.integers(0, STEPS + 3, 3)] + [None if i > 60 else i % 4, 0]
        out.append((i - i % 20 // 19, y, None if i % 7 == 0 else float(a), float(b), None if i % 3 == 0 else float(c), codes))
    return spark.createDataFrame(out, "id int, y int, a double, b double, c double, codes array<int>")


def sets():
    order = np.random.default_rng(1).permutation(FAMILIES * STEPS)
    return TrainingSets(order // STEPS, np.full(len(order), UPTO, np.int8), order % STEPS + 1)


def fitted(rows):
    return nested.fit_sets(rows, "y", FEATURES, F.col("codes"), sets(), c=np.linspace(0.2, 2, FAMILIES * STEPS)).orderBy("model").collect()


def test_whole_families_equal_passes_over_all_rows(rows, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(nested, "_added", lambda *a: pytest.fail("the driver steps the models"))
        m.setattr(nested, "PANEL", 7)
        m.setattr(nested, "PIECE", 512)
        whole = fitted(rows.repartition(3))
    monkeypatch.setattr(nested, "TASK_BYTES", 0)
    passes = fitted(rows)
    assert [r.model for r in whole] == list(range(FAMILIES * STEPS))
    assert sum(r.coef is None for r in whole) >= STEPS
    for one, other in zip(whole, passes, strict=True):
        assert (one.model, one.n_rows, one.n_pos, one.converged, one.coef is None) == (other.model, other.n_rows, other.n_pos, other.converged, other.coef is None)
        assert np.allclose([*one.mean, *one.scale], [*other.mean, *other.scale], rtol=1e-9)
        assert one.coef is None or np.allclose([one.intercept, *one.coef], [other.intercept, *other.coef], rtol=1e-7, atol=1e-7)


def test_scores_equal_those_row_by_row(rows):
    code = np.arange(FAMILIES * STEPS)
    plain = TrainingSets(code // STEPS, np.full(len(code), UPTO, np.int8), code % STEPS + 1)
    tests = rows.filter("id < 90").withColumn("family", F.explode(F.array(*map(F.lit, (0, 2, 3, 4))))).withColumn("y", F.when(F.col("id") % 13 > 0, F.col("y")))
    got = curve_scores(rows, tests, FAMILIES, STEPS, FEATURES)
    asked = tests.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(STEPS)))).withColumn("model", (F.col("family") * STEPS + F.col("n") - 1).cast("int"))
    fits = nested.fit_sets(rows, "y", FEATURES, F.col("codes"), plain)
    want = evaluate(models.score(asked, fits, "model", FEATURES), ["family", "n"])
    assert got.schema.simpleString() == want.schema.simpleString()
    got, want = (df.orderBy("family", "n").collect() for df in (got, want))
    assert len(got) == len(want) == 4 * STEPS
    for one, other in zip(got, want, strict=True):
        assert one[:4] == other[:4]
        for a, b in zip(one[4:], other[4:], strict=True):
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-9))


def test_families_with_too_many_rows_go_row_by_row(rows, monkeypatch):
    tests = rows.filter("id < 90").withColumn("family", F.lit(1))
    few = curve_scores(rows, tests, FAMILIES, STEPS, FEATURES).orderBy("n").collect()
    monkeypatch.setattr(matrix, "FAMILY_ROWS", 10)
    many = curve_scores(rows, tests, FAMILIES, STEPS, FEATURES).orderBy("n").collect()
    assert [r[:4] for r in few] == [r[:4] for r in many] and np.allclose([r.auc for r in few], [r.auc for r in many])
