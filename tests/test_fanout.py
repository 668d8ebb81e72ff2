"""Closed-form hourly measures equal a literal join of all tables on the hour."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from sitewise.operators.timeseries import Measure, hour_spans, hourly_features, hours_of, spread_over_stays, up_to_window
from sitewise.session import durable

MEASURES = (
    Measure("a", (("t1", "x"),)),
    Measure("b", (("t2", "x"),), "ceil_avg"),
    Measure("s", (("t3", "x"),), "sum"),
    Measure("two", (("t1", "x"), ("t2", "x"))),
    Measure("three", (("t2", "x"), ("t3", "x"), ("t1", "x"))),
)


@pytest.mark.parametrize("seed", [0, 1])
def test_closed_form_equals_literal_join(spark, seed):
    rng = np.random.default_rng(seed)
    grid = pd.DataFrame([(i, s, s - 3) for i in range(4) for s in range(6)], columns=["id", "slot", "hr"])
    tables = {}
    for name in ("t1", "t2", "t3"):
        n = 40
        x = rng.normal(5, 3, n).round(2)
        tables[name] = pd.DataFrame({"id": rng.integers(0, 5, n), "slot": rng.integers(0, 8, n), "x": np.where(rng.random(n) < 0.3, None, x)}).astype({"x": float})
    frames = {n: spark.createDataFrame(t.astype(object).where(t.notna(), None).values.tolist(), "id long, slot long, x double") for n, t in tables.items()}
    got = hourly_features(spark.createDataFrame(grid), frames, MEASURES, "id").toPandas().sort_values(["id", "hr"])
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(name, t.astype({"x": "Float64"}))
    con.register("grid", grid)
    want = con.execute(
        """select g.id, g.hr, avg(t1.x) as a, ceil(avg(t2.x)) as b, sum(t3.x) as s, avg(coalesce(t1.x, t2.x)) as two,
             avg(coalesce(t2.x, t3.x, t1.x)) as three
           from grid g left join t1 using (id, slot) left join t2 using (id, slot) left join t3 using (id, slot)
           group by 1, 2 order by 1, 2"""
    ).df()
    for c in ("a", "b", "s", "two", "three"):
        np.testing.assert_allclose(got[c].to_numpy(float), want[c].to_numpy(float), rtol=1e-9, equal_nan=True)
    plain = hourly_features(spark.createDataFrame(grid), frames, MEASURES, "id", sum_mode="corrected").toPandas().sort_values(["id", "hr"])
    sums = con.execute("select g.id, g.hr, sum(t3.x) as s from grid g left join t3 using (id, slot) group by 1, 2 order by 1, 2").df()
    np.testing.assert_allclose(plain["s"].to_numpy(float), sums["s"].to_numpy(float), rtol=1e-9, equal_nan=True)


def test_measurements_are_cut_to_the_hours_before_any_exchange(spark, capsys):
    """Two overlapping stays of one visit, rows outside all hours, keys without a stay: as a literal interval join."""
    rng = np.random.default_rng(3)
    stays = [(1, 7, 0, 0, 5), (2, 7, 0, 3, 9), (3, 8, 0, 2, 2), (4, None, 0, 1, 4), (5, 9, 1, None, 4)]
    frame = spark.createDataFrame(stays, "id long, visit long, excluded int, t0 long, t1 long").repartition(2)
    spans = durable(hour_spans(frame, "id", "t0", "t1", 1, lead=2, keep=["visit"]), "spans")
    grid = hours_of(spans, "id", ["visit"])
    n = 200
    events = {
        "own": pd.DataFrame({"id": rng.integers(1, 7, n), "slot": rng.integers(-9, 20, n), "x": rng.normal(size=n)}),
        "shared": pd.DataFrame({"visit": rng.integers(7, 10, n), "slot": rng.integers(-9, 20, n), "x": rng.normal(size=n)}),
    }
    frames = {name: durable(spark.createDataFrame(t).repartition(3), name) for name, t in events.items()}
    measures = (Measure("a", (("own", "x"),)), Measure("b", (("shared", "x"),), "sum"), Measure("c", (("shared", "x"), ("own", "x"))))
    job = hourly_features(grid, frames, measures, "id", "visit", ("shared",), spans=spans)
    got = job.toPandas().sort_values(["id", "hr"])
    con = duckdb.connect()
    con.register("grid", grid.toPandas().astype({"visit": "Int64"}))
    for name, t in events.items():
        con.register(name, t)
    want = con.execute(
        """select g.id, g.hr, avg(o.x) as a, sum(s.x) as b, avg(coalesce(s.x, o.x)) as c from grid g
           left join own o on g.id = o.id and g.slot = o.slot left join shared s on g.visit = s.visit and g.slot = s.slot group by 1, 2 order by 1, 2"""
    ).df()
    assert got[["id", "hr"]].to_numpy().tolist() == want[["id", "hr"]].to_numpy().tolist()
    assert set(got["id"]) == {1, 2, 3, 4}
    for c in "abc":
        np.testing.assert_allclose(got[c].to_numpy(float), want[c].to_numpy(float), rtol=1e-9, equal_nan=True)
    without = hourly_features(grid, frames, measures, "id", "visit", ("shared",)).toPandas().sort_values(["id", "hr"])
    pd.testing.assert_frame_equal(without.reset_index(drop=True), got.reset_index(drop=True))
    capsys.readouterr()
    job.explain()
    plan = capsys.readouterr().out.split("Initial Plan")[-1]
    # the stays before they grow, the grid, the reduced measurements; none of the tables on its own
    assert plan.count("Exchange hashpartitioning") == 3
    assert plan.count("BroadcastHashJoin") == 2 and plan.count("LeftOuter") == 1


def test_the_hours_of_stays_are_never_broadcast(spark, capsys):
    """A grid looks as small as its spans: values of a visit meet the spans, windows meet the grid by a merge join."""
    stays = [(1, 7, 0, 5000), (2, 7, 3, 9), (2, 7, 3, 9), (3, 8, 2, 2), (4, None, 1, 4)]
    spans = hour_spans(spark.createDataFrame(stays, "id long, visit long, t0 long, t1 long"), "id", "t0", "t1", 1, keep=["visit"])
    grid = hours_of(spans, "id", ["visit"])
    values = spark.createDataFrame([(7, 4, 1.5), (7, -30, 2.5), (7, 4000, 3.5), (8, 2, 4.5), (None, 2, 5.5), (9, 2, 6.5)], "visit long, slot long, x double")
    job = spread_over_stays(values, spans, "visit").select("id", "hr", "x")
    assert sorted(job.collect()) == sorted(grid.join(values, ["visit", "slot"]).select("id", "hr", "x").collect())
    windows = spark.createDataFrame([(1, 3), (2, 100)], "id long, windowtime_hours int")
    cut = up_to_window(grid, windows, "id")
    assert cut.count() == 28 + 2 * 31
    for plan, without in ((job, "Generate"), (cut, "BroadcastExchange")):
        capsys.readouterr()
        plan.explain()
        assert without not in capsys.readouterr().out
