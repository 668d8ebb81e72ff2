"""Positions, quantiles, metrics and samples against brute force, with one dominant group."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sitewise.operators import joins, metrics, ranking, resample


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(5)
    n = 3000
    site = np.where(rng.random(n) < 0.6, 0, rng.integers(1, 7, n))  # one site holds most rows
    p = np.where(rng.random(n) < 0.5, rng.random(n), rng.integers(0, 20, n) / 20)
    return pd.DataFrame({"id": np.arange(n), "site": site, "p": p, "v": rng.normal(size=n).round(1), "y": (rng.random(n) < p).astype(int)})


@pytest.fixture(scope="module")
def df(spark, frame):
    return spark.createDataFrame(frame)


def test_hash_positions_are_a_permutation(df, frame):
    out = ranking.hash_positions(df, ["site"], ["id"], 3).toPandas()
    assert len(out) == len(frame)
    for _, g in out.groupby("site"):
        assert sorted(g.position) == list(range(1, len(g) + 1))
    again = ranking.hash_positions(df.repartition(7), ["site"], ["id"], 3).toPandas()
    assert dict(zip(out.id, out.position)) == dict(zip(again.id, again.position))


def test_positions_keep_null_groups(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, 5)], "id int, g int")
    assert sorted(r.position for r in ranking.hash_positions(df, ["g"], ["id"], 1).collect()) == [1, 1, 2]
    assert sorted(r.position for r in ranking.ordered_positions(df, ["g"], [F.col("id")]).collect()) == [1, 1, 2]


@pytest.mark.parametrize("by", [["site"], []])
def test_ordered_positions_equal_row_number(df, frame, by):
    out = ranking.ordered_positions(df, by, [F.col("v").desc(), F.col("id")]).toPandas()
    ordered = frame.sort_values(["v", "id"], ascending=[False, True])
    want = ordered.groupby(by).cumcount() + 1 if by else pd.Series(range(1, len(ordered) + 1), index=ordered.index)
    want = dict(zip(ordered.id, want))
    assert dict(zip(out.id, out.position)) == want


def test_is_first_marks_one_row_per_group_nulls_last(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", 5), (3, "b", None), (4, None, 1), (5, None, 2)], "id int, g string, o int")
    out = {r.id: r.is_first for r in ranking.is_first(df, ["g"], ["o"], "id").collect()}
    assert out == {1: 0, 2: 1, 3: 1, 4: 1, 5: 0}


def test_quantiles_equal_linear_interpolation(df, frame):
    got = ranking.exact_quantiles(df, ["site"], "v", (0.0, 0.25, 0.5, 0.9, 1.0), list("abcde")).toPandas().set_index("site")
    want = frame.groupby("site").v.quantile([0.0, 0.25, 0.5, 0.9, 1.0]).unstack()
    np.testing.assert_allclose(got.sort_index().to_numpy(), want.to_numpy(), atol=1e-12)


def brute_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return ((pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()) if len(pos) and len(neg) else np.nan


def test_metrics_equal_definitions(df, frame):
    got = metrics.evaluate(df, ["site"]).toPandas().set_index("site")
    for site, g in frame.groupby("site"):
        y, p = g.y.to_numpy(), g.p.to_numpy()
        clipped = np.clip(p, 1e-15, 1 - 1e-15)
        row = got.loc[site]
        assert (row["count"], row["outcome"]) == (len(g), y.sum())
        assert row.auc == pytest.approx(brute_auc(y, p))
        assert row.smr == pytest.approx(y.sum() / p.sum())
        assert row.mse == pytest.approx(((y - p) ** 2).mean()) and row.mae == pytest.approx(np.abs(y - p).mean())
        assert row.logloss == pytest.approx(-(y * np.log(clipped) + (1 - y) * np.log(1 - clipped)).mean())


def test_auc_invariants(df, frame):
    base = metrics.evaluate(df).collect()[0].auc
    assert base == pytest.approx(brute_auc(frame.y.to_numpy(), frame.p.to_numpy()))
    assert metrics.evaluate(df.withColumn("p", F.exp("p"))).collect()[0].auc == pytest.approx(base)
    assert metrics.evaluate(df.withColumn("p", -F.col("p"))).collect()[0].auc == pytest.approx(1 - base)


def test_one_class_and_missing_scores(spark):
    df = spark.createDataFrame([(1, 1, 0.2), (1, 1, 0.4), (2, 0, None), (2, 1, None), (3, 0, 0.5), (3, 1, 0.5)], "site int, y int, p double")
    out = {r.site: r for r in metrics.evaluate(df, ["site"]).collect()}
    assert out[1].auc is None and out[1].smr == pytest.approx(2 / 0.6)
    assert out[2].auc is None and out[2].smr is None and out[2]["count"] == 2
    assert out[3].auc == 0.5


def test_salted_join_equals_join(spark, df):
    dims = spark.createDataFrame([(i, i * 10) for i in range(0, 9)], "site long, w long")
    plain = sorted(map(tuple, df.join(dims, "site").select("id", "w").collect()))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert not joins.broadcast_sized(dims)
        salted = joins.salted_join(df, dims, ["site"], spread=["id"]).select("id", "w")
        assert sorted(map(tuple, salted.collect())) == plain
        left = joins.salted_join(df, dims.filter("site < 2"), ["site"], spread=["id"], how="left")
        assert left.count() == df.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_heavy_keys_are_split_by_their_weight(spark):
    """Half of all rows have one key, a quarter none: both spread over the tasks, light keys stay whole."""
    rows = [(i, 1 if i % 2 else None if i % 4 else i) for i in range(2000)]
    facts = spark.createDataFrame(rows, "id long, k long")
    dims = spark.createDataFrame([(1, "a"), (1, "b"), (4, "c"), (None, "d"), (5, "e")], "k long, w string")
    assert [tuple(r) for r in joins._shares(facts, ["k"]).filter("k is not null").collect()] == [(1, 4)]
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for how in ("inner", "left", "left_semi", "left_anti"):
            got = joins.salted_join(facts, dims, ["k"], spread=["id"], how=how)
            want = facts.join(dims, "k", how)
            assert got.columns == want.columns
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        tasks = joins.salted_join(facts, dims, ["k"], spread=["id"], how="left").groupBy("k", F.spark_partition_id().alias("task")).count().collect()
        assert len({r.task for r in tasks if r.k == 1}) > 1 and len({r.task for r in tasks if r.k is None}) > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_membership_with_and_without_broadcast(spark, df, frame):
    keys = spark.createDataFrame([(0,), (3,), (99,)], "site long")
    inside = int(frame.site.isin([0, 3]).sum())
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for value in (limit, "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", value)
            assert joins.member_rows(df, keys, ["site"]).count() == inside
            assert joins.other_rows(df, keys, ["site"]).count() == len(frame) - inside
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_folds_differ_by_one(df):
    sizes = [r["count"] for r in resample.folds(df, ["id"], 4).groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_split_is_disjoint_and_half(df):
    split = resample.split_sites(df, "site", 9)
    train, test = resample.development_rows(df, split, "site")
    a, b = ({r.site for r in part.select("site").distinct().collect()} for part in (train, test))
    assert not a & b and len(a) == 3 and len(b) == 4


def test_sample_size(df, frame):
    got = resample.sample_per_group(df, ["site"], ["id"], 100, 2).groupBy("site").count().toPandas().set_index("site")["count"]
    assert got.to_dict() == frame.groupby("site").size().clip(upper=100).to_dict()


def test_spread_places_equal_linspace(spark):
    rng = np.random.default_rng(0)
    pairs = [(n, p) for n in (1, 2, 3, 7, 10, 50, 101, 137, 250) for p in {1, 2, n // 3, n // 2, n - 1, n} if 0 < p <= n]
    pairs += [(int(n), int(rng.integers(1, n + 1))) for n in rng.integers(2, 400, 60)]
    rows = [(g, i, int(i < p)) for g, (n, p) in enumerate(pairs) for i in range(n)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["g", "id", "y"]))
    out = resample.spread_order(df, ["g"], ["id"], "y", 1).toPandas()
    for g, part in out.groupby("g"):
        n, p = pairs[g]
        want = np.linspace(0, n - 1, p).astype(int) if p > 1 else np.array([0])
        assert sorted(part.place) == list(range(n)), pairs[g]
        assert sorted(part.place[part.y == 1]) == sorted(want), pairs[g]


def test_spread_without_outcomes(spark):
    df = spark.createDataFrame([(1, i, 0) for i in range(5)], "g int, id int, y int")
    assert sorted(r.place for r in resample.spread_order(df, ["g"], ["id"], "y", 1).collect()) == list(range(5))


def test_site_order_has_every_site_once_per_replicate(df):
    out = resample.site_order(df, "site", 3, 4, 1).toPandas()
    for _, g in out.groupby("b"):
        assert sorted(g.site) == [0, 1, 2, 4, 5, 6] and sorted(g.n) == [1, 2, 3, 4, 5, 6]


def test_interval_join_equals_filter(spark):
    rng = np.random.default_rng(1)
    base = pd.Timestamp("2020-01-01")
    events = pd.DataFrame({"k": rng.integers(0, 3, 400), "t": [base + pd.Timedelta(minutes=int(m)) for m in rng.integers(-3000, 9000, 400)]})
    spans = pd.DataFrame({"k": [0, 1, 1], "a": [base, base + pd.Timedelta(hours=5), base - pd.Timedelta(hours=30)], "b": [base + pd.Timedelta(days=3), base + pd.Timedelta(hours=6), base]})
    left, right = spark.createDataFrame(events), spark.createDataFrame(spans)
    got = joins.interval_join(left, right, ["k"], "t", "a", "b").count()
    both = events.merge(spans, on="k")
    assert got == ((both.t > both.a) & (both.t < both.b)).sum()
