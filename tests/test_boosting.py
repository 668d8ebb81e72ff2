"""Boosted trees against a plain version, row by row, and the distributed way against the one in a task."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from sitewise.operators import boosting
from sitewise.operators.boosting import Boosting, boosted, boosted_folds, fold_sets
from sitewise.queries import fits
from sitewise.queries.frames import Frames

SCHEMA = "site string, id bigint, y int, train boolean, a double, b double, `c d` double, `row` string, margin int"
FEATURES = ["a", "b", "`c d`"]
HOW = Boosting(trees=7, depth=3, step=0.3, seed=5)


def rows_of(seed, sizes):
    rng = random.Random(seed)
    out = []
    for site, n in sizes.items():
        for i in range(n):
            a, b, c = rng.gauss(0, 1), rng.choice([1.0, 2.0, 3.0, None]), rng.choice([rng.random(), None, float("nan")])
            y = int(rng.random() < 1 / (1 + math.exp(-2 * a - (2 if b is None else -1))))
            out.append((site, 1000 * len(site or "") + i, None if i % 29 == 28 else y, None if i % 31 == 30 else i % 5 > 0, a if i % 11 else None, b, c, "x", 1))
    return out


def limits(values):
    """Limits for few values: each but the least (quantiles of few values are the values)."""
    return sorted(set(values))


def plain(rows, edges, draws, how):
    """Probability per row of one set, with nested dicts for trees and a loop over rows and limits."""
    def missing(x):
        return x is None or math.isnan(x)

    def bin_of(x, e):
        return 0 if missing(x) else 1 + sum(v <= x for v in e)

    bins = [[bin_of(r[4 + f], edges[f]) for f in range(3)] for r in rows]
    margin = [0.0] * len(rows)
    for t in range(how.trees):
        drawn = boosting.sampled(np.array([d % (1 << 64) for d in draws], np.uint64), t, how)
        columns = [int(c) for c in boosting.seen_columns(3, t, how)]
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g = [round((p[i] - (r[2] or 0)) * 2**24) for i, r in enumerate(rows)]
        h = [round(p[i] * (1 - p[i]) * 2**24) for i in range(len(rows))]

        def node(members, depth):
            total_g, total_h = sum(g[i] for i in members), sum(h[i] for i in members)
            value = -how.step * (total_g / 2**24) / (total_h / 2**24 + how.ridge)
            best = (1e-6, None)
            for c in columns if depth < how.depth else []:
                for cut in range(1, boosting.BINS):
                    for side in (True, False):
                        left = [i for i in members if (side if bins[i][c] == 0 else bins[i][c] <= cut)]
                        lg, lh = sum(g[i] for i in left) / 2**24, sum(h[i] for i in left) / 2**24
                        rg, rh = total_g / 2**24 - lg, total_h / 2**24 - lh
                        if lh < how.least or rh < how.least:
                            continue
                        gain = lg**2 / (lh + how.ridge) + rg**2 / (rh + how.ridge) - (total_g / 2**24) ** 2 / (total_h / 2**24 + how.ridge)
                        if gain > best[0]:
                            best = (gain, (c, cut, side, left))
                    if cut > max(b[c] for b in bins):
                        break
            if best[1] is None:
                return value
            c, cut, side, left = best[1]
            return (c, cut, side, node(left, depth + 1), node([i for i in members if i not in set(left)], depth + 1))

        tree = node([i for i, r in enumerate(rows) if r[3] and r[2] is not None and drawn[i]], 0)
        for i, b in enumerate(bins):
            at = tree
            while isinstance(at, tuple):
                c, cut, side, left, right = at
                at = left if (side if b[c] == 0 else b[c] <= cut) else right
            margin[i] += at
    return [1 / (1 + math.exp(-m)) for m in margin]


def test_trees_equal_plain_ones(spark):
    rows = rows_of(1, {"one": 150, None: 60, "": 25})
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.site, r.id): r.p for r in boosted(df, "site", ["id"], "y", FEATURES, "train", HOW).collect()}
    edges = boosting.bin_edges(df, FEATURES)
    draws = {r.id: r.d for r in df.select("id", F.xxhash64("id").alias("d")).collect()}
    assert len(got) == len(rows)
    for site in ("one", None, ""):
        own = [r for r in rows if r[0] == site]
        want = plain(own, edges, [draws[r[1]] for r in own], HOW)
        np.testing.assert_allclose([got[site, r[1]] for r in own], want, atol=1e-9)


def test_large_sets_give_the_same_trees(spark, monkeypatch):
    df = spark.createDataFrame(rows_of(2, {"one": 400, None: 150, "": 90, "small": 9}), SCHEMA).repartition(5)
    whole = {(r.site, r.id): r.p for r in boosted(df, "site", ["id"], "y", FEATURES, "train", HOW).collect()}
    monkeypatch.setattr(boosting, "TASK_CELLS", 60)
    monkeypatch.setattr(boosting, "BLOCK", 3)
    monkeypatch.setattr(boosting, "TOGETHER", 2)
    apart = {(r.site, r.id): r.p for r in boosted(df, "site", ["id"], "y", FEATURES, "train", HOW).collect()}
    assert whole.keys() == apart.keys() and len(set(whole.values())) > 100
    np.testing.assert_allclose([apart[k] for k in whole], list(whole.values()), atol=1e-12)


def test_large_sets_from_cells_and_from_levels_are_the_same(spark, monkeypatch):
    """Trees of equal gains may not depend on the way; a tree is one exchange where its cells are few."""
    df = spark.createDataFrame(rows_of(6, {"one": 300, None: 120}), SCHEMA).repartition(3)
    monkeypatch.setattr(boosting, "TASK_CELLS", 60)
    got, levels = {}, []
    by_levels = boosting._tree_by_levels
    monkeypatch.setattr(boosting, "_tree_by_levels", lambda *a: levels.append(limit) or by_levels(*a))
    for limit in (1 << 16, 0):
        monkeypatch.setattr(boosting, "CELLS", limit)
        got[limit] = {(r.site, r.id): r.p for r in boosted(df, "site", ["id"], "y", FEATURES, "train", HOW).collect()}
    assert set(levels) == {0} and got[0] == pytest.approx(got[1 << 16], abs=1e-12)


def test_rows_of_equal_bins_are_grown_as_one(monkeypatch):
    """The work of a tree is bounded by the bins of its columns, not by the rows; the margins are those of the rows alone."""
    rng = np.random.default_rng(8)
    n, how = 5000, Boosting(trees=6, depth=4, step=0.3)
    bins = np.stack([rng.integers(0, 40, n), rng.integers(0, 20, n), rng.integers(0, 3, n), np.zeros(n, int)], axis=1).astype(np.uint8)
    y, weight, row = (rng.random(n) < bins[:, 0] / 40).astype(float), rng.random(n) < 0.8, rng.integers(0, 1 << 62, n).astype(np.uint64)
    monkeypatch.setattr(boosting, "PIECE", 700)
    sizes, grown = [], boosting.grown
    monkeypatch.setattr(boosting, "grown", lambda bins, *rest: sizes.append(len(bins)) or grown(bins, *rest))
    got = boosting.grow(bins, y, weight, row, how)
    assert max(sizes) <= 800 and len(set(got)) > 50
    monkeypatch.setattr(boosting, "CELLS", 0)
    np.testing.assert_array_equal(boosting.grow(bins, y, weight, row, how), got)
    assert max(sizes) > 2500 and len(sizes) == 12


def test_many_columns_have_more_combinations_than_a_number_holds():
    assert boosting.combinations(np.arange(40), np.full(40, 256)) == 256**40


def test_columns_keep_their_names_and_repeated_rows_stay(spark):
    rows = rows_of(3, {"one": 40})
    df = spark.createDataFrame(rows + rows[:3], SCHEMA)
    got = boosted(df, "site", ["id"], "y", FEATURES, "train", HOW, out="chance")
    assert got.columns == [*df.columns, "chance"] and got.count() == 43


def test_empty_tables_one_class_and_no_training_rows(spark):
    rows = rows_of(4, {"one": 40})
    assert boosted(spark.createDataFrame([], SCHEMA), "site", ["id"], "y", FEATURES, "train", HOW).collect() == []
    idle = spark.createDataFrame([(*r[:3], False, *r[4:]) for r in rows], SCHEMA)
    assert {r.p for r in boosted(idle, "site", ["id"], "y", FEATURES, "train", HOW).collect()} == {0.5}
    sure = spark.createDataFrame([(*r[:2], 1, True, *r[4:]) for r in rows], SCHEMA)
    assert {r.p > 0.7 for r in boosted(sure, "site", ["id"], "y", FEATURES, "train", HOW).collect()} == {True}


def test_unseen_rows_are_told_apart(spark):
    rng = random.Random(9)
    rows = []
    for i in range(3000):
        a, b = rng.random(), rng.random()
        rows.append(("s", i, int((a > 0.5) != (b > 0.5)), i % 4 > 0, a, b, None, "", 0))
    got = boosted(spark.createDataFrame(rows, SCHEMA), "site", ["id"], "y", FEATURES, "train", Boosting(trees=60, depth=4, step=0.2, columns=1.0)).filter("not train").collect()
    assert np.mean([(r.p > 0.5) == r.y for r in got]) > 0.95


@pytest.mark.parametrize("width", [1, 2, 10])
def test_shares_of_rows_and_columns(width):
    how = Boosting()
    seen = [boosting.seen_columns(width, t, how) for t in range(400)]
    assert {len(s) for s in seen} == {max(1, int(0.7 * width))}
    assert min(np.bincount(np.concatenate(seen), minlength=width)) > 0.4 * 400 * len(seen[0]) / width
    drawn = [boosting.sampled(np.arange(5000, dtype=np.uint64), t, how).mean() for t in range(5)]
    assert max(abs(d - 0.8) for d in drawn) < 0.02 and len(set(drawn)) > 1


@pytest.mark.parametrize("rows", [3, 60, 4000])
def test_trees_of_two_columns_do_not_go_over_their_cells_at_each_level(monkeypatch, rows):
    """Sums of a node's bins are differences of running sums; with a third column that cannot be split the cells are gone over."""
    rng = np.random.default_rng(rows)
    how, over = Boosting(depth=6, least=0.1), []
    histograms = boosting.histograms
    monkeypatch.setattr(boosting, "histograms", lambda *a: over.append(1) or histograms(*a))
    for width, few in ((200, 9), (30, 2), (1, 40)):
        bins = np.stack([rng.integers(0, width, rows), np.zeros(rows, int), rng.integers(few > 2, few, rows)], axis=1).astype(np.uint8)
        g, h = np.rint(rng.normal(0, 3, rows)) * 2**22, np.full(rows, 2.0**22)
        got = boosting.grown(bins, np.array([0, 2]), g, h, how)
        assert not over
        want = boosting.grown(bins, np.array([0, 1, 2]), g, h, how)
        assert over
        over.clear()
        split = want.feature >= 0
        np.testing.assert_array_equal(got.feature, want.feature)
        np.testing.assert_array_equal(got.bin[split], want.bin[split])
        np.testing.assert_array_equal(got.missing_left[split], want.missing_left[split])
        bins_of = np.array([width + 1, 1, few + 1])
        every = boosting.cells(3, np.array([0, 2]), bins_of)
        np.testing.assert_array_equal(boosting.cell_values(got, np.array([0, 2]), bins_of, 6), want.value[want.leaves(every, 6)])


def test_each_set_is_a_task_of_its_own(spark):
    sites = [None, *range(12)]
    rows = spark.createDataFrame([(s, 100 * k + i) for k, s in enumerate(sites) for i in range(3 + k)], "model int, row bigint")
    sizes = rows.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.expr("model <=> 11").alias("large"))

    def task(table):
        return pa.table({"n": [table.num_rows], "task": [TaskContext.get().partitionId()]})

    got = sorted((r.task, r.n) for r in boosting._dealt(rows, sizes).applyInArrow(task, "n bigint, task bigint").collect())
    assert got == list(enumerate(range(14, 2, -1)))


def test_draws_of_pieces_are_those_of_all_rows():
    row = np.random.default_rng(3).integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    for share in (0.3, 0.8, 1.0):
        how = Boosting(rows=share)
        draws = boosting.Draws(row, how)
        for t in range(4):
            draws.start(t)
            for p in (slice(0, 1000), slice(1000, 2999), slice(2999, 3000)):
                np.testing.assert_array_equal(draws.seen(p), np.flatnonzero(boosting.sampled(row[p], t, how)))


def test_margins_do_not_depend_on_what_is_kept_between_trees(monkeypatch):
    rng = np.random.default_rng(11)
    n, how = 4000, Boosting(trees=12, depth=5, step=0.3)
    bins = np.stack([rng.integers(0, k, n) for k in (50, 9, 4, 30)], axis=1).astype(np.uint8)
    y, weight, row = rng.integers(0, 3, n) / 2, rng.random(n) < 0.7, rng.integers(0, 1 << 62, n).astype(np.uint64)
    want = boosting.grow(bins, y, weight, row, how)
    for name, value in (("KNOWN", 1), ("PIECE", 111), ("CELLS", 300), ("CELLS", 0)):
        with monkeypatch.context() as m:
            m.setattr(boosting, name, value)
            np.testing.assert_array_equal(boosting.grow(bins, y, weight, row, how), want)


@pytest.mark.parametrize("large", [False, True])
def test_left_out_folds_have_the_chances_of_sets_of_their_own(spark, monkeypatch, large):
    rows = [(*r, r[1] % 3 if r[1] % 17 else None) for r in rows_of(12, {"one": 200, None: 70})]
    df = spark.createDataFrame(rows + rows[:4], SCHEMA + ", fold int").repartition(3)
    sets = df.withColumn("held", F.explode(F.array(*map(F.lit, range(3))))).withColumn("train", F.col("held") != F.col("fold"))
    want = boosted(sets, "held", ["site", "id"], "y", FEATURES, "train", HOW).filter("not train")
    if large:
        monkeypatch.setattr(boosting, "TASK_CELLS", 60)
        monkeypatch.setattr(boosting, "BLOCK", 3)
    got = boosted_folds(*fold_sets(df, "fold", 3, ["site", "id"], "y", FEATURES), HOW)
    assert got.columns == ["site", "id", "fold", "y", "p"]
    listed = [sorted(((r.site or "", r.id, r.fold, -1 if r.y is None else r.y, round(r.p, 9)) for r in x.collect())) for x in (got, want)]
    assert listed[0] == listed[1] and len(listed[0]) == sum(r[-1] is not None for r in rows + rows[:4])


def test_folds_cut_each_stay_into_bins_once(spark, folder, monkeypatch):
    """The rows were repeated for each fold before they were written and cut, and all of them came back."""
    seen, written = {}, boosting.durable
    monkeypatch.setattr(boosting, "durable", lambda df, label: [d := written(df, label), seen.update({label: d.count()})][0])
    monkeypatch.setattr(fits, "TREES", HOW)
    fr = Frames(spark, folder)
    assert [r.model for r in fits.cv_summary_models(fr).orderBy("model").collect()] == ["l2", "trees"]
    assert seen == {"boosting-rows": fr.feat.count(), "boosting-sizes": 5, "boosting-margins": fr.feat.count()}


def test_sets_of_a_million_rows_take_no_job_a_tree(spark, monkeypatch):
    """The trees of a set depend on each other: what its rows cost a task is far less than a pass over the cluster for each."""
    monkeypatch.setattr(boosting, "_grow_together", lambda *a: pytest.fail("a job a tree"))
    rows = spark.range(1_100_000).selectExpr("id", "int(id % 3 = 0) as y", *[f"double(id % {m}) as f{m}" for m in (7, 11, 13, 17)], "int(id % 2) as fold")
    names = ["f7", "f11", "f13", "f17"]
    whole = boosting.boosted(rows.withColumn("model", F.lit(0)).withColumn("train", F.lit(True)), "model", ["id"], "y", names, "train", Boosting(trees=2))
    assert whole.filter("p > 0").count() == 1_100_000
    held = boosting.boosted_folds(*boosting.fold_sets(rows, "fold", 2, ["id"], "y", names), Boosting(trees=2))
    assert held.select("id").distinct().count() == 1_100_000
