"""Hard negatives against a plain search, and products of residues against Python's integers."""

import math
import random

import numpy as np
import pytest

from sitewise.llm import negatives
from sitewise.llm.queries import embedding_negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int, `row` string, anchor string, score string, `a.b` int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", None, "s", 1) for r in rows], SCHEMA)


def plain(rows):
    kept = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [math.floor(256 * float(np.float32(x))) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for a, (i, v, label) in enumerate(kept):
        if i % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, other) for b, (j, w, other) in enumerate(kept) if b != a)
        for ps, p, _ in [s for s in scored if s[2] == label][:5]:
            own = [s for s in scored if s[2] != label and 50 * -ps <= 100 * -s[0] <= 95 * -ps][:3]
            out += [(i, p, r + 1, n, -ps, -ns) for r, (ns, n, _) in enumerate(own)]
    return sorted(out)


def vectors(n, seed, dims=6):
    rng = random.Random(seed)
    return [(i, [rng.choice([-0.5, -0.1, 0.2, 0.25, 0.6, 0.9]) for _ in range(dims)], rng.randrange(3)) for i in range(n)]


def check(spark, rows):
    got = sorted(tuple(r) for r in embedding_negatives(frame(spark, rows)).collect())
    assert got == plain(rows) and got


def test_ties_and_awkward_rows(spark):
    rows = vectors(160, 1)
    rows += [(None, [0.1] * 6, 1), (1000, None, 1), (1050, [0.1] * 6, None), (1100, [0.1, None], 1), (1150, [float("nan")] * 6, 1), (1200, [float("inf")] * 6, 2)]
    rows += [(1250, [], 1), (1300, [0.9], 1), (50, [0.9] * 6, 2), (50, [0.9] * 6, 2), (3, [0.9] * 6, 0), (-50, [0.6] * 6, 1), (1350, [0.3] * 9, 1)]
    check(spark, rows)


def test_small_blocks(spark, monkeypatch):
    for name, value in (("ANCHORS", 2), ("ROWS_AT_ONCE", 7), ("ANCHORS_AT_ONCE", 1), ("PARTITIONS", 3)):
        monkeypatch.setattr(negatives, name, value)
    check(spark, vectors(320, 2) + [(1000 + i, [0.6] * 6, i % 2) for i in range(40)])


def test_empty_tables(spark):
    assert embedding_negatives(frame(spark, [])).collect() == []
    assert embedding_negatives(frame(spark, [(1, [0.1], 1), (50, [], 1)])).collect() == []
    assert embedding_negatives(frame(spark, [(50, [0.5], 1), (51, [0.5], 2)])).collect() == []


def test_scores_that_do_not_fit(spark):
    with pytest.raises(ValueError, match="do not fit"):
        embedding_negatives(frame(spark, [(50, [1e20], 1), (51, [1e20], 1)]))


@pytest.mark.parametrize(("dims", "size"), [(1, 1), (5, 40), (64, 300), (64, 2**20), (3000, 10**6), (2, 2**28 - 1), (2500, 7)])
def test_products_are_exact(dims, size):
    rng = np.random.default_rng(dims)
    a, b = (rng.integers(-size, size + 1, (9, dims)) for _ in range(2))
    a[0], b[0], b[1] = size, size, -size
    primes = negatives.basis(dims * size**2)
    got = negatives.products(negatives.residues(a.astype(float), primes), negatives.residues(b.astype(float), primes), primes)
    assert got.tolist() == [[sum(x * y for x, y in zip(p, q)) for q in b.tolist()] for p in a.tolist()]
