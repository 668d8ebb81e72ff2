"""Runs of words against a plain search over all periods; transforms against plain sums."""

import hashlib
import random
import re
from zlib import crc32

import numpy as np
import pytest
from corpus import awkward, frame, words

from sitewise.llm import periods


def plain_runs(spoken):
    found = {}
    for q in range(1, len(spoken) // 2 + 1):
        i = 0
        while i + q < len(spoken):
            first = i
            while i + q < len(spoken) and spoken[i] == spoken[i + q]:
                i += 1
            if i > first and i - first + q >= max(12, 2 * q):
                found.setdefault((first, i - first + q), q)
            i += i == first
    return sorted((s, n, q) for (s, n), q in found.items())


def plain(rows):
    out = []
    for doc, text in rows:
        spoken = re.findall("[^\x20\x09-\x0d]+", text or "")
        n, h = len(spoken), crc32(str(doc).encode())
        if doc is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            spoken = [spoken[i if i < a else a + (i - a) % p] for i in range(n)]
        runs = sorted(plain_runs(spoken), key=lambda r: (r[0], r[2]))
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        kept = [w for i, w in enumerate(spoken) if not any(s + q <= i < s + m for s, m, q in runs)]
        shown = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
        hashes = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{m},{q}\n" for s, m, q in runs), " ".join(kept))]
        out.append((doc, len(runs), *shown, *hashes, n, n - len(kept)))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(5)
    rows = awkward() + [(1000 + i, words(i, rng.randrange(1, 300), rng.choice([2, 3, 60]))) for i in range(120)]
    rows += [(2000, "la " * 500), (2001, "a b c d e f g " * 40 + "x " * 30), (2002, "one two " * 6), (2003, "one two " * 5 + "one"), (2004, ("p q " * 8 + "r ") * 5)]
    return rows + [(2005, (words(9, 400, 5000) + " ") * 3), (2006, "a b " * 12), (2007, "a\x85 " * 12), (-10, "z " * 40)]


def check(spark, rows):
    got = [tuple(r) for r in periods.periodic_runs(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == plain(rows)


def test_corpus(spark):
    rows = corpus()
    assert any(crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i is not None)
    check(spark, rows)


def test_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(periods, "PIECE", 40)
    monkeypatch.setattr(periods, "TOGETHER", 16)
    check(spark, corpus())


def test_empty_table(spark):
    assert periods.periodic_runs(frame(spark, [])).collect() == []


def test_nothing_changed(spark):
    got = periods.periodic_runs(frame(spark, [(i, words(i, 50, 5000)) for i in range(40)]), change=lambda n, i: None).collect()
    assert all(r.n_runs == 0 and r.n_dropped == 0 and r.length is None for r in got)


@pytest.mark.parametrize("together", [1 << 16, 64])
def test_runs_of_joined_texts(monkeypatch, together):
    monkeypatch.setattr(periods, "TOGETHER", together)
    rng = random.Random(8)
    for _ in range(150):
        joined, owner, want = [], [], []
        for d in range(rng.randrange(1, 4)):
            size, n = rng.choice([1, 2, 2, 3, 5, 40]), rng.choice([0, 5, 12, 13, 30, 100, 260])
            spoken = [rng.randrange(size) for _ in range(n)]
            if n and rng.random() < 0.5:
                a = rng.randrange(n)
                p = 1 + (n - a) // (2 + rng.randrange(8))
                spoken = [spoken[i if i < a else a + (i - a) % p] for i in range(n)]
            want += [(s + len(joined), m, q) for s, m, q in plain_runs(spoken)]
            joined += [*spoken, 1000 + d]
            owner += [d] * (n + 1)
        got = periods.find_runs(np.array(joined), np.array(owner))
        assert list(zip(*(x.tolist() for x in got), strict=True)) == sorted(want, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize(("block", "window"), [(2, 7), (4, 11), (8, 23), (64, 191)])
def test_squared_differences(block, window):
    rng = np.random.default_rng(block)
    a, b = (rng.integers(0, 1 << 31, (3, n)).astype(np.uint64) for n in (block, window))
    b[1, 3 : 3 + block] = a[1]
    want = [[sum((int(x) - int(y)) ** 2 for x, y in zip(r, s[i : i + block], strict=True)) % periods.PRIME for i in range(window - block + 1)] for r, s in zip(a, b, strict=True)]
    assert periods.squared_differences(a, b).tolist() == want and want[1][3] == 0


def test_false_zeros_find_nothing(monkeypatch):
    monkeypatch.setattr(periods, "squared_differences", lambda a, b: np.zeros((len(a), b.shape[1] - a.shape[1] + 1), np.uint64))
    rng = random.Random(2)
    for size in (2, 3, 30):
        spoken = [rng.randrange(size) for _ in range(120)]
        got = periods.find_runs(np.array([*spoken, 99]), np.zeros(121, np.int64))
        assert list(zip(*(x.tolist() for x in got), strict=True)) == sorted(plain_runs(spoken), key=lambda r: (r[0], r[2]))
