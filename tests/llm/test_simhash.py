"""SimHash components against all pairs, masks against all small differences."""

import random
from itertools import combinations

import xxhash
from corpus import awkward, edited, frame, words

from sitewise.llm import simhash


def plain_print(text):
    spoken = (text or "").encode().lower().split()
    runs = [b" ".join(spoken[i : i + 3]) for i in range(max(1, len(spoken) - 2))] if spoken else []
    hashes = [xxhash.xxh64_intdigest(r, seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(prints):
    """Position -> positions that can be reached."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(prints)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            root[find(a)] = find(b)
    return [find(i) for i in range(len(prints))]


def plain(rows):
    prints = [plain_print(t) for _, t in rows]
    groups = grouped(prints)
    least = {g: min((rows[i][0] for i in range(len(rows)) if groups[i] == g and rows[i][0] is not None), default=None) for g in groups}
    return sorted(((rows[i][0], f"{prints[i]:016x}", least[groups[i]]) for i in range(len(rows))), key=str)


def check(spark, rows):
    assert sorted((tuple(r) for r in simhash.simhash_components(frame(spark, rows)).collect()), key=str) == plain(rows)


def corpus():
    base = words(7, 900, 5000)
    return awkward() + [(100 + i, edited(base, i, i % 4)) for i in range(60)] + [(200, "A b"), (201, "a B"), (202, "a\vb"), (203, "\x85 a"), (204, "x " * 5)]


def test_components(spark):
    rows = corpus()
    check(spark, rows)
    ids = {i: c for i, _, c in plain(rows)}
    assert len({ids[100 + i] for i in range(60)}) < 60


def test_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL", 2)
    check(spark, corpus())


def test_pieces(monkeypatch):
    texts = [t for _, t in awkward()] + ["a b c d", "a b", "  a  ", "éa b é"]
    monkeypatch.setattr(simhash, "PIECE", 5)
    assert [simhash.fingerprint((t or "").encode()) for t in texts] == [plain_print(t) for t in texts]


def test_empty_tables(spark):
    assert simhash.simhash_components(frame(spark, [])).collect() == []
    assert [tuple(r) for r in simhash.simhash_components(frame(spark, [(None, None)])).collect()] == [(None, "0" * 16, None)]


def test_masks_cover():
    rng = random.Random(0)
    for radius in (1, 2, 3):
        found = simhash.masks(radius)
        assert len(found) == 2 ** (radius + 1) - 1
        flips = [sum(1 << b for b in bits) for bits in combinations(range(64), radius)]
        for flip in rng.sample(flips, min(len(flips), 3000)):
            assert any(not flip & m for m in found)


def test_links_of_a_dense_cloud(spark, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(simhash, "SMALL", 8)
    numbers = {rng.getrandbits(64) for _ in range(20)}
    for x in list(numbers)[:4]:
        for _ in range(120):
            y = x
            for b in rng.sample(range(64), rng.randrange(1, 7)):
                y ^= 1 << b
            numbers.add(y)
    numbers = sorted(numbers)
    links = simhash.linked(spark.createDataFrame([(simhash.signed(x),) for x in numbers], "fingerprint bigint")).collect()
    place = {simhash.signed(x): i for i, x in enumerate(numbers)}
    want = {(a, b) for a, b in combinations(range(len(numbers)), 2) if (numbers[a] ^ numbers[b]).bit_count() <= 2}
    got = {tuple(sorted((place[r.a], place[r.b]))) for r in links}
    assert got <= want

    def reached(edges):
        root = list(range(len(numbers)))
        for _ in range(len(numbers)):
            changed = False
            for a, b in edges:
                low = min(root[a], root[b])
                changed |= root[a] != low or root[b] != low
                root[a] = root[b] = low
            if not changed:
                break
        return root

    assert reached(got) == reached(want)
