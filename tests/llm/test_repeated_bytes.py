"""Repeated substrings and the suffix array under them, against plain counting."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from corpus import awkward, frame, words

from sitewise.llm import repeats, suffixes
from sitewise.llm.repeats import remove_repeats
from sitewise.llm.suffixes import Strings, repeated_windows, smaller_than_successor, suffix_array

ALPHABETS = [b"a", b"ab", b"abc", b"\x00a", b"abcdefgh", bytes(range(256))]


@pytest.mark.parametrize("tied", [1, 2, 20_000])
def test_windows_that_repeat(monkeypatch, tied):
    monkeypatch.setattr(suffixes, "TIED", tied)
    rng = random.Random(tied)
    for _ in range(200):
        length, letters = rng.choice([1, 2, 3, 5, 8]), rng.choice(ALPHABETS)
        strings = [bytes(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 8))]
        strings += strings[: rng.randint(0, 1)]
        groups = np.unique(np.sort([rng.randint(0, 2) for _ in strings]), return_inverse=True)[1]
        seen = Counter((g, s[i : i + length]) for s, g in zip(strings, groups, strict=True) for i in range(len(s) - length + 1))
        for s, g, marked in zip(strings, groups, repeated_windows(strings, groups, length), strict=True):
            assert list(marked) == [seen[g, s[i : i + length]] > 1 for i in range(len(s) - length + 1)]


def test_suffixes_are_in_order():
    rng = random.Random(7)
    strings = [bytes(rng.choice(b"ab") for _ in range(60)) for _ in range(4)]
    texts = Strings(strings, np.array([0, 0, 1, 1]))
    text = {int(f) + i: (int(g), s[i : i + 50]) for f, s, g in zip(texts.first, strings, [0, 0, 1, 1], strict=True) for i in range(len(s) + 1)}
    order = [text[x] for x in suffix_array(texts, 50).tolist()]
    assert order == sorted(order)
    ascending = smaller_than_successor(texts.symbols)
    assert all(ascending[int(f) + i] == (s[i:] < s[i + 1 :]) for f, s in zip(texts.first, strings, strict=True) for i in range(len(s)))


def plain(rows):
    seen = Counter(raw[i : i + 400] for raw in ((t or "").encode() for _, t in rows) for i in range(len(raw) - 399))
    out = []
    for doc, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 399):
            if seen[raw[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus():
    shared, other = words(90, 120, 9000), words(91, 90, 9000)
    rows = [(400 + i, f"{words(i + 500, 100, 9000)} {shared} {words(i + 600, 100, 9000)}") for i in range(12)]
    rows += [(500 + i, f"{words(i + 700, 30, 9000)} {other}é{i}") for i in range(3)]
    rows += [(600, "ab" * 400), (601, "z" * 399), (602, "z" * 401), (603, words(95, 300, 9000) + " " + words(95, 300, 9000)), (604, "世界" * 150)]
    return awkward() + rows


def got(spark, rows):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in remove_repeats(frame(spark, rows)).collect()), key=str)


def test_repeats_are_cut(spark):
    assert got(spark, corpus()) == plain(corpus())


def crowd():
    """More strips than one slice holds: copies with edits, one passage in many places, periodic texts, a passage at different distances."""
    base, shared = words(80, 260, 9000), words(81, 75, 9000)
    rows = []
    for i in range(150):
        spoken = base.split(" ")
        spoken[(i * 37) % len(spoken)] = f"x{i}"
        rows.append((1000 + i, " ".join(spoken)))
    rows += [(2000 + i, f"{words(i + 3000, i % 23, 9000)}{'é' * (i % 3)} {shared} {words(i + 5000, 9, 9000)}") for i in range(150)]
    return rows + [(3000 + i, "abc" * (140 + i)) for i in range(4)]


@pytest.mark.parametrize(("group", "size"), [(1500, 1500), (1500, 1 << 20), (1, 1)])
def test_large_groups(spark, monkeypatch, group, size):
    """Parts of large groups, windows of large groups of parts, and both with many slices, batches and tasks."""
    sizes = iter([size])
    monkeypatch.setattr(repeats, "GROUP", group)
    large = repeats._large_groups

    def parted(cut):
        monkeypatch.setattr(repeats, "GROUP", next(sizes))
        return large(cut)

    monkeypatch.setattr(repeats, "_large_groups", parted)
    rows = corpus() + crowd()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        assert got(spark, rows) == plain(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_a_strip_has_three_parts_however_many_share_its_anchor():
    """One anchor in the middle of strips that differ elsewhere: the parts grow with the strips, not with their square."""
    import pyarrow as pa

    rng = random.Random(7)
    core = rng.randbytes(16)
    anchor = int(repeats.gram_hashes(np.frombuffer(core, np.uint8)).view(np.int64)[0])
    for n in (5, 50, 500):
        texts = [rng.randbytes(384) + core + rng.randbytes(384) for _ in range(n)]
        table = pa.record_batch(
            [pa.array([anchor] * n), pa.array([b"%d" % i for i in range(n)]), pa.array([1] * n), pa.array(texts, pa.binary())], names=["anchor", "digest", "n", "strip"]
        )
        rows = [r for b in repeats._parts(iter([table])) for r in b.to_pylist()]
        assert len(rows) == 3 * n and sum(r["windows"] for r in rows) == 385 * n


def test_equal_parts_of_a_strip_travel_once():
    import pyarrow as pa

    raw = b"the same line over again, " * 30
    anchor = int(repeats.gram_hashes(np.frombuffer(raw, np.uint8)).view(np.int64)[0])
    table = pa.record_batch([pa.array([anchor]), pa.array([b"d"]), pa.array([1]), pa.array([raw], pa.binary())], names=["anchor", "digest", "n", "strip"])
    rows = [r for b in repeats._parts(iter([table])) for r in b.to_pylist()]
    places = sorted((start, r["windows"]) for r in rows for start in r["starts"])
    assert len(rows) <= 3 and len(places) > 10
    assert [a + n for a, n in places] == [a for a, _ in places[1:]] + [len(raw) - 399] and places[0][0] == 0


def test_window_hashes_depend_on_the_window_only():
    import pyarrow as pa

    rng = random.Random(4)
    shared = rng.randbytes(400)
    strips = [shared, rng.randbytes(30) + shared, rng.randbytes(700), rng.randbytes(5) + shared + rng.randbytes(9)]

    def hashes(chosen):
        table = pa.record_batch([pa.array([0] * len(chosen)), pa.array([b"d"] * len(chosen)), pa.array([1] * len(chosen)), pa.array(chosen, pa.binary())], names=["anchor", "digest", "n", "strip"])
        return [(r["h1"], r["h2"]) for b in repeats._window_hashes(iter([table])) for r in b.to_pylist()]

    every = hashes(strips)
    places = [0, 1 + 30, 1 + 31 + 301 + 5]
    assert len({every[p] for p in places}) == 1 and len(set(every)) == len(every) - 2 and hashes([shared]) == [every[0]]


def test_empty_tables(spark):
    assert got(spark, []) == [] and got(spark, [(1, None), (2, "")]) == plain([(1, None), (2, "")])
