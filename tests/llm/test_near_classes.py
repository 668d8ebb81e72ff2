"""Near duplicates against all pairs, and signatures against weighted Jaccard similarity."""

import numpy as np
import pyarrow as pa
from corpus import awkward, edited, frame, shingle_counts, words

from pyspark.sql import functions as F

from sitewise.llm import near
from sitewise.llm.common import texts, with_row_key


def plain(rows):
    counts = [shingle_counts(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if counts[a] and counts[b] and sum((counts[a] & counts[b]).values()) >= 0.8 * sum((counts[a] | counts[b]).values()):
                root[find(a)] = find(b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    out = []
    for own in groups.values():
        names = [rows[i][0] for i in own if rows[i][0] is not None]
        out += [(rows[i][0], min(names, default=None), len(own)) for i in own]
    return sorted(out, key=str), len(groups)


def corpus():
    base = words(10, 80, 5000)
    family = [(100 + i, edited(base, i, i % 6)) for i in range(30)]
    return awkward() + family + [(200 + i, words(i + 50, 40, 5000)) for i in range(20)] + [(300, "la " * 50), (301, "la " * 48), (302, "la " * 20)]


def check(spark, rows):
    want, classes = plain(rows)
    got = near.near_classes(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.class_id, r.class_size) for r in got), key=str) == want
    assert sum(r.kept for r in got) == classes
    assert all(r.doc_id == r.class_id for r in got if r.kept)


def test_classes(spark):
    check(spark, corpus())


def test_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(near, "SMALL", 2)
    monkeypatch.setattr(near, "TASK_NODES", 4)
    monkeypatch.setattr(near, "HUGE", 20)
    check(spark, corpus())


def test_one_of_each_keeps_columns(spark):
    docs = frame(spark, corpus())
    kept = near.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == plain(corpus())[1]


def test_equal_texts_without_words_are_one_class(spark):
    rows = [(1, None), (2, ""), (3, " "), (4, "..."), (5, "..."), (5, "..."), (None, ""), (6, "a b"), (7, "a b")]
    got = near.near_classes(frame(spark, rows), wordless=True).collect()
    want = [(1, 1, 3), (2, 1, 3), (3, 3, 1), (4, 4, 3), (5, 4, 3), (5, 4, 3), (None, 1, 3), (6, 6, 2), (7, 6, 2)]
    assert sorted(((r.doc_id, r.class_id, r.class_size) for r in got), key=str) == sorted(want, key=str)
    assert sorted(r.doc_id for r in got if r.kept) == [1, 3, 4, 6]
    assert sorted(r.doc_id for r in near.one_of_each(frame(spark, rows), wordless=True).collect()) == [1, 3, 4, 6]


def test_empty_tables(spark):
    assert near.near_classes(frame(spark, [])).collect() == []
    assert near.near_classes(frame(spark, [(1, None), (2, "")])).count() == 2


def test_registers_agree_as_often_as_multisets_overlap():
    rng = np.random.default_rng(0)
    miss = []
    for _ in range(200):
        e = np.unique(rng.integers(1, 2**62, 150).astype(np.uint64))
        a = rng.integers(1, 40, len(e))
        b = np.where(rng.random(len(e)) < 0.6, a, rng.integers(1, 40, len(e)))
        s = near.signatures(np.concatenate([e, e]), np.concatenate([a, b]), np.array([len(e), len(e)]))
        miss.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(miss)) < 0.012 and np.std(miss) < 0.08


def test_long_chain_is_one_class(spark):
    links = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(40)] + [(bytes([100]), bytes([101]))], "a binary, b binary")
    got = {(bytes(r.node), bytes(r["class"])) for r in near.components(links).collect()}
    assert got == {(bytes([i]), bytes([0])) for i in range(41)} | {(bytes([i]), bytes([100])) for i in (100, 101)}


def test_blocks_compare_texts_whatever_their_registers(monkeypatch):
    """Registers of no agreement at all must not keep similar texts apart; results equal the plain similarity."""
    monkeypatch.setattr(near, "READ", 3)
    base = words(10, 80, 5000)
    rows = [edited(base, i, i % 9) for i in range(24)] + ["la " * 50, "la " * 45]
    n, half = len(rows), len(rows) // 2
    counts = [shingle_counts(t) for t in rows]
    batch = pa.record_batch(
        [pa.array([1] * n, pa.int64()), pa.array([0] * n, pa.int32()), pa.array([0] * n, pa.int32()), pa.array([int(i >= half) for i in range(n)], pa.int32()),
         pa.array(range(n), pa.int64()), pa.array(range(n), pa.int64()), pa.array([sum(c.values()) for c in counts], pa.int64()),
         pa.array([np.full(near.SIZE, i, "<u2").tobytes() for i in range(n)], pa.binary()), pa.array(rows)],
        names=["a", "own", "other", "kind", "node", "class", "total", "marks", "text"],
    )
    got = [x for b in near._join_blocks(iter([batch])) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    similar = {(a, b) for a in range(half) for b in range(half, n) if sum((counts[a] & counts[b]).values()) >= 0.8 * sum((counts[a] | counts[b]).values())}
    assert got and set(got) <= similar

    def reach(links):
        root = list(range(n))
        for _ in range(n):
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert reach(got) == reach(similar)


def test_nodes_that_share_nothing_but_a_very_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(near, "SMALL", 2)
    monkeypatch.setattr(near, "HUGE", 3)
    one, two = words(10, 300, 5000), words(11, 300, 5000)
    rows = [(i, edited(one if i % 2 else two, i, 1)) for i in range(8)]
    keyed = with_row_key(texts(frame(spark, rows)))
    bands = F.concat(F.array(F.lit(7)), F.transform(F.sequence(F.lit(1), F.lit(near.BANDS - 1)), lambda b: F.col("doc_id") * 1000 + b)).cast("array<bigint>")
    nodes = keyed.select(F.col("doc_id").alias("node"), "k1", "k2", F.lit(296).cast("bigint").alias("total"), bands.alias("bands"), F.lit(bytes(2 * near.SIZE)).alias("marks"))
    got = near._link(nodes, keyed)
    assert got is not None and {(r.node, r["class"]) for r in got.collect()} == {(i, i % 2) for i in range(8)}
