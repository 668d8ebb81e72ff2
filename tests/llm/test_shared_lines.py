"""Line dedup against counting by hand; the filter; undoing insertions."""

import hashlib
from collections import Counter

import numpy as np
from corpus import FOLD, awkward, frame

from sitewise.llm import lines
from sitewise.llm.lines import CuckooFilter, LineIndex, drop_shared_lines
from sitewise.session import durable


def key(line):
    return line.strip(" \t\n\v\f\r").translate(FOLD)


def plain(rows, least):
    seen = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for doc, text in rows:
        split = (text or "").split("\n")
        kept = [x for x in split if not key(x) or seen[key(x)] < least]
        out.append((doc, "\n".join(kept), len(split), len(split) - len(kept)))
    return sorted(out, key=str)


def got(frame_):
    return sorted(((r.row.doc_id, r.row.text, r.n_lines, r.n_dropped) for r in frame_.collect()), key=str)


CORPUS = [(i, f"Header\nown line {i}\n\n  FOOTER \r\nshared {i % 7}\nHeader") for i in range(30)] + awkward()


def test_shared_lines_go(spark):
    assert got(drop_shared_lines(frame(spark, CORPUS), 10)) == plain(CORPUS, 10)
    assert got(drop_shared_lines(frame(spark, CORPUS), 2)) == plain(CORPUS, 2)


def test_all_columns_stay(spark):
    docs = frame(spark, CORPUS)
    assert drop_shared_lines(docs).select("row.*").columns == docs.columns


def test_many_shards_and_tasks(spark, monkeypatch):
    monkeypatch.setattr(lines, "SHARD_KEYS", 3)
    monkeypatch.setattr(lines, "TASK_LINES", 10)
    assert got(drop_shared_lines(frame(spark, CORPUS), 2)) == plain(CORPUS, 2)


def test_insertions_are_undone_by_deletions(spark):
    first, second = frame(spark, CORPUS[:18]), frame(spark, CORPUS[18:])
    one = LineIndex.empty(spark, 5).insert(first)
    both = one.insert(second)
    back = both.delete(second)
    state = lambda index: sorted((bytes(r.digest), r.n) for r in index.counts.collect())
    assert state(back) == state(one) != state(both)
    assert got(both.strip(frame(spark, CORPUS))) == plain(CORPUS, 5)
    assert got(back.strip(first)) == got(one.strip(first)) == plain(CORPUS[:18], 5)
    assert back.delete(first).counts.isEmpty() and back.delete(first).filters.isEmpty()


def test_empty_index_and_table(spark):
    docs = frame(spark, CORPUS[:3])
    assert got(LineIndex.empty(spark).strip(docs)) == plain(CORPUS[:3], 10**9)
    assert drop_shared_lines(frame(spark, [])).collect() == []


def test_filter_holds_what_was_put_in_and_forgets_what_was_taken_out():
    digests = np.frombuffer(b"".join(hashlib.md5(str(i).encode()).digest() for i in range(4000)), np.uint8).reshape(-1, 16)
    made = CuckooFilter.holding(digests[:2000])
    assert made.contains(digests[:2000]).all() and made.contains(digests[2000:]).mean() < 0.01
    assert all(made.delete(d) for d in digests[:1000]) and made.contains(digests[1000:2000]).all()
    assert made.contains(digests[:1000]).mean() < 0.01
    assert (CuckooFilter.load(made.dump()).table == made.table).all()


def test_probe_reads_written_lines(spark):
    docs = frame(spark, CORPUS)
    held = durable(lines.document_lines(docs, 1))
    index = LineIndex.empty(spark, 10).changed(held, 1)
    shared = {bytes(r.digest) for r in index.shared(held).collect()}
    assert shared == {hashlib.md5(k.encode()).digest() for k in ("header", "footer")}
