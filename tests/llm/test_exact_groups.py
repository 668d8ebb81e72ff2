"""Exact groups against a plain grouping."""

import hashlib

from corpus import awkward, frame

from sitewise.llm.exact import exact_groups


def plain(rows):
    groups = {}
    for i, (doc, text) in enumerate(rows):
        body = (text or "").translate({ord(c): None for c in " \t\n\v\f\r"})
        groups.setdefault(body, []).append((-len(text or ""), doc is None, doc or 0, i))
    out = []
    for body, own in groups.items():
        own.sort()
        keep = rows[own[0][3]][0]
        for place, (_, _, _, i) in enumerate(own):
            out.append((rows[i][0], keep, len(own), place == 0, hashlib.sha256(body.encode()).hexdigest()))
    return out


def known(rows):
    return sorted(rows, key=str)


def test_groups_ties_nulls_and_repeated_rows(spark):
    rows = awkward()
    got = [tuple(r) for r in exact_groups(frame(spark, rows), digests=True).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert known(got) == known(plain(rows))


def test_equal_prefix_and_length(spark):
    rows = [(i, "p" * 100 + "abc"[i % 3]) for i in range(9)]
    got = exact_groups(frame(spark, rows)).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(i, i % 3, 3) for i in range(9)}


def test_empty_table(spark):
    assert exact_groups(frame(spark, []), digests=True).collect() == []


def test_most_rows_one_text(spark):
    rows = [(i, "hot" if i % 3 else f"text {i}") for i in range(3000)]
    got = {r.doc_id: r for r in exact_groups(frame(spark, rows)).collect()}
    assert len(got) == 3000 and got[1].group_size == 2000 and got[2].keep_id == 1 and got[3].group_size == 1
    assert sum(r.kept for r in got.values()) == 1001


def test_rows_alone_meet_no_join(spark):
    from sitewise.llm import exact

    met = []
    join = exact.keyed_join

    def counted(rows, keyed, on, weight, how="inner"):
        met.append((tuple(on), rows.count()))
        return join(rows, keyed, on, weight, how)

    exact.keyed_join = counted
    try:
        rows = [(i, "x" * (i + 1)) for i in range(500)] + [(1000, "pair"), (1001, "pa ir")]
        got = {r.doc_id: r for r in exact_groups(frame(spark, rows)).collect()}
    finally:
        exact.keyed_join = join
    assert len(got) == 502 and got[1001].keep_id == 1001 and not got[1000].kept and all(got[i].group_size == 1 and got[i].kept for i in range(500))
    assert dict(met)[("whole",)] < 10
