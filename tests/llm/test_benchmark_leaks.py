"""Containment of items against counting shingles by hand."""

import re

import pytest
from corpus import FOLD, awkward, edited, frame, shingle_counts, words

from sitewise.llm import decontaminate as leaks
from sitewise.llm.decontaminate import search, without_leaks

ITEMS = [(1, words(70, 12)), (2, words(71, 40)), (3, words(72, 70)), (4, words(73, 7)), (5, "just three words"), (6, "word"), (7, None), (8, "..."), (9, words(72, 70)), (None, words(74, 33))]
DOCS = awkward() + [
    (50, words(80, 500, 90_000) + " " + words(70, 12) + " " + words(81, 400, 90_000)),
    (51, words(82, 30, 90_000) + "\n" + edited(words(71, 40), 1, 1) + "! " + words(83, 3000, 90_000)),
    (52, words(71, 40).upper()), (53, words(84, 300, 90_000) + " " + words(72, 70)[:200] + " zz " + words(72, 70)[200:] + " " + words(85, 10_000, 90_000)),
    (54, "These are Just three, words here"), (55, words(73, 7)), (56, words(74, 33) + " tail"), (57, "a word"), (None, words(70, 12)), (58, words(70, 11)),
]


def spoken_words(text):
    return re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", (text or "").translate(FOLD))


def plain(least=0.8, docs=None, items=None):
    out = []
    for item, text in items or ITEMS:
        spoken = spoken_words(text)
        own = set(shingle_counts(text, min(5, max(1, len(spoken)))))
        for doc, body in docs or DOCS:
            held = spoken_words(body)
            k = min(5, len(spoken))
            there = {tuple(held[j : j + k]) for j in range(len(held) - k + 1)} if k else set()
            if own and len(own & there) / len(own) >= least:
                out.append((doc, item, len(own & there) / len(own)))
    return sorted(out, key=str)


def items(spark):
    return spark.createDataFrame(ITEMS, "item_id bigint, text string")


def test_items_are_found(spark):
    got = sorted((tuple(r) for r in search(frame(spark, DOCS), items(spark)).collect()), key=str)
    assert got == plain() and len(got) > 8


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK", 300)
    got = sorted((tuple(r) for r in search(frame(spark, DOCS), items(spark)).collect()), key=str)
    assert got == plain()


def test_documents_with_items_go(spark):
    docs = frame(spark, DOCS)
    kept = without_leaks(docs, items(spark))
    want = [(d, t) for d, t in DOCS if not plain(docs=[(d, t)])]
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("docs, rows", [([], ITEMS), (DOCS[:3], []), ([], [])])
def test_empty_tables(spark, docs, rows):
    table = spark.createDataFrame(rows, "item_id bigint, text string")
    assert search(frame(spark, docs), table).collect() == []
    assert without_leaks(frame(spark, docs), table).count() == len(docs)
