"""Benchmark items inside documents: MinHash search partitioned by size, then exact containment of five-word shingles.

Items are partitioned by their number of shingles, in powers of two.  For a partition of up to s shingles the documents are read as
overlapping windows of 2s shingles, one every s, so that an item lies whole in a window of like size, and a containment of 0.8 means a
Jaccard similarity of 0.19 or more.  Item and window are compared by ``FUNCTIONS`` minimum hashes, each a band of its own: a pair
misses all of them with probability 1e-6.  Every pair found is then judged on the whole document's shingles.

The benchmark is taken in blocks of bounded size; a block's index goes to every task, and documents are never shuffled.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, functions as F

from sitewise.llm.bytetext import batches, mix64, runs, shingles, text_bytes, word_hashes, word_spans
from sitewise.llm.common import in_small_batches, texts

WORDS, CONTAINED, FUNCTIONS = 5, 0.8, 64
#: Shingles per smallest block of a window; items with fewer are looked up by each of their shingles.
GRAIN = 8
#: Code points of items in one index.  An index takes some 30 bytes for each, and a longer item makes a larger one.
BLOCK = 4_000_000
_U = np.uint64
_ODD = mix64(np.arange(1, FUNCTIONS + 1, dtype=_U)) | _U(1)
#: Bits per key, at least, of the table that is asked first.
_ROOM = 16
SCHEMA = "doc_id bigint, item_id bigint, containment double"


class Lookup:
    """From 64-bit keys to the items that have them."""

    def __init__(self, keys: np.ndarray, items: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        self.keys, self.items = keys[order], items[order]
        self.mask = _U((1 << (_ROOM * len(keys)).bit_length()) - 1)
        self.present = np.zeros(int(self.mask) + 1, bool)
        self.present[keys & self.mask] = True

    def find(self, keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Distinct (owner, item) of equal keys."""
        some = np.flatnonzero(self.present[keys & self.mask])
        low = np.searchsorted(self.keys, keys[some], "left")
        n = np.searchsorted(self.keys, keys[some], "right") - low
        found = np.repeat(low, n) + runs(n)
        return np.unique(np.stack([np.repeat(owner[some], n), self.items[found]], 1), axis=0)


@dataclass
class Index:
    """Item ids, each item's distinct shingles, and the lookups by partition, by single shingle and by item of fewer words."""

    ids: list
    sets: list[np.ndarray]
    by_size: dict[int, list[Lookup]]
    single: Lookup | None
    short: dict[int, Lookup]


def build_index(items: pa.Table) -> Index:
    """Index of (item_id, text); items without words contain nothing to look for."""
    data, offsets = text_bytes(items.column("text").combine_chunks()) if items.num_rows else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
    starts, lengths, counts = word_spans(data, offsets)
    hashes, made = shingles(word_hashes(data, starts, lengths), counts, WORDS)
    ends = np.cumsum(made)
    sets = [np.unique(hashes[e - m : e]) for e, m in zip(ends, made, strict=True)]
    by_size: dict[int, list[int]] = {}
    single, short = [], {}
    for i, (own, words) in enumerate(zip(sets, counts, strict=True)):
        if 0 < words < WORDS:
            short.setdefault(int(words), []).append(i)
        elif 0 < len(own) < GRAIN:
            single.append(i)
        elif len(own):
            by_size.setdefault(1 << int(len(own)).bit_length(), []).append(i)
    flat = lambda own: Lookup(np.concatenate([sets[i] for i in own]), np.repeat(own, [len(sets[i]) for i in own]))
    signed = {s: [Lookup(np.array([(sets[i] * a).min() for i in own], _U), np.array(own)) for a in _ODD] for s, own in by_size.items()}
    return Index(items.column("item_id").to_pylist(), sets, signed, flat(single) if single else None, {w: flat(own) for w, own in short.items()})


def candidates(index: Index, hashes: np.ndarray, made: np.ndarray, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(text, item) pairs to be judged, from the texts' shingles and word hashes."""
    found = [np.zeros((0, 2), np.int64)]
    text_of = np.repeat(np.arange(len(made)), made)
    if index.single:
        found.append(index.single.find(hashes, text_of))
    for n, lookup in index.short.items():
        padded = np.concatenate([words, np.zeros(n, _U)])
        rows = np.maximum(counts - n + 1, 0)
        at = np.repeat(np.cumsum(counts) - counts, rows) + runs(rows)
        own, _ = shingles(np.stack([padded[at + j] for j in range(n)], 1).ravel(), np.full(len(at), n), WORDS)
        found.append(lookup.find(own, np.repeat(np.arange(len(rows)), rows)))
    if index.by_size and len(hashes):
        grains = -(-made // GRAIN)
        first = np.repeat(np.cumsum(made) - made, grains) + runs(grains) * GRAIN
        grain_text = np.repeat(np.arange(len(made)), grains)
        windows = {}
        for size in index.by_size:
            step = size // GRAIN
            number = np.where(grains > 0, np.maximum(1, -(-(grains - step) // step)), 0)
            place = runs(number) * step
            begin = np.repeat(np.cumsum(grains) - grains, number) + place
            length = np.minimum(2 * step, np.repeat(grains, number) - place)
            windows[size] = (np.stack([begin, begin + length], 1).ravel(), grain_text[begin])
        for f, a in enumerate(_ODD):
            low = np.append(np.minimum.reduceat(hashes * a, first), _U(0))
            for size, (bounds, owner) in windows.items():
                found.append(index.by_size[size][f].find(np.minimum.reduceat(low, bounds)[::2], owner))
    return np.unique(np.concatenate(found), axis=0)


def contained(index: Index, data: np.ndarray, offsets: np.ndarray, threshold: float) -> list[tuple[int, int, float]]:
    """(text, item, containment) of items whose shingles are in a text by ``threshold`` or more."""
    starts, lengths, counts = word_spans(data, offsets)
    words = word_hashes(data, starts, lengths)
    hashes, made = shingles(words, counts, WORDS)
    pairs = candidates(index, hashes, made, words, counts)
    begin, word_begin = np.cumsum(made) - made, np.cumsum(counts) - counts
    out = []
    text, own, grams = -1, None, {}
    for t, i in pairs:
        if t != text:
            text, own, grams = t, np.unique(hashes[begin[t] : begin[t] + made[t]]), {}
        n = next((w for w, lookup in index.short.items() if i in lookup.items), None)
        if n is not None and n not in grams:
            spoken = words[word_begin[t] : word_begin[t] + counts[t]]
            slid = np.stack([spoken[j : len(spoken) - n + 1 + j] for j in range(n)], 1)
            grams[n] = np.unique(shingles(slid.ravel(), np.full(len(slid), n), WORDS)[0])
        share = float(np.isin(index.sets[i], own if n is None else grams[n]).sum() / len(index.sets[i]))
        if share >= threshold:
            out.append((int(t), int(i), share))
    return out


def _blocks(items: DataFrame) -> Iterator[Broadcast]:
    """Index of each block of (item_id, text), sent to the executors with its classes."""
    listed = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = -(-int(listed.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK)
    for number in range(blocks):
        mine = listed.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number)
        yield items.sparkSession.sparkContext.broadcast(cloudpickle.dumps(build_index(mine.toArrow())))


def search(docs: DataFrame, items: DataFrame, threshold: float = CONTAINED) -> DataFrame:
    """(doc_id, item_id, containment) for every item and every document that holds ``threshold`` or more of its five-word shingles.

    Words are runs of letters and digits without regard to ASCII case; an item of fewer words is one shingle, found wherever its words
    follow each other.  Rows of equal ids give equal rows; empty texts and empty tables give none.
    """

    def hits(sent: Broadcast) -> DataFrame:
        def job(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = pickle.loads(sent.value)
            for batch in stream:
                ids = batch.column("doc_id").to_pylist()
                found = []
                for i, _, data, offsets in batches(batch.column("text")):
                    found += [(ids[i + t], index.ids[n], share) for t, n, share in contained(index, data, offsets, threshold)]
                columns = [pa.array([r[k] for r in found], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))]
                yield pa.record_batch(columns, names=["doc_id", "item_id", "containment"])

        return texts(docs).mapInArrow(job, SCHEMA)

    found = [hits(index) for index in _blocks(items)]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], SCHEMA)


def without_leaks(docs: DataFrame, items: DataFrame, threshold: float = CONTAINED) -> DataFrame:
    """The rows of ``docs``, all columns, in which no item is contained; the texts are read in place, nothing is shuffled."""

    def clean(sent: Broadcast):
        @F.arrow_udf("boolean")
        def judge(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            index = pickle.loads(sent.value)
            for column in columns:
                out = np.ones(len(column), bool)
                for i, _, data, offsets in batches(column):
                    out[[i + t for t, _, _ in contained(index, data, offsets, threshold)]] = False
                yield pa.array(out)

        return judge(F.coalesce(docs["text"], F.lit("")))

    return reduce(lambda kept, sent: kept.filter(clean(sent)), _blocks(items), in_small_batches(docs))
