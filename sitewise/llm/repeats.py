"""Bytes covered by a string of ``LENGTH`` bytes that also starts elsewhere in the corpus, found by suffix arrays and cut out.

Every window of ``LENGTH`` bytes has an anchor: the least hash of the ``GRAM``-byte strings in it.  Equal windows have equal anchors, so
windows are brought together by anchor.  Neighbouring windows mostly share theirs and travel as one strip of text, of at most twice a
window.  Strips whose anchor occurs once cannot repeat anything and stay where they are; equal strips travel once, with their number.
The strips of an anchor are sorted by suffix (see ``suffixes``), and windows whose common prefix with a neighbour is a whole window repeat.

An anchor with more than ``GROUP`` bytes of different strips is not given to one task.  Its strips are cut into parts whose windows have the anchor in places
less than ``PART`` apart; all windows that can be in such a part hold the same bytes around the anchor, so equal windows are in parts with equal ones.
Equal parts, which copies that differ elsewhere mostly have, again travel once, and the parts of one core are sorted like the strips of one anchor.  Only
where even those are too many are single windows counted, by 128-bit hashes relative to their own start: 10^15 such windows hold two
different ones of equal hash with a probability of about 10^-9.  Everywhere else repeats are told by their bytes or by 128-bit digests of whole strips.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sitewise.llm.bytetext import batches, mix64, runs, text_bytes
from sitewise.llm.common import keyed_join, texts, with_row_key
from sitewise.llm.suffixes import repeated_windows
from sitewise.session import durable

LENGTH, GRAM = 400, 16
WINDOW = LENGTH - GRAM + 1
#: Bytes of text scanned at a time; of strips in one suffix array, unless one anchor has more; of one anchor's strips in one task.
PIECE, ARRAY, GROUP = 1 << 18, 1 << 18, 1 << 20
#: Places that the anchor may have in the windows of a part: a third of all, so that no part is left with a window or two.
PART = -(-WINDOW // 3)
_U = np.uint64


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes that begin at each byte."""
    n = len(data) - GRAM + 1
    eight = np.ndarray((n + 8,), "<u8", buffer=np.ascontiguousarray(data), strides=(1,)).astype(_U)
    out = (eight[:n] * _U(0x9E3779B97F4A7C15)) ^ ((eight[8:] * _U(0xC2B2AE3D27D4EB4F)) >> _U(7)) ^ (eight[8:] << _U(29))
    out ^= out >> _U(32)
    out *= _U(0xD6E8FEB86659FD93)
    return out ^ (out >> _U(29))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours."""
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def strips(data: np.ndarray, offsets: np.ndarray):
    """Strips of the texts' windows that share an anchor: text, first byte, windows, anchor, does the anchor occur twice in it."""
    sizes = np.diff(offsets)
    number = np.maximum(sizes - LENGTH + 1, 0)
    if not number.any():
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(_U), none.astype(bool)
    hashes = gram_hashes(data)
    least = sliding_least(hashes, WINDOW)
    at = np.repeat(offsets[:-1], number) + runs(number)
    anchor = least[at]
    cut = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (np.diff(at) != 1)]))
    count = np.diff(np.append(cut, len(at)))
    start, anchor = at[cut], anchor[cut]
    text = np.searchsorted(offsets, start, "right") - 1
    # an anchor is the least of its window, so also of the half window before or after it: few places to look at
    half = sliding_least(hashes, WINDOW // 2 + 1)
    n = len(half)
    few = hashes[:n] == half
    few = np.append(few, np.zeros(len(hashes) - n, bool))
    few[len(hashes) - n :] |= hashes[len(hashes) - n :] == half
    few[n:] = True
    place = np.flatnonzero(few)
    low, high = np.searchsorted(place, start), np.searchsorted(place, start + count - 1 + WINDOW)
    near = np.repeat(low, high - low) + runs(high - low)
    strip = np.repeat(np.arange(len(start)), high - low)
    hits = np.bincount(strip, hashes[place[near]] == anchor[strip], len(start))
    return text, start, count, anchor, hits > 1


def _strip_rows(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        keys = [batch.column(c).to_numpy() for c in ("k1", "k2")]
        for i, j, data, offsets in batches(batch.column("text"), PIECE):
            if len(data) < LENGTH:
                continue
            text, start, count, anchor, twice = strips(data, offsets)
            raw = data.tobytes()
            digest = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), (start + count + LENGTH - 1).tolist(), strict=True)]
            yield pa.record_batch(
                [pa.array(k[i:j][text]) for k in keys]
                + [pa.array(start - offsets[text]), pa.array(count), pa.array(anchor.view(np.int64)), pa.array(digest, pa.binary()), pa.array(twice)],
                names=["k1", "k2", "start", "windows", "anchor", "digest", "twice"],
            )


def _cut_strips(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the strips picked from each text."""
    for batch in stream:
        picks = batch.column("picks")
        fields = dict(zip((f.name for f in picks.type.value_type), picks.flatten().flatten(), strict=True))
        number = np.diff(picks.offsets.to_numpy())
        data, offsets = text_bytes(batch.column("text"))
        raw = data.tobytes()
        begin = np.repeat(offsets[:-1], number) + fields["start"].to_numpy()
        end = begin + fields["windows"].to_numpy() + LENGTH - 1
        cut = pa.array([raw[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)], pa.large_binary()).cast(pa.binary())
        yield pa.record_batch([*(fields[c] for c in ("anchor", "digest", "n", "large")), cut], names=["anchor", "digest", "n", "large", "strip"])


def _cut(picked: DataFrame) -> DataFrame:
    """The strips picked from rows (text, picks)."""
    return picked.select("text", "picks").mapInArrow(_cut_strips, "anchor bigint, digest binary, n bigint, large boolean, strip binary")


def _spans(marked: np.ndarray) -> list[int]:
    """First and behind-last place of each run of marked windows, one after the other."""
    edge = np.diff(np.concatenate([[0], marked.astype(np.int8), [0]]))
    return np.flatnonzero(edge).tolist()


def _sorted_strips(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated windows of the strips, which come with those of one anchor together."""
    held: dict[int, dict[bytes, tuple[int, bytes]]] = {}
    size = 0

    def settle() -> pa.RecordBatch:
        nonlocal size
        found, rows = [], []
        for g, (anchor, own) in enumerate(held.items()):
            for digest, (n, strip) in own.items():
                if n > 1:  # every window of a strip that occurs twice does
                    found.append((anchor, digest, [0, len(strip) - LENGTH + 1]))
                if len(own) > 1 or n == 1:  # else there is nothing to sort it against
                    rows.append((g, anchor, digest, n, strip))
        if rows:
            groups = np.unique([r[0] for r in rows], return_inverse=True)[1]
            marked = repeated_windows([r[4] for r in rows], groups, LENGTH)
            found += [(r[1], r[2], _spans(m)) for r, m in zip(rows, marked, strict=True) if r[3] == 1]
        held.clear()
        size = 0
        return _found(found)

    for batch in stream:
        for anchor, digest, n, strip in zip(*(batch.column(c).to_pylist() for c in ("anchor", "digest", "n", "strip")), strict=True):
            if size >= ARRAY and anchor not in held:
                yield settle()
            held.setdefault(anchor, {})[digest] = (n, strip)
            size += len(strip)
    yield settle()


def _found(rows: list[tuple[int, bytes, list[int]]]) -> pa.RecordBatch:
    rows = [r for r in rows if r[2]]
    kinds = (pa.int64(), pa.binary(), pa.list_(pa.int32()))
    return pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["anchor", "digest", "spans"])


def _slices(stream: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows with a column ``strip``, a few at a time, with their bytes and offsets."""
    for whole in stream:
        for first in range(0, whole.num_rows, 256):
            batch = whole.slice(first, 256)
            yield batch, *text_bytes(batch.column("strip"))


def _parts(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each strip's different parts: first windows, windows, hash of the bytes that all windows of such a part hold, digest.

    Where the anchor recurs, as in a text that repeats a line, a strip holds the same part in many places.
    """
    for batch, data, offsets in _slices(stream):
        number = np.diff(offsets) - LENGTH + 1
        row = np.repeat(np.arange(batch.num_rows), number)
        at = offsets[row] + runs(number)
        hashes = gram_hashes(data)
        owner = np.repeat(np.arange(batch.num_rows), np.diff(offsets))[: len(hashes)]
        hit = hashes == batch.column("anchor").to_numpy().view(_U)[owner]
        # the first place of the anchor in each window
        place = np.minimum.accumulate(np.where(hit, np.arange(len(hashes)), len(data))[::-1])[::-1][at]
        kind = (place - at) // PART
        cut = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(place) != 0) | (np.diff(kind) != 0)]))
        count = np.diff(np.append(cut, len(at)))
        raw = data.tobytes()
        cores, digests = [], []
        for first, n, anchor, j in zip(at[cut].tolist(), count.tolist(), place[cut].tolist(), kind[cut].tolist(), strict=True):
            last = anchor - j * PART  # where the last window begins that a part of this kind can have
            cores.append(int.from_bytes(hashlib.blake2b(raw[last : last + LENGTH + 1 - PART], digest_size=8, key=bytes([j + 1])).digest(), "little", signed=True))
            digests.append(hashlib.blake2b(raw[first : first + n + LENGTH - 1], digest_size=16).digest())
        starts: dict[tuple[int, int, bytes], list[int]] = {}
        for key, first in zip(zip(row[cut].tolist(), count.tolist(), cores, digests, strict=True), (at - offsets[row])[cut].tolist(), strict=True):
            starts.setdefault(key, []).append(first)
        rows, counts, cores, digests = zip(*starts, strict=True) if starts else ((),) * 4
        own = pa.array(rows, pa.int64())
        yield pa.record_batch(
            [batch.column(c).take(own) for c in ("anchor", "digest", "n")]
            + [pa.array(starts.values(), pa.list_(pa.int64())), pa.array(counts, pa.int64()), pa.array(cores, pa.int64()), pa.array(digests, pa.binary())],
            names=["anchor", "digest", "n", "starts", "windows", "core", "part"],
        )


def _window_hashes(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two 64-bit hashes of the bytes of every window."""
    for batch, data, offsets in _slices(stream):
        number = np.diff(offsets) - LENGTH + 1
        row = np.repeat(np.arange(batch.num_rows), number)
        at = offsets[row] + runs(number)
        out = []
        for base in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            powers, back = (np.cumprod(np.concatenate([[_U(1)], np.full(len(data), x, _U)])) for x in (base, pow(base, -1, 1 << 64)))
            total = np.concatenate([np.zeros(1, _U), np.cumsum(mix64(data.astype(_U) + _U(base)) * powers[:-1], dtype=_U)])
            # divided by the power of the window's own start, a sum depends on the window's bytes alone
            out.append(mix64((total[at + LENGTH] - total[at]) * back[at]).view(np.int64))
        yield pa.record_batch(
            [batch.column(c).take(pa.array(row)) for c in ("anchor", "digest", "n")] + [pa.array(runs(number).astype(np.int32)), *map(pa.array, out)],
            names=["anchor", "digest", "n", "place", "h1", "h2"],
        )


def _counted_windows(kinds: DataFrame) -> DataFrame:
    """(anchor, digest, spans) of the windows of written strips that occur again: counted by hash, each strip's put together again."""
    windows = durable(kinds.select("anchor", "digest", "n", "strip").mapInArrow(_window_hashes, "anchor bigint, digest binary, n bigint, place int, h1 bigint, h2 bigint"), "repeat-windows")
    again = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("all")).filter("all > 1").select("h1", "h2", "rows")
    marked = keyed_join(windows, durable(again, "repeat-again"), ["h1", "h2"], "rows")
    places = marked.groupBy("anchor", "digest").agg(F.sort_array(F.collect_list("place")).alias("p"))  # of one strip each
    return places.select("anchor", "digest", F.flatten(F.transform("p", lambda x: F.array(x, x + 1))).alias("spans"))


def _sorted_groups(kinds: DataFrame) -> DataFrame:
    """(anchor, digest, spans) of the windows of written strips that occur again, groups of bounded size sorted in a task each."""
    together = kinds.select("anchor", "digest", "n", "strip").repartition("anchor").sortWithinPartitions("anchor")
    return together.mapInArrow(_sorted_strips, "anchor bigint, digest binary, spans array<int>")


def _large_groups(cut: DataFrame) -> DataFrame:
    """(anchor, digest, spans) of repeated windows of written strips of large groups, by their parts."""
    found = cut.select("anchor", "digest", "n", "strip").mapInArrow(_parts, "anchor bigint, digest binary, n bigint, starts array<bigint>, windows bigint, core bigint, part binary")
    found = durable(found, "repeat-parts")
    one = F.min(F.struct("anchor", "digest", F.col("starts")[0].alias("start"), "windows")).alias("one")
    kinds = durable(found.groupBy("core", "part").agg(F.sum(F.col("n") * F.size("starts")).alias("n"), F.count(F.lit(1)).alias("rows"), one), "repeat-part-kinds")
    sizes = durable(kinds.groupBy("core").agg(F.count(F.lit(1)).alias("kinds"), (F.sum(F.col("one.windows") + LENGTH) > GROUP).alias("large")), "repeat-part-sizes")
    pick = F.struct("one.start", "one.windows", F.col("core").alias("anchor"), F.col("part").alias("digest"), "n", "large").alias("pick")
    picks = keyed_join(kinds, sizes, ["core"], "kinds").select("one.anchor", "one.digest", pick)
    picked = picks.groupBy("anchor", "digest").agg(F.collect_list("pick").alias("picks"))  # of one strip each
    sized = durable(_cut(cut.select("anchor", "digest", F.col("strip").alias("text")).join(picked, ["anchor", "digest"])), "repeat-part-cut")
    spans = _sorted_groups(sized.filter("not large"))
    if not sized.filter("large").isEmpty():
        spans = spans.unionByName(_counted_windows(sized.filter("large")))
    spans = spans.withColumnsRenamed({"anchor": "core", "digest": "part"})
    known = durable(spans.join(kinds.select("core", "part", "rows"), ["core", "part"]), "repeat-part-spans")
    moved = F.flatten(F.transform("starts", lambda start: F.transform("spans", lambda x: x + start.cast("int"))))
    placed = keyed_join(found, known, ["core", "part"], "rows").select("anchor", "digest", moved.alias("spans"))
    return placed.groupBy("anchor", "digest").agg(F.flatten(F.collect_list("spans")).alias("spans"))  # of one strip each


def repeated_spans(keyed: DataFrame) -> DataFrame:
    """(k1, k2, spans) of texts (k1, k2, text) with repeated windows; ``spans`` are (start, windows) in the text's bytes."""
    found = durable(
        keyed.select("k1", "k2", "text").mapInArrow(_strip_rows, "k1 bigint, k2 bigint, start bigint, windows bigint, anchor bigint, digest binary, twice boolean"), "repeat-strips"
    )
    anchors = durable(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("rows"), F.max("twice").alias("any")).filter("rows > 1 or any").select("anchor", "rows"), "repeat-anchors")
    meeting = durable(keyed_join(found.drop("twice"), anchors, ["anchor"], "rows").drop("rows"), "repeat-meeting")
    kinds = durable(
        meeting.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "start", "windows")).alias("one")), "repeat-kinds"
    )
    sizes = durable(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), (F.sum(F.col("one.windows") + LENGTH) > GROUP).alias("large")), "repeat-sizes")
    sized = keyed_join(kinds, sizes, ["anchor"], "kinds")
    picks = sized.select("one.k1", "one.k2", F.struct("one.start", "one.windows", "anchor", "digest", "n", "large").alias("pick"))
    picked = picks.groupBy("k1", "k2").agg(F.collect_list("pick").alias("picks"))  # of one text each
    cut = durable(_cut(keyed.join(picked, ["k1", "k2"])), "repeat-cut")
    spans = _sorted_groups(cut.filter("not large"))
    if not cut.filter("large").isEmpty():
        spans = spans.unionByName(_large_groups(cut.filter("large")))
    spans = durable(spans.join(kinds.select("anchor", "digest", "n"), ["anchor", "digest"]), "repeat-spans")
    placed = keyed_join(meeting.select("k1", "k2", "start", "anchor", "digest"), spans, ["anchor", "digest"], "n")
    return placed.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "spans")).alias("spans"))  # of one text each


def _remove(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        kept, size, gone, cuts = [], [], [], []
        for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
            raw, spans = text.as_buffer().to_pybytes(), spans.as_py()
            ranges = sorted({(s["start"] + a, s["start"] + b - 1 + LENGTH) for s in spans or () for a, b in zip(s["spans"][::2], s["spans"][1::2], strict=True)})
            merged: list[list[int]] = []
            for a, b in ranges:
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            edges = [0, *(x for r in merged for x in r), len(raw)]
            kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if merged else raw)
            size.append(len(raw))
            gone.append(sum(b - a for a, b in merged))
            cuts.append(len(merged))
        columns = [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(cuts, pa.int64()), pa.array(kept, pa.binary())]
        yield pa.record_batch(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes, which may begin inside a character).

    Rows are texts of their own even if they repeat an id.  A null text has no bytes; texts shorter than ``LENGTH`` stay whole; an
    empty table gives none.
    """
    keyed = with_row_key(texts(docs))
    spans = repeated_spans(keyed)
    return keyed.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans").mapInArrow(
        _remove, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
    )
