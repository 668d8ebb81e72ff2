"""Periodic runs of words: maximal stretches that repeat with a smallest period at least twice.

A text becomes numbers, one per distinct word, and is cut into blocks of 2, 4, 8, .. words.  A run with a period q of a scale's range repeats one whole
block of that scale at distance q: block size 2 finds periods 1 to 6, a larger size B periods from 2B - 1 to 4B - 2.  The occurrences of a block in the
window behind it are the zeros of its squared differences with the window, sum a^2 - 2 sum a b + sum b^2, where the middle sum is a convolution by
number theoretic transforms modulo ``PRIME``, in integers throughout.  A zero gives a distance; blocks in a row with one
distance make a chain, and the words are compared outwards from its ends and inside it, so a sum that is zero modulo the prime only finds nothing.

Two kinds of blocks need no transform: those whose first words do not recur at any distance of the scale, and those that lie with their
window in a run of a period up to B, where a larger period can only be a multiple.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sitewise.llm.bytetext import mix64, pieces, text_bytes
from sitewise.llm.common import texts

#: 3 * 2^30 + 1, with 5 as a generator: has roots of unity for transforms of up to 2^30 words, and products fit in 64 bits.
PRIME, GENERATOR = 3 * 2**30 + 1, 5
#: Least length of a run; bytes of text handled at a time; numbers in one batch of transforms.
SHORTEST, PIECE, TOGETHER = 12, 1 << 20, 1 << 16
#: Words at the start of a block that must recur.
OPENING = 4
_U = np.uint64
_P = _U(PRIME)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime of numbers below it."""
    out = a * b
    return out - out // _P * _P


def _powers(root: int, n: int) -> np.ndarray:
    """1, root, root^2, .. modulo the prime."""
    out, step = np.ones(1, _U), root % PRIME
    while len(out) < n:
        out = np.concatenate([out, _times(out, _U(step))])
        step = step * step % PRIME
    return out[:n]


def transform(x: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Number theoretic transform of each row; row lengths are powers of two.  The inverse leaves out the division by the length."""
    rows, n = x.shape
    root = pow(GENERATOR, (PRIME - 1) // n, PRIME)
    if inverse:
        root = pow(root, -1, PRIME)
    powers = _powers(root, max(n // 2, 1))
    # halves are combined until transforms of one number have grown to the whole row, in order all along
    x = x.reshape(rows, n, 1)
    while x.shape[1] > 1:
        half = x.shape[1] // 2
        done = x.shape[2]
        a, b = x[:, :half], x[:, half:]
        factor = powers[:: half][:done] if half > 1 else powers[:done]
        b = _times(b, factor)
        up, down = a + b, a + (_P - b)
        up -= _P * (up >= _P)
        down -= _P * (down >= _P)
        x = np.concatenate([up, down], axis=2)
    return x.reshape(rows, n)


def squared_differences(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Sum of squared differences, modulo the prime, of each block of B numbers with each place of its window where it fits."""
    size = blocks.shape[1]
    places = windows.shape[1] - size + 1
    n = 1 << int(windows.shape[1] - 1).bit_length()
    turned = np.zeros((len(blocks), n), _U)
    turned[:, :size] = blocks[:, ::-1]
    wide = np.zeros((len(blocks), n), _U)
    wide[:, : windows.shape[1]] = windows
    # places with an index of size - 1 or more do not wrap round
    shared = transform(_times(transform(turned), transform(wide)), inverse=True)[:, size - 1 : size - 1 + places]
    shared = _times(shared, _U(pow(n, -1, PRIME)))
    total = np.zeros((len(blocks), windows.shape[1] + 1), _U)
    np.cumsum(_times(windows, windows), axis=1, out=total[:, 1:])
    seconds = total[:, size:] - total[:, : places]
    firsts = _times(blocks, blocks).sum(1, dtype=_U)
    return (seconds + firsts[:, None] + _U(2) * (_P - shared)) % _P


def _recurring(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For openings of ``OPENING`` words of one text: their keys, all keys with their places in order, and the bits of a place."""
    n = len(words)
    bits = max(n, 2).bit_length() + 1
    key = mix64(text.astype(_U) + _U(1))
    for j in range(min(OPENING, n)):
        key[: n - j] = mix64(key[: n - j] ^ (words[j:].astype(_U) + _U(1)))
    key = key >> _U(bits) << _U(bits)
    return key, np.sort(key | np.arange(n, dtype=_U)), bits


def _live(size: int, starts: np.ndarray, words: np.ndarray, low: int, high: int, opening) -> np.ndarray:
    """Those of the blocks whose first words recur at a distance from ``low`` to ``high``."""
    if size < OPENING:
        head = words[starts]
        again = np.zeros(len(starts), bool)
        for q in range(low, high + 1):
            again |= words[starts + q] == head
        return starts[again]
    key, ordered, _ = opening
    own = key[starts]
    at = np.searchsorted(ordered, own + (starts + low).astype(_U))
    found = ordered[np.minimum(at, len(ordered) - 1)]
    return starts[(at < len(ordered)) & (found <= own + (starts + high).astype(_U)) & (found >= own)]


def _extent(words: np.ndarray, at: np.ndarray, distance: np.ndarray, step: int) -> np.ndarray:
    """How many words from ``at`` on, in direction ``step``, equal those ``distance`` behind them.  Texts end with words of their own."""
    out = np.zeros(len(at), np.int64)
    going, width = np.arange(len(at)), 4
    while len(going):
        place = (at[going] + step * out[going])[:, None] + step * np.arange(width)
        further = place + distance[going, None]
        inside = (place >= 0) & (further < len(words))
        same = inside & (words[np.where(inside, place, 0)] == words[np.where(inside, further, 0)])
        first = np.where(same.all(1), width, np.argmin(same, axis=1))
        out[going] += first
        going = going[first == width]
        width = min(2 * width, max(4, TOGETHER // max(len(going), 1)))
    return out


def find_runs(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of at least ``SHORTEST`` words, by start, then period.

    ``words`` holds numbers below the prime; ``text`` tells which text a word is of.  Every text ends with a number that occurs nowhere else.
    """
    n = len(words)
    longest = int(np.bincount(text).max(initial=0)) if n else 0
    found = [np.zeros((3, 0), np.int64)]
    reach = np.zeros(n, np.int64)  # where the furthest run ends that begins here
    opening = _recurring(words, text) if n else None
    size = 2
    while n and (1 if size == 2 else 2 * size - 1) * 2 <= longest:
        low, high = (1 if size == 2 else 2 * size - 1), 4 * size - 2
        room = np.concatenate([words, np.full(5 * size, words[-1])])  # ends like the last text
        starts = np.arange(0, n - size + 1, size)
        starts = starts[np.maximum.accumulate(reach)[starts] < starts + high + size]
        starts = _live(size, starts, room, low, high, opening)
        pairs = []
        together = max(1, TOGETHER // (4 * size))
        for i in range(0, len(starts), together):
            own = starts[i : i + together, None]
            apart = squared_differences(room[own + np.arange(size)].astype(_U), room[own + np.arange(low, high + size)].astype(_U))
            block, place = np.nonzero(apart == 0)
            pairs.append(np.stack([place + low, own[block, 0]]))
        if pairs:
            found.append(_extended(words, size, *np.concatenate(pairs, axis=1)))
            start, length, period = found[-1]
            near = period <= 2 * size  # the next scale's block size
            np.maximum.at(reach, start[near], (start + length)[near])
            held = np.concatenate(found, axis=1)
            late = held[:, (held[2] <= 2 * size)]
            np.maximum.at(reach, late[0], late[0] + late[1])
        size *= 2
    start, length, period = np.concatenate(found, axis=1)
    # a stretch also has the multiples of its smallest period
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (np.diff(start) != 0) | (np.diff(length) != 0)
    start, length, period = start[first], length[first], period[first]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _extended(words: np.ndarray, size: int, distance: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Runs (start, length, period) around the blocks at ``start`` that recur at ``distance``; a period may be a multiple of the smallest."""
    order = np.lexsort((start, distance))
    distance, start = distance[order], start[order]
    head = np.ones(len(start), bool)
    head[1:] = (np.diff(distance) != 0) | (np.diff(start) != size)
    head = np.flatnonzero(head)
    q, first = distance[head], start[head]
    chained = np.append(start[head[1:] - 1], start[-1:]) + size - first
    # the words of a chain are compared too: they are equal but for sums that are zero modulo the prime only
    ahead = _extent(words, first, q, 1)
    behind = _extent(words, first - 1, q, -1)
    broken = ahead < chained
    if broken.any():  # the blocks of such a chain stand alone
        alone = np.isin(np.searchsorted(head, np.arange(len(start)), "right") - 1, np.flatnonzero(broken))
        q, first = np.append(q, distance[alone]), np.append(first, start[alone])
        ahead, behind = _extent(words, first, q, 1), _extent(words, first - 1, q, -1)
    length = behind + ahead + q
    whole = (length >= np.maximum(SHORTEST, 2 * q)) & (ahead > 0)
    return np.unique(np.stack([(first - behind)[whole], length[whole], q[whole]]), axis=1)


def altered(n: int, doc_id: int | None) -> tuple[int, int] | None:
    """Word ``a`` and period ``p`` from which on a text of ``n`` words is made to repeat, for one id in ten; a row without an id stays."""
    h = crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _words(raw: bytes, numbers: dict[bytes, int]) -> np.ndarray:
    """Numbers of a text's words, a piece of the text at a time; new words get the next number."""
    out, begin = [np.zeros(0, np.int64)], 0
    while begin < len(raw):
        end = begin + PIECE
        while end < len(raw) and raw[end] not in b" \t\n\v\f\r":
            end += 1
        spoken = raw[begin:end].split()
        out.append(np.fromiter(map(numbers.__getitem__, spoken), np.int64, len(spoken)))
        begin = end
    return np.concatenate(out)


def _digest(numbers: np.ndarray, names: list[bytes]) -> str:
    """Hash of words joined by one blank."""
    digest = hashlib.sha256()
    for i in range(0, len(numbers), PIECE):
        digest.update((b" " if i else b"") + b" ".join(map(names.__getitem__, numbers[i : i + PIECE].tolist())))
    return digest.hexdigest()


def _describe(stream: Iterator[pa.RecordBatch], change) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")), ("runs_sha256", pa.string()),
         ("collapsed_sha256", pa.string()), ("n_words", pa.int64()), ("n_dropped", pa.int64())]
    )
    for batch in stream:
        ids = batch.column("doc_id").to_pylist()
        data, offsets = text_bytes(batch.column("text"))
        for i, j in pieces(offsets, PIECE):
            numbers: dict[bytes, int] = defaultdict(count().__next__)
            bodies = []
            for r in range(i, j):
                body = _words(data[offsets[r] : offsets[r + 1]].tobytes(), numbers)
                repeat = change(len(body), ids[r])
                if repeat is not None:
                    a, p = repeat
                    body = np.concatenate([body[:a], np.resize(body[a : a + p], len(body) - a)])
                bodies.append(body)
            names = list(numbers)
            sizes = np.array([len(b) + 1 for b in bodies])
            ends = np.cumsum(sizes)
            # each text is followed by a number of its own
            joined = np.concatenate([x for k, b in enumerate(bodies) for x in (b, [len(names) + k])])
            start, length, period = find_runs(joined, np.repeat(np.arange(len(bodies)), sizes))
            gone = np.zeros(len(joined) + 1, np.int64)
            np.add.at(gone, start + period, 1)
            np.add.at(gone, start + length, -1)
            gone = np.cumsum(gone)[:-1] > 0
            cut = np.searchsorted(start, np.concatenate([[0], ends]))
            rows = []
            for k, body in enumerate(bodies):
                first, own = ends[k] - sizes[k], slice(cut[k], cut[k + 1])
                s, m, q = (start[own] - first).tolist(), length[own].tolist(), period[own].tolist()
                top = min(zip([-x for x in m], s, q, strict=True), default=None)
                shown = (None,) * 4 if top is None else (top[1], -top[0], top[2], -1000 * top[0] // top[2])
                lost = gone[first : first + len(body)]
                listed = hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in zip(s, m, q, strict=True)).encode()).hexdigest()
                rows.append((ids[i + k], len(s), *shown, listed, _digest(body[~lost], names), len(body), int(lost.sum())))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def periodic_runs(docs: DataFrame, change=altered) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, n_words, n_dropped.

    Words lie between blanks; a run has a smallest period q, at least ``SHORTEST`` and 2q words, and no word beside it keeps the period.  The
    longest is shown, of equals the first, then the least period; without runs these are null.  ``runs_sha256`` is the hash of all runs, ``start,length,period`` by
    line; ``collapsed_sha256`` that of the words left when every run keeps its first period only.  ``change`` gives for a text's number of words
    and id the word and period from which on it is made to repeat, or None.  Null and empty texts have no words.  No rows give none.
    """
    return texts(docs).mapInArrow(
        lambda stream: _describe(stream, change),
        "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string, "
        "n_words bigint, n_dropped bigint",
    )
