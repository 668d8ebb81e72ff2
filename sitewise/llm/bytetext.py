"""Texts of an Arrow batch as one array of bytes, and hashes of their words and word shingles.

All functions work on many texts at once: ``data`` holds their bytes one after the other, ``offsets`` where each begins and ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time, so that temporary arrays stay small; a longer text is handled alone.
PIECE = 1 << 20

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Letters, digits and every byte of a character beyond ASCII.
IS_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_STEP, _JOIN = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix64(np.arange(1, 257, dtype=_U) * _STEP)[_LOWER]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of texts, or of bytes, without nulls."""
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of ``limit`` bytes together, or of one longer text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def batches(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, data, offsets) of the pieces of a column."""
    data, offsets = text_bytes(column)
    for i, j in pieces(offsets, limit):
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def runs(lengths: np.ndarray) -> np.ndarray:
    """0, 1, .., n-1 for each length n."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of every word, and how many words each text has."""
    inside = IS_WORD[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    begin[heads] = inside[heads]  # a word ends with its text
    starts = np.flatnonzero(begin)
    total = np.concatenate([[0], np.cumsum(inside)])
    upto = total[starts]
    lengths = np.diff(np.append(upto, total[-1]))
    return starts, lengths, np.diff(np.searchsorted(starts, offsets))


def word_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, prefix: int | None = None) -> np.ndarray:
    """64-bit hash of each word without regard to ASCII case, or of its first ``prefix`` bytes."""
    if not len(starts):
        return np.zeros(0, _U)
    n = lengths if prefix is None else np.minimum(lengths, prefix)
    place = runs(n)
    powers = np.cumprod(np.full(int(n.max()), _STEP, _U))
    value = _BYTE[data[np.repeat(starts, n) + place]] * powers[place]
    return mix64(np.add.reduceat(value, np.cumsum(n) - n) + n.astype(_U))


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words of each text and their number; a text of fewer words, but one, is a single shingle."""
    powers = np.cumprod(np.full(k, _JOIN, _U))
    n = len(hashes)
    first = np.cumsum(counts) - counts
    whole = np.zeros(n, _U)
    for j in range(min(k, n)):
        whole[: n - j] += hashes[j:] * powers[j]
    made = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out = whole[np.repeat(first, made) + runs(made)]
    place = np.cumsum(made) - made
    for m in range(1, k):
        short = np.flatnonzero(counts == m)
        if len(short):
            out[place[short]] = sum((hashes[first[short] + j] * powers[j] for j in range(m)), np.zeros(len(short), _U)) + _U(m)
    return mix64(out), made
