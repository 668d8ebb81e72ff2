"""Suffix array of many short byte strings by two-stage sorting, and the windows of fixed length that occur twice in it.

Strings come in groups; suffixes are compared inside their group only.  A suffix smaller than its successor is sorted directly, by its
first ``depth`` bytes.  The others follow from one scan of the buckets of equal first byte, from the least: the predecessor of each
suffix met, if it is larger than that suffix, is next in the bucket of its own first byte.  The scan handles a byte's buckets of all groups at once.
"""

from __future__ import annotations

import numpy as np

from sitewise.llm.bytetext import runs

#: Symbols: 0 ends a string, byte b is b + 1; nine bits each, seven to a sorting key.
SYMBOLS, PACKED = 257, 7
#: Suffixes of equal beginning sorted by their bytes at once; more are first told apart by further symbols.
TIED = 20_000


class Strings:
    """Strings laid out one after the other, each with an end symbol, the groups ascending."""

    def __init__(self, strings: list[bytes], groups: np.ndarray) -> None:
        self.lengths = np.array([len(s) for s in strings], np.int64)
        self.first = np.cumsum(self.lengths + 1) - (self.lengths + 1)
        n = int(self.lengths.sum()) + len(strings)
        self.symbols = np.zeros(n, np.int16)
        place = np.repeat(self.first, self.lengths) + runs(self.lengths)
        self.content = b"\0".join([*strings, b""])
        self.symbols[place] = np.frombuffer(self.content, np.uint8)[place].astype(np.int16) + 1
        #: No string holds the byte that parts the strings.
        self.plain = self.content.count(0) == len(strings)
        self.group = np.repeat(groups, self.lengths + 1)
        self.end = np.repeat(self.first + self.lengths, self.lengths + 1)


def smaller_than_successor(symbols: np.ndarray) -> np.ndarray:
    """Is each suffix smaller than the next; an end symbol is not."""
    step = np.zeros(len(symbols), np.int8)
    step[:-1] = np.sign(symbols[1:] - symbols[:-1])
    step[symbols == 0] = -1
    decided = np.where(step != 0, np.arange(len(symbols)), len(symbols) - 1)
    step[-1] = -1
    return step[np.minimum.accumulate(decided[::-1])[::-1]] > 0


def direct_order(texts: Strings, at: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes ``at`` by group and first ``depth`` symbols; equal ones in any order."""
    padded = np.concatenate([texts.symbols, np.zeros(depth + PACKED, np.int16)]).astype(np.uint64)
    ends = texts.end

    def key(rows: np.ndarray, skip: int) -> np.ndarray:
        out = np.zeros(len(rows), np.uint64)
        for k in range(PACKED):
            inside = rows + skip + k <= ends[rows]
            out = (out << np.uint64(9)) | np.where(inside, padded[rows + skip + k], 0)
        return out

    def ties(rows: np.ndarray, fresh: np.ndarray, skip: int) -> np.ndarray:
        """Rows in order as far as ``skip`` symbols; ``fresh`` where one differs from the row before."""
        cut = np.flatnonzero(np.append(fresh, True))
        many = np.flatnonzero(np.diff(cut) > 1)
        if skip >= depth or not len(many):
            return rows
        listed, content = rows.tolist(), texts.content
        if texts.plain:
            after = lambda row: content[row + skip : row + depth]
        else:  # the shorter of two is the smaller, as an end symbol makes it
            after = lambda row: content[row + skip : min(row + depth, ends[row])]
        for a, b in zip(cut[many].tolist(), cut[many + 1].tolist(), strict=True):
            if b - a <= TIED:
                listed[a:b] = sorted(listed[a:b], key=after)
        rows = np.array(listed, np.int64)
        for a, b in zip(cut[many], cut[many + 1], strict=True):
            if b - a > TIED:
                keys = key(rows[a:b], skip)
                order = np.argsort(keys, kind="stable")
                keys = keys[order]
                rows[a:b] = ties(rows[a:b][order], np.append(True, keys[1:] != keys[:-1]), skip + PACKED)
        return rows

    if not len(at):
        return at
    keys = key(at, 0)
    order = np.lexsort((keys, texts.group[at]))
    rows, keys = at[order], keys[order]
    group = texts.group[rows]
    return ties(rows, np.append(True, (keys[1:] != keys[:-1]) | (group[1:] != group[:-1])), PACKED)


def asked(texts: Strings, ascending: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """The suffixes that the order of each string's first ``windows`` suffixes depends on: these, and on to the next one sorted directly."""
    places = np.arange(len(ascending))
    following = np.minimum.accumulate(np.where(ascending, places, len(ascending))[::-1])[::-1]
    some = np.flatnonzero(windows > 0)
    first = texts.first[some]
    last = np.minimum(following[first + windows[some] - 1], first + texts.lengths[some])
    return np.repeat(first, last - first + 1) + runs(last - first + 1)


def suffix_array(texts: Strings, depth: int) -> np.ndarray:
    """Suffixes of ``depth`` symbols or more, and some shorter ones, by group and first ``depth`` symbols at least."""
    s = texts.symbols.astype(np.int64)
    ascending = smaller_than_successor(texts.symbols)
    used = asked(texts, ascending, np.maximum(0, texts.lengths - depth + 1))
    bucket = texts.group * SYMBOLS + s
    buckets = int(bucket[-1] // SYMBOLS + 1) * SYMBOLS
    size = np.bincount(bucket[used], minlength=buckets)
    begin = np.cumsum(size) - size
    out = np.full(len(used), -1, np.int64)

    direct = direct_order(texts, used[ascending[used]], depth)
    number = np.bincount(bucket[direct], minlength=buckets)
    back = begin + size - number  # where the directly sorted suffixes of each bucket begin
    out[np.repeat(back, number) + runs(number)] = direct
    ends = used[s[used] == 0]
    number = np.bincount(bucket[ends], minlength=buckets)
    out[np.repeat(begin, number) + runs(number)] = ends

    fill = begin.copy()

    def put(rows: np.ndarray) -> None:
        """Rows, in the order of their successors, behind what their buckets hold."""
        own = bucket[rows]
        order = np.argsort(own, kind="stable")
        own, rows = own[order], rows[order]
        cut = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        count = np.diff(np.append(cut, len(own)))
        out[fill[own] + runs(count)] = rows
        fill[own[cut]] += count

    groups = np.arange(0, buckets, SYMBOLS)
    for c in np.flatnonzero(np.bincount(s, minlength=SYMBOLS)):
        mine = groups + c
        met = begin[mine]
        while c:  # runs of one byte: a larger suffix is followed by one of the same bucket
            new = np.repeat(met, fill[mine] - met) + runs(fill[mine] - met)
            met = fill[mine].copy()
            before = out[new] - 1
            before = before[(before >= 0) & (s[before] == c) & ~ascending[before]]
            if not len(before):
                break
            put(before)
        all_ = out[np.repeat(begin[mine], size[mine]) + runs(size[mine])]
        before = all_ - 1
        before = before[before >= 0]
        before = before[(s[before] > c) & ~ascending[before]]
        if len(before):
            put(before)
    return out


def equal_neighbours(texts: Strings, order: np.ndarray, length: int) -> np.ndarray:
    """Is the common prefix of each suffix in the array with the one before it, in its group, ``length`` or longer."""
    left, right = order[:-1], order[1:]
    whole = (texts.group[left] == texts.group[right]) & (left + length <= texts.end[left]) & (right + length <= texts.end[right])
    at = np.flatnonzero(whole)
    content = texts.content
    same = [content[a : a + length] == content[b : b + length] for a, b in zip(left[at].tolist(), right[at].tolist(), strict=True)]
    out = np.zeros(len(order), bool)
    out[at + 1] = same
    return out


def repeated_windows(strings: list[bytes], groups: np.ndarray, length: int) -> list[np.ndarray]:
    """For each string, at which places a window of ``length`` bytes begins that occurs again in the strings of its group."""
    texts = Strings(strings, groups)
    order = suffix_array(texts, length)
    again = equal_neighbours(texts, order, length)
    marked = np.zeros(len(texts.symbols), bool)
    marked[order[again]] = True
    marked[order[np.flatnonzero(again) - 1]] = True
    return [marked[f : f + max(0, n - length + 1)] for f, n in zip(texts.first, texts.lengths, strict=True)]
