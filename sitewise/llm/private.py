"""Personal data: fixed patterns, and what a linear-chain conditional random field over word shapes finds beside them.

The patterns decide alone about e-mail and network addresses, card and telephone numbers of their form.  The field labels the words
around digits and at signs; it learns from a small table of marked lines, and its best labels come from Viterbi, for many word sequences
at a time.  Words further from any digit or at sign are outside by definition, so sequences decode independently.  Spans that the field
finds are added where they touch no span of the patterns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sitewise.llm.bytetext import text_bytes
from sitewise.llm.common import texts

#: In the order in which spans of one place are listed; the last two are the field's alone.
KINDS = ("email", "ip", "card", "phone", "ssn", "secret")
BASE = KINDS[:4]
# fixed patterns; digits are taken whole and from their first, which finds the same in linear time
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Learning: steps, size of a step, weight of the squared parameters.
STEPS, RATE, RIDGE, SEED = 150, 0.1, 0.02, 3
#: Words kept on either side of a word with a digit or at sign.
AROUND = 2

#: Marked lines, ``[kind:text]``; the labelled table if no other is given.
MARKED = """
call me at [phone:(212) 555-0187] after nine
my phone is [phone:212-555-0143] or [phone:212.555.0190]
phone [phone:030 4455 6677] Berlin
tel. [phone:01 44 55 66 77] le matin
fax: [phone:0044 20 7946 0958]
reach [phone:+1 (415) 555-0132] today
ring [phone:+44 20 7946 0018], please
write to [email:anna.lee@example.org] soon
mail [email:support@lists.example.com], thanks
contact: [email:j_smith+news@uni.example.edu].
[email:bob@localhost] sent it
host [ip:10.0.0.12] answered
from [ip:198.51.100.23] at night
server [ip:192.168.1.77:8080] is down
ping [ip:203.0.113.9], then wait
card [card:4111 1111 1111 1111] expires
paid with [card:4242424242424242] yesterday
carte [card:5555-5555-5555-4444] refusée
Karte [card:6011111111111117] gesperrt
visa [card:378282246310005] declined
ssn [ssn:078-05-1120] on file
social security number [ssn:219-09-9999]
SSN: [ssn:457-55-5462].
password=[secret:c0ffee24d8a1b7e956] changed
token = "[secret:7c211433f02071597741e6ff5a8ea34789abbf43"]
TOKEN = "[secret:DA39A3EE5E6B4B0D3255BFEF95601890AFD80709"]
api_key: [secret:9f86d081884c7d659a2feaa0c55ad015]
secret=[secret:d4735e3a265e16eee03f59718b9b5d03] is set
License, version 3.
under version 2.0 of the License
CC BY-NC 4.0.
in 1998 and 2004 they met
the year 2021 was long
born on 12 May 1987 in Rome
on 2020-05-17 at 10:30
at 14:05:59 sharp
costs 19.99 or 1,250.00 euros
chapter 12 section 3.4.1
pages 120-135 of volume 7
about 300 people and 45 dogs
room 101 on floor 3
3 times 4 is 12
a 5.5 km walk in 40 minutes
route 66 and highway 101
ISBN 978-3-16-148410-0 printed
order 100200 shipped
100% of 250 cases
1. first 2. second 3. third
@home and @work are words
see table 4 and figure 12
""".strip()


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, in code points; those that fail their check are dropped and not tried again."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end(), "email"))
            done = domain.end()
        at = text.find("@", max(at + 1, done))
    for pattern, kind in ((_IP, "ip"), (_CARD, "card"), (_PHONE, "phone")):
        out += [(*m.span(), kind) for m in pattern.finditer(text) if passes(m[0], kind, 10)]
    return sorted(out, key=_listed)


def passes(found: str, kind: str, phone_digits: int = 7) -> bool:
    """Numbers that cannot be an address, a card or a telephone are not, whoever found them."""
    if kind == "ip":
        parts = [p.lstrip("0") or "0" for p in found.partition(":")[0].split(".")]
        return all(len(p) <= 3 and p.isdecimal() and int(p) <= 255 for p in parts)
    if kind == "card":
        digits = [int(c) for c in found if c in "0123456789"] if len(found) <= 40 else []
        return 14 <= len(digits) <= 19 and sum(d if k % 2 == 0 else (2 * d - 9 * (d > 4)) for k, d in enumerate(reversed(digits))) % 10 == 0
    return kind != "phone" or phone_digits <= sum(c in "0123456789" for c in found) <= 15


def _listed(span: tuple[int, int, str]) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


def described(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


# --- words, shapes and features

_WORD = re.compile(r"\S+")
_EDGE = "\"'.,;:!?#$%&*|<>[]{}="
_HEX = re.compile(r"[0-9a-fA-F]{12,}")


def sequences(text: str) -> list[list[tuple[int, int]]]:
    """Word spans near digits and at signs, those close to each other in one sequence."""
    words = [m.span() for m in _WORD.finditer(text)]
    out, last = [], -1
    for k, (a, b) in enumerate(words):
        if not _active(text[a:b]):
            continue
        low, high = max(0, k - AROUND), min(len(words), k + AROUND + 1)
        if out and low <= last:
            out[-1] += words[last:high]
        else:
            out.append(words[low:high])
        last = high
    return out


def _active(word: str) -> bool:
    return any(c in "0123456789@" for c in word)


def shape(word: str) -> str:
    """Letters as a or A, digits as 9 with their number up to 6, marks as they are; runs of letters once."""
    word = re.sub(r"[0-9]+", lambda m: "9" * min(len(m[0]), 6), word[:80])
    word = re.sub(r"[^\W\d_]+", lambda m: "A" if m[0].isupper() else "a", word)
    return word


def features(words: list[str], k: int) -> list[str]:
    word, trimmed = words[k], words[k].strip(_EDGE)
    digits = sum(c.isdigit() for c in word)
    out = ["bias", "s=" + shape(trimmed), f"n={min(digits, 17)}", f"long={min(len(trimmed) // 8, 4)}"]
    if not _active(word):
        out.append("plain")
    if "@" in word:
        out += ["at", "at." if "." in word[word.index("@") :] else "at-"]
    out.append("marks=" + "".join(sorted({c for c in trimmed if not c.isalnum()}))[:6])
    if _HEX.search(trimmed) and re.search("[a-fA-F]", trimmed):
        out.append("hex")
    if trimmed.isdigit():
        out.append("digits")
    if "=" in word:
        out.append("assigned")
    before = words[k - 1] if k else "^"
    after = words[k + 1] if k + 1 < len(words) else "$"
    out += ["<" + shape(before.strip(_EDGE)), ">" + shape(after.strip(_EDGE)), "<w=" + before.strip(_EDGE).lower()[:12], f"pair={min(digits, 6)}{shape(before.strip(_EDGE))}"]
    return out


# --- the field

STATES = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
_N = len(STATES)
#: A word inside a span follows one of its kind.
ALLOWED = np.array([[not b.startswith("I-") or (a[1:] == b[1:] and a != "O") for b in STATES] for a in STATES])
OPENING = np.array([not s.startswith("I-") for s in STATES])


@dataclass
class Field:
    weights: dict[str, np.ndarray]
    moves: np.ndarray

    def scores(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), _N))
        for k in range(len(words)):
            for f in features(words, k):
                w = self.weights.get(f)
                if w is not None:
                    out[k] += w
        return out

    def decode(self, found: list[np.ndarray]) -> list[np.ndarray]:
        """Best states of each sequence of word scores; sequences of like length go through Viterbi together."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(found)
        order = sorted(range(len(found)), key=lambda i: len(found[i]))
        for a in range(0, len(order), 512):
            own = order[a : a + 512]
            lengths = np.array([len(found[i]) for i in own])
            padded = np.zeros((len(own), int(lengths.max()), _N))
            for r, i in enumerate(own):
                padded[r, : lengths[r]] = found[i]
            for r, states in enumerate(viterbi(padded, lengths, self.moves)):
                out[own[r]] = states
        return out


def viterbi(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> list[np.ndarray]:
    """Best path of each of (sequences, words, states) scores."""
    n, t, _ = scores.shape
    moves = np.where(ALLOWED, moves, -1e9)
    best = scores[:, 0] + np.where(OPENING, 0, -1e9)
    back = np.zeros((n, t, _N), np.int64)
    ended = np.where((lengths == 1)[:, None], best, 0)
    for k in range(1, t):
        reach = best[:, :, None] + moves
        back[:, k] = reach.argmax(1)
        best = reach.max(1) + scores[:, k]
        ended = np.where((lengths == k + 1)[:, None], best, ended)
    path = np.zeros((n, t), np.int64)
    state, rows = ended.argmax(1), np.arange(n)
    for k in range(t - 1, -1, -1):
        inside = k < lengths
        path[inside, k] = state[inside]
        state = np.where(inside, back[rows, k, state], state)
    return [p[:m] for p, m in zip(path, lengths, strict=True)]


def labelled_lines(marked: str) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Lines and their spans from lines with marks."""
    out = []
    for line in marked.split("\n"):
        text, spans, at = "", [], 0
        for m in re.finditer(r"\[(\w+):([^\]]+)\]", line):
            text += line[at : m.start()]
            spans.append((len(text), len(text) + len(m[2]), m[1]))
            text, at = text + m[2], m.end()
        out.append((text + line[at:], spans))
    return out


def train(lines: list[tuple[str, list[tuple[int, int, str]]]]) -> Field:
    """Maximum likelihood with a ridge, by gradient steps over all lines at once; forward and backward sums in logarithms."""
    rows, gold = [], []
    for text, spans in lines:
        for words in sequences(text):
            states = []
            for a, b in words:
                kind = next(((s, k) for s, e, k in spans if s < b and e > a), None)
                states.append(0 if kind is None else STATES.index(("B-" if kind[0] >= a or not states or states[-1] == 0 else "I-") + kind[1]))
            rows.append([features([text[a:b] for a, b in words], k) for k in range(len(words))])
            gold.append(states)
    if not rows:
        return Field({}, np.zeros((_N, _N)))
    names = sorted({f for r in rows for word in r for f in word})
    index = {f: i for i, f in enumerate(names)}
    lengths = np.array([len(r) for r in rows])
    n, t = len(rows), int(lengths.max())
    x = np.zeros((n, t, len(names)), np.float32)
    y = np.zeros((n, t), np.int64)
    for i, (r, states) in enumerate(zip(rows, gold, strict=True)):
        y[i, : len(states)] = states
        for k, word in enumerate(r):
            x[i, k, [index[f] for f in word]] = 1
    real = np.arange(t) < lengths[:, None]
    seen = np.eye(_N)[y] * real[:, :, None]
    seen_moves = sum(seen[:, k - 1].T @ seen[:, k] for k in range(1, t))
    w, moves = np.zeros((len(names), _N)), np.zeros((_N, _N))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(moves), np.zeros_like(moves)]
    for step in range(1, STEPS + 1):
        scores = x @ w
        masked = np.where(ALLOWED, moves, -1e9)
        forward = np.zeros((n, t, _N))
        forward[:, 0] = scores[:, 0] + np.where(OPENING, 0, -1e9)
        for k in range(1, t):
            forward[:, k] = np.logaddexp.reduce(forward[:, k - 1][:, :, None] + masked, axis=1) + scores[:, k]
        backward = np.zeros((n, t, _N))
        for k in range(t - 2, -1, -1):
            on = np.logaddexp.reduce(masked[None] + (scores[:, k + 1] + backward[:, k + 1])[:, None, :], axis=2)
            backward[:, k] = np.where(real[:, k + 1][:, None], on, 0)
        total = np.logaddexp.reduce(forward[np.arange(n), lengths - 1], axis=1)
        belief = np.exp(forward + backward - total[:, None, None]) * real[:, :, None]
        expected = np.zeros((_N, _N))
        for k in range(1, t):
            pair = forward[:, k - 1][:, :, None] + masked + (scores[:, k] + backward[:, k])[:, None, :] - total[:, None, None]
            expected += (np.exp(pair) * real[:, k][:, None, None]).sum(0)
        grads = [np.einsum("ntf,nts->fs", x, belief - seen) + RIDGE * w, expected - seen_moves + RIDGE * moves]
        for value, grad, (m, v) in zip((w, moves), grads, (state[:2], state[2:]), strict=True):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            value -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field({f: w[i] for f, i in index.items()}, moves)


def field_spans(text: str, words: list[tuple[int, int]], states: np.ndarray) -> list[tuple[int, int, str]]:
    """Spans of labelled words without the marks at their edges; words before an equals sign are not part of what is assigned."""
    spans: list[list] = []
    for (a, b), s in zip(words, states, strict=True):
        if s == 0:
            continue
        name = STATES[s]
        if name.startswith("I-") and spans and spans[-1][2] == name[2:]:
            spans[-1][1] = b
        else:
            spans.append([a, b, name[2:]])
    out = []
    for a, b, kind in spans:
        if kind == "secret" and "=" in text[a:b]:
            a += text[a:b].index("=") + 1
        while a < b and text[a] in _EDGE:
            a += 1
        while a < b and text[b - 1] in _EDGE:
            b -= 1
        if any(c in "0123456789@" for c in text[a:b]) and passes(text[a:b], kind):
            out.append((a, b, kind))
    return out


def all_spans(found: list[str], field: Field) -> list[tuple[list, list]]:
    """(spans of the patterns, all spans) of each text."""
    base = [base_spans(text) for text in found]
    places = [(i, words) for i, text in enumerate(found) for words in sequences(text)]
    states = field.decode([field.scores([found[i][a:b] for a, b in words]) for i, words in places])
    more: list[list] = [[] for _ in found]
    for (i, words), path in zip(places, states, strict=True):
        more[i] += field_spans(found[i], words, path)
    out = []
    for own, added in zip(base, more, strict=True):
        covered, merged, k = sorted(s[:2] for s in own), [], 0
        reach = np.maximum.accumulate([e for _, e in covered]) if covered else []
        for a, b, kind in sorted(added):
            k = int(np.searchsorted([s for s, _ in covered], b)) if covered else 0
            if not k or reach[k - 1] <= a:
                merged.append((a, b, kind))
        out.append((own, sorted(own + merged, key=_listed)))
    return out


def find_private(docs: DataFrame, marked: str = MARKED) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone (of the patterns), n_added, base (their spans), spans (all).

    Spans are kind:start:end in code points, the end exclusive, by start, kind and end.  A null or empty text has none, and an empty
    table gives no rows.
    """
    field = train(labelled_lines(marked))
    digit_or_at = np.zeros(256, bool)
    digit_or_at[[*range(48, 58), 64]] = True

    def job(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            column = batch.column("text")
            data, offsets = text_bytes(column)
            total = np.concatenate([[0], np.cumsum(digit_or_at[data])])
            rows = np.flatnonzero(total[offsets[1:]] > total[offsets[:-1]])
            counts = np.zeros((5, batch.num_rows), np.int64)
            base, spans = [""] * batch.num_rows, [""] * batch.num_rows
            for a in range(0, len(rows), 256):
                some = rows[a : a + 256]
                for i, (own, all_) in zip(some.tolist(), all_spans([column[i].as_py() for i in some.tolist()], field), strict=True):
                    base[i], spans[i] = described(own), described(all_)
                    counts[:4, i] = [sum(s[2] == kind for s in own) for kind in BASE]
                    counts[4, i] = len(all_) - len(own)
            yield pa.record_batch(
                [batch.column("doc_id"), *map(pa.array, counts), pa.array(base, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_added", "base", "spans"],
            )

    return texts(docs).mapInArrow(job, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, n_added bigint, base string, spans string")

