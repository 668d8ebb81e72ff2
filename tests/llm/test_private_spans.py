"""Patterns against plain expressions, the field against its own lines, Viterbi against all paths."""

import itertools
import random
import re

import numpy as np
from corpus import awkward, frame

from sitewise.llm import private
from sitewise.llm.private import KINDS, MARKED, all_spans, base_spans, find_private, labelled_lines, train

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def plain(text):
    out = [(*m.span(), "email") for m in EMAIL.finditer(text)]
    out += [(*m.span(), "ip") for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((*m.span(), "card"))
    out += [(*m.span(), "phone") for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def test_patterns():
    rng = random.Random(2)
    for _ in range(20_000):
        text = "".join(rng.choice("a1@.- +()9_é0" + "0123456789" * rng.randint(0, 2)) for _ in range(rng.randint(0, 40)))
        assert base_spans(text) == plain(text), text


def test_long_runs_take_linear_time():
    for piece in ("1", "a", "1.", "a@", "+1", "1 ", "@", "a.b@c"):
        base_spans(piece * 200_000)


def test_field_learns_its_lines_and_their_like():
    field = train(labelled_lines(MARKED))
    found = lambda text: {(text[a:b], kind) for a, b, kind in all_spans([text], field)[0][1]}
    right = total = 0
    for text, spans in labelled_lines(MARKED):
        want = {(text[a:b].strip('"'), kind) for a, b, kind in spans if private.passes(text[a:b], kind)}
        right += len(want & found(text))
        total += len(want)
    assert right >= 0.9 * total
    assert ("(646) 555-0123", "phone") in found("call me at (646) 555-0123 after ten")
    assert ("0f1e2d3c4b5a69788796a5b4c3d2e1f00f1e2d3c", "secret") in found('the token = "0f1e2d3c4b5a69788796a5b4c3d2e1f00f1e2d3c" leaked')
    assert found("in 1776 and 1789, version 2.1 of chapter 7 cost 12.50 euros") == set()


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(0)
    n = len(private.STATES)
    scores, moves, lengths = rng.normal(size=(6, 3, n)), rng.normal(size=(n, n)), np.array([1, 2, 3, 3, 2, 1])
    for row, length, path in zip(scores, lengths, private.viterbi(scores, lengths, moves), strict=True):
        best = max(
            (p for p in itertools.product(range(n), repeat=int(length)) if private.OPENING[p[0]] and all(private.ALLOWED[a, b] for a, b in itertools.pairwise(p))),
            key=lambda p: sum(row[k, s] for k, s in enumerate(p)) + sum(moves[a, b] for a, b in itertools.pairwise(p)),
        )
        assert tuple(path) == best


def test_query_columns_and_awkward_rows(spark):
    rows = awkward() + [(900, "é x@y.zz, 10.0.0.1 or 4111 1111 1111 1111, +1 (415) 555-0132"), (901, "a@b.c" * 3)]
    got = {r.doc_id: r for r in find_private(frame(spark, rows)).collect()}
    r = got[900]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1) and r.base == "email:2:8,ip:10:18,card:22:41,phone:43:60"
    assert set(r.base.split(",")) <= set(r.spans.split(","))
    assert got[1].spans == got[2].spans == "" and find_private(frame(spark, [])).collect() == []
    assert find_private(frame(spark, rows)).count() == len(rows)


def made_up(rng, kind):
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == "phone":
        return rng.choice([f"({digits(3)}) 555-{digits(4)}", f"{digits(3)}-555-{digits(4)}", f"{digits(3)}.555.{digits(4)}"])
    if kind == "ssn":
        return f"{digits(3)}-{digits(2)}-{digits(4)}"
    if kind == "secret":
        return "a" + "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([31, 39, 63]))) + "7"
    raise ValueError(kind)


def test_recall_of_values_in_prose_the_field_has_not_seen():
    """Values of kinds and forms the patterns leave out, amid words of the given documents: 0.9 of each kind, and clean prose stays clean."""
    import pyarrow.parquet as pq

    rng = random.Random(11)
    lines = [line for t in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist() for line in (t or "").split("\n")]
    prose = [w[:12] for w in (re.sub(r"[0-9@]\S*", "", line).split() for line in lines) if len(w) >= 12][:600]
    field = train(labelled_lines(MARKED))
    # with a word that tells the kind before the value, and with nothing but prose around it
    for kind, word in [("phone", "phone"), ("ssn", "ssn"), ("secret", "token ="), ("phone", ""), ("ssn", ""), ("secret", "")]:
        planted, where = [], []
        for words in prose:
            value, cut = made_up(rng, kind), rng.randint(3, 9)
            before = " ".join([*words[:cut], *word.split()]) + " "
            planted.append(before + value + " " + " ".join(words[cut:]))
            where.append((len(before), len(before) + len(value)))
        found = all_spans(planted, field)
        exact = sum(any(s[:2] == at for s in spans) for at, (_, spans) in zip(where, found, strict=True))
        assert exact >= 0.9 * len(prose), (kind, word)
    assert not any(spans for _, spans in all_spans([" ".join(w) for w in prose], field))


def test_digits_of_the_given_documents(spark):
    """Every word with a digit lies in a span, but version numbers of licence lines and numbers that are no card."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = {r.doc_id: r.spans for r in find_private(docs).collect()}
    left = []
    for r in docs.select("doc_id", "text").collect():
        spans = [tuple(map(int, s.split(":")[1:])) for s in found[r.doc_id].split(",") if s]
        for m in re.finditer(r"\S*[0-9]\S*", r.text or ""):
            if not any(a < m.end() and m.start() < b for a, b in spans):
                left.append(m[0].strip(".,;:"))
    assert [w for w in left if len(w) > 3 and not (w.isdigit() and 14 <= len(w) <= 19 and not luhn(list(map(int, w))))] == []
