"""Small corpora with what is awkward: nulls, empty and long texts, ties, repeated rows, columns of clashing names."""

from __future__ import annotations

import random
import re
from collections import Counter

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n int, k1 string, node string, row int, `class` string, score string, `a.b` string"


def frame(spark, rows):
    """Documents of (doc_id, text); the other columns clash with names that operators use inside."""
    full = [(i, t, None if i is None else "en", "s", None if t is None else len(t), 1, "x", None, 2, "c", "z", "d") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(seed: int, n: int, size: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def edited(text: str, seed: int, edits: int) -> str:
    rng, parts = random.Random(seed), text.split(" ")
    for _ in range(edits):
        parts[rng.randrange(len(parts))] = f"x{rng.randrange(10_000)}"
    return " ".join(parts)


def awkward() -> list[tuple[int | None, str | None]]:
    long = words(1, 3000)
    return [
        (1, None), (2, ""), (3, " \t\n "), (4, "Same text"), (5, "Sametext"), (6, "same text"), (7, "Same  text"), (7, "Same  text"),
        (None, "Same text"), (None, None), (8, long), (9, long), (10, edited(long, 2, 20)), (11, "é ü ñ 世界 \U0001f600"), (12, "é ü ñ 世界 \U0001f600"),
        (13, "a b"), (14, "A b!"), (15, "x\x00y"), (16, long + " tail"), (17, "one\ntwo\n\none"), (18, words(3, 60)), (19, edited(words(3, 60), 4, 1)),
    ]


def shingle_counts(text: str | None, k: int = 5) -> Counter:
    spoken = re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", (text or "").translate(FOLD))
    return Counter(tuple(spoken[j : j + k]) for j in range(max(1, len(spoken) - k + 1))) if spoken else Counter()
