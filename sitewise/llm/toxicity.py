"""Toxicity as a probability, by a convolutional network over hashed words.

A word's vector joins three learned tables: two by hashes of the word, so that words that share a bucket of one differ in the other,
and one by its first bytes, which related forms share.  Filters of several widths read neighbouring words, the largest response of each
over the whole text is kept, and a logistic unit combines them.  Learning is numpy on the driver over a bounded sample; the tables
start from the log odds of their buckets.  All labelled rows that the network has not learnt from, a part of the sample that is set aside
and every row beyond it, give for each language the response at which a text counts as toxic: Spark counts them by language and response.
Scores are moved so that this point is ``DECIDED``.  The language is guessed from the text's own function words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sitewise.llm.bytetext import IS_WORD, batches, runs, text_bytes, word_hashes, word_spans
from sitewise.llm.common import texts
from sitewise.llm.quality import held_out, learnable, learning_rows
from sitewise.session import durable

BUCKETS, DIM, PREFIX = 1 << 16, 4, 4
WIDTHS, FILTERS = (1, 2, 3), 8
PER_CLASS, LONGEST = 2000, 50_000
EPOCHS, BATCH, RATE, SEED = 6, 64, 0.05, 5
DECIDED = 0.7
#: Responses are counted in steps of this part of one, up to this size; the counts are bounded, however many rows.
STEPS, FARTHEST = 1024, 64
#: Bytes of one text pooled at a time, and how far neighbouring parts overlap; a longer word may be cut.
SEGMENT, OVERLAP = 1 << 22, 4096
# fixed values: function words by language
FUNCTION_WORDS = {
    "de": "der die und den das nicht mit für von ist",
    "en": "the and of to that is with for this by",
    "es": "el los las del por con una no lo su",
    "fr": "le les des et une est du au pas qui",
}
LANGUAGES = [*sorted(FUNCTION_WORDS), "other"]


def _hashed(words: str) -> np.ndarray:
    data, offsets = text_bytes(pa.array([words]))
    return word_hashes(data, *word_spans(data, offsets)[:2])


class Words:
    """Table rows of the words of many texts, and the language of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, functions: list[np.ndarray]) -> None:
        starts, lengths, self.counts = word_spans(data, offsets)
        full = word_hashes(data, starts, lengths)
        stem = word_hashes(data, starts, lengths, PREFIX)
        low = np.uint64(BUCKETS - 1)
        self.ids = np.stack([full & low, (full >> np.uint64(20)) & low, stem & low], 1).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(self.counts)])
        spoken = []
        for known in functions:
            total = np.concatenate([[0], np.cumsum(np.isin(full, known))])
            spoken.append(total[ends[1:]] - total[ends[:-1]])
        spoken = np.stack(spoken, 1)
        self.language = np.where(spoken.max(1) > 0, spoken.argmax(1), len(functions))


class WordNetwork:
    def __init__(self) -> None:
        rng = np.random.default_rng(SEED)
        self.functions = [_hashed(FUNCTION_WORDS[x]) for x in sorted(FUNCTION_WORDS)]
        self.tables = rng.normal(0, 0.01, (3, BUCKETS, DIM)).astype(np.float32)
        self.filters = [rng.normal(0, 0.1, (w, 3 * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        for f in self.filters:
            f[0, ::DIM, : FILTERS // 2] += 0.5  # half of the filters begin by adding up log odds
        self.offsets = np.full(len(WIDTHS) * FILTERS, -0.5, np.float32)
        self.weights = np.full(len(WIDTHS) * FILTERS, 0.2, np.float32)
        self.bias = np.zeros(1, np.float32)
        self.threshold = np.zeros(len(LANGUAGES))

    def read(self, data: np.ndarray, offsets: np.ndarray) -> Words:
        return Words(data, offsets, self.functions)

    def layout(self, ids: np.ndarray, counts: np.ndarray):
        """Word vectors with blank words after each text, so that every filter fits; first row and real rows per text."""
        rows = np.maximum(counts, 1) + max(WIDTHS) - 1
        first = np.cumsum(rows) - rows
        place = np.repeat(first, counts) + runs(counts)
        x = np.zeros((int(rows.sum()), 3 * DIM), np.float32)
        for t in range(3):
            x[place, t * DIM : (t + 1) * DIM] = self.tables[t][ids[:, t]]
        return x, first, np.maximum(counts, 1), place

    def responses(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(WIDTHS) * FILTERS), np.float32)
        for n, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            for k in range(w):
                out[: len(x) - k, n * FILTERS : (n + 1) * FILTERS] += (x @ f[k])[k:]
        return out + self.offsets

    def pooled(self, words: Words, goes_on: bool = False) -> np.ndarray:
        """Largest responses; of a text that goes on, without those that would read beyond it."""
        x, first, real, _ = self.layout(words.ids, words.counts)
        if goes_on:
            real = np.maximum(real - max(WIDTHS) + 1, 1)
        out = self.responses(x)
        ends = np.stack([first, first + real], 1).ravel()
        ends[-1] = min(ends[-1], len(out) - 1)
        return np.maximum(np.maximum.reduceat(out, ends, axis=0)[::2], 0)

    def response(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Response and language of each text."""
        sizes = np.diff(offsets)
        if len(sizes) == 1 and sizes[0] > SEGMENT:
            parts = [self.read(p, np.array([0, len(p)])) for p in _parts(data)]
            best = np.max([self.pooled(w, goes_on=w is not parts[-1]) for w in parts], axis=0)
            votes = np.bincount([w.language[0] for w in parts], minlength=len(LANGUAGES))
            language = np.array([votes[:-1].argmax() if votes[:-1].any() else len(votes) - 1])
        else:
            words = self.read(data, offsets)
            best, language = self.pooled(words), words.language
        return (best @ self.weights + self.bias[0]).astype(np.float64), language

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Response less the threshold of the text's language."""
        response, language = self.response(data, offsets)
        return response - self.threshold[language]

    def step(self, ids: np.ndarray, counts: np.ndarray, label: np.ndarray, seen: dict) -> None:
        """One step of AdaGrad; only the winning words of each filter move."""
        x, first, real, _ = self.layout(ids, counts)
        out = self.responses(x)
        winner = np.array([b + out[b : b + c].argmax(0) for b, c in zip(first, real, strict=True)])
        units = np.arange(out.shape[1])
        best = out[winner, units]
        error = (1 / (1 + np.exp(-(np.maximum(best, 0) @ self.weights + self.bias[0]))) - label) / len(label)
        pull = error[:, None] * self.weights * (best > 0)
        begin = np.cumsum(counts) - counts
        word_of = np.where(counts[:, None] > 0, winner - first[:, None] + begin[:, None], -1)
        last = (begin + counts)[:, None]
        moved, by = [], []
        filter_grads = []
        for n, w in enumerate(WIDTHS):
            own = slice(n * FILTERS, (n + 1) * FILTERS)
            grad = np.zeros_like(self.filters[n])
            for k in range(w):
                grad[k] = np.einsum("dfx,df->xf", x[winner[:, own] + k], pull[:, own])
                at = word_of[:, own] + k
                real_word = (word_of[:, own] >= 0) & (at < last)
                moved.append(at[real_word])
                by.append((pull[:, own, None] * self.filters[n][k].T)[real_word])
            filter_grads.append(grad)
        for name, value, grad in [
            *[(f"f{n}", self.filters[n], g) for n, g in enumerate(filter_grads)],
            ("o", self.offsets, pull.sum(0)), ("w", self.weights, error @ np.maximum(best, 0)), ("b", self.bias, np.array([error.sum()])),
        ]:
            total = seen.setdefault(name, np.full_like(value, 1e-6))
            total += grad * grad
            value -= RATE * grad / np.sqrt(total)
        rows, grads = np.concatenate(moved), np.concatenate(by)
        for t in range(3):
            bucket, place = np.unique(ids[rows, t], return_inverse=True)
            grad = np.zeros((len(bucket), DIM), np.float32)
            np.add.at(grad, place, grads[:, t * DIM : (t + 1) * DIM])
            total = seen.setdefault("t", np.full(self.tables.shape, 1e-6, np.float32))[t]
            total[bucket] += grad * grad
            self.tables[t][bucket] -= RATE * grad / np.sqrt(total[bucket])


def _parts(data: np.ndarray) -> list[np.ndarray]:
    """A long text in overlapping parts that begin and end between words where the overlap holds such places."""
    parts, a = [], 0
    while a + SEGMENT < len(data):
        gap = np.flatnonzero(~IS_WORD[data[a + SEGMENT - OVERLAP // 4 : a + SEGMENT]])
        parts.append(data[a : a + SEGMENT - (OVERLAP // 4 - int(gap[-1]) if len(gap) else 0)])
        a += SEGMENT - OVERLAP
        gap = np.flatnonzero(~IS_WORD[data[a : a + OVERLAP // 4]])
        a += int(gap[0]) if len(gap) else 0
    return [*parts, data[a:]]


def train(sample: pa.Table, share: float) -> tuple[WordNetwork, np.ndarray]:
    """Learns from rows (doc_id, text, label): the network and the ids learnt from; a sample without one of the classes gives the share of label 1
    for every text."""
    network = WordNetwork()
    label = sample.column("label").to_numpy().astype(np.float32)
    if not len(label) or label.min() == label.max():
        share = min(max(share, 1e-3), 1 - 1e-3)
        network.weights[:], network.bias[:] = 0, np.log(share / (1 - share))
        return network, np.zeros(0, np.int64)
    data, offsets = text_bytes(sample.column("text").combine_chunks())
    words = network.read(data, offsets)
    begin = np.cumsum(words.counts) - words.counts
    rng = np.random.default_rng(SEED)
    aside = np.zeros(len(label), bool)
    for value in (0, 1):
        own = rng.permutation(np.flatnonzero(label == value))
        aside[own[: len(own) // 4]] = True
    fit = np.flatnonzero(~aside)

    text_of = np.repeat(np.arange(len(label)), words.counts)
    learnt = ~aside[text_of]
    for t in range(3):
        pairs = np.unique(text_of[learnt] * BUCKETS + words.ids[learnt, t])
        bucket, toxic = pairs % BUCKETS, label[pairs // BUCKETS]
        ones, zeros = np.bincount(bucket, toxic, BUCKETS), np.bincount(bucket, 1 - toxic, BUCKETS)
        odds = np.log((ones + 0.5) / (label[fit].sum() + 1)) - np.log((zeros + 0.5) / ((1 - label[fit]).sum() + 1))
        network.tables[t][:, 0] += np.clip(odds * (ones + zeros) / (ones + zeros + 2), -3, 3)
    seen: dict = {}
    for _ in range(EPOCHS):
        order = rng.permutation(fit)
        for b in range(0, len(order), BATCH):
            own = order[b : b + BATCH]
            at = np.repeat(begin[own], words.counts[own]) + runs(words.counts[own])
            network.step(words.ids[at], words.counts[own], label[own], seen)
    return network, np.unique(sample.column("doc_id").to_numpy()[fit])


def respond(docs: DataFrame, network: WordNetwork) -> DataFrame:
    """doc_id, response and language (a place in ``LANGUAGES``) of every whole text."""

    def job(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            response, language = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int32)
            for i, j, data, offsets in batches(batch.column("text")):
                response[i:j], language[i:j] = network.response(data, offsets)
            yield pa.record_batch([batch.column("doc_id"), pa.array(response), pa.array(language)], names=["doc_id", "response", "language"])

    return texts(docs).mapInArrow(job, "doc_id bigint, response double, language int")


def _thresholds(heard: DataFrame, usable: DataFrame) -> np.ndarray:
    """Per language the response that best tells the classes of all rows (doc_id, label) apart, drawn towards that of all languages."""
    place = F.floor(F.greatest(F.least("response", F.lit(float(FARTHEST))), F.lit(-float(FARTHEST))) * STEPS)
    counts = heard.join(usable, "doc_id").groupBy("language", place.alias("place")).agg(F.sum("label").alias("ones"), F.count(F.lit(1)).alias("n"))
    table = counts.toArrow()  # at most 2 * FARTHEST * STEPS rows a language
    language, place, ones, n = (table.column(c).to_numpy() for c in ("language", "place", "ones", "n"))

    def cut(own: np.ndarray) -> float:
        at, back = np.unique(place[own], return_inverse=True)
        pos, every = np.bincount(back, ones[own]), np.bincount(back, n[own])
        # errors if everything from place i on counts as toxic; in the middle of the widest of the best gaps
        errors = np.concatenate([[0], np.cumsum(pos)]) + np.concatenate([np.cumsum((every - pos)[::-1])[::-1], [0]])
        edges = np.concatenate([[at[0] - STEPS], (at[1:] + at[:-1] + 1) / 2, [at[-1] + STEPS]]) / STEPS
        gaps = np.concatenate([[0], at[1:] - at[:-1], [0]])
        best = np.flatnonzero(errors == errors.min())
        return float(edges[best[gaps[best].argmax()]])

    def both(own: np.ndarray) -> bool:
        return 0 < ones[own].sum() < n[own].sum()

    out = np.zeros(len(LANGUAGES))
    if both(n > 0):
        out[:] = cut(n > 0)
        for k in range(len(LANGUAGES)):
            if both(language == k):
                trust = min(n[language == k].sum(), 200) / 200
                out[k] = trust * cut(language == k) + (1 - trust) * out[k]
    return out


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (probability of toxic 1), predicted.

    Labels are (doc_id, toxic); null or other labels are left out, repeated ones count once.  Empty tables give empty results, no
    labels a constant score; an empty text has the response of no words.
    """
    sample, share = learning_rows(docs, labels, "toxic", PER_CLASS, LONGEST)
    network, learnt = train(sample, share)
    heard = durable(respond(docs, network), "toxicity")  # three numbers a row
    if len(learnt):
        fitted = docs.sparkSession.createDataFrame(pa.table({"doc_id": pa.array(learnt, pa.int64())}))
        network.threshold = _thresholds(heard, learnable(labels, "toxic").join(F.broadcast(fitted), "doc_id", "left_anti"))
    place = float(np.log(DECIDED / (1 - DECIDED)))
    logit = F.col("response") - F.get(F.array(*map(F.lit, network.threshold.tolist())), F.col("language")) + place
    scored = heard.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.least(logit, F.lit(30.0)), F.lit(-30.0)))))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= DECIDED).cast("int").alias("predicted"))
