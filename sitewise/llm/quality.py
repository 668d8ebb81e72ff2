"""Quality as the probability that a text is good, by a convolutional network over its bytes.

Each byte has a small learned vector.  Learned filters read ``WIDTH`` bytes at every fourth byte; their responses are averaged over
overlapping chunks that cover the whole text, the largest average of each filter and of its negative are kept, and one logistic
unit combines them.
Learning is numpy on the driver over a bounded sample; scoring is numpy over Arrow batches, a bounded piece of text at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sitewise.llm.bytetext import batches, runs, text_bytes
from sitewise.llm.common import bounded_sample, in_small_batches, texts

#: Vector per byte; filters; bytes per step, steps per filter; steps in half a chunk.
DIM, FILTERS, STRIDE, TAPS, HALF = 8, 16, 4, 3, 64
#: Steps without response that are added to every chunk, so that a few steps of a short text do not stand out.
SHRINK = 24
WIDTH = STRIDE * TAPS
#: Learning sees this many labelled rows of either class, those of smallest id hash, and of these only texts up to so many code points.
PER_CLASS, LONGEST = 800, 50_000
EPOCHS, BATCH, RATE, SEED = 10, 48, 0.02, 11
#: Bytes of one text pooled at a time: whole half chunks.
SEGMENT = HALF * STRIDE * 1024


def held_out(doc_id: Column | str) -> Column:
    """Is the row kept from learning: crc32 of the id as text has remainder 1 modulo 3; not so for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learnable(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) of all rows that may be learnt from."""
    usable = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label")).distinct()
    return usable.filter(~held_out("doc_id") & F.col("label").isin(0, 1))


def learning_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int, longest: int) -> tuple[pa.Table, float]:
    """(doc_id, text, label) of a bounded sample, and the share of label 1 among all rows that may be learnt from."""
    usable = learnable(labels, label)
    share = usable.agg(F.avg("label")).first()[0]
    short = texts(docs).filter(F.length("text") <= longest)
    chosen = []
    for value in (0, 1):
        chosen.append(bounded_sample(usable.filter(F.col("label") == value), per_class))
    rows = short.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")  # per_class rows of two numbers for either class
    # sorted, so that learning does not depend on the order in which tasks end
    sample = rows.select("doc_id", "label", "text").toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending"), ("text", "ascending")])
    return sample.select(["doc_id", "text", "label"]).slice(0, 4 * per_class), 0.5 if share is None else float(share)


class ByteNetwork:
    """Parameters: byte vectors (256, DIM), filters (TAPS * STRIDE * DIM, FILTERS), their offsets, weights of the logistic unit."""

    def __init__(self) -> None:
        rng = np.random.default_rng(SEED)
        kinds = np.array([_kind(b) for b in range(256)])
        self.vectors = (np.eye(DIM)[kinds] + rng.normal(0, 0.05, (256, DIM))).astype(np.float32)
        self.filters = rng.normal(0, 0.25, (WIDTH * DIM, FILTERS)).astype(np.float32)
        self.offsets = np.zeros(FILTERS, np.float32)
        self.weights = rng.normal(0, 0.3, 2 * FILTERS).astype(np.float32)
        self.bias = np.zeros(1, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.vectors, self.filters, self.offsets, self.weights, self.bias]

    def responses(self, data: np.ndarray, offsets: np.ndarray):
        """Bytes laid out in whole steps, filter responses per step, and where each text's steps begin and how many are real."""
        sizes = np.diff(offsets)
        steps = np.maximum(TAPS, -(-sizes // STRIDE))
        first = np.cumsum(steps) - steps
        laid = np.zeros(int(steps.sum()) * STRIDE, np.uint8)
        laid[np.repeat(first * STRIDE - offsets[:-1], sizes) + np.arange(len(data))] = data
        x = self.vectors[laid].reshape(-1, STRIDE * DIM)
        taps = self.filters.reshape(TAPS, STRIDE * DIM, FILTERS)
        n = len(x)
        out = np.zeros((n, FILTERS), np.float32)
        for k in range(TAPS):
            out[: n - k] += (x @ taps[k])[k:]
        out += self.offsets
        np.maximum(out, 0, out=out)
        last = first + steps
        for k in range(1, TAPS):
            out[last - k] = 0  # would read the next text
        return laid, out, first, steps - TAPS + 1

    def chunks(self, out: np.ndarray, first: np.ndarray, real: np.ndarray):
        """Mean response of each chunk of two half chunks, its first step and size, and the chunks per text."""
        halves = -(-real // HALF)
        place = runs(halves)
        at = np.repeat(first, halves) + place * HALF
        size = np.minimum(HALF, np.repeat(real, halves) - place * HALF)
        sums = np.add.reduceat(out, at, axis=0)
        # a segment's padding steps are zero, so sums hold real steps only
        number = np.maximum(halves - 1, 1)
        left = np.repeat(np.cumsum(halves) - halves, number) + runs(number)
        right = np.where(np.repeat(halves, number) > 1, left + 1, left)
        both = right > left
        total = size[left] + np.where(both, size[right], 0)
        mean = (sums[left] + np.where(both[:, None], sums[right], 0)) / (total + SHRINK)[:, None]
        return mean, at[left], total, number

    def pooled(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        _, out, first, real = self.responses(data, offsets)
        mean, _, _, number = self.chunks(out, first, real)
        return np.maximum.reduceat(np.hstack([mean, -mean]), np.cumsum(number) - number, axis=0)

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of texts that are long together or alone; long ones are pooled by segments that share half a chunk."""
        sizes = np.diff(offsets)
        if len(sizes) == 1 and sizes[0] > SEGMENT:
            step = SEGMENT - HALF * STRIDE
            parts = [data[a : a + SEGMENT + WIDTH - STRIDE] for a in range(0, int(sizes[0]) - HALF * STRIDE, step)]
            best = np.max([self.pooled(p, np.array([0, len(p)])) for p in parts], axis=0)
        else:
            best = self.pooled(data, offsets)
        return best @ self.weights + self.bias[0]

    def gradients(self, data: np.ndarray, offsets: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
        laid, out, first, real = self.responses(data, offsets)
        mean, start, size, number = self.chunks(out, first, real)
        begin = np.cumsum(number) - number
        n = len(label)
        both = np.hstack([mean, -mean])
        winner = np.array([b + both[b : b + c].argmax(0) for b, c in zip(begin, number, strict=True)])
        best = both[winner, np.arange(2 * FILTERS)]
        error = (1 / (1 + np.exp(-(best @ self.weights + self.bias[0]))) - label) / n
        grads = [np.zeros_like(p) for p in self.parameters()]
        grads[3][:], grads[4][:] = error @ best, error.sum()
        windows = np.lib.stride_tricks.sliding_window_view(laid, WIDTH)[::STRIDE]
        bytes_seen, pull = [], []
        for unit in range(2 * FILTERS):
            f, w = unit % FILTERS, winner[:, unit]
            slope = self.weights[unit] * (1 if unit < FILTERS else -1)
            steps = np.repeat(start[w], size[w]) + runs(size[w])
            g = np.repeat(error * slope / (size[w] + SHRINK), size[w]) * (out[steps, f] > 0)
            live = np.flatnonzero(g)
            seen = windows[steps[live]]
            x = self.vectors[seen].reshape(len(live), WIDTH * DIM)
            grads[1][:, f] += g[live] @ x
            grads[2][f] += g[live].sum()
            some = slice(unit % 8, None, 8)  # an eighth of the steps tells enough about the byte vectors
            bytes_seen.append(seen[some].ravel())
            pull.append((8 * g[live][some, None] * self.filters[:, f]).reshape(-1, DIM))
        seen, pulls = np.concatenate(bytes_seen), np.concatenate(pull)
        for d in range(DIM):
            grads[0][:, d] = np.bincount(seen, pulls[:, d], 256)
        return grads


def _kind(b: int) -> int:
    """Starting vectors tell letters, digits, blanks and marks apart."""
    c = chr(b)
    return 7 if b >= 128 else 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c == " " else 4 if c in "\n\r\t" else 5 if c in ".,;:'?-" else 6


def train(sample: pa.Table, share: float) -> ByteNetwork:
    """Adam on logistic loss; a sample without one of the classes gives the share of label 1 for every text."""
    network = ByteNetwork()
    label = sample.column("label").to_numpy().astype(np.float32)
    share = min(max(share, 1e-3), 1 - 1e-3)
    if not len(label) or label.min() == label.max():
        network.weights[:], network.bias[:] = 0, np.log(share / (1 - share))
        return network
    data, offsets = text_bytes(sample.column("text").combine_chunks())
    rng = np.random.default_rng(SEED)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in network.parameters()]
    t = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(label))
        rate = RATE * (1 - epoch / EPOCHS)
        for b in range(0, len(order), BATCH):
            own = order[b : b + BATCH]
            parts = [data[offsets[i] : offsets[i + 1]] for i in own]
            at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            t += 1
            for p, g, m in zip(network.parameters(), network.gradients(np.concatenate(parts), at, label[own]), moments, strict=True):
                m[0] = 0.9 * m[0] + 0.1 * g
                m[1] = 0.99 * m[1] + 0.01 * g * g
                p -= rate * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.99**t)) + 1e-8)
    seen = label.mean()
    network.bias += np.float32(np.log(share / (1 - share)) - np.log(seen / (1 - seen)))  # classes are drawn evenly, texts are not
    return network


def scores_of(network: ByteNetwork, column: pa.Array) -> np.ndarray:
    """Probability of label 1 of every whole text, from its bytes alone; an empty text is a text of padding."""
    scores = np.zeros(len(column))
    for i, j, data, offsets in batches(column):
        scores[i:j] = 1 / (1 + np.exp(-np.clip(network.logits(data, offsets), -30, 30)))
    return scores


def score(docs: DataFrame, network: ByteNetwork) -> DataFrame:
    """doc_id and score of every text."""

    def job(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            yield pa.record_batch([batch.column("doc_id"), pa.array(scores_of(network, batch.column("text")))], names=["doc_id", "score"])

    return texts(docs).mapInArrow(job, "doc_id bigint, score double")


def without_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is 0.5 or more; the texts are read in place, nothing is shuffled."""
    network = train(*learning_rows(docs, labels, "quality", PER_CLASS, LONGEST))

    @F.arrow_udf("double")
    def scored(column: pa.Array) -> pa.Array:
        return pa.array(scores_of(network, column))

    return in_small_batches(docs).filter(scored(F.coalesce(docs["text"], F.lit(""))) >= 0.5)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (probability of quality 1), predicted.

    Labels are (doc_id, quality); null or other labels are left out, repeated ones count once.  Empty tables give empty results,
    no labels a constant score.
    """
    sample, share = learning_rows(docs, labels, "quality", PER_CLASS, LONGEST)
    scored = score(docs, train(sample, share))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
