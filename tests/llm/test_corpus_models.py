"""Trained operators: held-out accuracy, constant answers without labels, rows of all kinds; the mixer's totals."""

import math

import numpy as np
import pyarrow as pa
import pytest
from corpus import awkward, frame, words
from pyspark.sql import functions as F

from sitewise.llm import mixing, quality, toxicity
from sitewise.llm.bytetext import text_bytes

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.mark.parametrize("job, label, least", [(quality.quality, "quality", 0.97), (toxicity.toxicity, "toxic", 0.95)])
def test_held_out_accuracy(tables, job, label, least):
    docs, labels = tables
    got = job(docs, labels).join(labels, "doc_id").filter("held_out")
    right = got.select(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0]
    kept = got.filter(F.col(label) == (1 if label == "quality" else 0)).select(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0]
    assert right >= least and kept >= 0.98


@pytest.mark.parametrize("job, label", [(quality.quality, "quality"), (toxicity.toxicity, "toxic")])
def test_awkward_rows_and_missing_labels(spark, job, label):
    docs = frame(spark, awkward())
    schema = f"doc_id bigint, {label} int, text string, score double"
    none = job(docs, spark.createDataFrame([], schema)).collect()
    assert len(none) == len(awkward()) and len({r.score for r in none}) == 1
    some = [(i, i % 2, "x", 0.1) for i, _ in awkward() if i] + [(4, None, "x", 0.2), (None, 1, "x", 0.3), (4, 7, "x", 0.1)]
    got = job(docs, spark.createDataFrame(some, schema)).collect()
    assert len(got) == len(awkward()) and all(0 <= r.score <= 1 for r in got)
    assert job(docs.limit(0), spark.createDataFrame(some, schema)).collect() == []
    same = {}
    for r in got:
        same.setdefault(r.doc_id, set()).add((r.score, r.predicted))
    assert len(same[7]) == 1  # equal rows, equal scores


def test_held_out_rows(spark):
    import zlib

    got = spark.range(100).withColumn("h", quality.held_out("id")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in got)


def test_long_texts_are_pooled_whole(monkeypatch):
    network = quality.ByteNetwork()
    text = ("Some words of a text. " * 3000 + "###$$$%%% " * 60 + "and on it goes. " * 3000).encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    whole = network.logits(data, offsets)
    monkeypatch.setattr(quality, "SEGMENT", quality.HALF * quality.STRIDE * 8)
    assert np.allclose(whole, network.logits(data, offsets), atol=1e-4)
    words = toxicity.WordNetwork()
    words.tables[:, :, :] = np.random.default_rng(0).normal(size=words.tables.shape)
    whole = words.logits(data, offsets)
    monkeypatch.setattr(toxicity, "SEGMENT", 20_000)
    assert np.allclose(whole, words.logits(data, offsets), atol=1e-4)


def test_gradients_of_the_byte_network():
    network = quality.ByteNetwork()
    rng = np.random.default_rng(0)
    data, offsets = text_bytes(pa.array(["".join(rng.choice(list("abc DE!#"), 900)) for _ in range(4)]))
    label = np.array([0, 1, 1, 0], np.float32)

    def loss():
        z = network.pooled(data, offsets).astype(np.float64) @ network.weights + network.bias[0]
        return float(np.mean(np.logaddexp(0, z) - label * z))

    grads = network.gradients(data, offsets, label)
    for p, g in list(zip(network.parameters(), grads, strict=True))[1:]:
        at = tuple(rng.integers(0, n) for n in p.shape)
        held, eps = p[at], 1e-2
        p[at] = held + eps
        up = loss()
        p[at] = held - eps
        down = loss()
        p[at] = held
        assert math.isclose((up - down) / (2 * eps), g[at], rel_tol=0.1, abs_tol=2e-3)


TARGETS = {"de": 0.2, "en": 0.4, "es": 0.2, "fr": 0.2}


def share(mixed):
    totals = mixed.agg(*[F.sum(F.col("rate") * F.col("n_tokens") * F.get("p", F.lit(d))) for d in range(len(TARGETS))]).first()
    return np.array(totals) / sum(totals)


def test_expected_totals_meet_the_targets(tables):
    docs, labels = tables
    mixed = mixing.mix(docs, docs.join(labels, "doc_id", "left_semi").selectExpr("doc_id", "lang as domain"), TARGETS).cache()
    assert np.allclose(share(mixed), [0.2, 0.4, 0.2, 0.2], atol=1e-5)
    low, copies, rates, n = mixed.agg(F.min("rate"), F.sum("copies"), F.sum("rate"), F.count("*")).first()
    assert low >= 0 and abs(copies - rates) < 4 * math.sqrt(n) and n == 10_000
    top = mixed.select("doc_id", F.expr("array_position(p, array_max(p)) - 1").alias("d")).join(docs, "doc_id")
    right = top.select(F.avg((F.element_at(F.array(*map(F.lit, sorted(TARGETS))), F.col("d").cast("int") + 1) == F.col("lang")).cast("double"))).first()[0]
    assert right > 0.95
    mixed.unpersist()


def test_rates_that_must_be_clipped(spark):
    rows = [(1, 10, [1.0, 0.0]), (2, 1000, [0.5, 0.5]), (3, 10, [0.0, 1.0]), (4, 0, [0.5, 0.5])]
    soft = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint, p array<double>")
    got = {r.doc_id: r for r in mixing.fit_rates(soft, [0.9, 0.1]).collect()}
    assert all(r.rate >= 0 for r in got.values()) and got[3].rate == 0
    reached = np.array([sum(r.rate * r.n_tokens * r.p[d] for r in got.values()) for d in range(2)])
    # projected gradient on the same problem, many small steps
    t, p, rate = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows]), np.ones(4)
    metric = np.linalg.pinv((p * t[:, None]).T @ p)
    for _ in range(5000):
        rate = np.maximum(0, rate - p @ (metric @ (p.T @ (rate * t) - np.array([0.9, 0.1]) * t.sum())))
    assert np.allclose(reached, p.T @ (rate * t), rtol=1e-4)


def test_steps_go_on_from_written_rates(spark, monkeypatch):
    rng = np.random.default_rng(6)
    score = rng.normal(0, 2, (600, 3)) + np.array([2, 0, 0])
    p = np.exp(score) / np.exp(score).sum(1, keepdims=True)
    soft = spark.createDataFrame([(i, 50 + i, [float(x) for x in q]) for i, q in enumerate(p)], "doc_id bigint, n_tokens bigint, p array<double>")
    whole = {r.doc_id: r.rate for r in mixing.fit_rates(soft, [0.1, 0.3, 0.6]).collect()}
    monkeypatch.setattr(mixing, "KEPT", 1)
    written = {r.doc_id: r.rate for r in mixing.fit_rates(soft, [0.1, 0.3, 0.6]).collect()}
    assert np.allclose([written[i] for i in whole], list(whole.values()), atol=1e-4) and min(whole.values()) == 0
    rows = soft.collect()
    reached = sum(whole[r.doc_id] * r.n_tokens * np.array(r.p) for r in rows) / sum(r.n_tokens for r in rows)
    assert np.abs(reached - [0.1, 0.3, 0.6]).max() <= mixing.TOLERANCE


def test_posteriors_equal_plain_ones(spark):
    rows = [(i, f"{'le chat noir' if i % 2 else 'the black cat'} {words(i, i % 7, 30)}") for i in range(40)] + [(100, None), (101, "Le le the " * 30)]
    docs = frame(spark, rows)
    labelled = spark.createDataFrame([(i, "fr" if i % 2 else "en") for i in range(30)], "doc_id bigint, domain string")
    weights = mixing.fit_domains(docs, labelled, ["en", "fr"])
    spoken = {i: [w for w in (t or "").lower().split() if w] for i, t in rows}
    bucket = {w: (r.b, w) for w, r in ((r.w, r) for r in spark.createDataFrame([(w,) for w in sorted({w for s in spoken.values() for w in s})], "w string")
              .select("w", F.pmod(F.xxhash64("w"), F.lit(mixing.BUCKETS)).alias("b")).collect())}
    counts = np.full((2, mixing.BUCKETS), 0.5)
    for i in range(30):
        for w in spoken[i]:
            counts[i % 2, bucket[w][0]] += 1
    logs, prior = np.log(counts / counts.sum(1, keepdims=True)), np.log([16 / 32, 16 / 32])
    assert np.allclose(weights[:, :-1], logs) and np.allclose(weights[:, -1], prior)
    for r in mixing.posteriors(docs, weights).collect():
        own = spoken[r.doc_id]
        score = prior + sum((logs[:, bucket[w][0]] - logs.mean(0)[bucket[w][0]] for w in own), np.zeros(2)) * min(len(own), mixing.EVIDENCE) / max(len(own), 1)
        want = np.exp(score - score.max())
        assert np.allclose(r.p, want / want.sum()) and r.n_tokens == len(own)


def test_targets_far_from_the_corpus_are_met(spark):
    rng = np.random.default_rng(5)
    for shares, targets in (([0.9, 0.1], [0.1, 0.9]), ([0.97, 0.03], [0.01, 0.99]), ([0.25] * 4, [0.85, 0.05, 0.05, 0.05])):
        score = rng.normal(0, 1, (2000, len(shares)))
        score[np.arange(2000), rng.choice(len(shares), 2000, p=shares)] += 4
        p = np.exp(score) / np.exp(score).sum(1, keepdims=True)
        rows = [(i, int(n), [float(x) for x in q]) for i, (n, q) in enumerate(zip(rng.integers(1, 500, 2000), p, strict=True))]
        soft = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint, p array<double>")
        got = mixing.fit_rates(soft, targets).collect()
        reached = sum(r.rate * r.n_tokens * np.array(r.p) for r in got) / sum(r.n_tokens for r in got)
        assert min(r.rate for r in got) >= 0 and np.abs(reached - targets).max() <= mixing.TOLERANCE


def test_targets_out_of_reach_are_told(spark):
    soft = spark.createDataFrame([(1, 10, [0.5, 0.5]), (2, 30, [0.6, 0.4])], "doc_id bigint, n_tokens bigint, p array<double>")
    with pytest.warns(UserWarning, match="misses a target by 0.3"):
        got = mixing.fit_rates(soft, [0.9, 0.1]).collect()
    assert {r.doc_id: r.rate > 0 for r in got} == {1: False, 2: True}


def test_mixing_awkward_rows(spark):
    docs = frame(spark, awkward())
    labelled = spark.createDataFrame([(4, "en"), (9, "fr"), (1, "de"), (None, "en"), (5, None), (5, "xx")], "doc_id bigint, domain string")
    got = mixing.mix(docs, labelled, TARGETS).collect()
    assert len(got) == len(awkward()) and all(r.rate >= 0 and abs(sum(r.p) - 1) < 1e-9 for r in got)
    assert [r.n_tokens for r in got if r.doc_id in (1, 2, 3)] == [0, 0, 0]
    assert mixing.mix(docs.limit(0), labelled, TARGETS).collect() == []
    assert mixing.mix(docs, labelled.limit(0), TARGETS).count() == len(awkward())
    rated = mixing.with_rates(docs, labelled, TARGETS)
    assert rated.columns == [*docs.columns, "mix_rate", "mix_copies"] and rated.count() == len(awkward())


def test_thresholds_count_every_labelled_row(spark, monkeypatch):
    """More rows than the learning sample holds: the cut is that of all of them, per language, as brute force finds it."""
    monkeypatch.setattr(toxicity, "PER_CLASS", 10)
    rng = np.random.default_rng(4)
    n = 3000
    label, language = rng.integers(0, 2, n), rng.integers(0, 2, n)
    response = np.floor((rng.normal(size=n) + 2.0 * label + 5.0 * language) * 64) / 64  # wider apart than a step
    heard = spark.createDataFrame([(i, float(response[i]), int(language[i])) for i in range(n)], "doc_id bigint, response double, language int")
    usable = spark.createDataFrame([(i, int(label[i])) for i in range(n)], "doc_id bigint, label int")
    got = toxicity._thresholds(heard, usable)
    for k in (0, 1):
        r, y = response[language == k], label[language == k]
        errors = lambda t: int(((r >= t) != y).sum())
        assert errors(got[k]) == min(errors(t) for t in [*np.unique(r), r.max() + 1])
    assert got[2] == got[3] == got[4]
    one_class = usable.withColumn("label", F.lit(1))
    assert not toxicity._thresholds(heard, one_class).any()


def test_rows_beyond_the_sample_move_the_threshold(spark, monkeypatch):
    """All labelled rows that were not learnt from reach the thresholds."""
    monkeypatch.setattr(toxicity, "PER_CLASS", 20)
    seen = []
    monkeypatch.setattr(toxicity, "_thresholds", lambda heard, usable: seen.append(heard.join(usable, "doc_id").count()) or np.zeros(len(toxicity.LANGUAGES)))
    docs = frame(spark, [(i, words(i, 20, 300) + (" vile" if i % 2 else "")) for i in range(400)])
    labels = spark.range(400).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    toxicity.toxicity(docs, labels).count()
    usable = quality.learnable(labels, "toxic").count()
    assert seen == [usable - 30]
