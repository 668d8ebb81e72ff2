"""Rates per document that bring a corpus to target shares of soft domains.

Only DataFrame functions.  A multinomial classifier over hashed words, counted from a labelled table, gives each document a
posterior over domains.  With tokens t, posteriors p and rates r >= 0 the expected total of domain d is sum_i r_i t_i p_id.  Projected gradient steps
on all rates at once, from 1, bring the squared miss of the targets down: a rate moves by -p_i . x and stops at 0, where x is the miss in the metric of the rows
whose rates are positive, damped until the miss falls; with much damping that is the plain gradient.  Each step is one grouping without keys; the driver sees as many numbers as there are pairs of domains and keeps
the x of the steps since rates were last written, from which any task can tell a row's rate.
"""

from __future__ import annotations

import warnings
import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from sitewise.llm.common import bounded_sample, named, texts, with_row_key
from sitewise.session import durable

#: Buckets of hashed words; labelled rows used at most (those of smallest id hash); words that count as independent evidence at most.
BUCKETS, LABELLED, EVIDENCE = 4096, 20_000, 8.0
#: Steps at most, largest miss of a domain as a share of all tokens, least and largest damping of the metric, and steps between two writes of the rates.
STEPS, TOLERANCE, FREE, STIFF, KEPT = 200, 1e-6, 1e-9, 1e5, 8


def words(text: Column | str) -> Column:
    """Words between blanks; an empty text has none."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def buckets(text: Column | str) -> Column:
    return F.transform(words(text), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def constant(values) -> Column:
    """An array literal of numbers."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def fit_domains(docs: DataFrame, labelled: DataFrame, domains: list[str]) -> np.ndarray:
    """Log weight per (domain, bucket), the last column for the prior, from rows (doc_id, domain) and the texts of ``docs``.

    At most ``LABELLED`` rows count; rows with a domain not in the list or without a text are left out.
    """
    chosen = bounded_sample(labelled.filter(F.col("domain").isin(domains)).select("doc_id", "domain"), LABELLED)
    sample = texts(docs).join(F.broadcast(chosen), "doc_id")  # LABELLED rows of an id and a name
    cells = (
        sample.select("domain", F.explode(F.concat(F.array(F.lit(BUCKETS)), buckets("text"))).alias("bucket"))
        .groupBy("domain", "bucket").agg(F.count(F.lit(1)).alias("n"))
    )
    table = np.zeros((len(domains), BUCKETS + 1))
    for domain, bucket, n in cells.collect():  # (domains x buckets) cells at most
        table[domains.index(domain), bucket] = n
    spoken = table[:, :BUCKETS] + 0.5
    rows = table[:, BUCKETS] + 1
    return np.log(np.hstack([spoken / spoken.sum(1, keepdims=True), (rows / rows.sum())[:, None]]))


def posteriors(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, k1, k2, n_tokens, p): tokens of the whole text and its posterior over the domains; the prior for texts without words."""
    counted = with_row_key(texts(docs)).select("doc_id", "k1", "k2", buckets("text").alias("ids")).withColumn("n_tokens", F.size("ids").cast("bigint"))
    scale = F.least(F.col("n_tokens").cast("double"), F.lit(EVIDENCE)) / F.greatest("n_tokens", F.lit(1))
    centre = weights[:, :BUCKETS].mean(0)

    def score(d: int) -> Column:
        table = constant(weights[d, :BUCKETS] - centre)
        return F.aggregate("ids", F.lit(0.0), lambda total, i: total + F.get(table, i)) * scale + F.lit(float(weights[d, -1]))

    scored = counted.select("doc_id", "k1", "k2", "n_tokens", *[score(d).alias(f"s{d}") for d in range(len(weights))])
    names = [f"s{d}" for d in range(len(weights))]
    top = F.greatest(*names) if len(names) > 1 else F.col(names[0])
    raised = scored.select("doc_id", "k1", "k2", "n_tokens", F.array(*[F.exp(F.col(s) - top) for s in names]).alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return raised.withColumn("_t", total).select("doc_id", "k1", "k2", "n_tokens", F.transform("e", lambda x: x / F.col("_t")).alias("p"))


def fit_rates(soft: DataFrame, targets: list[float]) -> DataFrame:
    """Adds ``rate`` to rows (n_tokens, p): nonnegative, with expected totals in the proportion of ``targets``.

    The corpus keeps its size in tokens.  Targets that no rates meet are met as nearly as they can be, and a warning gives the miss.
    """
    k = len(targets)
    p = [F.get("p", F.lit(d)) for d in range(k)]
    t = F.col("n_tokens").cast("double")
    total = float(soft.agg(F.sum(t)).first()[0] or 0.0)
    if not total:
        return soft.withColumn("rate", F.lit(1.0))
    shares = np.asarray(targets, float) / sum(targets)

    def stepped(rows: DataFrame, steps: list[np.ndarray]) -> DataFrame:
        rate = F.col("rate")
        for x in steps:
            rate = F.greatest(F.lit(0.0), rate - sum(p[d] * F.lit(float(x[d])) for d in range(k)))
        return rows.withColumn("rate", rate)

    def at(rows: DataFrame, steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Miss of the targets, and moments of the rows of positive rate, both by all tokens."""
        r = F.col("rate")
        cells = [F.sum(F.when(r > 0, t * p[a] * p[b])) for a in range(k) for b in range(a, k)]
        row = np.array([float(v or 0.0) for v in stepped(rows, steps).agg(*[F.sum(t * r * p[d]) for d in range(k)], *cells).first()]) / total
        moments = np.zeros((k, k))
        moments[np.triu_indices(k)] = row[k:]
        return row[:k] - shares, moments + np.triu(moments, 1).T

    rows, steps = soft.withColumn("rate", F.lit(1.0)), []
    miss, moments = at(rows, steps)
    size, damping = np.trace(moments) / k, FREE
    for _ in range(STEPS):
        if np.abs(miss).max() <= TOLERANCE / 10:
            break
        while damping <= STIFF:
            move = np.linalg.solve(moments + damping * size * np.eye(k), miss)
            tried = at(rows, [*steps, move])
            if np.linalg.norm(tried[0]) <= (1 - 1e-3 / (1 + damping)) * np.linalg.norm(miss):
                break
            damping *= 8
        else:
            break  # no step brings the totals nearer
        steps.append(move)
        miss, moments = tried
        damping = max(FREE, damping / 64)
        if len(steps) == KEPT:
            rows, steps = durable(stepped(rows, steps), "mix-rates"), []
    if np.abs(miss).max() > TOLERANCE:
        warnings.warn(f"mixing misses a target by {np.abs(miss).max():.2g} of all tokens", stacklevel=2)
    return stepped(rows, steps)


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float]) -> DataFrame:
    """One row per row of ``docs``: doc_id, its row key, n_tokens, p (posterior per domain, in name order), rate, copies.

    ``labelled`` has doc_id, domain.  ``copies`` is the rate rounded up or down by a hash of the id, so that its mean is the
    rate.  Every row is returned, also those of rate 0; no rows give no rows; domains without a target do not exist.
    """
    domains = sorted(targets)
    soft = durable(posteriors(docs, fit_domains(docs, labelled, domains)), "mix-soft")
    mixed = fit_rates(soft, [targets[d] for d in domains])
    chance = F.pmod(F.xxhash64("doc_id", F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    whole = F.floor("rate")
    return mixed.withColumn("copies", (whole + (chance < F.col("rate") - whole).cast("bigint")).cast("bigint"))


def with_rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float]) -> DataFrame:
    """All rows and columns of ``docs`` with mix_rate and mix_copies (which replace columns of those names)."""
    rates = mix(docs, labelled, targets).select("k1", "k2", "rate", "copies").dropDuplicates(["k1", "k2"])  # equal for equal keys
    own = [c for c in docs.columns if c.lower() not in ("mix_rate", "mix_copies")]
    packed = docs.select(F.struct(*map(named, own)).alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    joined = with_row_key(packed).select("k1", "k2", "row").join(rates, ["k1", "k2"])
    return joined.select("row.*", F.col("rate").alias("mix_rate"), F.col("copies").alias("mix_copies"))
