"""Logistic models for one, many or very many training sets at once.

A training set is a value of the ``model`` column: a site, a fold, a left-out site, a
replicate.  Rows of all sets are read by the same tasks; each task reduces its rows to
gradient and curvature sums per model, and only those sums are shuffled.  So a model with a
third of all rows costs no task more than its share, and nothing but sums is ever grouped.
Each Newton step is one Spark job over the members and one small job over the models.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sitewise.operators.joins import group_join
from sitewise.operators.prep import moments, standardized, with_moments
from sitewise.session import durable, shuffle_partitions

FLUSH_VALUES = 8_000_000
WIDE = 256

# the task functions below travel with the job: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def fit_logistic(
    members: DataFrame,
    model: str,
    label: str,
    features: Sequence[str],
    c: Column | float = 1.0,
    max_iter: int = 100,
    tol: float = 1e-5,
    warm: DataFrame | None = None,
) -> DataFrame:
    """Model table (model, n_rows, n_pos, mean, scale, intercept, coef, converged), one row per training set.

    Minimises sum(logloss) + |w|^2 / (2 c) on mean-imputed, standardised features; the
    intercept is not penalised.  ``c`` may be an expression of the model column.  Sets with a
    single class keep NULL coefficients; a missing model value is a set like any other.  A fit ends with the first step below ``tol``; Newton
    steps shrink quadratically, so the error left is of the order of its square.  ``warm`` is a
    one-row model table to start from; near solutions save passes over the members.  A set that is
    still moving after ``max_iter`` steps is returned as it is, with ``converged`` false.
    """
    k = len(features)
    penalty = F.lit(c) if isinstance(c, (int, float)) else c
    usable = (F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n_rows"))
    zero = F.array_repeat(F.lit(0.0), k + 1)
    if warm is not None:
        zero = F.coalesce(warm.select(F.concat(F.array("intercept"), "coef")).scalar(), zero)
    start = F.when(usable, zero)
    state = durable(
        moments(members, [model], features, F.sum(F.col(label).cast("bigint")).alias("n_pos"))
        .withColumn("penalty", (1.0 / penalty).cast("double"))
        .withColumn("beta", start)
        .withColumn("held", start)
        .withColumn("held_loss", F.lit(float("inf")))
        .withColumn("done", ~usable),
        "models",
    )
    columns = state.columns
    solver = _solver(state.schema, tol)
    slim = members.select(model, F.col(label).cast("double").alias("_y"), *[F.col(f).cast("double").alias(f) for f in features])
    for _ in range(max_iter):
        active = state.filter(~F.col("done"))
        if active.isEmpty():
            break
        sums = newton_sums(slim, active, model, features)
        same = active[model].eqNullSafe(sums["_of"])
        stepped = active.join(sums, same).drop("_of").mapInPandas(solver, state.schema)
        settled = state.filter("done")
        state = durable(settled.unionByName(stepped.select(*columns)), "models")
    return state.select(
        model,
        "n_rows",
        "n_pos",
        "mean",
        "scale",
        F.get("beta", F.lit(0)).alias("intercept"),
        F.when(F.col("beta").isNotNull(), F.slice("beta", 2, max(k, 1))).alias("coef"),
        F.col("done").alias("converged"),
    )


def newton_sums(members: DataFrame, state: DataFrame, model: str, features: Sequence[str]) -> DataFrame:
    """Loss, gradient and curvature sums (_of, sums) of each model at the current coefficients."""
    k = len(features)
    joined = group_join(members, state.select(model, "mean", "scale", "beta"), [model], spread=[*features, "_y"])
    z = F.array(*[standardized(f, i) for i, f in enumerate(features)])
    rows = joined.select(model, "_y", "beta", z.alias("_z"))
    rows = rows.select(model, "_y", _linear("_z", F.get("beta", F.lit(0)), "beta", 1, k).alias("_eta"), "_z")
    schema = T.StructType([members.schema[model], T.StructField("part", T.ArrayType(T.DoubleType()))])
    parts = rows.mapInArrow(_partial_sums(k, model), schema)
    added = (
        parts.select(model, F.posexplode("part").alias("pos", "value"))
        .groupBy(model, "pos")
        .agg(F.sum("value").alias("value"))
    )
    in_order = F.array_sort(F.collect_list(F.struct("pos", "value")))
    return added.groupBy(F.col(model).alias("_of")).agg(F.transform(in_order, lambda s: s["value"]).alias("sums"))


def _linear(z: str, intercept: Column, weights: str, shift: int, k: int) -> Column:
    total = intercept
    for i in range(k):
        total = total + F.get(z, F.lit(i)) * F.get(weights, F.lit(i + shift))
    return total


def _partial_sums(k: int, model: str):
    """Per task: [loss, gradient, upper triangle of the curvature] summed per model."""
    upper = np.triu_indices(k + 1)
    length = 1 + (k + 1) + len(upper[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        kind = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            kind = batch.schema.field(model).type
            keys = batch.column(0).dictionary_encode(null_encoding="encode")
            codes = keys.indices.to_numpy(zero_copy_only=False)
            names = keys.dictionary.to_pylist()
            y = batch.column(1).to_numpy(zero_copy_only=False)
            eta = batch.column(2).to_numpy(zero_copy_only=False)
            z = np.ones((batch.num_rows, k + 1))
            z[:, 1:] = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            prob = 1.0 / (1.0 + np.exp(-eta))
            loss = np.logaddexp(0.0, eta) - y * eta
            order = np.argsort(codes, kind="stable")
            cuts = np.searchsorted(codes[order], np.arange(len(names) + 1))
            if length <= WIDE:
                terms = np.empty((len(y), length))
                terms[:, 0] = loss
                terms[:, 1 : k + 2] = z * (prob - y)[:, None]
                terms[:, k + 2 :] = z[:, upper[0]] * z[:, upper[1]] * (prob * (1.0 - prob))[:, None]
                sums = np.add.reduceat(terms[order], cuts[:-1], axis=0)
            else:
                sums = [_curvature(z[r], prob[r], y[r], loss[r], upper) for r in np.split(order, cuts[1:-1])]
            for name, vector in zip(names, sums):
                held[name] = held[name] + vector if name in held else vector
            if len(held) * length > FLUSH_VALUES:
                yield _sums_batch(held, kind, model)
                held = {}
        if held:
            yield _sums_batch(held, kind, model)

    return run


def _curvature(z, prob, y, loss, upper) -> np.ndarray:
    """Sums of one model's rows; a matrix product beats per-row terms for many features."""
    curve = (z * (prob * (1.0 - prob))[:, None]).T @ z
    return np.concatenate(([loss.sum()], z.T @ (prob - y), curve[upper]))


def _sums_batch(held: dict, kind: pa.DataType, model: str) -> pa.RecordBatch:
    names = pa.array(list(held), type=kind)
    flat = np.concatenate(list(held.values()))
    ends = np.arange(len(held) + 1, dtype=np.int32) * (len(flat) // len(held))
    values = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
    return pa.RecordBatch.from_arrays([names, values], names=[model, "part"])


def _solver(schema: T.StructType, tol: float):
    """One damped Newton step per row of (state, sums); a step that raised the loss is halved."""
    out = [f.name for f in schema.fields]

    def run(frames):
        for frame in frames:
            if len(frame) == 0:
                yield frame[out]
                continue
            results = [_newton_step(*row) for row in zip(frame["beta"], frame["held"], frame["held_loss"], frame["penalty"], frame["sums"])]
            frame = frame.assign(
                beta=[r[0] for r in results],
                held=[r[1] for r in results],
                held_loss=[r[2] for r in results],
                done=[r[3] for r in results],
            )
            yield frame[out]

    def _newton_step(beta, held, held_loss, penalty, sums):
        beta, held, sums = np.asarray(beta), np.asarray(held), np.asarray(sums)
        width = len(beta)
        weights = beta.copy()
        weights[0] = 0.0
        loss = sums[0] + 0.5 * penalty * weights @ weights
        if not loss <= held_loss * (1 + 1e-12) + 1e-12:
            shorter = (beta + held) / 2.0
            return shorter, held, held_loss, bool(np.max(np.abs(shorter - held)) < tol)
        gradient = sums[1 : 1 + width] + penalty * weights
        curve = np.zeros((width, width))
        curve[np.triu_indices(width)] = sums[1 + width :]
        curve = curve + np.triu(curve, 1).T
        curve[np.arange(1, width), np.arange(1, width)] += penalty
        step = np.linalg.lstsq(curve, gradient, rcond=None)[0]
        return beta - step, beta, float(loss), bool(np.max(np.abs(step)) < tol)

    return run


def score(rows: DataFrame, models: DataFrame, on: str, features: Sequence[str], out: str = "p") -> DataFrame:
    """Probability of each row under the model of its key; NULL where the model has no coefficients."""
    table = models.select(on, "mean", "scale", "intercept", "coef")
    joined = group_join(rows, table, [on], spread=features, how="left")
    return _with_probability(joined, features, out)


def score_one(rows: DataFrame, models: DataFrame, features: Sequence[str], out: str = "p") -> DataFrame:
    """Probability under the single model of a one-row model table."""
    packed = models.select(F.struct("mean", "scale", "intercept", "coef").alias("m")).scalar()
    joined = rows.withColumn("_m", packed).withColumns({c: F.col(f"_m.{c}") for c in ("mean", "scale", "intercept", "coef")})
    return _with_probability(joined.drop("_m"), features, out)


def score_rescaled(rows: DataFrame, models: DataFrame, by: Sequence[str], features: Sequence[str], keep_imputer: bool, out: str = "p") -> DataFrame:
    """Probability under a one-row model table with the scaler refitted per target group.

    ``keep_imputer`` fills missing values with the training means before the refit; otherwise
    the group's own means are used and a feature a group never measured contributes nothing.
    """
    if keep_imputer:
        trained = models.select(F.struct("mean").alias("m")).scalar()
        rows = rows.withColumn("_t", trained).withColumns(
            {f: F.coalesce(F.col(f).cast("double"), F.get(F.col("_t.mean"), F.lit(i))) for i, f in enumerate(features)}
        ).drop("_t")
    joined = with_moments(rows, moments(rows, by, features), by, features)
    packed = models.select(F.struct("intercept", "coef").alias("m")).scalar()
    joined = joined.withColumn("_m", packed).withColumns({c: F.col(f"_m.{c}") for c in ("intercept", "coef")})
    return _with_probability(joined.drop("_m"), features, out)


def _with_probability(joined: DataFrame, features: Sequence[str], out: str) -> DataFrame:
    total = F.col("intercept")
    for i, f in enumerate(features):
        total = total + F.get("coef", F.lit(i)) * standardized(f, i)
    return joined.withColumn(out, 1.0 / (1.0 + F.exp(-total))).drop("mean", "scale", "intercept", "coef")


def score_pairs(rows: DataFrame, pairs: DataFrame, models: DataFrame, features: Sequence[str], train: str = "train_site", test: str = "test_site") -> DataFrame:
    """Rows of each test site under each model its pairs name: (train, test, y.., p).

    ``pairs`` lists the wanted (train, test) combinations.  Both joins are equi-joins; the
    scored rows go straight into the partial aggregate of the metrics.
    """
    table = models.select(F.col(models.columns[0]).alias(train), "mean", "scale", "intercept", "coef")
    # every row is scored under many models: spread the narrow rows before they multiply
    spread = rows.repartition(shuffle_partitions(rows.sparkSession), test, *features)
    # pairs are often exploded: written first, so that their size is known and not estimated
    paired = group_join(spread, durable(pairs.select(train, test), "pairs"), [test], spread=features)
    return _with_probability(group_join(paired, table, [train], spread=features), features, "p")
