"""Least squares for several targets and sets of inputs from one pass over the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F


def least_squares(rows: DataFrame, targets: Sequence[str], inputs: Mapping[str, Sequence[str]]) -> DataFrame:
    """(target, inputs, feature, weight, r2, n): fits of every target on every named set of inputs.

    Inputs are imputed by their mean and scaled by their population deviation, both over the rows where the target is known; of
    solutions to dependent inputs the shortest is taken.  ``weight`` belongs to the scaled input, ``r2`` is that of the rows themselves; a
    target without variance has none.  One aggregate gives the moments of all of them, as many numbers as there are pairs of columns.
    """
    columns = sorted({c for own in inputs.values() for c in own})
    y = {t: F.when(~F.isnan(F.col(t).cast("double")), F.col(t).cast("double")) for t in targets}
    # centred by the means of all rows first, so that squares of large values lose no digits
    about = rows.agg(*[F.avg(F.col(c).cast("double")) for c in columns], *[F.avg(y[t]) for t in targets]).first()
    centre = [v or 0.0 for v in about]
    x = {c: F.col(c).cast("double") - F.lit(centre[i]) for i, c in enumerate(columns)}
    v = {t: y[t] - F.lit(centre[len(columns) + i]) for i, t in enumerate(targets)}
    sums, places = [], {}

    def want(key, column) -> None:
        places[key] = len(sums)
        sums.append(F.sum(column))

    for t in targets:
        known = v[t].isNotNull()
        want((t, "n"), F.when(known, 1.0))
        want((t, "y"), v[t])
        want((t, "yy"), v[t] * v[t])
        for i, a in enumerate(columns):
            there = known & x[a].isNotNull()
            want((t, "n", a), F.when(there, 1.0))
            want((t, "x", a), F.when(there, x[a]))
            want((t, "xy", a), F.when(there, x[a] * v[t]))
            want((t, "y", a), F.when(there, v[t]))
            for b in columns[i:]:
                both = there & x[b].isNotNull()
                want((t, "xx", a, b), F.when(both, x[a] * x[b]))
                want((t, "xa", a, b), F.when(both, x[a]))
                want((t, "xb", a, b), F.when(both, x[b]))
                want((t, "n", a, b), F.when(both, 1.0))
    found = rows.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()
    at = lambda *key: float(found[places[key]] or 0.0)

    out = []
    for t in targets:
        n = at(t, "n")
        if not n:
            continue
        mean = {a: at(t, "x", a) / at(t, "n", a) if at(t, "n", a) else 0.0 for a in columns}
        # an imputed value is the mean, so it adds nothing to sums about the mean
        cross = {}
        for i, a in enumerate(columns):
            for b in columns[i:]:
                cross[a, b] = cross[b, a] = at(t, "xx", a, b) - mean[b] * at(t, "xa", a, b) - mean[a] * at(t, "xb", a, b) + mean[a] * mean[b] * at(t, "n", a, b)
        mean_y = at(t, "y") / n
        total = at(t, "yy") - n * mean_y**2
        with_y = {a: at(t, "xy", a) - mean[a] * at(t, "y", a) - mean_y * (at(t, "x", a) - mean[a] * at(t, "n", a)) for a in columns}
        for name, own in inputs.items():
            scale = np.array([np.sqrt(max(cross[a, a], 0.0) / n) for a in own])
            scale[scale < 1e-12] = 1.0
            gram = np.array([[cross[a, b] for b in own] for a in own]) / np.outer(scale, scale)
            right = np.array([with_y[a] for a in own]) / scale
            weights = np.linalg.lstsq(gram, right, rcond=1e-12)[0]
            r2 = float((2 * weights @ right - weights @ gram @ weights) / total) if total > 1e-18 * n else None
            out += [(t, name, a, float(w), r2, int(n)) for a, w in zip(own, weights, strict=True)]
    return rows.sparkSession.createDataFrame(out, "target string, inputs string, feature string, weight double, r2 double, n bigint")
