"""Design matrices: one row per stay, outcomes first."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sitewise.operators.cohort import drop_excluded
from sitewise.operators.features import FeaturePlan, front_columns, window_features
from sitewise.operators.timeseries import fixed_window, random_window
from sitewise.plans.vocabulary import LIMITS, OUTCOMES, STATIC_INPUTS


def day_one_windows(stays: DataFrame, static: DataFrame, key: str, hours: int = 24) -> DataFrame:
    """Window of the first day for the stays kept that last as long."""
    return fixed_window(_kept_limits(stays, static, key), LIMITS, hours)


def random_windows(stays: DataFrame, static: DataFrame, key: str, seed: int | str) -> DataFrame:
    """A reproducible random window end per stay kept."""
    return random_window(_kept_limits(stays, static, key), key, LIMITS, seed)


def design_matrix(
    stays: DataFrame,
    windows: DataFrame,
    hourly: DataFrame,
    static: DataFrame,
    key: str,
    width: int,
    extra: int = 24,
    plan: FeaturePlan = FeaturePlan(),
) -> DataFrame:
    """Window features with site, outcomes and static inputs of the stays kept."""
    kept = with_windows(stays, windows, key)
    features = window_features(hourly, kept, key, width, extra, plan)
    return _assemble(kept, features, static, key)


def severity_matrix(stays: DataFrame, windows: DataFrame, scores: DataFrame, static: DataFrame, key: str, score: str = "apsiii") -> DataFrame:
    """Severity score as the only measured input, NULL where a stay has none."""
    kept = with_windows(stays, windows, key)
    return _assemble(kept, kept.select(key).join(scores.select(key, score), key, "left"), static, key)


def with_windows(stays: DataFrame, windows: DataFrame, key: str) -> DataFrame:
    """Stays with no exclusion flag and a window."""
    return drop_excluded(stays.join(windows.select(key, "windowtime_hours"), key, "left"))


def _kept_limits(stays: DataFrame, static: DataFrame, key: str) -> DataFrame:
    return stays.filter("excluded = 0").select(key).join(static.select(key, *LIMITS), key)


def _assemble(stays: DataFrame, features: DataFrame, static: DataFrame, key: str) -> DataFrame:
    outcome = [c for c in OUTCOMES if c not in ("hospitalid", "hosp_los")]
    joined = (
        stays.select(key, "hospitalid", "hosp_los")
        .join(features, key)
        .join(static.select(key, *outcome, *STATIC_INPUTS), key)
    )
    return front_columns(joined, [key, *OUTCOMES])
