"""Column expressions; all of them stay inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

DAYS_PER_YEAR = 365.242


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r6(c: Column | str) -> Column:
    """Six digits: sums of doubles depend on their order, comparable results do not."""
    return F.round(col(c), 6)


def parse_number(c: Column | str, as_type: str = "int", strip: str = ">") -> Column:
    """Text to number: ``strip`` is removed, the empty text and junk become NULL."""
    text = F.trim(F.replace(col(c), F.lit(strip), F.lit("")))
    return F.nullif(text, F.lit("")).try_cast(as_type)


def safe_ratio(numerator: Column | str, denominator: Column | str) -> Column:
    return F.try_divide(col(numerator), col(denominator))


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone (session zone UTC)."""
    return F.unix_micros(col(ts).cast("timestamp"))


def hours_between(later: Column | str, earlier: Column | str) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(3600e6)


def days_between(later: Column | str, earlier: Column | str) -> Column:
    return hours_between(later, earlier) / F.lit(24.0)


def age_years(on: Column | str, born: Column | str) -> Column:
    """Years between two dates, four digits."""
    return F.round(F.datediff(col(on), col(born)) / F.lit(DAYS_PER_YEAR), 4)


def hour_ceil_59(ts: Column | str) -> Column:
    """Add 59 minutes, cut to the hour: a time 30 seconds past the hour stays on the hour."""
    return F.date_trunc("hour", col(ts) + F.expr("INTERVAL 59 MINUTES"))


def ceil_div(value: Column | str, unit: int) -> Column:
    """Exact ceiling of an integer column over a positive integer, also below zero."""
    v = col(value).cast("bigint")
    rest = F.pmod(v, F.lit(unit).cast("bigint"))
    # v - rest is a multiple of unit, so the double quotient is exact below 2^53
    return ((v - rest) / F.lit(unit)).cast("bigint") + F.when(rest > 0, 1).otherwise(0).cast("bigint")


def neglog_complement(p: Column | str) -> Column:
    """log(1 / (1 - p)), the input of the recalibration model."""
    return -F.log1p(-col(p))


def hash_uniform(key: Column | str | Sequence[Column | str], seed: int | str | Column) -> Column:
    """Uniform number in [0, 1) that depends on key and seed only, never on row order."""
    keys = [key] if isinstance(key, (Column, str)) else list(key)
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    text = F.concat_ws("|", *[col(k).cast("string") for k in keys], seed.cast("string"))
    head = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double")
    return head / F.lit(4294967296.0)


def any_of(flags: Sequence[Column]) -> Column:
    """True where at least one flag is true; NULL flags count as false."""
    return reduce(lambda a, b: a | b, [F.coalesce(f, F.lit(False)) for f in flags])


def last_match(default: str, rules: Sequence[tuple[Column, str]]) -> Column:
    """Label of the last rule that holds, as successive assignments would leave it."""
    out = F.lit(default)
    for condition, label in rules:
        out = F.when(condition, F.lit(label)).otherwise(out)
    return out


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it is false or NULL."""
    return F.when(condition, 1).otherwise(0)


def metric_bucket(c: Column | str, ranges: Sequence[tuple[str, float, float]], default: str) -> Column:
    """Name of the half-open range that holds the value; outside all ranges the default."""
    v = col(c)
    return last_match(default, [((v >= lo) & (v < hi), name) for name, lo, hi in ranges])
