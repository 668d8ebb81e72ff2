"""Register of queries and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sitewise.queries.frames import Frames, with_frames

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, frames: str = ""):
    """Register a function of ``Frames``; ``sql`` may use the named frames as tables."""

    def register(job: Callable[[Frames], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return job(Frames(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = job.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_frames(frames.split(), sql)
        return job

    return register
