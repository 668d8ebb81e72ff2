"""Durable intermediate results.

Loops and two-pass operators write what they need twice as parquet below the shared folder
the session names in ``spark.checkpoint.dir``.  Lineage is cut, a lost executor costs
nothing but a re-read, and the planner sees the true size of the written table.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None


def prepare(spark: SparkSession) -> None:
    """Times are read on the UTC clock."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach; a temporary one only for local sessions without a setting."""
    global _local_root
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir().rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder all executors can reach")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="sitewise-")
    return _local_root


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path no other call has used."""
    return f"{shared_folder(spark)}/sitewise/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once and return a frame that reads the written files."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def side_by_side(spark: SparkSession, *jobs: Callable[[], DataFrame]) -> list[DataFrame]:
    """What ``jobs`` return, with their Spark jobs run at once: one's tasks fill the cores that another's few long tasks leave."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
        return [r.result() for r in running]
