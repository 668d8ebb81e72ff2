"""Reading and writing tables and models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sitewise.session import fresh_path


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One table of a folder of parquet tables."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def query_tables(spark: SparkSession, root: str, text: str, names: Sequence[str]) -> DataFrame:
    """SQL over tables of a folder; ``{name}`` in the text stands for a table."""
    return spark.sql(text, **{n: read_table(spark, root, n) for n in names})


def write_matrix(df: DataFrame, path: str | None = None) -> str:
    """Compressed CSV with a header; returns the folder written."""
    path = path or fresh_path(df.sparkSession, "matrix")
    df.write.option("header", True).option("compression", "gzip").csv(path)
    return path


def read_matrix(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Compressed CSV with a header and a known schema; empty fields are missing values."""
    return spark.read.schema(schema).option("header", True).csv(path)


def write_cv_summary(scores: DataFrame, path: str | None = None, by: str = "model") -> str:
    """Mean of ``auc`` and ``smr`` over folds per model, as CSV."""
    path = path or fresh_path(scores.sparkSession, "cv-summary")
    scores.groupBy(by).agg(F.avg("auc").alias("auc"), F.avg("smr").alias("smr")).write.option("header", True).csv(path)
    return path


def materialize(df: DataFrame, path: str | None = None) -> DataFrame:
    """Replace the table at ``path`` and return it as read back."""
    spark = df.sparkSession
    path = path or fresh_path(spark, "table")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def save_model(model: PipelineModel, spark: SparkSession, path: str | None = None) -> str:
    path = path or fresh_path(spark, "model")
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
