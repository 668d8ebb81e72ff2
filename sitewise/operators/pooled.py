"""Models of one large training set with Spark's own estimators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, functions as F


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    """Feature vector; inputs must be complete."""
    return VectorAssembler(inputCols=list(features), outputCol=out).transform(df)


def fit_pooled_logistic(df: DataFrame, label: str, features: Sequence[str], c: float = 1.0) -> PipelineModel:
    """L2 logistic model of standardised rows; the penalty is spread over the row count."""
    estimator = LogisticRegression(
        labelCol=label, featuresCol="features", regParam=1.0 / (c * df.count()), elasticNetParam=0.0,
        standardization=False, maxIter=100, tol=1e-9,
    )
    return _pipeline(df, features, estimator)


def fit_boosted_trees(
    df: DataFrame, label: str, features: Sequence[str], trees: int = 1000, depth: int = 9, step: float = 0.01,
    rows: float = 0.8, columns: float = 0.7, seed: int = 71017,
) -> PipelineModel:
    """Gradient-boosted trees of complete rows."""
    estimator = GBTClassifier(
        labelCol=label, featuresCol="features", maxIter=trees, maxDepth=depth, stepSize=step,
        subsamplingRate=rows, featureSubsetStrategy=str(columns), seed=seed,
    )
    return _pipeline(df, features, estimator)


def fit_linear(df: DataFrame, label: str, features: Sequence[str]) -> PipelineModel:
    """Ordinary least squares."""
    estimator = LinearRegression(labelCol=label, featuresCol="features", regParam=0.0, standardization=False, solver="normal")
    return _pipeline(df, features, estimator)


def predict(model: PipelineModel, df: DataFrame, out: str = "p") -> DataFrame:
    """Probability of the outcome per row."""
    scored = model.transform(df)
    return scored.withColumn(out, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def coefficients(df: DataFrame, model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """One row per feature with its fitted weight."""
    weights = [float(w) for w in model.stages[-1].coefficients]
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(w).alias("weight")) for f, w in zip(features, weights)])
    return df.limit(1).select(F.inline(rows))


def _pipeline(df: DataFrame, features: Sequence[str], estimator) -> PipelineModel:
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    return PipelineModel(stages=[assembler, estimator.fit(assembler.transform(df))])
