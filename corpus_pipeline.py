"""Documents from raw to mixed, in five stages; each stage's rows are written and read again by the next.

    spark-submit corpus_pipeline.py <folder of tables> <output folder>

quality      documents that the byte network scores below 0.5 go
line dedup   lines found in ten documents or more go; ``n_chars`` follows the text
near dedup   one document of each class of near duplicates stays, of equal texts without words one too
leaks        documents that contain a benchmark item go
mixing       every document stays, with its rate and number of copies in a corpus of the target shares per language
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sitewise.llm import decontaminate, lines, mixing, near, quality  # noqa: E402
from sitewise.llm.queries import MIX, labelled_domains  # noqa: E402
from sitewise.session import durable  # noqa: E402
from sitewise.sources.tables import read_table  # noqa: E402


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.without_rejected(docs, read_table(spark, sf_dir, "labels"))


def own_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = lines.drop_shared_lines(docs).select("row.*")
    return rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else rows


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.one_of_each(docs, wordless=True)


def unseen_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.with_rates(docs, labelled_domains(docs, read_table(spark, sf_dir, "labels")), MIX)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_documents),
    ("line dedup", own_lines),
    ("minhash near-dedup", distinct_documents),
    ("benchmark decontamination", unseen_documents),
    ("mixing to target weights", mixed_documents),
]
#: The classifiers are trained models, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over the whole ``documents`` table."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}

if __name__ == "__main__":
    run(SparkSession.builder.getOrCreate(), sys.argv[1]).write.parquet(sys.argv[2])
