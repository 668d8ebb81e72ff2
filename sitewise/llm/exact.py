"""Exact duplicates by progressive refinement: length, hash of a prefix, hash of the whole text.

Only DataFrame functions.  Lengths and prefix hashes are a small table of two numbers per row.  Rows whose (length, prefix hash) is
theirs alone are done; only the rest have their whole text hashed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sitewise.llm.common import counted, keyed_join, keyed_join_once, texts
from sitewise.session import durable

#: Deleted before texts are compared.
SPACE = " \t\n\v\f\r"


def normalised(text: Column | str) -> Column:
    return F.translate(text, SPACE, "")


def exact_groups(docs: DataFrame, prefix: int = 64, digests: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept; with ``digests`` the hash of every normalised text.

    Of equal texts the row with the most code points stays, then the smallest doc_id (null ids last); of rows that also repeat
    the id, one.  A null text is an empty one, and empty texts equal each other.  An empty table gives an empty result.
    """
    body = normalised("text")
    rows = texts(docs).select(
        "doc_id", F.length("text").alias("points"), F.length(body).alias("len"), F.xxhash64(F.substring(body, 1, prefix)).alias("head"), body.alias("body")
    )
    sketch = durable(rows.select("doc_id", "len", "head"), "exact-sketch")
    lengths = counted(sketch, ["len"], "exact-lengths")
    alike = keyed_join(sketch, lengths, ["len"], "n")
    heads = counted(alike.select("len", "head"), ["len", "head"], "exact-heads")

    whole = F.unhex(F.sha2("body", 256))
    found = keyed_join_once(rows, heads, ["len", "head"], "n", F.col("doc_id"))
    hashed = durable(
        found.select("doc_id", "points", F.when(F.col("n").isNotNull(), whole).alias("whole"), *([whole.alias("digest")] if digests else []),
                     F.monotonically_increasing_id().alias("row")),
        "exact-hashed",
    )
    best = F.max(F.struct("points", (-F.col("doc_id")).alias("first"), (-F.col("row")).alias("row")))
    groups = (
        hashed.filter("whole is not null").groupBy("whole").agg(F.count(F.lit(1)).alias("n"), best.alias("best"))
        .filter("n > 1").select("whole", "n", (-F.col("best.first")).alias("keep_id"), (-F.col("best.row")).alias("keep_row"))
    )
    # a null hash stands for a text known to be alone: most of a corpus, which needs no join
    joined = keyed_join(hashed.filter("whole is not null"), durable(groups, "exact-groups"), ["whole"], "n", how="left")
    alone = hashed.filter("whole is null").select("*", *[F.lit(None).cast("bigint").alias(c) for c in ("n", "keep_id", "keep_row")])
    joined = joined.unionByName(alone)
    grouped = F.col("n").isNotNull()
    return joined.select(
        "doc_id",
        F.when(grouped, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
        F.coalesce(F.col("keep_row") == F.col("row"), F.lit(True)).alias("kept"),
        *([F.lower(F.hex("digest")).alias("text_sha256")] if digests else []),
    )
