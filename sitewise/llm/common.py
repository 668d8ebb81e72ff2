"""Helpers shared by the corpus operators.

Every operator reads only the columns it names (``doc_id`` and ``text``, mostly) and returns only its own, so extra columns of any
name cannot clash.  A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sitewise.session import durable

#: Bytes of a batch of rows that a Python worker takes at a time; Spark's own 64 MB cost an executor several times that per task.
BATCH_BYTES = "8m"
#: A key is heavy if it owns more than one of so many rows; there are fewer heavy keys than this.
HEAVY = 1000


def named(column: str) -> Column:
    """A column by its literal name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def in_small_batches(df: DataFrame) -> DataFrame:
    """The same rows; from now on the session hands Python workers ``BATCH_BYTES`` at a time."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with null texts as empty ones."""
    return in_small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def with_row_key(rows: DataFrame) -> DataFrame:
    """Adds (k1, k2), equal for rows of equal id and text only, so that it can be recomputed in any scan.

    Rows that repeat both share a key; whatever is decided about a text holds for each of them.
    """
    return rows.withColumns({"k1": F.coalesce("doc_id", F.lit(-(2**63))), "k2": F.xxhash64("text")})


def keyed_join(rows: DataFrame, keyed: DataFrame, on: Sequence[str], weight: str, how: str = "inner") -> DataFrame:
    """Rows with the columns of ``keyed``, which has one row per key and in ``weight`` the number of rows that have it.

    Keys with more than one of ``HEAVY`` rows, fewer than ``HEAVY`` of them by that count, are told by their hashes, and their rows meet
    a broadcast of as many rows, however large the data; the others have no key large enough to matter and meet by a shuffle.
    Both sides are read once more if there are such keys: pass a written ``keyed``.  ``how`` is inner or left.
    """
    total = keyed.agg(F.sum(weight)).first()[0] or 0
    place = F.xxhash64(*on)
    heavy = [r[0] for r in keyed.filter(F.col(weight) * HEAVY > F.lit(total)).select(place).collect()]
    columns = [*rows.columns, *[c for c in keyed.columns if c not in on]]
    if not heavy:
        return rows.join(keyed, list(on), how).select(*columns)
    hot = place.isin(heavy)
    few = rows.filter(hot).join(F.broadcast(keyed.filter(hot)), list(on), how).select(*columns)
    return few.unionByName(rows.filter(~hot).join(keyed.filter(~hot), list(on), how).select(*columns))


def keyed_join_once(rows: DataFrame, keyed: DataFrame, on: Sequence[str], weight: str, spread: Column) -> DataFrame:
    """The left join of ``keyed_join`` for rows that cost much to make: they are made once.

    All rows pass the broadcast of the heavy keys; those it has matched go through the shuffle of the others dealt by ``spread``.
    """
    total = keyed.agg(F.sum(weight)).first()[0] or 0
    payload = [c for c in keyed.columns if c not in on]
    heavy = F.col(weight) * HEAVY > F.lit(total)
    hot = keyed.filter(heavy).select(*on, F.struct(*payload).alias("_hot"))
    cold = keyed.filter(~heavy).select(*[F.col(c).alias(f"_{c}") for c in on], F.lit(0).alias("_dealt"), F.struct(*payload).alias("_cold"))
    known = F.col("_hot").isNotNull()
    dealt = F.when(known, F.pmod(F.xxhash64(spread), F.lit(HEAVY)).cast("int")).otherwise(0)
    left = rows.join(F.broadcast(hot), list(on), "left").withColumns({f"_{c}": F.when(~known, F.col(c)) for c in on} | {"_dealt": dealt})
    both = left.join(cold, [*(f"_{c}" for c in on), "_dealt"], "left").withColumn("_any", F.coalesce("_hot", "_cold"))
    return both.select(*rows.columns, *[F.col(f"_any.{c}").alias(c) for c in payload])


def counted(df: DataFrame, on: Sequence[str], label: str) -> DataFrame:
    """Written table of the keys that occur more than once, with their number of rows as ``n``."""
    return durable(df.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), label)


def bounded_sample(rows: DataFrame, n: int) -> DataFrame:
    """``n`` rows (all, if there are fewer) of smallest hash of ``doc_id``, of narrow rows.

    Rows with a hash that cannot be among the smallest are left out by each task, so that about ``2 n`` rows meet, however many there are.
    """
    total = rows.count()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    share = min(1.0, (2 * n + 100) / max(total, 1))
    return rows.filter(place <= int(share * (1 << 40))).orderBy(place, *rows.columns).limit(n)
