"""Lines that many documents share, found and dropped, for corpora that grow and shrink.

The state is an exact table of how many documents hold each line, and sharded cuckoo filters of the lines that hold in ``min_docs`` or
more.  Adding documents raises counts, taking them away lowers them, and a line that crosses the limit is put into or taken out of its
shard's filter, so that both can be undone.  To clean documents, their lines meet the filter of their shard; what it lets through
is held against the exact table.

A line's key is the line without blanks at either end and with A-Z in lower case; keys travel as 16-byte digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sitewise.llm.common import in_small_batches, keyed_join, named, with_row_key
from sitewise.session import durable

BLANK = " \t\n\v\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(UPPER, LOWER)
#: Lines in one filter when a corpus is first read; lines of one shard that one task probes.
SHARD_KEYS, TASK_LINES = 50_000, 100_000
SLOTS, KICKS = 4, 500


def line_keys(text: Column | str) -> Column:
    return F.transform(F.split(text, "\n"), lambda x: F.translate(F.btrim(x, F.lit(BLANK)), UPPER, LOWER))


def _digest(key: Column) -> Column:
    return F.unhex(F.md5(key))


def document_lines(docs: DataFrame, min_points: int) -> DataFrame:
    """(k1, k2, digest): the distinct keys of each row, of ``min_points`` code points or more."""
    keyed = with_row_key(in_small_batches(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    own = F.array_distinct(F.filter(line_keys("text"), lambda k: F.length(k) >= min_points))
    return keyed.select("k1", "k2", F.explode(own).alias("key")).select("k1", "k2", _digest(F.col("key")).alias("digest"))


class CuckooFilter:
    """16-bit fingerprints in buckets of four; a key has two buckets, either found from the other and the fingerprint."""

    def __init__(self, buckets: int, table: np.ndarray | None = None) -> None:
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table
        self.mask = np.uint32(buckets - 1)

    @classmethod
    def holding(cls, digests: np.ndarray) -> CuckooFilter:
        """Filter of the rows of a (n, 16) array of bytes, as large as they need."""
        buckets = 1 << max(4, int(len(digests) / SLOTS / 0.85).bit_length())
        while True:
            made = cls(buckets)
            if all(made.insert(d) for d in digests):
                return made
            buckets *= 2

    def places(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = np.ascontiguousarray(digests).view("<u4").reshape(len(digests), 4)
        print_ = (words[:, 0] & np.uint32(0xFFFF)).astype(np.uint16)
        print_ = np.maximum(print_, 1)
        first = words[:, 1] & self.mask
        return print_, first, self.other(first, print_)

    def other(self, bucket: np.ndarray, print_: np.ndarray) -> np.ndarray:
        return (bucket ^ (print_.astype(np.uint32) * np.uint32(0x5BD1E995) >> np.uint32(3))) & self.mask

    def contains(self, digests: np.ndarray) -> np.ndarray:
        print_, a, b = self.places(digests)
        return ((self.table[a] == print_[:, None]) | (self.table[b] == print_[:, None])).any(1)

    def insert(self, digest: np.ndarray) -> bool:
        print_, a, b = (x[0] for x in self.places(digest[None]))
        for bucket in (a, b):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = print_
                return True
        bucket = a
        for kick in range(KICKS):
            slot = (kick + int(print_)) % SLOTS
            print_, self.table[bucket, slot] = self.table[bucket, slot], print_
            bucket = self.other(np.array([bucket]), np.array([print_]))[0]
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = print_
                return True
        return False

    def delete(self, digest: np.ndarray) -> bool:
        print_, a, b = (x[0] for x in self.places(digest[None]))
        for bucket in (a, b):
            held = np.flatnonzero(self.table[bucket] == print_)
            if len(held):
                self.table[bucket, held[0]] = 0
                return True
        return False

    def dump(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def load(cls, blob: bytes) -> CuckooFilter:
        table = np.frombuffer(blob, np.uint16).reshape(-1, SLOTS).copy()
        return cls(len(table), table)


def _rows(values) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint8).reshape(-1, 16)


def _revised(key: tuple, held: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
    """A shard's filter after its frequent lines changed; built anew if it has grown too small."""
    keep = keys[keys["now"]]
    if not len(keep):
        return pd.DataFrame({"shard": [], "blob": []})
    blob = None
    if len(held):
        old = CuckooFilter.load(held["blob"].iloc[0])
        gone, come = keys[keys["before"] & ~keys["now"]], keys[~keys["before"] & keys["now"]]
        if all(old.delete(d) for d in _rows(gone["digest"])) and all(old.insert(d) for d in _rows(come["digest"])):
            blob = old.dump()
    if blob is None:
        blob = CuckooFilter.holding(_rows(keep["digest"])).dump()
    return pd.DataFrame({"shard": [key[0]], "blob": [blob]})


@dataclass
class LineIndex:
    """State after some insertions and deletions; each change returns a new one and leaves this as it was.

    ``counts``: (digest, n), n > 0.  ``filters``: (shard, blob), a row for each shard with a frequent line.
    """

    counts: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int
    min_points: int

    @classmethod
    def empty(cls, spark: SparkSession, min_docs: int = 10, min_points: int = 1) -> LineIndex:
        return cls(spark.createDataFrame([], "digest binary, n bigint"), spark.createDataFrame([], "shard int, blob binary"), 0, min_docs, min_points)

    def insert(self, docs: DataFrame) -> LineIndex:
        return self.changed(document_lines(docs, self.min_points), 1)

    def delete(self, docs: DataFrame) -> LineIndex:
        """Takes away documents inserted before."""
        return self.changed(document_lines(docs, self.min_points), -1)

    def changed(self, lines: DataFrame, sign: int) -> LineIndex:
        delta = lines.groupBy("digest").agg((sign * F.count(F.lit(1))).alias("d"))
        if self.shards:
            old = self.counts.select("digest", "n", F.lit(0).cast("bigint").alias("d"))
            delta = delta.select("digest", F.lit(0).cast("bigint").alias("n"), "d")
            merged = old.unionByName(delta).groupBy("digest").agg(F.sum("n").alias("old"), F.sum(F.col("n") + F.col("d")).alias("n"))
        else:
            merged = delta.select("digest", F.lit(0).cast("bigint").alias("old"), F.col("d").alias("n"))
        merged = durable(merged.filter("n > 0 or old > 0"), "line-counts")
        frequent = merged.filter((F.col("n") >= self.min_docs) | (F.col("old") >= self.min_docs))
        wanted = max(1, -(-frequent.count() // SHARD_KEYS))
        fresh = wanted > 2 * self.shards  # also on first reading: lines are dealt to more shards, all filters are built anew
        shards = wanted if fresh else self.shards
        limit = F.lit(self.min_docs)
        keys = frequent.select(
            shard_of("digest", shards).alias("shard"), "digest", (F.col("n") >= limit).alias("now"), (F.lit(not fresh) & (F.col("old") >= limit)).alias("before")
        )
        held = self.filters.limit(0) if fresh else self.filters
        revised = held.groupBy("shard").cogroup(keys.groupBy("shard")).applyInPandas(_revised, "shard int, blob binary")
        return LineIndex(merged.filter("n > 0").select("digest", "n"), durable(revised, "line-filters"), shards, self.min_docs, self.min_points)

    def shared(self, lines: DataFrame) -> DataFrame:
        """Those rows of (k1, k2, digest), a written table, whose line is in ``min_docs`` documents or more."""
        if not self.shards:
            return lines.limit(0)
        sharded = lines.withColumn("shard", shard_of("digest", self.shards))
        # a shard with many lines to probe is read by several tasks, each with the filter: a few numbers per shard
        sizes = durable(sharded.groupBy("shard").agg((F.floor(F.count(F.lit(1)) / TASK_LINES) + 1).cast("int").alias("tasks")), "line-sizes")
        filters = self.filters.join(F.broadcast(sizes), "shard").select(
            "shard", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("deal"), F.lit(0).alias("kind"), "blob",
            *[F.lit(None).cast(t).alias(c) for c, t in lines.dtypes],
        )
        probes = sharded.join(F.broadcast(sizes), "shard").select(
            "shard", F.pmod(F.xxhash64("k1", "k2"), F.col("tasks")).cast("int").alias("deal"), F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("blob"), *lines.columns
        )
        met = filters.unionByName(probes).repartition("shard", "deal").sortWithinPartitions("shard", "deal", "kind")
        passed = durable(met.mapInArrow(_probe, lines.schema), "line-passed")
        exact = self.counts.filter(F.col("n") >= self.min_docs)
        return keyed_join(passed, exact, ["digest"], "n").drop("n")

    def strip(self, docs: DataFrame, lines: DataFrame | None = None) -> DataFrame:
        """``docs`` with all its columns and ``text`` without shared lines, as (row, n_lines, n_dropped), ``row`` a struct.

        ``lines``: written ``document_lines`` of the same rows, if there are any.  Kept lines are joined by a line break; a null or empty
        text has one empty line, whose key is too short to be counted.  An empty table gives an empty one.
        """
        lines = durable(document_lines(docs, self.min_points), "lines") if lines is None else lines
        dropped = self.shared(lines).groupBy("k1", "k2").agg(F.collect_set("digest").alias("drop"))  # of one document each
        others = F.struct(*[named(c) for c in docs.columns if c != "text"])  # the text travels once
        packed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), others.alias("rest"))
        met = with_row_key(packed).join(dropped, ["k1", "k2"], "left").select("rest", "text", "drop")
        schema = T.StructType([T.StructField("rest", packed.schema["rest"].dataType), T.StructField("text", T.StringType()),
                               T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
        row = F.struct(*[F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns])
        return met.mapInArrow(_strip, schema).select(row.alias("row"), "n_lines", "n_dropped")


def shard_of(digest: str, shards: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(shards)).cast("int")


def _probe(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines that the filter before them may hold; a shard without a filter holds none."""
    shard, cuckoo = None, None
    for batch in stream:
        shards, kinds = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
        keep = np.zeros(batch.num_rows, bool)
        cuts = [0, *(np.flatnonzero((np.diff(shards) != 0) | (np.diff(kinds) != 0)) + 1), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if kinds[a] == 0:
                shard, cuckoo = shards[a], CuckooFilter.load(batch.column("blob")[a].as_py())
            elif shards[a] == shard:
                keep[a:b] = cuckoo.contains(_rows(batch.column("digest").slice(a, b - a).to_pylist()))
        yield batch.filter(pa.array(keep)).select(["k1", "k2", "digest"])


def _strip(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        texts, lines, dropped = [], [], []
        for text, drop in zip(batch.column("text"), batch.column("drop"), strict=True):
            text, drop = text.as_py(), drop.as_py()
            gone = 0
            if drop:
                drop, split = set(drop), text.split("\n")
                kept = [x for x in split if hashlib.md5(x.strip(BLANK).translate(_FOLD).encode()).digest() not in drop]
                gone, text = len(split) - len(kept), "\n".join(kept)
                lines.append(len(split))
            else:
                lines.append(text.count("\n") + 1)
            texts.append(text)
            dropped.append(gone)
        yield pa.record_batch([batch.column("rest"), pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())],
                              names=["rest", "text", "n_lines", "n_dropped"])


def drop_shared_lines(docs: DataFrame, min_docs: int = 10, min_points: int = 1) -> DataFrame:
    """Lines found in ``min_docs`` of these documents or more, dropped from them: see ``LineIndex.strip``.  Each row is a document."""
    index = LineIndex.empty(docs.sparkSession, min_docs, min_points)
    lines = durable(document_lines(docs, min_points), "lines")
    return index.changed(lines, 1).strip(docs, lines)
