"""Near duplicates by SimHash fingerprints, found by covering locality-sensitive hashing.

Every bit of a fingerprint gets a nonzero vector of ``radius`` + 1 bits, and every nonzero vector v of that many bits makes a mask: the fingerprint bits whose vector
has an odd product with v.  The vectors of up to ``radius`` bits leave some v at right angles to all of them, so two fingerprints
that differ in no more bits agree under that mask: no pair is missed.  Vectors are dealt evenly, so a mask keeps four bits in seven.

Equal fingerprints are one node.  Nodes that agree under a mask share a bucket.  Buckets of few nodes compare them in full.  In a larger one every
node names itself and all fingerprints that it turns into by flipping one bit that the mask leaves free: two nodes at most two bits apart
name one fingerprint in common, no other two do, and no fingerprint is named more than 65 times.  So the work on a bucket grows in proportion to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from sitewise.llm.bytetext import text_bytes
from sitewise.llm.common import counted, keyed_join, texts
from sitewise.llm.near import components
from sitewise.session import durable

WORDS, RADIUS, SEED = 3, 2, 42
#: Nodes of a bucket that are compared in full at most; bytes of a text handled at a time.
SMALL, PIECE = 64, 1 << 20


def signed(x: int) -> int:
    """A number of 64 bits as Spark holds it."""
    return x - (1 << 64) if x >> 63 else x


def masks(radius: int = RADIUS) -> list[int]:
    """Covering masks: two numbers of 64 bits that differ in at most ``radius`` of them agree under one."""
    vectors = (1 << (radius + 1)) - 1
    return [sum(1 << bit for bit in range(64) if ((1 + bit % vectors) & v).bit_count() % 2) for v in range(1, vectors + 1)]


def fingerprint(raw: bytes, k: int = WORDS) -> int:
    """A bit is set if it is in more than half of the hashes of all runs of ``k`` words; a text of fewer words is one run, without words it has 0."""
    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    ones, total, carried, begin = np.zeros(64, np.int64), 0, [], 0
    while begin < len(raw):
        end = begin + PIECE
        while end < len(raw) and raw[end] not in b" \t\n\v\f\r":
            end += 1
        words = carried + raw[begin:end].lower().split()
        begin, carried = end, words[max(len(words) - k + 1, 0) :]
        if len(words) < k:
            continue
        hashes = np.fromiter(map(digest, map(b" ".join, zip(*(words[j:] for j in range(k)), strict=False))), np.uint64, len(words) - k + 1)
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        total += len(hashes)
    if not total:
        return digest(b" ".join(carried)) if carried else 0
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def _fingerprints(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        data, offsets = text_bytes(batch.column("text"))
        found = [signed(fingerprint(data[a:b].tobytes())) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.record_batch([batch.column("doc_id"), pa.array(found, pa.int64())], names=["doc_id", "fingerprint"])


def within(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= RADIUS


def linked(nodes: DataFrame) -> DataFrame:
    """Written links (a, b) between the distinct numbers in ``fingerprint`` that join all pairs at most ``RADIUS`` = 2 bits apart."""
    tables = F.array(*[F.struct(F.lit(t).alias("table"), F.col("fingerprint").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(masks())])
    keyed = nodes.select("fingerprint", F.explode(tables).alias("at")).select("at.*", "fingerprint")
    members = durable(keyed_join(keyed, counted(keyed, ["table", "key"], "simhash-buckets"), ["table", "key"], "n"), "simhash-members")

    full = members.filter(F.col("n") <= SMALL).groupBy("table", "key").agg(F.collect_list("fingerprint").alias("all"))  # ``SMALL`` at most
    pairs = full.select(F.explode("all").alias("a"), "all").select("a", F.explode(F.filter("all", lambda b: b > F.col("a"))).alias("b")).filter(within("a", "b"))

    bits = F.array(*[F.lit(signed(1 << j)) for j in range(64)])
    free = F.element_at(F.array(*[F.lit(signed((1 << 64) - 1 - m)) for m in masks()]), F.col("table") + 1)
    flips = F.filter(bits, lambda bit: bit.bitwiseAND(F.col("free")) != 0)
    # a node in several large buckets names each number once
    wide = members.filter(F.col("n") > SMALL).groupBy("fingerprint").agg(F.bit_or(free).alias("free"))
    named = wide.select("fingerprint", F.explode(F.concat(F.array(F.lit(0).cast("bigint")), flips)).alias("flip"))
    meeting = named.groupBy(F.col("fingerprint").bitwiseXOR(F.col("flip")).alias("point")).agg(F.collect_list("fingerprint").alias("all"))  # 65 at most
    # all that name a number are within two bits of each other: the first stands for them
    stars = meeting.select(F.array_min("all").alias("a"), "all").select("a", F.explode(F.filter("all", lambda b: b > F.col("a"))).alias("b"))
    return durable(pairs.unionByName(stars).distinct(), "simhash-links")


def simhash_components(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hexadecimal digits), component_id.

    Words lie between blanks, A-Z lower-cased.  Fingerprints with ``RADIUS`` or fewer differing bits link their documents; ``component_id`` is the smallest id
    that can be reached (null if all are).  Texts without words, null ones too, have fingerprint 0 and link like any other.  Rows that repeat an id are
    rows of their own.  No rows give none.
    """
    rows = durable(texts(docs).mapInArrow(_fingerprints, "doc_id bigint, fingerprint bigint"), "simhash-rows")
    nodes = durable(rows.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least")), "simhash-nodes")
    links = linked(nodes.select("fingerprint"))
    classes = components(links).withColumnRenamed("node", "fingerprint")
    placed = durable(nodes.join(classes.hint("shuffle_hash"), "fingerprint", "left").withColumn("class", F.coalesce("class", "fingerprint")), "simhash-placed")
    heads = placed.groupBy("class").agg(F.count(F.lit(1)).alias("nodes"), F.min("least").alias("component_id"))
    named = durable(keyed_join(placed.select("fingerprint", "n", "class"), durable(heads, "simhash-heads"), ["class"], "nodes").select("fingerprint", "n", "component_id"), "simhash-named")
    joined = keyed_join(rows, named, ["fingerprint"], "n")
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
