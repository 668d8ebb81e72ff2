"""Hard negatives by exact integer scores: products of matrices in a residue number system.

Vectors have integer components.  Their residues modulo a few primes below 256 are multiplied as float32 matrices; residues are centred, so sums over
``DEPTH`` columns stay below 2^24 and are exact.  As many primes are taken as the largest possible score needs, and the Chinese
remainder theorem, digit by digit, gives back the signed score.

Anchors meet all rows in places (block of anchors, range of rows), each in a task that keeps the best few per anchor only.  A first pass
finds the positives, the second the best negatives inside each positive's window of scores.  There are about as many ranges as the root of the
number of rows, so neither a range nor the candidates of an anchor grow faster than that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sitewise.llm.common import in_small_batches
from sitewise.session import durable

PRIMES = [p for p in range(251, 2, -1) if all(p % d for d in range(2, 16))]
#: Columns that one float32 product may sum: each adds at most 125^2.
DEPTH = (1 << 24) // 125**2
#: Anchors of a place; rows and anchors scored at a time; places that partitions hold at most one each of.
ANCHORS, ROWS_AT_ONCE, ANCHORS_AT_ONCE, PARTITIONS = 2048, 2048, 256, 8192
#: Scores stay below this, so that windows are computed without overflow.
LARGEST = 1 << 58
NONE = np.iinfo(np.int64).min


def basis(bound: int) -> list[int]:
    """The first primes whose product tells all numbers from ``-bound`` to ``bound`` apart."""
    chosen, product = [], 1
    for p in PRIMES:
        if product > 2 * bound:
            break
        chosen.append(p)
        product *= p
    return chosen


def centred(x: np.ndarray, p: int) -> np.ndarray:
    """Numbers congruent to float32 integers below 2^24, at most (p + 1) / 2 from 0; (p - 1) / 2 if they are below 2^16 already."""
    return x - np.float32(p) * np.rint(x * np.float32(1 / p))


def residues(vectors: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """Centred residues, one float32 matrix per prime, of a float64 matrix of integers."""
    return [centred(np.remainder(vectors, p).astype(np.float32), p) for p in primes]


def products(left: list[np.ndarray], right: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact int64 inner products of all rows of ``left`` with all of ``right``, given as residues."""
    digits: list[np.ndarray] = []
    total, weight = np.zeros((len(left[0]), len(right[0])), np.int64), 1
    for p, a, b in zip(primes, left, right, strict=True):
        rest = np.zeros(total.shape, np.float32)
        for first in range(0, a.shape[1], DEPTH):
            rest = centred(centred(a[:, first : first + DEPTH] @ b[:, first : first + DEPTH].T, p) + rest, p)
        # the digit that makes the number right modulo p, given the digits before it
        known = 1
        for q, digit in zip(primes, digits, strict=False):
            rest -= digit * np.float32((known + p // 2) % p - p // 2)
            known *= q
        inverse = (pow(known, -1, p) + p // 2) % p - p // 2
        digit = centred(centred(centred(rest, p) * np.float32(inverse), p), p)
        digits.append(digit)
        # products may leave 64 bits on the way, the sum does not
        total += digit.astype(np.int64) * np.int64((weight + (1 << 63)) % (1 << 64) - (1 << 63))
        weight *= p
    return total


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest scores of each row with their ids, NONE where there are fewer; of ties the first.  ``scores`` is used up."""
    rows = np.arange(len(scores))
    top, at = np.full((len(scores), k), NONE), np.zeros((len(scores), k), np.int64)
    for j in range(min(k, scores.shape[1])):
        place = scores.argmax(1)
        top[:, j], at[:, j] = scores[rows, place], ids[place]
        scores[rows, place] = NONE
    return top, at


class Best:
    """The best ``k`` (score, id) seen so far for each of ``n`` rows, by score downwards, then id."""

    def __init__(self, n: int, k: int):
        self.scores, self.ids = np.full((n, k), NONE), np.zeros((n, k), np.int64)

    def add(self, rows: slice, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.hstack([self.scores[rows], scores]), np.hstack([self.ids[rows], ids])
        # ascending by complement, which has no overflow
        order = np.lexsort((ids, ~scores))[:, : self.scores.shape[1]]
        self.scores[rows], self.ids[rows] = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors of a list column as rows; missing components are 0."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dims))
    out[np.repeat(np.arange(len(column)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy()
    return out


class _Anchors:
    """The anchors of a place and what is kept for them."""

    def __init__(self, batches: list[pa.RecordBatch], dims: int, primes: list[int], keep: Callable[[int], list[Best]]):
        table = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        self.row, self.label = (table.column(c).to_numpy() for c in ("row", "label"))
        self.positives = table.column("positives").to_pylist()
        self.residues = residues(_matrix(table.column("vec"), dims), primes)
        self.kept = keep(len(self.row))


def _places(stream: Iterator[pa.RecordBatch], dims: int, primes: list[int], keep, look, emit) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by place, anchors (kind 0) first; ``look`` sees every block of scores, ``emit`` gives the rows of a finished place."""
    place, waiting, held = None, [], None
    for batch in stream:
        places, kinds = batch.column("place").to_numpy(), batch.column("kind").to_numpy()
        cuts = np.flatnonzero((np.diff(places) != 0) | (np.diff(kinds) != 0)) + 1
        for first, last in zip([0, *cuts.tolist()], [*cuts.tolist(), len(places)], strict=True):
            if first == last:
                continue
            if places[first] != place:
                if held is not None:
                    yield emit(held)
                place, waiting, held = places[first], [], None
            part = batch.slice(first, last - first)
            if kinds[first] == 0:
                waiting.append(part)
                continue
            if held is None:
                if not waiting:  # no anchor of this block has anything to look for
                    continue
                held, waiting = _Anchors(waiting, dims, primes, keep), []
            ids = part.column("vec_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            vectors = _matrix(part.column("vec"), dims)
            for i in range(0, len(order), ROWS_AT_ONCE):
                own = order[i : i + ROWS_AT_ONCE]
                right = residues(vectors[own], primes)
                row, label = (part.column(c).to_numpy()[own] for c in ("row", "label"))
                for j in range(0, len(held.row), ANCHORS_AT_ONCE):
                    block = slice(j, j + ANCHORS_AT_ONCE)
                    scores = products([r[block] for r in held.residues], right, primes)
                    look(held, block, scores, held.label[block, None] == label, held.row[block, None] == row, ids[own])
    if held is not None:
        yield emit(held)


def _positive_finder(dims: int, primes: list[int], k: int):
    def look(held, block, scores, alike, itself, ids):
        held.kept[0].add(block, *best(np.where(alike & ~itself, scores, NONE), ids, k))

    def emit(held):
        a, j = np.nonzero(held.kept[0].scores != NONE)
        return pa.record_batch([pa.array(held.row[a]), pa.array(held.kept[0].scores[a, j]), pa.array(held.kept[0].ids[a, j])], names=["row", "score", "vec_id"])

    return lambda stream: _places(stream, dims, primes, lambda n: [Best(n, k)], look, emit)


def _negative_finder(dims: int, primes: list[int], positives: int, k: int, low: Fraction, high: Fraction):
    def limits(held, block, j):
        """Least and largest score of the window of each anchor's positive ``j``; none where it is missing."""
        own = [p[j]["score"] if j < len(p) else None for p in held.positives[block]]
        return np.array([(1, 0) if s is None else (-((-s * low.numerator) // low.denominator), s * high.numerator // high.denominator) for s in own], np.int64).reshape(-1, 2)

    def look(held, block, scores, alike, itself, ids):
        other = np.where(alike, NONE, scores)
        for j in range(positives):
            least, most = limits(held, block, j).T
            inside = np.where((other >= least[:, None]) & (other <= most[:, None]), other, NONE)
            some = np.flatnonzero((least <= most) & (inside.max(1, initial=NONE) != NONE))
            if len(some):
                held.kept[j].add(np.arange(block.start, block.start + len(scores))[some], *best(inside[some], ids, k))

    def emit(held):
        found = [(np.full(len(a), j), a, i, kept) for j, kept in enumerate(held.kept) for a, i in [np.nonzero(kept.scores != NONE)]]
        columns = [np.concatenate(x) for x in zip(*[(held.row[a], j, kept.scores[a, i], kept.ids[a, i]) for j, a, i, kept in found], strict=True)]
        return pa.record_batch([pa.array(c.astype(np.int64)) for c in columns], names=["row", "turn", "score", "vec_id"])

    return lambda stream: _places(stream, dims, primes, lambda n: [Best(n, k) for _ in range(positives)], look, emit)


def _met(anchors: DataFrame, rows: DataFrame, blocks: int, ranges: int) -> DataFrame:
    """Every anchor in a place with every row, by places."""
    fixed = ["row", "vec_id", "label", "vec", "positives"]
    part = lambda n, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.select((part(blocks, 1) * ranges).alias("first"), each(ranges).alias("range"), F.lit(0).alias("kind"), *fixed)
    right = rows.select(part(ranges, 2).alias("range"), each(blocks).alias("block"), F.lit(1).alias("kind"), *fixed[:-1], F.lit(None).cast(anchors.schema["positives"].dataType).alias("positives"))
    both = left.select((F.col("first") + F.col("range")).alias("place"), "kind", *fixed).unionByName(right.select((F.col("block") * ranges + F.col("range")).alias("place"), "kind", *fixed))
    n = min(blocks * ranges, PARTITIONS)
    # the work lies in the products, not in the bytes by which Spark would merge partitions
    return both.repartitionById(n, F.pmod("place", F.lit(n)).cast("int")).sortWithinPartitions("place", "kind")


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The best ``k`` of each key's candidates, with their ``rank``."""
    best_first = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, positives: int = 5, negatives: int = 3, low: Fraction = Fraction(1, 2), high: Fraction = Fraction(19, 20)
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for rows (vec_id, label, vec, anchor).

    ``vec`` holds integers as doubles, a shorter vector ends in zeros; a score is the inner product.  An anchor's positives are its best ``positives``
    other rows of the same label; each gets the best ``negatives`` rows of other labels with a score from ``low`` to ``high`` times its own.
    Best is by score downwards, then vec_id.  Rows with a null in any of these columns, or in a vector, or a component that is not finite, take no
    part; rows that repeat an id are rows of their own.  Scores must stay below 2^58, or ValueError.  No rows, or no anchors, give none.
    """
    spark = in_small_batches(rows).sparkSession
    whole = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("anchor").isNotNull() & usable("vec"))
    placed = durable(whole.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"), "vec", "anchor"), "negatives-rows")
    largest = F.array_max(F.transform("vec", lambda x: F.abs(x)))
    n, n_anchors, dims, size = placed.agg(F.count(F.lit(1)), F.count_if("anchor"), F.max(F.size("vec")), F.max(largest)).first()
    out = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not n_anchors or not dims:
        return spark.createDataFrame([], out)
    bound = dims * int(size or 0) ** 2
    if bound >= LARGEST:
        raise ValueError(f"scores up to {bound} do not fit: scale the components down")
    primes = basis(bound)
    ranges, blocks = -(-int(n**0.5) // 4), -(-n_anchors // ANCHORS)
    anchors = placed.filter("anchor").select("row", "vec_id", "label", "vec")
    first = anchors.withColumn("positives", F.expr("cast(null as array<struct<score: bigint, vec_id: bigint>>)"))
    found = _met(first, placed, blocks, ranges).mapInArrow(_positive_finder(dims, primes, positives), "row bigint, score bigint, vec_id bigint")
    chosen = _first(found, ["row"], positives)
    lists = chosen.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "vec_id"))).alias("p"))  # ``positives`` of each anchor
    lists = durable(lists.select("row", F.transform("p", lambda x: F.struct(x["score"].alias("score"), x["vec_id"].alias("vec_id"))).alias("positives")), "negatives-positives")
    # anchors and their lists are equally many: they meet by a shuffle
    second = durable(anchors.join(lists.hint("shuffle_hash"), "row"), "negatives-anchors")
    found = _met(second, placed, blocks, ranges).mapInArrow(_negative_finder(dims, primes, positives, negatives, low, high), "row bigint, turn bigint, score bigint, vec_id bigint")
    taken = _first(found, ["row", "turn"], negatives)
    named = second.select("row", F.col("vec_id").alias("anchor_id"), F.posexplode("positives").alias("turn", "positive"))
    return taken.join(named.withColumn("turn", F.col("turn").cast("bigint")).hint("shuffle_hash"), ["row", "turn"]).select(
        "anchor_id", F.col("positive.vec_id").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"),
        F.col("positive.score").alias("positive_score"), F.col("score").alias("negative_score"),
    )


def usable(vec: str) -> Column:
    """Is a vector there, with finite components only?"""
    return F.col(vec).isNotNull() & F.forall(vec, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))


def quantised(vec: str, scale: int = 256) -> Column:
    """Components times ``scale``, rounded down, as doubles."""
    return F.transform(F.col(vec).cast("array<double>"), lambda x: F.floor(x * scale).cast("double"))
