"""Near duplicates: multisets of five-word shingles with a weighted Jaccard similarity of 0.8 or more, and the classes they form.

Signatures come from BagMinHash.  A shingle that occurs w times owns the stretch [0, w) of its weight axis, cut at 0, 1, 2, 4, 8, ..; each
piece has a Poisson process of points, as dense as the piece is wide, that depends on the shingle and the piece alone.  A point falls on
one of ``SIZE`` registers, and at some height of its piece, which a text takes only up to its own w.  A register keeps the first point it gets, so two texts
agree in a register with the probability of their weighted Jaccard similarity.  Most shingles need one draw: points later than
the last register can be waiting for are never made.

Texts of equal multisets are one node.  Nodes that agree in a band of registers meet in a bucket.  In small buckets all nodes are
compared, in large ones each with a leader, the node that shares most buckets, which copies of one origin have in common.  Nodes that are
then not of their leader's class are compared with all nodes that share their leader, in blocks that many tasks share: an index of a block's
shingles gives the exact overlap of a text with every text of the block.  Very large buckets are cut by a second band as well, whose links leave
fewer such nodes; the whole bucket is compared all the same.  Compared are the exact multisets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sitewise.llm.bytetext import batches, mix64, runs, shingles, word_hashes, word_spans
from sitewise.llm.common import keyed_join, named, texts, with_row_key
from sitewise.session import durable

WORDS, SIMILAR = 5, 0.8
#: Registers per band and bands; a pair of similarity 0.8 shares no band with probability 3e-5.
ROWS, BANDS = 4, 20
SIZE = ROWS * BANDS
#: Buckets up to this size are compared in full; nodes that one task compares with a copy of the leader's text, and that make a block.
SMALL, TASK_NODES = 16, 256
#: Places of a block's index that one text reads at a time.
READ = 1 << 20
#: Nodes of a bucket beyond which it is cut by a second band too.
HUGE = 100_000
_U = np.uint64
_POINT, _PLACE, _HEIGHT, _LEVEL = (_U(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3))


def multisets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text with their counts, and how many distinct ones each text has."""
    starts, lengths, counts = word_spans(data, offsets)
    hashes, made = shingles(word_hashes(data, starts, lengths), counts, WORDS)
    ends = np.cumsum(made)
    for e, m in zip(ends, made, strict=True):
        hashes[e - m : e].sort()
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = hashes[1:] != hashes[:-1]
    fresh[(ends - made)[made > 0]] = True
    at = np.flatnonzero(fresh)
    weights = np.diff(np.append(at, len(hashes)))
    return hashes[at], weights, np.diff(np.searchsorted(at, np.concatenate([[0], ends])))


def signatures(elements: np.ndarray, weights: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(texts, SIZE) registers; all zero for a text without shingles."""
    n = len(sizes)
    owner = np.repeat(np.arange(n), sizes)
    total = np.bincount(owner, weights, n)
    # pieces of the weight axis: 0 is [0, 1), l > 0 is [2^(l-1), 2^l)
    pieces = 1 + np.ceil(np.log2(np.maximum(weights, 1))).astype(np.int64)
    element = np.repeat(np.arange(len(elements)), pieces)
    level = runs(pieces)
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    width = np.maximum(low, 1)
    key = mix64(elements[element] + level.astype(_U) * _LEVEL)
    share = weights[element] - low  # of the piece's width, if not all of it
    text = owner[element]

    first = np.full(n * SIZE, np.inf)
    out = np.zeros(n * SIZE, _U)
    waiting = total > 0
    patience = np.log(SIZE) + 4.6
    while waiting.any():
        limit = np.where(waiting, SIZE / np.maximum(total, 1) * patience, -1.0)
        own = np.flatnonzero(limit[text] > 0)
        time, turn = np.zeros(len(own)), 0
        slots, times, points = [], [], []
        while len(own):
            turn += 1
            point = mix64(key[own] + _U(turn * int(_POINT) & (1 << 64) - 1))
            time = time - np.log(((point >> _U(11)).astype(np.float64) + 0.5) / (1 << 53)) / width[own]
            soon = time <= limit[text[own]]
            own, time, point = own[soon], time[soon], point[soon]
            taken = np.ones(len(own), bool)
            part = np.flatnonzero(share[own] < width[own])
            if len(part):
                taken[part] = mix64(point[part] ^ _HEIGHT) % width[own[part]].astype(_U) < share[own[part]].astype(_U)
            slots.append(text[own[taken]] * SIZE + (mix64(point[taken] ^ _PLACE) % _U(SIZE)).astype(np.int64))
            times.append(time[taken])
            points.append(point[taken])
        slot, when, point = np.concatenate(slots), np.concatenate(times), np.concatenate(points)
        np.minimum.at(first, slot, when)
        won = when == first[slot]
        out[slot[won]] = point[won]
        waiting &= np.isinf(first.reshape(n, SIZE)).any(1)
        patience *= 2
    return out.reshape(n, SIZE)


def _describe(stream: Iterator[pa.RecordBatch], wordless: bool = False) -> Iterator[pa.RecordBatch]:
    """Digest of the multiset (without words null, or with ``wordless`` a longer one of the text), number of shingles and bands of each row."""
    number = (np.arange(BANDS, dtype=_U) + _U(1)) * _LEVEL
    powers = np.cumprod(np.full(ROWS, _POINT, _U))
    for batch in stream:
        nodes, totals, bands = [], [], []
        for i, j, data, offsets in batches(batch.column("text")):
            elements, weights, sizes = multisets(data, offsets)
            begin, some = np.cumsum(sizes) - sizes, sizes > 0
            digest = np.zeros((j - i, 2), _U)
            total = np.zeros(j - i, np.int64)
            if len(elements):
                for k, salt in enumerate((_POINT, _PLACE)):
                    digest[some, k] = np.add.reduceat(mix64(elements ^ salt) * weights.astype(_U), begin[some])
                total[some] = np.add.reduceat(weights, begin[some])
            registers = signatures(elements, weights, sizes).reshape(j - i, BANDS, ROWS)
            joined = mix64((registers * powers).sum(2, dtype=_U) + number)
            silent = [hashlib.blake2b(data[offsets[k] : offsets[k + 1]].tobytes(), digest_size=17).digest() if wordless and not some[k] else None for k in range(j - i)]
            nodes += [d.tobytes() if s else h for d, s, h in zip(digest, some, silent, strict=True)]
            totals.append(total)
            bands.append(joined.view(np.int64).ravel())
        values = pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * BANDS), values)
        yield pa.record_batch(
            [*(batch.column(c) for c in ("doc_id", "k1", "k2")), pa.array(nodes, pa.binary()), pa.array(np.concatenate(totals) if totals else [], pa.int64()), lists],
            names=["doc_id", "k1", "k2", "digest", "total", "bands"],
        )


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets (sorted shingles, counts)."""
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    shared = b[0][at] == a[0]
    least = np.minimum(a[1][shared], b[1][at[shared]]).sum()
    return float(least / (a[1].sum() + b[1].sum() - least))


def _compare(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between each leader's text and the texts that follow it."""
    leader, held = None, None
    for batch in stream:
        a, kinds, b = batch.column("a").to_pylist(), batch.column("kind").to_numpy(), batch.column("b").to_pylist()
        links = []
        for i, j, data, offsets in batches(batch.column("text")):
            elements, weights, sizes = multisets(data, offsets)
            ends = np.cumsum(sizes)
            for r in range(i, j):
                own = slice(ends[r - i] - sizes[r - i], ends[r - i])
                if kinds[r] == 0:
                    leader, held = a[r], (elements[own], weights[own])
                elif a[r] == leader and similarity(held, (elements[own], weights[own])) >= SIMILAR:
                    links.append((a[r], b[r]))
        yield pa.record_batch([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])


def verified(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """Those of the written pairs (a, b) that are similar, of texts (node, text)."""
    degrees = durable(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "near-degrees")
    tasks = (F.floor(F.col("n") / TASK_NODES) + 1).cast("int")
    leaders = held.join(degrees, held.node == degrees.a).select(
        "a", F.explode(F.sequence(F.lit(0), tasks - 1)).alias("deal"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("b"), "text"
    )
    dealt = keyed_join(pairs, degrees, ["a"], "n").select("a", F.pmod(F.xxhash64("b"), tasks).cast("int").alias("deal"), F.lit(1).alias("kind"), "b")
    others = dealt.join(held.withColumnRenamed("node", "b"), "b").select("a", "deal", "kind", "b", "text")
    met = leaders.unionByName(others).repartition("a", "deal").sortWithinPartitions("a", "deal", "kind")
    return met.mapInArrow(_compare, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """(node, class): the smallest node that can be reached over the written links (a, b), which may be empty.

    Each round a node takes the smallest class among its neighbours, then the class of its class; long chains halve.
    """
    edges = durable(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near-edges")
    labels = durable(
        edges.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("least")).select(F.col("a").alias("node"), "n", F.least("a", "least").alias("class")),
        "near-labels",
    )
    while True:
        seen = keyed_join(edges, labels.withColumnRenamed("node", "a"), ["a"], "n")
        nearest = seen.groupBy("b").agg(F.min("class").alias("near")).withColumnRenamed("b", "node")
        taken = labels.join(nearest, "node").select("node", "n", F.least("class", "near").alias("next"), F.col("class").alias("before"))
        taken = durable(taken, "near-labels")
        follow = durable(taken.groupBy("next").agg(F.count(F.lit(1)).alias("users")).join(
            taken.select(F.col("node").alias("next"), F.col("next").alias("jump")), "next"), "near-jumps")
        labels = durable(
            keyed_join(taken, follow, ["next"], "users").select("node", "n", F.least("next", "jump").alias("class"), "before"), "near-labels"
        )
        if labels.filter(F.col("class") != F.col("before")).isEmpty():
            return labels.select("node", "class")
        labels = labels.drop("before")


def _classed(rows: DataFrame, classes: DataFrame | None) -> DataFrame:
    """Rows (.., node, ..) with the class of their node, the node itself where it has no link."""
    if classes is None:
        return rows.withColumn("class", F.col("node"))
    return rows.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))


def near_classes(docs: DataFrame, wordless: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, class_size, kept.

    Classes are the connected components of links between texts, named by their smallest doc_id (null if no member has one); of each class
    the row of that id is kept, of rows that repeat it one.  Words are runs of letters and digits without regard to ASCII case; a text
    of one to four words is one shingle.  Texts without words, null and empty ones too, are classes of their own, or with ``wordless`` equal ones are
    one class (null is empty).  No rows give none.
    """
    keyed = with_row_key(texts(docs))
    rows = durable(
        keyed.select("doc_id", "k1", "k2", "text").mapInArrow(lambda stream: _describe(stream, wordless), "doc_id bigint, k1 bigint, k2 bigint, digest binary, total bigint, bands array<bigint>")
        .withColumn("row", F.monotonically_increasing_id()),
        "near-rows",
    )
    best = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row"))
    nodes = durable(
        rows.filter("digest is not null").groupBy("digest").agg(F.count(F.lit(1)).alias("size"), best.alias("best"), F.min(F.struct("k1", "k2", "total", "bands")).alias("one"))
        .select(F.monotonically_increasing_id().alias("node"), "digest", "size", "best", "one.*"),
        "near-nodes",
    )
    classes = _link(nodes.filter("total > 0"), keyed)

    placed = durable(_classed(nodes.select("node", "digest", "size", "best"), classes), "near-placed")
    of_class = durable(placed.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("class_size"), F.min("best").alias("first")), "near-of-class")
    named = durable(keyed_join(placed.select("node", "digest", "size", "class"), of_class, ["class"], "n").select("digest", "size", "class_size", "first"), "near-named")
    alone = rows.filter("digest is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("bigint").alias("class_size"), F.lit(True).alias("kept"), "k1", "k2")
    joined = keyed_join(rows.filter("digest is not null").select("doc_id", "row", "digest", "k1", "k2"), named, ["digest"], "size")
    return joined.select("doc_id", F.col("first.doc_id").alias("class_id"), "class_size", (F.col("row") == F.col("first.row")).alias("kept"), "k1", "k2").unionByName(alone)


def one_of_each(docs: DataFrame, wordless: bool = False) -> DataFrame:
    """The rows of ``docs``, all columns, that are kept of their class; of rows that repeat id and text one."""
    kept = near_classes(docs, wordless).filter("kept").select("k1", "k2").distinct()
    packed = docs.select(F.struct(*map(named, docs.columns)).alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = with_row_key(packed).select("k1", "k2", "row")
    return keyed.join(kept, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select("row.*")


def _link(nodes: DataFrame, keyed: DataFrame) -> DataFrame | None:
    """(node, class) of linked nodes, from written nodes (node, k1, k2, total, bands) and texts (k1, k2, text)."""
    members = _members(nodes.select("node", F.explode("bands").alias("band")))
    if members.isEmpty():
        return None
    wide = members.filter(F.col("n") > HUGE)
    if not wide.isEmpty():
        further = wide.join(nodes.select("node", "bands"), "node").select("node", "band", F.explode("bands").alias("next")).filter("next != band")
        both = F.xxhash64(F.least("band", "next"), F.greatest("band", "next")).alias("band")
        members = durable(members.unionByName(_members(further.select("node", both).distinct())), "near-members")
    wanted = members.groupBy("node").agg(F.sum("n").alias("met")).join(nodes.select("node", "k1", "k2", "total"), "node")
    wanted = durable(wanted, "near-wanted")
    # rows that repeat id and text are one text; wanted nodes are many, so texts come to them by a shuffle whatever their number
    met_texts = keyed.select("k1", "k2", "text").join(wanted.select("node", "k1", "k2").hint("shuffle_hash"), ["k1", "k2"])
    held = durable(met_texts.dropDuplicates(["node"]).select("node", "text"), "near-texts")

    met = durable(members.join(wanted.select("node", "total", "met"), "node"), "near-met")
    small, large = met.filter(F.col("n") <= SMALL), met.filter(F.col("n") > SMALL)
    left = small.select("band", F.col("node").alias("a"), F.col("total").alias("ta"))
    right = small.select("band", F.col("node").alias("b"), F.col("total").alias("tb"))
    alike = F.least("ta", "tb") >= SIMILAR * F.greatest("ta", "tb")
    among = left.join(right, "band").filter((F.col("a") < F.col("b")) & alike).select("a", "b")
    top = F.max(F.struct("met", "node", "total")).alias("top")
    leaders = large.groupBy("band").agg(F.count(F.lit(1)).alias("m"), top).select("band", "m", F.col("top.node").alias("a"), F.col("top.total").alias("ta"))
    led = keyed_join(large.select("band", F.col("node").alias("b"), F.col("total").alias("tb")), durable(leaders, "near-leaders"), ["band"], "m")
    # buckets of one origin have one leader: their nodes make one group
    groups = durable(led.groupBy("a", "b").agg(F.first("ta").alias("ta"), F.first("tb").alias("tb")), "near-groups")
    stars = groups.filter((F.col("a") != F.col("b")) & alike).select("a", "b")
    links = durable(verified(durable(among.unionByName(stars).distinct(), "near-pairs"), held), "near-links")
    classes = None if links.isEmpty() else durable(components(links), "near-classes")

    found = _among_groups(groups, classes, held)
    if found is None:
        return classes
    links = durable(links.unionByName(found), "near-links")
    return None if links.isEmpty() else durable(components(links), "near-classes")


def _members(banded: DataFrame) -> DataFrame:
    """Written rows (node, band, n) of the buckets with several nodes."""
    sizes = durable(banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "near-buckets")
    return durable(keyed_join(banded, sizes, ["band"], "n"), "near-members")


def _among_groups(groups: DataFrame, classes: DataFrame | None, held: DataFrame) -> DataFrame | None:
    """Links (a, b) that join nodes that are not of their leader's class to others of its group; None if there are no such nodes.

    Blocks of about ``TASK_NODES`` of them meet blocks of the whole group, each pair of blocks in a task of its own, which returns no more
    links than join its nodes.
    """
    known = _classed(groups.select("a", F.col("b").alias("node"), F.col("tb").alias("total")), classes)
    heads = known.filter("a = node").select("a", F.col("class").alias("head")).join(groups.groupBy("a").agg(F.count(F.lit(1)).alias("m")), "a")
    known = keyed_join(known, durable(heads, "near-heads"), ["a"], "m")
    known = durable(known.withColumn("apart", F.col("class") != F.col("head")).drop("head"), "near-known")
    counts = durable(known.groupBy("a").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("apart").cast("bigint")).alias("r")).filter("r > 0"), "near-counts")
    if counts.isEmpty():
        return None
    blocks = lambda n: (F.floor(F.col(n) / TASK_NODES) + 1).cast("int")
    block = lambda n: F.pmod(F.xxhash64("node"), blocks(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    rows = keyed_join(known.drop("m"), counts, ["a"], "rows").join(held, "node")
    rest = ["node", "class", "total", "text"]
    apart = rows.filter("apart").select("a", block("r").alias("own"), every("rows").alias("other"), F.lit(0).alias("kind"), *rest)
    whole = rows.select("a", block("rows").alias("other"), every("r").alias("own"), F.lit(1).alias("kind"), *rest)
    place = ["a", "own", "other"]
    return apart.unionByName(whole).repartition(*place).sortWithinPartitions(*place, "kind").mapInArrow(_join_blocks, "a bigint, b bigint")


class _Block:
    """Multisets (sorted shingles, counts) of some texts as one index of their shingles."""

    def __init__(self, multisets: list[tuple[np.ndarray, np.ndarray]]) -> None:
        elements = np.concatenate([e for e, _ in multisets])
        order = np.argsort(elements, kind="stable")
        self.elements = elements[order]
        self.weights = np.concatenate([w for _, w in multisets]).astype(np.int32)[order]
        self.owner = np.repeat(np.arange(len(multisets), dtype=np.int32), [len(e) for e, _ in multisets])[order]
        self.sizes = np.array([w.sum() for _, w in multisets], np.float64)

    def similarities(self, elements: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Weighted Jaccard similarity of a multiset with each of the block."""
        low = np.searchsorted(self.elements, elements)
        found = np.searchsorted(self.elements, elements, "right") - low
        least = np.zeros(len(self.sizes))
        ends = np.cumsum(found)
        i = 0
        while i < len(found):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] - found[i] + READ, "right")))
            at = np.repeat(low[i:j], found[i:j]) + runs(found[i:j])
            least += np.bincount(self.owner[at], np.minimum(self.weights[at], np.repeat(weights[i:j], found[i:j])), len(least))
            i = j
        return least / (self.sizes + weights.sum() - least)


def _join_blocks(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each place's first kind of nodes with its second that no earlier link or class makes needless."""
    place, held, multisets_held, root, block = None, [], [], {}, None

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x] = root[root[x]]
        return x

    for batch in stream:
        places = list(zip(*(batch.column(c).to_pylist() for c in ("a", "own", "other")), strict=True))
        kinds = batch.column("kind").to_numpy()
        nodes, classes = batch.column("node").to_pylist(), batch.column("class").to_pylist()
        links = []
        for i, j, data, offsets in batches(batch.column("text")):
            elements, weights, distinct = multisets(data, offsets)
            ends = np.cumsum(distinct)
            for r in range(i, j):
                own = slice(ends[r - i] - distinct[r - i], ends[r - i])
                if places[r] != place:
                    place, held, multisets_held, root, block = places[r], [], [], {}, None
                if kinds[r] == 0:
                    # copies, as a view would keep the whole batch
                    held.append((nodes[r], classes[r]))
                    multisets_held.append((elements[own].copy(), weights[own].copy()))
                    continue
                if not held:
                    continue
                if block is None:
                    block, multisets_held = _Block(multisets_held), []
                for h in np.flatnonzero(block.similarities(elements[own], weights[own]) >= SIMILAR):
                    node, known = held[h]
                    if find(known) != find(classes[r]):
                        root[find(known)] = find(classes[r])
                        links.append((node, nodes[r]))
        yield pa.record_batch([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])
