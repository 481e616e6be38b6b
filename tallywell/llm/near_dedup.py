"""Near-duplicates of documents: DartMinHash signatures, banded joining, exact verification.

A document is a weighted set: its shingles of five words (lower case, split at white
space) with their numbers of occurrence as weights. Darts are thrown into the
region of an element (weight axis from 0 up, rank axis from 0 up) as a hashed
Poisson process: the gaps between ranks are exponential and, like a dart's weight and its
coordinate, come from hashes of the element alone, so that all documents share
their darts. Darts above the element's weight miss. A document throws until rank
``(ln k + 2) k / total weight`` - further only while a coordinate is still empty - and
keeps the earliest dart of each of the k coordinates; two documents agree in a coordinate
with probability equal to their weighted Jaccard similarity. The work is in proportion
to the shingles plus k log k, not to their product.

Documents of equal weighted sets form one node. Nodes that share a band of the signature
meet in a bucket. A bucket is not expanded into pairs: its members are compared with one
central member, the pivot, and links are contracted into components. Buckets whose members are then
in several components are read once more, in blocks of ``BLOCK`` members: a task holds two blocks
with their sets and links what belongs together across components, the likeliest first, each pair in
its first bucket only and none within what is linked by then. There, pairs whose signatures differ
in more coordinates than pairs at the threshold do by five standard deviations (1 in a million such
pairs) are left out, and pairs too different in weight to reach it. Every comparison that decides is
exact, on the whole weighted sets; no pair becomes a row before it is a link.

Defined cases: a text of one to four words is one shingle; a null text or one without words has
no near-duplicates. The document kept is that with the smallest id (null first, then the
first row). Repeated rows fall into one class. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywell.llm.cache import release
from tallywell.llm.common import row_key, rows_with_keys, ship_package, stored
from tallywell.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 27
ROWS = 7
#: Coordinates of a signature; the few that fill no band serve the sketch only.
COORDINATES = 192
#: Members and bytes of their sets that a task takes from a bucket at once.
BLOCK, BLOCK_BYTES = 256, 8_000_000
#: Pivots that a node is compared with: those it shares most buckets with.
PIVOTS_PER_NODE = 3

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
#: Darts thrown at once for all elements, at most (but one for each).
_CELLS = 1 << 16


def _mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixing (two xor-shift-multiply rounds)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_FACTORS = _mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


def _uniform(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers above 0 and at most 1."""
    return ((x >> _U(11)).astype(np.float64) + 1.0) * 2.0**-53


def _word_hashes(words: list[str]) -> np.ndarray:
    """Per word the sum of its UTF-8 bytes times fixed random numbers by place, mixed."""
    raw = np.frombuffer((" ".join(words) + " ").encode("utf-8", "replace"), np.uint8)
    ends = np.flatnonzero(raw == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(starts, ends + 1 - starts)
    longest = int(place.max()) + 1
    factors = _FACTORS if longest <= len(_FACTORS) else _mix(np.arange(1, longest + 1, dtype=np.uint64) * _ODD)
    return _mix(np.add.reduceat((raw.astype(np.uint64) + _U(1)) * factors[place], starts))


def weighted_set(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed shingles in order and how often each occurs."""
    words = (text or "").lower().split()
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes = _word_hashes(words)
    n = min(SHINGLE, len(hashes))
    total = np.full(len(hashes) - n + 1, n, np.uint64)
    for k in range(n):
        total = _mix(total * _ODD + hashes[k : len(hashes) - n + 1 + k])
    return np.unique(total, return_counts=True)


def signature(elements: np.ndarray, weights: np.ndarray, k: int = COORDINATES) -> np.ndarray:
    """The hashes of the earliest dart in each of ``k`` coordinates; weights are positive numbers."""
    # weight regions [2^v - 1, 2^(v+1) - 1), as many as the weight reaches into
    levels = np.floor(np.log2(np.maximum(weights, 1e-300) + 1.0)).astype(np.int64)
    levels = np.where(2.0**levels - 1.0 >= weights, levels - 1, levels) + 1
    owner = np.repeat(np.arange(len(elements)), levels)
    level = np.arange(len(owner)) - np.repeat(levels.cumsum() - levels, levels)
    low, size = 2.0**level - 1.0, 2.0**level
    limit = weights[owner].astype(np.float64)
    seed = _mix(elements[owner] + _ODD * (level.astype(np.uint64) + _U(1)))
    reach = k * (math.log(k) + 2.0) / float(weights.sum())
    while True:
        ranks, darts = [], []
        at, rank, step = np.arange(len(owner)), np.zeros(len(owner)), 0
        while len(at):
            mean = reach * float(size[at].max())
            width = math.ceil(mean + 2.0 * math.sqrt(mean)) if step == 0 else math.ceil(math.sqrt(mean))
            width = max(1, min(width, _CELLS // len(at)))
            number = np.arange(step + 1, step + width + 1, dtype=np.uint64)
            own = _mix(seed[at][:, None] ^ _mix(number * _ODD)[None, :])
            gaps = -np.log(_uniform(own)) / size[at][:, None]
            when = rank[:, None] + gaps.cumsum(1)
            inside = when <= reach
            hit = inside & (low[at][:, None] + _uniform(_mix(own + _U(1))) * size[at][:, None] <= limit[at][:, None])
            ranks.append(when[hit])
            darts.append(own[hit])
            on = inside[:, -1]
            at, rank, step = at[on], when[on, -1], step + width
        when, dart = np.concatenate(ranks), np.concatenate(darts)
        order = np.argsort(-when, kind="stable")  # the earliest is written last
        coordinate = (_mix(dart + _U(2)) % _U(k)).astype(np.int64)[order]
        out, filled = np.zeros(k, np.uint64), np.zeros(k, bool)
        out[coordinate] = dart[order]
        filled[coordinate] = True
        if filled.all():
            return out
        reach *= 2.0


def band_keys(sign: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    total = _mix(np.arange(1, bands + 1, dtype=np.uint64) * _ODD)
    for r in range(rows):
        total = _mix(total * _ODD + sign[: bands * rows].reshape(bands, rows)[:, r])
    return total.view(np.int64)


def sketch(sign: np.ndarray) -> np.ndarray:
    """Four bits of every coordinate, sixteen coordinates to a long."""
    bits = (sign.reshape(-1, 16) >> _U(7)) & _U(15)
    return (bits << (np.arange(16, dtype=np.uint64) * _U(4))).sum(1, dtype=np.uint64).view(np.int64)


def most_different(least: float, k: int = COORDINATES) -> int:
    """In how many of ``k`` four-bit coordinates a pair at the threshold may differ."""
    differ = (1.0 - least) * 15 / 16
    return math.floor(k * differ + 5 * math.sqrt(k * differ * (1 - differ)))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two weighted sets with elements in order."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.searchsorted(a[0], b[0])
    at[at == len(a[0])] = 0
    same = a[0][at] == b[0]
    shared = int(np.minimum(a[1][at[same]], b[1][same]).sum())
    return shared / (int(a[1].sum()) + int(b[1].sum()) - shared)


def _print(elements: np.ndarray, counts: np.ndarray) -> bytes:
    return hashlib.blake2b(elements.tobytes() + counts.astype("<i8").tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame) -> DataFrame:
    """``(row, doc_id, key, print, bands, sketch)`` per row, stored: the digest of its weighted set, its band
    keys and four bits of each coordinate."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            prints, bands, sketches = [], [], []
            for text in batch.column(2):
                elements, counts = weighted_set(text.as_py())
                prints.append(_print(elements, counts) if len(elements) else None)
                sign = signature(elements, counts) if len(elements) else None
                bands.append(band_keys(sign) if sign is not None else [])
                sketches.append(sketch(sign) if sign is not None else [])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(prints, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                    pa.array(sketches, pa.list_(pa.int64())),
                ],
                names=["doc_id", "key", "print", "bands", "sketch"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = docs.select("doc_id", row_key(docs).alias("key"), "text").mapInArrow(
        sign, f"doc_id {kind}, key string, print binary, bands array<bigint>, sketch array<bigint>"
    )
    return stored(signed.withColumn("row", F.monotonically_increasing_id()), "signatures")


def _vectors(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, elements, counts)`` of ``nodes (node, key, print)``, from their texts; no counts if all are 1."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [weighted_set(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([e.tobytes() for e, _ in sets], pa.binary()),
                    pa.array([b"" if c.max(initial=1) == 1 else c.astype("<i4").tobytes() for _, c in sets], pa.binary()),
                ],
                names=["node", "elements", "counts"],
            )

    texts = docs.select(row_key(docs).alias("key"), "text")
    one = nodes.select("node", "key").hint("merge")
    return stored(
        texts.join(one, "key")
        .select("node", "text")
        .mapInArrow(measure, "node long, elements binary, counts binary")
        .dropDuplicates(["node"]),
        "vectors",
    )


def _read(elements: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    found = np.frombuffer(elements, np.uint64)
    return found, np.frombuffer(counts, "<i4") if counts else np.ones(len(found), np.int32)


def _verified(pairs: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """The ``pairs (a, b)`` whose exact similarity reaches ``least``."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                ae, ac, be, bc = (batch.column(c)[i].as_py() for c in range(2, 6))
                keep.append(similarity(_read(ae, ac), _read(be, bc)) >= least)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    first = vectors.toDF("a", "ae", "ac")
    second = vectors.toDF("b", "be", "bc")
    joined = pairs.join(first, "a").join(second, "b").select("a", "b", "ae", "ac", "be", "bc")
    return joined.mapInArrow(compare, "a long, b long")


def _pivot_pairs(members: DataFrame, per_node: int) -> DataFrame:
    """From ``(bucket, node)``: each node with the pivots of its buckets, those first that it meets in most buckets.

    The pivot is a central member: its buckets hold many nodes, as a text from which the others were
    copied has. Sizes and pivots are found with map-side combining.
    """
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size"))
    central = members.join(sizes, "bucket").groupBy("node").agg(F.sum("size").alias("weight"))
    ranked = stored(members.join(central, "node"), "ranked")
    order = F.struct("weight", (-F.col("node")).alias("less"), "node")
    pivots = ranked.groupBy("bucket").agg(F.max(order).alias("p"))
    met = (
        ranked.join(pivots, "bucket")
        .filter(F.col("node") != F.col("p.node"))
        .groupBy("node", F.col("p.node").alias("pivot"))
        .agg(F.count("*").alias("shared"))
    )
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("shared"), "pivot"))
    chosen = met.withColumn("place", place).filter(F.col("place") <= per_node)
    return chosen.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()


class _Members:
    """Members of one bucket, of one part or of two, with their sets."""

    def __init__(self, bucket: int, rows: list[dict]) -> None:
        self.bucket, self.nodes = bucket, [r["node"] for r in rows]
        self.label = np.array([r["label"] for r in rows])
        self.part = np.array([r["part"] for r in rows])
        self.bands = np.array([r["bands"] for r in rows])
        self.sketch = np.array([r["sketch"] for r in rows], np.int64).view(np.uint64)
        self.sets = [_read(r["elements"], r["counts"]) for r in rows]
        self.weight = np.array([int(c.sum()) for _, c in self.sets])

    def candidates(self, i: int, least: float) -> np.ndarray:
        """Later members that may be near-duplicates of member i, the likeliest first."""
        later = np.arange(i + 1, len(self.nodes))
        ok = self.label[later] != self.label[i]
        if self.part.min() != self.part.max():
            ok &= self.part[later] != self.part[i]
        light, heavy = np.minimum(self.weight[later], self.weight[i]), np.maximum(self.weight[later], self.weight[i])
        later = later[ok & (light >= least * heavy)]
        shared = self.bands[later] == self.bands[i]
        later = later[self.bands[i][shared.argmax(1)] == self.bucket]  # the first bucket that both are in
        differ = self.sketch[later] ^ self.sketch[i]
        for shift in (1, 2):
            differ |= differ >> _U(shift)
        differ = np.bitwise_count(differ & _U(0x1111111111111111)).sum(1)
        near = differ <= most_different(least)
        return later[near][np.argsort(differ[near], kind="stable")]

    def links(self, least: float) -> Iterator[tuple[int, int]]:
        top: dict[int, int] = {}

        def component(label: int) -> int:
            while label in top:
                label = top[label]
            return label

        for i in range(len(self.nodes) - 1):
            for j in self.candidates(i, least):
                one, other = component(int(self.label[i])), component(int(self.label[j]))
                if one != other and similarity(self.sets[i], self.sets[j]) >= least:
                    top[max(one, other)] = min(one, other)
                    yield tuple(sorted((self.nodes[i], self.nodes[j])))


def _links_across(open_members: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """Links ``(a, b)`` between nodes of different components that share a bucket, as many as connect what
    belongs together within two parts of a bucket.

    A bucket has as many parts as its members or their bytes ask for; every two of its parts meet in
    one group of rows, which streams through a task sorted, a group at a time.
    """
    size = (F.length("elements") + F.length("counts")).alias("bytes")
    sized = open_members.join(vectors.select("node", size), "node")
    parts = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("bytes") / BLOCK_BYTES)).cast("int")
    load = sized.groupBy("bucket").agg(parts.alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    placed = (
        open_members.join(load, "bucket")
        .withColumn("part", part)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .join(vectors, "node")
        .select(
            "bucket", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"),
            "part", "node", "label", "bands", "sketch", "elements", "counts",
        )
        .repartition("bucket", "p", "q")
        .sortWithinPartitions("bucket", "p", "q", "node")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def found() -> Iterator[pa.RecordBatch]:
            links = list(_Members(key[0], rows).links(least)) if rows else []
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], names=["a", "b"])

        for batch in batches:
            for row in batch.to_pylist():
                if (now := (row["bucket"], row["p"], row["q"])) != key:
                    yield from found()
                    key, rows = now, []
                rows.append(row)
        yield from found()

    return placed.mapInArrow(compare, "a long, b long").distinct()


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``members`` with their label, of the buckets whose nodes are in more than one component."""
    labelled = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    split = labelled.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi")
    return labelled.join(split.select("bucket"), "bucket", "left_semi")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels of all linked nodes after adding ``links``; components so far stay one node each."""
    contracted = (
        links.join(labels.toDF("a", "la"), "a", "left")
        .join(labels.toDF("b", "lb"), "b", "left")
        .select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    )
    lifted = stored(components(stored(contracted, "contracted")), "lifted").toDF("label", "top")
    moved = labels.join(lifted, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    fresh = lifted.join(labels.select(F.col("node").alias("label")), "label", "left_anti").toDF("node", "label")
    return moved.union(fresh)


def node_labels(docs: DataFrame, nodes: DataFrame, least: float) -> DataFrame | None:
    """``(node, label)`` of the nodes with a link; None if there is no link."""
    placed = nodes.select(F.explode("bands").alias("bucket"), "node")
    busy = placed.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo != hi")
    members = stored(placed.join(busy.select("bucket"), "bucket", "left_semi"), "members")
    if members.isEmpty():
        return None
    involved = members.select("node").distinct()
    vectors = _vectors(docs, nodes.join(involved, "node", "left_semi"))
    pairs = stored(_pivot_pairs(members, PIVOTS_PER_NODE), "pairs")
    links = stored(_verified(pairs, vectors, least), "verified")
    labels = stored(components(links), "labels")
    # what the pivots left apart
    left = _open(members, labels).join(nodes.select("node", "bands", "sketch"), "node")
    more = stored(_links_across(stored(left, "open"), vectors, least), "across")
    if more.isEmpty():
        return labels
    return stored(_merged(labels, more), "labels")


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``(doc_id, class_id, class_size, kept, key)``, one row per row of ``docs``: ``class_id`` is the id
    of the document that stays for the class."""
    ship_package(docs.sparkSession)
    signed = signatures(docs)
    nodes = stored(
        signed.filter("print is not null")
        .groupBy("print")
        .agg(F.min("row").alias("node"), F.min_by("key", "row").alias("key"), F.min_by("bands", "row").alias("bands"), F.min_by("sketch", "row").alias("sketch")),
        "nodes",
    )
    labels = node_labels(docs, nodes, least)
    own = nodes.select("print", "node")
    if labels is not None:
        own = own.join(labels, "node", "left").select("print", F.coalesce("label", "node").alias("label"))
    else:
        own = own.withColumnRenamed("node", "label")
    rows = stored(
        signed.select("row", "doc_id", "key", "print")
        .join(own, "print", "left")
        .select("row", "doc_id", "key", F.coalesce("label", "row").alias("label")),
        "classes",
    )
    order: Column = F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", "row")
    best = rows.groupBy("label").agg(F.min(order).alias("best"), F.count("*").alias("class_size")).filter("class_size > 1")
    return rows.join(best, "label", "left").select(
        "doc_id",
        F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        (F.col("best").isNull() | (F.col("best.row") == F.col("row"))).alias("kept"),
        "key",
    )


def keep_one(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay, one of each class, with all their columns."""
    return rows_with_keys(docs, near_duplicates(docs, least).filter("kept").select("key"))
