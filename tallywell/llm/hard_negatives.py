"""Hard negatives of anchor vectors by certified searches in an inverted multi-index.

Rows are indexed once (``multi_index``): cells of two half-space codebooks, written as blocks of
about ``BLOCK_ROWS`` rows, so a cell that holds a third of all rows is many blocks. A search
goes in rounds. Each round, an anchor takes the next cells of its multi-sequence heap until
they hold the round's number of rows (which grows from round to round), leaving out cells
whose bounds miss all its windows; packs of anchors meet the blocks of the cells they ask
for, and the best five per window are kept. An anchor has finished when the bound of
its next cell lies below what could still enter any of its windows. There is no other
limit, so the result is exact. The first search finds the positives; the second searches all
windows ``0.8 * positive .. positive`` of an anchor together.

On vectors without structure the bounds certify little, and most cells are visited.

Defined cases: rows without id, label or vector, or with a null or non-finite component take no
part; rows equal in id, label and vector count once; other rows are told from an anchor by
their id, and rows that share an id with different vectors stay apart; components saturate at
2**28; a shorter vector counts as continued by zeros; equal scores go by id; no positives,
or no row in a window, give no rows; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywell.llm.common import remove_stored, ship_package, stored
from tallywell.llm.multi_index import SAMPLE, Index, fitted

TOP = 5
BLOCK_ROWS = 4096
#: Anchors per request, and rows that an anchor visits in the first round; each round visits so many times more.
PACK, FIRST_ROWS, GROWTH = 256, 8192, 16
#: Largest component: products of 64 of them still fit into 64 bits.
MOST = 1 << 28
FAR = 1 << 62

REQUESTS = (
    "cell int, keys array<long>, ids array<long>, labels array<long>, vectors binary, "
    "floors binary, highs binary, visited array<long>"
)
FOUND = "key long, target int, score long, id long"


def prepared(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """``(vec_id, label, v)`` of the rows that take part, components as whole numbers."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(
        "embedding",
        lambda x: F.least(F.greatest(F.floor(x.cast("double") * scale), F.lit(-MOST)), F.lit(MOST)).cast("int"),
    )
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return embeddings.filter(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False))
    ).select(F.col("vec_id").cast("long").alias("vec_id"), moved.cast("long").alias("label"), whole.alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of equal width, shorter lists continued by zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(sizes) and (sizes == width).all():
        return values.reshape(-1, width)
    rows = np.zeros((len(sizes), width))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    rows[owner, np.arange(len(values)) - np.repeat(sizes.cumsum() - sizes, sizes)] = values
    return rows


def scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products; by floating point where all partial sums are whole numbers below 2**53."""
    most = np.abs(left).max(initial=0) * np.abs(right).max(initial=0) * max(left.shape[1], 1)
    if most < 2**53:
        return (left @ right.T).astype(np.int64)
    return left.astype(np.int64) @ right.T.astype(np.int64)


class _Search:
    """The index of one table: its cells on the driver (bounded), its rows as blocks in the shared folder."""

    def __init__(self, rows: DataFrame, block_rows: int = BLOCK_ROWS) -> None:
        self.spark: SparkSession = rows.sparkSession
        count, width = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
        self.empty = not count
        if self.empty:
            return
        width = max(width, 1)
        edge = int(min(1.0, SAMPLE / count) * (1 << 30))
        sample = rows.filter(F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)) < edge).select("v").limit(2 * SAMPLE).toArrow()
        if not sample.num_rows:
            sample = rows.select("v").limit(1).toArrow()
        index = fitted(matrix(sample.column("v").combine_chunks(), width), count)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell, first, second = index.assign(matrix(batch.column(2), width))
                columns = [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(first), pa.array(second)]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "v", "cell", "first", "second"])

        self.rows = stored(
            rows.mapInArrow(assign, "vec_id long, label long, v array<int>, cell int, first double, second double"), "vectors"
        )
        # at most MOST_WORDS squared rows
        cells = self.rows.groupBy("cell").agg(
            F.count(F.lit(1)).alias("n"), F.max("first").alias("first"), F.max("second").alias("second")
        ).toArrow()
        self.index: Index = index.with_cells(*(cells.column(c).to_numpy() for c in ("cell", "n", "first", "second")))
        parts = [
            (int(c), -(-int(n) // block_rows)) for c, n in zip(cells.column("cell").to_numpy(), cells.column("n").to_numpy())
        ]
        self.parts = self.spark.createDataFrame(parts, "cell int, parts int")
        # a set, so that repeated rows leave the task as one
        self.blocks = stored(
            self.rows.join(F.broadcast(self.parts), "cell")
            .groupBy("cell", F.pmod(F.xxhash64("vec_id", "label", "v"), F.col("parts")).cast("int").alias("block"))
            .agg(F.collect_set(F.struct("vec_id", "label", "v")).alias("rows")),
            "blocks",
        )

    def anchors(self, wanted: str) -> DataFrame:
        """``(key, vec_id, label, v, cell)`` of the rows that satisfy ``wanted``, each once."""
        return (
            self.rows.filter(wanted)
            .select(F.xxhash64("vec_id", "label", "v").alias("key"), "vec_id", "label", "v", "cell")
            .dropDuplicates(["key"])
        )

    def _requests(self, states: DataFrame, budget: int, tasks: int) -> DataFrame:
        """For every unfinished anchor the cells it visits next: a row per pack and cell. Rows with
        cell -1 say how many cells an anchor has left behind."""
        index, width = self.index, self.index.width
        types = [pa.int32(), *[pa.list_(pa.int64())] * 3, *[pa.binary()] * 3, pa.list_(pa.int64())]
        schema = pa.schema(list(zip(("cell", "keys", "ids", "labels", "vectors", "floors", "highs", "visited"), types)))

        def pack(part: list[dict]) -> Iterator[pa.RecordBatch]:
            vectors = np.zeros((len(part), width))
            asked: dict[int, list[int]] = defaultdict(list)
            visited = []
            for k, anchor in enumerate(part):
                vectors[k, : len(anchor["v"])] = anchor["v"]
                goals = [(t["floor"], t["high"]) for t in anchor["targets"]]
                need = min((low for low, high in goals if low <= high), default=FAR)
                gathered, passed = 0, anchor["visited"]
                for n, (cell, bound, upper, lower) in enumerate(index.order(vectors[k])):
                    if n < passed:
                        continue
                    if bound < need or gathered >= budget:
                        break
                    passed += 1
                    if any(upper >= low and lower <= high for low, high in goals if low <= high):
                        asked[cell].append(k)
                        gathered += int(index.sizes[cell])
                visited.append(passed)
            floors = np.array([[t["floor"] for t in a["targets"]] for a in part], "<i8")
            highs = np.array([[t["high"] for t in a["targets"]] for a in part], "<i8")
            keys, ids, labels = (np.array([a[c] for a in part], np.int64) for c in ("key", "vec_id", "label"))
            rows = [[-1, keys, ids, labels, b"", b"", b"", visited]]
            for cell, who in asked.items():
                taken = [x[who].tobytes() for x in (vectors.astype("<i4"), floors, highs)]
                rows.append([cell, keys[who], ids[who], labels[who], *taken, []])
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                anchors = batch.to_pylist()
                for k in range(0, len(anchors), PACK):
                    yield from pack(anchors[k : k + PACK])

        return states.repartitionByRange(tasks, "cell", "key").mapInArrow(ask, REQUESTS)

    def _found(self, requests: DataFrame, same_label: bool) -> DataFrame:
        """The rows of the visited cells that may enter a window, at most ``TOP`` per block and window."""
        width = self.index.width

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for k in range(batch.num_rows):
                    keys, ids, labels = (batch.column(c)[k].values.to_numpy() for c in range(3))
                    vectors, floors, highs = (batch.column(c)[k].as_py() for c in range(3, 6))
                    left = np.frombuffer(vectors, "<i4").reshape(len(keys), -1).astype(np.float64)
                    floors, highs = (np.frombuffer(x, "<i8").reshape(len(keys), -1) for x in (floors, highs))
                    block = batch.column(6)[k].values
                    other, marks = (block.field(c).to_numpy() for c in range(2))
                    products = scores(left, matrix(block.field(2), width))
                    if same_label:
                        allowed = (labels[:, None] == marks[None, :]) & (ids[:, None] != other[None, :])
                    else:
                        allowed = labels[:, None] != marks[None, :]
                    for t in range(floors.shape[1]):
                        hits = allowed & (products >= floors[:, t, None]) & (products <= highs[:, t, None])
                        for i in np.flatnonzero(hits.any(1)):
                            at = np.flatnonzero(hits[i])
                            if len(at) > TOP:
                                least = np.partition(products[i, at], len(at) - TOP)[len(at) - TOP]
                                at = at[products[i, at] >= least]
                            at = at[np.lexsort((other[at], -products[i, at]))[:TOP]]
                            out.append((np.full(len(at), keys[i]), np.full(len(at), t), products[i, at], other[at]))
                if out:
                    key, target, found, who = (np.concatenate(c) for c in zip(*out))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key), pa.array(target.astype(np.int32)), pa.array(found), pa.array(who)],
                        names=["key", "target", "score", "id"],
                    )

        asked = requests.filter("cell >= 0").join(F.broadcast(self.parts), "cell")
        return (
            asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .join(self.blocks, ["cell", "block"])
            .select("keys", "ids", "labels", "vectors", "floors", "highs", "rows")
            .mapInArrow(score, FOUND)
        )

    def run(self, anchors: DataFrame, same_label: bool) -> DataFrame:
        """``(key, target, score, id)``: the first ``TOP`` rows per window of ``anchors (key, vec_id, label, v, cell, targets)``;
        ``targets`` is an array of windows ``(floor, high)``."""
        tasks = max(1, anchors.count() // (2 * PACK))
        best = self.spark.createDataFrame([], FOUND)
        states, budget, old = anchors.withColumn("visited", F.lit(0).cast("long")), FIRST_ROWS, []
        order = Window.partitionBy("key", "target").orderBy(F.col("score").desc(), "id")
        while True:
            requests = stored(self._requests(states, budget, tasks), "requests")
            for table in old:
                remove_stored(table)
            if requests.filter("cell >= 0").isEmpty():
                remove_stored(requests)
                return best
            known, best = best, stored(
                best.union(self._found(requests, same_label)).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= TOP).drop("_n"),
                "best",
            )
            if known.inputFiles():
                remove_stored(known)
            passed = requests.filter("cell = -1").select(F.explode(F.arrays_zip("keys", "visited")).alias("x"))
            passed = passed.select(F.col("x.keys").alias("key"), F.col("x.visited").alias("visited"))
            full = (
                best.groupBy("key", "target")
                .agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
                .filter(F.col("n") == TOP)
                .groupBy("key")
                .agg(F.map_from_entries(F.collect_list(F.struct("target", "least"))).alias("least"))
            )
            # a window that has its rows is raised to the last of them
            raised = F.transform(
                "targets",
                lambda t, i: F.struct(
                    F.greatest(t["floor"], F.coalesce(F.try_element_at("least", i), t["floor"])).alias("floor"), t["high"].alias("high")
                ),
            )
            states = stored(
                anchors.join(passed, "key").join(full, "key", "left").withColumn("targets", raised).select(*anchors.columns, "visited"), "states"
            )
            budget, old = budget * GROWTH, [requests, states]

    def remove(self) -> None:
        remove_stored(self.rows)
        remove_stored(self.blocks)


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(rows: DataFrame, wanted: str = "vec_id % 100 = 0", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The hard negatives of the anchors among ``rows (vec_id, label, v)``, whole-number vectors."""
    ship_package(rows.sparkSession)
    search = _Search(rows, block_rows)
    if search.empty:
        return rows.sparkSession.createDataFrame([], RESULT)
    window = lambda low, high: F.struct(low.cast("long").alias("floor"), high.cast("long").alias("high"))
    anchors = stored(search.anchors(wanted), "anchors")
    everything = F.array(window(F.lit(-FAR), F.lit(FAR)))
    positives = search.run(anchors.withColumn("targets", everything), same_label=True)
    ranked = Window.partitionBy("key").orderBy(F.col("score").desc(), "id")
    positives = stored(positives.withColumn("target", F.row_number().over(ranked) - 1), "positives")
    # 80 * positive <= 100 * negative, in whole numbers
    low = F.expr("score - (score - pmod(score, 5L)) div 5")
    windows = (
        positives.withColumn("w", window(low, F.col("score")))
        .groupBy("key")
        .agg(F.sort_array(F.collect_list(F.struct("target", "w"))).alias("w"))
        .select("key", F.transform("w", lambda x: x["w"]).alias("targets"))
    )
    # every anchor has as many windows: those that are missing can't be entered
    padded = F.slice(F.concat("targets", F.array_repeat(window(F.lit(FAR), F.lit(-FAR)), TOP)), 1, TOP)
    searched = stored(anchors.join(windows.withColumn("targets", padded), "key"), "windows")
    negatives = search.run(searched, same_label=False)
    place = Window.partitionBy("key", "target").orderBy(F.col("score").desc(), "id")
    result = stored(
        negatives.select("key", "target", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), F.row_number().over(place).alias("rank"))
        .join(positives.select("key", "target", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), ["key", "target"])
        .join(anchors.select("key", F.col("vec_id").alias("anchor_id")), "key")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"),
        "negatives",
    )
    for table in (anchors, positives, searched):
        remove_stored(table)
    search.remove()
    return result


SQL = """
WITH valid AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS same, r.vec_id = a.vec_id AS itself,
         CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM valid AS a, valid AS r WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same AND NOT itself
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS INT) AS rank,
       n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives AS p JOIN pairs AS n ON n.anchor_id = p.anchor_id AND NOT n.same
 AND 80 * p.positive_score <= 100 * n.score AND n.score <= p.positive_score
QUALIFY rank <= 5
"""
