"""Hashed maximum-entropy language model: n-gram and skip features, class-factored softmax.

A word belongs to a class (its last two characters) and within it to a group: the commonest words
of a class are groups of their own, the others fall into groups by their first two
characters. The model is

    P(word | history) = P(class | history) * P(group | class, history) * (c + 1) / (n + v + 1)

with softmax factors for class and group, and the word's share of its group by add-one counts
(n tokens and v words of the group in training; one place per group is left to unknown words).
Features of both factors are hashed: the previous word's group, the previous two together, and, as
a skip, the second word back alone; the group factor's are joined with the class.

Documents are read once, in blocks that list their distinct words. Counts of all
training words are one aggregation over these lists, joined back to them, so that a
block holds its documents as numbers with their counts and groups. Training takes one pass in
``ROUNDS`` jobs: a task runs AdaGrad steps over its blocks, ends with one weight table, and
the tasks' tables are averaged row by row, each weighted by its row's squared gradients.
Scoring goes over the blocks in numpy slices. The driver holds the weights (two tables of
``BUCKETS`` rows), the names of the classes and ``GROUPS`` totals; nothing of these grows with the corpus.

Defined cases: a null or empty text is its end token alone; a null id counts as the empty
text in the split; rows repeat as they come, and copies count as often in training; a text of
any length is one document of its block; classes and groups of equal counts go by name;
without training documents every share is 1 and the factors are uniform; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywell.llm.cache import release
from tallywell.llm.common import new_path, remove_stored, ship_package, stored
from tallywell.llm.token_counts import _packed, _unpacked

#: The end token; no word holds white space.
END = "\n"
BLOCK_CHARS = 12_000_000
#: Characters whose words are numbered at once.
PORTION = 6_000_000
#: Classes (the last ones shared by rare endings), groups of a class, and how many are single words.
CLASSES, SHARED, GROUPS, OWN = 32, 4, 32, 16
BUCKETS = 1 << 15
FEATURES = 3
#: Bound of a summed weight: exponentials stay far from overflow and from subnormal numbers.
LIMIT = 30.0
ROUNDS, STEP, BATCH = 2, 1.0, 2048
#: Training tokens per task at least, where there are several tasks: each ends with a weight table.
TASK_TOKENS = 16_000_000
#: Rows of a weight table that travel together.
PIECE = 1024
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _numbered(texts: pa.Array, index: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the texts, and their words with an end token each as numbers of ``index``, to which new words are added.
    Arrow's ASCII functions lower A-Z alone and split at x20 and x09-x0D alone."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, owner = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    some = pc.greater(pc.binary_length(words), 0)  # white space at either end leaves an empty piece
    sizes = np.bincount(owner[some.to_numpy(zero_copy_only=False)], minlength=len(texts))
    coded = words.filter(some).dictionary_encode()
    known = coded.dictionary.to_pylist()
    for word in known:
        if word not in index:
            index[word] = len(index)
    numbers = np.fromiter(map(index.__getitem__, known), np.int32, len(known))[coded.indices.to_numpy()]
    return sizes + 1, np.insert(numbers, sizes.cumsum(), index[END])


def encoded(docs: DataFrame, learn: Column, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row per block: ids, training marks and sizes of its documents, their words as numbers into the
    block's list of distinct words, and how often each of these stands in training documents."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType
    types = [pa.int64(), pa.list_(to_arrow_type(kind)), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int32())]
    schema = pa.schema(list(zip(("block", "ids", "learn", "sizes", "tokens", "words", "times"), types)))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        number = TaskContext.get().partitionId() << 24
        index, ids, marks, sizes, parts, chars = {END: 0}, [], [], [], [], 0

        def row() -> pa.RecordBatch:
            size, tokens, mark = (np.concatenate(x) for x in (sizes, parts, marks))
            times = np.bincount(tokens[np.repeat(mark, size)], minlength=len(index)).astype(np.int32)
            values = [[number], [pa.concat_arrays(ids)], [mark], [_packed(size)], [_packed(tokens)], [list(index)], [times]]
            return pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(values, schema)], schema=schema)

        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            done = 0
            while done < batch.num_rows:
                # a portion of documents that still fits into the block, one at least
                before = ends[done - 1] if done else 0
                room = min(block_chars - chars, PORTION)
                upto = max(done + 1, int(np.searchsorted(ends, before + room, "right")))
                part = batch.slice(done, upto - done)
                size, tokens = _numbered(part.column(1), index)
                ids.append(pa.array(part.column(0).to_pylist(), part.column(0).type))  # a copy: a slice would keep the batch
                marks.append(part.column(2).to_numpy(zero_copy_only=False).astype(bool))
                sizes.append(size)
                parts.append(tokens)
                chars += int(ends[upto - 1] - before)
                done = upto
                if chars >= block_chars - PORTION // 2:
                    yield row()
                    index, ids, marks, sizes, parts, chars = {END: 0}, [], [], [], [], 0
                    number += 1
        if ids:
            yield row()
        del index, ids, marks, sizes, parts
        pa.default_memory_pool().release_unused()

    return docs.select("doc_id", "text", learn.alias("learn")).mapInArrow(
        gather,
        f"block long, ids array<{kind.simpleString()}>, learn array<boolean>, sizes binary, tokens binary, "
        "words array<string>, times array<int>",
    )


def _last(word: Column) -> Column:
    return F.right(word, F.lit(2))


@dataclass
class Vocabulary:
    """What the model knows of the training words as a whole; every part is bounded."""

    tokens: int
    words: int
    endings: list[str]
    #: ``(word, class, group)`` of the words that are groups of their own.
    own: list[tuple[str, int, int]]
    #: Tokens and words by leaf, ``class * GROUPS + group``.
    leaf_tokens: np.ndarray = field(default_factory=lambda: np.zeros(CLASSES * GROUPS, np.int64))
    leaf_words: np.ndarray = field(default_factory=lambda: np.zeros(CLASSES * GROUPS, np.int64))

    def class_of(self, word: Column) -> Column:
        ending = _last(word)
        known = F.array_position(F.array(*[F.lit(e) for e in self.endings]).cast("array<string>"), ending)
        shared = CLASSES - SHARED + F.pmod(F.xxhash64(ending), F.lit(SHARED))
        return F.when(known > 0, known - 1).otherwise(shared).cast("int")

    def leaves(self, counts: DataFrame) -> DataFrame:
        """``(word, c, leaf)`` of ``counts (word, c)``."""
        own = counts.sparkSession.createDataFrame(self.own, "word string, _class int, _group int").select("word", "_group")
        other = OWN + F.pmod(F.xxhash64(F.left(F.col("word"), F.lit(2))), F.lit(GROUPS - OWN))
        group = F.coalesce("_group", other.cast("int"))
        return counts.join(F.broadcast(own), "word", "left").select(
            "word", "c", (self.class_of(F.col("word")) * GROUPS + group).cast("int").alias("leaf")
        )

    def share(self, leaf: np.ndarray, c: np.ndarray) -> np.ndarray:
        """log10 of a word's share of its group."""
        return np.log10((c + 1) / (self.leaf_tokens[leaf] + self.leaf_words[leaf] + 1))

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.tokens + self.words + 1))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Classes and groups from the counts of all training words."""
    known = counts.filter("c > 0")
    tokens, words = known.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    endings = known.groupBy(_last(F.col("word")).alias("ending")).agg(F.sum("c").alias("n"))
    endings = endings.orderBy(F.col("n").desc(), "ending").limit(CLASSES - SHARED)
    found = Vocabulary(tokens, words, [r["ending"] for r in endings.collect()], [])
    place = Window.partitionBy("class").orderBy(F.col("c").desc(), "word")
    own = (
        known.withColumn("class", found.class_of(F.col("word")))
        .withColumn("rank", F.row_number().over(place))
        .filter(F.col("rank") <= OWN)  # so written, it also limits the classes before the shuffle
        .withColumn("group", F.col("rank") - 1)
    )
    found.own = [(r["word"], r["class"], r["group"]) for r in own.select("word", "class", "group").collect()]  # CLASSES * OWN at most
    totals = found.leaves(known).groupBy("leaf").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"))
    for leaf, n, v in totals.collect():  # CLASSES * GROUPS at most
        found.leaf_tokens[leaf], found.leaf_words[leaf] = n, v
    return found


def features(leaves: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Keys of the ``FEATURES`` features of every token. ``leaves`` are those of whole documents one after
    another, ``place`` the token's number in its document; before a document stands leaf -1."""
    back = []
    for k in (1, 2):
        shifted = np.zeros(len(leaves), np.int64)
        shifted[k:] = leaves[:-k] + 1
        back.append(np.where(place >= k, shifted, 0))
    pair = back[0] * (CLASSES * GROUPS + 1) + back[1]
    kinds = [back[0], back[1], pair]
    return np.stack([x * FEATURES + kind for kind, x in enumerate(kinds)], 1).astype(np.uint64)


def buckets(keys: np.ndarray) -> np.ndarray:
    """Multiplicative hashing into ``BUCKETS`` rows (at most 2**16, which sort fast)."""
    return ((keys + np.uint64(1)) * _GOLDEN >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.uint16)


class Factor:
    """One softmax over hashed features: a weight row per bucket, and what its gradients' squares sum to."""

    def __init__(self, weights: np.ndarray, squares: np.ndarray) -> None:
        self.weights, self.squares = weights, squares

    @staticmethod
    def empty(width: int) -> Factor:
        return Factor(np.zeros((BUCKETS, width), np.float32), np.zeros(BUCKETS, np.float32))

    def copy(self) -> Factor:
        return Factor(self.weights.copy(), self.squares.copy())

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        """Softmax of the summed weights, these kept within +-``LIMIT``."""
        sums = self.weights.take(rows[:, 0], 0)
        for k in range(1, rows.shape[1]):
            sums += self.weights.take(rows[:, k], 0)
        np.clip(sums, -LIMIT, LIMIT, out=sums)
        np.exp(sums, out=sums)
        sums /= sums @ np.ones((sums.shape[1], 1), np.float32)
        return sums

    def of(self, rows: np.ndarray, truth: np.ndarray, length: int = 4 * BATCH) -> np.ndarray:
        """Probability of what came, above 0."""
        found = np.empty(len(truth))
        for k in range(0, len(truth), length):
            part = truth[k : k + length]
            found[k : k + length] = self.probabilities(rows[k : k + length])[np.arange(len(part)), part]
        return np.maximum(found, 1e-30)

    def step(self, rows: np.ndarray, truth: np.ndarray) -> None:
        """One AdaGrad step down the log loss of a batch."""
        slope = self.probabilities(rows)
        slope[np.arange(len(truth)), truth] -= 1
        flat = rows.ravel()
        order = np.argsort(flat, kind="stable")
        ordered, token = flat[order], order // rows.shape[1]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        times = np.diff(first, append=len(flat))
        # most rows are met once in a batch: only the others need sums
        gradient = slope.take(token[first], 0)
        again = times > 1
        if again.any():
            starts = np.cumsum(times[again]) - times[again]
            gradient[again] = np.add.reduceat(slope.take(token[np.repeat(again, times)], 0), starts, 0)
        touched = ordered[first]
        squares = self.squares.take(touched) + np.einsum("ij,ij->i", gradient, gradient)
        self.squares[touched] = squares
        gradient *= (-STEP / np.sqrt(1 + squares))[:, None]
        gradient += self.weights.take(touched, 0)
        self.weights[touched] = gradient


@dataclass
class Block:
    """A block's documents as numbers."""

    sizes: np.ndarray
    tokens: np.ndarray
    learn: np.ndarray
    counts: np.ndarray
    leaf: np.ndarray

    @staticmethod
    def of(batch: pa.RecordBatch, row: int) -> Block:
        learn, sizes, tokens, listed = (batch.column(c)[row] for c in ("learn", "sizes", "tokens", "listed"))
        place, leaf, c = (listed.values.field(k).to_numpy() for k in range(3))
        counts, leaves = np.zeros(len(place), np.int64), np.zeros(len(place), np.int32)
        counts[place], leaves[place] = c, leaf
        marks = learn.values.to_numpy(zero_copy_only=False).astype(bool)
        return Block(_unpacked(sizes.as_py()), _unpacked(tokens.as_py()), marks, counts, leaves)

    def slices(self, wanted: np.ndarray | None = None, length: int = 1 << 15) -> Iterator[tuple[np.ndarray, ...]]:
        """Positions, rows of both factors, class and group of the tokens of ``wanted`` documents, slice by slice."""
        leaves = self.leaf[self.tokens]
        start = self.sizes.cumsum() - self.sizes
        place = np.arange(len(leaves), dtype=np.int32) - np.repeat(start.astype(np.int32), self.sizes)
        at = np.arange(len(leaves)) if wanted is None else np.flatnonzero(np.repeat(wanted, self.sizes))
        for k in range(0, len(at), length):
            part = at[k : k + length]
            low = max(0, part[0] - 2)
            keys = features(leaves[low : part[-1] + 1], place[low : part[-1] + 1])[part - low]
            classes, groups = np.divmod(leaves[part], GROUPS)
            joined = (keys + np.uint64(1)) * np.uint64(CLASSES + 1) + (classes + 1).astype(np.uint64)[:, None]
            yield part, buckets(keys), buckets(joined), classes, groups


def _tables(factors: tuple[Factor, Factor], before: tuple[Factor, Factor]) -> Iterator[tuple]:
    """``(part, moved, gained)`` of the parts that a task has changed: by how much, in half precision, and the gain in squares."""
    for number, (now, old) in enumerate(zip(factors, before)):
        gained = now.squares - old.squares
        for k in range(0, BUCKETS, PIECE):
            if gained[k : k + PIECE].any():
                moved = (now.weights[k : k + PIECE] - old.weights[k : k + PIECE]).astype(np.float16)
                yield number * (BUCKETS // PIECE) + k // PIECE, moved.tobytes(), gained[k : k + PIECE].tobytes()


def train(blocks: DataFrame, tokens: int, rounds: int = ROUNDS) -> tuple[Factor, Factor]:
    """Class and group factor, fitted to the ``tokens`` of the marked documents of ``blocks``; round k takes every document
    whose number in its block leaves k, so that all rounds together are one pass."""
    context = blocks.sparkSession.sparkContext
    model = (Factor.empty(CLASSES), Factor.empty(GROUPS))
    for turn in range(rounds):
        shared = context.broadcast([(f.weights, f.squares) for f in model])

        def fit(batches: Iterator[pa.RecordBatch], turn: int = turn, shared=shared) -> Iterator[pa.RecordBatch]:
            before = tuple(Factor(*f) for f in shared.value)
            now = tuple(f.copy() for f in before)
            for batch in batches:
                for row in range(batch.num_rows):
                    block = Block.of(batch, row)
                    wanted = block.learn & (np.arange(len(block.learn)) % rounds == turn)
                    for _, first, second, classes, groups in block.slices(wanted):
                        for k in range(0, len(classes), BATCH):
                            now[0].step(first[k : k + BATCH], classes[k : k + BATCH])
                            now[1].step(second[k : k + BATCH], groups[k : k + BATCH])
            task = TaskContext.get().partitionId()
            for part, moved, gained in _tables(now, before):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([task], pa.int32()), pa.array([moved]), pa.array([gained])],
                    names=["part", "task", "moved", "gained"],
                )

        def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Sums of the tasks' tables in the order of tasks: a table per part, whatever the number of tasks."""
            sums: dict[int, list] = {}
            for batch in batches:
                for part, moved, gained in zip(batch["part"], batch["moved"], batch["gained"]):
                    gained = np.frombuffer(gained, np.float32).astype(np.float64)
                    moved = np.frombuffer(moved, np.float16).reshape(PIECE, -1) * gained[:, None]
                    if part in sums:
                        sums[part] = [sums[part][0] + moved, sums[part][1] + gained, sums[part][2] + (gained > 0)]
                    else:
                        sums[part] = [moved, gained, (gained > 0).astype(np.float64)]
            rows = [(part, *(x.tobytes() for x in found)) for part, found in sums.items()]
            yield pd.DataFrame(rows, columns=["part", "moved", "gained", "tasks"])

        parts = 2 * BUCKETS // PIECE
        tables = (
            blocks.select("learn", "sizes", "tokens", "listed")
            .coalesce(max(1, tokens // TASK_TOKENS))
            .mapInArrow(fit, "part int, task int, moved binary, gained binary")
            .repartition(min(parts, 16), "part")
            .sortWithinPartitions("part", "task")
            .mapInPandas(merge, "part int, moved binary, gained binary, tasks binary")
        )
        for part, *found in tables.collect():  # 2 * BUCKETS / PIECE rows
            moved, gained, tasks = (np.frombuffer(x) for x in found)
            factor, at = model[part // (BUCKETS // PIECE)], slice(part % (BUCKETS // PIECE) * PIECE, (part % (BUCKETS // PIECE) + 1) * PIECE)
            some = gained > 0
            factor.weights[at][some] += (moved.reshape(PIECE, -1)[some] / gained[some, None]).astype(np.float32)
            factor.squares[at][some] += (gained[some] / tasks[some]).astype(np.float32)
        shared.unpersist()
    return model


def score_block(block: Block, known: Vocabulary, model: tuple[Factor, Factor]) -> tuple[np.ndarray, ...]:
    """Per document: known tokens, base score, model score."""
    owner = np.repeat(np.arange(len(block.sizes)), block.sizes)
    total = np.zeros(len(block.sizes))
    for part, first, second, classes, groups in block.slices():
        chance = np.log10(model[0].of(first, classes)) + np.log10(model[1].of(second, groups))
        total += np.bincount(owner[part], chance, len(total))
    sums = (np.bincount(owner, of[block.tokens], len(total)) for of in (block.counts > 0, known.base(block.counts), known.share(block.leaf, block.counts)))
    seen, base, share = sums
    return np.rint(seen).astype(np.int64), base, total + share


def prepared(docs: DataFrame, learn: Column, block_chars: int = BLOCK_CHARS) -> tuple[DataFrame, Vocabulary]:
    """The blocks of ``docs``, their words replaced by counts and leaves, and the vocabulary."""
    ship_package(docs.sparkSession)
    read = stored(encoded(docs, learn, block_chars), "words")
    listed = read.select("block", F.posexplode(F.arrays_zip("words", "times")).alias("place", "x")).select(
        "block", "place", F.col("x.words").alias("word"), F.col("x.times").alias("times")
    )
    counts = stored(listed.groupBy("word").agg(F.sum("times").alias("c")), "counts")
    known = vocabulary(counts)
    back = (
        listed.join(known.leaves(counts), "word")
        .groupBy("block")
        .agg(F.collect_list(F.struct("place", "leaf", "c")).alias("listed"))
    )
    path = new_path(docs.sparkSession, "blocks")
    read.drop("words", "times").join(back, "block").write.parquet(path)
    remove_stored(read)
    remove_stored(counts)
    # a row is a block of some megabytes: a session of its own hands them to Python one by one
    session = docs.sparkSession.newSession()
    session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    return session.read.parquet(path), known


def scored(blocks: DataFrame, known: Vocabulary, model: tuple[Factor, Factor]) -> DataFrame:
    """``(doc_id, learn, n_tokens, n_known, train_tokens, base_score, score)`` of every document of ``blocks``."""
    from pyspark.sql.pandas.types import to_arrow_type

    shared = blocks.sparkSession.sparkContext.broadcast((known, model))
    kind = blocks.schema["ids"].dataType.elementType
    types = [to_arrow_type(kind), pa.bool_(), *[pa.int64()] * 3, pa.float64(), pa.float64()]
    names = ["doc_id", "learn", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                block = Block.of(batch, row)
                seen, base, total = score_block(block, known, model)
                ids = batch.column("ids")[row].values
                columns = [ids, block.learn, block.sizes.astype(np.int64), seen, np.full(len(seen), known.tokens), base, total]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return blocks.mapInArrow(
        score,
        f"doc_id {kind.simpleString()}, learn boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )


def scores(docs: DataFrame, learn: Column, block_chars: int = BLOCK_CHARS, rounds: int = ROUNDS) -> DataFrame:
    """Every row of ``docs`` scored by the model trained on the rows where ``learn`` holds."""
    blocks, known = prepared(docs, learn, block_chars)
    path = new_path(docs.sparkSession, "scores")
    scored(blocks, known, train(blocks, known.tokens, rounds)).write.parquet(path)
    remove_stored(blocks)
    return docs.sparkSession.read.parquet(path)
