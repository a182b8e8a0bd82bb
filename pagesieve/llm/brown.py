"""LM scoring by a class bigram model of Brown clusters.

Counts of all training words come first. The most frequent words are clustered by the exchange algorithm on their bigram counts, one word
at a time. Then all words of the dictionary are exchanged in distributed rounds: class counts are held, every word moves to the class that
raises the likelihood most given its neighbours' classes, and the counts are taken anew. Words beyond the dictionary, of any number, get
their class by the same rule in one pass that meets their neighbours' classes by word, and are joined back by word, so every training word
has a class of its own. A text's probability is the product of smoothed class transitions and of word emissions within the class.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text_crc, stored, writers

#: Words whose exchange is sequential, classes, words of the dictionary that is broadcast. All other words are counted, classed and looked up by joins.
EXCHANGE_WORDS, CLASSES, DICTIONARY = 1024, 64, 1 << 18
#: Sequential rounds, at most; distributed rounds over the whole dictionary.
EXCHANGE_ROUNDS, SHARED_ROUNDS = 8, 2
#: Added to word counts; to the class bigrams that words are moved by; weight of the class's own frequency in a transition.
ADDED, ADDED_PAIRS, PRIOR = 0.1, 0.1, 50.0
#: Held-out rows: crc32 of the id modulo 10 is 0.
FOLDS = 10
#: Words that a task counts before it gives its counts on; tokens whose contexts it counts together; rows of one block of a matrix and words of one block of contexts.
COUNTED, TOGETHER, BLOCK_ROWS, BLOCK_WORDS = 500_000, 1 << 20, 64, 1024
#: Texts that a kernel turns into words at once.
TEXTS = 512
#: In a sequence of classes: a word beyond the dictionary, and a word that training doesn't hold.
HOLE, UNKNOWN = 255, 254
END = b""


def is_held_out(doc_id: Column) -> Column:
    return id_text_crc(doc_id) % FOLDS == 0


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased; ``bytes.split`` cuts at ASCII space and U+0009 to U+000D only."""
    return (text or "").encode().lower().split()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.binary()), "n": pa.array(list(held.values()), pa.int64())})

    for batch in batches:
        for text in batch.column("text"):
            held.update(words_of(text.as_py()))
            held[END] += 1
            if len(held) > COUNTED:
                yield out()
                held.clear()
    yield out()


class _Vocabulary:
    """What the kernels need of the dictionary: counts and places of its words."""

    def __init__(self, words: bytes, counts: bytes):
        self.words = words.split(b"\n") if counts else []
        self.counts = np.frombuffer(counts, np.int64)
        self.place = {w: i for i, w in enumerate(self.words)}


def _vocabulary(shared) -> _Vocabulary:
    found = getattr(_vocabulary, "found", None)
    if found is None or found[0] != shared.id:
        _vocabulary.found = found = (shared.id, _Vocabulary(*shared.value))
    return found[1]


class _Broadcast:
    """A broadcast with an identity that survives pickling, so that a worker builds its tables once."""

    def __init__(self, spark, value):
        self.held, self.id = spark.sparkContext.broadcast(value), zlib.crc32(repr(id(value)).encode() + value[0])

    @property
    def value(self):
        return self.held.value


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few texts, where a kernel makes Python objects of all words of a batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            yield batch.slice(at, TEXTS)


def _encoder(shared, end: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Codes: place of a word of the dictionary, ``end`` for the end, ``end`` + 1 + its place in ``rare`` for any other word."""
        vocabulary = _vocabulary(shared)
        place = vocabulary.place
        logs = np.log10(vocabulary.counts + ADDED)
        for batch in _slices(batches):
            out: list[list] = [[] for _ in range(6)]
            for text in batch.column("text"):
                words = words_of(text.as_py())
                rare: dict[bytes, int] = {}
                codes = np.array([place[w] if w in place else end + 1 + rare.setdefault(w, len(rare)) for w in words] + [end], np.int64)
                there = codes[codes < end]
                n = np.bincount(codes[codes > end] - end - 1, minlength=len(rare))
                for column, value in zip(out, (len(words) + 1, len(there), float(logs[there].sum()), codes.astype("<u4").tobytes(), list(rare), n), strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "row", "held_out")), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["doc_id", "row", "held_out", "n_tokens", "known", "logs", "codes", "rare", "rare_n"])

    return kernel


ENCODED = "row long, held_out boolean, n_tokens long, known long, logs double, codes binary, rare array<binary>, rare_n array<long>"


def _classes_of(codes: np.ndarray, class_of: np.ndarray) -> np.ndarray:
    """Classes of codes; words beyond the dictionary have -1, as have its words without a class. The last entry of ``class_of`` is the end's."""
    return np.where(codes < len(class_of), class_of[np.minimum(codes, len(class_of) - 1)], -1)


def _salt(salts: int) -> int:
    """Which of the partial sums of a block this task adds to."""
    return TaskContext.get().partitionId() % salts


def _salts(spark) -> int:
    """Partial sums of a block: about as many as each of them, and their sum, has parts when tasks are as many as partitions."""
    return max(1, math.isqrt(int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _added(blocks: DataFrame, add, schema: str, then=None, then_schema: str | None = None) -> DataFrame:
    """Sums of the blocks with the same number by ``add``, in two steps, so that no task reads a block of every other task.

    ``then`` is a kernel over the sums. It runs in the same Python process: two kernels in a row would keep two processes for each core, all
    of which grow, as any of them may serve any later task.
    """
    n = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    partial = blocks.repartition(n, "block", "salt").sortWithinPartitions("block", "salt").mapInArrow(add, schema)
    last = (lambda batches: then(add(batches))) if then else add
    return partial.withColumn("salt", F.lit(0)).repartition(n, "block").sortWithinPartitions("block").mapInArrow(last, then_schema or schema)


def _matrix_blocks(height: int, width: int, kind: str, keys, salts: int):
    """A kernel that counts ``keys`` (row * width + column) of each sequence and gives on blocks of rows, of which only what isn't 0: few of a matrix's cells in a small task."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(height * width, np.int64)
        waiting, size = [], 0

        def add() -> None:
            nonlocal total
            if waiting:
                total += np.bincount(np.concatenate(waiting), minlength=height * width)
                waiting.clear()

        for batch in batches:
            for value in batch.column(0):
                waiting.append(keys(np.frombuffer(value.as_py(), kind).astype(np.int64)))
                size += len(waiting[-1])
                if size > TOGETHER:
                    add()
                    size = 0
        add()
        there = np.flatnonzero(total)
        yield _blocks(there, total[there], BLOCK_ROWS * width, _salt(salts))

    return kernel


def _matrix(sequences: DataFrame, height: int, width: int, kind: str, keys) -> np.ndarray:
    """The count matrix over all ``sequences`` (one binary column); its size is set by the parameters, not by the corpus."""
    schema, size = "block long, salt int, cells binary, n binary", BLOCK_ROWS * width
    blocks = sequences.mapInArrow(_matrix_blocks(height, width, kind, keys, _salts(sequences.sparkSession)), schema)
    out = np.zeros(-(-height // BLOCK_ROWS) * size, np.int64)
    for r in _added(blocks, _sparse_sums(size), schema).collect():
        _added_to(out[r["block"] * size : (r["block"] + 1) * size], r["cells"], r["n"])
    return out.reshape(-1, width)[:height]


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange_classes(bigrams: np.ndarray, classes: int = CLASSES, rounds: int = EXCHANGE_ROUNDS) -> np.ndarray:
    """A class for each word: words move to the class that raises the likelihood of the class bigrams most, until none moves."""
    n = len(bigrams)
    k = max(1, min(classes, n))
    of = np.arange(n) % k
    if n <= 1:
        return of
    member = np.eye(k, dtype=np.int64)[of]
    pairs = member.T @ bigrams @ member
    for _ in range(rounds):
        moved = 0
        for w in range(n):
            own, a = bigrams[w, w], of[w]
            before = np.bincount(of, bigrams[:, w], k).astype(np.int64)
            after = np.bincount(of, bigrams[w], k).astype(np.int64)
            before[a] -= own
            after[a] -= own
            pairs[:, a] -= before
            pairs[a] -= after
            pairs[a, a] -= own
            column = (_xlogx(pairs + before[:, None]) - _xlogx(pairs)).sum(0)
            row = (_xlogx(pairs + after[None, :]) - _xlogx(pairs)).sum(1)
            d = np.diag(pairs)
            both = _xlogx(d + before + after + own) - _xlogx(d + before) - _xlogx(d + after) + _xlogx(d)
            into, out = pairs.sum(0), pairs.sum(1)
            single = _xlogx(into + before.sum() + own) - _xlogx(into) + _xlogx(out + after.sum() + own) - _xlogx(out)
            b = int(np.argmax(column + row + both - single))
            pairs[:, b] += before
            pairs[b] += after
            pairs[b, b] += own
            moved += b != a
            of[w] = b
        if not moved:
            break
    return of


class Preference:
    """How much better each class fits a word with the given numbers of neighbours, in log likelihood, while class counts are held.

    Moving a word changes the likelihood of the class bigrams, to first order, by the sum over its left neighbours of log p(class | theirs) and over
    its right neighbours of log p(theirs | class), both relative to how frequent the classes are.
    """

    def __init__(self, pairs: np.ndarray):
        pairs = pairs + ADDED_PAIRS
        self.k = len(pairs) - 1  # the last class is the end's, which no word moves to
        self.common = int(np.argmax(pairs.sum(0)[: self.k]))
        into = np.log(pairs / pairs.sum(0, keepdims=True))[:, : self.k]
        onto = np.log(pairs / pairs.sum(1, keepdims=True))[: self.k]
        self.gain = np.concatenate([into, onto.T])

    def best(self, contexts: np.ndarray, default: np.ndarray) -> np.ndarray:
        """The best class for each row of counts (left classes, then right classes); ``default`` where there is no neighbour. Ties go to the lower class."""
        return np.where(contexts.any(1), np.argmax(np.round(contexts @ self.gain, 6), 1), default)


def _slots(codes: np.ndarray, class_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token the class of its left and of its right neighbour, -1 if it has none; before the first token is an end."""
    c = _classes_of(codes, class_of)
    return np.append(class_of[-1], c[:-1]), np.append(c[1:], -1)


def _sparse(block: np.ndarray, salt: int, cells: list[np.ndarray], n: list[np.ndarray]) -> pa.RecordBatch:
    # Counts take four bytes as long as they fit.
    columns = (block, [salt] * len(block), [c.astype("<u4").tobytes() for c in cells], [c.astype("<u4" if c.max() >> 32 == 0 else "<i8").tobytes() for c in n])
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["block", "salt", "cells", "n"])


def _blocks(keys: np.ndarray, n: np.ndarray, size: int, salt: int) -> pa.RecordBatch:
    """Counts ``n`` of the sorted ``keys`` in blocks of ``size`` places."""
    blocks = np.unique(keys // size).astype(np.int64)
    cuts = np.searchsorted(keys, np.append(blocks, blocks[-1:] + 1) * size)
    parts = [slice(a, z) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
    return _sparse(blocks, salt, [keys[p] % size for p in parts], [n[p] for p in parts])


def _added_to(total: np.ndarray, cells: bytes, n: bytes) -> None:
    total[np.frombuffer(cells, "<u4")] += np.frombuffer(n, "<u4" if len(n) == len(cells) else "<i8")


def _contexts(class_of: np.ndarray, width: int, salts: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of (word of the dictionary, class beside it) in blocks of words: ``cells`` holds the places in the block, ``n`` the counts."""
        waiting, size, words = [], 0, len(class_of) - 1
        kind = np.uint32 if words * width < 1 << 32 else np.int64

        def out() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(waiting), return_counts=True)
            return _blocks(keys, n, BLOCK_WORDS * width, _salt(salts))

        for batch in batches:
            for value in batch.column(0):
                codes = np.frombuffer(value.as_py(), "<u4").astype(np.int64)
                left, right = _slots(codes, class_of)
                known = codes < words
                for side, slot in enumerate((left, right)):
                    there = known & (slot >= 0)
                    waiting.append((codes[there] * width + slot[there] + side * (width // 2)).astype(kind))
                size += len(codes)
                if size > TOGETHER:
                    yield out()
                    waiting, size = [], 0
        if waiting:
            yield out()

    return kernel


def _sparse_sums(size: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of the blocks with the same number and salt; rows come sorted by them."""
        key, total = None, None

        def out() -> pa.RecordBatch:
            there = np.flatnonzero(total)
            return _sparse(np.array([key[0]]), key[1], [there], [total[there]])

        for batch in batches:
            for block, salt, cells, n in zip(batch.column("block").to_pylist(), batch.column("salt").to_pylist(), batch.column("cells"), batch.column("n"), strict=True):
                if (block, salt) != key:
                    if key is not None:
                        yield out()
                    key, total = (block, salt), np.zeros(size, np.int64)
                _added_to(total, cells.as_py(), n.as_py())
        if key is not None:
            yield out()

    return kernel


def _moved(prefers: Preference, default: np.ndarray, width: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The new classes of the words of each block, of which there is one row."""
        for batch in batches:
            classes = []
            for block, cells, n in zip(*(batch.column(c).to_pylist() for c in ("block", "cells", "n")), strict=True):
                own = default[block * BLOCK_WORDS : (block + 1) * BLOCK_WORDS]
                total = np.zeros(BLOCK_WORDS * width, np.int64)
                _added_to(total, cells, n)
                classes.append(prefers.best(total.reshape(-1, width)[: len(own)], own).astype("u1").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(classes, pa.binary())], ["block", "classes"])

    return kernel


def _moves(learnt: DataFrame, class_of: np.ndarray, prefers: Preference, default: np.ndarray) -> DataFrame:
    """(block, classes): the classes that the words of each block move to."""
    width = 2 * (CLASSES + 1)
    schema = "block long, salt int, cells binary, n binary"
    contexts = learnt.select("codes").mapInArrow(_contexts(class_of, width, _salts(learnt.sparkSession)), schema)
    return _added(contexts, _sparse_sums(BLOCK_WORDS * width), schema, _moved(prefers, default, width), "block long, classes binary")


def _exchanged(learnt: DataFrame, class_of: np.ndarray) -> np.ndarray:
    """``class_of`` after one distributed round: all words move at once, by class counts as they were. A byte a word reaches the driver."""
    k, words = CLASSES, len(class_of) - 1
    prefers = Preference(_pairs(learnt, class_of))
    default = np.where(class_of[:-1] < 0, np.arange(words) % k, class_of[:-1])
    out = np.append(default, k)
    for r in _moves(learnt, class_of, prefers, default).collect():
        at = r["block"] * BLOCK_WORDS
        out[at : at + len(r["classes"])] = np.frombuffer(r["classes"], "u1")
    return out


def _pairs(learnt: DataFrame, class_of: np.ndarray) -> np.ndarray:
    """How often a class follows another one, over neighbours that both have a class."""
    width = CLASSES + 1

    def keys(codes: np.ndarray) -> np.ndarray:
        c = _classes_of(codes, class_of)
        before = np.append(class_of[-1], c[:-1])
        there = (c >= 0) & (before >= 0)
        return before[there] * width + c[there]

    return _matrix(learnt.select("codes"), width, width, "<u4", keys)


def _tail_contexts(class_of: np.ndarray):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(word, n, slots) for each word beyond the dictionary in each text: left neighbours' classes, and right ones' plus the number of classes."""
        end, width = len(class_of) - 1, CLASSES + 1
        for batch in _slices(batches):
            words, counts, slots, lengths = [], [], [], []
            for codes, rare, n in zip(batch.column("codes"), batch.column("rare"), batch.column("rare_n"), strict=True):
                if not len(rare):
                    continue
                codes = np.frombuffer(codes.as_py(), "<u4").astype(np.int64)
                left, right = _slots(codes, class_of)
                at = np.flatnonzero(codes > end)
                word, slot = np.tile(codes[at] - end - 1, 2), np.concatenate([left[at], np.where(right[at] < 0, -1, right[at] + width)])
                there = np.flatnonzero(slot >= 0)
                there = there[np.argsort(word[there], kind="stable")]
                words += rare.as_py()
                counts += n.as_py()
                slots.append(slot[there].astype("u1"))
                lengths.append(np.bincount(word[there], minlength=len(rare)))
            if words:
                offsets = np.append(0, np.cumsum(np.concatenate(lengths))).astype("<i4")
                binary = pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.concatenate(slots).tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(counts, pa.int64()), binary], ["word", "n", "slots"])

    return kernel


def _tail_classes(prefers: Preference):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(word, c, k) of the words beyond the dictionary; rows of a word come one after another, and its counts go on into the next batch."""
        width = 2 * (CLASSES + 1)
        word, count, total = None, 0, np.zeros(width, np.int64)

        def out(words: list, counts: np.ndarray, totals: np.ndarray) -> pa.RecordBatch:
            best = prefers.best(totals, np.full(len(words), prefers.common))
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(counts, pa.int64()), pa.array(best.astype(np.int32))], ["word", "c", "k"])

        for batch in batches:
            if not len(batch):
                continue
            coded = pc.dictionary_encode(batch.column("word"))
            of, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()  # in order of appearance
            column = batch.column("slots")
            offsets = np.frombuffer(column.buffers()[1], "<i4", len(column) + 1, 4 * column.offset)
            slots = np.frombuffer(column.buffers()[2] or b"", "u1")[offsets[0] : offsets[-1]]
            flat = np.repeat(of.astype(np.int64), np.diff(offsets)) * width + slots
            totals = np.bincount(flat, minlength=len(words) * width).reshape(-1, width)
            counts = np.bincount(of, batch.column("n").to_numpy(), len(words)).astype(np.int64)
            if word == words[0]:
                totals[0] += total
                counts[0] += count
            elif word is not None:
                yield out([word], np.array([count]), total[None])
            word, count, total = words[-1], counts[-1], totals[-1]
            if len(words) > 1:
                yield out(words[:-1], counts[:-1], totals[:-1])
        if word is not None:
            yield out([word], np.array([count]), total[None])

    return kernel


def _classed(class_of: np.ndarray):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A class byte for each token, HOLE for words beyond the dictionary, whose places in ``rare`` follow in order in ``holes``."""
        end = len(class_of) - 1
        for batch in batches:
            classes, holes = [], []
            for value in batch.column("codes"):
                codes = np.frombuffer(value.as_py(), "<u4").astype(np.int64)
                classes.append(np.where(codes > end, HOLE, class_of[np.minimum(codes, end)]).astype("u1").tobytes())
                holes.append((codes[codes > end] - end - 1).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(classes, pa.binary()), pa.array(holes, pa.binary())], [*batch.schema.names[:-1], "classes", "holes"])

    return kernel


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The class bytes with the holes filled from ``found``, the classes of the document's rare words in their order."""
    for batch in batches:
        out = []
        for classes, holes, found in zip(batch.column("classes"), batch.column("holes"), batch.column("found"), strict=True):
            c = np.frombuffer(classes.as_py(), "u1")
            if len(found):
                c = c.copy()
                c[c == HOLE] = np.array(found.as_py(), np.uint8)[np.frombuffer(holes.as_py(), "<u4")]
            out.append(c.tobytes())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(out, pa.binary())], [*batch.schema.names[:-3], "classes"])


class ClassModel:
    """Transitions between classes and what emissions are divided by; the counts of words are the numerators.

    ``steps[a, b]`` counts class b after class a, ``inside`` the distinct words of a class. A class keeps room for one word more, the
    unknown one; an unknown word takes the class in which it is likeliest.
    """

    def __init__(self, steps: np.ndarray, inside: np.ndarray):
        size = steps.sum(0)
        own = (size + ADDED) / (size.sum() + ADDED * len(size))
        self.transition = np.log10((steps + PRIOR * own[None, :]) / (steps.sum(1, keepdims=True) + PRIOR))
        self.emission = np.log10(size + ADDED * (inside + 1))
        self.unknown = int(np.argmax(np.round(np.log10(own) - self.emission, 9)[:-1]))

    def order_part(self, classes: np.ndarray) -> float:
        """Log10 of the transitions, less the log10 of the emissions' denominators."""
        c = np.where(classes == UNKNOWN, self.unknown, classes)
        return float(self.transition[np.append(len(self.transition) - 1, c[:-1]), c].sum() - self.emission[c].sum())


def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows that are not held out, scores all. A null text is empty: one token, its end. A null id counts as the empty
    text and is held out. Repeated rows are learnt and scored like others; ids keep their type. Without training rows every word is unknown; an empty
    table gives no rows. Words beyond the dictionary, of any number, are counted, classed and looked up by joins on the word; only tables bounded
    by the parameters reach the driver. Only the two named columns are read, so others may have any name. Tables in between are written in few files,
    however many parts a small input comes in.
    """
    spark = docs.sparkSession
    files = writers(docs)
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), is_held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    counts = stored(rows.where(~F.col("held_out")).select("text").mapInArrow(_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c")).coalesce(files))
    n_tokens, n_distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()

    # The dictionary: all words from a count on, so that at most DICTIONARY of them are broadcast. 16 steps of counts per factor 2.
    step = F.floor(F.log2("c") * 16)
    n, least = 0, 0
    for r in sorted(counts.groupBy(step.alias("s")).agg(F.count("*").alias("n"), F.min("c").alias("c")).collect(), key=lambda r: -r["s"]):
        if n + r["n"] > DICTIONARY:
            break
        n, least = n + r["n"], r["c"]
    frequent = counts.where((F.col("c") >= least) & F.lit(bool(least)))
    top = sorted(((bytes(r["word"]), r["c"]) for r in frequent.collect()), key=lambda x: (-x[1], x[0]))
    end_count = next((c for w, c in top if w == END), 0) or (counts.where(F.col("word") == F.lit(b"")).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])
    top = [x for x in top if x[0] != END]
    shared = _Broadcast(spark, (b"\n".join(w for w, _ in top), np.array([c for _, c in top], np.int64).tobytes()))
    coded = stored(rows.coalesce(files).mapInArrow(_encoder(shared, len(top)), f"doc_id {id_type}, {ENCODED}"))
    learnt = coded.where(~F.col("held_out"))

    # Classes: exchange of the most frequent words one by one, of the whole dictionary at once, of all other words by their neighbours.
    core = min(len(top), EXCHANGE_WORDS)

    def bigram_keys(codes: np.ndarray) -> np.ndarray:
        a, b = codes[:-1], codes[1:]
        both = (a < core) & (b < core)
        return a[both] * core + b[both]

    class_of = np.full(len(top) + 1, -1)
    class_of[-1] = CLASSES
    if core:
        class_of[:core] = exchange_classes(_matrix(learnt.select("codes"), core, core, "<u4", bigram_keys), CLASSES)
        for _ in range(SHARED_ROUNDS):
            class_of = _exchanged(learnt, class_of)
    prefers = Preference(_pairs(learnt, class_of))
    contexts = learnt.select("codes", "rare", "rare_n").mapInArrow(_tail_contexts(class_of), "word binary, n long, slots binary")
    tail = stored(contexts.repartition(n_parts, "word").sortWithinPartitions("word").coalesce(files).mapInArrow(_tail_classes(prefers), "word binary, c long, k int"))
    inside = np.bincount(class_of, minlength=CLASSES + 1)
    for r in tail.groupBy("k").count().collect():
        inside[r["k"]] += r["count"]

    # Each document's rare words with their counts and classes; they meet by word, and come back together by document.
    rare = coded.select("row", F.posexplode(F.arrays_zip("rare", "rare_n")).alias("at", "r")).select("row", "at", F.col("r.rare").alias("word"), F.col("r.rare_n").alias("n"))
    c = F.coalesce("c", F.lit(0))
    found = F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("k", F.lit(UNKNOWN)).alias("k")))), lambda x: x["k"])
    rare = rare.join(tail, "word", "left").groupBy("row").agg(F.sum(F.col("n") * F.log10(c + ADDED)).alias("rare_logs"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("rare_known"), found.alias("found"))
    columns = ["doc_id", "row", "held_out", "n_tokens", "known", "logs"]
    kinds = f"doc_id {id_type}, row long, held_out boolean, n_tokens long, known long, logs double"
    classed = coded.select(*columns, "codes").mapInArrow(_classed(class_of), f"{kinds}, classes binary, holes binary")
    whole = classed.join(rare, "row", "left").select("doc_id", "row", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("known"), (F.col("logs") + F.coalesce("rare_logs", F.lit(0.0))).alias("logs"), "classes", "holes", F.coalesce("found", F.array().cast("array<int>")).alias("found"))
    filled = stored(whole.coalesce(files).mapInArrow(_filled, f"{kinds}, classes binary"))
    width = CLASSES + 1
    model = ClassModel(_matrix(filled.where(~F.col("held_out")).select("classes"), width, width, "u1", lambda c: np.append(width - 1, c[:-1]) * width + c), inside)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = [model.order_part(np.frombuffer(v.as_py(), "u1").astype(np.int64)) for v in batch.column("classes")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(part, pa.float64())], [*batch.schema.names[:-1], "part"])

    logs = F.col("logs") + math.log10(end_count + ADDED)
    return filled.mapInArrow(scored, f"{kinds}, part double").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + int(end_count > 0)).cast("long").alias("n_known"),
        F.lit(n_tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * math.log10(n_tokens + ADDED * (n_distinct + 1))).alias("base_score"),
        (logs + F.col("part")).alias("score"),
    )
