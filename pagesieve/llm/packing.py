"""Packing documents into windows by lexical retrieval.

Documents become token ids once. Document frequencies and lengths over all documents give the BM25 weights. Documents are
dealt by their heaviest terms, so that lexical neighbours meet, and each partition is cut into shards with an inverted
index of their own. A seed document opens a window; the index returns unused neighbours in the order of their BM25
score over all terms of the seed, which greedily fill it; the last one is cut where the window ends and its rest stays in the index.
Neighbours in other shards are not returned. When none with a common term is left, the unused documents of the shard follow in their order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .tokens import TOKENIZER, IdEncoder, load

WINDOW, END_ID = 1024, 0
K1, B = 1.2, 0.75
#: Neighbours that are asked for at once; if none of them fits into a window whole, the nearest is cut.
NEIGHBOURS = 24
#: One shard of the index ends at so many documents or ids.
SHARD_DOCS, SHARD_IDS = 2048, 1 << 21
#: Documents of one heaviest term that are dealt to the same place; a term that more documents have gets as many places as they ask for.
#: The heaviest term is found with weights raised by this power of the number of documents that have the term: the rarest of all brings next to none together.
PLACE_DOCS, DEALT_BY = 512, 0.2


def encoded(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, row, ids): ids of each document with the end id, as unsigned little-endian 16- or 32-bit integers."""
    width = id_width(tokenizer)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = IdEncoder(tokenizer, width)
        end = END_ID.to_bytes(width, "little")
        for batch in batches:
            ids = pa.array([encode(t.as_py() or "") + end for t in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), ids], ["doc_id", "row", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(kernel, f"doc_id {docs.schema[id_col].dataType.simpleString()}, row long, ids binary")


def id_width(tokenizer: str) -> int:
    return 2 if load(tokenizer).get_vocab_size() <= 1 << 16 else 4


def _frequencies(width: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, ids = np.zeros(0, np.int64), 0, 0
        for batch in batches:
            for value in batch.column("ids"):
                own = np.unique(np.frombuffer(value.as_py(), f"<u{width}"))
                if own[-1] >= len(df):
                    df = np.concatenate([df, np.zeros(int(own[-1]) + 1 - len(df), np.int64)])
                df[own] += 1
                docs, ids = docs + 1, ids + len(value.as_py()) // width
        there = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"id": pa.array(np.concatenate([there, [-1, -2]])), "n": pa.array(np.concatenate([df[there], [docs, ids]]))})

    return kernel


def term_weights(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(idf of each id, documents that hold it, average length) over all documents. The tables are bounded by the vocabulary."""
    found = rows.select("ids").mapInArrow(_frequencies(width), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    n = {r["id"]: r["n"] for r in found}
    docs = max(1, n.pop(-1, 0))
    mean = max(1.0, n.pop(-2, 0) / docs)
    df = np.zeros(max(n, default=0) + 1)
    df[list(n)] = list(n.values())
    return np.log(1 + (docs - df + 0.5) / (df + 0.5)), df, mean


class ShardIndex:
    """The BM25 inverted index of one shard, over the documents ``docs`` that are still unused."""

    def __init__(self, terms: list[np.ndarray], weights: list[np.ndarray]):
        self.docs = np.arange(len(terms))
        owner = np.repeat(self.docs, [len(t) for t in terms])
        flat = np.concatenate(terms)
        order = np.argsort(flat, kind="stable")
        self.owner, self.weight = owner[order], np.concatenate(weights)[order]
        self.known, start = np.unique(flat[order], return_index=True)
        self.ends = np.append(start, len(flat))

    def scores(self, query: np.ndarray) -> np.ndarray:
        """For each of ``docs`` the sum of its weights of the ``query`` terms."""
        at = np.searchsorted(self.known, query)
        parts = [slice(a, z) for a, z in zip(self.ends[at].tolist(), self.ends[at + 1].tolist(), strict=True)]
        return np.bincount(np.concatenate([self.owner[p] for p in parts]), np.concatenate([self.weight[p] for p in parts]), len(self.docs))

    def keep(self, unused: np.ndarray) -> None:
        """Takes the postings of used documents out."""
        here = unused[self.docs]
        posted = here[self.owner]
        self.ends = np.append(0, np.cumsum(posted))[self.ends]
        self.owner, self.weight, self.docs = (np.cumsum(here) - 1)[self.owner[posted]], self.weight[posted], self.docs[here]


def pack_shard(lengths: np.ndarray, terms: list[np.ndarray], weights: list[np.ndarray], window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of one shard, each a list of pieces (document, start, length) that covers all ids once.

    All sequences have ``window`` ids but for the last ids of the shard, which make sequences of powers of two: nothing is padded.
    """
    sequences = [[(d, at, window)] for d, n in enumerate(lengths) for at in range(0, n - window + 1, window)]
    start = lengths // window * window
    rest = lengths - start
    index = ShardIndex(terms, weights)
    unused = rest > 0
    index.keep(unused)
    last: list[tuple[int, int, int]] = []
    for seed in range(len(rest)):
        if not unused[seed]:
            continue
        pieces, room = [(seed, int(start[seed]), int(rest[seed]))], window - int(rest[seed])
        unused[seed] = False
        if 8 * np.count_nonzero(unused) < 7 * len(index.docs):
            index.keep(unused)
        score = index.scores(terms[seed])
        while room:
            here = np.flatnonzero(unused[index.docs])
            if not len(here):
                break
            free, near = index.docs[here], score[here]
            if len(free) > NEIGHBOURS:
                top = np.argpartition(-near, NEIGHBOURS - 1)
                top = np.flatnonzero(near >= near[top[NEIGHBOURS - 1]])  # all ties, of which the first documents count
                free, near = free[top], near[top]
            order = np.lexsort((free, -near))[:NEIGHBOURS]
            free = free[order]
            for d in free:
                if rest[d] <= room:
                    pieces.append((int(d), int(start[d]), int(rest[d])))
                    room -= int(rest[d])
                    unused[d] = False
            if room and not unused[free].all():
                continue
            if room:  # none of the nearest fits whole
                d = free[0]
                pieces.append((int(d), int(start[d]), room))
                start[d], rest[d], room = start[d] + room, rest[d] - room, 0
        if room:
            last += pieces
        else:
            sequences.append(pieces)
    return sequences + _powers_of_two(last)


def _powers_of_two(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    total = sum(n for _, _, n in pieces)
    out: list[list[tuple[int, int, int]]] = []
    queue = pieces[::-1]
    for bit in reversed(range(total.bit_length())):
        if total >> bit & 1:
            sequence, room = [], 1 << bit
            while room:
                d, at, n = queue.pop()
                take = min(n, room)
                sequence.append((d, at, take))
                if n > take:
                    queue.append((d, at + take, n - take))
                room -= take
            out.append(sequence)
    return out


def _weighted(ids: np.ndarray, idf: np.ndarray, mean: float) -> tuple[np.ndarray, np.ndarray]:
    terms, tf = np.unique(ids, return_counts=True)
    return terms, idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids) / mean))


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids on request).

    A null text is an empty document of the end id alone. Each id of a document lies in exactly one piece; long documents fill whole
    windows first. Repeated rows and null ids are packed like others; ids of documents keep their type; an empty table gives no rows. Token ids are written once to the shared
    folder, and a group of copies, or of documents about one term, of any size is dealt over the partitions. Only the two named columns are read, so others may have any name.
    """
    width = id_width(tokenizer)
    rows = stored(encoded(docs, id_col=id_col, text_col=text_col, tokenizer=tokenizer))
    idf, df, mean = term_weights(rows, width)
    spark = docs.sparkSession
    # A term that one document has can't bring it together with another one.
    shared = spark.sparkContext.broadcast((idf, np.where(df > 1, idf * df**DEALT_BY, 0.0), -(-df // PLACE_DOCS), mean))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, common, places, mean = shared.value
        for batch in batches:
            first, second, place = [], [], []
            for value, row in zip(batch.column("ids"), batch.column("row").to_pylist(), strict=True):
                terms, weights = _weighted(np.frombuffer(value.as_py(), f"<u{width}"), common, mean)
                one = int(np.argmax(weights))
                first.append(int(terms[one]))
                weights[one] = -1
                second.append(int(terms[np.argmax(weights)]))
                place.append((row * 0x9E3779B97F4A7C15 >> 20 & 0xFFFFFF) % int(places[first[-1]]))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int32()) for c in (first, second, place))], [*batch.schema.names, "first", "second", "place"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, _, _, mean = shared.value
        sequence = TaskContext.get().partitionId() << 40
        held: list[tuple] = []
        size = 0

        def shard() -> pa.RecordBatch:
            nonlocal sequence
            ids = [h[1] for h in held]
            both = [_weighted(i, idf, mean) for i in ids]
            columns: list[list] = [[] for _ in range(8)]
            for pieces in pack_shard(np.array([len(i) for i in ids]), [t for t, _ in both], [w for _, w in both], window):
                offset = 0
                for d, at, length in pieces:
                    own = ids[d][at : at + length].astype("<u4").tobytes()
                    for column, value in zip(columns, (held[d][0], at, length, zlib.crc32(own), len(ids[d]), sequence, offset, own if with_ids else None), strict=True):
                        column.append(value)
                    offset += length
                sequence += 1
            kinds = [id_kind, *[pa.int64()] * 6, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)][: 7 + with_ids], names)

        for batch in batches:
            id_kind = batch.schema.field("doc_id").type
            for doc_id, value in zip(batch.column("doc_id"), batch.column("ids"), strict=True):
                ids = np.frombuffer(value.as_py(), f"<u{width}")
                held.append((doc_id.as_py(), ids))
                size += len(ids)
                if len(held) >= SHARD_DOCS or size >= SHARD_IDS:
                    yield shard()
                    held, size = [], 0
        if held:
            yield shard()

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: 7 + with_ids]
    id_type = docs.schema[id_col].dataType.simpleString()
    dealt = rows.mapInArrow(keyed, f"doc_id {id_type}, row long, ids binary, first int, second int, place int").repartition(n, "first", "place").sortWithinPartitions("first", "second", "row")
    kinds = {"doc_id": id_type, "ids": "binary"}
    return dealt.select("doc_id", "ids").mapInArrow(packed, ", ".join(f"{c} {kinds.get(c, 'long')}" for c in names))
