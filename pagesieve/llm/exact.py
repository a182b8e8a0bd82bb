"""Exact dedup through a cuckoo-filter index.

Each task feeds the digests of its rows to an index: the filter says whether a digest may be live, a hit is verified
against the entry stored in the bucket, and a fuller index is rebuilt from its stored keys. That pre-aggregates a group of copies
inside every task; the partial groups then meet by digest bucket and go through the same index once more.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_groups

#: Live digests that one index may hold before it gives its groups on; digests of one bucket on average.
LIVE_LIMIT, BUCKET_ROWS = 200_000, 20_000


class CuckooIndex:
    """Live digests with a payload, behind a cuckoo filter of 16-bit tags in buckets of four.

    ``get``, ``insert`` and ``delete`` look into the two buckets of a digest only. A tag that
    matches is verified against the whole digest stored with it. When an insertion finds no room in ``max_kicks``
    moves, the table doubles and is filled again from the stored digests.
    """

    SLOTS = 4

    def __init__(self, buckets: int = 1024, max_kicks: int = 64):
        self.mask, self.max_kicks, self.size, self.resizes = buckets - 1, max_kicks, 0, 0
        if buckets & self.mask:
            raise ValueError("the number of buckets must be a power of two")
        self.tags = [[0] * self.SLOTS for _ in range(buckets)]
        self.content: list[list] = [[None] * self.SLOTS for _ in range(buckets)]

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        tag = int.from_bytes(digest[:2], "little") or 1
        one = int.from_bytes(digest[2:10], "little") & self.mask
        return tag, one, self._other(one, tag)

    def _other(self, bucket: int, tag: int) -> int:
        return (bucket ^ (tag * 0x5BD1E995)) & self.mask

    def _find(self, digest: bytes) -> tuple[int, int] | None:
        tag, one, two = self._places(digest)
        for bucket in (one, two):
            for slot, there in enumerate(self.tags[bucket]):
                if there == tag and self.content[bucket][slot][0] == digest:
                    return bucket, slot
        return None

    def may_contain(self, digest: bytes) -> bool:
        """What the filter alone says: never False for a live digest."""
        tag, one, two = self._places(digest)
        return tag in self.tags[one] or tag in self.tags[two]

    def get(self, digest: bytes):
        found = self._find(digest)
        return self.content[found[0]][found[1]][1] if found else None

    def insert(self, digest: bytes, payload) -> None:
        """Adds a digest that isn't live."""
        self.size += 1
        tag, one, two = self._places(digest)
        entry = (digest, payload)
        for bucket in (one, two):
            if 0 in self.tags[bucket]:
                self._put(bucket, self.tags[bucket].index(0), tag, entry)
                return
        bucket = one
        for kick in range(self.max_kicks):
            slot = kick % self.SLOTS
            (tag, entry), there = (self.tags[bucket][slot], self.content[bucket][slot]), (tag, entry)
            self._put(bucket, slot, *there)
            bucket = self._other(bucket, tag)
            if 0 in self.tags[bucket]:
                self._put(bucket, self.tags[bucket].index(0), tag, entry)
                return
        self._resize(entry)

    def delete(self, digest: bytes) -> bool:
        found = self._find(digest)
        if found:
            self._put(*found, 0, None)
            self.size -= 1
        return bool(found)

    def items(self) -> Iterator[tuple]:
        return (entry for bucket in self.content for entry in bucket if entry)

    def _put(self, bucket: int, slot: int, tag: int, entry) -> None:
        self.tags[bucket][slot], self.content[bucket][slot] = tag, entry

    def _resize(self, pending) -> None:
        entries, resizes = [*self.items(), pending], self.resizes
        self.__init__(2 * (self.mask + 1), self.max_kicks)
        self.resizes = resizes + 1
        for digest, payload in entries:
            self.insert(digest, payload)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of equal digests. Rows of one bucket follow each other; an index lives as long as its bucket and its room."""
    kind = None

    def out(index: CuckooIndex, bucket: int) -> pa.RecordBatch:
        rows = [(d, *p) for d, p in index.items()]
        return pa.RecordBatch.from_pydict(
            {
                "digest": pa.array([r[0] for r in rows], pa.binary()),
                "keep_id": pa.array([r[1] for r in rows], kind),
                "keep_row": pa.array([r[2] for r in rows], pa.int64()),
                "group_size": pa.array([r[3] for r in rows], pa.int64()),
                "bucket": pa.array([bucket] * len(rows), pa.int64()),
            }
        )

    index, current = CuckooIndex(), None
    for batch in batches:
        kind = batch.schema.field("keep_id").type
        for digest, doc_id, row, n, bucket in zip(*(batch.column(c).to_pylist() for c in ("digest", "keep_id", "keep_row", "group_size", "bucket")), strict=True):
            if index.size and (bucket != current or bucket is None and index.size >= LIVE_LIMIT):
                yield out(index, current)
                index = CuckooIndex()
            current = bucket
            old = index.get(digest) if index.may_contain(digest) else None
            if old is None:
                index.insert(digest, (doc_id, row, n))
                continue
            # The live entry is replaced: the largest id stays, nulls last, then the first row.
            best = (doc_id, row) if _stays(doc_id, row, *old[:2]) else old[:2]
            index.delete(digest)
            index.insert(digest, (*best, old[2] + n))
    if index.size:
        yield out(index, current)


def _stays(doc_id, row: int, other_id, other_row: int) -> bool:
    """Whether a row stays rather than the other one: a larger id, any id rather than none, then the earlier row."""
    if doc_id is None or other_id is None or doc_id == other_id:
        return row < other_row if doc_id == other_id else other_id is None
    return doc_id > other_id


def exact_groups(rows: DataFrame) -> DataFrame:
    """(digest, keep_id, keep_row, group_size), a row for each digest of ``rows`` (doc_id, row, digest)."""
    partial_type = f"digest binary, keep_id {rows.schema['doc_id'].dataType.simpleString()}, keep_row long, group_size long, bucket long"
    single = rows.select("digest", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("group_size"), F.lit(None).cast("long").alias("bucket"))
    partial = cut(single.mapInArrow(_grouped, partial_type))
    buckets = max(1, -(-partial.count() // BUCKET_ROWS))
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    # Buckets are ranges of the digest, at least a few for each partition.
    dealt = partial.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(max(buckets, 4 * n)).cast("long")))
    return dealt.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_grouped, partial_type).drop("bucket")


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; a null text counts as empty. Of equal texts the row with the largest id stays, null ids
    last; of rows that agree in id and text exactly one is kept. Ids keep their type, which may be any that can be ordered. An empty table gives no rows. Only the two named
    columns are read, so others may have any name; texts are read once, for their digest, and never shuffled.
    """
    sha = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.unhex(sha).alias("digest")))
    groups = cut(exact_groups(rows))
    return join_groups(rows, groups, ["digest"], "group_size").select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without exact copies, with the same columns; which row stays is told at :func:`exact_dedup`.

    A null text counts as empty, as there; of rows that agree in id and text one stays. Columns may have any names. An empty table gives no rows.
    """
    keep = exact_dedup(docs, id_col=id_col, text_col=text_col).where("kept").select(F.col("doc_id").alias("id"), F.xxhash64("doc_id").alias("id_hash"), F.unhex("text_sha256").alias("digest"))
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    whole = docs.select(F.struct(*docs.columns).alias("whole"), F.col(id_col).alias("own_id"), F.xxhash64(id_col).alias("id_hash"), digest.alias("digest"))
    found = whole.join(keep, ["digest", "id_hash"]).where(F.col("own_id").eqNullSafe(F.col("id")))
    # Rows with the same id and text, if any, lie in one partition already.
    return found.dropDuplicates(["digest", "id_hash"]).select("whole.*")
