"""Sharding by a Feistel permutation over global row numbers.

Rows get their number in the order of id, then CRC and size; the permutation of all numbers is a keyed Feistel network over the next
even power of two, walked along its cycle until it falls below the number of rows. The shuffled position tells shard and
slot by division, so either can be computed from a row number, and back, without any table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SHARDS, ROUNDS, SEED = 40, 6, 20240607
#: Bytes that a row costs besides its text.
ROW_BYTES = 16


def _half_bits(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _round(x: np.ndarray, k: int, seed: int, half: int) -> np.ndarray:
    """The round function: a 64-bit mix of one half, cut to ``half`` bits."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + (k + 1) * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) & np.uint64((1 << half) - 1)


def _network(x: np.ndarray, half: int, seed: int, backwards: bool) -> np.ndarray:
    left, right = x >> np.uint64(half), x & np.uint64((1 << half) - 1)
    for k in reversed(range(ROUNDS)) if backwards else range(ROUNDS):
        if backwards:
            left, right = right ^ _round(left, k, seed, half), left
        else:
            left, right = right, left ^ _round(right, k, seed, half)
    return (left << np.uint64(half)) | right


def permute(numbers, n: int, seed: int = SEED, *, backwards: bool = False) -> np.ndarray:
    """Positions of row ``numbers`` below ``n`` in the shuffled order, or with ``backwards`` the row numbers at positions."""
    x = np.asarray(numbers, np.uint64).copy()
    half = _half_bits(n)
    todo = np.arange(len(x))
    while len(todo):
        x[todo] = _network(x[todo], half, seed, backwards)
        todo = todo[x[todo] >= n]
    return x.astype(np.int64)


def locate(number: int, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[int, int]:
    """(shard, slot) of one row number."""
    at = int(permute([number], n, seed)[0])
    return at % shards, at // shards


def row_number_at(shard: int, slot: int, n: int, shards: int = SHARDS, seed: int = SEED) -> int:
    """The row number that lies in ``slot`` of ``shard``."""
    return int(permute([slot * shards + shard], n, seed, backwards=True)[0])


def numbered(rows: DataFrame, order: list, name: str = "row_number") -> DataFrame:
    """``rows`` with global numbers from 0 in ``order``: a range sort, counts of its partitions, and the place within each."""
    parted = cut(rows.orderBy(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    parts = parted.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.select("__part", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__offset"))
    # A row for each partition of the sort, so the broadcast is bounded.
    return parted.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__at") + F.col("__offset")).drop("__part", "__at", "__offset")


def assign_shards(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row for each document: doc_id, size, text_crc32, row_number, shard, slot.

    Counts of shards differ by one at most, and slots are gapless from 0. A null text has no bytes (size 16, CRC 0). Ids order
    the rows, nulls first; repeated ids go by CRC and size, and rows that agree in all of them are interchangeable. Fewer rows
    than shards leave shards empty; an empty table gives no rows. Texts are read once and never shuffled.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32")))
    n = rows.count()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = permute(batch.column("row_number").to_numpy(), n, seed)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((at % shards).astype(np.int32)), pa.array(at // shards)], [*batch.schema.names, "shard", "slot"])

    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, size long, text_crc32 long, row_number long, shard int, slot long"
    return numbered(rows, ["doc_id", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", "row_number").mapInArrow(kernel, schema)


def write_shards(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = SEED) -> None:
    """Writes ``docs`` under ``path``/shard=N, each shard sorted by slot, with the column slot added. Ids must be unique."""
    places = assign_shards(docs, id_col=id_col, text_col=text_col, shards=shards, seed=seed).select(F.col("doc_id").alias("__id"), "shard", "slot")
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    found = docs.select(*kept).join(places, F.col(id_col).eqNullSafe(F.col("__id"))).drop("__id")
    found.repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
