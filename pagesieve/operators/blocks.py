"""Blocks of extracted pages as rows: repeated segments, copies of documents, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import trimmed
from .lineage import cut

#: Texts of more characters than this may be dropped as repeats; occurrences that stay are one more than the repetitions.
MIN_SIZE, MAX_REPETITIONS, MIN_ADJACENT = 100, 2, 50


def explode_blocks(extracted: DataFrame, *keys: str) -> DataFrame:
    """(keys, pos, tag, level, text, is_comment): a row for each block of each page."""
    return extracted.select(*keys, F.explode("blocks").alias("b")).select(*keys, "b.*")


def _order(order_by: tuple[str, ...]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in order_by]


def numbered(rows: DataFrame, key: Column, order_by: tuple[str, ...], name: str) -> DataFrame:
    """``rows`` with a running number from 1 within each ``key``, in the given order (nulls last).

    Rows are range-sorted by key and order, so a key that a third of all rows have fills as many tasks as it needs. A task counts on from
    what earlier ones hold of the key that it begins with, of which there is one a task at most, so the table of these counts is bounded.
    """
    order = [F.struct(F.col(c).isNull(), F.col(c)).alias(f"__order{i}") for i, c in enumerate(order_by)]
    keyed = rows.select(F.struct(*rows.columns).alias("__row"), F.xxhash64(key).alias("__hash"), key.alias("__key"), *order)
    sort = ["__hash", "__key", *(f"__order{i}" for i in range(len(order)))]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(keyed.repartitionByRange(n, *sort).withColumn("__part", F.spark_partition_id()))
    counts = ranged.groupBy("__hash", "__key", "__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__hash", "__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.withColumn("__before", before).where("__before > 0").select("__hash", "__key", "__part", "__before")
    at = F.row_number().over(Window.partitionBy("__part", "__hash", "__key").orderBy(*sort[2:]))
    same = [F.col("a.__part") == F.col("b.__part"), F.col("a.__hash") == F.col("b.__hash"), F.col("a.__key").eqNullSafe(F.col("b.__key"))]
    joined = ranged.withColumn("__at", at).alias("a").join(F.broadcast(offsets).alias("b"), same[0] & same[1] & same[2], "left")
    return joined.select("a.__row.*", (F.col("a.__at") + F.coalesce("b.__before", F.lit(0))).cast("int").alias(name))


def repeated_segments(blocks: DataFrame, *, text_col: str = "text", order_by: tuple[str, ...] = ("doc_id", "pos"), min_size: int = MIN_SIZE, max_repetitions: int = MAX_REPETITIONS) -> DataFrame:
    """``blocks`` with ``occurrence`` (from 1, in the given order) and ``is_repeat``.

    A text of over ``min_size`` characters is a repeat from its occurrence ``max_repetitions + 2`` on; shorter texts never are.
    """
    counted = numbered(blocks, F.sha2(trimmed(text_col), 256), order_by, "occurrence")
    return counted.withColumn("is_repeat", (F.length(trimmed(text_col)) > min_size) & (F.col("occurrence") > max_repetitions + 1))


def without_repeated_segments(blocks: DataFrame, *, text_col: str = "text", order_by: tuple[str, ...] = ("doc_id", "pos"), min_size: int = MIN_SIZE, max_repetitions: int = MAX_REPETITIONS) -> DataFrame:
    """``blocks`` without the repeats of :func:`repeated_segments`.

    The rank is filtered at once, so Spark cuts each group to its first rows before the shuffle: a text that a third of all pages carry
    costs no more than any other. Short texts, which all stay, get a key of their own; ``blocks`` are read once.
    """
    long = F.coalesce(F.length(trimmed(text_col)) > min_size, F.lit(False))
    own = Window.partitionBy("__long", "__short").orderBy(*_order(order_by))
    keyed = blocks.withColumn("__long", F.when(long, F.sha2(trimmed(text_col), 256))).withColumn("__short", F.when(~long, F.monotonically_increasing_id()))
    kept = keyed.withColumn("__at", F.row_number().over(own)).where(F.col("__at") <= max_repetitions + 1)
    return kept.select(*blocks.columns)


def adjacent_repeats(blocks: DataFrame, *, doc_key: str = "doc_id", pos_col: str = "pos", text_col: str = "text", min_size: int = MIN_ADJACENT) -> DataFrame:
    """``blocks`` with ``is_adjacent_repeat``: a text of over ``min_size`` characters that equals the block before it."""
    own = Window.partitionBy(doc_key).orderBy(pos_col)
    t = trimmed(text_col)
    return blocks.withColumn("is_adjacent_repeat", F.coalesce((F.lag(t).over(own) == t) & (F.length(t) > min_size), F.lit(False)))


def without_adjacent_repeats(blocks: DataFrame, **options) -> DataFrame:
    return adjacent_repeats(blocks, **options).where(~F.col("is_adjacent_repeat")).drop("is_adjacent_repeat")


def document_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_size: int = MIN_SIZE, max_repetitions: int = MAX_REPETITIONS) -> DataFrame:
    """``docs`` with ``occurrence`` and ``is_repeat`` of their trimmed text, as for segments."""
    return repeated_segments(docs, text_col=text_col, order_by=(id_col,), min_size=min_size, max_repetitions=max_repetitions)


def without_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_size: int = MIN_SIZE, max_repetitions: int = MAX_REPETITIONS) -> DataFrame:
    return without_repeated_segments(docs, text_col=text_col, order_by=(id_col,), min_size=min_size, max_repetitions=max_repetitions)
