"""Mixing sources to target weights, with DataFrame expressions only.

Every document gets a hash-random key. Within its source the keys are range-sorted: equal ranges of the key, as many as
the source's rows ask for, each sorted on its own. Sums of the ranges before it plus a running sum inside the range make a
distributed prefix sum of sizes, and the source is cut at its exact budget after the whole epochs that the budget holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

#: Weights by the rank of the source, repeating; share of all sizes that the mix asks for; most epochs of one source.
WEIGHTS, SHARE, MAX_EPOCHS = (3, 1, 2), 1.5, 2
#: Rows that one range of keys holds on average, at most.
ROWS_PER_RANGE = 512
#: Ranges whose sums are added up in one task; the sums of such blocks are added up for each source.
RANGES_PER_BLOCK = 4096
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, *, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sources`` (source, source_size, n_docs) with the target of each.

    Ranks come from a range sort and a count for each partition, so any number of sources works. The share ``w * level``
    of each source is stopped at ``max_epochs * source_size``; raising the level by what the stopped
    sources leave over, divided by the weights of the others, ends when no source is above.
    Only sums of the sources reach the driver. Null sources rank last.
    """
    sorted_ = cut(sources.orderBy(F.col("source").isNull(), "source").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    parts = sorted_.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    # One row for each partition of the sort.
    offsets = parts.select("part", "first", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    w = F.array(*[F.lit(float(x)) for x in weights])
    ranked = cut(
        sorted_.join(F.broadcast(offsets), "part")
        .withColumn("weight", F.element_at(w, ((F.col("offset") + F.col("at") - F.col("first")) % len(weights) + 1).cast("int")))
        .withColumn("cap", (max_epochs * F.col("source_size")).cast("long"))
        .select("source", "source_size", "n_docs", "weight", "cap")
    )
    wanted = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, stopped = 0.0, -1
    while True:
        above = (F.col("weight") * level > F.col("cap")) if stopped >= 0 else F.lit(False)
        got = ranked.agg(F.count_if(above), F.sum(F.when(above, F.col("cap")).otherwise(0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight")))).first()
        if got[0] == stopped or not got[2]:
            break
        stopped, level = got[0], (wanted - got[1]) / got[2]
    return ranked.withColumn("target", F.least(F.col("weight") * level, F.col("cap").cast("double")))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, epochs, taken.

    ``size`` counts words (null text: 0). ``taken`` is what the mix takes of it: whole epochs times its size, plus what the
    last, partial epoch reaches in the order of the keys; the document at the cut is taken in part, so that each source
    gives the integral part of its target exactly. ``epochs`` is the number of copies, the partial one included.
    A null source is a source of its own; a null id has a key like any other; ties of keys go by id and size, and rows that agree in
    all of them are interchangeable. Sources without words have target 0. An empty table gives no rows.
    """
    # A row without an id has the hash of its text instead, so that such rows don't share one key.
    named = F.when(F.col(id_col).isNull(), F.concat_ws(":", F.lit(seed), F.lit("null"), F.xxhash64(F.col(text_col).cast("string")).cast("string"))).otherwise(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string")))
    key = F.conv(F.substring(F.md5(named), 1, 15), 16, 10).cast("long")
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), key.alias("key")))
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    targets = cut(source_targets(sources, weights=weights, share=share, max_epochs=max_epochs)).select(F.col("source").alias("s"), "source_size", "n_docs", "target")
    ranges = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / ROWS_PER_RANGE))
    keyed = cut(
        rows.join(targets, F.col("source").eqNullSafe(F.col("s")))
        .withColumn("range", F.floor(F.col("key") / F.ceil(F.lit(float(1 << 60)) / ranges)).cast("int"))
        .select("doc_id", "source", "size", "source_size", "target", "key", "range")
    )
    # Prefix sums in two steps, so that no task adds up all ranges of a large source.
    sums = keyed.groupBy("source", "range").agg(F.sum("size").alias("in_range")).withColumn("block", F.floor(F.col("range") / RANGES_PER_BLOCK))
    earlier = lambda total, *by: F.coalesce(F.sum(total).over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = sums.groupBy("source", "block").agg(F.sum("in_range").alias("in_block")).select(F.col("source").alias("s"), F.col("block").alias("b"), earlier("in_block", "source", "block").alias("before_block"))
    before = (
        sums.withColumn("in_block_before", earlier("in_range", "source", "block", "range"))
        .join(blocks, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
        .select("s", F.col("range").alias("r"), (F.col("before_block") + F.col("in_block_before")).alias("before_range"))
    )
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = keyed.withColumn("before", F.sum("size").over(inside) - F.col("size"))
    budget = F.floor("target")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), budget - whole * F.col("source_size") - F.col("before_range") - F.col("before")))
    return (
        summed.join(before, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
        .withColumn("part", part)
        .select("doc_id", "source", "size", "source_size", "target", (whole + (F.col("part") > 0).cast("long")).alias("epochs"), (whole * F.col("size") + F.col("part")).cast("long").alias("taken"))
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them: each document as often as its epochs say, the one at the cut as a whole copy.

    Keeps the columns of ``docs``, whatever their names. Rows are matched to the mix by id; of ids that repeat, the copies of all go by the
    largest of the decisions. Documents without words are kept once, as they cost nothing of any budget. An empty table gives no rows.
    """
    id_col = options.get("id_col", "doc_id")
    copies = mix(docs, **options).groupBy(F.col("doc_id").alias("id")).agg(F.max(F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("epochs"))).cast("int").alias("copies")).where("copies > 0")
    kept = docs.select(F.struct(*docs.columns).alias("whole"), F.col(id_col).alias("own_id")).join(copies, F.col("own_id").eqNullSafe(F.col("id")))
    return kept.select("whole", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("whole.*")
