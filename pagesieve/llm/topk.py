"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Vectors with equal components form one class, so a very common vector is scored once. Classes are dealt to blocks by the signs of their
first components. A query walks down the lists of all dimensions of a block at once, scores what it meets, and stops when the sum of
what the lists can still give cannot reach its k-th score. It visits the block of its own signs first; its k-th score there goes with it to
all other blocks, which it leaves at once where even their largest components cannot reach that score.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_groups

K, SCALE, QUERY_EVERY = 5, 256, 50
#: Classes of one block, on average; at most so many signs tell blocks apart.
BLOCK, MOST_SIGNS = 2048, 16
#: Entries of each list that the first step reads; each further step reads twice as many.
FIRST_STEP = 16


def threshold_top(matrix: np.ndarray, lists: np.ndarray, query: np.ndarray, k: int, own: np.ndarray | tuple = (), floor: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores) of ``matrix`` whose product with ``query`` is at least the k-th highest; the rows ``own`` count for none of the k.

    ``lists[d]`` holds the rows sorted by component ``d``, ascending. Rows that tie with the k-th are all returned. ``floor`` is a score that
    k other rows have reached: rows below it aren't wanted.
    """
    n = len(matrix)
    used = np.flatnonzero(query)
    q = query[used]
    down = q > 0
    seen = np.zeros(n, bool)
    rows, scores = np.empty(0, np.int64), np.empty(0, np.int64)
    at, step = 0, FIRST_STEP
    bound = lambda end: int((q * np.where(down, matrix[lists[used, n - end], used], matrix[lists[used, end - 1], used])).sum())
    if floor is not None and bound(1) < floor:
        return rows, scores
    while at < n:
        end = min(n, at + step)
        if len(used):
            met = np.concatenate([lists[used[~down], at:end].ravel(), lists[used[down], n - end : n - at].ravel()])
        else:
            met, end = np.arange(n), n
        new = np.zeros(n, bool)
        new[met] = True
        new = np.flatnonzero(new & ~seen)
        seen[new] = True
        rows, scores = np.concatenate([rows, new]), np.concatenate([scores, matrix[new] @ query])
        ranked = np.sort(scores[~np.isin(rows, own)] if len(own) else scores)[::-1]
        kth = None if len(ranked) < k else int(ranked[k - 1])
        if floor is not None and (kth is None or kth < floor):
            kth = floor
        if kth is not None:
            good = scores >= kth
            rows, scores = rows[good], scores[good]
            if end == n or bound(end) < kth:
                break
        at, step = end, 2 * step
    return rows, scores


class _Block:
    """The candidates of one block, with their lists."""

    def __init__(self, numbers: list[int], only: list, vectors: list[list[int]]):
        self.numbers, self.width = np.array(numbers, np.int64), max(map(len, vectors))
        self.matrix = np.zeros((len(vectors), self.width), np.int64)
        for row, v in enumerate(vectors):
            self.matrix[row, : len(v)] = v
        self.lists = np.ascontiguousarray(np.argsort(self.matrix, axis=0, kind="stable").T)
        self.of_id = defaultdict(list)  # rows of the classes that have this id only
        for row, i in enumerate(only):
            self.of_id[i].append(row)

    def top(self, query_id, vector: list[int], k: int, floor: int | None) -> tuple[np.ndarray, np.ndarray]:
        query = np.zeros(self.width, np.int64)
        query[: len(vector)] = vector[: self.width]  # further components meet nothing but zeros
        own = np.array(self.of_id.get(query_id, ()), np.int64)
        rows, scores = threshold_top(self.matrix, self.lists, query, k, own, floor)
        other = ~np.isin(rows, own)
        return self.numbers[rows[other]], scores[other]


def _block_top(k: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block, candidates (kind 0) before queries; queries are answered as they come."""
        current, held, block = None, [], None
        for batch in batches:
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for b, kind, number, i, v, floor in zip(*(batch.column(c).to_pylist() for c in ("block", "kind", "number", "id", "v", "floor")), strict=True):
                if b != current:
                    current, held, block = b, [], None
                if kind == 0:
                    held.append((number, i, v))
                    continue
                if held:
                    block, held = _Block(*map(list, zip(*held, strict=True))), []
                if block is not None:
                    found, scores = block.top(i, v, k, floor)
                    out.append((np.full(len(found), number), found, scores))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], ["ask", "class_id", "score"])

    return kernel


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each of ``queries`` its k highest inner products with ``vectors``.

    Components become ``floor(scale * x)``. Candidates with the query's own id don't count; ties go to the smaller id, and
    queries with fewer candidates get all of them. Rows whose vector is null, or holds a null or non-finite component, or
    whose id is null take no part; shorter vectors count as filled up with zeros. Rows that repeat an id
    are candidates each; what queries that repeat one find is ranked together. Ids keep their type.
    An empty table gives no rows. Each block of classes is shuffled twice and each query once to each block, so work grows with the
    number of queries times the number of blocks.
    """

    def whole(df: DataFrame) -> DataFrame:
        x = F.col(vector_col)
        bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) == float("inf")))
        return df.where(F.col(id_col).isNotNull() & x.isNotNull() & ~F.coalesce(bad, F.lit(False))).select(F.col(id_col).alias("id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale)).alias("v"))

    spark = vectors.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    members = cut(whole(vectors))
    classes = cut(members.groupBy("v").agg(F.count("*").alias("n")).select("v", "n", F.monotonically_increasing_id().alias("class_id")))
    # k + 1 ids of a class are enough, as one of them may be the query's, and k rows of each.
    joined = join_groups(members, classes, ["v"], "n").groupBy("class_id", "id").agg(F.count("*").alias("n"))
    first = cut(joined.withColumn("at", F.row_number().over(Window.partitionBy("class_id").orderBy("id"))).where(F.col("at") <= k + 1).select("class_id", "id", F.least("n", F.lit(k)).alias("n")))
    ids = cut(first.groupBy("class_id").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("class_id", F.get("ids", F.lit(0)).alias("least"), F.get("ids", F.lit(1)).alias("second")))
    total = classes.count()
    # Small tables make smaller blocks, so that all tasks have some.
    size = max(1, min(BLOCK, -(-total // n)))
    signs = min(MOST_SIGNS, (-(-total // size) - 1).bit_length() if total else 0)
    cell = sum((F.when(F.coalesce(F.get("v", F.lit(d)), F.lit(0)) > 0, 1 << d).otherwise(0) for d in range(signs)), F.lit(0))
    counted = classes.select("class_id", "v", cell.alias("cell"))
    cells = cut(counted.groupBy("cell").agg(F.count("*").alias("in_cell")).select("cell", F.ceil(F.col("in_cell") / size).alias("k")))
    # Blocks are numbered in one task: a short row for each thousand or two of classes.
    blocks = cut(cells.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("sub")).withColumn("block", (F.row_number().over(Window.orderBy("cell", "sub")) - 1).cast("long")))
    part = lambda c: F.pmod(F.xxhash64(c), F.col("k")).alias("sub")
    # A class counts for none of a query's k if it has no other id than the query's.
    only = F.when(F.col("second").isNull(), F.col("least"))
    placed = counted.join(cells, "cell").select("class_id", "v", "cell", part("class_id")).join(blocks, ["cell", "sub"])
    candidates = cut(placed.join(ids, "class_id").select("block", F.lit(0).alias("kind"), F.col("class_id").alias("number"), only.alias("id"), "v", F.lit(None).cast("long").alias("floor")))
    asked = cut(whole(queries).select(F.monotonically_increasing_id().alias("ask"), F.col("id").alias("query_id"), "v", cell.alias("cell")))
    homes = cut(asked.join(cells, "cell").select("ask", "cell", part("ask")).join(blocks, ["cell", "sub"]).select("ask", F.col("block").alias("home")))

    def answers(questions: DataFrame) -> DataFrame:
        rows = candidates.unionByName(questions.select("block", F.lit(1).alias("kind"), F.col("ask").alias("number"), F.col("query_id").alias("id"), "v", "floor"))
        return rows.repartition(n, "block").sortWithinPartitions("block", "kind").mapInArrow(_block_top(k), "ask long, class_id long, score long")

    at_home = cut(answers(asked.join(homes, "ask").select(F.col("home").alias("block"), "ask", "query_id", "v", F.lit(None).cast("long").alias("floor"))))
    floors = at_home.groupBy("ask").agg(F.count("*").alias("found"), F.min("score").alias("least")).select("ask", F.when(F.col("found") >= k, F.col("least")).alias("floor"))
    known = asked.join(homes, "ask", "left").join(floors, "ask", "left").select("ask", "query_id", "v", "home", "floor")
    every = known.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, blocks.count() - 1)).cast("long"))))
    away = every.where(~F.col("block").eqNullSafe(F.col("home")))
    found = at_home.unionByName(answers(away.select("block", "ask", "query_id", "v", "floor"))).join(asked.select("ask", "query_id"), "ask")
    # k classes, by the least id in them that is not the query's; then their members.
    other = F.when(F.col("least") == F.col("query_id"), F.col("second")).otherwise(F.col("least"))
    best = Window.partitionBy("ask").orderBy(F.desc("score"), other)
    kept = found.join(ids, "class_id").withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).select("query_id", "class_id", "score")
    copies = kept.join(first, "class_id").where("id <> query_id").select("query_id", "id", "score", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return copies.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
