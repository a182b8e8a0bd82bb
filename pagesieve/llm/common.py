"""Shared pieces: table access, lineage cuts and the text rules that several operators use."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word: a run of anything but ASCII space and U+0009 to U+000D. ``bytes.split()`` cuts at the same characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Used only by a session of one machine that names no shared folder, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"
#: Groups that may count as hot: at most so many can hold one part in so many of all rows.
HOT_GROUPS = 1000
#: A task that writes a table stands for so many bytes of the input at least, if that leaves so many tasks for each core.
WRITER_BYTES, WRITERS_PER_CORE = 8 << 20, 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a session on one machine may do without."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = LOCAL_CHECKPOINTS
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` written to the shared folder by ``checkpoint()``: computed once, and safe when executors go."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    As :func:`cut`, but compressed and read column by column: for what holds texts or long binaries.
    """
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def writers(df: DataFrame) -> int:
    """How many tasks at most should write a table made from ``df``; more of them only make small files.

    Goes by Spark's estimate of the size of ``df``, which for what no file or relation stands behind is beyond any bound. Where Hadoop's native library is
    missing, each file in a local folder costs two started processes besides (``chmod``, for it and its checksums).
    """
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(max(WRITERS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism, -(-estimate // WRITER_BYTES)), (1 << 31) - 1)


#: Tables that :func:`stored` has written in this process, oldest first.
_WRITTEN: list[str] = []


def stored_tables() -> list[str]:
    return list(_WRITTEN)


def _own_folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/pagesieve-{spark.sparkContext.applicationId}"


def drop_stored(spark: SparkSession, tables: list[str] | None = None) -> None:
    """Deletes ``tables`` that :func:`stored` has written, or all of this application. DataFrames that read them can't be used any more."""
    for name in [_own_folder(spark)] if tables is None else tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _WRITTEN[:] = [t for t in _WRITTEN if tables is not None and t not in tables]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def id_text_crc(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as the empty text (0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def null_salt(key: Column) -> Column:
    """A second join key that spreads null keys, which match nothing, over the partitions."""
    return F.when(key.isNull(), F.rand(7)).otherwise(F.lit(0.0))


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """``rows`` with the columns of their group; ``groups`` has one row for each combination of ``keys`` and its number of rows in ``size``.

    Groups that hold a thousandth of all rows or more, of which there are a thousand at most, are broadcast, so their
    rows stay where they are; the others are joined by a shuffle, none of whose keys is hot. Keys are not null, and both sides are read twice.
    """
    least = -(-(groups.agg(F.sum(size)).first()[0] or 0) // HOT_GROUPS)
    hot = groups.where(F.col(size) >= least).limit(HOT_GROUPS)
    cold = groups.where(F.col(size) < least)
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys))
