"""Files: directories of pages, tables, URL lists; results in the formats of the engine."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import is_utf8
from ..functions.pages import content_file_name, decoded

EXTENSIONS = {"csv": "csv", "json": "json", "xml": "xml", "xmltei": "xml"}


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table with url and html."""
    return spark.read.parquet(path)


def read_html_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, html, max_date): files below a directory, unpacked and decoded; valid UTF-8 is decoded without Python.

    The date of the last change bounds the dates that extraction may find.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    plain = is_utf8("content") & ~F.startswith(F.hex(F.substring("content", 1, 4)), F.lit("1F8B08"))
    html = F.when(plain, F.decode(F.col("content"), "UTF-8")).otherwise(decoded(F.when(~plain, F.col("content"))))
    return files.select("path", html.alias("html"), F.date_format("modificationTime", "yyyy-MM-dd").alias("max_date"), F.col("length").alias("n_bytes"))


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """(url, line): one address per line, each kept at its first place."""
    lines = spark.read.text(path).select(F.trim("value").alias("url"), F.monotonically_increasing_id().alias("line"))
    return lines.where("url <> ''").groupBy("url").agg(F.min("line").alias("line"))


def write_documents(extracted: DataFrame, path: str, output_format: str = "txt", *, per_file: int = 1000, mode: str = "errorifexists") -> None:
    """Serialized documents as text files, one document per line for JSON, else (name, output) as Parquet with at most ``per_file`` rows a file.

    Several formats have line breaks in a document, so these go to Parquet with a name made of the content.
    """
    docs = extracted.where("output IS NOT NULL")
    if output_format == "json":
        docs.select("output").write.mode(mode).option("maxRecordsPerFile", per_file).text(path)
    else:
        name = F.concat(content_file_name("output"), F.lit("." + EXTENSIONS.get(output_format, "txt")))
        docs.select(name.alias("name"), "output").write.mode(mode).option("maxRecordsPerFile", per_file).parquet(path)


def write_files(extracted: DataFrame, path: str, output_format: str = "txt", *, per_folder: int = 1000, source_col: str | None = None, root: str = "") -> DataFrame:
    """One file for each document below ``path``: (name, n_bytes) of what was written.

    Names are made of the content, in folders of ``per_folder`` files that are numbered by task; with ``source_col`` they mirror the documents' own
    paths below ``root``. ``path`` may be any address that pyarrow's file systems know, and must be one that all executors share. A task that is
    tried again writes the same files again. Documents with equal content share a file within a folder.
    """
    docs = extracted.where("output IS NOT NULL")
    if source_col:
        parts = F.regexp_replace(F.regexp_replace(F.col(source_col), r"^file:/*", "/"), r"\.[^./]*$", "")
        base = F.lit(root.rstrip("/") + "/") if root else F.lit("/")
        name = F.when(F.startswith(parts, base), F.substr(parts, F.length(base) + 1)).otherwise(F.ltrim(parts, F.lit("/")))
    else:
        name = content_file_name("output")
    suffix, mirrored = "." + EXTENSIONS.get(output_format, "txt"), bool(source_col)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        n = 0
        for batch in batches:
            names, sizes = [], []
            for own, text in zip(batch.column("name").to_pylist(), batch.column("output").to_pylist(), strict=True):
                folder = "" if mirrored else f"{TaskContext.get().partitionId()}-{n // per_folder + 1}/"
                place, data = f"{folder}{own}{suffix}", text.encode()
                system.create_dir(f"{top}/{place}".rpartition("/")[0], recursive=True)
                with system.open_output_stream(f"{top}/{place}") as out:
                    out.write(data)
                names.append(place)
                sizes.append(len(data))
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["name", "n_bytes"])

    return docs.select(name.alias("name"), "output").mapInArrow(kernel, "name string, n_bytes long")


def write_raw_pages(pages: DataFrame, path: str, *, html_col: str = "html", mode: str = "errorifexists") -> None:
    """A compressed copy of the raw pages, named by their content."""
    pages.select(content_file_name(html_col).alias("name"), F.col(html_col).alias("html")).write.mode(mode).option("compression", "gzip").parquet(path)
