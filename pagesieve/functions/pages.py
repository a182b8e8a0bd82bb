"""The page kernel as Arrow functions: one Python evaluation per page and per query."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..kernel.options import Options

BLOCK = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("tag", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("is_comment", T.BooleanType())])
_STRINGS = "title author url hostname description sitename date".split()
_MORE = "fingerprint id license body commentsbody comments raw_text text language image pagetype filedate".split()
DOCUMENT_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in _STRINGS]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("categories", "tags")]
    + [T.StructField(n, T.StringType()) for n in (*_MORE, "status", "stage", "body_text")]
    + [T.StructField("text_len", T.IntegerType()), T.StructField("comments_len", T.IntegerType()), T.StructField("output", T.StringType()), T.StructField("blocks", T.ArrayType(BLOCK))]
)
#: Pages of one Arrow batch: pages are large, results too.
BATCH = 256


def _arrow(name: str) -> pa.DataType:
    block = pa.struct([("pos", pa.int32()), ("tag", pa.string()), ("level", pa.int32()), ("text", pa.string()), ("is_comment", pa.bool_())])
    return {"categories": pa.list_(pa.string()), "tags": pa.list_(pa.string()), "text_len": pa.int32(), "comments_len": pa.int32(), "blocks": pa.list_(block)}.get(name, pa.string())


def _few_splits(rows: DataFrame) -> bool:
    """Whether a plain scan has fewer partitions than there are cores. What has been shuffled already is left as it is, and never run for this."""
    if rows._jdf.queryExecution().executedPlan().toString().startswith("AdaptiveSparkPlan"):
        return False
    return rows.rdd.getNumPartitions() < rows.sparkSession.sparkContext.defaultParallelism


def extract_pages(pages: DataFrame, options: Options | None = None, *, html_col: str = "html", url_col: str | None = "url", id_col: str | None = None, keep: tuple[str, ...] = (), fields: tuple[str, ...] | None = None, detect=None, spread: bool = True, date_col: str | None = None, **named) -> DataFrame:
    """The kept columns of ``pages`` with the fields of the record of each page.

    ``named`` are the keyword options (output_format, fast, favor_precision, include_links, ...). Pages often lie in few large files; with
    ``spread`` they are dealt over all cores first when there are fewer partitions than that. A page that can't be read has a status
    instead of a text and ends nothing; ``stage`` then tells what went wrong. ``date_col`` names the latest date that a page may have, such as that of its file.
    """
    options = options or Options.of(**named)
    fields = fields or tuple(f.name for f in DOCUMENT_SCHEMA)
    need_blocks = "blocks" in fields
    spark = pages.sparkSession
    html, url = F.col(html_col).alias("__html"), (F.col(url_col) if url_col else F.lit(None)).cast("string").alias("__url")
    ident = (F.col(id_col) if id_col else F.lit(None)).cast("string").alias("__id")
    latest = (F.col(date_col) if date_col else F.lit(None)).cast("string").alias("__latest")
    rows = pages.select(*keep, html, url, ident, latest)
    if spread and not pages.isStreaming and _few_splits(rows):
        rows = rows.repartition(4 * spark.sparkContext.defaultParallelism)
    schema = T.StructType([*(pages.schema[k] for k in keep), *(DOCUMENT_SCHEMA[f] for f in fields)])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sys

        from ..kernel.core import extract

        sys.setrecursionlimit(max(sys.getrecursionlimit(), 10_000))
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                found = [
                    extract(h, options if latest is None else options.but(date_params={**(options.date_params or {}), "latest": latest}), url=u, record_id=i, detect=detect, need=fields)
                    for h, u, i, latest in zip(*(batch.column(c).to_pylist() for c in ("__html", "__url", "__id", "__latest")), strict=True)
                ]
                arrays = [batch.column(k) for k in keep]
                for f in fields:
                    if f == "blocks" and need_blocks:
                        values = [None if r["blocks"] is None else [dict(zip(("pos", "tag", "level", "text", "is_comment"), b, strict=True)) for b in r["blocks"]] for r in found]
                    else:
                        values = [r[f] for r in found]
                    arrays.append(pa.array(values, _arrow(f)))
                yield pa.RecordBatch.from_arrays(arrays, [*keep, *fields])

    return rows.mapInArrow(kernel, schema)


def render_documents(docs: DataFrame, options: Options | None = None, *, keep: tuple[str, ...] = (), drop_col: str | None = None, **named) -> DataFrame:
    """The kept columns with text, comments, output and text_len, rendered from the ``body`` of extracted records in any format.

    Pages are parsed once and rendered as often as formats are wanted; ``drop_col`` holds positions of blocks to leave out. Metadata
    fields that ``docs`` has go into the output.
    """
    options = options or Options.of(**named)
    known = [f for f in DOCUMENT_SCHEMA.fieldNames() if f in docs.columns and f not in ("text", "comments", "output", "text_len", "comments_len", "blocks", "status", "stage", "body_text")]
    rows = docs.select(*keep, F.struct(*known).alias("__record"), (F.col(drop_col) if drop_col else F.lit(None)).cast("array<int>").alias("__drop"))
    fields = ("text", "comments", "output", "text_len")
    schema = T.StructType([*(docs.schema[k] for k in keep), *(DOCUMENT_SCHEMA[f] for f in fields)])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..kernel.core import rendered

        for batch in batches:
            found = [rendered(r, options, frozenset(d or ())) for r, d in zip(batch.column("__record").to_pylist(), batch.column("__drop").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *(pa.array([r[f] for r in found], _arrow(f)) for f in fields)], [*keep, *fields])

    return rows.mapInArrow(kernel, schema)


def _text_function(make: Callable[[], Callable], kind: str = "string"):
    """An Arrow function over one column; ``make`` runs on the worker and returns a function of one value."""

    @F.pandas_udf(kind)
    def function(values: pd.Series) -> pd.Series:
        f = make()
        return pd.Series([None if v is None else f(v) for v in values], dtype="object")

    return function


def _with_tree(name: str, module: str):
    def make():
        import importlib

        core = importlib.import_module("pagesieve.kernel.core")
        f = getattr(importlib.import_module(f"pagesieve.kernel.{module}"), name)
        return lambda page: f(core.load(page))

    return make


def baseline_text(html: Column | str) -> Column:
    """The text of the baseline extractor."""

    def make():
        from pagesieve.kernel.core import load
        from pagesieve.kernel.simple import baseline

        return lambda page: baseline(load(page))[1]

    return _text_function(make)(html)


def html_to_text(html: Column | str, closed_references: bool = False) -> Column:
    """All text of a page without its furniture."""

    def make():
        from pagesieve.kernel.core import load
        from pagesieve.kernel.simple import all_text
        from pagesieve.kernel.text import references

        def text(page):
            with references(closed_references):
                return all_text(load(page))

        return text

    return _text_function(make)(html)


def extract_text(html: Column | str, url: Column | str | None = None, **options) -> Column:
    """The page in the format of ``output_format`` (default txt), or null."""
    chosen = Options.of(**{"output_format": "txt", **options})

    @F.pandas_udf("string")
    def function(pages: pd.Series, addresses: pd.Series) -> pd.Series:
        from pagesieve.kernel.core import extract

        return pd.Series([extract(p, chosen, url=u, need=("output",))["output"] for p, u in zip(pages, addresses, strict=True)], dtype="object")

    return function(html, F.lit(None).cast("string") if url is None else url)


def page_metadata(html: Column | str, url: Column | str | None = None, closed_references: bool = False, **date_params) -> Column:
    """The metadata of a page as a struct of the string and array fields of the record."""
    names = [f for f in DOCUMENT_SCHEMA.fieldNames() if f in (*_STRINGS, "categories", "tags", "license", "image", "pagetype")]
    kind = T.StructType([DOCUMENT_SCHEMA[n] for n in names])

    @F.pandas_udf(kind)
    def function(pages: pd.Series, addresses: pd.Series) -> pd.DataFrame:
        from pagesieve.kernel.core import load
        from pagesieve.kernel.metadata import metadata
        from pagesieve.kernel.text import references

        rows = []
        with references(closed_references):
            for p, u in zip(pages, addresses, strict=True):
                tree = load(p)
                found = metadata(tree, u, date_params) if tree is not None else {}
                rows.append([found.get(n) for n in names])
        return pd.DataFrame(rows, columns=names)

    return function(html, F.lit(None).cast("string") if url is None else url)


def probably_readerable(html: Column | str) -> Column:
    return _text_function(_with_tree("probably_readerable", "fallback"), "boolean")(html)


def text_fingerprint(text: Column | str) -> Column:
    """The similarity hash of a text in hexadecimal digits without leading zeros."""

    def make():
        from pagesieve.kernel.fingerprint import fingerprint

        return fingerprint

    return _text_function(make)(text)


def content_file_name(text: Column | str) -> Column:
    def make():
        from pagesieve.kernel.fingerprint import file_name

        return file_name

    return _text_function(make)(text)


def decoded(content: Column | str) -> Column:
    """Bytes as text: unpacked, in the encoding that fits."""

    def make():
        from pagesieve.kernel.text import decode

        return decode

    return _text_function(make)(content)


def normalized_unicode(text: Column | str, form: str = "NFC") -> Column:
    def make():
        from pagesieve.kernel.text import nfc

        return lambda t: nfc(t, form)

    return _text_function(make)(text)


def clean_url(url: Column | str) -> Column:
    """A web page's address, cleaned and without tracking parameters; null if it is none."""

    def make():
        from pagesieve.kernel.urls import checked

        return lambda u: (checked(u) or (None,))[0]

    return _text_function(make)(url)


def similar_domains(one: Column | str, other: Column | str, least: float = 0.5) -> Column:
    @F.pandas_udf("boolean")
    def function(a: pd.Series, b: pd.Series) -> pd.Series:
        from pagesieve.kernel.fingerprint import similar_domains as f

        return pd.Series([f(x, y, least) if x is not None and y is not None else None for x, y in zip(a, b, strict=True)], dtype="object")

    return function(one, other)


def page_links(html: Column | str, url: Column | str, external: bool | None = None, language: str | None = None, detect=None, prune: tuple[str, ...] = ()) -> Column:
    """Distinct clean links of a page, in order.

    With a ``language``, links that tell another one are left out, and a page whose text ``detect`` takes to be in another one has none. What the
    expressions in ``prune`` select is cut out first.
    """

    @F.pandas_udf("array<string>")
    def function(pages: pd.Series, addresses: pd.Series) -> pd.Series:
        from pagesieve.kernel.core import load, selected
        from pagesieve.kernel.discovery import page_links as f
        from pagesieve.kernel.dom import without
        from pagesieve.kernel.simple import baseline

        def links(page: str | None, address: str | None) -> list[str]:
            tree = load(page) if page else None
            if tree is not None and language and detect is not None and detect(baseline(tree)[1]) not in (None, language):
                return []
            for expression in prune if tree is not None else ():
                tree = without(tree, selected(tree, expression))
            return f(tree, address, external=external, language=language)

        return pd.Series([links(p, u) for p, u in zip(pages, addresses, strict=True)])

    return function(html, url)


def language_fits(html: Column | str, language: Column | str, strict: bool = False) -> Column:
    """Whether what meta elements of a page (and with ``strict`` its html element) say of the language allows the given one; a page that says nothing allows any."""

    @F.pandas_udf("boolean")
    def function(pages: pd.Series, languages: pd.Series) -> pd.Series:
        from pagesieve.kernel.core import load, page_language_fits

        trees = [load(p) if p else None for p in pages]
        return pd.Series([None if t is None or lang is None else page_language_fits(t, lang, strict) for t, lang in zip(trees, languages, strict=True)], dtype="object")

    return function(html, language)


NODES = "page_id long, node_id int, parent_id int, depth int, pos int, tag string, id_attr string, class_attr string, text_len int, link_len int, commas int"


def dom_nodes(pages: DataFrame, *, html_col: str = "html", id_col: str = "page_id") -> DataFrame:
    """Pages as a table of their elements in the order of the document.

    ``pos`` is the place among the elements of the parent; ``text_len`` counts characters of the text with white space collapsed, ``link_len`` those in links
    below, ``commas`` the commas. One walk over the tree gives all of them.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..kernel.core import load
        from ..kernel.dom import measured

        kinds = [pa.int64(), *[pa.int32()] * 4, *[pa.string()] * 3, *[pa.int32()] * 3]
        names = [part.split()[0] for part in NODES.split(", ")]
        for batch in batches:
            for page_id, html in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist(), strict=True):
                tree = load(html)
                found = [(page_id, *row) for row in measured(tree)] if tree is not None else []
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True) if found else [[]] * len(names), kinds, strict=True)], names)

    return rows.mapInArrow(kernel, NODES)


__all__ = [n for n, f in list(globals().items()) if (callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_"))] + ["BLOCK", "DOCUMENT_SCHEMA", "NODES"]
