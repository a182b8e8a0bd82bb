"""The functions under SQL names: ``register(spark)`` makes them usable in ``spark.sql``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import pages as P


class ExtractBlocks:
    """``SELECT … FROM pages, LATERAL page_blocks(html, url)``: the blocks of a page."""

    def eval(self, html: str, url: str) -> Iterator[tuple]:
        from ..kernel.core import extract
        from ..kernel.options import Options

        yield from extract(html, Options.of(fast=True), url=url)["blocks"] or ()


class ExtractLinks:
    """``SELECT … FROM pages, LATERAL page_link_rows(html, url)``: the distinct clean links of a page."""

    def eval(self, html: str, url: str) -> Iterator[tuple]:
        from ..kernel.discovery import page_links

        yield from enumerate(page_links(html, url))


class DomNodes:
    """``SELECT … FROM pages, LATERAL page_nodes(html)``: the elements of a page."""

    def eval(self, html: str) -> Iterator[tuple]:
        from ..kernel.core import load
        from ..kernel.text import trim

        tree = load(html)
        number: dict[int, int] = {}
        for n in tree.walk() if tree is not None else ():
            number[id(n)] = len(number)
            yield number[id(n)], number.get(id(n.parent), -1), sum(1 for _ in n.ancestors()), n.tag, n.attrs.get("id"), n.attrs.get("class"), len(trim(n.text())), sum(len(trim(a.text())) for a in n.below("a"))


def _on_tree(module: str, name: str, part: int | None = None):
    def make():
        f = P._with_tree(name, module)()
        return f if part is None else lambda page: f(page)[part]

    return make


def _plain(module: str, name: str):
    def make():
        import importlib

        return getattr(importlib.import_module(f"pagesieve.kernel.{module}"), name)

    return make


def _main_text():
    from ..kernel.core import extract
    from ..kernel.options import Options

    options = Options.of(output_format="txt")
    return lambda page: extract(page, options)["output"]


SCALARS = [
    ("page_text", "string", _main_text),
    ("page_all_text", "string", _on_tree("simple", "all_text")),
    ("page_baseline_text", "string", _on_tree("simple", "baseline", 1)),
    ("page_readerable", "boolean", _on_tree("fallback", "probably_readerable")),
    ("text_fingerprint", "string", _plain("fingerprint", "fingerprint")),
    ("text_file_name", "string", _plain("fingerprint", "file_name")),
    ("text_language", "string", _plain("fallback", "guess_language")),
    ("clean_url", "string", _plain("urls", "cleaned")),
    ("registered_domain", "string", _plain("urls", "registered_domain")),
]


TABLES = [
    ("page_blocks", ExtractBlocks, "pos int, tag string, level int, text string, is_comment boolean"),
    ("page_link_rows", ExtractLinks, "pos int, link string"),
    ("page_nodes", DomNodes, "node_id int, parent_id int, depth int, tag string, id_attr string, class_attr string, text_len int, link_len int"),
]


def register(spark: SparkSession) -> list[str]:
    """Registers all names for the session and returns them."""
    for name, kind, make in SCALARS:
        spark.udf.register(name, P._text_function(make, kind))
    for name, table, kind in TABLES:
        spark.udtf.register(name, F.udtf(table, returnType=kind))
    return [name for name, *_ in (*SCALARS, *TABLES)]
