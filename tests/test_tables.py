"""Queries against their SQL on pages that the small tables lack."""

from __future__ import annotations

import html

import pytest

from pagesieve.kernel.core import extract, load
from pagesieve.kernel.metadata import metadata
from pagesieve.kernel.options import Options
from pagesieve.kernel.text import references, single_spaced
from pagesieve.plans import registry

NAMES = ["page_html", "page_markdown", "page_title", "page_xml", "pages_without_repeats", "feed_discovery", "html_to_text", "listed_links", "page_csv", "page_json", "page_metadata", "page_txt", "page_xmltei"]


def page(text: str) -> str:
    """A page as in the test tables: its title is the escaped text, cut at 60 characters."""
    lines = [html.escape(x) for x in text.split("\n")]
    title = lines[0][:60]
    return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{title}</title></head><body><article><h1>{title}</h1>{"".join(f"<p>{x}</p>" for x in lines)}</article></body></html>'


TEXTS = [
    "Alpha** beta&&& gamma delta epsilon zeta eta&&& theta iota kappa\nThe second paragraph of the first text.",  # the title is cut in a reference
    "The only paragraph of this text repeats the title as it",  # nothing is left below the heading
    "+1 (555) 010-0199 This title begins with a number\nThe second paragraph of the third text.",
    "4703443633947811 This one as well\nThe second paragraph of the fourth text.",
]
#: An address with a number that is no date; those of one host, over 10,000 characters in all, all pages twice.
URLS = ["http://one.example.com/en/206533.html"] + [f"http://many.example.com/en/{1000 + i}{end}" for i in range(200) for end in ("", "?utm_source=feed")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    documents = [(i, t, "en", "web", len(t)) for i, t in enumerate(TEXTS)]
    pages = [(i, f"http://one.example.com/en/{i}", page(t)) for i, t in enumerate(TEXTS)] + [(100 + i, u, page(TEXTS[3])) for i, u in enumerate(URLS)]
    documents += [(i, TEXTS[3], "en", "web", len(TEXTS[3])) for i in (206533, *range(1000, 1200))]
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_queries_match_their_sql(spark, tables, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet/*.parquet'")
    cursor = con.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    found = registry.QUERIES[name](spark, tables)
    assert found.columns == columns
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(cursor.fetchall(), key=repr)


def test_references_without_semicolon():
    text = '<html><head><title>A &amp; B &lt;c &amp</title><script>var a = "&lt";</script></head><body><article><p title="?a=1&copy=2">Some text &lt and &unknown; &gt; &#65; &#65 here.</p></article></body></html>'
    as_browsers, closed = (extract(text, Options.of(output_format="txt", fast=True, min_extracted_size=0, closed_references=c))["output"] for c in (False, True))
    assert as_browsers == "Some text < and &unknown; > A A here." and closed == "Some text &lt and &unknown; > A &#65 here."
    assert metadata(load(text))["title"] == "A & B <c &"


ODD = [
    "A tab\there, two  blanks and\t\ttabs\t in a title\nA tab\tin the second,  paragraph \nA \"tab\tin quotes\"",
    "Literal &lt;b&gt; &amp;amp; &nbsp;&#65; &copy;\nA second &lt;p&gt; with &amp;lt; and &#x41; &nbsp; in it",
    "This title is cut within the end of a comment that is <!-- x -->\nThe second <!-- &amp --> paragraph <script>&lt</script>",
    "A first line with a blank at its end \n Second paragraph",
    "Quotes\nThe second " + 'paragraph "has" many, ' * 2000,
]


@pytest.mark.parametrize("name", ["page_csv", "page_json"])
def test_formats_match_their_sql_on_odd_texts(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in enumerate(ODD)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    bold = [page(t).replace("<p>", "<p><b>", 1).replace("</p>", "<br>", 1) for t in ODD]  # as in the test tables
    spark.createDataFrame([(i, f"http://one.example.com/en/{i}", p) for i, p in enumerate(bold)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    expected = con.execute(registry.ORACLE_SQL[name]).fetchall()
    assert len(expected) == len(ODD)
    assert sorted(map(tuple, registry.QUERIES[name](spark, str(tmp_path)).collect()), key=repr) == sorted(expected, key=repr)


def test_single_spaces_leave_code():
    text = "<html><body><article><p>Some\n  text <b>here\t</b> a < b  c.</p><pre>a  b\n\tc</pre><p>Then <code>y  z</code>\r\nas well.</p></article></body></html>"
    assert single_spaced(text) == "<html><body><article><p>Some text <b>here </b> a < b c.</p><pre>a  b\n\tc</pre><p>Then <code>y  z</code> as well.</p></article></body></html>"
    assert extract(text, Options.of(output_format="markdown", fast=True, min_extracted_size=0, single_spaces=True))["output"].endswith("Then `y  z` as well.")


def test_closed_references_in_scripts_are_read():
    script = '{"@context": "https://schema.org", "@type": "Article", "headline": "A &amp;amp; B &lt; C &lt D"}'
    there = load(f'<html><head><script type="application/ld+json">{script}</script></head><body><p>Some text.</p></body></html>')
    with references(True):
        assert metadata(there)["title"] == "A &amp; B < C &lt D"


def test_dates_in_addresses():
    there = load("<html><body><p>Some text.</p></body></html>")
    for path, date in (("2022/1/9/x", "2022-01-09"), ("2022-01-09", "2022-01-09"), ("2022_01_09.html", "2022-01-09"), ("206533", None), ("2065-33", None)):
        assert metadata(there, f"https://example.org/{path}")["date"] == date
