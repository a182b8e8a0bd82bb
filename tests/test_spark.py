"""Functions, operators, sources and streams on a small session."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from pagesieve import functions as PF
from pagesieve import operators as O
from pagesieve.kernel.options import Options
from pagesieve.plans import registry
from pagesieve.operators.discovery import RULES
from pagesieve.sources import read_html_files, read_url_list, register, write_documents, write_files

ZERO = {"min_extracted_size": 0, "min_output_size": 0}


def column(spark, expression, *values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_text_columns(spark):
    assert column(spark, PF.trimmed("v"), "\t\tTest   Test\r\n", "a \x1cb", None) == ["Test Test", "a b", ""]
    assert column(spark, PF.has_chars("v"), "", "  ", "a", None) == [False, False, True, False]
    assert column(spark, PF.is_noise_line("v"), "Facebook", "x\nTwitter", "Facebook is big", None, "More on this now") == [True, True, False, True, True]
    assert column(spark, PF.is_image_name("v"), "PIC.PNG", "a.txt", "a.jpg" * 2000, None) == [True, False, False, False]
    assert column(spark, PF.clipped("v", 5), "abcdef", "abc") == ["abcd…", "abc"]
    assert column(spark, PF.heading_marks("v"), "1", "6", "9", "x", None) == ["#", "######", "##", "##", "##"]
    assert column(spark, PF.span_width("v"), "1", "12", "9007199254740991", "²", "2x", "", None) == [1, 12, 100, 1, 1, 1, 1]
    assert column(spark, PF.math_to_markdown("v"), "x \\(a+b\\) y", "\\[ c \\]") == ["x $a+b$ y", "\n$$\nc\n$$\n"]
    plain = ["Indu K Murthy", "https://example.com/a:b", "élan vital"]
    quoted = ["COP30: a guide", "#1 ranking", "true", "2024", "[draft]", 'say "hi": now']
    assert column(spark, PF.yaml_scalar("v"), *plain, *quoted) == [*plain, *map(json.dumps, quoted)]
    assert column(spark, PF.allowed_authors("v", ["A", "b"]), "a; B; c; d", "a") == ["c; d", None]
    assert column(spark, PF.license_from_link("v"), "https://creativecommons.org/licenses/by-nc-sa/4.0/", "x") == ["CC BY-NC-SA 4.0", None]
    assert column(spark, PF.lower_keys("v"), {"Content-Type": "x"}, kind="map<string,string>") == [{"content-type": "x"}]
    assert column(spark, PF.suitable_response(F.lit(200), "v"), "x" * 20, "short", None) == [True, False, False]
    assert column(spark, PF.exit_code("v", F.lit(200)), 0, 200, 100, kind="int") == [0, 126, 1]
    assert column(spark, PF.publisher(F.lit("Site "), "v"), "host", None) == ["Site (host)", "Site "]
    assert column(spark, PF.sample_tokens("v"), "a bb, (ccc) dd-d") == [["a", "bb", "ccc"]]


def test_hash_columns(spark):
    assert column(spark, PF.hash_from_hex("v"), "ffffffffffffffff", "528497a1d07b66d6") == [-1, 0x528497A1D07B66D6]
    assert column(spark, PF.hash_to_hex(PF.hash_from_hex("v")), "ffffffffffffffff", "24979dc6c8a26a5") == ["ffffffffffffffff", "24979dc6c8a26a5"]
    assert column(spark, PF.hamming_distance("v", F.lit(0).cast("long")), 7, -1, kind="long") == [3, 64]
    assert column(spark, PF.text_fingerprint("v"), "Here is text.", None) == ["d2ff47ba297cc254", None]
    assert column(spark, PF.content_file_name("v"), "This is a text.") == ["qAgzZnskrcRgeftk"]


def test_url_columns(spark):
    assert column(spark, PF.stripped_url("v"), "https://a.b/c//", "http://x.y") == ["a.b/c", "x.y"]
    assert column(spark, PF.domain("v"), "https://www2.B.org:80/x", "nothing") == ["b.org", None]
    assert column(spark, PF.crawl_reference("v"), "https://x.org/a/b", "https://x.org") == ["https://x.org/a", "https://x.org"]
    assert column(spark, PF.is_feed("v"), "<rss>", '<?xml version="1.0"?>', "<html>", None) == [True, True, False, False]
    assert column(spark, PF.robots_sitemaps("v"), "Sitemap: a # x\nsitemap : b\nSitemap: a\nAllow: c") == [["a", "b"]]
    assert column(spark, PF.clean_url("v"), "HTTPS://WWW.X.DE:80/", "mailto:a@b.c", "https://x.org/a.pdf") == ["https://www.x.de:80", None, None]
    assert column(spark, PF.similar_domains("v", F.lit("weindepot.info")), "kleins-weindepot.de", "eurosoft.net") == [True, False]


@pytest.fixture(scope="module")
def pages(spark):
    body = "A paragraph that is repeated on many pages of the same site, and that is long enough to count as one. "
    html = lambda i: f"<html><body><article><h1>Page {i}</h1><p>{body}</p><p>Only page {i} says this, in a sentence of its own.</p><a href='/p/{(i + 1) % 6}'>n</a></article></body></html>"
    return spark.createDataFrame([(i, f"https://x.org/p/{i}", html(i)) for i in range(6)] + [(6, None, None), (7, "https://x.org/e", "")], "page_id long, url string, html string")


def test_extract_pages(spark, pages):
    found = PF.extract_pages(pages, keep=("page_id",), output_format="json", fast=True, **ZERO)
    rows = {r.page_id: r for r in found.collect()}
    assert len(rows) == 8 and rows[6].status == "empty_tree" and rows[7].status == "too_short" and rows[0].status == "ok"
    assert json.loads(rows[1].output)["text"].startswith("Page 1\nA paragraph") and rows[1].blocks[0].tag == "head" and rows[1].blocks[0].level == 1
    assert found.columns[0] == "page_id" and "MapInArrow" in found._jdf.queryExecution().toString()
    assert found.select("status").where("status = 'ok'").count() == 6
    more = PF.extract_pages(pages.repartition(7), keep=("page_id",), fields=("text",), fast=True, **ZERO)
    assert {(r.page_id, r.text) for r in more.collect()} == {(r.page_id, r.text) for r in rows.values()}
    text = pages.select("page_id", PF.extract_text("html", "url", fast=True, **ZERO).alias("t"), PF.html_to_text("html").alias("all"), PF.baseline_text("html").alias("b")).where("page_id = 2").first()
    assert text.t.startswith("Page 2") and "Only page 2" in text.all and "Only page 2" in text.b
    meta = pages.select("page_id", PF.page_metadata("html", "url").alias("m")).where("page_id = 3").first().m
    assert meta.title == "Page 3" and meta.hostname == "x.org"


def test_render(spark, pages):
    once = PF.extract_pages(pages, keep=("page_id",), output_format="python", with_metadata=True, include_formatting=True, **ZERO).where("status = 'ok'").cache()
    for output in ("txt", "markdown", "json", "xml", "xmltei", "html", "csv"):
        options = {"output_format": output, "with_metadata": True, "include_formatting": True, **ZERO}
        direct = {r.page_id: r.output for r in PF.extract_pages(pages, keep=("page_id",), **options).where("status = 'ok'").collect()}
        again = {r.page_id: r.output for r in PF.render_documents(once, keep=("page_id",), **options).collect()}
        assert direct == again, output


def test_sql_names(spark, pages):
    from pagesieve.functions.sql import register

    names = register(spark)
    assert "page_blocks" in names
    pages.createOrReplaceTempView("web")
    r = spark.sql("SELECT page_text(html) AS t, page_all_text(html) AS a, page_baseline_text(html) AS b, page_readerable(html) AS r, text_language('the cat and the dog of the house') AS l, clean_url(url) AS u FROM web WHERE page_id = 1").first()
    assert "Only page 1" in r.t and "Only page 1" in r.a and "Only page 1" in r.b and r.r is False and r.l == "en" and r.u == "https://x.org/p/1"
    assert [x.tag for x in spark.sql("SELECT tag FROM web, LATERAL page_blocks(html, url) WHERE page_id = 1 ORDER BY pos").collect()] == ["p"]  # so short a page goes through the baseline
    assert [x.link for x in spark.sql("SELECT link FROM web, LATERAL page_link_rows(html, url) WHERE page_id = 1").collect()] == ["https://x.org/p/2"]
    assert spark.sql("SELECT count(*) FROM web, LATERAL page_nodes(html) WHERE page_id = 1 AND tag = 'p'").first()[0] == 2


def test_repeats(spark, pages):
    found = {r.page_id: r for r in O.extract_deduplicated(pages, Options.of(fast=True, **ZERO), key="page_id").collect()}
    assert [found[i].repeats for i in range(6)] == [0, 0, 0, 1, 1, 1] and "repeated on many" not in found[5].text and found[5].text.startswith("Page 5\nOnly")
    md = O.extract_deduplicated(pages, key="page_id", output_format="markdown", fast=True, **ZERO).where("page_id = 5").first()
    assert md.output == "# Page 5\n\nOnly page 5 says this, in a sentence of its own.\n\nn"
    same = spark.createDataFrame([(d, p, t) for d in range(5) for p, t in enumerate(["x" * 101, "short", "y" * 101 if d == 0 else "z"])], "doc_id long, pos int, text string")
    flagged = {(r.doc_id, r.pos): r for r in O.repeated_segments(same).collect()}
    assert [flagged[d, 0].is_repeat for d in range(5)] == [False, False, False, True, True] and not flagged[4, 1].is_repeat
    kept = {(r.doc_id, r.pos) for r in O.without_repeated_segments(same).collect()}
    assert kept == {k for k, r in flagged.items() if not r.is_repeat}
    twice = spark.createDataFrame([(1, 0, "a" * 60), (1, 1, "a" * 60), (1, 2, "b"), (1, 3, "b")], "doc_id long, pos int, text string")
    assert sorted(r.pos for r in O.without_adjacent_repeats(twice).collect()) == [0, 2, 3]
    assert "WindowGroupLimit" in O.without_repeated_segments(same)._jdf.queryExecution().toString()


def test_url_operators(spark):
    urls = spark.createDataFrame([("https://a.org/1/",), ("https://a.org/1/",), ("http://b.org/2",), ("https://a.org/3",), (None,)], "url string")
    bad = spark.createDataFrame([("http://a.org/1",)], "url string")
    assert {r.url for r in O.without_blacklisted(urls, bad).collect()} == {"http://b.org/2", "https://a.org/3"}
    assert {r.url for r in O.without_blacklisted(urls, filters=["org/3", "/2"]).collect()} == {"http://b.org/2", "https://a.org/3"}
    counts = {r.host: (r.urls, r.distinct_urls) for r in O.host_counts(urls).where("host IS NOT NULL").collect()}
    assert counts == {"a.org": (3, 2), "b.org": (1, 1)}
    rounds = O.fetch_rounds(urls.where("url IS NOT NULL").distinct(), sleep_time=2.0)
    assert {(r.url, r.round, r.not_before) for r in rounds.collect()} == {("https://a.org/1/", 0, 0.0), ("https://a.org/3", 1, 2.0), ("http://b.org/2", 0, 0.0)}
    assert [r.url for r in O.without_found_domains(urls.where("url IS NOT NULL"), bad).collect()] == ["http://b.org/2"]


def test_crawl_and_discovery(spark, pages):
    web = pages.where("url IS NOT NULL").select("url", "html")
    fetch = lambda todo: web.join(todo, "url", "left_semi")
    start = spark.createDataFrame([("https://x.org/p/0",)], "url string")
    frontier = O.crawl(start, fetch, max_rounds=3)
    assert {r.url: (r.visited, r.depth) for r in frontier.collect()} == {"https://x.org/p/0": (True, 0), "https://x.org/p/1": (True, 1), "https://x.org/p/2": (True, 2), "https://x.org/p/3": (False, 3)}
    rules = spark.createDataFrame([("https://x.org", [("/p/2", False)], None)], RULES)
    assert {r.url for r in O.crawl(start, fetch, max_rounds=3, rules=rules).collect()} == {"https://x.org/p/0", "https://x.org/p/1"}
    maps = spark.createDataFrame(
        [("https://x.org/sitemap.xml", '<?xml version="1.0"?><sitemapindex><loc>https://x.org/s2.xml</loc><loc>https://x.org/sitemap.xml</loc></sitemapindex>'), ("https://x.org/s2.xml", '<?xml version="1.0"?><urlset><loc>https://x.org/a</loc><loc>https://far-away.net/b</loc></urlset>')],
        "url string, html string",
    )
    found = O.discover_sitemaps(spark.createDataFrame([("https://x.org/sitemap.xml",)], "url string"), lambda todo: maps.join(todo, "url", "left_semi"))
    assert {(r.url, r.link) for r in found.collect()} == {("https://x.org/s2.xml", "https://x.org/a")}
    feeds = spark.createDataFrame([("https://x.org/feed", "<rss><link>https://x.org/news/1</link></rss>")], "url string, html string")
    assert [r.link for r in O.discover_feeds(feeds).collect()] == ["https://x.org/news/1"]


def web_of(spark, files):
    frame = spark.createDataFrame(list(files.items()), "url string, html string")
    return lambda todo: frame.join(todo, "url", "left_semi")


def test_find_feeds(spark):
    rss = "<rss><link>{0}/news/1</link><link>{0}/news/2</link></rss>"
    home = '<html><head><link rel="alternate" type="application/atom+xml" href="/f"></head><body><p>x</p></body></html>'
    files = {
        "https://feed.org/rss": rss.format("https://feed.org"),  # is a feed
        "https://page.org/": home, "https://page.org/f": rss.format("https://page.org"),  # names a feed
        "https://deep.org/news": home, "https://deep.org/f": rss.format("https://deep.org"),  # below a site: only links that hold the address
        "https://lost.org": home, "https://lost.org/f": rss.format("https://lost.org"),  # asked for a page that isn't there
        "https://none.org/": "<html><body>nothing</body></html>",
        "https://news.google.com/rss/search?q=site:none.org&hl=fr&scoring=n&num=100": rss.format("https://none.org"),
    }
    start = spark.createDataFrame([(u,) for u in ("https://feed.org/rss", "https://page.org/", "https://deep.org/news", "https://lost.org/gone", "https://none.org/", "https://dead.org/", "no address", None)], "url string")
    def got(**options):
        out = {}
        for r in O.find_feeds(start, web_of(spark, files), **options).collect():
            out.setdefault(r.url, set()).add(r.link)
        return out

    found = got()
    both = lambda site: {f"https://{site}/news/{i}" for i in (1, 2)}
    assert found == {"https://feed.org/rss": both("feed.org"), "https://page.org/": both("page.org"), "https://deep.org/news": both("deep.org"), "https://lost.org/gone": both("lost.org")}
    assert got(language="fr") == found | {"https://none.org/": both("none.org")}
    files["https://deep.org/f"] += "<link>https://deep.org/other/3</link>"
    assert got()["https://deep.org/news"] == both("deep.org")


def test_find_sitemaps(spark):
    head = '<?xml version="1.0"?>'
    listing = lambda *links: head + "<urlset>" + "".join(f"<url><loc>{x}</loc></url>" for x in links) + "</urlset>"
    files = {
        "https://a.org": "<html>up</html>", "https://a.org/robots.txt": "Sitemap: /maps.xml\n", "https://a.org/maps.xml": listing("https://a.org/m1.xml", "https://a.org/m2.xml"),
        "https://a.org/m1.xml": listing("https://a.org/news/1", "https://a.org/maps.xml"), "https://a.org/m2.xml": listing("https://a.org/news/2", "https://a.org/m3.xml"), "https://a.org/m3.xml": listing("https://a.org/y/3"),
        "https://b.org": "<html>up</html>", "https://b.org/sitemap_index.xml": listing("https://b.org/1"),
        "https://c.org/sitemap.xml": listing("https://c.org/1"),
    }
    fetch = web_of(spark, files)
    start = spark.createDataFrame([("https://a.org/news",), ("https://b.org/",), ("https://c.org/",), ("https://a.org/m3.xml",), (None,)], "url string")
    found = {(r.url, r.link) for r in O.find_sitemap_links(start, fetch).collect()}
    assert found == {("https://a.org/news", "https://a.org/news/1"), ("https://a.org/news", "https://a.org/news/2"), ("https://b.org/", "https://b.org/1"), ("https://c.org/", "https://c.org/1"), ("https://a.org/m3.xml", "https://a.org/y/3")}
    alive = O.find_sitemap_links(start, fetch, live=lambda urls: fetch(urls).select("url")).collect()
    assert {(r.url, r.link) for r in alive} == {x for x in found if "c.org" not in x[0]}
    few = O.find_sitemap_links(start.where("url = 'https://a.org/news'"), fetch, max_sitemaps=2).collect()
    assert [r.link for r in few] == ["https://a.org/news/1"]
    deep = {f"https://d.org/{i}.xml": listing(f"https://d.org/{i + 1}.xml", f"https://d.org/page/{i}") for i in range(25)}
    assert O.discover_sitemaps(spark.createDataFrame([("https://d.org/0.xml",)], "url string"), web_of(spark, deep)).count() == 25


def test_robots(spark):
    text = "User-agent: other\nDisallow: /\n\nUser-agent: *\nCrawl-delay: 3\nAllow: /a/open\nDisallow: /a\nDisallow:\n"
    rules = O.robots_rules(spark.createDataFrame([("https://x.org", text), ("https://y.org", "nothing here")], "base string, html string"))
    found = {r.base: r for r in rules.collect()}
    assert [(r.path, r.allow) for r in found["https://x.org"].rules] == [("/a/open", True), ("/a", False), ("", True)] and found["https://x.org"].delay == 3
    assert found["https://y.org"].rules == [] and found["https://y.org"].delay is None
    urls = spark.createDataFrame([("https://x.org/1",), ("https://x.org/2",), ("https://y.org/1",)], "url string")
    assert {(r.url, r.not_before) for r in O.fetch_rounds(urls, sleep_time=5.0, rules=rules).collect()} == {("https://x.org/1", 0.0), ("https://x.org/2", 3.0), ("https://y.org/1", 0.0)}
    links = "".join(f'<a href="{p}">x</a>' for p in ("/a/open/1", "/a/shut", "/b", "/login"))
    web = web_of(spark, {"https://x.org/robots.txt": text, "https://x.org/": f"<html><body>{links}</body></html>"})
    frontier = O.crawl(spark.createDataFrame([("https://x.org/",)], "url string"), web, max_rounds=1, ask_robots=True)
    assert {r.url for r in frontier.collect()} == {"https://x.org/", "https://x.org/a/open/1", "https://x.org/b"}


def test_crawl_follows_refreshes_and_languages(spark):
    page = lambda links, text="": "<html><body>" + f"<p>{text}</p>" + "".join(f'<a href="{x}">x</a>' for x in links) + "</body></html>"
    files = {
        "https://r.org/": '<html><head><meta http-equiv="refresh" content="0; url=/start"></head><body></body></html>',
        "https://r.org/start": page(["/1", "/de/2"]) + "<div class='box'><a href='/3'>x</a></div>",
        "https://r.org/1": page(["/4"], "der die das und ist nicht mit von den auf " * 5),
        "https://s.org/": '<html><head><meta http-equiv="refresh" content="0; url=https://s.org/nowhere"></head><body><a href="/lost">x</a></body></html>',
    }
    start = spark.createDataFrame([("https://r.org/",), ("https://s.org/",)], "url string")
    found = {r.url: r.visited for r in O.crawl(start, web_of(spark, files), max_rounds=3).collect()}
    assert found == {"https://r.org/": True, "https://r.org/start": True, "https://r.org/1": True, "https://r.org/de/2": False, "https://r.org/3": False, "https://r.org/4": False, "https://s.org/": True}
    from pagesieve.kernel.fallback import guess_language

    english = {r.url for r in O.crawl(start, web_of(spark, files), max_rounds=3, language="en", detect=guess_language, prune=["//div"]).collect()}
    assert english == {"https://r.org/", "https://r.org/start", "https://r.org/1", "https://s.org/"}
    known = spark.createDataFrame([("https://r.org/1",), ("https://r.org/old",)], "url string")
    seen = {r.url: r.visited for r in O.crawl(start, web_of(spark, files), max_rounds=1, known=known).collect()}
    assert seen["https://r.org/1"] and seen["https://r.org/old"] and not seen["https://r.org/3"]


def test_numbers_within_a_key(spark):
    rows = [(i, "hot" if i % 3 else f"k{i % 7}", None if i % 50 == 0 else i % 40) for i in range(600)] + [(600 + i, None, i) for i in range(5)]
    df = spark.createDataFrame(rows, "id int, k string, o int").repartition(7)
    want, last = {}, {}
    for i, k, _ in sorted(rows, key=lambda r: (r[2] is None, r[2] or 0, r[0])):
        want[i] = last[k] = last.get(k, 0) + 1
    found = O.numbered(df, F.col("k"), ("o", "id"), "n")
    assert found.columns == ["id", "k", "o", "n"] and {r.id: r.n for r in found.collect()} == want
    assert O.numbered(df.limit(0), F.col("k"), ("o",), "n").collect() == []


def extractions(df):
    return df._jdf.queryExecution().executedPlan().toString().count("MapInArrow")


def test_pages_are_parsed_once(spark, pages):
    """What is read several times is cut, so a plan holds the function at most once more, for the rendering."""
    assert extractions(O.extract_deduplicated(pages, Options.of(fast=True, **ZERO), key="page_id")) <= 1
    assert extractions(O.scored_candidates(PF.dom_nodes(pages))) == 0
    once = PF.extract_pages(pages, keep=("page_id",), fields=("blocks",), fast=True, **ZERO)
    assert extractions(O.without_repeated_segments(O.explode_blocks(once, "page_id"), order_by=("page_id", "pos"))) == 1
    assert extractions(registry.flagship(spark, SF)) == 1


def test_failures_tell_why(spark, pages, monkeypatch):
    from pagesieve.kernel import core

    monkeypatch.setattr(core, "cascade", lambda *a: 1 / 0)
    assert core.extract("<html><body><p>x</p></body></html>", Options.of(**ZERO)) | {"status": "error", "stage": "ZeroDivisionError: division by zero"} == core.extract("<html><body><p>x</p></body></html>", Options.of(**ZERO))
    monkeypatch.undo()
    whole = spark.read.parquet(f"{SF}/pages.parquet")
    assert PF.extract_pages(whole, keep=("page_id",), fields=("status", "stage")).where("status = 'error'").collect() == []


def test_crawl_stops_only_the_sites_at_the_cap(spark):
    links = lambda h, ns: "<html><body>" + "".join(f'<a href="https://{h}.org/p/{n}">{n}</a>' for n in ns) + "</body></html>"
    web = spark.createDataFrame([*((f"https://a.org/p/{i}", links("a", range(10 * i, 10 * i + 10))) for i in range(9)), *((f"https://b.org/p/{i}", links("b", [i + 1])) for i in range(9))], "url string, html string")
    start = spark.createDataFrame([("https://a.org/p/0",), ("https://b.org/p/0",)], "url string")
    frontier = O.crawl(start, lambda todo: web.join(todo, "url", "left_semi"), max_rounds=5, max_known=10).collect()
    assert {r.url for r in frontier if r.visited} == {"https://a.org/p/0", *(f"https://b.org/p/{i}" for i in range(5))}
    assert sorted(r.url for r in frontier) == sorted([*(f"https://a.org/p/{i}" for i in range(10)), *(f"https://b.org/p/{i}" for i in range(6))])


def test_crawl_query_goes_on_for_all_rounds(spark, tmp_path):
    rows = [(i, f"https://a.org/en/{i:02}", "<html><body><p>x</p></body></html>") for i in range(12)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert registry.QUERIES["crawl_frontier"](spark, str(tmp_path)).where("visited").count() == 10


@pytest.mark.parametrize("mode", ["fast", "default", "precision", "recall"])
def test_main_text_of_all_pages(spark, tmp_path, mode):
    line = "Line {} of this document is long enough to count as a paragraph of its own, and says something."
    bodies = [["A short text."], [line.format(i) for i in range(8)], [line.format(i) for i in (0, 1, 1, 2, 3, 4, 5)]]
    html = lambda ps: "<html><body><article>" + "".join(f"<p>{x}</p>" for x in ps) + "</article></body></html>"
    spark.createDataFrame([(i, f"https://x.org/en/{i}", html(ps)) for i, ps in enumerate(bodies)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    found = {r.page_id: r.body_text for r in registry.QUERIES[f"all_main_text_{mode}"](spark, str(tmp_path)).collect()}
    without_repeats = [[x for i, x in enumerate(ps) if not i or x != ps[i - 1]] for ps in bodies]
    assert found == {i: " ".join(ps) for i, ps in enumerate(without_repeats)}


def test_quality_counts_all_pages(spark, tmp_path):
    for name, rows, kind in (("pages", [(0, "https://x.org/en/1", "<html><body><article><p>A short text.</p></article></body></html>")], "page_id long, url string, html string"), ("documents", [(1, "A short text.", 13)], "doc_id long, text string, n_chars long")):
        spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / f"{name}.parquet"))
    found = registry.QUERIES["all_extraction_quality"](spark, str(tmp_path)).first()
    assert (found.tp, found.fn, found.fp, found.tn) == (2, 0, 0, 2)


def test_evaluation(spark):
    gold = spark.createDataFrame([("u1", ["good one", "good two"], ["bad"]), ("u2", ["x"], ["y"])], "url string, `with` array<string>, `without` array<string>")
    texts = spark.createDataFrame([("u1", "has  good\none and bad things"), ("u2", None)], "url string, text string")
    r = O.confusion(O.segment_hits(texts, gold)).first()
    assert (r.tp, r.fn, r.fp, r.tn) == (1, 2, 1, 1) and r.precision == 0.5 and abs(r.recall - 1 / 3) < 1e-9


def test_scoring(spark):
    html = "<html><body><div class='content'><p>" + "word " * 60 + "</p><p>" + "more " * 60 + "</p></div><div class='sidebar'><p>" + "less " * 20 + "</p></div></body></html>"
    nodes = PF.dom_nodes(spark.createDataFrame([(1, html)], "page_id long, html string"))
    best = O.best_candidates(O.scored_candidates(nodes)).first()
    from pagesieve.kernel.core import load
    from pagesieve.kernel.fallback import Candidates

    r = random.Random(12)
    tag = lambda depth: f"<{(t := r.choice(['div', 'td', 'article', 'ul']))} class='{r.choice(['post', 'menu', 'x'])}'>" + "".join(tag(depth + 1) if depth < 3 and r.random() < 0.5 else f"<p>{'one, two three ' * r.randrange(20)}<a>{'link ' * r.randrange(9)}</a></p>" for _ in range(3)) + f"</{t}>"
    some = [(i, f"<html><body>{tag(0)}{tag(0)}</body></html>") for i in range(20)]
    scores = O.scored_candidates(PF.dom_nodes(spark.createDataFrame(some, "page_id long, html string")))
    got = sorted((r.page_id, round(r.score, 6)) for r in scores.collect())
    assert got == sorted((i, round(s, 6)) for i, html in some for s in Candidates(load(html)).score.values()) and len(got) > 100
    assert nodes.where(F.col("node_id") == best.node_id).first().class_attr == "content"


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.html").write_text("<html><body><p>Grüße aus dem Text.</p></body></html>", encoding="utf-8")
    (tmp_path / "in" / "b.html").write_bytes(gzip.compress("<html><body><p>Packed été.</p></body></html>".encode()))
    files = read_html_files(spark, str(tmp_path / "in"))
    texts = {r.path.rpartition("/")[2]: r.html for r in files.collect()}
    assert "Grüße" in texts["a.html"] and "Packed été" in texts["b.html"]
    out = PF.extract_pages(files, html_col="html", url_col=None, keep=("path",), fields=("output",), output_format="txt", **ZERO)
    write_documents(out, str(tmp_path / "out"), "txt")
    assert {r.output for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"Grüße aus dem Text.", "Packed été."}
    names = {r.name: r.n_bytes for r in write_files(out, str(tmp_path / "files"), "txt", per_folder=1).collect()}
    assert {(tmp_path / "files" / n).read_text(encoding="utf-8") for n in names} == {"Grüße aus dem Text.", "Packed été."} and all(n.endswith(".txt") for n in names)
    mirrored = {r.name for r in write_files(out, f"file://{tmp_path}/mirror", "json", source_col="path", root=str(tmp_path)).collect()}
    assert mirrored == {"in/a.json", "in/b.json"} and (tmp_path / "mirror" / "in" / "b.json").read_text(encoding="utf-8") == "Packed été."
    (tmp_path / "urls.txt").write_text("https://a.org\n\nhttps://b.org\nhttps://a.org\n")
    assert [r.url for r in read_url_list(spark, str(tmp_path / "urls.txt")).orderBy("line").collect()] == ["https://a.org", "https://b.org"]
    register(spark)
    fixtures = {"https://a.org/1": "<html>" + "x" * 20, "https://a.org/2": {"status": 503, "body": "no"}, "https://b.org": {"body": "<html>moved" + "y" * 10, "url": "https://b.org/new", "headers": {"Server": "s"}}}
    got = spark.read.format("webpages").option("urls", json.dumps([*fixtures, "https://c.org"])).option("fixtures", json.dumps(fixtures)).load()
    rows = {r.url: r for r in got.collect()}
    assert rows["https://a.org/1"].html.startswith("<html>x") and rows["https://a.org/2"].html is None and not rows["https://a.org/2"].is_live
    assert rows["https://b.org"].final_url == "https://b.org/new" and rows["https://b.org"].headers == {"server": "s"} and rows["https://c.org"].status == 404


def test_dates_within_the_bounds_of_files(spark):
    dated = spark.createDataFrame([("<html><body><p>On 2019-03-04 and later text.</p></body></html>", d) for d in ("2020-01-01", "2018-01-01", None)], "html string, max_date string")
    found = PF.extract_pages(dated, url_col=None, keep=("max_date",), fields=("date",), date_col="max_date", with_metadata=True, fast=True, **ZERO)
    assert {r.max_date: r.date for r in found.collect()} == {"2020-01-01": "2019-03-04", "2018-01-01": None, None: "2019-03-04"}


def test_pauses_last_from_batch_to_batch(monkeypatch):
    from pagesieve.sources import web

    reader, slept = web.WebPagesReader({"sleep_time": "2"}), []
    monkeypatch.setattr(web.time, "sleep", slept.append)
    monkeypatch.setattr(reader, "_request", lambda url: (200, url, {}, b"<html>" + b"x" * 20))
    for url in ("https://a.org/1", "https://b.org/1", "https://a.org/2"):
        list(reader.read(web._Hosts([url])))
    assert len(slept) == 1 and 1.5 < slept[0] <= 2


def test_fetch_pages(spark):
    from pagesieve.sources import fetch_pages

    fixtures = json.dumps({"https://a.org/1": "<html>" + "x" * 20, "https://b.org": {"status": 500, "body": ""}})
    urls = spark.createDataFrame([("https://a.org/1",), ("https://a.org/1",), ("https://b.org",), (None,)], "url string")
    rows = {r.url: r for r in fetch_pages(urls, fixtures=fixtures).collect()}
    assert len(rows) == 2 and rows["https://a.org/1"].html.startswith("<html>x") and rows["https://a.org/1"].is_live and not rows["https://b.org"].is_live


def test_command_line(spark, tmp_path, capsys):
    from pagesieve import cli

    fixtures = tmp_path / "f.json"
    home = '<html><head><link rel="alternate" type="application/rss+xml" href="/rss"></head><body><a href="/a">a</a><a href="/shut/b">b</a></body></html>'
    fixtures.write_text(json.dumps({"https://x.org": home, "https://x.org/": home, "https://x.org/rss": "<rss><link>https://x.org/a</link></rss>", "https://x.org/robots.txt": "User-agent: *\nDisallow: /shut\nSitemap: https://x.org/sitemap.xml", "https://x.org/sitemap.xml": '<?xml version="1.0"?><urlset><loc>https://x.org/a</loc></urlset>', "https://x.org/a": "<html><body><article><p>The text of page a.</p></article></body></html>"}))
    config = tmp_path / "c.cfg"
    config.write_text("[DEFAULT]\nMIN_EXTRACTED_SIZE = 0\n")
    common = ["--fixtures", str(fixtures), "--config-file", str(config), "--sleep-time", "0"]
    assert cli.run(spark, cli.parse(["-u", "https://x.org/sitemap.xml", "--sitemap", "--list", *common])) == 0
    assert capsys.readouterr().out == "https://x.org/a\n"
    for mode in ("--feed", "--sitemap", "--explore"):
        assert cli.run(spark, cli.parse(["-u", "https://x.org/", mode, "--list", *common])) == 0
        assert capsys.readouterr().out == "https://x.org/a\n", mode
    assert cli.run(spark, cli.parse(["-u", "https://x.org/", "--crawl", "--list", "--rounds", "2", *common])) == 0
    assert capsys.readouterr().out == "https://x.org/\nhttps://x.org/a\n"
    assert cli.run(spark, cli.parse(["-u", "https://x.org/a", "--files", "-v", "--prune-xpath", "//h9", "--parallel", "2", "-o", str(tmp_path / "files"), *common])) == 0
    assert [p.read_text() for p in (tmp_path / "files").rglob("*.txt")] == ["The text of page a."]
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "deep" / "p.html").write_text("<html><body><article><p>A file below.</p></article></body></html>")
    assert cli.run(spark, cli.parse(["--input-dir", str(tmp_path / "in"), "--keep-dirs", "-o", str(tmp_path / "kept"), *common])) == 0
    assert (tmp_path / "kept" / "deep" / "p.txt").read_text() == "A file below."
    assert cli.run(spark, cli.parse(["-u", "https://x.org/a", "--fast", *common])) == 0
    assert capsys.readouterr().out == "The text of page a.\n"
    assert cli.run(spark, cli.parse(["-u", "https://x.org/a", "--json", "-o", str(tmp_path / "o"), *common])) == 0
    assert json.loads(spark.read.text(str(tmp_path / "o")).first()[0])["text"] == "The text of page a."
    assert cli.exit_status(0, 0) == 0 and cli.exit_status(1, 1) == 126 and cli.exit_status(1, 2) == 1
    for wrong in (["--feed"], ["--files", "-u", "x"], ["--keep-dirs", "-u", "x"], ["--precision", "--recall"], ["--version"]):
        with pytest.raises(SystemExit):
            cli.parse(wrong)
    capsys.readouterr()
    archived = tmp_path / "old.json"
    archived.write_text(json.dumps({"https://web.archive.org/web/20/https://x.org/gone": "<html><body><article><p>An older copy.</p></article></body></html>"}))
    assert cli.run(spark, cli.parse(["-u", "https://x.org/gone", "--archived", "--fast", "--fixtures", str(archived), *common[2:]])) == 0
    assert capsys.readouterr().out == "An older copy.\n"


def test_streams(spark, tmp_path, pages):
    from pagesieve import streaming as S

    source = str(tmp_path / "pages")
    pages.write.parquet(source)
    stream = spark.readStream.schema(pages.schema).parquet(source)
    q = S.extract_stream(stream, keep=("page_id",), fields=("status", "text"), fast=True, **ZERO).writeStream.format("memory").queryName("extracted").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = PF.extract_pages(pages, keep=("page_id",), fields=("status", "text"), fast=True, **ZERO)
    assert sorted(map(str, spark.table("extracted").collect())) == sorted(map(str, batch.collect()))
    texts = spark.createDataFrame([("x" * 101,)] * 5 + [("y",)] * 5, "text string")
    texts.coalesce(1).write.parquet(str(tmp_path / "texts"))
    stream = spark.readStream.schema("text string").parquet(str(tmp_path / "texts"))
    q = S.repeated_texts(stream).writeStream.format("memory").queryName("repeats").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("repeats").where("is_repeat").count() == 2 and spark.table("repeats").count() == 10
    times = spark.sql("SELECT 'https://a.org/' || id AS url, timestamp'2024-01-01 00:00:00' AS ts FROM range(3)")
    times.coalesce(1).write.parquet(str(tmp_path / "times"))
    stream = spark.readStream.schema(times.schema).parquet(str(tmp_path / "times"))
    q = S.polite_schedule(stream).writeStream.format("memory").queryName("schedule").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    at = sorted(r.fetch_at.timestamp() for r in spark.table("schedule").collect())
    assert [b - a for a, b in zip(at, at[1:], strict=False)] == [5.0, 5.0]
    q = S.first_seen_pages(stream.unionByName(stream), time_col="ts").writeStream.format("memory").queryName("first").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("first").count() == 3
    q = S.windowed_counts(stream, time_col="ts").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counts").first().n == 3
    events = spark.sql("SELECT 'u' AS who, timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, m) AS ts FROM VALUES (0), (3), (20) t(m)")
    events.coalesce(1).write.parquet(str(tmp_path / "events"))
    q = S.session_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events")), time_col="ts", by=("who",)).writeStream.format("memory").queryName("sessions").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("sessions").collect()) == [1, 2]


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_queries_match_their_sql(spark, name):
    import os

    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cursor = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(str(tuple(row[names.index(c)] for c in columns)) for row in cursor.fetchall())
    assert sorted(str(tuple(r[c] for c in columns)) for r in df.collect()) == want


def test_flagship(spark):
    assert registry.flagship(spark, SF).where("docs > 0").count() > 0
