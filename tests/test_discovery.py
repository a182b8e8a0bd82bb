"""URLs, feeds, sitemaps, robots files and links of pages."""

import pytest

from pagesieve.kernel import discovery as D
from pagesieve.kernel import urls as U
from pagesieve.kernel.fingerprint import file_name, fingerprint, parsed_hash, sample_tokens, similar_domains, simhash, similarity
from pagesieve.kernel.text import clean_lines, decode, is_image_name, is_noise, repair, trim

XML = '<?xml version="1.0" encoding="UTF-8"?>\n'


def test_urls():
    assert U.checked("https://github.com/some/thing") == ("https://github.com/some/thing", "github.com")
    assert U.checked("https://httpbin.org/redirect-to?url=http%3A%2F%2Fexample.org", strict=True) == ("https://httpbin.org/redirect-to", "httpbin.org")
    assert U.checked("https://www.un.org/en/about-us", language="en") and U.checked("https://www.un.org/en/about-us", language="de") is None
    assert U.cleaned("HTTPS://WWW.DWDS.DE:80/") == "https://www.dwds.de:80"
    assert not U.is_valid("http://1234") and U.is_valid("http://www.example.org/") and not U.is_valid("123://api.exe") and not U.is_valid(None)
    assert U.filtered(["https://www.sitemaps.org/de/", "https://www.sitemaps.org/terms.html"], "de") == ["https://www.sitemaps.org/de/"]
    assert U.is_navigation("https://www.example.org/category/news/") and U.is_not_crawlable("https://www.example.org/login")
    assert U.stripped("https://a.b/c//") == "a.b/c" and U.base_url("https://a.org/x?y") == "https://a.org"
    assert U.registered_domain("https://www.a.co.uk/x") == "a.co.uk" and U.domain("https://www2.b.org") == "b.org"
    assert U.normalized("https://x.org//a//b?utm_source=1&b=2&a=1#top") == "https://x.org/a/b?a=1&b=2#top"


def test_feeds():
    assert D.feed_links(None, "https://example.org") == [] and D.feed_links("<html></html>", "https://example.org") == []
    assert D.feed_links(f'{XML}<link type="application/atom+xml" rel="self" href="https://www.dwds.de/api/feed/x"/>', "https://www.dwds.de") == []
    assert D.feed_links(f'{XML}<link href="http://example.org/article1/"rest"/>', "http://example.org/", "http://example.org") == ["http://example.org/article1/"]
    assert D.feed_links(f"{XML}<link><![CDATA[http://example.org/article1/]]></link>", "http://example.org/") == ["http://example.org/article1/"]
    assert D.feed_links(f"{XML}<link>\r\n    https://www.ak-kurier.de/akkurier/x    </link>", "https://www.ak-kurier.de/") == ["https://www.ak-kurier.de/akkurier/x"]
    assert D.feed_links(f"{XML}<link>https://example.org</link>", "http://example.org") == []
    assert D.feed_links(f"{XML}<link>/api/feed/themenglossar/Corona</link>", "https://www.dwds.de", "https://www.dwds.de") == ["https://www.dwds.de/api/feed/themenglossar/Corona"]
    assert D.feed_links('{"items":[{"id":"https://www.example.org/1","title":"Test"}]}', "https://example.org") == ["https://www.example.org/1"]
    assert D.feed_links("{/}", "https://example.org") == []
    page = '<html><head><link rel="alternate" type="application/rss+xml" href="/feed.xml"/><link rel="alternate" type="text/xml" href="/comments/feed"/></head><body></body></html>'
    assert D.feeds_of_page(page, "https://example.org") == ["https://example.org/feed.xml"]
    assert D.feeds_of_page('<html><body><a href="https://example.org/feeds/posts/default/">f</a></body></html>', "https://example.org")


def test_sitemaps_and_robots():
    text = '<?xml version="1.0"?><urlset><url><loc>https://a.org/1</loc></url><url><loc><![CDATA[https://a.org/map.xml]]></loc></url><url><loc>https://other-place.com/2</loc></url></urlset>'
    assert D.sitemap_links("https://a.org/sitemap.xml", text, "https://a.org") == (["https://a.org/1"], ["https://a.org/map.xml"])
    assert D.sitemap_links("https://a.org/sitemap.xml", text, "https://a.org", external=True)[0] == ["https://a.org/1", "https://other-place.com/2"]
    assert not D.is_sitemap("http://x.org/sitemap.xml.gz", "\x1f\x8bABC") and not D.is_sitemap("http://x.org/map", "<html><head>") and D.is_sitemap("http://x.org/map", "http://x.org/1")
    lang = '<?xml version="1.0"?><urlset><url><loc>https://a.org/en/</loc><xhtml:link rel="alternate" hreflang="de" href="https://a.org/de/1"/></url></urlset>'
    assert D.sitemap_links("https://a.org/s.xml", lang, "https://a.org", language="de")[0] == ["https://a.org/de/1"]
    robots = "# s\nUser-agent: *\nDisallow: /private\n\nSITEMAP: https://a.org/s.xml # first\nSitemap: /t.xml\nSitemap: https://a.org/s.xml\n"
    assert D.robots_sitemaps(robots, "https://a.org") == ["https://a.org/s.xml", "https://a.org/t.xml"]
    assert D.robots_sitemaps("x" * 10_001, "https://a.org") == [] and D.robots_sitemaps(None, "x") == []
    rules = D.robots_rules(robots, "https://a.org/robots.txt")
    assert D.may_follow("https://a.org/x", "https://a.org", rules) and not D.may_follow("https://a.org/private/x", "https://a.org", rules)
    assert not D.may_follow("https://a.org/login", "https://a.org", None)


def test_page_links():
    page = '<html><body><a href="/a">1</a><a href="/a">1</a><a href="https://other.net/b">2</a><a href="mailto:x@y.z">3</a><a href="/pic.jpg">4</a><a rel="nofollow" href="/c">5</a></body></html>'
    assert D.page_links(page, "https://x.org/") == ["https://x.org/a", "https://other.net/b"]
    assert D.page_links(page, "https://x.org/", external=True) == ["https://other.net/b"] and D.page_links(page, "https://x.org/", external=False) == ["https://x.org/a"]
    assert D.refresh_target('<html><head><meta http-equiv="refresh" content="0; url=/new"/></head><body></body></html>', "https://x.org") == "https://x.org/new"
    assert D.refresh_target("<html></html>") is None
    assert D.reference_of("https://x.org/a/b") == "https://x.org/a" and D.reference_of("https://x.org") == "https://x.org"


@pytest.mark.parametrize(
    ("text", "hexadecimal"),
    [
        ("abcde ijk l, " * 10, "528497a1d07b66d6"),
        ("Hello world! This is a test string with some numbers 123.", "5efdce9f2b554683"),
        ("这是一个测试。我们在测试中文。", "ff377edee6edfb78"),
        ("Hello世界。This is混合文本!", "24979dc6c8a26a5"),
        ("Here is text.", "d2ff47ba297cc254"),
    ],
)
def test_fingerprints(text, hexadecimal):
    assert fingerprint(text) == hexadecimal and parsed_hash(hexadecimal) == simhash(text)


def test_hashes_and_names():
    assert file_name("abcde ijk l, " * 10) == "42LNugG3Sc95646i" and file_name("") == "uOHdo6wKo4IK0pkL" and file_name("This is a text.") == "qAgzZnskrcRgeftk"
    assert similarity(simhash("This is a text."), simhash("This is a test.")) == 0.84375
    assert simhash("") == 2**64 - 1 and parsed_hash("xyz") is None and parsed_hash(12) is None
    assert sample_tokens("a bb, (ccc) dd-d") == ["a", "bb", "ccc"]
    assert similar_domains("kleins-weindepot.de", "weindepot.info") and not similar_domains("kleins-weindepot.de", "eurosoft.net")


def test_text():
    import gzip
    import zlib

    assert trim("\t\tTest  Test\r\n") == "Test Test" and trim(None) == ""
    assert decode(gzip.compress(b"abc")) == "abc" and decode(zlib.compress(b"abc")) == "abc" and decode("été, où êtes-vous allés".encode("latin-1") * 20).startswith("été")
    assert decode(b"\xff\xfe\x00") is not None and decode(None) == ""
    assert repair("<!DOCTYPE html PUBLIC />\n<html></html>") == "\n<html></html>" and repair('<html lang="en"/>\n<p/>') == '<html lang="en">\n<p/>'
    assert is_noise("Facebook") and is_noise(" ") and is_noise("text\nTwitter") and not is_noise("Facebook is a company")
    assert is_image_name("PIC.PNG") and not is_image_name("test.txt") and not is_image_name("test.jpg" * 2000)
    assert clean_lines("a  b\n\n c ") == "a b\nc" and clean_lines(" a ", edges=True) == " a "
