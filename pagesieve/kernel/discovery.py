"""Links in pages, feeds, sitemaps and robots files."""

from __future__ import annotations

import json
import re
from urllib.robotparser import RobotFileParser

from . import urls
from .core import load
from .dom import Node
from .fingerprint import similar_domains

MAX_LINKS = 10**6

# Media types of feeds, patterns of links in feeds and sitemaps, usual places.
FEED_TYPES = frozenset(
    """application/atom application/atom+xml application/feed+json application/json application/rdf application/rdf+xml application/rss
    application/rss+xml application/x.atom+xml application/x-atom+xml application/xml text/atom text/atom+xml text/plain text/rdf
    text/rdf+xml text/rss text/rss+xml text/xml""".split()
)
FEED_START = re.compile(r"<(feed|rss|\?xml)")
FEED_LINK = re.compile(r'<link .*?href=".+?"')
FEED_HREF = re.compile(r'href="(.+?)"')
FEED_ELEMENT = re.compile(r"<link>(?:\s*)(?:<!\[CDATA\[)?(.+?)(?:\]\]>)?(?:\s*)</link>", re.DOTALL)
FEED_NAME = re.compile(r"\.(?:atom|rdf|rss|xml)$|\b(?:atom|rss)\b|\?type=100$|feeds/posts/default/?$|\?feed=(?:atom|rdf|rss|rss2)|feed$")
FEED_OF_COMMENTS = re.compile(r"\bcomments\b")
SITEMAP_LOC = re.compile(r"<loc>(?:<!\[CDATA\[)?(http.+?)(?:\]\]>)?</loc>")
SITEMAP_XHTML = re.compile(r"<xhtml:link.+?>", re.DOTALL)
SITEMAP_HREF = re.compile(r'href=["\'](.+?)["\']')
SITEMAP_START = re.compile(r"^.{0,5}<\?xml|<sitemap|<urlset")
SITEMAP_NAME = re.compile(r"\.xml(\..{2,4})?$|\.xml[?#]")
PLAIN_LINK = re.compile(r'https?://[^\s<"]+')
PLATFORMS = re.compile(r"(?:blogger|blogpost|ghost|hubspot|livejournal|medium|typepad|squarespace|tumblr|weebly|wix|wordpress)\.")
SITEMAP_GUESSES = ("sitemap.xml", "sitemap.xml.gz", "sitemap", "sitemap_index.xml", "sitemap_news.xml")


# ---- feeds ----------------------------------------------------------------------------------------------------------------


def is_feed(text: str) -> bool:
    return bool(FEED_START.match(text)) or "<rss" in text[:100] or "<feed" in text[:100]


def feed_entries(text: str) -> list[str]:
    """Raw links of an Atom, RSS or JSON feed, in order."""
    text = text.strip()
    if not is_feed(text):
        if text.startswith("{"):
            try:
                items = json.loads(text).get("items", [])
            except ValueError:
                return []
            return [u for u in (i.get("url") or i.get("id") for i in items if isinstance(i, dict)) if u is not None]
        return []
    if "<link " in text:
        found = (m[0] for m in FEED_LINK.finditer(text))
        return [FEED_HREF.search(x)[1] for x in found if "atom+xml" not in x and 'rel="self"' not in x][:MAX_LINKS]
    return [m[1].strip() for m in FEED_ELEMENT.finditer(text)][:MAX_LINKS] if "<link>" in text else []


def resolved_entries(links: list[str], base: str, domain: str, *, external: bool = False, language: str | None = None) -> list[str]:
    """Distinct links of a feed that lead to pages of a similar domain, sorted."""
    out: dict[str, None] = {}
    for item in sorted(set(links)):
        url = urls.absolute(base, item)
        found = urls.checked(url, language=language)
        if found is None:
            if "feedburner" in item or "feedproxy" in item:
                out[item] = None
        elif external or "feed" in url or similar_domains(domain, found[1]):
            out[found[0]] = None
    return list(out)


def feed_links(text: str | None, base: str, reference: str | None = None, **options) -> list[str]:
    found = resolved_entries(feed_entries(text or ""), base, urls.domain(base) or "", **options)
    return [u for u in found if u != reference and u.count("/") > 2]


def feeds_of_page(page: str, base: str, reference: str | None = None) -> list[str]:
    """Addresses of feeds that a page names: alternate links, else anchors that look like feeds."""
    tree = load(page)
    if tree is None:
        return []
    found = [n.get("href") for n in tree.below("link") if n.get("rel") == "alternate" and "href" in n.attrs and (n.get("type") in FEED_TYPES or FEED_NAME.search(n.get("href")))]
    found = found or [n.get("href") for n in tree.below("a") if FEED_NAME.search(n.get("href"))]
    out = []
    for link in dict.fromkeys(found):
        url = urls.cleaned(urls.absolute(base, link))
        if url and url != reference and urls.is_valid(url) and not FEED_OF_COMMENTS.search(url):
            out.append(url)
    return out


# ---- sitemaps and robots ----------------------------------------------------------------------------------------------------


def is_sitemap(url: str, text: str | None) -> bool:
    """False for an address of XML without a sitemap behind it, and for HTML."""
    if text is None or "<html" in text[:150].lower():
        return False
    return not re.search(r"\.xml\b", re.sub(r"\?.*$|#.*$", "", url)) or bool(SITEMAP_START.match(text))


def sitemap_entries(text: str, language: str | None = None) -> list[str]:
    """Raw links of a sitemap: those of one language if there are any, else all locations; plain text has one link after the other."""
    if not SITEMAP_START.match(text):
        return PLAIN_LINK.findall(text)[:MAX_LINKS]
    if language and "hreflang=" in text:
        wanted = re.compile(rf"hreflang=[\"']({re.escape(language)}.*?|x-default)[\"']", re.DOTALL)
        found = [h[1] for m in SITEMAP_XHTML.findall(text) if wanted.search(m) and (h := SITEMAP_HREF.search(m))]
        if found:
            return found[:MAX_LINKS]
    return SITEMAP_LOC.findall(text)[:MAX_LINKS]


def sitemap_links(url: str, text: str | None, base: str, *, external: bool = False, language: str | None = None) -> tuple[list[str], list[str]]:
    """(pages, nested sitemaps) of a sitemap, in order."""
    pages: list[str] = []
    maps: list[str] = []
    if not is_sitemap(url, text):
        return pages, maps
    own = urls.domain(base) or ""
    for raw in sitemap_entries(text or "", language):
        link = urls.cleaned(urls.absolute(base, raw), language)
        if raw == url or not link or not urls.language_fits(link, language):
            continue
        other = urls.domain(link)
        if other is None or not (external or PLATFORMS.search(other) or similar_domains(own, other)):
            continue
        (maps if SITEMAP_NAME.search(link) else pages).append(link)
    return pages, maps


def robots_sitemaps(text: str | None, base: str) -> list[str]:
    """Distinct sitemap addresses of a robots file."""
    if text is None:
        return []
    found = []
    for line in text.splitlines():
        name, colon, value = line.partition("#")[0].strip().partition(":")
        if colon and name.strip().lower() == "sitemap" and value.strip():
            found.append(urls.absolute(base, value.strip()))
    return list(dict.fromkeys(found))


def robots_rules(text: str | None, url: str = "") -> RobotFileParser | None:
    if not text:
        return None
    rules = RobotFileParser()
    rules.set_url(url)
    rules.parse(text.splitlines())
    return rules


# ---- pages --------------------------------------------------------------------------------------------------------------


def page_links(page: str | Node | None, url: str | None = None, *, external: bool | None = None, language: str | None = None, with_nav: bool = True) -> list[str]:
    """Distinct clean links of a page in order; ``external`` True keeps other domains only, False the own one only."""
    tree = page if isinstance(page, Node) or page is None else load(page)
    out: dict[str, None] = {}
    own = urls.registered_domain(url) if url else None
    for n in tree.below("a") if tree is not None else ():
        href = n.get("href")
        if not href or "nofollow" in n.get("rel"):
            continue
        if language and n.get("hreflang") and not n.get("hreflang").lower().startswith((language, "x-default")):
            continue
        found = urls.checked(urls.absolute(url, href) if url else href, language=language, with_nav=with_nav)
        if found and (external is None or own is None or (urls.registered_domain(found[0]) != own) == external):
            out[found[0]] = None
    return list(out)


def refresh_target(page: str, base: str | None = None) -> str | None:
    """Where a meta element redirects to."""
    if '"refresh"' not in page.lower():
        return None
    tree = load(page)
    for n in tree.below("meta") if tree is not None else ():
        if n.get("http-equiv").lower() == "refresh" and ";" in n.get("content"):
            target = n.get("content").split(";", 1)[1].strip()
            target = re.sub("^url=", "", target, flags=re.IGNORECASE).strip("'\"")
            return target if target.startswith("http") or not base else urls.absolute(base, target)
    return None


def reference_of(start: str) -> str:
    """What links must contain to stay within a crawl: the address up to its last slash."""
    return start.rsplit("/", 1)[0] if start.count("/") >= 3 else start


def may_follow(link: str, reference: str, rules: RobotFileParser | None = None) -> bool:
    return (rules is None or rules.can_fetch("*", link)) and reference in link and not urls.is_not_crawlable(link)
