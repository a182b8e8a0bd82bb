"""URLs: validation, cleaning, relations, kinds."""

from __future__ import annotations

import re
from urllib.parse import SplitResult, parse_qsl, urlencode, urljoin, urlsplit

# Parts of URLs that tell tracking, navigation, media and languages.
TRACKERS = re.compile(r"^(?:utm_|fb_|ga_|gs_|hsa_|mc_|mtm_|ns_|oly_|pk_|vero_|wt_)|^(?:dclid|fbclid|gclid|igshid|msclkid|yclid|ref|refsrc|source|session|sessionid|phpsessid|sid|aff|affiliate)$", re.IGNORECASE)
USEFUL = frozenset("aid article_id artnr id itemid objectid p page page_id pagenum pid post postid product_id id_article".split())
LANG_PARAMS = frozenset(("lang", "language", "locale"))
NAVIGATION = re.compile(r"/(?:archives?|auth[eo]r|blog|category|categories|kat|categoria|page|pages?|schlagwort|seite|tags?|themen?|thema|topics?|user)/|/page/[0-9]+|\?p=[0-9]+|\?page=", re.IGNORECASE)
NOT_CRAWLABLE = re.compile(r"/(?:login|signin|sign-in|signup|register|registrieren|anmelden|cart|checkout|wp-admin|wp-login)(?:\.php)?(?:/|$|\?)|mailto:|javascript:", re.IGNORECASE)
MEDIA = re.compile(r"\.(?:7z|aac|aif|apk|avi|bmp|bz2|css|deb|dmg|doc|docx|exe|flac|flv|gif|gz|ico|iso|jar|jpe?g|js|m4a|m4v|mkv|mov|mp3|mp4|mpe?g|ogg|pdf|png|ppt|pptx|rar|rpm|svg|swf|tar|tgz|tiff?|ttf|wav|webm|webp|wma|wmv|woff2?|xls|xlsx|zip)$", re.IGNORECASE)
PATH_LANG = re.compile(r"^/([a-z]{2})(?:[-_][a-z]{2,3})?(?:/|$)", re.IGNORECASE)
_HOST = re.compile(r"^(?:[a-z0-9_](?:[a-z0-9_-]{0,61}[a-z0-9_])?\.)+(?:[a-z]{2,63}|xn--[a-z0-9-]{1,59})\.?$", re.IGNORECASE)
_IP = re.compile(r"^(?:\d{1,3}\.){3}\d{1,3}$")
_SECOND_LEVEL = frozenset("ac co com edu gob gov net org or ne go".split())


def split(url: str | None) -> SplitResult | None:
    """The parts of a valid http(s) URL, else None."""
    try:
        parts = urlsplit(url or "")
        host = parts.hostname or ""
        parts.port  # noqa: B018 raises if it is not a number
    except ValueError:
        return None
    if parts.scheme not in ("http", "https") or len(parts.netloc) < 4:
        return None
    try:
        ascii_host = host.encode("idna").decode() if not host.isascii() else host
    except UnicodeError:
        return None
    return parts if _IP.match(ascii_host) or _HOST.match(ascii_host) else None


def is_valid(url: str | None) -> bool:
    return split(url) is not None


def base_url(url: str | None) -> str:
    parts = split(url)
    return f"{parts.scheme}://{parts.netloc}" if parts else ""


def host(url: str | None) -> str | None:
    parts = split(url)
    return parts.hostname if parts else None


def domain(url: str | None) -> str | None:
    """The host without a leading www."""
    found = host(url)
    return re.sub(r"^www[0-9]*\.", "", found) if found else None


def registered_domain(url: str | None) -> str | None:
    """The last labels of the host: two, or three below a generic second level such as ``co.uk``."""
    found = host(url)
    if not found or _IP.match(found):
        return found
    labels = found.rstrip(".").split(".")
    deep = len(labels) > 2 and len(labels[-1]) == 2 and labels[-2] in _SECOND_LEVEL
    return ".".join(labels[-3 if deep else -2 :])


def normalized(url: str | SplitResult, strict: bool = False, trailing_slash: bool = True) -> str:
    """Lower-case scheme and host, no tracking parameters, sorted query, collapsed slashes, no fragment of navigation."""
    parts = urlsplit(url) if isinstance(url, str) else url
    path = re.sub("/+", "/", parts.path)
    if not trailing_slash and path.endswith("/") and len(path) > 1:
        path = path.rstrip("/")
    query = []
    for k, v in parse_qsl(parts.query, keep_blank_values=True):
        if TRACKERS.search(k) or strict and k.lower() not in USEFUL | LANG_PARAMS:
            continue
        query.append((k, v))
    fragment = "" if strict or "=" in parts.fragment or TRACKERS.search(parts.fragment) else parts.fragment
    netloc = parts.netloc.lower()
    if parts.scheme == "http" and netloc.endswith(":80") or parts.scheme == "https" and netloc.endswith(":443"):
        netloc = netloc.rpartition(":")[0]
    out = f"{parts.scheme.lower()}://{netloc}{path}"
    if query:
        out += "?" + urlencode(sorted(query))
    return out + (f"#{fragment}" if fragment else "")


def language_fits(url: str, language: str | None, strict: bool = False) -> bool:
    """False if the path or a parameter names another language."""
    if not language:
        return True
    parts = urlsplit(url)
    for k, v in parse_qsl(parts.query):
        if k.lower() in LANG_PARAMS:
            return v[:2].lower() == language
    found = PATH_LANG.match(parts.path)
    return not found or found[1].lower() == language


def cleaned(url: str | None, language: str | None = None) -> str | None:
    """A URL without blanks, entities and noise around it, normalized."""
    if not url:
        return None
    url = re.sub(r"&amp;", "&", url.strip().strip("<>\"'"))
    url = re.sub(r"\s+", "", url)
    found = re.match(r"(?i)(https?)://", url)
    if not found:
        return None
    url = found[1].lower() + url[len(found[1]) :]
    try:
        parts = urlsplit(url)
    except ValueError:
        return None
    if parts.path == "/" and not parts.query:
        url = url.rstrip("/")
        parts = urlsplit(url)
    return normalized(parts)


def checked(url: str | None, *, strict: bool = False, language: str | None = None, with_nav: bool = True) -> tuple[str, str] | None:
    """(clean URL, domain) of a URL that leads to a web page, else None."""
    url = cleaned(url)
    parts = split(url)
    if parts is None or MEDIA.search(parts.path) or not language_fits(url, language):
        return None
    if not with_nav and is_navigation(url):
        return None
    out = normalized(parts, strict)
    return out, domain(out) or ""


def absolute(base: str, url: str) -> str:
    """``url`` against ``base``, protocol-relative links included; links of other schemes stay."""
    if url.startswith("{"):
        return url
    return urljoin(base.rstrip("/") + "/" if "/" not in base[8:] else base, url)


def is_navigation(url: str) -> bool:
    return bool(NAVIGATION.search(url))


def is_not_crawlable(url: str) -> bool:
    return bool(NOT_CRAWLABLE.search(url) or MEDIA.search(urlsplit(url).path))


def filtered(urls: list[str], pattern: str | None) -> list[str]:
    """Distinct URLs that hold ``pattern``, sorted; feeds of third parties stay."""
    kept = [u for u in urls if not pattern or pattern in u or "feedburner" in u or "feedproxy" in u]
    return sorted(set(kept))


def stripped(url: str) -> str:
    """Without scheme and trailing slashes: what blacklists compare."""
    return re.sub(r"^https?://|/+$", "", url)
