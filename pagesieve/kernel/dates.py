"""The publication date of a page, as YYYY-MM-DD: meta elements, embedded data, time elements, the address, the text."""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterator

from .dom import Node
from .simple import json_scripts
from .text import trim

EARLIEST = "1995-01-01"
# Names of meta elements with dates, months by their names.
PUBLISHED_NAMES = frozenset(
    """article:published article:published_time article:created bt:pubdate citation_date citation_publication_date created created_time
    creationdatetime date date_published datepublished dc.created dc.date dc.date.created dc.date.issued dc.date.publication dcterms.created
    dcterms.date dcterms.issued dc:created dc:date displaydate doc_date gentime mediator_published_time og:article:published_time
    og:pubdate og:published_time originalpublicationdate parsely-pub-date pdate ptime pubdate publication_date publicationdate publish-date
    publish_date publish_time publishdate published-date published_date published_time rnews:datepublished sailthru.date
    shareaholic:article_published_time timestamp""".split()
)
MODIFIED_NAMES = frozenset(
    """article:modified article:modified_time datemodified dateupdate dc.modified dcterms.modified lastdate lastmod lastmodified last-modified
    modificationdate modified_time og:article:modified_time og:modified_time og:updated_time release_date revision_date updated_time""".split()
)
MONTHS = {
    name: number
    for number, names in enumerate(
        (
            "january jan januar jänner janvier enero gennaio januari janeiro",
            "february feb februar février febrero febbraio februari fevereiro",
            "march mar märz mrz mars marzo maart março",
            "april apr avril abril aprile",
            "may mai mayo maggio mei maio maj",
            "june jun juni juin junio giugno junho",
            "july jul juli juillet julio luglio julho",
            "august aug août agosto augustus augusti",
            "september sep sept septembre septiembre settembre setembro",
            "october oct oktober okt octobre octubre ottobre outubro",
            "november nov novembre noviembre novembro",
            "december dec dezember dez décembre diciembre dicembre dezembro",
        ),
        1,
    )
    for name in names.split()
}
_ISO = re.compile(r"(?<!\d)((?:19|20)\d{2})[-/.](\d{1,2})[-/.](\d{1,2})(?!\d)")
_COMPACT = re.compile(r"(?<!\d)((?:19|20)\d{2})(0[1-9]|1[0-2])([0-2]\d|3[01])(?!\d)")
_DAY_FIRST = re.compile(r"(?<!\d)(\d{1,2})[./-](\d{1,2})[./-]((?:19|20)\d{2})(?!\d)")
_SHORT_YEAR = re.compile(r"(?<![\d.])(\d{1,2})\.(\d{1,2})\.(\d{2})(?![\d.]*\d)")
_LONG_1 = re.compile(r"(?<!\d)(\d{1,2})(?:st|nd|rd|th|er|\.)?\s+(?:de\s+|of\s+)?([^\W\d_]{3,10})\.?,?\s+(?:de\s+)?((?:19|20)\d{2})(?!\d)")
_LONG_2 = re.compile(r"([^\W\d_]{3,10})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+((?:19|20)\d{2})(?!\d)")
_URL_DATE = re.compile(r"/((?:19|20)\d{2})[/_-](\d{1,2})[/_-](\d{1,2})(?:\D|$)")
_JSON_DATE = re.compile(r'"date(Published|Created|Modified)"\s*:\s*"([^"]+)"')


def valid(year: int, month: int, day: int, earliest: str = EARLIEST, latest: str | None = None) -> str | None:
    try:
        out = datetime.date(year, month, day).isoformat()
    except ValueError:
        return None
    return out if earliest <= out and (latest is None or out <= latest) else None


def dates_in(text: str, day_first: bool = True) -> Iterator[tuple[int, int, int]]:
    """Dates in any of the common notations, surer ones first."""
    for m in _ISO.finditer(text):
        yield int(m[1]), int(m[2]), int(m[3])
    for m in _LONG_1.finditer(text):
        if m[2].lower() in MONTHS:
            yield int(m[3]), MONTHS[m[2].lower()], int(m[1])
    for m in _LONG_2.finditer(text):
        if m[1].lower() in MONTHS:
            yield int(m[3]), MONTHS[m[1].lower()], int(m[2])
    for m in _DAY_FIRST.finditer(text):
        a, b = int(m[1]), int(m[2])
        yield (int(m[3]), b, a) if (day_first and b <= 12) or a > 12 else (int(m[3]), a, b)
    for m in _SHORT_YEAR.finditer(text):
        year = int(m[3])
        yield (2000 if year < 70 else 1900) + year, int(m[2]), int(m[1])
    for m in _COMPACT.finditer(text):
        yield int(m[1]), int(m[2]), int(m[3])


def first_date(text: str, earliest: str = EARLIEST, latest: str | None = None) -> str | None:
    return next(filter(None, (valid(*d, earliest, latest) for d in dates_in(text))), None)


def find_date(tree: Node, url: str | None = None, *, original: bool = True, extensive: bool = True, earliest: str = EARLIEST, latest: str | None = None, **_) -> str | None:
    """The date of publication (or, without ``original``, of the last change first), within bounds; None if nothing tells."""
    see = lambda text: first_date(text, earliest, latest)
    if url and (m := _URL_DATE.search(url)) and (found := valid(int(m[1]), int(m[2]), int(m[3]), earliest, latest)):
        return found
    published: list[str] = []
    modified: list[str] = []
    for n in tree.below("meta"):
        name = (n.get("property") or n.get("name") or n.get("itemprop") or n.get("http-equiv")).lower()
        value = n.get("content") or n.get("datetime")
        if name in PUBLISHED_NAMES and (found := see(value)):
            published.append(found)
        elif name in MODIFIED_NAMES and (found := see(value)):
            modified.append(found)
    for script in json_scripts(tree):
        for kind, value in _JSON_DATE.findall(script):
            if found := see(value):
                (modified if kind == "Modified" else published).append(found)
    for first, second in ((published, modified) if original else (modified, published),):
        if first or second:
            return (first or second)[0]
    stamps = [n for n in tree.below("time", "abbr") if n.tag == "time" or n.get("class") in ("published", "date-published", "time published")]
    stamps.sort(key=lambda n: "pubdate" not in n.attrs and not re.search("entry-date|published|post-date", n.get("class")))
    for n in stamps:
        if found := see(n.get("datetime") or n.get("title")) or see(trim(n.text())):
            return found
    for n in tree.below():
        names = f"{n.get('class')} {n.get('id')} {n.get('itemprop')}".lower()
        if n.tag in ("div", "span", "p", "li", "h2", "h3", "h4", "h5", "h6", "small", "em", "strong", "td") and re.search("date|posted|publi|meta|byline|time", names):
            text = trim(n.text())
            if len(text) < 200 and (found := see(text)):
                return found
    if extensive:
        for n in tree.below("p", "span", "div", "footer", "li", "b", "i", "font"):
            text = trim(n.text())
            if 6 <= len(text) <= 120 and (found := see(text)):
                return found
    return None
