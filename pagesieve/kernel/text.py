"""Strings and bytes: decoding, repair, white space, filters of lines."""

from __future__ import annotations

import gzip
import html as html_lib
import re
import unicodedata
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache
from html.entities import html5

from charset_normalizer import from_bytes

try:
    import zstandard
except ImportError:  # optional decoder
    zstandard = None
try:
    import brotli
except ImportError:  # optional decoder
    brotli = None

# Formats and patterns that results depend on.
DOCTYPE_TAG = re.compile("^< ?! ?DOCTYPE[^>]*/[^<>]*>", re.IGNORECASE)
FAULTY_HTML = re.compile(r"(<html.*?)\s*/>", re.IGNORECASE)
MARKUP = re.compile(r"(<!--.*?-->|<[^>]*>)")
NAMED = re.compile(r"&(#?\w+;?)")
REFERENCE = re.compile(r"(<(script|style)\b.*?</\2|<!--.*?-->)|&(#?\w+;?)", re.DOTALL | re.IGNORECASE)
SPACES = re.compile(r"(<(code|listing|pre|script|style|textarea|xmp)\b.*?</\2|<!--.*?-->|</?[a-z!?][^>]*>)|[ \t\n\r]+", re.DOTALL | re.IGNORECASE)
INVALID_XML_CHARS = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")
IMAGE_EXTENSION = re.compile(r"[^\s]+\.(avif|bmp|gif|hei[cf]|jpe?g|png|webp)(\b|$)", re.IGNORECASE)
SOCIAL_LINE = re.compile(
    r"\W*(Drucken|E-?Mail|Facebook|Flipboard|Google|Instagram|Linkedin|Mail|PDF|Pinterest|Pocket|Print|QQ|Reddit|Twitter|"
    r"WeChat|WeiBo|Whatsapp|Xing|Mehr zum Thema:?|More on this.{,8}$)$",
    re.IGNORECASE,
)
BLOCK_SEPARATOR = "␤"
MAX_IMAGE_URL = 8192


#: Whether character references without their semicolon count, as in browsers.
_OPEN_REFERENCES = ContextVar("open_references", default=True)


@contextmanager
def references(closed: bool) -> Iterator[None]:
    """Within it, with ``closed``, only known references that end in a semicolon stand for characters, as in XML."""
    token = _OPEN_REFERENCES.set(not closed)
    try:
        yield
    finally:
        _OPEN_REFERENCES.reset(token)


def _is_closed(reference: str) -> bool:
    return reference[-1] == ";" and (reference[0] == "#" or reference in html5)


def closed_only(text: str) -> str:
    """``text`` or markup in which, where only closed references count, the ampersands of all others are escaped; scripts and comments stay."""
    if _OPEN_REFERENCES.get() or all(map(_is_closed, NAMED.findall(text))):
        return text
    return REFERENCE.sub(lambda m: m[0] if m[1] or _is_closed(m[3]) else f"&amp;{m[3]}", text)


def unescaped(text: str) -> str:
    """What still looks like a reference in a text of a tree stands for a character, unless only closed ones count: those the parser has read."""
    return html_lib.unescape(text) if _OPEN_REFERENCES.get() else text


def script_text(text: str) -> str:
    """A text from a script, in which the parser reads no references: where :func:`unescaped` won't, the closed ones are read here."""
    return text if _OPEN_REFERENCES.get() else html_lib.unescape(NAMED.sub(lambda m: m[0] if _is_closed(m[1]) else f"&amp;{m[1]}", text))


def single_spaced(html: str) -> str:
    """Markup in which runs of white space in texts are one blank, as browsers show them; code and what is preformatted stays."""
    inner = html.rstrip()
    return SPACES.sub(lambda m: m[1] or " ", html) if any(s in inner for s in ("  ", "\t", "\n", "\r")) else html


def decompressed(data: bytes) -> bytes:
    """``data`` unpacked by gzip, Zstandard, Brotli or zlib if it is in one of these formats."""
    attempts = []
    if data.startswith(b"\x1f\x8b\x08"):
        attempts.append(gzip.decompress)
    if zstandard is not None and data.startswith(b"\x28\xb5\x2f\xfd"):
        attempts.append(lambda d: zstandard.ZstdDecompressor().decompressobj().decompress(d))
    if brotli is not None:
        attempts.append(brotli.decompress)
    attempts.append(zlib.decompress)
    for attempt in attempts:
        try:
            return attempt(data)
        except Exception:  # noqa: BLE001 not this format
            continue
    return data


def is_utf8(data: bytes) -> bool:
    try:
        data.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def guess_encodings(data: bytes) -> list[str]:
    """Likely encodings, best first; of long inputs both ends are looked at before the whole."""
    if is_utf8(data):
        return ["utf-8"]
    found = from_bytes(data if len(data) < 10_000 else data[:5_000] + data[-5_000:])
    if not len(found) and len(data) >= 10_000:
        found = from_bytes(data)
    return [g.encoding for g in found if g.encoding not in ("utf-8", "utf_8")]


def decode(data: bytes | str | None) -> str:
    if data is None or isinstance(data, str):
        return data or ""
    data = decompressed(bytes(data))
    for encoding in guess_encodings(data):
        try:
            return data.decode(encoding)
        except (LookupError, UnicodeDecodeError):
            continue
    return data.decode("utf-8", "replace")


def repair(html: str) -> str:
    """Takes out what breaks parsers: control characters, a malformed doctype, a self-closed html tag in the first lines."""
    html = INVALID_XML_CHARS.sub("", html)
    if "doctype" in html[:50].lower():
        first, _, rest = html.partition("\n")
        html = f"{DOCTYPE_TAG.sub('', first, count=1)}\n{rest}"
    if any("<html" in line and line.endswith("/>") for line in html[:100_000].splitlines()[:4]):
        html = FAULTY_HTML.sub(r"\1>", html, count=1)
    return html


def looks_dubious(html: str) -> bool:
    return "html" not in html[:50].lower()


def trim(text: str | None) -> str:
    """Runs of white space (Unicode) become one blank; none at the ends."""
    return " ".join(text.split()) if text else ""


@lru_cache(maxsize=1 << 14)
def _printable(ch: str) -> str:
    return ch if ch.isprintable() or ch.isspace() else ""


def without_controls(text: str) -> str:
    return text if text.isprintable() else "".join(map(_printable, text))


def nfc(text: str, form: str = "NFC") -> str:
    return unicodedata.normalize(form, text)


def has_chars(text: str | None) -> bool:
    return bool(text and not text.isspace())


def clean_line(line: str, keep_space: bool = False, edges: bool = False) -> str | None:
    """One line without control characters; white space collapsed unless ``keep_space``; with ``edges`` a blank at each end survives."""
    if _OPEN_REFERENCES.get():
        line = line.replace("&#13;", "\r").replace("&#10;", "\n").replace("&nbsp;", " ")
    out = without_controls(line)
    if keep_space:
        return out
    out = trim(out)
    if not out:
        return None
    if edges:
        return f"{' ' if line[0].isspace() else ''}{out}{' ' if line[-1].isspace() else ''}"
    return out


def clean_lines(text: str | None, keep_space: bool = False, edges: bool = False) -> str | None:
    """All lines of a text, cleaned; empty ones go, and so does the mark between blocks."""
    if text is None:
        return None
    if edges:
        return clean_line(text, keep_space, True)
    lines = (clean_line(line, keep_space) for line in text.splitlines())
    return "\n".join(line for line in lines if line).replace(BLOCK_SEPARATOR, "")


def is_noise(text: str | None) -> bool:
    """Empty, or with a line that only names a social network or a share action."""
    return not has_chars(text) or any(map(SOCIAL_LINE.match, text.splitlines()))


def is_image_name(src: str | None) -> bool:
    return src is not None and len(src) <= MAX_IMAGE_URL and bool(IMAGE_EXTENSION.search(src))


def acceptable_size(n: int, least: int = 10, most: int = 20_000_000) -> bool:
    return least <= n <= most
