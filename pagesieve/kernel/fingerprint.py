"""Fingerprints of texts: sampled tokens, a similarity hash, a bag-of-words file name."""

from __future__ import annotations

import base64
import difflib
import re
import string
import unicodedata
from functools import cache, lru_cache
from hashlib import blake2b

import numpy as np

BITS = 64
_EXTENSION = re.compile(r"\.[^/?#]{2,63}$")


@cache
def _punctuation() -> dict[int, str]:
    return {i: " " for i in range(0x110000) if unicodedata.category(chr(i)).startswith("P")}


def sample_tokens(text: str, wanted: int = BITS) -> list[str]:
    """Alphanumeric tokens, the longer ones only as long as they make half of ``wanted``; Unicode punctuation splits if ASCII doesn't."""

    def longest(tokens: list[str]) -> list[str]:
        kept: list[str] = []
        for more_than in (4, 3, 2, 1, 0):
            kept = [t for t in tokens if len(t) > more_than]
            if len(kept) >= wanted / 2:
                break
        return kept

    tokens = longest([t for t in (w.strip(string.punctuation) for w in text.split()) if t.isalnum()])
    return tokens or longest([t for t in text.translate(_punctuation()).split() if t.isalnum()])


@lru_cache(maxsize=1 << 14)
def _token_hash(token: str) -> int:
    return int.from_bytes(blake2b(token.encode(), digest_size=8).digest(), "big")


def simhash(text: str) -> int:
    """A bit is 1 if at least half of the tokens' hashes have it (all bits, without tokens)."""
    hashes = np.array([_token_hash(t) for t in sample_tokens(text)], "<u8")
    bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, BITS)
    return int(np.packbits(2 * bits.sum(0, dtype=np.int64) >= len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str) -> str:
    return f"{simhash(text):x}"


def parsed_hash(value: int | str | None) -> int | None:
    """A hash given as a number of 18 to 22 digits, as a string of digits, or as a hexadecimal string."""
    if isinstance(value, int):
        return value if 18 <= len(str(value)) <= 22 else None
    if not isinstance(value, str):
        return None
    if value.isdigit() and 18 <= len(value) <= 22:
        return int(value)
    try:
        return int(value, 16)
    except ValueError:
        return None


def hamming(a: int, b: int) -> int:
    return (a ^ b).bit_count()


def similarity(a: int, b: int) -> float:
    return (BITS - hamming(a, b)) / BITS


def bag_hash(text: str, size: int = 24) -> bytes:
    return blake2b(" ".join(sample_tokens(text)).strip().encode(), digest_size=size).digest()


def file_name(content: str) -> str:
    """A name of 16 characters from the bag of words of a text without its tags."""
    return base64.urlsafe_b64encode(bag_hash(re.sub(r"<[^>]+>", " ", content or "") if "<" in (content or "") else content or "", 12)).decode()


@lru_cache(maxsize=1024)
def similar_domains(one: str, other: str, least: float = 0.5) -> bool:
    """Whether two domain names agree in half of their characters, extensions aside."""
    return difflib.SequenceMatcher(None, _EXTENSION.sub("", one), _EXTENSION.sub("", other)).ratio() >= least
