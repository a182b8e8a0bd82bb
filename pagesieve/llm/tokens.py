"""Token counts and token ids by public tokenizers, in Arrow functions.

Texts are encoded in batches that hold about the same number of bytes; a long text is split where the tokenizer's own
pre-tokenizer cuts in any case, so that counts of the pieces add up to the count of the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER, LIMIT = "byte_bpe_50k.json", 512
#: Bytes of one batch for the library, and of a piece of a long text, about.
BATCH_BYTES, PIECE_CHARS = 1 << 20, 1 << 16
#: Where a pre-token ends whatever is around: before a blank or newline that follows anything but white space (whitespace is the start
#: of a pre-token or one of its own, never inside), and after a full-width or CJK mark that a CJK letter follows, as marks and letters
#: never share a pre-token. What is on either side is cut alike without the other. Characters whose class changed between
#: versions of Unicode, and the apostrophe, which begins contractions, are left out.
SAFE = re.compile(r"(?<=[^\s\u180e\u200b\ufeff])(?=[ \n])|(?<=[\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f])(?=[\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3])")


@cache
def load(name: str):
    """The tokenizer of a file, once per process, on one thread."""
    import os

    path = public_tokenizers.path(name)
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if name.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def lengths(name: str, texts: list[str]) -> list[int]:
    """Token counts of ``texts`` without added special tokens."""
    tokenizer = load(name)
    if name.endswith(".model"):
        return [len(ids) for ids in tokenizer.encode(texts, num_threads=1)]
    return [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """``text`` in pieces of ``size`` characters or somewhat more, cut at safe boundaries only.

    A run of letters without any blank or mark is one pre-token to the library, and stays one piece.
    """
    at = 0
    while len(text) - at > size and (cut := SAFE.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def _counted(name: str, limit: int):
    splits = name == TOKENIZER  # the boundaries hold for this pre-tokenizer

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, n_bytes = [0] * len(batch), []
            waiting: list[tuple[int, str]] = []
            held = 0

            def encode() -> None:
                for (row, _), n in zip(waiting, lengths(name, [x for _, x in waiting]), strict=True):  # noqa: B023
                    totals[row] += n  # noqa: B023
                waiting.clear()  # noqa: B023

            for row, value in enumerate(batch.column("text")):
                text = value.as_py() or ""
                n_bytes.append(len(text.encode()))
                for piece in pieces(text) if splits else [text]:
                    waiting.append((row, piece))
                    held += len(piece.encode())
                    if held >= BATCH_BYTES:
                        encode()
                        held = 0
            encode()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(totals, pa.int64()), pa.array([n > limit for n in totals], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return kernel


def count_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_tokens, over_limit.

    A null text counts as empty: 0 bytes, 0 tokens. Special strings inside texts are what the library makes of them by
    default. Rows stay in place: nothing is shuffled, repeated rows and null ids stay as they are, and an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(_counted(tokenizer, limit), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


#: Texts of these characters only are cut alike by any implementation of the pre-tokenizer's pattern.
PLAIN = re.compile(r"[\t\n\r -~¡-ÿ]*")


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 itself, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@cache
def _same_vocabulary(name: str):
    """The vocabulary of a byte-level BPE file as ranks for the faster of the two libraries, or None for a file of another kind."""
    import json

    import tiktoken

    if not name.endswith(".json"):
        return None
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        data = json.load(f)
    model, cut = data["model"], data.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or data.get("normalizer"):
        return None
    byte_of, special = _byte_of(), {t["content"] for t in data.get("added_tokens", ())}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class IdEncoder:
    """Token ids as unsigned little-endian integers of ``width`` bytes.

    Plain texts go through the same vocabulary in tiktoken, which takes a quarter of the time for the same ids; texts that may
    hold special strings, or characters whose class may differ between the libraries, go through tokenizers.
    """

    def __init__(self, name: str = TOKENIZER, width: int = 4):
        self.name, self.fast, self.kind = name, _same_vocabulary(name), f"<u{width}"

    def __call__(self, text: str) -> bytes:
        if self.fast is not None and "<|" not in text and PLAIN.fullmatch(text):
            parts = [self.fast.encode_ordinary(p) for p in pieces(text)]
        else:
            split = pieces(text) if self.fast is not None else [text]
            parts = [e.ids for e in load(self.name).encode_batch_fast([*split], add_special_tokens=False)]  # loaded when first needed
        return b"".join(np.array(ids, self.kind).tobytes() for ids in parts)
