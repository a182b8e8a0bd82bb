"""Language ID by cross-parsing entropy.

For each language a suffix automaton is built of a bounded sample of labelled texts. A text is parsed from left to right into the
longest phrases that occur in the sample; phrases times log2(sample length) per character estimate the cross entropy, and
the language that needs the fewest wins.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text_crc

UNKNOWN = "und"
#: Bounds of the training sample: languages (the most frequent labels), documents and characters of each language,
#: characters of one document.
MAX_LANGUAGES, SAMPLE_DOCS, SAMPLE_CHARS, DOC_CHARS = 256, 32, 20_000, 4_000
#: Training rows of the registered query: crc32 of the id modulo 4 is not 2.
FOLDS, HELD_OUT = 4, 2

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def normalized(text: str | None) -> str:
    """Lower-cased letters, with one blank for each run of anything else; empty if there is no letter."""
    out = _NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    return out if any(map(str.isalpha, out)) else ""


def suffix_automaton(text: str) -> dict:
    """The start state of the suffix automaton of ``text``; a state maps a character to the next state."""
    moves: list[dict] = [{}]
    link, length = [-1], [0]
    last = 0
    for ch in text:
        here = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and ch not in moves[p]:
            moves[p][ch] = here
            p = link[p]
        if p >= 0:
            q = moves[p][ch]
            if length[p] + 1 == length[q]:
                link[here] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(ch) == q:
                    moves[p][ch] = clone
                    p = link[p]
                link[q] = link[here] = clone
        last = here
    for state in moves:
        for ch, to in state.items():
            state[ch] = moves[to]
    return moves[0]


def phrase_count(start: dict, text: str) -> int:
    """Phrases of the greedy parse: longest matches, a character that never occurs being a phrase of its own."""
    n, state = 0, start
    for ch in text:
        to = state.get(ch)
        if to is None:
            if state is not start:
                n += 1
            to = start.get(ch)
            if to is None:
                n += 1
                to = start
        state = to
    return n + (state is not start)


#: Entries that the tables of all automata may have (5 bytes each); larger alphabets are parsed state by state.
TABLE_ENTRIES = 1 << 24
#: Texts up to which one step of the table is no faster than one text after the other.
FEW = 8


class Parser:
    """Counts phrases of many texts under all languages at once.

    All automata share one table of moves, completed by what follows the end of a phrase, and one of the phrases that a move ends, so a step
    moves every text under every language by one character. Texts are sorted by length: those not yet at their end are the first
    ones. The last few, and all texts if the tables would be too large, are parsed one by one; the counts are the same.
    """

    def __init__(self, sample: tuple[tuple[str, str], ...]):
        self.languages = [lang for lang, _ in sample]
        self.bits = [math.log2(len(text) + 2) for _, text in sample]
        self.starts = [suffix_automaton(text) for _, text in sample]
        self.code = {ch: i + 1 for i, ch in enumerate(sorted({ch for _, text in sample for ch in text}))}
        self.width = len(self.code) + 1
        self.table = None
        # A suffix automaton has less than two states for each character.
        if 2 * sum(len(text) for _, text in sample) * self.width <= TABLE_ENTRIES and all(ord(ch) < 1 << 16 for ch in self.code):
            self._fill()

    def _fill(self) -> None:
        number: dict[int, int] = {}
        order: list[dict] = []
        for start in self.starts:
            stack = [start]
            while stack:
                state = stack.pop()
                if id(state) not in number:
                    order.append(state)
                    number[id(state)] = len(order)
                    stack.extend(state.values())
        self.first = np.array([number[id(s)] - 1 for s in self.starts], np.int32)
        self.table = np.full((len(order), self.width), -1, np.int32)
        start = np.zeros(len(order), np.int32)
        for lane, root in enumerate(self.first.tolist()):
            start[root : int(self.first[lane + 1]) if lane + 1 < len(self.first) else len(order)] = root
        for state in order:
            for ch, to in state.items():
                self.table[number[id(state)] - 1, self.code[ch]] = number[id(to)] - 1
        again = self.table[start]  # where a new phrase would begin
        here = np.arange(len(order), dtype=np.int32)
        ended = self.table < 0
        self.ends = np.where(ended, (here != start)[:, None].astype(np.int8) + (again < 0), 0).astype(np.int8)
        self.table = np.where(ended, np.where(again < 0, start[:, None], again), self.table)
        self.places = np.zeros(1 << 16, np.int32)
        for ch, i in self.code.items():
            if ord(ch) < len(self.places):
                self.places[ord(ch)] = i
        self.starts = []

    def counts(self, texts: list[str]) -> np.ndarray:
        """Phrases of each text (row) under each language (column)."""
        if self.table is None:
            return np.array([[phrase_count(start, t) for start in self.starts] for t in texts], np.int64).reshape(len(texts), -1)
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        lengths = np.array([len(texts[i]) for i in order], np.int64)
        at = np.cumsum(lengths) - lengths
        points = np.frombuffer("".join([texts[i] for i in order]).encode("utf-32-le", "surrogatepass"), "<u4")
        codes = np.where(points < len(self.places), self.places[np.minimum(points, len(self.places) - 1)], 0)
        moves, ends, width = self.table.ravel(), self.ends.ravel(), self.width
        state = np.repeat(self.first[:, None], len(order), 1)
        found = np.zeros(state.shape, np.int64)
        going = len(order) - np.searchsorted(lengths[::-1], np.arange(int(lengths[0]) + 1 if len(order) else 1), "right")
        step = 0
        while step < len(going) and going[step] > FEW:
            n = int(going[step])
            index = state[:, :n] * width + codes[at[:n] + step]
            found[:, :n] += ends[index]
            state[:, :n] = moves[index]
            step += 1
        moves, ends = memoryview(moves), memoryview(ends)
        for doc in range(int(going[step]) if step < len(going) else 0):
            rest = (codes[at[doc] + step : at[doc] + lengths[doc]]).tolist()
            for lane in range(len(self.first)):
                now, n = int(state[lane, doc]), 0
                for c in rest:
                    i = now * width + c
                    n += ends[i]
                    now = moves[i]
                state[lane, doc] = now
                found[lane, doc] += n
        found += state != self.first[:, None]
        out = np.empty((len(texts), len(self.first)), np.int64)
        out[order] = found.T
        return out


@lru_cache(maxsize=1)
def _parser(sample: tuple[tuple[str, str], ...]) -> Parser:
    """Built once per process; only the last sample is kept."""
    return Parser(sample)


#: Characters of the texts that are parsed together, about.
TOGETHER = 1 << 22


def predictions(sample: tuple[tuple[str, str], ...], texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, score) of each text: the score is how far, in parts of it, the second language's entropy lies above the best one's."""
    out: list[tuple[str, float]] = []
    held: list[str] = []

    def parse() -> None:
        told = [i for i, t in enumerate(held) if t and sample]
        found = dict(zip(told, _parser(sample).counts([held[i] for i in told]), strict=True)) if told else {}
        for i, t in enumerate(held):
            if i not in found:
                out.append((UNKNOWN, 0.0))
                continue
            parser = _parser(sample)
            ranked = sorted((n * bits / len(t), lang) for n, bits, lang in zip(found[i].tolist(), parser.bits, parser.languages, strict=True))
            out.append((ranked[0][1], 1.0 if len(ranked) == 1 else 1.0 - ranked[0][0] / ranked[1][0]))
        held.clear()

    size = 0
    for text in texts:
        held.append(normalized(text))
        size += len(held[-1])
        if size > TOGETHER:
            parse()
            size = 0
    parse()
    return out


def predict(sample: tuple[tuple[str, str], ...], text: str | None) -> tuple[str, float]:
    return predictions(sample, [text])[0]


def training_sample(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> tuple[tuple[str, str], ...]:
    """((language, sample text), ...) of ``labelled`` rows, within the bounds above.

    The hashes of the texts of each language fall into as many classes as documents are wanted, and the smallest hash of each class is
    taken, those within the bound of one document first. Minima are aggregated before the shuffle, copies count once, and
    what reaches the driver is bounded by the parameters.
    """
    text = F.col(text_col).cast("string")
    rows = labelled.where(F.col(lang_col).isNotNull() & text.isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), text.alias("text"), F.xxhash64(text).alias("h"))
    part = F.pmod("h", F.lit(SAMPLE_DOCS).cast("long")).alias("at")
    least = F.min(F.struct((F.length("text") > DOC_CHARS).alias("long"), "h")).alias("least")
    narrow = rows.groupBy("lang", part).agg(F.count("*").alias("n"), least)
    common = F.broadcast(narrow.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).select("lang"))
    chosen = narrow.join(common, "lang").select("lang", "at", F.col("least.h").alias("h"))
    # At most MAX_LANGUAGES * SAMPLE_DOCS rows, so the broadcast is bounded.
    texts = rows.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "at").agg(F.min(F.substring("text", 1, DOC_CHARS)).alias("text"))
    out: dict[str, str] = {}
    for r in sorted(texts.collect(), key=lambda r: (r["lang"], r["at"])):
        if len(out.get(r["lang"], "")) < SAMPLE_CHARS:
            out[r["lang"]] = f"{out.get(r['lang'], '')} {normalized(r['text'])}"
    return tuple((lang, text[:SAMPLE_CHARS]) for lang, text in sorted(out.items()) if text.strip())


def in_training(doc_id: Column) -> Column:
    return id_text_crc(doc_id) % FOLDS != HELD_OUT


def detect(docs: DataFrame, sample, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, lang_pred, score.

    A null text, or one without letters, is ``und`` with score 0; so is every text if there is no sample. Equal entropies go to
    the language that sorts first. Whole texts are parsed; nothing is shuffled; an empty table gives no rows.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = predictions(sample, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(kernel, f"doc_id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double")


def keep_known_languages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the documents whose language stays unknown, with the same columns. Learns from their own labels.

    Without a labelled row to learn from, only null texts and those without letters go.
    """
    sample = training_sample(docs.where(in_training(F.col(id_col))), text_col=text_col, lang_col=lang_col)
    at = docs.columns.index(text_col)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            yield batch.filter(pa.array([lang != UNKNOWN for lang, _ in predictions(sample, texts)] if sample else [bool(normalized(t)) for t in texts], pa.bool_()))

    return docs.mapInArrow(kernel, docs.schema)
