"""Structured Streaming: extraction, duplicates within a watermark, repetition counts and politeness as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.columns import host, trimmed
from ..functions.pages import extract_pages


def extract_stream(pages: DataFrame, **options) -> DataFrame:
    """A stream of pages extracted row by row; no state."""
    return extract_pages(pages, spread=False, **options)


def first_seen_pages(pages: DataFrame, *, time_col: str, delay: str = "1 day", key_cols: tuple[str, ...] = ("url",)) -> DataFrame:
    """Pages whose key was not seen within the watermark; state is dropped behind it."""
    return pages.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(list(key_cols))


def windowed_counts(events: DataFrame, *, time_col: str, window: str = "5 minutes", slide: str | None = None, delay: str = "10 minutes", by: tuple[str, ...] = ()) -> DataFrame:
    """Counts per window (tumbling, or sliding with ``slide``) and group, late rows accepted up to ``delay``."""
    span = F.window(time_col, window, slide) if slide else F.window(time_col, window)
    return events.withWatermark(time_col, delay).groupBy(span, *by).agg(F.count("*").alias("n"))


def session_counts(events: DataFrame, *, time_col: str, by: tuple[str, ...], gap: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Counts per session of a group: rows that follow one another within ``gap``. Works on batches as on streams."""
    return events.withWatermark(time_col, delay).groupBy(F.session_window(time_col, gap).alias("session"), *by).agg(F.count("*").alias("n"))


def repeated_texts(segments: DataFrame, *, text_col: str = "text", min_size: int = 100, max_repetitions: int = 2, timeout_ms: int | None = None) -> DataFrame:
    """(hash, text, occurrence, is_repeat): the running number of each text, kept as a count per hash.

    With ``timeout_ms`` counts that long untouched are forgotten, which bounds the state of a query that never ends; a query with the trigger
    availableNow must go without, as it would wait for timeouts for ever.
    """

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = state.get[0] if state.exists else 0
        for pdf in batches:
            numbers = range(seen + 1, seen + len(pdf) + 1)
            seen += len(pdf)
            long = pdf["text"].str.len() > min_size
            yield pd.DataFrame({"hash": key[0], "text": pdf["text"].values, "occurrence": list(numbers), "is_repeat": [bool(is_long) and n > max_repetitions + 1 for is_long, n in zip(long, numbers, strict=True)]})
        state.update((seen,))
        if timeout_ms:
            state.setTimeoutDuration(timeout_ms)

    rows = segments.select(F.sha2(trimmed(text_col), 256).alias("hash"), trimmed(text_col).alias("text"))
    return rows.groupBy("hash").applyInPandasWithState(count, "hash string, text string, occurrence long, is_repeat boolean", "seen long", "append", GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout)


def polite_schedule(urls: DataFrame, *, url_col: str = "url", time_col: str = "ts", sleep_time: float = 5.0, timeout_ms: int | None = None) -> DataFrame:
    """(url, host, fetch_at): the earliest time for each URL so that fetches of one host lie ``sleep_time`` apart; the last one is the host's state.

    The URLs of a host that one trigger brings are ordered by time. With ``timeout_ms`` hosts that long untouched are forgotten (see :func:`repeated_texts`).
    """

    def schedule(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        whole = pd.concat(list(batches)).sort_values("ts", kind="stable")
        out = []
        for at in whole["ts"]:
            last = at.timestamp() if last is None else max(at.timestamp(), last + sleep_time)
            out.append(pd.Timestamp(last, unit="s"))
        yield pd.DataFrame({"url": whole["url"].values, "host": key[0], "fetch_at": out})
        if last is not None:
            state.update((last,))
            if timeout_ms:
                state.setTimeoutDuration(timeout_ms)

    rows = urls.select(F.col(url_col).alias("url"), host(url_col).alias("host"), F.col(time_col).alias("ts"))
    return rows.groupBy("host").applyInPandasWithState(schedule, "url string, host string, fetch_at timestamp", "last double", "append", GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout)
