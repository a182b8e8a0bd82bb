"""A Python data source for web pages: ``spark.read.format("webpages")``.

Options: ``urls`` (JSON array) or ``path`` (a text file of URLs, read by the reader's planner); ``fixtures`` (JSON object of url -> body, or url -> object
with status, body, url, headers) answers without any network; ``method`` GET or HEAD; ``timeout``, ``max_size``, ``min_size``,
``retries``, ``user_agents`` (one per line), ``cookie``, ``sleep_time`` and ``partitions``. URLs of one host stay in one partition
and are fetched one after the other with a pause.
"""

from __future__ import annotations

import json
import random
import time
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "url string, final_url string, status int, headers map<string,string>, data binary, html string, is_live boolean"
#: Statuses after which another try may help.
RETRY_STATUS = frozenset((429, 499, 500, 502, 503, 504, 509, 520, 521, 522, 523, 524, 525, 526, 527, 530, 598))
CHUNK = 128 * 1024


class _Hosts(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class WebPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "webpages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WebPagesReader(self.options)


class WebPagesReader(DataSourceReader):
    def __init__(self, options: dict):
        get = {k.lower(): v for k, v in options.items()}.get
        self.urls = json.loads(get("urls") or "[]")
        if not self.urls and get("path"):
            with open(get("path"), encoding="utf-8") as f:
                self.urls = [line.strip() for line in f if line.strip()]
        fixtures = get("fixtures")
        self.fixtures = json.loads(fixtures) if fixtures else None
        self.method = (get("method") or "GET").upper()
        self.timeout, self.retries = float(get("timeout") or 30), int(get("retries") or 2)
        self.max_size, self.min_size = int(get("max_size") or 20_000_000), int(get("min_size") or 10)
        self.agents = [a for a in (get("user_agents") or "").splitlines() if a.strip()]
        self.cookie, self.sleep_time = get("cookie"), float(get("sleep_time") or 5.0)
        self.n = int(get("partitions") or 8)
        self.last: dict[str, float] = {}  # when each host was asked, for as long as the reader lives

    def partitions(self) -> list[InputPartition]:
        dealt: list[list[str]] = [[] for _ in range(self.n)]
        for url in dict.fromkeys(self.urls):
            dealt[zlib.crc32(urlsplit(url).netloc.encode()) % self.n].append(url)
        return [_Hosts(part) for part in dealt if part] or [_Hosts([])]

    def read(self, partition: _Hosts) -> Iterator[tuple]:
        from ..kernel.text import decode

        for url in partition.urls:
            if self.fixtures is None:
                host = urlsplit(url).netloc
                wait = self.last.get(host, 0) + self.sleep_time - time.monotonic()
                if wait > 0 and host in self.last:
                    time.sleep(wait)
                self.last[host] = time.monotonic()
            status, final, headers, data = self._fetch(url)
            fits = status == 200 and data is not None and self.min_size <= len(data) <= self.max_size
            html = decode(data) if fits and self.method == "GET" else None
            yield url, final, status, {k.lower(): v for k, v in (headers or {}).items()}, data, html, status is not None and status < 400

    def _fetch(self, url: str) -> tuple[int | None, str | None, dict | None, bytes | None]:
        if self.fixtures is not None:
            found = self.fixtures.get(url)
            if found is None:
                return 404, url, {}, None
            if isinstance(found, str):
                found = {"body": found}
            return int(found.get("status", 200)), found.get("url", url), found.get("headers", {}), found.get("body", "").encode()
        return self._request(url)

    def _request(self, url: str) -> tuple[int | None, str | None, dict | None, bytes | None]:
        import ssl
        import urllib.error
        import urllib.request

        headers = {"User-Agent": random.choice(self.agents)} if self.agents else {}
        if self.cookie:
            headers["Cookie"] = self.cookie
        checked = True
        for attempt in range(self.retries + 1):
            context = None if checked else ssl._create_unverified_context()  # noqa: S323 the second try goes without certificates
            try:
                request = urllib.request.Request(url, headers=headers, method=self.method)  # noqa: S310
                with urllib.request.urlopen(request, timeout=self.timeout, context=context) as answer:  # noqa: S310
                    data, size = [], 0
                    while self.method == "GET" and (chunk := answer.read(CHUNK)):
                        size += len(chunk)
                        if size > self.max_size:
                            return answer.status, answer.url, dict(answer.headers), None
                        data.append(chunk)
                    return answer.status, answer.url, dict(answer.headers), b"".join(data)
            except urllib.error.HTTPError as e:
                if e.code not in RETRY_STATUS:
                    return e.code, url, dict(e.headers or {}), None
            except urllib.error.URLError as e:
                checked = checked and not isinstance(e.reason, ssl.SSLError)
            except (OSError, ValueError):
                return None, url, None, None
            time.sleep(self.timeout / 2 * 2**attempt / 10)
        return None, url, None, None


def fetch_pages(urls: DataFrame, *, url_col: str = "url", partitions: int | None = None, **options) -> DataFrame:
    """The same columns as the data source for the distinct addresses of a DataFrame of any length.

    Addresses are dealt by host, so that a host's pages are fetched by one task with a pause in between; nothing is listed on the driver. ``options``
    are those of the data source. A task that is tried again fetches its pages again.
    """
    settings = {k: str(v) for k, v in options.items() if v is not None}
    n = partitions or urls.sparkSession.sparkContext.defaultParallelism * 4
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    rows = urls.select(F.col(url_col).alias("url")).where("url IS NOT NULL").distinct().withColumn("host", host).repartition(n, "host").sortWithinPartitions("host", "url")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = WebPagesReader(settings)
        kinds = [pa.string(), pa.string(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.string(), pa.bool_()]
        names = ["url", "final_url", "status", "headers", "data", "html", "is_live"]
        for batch in batches:
            for found in reader.read(_Hosts(batch.column("url").to_pylist())):
                values = [list(v.items()) if isinstance(v, dict) else v for v in found]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

    return rows.select("url").mapInArrow(kernel, SCHEMA)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WebPages)
