"""Paginated candle source as a Python data source.

``spark.read.format("candles").option("url", ...)``: one partition for each page of
at most ``page`` candles (300 by default).  The url holds ``{start}`` and ``{end}``
(epoch seconds); http(s) addresses are fetched with retries and growing pauses, others
are read as files.  A page is a JSON list of [time, low, high, open, close, volume];
pages that can't be had are skipped, rows are deduplicated by the reader's user with
``dropDuplicates(["ts"])``.
"""

from __future__ import annotations

import json
import time
import urllib.request
from datetime import UTC, datetime

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAX_PAGE = 300


class Page(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class CandleReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.start, self.end = options["url"], int(options["start"]), int(options["end"])
        self.step = int(options.get("granularity", 3600))
        self.page = min(int(options.get("page", MAX_PAGE)), MAX_PAGE)
        self.retries, self.pause = int(options.get("retries", 3)), float(options.get("pause", 1.0))

    def partitions(self) -> list[Page]:
        span = self.page * self.step
        return [Page(t, min(t + span, self.end)) for t in range(self.start, self.end, span)]

    def _text(self, url: str) -> str | None:
        for attempt in range(self.retries):
            try:
                if url.startswith(("http://", "https://")):
                    with urllib.request.urlopen(url, timeout=20) as r:  # noqa: S310
                        return r.read().decode()
                with open(url, encoding="utf-8") as f:
                    return f.read()
            except OSError:
                if attempt + 1 < self.retries:
                    time.sleep(self.pause * 2**attempt)
        return None

    def read(self, partition: Page):
        text = self._text(self.url.format(start=partition.start, end=partition.end))
        try:
            rows = json.loads(text) if text is not None else []
        except ValueError:
            rows = []
        for at, low, high, first, last, volume in rows:
            if partition.start <= int(at) < partition.end:
                yield datetime.fromtimestamp(int(at), UTC).replace(tzinfo=None), float(first), float(high), float(low), float(last), float(volume)


class CandleSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "candles"

    def schema(self) -> str:
        return "ts timestamp_ntz, open double, high double, low double, close double, volume double"

    def reader(self, schema) -> CandleReader:
        return CandleReader(self.options)
