"""A site's daily pages as a data source, for batches and streams.

    spark.dataSource.register(daily_pages())
    spark.read.format("daily_pages").options(site="http://...", first="2024-01-01", last="2024-01-07").load()

One partition per day, so each day is fetched, and tried again, by a task of
its own.  As a stream the source goes on from the day after the last one it
has committed, up to yesterday or to ``last``.
"""

from __future__ import annotations

import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tavola.functions import values as V

SCHEMA = "path string, date string, content binary, tries int"


@dataclass
class Day(InputPartition):
    """A day's page; ``page`` is its name on the site."""

    date: str
    url: str


def page_of(day: date) -> str:
    """The site has a page per day of the week, the last one first in the table."""
    return V.DAY_PAGES[6 - day.weekday()]


def fetch(url: str) -> bytes:
    with urllib.request.urlopen(url, timeout=60) as answer:  # noqa: S310
        return answer.read()


class _Pages:
    """What both readers share: options, the days of a range, and reading one day."""

    def __init__(self, options: dict, get: Callable[[str], bytes], pause: Callable[[float], None]):
        self.site = options["site"].rstrip("/")
        self.encoding = options.get("encoding", "windows-1250")
        self.most = int(options.get("tries", "4"))
        self.wait = float(options.get("wait", "1"))
        self.skip = options.get("onerror", "fail") == "skip"
        self.get, self.pause = get, pause

    def days(self, first: date, last: date) -> list[Day]:
        """Both ends included."""
        every = (first + timedelta(days=i) for i in range((last - first).days + 1))
        return [Day(str(d), f"{self.site}/{page_of(d)}.htm") for d in every]

    def rows(self, day: Day) -> Iterator[tuple]:
        """The page as UTF-8, at the try that it came; each try waits twice as long as the one before.  If none brings it, an error, or no row if ``onError`` is ``skip``."""
        for n in range(1, self.most + 1):
            try:
                text = self.get(day.url).decode(self.encoding)
                yield day.url, day.date, text.encode(), n
                return
            except OSError:  # of networks; a page that cannot be decoded is an error at once
                if n == self.most and not self.skip:
                    raise
                if n < self.most:
                    self.pause(self.wait * 2 ** (n - 1))


class _Reader(DataSourceReader):
    def __init__(self, pages: _Pages, first: date, last: date):
        self.pages, self.first, self.last = pages, first, last

    def partitions(self) -> list[Day]:
        return self.pages.days(self.first, self.last)

    def read(self, partition: Day) -> Iterator[tuple]:
        return self.pages.rows(partition)


class _StreamReader(DataSourceStreamReader):
    """An offset is the first day that is not read yet."""

    def __init__(self, pages: _Pages, first: date, until: Callable[[], date]):
        self.pages, self.first, self.until = pages, first, until

    def initialOffset(self) -> dict:
        return {"day": str(self.first)}

    def latestOffset(self) -> dict:
        return {"day": str(max(self.first, self.until() + timedelta(days=1)))}

    def partitions(self, start: dict, end: dict) -> list[Day]:
        return self.pages.days(date.fromisoformat(start["day"]), date.fromisoformat(end["day"]) - timedelta(days=1))

    def read(self, partition: Day) -> Iterator[tuple]:
        return self.pages.rows(partition)

    def commit(self, end: dict) -> None:
        pass


def daily_pages(get: Callable[[str], bytes] = fetch, name: str = "daily_pages", today: Callable[[], date] = date.today, pause: Callable[[float], None] = time.sleep) -> type[DataSource]:
    """The source, to be registered; ``get`` brings a page's bytes and goes to the executors.

    Options: ``site``; ``first`` and ``last`` (days; a batch without them has
    the week up to yesterday, a stream needs ``first``); ``tries`` (4) and
    ``wait`` (1 second before the second try); ``encoding`` (windows-1250);
    ``onError``: ``fail`` or ``skip``.
    """

    class DailyPages(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def _ends(self) -> tuple[date | None, date | None]:
            options = {k.lower(): v for k, v in self.options.items()}
            first, last = (date.fromisoformat(options[k]) if options.get(k) else None for k in ("first", "last"))
            return first, last

        def _pages(self) -> _Pages:
            return _Pages({k.lower(): v for k, v in self.options.items()}, get, pause)

        def reader(self, schema) -> DataSourceReader:
            first, last = self._ends()
            last = last or today() - timedelta(days=1)
            return _Reader(self._pages(), first or last - timedelta(days=6), last)

        def streamReader(self, schema) -> DataSourceStreamReader:
            first, last = self._ends()
            if first is None:
                raise ValueError("a stream of daily pages needs the option first")
            return _StreamReader(self._pages(), first, (lambda: last) if last else lambda: today() - timedelta(days=1))

    return DailyPages


def save_pages(pages: DataFrame, folder: str) -> DataFrame:
    """Write each of ``pages (date, content)`` as ``<date>.html``, by the task that has it, and return ``date, file``, which is to be acted on.  A page written again replaces itself."""
    import pyarrow as pa
    from pyarrow import fs

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = fs.FileSystem.from_uri(folder)
        store.create_dir(at, recursive=True)
        for b in batches:
            files = []
            for day, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with store.open_output_stream(f"{at}/{day}.html") as out:
                    out.write(content)
                files.append(f"{folder}/{day}.html")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(files, pa.string())], names=["date", "file"])

    return pages.select("date", F.col("content").cast("binary").alias("content")).mapInArrow(write, "date string, file string")


def fetch_week(spark: SparkSession, site: str, folder: str, today: date | None = None, get: Callable[[str], bytes] = fetch) -> list[str]:
    """On a Sunday, save the week's pages of ``site``, each by a task of its own, as UTF-8 files named by date; returns the seven paths.  On other days nothing."""
    today = today or date.today()
    if today.weekday() != 6:
        return []
    spark.dataSource.register(daily_pages(get, "week_pages"))
    rows = spark.read.format("week_pages").options(site=site, first=str(today - timedelta(days=6)), last=str(today)).load()
    return [r.file for r in sorted(save_pages(rows, folder).collect(), key=lambda r: r.date, reverse=True)]
