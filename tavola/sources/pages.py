"""Scraped pages: files, decoding, and the elements that menus are made of."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tavola.functions import values as V
from tavola.session import in_small_batches

ENCODINGS = ("utf-8", "iso-8859-2", "windows-1250")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = frozenset(("script", "style", "template"))


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """``path, date, content``: every ``.html`` file of the folder whose path has a date, in any order."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").load(folder)
    return files.select("path", date_of(F.col("path")).alias("date"), "content").where("date <> ''")


def date_of(path: Column) -> Column:
    """The first ``YYYY-MM-DD`` in a path; empty if there is none."""
    return F.regexp_extract(path, r"(?U)(\d{4}-\d{2}-\d{2})", 1)


def decode(raw: bytes | str | None) -> str:
    """The first of the encodings that fits; text passes."""
    if raw is None or isinstance(raw, str):
        return raw or ""
    for name in ENCODINGS:
        try:
            return raw.decode(name).replace("\r\n", "\n").replace("\r", "\n")
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace")


class _Elements(HTMLParser):
    """``img`` and ``p`` elements in page order.  An unclosed ``p`` holds what follows, later ``p`` included, unless ``close_p``."""

    def __init__(self, close_p: bool) -> None:
        super().__init__(convert_charrefs=True)
        self.close_p = close_p
        self.found: list[list] = []
        self.open: list[tuple[str, list | None]] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag == "p" and self.close_p:
            self.handle_endtag("p")
        item = None
        if tag == "img":
            self.found.append(["img", dict(attrs).get("src") or "", []])
        elif tag == "p":
            item = ["p", None, []]
            self.found.append(item)
        if tag not in _VOID:
            self.open.append((tag, item))
            self.hidden += tag in _HIDDEN

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self.hidden -= sum(t in _HIDDEN for t, _ in self.open[i:])
                del self.open[i:]
                return

    def handle_data(self, data):
        if not self.hidden:
            for _, item in self.open:
                if item is not None:
                    item[2].append(data)


def elements_of(html: str, close_p: bool = False) -> list[tuple[str, str | None, str]]:
    p = _Elements(close_p)
    p.feed(html)
    p.close()
    return [(tag, src, "".join(text).strip()) for tag, src, text in p.found]


_ELEMENT = pa.schema([("path", pa.string()), ("date", pa.string()), ("pos", pa.int32()), ("tag", pa.string()), ("src", pa.string()), ("text", pa.string())])


def elements_in_batches(pages: Iterable[tuple], close_p: bool = False, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The elements of ``pages``, in batches that end with the page with which they have over ``most`` characters."""
    out: tuple[list, ...] = tuple([] for _ in _ELEMENT)
    held = 0
    for path, day, raw in pages:
        for pos, (tag, src, text) in enumerate(elements_of(decode(raw), close_p)):
            for col, v in zip(out, (path, day, pos, tag, src, text), strict=True):
                col.append(v)
            held += 100 + len(path or "") + len(src or "") + len(text)
        if held > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _ELEMENT, strict=True)], schema=_ELEMENT)
            out, held = tuple([] for _ in _ELEMENT), 0
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _ELEMENT, strict=True)], schema=_ELEMENT)


def page_elements(pages: DataFrame, close_p: bool = False) -> DataFrame:
    """``path, date, pos, tag, src, text``: the elements of ``pages (path, date, content)``."""

    def run(batches):
        # a page at a time: as lists all pages of a batch would be in memory twice
        yield from elements_in_batches((tuple(c[i].as_py() for c in b.columns) for b in batches for i in range(b.num_rows)), close_p)

    return in_small_batches(pages.select("path", "date", "content")).mapInArrow(run, "path string, date string, pos int, tag string, src string, text string")


class _Plain(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in _HIDDEN

    def handle_endtag(self, tag):
        if tag in _HIDDEN and self.hidden:
            self.hidden -= 1

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)


def plain_text(html: str | None) -> str:
    """Text without tags; paragraph ends and line breaks become newlines, other white space one space."""
    import re

    source = (html or "").replace("\r", " ").replace("\n", " ").replace("</p>", "\n").replace("<br>", "\n")
    p = _Plain()
    p.feed(source)
    p.close()
    return re.sub(r"[^\S\n]+", " ", "".join(p.text)).strip()


def page_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` and ``text`` of each page; content may be text or bytes."""

    def run(batches):
        for b in batches:
            text = [plain_text(decode(x)) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(text, pa.string())], names=[*b.schema.names[1:], "text"])

    d = pages.select(F.col(html_col).alias("_html"), *keep)
    return d.mapInArrow(run, d.drop("_html").schema.add("text", "string"))


def line_frequency(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """``line, n``: how often each line occurs over all texts."""
    return texts.select(F.explode(F.split(F.col(text_col), "\n", -1)).alias("line")).groupBy("line").agg(F.count("*").alias("n"))


def weekly_schedule(days: DataFrame, day_col: str = "day") -> DataFrame:
    """``file_date, page``: for every Sunday of ``days`` the seven days up to it and their page names."""
    names = F.array(*[F.lit(x) for x in V.DAY_PAGES])
    sunday = days.where(F.dayofweek(day_col) == 1).select(F.col(day_col).cast("date").alias("d"))
    back = sunday.select("d", F.posexplode(names).alias("back", "page"))
    return back.select(F.date_format(F.date_sub("d", F.col("back")), "yyyy-MM-dd").alias("file_date"), "page")
