"""Main text of HTML pages by text-to-tag ratios.

Events of the standard library's parser are turned into lines as they come: a
block-level tag ends a line, white space inside becomes one space.  A line's
ratio is its characters outside of links over its tags; in menus, headers,
footers, sidebars, notices, adverts and comments, told by tag and class, a line
counts only a ten-thousandth of it.  The logarithms of the ratios are smoothed
by a Gaussian and split into two clusters by an iterated threshold.

The dense cluster selects the region: from the innermost container of half of
its characters outwards, as long as a container adds more dense characters
than its sparse lines lack to be dense; then the article element around that,
if there is one.  Of the region all lines are returned, however short, except
sparse ones of the kinds above, and lines of nothing but links beyond all
dense ones.  Scripts, styles, forms and hidden elements are no lines at all.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import in_small_batches
from .tables import free, table

_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is no line.
_DROP = frozenset("script style noscript template svg math head title iframe object canvas audio video form dialog button select textarea input datalist fieldset".split())
#: Elements whose lines are sparse unless they are ten thousand times as dense as others.
_WEAK = frozenset("nav footer aside menu".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login comment comments disqus reply replies respond share sharing social related recommended recommendations teaser widget toolbar pagination pager search skip outbrain taboola commentlist topnav subnav mainnav sitenav adsense adbox adslot adbanner sidebox cookiebar cookiebanner".split()
)
_NOT = frozenset("has with no without is js".split())
#: Elements that can be the region where no article is named; a paragraph or an item of a list is a part of one.
_CONTAINERS = frozenset("html body div section center main article table td".split())
#: An item ends the last one of these, but for one outside of the list or table that it is in.
_ITEMS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_LISTS = ("ul", "ol", "dl", "table", "select", "menu")
_P_SCOPE = ("td", "th", "caption", "table", "button", "object")
#: Elements that hold text themselves.
_TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre".split())
_DAMP = 1e-4
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def _hidden(attrs: list[tuple[str, str | None]]) -> bool:
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and (value or "").strip().lower() == "true":
            return True
        if name == "style" and value and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


_SAID, _NAMED = 2, 1


def _weak(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> int:
    """Whether tag or role say (2), or class or id name (1), that this is no part of an article.

    Of a container any part of a name tells, unless a word like ``with`` comes
    before it; of a paragraph, a heading or an item only a whole name.
    """
    if tag in ("html", "body", "main", "article"):
        return 0
    if tag in _WEAK or tag == "header" and not in_article:
        return _SAID
    if any(name == "role" and value and value.strip().lower() in _ROLES for name, value in attrs):
        return _SAID
    for name, value in attrs:
        if value and name in ("class", "id"):
            for token in value.split():
                if tag in _TEXTS:
                    if token.lower() in _NAMES:
                        return _NAMED
                    continue
                parts = [p.lower() for p in _PART.findall(token)]
                told = next((i for i, x in enumerate(parts) if x in _NAMES or x == "header" and not in_article), -1)
                if told >= 0 and _NOT.isdisjoint(parts[:told]):
                    return _NAMED
    return 0


@dataclass(slots=True)
class Line:
    """``inside``: the innermost element; ``weak``: in one that is no part of an article; ``inline``: the inline one that it is in, if any; ``linked``: characters of links."""

    text: str
    tags: int
    inside: int
    weak: bool
    inline: int
    linked: int

    @property
    def ratio(self) -> float:
        return max(0, len(self.text) - self.linked) / (1 + self.tags) * (_DAMP if self.weak else 1)


class _Lines(HTMLParser):
    """Lines of a page.  Elements are numbered as they open, from 1; 0 is the page.  Every tag costs constant time but for elements that it closes.

    An inline element that is dropped or weak ends with the block around it;
    if its own end tag never came, blocks inside it are as good as others.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.text: list[str] = []
        self.aside: list[str] = []  # text of weak inline elements of this line
        self.tags = self.linked = self.link = 0
        self.open: list[tuple[str, int, bool, bool, bool]] = []  # tag, number, dropped, weak, inline
        self.places: dict[str, list[int]] = {}  # of each tag among the open
        self.kinds, self.parent = [""], [0]
        self.inline_of = [0]  # of each element the innermost inline one that is dropped or weak, itself included
        self.unclosed: set[int] = set()
        self.said = [0]  # of each block element, what tag, role and names say of it
        self.dropped = 0  # open block elements of the kind
        self.inline = self.inline_dropped = 0  # open inline ones of either kind, and dropped ones
        self.blocks: list[int] = []  # places of open block elements
        self.began = 0  # the first inline one that began on this line

    def updatepos(self, i: int, j: int) -> int:
        """Line and column are not asked for."""
        return j

    def _inside(self) -> int:
        return self.open[-1][1] if self.open else 0

    def _end_line(self) -> None:
        at = self.parent[self.began] if self.began else self._inside()
        for text, aside in ((self.text, False), (self.aside, True)):
            words = " ".join("".join(text).split()) if text else ""
            if words:
                self.lines.append(Line(words, self.tags, at, aside, self.inline_of[at], 0 if aside else self.linked))
                self.tags = self.linked = 0
            text.clear()
        self.began = 0

    def _push(self, tag: str, dropped: bool, weak: int, inline: bool) -> None:
        up, number = self._inside(), len(self.kinds)
        self.kinds.append(tag)
        self.parent.append(up)
        odd = inline and (dropped or weak)
        self.inline_of.append(number if odd else self.inline_of[up])
        self.said.append(0 if odd else weak)
        self.places.setdefault(tag, []).append(len(self.open))
        if not inline:
            self.blocks.append(len(self.open))
        if odd:
            self.inline += 1
            self.inline_dropped += dropped
            self.began = self.began or number
        else:
            self.dropped += dropped
        self.open.append((tag, number, dropped, bool(weak), inline))

    def _pop_to(self, k: int, closed: int = -1) -> None:
        """``closed``: the place of the element whose end tag this is."""
        while len(self.open) > k:
            tag, number, dropped, weak, inline = self.open.pop()
            self.places[tag].pop()
            if not inline:
                self.blocks.pop()
            if inline and (dropped or weak):
                self.inline -= 1
                self.inline_dropped -= dropped
                if len(self.open) != closed:
                    self.unclosed.add(number)
            else:
                self.dropped -= dropped

    def _last(self, tags: tuple[str, ...]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def _close(self, tags: tuple[str, ...], scope: tuple[str, ...]) -> None:
        """Close the last of ``tags``, unless one of ``scope`` began in it."""
        k = self._last(tags)
        if k >= 0 and k > self._last(scope):
            self._pop_to(k)

    def handle_starttag(self, tag: str, attrs) -> None:
        block = tag in _BLOCK
        if block:
            self._end_line()
            self._close(("p",), _P_SCOPE)
            if tag in _ITEMS:
                self._close(_ITEMS[tag], _LISTS)
        self.tags += 1
        if tag == "br":
            (self.aside if self.inline else self.text).append(" ")
        if tag in _VOID:
            return
        self.link += tag == "a"
        dropped = tag in _DROP or bool(attrs) and _hidden(attrs)
        weak = 0 if dropped or not (attrs or tag in _WEAK or tag == "header") else _weak(tag, attrs, bool(self.places.get("article") or self.places.get("main")))
        if block or dropped or weak or self.inline:  # inside an inline one all are told apart, so that end tags fit
            self._push(tag, dropped, weak, not block)

    def handle_endtag(self, tag: str) -> None:
        if tag in _BLOCK:
            self._end_line()
        self.tags += 1
        if tag == "a" and self.link:
            self.link -= 1
        if tag not in _VOID and self.places.get(tag):
            k = self.places[tag][-1]
            if tag in _BLOCK or not self.blocks or self.blocks[-1] < k:
                self._pop_to(k, k)

    def handle_data(self, data: str) -> None:
        if self.dropped or self.open and self.open[-1][0] in ("script", "style"):
            return
        if self.inline_dropped:
            return
        if self.inline and self.began:
            self.aside.append(data)
            return
        self.text.append(data)
        if self.link:
            self.linked += len(data.strip())

    def result(self) -> list[Line]:
        """The lines; weak are those in inline elements that were closed in order, and those in blocks that tag, role or name tell.

        No name weakens a block that has the page's title or article and half
        of its text outside of links and of what tags and roles tell: a layout
        may be named for its sidebar.
        """
        n = len(self.kinds)
        inside, text = np.array([x.inside for x in self.lines], int), np.array([max(0, len(x.text) - x.linked) for x in self.lines], float)
        sure = [False] * n
        for e in range(1, n):
            sure[e] = self.said[e] == _SAID or sure[self.parent[e]]
        held = _sums(np.where(np.array(sure)[inside], 0, text), inside, self.parent) if self.lines else np.zeros(n)
        whole = [k in ("h1", "main", "article") for k in self.kinds]
        for e in range(n - 1, 0, -1):
            whole[self.parent[e]] = whole[self.parent[e]] or whole[e]
        block = [False] * n
        for e in range(1, n):
            block[e] = self.said[e] == _SAID or self.said[e] == _NAMED and not (whole[e] and 2 * held[e] >= held[0]) or block[self.parent[e]]
        weak = [False] * len(self.kinds)  # of inline ones: closed, or in one that is
        for e in range(1, len(weak)):
            if self.inline_of[e] == e:
                weak[e] = e not in self.unclosed or weak[self.inline_of[self.parent[e]]]
        for x in self.lines:
            x.weak = x.weak or block[x.inside] or weak[x.inline]
        return self.lines


def smoothed(ratio: np.ndarray, radius: int = 2, sigma: float = 1.0) -> np.ndarray:
    """``ratio`` convolved with a Gaussian; at the ends with the part of it that fits."""
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    n, cut = len(ratio), slice(radius, radius + len(ratio))
    return np.convolve(ratio, w)[cut] / np.convolve(np.ones(n), w)[cut]


def threshold(x: np.ndarray) -> float:
    """Between two clusters: half way between their means, iterated until it stays."""
    t = float(x.mean())
    for _ in range(100):
        low, high = x[x < t], x[x >= t]
        if not len(low) or not len(high):
            return t
        new = float((low.mean() + high.mean()) / 2)
        if abs(new - t) < 1e-9:
            break
        t = new
    return t


def _sums(values: np.ndarray, inside: np.ndarray, parent: list[int]) -> np.ndarray:
    """For each element the values of all lines in it."""
    total = np.bincount(inside, values, len(parent)).tolist()
    for e in range(len(parent) - 1, 0, -1):  # the inner ones have the greater numbers
        total[parent[e]] += total[e]
    return np.array(total)


def _chain(e: int, parent: list[int]):
    while True:
        yield e
        if not e:
            return
        e = parent[e]


def blocks(html: str | None) -> list[str]:
    """The blocks of the main text, in page order.  Null, empty and textless pages, and those of nothing but weak lines, have none."""
    if not html:
        return []
    p = _Lines()
    p.feed(html)
    p.close()
    p._end_line()
    p._pop_to(0)
    lines = p.result()
    if not lines:
        return []
    ratio = np.log1p([x.ratio for x in lines])
    soft = smoothed(ratio)
    limit = threshold(soft)
    weak = np.array([x.weak for x in lines])
    links = np.array([x.linked >= 0.9 * len(x.text.replace(" ", "")) for x in lines])
    # a long line between short ones is dense by itself; smoothing lends nothing to weak lines and to those of nothing but links
    dense = np.where(weak | links, np.minimum(soft, ratio), np.maximum(soft, ratio)) >= limit
    if weak.all():
        return []
    if not dense.any():
        dense = ~weak
    chars = np.array([len(x.text) for x in lines], float)
    inside = np.array([x.inside for x in lines])
    kinds, parent = p.kinds, p.parent
    held = _sums(chars * dense, inside, parent)
    lacks = _sums(np.where(dense | weak, 0, np.maximum(0, np.expm1(limit) * (1 + np.array([x.tags for x in lines])) - chars)), inside, parent)
    count = _sums(np.ones(len(lines)), inside, parent)
    fits = [e for e in range(len(kinds)) if not e or kinds[e] in _CONTAINERS and count[e] > 1 and 2 * held[e] >= held[0]]
    start = fits[-1]  # the innermost: numbers grow inwards
    region = max((e for e in _chain(start, parent) if not e or kinds[e] in _CONTAINERS), key=lambda e: (held[e] - lacks[e], -e))
    around = list(_chain(region, parent))
    named = [e for e in around if kinds[e] == "article"]
    if named:
        region = named[-1]
    own = np.zeros(len(kinds), bool)
    own[region] = True
    for e in range(1, len(kinds)):
        own[e] = own[e] or own[parent[e]]
    got = own[inside]
    first, last = np.flatnonzero(dense & got)[[0, -1]] if (dense & got).any() else (0, len(lines) - 1)
    out = []
    for i in np.flatnonzero(got & (dense | ~weak)).tolist():
        if first <= i <= last or kinds[region] == "article" or not links[i]:
            out.append(lines[i].text)
    return out


def main_text(html: str | None) -> str:
    return "\n\n".join(blocks(html))


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` without ``html_col``, with ``out_col`` and ``n_chars`` (code points; columns of these names are replaced).

    Null, empty and textless pages give an empty text.  Repeated rows stay.
    """
    keep = [c for c in pages.columns if c not in (html_col, out_col, "n_chars")]

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                text = [main_text(h.as_py()) for h in part.column(0)]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=[*part.schema.names[1:], out_col, "n_chars"])

    own = free("html", keep)
    d = pages.select(F.col(html_col).cast("string").alias(own), *keep)
    return in_small_batches(d).mapInArrow(run, d.drop(own).schema.add(out_col, "string").add("n_chars", "long"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, url, text, n_chars`` of all pages."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


# The given pages name their article, which has headings, paragraphs, line breaks and bold text.
_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS h FROM pages),
b AS (SELECT page_id, url, list_transform(string_split_regex(h, '</?(?:h1|p)>'), lambda x: regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g')) AS l FROM a),
c AS (SELECT page_id, url, list_transform(l, lambda x: regexp_replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;?', '&', 'g')) AS l FROM b),
d AS (SELECT page_id, url, list_filter(list_transform(l, lambda x: trim(regexp_replace(x, '[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{3000}]+', ' ', 'g'))), lambda x: x <> '') AS l FROM c)
SELECT page_id, url, array_to_string(l, chr(10) || chr(10)) AS text, CAST(length(array_to_string(l, chr(10) || chr(10))) AS BIGINT) AS n_chars FROM d
"""

QUERIES = {"op9_html_text": op9_html_text}
ORACLE = {"op9_html_text": _SQL}
