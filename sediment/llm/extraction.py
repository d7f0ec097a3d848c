"""The main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing, regions over a threshold."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import freed

# Elements of HTML by what they do to text, and words that pages put into class and id.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
UNSEEN = frozenset("head title script style noscript template iframe object svg canvas audio video select button textarea datalist".split())
APART = frozenset("nav footer aside form menu dialog search header".split())
LINKLESS = frozenset("article body h1 h2 h3 h4 h5 h6 li main p section td tr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words for what stays outside the text whatever it holds, an article too.
FINAL_WORDS = frozenset("comment comments disqus replies reply respond discussion sidebar aside related recommended footer".split())
#: Words for what stays outside, unless an article begins inside.
APART_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login nav navbar navigation menu breadcrumb breadcrumbs widget share sharing social toolbar topbar masthead pagination pager skip hidden".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog".split())
HEADER_WORDS = frozenset(["header"])
#: An open element of the first kind ends where one of its set begins, if no element of the third kind lies between.
ENDS = {"li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])), "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])), "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"]))}
FENCES = frozenset(["article", "main", "body", "table"])

#: A line is content if its smoothed ratio is over so many standard deviations of the page's.
DEVIATIONS = 1.0
#: Lines on either side that smoothing looks at, and its standard deviation in lines.
RADIUS, SIGMA = 2, 1.0
#: A box takes over from the one around it if it holds this share of the content.
HOLDS = 0.7
#: An article counts beside the largest from this share of its content.
BESIDE = 0.25

_INSIDE, _OUTSIDE, _FINALLY = 0, 1, 2
_LETTERS = re.compile("[a-z]+")


class Lines(HTMLParser):
    """Lines of a page in order: what stands between two borders of blocks. ``text``, ``tags`` (since the line
    before), ``linked`` (characters in links), ``box`` (of ``parent`` and ``kind``: the innermost element around it) and
    ``apart`` (menus, adverts and other things that are no article). Broken nesting ends at the nearest article,
    table or body."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text: list[str] = []
        self.tags: list[int] = []
        self.linked: list[int] = []
        self.box: list[int] = []
        self.apart: list[bool] = []
        self.parent, self.kind = [-1], ["html"]
        # open elements: name, what they are to text (or None: unseen), box
        self._open: list[tuple[str, int | None, int]] = [("", _INSIDE, 0)]
        self._count: Counter[str] = Counter()
        self._parts: list[str] = []
        self._seen = self._link_chars = 0
        self._link = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._seen += 1
        if tag == "a":
            self._link = any(name == "href" for name, _ in attrs)  # others are places to link to
        if tag == "br":
            self._parts.append(" ")
        block = tag in BLOCKS
        if block:
            if tag not in ("html", "body") and self._count["head"] and self._open[-1][0] == "head":
                self._close("head")
            if tag == "body":
                self._close("head")
            self._line()
            if tag in LINKLESS:
                self._link = False  # a link that nobody closed
            if self._open[-1][0] == "p":
                self._pop()
            if tag in ENDS:
                self._end_before(*ENDS[tag])
        if tag in VOID:
            return
        state = self._open[-1][1]
        new = self._state(tag, attrs, state)
        if block:
            self.parent.append(self._open[-1][2])
            self.kind.append(tag)
            self._push(tag, new, len(self.parent) - 1)
        elif tag in UNSEEN:
            self._push(tag, None, self._open[-1][2])
        elif new != state:  # an advert in the middle of a line
            self._push(tag, None, self._open[-1][2])

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "canvas", "iframe", "object"):  # the others can't end where they begin
            self._close(tag)

    def handle_endtag(self, tag: str) -> None:
        self._seen += 1
        if tag == "a":
            self._link = False
        if tag in BLOCKS:
            self._line()
        self._close(tag)

    def handle_data(self, data: str) -> None:
        if self._open[-1][1] is not None:
            self._parts.append(data)
            if self._link:
                self._link_chars += len(data)

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers, which nothing here reads

    def close(self) -> None:
        super().close()
        self._line()

    def _state(self, tag: str, attrs: list[tuple[str, str | None]], state: int | None) -> int | None:
        if state is None or state == _FINALLY:
            return state
        words: set[str] = set()
        role, hidden = "", False
        for name, value in attrs:
            value = value or ""
            if name in ("class", "id"):
                words.update(_LETTERS.findall(value.lower()))
            elif name == "role":
                role = value.lower().strip()
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and "display:none" in value.replace(" ", "").lower()):
                hidden = True
        if tag in ("html", "body"):
            return state
        if hidden:
            return _FINALLY
        if tag in ("article", "main") or role in ("main", "article"):
            return _FINALLY if words & FINAL_WORDS - {"aside", "sidebar"} and tag != "main" else _INSIDE
        if words & FINAL_WORDS or tag in ("aside", "footer"):
            return _FINALLY
        in_article = self._count["article"] or self._count["main"]
        if tag == "header" or words & HEADER_WORDS:
            return state if in_article else _OUTSIDE
        if tag in APART or words & APART_WORDS or role in APART_ROLES:
            return _OUTSIDE
        return state

    def _push(self, tag: str, state: int | None, box: int) -> None:
        self._open.append((tag, state, box))
        self._count[tag] += 1

    def _pop(self) -> str:
        tag = self._open.pop()[0]
        self._count[tag] -= 1
        return tag

    def _close(self, tag: str) -> None:
        if not self._count[tag]:
            return
        at = len(self._open) - 1
        while self._open[at][0] != tag:
            if self._open[at][0] in FENCES and tag not in FENCES:
                return
            at -= 1
        while len(self._open) > at:
            self._pop()

    def _end_before(self, ends: frozenset[str], fence: frozenset[str]) -> None:
        for at in range(len(self._open) - 1, 0, -1):
            name = self._open[at][0]
            if name in ends:
                while len(self._open) > at:
                    self._pop()
            elif name in fence or name in FENCES:
                return

    def _line(self) -> None:
        text = " ".join("".join(self._parts).split())
        self._parts.clear()
        if text:
            _, state, box = next(o for o in reversed(self._open) if o[1] is not None)  # a script may still be open
            self.text.append(text)
            self.tags.append(self._seen)
            self.linked.append(min(self._link_chars, len(text)))
            self.box.append(box)
            self.apart.append(state != _INSIDE)
            self._seen = 0
        self._link_chars = 0


def smoothed(ratio: np.ndarray, radius: int = RADIUS, sigma: float = SIGMA) -> np.ndarray:
    """``ratio`` under a Gaussian window that ends at the ends of the page (weights are scaled to sum to one there)."""
    if not len(ratio):
        return ratio
    weight = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    full = slice(radius, radius + len(ratio))
    return np.convolve(ratio, weight)[full] / np.convolve(np.ones(len(ratio)), weight)[full]


def chosen(lines: Lines, deviations: float = DEVIATIONS) -> np.ndarray:
    """Which lines are the page's main text."""
    inside = ~np.array(lines.apart, bool)
    if not inside.any():
        return inside
    chars = np.array([len(t) for t in lines.text], float) - np.array(lines.linked, float)
    ratio = np.where(inside, chars / np.maximum(1, np.array(lines.tags)), 0)
    even = smoothed(ratio)
    content = np.where(inside & (even > deviations * even.std()), chars, 0)
    if not content.any():
        content = np.where(inside, chars + 1, 0)
    boxes = len(lines.parent)
    box = np.array(lines.box)
    held = np.bincount(box, content, boxes)
    for b in range(boxes - 1, 0, -1):  # a box comes after the box around it
        held[lines.parent[b]] += held[b]
    for kind in ("article", "main"):
        outer = _outermost(lines, kind)
        best = max((held[b] for b in set(outer) if b >= 0), default=0)
        if best or (kind == "article" and (inside & (np.array(outer)[box] >= 0)).any() and not held[0]):
            keep = np.array([o >= 0 and held[o] >= BESIDE * best for o in outer])
            return inside & keep[box]
    at = 0
    while True:
        child = max((b for b in range(at + 1, boxes) if lines.parent[b] == at), key=lambda b: held[b], default=at)
        if child == at or held[child] < HOLDS * held[0]:
            break
        if lines.kind[child] in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "pre", "blockquote"):
            break
        at = child
    under = np.zeros(boxes, bool)
    under[at] = True
    for b in range(at + 1, boxes):
        under[b] = under[lines.parent[b]]
    kept = inside & under[box]
    # before the first and after the last line of content, lines of links are no text
    first, last = np.flatnonzero(content * kept)[[0, -1]] if (content * kept).any() else (0, len(kept) - 1)
    place = np.arange(len(kept))
    return kept & (((place >= first) & (place <= last)) | (chars > np.array(lines.linked)))


def _outermost(lines: Lines, kind: str) -> list[int]:
    """Of every box: the outermost box of that kind around it, or -1."""
    out = [-1]
    for b in range(1, len(lines.parent)):
        above = out[lines.parent[b]]
        out.append(above if above >= 0 else b if lines.kind[b] == kind else -1)
    return out


def main_text(html: str | None) -> str:
    """The main text of one page: blocks in page order, one a line."""
    if not html:
        return ""
    lines = Lines()
    lines.feed(html)
    lines.close()
    return "\n".join(t for t, keep in zip(lines.text, chosen(lines)) if keep)


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html).

    Parser events cut a page into lines at the borders of blocks; white space in a line becomes one space.
    Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are told by
    element, role, class and id. Over the other lines the ratio of text (links not counted) to tags is smoothed, and
    lines over a threshold are content. The region is the article with most content (others with at least a quarter
    as much, too), else the main element, else the innermost box that holds ``HOLDS`` of all content; all lines of the
    region that are no menu or the like are the text, short ones too.

    Null and empty pages give an empty text, as do pages with nothing but menus and the like. Pages of any length are
    read whole; broken and missing end tags are made good; repeated rows each give a row, equal ones; null ids and
    urls stay null; an empty table gives no rows; other columns are not read.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return base.mapInArrow(freed(run), "page_id long, url string, text string, n_chars long")


def op12_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))


#: For pages with one article that holds nothing but text, as all of ``pages`` are: what lies inside, cut at blocks.
OP12_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*?)(</article>|$)', 1) AS h FROM pages),
cut AS (SELECT page_id, url, string_split(regexp_replace(h, '</?(p|h[1-6]|div|ul|ol|li|section|blockquote)( [^>]*)?>', chr(1), 'g'), chr(1)) AS parts FROM a),
plain AS (
  SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(
    replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(x, '<br ?/?>', ' ', 'g'), '<[^>]*>', '', 'g'),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'),
    '\s+', ' ', 'g'))) AS parts FROM cut)
SELECT page_id, url, coalesce(array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)), '') AS text,
  CAST(length(coalesce(array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)), '')) AS BIGINT) AS n_chars
FROM plain
"""
