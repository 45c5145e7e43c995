"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block element. Lines of menus, forms, scripts and the like
weigh nothing, and so do lines that are mostly link text. The weights are summed over sliding
windows of lines; the text begins where the sum surges above a threshold and ends where it dives
to nothing. Everything between the two is kept.

All lines of every page are judged so. A surge takes as much text as boilerplate lines seldom have
together. A line inside a marked article weighs a surge more, so any text there is one, but lists of
links are not; text outside the mark surges by its own weight.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.llm.shared import map_batches

WINDOW = 3
SURGE = 86
LINK_SHARE = 0.5

# Elements of the HTML standard, by what they mean here.
BLOCKS = frozenset(
    "address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p "
    "pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
SILENT = frozenset(
    "script style noscript template title nav footer aside form button select textarea iframe "
    "object svg canvas audio video menu dialog datalist".split()
)
SILENT_ROLES = frozenset(
    "navigation banner contentinfo complementary search form alert alertdialog dialog menu "
    "menubar".split()
)
# Words in a class or id that name something other than the article.
SILENT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion "
    "banner sidebar menu nav navbar navigation breadcrumb breadcrumbs header masthead footer "
    "cookie cookies consent gdpr notice notices alert popup modal overlay comment comments "
    "respond disqus social share sharing related recommended widget subscribe newsletter signup "
    "login".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
COMMENT_NAMES = frozenset("comment comments respond disqus".split())
# What HTML closes without an end tag: the open elements that a start tag ends, and those whose inside
# it does not look out of.
SCOPE = frozenset(
    "applet button canvas caption html iframe marquee math noscript object select svg table td "
    "template textarea th title".split()
)
ENDS_P = frozenset(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr li listing main menu nav ol p pre search section "
    "summary table ul".split()
)
_ITEMS = BLOCKS - {"address", "div", "p"} | SCOPE
_IN_TABLE = SCOPE - {"td", "th", "caption"}
_ROWS = {"td", "th", "caption", "colgroup", "tr"}
IMPLIED = {
    "li": ({"li"}, _ITEMS - {"li"}),
    "dd": ({"dd", "dt"}, _ITEMS - {"dd", "dt"}),
    "dt": ({"dd", "dt"}, _ITEMS - {"dd", "dt"}),
    "option": ({"option"}, SCOPE | {"datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, SCOPE | {"datalist"}),
    "td": ({"td", "th", "caption", "colgroup"}, _IN_TABLE | {"tr"}),
    "th": ({"td", "th", "caption", "colgroup"}, _IN_TABLE | {"tr"}),
    "tr": (_ROWS, _IN_TABLE | {"tbody", "thead", "tfoot"}),
    "tbody": (_ROWS | {"tbody", "thead", "tfoot"}, _IN_TABLE),
    "thead": (_ROWS | {"tbody", "thead", "tfoot"}, _IN_TABLE),
    "tfoot": (_ROWS | {"tbody", "thead", "tfoot"}, _IN_TABLE),
    "rt": ({"rt", "rp"}, SCOPE | {"ruby"}),
    "rp": ({"rt", "rp"}, SCOPE | {"ruby"}),
    "body": ({"head"}, SCOPE),
}
# Table parts look for their start tag up to the table; others not beyond a cell.
TABLE_PARTS = frozenset("table caption colgroup tbody thead tfoot tr td th".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
KEPT_OPEN = BLOCKS | SILENT | SCOPE | IMPLIED.keys() | {"a", "head"}
UNFINISHED = re.compile(r"<[/!?a-zA-Z][^<>]*\Z")  # a tag that the page's end cuts off
WHOLE = frozenset(("html", "body", "main"))


def _names(attributes: dict[str, str | None]) -> set[str]:
    words = f"{attributes.get('class') or ''} {attributes.get('id') or ''}".lower()
    return set("".join(c if c.isalnum() else " " for c in words).split())


@dataclass
class Open:
    tag: str
    silent: bool = False  # it silences what is in it
    mark: bool = False  # it marks an article
    link: bool = False


@dataclass
class Line:
    text: str
    weight: int
    article: int  # number of the marked article it is in, 0 outside


class LineReader(HTMLParser):
    """The lines of a page. A silent element leaves a gap of weightless lines behind.

    Elements without an end tag end where HTML implies it, or with the element they are in. Of inline
    elements only links, and those that are silent or in a silent one, are followed.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.linked = 0
        self.links = 0
        self.open: list[Open] = []
        self.counts: Counter[str] = Counter()  # open elements by tag
        self.silent = 0  # open elements that silence
        self.marks = 0
        self.articles = 0
        self.heading = False  # the line is a headline

    def _is_silent(self, tag: str, attributes: dict[str, str | None]) -> bool:
        if tag in WHOLE:
            return False
        names = _names(attributes)
        if tag == "article":
            return bool(names & COMMENT_NAMES)
        if tag == "header":  # an article's own header holds its headline
            return not self.marks or bool(names & SILENT_NAMES)
        role = (attributes.get("role") or "").lower()
        hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true"
        return tag in SILENT or role in SILENT_ROLES or hidden or bool(names & SILENT_NAMES)

    def handle_starttag(self, tag, attrs) -> None:
        self._imply_ends(tag)
        if self.silent:
            if tag not in VOID:
                self._push(Open(tag))
            return
        if tag in BLOCKS:
            self.flush()
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        entry = Open(tag, silent=self._is_silent(tag, dict(attrs)))
        if entry.silent:
            if tag in BLOCKS or tag in SILENT:
                self.gap(tag)
            self.silent += 1
        elif tag in ("article", "main"):
            if not self.marks:
                self.gap(tag)  # the mark's lines are hills of their own
                self.articles += 1
            self.marks += 1
            entry.mark = True
        elif tag == "a" and any(name == "href" for name, _ in attrs):
            self.links += 1
            entry.link = True
        elif tag in HEADINGS:
            self.heading = True
        if entry.silent or tag in KEPT_OPEN:
            self._push(entry)

    def _push(self, entry: Open) -> None:
        self.open.append(entry)
        self.counts[entry.tag] += 1

    def handle_startendtag(self, tag, attrs) -> None:
        self._imply_ends(tag)
        if not self.silent and tag in BLOCKS:
            self.flush()
        elif not self.silent and tag == "br":
            self.parts.append(" ")

    def handle_endtag(self, tag) -> None:
        at = self._start_of(tag)
        if at is None:
            if not self.silent and tag in BLOCKS:
                self.flush()
        elif tag in FORMATTING:  # blocks opened inside stay open
            self._close(at, at + 1 if self._has_block(at + 1) else len(self.open), tag)
        elif tag in KEPT_OPEN or not self._has_block(at + 1):
            self._close(at, len(self.open), tag)

    def _has_block(self, at: int) -> bool:
        return any(x.tag in BLOCKS or x.tag in SCOPE for x in self.open[at:])

    def _start_of(self, tag: str) -> int | None:
        """The place of the open element that an end tag belongs to."""
        alike = HEADINGS if tag in HEADINGS else (tag,)
        if not any(self.counts[x] for x in alike):
            return None
        if tag in ("html", "body", "head"):
            stops = frozenset()
        elif tag in TABLE_PARTS:
            stops = _IN_TABLE
        else:
            stops = SCOPE | {"ol", "ul"} if tag == "li" else SCOPE
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at].tag in alike:
                return at
            if self.open[at].tag in stops:
                return None
        return None

    def _imply_ends(self, tag: str) -> None:
        """Close the open elements that a start tag ends."""
        if tag == "a" and self.counts["a"]:  # links do not nest
            self.handle_endtag("a")
        if tag in IMPLIED:
            self._end_nearest(*IMPLIED[tag], tag)
        if tag in ENDS_P:
            self._end_nearest({"p"}, SCOPE, tag)

    def _end_nearest(self, ended, stops, tag: str) -> None:
        """Close the outermost of the ended elements before the first that stops the search."""
        found = None
        if not any(self.counts[x] for x in ended):
            return
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at].tag in ended:
                found = at
            elif self.open[at].tag in stops:
                break
        if found is not None:
            self._close(found, len(self.open), tag)

    def _close(self, begin: int, end: int, tag: str) -> None:
        """Close a run of open elements, at a tag."""
        closed = self.open[begin:end]
        still = self.silent - sum(x.silent for x in closed)
        if not still and tag in BLOCKS:
            self.flush()
        del self.open[begin:end]
        self.silent = still
        self.links -= sum(x.link for x in closed)
        self.counts.subtract(x.tag for x in closed)
        marks = sum(x.mark for x in closed)
        self.marks -= marks
        if marks and not self.marks:
            self.gap("article")

    def handle_data(self, data) -> None:
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.linked += len("".join(data.split()))

    def gap(self, tag: str) -> None:
        """Weightless lines, as many as a window has; scripts and styles leave none."""
        if tag not in ("script", "style", "noscript", "template"):
            self.flush()
            self.lines += [Line("", 0, self._article())] * WINDOW

    def _article(self) -> int:
        return self.articles if self.marks else 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            size = len(text.replace(" ", ""))
            # a marked article's headline often links to the article itself
            listed = self.linked > LINK_SHARE * size and not (self.heading and self.marks)
            self.lines.append(Line(text, 0 if listed else len(text), self._article()))
        self.parts, self.linked, self.heading = [], 0, False

    def close(self) -> None:
        super().close()
        self.flush()


def kept_lines(weights: list[int], surge: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """Line ranges from a surge to the dive that follows.

    The sum at a line covers it and the ``window - 1`` lines after it. A run of lines with sums
    above zero is one hill of the distribution; it counts if its sums reach ``surge``, and loses the
    weightless lines at its ends.
    """
    sums = [sum(weights[i : i + window]) for i in range(len(weights))]
    found, at = [], 0
    while at < len(sums):
        if not sums[at]:
            at += 1
            continue
        end = at
        while end < len(sums) and sums[end]:
            end += 1
        if max(sums[at:end]) >= surge:
            first, last = at, end
            while not weights[first]:
                first += 1
            while not weights[last - 1]:
                last -= 1
            found.append((first, last))
        at = end
    return found


def main_text(html: str | None, window: int = WINDOW, surge: int = SURGE) -> list[str]:
    """The blocks of the main text, in page order."""
    reader = LineReader()
    reader.feed(UNFINISHED.sub("", html or ""))
    reader.close()
    lines = reader.lines
    # the mark is extra weight: a surge for each line of it that weighs anything
    weights = [line.weight + surge * (line.article > 0 < line.weight) for line in lines]
    ranges = kept_lines(weights, surge, window)
    if not ranges and any(weights):  # a page of little text: the hill with the most of it
        hills = kept_lines(weights, 1, window)
        ranges = [max(hills, key=lambda r: (sum(weights[r[0] : r[1]]), -r[0]))]
    return [lines[i].text for a, b in ranges for i in range(a, b) if lines[i].text]


def extract_main_text(
    pages: DataFrame,
    window: int = WINDOW,
    surge: int = SURGE,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
) -> DataFrame:
    """One row per page: ``page_id``, ``url``, ``text``, ``n_chars``, ``n_blocks``.

    Character references are decoded, white space inside a block is one space, blocks are joined by
    newlines. A null or empty page, or one without text, has an empty text. A line break inside a
    block is white space. Repeated pages each give a row; pages are read whole.
    """
    narrow = pages.select(
        F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(html).cast("string").alias("html")
    )
    kinds = {f.name: f.dataType.simpleString() for f in narrow.schema}

    def extract(batches):
        for batch in batches:
            blocks = [main_text(h, window, surge) for h in batch.column("html").to_pylist()]
            texts = ["\n".join(b) for b in blocks]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([len(b) for b in blocks], pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars", "n_blocks"],
            )

    schema = (
        f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint, n_blocks bigint"
    )
    return map_batches(narrow, extract, schema)
