"""Tables and links of stored web pages as rows."""

from __future__ import annotations

from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.session import ship_package

# Spans, and references other than those ``plain_text`` resolves.
_UNTIDY = r"(?is)\b(?:row|col)span\s*=|&(?!(?:nbsp|lt|gt|quot|amp|#39);)#?\w+"
#: rows of a page handed over at once by the tolerant parser
ROWS_AT_ONCE = 5000
_TABLE = r"(?is)<table\b[^>]*>(.*?)</table\s*>"
_ROW = r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"
_CELL = r"(?is)<t([dh])\b[^>]*>(.*?)</t[dh]\s*>"
# An anchor with a target: its attributes and its body.
_LINK = r"""(?is)<a\b([^>]*?\bhref\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)[^>]*)>(.*?)</a\s*>"""
_TARGET = r"""(?is)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
_REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});?"
_RARE = r"&(?!(?:nbsp|lt|gt|quot|amp|#39);)#?\w"


# Names (some without a semicolon) and what they stand for, from the standard library's table. One
# text rather than a map: a literal of thousands of entries would slow the planning of every query.
_START, _END = "\x01", "\x02"
_NAMES = "".join(f"{_START}{name}{_END}{text}" for name, text in sorted(html5.items())) + _START


def _named(name: Column) -> Column:
    """What a name stands for; NULL if nothing."""
    table, key = F.lit(_NAMES), F.concat(F.lit(_START), name, F.lit(_END))
    rest = F.call_function("substring_index", table, key, F.lit(-1))
    return F.when(table.contains(key), F.substring_index(rest, _START, 1))


# Numbers 128 to 159, which pages use for characters of code page 1252.
_CODE_PAGE = bytes(range(0x80, 0xA0)).decode("cp1252", "replace")


def _decoded(reference: Column) -> Column:
    """What one reference stands for; itself if nothing. A name counts as a whole."""
    body = F.regexp_replace(reference, "^&#[xX]?|;$", "")
    number = F.when(reference.rlike("^&#[xX]"), F.conv(body, 16, 10)).otherwise(body).cast("int")
    valid = (number > 0) & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    wide = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    numeric = F.when(number.between(0x80, 0x9F), F.substring(F.lit(_CODE_PAGE), number - 0x7F, F.lit(1))).when(valid, wide)
    return F.when(reference.startswith("&#"), F.coalesce(numeric, F.lit("\ufffd"))).otherwise(
        F.coalesce(_named(F.substring(reference, 2, 40)), reference)
    )


def decode_references(text: Column) -> Column:
    """Text with every character reference replaced, in one pass, so that none is read twice."""
    between = F.split(text, _REFERENCE, -1)
    found = F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0))
    pairs = F.zip_with(between, found, lambda x, r: F.concat(x, F.when(r.isNull(), "").otherwise(_decoded(r))))
    return F.array_join(pairs, "")


def plain_text(fragment: Column) -> Column:
    """Text of a fragment: tags dropped, the five common entities resolved, spaces collapsed."""
    text = F.regexp_replace(fragment, r"(?s)<[^>]*>", "")
    for entity, char in (
        ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
        ("&amp;", "&"),
    ):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def extract_tables(pages: DataFrame, page: str = "page_id", html: str = "html") -> DataFrame:
    """Rows ``(page, table_no, row_no, is_header, cells)`` of well-formed, unnested tables.

    Pages never meet: each is taken apart inside its own task. Pages whose tables span cells or hold
    rare character references go through ``extract_untidy_tables``, the others stay in the JVM. For
    nested or unclosed markup call that one.
    """
    untidy = F.coalesce(F.col(html).rlike(_UNTIDY), F.lit(False))
    tidy = _tidy_tables(pages.filter(~untidy), page, html)
    return tidy.unionByName(extract_untidy_tables(pages.filter(untidy), page, html))


def _tidy_tables(pages: DataFrame, page: str, html: str) -> DataFrame:
    tables = pages.select(
        page, F.posexplode(F.regexp_extract_all(html, F.lit(_TABLE), F.lit(1)))
    ).toDF(page, "table_no", "_table")
    rows = tables.select(
        page, "table_no", F.posexplode(F.regexp_extract_all("_table", F.lit(_ROW), F.lit(1)))
    ).toDF(page, "table_no", "row_no", "_row")
    marks = F.regexp_extract_all("_row", F.lit(_CELL), F.lit(1))
    found = F.regexp_extract_all("_row", F.lit(_CELL), F.lit(2))
    return rows.select(
        page,
        "table_no",
        "row_no",
        (~F.exists(marks, lambda m: F.lower(m) == "d")).alias("is_header"),
        F.transform(found, plain_text).alias("cells"),
    )


class _TableReader(HTMLParser):
    """Collects the rows of every table, nested ones included: (is header, parts, spans)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[tuple[bool, list[str], int, int]]]] = []
        self._open: list[list[list[tuple[bool, list[str], int, int]]]] = []

    def handle_starttag(self, tag, attrs) -> None:
        if tag == "table":
            table: list = []
            self.tables.append(table)
            self._open.append(table)
        elif self._open and tag == "tr":
            self._open[-1].append([])
        elif self._open and tag in ("td", "th"):
            if not self._open[-1]:
                self._open[-1].append([])
            given = dict(attrs)
            self._open[-1][-1].append(
                (tag == "th", [], _span(given.get("rowspan")), _span(given.get("colspan")))
            )

    def handle_endtag(self, tag) -> None:
        if tag == "table" and self._open:
            self._open.pop()

    def handle_data(self, data) -> None:
        if self._open and self._open[-1] and self._open[-1][-1]:
            self._open[-1][-1][-1][1].append(data)


def _span(value: str | None) -> int:
    """A span attribute; 1 where it is no number. Bounded as in the HTML standard."""
    digits = (value or "").strip()
    return min(max(int(digits), 1), 1000) if digits.isdecimal() else 1


def _grid(table) -> Iterator[tuple[bool, list[str]]]:
    """Rows with spanned cells repeated wherever they reach, so that positions hold."""
    open_cells: dict[int, tuple[int, str]] = {}  # column -> rows left, text
    for row in table:
        texts: list[str] = []

        def fill(texts=texts) -> None:
            while len(texts) in open_cells:
                left, text = open_cells.pop(len(texts))
                if left > 1:
                    below[len(texts)] = (left - 1, text)
                texts.append(text)

        below: dict[int, tuple[int, str]] = {}
        for _, parts, rows, columns in row:
            fill()
            text = " ".join("".join(parts).split())
            for _ in range(columns):
                if rows > 1:
                    below[len(texts)] = (rows - 1, text)
                texts.append(text)
        fill()
        for column, (left, text) in open_cells.items():
            if left > 1:
                below[column] = (left - 1, text)
        open_cells = below
        yield all(cell[0] for cell in row), texts


def extract_untidy_tables(
    pages: DataFrame, page: str = "page_id", html: str = "html"
) -> DataFrame:
    """As ``extract_tables`` for nested or unclosed markup, by a tolerant parser per page.

    Cells that span columns or rows appear at every place they cover.
    """
    page_type = pages.schema[page].dataType.simpleString()
    schema = f"{page} {page_type}, table_no int, row_no int, is_header boolean, cells array<string>"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, text in zip(batch[page], batch[html]):
                reader = _TableReader()
                reader.feed(text or "")
                reader.close()
                for t, table in enumerate(reader.tables):
                    for r, (header, texts) in enumerate(_grid(table)):
                        out.append((key, t, r, header, texts))
                        if len(out) >= ROWS_AT_ONCE:
                            yield pd.DataFrame(out, columns=names)
                            out = []
            yield pd.DataFrame(out, columns=names)

    names = [page, "table_no", "row_no", "is_header", "cells"]
    ship_package(pages.sparkSession)
    return pages.select(page, html).mapInPandas(read, schema)


def extract_links(pages: DataFrame, page: str = "page_id", html: str = "html") -> DataFrame:
    """Rows ``(page, link_no, href, link_text)`` of every anchor with a target, quoted or not.

    Character references are resolved in both; only texts that hold others than the common ones are
    taken apart. A null page has no links.
    """
    attributes, body = (F.regexp_extract_all(html, F.lit(_LINK), F.lit(k)) for k in (1, 2))
    each = F.posexplode(F.arrays_zip(attributes.alias("attributes"), body.alias("body")))
    target = F.concat(*[F.regexp_extract("col.attributes", _TARGET, k) for k in (1, 2, 3)])  # two are empty
    links = pages.select(page, each).select(
        page,
        F.col("pos").alias("link_no"),
        target.alias("href"),
        F.col("col.body").alias("body"),
    )
    # a target is decoded wherever it holds a reference, a text where the plain way cannot
    odd = F.array(
        F.when(F.col("href").contains("&"), F.col("href")),
        F.when(F.col("body").rlike(_RARE), F.regexp_replace("body", r"(?s)<[^>]*>", "")),
    )
    decoded = F.transform(odd, lambda x: F.when(x.isNotNull(), decode_references(x)))
    links = links.withColumn("decoded", decoded)
    text = F.trim(F.regexp_replace(F.translate(F.get("decoded", F.lit(1)), "\u00a0", " "), r"\s+", " "))
    return links.select(
        page,
        "link_no",
        F.coalesce(F.get("decoded", F.lit(0)), "href").alias("href"),
        F.coalesce(text, plain_text(F.col("body"))).alias("link_text"),
    )
