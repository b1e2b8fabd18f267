"""Listing rows out of HTML pages: by regular expressions, by cell class, by cell position.

Patterns stay in Spark.  Parsing runs in Arrow batches: pages of plain markup are cut
at their tags, all others go through the standard library's parser, with the same
result.  A page that cannot be parsed gives a row with an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.functions.numbers import digits
from pricewright.functions.text import trimmed

#: Rows that a results page shows at most.
PAGE_ROWS = 50


def pages(spark: SparkSession, folder: str, pattern: str = "*.html") -> DataFrame:
    """(path, make, file, body) of all pages below a folder; the make is the folder's name."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    parts = F.split("path", "/")
    return rows.select("path", F.element_at(parts, -2).alias("make"), F.regexp_replace(F.element_at(parts, -1), r"(?i)\.html?$", "").alias("file"), F.decode("content", "UTF-8").alias("body"))


def first_table(body: str) -> F.Column:
    """The page's first table, or the whole page without one."""
    return F.coalesce(F.nullif(F.regexp_extract(body, r"(?is)<table.*?</table>", 0), F.lit("")), F.col(body))


def rows_by_pattern(rows: DataFrame, body: str, min_price: int = 50_000, max_price: int = 150_000_000, years: tuple[int, int] = (1980, 2026)) -> DataFrame:
    """(..., year, price, tag) of each table row that holds a year and a price within bounds."""
    found = rows.withColumn("_row", F.explode(F.regexp_extract_all(F.col(body), F.lit(r"(?is)<tr[^>]*>.*?</tr>"), F.lit(0))))

    def cell(css: str, inner: str) -> F.Column:
        return F.regexp_extract("_row", rf'(?is)<td[^>]*class="[^"]*{css}[^"]*"[^>]*>{inner}', 1)

    year = F.coalesce(F.nullif(cell("searchResultsAttributeValue", r"\s*(\d{4})\s*</td>"), F.lit("")), F.regexp_extract("_row", r"\b(20[0-2][0-9]|19[8-9][0-9])\b", 1))
    price = F.coalesce(F.nullif(cell("searchResultsPriceValue", r".*?([\d.]+)\s*TL"), F.lit("")), F.regexp_extract("_row", r"(?i)([\d.]+)\s*TL", 1))
    tag = F.coalesce(F.nullif(cell("searchResultsTagAttributeValue", r".*?([^\s<]+).*?</td>"), F.lit("")), F.lit("Standart"))
    found = found.select(*rows.columns, digits(year).cast("int").alias("year"), digits(price).alias("price"), tag.alias("tag"))
    return found.where(F.col("price").between(min_price, max_price) & F.col("year").between(*years))


def harvested_prices(rows: DataFrame, body: str, low: int = 50_000, high: int = 100_000_000) -> DataFrame:
    """(..., price): every price with dotted thousands on a page, between the bounds."""
    texts = F.regexp_extract_all(F.col(body), F.lit(r"\d{1,3}(?:\.\d{3})+\s*TL"), F.lit(0))
    return rows.select(*(c for c in rows.columns if c != body), F.explode(texts).alias("_t")).select("*", digits(F.col("_t")).alias("price")).drop("_t").where((F.col("price") > low) & (F.col("price") < high))


def prices_or_harvest(rows: DataFrame, body: str, key: str, low: int = 50_000, high: int = 100_000_000) -> DataFrame:
    """(key, price): the prices in a page's first listing rows; of a page whose rows give none, all that its text gives.

    Keys are unique and not null.
    """
    cells = F.slice(F.regexp_extract_all(F.col(body), F.lit(r"(?is)<tr[^>]*class=\"[^\"]*searchResults?Item[^\"]*\"[^>]*>.*?</tr>"), F.lit(0)), 1, PAGE_ROWS)
    price = lambda x: digits(F.regexp_extract(x, r"(?is)<td[^>]*class=\"[^\"]*searchResultsPriceValue[^\"]*\"[^>]*>(.*?)</td>", 1))
    texts = F.regexp_extract_all(F.col(body), F.lit(r"\d{1,3}(?:\.\d{3})+\s*TL"), F.lit(0))
    within = lambda values: F.filter(values, lambda p: (p > low) & (p < high))
    shown, anywhere = within(F.transform(cells, price)), within(F.transform(texts, digits))
    return rows.select(key, F.explode(F.when(F.size(shown) > 0, shown).otherwise(anywhere)).alias("price"))


class _Table(HTMLParser):
    """Cells of table rows: (attributes of the row, [(class, text)])."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[tuple[dict, list[list[str]]]] = []
        self.depth = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "tr":
            self.rows.append((dict(attrs), []))
            self.depth = 0
        elif tag == "td" and self.rows:
            self.rows[-1][1].append([dict(attrs).get("class") or "", ""])
            self.depth = 1

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "tr"):
            self.depth = 0

    def handle_data(self, data: str) -> None:
        if self.depth:
            self.rows[-1][1][-1][1] += data


PARSED = "listing_id string, title string, year_text string, mileage_text string, price_text string, tag string, location string, error string"
NAMES = tuple(x.split()[0] for x in PARSED.split(", "))
CLASSES = {"title": "searchResultsTitleValue", "price_text": "searchResultsPriceValue", "tag": "searchResultsTagAttributeValue", "location": "searchResultsLocationValue"}
VALUES = "searchResultsAttributeValue"
#: Pages that are parsed at once; their rows are one batch, so that no task holds those of thousands of pages.
PAGES_AT_ONCE = 64

# Pages whose rows can be cut out without the parser: each row and cell is closed where it ends, all other tags are
# known ones that say nothing, attributes stand in double quotes, and there are no references, comments or scripts.
_SPACE, _TEXT = r"[ \t\n]", r"[^<&\0]*+"
_ATTRIBUTES = rf'(?:{_SPACE}++[a-z][a-z-]*+="[^"&<>\0]*+")*+{_SPACE}*+'
_OTHER = r"(?:a|b|i|p|br|div|span|strong|em|ul|li|img|h[1-6]|html|head|body|table|thead|tbody|tfoot|th)"
_LOOSE = rf"{_TEXT}(?:<(?:/{_OTHER}|{_OTHER}{_ATTRIBUTES})>{_TEXT})*+"
_PLAIN = re.compile(rf"{_LOOSE}(?:<tr{_ATTRIBUTES}>{_LOOSE}(?:<td{_ATTRIBUTES}>{_LOOSE}</td>{_LOOSE})*+</tr>{_LOOSE})*+")
_ATTRIBUTE, _TAG = re.compile(r'([a-z-]+)="([^"]*)"'), re.compile("<[^>]*>")


@lru_cache(4096)
def _class(attributes: str) -> str:
    return dict(_ATTRIBUTE.findall(attributes)).get("class", "")


@lru_cache(4096)
def _places(css: str) -> tuple[tuple[int, ...], bool]:
    """The columns that a cell's classes name, and whether they name a value."""
    names = css.split()
    return tuple(NAMES.index(column) for column, name in CLASSES.items() if name in names), VALUES in names


def _rows(body: str) -> Iterator[tuple[str, list]]:
    """(data-id, [(class, text)]) of each table row with a ``data-id``; texts may hold repeated spaces."""
    if _PLAIN.fullmatch(body) is None:
        parser = _Table()
        parser.feed(body)
        yield from ((attributes["data-id"], cells) for attributes, cells in parser.rows if attributes.get("data-id"))
        return
    for row in body.split("<tr")[1:]:
        attributes, _, inner = row.partition(">")
        listing = dict(_ATTRIBUTE.findall(attributes)).get("data-id")
        if not listing:
            continue
        cells = []
        for cell in inner.split("<td")[1:]:
            attributes, _, text = cell.partition(">")
            text = text[: text.index("</td>")]
            cells.append((_class(attributes), _TAG.sub("", text) if "<" in text else text))
        yield listing, cells


def _parse(body: str, positional: bool) -> Iterator[list]:
    """The ``PARSED`` columns of each listing row."""
    shown = 0
    for listing, cells in _rows(body):
        if positional:
            if len(cells) < 7 or shown >= PAGE_ROWS:
                continue
            text = lambda k: " ".join(cells[k][1].split())  # noqa: B023, E731
            row = [listing, text(2), text(3), text(4), text(6), text(1), text(8) if len(cells) > 8 else "", None]
        else:
            row, value = [listing, None, "", "", None, None, None, None], 2
            for css, text in cells:
                places, is_value = _places(css)
                for at in places:
                    if row[at] is None:
                        row[at] = " ".join(text.split())
                if is_value and value <= 3:
                    row[value] = " ".join(text.split())
                    value += 1
            for at in (1, 4, 5, 6):
                if row[at] is None:
                    row[at] = ""
        shown += 1
        yield row


def _parsed(rows: DataFrame, body: str, keep: Sequence[str], positional: bool) -> DataFrame:
    facts = rows.select(*keep, body)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in facts.schema if f.name != body), PARSED])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, PAGES_AT_ONCE) for whole in batches for k in range(0, whole.num_rows, PAGES_AT_ONCE)):
            at, out = [], []
            for k, text in enumerate(batch.column(len(keep)).to_pylist()):
                try:
                    found = list(_parse(text or "", positional))
                except Exception as error:  # a page that cannot be read is quarantined, not lost
                    found = [[*[None] * (len(NAMES) - 1), str(error)[:200]]]
                at += [k] * len(found)
                out += found
            take = pa.array(at, pa.int64())
            columns = [batch.column(i).take(take) for i in range(len(keep))] + [pa.array(x, pa.string()) for x in (zip(*out, strict=True) if out else [()] * len(NAMES))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *NAMES])

    found = facts.mapInArrow(parse, schema)
    return found.withColumns({"year": digits(F.col("year_text")).cast("int"), "mileage": digits(F.col("mileage_text")), "price": digits(F.col("price_text")), "title": trimmed(F.col("title"))})


def rows_by_class(rows: DataFrame, body: str, keep: Sequence[str]) -> DataFrame:
    """Table rows with a ``data-id``, cells by their class."""
    return _parsed(rows, body, keep, positional=False)


def rows_by_position(rows: DataFrame, body: str, keep: Sequence[str]) -> DataFrame:
    """Table rows with seven cells or more, by position; a page's first fifty."""
    return _parsed(rows, body, keep, positional=True)
