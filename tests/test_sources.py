"""Workbooks in their own order, file heads, and prices from rows or text."""

from __future__ import annotations

import zipfile

import pytest
from pyspark.sql import functions as F

from pricewright.operators import serving, valuation
from pricewright.sources import files, heads, html, workbook

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def cell(ref, text):
    return f'<c r="{ref}" t="inlineStr"><is><t>{text}</t></is></c>'


def sheet(*rows):
    return f"<worksheet {MAIN}><sheetData>{''.join(f'<row>{r}</row>' for r in rows)}</sheetData></worksheet>"


def write(path, sheets, listed):
    """A workbook with parts sheet1.xml... and the order in which the workbook lists them."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        for k, xml in enumerate(sheets, 1):
            book.writestr(f"xl/worksheets/sheet{k}.xml", xml)
        book.writestr("xl/workbook.xml", f"<workbook {MAIN} {REL}><sheets>{''.join(f'<sheet name=\"{n}\" r:id=\"r{k}\"/>' for n, k in listed)}</sheets></workbook>")
        book.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{''.join(f'<Relationship Id=\"r{k}\" Target=\"worksheets/sheet{k}.xml\"/>' for _, k in listed)}</Relationships>")


def test_sheets_come_in_the_workbooks_order(spark, tmp_path):
    write(tmp_path / "a.xlsx", [sheet(cell("A1", "x"), cell("A2", "one")), sheet(cell("A1", "Brand") + cell("B1", "Year"), "", cell("A3", "Audi") + cell("C3", "unnamed"), cell("B4", "2020"))], [("Second", 2), ("First", 1)])
    rows = files.workbooks(spark, str(tmp_path))
    assert rows.columns == ["path", "line", "row"]
    assert [(r.line, r.row) for r in rows.orderBy("line").collect()] == [(0, {"Brand": "Audi"}), (1, {"Year": "2020"})]
    every = files.workbooks(spark, f"file://{tmp_path}", every_sheet=True)
    assert {(r.sheet, r.line) for r in every.collect()} == {("Second", 0), ("Second", 1), ("First", 0)}
    assert every.rdd.getNumPartitions() == 2
    assert [tuple(r) for r in files.columns_of(rows, ["Brand", "Year"]).orderBy("line").collect()] == [(0, "Audi", None), (1, None, "2020")]


def test_a_large_sheet_is_a_stream(tmp_path):
    rows = [cell("A1", "k")] + [cell(f"A{k}", f"v{k}") for k in range(2, 30_002)]
    write(tmp_path / "big.xlsx", [sheet(*rows)], [("s", 1)])
    with zipfile.ZipFile(tmp_path / "big.xlsx") as book:
        found = workbook.rows_of(book, "xl/worksheets/sheet1.xml")
        assert next(found) == {"k": "v2"}  # before the rest is read
        assert sum(1 for _ in found) == 29_999


def test_old_and_empty_workbooks(spark, tmp_path):
    write(tmp_path / "none.xlsx", [sheet()], [("s", 1)])
    assert files.workbooks(spark, str(tmp_path)).collect() == []
    (tmp_path / "old.XLS").write_bytes(b"\xd0\xcf\x11\xe0")
    with pytest.raises(Exception, match="binary .xls"):
        files.workbooks(spark, str(tmp_path)).collect()


def test_brands_by_name_and_head(spark, tmp_path):
    for folder, name, text in (("x", "audi a3.html", "bmw"), ("x", "liste.html", "<title>satılık 'Tofaş' şahin</title>"), ("Lada", "liste.html", "-" * 5000 + "audi"), ("y", "mini.html", "nothing"), ("y", "z.txt", "audi")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(text)
    rows = heads.listing(spark, str(tmp_path))
    assert "content" not in rows.columns and rows.count() == 4
    found = heads.heads(rows)
    assert max(len(r.head) for r in found.collect()) <= 5000
    got = {(r.folder, r.file): r.brand for r in heads.with_brand(found, F.col("folder"), F.col("file"), F.col("head")).collect()}

    def plain(folder, file, head):
        by_name = next((b for b in heads.BRANDS if f"{b.lower()} " in file.lower()), None)
        return by_name or next((b for b in heads.BRANDS if b.lower() in head.lower()), folder)

    want = {(r.folder, r.file): plain(r.folder, r.file.replace("%20", " "), r.head) for r in found.collect()}
    assert {v for v in got.values()} == {v for v in want.values()} == {"Audi", "Tofaş", "Lada", "y"}
    gone = spark.createDataFrame([("file:/nowhere/a.html", "f", "a.html", 3)], "path string, folder string, file string, bytes long")
    assert heads.heads(gone).first()["head"] is None


def test_prices_from_rows_or_text(spark):
    item = lambda price: f'<tr class="searchResultsItem"><td class="searchResultsPriceValue"><b>{price} TL</b></td></tr>'
    rows = [("rows", f"<p>700.000 TL</p>{item('600.000')}{item('10')}"), ("none valid", f"<p>700.000 TL 1.234 TL</p>{item('10')}"), ("text", "a 60.000TL b 1.500.000 TL"), ("nothing", "x"), ("null", None), ("many", item("60.000") * 70)]
    got = html.prices_or_harvest(spark.createDataFrame(rows, "k string, body string"), "body", "k").groupBy("k").agg(F.sort_array(F.collect_list("price")).alias("p"))
    assert {r.k: r.p for r in got.collect()} == {"rows": [600_000], "none valid": [700_000], "text": [60_000, 1_500_000], "many": [60_000] * 50}


def test_facets_under_each_others_choices(spark):
    rows = spark.createDataFrame([("A", "x", 1), ("A", "y", 1), ("B", "x", 1), ("B", "x", 1), (None, "x", 1), ("C", "z", 2)], "variant string, body string, year int")
    got = {(r.facet, r.choice): (r.n, r["rank"], r.n_choices) for r in serving.facet_counts(rows, {"year": 1}, {"body": "x", "variant": "A"}, ("variant", "body"), top=1).collect()}
    assert got == {("variant", "B"): (2, 1, 2), ("body", "x"): (1, 1, 2)}
    assert serving.facet_counts(rows.limit(0), {}, {}, ("variant",)).collect() == []


def test_stored_valuations_are_matched_without_trim(spark):
    snap = spark.createDataFrame(
        [("A", "b", "c", 2020, 20, 900_000, 950_000, 1_000_000, 1_010_000, 1_200_000, 50_000, 0.0025, "DEFAULT_FALLBACK", "", "Sedan", "Benzin", "Manuel", "id")],
        "make string, model string, variant string, year int, n long, p5 long, p35 long, p50 long, p60 long, p95 long, median_mileage long, decay double, decay_source string, trim string, body string, fuel string, transmission string, snapshot_id string",
    )
    asked = spark.createDataFrame([("r", "A", "b", "c", 2020, 50_000, "NO", 0.0, "Line", "sedan", "benzin", "manuel"), ("q", "Z", "b", "c", 2020, 1, "NO", 0.0, "", "", "", "")], "request_id string, make string, model string, variant string, year int, mileage long, damage string, desired double, trim string, body string, fuel string, transmission string")
    assert {r.request_id: r.level for r in valuation.valued(asked, snap).collect()} == {"r": 2, "q": 4}
    assert {r.request_id: r.level for r in valuation.persisted(asked, snap).collect()} == {"r": 1}
