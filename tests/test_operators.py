"""Operators on small tables."""

from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from pricewright.functions import numbers
from pricewright.operators import imports, listings, mutations, prices, requests, serving, snapshots, versions
from pricewright.operators.normalize import BAD_MAKE, BAD_MODEL, canonical
from pricewright.sources import files, html
from pricewright.streaming import jobs


@pytest.mark.parametrize(
    ("make", "model", "title", "want"),
    [
        ("DS Automobiles", "DS 4 Fiyatları & Modelleri sahibinden.com'da - 2", "", ("DS Automobiles", "DS 4", None)),
        ("DS Automobiles", "DS Automobiles & Modelleri sahibinden.com'da - 4", "", ("DS Automobiles", None, BAD_MODEL)),
        ("BYD", "BYD Atto 3 Fiyatları sahibinden.com'da - 1", "", ("BYD", "Atto 3", None)),
        ("Cupra", "Cupra Formentor 1.5 TSI VZ - 3", "", ("Cupra", "Formentor", None)),
        ("Daihatsu", "Daihatsu Genel Model", "", ("Daihatsu", None, BAD_MODEL)),
        ("Citroën", "C3 Aircross", "", ("Citroen", "C3", None)),
        ("bmw", "Sedan", "320i temiz", ("BMW", "3 Serisi", None)),
        ("", "Golf", "", ("", None, BAD_MAKE)),
        ("Opel", "Opel", "", ("Opel", None, BAD_MODEL)),
    ],
)
def test_canonical(spark, make, model, title, want):
    df = spark.createDataFrame([(make, model, "Standart", title)], "make string, model string, variant string, title string")
    r = df.select(canonical(*(F.col(c) for c in ("make", "model", "variant", "title"))).alias("n")).first()["n"]
    assert (r["make"], r["model"] if r["is_valid"] else None, r["reason"]) == want
    assert r["variant"] is None


RAW = "source string, listing_id string, make string, model string, variant string, title string, year string, mileage string, price string"


def test_split_prefers_quarantine_and_is_repeatable(spark):
    rows = [
        ("w", "1", "Audi", "A3", "1.6", "temiz", "2020", "50.000 km", "900.000 TL"), ("w", "1", "Audi", "A3", "1.6", "temiz", "2020", "50.000 km", "850.000 TL"),
        ("w", "2", "Audi", "A3", "1.6", "pert", "2020", "2.020", "900.000 TL"), ("w", "3", "Audi", "A3", "", "", "1900", "1", "900.000"), ("w", "4", "Audi", "A3", "", "", "2020", "1", "9"),
        ("w", "2", "Audi", "A3", "", "", "2020", "", ""), ("x", "2", "Audi", "A4", None, None, "2021", None, "1.000.000"),
    ]
    valid, bad = listings.split(listings.judged(spark.createDataFrame(rows, RAW)))
    assert [(r.source, r.listing_id, r.price) for r in valid.orderBy("source", "listing_id").collect()] == [("w", "1", 850_000), ("x", "2", 1_000_000)]
    assert {(r.listing_id, r.reason) for r in bad.collect()} == {("2", listings.BAD_PRICE), ("3", listings.BAD_YEAR), ("4", listings.BAD_PRICE)}
    assert listings.split(listings.judged(spark.createDataFrame([], RAW)))[0].count() == 0


def test_mutations(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "id int, name string, price int")
    new = spark.createDataFrame([(2, "B", 25), (3, "c", 30)], "id int, name string, price int")
    get = lambda df: sorted(map(tuple, df.select("id", "name", "price").collect()))
    assert get(mutations.upsert(old, new, ["id"])) == [(1, "a", 10), (2, "B", 25), (3, "c", 30)]
    assert get(mutations.upsert(old, new, ["id"], ["price"])) == [(1, "a", 10), (2, "b", 25), (3, "c", 30)]
    assert get(mutations.find_or_create(old, new, ["id"])) == [(1, "a", 10), (2, "b", 20), (3, "c", 30)]
    assert get(mutations.replace_groups(old, new, ["id"])) == [(1, "a", 10), (2, "B", 25), (3, "c", 30)]
    assert mutations.changed(old, new, ["id"], ["price"]).collect()[0]["price"] == 25
    assert get(mutations.upsert(old.limit(0), new, ["id"])) == [(2, "B", 25), (3, "c", 30)]


def test_upsert_of_repeated_and_null_keys(spark):
    schema = "id int, name string, price int"
    old = spark.createDataFrame([(1, "a", 10), (None, "n", 1)], schema)
    new = spark.createDataFrame([(1, "b", 7), (1, "b", 5), (None, "m", 2), (4, "d", 4), (4, "c", 9)], schema)
    assert sorted(map(tuple, mutations.upsert(old, new, ["id"]).collect()), key=str) == sorted([(1, "b", 5), (None, "m", 2), (4, "c", 9)], key=str)


def test_an_incomplete_pointer_is_not_read(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    versions.publish(spark.range(3), folder, "1")
    (tmp_path / "t" / "._current-000000000009.json-left").write_text("{")
    assert versions.read(spark, folder).count() == 3
    versions.publish(spark.range(4), folder, "2")
    assert versions.read(spark, folder).count() == 4


def test_checked_requests(spark):
    rows = spark.createDataFrame([("34ABC123", "05321234567", "5"), ("82A12", "5321234567", "-1"), (None, "123", "x"), ("34ABC123", "05321234567", " ")], "plate string, phone string, desired string")
    found = requests.checked(rows, ["plate", "phone", "desired"], not_negative=["desired"])
    assert [r.errors for r in found.collect()] == [[], ["desired:negative", "plate:pattern"], ["desired:number", "phone:pattern", "plate:required"], ["desired:required"]]
    good, bad = requests.accepted(found)
    assert good.columns == rows.columns and (good.count(), bad.count()) == (1, 3)


def test_log_is_only_appended_to(spark, tmp_path):
    events = spark.sql("SELECT timestamp'2024-01-02 03:04:05' AS ts, 'x' AS what")
    for _ in range(2):
        requests.logged(events, f"file://{tmp_path}/log")
    assert spark.read.parquet(f"file://{tmp_path}/log").where("day = '2024-01-02'").count() == 2
    assert requests.by_key(events, "what", "x").count() == 1


def test_publish_keeps_readers_and_refuses_empty_versions(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    versions.publish(spark.range(3), folder, "1")
    reader = versions.read(spark, folder)
    versions.publish(spark.range(5), folder, "2")
    assert (reader.count(), versions.read(spark, folder).count()) == (3, 5)
    with pytest.raises(ValueError, match="too few"):
        versions.publish(spark.range(0), folder, "3")
    assert versions.read(spark, folder).count() == 5


def test_snapshot_of_a_segment(spark):
    rows = [(f"l{k}", "A", "B", "C", 2020, 1_000_000 - 10_000 * k, 10_000 * k, False) for k in range(1, 11)] + [("d", "A", "B", "C", 2020, 60_000, 1, True)]
    df = spark.createDataFrame(rows, "listing_id string, make string, model string, variant string, year int, price long, mileage long, is_damaged boolean")
    s = snapshots.snapshots(df).first()
    assert (s.n, s.p50, s.decay_source, s.n_mileages, s.median_mileage) == (10, 950_000, "LEARNED_FROM_LISTINGS", 10, 60_000)
    assert s.slope == pytest.approx(-10_000) and s.decay == pytest.approx(10_000 / 950_000)
    assert s.listing_ids == sorted(r[0] for r in rows[:-1]) and s.body == ""
    assert snapshots.snapshots(df.limit(0)).count() == 0


def test_facets_damage_and_permissions(spark):
    specs = spark.createDataFrame([("A", "x", "p"), ("A", "x", None), ("B", "y", "q")], "variant string, body string, package string")
    found = {r.facet: (r.choices, r.auto) for r in serving.facets(specs, {}, {"variant": "A"}, ("variant", "body", "package")).collect()}
    assert found == {"variant": (["A", "B"], None), "body": (["x"], "x"), "package": (["p"], "p")}
    parts = F.create_map(F.lit("Tavan"), F.lit("DEGISEN"), F.lit("Kapı"), F.lit("BOYALI"))
    row = spark.range(1).select(serving.damage_points(parts, {"heavy_damage": F.lit(True)}).alias("p"), serving.damage_points(parts, {"heavy_damage": F.lit(True), "chassis_action": F.lit(True)}).alias("most")).first()
    assert (row.p, row.most) == (45, 60)
    assert spark.range(1).select(serving.permitted(F.array(F.lit("a")), F.lit(None).cast("array<string>"))).first()[0] is True
    assert spark.range(1).select(serving.permitted(F.lit(None).cast("array<string>"), F.array(F.lit("a")))).first()[0] is False


def test_import_tells_headers_apart_by_case(spark):
    rows = spark.createDataFrame([(1, "", "Audi", "A3", "1.6", "2020", "0"), (2, "BMW", "x", "X5", "3.0", "2021", "150"), (3, "", "", "A", "B", "2020", "1")], ["line", "brand", "Brand", "model", "variant", "year", "horsepower"])
    out = {r.line: (r.make, r.year, r.horsepower, r.body, r.market_average) for r in imports.imported(rows).collect()}
    assert out == {1: ("Audi", 2020, 110.0, "Sedan", 500_000.0), 2: ("BMW", 2021, 150.0, "Sedan", 500_000.0)}


PAGE = """<html><table><tr class="searchResultsItem" data-id="7"><td class="searchResultsTagAttributeValue"> 1.6 TDI </td><td class="searchResultsTitleValue"><a>Temiz &amp; bakımlı</a></td>
<td class="searchResultsAttributeValue"> 2018 </td><td class="searchResultsAttributeValue">120.000</td><td class="searchResultsPriceValue"><span>950.000 TL</span></td></tr>
<tr><td>no id</td></tr></table></html>"""
CELLS = "<table><tr data-id='9'>" + "".join(f"<td>{x}</td>" for x in ("", "A3", "Temiz", "2019", "10.000", "Beyaz", "800.000 TL", "", "İzmir / Konak")) + "</tr></table>"


def test_html_pages(spark, tmp_path):
    folder = tmp_path / "Audi"
    folder.mkdir()
    (folder / "A3.html").write_text(PAGE)
    (folder / "A4.html").write_text(CELLS)
    (folder / "notes.txt").write_text("no page")
    pages = html.pages(spark, str(tmp_path))
    assert sorted((r.make, r.file) for r in pages.collect()) == [("Audi", "A3"), ("Audi", "A4")]
    row = html.rows_by_class(pages.where("file = 'A3'"), "body", ["make", "file"]).first()
    assert (row.listing_id, row.title, row.year, row.mileage, row.price, row.tag) == ("7", "Temiz & bakımlı", 2018, 120_000, 950_000, "1.6 TDI")
    row = html.rows_by_position(pages.where("file = 'A4'"), "body", ["make"]).first()
    assert (row.year, row.price, row.location) == (2019, 800_000, "İzmir / Konak")
    assert [(r.year, r.price, r.tag) for r in html.rows_by_pattern(pages.where("file = 'A3'"), "body").collect()] == [(2018, 950_000, "1.6")]
    assert [r.price for r in html.harvested_prices(pages, "body").orderBy("price").collect()] == [800_000, 950_000]
    empty = spark.createDataFrame([(None,), ("",)], "body string")
    assert html.rows_by_class(empty, "body", []).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Brand,Model\nAudi,"A3, temiz"\n')
    assert tuple(files.csv(spark, str(tmp_path / "a.csv")).first()) == ("Audi", "A3, temiz")
    (tmp_path / "a.json").write_text('[{"make": "Audi"}, {"make": "BMW"}]')
    (tmp_path / "b.json").write_text('{"make": "Opel"}')
    assert sorted(r.make for r in files.json_rows(spark, str(tmp_path / "*.json")).collect()) == ["Audi", "BMW", "Opel"]
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as book:
        book.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Brand</t></si><si><t>Audi</t></si></sst>")
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>Year</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="B2"><v>2020</v></c></row></sheetData></worksheet>')
    (tmp_path / "c.xlsx").write_bytes(data.getvalue())
    rows = files.columns_of(files.workbooks(spark, str(tmp_path)), ["Brand", "Year"])
    assert [tuple(r) for r in rows.collect()] == [(0, "Audi", "2020")]


def test_streams(spark, tmp_path):
    schema = "source string, listing_id string, price long"
    for k, rows in enumerate(([("w", "1", 10), ("w", "2", 20)], [("w", "2", 25), ("w", "3", 30)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        jobs.ingest(stream, f"file://{tmp_path}/table", f"{tmp_path}/checkpoint").awaitTermination()
        assert versions.read(spark, f"file://{tmp_path}/table").count() == 2 + k
    assert sorted(r.price for r in versions.read(spark, f"file://{tmp_path}/table").collect()) == [10, 25, 30]
    events = spark.createDataFrame([("2024-01-01 01:00:00", "a", 1.0), ("2024-01-01 05:00:00", "a", 2.0), ("2024-01-05 00:00:00", "b", 1.0)], "t string, event_type string, value double").select(F.to_timestamp("t").alias("ts"), "event_type", "value")
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    query = jobs.event_counts(stream).writeStream.format("memory").queryName("counts").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c2").start()
    query.awaitTermination()
    assert [(r.event_type, r.n, r.total) for r in spark.table("counts").collect()] == [("a", 2, 3.0)]
    snaps = spark.createDataFrame([("A", "B", "C", 2020, 100)], "make string, model string, variant string, year int, p50 int")
    rows = spark.createDataFrame([("A", "B", "C", 2020, 80), ("A", "B", "C", 2020, 90)], "make string, model string, variant string, year int, price int")
    assert [r.price for r in jobs.price_alerts(rows, snaps).collect()] == [80]


def test_percentiles_without_lists_agree_with_those_of_arrays(spark):
    prices_of = {"a": [5, 1, 1, 9, 7, 3, 3, 3, 8, 2, 6, 4], "b": [10], "c": [4, 4], "d": [1, 2, 3, 4, 5], "e": [None], "f": list(range(1, 101))}
    rows = spark.createDataFrame([(k, x) for k, v in prices_of.items() for x in v], "k string, price long")
    got = {r.k: r for r in snapshots.percentile_prices(rows, ["k"]).collect()}
    arrays = rows.where("price > 0").groupBy("k").agg(F.array_sort(F.collect_list(F.col("price").cast("double"))).alias("v"))
    want = arrays.select("k", F.size("v").alias("n"), *(numbers.interpolated(F.col("v"), p).alias(f"p{p}") for p in (5, 35, 50, 60, 95)), numbers.trimmed_mean(F.col("v")).alias("clean_average"))
    assert got == {r.k: r for r in want.collect()} and "e" not in got
    flat = {r.k: (r.n, r.cash_price, r.max_price) for r in prices.fanned_out(rows, ["k"], (2024,)).collect()}
    assert flat == {k: (len(v), v[int(len(v) * 0.35)] if v else None, v[int(len(v) * 0.95)] if v else None) for k, v in ((k, sorted(x for x in v if x is not None)) for k, v in prices_of.items())}
