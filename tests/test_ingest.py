"""Runs of pages: sides, actions, quarantine, and snapshots of touched segments only."""

from __future__ import annotations

import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from pricewright.operators import ingest, normalize, snapshots, versions
from pricewright.plans import jobs
from pricewright.sources import html

BROKEN = "<table><tr data-id='1'><td><![bad[x]]>"


def row(listing, price, title="temiz", year=2018, km="120.000", tag="1.6"):
    value = lambda css, x: f'<td class="searchResults{css}">{x}</td>'
    return f'<tr data-id="{listing}">' + value("TagAttributeValue", tag) + value("TitleValue", title) + value("AttributeValue", year) + value("AttributeValue", km) + value("PriceValue", f"{price} TL") + "</tr>"


def page(*rows):
    return f"<html><table>{''.join(rows)}</table></html>"


@pytest.fixture
def run(spark, tmp_path):
    """Ingest (page, body) pairs as a run; the tables served after it."""
    folder = f"file://{tmp_path}/t"

    def go(number, pages, specs=None):
        specs = spark.createDataFrame(specs or [], "make string, model string, variant string, year int, body string, fuel string, transmission string")
        ingest.run(spark.createDataFrame(pages, "page string, body string"), specs, folder, number)
        at = versions.head(spark, folder)
        return [versions.read(spark, folder, part, at) for part in ("listings", "quarantine", "snapshots")]

    return go


def facts(found, *columns):
    return {r.listing_id: tuple(r[c] for c in columns) for r in found.collect()}


def test_two_runs(spark, run):
    first = [
        ("x/Audi/A3.html", page(row("a", 900_000), row("b", 10), row("c", 800_000, tag="pert"), row("a", 950_000), row("d", 700_000), row("s", 600_000))),
        ("x/BYD/BYD.html", page(row("d", 700_000), row("e", 500_000, title="seal"))), ("x/Opel/Corsa.html", page(row("o", 500_000), row("p", 510_000))), ("x/Opel/none.html", None), ("empty.html", ""),
    ]
    listings, bad, snaps = run(1, first, [("opel", "corsa", "1.6", 2018, "Hatchback", "Benzin", "Manuel")])
    got = facts(listings, "status", "price", "make", "model", "is_damaged", "action", "first_run", "last_run")
    assert got["a"] == ("VALID", 900_000, "Audi", "A3", False, "created", 1, 1) and got["c"][4] is True
    assert got["b"][:2] == ("QUARANTINED", 10) and got["d"][:2] == ("QUARANTINED", 700_000)  # valid on one page, refused on another
    assert got["e"][:4] == ("VALID", 500_000, "BYD", "Seal") and set(got) == set("abcdeops")
    assert {(r.listing_id, r.reason, r.first_run, r.last_run) for r in bad.collect()} == {("b", "GEÇERSİZ_FİYAT", 1, 1), ("d", "GEÇERSİZ_MODEL_TESPİTİ", 1, 1)}
    assert {(r.make, r.model, r.n) for r in snaps.collect()} == {("Audi", "A3", 2), ("BYD", "Seal", 1), ("Opel", "Corsa", 2)}

    second = [("x/Audi/A3.html", page(row("a", 20), row("b", 600_000), row("c", 800_000), row("d", 690_000), row("s", 600_000))), ("x/Audi/A4.html", page(row("n", 1_000_000))), ("x/Audi/odd.html", BROKEN)]
    listings, bad, snaps = run(2, second, [("opel", "corsa", "1.6", 2018, "Sedan", "", "")])
    got = facts(listings, "status", "price", "action", "first_run", "last_run")
    assert got["a"] == ("QUARANTINED", 20, "quarantined", 1, 2) and got["b"] == ("VALID", 600_000, "restored", 1, 2) and got["d"] == ("VALID", 690_000, "restored", 1, 2)
    assert got["c"][2] == "updated" and got["s"][2] == "seen" and got["n"] == ("VALID", 1_000_000, "created", 2, 2) and got["o"] == ("VALID", 500_000, None, 1, 1)
    held = {(r.listing_id, r.reason.split(":")[0], r.price, r.first_run, r.last_run) for r in bad.collect()}
    assert {("a", "GEÇERSİZ_FİYAT", 20, 2, 2), ("b", "GEÇERSİZ_FİYAT", 10, 1, 1), ("d", "GEÇERSİZ_MODEL_TESPİTİ", 700_000, 1, 1), ("ERROR_odd", "PARSER_EXCEPTION", None, 2, 2)} == held
    valid = listings.where("status = 'VALID'")
    same = ["make", "model", "variant", "year", "n", "p5", "p50", "p95", "mean_mileage"]
    assert sorted(map(tuple, snaps.select(*same).collect())) == sorted(map(tuple, snapshots.snapshots(valid).select(*same).collect()))
    # No listing of this model was touched: its snapshot was taken over, with the data of the first run.
    assert snaps.where("make = 'Opel'").first().body == "Hatchback"
    assert {(r.make, r.model) for r in ingest.touched(listings).collect()} == {("Audi", "A3"), ("Audi", "A4")}

    again = run(2, second)
    assert all(sorted(map(str, a.collect())) == sorted(map(str, b.collect())) for a, b in zip(again, (listings, bad, snaps), strict=True))
    listings, bad, _ = run(3, second)
    assert {r.action for r in listings.where("last_run = 3").collect()} == {"seen"}
    assert bad.count() == len(held) and bad.where("listing_id = 'a'").first().last_run == 3


def test_two_runs_at_once_are_both_merged(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    specs = spark.createDataFrame([], "make string, model string, variant string, year int, body string, fuel string, transmission string")
    pages = lambda k: spark.createDataFrame([(f"Audi/A{k}.html", page(*(row(f"{k}-{i}", 500_000 + i) for i in range(5))))], "page string, body string")
    ingest.run(pages(3), specs, folder, 1)

    def change(number, k):
        # Both take the same number's turn: the run note is only told apart by the writer that comes later.
        return ingest.run(pages(k), specs, folder, number)

    with ThreadPoolExecutor(2) as pool:
        list(pool.map(change, (2, 3), (4, 6)))
    found = versions.read(spark, folder, "listings").count()
    assert found in (10, 15) and versions.head(spark, folder).notes["run"] == 3
    if found == 10:  # the later number came first, so the earlier one counts as merged
        ingest.run(pages(4), specs, folder, 4)
        assert versions.read(spark, folder, "listings").count() == 15


def test_empty_tables(spark, run):
    for number in (1, 2):
        assert [t.count() for t in run(number, [("a/b.html", None)])] == [0, 0, 0]


def test_plain_pages_are_cut_without_the_parser(monkeypatch):
    body = page(row("a", 900_000), row("b", 10, title="<a>bir  iki</a>", tag=" 1.6\n"), "<tr><th>x</th></tr>")

    def refuse():
        raise AssertionError("the parser was asked")

    monkeypatch.setattr(html, "_Table", refuse)
    assert [r[:6] for r in html._parse(body, False)] == [["a", "temiz", "2018", "120.000", "900000 TL", "1.6"], ["b", "bir iki", "2018", "120.000", "10 TL", "1.6"]]
    for odd in ("<td>1 &amp; 2</td>", "<!-- x -->", "<TD>1</TD>", "<td>1", "a < b", "<td class='q'>1</td>", "<script>x</script>"):
        with pytest.raises(AssertionError):
            list(html._parse(page(f'<tr data-id="1">{odd}</tr>'), False))


@pytest.mark.parametrize("positional", [False, True])
def test_cut_pages_give_what_the_parser_gives(monkeypatch, positional):
    rng = random.Random(positional)
    inner = ["text", " a \n b\xa0", "<a>", "</a>", '<span class="x">', "</span>", "<br>", "&amp;", "<", "</td>", "<!-- c -->", "<td>", "</tr>", "<tr>", "\0", "<b x='1'>", "<br/>"]
    classes = ['class="searchResultsTitleValue"', 'class="searchResultsAttributeValue x"', 'class="searchResultsAttributeValue searchResultsPriceValue"', 'title="q" class="searchResultsTagAttributeValue" ', 'class="a" class="searchResultsLocationValue"', ""]

    def cell():
        return f"<td {rng.choice(classes)}>" + "".join(rng.choice(inner[:7] if rng.random() < 0.95 else inner) for _ in range(rng.randrange(4))) + "</td>"

    def rows():
        return "".join(f"<tr {rng.choice(['', 'data-id=\"1\"', 'data-id=\"\"', 'class=\"q\" data-id=\"2\"'])}>{''.join(cell() for _ in range(rng.randrange(11)))}</tr>" for _ in range(rng.randrange(4)))

    def found(body):
        try:
            return [list(r) for r in html._parse(body, positional)]
        except Exception as error:
            return str(error)

    bodies = [rng.choice(["", "<p>x</p>", "<table>", "&"]) + rows() for _ in range(3000)]
    plain = sum(html._PLAIN.fullmatch(b) is not None for b in bodies)
    cut = [found(b) for b in bodies]
    monkeypatch.setattr(html, "_PLAIN", html.re.compile(r"(?!)"))
    assert [found(b) for b in bodies] == cut and 500 < plain < 2900 and sum(map(len, cut)) > 500


def test_pages_are_parsed_once(spark):
    pages = spark.createDataFrame([("x/Audi/A3.html", page(row("a", 900_000))), ("x/Audi/odd.html", BROKEN)], "page string, body string")
    found = ingest.judged(pages)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = {r.listing_id: r for r in found.collect()}
    assert got["a"].reason is None and got["a"].variant == "1.6"
    odd = got["ERROR_odd"]
    assert (odd.make, odd.model, odd.variant, odd.title, odd.year, odd.price, odd.is_damaged, odd.status, odd.raw_make, odd.raw_model) == ("", "", "", "unreadable page: odd", None, None, False, "QUARANTINED", "Audi", "odd")


def test_rules_of_names_are_read_once_and_pages_names_told_before(spark):
    names = spark.createDataFrame([("AUDI", "x", "1.6", "a4 temiz"), ("Arora", "q", "s1", None), (None, "A3", None, None), ("BYD", "x", "y", "z")], "make string, model string, variant string, title string")
    columns = [F.col(c) for c in names.columns]
    plain = names.select(normalize.canonical(*columns).alias("n"))
    assert plain._jdf.queryExecution().optimizedPlan().toString().count("VOLKSWAGEN") == 1
    before = names.withColumn("told", normalize.named(F.col("make"), F.col("model"))).select(normalize.canonical(*columns, name=F.col("told")).alias("n"))
    assert plain.collect() == before.collect()
    assert [(r.n.make, r.n.model) for r in plain.collect()] == [("Audi", "A4"), ("Arora", "S1"), ("", "A3"), ("BYD", "x")]


def test_a_first_run_is_merged_into_nothing(spark):
    new = ingest.one_each(ingest.judged(spark.createDataFrame([("x/Audi/A3.html", page(row("a", 900_000), row("b", 10)))], "page string, body string")))
    for first, empty in ((ingest.merged(None, new, 3), ingest.merged(spark.createDataFrame([], ingest.LISTINGS), new, 3)), (ingest.quarantine(None, new, 3), ingest.quarantine(spark.createDataFrame([], ingest.QUARANTINE), new, 3))):
        assert "Join" not in first._jdf.queryExecution().optimizedPlan().toString()
        assert [(f.name, f.dataType) for f in first.schema] == [(f.name, f.dataType) for f in empty.schema]
        assert sorted(map(str, first.collect())) == sorted(map(str, empty.collect()))


@pytest.mark.parametrize("query", ["ingest_publish", "ingest_listings", "ingest_snapshots"])
def test_listings_are_joined_once_for_both_runs(spark, monkeypatch, query):
    files, run = [], ingest.run
    monkeypatch.setattr(ingest, "run", lambda pages, *rest: (files.append(pages.inputFiles()), run(pages, *rest))[1])
    getattr(jobs, query)(spark, "/root/testdata/sf0.001")
    assert len(files) == 2 and not any("lineitem" in f for found in files for f in found)


def test_rows_are_sorted_by_their_ids_first(spark):
    rows = ingest.judged(spark.createDataFrame([("x/Audi/A3.html", page(row("a", 900_000), row("b", 10)))], "page string, body string"))
    rows = spark.createDataFrame(rows.collect(), rows.schema)  # stored rows, whose source is no constant
    held = spark.createDataFrame([], ingest.QUARANTINE)
    for made in (ingest.one_each(rows), ingest.merged(rows.select("*", *(F.lit(None).cast("long").alias(c) for c in ("first_run", "last_run"))), rows, 2), ingest.quarantine(None, rows, 1)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        sorts = [line.split("Sort [")[1] for line in plan.splitlines() if "Sort [" in line]
        assert sorts and not any(x.startswith(("source", "o_source", "n_source")) for x in sorts)
    assert ingest.quarantine(held, rows, 1).columns == ingest.quarantine(None, rows, 1).columns == held.columns
