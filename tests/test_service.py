"""The service's reads and writes: the stock in bulk, reports, choices, price moves, words of damage."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pricewright.functions import text as X
from pricewright.operators import market_sync, reports, serving, valuation, versions
from pricewright.plans import service
from pricewright.plans import views as V
from pricewright.plans.market import _snapshots

SF = "/root/testdata/sf0.001"


def test_bulk_values_equal_single_ones(spark):
    asked = service.stock(spark, SF).where("year = 1998 AND request_id LIKE '%-1'")
    # Rows of one vehicle, of none, and with nulls in what a match depends on; and a column that a figure is named like.
    odd = asked.limit(3).withColumns({"request_id": F.concat(F.lit("x"), "request_id"), "variant": F.lit(None).cast("string")}).unionByName(asked.limit(2).withColumns({"request_id": F.concat(F.lit("y"), "request_id"), "year": F.lit(None).cast("int")}))
    asked, snaps = asked.unionByName(odd).unionByName(asked.limit(1).withColumn("request_id", F.lit("z"))), _snapshots(spark, SF)
    columns = ["request_id", "status", *valuation.OFFER, "level", "n", "snapshot_id"]
    one = valuation.valued(asked, snaps, V.CONFIG).select(*columns)
    bulk = valuation.valued_in_bulk(asked.withColumn("level", F.lit("mine")), snaps, V.CONFIG).select(*columns)
    assert sorted(map(str, one.collect())) == sorted(map(str, bulk.collect())) and bulk.count() == asked.count()
    assert valuation.valued_in_bulk(asked.limit(0), snaps, V.CONFIG).count() == 0


def test_choices(spark):
    rows = spark.createDataFrame([("a", "x", "1"), ("a", "x", "1"), ("a", "x", "2"), ("a", "y", None), ("b", None, None), (None, "z", "9")], "make string, model string, variant string")
    got = {tuple(r) for r in serving.choices(rows, ("make", "model", "variant")).collect()}
    assert got == {(3, "a", "x", "1", 2, 0), (3, "a", "x", "2", 1, 0), (3, None, "z", "9", 1, 0), (2, "a", "x", None, 3, 2), (2, "a", "y", None, 1, 0), (2, None, "z", None, 1, 1), (1, "a", None, None, 4, 2), (1, "b", None, None, 1, 0)}
    assert serving.choices(rows.limit(0), ("make",)).collect() == []


def _report(spark, n: int, least: int):
    rows = spark.createDataFrame([(k, f"name | {k}\nx" if k % 2 else None, 1000 * k) for k in range(n)], "id int, name string, price int")
    facts = rows.agg(F.count("*").alias("rows"), F.max("price").alias("highest"))
    return reports.lines(rows, facts, {"enough": ("rows", F.col("rows") >= least), "a price": ("highest", F.col("highest") > 0)}, "Prices", {"name": "Name", "price": "Price"}, [F.col("price").desc(), F.col("id")], top=2)


def test_report_of_both_kinds(spark, tmp_path):
    folder = f"file://{tmp_path}/reports"
    text = lambda name: "".join(p.read_text() for p in Path(tmp_path, "reports", name).glob("part-*"))
    assert reports.write(_report(spark, 4, 4), folder, "p")
    assert text("p") == "# Prices\n| # | Name | Price |\n| ---: | ---: | ---: |\n| 1 | name   3 x | 3.000 |\n| 2 | - | 2.000 |\n- rows: 4\n- highest: 3.000\n"
    assert not reports.write(_report(spark, 4, 5), folder, "p")
    assert text("p-failed") == "# Prices: failed\n- enough: 4\n" and not Path(tmp_path, "reports", "p").exists()
    # Without rows the highest price is null, and its rule has failed.
    assert not reports.write(_report(spark, 0, 0), folder, "p")
    assert text("p-failed") == "# Prices: failed\n- a price: -\n"
    assert reports.write(_report(spark, 1 + 1, 0), folder, "p") and not Path(tmp_path, "reports", "p-failed").exists()


def test_market_sync(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/specs"
    rows = spark.createDataFrame([("a", 1000.0), ("b", 1001.0), ("b", 0.0), ("b", None)], "make string, msrp double")
    with pytest.raises(FileNotFoundError):
        market_sync.monthly(spark, folder, "2026-01")
    versions.publish(rows, folder, "specs")
    prices = lambda: [r.msrp for r in market_sync.specs(spark, folder).orderBy("make", F.col("msrp").desc()).collect()]
    assert market_sync.settings(spark, folder) == market_sync.Settings()
    assert market_sync.adjust(spark, folder, 50, ["b"]).updated == 1 and prices() == [1000.0, 1502.0, 0.0, None]
    first = market_sync.monthly(spark, folder, "2026-01")
    assert (first.updated, first.last_month) == (2, "2026-01") and prices() == [1025.0, 1540.0, 0.0, None]
    assert market_sync.monthly(spark, folder, "2026-01") == first and market_sync.monthly(spark, folder, "2025-12") == first and prices()[0] == 1025.0
    market_sync.save(spark, folder, enabled=False, monthly_percent=10.0)
    assert market_sync.monthly(spark, folder, "2026-02").last_month == "2026-01" and prices()[0] == 1025.0
    market_sync.save(spark, folder, enabled=True)
    # Another writer comes first: the change starts again from what it left.
    stage, met = versions.stage, []

    def late(*args):
        out = stage(*args)
        if not met:
            met.append(market_sync.save(spark, folder, cash_percent=9.0))
        return out

    monkeypatch.setattr(versions, "stage", late)
    now = market_sync.monthly(spark, folder, "2026-02")
    assert (now.cash_percent, now.last_month) == (9.0, "2026-02") and prices() == [1128.0, 1694.0, 0.0, None]
    assert market_sync.settings(spark, folder) == now


def test_words_of_damage(spark):
    rows = spark.createDataFrame([("Ağır HASAR",), ("agir hasar",), ("Hasarlı",), ("tavan boyalı",), ("boyalı",), ("expert",), ("",), (None,)], "t string")
    assert [r[0] for r in rows.select(X.damage_level(F.col("t"))).collect()] == ["heavy", "record", "record", "paint", None, "heavy", None, None]
    assert rows.select(X.short_id(F.lit("0123456789"))).first()[0] == "01234567"
