"""Queries over whole tables: no row is left out, and results grow with the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricewright import plans
from pricewright.plans import views as V

SF = "/root/testdata/sf0.01"


def test_every_customer_is_judged(spark):
    got = plans.queries()["permission_check"](spark, SF)
    assert got.count() == V.table(spark, SF, "customer").count() > 1001
    assert got.where("c_custkey > 1000").select("permitted").distinct().count() == 2


def test_every_listing_is_on_a_page(spark):
    got = plans.queries()["html_parsed"](spark, SF).cache()
    want = V.unique_listings(spark, SF).select("listing_id", "price")
    assert got.count() == want.count()
    assert got.select("listing_id", "price").exceptAll(want).count() == 0
    assert got.groupBy("page").count().agg(F.max("count")).first()[0] <= 100
    many = V.unique_listings(spark, SF).groupBy("make", "model").count().where("count > 50").count()
    assert got.select("page").distinct().count() >= want.join(got, "listing_id").select("title").distinct().count() + many


def test_valid_and_quarantined_listings_grow_with_the_table(spark):
    of = plans.queries()["quarantine_split"]
    valid, bad = ([of(spark, f"/root/testdata/{sf}").where(f"reason IS {null}").count() for sf in ("sf0.001", "sf0.01")] for null in ("NULL", "NOT NULL"))
    assert valid[1] > 5 * valid[0] > 0 and bad[1] > 5 * bad[0] > 0


def test_every_order_line_has_its_points(spark):
    got = plans.queries()["damage_points"](spark, SF).select("l_orderkey", "l_linenumber")
    assert got.exceptAll(V.table(spark, SF, "lineitem").select("l_orderkey", "l_linenumber")).count() == 0
    assert got.count() == V.table(spark, SF, "lineitem").count()
