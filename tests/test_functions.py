"""Column functions against plain values, boundaries included."""

from __future__ import annotations

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pricewright.config import COMMISSION_TIERS, RESERVE_TIERS, PricingConfig
from pricewright.functions import curves, inference, numbers, pricing, text
from pricewright.sources.files import settings as read_settings


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def array(values):
    return F.array(*(F.lit(v) for v in values)) if values else F.array().cast("array<long>")


@pytest.mark.parametrize(("x", "want"), [(2.5, 3), (-2.5, -2), (0.49, 0), (-0.5, 0), (7.0, 7)])
def test_half_up(spark, x, want):
    assert one(spark, numbers.half_up(F.lit(x))) == want


def test_defaults_and_digits(spark):
    assert one(spark, numbers.or_default(F.lit(0), F.lit(9))) == 9
    assert one(spark, numbers.or_default(F.lit(None).cast("int"), F.lit(9))) == 9
    assert one(spark, numbers.digits(F.lit("1.234.567 TL"))) == 1_234_567
    assert one(spark, numbers.digits(F.lit("TL"))) is None
    assert one(spark, numbers.digits(F.lit("9" * 30))) is None


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 180, 340])
def test_ranks_are_computed_in_doubles(spark, n):
    values = list(range(100, 100 + n))
    for share in (0.05, 0.35, 0.5, 0.6, 0.95):
        want = values[math.floor(n * share)] if n else None
        assert one(spark, numbers.at_rank(array(values), share)) == want


@settings(max_examples=15, deadline=None)
@given(values=st.lists(st.integers(50_000, 5_000_000), max_size=30))
def test_statistics_of_arrays(spark, values):
    values = sorted(values)
    kept, mean, p35 = spark.range(1).select(
        numbers.without_outliers(array(values)).alias("k"), numbers.trimmed_mean(array(values)).alias("m"), numbers.interpolated(array(values), 35).alias("p")
    ).first()
    assert set(kept) <= set(values) and kept == sorted(kept)
    n = len(values)
    if n:
        cut = max(1, math.floor(n * 0.1)) if n > 4 else 0
        inner = values[cut : n - cut]
        assert mean == math.floor(sum(inner) / len(inner) + 0.5)
        at = 0.35 * (n - 1)
        low, weight = math.floor(at), at - math.floor(at)
        want = values[low] if not weight else math.floor(values[low] * (1 - weight) + values[math.ceil(at)] * weight + 0.5)
        assert p35 == want
    else:
        assert mean is None and p35 == 0


def test_outliers_go(spark):
    prices = sorted([1, 111, 5000, 1_480_000, 1_490_000, 1_500_000, 1_510_000, 1_520_000, 999_999_999])
    assert one(spark, numbers.without_outliers(array(prices))) == [1_480_000, 1_490_000, 1_500_000, 1_510_000, 1_520_000]


@pytest.mark.parametrize("tiers", [RESERVE_TIERS, COMMISSION_TIERS])
def test_tiers_at_their_bounds(spark, tiers):
    for k, (bound, rate, least) in enumerate(tiers[:-1]):
        for x, row in ((bound - 1, tiers[k]), (bound, (bound, rate, least)), (bound + 1, tiers[k + 1])):
            assert one(spark, numbers.tier(F.lit(x), tiers, 1)) == row[1]
            assert one(spark, numbers.tier(F.lit(x), tiers, 2)) == row[2]


def test_roundings(spark):
    for x, want in ((999_999, 995_000), (1_000_000, 1_000_000), (1_000_001, 1_000_000), (1_019_999, 1_010_000)):
        assert one(spark, pricing.cash_rounded(F.lit(x))) == want
    assert one(spark, pricing.psychological(F.lit(1_234_567), F.lit(2_000_000))) == 1_233_000
    assert one(spark, pricing.psychological(F.lit(3_000_000), F.lit(1_000_000))) == 1_029_000
    assert one(spark, pricing.psychological(F.lit(100_500), F.lit(1_000_000))) == 100_500


def test_offer_chain(spark):
    """Listing price above the expected sale above the customer's net, and the reserve kept."""
    row = {"year": 2020, "mileage": 100_000, "damage": "NO", "desired": 0.0, "p35": 1_200_000, "p50": 1_250_000, "p60": 1_300_000, "n": 20, "level": 1, "base_confidence": 96, "median_mileage": 100_000, "decay": 0.0025}
    out = pricing.priced(spark.createDataFrame([row])).first()
    assert out["fmv"] == 1_250_000 and out["required"] == 85_000 and out["cash_offer"] == 1_160_000
    assert out["listing_price"] > out["expected_sale"] > out["customer_net"]
    assert out["customer_net"] == out["expected_sale"] - out["fee"] and not out["manual"]
    few = pricing.priced(spark.createDataFrame([row | {"n": 3}])).first()
    assert few["confidence"] == 86 and few["required"] > out["required"]


def test_market_value_falls_with_mileage(spark):
    base = {"year": 2020, "damage": "NO", "desired": 0.0, "p35": 900_000, "p50": 950_000, "p60": 990_000, "n": 20, "level": 1, "base_confidence": 96, "median_mileage": 80_000, "decay": 0.004}
    rows = spark.createDataFrame([base | {"mileage": m} for m in range(0, 500_000, 20_000)])
    values = [r["fmv"] for r in pricing.priced(rows).orderBy("mileage").collect()]
    assert values == sorted(values, reverse=True) and values[0] > values[-1]


def test_names(spark):
    clean = text.cleaned(F.lit("DS Automobiles & Modelleri sahibinden.com'da - 4"))
    assert one(spark, clean) == "DS Automobiles"
    assert one(spark, text.cleaned(F.lit(None).cast("string"))) == ""
    assert one(spark, text.folded(F.lit("İıÖöÜüŞşÇçĞğ"))) == "IiOoUuSsCcGg"
    assert one(spark, text.title_case(F.lit("istanbul ILICA"))) == "İstanbul Ilıca"
    assert one(spark, text.phone(F.lit("0532 123 45 67"))) == "905321234567"
    assert one(spark, text.damaged(F.lit("ekspertiz temiz"))) is True
    assert one(spark, text.damaged(F.lit("ekspertiz temiz"), strict=True)) is False
    assert one(spark, text.damaged(F.lit("AĞIR HASAR"), strict=True)) is True
    assert one(spark, text.city(F.lit(" / Kadıköy"))) == "İstanbul"


def test_inference_and_curves(spark):
    assert tuple(one(spark, inference.engine(F.lit("A4"), F.lit("40 TDI quattro")))) == (2000, 190, 342)
    assert one(spark, inference.body(F.lit("Q5 Sportback"))) == "SUV"
    assert one(spark, curves.by_year(F.lit("economy"), F.lit(2026))) == 1.0
    assert one(spark, curves.by_year(F.lit("economy"), F.lit(2005))) == 0.18
    assert one(spark, curves.by_year(F.lit("economy"), F.lit(1990))) == pytest.approx(0.162)
    assert one(spark, curves.fallback_price(F.lit("Ferrari"), F.lit("F8"), F.lit(0)))["average"] == 12_000_000


def test_settings():
    base = PricingConfig()
    assert read_settings(None, base) == base and read_settings("{broken", base) == base
    assert read_settings('{"ref_year": 2030, "unknown": 1, "min_price": null}', base).ref_year == 2030
