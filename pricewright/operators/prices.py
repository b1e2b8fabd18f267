"""Maintenance of catalogue prices: recalibration, inflation, fallbacks, fan-out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewright.config import DEFAULT, PricingConfig
from pricewright.functions.curves import by_year, fallback_price, market_prices
from pricewright.functions.numbers import half_up
from pricewright.operators.listings import first_of
from pricewright.operators.snapshots import at, ranked


def recalibrated(specs: DataFrame, config: PricingConfig = DEFAULT) -> DataFrame:
    """New list price and market prices of specs with tier and base price; ``changed`` where they differ from msrp."""
    msrp = half_up(F.col("base_price") * by_year(F.col("tier"), F.col("year"), config.ref_year))
    rows = specs.withColumn("new_msrp", msrp)
    days = F.when(F.col("tier") == "economy", 12).otherwise(20)
    return rows.select("*", market_prices(F.col("new_msrp")).alias("m"), days.alias("selling_days"), (~F.col("new_msrp").eqNullSafe(F.col("msrp"))).alias("changed")).select("*", "m.*").drop("m")


def inflated(specs: DataFrame, percent: float, makes: Sequence[str] | None = None) -> DataFrame:
    """List prices above 0 raised by ``percent``, of the given makes or of all."""
    chosen = (F.col("msrp") > 0) & (F.col("make").isin(*makes) if makes else F.lit(True))
    return specs.withColumn("msrp", F.when(chosen, half_up(F.col("msrp") * (1 + percent / 100.0)).cast("double")).otherwise(F.col("msrp")))


def with_fallback(specs: DataFrame, averages: DataFrame, keys: Sequence[str], config: PricingConfig = DEFAULT) -> DataFrame:
    """Averages of the listings, or the segment's fallback where there are none."""
    rows = specs.join(averages, list(keys), "left")
    back = fallback_price(F.col("make"), F.col("model"), F.greatest(F.lit(0), F.lit(config.ref_year) - F.col("year")))
    known = F.col("average").isNotNull()
    return rows.withColumns({
        "source": F.when(known, "Scraped").otherwise("Fallback Model"),
        "clean_average": F.when(known, F.col("clean_average")).otherwise(back["clean"]),
        "average": F.when(known, F.col("average")).otherwise(back["average"]),
    })


def fanned_out(listings: DataFrame, keys: Sequence[str], years: Sequence[int]) -> DataFrame:
    """The prices of a file, taken flat for each of some fixed years."""
    shares = {"min_price": 0.05, "cash_price": 0.35, "average": 0.5, "listing_price": 0.6, "max_price": 0.95}
    points = [at(F.floor(F.col("total") * F.lit(share))).alias(name) for name, share in shares.items()]
    rows = ranked(listings, keys, F.col("price")).groupBy(*keys).agg(F.first("total").cast("int").alias("n"), *points)
    return rows.select(*keys, F.explode(F.array(*map(F.lit, years))).alias("year"), "n", *shares)


def catalogue(variants: DataFrame, packages: DataFrame, years: Sequence[int], keys: Sequence[str]) -> DataFrame:
    """Every variant with each of its packages and each year; a variant without packages once with null."""
    rows = variants.join(packages, list(keys), "left")
    return rows.withColumn("year", F.explode(F.array(*map(F.lit, years))))


def without_specs(models: DataFrame, specs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Models that no spec has."""
    return models.join(specs.select(*keys).distinct(), list(keys), "left_anti")


def deduplicated(rows: DataFrame, keys: Sequence[str], newest: Column, tie: Sequence[Column]) -> DataFrame:
    """One row per key: the newest, ties by the given order."""
    return first_of(rows, keys, [newest.desc_nulls_last(), *tie])
