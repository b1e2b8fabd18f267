"""Listings: sanity bounds, damage, quarantine, and first-wins deduplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricewright.config import DEFAULT, PricingConfig
from pricewright.functions.numbers import digits
from pricewright.functions.text import damaged
from pricewright.operators.normalize import canonical

# Reasons of quarantine.
BAD_PRICE, BAD_YEAR = "GEÇERSİZ_FİYAT", "GEÇERSİZ_YIL"


def sane_price(price: Column, config: PricingConfig = DEFAULT) -> Column:
    return F.coalesce((price >= config.min_price) & (price <= config.max_price), F.lit(False))


def sane_year(year: Column, config: PricingConfig = DEFAULT) -> Column:
    return F.coalesce((year >= config.min_year) & (year <= config.ref_year), F.lit(False))


def sane_mileage(mileage: Column, year: Column, price: Column, config: PricingConfig = DEFAULT) -> Column:
    """The mileage, or null where it is out of bounds or repeats the year or the price."""
    fits = (mileage >= 0) & (mileage <= config.max_mileage)
    return F.when(fits & ~mileage.eqNullSafe(year) & ~mileage.eqNullSafe(price), mileage)


def first_of(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in the given order, which must be total to be repeatable."""
    rank = "_rank"
    while rank in map(str.lower, rows.columns):  # a name that the rows lack
        rank = f"_{rank}"
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn(rank, number).where(F.col(rank) == 1).drop(rank)


def total_order(rows: DataFrame, *first: str) -> list[Column]:
    """Ascending order over the named columns and then all others, nulls last."""
    rest = [c for c in rows.columns if c not in first]
    return [F.col(c).asc_nulls_last() for c in (*first, *rest)]


def judged(raw: DataFrame, config: PricingConfig = DEFAULT, damage: Column | None = None, keep: Sequence[str] = (), name: Column | None = None) -> DataFrame:
    """Raw listings of texts with parsed numbers, canonical names, damage and a reason of quarantine.

    ``raw`` has source, listing_id, make, model, variant, title, year, mileage and price, all texts.
    Damage is looked for in the title, or in ``damage``.  Columns to ``keep`` come last, as they are;
    ``name`` is for ``canonical``.
    """
    c = F.col
    rows = raw.select(
        "source", "listing_id", "title", digits(c("year")).cast("int").alias("year"), digits(c("mileage")).alias("mileage"), digits(c("price")).alias("price"),
        canonical(c("make"), c("model"), c("variant"), c("title"), name).alias("name"), c("make").alias("raw_make"), c("model").alias("raw_model"), damaged(c("title") if damage is None else damage).alias("is_damaged"), *keep,
    )
    reason = F.when(~sane_price(c("price"), config), BAD_PRICE).when(~sane_year(c("year"), config), BAD_YEAR).otherwise(c("name.reason"))
    return rows.select(
        "source", "listing_id", "name.make", "name.model", "name.variant", "title", "year",
        sane_mileage(c("mileage"), c("year"), c("price"), config).alias("mileage"), "price", "is_damaged", reason.alias("reason"), "raw_make", "raw_model", *keep,
    )


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined): one row per listing, and a quarantined listing is not valid, too.

    Whether any row of a listing is refused is told by a window over the key by
    which valid rows are dealt anyway, so rows are judged once for each half.
    """
    refused = "_refused"
    while refused in map(str.lower, rows.columns):
        refused = f"_{refused}"
    marked = rows.withColumn(refused, F.max(F.col("reason").isNotNull()).over(Window.partitionBy("source", "listing_id")))
    kept = marked.where(~F.col(refused)).drop("reason", "raw_make", "raw_model", refused)
    valid = first_of(kept, ["source", "listing_id"], total_order(kept, "price", "mileage"))
    bad = rows.where("reason IS NOT NULL").select("source", "listing_id", "reason", "raw_make", "raw_model", "year", "price")
    return valid, first_of(bad, ["source", "listing_id", "reason"], total_order(bad, "price"))
