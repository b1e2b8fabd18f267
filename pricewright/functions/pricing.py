"""From percentiles to offers: the deterministic pricing chain, as column expressions.

``priced`` adds the whole chain to rows that carry p35, p50, p60, the number of
comparables and the mileage reference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewright.config import COMMISSION_TIERS, DAMAGE_PENALTY, DEFAULT, RESERVE_TIERS, UNKNOWN_PENALTY, PricingConfig
from pricewright.functions.numbers import clamp, half_up, or_default, tier


def cash_rounded(x: Column) -> Column:
    """Down to 5,000 up to a million, else to 10,000."""
    return F.when(x <= 1_000_000, F.floor(x / 5_000) * 5_000).otherwise(F.floor(x / 10_000) * 10_000)


def gallery_rounded(x: Column) -> Column:
    """To the nearest 50,000 from 5 million, 10,000 from 1 million, else 5,000."""
    step = F.when(x >= 5_000_000, 50_000).when(x >= 1_000_000, 10_000).otherwise(5_000)
    return half_up(x / step) * step


def psychological(x: Column, market: Column) -> Column:
    """Just below a round thousand, at most 3 % above the market."""
    capped = F.least(x, half_up(market * 1.03))
    below = F.floor(capped / 1_000) * 1_000 - 1_000
    return F.when(below > 100_000, below).otherwise(capped)


def damage_penalty(status: Column) -> Column:
    out = F.lit(UNKNOWN_PENALTY)
    for name, penalty in DAMAGE_PENALTY.items():
        out = F.when(status == name, penalty).otherwise(out)
    return out


def reserve(market: Column, n: Column) -> Column:
    """What has to stay between market value and cash offer."""
    rate = tier(market, RESERVE_TIERS, 1)
    rate = F.when(market > 5_000_000, rate + 0.01).when(market < 1_000_000, rate - 0.005).otherwise(rate)
    rate = F.when(n < 8, rate + 0.025).otherwise(rate)
    return F.greatest(tier(market, RESERVE_TIERS, 2), half_up(market * rate))


def commission(price: Column) -> Column:
    return F.greatest(tier(price, COMMISSION_TIERS, 2), half_up(price * tier(price, COMMISSION_TIERS, 1)))


def net_profit(market: Column, cash: Column, listing: Column) -> Column:
    """Estimate after listing discount, preparation, transfer and financing."""
    return F.greatest(F.lit(0), (market - cash) - (half_up(listing * 0.015) + 15_000 + 5_000 + half_up(cash * 0.01)))


def priced(rows: DataFrame, config: PricingConfig = DEFAULT) -> DataFrame:
    """Adds the offer columns to rows with year, mileage, damage, desired, p35, p50, p60, n, level, base_confidence, median_mileage, decay."""
    c = F.col
    age = F.greatest(F.lit(1), F.lit(config.ref_year) - c("year"))
    rows = rows.withColumn("ref_mileage", F.when(c("median_mileage") > 0, c("median_mileage")).otherwise(age * config.yearly_mileage).cast("double"))
    rows = rows.withColumn("mileage_ratio", clamp((c("mileage") - c("ref_mileage")) / 10_000.0 * c("decay"), -0.10, 0.12))
    rows = rows.withColumn("penalty", damage_penalty(c("damage")))

    def adjusted(p: str) -> Column:
        return c(p) - half_up(c("p50") * c("mileage_ratio")) - half_up(c("p50") * c("penalty"))

    rows = rows.withColumns({"fmv": F.greatest(F.lit(100_000), half_up(adjusted("p50"))), "adjusted_p35": half_up(adjusted("p35")), "adjusted_p60": half_up(adjusted("p60"))})
    rows = rows.withColumn("required", reserve(c("fmv"), c("n")))
    before = c("fmv") - c("required")
    raw = F.when(c("fmv") - c("adjusted_p35") < c("required"), before).otherwise(F.least(before, c("adjusted_p35")))
    rows = rows.withColumn("cash_offer", cash_rounded(raw))
    rows = rows.withColumns({"cash_min": cash_rounded(c("cash_offer") * 0.96), "cash_max": cash_rounded(c("cash_offer") * 1.02)})
    manual = (c("fmv") < 400_000) & (c("cash_offer") / c("fmv") < 0.85)
    desired = or_default(c("desired"), F.lit(None).cast("double"))
    listing = F.when(desired > 0, psychological(desired, c("fmv") * 1.05)).otherwise(psychological(c("adjusted_p60"), c("fmv")))
    rows = rows.withColumns({"manual": manual, "listing_price": listing})
    rows = rows.withColumn("expected_sale", F.greatest(c("cash_offer") + 30_000, c("listing_price") - half_up(c("listing_price") * 0.015)))
    rows = rows.withColumn("fee", commission(c("expected_sale")))
    rows = rows.withColumn("customer_net", half_up(c("expected_sale") - c("fee")))
    days = lambda slow, quick, other: F.when(c("fmv") > 5_000_000, slow).when(c("fmv") < 1_000_000, quick).otherwise(other)
    rows = rows.withColumns({"days_min": days(20, 7, 14), "days_max": days(42, 18, 28)})
    confidence = c("base_confidence") - F.when(c("n") < 8, 10).otherwise(0) - F.when(c("level") == 4, 20).otherwise(0)
    return rows.withColumns({"confidence": clamp(confidence, 0, 99), "gross_reserve": c("fmv") - c("cash_offer"), "net_profit": net_profit(c("fmv"), c("cash_offer"), c("listing_price"))})
