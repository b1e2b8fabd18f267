"""Depreciation curves, price fallbacks and display prices, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricewright.functions.numbers import half_up
from pricewright.functions.rules import first_match

# What is left of a price from 2026 back to 2005, by market tier.
YEAR_CURVES = {
    "exotic": (1.00, 0.96, 0.91, 0.86, 0.81, 0.76, 0.71, 0.67, 0.63, 0.59, 0.55, 0.52, 0.49, 0.46, 0.43, 0.41, 0.39, 0.37, 0.35, 0.33, 0.32, 0.31),
    "luxury": (1.00, 0.93, 0.87, 0.81, 0.75, 0.69, 0.64, 0.59, 0.54, 0.50, 0.46, 0.43, 0.40, 0.37, 0.35, 0.33, 0.31, 0.29, 0.27, 0.25, 0.24, 0.23),
    "standard": (1.00, 0.91, 0.83, 0.76, 0.69, 0.63, 0.58, 0.53, 0.49, 0.45, 0.42, 0.39, 0.36, 0.34, 0.32, 0.30, 0.28, 0.26, 0.24, 0.22, 0.21, 0.20),
    "economy": (1.00, 0.88, 0.78, 0.70, 0.63, 0.57, 0.52, 0.47, 0.43, 0.40, 0.37, 0.34, 0.32, 0.30, 0.28, 0.26, 0.24, 0.22, 0.21, 0.20, 0.19, 0.18),
}
# Fixed values: (makes, price when new, floor) of the fallback prices.
SEGMENTS = (
    (("porsche", "maserati", "ferrari", "bentley", "mclaren"), 12_000_000, 2_500_000),
    (("mercedes", "bmw", "audi", "volvo", "tesla"), 4_000_000, 850_000),
    (("fiat", "dacia", "tata", "tofaş"), 800_000, 180_000),
)
DEFAULT_SEGMENT = (1_400_000, 300_000)
ECONOMY_MODEL = "clio"
# Surcharges by package name.
PACKAGES = (
    (("R-Line", "Passion", "M Sport", "Competition"), 1.25),
    (("Lounge", "Flame", "Executive", "Icon", "Elegant", "LTZ", "GT Line", "AMG Line", "Sport Line", "Luxury Line", "Elite", "Prime", "GT", "Ultimate"), 1.18),
    (("Urban", "Life", "Dream", "Touch", "Comfort", "LT", "Style", "Allure", "Elegance"), 1.08),
)
# Surcharges by what a variant's or package's name contains.
VARIANT_FACTORS = (
    (("performance", "plaid", "amg", "m5", "rs", "trofeo", "svr", "quadrifoglio"), 1.25), (("competition",), 1.12),
    (("sport", "gti", "st ", "type r", "opc", "nismo", "cupra", "r-line", "fr", "long range"), 1.10), (("cabrio", "convertible", "roadster", "volante", "spider", "spyder"), 1.15),
)
PACKAGE_FACTORS = (
    (("AMG", "M Sport", "RS", "R-Line", "S Line", "Titanium X", "Exclusive", "Icon", "GT", "Flame X-Pack", "Lounge", "Ultimate"), 1.10),
    (("Avantgarde", "Luxury", "Elegance", "Style", "Titanium", "Allure", "Touch", "Comfortline", "Prestige"), 1.05),
)


def to_floor(base: Column, floor: Column, age: Column, rate: float = 0.88) -> Column:
    """Exponential fall to a floor."""
    return half_up(floor + (base - floor) * F.pow(F.lit(rate), age))


def geometric(base: Column, age: Column, rate: float = 0.92) -> Column:
    return half_up(base * F.pow(F.lit(rate), age))


def concave(age: Column) -> Column:
    return F.greatest(F.lit(0.48), 1 - age * 0.025 - F.pow(age.cast("double"), F.lit(1.2)) * 0.002)


def package_surcharge(package: Column) -> Column:
    out = F.lit(1.0)
    for names, factor in reversed(PACKAGES):
        out = F.when(package.isin(*names), factor).otherwise(out)
    return out


def linear(base: Column, age: Column, yearly: float = 0.06, least: float = 0.30) -> Column:
    return half_up(base * F.greatest(F.lit(least), 1 - age * yearly))


def by_year(tier: Column, year: Column, last_year: int = 2026) -> Column:
    """What the tier's curve leaves in a model year; beyond its end nine tenths of the last value."""
    out = F.lit(None).cast("double")
    for name, values in YEAR_CURVES.items():
        curve = F.array(*(F.lit(v) for v in values))
        past = F.when(year >= last_year, F.lit(1.0)).when(year <= last_year - len(values), F.lit(values[-1] * 0.9))
        out = F.when(tier == name, past.otherwise(F.get(curve, (F.lit(last_year) - year).cast("int")))).otherwise(out)
    return out


def catalogue_price(base: Column, floor: Column, rate: Column, age: Column, variant: Column, package: Column) -> Column:
    """Category depreciation with the variant's and the package's surcharge."""
    factor = first_match([F.lower(variant)], VARIANT_FACTORS, F.lit(1.0))
    extra = first_match([package], PACKAGE_FACTORS, F.lit(1.0))
    return half_up((floor + (base - floor) * F.pow(rate, age)) * factor * extra)


def fallback_price(make: Column, model: Column, age: Column) -> Column:
    """(average, clean) price of a segment where no listing is known."""
    low = F.lower(make)
    rules = [(makes, k) for k, (makes, _, _) in enumerate(SEGMENTS)]
    segment = first_match([low], rules, F.when(F.lower(model).contains(ECONOMY_MODEL), 2))
    base, floor = F.lit(DEFAULT_SEGMENT[0]), F.lit(DEFAULT_SEGMENT[1])
    for k, (_, new, least) in enumerate(SEGMENTS):
        base, floor = F.when(segment == k, new).otherwise(base), F.when(segment == k, least).otherwise(floor)
    average = to_floor(base, floor, age)
    return F.struct(average.alias("average"), half_up(average * 1.05).alias("clean"))


def market_prices(msrp: Column) -> Column:
    """Market average and the prices derived from it, from a list price."""
    average = half_up(msrp / 1.2)
    return F.struct(
        average.alias("market_average"), half_up(average * 1.05).alias("clean_average"), half_up(average * 1.03).alias("listing_average"),
        half_up(average * 0.92).alias("min_price"), half_up(average * 1.08).alias("max_price"),
    )


def simulated(base: Column, age_loss: Column, mileage_loss: Column, gamma: float = 1.0, epsilon: float = 0.0) -> Column:
    """(value, buying price, listing price) of the price simulator."""
    value = half_up(base * ((1 - age_loss - mileage_loss) * gamma + epsilon))
    return F.struct(value.alias("value"), half_up(value * 0.91).alias("buying"), half_up(value * 1.08).alias("listing"))


def display_prices(cash: Column) -> Column:
    """Prices shown beside a cash offer."""
    market = half_up(cash / 0.88)
    return F.struct(market.alias("market"), half_up(market * 0.94).alias("low"), half_up(market * 0.96).alias("net"))
