"""Import of catalogue rows: header aliases, defaults, dimension keys, specs and prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewright.functions.numbers import or_default
from pricewright.operators.listings import first_of

# Column -> (header aliases, default of a text, or of a number).
TEXTS = {
    "make": (("brand", "Brand", "Manufacturer"), ""), "model": (("model", "Model"), ""), "variant": (("variant", "Variant"), ""), "package": (("package", "Package"), ""),
    "body": (("bodyType", "BodyType"), "Sedan"), "fuel": (("fuelType", "FuelType"), "Benzin"), "transmission": (("transmissionType", "TransmissionType"), "Manuel"),
    "drive": (("driveType", "DriveType"), "Önden Çekiş"),
}
NUMBERS = {
    "year": (("year", "Year"), None), "engine_cc": (("engineSize", "EngineSize"), 1600), "horsepower": (("horsepower", "Horsepower"), 110), "torque": (("torque", "Torque"), 200),
    "doors": (("doors", "Doors"), 4), "seats": (("seats", "Seats"), 5), "consumption": (("fuelConsumption", "FuelConsumption"), 5.5), "emission": (("emission", "Emission"), 120),
    "market_average": (("currentMarketAverage", "CurrentMarketAverage", "price"), 500_000), "listing_average": (("averageListingPrice", "AverageListingPrice"), 1.03),
    "min_price": (("minPrice", "MinPrice"), 0.92), "max_price": (("maxPrice", "MaxPrice"), 1.08), "selling_days": (("averageSellingTime", "AverageSellingTime"), 20),
}
#: Prices whose default is a multiple of the market average.
SHARES = ("listing_average", "min_price", "max_price")


def _exact_columns(rows: DataFrame) -> dict[str, Column]:
    """Columns by exact header; headers that differ in case only are told apart by place."""
    slots = rows.toDF(*(f"_{k}" for k in range(len(rows.columns))))
    return {name: slots[f"_{k}"] for k, name in enumerate(rows.columns)} | {"": slots}


def imported(rows: DataFrame) -> DataFrame:
    """Rows under their canonical headers; rows without make, model, variant or year are left out.

    ``line`` numbers the rows for the later choice of the last one; rows must carry it.
    """
    columns = _exact_columns(rows)
    slots = columns.pop("")

    def text(names: tuple[str, ...], default: str) -> Column:
        given = [F.nullif(F.trim(columns[n].cast("string")), F.lit("")) for n in names if n in columns]
        return F.coalesce(*given, F.lit(default))

    def number(names: tuple[str, ...]) -> Column:
        given = [F.nullif(columns[n].cast("string").try_cast("double"), F.lit(0.0)) for n in names if n in columns]
        return F.coalesce(*given, F.lit(None).cast("double"))

    found = {c: text(*v) for c, v in TEXTS.items()} | {c: number(names) for c, (names, _) in NUMBERS.items()}
    out = slots.select(columns["line"].alias("line"), *(x.alias(c) for c, x in found.items()))
    out = out.withColumns({c: or_default(F.col(c), F.lit(float(v))) for c, (_, v) in NUMBERS.items() if v is not None and c not in SHARES})
    out = out.withColumns({c: or_default(F.col(c), F.col("market_average") * NUMBERS[c][1]) for c in SHARES})
    return out.where("make <> '' AND model <> '' AND variant <> '' AND year <> 0").withColumn("year", F.col("year").cast("int"))


SPEC = ("year", "make", "model", "variant", "package", "body", "fuel", "transmission")


def latest_specs(rows: DataFrame) -> DataFrame:
    """One row per spec: of lines for the same spec the last stands."""
    return first_of(rows, SPEC, [F.col("line").desc()])


def dimension(rows: DataFrame, *names: str) -> DataFrame:
    """Distinct non-empty values with a key made from them, the same in every run."""
    values = rows.select(*names).where(F.col(names[-1]) != "").distinct()
    return values.withColumn(f"{names[-1]}_id", F.sha2(F.concat_ws("\u0001", *names), 256))
