"""The domain's tables, as views over the test tables; and the same views in SQL.

Listings are order lines: the part is the vehicle, the ship year the model year,
the price in hundredths the price in whole units.  The bounds are narrower than
the engine's, so that the rules bite.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.config import PricingConfig
from pricewright.functions.numbers import half_up
from pricewright.operators.listings import first_of, total_order

CONFIG = PricingConfig(ref_year=2002, min_price=150_000, max_price=10_000_000)
BODIES, FUELS, GEARS = ("Sedan", "Hatchback", "SUV"), ("Benzin", "Dizel"), ("Manuel", "Otomatik", "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(digest: Column, place: int, values: tuple[str, ...]) -> Column:
    """One of some values by a hexadecimal digit of a digest."""
    digit = F.conv(F.substring(digest, place, 1), 16, 10).cast("int")
    return F.get(F.array(*map(F.lit, values)), digit % len(values))


def raw_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order line as a listing; ids repeat."""
    t = lambda name: table(spark, sf_dir, name)
    rows = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("listing_id"), F.col("p_brand").alias("make"), F.col("p_type").alias("model"), F.col("p_name").alias("variant"),
        F.year("l_shipdate").alias("year"), half_up(F.col("l_extendedprice") * 100).alias("price"), F.when(F.col("l_tax") != 0, (F.col("l_quantity") * 1000).cast("long")).alias("mileage"),
        (F.col("l_returnflag") == "R").alias("is_damaged"), F.col("n_name").alias("city"),
    )


def unique_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_listings(spark, sf_dir)
    return first_of(rows, ["listing_id"], total_order(rows, "price", "mileage"))


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deduplicated listings within the price bounds."""
    return unique_listings(spark, sf_dir).where(F.col("price").between(CONFIG.min_price, CONFIG.max_price))


def spec_data(make: str, model: str, variant: str) -> dict[str, Column]:
    digest = F.md5(F.concat_ws("|", make, model, variant).cast("binary"))
    return {"body": pick(digest, 1, BODIES), "fuel": pick(digest, 2, FUELS), "transmission": pick(digest, 3, GEARS)}


def specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicles of the catalogue in each of seven years, with technical data and prices."""
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("make"), F.col("p_type").alias("model"), F.col("p_name").alias("variant")).agg(F.min("p_retailprice").alias("_price"), F.min("p_size").alias("size"))
    rows = rows.withColumns(spec_data("make", "model", "variant")).withColumn("msrp", half_up(F.col("_price") * 1000).cast("double"))
    package = F.when(F.col("size") % 3 == 0, "Comfort").when(F.col("size") % 3 == 1, "M Sport")
    return rows.withColumns({"package": package, "year": F.explode(F.sequence(F.lit(1995), F.lit(2001)))}).drop("_price")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One valuation request per segment with an open seventh line, and some for unknown vehicles."""
    rows = table(spark, sf_dir, "lineitem").where("l_linestatus = 'O' AND l_linenumber = 7").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select(
        F.col("p_brand").alias("make"), F.col("p_type").alias("model"), F.col("p_name").alias("variant"), F.year("l_shipdate").alias("year"), (F.col("l_quantity") * 1000).cast("long").alias("mileage"),
        F.when(F.col("l_returnflag") == "R", "YES").when(F.col("l_returnflag") == "A", "NO").otherwise("UNKNOWN").alias("damage"),
        F.when(F.col("l_discount") >= 0.08, half_up(F.col("l_extendedprice") * 100).cast("double")).otherwise(0.0).alias("desired"),
    )
    keys, order = ["make", "model", "variant", "year"], [F.col("mileage"), F.col("damage"), F.col("desired")]
    rows = first_of(rows, keys, order)
    rows = rows.unionByName(first_of(rows.where("year = 1998").withColumn("make", F.lit("Unknown")), keys, order))
    rows = rows.withColumns(spec_data("make", "model", "variant")).withColumns({"trim": F.lit(""), "request_id": F.concat_ws("|", "make", "model", "variant", "year")})
    # Every fifth mileage's request comes without a variant.
    return rows.withColumn("variant", F.when(F.col("mileage") % 5000 == 0, "Standart").otherwise(F.col("variant")))


#: The same views for DuckDB; text for a WITH clause.
LISTINGS = """
raw_listings AS (
  SELECT concat(l_orderkey, '-', l_linenumber) AS listing_id, p_brand AS make, p_type AS model, p_name AS variant, year(l_shipdate)::INT AS year,
    floor(l_extendedprice * 100 + 0.5::DOUBLE)::BIGINT AS price, CASE WHEN l_tax <> 0 THEN (l_quantity * 1000)::BIGINT END AS mileage,
    l_returnflag = 'R' AS is_damaged, n_name AS city
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
), unique_listings AS (
  SELECT * FROM raw_listings
  QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY price, mileage NULLS LAST, listing_id, make, model, variant, year, is_damaged, city) = 1
), listings AS (SELECT * FROM unique_listings WHERE price BETWEEN 150000 AND 10000000)"""
DATA = """
  ['Sedan', 'Hatchback', 'SUV'][1 + ('0x' || md5(name)[1])::INT % 3] AS body, ['Benzin', 'Dizel'][1 + ('0x' || md5(name)[2])::INT % 2] AS fuel,
  ['Manuel', 'Otomatik', ''][1 + ('0x' || md5(name)[3])::INT % 3] AS transmission"""
SPECS = f"""
specs AS (
  SELECT make, model, variant, size, {DATA}, floor(price * 1000 + 0.5::DOUBLE)::DOUBLE AS msrp,
    CASE size % 3 WHEN 0 THEN 'Comfort' WHEN 1 THEN 'M Sport' END AS package, unnest(range(1995, 2002))::INT AS year
  FROM (SELECT p_brand AS make, p_type AS model, p_name AS variant, concat_ws('|', p_brand, p_type, p_name) AS name, min(p_retailprice) AS price, min(p_size) AS size FROM part GROUP BY ALL)
)"""
REQUESTS = f"""
asked AS (
  SELECT p_brand AS make, p_type AS model, p_name AS variant, year(l_shipdate)::INT AS year, (l_quantity * 1000)::BIGINT AS mileage,
    CASE l_returnflag WHEN 'R' THEN 'YES' WHEN 'A' THEN 'NO' ELSE 'UNKNOWN' END AS damage, CASE WHEN l_discount >= 0.08::DOUBLE THEN floor(l_extendedprice * 100 + 0.5::DOUBLE) ELSE 0 END::DOUBLE AS desired
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'O' AND l_linenumber = 7
  QUALIFY row_number() OVER (PARTITION BY make, model, p_name, year ORDER BY mileage, damage, desired) = 1
), named AS (
  SELECT *, concat_ws('|', make, model, variant) AS name FROM (FROM asked UNION ALL SELECT 'Unknown' AS make, * EXCLUDE (make) FROM asked WHERE year = 1998
    QUALIFY row_number() OVER (PARTITION BY model, variant ORDER BY mileage, damage, desired) = 1)
), requests AS (
  SELECT make, model, CASE WHEN mileage % 5000 = 0 THEN 'Standart' ELSE variant END AS variant, year, mileage, damage, desired, {DATA}, '' AS trim, concat_ws('|', make, model, variant, year) AS request_id FROM named
)"""
SNAPSHOTS = """
grouped AS (
  SELECT make, model, variant, year, count(*) AS n, list(price ORDER BY price) AS prices, coalesce(list(mileage ORDER BY mileage) FILTER (mileage > 0), []) AS mileages,
    count(mileage) FILTER (mileage > 0)::DOUBLE AS m, sum(mileage) FILTER (mileage > 0)::DOUBLE AS sx, sum(price) FILTER (mileage > 0)::DOUBLE AS sy,
    sum(mileage * mileage) FILTER (mileage > 0)::DOUBLE AS sxx, sum(mileage * price) FILTER (mileage > 0)::DOUBLE AS sxy
  FROM listings WHERE NOT is_damaged GROUP BY ALL
), quartiles AS (
  SELECT *, len(prices) AS k, prices[1 + floor(n * 0.25::DOUBLE)::INT] AS q1, prices[1 + floor(n * 0.75::DOUBLE)::INT] AS q3,
    (m * sxy - sx * sy) / nullif(m * sxx - sx * sx, 0) * 10000::DOUBLE AS slope
  FROM grouped
), trimmed AS (
  SELECT *, CASE WHEN k < 4 THEN prices ELSE list_filter(prices, lambda x: x >= greatest(50000, q1 - 1.5 * (q3 - q1)) AND x <= q3 + 1.5 * (q3 - q1)) END AS kept FROM quartiles
), ranked AS (
  SELECT *, len(kept) AS n_kept, len(mileages) AS n_mileages, kept[1 + floor(len(kept) * 0.05::DOUBLE)::INT] AS p5, kept[1 + floor(len(kept) * 0.35::DOUBLE)::INT] AS p35,
    kept[1 + floor(len(kept) * 0.5::DOUBLE)::INT] AS p50, kept[1 + floor(len(kept) * 0.6::DOUBLE)::INT] AS p60, kept[1 + floor(len(kept) * 0.95::DOUBLE)::INT] AS p95
  FROM trimmed WHERE len(kept) > 0
), snapshots AS (
  SELECT r.make, r.model, r.variant, r.year, n, p5, p35, p50, p60, p95, kept[1] AS min_price, kept[-1] AS max_price,
    coalesce(mileages[1 + floor(n_mileages * 0.5::DOUBLE)::INT], 100000)::BIGINT AS median_mileage,
    coalesce(floor(sx / nullif(n_mileages, 0) + 0.5::DOUBLE), 100000)::BIGINT AS mean_mileage, n_mileages::INT AS n_mileages, slope,
    CASE WHEN n_mileages >= 8 AND slope < 0 AND p50 > 0 THEN greatest(0.001::DOUBLE, least(0.015::DOUBLE, abs(slope) / p50)) ELSE 0.0025::DOUBLE END AS decay,
    CASE WHEN n_mileages >= 8 AND slope < 0 AND p50 > 0 THEN 'LEARNED_FROM_LISTINGS' WHEN n_mileages >= 4 AND n_mileages < 8 THEN 'LIMITED_SAMPLE' ELSE 'DEFAULT_FALLBACK' END AS decay_source,
    CASE WHEN n >= 12 THEN 98 WHEN n >= 6 THEN 88 ELSE 72 END AS base_confidence,
    floor(greatest(0, least(100, 50 + least(20::DOUBLE, n * 1.5::DOUBLE) + 15::DOUBLE * n_mileages / n + CASE WHEN trim(r.variant) <> '' THEN 4 ELSE 0 END
      + CASE WHEN coalesce(body, '') <> '' THEN 4 ELSE 0 END + CASE WHEN coalesce(fuel, '') <> '' THEN 4 ELSE 0 END + CASE WHEN coalesce(transmission, '') <> '' THEN 3 ELSE 0 END
      + CASE WHEN n_kept >= 3 THEN greatest(0::DOUBLE, 15 - 30 * (sqrt(greatest(0::DOUBLE, (n_kept::DOUBLE * list_sum(list_transform(kept, lambda x: x * x))::DOUBLE - list_sum(kept)::DOUBLE * list_sum(kept)::DOUBLE)
          / (n_kept::DOUBLE * n_kept::DOUBLE))) / (list_sum(kept)::DOUBLE / n_kept::DOUBLE))) ELSE 5 END)) * 10 + 0.5::DOUBLE) / 10::DOUBLE AS quality,
    n_kept::INT AS n_kept, coalesce(body, '') AS body, coalesce(fuel, '') AS fuel, coalesce(transmission, '') AS transmission, '' AS trim, sha256(concat_ws('|', r.make, r.model, r.variant, r.year)) AS snapshot_id
  FROM ranked r LEFT JOIN specs s ON s.make = r.make AND s.model = r.model AND s.variant = r.variant AND s.year = r.year
)"""
