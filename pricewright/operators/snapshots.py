"""Market snapshots: one row of price and mileage statistics per segment.

Listings are counted by segment, price and mileage before they are shuffled.  Two
passes over the counted rows of a segment follow: running counts give the quartiles,
those the fences, and a percentile is the price whose running count passes its rank
plus the number of prices below the fences.  No list of a segment is made, so a
popular one costs time and disk but no memory; means, slope and spread come from
exact sums.  Equal counts come from ``counted`` rows that are kept and updated
(``increments``), so statistics can also be made from these.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricewright.config import DEFAULT, PricingConfig
from pricewright.functions.numbers import clamp, half_up
from pricewright.functions.text import blank
from pricewright.operators.listings import first_of, total_order

SEGMENT = ("make", "model", "variant", "year")
#: Prices that statistics are taken from; fewer than so many are not searched for outliers.
PRICES, FEW = (50_000, 150_000_000), 4
#: Percentiles by name: the value at rank floor(n * share), from 0.
SHARES = {"p5": 0.05, "p35": 0.35, "p50": 0.5, "p60": 0.6, "p95": 0.95}


def counted(listings: DataFrame, keys: Sequence[str] = SEGMENT) -> DataFrame:
    """(keys, price, mileage, times): undamaged listings by price and mileage, null where it is not above 0."""
    mileage = F.when(F.col("mileage") > 0, F.col("mileage"))
    return listings.where("NOT is_damaged").groupBy(*keys, F.col("price").cast("long").alias("price"), mileage.cast("long").alias("mileage")).agg(F.count("*").alias("times"))


def statistics(counts: DataFrame, keys: Sequence[str] = SEGMENT) -> DataFrame:
    """n, n_kept, p5..p95, min_price, max_price, n_mileages, median_mileage, mean_mileage, slope, spread of each segment that keeps a price.

    Kept are prices within bounds and within 1.5 quartile ranges of the quartiles;
    ``slope`` is that of all prices by mileage in units of 10,000, ``spread`` the
    standard deviation of kept prices over their mean.
    """
    c, whole = F.col, Window.partitionBy(*keys)
    up_to = lambda name: whole.orderBy(c(name).asc_nulls_first()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    at = lambda running, rank, value: F.min(F.when(c(running) > rank, c(value)))
    rows = counts.withColumn("_valid", F.coalesce(c("price").between(*PRICES), F.lit(False)))
    rows = rows.withColumns({"_v": F.when(c("_valid"), c("times")).otherwise(0), "_m": F.when(c("mileage").isNotNull(), c("times")).otherwise(0)})
    rows = rows.withColumn("_m_run", F.sum("_m").over(up_to("mileage"))).withColumn("_run", F.sum("_v").over(up_to("price")))
    rows = rows.withColumns({"_n": F.sum("_v").over(whole), "_n_m": F.sum("_m").over(whole)})
    rows = rows.withColumns({q: at("_run", F.floor(c("_n") * F.lit(share)), "price").over(whole) for q, share in (("_q1", 0.25), ("_q3", 0.75))})
    low, high = F.greatest(F.lit(float(PRICES[0])), c("_q1") - 1.5 * (c("_q3") - c("_q1"))), c("_q3") + 1.5 * (c("_q3") - c("_q1"))
    few = c("_n") < FEW
    rows = rows.withColumns({"_kept": c("_valid") & (few | c("price").between(low, high)), "_below": c("_valid") & ~few & (c("price") < low)})
    number = lambda flag: F.coalesce(F.sum(F.when(c(flag), c("times"))).over(whole), F.lit(0))
    rows = rows.withColumns({"_k": number("_kept"), "_b": number("_below")}).where("_k > 0")

    wide = lambda x: x.cast("decimal(18,0)")
    times, price, mileage = wide(c("times")), wide(c("price")), wide(c("mileage"))
    both = c("price").isNotNull() & c("mileage").isNotNull()
    # A product of two numbers has up to 24 digits here, which leaves a sum 14 more.
    product = lambda a, b: (a * b).cast("decimal(24,0)") * times
    total = lambda x, when: F.sum(F.when(when, x.cast("decimal(38,0)"))).cast("double")
    found = rows.groupBy(*keys).agg(
        F.sum("times").alias("n"), F.max("_k").alias("n_kept"), *(at("_run", c("_b") + F.floor(c("_k") * F.lit(share)), "price").alias(name) for name, share in SHARES.items()),
        F.min(F.when(c("_kept"), c("price"))).alias("min_price"), F.max(F.when(c("_kept"), c("price"))).alias("max_price"),
        F.max("_n_m").alias("n_mileages"), at("_m_run", F.floor(c("_n_m") * F.lit(0.5)), "mileage").alias("median_mileage"), total(mileage * times, c("mileage").isNotNull()).alias("_sm"),
        F.sum(F.when(both, c("times"))).cast("double").alias("_c"), total(mileage * times, both).alias("_sx"), total(price * times, both).alias("_sy"),
        total(product(mileage, mileage), both).alias("_sxx"), total(product(mileage, price), both).alias("_sxy"),
        total(price * times, c("_kept")).alias("_s"), total(product(price, price), c("_kept")).alias("_q"),
    )
    zero = F.lit(0.0)
    n = c("n_kept").cast("double")
    slope = (c("_c") * c("_sxy") - c("_sx") * c("_sy")) / F.nullif(c("_c") * c("_sxx") - c("_sx") * c("_sx"), zero)
    spread = F.sqrt(F.greatest(zero, (n * c("_q") - c("_s") * c("_s")) / F.nullif(n * n, zero))) / F.nullif(c("_s") / n, zero)
    mean = half_up(c("_sm") / F.nullif(c("n_mileages"), F.lit(0)))
    return found.select(*keys, "n", "n_kept", *SHARES, "min_price", "max_price", "n_mileages", "median_mileage", mean.alias("mean_mileage"), (slope * 10_000.0).alias("slope"), spread.alias("spread"))


def snapshot_id(keys: Sequence[str] = SEGMENT) -> Column:
    return F.sha2(F.concat_ws("|", *keys), 256)


def members(listings: DataFrame, first: int | None = None) -> DataFrame:
    """Undamaged listings with the ``snapshot_id`` they belong to and their ``position`` in it by id, from 0; all or the first ones."""
    order = Window.partitionBy("snapshot_id").orderBy(*total_order(listings, "listing_id"))
    rows = listings.where("NOT is_damaged").withColumn("snapshot_id", snapshot_id())
    rows = rows.withColumn("position", F.row_number().over(order) - 1)
    return rows if first is None else rows.where(F.col("position") < first)


def decay(slope_: Column, p50: Column, n: Column, config: PricingConfig = DEFAULT) -> tuple[Column, Column]:
    """(decay per 10,000 km, where it comes from) of a segment with n mileages."""
    learned = (n >= 8) & (slope_ < 0) & (p50 > 0)
    value = F.when(learned, clamp(F.abs(slope_) / p50, 0.001, 0.015)).otherwise(F.lit(config.default_decay))
    source = F.when(learned, "LEARNED_FROM_LISTINGS").when((n >= 4) & (n < 8), "LIMITED_SAMPLE").otherwise("DEFAULT_FALLBACK")
    return value, source


def quality(n: Column, n_mileages: Column, n_kept: Column, spread: Column, variant: Column, body: Column, fuel: Column, transmission: Column) -> Column:
    """Data quality score of 0 to 100, to one decimal."""
    points = 50 + F.least(F.lit(20.0), n * 1.5) + 15.0 * n_mileages / n
    for column, worth in ((variant, 4), (body, 4), (fuel, 4), (transmission, 3)):
        points = points + F.when(blank(column), 0).otherwise(worth)
    even = F.when(n_kept >= 3, F.greatest(F.lit(0.0), 15 - 30 * spread)).otherwise(5.0)
    return half_up(clamp(points + even, 0.0, 100.0) * 10) / 10.0


def snapshots(listings: DataFrame, specs: DataFrame | None = None, config: PricingConfig = DEFAULT, ids: bool = True) -> DataFrame:
    """All statistics of every segment; ``specs`` adds body, fuel and transmission by name and year.

    With ``ids`` a segment has the list of its listings' ids, too; that list
    grows with the segment, and ``members`` gives the same as rows.
    """
    rows = from_counts(counted(listings), specs, config)
    if not ids:
        return rows
    lists = listings.where("NOT is_damaged").groupBy(snapshot_id().alias("snapshot_id")).agg(F.array_sort(F.collect_list("listing_id")).alias("listing_ids"))
    return rows.join(lists, "snapshot_id")


def from_counts(counts: DataFrame, specs: DataFrame | None = None, config: PricingConfig = DEFAULT) -> DataFrame:
    """The snapshots of ``counted`` rows."""
    c = F.col
    rows = statistics(counts)
    rows = with_specs(rows, specs) if specs is not None else rows.withColumns(dict.fromkeys(("body", "fuel", "transmission"), F.lit("")))
    value, source = decay(c("slope"), c("p50"), c("n_mileages"), config)
    return rows.select(
        *SEGMENT, "n", *SHARES, "min_price", "max_price", F.coalesce("median_mileage", F.lit(100_000)).cast("long").alias("median_mileage"), F.coalesce("mean_mileage", F.lit(100_000)).alias("mean_mileage"),
        "n_mileages", "slope", value.alias("decay"), source.alias("decay_source"),
        F.when(c("n") >= 12, 98).when(c("n") >= 6, 88).otherwise(72).alias("base_confidence"),
        quality(c("n"), c("n_mileages"), c("n_kept"), c("spread"), c("variant"), c("body"), c("fuel"), c("transmission")).alias("quality"),
        "n_kept", "body", "fuel", "transmission", F.lit("").alias("trim"), snapshot_id().alias("snapshot_id"),
    )


def with_specs(rows: DataFrame, specs: DataFrame) -> DataFrame:
    """Body, fuel and transmission of the first spec with the same names and year; '' where there is none."""
    key = lambda name: F.lower(F.trim(F.coalesce(F.col(name), F.lit(""))))
    names = ("make", "model", "variant")
    facts = specs.select(*(key(x).alias(f"_{x}") for x in names), F.col("year").alias("_year"), "body", "fuel", "transmission")
    first = first_of(facts, ["_make", "_model", "_variant", "_year"], total_order(facts))
    found = rows.join(first, [key(x) == F.col(f"_{x}") for x in names] + [F.col("year") == F.col("_year")], "left")
    return found.withColumns({x: F.coalesce(x, F.lit("")) for x in ("body", "fuel", "transmission")}).drop("_make", "_model", "_variant", "_year")


def percentile_prices(prices: DataFrame, keys: Sequence[str], price: str = "price") -> DataFrame:
    """Interpolated percentiles and trimmed mean of positive prices per key."""
    return percentiles_of(value_counts(prices.where(F.col(price) > 0), keys, F.col(price).cast("double")), keys)


def percentiles_of(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """n, p5..p95 and clean_average of counted (keys, value, times) rows.

    A percentile between two prices is rounded.  For the mean the lowest and
    highest tenth goes, one price at least at each end, if there are five or more.
    """
    rows = with_ranks(counts, keys)
    n, aggregates, points = F.col("total"), [], {}
    for p in (5, 35, 50, 60, 95):
        place = F.lit(p / 100.0) * (n - 1)
        aggregates += [at(F.floor(place)).alias(f"low{p}"), at(F.ceil(place)).alias(f"high{p}")]
        weight = F.lit(p / 100.0) * (F.col("n") - 1)
        weight = weight - F.floor(weight)
        points[f"p{p}"] = F.when(weight == 0, F.col(f"low{p}")).otherwise(half_up(F.col(f"low{p}") * (1 - weight) + F.col(f"high{p}") * weight).cast("double"))
    cut = F.when(n <= 4, 0).otherwise(F.greatest(F.lit(1), F.floor(n * F.lit(0.1))))
    inside = F.greatest(F.lit(0), F.least(F.col("before") + F.col("times"), n - cut) - F.greatest(F.col("before"), cut))
    found = rows.groupBy(*keys).agg(F.first("total").alias("n"), *aggregates, F.sum(F.col("value") * inside).alias("sum"), F.sum(inside).alias("used"))
    return found.select(*keys, F.col("n").cast("int").alias("n"), *(x.alias(k) for k, x in points.items()), half_up(F.col("sum") / F.col("used")).alias("clean_average"))


def value_counts(rows: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """(keys, value, times): how often each value of a key occurs; nulls count 0 times."""
    return rows.select(*keys, value.alias("value")).groupBy(*keys, "value").agg(F.count("value").alias("times"))


def ranked(rows: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """(keys, value, times, before, total) of the values of rows.

    Equal values are counted before the shuffle by key, and no key's values are
    gathered in one row.
    """
    return with_ranks(value_counts(rows, keys, value), keys)


def with_ranks(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counted rows with how many values of the key are smaller (``before``), and how many there are (``total``)."""
    run = Window.partitionBy(*keys).orderBy(F.col("value").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.select(*keys, "value", "times", (F.sum("times").over(run) - F.col("times")).alias("before"), F.sum("times").over(Window.partitionBy(*keys)).alias("total"))


def at(rank: Column) -> Column:
    """The value at a rank from 0, an aggregate over ``ranked`` rows; null beyond the last."""
    return F.min(F.when(F.col("before") + F.col("times") > rank, F.col("value")))


def two_averages(listings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rounded mean price of all listings, and of the undamaged ones, or of all where none is."""
    mean = lambda x: half_up(F.sum(x).cast("double") / F.nullif(F.count(x), F.lit(0)))
    clean = F.when(~F.col("is_damaged"), F.col("price"))
    return listings.groupBy(*keys).agg(F.count("*").alias("n"), mean(F.col("price")).alias("average"), F.coalesce(mean(clean), mean(F.col("price"))).alias("clean_average"))
