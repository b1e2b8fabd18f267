"""Valuations: match, price, and one of three statuses; consignment intake; audit report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewright.config import DEFAULT, PricingConfig
from pricewright.functions.pricing import priced
from pricewright.operators.matching import matched
from pricewright.operators.snapshots import members

SUCCESS, MANUAL, INSUFFICIENT = "SUCCESS", "MANUAL_EVALUATION_REQUIRED", "INSUFFICIENT_DATA"
OFFER = (
    "fmv", "adjusted_p35", "required", "cash_offer", "cash_min", "cash_max", "listing_price", "expected_sale", "fee", "customer_net", "days_min", "days_max", "confidence",
    "gross_reserve", "net_profit",
)


def valued(requests: DataFrame, snapshots: DataFrame, config: PricingConfig = DEFAULT) -> DataFrame:
    """Each request with its match, its offer and ``status``; no offer where data are insufficient."""
    return offered(matched(requests, snapshots, config), config)


#: What a match depends on besides the snapshots.
VEHICLE = ("make", "model", "variant", "year", "trim", "body", "fuel", "transmission")


def valued_in_bulk(requests: DataFrame, snapshots: DataFrame, config: PricingConfig = DEFAULT) -> DataFrame:
    """``valued``, for many requests of the same vehicles.

    A match depends on the vehicle only, so each is matched once, and the requests get
    its figures by one join: the arrays of candidates never meet the requests.  A
    popular vehicle is one row on its side, so the requests' side may be split.
    """
    found = matched(requests.select(*VEHICLE).distinct(), snapshots, config)
    figures = [c for c in found.columns if c not in VEHICLE]
    found = found.select(*(F.col(c).alias(f"_{c}") for c in VEHICLE), *figures)
    own = requests.drop(*figures)
    same = [own[c].eqNullSafe(found[f"_{c}"]) for c in VEHICLE]
    return offered(own.join(found, same, "left").drop(*(f"_{c}" for c in VEHICLE)), config)


def persisted(requests: DataFrame, snapshots: DataFrame, config: PricingConfig = DEFAULT) -> DataFrame:
    """The valuations that are stored: as ``valued``, but matched without the request's trim, and successful ones alone."""
    rows = valued(requests.withColumn("trim", F.lit("")), snapshots, config)
    # The status depends on every step of the price.  A condition that needs a row number stays above the
    # columns it reads; pushed below them, it would repeat each step in the next.
    rows = rows.withColumn("_number", F.monotonically_increasing_id())
    return rows.where((F.col("status") == SUCCESS) & (F.col("_number") >= 0)).drop("_number")


def offered(matches: DataFrame, config: PricingConfig = DEFAULT) -> DataFrame:
    """Matched requests with their offer and ``status``."""
    rows = priced(matches, config)
    enough = (F.col("level") < 4) & (F.col("p50") > 0)
    status = F.when(~F.coalesce(enough, F.lit(False)), INSUFFICIENT).when(F.col("manual"), MANUAL).otherwise(SUCCESS)
    rows = rows.withColumn("status", status)
    return rows.withColumns({c: F.when(F.col("status") != INSUFFICIENT, F.col(c)) for c in OFFER})


def comparables(valuations: DataFrame, listings: DataFrame, n: int = 5) -> DataFrame:
    """The first n listings of each valuation's snapshot; no more than those n of a segment are joined."""
    wanted = valuations.where("snapshot_id IS NOT NULL").select("request_id", "snapshot_id")
    return wanted.join(members(listings, n), "snapshot_id").select("request_id", "position", "listing_id", "price", "mileage")


def intake(applications: DataFrame, valuations: DataFrame, requests: DataFrame, snapshots: DataFrame, config: PricingConfig = DEFAULT) -> DataFrame:
    """Consignment applications with a valuation; those that have none are valued first."""
    open_ = applications.join(valuations.select("request_id").distinct(), "request_id", "left_anti").select("request_id").distinct()
    fresh = valued(requests.join(open_, "request_id", "left_semi"), snapshots, config)
    columns = ["request_id", "status", "customer_net", "expected_sale"]
    return applications.join(valuations.select(*columns).unionByName(fresh.select(*columns)), "request_id", "left")


def audit(valuations: DataFrame, again: DataFrame, fields: tuple[str, ...] = ("level", "n", *OFFER[:4], "listing_price", "customer_net", "gross_reserve", "net_profit", "status")) -> DataFrame:
    """Field by field, on how many probes two layers agree, nulls compared as values."""
    pairs = valuations.alias("a").join(again.alias("b"), "request_id")
    agree = [F.count_if(F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}"))).alias(f) for f in fields]
    one = pairs.agg(F.count("*").alias("n_probes"), *agree)
    return one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*fields))).alias("field", "n_equal"), "n_probes")
